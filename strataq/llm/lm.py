"""Scores of documents by masked pseudo-likelihood.

A bidirectional window network predicts each word from the two words before and the two behind it. Its hidden layer
adds an embedding per place and context class, its softmax covers word classes: the ``own`` most frequent words
of the corpus have a class each, any other word falls in the class of its ending. The probability of a word is that of its class
times the word's share of the class, by its count in the whole corpus. A document's score is the sum of the logarithms over its words.

Words are numbers of ``ENDING`` + ``WORD`` bits, a digest of the ending and one of the word, so a vocabulary of four million words needs no table
of strings, and a text is split into words once: ``numbered`` writes the numbers to the shared folder, and counting,
training and scoring read them. Counts cover all documents.

Training deals the documents into shards by a digest of id and text and in an order that depends on nothing else. Each shard trains
a copy of the parameters by Adam in numpy; the rounds together take every window once; the copies are averaged by the
windows they saw, in exact decimals. So neither the number of tasks nor their order changes a score. Only
the averaged parameters and the table of counts, both of a fixed size, come to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import by_key, cut, small_batches, utf8

#: Bits of a word's number: digest of its last two bytes, then of the whole word.
ENDING, WORD = 5, 17
NUMBERS = 1 << ENDING + WORD
#: Numbers that a worker keeps by word.
HELD = 400_000
#: Added to the count of every number: small, so that a word which no other document holds stands apart from one that another does.
ALPHA = 0.01
PLACES = (-2, -1, 1, 2)
EDGE = 0
#: Parameters are averaged in steps of 2 ** -STEP.
STEP = 30


class Numbers(dict):
    """Number of a word, kept for words met before."""

    def __missing__(self, word: bytes) -> int:
        n = (zlib.crc32(word[-2:]) & (1 << ENDING) - 1) << WORD | zlib.crc32(word) & (1 << WORD) - 1
        if len(self) >= HELD:
            self.clear()
        self[word] = n
        return n


def numbers_of(text: bytes, known: Numbers) -> np.ndarray:
    return np.array([known[w] for w in text.lower().split()], "<u4")


def numbered(docs: DataFrame, shard_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shard, order, ids): each row's words as packed numbers, in the shared folder, by shard and in order.

    Null and empty texts have none; a null doc_id stays null; repeated rows stay; an empty table gives none.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = F.xxhash64("doc_id", "text")
    shard = F.pmod(order, F.lit(max(1, -(-size // shard_bytes)))).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Numbers()
        for b in batches:
            ids = pa.array([numbers_of(t, known).tobytes() for t in utf8(b.column(3))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], ids], ["doc_id", "shard", "order", "ids"])

    small_batches(docs.sparkSession)
    made = slim.select("doc_id", shard.alias("shard"), order.alias("order"), "text").mapInArrow(run, "doc_id long, shard int, order long, ids binary")
    return cut(by_key(made, "shard").sortWithinPartitions("shard", "order", "doc_id"))


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in column.to_pylist()]


def counts(table: DataFrame) -> np.ndarray:
    """How often each number occurs in the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(NUMBERS, np.int64)
        for b in batches:
            x = np.concatenate([np.empty(0, "<u4"), *_ids(b.column(0))])
            n += np.bincount(x, minlength=NUMBERS)
        at = np.flatnonzero(n)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)].astype(np.int32)), pa.array(n[at[k : k + (1 << 16)]])], ["number", "n"])

    found = table.select("ids").mapInArrow(run, "number int, n long").groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(NUMBERS, np.int64)
    out[found.column("number").to_numpy()] = found.column("n").to_numpy()
    return out


class Classes:
    """Class of each number: 1.. own for the most frequent, then one by ending; 0 is beyond a text's edge."""

    def __init__(self, n: np.ndarray, own: int) -> None:
        self.n = n
        self.of = (own + 1 + (np.arange(NUMBERS) >> WORD)).astype(np.int16)
        top = np.lexsort((np.arange(NUMBERS), -n))[:own]
        top = top[n[top] > 0]
        self.of[top] = 1 + np.arange(len(top))
        self.size = own + 1 + (1 << ENDING)
        #: Words and distinct numbers of each class.
        self.words = np.bincount(self.of, n, self.size).astype(np.int64)
        self.distinct = np.bincount(self.of, n > 0, self.size).astype(np.int64)

    def share(self, ids: np.ndarray, less: np.ndarray | int = 0) -> np.ndarray:
        """Logarithm of each word's share of its class, ``less`` of its occurrences not counted, ``ALPHA`` added to every number."""
        c = self.of[ids]
        return np.log(np.maximum(self.n[ids] - less, 0) + ALPHA) - np.log(self.words[c] + ALPHA * np.maximum(self.distinct[c], 1))


def start(classes: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    return {
        "e": r.normal(0, 0.1, (len(PLACES), classes, hidden)).astype(np.float32),
        "b": np.zeros(hidden, np.float32),
        "u": r.normal(0, 0.1, (hidden, classes)).astype(np.float32),
        "c": np.zeros(classes, np.float32),
    }


def flat(params: dict) -> np.ndarray:
    return np.concatenate([v.ravel() for v in params.values()])


def shaped(values: np.ndarray, like: dict) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = values[at : at + v.size].reshape(v.shape).astype(v.dtype)
        at += v.size
    return out


def contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes around the positions ``at`` of ``ids``, which ends in and begins with two edges."""
    return ids[at[None, :] + np.array(PLACES)[:, None]]


def forward(p: dict, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = p["b"] + p["e"][0][ctx[0]]
    for k in range(1, len(PLACES)):
        h += p["e"][k][ctx[k]]
    np.tanh(h, out=h)
    z = h @ p["u"]
    z += p["c"]
    return h, z


class Adam:
    def __init__(self, p: dict, rate: float) -> None:
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, ctx: np.ndarray, want: np.ndarray) -> None:
        p, n = self.p, len(want)
        h, z = forward(p, ctx)
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        z[np.arange(n), want] -= 1
        z /= n
        dh = (z @ p["u"].T) * (1 - h * h)
        one = np.zeros((n, p["c"].size), np.float32)
        de = np.empty_like(p["e"])
        rows = np.arange(n)
        for k in range(len(PLACES)):
            one[rows, ctx[k]] = 1
            de[k] = one.T @ dh
            one[rows, ctx[k]] = 0
        self.t += 1
        for name, g in (("e", de), ("b", dh.sum(0)), ("u", h.T @ z), ("c", z.sum(0))):
            m, v = self.m[name], self.v[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p[name] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def stream(texts: list[np.ndarray], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts with two edges around each, and the positions of their words."""
    edge = np.full(2, EDGE, of.dtype)
    x = np.concatenate([edge, *(y for t in texts for y in (of[t], edge))])
    return x, np.flatnonzero(x != EDGE)


def turns(n: int, turn: int, rounds: int) -> np.ndarray:
    """Which of ``n`` windows a round takes; all rounds together take each once."""
    return np.arange(n) % rounds == turn


class Scorer:
    """A trained network with its word classes."""

    def __init__(self, classes: Classes, params: dict) -> None:
        self.classes, self.params = classes, params

    def class_scores(self, x: np.ndarray, at: np.ndarray, step: int = 4096) -> np.ndarray:
        """Log-probability of the class at each position, given both sides."""
        out = np.empty(len(at), np.float64)
        for k in range(0, len(at), step):
            a = at[k : k + step]
            _, z = forward(self.params, contexts(x, a))
            want = x[a]
            top = z.max(1)
            own = z[np.arange(len(a)), want]
            z -= top[:, None]
            np.exp(z, out=z)
            out[k : k + step] = own - top - np.log(z.sum(1))
        return out

    def score_batch(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed log-probabilities of each text, with the counts of the whole corpus and with those of all other documents, and words that no other has."""
        x, at = stream(texts, self.classes.of)
        n = np.array([len(t) for t in texts], np.int64)
        ids = np.concatenate([np.empty(0, "<u4"), *texts]).astype(np.int64)
        both = np.repeat(np.arange(len(n)), n) * NUMBERS + ids
        _, back, often = np.unique(both, return_inverse=True, return_counts=True)
        base = self.class_scores(x, at)
        sums = lambda s: np.diff(np.concatenate(([0.0], np.cumsum(s)))[np.concatenate(([0], np.cumsum(n)))])
        less = often[back]
        return sums(base + self.classes.share(ids)), sums(base + self.classes.share(ids, less)), sums(self.classes.n[ids] <= less)

    def score(self, table: DataFrame) -> DataFrame:
        """(doc_id, n_words, score, mean_score, mean_apart, n_alone) for each row of a ``numbered`` table.

        score: the summed log-probability; mean_score: its mean by word; mean_apart: the same mean with the document's own
        words left out of the counts, so that only what other documents hold makes a rare word likely; n_alone: words that no other document holds.
        Null and empty texts have no words, score 0 and null means; a null doc_id stays null; repeated rows come out as often as they came in.
        A text of any length is scored whole, in steps of bounded size; an empty table gives none.
        """
        spark = table.sparkSession
        shared = spark.sparkContext.broadcast(self)  # the counts of NUMBERS numbers, and the parameters: a fixed size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = _ids(b.column(1))
                n = [len(t) for t in texts]
                total, apart, alone = shared.value.score_batch(texts)
                mean = lambda s: pa.array([round(float(t) / k, 6) if k else None for t, k in zip(s, n)], pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(np.round(total, 6)), mean(total), mean(apart), pa.array(alone.astype(np.int64))], ["doc_id", "n_words", "score", "mean_score", "mean_apart", "n_alone"])

        small_batches(spark)
        return table.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_words long, score double, mean_score double, mean_apart double, n_alone long")


def train(rows: Iterator[tuple[int, np.ndarray]], of: np.ndarray, first: dict, turn: int, rounds: int, batch: int, pool: int, rate: float, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(windows, parameters) of each shard, from its texts in order; pools of ``pool`` words are mixed and cut into batches."""
    shard, adam, seen, texts, held = None, None, 0, [], 0

    def learn() -> int:
        x, at = stream(texts, of)
        at = at[turns(len(at), turn, rounds)]
        at = at[np.random.default_rng(seed).permutation(len(at))]
        for lo in range(0, len(at), batch):
            adam.step(contexts(x, at[lo : lo + batch]), x[at[lo : lo + batch]])
        return len(at)

    for k, ids in rows:
        if k != shard:
            if texts:
                seen += learn()
            if seen:
                yield seen, flat(adam.p)
            shard, adam, seen, texts, held = k, Adam({n: v.copy() for n, v in first.items()}, rate), 0, [], 0
        texts.append(ids)
        held += len(ids)
        if held >= pool:
            seen += learn()
            texts, held = [], 0
    if texts:
        seen += learn()
    if seen:
        yield seen, flat(adam.p)


def fit(table: DataFrame, own: int = 95, hidden: int = 24, rounds: int = 2, batch: int = 4096, pool: int = 1 << 17, rate: float = 0.01, seed: int = 0) -> Scorer:
    """Count and train over a whole ``numbered`` table; an empty one leaves the network as it starts."""
    classes = Classes(counts(table), own)
    params = start(classes.size, hidden, seed)
    of = table.sparkSession.sparkContext.broadcast(classes.of)
    small_batches(table.sparkSession)
    for r in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], first=params, turn=r) -> Iterator[pa.RecordBatch]:
            rows = ((s, i) for b in batches for s, i in zip(b.column(0).to_pylist(), _ids(b.column(1))))
            for seen, p in train(rows, of.value, first, turn, rounds, batch, pool, rate, seed):
                whole = np.rint(p.astype(np.float64) * (1 << STEP)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(p), dtype=np.int32)), pa.array(whole), pa.array(np.full(len(p), seen, np.int64))], ["k", "v", "n"])

        trained = table.select("shard", "ids").mapInArrow(run, "k int, v long, n long")
        weighed = F.sum(F.col("v").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")) / F.sum("n").cast("decimal(20,0)")
        mean = trained.groupBy("k").agg(weighed.cast("double").alias("v")).toArrow()
        if not mean.num_rows:
            break
        values = np.empty(mean.num_rows)
        values[mean.column("k").to_numpy()] = mean.column("v").to_numpy() / (1 << STEP)
        params = shaped(values, params)
    return Scorer(classes, params)
