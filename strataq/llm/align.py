"""Alignment of two tokenizers' tokens over the bytes of a text.

Each byte of a text has a label: no token ends here, one of A's does, one of B's, or both. A regular expression scans the labels for
spans that end in the first "both"; the numbers of the other two labels in a span tell how many tokens of each make up the group. Links are the
pairs of a group's tokens whose bytes overlap.

Where a single space stands between two characters that are no white space, both tokenizers end a token: the byte-level one begins a new
pre-token with the space, and no piece of the other has its word mark behind another character (which is looked up in the model; a
model that has such a piece gets whole texts). So a text is cut there, and the alignment of a piece, which depends on nothing
else, is kept by a worker in a bounded cache.

Documents are worked in batches. A batch keeps its distinct links and, by document, how often each occurs. Its links are sent
to shards by B id, where the counts of all batches are merged, and then meet the merged counts there; what comes back is
summed by document. So what is shuffled are distinct links by batch, as packed arrays, and no task holds more than a shard of the link table, whose size
the vocabularies bound.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm import bpe
from strataq.llm.common import by_key, collector_paused, cut, small_batches

#: Pieces of text a worker keeps, the longest such piece, and characters of a batch of documents.
CACHE, CACHED_CHARS, BATCH_CHARS = 300_000, 64, 1 << 21
#: Batches that meet one copy of a shard's counts.
BATCHES_A_COPY = 1 << 16

MARK = "▁"
#: Between these a space may not be cut off, and where none of them is near a space every space may.
DOUBTFUL = re.compile(r"[\s▁] | \s")
CUT = re.compile(r"(?<=[^\s▁])(?= \S)")
A_END, B_END, BOTH = b"abc"
GROUP = re.compile(rb"[^c]*c")


class Pair:
    """The two tokenizers, and the bytes of their entries."""

    def __init__(self, file_a: str, file_b: str) -> None:
        from sentencepiece import SentencePieceProcessor

        tokenizer, letters = bpe.load(file_a), _byte_letters()
        vocabulary = tokenizer.get_vocab()
        self.b = SentencePieceProcessor(model_file=file_b)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.a = self.by_ranks(file_a) or self.by_library(tokenizer)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in e], np.int64) for e in (self.a_bytes, self.b_bytes))
        self.digits = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.known: dict[str, tuple | None] = {}
        self.told: dict[str, str] = {}

    def by_ranks(self, file: str):
        """A's encoder by ranks, which is quicker on short texts: where ids are in the order of merges and the pre-tokenizer is the common byte-level one."""
        import public_tokenizers
        import tiktoken

        told = json.load(open(file, encoding="utf-8"))
        ids, merges = told["model"]["vocab"], told["model"]["merges"]
        made = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        special = {x["id"] for x in told["added_tokens"]}
        common = told["pre_tokenizer"].get("type") == "ByteLevel" and told["pre_tokenizer"].get("use_regex", True) and not told["pre_tokenizer"]["add_prefix_space"] and told["normalizer"] is None
        if not common or made != list(range(256, 256 + len(made))) or len(ids) != len(made) + 256 + len(special & set(ids.values())):
            return None
        ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in special}
        encode = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: map(encode, texts)

    @staticmethod
    def by_library(tokenizer):
        tokenizer.encode_special_tokens = True
        return lambda texts: (e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def pieces(self, text: str) -> list[str]:
        """The pieces of " " + ``text``, each without the space that it begins with."""
        if not self.cuts:
            return [text]
        return [c[1:] for c in CUT.split(f" {text}")] if DOUBTFUL.search(f" {text} ") else text.split(" ")

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode and align ``pieces`` that aren't known, all in one; the cache starts anew when it is full."""
        if len(self.known) > CACHE:
            self.known.clear()
            self.told.clear()
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        a, b = list(self.a([f" {p}" for p in new])), self.b.encode(new, num_threads=1)
        raw = f" {' '.join(new)}".encode()
        n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        ids_a, ids_b = np.fromiter(chain.from_iterable(a), np.int64), np.fromiter(chain.from_iterable(b), np.int64)
        if min(n_a.min(), n_b.min()) > 0 and self.spelled(a, self.a_bytes) == raw == self.spelled(b, self.b_bytes):
            ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
            if np.array_equal(ends_a[np.cumsum(n_a) - 1], ends_b[np.cumsum(n_b) - 1]):
                self.align(new, raw, ids_a, ids_b, ends_a, ends_b, n_a, n_b)
                return
        if len(new) == 1:
            self.known[new[0]], self.told[new[0]] = None, ""
            return
        for half in (new[: len(new) // 2], new[len(new) // 2 :]):  # some of them isn't spelled: find it
            self.learn(half)

    @staticmethod
    def spelled(ids: list[list[int]], entries: list[bytes]) -> bytes:
        return b"".join(map(entries.__getitem__, chain.from_iterable(ids)))

    def align(self, new: list[str], raw: bytes, ids_a, ids_b, ends_a, ends_b, n_a, n_b) -> None:
        """Align pieces whose bytes stand one after the other in ``raw``, and whose tokens do in ``ids_a`` and ``ids_b``."""
        labels = np.full(len(raw), ord("."), np.uint8)
        labels[ends_a - 1] = A_END
        labels[ends_b - 1] = np.where(labels[ends_b - 1] == A_END, BOTH, B_END)
        text_a, text_b = [list(map(self.digits.__getitem__, x.tolist())) for x in (ids_a, ids_b)]
        told, i, j = [], 0, 0
        for span in GROUP.findall(labels.tobytes()):
            m, n = i + span.count(b"a") + 1, j + span.count(b"b") + 1
            told.append(f"{text_a[i]}|{text_b[j]}" if m == i + 1 and n == j + 1 else f"{','.join(text_a[i:m])}|{','.join(text_b[j:n])}")
            i, j = m, n
        groups = np.searchsorted(np.flatnonzero(labels == BOTH), ends_a[np.cumsum(n_a) - 1])
        # links of a token of A: from the token of B that ends beyond its start to the last that starts before its end
        first = np.searchsorted(ends_b, ends_a - self.a_sizes[ids_a], side="right")
        n = np.searchsorted(ends_b - self.b_sizes[ids_b], ends_a, side="left") - first
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keys = np.repeat(ids_a, n) * len(self.b_bytes) + ids_b[np.repeat(first, n) + within]
        links = np.cumsum(np.add.reduceat(n, np.cumsum(n_a) - n_a))
        at, of = 0, 0
        for p, x, y, end, to in zip(new, n_a.tolist(), n_b.tolist(), groups.tolist(), links.tolist()):
            self.known[p] = (x, y, end - at, to - of, keys[of:to])
            self.told[p] = ";".join(told[at:end])
            at, of = end, to

    def documents(self, texts: list[str]) -> Aligned:
        """A batch of texts, empty ones without tokens."""
        pieces = [self.pieces(t) if t else [] for t in texts]
        number = {p: k for k, p in enumerate(dict.fromkeys(chain.from_iterable(pieces)))}
        self.learn(number)
        each = [self.known[p] for p in number]
        broken = np.fromiter((e is None for e in each), bool, len(each))
        sizes = np.array([(0, 0, 0, 0) if e is None else e[:4] for e in each], np.int64).reshape(-1, 4)
        keys = np.concatenate([np.empty(0, np.int64), *(e[4] for e in each if e is not None)])
        place = np.fromiter(map(number.__getitem__, chain.from_iterable(pieces)), np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(p) for p in pieces])
        spelled = np.bincount(doc, broken[place], len(texts)) == 0
        kept = spelled[doc]
        place, doc = place[kept], doc[kept]
        counts = np.column_stack([np.bincount(doc, sizes[place, k], len(texts)) for k in range(4)]).astype(np.int64)
        told = [";".join(map(self.told.__getitem__, p)) if ok else "" for p, ok in zip(pieces, spelled)]
        # distinct pieces of a document, then distinct links of it
        both, often = np.unique(doc * len(number) + place, return_counts=True)
        doc, place = np.divmod(both, max(1, len(number)))
        n, begins = sizes[place, 3], np.cumsum(sizes[:, 3]) - sizes[:, 3]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        distinct, link = np.unique(keys, return_inverse=True)
        link = link[np.repeat(begins[place], n) + within]
        both, at = np.unique(np.repeat(doc, n) * max(1, len(distinct)) + link, return_inverse=True)
        times = np.bincount(at, np.repeat(often, n), len(both)).astype(np.int64)
        doc, link = np.divmod(both, max(1, len(distinct)))
        for p in number:
            if len(p) > CACHED_CHARS:
                del self.known[p], self.told[p]
        return Aligned(counts, told, distinct, np.bincount(link, times, len(distinct)).astype(np.int64), np.bincount(doc, minlength=len(texts)), link, times)


class Aligned(NamedTuple):
    counts: np.ndarray  # tokens of A, of B, groups and links by document
    told: list[str]
    keys: np.ndarray  # distinct links of the batch
    totals: np.ndarray  # how often each occurs
    sizes: np.ndarray  # distinct links by document
    places: np.ndarray  # of these, document after document, the place among the keys
    times: np.ndarray  # and how often it occurs there


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable Latin-1, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in printable]
    return {chr(x): x for x in printable} | {chr(0x100 + k): x for k, x in enumerate(others)}


@lru_cache(1)
def pair(file_a: str, file_b: str) -> Pair:
    return Pair(file_a, file_b)


def small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, with the size in front."""
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype("u1")
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def large(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


_DOCUMENT = ("n_a", "n_b", "n_groups", "n_links")
_PAYLOAD = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.list_(pa.int64())) for c in _DOCUMENT), ("told", pa.list_(pa.string())), *((c, pa.binary()) for c in ("keys", "totals", "sizes", "places", "times"))])
PAYLOAD = "batch long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, told array<string>, keys binary, totals binary, sizes binary, places binary, times binary"


def batches_of(docs: DataFrame, file_a: str, file_b: str, told: str) -> DataFrame:
    """Batches of documents, aligned; ``told``: 'groups' for the groups as text, 'sha256' for their digest."""

    def put(number: int, ids: list, found: Aligned) -> pa.RecordBatch:
        groups = [t if told == "groups" or not t else hashlib.sha256(t.encode()).hexdigest() for t in found.told]
        asked = found.totals > 0  # not those of texts that have no tokens after all
        row = (number, ids, *found.counts.T.tolist(), groups, found.keys[asked].tobytes(), found.totals[asked].tobytes(), small(found.sizes), small((np.cumsum(asked) - 1)[found.places]), small(found.times))
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, _PAYLOAD.types)], _PAYLOAD.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part, number = pair(file_a, file_b), TaskContext.get().partitionId() << 32, 0
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            lo = 0
            while lo < len(ids):
                hi, chars = lo, 0
                while hi < len(ids) and (hi == lo or chars + len(texts[hi]) <= BATCH_CHARS):
                    chars += len(texts[hi])
                    hi += 1
                with collector_paused():
                    made = put(part + number, ids[lo:hi], both.documents(texts[lo:hi]))
                yield made
                lo, number = hi, number + 1

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PAYLOAD)


SENT = "shard int, batch long, keys binary, totals binary"
COUNTED = "shard int, keys binary, totals binary, best binary"


def sent(made: DataFrame, b_ids: int, shards: int) -> DataFrame:
    """A batch's distinct links by shard of their B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, keys, totals in zip(*(c.to_pylist() for c in b.columns)):
                keys, totals = np.frombuffer(keys, np.int64), np.frombuffer(totals, np.int64)
                shard = keys % b_ids % shards
                order = np.argsort(shard, kind="stable")
                ends = np.searchsorted(shard[order], np.arange(shards + 1))
                some = [s for s in range(shards) if ends[s] < ends[s + 1]]
                parts = [order[ends[s] : ends[s + 1]] for s in some]
                cols = [pa.array(some, pa.int32()), pa.array([batch] * len(some), pa.int64()), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (keys, totals))]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "batch", "keys", "totals"])

    return made.select("batch", "keys", "totals").mapInArrow(run, SENT)


class Sums:
    """Counts by link key, merged when as much has come in as is held."""

    def __init__(self) -> None:
        self.keys, self.totals, self.new, self.waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, keys: bytes, totals: bytes) -> None:
        self.new.append((np.frombuffer(keys, np.int64), np.frombuffer(totals, np.int64)))
        self.waiting += len(self.new[-1][0])
        if self.waiting > max(len(self.keys), 1 << 17):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        totals = np.concatenate([self.totals, *(t for _, t in self.new)])
        order = np.argsort(keys, kind="stable")
        keys, totals = keys[order], totals[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        self.keys, self.totals, self.new, self.waiting = keys[first], np.add.reduceat(totals, first) if len(first) else totals, [], 0


def counted(requests: DataFrame, b_ids: int) -> DataFrame:
    """A row a shard: its link keys in order, how often each occurs, and whether that is the most for its B id. Merged within tasks before and after the exchange."""

    def merged(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards: dict[int, Sums] = {}
            at = None

            def done() -> Iterator[pa.RecordBatch]:
                for s, sums in shards.items():
                    sums.merge()
                    b = sums.keys % b_ids
                    most = np.zeros(b_ids, np.int64)
                    if last:
                        np.maximum.at(most, b, sums.totals)
                    best = (sums.totals == most[b]).astype(np.uint8) if last else np.empty(0, np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (sums.keys, sums.totals, best))], ["shard", "keys", "totals", "best"])
                shards.clear()

            for b in batches:
                for s, keys, totals in zip(*(c.to_pylist() for c in b.columns)):
                    if last and s != at:  # rows are in order: one shard at a time
                        yield from done()
                        at = s
                    shards.setdefault(s, Sums()).add(keys, totals)
                if not last and sum(len(x.keys) for x in shards.values()) > 1 << 22:
                    yield from done()
            yield from done()

        return run

    partial = requests.select("shard", "keys", "totals").mapInArrow(merged(False), COUNTED).select("shard", "keys", "totals")
    return by_key(partial, "shard").sortWithinPartitions("shard").mapInArrow(merged(True), COUNTED)


ANSWERED = "batch long, found binary, totals binary, best binary"


def answered(requests: DataFrame, counts: DataFrame, copies: int) -> DataFrame:
    """What each batch asked for of a shard: (batch, keys, their counts, whether they are their B id's most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = totals = best = None
        for b in batches:
            rows = []
            for of, batch, asked, t, m in zip(*(c.to_pylist() for c in b.columns)):
                asked = np.frombuffer(asked, np.int64)
                if batch is None:
                    keys, totals, best = asked, np.frombuffer(t, np.int64), np.frombuffer(m, np.uint8)
                    continue
                at = np.searchsorted(keys, asked)
                rows.append((batch, asked.tobytes(), totals[at].tobytes(), best[at].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["batch", "found", "totals", "best"])

    asks = requests.select("shard", F.pmod(F.xxhash64("batch"), F.lit(copies)).alias("copy"), "batch", "keys")
    tables = counts.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    cells = tables.unionByName(asks, allowMissingColumns=True).withColumn("of", F.concat_ws(":", "shard", "copy"))
    ordered = by_key(cells, "shard", "copy").sortWithinPartitions("of", F.col("batch").asc_nulls_first())
    return ordered.select("of", "batch", "keys", "totals", "best").mapInArrow(run, ANSWERED)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def summed(made: DataFrame, answers: DataFrame) -> DataFrame:
    """Each document's row, with its links' counts summed."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.string() if n == "groups_sha256" else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []

        def done() -> pa.RecordBatch:
            _, ids, a, b, groups, links, told, keys, sizes, places, times = held
            keys, sizes, places, times = np.frombuffer(keys, np.int64), large(sizes), large(places), large(times)
            totals, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for f, t, m in parts:
                at = np.searchsorted(keys, np.frombuffer(f, np.int64))
                totals[at], best[at] = np.frombuffer(t, np.int64), np.frombuffer(m, np.uint8)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            by_doc = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[places] * times)))[ends])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, a, b, groups, links, by_doc(best), by_doc(totals), told), kinds)], names)

        for rows in batches:
            for *payload, f, t, m in zip(*(c.to_pylist() for c in rows.columns)):
                if f is None:
                    if held:
                        yield done()
                    held, parts = payload, []
                else:
                    parts.append((f, t, m))
        if held:
            yield done()

    stored = ["batch", "doc_ids", *_DOCUMENT, "told", "keys", "sizes", "places", "times"]
    both = made.select(*stored).unionByName(answers, allowMissingColumns=True).select(*stored, "found", "totals", "best")
    return by_key(both, "batch").sortWithinPartitions("batch", F.col("found").isNotNull()).mapInArrow(run, RESULT)


def groups(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups) of each document, groups as text: ``a1,a2|b1;a3|b2,b3``.

    B encodes the text and A a space and the text, as B puts one there itself; strings of special tokens are plain text. A text that is null,
    empty, or not spelled by both has no tokens: zeros and ''. Rows keep their ids, null ones too; repeated rows are repeated; a
    long text is worked whole; an empty table gives none; further columns are not read.
    """
    made = batches_of(docs, file_a, file_b, "groups")
    each = made.select(F.explode(F.arrays_zip("doc_ids", *_DOCUMENT, "told")).alias("x"))
    return each.select(F.col("x.doc_ids").alias("doc_id"), *[f"x.{c}" for c in _DOCUMENT], F.col("x.told").alias("groups"))


def _b_ids(file_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=file_b).get_piece_size()


def links(docs: DataFrame, file_a: str, file_b: str, shards: int = 64) -> DataFrame:
    """(a, b, n, best): every pair of ids that is linked anywhere, how often, and whether b is linked with no other id more often."""
    b_ids = _b_ids(file_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for keys, totals, best in zip(*(c.to_pylist() for c in rows.columns)):
                keys = np.frombuffer(keys, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys // b_ids), pa.array(keys % b_ids), pa.array(np.frombuffer(totals, np.int64)), pa.array(np.frombuffer(best, np.uint8).astype(bool))], ["a", "b", "n", "best"])

    counts = counted(sent(batches_of(docs, file_a, file_b, "sha256"), b_ids, shards), b_ids)
    return counts.select("keys", "totals", "best").mapInArrow(run, "a long, b long, n long, best boolean")


def measure(docs: DataFrame, file_a: str, file_b: str, shards: int = 64) -> DataFrame:
    """Each document's row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; odd rows as in ``groups``.

    n_best are the links whose count over all documents is the highest of their B id, count_sum the sum of the counts of all links.
    """
    b_ids = _b_ids(file_b)
    made = cut(batches_of(docs, file_a, file_b, "sha256"))
    requests = sent(made, b_ids, shards)
    copies = -(-made.count() // BATCHES_A_COPY)
    return summed(made, answered(requests, counted(requests, b_ids), max(1, copies)))
