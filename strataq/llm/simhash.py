"""SimHash near-duplicates by a binary trie self-join.

A fingerprint has 64 bits, so of four 16-bit bands at least one is equal in any two that differ
in three bits or fewer. For each band the fingerprints are rotated until that band leads; they then
form one binary trie per band value below depth 16, where no bit has differed yet. The self-join
walks pairs of trie nodes together, adds up differing bits and drops a node pair as soon as the sum
exceeds the budget. Nodes are ranges of a sorted array, so a level of the walk is a few vector operations.

A trie that holds more than ``max_node`` entries is not left to one task. Spark expands it into
the pairs of its child nodes (four levels at a time, same pruning), until both nodes of a pair are
small enough; each node pair is then walked by itself.

Every task reduces what it finds to a spanning forest, so a dense cluster of M fingerprints yields
fewer than M links. Components come from the forests of the tasks' links, then from alternating large-star
and small-star steps on them, distributed, with the lineage cut after each round.

Three of 64 bits is close to equality. For a given Jaccard similarity of shingle sets, ``similar_documents`` walks
the tries of several fingerprints of a set with a larger budget, and decides every pair of a group of candidates
by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import arrow_map, by_key, cut, join_by_share, row_key, utf8

BITS, BANDS = 64, 4
#: Levels that Spark expands at once, and frontier entries walked at once.
STEP, CHUNK = 4, 1 << 16
#: Below this many comparisons a node pair is compared outright.
LEAF = 64
#: Comparisons expanded at once, and edges joined at once.
MOST = 1 << 18
#: Edges of components that are worth a task.
SHARE = 50_000


# ---------------------------------------------------------------- fingerprints


def fingerprint_of(words: list[bytes], n: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the space-joined n-word shingles.

    No words: 0. Fewer than n words: the one shingle of all of them.
    """
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -n]))
    stops = ends[n - 1 :] - 1
    h = np.fromiter(
        [xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts.tolist(), stops.tolist())],
        np.uint64,
        len(starts),
    )
    bits = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 8192):
        bits += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the signed 64-bit view of each text's fingerprint; a null text counts as empty."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = [fingerprint_of(t.lower().split(), shingle) for t in utf8(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long")


# ---------------------------------------------------------------- the walk


class Forest:
    """Union-find over 0..n-1 fed with arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if np.array_equal(r, s):
                self.up[x] = r
                return r
            r = s

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if len(a):
                np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def walk(v: np.ndarray, alo, ahi, blo, bhi, depth: int, spent, budget: int, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of the sorted distinct ``v`` below the given node pairs with at most ``budget`` differing bits.

    A node at ``depth`` is a range of ``v`` that agrees in its first ``depth`` bits.
    """
    stack = [(depth, np.asarray(alo), np.asarray(ahi), np.asarray(blo), np.asarray(bhi), np.asarray(spent))]
    while stack:
        d, alo, ahi, blo, bhi, spent = stack.pop()
        if len(alo) > CHUNK:
            half = len(alo) // 2
            stack.append((d, alo[half:], ahi[half:], blo[half:], bhi[half:], spent[half:]))
            stack.append((d, alo[:half], ahi[:half], blo[:half], bhi[:half], spent[:half]))
            continue
        size = (ahi - alo) * (bhi - blo)
        leaf = (size <= LEAF) | (d >= bits)
        if leaf.any() and int(size[leaf].sum()) > MOST and (len(alo) > 1 or ahi[0] - alo[0] > 1):
            if len(alo) > 1:
                parts = [(x[: len(alo) // 2], x[len(alo) // 2 :]) for x in (alo, ahi, blo, bhi, spent)]
            else:  # one large node at full depth
                mid = (alo + ahi) // 2
                parts = [(alo, mid), (mid, ahi), (blo, blo), (bhi, bhi), (spent, spent)]
            stack += [(d, *(x[k] for x in parts)) for k in (0, 1)]
            continue
        if leaf.any():
            n = size[leaf]
            which = np.repeat(np.flatnonzero(leaf), n)
            at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            width = (bhi - blo)[which]
            i, j = alo[which] + at // width, blo[which] + at % width
            near = (i < j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            rest = ~leaf
            alo, ahi, blo, bhi, spent = alo[rest], ahi[rest], blo[rest], bhi[rest], spent[rest]
        if not len(alo):
            continue
        shift = np.uint64(BITS - 1 - d)
        one = np.uint64(1)

        def middle(lo):
            return np.searchsorted(v, ((v[lo] >> shift) | one) << shift)

        am, bm = np.clip(middle(alo), alo, ahi), np.clip(middle(blo), blo, bhi)
        same = alo == blo
        parts = []
        for a0, a1, b0, b1, cost, skip in (
            (alo, am, blo, bm, 0, None),
            (am, ahi, bm, bhi, 0, None),
            (alo, am, bm, bhi, 1, None),
            (am, ahi, blo, bm, 1, same),
        ):
            ok = (a0 < a1) & (b0 < b1) & (spent + cost <= budget)
            if skip is not None:
                ok &= ~skip  # the mirror image of the pair before
            parts.append((a0[ok], a1[ok], b0[ok], b1[ok], spent[ok] + cost))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*parts))))


@dataclass(frozen=True)
class Rule:
    """``lead`` bits agree, of the first ``bits`` at most ``budget`` differ, and of these and all checks at most ``total``, if given."""

    lead: int
    bits: int
    budget: int
    total: int | None = None


class Trie:
    """Entries of one band sorted by their rotated bits: what is walked, and the nodes they stand for; ``checks``: further fingerprints, one a row."""

    def __init__(self, rot: np.ndarray, node: np.ndarray, checks: np.ndarray) -> None:
        order = np.argsort(rot, kind="stable")
        self.v, self.node, self.checks = rot[order], node[order], checks[:, order].view(np.uint64)

    def ranges(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        head = self.v >> np.uint64(BITS - depth)
        lo = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
        return lo, np.append(lo[1:], len(head))

    def links(self, alo, ahi, blo, bhi, depth: int, spent, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        forest = Forest(len(self.v))
        for i, j in walk(self.v, alo, ahi, blo, bhi, depth, spent, rule.budget, rule.bits):
            if rule.total is not None:
                near = sum(np.bitwise_count(c[i] ^ c[j]).astype(np.int64) for c in (self.v, *self.checks)) <= rule.total
                i, j = i[near], j[near]
            forest.join(i, j)
        i = np.arange(len(self.v))
        r = forest.roots(i)
        own = self.node[r] != self.node
        return self.node[own], self.node[r[own]]


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) ^ np.uint64(1 << 63)


def _walk_bands(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (band, rotated bits): whole tries, of which the last waits for the next batch."""
        band, held = None, []

        def out(rows: np.ndarray) -> pa.RecordBatch:
            t = Trie(_unsigned(rows[0]), rows[1], rows[2:])
            lo, hi = t.ranges(rule.lead)
            many = hi - lo > 1
            lo, hi = lo[many], hi[many]
            u, v = t.links(lo, hi, lo, hi, rule.lead, np.zeros(len(lo), np.int64), rule)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            bands = b.column(0).to_numpy(zero_copy_only=False)
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
            for k in np.unique(bands):
                if held and k != band:
                    yield out(np.concatenate(held, 1))
                    held = []
                band = k
                held.append(rows[:, bands == k])
            if sum(x.shape[1] for x in held) >= 1 << 15:
                all_rows = np.concatenate(held, 1)
                head = _unsigned(all_rows[0]) >> np.uint64(BITS - rule.lead)
                keep = int(np.searchsorted(head, head[-1]))
                if keep:
                    yield out(all_rows[:, :keep])
                held = [all_rows[:, keep:]]
        if held:
            yield out(np.concatenate(held, 1))

    return run


def _walk_pair(rule: Rule, checks: list[str]):
    def run(key, pdf):
        """One pair of trie nodes that Spark has expanded from a large trie."""
        depth, spent = int(pdf["depth"].iloc[0]), int(pdf["spent"].iloc[0])
        node = pdf["node"].to_numpy(np.int64)
        t = Trie(_unsigned(pdf["rot"].to_numpy(np.int64)), node, pdf[checks].to_numpy(np.int64).T)
        lo, hi = t.ranges(depth)
        b = 0 if key[1] == key[2] else 1
        if b < len(lo):
            u, v = t.links(lo[:1], hi[:1], lo[b : b + 1], hi[b : b + 1], depth, np.array([spent]), rule)
        else:
            u = v = node[:0]
        return pd.DataFrame({"u": u, "v": v})

    return run


def trie_links(rotated: DataFrame, rule: Rule, max_node: int, in_band: int | None = None) -> DataFrame:
    """(u, v) among the rows (band, rot, node, checks..) of ``rotated``; rot: rotated bits from the top, the sign bit flipped,
    so that Spark's signed order is the unsigned one. ``in_band``: rows of a band, where known; no trie has more."""
    data = [c for c in rotated.columns if c != "band"]
    checks = data[2:]
    head = lambda depth: F.shiftrightunsigned(F.col("rot"), BITS - depth)
    some_large = in_band is None or in_band > max_node
    if some_large:
        large = cut(rotated.groupBy("band", head(rule.lead).alias("top")).count().where(F.col("count") > max_node).select("band", "top"))
        some_large = not large.isEmpty()
    common = rotated.withColumn("top", head(rule.lead))
    if some_large:
        common = common.join(large, ["band", "top"], "left_anti")
    found = by_key(common, "band", "top").select("band", *data).sortWithinPartitions("band", "rot").mapInArrow(_walk_bands(rule), "u long, v long")
    if not some_large:
        return found
    inside = rotated.withColumn("top", head(rule.lead)).join(large, ["band", "top"], "left_semi").select("band", *data)
    pairs = large.select("band", F.col("top").alias("na"), F.col("top").alias("nb"), F.lit(0).alias("spent"))
    for depth in range(rule.lead, rule.bits + 1, STEP):
        nodes = cut(inside.groupBy("band", head(depth).alias("n")).agg(F.count("*").alias("size")))
        sized = pairs.join(nodes.select("band", F.col("n").alias("na"), F.col("size").alias("n_a")), ["band", "na"]).join(
            nodes.select("band", F.col("n").alias("nb"), F.col("size").alias("n_b")), ["band", "nb"]
        )
        small = (F.col("n_a") + F.col("n_b") <= max_node) | F.lit(depth >= rule.bits)
        ready = sized.where(small).select("band", "na", "nb", "spent").withColumn("depth", F.lit(depth))
        sides = ready.select("*", F.explode(F.array_distinct(F.array("na", "nb"))).alias("at"))
        routed = sides.join(inside.withColumn("at", head(depth)), ["band", "at"]).select("band", "na", "nb", "spent", "depth", *data)
        found = found.unionByName(routed.groupBy("band", "na", "nb").applyInPandas(_walk_pair(rule, checks), "u long, v long"))
        wide = cut(sized.where(~small).select("band", "na", "nb", "spent"))
        if depth >= rule.bits or wide.isEmpty():
            break
        child = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit((1 << STEP) - 1)), lambda k: F.shiftleft(F.col(c), STEP) + k))
        pairs = (
            wide.withColumn("ca", child("na"))
            .withColumn("cb", child("nb"))
            .where((F.col("na") != F.col("nb")) | (F.col("ca") <= F.col("cb")))
            .withColumn("spent", F.col("spent") + F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))))
            .where(F.col("spent") <= rule.budget)
            .select("band", F.col("ca").alias("na"), F.col("cb").alias("nb"), "spent")
        )
    return found


FLIP = -(1 << 63)


def links(fps: DataFrame, budget: int = 3, max_node: int = 50_000) -> DataFrame:
    """(u, v): for the distinct fingerprints ``fp``, links that connect just what differs in at most ``budget`` bits.

    ``budget`` must be below the number of bands, 4.
    """
    if not 0 <= budget < BANDS:
        raise ValueError("budget must be 0 to 3")
    width = BITS // BANDS
    turn = lambda b: F.shiftleft("fp", width * b).bitwiseOR(F.shiftrightunsigned("fp", BITS - width * b)) if b else F.col("fp")
    bands = F.array(*[F.struct(F.lit(b).alias("band"), turn(b).bitwiseXOR(F.lit(FLIP)).alias("rot")) for b in range(BANDS)])
    rotated = cut(fps.select("fp").distinct().select(F.explode(bands).alias("x"), F.col("fp").alias("node")).select("x.*", "node"))
    return trie_links(rotated, Rule(width, BITS, budget), max_node)


# ---------------------------------------------------------------- components


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to stars (node, its root) of the same components, for at most ``MOST`` of a task's edges at once."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        node, at = np.unique(np.concatenate(held, 1), return_inverse=True)
        forest = Forest(len(node))
        forest.join(*at.reshape(2, -1))
        r = forest.roots(np.arange(len(node)))
        own = node[r] != node
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[r[own]])], ["u", "v"])

    for b in batches:
        held.append(np.stack([c.to_numpy() for c in b.columns]))
        n += b.num_rows
        if n >= MOST:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def components(edges: DataFrame, max_rounds: int = 60, share: int = SHARE) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (u, v); root: the smallest node reachable.

    Each task joins what its edges connect, first where they are found, then ``share`` of them at a time. Then large-star and small-star
    alternate until all that is left are stars; no adjacency list is ever gathered.
    """

    def stars(e: DataFrame) -> bool:
        """Whether each node has either one edge to a root, or is a root and has none."""
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("x"))
        return ends.groupBy("x.node").agg(F.sum("x.up").alias("up"), F.min("x.up").alias("low")).where("up > 1 or up > low").isEmpty()

    e = cut(edges.select("u", "v").mapInArrow(_forests, "u long, v long").distinct())
    parts = max(1, -(-e.count() // share))
    e = cut(e.coalesce(parts).mapInArrow(_forests, "u long, v long"))
    for _ in range(max_rounds):
        if stars(e):
            break
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.*").where("u <> v").distinct()).coalesce(parts)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, shingle: int = 3, budget: int = 3, max_node: int = 50_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id that is reachable over
    links, the row's own included. Nulls and edge cases: a null or empty text has fingerprint zero,
    which links like any other; a null doc_id stays null and never becomes a component_id unless the
    whole component has none; repeated rows come out as often as they came in; an empty table gives
    an empty result; further columns of ``docs`` are not read.
    """
    fp = cut(fingerprints(docs, shingle, id_col, text_col))
    least = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rows = _labelled(fp.withColumnRenamed("fp", "node"), least.withColumnRenamed("fp", "node"), components(links(least, budget, max_node)))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- by similarity


#: Fingerprints of ``similar_documents``. Each leads five tries, turned by 12 bits from one to the next. A bit differs with a chance of
#: 0.15 in a pair of similarity 0.8, so 12 leading bits agree in one trie of seven, and in none of all 85 for 3 pairs in a million.
WORDS, TURNS = 17, 5
#: Of a trie's 64 bits at most 18 may differ, and of these and the next two fingerprints' together at most 43: 1 pair in 1,000 at 0.8 has
#: more, in each trie with other bits. Of unrelated pairs fewer than 1 in 10 ** 14 have so few.
SIMILAR = Rule(12, BITS, 18, 43)
CHECKS = 2
#: Shingles of a candidate group that are compared in one block.
BLOCK = 400_000
_RND = np.random.default_rng(42)
_XOR = _RND.integers(0, 1 << 64, WORDS, np.uint64)
_TIMES, _MIX = (_RND.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1) for _ in range(2))


def shingles_of(words: list[bytes], n: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the n-word shingles; fewer than n words are one shingle, no words none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-n]))
    stops = ends[min(n, len(words)) - 1 :] - 1
    return np.unique(np.fromiter([xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts.tolist(), stops.tolist())], np.uint64, len(stops)))


def fingerprints_of(shingles: np.ndarray) -> np.ndarray:
    """WORDS signed fingerprints of a shingle set: the majority bits of as many digests of each shingle; an empty set has none."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    bits = np.zeros(WORDS * BITS, np.int64)
    for i in range(0, len(shingles), 255):
        g = (shingles[i : i + 255, None] ^ _XOR) * _TIMES
        g = (g ^ (g >> np.uint64(32))) * _MIX
        g ^= g >> np.uint64(29)
        bits += np.unpackbits(g.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(bits * 2 > len(shingles), bitorder="little").view(np.int64)


def similar_pairs(sets: list[np.ndarray], block: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect just what has a Jaccard similarity of ``least`` or more; of two blocks only pairs across count."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(size) - size
    forest, mark = Forest(len(sets)), np.zeros(codes.max(initial=-1) + 1, np.int64)
    across = block.min() != block.max()
    every = np.arange(len(sets))
    for i in np.flatnonzero(block == block.min()).tolist():
        other = block != block[i] if across else every > i
        roots = forest.roots(every)
        other &= roots != roots[i]
        if not other.any():
            continue
        own = codes[start[i] : start[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[codes], start)
        mark[own] = 0
        near = np.flatnonzero(other & (both >= least * (size[i] + size - both) - 1e-9))
        forest.join(np.full(len(near), i), near)
    r = forest.roots(every)
    return every[r != every], r[r != every]


def _decide(shingle: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (root, lo, hi, node, block, text) sorted by the first three: whole groups, of which the last waits for the next batch."""
        group, held = None, {}
        u: list[int] = []
        v: list[int] = []

        def decide() -> None:
            if len(held) > 1 and (group[1] == group[2] or len({b for b, _ in held.values()}) > 1):
                node = list(held)
                i, j = similar_pairs([shingles_of(t.lower().split(), shingle) for _, t in held.values()], np.array([b for b, _ in held.values()]), least)
                u.extend(node[k] for k in i)
                v.extend(node[k] for k in j)

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
            u.clear(), v.clear()
            return made

        for b in batches:
            for *key, node, block, text in zip(*(c.to_pylist() for c in b.columns[:5]), utf8(b.column(5))):
                if key != group:
                    decide()
                    group, held = key, {}
                held[node] = block, text
            yield out()
        decide()
        yield out()

    return run


def similar_links(sets: DataFrame, max_node: int = 200_000, in_band: int | None = None) -> DataFrame:
    """(u, v): candidates among the rows (node, fps) of distinct shingle sets, by the walk over the tries of their fingerprints."""
    width = SIMILAR.lead
    turn = lambda b: F.shiftleft("x", width * b).bitwiseOR(F.shiftrightunsigned("x", BITS - width * b)) if b else F.col("x")
    each = sets.select("node", "fps", F.posexplode("fps").alias("w", "x"))
    checks = [F.get("fps", (F.col("w") + k) % WORDS).alias(f"c{k}") for k in range(1, CHECKS + 1)]
    turned = F.array(*[F.struct((F.col("w") * TURNS + b).alias("band"), turn(b).bitwiseXOR(F.lit(FLIP)).alias("rot")) for b in range(TURNS)])
    rotated = each.select("node", *checks, F.explode(turned).alias("t")).select("t.band", "t.rot", "node", *[f"c{k}" for k in range(1, CHECKS + 1)])
    return trie_links(rotated, SIMILAR, max_node, in_band)


def _similar(docs: DataFrame, shingle: int, least_similarity: float, max_node: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, node, root, component_id) for every row; key: ``row_key`` of id and text, node: a digest of the shingle set."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("key"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles_of(t.lower().split(), shingle) for t in utf8(b.column(1))]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        fps = pa.array([fingerprints_of(s) for s in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(node), pa.array(list(map(len, sets)), pa.int64()), fps], ["doc_id", "key", "node", "size", "fps"])

    made = cut(arrow_map(slim, run, "doc_id long, key long, node long, size long, fps array<long>"))
    least = cut(made.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("size").alias("size"), F.first("fps").alias("fps")))
    met = similar_links(least.select("node", "fps").where("size > 0"), in_band=least.count())
    least = least.select("node", "least", "key", "size")
    group = components(met)
    group = cut(group.unionByName(group.select(F.col("root").alias("node"), "root").distinct()).distinct().join(least.drop("least"), "node"))
    blocks = F.greatest(F.ceil(F.sum("size") / BLOCK), F.ceil(F.count("*") / max_node), F.lit(1)).cast("int")
    sizes = cut(group.groupBy("root").agg(blocks.alias("blocks"), F.count("*").alias("n")))
    sides = join_by_share(group, sizes, ["root"], "n").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    texts = slim.select("key", "text").join(sides.select("key", "root", "node", "block", "blocks"), "key")
    pairs = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "block", "text"
    )
    pairs = by_key(pairs, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    return _labelled(made.select("doc_id", "key", "node"), least.select("node", "least"), components(pairs.mapInArrow(_decide(shingle, least_similarity), "u long, v long")))


def similar_documents(docs: DataFrame, shingle: int = 5, least_similarity: float = 0.8, max_node: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row: components of documents whose shingle sets have ``least_similarity`` or more in common.

    The self-join of the tries of the sets' fingerprints finds candidates; within a group of candidates all pairs are decided by the exact
    Jaccard similarity of their sets. Of more than ``BLOCK`` shingles or ``max_node`` sets a group is cut into blocks and each pair of blocks is a
    unit of its own. Nulls, empty texts and repeated rows are as in ``near_duplicates``.
    """
    return _similar(docs, shingle, least_similarity, max_node, id_col, text_col).select("doc_id", "component_id")


def _labelled(rows: DataFrame, least: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows (.., node) with root and component_id."""
    comp = comp.withColumnRenamed("node", "in")
    rooted = least.join(comp, least["node"] == comp["in"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    best = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    return rows.join(join_by_share(rooted, best, ["root"], "n").select("node", "root", "component_id"), "node")


def keep_one(docs: DataFrame, shingle: int = 5, least_similarity: float = 0.8, max_node: int = 50_000) -> DataFrame:
    """``docs`` with one row of each component of ``similar_documents``, that of the smallest doc_id.

    Rows are told apart by doc_id and text; a row without a doc_id stays only if no other of its component has one.
    """
    dup = cut(_similar(docs, shingle, least_similarity, max_node))
    first = dup.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("__key"))
    kept = docs.withColumn("__key", row_key("doc_id", "text")).join(first, "__key", "left_semi")
    twice = cut(dup.groupBy("key").count().where("count > 1").select(F.col("key").alias("__key")))
    if not twice.isEmpty():
        kept = kept.join(twice, "__key", "left_anti").unionByName(kept.join(twice, "__key", "left_semi").dropDuplicates(["__key"]))
    return kept.select(*docs.columns)
