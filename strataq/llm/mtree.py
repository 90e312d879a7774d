"""Exact search for the largest inner products by best-first search of M-trees.

Components are integers. With one more component sqrt(M - |v|^2), M the greatest squared norm of all, vectors lie on a sphere, and a query
with 0 there has the squared distance |q|^2 + M - 2 <q, v> to v: the nearest is the one of the largest product. So an M-tree, which only knows distances,
serves: its nodes are pages of entries; a leaf's entry is a vector with its distance to the page's routing object, an inner one
a routing object with the radius that covers its page and its distance to the parent's. By the triangle inequality
|d(q, parent) - d(entry, parent)| - radius bounds an entry from below before its own distance is computed; pages are taken by their
bounds, least first, until none can hold anything better than the k-th best. Products are whole numbers and exact, so ties are
settled by id and no bound, which has a small margin for rounding, can lose one.

Equal vectors are one entry with its k + 1 least ids: of a group of copies nothing else can be among the k best. Distinct vectors
are dealt to at most ``pivots`` groups by their nearest pivot, groups to trees of at most some ``tree_size`` vectors, and trees
are built and written once. A query first visits a tree of its own group, and then, with that k-th best as limit, the trees of
all groups whose covering radius reaches within it. A task holds one tree and streams queries past it, some of which, by home, search
together: they share the order of pages, and each has bounds and a limit of its own.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strataq.llm.common import by_key, cut, join_by_share, small_batches

#: Entries of a page.
PAGE = 128
#: Relative margin of all bounds for rounding, and that of squared distances against the squared norms that they are differences of.
MARGIN, BLUR = 1e-9, 1e-15


def whole(vectors: DataFrame, scale: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, of rows with an id and a vector without null or non-finite components, and at least one."""
    v = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    finite = F.forall(F.col(vec_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(id_col).isNotNull() & F.coalesce(finite & (F.size(vec_col) > 0), F.lit(False)))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def packed(rows: DataFrame, kind: str) -> DataFrame:
    """(vec_id, dim, vec): distinct rows with their vectors packed as integers of ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(kind), np.asarray(lists.value_lengths()).cumsum()
            vec = [x.tobytes() for x in np.split(flat, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([b.column(0), lists.value_lengths(), pa.array(vec, pa.binary())], ["vec_id", "dim", "vec"])

    return rows.mapInArrow(run, "vec_id long, dim int, vec binary").distinct()


class Facts:
    """What all tasks must know of the table: greatest squared norm, and how vectors are packed."""

    def __init__(self, most: float, norm: float, dim: int) -> None:
        if dim * most * most >= 2.0**63:
            raise ValueError("inner products would pass 64 bits")
        self.kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 2.0**bits)
        #: Products are summed as doubles while these hold them exactly.
        self.sums = np.float64 if dim * most * most < 2.0**53 else np.int64
        self.norm = norm

    def rows(self, vecs: list[bytes], dim: int) -> np.ndarray:
        return np.frombuffer(b"".join(vecs), self.kind).reshape(-1, dim).astype(self.sums)

    def points(self, x: np.ndarray) -> np.ndarray:
        """``x`` with the component that puts it on the sphere."""
        x = x.astype(np.float64)
        return np.column_stack((x, np.sqrt(np.maximum(self.norm - (x * x).sum(1), 0))))

    def blur(self, own):
        """What rounding may do to a few distances of a query of squared norm ``own``: it shows where they are small beside the norms."""
        return 4 * np.sqrt(BLUR * (np.asarray(own, np.float64) + self.norm))

    def apart(self, own: float, product):
        """Distance of a query of squared norm ``own`` to what has this product with it."""
        return np.sqrt(np.maximum(own + self.norm - 2.0 * np.asarray(product, np.float64), 0))


def facts(rows: DataFrame) -> Facts | None:
    total = lambda f: F.aggregate("v", F.lit(0.0), f)
    most, norm = total(lambda a, x: F.greatest(a, F.abs(x))), total(lambda a, x: a + x * x)
    r = rows.agg(F.max(most), F.max(norm), F.max(F.size("v"))).first()
    return None if r[2] is None else Facts(*r)


def between(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(1))


# ---------------------------------------------------------------- building

PAGES = "tree long, page int, leaf boolean, dim int, objects binary, apart binary, radii binary, children binary, ids binary, ends binary"


class Builder:
    """The pages of one tree; page 0 is the root, whose routing object stands in the page before it, -1."""

    def __init__(self, facts: Facts, tree: int, dim: int, vecs: list[bytes], ids: list[list[int]]) -> None:
        self.facts, self.tree, self.dim, self.vecs, self.ids, self.pages = facts, tree, dim, vecs, ids, []
        self.points = facts.points(facts.rows(vecs, dim))
        self.random = np.random.default_rng(len(vecs))
        every = np.arange(len(vecs))
        centre = int(between(self.points, self.points.mean(0)).argmin())
        self.put(-1, False, [centre], [0.0], [between(self.points, self.points[centre]).max()], [0])
        self.made = 0
        waiting = [(every, centre, self.number())]
        while waiting:
            at, parent, page = waiting.pop()
            if len(at) <= PAGE:
                self.put(page, True, at, between(self.points[at], self.points[parent]))
                continue
            parts = self.split(at)
            numbers = [self.number() for _ in parts]
            radii = [between(self.points[p], self.points[s]).max() for s, p in parts]
            seeds = [s for s, _ in parts]
            self.put(page, False, seeds, between(self.points[seeds], self.points[parent]), radii, numbers)
            waiting += [(p, s, n) for (s, p), n in zip(parts, numbers)]

    def number(self) -> int:
        self.made += 1
        return self.made - 1

    def split(self, at: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(routing object, entries) of the parts of ``at``: by nearest of some chosen entries, too large parts in shells."""
        n = min(PAGE, -(-len(at) // PAGE))
        seeds = self.random.choice(at, max(n, 2), replace=False)
        x, y = self.points[at], self.points[seeds]
        near = ((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T).argmin(1)
        most = -(-3 * len(at) // (2 * len(seeds)))
        out = []
        for k, s in enumerate(seeds.tolist()):
            part = at[near == k]
            if len(part) > most:
                part = part[np.argsort(between(self.points[part], self.points[s]), kind="stable")]
            out += [(s, p) for p in np.array_split(part, -(-len(part) // most))] if len(part) else []
        return out

    def put(self, page: int, leaf: bool, at, apart, radii=(), children=()) -> None:
        ids = [self.ids[k] for k in at] if leaf else []
        row = (self.tree, page, leaf, self.dim, b"".join(self.vecs[k] for k in at), np.asarray(apart, "<f8").tobytes(), np.asarray(radii, "<f8").tobytes(), np.asarray(children, "<i4").tobytes())
        self.pages.append((*row, np.array([i for x in ids for i in x], "<i8").tobytes(), np.cumsum([len(x) for x in ids], dtype="<i4").tobytes()))


_PAGES = pa.schema([("tree", pa.int64()), ("page", pa.int32()), ("leaf", pa.bool_()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("objects", "apart", "radii", "children", "ids", "ends"))])


def built(dealt: DataFrame, facts: Facts) -> DataFrame:
    """The pages of all trees, out of (tree, dim, vec, ids); a task holds one tree's vectors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, dim, vecs, ids = None, None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            pages = Builder(facts, at, dim, vecs, ids).pages
            for lo in range(0, len(pages), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pages[lo : lo + 64]), _PAGES.types)], _PAGES.names)

        for b in batches:
            for t, d, v, i in zip(*(c.to_pylist() for c in b.columns)):
                if t != at:
                    if vecs:
                        yield from done()
                    at, dim, vecs, ids = t, d, [], []
                vecs.append(v)
                ids.append(i)
        if vecs:
            yield from done()

    return by_key(dealt, "tree").sortWithinPartitions("tree", "vec").mapInArrow(run, PAGES)


# ---------------------------------------------------------------- searching


class Page:
    def __init__(self, facts: Facts, leaf: bool, dim: int, objects: bytes, apart: bytes, radii: bytes, children: bytes, ids: bytes, ends: bytes) -> None:
        self.leaf, self.objects, self.apart = leaf, facts.rows([objects], dim), np.frombuffer(apart, "<f8")
        self.radii = 0.0 if leaf else np.frombuffer(radii, "<f8")
        self.children = np.frombuffer(children, "<i4")
        if leaf:
            self.norms = (self.objects * self.objects).sum(1)
            self.ids = np.split(np.frombuffer(ids, "<i8"), np.frombuffer(ends, "<i4")[:-1])


class Asked:
    """Queries of one length that search together, each with its k best so far."""

    def __init__(self, facts: Facts, vecs: list[bytes], dim: int, k: int, least: list[float | None]) -> None:
        self.facts, self.k, self.rows = facts, k, facts.rows(vecs, dim)
        self.own = (self.rows * self.rows).sum(1)
        self.floor = np.array([-np.inf if x is None else x for x in least])
        self.best: list[list[tuple[int, int, bool]]] = [[] for _ in vecs]
        self.limit = np.empty(len(vecs))
        self.reach(np.arange(len(vecs)))

    def reach(self, at: np.ndarray) -> None:
        """Distances within which something as good as the k-th best may lie."""
        some = self.floor[at] > -np.inf
        self.limit[at] = np.where(some, self.facts.apart(self.own[at], np.where(some, self.floor[at], 0)) * (1 + MARGIN) + MARGIN + self.facts.blur(self.own[at]), np.inf)

    def meet(self, at: int, products: np.ndarray, entries: np.ndarray, page: Page) -> None:
        best = self.best[at]
        mine = (2 * products == self.own[at] + page.norms[entries]).tolist()
        for s, e, m in zip(products.tolist(), entries.tolist(), mine):
            best += [(-int(s), i, m) for i in page.ids[e].tolist()]
        best.sort()
        del best[self.k :]
        if len(best) == self.k:
            self.floor[at] = max(self.floor[at], -best[-1][0])


class Tree:
    """One tree's pages, and the counts of distances that were computed and that a stored bound made needless."""

    def __init__(self, facts: Facts) -> None:
        self.facts, self.pages, self.computed, self.spared = facts, {}, 0, 0

    def search(self, asked: Asked) -> None:
        """The k best of each query, or those of them that reach the floor it came with.

        A page waits once for all queries, at the least of their bounds, and meets those whose own bound is within their limit.
        """
        top = self.pages[-1]
        first = self.facts.apart(asked.own, (asked.rows @ top.objects.T)[:, 0])
        bounds = np.maximum(0.0, first - top.radii[0]) * (1 - MARGIN)
        waiting = [(float(bounds.min()), 0, bounds, first)]
        while waiting:
            _, number, bounds, apart = heapq.heappop(waiting)
            who = (bounds <= asked.limit).nonzero()[0]
            if not len(who):
                continue
            page = self.pages[number]
            near = np.abs(apart[who, None] - page.apart) - page.radii <= (asked.limit[who] + MARGIN * apart[who])[:, None]
            at = near.any(0).nonzero()[0]
            near = near[:, at]
            computed = int(near.sum())
            self.computed += computed
            self.spared += len(who) * len(page.apart) - computed
            if not len(at):
                continue
            products = asked.rows[who] @ page.objects[at].T
            if page.leaf:
                hits = near & (products >= asked.floor[who, None])
                some = hits.any(1).nonzero()[0]
                for i in some.tolist():
                    found = hits[i].nonzero()[0]
                    asked.meet(who[i], products[i, found], at[found], page)
                asked.reach(who[some])
                continue
            d = self.facts.apart(asked.own[who, None], products)
            low = np.maximum(bounds[who, None], (d - page.radii[at]) * (1 - MARGIN) - MARGIN)
            low = np.where(near, low, np.inf)
            for j in (low <= asked.limit[who, None]).any(0).nonzero()[0].tolist():
                of, to = np.full(len(bounds), np.inf), np.zeros(len(bounds))
                of[who], to[who] = low[:, j], d[:, j]
                heapq.heappush(waiting, (float(low[:, j].min()), int(page.children[at[j]]), of, to))


#: Queries that search together.
TOGETHER = 256

ANSWER = "query string, dim int, vec binary, home long, floor double, scores array<long>, ids array<long>, own array<boolean>"
_ANSWER = pa.schema([
    ("query", pa.string()), ("dim", pa.int32()), ("vec", pa.binary()), ("home", pa.int64()), ("floor", pa.float64()), ("scores", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("own", pa.list_(pa.bool_()))
])


def visited(asks: DataFrame, pages: DataFrame, facts: Facts, k: int, blocks: int) -> DataFrame:
    """Each of (query, dim, vec, home, floor, tree) with what its tree has for it.

    A tree goes to ``blocks`` tasks at most, each with a share of the queries that visit it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, rows = None, None, []

        def done() -> pa.RecordBatch:
            asked = Asked(facts, [r[2] for r in rows], rows[0][1], k, [r[4] for r in rows])
            tree.search(asked)
            made = []
            for row, floor, best in zip(rows, asked.floor.tolist(), asked.best):
                made.append((*row[:4], None if floor == -math.inf else floor, *([list(x) for x in zip(*((-s, i, m) for s, i, m in best))] or [[], [], []])))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), _ANSWER.types)], _ANSWER.names)

        for b in batches:
            for t, block, page, leaf, dim, *binary, query, vec, home, floor in zip(*(c.to_pylist() for c in b.columns)):
                if (t, block) != at:
                    if rows:
                        yield done()
                    at, tree = (t, block), Tree(facts)
                if page is not None:
                    tree.pages[page] = Page(facts, leaf, dim, *binary)
                    continue
                rows.append((query, dim, vec, home, floor))
                if len(rows) == TOGETHER:
                    yield done()
        if rows:
            yield done()

    asks = asks.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    copies = pages.join(asks.select("tree", "block").distinct(), "tree")
    stored = [c.split()[0] for c in PAGES.split(", ")][4:]
    cells = copies.unionByName(asks, allowMissingColumns=True).select("tree", "block", "page", "leaf", "dim", *stored, "query", "vec", "home", "floor")
    return by_key(cells, "tree", "block").sortWithinPartitions("tree", "block", F.col("page").asc_nulls_last(), "home", "query").mapInArrow(run, ANSWER)


class Groups:
    """The pivots, and of the group of each the number of trees and the radius that covers it; at most ``pivots`` and one a length without any."""

    def __init__(self, facts: Facts, pivots: dict[int, list[bytes]], found: list[tuple[int, int, int, float]], tree_size: int) -> None:
        self.facts = facts
        self.points = {d: facts.points(facts.rows(v, d)) for d, v in pivots.items()}
        self.of = {(d, p): (g, max(1, -(-n // tree_size)), far) for g, (d, p, n, far) in enumerate(sorted(found))}

    @property
    def trees(self) -> int:
        return sum(m for _, m, _ in self.of.values())

    def nearest(self, x: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, distance to it) of each point; pivot -1 where the length has none."""
        if dim not in self.points:
            return np.full(len(x), -1), np.full(len(x), np.inf)
        y = self.points[dim]
        at = ((y * y).sum(1) - 2 * x @ y.T).argmin(1)
        return at, between(x, y[at])

    def tree(self, dim: int, pivot: int, vec: bytes) -> int:
        g, m, _ = self.of[dim, pivot]
        return (g << 20) + zlib.crc32(vec) % m

    def reached(self, q: np.ndarray, dim: int, floor: float | None) -> list[int]:
        """All trees that may hold a vector of a product of ``floor`` or more."""
        own = float(q @ q)
        limit = math.inf if floor is None else float(self.facts.apart(own, floor) * (1 + MARGIN) + MARGIN + self.facts.blur(own))
        out = []
        d = between(self.points[dim], np.append(q, 0.0)) if dim in self.points else None
        for (of, p), (g, m, far) in self.of.items():
            if of == dim and (p < 0 or (d[p] - far) * (1 - MARGIN) - MARGIN <= limit):
                out += range(g << 20, (g << 20) + m)
        return out


def _nearest(entries: DataFrame, facts: Facts, pivots: dict[int, list[bytes]]) -> DataFrame:
    groups = Groups(facts, pivots, [], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, vecs = b.column(0).to_numpy(), b.column(1).to_pylist()
            pivot, far = np.empty(len(vecs), np.int32), np.empty(len(vecs))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                pivot[at], far[at] = groups.nearest(facts.points(facts.rows([vecs[k] for k in at.tolist()], dim)), dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pivot), pa.array(far)], ["dim", "pivot", "far"])

    return entries.select("dim", "vec").mapInArrow(run, "dim int, pivot int, far double")


def _homes(rows: DataFrame, facts: Facts, groups: Groups, name: str) -> DataFrame:
    """``rows`` (.., dim, vec) with the tree that their vectors belong to; a length that no vector has drops out."""
    lengths = {d for d, _ in groups.of}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, vecs = b.column("dim").to_numpy(), b.column("vec").to_pylist()
            home = np.full(len(vecs), -1, np.int64)
            for dim in np.unique(dims).tolist():
                if dim not in lengths:
                    continue
                at = np.flatnonzero(dims == dim).tolist()
                near = groups.nearest(facts.points(facts.rows([vecs[k] for k in at], dim)), dim)[0].tolist()
                for k, p in zip(at, near):
                    if (dim, p) not in groups.of:  # a pivot that is nobody's nearest: any group of this length will do to begin with
                        p = min(x for d, x in groups.of if d == dim)
                    home[k] = groups.tree(dim, p, vecs[k])
            kept = pa.array(home >= 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home)], [*b.schema.names, name]).filter(kept)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, LongType())]))


def _others(first: DataFrame, facts: Facts, groups: Groups) -> DataFrame:
    """Each query with every further tree that its k-th best so far doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for query, dim, vec, home, floor in zip(*(c.to_pylist() for c in b.columns)):
                q = facts.rows([vec], dim)[0].astype(np.float64)
                rows += [(query, dim, vec, home, floor, t) for t in groups.reached(q, dim, floor) if t != home]
                if len(rows) >= 4096:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*_ANSWER.types[:5], pa.int64()])], [*_ANSWER.names[:5], "tree"])

    return first.select("query", "dim", "vec", "home", "floor").mapInArrow(run, "query string, dim int, vec binary, home long, floor double, tree long")


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64, pivots: int = 1024, tree_size: int = 1 << 16, queries_a_task: int = 1 << 14, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest products of floor(scale * x) with all other rows, ties to the smaller vec_id.

    Rows without an id, and vectors that are null, empty or hold a null or non-finite component take no part; vectors of another length
    than a query's are no candidates for it. Equal rows are one; of two vectors under one id each is a candidate for the other, and as queries
    their lists are merged into one of k. Products that pass 64 bits are an error. An empty table gives none, further columns are not read.
    The pivots are the ``pivots`` vectors of least digest, a bounded sample that only decides how vectors are dealt.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    base = whole(vectors, scale, id_col, vec_col)
    known = facts(base)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if known is None:
        return empty
    digest = F.md5(F.concat(F.col("dim").cast("string").cast("binary"), F.col("vec"))).alias("digest")
    within = F.row_number().over(W.partitionBy("dim", "vec").orderBy("vec_id"))
    least = packed(base, known.kind).withColumn("n", within).where(F.col("n") <= k + 1)
    entries = cut(least.groupBy("dim", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    chosen: dict[int, list[bytes]] = {}
    n, cores = entries.count(), spark.sparkContext.defaultParallelism
    wanted = min(pivots, max(-(-n // tree_size), min(-(-n // 4096), 2 * cores)))  # small tables have smaller trees, enough for all cores
    for r in entries.select("dim", "vec", digest).orderBy("digest").limit(wanted).collect():
        chosen.setdefault(r["dim"], []).append(bytes(r["vec"]))
    found = _nearest(entries, known, chosen).groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    groups = Groups(known, chosen, [tuple(r) for r in found], tree_size)
    pages = cut(built(_homes(entries, known, groups, "tree").select("tree", "dim", "vec", "ids"), known))

    asked = cut(packed(whole(queries, scale, id_col, vec_col), known.kind).select("vec_id", "dim", "vec", digest.alias("query")))
    one = _homes(asked.select("query", "dim", "vec").distinct(), known, groups, "home").withColumn("floor", F.lit(None).cast("double"))
    blocks = max(-(-asked.count() // queries_a_task), -(-2 * cores // groups.trees))
    first = cut(visited(one.withColumn("tree", F.col("home")), pages, known, k + 1, blocks))
    answers = first.unionByName(visited(_others(first, known, groups), pages, known, k + 1, blocks))
    each = answers.select("query", F.explode(F.arrays_zip("scores", "ids", "own")).alias("x")).select("query", "x.scores", "x.ids", "x.own")
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("scores"), "ids", "own"))
    top = each.withColumn("n", rank("query")).where(F.col("n") <= k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "scores", "ids", "own"))).alias("top"))
    counted = asked.groupBy("query").agg(F.count("*").alias("asking"))
    lists = cut(top.join(counted, "query"))
    told = join_by_share(asked.select("query", F.col("vec_id").alias("query_id")), lists, ["query"], "asking")
    rows = told.select("query_id", F.explode("top").alias("x")).where(~(F.col("x.own") & (F.col("x.ids") == F.col("query_id"))))
    out = rows.select("query_id", "x.scores", "x.ids", "x.own").withColumn("rank", rank("query_id")).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("ids").alias("vec_id"), F.col("scores").alias("score"))
