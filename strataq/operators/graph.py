"""Dependency graphs of metrics: names, closure and levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions.session import written

UNITS = ("min", "h", "d", "day", "week", "y")


def canonical(name: Column) -> Column:
    """A metric's name without version and windows, its bucket as ``B``.

    A name is made of parts between underscores and a version behind a slash. A part of digits and a unit is a window and drops out; a part that
    names a size of holdings (``1``, ``1e3`` or ``1e`` and ``3``, ``all``, ``inf``) is a bucket if it ends what is left.
    """
    window = lambda p: reduce(lambda a, b: a | b, [p.endswith(u) & p.substr(F.lit(1), F.length(p) - len(u)).try_cast("int").isNotNull() for u in UNITS])
    parts = F.filter(F.split(F.substring_index(name, "/", 1), "_"), lambda p: ~window(p))
    size = F.size(parts)
    last, before = F.try_element_at(parts, size), F.try_element_at(parts, size - 1)
    exponent = lambda p: p.startswith("1e") & p.substr(F.lit(3), F.length(p)).try_cast("int").isNotNull()
    own = F.when((size > 2) & (before == "1e") & last.try_cast("int").isNotNull(), 2).when((size > 1) & (last.isin("1", "all", "inf") | exponent(last)), 1).otherwise(0)
    base = F.array_join(F.slice(parts, 1, size - own), "_")
    return F.when(own > 0, F.concat(base, F.lit("_B"))).otherwise(base)


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(root, node, depth): everything that depends on a root, at its least depth; ``edges``: (source, target).

    A breadth-first walk of joins until nothing new is found; each round meets only the nodes found last, and known ones drop out.
    """
    seen = front = written(start.select("root", "node", F.lit(0).alias("depth")))
    depth = 0
    while not front.isEmpty():
        depth += 1
        nxt = front.join(edges, front["node"] == edges["source"]).select("root", F.col("target").alias("node")).distinct()
        front = written(nxt.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = written(seen.unionByName(front))
    return seen


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): 0 for what depends on nothing, else one beyond its last dependency; a cycle is an error.

    Each round places the nodes all of whose sources are placed, by one join and one aggregation.
    """
    edges = written(edges.select("source", "target").distinct())
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    placed = written(nodes.join(edges.select(F.col("target").alias("node")), "node", "left_anti").withColumn("level", F.lit(0)))
    left = edges.select(F.col("target").alias("node")).distinct().count()
    while left:
        known = edges.join(placed.select(F.col("node").alias("source"), "level"), "source", "left")
        ready = known.groupBy(F.col("target").alias("node")).agg(F.bool_and(F.col("level").isNotNull()).alias("all"), (F.max("level") + 1).alias("level"))
        new = written(ready.where("all").select("node", "level").join(placed.select("node"), "node", "left_anti"))
        n = new.count()
        if not n:
            raise ValueError("the edges have a cycle")
        left -= n
        placed = written(placed.unionByName(new))
    return placed


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b), whose order means nothing; a component is named by its least node.

    Stars are contracted in turn: around each node the greater neighbours are tied to the least one, then the lesser ones are, until nothing
    moves. A round is two aggregations and joins on nodes, rounds grow with the logarithm of a component's size, and edges never become more.
    Edges with a null end say nothing; a node tied to itself is a component.
    """
    ends = written(edges.select("a", "b").where("a is not null and b is not null").distinct())  # read more than once below
    alone = ends.where("a = b").select(F.col("a").alias("node")).distinct()
    pairs = written(ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(pairs)
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        pairs = written(small.select("x.u", "x.v").where("u <> v").distinct())
        now = mark(pairs)
        if now == before:
            break
        before = now
    named = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    tops = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    known = named.unionByName(tops)
    single = alone.join(known.select("node"), "node", "left_anti")
    return known.unionByName(single.select("node", F.col("node").alias("component")))
