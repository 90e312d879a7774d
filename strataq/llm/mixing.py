"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame operations only.

Targets. Sources share ``share`` times all tokens by weight; none may get more than ``cap`` times its own, and the excess
goes to the others by weight until none is above. In the order of cap per weight the sources at their cap are a
prefix, so running sums give the common level of the rest at once.

Quotas. The total is cut into blocks of equal size, and the blocks are seats: each next one goes to the source with the
highest quotient target / (2 * seats + 1). A source with fewer than ``least_seats`` of them is so small that a block is a coarse
measure; its target is cut into about that many blocks of its own. A source's documents are dealt into shards of bounded size and its
seats go to groups of shards and in each group to shards, in the same way by their sizes, so that no task sees all
shards of a source. Two divisors that enclose the final one bound the seats from
below and above, so only about two quotients a party are ever ranked, not one for each block.

Selection. A shard's documents, in a seeded order, form a stream of tokens in blocks of equal length. All blocks
are taken quota div blocks times; the rest of the quota goes to blocks that a seeded permutation puts first. What a
document gives is the sum over the blocks that it overlaps, so blocks are never written out as rows.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
#: Strides of the permutations: primes, of which one that doesn't divide the number of blocks is used.
STRIDES = (15485863, 32452843, 49979687, 67867967, 86028121, 104395301, 122949823, 141650939)


def sizes(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> list[Column]:
    own = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit(""))
    return [
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), own)).alias("h"),
        F.md5(F.col(text_col)).alias("tie"),  # rows of one id and size, so that a rerun takes the same texts
    ]


def targets(totals: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Adds src (1, 2, .. by code point, null last), weight, total and target to one row per source with source_size."""
    everywhere = W.partitionBy()
    t = totals.withColumn("src", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("src") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("total", F.sum("source_size").over(everywhere)).withColumn("most", cap * F.col("source_size"))
    t = t.withColumn("ratio", F.col("most") / F.col("weight"))
    order = W.orderBy("ratio", "src")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    t = t.withColumn("level", (share * F.col("total") - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(everywhere)["level"]
    t = t.withColumn("target", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most"))))
    return t.select("source", "src", "weight", "source_size", "total", "target")


def sainte_lague(parties: DataFrame, within: list[str], party: str, votes: str, house: str) -> DataFrame:
    """``parties`` with ``seats``: in each group of ``within``, ``house`` seats by highest quotients, ties to the smaller ``party``."""
    group = W.partitionBy(*within)
    v, n = F.col(votes).cast("double"), F.col(house)
    some = parties.where(F.col(votes) > 0)
    some = some.withColumn("__s", F.count("*").over(group)).withColumn("__v", F.sum(v).over(group))
    low = F.when(2 * n > F.col("__s"), F.greatest(F.floor(v / (F.col("__v") / (n - F.col("__s") / 2)) + 0.5) - 1, F.lit(0))).otherwise(F.lit(0))
    high = F.floor(v / (F.col("__v") / (n + F.col("__s") / 2)) + 0.5) + 1
    some = some.withColumn("__low", low.cast("long")).withColumn("__high", F.greatest(high, F.col("__low") + 1).cast("long"))
    some = some.withColumn("__sure", F.sum("__low").over(group))
    ranked = some.select("*", F.explode(F.sequence("__low", F.col("__high"))).alias("__k")).withColumn(
        "__rank", F.row_number().over(W.partitionBy(*within).orderBy(F.desc(v / (2 * F.col("__k") + 1)), party))
    )
    won = ranked.groupBy(*within, party).agg((F.first("__low") + F.sum((F.col("__rank") <= n - F.col("__sure")).cast("long"))).alias("seats"))
    return parties.join(won, [*within, party], "left").withColumn("seats", F.coalesce("seats", F.lit(0)).cast("long"))


class Mix:
    """The plan of one mix: targets by source and quotas by shard, which ``take`` applies to the documents."""

    def __init__(
        self, docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 0,
        shard_tokens: int = 500_000, shards_a_group: int = 1024, most_block: int = 512, blocks_a_source: int = 1000, least_seats: int = 64,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    ) -> None:
        self.docs, self.seed, self.text_col, self.passes = docs, seed, text_col, max(1, ceil(cap))
        self.columns = sizes(docs, seed, id_col, text_col, source_col)
        self.slim = cut(docs.select(*self.columns))
        totals = self.slim.groupBy("source").agg(F.sum("size").alias("source_size"))
        t = targets(totals, weights, share, cap)
        sources = F.count("*").over(W.partitionBy())
        block = F.greatest(F.lit(1), F.least(F.lit(most_block), F.floor(F.col("total") / (blocks_a_source * sources)))).cast("long")
        t = t.withColumn("block", block).withColumn("house", F.round(share * F.col("total") / F.col("block")).cast("long")).withColumn("one", F.lit(1))
        t = sainte_lague(t, ["one"], "src", "target", "house")
        small = F.col("seats") < least_seats
        fine = F.least("block", F.greatest(F.lit(1), F.floor(F.col("target") / least_seats))).cast("long")
        t = t.withColumns({"seats": F.when(small, F.round(F.col("target") / fine).cast("long")).otherwise(F.col("seats")), "block": F.when(small, fine).otherwise(F.col("block"))})
        t = t.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("long"))
        self.sources = cut(t.select("source", "src", "source_size", "target", "block", "shards", F.col("seats").alias("source_seats")))
        parts = self._dealt(self.slim).groupBy("src", "shard").agg(F.sum("size").alias("length"), F.first("block").alias("block"), F.first("source_seats").alias("source_seats"))
        parts = cut(parts.withColumn("group", F.expr(f"shard div {shards_a_group}")))
        groups = parts.groupBy("src", "group").agg(F.sum("length").alias("weight"), F.first("source_seats").alias("source_seats"))
        groups = cut(sainte_lague(groups, ["src"], "group", "weight", "source_seats").select("src", "group", F.col("seats").alias("group_seats")))
        parts = sainte_lague(parts.join(groups, ["src", "group"]), ["src", "group"], "shard", "length", "group_seats")
        parts = parts.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("length") / F.col("block"))).cast("long"))
        whole = F.floor(F.lit(float(cap)) * F.col("blocks")).cast("long")
        self.quotas = cut(parts.select("src", "shard", "length", "blocks", F.least("seats", whole).alias("quota")))

    def _dealt(self, sized: DataFrame) -> DataFrame:
        s = self.sources.withColumnRenamed("source", "__source")
        shard = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("shards")
        return sized.join(s, sized["source"].eqNullSafe(s["__source"])).drop("__source").withColumn("shard", shard)

    def _placed(self, sized: DataFrame) -> DataFrame:
        """Adds a document's place in its shard's stream, its first and last block, and how often each is taken."""
        order = W.partitionBy("src", "shard").orderBy("h", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, 0)
        d = self._dealt(sized).join(self.quotas, ["src", "shard"]).withColumn("stop", F.sum("size").over(order))
        d = d.withColumn("start", F.col("stop") - F.col("size"))
        first = F.expr("((start + 1) * blocks - 1) div length")
        last = F.expr("(stop * blocks - 1) div length")
        strides = "filter(array({}), p -> blocks % p <> 0)".format(", ".join(f"{p}L" for p in STRIDES))
        d = d.withColumn("stride", F.expr(f"element_at({strides}, cast(({self.seed} + src + shard) % size({strides}) + 1 as int))"))
        d = d.withColumn("span", F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))
        d = d.withColumn(
            "pieces",
            F.expr(
                f"""transform(span, b -> named_struct(
                    'lo', greatest(start, b * length div blocks), 'hi', least(stop, (b + 1) * length div blocks),
                    'times', quota div blocks + if((b * stride + {self.seed} + src * 7919 + shard * 104729) % blocks < quota % blocks, 1, 0)))"""
            ),
        )
        return d

    def take(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) for each row of the documents."""
        taken = F.expr("aggregate(pieces, 0L, (a, p) -> a + p.times * (p.hi - p.lo))")
        return self._placed(self.slim).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))

    def documents(self) -> DataFrame:
        """The mix itself, in the documents' columns: a row for each document and pass that takes any of it.

        There are as many passes as ``cap`` rounded up; the second holds what is taken twice, and so on. Null texts and texts without a word
        are not taken; an empty table gives none. A document that a pass takes in part has the words of the blocks taken,
        with the white space behind them.
        """
        names = self.docs.columns
        placed = self._placed(self.docs.select(*self.columns, F.struct(*names).alias("row")))
        passes = placed.select("row", "size", "start", F.explode(F.expr(f"transform(sequence(1, {self.passes}), c -> filter(pieces, p -> p.times >= c))")).alias("got")).where(F.size("got") > 0)
        text = F.col("row")[self.text_col]
        partial = F.expr(
            f"array_join(flatten(transform(got, p -> slice(words, cast(p.lo - start + 1 as int), cast(p.hi - p.lo as int)))), '')"
        )
        whole = F.expr("aggregate(got, 0L, (a, p) -> a + p.hi - p.lo) = size")
        words = F.when(whole, F.lit(None)).otherwise(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)))
        out = passes.withColumn("whole", whole).withColumn("words", words).withColumn("new", F.when(F.col("whole"), text).otherwise(partial))
        changed = {self.text_col: F.col("new")}
        if "n_chars" in names:
            changed["n_chars"] = F.when(F.col("whole"), F.col("row")["n_chars"]).otherwise(F.length("new").cast("long"))
        return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in names])


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``; see the module for the method.

    size counts words; a null text has none and gives none. A null source is a source of its own, last in order;
    a null doc_id stays null, and such rows are told apart by their texts; repeated rows are documents of their own; an empty
    table gives none; further columns are not read. No document gives more than twice its words.
    """
    return Mix(docs, **parameters).take()
