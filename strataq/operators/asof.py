"""As-of joins that don't gather a key's whole history in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.functions.time import DAY


def asof_backward(left: DataFrame, right: DataFrame, on: str, value: str, by: list[str] | None = None, slice_size: int = DAY, unmatched: str = "null", greatest_gap: int | None = None) -> DataFrame:
    """``left`` with ``value`` of the latest row of ``right`` at or before ``on``, within ``by``.

    Time is cut into slices; rows meet in windows by (key, slice), and what holds when a slice begins is carried over from the
    slices before, of which there is one row each. Of several right rows at one time the greatest value counts. ``unmatched``: 'null', or 'zero' for the lossy convention that
    takes an absent value for 0. With ``greatest_gap`` a value from longer before is none.
    """
    by = by or []
    if greatest_gap is not None:
        dated = right.where(F.col(value).isNotNull()).select(*by, on, F.struct(F.col(on).alias("of"), F.col(value).alias("value")).alias(value))
        near = F.when(F.col(on) - F.col(f"{value}.of") <= greatest_gap, F.col(f"{value}.value"))
        found = asof_backward(left, dated, on, value, by, slice_size)
        return found.withColumn(value, F.coalesce(near, F.lit(0)) if unmatched == "zero" else near)
    cut = lambda df: df.withColumn("__slice", F.col(on) - F.pmod(F.col(on), F.lit(slice_size)))
    l, r = cut(left), cut(right.where(F.col(value).isNotNull()).groupBy(*by, on).agg(F.max(value).alias(value)))
    ends = r.groupBy(*by, "__slice").agg(F.max_by(value, on).alias("__end"))
    slices = l.select(*by, "__slice").distinct().join(ends, [*by, "__slice"], "full")
    before = W.partitionBy(*by).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    carry = slices.select(*by, "__slice", F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    both = l.withColumn("__side", F.lit(1)).unionByName(r.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    if value in left.columns:
        raise ValueError(f"left has a column {value} already")
    so_far = W.partitionBy(*by, "__slice").orderBy(on, "__side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("__value", F.last(value, ignorenulls=True).over(so_far)).where("__side = 1").drop(value, "__side")
    out = F.coalesce("__value", "__carry")
    if unmatched == "zero":
        out = F.coalesce(out, F.lit(0))
    return found.join(carry, [*by, "__slice"], "left").withColumn(value, out).select(*left.columns, value)


def within_ranges(points: DataFrame, ranges: DataFrame, on: str, start: str, end: str, by: list[str] | None = None, finest: int = 1) -> DataFrame:
    """Every pair of a point and a range [start, end) that holds it, within ``by``; ranges may overlap and nest.

    A range has a level, the power of two of ``finest`` that is its length or more, and so lies in two bins of that level at most. Points meet
    bins by equality, once for each level that occurs, of which there are 63 at most; a check of the ends decides. Empty ranges hold nothing,
    and nulls are in no pair. Other columns of both sides are kept and must differ.
    """
    by = by or []
    size = F.col(end) - F.col(start)
    level = F.greatest(F.ceil(F.log2(size / F.lit(finest))).cast("int"), F.lit(0))
    # log2 rounds: a length just above a power of two may get the level below, where it lies in three bins
    wide = F.call_function("shiftleft", F.lit(finest).cast("long"), F.col("__level"))
    bin_of = lambda c: F.call_function("div", c - F.pmod(c, wide), wide)
    levelled = ranges.where(size > 0).withColumn("__level", level)
    binned = levelled.withColumn("__bin", F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.col(end) - 1))))
    levels = [r[0] for r in levelled.select("__level").distinct().collect()]
    if not levels:
        levels = [0]
    asked = points.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]))).withColumn("__bin", bin_of(F.col(on)))
    met = asked.join(binned, [*by, "__level", "__bin"])
    return met.where((F.col(on) >= F.col(start)) & (F.col(on) < F.col(end))).drop("__level", "__bin")
