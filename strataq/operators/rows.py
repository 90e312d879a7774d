"""Versions, duplicates, gaps and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The row of the greatest ``version`` of each key; ties by all other columns, so the choice is the same everywhere."""
    rest = [c for c in df.columns if c not in key]
    ordered = [*version, *[c for c in rest if c not in version]]
    best = df.groupBy(*key).agg(F.max(F.struct(*ordered)).alias("__best"))
    return best.select(*key, *[F.col(f"__best.{c}").alias(c) for c in rest])


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def dense_days(points: DataFrame, key: str, day: str = "day") -> DataFrame:
    """Every key with every day from its first to the last of all; missing days have nulls."""
    span = points.agg(F.max(day).alias("__last"))
    keys = points.groupBy(key).agg(F.min(day).alias("__first"))
    grid = keys.crossJoin(F.broadcast(span)).select(key, F.explode(F.sequence("__first", "__last")).alias(day))
    return grid.join(points, [key, day], "left")


def fill_forward(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Missing values replaced by the last known one."""
    w = W.partitionBy(key).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def change_over_days(points: DataFrame, key: str, day: str, value: str, days: tuple[int, ...]) -> DataFrame:
    """``points`` with d1, d7 and so on: the value less that of so many days before, null where that day has none.

    A window over the range of that one day, so missing days don't shift what is compared.
    """
    at = lambda n: W.partitionBy(key).orderBy(day).rangeBetween(-n, -n)
    return points.select(key, day, *[(F.col(value) - F.first(value).over(at(n))).alias(f"d{n}") for n in days])


def over_range(points: DataFrame, time: str, width: int, aggregates: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """``points`` with aggregates of the rows of (time - width, time] of their key, e.g. ``{"low": F.min("price")}``.

    Time is cut into slices of ``width``; a row's range lies in its own slice and the one before, so each slice is given the rows of the one before
    as well, and a window meets two slices at most, however long a series is and with or without a key. A null time has no range.
    """
    by = by or []
    slice_ = (F.col(time) - F.pmod(F.col(time), F.lit(width))).cast("long")
    both = points.where(F.col(time).isNotNull()).withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("__slice", F.when(F.col("__own"), slice_).otherwise(slice_ + width))
    order = W.partitionBy(*by, "__slice").orderBy(time).rangeBetween(1 - width, 0)
    return both.select("*", *[a.over(order).alias(n) for n, a in aggregates.items()]).where("__own").drop("__own", "__slice")
