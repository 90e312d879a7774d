"""Running sums that go on from what an earlier run has stored."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fresh_name() -> str:
    return f"sums-{uuid.uuid4().hex}"


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """What the runs have stored: (key.., time, total, until), each run under the time that it went to."""
    return spark.read.parquet(folder).where("own").drop("own")


def beyond(deltas: DataFrame, time: str, cursor: int | None, until: int) -> DataFrame:
    """The part of ``deltas`` that a run reads: behind the cursor, which reaches the scan as a plain filter."""
    part = deltas.where(F.col(time) <= until)
    return part if cursor is None else part.where(F.col(time) > cursor)


def carry_on(deltas: DataFrame, folder: str, key: Sequence[str], time: str, value: str, until: int) -> int | None:
    """Store the running sums of ``deltas`` (key.., time, value) up to ``until``, from the last stored value of each key; gives the cursor it began at.

    A run covers all keys up to its ``until``, which is the next one's cursor; one that was lost is done again and replaces what it had written.
    Rows that come late, at or before the cursor, are not seen. Of each key only the last value is read, and of earlier runs' rows only as many
    as there are keys are carried on: each run stores them again under its own time where a key has no new row.
    """
    spark, key = deltas.sparkSession, list(key)
    try:
        runs = [r[0] for r in spark.read.parquet(folder).select("until").distinct().collect() if r[0] < until]
    except AnalysisException:  # nothing stored yet
        runs = []
    cursor = max(runs, default=None)
    new = beyond(deltas, time, cursor, until).groupBy(*key, time).agg(F.sum(value).alias("d"))
    order = W.partitionBy(*key).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    if cursor is None:
        rows = new.select(*key, time, F.sum("d").over(order).alias("total"), F.lit(True).alias("own"))
    else:
        # the stored last values stand in front of the new rows: no join, and each key is one group
        ends = spark.read.parquet(folder).where(F.col("until") == cursor).groupBy(*key).agg(F.max_by("total", time).alias("d"))
        front = ends.select(*key, F.lit(None).cast(deltas.schema[time].dataType).alias(time), "d")
        both = front.unionByName(new).withColumn("total", F.sum("d").over(W.partitionBy(*key).orderBy(F.col(time).asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.count("*").over(W.partitionBy(*key)))
        here = F.col(time).isNotNull()
        rows = both.where(here | (F.col("n") == 1)).select(*key, F.coalesce(time, F.lit(cursor)).alias(time), "total", here.alias("own"))
    rows.write.mode("overwrite").parquet(f"{folder}/until={until}")
    return cursor
