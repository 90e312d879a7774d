"""Comparison of two runs of the same keyed points."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def relative_difference(p: Column, e: Column) -> Column:
    """|p - e| over the mean magnitude, at least 1e-12: between 0 and 2."""
    return F.abs(p - e) / F.greatest((F.abs(p) + F.abs(e)) / 2, F.lit(1e-12))


def paired(prod: DataFrame, exp: DataFrame, key: list[str], value: str) -> DataFrame:
    """Full outer join by key: columns p and e, null where a side has no row."""
    return prod.select(*key, F.col(value).alias("p")).join(exp.select(*key, F.col(value).alias("e")), key, "full")


def compare(prod: DataFrame, exp: DataFrame, group: str, day: str, value: str, tol: float = 1e-9) -> DataFrame:
    """One row per group: how many keys are on both sides or one, absolute and relative differences, first divergence, sums."""
    d = paired(prod, exp, [group, day], value)
    both = F.col("p").isNotNull() & F.col("e").isNotNull()
    rel = F.when(both, relative_difference(F.col("p"), F.col("e")))
    return (
        d.withColumn("rel", rel)
        .groupBy(group)
        .agg(
            F.count_if(both).alias("both"),
            F.count_if(F.col("e").isNull()).alias("prod_only"),
            F.count_if(F.col("p").isNull()).alias("exp_only"),
            F.max(F.when(both, F.abs(F.col("p") - F.col("e")))).alias("max_abs"),
            F.round(F.max("rel"), 9).alias("max_rel"),
            F.round(F.avg("rel"), 9).alias("mean_rel"),
            F.round(F.percentile("rel", 0.5), 9).alias("p50_rel"),
            F.round(F.percentile("rel", 0.99), 9).alias("p99_rel"),
            F.min(F.when(F.col("rel") > tol, F.col(day))).alias("first_divergence"),
            F.sum("p").alias("sum_prod"),
            F.sum("e").alias("sum_exp"),
        )
        .withColumn("sum_ratio", F.round(F.when(F.col("sum_prod") != 0, F.col("sum_exp") / F.col("sum_prod")), 9))
    )


def verdict(statistic: str, tol: float = 1e-9, minor: float = 0.05) -> Column:
    """MATCH, minor-drift or DIVERGE by a relative difference; where no key is on both sides EXP-ONLY, or no-overlap without any of the new run's.

    The labels and the bounds 1e-9 and 0.05 are fixed values.
    """
    x = F.col(statistic)
    return (
        F.when((F.col("both") == 0) & (F.col("exp_only") > 0), "EXP-ONLY")
        .when(F.col("both") == 0, "no-overlap")
        .when(x.isNull() | (x <= tol), "MATCH")
        .when(x <= minor, "minor-drift")
        .otherwise("DIVERGE")
    )


def union_difference(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Difference and gross by key from one signed union and one aggregation, without a join."""
    one = lambda df, s: df.select(*key, (F.lit(s) * F.col(value)).alias("d"), F.abs(value).alias("g"))
    return one(a, 1).unionByName(one(b, -1)).groupBy(*key).agg(F.sum("d").alias("difference"), F.sum("g").alias("gross"))


def signature(points: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """count, sum, first and last by group: a small record to hold later runs against."""
    return points.groupBy(*group).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last")
    )


#: Relative tolerance of a check against a signature, where a metric has none of its own, and the absolute one.
RTOL, ATOL = 1e-6, 1e-9


def check_signature(points: DataFrame, baseline: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """``baseline`` (group, n, total, first, last, rtol) with the state of ``points`` against it: ok, off, or missing; groups it doesn't know are new.

    Counts must be equal; sums, first and last values within rtol (``RTOL`` where it is null) of the greater magnitude, or ``ATOL``.
    """
    now = signature(points, group, order, value).select(*group, *[F.col(c).alias(f"{c}_now") for c in ("n", "total", "first", "last")])
    rtol = F.coalesce("rtol", F.lit(RTOL))
    near = lambda c: F.abs(F.col(c) - F.col(f"{c}_now")) <= F.greatest(rtol * F.greatest(F.abs(c), F.abs(f"{c}_now")), F.lit(ATOL))
    same = (F.col("n") == F.col("n_now")) & near("total") & near("first") & near("last")
    state = F.when(F.col("n_now").isNull(), "missing").when(F.col("n").isNull(), "new").when(same, "ok").otherwise("off")
    return baseline.join(now, group, "full").select(*group, F.col("n").alias("recorded"), F.col("n_now").alias("found"), state.alias("state"))


#: The bounds of the tiers.
TIERS = (1e-9, 1e-4, 1e-2)


def tier(rel: Column) -> Column:
    return F.when(rel < TIERS[0], "exact").when(rel < TIERS[1], "float-noise").when(rel <= TIERS[2], "moderate").otherwise("real")


def require_rows(inputs: dict[str, DataFrame]) -> None:
    """Gate before a run: every input must have rows, or the run stops with the names of those that have none."""
    empty = sorted(n for n, df in inputs.items() if df.isEmpty())
    if empty:
        raise ValueError(f"inputs without rows: {', '.join(empty)}")


def allowed_writes(planned: set[str], allowed: set[str]) -> None:
    """Gate before a run: nothing outside the allowed tables may be written."""
    if planned - allowed:
        raise ValueError(f"not allowed to write: {', '.join(sorted(planned - allowed))}")


def touched(spark: SparkSession, statement: str) -> tuple[set[str], set[str]]:
    """(tables read, tables written) of a SQL statement, by its analysed plan; nothing is run. Names of the session's own catalogue stand without it."""
    told = spark.sql(f"EXPLAIN EXTENDED {statement}").first()[0]
    plan = told.split("== Analyzed Logical Plan ==", 1)[1].split("== Optimized Logical Plan ==", 1)[0]
    name = r"spark_catalog\.([\w.]+)"
    bare = lambda n: n.removeprefix("default.")
    writes, reads = set(), set()
    for line in plan.splitlines():
        if re.search(r"\b(InsertInto|CreateDataSourceTableAsSelect|OverwriteBy|AppendData|ReplaceTable|CreateTable|DeleteFrom|UpdateTable|MergeInto|TruncateTable|DropTable)\w*", line):
            writes |= {bare(n.replace("`", "")) for n in re.findall(name, line.replace("`", ""))}
        elif "SubqueryAlias" in line or "Relation" in line:
            reads |= {bare(n) for n in re.findall(name, line.replace("`", ""))}
    return reads - writes, writes


def gated(spark: SparkSession, statement: str, may_read: set[str], may_write: set[str]) -> DataFrame:
    """Run a statement that reads and writes allowed tables alone; one that doesn't is refused before it runs."""
    reads, writes = touched(spark, statement)
    if reads - may_read:
        raise ValueError(f"not allowed to read: {', '.join(sorted(reads - may_read))}")
    allowed_writes(writes, may_write)
    return spark.sql(statement)


def with_ids(points: DataFrame, metadata: DataFrame) -> DataFrame:
    """``points`` (name, ..) with metric_id from ``metadata`` (name, metric_id); a name without an id is an error when it is read."""
    j = points.join(metadata, "name", "left")
    return j.withColumn("metric_id", F.when(F.col("metric_id").isNotNull(), F.col("metric_id")).otherwise(F.raise_error(F.concat(F.lit("no id for metric "), F.col("name")))))
