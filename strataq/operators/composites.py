"""Composite metrics as data: a formula a metric, over series that are aligned by asset and time.

A formula is a Spark SQL expression with the names of other metrics in braces: ``{supply} * {close}``. ``{supply@7}`` is the value so many steps
before, null where that time has none. Formulas may rest on others; they are worked in the order of that.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAME = re.compile(r"\{(\w+)(?:@(\d+))?\}")


def inputs(formula: str) -> set[tuple[str, int]]:
    """(metric, steps before) that a formula names."""
    return {(n, int(k or 0)) for n, k in NAME.findall(formula)}


def in_order(formulas: Mapping[str, str]) -> list[list[str]]:
    """The formulas in rounds, each of which rests on earlier ones and series alone; a circle is an error."""
    left, rounds = dict(formulas), []
    while left:
        ready = sorted(m for m, f in left.items() if not {n for n, _ in inputs(f)} & set(left))
        if not ready:
            raise ValueError(f"formulas rest on each other: {', '.join(sorted(left))}")
        rounds.append(ready)
        for m in ready:
            del left[m]
    return rounds


def evaluate(points: DataFrame, formulas: Mapping[str, str], by: Sequence[str] = ("asset",), time: str = "dt", step: int = 1) -> DataFrame:
    """(by.., time, metric, value) of every formula at every time where it has a finite value.

    ``points``: (by.., time, metric, value) of the series that formulas rest on, one value a metric and time, in any order. They are put side
    by side by one aggregation, so all formulas of a time are worked in one row; earlier values come by a window over an asset's own times. What lacks
    an input has no value there. A name that is neither a series of ``points`` nor a formula has no values, and so has none that rests on it.
    """
    by = list(by)
    named = {i for f in formulas.values() for i in inputs(f)}
    series = sorted({n for n, _ in named} - set(formulas))
    value = lambda n: F.max(F.when(F.col("metric") == n, F.col("value").cast("double"))).alias(n)
    wide = points.where(F.col("metric").isin(series)).groupBy(*by, time).agg(*[value(n) for n in series])
    before = lambda n, k: F.first(n).over(W.partitionBy(*by).orderBy(time).rangeBetween(-k * step, -k * step)).alias(f"{n}@{k}")

    def lagged(of: DataFrame, names: Sequence[str]) -> DataFrame:
        return of.select("*", *[before(n, k) for n, k in sorted(named) if k and n in names])

    wide = lagged(wide, series)
    for ready in in_order(formulas):
        told = {m: NAME.sub(lambda x: f"`{x[1]}@{x[2]}`" if x[2] else f"`{x[1]}`", formulas[m]) for m in ready}
        wide = lagged(wide.select("*", *[F.expr(f).cast("double").alias(m) for m, f in told.items()]), ready)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in formulas]))
    long = wide.select(*by, time, each.alias("x")).select(*by, time, "x.metric", "x.value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
