"""Queries on composite metrics that are given as formulas, and on sums that are carried on from stored values."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.functions.session import scratch_folder, table, written
from strataq.functions.time import day_number, micros
from strataq.operators import composites, sums
from strataq.plans.registry import query

#: Formulas over the daily series of an asset; they are ours.
FORMULAS = {
    "turnover": "{inflow} + {outflow}",
    "net_flow": "{inflow} - {outflow}",
    "flow_ratio": "try_divide({inflow}, {outflow})",
    "per_head": "try_divide({turnover}, {active})",
    "mean_size": "try_divide({turnover}, {count})",
    "span": "{high} - {low}",
    "relative_span": "try_divide({span}, {close})",
    "middle": "({high} + {low}) / 2",
    "typical": "({high} + {low} + {close}) / 3",
    "worth": "{supply} * {close}",
    "velocity": "try_divide({turnover}, {supply})",
    "worth_to_turnover": "try_divide({worth}, {turnover} * {close})",
    "change": "{close} - {close@1}",
    "growth": "try_divide({close}, {close@1}) - 1",
    "log_growth": "ln(try_divide({close}, {close@1}))",
    "week_growth": "try_divide({close}, {close@7}) - 1",
    "issued": "{supply} - {supply@1}",
    "issued_in_week": "{supply} - {supply@7}",
    "yearly_inflation": "try_divide({issued_in_week}, {supply@7}) * 365 / 7",
    "stock_to_flow": "try_divide({supply}, {issued} * 365)",
    "head_growth": "try_divide({active}, {active@1}) - 1",
    "divergence": "{head_growth} - {growth}",
    "smoothed": "({typical} + {typical@1} + {typical@2}) / 3",
    "above_smoothed": "CASE WHEN {close} > {smoothed} THEN 1 ELSE 0 END",
    "worth_change": "abs({worth} - {worth@1})",
}

_SERIES = """d AS (
  SELECT event_id % 3 AS asset, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS dt, epoch_us(ts) AS t, event_id, user_id, event_type IN ('purchase', 'error') AS out, round(value * 100)::BIGINT AS c FROM events
), b AS (
  SELECT asset, dt, coalesce(sum(c) FILTER (WHERE NOT out), 0)::DOUBLE AS inflow, coalesce(sum(c) FILTER (WHERE out), 0)::DOUBLE AS outflow, count(DISTINCT user_id)::DOUBLE AS active, count(*)::DOUBLE AS cnt,
         max(c)::DOUBLE AS high, min(c)::DOUBLE AS low, arg_max(c, (t, event_id))::DOUBLE AS close FROM d GROUP BY 1, 2
), s AS (
  SELECT *, sum(inflow - outflow) OVER (PARTITION BY asset ORDER BY dt) AS supply, (high + low + close) / 3 AS typical FROM b
), x AS (
  SELECT s.*, p.close AS close1, p.supply AS supply1, p.active AS active1, p.typical AS typical1, q.typical AS typical2, w.close AS close7, w.supply AS supply7 FROM s
  LEFT JOIN s p ON p.asset = s.asset AND p.dt = s.dt - 1 LEFT JOIN s q ON q.asset = s.asset AND q.dt = s.dt - 2 LEFT JOIN s w ON w.asset = s.asset AND w.dt = s.dt - 7
), f AS (
  SELECT asset, dt, inflow + outflow AS turnover, inflow - outflow AS net_flow, inflow / nullif(outflow, 0) AS flow_ratio, (inflow + outflow) / active AS per_head, (inflow + outflow) / cnt AS mean_size,
         high - low AS span, (high - low) / nullif(close, 0) AS relative_span, (high + low) / 2 AS middle, typical, supply * close AS worth, (inflow + outflow) / nullif(supply, 0) AS velocity,
         supply * close / nullif((inflow + outflow) * close, 0) AS worth_to_turnover, close - close1 AS change, close / nullif(close1, 0) - 1 AS growth, ln(nullif(close, 0) / nullif(close1, 0)) AS log_growth,
         close / nullif(close7, 0) - 1 AS week_growth, supply - supply1 AS issued, supply - supply7 AS issued_in_week, (supply - supply7) / nullif(supply7, 0) * 365 / 7 AS yearly_inflation,
         supply / nullif((supply - supply1) * 365, 0) AS stock_to_flow, active / nullif(active1, 0) - 1 AS head_growth, active / nullif(active1, 0) - 1 - (close / nullif(close1, 0) - 1) AS divergence,
         (typical + typical1 + typical2) / 3 AS smoothed, CASE WHEN close > (typical + typical1 + typical2) / 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS above_smoothed, abs(supply * close - supply1 * close1) AS worth_change FROM x
)"""


def _series(spark, sf_dir):
    """(asset, dt, metric, value): daily series of three assets."""
    e = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 3).alias("asset"), micros("ts").alias("t"), "event_id", "user_id", F.col("event_type").isin("purchase", "error").alias("out"), F.round(F.col("value") * 100).cast("long").alias("c")
    )
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))
    daily = e.groupBy("asset", day_number("t").alias("dt")).agg(
        part(~F.col("out")).alias("inflow"), part(F.col("out")).alias("outflow"), F.countDistinct("user_id").alias("active"), F.count("*").alias("count"),
        F.max("c").alias("high"), F.min("c").alias("low"), F.max_by("c", F.struct("t", "event_id")).alias("close"),
    )
    daily = daily.withColumn("supply", F.sum(F.col("inflow") - F.col("outflow")).over(W.partitionBy("asset").orderBy("dt")))
    names = ("inflow", "outflow", "active", "count", "high", "low", "close", "supply")
    return daily.select("asset", "dt", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("asset", "dt", "x.*")


@query("composites", f"WITH {_SERIES} SELECT asset, dt, metric, round(value, 6) AS value FROM (UNPIVOT f ON COLUMNS(* EXCLUDE (asset, dt)) INTO NAME metric VALUE value)")
def formulas(spark, sf_dir):
    """Composites given as formulas, some over others and over earlier values, aligned by asset and day."""
    return composites.evaluate(_series(spark, sf_dir), FORMULAS).withColumn("value", F.round("value", 6))


@query(
    "cumulative_carried",
    """SELECT event_id % 3 AS asset, event_type AS metric, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS dt, (sum(sum(round(value * 100)::BIGINT)) OVER (PARTITION BY event_id % 3, event_type ORDER BY CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT)))::BIGINT AS total
    FROM events GROUP BY 1, 2, 3""",
)
def carried(spark, sf_dir):
    """Running sums by asset and metric, carried on from stored last values in three runs, each of which reads what lies beyond the last one's cursor."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 3).alias("asset"), F.col("event_type").alias("metric"), day_number(micros("ts")).alias("dt"), F.round(F.col("value") * 100).cast("long").alias("d"))
    daily = written(e.groupBy("asset", "metric", "dt").agg(F.sum("d").alias("d")))
    first, last = daily.agg(F.min("dt"), F.max("dt")).first()
    with scratch_folder(spark, sums.fresh_name()) as folder:
        for part in (1, 2, 3):
            sums.carry_on(daily, folder, ["asset", "metric"], "dt", "d", (first or 0) + ((last or 0) - (first or 0)) * part // 3)
        return written(sums.stored(spark, folder).select("asset", "metric", "dt", "total"))
