"""Metric queries: declared in SQL over the ledgers and series, as a metric's specification is.

Spark builds the sources with the operators (fold, as-of join); the SQL twin builds them by closed forms, so
a metric is checked from its raw changes on. ``{day(x)}`` and the like become integer expressions that both read alike.
Where no formula is published for a metric, the docstring of the family says that it is ours.
"""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.functions.session import table
from strataq.functions.time import micros
from strataq.operators import rows
from strataq.plans.base import SOURCES, with_prelude
from strataq.plans.registry import query

DAY_US = 86_400_000_000
#: Windows in days; from ``INFINITE`` days on a window has no end and books no cancels.
WINDOWS = (1, 7, 30, 60, 90, 180, 365, 730, 1095, 1825, 3650, 7300)
INFINITE = 36_500


def _expand(sql: str) -> str:
    day = lambda m: f"CAST(floor(({m[1]}) / {DAY_US}) AS BIGINT)"
    five = lambda m: f"CAST(floor(({m[1]}) / 300000000) AS BIGINT)"
    return re.sub(r"\{five\(([^}]*)\)\}", five, re.sub(r"\{day\(([^}]*)\)\}", day, sql))


def metric(name: str, sources: str, sql: str, doc: str, twin: tuple[str, str] | None = None):
    """Register a metric over ``sources``: names of ``SOURCES`` or of input tables. ``twin``: a formula of other terms for SQL, behind its sources."""
    text = _expand(sql)
    ours = [s for s in sources.split() if s in SOURCES]
    raw = [s for s in sources.split() if s not in SOURCES]

    def run(spark, sf_dir):
        frames = {s: SOURCES[s](spark, sf_dir) for s in ours} | {s: RAW[s](spark, sf_dir) for s in raw}
        named = re.sub(r"\b(FROM|JOIN) (" + "|".join(frames) + r")\b", r"\1 {\2}", text)
        return spark.sql(named, **frames)

    run.__name__, run.__doc__ = name, doc
    own = with_prelude(text, *ours, *(f"{s} AS ({RAW_SQL[s]})" for s in raw))
    query(name, own if twin is None else with_prelude(_expand(twin[1]), *twin[0].split(", ")))(run)


#: Series that aren't ledgers: for Spark and for SQL.
RAW = {
    "ev": lambda s, d: table(s, d, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("t")).selectExpr(
    "event_id", "user_id AS address", "event_type AS kind", "t", "cast(round(value * 100) AS bigint) AS cents"
    ),
    "tx": lambda s, d: table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", micros("o_orderdate").alias("t")).selectExpr(
    "o_orderkey AS tx", "o_custkey AS sender", "(o_custkey * 7 + 3) % 1000 AS receiver", "o_orderpriority AS kind", "t", "cast(round(o_totalprice * 100) AS bigint) AS cents"
    ),
    "holder": lambda s, d: table(s, d, "customer").join(table(s, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").selectExpr(
        "c_custkey AS address", "c_mktsegment AS label", "n_name AS nation", "cast(round(c_acctbal * 100) AS bigint) AS cents"
    ),
}
RAW_SQL = {
    "ev": "SELECT event_id, user_id AS address, event_type AS kind, epoch_us(ts) AS t, round(value * 100)::BIGINT AS cents FROM events",
    "tx": "SELECT o_orderkey AS tx, o_custkey AS sender, (o_custkey * 7 + 3) % 1000 AS receiver, o_orderpriority AS kind, epoch_us(o_orderdate) AS t, round(o_totalprice * 100)::BIGINT AS cents FROM orders",
    "holder": "SELECT c_custkey AS address, c_mktsegment AS label, n_name AS nation, round(c_acctbal * 100)::BIGINT AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey",
}

I = lambda x: f"CAST({x} AS BIGINT)"  # noqa: E731, E741
PREFIX = "OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

# ---------------------------------------------------------------- ages and prices of coins

metric("age_distribution", "pseam", f"SELECT {{day(t)}} AS day, {{day(odt)}} AS origin_day, {I('sum(measure)')} AS measure, {I('sum(measure * acq)')} AS cost FROM pseam WHERE odt <> 0 GROUP BY {{day(t)}}, {{day(odt)}}", "M1, M2: measure and cost by day and origin day.")
metric("age_consumed_daily", "seam", f"SELECT {{day(t)}} AS day, round(sum(CAST(-measure AS DOUBLE) * ((t - odt) / 1000000)) / 86400, 3) AS age_consumed FROM seam WHERE odt <> 0 AND odt <> t GROUP BY {{day(t)}}", "M3.",
       ("eaten", "SELECT day, round(sum(CAST(amount AS DOUBLE) * ((t - odt) / 1000000)) / 86400, 3) AS age_consumed FROM eaten WHERE odt <> t GROUP BY day"))
metric("age_consumed_intraday", "seam", f"SELECT {{five(t)}} AS bucket, {I('sum(-measure * {day(t - odt)})')} AS coin_days FROM seam WHERE odt <> 0 AND odt <> t GROUP BY {{five(t)}}", "M3: whole days of age by five minutes.",
       ("eaten", "SELECT {five(t)} AS bucket, sum(amount * ((t - odt) // 86400000000))::BIGINT AS coin_days FROM eaten WHERE odt <> t GROUP BY 1"))
metric("price_consumed_daily", "pseam", f"SELECT {{day(t)}} AS day, {I('sum(-measure * acq * {day(t - odt)})')} AS value FROM pseam WHERE odt <> 0 GROUP BY {{day(t)}}", "M4: rows without an acquisition price are skipped.")
metric("network_profit_loss", "pseam", f"SELECT {{day(t)}} AS day, {I('coalesce(sum((now - acq) * -measure), 0)')} AS npl FROM pseam GROUP BY {{day(t)}}", "M5: both prices are on the five-minute grid, so fresh inflows cancel; what lacks a price has no profit.",
       ("eaten", "SELECT d.day, coalesce(sum(e.amount * (e.now - e.acq)), 0)::BIGINT AS npl FROM (SELECT DISTINCT {day(t)} AS day FROM ch) d LEFT JOIN eaten e ON e.day = d.day GROUP BY d.day"))
metric(
    "volume_profit_loss", "pseam",
    f"""SELECT {{day(t)}} AS day, {I('sum(CASE WHEN now > acq THEN -measure ELSE 0 END)')} AS profit, {I('sum(CASE WHEN now < acq THEN -measure ELSE 0 END)')} AS loss,
    round(CAST(sum(CASE WHEN now > acq THEN -measure ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN now < acq THEN -measure ELSE 0 END), 0), 6) AS ratio
    FROM pseam WHERE t <> odt GROUP BY {{day(t)}}""", "M6: a null price is neither profit nor loss.",
)


def _windowed(windows=(*WINDOWS, INFINITE)) -> str:
    """Daily changes of what is younger than each window: what enters, and its cancel on the day it grows too old. One pass."""
    rows = [(w, k, w * DAY_US if w < INFINITE else 0) for w in windows for k in (0, 1) if w < INFINITE or k == 0]
    return f"""SELECT window_days, day, {I('sum(m)')} AS delta, {I('sum(c)')} AS cost, {I('sum(m * created)')} AS created, sum(CAST(m AS DECIMAL(38, 0)) * created * created) AS squared, {I('sum(c_m)')} AS priced, sum(CAST(c AS DECIMAL(38, 0)) * created) AS cost_created FROM (
      SELECT w.window_days, {{day(s.odt)}} AS created, CASE WHEN w.cancel = 0 THEN {{day(s.t)}} ELSE {{day(s.odt + w.us)}} END AS day,
             CASE WHEN w.cancel = 0 THEN s.measure ELSE -s.measure END AS m, CASE WHEN w.cancel = 0 THEN coalesce(s.measure * s.acq, 0) ELSE -coalesce(s.measure * s.acq, 0) END AS c,
             CASE WHEN s.acq IS NULL THEN 0 WHEN w.cancel = 0 THEN s.measure ELSE -s.measure END AS c_m
      FROM pseam s CROSS JOIN (VALUES {", ".join(map(str, rows))}) AS w(window_days, cancel, us)
      WHERE s.odt <> 0 AND (w.window_days >= {INFINITE} OR s.t - s.odt < w.us)) x GROUP BY window_days, day"""


OVER_DAYS = "OVER (PARTITION BY g.window_days ORDER BY g.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_SUMS = ("delta", "cost", "created", "squared", "priced", "cost_created")


def _so_far(*sums: str, windows=(*WINDOWS, INFINITE)) -> str:
    """Running ``sums`` of the windowed changes on every day of every window, up to the last day of the data."""
    values = ", ".join(f"({w})" for w in windows)
    told = ", ".join(f"CAST(sum(coalesce(d.{c}, 0)) {OVER_DAYS} AS {'DECIMAL(38, 0)' if c in ('squared', 'cost_created') else 'BIGINT'}) AS {c}" for c in sums)
    return f"""SELECT g.window_days, g.day, {told} FROM (SELECT w.window_days, n.day FROM days n CROSS JOIN (VALUES {values}) AS w(window_days)) g
      LEFT JOIN ({_windowed(windows)}) d ON d.window_days = g.window_days AND d.day = g.day"""


#: Of the held amounts by day: of those younger than a window, or all.
_YOUNG = f"(w.window_days >= {INFINITE} OR {{day(h.odt + w.window_days * {DAY_US})}} > h.day)"
_HELD_TWIN = lambda what, name: ("held days", f"SELECT w.window_days, g.day, coalesce(sum(CASE WHEN {_YOUNG} THEN {what} END), 0)::BIGINT AS {name} FROM days g CROSS JOIN (VALUES {', '.join(f'({w})' for w in (*WINDOWS, INFINITE))}) AS w(window_days) LEFT JOIN held_days h ON h.day = g.day GROUP BY 1, 2")
metric("circulation_delta_T", "pseam", f"SELECT window_days, day, delta FROM ({_windowed()}) d", "M7, M8: changes by day, cancels after the last day of the data with them; the infinite window has no cancels.")
metric("circulation_T", "pseam days", f"SELECT window_days, day, delta AS circulation FROM ({_so_far('delta')}) d", "M9: on every day of every window.", _HELD_TWIN("h.rem", "circulation"))
metric("circulation_infinite", "pseam days", f"SELECT day, delta AS circulation FROM ({_so_far('delta', windows=(INFINITE,))}) d", "M8.")
_ASSET_DELTAS = f"""SELECT contract, window_days, day, {I('sum(m)')} AS delta, {I('sum(c)')} AS cost FROM (
      SELECT s.contract, w.window_days, CASE WHEN w.cancel = 0 THEN {{day(s.t)}} ELSE {{day(s.odt + w.us)}} END AS day, CASE WHEN w.cancel = 0 THEN s.measure ELSE -s.measure END AS m,
             CASE WHEN w.cancel = 0 THEN coalesce(s.measure * s.acq, 0) ELSE -coalesce(s.measure * s.acq, 0) END AS c
      FROM cseam s CROSS JOIN (VALUES {", ".join(str((w, k, w * DAY_US if w < INFINITE else 0)) for w in (*WINDOWS, INFINITE) for k in (0, 1) if w < INFINITE or k == 0)}) AS w(window_days, cancel, us)
      WHERE s.odt <> 0 AND (w.window_days >= {INFINITE} OR s.t - s.odt < w.us)) x GROUP BY contract, window_days, day"""
_ASSET_DAYS = "OVER (PARTITION BY g.contract, g.window_days ORDER BY g.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_ALL_WINDOWS = ", ".join(f"({w})" for w in (*WINDOWS, INFINITE))
_BY_ASSET = f"""SELECT g.contract, g.window_days, g.day, {I('sum(coalesce(d.delta, 0)) ' + _ASSET_DAYS)} AS circulation, {I('sum(coalesce(d.cost, 0)) ' + _ASSET_DAYS)} AS cap
      FROM (SELECT n.contract, n.day, w.window_days FROM cdays n CROSS JOIN (VALUES {_ALL_WINDOWS}) AS w(window_days)) g
      LEFT JOIN ({_ASSET_DELTAS}) d ON d.contract = g.contract AND d.window_days = g.window_days AND d.day = g.day"""
_ASSET_CLOSE = "SELECT contract, {day(t)} AS day, max_by(price, t) AS price FROM cprice GROUP BY contract, {day(t)}"
_ASSET_HELD = f"SELECT g.contract, w.window_days, g.day, coalesce(sum(CASE WHEN {_YOUNG} THEN h.rem END), 0)::BIGINT AS circulation, coalesce(sum(CASE WHEN {_YOUNG} THEN h.rem * h.acq END), 0)::BIGINT AS cap FROM cdays g CROSS JOIN (VALUES {_ALL_WINDOWS}) AS w(window_days) LEFT JOIN cheld_days h ON h.contract = g.contract AND h.day = g.day GROUP BY 1, 2, 3"
metric("circulation_by_asset", "cseam cdays", f"SELECT contract, window_days, day, circulation, cap AS realized_cap FROM ({_BY_ASSET}) d", "M7-M10 by asset, each with its own prices.",
       ("cheld days, cdays", f"SELECT contract, window_days, day, circulation, cap AS realized_cap FROM ({_ASSET_HELD}) k"))
metric("mvrv_by_asset", "cseam cdays cprice", f"SELECT k.contract, k.window_days, k.day, round(CAST(k.cap AS DOUBLE) / nullif(k.circulation, 0), 6) AS mean_price, round(CAST(p.price AS DOUBLE) * k.circulation / nullif(k.cap, 0), 6) AS mvrv FROM ({_BY_ASSET}) k JOIN ({_ASSET_CLOSE}) p ON k.contract = p.contract AND k.day = p.day", "M11, M12 by asset.",
       ("cheld days, cdays", f"SELECT k.contract, k.window_days, k.day, round(k.cap::DOUBLE / nullif(k.circulation, 0), 6) AS mean_price, round(p.price::DOUBLE * k.circulation / nullif(k.cap, 0), 6) AS mvrv FROM ({_ASSET_HELD}) k JOIN (SELECT contract, t // 86400000000 AS day, arg_max(price, t) AS price FROM cprice GROUP BY 1, 2) p ON k.contract = p.contract AND k.day = p.day"))
metric(
    "hodl_waves_by_asset", "cseam cdays",
    f"""SELECT contract, day, window_days, {I('cap - coalesce(younger, 0)')} AS band_cap, round(CAST(cap - coalesce(younger, 0) AS DOUBLE) / nullif(whole, 0), 6) AS share FROM (
      SELECT contract, day, window_days, cap, lag(cap) OVER (PARTITION BY contract, day ORDER BY window_days) AS younger, max(CASE WHEN window_days = {INFINITE} THEN cap END) OVER (PARTITION BY contract, day) AS whole FROM ({_BY_ASSET}) k) w""",
    "M13 by asset.",
)
metric("profit_loss_by_asset", "cseam", f"SELECT contract, {{day(t)}} AS day, {I('coalesce(sum((now - acq) * -measure), 0)')} AS npl, {I('sum(CASE WHEN now > acq AND t <> odt THEN -measure ELSE 0 END)')} AS profit, {I('sum(CASE WHEN now < acq AND t <> odt THEN -measure ELSE 0 END)')} AS loss FROM cseam GROUP BY contract, {{day(t)}}", "M5, M6 by asset.",
       ("ceaten", "SELECT d.contract, d.day, coalesce(any_value(e.npl), 0)::BIGINT AS npl, coalesce(any_value(e.profit), 0)::BIGINT AS profit, coalesce(any_value(e.loss), 0)::BIGINT AS loss FROM (SELECT DISTINCT contract, day FROM (SELECT address % 10 AS contract, t // 86400000000 AS day FROM ledger GROUP BY 1, 2, odt HAVING sum(sign * amount) <> 0)) d LEFT JOIN (SELECT contract, day, sum(amount * (now - acq)) AS npl, sum(amount) FILTER (WHERE now > acq AND t <> odt) AS profit, sum(amount) FILTER (WHERE now < acq AND t <> odt) AS loss FROM ceaten GROUP BY 1, 2) e ON e.contract = d.contract AND e.day = d.day GROUP BY 1, 2"))
metric(
    "dormant_by_asset", "cseam", f"SELECT s.contract, w.window_days, {{day(s.t)}} AS day, {I('sum(-s.measure)')} AS moved, {I('sum(-s.measure * s.now)')} AS moved_value FROM cseam s CROSS JOIN (VALUES {', '.join(str((w, w * DAY_US)) for w in WINDOWS)}) AS w(window_days, us) WHERE s.odt <> 0 AND s.t - s.odt >= w.us GROUP BY s.contract, w.window_days, {{day(s.t)}}",
    "M14 by asset.",
    ("ceaten", f"SELECT e.contract, w.window_days, e.day, sum(e.amount)::BIGINT AS moved, sum(e.amount * e.now)::BIGINT AS moved_value FROM ceaten e CROSS JOIN (VALUES {', '.join(f'({w})' for w in WINDOWS)}) AS w(window_days) WHERE e.t - e.odt >= w.window_days * {DAY_US} GROUP BY 1, 2, 3"),
)
metric("age_consumed_by_asset", "cseam", f"SELECT contract, {{day(t)}} AS day, {I('sum(-measure * {day(t - odt)})')} AS coin_days FROM cseam WHERE odt <> 0 AND odt <> t GROUP BY contract, {{day(t)}}", "M3 by asset.")
metric(
    "creation_T", "pseam days",
    f"""SELECT window_days, day, created AS creation_days, round(CAST(created AS DOUBLE) / nullif(delta, 0), 6) AS mean_creation, round(day + 1 - CAST(created AS DOUBLE) / nullif(delta, 0), 6) AS mean_age,
    round(CAST(squared AS DOUBLE) / 1000000000000, 4) AS squared FROM ({_so_far('delta', 'created', 'squared')}) c""",
    "M16-M18 by window: total and mean creation day, mean age, and squares in units of 1e12.",
    ("held days", f"""SELECT window_days, day, x1::BIGINT AS creation_days, round(x1::DOUBLE / nullif(x0, 0), 6) AS mean_creation, round(day + 1 - x1::DOUBLE / nullif(x0, 0), 6) AS mean_age, round(x2::DOUBLE / 1000000000000, 4) AS squared FROM (
      SELECT w.window_days, g.day, coalesce(sum(CASE WHEN {_YOUNG} THEN h.rem END), 0) AS x0, coalesce(sum(CASE WHEN {_YOUNG} THEN h.rem * {{day(h.odt)}} END), 0) AS x1, coalesce(sum(CASE WHEN {_YOUNG} THEN h.rem::HUGEINT * {{day(h.odt)}} * {{day(h.odt)}} END), 0) AS x2
      FROM days g CROSS JOIN (VALUES {', '.join(f'({w})' for w in (*WINDOWS, INFINITE))}) AS w(window_days) LEFT JOIN held_days h ON h.day = g.day GROUP BY 1, 2) x"""),
)
metric("mean_age_within_window", "pseam days", f"SELECT window_days, count(*) AS days, {I('sum(CASE WHEN delta > 0 AND (day + 1) * delta - created > (window_days + 1) * delta THEN 1 ELSE 0 END)')} AS beyond FROM ({_so_far('delta', 'created')}) c WHERE window_days < {INFINITE} GROUP BY window_days", "R18: what is younger than a window is no older on average, to the day.")
metric("realized_cap_T", "pseam days", f"SELECT window_days, day, cost AS realized_cap FROM ({_so_far('cost')}) d", "M10: weighted by acquisition price.", _HELD_TWIN("h.rem * h.acq", "realized_cap"))
metric(
    "dollar_age_T", "pseam days",
    f"SELECT window_days, day, round(day + 1 - CAST(cost_created AS DOUBLE) / nullif(cost, 0), 6) AS dollar_age, round(CAST(cost AS DOUBLE) / nullif(priced, 0), 6) AS mean_price FROM ({_so_far('cost', 'priced', 'cost_created')}) d",
    "M22 by window: mean age and mean price, weighted by cost; what has no price weighs nothing.",
    ("held days", f"""SELECT window_days, day, round(day + 1 - x1::DOUBLE / nullif(x0, 0), 6) AS dollar_age, round(x0::DOUBLE / nullif(n, 0), 6) AS mean_price FROM (
      SELECT w.window_days, g.day, coalesce(sum(CASE WHEN {_YOUNG} THEN h.rem * h.acq END), 0) AS x0, sum(CASE WHEN {_YOUNG} THEN (h.rem * h.acq)::HUGEINT * {{day(h.odt)}} END) AS x1, sum(CASE WHEN {_YOUNG} AND h.acq IS NOT NULL THEN h.rem END) AS n
      FROM days g CROSS JOIN (VALUES {', '.join(f'({w})' for w in (*WINDOWS, INFINITE))}) AS w(window_days) LEFT JOIN held_days h ON h.day = g.day GROUP BY 1, 2) x"""),
)
_CAPS = f"SELECT window_days, day, delta AS circulation, cost AS cap FROM ({_so_far('delta', 'cost')}) k"
_LAST = "SELECT {day(t)} AS day, max_by(price, t) AS price FROM price GROUP BY {day(t)}"
metric("mrp_mvrv", "pseam price days", f"SELECT k.window_days, k.day, round(CAST(cap AS DOUBLE) / nullif(circulation, 0), 6) AS mean_price, round(CAST(p.price AS DOUBLE) * circulation / nullif(cap, 0), 6) AS mvrv FROM ({_CAPS}) k JOIN ({_LAST}) p ON k.day = p.day", "M11, M12: the mean realized price, and the day's closing price over it.")
metric(
    "hodl_waves", "pseam days",
    f"""SELECT day, window_days, {I('cap - coalesce(younger, 0)')} AS band_cap, round(CAST(cap - coalesce(younger, 0) AS DOUBLE) / nullif(whole, 0), 6) AS share FROM (
      SELECT day, window_days, cap, lag(cap) OVER (PARTITION BY day ORDER BY window_days) AS younger, max(CASE WHEN window_days = {INFINITE} THEN cap END) OVER (PARTITION BY day) AS whole FROM ({_CAPS}) k) w""",
    "M13: realized cap between neighbouring windows over that of all time, on every day.",
)
metric("mvrv_long_short", "pseam price days", f"SELECT k.day, round(max(CASE WHEN window_days = {INFINITE} THEN CAST(p.price AS DOUBLE) * circulation / nullif(cap, 0) END) - max(CASE WHEN window_days = 7 THEN CAST(p.price AS DOUBLE) * circulation / nullif(cap, 0) END), 6) AS diff FROM ({_CAPS}) k JOIN ({_LAST}) p ON k.day = p.day GROUP BY k.day", "M12: all time less seven days; the choice of windows is ours.")
metric("dormant_T", "pseam", f"SELECT w.window_days, {{day(s.t)}} AS day, {I('sum(-s.measure)')} AS moved, {I('sum(-s.measure * s.now)')} AS moved_value FROM pseam s CROSS JOIN (VALUES {', '.join(str((w, w * DAY_US)) for w in WINDOWS)}) AS w(window_days, us) WHERE s.odt <> 0 AND s.t - s.odt >= w.us GROUP BY w.window_days, {{day(s.t)}}", "M14: what moved at an age of the window or more, and its value at the time's price.")
_EDGES = (0, *WINDOWS)
_BAND = "CASE " + " ".join(f"WHEN {{age}} < {w * DAY_US} THEN '{a}-{w}'" for a, w in zip(_EDGES, WINDOWS)) + f" ELSE '{WINDOWS[-1]}+' END"
metric(
    "spent_age_bands", "seam",
    f"""SELECT day, band, moved, round(CAST(moved AS DOUBLE) / nullif(sum(moved) OVER (PARTITION BY day), 0), 6) AS share FROM (
      SELECT {{day(t)}} AS day, {_BAND.format(age='t - odt')} AS band, {I('sum(-measure)')} AS moved FROM seam WHERE odt <> 0 AND odt <> t GROUP BY {{day(t)}}, {_BAND.format(age='t - odt')}) b""",
    "M15: consumed volume by age band between neighbouring windows, in days, lower edges included.",
    ("eaten", f"SELECT day, band, sum(amount)::BIGINT AS moved, round(sum(amount)::DOUBLE / nullif(sum(sum(amount)) OVER (PARTITION BY day), 0), 6) AS share FROM (SELECT *, {_BAND.format(age='t - odt')} AS band FROM eaten WHERE odt <> t) e GROUP BY day, band"),
)
_MOMENTS = f"SELECT {{day(t)}} AS day, {I('sum(measure)')} AS m0, {I('sum(measure * {day(odt)})')} AS m1, CAST(sum(CAST(measure AS DOUBLE) * {{day(odt)}} * {{day(odt)}}) AS DOUBLE) AS m2 FROM seam WHERE odt <> 0 GROUP BY {{day(t)}}"
metric("creation_moments", "seam", f"SELECT day, supply, creation_days, squared, round(CAST(creation_days AS DOUBLE) / nullif(supply, 0), 6) AS mean_creation FROM (SELECT day, {I('sum(m0) ' + PREFIX)} AS supply, {I('sum(m1) ' + PREFIX)} AS creation_days, round(sum(m2) {PREFIX} / 1000000000000, 4) AS squared FROM ({_MOMENTS}) d) x", "M16, M17: total creation days, their squares in units of 1e12, and the mean.")
metric(
    "mean_age_liveliness", "seam",
    f"""SELECT day, round(day + 1 - CAST(s1 AS DOUBLE) / nullif(s0, 0), 6) AS mean_age, {I('s0 * (day + 1) - s1')} AS total_age, round(CAST(eaten AS DOUBLE) / nullif(eaten + s0 * (day + 1) - s1, 0), 6) AS liveliness FROM (
      SELECT d.day, sum(m0) OVER (ORDER BY d.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s0, sum(m1) OVER (ORDER BY d.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s1,
             sum(c) OVER (ORDER BY d.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eaten
      FROM ({_MOMENTS}) d JOIN (SELECT {{day(t)}} AS day, sum(CASE WHEN odt <> t THEN -measure * ({{day(t)}} - {{day(odt)}}) ELSE 0 END) AS c FROM seam WHERE odt <> 0 GROUP BY {{day(t)}}) e ON d.day = e.day) x""",
    "M18-M20: mean age in days, total age, and consumed over consumed and held.",
)
metric("coin_age_deviation", "seam", f"SELECT day, round(sqrt(greatest(0, s2 / nullif(s0, 0) - (s1 / nullif(s0, 0)) * (s1 / nullif(s0, 0)))), 2) AS deviation FROM (SELECT day, CAST(sum(m0) {PREFIX} AS DOUBLE) AS s0, CAST(sum(m1) {PREFIX} AS DOUBLE) AS s1, sum(m2) {PREFIX} AS s2 FROM ({_MOMENTS}) d) x", "M21: from the moments of creation days; the derivation is ours.")
metric("dollar_weighted_age", "pseam", f"SELECT day, round(day + 1 - CAST(c1 AS DOUBLE) / nullif(c0, 0), 6) AS dollar_age FROM (SELECT day, sum(c0) {PREFIX} AS c0, sum(c1) {PREFIX} AS c1 FROM (SELECT {{day(t)}} AS day, sum(measure * acq) AS c0, sum(measure * acq * {{day(odt)}}) AS c1 FROM pseam WHERE odt <> 0 AND acq IS NOT NULL GROUP BY {{day(t)}}) d) x", "M22.")
metric("supply_from_balances", "balance", f"SELECT day, {I('sum(d) ' + PREFIX)} AS supply FROM (SELECT {{day(t)}} AS day, sum(balance - old_balance) AS d FROM balance GROUP BY {{day(t)}}) x", "M23.")
metric("marketcap_nvt", "balance price ch", f"SELECT s.day, {I('s.supply * p.price')} AS marketcap, round(CAST(s.supply AS DOUBLE) * p.price / nullif(v.volume, 0), 4) AS nvt, round(CAST(v.volume AS DOUBLE) / nullif(s.supply, 0), 6) AS velocity FROM (SELECT day, sum(d) {PREFIX} AS supply FROM (SELECT {{day(t)}} AS day, sum(balance - old_balance) AS d FROM balance GROUP BY {{day(t)}}) x) s JOIN ({_LAST}) p ON s.day = p.day JOIN (SELECT {{day(t)}} AS day, sum(abs(amount)) AS volume FROM ch GROUP BY {{day(t)}}) v ON s.day = v.day", "M24: composites of supply, price and volume; the formulas are ours.")
_COHORTS = "SELECT {day(t)} AS day, acq, sum(measure) AS measure FROM pseam WHERE odt <> 0 GROUP BY {day(t)}, acq"


@query(
    "supply_in_profit",
    with_prelude(
        _expand(f"""SELECT p.day, {I('sum(CASE WHEN s.acq < p.price THEN s.measure ELSE 0 END)')} AS in_profit, {I('sum(s.measure)')} AS supply,
        round(CAST(sum(CASE WHEN s.acq < p.price THEN s.measure ELSE 0 END) AS DOUBLE) / nullif(sum(s.measure), 0), 6) AS percent
        FROM ({_LAST}) p JOIN ({_COHORTS}) s ON s.day <= p.day GROUP BY p.day"""),
        "pseam", "price",
    ),
)
def supply_in_profit(spark, sf_dir):
    """Held cohorts bought below the day's price, and their share.

    A cohort of one purchase price holds the same from one of its days to the next; each such span meets the days it
    covers by an equi-join on the day.
    """
    p = spark.sql(_expand(_LAST).replace("FROM price", "FROM {price}"), price=SOURCES["price"](spark, sf_dir))
    c = spark.sql(_expand(_COHORTS).replace("FROM pseam", "FROM {pseam}"), pseam=SOURCES["pseam"](spark, sf_dir))
    days = W.partitionBy("acq").orderBy("day")
    held = c.select("acq", F.sum("measure").over(days).alias("held"), F.col("day").alias("since"), F.lead("day").over(days).alias("until"))
    last = p.agg(F.max("day")).first()[0] or 0
    spans = held.where((F.col("held") != 0) & (F.col("since") <= last)).select("acq", "held", F.explode(F.sequence("since", F.least(F.coalesce(F.col("until") - 1, F.lit(last)), F.lit(last)))).alias("day"))
    below = F.sum(F.when(F.col("acq") < F.col("price"), F.col("held")).otherwise(0))
    out = spans.join(p, "day").groupBy("day").agg(below.cast("long").alias("in_profit"), F.sum("held").cast("long").alias("supply"))
    return out.withColumn("percent", F.round(F.try_divide(F.col("in_profit").cast("double"), F.col("supply")), 6))


_SUPPLY = f"SELECT day, sum(d) {PREFIX} AS supply, d FROM (SELECT {{day(t)}} AS day, sum(balance - old_balance) AS d FROM balance GROUP BY {{day(t)}}) x"
metric("total_supply_coalesce", "balance pseam days", f"SELECT k.day, {I('coalesce(c.supply, k.circulation)')} AS supply FROM ({_CAPS}) k LEFT JOIN ({_SUPPLY}) c ON k.day = c.day AND c.day % 3 <> 0 WHERE k.window_days = 7300", "M23: a supply of its own where there is one, else the circulation of twenty years.")
metric("mvrv_z", "balance pseam price days", f"SELECT day, round((value - cap) / nullif(deviation, 0), 4) AS z FROM (SELECT k.day, CAST(s.supply AS DOUBLE) * p.price AS value, CAST(k.cap AS DOUBLE) AS cap, stddev_samp(CAST(s.supply AS DOUBLE) * p.price / 1000000) OVER (ORDER BY k.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 1000000 AS deviation FROM ({_CAPS}) k JOIN ({_SUPPLY}) s ON k.day = s.day JOIN ({_LAST}) p ON k.day = p.day WHERE k.window_days = {INFINITE}) x", "M12: market less realized value over the deviation of market values so far; the formula is ours.")
metric(
    "supply_composites", "balance price tx",
    f"""SELECT s.day, {I('m.most * p.price')} AS fully_diluted, round(CAST(s.supply - w.supply AS DOUBLE) / nullif(w.supply, 0) * 365 / 7, 6) AS annual_inflation, round(CAST(s.supply AS DOUBLE) / nullif(s.d * 365, 0), 6) AS stock_to_flow,
    round(CAST(s.supply AS DOUBLE) * p.price / nullif(v.volume, 0), 4) AS nvt_volume FROM ({_SUPPLY}) s JOIN ({_LAST}) p ON s.day = p.day LEFT JOIN ({_SUPPLY}) w ON w.day = s.day - 7
    LEFT JOIN (SELECT {{day(t)}} AS day, sum(cents) AS volume FROM tx GROUP BY {{day(t)}}) v ON v.day = s.day CROSS JOIN (SELECT max(supply) AS most FROM ({_SUPPLY}) z) m""",
    "M24: composites of supply, price and transaction volume; the formulas are ours. One row of the greatest supply meets all days.",
)
metric("market_dominance", "ev price", f"SELECT c.day, c.kind, round(CAST(c.held AS DOUBLE) / nullif(sum(c.held) OVER (PARTITION BY c.day), 0), 6) AS dominance FROM (SELECT kind, day, sum(d) OVER (PARTITION BY kind ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM (SELECT kind, {{day(t)}} AS day, sum(cents) AS d FROM ev GROUP BY kind, {{day(t)}}) k) c JOIN ({_LAST}) p ON c.day = p.day", "M24: one asset's value in that of all; kinds of events stand for assets.")
metric("address_profit_cumulative", "pledger", f"SELECT address, day, {I('sum(profit) OVER (PARTITION BY address ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS profit FROM (SELECT address, {{day(t)}} AS day, coalesce(sum(-sign * amount * (now - acq)), 0) AS profit FROM pledger WHERE odt <> 0 GROUP BY address, {{day(t)}}) d", "M40: the running profit of each key.",
       ("eaten", "SELECT d.address, d.day, coalesce(sum(sum(e.amount * (e.now - e.acq))) OVER (PARTITION BY d.address ORDER BY d.day), 0)::BIGINT AS profit FROM (SELECT DISTINCT address, {day(t)} AS day FROM ledger WHERE odt <> 0) d LEFT JOIN eaten e ON e.address = d.address AND e.day = d.day GROUP BY d.address, d.day"))
metric("address_realized_profit", "pledger", f"SELECT address, {I('coalesce(sum(-sign * amount * (now - acq)), 0)')} AS profit FROM pledger WHERE odt <> 0 GROUP BY address", "M40: by key; over all keys the sum is that of the network's profits.",
       ("eaten", "SELECT a.address, coalesce(sum(e.amount * (e.now - e.acq)), 0)::BIGINT AS profit FROM (SELECT DISTINCT address FROM ledger WHERE odt <> 0) a LEFT JOIN eaten e ON e.address = a.address GROUP BY a.address"))

metric("survivor_circulation_T", "survivors", f"SELECT w.window_days, count(*) AS coins, {I('sum(s.held)')} AS circulation FROM survivors s CROSS JOIN (VALUES {', '.join(str((w, w * DAY_US)) for w in WINDOWS)}) AS w(window_days, us) WHERE s.held > 0 AND s.t >= 1706572800000000 - w.us GROUP BY w.window_days", "K9: what younger inflows still hold on 2024-01-30.")
metric(
    "survivor_realized_cap", "psurvivors", f"SELECT {{day(t)}} AS day, {I('sum(held * acq)')} AS cap, {I('sum(held)')} AS held, round(CAST(sum(held * {{day(t)}}) AS DOUBLE) / nullif(sum(held), 0), 6) AS mean_creation FROM psurvivors WHERE held > 0 GROUP BY {{day(t)}}",
    "K10: survivors at the price at their time, and their mean day of creation.",
    ("held days", "SELECT odt // 86400000000 AS day, sum(rem * acq)::BIGINT AS cap, sum(rem)::BIGINT AS held, round(sum(rem * (odt // 86400000000))::DOUBLE / nullif(sum(rem), 0), 6) AS mean_creation FROM held_days WHERE day = (SELECT max(day) FROM days) AND rem > 0 GROUP BY 1"),
)
metric("busy_days_only", "ch", "SELECT address, count(*) AS n, sum(CASE WHEN amount < 0 THEN 1 ELSE 0 END) AS outflows FROM ch GROUP BY address HAVING sum(CASE WHEN amount < 0 THEN 1 ELSE 0 END) > 20".replace("sum(CASE WHEN amount < 0 THEN 1 ELSE 0 END) AS", "CAST(sum(CASE WHEN amount < 0 THEN 1 ELSE 0 END) AS BIGINT) AS"), "A10: groups kept by a condition on a conditional count.")

# ---------------------------------------------------------------- activity, holders and labels

metric("active_addresses", "ch", "SELECT {day(t)} AS day, count(DISTINCT address) AS active FROM ch GROUP BY {day(t)}", "M28.")
metric("network_growth", "ch", "SELECT first_day AS day, count(*) AS born FROM (SELECT address, min({day(t)}) AS first_day FROM ch GROUP BY address) f GROUP BY first_day", "M28: addresses by their first day.")
metric("rolling_change", "ch", "SELECT day, active, active - first_value(active) OVER (ORDER BY day RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS change_1d, active - first_value(active) OVER (ORDER BY day RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING) AS change_7d FROM (SELECT {day(t)} AS day, count(DISTINCT address) AS active FROM ch GROUP BY {day(t)}) d", "W6: against the day so many days before, null where it has none.")
metric("transaction_volume", "tx", f"SELECT {{day(t)}} AS day, count(*) AS transactions, {I('sum(cents)')} AS volume, {I('max(cents)')} AS largest, round(avg(cents), 3) AS mean_size, CAST(sum(CASE WHEN sender <> receiver THEN 1 ELSE 0 END) AS BIGINT) AS payments FROM tx GROUP BY {{day(t)}}", "M29.")
metric("whale_transactions", "tx", f"SELECT {{day(t)}} AS day, count(*) AS whales, {I('sum(cents)')} AS volume FROM tx WHERE cents >= 30000000 GROUP BY {{day(t)}}", "M30: above a threshold in cents.")
metric("label_balance_delta", "tx holder", f"SELECT h.label, {{day(x.t)}} AS day, {I('sum(x.amount)')} AS delta FROM (SELECT sender AS address, t, -cents AS amount FROM tx UNION ALL SELECT receiver, t, cents FROM tx) x JOIN holder h ON x.address = h.address GROUP BY h.label, {{day(x.t)}}", "M32.")
metric("label_balance_cumulative", "tx holder", f"SELECT label, day, {I('sum(delta) OVER (PARTITION BY label ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS balance FROM (SELECT h.label, {{day(x.t)}} AS day, sum(x.amount) AS delta FROM (SELECT sender AS address, t, -cents AS amount FROM tx UNION ALL SELECT receiver, t, cents FROM tx) x JOIN holder h ON x.address = h.address GROUP BY h.label, {{day(x.t)}}) d", "M32, M36.")
metric("exchange_flow", "tx holder", f"SELECT {{day(x.t)}} AS day, {I('sum(CASE WHEN r.label IS NOT NULL THEN x.cents ELSE 0 END)')} AS inflow, {I('sum(CASE WHEN s.label IS NOT NULL THEN x.cents ELSE 0 END)')} AS outflow, {I('sum(CASE WHEN r.label IS NOT NULL AND s.label IS NOT NULL THEN x.cents ELSE 0 END)')} AS internal FROM tx x LEFT JOIN holder s ON x.sender = s.address AND s.label = 'BUILDING' LEFT JOIN holder r ON x.receiver = r.address AND r.label = 'BUILDING' GROUP BY {{day(x.t)}}", "M31: one market segment stands for exchanges.")
metric("exchange_labelled_flow", "tx holder", f"SELECT s.label AS from_label, r.label AS to_label, count(*) AS n, {I('sum(x.cents)')} AS volume FROM tx x JOIN holder s ON x.sender = s.address JOIN holder r ON x.receiver = r.address GROUP BY s.label, r.label", "M31: deposits and withdrawals between labels.")
metric("exchange_supply", "holder", f"SELECT nation, {I('sum(cents)')} AS supply, {I('sum(CASE WHEN label = ' + chr(39) + 'BUILDING' + chr(39) + ' THEN cents ELSE 0 END)')} AS on_exchanges, {I('sum(CASE WHEN label <> ' + chr(39) + 'BUILDING' + chr(39) + ' THEN cents ELSE 0 END)')} AS off_exchanges, round(100 * CAST(sum(CASE WHEN label = 'BUILDING' THEN cents ELSE 0 END) AS DOUBLE) / nullif(sum(cents), 0), 4) AS percent_on FROM holder GROUP BY nation", "M26: label-restricted balance sums.")
_BUCKET = "CASE " + " ".join(f"WHEN {{c}} < {10**k * 100} THEN {k}" for k in range(1, 10)) + " ELSE 10 END"
metric("holders_distribution", "holder", f"SELECT bucket, count(*) AS holders, {I('sum(cents)')} AS held FROM (SELECT cents, {_BUCKET.format(c='cents')} AS bucket FROM holder) h GROUP BY bucket", "M27: below each power of ten from 1e1 to 1e9, and beyond.")
metric("active_holders_distribution", "tx holder", f"SELECT bucket, count(DISTINCT address) AS holders FROM (SELECT h.address, {_BUCKET.format(c='h.cents')} AS bucket FROM tx x JOIN holder h ON x.sender = h.address) a GROUP BY bucket", "M27: only holders that moved.")
_EXCHANGE = "label = 'BUILDING'"
metric("deposits_activity", "tx holder", f"SELECT {{day(x.t)}} AS day, count(*) AS deposits, count(DISTINCT x.sender) AS depositors, {I('sum(x.cents)')} AS volume FROM tx x JOIN holder r ON x.receiver = r.address AND r.{_EXCHANGE} GROUP BY {{day(x.t)}}", "M31.")
metric("withdrawals_activity", "tx holder", f"SELECT {{day(x.t)}} AS day, count(*) AS withdrawals, count(DISTINCT x.receiver) AS receivers, {I('sum(x.cents)')} AS volume FROM tx x JOIN holder s ON x.sender = s.address AND s.{_EXCHANGE} GROUP BY {{day(x.t)}}", "M31.")
metric("labelled_composite", "tx holder", f"SELECT day, {I('sum(CASE WHEN label IN ' + '(' + chr(39) + 'BUILDING' + chr(39) + ', ' + chr(39) + 'MACHINERY' + chr(39) + ')' + ' THEN delta ELSE 0 END) - sum(CASE WHEN label = ' + chr(39) + 'HOUSEHOLD' + chr(39) + ' THEN delta ELSE 0 END)')} AS composite FROM (SELECT h.label, {{day(x.t)}} AS day, sum(x.amount) AS delta FROM (SELECT sender AS address, t, -cents AS amount FROM tx UNION ALL SELECT receiver, t, cents FROM tx) x JOIN holder h ON x.address = h.address GROUP BY h.label, {{day(x.t)}}) d GROUP BY day", "M32: balances of some labels less that of another.")
metric("dex_by_token", "ev", f"SELECT kind, address % 5 AS token, {{day(t)}} AS day, {I('sum(cents)')} AS volume, count(*) AS amount, round(CAST(sum(cents) AS DOUBLE) / count(*), 4) AS price FROM ev GROUP BY kind, address % 5, {{day(t)}}", "M37: volume, number and mean price by venue and token; keys modulo five stand for tokens.")
metric("gas_used", "tx", f"SELECT day, gas, {I('sum(gas) ' + PREFIX)} AS total_gas FROM (SELECT {{day(t)}} AS day, {I('sum(21000 + tx % 1000)')} AS gas FROM tx GROUP BY {{day(t)}}) d", "M38: by day and in total; an order's gas is ours.")
metric("staking_withdrawals", "ev", f"SELECT {{day(t)}} AS day, {I('sum(CASE WHEN kind = ' + chr(39) + 'signup' + chr(39) + ' THEN cents ELSE 0 END)')} AS deposits, {I('sum(CASE WHEN kind = ' + chr(39) + 'purchase' + chr(39) + ' THEN cents ELSE 0 END)')} AS withdrawals FROM ev GROUP BY {{day(t)}}", "M39: two kinds of events stand for deposits and withdrawals.")
metric("valid_points", "price", f"SELECT t, price FROM price WHERE price < 1000000 AND t % 600000000 = 0", "P8: points of one source (every other five minutes) below a bound.")
metric("finite_only", "ch", f"SELECT day, round(x, 6) AS x FROM (SELECT day, CASE WHEN day % 5 = 0 THEN CAST('NaN' AS DOUBLE) WHEN day % 7 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(v AS DOUBLE) / n END AS x FROM (SELECT {{day(t)}} AS day, sum(amount) AS v, count(*) AS n FROM ch GROUP BY {{day(t)}}) d) y WHERE NOT isnan(x) AND abs(x) < 1e300", "P9: rows of a composite that are no finite number drop out.")
metric("daily_market", "price tx balance", f"SELECT p.day, p.price AS close, {I('s.supply * p.price')} AS marketcap, {I('coalesce(v.volume, 0)')} AS volume FROM ({_LAST}) p JOIN ({_SUPPLY}) s ON s.day = p.day LEFT JOIN (SELECT {{day(t)}} AS day, sum(cents) AS volume FROM tx GROUP BY {{day(t)}}) v ON v.day = p.day", "M34: market value and volume beside the day's price.")
metric("dex_volume", "ev", f"SELECT kind, {{day(t)}} AS day, {I('sum(cents)')} AS volume, count(*) AS trades, round(CAST(sum(cents * cents) AS DOUBLE) / nullif(sum(cents), 0), 4) AS vwap FROM ev GROUP BY kind, {{day(t)}}", "M37: by venue; weighting a price by its own volume is ours.")
metric("gas_fees", "ev", f"SELECT {{day(t)}} AS day, {I('sum(cents)')} AS fees, {I('sum(CASE WHEN kind = ' + chr(39) + 'error' + chr(39) + ' THEN cents ELSE 0 END)')} AS burnt FROM ev GROUP BY {{day(t)}}", "M38.")
metric("staking", "ev", f"SELECT {{day(t)}} AS day, count(DISTINCT address) AS stakers, {I('sum(cents)')} AS deposits FROM ev WHERE kind = 'signup' GROUP BY {{day(t)}}", "M39.")
metric("daa_divergence", "ch price", f"SELECT a.day, round(CAST(a.active AS DOUBLE) / first_value(a.active) OVER (ORDER BY a.day RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - CAST(p.price AS DOUBLE) / first_value(p.price) OVER (ORDER BY a.day RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 6) AS divergence FROM (SELECT {{day(t)}} AS day, count(DISTINCT address) AS active FROM ch GROUP BY {{day(t)}}) a JOIN ({_LAST}) p ON a.day = p.day", "M42: growth of addresses less growth of price; the formula is ours.")

# ---------------------------------------------------------------- prices

_GRID = "SELECT {day(t)} AS day, t, price FROM price"
metric("price_resample", "ev", f"SELECT {{five(t)}} AS bucket, {I('floor(sum(cents) / count(*))')} AS mean, {I('min(cents)')} AS low, {I('max(cents)')} AS high, count(*) AS ticks FROM ev WHERE kind = 'click' GROUP BY {{five(t)}}", "M33.")
metric("price_ohlc", "price", f"SELECT day, max(CASE WHEN up = 1 THEN price END) AS open, max(price) AS high, min(price) AS low, max(CASE WHEN down = 1 THEN price END) AS close, round(avg(price), 4) AS mean FROM (SELECT day, price, row_number() OVER (PARTITION BY day ORDER BY t) AS up, row_number() OVER (PARTITION BY day ORDER BY t DESC) AS down FROM ({_GRID}) g) x GROUP BY day", "M34.")
_CLOSE = f"SELECT day, max(CASE WHEN down = 1 THEN price END) AS price FROM (SELECT day, price, row_number() OVER (PARTITION BY day ORDER BY t DESC) AS down FROM ({_GRID}) g) x GROUP BY day"
metric("volatility", "price", f"SELECT day, round(stddev_samp(r) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS volatility FROM (SELECT day, ln(CAST(price AS DOUBLE) / lag(price) OVER (ORDER BY day)) AS r FROM ({_CLOSE}) c) x", "W11, M41: sample deviation of seven log returns; the formula is ours.")
metric("rsi", "price", f"SELECT day, round(100 - 100 / (1 + CAST(up AS DOUBLE) / nullif(down, 0)), 6) AS rsi FROM (SELECT day, sum(greatest(d, 0)) OVER (ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS up, sum(greatest(-d, 0)) OVER (ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS down FROM (SELECT day, price - lag(price) OVER (ORDER BY day) AS d FROM ({_CLOSE}) c) y) x", "W11, M41: fourteen days by plain sums; the variant is ours.")
metric("price_in_other", "cprice", "SELECT a.contract, a.day, round(CAST(a.price AS DOUBLE) / b.price, 6) AS ratio FROM (SELECT contract, {day(t)} AS day, max_by(price, t) AS price FROM cprice GROUP BY contract, {day(t)}) a JOIN (SELECT {day(t)} AS day, max_by(price, t) AS price FROM cprice WHERE contract = 0 GROUP BY {day(t)}) b ON a.day = b.day", "M33: closing prices of each asset in terms of the first.")

# ---------------------------------------------------------------- composites and cumulative series

metric("composite_formula", "ch", f"SELECT day, round(CAST(inflow AS DOUBLE) / nullif(active, 0), 6) AS per_head FROM (SELECT day, max(CASE WHEN name = 'inflow' THEN v END) AS inflow, max(CASE WHEN name = 'active' THEN v END) AS active FROM (SELECT {{day(t)}} AS day, 'inflow' AS name, {I('sum(CASE WHEN amount > 0 THEN amount ELSE 0 END)')} AS v FROM ch GROUP BY {{day(t)}} UNION ALL SELECT {{day(t)}}, 'active', count(DISTINCT address) FROM ch GROUP BY {{day(t)}}) p GROUP BY day) w WHERE active <> 0", "M35, P9: a formula over metrics aligned by day.")
metric("cumulative_sequenced", "ch", f"SELECT day, {I('seed + sum(d) ' + PREFIX)} AS total FROM (SELECT day, d, (SELECT sum(amount) FROM ch WHERE {{day(t)}} < 19730) AS seed FROM (SELECT {{day(t)}} AS day, sum(amount) AS d FROM ch GROUP BY {{day(t)}}) a WHERE day >= 19730) x", "M36: resumed from what is stored before a cursor.")
metric("age_predicate", "seam", f"SELECT count(*) AS n, {I('sum(measure)')} AS measure FROM seam WHERE odt <> 0 AND t - odt < {7 * DAY_US}", "P4.")
metric("bucket_alignment", "seam", "SELECT count(*) AS n, sum(CASE WHEN odt <> 0 AND odt % 3600000000 <> 0 THEN 1 ELSE 0 END) AS off_grid FROM seam".replace("sum(CASE", "CAST(sum(CASE").replace("END) AS off", "END) AS BIGINT) AS off"), "P10, R8: origins off the hourly grid, the sentinel exempt.")


@query("rate_over_range", f"WITH ev AS ({RAW_SQL['ev']}) SELECT bucket, d, round((sum(d) OVER (ORDER BY bucket RANGE BETWEEN 71 PRECEDING AND CURRENT ROW))::DOUBLE / 21600, 6) AS rate FROM (SELECT t // 300000000 AS bucket, sum(cents)::BIGINT AS d FROM ev GROUP BY 1) x")
def rate_over_range(spark, sf_dir):
    """The increase of a counter over six hours by second, by slices of six hours."""
    ev = RAW["ev"](spark, sf_dir).groupBy(F.expr("t div 300000000").alias("bucket")).agg(F.sum("cents").alias("d"))
    return rows.over_range(ev, "bucket", 72, {"sum": F.sum("d")}).select("bucket", "d", F.round(F.col("sum").cast("double") / 21600, 6).alias("rate"))


@query("min_over_range", with_prelude("SELECT t, min(price) OVER (ORDER BY t RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS low FROM price", "price"))
def min_over_range(spark, sf_dir):
    """Lowest of the last six hours, by slices of six hours."""
    return rows.over_range(SOURCES["price"](spark, sf_dir), "t", 21_600_000_000, {"low": F.min("price")}).select("t", "low")


@query("range_by_asset", with_prelude("SELECT contract, t, min(price) OVER w AS low, max(price) OVER w AS high, count(*) OVER w AS n FROM cprice WINDOW w AS (PARTITION BY contract ORDER BY t RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)", "cprice"))
def range_by_asset(spark, sf_dir):
    """Lowest and highest price of the last day by asset."""
    return rows.over_range(SOURCES["cprice"](spark, sf_dir), "t", DAY_US, {"low": F.min("price"), "high": F.max("price"), "n": F.count("*")}, ["contract"]).select("contract", "t", "low", "high", "n")
