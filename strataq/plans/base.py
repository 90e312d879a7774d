"""The ledgers and series that the registered queries start from, and their SQL twins.

Amounts and prices are integer cents and times are integer microseconds, so that results compare exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.functions.session import table
from strataq.functions.time import DAY, FIVE_MINUTES, day_number, floor_to, micros
from strataq.operators import asof, fold


def _sign() -> Column:
    """Purchases and errors flow out."""
    return F.when(F.col("event_type").isin("purchase", "error"), -1).otherwise(1)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed cents by user; purchases and errors flow out."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("address"), "event_id", micros("ts").alias("t"), (_sign() * F.round(F.col("value") * 100).cast("long")).alias("amount"))


def small_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small whole amounts by contract and address, a block a day; the kind of an event alone tells the sign, also where its value rounds to nothing."""
    e = table(spark, sf_dir, "events").withColumn("t", micros("ts"))
    return e.select((F.col("event_id") % 3).alias("contract"), F.col("user_id").alias("address"), "event_id", floor_to("t", DAY).alias("t"), (_sign() * (F.col("event_id") % 4)).alias("amount"))


def hot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes with every second one under one address, which so has half of all."""
    return changes(spark, sf_dir).withColumn("address", F.when(F.col("event_id") % 2 == 0, F.lit(-1)).otherwise(F.col("address")).cast("long"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, price): mean cents of the clicks of each five minutes."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select(micros("ts").alias("t"), F.round(F.col("value") * 100).cast("long").alias("c"))
    return e.groupBy(floor_to("t", FIVE_MINUTES).alias("t")).agg(F.floor(F.sum("c") / F.count("*")).cast("long").alias("price"))


def _priced(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rows`` (.., t, odt) with the price at origin and the price at the time, null where there is none yet."""
    p = prices(spark, sf_dir)
    for name, of in (("acq", "odt"), ("now", "t")):
        rows = asof.asof_backward(rows.withColumn("at", floor_to(of, FIVE_MINUTES)), p.select(F.col("t").alias("at"), F.col("price").alias(name)), "at", name).drop("at")
    return rows


def priced_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with acq and now."""
    return _priced(fold.lifo_ledger(changes(spark, sf_dir)), spark, sf_dir)


def priced_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each inflow still holds, with the price at its time."""
    p = prices(spark, sf_dir).select(F.col("t").alias("at"), F.col("price").alias("acq"))
    return asof.asof_backward(fold.survivors(changes(spark, sf_dir)).withColumn("at", floor_to("t", FIVE_MINUTES)), p, "at", "acq").drop("at")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day from the first change to the last."""
    d = changes(spark, sf_dir).agg(F.min(day_number("t")).alias("lo"), F.max(day_number("t")).alias("hi"))
    return d.select(F.explode(F.sequence("lo", "hi")).alias("day"))


def contract_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contract, day): every day for every contract."""
    return small_changes(spark, sf_dir).select("contract").distinct().crossJoin(F.broadcast(days(spark, sf_dir)))  # days are few


def contract_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contract, t, price): mean cents of a contract's clicks of each five minutes."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    p = e.select((F.col("event_id") % 3).alias("contract"), floor_to(micros("ts"), FIVE_MINUTES).alias("t"), F.round(F.col("value") * 100).cast("long").alias("c"))
    return p.groupBy("contract", "t").agg(F.floor(F.sum("c") / F.count("*")).cast("long").alias("price"))


def priced_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, odt, measure, acq, now): the seam with the price at origin and the price at the time, null where there is none yet."""
    return _priced(fold.seam(fold.lifo_ledger(changes(spark, sf_dir))), spark, sf_dir)


def contract_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contract, t, odt, measure, acq, now): the seam of each contract with its own price at origin and at the time, null where it has none yet."""
    p = contract_prices(spark, sf_dir)
    s = fold.seam(fold.lifo_ledger(small_changes(spark, sf_dir), ("contract", "address")), ["contract"])
    for name, of in (("acq", "odt"), ("now", "t")):
        s = asof.asof_backward(s.withColumn("at", floor_to(of, FIVE_MINUTES)), p.select("contract", F.col("t").alias("at"), F.col("price").alias(name)), "at", name, by=["contract"]).drop("at")
    return s


#: Source of a query -> DataFrame of it.
SOURCES = {
    "ch": changes,
    "price": prices,
    "ledger": lambda s, d: fold.lifo_ledger(changes(s, d)),
    "seam": lambda s, d: fold.seam(fold.lifo_ledger(changes(s, d))),
    "pseam": priced_seam,
    "survivors": lambda s, d: fold.survivors(changes(s, d)),
    "balance": lambda s, d: fold.balances(changes(s, d)),
    "cseam": contract_seam,
    "pledger": priced_ledger,
    "psurvivors": priced_survivors,
    "cprice": contract_prices,
    "days": days,
    "cdays": contract_days,
    "live": lambda s, d: fold.net_cohorts(fold.lifo_ledger(changes(s, d))),
}

CH = """ch AS (
  SELECT user_id AS address, event_id, epoch_us(ts) AS t,
         (CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END * round(value * 100)::BIGINT)::BIGINT AS amount FROM events
)"""
#: Small whole amounts by contract and address and a block a day, so that stacks empty often; the twin packs both keys into one.
CH_SMALL = """ch AS (
  SELECT user_id * 10 + event_id % 3 AS address, event_id, epoch_us(ts) - epoch_us(ts) % 86400000000 AS t,
         (CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END * (event_id % 4))::BIGINT AS amount FROM events
)"""
CH_HOT = CH.replace("user_id AS address", "CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END AS address")
BALANCE = """balance AS (
  SELECT address, event_id, t, amount, (sum(amount) OVER w)::BIGINT AS balance, (sum(amount) OVER w - amount)::BIGINT AS old_balance
  FROM ch WINDOW w AS (PARTITION BY address ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)
)"""
#: Pairs of an inflow and each later change, with the lowest balance between: what is held after and before it.
PAIRS = """pos AS (
  SELECT *, row_number() OVER (PARTITION BY address ORDER BY t, event_id) AS pos FROM balance
), path AS (
  SELECT i.address, i.pos AS coin, i.t AS odt, i.old_balance AS low, i.balance AS high, j.pos, j.event_id, j.t, j.amount, j.balance AS bal,
         min(j.balance) OVER (PARTITION BY i.address, i.pos ORDER BY j.pos ROWS UNBOUNDED PRECEDING) AS m
  FROM pos i JOIN pos j ON i.address = j.address AND j.pos >= i.pos WHERE i.amount >= 0
), held AS (
  SELECT *, greatest(least(m, high) - low, 0) AS rem, lag(m) OVER (PARTITION BY address, coin ORDER BY pos) AS pm FROM path
), touch AS (
  SELECT *, greatest(least(pm, high) - low, 0) AS prem FROM held
  WHERE pos > coin AND amount < 0 AND CASE WHEN high = low THEN pm >= low AND bal < low ELSE least(pm, high) > low AND bal < least(pm, high) END
), owe AS (
  SELECT *, lag(debt, 1, 0) OVER (PARTITION BY address ORDER BY pos) AS pdebt FROM (
    SELECT *, least(0, min(balance) OVER (PARTITION BY address ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS debt FROM pos)
), moves AS (
  SELECT address, coin, pos, event_id, t, 1 AS sign, odt, rem AS amount FROM held WHERE pos = coin
  UNION ALL SELECT address, coin, pos, event_id, t, -1, odt, prem FROM touch
  UNION ALL SELECT address, coin, pos, event_id, t, 1, odt, rem FROM touch WHERE rem > 0
  UNION ALL SELECT address, 0, pos, event_id, t, -1, 0, pdebt FROM owe WHERE debt <> pdebt AND pdebt < 0
  UNION ALL SELECT address, 0, pos, event_id, t, 1, 0, debt FROM owe WHERE debt <> pdebt
), sized AS (
  SELECT address, pos, t, sum(s) OVER (PARTITION BY address ORDER BY pos) AS size FROM (SELECT address, pos, t, sum(sign) AS s FROM moves GROUP BY address, pos, t)
), periods AS (
  SELECT address, pos, sum(CASE WHEN empty AND t <> before THEN 1 ELSE 0 END) OVER (PARTITION BY address ORDER BY pos) AS period FROM (
    SELECT *, lag(size) OVER w = 0 AS empty, lag(t) OVER w AS before FROM sized WINDOW w AS (PARTITION BY address ORDER BY pos))
), numbered AS (
  SELECT m.*, CASE WHEN sign = 1 THEN row_number() OVER (PARTITION BY address, period, sign ORDER BY pos) END AS own FROM moves m JOIN periods USING (address, pos)
), ledger AS (
  SELECT address, event_id, t, sign, coalesce(own, lag(own) OVER (PARTITION BY address, coin ORDER BY pos, sign))::BIGINT AS nonce, odt, amount::BIGINT AS amount FROM numbered
)"""
SEAM = "seam AS (SELECT t, odt, sum(sign * amount)::BIGINT AS measure FROM ledger GROUP BY t, odt HAVING sum(sign * amount) <> 0)"
PRICE = """price AS (
  SELECT t - t % 300000000 AS t, floor(sum(c) / count(*))::BIGINT AS price
  FROM (SELECT epoch_us(ts) AS t, round(value * 100)::BIGINT AS c FROM events WHERE event_type = 'click') GROUP BY 1
)"""
PSEAM = """pseam AS (
  SELECT s.t, s.odt, s.measure, a.price AS acq, n.price AS now
  FROM (SELECT *, odt - odt % 300000000 AS oat, t - t % 300000000 AS tat FROM seam) s
  ASOF LEFT JOIN price a ON s.oat >= a.t ASOF LEFT JOIN price n ON s.tat >= n.t
)"""
CPRICE = """cprice AS (
  SELECT contract, t - t % 300000000 AS t, floor(sum(c) / count(*))::BIGINT AS price FROM (SELECT event_id % 3 AS contract, epoch_us(ts) AS t, round(value * 100)::BIGINT AS c FROM events WHERE event_type = 'click') GROUP BY 1, 2
)"""
CSEAM = """cseam AS (
  SELECT s.contract, s.t, s.odt, s.measure, p.price AS acq, n.price AS now
  FROM (SELECT address % 10 AS contract, t, odt, odt - odt % 300000000 AS oat, t - t % 300000000 AS tat, sum(sign * amount)::BIGINT AS measure FROM ledger GROUP BY 1, 2, 3, 4, 5 HAVING sum(sign * amount) <> 0) s
  ASOF LEFT JOIN cprice p ON s.contract = p.contract AND s.oat >= p.t ASOF LEFT JOIN cprice n ON s.contract = n.contract AND s.tat >= n.t
)"""
#: ``eaten`` and ``held_days`` by contract, with its own prices.
CEATEN = """ceaten AS (
  SELECT e.*, a.price AS acq, n.price AS now, e.t // 86400000000 AS day
  FROM (SELECT address % 10 AS contract, t, odt, prem - rem AS amount, odt - odt % 300000000 AS oat, t - t % 300000000 AS tat FROM touch WHERE prem > rem) e
  ASOF LEFT JOIN cprice a ON e.contract = a.contract AND e.oat >= a.t ASOF LEFT JOIN cprice n ON e.contract = n.contract AND e.tat >= n.t
)"""
CHELD_DAYS = """by_day AS (
  SELECT address, coin, odt, t // 86400000000 AS day, min(rem) AS rem FROM held GROUP BY 1, 2, 3, 4
), coin_days AS (
  SELECT c.*, g.day FROM (SELECT DISTINCT address, coin, odt FROM held) c JOIN days g ON g.day >= c.odt // 86400000000
), cheld_days AS (
  SELECT c.contract, c.day, c.odt, h.rem, p.price AS acq
  FROM (SELECT c.*, c.address % 10 AS contract, odt - odt % 300000000 AS oat FROM coin_days c) c ASOF JOIN by_day h ON c.address = h.address AND c.coin = h.coin AND c.day >= h.day
  ASOF LEFT JOIN cprice p ON c.contract = p.contract AND c.oat >= p.t
)"""
LIVE = "live AS (SELECT address, odt, sum(sign * amount)::BIGINT AS amount FROM ledger GROUP BY address, odt HAVING sum(sign * amount) <> 0)"
SURVIVORS = """survivors AS (
  SELECT address, event_id, t, amount, greatest(least(low, balance) - old_balance, 0)::BIGINT AS held FROM (
    SELECT *, min(balance) OVER (PARTITION BY address ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM balance) WHERE amount >= 0
)"""
PLEDGER = """pledger AS (
  SELECT l.*, a.price AS acq, n.price AS now
  FROM (SELECT *, odt - odt % 300000000 AS oat, t - t % 300000000 AS tat FROM ledger) l
  ASOF LEFT JOIN price a ON l.oat >= a.t ASOF LEFT JOIN price n ON l.tat >= n.t
)"""
DAYS = """days AS (
  SELECT unnest(range(lo, hi + 1)) AS day FROM (SELECT min(CAST(floor(t / 86400000000) AS BIGINT)) AS lo, max(CAST(floor(t / 86400000000) AS BIGINT)) AS hi FROM ch)
)"""
#: What each outflow takes of each inflow, by the lowest balances, with both prices: other terms than the ledger's rows.
EATEN = """eaten AS (
  SELECT e.*, a.price AS acq, n.price AS now, CAST(floor(e.t / 86400000000) AS BIGINT) AS day
  FROM (SELECT address, t, odt, prem - rem AS amount, odt - odt % 300000000 AS oat, t - t % 300000000 AS tat FROM touch WHERE prem > rem) e
  ASOF LEFT JOIN price a ON e.oat >= a.t ASOF LEFT JOIN price n ON e.tat >= n.t
)"""
#: What each inflow holds at the end of each day from its own on, with the price at its origin.
HELD_DAYS = """by_day AS (
  SELECT address, coin, odt, CAST(floor(t / 86400000000) AS BIGINT) AS day, min(rem) AS rem FROM held GROUP BY 1, 2, 3, 4
), coin_days AS (
  SELECT c.*, g.day FROM (SELECT DISTINCT address, coin, odt FROM held) c JOIN days g ON g.day >= c.odt // 86400000000
), held_days AS (
  SELECT c.day, c.odt, h.rem, p.price AS acq
  FROM (SELECT c.*, odt - odt % 300000000 AS oat FROM coin_days c) c ASOF JOIN by_day h ON c.address = h.address AND c.coin = h.coin AND c.day >= h.day
  ASOF LEFT JOIN price p ON c.oat >= p.t
)"""
PSURVIVORS = "psurvivors AS (SELECT s.*, p.price AS acq FROM (SELECT *, t - t % 300000000 AS at FROM survivors) s ASOF LEFT JOIN price p ON s.at >= p.t)"
_LEDGER = [CH, BALANCE, PAIRS]
PRELUDES = {
    "small ledger": [CH_SMALL, BALANCE, PAIRS],
    "hot ledger": [CH_HOT, BALANCE, PAIRS],
    "cseam": [CH_SMALL, BALANCE, PAIRS, CPRICE, CSEAM],
    "cprice": [CPRICE],
    "cdays": [CH_SMALL, DAYS, "cdays AS (SELECT DISTINCT contract, day FROM days, (SELECT DISTINCT address % 10 AS contract FROM ch) c)"],
    "ceaten": [CH_SMALL, BALANCE, PAIRS, CPRICE, CEATEN],
    "cheld days": [CH_SMALL, BALANCE, PAIRS, CPRICE, DAYS, CHELD_DAYS],
    "days": [CH, DAYS],
    "psurvivors": [CH, BALANCE, SURVIVORS, PRICE, PSURVIVORS],
    "pledger": [*_LEDGER, PRICE, PLEDGER],
    "eaten": [*_LEDGER, PRICE, EATEN],
    "held days": [*_LEDGER, PRICE, DAYS, HELD_DAYS],
    "ch": [CH],
    "price": [PRICE],
    "balance": [CH, BALANCE],
    "survivors": [CH, BALANCE, SURVIVORS],
    "ledger": _LEDGER,
    "live": [*_LEDGER, LIVE],
    "seam": [*_LEDGER, SEAM],
    "pseam": [*_LEDGER, SEAM, PRICE, PSEAM],
}


def with_prelude(sql: str, *sources: str) -> str:
    """``sql`` behind the common table expressions of ``sources``, names or texts; it may begin with a comma and further ones."""
    parts = list(dict.fromkeys(p for s in sources for p in PRELUDES.get(s, [s])))
    sql = sql.strip()
    return f"WITH {', '.join(parts)}" + (sql if sql.startswith(",") else f" {sql}")
