"""Queries that compare two runs, and windows over daily series."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.functions.session import scratch_tables, table
from strataq.functions.time import HOUR, day_number, floor_to, micros
from strataq.operators import fold, reconcile, rows
from strataq.plans import base
from strataq.plans.base import with_prelude
from strataq.plans.registry import query

#: Two runs of one daily series: the second lost the open orders and has five days more.
RUNS = """prod AS (SELECT o_orderpriority AS name, CAST(floor(epoch_us(o_orderdate) / 86400000000) AS BIGINT) AS day, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS value FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1, 2),
expr AS (SELECT o_orderpriority AS name, CAST(floor(epoch_us(o_orderdate) / 86400000000) AS BIGINT) AS day, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS value FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0 GROUP BY 1, 2)"""


def _runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("name"), day_number(micros("o_orderdate")).alias("day"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    daily = lambda d: d.groupBy("name", "day").agg(F.sum("c").alias("value"))
    return daily(o.where("o_orderkey % 11 <> 0")), daily(o.where("o_orderstatus <> 'P' or o_orderkey % 2 = 0"))


#: One daily series of all orders.
DAILY = "prod AS (SELECT o_orderpriority AS name, CAST(floor(epoch_us(o_orderdate) / 86400000000) AS BIGINT) AS day, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS value FROM orders GROUP BY 1, 2)"


def _daily(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), day_number(micros("o_orderdate")).alias("day"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    return o.groupBy("name", "day").agg(F.sum("c").alias("value"))


_PAIR = f"{RUNS}, j AS (SELECT name, day, prod.value AS p, expr.value AS e FROM prod FULL JOIN expr USING (name, day)), r AS (SELECT *, CASE WHEN p IS NOT NULL AND e IS NOT NULL THEN abs(p - e) / greatest((abs(p) + abs(e)) / 2.0::DOUBLE, 1e-12::DOUBLE) END AS rel FROM j)"
_REPORT = """rep AS (SELECT name, count(*) FILTER (WHERE p IS NOT NULL AND e IS NOT NULL) AS both, count(*) FILTER (WHERE e IS NULL) AS prod_only, count(*) FILTER (WHERE p IS NULL) AS exp_only,
  max(CASE WHEN p IS NOT NULL AND e IS NOT NULL THEN abs(p - e) END) AS max_abs, round(max(rel), 9) AS max_rel, round(avg(rel), 9) AS mean_rel, round(quantile_cont(rel, 0.5), 9) AS p50_rel, round(quantile_cont(rel, 0.99), 9) AS p99_rel,
  min(CASE WHEN rel > 1e-9 THEN day END) AS first_divergence, sum(p)::BIGINT AS sum_prod, sum(e)::BIGINT AS sum_exp, round(CASE WHEN sum(p) <> 0 THEN sum(e)::DOUBLE / sum(p) END, 9) AS sum_ratio FROM r GROUP BY name)"""


@query("compare_full_outer", f"WITH {_PAIR}, {_REPORT} SELECT * FROM rep")
def compare_full(spark, sf_dir):
    """The comparison report by metric."""
    return reconcile.compare(*_runs(spark, sf_dir), "name", "day", "value")


def _verdict_sql(stat: str) -> str:
    return f"""WITH {_PAIR}, {_REPORT} SELECT name, CASE WHEN "both" = 0 AND exp_only > 0 THEN 'EXP-ONLY' WHEN "both" = 0 THEN 'no-overlap' WHEN {stat} IS NULL OR {stat} <= 1e-9 THEN 'MATCH' WHEN {stat} <= 0.05 THEN 'minor-drift' ELSE 'DIVERGE' END AS verdict FROM rep"""


@query("verdict_mean", _verdict_sql("mean_rel"))
def verdict_mean(spark, sf_dir):
    """Verdict by the mean."""
    return reconcile.compare(*_runs(spark, sf_dir), "name", "day", "value").select("name", reconcile.verdict("mean_rel").alias("verdict"))


@query("verdict_median", _verdict_sql("p50_rel"))
def verdict_median(spark, sf_dir):
    """Verdict by the median."""
    return reconcile.compare(*_runs(spark, sf_dir), "name", "day", "value").select("name", reconcile.verdict("p50_rel").alias("verdict"))


_DISJOINT = f"""{RUNS}, a AS (SELECT * FROM prod WHERE name <> '1-URGENT' AND (name <> '2-HIGH' OR day % 2 = 0) AND name <> '3-MEDIUM'),
b AS (SELECT * FROM prod WHERE (name <> '2-HIGH' OR day % 2 = 1) AND name <> '5-LOW' AND name <> '3-MEDIUM' UNION ALL SELECT name, day, value + value % 3 FROM prod WHERE name = '3-MEDIUM'),
c AS (SELECT name, count(*) FILTER (WHERE a.value IS NOT NULL AND b.value IS NOT NULL) AS n, count(*) FILTER (WHERE a.value IS NULL) AS exp_only FROM a FULL JOIN b USING (name, day) GROUP BY name)
SELECT name, CASE WHEN n = 0 AND exp_only > 0 THEN 'EXP-ONLY' WHEN n = 0 THEN 'no-overlap' ELSE 'MATCH' END AS verdict FROM c"""


@query("verdict_disjoint", f"WITH {_DISJOINT}")
def verdict_disjoint(spark, sf_dir):
    """Runs that share no days of some metrics, or have no metric of the other's."""
    p, _ = _runs(spark, sf_dir)
    half = lambda k: (F.col("name") != "2-HIGH") | (F.col("day") % 2 == k)
    rest = F.col("name") != "3-MEDIUM"
    a = p.where((F.col("name") != "1-URGENT") & half(0) & rest)
    b = p.where(half(1) & (F.col("name") != "5-LOW") & rest).unionByName(p.where(~rest).withColumn("value", F.col("value") + F.col("value") % 3))
    return reconcile.compare(a, b, "name", "day", "value").select("name", reconcile.verdict("mean_rel").alias("verdict"))


#: What the second of two seams has: no liabilities, nothing from 2024-01-28 on, and what is older than five days an hour off.
_OTHER = "SELECT t, CASE WHEN t - odt > 432000000000 THEN odt + 3600000000 ELSE odt END AS odt, measure FROM seam WHERE odt <> 0 AND t < 1706400000000000"


def _other(s):
    old = F.when(F.col("t") - F.col("odt") > 432_000_000_000, F.col("odt") + HOUR).otherwise(F.col("odt"))
    return s.where("odt <> 0 and t < 1706400000000000").select("t", old.alias("odt"), "measure")


@query(
    "compare_hour_rolled",
    with_prelude(
        """, exact AS (SELECT t - t % 3600000000 AS t, odt - odt % 3600000000 AS odt, sum(measure)::BIGINT AS v FROM seam GROUP BY 1, 2),
        rolled AS (SELECT t - t % 3600000000 AS t, odt - odt % 3600000000 AS odt, sum(measure)::BIGINT AS v FROM (""" + _OTHER + """) GROUP BY 1, 2)
        SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(a.v, 0) <> coalesce(b.v, 0)) AS off, sum(abs(coalesce(a.v, 0) - coalesce(b.v, 0)))::BIGINT AS total FROM exact a FULL JOIN rolled b ON a.t = b.t AND a.odt = b.odt""",
        "seam",
    ),
)
def hour_rolled(spark, sf_dir):
    """The seam rolled to hours on both axes against another run, absent taken for 0."""
    s = base.SOURCES["seam"](spark, sf_dir)
    roll = lambda d: d.groupBy(floor_to("t", HOUR).alias("t"), floor_to("odt", HOUR).alias("odt")).agg(F.sum("measure").alias("v"))
    d = reconcile.paired(roll(s), roll(_other(s)), ["t", "odt"], "v").select(F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("e", F.lit(0)).alias("e"))
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("p") != F.col("e")).alias("off"), F.sum(F.abs(F.col("p") - F.col("e"))).alias("total"))


@query("l1_universe", "SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS a, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_linestatus = 'O') AS b, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS keys")
def universe(spark, sf_dir):
    """Distinct keys of two sides."""
    l = table(spark, sf_dir, "lineitem")
    return l.agg(
        F.countDistinct("l_orderkey").alias("a"), F.countDistinct(F.when(F.col("l_linestatus") == "O", F.col("l_orderkey"))).alias("b"), F.countDistinct("l_orderkey", "l_linenumber").alias("keys")
    )


@query(
    "l1_collisions",
    "SELECT count(*) FILTER (WHERE spread > 0) AS colliding, max(spread)::BIGINT AS worst, max(n) AS copies FROM (SELECT l_orderkey, l_linenumber, max(round(l_quantity * 100)::BIGINT) - min(round(l_quantity * 100)::BIGINT) AS spread, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)",
)
def collisions(spark, sf_dir):
    """Keys whose rows don't agree."""
    q = F.round(F.col("l_quantity") * 100).cast("long")
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.max(q) - F.min(q)).alias("spread"), F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count_if(F.col("spread") > 0).alias("colliding"), F.max("spread").alias("worst"), F.max("n").alias("copies"))


@query(
    "l1_conservation",
    with_prelude(
        """, l AS (SELECT address, sum(sign * amount)::BIGINT AS net, sum(abs(amount))::BIGINT AS gross FROM ledger GROUP BY address), b AS (SELECT address, sum(amount)::BIGINT AS balance FROM ch GROUP BY address)
        SELECT address, net, balance, gross, abs(net - balance) > 1e-9::DOUBLE * gross + 1e-6::DOUBLE AS broken FROM l FULL JOIN b USING (address)""",
        "ledger",
    ),
)
def conservation(spark, sf_dir):
    """The ledger's net is the balance, within the amended tolerance."""
    ch = base.changes(spark, sf_dir)
    net = fold.lifo_ledger(ch).groupBy("address").agg(F.sum(F.col("sign") * F.col("amount")).alias("net"), F.sum(F.abs("amount")).alias("gross"))
    bal = ch.groupBy("address").agg(F.sum("amount").alias("balance"))
    return net.join(bal, "address", "full").select("address", "net", "balance", "gross", (F.abs(F.col("net") - F.col("balance")) > 1e-9 * F.col("gross") + 1e-6).alias("broken"))


@query(
    "l1_seam_union_diff",
    with_prelude(
        """, d AS (SELECT t, odt - odt % 3600000000 AS odt, measure AS d, abs(measure) AS g FROM seam UNION ALL SELECT t, odt - odt % 3600000000, -measure, abs(measure) FROM (""" + _OTHER + """))
        SELECT odt, sum(d)::BIGINT AS difference, sum(g)::BIGINT AS gross, abs(sum(d)) > 1e-9::DOUBLE * sum(g) + 0.01::DOUBLE AS broken FROM d GROUP BY odt HAVING sum(d) <> 0""",
        "seam",
    ),
)
def union_diff(spark, sf_dir):
    """Two seams compared by a signed union, without a join."""
    s = base.SOURCES["seam"](spark, sf_dir).withColumn("odt", floor_to("odt", HOUR))
    other = _other(base.SOURCES["seam"](spark, sf_dir)).withColumn("odt", floor_to("odt", HOUR))
    d = reconcile.union_difference(s, other, ["odt"], "measure").where("difference <> 0")
    return d.withColumn("broken", F.abs("difference") > 1e-9 * F.col("gross") + 0.01)


@query("l1_reduction", with_prelude("SELECT (SELECT count(*) FROM seam) AS fine, (SELECT count(*) FROM (SELECT DISTINCT t, odt - odt % 3600000000 FROM seam)) AS coarse", "seam"))
def reduction(spark, sf_dir):
    """Rows before and after rolling origins up."""
    s = base.SOURCES["seam"](spark, sf_dir)
    return s.agg(F.count("*").alias("fine"), F.countDistinct("t", floor_to("odt", HOUR)).alias("coarse"))


@query("yearly_signature", f"WITH {DAILY} SELECT name, year(DATE '1970-01-01' + day::INT)::INT AS span, count(*) AS n, sum(value)::BIGINT AS total, arg_min(value, day) AS first, arg_max(value, day) AS last FROM prod GROUP BY 1, 2")
def signature(spark, sf_dir):
    """The record that later runs are held against."""
    p = _daily(spark, sf_dir)
    return reconcile.signature(p.withColumn("span", _year()), ["name", "span"], "day", "value")


def _year():
    return F.year(F.date_from_unix_date(F.col("day").cast("int")))


#: A metric's own tolerance in place of the common one.
RTOLS = {"1-URGENT": 0.5, "2-HIGH": 0.05}


@query(
    "signature_check",
    f"""WITH {RUNS}, old AS (SELECT name, year(DATE '1970-01-01' + day::INT)::INT AS span, count(*) AS n, sum(value)::BIGINT AS total, arg_min(value, day) AS first, arg_max(value, day) AS last FROM prod WHERE name <> '5-LOW' GROUP BY 1, 2),
    new AS (SELECT name, year(DATE '1970-01-01' + day::INT)::INT AS span, count(*) AS n, sum(value)::BIGINT AS total, arg_min(value, day) AS first, arg_max(value, day) AS last FROM expr WHERE name <> '4-NOT SPECIFIED' GROUP BY 1, 2),
    j AS (SELECT name, span, old.n AS recorded, new.n AS found, CASE name WHEN '1-URGENT' THEN 0.5::DOUBLE WHEN '2-HIGH' THEN 0.05::DOUBLE ELSE 1e-6::DOUBLE END AS rtol,
      abs(old.total - new.total) AS dt, greatest(abs(old.total), abs(new.total)) AS gt, abs(old.first - new.first) AS df, greatest(abs(old.first), abs(new.first)) AS gf, abs(old.last - new.last) AS dl, greatest(abs(old.last), abs(new.last)) AS gl
      FROM old FULL JOIN new USING (name, span))
    SELECT name, span, recorded, found, CASE WHEN found IS NULL THEN 'missing' WHEN recorded IS NULL THEN 'new'
      WHEN recorded = found AND dt <= greatest(rtol * gt, 1e-9::DOUBLE) AND df <= greatest(rtol * gf, 1e-9::DOUBLE) AND dl <= greatest(rtol * gl, 1e-9::DOUBLE) THEN 'ok' ELSE 'off' END AS state FROM j""",
)
def signature_check(spark, sf_dir):
    """A run against the recorded signature of an earlier one, with a tolerance by metric; missing and new groups told apart."""
    p, e = _runs(spark, sf_dir)
    old = reconcile.signature(p.where("name <> '5-LOW'").withColumn("span", _year()), ["name", "span"], "day", "value")
    own = F.when(F.col("name") == "1-URGENT", RTOLS["1-URGENT"]).when(F.col("name") == "2-HIGH", RTOLS["2-HIGH"])
    new = e.where("name <> '4-NOT SPECIFIED'").withColumn("span", _year())
    return reconcile.check_signature(new, old.withColumn("rtol", own), ["name", "span"], "day", "value")


@query("baseline_check", f"WITH {_PAIR} SELECT name, day, CASE WHEN e IS NULL THEN 'missing' WHEN p IS NULL THEN 'new' WHEN abs(p - e) <= 0.05::DOUBLE * greatest(abs(p), abs(e)) + 1e-9::DOUBLE THEN 'close' ELSE 'off' END AS state FROM r")
def baseline(spark, sf_dir):
    """Relative and absolute tolerance, missing points told apart."""
    d = reconcile.paired(*_runs(spark, sf_dir), ["name", "day"], "value")
    close = F.abs(F.col("p") - F.col("e")) <= 0.05 * F.greatest(F.abs("p"), F.abs("e")) + 1e-9
    return d.select("name", "day", F.when(F.col("e").isNull(), "missing").when(F.col("p").isNull(), "new").when(close, "close").otherwise("off").alias("state"))


@query("drift_tiers", f"WITH {_PAIR} SELECT CASE WHEN rel < 1e-9 THEN 'exact' WHEN rel < 1e-4 THEN 'float-noise' WHEN rel <= 1e-2 THEN 'moderate' ELSE 'real' END AS tier, count(*) AS n FROM r WHERE rel IS NOT NULL GROUP BY 1")
def tiers(spark, sf_dir):
    """R14."""
    d = reconcile.paired(*_runs(spark, sf_dir), ["name", "day"], "value").where("p is not null and e is not null")
    return d.groupBy(reconcile.tier(reconcile.relative_difference(F.col("p"), F.col("e"))).alias("tier")).agg(F.count("*").alias("n"))


_MONTH = "(year(DATE '1970-01-01' + day::INT) * 12 + month(DATE '1970-01-01' + day::INT) - 1)::BIGINT"


@query("monthly_coverage", f"WITH {DAILY}, c AS (SELECT name, {_MONTH} AS m, count(*) AS n FROM prod GROUP BY 1, 2), g AS (SELECT name, unnest(range(lo, hi + 1)) AS m FROM (SELECT name, min(m) AS lo, max(m) AS hi FROM c GROUP BY name)) SELECT g.name, g.m, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON g.name = c.name AND g.m = c.m")
def coverage(spark, sf_dir):
    """Points by calendar month (12 times the year, plus the month from 0), months without any shown as 0."""
    day = F.date_from_unix_date(F.col("day").cast("int"))
    p = _daily(spark, sf_dir).withColumn("m", (F.year(day) * 12 + F.month(day) - 1).cast("long"))
    c = p.groupBy("name", "m").agg(F.count("*").alias("n"))
    g = c.groupBy("name").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).select("name", F.explode(F.sequence("lo", "hi")).alias("m"))
    return g.join(c, ["name", "m"], "left").select("name", "m", F.coalesce("n", F.lit(0)).alias("n"))


@query("rebucket_levels", with_prelude("SELECT (SELECT sum(v) FROM (SELECT CAST(floor(t / 300000000) AS BIGINT) AS b, sum(amount) AS v FROM ch GROUP BY 1))::BIGINT AS five_minutes, (SELECT sum(v) FROM (SELECT CAST(floor(t / 86400000000) AS BIGINT) AS b, sum(amount) AS v FROM ch GROUP BY 1))::BIGINT AS daily, (SELECT sum(v) FROM (SELECT CAST(floor(t / 604800000000) AS BIGINT) AS b, sum(amount) AS v FROM ch GROUP BY 1))::BIGINT AS weekly", "ch"))
def rebucket(spark, sf_dir):
    """Sums at three levels of aggregation agree."""
    ch = base.changes(spark, sf_dir)
    five = ch.groupBy(F.floor(F.col("t") / 300_000_000).alias("b")).agg(F.sum("amount").alias("v"))
    day = five.groupBy(F.floor(F.col("b") / 288).alias("d")).agg(F.sum("v").alias("v"))
    week = day.groupBy(F.floor(F.col("d") / 7).alias("w")).agg(F.sum("v").alias("v"))
    each = [d.select(F.lit(c).alias("level"), "v") for d, c in ((five, "five_minutes"), (day, "daily"), (week, "weekly"))]
    at = lambda c: F.sum(F.when(F.col("level") == c, F.col("v"))).alias(c)
    return each[0].union(each[1]).union(each[2]).agg(at("five_minutes"), at("daily"), at("weekly"))


@query("gap_fill_locf", f"WITH {DAILY}, s AS (SELECT name, unnest(range(lo, (SELECT max(day) FROM prod) + 1)) AS day FROM (SELECT name, min(day) AS lo FROM prod GROUP BY name)) SELECT s.name, s.day, last_value(p.value IGNORE NULLS) OVER (PARTITION BY s.name ORDER BY s.day ROWS UNBOUNDED PRECEDING) AS value FROM s LEFT JOIN prod p ON s.name = p.name AND s.day = p.day")
def gap_fill(spark, sf_dir):
    """Missing days hold the last known value."""
    p = _daily(spark, sf_dir)
    return rows.fill_forward(rows.dense_days(p, "name"), "name", "day", "value").select("name", "day", "value")


@query("zero_fill_cross", f"WITH {DAILY}, s AS (SELECT name, unnest(range(lo, (SELECT max(day) FROM prod) + 1)) AS day FROM (SELECT name, min(day) AS lo FROM prod GROUP BY name)) SELECT s.name, s.day, coalesce(p.value, 0) AS value FROM s LEFT JOIN prod p ON s.name = p.name AND s.day = p.day")
def zero_fill(spark, sf_dir):
    """J16."""
    p = _daily(spark, sf_dir)
    return rows.dense_days(p, "name").select("name", "day", F.coalesce("value", F.lit(0)).alias("value"))


@query("change_over_days", f"WITH {DAILY}, g AS (SELECT * FROM prod) SELECT g.name, g.day, g.value - a.value AS d1, g.value - b.value AS d7, g.value - c.value AS d30 FROM g LEFT JOIN g a ON a.name = g.name AND a.day = g.day - 1 LEFT JOIN g b ON b.name = g.name AND b.day = g.day - 7 LEFT JOIN g c ON c.name = g.name AND c.day = g.day - 30")
def change_over(spark, sf_dir):
    """Change over so many days."""
    return rows.change_over_days(_daily(spark, sf_dir), "name", "day", "value", (1, 7, 30))


@query("cumulative_from_genesis", f"WITH {DAILY} SELECT name, day, (sum(value) OVER (PARTITION BY name ORDER BY day ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM prod")
def cumulative(spark, sf_dir):
    """W1."""
    p = _daily(spark, sf_dir)
    return p.select("name", "day", F.sum("value").over(W.partitionBy("name").orderBy("day").rowsBetween(W.unboundedPreceding, 0)).alias("total"))


@query("top_movers", f"WITH {_PAIR} SELECT name, day, p, e FROM r WHERE p IS NOT NULL AND e IS NOT NULL ORDER BY abs(p - e) DESC, name, day LIMIT 12")
def top_movers(spark, sf_dir):
    """O2, O3: the largest differences, a top-k report."""
    d = reconcile.paired(*_runs(spark, sf_dir), ["name", "day"], "value").where("p is not null and e is not null")
    return d.orderBy(F.abs(F.col("p") - F.col("e")).desc(), "name", "day").limit(12)


@query("null_safe_join", "SELECT count(*) AS n, count(a.o_custkey) AS with_key FROM (SELECT CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders) a JOIN (SELECT DISTINCT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS k FROM customer) b ON a.o_custkey IS NOT DISTINCT FROM b.k")
def null_safe(spark, sf_dir):
    """J12."""
    a = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"))
    b = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("k")).distinct()
    a = a.groupBy("o_custkey").agg(F.count("*").alias("n"))  # the null key may hold many rows; they meet as one
    return a.join(b, a["o_custkey"].eqNullSafe(b["k"])).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("o_custkey").isNotNull(), F.col("n"))), F.lit(0)).alias("with_key"))


@query("metadata_names", "SELECT n_name AS name, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def metadata_names(spark, sf_dir):
    """Names by a small dimension; Spark broadcasts it while it is below its threshold."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n"))


@query(
    "block_digest",
    with_prelude(
        """SELECT CAST(floor(t / 86400000000) AS BIGINT) AS day, count(*) AS n, bit_xor(h)::BIGINT AS xor, sum(h)::HUGEINT::VARCHAR AS total
        FROM (SELECT t, ('0x' || substr(md5(address || ':' || event_id || ':' || t || ':' || amount), 1, 15))::BIGINT AS h FROM ch) GROUP BY 1""",
        "ch",
    ),
)
def block_digest(spark, sf_dir):
    """Count, xor and sum of row digests by day: two runs agree just if these do, whatever the order of rows."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "address", "event_id", "t", "amount")), 1, 15), 16, 10).cast("long")
    total = F.sum(h.cast("decimal(38,0)")).cast("string")
    return base.changes(spark, sf_dir).groupBy(day_number("t").alias("day")).agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), total.alias("total"))


@query(
    "scratch_tables",
    """WITH busy AS (SELECT o_custkey AS k, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT) AS v FROM orders GROUP BY 1), mean AS (SELECT c_nationkey, avg(n) AS mean FROM busy JOIN customer ON k = c_custkey GROUP BY 1)
    SELECT c_nationkey AS nation, count(*) AS above, sum(v)::BIGINT AS volume FROM busy JOIN customer ON k = c_custkey JOIN mean USING (c_nationkey) WHERE n > mean GROUP BY 1""",
)
def tables_of_a_session(spark, sf_dir):
    """Results kept as the session's own tables while later statements use them."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    busy = o.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("v"))
    tag = uuid.uuid4().hex
    with scratch_tables(spark, **{f"busy_{tag}": busy, f"customer_{tag}": c.select("c_custkey", "c_nationkey")}):
        mean = spark.sql(f"SELECT c_nationkey, avg(n) AS mean FROM busy_{tag} JOIN customer_{tag} ON k = c_custkey GROUP BY 1")
        with scratch_tables(spark, **{f"mean_{tag}": mean}):
            return spark.sql(f"SELECT c_nationkey AS nation, count(*) AS above, sum(v) AS volume FROM busy_{tag} JOIN customer_{tag} ON k = c_custkey JOIN mean_{tag} USING (c_nationkey) WHERE n > mean GROUP BY 1")
