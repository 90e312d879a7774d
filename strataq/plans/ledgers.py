"""Queries on folds, versions, joins and windows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.functions.session import scratch_folder, table, written
from strataq.functions.time import FIVE_MINUTES, HOUR, day_number, floor_to, micros
from strataq.operators import asof, fold, fold_table, hot_fold, kept, predicates, rows, stack
from strataq.plans import base
from strataq.plans.base import with_prelude
from strataq.plans.registry import query


@query("fold_lifo_ledger", with_prelude("SELECT address, event_id, t, sign, nonce, odt, amount FROM ledger", "ledger"))
def lifo_ledger(spark, sf_dir):
    """Every segment pushed and popped."""
    return fold.lifo_ledger(base.changes(spark, sf_dir))


@query("fold_table_function", with_prelude("SELECT address, event_id, t, sign, nonce, odt, amount FROM ledger", "ledger"))
def table_function(spark, sf_dir):
    """The same ledger by a table function over partitioned and ordered rows."""
    fold_table.register(spark)
    return spark.sql("SELECT * FROM lifo(TABLE(SELECT * FROM {changes}) PARTITION BY address ORDER BY (t, event_id))", changes=base.changes(spark, sf_dir))


@query("fold_hot_key", with_prelude("SELECT address, event_id, t, sign, nonce, odt, amount FROM ledger", "hot ledger"))
def hot_key(spark, sf_dir):
    """K1, F1: the exact ledger where one key has half of all changes; its slices are folded side by side."""
    return hot_fold.lifo_ledger_sliced(base.hot_changes(spark, sf_dir), slice_rows=2048)


_BOTH = "address % 10 AS contract, address // 10 AS address"


@query("fold_by_contract", with_prelude(f"SELECT {_BOTH}, event_id, t, sign, nonce, odt, amount FROM ledger", "small ledger"))
def by_contract(spark, sf_dir):
    """A state by contract and address; several changes in a block, zero amounts, numbers that begin anew when a block ends empty."""
    return fold.lifo_ledger(base.small_changes(spark, sf_dir), ("contract", "address"))


@query("seam_by_contract", with_prelude("SELECT address % 10 AS contract, t, odt, sum(sign * amount)::BIGINT AS measure FROM ledger GROUP BY 1, 2, 3 HAVING sum(sign * amount) <> 0", "small ledger"))
def seam_by_contract(spark, sf_dir):
    """A7 with an asset key."""
    return fold.seam(fold.lifo_ledger(base.small_changes(spark, sf_dir), ("contract", "address")), ["contract"])


@query("fold_bucketed", with_prelude("SELECT address, odt - odt % 259200000000 AS odt, sum(sign * amount)::BIGINT AS amount FROM ledger GROUP BY 1, 2 HAVING sum(sign * amount) <> 0", "ledger"))
def bucketed(spark, sf_dir):
    """inflows of one bucket of three days share a segment; what is held by bucket is what the ledger without buckets holds."""
    return fold.net_cohorts(fold.lifo_ledger(base.changes(spark, sf_dir), bucket=72 * HOUR))


@query("fold_resumed", with_prelude("SELECT address, event_id, t, sign, nonce, odt, amount FROM ledger WHERE t >= 1705276800000000", "ledger"))
def resumed(spark, sf_dir):
    """K2, K3, K8: state out of the ledger up to a day, the changes since then folded upon the tops of the stacks, deep ones again with all of them."""
    ch = base.changes(spark, sf_dir)
    state = fold.fold_state(fold.lifo_ledger(ch.where("t < 1705276800000000")))
    return fold.resume(fold.State(*map(written, state)), ch.where("t >= 1705276800000000"), top=4)



@query("fold_kept_batches", with_prelude("SELECT address, event_id, t, sign, nonce, odt, amount FROM ledger", "ledger"))
def kept_batches(spark, sf_dir):
    """The ledger carried on by ten days at a time over kept tables, one batch lost between writing and commit, a summary between."""
    ch, days = base.changes(spark, sf_dir), 240 * HOUR
    first = ch.agg(F.min(F.floor(F.col("t") / days)), F.max(F.floor(F.col("t") / days))).first()
    name = f"kept_{uuid.uuid4().hex}"
    with scratch_folder(spark, name) as folder:
        state = kept.Kept(spark, folder, name, buckets=8)
        try:
            for number, span in enumerate(range(first[0] or 0, (first[1] or 0) + 1)):
                batch = ch.where((F.col("t") >= span * days) & (F.col("t") < (span + 1) * days))
                if number == 1:
                    state.write(number, batch)  # lost: it is done again
                state.apply(number, batch)
                if number == 1:
                    state.compact()
            return written(state.output())
        finally:
            state.drop()


_OPEN = "SELECT address, nonce, arg_max(odt, (t, event_id)) FILTER (WHERE sign = 1) AS odt, arg_max(amount, (t, event_id)) FILTER (WHERE sign = 1) AS amount FROM ledger{where} GROUP BY address, nonce HAVING sum(sign) > 0"


@query("fold_as_expression", with_prelude(f"SELECT address, row_number() OVER (PARTITION BY address ORDER BY nonce) AS position, odt, amount FROM ({_OPEN.format(where='')}) o", "ledger"))
def as_expression(spark, sf_dir):
    """The live stack of every key by one expression over its ordered changes."""
    s = stack.stack_by_expression(base.changes(spark, sf_dir))
    return s.select("address", F.posexplode("stack").alias("k", "s")).select("address", (F.col("k") + 1).cast("long").alias("position"), "s.odt", "s.amount")


_DAY_BEFORE = 1705276800000000


@query(
    "pop_boundary",
    with_prelude(
        f""", o AS ({_OPEN.format(where=f' WHERE t < {_DAY_BEFORE}')}), c AS (SELECT *, row_number() OVER w AS place, sum(amount) OVER w AS covered FROM o WINDOW w AS (PARTITION BY address ORDER BY nonce DESC)),
        x AS (SELECT address, -sum(amount)::BIGINT AS owed FROM ch WHERE t >= {_DAY_BEFORE} AND amount < 0 GROUP BY address)
        SELECT x.address, x.owed, min(place) FILTER (WHERE covered >= owed)::INT AS depth, arg_min(covered, place) FILTER (WHERE covered >= owed)::BIGINT AS covered, arg_min(odt, place) FILTER (WHERE covered >= owed) AS odt
        FROM x LEFT JOIN c ON c.address = x.address GROUP BY x.address, x.owed""",
        "ledger",
    ),
)
def boundary(spark, sf_dir):
    """How deep into each stack all outflows of the second half would reach, sums from the top."""
    ch = base.changes(spark, sf_dir)
    live = fold.open_segments(fold.lifo_ledger(ch.where(f"t < {_DAY_BEFORE}")))
    owed = ch.where(f"t >= {_DAY_BEFORE} and amount < 0").groupBy("address").agg((-F.sum("amount")).alias("owed"))
    return stack.pop_boundary(live, owed)


@query("lifo_consumption", with_prelude("SELECT address, event_id, t, odt, (prem - rem)::BIGINT AS eaten FROM touch WHERE prem > rem", "ledger"))
def lifo_consumption(spark, sf_dir):
    """what each outflow takes of each origin."""
    led = fold.lifo_ledger(base.changes(spark, sf_dir)).where("odt <> 0")
    eaten = led.withColumn("birth", (F.col("sign") == 1) & (F.col("odt") == F.col("t"))).where("not birth")
    return eaten.groupBy("address", "event_id", "t", "odt").agg(F.sum(-F.col("sign") * F.col("amount")).alias("eaten")).where("eaten > 0")


@query("lifo_survivors", with_prelude("SELECT address, event_id, t, amount, held FROM survivors", "survivors"))
def lifo_survivors(spark, sf_dir):
    """What each inflow still holds, by suffix minimum."""
    return fold.survivors(base.changes(spark, sf_dir))


@query("lifo_survivors_sliced", with_prelude("SELECT address, event_id, t, amount, held FROM survivors", "survivors"))
def lifo_survivors_sliced(spark, sf_dir):
    """W2, W3 for very large keys: no window holds a key's whole history."""
    return fold.survivors_sliced(base.changes(spark, sf_dir), 24 * HOUR)


@query("net_cohorts", with_prelude("SELECT address, odt, amount FROM live", "live"))
def net_cohorts(spark, sf_dir):
    """The live stack rebuilt from the ledger."""
    return fold.net_cohorts(fold.lifo_ledger(base.changes(spark, sf_dir)))


@query(
    "open_segments_antijoin",
    with_prelude(f"SELECT {_BOTH}, nonce, arg_max(odt, (t, event_id)) FILTER (WHERE sign = 1) AS odt, arg_max(amount, (t, event_id)) FILTER (WHERE sign = 1) AS amount FROM ledger GROUP BY address, nonce HAVING sum(sign) > 0", "small ledger"),
)
def open_segments(spark, sf_dir):
    """Pushed and never popped, where numbers begin anew."""
    return fold.open_segments(fold.lifo_ledger(base.small_changes(spark, sf_dir), ("contract", "address")), ("contract", "address"))


@query("balance_fold", with_prelude("SELECT address, event_id, t, old_balance, balance FROM balance", "balance"))
def balance_fold(spark, sf_dir):
    """K5: balances before and after each change."""
    return fold.balances(base.changes(spark, sf_dir)).select("address", "event_id", "t", "old_balance", "balance")


@query(
    "fifo_consumption",
    with_prelude(
        """, i AS (SELECT address, event_id, sum(amount) OVER w - amount AS lo, sum(amount) OVER w AS hi FROM ch WHERE amount > 0 WINDOW w AS (PARTITION BY address ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
        o AS (SELECT address, event_id, sum(-amount) OVER w + amount AS lo, sum(-amount) OVER w AS hi FROM ch WHERE amount < 0 WINDOW w AS (PARTITION BY address ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))
        SELECT i.address, i.event_id AS in_event, o.event_id AS out_event, (least(i.hi, o.hi) - greatest(i.lo, o.lo))::BIGINT AS amount
        FROM i JOIN o ON i.address = o.address AND i.lo < o.hi AND o.lo < i.hi""",
        "ch",
    ),
)
def fifo(spark, sf_dir):
    """First in, first out."""
    return fold.fifo_matches(base.changes(spark, sf_dir))


_RECURRENCE = """, pos AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY t, event_id) AS pos FROM (SELECT c.*, p.price FROM ch c ASOF LEFT JOIN price p ON c.t - c.t % 300000000 >= p.t)),
        r AS (
          SELECT p.address, p.pos, p.amount AS b, CASE WHEN p.amount >= 0 THEN p.amount::DOUBLE * (p.t::DOUBLE / 1000000) ELSE 0 END AS w, CASE WHEN p.amount >= 0 AND p.price IS NOT NULL THEN p.amount::DOUBLE ELSE 0 END AS k, CASE WHEN p.amount >= 0 AND p.price IS NOT NULL THEN p.amount::DOUBLE * p.price ELSE 0 END AS c FROM pos p WHERE pos = 1
          UNION ALL
          SELECT r.address, p.pos, r.b + p.amount, CASE WHEN p.amount >= 0 THEN r.w + p.amount::DOUBLE * (p.t::DOUBLE / 1000000) WHEN r.b <> 0 THEN r.w * ((r.b + p.amount)::DOUBLE / r.b) ELSE r.w END,
                 CASE WHEN p.amount >= 0 THEN r.k + CASE WHEN p.price IS NOT NULL THEN p.amount::DOUBLE ELSE 0 END WHEN r.b <> 0 THEN r.k * ((r.b + p.amount)::DOUBLE / r.b) ELSE r.k END,
                 CASE WHEN p.amount >= 0 THEN r.c + coalesce(p.amount::DOUBLE * p.price, 0) WHEN r.b <> 0 THEN r.c * ((r.b + p.amount)::DOUBLE / r.b) ELSE r.c END
          FROM r JOIN pos p ON p.address = r.address AND p.pos = r.pos + 1
        )
        SELECT address, b::BIGINT AS balance, round(CASE WHEN b <> 0 THEN w / b / 86400 END, 3) AS birth, round(CASE WHEN k <> 0 THEN c / k END, 3) AS mean_cost FROM (SELECT *, max(pos) OVER (PARTITION BY address) AS last FROM r) WHERE pos = last"""


@query("tank_birth_time", with_prelude(_RECURRENCE, "ch", "price").replace("WITH ", "WITH RECURSIVE ", 1))
def tank(spark, sf_dir):
    """K6, K7: the average birth time in days and the average cost, linear recurrences over a key's changes."""
    p = base.prices(spark, sf_dir).select(F.col("t").alias("at"), "price")
    ch = asof.asof_backward(base.changes(spark, sf_dir).withColumn("at", floor_to("t", FIVE_MINUTES)), p, "at", "price")
    mean = lambda c, of: F.when(F.col(of) != 0, F.col(c) / F.col(of))
    return fold.averages(ch).select("address", "balance", F.round(mean("weight", "balance") / 86400, 3).alias("birth"), F.round(mean("cost", "priced"), 3).alias("mean_cost"))


@query(
    "trough_circulation",
    with_prelude("SELECT address, greatest(0, arg_max(balance, (t, event_id)) - min(old_balance))::BIGINT AS untouched FROM balance GROUP BY address", "balance"),
)
def trough(spark, sf_dir):
    """A14, K9."""
    return fold.trough(base.changes(spark, sf_dir))


@query(
    "trough_by_day",
    with_prelude(
        """, dd AS (SELECT address, CAST(floor(t / 86400000000) AS BIGINT) AS day, arg_max(balance, (t, event_id)) AS bal, min(old_balance) AS low FROM balance GROUP BY 1, 2),
        w(n) AS (VALUES (1), (7), (30)), days AS (SELECT DISTINCT n, unnest([day, day + n]) AS day FROM dd, w),
        k AS (SELECT d.n, d.day, (SELECT arg_max(bal, x.day) FROM dd x WHERE x.address = a.address AND x.day <= d.day) AS bal,
              (SELECT min(low) FROM dd x WHERE x.address = a.address AND x.day <= d.day AND x.day > d.day - d.n) AS low FROM days d, (SELECT DISTINCT address FROM dd) a)
        SELECT n AS window_days, day, sum(greatest(0, coalesce(bal - low, 0)))::BIGINT AS circulation FROM k GROUP BY 1, 2""",
        "balance",
    ),
)
def trough_days(spark, sf_dir):
    """Circulation of three windows by day, out of balances alone."""
    return fold.trough_by_day(base.changes(spark, sf_dir), (1, 7, 30))


@query(
    "group_and_compress",
    with_prelude(
        """, f AS (SELECT *, CASE WHEN sign(amount) <> lag(sign(amount)) OVER w THEN 1 WHEN lag(amount) OVER w IS NULL THEN 1 ELSE 0 END AS flip FROM ch WINDOW w AS (PARTITION BY address ORDER BY t, event_id)),
        r AS (SELECT *, sum(flip) OVER (PARTITION BY address ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM f)
        SELECT address, run, arg_min(event_id, (t, event_id)) AS first_event, arg_max(event_id, (t, event_id)) AS last_event, count(*) AS n, sum(amount)::BIGINT AS amount FROM r GROUP BY address, run""",
        "ch",
    ),
)
def compress(spark, sf_dir):
    """Runs of one sign merged."""
    return fold.compress_runs(base.changes(spark, sf_dir))


@query(
    "two_leg_changes",
    """WITH l AS (SELECT o_custkey AS a, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey ELSE (o_custkey * 7 + 3) % 1000 END AS b, round(o_totalprice * 100)::BIGINT AS v,
      o_orderpriority = '5-LOW' AS approval, o_orderkey % 10 AS block, o_orderkey % 4 AS ts, o_orderkey % 3 = 0 AS closing FROM orders)
    SELECT address, sum(amount)::BIGINT AS net, count(*) AS n FROM (
      SELECT a AS address, -v AS amount FROM l WHERE (a <> b OR closing) AND NOT approval AND (block > 0 OR ts > 0)
      UNION ALL SELECT b, v FROM l WHERE (a <> b OR closing) AND NOT approval AND (block > 0 OR ts > 0)) GROUP BY address""",
)
def two_leg(spark, sf_dir):
    """A transfer as two signed changes; transfers to oneself count only at a block's end, approvals and what has no block or time don't."""
    key = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("sender"), F.when(key % 5 == 0, F.col("o_custkey")).otherwise((F.col("o_custkey") * 7 + 3) % 1000).alias("receiver"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.when(F.col("o_orderpriority") == "5-LOW", "APPROVE").otherwise("TRANSFER").alias("kind"),
        (key % 10).alias("block"), (key % 4).alias("ts"), (key % 3 == 0).alias("end_of_block"),
    )
    legs = predicates.rows_of("transfers.two_legs", predicates.settled(raw))
    return legs.groupBy("address").agg(F.sum("amount").alias("net"), F.count("*").alias("n"))


@query(
    "named_predicates",
    """WITH l AS (SELECT o_custkey AS a, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_custkey ELSE (o_custkey * 7 + 3) % 1000 END AS b, round(o_totalprice * 100)::BIGINT AS v, o_orderpriority = '5-LOW' AS fee,
      o_custkey % 3 = 0 AS fx, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN o_custkey ELSE (o_custkey * 7 + 3) % 1000 END % 3 = 0 AND o_orderkey % 7 <> 0, false) AS tx, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS stake FROM orders), x AS (SELECT *, tx AND NOT stake AS te FROM l)
    SELECT 'only_in' AS name, count(*) AS n, coalesce(sum(v), 0)::BIGINT AS volume FROM x WHERE v > 0 AND a <> b
    UNION ALL SELECT 'in_and_out', count(*), coalesce(sum(v), 0)::BIGINT FROM x WHERE a <> b
    UNION ALL SELECT 'without_fees', count(*), coalesce(sum(v), 0)::BIGINT FROM x WHERE NOT fee
    UNION ALL SELECT 'burnt_fees', count(*), coalesce(sum(v), 0)::BIGINT FROM x WHERE fee AND b IS NULL
    UNION ALL SELECT 'exchanges_only', count(*), coalesce(sum(v), 0)::BIGINT FROM x WHERE fx OR te
    UNION ALL SELECT 'without_exchange_to_exchange', count(*), coalesce(sum(v), 0)::BIGINT FROM x WHERE NOT (fx AND te)
    UNION ALL SELECT 'whales', count(*), coalesce(sum(v), 0)::BIGINT FROM x WHERE v >= 30000000
    UNION ALL SELECT 'stakers', count(*), coalesce(sum(v), 0)::BIGINT FROM x WHERE stake""",
)
def named_predicates(spark, sf_dir):
    """Variants of a source by the names of their predicates, all of them."""
    key, own = F.col("o_orderkey"), F.col("o_custkey")
    to = F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, own).otherwise((own * 7 + 3) % 1000)
    t = table(spark, sf_dir, "orders").select(own.alias("sender"), to.alias("receiver"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.when(F.col("o_orderpriority") == "5-LOW", "fee").otherwise("TRANSFER").alias("kind"), ((F.col("o_orderstatus") == "F") & (key % 2 == 0)).alias("stake"))
    t = t.withColumns({"from_label": F.when(F.col("sender") % 3 == 0, "exchange"), "to_label": F.when(F.col("stake"), "staking").when(F.col("receiver") % 3 == 0, "exchange")})
    each = [predicates.rows_of("transfers.as_they_are", t, p).select(F.lit(p).alias("name"), "cents") for p in predicates.PREDICATES]
    names = spark.createDataFrame([(p,) for p in predicates.PREDICATES], "name string")
    sums = reduce(lambda a, b: a.unionByName(b), each).groupBy("name").agg(F.count("*").alias("n"), F.sum("cents").alias("volume"))
    return names.join(sums, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("volume", F.lit(0)).alias("volume"))


@query("seam_deltas", with_prelude("SELECT t, odt, measure FROM seam", "seam"))
def seam_deltas(spark, sf_dir):
    """A7."""
    return base.SOURCES["seam"](spark, sf_dir)


@query("seam_hourly", with_prelude("SELECT t, odt - odt % 3600000000 AS odt, sum(measure)::BIGINT AS measure FROM seam GROUP BY 1, 2", "seam"))
def seam_hourly(spark, sf_dir):
    """Origins rolled up to the hour."""
    return base.SOURCES["seam"](spark, sf_dir).groupBy("t", floor_to("odt", HOUR).alias("odt")).agg(F.sum("measure").alias("measure"))


@query("asof_acquisition_price", with_prelude("SELECT t, odt, measure, acq, now FROM pseam", "pseam"))
def acquisition(spark, sf_dir):
    """The latest price at or before the origin, null before the first."""
    return base.priced_seam(spark, sf_dir)


@query(
    "asof_unmatched_null_vs_zero",
    with_prelude(
        """SELECT s.t - s.t % 86400000000 AS day, sum(measure * a.price)::BIGINT AS cost_null, sum(measure * coalesce(a.price, 0))::BIGINT AS cost_zero,
           count(*) FILTER (WHERE a.price IS NULL) AS unmatched
        FROM (SELECT *, odt - odt % 300000000 AS oat FROM seam) s ASOF LEFT JOIN price a ON s.oat >= a.t GROUP BY 1""",
        "seam", "price",
    ),
)
def asof_modes(spark, sf_dir):
    """Both conventions for an absent price."""
    s = base.SOURCES["seam"](spark, sf_dir).withColumn("at", floor_to("odt", FIVE_MINUTES))
    p = base.prices(spark, sf_dir).withColumnRenamed("t", "at")
    null = asof.asof_backward(s, p.withColumnRenamed("price", "acq"), "at", "acq")
    both = asof.asof_backward(null, p.withColumnRenamed("price", "acq0"), "at", "acq0", unmatched="zero")
    return both.groupBy(floor_to("t", 24 * HOUR).alias("day")).agg(
        F.sum(F.col("measure") * F.col("acq")).alias("cost_null"), F.sum(F.col("measure") * F.col("acq0")).alias("cost_zero"), F.count_if(F.col("acq").isNull()).alias("unmatched")
    )


@query(
    "inner_price_drop",
    with_prelude("SELECT count(*) AS n, sum(measure)::BIGINT AS measure FROM seam JOIN price p ON seam.odt - seam.odt % 300000000 = p.t", "seam", "price"),
)
def inner_price(spark, sf_dir):
    """The older equality join on the price's bucket, which drops what has none."""
    s = base.SOURCES["seam"](spark, sf_dir).withColumn("at", floor_to("odt", FIVE_MINUTES))
    j = s.join(base.prices(spark, sf_dir).withColumnRenamed("t", "at"), "at")
    return j.agg(F.count("*").alias("n"), F.sum("measure").alias("measure"))


_LATEST = """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, round(l_quantity * 100)::BIGINT AS qty FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, round(l_quantity * 100)::BIGINT DESC) = 1"""


def _versions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", F.round(F.col("l_quantity") * 100).cast("long").alias("qty"))


@query("latest_version_dedup", f"SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) AS version, l_partkey, l_suppkey, qty FROM ({_LATEST})")
def latest_version(spark, sf_dir):
    """The latest version of each key."""
    v = rows.latest(_versions(spark, sf_dir), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "qty"])
    return v.select("l_orderkey", "l_linenumber", micros("l_shipdate").alias("version"), "l_partkey", "l_suppkey", "qty")


@query(
    "keep_first_dedup",
    "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
)
def keep_first(spark, sf_dir):
    """W9."""
    return rows.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("any_per_full_key", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, count(*) AS copies FROM lineitem GROUP BY 1, 2")
def any_per_key(spark, sf_dir):
    """A2: one value per key, the same on every run."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.count("*").alias("copies"))


@query("distinct_rows", "SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)")
def distinct_rows(spark, sf_dir):
    """U4."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct().agg(F.count("*").alias("n"))


@query(
    "touched_top_segments",
    with_prelude(
        """, touched AS (SELECT DISTINCT address FROM ch WHERE t >= 1706486400000000)
        SELECT address, odt, amount, rank FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY odt DESC) AS rank FROM live WHERE address IN (SELECT address FROM touched)) WHERE rank <= 3""",
        "live",
    ),
)
def touched_top(spark, sf_dir):
    """The top segments of the keys that a window touches."""
    ch = base.changes(spark, sf_dir)
    touched = ch.where("t >= 1706486400000000").select("address").distinct()
    live = fold.net_cohorts(fold.lifo_ledger(ch)).join(touched, "address", "left_semi")
    return rows.top_k(live, ["address"], [F.desc("odt")], 3).select("address", "odt", "amount", F.col("rank").cast("long").alias("rank"))


@query("window_scan", "SELECT count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def window_scan(spark, sf_dir):
    """A half-open window, pushed to the scan."""
    e = table(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-10 00:00:00' and ts < timestamp_ntz'2024-01-12 00:00:00'")
    return e.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))


@query(
    "monotone_progress",
    with_prelude(
        """SELECT address, count(*) FILTER (WHERE event_id <= seen) AS late FROM (
          SELECT *, max(event_id) OVER (PARTITION BY address ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ch) GROUP BY address""",
        "ch",
    ),
)
def monotone(spark, sf_dir):
    """Rows whose id doesn't go beyond all before."""
    seen = F.max("event_id").over(fold.in_order().rowsBetween(W.unboundedPreceding, -1))
    return base.changes(spark, sf_dir).withColumn("seen", seen).groupBy("address").agg(F.count_if(F.col("event_id") <= F.col("seen")).alias("late"))


@query(
    "ordered_arrays",
    with_prelude("SELECT address, row_number() OVER (PARTITION BY address ORDER BY t, event_id) AS position, amount FROM ch", "ch"),
)
def ordered_arrays(spark, sf_dir):
    """All values of each key in order, one row each, so that no key's history is one row."""
    return base.changes(spark, sf_dir).select("address", F.row_number().over(fold.in_order()).cast("long").alias("position"), "amount")


@query("stack_depths", with_prelude("SELECT round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, max(n) AS deepest FROM (SELECT address, count(*) AS n FROM live GROUP BY address)", "live"))
def depths(spark, sf_dir):
    """How deep stacks are."""
    n = base.SOURCES["live"](spark, sf_dir).groupBy("address").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.percentile("n", 0.5), 6).alias("p50"), F.round(F.percentile("n", 0.9), 6).alias("p90"), F.max("n").alias("deepest"))
