import json

import pytest
from pyspark.sql import functions as F

from strataq.operators import composites, reconcile, sums

POINTS = "asset string, dt long, metric string, value double"


def test_formulas_rest_on_each_other_and_on_earlier_values(spark):
    rows = [(a, d, m, v) for a, k in (("x", 1.0), ("y", 10.0)) for d in (1, 2, 4) for m, v in (("p", k * d), ("q", k + d))]
    rows = [r for r in rows if r[:3] != ("y", 4, "q")]
    f = {"last": "{sum} - {sum@1}", "sum": "{p} + {q}", "half": "try_divide({sum}, {p} - 10)", "far": "{p@2}", "never": "{unknown} + 1"}
    got = {(r.asset, r.dt, r.metric): r.value for r in composites.evaluate(spark.createDataFrame(rows, POINTS), f).collect()}
    total = {(a, d): p + q for a, d, p, q in (("x", 1, 1, 2), ("x", 2, 2, 3), ("x", 4, 4, 5), ("y", 1, 10, 11), ("y", 2, 20, 12))}
    want = {(*k, "sum"): v for k, v in total.items()} | {(a, 2, "last"): total[a, 2] - total[a, 1] for a in "xy"}
    want |= {("x", d, "half"): total["x", d] / (d - 10) for d in (1, 2, 4)} | {("y", 2, "half"): 3.2} | {("x", 4, "far"): 2.0, ("y", 4, "far"): 20.0}
    assert got == want
    with pytest.raises(ValueError, match="a, b"):
        composites.in_order({"a": "{b}", "b": "{a} + 1", "c": "1"})


def test_sums_go_on_from_what_is_stored(spark, tmp_path):
    rows = [(k, d, d * (k + 1)) for k in range(3) for d in range(30) if (k, d // 10) != (2, 1)] + [(7, 25, 5)]
    spark.createDataFrame(rows, "k long, dt long, d long").write.parquet(f"{tmp_path}/in")
    deltas = spark.read.parquet(f"{tmp_path}/in")
    folder = f"{tmp_path}/sums"
    assert [sums.carry_on(deltas, folder, ["k"], "dt", "d", u) for u in (9, 19, 19, 29)] == [None, 9, 9, 19]  # a run again replaces itself
    want, at = [], {}
    for k, d, x in sorted(rows):
        at[k] = at.get(k, 0) + x
        want.append((k, d, at[k]))
    assert sorted((r.k, r.dt, r.total) for r in sums.stored(spark, folder).collect()) == want
    plan = sums.beyond(deltas, "dt", 19, 29)._jdf.queryExecution().toString()
    assert "GreaterThan(dt,19)" in plan


def test_gates_read_the_plan(spark, tmp_path):
    for t in ("gate_in", "gate_out", "gate_other"):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {t} (k BIGINT) USING parquet LOCATION '{tmp_path}/{t}'")
    try:
        told = "INSERT INTO gate_out WITH c AS (SELECT k FROM gate_in) SELECT c.k FROM c JOIN gate_other o ON c.k = o.k"
        assert reconcile.touched(spark, told) == ({"gate_in", "gate_other"}, {"gate_out"})
        with pytest.raises(ValueError, match="gate_other"):
            reconcile.gated(spark, told, {"gate_in"}, {"gate_out"})
        with pytest.raises(ValueError, match="gate_out"):
            reconcile.gated(spark, told, {"gate_in", "gate_other"}, set())
        assert spark.table("gate_out").count() == 0  # refused before it ran
        spark.sql("INSERT INTO gate_in VALUES (1), (2)")
        spark.sql("INSERT INTO gate_other VALUES (2)")
        reconcile.gated(spark, told, {"gate_in", "gate_other"}, {"gate_out"})
        assert [r.k for r in spark.table("gate_out").collect()] == [2]
        assert reconcile.touched(spark, "SELECT k + 1 FROM gate_in WHERE k IN (SELECT k FROM gate_other)") == ({"gate_in", "gate_other"}, set())
    finally:
        for t in ("gate_in", "gate_out", "gate_other"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
