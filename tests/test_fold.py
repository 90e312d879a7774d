import random

import pytest
from pyspark.sql import functions as F

from strataq.operators import asof, fold, graph, reconcile, rows


def frame(spark, by_key):
    data = [(k, 100 * k + i, 10 + i, a) for k, amounts in by_key.items() for i, a in enumerate(amounts)]
    return spark.createDataFrame(data, "address long, event_id long, t long, amount long")


CASES = {
    "fresh push": ([5], [[(1, 1, 10, 5)]], [(1, 10, 5)]),
    "exact drain": ([5, -5], [[(1, 1, 10, 5)], [(-1, 1, 10, 5)]], []),
    "numbers begin anew": ([5, -5, 3], [[(1, 1, 10, 5)], [(-1, 1, 10, 5)], [(1, 1, 12, 3)]], [(1, 12, 3)]),
    "remainder": ([5, -2], [[(1, 1, 10, 5)], [(-1, 1, 10, 5), (1, 2, 10, 3)]], [(2, 10, 3)]),
    "several pops": ([5, 4, -7], [[(1, 1, 10, 5)], [(1, 2, 11, 4)], [(-1, 2, 11, 4), (-1, 1, 10, 5), (1, 3, 10, 2)]], [(3, 10, 2)]),
    "liability": ([-3], [[(1, 1, 0, -3)]], [(1, 0, -3)]),
    "liability popped": ([-3, 5, -4, -3], None, [(4, 0, -5)]),
    "zero inflow": ([0, 0], [[(1, 1, 10, 0)], [(1, 2, 11, 0)]], [(1, 10, 0), (2, 11, 0)]),
}


@pytest.mark.parametrize("name", CASES)
def test_fold_vectors(name):
    amounts, want, end = CASES[name]
    got, stack, _ = fold.fold_key([(10 + i, a) for i, a in enumerate(amounts)])
    assert stack == end
    if want is not None:
        assert got == want


def test_emptiness_within_a_block_keeps_the_number():
    got, stack, nonce = fold.fold_key([(10, 5), (10, -5), (10, 3), (11, -3), (11, 2), (11, -2)])
    assert [r[1] for x in got for r in x] == [1, 1, 2, 2, 3, 3] and (stack, nonce) == ([], 1)


def test_buckets():
    rows, stack, _ = fold.fold_key([(11, 5), (14, 2), (15, -4), (21, 1)], bucket=10)
    assert rows == [[(1, 1, 10, 5)], [(-1, 1, 10, 5), (1, 2, 10, 7)], [(-1, 2, 10, 7), (1, 3, 10, 3)], [(1, 4, 20, 1)]]
    assert stack == [(3, 10, 3), (4, 20, 1)]
    assert fold.fold_key([(11, -5), (12, 2)], bucket=10)[1] == [(1, 0, -5), (2, 10, 2)]  # what is owed joins nothing
    rnd = random.Random(4)
    ch = [(i // 2, rnd.randint(-9, 9)) for i in range(300)]
    assert fold.fold_key(ch, bucket=0) == fold.fold_key(ch)
    net = lambda out, f: {o: n for o in {f(r[2]) for x in out for r in x} if (n := sum(s * a for x in out for s, _, odt, a in x if f(odt) == o))}
    assert net(fold.fold_key(ch, bucket=7)[0], lambda o: o) == net(fold.fold_key(ch)[0], lambda o: o - o % 7)


def test_ledger_by_several_keys_and_resumed(spark):
    rnd = random.Random(6)
    data = [(c, f"a{a}" if a else None, 1000 * c + 50 * a + i, 10 + i // 2, rnd.randint(-4, 5)) for c in (1, 2) for a in range(8) for i in range(40)]
    ch = spark.createDataFrame(data, "contract int, address string, event_id long, t long, amount long")
    key = ("contract", "address")
    want = []
    for c in (1, 2):
        for a in range(8):
            own = [d for d in data if d[0] == c and d[1] == (f"a{a}" if a else None)]
            for d, moves in zip(own, fold.fold_key([(d[3], d[4]) for d in own])[0]):
                want += [(*d[:4], *m) for m in moves]
    got = [tuple(r) for r in fold.lifo_ledger(ch, key).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for day, top in ((11, 1), (20, 3), (29, 1), (29, 100)):
        state = fold.fold_state(fold.lifo_ledger(ch.where(f"t < {day}"), key), key)
        rest = [tuple(r) for r in fold.resume(state, ch.where(f"t >= {day}"), top, key).collect()]
        assert sorted(rest, key=repr) == sorted((w for w in want if w[3] >= day), key=repr), (day, top)
    want = sorted(map(tuple, fold.lifo_ledger(ch, key, bucket=7).where("t >= 20").collect()), key=repr)
    state = fold.fold_state(fold.lifo_ledger(ch.where("t < 20"), key, bucket=7), key)
    assert sorted(map(tuple, fold.resume(state, ch.where("t >= 20"), 2, key, bucket=7).collect()), key=repr) == want


def test_incremental_fold_equals_batch():
    rnd = random.Random(1)
    for _ in range(50):
        ch = [(i, rnd.randint(-9, 9)) for i in range(25)]
        whole = fold.fold_key(ch)
        cut = rnd.randrange(25)
        a, stack, nonce = fold.fold_key(ch[:cut])
        b, stack, nonce = fold.fold_key(ch[cut:], stack, nonce)
        assert (a + b, stack, nonce) == whole


def test_closed_forms_agree_with_the_ledger(spark):
    rnd = random.Random(2)
    by_key = {k: [rnd.randint(-20, 20) for _ in range(rnd.randint(1, 25))] for k in range(1, 40)}
    ch = frame(spark, by_key)
    ledger = fold.lifo_ledger(ch).cache()
    net = {r.address: r.n for r in ledger.groupBy("address").agg(F.sum(F.col("sign") * F.col("amount")).alias("n")).collect()}
    assert net == {k: sum(v) for k, v in by_key.items()}  # conservation
    live = {(r.address, r.odt): r.amount for r in fold.net_cohorts(ledger).collect() if r.odt}
    held = {(r.address, r.t): r.held for r in fold.survivors(ch).collect() if r.held}
    assert live == held
    births = {(r.address, r.odt) for r in ledger.where("sign = 1 and odt = t").collect()}
    assert all((r.address, r.odt) in births for r in ledger.where("sign = -1 and odt <> 0").collect())
    stacks = {k: [s for s in fold.fold_key([(10 + i, a) for i, a in enumerate(v)])[1]] for k, v in by_key.items()}
    open_ = {}
    for r in fold.open_segments(ledger).collect():
        open_.setdefault(r.address, []).append((r.nonce, r.odt, r.amount))
    assert {k: sorted(v) for k, v in stacks.items() if v} == {k: sorted(v) for k, v in open_.items()}


def test_slices_do_not_matter(spark):
    rnd = random.Random(5)
    ch = frame(spark, {k: [rnd.randint(-20, 20) for _ in range(30)] for k in range(1, 9)})
    rows_of = lambda d, *c: sorted(map(tuple, d.select(*c).collect()))
    for size in (1, 7, 1000):
        assert rows_of(fold.survivors_sliced(ch, size), "event_id", "held") == rows_of(fold.survivors(ch), "event_id", "held")
        assert rows_of(fold.balances_sliced(ch, size), "event_id", "balance", "old_balance") == rows_of(fold.balances(ch), "event_id", "balance", "old_balance")


def test_fifo(spark):
    got = fold.fifo_matches(frame(spark, {1: [5, 3, -6, -1, 4]})).collect()
    assert sorted((r.in_event, r.out_event, r.amount) for r in got) == [(100, 102, 5), (101, 102, 1), (101, 103, 1)]


def test_asof_carries_over_slices(spark):
    left = spark.createDataFrame([(1, 5), (1, 95), (1, 250), (2, 250), (1, 40)], "k int, t long")
    right = spark.createDataFrame([(1, 10, 1.0), (1, 40, 2.0), (1, 120, 3.0), (2, 300, 9.0)], "k int, t long, v double")
    got = {(r.k, r.t): r.v for r in asof.asof_backward(left, right, "t", "v", ["k"], slice_size=50).collect()}
    assert got == {(1, 5): None, (1, 40): 2.0, (1, 95): 2.0, (1, 250): 3.0, (2, 250): None}
    zero = asof.asof_backward(left, right, "t", "v", ["k"], slice_size=50, unmatched="zero")
    assert {(r.k, r.t): r.v for r in zero.collect()}[2, 250] == 0.0


def test_latest_breaks_ties(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 1, "z")], "k int, ver int, x string")
    assert [tuple(r) for r in rows.latest(df, ["k"], ["ver"]).collect()] == [(1, 2, "b")]


def test_relative_difference_bounds(spark):
    r = spark.createDataFrame([(0.0, 0.0), (1.0, -1.0), (2.0, 2.0)], "p double, e double")
    r = r.select(reconcile.relative_difference(F.col("p"), F.col("e")).alias("d")).collect()
    assert r[0].d == 0 and r[1].d == 2 and r[2].d == 0


def test_levels(spark):
    of = lambda e: {r.node: r.level for r in graph.levels(spark.createDataFrame(e, "source string, target string")).collect()}
    assert of([("b", "c"), ("a", "c"), ("c", "d"), ("a", "d"), ("a", "d")]) == {"a": 0, "b": 0, "c": 1, "d": 2}
    assert of([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(8)])["n008"] == 8
    with pytest.raises(ValueError):
        of([("x", "a"), ("a", "b"), ("b", "a")])


def test_canonical_names(spark):
    names = {"a_b_1d": "a_b", "a_1d_30d/v3": "a", "holders_1e_3": "holders_B", "holders_1e3_1day": "holders_B", "x_all_5min": "x_B", "x_1": "x_B", "age_5min_delta": "age_delta", "usd_2y": "usd", "all": "all"}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", graph.canonical(F.col("n")).alias("c"))
    assert {r.n: r.c for r in df.collect()} == names



def test_lineage_reaches_each_node_once(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "source string, target string")
    got = graph.reachable(e, spark.createDataFrame([("a", "a")], "root string, node string")).collect()
    assert sorted((r.node, r.depth) for r in got) == [("a", 0), ("b", 1), ("c", 1)]


def test_gates_and_ids(spark):
    some, none = spark.range(3), spark.range(0)
    reconcile.require_rows({"a": some})
    with pytest.raises(ValueError, match="b"):
        reconcile.require_rows({"a": some, "b": none})
    reconcile.allowed_writes({"x"}, {"x", "y"})
    with pytest.raises(ValueError, match="z"):
        reconcile.allowed_writes({"z"}, {"x"})
    points, meta = spark.createDataFrame([("m", 1.0)], "name string, v double"), spark.createDataFrame([("m", 7)], "name string, metric_id int")
    assert reconcile.with_ids(points, meta).first().metric_id == 7
    with pytest.raises(Exception, match="no id"):
        reconcile.with_ids(points, meta.where("name = 'q'")).collect()


def test_ranges_that_overlap_and_nest(spark):
    rnd = random.Random(12)
    spans = [(k, rnd.randint(0, 2), lo := rnd.randint(-50, 3000), lo + rnd.choice([0, 1, 2, 3, 5, 64, 65, 1000, 5000])) for k in range(300)] + [(900, None, 0, 10), (901, 1, None, 5), (902, 1, 7, 3)]
    points = [(k, rnd.randint(0, 2), rnd.randint(-60, 4000)) for k in range(400)] + [(900, None, 5), (901, 1, None)]
    for finest in (1, 16):
        found = asof.within_ranges(spark.createDataFrame(points, "p long, g int, at long"), spark.createDataFrame(spans, "r long, g int, lo long, hi long"), "at", "lo", "hi", ["g"], finest)
        got = sorted((x.p, x.r) for x in found.collect())
        want = sorted((p, r) for p, g, at in points for r, h, lo, hi in spans if None not in (g, at, lo) and g == h and lo <= at < hi)
        assert got == want
        assert "NestedLoop" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()


def test_a_value_from_too_long_before_is_none(spark):
    left = spark.createDataFrame([(k, at) for k, at in enumerate([5, 10, 14, 15, 40, 41])], "k int, at long")
    right = spark.createDataFrame([(10, 1), (35, 2)], "at long, v int")
    got = {r.at: r.v for r in asof.asof_backward(left, right, "at", "v", slice_size=7, greatest_gap=5).collect()}
    assert got == {5: None, 10: 1, 14: 1, 15: 1, 40: 2, 41: None}


def test_slices_of_several_keys_and_nulls(spark):
    rnd = random.Random(15)
    data = [(c, f"a{a}" if a else None, 1000 * (c or 0) + 50 * a + i, 10 + i // 2, rnd.randint(-4, 5)) for c in (1, None) for a in range(3) for i in range(30)]
    ch, key = spark.createDataFrame(data, "contract int, address string, event_id long, t long, amount long"), ("contract", "address")
    told = lambda d, *c: sorted(map(tuple, d.select(*key, "event_id", *c).collect()), key=repr)
    assert told(fold.survivors_sliced(ch, 4, key), "held") == told(fold.survivors(ch, key), "held")
    assert told(fold.balances_sliced(ch, 4, key), "balance") == told(fold.balances(ch, key), "balance")


def test_ranges_of_time_meet_two_slices(spark):
    rnd = random.Random(16)
    data = [(rnd.choice(["a", None]), rnd.randint(-40, 200), rnd.randint(0, 99)) for _ in range(300)] + [("a", None, 5)]
    df = spark.createDataFrame(data, "k string, t long, v long")
    got = sorted(map(tuple, rows.over_range(df, "t", 13, {"low": F.min("v"), "n": F.count("*")}, ["k"]).collect()), key=repr)
    near = lambda k, t: [v for x, s, v in data if x == k and s is not None and t - 13 < s <= t]
    assert got == sorted(((k, t, v, min(near(k, t)), len(near(k, t))) for k, t, v in data if t is not None), key=repr)


def test_the_fold_as_an_expression(spark):
    from strataq.operators import stack

    rnd = random.Random(21)
    by_key = {k: [rnd.randint(*[(-9, 9), (-3, 9), (-9, 3), (0, 0), (-2, 2)][k % 5]) for _ in range(rnd.randint(1, 40))] for k in range(40)}
    got = {r.address: [tuple(s) for s in r.stack] for r in stack.stack_by_expression(frame(spark, by_key)).collect()}
    assert got == {k: [s[1:] for s in fold.fold_key([(10 + i, a) for i, a in enumerate(v)])[1]] for k, v in by_key.items()}


def test_how_deep_an_outflow_reaches(spark):
    from strataq.operators import stack

    segments = spark.createDataFrame([(1, 1, 0, -5), (1, 2, 11, 4), (1, 3, 12, 3), (None, 1, 9, 2)], "address long, nonce long, odt long, amount long")
    owed = lambda *x: spark.createDataFrame(list(x), "address long, owed long")
    told = lambda o: [tuple(r) for r in stack.pop_boundary(segments, o).collect()]
    assert told(owed((1, 3))) == [(1, 3, 1, 3, 12)] and told(owed((1, 4))) == [(1, 4, 2, 7, 11)] and told(owed((1, 8))) == [(1, 8, None, None, None)]
    assert told(owed((None, 1))) == [(None, 1, 1, 2, 9)] and told(owed((2, 1))) == [(2, 1, None, None, None)]


def test_stacks_within_reach_are_folded_once(spark, monkeypatch):
    """No key reaches below the tops of its stack: one pass over state and changes; the ledger is that of all changes at once."""
    folds, own = [], fold._resumed
    monkeypatch.setattr(fold, "_resumed", lambda *a: folds.append(1) or own(*a))
    data = [(k % 3, k, 10 + k, 5 if k % 4 else -12) for k in range(60)]
    ch = spark.createDataFrame(data, "address long, event_id long, t long, amount long")
    state = fold.fold_state(fold.lifo_ledger(ch.where("t < 40")))
    for top, passes in ((64, 1), (1, 2)):
        folds.clear()
        got = fold.resume(state, ch.where("t >= 40"), top)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fold.lifo_ledger(ch).where("t >= 40").collect())) and len(folds) == passes
