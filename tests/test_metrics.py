"""Metrics against brute force: over years, so that every window matters, and against each other."""

import datetime
import random
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strataq.operators import fold, rows
from strataq.plans import metrics
from strataq.plans.registry import QUERIES

DAY = 86_400_000_000
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def years(tmp_path_factory):
    """A folder with changes over 24 years, prices from its second year on; and the changes by address."""
    rnd, folder = random.Random(11), tmp_path_factory.mktemp("years")
    start = datetime.datetime(2000, 1, 1)
    data, by = [], defaultdict(list)
    for i in range(260):
        at = start + datetime.timedelta(seconds=rnd.randrange(24 * 365 * 86_400))
        kind = rnd.choice(["view", "click", "purchase", "signup", "error"])
        kind = "view" if kind == "click" and at.year == 2000 else kind
        data.append((i, rnd.randrange(4), kind, at, round(rnd.random() * 50, 2)))
    names = ["event_id", "user_id", "event_type", "ts", "value"]
    pq.write_table(pa.table(dict(zip(names, zip(*data))), schema=pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.timestamp("us"), pa.float64()))))), folder / "events.parquet")
    for i, user, kind, at, value in data:
        t = int((at - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        by[user].append((t, i, (-1 if kind in ("purchase", "error") else 1) * round(value * 100)))
    return str(folder), {k: sorted(v) for k, v in by.items()}


def test_windows_over_years(spark, years):
    folder, by = years
    got = {(r.window_days, r.day): r.circulation for r in QUERIES["circulation_T"](spark, folder).collect()}
    times = [t for v in by.values() for t, _, _ in v]
    lo, hi = min(times) // DAY, max(times) // DAY
    assert set(got) == {(w, d) for w in (*metrics.WINDOWS, metrics.INFINITE) for d in range(lo, hi + 1)}
    for d in range(lo, hi + 1, 97):
        held = [s for v in by.values() for s in fold.fold_key([(t, a) for t, _, a in v if t // DAY <= d])[1] if s[1]]
        for w in metrics.WINDOWS:
            assert got[w, d] == sum(a for _, odt, a in held if (odt + w * DAY) // DAY > d), (w, d)
        assert got[metrics.INFINITE, d] == sum(a for _, _, a in held)
    last = {w: got[w, hi] for w in metrics.WINDOWS}
    assert len(set(last.values())) > 6  # the windows differ


def test_bands_and_waves_over_years(spark, years):
    folder, by = years
    moved = defaultdict(int)
    for v in by.values():
        for (t, _, _), made in zip(v, fold.fold_key([(t, a) for t, _, a in v])[0]):
            for sign, _, odt, a in made:
                if odt and odt != t:
                    edge = next((f"{x}-{y}" for x, y in zip((0, *metrics.WINDOWS), metrics.WINDOWS) if t - odt < y * DAY), "7300+")
                    moved[t // DAY, edge] += -sign * a
    got = {(r.day, r.band): r.moved for r in QUERIES["spent_age_bands"](spark, folder).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in moved.items() if v} and len({b for _, b in got}) > 7
    waves = defaultdict(int)
    caps = {(r.window_days, r.day): r.realized_cap for r in QUERIES["realized_cap_T"](spark, folder).collect()}
    for r in QUERIES["hodl_waves"](spark, folder).collect():
        waves[r.day] += r.band_cap
    assert all(total == caps[metrics.INFINITE, d] for d, total in waves.items()) and len(waves) > 8000


def test_profits_by_address_are_the_networks(spark):
    by_address = QUERIES["address_realized_profit"](spark, SF).agg(F.sum("profit")).first()[0]
    network = QUERIES["network_profit_loss"](spark, SF).agg(F.sum("npl")).first()[0]
    assert by_address == network != 0


def test_closing_prices_agree(spark):
    ohlc = {r.day: r.close for r in QUERIES["price_ohlc"](spark, SF).collect()}
    assert {r.day: r.close for r in QUERIES["daily_market"](spark, SF).collect()}.items() <= ohlc.items()


def test_no_price_is_no_cost(spark):
    df = spark.createDataFrame([(1, 1, 10, 10, None), (1, 2, 20, 10, 100), (1, 3, 30, -10, 7), (2, 1, 10, 5, None)], "address long, event_id long, t long, amount long, price long")
    got = {r.address: r for r in fold.averages(df).collect()}
    assert got[1].cost / got[1].priced == 100 and (got[1].balance, got[1].priced, got[1].cost) == (10, 5.0, 500.0)
    assert (got[2].priced, got[2].cost) == (0.0, 0.0)


def test_gaps_are_no_change(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 8, 20), ("a", 9, 1)], "name string, day long, value long")
    got = {r.day: (r.d1, r.d7) for r in rows.change_over_days(df, "name", "day", "value", (1, 7)).collect()}
    assert got == {1: (None, None), 2: (2, None), 8: (None, 15), 9: (-19, -6)}


def test_all_that_enters_a_window_leaves_it(spark, years):
    total = {r.window_days: r.total for r in QUERIES["circulation_delta_T"](spark, years[0]).groupBy("window_days").agg(F.sum("delta").alias("total")).collect()}
    assert set(total) == {*metrics.WINDOWS, metrics.INFINITE} and total[metrics.INFINITE] > 0
    assert all(total[w] == 0 for w in metrics.WINDOWS)  # cancels after the last day of the data are told
