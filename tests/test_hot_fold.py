import random

import pytest

from strataq.operators import fold, hot_fold

SCHEMA = "address long, event_id long, t long, amount long"


def both(spark, data, slice_rows, key=("address",), schema=SCHEMA):
    ch = spark.createDataFrame(data, schema).repartition(5)
    got = sorted(map(tuple, hot_fold.lifo_ledger_sliced(ch, key, slice_rows).collect()), key=repr)
    want = sorted(map(tuple, fold.lifo_ledger(ch, key).collect()), key=repr)
    assert got == want
    return got


def walk(rnd, n, low, high, ts=3):
    return [(i // rnd.randint(1, ts) if ts > 1 else i, rnd.randint(low, high)) for i in range(n)]


def rows(key, changes):
    return [(key, 1000 * k, t, a) for k, (t, a) in enumerate(sorted(changes, key=lambda c: c[0]))]


@pytest.mark.parametrize("slice_rows", [1, 7, 64])
def test_equals_the_ledger_of_one_task(spark, slice_rows):
    rnd = random.Random(slice_rows)
    data = []
    for k in range(6):  # one very large key among smaller ones, in and out of debt, with empty segments
        n = 900 if k == 0 else rnd.randrange(1, 60)
        data += rows(k, walk(rnd, n, *[(-5, 5), (-3, 6), (-6, 3), (0, 2), (-2, 0), (-1, 1)][k if slice_rows == 7 else (k + 1) % 6]))
    both(spark, data, slice_rows)


@pytest.mark.parametrize("amounts", [
    [5, 0, 3, -3, -1, -4, 2, 0, 0, -9, 1, -1, 7], [0, 0, 5, -5, -1, 4, -2, -2, -2], [9] * 30 + [-200, -70, -1] + [3] * 5 + [-15, 1], [-4, 4, -4, 4, 0, -5, 0, 1],
    [2, 2, 2, -6, 5, -5, 5, -2, -3, 1], [0, -1, 0, -1, 3, -1, -1, -1, 2], [5, 0, -5, 0, 4, 0, -4, 1, -2],
])
@pytest.mark.parametrize("slice_rows", [1, 2, 3])
def test_pieces_that_end_at_segments(spark, amounts, slice_rows):
    both(spark, [(1, k, k // 2, a) for k, a in enumerate(amounts)] + [(2, k, k, a) for k, a in enumerate(amounts)], slice_rows)


def test_several_keys_and_nulls(spark):
    rnd = random.Random(9)
    data = [(c, f"a{a}" if a else None, 1000 * (c or 0) + 50 * a + i, 10 + i // 2, rnd.randint(-4, 5)) for c in (1, None) for a in range(3) for i in range(40)]
    both(spark, data, 6, ("contract", "address"), "contract int, address string, event_id long, t long, amount long")
    assert both(spark, [], 6) == []
