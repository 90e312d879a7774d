"""Ordered folds of signed changes, one state per key.

A last-in-first-out position is a stack of segments. An inflow pushes one; an outflow pops segments from the top until
it is covered and pushes what is left of the last one again, under that one's origin time. What isn't covered stays as
a negative segment of origin time 0 at the bottom, and popping that makes the outflow larger. Segments have numbers (nonces), which
begin anew when a key's stack is empty at the end of a block; a block is what happens at one time.

The exact ledger needs the order, so a key is folded by one task; keys are hashed over tasks, each task streams
its sorted rows and holds one stack at a time. All other forms here are windows and joins of DataFrames. ``key`` names the columns
of a key: an address, or an address with its contract or asset.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataq.functions.session import by_key, written
from strataq.functions.time import day_number

#: Columns of a ledger behind those of its key; a change has a key, an order (t, event_id) and a signed ``amount``.
MOVES = "event_id long, t long, sign int, nonce long, odt long, amount long"
LEDGER = f"address long, {MOVES}"
KEY = ("address",)
Segment = tuple[int, int, int]  # nonce, origin time, amount


def fold_one(stack: list[Segment], nonce: int, t: int, amount: int, bucket: int = 0) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Apply one change to ``stack`` in place; gives the next nonce and rows (sign, nonce, odt, amount).

    With a ``bucket`` size origins are the starts of buckets, and an inflow joins a top segment of its own bucket: that one is popped and
    pushed again with both amounts under a new nonce. What is owed (odt 0) joins nothing.
    """
    if amount >= 0:
        if not bucket:
            stack.append((nonce, t, amount))
            return nonce + 1, [(1, nonce, t, amount)]
        odt, rows = t - t % bucket, []
        if stack and stack[-1][1] == odt != 0:
            n, _, a = stack.pop()
            rows.append((-1, n, odt, a))
            amount += a
        stack.append((nonce, odt, amount))
        return nonce + 1, [*rows, (1, nonce, odt, amount)]
    rows, owed, covered, odt = [], -amount, 0, 0
    while covered < owed and stack:
        n, odt, a = stack.pop()
        covered += a
        rows.append((-1, n, odt, a))
    if covered != owed:
        if covered < owed:
            odt = 0
        stack.append((nonce, odt, covered - owed))
        rows.append((1, nonce, odt, covered - owed))
        nonce += 1
    return nonce, rows


def fold_key(changes: Iterable[tuple[int, int]], stack: list[Segment] | None = None, nonce: int = 1, bucket: int = 0) -> tuple[list[list[tuple[int, int, int, int]]], list[Segment], int]:
    """Rows by change of one key's ordered (t, amount), with the stack and nonce they end in; ``changes`` end with a block."""
    stack, out, last = list(stack or []), [], None
    for t, a in changes:
        if t != last and not stack:
            nonce = 1
        last = t
        nonce, rows = fold_one(stack, nonce, t, a, bucket)
        out.append(rows)
    return out, stack, nonce if stack else 1


def key_changes(columns: list[pa.Array]) -> np.ndarray:
    """Where a row's key is another than the row's before; the first counts as another. Nulls are a key."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def _in_key_order(changes: DataFrame, key: Sequence[str], *values: str) -> DataFrame:
    columns = [*key, "event_id", "t", *values]
    return by_key(changes.select(*columns), *key).sortWithinPartitions(*key, "t", "event_id")


def _schema(changes: DataFrame, key: Sequence[str], rest: str) -> StructType:
    return StructType([changes.schema[k] for k in key] + StructType.fromDDL(rest).fields)


def lifo_ledger(changes: DataFrame, key: Sequence[str] = KEY, bucket: int = 0) -> DataFrame:
    """Every segment pushed (+1) and popped (-1), in order of changes, by ``key``; ``bucket`` as in ``fold_one``."""
    k = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack, nonce, last = None, [], 1, None
        for b in batches:
            if not b.num_rows:
                continue
            new = key_changes(b.columns[:k]).tolist()
            first = [c[0].as_py() for c in b.columns[:k]]
            new[0] = at is None or first != at
            at = [c[-1].as_py() for c in b.columns[:k]]
            rows, of = [], []
            for i, (begins, t, amount) in enumerate(zip(new, b.column(k + 1).to_numpy().tolist(), b.column(k + 2).to_numpy().tolist())):
                if begins:
                    stack, nonce = [], 1
                elif not stack and t != last:
                    nonce = 1
                last = t
                nonce, made = fold_one(stack, nonce, t, amount, bucket)
                rows += made
                of += [i] * len(made)
            sign, n, odt, a = zip(*rows) if rows else ((),) * 4
            own = [c.take(pa.array(of, pa.int32())) for c in b.columns[: k + 2]]
            cols = [*own, pa.array(sign, pa.int32()), *(pa.array(c, pa.int64()) for c in (n, odt, a))]
            yield pa.RecordBatch.from_arrays(cols, [*key, *(x.split()[0] for x in MOVES.split(", "))])

    return _in_key_order(changes, key, "amount").mapInArrow(run, _schema(changes, key, MOVES))


def in_order(key: Sequence[str] = KEY):
    """The changes of each key in order."""
    return W.partitionBy(*key).orderBy("t", "event_id")


def balances(changes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Changes with old_balance and balance."""
    bal = F.sum("amount").over(in_order(key))
    return changes.withColumn("balance", bal).withColumn("old_balance", F.col("balance") - F.col("amount"))


def survivors(changes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """What each inflow still holds at the end: the lowest later balance less the balance before it, within the inflow."""
    b = balances(changes, key).withColumn("low", F.min("balance").over(in_order(key).rowsBetween(0, W.unboundedFollowing)))
    held = F.greatest(F.least(F.col("low"), F.col("balance")) - F.col("old_balance"), F.lit(0))
    return b.where("amount >= 0").withColumn("held", held).select(*key, "event_id", "t", "amount", "held")


def _by_slice(rows: DataFrame, other: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """``rows`` with ``value`` of their key's slice; nulls are a key."""
    r, o = rows.alias("__r"), other.alias("__o")
    return r.join(o, [F.col(f"__r.{c}").eqNullSafe(F.col(f"__o.{c}")) for c in (*key, "slice")]).select("__r.*", f"__o.{value}")


def balances_sliced(changes: DataFrame, slice_size: int, key: Sequence[str] = KEY) -> DataFrame:
    """``balances`` for keys with very many changes: running sums within (key, slice of time), begun at the sum of the slices before.

    The windows over a key's slices meet one row per slice, so no task holds a key's whole history.
    """
    cut = changes.withColumn("slice", F.col("t") - F.pmod(F.col("t"), F.lit(slice_size)))
    totals = cut.groupBy(*key, "slice").agg(F.sum("amount").alias("total"))
    before = W.partitionBy(*key).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    begun = totals.select(*key, "slice", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("begun"))
    inner = W.partitionBy(*key, "slice").orderBy("t", "event_id")
    b = _by_slice(cut, begun, key, "begun").withColumn("balance", F.col("begun") + F.sum("amount").over(inner))
    return b.withColumn("old_balance", F.col("balance") - F.col("amount")).drop("begun")


def survivors_sliced(changes: DataFrame, slice_size: int, key: Sequence[str] = KEY) -> DataFrame:
    """``survivors`` for keys with very many changes: the lowest balance within a slice, then that of the slices behind."""
    b = balances_sliced(changes, slice_size, key)
    lows = b.groupBy(*key, "slice").agg(F.min("balance").alias("low"))
    after = W.partitionBy(*key).orderBy("slice").rowsBetween(1, W.unboundedFollowing)
    later = lows.select(*key, "slice", F.min("low").over(after).alias("later"))
    inner = W.partitionBy(*key, "slice").orderBy("t", "event_id").rowsBetween(0, W.unboundedFollowing)
    b = _by_slice(b, later, key, "later").withColumn("low", F.least(F.min("balance").over(inner), F.col("later")))
    held = F.greatest(F.least(F.col("low"), F.col("balance")) - F.col("old_balance"), F.lit(0))
    return b.where("amount >= 0").select(*key, "event_id", "t", "amount", held.alias("held"))


def net_cohorts(ledger: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The live stack out of a ledger: amounts by origin that don't cancel."""
    return ledger.groupBy(*key, "odt").agg(F.sum(F.col("sign") * F.col("amount")).alias("amount")).where("amount <> 0")


def open_segments(ledger: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The live stack segment by segment: pushed and never popped.

    Nonces begin anew with every holding period, so a pop belongs to the nearest push of its nonce before it: what is left open is where
    pushes and pops of a nonce don't balance, and that is the last push.
    """
    last = F.max_by(F.struct("odt", "amount"), F.when(F.col("sign") == 1, F.struct("t", "event_id", "odt", "amount")))
    open_ = ledger.groupBy(*key, "nonce").agg(F.sum("sign").alias("left"), last.alias("last")).where("left > 0")
    return open_.select(*key, "nonce", "last.odt", "last.amount")


def seam(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Net measure by time and origin time over all keys, or by each of ``by`` (a contract, an asset)."""
    return ledger.groupBy(*by, "t", "odt").agg(F.sum(F.col("sign") * F.col("amount")).alias("measure")).where("measure <> 0")


class State(NamedTuple):
    """What ``resume`` goes on from, as rows: a key's head (next_nonce, last_t, last_event, n live segments), and its segments (nonce, odt, amount)."""

    heads: DataFrame
    segments: DataFrame


def fold_state(ledger: DataFrame, key: Sequence[str] = KEY) -> State:
    """The state that a ledger ends in. Numbers go on behind the last push, or from 1 where nothing is held."""
    n = F.sum("sign")
    last = F.max_by("nonce", F.when(F.col("sign") == 1, F.struct("t", "event_id")))
    heads = ledger.groupBy(*key).agg(
        F.when(n == 0, 1).otherwise(last + 1).cast("long").alias("next_nonce"), F.max("t").alias("last_t"), F.max(F.struct("t", "event_id"))["event_id"].alias("last_event"), n.alias("n")
    )
    return State(heads, open_segments(ledger, key))


def alike(a: DataFrame, b: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """A semi or anti join by ``key`` in which nulls are equal."""
    a, b = a.alias("__a"), b.alias("__b")
    return a.join(b, [F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")) for c in key], how)


def resume(state: State, changes: DataFrame, top: int = 64, key: Sequence[str] = KEY, bucket: int = 0) -> DataFrame:
    """The ledger of ``changes``, which come after ``state``: only keys with changes read a stack, and of it only the ``top`` segments.

    A key whose outflows reach below these is folded once more with its whole stack, so the result doesn't depend on ``top``.
    """
    touched = changes.select(*key).distinct()
    heads, segments = (alike(d, touched, key, "left_semi") for d in state)
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("nonce")))
    tops = segments.withColumn("rank", rank).where(F.col("rank") <= top + 1).withColumn("below", F.col("rank") > top).drop("rank")
    lazy = written(_resumed(heads, tops, changes, key, bucket))
    short = lazy.where("sign = 0").select(*key)
    if short.isEmpty():
        return lazy
    parts = [alike(d, short, key, "left_semi") for d in (heads, segments.withColumn("below", F.lit(False)), changes)]
    return alike(lazy, short, key, "left_anti").unionByName(_resumed(*parts, key, bucket))


def _resumed(heads: DataFrame, segments: DataFrame, changes: DataFrame, key: Sequence[str], bucket: int) -> DataFrame:
    """Ledger rows by key; a row of sign 0 alone where more was needed than what lies above a segment marked ``below``."""
    kind = lambda n: F.lit(n).alias("kind")
    first = heads.select(*key, kind(0), F.col("next_nonce").alias("nonce"), F.col("last_t").alias("t"))
    held = segments.select(*key, kind(1), "nonce", F.col("odt").alias("t"), "amount", "below")
    rest = changes.select(*key, kind(2), "event_id", "t", "amount")
    k = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack, nonce, last, whole, out = None, [], 1, None, True, []

        def told(kinds: list[pa.DataType]) -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * (k + 6)
            made = [pa.array(c, t) for c, t in zip(cols[:k], kinds)] + [pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(cols[k:])]
            out.clear()
            return pa.RecordBatch.from_arrays(made, [*key, *(x.split()[0] for x in MOVES.split(", "))])

        for b in batches:
            for *own, of, number, event, t, amount, below in zip(*(c.to_pylist() for c in b.columns)):
                if own != at:
                    at, stack, nonce, last, whole = own, [], 1, None, True
                if of == 0:
                    nonce, last = number, t
                elif of == 1:
                    if below:
                        whole = False
                    else:
                        stack.append((number, t, amount))
                elif whole is not None:
                    if whole and not stack and t != last:
                        nonce = 1
                    last = t
                    nonce, rows = fold_one(stack, nonce, t, amount, bucket)
                    if not whole and (not stack or (stack[0][1] == 0 and stack[0][2] < 0)):
                        whole = None  # what lies below was needed
                        out.append((*own, event, t, 0, 0, 0, 0))
                        continue
                    out += [(*own, event, t, *r) for r in rows]
            if out:
                yield told([b.schema.field(i).type for i in range(k)])

    columns = [*key, "kind", "nonce", "event_id", "t", "amount", "below"]
    rows = first.unionByName(held, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True).select(*columns)
    return by_key(rows, *key).sortWithinPartitions(*key, "kind", "nonce", "t", "event_id").mapInArrow(run, _schema(changes, key, MOVES))


def fifo_matches(changes: DataFrame) -> DataFrame:
    """First-in-first-out pairs (in_event, out_event, amount): overlaps of running inflow with running outflow.

    The ends of both kinds of interval are put in one order per key; each piece between two ends belongs to the next
    inflow end and the next outflow end. One sort per key, no range join.
    """
    side = lambda cond, name: changes.where(cond).withColumn("end", F.sum(F.abs("amount")).over(in_order())).select("address", "end", F.col("event_id").alias(name))
    both = side("amount > 0", "in_event").unionByName(side("amount < 0", "out_event"), allowMissingColumns=True)
    ends = both.groupBy("address", "end").agg(F.max("in_event").alias("in_event"), F.max("out_event").alias("out_event"))
    w = W.partitionBy("address").orderBy("end")
    ahead = w.rowsBetween(0, W.unboundedFollowing)
    return (
        ends.withColumn("amount", F.col("end") - F.coalesce(F.lag("end").over(w), F.lit(0)))
        .withColumn("in_event", F.first("in_event", ignorenulls=True).over(ahead))
        .withColumn("out_event", F.first("out_event", ignorenulls=True).over(ahead))
        .where("in_event is not null and out_event is not null")
        .select("address", "in_event", "out_event", "amount")
    )


AVERAGES = "event_id long, t long, balance long, weight double, priced double, cost double"


def averages(changes: DataFrame, key: Sequence[str] = KEY, series: bool = False) -> DataFrame:
    """Average birth time and average cost as linear recurrences over a key's ordered changes (.., t, event_id, amount, price).

    weight: balance times its mean birth time in seconds; priced: what of the balance came in at a known price, and cost: that times its mean
    price, so what has no price costs nothing and doesn't lower the mean. An inflow adds amount times time and times price; an outflow scales
    all three by new over old balance. One row a key, or with ``series`` one a change.
    A key's rows are streamed, so a long history takes no memory.
    """
    k = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, balance, weight, priced, cost, row = None, 0, 0.0, 0.0, 0.0, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), [*kinds, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()])]
            return pa.RecordBatch.from_arrays(cols, [*key, *(x.split()[0] for x in AVERAGES.split(", "))])

        for b in batches:
            kinds, rows = [c.type for c in b.columns[:k]], []
            for *own, event, t, amount, price in zip(*(c.to_pylist() for c in b.columns)):
                if own != at:
                    if row and not series:
                        rows.append(row)
                    at, balance, weight, priced, cost = own, 0, 0.0, 0.0, 0.0
                if amount >= 0:
                    weight += float(amount) * (t / 1_000_000)
                    if price is not None:
                        priced += float(amount)
                        cost += float(amount) * price
                elif balance:
                    left = (balance + amount) / balance
                    weight, priced, cost = weight * left, priced * left, cost * left
                balance += amount
                row = (*own, event, t, balance, weight, priced, cost)
                if series:
                    rows.append(row)
            if rows:
                yield out(rows)
        if row and not series:
            yield out([row])

    priced = changes if "price" in changes.columns else changes.withColumn("price", F.lit(None).cast("long"))
    return _in_key_order(priced, key, "amount", "price").mapInArrow(run, _schema(changes, key, AVERAGES))


def trough(changes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """What of each key's net inflow no later dip touched: end balance less the lowest old balance, at least 0."""
    b = balances(changes, key)
    last = F.max_by("balance", F.struct("t", "event_id"))
    return b.groupBy(*key).agg(F.greatest(F.lit(0), last - F.min("old_balance")).alias("untouched"))


def trough_by_day(changes: DataFrame, days: Sequence[int], key: Sequence[str] = KEY) -> DataFrame:
    """(window_days, day, circulation): over all keys, what of the net inflow of the last so many days no dip within them touched.

    A key's part only changes on a day with changes and when such a day leaves the window, so each of its days gives two rows a
    window; the differences are summed by day, and only the sums by day are accumulated.
    """
    daily = balances(changes, key).withColumn("day", day_number("t")).groupBy(*key, "day").agg(F.max_by("balance", F.struct("t", "event_id")).alias("bal"), F.min("old_balance").alias("low"))
    parts = []
    for n in days:
        at = daily.select(*key, F.explode(F.array("day", F.col("day") + n)).alias("day")).distinct().join(daily, [*key, "day"], "left")
        order = W.partitionBy(*key).orderBy("day")
        held = F.last("bal", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.min("low").over(order.rangeBetween(1 - n, 0))
        at = at.withColumn("held", F.greatest(F.coalesce(held, F.lit(0)), F.lit(0)))
        parts.append(at.select(F.lit(n).alias("window_days"), "day", (F.col("held") - F.coalesce(F.lag("held").over(order), F.lit(0))).alias("d")))
    sums = reduce(lambda a, b: a.unionByName(b), parts).groupBy("window_days", "day").agg(F.sum("d").alias("d"))
    total = F.sum("d").over(W.partitionBy("window_days").orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    return sums.select("window_days", "day", total.alias("circulation"))


def compress_runs(changes: DataFrame) -> DataFrame:
    """Runs of equal sign within a key merged: first and last event, number of changes and their sum."""
    flip = (F.signum("amount") != F.lag(F.signum("amount")).over(in_order())).cast("int")
    run = F.sum(F.coalesce(F.col("flip"), F.lit(1))).over(in_order())
    return (
        changes.withColumn("flip", flip).withColumn("run", run).groupBy("address", "run")
        .agg(F.min_by("event_id", F.struct("t", "event_id")).alias("first_event"), F.max_by("event_id", F.struct("t", "event_id")).alias("last_event"), F.count("*").alias("n"), F.sum("amount").alias("amount"))
    )
