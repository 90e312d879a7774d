"""The exact last-in-first-out ledger of keys of any size, a slice of changes at a time.

What a slice does to the stack below it is known without that stack: outflows that its own inflows don't cover take so much from below,
one after the other, and what is left of its inflows lies on top. So slices are folded side by side first. Per key, one row a slice, these summaries are
then composed in order: which part of which earlier slice's rest is taken by which slice, and what is owed when nothing is left. With that the
takes of one slice meet the rest of another, piece by piece, again side by side. No task sees more of a key than one slice, one slice's
rest and a row for each slice.

A change pushes one segment at most, so a segment is known by the change that pushed it: numbers are given to pushes in order, by slice
with the number of those before, and what pops a segment looks its number up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.functions.session import by_key, small_batches, written
from strataq.operators.fold import KEY, MOVES, _schema, fold_key

#: Changes of a slice, unless the caller says otherwise.
SLICE = 1 << 14

_L = "array<long>"
CHANGES = f"slice long, whole boolean, ts {_L}, events {_L}, amounts {_L}"
ROWS = "t long, event_id long, sign int, odt long, amount long, owner_t long, owner_event long"
LOCAL = f"slice long, first_t long, last_t long, take_ts {_L}, take_events {_L}, takes {_L}, left_odts {_L}, left_amounts {_L}, left_ts {_L}, left_events {_L}, row_fields array<array<long>>, ts {_L}, events {_L}, own_empty array<boolean>, taken {_L}"
PIECES = "slice long, of long, depth long, size long, top long, through boolean, prev_t long, prev_event long, owed long"
PLACES = "slice long, below long, clean boolean, fresh boolean"


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), _L: pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}


def _out(rows: list[dict], ddl: str, key: list[pa.Field]) -> pa.RecordBatch:
    fields = [*key, *(pa.field(c.split()[0], _ARROW[c.split()[1]]) for c in ddl.split(", "))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def _each(key: Sequence[str], ddl: str, f: Callable[[dict], Iterator[dict] | list[dict]], size: int = 4096):
    """Arrow code that maps a row to rows of ``ddl`` behind the row's key."""
    k = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields, rows = [b.schema.field(i) for i in range(k)], []
            for at in range(b.num_rows):
                (row,) = b.slice(at, 1).to_pylist()
                own = {c: row[c] for c in key}
                for made in f(row):
                    rows.append(own | made)
                    if len(rows) >= size:
                        yield _out(rows, ddl, fields)
                        rows = []
            if rows:
                yield _out(rows, ddl, fields)

    return run


def _packed(key: Sequence[str], slice_rows: int):
    """Changes in order to slices: a key that lies within a task and a slice is whole, others are cut."""
    k = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, at, edge, held, out, rows = TaskContext.get().partitionId() << 32, 0, None, True, None, [], 0
        fields = []

        def put(whole: bool) -> None:
            nonlocal number, rows
            out.append({**dict(zip(key, at)), "slice": part + number, "whole": whole, "ts": held[0], "events": held[1], "amounts": held[2]})
            number += 1
            rows += len(held[0])

        for b in batches:
            fields = [b.schema.field(i) for i in range(k)]
            for *own, event, t, amount in zip(*(c.to_pylist() for c in b.columns)):
                if held is None or own != at:
                    if held is not None:
                        put(not edge)
                        edge = False
                    at, held = own, ([], [], [])
                elif len(held[0]) >= slice_rows:
                    put(False)
                    edge, held = True, ([], [], [])
                held[0].append(t)
                held[1].append(event)
                held[2].append(amount)
                if rows >= slice_rows:
                    yield _out(out, CHANGES, fields)
                    out.clear()
                    rows = 0
        if held is not None:
            put(False)
        if out:
            yield _out(out, CHANGES, fields)

    return run


def _fold_whole(row: dict) -> Iterator[dict]:
    made, _, _ = fold_key(zip(row["ts"], row["amounts"]))
    for t, e, each in zip(row["ts"], row["events"], made):
        for sign, nonce, odt, amount in each:
            yield {"event_id": e, "t": t, "sign": sign, "nonce": nonce, "odt": odt, "amount": amount}


def _fold_slice(row: dict) -> list[dict]:
    """A slice folded over an unknown stack."""
    stack: list[tuple[int, int, int, int]] = []  # origin time, amount, and the change that pushed it
    rows, takes, own_empty, taken, total = [], [], [], [], 0
    for t, e, amount in zip(row["ts"], row["events"], row["amounts"]):
        if amount >= 0:
            stack.append((t, amount, t, e))
            rows.append((t, e, 1, t, amount, t, e))
        else:
            owed = -amount
            while owed > 0 and stack:
                odt, a, *owner = stack.pop()
                rows.append((t, e, -1, odt, a, *owner))
                if a > owed:
                    stack.append((odt, a - owed, t, e))
                    rows.append((t, e, 1, odt, a - owed, t, e))
                owed -= min(a, owed)
            if owed:
                takes.append((t, e, owed))
                total += owed
        own_empty.append(not stack)
        taken.append(total)
    column = lambda what, n: [list(c) for c in zip(*what)] or [[]] * n
    take, left = column(takes, 3), column(stack, 4)
    return [{
        "slice": row["slice"], "first_t": row["ts"][0], "last_t": row["ts"][-1], "take_ts": take[0], "take_events": take[1], "takes": take[2], "left_odts": left[0], "left_amounts": left[1],
        "left_ts": left[2], "left_events": left[3], "row_fields": column(rows, 7), "ts": row["ts"], "events": row["events"], "own_empty": own_empty, "taken": taken,
    }]


def _compose(key: Sequence[str]):
    """Summaries of a key's slices in order to pieces (what slice takes which part of whose rest) and places (what lies below each slice)."""
    k = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rests, owed, owed_by, empty, last_t = None, [], 0, (None, None), True, None
        for b in batches:
            fields, rows = [b.schema.field(i) for i in range(k)], []
            for *own, number, take, left, n_left, zero_below, first_t, until_t, by_t, by_event in zip(*(c.to_pylist() for c in b.columns)):
                if own != at:
                    at, rests, owed, owed_by, empty, last_t = own, [], 0, (None, None), True, None
                me = dict(zip(key, own)) | {"slice": number}
                below = rests[-1]["under"] + rests[-1]["left"] if rests else 0
                clean = not owed and (not rests or (rests[0]["left"] > 0 and not rests[0]["zero"]))
                rows.append(me | {"below": below, "clean": clean, "fresh": empty and last_t != first_t})
                depth = 0
                while depth < take and rests:
                    r = rests[-1]
                    size = min(r["left"], take - depth)
                    through = take - depth > r["left"]
                    rows.append(me | {"of": r["slice"], "depth": depth, "size": size, "top": r["left"], "through": through, "prev_t": r["prev"][0], "prev_event": r["prev"][1]})
                    depth += size
                    r["left"] -= size
                    r["prev"] = (by_t, by_event)
                    if through or (r["left"] == 0 and not r["zero"]):
                        rests.pop()
                if depth < take:
                    rows.append(me | {"depth": depth, "size": take - depth, "prev_t": owed_by[0], "prev_event": owed_by[1], "owed": owed})
                    owed, owed_by = owed + take - depth, (by_t, by_event)
                if n_left:
                    under = rests[-1]["under"] + rests[-1]["left"] if rests else 0
                    rests.append({"slice": number, "left": left, "under": under, "zero": zero_below, "prev": (None, None)})
                empty, last_t = not rests and not owed, until_t
            yield _out(rows, f"{PIECES}, {PLACES.removeprefix('slice long, ')}", fields)

    return run


def _meet(row: dict) -> Iterator[dict]:
    """The takes of a slice that fall into a piece, and the segments there: pops, and what a take leaves of the last."""

    def told(t: int, e: int, sign: int, odt: int, amount: int, owner: tuple) -> dict:
        return {"t": t, "event_id": e, "sign": sign, "odt": odt, "amount": amount, "owner_t": owner[0], "owner_event": owner[1]}

    lo, hi = row["depth"], row["depth"] + row["size"]
    before, owed, owner = 0, row["owed"], (row["prev_t"], row["prev_event"])
    segments = []  # from the bottom, each with how much of it lies below the piece's top
    if row["of"] is not None:
        at = 0
        for odt, a, t, e in zip(row["left_odts"], row["left_amounts"], row["left_ts"], row["left_events"]):
            if at < row["top"] or (a == 0 and at == row["top"]):
                segments.append((odt, a, t, e) if at + a <= row["top"] else (odt, row["top"] - at, *owner))
            at += a
    for t, e, x in zip(row["take_ts"], row["take_events"], row["takes"]):
        begin, end = before, before + x
        before = end
        if end <= lo:
            continue
        if row["of"] is None:
            if owed:
                yield told(t, e, -1, 0, -owed, owner)
            owed, owner = owed + end - max(begin, lo), (t, e)
            yield told(t, e, 1, 0, -owed, owner)
            continue
        need = min(end, hi) - max(begin, lo)
        while segments and (need > 0 or end > hi):  # what goes on below takes the empty segments at this rest's bottom too
            odt, a, *by = segments.pop()
            yield told(t, e, -1, odt, a, by)
            if a > need:
                segments.append((odt, a - need, t, e))
                yield told(t, e, 1, odt, a - need, (t, e))
            need -= min(a, need)
        if end >= hi and not (end == hi and row["through"]):
            return


def _starts(row: dict) -> Iterator[dict]:
    """The changes of a slice before which the stack was empty at the end of a block, so that numbers begin anew."""
    last, empty = None, False
    for k, (t, e, own, taken) in enumerate(zip(row["ts"], row["events"], row["own_empty"], row["taken"])):
        if (row["fresh"] if k == 0 else empty and t != last):
            yield {"slice": row["slice"], "t": t, "event_id": e}
        last, empty = t, own and row["clean"] and taken == row["below"]


def lifo_ledger_sliced(changes: DataFrame, key: Sequence[str] = KEY, slice_rows: int = SLICE) -> DataFrame:
    """The rows of ``fold.lifo_ledger`` for keys of any size: no task takes more than a slice of a key's changes.

    Changes are dealt by ranges of (key, t, event_id); (t, event_id) is unique within a key. Keys that lie within a range and a slice are folded there. A null is a key like
    any other, and an empty table gives none.
    """
    key = list(key)
    small_batches(changes.sparkSession, 256)  # a row holds up to a slice
    order = [F.col(c).asc_nulls_first() for c in key] + [F.col("t").asc(), F.col("event_id").asc()]
    ordered = changes.select(*key, "event_id", "t", "amount").repartitionByRange(*order).sortWithinPartitions(*order)
    packed = written(ordered.mapInArrow(_packed(key, slice_rows), _schema(changes, key, CHANGES)))
    whole = packed.where("whole").mapInArrow(_each(key, MOVES, _fold_whole), _schema(changes, key, MOVES))

    local = written(packed.where("not whole").mapInArrow(_each(key, LOCAL, _fold_slice, 1), _schema(changes, key, LOCAL)))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    summary = local.select(
        *key, "slice", total("takes").alias("take"), total("left_amounts").alias("left"), F.size("left_odts").alias("n_left"), F.coalesce(F.get("left_amounts", F.lit(0)) == 0, F.lit(False)).alias("zero"),
        "first_t", "last_t", F.try_element_at("take_ts", F.lit(-1)).alias("by_t"), F.try_element_at("take_events", F.lit(-1)).alias("by_event"),
    )
    composed = written(by_key(summary, *key).sortWithinPartitions(*key, "slice").mapInArrow(_compose(key), _schema(changes, key, f"{PIECES}, {PLACES.removeprefix('slice long, ')}")))

    pieces = composed.where("size is not null").select("slice", "of", "depth", "size", "top", "through", "prev_t", "prev_event", "owed")
    takes = local.select(*key, "slice", "take_ts", "take_events", "takes")
    rests = local.select(F.col("slice").alias("of"), "left_odts", "left_amounts", "left_ts", "left_events")
    met = takes.join(pieces, "slice").join(rests, "of", "left").select(*key, *[c for c in [*_names(PIECES), "take_ts", "take_events", "takes", "left_odts", "left_amounts", "left_ts", "left_events"]])
    below = met.mapInArrow(_each(key, f"slice long, {ROWS}", lambda r: ({"slice": r["slice"]} | x for x in _meet(r))), _schema(changes, key, f"slice long, {ROWS}"))
    each = local.select(*key, "slice", F.explode(F.arrays_zip(*[F.get("row_fields", F.lit(n)).alias(f"f{n}") for n in range(7)])).alias("x"))
    inner = each.select(*key, "slice", *[F.col(f"x.f{n}").cast("int" if c == "sign" else "long").alias(c) for n, c in enumerate(_names(ROWS))])
    moves = written(inner.unionByName(below))

    places = composed.where("below is not null").select("slice", "below", "clean", "fresh")
    starts = local.select(*key, "slice", "ts", "events", "own_empty", "taken").join(places, "slice")
    starts = starts.select(*key, "slice", "ts", "events", "own_empty", "taken", "below", "clean", "fresh").mapInArrow(_each(key, "slice long, t long, event_id long", _starts), _schema(changes, key, "slice long, t long, event_id long"))

    # numbers of pushes: within a slice, then with what earlier slices have pushed since numbers last began anew
    both = moves.where("sign = 1").select(*key, "slice", "t", "event_id", F.lit(0).alias("anew")).unionByName(starts.withColumn("anew", F.lit(1)))
    here = W.partitionBy("slice").orderBy("t", "event_id", F.desc("anew"))
    run = both.withColumn("period", F.sum("anew").over(here.rowsBetween(W.unboundedPreceding, 0)))
    pushes = run.where("anew = 0").withColumn("own", F.row_number().over(W.partitionBy("slice", "period").orderBy("t", "event_id")))
    ends = run.groupBy("slice", "period").agg(F.sum(1 - F.col("anew")).alias("n")).groupBy("slice").agg(F.max("period").alias("periods"), F.max_by("n", "period").alias("tail"))
    slices = composed.where("below is not null").select(*key, "slice").join(ends, "slice", "left").fillna(0, ["periods", "tail"])
    by_slice = W.partitionBy(*key).orderBy("slice")
    span = slices.withColumn("span", F.sum(F.when(F.col("periods") > 0, 1).otherwise(0)).over(by_slice.rowsBetween(W.unboundedPreceding, 0)))
    offsets = span.withColumn("upto", F.sum("tail").over(W.partitionBy(*key, "span").orderBy("slice").rowsBetween(W.unboundedPreceding, 0))).withColumn("offset", F.coalesce(F.lag("upto").over(by_slice), F.lit(0))).select("slice", "offset")
    numbered = pushes.join(offsets, "slice").select(*key, F.col("t").alias("owner_t"), F.col("event_id").alias("owner_event"), (F.col("own") + F.when(F.col("period") == 0, F.col("offset")).otherwise(0)).cast("long").alias("nonce"))
    m, n = moves.alias("m"), numbered.alias("n")
    on = [F.col(f"m.{c}").eqNullSafe(F.col(f"n.{c}")) for c in [*key, "owner_t", "owner_event"]]
    cut = m.join(n, on).select(*[F.col(f"m.{c}").alias(c) for c in key], "m.event_id", "m.t", "m.sign", "n.nonce", "m.odt", "m.amount")
    return whole.unionByName(cut)
