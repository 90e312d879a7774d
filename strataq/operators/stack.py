"""Stacks by windows and by expressions: how deep an outflow reaches, and the fold of a small key as one expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.operators.fold import KEY

SEGMENT = "struct<odt:bigint,amount:bigint>"


def pop_boundary(segments: DataFrame, outflows: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, owed, depth, covered, odt): how far an outflow of ``owed`` by key reaches into its live ``segments`` (key, nonce, odt, amount).

    depth: the first place from the top where the running sum is ``owed`` or more, which counts as a liability lowers it again and is null where no
    sum is enough; covered: the sum there; odt: the origin there. One outflow a key; a key without segments has none of the three.
    """
    top = W.partitionBy(*key).orderBy(F.desc("nonce"))
    sums = segments.withColumn("place", F.row_number().over(top)).withColumn("covered", F.sum("amount").over(top.rowsBetween(W.unboundedPreceding, 0)))
    s, o = sums.alias("s"), outflows.alias("o")
    met = o.join(s, [F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")) for c in key], "left")
    enough = F.col("s.covered") >= F.col("o.owed")
    first = F.min(F.when(enough, F.struct("s.place", "s.covered", "s.odt"))).alias("b")
    found = met.groupBy(*[F.col(f"o.{c}") for c in key], F.col("o.owed")).agg(first)
    return found.select(*key, "owed", F.col("b.place").alias("depth"), F.col("b.covered").alias("covered"), F.col("b.odt").alias("odt"))


def _after(stack: Column, change: Column) -> Column:
    """The stack, from the bottom, behind one change: an expression without Python."""
    segment = lambda odt, amount: F.array(F.struct(odt.cast("long").alias("odt"), amount.cast("long").alias("amount")))
    owed = -change["amount"]
    amounts = F.reverse(F.transform(stack, lambda s: s["amount"]))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"))
    # from the top until the running sum is enough: how many are popped, and their sum
    popped = F.aggregate(amounts, none, lambda a, x: F.when(a["sum"] < owed, F.struct((a["n"] + 1).alias("n"), (a["sum"] + x).alias("sum"))).otherwise(a))

    def drained(p: Column) -> Column:
        kept = F.slice(stack, F.lit(1), F.size(stack) - p["n"])
        last = F.when(p["sum"] < owed, F.lit(0).cast("long")).otherwise(F.get(stack, F.size(stack) - p["n"])["odt"])
        return F.when(p["sum"] == owed, kept).otherwise(F.concat(kept, segment(last, p["sum"] - owed)))

    # an array of one is how an expression gets a name
    return F.when(change["amount"] >= 0, F.concat(stack, segment(change["t"], change["amount"]))).otherwise(F.get(F.transform(F.array(popped), drained), 0))


def stack_by_expression(changes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, stack array<struct<odt, amount>>): the live stack of each key, from the bottom, as one ``aggregate`` over its changes in order.

    A key's changes are one array and each step makes its stack anew, so this is for keys of some thousand changes; larger ones are
    ``fold.lifo_ledger``'s or ``hot_fold.lifo_ledger_sliced``'s.
    """
    ordered = F.sort_array(F.collect_list(F.struct("t", "event_id", "amount")))
    return changes.groupBy(*key).agg(F.aggregate(ordered, F.array().cast(f"array<{SEGMENT}>"), _after).alias("stack"))
