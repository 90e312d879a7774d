"""The last-in-first-out fold as a table function for SQL: ``lifo(TABLE(changes) PARTITION BY address ORDER BY (t, event_id))``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from strataq.operators.fold import LEDGER, Segment, fold_one


@udtf(returnType=LEDGER)
class Lifo:
    """One instance a key: its rows come in order, and only the stack is held."""

    def __init__(self) -> None:
        self.stack: list[Segment] = []
        self.nonce, self.last = 1, None

    def eval(self, row: Row) -> Iterator[tuple]:
        if not self.stack and row["t"] != self.last:
            self.nonce = 1
        self.last = row["t"]
        self.nonce, moves = fold_one(self.stack, self.nonce, row["t"], row["amount"])
        for m in moves:
            yield (row["address"], row["event_id"], row["t"], *m)


def register(spark: SparkSession, name: str = "lifo") -> None:
    """Make the function known to SQL under ``name``; rows need address, event_id, t and amount."""
    spark.udtf.register(name, Lifo)
