"""Named predicates and source functions, as job specifications refer to them.

A predicate is a condition on the columns of transfers or changes; a source function has a dotted name and gives the rows that a job
reads. Both are looked up by name, so a specification stays data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name -> condition in SQL over (sender, receiver, cents, kind, from_label, to_label).
PREDICATES = {
    "only_in": "cents > 0 and sender <> receiver",
    "in_and_out": "sender <> receiver",
    "without_fees": "kind <> 'fee'",
    "burnt_fees": "kind = 'fee' and receiver is null",
    "exchanges_only": "from_label = 'exchange' or to_label = 'exchange'",
    "without_exchange_to_exchange": "not (coalesce(from_label, '') = 'exchange' and coalesce(to_label, '') = 'exchange')",
    "whales": "cents >= 30000000",
    "stakers": "to_label = 'staking'",
}
SOURCES: dict[str, Callable[..., DataFrame]] = {}


def source(name: str):
    """Register a source function under its dotted name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in SOURCES:
            raise ValueError(f"two sources named {name}")
        SOURCES[name] = f
        return f

    return add


def rows_of(name: str, transfers: DataFrame, *predicates: str) -> DataFrame:
    """The rows that the source function ``name`` gives of ``transfers``, where all named predicates hold; an unknown name is an error."""
    for p in predicates:
        if p not in PREDICATES:
            raise KeyError(f"no predicate named {p}")
        transfers = transfers.where(PREDICATES[p])
    return SOURCES[name](transfers)


@source("transfers.as_they_are")
def as_they_are(transfers: DataFrame) -> DataFrame:
    return transfers


@source("transfers.two_legs")
def two_legs(transfers: DataFrame) -> DataFrame:
    """Each transfer as two signed changes (address, amount, ..)."""
    legs = F.array(F.struct(F.col("sender").alias("address"), (-F.col("cents")).alias("amount")), F.struct(F.col("receiver").alias("address"), F.col("cents").alias("amount")))
    rest = [c for c in transfers.columns if c not in ("sender", "receiver", "cents")]
    return transfers.select(*rest, F.explode(legs).alias("leg")).select(*rest, "leg.*")


def settled(transfers: DataFrame) -> DataFrame:
    """What counts of raw transfers (sender, receiver, kind, block, ts, end_of_block).

    A transfer to oneself counts only as an end-of-block row behind the first block; approvals don't count, nor does what has neither block nor time.
    """
    own = F.col("sender") == F.col("receiver")
    begun = (F.col("block") > 0) | (F.col("ts") > 0)
    return transfers.where((~own | (F.col("end_of_block") & begun)) & (F.col("kind") != "APPROVE") & begun)
