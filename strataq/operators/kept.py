"""A ledger that is carried on batch by batch, over a state that is kept in tables.

A batch's output feeds the state: a delta by (key, number) goes to a table that is partitioned by batch and bucketed by key, beside each
touched key's head. What is live is the sum of the deltas, so nothing is rewritten; ``compact`` sums them up now and then. A read of touched keys
joins the buckets as they lie, without an exchange of the state, and where the keys are few, opens only their buckets.

A batch counts when it is committed, which is the last thing written. One that was lost before is done again under its number and replaces what it
had written; one that is committed is not done again, and its output is read. So a stream whose batches have numbers gets each change into the ledger
once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.functions.session import written
from strataq.operators import fold

#: Keys that a read names one by one, so that only their buckets are opened; with more, most buckets have some.
NAMED = 1000
SEGMENTS = "nonce BIGINT, n INT, odt BIGINT, amount BIGINT"
HEADS = "next_nonce BIGINT, last_t BIGINT, last_event BIGINT, n BIGINT"


class Kept:
    """The state under ``root``. ``keys``: names and types of the key's columns, as in DDL; a null is a key like any other.

    ``name`` names the tables in the session's catalogue; they can be made anew over the same folder at any time.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, keys: str = "address BIGINT", buckets: int = 64, top: int = 64) -> None:
        self.spark, self.root, self.buckets, self.top = spark, root, buckets, top
        self.key: Sequence[str] = [k.split()[0] for k in keys.split(", ")]
        self.tables = {}
        for part, columns in (("segments", SEGMENTS), ("heads", HEADS)):
            self.tables[part] = f"{name}_{part}"
            spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.tables[part]} ({keys}, {columns}, part BIGINT) USING parquet PARTITIONED BY (part)
                CLUSTERED BY ({', '.join(self.key)}) SORTED BY ({', '.join(self.key)}) INTO {buckets} BUCKETS LOCATION '{root}/{part}'""")
            if self.committed():
                spark.catalog.recoverPartitions(self.tables[part])

    # A batch k is part 2k + 1; a summary of all batches before k is part 2k.

    def committed(self) -> list[int]:
        """Parts that count."""
        try:
            return sorted(r["part"] for r in self.spark.read.schema("at TIMESTAMP, part BIGINT").parquet(f"{self.root}/commits").select("part").distinct().collect())
        except AnalysisException:  # no batch yet
            return []

    def live(self) -> list[int]:
        """The last summary and the batches behind it."""
        parts = self.committed()
        since = max([p for p in parts if p % 2 == 0], default=0)
        return [p for p in parts if p >= since]

    def commit(self, part: int) -> None:
        self.spark.range(1).select(F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/part={part}")

    def drop(self) -> None:
        """Forget the tables; their files stay."""
        for t in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")

    def _of(self, table: str, touched: DataFrame | None) -> DataFrame:
        """Live rows of a table, of the ``touched`` keys or all."""
        rows = self.spark.table(self.tables[table]).where(F.col("part").isin(self.live()))
        if touched is None:
            return rows
        keys = touched.select(*self.key).distinct()
        absent = " or ".join(f"{k} is null" for k in self.key)
        some: Column = F.lit(True)
        named = [r[0] for r in keys.limit(NAMED + 1).collect()] if len(self.key) == 1 else None
        if named is not None and len(named) <= NAMED:
            some = F.col(self.key[0]).isin([k for k in named if k is not None])
        found = rows.where(some).join(keys.dropna().hint("merge"), list(self.key), "left_semi")  # by buckets as they lie
        if not keys.where(absent).limit(1).collect():
            return found
        unnamed = rows.where(absent)
        return found.unionByName(unnamed if len(self.key) == 1 else fold.alike(unnamed, keys.where(absent), self.key, "left_semi"))

    def segments(self, touched: DataFrame | None = None) -> DataFrame:
        """(key, nonce, odt, amount) of live segments."""
        return self._live(self._of("segments", touched)).where("n > 0").select(*self.key, "nonce", "odt", "amount")

    def _live(self, deltas: DataFrame) -> DataFrame:
        last = F.max_by(F.struct("odt", "amount"), F.when(F.col("odt").isNotNull(), F.col("part")))
        return deltas.groupBy(*self.key, "nonce").agg(F.sum("n").cast("int").alias("n"), last.alias("last")).select(*self.key, "nonce", "n", "last.odt", "last.amount")

    def heads(self, touched: DataFrame | None = None) -> DataFrame:
        last = F.max_by(F.struct("next_nonce", "last_t", "last_event", "n"), "part")
        return self._of("heads", touched).groupBy(*self.key).agg(last.alias("h")).select(*self.key, "h.*")

    def state(self, touched: DataFrame | None = None) -> fold.State:
        return fold.State(self.heads(touched), self.segments(touched))

    def output(self) -> DataFrame:
        """The ledger of all committed batches."""
        parts = [p for p in self.committed() if p % 2]
        return self.spark.read.parquet(f"{self.root}/output").where(F.col("part").isin(parts)).drop("part")

    def _put(self, table: str, part: int, rows: DataFrame) -> None:
        """``rows`` as a part of a table; rows that come from the same table have to be ``written`` first, as Spark doesn't overwrite what a plan reads."""
        dealt = rows.repartition(self.buckets, *self.key)  # a file a bucket
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.tables[table]} PARTITION (part = {part}) SELECT * FROM {{rows}}", rows=dealt)

    def write(self, number: int, changes: DataFrame) -> DataFrame:
        """A batch's output, written with the delta and heads that follow from it, but not committed."""
        part, place = 2 * number + 1, f"{self.root}/output/part={2 * number + 1}"
        before = self.state(changes)
        fold.resume(before, changes, self.top, self.key).write.mode("overwrite").parquet(place)
        out = self.spark.read.parquet(place)
        order = F.struct("t", "event_id")
        by_number = out.groupBy(*self.key, "nonce").agg(
            F.sum("sign").cast("int").alias("n"), F.max_by(F.struct("sign", "odt", "amount"), F.struct("t", "event_id", "sign")).alias("last")
        )
        pushed = F.col("last.sign") == 1
        delta = by_number.where((F.col("n") != 0) | pushed).select(*self.key, "nonce", "n", *[F.when(pushed, F.col(f"last.{c}")).alias(c) for c in ("odt", "amount")])
        self._put("segments", part, delta)
        ends = out.groupBy(*self.key).agg(
            F.max_by("nonce", F.when(F.col("sign") == 1, order)).alias("pushed"), F.max("t").alias("last_t"), F.max(order)["event_id"].alias("last_event"), F.sum("sign").alias("more")
        )
        e, h = ends.alias("e"), before.heads.alias("h")
        both = e.join(h, [F.col(f"e.{k}").eqNullSafe(F.col(f"h.{k}")) for k in self.key], "left")
        n = F.coalesce("h.n", F.lit(0)) + F.col("e.more")
        following = F.when(n == 0, 1).otherwise(F.coalesce(F.col("e.pushed") + 1, F.col("h.next_nonce")))
        self._put("heads", part, written(both.select(*[F.col(f"e.{k}") for k in self.key], following.cast("long").alias("next_nonce"), "e.last_t", "e.last_event", n.alias("n"))))
        return out

    def apply(self, number: int, changes: DataFrame) -> DataFrame:
        """The output of batch ``number``, done once; batches come in order of their numbers."""
        part = 2 * number + 1
        parts = self.committed()
        if part in parts:
            return self.spark.read.parquet(f"{self.root}/output/part={part}")
        if parts and max(parts) > part:
            raise ValueError(f"batch {number} comes after a later one")
        out = self.write(number, changes)
        self.commit(part)
        return out

    def compact(self) -> None:
        """Sum up the batches so far; reads then take the sum and what comes later."""
        last = max((p for p in self.committed() if p % 2), default=None)
        if last is not None:
            self._put("segments", last + 1, written(self._live(self._of("segments", None)).where("n > 0")))
            self._put("heads", last + 1, written(self.heads()))
            self.commit(last + 1)


def follow(changes: DataFrame, kept: Kept, checkpoint: str):
    """A stream of changes carried into ``kept``, a micro-batch a batch; the changes of a key come in order from batch to batch."""
    return changes.writeStream.foreachBatch(lambda batch, number: kept.apply(number, batch) and None).option("checkpointLocation", checkpoint)
