"""Queries that carry a stream over files of the tables to its end, and give what it has written.

Files come in spans of days; after each the stream is started, takes what is new as one micro-batch, and stops, so every query also goes on from its
checkpoint several times.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.functions.session import scratch_folder, table, written
from strataq.functions.time import DAY, HOUR, floor_to, micros
from strataq.operators import kept
from strataq.plans import base
from strataq.plans.base import BALANCE, CH, PAIRS, with_prelude
from strataq.plans.registry import query
from strataq.streaming import blocklog, blocks
from strataq.streaming import fold as streams

#: Time that comes in at once.
SPAN = 16 * DAY


@contextmanager
def _with(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def carried(spark: SparkSession, rows: DataFrame, time: str, size: int, write: Callable, last: DataFrame | None = None) -> DataFrame:
    """What ``write(stream, out, checkpoint)`` has written of ``rows`` that come in spans of ``size`` of ``time``; ``last`` comes behind them, to move the clock on."""
    lo, hi = rows.agg(F.min(time), F.max(time)).first()
    parts = [rows.where((F.col(time) >= s) & (F.col(time) < s + size)) for s in range(lo, hi + 1, size)] if lo is not None else [rows]
    if last is not None:
        parts.append(last)
    # a state is kept in as many parts as there are partitions, each of which costs something in every batch
    states = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2, spark.sparkContext.defaultParallelism))
    with scratch_folder(spark, f"stream-{uuid.uuid4().hex}") as at, _with(spark, "spark.sql.shuffle.partitions", str(states)):
        for k, part in enumerate(parts):
            part.write.parquet(f"{at}/in/n={k}")
            stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in/*")
            write(stream, f"{at}/out", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
        return written(spark.read.parquet(f"{at}/out").drop("batch"))


@query("stream_ledger", with_prelude("SELECT address, event_id, t, sign, nonce, odt, amount FROM ledger", "ledger"))
def stream_ledger(spark, sf_dir):
    """The ledger of a stream, a state a key, each micro-batch under its number."""
    return carried(spark, base.changes(spark, sf_dir), "t", SPAN, lambda s, out, check: streams.write_batches(streams.lifo_stream(s), out, check))


@query("stream_kept_ledger", with_prelude("SELECT address, event_id, t, sign, nonce, odt, amount FROM ledger", "ledger"))
def stream_kept(spark, sf_dir):
    """A stream carried into kept tables, a micro-batch a batch."""
    ch, name = base.changes(spark, sf_dir), f"kept_{uuid.uuid4().hex}"
    with scratch_folder(spark, name) as folder:
        state = kept.Kept(spark, folder, name, buckets=8)
        try:
            def carry(stream, out, check):
                def put(batch: DataFrame, number: int) -> None:
                    state.apply(number, batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

                return stream.writeStream.foreachBatch(put).option("checkpointLocation", check)

            return carried(spark, ch, "t", SPAN, carry)
        finally:
            state.drop()


_CH_HOURS = CH.replace("epoch_us(ts) AS t", "epoch_us(ts) // 3600000000 AS t")
_BLOCK_TWIN = with_prelude("SELECT address, event_id, t AS block, sign, nonce, odt, amount FROM ledger", _CH_HOURS, BALANCE, PAIRS)


def _by_blocks(spark, sf_dir, form) -> DataFrame:
    ch = base.changes(spark, sf_dir).select("address", "event_id", (floor_to("t", HOUR) / HOUR).cast("long").alias("block"), "amount")
    end = ch.agg(F.coalesce(F.max("block"), F.lit(0)).alias("end"))  # a further block of nobody's, so that the last one is over
    none = F.lit(-1).cast("long")
    last = end.select(none.alias("address"), none.alias("event_id"), (F.col("end") + 10).alias("block"), F.lit(1).cast("long").alias("amount"))
    with _with(spark, "spark.sql.streaming.stateStore.providerClass", blocks.ROCKSDB):
        out = carried(spark, ch, "block", SPAN // HOUR, lambda s, out, check: blocks.sorted_blocks(form(s), out, check), last)
    return out.where("address >= 0")


@query("stream_block_ledger", _BLOCK_TWIN)
def block_ledger(spark, sf_dir):
    """The ledger by a clock of blocks: changes wait, timers fold them, emptied keys go, rows are written in order."""
    return _by_blocks(spark, sf_dir, blocks.lifo_blocks)


@query("stream_grouped_ledger", _BLOCK_TWIN)
def grouped_ledger(spark, sf_dir):
    """A key's block gathered by one stateful operator before another folds it."""
    return _by_blocks(spark, sf_dir, blocks.lifo_grouped_blocks)


@query("stream_first_kinds", "SELECT DISTINCT user_id AS address, event_type AS kind FROM events")
def first_kinds(spark, sf_dir):
    """Of each key the first row alone, by a state that a watermark bounds."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("address"), F.col("event_type").alias("kind"), micros("ts").alias("t"))
    timed = lambda s: s.withColumn("ts", F.timestamp_micros("t"))
    return carried(spark, e, "t", SPAN, lambda s, out, check: streams.write_batches(streams.dedup_stream(timed(s), ["address", "kind"], "ts", "1000 days").select("address", "kind"), out, check))


@query("stream_hours", "SELECT epoch_us(ts) // 3600000000 AS hour, sum(round(value * 100)::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1")
def hours(spark, sf_dir):
    """Sums by hour, told when an hour is over; what came later would be dropped."""
    e = table(spark, sf_dir, "events").select(F.round(F.col("value") * 100).cast("long").alias("cents"), micros("ts").alias("t"))
    end = e.agg(F.coalesce(F.max("t"), F.lit(0)).alias("end"))
    last = end.select(F.lit(0).cast("long").alias("cents"), (F.col("end") + DAY).alias("t"))
    timed = lambda s: s.withColumn("ts", F.timestamp_micros("t"))
    out = carried(spark, e, "t", SPAN, lambda s, out, check: streams.write_batches(streams.windowed_sums(timed(s), "ts", "0 seconds", "1 hour", "cents").select(F.unix_micros("window.start").alias("t"), "total", "n"), out, check), last)
    over = end.first()[0]
    return out.where(F.col("t") <= over).select((F.col("t") / HOUR).cast("long").alias("hour"), "total", "n")


@query("stream_from_block", with_prelude("SELECT address, event_id, t // 3600000000 AS block, amount FROM ch WHERE t // 3600000000 >= (SELECT (min(t // 3600000000) + max(t // 3600000000)) // 2 FROM ch)", "ch"))
def from_block(spark, sf_dir):
    """Changes written to a partitioned log in order, and read from the middle block on; what lies before it isn't read."""
    ch = base.changes(spark, sf_dir).select("address", "event_id", (floor_to("t", HOUR) / HOUR).cast("long").alias("block"), "amount")
    lo, hi = ch.agg(F.min("block"), F.max("block")).first()
    blocklog.register(spark)
    with scratch_folder(spark, f"log-{uuid.uuid4().hex}") as at:
        written(blocklog.write_log(ch, f"{at}/log", "block", ["block", "event_id"], 4, segment=1000, key="address"))
        stream = spark.readStream.format("blocklog").schema(ch.schema).options(path=f"{at}/log", startingBlock=str(((lo or 0) + (hi or 0)) // 2), rows="1000000000").load()
        streams.write_batches(stream, f"{at}/out", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
        return written(spark.read.parquet(f"{at}/out").drop("batch"))
