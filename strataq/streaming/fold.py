"""Folds and deduplication over streams of changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.operators.fold import LEDGER, fold_one

STATE = "nonce long, last_t long, last_event long, nonces array<long>, odts array<long>, amounts array<long>"


def _advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Fold the batch's rows of one key in order; rows at or before the last one seen are late or repeated and drop out."""
    if state.exists:
        nonce, last_t, last_event, nonces, odts, amounts = state.get
        stack = list(zip(nonces, odts, amounts))
    else:
        nonce, last_t, last_event, stack = 1, -(1 << 62), -1, []
    out = []
    rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
    for event, t, amount in zip(rows["event_id"].tolist(), rows["t"].tolist(), rows["amount"].tolist()):
        if (t, event) <= (last_t, last_event):
            continue
        if not stack and t != last_t:
            nonce = 1
        nonce, moves = fold_one(stack, nonce, t, amount)
        out += [(key[0], event, t, *m) for m in moves]
        last_t, last_event = t, event
    columns = list(zip(*stack)) or [(), (), ()]
    state.update((nonce, last_t, last_event, *map(list, columns)))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in LEDGER.split(", ")])


def lifo_stream(changes: DataFrame) -> DataFrame:
    """The exact ledger of a stream of changes (address, event_id, t, amount): a state per key, appended rows.

    A batch's rows of a key are folded in order; exactly-once output follows from the checkpoint, as the
    fold depends on its input alone.
    """
    return changes.groupBy("address").applyInPandasWithState(_advance, LEDGER, STATE, "append", "NoTimeout")


def dedup_stream(events: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key, within a watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_sums(events: DataFrame, time: str, delay: str, size: str, value: str) -> DataFrame:
    """Sums by tumbling window; late rows beyond the watermark are dropped."""
    return events.withWatermark(time, delay).groupBy(F.window(time, size)).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def write_batches(stream: DataFrame, out: str, checkpoint: str):
    """Write each micro-batch under its own number, so that a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def read_kafka(spark, servers: str, topic: str, schema: str) -> DataFrame:
    """A Kafka topic of JSON rows from its earliest offset; needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def write_kafka(stream: DataFrame, servers: str, topic: str, checkpoint: str, key: str = "all"):
    """Rows as JSON under one constant key, which keeps them in one partition."""
    rows = stream.select(F.lit(key).alias("key"), F.to_json(F.struct("*")).alias("value"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
