import random
import time

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strataq.operators import fold
from strataq.streaming import blocklog, blocks
from strataq.streaming import fold as streams

SCHEMA = "address long, event_id long, t long, amount long"


def test_stream_replay_equals_batch(spark, tmp_path):
    rnd = random.Random(4)
    data = [(rnd.randint(1, 5), i, 1000 + i, rnd.randint(-20, 20)) for i in range(120)]
    for n in range(4):
        spark.createDataFrame(data[30 * n : 30 * n + 30], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame(data[:10], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # late repeats
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streams.write_batches(streams.lifo_stream(files), f"{tmp_path}/out", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").drop("batch").collect())
    want = sorted(tuple(r) for r in fold.lifo_ledger(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == want


def test_stream_dedup_and_windows(spark, tmp_path):
    rows = [(i % 7, f"2024-01-01 00:{i:02d}:00", i) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, ts string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = streams.dedup_stream(stream, ["k"], "ts", "1 hour").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 7
    w = streams.windowed_sums(stream, "ts", "1 minute", "10 minutes", "v").writeStream.format("memory").outputMode("complete").queryName("sums").trigger(availableNow=True).start()
    w.awaitTermination()
    assert sorted((r.total, r.n) for r in spark.table("sums").collect()) == [(45, 10), (145, 10)]


@pytest.mark.parametrize("form", [blocks.lifo_blocks, blocks.lifo_grouped_blocks])
def test_blocks_in_any_order_equal_the_batch_fold(spark, tmp_path, form):
    rnd = random.Random(8)
    data = [(k, 10 * b + i, b, rnd.randint(-3, 3)) for b in range(1, 9) for i, k in enumerate(rnd.choices(range(1, 5), k=6))]
    schema = "address long, event_id long, block long, amount long"
    parts = [[d for d in data if d[2] in (2 * n + 1, 2 * n + 2)] for n in range(4)]
    late = [(1, 999, 3, 5)]
    for n, part in enumerate([*parts, late, [(9, 1000, 20, 1)], [(9, 1001, 30, 1)]]):
        rnd.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", blocks.ROCKSDB)
    try:
        files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = blocks.sorted_blocks(form(files), f"{tmp_path}/out", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").drop("batch").where("block < 20").collect()]
    batch = spark.createDataFrame(data, schema).withColumnRenamed("block", "t")
    assert sorted(got) == sorted(tuple(r) for r in fold.lifo_ledger(batch).collect())
    assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) >= 1  # late, and told


class Counted(dict):
    """A map state that counts what is asked of it."""

    def __init__(self) -> None:
        super().__init__()
        self.calls = 0

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.pop(key, None)


def test_only_the_top_of_a_stack_is_touched():
    rnd, state, stack, nonce = random.Random(2), Counted(), [], 1
    for k in range(600):
        amount = rnd.randint(-6, 9)
        top, calls = blocks.TopStack(state, len(stack)), state.calls
        want = fold.fold_one(stack, nonce, k + 1, amount)
        assert fold.fold_one(top, nonce, k + 1, amount) == want
        top.put()
        nonce = want[0]
        assert [state[(i,)] for i in range(len(state))] == stack
        assert state.calls - calls <= 2 * len(want[1])
    assert len(stack) > 100


def test_a_log_is_read_from_a_block_on(spark, tmp_path):
    schema, rnd = "block long, event_id long, amount long", random.Random(5)
    rows, names = {0: [], 1: []}, schema.split()[::2]
    for p in rows:
        block = 0
        for i in range(500):
            block += rnd.choice([0, 0, 1, 3])
            rows[p].append((block, 1000 * p + i, rnd.randint(-5, 5)))
        at = 0
        (tmp_path / "log" / f"partition={p}").mkdir(parents=True)
        while at < 500:
            part = rows[p][at : at + rnd.randint(20, 90)]
            pq.write_table(pa.table(dict(zip(names, zip(*part)))), tmp_path / "log" / f"partition={p}" / f"{at:020d}.parquet", row_group_size=16)
            at += len(part)
    log = blocklog.Log(f"{tmp_path}/log", "block")
    for p, each in rows.items():
        for block in (-1, 0, 1, 100, each[250][0], each[-1][0], each[-1][0] + 1):
            assert log.begin(p, block) == sum(r[0] < block for r in each)
    blocklog.register(spark)
    begin = rows[0][200][0]

    def run(limit):
        stream = spark.readStream.format("blocklog").schema(schema).options(path=f"{tmp_path}/log", startingBlock=str(begin), rows="60", progress=f"{tmp_path}/progress").load()
        q = streams.write_batches(stream, f"{tmp_path}/out", f"{tmp_path}/check").start()
        while q.isActive and (q.lastProgress is None or q.lastProgress["batchId"] < limit):
            q.processAllAvailable() if limit > 50 else time.sleep(0.05)
            if limit > 50:
                break
        q.stop()
        return q

    run(2)  # stopped on the way
    run(99)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*names).collect())
    assert got == sorted(r for each in rows.values() for r in each if r[0] >= begin)
    sizes = [r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("batch").count().collect()]
    assert max(sizes) <= 240 and len(sizes) >= 4  # two partitions of 60 rows a batch, twice that at most behind a stop


def test_pregrouped(spark):
    rows = [(1, 2, 5, 7), (1, 1, 5, 3), (2, 3, 5, 1)]
    got = blocks.pregrouped(spark.createDataFrame(rows, "address long, event_id long, block long, amount long")).collect()
    assert {(r.address, r.block): [tuple(c) for c in r.changes] for r in got} == {(1, 5): [(1, 3), (2, 7)], (2, 5): [(3, 1)]}


class Handle:
    """A processor's handle and states in memory, with a count of the calls."""

    def __init__(self) -> None:
        self.calls, self.timers = 0, []

    def registerTimer(self, at):
        self.calls, self.timers = self.calls + 1, [*self.timers, at]

    def _state(self, *_):
        return State(self)

    getMapState = getValueState = getListState = _state


class State(dict):
    def __init__(self, handle) -> None:
        super().__init__()
        self.handle, self.value = handle, None

    def _call(self, made=None):
        self.handle.calls += 1
        return made

    def get(self):
        return self._call(self.value)

    def exists(self):
        return self._call(self.value is not None)

    def clear(self):
        self.value = self._call()

    def put(self, value):
        self.value = self._call(value)

    def update(self, value):
        self.value = self._call(value)

    def appendList(self, rows):
        self.value = self._call([*(self.value or []), *rows])

    def getValue(self, key):
        return self._call(self[key])

    def updateValue(self, key, value):
        self[key] = self._call(value)

    def removeKey(self, key):
        self._call(self.pop(key, None))

    def iterator(self):
        return iter(list(self._call(self.items())))


def test_a_key_is_called_once_for_all_blocks_that_are_over():
    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    rnd, handle, p, got, total = random.Random(3), Handle(), blocks.BlockFold(), [], 0
    p.init(handle)
    data = [(b, 3 * b + i, rnd.randint(-9, 11)) for b in range(1, 1200) for i in range(3)]
    for lo in range(1, 1200, 100):
        part = [d for d in data if lo <= d[0] < lo + 100]
        rnd.shuffle(part)
        list(p.handleInputRows((7,), iter([pd.DataFrame(part, columns=["block", "event_id", "amount"])]), None))
        over, before = 1000 * (lo + 97), handle.calls  # the newest blocks still wait
        while due := [t for t in handle.timers if t <= over]:
            handle.timers.remove(due[0])
            for pdf in p.handleExpiredTimer((7,), Now(over), Now(due[0])):
                got += pdf.itertuples(index=False, name=None)
        total += handle.calls - before
    for t in list(handle.timers):
        for pdf in p.handleExpiredTimer((7,), Now(1_300_000), Now(t)):
            got += pdf.itertuples(index=False, name=None)
    want = fold.fold_key([(b, a) for b, _, a in data])[0]
    assert [tuple(map(int, r)) for r in got] == [(7, e, b, *m) for (b, e, _), made in zip(data, want) for m in made]
    assert len(p.kept) > 100 and total < len(data) // 2  # deep enough to reach below what is at hand
