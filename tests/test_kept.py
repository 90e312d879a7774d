import random
import re
import uuid

import pytest

from strataq.operators import fold, kept

SCHEMA = "address long, event_id long, t long, amount long"


def made(rnd, n, keys=9, none=True):
    return [(rnd.choice([None, *range(keys)] if none else range(keys)), i, 10 + i // 3, rnd.randint(-5, 5)) for i in range(n)]


def sorted_rows(df):
    return sorted(map(tuple, df.select("address", "event_id", "t", "sign", "nonce", "odt", "amount").collect()), key=repr)


@pytest.fixture
def new(spark, tmp_path):
    names = []

    def make(folder="a", **more):
        names.append(f"kept_{uuid.uuid4().hex}")
        return kept.Kept(spark, f"{tmp_path}/{folder}", names[-1], **{"buckets": 4, "top": 2} | more)

    yield make
    for n in names:
        for t in ("segments", "heads"):
            spark.sql(f"DROP TABLE IF EXISTS {n}_{t}")


def test_batches_with_one_lost_give_the_batch_ledger(spark, new):
    data = made(random.Random(1), 240)
    want = sorted_rows(fold.lifo_ledger(spark.createDataFrame(data, SCHEMA)))
    batch = lambda k: spark.createDataFrame(data[48 * k : 48 * k + 48], SCHEMA)
    state = new()
    for k in range(5):
        if k == 2:
            state.write(k, batch(k))  # lost before it was committed
            state = new()  # another session would begin like this
            assert len(state.committed()) == 3  # two batches and the summary
        once = sorted_rows(state.apply(k, batch(k)))
        assert once == sorted_rows(state.apply(k, batch(k)))  # done once, however often it is sent
        if k in (1, 3):
            state.compact()
            assert len(state.live()) == 1
    assert sorted_rows(state.output()) == want
    whole = fold.fold_state(fold.lifo_ledger(spark.createDataFrame(data, SCHEMA)))
    for mine, theirs in zip(state.state(), whole):
        assert sorted(map(tuple, mine.collect()), key=repr) == sorted(map(tuple, theirs.select(*mine.columns).collect()), key=repr)
    with pytest.raises(ValueError):
        new("b").apply(3, batch(0)) and state.apply(1, batch(1)) and state.compact()
        late = new("b")
        late.apply(2, batch(0))


def test_a_read_of_touched_keys_leaves_the_state_where_it_lies(spark, new):
    data = made(random.Random(2), 300, 50, none=False)
    state = new(buckets=8)
    for k in range(3):
        state.apply(k, spark.createDataFrame(data[100 * k : 100 * k + 100], SCHEMA))
    touched = spark.createDataFrame([(7,)], "address long")
    few = state.segments(touched)
    plan = few._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    tree = plan.split("\n\n\n")[0]
    lines = tree.splitlines()
    scans = [k for k, x in enumerate(lines) if "Scan parquet" in x]
    depth = lambda x: len(x) - len(x.lstrip(" :+-|"))
    for k in scans:  # no exchange between a scan of the state and the join that prunes it
        above, d = [], depth(lines[k])
        for x in reversed(lines[:k]):
            if depth(x) < d:
                above.append(x)
                d = depth(x)
                if "Join" in x:
                    break
        assert any("Join" in x for x in above) and not any("Exchange" in x for x in above), tree
    assert "SelectedBucketsCount: 1 out of 8" in plan and re.search(r"PartitionFilters: \[.*part.* IN \(1,3,5\)", plan), plan
    want = {tuple(r) for r in fold.open_segments(fold.lifo_ledger(spark.createDataFrame(data, SCHEMA))).where("address = 7").collect()}
    assert {tuple(r) for r in few.collect()} == want != set()


def test_a_stream_is_carried_on_after_a_stop(spark, new, tmp_path):
    data = made(random.Random(3), 120)
    for n in range(4):
        spark.createDataFrame(data[30 * n : 30 * n + 30], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/n={n}")
    files = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    state = new("s")
    lost = []

    def once_lost(batch, number):
        if number == 2 and not lost:
            lost.append(state.write(number, batch))
            raise RuntimeError("killed between write and commit")
        state.apply(number, batch)

    with pytest.raises(Exception, match="killed"):
        files().writeStream.foreachBatch(once_lost).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert state.committed() == [1, 3]
    kept.follow(files(), state, f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert sorted_rows(state.output()) == sorted_rows(fold.lifo_ledger(spark.createDataFrame(data, SCHEMA)))
