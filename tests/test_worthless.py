"""Events whose value rounds to nothing still move a small whole amount: their kind tells the sign."""

import datetime
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strataq.plans.registry import ORACLES, QUERIES
from tests.test_queries import rows

NAMES = "fold_by_contract seam_by_contract open_segments_antijoin circulation_by_asset profit_loss_by_asset dormant_by_asset age_consumed_by_asset".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rnd, at = random.Random(5), tmp_path_factory.mktemp("worthless")
    kinds, start = ["view", "click", "purchase", "signup", "error"], datetime.datetime(2024, 1, 1)
    data = [(i, rnd.randrange(4), rnd.choice(kinds), start + datetime.timedelta(hours=7 * i), rnd.choice([0.0, 0.004, 3.25])) for i in range(90)]
    names = ["event_id", "user_id", "event_type", "ts", "value"]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.timestamp("us"), pa.float64()))))
    pq.write_table(pa.table(dict(zip(names, zip(*data))), schema=schema), at / "events.parquet")
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_worthless_events_move_amounts(spark, folder, name):
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{folder}/events.parquet'")
    got, want = QUERIES[name](spark, folder).toPandas(), db.sql(ORACLES[name]).df()
    assert len(want) and rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))
