"""What several of the training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts can be long, so far fewer than Spark's own 10,000.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts takes in a Python worker; Spark reads the setting when a query runs, so it stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names.

    Where it names none, as in tests, a local master gets a folder of its own; on a cluster that is an error, as executors don't
    share local folders.
    """
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not re.match(r"local(\[[^]]*\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or sc.getCheckpointDir()


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder under the shared one, removed in the end; what is read from it must have been read by then."""
    folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        remove_folder(folder)


def remove_folder(uri: str) -> None:
    where, path = fs.FileSystem.from_uri(uri)
    if where.get_file_info(path).type == fs.FileType.Directory:
        where.delete_dir(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, with its lineage cut."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def arrow_map(
    df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Map Arrow batches one to one; ``f`` may return None for a batch without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = f(b)
            if out is not None:
                yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes, null as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def by_key(df: DataFrame, *key: str) -> DataFrame:
    """``df`` with all rows of a key in one partition, for Arrow code that Spark doesn't know to need that.

    Rows are dealt by a digest of the key. By the key itself Spark drops the exchange where a join or a union has dealt rows that way,
    and may then turn the join into a broadcast join that hasn't.
    """
    return df.repartition(F.xxhash64(*key))


def row_key(*columns: str) -> Column:
    """A 64-bit digest of the given columns, which tells rows of one id apart.

    Rows that agree in all of them share it; that is wanted, as such repeats get equal results.
    """
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in columns])


def join_by_share(rows: DataFrame, keys: DataFrame, key: list[str], n: str, parts: int = 10_000) -> DataFrame:
    """``rows`` joined with ``keys``, which has one row per ``key`` and in ``n`` the number of its rows, hot keys dealt to many tasks.

    A key with more than a ``parts``-th of all these rows is split into as many salts as it has such shares. Fewer than
    ``parts`` keys can have that many, so the list of them, which is broadcast, has a fixed bound, and so have the copies of their rows.
    """
    share = max(1, -(-(keys.agg(F.sum(n)).first()[0] or 0) // parts))
    salts = F.ceil(F.col(n) / share)
    hot = keys.where(F.col(n) > share).select(*key, salts.alias("__salts"))
    dealt = rows.join(F.broadcast(hot), key, "left")
    salt = F.coalesce(F.pmod(F.xxhash64(*[c for c in rows.columns if c not in key]), F.col("__salts")), F.lit(0))
    each = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col(n) > share, salts).otherwise(1) - 1)))
    return dealt.withColumn("__salt", salt).drop("__salts").join(each, [*key, "__salt"]).drop("__salt")


@contextmanager
def collector_paused() -> Iterator[None]:
    """No cyclic garbage collection meanwhile: a batch of texts makes many small objects and no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
