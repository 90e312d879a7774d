"""Session helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it names none, as in tests, a local master gets one of its own; on a cluster that is an error."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not re.match(r"local(\[[^]]*\])?$", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return named or sc.getCheckpointDir()


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder under the shared one, removed in the end; what is read from it must have been read by then."""
    uri = f"{shared_root(spark)}/{name}"
    try:
        yield uri
    finally:
        where, path = fs.FileSystem.from_uri(uri)
        if where.get_file_info(path).type == fs.FileType.Directory:
            where.delete_dir(path)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut; a lost executor costs no more than its tasks."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch_tables(spark: SparkSession, **frames: DataFrame) -> Iterator[None]:
    """``frames`` written once and known to SQL by their names for a while, as tables of this session alone."""
    for name, df in frames.items():
        written(df).createTempView(name)
    try:
        yield
    finally:
        for name in frames:
            spark.catalog.dropTempView(name)


def small_batches(spark: SparkSession, rows: int) -> None:
    """Let Arrow batches hold ``rows`` rows at most, for rows that hold arrays; Spark reads the setting when a query runs, so it stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def by_key(df: DataFrame, *key: str) -> DataFrame:
    """``df`` with all rows of a key in one partition, for code that Spark doesn't know to need that.

    Rows are dealt by a digest of the key. By the key itself Spark drops the exchange where a join or a union has dealt rows that way,
    and may then turn the join into a broadcast join that hasn't.
    """
    return df.repartition(F.xxhash64(*key))
