"""A stream out of a partitioned log, begun at a block.

The log is a folder with a folder per partition, ``partition=0`` and so on, of Parquet segments that are named by the offset of their first row
and hold rows in order of block, as a broker's segments do: 00000000000000000000.parquet, 00000000000000001200.parquet. Offsets of a partition
run on from segment to segment. Where a block begins is found by binary search, over segments by their first block, then over a segment's row
groups and rows; nothing before it is read.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from strataq.functions.session import by_key


class Log:
    """Segments of the partitions under a folder."""

    def __init__(self, folder: str, block: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.block = block

    def partitions(self) -> list[int]:
        found = self.fs.get_file_info(fs.FileSelector(self.path))
        return sorted(int(f.base_name.split("=")[1]) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("partition="))

    def segments(self, partition: int) -> list[tuple[int, str]]:
        """(offset of the first row, path), in order."""
        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/partition={partition}"))
        return sorted((int(f.base_name.split(".")[0]), f.path) for f in found if f.base_name.endswith(".parquet"))

    def open(self, path: str) -> pq.ParquetFile:
        return pq.ParquetFile(self.fs.open_input_file(path))

    def end(self, partition: int) -> int:
        """The offset behind the last row."""
        s = self.segments(partition)
        return s[-1][0] + self.open(s[-1][1]).metadata.num_rows if s else 0

    def first_block(self, path: str, group: int = 0) -> int:
        file = self.open(path)
        column = file.schema_arrow.get_field_index(self.block)
        told = file.metadata.row_group(group).column(column).statistics
        return told.min if told is not None and told.has_min_max else file.read_row_group(group, [self.block]).column(0)[0].as_py()

    def begin(self, partition: int, block: int) -> int:
        """The offset of the first row of ``block`` or later."""
        s = self.segments(partition)
        if not s:
            return 0
        # the block may begin in the segment before the first one that begins with it
        at = max(0, bisect_left(s, block, key=lambda x: self.first_block(x[1])) - 1)
        offset, path = s[at]
        file = self.open(path)
        groups = range(file.metadata.num_row_groups)
        group = max(0, bisect_left(groups, block, key=lambda g: self.first_block(path, g)) - 1)
        before = sum(file.metadata.row_group(g).num_rows for g in range(group))
        rows = file.read_row_group(group, [self.block]).column(0) if len(groups) else pa.chunked_array([[]])
        return offset + before + bisect_left(range(len(rows)), block, key=lambda k: rows[k].as_py())


class Span(InputPartition):
    def __init__(self, path: str, skip: int, rows: int) -> None:
        self.path, self.skip, self.rows = path, skip, rows


class Reader(DataSourceStreamReader):
    """Offsets by partition. A batch takes ``rows`` rows of a partition at most.

    What has been processed is noted under ``progress``, so that a query that is started again goes on with batches of that size; which rows are
    read then is Spark's own checkpoint's to say.
    """

    def __init__(self, options: dict, schema) -> None:
        self.log, self.schema = Log(options["path"], options.get("block", "block")), schema
        self.block, self.rows, self.progress = int(options.get("startingBlock", 0)), int(options.get("rows", 100_000)), options.get("progress")
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {str(p): self.log.begin(p, self.block) for p in self.log.partitions()}

    def noted(self) -> dict | None:
        if self.progress is None:
            return None
        where, path = fs.FileSystem.from_uri(self.progress)
        if where.get_file_info(path).type != fs.FileType.File:
            return None
        with where.open_input_stream(path) as f:
            return json.loads(f.read())

    def latestOffset(self) -> dict:
        at = self.at or self.noted() or self.initialOffset()
        self.at = {str(p): min(at.get(str(p), 0) + self.rows, self.log.end(p)) for p in self.log.partitions()}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.at = {p: max(o, (self.at or {}).get(p, 0)) for p, o in end.items()}
        out = []
        for p, to in end.items():
            since, segments = start.get(p, 0), self.log.segments(int(p))
            k = max(0, bisect_right(segments, since, key=lambda x: x[0]) - 1)
            for (first, path), (behind, _) in zip(segments[k:], [*segments[k + 1 :], (to, "")]):
                lo, hi = max(since, first), min(to, behind)
                if lo < hi:
                    out.append(Span(path, lo - first, hi - lo))
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        file, skip, left = self.log.open(partition.path), partition.skip, partition.rows
        for g in range(file.metadata.num_row_groups):
            n = file.metadata.row_group(g).num_rows
            if skip < n and left > 0:
                part = file.read_row_group(g, self.schema.fieldNames()).slice(skip, left)
                left -= part.num_rows
                yield from part.to_batches()
            skip = max(0, skip - n)

    def commit(self, end: dict) -> None:
        if self.progress is not None:
            where, path = fs.FileSystem.from_uri(self.progress)
            with where.open_output_stream(path) as f:
                f.write(json.dumps(end).encode())


class BlockLog(DataSource):
    """``readStream.format("blocklog")`` with a schema and the options path, startingBlock, block (the column's name), rows and progress."""

    @classmethod
    def name(cls) -> str:
        return "blocklog"

    def streamReader(self, schema) -> Reader:
        return Reader(self.options, schema)


def write_log(rows: DataFrame, folder: str, block: str, order: Sequence[str], partitions: int, segment: int = 50_000, key: str | None = None) -> DataFrame:
    """Write ``rows`` as a log, dealt by ``key`` (all to partition 0 without one) and in ``order`` within a partition, which begins with the block.

    Gives (partition, offset, rows) of the segments. A task writes one partition at a time and holds one segment; a segment that another attempt has
    written is written again, with the same rows.
    """
    names, dealt = rows.columns, F.pmod(F.xxhash64(key), F.lit(partitions)) if key else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        at, offset, held = None, 0, []

        def put() -> pa.RecordBatch:
            nonlocal offset, held
            table = pa.Table.from_batches(held)
            where.create_dir(f"{path}/partition={at}", recursive=True)
            pq.write_table(table, f"{path}/partition={at}/{offset:020d}.parquet", filesystem=where, row_group_size=4096)
            told = pa.RecordBatch.from_pydict({"partition": pa.array([at], pa.int64()), "offset": pa.array([offset], pa.int64()), "rows": pa.array([len(table)], pa.int64())})
            offset, held = offset + len(table), []
            return told

        for b in batches:
            cuts = [0, *(k for k in range(1, b.num_rows) if b.column(0)[k] != b.column(0)[k - 1]), b.num_rows] if b.num_rows else []
            for lo, hi in zip(cuts, cuts[1:]):
                if (p := b.column(0)[lo].as_py()) != at:
                    if held:
                        yield put()
                    at, offset, held = p, 0, []
                while lo < hi:
                    part = b.slice(lo, min(hi - lo, segment - sum(x.num_rows for x in held)))
                    held.append(pa.RecordBatch.from_arrays(part.columns[1:], names))
                    lo += part.num_rows
                    if sum(x.num_rows for x in held) == segment:
                        yield put()
        if held:
            yield put()

    parts = rows.select(dealt.cast("long").alias("__partition"), *names)
    return by_key(parts, "__partition").sortWithinPartitions("__partition", *order).mapInArrow(run, "partition long, offset long, rows long")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockLog)
