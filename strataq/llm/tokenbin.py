"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents as one stream, cut into blocks of 4096 ids. A block
stores its minimum, and of each id less the minimum the low ``width`` bits; ``width`` is what the
``percentile``-th of them needs. Ids that need more are exceptions: their places and high bits follow
in a list of their own. Behind the blocks stand the blocks' start offsets, so that any range of ids
can be read alone, then the documents' ids and token counts, then a footer.

    block    minimum u32, ids u32, exceptions u32, width u8, pad u8 * 3
             packed bits | places u16 * exceptions | high bits u32 * exceptions
    index    block starts u64 * blocks, doc ids i64 * docs, null flags u8 * docs, lengths u64 * docs
    footer   blocks u64, docs u64, ids u64, index offset u64, magic 8 bytes

Writing deals documents out in ranges of ascending doc_id; every task streams its range into files of
bounded size, first under a name of its own attempt, then renamed. A task that is run again writes the
same bytes under the same names and leaves alone what is there, so a lost executor costs its tasks only.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.llm import bpe
from strataq.llm.common import collector_paused, cut, small_batches

BLOCK = 4096
HEAD, FOOT = struct.Struct("<IIIB3x"), struct.Struct("<QQQQ8s")
MAGIC = b"PFORIDS1"
#: Widths whose packed bits are little-endian integers as they are.
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


# ---------------------------------------------------------------- blocks


def _bits(v: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs."""
    return np.frexp(v.astype(np.float64))[1]


def pack_blocks(ids: np.ndarray, percentile: float = 0.97) -> list[bytes]:
    """The blocks of a stream of ids."""
    out = []
    for at in range(0, len(ids), BLOCK):
        x = ids[at : at + BLOCK]
        least = int(x.min())
        d = x - np.uint32(least)
        k = min(len(d) - 1, int(percentile * len(d)))
        width = int(_bits(np.partition(d, k)[k : k + 1])[0])
        over = np.flatnonzero(d >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
        if width in WHOLE:
            low = d.astype(WHOLE[width])
        else:
            low = np.packbits(((d[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8).ravel(), bitorder="little")
        out.append(
            HEAD.pack(least, len(x), len(over), width)
            + low.tobytes()
            + over.astype("<u2").tobytes()
            + (d[over] >> np.uint32(width)).astype("<u4").tobytes()
        )
    return out


def unpack_block(data: memoryview, at: int) -> np.ndarray:
    """The ids of the block that starts at ``at``."""
    least, n, n_over, width = HEAD.unpack_from(data, at)
    at += HEAD.size
    size = (n * width + 7) // 8
    d = np.zeros(n, np.uint32)
    if width in WHOLE:
        d = np.frombuffer(data, WHOLE[width], n, at).astype(np.uint32)
    elif width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        whole = np.zeros((n, 32 if width > 16 else 16), np.uint8)
        whole[:, :width] = bits
        d = np.packbits(whole, axis=1, bitorder="little").view("<u4" if width > 16 else "<u2").ravel().astype(np.uint32)
    if n_over:
        places = np.frombuffer(data, "<u2", n_over, at + size)
        d[places] |= np.frombuffer(data, "<u4", n_over, at + size + 2 * n_over) << np.uint32(width)
    return d + np.uint32(least)


def file_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], percentile: float = 0.97) -> bytes:
    blocks = pack_blocks(ids, percentile)
    starts = np.cumsum([0, *map(len, blocks)])
    return b"".join(
        [
            *blocks,
            starts[:-1].astype("<u8").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array(lengths, "<u8").tobytes(),
            FOOT.pack(len(blocks), len(doc_ids), len(ids), int(starts[-1]), MAGIC),
        ]
    )


class TokenFile:
    """Reader of one file's bytes."""

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        blocks, docs, self.n_ids, at, magic = FOOT.unpack_from(self.data, len(data) - FOOT.size)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.starts = np.frombuffer(data, "<u8", blocks, at)
        at += 8 * blocks
        ids = np.frombuffer(data, "<i8", docs, at)
        null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if n else int(d) for d, n in zip(ids, null)]
        self.lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)

    def read(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the stream; only the blocks that hold them are unpacked."""
        if hi <= lo:
            return np.empty(0, np.uint32)
        parts = [unpack_block(self.data, int(self.starts[k])) for k in range(lo // BLOCK, (hi - 1) // BLOCK + 1)]
        first = lo // BLOCK * BLOCK
        return np.concatenate(parts)[lo - first : hi - first]


# ---------------------------------------------------------------- writing and reading on Spark


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def publish(where, own: str, final: str) -> None:
    """Give an attempt's file its final name, unless another attempt has: its bytes are the same, so its file stays and ours goes.

    At no moment is a published file missing, so an attempt may be lost between any two steps.
    """
    if not where.get_file_info(final).is_file:
        try:
            where.move(own, final)
            return
        except OSError:  # not every store replaces on renaming; another attempt may have come first
            if not where.get_file_info(final).is_file:
                raise
    where.delete_file(own)


def write_tokens(
    docs: DataFrame, out: str, tokenizer: str, end_id: int, file_tokens: int = 4_000_000, percentile: float = 0.97, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode, append ``end_id`` to each document and write files under the folder ``out``, eagerly; each call's files have names of its own.

    Gives the manifest (part, seq, file, n_docs, n_tokens), whose order is that of ascending doc_id;
    rows without a doc_id come first, repeated doc_ids by their texts. A null or empty text is the end id
    alone. An empty table writes no file.
    """
    spark, job = docs.sparkSession, uuid.uuid4().hex[:12]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.worker_encoder(tokenizer, "packed", True)
        end = struct.pack("<I", end_id)
        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        where, folder = _files(out)
        parts, doc_ids, lengths, held, seq = [], [], [], 0, 0

        def flush():
            nonlocal parts, doc_ids, lengths, held, seq
            where.create_dir(folder, recursive=True)
            name = f"tokens-{job}-{part:06d}-{seq:05d}.pfor"
            with where.open_output_stream(f"{folder}/.{name}.{attempt}") as f:
                f.write(file_bytes(np.frombuffer(b"".join(parts), "<u4"), doc_ids, lengths, percentile))
            publish(where, f"{folder}/.{name}.{attempt}", f"{folder}/{name}")
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_tokens": pa.array([held], pa.int64())})
            parts, doc_ids, lengths, held, seq = [], [], [], 0, seq + 1
            return row

        for b in batches:
            with collector_paused():
                encoded = [b"".join(encode(t or "")) + end for t in b.column(1).to_pylist()]
            for d, x in zip(b.column(0).to_pylist(), encoded):
                parts.append(x)
                doc_ids.append(d)
                lengths.append(len(x) // 4)
                held += len(x) // 4
                if held >= file_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    small_batches(spark)
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return cut(ordered.mapInArrow(run, "part int, seq int, file string, n_docs long, n_tokens long"))


def read_tokens(manifest: DataFrame, out: str) -> DataFrame:
    """Read the files back: (doc_id, start, n_tokens, ids_crc32) per document.

    start counts the ids of all documents before it, over all files. Rows without a doc_id have none here and come first; an
    empty manifest gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = _files(out)
        for b in batches:
            for part, seq, name in zip(*(b.column(k).to_pylist() for k in (0, 1, 2))):
                with where.open_input_file(f"{folder}/{name}") as f:
                    tf = TokenFile(f.read())
                ids = tf.read(0, tf.n_ids).astype("<u4")
                ends = np.cumsum(tf.lengths)
                starts = ends - tf.lengths
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.full(n, part, np.int32)),
                        "seq": pa.array(np.full(n, seq, np.int32)),
                        "doc_id": pa.array(tf.doc_ids, pa.int64()),
                        "inner": pa.array(starts.astype(np.int64)),
                        "n_tokens": pa.array(tf.lengths),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    # One row a file: the window sums over file totals, not over documents.
    before = manifest.select("part", "seq", (F.sum("n_tokens").over(W.orderBy("part", "seq")) - F.col("n_tokens")).alias("base"))
    docs = manifest.mapInArrow(run, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(before, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
