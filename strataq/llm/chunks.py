"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes: h = (h << 1) + G[byte], of which 32 bits remember the last 32 bytes.
A chunk ends where the hash is larger than at the ``reach`` bytes before and at least as large as at the ``reach`` bytes
after, so ends are at least ``reach`` + 1 apart, depend on the bytes nearby alone, and fall into step again right behind an
insertion. Runs without such an end (one byte repeated) are cut at ``most`` bytes. Ends are moved to the next
character boundary.

Chunks are told apart by a 128-bit digest. Texts are chunked once to count digests and once more to
look up the repeated ones, which costs less than to keep all chunks on disk. A digest found at two places or more marks repeated text; a run of repeated
chunks of at least ``least_words`` words or ``least_chars`` characters is a repeated passage. The first place of a digest, by doc_id and
offset, is the original and stays; the other places are removed. A digest with a large share of all places is dealt to many tasks, and runs
are numbered by a window over a document's chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.llm.common import arrow_map, cut, join_by_share, row_key, utf8

REACH, MOST = 20, 1024
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte, by doubling: the hash over 2m bytes from two over m."""
    h = GEAR[data]
    for m in (1, 2, 4, 8, 16):
        h[m:] = h[m:] + (h[:-m] << np.uint32(m))
    return h


def _peak(h: np.ndarray, reach: int) -> np.ndarray:
    """Largest of h[i+1 .. i+reach] for each i."""
    n, size = len(h), 1
    m = np.concatenate((h, np.zeros(reach, h.dtype)))
    while 2 * size <= reach:
        m[:-size] = np.maximum(m[:-size], m[size:])
        size *= 2
    return np.maximum(m[1 : n + 1], m[1 + reach - size : n + 1 + reach - size])


def ends(data: bytes, reach: int = REACH, most: int = MOST) -> list[int]:
    """Ends of the chunks of a text's UTF-8 bytes, the last one its length."""
    n = len(data)
    if n == 0:
        return []
    b = np.frombuffer(data, np.uint8)
    if n <= reach:
        return [n]
    h = gear(b)
    at = np.flatnonzero((h > _peak(h[::-1], reach)[::-1]) & (h >= _peak(h, reach))) + 1
    inner = np.concatenate((at, [n]))
    while True:  # ends within a character move on, a byte at a time
        off = (inner < n) & ((b[np.minimum(inner, n - 1)] & 0xC0) == 0x80)
        if not off.any():
            break
        inner = inner + off
    out = np.unique(inner)
    wide = np.flatnonzero(np.diff(out, prepend=0) > most)
    for k in wide.tolist():
        lo = int(out[k - 1]) if k else 0
        more = np.arange(lo + most, int(out[k]), most)
        while ((b[more] & 0xC0) == 0x80).any():
            more = more + ((b[more] & 0xC0) == 0x80)
        inner = np.concatenate((inner, more))
    return np.unique(inner).tolist() if len(wide) else out.tolist()


def chunk_rows(text: bytes) -> tuple[np.ndarray, ...]:
    """(start, end in code points, words begun, two halves of the digest) of each chunk, as columns."""
    e = ends(text)
    if not e:
        return (np.zeros(0, np.int64),) * 5
    b = np.frombuffer(text, np.uint8)
    lead = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
    space = (b == 32) | ((b >= 9) & (b <= 13))
    words = np.concatenate(([0], np.cumsum(~space & np.concatenate(([True], space[:-1])))))
    at = np.array(e)
    s = np.concatenate(([0], at[:-1]))
    d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[x:y]) for x, y in zip(s.tolist(), e)]), "<i8").reshape(-1, 2)
    return lead[s], lead[at], words[at] - words[s], d[:, 0], d[:, 1]


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, start, end, words, d1, d2), one row for each chunk of each text."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("row_key"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [chunk_rows(t) for t in utf8(b.column(1))]
        cols = [np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64) for k in range(5)]
        of = pa.array(np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]))
        small = [pa.array(c.astype(np.int32)) for c in cols[:3]]
        return pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(2).take(of), *small, pa.array(cols[3]), pa.array(cols[4])], ["doc_id", "row_key", "start", "end", "words", "d1", "d2"])

    return arrow_map(slim, run, "doc_id long, row_key long, start int, end int, words int, d1 long, d2 long")


def _passages(places: DataFrame, least_words: int, least_chars: int) -> DataFrame:
    """(doc_id, row_key, repeated, removed) from repeated chunks (.., start, end, words, later).

    Touching chunks are merged, among all and among the later ones, and what is long enough is kept.
    """
    kinds = F.explode(F.when(F.col("later"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    each = places.select("doc_id", "row_key", "start", "end", "words", kinds.alias("kind"))
    order = W.partitionBy("doc_id", "row_key").orderBy("kind", "start")
    before = lambda c: F.lag(c).over(order)
    same = before("kind").eqNullSafe(F.col("kind"))
    each = each.withColumns({"again": same & before("start").eqNullSafe(F.col("start")), "joins": same & before("end").eqNullSafe(F.col("start"))})
    each = each.where("not again").withColumn("run", F.sum((~F.col("joins")).cast("int")).over(order))
    runs = each.groupBy("doc_id", "row_key", "kind", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").cast("int").alias("words"))
    runs = runs.where((F.col("words") >= least_words) | (F.col("end") - F.col("start") >= least_chars))
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("start", "end", "words"))))
    return runs.groupBy("doc_id", "row_key").agg(of(0).alias("repeated"), of(1).alias("removed"))


def repeats(docs: DataFrame, least_words: int = 12, least_chars: int = 120, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, repeated array<struct<start, end, words>>, removed likewise) for each row.

    ``repeated``: passages that occur at another place too, in this or another document; ``removed``: those
    of them that are not the first place. Code points, end exclusive. Null and empty texts have none; a document without an
    id comes before all others and its doc_id stays null; repeated rows are one document and get equal results; an empty table gives
    none; further columns are not read.
    """
    every = chunked(docs, id_col, text_col)
    at = F.struct("doc_id", "row_key", "start")
    counted = every.groupBy("d1", "d2").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    twice = cut(counted.where(F.col("first") != F.col("last")).select("d1", "d2", "first", "n"))
    found = join_by_share(every, twice, ["d1", "d2"], "n").select("doc_id", "row_key", "start", "end", "words", (at != F.col("first")).alias("later"))
    found = _passages(found, least_words, least_chars).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), "repeated", "removed")
    none = F.array().cast("array<struct<start:int,end:int,words:int>>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"))
    return rows.join(found, (F.col("row_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left").select(
        "doc_id", "n_chars", F.coalesce("repeated", none).alias("repeated"), F.coalesce("removed", none).alias("removed")
    )
