"""Quality rules: measures of each document and the frequency of its lines across documents.

Lines are normalised (ASCII lower case, words joined by one space) and hashed with their host. A line that more than ``max_docs``
distinct documents of one host hold, whatever its length, is removed; documents that this leaves with too little are
rejected. The first document of the host that holds a line (by doc_id) keeps it, so that a text or passage that was copied often
stays once and its copies go.

The one pass over the texts gives a small row per document. Counting shuffles a hash per document and distinct line,
pre-aggregated; lines above the limit are joined back with hot lines dealt to many tasks.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import arrow_map, cut, join_by_share, row_key, utf8

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes], n: int = 5) -> int:
    """Words in n-word windows that the text holds twice or more."""
    if len(words) <= n:
        return 0
    grams = list(zip(*(words[k:] for k in range(n))))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    covered, until = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered += i + n - max(i, until)
            until = i + n
    return covered


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    code_points = lambda b: len(b) if b.isascii() else len(b.decode())
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACE):
            seen.add(line)
    return (
        len(words),
        code_points(text.translate(None, SPACE)),
        len(text) - len(text.translate(None, SYMBOLS)),
        dup,
        repeat_words(words),
    )


def line_hashes(text: bytes, host: bytes) -> list[dict]:
    """The distinct normalised lines of a text with a word: hash with the host, words, and the numbers of its lines."""
    out: dict[bytes, dict] = {}
    for k, line in enumerate(text.split(b"\n")):
        w = line.lower().split()
        if w:
            norm = b" ".join(w)
            if norm in out:
                out[norm]["no"].append(k)
            else:
                h = xxhash.xxh64_intdigest(host + b"\n" + norm)
                out[norm] = {"h": h - (1 << 64) if h >> 63 else h, "w": len(w), "no": [k]}
    return list(out.values())


def judge(
    docs: DataFrame, max_docs: int = 20, least_words: int = 10, least_left: int = 5, least_share: float = 0.2, most_repeats: int = 20,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """One row per document: row_key, doc_id, the measures, base_failed, removed_lines, removed_words, kept.

    A document is kept if it has ``least_words`` words, at most ``most_repeats`` percent of them in
    repeated 5-word windows, and the removal leaves at least ``least_left`` words and ``least_share`` of all.
    A null text counts as empty; a null host is a host of its own; a null doc_id stays null and comes last among the documents that
    hold a line; repeated rows are one document and get equal results; an empty table gives none; further columns are not read.
    """
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"), row_key(id_col, host_col, text_col).alias("row_key")
    )
    line = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32()), ("no", pa.list_(pa.int32()))]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(b.column(1))
        hosts = [b"\0" if h is None else h.encode() for h in b.column(2).to_pylist()]
        m = [pa.array(x, pa.int64()) for x in zip(*map(measure, texts))] if texts else [pa.array([], pa.int64())] * 5
        return pa.RecordBatch.from_arrays([b.column(0), b.column(3), *m, pa.array(list(map(line_hashes, texts, hosts)), line)], ["doc_id", "row_key", *MEASURES, "lines"])

    base = cut(arrow_map(slim, run, f"doc_id long, row_key long, {', '.join(f'{m} long' for m in MEASURES)}, lines array<struct<h long, w int, no array<int>>>"))
    once = base.select("doc_id", "row_key", "lines")
    if not once.groupBy("doc_id", "row_key").count().where("count > 1").isEmpty():
        once = once.dropDuplicates(["doc_id", "row_key"])
    each = once.select("doc_id", "row_key", F.explode("lines").alias("x")).select("x.h", "doc_id", "row_key", "x.w", "x.no")
    counted = each.groupBy("h").agg(F.count("*").alias("docs"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"))
    common = cut(counted.where(F.col("docs") > max_docs).select("h", "docs", "first"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    gone = (
        join_by_share(each, common, ["h"], "docs").where(own != F.col("first"))
        .groupBy("doc_id", "row_key").agg(F.sort_array(F.flatten(F.collect_list("no"))).alias("removed_lines"), F.sum(F.col("w") * F.size("no")).alias("removed_words"))
        .select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), "removed_lines", "removed_words")
    )
    words, removed = F.col("n_words"), F.coalesce("removed_words", F.lit(0)).cast("long")
    failed = (words < least_words) | (100 * F.col("n_repeat_words") > most_repeats * words)
    left = words - removed
    kept = ~failed & (left >= least_left) & (left >= least_share * words)
    return base.drop("lines").join(gone, (F.col("row_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left").select(
        "row_key", "doc_id", *MEASURES, failed.alias("base_failed"), F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"), removed.alias("removed_words"), kept.alias("kept"),
    )


def clean(docs: DataFrame, **rules) -> DataFrame:
    """``docs`` without the rejected documents and without the lines above the limit; n_chars is brought up to date.

    Rows come out with the columns and as often as they came in. A null or empty text fails ``least_words`` and goes, unless that is 0;
    a null doc_id or host stays null; an empty table gives none. Columns of any name may be there.
    """
    id_col, text_col, host_col = (rules.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("host_col", "source")))
    verdict = judge(docs, **rules).where("kept").select("doc_id", "row_key", "removed_lines").dropDuplicates(["doc_id", "row_key"])
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key(id_col, host_col, text_col).alias("key"), F.col(id_col).cast("long").alias("id"))
    kept = rows.join(verdict, (F.col("key") == F.col("row_key")) & F.col("id").eqNullSafe(F.col("doc_id")))
    whole, text = F.size("removed_lines") == 0, F.col("row")[text_col]
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("removed_lines", i)), "\n")
    kept = kept.withColumn("new", F.when(whole, text).otherwise(left))
    changed = {text_col: F.col("new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("row")["n_chars"]).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
