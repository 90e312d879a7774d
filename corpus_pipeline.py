"""A corpus from raw documents: quality rules, near-dedup, redaction, mixing, token counts and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataq.llm import bpe, mixing, quality, secrets, simhash
from strataq.llm.common import cut, remove_folder, scratch_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that too many documents of their source share; see ``quality.clean``."""
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of five words, similarity of 0.8 or more; see ``simhash.keep_one``.

    Null and empty texts are alike and one of them stays; of repeated rows one stays; an empty table gives none.
    """
    return simhash.keep_one(docs, shingle=5, least_similarity=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret replaced by a mark; a null text stays null."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and parts of documents that the mix takes, once for each pass; what has no words is not taken.

    Repeated rows are documents of their own, a null source is a source; an empty table gives none.
    """
    return mixing.Mix(docs).documents()


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and the decoded text of each row; a null text counts as empty."""
    return bpe.encode_decode(docs, bpe.path("word_bpe_49k.json"), ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("secret scans", secret_scan),
    ("source mixing", source_mix),
    ("bpe round trip", bpe_round_trip),
]

#: Fingerprints, entropy spans and tokenizer digests are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again.

    A stage's files go when the next one's are written. Null ids stay null, null texts and empty ones fail the quality rules,
    repeated rows come through as one; an empty table gives none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch_folder(spark, "pipeline") as folder:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            remove_folder(f"{folder}/{k - 1}")
        return cut(STAGES[-1][1](spark, docs, sf_dir))
