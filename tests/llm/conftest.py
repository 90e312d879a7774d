import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
])


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows of (doc_id, text, source) as a documents table with further, clashing columns."""

    def make(rows, extra=("n_words", "fingerprint", "spans", "size", "node", "u")):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(d, t, None, s, None) for d, t, s in rows], SCHEMA)
        for c in extra:
            df = df.withColumn(c, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in each column, empty and long texts, ties and repeated rows."""
    long = "lorem ipsum dolor sit amet consectetur " * 3000
    return [
        (1, None, "a"), (2, "", None), (None, "no id here at all", "a"), (3, "same words in this text", "a"),
        (3, "same words in this text", "a"), (4, "same words in this text", "b"), (5, long, "b"), (6, long, None), (7, " \t\n ", "a"),
        (8, "é̀ ÀÉ  two  spaces\n\nand lines\n", "c"), (9, "one", "c"),
    ]
