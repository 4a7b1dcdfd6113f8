import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
     # Names that operators use inside: they must not clash.
     T.StructField("id", T.StringType()), T.StructField("node", T.StringType()), T.StructField("spans", T.StringType())]
)


@pytest.fixture
def docs(spark):
    """A documents table of (doc_id, text[, lang]) rows with extra columns."""

    def make(rows, parts=2):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, "x", None, "y") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


LONG = "lorem ipsum dolor sit amet consectetur " * 4000
PROSE = "The cat sat on the mat and looked at the door, as it was late in the day and nobody had come to the house for a long time. "


@pytest.fixture
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, PROSE), (5, PROSE), (6, PROSE), (None, PROSE), (None, None),
        (7, "é☃𝒳 \x00 mixed\x1ctext"), (7, "another text of the same id"), (8, "a\n\n  b   c \n d"), (9, "short"),
    ]
