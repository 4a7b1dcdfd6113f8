"""The corpus pipeline: five stages over ``documents``, each a training-data operator on all that the one before kept.

Quality rules and decontamination drop documents, near-dedup leaves one document
of each class, personal data is replaced in the text, and the last stage encodes
what is left.  ``run`` writes each stage's rows to the shared folder and reads
them again, so a lost executor repeats one stage's tasks at most.

Any column may hold nulls: a null text counts as empty (the quality rules reject
it), a null id is a document of its own.  Rows that repeat an id are each judged and
kept or dropped; near-dedup leaves all rows of a class's least id.  Texts are taken
whole whatever their length; no documents give none; further columns stay up to the
last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import decontaminate, minhash_dedup, pii, quality_rules, sentencepiece_codec, store
from shutterlake.llm.queries import vocabulary
from shutterlake.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class."""
    return minhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is verified."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data in ``text`` is replaced, and ``n_chars`` is counted anew where there is a text."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the final texts."""
    return sentencepiece_codec.digests(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: SQL expresses neither the sampling of near duplicates nor the encoding; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.materialize(stage(spark, docs, sf_dir), name)
    return docs
