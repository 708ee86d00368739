"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of ``documents``.
Stages are written as Parquet and read again, so a lost executor costs part of one stage only.

In every stage: a null text is the empty text, a null doc_id stays a row of its own, repeated rows are rows of their own except in near_dedup,
very long texts are read whole, an empty table gives an empty one, and further columns, whatever they are called, stay as they are up to the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnlake.llm import common, decontaminate, packing, pii, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; null and empty texts, which have under 20 words, go."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each group of exact copies and of texts whose five-word shingles are similar by 0.8 or more.

    Texts meet by op9's operator, the trie self-join of SimHash fingerprints, and are then compared word by word; a prefix filter finds similar
    texts beyond its budget of bits.
    Null and empty texts are copies of each other; rows without an id come after all others; of repeated rows one stays.
    """
    return simhash.drop_near_duplicates(docs, size=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no eight-word window of a benchmark item occurs; a document without words stays, an empty benchmark takes nothing out."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text, and a null text stays null with its n_chars."""
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens; a null or empty text is its end token alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii_redaction),
    ("packing", pack_sequences),
]

#: Suffix arrays, fingerprints and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
