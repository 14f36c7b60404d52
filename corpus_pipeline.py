"""From documents to packed training sequences: five stages, each over all that the one before has kept.

The stages are those of ``verdigris.llm``: language identification (a document without a language
that is told with some confidence goes), near duplicates (one document of each group stays),
benchmark decontamination (a document with a window of a benchmark item goes), personal data (spans
are replaced in the text) and packing (the last stage returns pieces of sequences).

Every stage takes any table with the columns of documents: an empty one gives an empty result, further
columns stay as they are whatever their names (but for packing, which has columns of its own), texts of
any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import decontam, langid, neardup, packing, pii
from verdigris.llm.common import crc_of_id, saved


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of two thirds of the documents and drops what has no language.

    Null texts, and texts without a letter, go; rows without a label are judged like others; without any
    label there is nothing to tell a language by, and all rows go; each of repeated rows is judged by itself.
    """
    return langid.accepted(docs, langid.fit(docs.where(crc_of_id() % 3 != 1)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; repeated rows and ids are copies, texts without words and null texts all stay."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of an item; null and empty texts stay, repeated rows are judged each, without items all stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces spans by marks of their kind; null texts stay null, repeated rows are all redacted, no row goes."""
    return pii.redact(docs, pii.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences: a null or empty text is its end id, repeated rows and ids are packed each, ties of sources go by name."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", packed),
]

#: A trained classifier, message passing and a tokenizer can't be put into SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
