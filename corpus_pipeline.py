"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulelens.llm import minhash_dedup, mixing, packing, suffix_dedup, toxicity
from rulelens.llm.common import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Null and empty texts stay; repeated rows go or stay together; an empty table stays empty; all columns stay.
    """
    return toxicity.reject(docs, toxicity.fit(*toxicity.learning_rows(spark, docs, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id.

    Null and empty texts and rows without doc_id stay; of rows that repeat a doc_id one stays; an empty table stays
    empty; all columns stay.
    """
    return minhash_dedup.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that still occur more than once are cut out of the texts.

    All rows and columns stay; null, empty and short texts are unchanged; rows that repeat as a whole lose all their
    long strings; an empty table stays empty.
    """
    return suffix_dedup.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target weights.

    A null source is a source; null and empty texts weigh nothing and go with their source's rate; rows that repeat a
    doc_id share its draw; an empty table stays empty; all columns stay.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in as few sequences as possible.

    Null and empty texts are an end id alone; repeated rows are packed each; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The trained, hashed and optimised stages are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
