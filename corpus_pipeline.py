"""The corpus pipeline: language ID, quality rules, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``docs``. ``run`` writes each result to the shared folder and reads it
back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamis.llm import common, langid, mixing, outliers, packing, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters that are about as like their language, learned from ``docs``, as its
    own documents of like length are."""
    return langid.keep_known(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and are no robust outlier of their language and source."""
    return outliers.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of near copies."""
    return simhash.drop_copies(docs, simhash.near_copies(docs))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture to target weights draws them, in the order of its shards and
    places. A document in which a source's quota ends is taken whole if more than half is within."""
    mixed = mixing.mix(docs).select("mixed.*")
    return mixed.filter("2 * words > size").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    return packing.packed_documents(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mixing", mixing_weights), ("packing", pack)]

#: SQL has neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus. What a stage wrote for itself goes once its result is stored."""
    docs, done = common.load(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        before = len(common.MADE)
        docs = common.materialise(stage(spark, docs, sf_dir), name)
        *scratch, result = common.MADE[before:]
        common.drop_paths(spark, done + scratch)
        done = [result]
    return STAGES[-1][1](spark, docs, sf_dir)
