"""From raw documents to packed training sequences. Counted as part of riskloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import mixing, neardup, packing, pii, queries, toxicity
from riskloom.llm.common import Tables, documents


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled rows rejects go; null and empty texts stay, repeated rows go together."""
    return toxicity.reject(docs, documents(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the least id; texts without words all stay."""
    return neardup.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed personal data is replaced by its kind; every document stays, null and empty texts as they are."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum: one row per copy that the mix takes, in training order; a null source is one of its own, and texts
    without words are not taken."""
    return mixing.curriculum(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix and their places in sequences of at most 4,096 tokens, with their places in training time; each
    row is packed, also of repeated ids, and longer texts are cut, not dropped."""
    return packing.pack_documents(*_placed(docs))


def _placed(docs: DataFrame) -> tuple:
    placed, position = packing.training_order(docs)
    return placed, queries.TOKENIZER, packing.SIZE, position


STAGES = [("toxicity", clean), ("near duplicates", distinct), ("personal data", private), ("mixing", mixed), ("packing", packed)]

#: Neither the fitted model nor components and packing can be put in SQL; tests/llm holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again as the next one's input, which then goes.

    An empty table gives an empty result; columns that documents has besides its own stay until the packing.
    """
    tables, docs = Tables(spark), documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = tables.put(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            tables.drop(f"stage-{k - 1}")
    return docs
