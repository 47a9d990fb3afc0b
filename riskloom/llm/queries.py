"""The query of each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import ann, lexical, licenses, merkle, mixing, neardup, packing, pii, suffixes, tiff, topk, toxicity, wrappers
from riskloom.llm.common import documents

#: Where the vocabulary of the packing query lies; a parameter of the operator.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 50 = 0"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.ordered(documents(spark, sf_dir))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(documents(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), TOKENIZER)


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digest(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(documents(spark, sf_dir))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.where("vec_id % 50 = 0"))


_ALL = (op1_ann, op2_pii, op3_mixing, op4_suffixes, op5_html, op6_packing, op7_neardup, op8_media, op9_toxicity, op10_licenses, op11_merkle, op12_lexical, op13_topk)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op3_mixing": mixing.ORACLE, "op10_licenses": licenses.ORACLE, "op11_merkle": merkle.ORACLE, "op12_lexical": lexical.ORACLE, "op13_topk": topk.ORACLE}
