"""All registered queries of the library, with the SQL they are held against.

Names begin with the inventory's op IDs. Float columns are rounded to six decimals on both sides, as sums
depend on order; a small shift keeps exact halves from falling apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "A01_A02_features_fused"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None, floats: str = "") -> None:
    """``floats``: the columns to round, on both sides."""
    columns = set(floats.lower().split())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(spark, sf_dir)
        return out.selectExpr(*[f"round(CAST(`{c}` AS DOUBLE) + 1.23e-8D, 6) + 0.0D AS `{c}`" if c.lower() in columns else f"`{c}`" for c in out.columns]) if columns else out

    QUERIES[name] = run
    if sql:
        ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE) + 1.23e-8, 6) + 0.0 AS {c}' for c in floats.split())}) FROM ({sql}) AS q" if columns else sql
