"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Tables


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Tie neighbours of each vertex to the least one: the greater neighbours (large) or the lesser (small)."""
    if large:
        ends = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    tied = ends.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, tables: Tables, name: str = "components") -> DataFrame:
    """(a, b) -> (id, component) for every vertex of an edge; the component is its least id.

    Vertices are never gathered: each step is a group-by and a join, written to the shared folder. It ends when a round
    leaves the edges as they are; then every vertex hangs on its component's least one.
    """
    now = tables.put(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    step, seen = 0, None
    while (state := mark(now)) != seen:
        seen, step = state, step + 1
        now = tables.put(_stars(_stars(now, True), False), f"{name}-{step}")
        tables.drop(f"{name}-{step - 1}")
    # u hangs on v; v itself is the least.
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
