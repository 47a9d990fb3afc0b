"""Column profiles that decide which predictors are kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def column_profile(rows: DataFrame, columns: Sequence[str], least_fill: float = 0.05, least_distinct: int = 2, most_categories: int = 20) -> DataFrame:
    """column, kind, fill, n_distinct, kept: columns that are too empty, constant, or text of too many categories go.

    Values are counted as rows of (column, value), so one shuffle serves all columns and none is collected.
    """
    texts = {n for n, t in rows.dtypes if t == "string"}
    named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = rows.select(F.explode(named).alias("x")).select("x.*").groupBy("column", "value").agg(F.count("*").alias("n"))
    filled = F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")
    out = counts.groupBy("column").agg(filled.alias("fill"), F.count("value").alias("n_distinct"))
    kind = F.when(F.col("column").isin(*texts), "categorical").otherwise("numerical") if texts else F.lit("numerical")
    kept = (F.col("fill") >= least_fill) & (F.col("n_distinct") >= least_distinct) & ((F.col("kind") == "numerical") | (F.col("n_distinct") <= most_categories))
    return out.withColumn("kind", kind).withColumn("kept", kept).select("column", "kind", "fill", "n_distinct", "kept")


def drop_columns(rows: DataFrame, columns: Sequence[str], **limits) -> DataFrame:
    """The table without the columns that the profile does not keep; one row a column comes to the driver."""
    gone = [r["column"] for r in column_profile(rows, columns, **limits).where("NOT kept").collect()]
    return rows.drop(*gone)


def rank_groups(rows: DataFrame, group: str, target: str) -> DataFrame:
    """value, rate, rank: groups by rising target rate, 1 first; ties by value. One row a group is ranked."""
    t = rows.groupBy(F.col(group).alias("value")).agg(F.avg(F.col(target).cast("double")).alias("rate"))
    return t.withColumn("rank", F.row_number().over(Window.orderBy("rate", "value")))


def percent_table(rows: DataFrame, by: str, target: str, digits: int = 2) -> DataFrame:
    """Share of rows and rate by group in per cent, rounded half to even."""
    t = rows.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("rate"))
    every = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return t.select("value", "n", F.bround(100 * F.col("n") / every, digits).alias("share_pct"), F.bround(100 * F.col("rate"), digits).alias("rate_pct"))


def kind_of(type_: str) -> str:
    """numeric, time or categorical, by Spark's name of the type."""
    if type_ in ("tinyint", "smallint", "int", "bigint", "float", "double") or type_.startswith("decimal"):
        return "numeric"
    return "time" if type_.startswith(("date", "timestamp")) else "categorical"


def descriptors(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, kind, n_unique, and what its kind has: mean, std, minimum, maximum of numbers, mode of categories (of ties
    the least), first and last time as text.

    All come from one count of (column, value), so neither a column nor a hot value is gathered in one task.
    """
    kinds = {c: kind_of(t) for c, t in rows.dtypes if c in columns}
    none = F.lit(None)
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text"), (F.col(c) if kinds[c] == "numeric" else none).cast("double").alias("x")) for c in columns]
    t = rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("column", "text", "x").agg(F.count("*").alias("n"))
    n, x, filled = F.when(F.col("x").isNotNull(), F.col("n")), F.col("x"), F.col("text").isNotNull()
    means = t.groupBy("column").agg((F.sum(n * x) / F.sum(n)).alias("_mean"))
    t = t.join(F.broadcast(means), "column")  # one row a column
    spread = F.sqrt(F.sum(n * (x - F.col("_mean")) * (x - F.col("_mean"))) / F.when(F.sum(n) > 1, F.sum(n) - 1))
    mode = F.min_by("text", F.when(filled, F.struct(-F.col("n"), F.col("text"))))
    out = t.groupBy("column").agg(F.count("text").alias("n_unique"), F.max("_mean").alias("mean"), spread.alias("std"), F.min("x").alias("minimum"), F.max("x").alias("maximum"), mode.alias("mode"), F.min("text").alias("first_time"), F.max("text").alias("last_time"))
    kind = F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair])[F.col("column")]
    own = lambda c, k: F.when(F.col("kind") == k, F.col(c)).alias(c)
    return out.withColumn("kind", kind).select("column", "kind", "n_unique", "mean", "std", "minimum", "maximum", own("mode", "categorical"), own("first_time", "time"), own("last_time", "time"))
