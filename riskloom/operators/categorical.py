"""Features of a categorical column per entity: mode, first, last, argmax and the like, changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.aggregates import best
from riskloom.functions.times import whole_units

ONE_PASS = ("mode", "nunique", "first", "last", "argmax", "argmin")
TWO_LEVEL = ("argmaxsum", "argminsum", "argmaxmean", "argminmean")
ORDERED = ("nchanges", "tschange")


def named_nan(c: Column, as_category: bool) -> Column:
    """Nulls as a category of their own, or left out."""
    return F.coalesce(c, F.lit("NaN")) if as_category else c


def simple(rows: DataFrame, keys: Sequence[str], column: str, time: str, metric: str, funcs: Sequence[str] = ONE_PASS, nan: bool = False) -> DataFrame:
    """All one-pass features in one aggregation. Of tied categories the smallest."""
    c = named_nan(F.col(column), nan)
    made = {"mode": lambda: F.mode(c, True), "nunique": lambda: F.countDistinct(c), "first": lambda: best(c, F.unix_micros(F.col(time).cast("timestamp")), False), "last": lambda: best(c, F.unix_micros(F.col(time).cast("timestamp")), True), "argmax": lambda: best(c, F.col(metric), True), "argmin": lambda: best(c, F.col(metric), False)}
    return rows.groupBy(*keys).agg(*[made[f]().alias(f"{column}_{f}".upper()) for f in funcs])


def by_total(rows: DataFrame, keys: Sequence[str], column: str, metric: str, funcs: Sequence[str] = TWO_LEVEL, nan: bool = False) -> DataFrame:
    """The category with the largest or smallest sum or mean of a metric: partial sums by category, then one pick."""
    parts = rows.withColumn("_c", named_nan(F.col(column), nan)).groupBy(*keys, "_c").agg(F.sum(metric).alias("_sum"), F.avg(metric).alias("_mean"))
    return parts.groupBy(*keys).agg(*[best(F.col("_c"), F.col("_sum" if f.endswith("sum") else "_mean"), "max" in f).alias(f"{column}_{f}".upper()) for f in funcs])


def changes(rows: DataFrame, keys: Sequence[str], column: str, time: str, end: Column, unit: str = "days", ties: Sequence[str] = (), nan: bool = False) -> DataFrame:
    """Number of changes in time order (the first row is none), and whole units since the last one."""
    w = Window.partitionBy(*keys).orderBy(time, *ties)
    c = named_nan(F.col(column), nan)
    kept = rows.withColumn("_c", c).where(F.col("_c").isNotNull())
    moved = (F.col("_c") != F.lag("_c").over(w)).alias("_moved")
    marked = kept.select("*", moved)
    since = F.when(F.col("_moved"), whole_units(F.col(time), end, unit))
    return marked.groupBy(*keys).agg(F.sum(F.coalesce(F.col("_moved").cast("long"), F.lit(0))).alias(f"{column}_NCHANGES".upper()), F.min(since).alias(f"{column}_TSCHANGE".upper()))


def monotonic(rows: DataFrame, key: str, column: str, time: str, ties: Sequence[str] = ()) -> DataFrame:
    """Whether a column never falls, and whether it never rises, in time order."""
    w = Window.partitionBy(key).orderBy(time, *ties)
    step = rows.withColumn("_step", F.col(column) - F.lag(column).over(w))
    return step.groupBy(key).agg(F.coalesce(F.bool_and(F.col("_step") >= 0), F.lit(True)).alias("is_increasing"), F.coalesce(F.bool_and(F.col("_step") <= 0), F.lit(True)).alias("is_decreasing"))


def modes(rows: DataFrame, key: str, column: str, most: int | None = None) -> DataFrame:
    """All modes spread over columns _0, _1, … in the order of their values.

    There are as many columns as any key has modes, which one aggregation finds; or ``most``, and the array of all, if given.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(key, column).count()
    top = counts.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.col("count").desc()))).where("_r = 1")
    values = top.groupBy(key).agg(F.sort_array(F.collect_list(column)).alias("_m"))
    width = most if most is not None else values.agg(F.max(F.size("_m"))).first()[0] or 1
    every = [] if most is None else [F.col("_m").alias(f"{column}_modes")]
    return values.select(key, *[F.get("_m", F.lit(i)).alias(f"{column}_mode_{i}") for i in range(width)], *every)


def sql_text(table: str, key: str, column: str, funcs: Sequence[str], metric: str = "", time: str = "", low: int = 1, high: int | None = None, ties: Sequence[str] = ()) -> str:
    """The features as one SQL statement over a table with a column ``_age``, for engines with windows.

    A nested select for each feature, of which ordered picks number their rows; all are joined to the table's entities, so
    those without a row in the range get nulls. Of tied categories the smallest, as in the plan. TSCHANGE counts in the units
    of ``_age``.
    """
    inside = f"{column} IS NOT NULL AND _age >= {low}" + (f" AND _age <= {high}" if high is not None else "")
    span = f"{low}_{'INF' if high is None else high}"
    in_time = ", ".join([time, *ties])

    def picked(order: str, grouped: bool, more: str = "") -> str:
        ends = f" GROUP BY {key}, {column}" if grouped else ""
        return f"SELECT {key}, val FROM (SELECT {key}, {column} AS val, row_number() OVER (PARTITION BY {key} ORDER BY {order}, {column}) AS place FROM {table} WHERE {inside}{more}{ends}) AS q WHERE place = 1"

    def one(func: str) -> str:
        moved = f"SELECT {key}, {column} AS val, lag({column}) OVER (PARTITION BY {key} ORDER BY {in_time}) AS before, _age FROM {table} WHERE {inside}"
        known = f" AND {metric} IS NOT NULL"
        made = {
            "mode": lambda: picked("count(*) DESC", True),
            "nunique": lambda: f"SELECT {key}, count(DISTINCT {column}) AS val FROM {table} WHERE {inside} GROUP BY {key}",
            "first": lambda: picked(time, False),
            "last": lambda: picked(f"{time} DESC", False),
            "argmax": lambda: picked(f"{metric} DESC", False, known),
            "argmin": lambda: picked(metric, False, known),
            "argmaxsum": lambda: picked(f"sum({metric}) DESC", True, known),
            "argminsum": lambda: picked(f"sum({metric})", True, known),
            "argmaxmean": lambda: picked(f"avg({metric}) DESC", True, known),
            "argminmean": lambda: picked(f"avg({metric})", True, known),
            "nchanges": lambda: f"SELECT {key}, sum(CASE WHEN val <> before THEN 1 ELSE 0 END) AS val FROM ({moved}) AS q GROUP BY {key}",
            "tschange": lambda: f"SELECT {key}, min(_age) - 1 AS val FROM ({moved}) AS q WHERE val <> before GROUP BY {key}",
        }
        if func not in made:
            raise ValueError(f"unknown feature {func!r}; known: {sorted(made)}")
        return made[func]()

    names = [f"{column}_{f}_{metric + '_' if f.startswith('arg') else ''}{span}".upper() for f in funcs]
    picks = ", ".join(f"t{i}.val AS {n}" for i, n in enumerate(names))
    joins = " ".join(f"LEFT JOIN ({one(f)}) AS t{i} ON k.{key} IS NOT DISTINCT FROM t{i}.{key}" for i, f in enumerate(funcs))
    return f"SELECT k.{key}, {picks} FROM (SELECT DISTINCT {key} FROM {table}) AS k {joins}"
