"""Time slices: (entity, number of the unit before its reference) tables of aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import aggregates, times
from riskloom.functions.expressions import ratio


def time_order(rows: DataFrame, by: str, time: str, ties: Sequence[str]) -> DataFrame:
    """Adds TIME_ORDER: 1 for the newest row of each partition; ties in the order of ``ties``."""
    w = Window.partitionBy(by).orderBy(F.col(time).desc(), *ties)
    return rows.withColumn("TIME_ORDER", F.row_number().over(w))


def assign(rows: DataFrame, time: str, end: Column, unit: str, history: int | None = None) -> DataFrame:
    """Adds TIME_ORDER by whole units back from ``end``; later rows and rows beyond the history are dropped."""
    out = rows.where(F.col(time) <= end).withColumn("TIME_ORDER", times.order_units(F.col(time), end, unit))
    return out.where(F.col("TIME_ORDER") <= history) if history is not None else out


def grid(ids: DataFrame, id: str, end: Column, unit: str, history: int) -> DataFrame:
    """Every entity with slices 1 to ``history`` and their bounds (TIME_FROM, TIME_TO]; generated, not joined."""
    return ids.select(id, F.explode(F.sequence(F.lit(1), F.lit(history))).alias("TIME_ORDER")).select(id, "TIME_ORDER", times.slice_bound(end, F.col("TIME_ORDER"), unit).alias("TIME_FROM"), times.slice_bound(end, F.col("TIME_ORDER") - 1, unit).alias("TIME_TO"))


def general(rows: DataFrame, id: str, column: str, funcs: Sequence[str]) -> DataFrame:
    """COLUMN_FUNC per entity and slice."""
    return rows.groupBy(id, "TIME_ORDER").agg(*[aggregates.aggregate(f, F.col(column)).alias(f"{column}_{f}".upper()) for f in funcs])


def segmented(rows: DataFrame, id: str, column: str, func: str, segment: str, values: Sequence, relative: bool = False) -> DataFrame:
    """COLUMN_SEG_value_FUNC per entity and slice, as conditional aggregates; ``relative`` divides by the general one (suffix _R)."""
    out = []
    for v in values:
        part = aggregates.aggregate(func, F.when(F.col(segment) == F.lit(v), F.col(column)))
        name = f"{column}_{segment}_{v}_{func}".upper().replace("-", "_").replace(" ", "_")
        out.append(ratio(part, aggregates.aggregate(func, F.col(column))).alias(f"{name}_R") if relative else part.alias(name))
    return rows.groupBy(id, "TIME_ORDER").agg(*out)


def on_grid(slices: DataFrame, grid_: DataFrame, id: str) -> DataFrame:
    """Slices without rows as nulls."""
    return grid_.join(slices, [id, "TIME_ORDER"], "left")
