"""Running sums over a total order that no single task has to see."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges a global order is cut into: as many as shuffle partitions are set, within these bounds, found in two steps.
RANGES, MOST, STEP = 64, 4_096, 64


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null; the right side's keys go."""
    named = right.select(*[F.col(k).alias(f"_same_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(named, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys])).drop(*[f"_same_{k}" for k in keys])


def running(rows: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Adds cum_<c> (this row included) and all_<c> for each column, by groups, in ascending ``order``.

    The order is cut at approximate quantiles; ranges are summed, their few sums run, and rows run inside their range. Rows
    are to be unique in (by, order), as the result of a group-by: its exchange is then shared by all three uses. Nothing runs
    before the result is asked for. Null groups stay.
    """
    ranges = ranges or min(MOST, max(RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = rows.agg(F.percentile_approx(F.col(order).cast("double"), F.expr(f"array({', '.join(f'{i / ranges!r}D' for i in range(1, ranges))})"), F.lit(max(1000, 10 * ranges))).alias("_cuts"))
    above = lambda edges: F.size(F.filter(edges, lambda e: F.col(order) >= e))
    if ranges <= STEP:
        part = above(F.col("_cuts"))
    else:
        cuts = cuts.withColumn("_heads", F.expr(f"filter(_cuts, (e, i) -> i % {STEP} = {STEP - 1})"))
        steps = above(F.col("_heads")) * STEP
        part = steps + above(F.slice("_cuts", steps + 1, F.lit(STEP)))
    marked = rows.crossJoin(F.broadcast(cuts)).withColumn("_part", F.coalesce(part, F.lit(0))).drop("_cuts", "_heads")  # one row on the right
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sums = marked.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    sums = sums.select(*by, "_part", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns], *[F.sum(f"_s_{c}").over(whole).alias(f"all_{c}") for c in columns])
    inside = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = marked.select("*", *[F.sum(c).over(inside).alias(f"_c_{c}") for c in columns])
    out = out.join(F.broadcast(sums), "_part") if not by else same(out, sums, [*by, "_part"])
    return out.select(*rows.columns, *[(F.col(f"_c_{c}") + F.col(f"_b_{c}")).alias(f"cum_{c}") for c in columns], *[f"all_{c}" for c in columns])


def percentiles(rows: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row a group: ``q``, the exact percentiles, linear between neighbours; null without values.

    They come from running counts of the values, so no task holds the values of a group.
    """
    v = F.col(column).cast("double")
    t = running(rows.where(v.isNotNull()).groupBy(*by, v.alias("_v")).agg(F.count("*").alias("_n")), by, "_v", ("_n",))
    t = t.withColumn("_first", F.col("cum__n") - F.col("_n"))

    def at(share: float) -> Column:
        place = F.lit(float(share)) * (F.col("all__n") - 1)
        low, high = F.floor(place), F.ceil(place)
        held = lambda k: F.max(F.when((F.col("_first") <= k) & (k < F.col("cum__n")), F.col("_v")))
        a, b, p, lo, hi = held(low), held(high), F.max(place), F.max(low), F.max(high)
        return F.when(a == b, a).otherwise((hi - p) * a + (p - lo) * b)

    return t.groupBy(*by).agg(F.array(*[at(s) for s in shares]).alias("q"))


def pages(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Adds ``page``, from 0: ``size`` rows each in the order of a numeric key that no two rows share."""
    t = running(rows.withColumn("_one", F.lit(1)), (), key, ("_one",))
    return t.select(*rows.columns, F.floor((F.col("cum__one") - 1) / size).cast("int").alias("page"))
