"""Collections: payment curves, impact of treating the best, daily winners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.cumulative import percentiles
from riskloom.functions.expressions import ratio


def payment_curve(rows: DataFrame, group: str, day: str, amount: str) -> DataFrame:
    """Running share of a group's total by day."""
    t = rows.groupBy(group, day).agg(F.sum(amount).alias("paid"))
    w = Window.partitionBy(group)
    return t.select(group, day, (F.sum("paid").over(w.orderBy(day)) / F.sum("paid").over(w)).alias("share"))


def impact_curve(rows: DataFrame, bin_: str, value: str, treated: str) -> DataFrame:
    """Value per head if the bins up to each one are treated and the others are not."""
    t = rows.groupBy(bin_).agg(F.count("*").alias("n"), *[F.avg(F.when(F.col(treated) == v, F.col(value))).alias(f"m{v}") for v in (0, 1)])
    one = Window.partitionBy(F.lit(0)).orderBy(bin_)  # one row a bin
    up = F.sum(F.col("n") * F.col("m1")).over(one.rowsBetween(Window.unboundedPreceding, 0))
    down = F.coalesce(F.sum(F.col("n") * F.col("m0")).over(one.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    every = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return t.select(F.col(bin_).alias("bin"), ratio(up + down, every).alias("per_head"))


def quantiles_by_day(rows: DataFrame, day: str, value: str, shares: Sequence[float]) -> DataFrame:
    return percentiles(rows, value, shares, (day,)).select(day, *[F.col("q")[i].alias(f"q{round(100 * s)}") for i, s in enumerate(shares)])


def daily_winner(rows: DataFrame, day: str, group: str, value: str) -> DataFrame:
    """The group of the largest mean by day, ties to the smaller group, and how often each wins."""
    t = rows.groupBy(day, group).agg(F.avg(value).alias("m"))
    best = t.groupBy(day).agg(F.min(F.struct(F.negate("m").alias("k"), F.col(group).alias("g")))["g"].alias("winner"))
    return best.groupBy("winner").agg(F.count("*").alias("days"))


def _draws(key: str, replicates: int, seed: int):
    """replicate and weight pairs of a row: Poisson weights by a hash of the key, rows of weight 0 left out."""
    u = lambda i: (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(i)), F.lit(10**9)) + 0.5) / 1e9
    cuts, total, term = [], 0.0, 0.36787944117144233
    for k in range(12):
        total += term
        cuts.append(total)
        term /= k + 1

    def weight(i: int):
        out = F.lit(0)
        for c in cuts:
            out = out + (u(i) > c).cast("int")
        return out

    return F.filter(F.array(*[F.struct(F.lit(i).alias("replicate"), weight(i).alias("w")) for i in range(replicates)]), lambda x: x["w"] > 0)


def bootstrap_impact(rows: DataFrame, bin_: str, value: str, treated: str, key: str, replicates: int = 20, seed: int = 1) -> DataFrame:
    """Mean and 5th and 95th percentile over replicates of what treating a bin adds per head; one aggregation for all."""
    each = rows.withColumn("_x", F.explode(_draws(key, replicates, seed))).select(F.col(bin_).alias("bin"), value, treated, "_x.*")
    mean = lambda v: ratio(F.sum(F.when(F.col(treated) == v, F.col("w") * F.col(value))), F.sum(F.when(F.col(treated) == v, F.col("w"))))
    t = each.groupBy("bin", "replicate").agg((mean(1) - mean(0)).alias("gain"))
    return t.groupBy("bin").agg(F.avg("gain").alias("mean"), F.percentile("gain", F.lit(0.05)).alias("p5"), F.percentile("gain", F.lit(0.95)).alias("p95"))


def trajectories(rows: DataFrame, day: str, group: str, value: str, paths: int = 10, seed: int = 1) -> DataFrame:
    """Paths that pick one group a day by a hash, and the mean of the picked groups' means so far."""
    t = rows.groupBy(day, group).agg(F.avg(value).alias("m"))
    each = t.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))
    pick = each.groupBy("path", day).agg(F.min(F.struct(F.xxhash64(F.col(group).cast("string"), F.col("path"), F.lit(seed), F.col(day).cast("string")).alias("h"), F.col("m")))["m"].alias("m"))
    return pick.select("path", day, F.avg("m").over(Window.partitionBy("path").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)).alias("mean_so_far"))
