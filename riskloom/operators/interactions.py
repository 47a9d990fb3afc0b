"""Two-way interactions: cells of binned pairs, groups of cells, and which pairs are worth it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.expressions import bin_index
from riskloom.operators.cumulative import percentiles
from riskloom.operators.metrics import curve, quantile_edges


def group_of(groups: Sequence[Sequence[tuple[Column, Column]]]) -> Column:
    """Number of the group whose (row, column) condition holds; later groups overwrite earlier ones; -1 for none."""
    out: Column = F.lit(-1)
    for k, pairs in enumerate(groups):
        for a, b in pairs:
            out = F.when(a & b, F.lit(k)).otherwise(out)
    return out


def group_sql(name: str, groups: Sequence[Sequence[tuple[str, str]]]) -> str:
    """The same over conditions as text; CASE takes the first arm, so the last group comes first."""
    arms = [f"WHEN {a} AND {b} THEN {k}" for k, pairs in reversed(list(enumerate(groups))) for a, b in reversed(list(pairs))]
    return f"CASE {' '.join(arms)} ELSE -1 END AS {name}"


def pair_power(rows: DataFrame, columns: Sequence[str], target: str, bins: int = 5) -> DataFrame:
    """Gini of the cell rates of every pair of binned columns: right-closed quantile bins, nulls in a bin of their own.

    All pairs go through one aggregation of their cells and one curve by pair.
    """
    index = {c: F.coalesce(bin_index(F.col(c), quantile_edges(rows, c, bins), "right"), F.lit(-1)) for c in columns}
    binned = rows.where(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("_y"), *[i.alias(c) for c, i in index.items()])
    every = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("i"), F.col(b).alias("j")) for a, b in combinations(columns, 2)]
    cells = binned.select("_y", F.explode(F.array(*every)).alias("x")).groupBy("x.a", "x.b", "x.i", "x.j").agg(F.sum("_y").alias("bad"), F.sum(1 - F.col("_y")).alias("good"))
    levels = cells.groupBy("a", "b", (F.col("bad") / (F.col("bad") + F.col("good"))).alias("score")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return curve(levels, ("a", "b")).select("a", "b", "gini")


def _outer_bins(rows: DataFrame, column: str, bins: int) -> Column:
    """Right-closed intervals between percentiles at equal whole steps, from the least value on, which itself is in none."""
    step = round(100 / bins)
    found = percentiles(rows, column, [k * step / 100 for k in range(100 // step + 1)]).first()
    edges = sorted({x for x in (found[0] if found and found[0] else []) if x is not None})
    c = F.col(column)
    if not edges:
        return F.lit(None).cast("int")
    return F.when((c > edges[0]) & (c <= edges[-1]), bin_index(c, edges[1:-1], "right"))


def potential(rows: DataFrame, column: str, moderator: str, target: str, bins: int = 10) -> DataFrame:
    """By bin of a column: the rate below and above the moderator's mean, and their difference.

    Rows with a null among the three take no part. Bins are right-closed between percentiles; the least value is in none.
    """
    clean = rows.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys((column, moderator, target))]).dropna()
    mean = clean.agg(F.avg(moderator).alias("_mean"))
    marked = clean.crossJoin(F.broadcast(mean)).withColumn("bin", _outer_bins(clean, column, bins)).where("bin IS NOT NULL")  # one row on the right
    t = marked.groupBy("bin").agg(*[F.avg(F.when((F.col(moderator) > F.col("_mean")) == F.lit(v), F.col(target))).alias(n) for v, n in ((False, "rate_below"), (True, "rate_above"))])
    return t.withColumn("difference", F.col("rate_above") - F.col("rate_below"))


def interaction_test(rows: DataFrame, column: str, moderator: str, target: str, bins: int = 10) -> tuple[float | None, float | None]:
    """p-value of the interaction in a least-squares fit of the cells' mean target, and the share of the moderator's larger side.

    Cells are the bins of ``potential`` below and above the moderator's mean; each is one point, at its mean of the column. Null
    where fewer than five cells are left, or the fit is exact or not unique.
    """
    clean = rows.select(F.col(column).cast("double").alias("_x"), F.col(moderator).cast("double").alias("_m"), F.col(target).cast("double").alias("_y")).dropna()
    mean = clean.agg(F.avg("_m").alias("_mean"))
    marked = clean.crossJoin(F.broadcast(mean)).select("_x", "_y", (F.col("_m") > F.col("_mean")).cast("int").alias("above"), _outer_bins(clean, "_x", bins).alias("bin"))  # one row on the right
    cells = marked.groupBy("bin", "above").agg(F.count("*").alias("n"), F.avg("_y").alias("y"), F.avg("_x").alias("x")).collect()  # two rows a bin
    n = sum(r["n"] for r in cells)
    share = sum(r["n"] for r in cells if r["above"]) / n if n else None
    share = None if share is None else max(share, 1 - share)
    used = sorted(tuple(r) for r in cells if r["bin"] is not None)
    if len(used) < 5:
        return None, share
    x, m, y = (np.array([r[i] for r in used], float) for i in (4, 1, 3))
    design = np.stack([np.ones(len(x)), x, m, x * m], 1)
    if np.linalg.matrix_rank(design) < 4:
        return None, share
    inverse = np.linalg.inv(design.T @ design)
    slope = inverse @ design.T @ y
    rest = y - design @ slope
    df = len(x) - 4
    error = float(np.sqrt((rest @ rest) / df * inverse[3, 3]))
    if error <= 1e-12 * max(1.0, abs(float(slope[3]))):
        return None, share
    return student_tails(float(slope[3]) / error, df), share


def interaction_potential(rows: DataFrame, columns: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """x1, x2, p_val_x1, p_val_x2, obs_cnt, moder_freq1, moder_freq2, p_val_min of every pair: each column tested with the
    other as its moderator, over the rows that have both and a target."""
    out = []
    for a, b in combinations(columns, 2):
        clean = rows.select(a, b, target).dropna()
        (p, f), (q, g) = interaction_test(clean, a, b, target, bins), interaction_test(clean, b, a, target, bins)
        known = [v for v in (p, q) if v is not None]
        out.append((a, b, p, q, clean.count(), f, g, min(known) if known else None))
    return rows.sparkSession.createDataFrame(out, "x1 string, x2 string, p_val_x1 double, p_val_x2 double, obs_cnt long, moder_freq1 double, moder_freq2 double, p_val_min double")


def student_tails(t: float, df: int) -> float:
    """P(|T| > |t|) of Student's distribution with whole degrees, by its finite sums."""
    angle = math.atan2(abs(t), math.sqrt(df))
    sine, cosine = math.sin(angle), math.cos(angle)
    total, term = 0.0, cosine if df % 2 else 1.0
    for k in range(3 if df % 2 else 2, df + 1, 2):
        total += term
        term *= cosine * cosine * (k - 1) / k
    inside = 2 / math.pi * (angle + sine * total) if df % 2 else sine * total
    return max(0.0, 1 - inside)


def largest_leap(rows: DataFrame, bin_: str, month: str, target: str) -> DataFrame:
    """Per bin: the largest change of its rate between months in which its rank changes."""
    t = rows.groupBy(month, bin_).agg(F.avg(F.col(target).cast("double")).alias("rate"))
    t = t.withColumn("rank", F.dense_rank().over(Window.partitionBy(month).orderBy(F.col("rate").desc())))
    w = Window.partitionBy(bin_).orderBy(month)
    leap = F.when(F.col("rank") != F.lead("rank").over(w), F.abs(F.col("rate") - F.lead("rate").over(w)))
    return t.withColumn("_leap", leap).groupBy(F.col(bin_).alias("bin")).agg(F.max("_leap").alias("leap"))


def steady_ranks(rows: DataFrame, bin_: str, month: str, target: str, threshold: float) -> DataFrame:
    """bin, month, rate, rank: bins whose largest leap is within ``threshold`` of the span of all rates keep their
    commonest rank (of ties the least) in all months.

    Ranks, leaps and modes are of one row a bin and month.
    """
    t = rows.groupBy(F.col(month).alias("month"), F.col(bin_).alias("bin")).agg(F.avg(F.col(target).cast("double")).alias("rate"))
    t = t.withColumn("rank", F.dense_rank().over(Window.partitionBy("month").orderBy(F.col("rate").desc())))
    leaps = largest_leap(rows, bin_, month, target).select(F.col("bin").alias("_bin"), F.coalesce("leap", F.lit(0.0)).alias("_leap"))
    span = t.agg((F.max("rate") - F.min("rate")).alias("_span"))
    modes = t.groupBy("bin").agg(F.mode("rank", True).alias("_mode")).select(F.col("bin").alias("_own"), "_mode")
    joined = t.join(leaps, F.col("bin").eqNullSafe(F.col("_bin"))).join(modes, F.col("bin").eqNullSafe(F.col("_own"))).crossJoin(F.broadcast(span))  # one row
    steady = F.col("_leap") <= F.lit(threshold) * F.col("_span")
    return joined.select("bin", "month", "rate", F.when(steady, F.col("_mode")).otherwise(F.col("rank")).alias("rank"))


def stability_by_bins(rows: DataFrame, column: str, edges: Sequence[float], month: str, target: str) -> DataFrame:
    """n_bins, rsi for the first 1, 2, ... edges; a full rsi after a lower one at fewer bins is taken back to that one.

    All numbers of bins go through one aggregation by (number, month, bin).
    """
    each = [F.struct(F.lit(k + 1).alias("n_bins"), bin_index(F.col(column), sorted(edges[:k])).alias("bin")) for k in range(1, len(edges) + 1)]
    t = rows.select(F.col(month).alias("m"), F.col(target).cast("double").alias("y"), F.explode(F.array(*each)).alias("x")).groupBy("x.n_bins", "m", "x.bin").agg(F.avg("y").alias("rate"))
    t = t.withColumn("rank", F.dense_rank().over(Window.partitionBy("n_bins", "m").orderBy(F.col("rate").desc())))
    share = t.groupBy("n_bins", "bin", "rank").count().groupBy("n_bins", "bin").agg((F.max("count") / F.sum("count")).alias("share"))
    rsi = share.groupBy("n_bins").agg(F.avg("share").alias("rsi"))
    before = F.lag("rsi").over(Window.orderBy("n_bins"))  # one row a number of bins
    return rsi.withColumn("rsi", F.when((F.col("rsi") == 1) & (before < 1), before).otherwise(F.col("rsi")))
