"""Measures of scores and predictors, each from a score-level or bin-level aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.expressions import bin_by, equal_width, ratio
from riskloom.operators.cumulative import percentiles, running, same

#: Replicates whose sums are columns of one row; more of them go in further rows.
REPLICATES = 20


def score_table(rows: DataFrame, score: str, target: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Goods, bads and rows per score value: what all curves start from."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = rows.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    return known.groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(w * F.col(target)).alias("bad"), F.sum(w * (1 - F.col(target))).alias("good"))


def discrimination(rows: DataFrame, score: str, target: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """AUC, Gini and Kolmogorov-Smirnov by groups; ties share, a higher score stands for the target. Null for one class."""
    return curve(score_table(rows, score, target, weight, by), by)


def curve(levels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same from a table of ``score_table``."""
    t = running(levels, by, "score", ("bad", "good"))
    pairs = F.col("bad") * (F.col("cum_good") - F.col("good") / 2)
    gap = F.abs(F.col("cum_bad") / F.col("all_bad") - F.col("cum_good") / F.col("all_good"))
    two = (F.max("all_bad") > 0) & (F.max("all_good") > 0)
    t = t.withColumn("_pairs", pairs).withColumn("_gap", F.when((F.col("all_bad") > 0) & (F.col("all_good") > 0), gap))
    area = F.when(two, F.sum("_pairs") / (F.max("all_bad") * F.max("all_good")))
    out = t.groupBy(*by).agg(area.alias("auc"), F.max("_gap").alias("ks"), (F.max("all_bad") + F.max("all_good")).alias("n"))
    return out.select(*by, "auc", (2 * F.col("auc") - 1).alias("gini"), "ks", "n")


def roc(rows: DataFrame, score: str, target: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """fpr, tpr and lift from the highest score down, one row per score value."""
    t = running(score_table(rows, score, target, weight, by).withColumn("down", -F.col("score")), by, "down", ("bad", "good"))
    seen, every = F.col("cum_bad") + F.col("cum_good"), F.col("all_bad") + F.col("all_good")
    return t.select(*by, "score", ratio(F.col("cum_good"), F.col("all_good")).alias("fpr"), ratio(F.col("cum_bad"), F.col("all_bad")).alias("tpr"), ratio(seen, every).alias("share"), ratio(F.col("cum_bad") / seen, F.col("all_bad") / every).alias("lift"))


def lift(rows: DataFrame, score: str, target: str, percent: float, side: str = "low", by: Sequence[str] = ()) -> DataFrame:
    """Mean target on one side of a score percentile over the mean target."""
    p = percent / 100 if side == "low" else 1 - percent / 100
    cut = percentiles(rows, score, [p], by).withColumn("_cut", F.col("q")[0]).drop("q")
    joined = same(rows, cut, by) if by else rows.crossJoin(F.broadcast(cut))  # one row on the right
    inside = F.col(score) <= F.col("_cut") if side == "low" else F.col(score) >= F.col("_cut")
    return joined.groupBy(*by).agg(ratio(F.avg(F.when(inside, F.col(target).cast("double"))), F.avg(F.col(target).cast("double"))).alias("lift"))


def lift_levels(rows: DataFrame, score: str, target: str, percents: Sequence[int], side: str = "high") -> DataFrame:
    """The lift at several percentiles in two passes."""
    ps = [p / 100 if side == "low" else 1 - p / 100 for p in percents]
    cuts = percentiles(rows, score, ps).withColumnRenamed("q", "_cuts")
    inside = lambda i: F.col(score) <= F.col("_cuts")[i] if side == "low" else F.col(score) >= F.col("_cuts")[i]
    y = F.col(target).cast("double")
    wide = rows.crossJoin(F.broadcast(cuts)).agg(*[ratio(F.avg(F.when(inside(i), y)), F.avg(y)).alias(str(p)) for i, p in enumerate(percents)])
    return wide.unpivot([], [str(p) for p in percents], "percent", "lift").withColumn("percent", F.col("percent").cast("int"))


def information_value(rows: DataFrame, predictor: str, target: str) -> DataFrame:
    """Sum over values of (share of goods - share of bads) ln of their ratio, with one added to every count."""
    t = rows.groupBy(predictor).agg(F.sum(F.col(target)).cast("double").alias("b"), F.sum(1 - F.col(target)).cast("double").alias("g"))
    total = t.agg(F.sum(F.col("b") + 1).alias("all_b"), F.sum(F.col("g") + 1).alias("all_g"))
    pg, pb = (F.col("g") + 1) / F.col("all_g"), (F.col("b") + 1) / F.col("all_b")
    return t.crossJoin(F.broadcast(total)).agg(F.sum((pg - pb) * F.log(pg / pb)).alias("iv"))


def predictor_power(rows: DataFrame, predictors: Sequence[str], target: str) -> DataFrame:
    """IV and Gini of -x for each numeric predictor, all of them in one unpivoted pass."""
    values = F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).cast("double").alias("_v")) for p in predictors])
    cells = rows.select(F.explode(values).alias("x"), F.col(target).alias("_y")).select("x.predictor", "x._v", "_y")
    cells = cells.where("_y IS NOT NULL").groupBy("predictor", "_v").agg(F.sum("_y").cast("double").alias("b"), F.sum(1 - F.col("_y")).cast("double").alias("g"))
    total = cells.groupBy("predictor").agg(F.sum(F.col("b") + 1).alias("all_b"), F.sum(F.col("g") + 1).alias("all_g"))
    pg, pb = ((F.col(c) + 1) / F.col(f"all_{c}") for c in ("g", "b"))
    iv = cells.join(F.broadcast(total), "predictor").groupBy("predictor").agg(F.sum((pg - pb) * F.log(pg / pb)).alias("iv"))
    known = cells.where("_v IS NOT NULL").select("predictor", (-F.col("_v")).alias("score"), F.col("b").alias("bad"), F.col("g").alias("good"))
    return iv.join(curve(known, ("predictor",)), "predictor", "left").select("predictor", "iv", "gini")


def quantile_edges(rows: DataFrame, column: str, n: int) -> list[float]:
    """Inner edges of n quantile bins, each once; they are n - 1 numbers."""
    found = percentiles(rows, column, [i / n for i in range(1, n)]).first()[0] or []
    return sorted({x for x in found if x is not None})


def shares(rows: DataFrame, bin_: Column, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Share of each bin in its group."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    t = rows.groupBy(*by, bin_.alias("bin")).agg(F.sum(w).alias("n"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))))


def stability(rows: DataFrame, column: str, month: str, reference: Column, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """PSI, Bhattacharyya distance and Jensen-Shannon divergence of each month against the reference rows.

    Quantile bins of the reference, right-closed and with open ends, nulls in a bin of their own; empty shares count as ``floor``.
    """
    edges = F.array(*[F.lit(float(e)) for e in quantile_edges(rows.where(reference), column, bins)]).cast("array<double>")
    b = F.coalesce(bin_by(F.col(column), edges, "right"), F.lit(-1))
    ref = shares(rows.where(reference), b, ()).select("bin", F.col("share").alias("q"))
    months = shares(rows, b, (month,))
    every = rows.select(month).distinct().crossJoin(F.broadcast(ref.select("bin").union(months.select("bin")).distinct()))  # months x bins
    t = every.join(months.select(month, "bin", F.col("share").alias("p")), [month, "bin"], "left").join(ref, "bin", "left")
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    pf, qf, m = F.greatest(p, F.lit(floor)), F.greatest(q, F.lit(floor)), (p + q) / 2
    half = lambda x: F.when(x > 0, x * F.log(x / m) / 2).otherwise(0.0)
    return t.groupBy(month).agg(F.sum((pf - qf) * F.log(pf / qf)).alias("psi"), (-F.log(F.sum(F.sqrt(p * q)))).alias("bhattacharyya"), F.sum(half(p) + half(q)).alias("jensen_shannon"))


def psi_categories(reference: DataFrame, actual: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """PSI over the categories that both tables have."""
    a, b = (shares(x, F.col(column), (), weight).select("bin", F.col("share").alias(n)) for x, n in ((reference, "q"), (actual, "p")))
    return a.join(b, "bin").agg(F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))).alias("psi"))


def psi_consecutive(rows: DataFrame, column: str, month: str) -> DataFrame:
    """Mean PSI of each month against the one before, over common categories."""
    t = shares(rows, F.col(column), (month,))
    order = rows.select(month).distinct().withColumn("_next", F.lead(month).over(Window.orderBy(month)))  # one row a month
    a = t.join(F.broadcast(order), month).select("bin", F.col("_next").alias("m"), F.col("share").alias("q"))
    pairs = a.join(t.select("bin", F.col(month).alias("m"), F.col("share").alias("p")), ["bin", "m"])
    each = pairs.groupBy("m").agg(F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))).alias("psi"))
    return each.agg(F.avg("psi").alias("psi"))


def rank_stability(rows: DataFrame, bin_: str, month: str, target: str, base: str | None = None, weight: str | None = None, nan: bool = True, zero: bool = True) -> DataFrame:
    """How steadily bins keep their rank by bad rate, in two versions.

    rsi: the share of months that a bin is at its commonest rank, mean over bins. rsi_product: within each rank, the product
    of the shares that the bins have in it, mean over ranks. Null bins, and bins of value 0, can be left out.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = rows.where(F.col(base) == 1) if base else rows
    t = known.groupBy(month, bin_).agg(ratio(F.sum(w * F.col(target)), F.sum(w)).alias("rate"))
    t = t if nan else t.where(F.col(bin_).isNotNull())
    t = t if zero else t.where(~F.coalesce(F.col(bin_) == 0, F.lit(False)))
    t = t.withColumn("rank", F.dense_rank().over(Window.partitionBy(month).orderBy(F.col("rate").desc())))
    counts = t.groupBy(bin_, "rank").count()
    each = counts.groupBy(bin_).agg((F.max("count") / F.sum("count")).alias("share")).agg(F.avg("share").alias("rsi"))
    part = counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("rank")))
    return each.crossJoin(F.broadcast(part.groupBy("rank").agg(F.product("share").alias("x")).agg(F.avg("x").alias("rsi_product"))))


def histogram(rows: DataFrame, column: str, bins: int, target: str | None = None) -> DataFrame:
    """Equal-width bins: number, bounds, rows and, with a target, bads."""
    ends = rows.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    marked = rows.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", equal_width(F.col(column).cast("double"), F.col("_lo"), F.col("_hi"), bins))
    width = (F.max("_hi") - F.max("_lo")) / bins
    more = [F.sum(target).cast("long").alias("bads")] if target else []
    return marked.groupBy("bin").agg((F.max("_lo") + F.col("bin") * width).alias("low"), F.count("*").alias("n"), *more)


def psi_equal_width(rows: DataFrame, column: str, reference: Column, bins: int = 50, floor: float = 1e-4) -> DataFrame:
    ends = rows.where(reference).agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    t = rows.crossJoin(F.broadcast(ends)).where(F.col(column).between(F.col("_lo"), F.col("_hi"))).withColumn("bin", equal_width(F.col(column).cast("double"), F.col("_lo"), F.col("_hi"), bins))
    t = t.groupBy("bin").agg(F.sum(reference.cast("double")).alias("a"), F.sum((~reference).cast("double")).alias("b"))
    one = Window.partitionBy(F.lit(0))
    p, q = (F.greatest(F.col(c) / F.sum(c).over(one), F.lit(floor)) for c in ("b", "a"))
    return t.select(((p - q) * F.log(p / q)).alias("x")).agg(F.sum("x").alias("psi"))


def psi_in_time(rows: DataFrame, column: str, month: str, pivot: object, bins: int = 50, floor: float = 1e-4) -> DataFrame:
    """month, psi: ``psi_equal_width`` of every month against the month ``pivot``, in one pass over the rows.

    Bins are equal-width over the pivot month's range; rows beyond it, and nulls, take no part. A month without rows in the
    range has none here.
    """
    ref = F.col(month) == F.lit(pivot)
    ends = rows.where(ref).agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    inside = rows.crossJoin(F.broadcast(ends)).where(F.col(column).between(F.col("_lo"), F.col("_hi")))  # one row on the right
    t = inside.groupBy(month, equal_width(F.col(column).cast("double"), F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(F.count("*").cast("double").alias("n"))
    months = t.groupBy(month).agg(F.sum("n").alias("all"))
    own = t.where(ref).select("bin", F.col("n").alias("q"))
    every = t.select("bin").distinct()
    grid = months.crossJoin(F.broadcast(every)).join(t.select(F.col(month).alias("_m"), F.col("bin").alias("_b"), "n"), F.col(month).eqNullSafe(F.col("_m")) & (F.col("bin") == F.col("_b")), "left").join(F.broadcast(own.withColumnRenamed("bin", "_q")), F.col("bin") == F.col("_q"), "left")  # months x bins
    total = own.agg(F.sum("q").alias("all_q"))
    p, q = F.greatest(F.coalesce("n", F.lit(0.0)) / F.col("all"), F.lit(floor)), F.greatest(F.coalesce("q", F.lit(0.0)) / F.col("all_q"), F.lit(floor))
    return grid.crossJoin(F.broadcast(total)).groupBy(month).agg(F.sum((p - q) * F.log(p / q)).alias("psi"))


def bootstrap_gini(rows: DataFrame, score: str, target: str, key: str, replicates: int = 20, seed: int = 1) -> DataFrame:
    """Mean, spread and 5th and 95th percentile of the Gini over Poisson-weighted replicates, all in one aggregation.

    A row's weight in a replicate comes from a hash of its key, so reruns agree. Replicates are sums beside each other of one
    row a score, REPLICATES at a time, and become rows after that.
    """
    chunks = -(-replicates // REPLICATES)
    own = range(min(REPLICATES, replicates))
    cuts, total, term = [], 0.0, 0.36787944117144233
    for k in range(12):
        total += term
        cuts.append(total)
        term /= k + 1

    def draw(u: Column) -> Column:
        out = F
        for k, cut in enumerate(cuts):
            out = out.when(u <= cut, F.lit(float(k)))
        return out.otherwise(F.lit(float(len(cuts))))

    known = rows.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    chunk = F.lit(0) if chunks == 1 else F.explode(F.array(*[F.lit(i * REPLICATES) for i in range(chunks)]))
    known = known.select(F.col(score).cast("double").alias("score"), F.col(target).alias("_y"), F.col(key).alias("_key"), chunk.alias("_first"))
    # A hash and the draw from it are columns of their own, so that neither is computed twice.
    known = known.select("score", "_y", "_first", *[((F.pmod(F.xxhash64("_key", F.lit(seed), F.col("_first") + F.lit(i)), F.lit(10**9)) + 0.5) / 1e9).alias(f"_u{i}") for i in own])
    known = known.select("score", "_y", "_first", *[draw(F.col(f"_u{i}")).alias(f"_w{i}") for i in own])
    wide = known.groupBy("_first", "score").agg(*[F.sum(F.col(f"_w{i}") * v).alias(f"{n}{i}") for i in own for n, v in (("bad", F.col("_y")), ("good", 1 - F.col("_y")))])
    each = F.explode(F.array(*[F.struct((F.col("_first") + F.lit(i)).alias("replicate"), F.col(f"bad{i}").alias("bad"), F.col(f"good{i}").alias("good")) for i in own]))
    levels = wide.select("score", each.alias("x")).select("x.replicate", "score", "x.bad", "x.good").where((F.col("replicate") < replicates) & (F.col("bad") + F.col("good") > 0))
    g = curve(levels, ("replicate",))
    return g.agg(F.avg("gini").alias("mean"), F.stddev_samp("gini").alias("std"), F.percentile("gini", F.lit(0.05)).alias("p5"), F.percentile("gini", F.lit(0.95)).alias("p95"))


def uplift_curve(rows: DataFrame, score: str, target: str, treated: str, key: str, bins: int = 10) -> DataFrame:
    """Equal-count bins from the top, equal scores by a numeric key that no two rows share: rates of both groups and the
    running gain. A score that most rows share is cut into ranges of the key."""
    # Scores are counted first: a place in the order is the rows above a score and the rank among its equals.
    levels = running(rows.groupBy((-F.col(score).cast("double")).alias("_down")).agg(F.count("*").alias("n")), (), "_down", ("n",))
    places = levels.select("_down", (F.col("cum_n") - F.col("n")).alias("_above"), F.col("all_n").alias("_n"))
    marked = rows.select(F.col(key).alias("_key"), F.col(target).alias(target), F.col(treated).alias(treated), (-F.col(score).cast("double")).alias("_down"), F.lit(1).alias("_one"))
    ranked = running(marked, ("_down",), "_key", ("_one",)).join(places, "_down").withColumn("_k", F.col("cum__one") + F.col("_above"))
    b = ranked.withColumn("bin", F.floor((F.col("_k") - 1) * bins / F.col("_n")).cast("int")).groupBy("bin").agg(*[F.sum(F.when(F.col(treated) == v, F.col(target)).otherwise(0)).alias(f"y{v}") for v in (0, 1)], *[F.sum((F.col(treated) == v).cast("long")).alias(f"n{v}") for v in (0, 1)])
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = {c: F.sum(c).over(w) for c in ("y0", "y1", "n0", "n1")}
    return b.select("bin", (ratio(F.col("y1"), F.col("n1")) - ratio(F.col("y0"), F.col("n0"))).alias("uplift"), (ratio(cum["y1"], cum["n1"]) - ratio(cum["y0"], cum["n0"])).alias("cum_uplift"))


def niv(rows: DataFrame, bin_: str, target: str, treated: str) -> DataFrame:
    """Net information value: the sum of (net odds share) x net weight of evidence, one added to every count."""
    cell = lambda t, y: (F.sum(((F.col(treated) == t) & (F.col(target) == y)).cast("double")) + 1).alias(f"c{t}{y}")
    t = rows.groupBy(bin_).agg(*[cell(a, b) for a in (0, 1) for b in (0, 1)])
    one = Window.partitionBy(F.lit(0))
    p = {k: F.col(k) / F.sum(k).over(one) for k in ("c00", "c01", "c10", "c11")}
    nwoe = F.log(p["c11"] * p["c00"] / (p["c10"] * p["c01"]))
    return t.select(((p["c11"] * p["c00"] - p["c10"] * p["c01"]) * nwoe).alias("x")).agg(F.sum("x").alias("niv"))


def same_distribution(one: DataFrame, other: DataFrame, column: str, bins: int = 10, least: float = 0.0, ddof: int = 0) -> DataFrame:
    """statistic, df, p_value of the chi-square test that two samples have one distribution.

    Cells are equal-width over the first sample's range, the top edge in the last; values of the second outside it are in its
    size only. Empty cells do not count; neighbours of fewer than ``least`` values together are pooled upwards. Nulls and NaN
    play no part. Null where a sample is empty or fewer than two cells are left.
    """
    v = F.col(column).cast("double")
    known = lambda df, k: df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"), F.lit(k).alias("k"))
    both = known(one, 0).unionByName(known(other, 1))
    low, high, n, m = both.agg(F.min(F.when(F.col("k") == 0, F.col("v"))), F.max(F.when(F.col("k") == 0, F.col("v"))), F.sum(1 - F.col("k")), F.sum("k")).first()
    shape = "statistic double, df int, p_value double"
    if not n or not m:
        return one.sparkSession.createDataFrame([(None, None, None)], shape)
    if low == high:
        low, high = low - 0.5, high + 0.5
    cell = F.least(F.floor((F.col("v") - low) / ((high - low) / bins)), F.lit(bins - 1))
    counts = both.where(F.col("v").between(low, high)).groupBy(cell.alias("cell")).agg(F.sum(1 - F.col("k")).alias("a"), F.sum("k").alias("b")).collect()  # one row a cell
    pools: list[list[int]] = []
    for r in sorted(counts):
        if pools and sum(pools[-1]) < least:
            pools[-1] = [pools[-1][0] + r["a"], pools[-1][1] + r["b"]]
        else:
            pools.append([r["a"], r["b"]])
    if len(pools) > 1 and sum(pools[-1]) < least:
        a, b = pools.pop()
        pools[-1] = [pools[-1][0] + a, pools[-1][1] + b]
    df = len(pools) - 1 - ddof
    statistic = sum(((n / m) ** 0.5 * b - (m / n) ** 0.5 * a) ** 2 / (a + b) for a, b in pools)
    return one.sparkSession.createDataFrame([(float(statistic), df, chi_square_tail(statistic, df)) if df > 0 else (None, None, None)], shape)


def chi_square_tail(x: float, df: int) -> float:
    """P(chi-square of ``df`` degrees > x), by the recurrence over the degrees."""
    half = x / 2
    total, term, k = (math.erfc(math.sqrt(half)), math.sqrt(half / math.pi) * 2 * math.exp(-half), 3) if df % 2 else (math.exp(-half), half * math.exp(-half), 4)
    while k <= df:
        total += term
        term *= half / (k / 2)
        k += 2
    return total
