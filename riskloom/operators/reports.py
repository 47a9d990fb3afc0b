"""Report tables over time, segments and samples. Long tables; a pivot is left to the reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.expressions import bin_index, logit, ratio
from riskloom.operators import comparison, metrics
from riskloom.operators.cumulative import percentiles, running
from riskloom.sources.shared import Scratch


def sample_description(rows: DataFrame, by: Sequence[str], target: str, base: str | None = None, total: bool = True) -> DataFrame:
    """Observations, measurable rows, bads and rate by groups, with a row of totals (nulls in the group columns)."""
    b = F.col(base) if base else F.lit(1)
    grouped = rows.rollup(*by) if total else rows.groupBy(*by)
    return grouped.agg(F.count("*").alias("n"), F.sum(b).cast("long").alias("measurable"), F.sum(b * F.col(target)).cast("long").alias("bads"), ratio(F.sum(b * F.col(target)), F.sum(b)).alias("rate"))


def risk_in_time(rows: DataFrame, month: str, value: str, target: str) -> DataFrame:
    """Rows, bads and rate by month and value, with both margins."""
    t = rows.cube(month, value).agg(F.count("*").alias("n"), F.sum(target).cast("long").alias("bads"), F.avg(F.col(target).cast("double")).alias("rate"), F.grouping_id().alias("level"))
    return t.select(F.col(month).alias("month"), F.col(value).alias("value"), "level", "n", "bads", "rate")


def share_in_time(rows: DataFrame, month: str, value: str) -> DataFrame:
    t = rows.groupBy(month, value).count()
    return t.select(F.col(month).alias("month"), F.col(value).alias("value"), F.col("count").alias("n"), (F.col("count") / F.sum("count").over(Window.partitionBy(month))).alias("share"))


def complete_in_time(rows: DataFrame, month: str, value: str) -> DataFrame:
    """Counts for every month and value, 0 where there are none; the two lists are distinct values, not rows."""
    cells = rows.select(month).distinct().crossJoin(F.broadcast(rows.select(value).distinct()))
    return cells.join(rows.groupBy(month, value).count(), [month, value], "left").select(F.col(month).alias("month"), F.col(value).alias("value"), F.coalesce("count", F.lit(0)).alias("n"))


def empty_share(rows: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Share of nulls per column and group, in one pass."""
    wide = rows.groupBy(by).agg(*[F.bround(F.avg(F.col(c).isNull().cast("double")), 3).alias(c) for c in columns])
    return wide.unpivot([by], list(columns), "column", "empty").withColumnRenamed(by, "group")


def profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: type, distinct values, fill share; one aggregation."""
    kinds = dict(rows.dtypes)
    stats = rows.agg(*[F.struct(F.countDistinct(c).alias("n_distinct"), F.avg(F.col(c).isNotNull().cast("double")).alias("fill")).alias(c) for c in columns])
    out = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(c)["n_distinct"].alias("n_distinct"), F.col(c)["fill"].alias("fill")) for c in columns])
    return stats.select(F.explode(out).alias("x")).select("x.*")


def describe_numeric(rows: DataFrame, column: str, target: str, weight: str | None = None) -> DataFrame:
    """Mean, spread, extremes and quantiles over all rows, bads and goods."""
    c = F.col(column).cast("double")
    w = F.when(c.isNotNull(), F.col(weight).cast("double") if weight else F.lit(1.0))
    parts = rows.select(c.alias("_c"), w.alias("_w"), F.explode(F.array(F.lit("all"), F.col(target).cast("int").cast("string"))).alias("part")).where(F.col("part").isin("all", "0", "1"))
    mean = F.sum(F.col("_w") * F.col("_c")) / F.sum("_w")
    std = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("_w") * F.col("_c") * F.col("_c")) / F.sum("_w") - mean * mean))
    t = parts.groupBy("part").agg(F.count("_c").alias("n"), mean.alias("mean"), std.alias("std"), F.min("_c").alias("min"), F.max("_c").alias("max"))
    q = percentiles(parts, "_c", (0.25, 0.5, 0.75), ("part",))
    every = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in ("all", "1", "0")])).alias("part"))
    out = every.join(t, "part", "left").join(q, "part", "left")
    return out.select("part", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max")


def stats_in_time(rows: DataFrame, month: str, column: str) -> DataFrame:
    c = F.col(column).cast("double")
    t = rows.groupBy(F.col(month).alias("month")).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    shares = (0.1, 0.25, 0.5, 0.75, 0.9)
    q = percentiles(rows, column, shares, (month,)).withColumnRenamed(month, "_month")
    joined = t.join(q, F.col("month").eqNullSafe(F.col("_month")), "left")
    return joined.select("month", "n", "mean", "std", "min", *[F.col("q")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(shares)], "max")


def distinct_per_entity(rows: DataFrame, id: str, columns: Sequence[str]) -> DataFrame:
    """Per column: least, mean and most distinct values of an entity."""
    t = rows.groupBy(id).agg(*[F.countDistinct(c).alias(c) for c in columns])
    wide = t.agg(*[F.struct(F.min(c).alias("least"), F.avg(c).alias("mean"), F.max(c).alias("most")).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["least"].alias("least"), F.col(c)["mean"].alias("mean"), F.col(c)["most"].alias("most")) for c in columns])).alias("x")).select("x.*")


def log_risk(rows: DataFrame, column: str, target: str, bins: int = 10, month: str | None = None) -> DataFrame:
    """ln(p / (1 - p)) of right-closed quantile bins; null where a bin has one class."""
    i = bin_index(F.col(column), metrics.quantile_edges(rows, column, bins), "right")
    t = rows.groupBy(*([F.col(month).alias("month")] if month else []), i.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("rate"))
    return t.withColumn("log_risk", F.when((F.col("rate") > 0) & (F.col("rate") < 1), logit(F.col("rate"))))


#: Different values of a column whose ranks are sent to every task; beyond it the ranks are joined.
RANKS = 200_000


def correlation(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman correlation of each pair: ranks with shared ties come from value counts, not from one sorted task.

    All columns go through one count of (column, value). Its ranks are a written table of values, of which each column joins
    its own; rows stay where they are as long as a column has at most RANKS different values, which are counted.
    """
    scratch = Scratch(rows.sparkSession)
    named = rows.select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    values = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(f"_v{i}").alias("_v")) for i in range(len(columns))])
    counts = named.select(F.explode(values).alias("x")).select("x.*").where("_v IS NOT NULL").groupBy("_c", "_v").agg(F.count("*").alias("n"))
    t = running(scratch.put(counts, "counts"), ("_c",), "_v", ("n",))
    ranks = scratch.put(t.select("_c", "_v", (F.col("cum_n") - (F.col("n") - 1) / 2).alias("_r")), "ranks")
    sizes = {r["_c"]: r["count"] for r in ranks.groupBy("_c").count().collect()}  # one row a column
    for i in range(len(columns)):
        own = ranks.where(F.col("_c") == i).select(F.col("_v").alias(f"_v{i}"), F.col("_r").alias(f"_r{i}"))
        named = named.join(F.broadcast(own) if sizes.get(i, 0) <= RANKS else own, f"_v{i}", "left")
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    wide = named.agg(F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.corr(f"_r{i}", f"_r{j}").alias("rho")) for i, j in pairs]).alias("x"))
    return wide.select(F.explode("x").alias("x")).select("x.*")


def transition(rows: DataFrame, old: str, new: str, target: str, bins: int = 5) -> DataFrame:
    """Old against new right-closed quantile: rows, share of the old bin, rate."""
    a, b = (bin_index(F.col(c), metrics.quantile_edges(rows, c, bins), "right") for c in (old, new))
    t = rows.groupBy(a.alias("old_bin"), b.alias("new_bin")).agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("rate"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("old_bin")))


def calibration(rows: DataFrame, score: str, target: str, bins: int = 10) -> DataFrame:
    """Mean score against mean target by quantile bin of the score."""
    i = bin_index(F.col(score), metrics.quantile_edges(rows, score, bins))
    return rows.groupBy(i.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(score).cast("double")).alias("mean_score"), F.avg(F.col(target).cast("double")).alias("mean_target"))


def approval(rows: DataFrame, score: str, target: str, rates: Sequence[float]) -> DataFrame:
    """At each approval rate, lowest scores first: the cutoff, the bad rate below and above it, false rejects and approvals."""
    t = running(metrics.score_table(rows, score, target), (), "score", ("bad", "good"))
    seen, every = F.col("cum_bad") + F.col("cum_good"), F.col("all_bad") + F.col("all_good")
    t = t.withColumn("_seen", seen).withColumn("_every", every)
    picks = []
    for r in rates:
        inside = F.col("_seen") <= F.lit(r) * F.col("_every") + 1e-9
        last = F.max(F.when(inside, F.struct("_seen", "score", "cum_bad", "cum_good")))
        bad, n = F.max("all_bad"), F.max("_every")
        picks.append(F.struct(F.lit(r).alias("rate"), last["score"].alias("cutoff"), ratio(last["cum_bad"], last["_seen"]).alias("bad_rate_below"), ratio(bad - last["cum_bad"], n - last["_seen"]).alias("bad_rate_above"), ratio(F.max("all_good") - last["cum_good"], n).alias("false_reject"), ratio(last["cum_bad"], n).alias("false_approve")))
    return t.agg(F.array(*picks).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def expected_approval(rows: DataFrame, score: str, rates: Sequence[float], subset: str) -> DataFrame:
    """Approval rate of a subset at the cutoffs that give ``rates`` overall."""
    cuts = percentiles(rows, score, rates).withColumnRenamed("q", "_cuts")
    inside = rows.where(F.expr(subset)).crossJoin(F.broadcast(cuts))
    made = F.array(*[F.struct(F.lit(r).alias("rate"), F.avg((F.col(score) <= F.col("_cuts")[i]).cast("double")).alias("subset_rate")) for i, r in enumerate(rates)])
    return inside.agg(made.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def performance(rows: DataFrame, scores: Sequence[str], target: str, by: Sequence[str] = (), percent: float = 10) -> DataFrame:
    """Gini, KS and lift of several scores by groups, in long form; rows are read once, and one written table of score levels
    serves all measures.

    A score without values in a group has no row there. ``n`` counts the rows with the score and the target.
    """
    values = F.array(*[F.struct(F.lit(s).alias("_score"), F.col(s).cast("double").alias("value")) for s in scores])
    spread = rows.select(*by, F.col(target).alias("_y"), F.explode(values).alias("_s")).select(*by, "_y", "_s.*").where("value IS NOT NULL")
    keys = (*by, "_score")
    levels = comparison.levels_of(spread, keys, Scratch(rows.sparkSession))
    found = comparison.measures(levels, keys, (percent,))
    return found.select(*by, F.col("_score").alias("score"), "gini", "ks", F.col(f"`lift_{percent}`").alias("lift"), F.col("n_known").alias("n"))


def hit_rate(rows: DataFrame, scores: Sequence[str], month: str) -> DataFrame:
    """Share of rows with each score by month."""
    wide = rows.groupBy(F.col(month).alias("month")).agg(*[F.avg(F.col(s).isNotNull().cast("double")).alias(s) for s in scores])
    return wide.unpivot(["month"], list(scores), "score", "hit_rate")


def moving_gini(rows: DataFrame, score: str, target: str, month: str) -> DataFrame:
    """Gini by month and its mean over the months so far; the window has one row a month."""
    g = metrics.discrimination(rows, score, target, None, (month,)).select(F.col(month).alias("month"), "gini")
    return g.withColumn("mean_so_far", F.avg("gini").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))


def reject_order(rows: DataFrame, value: str, target: str, reject: str) -> DataFrame:
    """Per value: rates of target and reject with one added, and whether both put the value at the same rank."""
    t = rows.groupBy(value).agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("target_rate"), F.avg(F.col(reject).cast("double")).alias("reject_rate"))
    one = Window.partitionBy(F.lit(0))
    ranked = t.withColumn("target_rank", F.rank().over(one.orderBy("target_rate"))).withColumn("reject_rank", F.rank().over(one.orderBy("reject_rate")))
    return ranked.select(F.col(value).alias("value"), "n", "target_rate", "reject_rate", (F.col("target_rank") == F.col("reject_rank")).alias("same_order"))
