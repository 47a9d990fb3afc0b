"""Several scores side by side over samples and segments: every part of the report reads one table of score levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.expressions import ratio
from riskloom.operators.cumulative import running, same
from riskloom.sources.shared import Scratch

#: How the row over all segments, or over all samples, is named.
ALL = "All"
KEYS = ("sample", "segment", "score")


def levels_of(spread: DataFrame, keys: Sequence[str], scratch: Scratch, name: str = "levels") -> DataFrame:
    """keys, value, n, bad, good, all with their running sums from the lowest value up: rows of (keys, value, _y), folded before
    they are shuffled, and written, as every measure reads them."""
    y = F.col("_y").cast("double")
    sums = [F.count("*").alias("n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("bad"), F.coalesce(F.sum(1 - y), F.lit(0.0)).alias("good")]
    fine = scratch.put(spread.groupBy(*keys, "value").agg(*sums), f"{name}-folded")
    return scratch.put(running(fine, keys, "value", ("n", "bad", "good")), name)


def measures(levels: DataFrame, keys: Sequence[str], percents: Sequence[float] = (10,)) -> DataFrame:
    """keys, hits, mean_score, gini, ks, n_known and lift_<p>: two passes over the levels, the second for the lifts.

    lift_<p> is the rate of the rows from the exact percentile up over the rate of all. Null where a measure is not defined.
    """
    two = (F.max("all_bad") > 0) & (F.max("all_good") > 0)
    pairs = ratio(F.sum(F.col("bad") * (F.col("cum_good") - F.col("good") / 2)), F.max("all_bad") * F.max("all_good"))
    gap = F.max(F.abs(ratio(F.col("cum_bad"), F.col("all_bad")) - ratio(F.col("cum_good"), F.col("all_good"))))
    known = F.col("bad") + F.col("good")

    def percentile(share: float) -> Column:
        """Of the rows that have the score, linear between neighbours."""
        place = F.lit(float(share)) * (F.col("all_n") - 1)
        low, high = F.floor(place), F.ceil(place)
        held = lambda k: F.max(F.when((F.col("cum_n") - F.col("n") <= k) & (k < F.col("cum_n")), F.col("value")))
        a, b, p, lo, hi = held(low), held(high), F.max(place), F.max(low), F.max(high)
        return F.when(a == b, a).otherwise((hi - p) * a + (p - lo) * b)

    found = levels.groupBy(*keys).agg(
        F.max("all_n").alias("hits"),
        (F.max("all_bad") + F.max("all_good")).alias("n_known"),
        ratio(F.sum(F.col("value") * known), F.sum(known)).alias("mean_score"),
        F.when(two, 2 * pairs - 1).alias("gini"),
        F.when(two, gap).alias("ks"),
        *[percentile(1 - p / 100).alias(f"_cut_{p}") for p in percents],
    )
    cuts = found.select(*keys, *[f"_cut_{p}" for p in percents])
    at = same(levels, cuts, keys) if keys else levels.crossJoin(F.broadcast(cuts))  # one row a group on the right
    top = lambda c, p: F.sum(F.when(F.col("value") >= F.col(f"_cut_{p}"), c))
    lifts = at.groupBy(*keys).agg(*[ratio(ratio(top(F.col("bad"), p), top(known, p)), ratio(F.sum("bad"), F.sum(known))).alias(f"lift_{p}") for p in percents])
    both = same(found, lifts, keys) if keys else found.crossJoin(F.broadcast(lifts))  # one row on each side
    return both.drop(*[f"_cut_{p}" for p in percents])


@dataclass
class Comparison:
    """``levels`` by sample, segment and score, as ``levels_of`` gives them. ``sizes``: rows, targets and bads by sample and
    segment."""

    levels: DataFrame
    sizes: DataFrame

    def table(self, percents: Sequence[float] = (10,)) -> DataFrame:
        """sample, segment, n, measurable, bads, rate, and for each score its hits, mean on measurable rows, Gini, KS and lifts."""
        found = measures(self.levels, KEYS, percents).join(self.sizes, ["sample", "segment"])
        return found.select("sample", "segment", "n", "measurable", "bads", "rate", "score", "hits", "mean_score", "gini", "ks", *[f"lift_{p}" for p in percents])

    def lifts(self, percents: Sequence[float] = tuple(range(5, 95, 5))) -> DataFrame:
        """sample, segment, score, percent, lift."""
        wide = self.table(percents)
        return wide.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.col(f"lift_{p}").alias("lift")) for p in percents])).alias("x")).select(*KEYS, "x.*")

    def roc(self) -> DataFrame:
        """sample, segment, score, value, fpr, tpr: a point for each value, which is the least that counts as bad."""
        above = lambda c: F.col(f"all_{c}") - F.col(f"cum_{c}") + F.col(c)
        return self.levels.select(*KEYS, "value", ratio(above("good"), F.col("all_good")).alias("fpr"), ratio(above("bad"), F.col("all_bad")).alias("tpr"))


def compare(rows: DataFrame, scores: Sequence[str], target: str, segment: str | None = None, samples: Mapping[str, str] | None = None) -> Comparison:
    """Scores of which a higher value stands for the target, by samples (named conditions in SQL, which may overlap) and by
    the values of a segment column, each with a row over all.

    The rows are read once: each goes to its samples and to all scores it has, and folds to counts of (sample, segment, score,
    value) before it is shuffled. That table is written; rows over all segments are sums of it. A null segment is 'null'; a
    segment of a row in a sample that is itself named as the row over all is an error, as are repeated scores.
    """
    if len(set(scores)) != len(scores):
        raise ValueError("scores repeat")
    scratch = Scratch(rows.sparkSession)
    y = F.col(target).cast("double")
    own = F.coalesce(F.col(segment).cast("string"), F.lit("null")) if segment else F.lit(ALL)
    names = list(samples or {ALL: "true"})
    inside = F.array(*[F.coalesce(F.expr(c), F.lit(False)) for c in (samples or {ALL: "true"}).values()])
    values = [F.struct(F.lit(i).alias("_score"), F.col(s).cast("double").alias("value")) for i, s in enumerate(scores)]
    # A struct of number -1 counts the row itself. Rows fold before their samples get rows of their own, under short keys.
    every = F.array(F.struct(F.lit(-1).alias("_score"), F.lit(None).cast("double").alias("value")), *values)
    spread = rows.select(inside.alias("_in"), own.alias("segment"), y.alias("_y"), F.explode(every).alias("_s")).select("_in", "segment", "_y", "_s.*").where(F.exists("_in", lambda x: x) & ((F.col("_score") < 0) | F.col("value").isNotNull()))
    sums = [F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("bad"), F.coalesce(F.sum(1 - F.col("_y")), F.lit(0.0)).alias("good")]
    folded = spread.groupBy("_in", "segment", "_score", "value").agg(*sums)
    placed = F.explode(F.array_compact(F.array(*[F.when(F.col("_in")[i], F.lit(n)) for i, n in enumerate(names)])))
    named = F.array(*[F.lit(s) for s in scores])
    again = folded.select(placed.alias("sample"), "segment", F.when(F.col("_score") >= 0, F.get(named, F.col("_score"))).alias("score"), "value", "n", "bad", "good")
    fine = scratch.put(again.groupBy(*KEYS, "value").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")]), "levels")
    if segment and fine.where(F.col("segment") == ALL).limit(1).count():
        raise ValueError(f"a segment is named {ALL!r}")
    whole = fine
    if segment:
        over = fine.groupBy("sample", F.lit(ALL).alias("segment"), "score", "value").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
        whole = fine.unionByName(over.select(fine.columns))
    sizes = whole.where("score IS NULL").select("sample", "segment", "n", (F.col("bad") + F.col("good")).alias("measurable"), F.col("bad").alias("bads"), ratio(F.col("bad"), F.col("bad") + F.col("good")).alias("rate"))
    levels = running(whole.where("score IS NOT NULL"), KEYS, "value", ("n", "bad", "good"))
    return Comparison(scratch.put(levels, "running"), sizes)


def steady_order(comparison: Comparison) -> DataFrame:
    """sample, segment, score, place by falling Gini, ties by name: which score is best where."""
    t = comparison.table()
    return t.select(*KEYS, "gini", F.row_number().over(Window.partitionBy("sample", "segment").orderBy(F.col("gini").desc_nulls_last(), "score")).alias("place"))
