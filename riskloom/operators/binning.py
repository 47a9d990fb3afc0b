"""Binning and encoding of predictors: fits are small tables from one aggregation, transforms are Column expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.expressions import bin_index, ratio, woe
from riskloom.operators.cumulative import running
from riskloom.operators.metrics import curve, quantile_edges

#: Distinct values up to which a tree is grown on the driver; with more its splits are found in Spark.
VALUES = 10_000


@dataclass
class Bins:
    """Fitted bins of one predictor: inner edges or groups of categories, and the weight of evidence of each."""

    column: str
    edges: list[float] | None = None
    groups: list[list[str]] | None = None
    woes: list[float] = field(default_factory=list)
    nan_woe: float = 0.0
    unknown_woe: float = 0.0

    def index(self) -> Column:
        """Bin number; null and unknown values come after the last."""
        c = F.col(self.column)
        if self.edges is not None:
            return F.coalesce(bin_index(c, self.edges), F.lit(len(self.edges) + 1))
        out = F.when(c.isNull(), F.lit(len(self.groups)))
        for i, g in enumerate(self.groups):
            out = out.when(c.cast("string").isin(*g), F.lit(i))
        return out.otherwise(F.lit(len(self.groups)))

    def woe(self) -> Column:
        i, out = self.index(), F.when(F.col(self.column).isNull(), F.lit(float(self.nan_woe)))
        for k, w in enumerate(self.woes):
            out = out.when(i == k, F.lit(float(w)))
        return out.otherwise(F.lit(float(self.unknown_woe)))

    def names(self) -> list[str]:
        if self.groups is not None:
            return [", ".join(g)[:40] for g in self.groups]
        ends = [-math.inf, *self.edges, math.inf]
        return [f"[{a:.3f}, {b:.3f})" for a, b in zip(ends, ends[1:], strict=False)]

    def short_name(self) -> Column:
        i, out = self.index(), F
        for k, n in enumerate(self.names()):
            out = out.when(i == k, F.lit(n))
        return out.otherwise(F.lit("NaN"))

    def dummies(self) -> list[Column]:
        i, n = self.index(), len(self.names())
        return [(i == k).cast("int").alias(f"{self.column}_DMY_{k}") for k in range(n)] + [(i == n).cast("int").alias(f"{self.column}_DMY_NaN")]

    def sql(self) -> str:
        """The transform as a CASE expression; numbers in scientific form, which SQL reads as doubles."""
        c, n = self.column, "{:.17e}".format
        if self.groups is not None:
            arms = [f"WHEN {c} IN ({', '.join(repr(x) for x in g)}) THEN {n(w)}" for g, w in zip(self.groups, self.woes, strict=True)]
        else:
            arms = [f"WHEN {c} < {n(e)} THEN {n(w)}" for e, w in zip(self.edges, self.woes, strict=False)] + [f"WHEN {c} IS NOT NULL THEN {n(self.woes[-1])}"]
        return f"CASE WHEN {c} IS NULL THEN {n(self.nan_woe)} {' '.join(arms)} ELSE {n(self.unknown_woe)} END AS {c}_WOE"

    def group_sql(self) -> str:
        """The bin's name as a CASE expression: ``short_name`` as text."""
        c, n, quoted = self.column, "{:.17e}".format, lambda x: "'" + x.replace("'", "''") + "'"
        names = [quoted(x) for x in self.names()]
        if self.groups is not None:
            arms = [f"WHEN {c} IN ({', '.join(map(quoted, g))}) THEN {x}" for g, x in zip(self.groups, names, strict=True)]
        else:
            arms = [f"WHEN {c} < {n(e)} THEN {x}" for e, x in zip(self.edges, names, strict=False)] + [f"WHEN {c} IS NOT NULL THEN {names[-1]}"]
        return f"CASE WHEN {c} IS NULL THEN 'NaN' {' '.join(arms)} ELSE 'NaN' END AS {c}_GROUP"


def save(bins: Sequence[Bins]) -> str:
    return json.dumps([asdict(b) for b in bins])


def load(text: str) -> list[Bins]:
    return [Bins(**b) for b in json.loads(text)]


def grow(table: Sequence[tuple[float, float, float]], leaves: int, least: float) -> list[float]:
    """Edges of a best-first tree over (value, weight, bads) in order of value: the split that lowers the Gini impurity most
    comes first, until there are so many leaves. Edges lie midway between values, in the order of their splits."""
    n = len(table)
    w, b = [0.0], [0.0]
    for _, x, y in table:
        w.append(w[-1] + x)
        b.append(b[-1] + y)
    impurity = lambda i, j: 0.0 if w[j] <= w[i] else 2 * (b[j] - b[i]) * (1 - (b[j] - b[i]) / (w[j] - w[i]))

    def split(i: int, j: int) -> tuple[float, int]:
        fits = [k for k in range(i + 1, j) if w[k] - w[i] >= least and w[j] - w[k] >= least]
        return max(((impurity(i, j) - impurity(i, k) - impurity(k, j), -k) for k in fits), default=(0.0, 0))

    open_, edges = {(0, n): split(0, n)}, []
    while len(edges) + 1 < leaves and open_:
        (i, j), (gain, k) = max(open_.items(), key=lambda x: (x[1][0], -x[0][0]))
        if gain <= 1e-12:
            break
        k = -k
        edges.append((table[k - 1][0] + table[k][0]) / 2)
        del open_[i, j]
        open_[i, k], open_[k, j] = split(i, k), split(k, j)
    return edges


def value_table(rows: DataFrame, column: str, target: str, weight: str | None = None) -> DataFrame:
    """v, w, b: each value with its weight and its bads."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    v = F.col(column).cast("double")
    known = rows.where(v.isNotNull() & F.col(target).isNotNull())
    return known.groupBy(v.alias("v")).agg(F.sum(w).alias("w"), F.sum(w * F.col(target)).cast("double").alias("b"))


def tree_edges(table: DataFrame, leaves: int, least: float) -> list[float]:
    """Edges of ``grow`` in the order they are made, so that a tree of fewer leaves is a beginning of the list.

    Up to VALUES values are looked at on the driver. Beyond them the same splits are found by running sums over all values:
    each open leaf sends its best split, so only edges reach the driver.
    """
    few = table.limit(VALUES + 1).collect()
    if len(few) <= VALUES:
        return grow(sorted((r["v"], r["w"], r["b"]) for r in few), leaves, least)
    sums = running(table, (), "v", ("w", "b")).select("v", F.col("cum_w").alias("w"), F.col("cum_b").alias("b"), F.col("all_w").alias("aw"), F.col("all_b").alias("ab")).persist()

    def impurity(b: Column, w: Column) -> Column:
        return F.when(w > 0, 2 * b * (1 - b / w)).otherwise(0.0)

    def split(low: tuple, high: tuple) -> tuple | None:
        """Of the values above ``low`` and up to ``high``, given with their running sums: gain, edge, and where it is."""
        inside = sums.where((F.col("v") > low[0]) & (F.col("v") < high[0]))
        (lw, lb), (hw, hb) = low[1:], high[1:]
        left = impurity(F.col("b") - lb, F.col("w") - lw)
        right = impurity(F.lit(hb) - F.col("b"), F.lit(hw) - F.col("w"))
        fits = (F.col("w") - lw >= least) & (F.lit(hw) - F.col("w") >= least)
        gain = F.when(fits, impurity(F.lit(hb - lb), F.lit(hw - lw)) - left - right)
        best = inside.select(gain.alias("gain"), "v", "w", "b").where("gain IS NOT NULL").agg(F.max_by(F.struct("gain", "v", "w", "b"), F.struct("gain", F.negate("v"))).alias("x")).first()["x"]
        if best is None or best["gain"] <= 1e-12:
            return None
        after = sums.where(F.col("v") > best["v"]).agg(F.min("v")).first()[0]
        return best["gain"], (best["v"] + after) / 2, (best["v"], best["w"], best["b"])

    try:
        end = sums.agg(F.max("v"), F.max("aw"), F.max("ab")).first()
        ends = ((float("-inf"), 0.0, 0.0), tuple(end))
        open_, edges = {ends: split(*ends)}, []
        while len(edges) + 1 < leaves:
            able = [(x[0], -leaf[0][0], leaf) for leaf, x in open_.items() if x]
            if not able:
                break
            leaf = max(able)[2]
            _, edge, at = open_.pop(leaf)
            edges.append(edge)
            open_[leaf[0], at], open_[at, leaf[1]] = split(leaf[0], at), split(at, leaf[1])
        return edges
    finally:
        sums.unpersist()


def bin_table(rows: DataFrame, index: Column, target: str, weight: str | None = None, smooth: float = 0.001) -> DataFrame:
    """Per bin: rows, bads, rate, share, shares of goods and bads, weight of evidence, information value."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = rows.where(F.col(target).isNotNull())
    t = known.groupBy(index.alias("bin")).agg(F.sum(w).alias("n"), F.sum(w * F.col(target)).alias("bads"))
    one = Window.partitionBy(F.lit(0))
    n, b = F.sum("n").over(one), F.sum("bads").over(one)
    t = t.withColumn("_n", n).withColumn("_b", b)
    good, bad = ratio(F.col("n") - F.col("bads"), F.col("_n") - F.col("_b")), ratio(F.col("bads"), F.col("_b"))
    iv = F.when((good > 0) & (bad > 0), (good - bad) * F.log(good / bad)).otherwise(0.0)
    return t.select("bin", "n", "bads", ratio(F.col("bads"), F.col("n")).alias("rate"), ratio(F.col("n"), F.col("_n")).alias("share"), good.alias("dist_good"), bad.alias("dist_bad"), woe(F.col("bads"), F.col("n"), F.col("_b"), F.col("_n"), smooth).alias("woe"), iv.alias("iv"))


def with_woes(rows: DataFrame, bins: Bins, target: str, weight: str | None = None, smooth: float = 0.001) -> Bins:
    """The bins with weights of evidence from these rows; nulls get their own."""
    t = {r["bin"]: r["woe"] for r in bin_table(rows, bins.index(), target, weight, smooth).collect()}  # one row a bin
    n = len(bins.names())
    bins.woes = [float(t.get(i, 0.0)) for i in range(n)]
    bins.nan_woe = float(t.get(n, 0.0))
    return bins


def fit_numeric(rows: DataFrame, column: str, target: str, groups: int = 5, least: float = 1, weight: str | None = None, smooth: float = 0.001, edges: Sequence[float] | None = None) -> Bins:
    found = list(edges) if edges is not None else sorted(tree_edges(value_table(rows, column, target, weight), groups, least))
    return with_woes(rows, Bins(column, edges=found), target, weight, smooth)


def fit_categorical(rows: DataFrame, column: str, target: str, groups: int = 5, least: float = 1, weight: str | None = None, smooth: float = 0.001, most: int = VALUES) -> Bins:
    """Categories by their event rate; those below ``least`` rows are pooled and share a rate; then a tree over the rates.

    Bins name their categories, so more than ``most`` of them are refused: ``merge_rare`` makes them fewer.
    """
    c = F.col(column).cast("string")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    t = rows.where(c.isNotNull() & F.col(target).isNotNull()).groupBy(c.alias("c")).agg(F.sum(w).alias("w"), F.sum(w * F.col(target)).alias("b")).limit(most + 1).collect()
    if len(t) > most:
        raise ValueError(f"{column} has more than {most} categories")
    rare = [r for r in t if r["w"] < least]
    pooled = sum(r["b"] for r in rare) / sum(r["w"] for r in rare) if rare else 0.0
    rate = {r["c"]: pooled if r["w"] < least else r["b"] / r["w"] for r in t}
    by: dict[float, list[float]] = {}
    for r in t:
        x = by.setdefault(rate[r["c"]], [0.0, 0.0])
        x[0] += r["w"]
        x[1] += r["b"]
    edges = sorted(grow(sorted((v, *x) for v, x in by.items()), groups, least))
    found: dict[int, list[str]] = {}
    for cat in sorted(rate):
        found.setdefault(sum(rate[cat] >= e for e in edges), []).append(cat)
    return with_woes(rows, Bins(column, groups=[found[k] for k in sorted(found)]), target, weight, smooth)


def fit(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, **settings) -> list[Bins]:
    return [fit_numeric(rows, c, target, **settings) for c in numeric] + [fit_categorical(rows, c, target, **settings) for c in categorical]


def transform(rows: DataFrame, bins: Sequence[Bins], to: str = "woe") -> DataFrame:
    """Adds <column>_WOE, _GRP, _RNG or dummies for every fitted predictor; one projection, no shuffle."""
    made = {"woe": lambda b: [b.woe().alias(f"{b.column}_WOE")], "group_number": lambda b: [b.index().alias(f"{b.column}_GRP")], "shortnames": lambda b: [b.short_name().alias(f"{b.column}_RNG")], "dummy": lambda b: b.dummies()}[to]
    return rows.select("*", *[c for b in bins for c in made(b)])


def fit_stable(rows: DataFrame, column: str, target: str, month: str, most: int = 6, least: float = 1) -> Bins:
    """Of trees with 2 to ``most`` leaves, the largest whose bins keep their rank by rate in every month; else two leaves."""
    from riskloom.operators.metrics import rank_stability

    edges, best = tree_edges(value_table(rows, column, target), most, least), None
    for n in range(2, most + 1):
        b = Bins(column, edges=sorted(edges[: n - 1]))
        steady = rank_stability(rows.withColumn("_bin", b.index()), "_bin", month, target).first()["rsi"]
        if best is None or (steady or 0) >= 1 - 1e-9:
            best = b
    return with_woes(rows, best, target)


def net_woe(rows: DataFrame, index: Column, target: str, treated: str) -> DataFrame:
    """Weight of evidence of the treated less that of the others, with one added to the counts."""
    cell = lambda t, y: F.sum(((F.col(treated) == t) & (F.col(target) == y)).cast("double")).alias(f"c{t}{y}")
    t = rows.groupBy(index.alias("bin")).agg(*[cell(a, b) for a in (0, 1) for b in (0, 1)])
    one = Window.partitionBy(F.lit(0))
    side = lambda t: F.log((F.col(f"c{t}0") + 1) / (F.sum(f"c{t}0").over(one) + 1)) - F.log((F.col(f"c{t}1") + 1) / (F.sum(f"c{t}1").over(one) + 1))
    return t.select("bin", (side(1) - side(0)).alias("nwoe"))


def gini_of_groups(groups: DataFrame, woe_: str = "woe", share: str = "share", rate: str = "rate") -> DataFrame:
    """The Gini that a grouped predictor has as a score: groups in the order of falling weight of evidence, the best first.

    One row a group comes in, so the window over all of them is small. Groups of one weight of evidence are one.
    """
    bad, good = F.col(share) * F.col(rate), F.col(share) * (1 - F.col(rate))
    levels = groups.groupBy((-F.col(woe_)).alias("score")).agg(F.sum(bad).alias("bad"), F.sum(good).alias("good"))
    return curve(levels).select("gini")


def woe_encoder(rows: DataFrame, column: str, target: str, smooth: float = 0.001, cap: float = 5.0) -> DataFrame:
    """value, woe capped to +-cap."""
    return bin_table(rows, F.col(column), target, smooth=smooth).select(F.col("bin").alias("value"), F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col("woe"))).alias("woe"))


def mean_encoder(rows: DataFrame, column: str, target: str, strength: float = 0.01, weight: str | None = None, as_logit: bool = False) -> DataFrame:
    """value, (sum of targets + mean x strength x all weight) / (weight + strength x all weight); null values are a value."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    t = rows.groupBy(F.col(column).alias("value")).agg(F.sum(w).alias("w"), F.sum(w * F.col(target)).alias("y"))
    one = Window.partitionBy(F.lit(0))
    everything, mean = F.sum("w").over(one), F.sum("y").over(one) / F.sum("w").over(one)
    p = (F.col("y") + mean * strength * everything) / (F.col("w") + strength * everything)
    return t.select("value", (F.log(p / (1 - p)) if as_logit else p).alias("encoded"))


def odds_encoder(rows: DataFrame, column: str, target: str) -> DataFrame:
    """value, the share of goods over the share of bads with one added to each count; no logarithm."""
    t = rows.groupBy(F.col(column).alias("value")).agg(F.sum(1 - F.col(target)).alias("g"), F.sum(target).alias("b"))
    one = Window.partitionBy(F.lit(0))
    return t.select("value", (((F.col("g") + 1) / F.sum(F.col("g") + 1).over(one)) / ((F.col("b") + 1) / F.sum(F.col("b") + 1).over(one))).alias("encoded"))


def merge_rare(rows: DataFrame, column: str, least: int, rare: str = "RARE") -> DataFrame:
    """Categories of fewer rows become one; the counts are joined, so no category is gathered in one task."""
    few = rows.groupBy(column).count().where(F.col("count") < least).select(F.col(column).alias("_few"))
    return rows.join(few, rows[column].eqNullSafe(few["_few"]), "left").withColumn(column, F.when(F.col("_few").isNotNull(), F.lit(rare)).otherwise(F.col(column))).drop("_few")


def discretize(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Adds <column>_BIN: quantile bins, left closed."""
    return rows.withColumn(f"{column}_BIN", bin_index(F.col(column), quantile_edges(rows, column, n)))


def two_way(rows: DataFrame, a: Column, b: Column, target: str) -> DataFrame:
    """Rows, bads and rate of each pair of bins."""
    return rows.groupBy(a.alias("row_bin"), b.alias("col_bin")).agg(F.count("*").alias("n"), F.sum(target).cast("long").alias("bads"), F.avg(F.col(target).cast("double")).alias("rate"))


def weighted_quantiles(rows: DataFrame, column: str, weight: str, shares: Sequence[float]) -> DataFrame:
    """The least value at which the running weight reaches each share of the total."""
    from riskloom.operators.cumulative import running

    t = running(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.sum(F.col(weight).cast("double")).alias("w")), (), "v", ("w",))
    picks = [F.min(F.when(F.col("cum_w") >= F.lit(s) * F.col("all_w") - 1e-9, F.col("v")))for s in shares]
    made = F.array(*[F.struct(F.lit(s).alias("share"), p.alias("value")) for s, p in zip(shares, picks, strict=True)])
    return t.agg(made.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def grow_uplift(table: Sequence[tuple[float, float, float, float, float]], leaves: int, least: float) -> list[float]:
    """Edges of a best-first tree over (value, treated rows, their targets, other rows, their targets): the split that sets
    the uplifts of its sides furthest apart comes first."""
    n = len(table)
    sums = [[0.0] * 4]
    for row in table:
        sums.append([a + b for a, b in zip(sums[-1], row[1:], strict=True)])

    def split(i: int, j: int) -> tuple[float, int]:
        best = (0.0, 0)
        for k in range(i + 1, j):
            sides = [[b - a for a, b in zip(sums[x], sums[y], strict=True)] for x, y in ((i, k), (k, j))]
            if all(s[0] >= least and s[2] >= least for s in sides):
                up = [s[1] / s[0] - s[3] / s[2] for s in sides]
                size = [s[0] + s[2] for s in sides]
                best = max(best, ((up[0] - up[1]) ** 2 * size[0] * size[1] / sum(size), -k))
        return best

    open_, edges = {(0, n): split(0, n)}, []
    while len(edges) + 1 < leaves and open_:
        (i, j), (gain, k) = max(open_.items(), key=lambda x: (x[1][0], -x[0][0]))
        if gain <= 1e-12:
            break
        edges.append((table[-k - 1][0] + table[-k][0]) / 2)
        del open_[i, j]
        open_[i, -k], open_[-k, j] = split(i, -k), split(-k, j)
    return sorted(edges)


def _uplift_edges(table: DataFrame, leaves: int, least: float) -> list[float]:
    """The edges of ``grow_uplift`` from running sums over all values: each open leaf sends its best split only."""
    names = ("n1", "y1", "n0", "y0")
    sums = running(table, (), "v", names).persist()

    def split(low: tuple, high: tuple) -> tuple | None:
        """Of the values above ``low`` and up to ``high``, given with their running sums: gain, edge, and where it is."""
        inside = sums.where((F.col("v") > low[0]) & (F.col("v") < high[0]))
        left = [F.col(f"cum_{c}") - x for c, x in zip(names, low[1:], strict=True)]
        right = [F.lit(x) - F.col(f"cum_{c}") for c, x in zip(names, high[1:], strict=True)]
        up = [s[1] / s[0] - s[3] / s[2] for s in (left, right)]
        size = [s[0] + s[2] for s in (left, right)]
        fits = (left[0] >= least) & (left[2] >= least) & (right[0] >= least) & (right[2] >= least)
        gain = F.when(fits, (up[0] - up[1]) * (up[0] - up[1]) * size[0] * size[1] / (size[0] + size[1]))
        best = inside.select(gain.alias("gain"), "v", *[f"cum_{c}" for c in names]).where("gain IS NOT NULL").agg(F.max_by(F.struct("*"), F.struct("gain", F.negate("v"))).alias("x")).first()["x"]
        if best is None or best["gain"] <= 1e-12:
            return None
        after = sums.where(F.col("v") > best["v"]).agg(F.min("v")).first()[0]
        return best["gain"], (best["v"] + after) / 2, tuple(best)[1:]

    try:
        end = sums.agg(F.max("v"), *[F.max(f"all_{c}") for c in names]).first()
        ends = ((float("-inf"), 0.0, 0.0, 0.0, 0.0), tuple(end))
        open_, edges = {ends: split(*ends)}, []
        while len(edges) + 1 < leaves:
            able = [(x[0], -leaf[0][0], leaf) for leaf, x in open_.items() if x]
            if not able:
                break
            leaf = max(able)[2]
            _, edge, at = open_.pop(leaf)
            edges.append(edge)
            open_[leaf[0], at], open_[at, leaf[1]] = split(leaf[0], at), split(at, leaf[1])
        return sorted(edges)
    finally:
        sums.unpersist()


def fit_uplift(rows: DataFrame, column: str, target: str, treated: str, groups: int = 4, least: float = 1) -> list[float]:
    """Edges for uplift from the values' counts, each side of a split with ``least`` rows of either kind. Up to VALUES values
    are looked at on the driver; beyond them the same splits are found in Spark."""
    least = max(1, least)
    cell = lambda t: [F.sum((F.col(treated) == t).cast("double")), F.sum(F.when(F.col(treated) == t, F.col(target)).otherwise(0).cast("double"))]
    names = ("n1", "y1", "n0", "y0")
    t = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(*[c.alias(n) for n, c in zip(names, [*cell(1), *cell(0)], strict=True)])
    found = t.limit(VALUES + 1).collect()
    if len(found) > VALUES:
        return _uplift_edges(t, groups, least)
    return grow_uplift(sorted((r["v"], r["n1"], r["y1"], r["n0"], r["y0"]) for r in found), groups, least)
