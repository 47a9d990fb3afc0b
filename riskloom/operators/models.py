"""Logistic models on top of pyspark.ml, selection by Gini, variable clusters, scorecards as expressions and SQL."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.expressions import expit
from riskloom.operators import metrics
from riskloom.operators.binning import Bins
from riskloom.operators.metrics import chi_square_tail
from riskloom.sources.shared import Scratch


#: Rows of a part of the data that a boosted fit keeps and reads again for every level of every tree.
PART = 250_000


@dataclass
class Logit:
    columns: list[str]
    coefficients: list[float]
    intercept: float

    def linear(self) -> Column:
        out = F.lit(self.intercept)
        for c, b in zip(self.columns, self.coefficients, strict=True):
            out = out + F.lit(b) * F.col(c)
        return out

    def score(self) -> Column:
        """The probability as one expression: to score is a projection."""
        return expit(self.linear())


def fit_logit(rows: DataFrame, columns: Sequence[str], target: str, weight: str | None = None, penalty: float = 0.0, l1: float = 0.0) -> Logit:
    data = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(rows)
    lr = LogisticRegression(featuresCol="_x", labelCol=target, regParam=penalty, elasticNetParam=l1)
    model = (lr.setWeightCol(weight) if weight else lr).fit(data)
    return Logit(list(columns), [float(b) for b in model.coefficients], float(model.intercept))


def gini_of(rows: DataFrame, model: Logit, target: str) -> float:
    return metrics.discrimination(rows.withColumn("_score", model.score()), "_score", target).first()["gini"] or 0.0


def folded(rows: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """The different rows of the columns and the target, with ``_n``, how many there are: written once for all fits and
    measures over them. It has as many rows as the table if no two are alike, but no more than these columns."""
    return Scratch(rows.sparkSession).put(rows.groupBy(*dict.fromkeys([*columns, target])).agg(F.count("*").cast("double").alias("_n")), "folded")


def ginis_of(rows: DataFrame, models: Sequence[Logit], target: str, weight: str | None = None) -> list[float]:
    """The Gini of each model, all of them in one pass over the rows."""
    if not models:
        return []
    own = [c for c in (target, weight) if c]
    scores = F.explode(F.array(*[F.struct(F.lit(i).alias("_model"), m.score().alias("_score")) for i, m in enumerate(models)]))
    spread = rows.select(*own, scores.alias("_s")).select(*own, "_s.*")
    found = {r["_model"]: r["gini"] for r in metrics.discrimination(spread, "_score", target, weight, ("_model",)).collect()}  # one row a model
    return [found.get(i) or 0.0 for i in range(len(models))]


def fold(key: str, k: int, seed: int = 0) -> Column:
    """Fold number by a hash of the key."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k))


def cross_validated_gini(rows: DataFrame, columns: Sequence[str], target: str, key: str, k: int = 3) -> float:
    marked = rows.withColumn("_fold", fold(key, k))
    return float(np.mean([gini_of(marked.where(F.col("_fold") == i), fit_logit(marked.where(F.col("_fold") != i), columns, target), target) for i in range(k)]))


def stepwise(train: DataFrame, valid: DataFrame, columns: Sequence[str], target: str, least_gain: float = 0.001, most: int = 20, most_corr: float = 0.9) -> tuple[Logit, list[tuple[str, float]]]:
    """Forward selection by the Gini on ``valid``, each fit kept; columns too near to chosen ones are left out."""
    train, valid = folded(train, columns, target), folded(valid, columns, target)
    corr = correlation_matrix(train, columns, weight="_n")
    chosen: list[str] = []
    history: list[tuple[str, float]] = []
    best, model = 0.0, None

    while len(chosen) < most:
        open_ = [c for c in columns if c not in chosen and all(abs(corr[columns.index(c), columns.index(x)]) <= most_corr for x in chosen)]
        fits = [fit_logit(train, sorted((*chosen, c)), target, "_n") for c in open_]
        found = max(zip(ginis_of(valid, fits, target, "_n"), open_, strict=True), default=(0.0, ""))
        if not found[1] or found[0] < best + least_gain:
            break
        best = found[0]
        chosen.append(found[1])
        history.append((found[1], best))
        model = fits[open_.index(found[1])]
    return model or fit_logit(train, [], target, "_n"), history


def lasso_path(train: DataFrame, valid: DataFrame, columns: Sequence[str], target: str, penalties: Sequence[float]) -> list[tuple[float, int, float]]:
    """(penalty, columns in use, Gini on ``valid``) of L1 fits."""
    fits = [fit_logit(train, columns, target, penalty=p, l1=1.0) for p in penalties]
    return [(p, sum(b != 0 for b in m.coefficients), g) for p, m, g in zip(penalties, fits, ginis_of(valid, fits, target), strict=True)]


def marginal_contributions(train: DataFrame, valid: DataFrame, columns: Sequence[str], target: str) -> list[tuple[str, float]]:
    """What the Gini loses without each column."""
    train, valid = folded(train, columns, target), folded(valid, columns, target)
    fits = [fit_logit(train, own, target, "_n") for own in (columns, *([x for x in columns if x != c] for c in columns))]
    whole, *rest = ginis_of(valid, fits, target, "_n")
    return [(c, whole - g) for c, g in zip(columns, rest, strict=True)]


def marginal_additions(train: DataFrame, valid: DataFrame, columns: Sequence[str], extra: Sequence[str], target: str) -> list[tuple[str, float]]:
    """What the Gini gains with each further column."""
    train, valid = (folded(x, [*columns, *extra], target) for x in (train, valid))
    base, *more = ginis_of(valid, [fit_logit(train, own, target, "_n") for own in (columns, *([*columns, c] for c in extra))], target, "_n")
    return [(c, g - base) for c, g in zip(extra, more, strict=True)]


def lift_of(rows: DataFrame, model: Logit, target: str, percent: float = 10) -> float:
    return metrics.lift(rows.withColumn("_score", model.score()), "_score", target, percent, "high").first()["lift"] or 0.0


def marginal_lifts(train: DataFrame, valid: DataFrame, columns: Sequence[str], target: str, percent: float = 10) -> list[tuple[str, float]]:
    """What the lift loses without each column."""
    base = lift_of(valid, fit_logit(train, columns, target), target, percent)
    return [(c, base - lift_of(valid, fit_logit(train, [x for x in columns if x != c], target), target, percent)) for c in columns]


def best_model(valid: DataFrame, models: Sequence[Logit], target: str, most: int | None = None) -> tuple[int, float]:
    """The model of the highest Gini among those of at most ``most`` columns, ties to the first: its place and Gini."""
    found = [(gini_of(valid, m, target), -i) for i, m in enumerate(models) if most is None or len(m.columns) <= most]
    gini, place = max(found)
    return -place, gini


def log_likelihood(rows: DataFrame, model: Logit, target: str) -> float:
    p, y = model.score(), F.col(target)
    return float(rows.agg(F.sum(y * F.log(p) + (1 - y) * F.log(1 - p))).first()[0] or 0.0)


def likelihood_ratio_test(rows: DataFrame, small: Sequence[str], large: Sequence[str], target: str) -> tuple[float, float]:
    """Statistic and p-value of the further columns of the larger model; ``small`` is part of ``large``."""
    a, b = (log_likelihood(rows, fit_logit(rows, c, target), target) for c in (small, large))
    x = max(0.0, 2 * (b - a))
    return x, chi_square_tail(x, len(large) - len(small))


def gini_gain(train: DataFrame, valid: DataFrame, small: Sequence[str], large: Sequence[str], target: str) -> float:
    return gini_of(valid, fit_logit(train, large, target), target) - gini_of(valid, fit_logit(train, small, target), target)


def correlation_matrix(rows: DataFrame, columns: Sequence[str], method: str = "pearson", weight: str | None = None) -> np.ndarray:
    """p x p, whatever the number of rows. With a weight, Pearson's of rows that stand for several."""
    if weight:
        return _weighted_correlation(rows, columns, weight)
    data = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(rows)
    return Correlation.corr(data, "_x", method).first()[0].toArray()


def _weighted_correlation(rows: DataFrame, columns: Sequence[str], weight: str) -> np.ndarray:
    """Sums of products about the means, a batch at a time; rows with an unknown column take no part, as in an assembler that skips."""
    own = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    known = rows.select(F.col(weight).cast("double").alias("w"), *own).dropna()
    names = [f"x{i}" for i in range(len(columns))]
    total, *sums = known.agg(F.sum("w"), *[F.sum(F.col("w") * F.col(n)) for n in names]).first()
    if not total:
        return np.full((len(columns), len(columns)), np.nan)
    means = np.array(sums) / total

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((len(names), len(names)))
        for batch in batches:
            x = batch[names].to_numpy() - means
            out += (x * batch[["w"]].to_numpy()).T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(len(names)), len(names)), "j": np.tile(np.arange(len(names)), len(names)), "s": out.ravel()})

    found = np.zeros((len(names), len(names)))
    for r in known.mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # p x p
        found[r["i"], r["j"]] = r["s"]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = found / np.sqrt(np.outer(np.diag(found), np.diag(found)))
    np.fill_diagonal(out, 1.0)
    return out


def cluster_variables(rows: DataFrame, columns: Sequence[str], least: float = 0.5) -> dict[str, int]:
    """Average linkage on |correlation|: clusters are joined while their mean correlation is at least ``least``."""
    corr = np.abs(correlation_matrix(rows, columns))
    groups = [[i] for i in range(len(columns))]
    while len(groups) > 1:
        score, a, b = max((float(corr[np.ix_(x, y)].mean()), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if score < least:
            break
        groups[a] += groups.pop(b)
    return {columns[i]: k for k, g in enumerate(sorted(groups)) for i in g}


def cluster_means(rows: DataFrame, clusters: dict[str, int]) -> DataFrame:
    """Adds cluster_<k>, the mean of the filled columns of each cluster: one projection."""
    made = {}
    for k in sorted(set(clusters.values())):
        own = F.filter(F.array(*[F.col(c).cast("double") for c, n in clusters.items() if n == k]), lambda x: x.isNotNull())
        made[f"cluster_{k}"] = F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own))
    return rows.withColumns(made)


def surrogates(train: DataFrame, valid: DataFrame, columns: Sequence[str], clusters: dict[str, int], target: str) -> list[tuple[str, str, float]]:
    """(column, the one of its cluster in its place, Gini): for each column of a model every other of its cluster."""
    out = []
    for c in columns:
        for other in sorted(x for x, k in clusters.items() if k == clusters[c] and x not in columns):
            out.append((c, other, gini_of(valid, fit_logit(train, [other if x == c else x for x in columns], target), target)))
    return out


def k_means_variables(rows: DataFrame, columns: Sequence[str], k: int, rounds: int = 50) -> dict[str, int]:
    """k-means of the columns as points, by their rows of the p x p correlation matrix; far columns start the clusters."""
    points = correlation_matrix(rows, columns)
    centres = [points[0]]
    while len(centres) < k:
        centres.append(points[int(np.argmax(np.min([((points - c) ** 2).sum(1) for c in centres], 0)))])
    own = None
    for _ in range(rounds):
        near = np.argmin([((points - c) ** 2).sum(1) for c in centres], 0)
        if own is not None and (near == own).all():
            break
        own = near
        centres = [points[own == i].mean(0) if (own == i).any() else centres[i] for i in range(k)]
    return {c: int(i) for c, i in zip(columns, own, strict=True)}


def in_parts(rows: DataFrame) -> DataFrame:
    """Rows of a boosted fit, dealt evenly to parts of about PART rows: a task reads one of them, however large the table and
    its files are. Small tables stay as they come."""
    n = rows.count()
    return rows if n <= PART else rows.repartition(max(-(-n // PART), rows.sparkSession.sparkContext.defaultParallelism))


def fit_boosted(rows: DataFrame, columns: Sequence[str], target: str, trees: int = 20, depth: int = 3):
    own = in_parts(rows.select(*dict.fromkeys([*columns, target])))
    data = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="keep").transform(own)
    return GBTClassifier(featuresCol="_x", labelCol=target, maxIter=trees, maxDepth=depth, seed=1).fit(data)


def tree_sql(model, columns: Sequence[str]) -> str:
    """A boosted model as one SQL expression of nested CASE, the sum over its trees; numbers in scientific form are doubles."""
    number = "{:.17e}".format

    def walk(node) -> str:
        if node.numDescendants() == 0:
            return number(float(node.prediction()))
        split = node.split()
        return f"CASE WHEN {columns[split.featureIndex()]} <= {number(float(split.threshold()))} THEN {walk(node.leftChild())} ELSE {walk(node.rightChild())} END"

    return " + ".join(f"{number(float(w))} * ({walk(t._call_java('rootNode'))})" for t, w in zip(model.trees, model.treeWeights, strict=True))


@dataclass
class ScoreCard:
    """A logit over weights of evidence."""

    bins: list[Bins]
    model: Logit

    def table(self) -> list[tuple[str, str, float, float]]:
        """(predictor, bin, weight of evidence, its part of the score)."""
        out = []
        for b, beta in zip(self.bins, self.model.coefficients, strict=True):
            out += [(b.column, n, w, w * beta) for n, w in zip(b.names(), b.woes, strict=True)] + [(b.column, "NaN", b.nan_woe, b.nan_woe * beta)]
        return out

    def score(self) -> Column:
        linear = F.lit(self.model.intercept)
        for b, beta in zip(self.bins, self.model.coefficients, strict=True):
            linear = linear + F.lit(beta) * b.woe()
        return expit(linear)

    def sql(self, table: str, groups: bool = False) -> str:
        """The score as one statement over a table; with ``groups`` the name of each predictor's bin as well."""
        inner = ", ".join([*(b.sql() for b in self.bins), *(b.group_sql() for b in self.bins if groups)])
        linear = " + ".join([f"{self.model.intercept:.17e}", *(f"{beta:.17e} * {b.column}_WOE" for b, beta in zip(self.bins, self.model.coefficients, strict=True))])
        return f"SELECT *, 1 / (1 + exp(-({linear}))) AS score FROM (SELECT *, {inner} FROM {table})"


def fit_scorecard(rows: DataFrame, bins: list[Bins], target: str) -> ScoreCard:
    named = rows.select(target, *[b.woe().alias(f"{b.column}_WOE") for b in bins])
    return ScoreCard(bins, fit_logit(named, [f"{b.column}_WOE" for b in bins], target))


def partial_dependence(rows: DataFrame, model: Logit, column: str, points: Sequence[float]) -> DataFrame:
    """Mean score with the column set to each point: one scan, one expression per point."""
    made = []
    for p in points:
        linear = F.lit(model.intercept)
        for c, b in zip(model.columns, model.coefficients, strict=True):
            linear = linear + F.lit(b) * (F.lit(float(p)) if c == column else F.col(c))
        made.append(F.struct(F.lit(float(p)).alias("point"), F.avg(expit(linear)).alias("mean_score")))
    return rows.agg(F.array(*made).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def bootstrap_logit(rows: DataFrame, columns: Sequence[str], target: str, key: str, replicates: int = 5, seed: int = 1) -> Logit:
    """Mean coefficients of fits on Poisson-weighted rows; weights come from a hash of the key."""
    fits = []
    for i in range(replicates):
        u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(i)), F.lit(10**9)) + 0.5) / 1e9
        w = F.lit(0.0)
        for cut in (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941):
            w = w + (u > cut).cast("double")
        fits.append(fit_logit(rows.withColumn("_w", w).where("_w > 0"), columns, target, "_w"))
    mean = lambda xs: float(np.mean(xs))
    return Logit(list(columns), [mean([f.coefficients[k] for f in fits]) for k in range(len(columns))], mean([f.intercept for f in fits]))
