"""Boosted trees beyond the fit: attributions of a score to its columns, selection by them, and choice of the target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators import binning, metrics
from riskloom.operators.models import fold, in_parts

#: Stands for a missing number in a fit.
MOST = 1.7976931348623157e308


@dataclass
class Leaf:
    """A leaf of one tree, times the tree's weight: per column of its path the interval that leads here and the share of the
    training rows that go along where the column is unknown."""

    value: float
    cover: float
    columns: list[int]
    low: list[float]
    high: list[float]
    shares: list[float]

    def weights(self) -> np.ndarray:
        """What the leaf adds to each of its columns, by the pattern of columns whose value leads here (bit i: column i)."""
        m = len(self.columns)
        table = np.zeros((2**m, m))
        for j in range(m):
            others = [i for i in range(m) if i != j]
            for size in range(m):
                w = factorial(size) * factorial(m - size - 1) / factorial(m)
                for chosen in combinations(others, size):
                    free = np.prod([self.shares[i] for i in others if i not in chosen])
                    need = sum(1 << i for i in chosen)
                    met = (np.arange(2**m) & need) == need
                    own = (np.arange(2**m) >> j) & 1
                    table[:, j] += met * w * free * (own - self.shares[j]) * self.value
        return table


def leaves(model) -> list[Leaf]:
    """All leaves of a boosted model of ``pyspark.ml``; the intervals are (low, high], null and NaN lie above all."""
    out = []

    def walk(node, weight: float, path: dict[int, tuple[float, float, float]]) -> None:
        if node.numDescendants() == 0:
            columns = sorted(path)
            out.append(Leaf(weight * float(node.prediction()), cover(node), columns, *([path[c][i] for c in columns] for i in range(3))))
            return
        c, at = int(node.split().featureIndex()), float(node.split().threshold())
        low, high, share = path.get(c, (-np.inf, np.inf, 1.0))
        for child, a, b in ((node.leftChild(), low, min(high, at)), (node.rightChild(), max(low, at), high)):
            walk(child, weight, {**path, c: (a, b, share * cover(child) / cover(node))})

    def cover(node) -> float:
        return float(node.impurityStats().count())

    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        walk(tree._call_java("rootNode"), float(weight), {})
    return out


def attributions(model, columns: Sequence[str]) -> Column:
    """An array: what each column adds to the row's raw score, and at the end what the score is without any of them.

    Path-dependent Shapley values: an unknown column goes both ways by the shares of the training rows. They add up to the
    raw score. A null or NaN goes right at every split, as in the model. Trees are read once on the driver and sent as small
    tables; rows come in Arrow batches.
    """
    known, total = [], 0.0
    for leaf in leaves(model):
        total += leaf.value * float(np.prod(leaf.shares))
        known.append((np.array(leaf.columns, int), np.array(leaf.low), np.array(leaf.high), leaf.weights()))
    count = len(columns)

    @F.pandas_udf("array<double>")
    def attributed(rows: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(r, np.float64) for r in rows]) if len(rows) else np.zeros((0, count))
        x = np.where(np.isnan(x), np.inf, x)
        out = np.zeros((len(x), count + 1))
        out[:, count] = total
        for own, low, high, table in known:
            met = (x[:, own] > low) & (x[:, own] <= high) | ((low == -np.inf) & (x[:, own] == -np.inf)) if len(own) else np.zeros((len(x), 0), bool)
            out[:, own] += table[(met << np.arange(len(own))).sum(1)]
        return pd.Series(list(out))

    return attributed(F.transform(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: F.coalesce(v, F.lit(float("nan")))))


def importances(rows: DataFrame, model, columns: Sequence[str]) -> list[tuple[str, float]]:
    """(column, sum of absolute attributions over all rows), the largest first, ties by name."""
    parts = rows.select(attributions(model, columns).alias("a"))
    sums = parts.agg(*[F.sum(F.abs(F.col("a")[i])).alias(f"s{i}") for i in range(len(columns))]).first()
    return sorted(((c, float(sums[i] or 0.0)) for i, c in enumerate(columns)), key=lambda x: (-x[1], x[0]))


def fit(rows: DataFrame, columns: Sequence[str], target: str, trees: int = 20, depth: int = 3, seed: int = 1, weight: str | None = None, valid: str | None = None, subsample: float = 1.0):
    """A boosted classifier; with ``valid``, a boolean column, growing stops when the loss there no longer falls.

    The fit takes no null, NaN or infinity: they count as the greatest number, so they go right of every split, and minus
    infinity as the least.
    """
    c = {f"_in{i}": F.col(c).cast("double") for i, c in enumerate(columns)}
    filled = {n: F.when(x.isNull() | F.isnan(x), F.lit(MOST)).otherwise(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), x))) for n, x in c.items()}
    own = [F.col(n).alias(m) for n, m in ((target, "_label"), (weight, "_weight"), (valid, "_valid")) if n]
    data = VectorAssembler(inputCols=list(filled), outputCol="_x").transform(in_parts(rows.select(*own, *[x.alias(n) for n, x in filled.items()])))
    tool = GBTClassifier(featuresCol="_x", labelCol="_label", maxIter=trees, maxDepth=depth, seed=seed, subsamplingRate=subsample)
    tool = tool.setWeightCol("_weight") if weight else tool
    return (tool.setValidationIndicatorCol("_valid") if valid else tool).fit(data)


def tree_scores(model, columns: Sequence[str], trees: int | None = None) -> list[Column]:
    """Each tree's part of the raw score, as one expression; a null input goes right."""

    def walk(node) -> Column:
        if node.numDescendants() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        left = F.col(columns[split.featureIndex()]).cast("double") <= float(split.threshold())
        return F.when(left, walk(node.leftChild())).otherwise(walk(node.rightChild()))

    return [F.lit(float(w)) * walk(t._call_java("rootNode")) for t, w in list(zip(model.trees, model.treeWeights, strict=True))[:trees]]


def raw_score(model, columns: Sequence[str], trees: int | None = None) -> Column:
    total = F.lit(0.0)
    for part in tree_scores(model, columns, trees):
        total = total + part
    return total


def _auc(scored: DataFrame, target: str, weight: str | None, by: Sequence[str]) -> dict[tuple, float]:
    """AUC by groups of a table (by, score, target): one pass for all of them."""
    levels = metrics.score_table(scored, "_score", target, weight, by)
    return {tuple(r[b] for b in by): (r["gini"] + 1) / 2 for r in metrics.curve(levels, by).collect() if r["gini"] is not None}


@dataclass
class Step:
    columns: list[str]
    trees: int
    cv_auc: float
    aucs: dict[str, float]


class Selection:
    """Adds columns in the order of their importance, ``step`` at a time, and measures each set; sets are fitted once.

    ``sets`` are named conditions in SQL over the rows, such as test and out of time; rows of none of them train. Folds come
    from a hash of ``key``. The number of trees of a set is the one of the best mean AUC over the held out folds, looked at
    every ``every`` trees; ``seeds`` fits of that size on all training rows are averaged for the other sets.
    """

    def __init__(self, rows: DataFrame, target: str, key: str, sets: Mapping[str, str] | None = None, weight: str | None = None, folds: int = 4, seeds: int = 1, trees: int = 20, depth: int = 3, every: int = 5):
        self.target, self.weight, self.folds, self.seeds, self.trees, self.depth, self.every = target, weight, folds, seeds, trees, depth, every
        self.sets, self.known = dict(sets or {}), {}
        name = F.lit("train")
        for n, condition in self.sets.items():
            name = F.when(F.coalesce(F.expr(condition), F.lit(False)), F.lit(n)).otherwise(name)
        self.rows = rows.where(F.col(target).isNotNull()).withColumns({"_set": name, "_fold": fold(key, folds)})

    def measure(self, columns: Sequence[str]) -> Step:
        columns = sorted(columns)
        if (found := self.known.get(tuple(columns))) is None:
            found = self.known[tuple(columns)] = self._measure(columns)
        return found

    def _measure(self, columns: list[str]) -> Step:
        train = self.rows.where("_set = 'train'")
        sizes = sorted({*range(self.every, self.trees, self.every), self.trees})
        held = F.lit(None).cast("array<struct<size:int,_score:double>>")
        for i in range(self.folds):
            model = fit(train.where(F.col("_fold") != i), columns, self.target, self.trees, self.depth, 1, self.weight)
            parts, total, at = tree_scores(model, columns), F.lit(0.0), []
            for n, part in enumerate(parts, 1):
                total = total + part
                if n in sizes or n == len(parts):
                    at.append(F.struct(F.lit(n).alias("size"), total.alias("_score")))
            held = F.when(F.col("_fold") == i, F.array(*at)).otherwise(held)
        own = [self.target, *([self.weight] if self.weight else [])]
        scored = train.select("_fold", *own, F.explode(held).alias("_s")).select("_fold", *own, "_s.*")
        found: dict[int, list[float]] = {}
        for (_, n), auc in _auc(scored, self.target, self.weight, ("_fold", "size")).items():
            found.setdefault(n, []).append(auc)
        trees, cv = max(((n, float(np.mean(a))) for n, a in found.items()), key=lambda x: (x[1], -x[0]))
        aucs = {}
        if self.sets:
            mean = F.lit(0.0)
            for seed in range(1, self.seeds + 1):
                mean = mean + raw_score(fit(train, columns, self.target, trees, self.depth, seed, self.weight, subsample=1.0 if self.seeds == 1 else 0.8), columns) / self.seeds
            rest = self.rows.where("_set <> 'train'").select("_set", *own, mean.alias("_score"))
            aucs = {k[0]: v for k, v in _auc(rest, self.target, self.weight, ("_set",)).items()}
        return Step(columns, trees, cv, aucs)

    def run(self, ranked: Sequence[tuple[str, float]], base: Sequence[str] = (), step: int = 1, least_gain: float | None = None, patience: int = 1) -> list[Step]:
        """A step for each set, the last ones too. With ``least_gain`` it stops after ``patience`` sets in a row that gain
        less than it over the best cross-validated AUC before them."""
        order = [c for c, _ in sorted(ranked, key=lambda x: (-x[1], x[0])) if c not in base]
        out, best, idle = [], -1.0, 0
        for at in range(0, len(order), step):
            out.append(self.measure([*base, *order[: at + step]]))
            idle = 0 if out[-1].cv_auc >= best + (least_gain or 0.0) else idle + 1
            best = max(best, out[-1].cv_auc)
            if least_gain is not None and idle >= patience:
                break
        return out


def target_matrix(train: DataFrame, valid: DataFrame, test: DataFrame, targets: Sequence[tuple[str, str]], numbers: Sequence[str], categories: Sequence[str] = (), trees: int = 50, depth: int = 3, groups: int = 5, least: int = 200) -> DataFrame:
    """trained, measured, gini: the model of each target measured on every target, over the test rows of that one's base.

    ``targets`` are (target, base) columns; a model sees the rows of its own base. Categories are grouped and encoded by the
    weight of evidence of the model's target; ``valid`` ends its growth. All models are one projection of the test rows, and
    all Ginis come from one pass over (model, target).
    """
    scores = []
    for target, base in targets:
        own = train.where(F.col(base) == 1)
        bins = [binning.fit_categorical(own, c, target, groups, least) for c in categories]
        names = [f"_in{i}" for i in range(len(numbers) + len(bins))]
        inputs = [F.col(c).cast("double") for c in numbers] + [b.woe().cast("double") for b in bins]
        both = own.withColumn("_valid", F.lit(False)).unionByName(valid.where(F.col(base) == 1).withColumn("_valid", F.lit(True)))
        ready = both.select(F.col(target).cast("double").alias("_y"), "_valid", *[x.alias(n) for x, n in zip(inputs, names, strict=True)]).where("_y IS NOT NULL")
        scores.append((target, raw_score(fit(ready, names, "_y", trees, depth, valid="_valid"), names), inputs, names))
    scored = test
    made = []
    for k, (target, score, inputs, names) in enumerate(scores):
        # Inputs of one model at a time; only its score stays.
        scored = scored.withColumns(dict(zip(names, inputs, strict=True))).withColumn(f"_score{k}", score).drop(*names)
        made.append(F.struct(F.lit(target).alias("trained"), F.col(f"_score{k}").alias("_score")))
    measured = [F.struct(F.lit(t).alias("measured"), F.when(F.col(b) == 1, F.col(t).cast("double")).alias("_y")) for t, b in targets]
    pairs = scored.select(F.array(*made).alias("_s"), F.explode(F.array(*measured)).alias("_m")).where("_m._y IS NOT NULL")
    pairs = pairs.select(F.explode("_s").alias("_s"), F.col("_m.measured").alias("measured"), F.col("_m._y").alias("_y")).select("_s.*", "measured", "_y")
    by = ("trained", "measured")
    return metrics.curve(metrics.score_table(pairs, "_score", "_y", None, by), by).select(*by, "gini")
