"""Models over scores of other models: imputed by hit conditions, cross-validated, searched, calibrated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.expressions import expit, logit, ratio
from riskloom.operators import imputation, metrics
from riskloom.operators.comparison import levels_of, measures
from riskloom.operators.models import Logit, fit_logit, fold, folded
from riskloom.sources.shared import Scratch


@dataclass(frozen=True)
class Imputation:
    """Rows of ``nohit`` get a value of ``column`` that is learnt from the rows of ``hit``, or the given one.

    Conditions are SQL over the columns as they come.
    """

    column: str
    hit: str
    nohit: str
    value: float | None = None


@dataclass
class ScoreModel:
    """A logit over prepared columns: to score is one projection."""

    inputs: dict[str, Column]
    model: Logit
    slope: float = 1.0
    shift: float = 0.0
    imputations: list[Imputation] = field(default_factory=list)

    def linear(self) -> Column:
        terms = [F.lit(b) * self.inputs[c] for c, b in zip(self.model.columns, self.model.coefficients, strict=True)]
        return reduce(Column.__add__, terms, F.lit(self.model.intercept))

    def score(self) -> Column:
        return expit(F.lit(self.slope) * self.linear() + F.lit(self.shift))

    def good_score(self) -> Column:
        """The probability of class 0."""
        return 1 - self.score()

    def impute(self, rows: DataFrame) -> DataFrame:
        """The columns as the model sees them."""
        return rows.withColumns({c: self.inputs[c] for c in self.model.columns})


def prepared(columns: Sequence[str], imputations: Sequence[Imputation], probabilities: Sequence[str]) -> dict[str, Column]:
    """Per column: the logit of a probability, then the values of its imputations in their order."""
    out = {}
    for c in columns:
        x = logit(F.col(c).cast("double")) if c in probabilities else F.col(c).cast("double")
        for i in imputations:
            if i.column == c:
                x = F.when(F.coalesce(F.expr(i.nohit), F.lit(False)), F.lit(i.value).cast("double")).otherwise(x)
        out[c] = x
    return out


def learn(rows: DataFrame, one: Imputation, target: str, probabilities: Sequence[str] = (), weight: str | None = None, kind: str = "linear") -> Imputation:
    """The imputation with its value.

    linear: logit of mean probability x (rate without hit / rate with hit). quantile: mean score of the bin whose smoothed
    rate is nearest to that of the rows without hit.
    """
    if one.value is not None:
        return one
    x = prepared([one.column], (), probabilities)[one.column]
    hit, nohit = (F.coalesce(F.expr(c), F.lit(False)) for c in (one.hit, one.nohit))
    if kind == "quantile":
        marked = rows.where(hit | nohit).select(F.when(~nohit, x).alias("_x"), F.col(target).alias("_y"))
        return replace(one, value=imputation.quantile_imputer(marked, "_x", "_y", 25))
    w, y = F.col(weight).cast("double") if weight else F.lit(1.0), F.col(target).cast("double")
    mean = lambda c, inside: ratio(F.sum(F.when(inside, c * w)), F.sum(F.when(inside & c.isNotNull(), w)))
    p = mean(expit(x), hit) * ratio(mean(y, nohit), mean(y, hit))
    return replace(one, value=rows.agg(logit(p).alias("v")).first()["v"])


def fit_general(rows: DataFrame, columns: Sequence[str], target: str, key: str, imputations: Sequence[Imputation] = (), probabilities: Sequence[str] = (), folds: int = 5, weight: str | None = None, kind: str = "linear") -> tuple[ScoreModel, float | None]:
    """Mean model of the folds, each fitted with its own imputations, and the Gini of the scores of held out rows.

    Folds come from a hash of the key. An imputation that no fold can learn stays null, and rows that it would fill are
    then left out, as is every row with a null input.
    """
    marked = rows.withColumn("_fold", fold(key, folds))
    held, fits, learnt = F.lit(None).cast("double"), [], []
    for i in range(folds):
        train = marked.where(F.col("_fold") != i)
        own = [learn(train, one, target, probabilities, weight, kind) for one in imputations]
        inputs = prepared(columns, own, probabilities)
        seen = train.select(F.col(target).alias("_y"), *([F.col(weight).alias("_w")] if weight else []), *[inputs[c].alias(c) for c in columns]).dropna()
        model = fit_logit(seen, columns, "_y", "_w" if weight else None, penalty=1 / (1000 * max(1, seen.count())))
        held = F.when(F.col("_fold") == i, ScoreModel(inputs, model).score()).otherwise(held)
        fits.append(model)
        learnt.append(own)
    mean = lambda xs: float(np.mean(xs))
    known = [[o[k].value for o in learnt if o[k].value is not None] for k in range(len(imputations))]
    final = [replace(one, value=mean(v) if v else None) for one, v in zip(imputations, known, strict=True)]
    model = Logit(list(columns), [mean([f.coefficients[k] for f in fits]) for k in range(len(columns))], mean([f.intercept for f in fits]))
    gini = metrics.discrimination(marked.withColumn("_held", held), "_held", target, weight).first()["gini"]
    return ScoreModel(prepared(columns, final, probabilities), model, imputations=final), gini


def missing_kinds(rows: DataFrame, columns: Sequence[str], target: str, codes: Mapping[str, Sequence[float]]) -> list[Imputation]:
    """One imputation for the nulls of each column and one for each code that stands for nothing: the mean score of the
    bin whose rate is nearest to that of the kind. A kind without rows gets none."""
    kinds_of = {c: {f"`{c}` IS NULL": F.col(c).isNull(), **{f"`{c}` = {float(k)!r}D": F.col(c).cast("double") == float(k) for k in codes.get(c, ())}} for c in columns}
    # One pass tells which kinds have rows; only those are looked at.
    every = [(c, text) for c, kinds in kinds_of.items() for text in kinds]
    seen = rows.where(F.col(target).isNotNull()).agg(*[F.count_if(kinds_of[c][text]).alias(f"n{i}") for i, (c, text) in enumerate(every)]).first() if every else ()
    has = {k for k, n in zip(every, seen, strict=True) if n}
    out = []
    for c, kinds in kinds_of.items():
        value = F.col(c).cast("double")
        known = ~reduce(Column.__or__, [F.coalesce(k, F.lit(False)) for k in kinds.values()])
        for text, kind in kinds.items():
            if (c, text) not in has:
                continue
            own = rows.where(known | kind).select(F.when(known, value).alias("_x"), F.col(target).alias("_y"))
            found = imputation.discrete(own, "_x", "_y")
            if found is not None:
                out.append(Imputation(c, f"NOT ({text})", text, found))
    return out


def fit_scores(rows: DataFrame, columns: Sequence[str], target: str, c: float = 1.0, logits: Sequence[str] = (), codes: Mapping[str, Sequence[float]] | None = None) -> ScoreModel:
    """Imputed, as logits where named, standardised, then a logit of inverse penalty ``c``."""
    return fit_each(rows, columns, target, [c], logits, codes)[0]


def fit_each(rows: DataFrame, columns: Sequence[str], target: str, cs: Sequence[float], logits: Sequence[str] = (), codes: Mapping[str, Sequence[float]] | None = None) -> list[ScoreModel]:
    """``fit_scores`` for each inverse penalty: what does not depend on it is found once, and equal rows are folded."""
    fills = missing_kinds(rows, columns, target, codes or {})
    # Values are found before the logit, so those of probabilities go through it.
    own = [replace(f, value=float(np.log(f.value / (1 - f.value)))) if f.column in logits else f for f in fills]
    inputs = prepared(columns, own, logits)
    seen = folded(rows.select(F.col(target).alias("_y"), *[inputs[x].alias(x) for x in columns]).dropna(), columns, "_y")
    n = seen.agg(F.sum("_n")).first()[0] or 1
    return [ScoreModel(inputs, fit_logit(seen, columns, "_y", "_n", penalty=1 / (c * n)), imputations=own) for c in cs]


def search(rows: DataFrame, columns: Sequence[str], target: str, key: str, cs: Sequence[float] = tuple(10.0**k for k in range(-3, 4)), splits: int = 15, test: float = 0.33, percent: float = 10, logits: Sequence[str] = (), codes: Mapping[str, Sequence[float]] | None = None) -> tuple[list[tuple[float, float]], float, ScoreModel]:
    """(Gini, lift) of each split at the inverse penalty of the highest mean Gini, that penalty, and the model of all rows.

    A split holds out a share of the rows by a hash of the key; its imputations are found once for all penalties.
    """
    found, scratch = {c: [] for c in cs}, Scratch(rows.sparkSession)
    for i in range(splits):
        out = F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(10**6)) < int(test * 10**6)
        models = fit_each(rows.where(~out), columns, target, cs, logits, codes)
        # The scores of all penalties are measured together: one pass over the rows, then one table of score levels.
        scores = F.explode(F.array(*[F.struct(F.lit(k).alias("_model"), m.score().alias("value")) for k, m in enumerate(models)]))
        spread = rows.where(out).select(F.col(target).alias("_y"), scores.alias("_s")).select("_y", "_s.*").where("value IS NOT NULL")
        levels = levels_of(spread, ("_model",), scratch, f"split{i}")
        got = {r["_model"]: (r["gini"] or 0.0, r[f"lift_{percent}"] or 0.0) for r in measures(levels, ("_model",), (percent,)).collect()}  # one row a model
        for k, c in enumerate(cs):
            found[c].append(got.get(k, (0.0, 0.0)))
    best = max(cs, key=lambda c: (float(np.mean([g for g, _ in found[c]])), -c))
    return found[best], best, fit_scores(rows, columns, target, best, logits, codes)


def fit_calibrated(rows: DataFrame, columns: Sequence[str], target: str, base: str, c: float, part: str | None = None, logits: Sequence[str] = (), codes: Mapping[str, Sequence[float]] | None = None) -> ScoreModel:
    """``fit_scores`` over the rows of the base (and of 'train' in ``part``), then a line through its logits that fits the target."""
    own = rows.where(F.col(base) == 1)
    own = own.where(F.col(part) == "train") if part else own
    model = fit_scores(own, columns, target, c, logits, codes)
    line = fit_logit(own.select(F.col(target).alias("_y"), model.linear().alias("_line")).dropna(), ["_line"], "_y")
    return replace(model, slope=line.coefficients[0], shift=line.intercept)


def conditional_expectations(rows: DataFrame, model: Logit, column: str, keys: Sequence[str], sample: int = 1000, points: int = 20) -> DataFrame:
    """keys, point, score: how the score of each of ``sample`` rows (least md5 of the keys) changes along the column.

    Points are the distinct quantiles of the sample at equal steps; the curves' mean is the partial dependence. Rows that
    share their keys go by the columns of the model, and the sample is written once, so points and curves are of the same
    rows in every run.
    """
    order = F.md5(F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))
    own = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in model.columns])
    few = Scratch(rows.sparkSession).put(own.orderBy(order, *keys, *model.columns).limit(sample), "sample")
    at = F.array_distinct(F.percentile(column, F.array(*[F.lit(i / (points - 1)) for i in range(points)])))  # of the sample
    grid = few.agg(at.alias("_points")).where("_points IS NOT NULL").select(F.explode("_points").alias("point"))
    terms = [F.lit(b) * (F.col("point") if c == column else F.col(c)) for c, b in zip(model.columns, model.coefficients, strict=True)]
    curves = few.crossJoin(F.broadcast(grid))  # at most ``points`` rows on the right
    return curves.select(*keys, "point", expit(reduce(Column.__add__, terms, F.lit(model.intercept))).alias("score"))


def cluster_table(rows: DataFrame, clusters: Mapping[str, int], target: str) -> DataFrame:
    """column, cluster, Gini of -x, and the place in the cluster by falling Gini."""
    from pyspark.sql import Window

    power = metrics.predictor_power(rows, list(clusters), target)
    number = F.create_map(*[F.lit(x) for pair in clusters.items() for x in pair])[F.col("predictor")]
    t = power.select(F.col("predictor").alias("column"), number.alias("cluster"), "gini")
    return t.withColumn("order", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("gini").desc(), "column")))
