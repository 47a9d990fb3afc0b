"""Imputation of scores and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.expressions import bin_index, ratio
from riskloom.operators.metrics import quantile_edges


def discrete(rows: DataFrame, score: str, target: str, bins: int = 10) -> float | None:
    """Mean score of the bin whose target rate is nearest to that of rows without a score."""
    i = bin_index(F.col(score), quantile_edges(rows, score, bins))
    t = rows.where(F.col(target).isNotNull()).groupBy(i.alias("bin")).agg(F.avg(F.col(target).cast("double")).alias("rate"), F.avg(F.col(score).cast("double")).alias("mean")).collect()  # one row a bin
    missing = next((r["rate"] for r in t if r["bin"] is None), None)
    known = [r for r in t if r["bin"] is not None]
    return min(known, key=lambda r: (abs(r["rate"] - missing), r["bin"]))["mean"] if missing is not None and known else None


def impute_score(rows: DataFrame, score: str, target: str, bins: int = 10) -> DataFrame:
    value = discrete(rows, score, target, bins)
    return rows.withColumn(score, F.coalesce(F.col(score), F.lit(value)))


def proportional(rows: DataFrame, score: str, target: str) -> DataFrame:
    """One row: the score of rows without one, as mean score x (rate without / rate with)."""
    has = F.col(score).isNotNull()
    y = F.col(target).cast("double")
    return rows.agg((F.avg(score) * ratio(F.avg(F.when(~has, y)), F.avg(F.when(has, y)))).alias("imputed"))


def regression(rows: DataFrame, score: str, target: str, bins: int = 10) -> DataFrame:
    """One row: slope and intercept of a count-weighted line of bin rates on bin means."""
    i = bin_index(F.col(score), quantile_edges(rows, score, bins))
    t = rows.where(F.col(score).isNotNull()).groupBy(i.alias("bin")).agg(F.count("*").cast("double").alias("n"), F.avg(F.col(score).cast("double")).alias("x"), F.avg(F.col(target).cast("double")).alias("y"))
    n, sx, sy, sxx, sxy = F.sum("n"), F.sum(F.col("n") * F.col("x")), F.sum(F.col("n") * F.col("y")), F.sum(F.col("n") * F.col("x") * F.col("x")), F.sum(F.col("n") * F.col("x") * F.col("y"))
    slope = ratio(n * sxy - sx * sy, n * sxx - sx * sx)
    return t.agg(slope.alias("slope"), ((sy - slope * sx) / n).alias("intercept"))


def isotonic(values: list[tuple[float, float]]) -> list[float]:
    """Pool adjacent violators over (value, weight): the nearest rising sequence."""
    blocks: list[list[float]] = []
    for v, w in values:
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [b[0] for b in blocks for _ in range(int(b[2]))]


def impute_target(rows: DataFrame, target: str, probability: str, mode: str = "weighted", cutoff: float = 0.5, key: str | None = None, seed: int = 0) -> DataFrame:
    """Rows without a target: both outcomes with weights p and 1 - p, a draw by a hash of the key, or a threshold."""
    p, unknown = F.col(probability), F.col(target).isNull()
    if mode == "weighted":
        both = F.array(F.struct(F.lit(1).alias("y"), p.alias("w")), F.struct(F.lit(0).alias("y"), (1 - p).alias("w")))
        one = F.array(F.struct(F.col(target).cast("int").alias("y"), F.lit(1.0).alias("w")))
        return rows.withColumn("_x", F.explode(F.when(unknown, both).otherwise(one))).withColumn(target, F.col("_x.y")).withColumn("weight", F.col("_x.w")).drop("_x")
    if mode == "randomized":
        u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10**9)) + 0.5) / 1e9
        drawn = (u < p).cast("int")
    else:
        drawn = (p >= cutoff).cast("int")
    return rows.withColumn(target, F.when(unknown, drawn).otherwise(F.col(target))).withColumn("weight", F.lit(1.0))


def quantile_imputer(rows: DataFrame, score: str, target: str, bins: int = 20) -> float | None:
    """Mean score of the quantile bin whose rate, made to rise (or fall, as the score's correlation with the target does)
    with the score, is nearest to that of rows without a score."""
    i = bin_index(F.col(score), quantile_edges(rows, score, bins))
    t = rows.where(F.col(target).isNotNull()).groupBy(i.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("rate"), F.avg(F.col(score).cast("double")).alias("mean")).collect()  # one row a bin
    missing = next((r["rate"] for r in t if r["bin"] is None), None)
    falls = (rows.agg(F.corr(F.col(score).cast("double"), F.col(target).cast("double"))).first()[0] or 0.0) < 0
    known = sorted((r for r in t if r["bin"] is not None), key=lambda r: r["bin"], reverse=falls)
    if missing is None or not known:
        return None
    rising = isotonic([(r["rate"], r["n"]) for r in known])
    return known[min(range(len(known)), key=lambda k: (abs(rising[k] - missing), k))]["mean"]


def by_correlation(rows: DataFrame, column: str, target: str) -> DataFrame:
    """One row: the mean of a column times the ratio of rates, inverted where the column falls with the target."""
    has, y = F.col(column).isNotNull(), F.col(target).cast("double")
    r = ratio(F.avg(F.when(~has, y)), F.avg(y))
    return rows.agg((F.avg(column) * F.when(F.corr(column, target) >= 0, r).otherwise(ratio(F.lit(1.0), r))).alias("imputed"))
