"""Splits and samples that depend on a key and a seed only, so reruns and other partitionings agree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.shared import Scratch

#: Parts that draws are divided among at once, and rows of a last part.
FAN, PART = 1_024, 65_536


def order_of(key: str, seed: int = 0) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def split(rows: DataFrame, key: str, sizes: Sequence[float], names: Sequence[str], strata: Sequence[str], seed: int = 0) -> DataFrame:
    """Adds data_type: exact shares of each stratum, in the order of a hash of the key.

    A stratum may hold most rows: places come from counts of hash ranges and ranks inside a range.
    """
    rows = rows.withColumn("_o", order_of(key, seed)).withColumn("_r", F.substring("_o", 1, 2))
    before = Window.partitionBy(*strata).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*strata, "_r").count()
    parts = parts.withColumn("_b", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumn("_n", F.sum("count").over(Window.partitionBy(*strata))).drop("count")
    place = F.row_number().over(Window.partitionBy(*strata, "_r").orderBy("_o")) + F.col("_b")
    out, edge = F, 0.0
    placed = rows.join(parts, [*strata, "_r"]).withColumn("_p", place)
    for size, name in zip(sizes, names, strict=True):
        edge += size
        out = out.when(F.col("_p") <= F.bround(F.lit(edge) * F.col("_n") + 1e-9), F.lit(name))
    return placed.withColumn("data_type", out.otherwise(F.lit(names[-1]))).drop("_o", "_r", "_b", "_n", "_p")


def time_split(rows: DataFrame, time: str, points: Sequence, names: Sequence[str]) -> DataFrame:
    """Adds period: before the first point, between points, from the last one."""
    out = F
    for p, name in zip(points, names, strict=False):
        out = out.when(F.col(time) < F.lit(p), F.lit(name))
    return rows.withColumn("period", out.otherwise(F.lit(names[-1])))


def fixed_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by the least hash of the key; n is the size of a sample that is asked for."""
    return rows.orderBy(order_of(key, seed), key).limit(n)


def balance(rows: DataFrame, column: str) -> DataFrame:
    """Adds weight: the largest class over the row's class."""
    w = rows.groupBy(column).count().withColumn("weight", F.max("count").over(Window.partitionBy(F.lit(0))) / F.col("count")).drop("count")
    return rows.join(w, column)


def resample(rows: DataFrame, seed: int = 0, size: int | None = None) -> DataFrame:
    """The different rows with draws: how often each comes in a bootstrap sample of exactly ``size`` rows (as many as there
    are, if not given).

    Equal rows fold first, so one that is repeated without end is one row with a weight. Draws are divided down ranges of a
    hash of the row, by multinomial draws among at most FAN parts at a time, then among the rows of a range: together the
    multinomial of all rows, though nothing lists them. It depends on the rows and the seed only. An empty table stays empty.
    """
    spark = rows.sparkSession
    folded = rows.groupBy(*rows.columns).agg(F.count("*").alias("_m"))
    # Written, as sizes, ranges, draws and the result all read it: to fold is the dearest step.
    hashed = Scratch(spark).put(folded.withColumns({"_h": F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(2**40)), "_g": F.xxhash64(*rows.columns, F.lit(seed + 1))}), "folded")
    n = hashed.agg(F.sum("_m")).first()[0] or 0
    size = n if size is None else size
    if not n:
        return folded.withColumn("draws", F.lit(0).cast("long")).drop("_m")
    fine = min(FAN, max(1, -(-n // PART)))  # ranges of a coarse one
    coarse = min(FAN, max(1, -(-n // (PART * fine))))
    spread = F.col("_h").cast("decimal(38,0)") * coarse
    at = hashed.withColumns({"_c": F.floor(spread / 2**40).cast("long"), "_f": F.floor(F.pmod(spread, F.lit(2**40)) * fine / 2**40).cast("long")})

    def generator(*place: int) -> np.random.Generator:
        return np.random.default_rng([seed, *place])

    counts = sorted((r["_c"], r["n"]) for r in at.groupBy("_c").agg(F.sum("_m").alias("n")).collect())  # at most FAN rows
    given = generator(0).multinomial(size, [c / n for _, c in counts])
    first = spark.createDataFrame([(c, int(d)) for (c, _), d in zip(counts, given, strict=True)], "_c long, _given long")

    def divided(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_f")
        drawn = generator(1, int(own["_c"].iloc[0])).multinomial(int(own["_given"].iloc[0]), own["n"] / own["n"].sum())
        return pd.DataFrame({"_c": own["_c"], "_f": own["_f"], "_given": drawn})

    parts = at.groupBy("_c", "_f").agg(F.sum("_m").alias("n")).join(F.broadcast(first), "_c").groupBy("_c").applyInPandas(divided, "_c long, _f long, _given long")

    def drawn(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["_h", "_i"])
        own["draws"] = generator(2, int(own["_c"].iloc[0]), int(own["_f"].iloc[0])).multinomial(int(own["_given"].iloc[0]), own["_m"] / own["_m"].sum())
        return own[["_h", "_i", "draws"]]

    # Only hashes, weights and places go to Python; different rows of one hash are told apart by their number.
    inside = Window.partitionBy("_c", "_f", "_h").orderBy("_g")
    numbered = at.withColumn("_i", F.row_number().over(inside))
    found = numbered.select("_c", "_f", "_h", "_i", "_m").join(parts, ["_c", "_f"]).groupBy("_c", "_f").applyInPandas(drawn, "_h long, _i int, draws long")
    return numbered.join(found, ["_h", "_i"]).drop("_h", "_g", "_i", "_m", "_c", "_f")
