"""Run-length features: for how long a condition held, and how long ago."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.expressions import ratio


def run_features(rows: DataFrame, key: str, time: str, condition: Column, z: int = 1, mid: int = 3, ties: Sequence[str] = ()) -> DataFrame:
    """One row per entity: counts, longest, mean and last runs of the condition and of its opposite.

    ``z``: runs are counted from more than z rows on; ``mid``: the newest rows that the ratio compares with the older ones.
    Nulls of the condition count as not fulfilled. One sort by (key, time) serves all windows.
    """
    w = Window.partitionBy(key).orderBy(time, *ties)
    flag = F.coalesce(condition, F.lit(False))
    marked = rows.select(key, time, *ties, flag.alias("_is")).withColumn("_flip", F.coalesce((F.col("_is") != F.lag("_is").over(w)).cast("int"), F.lit(0)))
    marked = marked.withColumn("_run", F.sum("_flip").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    runs = marked.groupBy(key, "_run", "_is").agg(F.count("*").alias("_len"), F.max("_n").alias("_end"))
    every = Window.partitionBy(key)
    runs = runs.withColumn("_last", F.max("_run").over(every)).withColumn("_all", F.sum("_len").over(every))
    out = [F.max("_all").alias("n_rows")]
    for word, held in (("is", F.col("_is")), ("not", ~F.col("_is"))):
        long = held & (F.col("_len") > z)
        recent = F.greatest(F.lit(0), F.least(F.col("_len"), F.col("_end") - (F.col("_all") - mid)))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        out += [
            zero(F.sum(F.when(held, F.col("_len")))).alias(f"sum{word}"),
            zero(F.max(F.when(held, F.col("_len")))).alias(f"max{word}"),
            F.coalesce(F.avg(F.when(held, F.col("_len"))), F.lit(0.0)).alias(f"mean{word}"),
            zero(F.max(F.when(held & (F.col("_run") == F.col("_last")), F.col("_len")))).alias(f"maxcon{word}fix"),
            F.sum(long.cast("long")).alias(f"con{word}{z}"),
            zero(F.min(F.when(long, F.col("_all") - F.col("_end")))).alias(f"distcon{word}{z}"),
            ratio(F.sum(F.when(held, recent).otherwise(0)), F.sum(F.when(held, F.col("_len") - recent).otherwise(0))).alias(f"r{mid}_{word}"),
        ]
    out.append(ratio(F.sum(F.when(F.col("_is"), F.col("_len")).otherwise(0)), F.max("_all")).alias("r_sumis"))
    return runs.groupBy(key).agg(*out)
