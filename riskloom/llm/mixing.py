"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Each source has a share of the mix and a schedule that says how its density runs over training time. The schedule is
integrated to a cumulative token demand; inverting it turns a document's place in its source into a training position.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, whole

#: Density at the start and the end of training, by weight rank: the heaviest sources early, the lightest late.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def _pick(index: Column, values: Sequence[float]) -> Column:
    return reduce(lambda c, iv: c.when(index == iv[0], F.lit(float(iv[1]))), enumerate(values), F).otherwise(None)


def source_targets(totals: DataFrame, weights: Sequence[float], volume: float, limit: float, schedules=SCHEDULES) -> DataFrame:
    """(_key, source_size) -> targets. Sources are few; a target over ``limit`` x size is cut and the rest reshared.

    Ordered by size/weight the cut sources are a prefix, so one running sum finds the level that holds for the others.
    """
    everything = Window.orderBy("_key")
    full = Window.orderBy("_fill", "_key")
    index = (F.row_number().over(everything) - 1) % len(weights)
    level = (F.lit(volume) * F.col("_all") - F.coalesce(F.sum("_cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    whole_table = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        totals.withColumn("_index", index)
        .withColumn("_weight", _pick(F.col("_index"), weights))
        .withColumn("_from", _pick(F.col("_index") % len(schedules), [a for a, _ in schedules]))
        .withColumn("_to", _pick(F.col("_index") % len(schedules), [b for _, b in schedules]))
        .withColumn("_cap", limit * F.col("source_size").cast("double"))
        .withColumn("_fill", F.col("_cap") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("_level", level)
        .withColumn("_level", F.first(F.when(F.col("_fill") > F.col("_level"), F.col("_level")), ignorenulls=True).over(whole_table))
        .withColumn("target", F.coalesce(F.least("_cap", F.col("_level") * F.col("_weight")), F.col("_cap")))
        .select("_key", "source_size", "target", "_from", "_to")
    )


def training_position(share: Column, start: Column, end: Column) -> Column:
    """Invert the integral of the density start + (end - start) t, scaled to 1 over [0, 1], at ``share``."""
    x = share * (start + end) / 2
    return F.when(start == end, x / start).otherwise((F.sqrt(start * start + 2 * (end - start) * x) - start) / (end - start))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), volume: float = 1.5, limit: float = 2.0, schedules=SCHEDULES, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, positions.

    Within a source, documents stand in the order of md5(doc_id); the mix runs through that order up to the source's
    target, again from the start after each whole pass, and cuts the last copy where the target ends. ``copies`` has the
    words of each copy, ``positions`` their places in [0, 1] of training time. The running sum goes in two steps, over
    4,096 hash ranges and inside each, so a source with most rows is still many groups.

    Null source: a source of its own, last. Null or empty text: size 0, nothing taken. Repeated rows count each; rows that
    share a doc_id stand by size, then by the text's hash. An empty table gives no rows. Other columns are ignored unless
    named in ``keep``, which takes names that are not columns of the result.
    """
    size = F.regexp_count(whole(), F.lit(WORD)).cast("long")
    key = F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))  # null is a source of its own and stands last
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = docs.select("doc_id", "source", size.alias("size"), key.alias("_key"), order.alias("_order"), F.xxhash64("text").alias("_tie"), *keep).withColumn("_range", F.substring("_order", 1, 3))
    parts = sized.groupBy("_key", "_range").agg(F.sum("size").alias("_size"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    targets = source_targets(parts.groupBy("_key").agg(F.sum("_size").alias("source_size")), weights, volume, limit, schedules)
    out = sized.join(parts.join(targets, "_key"), ["_key", "_range"])
    inside = Window.partitionBy("_key", "_range").orderBy("_order", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    goal, n = F.bround("target").cast("long"), F.col("source_size")
    out = out.withColumn("_at", at).withColumn("_goal", goal)
    copy = lambda r: F.greatest(F.lit(0), F.least(F.col("size"), F.col("_goal") - r * n - F.col("_at")))
    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(int(-(-limit // 1)))), lambda r: F.struct(r.alias("r"), copy(r).alias("words"))), lambda c: c["words"] > 0)
    place = lambda c: training_position(F.least(F.lit(1.0), (c["r"] * n + F.col("_at") + c["words"] / 2) / F.col("_goal")), F.col("_from"), F.col("_to"))
    out = out.withColumn("_copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", F.aggregate("_copies", F.lit(0).cast("long"), lambda s, c: s + c["words"]).alias("taken"), F.transform("_copies", lambda c: c["words"]).alias("copies"), F.transform("_copies", place).alias("positions"), *keep)


def ordered(docs: DataFrame, **settings) -> DataFrame:
    """What the mix takes of each document, range-sorted by training position: doc_id, size, source_size, target, taken,
    copies and position, the place of its first copy in [0, 1]. Documents of which nothing is taken stand last, without one.

    Null and empty texts have size 0 and are not taken; a null source is a source, the last. Repeated rows are documents of
    their own, of which ties in place go to the smaller doc_id; an empty table gives no rows; other columns are ignored.
    """
    out = mix(docs, **settings).withColumn("position", F.try_element_at("positions", F.lit(1))).withColumn("copies", F.size("copies").cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def curriculum(docs: DataFrame, **settings) -> DataFrame:
    """The mix as training order: one row per copy with all columns of ``docs``, range-sorted by position.

    A copy that the target cuts keeps its first words. Repeats keep their doc_id. Columns may have any names; a column
    n_chars follows the text. Nulls, ties, repeated rows and empty tables: as in ``mix``.
    """
    mixed = mix(docs.select("doc_id", "source", "text", F.struct("*").alias("_doc")), keep=["text", "_doc"], **settings)
    copies = mixed.withColumn("_copy", F.explode(F.arrays_zip("copies", "positions")))
    words = F.col("_copy.copies")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), words.cast("int")), "")
    text = F.when(words < F.col("size"), cut).otherwise(F.col("text"))
    own = lambda c: text if c == "text" else F.char_length(text).cast("long") if c == "n_chars" else F.col("_doc")[c]
    placed = copies.select(F.col("_copy.positions").alias("_position"), F.col("doc_id").alias("_id"), F.struct(*[own(c).alias(c) for c in docs.columns]).alias("_doc"))
    return placed.orderBy("_position", "_id").select("_doc.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS o FROM documents
), totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS d0,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS d1,
    2.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS everything FROM totals
), levels AS (
  SELECT *, (1.5::DOUBLE * everything - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted
), targets AS (
  SELECT source, source_size, d0, d1, coalesce(least(cap, w * (SELECT arg_min(level, cap / w) FROM levels WHERE cap / w > level)), cap) AS target FROM levels
), placed AS (
  SELECT s.*, t.source_size, t.target, t.d0, t.d1, CAST(round_even(t.target, 0) AS BIGINT) AS goal,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT *, list_filter([greatest(0, least(size, goal - place)), greatest(0, least(size, goal - source_size - place)), greatest(0, least(size, goal - 2 * source_size - place))], lambda w: w > 0) AS words
  FROM placed
), shares AS (
  SELECT *, least(1.0::DOUBLE, CAST(place + words[1] / 2 AS DOUBLE) / goal) * (d0 + d1) / 2 AS x FROM copied
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(list_sum(words), 0) AS BIGINT) AS taken, CAST(len(words) AS BIGINT) AS copies,
  CASE WHEN len(words) = 0 THEN NULL WHEN d0 = d1 THEN x / d0 ELSE (sqrt(d0 * d0 + 2 * (d1 - d0) * x) - d0) / (d1 - d0) END AS position
FROM shares
"""
