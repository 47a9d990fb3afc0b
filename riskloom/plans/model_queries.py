"""Queries over sources, streams, models, scorecards and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import binning, collections, imputation, models
from riskloom.plans.catalogue import register, table
from riskloom.plans.measure_queries import POP, population
from riskloom.sources import tables
from riskloom.streaming import events as streams


def facts(s: SparkSession, d: str) -> DataFrame:
    """Orders as attribute-value rows."""
    o = table(s, d, "orders")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    parts = F.array(F.struct(F.lit("status").alias("attribute"), number.alias("num"), F.col("o_orderstatus").alias("txt")), F.struct(F.lit("key").alias("attribute"), F.col("o_orderkey").cast("double").alias("num"), text.alias("txt")))
    return o.select("o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("phase"), F.explode(parts).alias("x")).select("o_custkey", "phase", "x.*")


register(
    "S10_W15_pivot_attributes",
    lambda s, d: tables.pivot_attributes(facts(s, d).where("attribute = 'status'"), "o_custkey", "attribute", "phase", ["num", "txt"], ["status"]),
    "SELECT o_custkey, max(o_orderstatus) AS status FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderdate = m GROUP BY o_custkey",
)
register(
    "S08_A54_attribute_profile",
    lambda s, d: tables.attribute_profile(facts(s, d), "o_custkey", "attribute", ["num", "txt"]),
    "SELECT 'status' AS attribute, count(DISTINCT o_custkey) AS n_entities, CAST(0 AS BIGINT) AS n_num, count(o_orderstatus) AS n_txt FROM orders UNION ALL SELECT 'key', count(DISTINCT o_custkey), count(o_orderkey), 0 FROM orders",
)
register(
    "S05_S07_suggest_types",
    lambda s, d: tables.suggest_types(table(s, d, "lineitem"), ["l_linenumber", "l_quantity"]),
    "SELECT 'l_linenumber' AS \"column\", CASE WHEN max(l_linenumber) < 128 THEN 'tinyint' ELSE 'smallint' END AS type FROM lineitem UNION ALL SELECT 'l_quantity', CASE WHEN count(DISTINCT CAST(l_quantity AS FLOAT)) = count(DISTINCT l_quantity) THEN 'float' ELSE 'double' END FROM lineitem",
)
register(
    "S12_import_catalogue",
    lambda s, d: tables.import_catalogue(table(s, d, "region").select(F.concat(F.lit("data.items[]."), F.lower(F.regexp_replace("r_name", " ", ""))).alias("path")), "path", [("any", lambda c: c.isNotNull()), ("asia", lambda c: c.contains("asia"))], [(r"^data\.items\[\]\.", "i_")]).select("path", "depth", "family", "name", "block"),
    "SELECT 'data.items[].' || lower(replace(r_name, ' ', '')) AS path, 1 AS depth, CASE WHEN contains(lower(r_name), 'asia') THEN 'asia' ELSE 'any' END AS family, 'i_' || lower(replace(r_name, ' ', '')) AS name, CASE WHEN contains(lower(r_name), 'asia') THEN 'asia' ELSE 'any' END || '_1' AS block FROM region",
)
register(
    "T01_tumbling_windows",
    lambda s, d: streams.tumbling(table(s, d, "events"), "user_id", "ts", "value", "1 day", "2 days").select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "total", "least", "most"),
    "SELECT user_id, date_trunc('day', ts) AS window_start, count(*) AS n, sum(value) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY ALL",
    "total least most",
)
register(
    "T02_sessions",
    lambda s, d: streams.sessions(table(s, d, "events"), "user_id", "ts", "6 hours", "2 days").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest")),
    """WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM a), c AS (SELECT user_id, k, count(*) AS n FROM b GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY user_id""",
)
register(
    "C06_W14_payment_curve",
    lambda s, d: collections.payment_curve(population(s, d), "seg", "yr", "l_extendedprice"),
    POP + "SELECT seg, yr, sum(sum(l_extendedprice)) OVER (PARTITION BY seg ORDER BY yr) / sum(sum(l_extendedprice)) OVER (PARTITION BY seg) AS share FROM p GROUP BY seg, yr",
    "share",
)
register(
    "C01_impact_curve",
    lambda s, d: collections.impact_curve(population(s, d), "yr", "l_quantity", "treated"),
    POP + ", t AS (SELECT yr AS bin, count(*) AS n, avg(CASE WHEN treated = 1 THEN l_quantity END) AS m1, avg(CASE WHEN treated = 0 THEN l_quantity END) AS m0 FROM p GROUP BY 1) SELECT bin, (sum(n * m1) OVER (ORDER BY bin) + coalesce(sum(n * m0) OVER (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) / sum(n) OVER () AS per_head FROM t",
    "per_head",
)
register("C05_C07_quantiles_by_day", lambda s, d: collections.quantiles_by_day(population(s, d), "yr", "l_quantity", [0.05, 0.5, 0.95]), POP + "SELECT yr, quantile_cont(l_quantity, 0.05) AS q5, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.95) AS q95 FROM p GROUP BY yr", "q5 q50 q95")
register("C03_daily_winner", lambda s, d: collections.daily_winner(population(s, d), "yr", "seg", "l_extendedprice"), POP + ", t AS (SELECT yr, seg, row_number() OVER (PARTITION BY yr ORDER BY avg(l_extendedprice) DESC, seg) AS r FROM p GROUP BY yr, seg) SELECT seg AS winner, count(*) AS days FROM t WHERE r = 1 GROUP BY seg")


def scored(s: SparkSession, d: str) -> DataFrame:
    rows = population(s, d)
    card = models.fit_scorecard(rows, [binning.fit_numeric(rows, c, "y", 4, 200) for c in ("l_quantity", "l_extendedprice")], "y")
    return rows.select("l_orderkey", "l_linenumber", card.score().alias("score"))


register("L18_L19_scorecard", scored)


def selected(s: SparkSession, d: str) -> DataFrame:
    rows = population(s, d).withColumn("k", models.fold("l_orderkey", 2))
    model, history = models.stepwise(rows.where("k = 0"), rows.where("k = 1"), ["l_quantity", "l_discount", "l_extendedprice"], "y", least_gain=-1.0, most=2)
    return s.createDataFrame(history, "column string, gini double")


register("L01_stepwise", selected)
register("R25_R27_partial_dependence", lambda s, d: models.partial_dependence(population(s, d), models.Logit(["l_quantity", "l_discount"], [0.01, -2.0], 0.1), "l_quantity", [1, 25, 50]), POP + ", k AS (SELECT unnest([1.0::DOUBLE, 25.0::DOUBLE, 50.0::DOUBLE]) AS point) SELECT point, avg(1 / (1 + exp(-(0.1 + 0.01 * point - 2.0 * l_discount)))) AS mean_score FROM p, k GROUP BY point", "point mean_score")
register("L07_variable_clusters", lambda s, d: s.createDataFrame(sorted(models.cluster_variables(population(s, d), ["l_quantity", "l_discount", "l_extendedprice"], 0.5).items()), "column string, cluster int"))
register("C02_bootstrap_impact", lambda s, d: collections.bootstrap_impact(population(s, d), "yr", "l_quantity", "treated", "l_orderkey", 10))
register("C04_W13_trajectories", lambda s, d: collections.trajectories(population(s, d), "yr", "seg", "l_extendedprice", 5))
register(
    "I05_by_correlation",
    lambda s, d: imputation.by_correlation(population(s, d).withColumn("x", F.when(F.col("l_quantity") > 10, F.col("l_discount"))), "x", "y"),
    POP + ", g AS (SELECT CASE WHEN l_quantity > 10 THEN l_discount END AS x, CAST(y AS DOUBLE) AS y FROM p), r AS (SELECT avg(x) AS m, corr(x, y) AS c, avg(CASE WHEN x IS NULL THEN y END) / avg(y) AS r FROM g) SELECT m * CASE WHEN c >= 0 THEN r ELSE 1 / r END AS imputed FROM r",
    "imputed",
)
register("I03_quantile_imputer", lambda s, d: s.createDataFrame([(imputation.quantile_imputer(population(s, d).withColumn("x", F.when(F.col("l_quantity") > 10, F.col("l_extendedprice"))), "x", "y"),)], "imputed double"))
register("L05_bootstrap_logit", lambda s, d: population(s, d).select("l_orderkey", "l_linenumber", models.bootstrap_logit(population(s, d), ["l_quantity", "l_discount"], "y", "l_orderkey", 2).score().alias("score")))
register("B06_uplift_binning", lambda s, d: binning.net_woe(population(s, d), binning.bin_index(F.col("l_quantity"), binning.fit_uplift(population(s, d), "l_quantity", "y", "treated", 3, 50)), "y", "treated"))
