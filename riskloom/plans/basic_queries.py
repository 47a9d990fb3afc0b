"""Joins, set operations, filters, targets and profiles in the forms that the inventory names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.times import yyyymm
from riskloom.operators import binning, interactions, metrics
from riskloom.plans.catalogue import register, table
from riskloom.plans.measure_queries import POP, gini_sql, population


def orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders")


def customers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer")


register("J04_reindex", lambda s, d: customers(s, d).select(F.col("c_custkey").alias("k")).join(orders(s, d).groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("total")), "k", "left"), "SELECT c_custkey AS k, total FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey", "total")
register("J07_outer_join", lambda s, d: orders(s, d).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).join(customers(s, d).where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), "c_acctbal"), "k", "full_outer"), "SELECT coalesce(o_custkey, c_custkey) AS k, n, c_acctbal FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey")
register("J08_F27_month_lookup", lambda s, d: table(s, d, "lineitem").join(orders(s, d).select(F.col("o_orderkey").alias("l_orderkey"), yyyymm(F.col("o_orderdate")).alias("month")), "l_orderkey", "left").groupBy("month").agg(F.count("*").alias("n")), "SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
register("J10_bad_rate_lookup", lambda s, d: (lambda p: p.join(p.groupBy("l_discount").agg(F.avg(F.col("y").cast("double")).alias("rate")), "l_discount", "left").select("l_orderkey", "l_linenumber", "rate"))(population(s, d)), POP + "SELECT l_orderkey, l_linenumber, avg(y) OVER (PARTITION BY l_discount) AS rate FROM p", "rate")
register("J12_U04_semi_join", lambda s, d: customers(s, d).join(orders(s, d).where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
register("J14_totals_join_back", lambda s, d: orders(s, d).groupBy("o_orderstatus", "o_orderpriority").count().select("o_orderstatus", "o_orderpriority", F.col("count").alias("n"), F.sum("count").over(Window.partitionBy("o_orderstatus")).alias("n_all")), "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS n_all FROM orders GROUP BY o_orderstatus, o_orderpriority")
register("U01_U03_U06_union_distinct", lambda s, d: customers(s, d).select(F.col("c_custkey").alias("k")).unionByName(orders(s, d).select(F.col("o_custkey").alias("k"))).distinct(), "SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders")
register("U05_difference", lambda s, d: customers(s, d).select(F.col("c_custkey").alias("k")).join(orders(s, d).select(F.col("o_custkey").alias("k")), "k", "left_anti"), "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
register("P18_homogeneity", lambda s, d: orders(s, d).groupBy("o_orderpriority").count().agg((F.max("count") / F.sum("count")).alias("share")), "SELECT max(n) / sum(n) AS share FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)", "share")
register("P04_between", lambda s, d: orders(s, d).where(F.col("o_totalprice").between(1000, 50000)).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
register("A53_row_mean", lambda s, d: population(s, d).select("l_orderkey", "l_linenumber", ((F.col("l_quantity") + F.col("l_discount") + F.col("l_extendedprice")) / 3).alias("mean")), POP + "SELECT l_orderkey, l_linenumber, (l_quantity + l_discount + l_extendedprice) / 3 AS mean FROM p", "mean")
register(
    "A56_F28_target_from_delinquency",
    lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.least(F.lit(30), F.greatest(F.lit(0), F.coalesce(F.col("l_quantity"), F.lit(0)) - 20))).alias("days"), F.max((F.col("l_linenumber") <= 2) & (F.col("l_returnflag") == "R")).cast("int").alias("target_2"), F.max(F.col("l_returnflag") == "R").cast("int").alias("target_all")),
    "SELECT l_orderkey, max(least(30, greatest(0, coalesce(l_quantity, 0) - 20))) AS days, max(CASE WHEN l_linenumber <= 2 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS target_2, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS target_all FROM lineitem GROUP BY 1",
)
_CAT = ", t AS (SELECT yr AS bin, count(*) AS n, sum(y) AS bads FROM p GROUP BY 1), x AS (SELECT *, sum(n) OVER () AS an, sum(bads) OVER () AS ab FROM t) "
register("A45_B28_categorical_table", lambda s, d: binning.bin_table(population(s, d), F.col("yr"), "y").select("bin", "n", "bads", "rate", "iv"), POP + _CAT + "SELECT bin, n, bads, bads / n AS rate, ((n - bads) / (an - ab) - bads / ab) * ln(((n - bads) / (an - ab)) / (bads / ab)) AS iv FROM x", "n bads rate iv")
register("A46_B25_quantile_table", lambda s, d: binning.bin_table(population(s, d), binning.bin_index(F.col("l_extendedprice"), metrics.quantile_edges(population(s, d), "l_extendedprice", 4)), "y").select("bin", "n", "bads", "rate"), POP + ", e AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.75) AS c FROM p) SELECT CAST(l_extendedprice >= a AS INTEGER) + CAST(l_extendedprice >= b AS INTEGER) + CAST(l_extendedprice >= c AS INTEGER) AS bin, count(*) AS n, sum(y) AS bads, avg(y) AS rate FROM p, e GROUP BY 1", "n bads rate")
register("B34_B36_group_of_pairs", lambda s, d: population(s, d).select(interactions.group_of([[(F.col("l_quantity") > 10, F.col("l_discount") <= 0.05)], [(F.col("l_quantity") > 30, F.col("l_discount") > 0.02)]]).alias("g")).groupBy("g").agg(F.count("*").alias("n")), POP + ", x AS (SELECT " + interactions.group_sql("g", [[("l_quantity > 10", "l_discount <= 0.05")], [("l_quantity > 30", "l_discount > 0.02")]]) + " FROM p) SELECT g, count(*) AS n FROM x GROUP BY g")
register(
    "B35_interaction_potential",
    lambda s, d: interactions.potential(population(s, d), "l_quantity", "l_discount", "y", 2),
    POP + ", e AS (SELECT min(l_quantity) AS low, quantile_cont(l_quantity, 0.5) AS a, avg(l_discount) AS m FROM p), b AS (SELECT CAST(l_quantity > a AS INTEGER) AS bin, avg(CASE WHEN l_discount <= m THEN CAST(y AS DOUBLE) END) AS rate_below, avg(CASE WHEN l_discount > m THEN CAST(y AS DOUBLE) END) AS rate_above FROM p, e WHERE l_quantity > low GROUP BY 1) SELECT *, rate_above - rate_below AS difference FROM b",
    "rate_below rate_above difference",
)
register("B35_interaction_p_values", lambda s, d: interactions.interaction_potential(population(s, d), ["l_quantity", "l_discount", "l_extendedprice"], "y"))
register("B37_pair_power", lambda s, d: interactions.pair_power(population(s, d), ["l_quantity", "l_discount"], "y", 2), POP + ", e AS (SELECT quantile_cont(l_quantity, 0.5) AS a, quantile_cont(l_discount, 0.5) AS b FROM p), z AS (SELECT avg(y) OVER (PARTITION BY l_quantity > a, l_discount > b) AS rate, y FROM p, e)" + gini_sql("rate", "", "z").replace("SELECT auc, 2 * auc - 1 AS gini, ks, n", "SELECT 'l_quantity' AS a, 'l_discount' AS b, 2 * auc - 1 AS gini"), "gini")
register("W19_largest_leap", lambda s, d: interactions.largest_leap(population(s, d), "seg", "yr", "y"), POP + ", t AS (SELECT yr, seg, avg(y) AS rate, dense_rank() OVER (PARTITION BY yr ORDER BY avg(y) DESC) AS r FROM p GROUP BY yr, seg), w AS (SELECT seg, CASE WHEN r <> lead(r) OVER v THEN abs(rate - lead(rate) OVER v) END AS leap FROM t WINDOW v AS (PARTITION BY seg ORDER BY yr)) SELECT seg AS bin, max(leap) AS leap FROM w GROUP BY seg", "leap")
register(
    "M23_W10_uplift_area",
    lambda s, d: (lambda c: c.withColumn("_w", (F.col("cum_uplift") + F.coalesce(F.lag("cum_uplift").over(Window.orderBy("bin")), F.lit(0.0))) / 20).agg((F.sum("_w") - F.max_by("cum_uplift", "bin") / 2).alias("area")))(metrics.uplift_curve(population(s, d).withColumn("k", F.col("l_orderkey") * 100 + F.col("l_linenumber")), "l_extendedprice", "y", "treated", "k")),
    POP + ", r AS (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey * 100 + l_linenumber) AS k, count(*) OVER () AS n FROM p), b AS (SELECT (k - 1) * 10 // n AS bin, sum(CASE WHEN treated = 0 THEN y ELSE 0 END) AS y0, sum(CASE WHEN treated = 1 THEN y ELSE 0 END) AS y1, sum(CASE WHEN treated = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN treated = 1 THEN 1 ELSE 0 END) AS n1 FROM r GROUP BY 1), c AS (SELECT bin, sum(y1) OVER w / sum(n1) OVER w - sum(y0) OVER w / sum(n0) OVER w AS u FROM b WINDOW w AS (ORDER BY bin)) SELECT sum(x) - max(CASE WHEN bin = 9 THEN u END) / 2 AS area FROM (SELECT bin, u, (u + coalesce(lag(u) OVER (ORDER BY bin), 0)) / 20 AS x FROM c)",
    "area",
)
