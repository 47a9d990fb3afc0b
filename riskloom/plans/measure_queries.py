"""Queries over a scored population: metrics, stability, binning, encoders, reports, samples, imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import binning, imputation, metrics, reports, sampling
from riskloom.plans.catalogue import register, table

POP = "WITH p AS (SELECT l_orderkey, l_linenumber, l_discount, l_quantity, l_extendedprice, CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(year(l_shipdate) AS INTEGER) AS yr, l_linestatus AS seg, l_suppkey % 2 AS treated FROM lineitem) "


def population(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"), F.year("l_shipdate").alias("yr"), F.col("l_linestatus").alias("seg"), (F.col("l_suppkey") % 2).alias("treated"), "l_shipdate")


def curve_sql(score: str, by: str = "", source: str = "p") -> str:
    """Score levels with running sums, as a table t."""
    part, cols = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f""", s AS (SELECT {cols}{score} AS score, CAST(sum(y) AS DOUBLE) AS bad, CAST(sum(1 - y) AS DOUBLE) AS good FROM {source} GROUP BY ALL),
    t AS (SELECT *, sum(bad) OVER w AS cb, sum(good) OVER w AS cg, sum(bad) OVER ({part}) AS ab, sum(good) OVER ({part}) AS ag FROM s WINDOW w AS ({part} ORDER BY score)) """


def gini_sql(score: str, by: str = "", source: str = "p") -> str:
    cols = f"{by}, " if by else ""
    return curve_sql(score, by, source) + f"SELECT {cols}auc, 2 * auc - 1 AS gini, ks, n FROM (SELECT {cols}sum(bad * (cg - good / 2)) / max(ab * ag) AS auc, max(abs(cb / ab - cg / ag)) AS ks, max(ab + ag) AS n FROM t {f'GROUP BY {by}' if by else ''})"


register("M01_M02_M10_gini_ks", lambda s, d: metrics.discrimination(population(s, d), "l_extendedprice", "y"), POP + gini_sql("l_extendedprice"), "auc gini ks n")
register("M11_R05_R28_gini_in_time", lambda s, d: metrics.discrimination(population(s, d), "l_extendedprice", "y", None, ("yr",)), POP + gini_sql("l_extendedprice", "yr"), "auc gini ks n")
register("R06_gini_by_segment", lambda s, d: metrics.discrimination(population(s, d), "l_discount", "y", None, ("seg",)), POP + gini_sql("l_discount", "seg"), "auc gini ks n")
register(
    "M08_M09_R10_R33_roc",
    lambda s, d: metrics.roc(population(s, d), "l_quantity", "y"),
    POP + ", s AS (SELECT l_quantity AS score, CAST(sum(y) AS DOUBLE) AS bad, CAST(sum(1 - y) AS DOUBLE) AS good FROM p GROUP BY ALL), t AS (SELECT *, sum(bad) OVER w AS cb, sum(good) OVER w AS cg, sum(bad) OVER () AS ab, sum(good) OVER () AS ag FROM s WINDOW w AS (ORDER BY score DESC)) SELECT score, cg / ag AS fpr, cb / ab AS tpr, (cb + cg) / (ab + ag) AS share, (cb / (cb + cg)) / (ab / (ab + ag)) AS lift FROM t",
    "fpr tpr share lift",
)
register("M03_M37_lift", lambda s, d: metrics.lift(population(s, d), "l_extendedprice", "y", 10), POP + "SELECT avg(CASE WHEN l_extendedprice <= c THEN CAST(y AS DOUBLE) END) / avg(y) AS lift FROM p, (SELECT quantile_cont(l_extendedprice, 0.1) AS c FROM p)", "lift")
register("M12_R07_R29_lift_in_time", lambda s, d: metrics.lift(population(s, d), "l_extendedprice", "y", 20, "high", ("yr",)), POP + "SELECT yr, avg(CASE WHEN l_extendedprice >= c THEN CAST(y AS DOUBLE) END) / avg(y) AS lift FROM p JOIN (SELECT yr, quantile_cont(l_extendedprice, 0.8) AS c FROM p GROUP BY yr) USING (yr) GROUP BY yr", "lift")
register("R09_R34_lift_levels", lambda s, d: metrics.lift_levels(population(s, d), "l_extendedprice", "y", [5, 10, 50]), POP + ", c AS (SELECT unnest([5, 10, 50]) AS percent), k AS (SELECT percent, (SELECT quantile_cont(l_extendedprice, 0.95) FROM p) AS a, (SELECT quantile_cont(l_extendedprice, 0.9) FROM p) AS b, (SELECT quantile_cont(l_extendedprice, 0.5) FROM p) AS e FROM c) SELECT percent, avg(CASE WHEN l_extendedprice >= CASE percent WHEN 5 THEN a WHEN 10 THEN b ELSE e END THEN CAST(y AS DOUBLE) END) / avg(y) AS lift FROM p, k GROUP BY percent", "lift")
register("M05_information_value", lambda s, d: metrics.information_value(population(s, d), "l_quantity", "y"), POP + ", t AS (SELECT l_quantity, sum(y) + 1 AS b, sum(1 - y) + 1 AS g FROM p GROUP BY 1), q AS (SELECT b / sum(b) OVER () AS pb, g / sum(g) OVER () AS pg FROM t) SELECT sum((pg - pb) * ln(pg / pb)) AS iv FROM q", "iv")
register("M06_R31_predictor_power", lambda s, d: metrics.predictor_power(population(s, d), ["l_quantity", "l_discount"], "y"), POP + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS predictor, (SELECT sum((pg - pb) * ln(pg / pb)) FROM (SELECT b / sum(b) OVER () AS pb, g / sum(g) OVER () AS pg FROM (SELECT sum(y) + 1 AS b, sum(1 - y) + 1 AS g FROM p GROUP BY {c}))) AS iv, (SELECT gini FROM (WITH z AS (SELECT 1){gini_sql('-' + c)})) AS gini" for c in ("l_quantity", "l_discount")) + ")", "iv gini")
register(
    "M04_R32_R36_performance",
    lambda s, d: reports.performance(population(s, d), ["l_quantity", "l_extendedprice"], "y", ("seg",)),
    POP + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT g.seg, '{c}' AS score, gini, ks, lift, n FROM (WITH z AS (SELECT 1){gini_sql(c, 'seg')}) g JOIN (SELECT seg, avg(CASE WHEN {c} >= k THEN CAST(y AS DOUBLE) END) / avg(y) AS lift FROM p JOIN (SELECT seg, quantile_cont({c}, 0.9) AS k FROM p GROUP BY seg) USING (seg) GROUP BY seg) USING (seg)" for c in ("l_quantity", "l_extendedprice")) + ")",
    "gini ks lift n",
)
register("M14_M13_stability", lambda s, d: metrics.stability(population(s, d), "l_quantity", "yr", F.col("yr") == 1998, 5), POP + """, e AS (SELECT list_distinct([quantile_cont(l_quantity, 0.2), quantile_cont(l_quantity, 0.4), quantile_cont(l_quantity, 0.6), quantile_cont(l_quantity, 0.8)]) AS e FROM p WHERE yr = 1998),
    b AS (SELECT yr, len(list_filter(e, lambda x: l_quantity > x)) AS bin FROM p, e), q AS (SELECT bin, count(*) / sum(count(*)) OVER () AS q FROM b WHERE yr = 1998 GROUP BY bin),
    m AS (SELECT yr, bin, count(*) / sum(count(*)) OVER (PARTITION BY yr) AS p FROM b GROUP BY yr, bin), t AS (SELECT yr, bin, coalesce(m.p, 0) AS p, coalesce(q.q, 0) AS q FROM (SELECT DISTINCT yr FROM b) CROSS JOIN (SELECT DISTINCT bin FROM b) LEFT JOIN m USING (yr, bin) LEFT JOIN q USING (bin))
    SELECT yr, sum((greatest(p, 1e-4) - greatest(q, 1e-4)) * ln(greatest(p, 1e-4) / greatest(q, 1e-4))) AS psi, -ln(sum(sqrt(p * q))) AS bhattacharyya, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) / 2 ELSE 0 END) AS jensen_shannon FROM t GROUP BY yr""", "psi bhattacharyya jensen_shannon")
register("M18_psi_categories", lambda s, d: metrics.psi_categories(population(s, d).where("yr = 1998"), population(s, d).where("yr = 1999"), "l_quantity", "l_extendedprice"), POP + ", a AS (SELECT l_quantity, sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER () AS q FROM p WHERE yr = 1998 GROUP BY 1), b AS (SELECT l_quantity, sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER () AS p FROM p WHERE yr = 1999 GROUP BY 1) SELECT sum((p - q) * ln(p / q)) AS psi FROM a JOIN b USING (l_quantity)", "psi")
register("M19_psi_consecutive", lambda s, d: metrics.psi_consecutive(population(s, d), "l_discount", "yr"), POP + ", t AS (SELECT yr, l_discount, count(*) / sum(count(*)) OVER (PARTITION BY yr) AS s FROM p GROUP BY yr, l_discount) SELECT avg(x) AS psi FROM (SELECT b.yr, sum((b.s - a.s) * ln(b.s / a.s)) AS x FROM t a JOIN t b ON b.yr = a.yr + 1 AND a.l_discount = b.l_discount GROUP BY b.yr)", "psi")
register("M20_W08_rank_stability", lambda s, d: metrics.rank_stability(population(s, d), "seg", "yr", "y"), POP + ", t AS (SELECT yr, seg, dense_rank() OVER (PARTITION BY yr ORDER BY avg(y) DESC) AS r FROM p GROUP BY yr, seg), c AS (SELECT seg, r, count(*) AS n FROM t GROUP BY ALL), e AS (SELECT max(n) / sum(n) AS x FROM c GROUP BY seg), f AS (SELECT product(x) AS x FROM (SELECT r, n / sum(n) OVER (PARTITION BY r) AS x FROM c) GROUP BY r) SELECT (SELECT avg(x) FROM e) AS rsi, (SELECT avg(x) FROM f) AS rsi_product", "rsi rsi_product")
register("M16_psi_equal_width", lambda s, d: metrics.psi_equal_width(population(s, d), "l_extendedprice", F.col("yr") < 1999, 20), POP + ", r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM p WHERE yr < 1999), b AS (SELECT least(19, floor((l_extendedprice - lo) / (hi - lo) * 20)) AS bin, yr < 1999 AS f FROM p, r WHERE l_extendedprice BETWEEN lo AND hi), t AS (SELECT bin, sum(CASE WHEN f THEN 1 ELSE 0 END) AS a, sum(CASE WHEN f THEN 0 ELSE 1 END) AS b FROM b GROUP BY bin), x AS (SELECT greatest(b / sum(b) OVER (), 1e-4) AS p, greatest(a / sum(a) OVER (), 1e-4) AS q FROM t) SELECT sum((p - q) * ln(p / q)) AS psi FROM x", "psi")
register("M31_M33_R13_R38_histogram", lambda s, d: metrics.histogram(population(s, d), "l_extendedprice", 20, "y"), POP + ", r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM p) SELECT CAST(least(19, floor((l_extendedprice - lo) / (hi - lo) * 20)) AS INTEGER) AS bin, max(lo) + least(19, floor((l_extendedprice - lo) / (hi - lo) * 20)) * (max(hi) - max(lo)) / 20 AS low, count(*) AS n, CAST(sum(y) AS BIGINT) AS bads FROM p, r GROUP BY least(19, floor((l_extendedprice - lo) / (hi - lo) * 20))", "low")
register("M07_R35_bootstrap_gini", lambda s, d: metrics.bootstrap_gini(population(s, d), "l_quantity", "y", "l_orderkey", 10))
register("M21_niv", lambda s, d: metrics.niv(population(s, d), "l_quantity", "y", "treated"), POP + ", t AS (SELECT l_quantity, " + ", ".join(f"sum(CASE WHEN treated = {a} AND y = {b} THEN 1 ELSE 0 END) + 1.0::DOUBLE AS c{a}{b}" for a in (0, 1) for b in (0, 1)) + " FROM p GROUP BY 1), q AS (SELECT " + ", ".join(f"c{a}{b} / sum(c{a}{b}) OVER () AS p{a}{b}" for a in (0, 1) for b in (0, 1)) + " FROM t) SELECT sum((p11 * p00 - p10 * p01) * ln(p11 * p00 / (p10 * p01))) AS niv FROM q", "niv")
register(
    "M22_uplift_curve",
    lambda s, d: metrics.uplift_curve(population(s, d).withColumn("k", F.col("l_orderkey") * 100 + F.col("l_linenumber")), "l_extendedprice", "y", "treated", "k"),
    POP + ", r AS (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey * 100 + l_linenumber) AS k, count(*) OVER () AS n FROM p), b AS (SELECT CAST((k - 1) * 10 // n AS INTEGER) AS bin, sum(CASE WHEN treated = 0 THEN y ELSE 0 END) AS y0, sum(CASE WHEN treated = 1 THEN y ELSE 0 END) AS y1, sum(CASE WHEN treated = 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN treated = 1 THEN 1 ELSE 0 END) AS n1 FROM r GROUP BY 1) SELECT bin, y1 / n1 - y0 / n0 AS uplift, sum(y1) OVER w / sum(n1) OVER w - sum(y0) OVER w / sum(n0) OVER w AS cum_uplift FROM b WINDOW w AS (ORDER BY bin)",
    "uplift cum_uplift",
)
_EDGES = [10.0, 25.0, 40.0]
_BIN = "CAST(l_quantity >= 10 AS INTEGER) + CAST(l_quantity >= 25 AS INTEGER) + CAST(l_quantity >= 40 AS INTEGER)"
_TABLE = "t AS (SELECT {b} AS bin, count(*) AS n, sum(y) AS bads FROM p GROUP BY 1), x AS (SELECT *, sum(n) OVER () AS an, sum(bads) OVER () AS ab FROM t)"
_WOE = "ln((1 - bads / n + 0.001) / (bads / n + 0.001)) - ln((1 - ab / an + 0.001) / (ab / an + 0.001))"
register("B01_B02_B09_B22_B32_bin_table", lambda s, d: binning.bin_table(population(s, d), binning.Bins("l_quantity", edges=_EDGES).index(), "y"), POP + f", {_TABLE.format(b=_BIN)} SELECT bin, n, bads, bads / n AS rate, n / an AS share, (n - bads) / (an - ab) AS dist_good, bads / ab AS dist_bad, {_WOE} AS woe, ((n - bads) / (an - ab) - bads / ab) * ln(((n - bads) / (an - ab)) / (bads / ab)) AS iv FROM x", "n bads rate share dist_good dist_bad woe iv")


def transformed(s: SparkSession, d: str) -> DataFrame:
    rows = population(s, d)
    bins = [binning.fit_numeric(rows, "l_quantity", "y", edges=_EDGES)]
    out = binning.transform(binning.transform(binning.transform(rows, bins), bins, "group_number"), bins, "dummy")
    return out.groupBy("l_quantity_WOE", "l_quantity_GRP").agg(F.count("*").alias("n"), F.sum("l_quantity_DMY_0").alias("d0"), F.sum("l_quantity_DMY_NaN").alias("dn"))


register("B10_B15_transform", transformed, POP + f", {_TABLE.format(b=_BIN)} SELECT {_WOE} AS l_quantity_WOE, bin AS l_quantity_GRP, n, CAST(CASE WHEN bin = 0 THEN n ELSE 0 END AS BIGINT) AS d0, CAST(0 AS BIGINT) AS dn FROM x", "l_quantity_WOE")


def tree_bins(s: SparkSession, d: str) -> DataFrame:
    rows = population(s, d)
    b = binning.fit_numeric(rows, "l_extendedprice", "y", 4, 200)
    return binning.bin_table(rows, b.index(), "y").select("bin", "n", "rate", "woe")


register("B05_B07_tree_binning", tree_bins)


def by_year(s: SparkSession, d: str) -> DataFrame:
    return population(s, d).withColumn("c", F.col("yr").cast("string"))


register("B08_categorical_binning", lambda s, d: binning.transform(by_year(s, d), [binning.fit_categorical(by_year(s, d), "c", "y", 3, 200)], "group_number").groupBy("c", "c_GRP").count())
register("B18_B20_stable_grouping", lambda s, d: binning.transform(population(s, d), [binning.fit_stable(population(s, d), "l_quantity", "y", "yr", 4, 100)], "group_number").groupBy("l_quantity_GRP").count())
register("B03_B38_net_woe", lambda s, d: binning.net_woe(population(s, d), F.col("l_quantity"), "y", "treated"), POP + ", t AS (SELECT l_quantity AS bin, " + ", ".join(f"sum(CASE WHEN treated = {a} AND y = {b} THEN 1 ELSE 0 END) AS c{a}{b}" for a in (0, 1) for b in (0, 1)) + " FROM p GROUP BY 1) SELECT bin, (ln((c10 + 1) / (sum(c10) OVER () + 1)) - ln((c11 + 1) / (sum(c11) OVER () + 1))) - (ln((c00 + 1) / (sum(c00) OVER () + 1)) - ln((c01 + 1) / (sum(c01) OVER () + 1))) AS nwoe FROM t", "nwoe")
register("B29_woe_encoder", lambda s, d: binning.woe_encoder(population(s, d), "l_discount", "y"), POP + f", {_TABLE.format(b='l_discount')} SELECT bin AS value, greatest(-5, least(5, {_WOE})) AS woe FROM x", "woe")
register("B30_mean_encoder", lambda s, d: binning.mean_encoder(population(s, d), "l_discount", "y"), POP + ", t AS (SELECT l_discount AS value, count(*) AS w, sum(y) AS y FROM p GROUP BY 1), x AS (SELECT *, sum(w) OVER () AS aw, sum(y) OVER () AS ay FROM t) SELECT value, (y + ay / aw * 0.01 * aw) / (w + 0.01 * aw) AS encoded FROM x", "encoded")
register("B31_odds_encoder", lambda s, d: binning.odds_encoder(population(s, d), "l_discount", "y"), POP + ", t AS (SELECT l_discount AS value, sum(1 - y) + 1 AS g, sum(y) + 1 AS b FROM p GROUP BY 1) SELECT value, (g / sum(g) OVER ()) / (b / sum(b) OVER ()) AS encoded FROM t", "encoded")
register("F22_J12_merge_rare", lambda s, d: binning.merge_rare(by_year(s, d), "c", 5000).groupBy("c").agg(F.count("*").alias("n")), POP + ", k AS (SELECT yr, count(*) AS n FROM p GROUP BY yr) SELECT CASE WHEN n < 5000 THEN 'RARE' ELSE CAST(yr AS VARCHAR) END AS c, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1")
register("F23_F24_discretize", lambda s, d: binning.discretize(population(s, d), "l_extendedprice", 4).groupBy("l_extendedprice_BIN").agg(F.count("*").alias("n")), POP + ", e AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.75) AS c FROM p) SELECT CAST(l_extendedprice >= a AS INTEGER) + CAST(l_extendedprice >= b AS INTEGER) + CAST(l_extendedprice >= c AS INTEGER) AS l_extendedprice_BIN, count(*) AS n FROM p, e GROUP BY 1")
register("B33_two_way", lambda s, d: binning.two_way(population(s, d), binning.Bins("l_quantity", edges=_EDGES).index(), F.col("seg"), "y"), POP + f"SELECT {_BIN} AS row_bin, seg AS col_bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS bads, avg(y) AS rate FROM p GROUP BY ALL", "rate")
register("B26_B27_W11_weighted_quantiles", lambda s, d: binning.weighted_quantiles(population(s, d), "l_quantity", "l_discount", [0.1, 0.5, 0.9]), POP + ", t AS (SELECT l_quantity AS v, sum(l_discount) AS w FROM p GROUP BY 1), c AS (SELECT v, sum(w) OVER (ORDER BY v) AS cw, sum(w) OVER () AS aw FROM t) SELECT s AS share, (SELECT min(v) FROM c WHERE cw >= s * aw - 1e-9) AS value FROM (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS s)", "value")

register("R01_R02_A55_R42_sample_description", lambda s, d: reports.sample_description(population(s, d), ["yr", "seg"], "y"), POP + "SELECT yr, seg, count(*) AS n, count(*) AS measurable, CAST(sum(y) AS BIGINT) AS bads, avg(y) AS rate FROM p GROUP BY ROLLUP (yr, seg)", "rate")
register("R03_M24_M32_R30_risk_in_time", lambda s, d: reports.risk_in_time(population(s, d), "yr", "seg", "y"), POP + "SELECT yr AS month, seg AS value, CAST(grouping_id(yr, seg) AS BIGINT) AS level, count(*) AS n, CAST(sum(y) AS BIGINT) AS bads, avg(y) AS rate FROM p GROUP BY CUBE (yr, seg)", "rate")
register("R04_B23_share_in_time", lambda s, d: reports.share_in_time(population(s, d), "yr", "seg"), POP + "SELECT yr AS month, seg AS value, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY yr) AS share FROM p GROUP BY yr, seg", "share")
register("J09_complete_in_time", lambda s, d: reports.complete_in_time(population(s, d), "yr", "l_quantity"), POP + "SELECT a.yr AS month, b.l_quantity AS value, coalesce(n, 0) AS n FROM (SELECT DISTINCT yr FROM p) a CROSS JOIN (SELECT DISTINCT l_quantity FROM p) b LEFT JOIN (SELECT yr, l_quantity, count(*) AS n FROM p GROUP BY ALL) USING (yr, l_quantity)")
register("A48_R22_R39_empty_share", lambda s, d: reports.empty_share(table(s, d, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P"))).withColumn("yr", F.year("o_orderdate")), "yr", ["status", "o_totalprice"]), "WITH x AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS g, round_even(avg(CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0 END), 3) AS a, round_even(avg(CASE WHEN o_totalprice IS NULL THEN 1.0::DOUBLE ELSE 0 END), 3) AS b FROM orders GROUP BY 1) SELECT g AS \"group\", 'status' AS \"column\", a AS \"empty\" FROM x UNION ALL SELECT g, 'o_totalprice', b FROM x")
register("A50_P15_P14_profile", lambda s, d: reports.profile(table(s, d, "orders"), ["o_custkey", "o_orderstatus"]), "SELECT 'o_custkey' AS \"column\", 'bigint' AS type, count(DISTINCT o_custkey) AS n_distinct, CAST(count(o_custkey) / count(*) AS DOUBLE) AS fill FROM orders UNION ALL SELECT 'o_orderstatus', 'string', count(DISTINCT o_orderstatus), CAST(count(o_orderstatus) / count(*) AS DOUBLE) FROM orders")
register("A44_A57_describe", lambda s, d: reports.describe_numeric(population(s, d), "l_extendedprice", "y"), POP + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS part, count(*) AS n, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS std, min(l_extendedprice) AS min, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50, quantile_cont(l_extendedprice, 0.75) AS q75, max(l_extendedprice) AS max FROM p WHERE {c}" for n, c in (("all", "true"), ("1", "y = 1"), ("0", "y = 0"))) + ")", "mean min q25 q50 q75 max")
register("R14_A47_stats_in_time", lambda s, d: reports.stats_in_time(population(s, d), "yr", "l_extendedprice"), POP + "SELECT yr AS month, count(*) AS n, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std, min(l_extendedprice) AS min, " + ", ".join(f"quantile_cont(l_extendedprice, {p}) AS p{round(100 * p)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + ", max(l_extendedprice) AS max FROM p GROUP BY 1", "mean std min p10 p25 p50 p75 p90 max")
register("A49_dynamic_diversity", lambda s, d: reports.distinct_per_entity(table(s, d, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"]), "WITH t AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_orderpriority) AS b FROM orders GROUP BY 1) SELECT 'o_orderstatus' AS \"column\", min(a) AS least, avg(a) AS mean, max(a) AS most FROM t UNION ALL SELECT 'o_orderpriority', min(b), avg(b), max(b) FROM t", "mean")
register("R15_R16_log_risk", lambda s, d: reports.log_risk(population(s, d), "l_extendedprice", "y", 5), POP + ", e AS (SELECT " + ", ".join(f"quantile_cont(l_extendedprice, {i / 5}) AS e{i}" for i in range(1, 5)) + " FROM p), b AS (SELECT " + " + ".join(f"CAST(l_extendedprice > e{i} AS INTEGER)" for i in range(1, 5)) + " AS bin, y FROM p, e) SELECT bin, count(*) AS n, avg(y) AS rate, ln(avg(y) / (1 - avg(y))) AS log_risk FROM b GROUP BY bin", "rate log_risk")
register("R21_correlation", lambda s, d: reports.correlation(population(s, d), ["l_quantity", "l_discount", "l_extendedprice"]), POP + ", r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS r{i}" for i, c in enumerate(("l_quantity", "l_discount", "l_extendedprice"))) + " FROM p) SELECT 'l_quantity' AS a, 'l_discount' AS b, corr(r0, r1) AS rho FROM r UNION ALL SELECT 'l_quantity', 'l_extendedprice', corr(r0, r2) FROM r UNION ALL SELECT 'l_discount', 'l_extendedprice', corr(r1, r2) FROM r", "rho")
register("M25_R23_R37_transition", lambda s, d: reports.transition(population(s, d), "l_quantity", "l_extendedprice", "y", 3), POP + ", e AS (SELECT " + ", ".join(f"quantile_cont({c}, CAST({i} AS DOUBLE) / 3) AS {c[2]}{i}" for c in ("l_quantity", "l_extendedprice") for i in (1, 2)) + " FROM p), b AS (SELECT CAST(l_quantity > q1 AS INTEGER) + CAST(l_quantity > q2 AS INTEGER) AS old_bin, CAST(l_extendedprice > e1 AS INTEGER) + CAST(l_extendedprice > e2 AS INTEGER) AS new_bin, y FROM p, e) SELECT old_bin, new_bin, count(*) AS n, avg(y) AS rate, count(*) / sum(count(*)) OVER (PARTITION BY old_bin) AS share FROM b GROUP BY old_bin, new_bin", "rate share")
register("M26_M30_R40_calibration", lambda s, d: reports.calibration(population(s, d), "l_extendedprice", "y", 5), POP + ", e AS (SELECT " + ", ".join(f"quantile_cont(l_extendedprice, {i / 5}) AS e{i}" for i in range(1, 5)) + " FROM p), b AS (SELECT " + " + ".join(f"CAST(l_extendedprice >= e{i} AS INTEGER)" for i in range(1, 5)) + " AS bin, y, l_extendedprice FROM p, e) SELECT bin, count(*) AS n, avg(l_extendedprice) AS mean_score, avg(y) AS mean_target FROM b GROUP BY bin", "mean_score mean_target")
register("M27_M28_approval", lambda s, d: reports.approval(population(s, d), "l_quantity", "y", [0.3, 0.6]), POP + curve_sql("l_quantity") + ", k AS (SELECT unnest([0.3::DOUBLE, 0.6::DOUBLE]) AS rate), l AS (SELECT rate, max(score) AS cutoff, max(cb) AS b, max(cg) AS g, max(ab) AS ab, max(ag) AS ag FROM t, k WHERE cb + cg <= rate * (ab + ag) + 1e-9 GROUP BY rate) SELECT rate, cutoff, b / (b + g) AS bad_rate_below, (ab - b) / (ab + ag - b - g) AS bad_rate_above, (ag - g) / (ab + ag) AS false_reject, b / (ab + ag) AS false_approve FROM l", "rate cutoff bad_rate_below bad_rate_above false_reject false_approve")
register("M29_R41_P17_expected_approval", lambda s, d: reports.expected_approval(population(s, d), "l_extendedprice", [0.2, 0.5], "seg = 'F'"), POP + ", c AS (SELECT quantile_cont(l_extendedprice, 0.2) AS a, quantile_cont(l_extendedprice, 0.5) AS b FROM p) SELECT 0.2::DOUBLE AS rate, avg(CAST(l_extendedprice <= a AS INTEGER)) AS subset_rate FROM p, c WHERE seg = 'F' UNION ALL SELECT 0.5, avg(CAST(l_extendedprice <= b AS INTEGER)) FROM p, c WHERE seg = 'F'", "rate subset_rate")
register("A52_hit_rate", lambda s, d: reports.hit_rate(population(s, d).withColumn("s1", F.when(F.col("l_quantity") > 5, F.col("l_quantity"))), ["s1"], "yr"), POP + "SELECT yr AS month, 's1' AS score, avg(CASE WHEN l_quantity > 5 THEN 1 ELSE 0 END) AS hit_rate FROM p GROUP BY yr", "hit_rate")
register("W17_moving_gini", lambda s, d: reports.moving_gini(population(s, d), "l_quantity", "y", "yr"), POP + ", g AS (SELECT * FROM (WITH z AS (SELECT 1)" + gini_sql("l_quantity", "yr") + ")) SELECT yr AS month, gini, avg(gini) OVER (ORDER BY yr) AS mean_so_far FROM g", "gini mean_so_far")
register("M35_reject_order", lambda s, d: reports.reject_order(population(s, d), "l_discount", "y", "treated"), POP + ", t AS (SELECT l_discount AS value, count(*) AS n, avg(y) AS target_rate, avg(treated) AS reject_rate FROM p GROUP BY 1) SELECT *, rank() OVER (ORDER BY target_rate) = rank() OVER (ORDER BY reject_rate) AS same_order FROM t", "target_rate reject_rate")

register("O04_P10_split", lambda s, d: sampling.split(table(s, d, "orders"), "o_orderkey", [0.6, 0.2, 0.2], ["train", "valid", "test"], ["o_orderstatus"]).select("o_orderkey", "data_type"), "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || ':0')) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, CASE WHEN k <= round_even(0.6::DOUBLE * n + 1e-9, 0) THEN 'train' WHEN k <= round_even(0.8::DOUBLE * n + 1e-9, 0) THEN 'valid' ELSE 'test' END AS data_type FROM r")
register("O07_O08_fixed_sample", lambda s, d: sampling.fixed_sample(table(s, d, "orders"), "o_orderkey", 100).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':0'), o_orderkey LIMIT 100")
register("O05_time_split", lambda s, d: sampling.time_split(population(s, d), "yr", [1997, 2000], ["a", "b", "c"]).groupBy("period").agg(F.count("*").alias("n")), POP + "SELECT CASE WHEN yr < 1997 THEN 'a' WHEN yr < 2000 THEN 'b' ELSE 'c' END AS period, count(*) AS n FROM p GROUP BY 1")
register("J13_balance", lambda s, d: sampling.balance(table(s, d, "customer"), "c_mktsegment").select("c_custkey", "weight"), "SELECT c_custkey, max(n) OVER () / n AS weight FROM (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)", "weight")
_GAP = lambda s, d: population(s, d).withColumn("score", F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")))
register("I02_proportional", lambda s, d: imputation.proportional(_GAP(s, d), "score", "y"), POP + "SELECT avg(CASE WHEN l_quantity > 10 THEN l_extendedprice END) * avg(CASE WHEN l_quantity <= 10 THEN CAST(y AS DOUBLE) END) / avg(CASE WHEN l_quantity > 10 THEN CAST(y AS DOUBLE) END) AS imputed FROM p", "imputed")
_GAPS = POP + ", g AS (SELECT CASE WHEN l_quantity > 10 THEN l_extendedprice END AS score, CAST(y AS DOUBLE) AS y, l_quantity > 10 AS had FROM p)"


def _binned_sql(n: int) -> str:
    """Rates and means of n left-closed quantile bins of the score, as a table b."""
    edges = ", ".join(f"quantile_cont(score, {i / n}) AS e{i}" for i in range(1, n))
    return f"{_GAPS}, e AS (SELECT {edges} FROM g), b AS (SELECT {' + '.join(f'CAST(score >= e{i} AS INTEGER)' for i in range(1, n))} AS bin, avg(y) AS rate, avg(score) AS mean, CAST(count(*) AS DOUBLE) AS n FROM g, e WHERE score IS NOT NULL GROUP BY 1)"


register(
    "I01_I04_O03_discrete",
    lambda s, d: imputation.impute_score(_GAP(s, d), "score", "y").groupBy((F.col("l_quantity") > 10).alias("had")).agg(F.avg("score").alias("mean")),
    _binned_sql(10) + ", v AS (SELECT arg_min(mean, (abs(rate - m), bin)) AS value FROM b, (SELECT avg(y) AS m FROM g WHERE score IS NULL)) SELECT had, avg(coalesce(score, value)) AS mean FROM g, v GROUP BY had",
    "mean",
)
register(
    "I06_regression",
    lambda s, d: imputation.regression(_GAP(s, d), "score", "y", 5),
    _binned_sql(5) + ", t AS (SELECT sum(n) AS n, sum(n * mean) AS sx, sum(n * rate) AS sy, sum(n * mean * mean) AS sxx, sum(n * mean * rate) AS sxy FROM b) SELECT (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS intercept FROM t",
    "slope intercept",
)
register("I07_J11_target_weighted", lambda s, d: imputation.impute_target(population(s, d).withColumn("t", F.when(F.col("l_quantity") > 10, F.col("y"))).withColumn("pd", F.col("l_discount") * 5), "t", "pd").groupBy("t").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), POP + ", x AS (SELECT y AS t, 1.0::DOUBLE AS w FROM p WHERE l_quantity > 10 UNION ALL SELECT 1, l_discount * 5 FROM p WHERE l_quantity <= 10 UNION ALL SELECT 0, 1 - l_discount * 5 FROM p WHERE l_quantity <= 10) SELECT t, count(*) AS n, sum(w) AS weight FROM x GROUP BY t", "weight")
