"""Fits, selections, trees and replicates against plain Python on a small table."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import binning, boosting, collections, cumulative, imputation, metrics, models, reports

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(21)
    out = []
    for i in range(500):
        a, b = r.normal(), r.normal()
        c = 0.9 * a + 0.3 * r.normal()
        y = int(r.random() < 1 / (1 + np.exp(-(1.2 * a - 0.7 * b - 0.2))))
        out.append((i, float(a), float(b), float(c), y, i % 2, i % 3, float(r.integers(0, 12)), float(r.integers(1, 90)), "uvw"[i % 7 % 3]))
    return spark.createDataFrame(out, "i long, a double, b double, c double, y int, treated int, month int, few double, value double, g string").repartition(2).cache()


@pytest.fixture(scope="module")
def data(rows):
    return rows.orderBy("i").toPandas()


@pytest.fixture(scope="module")
def halves(rows, data):
    return rows.where("i % 2 = 0"), rows.where("i % 2 = 1"), data[data.i % 2 == 0], data[data.i % 2 == 1]


def logit(x, y, w=None):
    """Newton's method; coefficients and the intercept last."""
    x, w = np.column_stack([x, np.ones(len(x))]), np.ones(len(x)) if w is None else w
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (y - p)))
    return beta


def lasso(x, y, penalty):
    """Coefficients by proximal steps over standardised columns, the intercept free."""
    s = x.std(0, ddof=1)
    z = np.column_stack([x / s, np.ones(len(x))])
    beta, step = np.zeros(z.shape[1]), 4 / np.linalg.eigvalsh(z.T @ z / len(z))[-1]
    for _ in range(4000):
        beta = beta - step * z.T @ (1 / (1 + np.exp(-z @ beta)) - y) / len(y)
        beta[:-1] = np.sign(beta[:-1]) * np.maximum(np.abs(beta[:-1]) - step * penalty, 0)
    return np.append(beta[:-1] / s, beta[-1])


def score(beta, x):
    return x @ beta[:-1] + beta[-1]


def gini(s, y, w=None):
    s, y, w = np.asarray(s), np.asarray(y), np.ones(len(s)) if w is None else np.asarray(w)
    bad, good = y == 1, y == 0
    wins = ((s[bad][:, None] > s[good][None]) + (s[bad][:, None] == s[good][None]) / 2) * w[bad][:, None] * w[good][None]
    return 2 * wins.sum() / (w[bad].sum() * w[good].sum()) - 1


def gini_of(train, valid, columns):
    columns = list(columns)
    return gini(score(logit(train[columns].to_numpy(), train.y.to_numpy()), valid[columns].to_numpy()), valid.y)


def close(x):
    return pytest.approx(x, abs=2e-3)


def test_fit_and_cross_validation(rows, data):
    m = models.fit_logit(rows, ["a", "b"], "y")
    assert [*m.coefficients, m.intercept] == pytest.approx(logit(data[["a", "b"]].to_numpy(), data.y.to_numpy()), abs=1e-3)
    folds = rows.select("i", models.fold("i", 3).alias("f")).orderBy("i").toPandas().f
    want = np.mean([gini_of(data[folds != k], data[folds == k], ["a", "b"]) for k in range(3)])
    assert models.cross_validated_gini(rows, ["a", "b"], "y", "i", 3) == close(want)


def test_lasso_path(halves):
    train, valid, t, v = halves
    for (penalty, n, g) in models.lasso_path(train, valid, COLUMNS, "y", [0.0, 0.03, 0.08, 10.0]):
        beta = lasso(t[COLUMNS].to_numpy(), t.y.to_numpy(), penalty)
        assert n == (np.abs(beta[:-1]) > 1e-6).sum() and g == close(gini(score(beta, v[COLUMNS].to_numpy()), v.y))


def test_stepwise(halves):
    """The greedy choice by plain fits; a column too near to a chosen one is left out."""
    train, valid, t, v = halves
    chosen, best, corr = [], 0.0, t[COLUMNS].corr().abs()
    while True:
        able = [c for c in COLUMNS if c not in chosen and all(corr.loc[c, x] <= 0.9 for x in chosen)]
        found = max(((gini_of(t, v, sorted([*chosen, c])), c) for c in able), default=(0, ""))
        if not found[1] or found[0] < best + 0.001:
            break
        best = found[0]
        chosen.append(found[1])
    model, history = models.stepwise(train, valid, COLUMNS, "y")
    assert [c for c, _ in history] == chosen and model.columns == sorted(chosen) and [g for _, g in history][-1] == close(best)


def test_marginal_gains_and_surrogates(halves):
    train, valid, t, v = halves
    whole = gini_of(t, v, COLUMNS)
    for c, g in models.marginal_contributions(train, valid, COLUMNS, "y"):
        assert g == close(whole - gini_of(t, v, [x for x in COLUMNS if x != c]))
    for c, g in models.marginal_additions(train, valid, ["b"], ["a", "c"], "y"):
        assert g == close(gini_of(t, v, ["b", c]) - gini_of(t, v, ["b"]))
    assert [(c, o) for c, o, _ in models.surrogates(train, valid, ["a", "b"], {"a": 0, "c": 0, "b": 1}, "y")] == [("a", "c")]
    assert models.surrogates(train, valid, ["a", "b"], {"a": 0, "c": 0, "b": 1}, "y")[0][2] == close(gini_of(t, v, ["c", "b"]))


def lift(s, y, percent):
    cut = np.percentile(s, 100 - percent)
    return y[s >= cut].mean() / y.mean()


def test_marginal_lifts_and_best_model(halves):
    train, valid, t, v = halves
    of = lambda c: lift(score(logit(t[c].to_numpy(), t.y.to_numpy()), v[c].to_numpy()), v.y.to_numpy(), 20)
    base = of(["a", "b"])
    assert dict(models.marginal_lifts(train, valid, ["a", "b"], "y", 20)) == {"a": pytest.approx(base - of(["b"]), abs=0.03), "b": pytest.approx(base - of(["a"]), abs=0.03)}
    fits = [models.fit_logit(train, c, "y") for c in (["b"], ["a"], ["a", "b"])]
    assert models.best_model(valid, fits, "y", 1) == (1, close(gini_of(t, v, ["a"]))) and models.best_model(valid, fits, "y")[0] == 2


def test_bootstrap_logit(rows, data):
    draws = rows.select("i", *[(F.pmod(F.xxhash64(F.col("i"), F.lit(1), F.lit(k)), F.lit(10**9)) / 1e9).alias(f"u{k}") for k in range(2)]).orderBy("i").toPandas()
    cuts = (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)
    fits = [logit(data[["a"]].to_numpy(), data.y.to_numpy(), sum((draws[f"u{k}"] + 5e-10 > c).to_numpy().astype(float) for c in cuts)) for k in range(2)]
    m = models.bootstrap_logit(rows, ["a"], "y", "i", 2)
    assert [*m.coefficients, m.intercept] == pytest.approx(np.mean(fits, 0), abs=2e-3)


def test_clusters_of_variables(rows, data):
    """Average linkage by brute force over all pairs of groups."""
    corr, groups = data[COLUMNS].corr().abs().to_numpy(), [[0], [1], [2]]
    while len(groups) > 1:
        best = max((corr[np.ix_(x, y)].mean(), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2))
        if best[0] < 0.5:
            break
        groups[best[1]] += groups.pop(best[2])
    assert models.cluster_variables(rows, COLUMNS) == {COLUMNS[i]: k for k, g in enumerate(sorted(groups)) for i in g} == {"a": 0, "c": 0, "b": 1}


def test_boosted_as_sql(rows):
    """The text is the model's own raw score, and its columns may stand in any order."""
    model = models.fit_boosted(rows, COLUMNS, "y", 3, 3)
    from pyspark.ml.feature import VectorAssembler

    own = model.transform(VectorAssembler(inputCols=COLUMNS, outputCol="_x").transform(rows)).select("i", "rawPrediction").collect()
    got = {r["i"]: r["raw"] for r in rows.select("i", F.expr(models.tree_sql(model, COLUMNS)).alias("raw")).collect()}
    assert {r["i"]: 2 * got[r["i"]] for r in own} == pytest.approx({r["i"]: 2 * r["rawPrediction"][1] for r in own})
    assert {r["i"]: r["raw"] for r in rows.select("i", boosting.raw_score(model, COLUMNS).alias("raw")).collect()} == pytest.approx(got)


def test_scorecard(rows, data):
    """Bins, weights of evidence, the table and the score by their formulas."""
    b = binning.fit_numeric(rows, "a", "y", edges=[-0.5, 0.7])
    g = binning.fit_categorical(rows, "g", "y", 3)
    card = models.fit_scorecard(rows, [b, g], "y")
    index = np.digitize(data.a, [-0.5, 0.7])
    rate = data.y.mean()
    side = lambda p: np.log((1 - p + 0.001) / (p + 0.001))
    woes = [side(data.y[index == k].mean()) - side(rate) for k in range(3)]
    assert b.woes == pytest.approx(woes)
    of = {c: side(data.y[data.g == c].mean()) - side(rate) for c in "uvw"}
    x = np.column_stack([np.array(woes)[index], [of[c] for c in data.g]])
    beta = logit(x, data.y.to_numpy())
    assert [*card.model.coefficients, card.model.intercept] == pytest.approx(beta, abs=5e-3)
    got = rows.select("i", card.score().alias("s")).orderBy("i").toPandas().s
    exact = 1 / (1 + np.exp(-(x @ np.array(card.model.coefficients) + card.model.intercept)))
    assert got.to_numpy() == pytest.approx(exact)
    table = {(p, n): (w, part) for p, n, w, part in card.table()}
    assert table["a", "[-0.500, 0.700)"] == (pytest.approx(woes[1]), pytest.approx(woes[1] * card.model.coefficients[0])) and ("g", "NaN") in table


def test_uplift_tree(rows, data, monkeypatch):
    """Best first over all splits, by brute force."""
    least = 15

    def gain(part, cut):
        sides, ups = [part[part.few < cut], part[part.few > cut]], []
        for s in sides:
            if (s.treated == 1).sum() < least or (s.treated == 0).sum() < least:
                return 0.0
            ups.append(s.y[s.treated == 1].mean() - s.y[s.treated == 0].mean())
        return (ups[0] - ups[1]) ** 2 * len(sides[0]) * len(sides[1]) / len(part)

    leaves, edges = [data], []
    while len(leaves) < 4:
        best = max(((gain(p, (a + b) / 2), -k, -(a + b) / 2) for k, p in enumerate(leaves) for a, b in itertools.pairwise(sorted(p.few.unique()))), default=(0, 0, 0))
        if best[0] <= 0:
            break
        p = leaves.pop(-best[1])
        edges.append(-best[2])
        leaves += [p[p.few < -best[2]], p[p.few > -best[2]]]
    assert binning.fit_uplift(rows, "few", "y", "treated", 4, least) == pytest.approx(sorted(edges))
    monkeypatch.setattr(binning, "VALUES", 3)  # the same splits in Spark
    assert binning.fit_uplift(rows, "few", "y", "treated", 4, least) == pytest.approx(sorted(edges))


def test_stable_grouping(rows, data):
    """Of the trees with 2 to 4 leaves the largest whose bins keep their ranks in every month."""
    edges = binning.tree_edges(binning.value_table(rows, "few", "y"), 4, 20)

    def steady(n):
        index = np.digitize(data.few, sorted(edges[: n - 1]))
        ranks = {}
        for m in sorted(data.month.unique()):
            rates = {k: data.y[(index == k) & (data.month == m)].mean() for k in set(index)}
            for k, r in rates.items():
                ranks.setdefault(k, []).append(sum(o > r for o in set(rates.values())))
        return all(len(set(r)) == 1 for r in ranks.values())

    want = max([2, *[n for n in range(2, 5) if steady(n)]])
    assert binning.fit_stable(rows, "few", "y", "month", 4, 20).edges == sorted(edges[: want - 1])


def poisson(rows, key, replicates, seed):
    u = rows.select("i", *[((F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(k)), F.lit(10**9)) + 0.5) / 1e9).alias(f"u{k}") for k in range(replicates)]).orderBy("i").toPandas()
    cuts, total, term = [], 0.0, np.exp(-1)
    for k in range(12):
        total += term
        cuts.append(total)
        term /= k + 1
    return [sum((u[f"u{k}"] > c).to_numpy().astype(int) for c in cuts) for k in range(replicates)]


def test_bootstrap_gini_and_impact(rows, data):
    draws = poisson(rows, "i", 4, 1)
    ginis = [gini(data.few[w > 0], data.y[w > 0], w[w > 0]) for w in draws]
    got = metrics.bootstrap_gini(rows, "few", "y", "i", 4).first()
    assert (got["mean"], got["std"], got["p5"], got["p95"]) == pytest.approx((np.mean(ginis), np.std(ginis, ddof=1), np.percentile(ginis, 5), np.percentile(ginis, 95)))
    for r in collections.bootstrap_impact(rows, "month", "value", "treated", "i", 4).collect():
        gains = []
        for w in draws:
            of = lambda v: np.average(data.value[(data.month == r["bin"]) & (data.treated == v)], weights=w[(data.month == r["bin"]) & (data.treated == v)])  # noqa: B023, E731
            gains.append(of(1) - of(0))
        assert (r["mean"], r["p5"], r["p95"]) == pytest.approx((np.mean(gains), np.percentile(gains, 5), np.percentile(gains, 95)))


def test_bootstrap_gini_hashes_a_row_once_a_replicate(rows, data, monkeypatch):
    plan = metrics.bootstrap_gini(rows, "few", "y", "i", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("xxhash64(") <= 4 * plan.count("Scan ")
    whole = metrics.bootstrap_gini(rows, "few", "y", "i", 7).first()
    monkeypatch.setattr(metrics, "REPLICATES", 3)  # some rows of sums are not full
    assert tuple(metrics.bootstrap_gini(rows, "few", "y", "i", 7).first()) == pytest.approx(tuple(whole))
    ginis = [gini(data.few[w > 0], data.y[w > 0], w[w > 0]) for w in poisson(rows, "i", 7, 1)]
    assert whole["mean"] == pytest.approx(np.mean(ginis))


def test_steps_fit_each_set_once_on_folded_rows(rows, monkeypatch):
    """Weighted rows give the fits, Ginis and correlations of the rows they stand for; all Ginis of a step are one pass."""
    twice = rows.unionByName(rows).unionByName(rows.where("i % 3 = 0"))
    fine = models.folded(twice, COLUMNS, "y")
    assert fine.count() < twice.count() and fine.agg(F.sum("_n")).first()[0] == twice.count()
    assert models.correlation_matrix(fine, COLUMNS, weight="_n") == pytest.approx(models.correlation_matrix(twice, COLUMNS), abs=1e-12)
    plain = models.fit_logit(twice, COLUMNS, "y")
    assert models.fit_logit(fine, COLUMNS, "y", "_n").coefficients == pytest.approx(plain.coefficients, abs=1e-4)
    assert models.ginis_of(fine, [plain, models.Logit(["a"], [1.0], 0.0)], "y", "_n") == pytest.approx([models.gini_of(twice, plain, "y"), models.gini_of(twice, models.Logit(["a"], [1.0], 0.0), "y")])
    fits, real = [], models.fit_logit
    monkeypatch.setattr(models, "fit_logit", lambda *a, **k: fits.append(tuple(a[1])) or real(*a, **k))
    models.stepwise(twice, twice, COLUMNS[:2], "y", least_gain=-1.0)
    assert len(fits) == len(set(fits)) == 3


def test_trajectories(rows, data):
    """Each path takes one group a month by the least hash; the mean of the means so far."""
    means = data.groupby(["month", "g"]).value.mean()
    hashes = rows.select("month", "g").distinct().withColumn("path", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("h", F.xxhash64("g", "path", F.lit(1), F.col("month").cast("string"))).collect()
    for path in (0, 1):
        picked = [means[m, min((r["h"], r["g"]) for r in hashes if r["path"] == path and r["month"] == m)[1]] for m in range(3)]
        got = collections.trajectories(rows, "month", "g", "value", 2).where(f"path = {path}").orderBy("month").collect()
        assert [r["mean_so_far"] for r in got] == pytest.approx([np.mean(picked[: k + 1]) for k in range(3)])


def test_quantile_imputer_and_discrete(rows, data):
    """The nearest bin's mean, plain and with rates made to rise."""
    gap = rows.withColumn("s", F.when(F.col("i") % 5 > 0, F.col("a")))
    known, missing = data[data.i % 5 > 0], data[data.i % 5 == 0].y.mean()
    index = np.digitize(known.a, np.percentile(known.a, [20, 40, 60, 80]))
    rates = [known.y[index == k].mean() for k in range(5)]
    nearest = min(range(5), key=lambda k: (abs(rates[k] - missing), k))
    assert imputation.discrete(gap, "s", "y", 5) == pytest.approx(known.a[index == nearest].mean())
    rising = imputation.isotonic([(rates[k], int((index == k).sum())) for k in range(5)])
    nearest = min(range(5), key=lambda k: (abs(rising[k] - missing), k))
    assert imputation.quantile_imputer(gap, "s", "y", 5) == pytest.approx(known.a[index == nearest].mean())


def test_grouping_of_all_predictors(rows):
    """One fit of several is the fits of each, through its saved form; groups are what edges and lists say."""
    every = binning.load(binning.save(binning.fit(rows, ["a", "few"], ["g"], "y", groups=3)))
    assert every == [binning.fit_numeric(rows, "a", "y", 3), binning.fit_numeric(rows, "few", "y", 3), binning.fit_categorical(rows, "g", "y", 3)]
    for r in binning.transform(rows, every, "group_number").collect():
        assert r["a_GRP"] == np.digitize(r["a"], every[0].edges) and r["few_GRP"] == np.digitize(r["few"], every[1].edges) and r["g"] in every[2].groups[r["g_GRP"]]
    empty = binning.Bins("g", groups=[], nan_woe=0.5, unknown_woe=0.25)
    assert {r[0] for r in rows.select(empty.woe()).collect()} == {0.25} and {r[0] for r in rows.select(empty.index()).collect()} == {0}


@pytest.mark.parametrize("ranges", [2, 64, 65, 300])
def test_running_sums_over_any_number_of_ranges(rows, data, ranges):
    """Ranges are found in one step or two; sums by group and over all are the plain ones."""
    t = rows.select("month", "a", "value")
    got = {r["a"]: r for r in cumulative.running(t, (), "a", ("value",), ranges).collect()}
    want = data.sort_values("a").value.cumsum()
    assert {a: r["cum_value"] for a, r in got.items()} == pytest.approx(dict(zip(data.a[want.index], want, strict=True)))
    by = {r["a"]: r["cum_value"] for r in cumulative.running(t, ("month",), "a", ("value",), ranges).collect()}
    want = data.sort_values("a").groupby("month").value.cumsum()
    assert by == pytest.approx(dict(zip(data.a[want.index], want, strict=True)))


def test_uplift_curve_of_tied_scores(rows, data):
    """Nearly all rows share one score: places inside it follow the key."""
    tied = rows.withColumn("s", F.when(F.col("i") % 50 == 0, F.col("few")).otherwise(5.0))
    order = data.assign(s=np.where(data.i % 50 == 0, data.few, 5.0)).sort_values(["s", "i"], ascending=[False, True]).reset_index(drop=True)
    bins = (np.arange(len(order)) * 10 // len(order)).astype(int)
    for r in metrics.uplift_curve(tied, "s", "y", "treated", "i").collect():
        own, seen = order[bins == r["bin"]], order[bins <= r["bin"]]
        assert r["uplift"] == pytest.approx(own.y[own.treated == 1].mean() - own.y[own.treated == 0].mean())
        assert r["cum_uplift"] == pytest.approx(seen.y[seen.treated == 1].mean() - seen.y[seen.treated == 0].mean())


@pytest.mark.parametrize("most", [200_000, 0])
def test_rank_correlation(rows, data, monkeypatch, most):
    """Ranks sent to every task or joined; ties share; a null leaves its pair out."""
    monkeypatch.setattr(reports, "RANKS", most)
    gap = rows.withColumn("b", F.when(F.col("i") % 7 > 0, F.col("b")))
    pandas = data.assign(b=data.b.where(data.i % 7 > 0))
    ranks = pandas[["a", "b", "few"]].rank()
    for r in reports.correlation(gap, ["a", "b", "few"]).collect():
        both = ranks[[r["a"], r["b"]]].dropna()
        assert r["rho"] == pytest.approx(np.corrcoef(both.T)[0, 1])


def test_performance_by_groups_with_nulls(rows, data):
    """One level table for all measures; a null group and a score with gaps."""
    marked = rows.withColumns({"m": F.when(F.col("month") > 0, F.col("month")), "s": F.when(F.col("i") % 4 > 0, F.col("few"))})
    got = {(r["m"], r["score"]): r for r in reports.performance(marked, ["a", "s"], "y", ("m",), 20).collect()}
    assert set(got) == {(m, s) for m in (None, 1, 2) for s in ("a", "s")}
    for (m, s), r in got.items():
        own = data[data.month == (m or 0)]
        own = own[own.i % 4 > 0].assign(s=own.few) if s == "s" else own
        assert r["gini"] == pytest.approx(gini(own[s], own.y)) and r["lift"] == pytest.approx(lift(own[s].to_numpy(), own.y.to_numpy(), 20)) and r["n"] == len(own)


def test_psi_in_time(rows, data):
    got = {r["month"]: r["psi"] for r in metrics.psi_in_time(rows, "value", "month", 1, 5).collect()}
    _, edges = np.histogram(data.value[data.month == 1], 5)
    share = lambda m: np.maximum(np.histogram(data.value[data.month == m], edges)[0] / np.histogram(data.value[data.month == m], edges)[0].sum(), 1e-4)
    assert got == pytest.approx({m: ((share(m) - share(1)) * np.log(share(m) / share(1))).sum() for m in (0, 1, 2)})
