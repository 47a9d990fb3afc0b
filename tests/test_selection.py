"""Neighbour weights, attributions, selection, target matrices, resamples, declared aggregates, tests of distributions."""

import math
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import aggregates
from riskloom.operators import boosting, comparison, interactions, metrics, models, neighbours, sampling

NAN, INF = float("nan"), float("inf")


def weights(source, target, k, normalize):
    """Brute force: targets within the k-th distance of each source row."""
    fine = lambda r: all(v is not None and np.isfinite(v) for v in r)
    x, y = np.array([r for r in source if fine(r)], float), np.array([r for r in target if fine(r)], float).reshape(-1, len(source[0]))
    if normalize:
        mean, std = x.mean(0), x.std(0)
        std[std == 0] = 1
        x, y = (x - mean) / std, (y - mean) / std
    out, at = [], 0
    for r in source:
        if not fine(r) or len(x) < k:
            out.append(None)
            continue
        d = np.sort(((x - x[at]) ** 2).sum(1))[k - 1]
        out.append(int((((y - x[at]) ** 2).sum(1) <= d).sum()))
        at += 1
    return out


def plain(v):
    return None if v is None else float(v)


def frames(spark, source, target):
    one = spark.createDataFrame([(i, *map(plain, r), 1.0) for i, r in enumerate(source)], "i int, a double, b double, v double").repartition(3)
    return one, spark.createDataFrame([tuple(map(plain, r)) for r in target], "a double, b double").repartition(2)


@pytest.mark.parametrize(("small", "normalize", "ks"), [(False, True, (7,)), (True, False, (1, 100)), (True, True, (7,))])
def test_radius_weights(spark, monkeypatch, small, normalize, ks):
    """Ties, nulls, a hot group of equal rows, and blocks that cut a cell."""
    if small:
        for name, value in (("CELL", 20), ("BLOCK", 16), ("HELD", 500)):
            monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(4)
    grid = r.integers(0, 8, (150, 2)).astype(float) if not normalize else r.normal(0, 3, (150, 2))
    source = [tuple(x) for x in grid] + [(3.0, 3.0)] * 90 + [(None, 1.0), (1.0, NAN), (INF, 0.0)]
    target = [tuple(x) for x in (r.integers(-1, 10, (120, 2)).astype(float) if not normalize else r.normal(1, 3, (120, 2)))] + [(3.0, 3.0)] * 40 + [(None, None)]
    one, other = frames(spark, source, target)
    for k in ks:
        got = {x["i"]: x["weight"] for x in neighbours.radius_weights(one, other, ["a", "b"], k, normalize).collect()}
        assert [got[i] for i in range(len(source))] == weights(source, target, k, normalize)


def test_radius_weights_of_little(spark):
    one, other = frames(spark, [(1.0, 2.0), (2.0, 2.0)], [(1.0, 2.0)])
    assert {r["weight"] for r in neighbours.radius_weights(one, other, ["a", "b"], 3).collect()} == {None}
    assert {r["weight"] for r in neighbours.radius_weights(one, other.limit(0), ["a", "b"], 1).collect()} == {0}
    assert not neighbours.radius_weights(one.limit(0), other, ["a", "b"], 1).count()
    plan = neighbours.radius_weights(one, other, ["a", "b"], 1)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.fixture(scope="module")
def risky(spark):
    r = np.random.default_rng(11)
    rows = []
    for i in range(1200):
        a, b, c = r.normal(), r.normal(), r.normal()
        y = int(r.random() < 1 / (1 + np.exp(-(1.5 * a - b))))
        rows.append((i, float(a) if i % 17 else None, float(b), float(c), y, int(r.random() < 0.3), 1, int(i % 4 > 0), "xyz"[i % 7 % 3]))
    return spark.createDataFrame(rows, "i long, a double, b double, c double, y int, z int, base int, half int, kind string").cache()


def expectation(node, x, known):
    """A tree's value where only some columns are known."""
    if node.numDescendants() == 0:
        return float(node.prediction())
    split, left, right = node.split(), node.leftChild(), node.rightChild()
    if split.featureIndex() in known:
        return expectation(left if x[split.featureIndex()] <= split.threshold() else right, x, known)
    n = [float(c.impurityStats().count()) for c in (left, right)]
    return (n[0] * expectation(left, x, known) + n[1] * expectation(right, x, known)) / sum(n)


def shapley(model, x):
    """By the definition, over all subsets of the columns."""
    def value(known):
        return sum(float(w) * expectation(t._call_java("rootNode"), x, known) for t, w in zip(model.trees, model.treeWeights, strict=True))

    m = len(x)
    out = []
    for j in range(m):
        rest = [i for i in range(m) if i != j]
        out.append(sum(factorial(n) * factorial(m - n - 1) / factorial(m) * (value({*s, j}) - value(set(s))) for n in range(m) for s in combinations(rest, n)))
    return [*out, value(set())]


def test_attributions(risky):
    columns = ["a", "b", "c"]
    model = boosting.fit(risky, columns, "y", 3, 4)
    few = risky.orderBy("i").limit(20)
    got = few.select("i", *columns, boosting.attributions(model, columns).alias("parts"), boosting.raw_score(model, columns).alias("raw")).orderBy("i").collect()
    for r in got:
        x = [NAN if r[c] is None else r[c] for c in columns]
        assert r["parts"] == pytest.approx(shapley(model, x), abs=1e-9)
        assert sum(r["parts"]) == pytest.approx(r["raw"], abs=1e-9)
    ranked = boosting.importances(risky, model, columns)
    sums = np.abs([r["parts"][:3] for r in risky.select(boosting.attributions(model, columns).alias("parts")).collect()]).sum(0)
    assert dict(ranked) == pytest.approx(dict(zip(columns, sums, strict=True))) and ranked[0][0] == "a" and ranked[-1][0] == "c"
    assert risky.limit(0).select(boosting.attributions(model, columns)).count() == 0


def auc(score, y):
    good, bad = [s for s, t in zip(score, y, strict=True) if not t], [s for s, t in zip(score, y, strict=True) if t]
    return sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))


def test_selection(risky):
    """Columns come by importance; the AUC of a set is the plain one of its fits; a set is fitted once; it stops."""
    tool = boosting.Selection(risky, "y", "i", {"test": "i % 5 = 0"}, folds=2, trees=4, depth=2, every=2)
    steps = tool.run([("c", 1.0), ("a", 9.0), ("b", 5.0)])
    assert [s.columns for s in steps] == [["a"], ["a", "b"], ["a", "b", "c"]]
    assert steps[1].cv_auc > steps[0].cv_auc + 0.02 and set(steps[0].aucs) == {"test"}
    first, train = steps[0], risky.where("i % 5 <> 0").withColumn("f", models.fold("i", 2))
    found = []
    for k in range(2):
        model = boosting.fit(train.where(f"f <> {k}"), ["a"], "y", 4, 2)
        rows = train.where(f"f = {k}").select("y", boosting.raw_score(model, ["a"], first.trees).alias("s")).collect()
        found.append(auc([r["s"] for r in rows], [r["y"] for r in rows]))
    assert first.cv_auc == pytest.approx(np.mean(found))
    model = boosting.fit(train.drop("f"), ["a"], "y", first.trees, 2)
    rows = risky.where("i % 5 = 0").select("y", boosting.raw_score(model, ["a"]).alias("s")).collect()
    assert first.aucs["test"] == pytest.approx(auc([r["s"] for r in rows], [r["y"] for r in rows]))
    assert tool.measure(["b", "a"]) is steps[1]
    stopped = tool.run([("c", 9.0), ("a", 5.0), ("b", 1.0)], base=["a", "b"], least_gain=0.5)
    assert [s.columns for s in stopped] == [["a", "b", "c"]]
    assert len(tool.run([("a", 2.0), ("b", 1.0), ("c", 0.5)], least_gain=0.5)) == 2


def test_target_matrix(risky):
    """Every model on every target; a base leaves rows out; numbers by hand."""
    part = lambda k: risky.where(F.col("i") % 3 == k)
    m = boosting.target_matrix(part(0), part(1), part(2), [("y", "base"), ("z", "half")], ["a", "b"], ["kind"], trees=3, depth=2, least=1)
    got = {(r["trained"], r["measured"]): r["gini"] for r in m.collect()}
    assert set(got) == {(a, b) for a in "yz" for b in "yz"} and got["y", "y"] > 0.3 > abs(got["y", "z"])
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan
    both = part(0).withColumn("v", F.lit(False)).unionByName(part(1).withColumn("v", F.lit(True)))
    model = boosting.fit(both.withColumn("y", F.col("y").cast("double")), ["a", "b"], "y", 3, 2, valid="v")
    numeric = boosting.target_matrix(part(0), part(1), part(2), [("y", "base"), ("z", "half")], ["a", "b"], trees=3, depth=2)
    numeric = {(r["trained"], r["measured"]): r["gini"] for r in numeric.collect()}
    for target, base in (("y", "base"), ("z", "half")):
        rows = part(2).where(f"{base} = 1").select(target, boosting.raw_score(model, ["a", "b"]).alias("s")).collect()
        assert numeric["y", target] == pytest.approx(2 * auc([r["s"] for r in rows], [r[target] for r in rows]) - 1)


def test_resample(spark, monkeypatch):
    """Exactly n draws, each row as likely; equal rows fold; reruns and other partitionings agree; ranges go down two levels."""
    rows = [(i, "x") for i in range(600)] + [(None, "y")] * 300
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r["i"]: r["draws"] for r in sampling.resample(df, 5).collect()}
    assert sum(got.values()) == 900 and len(got) == 601 and got == {r["i"]: r["draws"] for r in sampling.resample(df.repartition(7), 5).collect()}
    assert 250 < got[None] < 350 and 0.3 < sum(v == 0 for k, v in got.items() if k is not None) / 600 < 0.44
    monkeypatch.setattr(sampling, "FAN", 4)
    monkeypatch.setattr(sampling, "PART", 50)
    total = np.zeros(600)
    for seed in range(6):
        deep = {r["i"]: r["draws"] for r in sampling.resample(df, seed).collect()}
        assert sum(deep.values()) == 900
        total += [deep[i] for i in range(600)]
    assert abs(total.mean() - 6) < 0.4 and 4 < total.var() < 8.5  # of a Poisson-like sum of six
    assert sampling.resample(df, 1, 10).agg(F.sum("draws")).first()[0] == 10
    assert not sampling.resample(df.limit(0), 1).count()


def test_declared_aggregates(spark):
    registry = aggregates.Registry()
    root = aggregates.Declared({"s": lambda c: F.sum(c * c), "n": F.count}, {"s": F.sum, "n": F.sum}, lambda v: F.sqrt(v["s"] / v["n"]))
    registry.add("root_mean_square", root)
    df = spark.createDataFrame([("a", 3.0, 1), ("a", 4.0, 2), (None, 5.0, 3), (None, None, 4), ("b", None, 5)] + [("hot", 2.0, k) for k in range(200)], "g string, v double, t int")
    made = {"rms": ("root_mean_square", "v"), "top": ("max", "v"), "end": ("last", "v")}
    got = {r["g"]: (r["rms"], r["top"], r["end"]) for r in registry.group(df, ["g"], made, order=F.col("t")).collect()}
    assert got == {"a": (pytest.approx(12.5**0.5), 4.0, 4.0), None: (5.0, 5.0, 5.0), "b": (None, None, None), "hot": (2.0, 2.0, 2.0)}
    assert registry.group(df, [], {"rms": ("root_mean_square", "v"), "n": ("count", "v")}).first()["n"] == 203
    assert registry.group(df.limit(0), ["g"], made, order=F.col("t")).count() == 0
    registry.prove(df, "v", "root_mean_square")
    registry.add("wrong", aggregates.Declared({"m": F.avg}, {"m": F.avg}, lambda v: v["m"]))  # means of parts are no mean
    with pytest.raises(ValueError, match="over one"):
        registry.prove(spark.range(50).select((F.col("id") * F.col("id")).alias("v")), "v", "wrong")
    for name, bad in (("max", root), ("no name", root), ("root_mean_square", root), ("x", aggregates.Declared({"a": F.sum}, {"b": F.sum}, lambda v: v["a"]))):
        with pytest.raises(ValueError, match="taken|different"):
            registry.add(name, bad)
    with pytest.raises(TypeError):
        registry.add("text", aggregates.Declared({"a": F.sum}, {"a": F.sum}, lambda v: "eval(v)"))


def test_same_distribution(spark):
    """Statistic and tail by hand; rows outside the first range, thin cells, and samples of nothing."""
    one, other = [float(i % 10) for i in range(200)], [float(i % 7) for i in range(150)] + [99.0] * 10
    frame = lambda v: spark.createDataFrame([(x,) for x in [*v, None, NAN]], "v double")
    got = metrics.same_distribution(frame(one), frame(other), "v", 5).first()
    a, edges = np.histogram(one, 5)
    b, _ = np.histogram(other, edges)
    n, m = len(one), len(other)
    statistic = (((n / m) ** 0.5 * b - (m / n) ** 0.5 * a) ** 2 / (a + b)).sum()
    assert (got["statistic"], got["df"]) == (pytest.approx(statistic), 4)
    assert got["p_value"] == pytest.approx(np.exp(-statistic / 2) * (1 + statistic / 2))
    assert metrics.same_distribution(frame(one), frame(one), "v").first()["p_value"] == pytest.approx(1.0)
    assert metrics.same_distribution(frame(one), frame(other), "v", 5, least=100).first()["df"] == 1  # 83 + 83, 83 + 61 + 40
    assert tuple(metrics.same_distribution(frame(one), frame([]), "v").first()) == (None, None, None)
    assert metrics.same_distribution(frame([1.0]), frame([1.0]), "v").first()["df"] is None


def test_comparison(spark):
    """Two scores over overlapping samples and segments, with ties, nulls in score, target and segment: by hand."""
    r = np.random.default_rng(8)
    data = [(int(r.integers(0, 3)), None if i % 11 == 0 else float(r.integers(0, 9)), float(r.normal()), None if i % 13 == 0 else int(r.random() < 0.4), i) for i in range(300)]
    data = [(None if s == 2 else "ab"[s], *rest) for s, *rest in data]
    df = spark.createDataFrame(data, "seg string, s1 double, s2 double, y int, i int")
    made = comparison.compare(df, ["s1", "s2"], "y", "seg", {"even": "i % 2 = 0", "low": "i < 200"})
    got = {(x["sample"], x["segment"], x["score"]): x for x in made.table((10, 30)).collect()}
    assert len(got) == 2 * 4 * 2
    for (sample, segment, score), x in got.items():
        rows = [d for d in data if (d[4] % 2 == 0 if sample == "even" else d[4] < 200) and segment in ("All", d[0] or "null")]
        at = 1 if score == "s1" else 2
        known = [(d[at], d[3]) for d in rows if d[at] is not None]
        both = [(v, y) for v, y in known if y is not None]
        assert (x["n"], x["measurable"], x["bads"], x["hits"]) == (len(rows), sum(d[3] is not None for d in rows), sum(d[3] or 0 for d in rows), len(known))
        assert x["mean_score"] == pytest.approx(np.mean([v for v, _ in both])) and x["gini"] == pytest.approx(2 * auc(*zip(*both, strict=True)) - 1)
        for p in (10, 30):
            cut = np.percentile([v for v, _ in known], 100 - p)
            assert x[f"lift_{p}"] == pytest.approx(np.mean([y for v, y in both if v >= cut]) / np.mean([y for _, y in both]))
        best = max(abs(np.mean([v <= c for v, y in both if y]) - np.mean([v <= c for v, y in both if not y])) for c in {v for v, _ in both})
        assert x["ks"] == pytest.approx(best)
    points = made.roc().where("sample = 'low' AND segment = 'All' AND score = 's1'").collect()
    both = [(d[1], d[3]) for d in data if d[4] < 200 and d[1] is not None and d[3] is not None]
    for x in points:
        assert x["tpr"] == pytest.approx(np.mean([v >= x["value"] for v, y in both if y])) and x["fpr"] == pytest.approx(np.mean([v >= x["value"] for v, y in both if not y]))
    assert made.lifts((10, 20)).count() == 32 and {x["place"] for x in comparison.steady_order(made).collect()} == {1, 2}
    whole = comparison.compare(df, ["s1"], "y").table().collect()
    assert [(x["sample"], x["segment"], x["n"]) for x in whole] == [("All", "All", 300)]
    assert not comparison.compare(df.limit(0), ["s1"], "y").table().count()
    one_class = comparison.compare(df.where("y = 1"), ["s1"], "y").table().first()
    assert one_class["gini"] is None and one_class["ks"] is None and one_class["lift_10"] == 1.0
    for bad in (lambda: comparison.compare(df, ["s1", "s1"], "y"), lambda: comparison.compare(df.withColumn("seg", F.lit("All")), ["s1"], "y", "seg")):
        with pytest.raises(ValueError, match="repeat|named"):
            bad()


def test_interaction_test(spark):
    """The p-value against a plain fit and a tail summed numerically; the least value is in no bin; cells that are too few."""
    r = np.random.default_rng(3)
    x, m = r.normal(size=900), r.normal(size=900)
    y = (r.random(900) < 1 / (1 + np.exp(-x * (m > 0)))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, m, y, strict=True)] + [(None, 1.0, 1), (1.0, None, 0)], "x double, m double, y int")
    p, share = interactions.interaction_test(df, "x", "m", "y", 5)
    edges, above = np.unique(np.percentile(x, np.arange(0, 100.001, 20))), m > m.mean()
    cells = [(x[k].mean(), s, y[k].mean()) for i in range(len(edges) - 1) for s in (False, True) if (k := (x > edges[i]) & (x <= edges[i + 1]) & (above == s)).any()]
    design = np.array([(1, a, b, a * b) for a, b, _ in cells], float)
    out = np.array([c for *_, c in cells])
    slope, rest = np.linalg.lstsq(design, out, rcond=None)[:2]
    df_ = len(cells) - 4
    t = slope[3] / np.sqrt(rest[0] / df_ * np.linalg.inv(design.T @ design)[3, 3])
    grid = np.linspace(abs(t), 400, 2_000_001)
    density = (1 + grid**2 / df_) ** (-(df_ + 1) / 2)
    scale = float(np.exp(math.lgamma((df_ + 1) / 2) - math.lgamma(df_ / 2)) / np.sqrt(df_ * np.pi))
    assert p == pytest.approx(2 * scale * float(((density[1:] + density[:-1]) / 2).sum() * (grid[1] - grid[0])), rel=1e-3, abs=1e-9) and p < 0.05
    assert share == pytest.approx(max(above.mean(), 1 - above.mean()))
    assert interactions.student_tails(2.0, 1) == pytest.approx(0.2951672, abs=1e-6) and interactions.student_tails(2.0, 4) == pytest.approx(0.1161165, abs=1e-6)
    table = interactions.interaction_potential(df, ["x", "m"], "y", 5).first()
    assert table["p_val_x1"] == pytest.approx(p) and table["obs_cnt"] == 900 and table["p_val_min"] == min(table["p_val_x1"], table["p_val_x2"])
    assert interactions.interaction_test(df.where("x > 2.5"), "x", "m", "y", 2)[0] is None and interactions.interaction_test(df.limit(0), "x", "m", "y") == (None, None)
    tied = spark.createDataFrame([(float(k % 3), 1.0 * (k % 2), k % 2) for k in range(60)], "x double, m double, y int")
    assert sorted(r["bin"] for r in interactions.potential(tied, "x", "m", "y", 2).collect()) == [0, 1]


def test_boosted_fits_read_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(models, "PART", 100)
    rows = spark.range(1000).coalesce(1).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 7 > 2).cast("int").alias("y"))
    sizes = [r["n"] for r in models.in_parts(rows).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 110
    assert models.in_parts(rows.limit(100)).rdd.getNumPartitions() == 1
    seen = []
    monkeypatch.setattr(models, "in_parts", lambda df: seen.append(df) or df)
    monkeypatch.setattr(boosting, "in_parts", lambda df: seen.append(df) or df)
    models.fit_boosted(rows, ["a"], "y", 1, 1)
    boosting.fit(rows, ["a"], "y", 1, 1)
    assert len(seen) == 2


def test_comparison_folds_rows_before_they_go_to_samples(spark, monkeypatch):
    df = spark.range(200).select((F.col("id") % 5).cast("double").alias("s"), (F.col("id") % 2).cast("int").alias("y"), "id")
    plans, real = [], comparison.Scratch.put
    monkeypatch.setattr(comparison.Scratch, "put", lambda self, d, n: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or real(self, d, n))
    got = comparison.compare(df, ["s"], "y", None, {"all": "true", "low": "id < 100"})
    assert plans[0].split("Aggregate")[-1].count("Generate") == 1  # scores only
    assert {r["sample"]: r["n"] for r in got.sizes.collect()} == {"all": 200, "low": 100}


def test_resample_folds_once(spark):
    df = spark.range(500).select((F.col("id") % 400).alias("i"))
    plan = sampling.resample(df, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan and "folded" not in sampling.resample(df, 5).columns
    assert sampling.resample(df, 5).columns == ["i", "draws"]
