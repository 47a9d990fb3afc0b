"""Nearest neighbours, toxicity, wrappers and the pipeline."""

import itertools
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ann, mixing, pii, toxicity, wrappers


def brute(rows, k=5):
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in use if i % 5 == 0}:
        best = {}  # an id counts once, with the best score over its vectors and the query's
        for v in [v for i, v in use if i == q]:
            for i, x in use:
                if i != q:
                    best[i] = max(best.get(i, -2.0), float((x * v).sum() / (np.sqrt((x * x).sum()) * np.sqrt((v * v).sum()))))
        out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def test_ann_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(120, 160)] + [(160, None), (161, [0.0] * 8), (162, [float("nan")] * 8), (163, [1.0, None] + [1.0] * 6), (164, [1.0]), (None, rows[0][1]), (165, [float("inf")] * 8)]
    rows += [(7, rows[7][1])] * 6 + [(8, rows[9][1]), (50, rows[11][1]), (50, rows[50][1])]  # repeated rows, ids with two vectors
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, id int")
    got = ann.nearest(df, df.where("vec_id % 5 = 0")).orderBy("query_id", "rank").collect()
    want = brute(rows)
    assert {r["query_id"] for r in got} == set(want)
    for q, near in want.items():
        mine = [(r["vec_id"], r["score"]) for r in got if r["query_id"] == q]
        assert [i for i, _ in mine] == [i for i, _ in near] and [s for _, s in mine] == pytest.approx([s for _, s in near])
    empty = df.limit(0)
    assert ann.nearest(empty, empty).count() == 0
    few = df.where("vec_id < 3")
    assert ann.nearest(few, few).count() == 6


def test_ann_repeated_ids_leave_room(spark):
    """Copies of one row are one candidate: the query still gets its k nearest ids."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=8)
    near = [(7, base + 0.01)] * 6 + [(i, base + 0.02 * i) for i in (8, 9)] + [(i, base + rng.normal(size=8)) for i in range(100, 105)] + [(50, base)]
    df = spark.createDataFrame([(i, np.asarray(v, np.float32).tolist()) for i, v in near], "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id = 50")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and len({r["vec_id"] for r in got}) == 5 and got[0]["vec_id"] == 7


def recall_of(spark, df):
    got = ann.nearest(df, df.where("vec_id % 50 = 0")).collect()
    rows = df.where("embedding IS NOT NULL").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    hit, queries = 0, ids[ids % 50 == 0]
    for q in queries:
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        near = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        assert all(s[ids == i][0] == pytest.approx(c) for i, c in near.items())
        hit += sum(c >= np.sort(s)[-5] - 1e-9 for c in near.values())
    return hit / (5 * len(queries))


def test_ann_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 300)  # cells in several blocks
    assert recall_of(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")) >= 0.9


def test_ann_looks_at_few_rows_where_vectors_have_structure(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    x = (centres[rng.integers(0, 60, 6000)] + 0.35 * rng.normal(size=(6000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert ann.needed(ann.grow(unit.astype(float)), unit.astype(float), 5) < 0.25
    assert recall_of(spark, df) >= 0.9


def test_toxicity_held_out(spark, docs, nothing):
    d = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.judge(table, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) >= 0.9
    plain = toxicity.judge(docs, labels.limit(0)).collect()
    assert len(plain) == docs.count() and {r["score"] for r in plain} == {0.5}
    assert toxicity.judge(nothing, labels).count() == 0
    kept = toxicity.reject(table, labels)
    assert kept.columns == table.columns and 0.7 * table.count() < kept.count() < table.count()


def page(i, extra=""):
    body = "".join(f"<p>para {i} {k} some words &eacute; here   and\n there</p>" for k in range(6 + i % 3))
    return f"""<html><head><title>x{i}</title></head><body><div id=top class="site-header"><a href=/>Home</a></div><div class="menu"><ul><li><a>A<li><a>B</ul></div>
<div class="content-{i}"><h1>Title {i}</h1><div class="ad">buy now</div>{body}{extra}<p>All rights to you, reader of this site</p></div><div class="sidebar"><p>side {i}</p></div>
<div class="comments"><article class="comment"><p>great {i}</p></article></div><form><input><p>subscribe</p></form><footer>f {i}</footer></body></html>"""


def text_of(i, extra=""):
    return f"Title {i} " + " ".join(f"para {i} {k} some words é here and there" for k in range(6 + i % 3)) + extra


def test_wrappers_of_one_host(spark):
    rows = [(i, f"https://h.example.org/{i}", page(i), "w") for i in range(12)]
    rows += [(20, "https://alone.example.org/", "<article><h1>A</h1><p>b<b>c</b> &amp; d<script>x()</script><nav>n</nav></article><p>not this"), (21, None, None), (22, "::bad", ""), (23, "https://h.example.org/x", "just text < 5 & more")]
    df = spark.createDataFrame([(*r[:3], "w") for r in rows], "page_id long, url string, html string, wrapper string")
    got = {r["page_id"]: r for r in wrappers.main_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i]["text"] == text_of(i) and got[i]["n_chars"] == len(text_of(i))
    assert got[20]["text"] == "A bc & d" and got[21]["text"] == "" and got[22]["text"] == "" and got[23]["text"] == "just text < 5 & more"
    assert wrappers.main_text(df.limit(0)).count() == 0


def test_inference_folds_and_aligns():
    assert wrappers.fold(["p", "", "/p", "p", "", "/p", "h1"]) == [("+", "p", "", "/p"), "h1"]
    merged = wrappers.align([("a", False), ("b", False), ("c", False)], ["a", "c", "d"])
    assert merged == [("a", False), ("b", True), ("c", False), ("d", True)]
    same = [wrappers.outline(page(1)) for _ in range(5)]  # copies: nothing varies, so nothing is template
    assert wrappers.infer(same)["template"] == [] and wrappers.extract(page(1), wrappers.infer(same)).startswith("Title 1 para 1 0")


def test_wrapper_of_all_pages_of_a_host(spark):
    """Each page keeps its article in an element of its own name: all of them are found, whatever the order of the pages."""
    names = ["x" + a + b for a in "abcdef" for b in "uvwxyz"]
    rows = [(i, "https://h.example.org/", "h.example.org", page(i).replace(f"content-{i}", f"content-{n}")) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, html string")
    one, two = (wrappers.infer_wrappers(x).collect() for x in (df, df.orderBy(F.desc("page_id")).repartition(5)))
    assert one == two and len(one) == 1
    found = json.loads(one[0]["wrapper"])
    assert found["articles"] == [f"/html/body/div.content.{n}" for n in names]
    assert {f"div.content.{n}" for n in names} <= set(wrappers._frozen(found["tokens"]))


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_pipeline_against_plain_python(spark, tmp_path):
    """run() on the smallest tables: every stage's result from its input, by plain Python but for the fitted scores."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "personal data", "mixing", "packing"]
    stages = [table]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, stages[-1], d).write.parquet(str(tmp_path / str(k)))
        stages.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(s.columns == table.columns for s in stages[:-1])
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} for s in stages[:4]]

    scores = {r["doc_id"]: r["predicted"] for r in toxicity.judge(table, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    assert texts[1] == {i: t for i, t in texts[0].items() if not scores[i]}

    own, up = {i: sets(t) for i, t in texts[1].items()}, {i: i for i in texts[1]}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(own), 2):
        if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert texts[2] == {i: t for i, t in texts[1].items() if root(i) == i}

    found = {r["doc_id"]: r["pii"] for r in pii.find(stages[2]).collect()}
    for i, t in texts[2].items():
        want, at = "", 0
        for s in sorted(found[i], key=lambda s: (s["start"], s["end"], s["kind"])):
            if s["start"] >= at:
                want, at = want + (t or "")[at : s["start"]] + f"<{s['kind']}>", s["end"]
        assert texts[3][i] == (want + t[at:] if t is not None else None)

    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(stages[3]).collect()}
    order = [r for f in sorted((tmp_path / "3").glob("part-*")) for r in spark.read.parquet(str(f)).collect()]  # the training order
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for i in texts[3]:
        copies = [r["text"] for r in order if r["doc_id"] == i]
        assert sum(map(count, copies)) == taken[i] and all(texts[3][i].startswith(c) for c in copies)

    model, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for k, r in enumerate(order):
        ids = [*model.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(r["doc_id"], n, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()), round(k / len(order), 9)) for n, a in enumerate(range(0, len(ids), 4096))]
    out = stages[5].toPandas()
    assert sorted(zip(out["doc_id"], out["piece"], out["start"], out["length"], out["ids_crc32"], out["position"].round(9), strict=True)) == sorted(want)
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id")["length"].cumsum() - out["length"] == out["offset"]).all() and out.groupby("sequence_id")["length"].sum().max() <= 4096
    mean = out.assign(m=out["position"] * out["length"]).groupby("sequence_id")[["m", "length"]].sum()
    assert (out.drop_duplicates("sequence_id").set_index("sequence_id")["sequence_position"] - mean["m"] / mean["length"]).abs().max() < 1e-9
    assert corpus_pipeline.run(spark, d).count() == len(want)
    empty = table.limit(0)
    for _, f in corpus_pipeline.STAGES:
        empty = f(spark, empty, d)
    assert empty.count() == 0


def bare(i, kind="content"):
    """A page without an article, from a host of two kinds of pages; links cut its blocks into pieces."""
    body = "".join(f"<p>word{i}_{k} says <a href=/>link</a>, and <em>more {i}</em>.</p>" for k in range(8))
    return f'<html><body><div class="top"><p>Welcome to the site</p><p>Menu of {i}</p></div><div class="{kind}"><h2>Introduction</h2>{body}<p>Printed by the host</p></div><div class="side"><p>seen {i} times</p></div></body></html>'


def bare_text(i):
    return " ".join(f"word{i}_{k} says link, and more {i}." for k in range(8))


def test_slots_of_the_wrapper_decide(spark):
    rows = [(i, f"https://two.example.org/{i}", bare(i, "content" if i % 2 else "story")) for i in range(10)]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(bare_text(i) in got[i] and "Welcome" not in got[i] and "seen" not in got[i] for i in range(10))


def test_template_is_whole_blocks_of_all_pages(spark):
    rows = [(i, f"https://one.example.org/{i}", bare(i)) for i in range(10)]
    own = [(i, f"https://own.example.org/{i}", f"<body><article><h2>Introduction</h2><p>a{i} <a>b</a>, and <em>c{i}</em>.</p></article></body>") for i in range(20, 30)]
    late = [(i, f"https://late.example.org/{i}", bare(i).replace("Printed by the host", f"Only {i}" if i >= 44 else "Printed by the host")) for i in range(40, 70)]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows + own + late, "page_id long, url string, html string")).collect()}
    assert all(got[i] == bare_text(i) for i in range(10))
    assert all(got[i] == f"Introduction a{i} b, and c{i}." for i in range(20, 30))
    assert all(bare_text(i) in got[i] and ("Printed" in got[i] or f"Only {i}" in got[i]) for i in range(40, 70))


@pytest.mark.parametrize("page", [
    '<body class="has-sidebar"><article><p>T x</p></article></body>',
    '<body class="search no-sidebar"><main class="search-enabled"><p>T x</p></main></body>',
    '<body><div class="entry-content share-on"><p>T x</p></div></body>',
    '<body><article class="post hidden-title"><p>T x</p></article></body>',
    '<body><article><div class="article-header"><h1>T</h1></div><p>x</p></article></body>',
    '<body><article><header class="entry-header header"><h1>T</h1></header><p>x</p></article></body>',
    '<body><div class="widget"><article><p>T x</p></article></div></body>',
    '<body><form><article><p title="a hidden gem">T x</p></article></form></body>',
    '<body><article><p>T x</p><p hidden>no</p><div class="share">no</div></article><div class="related"><article><p>no</p></article></div></body>',
])
def test_names_of_furniture_are_whole_tokens(page):
    assert wrappers.extract(page, None) == "T x"


def test_toxicity_keeps_every_prefix(spark):
    """More nodes than any fixed table: each prefix that is seen three times has its own place."""
    rng = np.random.default_rng(4)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (36_000, 11))]
    texts = [" ".join(words[k % 40 :: 40]) for k in range(120)]
    df = spark.createDataFrame([(t, k % 2) for k, t in enumerate(texts)], "text string, toxic int")
    tree = toxicity._tree(df.mapInPandas(toxicity._counted, "node long, parent long, gram int, tox long, ord long"), toxicity.Tables(spark))
    want = set()
    for t in texts[:40]:
        for _, _, _, child, _ in toxicity._prefixes(*toxicity._words([t])[:3]):
            want |= set(child.tolist())
    long_ = ["internationalised", "internationalbbb"] * 2
    grown = toxicity._tree(spark.createDataFrame([(" ".join(long_ * 2), 1)], "text string, toxic int").mapInPandas(toxicity._counted, "node long, parent long, gram int, tox long, ord long"), toxicity.Tables(spark))
    assert np.count_nonzero(grown.keys) == len({w[: k + 1] for w in long_ for k in range(len(w))}) + 2  # to the end of both
    assert len(want) > 1 << 18 and set(tree.keys[tree.keys != 0].tolist()) == want
