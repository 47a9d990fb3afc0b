"""op11 to op13 against plain Python: nulls, empties, ties, repeats, very long texts, clashing columns, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import lexical, merkle, topk
from tests.llm.conftest import SCHEMA, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes):
    """The top, and of each leaf the (slot, run) pairs up to it."""
    paths, under = [[] for _ in hashes], [[k] for k in range(len(hashes))]
    while len(hashes) > 1:
        above, groups = [], []
        for i in range(0, len(hashes), 16):
            run = hashes[i : i + 16]
            above.append(digest(*run))
            groups.append([k for j in range(len(run)) for k in under[i + j]])
            for j in range(len(run)):
                for k in under[i + j]:
                    paths[k].append((j, run))
        hashes, under = above, groups
    return hashes[0], paths


def manifest(rows):
    leaves = [digest(*map(encoded, r)) for r in rows]
    by = defaultdict(list)
    for k, r in enumerate(rows):
        by[r[1]].append(k)
    subroots, own = {}, {}
    for s, ks in by.items():
        ks.sort(key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaves[k]))
        subroots[s], paths = tree([leaves[k] for k in ks])
        own.update(zip(ks, paths, strict=True))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    root, tops = tree([subroots[s] for s in order])
    out = []
    for k, r in enumerate(rows):
        path, node = own[k] + tops[order.index(r[1])], leaves[k]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
            node = digest(*map(encoded, (*r[:4], r[4] and r[4].translate(LOWER))))
        proof = digest("".join(h for j, run in path for i, h in enumerate(run) if i != j))
        for j, run in path:
            node = digest(*run[:j], node, *run[j + 1 :])
        out.append((r[0], leaves[k], subroots[r[1]], root, proof, node, node == root))
    return sorted(out, key=str)


def test_manifest(docs):
    got = [tuple(r) for r in merkle.digest(docs).collect()]
    assert sorted(got, key=str) == manifest([tuple(r) for r in docs.select(*merkle.FIELDS).collect()])
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 300])
def test_manifest_of_sizes(spark, n):
    """One leaf is its own subroot and root; one source; runs of one; a last run that is hashed alone."""
    rows = [(i, "only", "en", i, f"Text {i}") for i in range(n)]
    assert sorted(map(tuple, merkle.digest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")).collect()), key=str) == manifest(rows)


def test_manifest_of_many_sources(spark):
    rows = [(None if i % 50 == 3 else i // 2, None if i % 40 == 0 else f"s{i % 37}é", None, None, None if i % 9 == 0 else "Aa" * (i % 5)) for i in range(400)]
    rows += rows[:20]
    assert sorted(map(tuple, merkle.digest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)).collect()), key=str) == manifest(rows)


def test_manifest_of_nothing(nothing):
    assert merkle.digest(nothing).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert not merkle.digest(nothing).count()


def test_paths_lead_to_the_root(docs):
    """The operator's own output: folding a leaf with its path gives the root, another hash does not."""
    got = merkle.prove(docs).select((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("own"), (merkle.fold(F.sha2("leaf", 256), F.col("path")) == F.col("root")).alias("other"))
    assert got.where("own AND NOT other").count() == docs.count()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranking(docs, items, k=20):
    words = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    n, total = len(words), sum(c.total() for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in words:
            m = 75 + (25 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in TERM.findall((text or "").translate(LOWER)) if c[t])
            if score:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if void else i, -score) for rank, (score, void, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, prose(999, 40)), (1, prose(999, 40)), (2, prose(500, 20)), (3, None), (4, " .,; "), (5, "no word that is anywhere zzz"), (6, "Stone1 STONE1 stone2 é 日本 x"), (None, prose(3, 9)), (7, "a" * 3000), (8, prose(501, 60))]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 0, "m") for i, t in ITEMS], "item_id long, text string, rank int, part string").repartition(2)


def test_lexical(docs, items):
    got = sorted((tuple(r) for r in lexical.search(docs, items).collect()), key=str)
    assert got == ranking([tuple(r) for r in docs.select("doc_id", "text").collect()], ITEMS)


def test_lexical_in_small_shards_and_parts(docs, items, monkeypatch):
    """Texts in pieces, items in parts, shards of few documents with deeper trees: the same rows."""
    monkeypatch.setattr(lexical, "ITEMS", 200)
    monkeypatch.setattr(lexical, "SHARD", 7)
    monkeypatch.setattr(lexical, "FAN", 2)
    monkeypatch.setattr(lexical, "PIECE", 50)
    got = sorted((tuple(r) for r in lexical.search(docs, items, 3).collect()), key=str)
    assert got == ranking([tuple(r) for r in docs.select("doc_id", "text").collect()], ITEMS, 3)


def test_bounds_leave_ranges_closed():
    """A shard whose best documents lie together is not opened whole, and a tie at the bound is."""
    sizes, terms = np.full(256, 1), np.repeat([0, 1], 128)
    scores = np.r_[np.full(128, 9), np.full(120, 5), np.full(8, 7)]
    shard = lexical.Shard(list(range(256)), sizes, terms, scores, 2)
    best = []
    opened = shard.search(np.array([0, 1]), np.array([1, 1]), 5, best)
    assert [b[2] for b in best] == [0, 1, 2, 3, 4] and opened == 128
    best = []
    assert shard.search(np.array([1]), np.array([2]), 4, best) < 128 and [b[0] for b in best] == [-14] * 4


def test_lexical_of_nothing(nothing, docs, items):
    empty = items.limit(0)
    for d, i in ((nothing, items), (docs, empty), (docs, items.where("item_id IN (3, 4)"))):
        got = lexical.search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and not got.count()


def nearest(rows, queries, k=5):
    def ints(v):
        if v is None or any(c is None or not math.isfinite(c) for c in v):
            return None
        return tuple(math.floor(c * 256) for c in v)

    known = {(i, ints(v)) for i, v in rows if i is not None and ints(v) is not None}
    out = []
    for own in {i for i, v in queries if i is not None}:
        best = {}
        for q in {ints(v) for i, v in queries if i == own} - {None}:
            for i, v in known:
                if i != own and len(v) == len(q):
                    score = sum(a * b for a, b in zip(q, v, strict=True))
                    best[i] = max(best.get(i, score), score)
        out += [(own, rank, i, s) for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


def vectors(seed=1):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 8)]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(150, 230)]  # copies: ties
    rows += [(7, rows[8][1]), (7, rows[7][1]), (50, rows[9][1]), (50, None)]  # one id with several vectors, queries among them
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (350, [0.0] * 8), (304, [1.0, 2.0]), (400, [0.5, -0.5]), (450, []), (None, rows[1][1])]
    rows += [(500, [-0.001] * 8), (501, [-0.0] * 8), (502, [40.0] * 8)]
    return rows


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, rank int, score int").repartition(3)


def both(spark, rows, **more):
    df = frame(spark, rows)
    return sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0"), **more).collect())


def test_topk(spark):
    assert both(spark, vectors()) == nearest(vectors(), [r for r in vectors() if r[0] is not None and r[0] % 50 == 0])


def test_topk_in_small_blocks(spark, monkeypatch):
    for name, value in (("COMPONENTS", 200), ("QUERIES", 2), ("SAMPLE", 20), ("SLICE", 2), ("FEW", 0.0)):
        monkeypatch.setattr(topk, name, value)
    assert both(spark, vectors(2), k=3) == nearest(vectors(2), [r for r in vectors(2) if r[0] is not None and r[0] % 50 == 0], 3)


def test_topk_of_great_numbers(spark):
    """Beyond doubles' exact sums, integers are used; what 64 bits cannot hold is an error."""
    rows = [(i, [float((i * 7919) % 1009) * 1e4 + i, 1.0 + i, -2.0**20]) for i in range(101)]
    assert both(spark, rows) == nearest(rows, [r for r in rows if r[0] % 50 == 0])
    with pytest.raises(Exception, match="OverflowError|too large|out of bounds|int"):
        both(spark, [(i, [1e12, 1e12]) for i in range(60)])


def test_lists_are_read_no_further_than_needed():
    """A block whose high ends decide: bounds exclude the rest before the lists end."""
    r = np.random.default_rng(3)
    x = np.floor(np.exp(r.normal(0, 2, (2000, 4))) * 256)
    deep, read = [], topk.Lists.read
    try:
        topk.Lists.read = lambda self, depth: (deep.append(depth), read(self, depth))[1]
        got = list(topk.aggregate(x[:3], np.arange(3), np.full(3, -np.inf), x, np.arange(2000), 5))
    finally:
        topk.Lists.read = read
    for number, scores, ids in got:
        want = sorted(((-(x[i] @ x[number]), i) for i in range(2000) if i != number))[:5]
        assert list(zip(-scores, ids, strict=True)) == want
    assert max(deep) < 2000


def test_topk_of_nothing(spark):
    df = frame(spark, vectors())
    for rows, queries in ((df.limit(0), df), (df, df.limit(0)), (df.where("vec_id > 299 AND vec_id < 304"), df)):
        got = topk.search(rows, queries)
        assert got.columns == ["query_id", "rank", "vec_id", "score"] and not got.count()


def test_columns_of_the_tables_play_no_part(docs, nothing):
    assert docs.columns == nothing.columns and "rank" in SCHEMA
