"""Near-duplicates, repeated passages, packing and media against brute force."""

import hashlib
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import neardup, packing, suffixes, tiff
from riskloom.llm.common import Tables, small_batches

P = pytest.importorskip("public_tokenizers")


def sets_of(docs):
    out = []
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        out.append((r["doc_id"], {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def test_neardup_components(docs, nothing):
    sets = sets_of(docs)
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and a < b and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(sets)
    size = {i: len(s) for i, s in sets}
    for r in got:
        assert r["n_shingles"] == size[r["doc_id"]]
        assert r["component_id"] == (root(r["doc_id"]) if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}
    assert neardup.near_duplicates(nothing).count() == 0


def test_neardup_large_group(spark, monkeypatch):
    """A group of near copies whose links do not all go through one hub, in blocks of a few rows."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        w = list(base)
        for j in range(i // 3):
            w[(11 * i + 7 * j) % 100] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    test_neardup_components(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string"))


def test_neardup_two_texts_of_one_id(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    base, other = " ".join(words), " ".join(f"{w}x" for w in words)
    rows = [(1, base), (1, other), (3, other + " more"), (4, base + " more"), (2, "quite a different text of its own"), (2, base)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, component_id int")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True), (3, 1, False), (4, 1, False)]
    assert sorted(r["text"] for r in neardup.keep_one(df).collect()) == sorted([base, other, "quite a different text of its own"])


def test_repeated_passages(docs, nothing, monkeypatch):
    for hot in (suffixes.HOT, 1):  # with 1, every shared anchor is spread by its strings
        monkeypatch.setattr(suffixes, "HOT", hot)
        texts = [(2**63 - 1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
        first = {}
        for i, b in sorted(texts):
            for k in range(len(b) - 49):
                first.setdefault(b[k : k + 50], i)
        want = []
        for i, b in texts:
            gone = np.zeros(len(b) + 1, bool)
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < i:
                    gone[k : k + 50] = True
            kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
            want.append((None if i == 2**63 - 1 else i, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
        got = [tuple(r) for r in suffixes.remove_repeats(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert suffixes.remove_repeats(nothing).count() == 0


def test_merge_of_transforms():
    rng = np.random.default_rng(0)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 40), dtype=np.uint8)) for _ in range(30)]
    ids = np.arange(30) // 2
    for shard in (5, 40, 10_000):
        suffixes.SHARD, kept = shard, suffixes.SHARD
        try:
            got = suffixes.repeated(strings, ids, 6)
        finally:
            suffixes.SHARD = kept
        for i, s in enumerate(strings):
            want = [k for k in range(len(s) - 5) if any(ids[j] < ids[i] and s[k : k + 6] in t for j, t in enumerate(strings))]
            assert got[i].tolist() == want


@pytest.mark.parametrize("size", [64, 4096])
def test_packing(docs, nothing, size):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, size).toPandas()
    want = []
    for r in docs.collect():
        ids = model.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want += [(str(r["doc_id"]), k, a, len(ids[a : a + size]), zlib.crc32(np.array(ids[a : a + size], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), size))]
    key = got["doc_id"].map(lambda x: "None" if x != x or x is None else str(int(x)))
    assert sorted(zip(key, got["piece"], got["start"], got["length"], got["ids_crc32"], strict=True)) == sorted(want)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= size
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // size) * 1.1 + 1
    assert packing.pack_documents(nothing, path).count() == 0


def test_plan_places_every_length():
    rng = np.random.default_rng(3)
    for scale in (50, 600, 2500):
        lengths = np.minimum(4096, 1 + rng.exponential(scale, 5000).astype(int))
        histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
        plan = packing.plan(histogram)
        used = np.zeros(plan.count, int)
        for s, n in histogram.items():
            ranks = s << 44 | np.arange(n)
            run = np.searchsorted(plan.keys, ranks, side="right") - 1
            beyond = np.arange(n) - (plan.keys[run] & ((1 << 44) - 1))
            np.add.at(used, plan.sequences[run] + beyond // plan.side[run], s)
        assert used.max() <= 4096 and used.min() > 0 and plan.count <= 1.15 * lengths.sum() / 4096 + 1


def test_training_order_does_not_move_texts(spark, docs):
    """One row a file is sent to the documents, whatever Spark takes its size for."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        placed, position = packing.training_order(docs)
        plan = placed.select("text", position)._jdf.queryExecution().executedPlan().toString()
        got = sorted(r[0] for r in placed.select(position).collect())
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert got == pytest.approx([k / len(got) for k in range(len(got))])


def test_words_kept_by_a_worker_are_bounded():
    """A worker lives on through other stages with the words it keeps."""
    own = packing._Encoder(P.path("word_bpe_49k.json"))
    for at in range(0, 900_000, 50_000):
        own._look_up([f"{k:x}q" for k in range(at, at + 50_000)])
    held = [*own.known.items(), *own.older.items()]
    assert sum(sys.getsizeof(w) + sys.getsizeof(ids) for w, ids in held) < 60e6
    again = [f"{k:x}q" for k in range(100)]
    assert own._look_up(again) == [x.tobytes() for x in own._ids(again)]  # what went is learnt again


def test_long_texts_go_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield batch.text.str.len().agg(["sum"]).to_frame("n")

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), F.lit(100_000)).alias("text"))
    with small_batches(spark):
        got = [r.n for r in Tables(spark).put(rows.mapInPandas(sizes, "n long"), "sizes").collect()]
    assert sum(got) == 30_000_000 and max(got) < 6_000_000
    assert spark.conf.get(key) == before


def test_words_encode_as_whole_texts():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    model, own = Tokenizer.from_file(path), packing._Encoder(path)
    texts = ["It's the dog's, we'll go. 3.5, x_. A.B., été, ΣΑΣ Straße İx", "<|endoftext|> a<|ENDOFTEXT|>b", "a b c\x1cd \t\r e", "don't 'still 's, ...wow,, .", "日本語 テスト 12345 ½", " ", "", "x" * 5000]
    texts += ["thear###", "a|b c| d", "dog's,", "l'été.", "x's'", "e\u0301, e\u0301", "(a) [b] {c} \"d\" e_ f-g h--", "ab" * 2000 + ",", "it'sing 'sing", "ŉ. ǰ, ß! İ."]
    whole = packing._Encoder(path)
    whole.wordwise = False
    for encode in (own, whole):
        assert encode.wordwise == (encode is own)
        for part in (texts, texts[::-1], []):
            ids, ends = encode(part)
            for t, a, b in zip(part, [0, *ends], ends, strict=False):
                assert ids[a:b].tolist() == model.encode(t, add_special_tokens=False).ids, t
    assert not packing._Encoder(P.path("byte_bpe_50k.json")).wordwise


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(scheme, predictor):
    rng = np.random.default_rng(1)
    pages = [(np.cumsum(rng.integers(-1, 2, (h, w, s)), 1) % 256).astype(np.uint8) for h, w, s in ((70, 50, 1), (33, 65, 3), (1, 1, 1), (200, 300, 1))]
    for tile in (None, (16, 32)):
        got = list(tiff.read(tiff.write(pages, scheme, predictor, tile=tile)))
        assert len(got) == 4 and all((a == b.pixels).all() and b.tiled == bool(tile) for a, b in zip(pages, got, strict=True))
    for n in (0, 1, 4000, 100_000):
        for top in (3, 256):
            data = rng.integers(0, top, n).astype(np.uint8).tobytes()
            assert tiff._unpacked(tiff._packed(data, scheme), scheme, n) == data


def test_media_digest(docs, nothing):
    got = tiff.digest(docs).collect()
    by = {}
    for r, d in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["media_sha256"])), sorted(docs.collect(), key=lambda r: str(r["doc_id"])), strict=True):
        raw = (d["text"] or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert by.setdefault(raw, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert tiff.digest(nothing).count() == 0


def test_broken_files_give_errors(spark):
    good = tiff.write([np.zeros((4, 4, 1), np.uint8)])
    loop = bytearray(good)
    loop[-4:] = loop[4:8]
    rows = [(1, good), (2, None), (3, b""), (4, b"II*\0\xff\xff\xff\xff"), (5, good[:-9]), (6, bytes(loop)), (7, b"GIF89a--")]
    out = tiff.pages(spark.createDataFrame(rows, "k int, media binary"), "k").collect()
    assert sorted((r["k"], r["error"] is None) for r in out if r["k"] != 6) == [(1, True), (2, False), (3, False), (4, False), (5, False), (7, False)]
    assert [r["error"] is None for r in out if r["k"] == 6] == [True, False]


def test_tiff_header_that_asks_for_more_than_it_holds(spark):
    """A broken size gives an error row, not memory."""
    import struct

    whole = tiff.write([np.zeros((4, 8, 1), np.uint8)])
    at = struct.unpack_from("<I", whole, 4)[0]
    broken = bytearray(whole)
    for k in range(struct.unpack_from("<H", whole, at)[0]):
        if struct.unpack_from("<H", whole, at + 2 + 12 * k)[0] in (tiff.WIDTH, tiff.HEIGHT):
            struct.pack_into("<I", broken, at + 10 + 12 * k, 2**31 - 1)
    df = spark.createDataFrame([(1, bytes(broken)), (2, whole), (3, None)], "id int, media binary")
    got = {r["id"]: r for r in tiff.pages(df, "id").collect()}
    assert "more samples" in got[1]["error"] and got[2]["error"] is None and got[2]["pixels"] == bytes(32) and got[3]["error"]
