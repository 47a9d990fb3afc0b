"""MinHash near-duplicates by a signature-coordinate inverted join.

Every document has K MinHash coordinates; each (coordinate, value) pair is an element with a posting list. Two sets with
a similarity of 0.75 agree in a coordinate with a chance of 0.75, so fewer than MATCHES agreements of K come about in
about one of 125,000 such pairs, and more rarely for nearer ones. Pairs with MATCHES agreements share an element among the
K - MATCHES + 1 rarest of either (prefix merging); elements of one document are skipped. Candidates are then confirmed on
the full shingle sets.

Only components are asked for, so no group's pairs are all emitted. First every list ties its documents to the most
central one, its hub; confirmed links give components. Then pairs inside a list are compared only between different
components, in blocks of bounded size that hold the full sets; any pair left out is inside a component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Tables
from riskloom.llm.components import components

WIDTH, PERCENT = 5, 75
K, MATCHES = 32, 13
#: Rows of one side of a block of a long posting list.
BLOCK = 1000
#: Ids of documents to confirm that are sent to every task; beyond it they are joined.
IDS = 2_000_000

_U = np.uint64
_STEP, _BACK = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_rng = np.random.default_rng(20240607)
_MUL, _ADD = (_rng.integers(1, 2**63, K, dtype=np.uint64) * _U(2) + _U(1) for _ in range(2))
_PLACE = _rng.integers(1, 2**63, 2 * WIDTH, dtype=np.uint64) * _U(2) + _U(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        m = max(n, 2 * len(_powers["up"]), 1 << 16)
        for k, base in (("up", _STEP), ("down", _BACK)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; the whole sequence as one if it is shorter."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    letter = np.r_[False, (b != 32) & ((b < 9) | (b > 13)), False]
    turns = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power(len(b) + 1)
    low = b.astype(np.uint64) + _U(1) + _U(32) * ((b >= 65) & (b <= 90))
    sums = np.r_[_U(0), np.cumsum(low * up[: len(b)], dtype=np.uint64)]
    words = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    n = len(words)
    if n < WIDTH:
        return _mixed(np.array([(words * _PLACE[WIDTH : WIDTH + n]).sum(dtype=np.uint64) + _U(n)], np.uint64))
    grams = words[: n - WIDTH + 1] * _PLACE[0]
    for j in range(1, WIDTH):
        grams = grams + words[j : n - WIDTH + 1 + j] * _PLACE[j]
    return np.unique(_mixed(grams))


def signature(hashes: np.ndarray) -> np.ndarray:
    """K coordinates as signed 32-bit numbers."""
    out = np.full(K, 2**32 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] * _MUL + _ADD
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        out = np.minimum(out, (x >> _U(32)).min(0))
    return out.astype(np.uint32).view(np.int32)


def _marks(s: np.ndarray) -> list[int]:
    """Two numbers that, with the size of a set, tell it from any other."""
    return [int(_mixed(s + add).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for add in (_U(1), _U(77))]


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, row, text_mark, text in zip(batch["doc_id"], batch["row"], batch["text_mark"], batch["text"], strict=True):
            s = shingles(text)
            rows.append((doc, row, text_mark, len(s), *_marks(s), signature(s) if len(s) else None))
        yield pd.DataFrame(rows, columns=["doc_id", "row", "text_mark", "n", "mark1", "mark2", "sig"])


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [shingles(t) for t in batch["text"]]
        marks = [(len(s), *_marks(s), s.tobytes()) for s in found]
        yield pd.DataFrame(marks, columns=["n", "mark1", "mark2", "hashes"]).assign(doc=batch["doc_id"].to_numpy())


def _agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            same = (np.stack(batch["sig_a"]) == np.stack(batch["sig_b"])).sum(1)
            yield batch.loc[same >= MATCHES, ["a", "b"]]


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["hashes_a"], batch["hashes_b"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.loc[keep, ["a", "b"]]


def _across(cell: pd.DataFrame) -> pd.DataFrame:
    """Links of one block between different components; each pair is looked at in its first common list only.

    A link found makes two components one for the rest of the block, so at most as many links as components come out.
    """
    left, right = cell[cell["left"]], cell[cell["right"]]
    out, joined = [], {}

    def root(c: int) -> int:
        while (up := joined.get(c, c)) != c:
            c = up
        return c

    if len(left) and len(right):
        element = cell["element"].iloc[0]
        sig, n, rep, rest = np.stack(right["sig"]), right["n"].to_numpy(), right["rep"].to_numpy(), ~right["dominant"].to_numpy()
        comps, lists, sets = list(right["component"]), list(right["prefix"]), list(right["hashes"])
        for s, m, c, r, prefix, own in left[["sig", "n", "component", "rep", "prefix", "hashes"]].itertuples(index=False):
            at = np.flatnonzero((100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & ~(rest & (rep <= r)))
            at = at[(sig[at] == s).sum(1) >= MATCHES]
            own, seen = np.frombuffer(own, np.uint64), set(prefix)
            for j in at:
                if root(comps[j]) == root(c) or next(e for e in lists[j] if e in seen) != element:
                    continue
                other = np.frombuffer(sets[j], np.uint64)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= PERCENT * (len(own) + len(other) - both):
                    out.append((r, rep[j]))
                    joined[root(c)] = root(comps[j])
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _sets_of(ids: DataFrame, reps: DataFrame, docs: DataFrame, tables: Tables, name: str) -> DataFrame:
    """id, hashes: the full sets of the classes in ``ids`` (id), each from a text of its least document."""
    wanted = tables.put(reps.join(ids.select(F.col("id").alias("rep")).distinct(), "rep").select("rep", "doc", "n", "mark1", "mark2"), f"{name}-ids")
    few = wanted.count() <= IDS  # else the texts have to move
    own = wanted.select(F.col("doc").alias("doc_id")).distinct()
    some = docs.join(F.broadcast(own) if few else own, "doc_id", "left_semi").select("doc_id", "text")
    found = some.mapInPandas(_sets, "n long, mark1 long, mark2 long, hashes binary, doc long")
    out = found.join(wanted, ["doc", "n", "mark1", "mark2"]).groupBy(F.col("rep").alias("id")).agg(F.first("hashes").alias("hashes"))
    return tables.put(out, name)


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, tables: Tables) -> DataFrame:
    """The pairs whose full sets are near enough; sets are computed for documents in a pair only."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), reps, docs, tables, "sets")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"hashes_{c}"))
    links = tables.put(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_linked, "a long, b long"), "confirmed")
    tables.drop("sets")
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``; other columns are ignored.

    Null or empty texts and texts without words have no shingles and are linked with nothing. Rows without a doc_id are
    returned with a null component and kept. Equal sets are one class with its smallest doc_id as representative, so
    copies cost one row each. Rows that share a doc_id count each with its own text. An empty table gives no rows.
    """
    return _labelled(docs).drop("text_mark")


def _labelled(docs: DataFrame) -> DataFrame:
    """The same with ``text_mark``, the md5 of the text."""
    spark = docs.sparkSession
    tables = Tables(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.md5("text").alias("text_mark"), "text")
    signed = tables.put(numbered.mapInPandas(_signed, "doc_id long, row long, text_mark string, n long, mark1 long, mark2 long, sig array<int>"), "signed")
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    # A class goes by the row of its least document, as one document may stand for two texts.
    least = some.groupBy("n", "mark1", "mark2").agg(F.min(F.struct("doc_id", "row")).alias("own"), F.first("sig").alias("sig"))
    reps = tables.put(least.select("n", "mark1", "mark2", F.col("own.row").alias("rep"), F.col("own.doc_id").alias("doc"), "sig"), "reps")

    elements = reps.select("rep", F.posexplode("sig").alias("place", "value")).select("rep", (F.shiftleft(F.col("place").cast("long"), 32) + F.col("value")).alias("element"))
    shared = elements.groupBy("element").agg(F.count("*").alias("size")).where("size > 1")
    ranked = elements.join(shared, "element").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("size", "element"))).alias("all"))
    # Elements of one document come first in the prefix and have no list to post to. The more a document's elements are
    # shared, the nearer it stands to the middle of its group, and the better a hub it is.
    central = F.aggregate("all", F.lit(0.0), lambda acc, x: acc + F.log2(x["size"].cast("double"))).alias("central")
    prefix = ranked.withColumn("left", F.size("all") - F.lit(MATCHES - 1)).where("left > 0").select("rep", central, F.transform(F.slice("all", F.lit(1), F.col("left")), lambda x: x["element"]).alias("prefix"))
    heads = tables.put(prefix.join(reps.select("rep", "n", "sig"), "rep"), "heads")
    posted = heads.withColumn("element", F.explode("prefix"))

    hubs = posted.groupBy("element").agg(F.max_by(F.struct("rep", "n", "sig"), F.struct("central", F.negate("rep"))).alias("hub"), F.count("*").alias("size")).where("size > 1").drop("size")
    near = "rep <> hub.rep AND 100 * least(n, hub.n) >= %d * greatest(n, hub.n)" % PERCENT
    stars = posted.drop("prefix").join(hubs, "element").where(near).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("hub.sig").alias("sig_a"))
    stars = tables.put(stars.mapInPandas(_agreeing, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    links = _confirmed(stars, reps, docs, tables)
    first = tables.put(components(links, tables, "first"), "first")

    named = heads.join(first.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).select("rep", "component", "central", "prefix")
    lists = named.withColumn("element", F.explode("prefix")).groupBy("element").agg(F.max_by("component", F.struct("central", F.negate("rep"))).alias("top"), F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high AND size > 2")
    lists = lists.select("element", "top", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    open_ = tables.put(named.withColumn("element", F.explode("prefix")).join(lists, "element").select("element", "rep", "component", (F.col("component") == F.col("top")).alias("dominant"), "blocks"), "open")
    sets = _sets_of(open_.select(F.col("rep").alias("id")), reps, docs, tables, "open-sets")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    rows = F.when(F.col("dominant"), F.array().cast("array<struct<row:bigint,col:bigint>>")).otherwise(F.transform(every, lambda i: F.struct(F.col("block").alias("row"), i.alias("col"))))
    cols = F.transform(every, lambda i: F.struct(i.alias("row"), F.col("block").alias("col")))
    cells = open_.withColumn("block", block).withColumn("cell", F.explode(F.array_distinct(F.concat(rows, cols)))).select("element", "rep", "component", "dominant", "cell", ((F.col("cell.row") == F.col("block")) & ~F.col("dominant")).alias("left"), (F.col("cell.col") == F.col("block")).alias("right"))
    full = cells.join(heads.select("rep", "n", "sig", "prefix").join(sets.withColumnRenamed("id", "rep"), "rep"), "rep")
    more = tables.put(full.groupBy("element", "cell").applyInPandas(_across, "a long, b long"), "across")
    tables.drop("open-sets")
    final = components(links.unionByName(more), tables, "final")
    for name in ("heads", "stars", "confirmed", "first", "open", "across"):
        tables.drop(name)

    named = reps.join(final.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")).select("n", "mark1", "mark2", "doc", "component")
    lowest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    labels = named.join(lowest, "component").select("n", "mark1", "mark2", "component_id")
    alone = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", "text_mark", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = some.join(labels, ["n", "mark1", "mark2"]).select("doc_id", "text_mark", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but the smallest doc_id of each component, with all their columns whatever their names.

    Rows without a doc_id or without words stay; so do all rows of a document with the text that is kept. An empty table
    gives no rows.
    """
    tables = Tables(docs.sparkSession)
    gone = _labelled(docs).where("NOT kept").select(F.col("doc_id").alias("_gone_id"), F.unhex("text_mark").alias("_gone_text")).distinct()
    gone = tables.put(gone, "gone")
    few = gone.count() <= IDS  # else the texts have to move
    marked = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_id"), F.unhex(F.md5("text")).alias("_text"))
    return marked.join(F.broadcast(gone) if few else gone, (F.col("_id") == F.col("_gone_id")) & (F.col("_text") == F.col("_gone_text")), "left_anti").select("_doc.*")
