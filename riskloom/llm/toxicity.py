"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

A word is a walk from the root of a prefix tree. Each class has its counts at every node; what discounting takes away goes
to one backoff that both classes share: in how many places of the tree a byte follows the two before it. So rare expressions
score alike in both classes, and a word's log-likelihood ratio is that of its longest known prefix. A document's ratio is
normalised by its length and calibrated to a probability on labelled rows that the tree was not fitted on.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Tables, whole

#: Bound of the labelled rows that the model is fitted on; above it, rows with the least md5(doc_id) are taken.
FIT_ROWS = 40_000
#: Of the fitted rows, those with crc32 mod 16 in this range calibrate; the others fill the tree.
CALIBRATE = (12, 16)
DISCOUNT = 0.75
#: A prefix seen less often backs off: its words go by their longest prefix seen as often as this, whatever the number of nodes.
LEAST = 3
THRESHOLD = 0.3

#: Characters of text that are worked on at once.
BLOCK = 1 << 18
#: Rows of the table of grams up to which it is sent to every task; beyond it, it is joined.
GRAMS = 2_000_000

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(27))


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes of all texts with a 0 after them, where words of letters start and end, and each word's text."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b"\n".join(parts) + b"\0", np.uint8)
    letter = np.r_[False, ((b >= 97) & (b <= 122)) | (b >= 128), False]
    turns = np.flatnonzero(letter[1:] != letter[:-1])
    begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    return b, turns[::2], turns[1::2], np.searchsorted(begins, turns[::2], side="right") - 1


def _blocks(texts: list[str | None]) -> Iterator[slice]:
    """Neighbouring texts that are worked on at once."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= BLOCK:
            yield slice(start, k + 1)
            start, held = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _prefixes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Generator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray | None, None]:
    """For each depth: the words that reach it, their parent's hash, their own, and the byte; the end of a word is byte 0.

    Words are read to their end; what is sent back are those to read on.
    """
    at, node, up, depth = np.arange(len(starts)), np.zeros(len(starts), np.uint64), _STEP, 0
    while len(at):
        place = starts[at] + depth
        byte = np.where(place < ends[at], b[place], 0)
        child = node[at] + (byte.astype(np.uint64) + _U(1)) * up
        on = yield depth, at, node[at].copy(), child, byte
        node[at] = child
        at = at[(byte > 0) if on is None else (byte > 0) & on]
        depth += 1
        up = _U(int(up) * int(_STEP) % 2**64)


def _summed(found: list[np.ndarray]) -> pd.DataFrame:
    """Rows of (node, parent, gram, toxic) as counts of each node by class; a node has one parent and one gram."""
    node, parent, gram, toxic = np.concatenate(found, axis=1)
    nodes, first, which = np.unique(node, return_index=True, return_inverse=True)
    every, tox = np.bincount(which), np.bincount(which, weights=toxic).astype(np.int64)
    return pd.DataFrame({"node": nodes, "parent": parent[first], "gram": gram[first].astype(np.int32), "tox": tox, "ord": every - tox})


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found, held = [], 0
    for batch in batches:
        for toxic, rows in batch.groupby("toxic")["text"]:
            for part in _blocks(texts := list(rows)):
                b, starts, ends, _ = _words(texts[part])
                for depth, at, parent, child, byte in _prefixes(b, starts, ends):
                    before = sum((b[starts[at] + depth - k].astype(np.int64) << (8 * k)) if depth >= k else 0 for k in (1, 2))
                    found.append(np.stack([child.view(np.int64), parent.view(np.int64), before + byte, np.full(len(at), int(toxic))]))
                    held += len(at)
                if held > 1_000_000:
                    yield _summed(found)
                    found, held = [], 0
    if held:
        yield _summed(found)


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return (_mixed(keys) >> _U(65 - size.bit_length())).astype(np.int64)


def _table(keys: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every key and its ratio in an open table of a power of two of places."""
    size = 1 << max(10, (2 * len(keys)).bit_length())
    held, values = np.zeros(size, np.uint64), np.zeros(size, np.float32)
    left, slot = np.arange(len(keys)), _slots(keys, size)
    while len(left):
        free = np.flatnonzero(held[slot[left]] == 0)
        _, first = np.unique(slot[left[free]], return_index=True)
        put = left[free[first]]
        held[slot[put]], values[slot[put]] = keys[put], ratios[put]
        left = left[held[slot[left]] != keys[left]]
        slot[left] = (slot[left] + 1) % size
    return held, values


@dataclass
class Tree:
    """Ratios of all prefixes seen LEAST times in an open table that is at most half full; a taken place sends a key to the next."""

    keys: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray = None
    intercept: float = 0.0

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: its log-likelihood ratio over its length, and over the root of it, for all words and for
        those that speak clearly for toxic; and their share."""
        made = [self._features(texts[part]) for part in _blocks(texts)]
        return np.concatenate(made) if made else np.zeros((0, 4))

    def _features(self, texts: list[str | None]) -> np.ndarray:
        b, starts, ends, text = _words(texts)
        ratio = np.zeros(len(starts), np.float32)
        walk = _prefixes(b, starts, ends)
        step = next(walk, None)
        while step is not None:
            _, at, _, child, _ = step
            slot, found = _slots(child, len(self.keys)), np.zeros(len(at), bool)
            left = np.flatnonzero(self.keys[slot] != 0)
            while len(left):
                known = self.keys[slot[left]] == child[left]
                hit = left[known]
                ratio[at[hit]], found[hit] = self.ratios[slot[hit]], True
                left = left[~known]
                slot[left] = (slot[left] + 1) % len(self.keys)
                left = left[self.keys[slot[left]] != 0]
            try:
                step = walk.send(found)  # no prefix is known whose own prefix is not
            except StopIteration:
                step = None
        strong = ratio > 2
        of = lambda w: np.bincount(text, weights=w, minlength=len(texts)).astype(np.float64)
        n = np.maximum(of(np.ones(len(text))), 1)
        return np.stack([of(ratio) / n, np.tanh(of(ratio) / np.sqrt(n) / 4), np.minimum(1.0, 50 * of(strong) / n), np.tanh(of(ratio * strong) / np.sqrt(n) / 2)], 1)


def _tree(grown: DataFrame, tables: Tables) -> Tree:
    nodes = tables.put(grown.groupBy("node", "parent", "gram").agg(F.sum("tox").alias("tox"), F.sum("ord").alias("ord")), "nodes")
    kinds = lambda c: F.sum((F.col(c) > 0).cast("long")).alias(f"kinds_{c}")
    parents = nodes.groupBy("parent").agg(F.sum("tox").alias("all_tox"), F.sum("ord").alias("all_ord"), kinds("tox"), kinds("ord"))
    grams = nodes.groupBy("gram").agg(F.count("*").alias("places"))
    before = nodes.groupBy(F.shiftright("gram", 8).alias("before")).agg(F.count("*").alias("all_places"))  # at most 65,536 rows
    shared = grams.withColumn("before", F.shiftright("gram", 8)).join(F.broadcast(before), "before").select("gram", ((F.col("places") + 0.5) / (F.col("all_places") + 128)).alias("shared"))
    # A class that never came to the parent has the backoff alone.
    side = lambda c: F.when(F.col(f"all_{c}") > 0, (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"kinds_{c}") * F.col("shared")) / F.col(f"all_{c}")).otherwise(F.col("shared"))
    few = grams.count() <= GRAMS
    steps = nodes.where(F.col("tox") + F.col("ord") >= LEAST).join(parents, "parent").join(F.broadcast(shared) if few else shared, "gram")
    t = steps.select("node", "parent", F.log(side("tox") / side("ord")).cast("float").alias("step")).toArrow()
    keys, parent, step = (t[c].to_numpy() for c in ("node", "parent", "step"))
    keys, parent = keys.view(np.uint64), parent.view(np.uint64)
    order = np.argsort(keys)
    keys, parent, step = keys[order], parent[order], step[order]
    n = len(keys)  # the root's place: every node adds up what its parent has, then what that one's has, twice as far each time
    up = np.minimum(np.searchsorted(keys, parent), max(n - 1, 0))
    up = np.append(np.where(keys[up] == parent, up, n) if n else up, n)
    ratio = np.append(step.astype(np.float64), 0.0)
    while (up != n).any():
        ratio, up = ratio + ratio[up], up[up]
    ratio = ratio[:n].astype(np.float32)
    return Tree(*_table(keys, ratio))


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None = 2) -> Tree:
    """Learn from labelled rows of ``docs``; rows with crc32(doc_id) mod 4 = ``held_out`` are never used.

    Null labels are left out; of repeated labels the highest counts. Without labelled rows of both classes every score is 0.5.
    """
    tables = Tables(docs.sparkSession)
    crc = F.crc32(F.col("doc_id").cast("string"))
    given = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    if held_out is not None:
        given = given.where(crc % 4 != held_out)
    given = given.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # At most FIT_ROWS rows of a number and a class, so they can be sent to every task.
    taken = given.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(FIT_ROWS)
    rows = docs.select("doc_id", whole().alias("text")).join(F.broadcast(taken), "doc_id").withColumn("part", F.floor(crc / 4) % 16)
    rows = tables.put(rows.select("text", "toxic", "part"), "rows")
    calibrates = F.col("part").between(CALIBRATE[0], CALIBRATE[1] - 1)
    tree = _tree(rows.where(~calibrates).select("text", "toxic").mapInPandas(_counted, "node long, parent long, gram int, tox long, ord long"), tables)
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"].astype(float), "features": list(shared.value.features(list(batch["text"])))})

    seen = rows.where(calibrates).select("text", "toxic").mapInPandas(measured, "toxic double, features array<double>")
    seen = tables.put(seen, "seen").withColumn("features", array_to_vector("features"))
    if seen.select("toxic").distinct().count() == 2:
        model = LogisticRegression(labelCol="toxic", regParam=1e-4).fit(seen)
        tree.weights, tree.intercept = np.array(model.coefficients), float(model.intercept)
    for name in ("nodes", "rows", "seen"):
        tables.drop(name)
    return tree


def score(docs: DataFrame, tree: Tree, name: str = "score") -> DataFrame:
    """Adds a column of scores; only the text goes to Python. Null or empty texts get the score of a text without evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            raw = np.zeros(len(texts)) if model.weights is None else model.features(list(texts)) @ model.weights + model.intercept
            yield pd.Series(1 / (1 + np.exp(-np.clip(raw, -50, 50))))

    return docs.withColumn(name, scored(whole()))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row; other columns are ignored.

    Null and empty texts have the score of a text without evidence. Equal texts have equal scores, repeated rows too; a null
    doc_id is not held out. An empty table gives no rows; without labels of both classes every score is 0.5.
    """
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns whatever their names.

    Null and empty texts stay unless a text without evidence is toxic; repeated rows stay or go together; an empty table
    gives no rows. Without labels of both classes every score is 0.5, so none is left.
    """
    marked = score(docs.select("text", F.struct("*").alias("_doc")), fit(docs, labels))
    return marked.where(F.col("score") < THRESHOLD).select("_doc.*")
