"""Ranked lexical search: a tree of maxima over document ranges per term, searched best first.

A pass over the texts writes, for each document, its query terms and their frequencies; the totals that the weights need are
aggregated from them. A second pass reads these postings where they lie, in shards. In a shard every term has a tree: the
largest score that it gives a document of a range, for ranges of 16, 256, ... documents. The bound of a range for an item is
the sum over the item's terms. A queue opens the range of the highest bound first, until no bound reaches the score of the
item's k-th document so far; a bound equal to it is opened, as a tie may go to a smaller id. What an item has found goes on
from shard to shard of a task; the tasks' best meet in one window an item.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Tables

#: Bytes of item texts that share one pass, as their terms are sent to every task; more items take more passes.
ITEMS = 4 << 20
#: Documents and cells of the lowest level of the tree that a shard holds, and the children of a node.
SHARD, CELLS, FAN = 4_096, 1 << 21, 16
#: Bytes of a text that are split into terms at once.
PIECE = 4 << 20

_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def frequencies(raw: bytes) -> Counter:
    """Terms of a UTF-8 text: runs of ASCII letters and digits and of whatever lies beyond ASCII, A-Z lower-cased."""
    raw, out, start = raw.translate(_LETTERS), Counter(), 0
    while start < len(raw):
        end = raw.find(b" ", start + PIECE)
        end = len(raw) if end < 0 else end
        out.update(raw[start:end].split())
        start = end
    return out


class Shard:
    """The postings of some documents, and the trees of their terms. Documents with like terms and lengths lie together."""

    def __init__(self, ids: list, sizes: np.ndarray, terms: np.ndarray, scores: np.ndarray, vocabulary: int):
        first = np.cumsum(sizes) - sizes
        top = np.maximum.reduceat(scores, first)
        lead = np.zeros(len(sizes), np.int64)  # the term that says most of a document
        at = np.flatnonzero(scores == np.repeat(top, sizes))
        lead[np.repeat(np.arange(len(sizes)), sizes)[at]] = terms[at]
        order = np.lexsort((sizes, lead))
        take = np.repeat(first[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) + np.arange(len(terms))
        self.ids, sizes = [ids[i] for i in order], sizes[order]
        self.first = np.r_[0, np.cumsum(sizes)]
        self.scores = scores[take]
        present, self.local = np.unique(terms[take], return_inverse=True)
        self.rows = np.full(vocabulary, -1, np.int64)
        self.rows[present] = np.arange(len(present))
        self.weight = np.zeros(len(present), np.int64)
        level = np.zeros((len(present), -(-len(sizes) // FAN)), np.int64)
        np.maximum.at(level, (self.local, np.repeat(np.arange(len(sizes)) // FAN, sizes)), self.scores)
        self.levels = [level]
        while level.shape[1] > 1:
            level = np.pad(level, ((0, 0), (0, -level.shape[1] % FAN))).reshape(len(present), -1, FAN).max(2)
            self.levels.append(level)

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, best: list[tuple]) -> int:
        """Adds to ``best``, (-score, id is null, id) in order, what belongs to the k best; gives the opened documents."""
        rows = self.rows[terms]
        rows, times = rows[rows >= 0], times[rows >= 0]
        if not len(rows):
            return 0
        self.weight[rows] = times
        opened, last = 0, len(self.levels) - 1
        least = max(1, -best[-1][0]) if len(best) == k else 1
        queue = [(-int(times @ self.levels[last][rows, 0]), last, 0)]
        while queue and -queue[0][0] >= least:
            _, depth, node = heapq.heappop(queue)
            low = node * FAN
            if depth:
                bounds = times @ self.levels[depth - 1][rows, low : low + FAN]
                for j in np.flatnonzero(bounds >= least).tolist():
                    heapq.heappush(queue, (-int(bounds[j]), depth - 1, low + j))
                continue
            high = min(low + FAN, len(self.ids))
            opened += high - low
            a, b = self.first[low], self.first[high]
            found = np.add.reduceat(self.scores[a:b] * self.weight[self.local[a:b]], self.first[low:high] - a)
            for j in np.flatnonzero(found >= least).tolist():
                own = self.ids[low + j]
                bisect.insort(best, (-int(found[j]), own is None, own or 0))
                if len(best) >= k:
                    del best[k:]
                    least = max(1, -best[-1][0])
        self.weight[rows] = 0
        return opened


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of the highest scores above 0 for each item.

    Equal scores go by the smaller id, null last. Null and empty texts have no terms: such documents are not counted and
    such items have no rows. Rows of ``docs`` that share an id are documents of their own, so an id may come twice; items
    that repeat id and text count once, and those of one id with several texts are ranked each. Empty tables give no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    asked = items.select(F.col(item).alias("item_id"), F.col(query).cast("binary").alias("raw")).where("octet_length(raw) > 0").distinct()
    total = asked.agg(F.sum(F.octet_length("raw"))).first()[0]
    nothing = spark.createDataFrame([], f"item_id {items.schema[item].dataType.simpleString()}, rank int, doc_id long, score long")
    if not total:
        return nothing
    parts = -(-total // ITEMS)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("item_id", "raw"), F.lit(parts)))
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("raw")).where("octet_length(raw) > 0")
    done = [_pass(texts, asked.where(F.col("part") == p).select("item_id", "raw").toArrow(), k, tables, p) for p in range(parts)]
    done = [d for d in done if d is not None]
    if not done:
        return nothing
    found = reduce(DataFrame.unionByName, done)
    best = Window.partitionBy("part", "item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def _pass(texts: DataFrame, asked: pa.Table, k: int, tables: Tables, part: int) -> DataFrame | None:
    """The candidates of one part of the items, at most k an item and task."""
    spark = texts.sparkSession
    vocabulary: dict[bytes, int] = {}
    wanted = []
    for raw in asked["raw"].to_pylist():
        counts = frequencies(raw)
        wanted.append((np.array([vocabulary.setdefault(w, len(vocabulary)) for w in counts], np.int64), np.array(list(counts.values()), np.int64)))
    if not vocabulary:
        return None
    known = spark.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in batches:
            ids, lengths, ends, terms, times = [], [], [0], [], []
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = frequencies(raw.as_py())
                if not counts:
                    continue
                for w in known.value.keys() & counts.keys():
                    terms.append(number(w))
                    times.append(counts[w])
                ids.append(own)
                lengths.append(counts.total())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), *lists], ["id", "n", "terms", "times"])

    posts = tables.put(texts.mapInArrow(counted, "id long, n long, terms array<int>, times array<long>"), f"posts-{part}")
    count, words = posts.agg(F.count("*"), F.sum("n")).first()
    if not count:
        return None
    held = np.zeros(len(vocabulary), np.int64)
    for term, df in posts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # no more than the part's terms
        held[term] = df
    weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
    shared = spark.sparkContext.broadcast((wanted, weights, int(count), int(words)))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, count, words = shared.value
        best: list[list] = [[] for _ in wanted]
        for ids, sizes, terms, scores in _shards(batches, weights, count, words):
            shard = Shard(ids, sizes, terms, scores, len(weights))
            for (own, times), found in zip(wanted, best, strict=True):
                shard.search(own, times, k, found)
        rows = [(i, None if void else own, -score) for i, found in enumerate(best) for score, void, own in found]
        at = [list(x) for x in zip(*rows, strict=True)] or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in at], ["item", "id", "score"])

    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(asked)), pa.int64()), "item_id": asked["item_id"]}))
    found = tables.put(posts.mapInArrow(searched, "item long, id long, score long"), f"found-{part}")
    tables.drop(f"posts-{part}")
    return found.join(names, "item").withColumn("part", F.lit(part))


def _shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, count: int, words: int) -> Iterator[tuple]:
    """Ids, numbers of postings, terms and scores of documents that fit a shard; those without a query term are left out."""
    ids, parts, cells = [], [], 0
    for batch in batches:
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        n, terms, times = batch.column("n").to_numpy(), batch.column("terms").flatten().to_numpy(), batch.column("times").flatten().to_numpy()
        m = 75 + (25 * n * count) // words
        scores = weights[terms] * ((10**9 * times) // (1000 * times + 12 * np.repeat(m, sizes)))
        first = np.cumsum(sizes) - sizes
        for i, own in enumerate(batch.column("id").to_pylist()):
            if not sizes[i]:
                continue
            if ids and (len(ids) >= SHARD or min(cells + sizes[i], len(weights)) * (len(ids) // FAN + 1) > CELLS):
                yield _shard(ids, parts)
                ids, parts, cells = [], [], 0
            ids.append(own)
            parts.append((terms[first[i] : first[i] + sizes[i]], scores[first[i] : first[i] + sizes[i]]))
            cells += int(sizes[i])
    if ids:
        yield _shard(ids, parts)


def _shard(ids: list, parts: list) -> tuple:
    return ids, np.array([len(t) for t, _ in parts]), np.concatenate([t for t, _ in parts]).astype(np.int64), np.concatenate([s for _, s in parts])


ORACLE = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, docs),
scored AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l))))::BIGINT AS score
  FROM tf JOIN asked USING (term) JOIN w USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
