"""Repeated passages by merging Burrows-Wheeler transforms.

A 50-byte string belongs to the anchor with the least hash among its 24-byte pieces, so equal strings, wherever they stand,
meet at one anchor. Anchors are only a filter: one that stands once in the corpus has no repeat. A run of strings with one
anchor is a stretch. Texts lie in chunks, and every exchange is between chunks and parts of the anchors, so however many rows
share a passage, it comes once from each chunk:

1. each chunk sends its anchors, by part; a part tells which of them others have as well;
2. the chunk sends the bytes of the stretches of those anchors, each distinct one once, with its least document;
3. where an anchor has different stretches, each shard of them gets its transform, and the transforms are merged by refining
   their interleave 50 times: a step reads the letters in the present order and sorts them stably, and a border appears
   where a letter or the group before differs. Groups without a border inside are the repeated intervals: their suffixes
   share their first 50 bytes, and their least document is known. No suffix of one shard is compared with one of another;
4. the least documents go back to the chunks, which drop what a smaller document has.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Tables, whole
from riskloom.llm.neardup import _mixed

LENGTH, PIECE = 50, 24
#: Bytes of text of a chunk (a longer text is a chunk of its own), and of the block that is hashed at a time.
CHUNK, BLOCK = 4 << 20, 1 << 17
#: Bytes of text for each part of the anchors, for each bucket of stretches, and for each bucket of the table of chunks.
PART, BUCKET, LOT = 32 << 20, 4 << 20, 16 << 20
#: Bytes of stretches with one anchor from which they no longer stay together: each of their strings is then its own anchor.
HOT = 2 << 20
#: Letters of a shard and of the shards that are merged at once; whole anchors, so one may be longer.
SHARD, MERGED = 1 << 14, 1 << 16

_U = np.uint64
_A, _B, _C = (_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_UP = np.multiply.accumulate(np.full(BLOCK + LENGTH, _A, np.uint64))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], ..., starts[i] + counts[i] - 1 of all i, one after the other."""
    out = np.arange(int(counts.sum()))
    return out + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    return np.ndarray((len(b) - 7,), "<u8", b, strides=(1,)).astype(np.uint64)


def _least(b: np.ndarray) -> np.ndarray:
    """For each 50-byte string of ``b`` the least hash of its 24-byte pieces."""
    w = _eights(b)
    h = w[: len(w) - 16] * _A
    h += w[8 : len(w) - 8] * _B
    h += w[16:] * _C
    h ^= h >> _U(29)
    h *= _B
    h ^= h >> _U(32)
    wide, want = 1, LENGTH - PIECE + 1
    while 2 * wide <= want:
        h = np.minimum(h[:-wide], h[wide:])
        wide *= 2
    return np.minimum(h[: len(h) - (want - wide)], h[want - wide :]) if want > wide else h


def _blocks(ends: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Neighbouring texts as (start, end, number), up to a block at a time; of a longer text parts that share 49 bytes."""
    now, start = [], 0
    for k, end in enumerate(ends.tolist()):
        if end - start >= LENGTH:
            if now and end - now[0][0] > BLOCK:
                yield now
                now = []
            if end - start > BLOCK:
                for at in range(start, end - LENGTH + 1, BLOCK - LENGTH + 1):
                    yield [(at, min(end, at + BLOCK), k)]
            else:
                now.append((start, end, k))
        start = end
    if now:
        yield now


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of 50-byte strings with one anchor in texts that end at ``ends``: first string, number of strings, anchor, text."""
    out = []
    for parts in _blocks(ends):
        low, high = parts[0][0], parts[-1][1]
        least = _least(data[low:high])
        fits = np.zeros(len(least) + 2, bool)  # a string fits in its text; none does before and after the block
        for start, end, _ in parts:
            fits[start - low + 1 : end - low - LENGTH + 2] = True
        change = least[1:] != least[:-1]
        first = np.flatnonzero(fits[1:-1] & (~fits[:-2] | np.concatenate(([True], change))))
        last = np.flatnonzero(fits[1:-1] & (~fits[2:] | np.concatenate((change, [True]))))
        text = np.array([k for _, _, k in parts])[np.searchsorted(np.array([s for s, _, _ in parts]), first + low, side="right") - 1]
        out.append((first + low, last - first + 1, _mixed(least[first]), text))
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, np.empty(0, np.uint64), none)


def _dealt(anchor: np.ndarray, parts: int) -> np.ndarray:
    """Part and 32 further bits of an anchor in one number, so that sorting it sorts by part."""
    return (anchor % _U(parts)) << _U(32) | anchor >> _U(32)


class Chunk:
    """Texts of a row of the table of chunks and their stretches."""

    def __init__(self, row, parts: int):
        self.doc, sizes = (np.frombuffer(row[c], np.int64) for c in ("docs", "sizes"))
        self.ends = np.cumsum(sizes)
        self.data = np.frombuffer(zlib.decompress(row["data"]), np.uint8)
        self.first, self.count, self.anchor, self.text = stretches(self.data, self.ends)
        self.key = _dealt(self.anchor, parts)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, the number of bytes of their stretches, and for each stretch its key's place."""
        keys, place = np.unique(self.key, return_inverse=True)
        return keys, np.bincount(place, weights=self.count + LENGTH - 1, minlength=len(keys)).astype(np.int64), place

    def strings(self, shared: np.ndarray, hot: np.ndarray, buckets: int) -> None:
        """Keep the shared stretches, hot ones string by string, with ``bytes``, ``mark``, and ``which`` distinct one each is."""
        cold = np.flatnonzero(shared & ~hot)
        apart = np.flatnonzero(shared & hot)
        n = self.count[apart]
        self.first = np.concatenate((self.first[cold], _spread(self.first[apart], n)))
        self.text = np.concatenate((self.text[cold], np.repeat(self.text[apart], n)))
        self.anchor = np.concatenate((self.anchor[cold], np.zeros(n.sum(), np.uint64)))
        self.count = np.concatenate((self.count[cold], np.ones(n.sum(), np.int64)))
        mark = np.empty(len(self.first), np.uint64)
        for at in range(0, len(mark), 8192):
            first, size = self.first[at : at + 8192], self.count[at : at + 8192] + LENGTH - 1
            weighed = (self.data[_spread(first, size)].astype(np.uint64) + _U(1)) * _UP[_spread(np.zeros(len(size), np.int64), size)]
            mark[at : at + 8192] = _mixed(np.add.reduceat(weighed, np.cumsum(size) - size) + size.astype(np.uint64))
        alone = slice(len(cold), None)
        self.anchor[alone] = mark[alone]
        bucket = (_mixed(self.anchor) % _U(buckets)).astype(np.int64)
        order = np.lexsort((self.doc[self.text], mark, self.anchor, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (self.anchor[order][1:] != self.anchor[order][:-1]) | (mark[order][1:] != mark[order][:-1])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.own = order[new]  # of each distinct stretch the one with the least document
        self.bucket, self.mark = bucket[self.own], mark[self.own]


def transform(letters: np.ndarray, string: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and transform of strings, each ended by a 0; ``left`` are the letters to that end, itself included.

    Sorted by packs of letters, then by doubling; suffixes that are equal up to their end go by their string's number.
    """
    n, bits = len(letters), int(letters.max()).bit_length() or 1
    step = min(62 // bits, 16)
    key, wide = np.zeros(n, np.int64), np.concatenate((letters.astype(np.int64), np.zeros(step, np.int64)))
    for j in range(step):
        key = key << bits | np.where(left > j, wide[j : j + n], 0)
    order = np.argsort(key)
    while True:
        fresh = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        if fresh[-1] == n - 1:
            break
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        after = rank[np.minimum(np.arange(n) + step, n - 1)]
        key = rank * (n + 1) + np.where(left > step, after, string)
        order = np.argsort(key)
        step *= 2
    before = np.concatenate(([0], letters[:-1])).astype(letters.dtype)  # the letter before a string's first is the 0 of the one before it
    return order, before[order]


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of shards, and where a group of suffixes with ``depth`` common letters begins in it."""
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8 if len(transforms) < 256 else np.uint16), [len(t) for t in transforms])
    group = np.zeros(len(shard), np.int32)
    every = np.concatenate(transforms)
    letters = np.empty_like(every)
    border = np.zeros(len(shard), bool)
    for _ in range(depth):
        letters[np.argsort(shard, kind="stable")] = every  # the i-th place of a shard reads its i-th letter
        order = np.argsort(letters, kind="stable")
        now, was = letters[order], group[order]
        np.not_equal(was[1:], was[:-1], out=border[1:])
        border[1:] |= now[1:] != now[:-1]
        shard, group = shard[order], np.cumsum(border, dtype=np.int32)
    return shard, group


def least_documents(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each ``depth``-byte string of the strings in ``data``, in order, the least document of a string that holds it."""
    used, codes = np.unique(data, return_inverse=True)
    letters = np.zeros(len(data) + len(sizes), np.uint8 if len(used) < 256 else np.uint16)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(letters), bool)
    inside[ends] = False
    letters[inside] = codes + 1
    string = np.repeat(np.arange(len(sizes)), sizes + 1)
    left = ends[string] - np.arange(len(letters)) + 1
    turn = (ends // SHARD)[string]  # shards are of whole strings
    cuts = np.concatenate(([0], np.flatnonzero(turn[1:] != turn[:-1]) + 1, [len(letters)]))
    made = [transform(letters[a:b], string[a:b] - string[a], left[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    shard, group = merge([t for _, t in made], depth)
    place = np.empty(len(letters), np.int64)  # where the suffix of each place of the interleave begins
    place[np.argsort(shard, kind="stable")] = np.concatenate([a + suffixes for a, (suffixes, _) in zip(cuts, made, strict=False)])
    full = left[place] > depth
    doc = np.where(full, docs[string[place]], np.iinfo(np.int64).max)
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    out = np.empty(len(letters), np.int64)
    out[place] = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.concatenate((heads, [len(doc)]))))
    return out[left > depth]


def repeated(strings: list[bytes], docs: np.ndarray, depth: int = LENGTH) -> list[np.ndarray]:
    """For each string, the places where ``depth`` bytes start that a string of a smaller document holds as well."""
    sizes = np.array([len(s) for s in strings])
    least = least_documents(np.frombuffer(b"".join(strings), np.uint8), sizes, np.asarray(docs), depth)
    cuts = np.cumsum(np.maximum(sizes - depth + 1, 0))
    return [np.flatnonzero(x < d) for x, d in zip(np.split(least, cuts[:-1]), docs, strict=True)]


def _windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 50-byte strings of the strings in ``data``, and which string each is of."""
    w = _eights(data)
    h = np.zeros(max(0, len(data) - LENGTH + 1), np.uint64)
    for k, at in enumerate((*range(0, LENGTH - 8, 8), LENGTH - 8)):
        h += w[at : at + len(h)] * _UP[k]
        h ^= h >> _U(31)
        h *= _B
    count = sizes - LENGTH + 1
    return h[_spread(starts, count)], np.repeat(np.arange(len(sizes)), count)


def _compared(anchor: np.ndarray, data: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings in the order of their anchors -> for those with a string that another one holds as well: which, and the
    least documents of all their 50-byte strings, one after the other."""
    starts = np.cumsum(sizes) - sizes
    hashes, owner = _windows(data, starts, sizes)
    _, place, times = np.unique(hashes, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[place] > 1)  # a filter: what stands once needs no merge
    count = sizes - LENGTH + 1
    base = np.cumsum(count) - count
    least = np.repeat(docs, count)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    heads = np.flatnonzero(np.concatenate(([True], owner[at][1:] != owner[at][:-1])))
    who = owner[at][heads]
    low = at[heads] - base[who]
    high = at[np.concatenate((heads[1:] - 1, [len(at) - 1]))] - base[who]
    cut, size = starts[who] + low, high - low + LENGTH
    turn, begun, last = np.zeros(len(who), np.int64), 0, None
    begin = np.flatnonzero(np.concatenate(([True], anchor[who][1:] != anchor[who][:-1])))
    for a, b in zip(begin.tolist(), np.concatenate((begin[1:], [len(who)])).tolist(), strict=True):
        n = int(size[a:b].sum()) + b - a
        if last is None or begun + n > MERGED:
            begun, last = 0, a
        begun += n
        turn[a:b] = last
    for a in np.unique(turn):
        part = np.flatnonzero(turn == a)
        got = least_documents(data[_spread(cut[part], size[part])], size[part], docs[who[part]])
        least[_spread(base[who[part]] + low[part], size[part] - LENGTH + 1)] = got
    return who, least[_spread(base[who], count[who])]


def compare(group: pd.DataFrame) -> pd.DataFrame:
    """A row for each chunk of a bucket: for its stretches, in its order, runs of 50-byte strings and their least documents."""
    of = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in group[c]])
    anchor, mark, docs, sizes, data = of("anchors", np.uint64), of("marks", np.uint64), of("docs", np.int64), of("sizes", np.uint32).astype(np.int64), of("data", np.uint8)
    starts = np.cumsum(sizes) - sizes
    order = np.lexsort((docs, mark, anchor))
    a, m = anchor[order], mark[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (m[1:] != m[:-1])))
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    own = order[new]  # equal stretches are one with the least document
    a, least, size = anchor[own], docs[own], sizes[own]
    heads = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    several = np.repeat(np.diff(np.concatenate((heads, [len(a)]))) > 1, np.diff(np.concatenate((heads, [len(a)]))))
    runs, lengths, values = np.ones(len(own), np.int64), size - LENGTH + 1, least
    if several.any():
        s = np.flatnonzero(several)
        who, found = _compared(a[s], data[_spread(starts[own[s]], size[s])], size[s], least[s])
        if len(who):
            who = s[who]
            count = size[who] - LENGTH + 1
            turn = np.ones(len(found), bool)
            turn[1:] = found[1:] != found[:-1]
            turn[np.cumsum(count) - count] = True
            heads = np.flatnonzero(turn)
            runs[who] = np.add.reduceat(turn.astype(np.int64), np.cumsum(count) - count)
            base = np.cumsum(runs) - runs
            long_, vals = np.repeat(lengths, runs), np.repeat(values, runs)
            at = _spread(base[who], runs[who])
            long_[at], vals[at] = np.diff(np.concatenate((heads, [len(found)]))), found[heads]
            lengths, values = long_, vals
    base = np.cumsum(runs) - runs
    out, at = [], 0
    for chunk, n in zip(group["chunk"], [len(x) // 8 for x in group["marks"]], strict=True):
        mine = which[at : at + n]
        at += n
        all_ = _spread(base[mine], runs[mine])
        out.append((chunk, 1, group["bucket"].iloc[0], runs[mine].astype(np.uint32).tobytes(), lengths[all_].astype(np.uint32).tobytes(), values[all_].tobytes()))
    return pd.DataFrame(out, columns=["chunk", "kind", "number", "x", "y", "z"])


def settle(group: pd.DataFrame) -> pd.DataFrame:
    """A row for each chunk of a part: a bit for each of its anchors that stands elsewhere as well, and for each hot one."""
    keys, sizes = (np.concatenate([np.frombuffer(x, np.uint32) for x in group[c]]) for c in ("keys", "sizes"))
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    size = np.add.reduceat(sizes[order].astype(np.int64), heads)
    times = np.diff(np.concatenate((heads, [len(keys)])))
    code = np.empty(len(keys), np.uint8)  # an even size: one stretch of one text; the last bit says more
    more = np.bitwise_or.reduceat(sizes[order] & 1, heads) > 0
    code[order] = np.repeat(np.where((times > 1) | more, np.where(size // 2 > HOT, 3, 1), 0), times)
    out, at = [], 0
    for chunk, n in zip(group["chunk"], [len(x) // 4 for x in group["keys"]], strict=True):
        own = code[at : at + n]
        at += n
        if own.any():
            out.append((chunk, 0, group["part"].iloc[0], np.packbits(own & 1).tobytes(), np.packbits(own >> 1).tobytes() if (own > 1).any() else None, None))
    return pd.DataFrame(out, columns=["chunk", "kind", "number", "x", "y", "z"], dtype=object).astype({"chunk": "int64", "kind": "int32", "number": "int32"})


ANSWER = "chunk long, kind int, number int, x binary, y binary, z binary"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of ``docs``; other columns are ignored.

    Null text: empty. Equal texts are looked at once, with their least doc_id; those of a greater doc_id go whole from 50
    bytes on. Rows with one doc_id take nothing from each other, be their texts equal or not. Rows without a doc_id come
    after all others. Empty tables give no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"), F.unhex(F.md5(whole())).alias("mark"), whole().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts, buckets, lots = max(4, -(-total // PART)), max(8, -(-total // BUCKET)), max(8, -(-total // LOT))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            text = batch["text"].cast(pa.large_binary())
            cuts = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset)
            data = memoryview(text.buffers()[2] or b"")
            own, mark = batch["doc"].to_numpy(zero_copy_only=False), batch["mark"].to_pylist()
            at = 0
            while at < len(text):
                to = min(len(text), max(at + 1, int(np.searchsorted(cuts, cuts[at] + CHUNK))))
                name = int.from_bytes(mark[at][:8], "little", signed=True)  # a text is in one chunk, so its hash names it
                yield pa.RecordBatch.from_pylist([{"chunk": name, "docs": own[at:to].tobytes(), "sizes": np.diff(cuts[at : to + 1]).tobytes(), "marks": b"".join(mark[at:to]), "data": zlib.compress(data[int(cuts[at]) : int(cuts[to])], 1)}], schema=chunk_schema)
                at = to

    chunk_schema = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("marks", pa.binary()), ("data", pa.binary())])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, parts)
                keys, sizes, place = chunk.anchors()
                # twice the size, and 1 more where several stretches have the anchor
                sizes = np.minimum(2 * sizes, 2**31).astype(np.uint32) + (np.bincount(place, minlength=len(keys)) > 1)
                part, low = (keys >> _U(32)).astype(np.int64), keys.astype(np.uint32)
                heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else part
                cut = list(zip(heads, [*heads[1:], len(part)], strict=True)) if len(part) else []
                yield pa.RecordBatch.from_pydict({"part": part[heads].astype(np.int32), "chunk": np.full(len(heads), row["chunk"], np.int64), "keys": [low[a:b].tobytes() for a, b in cut], "sizes": [sizes[a:b].astype(np.uint32).tobytes() for a, b in cut]}, schema=part_schema)

    part_schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary())])

    def opened(row, answers: pd.DataFrame) -> Chunk | None:
        """The chunk with its shared stretches, or nothing if it has none."""
        bits = {r["number"]: (r["x"], r["y"]) for _, r in answers[answers["kind"] == 0].iterrows()}
        if not bits:
            return None
        chunk = Chunk(row, parts)
        keys, _, place = chunk.anchors()
        part = (keys >> _U(32)).astype(np.int64)
        flags = np.zeros((2, len(keys)), bool)
        for number, both in bits.items():
            a, b = np.searchsorted(part, [number, number + 1])
            for k, packed in enumerate(both):
                if packed is not None:
                    flags[k, a:b] = np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a).astype(bool)
        chunk.strings(flags[0][place], flags[1][place], buckets)
        return chunk

    def located(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in chunks.iterrows():
            if (chunk := opened(row, answers)) is None:
                continue
            heads = np.flatnonzero(np.concatenate(([True], chunk.bucket[1:] != chunk.bucket[:-1])))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(chunk.bucket)], strict=True):
                own = chunk.own[a:b]
                size = chunk.count[own] + LENGTH - 1
                out.append((chunk.bucket[a], row["chunk"], chunk.anchor[own].tobytes(), chunk.mark[a:b].tobytes(), chunk.doc[chunk.text[own]].tobytes(), size.astype(np.uint32).tobytes(), chunk.data[_spread(chunk.first[own], size)].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "chunk", "anchors", "marks", "docs", "sizes", "data"], dtype=object).astype({"bucket": "int32", "chunk": "int64"})

    def finished(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in chunks.iterrows():
            chunk = opened(row, answers)
            spans: dict[int, list[tuple[int, int]]] = {}
            if chunk is not None:
                for text, low, high in zip(*removed(chunk, answers), strict=True):
                    spans.setdefault(text, []).append((low, high))
                data, ends, own = chunk.data, chunk.ends, chunk.doc
            else:
                own, ends = np.frombuffer(row["docs"], np.int64), np.cumsum(np.frombuffer(row["sizes"], np.int64))
                data = np.frombuffer(zlib.decompress(row["data"]), np.uint8)
            data, start = data.tobytes(), 0
            for k, (d, end) in enumerate(zip(own.tolist(), ends.tolist(), strict=True)):
                kept, at, gone = hashlib.sha256(), start, 0
                for low, high in spans.get(k, ()):
                    kept.update(data[at:low])
                    at, gone = high, gone + high - low
                kept.update(data[at:end])
                out.append((row["marks"][16 * k : 16 * k + 16], d, end - start, gone, len(spans.get(k, ())), kept.hexdigest()))
                start = end
        return pd.DataFrame(out, columns=["mark", "least", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def removed(chunk: Chunk, answers: pd.DataFrame) -> tuple[list[int], list[int], list[int]]:
        """Text, start and end of the maximal runs that go, in order."""
        found = answers[answers["kind"] == 1].sort_values("number")
        runs, lengths, least = (np.concatenate([np.frombuffer(x, t) for x in found[c]]).astype(np.int64) for c, t in (("x", np.uint32), ("y", np.uint32), ("z", np.int64)))
        base = np.cumsum(runs) - runs
        n = runs[chunk.which]
        at = _spread(base[chunk.which], n)  # the runs of each stretch, one after the other
        stretch = np.repeat(np.arange(len(n)), n)
        length = lengths[at]
        sums = np.cumsum(length) - length
        low = chunk.first[stretch] + sums - np.repeat(sums[np.cumsum(n) - n], n)
        hit = np.flatnonzero(least[at] < chunk.doc[chunk.text[stretch]])
        hit = hit[np.argsort(low[hit])]
        low, high, text = low[hit], low[hit] + length[hit] + LENGTH - 1, chunk.text[stretch[hit]]
        if not len(low):
            return [], [], []
        top = np.maximum.accumulate(high)
        heads = np.concatenate(([True], (low[1:] > top[:-1]) | (text[1:] != text[:-1])))
        heads = np.flatnonzero(heads)
        return text[heads].tolist(), low[heads].tolist(), top[np.concatenate((heads[1:] - 1, [len(low) - 1]))].tolist()

    texts = rows.groupBy("mark").agg(F.min("doc").alias("doc"), F.first("text").alias("text"))
    table = f"riskloom_chunks_{uuid.uuid4().hex}"  # bucketed, so that no later step moves a text
    try:
        made = texts.mapInArrow(chunked, "chunk long, docs binary, sizes binary, marks binary, data binary")
        made.write.option("path", f"{tables.root}/chunks").bucketBy(lots, "chunk").saveAsTable(table)
        chunks = spark.table(table)
        anchors = chunks.mapInArrow(gathered, "part int, chunk long, keys binary, sizes binary")
        shared = tables.put(anchors.groupBy("part").applyInPandas(settle, ANSWER), "shared")
        strings = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(located, "bucket int, chunk long, anchors binary, marks binary, docs binary, sizes binary, data binary")
        least = tables.put(strings.groupBy("bucket").applyInPandas(compare, ANSWER), "least")
        done = chunks.groupBy("chunk").cogroup(shared.unionByName(least).groupBy("chunk")).applyInPandas(finished, "mark binary, least long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        done = tables.put(done, "done")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        for name in ("chunks", "shared", "least"):
            tables.drop(name)
    copy = (F.col("doc") > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    of = lambda gone, kept, name: F.when(copy, gone).otherwise(kept).alias(name)
    found = rows.select("doc_id", "doc", "mark").join(done, "mark")
    return found.select("doc_id", "n_bytes", of(F.col("n_bytes"), F.col("n_removed"), "n_removed"), of(F.lit(1).cast("long"), F.col("n_spans"), "n_spans"), of(F.lit(hashlib.sha256().hexdigest()), F.col("kept_sha256"), "kept_sha256"))
