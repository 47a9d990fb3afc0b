"""Best-fit packing of token sequences by linear grouping.

Only a histogram of piece lengths, of at most ``size`` rows, comes to the driver. There the large lengths are put in groups
of equal cardinality and rounded up to the group's largest, patterns over those few sizes are chosen by column generation,
the actual lengths take the patterns' places, and the rest is placed best-fit, longest first. The plan gives each length's
ranks their sequences; pieces find theirs by their rank, so no task sees more than a range of pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import Tables, small_batches

SIZE, END = 4096, 1
#: Lengths above size / LARGE are grouped; GROUPS groups of equal cardinality.
LARGE, GROUPS = 8, 20
#: Pieces of one length that one task ranks.
RANKED = 50_000
#: Words that one generation of a worker's encoder holds, about 160 bytes each.
CACHE = 290_000

_OTHER = re.compile("[^\x00-\u024f]")
#: Marks that may end a word of letters; without the apostrophe, which can begin a piece of the tokenizer with the letters after it.
_MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{}~\""
#: Bytes of text whose words are looked up at once.
_PART = 4 << 20
#: What a tokenizer must do before its merges to be used word by word; texts of any other are encoded whole.
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class _Encoder:
    """Texts -> their ids, one after the other, and where each text's end.

    A tokenizer that never joins over a blank, nor over a letter and a mark after it, encodes each distinct word once; words
    are kept in two generations of at most CACHE each. It lower-cases; texts of Latin letters are put in lower case before,
    which gives the same ids from fewer words. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.model, self.known, self.older = Tokenizer.from_file(path), {}, {}
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.wordwise = all(told.get(k) == v for k, v in _WORDWISE.items()) and told["model"].get("end_of_word_suffix") == "</w>"
        self.ends = np.zeros(max(self.model.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        for at in range(0, len(plain), 512):  # one text of letter words: each is a piece of its own, so its last id ends a word
            part = plain[at : at + 512]
            ids = self._ids([" ".join(part)])[0]
            cut, raw = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
            if len(cut) == len(part):
                self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *cut], cut, strict=False)], strict=True))
        rest = [w for w in words if w not in self.known]
        self.known.update(zip(rest, [x.tobytes() for x in self._ids(rest)], strict=True))

    def _look_up(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known, self.older, new = {}, self.known, words
        old = [w for w in new if w in self.older]
        self.known.update(zip(old, map(self.older.__getitem__, old), strict=True))
        self._learn([w for w in new if w not in self.older])
        return list(map(self.known.__getitem__, words))

    def _parted(self, words: pa.Array) -> tuple[list[str], np.ndarray]:
        """Letters and the marks after them have their ids apart: distinct parts, and the two of each distinct word."""
        bases = pc.utf8_rtrim(words, _MARKS)
        marked = pc.not_equal(pc.binary_length(bases), pc.binary_length(words)).to_numpy(zero_copy_only=False)
        coded = bases.dictionary_encode()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = np.zeros((len(words), 2), np.int64)
        which[:, 0] = coded.indices.to_numpy()
        place = {}
        for i, w in zip(np.flatnonzero(marked).tolist(), words.filter(pa.array(marked)).to_numpy(zero_copy_only=False).tolist(), strict=True):
            base = parts[which[i, 0]]
            if base and base[-1].isalpha() and base[-1] < "\u0250":
                which[i, 1] = place.setdefault(w[len(base) :], len(place) + 1)
            else:
                which[i, 0] = -place.setdefault(w, len(place) + 1)
        which[:, 1] = np.where(which[:, 1] > 0, len(parts) + which[:, 1], len(parts))
        which[:, 0] = np.where(which[:, 0] < 0, len(parts) - which[:, 0], which[:, 0])
        return [*parts, "", *place], which

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.wordwise:
            ids = self._ids(texts)
            return np.concatenate(ids) if ids else np.zeros(0, "<u4"), np.cumsum([len(x) for x in ids])
        texts = [t if "<|" in t or _OTHER.search(t) else t.lower() for t in texts]
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        parts, which = self._parted(words.dictionary)
        ids = self._look_up(parts)
        ids, ends = _taken(np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64), which.ravel())
        ids, ends = _taken(ids, np.diff(ends[::2]), words.indices.to_numpy())
        return ids, ends[cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()]


def _taken(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces of ``values``, those named by ``which`` one after the other, and where each begins, and the end."""
    counts = sizes[which]
    ends = np.concatenate(([0], np.cumsum(counts)))
    starts = (np.cumsum(sizes) - sizes)[which]
    return values[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], counts)], ends


_encoders: dict[str, _Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, position: Column | None = None) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32, and the document's ``position`` if given.

    ``row`` tells repeated rows apart. Null text: only the end id.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, last = _encoders.setdefault(tokenizer, None) or _Encoder(tokenizer), np.array([end], "<u4").tobytes()
        _encoders[tokenizer] = encode  # a worker keeps its words from task to task
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch["text"]]
            turn = np.cumsum([len(t) for t in texts]) // _PART
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(turn)) + 1):
                ids, ends = encode([texts[i] for i in part])
                raw, start = ids.tobytes(), 0
                for doc, row, at_, to in zip(batch["doc_id"].iloc[part], batch["row"].iloc[part], batch["position"].iloc[part], (4 * ends).tolist(), strict=True):
                    own = raw[start:to] + last
                    start = to
                    for k, at in enumerate(range(0, len(own), 4 * size)):
                        piece = own[at : at + 4 * size]
                        rows.append((doc, row, k, at // 4, len(piece) // 4, zlib.crc32(piece), at_))
            yield pd.DataFrame(rows, columns=["doc_id", "row", "piece", "start", "length", "ids_crc32", "position"])

    place = F.lit(None).cast("double") if position is None else position
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text", place.alias("position"))
    out = rows.mapInPandas(cut, "doc_id long, row long, piece int, start long, length long, ids_crc32 long, position double")
    return out if position is not None else out.drop("position")


@dataclass
class Plan:
    """For each length its runs of ranks: the first rank, sequence and offset, and how many stand side by side."""

    keys: np.ndarray  # length << 44 | first rank, sorted
    sequences: np.ndarray
    offsets: np.ndarray
    side: np.ndarray
    count: int


def _patterns(sizes: list[int], counts: list[int], size: int) -> dict[tuple[int, ...], int]:
    """Whole copies of patterns over few sizes: the linear relaxation by column generation, rounded down."""
    m = len(sizes)
    columns = [np.eye(m)[i] * (size // s) for i, s in enumerate(sizes)]
    need, basis = np.array(counts, float), np.array(columns).T
    for _ in range(30 * m):
        try:
            value = np.linalg.solve(basis.T, np.ones(m))
        except np.linalg.LinAlgError:
            break
        best, pick = np.zeros(size + 1), np.full(size + 1, -1)
        unit = sizes[-1]
        for room in range(unit, size + 1):  # unbounded knapsack of the dual values
            best[room], pick[room] = best[room - 1], -2
            for i, s in enumerate(sizes):
                if s <= room and best[room - s] + value[i] > best[room] + 1e-12:
                    best[room], pick[room] = best[room - s] + value[i], i
        if best[size] <= 1 + 1e-7:
            break
        column, room = np.zeros(m), size
        while room >= unit:
            if pick[room] == -2:
                room -= 1
            else:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        way, amount = np.linalg.solve(basis, column), np.linalg.solve(basis, need)
        able = way > 1e-9
        if not able.any():
            break
        leave = np.flatnonzero(able)[np.argmin(amount[able] / way[able])]
        basis[:, leave] = column
    amount = np.linalg.solve(basis, need)
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for j in range(m):
        if (n := int(np.floor(amount[j] + 1e-9))) > 0:
            out[tuple(basis[:, j].round().astype(int))] += n
    return out


def plan(histogram: dict[int, int], size: int = SIZE) -> Plan:
    left = {s: n for s, n in histogram.items() if n > 0}
    done: list[tuple[int, tuple]] = []  # sequences, and what stands in each: (length, how often) nested
    if n := left.pop(size, 0):
        done.append((n, ((size, 1), None)))
    bins: dict[int, list[list]] = defaultdict(list)  # by room left: [sequences, what stands in them]

    large = sorted((s for s in left if s > size // LARGE), reverse=True)
    total = sum(left[s] for s in large)
    if total:
        groups, each, at = [], -(-total // GROUPS), 0
        for s in large:
            if not groups or at >= each:
                groups.append([])
                at = 0
            groups[-1].append(s)
            at += left[s]
        rounded = [g[0] for g in groups]
        for pattern, n in _patterns(rounded, [sum(left[s] for s in g) for g in groups], size).items():
            slots = [g for g, k in enumerate(pattern) for _ in range(k)]
            while n and slots:
                heads = [next((s for s in groups[g] if left[s] > 0), 0) for g in slots]
                slots = [g for g, s in zip(slots, heads, strict=True) if s]
                heads = [s for s in heads if s]
                if not heads:
                    break
                times = {s: heads.count(s) for s in heads}
                k = min([n, *(left[s] // t for s, t in times.items())])
                if not k:  # the last of a length: one sequence of what there is
                    k, times = 1, {s: min(t, left[s]) for s, t in times.items()}
                node = None
                for s, t in times.items():
                    node = ((s, t), node)
                    left[s] -= k * t
                bins[size - sum(s * t for s, t in times.items())].append([k, node])
                n -= k

    rooms = sorted(bins)
    import bisect

    def put(room: int, n: int, node: tuple) -> None:
        if room == 0:
            done.append((n, node))
            return
        if room not in bins or not bins[room]:
            if (i := bisect.bisect_left(rooms, room)) == len(rooms) or rooms[i] != room:
                rooms.insert(i, room)
        bins[room].append([n, node])

    for s in sorted((s for s in left if left[s] > 0), reverse=True):
        n = left[s]
        while n:
            i = bisect.bisect_left(rooms, s)
            while i < len(rooms) and not bins[rooms[i]]:
                rooms.pop(i)
            room = rooms[i] if i < len(rooms) else size
            times = min(room // s, n)
            if i < len(rooms):
                have, node = bins[room][-1]
                k = min(have, n // times)
                if k == have:
                    bins[room].pop()
                else:
                    bins[room][-1][0] -= k
            else:
                k, node = n // times, None
            n -= k * times
            put(room - s * times, k, ((s, times), node))
    done += [(n, node) for room in bins for n, node in bins[room]]

    rank, first = defaultdict(int), 0
    rows = []
    for n, node in done:
        stand = []
        while node:
            stand.append(node[0])
            node = node[1]
        offset = 0
        for s, t in reversed(stand):
            rows.append((s << 44 | rank[s], first, offset, t))
            rank[s] += n * t
            offset += s * t
        first += n
    assert all(rank[s] == n for s, n in histogram.items())
    keys, seq, off, side = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    return Plan(keys, seq, off, side, first)


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``size``; within a sequence they leave no gap.

    With a column ``position`` in [0, 1], pieces of one length take their places in its order, so that those of a sequence
    lie near each other in training time.
    """
    spark = cut.sparkSession
    lengths = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    shared = spark.sparkContext.broadcast(plan(lengths, size))
    # A length that many pieces share is ranked in several ranges of the hash; before each stand the counts of those before it.
    parts = {s: -(-n // RANKED) for s, n in lengths.items() if n > RANKED}
    number = F.coalesce(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])[F.col("length")], F.lit(1)) if parts else F.lit(1)
    placed_ = "position" in cut.columns
    part = F.least(F.floor(F.coalesce("position", F.lit(0.0)) * number), number - 1) if placed_ else F.pmod("_hash", number)
    ranged = cut.withColumn("_hash", F.xxhash64("doc_id", "row", "piece")).withColumn("_part", part.cast("long"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("length", "_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("length", "_part").orderBy(*["position"] * placed_, "_hash", "doc_id", "row", "piece")
    ranked = ranged.withColumn("_rank", F.row_number().over(inside) - 1).join(sums, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["_rank"].to_numpy(np.int64)
            run = np.searchsorted(p.keys, length << 44 | rank, side="right") - 1
            beyond = rank - (p.keys[run] & ((1 << 44) - 1))
            yield batch.drop(columns="_rank").assign(sequence_id=p.sequences[run] + beyond // p.side[run], offset=p.offsets[run] + beyond % p.side[run] * length)

    kept = ranked.select(*cut.columns, F.col("_rank").cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return kept.mapInPandas(placed, f"{schema}, sequence_id long, offset long")


def training_order(docs: DataFrame) -> tuple[DataFrame, Column | None]:
    """The documents with the place of each row in its files, in [0, 1], if they are read from files in training order."""
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    except AnalysisException:  # not files: no order is known
        return docs, None
    files = placed.groupBy("_file").agg(F.count("*").alias("_rows"))
    everything = Window.orderBy("_file")
    before = F.coalesce(F.sum("_rows").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("_file", before.alias("_before"), F.sum("_rows").over(Window.partitionBy(F.lit(0))).alias("_all"))  # one row a file
    # Without the hint all texts are shuffled before Spark sees that the other side is one row a file.
    return placed.join(F.broadcast(files), "_file"), (F.col("_before") + F.col("_index")) / F.col("_all")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, position: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and position and sequence_position,
    the mean of its pieces by length, if a position is given.

    The pieces are written once, so each text is tokenized once. Null and empty texts are one piece of the end id; equal
    texts and repeated rows are packed each; pieces of one length and position go by a hash. Extra columns are ignored; an
    empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        cut = Tables(docs.sparkSession).put(pieces(docs, tokenizer, size, position=position), "pieces")
    out = pack(cut, size).drop("row")
    if position is None:
        return out
    means = Window.partitionBy("sequence_id")
    return out.withColumn("sequence_position", F.sum(F.col("position") * F.col("length")).over(means) / F.sum("length").over(means))
