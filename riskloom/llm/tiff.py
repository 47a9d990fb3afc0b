"""Media columns: TIFF files in a binary column, decoded to one row per page."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 format: tags, field types with their widths, and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

#: Payload rows of WIDTH_OF_PAYLOAD samples; rows a strip and rows a page of the files that ``encode`` writes.
WIDTH_OF_PAYLOAD, STRIP_ROWS, PAGE_ROWS = 576, 64, 1024


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray  # height, width, samples


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while at + run < len(data) and run < 128 and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
        else:
            end = at + 1
            while end < len(data) and end - at < 128 and (end + 1 >= len(data) or data[end] != data[end + 1]):
                end += 1
            out += bytes((end - at - 1,)) + data[at:end]
            at = end
    return bytes(out)


def decode_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early; 256 clears and 257 ends."""
    out, table, width, bits, held = bytearray(), [], 9, 0, 0
    last = b""
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data without a clear code")
        if code < len(table):
            now = table[code]
        elif last:
            now = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += now
        if last:
            table.append(last + now[:1])
        last = now
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out[:size])


def encode_lzw(data: bytes) -> bytes:
    """Each code is written in the width that the decoder has by then: its table is one entry behind."""
    out, bits, held = bytearray(), 0, 0
    table, width = {bytes((i,)): i for i in range(256)}, 9

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    put(256)
    n, now = 258, b""
    for i in range(len(data)):
        longer = now + data[i : i + 1]
        if longer in table:
            now = longer
            continue
        put(table[now])
        table[longer], n = n, n + 1
        width = max(9, n.bit_length())
        if n >= 4093:
            put(256)
            table, n, width = {bytes((k,)): k for k in range(256)}, 258, 9
        now = data[i : i + 1]
    if now:
        put(table[now])
        width = max(9, (n + 1).bit_length())
    put(257)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


def _unpacked(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        return data[:size]
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)[:size]
    if scheme == PACKBITS:
        return unpack_bits(data, size)
    if scheme == LZW:
        return decode_lzw(data, size)
    raise ValueError(f"compression {scheme} is not known")


#: No scheme makes more bytes of one: a header that asks for more is broken, and nothing is set aside for it.
EXPANDS = 4096


def _packed(data: bytes, scheme: int) -> bytes:
    return {NONE: lambda: data, DEFLATE: lambda: zlib.compress(data, 1), PACKBITS: lambda: pack_bits(data), LZW: lambda: encode_lzw(data)}[scheme]()


def read(data: bytes) -> Iterator[Page]:
    """Walk the chain of image directories. Raises ValueError where the file is broken, after the pages before."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("the chain of directories is broken")
        seen.add(at)
        try:
            (n,) = struct.unpack_from(f"{order}H", data, at)
            tags = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
                if kind in TYPES:
                    code, wide = TYPES[kind]
                    place = at + 10 + 12 * k
                    if count * wide > 4:
                        (place,) = struct.unpack_from(f"{order}I", data, place)
                    tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
            (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
            yield _page(data, tags)
        except (struct.error, KeyError, IndexError, zlib.error) as e:
            raise ValueError(f"broken page: {e}") from e


def _page(data: bytes, tags: dict[int, tuple[int, ...]]) -> Page:
    one = lambda tag, default=None: tags[tag][0] if default is None else tags.get(tag, (default,))[0]
    width, height, samples, scheme, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if any(b != 8 for b in tags.get(BITS, (1,))) or predictor not in (1, 2):
        raise ValueError("only samples of 8 bits and predictors 1 and 2 are read")
    tiled, apart = TILE_OFFSETS in tags, one(PLANAR, 1) == 2
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if min(w, h, samples) < 1:
        raise ValueError("empty strips or tiles")
    starts, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    if width * height * samples > EXPANDS * sum(min(c, len(data)) for c in counts):
        raise ValueError("more samples than the strips or tiles can hold")
    pixels, k = np.zeros((height, width, samples), np.uint8), 0
    for plane in range(samples if apart else 1):
        depth = 1 if apart else samples
        for y in range(0, height, h):
            for x in range(0, width, w):
                rows = h if tiled else min(h, height - y)
                raw = np.frombuffer(_unpacked(data[starts[k] : starts[k] + counts[k]], scheme, rows * w * depth), np.uint8)
                if len(raw) != rows * w * depth:
                    raise ValueError("a strip or tile is too short")
                block = raw.reshape(rows, w, depth)
                if predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=np.uint8)
                part = pixels[y : y + rows, x : x + w, plane : plane + depth] if apart else pixels[y : y + rows, x : x + w]
                part[:] = block[: part.shape[0], : part.shape[1]]
                k += 1
    return Page(width, height, samples, scheme, predictor, tiled, pixels)


def write(pages: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 2, strip: int = STRIP_ROWS, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file of pages of shape (height, width, samples), in strips or tiles of (height, width)."""
    out, link = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for pixels in pages:
        height, width, samples = pixels.shape
        h, w = tile or (min(strip, height), width)
        places, sizes = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                block = pixels[y : y + h, x : x + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)), mode="edge")
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                packed = _packed(block.astype(np.uint8).tobytes(), scheme)
                places.append(len(out))
                sizes.append(len(packed))
                out += packed + b"\0" * (len(packed) % 2)
        tags = [(WIDTH, (width,)), (HEIGHT, (height,)), (BITS, (8,) * samples), (COMPRESSION, (scheme,)), (PHOTOMETRIC, (1 if samples == 1 else 2,)), (SAMPLES, (samples,)), (PREDICTOR, (predictor,))]
        tags += [(TILE_WIDTH, (w,)), (TILE_HEIGHT, (h,)), (TILE_OFFSETS, places), (TILE_COUNTS, sizes)] if tile else [(STRIP_OFFSETS, places), (ROWS_PER_STRIP, (h,)), (STRIP_COUNTS, sizes)]
        entries = b""
        for tag, values in sorted(tags):
            kind, code, wide = (4, "I", 4) if tag in (WIDTH, HEIGHT, STRIP_OFFSETS, STRIP_COUNTS, TILE_OFFSETS, TILE_COUNTS, ROWS_PER_STRIP, TILE_WIDTH, TILE_HEIGHT) else (3, "H", 2)
            body = struct.pack(f"<{len(values)}{code}", *values)
            if len(body) > 4:
                place = len(out)
                out += body + b"\0" * (len(body) % 2)
                body = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def store(payload: bytes, scheme: int = DEFLATE) -> bytes:
    """Bytes, padded with 255 to a positive multiple of 576, as gray pages of 576 samples a row."""
    padded = payload + b"\xff" * (-len(payload) % WIDTH_OF_PAYLOAD if payload else WIDTH_OF_PAYLOAD)
    rows = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH_OF_PAYLOAD, 1)
    return write([rows[at : at + PAGE_ROWS] for at in range(0, len(rows), PAGE_ROWS)], scheme)


def encode(docs: DataFrame, scheme: int = DEFLATE) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a file. Null text: empty. Equal texts give equal files."""

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            yield pd.DataFrame({"doc_id": list(batch["doc_id"]), "n_bytes": [len(x) for x in raw], "media": [store(x, scheme) for x in raw]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(files, "doc_id long, n_bytes long, media binary")


def pages(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """One row per page of each file: key, page, width, height, samples, compression, predictor, tiled, pixels, error.

    A null or broken file gives its readable pages and one row with the error and no pixels; no row makes the job fail.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["_key", "page", "width", "height", "samples", "compression", "predictor", "tiled", "pixels", "error"]
        for batch in batches:
            for k, data in zip(batch["_key"], batch["_media"], strict=True):
                out, n = [], 0
                try:
                    for p in read(data if data is not None else b""):
                        out.append((k, n, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None))
                        n += 1
                except ValueError as e:
                    out.append((k, n, None, None, None, None, None, None, None, str(e)))
                yield pd.DataFrame(out, columns=names).astype({c: "Int32" for c in names[1:7]} | {"tiled": "boolean"})

    kind = media.schema[key].dataType.simpleString()
    read_in = media.select(F.col(key).alias("_key"), F.col(column).alias("_media"))
    return read_in.mapInPandas(rows, f"_key {kind}, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string").withColumnRenamed("_key", key)


def _feature(found: list[Page]) -> str:
    """Sums over the samples: the mean, the spread, the mean step along rows, and a histogram of 8 classes."""
    total = square = steps = count = 0
    classes = np.zeros(8, np.int64)
    for p in found:
        x = p.pixels.astype(np.int64)
        total, square, count = total + int(x.sum()), square + int((x * x).sum()), count + x.size
        steps += int(np.abs(np.diff(x, axis=1)).sum())
        classes += np.bincount(p.pixels.ravel() >> 5, minlength=8)
    mean = total / count
    return f"pages={len(found)};rows={sum(p.height for p in found)};mean={mean:.4f};spread={max(0.0, square / count - mean * mean) ** 0.5:.4f};step={steps / count:.4f};classes={','.join(map(str, classes))}"


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload and media sizes and hashes, feature; all from the stored bytes as read back.

    A null or empty text is one row of padding. Equal texts, repeated rows too, have equal values; a text of any length is
    stored whole, in pages; an empty table gives no rows; other columns are ignored.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, n, data in zip(batch["doc_id"], batch["n_bytes"], batch["media"], strict=True):
                found = list(read(data))
                payload = b"".join(p.pixels.tobytes() for p in found)
                sha = lambda x: hashlib.sha256(x).hexdigest()
                out.append((doc, n, len(payload), sha(payload), zlib.crc32(payload[-32:]), len(data), sha(data), _feature(found)))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return encode(docs).mapInPandas(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
