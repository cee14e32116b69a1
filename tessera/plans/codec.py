"""The codec over compact images: planes in, k tables, offsets and words out, and back.

An image is (img, width, height, data). ``encode`` and ``decode`` work on a few images at a
time with numpy and no shuffle, which is the way for images that fit a task. For larger
planes ``bands`` first cuts them into bands of big blocks, which code independently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decode import ESCAPE, grouped

BIG, SMALL, HALF = 32, 8, 32
ENCODED = "img long, width int, height int, ks binary, offsets array<long>, n_bits long, words binary"


def _zigzag(u: np.ndarray) -> np.ndarray:
    return (u << 1) ^ (0 - (u >> 7)).astype(np.uint8)


def _unzigzag(z: np.ndarray) -> np.ndarray:
    return ((z >> 1) ^ (0 - (z & 1))).astype(np.uint8)


def _big(plane: np.ndarray) -> np.ndarray:
    """(rows of big blocks, columns of them, 32, 32)"""
    h, w = plane.shape
    return plane.reshape(h // BIG, BIG, w // BIG, BIG).transpose(0, 2, 1, 3)


def _small(big: np.ndarray) -> np.ndarray:
    """Small blocks in coding order: big blocks in raster order, and small ones within each."""
    r, c = big.shape[:2]
    n = BIG // SMALL
    return big.reshape(r, c, n, SMALL, n, SMALL).transpose(0, 1, 2, 4, 3, 5).reshape(-1, SMALL * SMALL)


def blocks_of(data: bytes, width: int, height: int) -> np.ndarray:
    """Deltas on padded big blocks, as small blocks in coding order."""
    h, w = -(-height // BIG) * BIG, -(-width // BIG) * BIG
    plane = np.zeros((h, w), np.uint8)
    plane[:height, :width] = np.frombuffer(data, np.uint8).reshape(height, width)
    big = _big(plane)
    d = np.empty_like(big)
    d[..., 1:] = _zigzag(big[..., 1:] - big[..., :-1])
    d[..., 1:, 0] = _zigzag(big[..., 1:, 0] - big[..., :-1, 0])
    d[..., 0, 0] = big[..., 0, 0]
    return _small(d)


def plane_of(blocks: np.ndarray, width: int, height: int) -> bytes:
    """Small blocks in coding order back to the cropped plane."""
    r, c, n = -(-height // BIG), -(-width // BIG), BIG // SMALL
    big = blocks.astype(np.uint8).reshape(r, c, n, n, SMALL, SMALL).transpose(0, 1, 2, 4, 3, 5).reshape(r, c, BIG, BIG)
    raw = _unzigzag(big)
    raw[..., 0, 0] = big[..., 0, 0]
    raw[..., 0] = np.cumsum(raw[..., 0], axis=-1, dtype=np.uint8)
    plane = np.cumsum(raw, axis=-1, dtype=np.uint8).transpose(0, 2, 1, 3).reshape(r * BIG, c * BIG)
    return plane[:height, :width].tobytes()


def _costs() -> np.ndarray:
    """Bits of each byte under each k."""
    n, k = np.arange(256), np.arange(8)[:, None]
    return np.where(n >> k >= ESCAPE, 24, (n >> k) + 1 + k).astype(np.uint8)


COSTS = _costs()


def best_ks(blocks: np.ndarray) -> np.ndarray:
    """The k of each block that needs least bits.

    Without escapes a block's bits are its symbols' sum shifted right by k and a constant, and the
    shifted sum is a weighted sum of how often each bit is set. Escapes are put right one by one.
    A block has 64 symbols, as eight words.
    """
    n, size = blocks.shape
    words = np.ascontiguousarray(blocks).view(np.uint64).reshape(n, -1)
    ones = np.uint64(0x0101010101010101)
    cost = np.empty((8, n), np.int32)
    above = np.zeros(n, np.int32)
    for j in range(7, -1, -1):
        lanes = np.zeros(n, np.uint64)  # eight counts, none above the eight words of a block
        for i in range(words.shape[1]):
            lanes += (words[:, i] >> np.uint64(j)) & ones
        above = 2 * above + ((lanes * ones) >> np.uint64(56)).astype(np.int32)
        cost[j] = above + size * (1 + j)
    at = np.flatnonzero(blocks.ravel() & 0xF0)  # only these can be escapes
    symbol, whose = blocks.ravel()[at].astype(np.int32), at // size
    for k in range(4):
        more = np.where(symbol >> k >= ESCAPE, 24 - (symbol >> k) - 1 - k, 0)
        cost[k] += np.bincount(whose, more, n).astype(np.int32)
    return np.argmin(cost, axis=0)  # the first, so the smallest, of those that tie


def words_of(blocks: np.ndarray, ks: np.ndarray, owner: np.ndarray, images: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """The words of each image's stream, its bits, and where each of its half blocks begins.

    ``owner`` says, in rising order, whose each block is. Four symbols, prefixes first, are one
    part if they have at most 32 bits, as most have; else five, each one's prefix and all
    suffixes. A part ends at a known bit and adds to one word or two; as parts share no bits,
    sums put them together. Each stream begins a new word.
    """
    k, fours = ks[:, None].astype(np.uint8), blocks.shape[1] // 4
    q = blocks >> k
    escaped = q >= ESCAPE
    size = np.where(escaped, ESCAPE + 8 - k, q + 1).astype(np.uint8).reshape(-1, 4)
    number = np.where(escaped, q, 1).astype(np.uint8).reshape(-1, 4)
    low = (blocks & ((1 << k.astype(np.uint16)) - 1).astype(np.uint8)).reshape(-1, 4)
    width = np.repeat(ks.astype(np.uint32), fours)
    rest = low[:, 0].astype(np.uint32)
    for j in range(1, 4):
        rest = (rest << width) | low[:, j]
    total = 4 * width.astype(np.int64) + size[:, 0] + size[:, 1] + size[:, 2] + size[:, 3]

    end = np.cumsum(total)
    last = np.searchsorted(owner, np.arange(images), side="right") * fours - 1
    until = np.where(last >= 0, end[last], 0)
    before = np.concatenate(([0], until[:-1]))
    n_bits = until - before
    first = np.concatenate(([0], np.cumsum(-(-n_bits // 32))))
    end += np.repeat(np.repeat(first[:-1] * 32 - before, np.bincount(owner, minlength=images)), fours)
    begin = end - total

    short = total <= 32
    some = slice(None) if short.all() else np.flatnonzero(short)
    one = number[some, 0].astype(np.uint64)
    for j in range(1, 4):
        one = (one << size[some, j].astype(np.uint64)) | number[some, j]
    one = (one << (4 * width[some]).astype(np.uint64)) | rest[some]
    long = np.flatnonzero(~short)
    inner = begin[long, None] + np.cumsum(size[long], axis=1, dtype=np.int64)
    ends = np.concatenate([end[some], inner.ravel(), end[long]])
    parts = np.concatenate([one, number[long].ravel().astype(np.uint64), rest[long].astype(np.uint64)])

    place = np.maximum(ends - 1, 0)
    moved = parts << (31 - (place & 31)).astype(np.uint64)
    word = place >> 5
    high = moved >> np.uint64(32)
    sums = np.bincount(word, (moved & np.uint64(0xFFFFFFFF)).astype(float), int(first[-1]))
    over = np.flatnonzero(high)
    sums += np.bincount(word[over] - 1, high[over].astype(float), int(first[-1]))
    words = np.split(sums.astype(np.uint32), first[1:-1])
    half = begin[:: HALF // 4] - np.repeat(np.repeat(first[:-1] * 32, np.bincount(owner, minlength=images)), fours * 4 // HALF)
    return words, n_bits, np.split(half, np.searchsorted(owner, np.arange(1, images)) * (blocks.shape[1] // HALF))


def frame(words: np.ndarray, n_bits: int) -> bytes:
    """Stored words: four zero bytes, padding, one zero word; bytes of each word turned."""
    total = (-(-(-(-n_bits // 8) + 4) // 4) * 4 + 4) // 4
    out = np.zeros(total, "<u4")
    out[: len(words)] = words
    return out.tobytes()


def unframe(words: bytes) -> bytes:
    return np.frombuffer(words, "<u4").astype(">u4").tobytes()


#: Cells that are encoded or decoded in one go; images are small or are cut into bands.
CELLS = 1 << 20


def encode_many(images: list[tuple[bytes, int, int]]) -> list[tuple[bytes, list[int], int, bytes]]:
    """ks, offsets, bits and words of images given as (data, width, height)."""
    parts = [blocks_of(*image) for image in images]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    blocks = np.concatenate(parts)
    ks = best_ks(blocks)
    words, n_bits, halves = words_of(blocks, ks, owner, len(parts))
    own = np.split(ks.astype(np.uint8), np.cumsum([len(p) for p in parts])[:-1])
    return [(k.tobytes() + b"\0", at.tolist(), int(n), frame(w, int(n))) for k, at, n, w in zip(own, halves, n_bits, words)]


def decode_many(images: list[tuple[bytes, list[int], bytes, int, int]]) -> list[bytes]:
    """Planes of images given as (ks, offsets, words, width, height): all half blocks at once."""
    k = [np.repeat(np.frombuffer(ks, np.uint8)[:-1], 2) for ks, *_ in images]
    at = np.concatenate([np.asarray(offsets, np.int64) for _, offsets, *_ in images])
    owner = np.repeat(np.arange(len(images)), [len(x) for x in k])
    symbols = grouped([unframe(words) for _, _, words, *_ in images], np.concatenate(k), HALF, at, owner)
    blocks = np.split(symbols.reshape(-1, SMALL * SMALL), np.cumsum([len(x) // 2 for x in k])[:-1])
    return [plane_of(b, width, height) for b, (*_, width, height) in zip(blocks, images)]


def encode_one(data: bytes, width: int, height: int) -> tuple[bytes, list[int], int, bytes]:
    return encode_many([(data, width, height)])[0]


def decode_one(ks: bytes, offsets: list[int], words: bytes, width: int, height: int) -> bytes:
    return decode_many([(ks, offsets, words, width, height)])[0]


def _batches(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows in pieces of at most CELLS cells, or one row."""
    cells = np.cumsum(rows["width"].to_numpy(np.int64) * rows["height"].to_numpy(np.int64))
    yield from (part for _, part in rows.groupby(cells // CELLS, sort=True))


def encode(images: DataFrame) -> DataFrame:
    """img, width, height, ks (a zero byte last), offsets by half block, n_bits, words."""
    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for part in _batches(rows):
                made = encode_many(list(zip(part["data"], part["width"], part["height"])))
                ks, offsets, n_bits, words = zip(*made)
                yield part[["img", "width", "height"]].assign(ks=ks, offsets=list(offsets), n_bits=n_bits, words=words)

    return images.filter((F.col("width") > 0) & (F.col("height") > 0)).select("img", "width", "height", "data").mapInPandas(some, ENCODED)


def decode(encoded: DataFrame) -> DataFrame:
    """img, width, height, data."""
    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for part in _batches(rows):
                data = decode_many(list(zip(part["ks"], part["offsets"], part["words"], part["width"], part["height"])))
                yield part[["img", "width", "height"]].assign(data=data)

    return encoded.mapInPandas(some, "img long, width int, height int, data binary")


def images(rows: DataFrame, width: int = BIG) -> DataFrame:
    """Byte strings (img, data) as images of a width, the last row filled with zeros."""
    n = F.octet_length("data")
    height = F.ceil(n / width).cast("int")
    filled = F.concat("data", F.unhex(F.repeat(F.lit("00"), (height * width - n).cast("int"))))
    return rows.filter(n > 0).select("img", F.lit(width).alias("width"), height.alias("height"), filled.alias("data"))


def bands(images: DataFrame, rows: int = 32 * BIG) -> DataFrame:
    """Images cut into bands of at most ``rows`` rows; band is a column, img stays."""
    size = F.col("width") * rows
    at = F.sequence(F.lit(0), (F.ceil(F.col("height") / rows) - 1).cast("int"))
    cut = images.withColumn("band", F.explode(at))
    height = F.least(F.lit(rows), F.col("height") - F.col("band") * rows).cast("int")
    part = F.substring(F.col("data"), (F.col("band") * size + 1).cast("int"), (F.col("width") * height).cast("int"))
    return cut.select("img", "band", "width", height.alias("height"), part.alias("data"))


def relations(encoded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An encoding as three relations: k by block, offset by half block, and words."""
    ks = F.transform(F.sequence(F.lit(1), F.octet_length("ks") - 1), lambda i: F.conv(F.hex(F.substr("ks", i, F.lit(1))), 16, 10).cast("int"))
    k = encoded.select("img", F.posexplode(ks).alias("blocki", "k"))
    offsets = encoded.select("img", F.posexplode("offsets").alias("half", "bit_offset"))
    return k, offsets, encoded.select("img", "width", "height", "n_bits", "words")


def write_relations(encoded: DataFrame, path: str) -> None:
    """The three relations as parquet folders under a path."""
    for name, part in zip(("k", "offsets", "words"), relations(encoded)):
        part.write.mode("overwrite").parquet(f"{path}/{name}")
