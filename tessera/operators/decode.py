"""Decoders: bits back to symbols, many blocks in step.

Where a symbol begins depends on all before it, so a block's bits are read in order. Blocks
are independent: numpy reads the j-th symbol of all blocks of a batch at once, so Python
runs a loop over the symbols of one block, not over all symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ESCAPE = 16


def _leading() -> np.ndarray:
    """Zeros before the first one of each 16 bits; 16 for none."""
    table = np.full(1 << 16, ESCAPE, np.uint8)
    for i in range(16):
        table[1 << i : 2 << i] = 15 - i
    return table


LEADING = _leading()


#: Stands for 16 bits that do not hold four whole prefixes.
SLOW = np.uint32(0xFFFFFFFF)


def _fours() -> np.ndarray:
    """What the first four prefixes in each 16 bits are: a nibble of zeros for each, the first lowest, then all their bits."""
    rest, used, out = np.arange(1 << 16, dtype=np.uint32), np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.uint32)
    whole = np.ones(1 << 16, bool)
    for j in range(4):
        q = LEADING[rest].astype(np.uint32)
        used += q + 1
        whole &= (q < ESCAPE) & (used <= 16)
        out |= q << (4 * j)
        rest = (rest << np.minimum(q + 1, 16)) & 0xFFFF
    return np.where(whole, out | used << 16, SLOW)


FOURS = _fours()


class Lanes:
    """Bit positions in packed bit strings: one in each, or as many as ``owner`` names."""

    def __init__(self, data: list[bytes], skip: np.ndarray | None = None, owner: np.ndarray | None = None):
        size = [len(d) for d in data]
        joined = b"".join(data) + b"\0" * 16
        # the eight bytes from each byte on, without a copy
        self.words = np.ndarray(len(joined) - 7, ">u8", joined, strides=(1,))
        begin = np.concatenate(([0], np.cumsum(size)))[:-1].astype(np.int64)
        begin = begin if owner is None else begin[owner]
        self.at = begin * 8 + (0 if skip is None else skip.astype(np.int64))

    def peek(self) -> np.ndarray:
        """The next 32 bits of each, the first one highest."""
        byte = np.minimum(self.at >> 3, len(self.words) - 1)
        word = self.words[byte].astype(np.uint64)
        return (word << (self.at & 7).astype(np.uint64)) >> np.uint64(32)

    def take(self, n: np.ndarray) -> np.ndarray:
        """n bits of each as a number, n at most 32."""
        out = self.peek() >> (np.uint64(32) - n.astype(np.uint64))
        self.at = self.at + n
        return out.astype(np.int64)

    def zeros(self) -> np.ndarray:
        """Reads a prefix: zeros up to a one, which is read too; or 16 zeros alone."""
        q = LEADING[self.peek() >> np.uint64(16)].astype(np.int64)
        self.at = self.at + np.minimum(q + 1, ESCAPE)
        return q


    def some(self, rows: np.ndarray) -> Lanes:
        """Those of some rows."""
        out = object.__new__(Lanes)
        out.words, out.at = self.words, self.at[rows]
        return out


def _group(lanes: Lanes, k: np.ndarray, size: int) -> np.ndarray:
    """The next ``size`` symbols of each, one group, symbol by symbol; rows are symbols."""
    out = np.empty((size, len(k)), np.int64)
    for j in range(size):
        q = lanes.zeros()
        escaped = q == ESCAPE
        if escaped.any():
            q = np.where(escaped, lanes.take(np.where(escaped, 8 - k, 0)), q)
        out[j] = q << k
    rest = lanes.take(k * size)  # at most 28 bits
    for j in range(size - 1, -1, -1):
        out[j] |= rest & ((1 << k) - 1)
        rest >>= k
    return out


def grouped(data: list[bytes], k: np.ndarray, n: int, skip: np.ndarray | None = None, owner: np.ndarray | None = None) -> np.ndarray:
    """n symbols of each block whose code puts four prefix parts before four suffixes.

    Where four prefixes are whole in the next 16 bits, one look-up finds them, and the
    same word has their suffixes. Other groups, with escapes among them, are read symbol by symbol.
    """
    lanes, k = Lanes(data, skip, owner), k.astype(np.int64)
    out = np.zeros((n, len(k)), np.int32)
    k_, low = k.astype(np.uint32), ((1 << k) - 1).astype(np.uint32)
    down, bits = (63 - 4 * k).astype(np.uint64), 4 * k
    for g in range(0, n - n % 4, 4):
        byte = np.minimum(lanes.at >> 3, len(lanes.words) - 1)
        word = lanes.words[byte].astype(np.uint64) << (lanes.at & 7).astype(np.uint64)
        found = FOURS[word >> np.uint64(48)]
        slow = np.flatnonzero(found == SLOW)
        used = found >> np.uint32(16)
        rest = (((word << used.astype(np.uint64)) >> np.uint64(1)) >> down).astype(np.uint32)
        for j in range(3, -1, -1):
            out[g + j] = (((found >> np.uint32(4 * j)) & np.uint32(15)) << k_) | (rest & low)
            rest >>= k_
        at = lanes.at + used + bits
        if len(slow):
            few = lanes.some(slow)
            out[g : g + 4, slow] = _group(few, k[slow], 4)
            at[slow] = few.at
        lanes.at = at
    if n % 4:
        out[n - n % 4 :] = _group(lanes, k, n % 4)
    return np.ascontiguousarray(out.T)


def interleaved(data: list[bytes], k: np.ndarray, n: int, skip: np.ndarray | None = None) -> np.ndarray:
    """n symbols of each block, each with its prefix and suffix together."""
    lanes, k = Lanes(data, skip), k.astype(np.int64)
    out = np.zeros((len(k), n), np.int64)
    for j in range(n):
        q = lanes.zeros()
        rest = lanes.take(np.where(q == ESCAPE, 8, k))
        out[:, j] = np.where(q == ESCAPE, rest, (q << k) | rest)
    return out


def prefixes(data: list[bytes], n: int, skip: np.ndarray | None = None) -> np.ndarray:
    """n prefix lengths 1 to 16, or 17 for an escape, of each stream of prefixes."""
    lanes = Lanes(data, skip)
    return np.stack([lanes.zeros() + 1 for _ in range(n)], axis=1)


def split(first: list[bytes], second: list[bytes], k: np.ndarray, n: int) -> np.ndarray:
    """n symbols of each block from its stream of prefixes and its stream of suffixes."""
    q = prefixes(first, n) - 1
    lanes, k = Lanes(second), k.astype(np.int64)
    out = np.zeros((len(k), n), np.int64)
    for j in range(n):
        rest = lanes.take(np.where(q[:, j] == ESCAPE, 8, k))
        out[:, j] = np.where(q[:, j] == ESCAPE, rest, (q[:, j] << k) | rest)
    return out


def plain(data: list[bytes], k: np.ndarray, n: int) -> np.ndarray:
    """n symbols of each block under the code without escapes, ones before a zero."""
    lanes, k = Lanes(data), k.astype(np.int64)
    out = np.zeros((len(k), n), np.int64)
    for j in range(n):
        q, more = np.zeros(len(k), np.int64), np.ones(len(k), bool)
        while more.any():
            run = (~lanes.peek()) & np.uint64(0xFFFFFFFF)
            ones = np.where(run > 0, 31 - np.floor(np.log2(np.maximum(run, 1).astype(float))).astype(np.int64), 32)
            ones = np.where(more, np.minimum(ones, 24), 0)
            lanes.at, q = lanes.at + ones, q + ones
            more &= ones == 24
        lanes.at = lanes.at + 1
        out[:, j] = (q << k) | lanes.take(k)
    return out


def pack_text(bits: str) -> bytes:
    """A text of bits as bytes, the last filled with zeros."""
    return np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48).tobytes()


def _decoded(df: DataFrame, read, out: str = "syms", kind: str = "array<int>") -> DataFrame:
    """``df`` with what ``read`` makes of each batch; other columns stay."""
    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            yield rows.assign(**{out: list(read(rows)) if len(rows) else []})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(some, f"{fields}, {out} {kind}")


def decode_grouped(blocks: DataFrame, n: int) -> DataFrame:
    """Blocks (bits, k) with syms, n of each."""
    return _decoded(blocks, lambda r: grouped([pack_text(b) for b in r["bits"]], r["k"].to_numpy(), n).tolist())


def decode_interleaved(blocks: DataFrame, n: int) -> DataFrame:
    return _decoded(blocks, lambda r: interleaved([pack_text(b) for b in r["bits"]], r["k"].to_numpy(), n).tolist())


def decode_plain(blocks: DataFrame, n: int) -> DataFrame:
    return _decoded(blocks, lambda r: plain([pack_text(b) for b in r["bits"]], r["k"].to_numpy(), n).tolist())


def decode_prefixes(streams: DataFrame, n: int) -> DataFrame:
    """Streams (bits) of prefixes with counts."""
    return _decoded(streams, lambda r: prefixes([pack_text(b) for b in r["bits"]], n).tolist(), "counts")


def decode_split(blocks: DataFrame, n: int) -> DataFrame:
    """Blocks (first, second, k) with syms."""
    return _decoded(blocks, lambda r: split([pack_text(b) for b in r["first"]], [pack_text(b) for b in r["second"]], r["k"].to_numpy(), n).tolist())


def read_bits(rows: DataFrame, skip: int, n: int) -> DataFrame:
    """Rows (data) with bits: n bits, at most 24, after the first ``skip``."""
    def read(r: pd.DataFrame) -> list[int]:
        lanes = Lanes(r["data"].tolist(), np.full(len(r), skip))
        return lanes.take(np.full(len(r), n)).tolist()

    return _decoded(rows, read, "bits", "long")
