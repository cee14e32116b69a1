"""Several coded streams in one: bytes in the order in which decoders ask for them.

All streams have as many symbols, and are decoded one symbol from each in turn. A decoder
holds up to 32 bits and asks for bytes while it has at most ``LOW`` of them: before each
prefix, before an escape's byte and before each suffix. The multiplexed stream holds the bytes in
just that order, so one reader can feed all decoders. The order depends on the bits, so
both directions step through symbols; each step is numpy over all streams (or groups) of a
batch at once. One group is one row, as one container is; groups are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW = 24
ESCAPE = 16


class Readers:
    """Decoders that take a step at once: the bits that each holds, and those of a word it has not begun."""

    def __init__(self, count: int, unit: int):
        self.unit = unit
        self.bits, self.word = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
        self.have, self.left = np.zeros(count, np.int64), np.zeros(count, np.int64)

    def refill(self, rows: np.ndarray, fetch) -> np.ndarray:
        """Units that each of ``rows`` took, from what ``fetch`` gives for rows that ask."""
        took = np.zeros(len(rows), np.int64)
        while True:
            ask = self.have[rows] + self.left[rows] <= LOW
            if not ask.any():
                break
            at = rows[ask]
            got = fetch(at)
            took[ask] += 1
            if self.unit == 1:
                self.bits[at] = (self.bits[at] << np.uint64(8)) | got
                self.have[at] += 8
            else:
                self.word[at], self.left[at] = got, 8 * self.unit
        while self.unit > 1:  # a word comes over in halves, so that 64 bits hold what is begun
            half = 4 * self.unit
            at = rows[(self.left[rows] > 0) & (self.have[rows] < 32)]
            if not len(at):
                break
            self.left[at] -= half
            self.bits[at] = (self.bits[at] << np.uint64(half)) | ((self.word[at] >> self.left[at].astype(np.uint64)) & np.uint64((1 << half) - 1))
            self.have[at] += half
        return took

    def take(self, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        self.have[rows] -= n
        kept = self.have[rows].astype(np.uint64)
        out = self.bits[rows] >> kept
        self.bits[rows] &= (np.uint64(1) << kept) - np.uint64(1)
        return out.astype(np.int64)

    def prefix(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Quotients and whether each is an escape; the prefixes are taken."""
        top = (self.bits[rows] >> (self.have[rows] - ESCAPE).astype(np.uint64)) & np.uint64(0xFFFF)
        q = ESCAPE - 1 - np.floor(np.log2(np.maximum(top, 1).astype(float))).astype(np.int64)
        escaped = top == 0
        self.take(rows, np.where(escaped, ESCAPE, q + 1))
        return q, escaped

    def symbol(self, rows: np.ndarray, k: np.ndarray, fetch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A symbol of each row, and the units that it took before its prefix and before the rest."""
        first = self.refill(rows, fetch)
        q, escaped = self.prefix(rows)
        second = self.refill(rows, fetch)
        rest = self.take(rows, np.where(escaped, 8, k))
        return np.where(escaped, rest, (q << k) | rest), first, second


def _units(streams: list[bytes], unit: int) -> tuple[np.ndarray, np.ndarray]:
    """All streams' units as one array, with a zero one last, and where each stream begins."""
    padded = [s + bytes(-len(s) % unit) for s in streams]
    begin = np.cumsum([0, *(len(p) // unit for p in padded)])
    return np.concatenate([np.frombuffer(b"".join(padded), f">u{unit}").astype(np.uint64), np.zeros(1, np.uint64)]), begin


class _Source:
    """Gives the next unit of each of several streams; past its end zeros are read."""

    def __init__(self, streams: list[bytes], unit: int):
        self.units, begin = _units(streams, unit)
        self.at, self.end = begin[:-1].copy(), begin[1:]

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        place = np.where(self.at[rows] < self.end[rows], self.at[rows], len(self.units) - 1)
        self.at[rows] += 1
        return self.units[place]


def _k_of(ks: list[list[int]], n: int, block: int) -> np.ndarray:
    """The k of each stream's symbols, a row for each stream."""
    blocks = -(-n // block)
    return np.array([list(k[:blocks]) for k in ks], np.int64).reshape(len(ks), blocks).repeat(block, axis=1)[:, :n]


def multiplex_many(groups: list[list[bytes]], kss: list[list[list[int]]], n: int, block: int, unit: int = 1) -> list[bytes]:
    """For each group the units of its streams in the order of their use; a unit is a byte, or a word of ``unit`` bytes."""
    streams = [s for g in groups for s in g]
    if not streams:
        return [b"" for _ in groups]
    k = _k_of([x for ks in kss for x in ks], n, block)
    readers, source, rows = Readers(len(streams), unit), _Source(streams, unit), np.arange(len(streams))
    took = np.empty((len(streams), n, 2), np.int64)
    for j in range(n):
        _, took[:, j, 0], took[:, j, 1] = readers.symbol(rows, k[:, j], source)
    units, begin = _units(streams, unit)
    out, at = [], 0
    for g in groups:
        mine = slice(at, at + len(g))
        each = took[mine].transpose(1, 0, 2).ravel()  # by symbol, then stream, then step
        stream = np.tile(np.arange(len(g)).repeat(2), n).repeat(each)
        order = np.argsort(stream, kind="stable")
        count = took[mine].sum(axis=(1, 2))
        place = np.empty(len(stream), np.int64)
        place[order] = np.arange(len(stream)) - (np.cumsum(count) - count).repeat(count)
        starts, ends = begin[:-1][mine][stream], begin[1:][mine][stream]
        got = units[np.where(starts + place < ends, starts + place, len(units) - 1)]
        out.append(got.astype(f">u{unit}").tobytes())
        at += len(g)
    return out


def demultiplex_many(muxes: list[bytes], kss: list[list[list[int]]], n: int, block: int, unit: int = 1) -> list[np.ndarray]:
    """For each group the symbols of its streams, a row for each stream."""
    out: list[np.ndarray] = [np.empty((len(ks), n), np.int64) for ks in kss]
    sizes = np.array([len(ks) for ks in kss])
    for size in np.unique(sizes[sizes > 0]).tolist():  # groups with as many streams step together
        some = np.flatnonzero(sizes == size)
        source = _Source([muxes[i] for i in some], unit)
        k = np.stack([_k_of(kss[i], n, block) for i in some])
        readers, found = Readers(len(some) * size, unit), np.empty((len(some), size, n), np.int64)
        groups = np.arange(len(some))
        for j in range(n):
            for s in range(size):
                found[:, s, j] = readers.symbol(groups * size + s, k[:, s, j], lambda rows: source(rows // size))[0]
        for i, f in zip(some.tolist(), found):
            out[i] = f
    return out


def multiplex(streams: list[bytes], ks: list[list[int]], n: int, block: int, unit: int = 1) -> bytes:
    return multiplex_many([streams], [ks], n, block, unit)[0]


def demultiplex(data: bytes, ks: list[list[int]], n: int, block: int, unit: int = 1) -> list[list[int]]:
    return demultiplex_many([data], [ks], n, block, unit)[0].tolist()


def multiplexed(streams: DataFrame, n: int, block: int, unit: int = 1) -> DataFrame:
    """img, mux and kss (the ks of each stream in order) of rows (img, stream, data, ks)."""
    whole = streams.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("stream", "data", "ks"))).alias("s"))
    whole = whole.select("img", F.col("s.data").alias("data"), F.col("s.ks").alias("kss"))

    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            mux = multiplex_many([list(d) for d in rows["data"]], [[list(k) for k in ks] for ks in rows["kss"]], n, block, unit)
            yield pd.DataFrame({"img": rows["img"], "mux": mux, "kss": rows["kss"]})

    return whole.mapInPandas(some, "img long, mux binary, kss array<array<int>>")


def demultiplexed(muxed: DataFrame, n: int, block: int, unit: int = 1) -> DataFrame:
    """img, stream, syms of rows (img, mux, kss)."""
    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            found = demultiplex_many(list(rows["mux"]), [[list(k) for k in ks] for ks in rows["kss"]], n, block, unit)
            yield pd.DataFrame([(img, s, v) for img, f in zip(rows["img"], found) for s, v in enumerate(f.tolist())], columns=["img", "stream", "syms"])

    return muxed.select("img", "mux", "kss").mapInPandas(some, "img long, stream int, syms array<int>")
