"""Pack token sequences: non-negative least squares over shallow length combinations.

A document's ids are cut into pieces of ``WINDOW`` and one remainder. Whole windows are
sequences already. For the remainders only their histogram over lengths 1 to WINDOW - 1
goes to the driver, whatever the number of documents. There, in rounds:

1. combinations of lengths are enumerated that fill a window but for a slack: each length
   is completed by the cheapest set of others (a knapsack over lengths whose prices follow
   the residual, the histogram and a seeded noise, with a cost for each piece, so that
   combinations stay shallow). Where lengths are short, so that only deep combinations fill
   a window, lengths drawn from the histogram come first and the knapsack closes the rest;
2. repeat counts x >= 0 are solved that minimise ``|A x - histogram|``;
3. they are rounded, the largest first, within what the histogram has;
4. the next round solves for what is left. When a slack yields little, the next one of
   the schedule is taken; the last allows any gap, so that a length that nothing fits beside
   is a combination by itself. Combinations that hold a length over half a window come
   first, for each of these needs a window of its own;
5. what rounding leaves at last is packed greedily, best fit over lengths. Of the two
   ``SCHEDULES`` of slacks the one that needs fewer sequences counts.

The result is runs "n sequences, each with these lengths in this order", a few thousand;
the m-th piece of a length belongs to the run that covers m. So each piece finds its
sequence from its rank among pieces of its length, which is taken in parts and never sorts
a length in one task. Column ``solved`` says whether a piece was placed by steps 1 to 4.

Defined cases: a null text is empty and yields one piece with the closing id alone; a very
long text is cut into windows like any other; null or repeated ids keep their rows, each
row being a document of its own; other columns of the input are not read, so none can
clash; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_in_groups, stage
from .tokens import Codec

WINDOW = 2048
END_ID = 1
#: Places of a window that a combination may leave empty, one after another; the schedule that needs fewer sequences counts.
SCHEDULES = ((0, 2, 8, 32, WINDOW), (8, 32, WINDOW))
#: Rounds without much success before the next slack, the least share that is much, and a bound of all rounds.
TRIES = 2
MUCH = 0.02
MOST_ROUNDS = 120
#: Enumerations of a round, and steps of the solver between and after them.
ENUMERATIONS = 6
STEPS = 300
#: What a price is made of: noise, the residual, the histogram, and the cost of a piece.
NOISE, SHORT, COMMON, COST = 1.0, 0.5, 0.5, 2.0
#: Lengths up to this quantile of the pieces count as the usual ones; a knapsack closes three of them.
USUAL = 0.9
SEED = 11
#: Pieces of one length that are ranked in one task.
RANK_ROWS = 250_000


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents; with ``keep_ids`` their ids too, as an array."""
    names = [f.split()[0] for f in _PIECE.split(", ")] + ["ids"] * keep_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n = Codec().encode, 0
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = text.as_py()
                ids = np.append(encode(t) if t else np.empty(0, np.uint32), np.uint32(END_ID)).astype("<u4")
                for a in range(0, len(ids), window):
                    part = ids[a : a + window]
                    n += 1
                    row = (doc, a, len(part), zlib.crc32(part.tobytes()), len(ids), n)
                    out.append((*row, part.tolist()) if keep_ids else row)
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(rows, _PIECE + ", ids array<long>" * keep_ids)


def combinations(have: np.ndarray, residual: np.ndarray, window: int, slack: int, least: int, rng: np.random.Generator) -> set[tuple[int, ...]]:
    """Of each length from ``least`` on a combination that holds it and fills the window but for ``slack``, if there is one."""
    lengths = np.flatnonzero(have)
    n = have[lengths]
    usual = int(lengths[np.searchsorted(np.cumsum(n), USUAL * n.sum())])
    price = NOISE * rng.random(len(lengths)) + SHORT * np.clip(residual[lengths] / n, -1, 1) + COMMON * np.log(n) / max(1.0, np.log(n.max())) - COST
    if slack >= window:  # any gap is allowed, so filling comes first
        price = lengths * (1 + 0.01 * price)
    top = min(window, 3 * usual)
    best, last = np.full(top + 1, -np.inf), np.zeros(top + 1, int)
    best[0] = 0
    for w in range(int(lengths[0]), top + 1):
        k = int(np.searchsorted(lengths, w, side="right"))
        sums = best[w - lengths[:k]] + price[:k]
        i = int(sums.argmax())
        best[w], last[w] = sums[i], lengths[i]
    drawn = None
    if 4 * usual <= window:
        drawn = rng.choice(lengths, (len(lengths), min(window, 2 * window // max(1, int(lengths @ n // n.sum())))), p=n / n.sum())
    out = set()
    for j, v in enumerate(lengths.tolist()):
        if v < least:
            continue
        fill, room = [v], window - v
        for d in drawn[j].tolist() if drawn is not None else ():
            if room <= top:
                break
            if d <= room:
                fill.append(d)
                room -= d
        low = max(0, room - slack)
        if low > top:
            continue
        reach = best[low : min(room, top) + 1]
        w = low + int(reach.argmax())
        if best[w] == -np.inf:
            continue
        while w:
            fill.append(int(last[w]))
            w -= fill[-1]
        if all(have[a] >= k for a, k in Counter(fill).items()):
            out.add(tuple(sorted(fill, reverse=True)))
    return out


def solve(combos: list[Counter[int]], have: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Repeat counts x >= 0 that bring A x nearest to the histogram, and the residual, by accelerated projected gradients.

    A has a row for each length and a column for each combination; only its entries are kept.
    """
    row = np.concatenate([np.fromiter(c, int) for c in combos])
    times = np.concatenate([np.fromiter(c.values(), float) for c in combos])
    column = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    size = len(combos)

    def apply(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, times * x[column], len(have))

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(column, times * r[row], size)

    x = np.ones(size)  # the largest eigenvalue of A'A, by power iteration
    for _ in range(20):
        x = back(apply(x))
        width = np.linalg.norm(x)
        x /= width
    width *= 1.05
    x = y = np.zeros(size)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(apply(y) - have) / width)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x, have - apply(x)


def _round(have: np.ndarray, window: int, slack: int, least: int, rng: np.random.Generator) -> list[tuple[int, tuple[int, ...]]]:
    """Runs of one solution for what the histogram ``have`` still holds, which is reduced by them."""
    found: set[tuple[int, ...]] = set()
    residual = have.astype(float)
    x = np.empty(0)
    for i in range(ENUMERATIONS):
        found |= combinations(have, residual, window, slack, least, rng)
        if found and i % 3 == 2:
            names = sorted(found)
            counted = [Counter(c) for c in names]
            x, residual = solve(counted, have)
    runs = []
    for i in np.argsort(-x, kind="stable").tolist():
        if x[i] < 0.3:
            break
        n = min([max(1, round(x[i])), *(int(have[v]) // k for v, k in counted[i].items())])
        if n > 0:
            runs.append((n, names[i]))
            for v, k in counted[i].items():
                have[v] -= n * k
    return runs


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, tuple[int, ...], bool]]:
    """Runs (n, lengths, solved): n sequences that each hold these lengths. They use the histogram up."""
    return min((_plan(histogram, window, slacks) for slacks in SCHEDULES), key=lambda runs: sum(n for n, _, _ in runs))


def _plan(histogram: dict[int, int], window: int, slacks: tuple[int, ...]) -> list[tuple[int, tuple[int, ...], bool]]:
    have = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        have[length] += n
    runs: list[tuple[int, tuple[int, ...], bool]] = []
    if have[window]:
        runs.append((int(have[window]), (window,), True))
        have[window] = 0
    rng, rounds = np.random.default_rng(SEED), 0
    for least in (window // 2 + 1, 1):  # no two of the longer ones fit together, so others must not use up what fits beside them
        for slack in slacks:
            failed = 0
            while failed < TRIES and rounds < MOST_ROUNDS and have[least:].any():
                rounds += 1
                before = have.sum()
                runs += [(*run, True) for run in _round(have, window, slack, least, rng)]
                failed = failed + 1 if before - have.sum() < MUCH * before else 0
    left = np.flatnonzero(have).tolist()
    while left:  # the longest length first, then the longest that still fits
        a = left[-1]
        fill, room, used = [a], window - a, {a: 1}
        while room:
            i = bisect_left(left, room + 1) - 1
            while i >= 0 and have[left[i]] <= used.get(left[i], 0):
                i -= 1
            if i < 0:
                break
            fill.append(left[i])
            used[left[i]] = used.get(left[i], 0) + 1
            room -= left[i]
        n = min(int(have[v]) // k for v, k in used.items())
        runs.append((n, tuple(fill), False))
        for v, k in used.items():
            have[v] -= n * k
        left = [v for v in left if have[v]]
    return runs


def pack(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Staged ``pieces`` with sequence_id, offset and solved."""
    spark = found.sparkSession
    counted = found.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row for each length up to the window
    runs = plan({r.length: r.n for r in counted}, window)
    taken: dict[int, int] = {}
    by_length: dict[int, list[tuple]] = {}
    sequence = 0
    for n, lengths, solved in runs:
        offset = 0
        for v in lengths:
            first = taken.get(v, 0)
            by_length.setdefault(v, []).append((first, first + n, sequence, offset, solved))
            taken[v] = first + n
            offset += v
        sequence += n
    slot = "array<struct<first:long,stop:long,seq:long,off:long,solved:boolean>>"
    where = spark.createDataFrame(sorted(by_length.items()), f"length long, slots {slot}")
    order = [F.col("ids_crc32"), F.col("doc_id"), F.col("start")]
    parts = max((r.n for r in counted), default=0) // RANK_ROWS + 1
    ranked = rank_in_groups(found, ["length"], order, F.pmod(F.col("salt"), F.lit(parts)), "m")
    placed = ranked.join(F.broadcast(where), "length")  # at most one row for each length
    at = F.filter("slots", lambda s: (s["first"] <= F.col("m")) & (F.col("m") < s["stop"]))[0]
    placed = placed.withColumn("_at", at).withColumn("sequence_id", F.col("_at.seq") + F.col("m") - F.col("_at.first"))
    return placed.withColumns({"offset": F.col("_at.off"), "solved": F.col("_at.solved")}).drop("slots", "m", "salt", "_at")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document, with its sequence and its place there."""
    return pack(stage(pieces(docs, id_col, text_col, window, keep_ids)), window)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "solved")
