"""Near-duplicate documents by SimHash fingerprints and pigeonring filtering.

A fingerprint has 64 bits. Two fingerprints link if they differ in at most 4 bits.
The bits form a ring of 7 segments. If at most 4 bits differ, at least 3 segments are
equal, so every link shares one of the 35 keys made of 3 segments; and, going round the
ring from some segment, the differences summed over the first n segments never exceed
n * 4 / 7 (the strong form of the pigeonring principle). Candidates that share a key
must pass that test of chains before their whole Hamming distance is taken.

Equal fingerprints are one class from the start. A group that shares a key gives a
spanning forest, never all its pairs. Keys are counted by partial sums before rows meet, so
a key with a third of all rows is counted nowhere in one task. A key shared by over
``MAX_GROUP`` classes takes another exact way: two fingerprints differ in at most 4 bits if
and only if a third one lies within 2 bits of either, so each class goes to all fingerprints
within 2 bits of it, and those that meet are linked to the least of them. Its cost is linear
in the group.

Defined cases: null or wordless text has fingerprint zero and links like any other; a very
long text is one row, whose hashes are counted in pieces of ``CHUNK``; a null doc_id keeps
its row, and counts in no component's smallest id unless all are null; repeated rows come
back as often as they went in; other columns are not read, and ``keep_one`` names its
helpers so that they meet no column of the input; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import discard, fresh, join_checked, stage

WORDS = 4
SEED = 42
MAX_BITS = 4
#: Classes under one key that are still compared with each other, and rows of a block in ``word_links``.
MAX_GROUP = 8192
#: For ``keep_one``: prints of word sets, the bits in which the texts' own fingerprints
#: may differ for a pair to be verified, the words of a shingle, and the least similarity.
WORD_PRINTS = 3
FAR_BITS = 18
SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: Bits of the sketch that bounds how far two texts' shingles differ.
SKETCH = 1024
#: Distances in a part's order up to which all parts of a batch are compared at once.
NEAR = 64
#: Hashes whose bits are counted at once, and pairs that are sent at once.
CHUNK = 65_536
#: Rows of one or two numbers up to which they are broadcast.
FEW_KEYS = 200_000
#: Rows with a sketch up to which they are broadcast, some 8 MB.
FEW_WIDE = 40_000
#: Keys whose bitmap, 2 to 4 bytes a key, every task holds; and what a key's hash is multiplied by.
FILTER_KEYS = 4_000_000
_MARK = np.uint64(0x9E3779B97F4A7C15)


class Ring(NamedTuple):
    """Widths of the segments from the lowest bit; any two fingerprints within MAX_BITS agree in ``equal`` of them."""

    widths: tuple[int, ...]

    @property
    def equal(self) -> int:
        return len(self.widths) - MAX_BITS

    @property
    def starts(self) -> list[int]:
        return np.cumsum((0, *self.widths[:-1])).tolist()

    @property
    def masks(self) -> list[np.uint64]:
        return [np.uint64(((1 << w) - 1) << s) for w, s in zip(self.widths, self.starts)]

    def keys(self, fp: np.ndarray) -> np.ndarray:
        """The keys of fingerprints, a row for each key: its number, then its segments."""
        seg = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1), w) for w, s in zip(self.widths, self.starts)]
        out = []
        for i, some in enumerate(combinations(seg, self.equal)):
            key, at = np.full(len(fp), i << 40, np.uint64), 0
            for part, w in some:
                key |= part << np.uint64(at)
                at += w
            out.append(key)
        return np.array(out)

    def viable(self, x: np.ndarray) -> np.ndarray:
        """Whether some chain of segments of the differing bits ``x`` stays within its budgets."""
        n = len(self.widths)
        d = [np.bitwise_count(x & m).astype(np.int8) for m in self.masks]
        found = np.zeros(len(x), bool)
        for i in range(n):
            total, ok = np.zeros(len(x), np.int8), np.ones(len(x), bool)
            for k in range(n - 1):
                total = total + d[(i + k) % n]
                ok &= total <= (k + 1) * MAX_BITS // n
            found |= ok
        return found

    def first_key(self, x: np.ndarray) -> np.ndarray:
        """The number of the first key that two fingerprints share, from their differing bits."""
        n = len(self.widths)
        number = np.full((n,) * self.equal, -1)
        for i, some in enumerate(combinations(range(n), self.equal)):
            number[some] = i
        other = np.stack([(x & m) != 0 for m in self.masks], axis=1)
        some = np.argsort(other, axis=1, kind="stable")[:, : self.equal]
        return number[tuple(some.T)]


#: Keys of 27 or 28 bits: fewer segments make fewer keys, but then unlike fingerprints share keys by chance.
RING = Ring((9, 9, 9, 9, 9, 9, 10))


def _hashes(text: bytes | None) -> tuple[np.ndarray, int]:
    """Hashes of a text's shingles of WORDS words in order, and its number of words."""
    tokens = (text or b"").lower().split()  # both are ASCII only on bytes
    h = xxhash.xxh64_intdigest
    if len(tokens) <= WORDS:
        return np.array([h(b" ".join(tokens), SEED)] if tokens else [], np.uint64), len(tokens)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[WORDS - 1 :].tolist()
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[: len(stops)].tolist(), stops)), np.uint64, len(stops)), len(tokens)


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a text given as UTF-8."""
    return _vote(_hashes(text)[0])


def _vote(hashes: np.ndarray) -> int:
    """Each bit that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def odd_sketch(hashes: np.ndarray) -> bytes:
    """SKETCH bits, each whether an odd number of distinct hashes falls to it.

    The differing bits of two sketches are never more than the hashes that only one text has.
    """
    return np.packbits(np.bincount((np.unique(hashes) >> np.uint64(7)) & np.uint64(SKETCH - 1), minlength=SKETCH) & 1).tobytes()


def most_apart(words_a: np.ndarray, words_b: np.ndarray) -> np.ndarray:
    """A bound of the shingles of WORDS words that only one of two similar texts has.

    Sets of a and b shingles with a similarity of s differ in (a + b) (1 - s) / (1 + s). A
    shingle of WORDS words that only one text has begins a longer one that only it has, but
    for the last of either text. A text has no more shingles than places for them.
    """
    places = np.maximum(words_a - SIMILAR_WORDS + 1, 1) + np.maximum(words_b - SIMILAR_WORDS + 1, 1)
    return places * (1 - SIMILARITY) / (1 + SIMILARITY) + 2 + 1e-9


#: What the words' hashes are combined with, for each bit of the prints of word sets, and which bit of the least result counts.
_MIX = (np.arange(1, 64 * WORD_PRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93)
_BIT = (np.arange(64 * WORD_PRINTS) % 29).astype(np.uint64)


def word_fingerprints(text: bytes | None) -> list[int]:
    """WORD_PRINTS prints of the set of a text's words; each bit is one of the word that comes first in an order of its own.

    Two sets with a Jaccard similarity of J differ in 64 (1 - J) / 2 bits of a print on
    average (one-bit minwise hashing), fewer than votes over all words would give.
    """
    words = list(set((text or b"").lower().split()))
    if not words:
        return [0] * WORD_PRINTS
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    least = np.full(len(_MIX), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        x = (h[i : i + 1024, None] ^ _MIX) * np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, x.min(axis=0), out=least)
    bits = (((least * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)) >> _BIT) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64).tolist()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        _fingerprints, "doc_id long, fp long"
    )


def _forest(key: np.ndarray, fp: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over rows that are sorted by key, as two arrays of fp."""
    n = len(key)
    root = np.arange(n)
    at, gap = np.arange(n), 0
    while len(at):
        gap += 1
        at = at[at + gap < n]
        at = at[key[at + gap] == key[at]]
        a = at[root[at] != root[at + gap]]
        x = fp[a] ^ fp[a + gap]
        keep = ring.viable(x)
        a, x = a[keep], x[keep]
        hits = a[np.bitwise_count(x) <= MAX_BITS]
        for i in hits.tolist():
            p, q = i, i + gap
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            root[max(p, q)] = min(p, q)
        if len(hits):
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    child = np.flatnonzero(root != np.arange(n))
    return fp[root[child]], fp[child]


def _links(ring: Ring):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, fp) sorted by key; a key's rows may run over several batches."""
        keep_k, keep_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def links(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = _forest(k, f, ring)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            k = np.concatenate([keep_k, batch.column(0).to_numpy()])
            f = np.concatenate([keep_f, batch.column(1).to_numpy().view(np.uint64)])
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))
            yield links(k[:cut], f[:cut])
            keep_k, keep_f = k[cut:], f[cut:]
        yield links(keep_k, keep_f)

    return rows


def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = [np.uint64(1 << i) for i in range(64)]
    flips = np.array([0, *one, *(a | b for a, b in combinations(one, 2))], np.uint64)
    for batch in batches:
        for f in batch.column(0).to_numpy().view(np.uint64):
            near = f ^ flips
            yield pa.RecordBatch.from_arrays([pa.array(near.view(np.int64)), pa.array(np.full(len(near), f).view(np.int64))], ["z", "fp"])


def keyed(df: DataFrame, prints: Column, carry: list[str], ring: Ring, wanted: DataFrame | None = None) -> DataFrame:
    """key, w (the fingerprint) and ``carry``, longs, for each key of each fingerprint of an array column.

    If there are at most FILTER_KEYS ``wanted`` keys (staged), most rows with other keys are left
    out by a bitmap of their hashes; whoever asks joins by key all the same.
    """
    shared = None
    if wanted is not None and (n := wanted.count()) <= FILTER_KEYS:
        bits = max(10, (16 * n).bit_length())
        found = wanted.select("key").toArrow()["key"].to_numpy().view(np.uint64)
        mask = np.zeros(1 << bits, bool)
        mask[(found * _MARK) >> np.uint64(64 - bits)] = True
        shared = df.sparkSession.sparkContext.broadcast((bits, np.packbits(mask, bitorder="little")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                x = batch.column(0).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
                others = [batch.column(i + 1).to_numpy() for i in range(len(carry))]
                for which in range(x.shape[1]):
                    key = ring.keys(x[:, which]) | np.uint64(which << 48)
                    at = np.broadcast_to(np.arange(batch.num_rows), key.shape).ravel()
                    key = key.ravel()
                    if shared is not None:
                        bits, mask = shared.value
                        h = (key * _MARK) >> np.uint64(64 - bits)
                        keep = np.flatnonzero((mask[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1)
                        key, at = key[keep], at[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(x[at, which].view(np.int64)), *(pa.array(o[at]) for o in others)], ["key", "w", *carry])

    return df.select(prints.alias("prints"), *carry).mapInArrow(rows, ", ".join(f"{c} long" for c in ["key", "w", *carry]))


def links(classes: DataFrame, max_group: int = MAX_GROUP, ring: Ring = RING) -> DataFrame:
    """Links a, b between distinct fingerprints that give the components of all links."""
    own = F.array("fp")
    busy = stage(keyed(classes, own, [], ring).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    sized = stage(join_checked(keyed(classes, own, [], ring, busy).withColumnRenamed("w", "fp"), busy, "key", rows=FEW_KEYS))
    small = sized.filter(F.col("n") <= max_group).select("key", "fp")
    found = small.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(ring), "a long, b long")
    large = sized.filter(F.col("n") > max_group).select("fp")
    if not large.isEmpty():
        near = stage(large.distinct().mapInArrow(_ball, "z long, fp long"))
        least = near.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("z", "a")
        found = found.union(near.join(least, "z").filter("fp <> a").select("a", F.col("fp").alias("b")))
    return found.distinct()


class Part(NamedTuple):
    """Rows sorted by key and part."""

    key: np.ndarray
    part: np.ndarray
    w: np.ndarray
    fp: np.ndarray
    root: np.ndarray
    block: np.ndarray
    two: np.ndarray
    words: np.ndarray
    sketch: np.ndarray

    def take(self, at) -> Part:
        return Part(*(x[at] for x in self))


def _near_in_words(rows: Part, forest: bool, ring: Ring) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one part that have different roots and pass the tests: both Hamming distances and the sketches.

    A pair is given under the first key that it shares, and where a part is made of two
    blocks only if its rows are of different ones. With ``forest`` a pair is left out if
    pairs before it join its rows, given here or under the key that gives them.
    """
    if not len(rows.key):
        return
    change = np.append(True, (rows.key[1:] != rows.key[:-1]) | (rows.part[1:] != rows.part[:-1]))
    starts = np.flatnonzero(change)
    mixed = np.minimum.reduceat(rows.root, starts) < np.maximum.reduceat(rows.root, starts)
    rows = rows.take(mixed[np.cumsum(change) - 1])
    n = len(rows.key)
    if not n:
        return
    change = np.append(True, (rows.key[1:] != rows.key[:-1]) | (rows.part[1:] != rows.part[:-1]))
    starts = np.flatnonzero(change)
    group, size = np.cumsum(change) - 1, np.diff(np.append(starts, n))
    # roots as numbers of their own in each group, which the pairs of a forest join
    order = np.lexsort((rows.root, group))
    fresh_root = np.append(True, (group[order][1:] != group[order][:-1]) | (rows.root[order][1:] != rows.root[order][:-1]))
    local = np.empty(n, np.int64)
    local[order] = np.cumsum(fresh_root) - 1
    joined = np.arange(int(local.max()) + 1)
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def root(x: int) -> int:
        while joined[x] != x:
            joined[x] = joined[joined[x]]
            x = joined[x]
        return x

    def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = rows.w[a] ^ rows.w[b]
        ok = np.bitwise_count(x) <= MAX_BITS
        a, b, x = a[ok], b[ok], x[ok]
        ok = ring.viable(x) & (np.bitwise_count(rows.fp[a] ^ rows.fp[b]) <= FAR_BITS)
        a, b = a[ok], b[ok]
        apart = np.bitwise_count(rows.sketch[a] ^ rows.sketch[b]).sum(axis=1, dtype=np.int64)
        ok = apart <= most_apart(rows.words[a], rows.words[b])
        return a[ok], b[ok]

    def give(a: np.ndarray, b: np.ndarray) -> bool:
        """Takes near pairs; whether some roots were joined."""
        if forest:
            keep = np.zeros(len(a), bool)
            for i, (p, q) in enumerate(zip(local[a].tolist(), local[b].tolist())):
                p, q = root(p), root(q)
                if p != q:
                    joined[max(p, q)] = min(p, q)
                    keep[i] = True
            a, b = a[keep], b[keep]
        some = bool(len(a))
        mine = ring.first_key(rows.w[a] ^ rows.w[b]) == (rows.key[a] >> 40) & 0xFF
        mine &= ~rows.two[a] | (rows.block[a] != rows.block[b])
        pending.append((rows.fp[a[mine]], rows.fp[b[mine]]))
        return some and forest

    def settle() -> None:
        nonlocal local
        while not np.array_equal(up := joined[joined], joined):
            joined[:] = up
        local = joined[local]

    at = np.arange(n)
    for gap in range(1, NEAR):
        at = at[at + gap < n]
        at = at[group[at + gap] == group[at]]
        if not len(at):
            break
        a = at[local[at] != local[at + gap]]
        if len(a) and give(*near(a, a + gap)):
            settle()
    for g in np.flatnonzero(size > NEAR).tolist():  # the rest of large parts: rows outside the largest component meet all
        here = np.arange(starts[g], starts[g] + size[g])
        names, count = np.unique(local[here], return_counts=True)
        if len(names) == 1:
            continue
        most = names[count.argmax()]
        for i in here[local[here] != most].tolist():
            others = here[(local[here] != local[i]) & (np.abs(here - i) >= NEAR) & ((local[here] == most) | (here > i))]
            if len(others) and give(*near(np.full(len(others), i), others)):
                settle()
        if sum(len(x[0]) for x in pending) > CHUNK:
            yield tuple(map(np.concatenate, zip(*pending)))
            pending = []
    if pending:
        yield tuple(map(np.concatenate, zip(*pending)))


def _word_pairs(forest: bool, ring: Ring):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows as in ``Part``, sorted by key and part; a part's rows may run over several batches."""
        kept: Part | None = None

        def pairs(some: Part) -> Iterator[pa.RecordBatch]:
            for a, b in _near_in_words(some, forest, ring):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            got = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(Part._fields) - 1)]
            got[2], got[3] = got[2].view(np.uint64), got[3].view(np.uint64)
            sketch = np.frombuffer(b"".join(batch.column(len(got)).to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            now = Part(*got, sketch)
            if kept is not None:
                now = Part(*(np.concatenate(x) for x in zip(kept, now)))
            last = (now.key == now.key[-1]) & (now.part == now.part[-1])
            cut = len(last) - int(last.sum())
            yield from pairs(now.take(slice(0, cut)))
            kept = now.take(slice(cut, None))
        if kept is not None:
            yield from pairs(kept)

    return rows


def word_links(rooted: DataFrame, texts: DataFrame, max_group: int = MAX_GROUP, ring: Ring = RING) -> DataFrame | None:
    """Links a, b that join all documents of different components whose word sets are near and whose shingles are similar.

    ``rooted`` has fp, root, row, words, sketch and ws, the fingerprints of the word sets;
    ``texts`` has row and text. Every pair that passes the tests of ``_near_in_words`` is
    verified, unless links found before join it. The first round takes a spanning forest
    of the near pairs of each group, as if all were similar, and contracts the components
    of those that are. If all were, nothing is left; else a last round verifies all near pairs
    that still have different roots. A group of over ``max_group`` rows is dealt
    into blocks by hash: each block is a part, and so are any two blocks, nearer ones before
    farther ones. So a task has two blocks at once, and no pair is left out.
    """
    roots_of = keyed(rooted, F.col("ws"), ["root"], ring).groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    busy = stage(roots_of.filter("low < high").select("key"))
    shared = stage(join_checked(keyed(rooted, F.col("ws"), ["fp"], ring, busy), busy, "key", rows=FEW_KEYS))
    sized = shared.join(shared.groupBy("key").agg(F.count("*").alias("n")), "key")
    roots = stage(rooted.select("fp", "root", "row", "words", "sketch").join(shared.select("fp").distinct(), "fp", "left_semi"))  # no others can link
    count = f"cast(ceil(n / {max_group}) as bigint)"
    dealt = sized.selectExpr("key", "w", "fp", f"{count} as blocks", f"pmod(xxhash64(fp), {count}) as block")
    blocks = sized.selectExpr(f"max({count}) as blocks").first().blocks or 1
    found: list[DataFrame] = []
    refuted = False

    def ask(parts: DataFrame, forest: bool) -> None:
        """Verifies the near pairs of ``parts`` and contracts the components of similar ones."""
        nonlocal roots, refuted
        rows = join_checked(parts, roots.select("fp", "root", "words", "sketch"), "fp", rows=FEW_WIDE).select(*Part._fields)
        near = rows.repartition("key", "part").sortWithinPartitions("key", "part", "fp").mapInArrow(_word_pairs(forest, ring), "a long, b long")
        pairs = stage(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        asked = pairs.count()
        if not asked:
            return
        good = stage(similar(pairs, roots.select("fp", "row"), texts))
        discard(pairs)
        true = good.count()
        refuted |= true < asked
        if not true:
            return
        found.append(good)
        of_a, of_b = roots.selectExpr("fp as a", "root as u"), roots.selectExpr("fp as b", "root as v")
        joined = stage(components(good.join(of_a, "a").join(of_b, "b").selectExpr("u as a", "v as b"))).selectExpr("node as root", "root as new")
        last, roots = roots, stage(join_checked(roots, joined, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new"))
        discard(last)

    def apart(least: int, most: int) -> DataFrame:
        """Parts of two blocks each that are ``least`` to ``most`` places from each other."""
        by = f"explode(sequence({least}L, least({most}L, blocks - 1))) as by"
        sides = dealt.filter(F.col("blocks") > least).selectExpr("*", by).selectExpr("*", "explode(array(block, block - by)) as first")
        sides = sides.filter("first >= 0 and first + by < blocks")
        return sides.selectExpr("key", "w", "fp", "first * blocks + by as part", "block", "true as two")

    alone = dealt.selectExpr("key", "w", "fp", "0L as part", "block", "false as two").withColumn("part", F.col("block") * blocks)
    steps = [(1 << i, (2 << i) - 1) for i in range((blocks - 1).bit_length())]
    for forest in (True, False):
        if forest or refuted:
            ask(alone, forest)
            for least, most in steps:
                ask(apart(least, most), forest)
    discard(busy, shared, roots)
    return reduce(DataFrame.union, found) if found else None


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for t in batch.column(1):
            words = (t.as_py() or b"").lower().split()
            parts = {b" ".join(words[i : i + SIMILAR_WORDS]) for i in range(max(1, len(words) - SIMILAR_WORDS + 1))}
            sets.append(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), np.uint64, len(parts)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["fp", "shingles"])


def similar(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose documents share at least SIMILARITY of their shingles.

    ``reps`` gives fp and row of one document for each fingerprint; ``texts`` has row and text.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = stage(reps.join(wanted, "fp"))
    found = join_checked(texts, wanted, "row", rows=FEW_KEYS).select("fp", F.col("text").cast("binary").alias("text"))
    sets = stage(found.mapInArrow(_shingle_sets, "fp long, shingles array<long>"))
    left = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    met = pairs.join(left, "a").join(right, "b").withColumn("s", shared)
    return met.filter(F.col("s") >= SIMILARITY * (F.size("x") + F.size("y") - F.col("s"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node and root of every node of ``edges`` (a, b): the least node that it reaches.

    Large and small stars in turn (Kiveris et al., Connected components in MapReduce and beyond):
    each round is two joins with per-node minima, and ends when no edge changes, which
    their number and two sums of their hashes tell.
    """
    def settled(df: DataFrame) -> tuple[DataFrame, tuple]:
        out = stage(df)
        h = F.xxhash64("u", "v")
        return out, tuple(out.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())

    e, mark = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        # a neighbour that is not the least one hangs below it, and so does the node
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        new, now = settled(small.select("x.u", "x.v").filter("u <> v").distinct())
        discard(e)
        e, same, mark = new, now == mark, now
        if same:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_group: int = MAX_GROUP) -> DataFrame:
    """doc_id, fp, component_id of each row; component_id is the smallest id it reaches."""
    prints = stage(fingerprints(docs, id_col, text_col))
    return _with_components(prints, max_group)


def _with_components(prints: DataFrame, max_group: int, ring: Ring = RING) -> DataFrame:
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(classes, max_group, ring))
    reach = stage(classes.join(root, classes.fp == root.node).select("fp", "root", "least"))
    least = reach.groupBy("root").agg(F.min("least").alias("all_least"))
    linked = reach.join(least, "root").select("fp", "all_least")
    ids = classes.join(linked, "fp", "left").select("fp", F.coalesce("all_least", "least").alias("component_id"))
    return prints.join(stage(ids), "fp")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def numbered(docs: DataFrame, out: str) -> DataFrame:
    """``docs`` with a struct ``out``: row (a number of its own), doc_id, th, fp, ws, words, sketch. To be staged."""
    columns = docs.columns
    row, id_at, hash_at, text_at = (fresh(docs, x) for x in ("row", "id", "hash", "bytes"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            fp, ws, sizes, sketches = [], [], [], []
            for t in column[text_at]:
                text = t.as_py()
                h, n = _hashes(text)
                fp.append(_vote(h))
                ws.append(np.array(word_fingerprints(text), np.uint64).view(np.int64))
                sizes.append(n)
                sketches.append(odd_sketch(h))
            made = [column[row], column[id_at], column[hash_at], pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(ws, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
            struct = pa.StructArray.from_arrays(made, ["row", "doc_id", "th", "fp", "ws", "words", "sketch"])
            yield pa.RecordBatch.from_arrays([*(column[c] for c in columns), struct], [*columns, out])

    helpers = {row: F.monotonically_increasing_id(), id_at: F.col("doc_id").cast("long"), hash_at: F.xxhash64("text"), text_at: F.col("text").cast("binary")}
    kind = StructType.fromDDL("row long, doc_id long, th long, fp long, ws array<long>, words long, sketch binary")
    return docs.withColumns(helpers).mapInArrow(rows, StructType([*docs.schema.fields, StructField(out, kind)]))


def keep_one(docs: DataFrame, max_group: int = MAX_GROUP, ring: Ring = RING) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id.

    Besides fingerprints that link, copies are found that changed in more places: documents
    whose word sets are near (by the same search over WORD_PRINTS other fingerprints) and
    that share at least SIMILARITY of their SIMILAR_WORDS-word shingles, which is verified.
    Among rows that share an id the one with the smallest text hash stays, once. Texts are
    written once with their fingerprints, and shuffled only where over FEW_KEYS rows go.
    """
    out = fresh(docs, "prints")
    held = stage(numbered(docs, out))
    prints = held.select(f"{out}.*")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "row", "ws", "words", "sketch"))
    classes = stage(prints.groupBy("fp").agg(rep.alias("rep")))
    edges = stage(links(classes.select("fp"), max_group, ring))
    rooted = classes.join(components(edges), classes.fp == F.col("node"), "left")
    rooted = stage(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "rep.row", "rep.words", "rep.sketch", "rep.ws"))
    more = word_links(rooted, held.select(F.col(f"{out}.row").alias("row"), "text"), max_group, ring)
    linked = components(edges if more is None else edges.union(more))
    names = F.struct("rep.last", "rep.doc_id", "rep.th", "rep.row").alias("rep")
    grouped = classes.select("fp", names).join(linked, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root"))
    chosen = grouped.agg(F.min("rep").alias("x")).select("x.row")
    row = fresh(docs, "row")
    gone = stage(prints.select("row").join(chosen, "row", "left_anti").select(F.col("row").alias(row)))
    discard(classes, edges, rooted)
    return join_checked(held.withColumn(row, F.col(f"{out}.row")), gone, row, "left_anti", FEW_KEYS).select(*docs.columns)
