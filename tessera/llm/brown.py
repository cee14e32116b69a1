"""Brown class-based bigrams: exchange clustering, class transitions and word emissions.

Every word of the training texts belongs to a class; the end of a text has class 0 alone.
The ``OWN`` most frequent words are clustered by the exchange algorithm: one after another
moves to the class that gives the training text the highest likelihood, until none moves;
bigrams with other words count there as bigrams with one fixed class. Each other word
then goes to the class under which the contexts that it has among those words and ends are
likeliest (log p(class | before) + log p(after | class) - log n(class), over all its
occurrences, and the log share of the class among the less frequent own words). So the table
of words, counts and classes grows with the vocabulary. A word of the training texts
without such a context belongs to the class with the most distinct words.

    score = log10 of the product of p(class | class before) p(word | class)
    p(class | before) = (n(before, class) + LAMBDA p(class)) / (n(before) + LAMBDA)
    p(word | class)   = (c(word) + 0.5) / (n(class) + 0.5 (v(class) + 1))

where n counts over all training texts with all words in their classes, and v counts the
distinct words of a class; one more stands for unknown words in each class, so the
probabilities of a run of unknown words are sums over the classes that it may have (the
end has no unknown words). A text begins after an end.

Texts are read once and kept as numbers: the place of each word in the ``HEAD`` most
frequent ones, which every task knows, or in the list of the text's other words. The
counts and classes of those are joined by word. What the driver holds is bounded: the
head, the bigrams of the own words, and the classes' transitions.

Defined cases: null text is empty and has the end alone; a null doc_id counts as the empty
string for the split; a very long text is one row, of 4 bytes a token; repeated rows are
scored one by one; with no training document the model is flat; other columns of the input
are not read, so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage

HEAD = 262_144
#: Words of more bytes than this are never in the head, which bounds its size.
HEAD_BYTES = 64
#: Words that the exchange moves one by one.
OWN = 1536
#: Classes, at most 128; 0 is the end's.
CLASSES = 50
LAMBDA = 5.0
#: Runs of unknown words up to this length are kept ready.
CACHED_RUNS = 64
#: Steps of the histogram of counts for each power of two.
COUNT_STEPS = 64
#: Distinct words, and bigrams or contexts, that a task gathers before it sends them on.
FLUSH_WORDS = 400_000
FLUSH_TOKENS = 2_000_000


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # ASCII only on bytes


def _sources(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id = F.col(id_col).cast("long")
    held = F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 1
    return docs.select(doc_id.alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("binary").alias("text"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def send() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for t in batch.column(0):
            seen.update(tokens(t.as_py()))
            seen[b""] += 1
            if len(seen) > FLUSH_WORDS:
                yield send()
                seen.clear()
    yield send()


def _head(vocabulary: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words and their counts: at most HEAD words of at most HEAD_BYTES bytes.

    A histogram of counts over log steps says from which count on all words fit, so that
    no task sorts the vocabulary.
    """
    short = vocabulary.filter(F.length("word") <= HEAD_BYTES).withColumn("step", F.floor(F.log2("n") * COUNT_STEPS).cast("int"))
    have = sorted(((r.step, r.k) for r in short.groupBy("step").agg(F.count("*").alias("k")).collect()), reverse=True)  # at most 64 * COUNT_STEPS rows
    least, total = None, 0
    for step, k in have:
        total += k
        if total > HEAD:
            break
        least = step
    if least is None:
        return [], np.empty(0, np.int64)
    head = short.filter(F.col("step") >= least).select("word", "n").toArrow()
    head = head.sort_by([("n", "descending"), ("word", "ascending")])
    return head["word"].to_pylist(), head["n"].to_numpy()


def _read(shared):
    """Texts as numbers: key, doc_id, held_out, ids (4 bytes each: a place in the head, or -1 - a place in others), others."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(shared.value)}
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, others, keys = [], [], []
            for t in batch.column(2):
                words = tokens(t.as_py())
                known = [at.get(w) for w in words]
                if None in known:
                    other: dict[bytes, int] = {}
                    for i, k in enumerate(known):
                        if k is None:
                            known[i] = -1 - other.setdefault(words[i], len(other))
                    others.append(list(other))
                else:
                    others.append([])
                ids.append(np.array(known, "<i4").tobytes())
                key += 1
                keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(others, pa.list_(pa.binary()))], ["key", "doc_id", "held_out", "ids", "others"])

    return rows


READ = "key long, doc_id long, held_out boolean, ids binary, others array<binary>"


def _chain(ids: bytes, of: np.ndarray, other: int | np.ndarray, end: int) -> np.ndarray:
    """The values ``of`` a text's words, ``other`` for words outside the head, between two ends."""
    at = np.frombuffer(ids, "<i4")
    out = np.empty(len(at) + 2, of.dtype)
    out[0] = out[-1] = end
    inside = at >= 0
    out[1:-1][inside] = of[at[inside]]
    out[1:-1][~inside] = other if isinstance(other, int) else other[-1 - at[~inside]]
    return out


def _pairs(chains: Iterator[np.ndarray], size: int) -> Iterator[pa.RecordBatch]:
    """Counts of neighbours in chains of numbers below ``size``."""
    total, pending, held = np.zeros(size * size, np.int64), [], 0
    for c in chains:
        pending.append(c[:-1].astype(np.int64) * size + c[1:])
        held += len(c)
        if held > FLUSH_TOKENS:
            total += np.bincount(np.concatenate(pending), minlength=size * size)
            pending, held = [], 0
    if pending:
        total += np.bincount(np.concatenate(pending), minlength=size * size)
    pair = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(total[pair], pa.int64())], ["pair", "n"])


def _matrix(rows: DataFrame, counts, size: int) -> np.ndarray:
    """The sums of what ``counts`` gives for each task, as a matrix."""
    got = rows.mapInArrow(counts, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most size ** 2 rows
    out = np.zeros(size * size)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size, size)


def exchange(n: np.ndarray, classes: int, fixed: int = 1) -> np.ndarray:
    """A class for each item, from the matrix of bigram counts, in sweeps until none moves.

    The last ``fixed`` items stay where they are: the very last, the end, in class 0, those
    before it in classes of their own after the others.
    """
    size = len(n)
    free = size - fixed
    weight = n.sum(axis=0) + n.sum(axis=1)
    order = np.argsort(-weight[:free], kind="stable")
    of = np.zeros(size, int)
    of[order] = 1 + np.arange(free) % (classes - 1)
    of[free : size - 1] = classes + np.arange(fixed - 1)
    member = np.eye(classes + fixed - 1)[of]
    right, left = n @ member, n.T @ member  # of each item: to, and from, each class
    between = member.T @ right

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1))

    moved = 1
    while moved:
        moved = 0
        for w in order[weight[order] > 0].tolist():
            a, s = of[w], n[w, w]
            r, c = right[w].copy(), left[w].copy()
            r[a] -= s
            c[a] -= s
            between[a] -= r
            between[:, a] -= c
            between[a, a] -= s
            own = np.diag(between)
            out, into = between.sum(axis=1), between.sum(axis=0)
            to, came = np.flatnonzero(r), np.flatnonzero(c)
            gain = (f(between[:, to] + r[to]) - f(between[:, to])).sum(axis=1) + (f(between[came] + c[came, None]) - f(between[came])).sum(axis=0)
            gain += f(own + r + c + s) - f(own) - (f(own + r) - f(own)) - (f(own + c) - f(own))
            out, into = out + c, into + r  # the item's neighbours keep their totals wherever it goes
            gain -= f(out + r.sum() + s) - f(out) + f(into + c.sum() + s) - f(into)
            gain[0] = gain[classes:] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-6:
                b = a
            between[b] += r
            between[:, b] += c
            between[b, b] += s
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= n[:, w]
                right[:, b] += n[:, w]
                left[:, a] -= n[w]
                left[:, b] += n[w]
    return of


def context_scores(between: np.ndarray) -> np.ndarray:
    """What one occurrence of a context adds to each class: rows are contexts (classes before, then after).

    ``between`` counts transitions among the classes of own words; smoothed as transitions are.
    """
    size = len(between)
    of_class = between.sum(axis=0)
    prior = (of_class + 1) / (of_class + 1).sum()
    step = np.log((between + LAMBDA * prior) / (between.sum(axis=1, keepdims=True) + LAMBDA))
    emit = np.log(of_class + 1)
    out = np.concatenate([step - emit, step.T])
    assert out.shape == (2 * size, size)
    return out


def _contexts(shared):
    """Rows word, n (0), contexts and times (4 bytes each) of the words that are not own, for contexts that are own words or ends."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of = shared.value  # of the head: the class of own words, -1 for others
        at: dict[bytes, int] = {}
        local, codes, held = [], [], 0

        def send() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate([*codes, np.empty(0, np.int64)]), return_counts=True)
            number, context = np.divmod(code, 2 * CLASSES)
            first = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.empty(0, np.int64)
            which, ends = number[first], np.append(first, len(number))
            inside = which < len(words)
            names = pa.array([words[i] for i in which[inside].tolist()] + [local[i] for i in (which[~inside] - len(words)).tolist()], pa.binary())
            lists = [pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (context.astype(np.uint8), n.astype("<u4"))]
            return pa.RecordBatch.from_arrays([names, pa.array(np.zeros(len(names), np.int64)), *lists], ["word", "n", "contexts", "times"])

        for batch in batches:
            for ids, others in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = np.empty(len(others), np.int64)
                for j, w in enumerate(others):
                    k = at.get(w)
                    if k is None:
                        k = at[w] = len(local)
                        local.append(w)
                    mine[j] = len(words) + k
                cls = _chain(ids, of, -1, 0)
                number = np.frombuffer(ids, "<i4").astype(np.int64)
                outside = number < 0
                number[outside] = mine[-1 - number[outside]]
                for side in (0, 1):
                    near = cls[:-2] if side == 0 else cls[2:]
                    take = (cls[1:-1] < 0) & (near >= 0)
                    codes.append(number[take] * (2 * CLASSES) + side * CLASSES + near[take])
                    held += len(codes[-1])
            if held > FLUSH_TOKENS or len(local) > FLUSH_WORDS:
                yield send()
                at, local, codes, held = {}, [], [], 0
        yield send()

    return rows


def _assign(shared):
    """Rows as of ``_contexts``, and of counts, sorted by word, give word, n, class.

    A word's rows may run over any number of batches; only their sums are carried.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scores, share, none = shared.value
        open_word, open_n, open_seen = None, 0, np.zeros(2 * CLASSES)

        def classes(names: list[bytes], total: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
            gain = seen @ scores + share
            gain[:, 0] = -np.inf
            cls = np.where(seen.any(axis=1), gain.argmax(axis=1), none).astype(np.int32)
            for i, w in enumerate(names):
                if w in own:
                    cls[i] = own[w]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(total, pa.int64()), pa.array(cls)], ["word", "n", "class"])

        for batch in batches:
            if not batch.num_rows:
                continue
            word, n = batch.column(0), batch.column(1).to_numpy()
            context, times = (b"".join(batch.column(i).to_pylist()) for i in (2, 3))
            context, times = np.frombuffer(context, np.uint8).astype(np.int64), np.frombuffer(times, "<u4")
            each = pc.binary_length(batch.column(2)).to_numpy()
            first = np.append(True, pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False))
            run = np.cumsum(first) - 1
            names = word.take(pa.array(np.flatnonzero(first))).to_pylist()
            total = np.bincount(run, n, len(names)).astype(np.int64)
            seen = np.bincount(run.repeat(each) * (2 * CLASSES) + context, times, len(names) * 2 * CLASSES).reshape(len(names), 2 * CLASSES)
            if open_word == names[0]:
                total[0] += open_n
                seen[0] += open_seen
            elif open_word is not None:
                yield classes([open_word], np.array([open_n]), open_seen[None])
            open_word, open_n, open_seen = names[-1], total[-1], seen[-1].copy()
            yield classes(names[:-1], total[:-1], seen[:-1])
        if open_word is not None:
            yield classes([open_word], np.array([open_n]), open_seen[None])

    return rows


def _known(others: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts (0: unknown) and classes (-1: unknown) of a text's other words, by their places."""
    got = others or []
    n, cls = np.zeros(len(got), np.int64), np.full(len(got), -1, np.int32)
    for o in got:
        if o["n"] is not None:
            n[o["j"]], cls[o["j"]] = o["n"], o["class"]
    return n, cls


class Runs:
    """Log probabilities of ways between known classes, over runs of unknown words."""

    def __init__(self, step: np.ndarray, unknown: np.ndarray):
        self.step, self.once, self.cached = step, unknown[:, None] * step, {0: np.log10(step)}

    def over(self, run: int) -> np.ndarray:
        """log10 of step (diag(unknown) step) ** run, scaled as it goes, by repeated squaring."""
        if run not in self.cached:
            left, square, log, log_square, bits = self.step, self.once, 0.0, 0.0, run
            while bits:
                if bits & 1:
                    left = left @ square
                    log += log_square + math.log10(left.max())
                    left = left / left.max()
                bits >>= 1
                square = square @ square
                log_square = 2 * log_square + math.log10(square.max())
                square = square / square.max()
            out = np.log10(left) + log
            if run > CACHED_RUNS:
                return out
            self.cached[run] = out
        return self.cached[run]

    def path(self, classes: np.ndarray) -> float:
        """Of a chain of classes, with -1 for unknown words, that begins and ends with known ones."""
        at = np.flatnonzero(classes >= 0)
        run, a, b = np.diff(at) - 1, classes[at[:-1]], classes[at[1:]]
        return sum(float(self.over(int(k))[a[run == k], b[run == k]].sum()) for k in np.unique(run))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    sc = docs.sparkSession.sparkContext
    source = _sources(docs, id_col, text_col)
    train = source.filter(~F.col("held_out")).select("text")
    vocabulary = stage(train.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    words, counts = _head(vocabulary)
    read = stage(source.mapInArrow(_read(sc.broadcast(words)), READ))
    trained = read.filter(~F.col("held_out"))

    # the exchange over own words; the end is a word of the vocabulary, but no word of a text
    own = [i for i, w in enumerate(words) if w][:OWN]
    item = np.full(len(words), len(own), np.int32)
    item[own] = np.arange(len(own))
    item_of = sc.broadcast(item)
    size = len(own) + 2

    def own_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pairs((_chain(x, item_of.value, size - 2, size - 1) for b in batches for x in b.column(0).to_pylist()), size)

    n = _matrix(trained.select("ids"), own_pairs, size)
    of = exchange(n, CLASSES, 2)
    member = np.eye(CLASSES + 1)[of][:, :CLASSES]
    scores = context_scores(member.T @ n @ member)
    late = of[len(own) // 2 : len(own)]  # the less frequent half
    share = np.log(np.bincount(late, minlength=CLASSES) + 1.0)
    cls = np.full(len(words), -1, np.int32)
    cls[own] = of[: len(own)]
    classes_of_own = {words[i]: int(cls[i]) for i in own} | {b"": 0}

    # the other words, by their contexts; one more row carries each word's count
    met = trained.select("ids", "others").mapInArrow(_contexts(sc.broadcast((words, cls))), "word binary, n long, contexts binary, times binary")
    nothing = F.lit(b"")
    met = met.union(vocabulary.select("word", "n", nothing.alias("contexts"), nothing.alias("times"))).withColumn("h", F.xxhash64("word"))
    met = met.repartition("h").sortWithinPartitions("h", "word").drop("h")
    none = CLASSES  # no context at all: settled below
    table = stage(met.mapInArrow(_assign(sc.broadcast((classes_of_own, scores, share, none))), "word binary, n long, class int"))
    discard(vocabulary)
    types = {r["class"]: (r.n, r.v) for r in table.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # a row for each class
    of_class, types_of = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, (total, v) in types.items():
        if c < CLASSES:
            of_class[c], types_of[c] = total, v
    rare = 1 + int(np.argmax(types_of[1:]))
    total, v = types.get(none, (0, 0))
    of_class[rare] += total
    types_of[rare] += v
    table = table.withColumn("class", F.when(F.col("class") == none, rare).otherwise(F.col("class")))
    train_tokens, types_all = int(of_class.sum()), sum(v for _, v in types.values())

    least = int(counts.min()) if len(words) else 0
    in_head = table.filter((F.col("n") >= least) & (F.length("word") <= HEAD_BYTES)).select("word", "class").toArrow()  # the head's rows
    class_of = dict(zip(in_head["word"].to_pylist(), in_head["class"].to_numpy().tolist()))
    head_class = np.array([class_of[w] for w in words], np.int32)

    # counts and classes of the words outside the head, by text
    asked = read.select("key", F.posexplode("others").alias("j", "word"))
    found = asked.join(table, "word", "left").groupBy("key").agg(F.collect_list(F.struct("j", "n", "class")).alias("others"))
    resolved = stage(read.drop("others").join(found, "key", "left").select("doc_id", "held_out", "ids", "others"))
    discard(read)
    shared = sc.broadcast((head_class, np.log10(counts + 0.5)))

    def class_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chains() -> Iterator[np.ndarray]:
            for b in batches:
                for ids, others in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield _chain(ids, shared.value[0], _known(others)[1], 0)  # training texts have no unknown words

        return _pairs(chains(), CLASSES)

    between = _matrix(resolved.filter(~F.col("held_out")).select("ids", "others"), class_pairs, CLASSES)
    prior = (of_class + 1) / (of_class + 1).sum()
    step = (between + LAMBDA * prior) / (between.sum(axis=1, keepdims=True) + LAMBDA)
    under = of_class + 0.5 * (types_of + 1)  # what p(word | class) divides by
    under[0] = of_class[0] + 0.5
    unknown = 0.5 / under
    unknown[0] = 0
    base = float(np.log10(train_tokens + 0.5 * (types_all + 1)))
    end = float(np.log10(of_class[0] + 0.5))
    seen_end = bool(of_class[0])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, log_n = shared.value
        log_under, over = np.log10(under), Runs(step, unknown)
        for b in batches:
            out = []
            for ids, others in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                n, known = _known(others)
                path = _chain(ids, classes, known, 0)
                at = np.frombuffer(ids, "<i4")
                inside = at[at >= 0]
                rest = n[-1 - at[at < 0]]
                size = len(at) + 1
                seen = float(log_n[inside].sum() + np.log10(rest[rest > 0] + 0.5).sum()) + end
                lost = int((rest == 0).sum())
                emitted = seen - float(log_under[path[1:][path[1:] >= 0]].sum())
                out.append((size, size - lost - (not seen_end), train_tokens, seen + lost * math.log10(0.5) - size * base, emitted + over.path(path)))
            kinds = [pa.int64()] * 3 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return resolved.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
