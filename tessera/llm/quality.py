"""Quality rules: word and line statistics, and bands of n-gram perplexity per language.

The language model of each language is a modified Kneser-Ney model of order 4 over the
UTF-16 units of the text as it is, so that every letter of every script counts for itself
(a symbol beyond the basic plane is two units). Spark counts the 4-grams of all
documents; those of the reference texts of a language train its model: texts that pass
the base rules and whose share of symbols lies in no higher step than that of the
language's median (``STEPS`` per power of two; no symbols at all is a step of its own). The
table of 4-grams covers all documents, so each has its interpolated probability there,
with a count of zero or more, and no text needs anything that the table lacks.

Levels, discounts and weights are joins and sums by language and history in Spark. The
result is stored as sorted hash arrays: hashes of 4-grams by language, with log
probabilities beside them. Arrays of the ``HEAD`` most frequent 4-grams go to every task;
where there are more, texts look up the others in the table by an exact join.

A language's lower and upper band lie around the median log perplexity of all its different
texts that pass the base rules; copies count once. A short text strays further from it than
a long one, as the mean of n terms does, so the bands are FLOOR + SPREAD * m / sqrt(n) away
for a text of n units. m is the median of |log perplexity - median| * sqrt(n), but at least
LEAST_STRAY times the median deviation of single terms within a text: near copies that make
up most of a language would else draw the bands together around themselves.

Defined cases: null text has no words and fails the base rules; a null language is a
language of its own, apart from the empty string; a very long text is read in pieces of
``CHUNK`` units; repeated rows come back as often as they went in; a language without a text
that passes the base rules has no bands, and nothing of it is kept; other columns are not
read, and ``keep_good`` names its helpers so that they meet no column of the input; an
empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import discard, fresh, join_checked, stage

ORDER = 4
UNIT = 16
FLOOR = 0.02
SPREAD = 8.0
LEAST_STRAY = 0.4
MIN_WORDS = 10
WINDOW = 5
#: Steps of the share of symbols for each power of two, and the step of texts that fail the base rules.
STEPS = 2
NEVER = 1 << 20
#: 4-grams whose probabilities every task holds, in 12 bytes each; the others are joined.
HEAD = 1 << 21
COUNT_STEPS = 64
#: Units whose n-grams are taken at once, and distinct n-grams that a task gathers before it sends them on.
CHUNK = 1 << 20
FLUSH = 1 << 21

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def grams(text: str | None) -> Iterator[np.ndarray]:
    """The 4-grams of a text as unsigned 64-bit numbers, zero units before it; in pieces of ``CHUNK``."""
    units = np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), "<u2")
    tail = np.zeros(ORDER - 1, np.uint64)
    for i in range(0, len(units), CHUNK):
        c = np.concatenate([tail, units[i : i + CHUNK].astype(np.uint64)])
        tail = c[-(ORDER - 1) :]
        yield (c[:-3] << np.uint64(48)) | (c[1:-2] << np.uint64(32)) | (c[2:-1] << np.uint64(16)) | c[3:]


def statistics(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    b = text or b""
    words = b.split()
    data = np.frombuffer(b, np.uint8)
    points = len(b) - int(np.count_nonzero((data & 0xC0) == 0x80))
    spaces = len(b) - len(b.translate(None, _SPACE))
    symbols = len(b) - len(b.translate(None, _SYMBOLS))
    dup = 0
    if b"\n" in b:
        lines = [x for x in b.split(b"\n") if x.strip()]
        dup = len(lines) - len(set(lines))
    return len(words), points - spaces, symbols, dup, repeated(words)


def repeated(words: list[bytes]) -> int:
    """How many words lie in a 5-word window that the list holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    put = number.setdefault
    ids = np.array([put(w, len(number)) for w in words], np.int64)
    bits = max(1, int(len(number) - 1).bit_length())
    if bits * WINDOW > 63:  # pairs first, numbered anew, so that five fit
        pair = np.unique((ids[:-1] << bits) | ids[1:], return_inverse=True)[1]
        wide = max(1, int(pair.max()).bit_length())
        code = np.unique((pair[:-2] << wide) | pair[2:], return_inverse=True)[1]
        code = (code[:n].astype(np.int64) << bits) | ids[WINDOW - 1 :]
    else:
        code = np.zeros(n, np.int64)
        for i in range(WINDOW):
            code = (code << bits) | ids[i : i + n]
    order = np.sort(code)
    again = order[1:] == order[:-1]
    if not again.any():
        return 0
    hit = np.isin(code, order[1:][again])
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i : i + n] |= hit
    return int(covered.sum())


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _base_fails(stats: tuple[int, int, int, int, int]) -> bool:
    return stats[0] < MIN_WORDS or 100 * stats[4] > 20 * stats[0]


def symbol_step(stats: tuple[int, int, int, int, int]) -> int:
    """The step of a text's share of symbols: 0 for none, NEVER if the base rules reject it."""
    if _base_fails(stats):
        return NEVER
    return 1 + int(STEPS * max(0.0, 20 + np.log2(stats[2] / stats[1]))) if stats[2] else 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows lang, step, gram, n; a row without a gram counts texts."""
    seen: dict[tuple[str | None, int], list[np.ndarray]] = {}
    texts: dict[tuple[str | None, int], int] = {}
    held = 0

    def merged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([p[0] for p in parts])
        order = np.argsort(codes, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))
        return codes[order][first], np.add.reduceat(np.concatenate([p[1] for p in parts])[order], first)

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, step), parts in seen.items():
            code, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(np.full(len(code), step), pa.int32()), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "step", "gram", "n"])
        keys = list(texts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([None] * len(keys), pa.int64()), pa.array([texts[k] for k in keys], pa.int64())], ["lang", "step", "gram", "n"])
        seen.clear()
        texts.clear()

    def add(key: tuple[str | None, int], codes: list[np.ndarray]) -> int:
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        seen.setdefault(key, []).append((code, n.astype(np.int64)))
        return len(code)

    pending: dict[tuple[str | None, int], list[np.ndarray]] = {}
    waiting = 0
    for batch in batches:
        for lang, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = t.as_py()
            key = (lang, symbol_step(statistics((text or "").encode("utf-8", "surrogatepass"))))
            texts[key] = texts.get(key, 0) + 1
            for g in grams(text):
                pending.setdefault(key, []).append(g)
                waiting += len(g)
            if waiting >= CHUNK:
                held += sum(add(k, parts) for k, parts in pending.items())
                pending, waiting = {}, 0
                if held > FLUSH:  # together first, for chunks share most of their n-grams
                    for k in seen:
                        seen[k] = [merged(seen[k])]
                    held = sum(len(p[0][0]) for p in seen.values())
                    if held > FLUSH // 2:
                        yield from send()
                        held = 0
    for k, parts in pending.items():
        add(k, parts)
    yield from send()


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, step, gram, n: the 4-grams of all documents; each task sends sums only."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_count, "lang string, step int, gram long, n long")
    return rows.groupBy(_key("lang").alias("lang"), "step", "gram").agg(F.sum("n").alias("n"))


def _key(lang: str) -> Column:
    """A language as a key that tells null from every string."""
    return F.when(F.col(lang).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(lang)))


def _suffix(k: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << (UNIT * k)) - 1))


def kneser_ney(counted: DataFrame) -> DataFrame:
    """lang, gram, n_all, logp of each 4-gram from ``count_grams``, by a modified Kneser-Ney model of each language.

    Level k has the k-grams that end some 4-gram; its counts are, below the highest, of
    different units before them. Each level interpolates the one below; under the lowest all
    units of the language, and one more, are alike.
    """
    texts = counted.filter(F.col("gram").isNull() & (F.col("step") < NEVER))
    below = Window.partitionBy("lang").orderBy("step")  # a row for each language and step
    half = texts.withColumn("upto", F.sum("n").over(below)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    limit = half.filter(2 * F.col("upto") >= F.col("all")).groupBy("lang").agg(F.min("step").alias("limit"))
    train = F.coalesce(F.when(F.col("step") <= F.col("limit"), F.col("n")), F.lit(0))
    table = join_checked(counted.filter("gram is not null"), stage(limit), "lang", "left").groupBy("lang", "gram").agg(F.sum("n").alias("n_all"), F.sum(train).alias("n"))
    levels = {ORDER: stage(table)}
    for k in range(ORDER - 1, 0, -1):
        more = F.count(F.when(F.col("n") > 0, True)).alias("n")
        levels[k] = stage(levels[k + 1].groupBy("lang", _suffix(k).alias("gram")).agg(more))
    of_lang = stage(reduce(DataFrame.union, [_discounts(level).withColumn("level", F.lit(k)) for k, level in levels.items()]))
    prob = stage(levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p"))).withColumn("gram", F.lit(0).cast("long"))
    for k in range(1, ORDER + 1):
        less = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        cut = levels[k].join(of_lang.filter(F.col("level") == k), "lang").withColumn("d", less).withColumn("history", F.shiftrightunsigned("gram", UNIT))
        cut = cut.select("lang", "gram", "n", "d", "history", (_suffix(k - 1) if k > 1 else F.lit(0).cast("long")).alias("end"), *(["n_all"] if k == ORDER else []))
        history = cut.groupBy("lang", "history").agg(F.sum("n").alias("total"), F.sum("d").alias("freed"))
        lower = prob.select("lang", F.col("gram").alias("end"), F.col("p").alias("lower"))
        met = cut.join(history, ["lang", "history"]).join(lower, ["lang", "end"])
        own = F.when(F.col("total") > 0, (F.col("n") - F.col("d")) / F.col("total")).otherwise(0.0)
        weight = F.when(F.col("total") > 0, F.col("freed") / F.col("total")).otherwise(1.0)
        prob = stage(met.select("lang", "gram", *(["n_all"] if k == ORDER else []), (own + weight * F.col("lower")).alias("p")))
    discard(of_lang, *levels.values())
    return prob.select("lang", "gram", "n_all", F.log("p").alias("logp"))


def _discounts(level: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: what counts of 1, 2 and 3 or more give up, from how many n-grams have counts 1 to 4."""
    n = [F.greatest(F.count(F.when(F.col("n") == i, True)), F.lit(1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05 * i)), F.lit(0.95 * i)).alias(f"d{i}") for i in (1, 2, 3)]
    return level.groupBy("lang").agg(*n).select("lang", *d)


def hashes(code: np.ndarray) -> np.ndarray:
    """64-bit hashes of 4-grams; a bijection, so that none collide."""
    return (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


class Scores:
    """Sorted hash arrays of one language: hashes, and log probabilities beside them."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray):
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length() + 2))
        self.keys, self.logp = np.append(keys, np.uint64(0)), np.append(logp, np.float32(0))  # a place past the end
        starts = (keys >> self.shift).astype(np.int64)
        self.first = np.searchsorted(starts, np.arange(1 << (64 - int(self.shift)))).astype(np.int32)
        self.most = int(np.bincount(starts).max()) if len(keys) else 0

    @classmethod
    def of(cls, code: np.ndarray, logp: np.ndarray) -> Scores:
        keys = hashes(code)
        order = np.argsort(keys)
        return cls(keys[order], logp[order].astype(np.float32))

    def look_up(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities (zero where they are not here), and whether they are here."""
        h = hashes(code)
        at = self.first[h >> self.shift]
        here = (self.keys[at] == h) & (at < len(self.keys) - 1)
        out = np.where(here, self.logp[at], np.float32(0))
        todo = np.flatnonzero(~here)
        for ahead in range(1, self.most):  # all that share the leading bits stand together
            place = np.minimum(at[todo] + ahead, len(self.keys) - 1)
            hit = (self.keys[place] == h[todo]) & (place < len(self.keys) - 1)
            out[todo[hit]] = self.logp[place[hit]]
            here[todo[hit]] = True
            todo = todo[~hit]
            if not len(todo):
                break
        return out, here


def arrays(model: DataFrame, head: int | None = None) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], DataFrame | None]:
    """Keys and log probabilities by language of at most ``head`` of the most frequent 4-grams, and the table of the others if there are any."""
    head = HEAD if head is None else head
    step = F.floor(F.log2("n_all") * COUNT_STEPS)
    have = model.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect()  # at most 64 * COUNT_STEPS rows
    least, total = None, 0
    for r in sorted(have, reverse=True):
        total += r.k
        if total > head:
            break
        least = r.step
    inside = step >= least if least is not None else F.lit(False)
    got = model.filter(inside).select("lang", "gram", F.col("logp").cast("float")).toArrow()
    lang, code, logp = got["lang"].to_numpy(), got["gram"].to_numpy().view(np.uint64), got["logp"].to_numpy()
    out = {}
    for name in np.unique(lang.astype(str)).tolist():
        one = Scores.of(code[lang == name], logp[lang == name])
        out[name] = (one.keys[:-1], one.logp[:-1])
    return out, model.filter(~inside) if total > head else None


def measure(docs: DataFrame, known: dict[str, tuple[np.ndarray, np.ndarray]], out: str, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct ``out``: key, th, lang (as a key), the statistics, n_units, the sums of the log
    probabilities that ``known`` has and of their squares, and the 4-grams that it lacks. To be staged, for keys are random.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)
    columns = docs.columns if keep is None else keep
    text_at, lang_at, hash_at = (fresh(docs, x) for x in ("text", "lang", "hash"))
    longs = dict.fromkeys(_STATS, pa.int64())
    kinds = {"key": pa.string(), "th": pa.int64(), "lang": pa.string(), **longs, "n_units": pa.int64(), "total": pa.float64(), "squares": pa.float64(), "rest": pa.list_(pa.struct([("gram", pa.int64()), ("k", pa.int64())]))}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: Scores(*v) for k, v in shared.value.items()}
        none = Scores(np.empty(0, np.uint64), np.empty(0, np.float32))
        task, number = uuid.uuid4().hex, 0
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            found = []
            for text, lang, th in zip(column[text_at], column[lang_at].to_pylist(), column[hash_at].to_pylist()):
                t = text.as_py() or ""
                table, total, squares, size, rest = tables.get(lang, none), 0.0, 0.0, 0, []
                for g in grams(t):
                    p, here = table.look_up(g)
                    size, total, squares = size + len(g), total + float(p.sum(dtype=float)), squares + float(np.square(p, dtype=float).sum())
                    if not here.all():
                        code, n = np.unique(g[~here], return_counts=True)
                        rest += [{"gram": c, "k": k} for c, k in zip(code.view(np.int64).tolist(), n.tolist())]
                number += 1
                found.append((f"{task}{number}", th, lang, *statistics(t.encode("utf-8", "surrogatepass")), size, total, squares, rest))
            made = pa.StructArray.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds.values())], list(kinds))
            yield pa.RecordBatch.from_arrays([*(column[c] for c in columns), made], [*columns, out])

    source = docs.withColumns({text_at: F.col(text_col).cast("string"), lang_at: _key(lang_col), hash_at: F.xxhash64(text_col)}).select(*columns, text_at, lang_at, hash_at)
    made = ",".join(f"{c}:bigint" for c in [*_STATS, "n_units"])
    kind = f"struct<key:string,th:bigint,lang:string,{made},total:double,squares:double,rest:array<struct<gram:bigint,k:bigint>>>"
    return source.mapInArrow(rows, StructType([*(docs.schema[c] for c in columns), StructField(out, StructType.fromDDL(f"x {kind}")[0].dataType)]))


def with_rest(measured: DataFrame, out: str, rest: DataFrame) -> DataFrame:
    """``measured`` with the sums of ``out`` made whole by an exact join with the 4-grams that its tasks did not hold."""
    asked = measured.select(F.col(f"{out}.key").alias("key"), F.col(f"{out}.lang").alias("lang"), F.explode(f"{out}.rest").alias("x")).select("key", "lang", "x.gram", "x.k")
    found = join_checked(asked, rest.select("lang", "gram", "logp"), ["lang", "gram"])
    key, total, squares = (fresh(measured, x) for x in ("key", "total", "squares"))
    sums = found.groupBy(F.col("key").alias(key)).agg(F.sum(F.col("k") * F.col("logp")).alias(total), F.sum(F.col("k") * F.col("logp") * F.col("logp")).alias(squares))
    met = join_checked(measured.withColumn(key, F.col(f"{out}.key")), stage(sums), key, "left")
    whole = F.col(out).withField("total", F.col(f"{out}.total") + F.coalesce(total, F.lit(0.0))).withField("squares", F.col(f"{out}.squares") + F.coalesce(squares, F.lit(0.0)))
    return met.withColumn(out, whole).drop(key, total, squares)


def _failed(out: str) -> Column:
    return (F.col(f"{out}.n_words") < MIN_WORDS) | (100 * F.col(f"{out}.n_repeat_words") > 20 * F.col(f"{out}.n_words"))


def _log_ppl(out: str) -> Column:
    return F.when(F.col(f"{out}.n_units") > 0, -F.col(f"{out}.total") / F.col(f"{out}.n_units"))


def bands(measured: DataFrame, out: str) -> DataFrame:
    """lang, mid, stray: each language's median log perplexity, and m (see above)."""
    mean = _log_ppl(out)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col(f"{out}.squares") / F.col(f"{out}.n_units") - mean * mean))
    passing = measured.filter(~_failed(out)).select(f"{out}.lang", f"{out}.th", f"{out}.n_units", mean.alias("log_ppl"), sd.alias("term_sd"))
    each = stage(passing.groupBy("lang", "th").agg(*[F.min(c).alias(c) for c in ("log_ppl", "n_units", "term_sd")]))
    middle = stage(each.groupBy("lang").agg(F.percentile_approx("log_ppl", 0.5, 1000).alias("mid"), F.percentile_approx("term_sd", 0.5, 1000).alias("sd")))
    away = join_checked(each, middle, "lang").withColumn("off", F.abs(F.col("log_ppl") - F.col("mid")) * F.sqrt("n_units"))
    stray = F.greatest(F.percentile_approx("off", 0.5, 1000), F.first("sd") * LEAST_STRAY)
    limits = stage(away.groupBy("lang").agg(F.first("mid").alias("mid"), stray.alias("stray")))
    discard(each, middle)
    return limits


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, spread: float = SPREAD, floor: float = FLOOR) -> tuple[DataFrame, str]:
    """Columns ``keep`` of ``docs`` (all, if not given) with a struct whose name comes second: statistics, base_failed, log_ppl, low, high, kept."""
    counted = stage(count_grams(docs, text_col, lang_col))
    model = kneser_ney(counted)
    known, rest = arrays(model)
    out = fresh(docs, "quality")
    measured = stage(measure(docs, known, out, text_col, lang_col, keep))
    if rest is not None:
        measured = stage(with_rest(measured, out, rest))
    discard(counted, model)
    limits = bands(measured, out)
    lang, mid, stray = (fresh(measured, x) for x in ("lang", "mid", "stray"))
    limits = limits.toDF(lang, mid, stray)
    met = join_checked(measured.withColumn(lang, F.col(f"{out}.lang")), limits, lang, "left")
    away = floor + spread * F.col(stray) / F.sqrt(F.greatest(f"{out}.n_units", F.lit(1)))
    low, high, failed = F.col(mid) - away, F.col(mid) + away, _failed(out)
    kept = F.coalesce(~failed & _log_ppl(out).between(low, high), F.lit(False))
    fields = [F.col(f"{out}.{c}").alias(c) for c in _STATS] + [failed.alias("base_failed"), kept.alias("kept"), _log_ppl(out).alias("log_ppl"), low.alias("low"), high.alias("high")]
    return met.withColumn(out, F.struct(*fields)).drop(lang, mid, stray), out


def digest(judged: DataFrame, out: str) -> DataFrame:
    return judged.select(F.col("doc_id").cast("long").alias("doc_id"), *[f"{out}.{c}" for c in (*_STATS, "base_failed", "kept", "log_ppl", "low", "high")])


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is kept."""
    judged, out = judge(docs)
    return judged.filter(F.col(f"{out}.kept")).select(*docs.columns)
