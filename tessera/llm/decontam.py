"""Documents that hold benchmark items: MinHash containment search by size, then exact.

Only DataFrame functions are used. Words are runs of letters and digits in lower case; a
shingle is five words. The sketch of an item is a one-permutation MinHash: the hashes of its
shingles fall into ``BINS`` bins by their top bits and each bin keeps its least. Items are
partitioned by size: class S holds the items with over S / 2 and at most S shingles. In a
document an item of class S is looked for in windows of 2 S shingles, a new one every S, so
that whatever an item spans lies whole within some window, and a short item meets a window
of its own size however long the document is.

The share of an item's sketch among the shingles of a window estimates how much of the item
the window contains; a window with at least ``SHARE`` of the sketch makes a candidate. At a
containment of 0.8 a miss has a probability below 1e-9 for sketches of 30 hashes, below
1e-3 for 4 or 5, and items with fewer shingles than that must be there whole. Documents'
shingles meet the sketches where they are read, if those are counted as small; only those
that are in some sketch are gathered, by document, item and window. Candidates are verified
on the shingles' text: an item is found if at least 0.8 of its distinct shingles are in the
document.

Defined cases: null text has no words; texts and items of fewer than five words have no
shingles, so such an item is never found; repeated rows of documents give one result for
each different text under an id, repeated items count once for each id; a null item id is
kept; a very long text is one row with some 24 bytes a word; other columns are not read, so
none can clash; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_checked, stage

WORDS = 5
CONTAINMENT = 0.8
BINS = 64
SHIFT = 58
#: The least part of an item's sketch that a window must have.
SHARE = 0.3
#: Documents up to which the list of candidates is broadcast.
FEW = 100_000


def _words(text: str) -> str:
    return rf"filter(split(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), x -> x <> '')"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is then taken once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _hashes(df: DataFrame) -> DataFrame:
    """Column text becomes h, the hashes of its shingles in order."""
    each = ", ".join(f"w[i + {k}]" for k in range(WORDS))
    some = f"transform(sequence(0, size(w) - {WORDS}), i -> xxhash64({each}))"
    hashed = f"transform({_words('text')}, x -> xxhash64(x))"
    return df.withColumn("h", F.expr(_let("w", hashed, f"if(size(w) >= {WORDS}, {some}, cast(array() as array<bigint>))"))).drop("text")


def _least(a: str) -> str:
    """The least of each bin of a sorted array of hashes."""
    return f"filter({a}, (x, i) -> i = 0 or shiftright(x, {SHIFT}) <> shiftright({a}[i - 1], {SHIFT}))"


def item_sketches(items: DataFrame) -> DataFrame:
    """item_id, size_class, needed (how many hashes make a candidate) and least (a bin's least hash), a row for each bin."""
    hashed = _hashes(items.select("item_id", "text")).filter("size(h) > 0").withColumn("h", F.expr("array_distinct(h)"))
    sized = hashed.withColumn("size_class", F.expr("cast(pow(2, ceil(log2(size(h)))) as int)")).withColumn("sketch", F.expr(_let("a", "sort_array(h)", _least("a"))))
    needed = F.greatest(F.lit(1), F.ceil(F.size("sketch") * SHARE)).cast("int")
    return sized.select("item_id", "size_class", needed.alias("needed"), F.explode("sketch").alias("least")).distinct()


def candidates(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """doc_id, th, item_id: pairs of which some window has enough of the item's sketch. ``sketches`` should be staged."""
    rows = _hashes(docs.select("doc_id", "th", "text")).select("doc_id", "th", F.posexplode("h").alias("at", "least"))
    met = join_checked(rows, sketches, "least")
    first = F.floor(F.col("at") / F.col("size_class"))
    window = F.explode(F.array(first, first - 1)).alias("window")
    seen = met.select("doc_id", "th", "item_id", "size_class", "needed", "least", window)
    each = seen.groupBy("doc_id", "th", "item_id", "size_class", "needed", "window").agg(F.countDistinct("least").alias("n"))
    return each.filter("n >= needed").select("doc_id", "th", "item_id").distinct()


def search(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """doc_id, th (the text's hash), item_id, n_item, n_shared, containment of each item found."""
    keyed = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    known = items.select("item_id", "text")
    sketches = stage(item_sketches(known))
    pairs = stage(candidates(keyed, sketches))
    wanted = pairs.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    wanted = stage(wanted)
    same = [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("th") == F.col("_th")]
    texts = join_checked(keyed, wanted, same, "left_semi", FEW).dropDuplicates(["doc_id", "th"])
    texts = texts.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), _shingles().alias("have"))
    kept = known.select(F.col("item_id").alias("_item"), F.array_distinct(_shingles()).alias("want"))
    met = pairs.join(texts, same).join(kept, F.col("item_id").eqNullSafe(F.col("_item")))
    n = F.size("want")
    shared = F.size(F.array_intersect("want", "have"))
    out = met.select("doc_id", "th", "item_id", n.cast("long").alias("n_item"), shared.cast("long").alias("n_shared"))
    out = out.filter((F.col("n_item") > 0) & (F.col("n_shared") >= threshold * F.col("n_item")))
    return out.groupBy("doc_id", "th", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_item", "n_shared")).alias("x")).select(
        "doc_id", "th", "item_id", "x.n_item", "x.n_shared", F.round("x.c", 6).alias("containment")
    )


def _shingles():
    w = _words("text")
    some = f"transform(sequence(0, size(w) - {WORDS}), i -> array_join(slice(w, i + 1, {WORDS}), ' '))"
    return F.expr(_let("w", w, f"if(size(w) >= {WORDS}, {some}, cast(array() as array<string>))"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item. Helper columns meet no name of ``docs``."""
    doc, of_text, th = (fresh(docs, x) for x in ("doc", "of_text", "text_hash"))
    bad = stage(search(docs, items).select(F.col("doc_id").alias(doc), F.col("th").alias(of_text)).distinct())
    on = [F.col("doc_id").eqNullSafe(F.col(doc)), F.col(th) == F.col(of_text)]
    return join_checked(docs.withColumn(th, F.xxhash64("text")), bad, on, "left_anti", FEW).select(*docs.columns)


ORACLE = r"""
with w as (select doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
i as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
di as (select distinct item_id, array_to_string(w[k:k+4], ' ') as s from (select item_id, w, unnest(range(1, greatest(len(w) - 3, 1))) as k from i)),
ds as (select distinct doc_id, text, array_to_string(w[k:k+4], ' ') as s from (select doc_id, text, w, unnest(range(1, greatest(len(w) - 3, 1))) as k from w)),
n as (select item_id, count(*) as n_item from di group by 1),
m as (select doc_id, text, item_id, count(*) as n_shared from ds join di using (s) group by 1, 2, 3)
select distinct doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) as containment
from m join n using (item_id) where n_shared >= 0.8 * n_item
"""
