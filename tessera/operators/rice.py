"""Adaptive Rice codes as plans: the best k, widths, offsets, and bits of a block.

Rows are blocks with ``syms``, an array of symbols. Bits are texts of 0 and 1, the highest
first; ``functions.serial.frame_words`` turns them into the stored words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import ESCAPE, col, let, num_bits, num_bits_plain, shifted_right
from .scans import carried_sum

KS = 8
GROUP = 4
#: Blocks of a part of a stored table of k, and block numbers or rows of big blocks that are summed in one piece.
PART = 65_536
PIECE = 2048


def cost(syms, k, width=num_bits) -> Column:
    """Bits of all symbols under one k."""
    add = lambda a, n: a + width(n, col(k)).cast("int")
    return F.aggregate(col(syms), F.lit(0), add)


def costs(syms) -> Column:
    """Bits of all symbols under each k from 0 to 7, in one pass over the symbols."""
    zero = F.array_repeat(F.lit(0), KS)
    add = lambda a, n: F.array(*[F.get(a, F.lit(k)) + num_bits(n, F.lit(k)).cast("int") for k in range(KS)])
    return F.aggregate(col(syms), zero, add)


def best_k(syms) -> Column:
    """The k that needs least bits; the smallest of those that tie."""
    return let(costs(syms), lambda c: (F.array_position(c, F.array_min(c)) - 1).cast("int"))


def escapes(syms, k) -> Column:
    """How many symbols are written as escapes."""
    return F.size(F.filter(col(syms), lambda n: shifted_right(n, k) >= ESCAPE))


def k_table(best: DataFrame, order: str = "blocki") -> DataFrame:
    """img, part and ks: the k of each block as bytes in order, in parts of ``PART``, then one zero byte in the last part.

    The parts in order are the table as stored; none is larger, whatever the plane's size.
    """
    ends = best.groupBy("img").agg((F.max(order) + 1).alias(order)).select("img", order, F.lit(0).cast("long").alias("k"))
    rows = best.select("img", F.col(order).cast("long").alias(order), F.col("k").cast("long").alias("k")).union(ends)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "k"))), lambda x: F.lpad(F.hex(x["k"]), 2, "0"))
    return rows.groupBy("img", F.floor(F.col(order) / PART).alias("part")).agg(F.unhex(F.array_join(listed, "")).alias("ks"))


def _low_bits(n: Column, width: Column) -> Column:
    return F.when(width > 0, F.right(F.lpad(F.bin(n.cast("long")), 8, "0"), width)).otherwise("")


def prefix(n: Column, k: Column) -> Column:
    """q zeros and a one."""
    return F.concat(F.repeat(F.lit("0"), shifted_right(n, k).cast("int")), F.lit("1"))


def suffix(n: Column, k: Column) -> Column:
    return _low_bits(n, k)


def _escaped(n: Column, k: Column) -> Column:
    return shifted_right(n, k) >= ESCAPE


_ZEROS = "0" * ESCAPE


def over(n: Column, k: Column) -> Column:
    """What the prefix part of an escaped symbol holds besides its zeros: the top 8 - k bits."""
    return F.left(F.lpad(F.bin(n.cast("long")), 8, "0"), F.lit(8) - k)


def grouped_prefix(n: Column, k: Column) -> Column:
    return F.when(_escaped(n, k), F.concat(F.lit(_ZEROS), over(n, k))).otherwise(prefix(n, k))


def symbol_bits(n: Column, k: Column) -> Column:
    """One symbol, prefix and suffix together; an escape is 16 zeros and the byte."""
    return F.when(_escaped(n, k), F.concat(F.lit(_ZEROS), _low_bits(n, F.lit(8)))).otherwise(F.concat(prefix(n, k), suffix(n, k)))


def grouped_bits(syms, k) -> Column:
    """Bits of a block by fours: four prefix parts, then four suffixes of one width."""
    k = col(k)

    def group(s: Column) -> Column:
        return F.concat(F.transform(s, lambda n: grouped_prefix(n, k)), F.transform(s, lambda n: suffix(n, k)))

    starts = F.sequence(F.lit(0), (F.size(col(syms)) / GROUP - 1).cast("int"))
    parts = let(syms, lambda s: F.transform(starts, lambda g: F.array_join(group(F.slice(s, g * GROUP + 1, F.lit(GROUP))), "")))
    return F.when(F.size(col(syms)) > 0, F.array_join(parts, "")).otherwise("")


def interleaved_bits(syms, k) -> Column:
    """Bits of a block symbol by symbol."""
    k = col(k)
    return F.array_join(F.transform(col(syms), lambda n: symbol_bits(n, k)), "")


def plain_bits(syms, k) -> Column:
    """The code without escapes, prefix of ones: q ones, a zero, k bits."""
    k = col(k)
    one = lambda n: F.concat(F.repeat(F.lit("1"), shifted_right(n, k).cast("int")), F.lit("0"), suffix(n, k))
    return F.array_join(F.transform(col(syms), one), "")


def plain_cost(syms, k) -> Column:
    return cost(syms, k, num_bits_plain)


def split_prefix_bits(syms, k) -> Column:
    """The first of two streams: prefixes; an escape is 16 zeros alone."""
    k = col(k)
    return F.array_join(F.transform(col(syms), lambda n: F.when(_escaped(n, k), _ZEROS).otherwise(prefix(n, k))), "")


def split_suffix_bits(syms, k) -> Column:
    """The second of two streams: k bits of each symbol, or all 8 of an escaped one."""
    k = col(k)
    return F.array_join(F.transform(col(syms), lambda n: F.when(_escaped(n, k), _low_bits(n, F.lit(8))).otherwise(suffix(n, k))), "")


def prefix_counts(syms, k) -> Column:
    """Unary lengths 1 to 16; 17 stands for an escape."""
    k = col(k)
    return F.transform(col(syms), lambda n: F.least(shifted_right(n, k) + 1, F.lit(ESCAPE + 1)).cast("int"))


def remainders(syms, k) -> Column:
    """The value that each suffix holds."""
    k = col(k)
    rest = lambda n: F.when(_escaped(n, k), n).otherwise(n - shifted_right(n, k) * F.pow(F.lit(2), k).cast("int"))
    return F.transform(col(syms), rest)


def expand_runs(runs: DataFrame) -> DataFrame:
    """Runs (img, run, count, n) as blocks: img, blocki in the order of runs, and n, its symbols."""
    placed = carried_sum(runs, "count", ["run"], "_at", PIECE)
    blocks = placed.filter("count > 0").select("img", "n", "_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count").cast("long") - 1)).alias("_i"))
    return blocks.select("img", (F.col("_at") + F.col("_i")).alias("blocki"), "n")


def offsets_of(rows: DataFrame, width: str, keys: list[str], out: str = "bit_offset") -> DataFrame:
    """``rows`` with the sum of a width over the rows before, by img in the order of keys."""
    return carried_sum(rows, width, keys, out, PIECE)


def suffix_starts(best: DataFrame, d: int = 8) -> DataFrame:
    """Where each block's suffixes begin, if every symbol takes k bits."""
    return offsets_of(best.withColumn("_w", F.col("k") * (d * d)), "_w", ["blocki"], "suffix_start").drop("_w")


def lookup_table(spark) -> DataFrame:
    """key and packed: for each 6 bits, the lengths of up to four prefixes as nibbles, lowest first."""
    rows = spark.range(64).select(F.col("id").cast("int").alias("key"), F.lpad(F.bin("id"), 6, "0").alias("_rest"), F.lit(0).cast("int").alias("packed"))
    for i in range(4):
        at = F.instr("_rest", "1")
        rows = rows.select("key", F.when(at > 0, F.col("packed") + at * (1 << (4 * i))).otherwise(F.col("packed")).cast("int").alias("packed"),
                           F.when(at > 0, F.expr("substring(_rest, instr(_rest, '1') + 1)")).otherwise("").alias("_rest"))
    return rows.drop("_rest")
