"""Deltas and running sums over sequences (img, i, v).

``i`` is the order. ``width`` is the number of bits after which values wrap; None: never.
A sequence is cut into pieces of ``PIECE`` places, so a long one is never sorted in one
task: windows run within (img, piece), and what comes before a piece is carried by a table
with a row for each piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import byte_unzigzag, byte_zigzag

PIECE = 65_536


def _inside():
    return Window.partitionBy("img", "_piece").orderBy("i")


def _pieces():
    return Window.partitionBy("img").orderBy("_piece")


def _cut(seq: DataFrame) -> DataFrame:
    return seq.withColumn("_piece", F.floor(F.col("i") / PIECE))


def numbered(rows: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """``rows`` with their place from 0 among those of a key, in the order of whole numbers that differ within it.

    A piece takes ``PIECE`` consecutive numbers, so it has no more rows.
    """
    cut = rows.withColumn("_piece", F.floor(F.col(order) / PIECE))
    counted = cut.groupBy(key, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = counted.select(key, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = F.row_number().over(Window.partitionBy(key, "_piece").orderBy(order))
    return cut.join(carried, [key, "_piece"]).withColumn(out, F.col("_from") + inside - 1).drop("_piece", "_from")


def carried_sum(rows: DataFrame, value: str, keys: list[str], out: str, numbers: int) -> DataFrame:
    """``rows`` with the sum of a value over the rows before, by img in the order of ``keys``.

    A piece takes ``numbers`` consecutive values of the first key, a whole number.
    """
    cut = rows.withColumn("_piece", F.floor(F.col(keys[0]) / numbers))
    totals = cut.groupBy("img", "_piece").agg(F.sum(value).alias("_t"))
    carried = totals.select("img", "_piece", F.coalesce(F.sum("_t").over(_pieces().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("img", "_piece").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    met = cut.join(carried, ["img", "_piece"])
    return met.withColumn(out, (F.col("_from") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop("_piece", "_from")


def running(seq: DataFrame, value: Column, out: str) -> DataFrame:
    """``seq`` with the sum of ``value`` up to and with each place."""
    cut = _cut(seq).withColumn("_v", value)
    totals = cut.groupBy("img", "_piece").agg(F.sum("_v").alias("_t"))
    carried = totals.select("img", "_piece", F.coalesce(F.sum("_t").over(_pieces().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    met = cut.join(carried, ["img", "_piece"])
    return met.withColumn(out, F.col("_from") + F.sum("_v").over(_inside().rowsBetween(Window.unboundedPreceding, 0))).drop("_piece", "_v", "_from")


def previous(seq: DataFrame, out: str, first: int = 0) -> DataFrame:
    """``seq`` with the value one place before; ``first`` where there is none."""
    cut = _cut(seq)
    ends = cut.groupBy("img", "_piece").agg(F.max_by("v", "i").alias("_last"))
    carried = ends.select("img", "_piece", F.lag("_last").over(_pieces()).alias("_from"))
    met = cut.join(carried, ["img", "_piece"])
    return met.withColumn(out, F.coalesce(F.lag("v").over(_inside()), "_from", F.lit(first))).drop("_piece", "_from")


def _wrap(c: Column, width: int | None) -> Column:
    return c if width is None else F.pmod(c, F.lit(1 << width).cast("long"))


def delta(seq: DataFrame, width: int | None = 8) -> DataFrame:
    """The first value, then differences."""
    return previous(seq, "_p").select("img", "i", _wrap(F.col("v") - F.col("_p"), width).alias("d"))


def undelta(deltas: DataFrame, width: int | None = 8) -> DataFrame:
    return running(deltas, F.col("d"), "_s").select("img", "i", _wrap(F.col("_s"), width).alias("v"))


def rising_delta(seq: DataFrame, minus_one: bool = False) -> DataFrame:
    """Differences of values that rise; with ``minus_one`` each but the first is one less.

    Values that don't rise (strictly, with ``minus_one``) raise an error when the rows are read.
    """
    step = F.col("v") - F.col("_p")
    step = F.when(F.col("i") > 0, step - 1).otherwise(step) if minus_one else step
    checked = F.when((F.col("i") > 0) & (step < 0), F.raise_error(F.lit("values do not rise")).cast("long")).otherwise(step)
    return previous(seq, "_p").select("img", "i", checked.cast("long").alias("d"))


def rising_undelta(deltas: DataFrame, minus_one: bool = False) -> DataFrame:
    step = F.when(F.col("i") > 0, F.col("d") + 1).otherwise(F.col("d")) if minus_one else F.col("d")
    return running(deltas, step, "_s").select("img", "i", F.col("_s").alias("v"))


def signed_delta(seq: DataFrame) -> DataFrame:
    """Byte deltas with folded signs, the first value too."""
    return delta(seq).select("img", "i", byte_zigzag("d").alias("d"))


def signed_undelta(deltas: DataFrame) -> DataFrame:
    return undelta(deltas.select("img", "i", byte_unzigzag("d").alias("d")))


def inclusive(seq: DataFrame, width: int | None = 8) -> DataFrame:
    return running(seq, F.col("v"), "_s").select("img", "i", _wrap(F.col("_s"), width).alias("sum"))


def exclusive(seq: DataFrame, width: int | None = 8) -> DataFrame:
    return running(seq, F.col("v"), "_s").select("img", "i", _wrap(F.col("_s") - F.col("v"), width).alias("sum"))


def reduce_pairs(seq: DataFrame) -> DataFrame:
    """Sums of neighbours modulo 256: one level up a tree of sums."""
    half = seq.groupBy("img", F.floor(F.col("i") / 2).cast("long").alias("i"))
    return half.agg(_wrap(F.sum("v"), 8).alias("v"))


def downsweep(above: DataFrame, level: DataFrame) -> DataFrame:
    """One level down: the parent's sum, and the left neighbour's value at odd places."""
    own = previous(level, "_p").select("img", "i", F.when(F.col("i") % 2 == 1, F.col("_p")).otherwise(0).alias("left"))
    parent = above.select("img", F.col("i").alias("p"), F.col("v").alias("up"))
    met = own.withColumn("p", F.floor(F.col("i") / 2).cast("long")).join(parent, ["img", "p"])
    return met.select("img", "i", _wrap(F.col("up") + F.col("left"), 8).alias("v"))


def column_row_sum(plane: DataFrame, d: int = 32, zigzag: bool = True) -> DataFrame:
    """Blocks of deltas summed by two windows: first columns down, then rows across."""
    keyed = plane.select("*", F.floor(F.col("y") / d).alias("by"), F.floor(F.col("x") / d).alias("bx"))
    corner = (F.col("y") % d == 0) & (F.col("x") % d == 0)
    raw = keyed.withColumn("r", F.when(corner, F.col("v")).otherwise(byte_unzigzag("v")) if zigzag else F.col("v"))
    first = F.col("x") % d == 0
    down = Window.partitionBy("img", "by", "bx", first).orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    summed = raw.withColumn("base", F.when(first, F.sum(F.when(first, F.col("r"))).over(down)).otherwise(F.col("r")))
    across = Window.partitionBy("img", "by", "bx", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return summed.select("img", "y", "x", _wrap(F.sum("base").over(across), 8).alias("v"))
