"""Checksums, component scans and comparisons of byte relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADLER = 65_521
ALL_ONES = 0xFFFFFFFF


def adler_of(low: Column, high: Column) -> Column:
    """The two sums as one number; 0 is stored as all ones."""
    both = high * 65_536 + low
    return F.when(both == 0, ALL_ONES).otherwise(both).cast("long")


def adler32(seq: DataFrame) -> DataFrame:
    """img and adler of sequences (img, i, v), by its closed form and so in one aggregation.

    The sums begin at 0, not 1: s1 = sum v and s2 = sum (n - i) v, both modulo 65521. For
    places 0 to n - 1 the latter is n sum v - sum i v; terms are reduced before they are
    summed, so that no sum overflows.
    """
    v, i = F.col("v").cast("long"), F.col("i") % ADLER
    sums = seq.groupBy("img").agg(F.sum(v).alias("s"), F.sum(i * v % ADLER).alias("iv"), F.count("*").alias("n"))
    low = F.col("s") % ADLER
    high = F.pmod((F.col("n") % ADLER) * low - F.col("iv"), F.lit(ADLER))
    return sums.select("img", adler_of(low, high).alias("adler"))


def components(pixels: DataFrame) -> DataFrame:
    """img and n: 4 if some pixel isn't opaque, else 1 if all are gray, else 3."""
    clear = F.max(F.when(F.col("a") != 255, 1).otherwise(0))
    coloured = F.max(F.when((F.col("r") != F.col("g")) | (F.col("g") != F.col("b")), 1).otherwise(0))
    n = F.when(F.col("clear") == 1, 4).when(F.col("coloured") == 1, 3).otherwise(1)
    return pixels.groupBy("img").agg(clear.alias("clear"), coloured.alias("coloured")).select("img", n.alias("n"))


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Places where two relations differ, or that only one has: left_v and right_v."""
    a, b = left.select(*keys, F.col("v").alias("left_v")), right.select(*keys, F.col("v").alias("right_v"))
    return a.join(b, keys, "full").filter(~F.col("left_v").eqNullSafe(F.col("right_v")))


def first_differences(left: DataFrame, right: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    return differences(left, right, keys).orderBy(*keys).limit(n)
