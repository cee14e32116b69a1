"""Tiles: dense square pieces of a plane, one row each, and their reorderings.

A plane is (img, y, x, v). A tile is (img, by, bx, cells), with its cells in row order and 0
where the plane has none. One exchange on (img, by, bx) makes tiles; whatever follows
works within rows, so that deltas, reorderings, code lengths and bit streams of a block
need no further one. A tile holds D * D cells at most, whatever the plane's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import byte_unzigzag, byte_zigzag, col, let

BIG = 32
SMALL = 8
WIDTH = 32


def grid(seq: DataFrame, width: int = WIDTH) -> DataFrame:
    """A sequence (img, i, v) laid out in rows of a width."""
    return seq.select("img", F.floor(F.col("i") / width).cast("long").alias("y"), (F.col("i") % width).cast("long").alias("x"), "v")


def block_keys(plane: DataFrame, d: int) -> DataFrame:
    """by, bx and o (the offset within the block) beside each cell; no data moves."""
    o = (F.col("y") % d) * d + F.col("x") % d
    return plane.select("img", F.floor(F.col("y") / d).cast("long").alias("by"), F.floor(F.col("x") / d).cast("long").alias("bx"), o.cast("int").alias("o"), "v")


def tiles(plane: DataFrame, d: int = BIG, empty: int = 0) -> DataFrame:
    """img, by, bx, cells: what no cell covers holds ``empty``.

    A plane is a function of its places: a place given twice is an error when rows are read.
    """
    cells = F.map_from_entries(F.collect_list(F.struct("o", "v")))
    grouped = block_keys(plane, d).groupBy("img", "by", "bx").agg(cells.alias("m"))
    every = F.sequence(F.lit(0), F.lit(d * d - 1))
    return grouped.select("img", "by", "bx", let("m", lambda m: F.transform(every, lambda o: F.coalesce(F.try_element_at(m, o), F.lit(empty)))).alias("cells"))


def cells_of(tiled: DataFrame, d: int) -> DataFrame:
    """Tiles back to a plane."""
    rows = tiled.select("img", "by", "bx", F.posexplode("cells").alias("o", "v"))
    return rows.select("img", (F.col("by") * d + F.floor(F.col("o") / d)).cast("long").alias("y"), (F.col("bx") * d + F.col("o") % d).cast("long").alias("x"), "v")


def crop(plane: DataFrame, width, height) -> DataFrame:
    return plane.filter((F.col("x") < col(width)) & (F.col("y") < col(height)))


def unpacked(plane: DataFrame, width, height) -> DataFrame:
    """Packed pixels (img, y, x, word) as cells, four of a word from its lowest byte on, cropped."""
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.call_function("shiftright", F.col("word"), (j * 8).cast("int")).bitwiseAND(255).cast("int"))
    rows = plane.filter(F.col("x") * 4 < col(width)).select("*", F.posexplode(bytes_).alias("_j", "v"))
    return crop(rows.withColumn("x", (F.col("x") * 4 + F.col("_j")).cast("long")), width, height).select("img", "y", "x", "v")


def drop_missing(df: DataFrame, column: str = "v", missing: int = 0xFFFFFFFF) -> DataFrame:
    """Without the rows that hold the padding value."""
    return df.filter(F.col(column) != missing)


def spaced(plane: DataFrame, d: int = BIG, border: int = 2) -> DataFrame:
    """Each cell's place when blocks stand ``border`` cells apart."""
    return plane.select("img", (F.col("y") + border * F.floor(F.col("y") / d)).alias("y"), (F.col("x") + border * F.floor(F.col("x") / d)).alias("x"), "v")


def delta_block(cells, d: int) -> Column:
    """Deltas within a block, as zigzagged bytes: down the first column, then along rows.

    The corner is raw. Rows become independent once the first column is summed.
    """
    def step(c: Column, v: Column, i: Column) -> Column:
        before = F.when(i % d == 0, F.get(c, i - d)).otherwise(F.get(c, i - 1))
        return F.when(i == 0, v).otherwise(byte_zigzag(F.pmod(v - before, F.lit(256))))

    return let(cells, lambda c: F.transform(c, lambda v, i: step(c, v, i)))


def undelta_block(cells, d: int, zigzag: bool = True) -> Column:
    """Sums of a block of deltas modulo 256: down the first column, then along each row."""
    raw = F.transform(col(cells), lambda v, i: F.when(i == 0, v).otherwise(byte_unzigzag(v) if zigzag else v))

    def sums(a: Column, start: Column) -> Column:
        """Running sums of an array modulo 256, as the tail of an array that begins with start."""
        step = lambda acc, v: F.concat(acc, F.array(F.pmod(F.element_at(acc, -1) + v, F.lit(256))))
        return F.slice(F.aggregate(a, F.array(start), step), F.lit(2), F.size(a))

    def rows(c: Column) -> Column:
        column = sums(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda r: F.get(c, r * d)), F.lit(0))
        line = lambda s, r: F.concat(F.array(s), sums(F.slice(c, r * d + 2, F.lit(d - 1)), s))
        return F.flatten(F.transform(column, lambda s, r: line(s, r)))

    return let(raw, rows)


def small_blocks(cells, big: int = BIG, small: int = SMALL) -> Column:
    """A big block's cells as an array of small blocks in raster order."""
    n = big // small
    at = lambda s, o: (F.floor(s / n) * small + F.floor(o / small)) * big + (s % n) * small + o % small
    every = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    return let(cells, lambda c: F.transform(every(n * n), lambda s: F.transform(every(small * small), lambda o: F.get(c, at(s, o).cast("int")))))


def join_small(blocks, big: int = BIG, small: int = SMALL) -> Column:
    """Small blocks of a big block back to its cells."""
    n = big // small

    def cell(b: Column, i: Column) -> Column:
        y, x = F.floor(i / big), i % big
        s = F.floor(y / small) * n + F.floor(x / small)
        return F.get(F.get(b, s.cast("int")), ((y % small) * small + x % small).cast("int"))

    return let(blocks, lambda b: F.transform(F.sequence(F.lit(0), F.lit(big * big - 1)), lambda i: cell(b, i)))


def visit_order(width: int, height: int, small: int, group: int, spark) -> DataFrame:
    """iter, blocki: raster indices of small blocks, visited by groups of group x group.

    Groups follow in raster order, and blocks within each; groups at the edges that are not
    full have fewer members.
    """
    bw, bh = -(-width // small), -(-height // small)
    n = spark.range(bw * bh)
    x, y = F.col("id") % bw, F.floor(F.col("id") / bw)
    gx, gy = F.floor(x / group), F.floor(y / group)
    # how many blocks come in earlier rows of groups, in earlier groups of the row, then within
    full = F.least(F.lit(group), F.lit(bh) - gy * group)
    wide = F.least(F.lit(group), F.lit(bw) - gx * group)
    place = gy * group * bw + gx * group * full + (y % group) * wide + x % group
    return n.select(place.cast("long").alias("iter"), F.col("id").alias("blocki"))


def two_stage(plane: DataFrame) -> DataFrame:
    """img, by, bx, s, syms: deltas on 32 x 32 blocks, cut into 8 x 8 blocks without more."""
    deltas = tiles(plane).select("img", "by", "bx", small_blocks(delta_block("cells", BIG)).alias("blocks"))
    return deltas.select("img", "by", "bx", F.posexplode("blocks").alias("s", "syms"))


def halves(blocks: DataFrame) -> DataFrame:
    """Each block's two halves as rows, with the block's other columns."""
    rest = [c for c in blocks.columns if c != "syms"]
    size = F.floor(F.size("syms") / 2).cast("int")
    cut = F.array(F.slice("syms", F.lit(1), size), F.slice("syms", size + 1, size))
    return blocks.select(*rest, F.posexplode(cut).alias("half", "syms"))
