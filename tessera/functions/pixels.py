"""Coordinates, pixels and blocks as Column functions.

A pixel is a bigint 0xAARRGGBB, for values above 2**31 - 1 are legal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import col, shifted_right

#: Weights of the luma of red, green and blue (ITU-R BT.601), in thousandths.
LUMA = {"r": 299, "g": 587, "b": 114}

#: How a block may be divided, in the order of their codes; none has code 12.
SUBDIVISIONS = (
    "NONE", "TOPBOTTOM", "LEFTRIGHT", "4UP", "LEFTRIGHTHALF", "LEFTHALFRIGHT", "TOPBOTTOMHALF", "TOPHALFBOTTOM",
    "L1", "L2", "L3", "L4", "END", "CHECKERBOARD_BW_WB", "CHECKERBOARD_WB_BW",
)
PREFIX = "BLOCK_SUBDIVISION_TYPE_"


def offset_of(x, y, width) -> Column:
    return col(y) * col(width) + col(x)


def coords_of(offset, width) -> Column:
    """struct(x, y) of a raster offset."""
    o, w = col(offset), col(width)
    return F.struct((o % w).cast("long").alias("x"), F.floor(o / w).cast("long").alias("y"))


def relative_coords(root_x, root_y, width, offset) -> Column:
    """struct(x, y) of an offset inside a box that begins at a root."""
    at = coords_of(offset, width)
    return F.struct((col(root_x) + at["x"]).alias("x"), (col(root_y) + at["y"]).alias("y"))


def to_unit(v, most: int = 255) -> Column:
    """An integer 0..most as a fraction 0..1."""
    return col(v) / most


def from_unit(f, most: int = 255) -> Column:
    return F.floor(col(f) * most + 0.5).cast("long")


def cell_of(coordinate, size) -> Column:
    """Index of the cell whose centre has this coordinate in 0..1."""
    half = 0.5 / col(size)
    return F.floor((col(coordinate) - half) * col(size) + 0.5).cast("long")


def pack_bgra(b, g, r, a) -> Column:
    b, g, r, a = (col(c).cast("long") for c in (b, g, r, a))
    return a * (1 << 24) + r * (1 << 16) + g * (1 << 8) + b


def unpack_bgra(pixel) -> Column:
    p = col(pixel)
    part = lambda s: shifted_right(p, s).bitwiseAND(F.lit(255)).cast("int")
    return F.struct(part(0).alias("b"), part(8).alias("g"), part(16).alias("r"), part(24).alias("a"))


def gray_pixel(v) -> Column:
    """An opaque pixel whose three channels are v."""
    return col(v).cast("long") * 0x010101 + 0xFF000000


def luma(r, g, b) -> Column:
    """Gray value of a colour, rounded; weights are LUMA."""
    total = col(r) * LUMA["r"] + col(g) * LUMA["g"] + col(b) * LUMA["b"]
    return F.floor((total + 500) / 1000).cast("int")


def clear_alpha(pixel) -> Column:
    return col(pixel).bitwiseAND(F.lit(0x00FFFFFF).cast("long"))


def opaque(pixel) -> Column:
    return col(pixel).bitwiseOR(F.lit(0xFF000000).cast("long"))


def xy_pixel(x, y) -> Column:
    """Two 16-bit coordinates in one 32-bit pixel, y above x."""
    return col(y).cast("long") * (1 << 16) + col(x)


def subdivision_name(code) -> Column:
    """Name of a subdivision code; null where there is none."""
    c = col(code)
    names = F.array(*[F.lit(PREFIX + s) for s in SUBDIVISIONS])
    return F.when((c >= 0) & (c < len(SUBDIVISIONS)) & (c != SUBDIVISIONS.index("END")), F.element_at(names, (c + 1).cast("int")))


def subdivision_code(name) -> Column:
    names = F.array(*[F.lit(PREFIX + s) for s in SUBDIVISIONS if s != "END"])
    at = F.array_position(names, col(name))
    return F.when(at > SUBDIVISIONS.index("END"), at).when(at > 0, at - 1).cast("int")
