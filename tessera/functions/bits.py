"""Bit and integer arithmetic as Column functions.

Symbols are bytes kept in 0..255. All are built-in expressions that whole-stage code
generation covers; none calls Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An escape is written where the quotient has at least this many zeros.
ESCAPE = 16
ESCAPE_BITS = 24


def col(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def let(value, body) -> Column:
    """``body`` of a value that is taken once a row, however often ``body`` mentions it."""
    return F.transform(F.array(col(value)), body)[0]


def shifted_right(n, k) -> Column:
    """n >> k, the quotient by 2**k."""
    return F.call_function("shiftright", col(n), col(k).cast("int"))


def zigzag(v) -> Column:
    """0, -1, 1, -2, 2 ... to 0, 1, 2, 3, 4 ..."""
    v = col(v)
    return F.when(v < 0, -2 * v - 1).otherwise(2 * v)


def unzigzag(z) -> Column:
    z = col(z)
    return F.when(z % 2 == 0, shifted_right(z, 1)).otherwise(-shifted_right(z, 1) - 1)


def byte_zigzag(u) -> Column:
    """Zigzag of a byte 0..255 read as -128..127; the result is a byte again."""
    u = col(u)
    return F.when(u >= 128, 511 - 2 * u).otherwise(2 * u)


def byte_unzigzag(z) -> Column:
    return F.pmod(unzigzag(z), F.lit(256))


def byte_zigzag_by_mask(u) -> Column:
    """The same without a branch: the doubled value, its bits turned where it was negative."""
    u = col(u)
    return F.pmod((2 * u).bitwiseXOR(-(shifted_right(u, 7))), F.lit(256))


def num_bits_plain(n, k) -> Column:
    """Width of a code whose prefix has no limit."""
    return shifted_right(n, k) + 1 + col(k)


def num_bits(n, k) -> Column:
    """Width of a code that is escaped from 16 zeros on."""
    return F.when(shifted_right(n, k) >= ESCAPE, ESCAPE_BITS).otherwise(num_bits_plain(n, k))


def leading_zeros(bits) -> Column:
    """Zeros before the first 1 of a text of bits, at most 16; 16 if it has none."""
    at = F.instr(col(bits), "1")
    return F.when(at == 0, ESCAPE).otherwise(F.least(F.lit(ESCAPE), at - 1))


def safe_shift_left(v, n, width: int = 32) -> Column:
    """v << n within ``width`` bits (at most 32); 0 from n = width on."""
    n = col(n)
    moved = F.call_function("shiftleft", col(v).cast("long"), F.least(n, F.lit(31)).cast("int"))
    return F.when(n >= width, F.lit(0).cast("long")).otherwise(moved.bitwiseAND(F.lit((1 << width) - 1)))


def safe_shift_right(v, n, width: int = 32) -> Column:
    n = col(n)
    moved = F.call_function("shiftright", col(v).cast("long"), F.least(n, F.lit(31)).cast("int"))
    return F.when(n >= width, F.lit(0).cast("long")).otherwise(moved)


def bit_text(v, width: int) -> Column:
    """Binary digits in groups of four, with dashes between."""
    digits = F.lpad(F.bin(col(v)), width, "0")
    return F.regexp_replace(digits, "(?<=[01])(?=([01]{4})+$)", "-")


def clamp(v, low, high) -> Column:
    return F.greatest(col(low), F.least(col(high), col(v)))


def ceil_div(n, d: int) -> Column:
    return F.floor((col(n) + (d - 1)) / d).cast("long")


def padded(n, to: int = 4) -> Column:
    """n rounded up to a multiple."""
    return ceil_div(n, to) * to
