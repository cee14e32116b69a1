"""Arrays of integers to bytes and back, as Column functions.

All multi-byte integers are little-endian. A counted form begins with the number of values
(or of bytes, for nibbles) as 32 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import col, let, shifted_right


def _index(n: Column) -> Column:
    """0 to n - 1 as an array; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def to_bytes(values) -> Column:
    """An array of bytes 0..255 as binary."""
    return F.unhex(F.array_join(F.transform(col(values), lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def from_bytes(data) -> Column:
    """Binary as an array of 0..255."""
    byte = lambda h, i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return let(F.hex(col(data)), lambda h: F.transform(_index(F.length(h) / 2), lambda i: byte(h, i)))


def little(v, size: int) -> Column:
    """An unsigned integer as ``size`` bytes; 8 bytes take a bigint or a decimal(20, 0)."""
    h = F.lpad(F.hex(col(v)) if size < 8 else F.conv(col(v).cast("string"), 10, 16), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * (size - i) - 1, 2) for i in range(size)]))


def read_little(data, offset, size: int) -> Column:
    """The unsigned integer of ``size`` bytes at an offset; of 8 bytes as decimal(20, 0)."""
    h = F.hex(col(data))
    at = col(offset) * 2
    text = F.concat(*[F.substr(h, at + 2 * (size - 1 - i) + 1, F.lit(2)) for i in range(size)])
    return F.conv(text, 16, 10).cast("decimal(20,0)" if size == 8 else "long")


def joined(*parts) -> Column:
    return F.concat(*[col(p) for p in parts])


def counted(values) -> Column:
    """The number of values, then the values as bytes."""
    return F.concat(little(F.size(col(values)), 4), to_bytes(values))


def read_counted(data) -> Column:
    n = read_little(data, F.lit(0), 4)
    return F.slice(from_bytes(data), F.lit(5), n.cast("int"))


def nibbles(values) -> Column:
    """Pairs of values 0..15 as bytes, the first in the low half; an odd last one has 0 above."""
    pair = lambda a, i: F.get(a, i * 2) + 16 * F.coalesce(F.get(a, i * 2 + 1), F.lit(0))
    return let(values, lambda a: F.transform(_index(F.ceil(F.size(a) / 2)), lambda i: pair(a, i)))


def split_nibbles(merged) -> Column:
    return F.flatten(F.transform(col(merged), lambda b: F.array(b.bitwiseAND(F.lit(15)), shifted_right(b, 4))))


def counted_nibbles(values) -> Column:
    merged = nibbles(values)
    return F.concat(little(F.size(merged), 4), to_bytes(merged))


def read_counted_nibbles(data) -> Column:
    return split_nibbles(read_counted(data))


def counted_bits(values) -> Column:
    """The number of bits, then the bits, eight to a byte from the lowest; not 0 counts as 1."""
    bit = lambda a, i, j: F.when(F.coalesce(F.get(a, i * 8 + j), F.lit(0)) != 0, 1 << j).otherwise(0)
    byte = lambda a, i: sum((bit(a, i, j) for j in range(1, 8)), bit(a, i, 0))
    packed = let(values, lambda a: F.transform(_index(F.ceil(F.size(a) / 8)), lambda i: byte(a, i)))
    return F.concat(little(F.size(col(values)), 4), to_bytes(packed))


def read_counted_bits(data) -> Column:
    n = read_little(data, F.lit(0), 4).cast("int")
    packed = F.slice(from_bytes(data), F.lit(5), F.octet_length(col(data)))
    bits = F.flatten(F.transform(packed, lambda b: F.array(*[shifted_right(b, j).bitwiseAND(F.lit(1)) for j in range(8)])))
    return F.slice(bits, F.lit(1), n)


def planar16(values, count: bool = False) -> Column:
    """The low bytes of all values, then their high bytes."""
    a = col(values)
    low, high = F.transform(a, lambda v: v.bitwiseAND(F.lit(255))), F.transform(a, lambda v: shifted_right(v, 8))
    planes = to_bytes(F.concat(low, high))
    return F.concat(little(F.size(a), 4), planes) if count else planes


def read_planar16(data, count: bool = False) -> Column:
    def read(b: Column) -> Column:
        half = F.floor(F.size(b) / 2).cast("int")
        return F.transform(F.slice(b, F.lit(1), half), lambda v, i: v + 256 * F.get(b, half + i))

    b = from_bytes(data)
    return let(F.slice(b, F.lit(5), F.octet_length(col(data))) if count else b, read)


def split_runs(values, length: int) -> Column:
    """An array cut into arrays of a length; the last may be shorter."""
    return let(values, lambda a: F.transform(_index(F.ceil(F.size(a) / length)), lambda i: F.slice(a, i * length + 1, F.lit(length))))


def split_streams(values, n: int) -> Column:
    """n arrays of equal length, one after the other; the length must be a multiple of n."""
    def split(a: Column) -> Column:
        size = F.floor(F.size(a) / n).cast("int")
        return F.transform(F.array(*[F.lit(i) for i in range(n)]), lambda i: F.slice(a, i * size + 1, size))

    return let(values, split)


def deinterleave(values, n: int) -> Column:
    """Every n-th value from the first, then every n-th from the second, and so on."""
    def deal(a: Column) -> Column:
        size = F.floor(F.size(a) / n).cast("int")
        return F.transform(_index(F.size(a)), lambda p: F.get(a, (p % size) * n + F.floor(p / size).cast("int")))

    return let(values, deal)


def swap_words(data, width: int = 4) -> Column:
    """Bytes of each word of ``width`` in turned order; the length must be a multiple."""
    turned = let(from_bytes(data), lambda b: F.transform(_index(F.size(b)), lambda i: F.get(b, i - i % width + (width - 1) - i % width)))
    return to_bytes(turned)


def frame_words(bits, width: int = 4) -> Column:
    """Padded, swapped words of a text of bits.

    The last byte is filled with zeros; four zero bytes follow, zeros up to a whole word,
    one zero word; then the bytes of each word are turned.
    """
    n = F.ceil(F.length(col(bits)) / 8).cast("int")
    filled = F.rpad(col(bits), n * 8, "0")
    packed = let(filled, lambda b: F.transform(_index(n), lambda i: F.conv(F.substr(b, i * 8 + 1, F.lit(8)), 2, 10).cast("int")))
    total = (F.ceil((n + 4) / width) * width + width).cast("int")
    return swap_words(to_bytes(F.concat(packed, F.array_repeat(F.lit(0), (total - n).cast("int")))), width)


def numbers_text(values) -> Column:
    return F.array_join(F.transform(col(values), lambda v: v.cast("string")), " ")
