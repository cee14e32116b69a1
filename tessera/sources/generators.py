"""Test planes made by ``range``: ramps, growing steps and seeded noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def _halves(left: list[list[int]], right: list[list[int]]) -> list[int]:
    """16 rows of 16: bands of four rows, each row a left and a right half, taken in turn by band and row."""
    return [v for y in range(16) for v in left[y // 4 % 2 * 2 + y % 2] + right[y // 4 % 2]]


#: Small planes given cell by cell, with their widths; the last three by rule, as rows of halves and as five cells among zeros.
LITERALS = {
    "grid_4x4": (4, [0, 1, 4, 5, 2, 3, 6, 7, 8, 9, 12, 13, 10, 11, 14, 15]),
    "grid_4x4_padded": (4, [0, 1, 4, 0, 2, 3, 5, 0, 6, 7, 10, 0, 8, 9, 11, 0]),
    "grid_4x8": (4, [0, 1, 4, 5, 2, 3, 6, 7, 8, 9, 12, 13, 10, 11, 14, 15, 0, 1, 4, 5, 2, 3, 6, 7, 8, 8, 10, 10, 9, 9, 10, 10]),
    "grid_2x8": (2, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]),
    "grid_2x2": (2, [0, 1, 2, 3]),
    "grid_3x2": (3, [0, 1, 4, 2, 3, 5]),
    "grid_6x4": (6, [0, 1, 2, 3, 4, 5, 3, 3, 1, 1, 2, 2, 5, 4, 3, 2, 1, 0, 2, 2, 1, 1, 3, 3]),
    "grid_16x16_1": (16, _halves([list(range(8)), list(range(10, 2, -1)), list(range(50, 58)), list(range(58, 50, -1))], [list(range(102, 117, 2)), [3, 5, 6, 3, 1, 2, 1, 1]])),
    "grid_16x16_2": (16, [228, 228, 228, 44, 2] + [0] * 251),
    "grid_16x16_3": (16, [0] * 128 + [228, 228, 228, 44, 2] + [0] * 123),
}


def literal(spark: SparkSession, name: str) -> DataFrame:
    width, cells = LITERALS[name]
    rows = [(0, i // width, i % width, v) for i, v in enumerate(cells)]
    return spark.createDataFrame(rows, "img long, y long, x long, v int")


def _plane(spark: SparkSession, width: int, height: int, value) -> DataFrame:
    i = F.col("id")
    return spark.range(width * height).select(
        F.lit(0).cast("long").alias("img"), F.floor(i / width).cast("long").alias("y"), (i % width).cast("long").alias("x"), value(i).cast("int").alias("v")
    )


def ramp(spark: SparkSession, width: int, height: int) -> DataFrame:
    """v = i mod 256."""
    return _plane(spark, width, height, lambda i: i % 256)


def growing(spark: SparkSession, width: int, height: int) -> DataFrame:
    """v = i (i + 1) / 2 mod 256: each step is one larger than the last."""
    return _plane(spark, width, height, lambda i: F.floor(i * (i + 1) / 2) % 256)


def noise(spark: SparkSession, width: int, height: int, seed: int = 42) -> DataFrame:
    """Uniform symbols that depend on the seed and the cell alone, not on the partitions."""
    return _plane(spark, width, height, lambda i: F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(256)))


#: Named inputs, as generators with their sizes.
CONFIGS = {
    "8x8_ident": (ramp, 8, 8), "16x8_ident": (ramp, 16, 8), "16x16_ident": (ramp, 16, 16),
    "16x16_delta_ident": (growing, 16, 16), "32x32_delta_ident": (growing, 32, 32),
    "8x8_ident_2048": (ramp, 2048, 1536), "8x8_ident_4096": (ramp, 4096, 4096), "large_random": (noise, 1024, 1024),
}


def frame(spark: SparkSession, config: str) -> DataFrame:
    """A named input as img, y, x, v."""
    if config in LITERALS:
        return literal(spark, config)
    make, width, height = CONFIGS[config]
    return make(spark, width, height)
