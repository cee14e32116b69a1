"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The source blocks are the input's partitions. How many rows of each block go to each shard
is drawn from the distribution that a uniform shuffle of all rows would give: a block of n
rows takes a multivariate hypergeometric sample of the places still free in the shards.
A block's rows are then permuted locally, the first ones go to shard 0, the next to shard
1 and so on, and within a shard all rows are permuted again, which gives their slots. Shard sizes
differ by one row at most.

The rows are DataFrame operations throughout. The driver only draws the matrix, from the
counts of at most ``BLOCKS`` blocks. Random keys are drawn once and staged, so a task that
runs again finds the same keys. Neither a block nor a shard is sorted in one task: keys
are uniform, so ranks are taken in parts of ``PART_ROWS`` rows or so.

Defined cases: copies, repeated rows and null ids are rows like any other; a null text has
8 bytes and checksum 0; a very long text is a row like any other, and only its size and
checksum are carried by the query; fewer rows than shards leave the last shards empty;
columns with any names stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, rank_in_groups, stage

SHARDS = 24
SEED = 20_240_229
BLOCKS = 4096
PART_ROWS = 250_000
LEAST_PARTS = 8


def hypergeometric(rng: random.Random, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` balls drawn from an urn are good.

    Inverts the distribution function over 40 standard deviations around the mode; what
    lies beyond has less probability than a double can tell from nothing.
    """
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    total = good + bad
    mean = sample * good / total
    spread = (mean * (bad / total) * (total - sample) / max(1, total - 1)) ** 0.5
    a, b = max(low, int(mean - 40 * spread - 40)), min(high, int(mean + 40 * spread + 40))
    k = np.arange(a, b, dtype=float)
    steps = np.log((good - k) * (sample - k)) - np.log((k + 1) * (bad - sample + k + 1))
    log_p = np.concatenate(([0.0], np.cumsum(steps)))
    below = np.cumsum(np.exp(log_p - log_p.max()))
    return a + int(np.searchsorted(below, rng.random() * below[-1], side="right"))


def matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows for blocks, columns for shards: exact margins, drawn as a uniform shuffle has them."""
    rng = random.Random(seed)
    rows = sum(counts)
    free = [rows // shards + (j < rows % shards) for j in range(shards)]
    out = []
    for n in counts:
        line, left, places = [], n, sum(free)
        for j in range(shards):
            places -= free[j]
            take = hypergeometric(rng, free[j], places, left)
            line.append(take)
            left -= take
        free = [f - t for f, t in zip(free, line)]
        out.append(line)
    return out


def uniform_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with two more columns: shard (from 0) and slot (gapless from 0 in each shard).

    Where ``df`` has such a name, it stays, and the new column has an underscore before it.
    """
    spark = df.sparkSession
    shard, slot, block_of, first, second, tie, rank, ends_of = (fresh(df, x) for x in ("shard", "slot", "block", "key_1", "key_2", "tie", "rank", "ends"))
    block = F.pmod(F.spark_partition_id(), F.lit(BLOCKS))
    keyed = stage(df.withColumns({block_of: block, first: F.rand(seed), second: F.rand(seed + 1), tie: F.monotonically_increasing_id()}))
    counted = sorted((r[0], r[1]) for r in keyed.groupBy(block_of).agg(F.count("*")).collect())  # at most BLOCKS rows
    rows = sum(n for _, n in counted)
    drawn = matrix([n for _, n in counted], shards, seed)
    ends = [(i, np.cumsum(line).tolist()) for (i, _), line in zip(counted, drawn)]
    ends = F.broadcast(spark.createDataFrame(ends, f"{block_of} int, {ends_of} array<long>"))  # at most BLOCKS x shards numbers

    def parts(groups: int) -> int:
        return max(LEAST_PARTS, rows // max(1, groups) // PART_ROWS + 1)

    def bucket(key: str, groups: int):
        return F.floor(F.col(key) * parts(groups)).cast("int")

    dealt = rank_in_groups(keyed, [block_of], [F.col(first), F.col(tie)], bucket(first, len(counted)), rank)
    sent = dealt.join(ends, block_of).withColumn(shard, F.size(F.filter(ends_of, lambda e: e <= F.col(rank))))
    sent = stage(sent.drop(ends_of, rank, block_of, first))
    return rank_in_groups(sent, [shard], [F.col(second), F.col(tie)], bucket(second, shards), slot).drop(second, tie)


def digest(docs: DataFrame) -> DataFrame:
    """The shard and slot of each document, with its size and checksum."""
    text = F.coalesce("text", F.lit(""))
    small = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    return uniform_shards(small).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )
