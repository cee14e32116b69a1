"""The codec as SQL functions: a decoder of values, one of rows, and aggregates over symbols."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.decode import grouped, interleaved, pack_text
from ..plans.codec import COSTS as CODE_COSTS

READERS = {"grouped": grouped, "interleaved": interleaved}
COSTS = CODE_COSTS.astype(np.int64)


def register(spark: SparkSession) -> None:
    """rice_decode(bits, k, n, layout) gives an array; rice_symbols(bits, k, n, layout) gives rows (i, v).
    The aggregates rice_k(v) and rice_bits(v) give the best k of a group's symbols, and their bits under it.

    ``layout`` is "grouped" or "interleaved". Null bits give null, or no rows. Arguments should
    be stored columns: Spark cannot hand an expression with nested lambdas to Python.
    """
    @F.pandas_udf("array<int>")
    def rice_decode(bits: pd.Series, k: pd.Series, n: pd.Series, layout: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(bits), dtype=object)
        for (size, how), part in pd.DataFrame({"n": n, "how": layout, "k": k, "bits": bits}).dropna().groupby(["n", "how"]):
            got = READERS[how]([pack_text(b) for b in part["bits"]], part["k"].to_numpy(), int(size))
            for at, row in zip(part.index, got.tolist()):
                out[at] = row
        return out

    class Symbols:
        def eval(self, bits: str, k: int, n: int, layout: str):
            if bits is not None:
                for i, v in enumerate(READERS[layout]([pack_text(bits)], np.array([k]), n)[0].tolist()):
                    yield i, v

    def cost(v: pd.Series) -> np.ndarray:
        """Bits of all symbols under each k."""
        return COSTS @ np.bincount(v.dropna().astype(np.int64), minlength=256)

    @F.pandas_udf("int")
    def rice_k(v: pd.Series) -> int:
        return int(np.argmin(cost(v)))

    @F.pandas_udf("long")
    def rice_bits(v: pd.Series) -> int:
        return int(cost(v).min())

    spark.udf.register("rice_decode", rice_decode)
    spark.udf.register("rice_k", rice_k)
    spark.udf.register("rice_bits", rice_bits)
    spark.udtf.register("rice_symbols", F.udtf(Symbols, returnType="i int, v int"))
