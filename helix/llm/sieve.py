"""A bit set of fixed size that tells which rows may have a partner in a join, so that the others aren't shuffled.

It only ever lets too many through: a join follows. When it is full it lets all through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24


class Sieve:
    def __init__(self, hashes: DataFrame):
        """hashes: one column of 64-bit hashes. Each task sets bits before the shuffle; 2^18 words of 64 bits come to the driver at most."""
        (name,) = hashes.columns
        at = F.col(name).bitwiseAND(F.lit((1 << BITS) - 1))
        table = hashes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(self._shifted(at)).alias("bits")).toArrow()
        words = np.zeros(1 << (BITS - 6), np.uint64)
        if table.num_rows:
            words[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
        self.words = words

    @staticmethod
    def _shifted(at: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h.astype(np.uint64) & np.uint64((1 << BITS) - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    def column(self, hashed: Column) -> Column:
        """A boolean column: may the row's hash be there?"""
        holds = self.holds

        @F.pandas_udf("boolean")
        def test(h: pd.Series) -> pd.Series:
            return pd.Series(holds(h.to_numpy().view(np.uint64)))

        return test(hashed)
