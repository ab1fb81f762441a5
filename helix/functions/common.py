"""Small column helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """scale * a / b to six places, 0 where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(scale * a.cast("double") / b, 6))


def count_of(text: Column, letters: str) -> Column:
    """How many characters of text are among the letters."""
    others = "".join(c if c.isalnum() else f"\\{c}" for c in letters)
    return F.length(F.regexp_replace(text, F.lit(f"[^{others}]+"), F.lit(""))).cast("long")  # runs at a time; translate makes a string of each character


def count_if(condition: Column) -> Column:
    """A conditional count that is 0 over no rows."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def first_error(*cases: tuple[Column, str]) -> Column:
    """The code of the first case that holds, else null."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), code) for c, code in cases])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array without nulls, one value after the other, and where each begins (and the last ends): views of Arrow's buffers."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    cuts = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.zeros(0, np.uint8), cuts - cuts[0]
