"""FASTQ reads: qualities, names of mates, adapters and trimming."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helix.functions.common import col, count_of, first_error, text_bytes
from helix.functions.sequence import base_composition

OFFSET, LAST = 33, 126


def _chars(a: int, b: int) -> str:
    """The quality characters of phred a up to, not with, b."""
    return "".join(map(chr, range(OFFSET + a, OFFSET + b)))


def phred(qual: Column | str) -> Column:
    """Array of phred scores."""
    q = col(qual)
    return F.when(F.length(q) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(q, ""), lambda c: F.ascii(c) - OFFSET))


PROFILE = T.StructType([T.StructField(n, t) for n, t in (("total", T.LongType()), ("q20", T.LongType()), ("q30", T.LongType()), ("low", T.IntegerType()), ("high", T.IntegerType()))])


def _profiles(quals: pa.Array) -> pa.Array:
    """The rows of quality_profile."""
    text = quals.fill_null("")
    data, cuts = text_bytes(text)
    if len(data) and data.max() > 127:  # characters, not bytes
        data, cuts = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(np.array([len(x) for x in text.to_pylist()], np.int64))])
    scores = data.astype(np.int64) - OFFSET
    of = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[cuts])
    absent, empty = quals.is_null().to_numpy(zero_copy_only=False), cuts[1:] == cuts[:-1]
    low, high = np.zeros((2, len(empty)), np.int32)
    if len(scores):
        low[~empty], high[~empty] = (f.reduceat(scores, cuts[:-1][~empty]) for f in (np.minimum, np.maximum))
    columns = [pa.array(of(x).astype(np.int64), mask=absent) for x in (scores, scores >= 20, scores >= 30)] + [pa.array(x, mask=empty) for x in (low, high)]
    return pa.StructArray.from_arrays(columns, PROFILE.names)


def quality_profile(qual: Column | str) -> Column:
    """struct(total, q20, q30, low, high): the sum of scores, how many are at least 20 and 30, the least and the greatest. By batches of bytes; see profile_expression for SQL."""
    return F.arrow_udf(_profiles, PROFILE)(col(qual))


def profile_expression(qual: Column | str) -> Column:
    """quality_profile as an expression without Python: for SQL functions."""
    q = col(qual)
    # bound to a variable, so that the scores are made once
    of = lambda p: F.struct(F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min(p).alias("low"), F.array_max(p).alias("high"))
    s = F.get(F.transform(F.array(phred(q)), of), F.lit(0))
    return F.struct(s["total"].alias("total"), (F.length(q) - count_of(q, _chars(0, 20))).alias("q20"), (F.length(q) - count_of(q, _chars(0, 30))).alias("q30"), s["low"].alias("low"), s["high"].alias("high"))


def fastq_error(header: Column | str, seq: Column | str, separator: Column | str, qual: Column | str) -> Column:
    """Why a record is invalid, or null: bad_header, empty_sequence, bad_separator, length_mismatch, bad_base, bad_quality."""
    h, s, p, q = col(header), col(seq), col(separator), col(qual)
    return first_error(
        (h.isNull() | ~h.rlike(r"^@\s*\S"), "bad_header"), (s.isNull() | (s == ""), "empty_sequence"), (p.isNull() | ~F.startswith(p, F.lit("+")), "bad_separator"),
        (q.isNull() | (F.length(s) != F.length(q)), "length_mismatch"), (~base_composition(s)["valid"], "bad_base"), (~q.rlike("^[!-~]+$"), "bad_quality"),
    )


def read_name(header: Column | str) -> Column:
    """The first token of a header, without its @."""
    return F.regexp_extract(col(header), r"^@[ \t]*([^ \t]+)", 1)


def mate_identity(header: Column | str) -> Column:
    """struct(core_id, mate, error). A mate is said by /1 or /2 at the end of the first token, or 1: or 2: at the start of the second."""
    token = F.regexp_extract(col(header), r"^@([^ \t]*)", 1)
    marked = token.rlike(r"^(?s:.+)/[12]$")
    first = F.when(marked, F.substr(token, F.length(token), F.lit(1)).cast("int"))
    second = F.regexp_extract(col(header), r"^@[^ \t]*[ \t]+([12]):", 1)
    second = F.when(second != "", second.cast("int"))
    core = F.when(marked, F.substr(token, F.lit(1), F.length(token) - 2)).otherwise(token)
    error = first_error((~F.startswith(col(header), F.lit("@")) | (F.length(col(header)) < 2), "bad_header"), (core == "", "empty_id"), (first != second, "conflicting_mates"))
    return F.struct(core.alias("core_id"), F.coalesce(second, first).alias("mate"), error.alias("error"))


def adapter_position(seq: Column | str, adapter: Column | str, min_overlap: Column | int = 6, max_mismatches: Column | int = 0) -> Column:
    """adapter: a column, or the adapter itself. Where the adapter starts at the 3' end, from 0: leftmost place from which all that is left matches the adapter's start; the length if none."""
    given = adapter if isinstance(adapter, Column) else F.lit(adapter)
    # the read's end is bound to a variable: what a lambda says of a column is computed again at each of its steps
    end = F.struct(F.length(col(seq)).alias("n"), F.when(F.length(given) > 0, F.substr(col(seq), F.greatest(F.lit(1), F.length(col(seq)) - F.length(given) + 1))).otherwise("").alias("text"), given.alias("adapter"))

    def place(x: Column) -> Column:
        text, size = x["text"], F.least(x["n"], F.length(x["adapter"]))
        wrong = lambda st: F.aggregate(F.sequence(st + 1, size), F.lit(0), lambda n, i: n + F.when(F.substr(text, i, F.lit(1)) == F.substr(x["adapter"], i - st, F.lit(1)), 0).otherwise(1))
        found = F.array_min(F.filter(F.sequence(F.lit(0), size - min_overlap), lambda st: wrong(st) <= max_mismatches))
        return F.when(size < min_overlap, x["n"]).otherwise(F.coalesce(x["n"] - size + found, x["n"]))

    return F.get(F.transform(F.array(end), place), F.lit(0))


def quality_trim_length(qual: Column | str, end: Column, q: int = 20) -> Column:
    """What is left of the first end scores when those under q are taken off their end."""
    kept = F.substr(col(qual), F.lit(1), end.cast("int"))
    return F.length(F.rtrim(kept, F.lit(_chars(0, q)))) if q > 0 else end.cast("int")
