"""Fuzzy line deduplication by MinHash: one line stays of each component of similar lines.

Equal lines become one member first, with its count and its first place, so a line that stands in a third of all documents is one
row from then on. A line's sketch, of its set of character shingles, is made where the document is read, and goes into the shuffle in
place of the text, which it is smaller than. Members are joined as in similar.py. Every occurrence but the component's first is
then dropped: only occurrences of lines with a rival take part in that join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helix.llm import words as W
from helix.llm.shared import Scratch, located, texts_at, written
from helix.llm.sieve import Sieve
from helix.llm.similar import matrix, similarity_classes
from helix.llm.sketch import bytes_of, minhashes


#: Characters that are hashed at a time, so that what is computed stays in a core's cache.
_STEP = 1 << 14


def char_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n characters of a run of texts (of all of a shorter text), ASCII letters folded, row by row, and the rows' offsets in them."""
    c = np.frombuffer(W.LOWER[data].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = offsets if len(c) == len(data) else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    size = np.diff(at)
    after = np.concatenate([[0], np.cumsum(np.where(size < n, size > 0, size - n + 1))])
    long, short = np.flatnonzero(size >= n), np.flatnonzero((size > 0) & (size < n))
    every = _run_hashes(c, n)
    # runs that begin in a row and end in the next one go
    begins = np.zeros(len(every) + 1, np.int8)
    np.add.at(begins, at[long], 1)
    np.add.at(begins, at[long + 1] - n + 1, -1)
    every = every[np.cumsum(begins[:-1], dtype=np.int8).view(bool)]
    if not len(short):
        return every, after
    out = np.empty(after[-1], W.U)
    inner = np.ones(len(out), bool)
    inner[after[short]] = False
    out[inner] = every
    for k in range(1, n):
        some = short[size[short] == k]
        if len(some):
            out[after[some]] = _run_hashes(c, k)[at[some]]
    return out, after


def _run_hashes(c: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n characters: their sum with random odd factors, mixed."""
    out = np.empty(max(len(c) - n + 1, 0), W.U)
    wide, sums, part = np.empty(_STEP + n, W.U), np.empty(_STEP, W.U), np.empty(_STEP, W.U)
    for first in range(0, len(out), _STEP):
        last = min(first + _STEP, len(out))
        x, y, z = wide[: last - first + n - 1], sums[: last - first], part[: last - first]
        np.add(c[first : last + n - 1], W.U(1), out=x)
        np.multiply(x[: len(y)], W.FACTORS[0], out=y)
        for i in range(1, n):
            np.multiply(x[i : i + len(y)], W.FACTORS[i], out=z)
            np.add(y, z, out=y)
        np.add(y, W.U(n), out=y)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            np.right_shift(y, W.U(shift), out=z)
            np.bitwise_xor(y, z, out=y)
            np.multiply(y, W.U(factor), out=y)
        np.right_shift(y, W.U(31), out=z)
        np.bitwise_xor(y, z, out=out[first:last])
    return out


def char_shingles(n: int):
    """The runs of n characters of a run of texts, with the row of each, in order of rows."""

    def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, after = char_hashes(data, offsets, n)
        return h, np.repeat(np.arange(len(after) - 1), np.diff(after))

    return shingles


def distinct_hashes(h: np.ndarray) -> np.ndarray:
    """The distinct ones, in order."""
    h = np.sort(h)
    first = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=first[1:])
    return h[first]


#: Bytes that are white space at a line's ends.
_INK = np.array([b not in b" \t\n\r\v\f" for b in range(256)])


def text_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines of a run of texts that aren't blank, without white space at their ends: starts, ends, rows, numbers from 0; and how many lines each text has."""
    feeds = np.flatnonzero(data == 10)
    row_of = np.searchsorted(offsets, feeds, "right") - 1
    n = np.bincount(row_of, minlength=len(offsets) - 1) + 1
    row = np.repeat(np.arange(len(n)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    after = np.concatenate([[0], np.cumsum(n)])
    starts, ends = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    starts[after[:-1]], ends[after[1:] - 1] = offsets[:-1], offsets[1:]
    inner = np.ones(len(row), bool)
    inner[after[:-1]] = False
    starts[inner] = feeds + 1
    ends[np.flatnonzero(inner) - 1] = feeds
    for move, at in ((1, starts), (-1, ends)):
        live = np.flatnonzero(starts < ends)
        for _ in range(64):
            live = live[~_INK[data[at[live] - (move < 0)]]]
            if not len(live):
                break
            at[live] += move
            live = live[starts[live] < ends[live]]
    if len(live) or (~_INK[data[starts[starts < ends]]]).any():  # long white space
        ink = np.flatnonzero(_INK[data])
        i, j = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
        some = np.flatnonzero(i < j)
        return ink[i[some]], ink[j[some] - 1] + 1, row[some], number[some], n
    some = np.flatnonzero(starts < ends)
    return starts[some], ends[some], row[some], number[some], n


def compact(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans in a row, and their offsets. Spans are in order and don't overlap."""
    after = np.concatenate([[0], np.cumsum(ends - starts)])
    cuts = np.stack([starts, ends], axis=1).ravel()
    inside = np.repeat(np.arange(len(cuts) + 1) % 2 == 1, np.diff(cuts, prepend=0, append=len(data)))
    return data[inside], after


def keys(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The MD5 of each text."""
    raw, cuts = data.tobytes(), offsets.tolist()
    return pa.array([hashlib.md5(raw[a:b]).digest() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())


def sketched_lines(rows: DataFrame, shingle: int, coordinates: int) -> DataFrame:
    """rows (doc_id, text, at, _row) -> key, doc_id, at, _row, line, sketch: every line that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in W.chunks(batch["text"]):
                starts, ends, row, number, _ = text_lines(data, offsets)
                if len(row):
                    bytes_, after = compact(data, starts, ends)
                    sketch = np.ascontiguousarray(bytes_of(minhashes(*char_hashes(bytes_, after, shingle), coordinates)))
                    cuts = np.arange(len(row) + 1, dtype=np.int32) * coordinates
                    at = pa.array(row + first)
                    yield pa.RecordBatch.from_arrays(
                        [keys(bytes_, after), *(batch[c].take(at) for c in ("doc_id", "at", "_row")), pa.array(number.astype(np.int32)), pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts), pa.py_buffer(sketch)])],
                        ["key", "doc_id", "at", "_row", "line", "sketch"],
                    )

    return rows.mapInArrow(W.releasing(run), f"key binary, doc_id {rows.schema['doc_id'].dataType.simpleString()}, at long, _row long, line int, sketch binary")


def lines_at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """rows (text, at, _row) -> at, _row, line, text of the lines that may be among places (at, _row, line); a join follows."""
    wanted = Sieve(places.select(F.xxhash64("at", "_row").alias("h")))
    held = Sieve(hashed(places.select("at", "_row", "line"), lambda b: place_hashes(*(c.to_numpy(zero_copy_only=False) for c in b.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in W.chunks(batch["text"]):
                starts, ends, row, number, _ = text_lines(data, offsets)
                place = [batch[c].to_numpy(zero_copy_only=False)[row + first] for c in ("at", "_row")]
                some = np.flatnonzero(held.holds(place_hashes(*place, number)))
                if len(some):
                    bytes_, after = compact(data, starts[some], ends[some])
                    text = pa.StringArray.from_buffers(len(some), pa.py_buffer(after.astype(np.int32)), pa.py_buffer(bytes_))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x[some]) for x in place), pa.array(number[some].astype(np.int32)), text], ["at", "_row", "line", "text"])

    return rows.filter(wanted.column(F.xxhash64("at", "_row"))).select("text", "at", "_row").mapInArrow(W.releasing(run), "at long, _row long, line int, text string")


def hashed(rows: DataFrame, hashes) -> DataFrame:
    """A column of what hashes() gives for batches of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(hashes(b).view(np.int64))], ["h"])

    return rows.mapInArrow(W.releasing(run), "h long")


def place_hashes(at: np.ndarray, row: np.ndarray, line: np.ndarray) -> np.ndarray:
    return W.mixed(at.view(W.U) ^ W.mixed(row.astype(W.U) * W.U(0x9E3779B97F4A7C15) + line.astype(W.U)))


def key_hashes(key: pa.Array) -> np.ndarray:
    """The first eight bytes of keys."""
    return np.ascontiguousarray(matrix(key)).view(W.U)[:, 0] if len(key) else np.zeros(0, W.U)


def lines_with_keys(rows: DataFrame, wanted: Sieve) -> DataFrame:
    """rows (doc_id, text, _file, _row) -> doc_id, n_lines, _file, _row, and the numbers (lines) and keys of the lines whose key may be among those wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in W.chunks(batch["text"]):
                starts, ends, row, number, n = text_lines(data, offsets)
                key = keys(*compact(data, starts, ends))
                some = np.flatnonzero(wanted.holds(key_hashes(key)))
                cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[some], minlength=len(n)))]), pa.int32())
                part = batch.slice(first, len(n))
                yield pa.RecordBatch.from_arrays(
                    [*(part[c] for c in ("doc_id", "_file", "_row")), pa.array(n), pa.ListArray.from_arrays(cuts, pa.array(number[some].astype(np.int32))), pa.ListArray.from_arrays(cuts, key.take(pa.array(some)))],
                    ["doc_id", "_file", "_row", "n_lines", "lines", "keys"],
                )

    return rows.select("doc_id", "text", "_file", "_row").mapInArrow(W.releasing(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, _file string, _row long, n_lines long, lines array<int>, keys array<binary>")


def line_decisions(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, coordinates: int = 144, rows_per_band: int = 6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (doc_id, text; others are left alone) -> for each row: doc_id, n_lines, dropped (array of line numbers from 0, in order), _file, _row.

    Lines end at line feeds and are compared without white space at their ends; blank ones are never dropped. Two lines are linked if they are equal or the
    Jaccard similarity of their sets of character shingles is at least threshold. Of a component the occurrence of the smallest doc_id (null last), then
    file, row and line number, stays. Repeated rows are documents like others, so the later one loses its lines. Null is as empty: one blank line.
    144 coordinates in 24 bands of 6 miss a link of similarity 0.8 once in 1,470 times, one of 0.85 once in 85,000, one of 0.9 once in 85 million.
    """
    return decisions_of(texts_at(located(docs), doc_id, text), shingle=shingle, threshold=threshold, coordinates=coordinates, rows_per_band=rows_per_band)


def decisions_of(rows: DataFrame, *, shingle: int = 5, threshold: float = 0.8, coordinates: int = 144, rows_per_band: int = 6) -> DataFrame:
    """line_decisions() of rows (doc_id, text, _file, _row)."""
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("at", F.xxhash64("_file"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "_row", "line")
    scratch = Scratch(rows.sparkSession)
    distinct = sketched_lines(rows, shingle, coordinates).groupBy("key").agg(F.min(place).alias("place"), F.count("*").alias("n"), F.first("sketch").alias("sketch"))
    members = scratch.written(distinct.withColumn("id", F.monotonically_increasing_id()), "lines")

    def texts_of(held: DataFrame, ids: DataFrame) -> DataFrame:
        places = scratch.written(held.select("id", "place.at", "place._row", "place.line").join(ids, "id"), "places")
        return scratch.written(lines_at(rows, places).join(places, ["at", "_row", "line"]).select("id", "text"), "texts")

    roots, held = similarity_classes(members, texts_of, char_shingles(shingle), distinct_hashes, scratch, threshold=threshold, width=rows_per_band)
    # lines of their own that stand once have no rival, which are most
    classed = held.select("id", "key", "place").join(roots, "id")
    heads = classed.groupBy("root").agg(F.min("place").alias("first"))
    equal = members.filter("n > 1").select("id", "key", "place").join(roots, "id", "left_anti")
    rivals = written(classed.select("key", "root").join(heads, "root").select("key", "first").unionByName(equal.select("key", F.col("place").alias("first"))), "rivals")
    scratch.drop()
    found = written(lines_with_keys(rows, Sieve(hashed(rivals.select("key"), lambda b: key_hashes(b["key"])))), "found")
    some = found.select("_file", "_row", F.explode(F.arrays_zip("lines", "keys")).alias("x")).select("_file", "_row", F.col("x.lines").alias("line"), F.col("x.keys").alias("key"))
    is_first = (F.col("first.at") == F.xxhash64("_file")) & (F.col("first._row") == F.col("_row")) & (F.col("first.line") == F.col("line"))
    dropped = some.join(rivals, "key").filter(~is_first).groupBy("_file", "_row").agg(F.array_sort(F.collect_list("line")).alias("dropped"))
    return found.drop("lines", "keys").join(dropped, ["_file", "_row"], "left").select("doc_id", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"), "_file", "_row")


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with the lines of line_decisions() taken out of text; all rows and other columns stay. A null text stays null."""
    places = located(docs)
    out = places.join(decisions_of(texts_at(places, doc_id, text), **options).select("_file", "_row", "dropped"), ["_file", "_row"])
    t, gone = F.col("row")[text], F.map_from_arrays("dropped", F.transform("dropped", lambda _: F.lit(True)))
    kept = F.filter(F.transform(F.split(t, "\n"), lambda line, i: F.struct(line.alias("line"), F.map_contains_key(gone, i).alias("gone"))), lambda x: ~x["gone"])
    new = F.when(F.size("dropped") == 0, t).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return out.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
