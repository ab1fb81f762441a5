"""Best-fit packing by patterns: how often each of the few-document patterns of lengths is used, is a non-negative least-squares fit to the histogram of lengths.

Each task encodes its documents, cuts them into pieces and numbers its pieces of each length. The histogram has a bin for
each length, so the plan (patterns and how often each is used) is made on the driver from a table whose size doesn't grow with
the data. A piece's number among all pieces of its length, from the tasks' counts, then says which use of which pattern it
fills; no group of pieces is ever gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helix.llm import words as W
from helix.llm.shared import written
from helix.llm.tokens import encoder

Plan = list[tuple[list[tuple[int, int]], int]]  # of (lengths with how often each stands in the pattern, uses of the pattern)


def token_pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, doc_id: str, text: str, with_ids: bool = False) -> DataFrame:
    """docs -> a row for each piece: doc_id, piece, start, length, ids_crc32 (and ids), part, rank (among the part's pieces of that length)."""
    kept = T.StructField("doc_id", docs.schema[doc_id].dataType)
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.LongType()), ("rank", T.LongType())]
    schema = T.StructType([kept, *(T.StructField(*f) for f in fields), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(tokenizer).encode, TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in batches:
            for base, data, offsets in W.chunks(b["text"], 1 << 20):
                ids, rows = encode(data, offsets)
                out: list[tuple] = []
                for i in range(len(rows) - 1):
                    own = np.append(ids[rows[i] : rows[i + 1]], np.uint32(end_id)).astype("<u4")
                    at, cut, k = 0, len(own) % size or size, 0
                    while at < len(own):
                        out.append((base + i, k, at, cut, zlib.crc32(own[at : at + cut]), part, seen[cut], *([own[at : at + cut].astype(np.int32)] if with_ids else [])))
                        seen[cut] += 1
                        at, cut, k = at + cut, size, k + 1
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(columns[0])), *(pa.array(c, f.dataType == T.IntegerType() and pa.int32() or (pa.list_(pa.int32()) if f.name == "ids" else pa.int64())) for c, f in zip(columns[1:], schema.fields[1:], strict=True))], [f.name for f in schema.fields])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(W.releasing(run, keeps=True), schema)


def patterns(size: int) -> np.ndarray:
    """All patterns of two or three lengths, in order, that add up to size; of two, the first is 0."""
    a, b = np.meshgrid(np.arange(0, size // 3 + 1), np.arange(1, size), indexing="ij")
    c = size - a - b
    ok = (a <= b) & (b <= c)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def fit(histogram: np.ndarray, pats: np.ndarray, rounds: int = 300) -> np.ndarray:
    """How often to use each pattern: the non-negative least-squares fit of their lengths to the histogram, by accelerated projected gradient."""
    n, total = len(histogram), histogram.sum()
    goal = histogram / total
    cols = [pats[:, k] for k in range(3)]

    def made(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(c, x, n) for c in cols)
        y[0] = 0
        return y

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[c] for c in cols)

    v = np.ones(len(pats))
    for _ in range(30):  # the largest eigenvalue, for the step
        w = back(made(v))
        v = w / np.linalg.norm(w)
    step = 1 / (1.05 * np.linalg.norm(back(made(v))))
    x = y = np.full(len(pats), 1 / len(pats) / 3)
    t = 1.0
    for _ in range(rounds):
        r = made(y) - goal
        r[0] = 0
        new = np.maximum(0, y - step * back(r))
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (last - 1) / t * (new - x)
        x = new
    return x * total


def best_fit(histogram: np.ndarray, size: int) -> Plan:
    """Best-fit decreasing over counts: the longest first, each into the fullest sequence that has room. Equal sequences are kept as one with a count."""
    rooms: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def put(room: int, pattern: list[tuple[int, int]], count: int) -> None:
        if count:
            rooms.setdefault(room, []).append((pattern, count))

    for length in range(size, 0, -1):
        left = int(histogram[length])
        for room in sorted(r for r in rooms if r >= length):
            each = room // length
            while left and rooms.get(room):
                pattern, count = rooms[room].pop()
                full = min(count, left // each)
                put(room - each * length, [*pattern, (length, each)], full)
                left -= full * each
                count -= full
                if count and left:  # fewer are left than would fill one
                    put(room - left * length, [*pattern, (length, left)], 1)
                    left, count = 0, count - 1
                put(room, pattern, count)
                if full == 0:
                    break
            if not left:
                break
        if left:
            each = size // length
            put(size - each * length, [(length, each)], left // each)
            if left % each:
                put(size - left % each * length, [(length, left % each)], 1)
    return [x for group in rooms.values() for x in group]


def make_plan(histogram: np.ndarray, size: int, fits: int = 3) -> Plan:
    """The plan for a histogram of lengths 0 to size: fitted patterns with counts rounded down, and the rest by best fit. It uses every piece once."""
    rest, plan = histogram.astype(np.int64).copy(), []
    if rest[size]:
        plan.append(([(size, 1)], int(rest[size])))
        rest[size] = 0
    pats = patterns(size)
    for _ in range(fits):
        if rest.sum() < len(rest):
            break
        x = fit(rest, pats)
        use = sum(np.bincount(pats[:, k], x, len(rest)) for k in range(3))
        most = np.divide(rest, use, out=np.ones(len(rest)), where=use > rest)
        most[0] = 1
        x = np.floor(x * most[pats].min(axis=1) + 1e-9).astype(np.int64)  # never more of a length than there is
        for i in np.flatnonzero(x):
            lengths = pats[i][pats[i] > 0].tolist()
            plan.append(([(n, lengths.count(n)) for n in dict.fromkeys(lengths)], int(x[i])))
            for n in lengths:
                rest[n] -= x[i]
    assert (rest >= 0).all()
    return plan + best_fit(rest, size)


def slots(plan: Plan) -> dict[str, np.ndarray]:
    """The plan as arrays, a row for each length in a pattern, by length: first (the first number of that length that goes there), sequence (the
    pattern's first), offset, each (how often the length stands there)."""
    rows, taken, sequence = [], {}, 0
    for lengths, count in plan:
        offset = 0
        for n, each in lengths:
            rows.append((n, taken.get(n, 0), sequence, offset, each))
            taken[n] = taken.get(n, 0) + count * each
            offset += n * each
        sequence += count
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "offset", "each"), a.T, strict=True))


def pack(docs: DataFrame, tokenizer: str, *, size: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text; others are left alone) -> a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document's ids end with end_id, so a null or empty text is one piece of one id. Documents of more than size ids are cut into pieces of size,
    the first of which has what is over. Rows with the same or no doc_id are documents of their own. Every sequence is filled from 0 without gaps.
    The tokenizer's file must have the same path on every executor.
    """
    cut = written(token_pieces(docs, tokenizer, size, end_id, doc_id, text, with_ids), "pieces")
    counts = written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length
        histogram[r["length"]] = r["n"]
    plan = slots(make_plan(histogram, size))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    base = counts.select(F.col("part").alias("_part"), F.col("length").alias("_length"), before.alias("_base"))
    numbered = cut.join(base, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).withColumn("number", F.col("rank") + F.col("_base")).drop("_part", "_length", "_base", "part", "rank")
    return _placed(numbered, plan, size)


def _placed(numbered: DataFrame, plan: dict[str, np.ndarray], size: int) -> DataFrame:
    kept: Sequence[T.StructField] = [f for f in numbered.schema.fields if f.name != "number"]
    key = plan["length"] << 44 | plan["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b["length"].to_numpy(zero_copy_only=False), b["number"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length.astype(np.int64) << 44 | number, "right") - 1
            over = number - plan["first"][at]
            sequence = plan["sequence"][at] + over // plan["each"][at]
            offset = plan["offset"][at] + over % plan["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(b[f.name] for f in kept), pa.array(sequence), pa.array(offset)], [*(f.name for f in kept), "sequence_id", "offset"])

    return numbered.mapInArrow(W.releasing(run), T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
