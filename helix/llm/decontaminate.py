"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, at full containment.

An item is seen as its windows of 13 consecutive words (a shorter item is one window). A window is a list of shingles; the
corpus is counted once over all documents to order shingles by rarity. A document that contains a window contains all of its
shingles, so at this threshold the necessary prefix is the one rarest shingle: documents are probed for it alone. A hit at a
place fixes where the window would lie; the bounds on position and length drop those that don't fit, the rest are verified
word by word, at last as text.

Documents are read twice (count, probe) and never shuffled. The index of windows, in blocks of at most block_windows, goes to
the tasks; a benchmark of more than one block is probed block after block in one pass over the documents, so any size is done
whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helix.llm import words as W
from helix.llm.shared import written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a shingle; shorter windows have one of all their words.
SHINGLE = 4


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    raw = b"" if text is None else text.encode() if isinstance(text, str) else bytes(text)
    return WORD.findall(raw.lower())


def item_windows(benchmark: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """benchmark -> its distinct windows: words (joined by spaces), n (their number), items (ids as sorted strings). A null id is an empty one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = [], []
            for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ws = words_of(t)
                for k in range(max(1, len(ws) - window + 1) if ws else 0):
                    ids.append(i)
                    found.append(b" ".join(ws[k : k + window]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], ["id", "words"])

    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(W.releasing(cut), "id string, words string").groupBy("words").agg(F.array_sort(F.collect_set("id")).alias("items"))


@dataclass
class Block:
    """Windows as arrays. key: their shingles, by which they are probed, in order; at: its offset in the window."""

    key: np.ndarray
    at: np.ndarray
    length: np.ndarray
    hashed: np.ndarray  # the words' hashes, a row for each window
    words: list[list[bytes]]
    items: list[list[str]]

    @staticmethod
    def of(rows: Sequence, counts: dict[int, int], window: int) -> Block:
        """The rarest shingle is the key; of equally rare ones the first."""
        texts = [r["words"].encode().split(b" ") for r in rows]
        hashed = np.zeros((len(rows), window), W.U)
        key, at = np.zeros(len(rows), W.U), np.zeros(len(rows), np.int64)
        for i, ws in enumerate(texts):
            data = np.frombuffer(b" ".join(ws), np.uint8)
            starts, ends, _ = W.spans(data, np.array([0, len(data)]), W.ALNUM)
            h = hashed[i, : len(ws)] = W.hashes(data, starts, ends)
            s = W.combined(h, min(SHINGLE, len(ws)))
            at[i] = min(range(len(s)), key=lambda j: counts.get(int(s[j]), 0))
            key[i] = s[at[i]]
        order = np.argsort(key, kind="stable")
        return Block(key[order], at[order], np.array([len(w) for w in texts], np.int64)[order], hashed[order], [texts[i] for i in order], [list(rows[i]["items"]) for i in order])


def _sieve(keys: np.ndarray) -> np.ndarray:
    """A bit for each of 2^20 values of a hash's low end: a cheap test before the search."""
    bits = np.zeros(1 << 20, bool)
    bits[(keys & W.U((1 << 20) - 1)).astype(np.int64)] = True
    return bits


def _members(h: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in h a key stands, and which."""
    at = np.flatnonzero(bits[(h & W.U((1 << 20) - 1)).astype(np.int64)])
    place = np.searchsorted(keys, h[at])
    ok = keys[np.minimum(place, len(keys) - 1)] == h[at] if len(keys) else np.zeros(len(at), bool)
    return at[ok], place[ok]


def shingle_counts(docs: DataFrame, text: str, keys: np.ndarray, sizes: Sequence[int]) -> DataFrame:
    """How often each of the keys (sorted hashes of shingles) stands in the documents: key, n. Each task sums before the shuffle."""
    bits = _sieve(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        for b in batches:
            for _, data, offsets in W.chunks(b.column(0)):
                starts, ends, rows = W.spans(data, offsets, W.ALNUM)
                h = W.hashes(data, starts, ends)
                for n in sizes:
                    at, _ = W.runs(rows, n)
                    _, place = _members(W.combined(h, n)[at], keys, bits)
                    total += np.bincount(place, minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[some])], ["key", "n"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(W.releasing(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _hits(h: np.ndarray, rows: np.ndarray, block: Block, bits: np.ndarray, step: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places where a window of the block stands by its words' hashes: rows of the chunk, first words, windows."""
    for n in range(1, SHINGLE + 1):
        mine = block.length == n if n < SHINGLE else block.length >= n
        if not mine.any():
            continue
        at, row = W.runs(rows, n)
        s = W.combined(h, n)[at]
        found, _ = _members(s, block.key, bits)
        lo, hi = np.searchsorted(block.key, s[found]), np.searchsorted(block.key, s[found], "right")
        for i in range(0, len(found), step):
            part, a, b = found[i : i + step], lo[i : i + step], hi[i : i + step]
            times = b - a
            where = np.repeat(part, times)
            window = np.repeat(a, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            first = at[where] - block.at[window]
            r = row[where]
            fits = mine[window] & (first >= rows[r]) & (first + block.length[window] <= rows[r + 1])
            first, window, r = first[fits], window[fits], r[fits]
            same = np.ones(len(first), bool)
            for k in range(block.hashed.shape[1]):
                live = same & (k < block.length[window])
                same[live] = h[first[live] + k] == block.hashed[window[live], k]
            yield r[same], first[same], window[same]


def probe(docs: DataFrame, text: str, carry: Sequence[str], block: Block, more: bool) -> DataFrame:
    """docs with what the block's windows hit. more: docs has been probed with another block, whose spans and items are added to."""
    bits = _sieve(block.key)
    kept = [f for f in docs.schema.fields if f.name in carry]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            n_words, spans, items = np.zeros(n, np.int64), [set() for _ in range(n)], [set() for _ in range(n)]
            if more:
                spans, items = [set(x) for x in b["spans"].to_pylist()], [set(x) for x in b["items"].to_pylist()]
            for base, data, offsets in W.chunks(b["text"]):
                starts, ends, rows = W.spans(data, offsets, W.ALNUM)
                n_words[base : base + len(rows) - 1] = np.diff(rows)
                h = W.hashes(data, starts, ends)
                read = (-1, [])
                for r, first, window in _hits(h, rows, block, bits):
                    for i, f, w in zip(r.tolist(), first.tolist(), window.tolist(), strict=True):
                        if read[0] != i:
                            read = (i, words_of(data[offsets[i] : offsets[i + 1]].tobytes()))
                        k, size = f - int(rows[i]), len(block.words[w])
                        if read[1][k : k + size] == block.words[w]:
                            spans[base + i].add(k << 32 | size)
                            items[base + i].update(block.items[w])
            yield pa.RecordBatch.from_arrays(
                [*(b[f.name] for f in kept), b["text"], pa.array(n_words), pa.array([sorted(x) for x in spans], pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], [f.name for f in schema.fields]
            )

    return docs.mapInArrow(W.releasing(run), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, share: int = 20, text: str = "text", carry: Sequence[str] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", block_windows: int = 200_000) -> DataFrame:
    """docs (text and the columns to carry; others are left alone) -> carry, n_words, spans (array of start and length in words, not merged),
    items (sorted strings), n_hit (words inside any span), contaminated (n_hit > 0 and share * n_hit >= n_words): a row for each row.

    Null and empty texts have no words and are clean; items without words hit nothing; items of the same words all count. Repeated rows each get their
    result. Without documents or items nothing is hit. Carried columns must not be called text, n_words, spans, items, n_hit or contaminated:
    put a row in a struct to carry any.
    """
    windows = written(item_windows(benchmark, window, item_id, item_text), "windows")
    n_blocks = max(1, -(-windows.count() // block_windows))
    part = F.pmod(F.xxhash64("words"), F.lit(n_blocks))
    read = docs.select(*carry, F.col(text).cast("string").alias("text"))
    out = read
    for i in range(n_blocks):
        rows = windows.filter(part == i).collect()  # a block, so bounded
        hashed = []
        for r in rows:
            data = np.frombuffer(r["words"].encode(), np.uint8)
            starts, ends, _ = W.spans(data, np.array([0, len(data)]), W.ALNUM)
            hashed.append(W.combined(W.hashes(data, starts, ends), min(SHINGLE, len(starts))))
        sizes = sorted({min(SHINGLE, r["words"].count(" ") + 1) for r in rows})
        keys = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, W.U)
        counts = shingle_counts(read, "text", keys, sizes).collect() if len(keys) else []  # at most a row for each key
        by_key = {int(np.int64(r["key"]).view(W.U)): r["n"] for r in counts}
        out = probe(out, "text", carry, Block.of(rows, by_key, window), i > 0)
    split = F.transform("spans", lambda s: F.struct(F.shiftright(s, 32).alias("start"), s.bitwiseAND(F.lit(0xFFFFFFFF)).alias("length")))
    # spans are short and may overlap by all but one word: the part of each that no earlier one covers is added up, in order of their starts
    reach = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["start"] + s["length"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["start"] + s["length"]).alias("end")),
    )
    out = out.select(*carry, "n_words", split.alias("spans"), "items").withColumn("n_hit", reach["n"])
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
