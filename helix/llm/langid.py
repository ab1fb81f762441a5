"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams, learned by follow-the-regularised-leader
(proximal, with L1 and L2 penalties), then calibrated by a temperature.

Document frequencies are counted over all labelled documents, each task summing before the shuffle. The weights are learned in one
task from a sample whose size is a parameter; a sample's row is its sparse counts, so text isn't moved. Prediction adds up weights
along the whole text, in runs of about a megabyte, so a document's length doesn't matter.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helix.llm import words as W

BITS = 16
ORDERS = (1, 2, 3)
#: Term frequencies are shares of a text's n-grams, so small; this brings their sums to the order of one.
SCALE = 32.0
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case if it is a letter, else a space; and whether it is a letter."""
    if not _TABLES:
        points = range(sys.maxunicode + 1)
        _TABLES["letter"] = np.array([chr(c).isalpha() for c in points])
        low = np.full(len(points), 32, np.uint32)
        for c in np.flatnonzero(_TABLES["letter"]).tolist():
            x = chr(c).lower()
            low[c] = ord(x[0])
        _TABLES["low"] = low
    return _TABLES["low"], _TABLES["letter"]


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed n-grams of a run of texts: buckets, the row of each, and whether each row has a letter."""
    low, letter = _tables()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    has = np.bincount(row, letter[points], len(at) - 1) > 0
    c = low[points] * np.uint32(0x9E3779B1)
    found, rows = [], []
    for n in ORDERS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint32)
        for i in range(n):
            h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        own = row[: len(h)] == row[n - 1 :]
        found.append((h >> np.uint32(32 - BITS))[own])
        rows.append(row[: len(h)][own])
    return (np.concatenate(found), np.concatenate(rows), has) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int32), has)


def by_row(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each row and how often each stands there."""
    b, row, _ = buckets(data, offsets)
    order = np.argsort(row, kind="stable")
    b, cuts = b[order], np.searchsorted(row[order], np.arange(len(offsets)))
    for i in range(len(offsets) - 1):
        yield np.unique(b[cuts[i] : cuts[i + 1]], return_counts=True)


def document_frequencies(labelled: DataFrame) -> tuple[np.ndarray, int]:
    """labelled (text) -> in how many documents each bucket stands, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for _, data, offsets in W.chunks(batch["text"]):
                b, row, _ = buckets(data, offsets)
                n += len(offsets) - 1
                order = np.argsort(row, kind="stable")
                b, cuts = b[order], np.searchsorted(row[order], np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    seen = np.zeros(1 << BITS, bool)
                    seen[b[cuts[i] : cuts[i + 1]]] = True
                    total += seen
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["bucket", "n"])

    df, n = np.zeros(1 << BITS), 0
    for r in labelled.select("text").mapInArrow(W.releasing(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket at most
        if r["bucket"] < 0:
            n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, n


@dataclass
class Model:
    """weights: a row of scores for each bucket, times its inverse document frequency; bias: of each language."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], k: int, *, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """Weights (a row for each bucket, and a last one for the bias, which has no penalty) after some passes over rows of (buckets, values, class)."""
    z, n = np.zeros(((1 << BITS) + 1, k)), np.zeros(((1 << BITS) + 1, k))

    def weights(i: np.ndarray | slice) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    for epoch in range(epochs):
        for j in np.random.default_rng(epoch).permutation(len(rows)):
            b, x, y = rows[j]
            w, bias = weights(b), -z[-1] * alpha / (beta + np.sqrt(n[-1]))
            p = softmax(x @ w + bias)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[b] + g * g) - np.sqrt(n[b])) / alpha
            z[b] += g - sigma * w
            n[b] += g * g
            z[-1] += p - (np.sqrt(n[-1] + p * p) - np.sqrt(n[-1])) / alpha * bias
            n[-1] += p * p
    out = weights(slice(None))
    out[-1] = -z[-1] * alpha / (beta + np.sqrt(n[-1]))
    return out


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """That which gives the least log loss: a search by golden section over its logarithm, bounded as classes that are told apart without error have no least."""

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(scores / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()

    a, b, g = -1.4, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(labelled: DataFrame, *, per_language: int = 800, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.001, l2: float = 0.001, epochs: int = 3) -> Model | None:
    """labelled (text, lang) -> a model; null if no row has a language.

    Of each language about per_language rows, chosen by a hash of row and label, are learned from; a fifth of them sets the temperature. Frequencies are
    those of all rows. Rows with a null language are left out; null texts have no n-grams.
    """
    rows = labelled.filter("lang IS NOT NULL").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), *(["doc_id"] if "doc_id" in labelled.columns else []))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    draw = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "lang"]), F.lit(1 << 30))
    most = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(int((1 << 30) * min(1.0, per_language / sizes[lang]))))])
    chosen = rows.withColumn("draw", draw).filter(F.col("draw") < most[F.col("lang")]).select("text", "lang", "draw")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, offsets in W.chunks(batch["text"]):
                got = list(by_row(data, offsets))
                some = batch.slice(base, len(got))
                yield pa.RecordBatch.from_arrays([some["lang"], some["draw"], pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1].astype(np.int32) for g in got], pa.list_(pa.int32()))], ["lang", "draw", "bucket", "n"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, held = {x: i for i, x in enumerate(languages)}, [], []
        got = [(r, np.asarray(b, np.int64), np.asarray(c, float), lang) for batch in batches for r, b, c, lang in zip(batch["draw"].to_pylist(), batch["bucket"].to_pylist(), batch["n"].to_pylist(), batch["lang"].to_pylist(), strict=True)]
        for r, b, c, lang in sorted(got, key=lambda x: (x[0], x[3], len(x[1]), x[1].tobytes())):
            row = (b, c / max(1.0, c.sum()) * idf[b] * SCALE, at[lang])
            (held if r % 5 == 0 and len(rows) > 20 else rows).append(row)
        w = ftrl(rows, len(languages), alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
        t = temperature(np.array([x @ w[b] + w[-1] for b, x, _ in held]), np.array([y for *_, y in held])) if len(held) >= 20 else 1.0
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()]), pa.array([t])], ["weights", "temperature"])

    one = chosen.mapInArrow(W.releasing(sparse), "lang string, draw long, bucket array<int>, n array<int>").repartition(1).mapInArrow(W.releasing(learn), "weights binary, temperature double").collect()[0]
    w = np.frombuffer(one["weights"], "<f8").reshape(-1, len(languages))
    return Model(languages, (w[:-1] * (idf * SCALE)[:, None]).astype(np.float32), w[-1], one["temperature"])


def predict(docs: DataFrame, model: Model | None, *, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """docs (text and the columns to carry) -> carry, lang_pred, score: a row for each row, repeated ones too.

    A text that is null or has no letters, and any text without a model, is "und" with score 0. Of equally likely languages the first by name is taken.
    The carried columns must not be called lang_pred or score: put a row in a struct to carry any.
    """
    read = docs.select(*carry, F.col(text).cast("string").alias("_text"))
    kept = read.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for base, data, offsets in W.chunks(batch["_text"]) if model else ():
                b, row, has = buckets(data, offsets)
                n = np.bincount(row, minlength=len(has))
                total = np.stack([np.bincount(row, model.weights[:, k][b], len(has)) for k in range(len(model.languages))], axis=1)
                p = softmax((total / np.maximum(n, 1)[:, None] + model.bias) / model.temperature)
                best = p.argmax(axis=1)
                names[base : base + len(has)] = np.where(has, np.array(model.languages, object)[best], "und")
                scores[base : base + len(has)] = np.where(has, p[np.arange(len(p)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), pa.array(names, pa.string()), pa.array(scores)], [*(f.name for f in kept), "lang_pred", "score"])

    return read.mapInArrow(W.releasing(run), T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def crc_part(doc_id: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; 0 for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))
