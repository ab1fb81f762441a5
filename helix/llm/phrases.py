"""Phrases that stand together more often than their parts suggest, from streams of counts in prefix and suffix order.

As in the estimation of language models outside of memory, each place of the texts gives one record: the phrase of the longest order that begins there. The
records are dealt out once by their first two words and sorted, so that all phrases with the same beginning lie together, and one pass over that
stream counts every order as sums over runs of records. Counts of all orders then are a stream of records (lang, phrase, a): sorted by phrase it has each phrase beside what
it begins with, sorted by its end beside what it ends with, and sort-merge joins of the streams, in lockstep and without tables of hashes, give
left and right counts and those of phrases that are longer by a word. Spark sorts and merges, spills what doesn't fit and splits frequent keys.

A phrase is no more frequent than its pairs of words, so records end before a rare pair, and most texts are made of these. A first pass counts pairs by 40 bits of
a hash, and those that may be frequent are told by a bit set of fixed size; both let too many through at worst, and no count that is returned depends on
them. The first two words may be a pair that a good part of all records begins with: pairs of two words that each are a thousandth of
all (so a thousand words at most) are dealt out by the words up to the first that is rarer, and counts of what is cut so are added up in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helix.llm import words as W
from helix.llm.shared import Scratch, written
from helix.llm.sieve import Sieve

#: Bytes that end a piece, and bytes of words.
BREAKS = np.array([b in b".,;:!?\n\v\f\r" for b in range(256)])
INSIDE = np.array([b not in b" \t.,;:!?\n\v\f\r" for b in range(256)])
#: A record's second hash, which tells apart those that share the first.
OTHER = W.U(0xD6E8FEB86659FD93)
COUNTS = "lang string, phrase string, n long"


def _lang_seeds(langs: list[str]) -> np.ndarray:
    """A 64-bit value of each language."""
    data = np.frombuffer("".join(langs).encode(), np.uint8)
    ends = np.cumsum([len(x.encode()) for x in langs])
    return W.hashes(data, np.r_[0, ends[:-1]], ends, np.arange(256)) if langs else np.zeros(0, W.U)


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Words from rows of spans (phrases x words) as strings, with a space between words."""
    rows, n = starts.shape
    size = ends - starts + 1  # with the space
    total = size.sum(axis=1) - 1
    flat, first = size.ravel(), starts.ravel()
    base = np.cumsum(flat) - flat
    at = np.arange(flat.sum()) - np.repeat(base - first, flat)
    at[base + flat - 1] = len(data)
    text = np.append(data, np.uint8(32))[at]
    keep = np.ones(len(text), bool)
    keep[(base + flat - 1).reshape(rows, n)[:, -1]] = False
    cuts = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(text[keep]))).cast(pa.string())


def _distinct(key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value first stands, and how often it does: of pairs of hashes, should the first ones not tell all apart."""
    _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if (other == other[first][inverse]).all():
        return first, n
    pairs = np.stack([key, other], axis=1)
    _, first, n = np.unique(pairs, axis=0, return_index=True, return_counts=True)
    return first, n


#: A word of one in so many may make a frequent pair; records that begin with two such words are dealt out to so many more keys.
SHARE, SALTS = 1000, 61
#: Orders, from 2 on, of which frequent phrases are told beforehand. More of them make fewer records and one more pass each.
ORDERS = (2,)


def _tokens(batch: pa.RecordBatch, run_bytes: int):
    """For runs of rows of a batch (lang, text): bytes in lower case, starts and ends of words, which words have the next one in their piece, the language (a number) of
    each word."""
    lang_of = batch["lang"].to_numpy(zero_copy_only=False)
    for first, data, offsets in W.chunks(batch["text"], run_bytes):
        starts, ends, rows = W.spans(data, offsets, INSIDE)
        if len(starts):
            data = W.LOWER[data]
            row = np.arange(len(offsets) - 1).repeat(np.diff(rows))
            broken = np.concatenate([[0], np.cumsum(BREAKS[data], dtype=np.int32)])
            joined = np.append((row[1:] == row[:-1]) & (broken[starts[1:]] == broken[ends[:-1]]), False)
            yield data, starts, ends, joined, lang_of[first : first + len(offsets) - 1].repeat(np.diff(rows))


def _numbered(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.Array, np.ndarray]:
    """A batch with its languages as numbers, the languages, and a 64-bit value of each."""
    names = batch["lang"].dictionary_encode()
    return pa.RecordBatch.from_arrays([names.indices, batch["text"]], ["lang", "text"]), names.dictionary, _lang_seeds(names.dictionary.to_pylist())


def word_counts(texts: DataFrame, run_bytes: int = 1 << 20) -> DataFrame:
    """texts (lang, text) -> lang, phrase, n: how often each word stands in some run of the texts; the row with a null phrase is of all words of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch, names, seeds = _numbered(batch)
            for data, starts, ends, _, lang in _tokens(batch, run_bytes):
                h = W.hashes(data, starts, ends)
                first, count = _distinct(h ^ seeds[lang], W.mixed(h + OTHER) ^ seeds[lang])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[first])), _gather(data, starts[first][:, None], ends[first][:, None]), pa.array(count)], ["lang", "phrase", "n"])
                of = np.bincount(lang, minlength=len(names))
                yield pa.RecordBatch.from_arrays([names, pa.nulls(len(of), pa.string()), pa.array(of)], ["lang", "phrase", "n"])

    return texts.mapInArrow(W.releasing(run), COUNTS)


def _keys(h: np.ndarray, seeds: np.ndarray, lang: np.ndarray, n: int) -> np.ndarray:
    """40 bits for each n words in a row: len(h) - n + 1."""
    return W.mixed(W.combined(h, n) ^ seeds[lang[: max(len(h) - n + 1, 0)]]) >> W.U(24)


def _swapped(keys: np.ndarray) -> np.ndarray:
    """Keys high byte first."""
    return (keys << W.U(24)).byteswap()


def gram_counts(texts: DataFrame, n: int, less: Sieve, run_bytes: int = 1 << 20, held_grams: int = 1 << 22) -> DataFrame:
    """texts (lang, text) -> h, n: how often phrases of n words (2 and more) stand in some run of the texts, by their keys; only those whose first and last n - 1 words
    are in the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            h, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            # in order and high byte first, so that rows of a shuffle's block share what they begin with and compress
            return pa.RecordBatch.from_arrays([pa.array(_swapped(h).view(np.int64)), pa.array(times.astype(np.int32))], ["h", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            batch, _, seeds = _numbered(batch)
            for data, starts, ends, joined, lang in _tokens(batch, run_bytes):
                if len(starts) < n:
                    continue
                h = W.hashes(data, starts, ends)
                may = less.holds(W.mixed(h ^ seeds[lang]) if n == 2 else _swapped(_keys(h, seeds, lang, n - 1)))
                ok = may[:-1] & may[1:]
                for k in range(n - 1):
                    ok &= joined[k : k + len(ok)]
                held.append(_keys(h, seeds, lang, n)[ok])
                if sum(map(len, held)) >= held_grams:
                    yield out()
        if held:
            yield out()

    return texts.mapInArrow(W.releasing(run), "h long, n int")


def _added(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]) -> pa.RecordBatch:
    """Rows of several runs, with their keys and those of their pairs: equal ones as one, their n added up, and pairs together, so that a shuffle's blocks compress."""
    key, other, pair = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2))
    rows = pa.Table.from_batches([x[3] for x in held]).combine_chunks().to_batches()[0]
    held.clear()
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    if not (other == other[first][inverse]).all():
        _, first, inverse = np.unique(np.stack([key, other], axis=1), axis=0, return_index=True, return_inverse=True)
    n = np.bincount(inverse.ravel(), rows["n"].to_numpy()).astype(np.int64)
    order = np.argsort(pair[first], kind="stable")
    first, n = first[order], n[order]
    return rows.take(pa.array(first)).set_column(rows.schema.get_field_index("n"), "n", pa.array(n))


def records(texts: DataFrame, longest: int, sieves: dict[int, Sieve], hot: np.ndarray, run_bytes: int = 1 << 20, held_rows: int = 3 << 19) -> DataFrame:
    """texts (lang, text) -> lang, pair, w3 .. w<longest>, salt, n: for each place of a run of the texts where two words begin in a piece that may be a frequent pair, these and
    those that follow, as long as all phrases of the sieves' orders in it may be frequent (null from there); equal ones of a task are one, as far as held_rows go. salt: 0, but for records that begin with d hot words,
    two or more: then 1 + 8 * (a hash of d + 1 words) + d."""
    more = [f"w{i}" for i in range(3, longest + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            batch, names, seeds = _numbered(batch)
            for data, starts, ends, joined, lang in _tokens(batch, run_bytes):
                h = W.hashes(data, starts, ends)
                often = np.isin(W.mixed(h ^ seeds[lang]), hot)
                size, grows, held_there = np.ones(len(h), np.int8), np.ones(len(h), bool), {}  # words of a place's record
                for n in range(2, longest + 1):
                    may = np.zeros(len(h), bool)
                    if len(h) >= n:
                        order = max(k for k in sieves if k <= n)  # what begins earlier has been looked at for the orders before
                        if order not in held_there:
                            held_there[order] = sieves[order].holds(_swapped(_keys(h, seeds, lang, order)))
                        may[: len(h) - n + 1] = held_there[order][n - order :] & joined[n - 2 : len(h) - 1]
                    grows &= may
                    size[grows] = n
                at = np.flatnonzero(size > 1)
                if not len(at):
                    continue
                size = size[at]
                key, other = np.zeros(len(at), W.U), np.zeros(len(at), W.U)
                for n in range(2, longest + 1):
                    some = size == n
                    key[some] = W.combined(h, n)[at[some]] if n <= len(h) else 0
                    other[some] = W.combined(h ^ OTHER, n)[at[some]] if n <= len(h) else 0
                keyed, others = W.mixed(key ^ seeds[lang[at]]), W.mixed(other ^ seeds[lang[at]])
                first, count = _distinct(keyed, others)
                begins = np.zeros(len(first), np.int64)  # hot words
                for n in range(longest, 0, -1):
                    follows = at[first] + n - 1
                    begins = np.where((size[first] >= n) & often[np.minimum(follows, len(h) - 1)], begins + 1, 0)
                salt = np.zeros(len(first), np.int64)
                for n in range(2, longest + 1):
                    some = np.flatnonzero((begins > 1) & (np.minimum(begins + 1, size[first]) == n))
                    if len(some):
                        salt[some] = 1 + 8 * (W.combined(h, n)[at[first[some]]] % W.U(SALTS)).astype(np.int64) + begins[some]
                at, size = at[first], size[first]
                columns = [names.take(pa.array(lang[at])), _gather(data, starts[at[:, None] + np.arange(2)], ends[at[:, None] + np.arange(2)])]
                for n in range(3, longest + 1):
                    has = size >= n
                    words = _gather(data, starts[at[has] + n - 1][:, None], ends[at[has] + n - 1][:, None])
                    columns.append(words.take(pa.array(np.cumsum(has) - 1, mask=~has)))
                rows = pa.RecordBatch.from_arrays([*columns, pa.array(salt.astype(np.int32)), pa.array(count)], ["lang", "pair", *more, "salt", "n"])
                held.append((keyed[first], others[first], W.combined(h, 2)[at], rows))
                if sum(len(x[0]) for x in held) >= held_rows:
                    yield _added(held)
        if held:
            yield _added(held)

    schema = ", ".join(f"{c} string" for c in ["lang", "pair", *more])
    return texts.mapInArrow(W.releasing(run), f"{schema}, salt int, n long")


def run_counts(stream: DataFrame, longest: int, least: int) -> DataFrame:
    """stream: records(), dealt out by lang, pair and salt and sorted by these and the further words -> lang, phrase, m, whole, a: how often each phrase of m words (2 and
    more) begins a record, if least times or not counted as a whole here (whole is false)."""
    words = ["pair", *(f"w{i}" for i in range(3, longest + 1))]
    fields = ["lang", "salt", *words, "n"]

    def emitted(rows: pa.RecordBatch, at: np.ndarray, a: np.ndarray, m: int) -> pa.RecordBatch:
        salt = rows["salt"].to_numpy()[at]
        whole = (salt == 0) | ((salt - 1) % 8 < m)
        ok = (a >= least) | ~whole
        if m > 2:
            ok &= pc.not_equal(rows[f"w{m}"], "").to_numpy(zero_copy_only=False)[at]
        some = rows.take(pa.array(at[ok]))
        phrase = pc.binary_join_element_wise(*(some[w] for w in words[: m - 1]), " ")
        return pa.RecordBatch.from_arrays([some["lang"], phrase, pa.array(np.full(ok.sum(), m, np.int32)), pa.array(whole[ok]), pa.array(a[ok])], ["lang", "phrase", "m", "whole", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(longest + 1, np.int64)  # the row before, and what its runs have so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.RecordBatch.from_arrays([pc.fill_null(batch[c], "") if c in words else batch[c] for c in fields], fields)
            if last is not None:
                rows = pa.Table.from_batches([last, rows]).combine_chunks().to_batches()[0]
            n = rows["n"].to_numpy()
            before = 0 if last is None else 1  # the row before counts in held
            total = np.concatenate([[0], np.cumsum(np.where(np.arange(len(n)) < before, 0, n))])
            new = np.zeros(len(n), bool)
            new[0] = True
            for m, columns in enumerate([["lang", "salt", "pair"], *([w] for w in words[1:])], 2):
                for c in columns:
                    new[1:] |= pc.not_equal(rows[c].slice(1), rows[c].slice(0, len(n) - 1)).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(new)
                a = np.diff(np.append(total[starts], total[-1]))
                a[0] += held[m]
                held[m] = a[-1]
                if len(starts) > 1:
                    yield emitted(rows, starts[:-1], a[:-1], m)
            last = rows.slice(len(n) - 1)
        if last is not None:
            for m in range(2, longest + 1):
                yield emitted(last, np.zeros(1, np.int64), held[m : m + 1], m)

    return stream.select(*fields).mapInArrow(W.releasing(run), "lang string, phrase string, m int, whole boolean, a long")


def phrase_counts(texts: DataFrame, longest: int, least: int, words: Sieve, hot: np.ndarray, scratch: Scratch) -> DataFrame:
    """texts (lang, text) -> lang, phrase, m, a: the phrases of 2 to longest words that stand least times."""
    keys = ("pair", "lang", "salt")
    sieves, less = {}, words
    for n in ORDERS:
        # most stand once in a task: no aggregate before the shuffle
        frequent = gram_counts(texts, n, less).repartition("h").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        sieves[n] = less = Sieve(frequent.select("h"))
    stream = records(texts, longest, sieves, hot).repartition(*keys).sortWithinPartitions(*keys, *(f"w{i}" for i in range(3, longest + 1)))
    found = scratch.written(run_counts(stream, longest, least), "runs")
    added = found.filter("NOT whole").groupBy("lang", "phrase", "m").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return found.filter("whole").select("lang", "phrase", "m", "a").unionByName(added)


def _hashes(words: DataFrame) -> DataFrame:
    """words (lang, phrase: a word) -> h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names = batch["lang"].dictionary_encode()
                seeds, lang_of = _lang_seeds(names.dictionary.to_pylist()), names.indices.to_numpy(zero_copy_only=False)
                for first, data, offsets in W.chunks(batch["phrase"]):
                    h = W.hashes(data, offsets[:-1], offsets[1:])
                    yield pa.RecordBatch.from_arrays([pa.array(W.mixed(h ^ seeds[lang_of[first : first + len(h)]]).view(np.int64))], ["h"])

    return words.select("lang", "phrase").mapInArrow(W.releasing(run), "h long")


def mine(docs: DataFrame, *, least: int = 30, longest: int = 4, top: int = 2000, covered: int = 80, scale: int = 2_000_000, lang: str = "lang", text: str = "text") -> DataFrame:
    """docs (lang, text; others are left alone) -> lang, rank, phrase, a, l, r, n, score: each language's first phrases.

    Texts are cut at . , ; : ! ? and line ends into pieces, those at spaces and tabs into words, A-Z in lower case. A candidate is a phrase of 2 to longest words
    that stands a >= least times; of its cuts into two parts that stand l and r times the one of the lowest floor(scale * a / (l + r)) counts, the first of equal ones.
    A candidate goes if a longer one that contains it stands at least covered percent as often. Order: score, a (both descending), phrase (by bytes). n: all
    words of the language.

    A null text is as an empty one, a null language is und; a table without candidates gives no rows. Repeated rows count each; texts of any length are read whole.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    scratch = Scratch(docs.sparkSession)
    every = word_counts(texts).groupBy("lang", "phrase").agg(F.sum("n").alias("a")).filter((F.col("a") >= least) | F.col("phrase").isNull())
    every = scratch.written(every, "words")
    total, words = every.filter("phrase IS NULL").select("lang", F.col("a").alias("n")), every.filter("phrase IS NOT NULL")
    all_words = total.agg(F.sum("n")).first()[0] or 0
    hot = _hashes(words.filter(F.col("a") * SHARE >= all_words)).toArrow()["h"].to_numpy().view(W.U)  # SHARE words at most
    counts = words.withColumn("m", F.lit(1)).unionByName(phrase_counts(texts, longest, least, Sieve(_hashes(words)), hot, scratch))
    counts = scratch.written(counts, "counts")
    found = written(_ranked(counts, total, top, covered, scale), "phrases")
    scratch.drop()
    return found


def _ranked(counts: DataFrame, total: DataFrame, top: int, covered: int, scale: int) -> DataFrame:
    """counts (lang, phrase, m, a) of all frequent phrases of one word and more, total (lang, n) -> the result of mine()."""
    cut = counts.filter("m > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cut = cut.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring_index(phrase, ' ', k - m)")})
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(n)).hint("merge")
    both = cut.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    wide = "cast({} AS decimal(19, 0))"
    score = F.expr(f"({wide.format(scale)} * {wide.format('a')}) div ({wide.format('l')} + {wide.format('r')})")
    best = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x"))
    # what a phrase is the beginning or the end of: one more word is enough, as a phrase of two more stands no more often than one of one more within it
    longer = counts.filter("m > 2")
    ends = F.explode(F.array(F.expr("substring_index(phrase, ' ', m - 1)"), F.expr("substring_index(phrase, ' ', 1 - m)")))
    longer = longer.select("lang", ends.alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    alone = best.join(longer.hint("merge"), ["lang", "phrase"], "left").filter(F.expr(f"b IS NULL OR {wide.format('b')} * 100 < {wide.format('a')} * {covered}"))
    order = Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))
