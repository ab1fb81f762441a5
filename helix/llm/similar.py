"""Classes of similar texts: banded sketches nominate, exact similarity decides, union-find joins. Used for documents and for lines.

In each bucket of a band, members meet one of them, the pivot: that which shares most buckets with others. So a bucket of thousands
gives as many pairs, not their square. A pair whose sketches are not far apart is measured on the texts: how many elements both have,
and the difference, which is what only one of them has. Every other pair of a bucket is then decided without its texts:

- Of two members near a pivot the common elements follow exactly from their differences to it: a pivot of n elements, of which they
  lack x and y, and s elements that are in both differences give n - x - y + s. Differences meet in blocks of bounded size, and a
  block hands on a spanning forest of its links, at most a row for each member. Groups of several blocks first look within blocks;
  once components are formed, only members outside of the group's largest component look into the other blocks.
- A member far from the pivot can be similar only to members that are not close to it (distances obey the triangle inequality).
  Those of a bucket form a bucket for the next level, which has up to 64 times as many pivots, none of them seen before.
- A bucket of two, as most are, is that pair and nothing else.

No link between members of a bucket is left out, but for the chance that sketches err by many standard deviations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helix.llm import words as W
from helix.llm.components import components
from helix.llm.shared import Scratch
from helix.llm.sieve import Sieve

Shingler = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Sketches under FAR are of pairs that are not measured; over CLOSE, of pairs that are surely similar to a good degree. Members and elements of a block.
FAR, CLOSE, BLOCK, ELEMENTS = 0.35, 0.8, 700, 500_000
#: Members of a bucket whose marks are all compared.
MARKED = 16
LINKS = "u long, v long"
#: For rounding: both sides are integers when multiplied by what makes the threshold one.
SLACK = 1e-9


def matrix(sketches: pa.Array) -> np.ndarray:
    """The coordinates of sketches without nulls, a row for each."""
    offsets = np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset : sketches.offset + len(sketches) + 1]
    return np.frombuffer(sketches.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(sketches), -1)


def band_hashes(sketches: pa.Array, width: int) -> np.ndarray:
    """A hash of each band of width coordinates of sketches without nulls, which also tells bands apart: a row for each sketch."""
    coordinates = matrix(sketches)
    n, k = coordinates.shape[0], coordinates.shape[1] // width
    h = np.zeros((n, k), W.U) + np.arange(1, k + 1, dtype=W.U)
    for i in range(width):
        h = W.mixed(h * W.U(256) + coordinates[:, i : width * k : width])
    return h


def marks(sketches: pa.Array) -> np.ndarray:
    """A bit of each of 64 coordinates (of all, if there are fewer) of sketches without nulls."""
    x = matrix(sketches)
    bits = np.zeros((len(x), 64), np.uint8)
    some = x[:, :: max(1, x.shape[1] // 64)][:, :64] & 1
    bits[:, : some.shape[1]] = some
    return np.packbits(bits, axis=1).view(np.uint64)[:, 0]


def most_unlike(threshold: float) -> int:
    """So many bits of the marks of two similar members differ at most, but for once in 100,000 times."""
    p = (1 - threshold) / 2
    tail = np.cumsum([math.comb(64, i) * p**i * (1 - p) ** (64 - i) for i in range(64, -1, -1)])[::-1]
    return int(np.flatnonzero(np.append(tail, 0) < 1e-5)[0]) - 1


def banded(members: DataFrame, width: int, bits: int) -> DataFrame:
    """The bands of members, packed: rows (part, base, bands) for the first bits of their hashes; bands holds four 32-bit numbers for each: the next 32 bits of its hash,
    the member's id less base, the member's marks. A row for each band would be several times the bytes and most of the work."""

    def packed(base: int, ids: np.ndarray, hashes: np.ndarray, marks_: np.ndarray) -> pa.RecordBatch:
        h, offset, mark = hashes.ravel(), np.repeat((ids - base).astype(np.uint32), hashes.shape[1]), np.repeat(marks_, hashes.shape[1])
        part = (h >> W.U(64 - bits)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        entries = np.stack([(h >> W.U(32 - bits)).astype(np.uint32)[order], offset[order], *(x[order] for x in (mark.astype(np.uint32), (mark >> W.U(32)).astype(np.uint32)))], axis=1)
        n = np.bincount(part, minlength=1 << bits)
        some = np.flatnonzero(n)
        cuts = pa.array(np.concatenate([[0], np.cumsum(n[some]) * 16]), pa.int32())
        bands = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, cuts.buffers()[1], pa.py_buffer(entries)])
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), base)), bands], ["part", "base", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            ids, hashes, marks_ = (np.concatenate(x) for x in zip(*held, strict=True))
            for high in np.unique(ids >> 32):
                some = ids >> 32 == high
                yield packed(int(high) << 32, ids[some], hashes[some], marks_[some])

        for b in batches:
            if b.num_rows:
                held.append((b["id"].to_numpy(zero_copy_only=False), band_hashes(b["sketch"], width), marks(b["sketch"])))
                size += held[-1][1].size
                if size >= 1 << 18:
                    yield from flushed()
                    held, size = [], 0
        if held:
            yield from flushed()

    return members.filter("sketch IS NOT NULL").select("id", "sketch").mapInArrow(W.releasing(run), "part int, base long, bands binary")


def shared_bands(members: DataFrame, width: int, threshold: float) -> DataFrame:
    """h, id, n: the members of each bucket of n > 1. Buckets are told by 32 bits and those of the part, of which there are more in a larger table; the few that
    meet by chance are one, which costs time only. Of buckets of up to MARKED, only members stay whose marks are like those of another: most buckets are of
    two members that are not alike."""
    limit = most_unlike(threshold)

    def run(t: pa.Table) -> pa.Table:
        entries = [np.frombuffer(x, np.uint32).reshape(-1, 4) for x in t["bands"].to_pylist()]
        ids = np.concatenate([x[:, 1] + base for x, base in zip(entries, t["base"].to_numpy(), strict=True)])
        h, low, high = (np.concatenate([x[:, i] for x in entries]) for i in (0, 2, 3))
        mark = low.astype(W.U) | high.astype(W.U) << W.U(32)
        order = np.argsort(h, kind="stable")
        h = h[order]
        cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.append(cut, len(h)))
        n = np.repeat(size, size)
        for m in range(2, MARKED + 1):
            at = cut[size == m][:, None] + np.arange(m)
            for first in range(0, len(at), 4096):
                places = at[first : first + 4096]
                x = mark[order[places]]
                like = np.bitwise_count(x[:, :, None] ^ x[:, None, :]) <= limit
                like[:, np.arange(m), np.arange(m)] = False
                alike = like.any(axis=2)
                n[places] = np.where(alike, alike.sum(axis=1)[:, None], 0)
        some = n > 1
        return pa.table({"h": h[some].astype(np.int64) + (t["part"][0].as_py() << 32), "id": ids[order[some]], "n": n[some]})

    bits = min(max(int(members.count() * 24 >> 17).bit_length(), 6), 16)
    return banded(members, width, bits).groupBy("part").applyInArrow(run, "h long, id long, n long")


def buckets(members: DataFrame, width: int, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """h, id, pivot: the members of each bucket that has more than two; a, b: those of the others."""
    shared = scratch.written(shared_bands(members, width, threshold), "shared")
    pairs = shared.filter("n = 2").groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b")
    shared = shared.filter("n > 2")
    ranked = shared.join(shared.groupBy("id").agg(F.sum("n").alias("p")), "id")
    pivots = ranked.groupBy("h").agg(F.max(F.struct("p", (-F.col("id")).alias("i"))).alias("x")).select("h", (-F.col("x.i")).alias("pivot"))
    return scratch.written(shared.select("h", "id").join(pivots, "h"), "buckets"), pairs


def compared(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """pairs (a, b, star) with est, the share of coordinates in which their sketches (id, sketch: a byte for each) agree."""
    s = sketches.select("id", "sketch")
    both = pairs.join(s.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["a"], b["b"], b["star"], pa.array((matrix(b["sa"]) == matrix(b["sb"])).mean(axis=1))], ["a", "b", "star", "est"])

    return both.mapInArrow(W.releasing(run), "a long, b long, star boolean, est double")


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id may be among ids (one column); more may be left, as a join follows."""
    hashed = F.xxhash64("id")
    return rows.filter(Sieve(ids.select(F.xxhash64(ids.columns[0]).alias("h"))).column(hashed))


def measured(pairs: DataFrame, texts: DataFrame, shingles: Shingler, as_set: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """pairs (a, b, star) with inter, na, nb: the elements that the texts (id, text) have in common and have; delta: of a star, those that one has and the other has not."""
    both = pairs.select("a", "b", "star").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, data, offsets in W.chunks(column):
            h, row = shingles(data, offsets)
            out += [as_set(x) for x in np.split(h, np.searchsorted(row, np.arange(1, len(offsets) - 1)))]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                b = batch.slice(first, 64)
                # a pivot's text stands in many rows
                ids, at, which = np.unique(b["a"].to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
                pivots = sets(b["ta"].take(pa.array(at)))
                x, y = [pivots[i] for i in which], sets(b["tb"])
                inter, delta = np.zeros(len(x), np.int64), []
                for i, (p, q, star) in enumerate(zip(x, y, b["star"].to_pylist(), strict=True)):
                    both = np.concatenate([p, q])
                    both.sort(kind="stable")  # two runs: a merge
                    again = both[1:] == both[:-1]
                    inter[i] = np.count_nonzero(again)
                    if star:
                        one = np.ones(len(both), bool)
                        one[1:] &= ~again
                        one[:-1] &= ~again
                        delta.append(both[one].view(np.int64))
                    else:
                        delta.append(both[:0].view(np.int64))
                yield pa.RecordBatch.from_arrays([b["a"], b["b"], b["star"], pa.array(inter), pa.array([len(p) for p in x]), pa.array([len(q) for q in y]), pa.array(delta, pa.list_(pa.int64()))], ["a", "b", "star", "inter", "na", "nb", "delta"])

    return both.mapInArrow(W.releasing(run), "a long, b long, star boolean, inter long, na long, nb long, delta array<long>")


def similar(threshold: float):
    """The condition on what measured() gives."""
    return (F.col("inter") > 0) & (F.col("inter") * (1 + threshold) >= threshold * (F.col("na") + F.col("nb")) - SLACK)


def common(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n x n: how many values each two owners share."""
    share = np.zeros((n, n), np.float32)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    cut = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    size = np.diff(np.append(cut, len(values)))
    two = cut[size == 2]
    np.add.at(share, (owner[two], owner[two + 1]), 1)
    share += share.T
    many = np.flatnonzero(size > 2)
    for first in range(0, len(many), 4096):
        some = many[first : first + 4096]
        x = np.zeros((n, len(some)), np.float32)
        at = np.repeat(cut[some], size[some]) + np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        x[owner[at], np.repeat(np.arange(len(some)), size[some])] = 1
        share += x @ x.T
    return share


def forest(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of stars that connect what the symmetric matrix ok connects."""
    label = np.arange(len(ok))
    while True:
        new = np.minimum(label, np.where(ok, label[None, :], len(ok)).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(ok)))
    return at, label[at]


def block_links(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (a, p, q, side, b, root, linked, na, inter, nb, delta): members b of the block (p, q) of a pivot a -> links (u, v) that connect all similar ones of the
    block that are of two sides, of two roots, and not both linked with the pivot. A side or root of -1 differs from every other."""

    def links(t: pa.Table) -> pa.RecordBatch:
        b, side, root, linked = (t[c].to_numpy() for c in ("b", "side", "root", "linked"))
        na, inter, nb = (t[c].to_numpy().astype(np.float32) for c in ("na", "inter", "nb"))
        lists = pa.concat_arrays(t["delta"].chunks)
        share = common(lists.flatten().to_numpy(), np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy()), len(b))
        lacks = na - inter
        both = na[:, None] - lacks[:, None] - lacks[None, :] + share
        ok = (both > 0) & (both * (1 + threshold) >= threshold * (nb[:, None] + nb[None, :]) - SLACK) & ~(linked[:, None] & linked[None, :])
        for x in (side, root):
            ok &= (x[:, None] != x[None, :]) | (x[:, None] < 0)
        np.fill_diagonal(ok, False)
        u, v = forest(ok)
        return pa.RecordBatch.from_arrays([pa.array(b[u]), pa.array(b[v])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("a", "p", "q")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                now = tuple(key[i])
                if now != last and held:
                    yield links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(i, j - i))
                last = now
        if held:
            yield links(pa.Table.from_batches(held))

    columns = ("a", "p", "q", "side", "b", "root", "linked", "na", "inter", "nb", "delta")
    return rows.select(*columns).repartition("a", "p", "q").sortWithinPartitions("a", "p", "q").mapInArrow(W.releasing(run), LINKS)


def within_blocks(known: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """known: what measured() gives -> the links within each block of a pivot's members, and known of the pivots whose members are in several blocks, with block."""
    known = known.withColumn("linked", similar(threshold))
    sizes = known.groupBy("a").agg(F.count("*").alias("n"), F.sum(F.size("delta")).alias("e"), F.min("linked").alias("all")).filter("n > 1 AND NOT all")
    sizes = sizes.select("a", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("e") / ELEMENTS)).cast("int").alias("blocks"))
    rows = known.join(sizes, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    one = rows.withColumns({"p": F.col("block"), "q": F.col("block"), "side": F.lit(-1), "root": F.lit(-1).cast("long")})
    return block_links(one, threshold), rows.filter("blocks > 1")


def across_blocks(rows: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """rows with block, of pivots that have several -> the links between different blocks of members that are not in the group's largest component and others."""
    rooted = rows.join(roots.withColumnRenamed("id", "b"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    each = rooted.groupBy("a", "root").agg(F.count("*").alias("n"), F.sum(F.size("delta")).alias("e"))
    main = each.groupBy("a").agg(F.max(F.struct("n", "root", "e")).alias("x"), F.sum("n").alias("n"), F.sum("e").alias("e"))
    parts = F.greatest(F.ceil((F.col("n") - F.col("x.n")) / BLOCK), F.ceil((F.col("e") - F.col("x.e")) / ELEMENTS)).cast("int")
    live = rooted.join(main.filter(F.col("n") > F.col("x.n")).select("a", F.col("x.root").alias("main"), parts.alias("parts")), "a")
    minor = live.filter("root <> main").withColumn("p", F.pmod(F.xxhash64("b", F.lit(1)), F.col("parts")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    every = live.withColumn("q", F.col("block")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(1))
    return block_links(minor.unionByName(every), threshold)


def stars_of(shared: DataFrame) -> DataFrame:
    """a, b, star: each member of a bucket with the bucket's pivot."""
    return shared.select(F.col("pivot").alias("a"), F.col("id").alias("b"), F.lit(True).alias("star"))


def similarity_classes(members: DataFrame, texts_of: Callable[[DataFrame, DataFrame], DataFrame], shingles: Shingler, as_set: Callable[[np.ndarray], np.ndarray], kept: Scratch, *, threshold: float, width: int) -> tuple[DataFrame, DataFrame]:
    """members (id, sketch: binary, a byte for each coordinate, null without elements; distinct ids) -> id, root: for every member with a similar one, the
    smallest id of its class; and held, a table in kept: the members that were compared with others, with all their columns. Bands have width coordinates.
    texts_of gives a table of the texts (id, text) of some ids of held; as_set makes a text's shingles a set of distinct elements in order."""
    spark = members.sparkSession
    scratch, first, last = Scratch(spark), Scratch(spark), Scratch(spark)
    shared, pairs = buckets(members, width, threshold, scratch)
    pairs = pairs.withColumn("star", F.lit(False)).unionByName(stars_of(shared))
    pairs = scratch.written(pairs.filter("a <> b").groupBy("a", "b").agg(F.max("star").alias("star")), "pairs")
    shared, level, roots, more, any_more = shared.withColumn("far", F.lit(True)), 0, None, None, False
    held = kept.written(only(members, pairs.select("a").unionByName(pairs.select(F.col("b").alias("a")))), "held")  # most members are in no pair
    while True:
        stars = scratch.written(compared(pairs, held), "stars")
        near = stars.filter(F.col("est") >= FAR)
        texts = texts_of(held, near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct())
        known = scratch.written(measured(near, texts, shingles, as_set), "measured")
        inside, several = within_blocks(known.filter("star").drop("star"), threshold)
        links = scratch.written(known.filter(similar(threshold)).select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(inside), "links")
        more = links if more is None else more.unionByName(links)
        any_more |= level > 0 and not links.isEmpty()
        if level == 0:
            roots = first.written(components(links, first), "roots")
        if not several.isEmpty():
            more, any_more = more.unionByName(scratch.written(across_blocks(several, roots, threshold), "links")), True
        # a pair that is still open has, for each pivot of its bucket, a member that is far from it, and none that is close to it
        est = shared.join(stars.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "est"), ["pivot", "id"], "left").fillna(1.0, ["est"])
        apart = est.groupBy("h", "id").agg(F.max("est").alias("most"), (F.max("far") & (F.min("est") < FAR)).alias("far")).filter(F.col("most") < CLOSE)
        apart = scratch.written(apart.join(roots, "id", "left").select("h", "id", "far", F.coalesce("root", "id").alias("root")), "apart")
        alive = apart.groupBy("h").agg(F.max("far").alias("far"), F.min("root").alias("x"), F.max("root").alias("y")).filter("far AND x < y").select("h")
        level += 1
        left = apart.join(alive, "h")
        pivots = left.filter("far").groupBy("h", F.pmod(F.xxhash64("id"), F.lit(64**level)).alias("part")).agg(F.min("id").alias("pivot")).select("h", "pivot")
        shared = scratch.written(left.select("h", "id", "far").join(pivots, "h"), "buckets")
        if shared.isEmpty():
            break
        pairs = stars_of(shared).filter("a <> b").distinct()
    if any_more:
        roots = last.written(components(more, scratch), "roots")
        first.drop()
    scratch.drop()
    return roots, held
