"""Near copies among embeddings: p-stable hashing of normalised vectors in several tables, exact cosines, union-find.

A table cuts some random projections of the unit vector (Gaussian directions: distances between projections are as those of the vectors) into
cells of one width, each from an offset of its own. Vectors that share all cells of a table, and their label, are one bucket. All pairs of a
bucket are compared by blocks of matrix products, so tasks make counts and a spanning forest of the links, a row or two for each member, and never a
row for each pair. A pair that shares several buckets counts in the first of them.

Bit-equal vectors are one member that counts as often as it stands. Of buckets that hold the same members, the first alone is looked at. A bucket of
more than BLOCK members is dealt out in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helix.llm import words as W
from helix.llm.components import components
from helix.llm.shared import Scratch, written

#: Members of a block, and rows of a matrix product at a time.
BLOCK, TILE = 1024, 512


class Projections:
    """Directions and offsets of all tables, by the vectors' length; the same in every task."""

    def __init__(self, tables: int, per_table: int, width: float, seed: int = 20240229):
        self.tables, self.per_table, self.width, self.seed = tables, per_table, width, seed
        self.drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.factors = W.mixed(np.arange(1, per_table + 1, dtype=W.U)) | W.U(1)

    def hashes(self, unit: np.ndarray) -> np.ndarray:
        """n unit vectors -> n x tables 32-bit hashes of their cells."""
        n, size = unit.shape
        if size not in self.drawn:
            rng = np.random.default_rng([self.seed, size])
            k = self.tables * self.per_table
            self.drawn[size] = rng.standard_normal((size, k)), rng.random(k)
        directions, offsets = self.drawn[size]
        cells = np.floor(unit @ directions / self.width + offsets).astype(np.int64).view(W.U).reshape(n, self.tables, self.per_table)
        return (W.mixed((cells * self.factors).sum(axis=2, dtype=W.U)) >> W.U(32)).astype(np.uint32)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of numbers -> values (float64, null as NaN), the start of each list, its length (-1: null)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    held = np.maximum(length, 0)
    return values, np.cumsum(held) - held, length


def hashed(vectors: DataFrame, projections: Projections) -> DataFrame:
    """vectors (vec_id, label, v: array) -> vec_id, id (a number for each row), label, v (bytes of doubles), cells (bytes of 32-bit hashes, a table each), key (of equal
    labels and vectors). Rows that can't link have null in label, v, cells and key. Write it before use: ids depend on how rows lie in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 38
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                b = whole.slice(first, 1024)
                n = b.num_rows
                values, at, length = _matrix(b["v"])
                labelled = ~b["label"].is_null().to_numpy(zero_copy_only=False)
                v, cells = np.full(n, None, object), np.full(n, None, object)
                for size in np.unique(length[length > 0]):
                    rows = np.flatnonzero((length == size) & labelled)
                    x = values[at[rows][:, None] + np.arange(size)]
                    with np.errstate(all="ignore"):
                        norm = np.sqrt((x * x).sum(axis=1))
                    ok = np.isfinite(norm) & (norm > 0)
                    rows, x, norm = rows[ok], x[ok], norm[ok]
                    if len(rows):
                        h = projections.hashes(x / norm[:, None])
                        for i, r in enumerate(rows):
                            v[r], cells[r] = (x[i] + 0.0).tobytes(), h[i].tobytes()  # + 0.0: no negative zeros
                ids = pa.array(np.arange(next_id, next_id + n))
                next_id += n
                yield pa.RecordBatch.from_arrays([b["vec_id"], ids, b["label"], pa.array(v, pa.binary()), pa.array(cells, pa.binary())], ["vec_id", "id", "label", "v", "cells"])

    kind = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    rows = vectors.select("vec_id", "label", "v").mapInArrow(W.releasing(run), f"vec_id {kind['vec_id']}, id long, label {kind['label']}, v binary, cells binary")
    return rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.concat(F.col("label").cast("string"), F.lit("\n"), F.hex("v")).cast("binary"), 256)))


def _buckets(members: DataFrame, tables: int, scratch: Scratch) -> DataFrame:
    """members (id, label, size, cells) -> id, t, label, size, h, n: for the buckets of several members, the first of those with the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = np.frombuffer(b"".join(b["cells"].to_pylist()), np.uint32).reshape(-1, tables)
                each = np.repeat(np.arange(b.num_rows), tables)
                take = lambda c: b[c].take(pa.array(each))
                yield pa.RecordBatch.from_arrays([take("id"), pa.array(np.tile(np.arange(tables, dtype=np.int32), b.num_rows)), take("label"), take("size"), pa.array(cells.ravel().view(np.int32))], ["id", "t", "label", "size", "h"])

    label = members.schema["label"].dataType.simpleString()
    rows = members.select("id", "label", "size", "cells").mapInArrow(W.releasing(run), f"id long, t int, label {label}, size int, h int")
    key = ["t", "label", "size", "h"]
    a, b = F.xxhash64("id"), F.xxhash64("id", F.lit(1))
    sets = rows.groupBy(*key).agg(F.count("*").alias("n"), F.bit_xor(a).alias("x"), F.sum(b.cast("decimal(38,0)")).alias("y")).filter("n > 1")
    sets = scratch.written(sets, "sets")
    firsts = sets.groupBy("n", "x", "y").agg(F.min(F.struct(*key)).alias("k")).select("k.*", "n")
    # a large bucket's rows meet it in several tasks
    salted = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(8)).cast("int")).join(salted, [*key, "salt"]).select("id", *key, "n")


def _links(rows: DataFrame, tables: int, threshold: float) -> DataFrame:
    """rows (t, label, size, h, p, q, side, id, copies, v, cells): members of the pairs of blocks (p, q) of buckets -> id, n, other: links of id counted here, with the
    copies of who is linked, and a member of its component."""

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, side, copies = (t[c].to_numpy() for c in ("id", "side", "copies"))
        x = np.frombuffer(b"".join(t["v"].to_pylist()), np.float64).reshape(len(ids), -1)
        cells = np.frombuffer(b"".join(t["cells"].to_pylist()), np.uint32).reshape(len(ids), tables)
        table, one = t["t"][0].as_py(), t["p"][0].as_py() == t["q"][0].as_py()
        norm = np.sqrt((x * x).sum(axis=1))
        left, right = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        count, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i in range(0, len(left), TILE):
            a = left[i : i + TILE]
            for j in range(i if one else 0, len(right), TILE):
                b = right[j : j + TILE]
                r, c = np.nonzero((x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= threshold)
                r, c = a[r], b[c]
                if one:
                    r, c = r[r < c], c[r < c]
                earlier = np.zeros(len(r), bool)
                for k in range(table):
                    earlier |= cells[r, k] == cells[c, k]
                r, c = r[~earlier], c[~earlier]
                np.add.at(count, r, copies[c])
                np.add.at(count, c, copies[r])
                while len(r):  # a forest: each root under a smaller one, until no link joins two trees
                    u, v = parent[r], parent[c]
                    apart = u != v
                    r, c, u, v = r[apart], c[apart], u[apart], v[apart]
                    if not len(r):
                        break
                    np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
                    while (parent[parent] != parent).any():
                        parent = parent[parent]
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some]), pa.array(ids[parent[some]])], ["id", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch[c].to_numpy(zero_copy_only=False) for c in key]
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cuts = np.flatnonzero(new)
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                now = tuple(k[i] for k in keys)
                if now != last and held:
                    yield from links(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(i, j - i))
                last = now
        if held:
            yield from links(pa.Table.from_batches(held))

    key = ("t", "label", "size", "h", "p", "q")
    return rows.select(*key, "side", "id", "copies", "v", "cells").repartition(*key).sortWithinPartitions(*key).mapInArrow(W.releasing(run), "id long, n long, other long")


def embedding_dedup(
    vectors: DataFrame, *, threshold: float = 0.98, tables: int = 40, per_table: int = 20, width: float = 2.0, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding"
) -> DataFrame:
    """vectors (vec_id, label, embedding: array of numbers; others are left alone) -> for each row: vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is at least threshold. n_links: other rows linked with
    it; component_id: the smallest vec_id that links reach, its own included; kept: vec_id is component_id, so rows that share the smallest id are all kept. A null
    vec_id is the smallest of no component but one of nulls. Vectors that are null, empty, zero or hold null or non-finite numbers, or whose norm isn't finite, have no
    links; nor do vectors of different lengths. Repeated rows link with each other. An empty table gives no rows.

    With cells of width 2 two unit vectors of cosine 0.98 share one of 20 cells with probability 0.92, so all of a table's with 0.19, and none of 40 tables once in 4,000
    pairs; of cosine 0.99 once in 300,000. Vectors at right angles share a table's cells once in 1.8 million. All that share any are compared.
    """
    scratch, projections = Scratch(vectors.sparkSession), Projections(tables, per_table, width)
    chosen = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("v"))
    every = scratch.written(hashed(chosen, projections), "vectors")
    linkable = every.filter("key IS NOT NULL")
    reps = scratch.written(linkable.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "distinct")
    members = linkable.join(reps.select("id"), "id", "left_semi").withColumn("size", F.expr("cast(octet_length(v) / 8 AS int)"))
    shared = scratch.written(_buckets(members, tables, scratch), "buckets")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    dealt = shared.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "t", "label", "size", "h", F.least("mine", "with").alias("p"), F.greatest("mine", "with").alias("q"), (F.col("mine") > F.col("with")).cast("int").alias("side"))
    full = dealt.join(members.select("id", "v", "cells").join(reps.select("id", "copies"), "id"), "id")
    found = scratch.written(_links(full, tables, threshold), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("links"))
    roots = components(found.select(F.col("id").alias("u"), F.col("other").alias("v")), scratch)

    of = reps.join(counts, "id", "left").join(roots, "id", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
    # copies of a member meet it in several tasks
    salted = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    rows = linkable.select("vec_id", "key", F.pmod("id", F.lit(8)).cast("int").alias("salt")).join(salted, ["key", "salt"])
    least = rows.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    linked = rows.join(least, ["root", "salt"]).select("vec_id", "n_links", "component_id")
    alone = every.filter("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    out = written(out, "components")
    scratch.drop()
    return out
