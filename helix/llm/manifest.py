"""A Merkle manifest of a dataset as a content-addressed graph, and the proofs of its rows by descent from the root.

A store holds, for the digest of each inner node, the digests of its children, one after the other. Rows are ranked within their group by a
range-partitioned sort, so no group has to pass one task; every FAN consecutive nodes become one, level by level, until a group has one, its
subroot, and the subroots of all groups become the root in the same way.

A request for leaves starts at the root with one row. At each level the store is looked up by digest, and the digits of the leaves' ranks (in base
FAN) select children; the unselected ones are what a proof needs. Leaves below the same node share its row, so a level has as many rows as it has
nodes, never one for each leaf. The segments of a path, met from the root, are reversed at the end: a proof is read from the leaf.

Digests are held as 32 bytes; what is hashed is their lowercase hex text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helix.llm.shared import Scratch, written

FAN, SIZE = 8, 32
PATH = "array<struct<digit int, children binary>>"


def field(c: Column) -> Column:
    """A value as it is hashed: "-" if null, else its UTF-8 length, a colon, itself."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def text_of(d: Column) -> Column:
    return F.lower(F.hex(d))


def node(children: Column) -> Column:
    """The digest of a node with these children."""
    return F.unhex(F.sha2(text_of(children).cast("binary"), 256))


def numbered(rows: DataFrame, groups: list[str], order: list[Column], scratch: Scratch) -> DataFrame:
    """rows with rank, the place (from 0) of each in its group, and n, the size of the group. The sort is by ranges of groups and order; ties are as rows come.
    Places before a range are the sums of the ranges before it, a row for each group in each range."""
    keys = [F.asc_nulls_first(g) for g in groups] + order
    sorted_rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    sorted_rows = sorted_rows.repartitionByRange(*keys, F.asc("_tie")).sortWithinPartitions(*keys, F.asc("_tie")).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.written(sorted_rows, "sorted").withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(*groups, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    along = Window.partitionBy(*groups).orderBy("_part")
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    parts = parts.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("_part").alias("_p"), "_first", before, F.sum("_n").over(Window.partitionBy(*groups)).alias("n"))
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return placed.join(parts, same).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("rank"), "n")


def _up(nodes: DataFrame) -> DataFrame:
    """nodes (g, n, idx, digest) of a level -> (g, n, idx, digest, children) of the next; n: the nodes that a group has in the level. Groups of one node are at their end."""
    runs = nodes.filter("n > 1").groupBy("g", "n", F.expr(f"idx div {FAN}").alias("up")).agg(F.sort_array(F.collect_list(F.struct(F.col("idx"), F.col("digest")))).alias("run"))
    children = F.concat(*(F.coalesce(F.get("run", F.lit(i))["digest"], F.lit(b"")) for i in range(FAN)))
    up = runs.select("g", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("up").alias("idx"), children.alias("children"))
    return up.select("g", "n", "idx", node(F.col("children")).alias("digest"), "children")


def _levels(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """nodes and the levels over them, each written."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [nodes]
    while most > 1:
        out.append(scratch.written(_up(out[-1]), "level"))
        most = -(-most // FAN)
    return out


@dataclass
class Manifest:
    """leaves (g, n, idx, digest and what the rows carry), the levels over them and the levels over the groups' subroots (idx: the group's place)."""

    leaves: DataFrame
    levels: list[DataFrame]
    tops: list[DataFrame]

    def store(self) -> DataFrame:
        """digest -> children, of all inner nodes."""
        inner = [x.select("digest", "children") for x in self.levels[1:] + self.tops[1:]]
        return _union(inner).distinct() if inner else self.leaves.select("digest", F.lit(b"").alias("children")).limit(0)

    def root(self) -> DataFrame:
        return self.tops[-1].select("digest")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def build(rows: DataFrame, group: str, order: list[Column], scratch: Scratch) -> Manifest:
    """rows (group, digest and others) -> their manifest. Groups are in order of bytes, null first."""
    ranked = scratch.written(numbered(rows, [group], order, scratch), "ranked")
    sizes = ranked.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_size"))
    places = scratch.written(numbered(sizes, [], [F.asc_nulls_first("_group")], scratch).select("_group", F.col("rank").alias("g"), F.col("n").alias("groups")), "groups")
    if places.count() <= 10_000:
        leaves = ranked.join(F.broadcast(places), F.col(group).eqNullSafe(F.col("_group")))
    else:  # a group's rows meet it in several tasks
        salted = places.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        leaves = ranked.join(salted, F.col(group).eqNullSafe(F.col("_group")) & (F.col("rank") % 64 == F.col("_salt")))
    leaves = scratch.written(leaves.select("g", "n", F.col("rank").alias("idx"), *(c for c in rows.columns if c != group), "groups"), "leaves")
    levels = _levels(leaves, scratch)
    subroots = _union([x.filter("n = 1").select("g", "digest") for x in levels]).join(places.select("g", "groups"), "g")
    tops = scratch.written(subroots.select(F.lit(0).cast("long").alias("g"), F.col("groups").alias("n"), F.col("g").alias("idx"), "digest"), "subroots")
    return Manifest(leaves, levels, _levels(tops, scratch))


def _children(frontier: DataFrame, level: DataFrame) -> DataFrame:
    """Each node of the frontier with what the store holds under its digest."""
    return frontier.join(level.select("digest", "children").dropDuplicates(["digest"]), "digest")


def _selected(found: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """The children of found nodes that lead to wanted ones (g, idx), each with the path that leads there."""
    digits = F.explode(F.sequence(F.lit(0), F.expr(f"cast(octet_length(children) / {SIZE} AS int) - 1"))).alias("digit")
    each = found.select("*", digits).select(
        *(c for c in found.columns if c not in ("digest", "children", "idx", "path")), (F.col("idx") * FAN + F.col("digit")).alias("idx"),
        F.substring("children", F.col("digit") * SIZE + 1, F.lit(SIZE)).alias("digest"), F.concat("path", F.array(F.struct(F.col("digit"), F.col("children")))).alias("path"),
    )
    return each if wanted is None else each.join(wanted, ["g", "idx"], "left_semi")


def descend(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The leaves of requests (g, idx), or all -> g, idx, subroot, root, path: segments (digit, children) from the root, and the leaf's row as a struct, leaf."""
    leaves = m.leaves if requests is None else m.leaves.join(requests.select("g", "idx").distinct(), ["g", "idx"], "left_semi")
    above = lambda h: None if requests is None else requests.select("g", F.expr(f"cast(floor(idx / {FAN**h}) AS bigint)").alias("idx")).distinct()

    at = m.tops[-1].select("g", "idx", "digest", F.col("digest").alias("root"), F.expr(f"cast(array() AS {PATH})").alias("path"))
    for level in m.tops[:0:-1]:
        at = _selected(_children(at, level), None)
    sizes = _union([x.filter("n = 1").select("g", F.lit(h).alias("height")) for h, x in enumerate(m.levels)])
    starts = at.select(F.col("idx").alias("g"), F.lit(0).cast("long").alias("idx"), "digest", F.col("digest").alias("subroot"), "root", "path").join(sizes, "g")
    if requests is not None:
        starts = starts.join(requests.select("g").distinct(), "g", "left_semi")

    carried = leaves.select("g", "idx", F.struct("*").alias("leaf"))
    out = starts.filter("height = 0").join(carried, ["g", "idx"]).select("g", "idx", "subroot", "root", "path", "leaf")
    frontier = None
    for h in range(len(m.levels) - 1, 0, -1):
        new = starts.filter(F.col("height") == h).drop("height")
        frontier = new if frontier is None else frontier.unionByName(new)
        found = _children(frontier, m.levels[h])
        if h > 1:
            frontier = _selected(found, above(h - 1))
            continue
        runs = carried.groupBy("g", F.expr(f"idx div {FAN}").alias("idx")).agg(F.collect_list("leaf").alias("run"))  # FAN at most
        last = found.join(runs, ["g", "idx"]).select("g", "subroot", "root", "path", "children", F.explode("run").alias("leaf"))
        segment = F.struct(F.expr(f"cast(leaf.idx % {FAN} AS int)").alias("digit"), F.col("children"))
        out = out.unionByName(last.select("g", F.col("leaf.idx").alias("idx"), "subroot", "root", F.concat("path", F.array(segment)).alias("path"), "leaf"))
    return out


def _left(s: Column) -> Column:
    return F.substring(s["children"], F.lit(1), s["digit"] * SIZE)


def _right(s: Column) -> Column:
    return F.substring(s["children"], s["digit"] * SIZE + SIZE + 1, F.lit(FAN * SIZE))


def siblings(path: Column) -> Column:
    """The hex text of what a proof holds: the siblings at each level from the leaf to the root, left to right."""
    return F.array_join(F.transform(F.reverse(path), lambda s: text_of(F.concat(_left(s), _right(s)))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(F.reverse(path), leaf, lambda now, s: node(F.concat(_left(s), now, _right(s))))


def manifest_proofs(docs: DataFrame, *, tampered: Column | None = None, doc_id: str = "doc_id", lang: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text") -> DataFrame:
    """docs -> for each row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows are ordered by lang (null first, by bytes) and doc_id (null first, then by the digest of the row). Where tampered (a condition on docs; none: nowhere) holds,
    folded_root is computed from a leaf whose text has A-Z in lower case. Nulls are hashed as "-", so they differ from empty texts. Repeated rows are leaves of their
    own; a table of one row is its own root, with a proof of nothing; an empty table gives no rows. Of docs only the named columns are read, whatever others are called.
    """
    scratch = Scratch(docs.sparkSession)
    column = {f: F.col(f) for f in fields}
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    changed = digest(*(field(F.translate(F.col(f).cast("string"), upper, lower) if f == text else c) for f, c in column.items()))
    rows = docs.select(
        F.col(lang).cast("string").alias("lang"), F.col(doc_id).alias("doc_id"), digest(*(field(c) for c in column.values())).alias("digest"),
        (F.lit(None).cast("binary") if tampered is None else F.when(tampered, changed)).alias("changed"),
    )
    m = build(rows, "lang", [F.asc_nulls_first("doc_id"), F.asc("digest")], scratch)
    found = descend(m).withColumn("folded", folded(F.coalesce("leaf.changed", "leaf.digest"), F.col("path")))
    out = found.select(
        F.col("leaf.doc_id").alias("doc_id"), text_of(F.col("leaf.digest")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"),
        F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"), text_of(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
    out = written(out, "proofs")
    scratch.drop()
    return out
