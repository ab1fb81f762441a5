"""Quality control of alignments, coverage, pileup and calls of single-nucleotide variants."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helix.functions.alignment import (
    MAPQ_BINS,
    bounds_error,
    cigar_blocks,
    cigar_valid,
    eligibility,
    has,
    is_primary,
    is_primary_mapped,
    mapq_bin,
    observation_class,
    parse_cigar,
    tlen_eligible,
)
from helix.functions.common import count_if, ratio, text_bytes
from helix.options import SnvOptions

ELIGIBILITY = ("secondary", "supplementary", "unmapped", "duplicate", "qc_fail", "mapq_unavailable", "low_mapq", "eligible")
OBSERVATIONS = ("reference_not_canonical", "read_ambiguous", "low_quality", "callable")


def alignment_qc(records: DataFrame) -> DataFrame:
    """Records (flag, rname, mapq, nm, rnext, tlen) -> one row: counts of records, MAPQ, NM and template lengths of primary mapped ones."""
    primary, mapped = is_primary("flag"), is_primary_mapped("flag")
    at = lambda *n: has("flag", *n)
    only = lambda c, x: F.when(c, F.col(x))
    tl = tlen_eligible("flag", "rname", "rnext", "tlen")
    mean = lambda c, x: F.coalesce(F.round(F.avg(only(c, x)), 6), F.lit(0.0))
    out = records.agg(
        F.count("*").alias("total"), count_if(primary).alias("primary"), count_if(mapped).alias("mapped"), count_if(primary & at("unmapped")).alias("unmapped"), count_if(at("secondary")).alias("secondary"),
        count_if(at("supplementary")).alias("supplementary"), *[count_if(primary & at(n)).alias(n) for n in ("duplicate", "qc_fail", "paired", "read1", "read2")], count_if(primary & at("paired") & at("proper")).alias("proper"),
        count_if(mapped & at("reverse")).alias("reverse"), count_if(primary & at("paired") & at("mate_unmapped")).alias("mate_unmapped"), mean(mapped, "mapq").alias("mean_mapq"), F.min(only(mapped, "mapq")).alias("min_mapq"),
        F.max(only(mapped, "mapq")).alias("max_mapq"), *[count_if(mapped & (mapq_bin("mapq") == n)).alias(f"mapq_{n.replace('-', '_').replace('+', '_up')}") for _, n in MAPQ_BINS], count_if(mapped & F.col("nm").isNotNull()).alias("nm_observed"),
        count_if(mapped & F.col("nm").isNull()).alias("nm_missing"), F.coalesce(F.sum(only(mapped, "nm")), F.lit(0)).cast("long").alias("nm_total"), mean(mapped, "nm").alias("nm_mean"), F.min(only(mapped, "nm")).cast("long").alias("nm_min"),
        F.max(only(mapped, "nm")).cast("long").alias("nm_max"), count_if(tl).alias("tlen_observed"), mean(tl, "tlen").alias("tlen_mean"), F.min(only(tl, "tlen")).alias("tlen_min"), F.max(only(tl, "tlen")).alias("tlen_max"),
    )
    return out.withColumn("mapping_rate", ratio(F.col("mapped"), F.col("primary"), 100)).withColumn("proper_pair_rate", ratio(F.col("proper"), F.col("paired"), 100))


def contig_counts(records: DataFrame) -> DataFrame:
    return records.filter(is_primary_mapped("flag")).groupBy(F.col("rname").alias("contig")).agg(F.count("*").alias("mapped"))


def undeclared(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Mapped records whose contig the dictionary (contig, length) lacks."""
    return records.filter(~has("flag", "unmapped")).join(dictionary.select(F.col("contig").alias("rname")), "rname", "left_anti")


def record_errors(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """All mapped records (pos, cigar, seq and others) with error: bad_cigar, beyond_contig, read_length or null."""
    m = records.filter(~has("flag", "unmapped")).join(dictionary.select(F.col("contig").alias("rname"), F.col("length").alias("_len")), "rname", "left")
    ops = parse_cigar("cigar")
    return m.withColumn("error", F.when(~cigar_valid("cigar"), "bad_cigar").otherwise(bounds_error("pos", ops, F.col("_len"), F.col("seq")))).drop("_len")


def caller_errors(records: DataFrame, reference: DataFrame, options: SnvOptions = SnvOptions()) -> DataFrame:
    """Mapped records that a caller can't take, with error: unknown_contig, no_bases, length_mismatch, bad_base, read_length or beyond_contig (the last two of eligible ones)."""
    m = records.filter(~has("flag", "unmapped")).join(reference.select(F.col("contig").alias("rname"), F.length("seq").cast("long").alias("_len")), "rname", "left")
    eligible = eligibility("flag", "mapq", options.min_mapq) == "eligible"
    error = F.when(F.col("_len").isNull(), "unknown_contig").when((F.col("seq") == "*") | (F.col("qual") == "*"), "no_bases").when(F.length("seq") != F.length("qual"), "length_mismatch")
    error = error.when(~F.col("seq").rlike("^[ACGTURYSWKMBDHVNacgturyswkmbdhvn=]+$"), "bad_base").when(eligible, bounds_error("pos", parse_cigar("cigar"), F.col("_len"), F.col("seq")))
    return m.withColumn("error", error).filter("error IS NOT NULL").drop("_len")


#: Places of a stretch of a contig that one task sweeps.
SWEEP = 1 << 18


def depth_segments(records: DataFrame) -> DataFrame:
    """contig, pos, next, depth: stretches [pos, next) of one depth over primary mapped records, by a sweep over starts and ends.

    The changes at a place are added up first, so however deep a contig is covered, a sweep sorts distinct places; each sweep is over a part of a contig and
    starts from the depth that the sums of the parts before it give.
    """
    blocks = records.filter(is_primary_mapped("flag") & cigar_valid("cigar")).select(F.col("rname").alias("contig"), F.explode(cigar_blocks("pos", parse_cigar("cigar"))).alias("b"))
    changes = blocks.select("contig", F.explode(F.array(F.struct(F.col("b.s").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("b.e").alias("pos"), F.lit(-1).alias("d")))).alias("x"))
    summed = changes.groupBy("contig", F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d")).withColumn("part", F.floor(F.col("pos") / SWEEP))
    parts = summed.groupBy("contig", "part").agg(F.sum("d").alias("d"), F.min("pos").alias("first"))  # a row for each SWEEP places at most
    along = Window.partitionBy("contig").orderBy("part")
    parts = parts.select("contig", "part", F.coalesce(F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("first").over(along).alias("after"))
    w = Window.partitionBy("contig", "part").orderBy("pos")
    swept = summed.join(parts, ["contig", "part"]).select("contig", "pos", F.coalesce(F.lead("pos").over(w), F.col("after")).alias("next"), (F.col("before") + F.sum("d").over(w)).alias("depth"))
    return swept.filter("depth > 0")


def coverage(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """For each contig of the dictionary: covered bases, breadth, mean and greatest depth, sum of depth, bases at 1, 10, 20 and 30 or more."""
    n = F.col("next") - F.col("pos")
    got = depth_segments(records).groupBy("contig").agg(
        F.sum(n).alias("covered_bases"), F.sum(n * F.col("depth")).alias("depth_sum"), F.max("depth").alias("max_depth"), *[F.sum(F.when(F.col("depth") >= k, n).otherwise(0)).alias(f"bases_{k}x") for k in (1, 10, 20, 30)]
    )
    out = dictionary.select("contig", "length").join(got, "contig", "left").fillna(0)
    return out.withColumn("breadth_percent", ratio(F.col("covered_bases"), F.col("length"), 100)).withColumn("mean_depth", ratio(F.col("depth_sum"), F.col("length")))


def coverage_totals(cov: DataFrame) -> DataFrame:
    sums = ("length", "covered_bases", "depth_sum", "bases_1x", "bases_10x", "bases_20x", "bases_30x")
    t = cov.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums], F.coalesce(F.max("max_depth"), F.lit(0)).alias("max_depth"))
    return t.withColumn("breadth_percent", ratio(F.col("covered_bases"), F.col("length"), 100)).withColumn("mean_depth", ratio(F.col("depth_sum"), F.col("length")))


def contig_report(records: DataFrame, cov: DataFrame) -> DataFrame:
    """Contigs with mapped records and contigs with coverage, together."""
    return contig_counts(records).join(cov, "contig", "full_outer").fillna(0)


#: Bases of a reference piece.
PIECE = 4096
#: Of a CIGAR, and more bases than any contig or read has.
CIGAR_OP, FARTHEST = re.compile("([0-9]+)([MIDNSHP=X])"), 1 << 40


def reference_pieces(reference: DataFrame, more: int = 0, also: dict[str, Column] = {}) -> DataFrame:
    """reference (contig, seq) -> contig, piece (from 0), text: pieces of PIECE bases in upper case, each with so many more bases (PIECE at most) of the next; and other columns.

    All pieces are cut in one pass over a contig. An empty or null contig has none; there is no filter on seq, since Spark would carry it through a join on contig
    and, where seq is computed from contig, compute it for each row of the other side.
    """
    cut = reference.select("contig", *[c.alias(n) for n, c in also.items()], F.regexp_extract_all(F.upper("seq"), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("p"))
    if more:
        nexts = F.concat(F.transform(F.slice("p", 2, 1 << 30), lambda x: F.substr(x, F.lit(1), F.lit(more))), F.array(F.lit("")))
        cut = cut.withColumn("p", F.when(F.size("p") > 0, F.zip_with("p", nexts, lambda x, y: F.concat(x, y))))
    each = cut.select("contig", *also, F.posexplode_outer("p").alias("piece", "text")).filter("text IS NOT NULL")  # without outer, Spark cuts again for a filter on the number of pieces
    return each.select("contig", *also, F.col("piece").cast("long").alias("piece"), "text")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (rname, pos, cigar, seq, qual; seq and qual are ASCII) -> their aligned stretches, cut where pieces of the reference end: rname, piece, s (from 1),
    bases, quals. Bases that a CIGAR has beyond seq are none; qualities that are lacking are bytes of 0. A CIGAR is walked once a batch."""
    for b in batches:
        b = b.filter(b["seq"].is_valid())
        names = b["cigar"].dictionary_encode()
        walks = []
        for cigar in names.dictionary.to_pylist():
            ref = read = 0
            walk = []
            for n, op in CIGAR_OP.findall(cigar):
                n = min(int(n), FARTHEST)
                if op in "M=X":
                    walk.append((ref, read, n))
                ref, read = min(ref + n * (op in "MDN=X"), FARTHEST), min(read + n * (op in "MIS=X"), FARTHEST)
            walks.append(np.array(walk, np.int64).reshape(-1, 3))
        if not walks:
            continue
        size = np.array([len(w) for w in walks])
        walk, begin = np.concatenate(walks), np.cumsum(size) - size
        which = names.indices.to_numpy(zero_copy_only=False)
        row, nth = _each(size[which])
        ref, read, n = walk[begin[which[row]] + nth].T
        (bases, at), (quals, qat) = text_bytes(b["seq"]), text_bytes(b["qual"])
        n = np.minimum(n, np.diff(at)[row] - read)
        s = b["pos"].to_numpy(zero_copy_only=False).astype(np.int64)[row] + ref
        some = n > 0
        row, read, n, s = row[some], read[some], n[some], s[some]
        first = (s - 1) // PIECE
        i, nth = _each((s + n - 2) // PIECE - first + 1)
        piece = first[i] + nth
        lo, hi = np.maximum(s[i], piece * PIECE + 1), np.minimum((s + n)[i], (piece + 1) * PIECE + 1)
        row, skip = row[i], read[i] + lo - s[i]
        part, along = _each(hi - lo)
        place = (qat[:-1][row] + skip)[part] + along
        quality = np.where(place < qat[1:][row][part], np.append(quals, np.uint8(0))[np.minimum(place, len(quals))], 0).astype(np.uint8)
        cuts = pa.py_buffer(np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32))
        texts = [pa.Array.from_buffers(pa.binary(), len(row), [None, cuts, pa.py_buffer(x)]) for x in (bases[(at[:-1][row] + skip)[part] + along], quality)]
        yield pa.RecordBatch.from_arrays([b["rname"].take(pa.array(row)), pa.array(piece), pa.array(lo), *texts], ["rname", "piece", "s", "bases", "quals"])


def _each(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of so many times: of which element, and the how manieth."""
    of = np.repeat(np.arange(len(times)), times)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)


def _stretches(records: DataFrame, reference: DataFrame, options: SnvOptions) -> DataFrame:
    """The aligned stretches of eligible records, cut where pieces of the reference end: rname, piece, s (from 1), and as bytes bases, quals, _ref.

    A stretch of a record meets only the pieces that it lies on, by an equi-join that sorts them by piece, whatever the reference's size: what follows finds the
    stretches of a place together, so that a task adds up all of a place before anything else is shuffled. A very deep piece is split by Spark's skew join. A byte is a
    letter, so that a part of a piece is found without walking through it. Null qualities are as empty ones.
    """
    plain = lambda c: F.when(F.octet_length(c) == F.length(c), F.col(c)).otherwise(F.regexp_replace(c, r"[^\x00-\x7F]", "?")).cast("binary").alias(c)
    e = records.filter((eligibility("flag", "mapq", options.min_mapq) == "eligible") & cigar_valid("cigar"))
    e = e.select("rname", F.col("pos").cast("long").alias("pos"), "cigar", plain("seq"), F.coalesce(plain("qual"), F.lit("").cast("binary")).alias("qual"))
    on = e.filter("rname IS NOT NULL AND pos IS NOT NULL").mapInArrow(_cut, "rname string, piece long, s long, bases binary, quals binary")
    ref = reference_pieces(reference).select(F.col("contig").alias("rname"), "piece", plain("text").alias("_ref"))
    return on.join(ref.hint("merge"), ["rname", "piece"]).withColumn("_ref", F.substr("_ref", (F.col("s") - F.col("piece") * PIECE).cast("int"), F.length("bases"))).filter(F.length("_ref") > 0)


def observations(records: DataFrame, reference: DataFrame, options: SnvOptions = SnvOptions()) -> DataFrame:
    """Every aligned base of eligible records (rname, pos from 1, cigar, seq, qual) against reference (contig, seq) -> contig, pos, ref, base, quality, class."""
    text = _stretches(records, reference, options).select("rname", "s", *(F.col(c).cast("string").alias(c) for c in ("bases", "quals", "_ref")))
    each = text.select("rname", F.explode(F.transform(F.sequence(F.lit(0), F.length("bases") - 1), lambda i: F.struct((F.col("s") + i).alias("pos"), F.substr("_ref", i + 1, F.lit(1)).alias("ref"), F.upper(F.substr("bases", i + 1, F.lit(1))).alias("base"), (F.ascii(F.substr("quals", i + 1, F.lit(1))) - 33).alias("quality")))).alias("o"))
    o = each.select(F.col("rname").alias("contig"), "o.*")
    return o.withColumn("class", observation_class(F.col("ref"), F.col("base"), F.col("quality"), options.min_base_quality)).withColumn("base", F.when(F.col("base") == "=", F.col("ref")).otherwise(F.col("base")))


def counted_observations(records: DataFrame, reference: DataFrame, options: SnvOptions = SnvOptions()) -> DataFrame:
    """observations() added up: contig, pos, ref, base, class, n, qsum. Tasks add up before any row is made, so a place may have several rows of a kind; all of
    it is ASCII, so bases are bytes."""
    least = options.min_base_quality
    letters, upper = np.zeros(256, bool), np.arange(256, dtype=np.int64)
    letters[list(b"ACGT")] = True
    upper[97:123] -= 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            names = b["rname"].dictionary_encode()
            (bases, cuts), (quals, _), (ref, _) = (text_bytes(b[c]) for c in ("bases", "quals", "_ref"))
            n = np.diff(cuts)
            row, along = _each(n)
            s, piece, contig = b["s"].to_numpy(zero_copy_only=False), b["piece"].to_numpy(zero_copy_only=False), names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            on = np.unique(contig << 40 | piece, return_inverse=True)[1]  # dense, so that what follows fits for any number of contigs
            place = (on * PIECE + s - piece * PIECE - 1)[row] + along
            ref, base, quality = upper[ref], upper[bases], quals.astype(np.int64) - 33
            base = np.where(base == ord("="), ref, base)
            kind = np.where(~letters[ref], 0, np.where(~letters[base], 1, np.where(quality < least, 2, 3)))
            _, first, inverse = np.unique((place << 16 | ref << 8 | base) * 4 + kind, return_index=True, return_inverse=True)
            text = lambda x: pa.array(x[first].astype(np.uint8).view("S1").astype("U1"))
            at = row[first]
            yield pa.RecordBatch.from_arrays(
                [names.dictionary.take(pa.array(contig[at])), pa.array(s[at] + along[first]), text(ref), text(base), pa.array(kind[first]), pa.array(np.bincount(inverse)), pa.array(np.bincount(inverse, quality).astype(np.int64))],
                ["contig", "pos", "ref", "base", "kind", "n", "qsum"],
            )

    filled = lambda c: F.rpad(F.col(c).cast("string"), F.length("bases"), F.lit("\0")).alias(c)  # noqa: E731  what stands beyond a contig's end
    out = _stretches(records, reference, options).select("rname", "piece", "s", "bases", "quals", filled("_ref")).mapInArrow(run, "contig string, pos long, ref string, base string, kind long, n long, qsum long")
    return out.withColumn("class", F.element_at(F.array(*map(F.lit, OBSERVATIONS)), (F.col("kind") + 1).cast("int"))).drop("kind")


def pileup(counted: DataFrame) -> DataFrame:
    """contig, pos, ref, base, n, qsum of callable observations, from what counted_observations() gives."""
    return counted.filter("class = 'callable'").groupBy("contig", "pos", "ref", "base").agg(F.sum("n").alias("n"), F.sum("qsum").alias("qsum"))


def pileup_with_depth(counted: DataFrame) -> DataFrame:
    """pileup() with depth, the observations of all bases at a place: one aggregation to a row for each place, from which its bases are told apart again."""
    of = lambda x, c: F.sum(F.when(F.col("base") == x, F.col(c)))
    sites = counted.filter("class = 'callable'").groupBy("contig", "pos", "ref").agg(F.sum("n").alias("depth"), *[F.struct(F.lit(x).alias("base"), of(x, "n").alias("n"), of(x, "qsum").alias("qsum")).alias(x) for x in "ACGT"])
    return sites.select("contig", "pos", "ref", "depth", F.inline(F.filter(F.array(*"ACGT"), lambda b: b["n"].isNotNull()))).select("contig", "pos", "ref", "base", "n", "qsum", "depth")


def call_snvs(piled: DataFrame, options: SnvOptions = SnvOptions()) -> DataFrame:
    """contig, pos, ref, depth, alts: array of struct(base, n, fraction, abq), in the order A, C, G, T."""
    sites = piled.groupBy("contig", "pos", "ref").agg(F.sum("n").alias("depth"), F.sort_array(F.collect_list(F.struct("base", "n", "qsum"))).alias("bases"))  # four at most
    ok = lambda b: (b["base"] != F.col("ref")) & (b["n"] >= options.min_alt_count) & (b["n"] / F.col("depth") + 2.220446049250313e-16 >= options.min_alt_fraction)
    alts = F.transform(F.filter("bases", ok), lambda b: F.struct(b["base"].alias("base"), b["n"].alias("n"), F.round(b["n"] / F.col("depth"), 6).alias("fraction"), F.round(b["qsum"] / b["n"], 6).alias("abq")))
    return sites.filter(F.col("depth") >= options.min_depth).select("contig", "pos", "ref", "depth", alts.alias("alts")).filter(F.size("alts") > 0)


def snv_summary(records: DataFrame, counted: DataFrame, options: SnvOptions = SnvOptions()) -> DataFrame:
    """One row: records by class, observations by class, sites, sites deep enough, called sites and alleles; the observations are gone through once."""
    e = eligibility("flag", "mapq", options.min_mapq)
    r = records.agg(F.count("*").alias("records"), *[count_if(e == c).alias(f"records_{c}") for c in ELIGIBILITY])
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    callable_ = F.col("class") == "callable"
    sites = counted.groupBy("contig", "pos", "ref").agg(*[of(callable_ & (F.col("base") == x)).alias(x) for x in "ACGT"], *[of(F.col("class") == c).alias(f"observations_{c}") for c in OBSERVATIONS])
    depth = F.col("observations_callable")
    alleles = sum((F.when((F.col("ref") != x) & (F.col(x) >= options.min_alt_count) & (F.col(x) / depth + 2.220446049250313e-16 >= options.min_alt_fraction), 1).otherwise(0) for x in "ACGT"), F.lit(0))
    sites = sites.withColumn("alleles", F.when(depth >= options.min_depth, alleles).otherwise(0))
    s = sites.agg(
        *[F.coalesce(F.sum(f"observations_{c}"), F.lit(0)).alias(f"observations_{c}") for c in OBSERVATIONS], count_if(depth > 0).alias("sites"), count_if(depth >= options.min_depth).alias("sites_at_depth"),
        count_if(F.col("alleles") > 0).alias("called_sites"), F.coalesce(F.sum("alleles"), F.lit(0)).alias("called_alleles"),
    )
    return r.crossJoin(s)  # one row each


def compare_dictionaries(a: DataFrame, b: DataFrame, ordered: bool = False) -> DataFrame:
    """The contigs (idx, contig, length) in which a and b differ: by name, or by place in the order of idx if ordered (a dictionary is a row for each contig)."""
    key = "place" if ordered else "contig"
    if ordered:
        a, b = (d.withColumn(key, F.row_number().over(Window.orderBy("idx"))) for d in (a, b))
    x, y = (d.select(key, F.struct("contig", "length").alias(n)) for d, n in ((a, "a"), (b, "b")))
    return x.join(y, key, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand in several rows, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).filter("count > 1")

