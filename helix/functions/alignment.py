"""Alignment records: flags, CIGARs, tags and classes of records and observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helix.functions.common import col

#: The bits of FLAG.
FLAGS = {
    "paired": 0x1, "proper": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "reverse": 0x10, "mate_reverse": 0x20, "read1": 0x40, "read2": 0x80, "secondary": 0x100, "qc_fail": 0x200,
    "duplicate": 0x400, "supplementary": 0x800,
}


def has(flag: Column | str, *names: str) -> Column:
    """Any of the bits is set."""
    return col(flag).bitwiseAND(F.lit(sum(FLAGS[n] for n in names))) != 0


def decode_flags(flag: Column | str) -> Column:
    """struct of a boolean for each bit."""
    return F.struct(*[has(flag, n).alias(n) for n in FLAGS])


def flag_error(flag: Column | str) -> Column:
    return F.when(has(flag, "read1") & has(flag, "read2"), "both_reads")


def is_primary(flag: Column | str) -> Column:
    return ~has(flag, "secondary", "supplementary")


def is_primary_mapped(flag: Column | str) -> Column:
    return ~has(flag, "secondary", "supplementary", "unmapped")


def eligibility(flag: Column | str, mapq: Column | str, min_mapq: int = 20) -> Column:
    """A record's class for calling; the first that fits."""
    m = col(mapq)
    out = F.when(has(flag, "secondary"), "secondary").when(has(flag, "supplementary"), "supplementary").when(has(flag, "unmapped"), "unmapped").when(has(flag, "duplicate"), "duplicate")
    return out.when(has(flag, "qc_fail"), "qc_fail").when(m == 255, "mapq_unavailable").when(m < min_mapq, "low_mapq").otherwise("eligible")


def cigar_valid(cigar: Column | str) -> Column:
    return F.coalesce(col(cigar).rlike("^(?:0*[1-9][0-9]*[MIDNSHP=X])+$"), F.lit(False))


def parse_cigar(cigar: Column | str) -> Column:
    """array of struct(n, op)."""
    c, op = col(cigar), F.lit("([0-9]+)([MIDNSHP=X])")
    return F.zip_with(F.regexp_extract_all(c, op, F.lit(1)), F.regexp_extract_all(c, op, F.lit(2)), lambda n, o: F.struct(n.cast("long").alias("n"), o.alias("op")))


def _span(ops: Column, kinds: str) -> Column:
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*kinds)), F.lit(0).cast("long"), lambda a, x: a + x["n"])


def read_span(ops: Column) -> Column:
    return _span(ops, "MIS=X")


def ref_span(ops: Column) -> Column:
    return _span(ops, "MDN=X")


def cigar_walk(ops: Column) -> Column:
    """array of struct(op, n, ref, read): each operation with the reference and read bases before it."""
    step = lambda a, x: F.struct(
        F.concat(a["out"], F.array(F.struct(x["op"].alias("op"), x["n"].alias("n"), a["ref"].alias("ref"), a["read"].alias("read")))).alias("out"),
        (a["ref"] + F.when(x["op"].isin(*"MDN=X"), x["n"]).otherwise(0)).alias("ref"), (a["read"] + F.when(x["op"].isin(*"MIS=X"), x["n"]).otherwise(0)).alias("read"),
    )
    start = F.struct(F.array().cast("array<struct<op:string,n:bigint,ref:bigint,read:bigint>>").alias("out"), F.lit(0).cast("long").alias("ref"), F.lit(0).cast("long").alias("read"))
    return F.aggregate(ops, start, step, lambda a: a["out"])


def cigar_blocks(pos: Column | str, ops: Column) -> Column:
    """array of struct(s, e): the covered stretches of the reference, from 1, without e. Deletions and skips aren't covered."""
    covered = F.filter(cigar_walk(ops), lambda x: x["op"].isin("M", "=", "X"))
    return F.transform(covered, lambda x: F.struct((col(pos) + x["ref"]).alias("s"), (col(pos) + x["ref"] + x["n"]).alias("e")))


def bounds_error(pos: Column | str, ops: Column, contig_length: Column, seq: Column | None = None) -> Column:
    """beyond_contig or read_length, else null. seq: null or * has no length to compare."""
    out = F.when(col(pos) + ref_span(ops) - 1 > contig_length, "beyond_contig")
    return out if seq is None else out.when((seq != "*") & (F.length(seq) != read_span(ops)), "read_length")


def nm_tag(tags: Column | str) -> Column:
    """The number of NM:i:n among an array of optional fields; null without one or with several."""
    nm = F.filter(col(tags), lambda x: x.rlike("^NM:i:[0-9]+$"))
    return F.when(F.size(nm) == 1, F.substr(F.get(nm, F.lit(0)), F.lit(6), F.lit(20)).cast("long"))


#: The first of each bin, and the bin's name.
MAPQ_BINS = ((0, "0"), (1, "1-9"), (10, "10-19"), (20, "20-29"), (30, "30-39"), (40, "40-59"), (60, "60+"))


def mapq_bin(mapq: Column | str) -> Column:
    out = F.lit(MAPQ_BINS[0][1])
    for least, name in MAPQ_BINS[1:]:
        out = F.when(col(mapq) >= least, name).otherwise(out)
    return out


def tlen_eligible(flag: Column | str, rname: Column | str, rnext: Column | str, tlen: Column | str) -> Column:
    """Its template length counts: primary, paired, properly, both ends on one contig, positive."""
    f = is_primary(flag) & has(flag, "paired") & has(flag, "proper") & ~has(flag, "unmapped", "mate_unmapped")
    return f & ((col(rnext) == "=") | (col(rnext) == col(rname))) & (col(tlen) > 0)


def observation_class(ref_base: Column, read_base: Column, quality: Column, min_quality: int = 20) -> Column:
    """A base's class for calling, in this order; = in a read means the reference's base."""
    r = F.when(read_base == "=", ref_base).otherwise(F.upper(read_base))
    out = F.when(~F.upper(ref_base).isin(*"ACGT"), "reference_not_canonical").when(~r.isin(*"ACGT"), "read_ambiguous")
    return out.when((quality == 255) | (quality < min_quality), "low_quality").otherwise("callable")


def sam_flags(paired: bool, mate: Column | None, hit: Column, reverse: Column, mate_hit: Column | None = None, mate_reverse: Column | None = None) -> Column:
    """FLAG of an aligned record; never properly paired."""
    bit = lambda c, n: F.when(F.coalesce(c, F.lit(False)), FLAGS[n]).otherwise(0)
    out = bit(~hit, "unmapped") + bit(hit & reverse, "reverse")
    if paired:
        out = out + FLAGS["paired"] + F.when(mate == 1, FLAGS["read1"]).otherwise(FLAGS["read2"]) + bit(~mate_hit, "mate_unmapped") + bit(mate_hit & mate_reverse, "mate_reverse")
    return out.cast("int")


def template_length(same_contig: Column, pos: Column, length: Column, mate_pos: Column, mate_length: Column, is_read1: Column) -> Column:
    """Signed span of both mates on one contig: plus for the leftmost, and for read 1 if both start there; else 0."""
    span = F.greatest(pos + length, mate_pos + mate_length) - F.least(pos, mate_pos)
    left = (pos < mate_pos) | ((pos == mate_pos) & is_read1)
    return F.when(F.coalesce(same_contig, F.lit(False)), F.when(left, span).otherwise(-span)).otherwise(0).cast("long")
