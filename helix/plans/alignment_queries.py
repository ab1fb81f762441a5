"""Queries of alignment operators over records derived from lineitem."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helix.functions.alignment import FLAGS, bounds_error, cigar_blocks, cigar_valid, decode_flags, eligibility, is_primary, is_primary_mapped, mapq_bin, nm_tag, parse_cigar, read_span, ref_span, tlen_eligible
from helix.operators import alignments as A
from helix.operators.sinks import to_metrics
from helix.plans.adapters import PERIOD, aligned_letters, duck, strings, table
from helix.registry import query

D = duck("alignments", "dictionary")


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "alignments")


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dictionary")


@query("P15_P16_flags", f"{D} SELECT flag, count(*) AS n, {', '.join(f'flag & {v} <> 0 AS f_{k}' for k, v in FLAGS.items())}, flag & 2304 = 0 AS is_primary, flag & 2308 = 0 AS is_primary_mapped FROM alignments GROUP BY flag")
def _(spark, d):
    f = decode_flags("flag")
    return records(spark, d).groupBy("flag").agg(F.count("*").alias("n")).select("flag", "n", *[f[k].alias(f"f_{k}") for k in FLAGS], is_primary("flag").alias("is_primary"), is_primary_mapped("flag").alias("is_primary_mapped"))


CLASS = "CASE WHEN flag & 256 <> 0 THEN 'secondary' WHEN flag & 2048 <> 0 THEN 'supplementary' WHEN flag & 4 <> 0 THEN 'unmapped' WHEN flag & 1024 <> 0 THEN 'duplicate' WHEN flag & 512 <> 0 THEN 'qc_fail' WHEN mapq = 255 THEN 'mapq_unavailable' WHEN mapq < 20 THEN 'low_mapq' ELSE 'eligible' END"


@query("P17_eligibility", f"{D} SELECT {CLASS} AS class, count(*) AS n FROM alignments GROUP BY 1")
def _(spark, d):
    return records(spark, d).groupBy(eligibility("flag", "mapq").alias("class")).agg(F.count("*").alias("n"))


OPS = "list_zip(list_transform(regexp_extract_all(cigar, '[0-9]+'), lambda x: x::BIGINT), regexp_extract_all(cigar, '[MIDNSHP=X]'))"


@query("P18_P19_cigar", f"{D}, c AS (SELECT cigar, {OPS} AS ops, count(*) AS n FROM alignments GROUP BY cigar) SELECT cigar, n, len(ops) AS n_ops, coalesce(list_sum(list_transform(list_filter(ops, lambda o: contains('MIS=X', o[2])), lambda o: o[1])), 0)::BIGINT AS read_span, coalesce(list_sum(list_transform(list_filter(ops, lambda o: contains('MDN=X', o[2])), lambda o: o[1])), 0)::BIGINT AS ref_span, regexp_matches(cigar, '^(?:0*[1-9][0-9]*[MIDNSHP=X])+$') AS valid FROM c")
def _(spark, d):
    ops = parse_cigar("cigar")
    return records(spark, d).groupBy("cigar").agg(F.count("*").alias("n")).select("cigar", "n", F.size(ops).cast("long").alias("n_ops"), read_span(ops).alias("read_span"), ref_span(ops).alias("ref_span"), cigar_valid("cigar").alias("valid"))


#: The records' CIGARs are an optional 5S, a run of M and an optional 2D3M, which gives their blocks without a walk.
BLOCKS = "x AS (SELECT *, regexp_extract(cigar, '([0-9]+)M', 1)::BIGINT AS m FROM alignments), blocks AS (SELECT rname, flag, k, pos AS s, pos + m AS e FROM x UNION ALL SELECT rname, flag, k, pos + m + 2, pos + m + 5 FROM x WHERE cigar LIKE '%2D3M')"


@query("P20_cigar_blocks", f"{D}, {BLOCKS} SELECT rname, s, e, count(*) AS n FROM blocks GROUP BY ALL")
def _(spark, d):
    b = records(spark, d).select("rname", F.explode(cigar_blocks("pos", parse_cigar("cigar"))).alias("b"))
    return b.groupBy("rname", F.col("b.s").alias("s"), F.col("b.e").alias("e")).agg(F.count("*").alias("n"))


@query("P22_bounds", f"{D}, {BLOCKS}, z AS (SELECT CASE WHEN pos + m + CASE WHEN cigar LIKE '%D%' THEN 5 ELSE 0 END - 1 > 2000 THEN 'beyond_contig' WHEN read_len % 7 = 0 THEN 'read_length' END AS error FROM x) SELECT error, count(*) AS n FROM z GROUP BY error")
def _(spark, d):
    seq = F.repeat(F.lit("A"), F.when(F.col("read_len") % 7 == 0, F.col("read_len") - 1).otherwise(F.col("read_len")))
    return records(spark, d).select(bounds_error("pos", parse_cigar("cigar"), F.lit(2000), seq).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("P23_nm_tag", f"{D} SELECT CASE WHEN k % 5 = 0 THEN NULL ELSE nm END AS nm, count(*) AS n FROM alignments GROUP BY 1")
def _(spark, d):
    tags = F.split(F.concat(F.lit("AS:i:3\t"), F.when(F.col("nm").isNull(), "XX:Z:q").otherwise(F.concat(F.lit("NM:i:"), "nm")), F.when(F.col("k") % 5 == 0, F.lit("\tNM:i:9")).otherwise("")), "\t")
    t = records(spark, d).withColumn("t", tags).withColumn("t", F.when((F.col("k") % 5 == 0), F.array(F.lit("NM:i:1"), F.lit("NM:i:9"))).otherwise(F.col("t")))
    return t.groupBy(nm_tag("t").alias("nm")).agg(F.count("*").alias("n"))


BIN = "CASE WHEN mapq >= 60 THEN '60+' WHEN mapq >= 40 THEN '40-59' WHEN mapq >= 30 THEN '30-39' WHEN mapq >= 20 THEN '20-29' WHEN mapq >= 10 THEN '10-19' WHEN mapq >= 1 THEN '1-9' ELSE '0' END"
TL = "(flag & 2304 = 0 AND flag & 1 <> 0 AND flag & 2 <> 0 AND flag & 12 = 0 AND (rnext = '=' OR rnext = rname) AND tlen > 0)"


@query("P24_mapq_bin", f"{D} SELECT {BIN} AS bin, count(*) AS n FROM alignments GROUP BY 1")
def _(spark, d):
    return records(spark, d).groupBy(mapq_bin("mapq").alias("bin")).agg(F.count("*").alias("n"))


@query("P25_tlen_eligible", f"{D} SELECT rname, count_if({TL}) AS n FROM alignments GROUP BY rname")
def _(spark, d):
    return records(spark, d).groupBy("rname").agg(F.count_if(tlen_eligible("flag", "rname", "rnext", "tlen")).alias("n"))


def _m(c: str, x: str, f: str) -> str:
    return f"{f}(CASE WHEN {c} THEN {x} END)"


PM, PR = "flag & 2308 = 0", "flag & 2304 = 0"
QC = f"""count(*) AS total, count_if({PR}) AS "primary", count_if({PM}) AS mapped, count_if({PR} AND flag & 4 <> 0) AS unmapped, count_if(flag & 256 <> 0) AS secondary, count_if(flag & 2048 <> 0) AS supplementary, count_if({PR} AND flag & 1024 <> 0) AS duplicate,
 count_if({PR} AND flag & 512 <> 0) AS qc_fail, count_if({PR} AND flag & 1 <> 0) AS paired, count_if({PR} AND flag & 64 <> 0) AS read1, count_if({PR} AND flag & 128 <> 0) AS read2, count_if({PR} AND flag & 1 <> 0 AND flag & 2 <> 0) AS proper, count_if({PM} AND flag & 16 <> 0) AS reverse,
 count_if({PR} AND flag & 1 <> 0 AND flag & 8 <> 0) AS mate_unmapped, coalesce(round({_m(PM, 'mapq', 'avg')}, 6), 0) AS mean_mapq, {_m(PM, 'mapq', 'min')} AS min_mapq, {_m(PM, 'mapq', 'max')} AS max_mapq,
 {', '.join(f"count_if({PM} AND {BIN} = '{n}') AS mapq_{n.replace('-', '_').replace('+', '_up')}" for _, n in A.MAPQ_BINS)}, count_if({PM} AND nm IS NOT NULL) AS nm_observed, count_if({PM} AND nm IS NULL) AS nm_missing, coalesce({_m(PM, 'nm', 'sum')}, 0)::BIGINT AS nm_total,
 coalesce(round({_m(PM, 'nm', 'avg')}, 6), 0) AS nm_mean, {_m(PM, 'nm', 'min')} AS nm_min, {_m(PM, 'nm', 'max')} AS nm_max, count_if({TL}) AS tlen_observed, coalesce(round({_m(TL, 'tlen', 'avg')}, 6), 0) AS tlen_mean, {_m(TL, 'tlen', 'min')} AS tlen_min, {_m(TL, 'tlen', 'max')} AS tlen_max"""
SUMMARY = f'q AS (SELECT {QC} FROM alignments), summary AS (SELECT *, round(100.0 * mapped / "primary", 6) AS mapping_rate, CASE WHEN paired = 0 THEN 0 ELSE round(100.0 * proper / paired, 6) END AS proper_pair_rate FROM q)'


@query("A9_A12_F8_alignment_qc", f"{D}, {SUMMARY} SELECT * FROM summary")
def _(spark, d):
    return A.alignment_qc(records(spark, d))


@query("SNK4_metrics", f"{D}, {SUMMARY} SELECT 'total' AS metric, total::VARCHAR AS value FROM summary UNION ALL SELECT 'mapped', mapped::VARCHAR FROM summary UNION ALL SELECT 'nm_total', nm_total::VARCHAR FROM summary")
def _(spark, d):
    return to_metrics(A.alignment_qc(records(spark, d)).select("total", "mapped", "nm_total"))


@query("A13_contig_counts", f"{D} SELECT rname AS contig, count(*) AS mapped FROM alignments WHERE {PM} GROUP BY 1")
def _(spark, d):
    return A.contig_counts(records(spark, d))


@query("J5_undeclared", f"{D} SELECT rname, count(*) AS n FROM alignments WHERE flag & 4 = 0 AND rname NOT IN ('chr1', 'chr2', 'chr4') GROUP BY rname")
def _(spark, d):
    return A.undeclared(records(spark, d), dictionary(spark, d).filter("contig IN ('chr1', 'chr2', 'chr4')")).groupBy("rname").agg(F.count("*").alias("n"))


#: Depth of every single base, which the sweep avoids.
DEPTH = f"{BLOCKS}, bases AS (SELECT rname AS contig, unnest(range(s, e)) AS p FROM blocks WHERE {PM}), depth AS (SELECT contig, p, count(*) AS d FROM bases GROUP BY ALL)"
COVER = f"{DEPTH}, cov AS (SELECT contig, length, coalesce(covered_bases, 0) AS covered_bases, coalesce(depth_sum, 0)::BIGINT AS depth_sum, coalesce(max_depth, 0) AS max_depth, coalesce(bases_1x, 0) AS bases_1x, coalesce(bases_10x, 0) AS bases_10x, coalesce(bases_20x, 0) AS bases_20x, coalesce(bases_30x, 0) AS bases_30x FROM dictionary LEFT JOIN (SELECT contig, count(*) AS covered_bases, sum(d) AS depth_sum, max(d) AS max_depth, count_if(d >= 1) AS bases_1x, count_if(d >= 10) AS bases_10x, count_if(d >= 20) AS bases_20x, count_if(d >= 30) AS bases_30x FROM depth GROUP BY contig) USING (contig)), coverage AS (SELECT *, round(100.0 * covered_bases / length, 6) AS breadth_percent, round(depth_sum / length, 6) AS mean_depth FROM cov)"


@query("A14_coverage", f"{D}, {COVER} SELECT * FROM coverage")
def _(spark, d):
    return A.coverage(records(spark, d), dictionary(spark, d))


@query("W2_depth_segments", f"{D}, {DEPTH} SELECT contig, d::BIGINT AS depth, count(*) AS bases FROM depth GROUP BY ALL")
def _(spark, d):
    return A.depth_segments(records(spark, d)).groupBy("contig", "depth").agg(F.sum(F.col("next") - F.col("pos")).alias("bases"))


@query("A15_coverage_totals", f"{D}, {COVER}, t AS (SELECT sum(length)::BIGINT AS length, sum(covered_bases)::BIGINT AS covered_bases, sum(depth_sum)::BIGINT AS depth_sum, sum(bases_1x)::BIGINT AS bases_1x, sum(bases_10x)::BIGINT AS bases_10x, sum(bases_20x)::BIGINT AS bases_20x, sum(bases_30x)::BIGINT AS bases_30x, max(max_depth) AS max_depth FROM coverage) SELECT *, round(100.0 * covered_bases / length, 6) AS breadth_percent, round(depth_sum / length, 6) AS mean_depth FROM t")
def _(spark, d):
    return A.coverage_totals(A.coverage(records(spark, d), dictionary(spark, d)))


@query("J9_U2_contig_report", f"{D}, {COVER} SELECT contig, coalesce(mapped, 0) AS mapped, coalesce(covered_bases, 0) AS covered_bases, coalesce(max_depth, 0) AS max_depth FROM (SELECT rname AS contig, count(*) AS mapped FROM alignments WHERE {PM} GROUP BY 1) FULL OUTER JOIN (SELECT * FROM coverage WHERE contig <> 'chr3') USING (contig)")
def _(spark, d):
    return A.contig_report(records(spark, d), A.coverage(records(spark, d), dictionary(spark, d).filter("contig <> 'chr3'"))).select("contig", "mapped", "covered_bases", "max_depth")


@query("J7_compare_dictionaries", f"{D}, b AS (SELECT contig, length + CASE contig WHEN 'chr2' THEN 1 ELSE 0 END AS length FROM dictionary WHERE contig <> 'chr5') SELECT coalesce(a.contig, b.contig) AS contig, a.length AS length_a, b.length AS length_b FROM dictionary a FULL OUTER JOIN b USING (contig) WHERE a.length IS DISTINCT FROM b.length")
def _(spark, d):
    a = dictionary(spark, d)
    b = a.filter("contig <> 'chr5'").withColumn("length", F.col("length") + F.when(F.col("contig") == "chr2", 1).otherwise(0))
    return A.compare_dictionaries(a, b).select("contig", F.col("a.length").alias("length_a"), F.col("b.length").alias("length_b"))


@query("V28_duplicates", f"{D} SELECT rname, pos, cigar, count(*) AS count FROM alignments GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return A.duplicates(records(spark, d), "rname", "pos", "cigar")


#: Reference base at p (from 0) of contig c, and a read's base there, which differs for some.
REF = "substr('ACGNT', cast(1 + (p * 7 + c * 3 + p // 5) % 5 AS int), 1)"
OBS = f"w AS (SELECT k, substr(rname, 4)::BIGINT AS c, rname, flag, mapq, unnest(range(s - 1, e - 1)) AS p, s, unnest(range(1, e - s + 1)) AS i FROM (SELECT b.*, mapq FROM (SELECT rname, flag, k, mapq, pos AS s, pos + m AS e, 0 AS z FROM x UNION ALL SELECT rname, flag, k, mapq, pos + m + 2, pos + m + 5, 1 FROM x WHERE cigar LIKE '%2D3M') b)), o AS (SELECT rname AS contig, p + 1 AS pos, {REF} AS ref, CASE WHEN (k + p) % 11 = 0 THEN 'G' WHEN (k + p) % 53 = 0 THEN 'N' ELSE {REF} END AS base, ((k + p) % 30 + 10)::INT AS quality FROM w WHERE {CLASS} = 'eligible')"
OCLASS = "CASE WHEN NOT contains('ACGT', ref) THEN 'reference_not_canonical' WHEN NOT contains('ACGT', base) THEN 'read_ambiguous' WHEN quality < 20 THEN 'low_quality' ELSE 'callable' END"
ALIGNED = f"{BLOCKS}, {OBS}, oc AS (SELECT *, {OCLASS} AS class FROM o), pile AS (SELECT contig, pos, ref, base, count(*) AS n, sum(quality)::BIGINT AS qsum FROM oc WHERE class = 'callable' GROUP BY ALL), site AS (SELECT *, sum(n) OVER (PARTITION BY contig, pos)::BIGINT AS depth FROM pile), alt AS (SELECT *, round(n / depth, 6) AS fraction, round(qsum / n, 6) AS abq FROM site WHERE depth >= 3 AND base <> ref AND n >= 2 AND n / depth + 2.220446049250313e-16 >= 0.2)"


def reference(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, PERIOD)), F.substr("contig", F.lit(4)).cast("int") % 5 + 1)
    return dictionary(spark, d).select("contig", F.substr(F.repeat(text, F.ceil(F.col("length") / 25).cast("int")), F.lit(1), F.col("length").cast("int")).alias("seq"))


def sequenced(spark: SparkSession, d: str) -> DataFrame:
    """Records with bases and qualities of the same rule as the DuckDB form's; soft-clipped bases are A of the least quality. Columns of one function each, so that
    filters on records come before them and records whose bases nobody asks for get none."""
    table = np.array([list(text.encode()) for text in PERIOD])

    @F.arrow_udf("string")
    def seq(rname: pa.Array, pos: pa.Array, cigar: pa.Array, k: pa.Array) -> pa.Array:
        row, p, q, clipped, cuts = aligned_letters(pos, cigar, k)
        contig = pc.cast(pc.utf8_slice_codeunits(rname, 3), pa.int64()).to_numpy() % 5
        return strings(np.where(clipped, ord("A"), np.where(q % 11 == 0, ord("G"), np.where(q % 53 == 0, ord("N"), table[contig[row], p % 25]))), cuts)

    @F.arrow_udf("string")
    def qual(pos: pa.Array, cigar: pa.Array, k: pa.Array) -> pa.Array:
        _, _, q, clipped, cuts = aligned_letters(pos, cigar, k)
        return strings(np.where(clipped, ord("!"), q % 30 + 43), cuts)

    return records(spark, d).withColumns({"seq": seq("rname", "pos", "cigar", "k"), "qual": qual("pos", "cigar", "k")})


@query("P21_P26_J6_observations", f"{D}, {ALIGNED} SELECT contig, class, base, count(*) AS n, sum(quality)::BIGINT AS quality FROM oc GROUP BY contig, class, base")
def _(spark, d):
    return A.counted_observations(sequenced(spark, d), reference(spark, d)).groupBy("contig", "class", "base").agg(F.sum("n").alias("n"), F.sum("qsum").alias("quality"))


@query("A16_W5_pileup", f"{D}, {ALIGNED} SELECT contig, pos, ref, base, n, qsum, depth FROM site")
def _(spark, d):
    return A.pileup_with_depth(A.counted_observations(sequenced(spark, d), reference(spark, d)))


@query("A17_F9_O4_call_snvs", f"{D}, {ALIGNED} SELECT contig, pos, ref, depth, base AS alt, n, fraction, abq FROM alt")
def _(spark, d):
    c = A.call_snvs(A.pileup(A.counted_observations(sequenced(spark, d), reference(spark, d))))
    return c.select("contig", "pos", "ref", "depth", F.explode("alts").alias("a")).select("contig", "pos", "ref", "depth", F.col("a.base").alias("alt"), F.col("a.n").alias("n"), F.col("a.fraction").alias("fraction"), F.col("a.abq").alias("abq")).orderBy("contig", "pos")


@query("A18_snv_summary", f"{D}, {ALIGNED} SELECT (SELECT count(*) FROM alignments) AS records, {', '.join(f'''(SELECT count(*) FROM alignments WHERE {CLASS} = '{c}') AS records_{c}''' for c in A.ELIGIBILITY)}, {', '.join(f'''(SELECT count(*) FROM oc WHERE class = '{c}') AS observations_{c}''' for c in A.OBSERVATIONS)}, (SELECT count(*) FROM (SELECT DISTINCT contig, pos FROM site)) AS sites, (SELECT count(*) FROM (SELECT DISTINCT contig, pos FROM site WHERE depth >= 3)) AS sites_at_depth, (SELECT count(*) FROM (SELECT DISTINCT contig, pos FROM alt)) AS called_sites, (SELECT count(*) FROM alt) AS called_alleles")
def _(spark, d):
    r = sequenced(spark, d)
    return A.snv_summary(r, A.counted_observations(r, reference(spark, d)))


@query("SNK6_variant_table", f"{D}, {ALIGNED} SELECT contig, pos::VARCHAR AS pos, ref, base AS alt, depth::VARCHAR AS dp, n::VARCHAR AS ac, printf('%.6f', fraction) AS af, printf('%.6f', abq) AS abq FROM alt")
def _(spark, d):
    from helix.operators.variants import to_variant_table

    return to_variant_table(A.call_snvs(A.pileup(A.counted_observations(sequenced(spark, d), reference(spark, d)))))


