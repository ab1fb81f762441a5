"""Column functions for SQL users: SQL functions and table functions, whose bodies are the column forms' own SQL text, so nothing runs in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from helix.functions import alignment as A
from helix.functions import fastq as Q
from helix.functions import jobs as J
from helix.functions import sequence as S
from helix.functions import vcf as V
from helix.functions.common import count_of, ratio

C = F.col


def scalars() -> tuple[tuple[str, str, Column], ...]:
    """Functions of a row: name, parameters, the column form over these."""
    ops = A.parse_cigar("cigar")
    return (
        ("base_composition", "seq STRING", S.base_composition("seq")), ("fasta_error", "header STRING, seq STRING", S.fasta_error("header", "seq")), ("revcomp", "seq STRING", S.revcomp("seq")),
        ("contig_name", "header STRING", S.contig_name("header")), ("canonical_hamming", "a STRING, b STRING", S.canonical_hamming("a", "b")), ("gc", "seq STRING", count_of(F.upper("seq"), "GC")),
        ("phred", "qual STRING", Q.phred("qual")), ("quality_profile", "qual STRING", Q.profile_expression("qual")), ("fastq_error", "header STRING, seq STRING, separator STRING, qual STRING", Q.fastq_error("header", "seq", "separator", "qual")),
        ("read_name", "header STRING", Q.read_name("header")), ("mate_identity", "header STRING", Q.mate_identity("header")),
        ("adapter_position", "seq STRING, adapter STRING, min_overlap INT, max_mismatches INT", Q.adapter_position("seq", C("adapter"), C("min_overlap"), C("max_mismatches"))), ("quality_trim_length", "qual STRING, upto INT", Q.quality_trim_length("qual", C("upto"))),
        ("has_flag", "flag INT, mask INT", F.expr("flag & mask") != 0), ("decode_flags", "flag INT", A.decode_flags("flag")), ("flag_error", "flag INT", A.flag_error("flag")), ("is_primary", "flag INT", A.is_primary("flag")),
        ("is_primary_mapped", "flag INT", A.is_primary_mapped("flag")), ("eligibility", "flag INT, mapq INT", A.eligibility("flag", "mapq")), ("cigar_valid", "cigar STRING", A.cigar_valid("cigar")), ("parse_cigar", "cigar STRING", ops),
        ("read_span", "cigar STRING", A.read_span(ops)), ("ref_span", "cigar STRING", A.ref_span(ops)), ("cigar_walk_array", "cigar STRING", A.cigar_walk(ops)), ("cigar_blocks_array", "pos BIGINT, cigar STRING", A.cigar_blocks("pos", ops)),
        ("bounds_error", "pos BIGINT, cigar STRING, contig_length BIGINT, seq STRING", A.bounds_error("pos", ops, C("contig_length"), C("seq"))), ("nm_tag", "tags ARRAY<STRING>", A.nm_tag("tags")), ("mapq_bin", "mapq INT", A.mapq_bin("mapq")),
        ("tlen_eligible", "flag INT, rname STRING, rnext STRING, tlen BIGINT", A.tlen_eligible("flag", "rname", "rnext", "tlen")),
        ("observation_class", "ref_base STRING, read_base STRING, quality INT", A.observation_class(C("ref_base"), C("read_base"), C("quality"))),
        ("template_length", "same_contig BOOLEAN, pos BIGINT, length BIGINT, mate_pos BIGINT, mate_length BIGINT, is_read1 BOOLEAN", A.template_length(C("same_contig"), C("pos"), C("length"), C("mate_pos"), C("mate_length"), C("is_read1"))),
        ("info_error", "info STRING", V.info_error("info")), ("parse_info", "info STRING", V.parse_info("info")), ("info_value", "info STRING, key STRING", F.try_element_at(V.parse_info("info"), C("key"))),
        ("info_scalar", "info STRING, key STRING", F.regexp_extract(F.try_element_at(V.parse_info("info"), C("key")), "^([0-9]+)$", 1).try_cast("long")), ("variant_type", "ref STRING, alt STRING", V.variant_type("ref", "alt")),
        ("ti_tv", "ref STRING, alt STRING", V.ti_tv("ref", "alt")), ("variant_key", "chrom STRING, pos BIGINT, ref STRING, alt STRING", V.variant_key("chrom", "pos", "ref", "alt")), ("filter_error", "flt STRING", V.filter_error("flt")),
        ("parse_filter", "flt STRING", V.parse_filter("flt")), ("vcf_escape", "v STRING", V.vcf_escape("v")), ("tsv_safe", "v STRING", V.tsv_safe("v")), ("infer_file_type", "name STRING", J.infer_file_type("name")),
        ("artifact_category", "file_type STRING, port STRING", J.artifact_category("file_type", "port")), ("clamp_progress", "p DOUBLE", J.clamp_progress("p")), ("ratio", "a DOUBLE, b DOUBLE, scale DOUBLE", ratio(C("a"), C("b"), C("scale"))),
    )


def tables() -> tuple[tuple[str, str, str, Column], ...]:
    """Table functions: name, parameters, columns, an array of structs with these."""
    ops = A.parse_cigar("cigar")
    return (
        ("cigar_walk", "cigar STRING", "op STRING, n BIGINT, ref BIGINT, read BIGINT", A.cigar_walk(ops)), ("cigar_blocks", "pos BIGINT, cigar STRING", "s BIGINT, e BIGINT", A.cigar_blocks("pos", ops)),
        ("explode_alleles", "alt STRING", "allele_index INT, allele STRING", F.transform(F.split("alt", ","), lambda a, i: F.struct((i + 1).alias("allele_index"), a.alias("allele")))),
    )


#: The N50 of a histogram of lengths, which is what tasks add up and merge: SELECT helix_n50(map_from_entries(collect_list(struct(l, n)))) FROM (SELECT l, count(*) n .. GROUP BY l).
N50 = """aggregate(array_sort(map_entries(lengths), (x, y) -> CASE WHEN x.key > y.key THEN -1 WHEN x.key < y.key THEN 1 ELSE 0 END),
  named_struct('left', aggregate(map_entries(lengths), cast(0 AS DECIMAL(38, 0)), (t, e) -> cast(t + cast(e.key AS DECIMAL(19, 0)) * cast(e.value AS DECIMAL(19, 0)) AS DECIMAL(38, 0))), 'sum', cast(0 AS DECIMAL(38, 0)), 'n50', 0L),
  (a, e) -> named_struct('left', a.left, 'sum', cast(a.sum + cast(e.key AS DECIMAL(19, 0)) * cast(e.value AS DECIMAL(19, 0)) AS DECIMAL(38, 0)), 'n50', CASE WHEN 2 * a.sum < a.left THEN e.key ELSE a.n50 END), a -> a.n50)"""

_LITERAL, _OPERATOR = re.compile(r"('(?:[^'\\]|\\.|'')*')"), re.compile(r"(?<![\w`>])(!|<=>|<=|>=|<>|=|<|>|\+|-|\*|/|%|&|\||\^|in|or|and|not)\(")


def sql_text(column: Column) -> str:
    """A column's text as SQL that can be parsed: operators, which it names before their operands, as quoted functions."""
    parts = _LITERAL.split(column._jc.node().sql())
    return "".join(p if i % 2 else _OPERATOR.sub(r"`\1`(", p) for i, p in enumerate(parts))


def register_functions(spark: SparkSession) -> None:
    """Temporary functions of this session, helix_<name>, and the data sources fastq and bam."""
    from helix.sources.fastq import FastqSource
    from helix.sources.sam import BamSource

    for name, parameters, column in scalars():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION helix_{name}({parameters}) RETURN {sql_text(column)}")
    for name, parameters, columns, column in tables():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION helix_{name}({parameters}) RETURNS TABLE ({columns}) RETURN SELECT x.* FROM explode({sql_text(column)}) t(x)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION helix_n50(lengths MAP<BIGINT, BIGINT>) RETURNS BIGINT RETURN {N50}")
    spark.dataSource.register(FastqSource)
    spark.dataSource.register(BamSource)
