"""Queries of variant operators over records derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helix.functions.vcf import filter_error, info_error, info_per_allele, info_scalar, parse_filter, parse_info, ti_tv, tsv_safe, variant_key, variant_type, vcf_escape
from helix.operators import variants as V
from helix.operators.alignments import duplicates
from helix.options import VcfQcOptions
from helix.plans.adapters import duck, table
from helix.registry import query

D = duck("variants")
OPTIONS = VcfQcOptions(min_dp=4, min_ac=2, min_af=0.2, min_abq=20.5)


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "variants")


def val(k: str) -> str:
    return f"regexp_extract(info, '(?:^|;){k}=([^;]*)', 1)"


ALLELES = f"r AS (SELECT *, string_split(alt, ',') AS alts, CASE WHEN {val('DP')} = '' THEN NULL ELSE {val('DP')}::BIGINT END AS dp, CASE WHEN {val('AC')} <> '' THEN string_split({val('AC')}, ',') END AS acs, CASE WHEN {val('AF')} <> '' THEN string_split({val('AF')}, ',') END AS afs, CASE WHEN {val('ABQ')} <> '' THEN string_split({val('ABQ')}, ',') END AS abqs FROM variants), a AS (SELECT ordinal, chrom, pos, ref, flt, info, dp, acs, afs, abqs, cust, prio, unnest(alts) AS alt, unnest(range(1, len(alts) + 1)) AS i FROM r)"
TYPE = "CASE WHEN regexp_matches(alt, '^<.*>$') OR regexp_matches(alt, '[\\[\\]]') OR alt = '*' THEN 'symbolic' WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snv' WHEN length(ref) = length(alt) THEN 'mnv' WHEN length(alt) > length(ref) THEN 'insertion_like' ELSE 'deletion_like' END"
CHANGE = f"CASE WHEN {TYPE} = 'snv' THEN CASE WHEN ref || alt IN ('AG', 'GA', 'CT', 'TC') THEN 'transition' ELSE 'transversion' END END"
METRICS = f"m AS (SELECT *, acs[i]::BIGINT AS ac, afs[i]::DOUBLE AS af, abqs[i]::DOUBLE AS abq, {TYPE} AS type, {CHANGE} AS change FROM a)"
SOFT = "s AS (SELECT *, list_filter([CASE WHEN dp IS NULL THEN 'MissingDP' WHEN dp < 4 THEN 'LowDP' END, CASE WHEN ac IS NULL THEN 'MissingAC' WHEN ac < 2 THEN 'LowAC' END, CASE WHEN af IS NULL THEN 'MissingAF' WHEN af + 2.220446049250313e-16 < 0.2 THEN 'LowAF' END, CASE WHEN abq IS NULL THEN 'MissingABQ' WHEN abq + 2.220446049250313e-16 < 20.5 THEN 'LowABQ' END], lambda x: x IS NOT NULL) AS soft, CASE flt WHEN 'PASS' THEN [] WHEN '.' THEN ['Unfiltered'] ELSE string_split(flt, ';') END AS input FROM m), z AS (SELECT *, list_concat(input, soft) AS reasons FROM s)"
FULL = f"{D}, {ALLELES}, {METRICS}, {SOFT}"
# the reasons of both alleles, each once, in the order of the first allele that has it
FILTER = "g AS (SELECT ordinal, any_value(flt) AS flt, any_value(input) AS input, list(soft ORDER BY i) AS softs FROM z GROUP BY ordinal), f AS (SELECT ordinal, flt, list_concat(input, list_concat(softs[1], list_filter(coalesce(softs[2], []), lambda x: NOT list_contains(softs[1], x)))) AS l FROM g), o AS (SELECT ordinal, flt, CASE WHEN len(l) = 0 THEN 'PASS' ELSE array_to_string(l, ';') END AS out_filter FROM f)"


def qc(spark: SparkSession, d: str) -> DataFrame:
    return V.qc_records(records(spark, d), OPTIONS)


@query("P30_parse_info", f"{D} SELECT ordinal, len(string_split(info, ';')) * (info <> '.')::INT AS n_keys, CASE WHEN {val('AF')} = '' THEN NULL ELSE {val('AF')} END AS af, info = '' AS bad FROM variants")
def _(spark, d):
    return records(spark, d).select("ordinal", F.size(parse_info("info")).cast("long").alias("n_keys"), F.try_element_at(parse_info("info"), F.lit("AF")).alias("af"), info_error("info").isNotNull().alias("bad"))


@query("P31_info_values", f"{D}, {ALLELES} SELECT ordinal, dp, array_to_string(list_transform(acs, lambda x: x::BIGINT), ',') AS ac, list_sum(list_transform(afs, lambda x: x::DOUBLE)) AS af_sum, list_max(list_transform(abqs, lambda x: x::DOUBLE)) AS abq_max FROM r")
def _(spark, d):
    n = F.size(F.split("alt", ","))
    return records(spark, d).select("ordinal", info_scalar("info", "DP").alias("dp"), F.array_join(info_per_allele("info", "AC", n, "long").cast("array<string>"), ",").alias("ac"), F.aggregate(info_per_allele("info", "AF", n, "double", 0, 1), F.lit(0.0), lambda a, x: a + x).alias("af_sum"), F.array_max(info_per_allele("info", "ABQ", n, "double", 0, 10000)).alias("abq_max"))


@query("P32_P35_alleles", f"{FULL} SELECT ordinal, alt, i::INT AS allele_index, type, change, chrom || ':' || pos || ':' || ref || ':' || alt AS key FROM m")
def _(spark, d):
    a = records(spark, d).select("ordinal", "chrom", "pos", "ref", F.posexplode(F.split("alt", ",")).alias("i", "alt"))
    return a.select("ordinal", "alt", (F.col("i") + 1).alias("allele_index"), variant_type("ref", "alt").alias("type"), ti_tv("ref", "alt").alias("change"), variant_key("chrom", "pos", "ref", "alt").alias("key"))


@query("P36_parse_filter", f"{D} SELECT ordinal, array_to_string(CASE flt WHEN 'PASS' THEN [] WHEN '.' THEN ['Unfiltered'] ELSE string_split(flt, ';') END, ',') AS filters, false AS bad FROM variants")
def _(spark, d):
    return records(spark, d).select("ordinal", F.array_join(parse_filter("flt"), ",").alias("filters"), filter_error("flt").isNotNull().alias("bad"))


@query("P37_P38_soft_filters", f"{FULL} SELECT ordinal, i::INT AS allele_index, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed FROM z")
def _(spark, d):
    each = qc(spark, d).select("ordinal", F.posexplode_outer("reasons").alias("i", "r")).filter("i IS NOT NULL")  # see explode_alleles
    return each.select("ordinal", (F.col("i") + 1).alias("allele_index"), F.array_join("r", ",").alias("reasons"), (F.size("r") == 0).alias("passed"))


@query("P39_U4_record_filter", f"{FULL}, {FILTER} SELECT ordinal, out_filter, out_filter = 'PASS' AS passed FROM o")
def _(spark, d):
    return qc(spark, d).select("ordinal", "out_filter", "passed")


@query("P40_P41_escape", f"{D} SELECT ordinal, replace(replace(replace(replace(prio || ' & ' || alt, '&', '%26'), ' ', '%20'), '<', '%3C'), '>', '%3E').replace(',', '%2C') AS escaped, translate(prio || chr(9) || alt, chr(9), ' ') AS safe FROM variants")
def _(spark, d):
    return records(spark, d).select("ordinal", vcf_escape(F.concat("prio", F.lit(" & "), "alt")).alias("escaped"), tsv_safe(F.concat_ws("\t", "prio", "alt")).alias("safe"))


SUM = ", ".join(f"count_if(type = '{t}') AS {t}_alleles" for t in V.TYPES) + ", " + ", ".join(f"count_if({m} IS NULL) AS missing_{m}" for m in ("dp", "ac", "af", "abq"))


@query("A19_A22_F10_vcf_qc_summary", f"{FULL}, {FILTER}, rr AS (SELECT count(*) AS records, count_if(out_filter = 'PASS') AS passed_records, count_if(out_filter <> 'PASS') AS filtered_records, count_if(flt = '.') AS unfiltered_records, count_if(flt NOT IN ('PASS', '.')) AS prefiltered_records FROM o), aa AS (SELECT count(*) AS alleles, count_if(len(reasons) = 0) AS passed_alleles, count_if(len(reasons) > 0) AS filtered_alleles, {SUM}, count_if(change = 'transition') AS transitions, count_if(change = 'transversion') AS transversions FROM z) SELECT *, round(transitions / nullif(transversions, 0), 6) AS ti_tv FROM rr, aa")
def _(spark, d):
    return V.vcf_qc_summary(qc(spark, d))


@query("A20_filter_reasons", f"{FULL} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM z) x WHERE reason NOT IN ('q10', 's50') GROUP BY reason")
def _(spark, d):
    return V.filter_reason_counts(qc(spark, d))


@query("A21_contig_records", f"{D} SELECT chrom, count(*) AS records FROM variants GROUP BY chrom")
def _(spark, d):
    return V.contig_record_counts(records(spark, d))


@query("SNK6_vcf_qc_table", f"{FULL}, {FILTER} SELECT chrom || ':' || pos || ':' || ref || ':' || alt AS key, chrom, pos::VARCHAR AS pos, ref, alt, i::VARCHAR AS allele_index, type, z.flt, out_filter, coalesce(dp::VARCHAR, '.') AS dp, coalesce(ac::VARCHAR, '.') AS ac, CASE WHEN af IS NULL THEN '.' ELSE printf('%.6f', af) END AS af, CASE WHEN abq IS NULL THEN '.' ELSE printf('%.6f', abq) END AS abq, CASE WHEN len(reasons) = 0 THEN 'PASS' ELSE 'FILTERED' END AS decision FROM z JOIN o USING (ordinal)")
def _(spark, d):
    return V.to_vcf_qc_table(V.explode_alleles(qc(spark, d)))


NOTES = f"{ALLELES}, notes AS (SELECT DISTINCT chrom || ':' || pos || ':' || ref || ':' || alt AS key, concat('G', cust % 50) AS gene, prio AS consequence, CASE WHEN ordinal % 2 = 0 THEN '.' ELSE 'Benign & likely' END AS clinical_significance, 'local' AS source, '' AS source_id FROM a WHERE ordinal % 3 = 0), j AS (SELECT a.*, chrom || ':' || pos || ':' || ref || ':' || a.alt AS key, gene IS NOT NULL AS hit, coalesce(gene, '.') AS gene, coalesce(consequence, '.') AS consequence, coalesce(clinical_significance, '.') AS clinical_significance, coalesce(source, '.') AS source, coalesce(source_id, '.') AS source_id FROM a LEFT JOIN notes ON notes.key = chrom || ':' || pos || ':' || ref || ':' || a.alt)"


def notes(spark: SparkSession, d: str) -> DataFrame:
    a = records(spark, d).filter("ordinal % 3 = 0").select("*", F.explode(F.split("alt", ",")).alias("one"))
    return a.select(variant_key("chrom", "pos", "ref", "one").alias("key"), F.concat(F.lit("G"), F.col("cust") % 50).alias("gene"), F.col("prio").alias("consequence"), F.when(F.col("ordinal") % 2 == 0, ".").otherwise("Benign & likely").alias("clinical_significance"), F.lit("local").alias("source"), F.lit("").alias("source_id"))


def annotated(spark: SparkSession, d: str) -> DataFrame:
    return V.annotate(records(spark, d), notes(spark, d))


@query("J8_annotate", f"{D}, {NOTES} SELECT key, hit, gene, consequence, clinical_significance FROM j")
def _(spark, d):
    return annotated(spark, d).select("key", "hit", "gene", "consequence", "clinical_significance")


@query("SNK6_annotation_table", f"{D}, {NOTES} SELECT key, chrom, pos, ref, alt, flt, hit::INT AS hit, gene, consequence, clinical_significance, source, source_id FROM j")
def _(spark, d):
    return V.to_annotation_table(annotated(spark, d))


@query("P42_append_info", f"{D}, {NOTES}, e AS (SELECT ordinal, info, string_agg(gene, ',' ORDER BY i) AS g, string_agg(replace(replace(consequence, ' ', '%20'), '&', '%26'), ',' ORDER BY i) AS c, string_agg(replace(replace(clinical_significance, ' ', '%20'), '&', '%26'), ',' ORDER BY i) AS s, string_agg(CASE WHEN source = '' THEN '.' ELSE source END, ',' ORDER BY i) AS o, string_agg('.', ',' ORDER BY i) AS x FROM j GROUP BY ordinal, info) SELECT ordinal, CASE WHEN info = '.' THEN '' ELSE info || ';' END || 'ANN_GENE=' || g || ';ANN_CSQ=' || c || ';ANN_CLNSIG=' || s || ';ANN_SOURCE=' || o || ';ANN_SOURCE_ID=' || x AS info FROM e")
def _(spark, d):
    return V.append_info(records(spark, d), annotated(spark, d)).select("ordinal", "info")


@query("A23_F11_annotation_summary", f"{D}, {NOTES} SELECT (SELECT count(*) FROM variants) AS records, (SELECT count(*) FROM variants WHERE flt = 'PASS') AS pass_records, (SELECT count(*) FROM variants WHERE flt <> 'PASS') AS filtered_records, count(*) AS alleles, count_if(hit) AS hits, count_if(NOT hit) AS misses, (SELECT count(*) FROM notes) AS annotation_rows, round(100.0 * count_if(hit) / count(*), 6) AS hit_rate_percent FROM j")
def _(spark, d):
    return V.annotation_summary(annotated(spark, d), records(spark, d), notes(spark, d))


@query("A24_O5_top_genes", f"{D}, {NOTES} SELECT gene AS value, count(*) AS n FROM j WHERE hit GROUP BY gene ORDER BY n DESC, value LIMIT 10")
def _(spark, d):
    return V.top_values(annotated(spark, d), "gene")


@query("O6_preview", f"{D}, {NOTES} SELECT key, gene FROM j WHERE hit ORDER BY ordinal, i LIMIT 500")
def _(spark, d):
    return V.preview(annotated(spark, d)).select("key", "gene")


@query("V28_annotation_keys", f"{D}, {NOTES} SELECT gene, consequence, count(*) AS count FROM notes GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return duplicates(notes(spark, d), "gene", "consequence")
