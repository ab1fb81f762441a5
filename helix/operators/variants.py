"""Quality filters of variant records, and their annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helix.functions.common import count_if, ratio
from helix.functions.vcf import filter_error, info_error, info_per_allele, info_scalar, parse_filter, ti_tv, tsv_safe, variant_key, variant_type, vcf_escape
from helix.options import VcfQcOptions

EPSILON = 2.220446049250313e-16
TYPES = ("snv", "mnv", "insertion_like", "deletion_like", "symbolic", "complex")
#: The names of the soft filters, in the order in which they are tried.
REASONS = ("MissingDP", "LowDP", "MissingAC", "LowAC", "MissingAF", "LowAF", "MissingABQ", "LowABQ")
ANNOTATIONS = ("gene", "consequence", "clinical_significance", "source", "source_id")
INFO_IDS = ("ANN_GENE", "ANN_CSQ", "ANN_CLNSIG", "ANN_SOURCE", "ANN_SOURCE_ID")


def record_error(df: DataFrame) -> DataFrame:
    """Records (info, flt) with error: what is wrong with INFO or FILTER, or null."""
    return df.withColumn("error", F.coalesce(info_error("info"), filter_error("flt")))


def qc_records(df: DataFrame, options: VcfQcOptions = VcfQcOptions()) -> DataFrame:
    """Records (chrom, pos, ref, alt, flt, info) with alts, metrics, reasons (array of reasons for each allele), out_filter and passed.

    An input filter counts as a reason of every allele; "." as Unfiltered. A metric that is missing fails if its filter is on.
    """
    alts = F.split("alt", ",")
    n = F.size("alts")
    d = df.withColumn("alts", alts).withColumn("dp", info_scalar("info", "DP")).withColumns({
        "acs": info_per_allele("info", "AC", n, "long"), "afs": info_per_allele("info", "AF", n, "double", 0, 1), "abqs": info_per_allele("info", "ABQ", n, "double", 0, 10_000), "input": parse_filter("flt"),
    })

    def checks(i):
        none = F.lit(None).cast("string")
        each = [
            none if options.min_dp is None else F.when(F.col("dp").isNull(), "MissingDP").when(F.col("dp") < options.min_dp, "LowDP"),
            none if options.min_ac is None else F.when(F.col("acs").isNull(), "MissingAC").when(F.get("acs", i) < options.min_ac, "LowAC"),
            none if options.min_af is None else F.when(F.col("afs").isNull(), "MissingAF").when(F.get("afs", i) + EPSILON < options.min_af, "LowAF"),
            none if options.min_abq is None else F.when(F.col("abqs").isNull(), "MissingABQ").when(F.get("abqs", i) + EPSILON < options.min_abq, "LowABQ"),
        ]
        return F.array_compact(F.array(*each))

    d = d.withColumn("soft", F.transform("alts", lambda a, i: checks(i)))
    d = d.withColumn("reasons", F.transform("soft", lambda s: F.concat(F.col("input"), s)))
    joined = F.array_join(F.array_distinct(F.concat("input", F.flatten("soft"))), ";")
    return d.withColumn("out_filter", F.when(joined == "", "PASS").otherwise(joined)).withColumn("passed", F.col("out_filter") == "PASS")


def explode_alleles(qc: DataFrame) -> DataFrame:
    """A row for each alternate allele: allele_index from 1, alt, type, change, key, its metrics, reasons and decision."""
    # without outer, Spark filters on the array's size first, and carries that with all that the array is computed from down to the scan
    d = qc.select("chrom", "pos", "ref", "flt", "out_filter", "dp", F.posexplode_outer(F.arrays_zip("alts", "reasons", "soft")).alias("i", "a"), "acs", "afs", "abqs").filter("i IS NOT NULL")
    return d.select(
        "chrom", "pos", "ref", F.col("a.alts").alias("alt"), (F.col("i") + 1).alias("allele_index"), variant_type("ref", "a.alts").alias("type"), ti_tv("ref", "a.alts").alias("change"), variant_key("chrom", "pos", "ref", "a.alts").alias("key"), "flt",
        "out_filter", "dp", F.get("acs", F.col("i")).alias("ac"), F.get("afs", F.col("i")).alias("af"), F.get("abqs", F.col("i")).alias("abq"), F.col("a.reasons").alias("reasons"), F.col("a.soft").alias("soft"), (F.size("a.reasons") == 0).alias("passed"),
    )


def vcf_qc_summary(qc: DataFrame) -> DataFrame:
    """One row: records and alleles by decision, alleles by type, missing metrics, records by input filter, transitions, transversions and their ratio (null without the latter)."""
    r = qc.agg(F.count("*").alias("records"), count_if(F.col("passed")).alias("passed_records"), count_if(~F.col("passed")).alias("filtered_records"), count_if(F.col("flt") == ".").alias("unfiltered_records"), count_if(~F.col("flt").isin("PASS", ".")).alias("prefiltered_records"))
    a = explode_alleles(qc).agg(
        F.count("*").alias("alleles"), count_if(F.col("passed")).alias("passed_alleles"), count_if(~F.col("passed")).alias("filtered_alleles"), *[count_if(F.col("type") == t).alias(f"{t}_alleles") for t in TYPES],
        *[count_if(F.col(m).isNull()).alias(f"missing_{m}") for m in ("dp", "ac", "af", "abq")], count_if(F.col("change") == "transition").alias("transitions"), count_if(F.col("change") == "transversion").alias("transversions"),
    )
    return r.crossJoin(a).withColumn("ti_tv", F.round(F.col("transitions") / F.nullif(F.col("transversions"), F.lit(0)), 6))  # one row each


def filter_reason_counts(qc: DataFrame) -> DataFrame:
    """reason, n: the soft filters' reasons of alleles, and Unfiltered; other input filters aren't counted."""
    mine = F.transform("reasons", lambda rs: F.filter(rs, lambda r: r.isin("Unfiltered", *REASONS)))
    return qc.select(F.explode(F.flatten(mine)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def contig_record_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("chrom").agg(F.count("*").alias("records"))


def annotate(records: DataFrame, annotations: DataFrame) -> DataFrame:
    """Records (ordinal, chrom, pos, ref, alt, flt) -> a row for each allele with the annotation of its key: key, hit and five columns, "." where there is none.

    annotations (key and the five) must have each key once: see duplicates().
    """
    a = records.select("ordinal", "chrom", "pos", "ref", "flt", F.posexplode(F.split("alt", ",")).alias("i", "alt")).withColumn("key", variant_key("chrom", "pos", "ref", "alt"))
    known = annotations.select(F.col("key").alias("_k"), F.lit(True).alias("hit"), *ANNOTATIONS)
    j = a.join(known, F.col("key") == F.col("_k"), "left").drop("_k").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return j.withColumns({c: F.when(F.col("hit"), F.coalesce(c, F.lit(""))).otherwise(".") for c in ANNOTATIONS})


def append_info(records: DataFrame, annotated: DataFrame) -> DataFrame:
    """Records with five lists, a value for each allele, put after what INFO has."""
    value = lambda c: F.when(F.col("hit"), vcf_escape(c)).otherwise(".")
    lists = annotated.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("i", *[value(c).alias(c) for c in ANNOTATIONS]))).alias("v"))  # as many as the record has alleles
    extra = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), F.array_join(F.col(f"v.{c}"), ",")) for k, c in zip(INFO_IDS, ANNOTATIONS, strict=True)])
    return records.join(lists.select("ordinal", extra.alias("_extra")), "ordinal").withColumn("info", F.when(F.col("info").isin(".", ""), F.col("_extra")).otherwise(F.concat_ws(";", "info", "_extra"))).drop("_extra")


def annotation_summary(annotated: DataFrame, records: DataFrame, annotations: DataFrame) -> DataFrame:
    r = records.agg(F.count("*").alias("records"), count_if(F.col("flt") == "PASS").alias("pass_records"), count_if(F.col("flt") != "PASS").alias("filtered_records"))
    a = annotated.agg(F.count("*").alias("alleles"), count_if(F.col("hit")).alias("hits"), count_if(~F.col("hit")).alias("misses"))
    return r.crossJoin(a).crossJoin(annotations.agg(F.count("*").alias("annotation_rows"))).withColumn("hit_rate_percent", ratio(F.col("hits"), F.col("alleles"), 100))


def top_values(annotated: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values among hits, equally frequent ones by name."""
    some = annotated.filter("hit").filter(~F.col(column).isin(".", ""))
    return some.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def preview(annotated: DataFrame, n: int = 500) -> DataFrame:
    """The first n hits in file order."""
    return annotated.filter("hit").orderBy("ordinal", "i").limit(n)


def to_annotation_table(annotated: DataFrame) -> DataFrame:
    return annotated.select("key", "chrom", "pos", "ref", "alt", "flt", F.col("hit").cast("int").alias("hit"), *[tsv_safe(c).alias(c) for c in ANNOTATIONS])


def to_vcf_qc_table(alleles: DataFrame) -> DataFrame:
    """The rows of explode_alleles as text, "." for what is missing."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    number = lambda c: F.coalesce(F.format_string("%.6f", F.col(c)), F.lit("."))
    return alleles.select("key", "chrom", text("pos").alias("pos"), "ref", "alt", text("allele_index").alias("allele_index"), "type", "flt", "out_filter", text("dp").alias("dp"), text("ac").alias("ac"), F.when(F.col("af").isNull(), ".").otherwise(number("af")).alias("af"), F.when(F.col("abq").isNull(), ".").otherwise(number("abq")).alias("abq"), F.when(F.col("passed"), "PASS").otherwise("FILTERED").alias("decision"))


def to_variant_table(calls: DataFrame) -> DataFrame:
    """A row for each called allele, as text."""
    c = calls.select("contig", "pos", "ref", "depth", F.explode("alts").alias("a"))
    return c.select("contig", F.col("pos").cast("string").alias("pos"), "ref", F.col("a.base").alias("alt"), F.col("depth").cast("string").alias("dp"), F.col("a.n").cast("string").alias("ac"), F.format_string("%.6f", F.col("a.fraction")).alias("af"), F.format_string("%.6f", F.col("a.abq")).alias("abq"))
