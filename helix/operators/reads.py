"""Quality control and trimming of FASTA and FASTQ reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helix.functions.common import count_if, ratio
from helix.functions.fastq import adapter_position, mate_identity, quality_profile, quality_trim_length
from helix.functions.sequence import base_composition
from helix.options import TrimOptions


def n50(df: DataFrame, length: str = "length", by: Sequence[str] = ()) -> DataFrame:
    """by, n50: the length at which the longest first reach half of all. Lengths are counted before the window, so it sees the distinct ones only."""
    lengths = df.groupBy(*by, F.col(length).alias("_l")).agg((F.count("*") * F.col("_l")).alias("_b"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    reached = lengths.withColumn("_c", F.sum("_b").over(group.orderBy(F.desc("_l")))).withColumn("_t", F.sum("_b").over(group))
    return reached.filter(F.col("_c") >= F.ceil(F.col("_t") / 2)).groupBy(*by).agg(F.max("_l").cast("long").alias("n50"))


def fasta_qc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Records (seq) -> counters, average length, GC share of canonical bases, shares of N and ambiguous bases among all; percentages."""
    c = df.withColumn("_c", base_composition("seq")).withColumn("_l", F.length("seq"))
    sums = c.groupBy(*by).agg(
        F.count("*").alias("sequences"), F.coalesce(F.sum("_l"), F.lit(0)).alias("bases"), F.min("_l").cast("long").alias("min_length"), F.max("_l").cast("long").alias("max_length"),
        *[F.coalesce(F.sum(f"_c.{k}"), F.lit(0)).alias(n) for k, n in (("canonical", "canonical_bases"), ("gc", "gc_bases"), ("n", "n_bases"), ("ambiguous", "ambiguous_bases"))],
    )
    half = n50(c, "_l", by)
    out = sums.join(half, list(by), "left") if by else sums.join(half, F.lit(True), "left")
    return out.withColumns({
        "average_length": ratio(F.col("bases"), F.col("sequences")), "gc_percent": ratio(F.col("gc_bases"), F.col("canonical_bases"), 100),
        "n_percent": ratio(F.col("n_bases"), F.col("bases"), 100), "ambiguous_percent": ratio(F.col("ambiguous_bases"), F.col("bases"), 100),
    })


def _fastq_sums(df: DataFrame, by: Sequence[str]) -> DataFrame:
    c = df.withColumn("_c", base_composition("seq")).withColumn("_q", quality_profile("qual")).withColumn("_l", F.length("seq"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return c.groupBy(*by).agg(
        F.count("*").alias("reads"), total("_l").alias("bases"), F.min("_l").cast("long").alias("min_length"), F.max("_l").cast("long").alias("max_length"), total("_c.canonical").alias("canonical_bases"),
        total("_c.gc").alias("gc_bases"), total("_c.n").alias("n_bases"), total("_c.ambiguous").alias("ambiguous_bases"), total("_q.total").alias("phred_total"), total("_q.q20").alias("q20_bases"),
        total("_q.q30").alias("q30_bases"), F.min("_q.low").alias("min_phred"), F.max("_q.high").alias("max_phred"),
    )


def _fastq_ratios(sums: DataFrame) -> DataFrame:
    b = F.col("bases")
    return sums.withColumns({
        "average_length": ratio(b, F.col("reads")), "mean_phred": ratio(F.col("phred_total"), b), "gc_percent": ratio(F.col("gc_bases"), F.col("canonical_bases"), 100),
        "n_percent": ratio(F.col("n_bases"), b, 100), "q20_percent": ratio(F.col("q20_bases"), b, 100), "q30_percent": ratio(F.col("q30_bases"), b, 100),
    })


def fastq_qc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reads (seq, qual) -> counters of reads, bases, lengths, composition and scores; means are by base."""
    return _fastq_ratios(_fastq_sums(df, by))


def pair_reads(r1: DataFrame, r2: DataFrame, by: str = "ordinal") -> DataFrame:
    """Mates by record number -> by, header1, seq1, qual1, header2, seq2, qual2, core_id, pair_error (missing_mate, bad_header, id_mismatch, wrong_mate or null)."""
    one, two = (r.select(by, *[F.col(c).alias(f"{c}{n}") for c in ("header", "seq", "qual")]) for n, r in ((1, r1), (2, r2)))
    p = one.join(two, by, "full_outer").withColumn("_a", mate_identity("header1")).withColumn("_b", mate_identity("header2"))
    a, b = F.col("_a"), F.col("_b")
    error = F.when(F.col("seq1").isNull() | F.col("seq2").isNull(), "missing_mate").when(a["error"].isNotNull() | b["error"].isNotNull(), "bad_header").when(a["core_id"] != b["core_id"], "id_mismatch")
    return p.withColumn("pair_error", error.when((a["mate"] == 2) | (b["mate"] == 1), "wrong_mate")).withColumn("core_id", a["core_id"]).drop("_a", "_b")


def mates(pairs: DataFrame) -> DataFrame:
    """Pairs as one population of reads: mate, header, seq, qual."""
    return pairs.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mate"), *[F.col(f"{c}{m}").alias(c) for c in ("header", "seq", "qual")]) for m in (1, 2)])).alias("r")).select("r.*")


def paired_fastq_qc(pairs: DataFrame) -> DataFrame:
    """A row for read1, read2 and combined: block, pairs and the columns of fastq_qc."""
    each = _fastq_sums(mates(pairs), ["mate"])  # a row for each mate, added up: the reads are gone through once
    added = each.select(F.explode(F.array(F.concat(F.lit("read"), F.col("mate").cast("string")), F.lit("combined"))).alias("block"), *each.columns[1:]).groupBy("block")
    how = lambda c: F.min if c.startswith("min_") else F.max if c.startswith("max_") else F.sum
    q = _fastq_ratios(added.agg(*[how(c)(c).alias(c) for c in each.columns[1:]]))
    return q.withColumn("pairs", F.when(F.col("block") == "combined", (F.col("reads") / 2).cast("long")).otherwise(F.col("reads")))


def trim_reads(df: DataFrame, options: TrimOptions = TrimOptions()) -> DataFrame:
    """Reads (seq, qual) with what trimming does: adapter_bases, quality_bases, final_length, trimmed_seq, trimmed_qual, kept."""
    return _trim(df, "", options.adapter, options).withColumn("kept", F.col("final_length") >= options.min_length)


def _trim(df: DataFrame, n: str, adapter: str, o: TrimOptions) -> DataFrame:
    at = adapter_position(f"seq{n}", adapter, o.min_overlap, o.max_mismatches)
    d = df.withColumn("_at", at).withColumn(f"final_length{n}", quality_trim_length(f"qual{n}", F.col("_at"), o.quality))
    cut = lambda c: F.substr(F.col(c), F.lit(1), F.col(f"final_length{n}"))
    return d.withColumns({
        f"adapter_bases{n}": F.length(f"seq{n}") - F.col("_at"), f"quality_bases{n}": F.col("_at") - F.col(f"final_length{n}"), f"trimmed_seq{n}": cut(f"seq{n}"), f"trimmed_qual{n}": cut(f"qual{n}")
    }).drop("_at")


def trim_pairs(pairs: DataFrame, options: TrimOptions = TrimOptions()) -> DataFrame:
    """The columns of trim_reads for either mate, with 1 and 2 at the end of their names; kept if both mates are long enough."""
    p = _trim(_trim(pairs, "1", options.adapter, options), "2", options.adapter2, options)
    return p.withColumn("kept", F.least("final_length1", "final_length2") >= options.min_length)


def _trim_counters(n: str) -> list[Column]:
    s = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return [
        count_if(F.col(f"adapter_bases{n}") > 0).alias(f"adapter_reads{n}"), s(f"adapter_bases{n}").alias(f"adapter_bases{n}"), count_if(F.col(f"quality_bases{n}") > 0).alias(f"quality_reads{n}"),
        s(f"quality_bases{n}").alias(f"quality_bases{n}"), s(F.length(f"seq{n}")).alias(f"input_bases{n}"), s(F.when(F.col("kept"), F.col(f"final_length{n}"))).alias(f"output_bases{n}"),
    ]


def trim_summary(trimmed: DataFrame) -> DataFrame:
    """Counters of trim_reads; what was trimmed counts whether or not the read is kept."""
    return trimmed.agg(F.count("*").alias("input_reads"), count_if(F.col("kept")).alias("kept_reads"), count_if(~F.col("kept")).alias("discarded_reads"), *_trim_counters(""))


def paired_trim_summary(trimmed: DataFrame) -> DataFrame:
    return trimmed.agg(F.count("*").alias("input_pairs"), count_if(F.col("kept")).alias("kept_pairs"), count_if(~F.col("kept")).alias("discarded_pairs"), *_trim_counters("1"), *_trim_counters("2"))
