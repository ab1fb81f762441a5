"""The workflows from files to results. Each is a function of a session, paths and options that returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helix.operators import align as AL
from helix.operators import alignments as A
from helix.operators import reads as R
from helix.operators import variants as V
from helix.operators.sinks import with_annotation_lines, with_qc_lines
from helix.options import AlignOptions, SnvOptions, TrimOptions, VcfQcOptions
from helix.sources.fasta import read_fasta, read_reference
from helix.sources.fastq import read_fastq, with_ordinals
from helix.sources.sam import read_bam, read_bam_dictionary, read_sam, read_sam_dictionary
from helix.sources.vcf import read_annotations, read_vcf


def fasta_qc(spark: SparkSession, path: str) -> DataFrame:
    return R.fasta_qc(read_fasta(spark, path))


def fastq_qc(spark: SparkSession, path: str) -> DataFrame:
    return R.fastq_qc(read_fastq(spark, path))


def _pairs(spark: SparkSession, path1: str, path2: str) -> DataFrame:
    if path1 == path2:
        raise ValueError("the two files of pairs must differ")
    p = R.pair_reads(with_ordinals(read_fastq(spark, path1)), with_ordinals(read_fastq(spark, path2)))
    bad = p.filter("pair_error IS NOT NULL").limit(1).collect()
    if bad:
        raise ValueError(f"pair {bad[0]['ordinal']}: {bad[0]['pair_error']}")
    return p


def paired_fastq_qc(spark: SparkSession, path1: str, path2: str) -> DataFrame:
    return R.paired_fastq_qc(_pairs(spark, path1, path2))


def trim_single(spark: SparkSession, path: str, options: TrimOptions = TrimOptions()) -> tuple[DataFrame, DataFrame]:
    """(all reads with what was trimmed and kept, summary)."""
    t = R.trim_reads(with_ordinals(read_fastq(spark, path)), options)
    return t, R.trim_summary(t)


def trim_paired(spark: SparkSession, path1: str, path2: str, options: TrimOptions = TrimOptions()) -> tuple[DataFrame, DataFrame]:
    t = R.trim_pairs(_pairs(spark, path1, path2), options)
    return t, R.paired_trim_summary(t)


def align_single(spark: SparkSession, reads: str, reference: str, options: AlignOptions = AlignOptions()) -> tuple[DataFrame, DataFrame]:
    """(SAM columns, summary)."""
    from helix.functions.fastq import read_name

    r = with_ordinals(read_fastq(spark, reads)).withColumn("read_id", read_name("header"))
    sam = AL.to_sam(r.withColumn("qname", r["read_id"]).withColumn("read_id", r["ordinal"]), AL.align(r.select(r["ordinal"].alias("read_id"), "seq"), read_reference(spark, reference), options))
    return sam, AL.alignment_summary(sam)


def align_paired(spark: SparkSession, reads1: str, reads2: str, reference: str, options: AlignOptions = AlignOptions()) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import functions as F

    p = _pairs(spark, reads1, reads2)
    m = p.select("ordinal", "core_id", F.explode(F.array(*[F.struct(F.lit(k).alias("mate"), F.col(f"seq{k}").alias("seq"), F.col(f"qual{k}").alias("qual")) for k in (1, 2)])).alias("m"))
    r = m.select((F.col("ordinal") * 2 + F.col("m.mate") - 1).alias("read_id"), F.col("ordinal").alias("pair_id"), "m.mate", "m.seq", "m.qual")
    sam = AL.align_pairs(r, AL.align(r.select("read_id", "seq"), read_reference(spark, reference), options))
    return sam.join(p.select(F.col("ordinal").alias("pair_id"), F.col("core_id").alias("qname")), "pair_id"), AL.pair_classes(sam)


def _alignments(spark: SparkSession, path: str) -> DataFrame:
    return read_bam(spark, path) if path.endswith(".bam") else read_sam(spark, path)


def alignment_qc(spark: SparkSession, path: str, dictionary: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counters, coverage by contig, coverage in all)."""
    r = _alignments(spark, path)
    bad = A.record_errors(r, dictionary).filter("error IS NOT NULL").limit(1).collect()
    if bad or not A.undeclared(r, dictionary).isEmpty():
        raise ValueError(f"a record doesn't fit the dictionary: {bad[0]['error'] if bad else 'undeclared contig'}")
    cov = A.coverage(r, dictionary)
    return A.alignment_qc(r), cov, A.coverage_totals(cov)


def call_snvs(spark: SparkSession, alignments: str, reference: str, options: SnvOptions = SnvOptions()) -> tuple[DataFrame, DataFrame]:
    """(calls, summary). A dictionary that doesn't match the reference, and records that it can't take, are errors; blank lines are skipped."""
    text = not alignments.endswith(".bam")
    r, ref = read_sam(spark, alignments, skip_blank=True) if text else read_bam(spark, alignments), read_reference(spark, reference, allow_u=True)
    named = read_sam_dictionary(spark, alignments) if text else read_bam_dictionary(spark, alignments)
    # a BAM file's list is the reference's, in its order; that of SAM text may be missing or in another order
    if not (text and named.isEmpty()) and not A.compare_dictionaries(named, ref.withColumnRenamed("contig_idx", "idx"), ordered=not text).isEmpty():
        raise ValueError("the dictionary doesn't match the reference")
    bad = A.caller_errors(r, ref, options).limit(1).collect()
    if bad:
        raise ValueError(f"record {bad[0]['qname']}: {bad[0]['error']}")
    o = A.counted_observations(r, ref, options)
    return A.call_snvs(A.pileup(o), options), A.snv_summary(r, o, options)


def vcf_qc_filter(spark: SparkSession, path: str, options: VcfQcOptions = VcfQcOptions()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header lines, records with decisions, summary)."""
    meta, records = read_vcf(spark, path)
    qc = V.qc_records(records, options)
    return with_qc_lines(meta, options), qc, V.vcf_qc_summary(qc)


def annotate_variants(spark: SparkSession, path: str, annotations: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(header lines, records with INFO put on, alleles, summary)."""
    meta, records = read_vcf(spark, path, versions=("4.0", "4.1", "4.2", "4.3", "4.4", "4.5"))
    notes = read_annotations(spark, annotations)
    alleles = V.annotate(records, notes)
    return with_annotation_lines(meta), V.append_info(records, alleles), alleles, V.annotation_summary(alleles, records, notes)
