"""Sinks and sources together: what rows are after they were written to files and read again, against the rows themselves."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helix.operators import sinks
from helix.operators.variants import ANNOTATIONS
from helix.plans import alignment_queries as AQ
from helix.plans import run_queries as RQ
from helix.plans.adapters import duck, table
from helix.registry import query
from helix.sources.fasta import read_fasta, read_reference
from helix.sources.fastq import read_fastq
from helix.sources.sam import read_sam, read_sam_dictionary
from helix.sources.vcf import read_annotations, read_events, read_registry, read_vcf

READS, ALIGNED, VARIANTS, EVENTS, JOBS = duck("reads"), duck("alignments"), duck("variants"), duck("run_events"), duck("jobs")


def place(spark: SparkSession, name: str) -> str:
    """A folder that nothing uses yet, in the one that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="spark-trip-")
    return f"{base.rstrip('/')}/helix-{name}-{uuid.uuid4().hex}"


def fastq_reads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reads").select(F.lit("x").alias("file"), F.col("read_id").alias("ordinal"), F.concat(F.lit("@r"), "read_id").alias("header"), "seq", "qual")


FASTQ = f"{READS} SELECT concat('@r', read_id) AS header, seq, qual FROM reads"


@query("SRC3_SNK1_fastq", FASTQ)
def _(spark, d):
    path = place(spark, "fastq")
    sinks.write_fastq(fastq_reads(spark, d), path)
    return read_fastq(spark, path).select("header", "seq", "qual")


@query("SRC4_fastq_gzip", FASTQ)
def _(spark, d):
    path = place(spark, "gzip")
    sinks.write_fastq(fastq_reads(spark, d), path, compression="gzip")
    return read_fastq(spark, path).select("header", "seq", "qual")


def fasta_file(spark: SparkSession, d: str) -> str:
    """Sequences in lines of 60."""
    path = place(spark, "fasta")
    lines = F.array_join(F.regexp_extract_all("seq", F.lit(".{1,60}"), F.lit(0)), "\n")
    table(spark, d, "reads").select(F.concat(F.lit(">r"), "read_id", F.lit(" "), "lang", F.lit("\n"), lines)).write.text(path)
    return path


@query("SRC1_fasta", f"{READS} SELECT concat('r', read_id, ' ', lang) AS header, seq, length(seq) AS length FROM reads")
def _(spark, d):
    return read_fasta(spark, fasta_file(spark, d)).select("header", "seq", "length")


@query("SRC2_reference", f"{READS} SELECT concat('r', read_id) AS contig, seq, length(seq) AS length FROM reads")
def _(spark, d):
    return read_reference(spark, fasta_file(spark, d)).select("contig", "seq", "length")


def sam_files(spark: SparkSession, d: str) -> str:
    path = place(spark, "sam")
    r = AQ.sequenced(spark, d).withColumns({"qname": F.concat(F.lit("q"), "k"), "pnext": F.lit(0), "nh": F.lit(1), "ordinal": F.col("k")})
    reference = AQ.reference(spark, d).withColumn("contig_idx", F.substr("contig", F.lit(4)).cast("long"))
    sinks.write_sam(r, reference, path)
    return path


@query("SRC5_SNK2_sam", f"{ALIGNED} SELECT concat('q', k) AS qname, flag, rname, pos, mapq, cigar, rnext, 0 AS pnext, tlen, read_len AS bases, nm FROM alignments")
def _(spark, d):
    return read_sam(spark, sam_files(spark, d)).select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", F.length("seq").alias("bases"), "nm")


@query("SRC6_sam_dictionary", f"{AQ.D} SELECT contig, length FROM dictionary")
def _(spark, d):
    return read_sam_dictionary(spark, sam_files(spark, d)).select("contig", "length")


@query("SRC8_SNK3_vcf", f"{VARIANTS} SELECT chrom, pos, concat('v', ordinal) AS id, ref, alt, flt, info FROM variants")
def _(spark, d):
    path = place(spark, "vcf")
    v = table(spark, d, "variants")
    meta = spark.createDataFrame([(0, "##fileformat=VCFv4.3"), (1, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO")], "ordinal long, line string")
    sinks.write_vcf(meta, v.select("ordinal", F.concat_ws("\t", "chrom", "pos", F.concat(F.lit("v"), "ordinal"), "ref", "alt", F.lit("."), "flt", "info").alias("line")), path)
    return read_vcf(spark, path)[1].select("chrom", "pos", "id", "ref", "alt", "flt", "info")


@query("SRC9_annotations", f"{VARIANTS} SELECT concat(chrom, ':', pos, ':', ordinal) AS key, concat('g', cust) AS gene, prio AS consequence, flt AS clinical_significance, '' AS source, concat('s', ordinal) AS source_id FROM variants")
def _(spark, d):
    path = place(spark, "annotations")
    key = F.concat_ws(":", "chrom", "pos", "ordinal").alias("key")
    values = (F.concat(F.lit("g"), "cust"), F.col("prio"), F.col("flt"), F.lit(""), F.concat(F.lit("s"), "ordinal"))
    sinks.write_table(table(spark, d, "variants").select(key, *(v.alias(c) for c, v in zip(ANNOTATIONS, values, strict=True))), path)
    return read_annotations(spark, path)


@query("SRC10_registry", f"{JOBS} SELECT job_id, status, progress, revision FROM jobs")
def _(spark, d):
    path = place(spark, "registry")
    table(spark, d, "jobs").write.parquet(f"{path}/jobs")
    found = read_registry(spark, path)
    if set(found) != {"jobs"}:
        raise ValueError("the registry has other tables than were written")
    return found["jobs"].select("job_id", "status", "progress", "revision")


@query("SRC11_events", f"{EVENTS}, s AS ({RQ.SHAPED}) SELECT job_id, sequence, type, progress, {RQ.T1} AS error FROM s")
def _(spark, d):
    path = place(spark, "events")
    s = spark.sql(RQ.SHAPED.replace("FROM run_events", "FROM {run_events}"), run_events=table(spark, d, "run_events"))
    s.select(F.to_json(F.struct(*(c for c in s.columns if c != "arrival")))).write.text(path)
    return read_events(spark, path, streaming=False).select("job_id", "sequence", "type", "progress", F.col("_error").alias("error"))


@query("SNK5_summary", f"{AQ.D}, {AQ.SUMMARY} SELECT total, mapped, (SELECT count(DISTINCT rname) FROM alignments WHERE {AQ.PM}) AS contigs FROM summary")
def _(spark, d):
    from helix.operators import alignments as A

    path, r = place(spark, "summary"), AQ.records(spark, d)
    sinks.write_summary(sinks.to_summary(A.alignment_qc(r).select("total", "mapped"), contigs=A.contig_counts(r)), path)
    return spark.read.json(path).select("metrics.total", "metrics.mapped", F.size("contigs").cast("long").alias("contigs"))
