"""The queries of FASTA and FASTQ operators over whole documents.

The queries of read_queries see reads of 150 letters (a document's last has what is left over). Each has a form here that runs the same operators over reads that are
whole documents, against the same DuckDB text over these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helix.functions.sequence import canonical_hamming
from helix.operators import reads as R
from helix.operators.align import align, align_pairs, alignment_summary, pair_classes, to_sam
from helix.options import AlignOptions
from helix.plans import read_queries as Q
from helix.plans.adapters import duck, table
from helix.registry import ORACLE, QUERIES, query
from helix.shipping import ship

#: The queries that take reads and nothing else.
NAMES = (
    "P1_base_composition", "P2_phred_decode", "P3_quality_profile", "P4_fastq_check", "P5_fasta_check", "P8_P9_reverse", "P11_adapter_position", "P12_quality_trim", "P13_P14_trim_reads",
    "A1_fasta_qc", "A2_W1_n50", "A3_fastq_qc", "A5_trim_summary", "F2_fastq_qc",
)
D = duck("whole_reads") + ", reads AS (SELECT * FROM whole_reads)"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "whole_reads")


def whole(name: str) -> None:
    over = QUERIES[name]

    @query(f"{name}_whole", ORACLE[name].replace(Q.D, D, 1))
    def _(spark, d):
        return over(spark, reads(spark, d))


for _name in NAMES:
    whole(_name)


@query("P10_canonical_hamming_whole", f"{D} SELECT read_id, len(list_filter(list_zip(string_split(seq, ''), string_split(reverse(seq), '')), lambda x: NOT (x[1] = x[2] AND contains('ACGT', x[1])))) AS distance FROM reads")
def _(spark, d):
    return reads(spark, d).select("read_id", canonical_hamming("seq", F.reverse("seq")).cast("long").alias("distance"))


PAIRS = Q.PAIRS


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return Q.pairs(spark, reads(spark, d))


@query("J1_J2_pair_reads_whole", ORACLE["J1_J2_pair_reads"].replace(Q.D, D, 1).replace(Q.PAIRS, PAIRS, 1))
def _(spark, d):
    return pairs(spark, d).select("ordinal", "seq1", "seq2", "pair_error")


@query("A4_U1_paired_fastq_qc_whole", ORACLE["A4_U1_paired_fastq_qc"].replace(Q.D, D, 1).replace(Q.PAIRS, PAIRS, 1))
def _(spark, d):
    return R.paired_fastq_qc(pairs(spark, d).filter("pair_error IS NULL"))


@query("A6_F5_paired_trim_whole", ORACLE["A6_F5_paired_trim"].replace(Q.D, D, 1).replace(Q.PAIRS, PAIRS, 1))
def _(spark, d):
    return R.paired_trim_summary(R.trim_pairs(pairs(spark, d).filter("pair_error IS NULL"), Q.OPTIONS))


#: Alignment of whole reads against the whole table. DuckDB would have to try all reads at all places, so these have no SQL; align is tested by brute force.
REFERENCE = "SELECT concat('c', read_id) AS contig, read_id AS contig_idx, seq FROM {reads}"
#: Every third read may have a base changed, and every third is reversed.
PROBES = """SELECT read_id, CASE WHEN read_id % 3 = 0 THEN concat('A', substr(seq, 2)) WHEN read_id % 3 = 1 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq,
    CASE WHEN read_id % 3 = 1 THEN reverse(qual) ELSE qual END AS qual FROM {reads}"""


def probes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Reads with their mates, and their hits."""
    ship(spark)
    r = reads(spark, d)
    p = spark.sql(PROBES, reads=r).withColumn("pair_id", F.floor(F.col("read_id") / 2)).withColumn("mate", (F.col("read_id") % 2 + 1).cast("int"))
    return p, align(p, spark.sql(REFERENCE, reads=r), AlignOptions(2))


def align_whole(spark: SparkSession, d: str) -> DataFrame:
    return probes(spark, d)[1].select("read_id", "contig", "pos", "strand", F.col("nm").cast("long").alias("nm"), "nh")


def align_single_whole(spark: SparkSession, d: str) -> DataFrame:
    return alignment_summary(to_sam(*probes(spark, d)))


def pair_classes_whole(spark: SparkSession, d: str) -> DataFrame:
    return pair_classes(align_pairs(*probes(spark, d)))


def align_pairs_whole(spark: SparkSession, d: str) -> DataFrame:
    return align_pairs(*probes(spark, d)).select("pair_id", "mate", "flag", "rname", "pos", "rnext", "pnext", "tlen")


ALIGN = {"J3_W3_W4_align_whole": align_whole, "F6_P29_A7_align_single_whole": align_single_whole, "A8_J4_pair_classes_whole": pair_classes_whole, "F7_P27_P28_align_pairs_whole": align_pairs_whole}
