"""Operators by brute force, for small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helix.functions.sequence import canonical_hamming
from helix.operators.align import oriented


def brute_force(reads: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """The hits without seeds, for tests on small inputs: every read at every place."""
    o = oriented(reads)
    ref = reference.select("contig", "contig_idx", F.upper("seq").alias("rseq"))
    p = o.join(ref, F.length("oseq") <= F.length("rseq")).filter(F.length("oseq") > 0).select("*", F.explode(F.sequence(F.lit(0), F.length("rseq") - F.length("oseq"))).alias("pos"))
    p = p.withColumn("nm", canonical_hamming("oseq", F.substr("rseq", F.col("pos") + 1, F.length("oseq")))).filter(F.col("nm") <= k)
    best = Window.partitionBy("read_id").orderBy("nm")
    ties = p.withColumn("r", F.rank().over(best)).filter("r = 1").withColumn("nh", F.count("*").over(Window.partitionBy("read_id")))
    return ties.withColumn("n", F.row_number().over(Window.partitionBy("read_id").orderBy("contig_idx", "pos", "strand"))).filter("n = 1").select("read_id", "contig", F.col("pos").cast("long").alias("pos"), "strand", "nm", "nh")
