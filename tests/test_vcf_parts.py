"""A VCF file of several parts."""

from pyspark.sql import functions as F

from helix.operators import sinks
from helix.sources.vcf import read_vcf


def test_vcf_of_several_parts(spark, tmp_path):
    """the parts' names are compared however Spark writes their path."""
    meta = spark.createDataFrame([(0, "##fileformat=VCFv4.3"), (1, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO")], "ordinal long, line string")
    rows = spark.range(1, 4001, numPartitions=4).select(F.col("id").alias("ordinal"), F.concat_ws("\t", F.lit("c"), "id", F.lit("."), F.lit("A"), F.lit("G"), F.lit("."), F.lit("PASS"), F.lit("DP=3")).alias("line"))
    sinks.write_vcf(meta, rows, f"file://{tmp_path}/v", 5)
    got = read_vcf(spark, f"file://{tmp_path}/v")[1].orderBy("ordinal").select("pos").collect()
    assert [r["pos"] for r in got] == list(range(1, 4001))
