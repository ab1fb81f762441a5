"""FASTA files. A file is cut at line starts with ">", so it can be split at any byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helix.functions.common import first_error
from helix.functions.sequence import contig_name, fasta_error


def checked(df: DataFrame, on_error: str) -> DataFrame:
    """fail: an invalid row raises when it is read; quarantine: rows keep their reason in _error."""
    if on_error == "quarantine":
        return df
    if on_error != "fail":
        raise ValueError("on_error is fail or quarantine")
    ok = F.when(F.col("_error").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("invalid record: "), F.col("_error"))).cast("boolean"))
    return df.filter(ok).drop("_error")


def read_fasta(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """file, header, seq, length (and _error). Lines may end in CR; blank ones are left out; what stands before the first header is an error."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"), (F.col("_metadata.file_block_start") == 0).alias("_first"))
    v = F.regexp_replace("value", "^﻿", "")
    starts = F.startswith(v, F.lit(">"))
    text = F.when(starts, F.substr(v, F.lit(2))).otherwise(v)
    r = raw.withColumn("_t", F.regexp_replace(text, "\r\n?", "\n")).withColumn("header", F.substring_index("_t", "\n", 1))
    body = F.when(F.contains("_t", F.lit("\n")), F.substr("_t", F.length("header") + 2)).otherwise("")
    r = r.filter(F.trim(F.regexp_replace("_t", "\n", " ")) != "").withColumn("seq", F.regexp_replace(body, "\n", ""))
    out = r.select("file", "header", "seq", F.length("seq").cast("long").alias("length"), fasta_error("header", "seq").alias("_error"))
    return checked(out, on_error)


def read_reference(spark: SparkSession, path: str, allow_u: bool = False, on_error: str = "fail", max_name: int = 1024) -> DataFrame:
    """contig, contig_idx (an order of the file's contigs), seq in upper case, length. With allow_u an upper-case U is read as T. A contig that stands twice is an error."""
    f = read_fasta(spark, path, "quarantine")
    seq = F.translate("seq", "U", "T") if allow_u else F.col("seq")
    name = contig_name("header")
    rows = f.select("file", name.alias("contig"), F.upper(seq).alias("seq"), F.col("_error").alias("_e"))
    bad_base = ~F.col("seq").rlike("^[ACGTNRYSWKMBDHVU]+$" if allow_u else "^[ACGTNRYSWKMBDHV]+$")
    error = first_error((F.col("_e").isNotNull() & (F.col("_e") != "bad_base"), "record"), (F.octet_length("contig") > max_name, "long_name"), (bad_base, "bad_base"))
    rows = rows.withColumn("_error", error).drop("_e").join(_order(spark, path), ["file", "contig"])
    rows = rows.withColumn("_error", F.when(F.col("_copies") > 1, F.coalesce("_error", F.lit("repeated_contig"))).otherwise(F.col("_error"))).drop("_copies", "file")
    return checked(rows, on_error).withColumn("length", F.length("seq").cast("long"))


def _order(spark: SparkSession, path: str) -> DataFrame:
    """file, contig, contig_idx, _copies: records in the order of the file's bytes (partitions of one file are numbered in that order), and how many have the name."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.substring_index(F.regexp_replace("value", "^﻿?>?", ""), "\n", 1).alias("h"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    return raw.filter(F.trim("h") != "").groupBy("file", contig_name("h").alias("contig")).agg(F.min(F.struct("b", "n")).alias("s"), F.count("*").alias("c")).select(
        "file", "contig", (F.col("s.b") * (1 << 33) + F.col("s.n") % (1 << 33)).alias("contig_idx"), F.sum("c").over(Window.partitionBy("contig")).alias("_copies")
    )
