"""Files behind artifacts: are they there, and what they should be?"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helix.sources.storage import opened, reachable


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified of all files under a folder; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


#: Bytes of a file that a task holds at a time.
BLOCK = 1 << 20


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_p (a path) -> with _sha, by a running digest; null where the file can't be read any more."""
    for b in batches:
        out = []
        for path in b["_p"].to_pylist():
            digest = hashlib.sha256()
            try:
                with opened(path) as f:
                    while block := f.read(BLOCK):
                        digest.update(block)
                out.append(digest.hexdigest())
            except OSError:
                out.append(None)
        yield b.append_column("_sha", pa.array(out, pa.string()))


def verify_artifacts(artifacts: DataFrame, folder: str) -> DataFrame:
    """artifacts (path under the folder, size, sha256) with outcome: missing, size_mismatch, checksum_unavailable, checksum_mismatch or verified.

    Only files of the right size that have a checksum are read, block by block, whatever their size; files are dealt out by path. Where Python can't
    open the folder, Spark's reader gives each file, of 2 GB at most, as a whole.
    """
    spark = artifacts.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = F.substring_index(F.lit(folder.rstrip("/")), "/", -1)
    rel = F.element_at(F.split("path", F.concat(F.lit("/"), base, F.lit("/")), 2), -1).alias("_rel")
    found = files.select(F.col("path").alias("_p"), rel, F.col("length").alias("_size"))
    wanted = artifacts.filter("sha256 IS NOT NULL").select(F.col("path").alias("_rel"), F.col("size").alias("_size")).distinct()
    to_read = found.join(wanted, ["_rel", "_size"], "left_semi")
    if reachable(folder):
        read = to_read.repartition(F.xxhash64("_p")).select("_p").mapInArrow(_digests, "_p string, _sha string")
    else:
        read = files.select(F.col("path").alias("_p"), F.sha2("content", 256).alias("_sha")).join(to_read.select("_p"), "_p", "left_semi")
    j = artifacts.join(found.join(read, "_p", "left"), F.col("path") == F.col("_rel"), "left")
    out = F.when(F.col("_rel").isNull(), "missing").when(F.col("size") != F.col("_size"), "size_mismatch").when(F.col("sha256").isNull(), "checksum_unavailable").when(F.coalesce(F.lower("sha256") != F.col("_sha"), F.lit(True)), "checksum_mismatch").otherwise("verified")
    return j.select(*artifacts.columns, out.alias("outcome"))
