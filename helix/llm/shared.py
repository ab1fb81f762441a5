"""Scratch tables in the folder that the whole cluster shares, and small helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (local tests), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-helix-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/helix-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there, and lost executors lose none of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later result reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Scratch:
    """Scratch tables that go together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def located(docs: DataFrame) -> DataFrame:
    """row (all columns of docs, so that none can clash), _file and _row (the row's place). A table that isn't read from files is written to the shared folder first."""

    def placed(d: DataFrame) -> DataFrame:
        place = d.metadataColumn("_metadata")  # also where the table has a column of that name
        return d.select(F.struct("*").alias("row"), place["file_path"].alias("_file"), place["row_index"].alias("_row"))

    try:
        return placed(docs)
    except AnalysisException:
        path = new_path(docs.sparkSession, "docs")
        docs.write.parquet(path)
        return placed(docs.sparkSession.read.schema(docs.schema).parquet(path))


def texts_at(places: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, _file, _row of a located table."""
    return places.select(F.col("row")[doc_id].alias("doc_id"), F.col("row")[text].cast("string").alias("text"), "_file", "_row")
