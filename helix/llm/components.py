"""Connected components of a distributed graph: union-find by alternating large and small stars over edge tables.

Every step is joins and aggregates of edges; nothing about the graph is gathered anywhere. Steps are written to the shared
folder, so lineage stays short and lost executors lose nothing. The number of rounds grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helix.llm.shared import Scratch, drop_path, new_path


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """edges (u, v: long) -> id, root: for each node of an edge between two nodes, the smallest id of its component.

    Loops and repeated edges change nothing; edges with a null end are left out. Without edges there are no rows.
    The result reads a table in the shared folder, which goes with scratch.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e.write.parquet(path)
    mark = None
    while True:
        e = spark.read.parquet(path)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = new_path(spark, "edges")
        small.write.parquet(after)
        drop_path(spark, path)
        path = after
    if scratch is not None:
        scratch.paths.append(path)
    # stars now: each node's only edge goes to its root
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
