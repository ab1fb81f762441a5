"""Exact deduplication as a stateful stream.

Every row becomes an entry of a log: digest of the normalised text, stable identifier, content locator (file and row). The log
is read as a stream; its state, kept by digest in RocksDB on the executors' disks and checkpointed in the shared folder, never
expires and holds the group's smallest identifier, that row's locator and the group's size. Each batch appends the groups it
touched to a table, written by batch number so that a repeated batch replaces itself; the last entry of a digest is its state.
With a folder of its own (state_dir) log and state stay, and a later call adds its rows to those of the calls before.

A digest only nominates. Rows of groups with several members fetch the nominated row's text by its locator and compare whole
texts; the members of a digest under which texts differ are grouped again by the full text itself.

Everything is DataFrame operations. A digest that a third of all rows share is pre-aggregated before the state's shuffle, and
its rows meet the one row of their group in a join that is salted on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helix.llm.shared import located, new_path, path_exists, texts_at, written

#: Rows of a group of more members than this are dealt over SALTS keys.
HOT, SALTS = 1000, 64


def normalised(text: Column) -> Column:
    """Null as empty, and each run of space, tab, line feed, vertical tab, form feed and carriage return as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def grouped_by_state(spark: SparkSession, base: str, schema, bytes_per_batch: int) -> DataFrame:
    """The log in base, as far as it is new, as a stream through the keyed state -> digest, keep (doc_id, _file, _row of the row that stays), size."""
    session = spark.newSession()  # the state's settings stay out of the caller's session
    for k, v in {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",  # beside the heap, kept by the executor; the rest is on disk
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a task's store is closed with it: open ones reserve disk
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }.items():
        session.conf.set(k, v)
    log = session.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(f"{base}/log")
    member = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_file", "_row")
    state = log.groupBy("digest").agg(F.min(member).alias("keep"), F.count("*").alias("size"))

    def append(groups: DataFrame, batch: int) -> None:
        groups.write.mode("overwrite").parquet(f"{base}/groups/batch={batch:012d}")

    state.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(append).start().awaitTermination()
    return latest(spark, base)


def latest(spark: SparkSession, base: str) -> DataFrame:
    """digest, keep, size of all groups. A group's size only grows and its smallest member only falls."""
    return spark.read.parquet(f"{base}/groups").groupBy("digest").agg(F.min("keep").alias("keep"), F.max("size").alias("size"))


def exact_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, bytes_per_batch: int = 4 << 30, state_dir: str | None = None) -> DataFrame:
    """docs (doc_id, text; others are left alone) -> for each row: doc_id, keep_id, group_size, kept, text_sha256, _file, _row.

    Texts are equal if they are identical once normalised; null is as empty. Of equal texts the row with the smallest doc_id stays (a null id after all
    others), and of rows with that id the first by file and place, so repeated rows leave one. _file and _row are the row's place in the table
    (see located). digest is a parameter so that tests can make digests collide; text_sha256 is SHA-256 whatever it is. Empty tables give none.

    state_dir: a folder that keeps the state. The result is then of the rows of all calls with it, of which only this call's are read and compared, with the
    rows that stayed before, found by their locators; so the files of earlier calls must still be there.
    """
    spark = docs.sparkSession

    def fetch(places: DataFrame) -> DataFrame:
        files = [r["_file"] for r in places.select("_file").distinct().collect()]  # no more than the table has files
        if not files:
            return places.select(F.lit(None).cast(docs.schema[doc_id].dataType).alias("doc_id"), F.lit("").alias("text"), "_file", "_row").limit(0)
        return texts_at(located(spark.read.parquet(*files)), doc_id, text).join(places, ["_file", "_row"], "left_semi")

    return exact_groups(texts_at(located(docs), doc_id, text), digest=digest, bytes_per_batch=bytes_per_batch, state_dir=state_dir, fetch=fetch)


def exact_groups(rows: DataFrame, *, digest: Callable[[Column], Column] = sha256, bytes_per_batch: int = 4 << 30, state_dir: str | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """exact_dedup() of rows (doc_id, text, _file, _row). fetch gives such rows of earlier calls by their place."""
    spark = rows.sparkSession
    rows = rows.withColumn("text", normalised(F.col("text")))
    base = state_dir or new_path(spark, "dedup")
    earlier = state_dir is not None and path_exists(spark, f"{base}/groups")
    before = written(latest(spark, base), "groups") if earlier else None
    found = _resolved(rows, digest, bytes_per_batch, base)
    known, all_rows = rows, lambda some: rows
    if before is not None:
        touched = rows.select(digest(F.col("text")).alias("digest")).distinct()
        stayed = before.join(touched, "digest", "left_semi").select(F.col("keep._file").alias("_file"), F.col("keep._row").alias("_row"))
        again = lambda places: fetch(places).withColumn("text", normalised(F.col("text")))
        known = rows.unionByName(again(stayed))
        all_rows = lambda some: again(found.join(some, "digest", "left_semi").select("_file", "_row"))
    differing = written_if_any(_differing(known, found, digest))
    if state_dir and differing is not None:
        differing.write.mode("append").parquet(f"{base}/differing")
    if state_dir and path_exists(spark, f"{base}/differing"):
        differing = spark.read.parquet(f"{base}/differing").distinct()
    if differing is not None:  # texts under one digest differ: the whole text is the key
        some = all_rows(differing).withColumn("digest", digest(F.col("text"))).join(differing, "digest", "left_semi").drop("digest")
        exact = _resolved(some, lambda t: F.concat(t, F.lit("")), bytes_per_batch, new_path(spark, "dedup"))
        found = found.join(differing, "digest", "left_anti").unionByName(exact)
    return found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"), ((F.col("keep._file") == F.col("_file")) & (F.col("keep._row") == F.col("_row"))).alias("kept"), "text_sha256", "_file", "_row")


def written_if_any(df: DataFrame) -> DataFrame | None:
    path = new_path(df.sparkSession, "some")
    df.write.parquet(path)
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    return None if df.isEmpty() else df


def salted(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows and groups meet by digest. The one row of a hot group is repeated for each salt, and every row takes a salt; small groups
    have salt 0 only, so rows try their salt and 0. Spark's skew join splits what is left."""
    salt = F.pmod(F.xxhash64("_file", "_row"), F.lit(SALTS)).cast("int")
    hot = groups.filter(F.col("size") > HOT).select("digest", F.lit(True).alias("_hot"))
    # at most one hot digest for each HOT rows, and few in practice: Spark broadcasts the list if its size allows
    marked = rows.join(hot, "digest", "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    each = groups.withColumn("_salt", F.explode(F.when(F.col("size") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return marked.join(each, ["digest", "_salt"]).drop("_salt")


def _resolved(rows: DataFrame, digest: Callable[[Column], Column], bytes_per_batch: int, base: str) -> DataFrame:
    """rows (doc_id, text, _file, _row), added to the log in base -> the log's rows with the keep and size of their group."""
    spark = rows.sparkSession
    rows.select("doc_id", "_file", "_row", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("text_sha256")).write.mode("append").parquet(f"{base}/log")
    log = spark.read.parquet(f"{base}/log")
    return salted(log, grouped_by_state(spark, base, log.schema, bytes_per_batch))


def _differing(rows: DataFrame, found: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The digests under which a row's text isn't that of the row that stays: whole texts are compared."""
    several = found.filter("size > 1").select("digest", "size", "_file", "_row", ((F.col("keep._file") == F.col("_file")) & (F.col("keep._row") == F.col("_row"))).alias("is_kept"))
    members = rows.select("text", "_file", "_row").join(several, ["_file", "_row"])  # the only shuffle of whole texts; both uses below share it
    kept = members.filter("is_kept").select("digest", "size", F.col("text").alias("whole"))
    pairs = salted(members.select("digest", "text", "_file", "_row"), kept)
    return pairs.filter("text != whole").select("digest").distinct()
