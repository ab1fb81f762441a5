"""VCF text, annotation tables, registry tables and worker events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helix.functions.common import first_error
from helix.functions.vcf import filter_error, info_error
from helix.operators.alignments import duplicates
from helix.operators.variants import ANNOTATIONS
from helix.sources.fasta import checked

FIELDS = ("chrom", "pos_text", "id", "ref", "alt", "qual", "flt", "info")


def read_vcf(spark: SparkSession, path: str, on_error: str = "fail", versions: tuple[str, ...] = ("4.2", "4.3")) -> tuple[DataFrame, DataFrame]:
    """(meta, records): header lines (ordinal, line); records with ordinal, pos, further (what stands after INFO) and _error.

    The ordinal orders the lines of a file, or of a folder whose files are the parts of one in order of their names: by file, then by order of partitions and lines."""
    text = spark.read.text(path)
    names = sorted(re.sub("^([^/:]+):/+", r"\1:/", n) for n in text.inputFiles())  # Spark writes a local file as file:/ here and as file:/// there
    at = F.monotonically_increasing_id()
    if len(names) > 1:  # a name for each part
        of = spark.createDataFrame(list(enumerate(names)), "i long, name string")
        text = text.withColumns({"name": F.regexp_replace("_metadata.file_path", "^([^/:]+):/+", "$1:/"), "at": at}).join(F.broadcast(of), "name")
        at = F.col("i").cast("decimal(38,0)") * (1 << 60) + F.col("at")
    lines = text.select(at.alias("ordinal"), F.regexp_replace("value", "\r$", "").alias("line"))
    meta = lines.filter(F.startswith("line", F.lit("#")))
    first = meta.orderBy("ordinal").first()
    if first is None or first["line"] not in [f"##fileformat=VCFv{v}" for v in versions]:
        raise ValueError("a VCF file starts with its version")
    names = F.when(F.startswith("line", F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO")), F.col("ordinal"))
    version = F.when(F.startswith("line", F.lit("##fileformat=")), True)
    x = meta.agg(F.count(names).alias("names"), F.max(names).alias("at"), F.count(version).alias("versions"), F.max("ordinal").alias("last")).first()
    if x["names"] != 1:
        raise ValueError("a VCF file has one line of column names")
    if x["versions"] != 1 or x["last"] != x["at"]:
        raise ValueError("a VCF file has one version, and no header line after its column names")
    r = lines.filter(~F.startswith("line", F.lit("#"))).withColumn("f", F.split("line", "\t", 9))
    r = r.select("ordinal", *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(FIELDS)], F.get("f", F.lit(8)).alias("further"), F.size("f").alias("n")).withColumn("pos", F.when(F.col("pos_text").rlike("^[0-9]+$"), F.col("pos_text")).try_cast("long"))
    error = first_error(
        (F.col("ordinal") < x["at"], "before_header"), (F.col("n") < 8, "few_fields"), (~F.col("chrom").rlike(r"^[^\x00-\x20\x7F;]+$"), "bad_contig"), (F.col("pos").isNull() | (F.col("pos") < 1), "bad_position"), (F.col("ref").isin("", ".") | F.col("alt").isin("", "."), "bad_allele"), (F.exists(F.split("alt", ","), lambda a: a == ""), "bad_allele"),
        (F.size(F.split("alt", ",")) > 4096, "many_alleles"), ((F.col("qual") != ".") & (F.col("qual").try_cast("double").isNull() | (F.col("qual").try_cast("double") < 0)), "bad_quality"), (info_error("info").isNotNull(), "bad_info"), (filter_error("flt").isNotNull(), "bad_filter"),
    )
    return meta, checked(r.withColumn("_error", error).drop("n"), on_error)


def record_lines(records: DataFrame) -> DataFrame:
    """ordinal, line: records as text again, with what they had after INFO."""
    return records.select("ordinal", F.concat_ws("\t", *FIELDS, "further").alias("line"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """key and five columns of a table with exactly these in its header; a repeated or empty key is an error."""
    schema = ", ".join(f"{c} string" for c in ("key", *ANNOTATIONS))
    a = spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=False, mode="FAILFAST", quote="", escape="", ignoreTrailingWhiteSpace=False).fillna("")
    if not duplicates(a, "key").isEmpty() or not a.filter("key = ''").isEmpty():
        raise ValueError("annotation keys must be there and differ")
    return a


def read_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a run registry that are there, by name."""
    out = {}
    for name in ("jobs", "managed_files", "generated_artifacts", "job_execution_plans", "projects"):
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except Exception as e:  # noqa: BLE001  a registry need not have all
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


EVENT_SCHEMA = """protocol_version int, type string, job_id string, job_revision long, sequence long, timestamp_utc timestamp, progress double, active_step_id string, log_level string, component string, message string,
artifact_step_id string, artifact_output_port string, artifact_plugin_id string, artifact_plugin_version string, artifact_module_id string, artifact_file_type string, artifact_relative_project_path string, exit_code long"""


def read_events(spark: SparkSession, path: str, streaming: bool = True, max_line: int = 64 << 10, complete: bool = False) -> DataFrame:
    """Worker events of NDJSON files, as a stream or at once, with _error: too_long, nul, not_json, a reason of event_error, or null. As a stream, files may grow, so a last line without an end waits unless they are complete: see
    helix.sources.events; where Python can't open the path, Spark's text source reads each file once."""
    from helix.functions.jobs import event_error
    from helix.sources.events import EventSource
    from helix.sources.storage import reachable

    if streaming and reachable(path):
        spark.dataSource.register(EventSource)
        text = spark.readStream.format("event_lines").option("complete", str(complete).lower()).load(path).select("value", "bytes")
    else:
        text = (spark.readStream if streaming else spark.read).text(path).select("value", F.octet_length("value").cast("long").alias("bytes"))
    lines = text.withColumn("value", F.regexp_replace("value", "\r$", "")).filter("value <> ''")
    e = lines.select("value", "bytes", F.from_json("value", EVENT_SCHEMA).alias("e")).select("value", "bytes", "e.*")
    framing = first_error((F.least(F.octet_length("value"), F.col("bytes")) > max_line, "too_long"), (F.contains("value", F.lit("\x00")), "nul"), (F.col("type").isNull() & F.col("job_id").isNull(), "not_json"))
    return e.withColumn("_error", F.coalesce(framing, event_error())).drop("value", "bytes")
