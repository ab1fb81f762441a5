"""Rows of the run registry: files, artifacts, jobs and worker events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helix.functions.common import col, first_error

#: The states of a job, which states may follow which, and groups of states.
TRANSITIONS = {
    "draft": ("queued", "cancelled"), "queued": ("preparing", "cancelling", "cancelled"), "preparing": ("running", "cancelling", "failed", "interrupted"),
    "running": ("paused", "cancelling", "completed", "failed", "interrupted"), "paused": ("running", "cancelling", "interrupted"), "cancelling": ("cancelled", "failed", "interrupted"),
    "interrupted": ("queued", "cancelled"), "cancelled": (), "completed": (), "failed": (),
}
TERMINAL = ("cancelled", "completed", "failed")
STARTED = ("preparing", "running", "paused", "cancelling", "completed", "failed", "interrupted")
HOLDS_SLOT = ("preparing", "running", "cancelling")
KINDS = {"active": ("queued", "preparing", "running", "cancelling"), "attention": ("failed", "interrupted"), "completed": ("completed",), "cancellable": ("draft", "queued", "preparing", "running", "paused", "interrupted")}
LIVENESS = ("ready", "heartbeat", "progress")


def infer_file_type(name: Column | str) -> Column:
    """The type that a file's name says, or null. The endings of each type."""
    n = F.lower(F.trim(col(name)))
    return F.when(n.rlike(r"\.(fastq|fq)(\.gz)?$"), "fastq").when(n.rlike(r"\.(fa|fasta|fna|ffn|faa|frn)$"), "fasta").when(n.rlike(r"\.(sam|bam|vcf|tsv)$"), F.regexp_extract(n, r"\.(\w+)$", 1))


def artifact_category(file_type: Column | str, port: Column | str) -> Column:
    """report, primary, summary or other. The types and ports of each."""
    t, p = F.lower(F.coalesce(col(file_type), F.lit(""))), F.lower(F.coalesce(col(port), F.lit("")))
    primary = t.isin("fasta", "fastq", "sam", "bam", "vcf") | p.isin("alignment", "variants", "filtered", "annotated", "trimmed", "trimmed_read1", "trimmed_read2")
    return F.when((t == "html") | (p == "report"), "report").when(primary, "primary").when(t.isin("json", "tsv") | p.isin("summary", "table"), "summary").otherwise("other")


def clamp_progress(p: Column | str) -> Column:
    """Between 0 and 1; 0 for null, NaN and infinities."""
    x = col(p).cast("double")
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit("Infinity").cast("double"))
    return F.when(odd, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def job_error() -> Column:
    """Why a job's row (status, progress, started_at, finished_at, active_step, revision) is invalid, or null."""
    s, terminal = F.col("status"), F.col("status").isin(*TERMINAL)
    return first_error(
        (F.col("revision") < 0, "negative_revision"), ((s == "completed") & (F.col("progress") != 1.0), "incomplete"), (terminal & F.col("finished_at").isNull(), "no_finish"),
        (~terminal & F.col("finished_at").isNotNull(), "early_finish"), (terminal & F.col("active_step").isNotNull(), "active_step"), (s.isin(*STARTED) & F.col("started_at").isNull(), "no_start"),
    )


_ARTIFACT = ("artifact_step_id", "artifact_output_port", "artifact_plugin_id", "artifact_plugin_version", "artifact_module_id", "artifact_file_type", "artifact_relative_project_path")
#: Of each event type the fields that it needs and those that it may have.
EVENT_FIELDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "ready": ((), ()), "heartbeat": ((), ()), "progress": (("progress",), ("active_step_id",)), "log": (("log_level", "component", "message"), ()), "artifact": (_ARTIFACT, ()),
    "completed": (("exit_code",), ()), "failed": (("exit_code", "message"), ()),
}
#: The greatest length of text fields.
EVENT_LENGTHS = {"job_id": 128, "active_step_id": 200, "component": 200, "message": 16384, "artifact_relative_project_path": 4096, "artifact_step_id": 200, "artifact_output_port": 200, "artifact_file_type": 128}
OPTIONAL = ("progress", "active_step_id", "log_level", "component", "message", *_ARTIFACT, "exit_code")


def event_error() -> Column:
    """Why a worker event is invalid, or null."""
    cases = [(F.col("protocol_version") != 1, "protocol"), (F.coalesce(F.col("job_id"), F.lit("")) == "", "no_job"), (F.col("job_revision") < 0, "revision"), (F.coalesce(F.col("sequence"), F.lit(0)) < 1, "sequence"), (~F.col("type").isin(*EVENT_FIELDS), "type")]
    for kind, (needs, may) in EVENT_FIELDS.items():
        mine = F.col("type") == kind
        cases += [(mine & F.col(f).isNull(), "missing_field") for f in needs]
        cases += [(mine & F.col(f).isNotNull(), "unrelated_field") for f in OPTIONAL if f not in needs + may]
    cases += [(F.length(F.col(f)) > n, "too_long") for f, n in EVENT_LENGTHS.items()]
    p = F.col("progress")
    cases += [((F.col("type") == "progress") & (F.isnan(p) | (p < 0) | (p > 1)), "progress_range"), ((F.col("type") == "completed") & (F.col("exit_code") != 0), "exit_code"), ((F.col("type") == "failed") & (F.col("exit_code") == 0), "exit_code")]
    return first_error(*cases)
