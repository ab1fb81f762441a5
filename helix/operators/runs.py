"""Queries over the history of runs: jobs, artifacts, plans, files and worker events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helix.functions.common import count_if
from helix.functions.jobs import HOLDS_SLOT, KINDS, LIVENESS, TRANSITIONS, clamp_progress

PROVENANCE = ("plugin_id", "plugin_version", "module_id", "file_type", "path")


def normalize_jobs(jobs: DataFrame) -> DataFrame:
    """Progress between 0 and 1, status unknown and priority normal where there are none; jobs without an id are left out."""
    ok = jobs.filter(F.coalesce(F.col("job_id").cast("string"), F.lit("")) != "")
    return ok.withColumns({"progress": clamp_progress("progress"), "status": F.coalesce("status", F.lit("unknown")), "priority": F.coalesce("priority", F.lit("normal")), "revision": F.coalesce("revision", F.lit(0))})


def filter_jobs(jobs: DataFrame, kind: str) -> DataFrame:
    return jobs if kind == "all" else jobs.filter(F.col("status").isin(*KINDS[kind]))


def managed_inputs(files: DataFrame) -> DataFrame:
    return files.filter("storage_mode = 'managed_copy'")


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("jobs"), *[count_if(F.col("status").isin(*KINDS[k])).alias(k) for k in ("active", "completed", "attention")])


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Rows (from_status, to_status and others) that no rule allows."""
    edges = log.sparkSession.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "from_status string, to_status string")
    return log.join(F.broadcast(edges), ["from_status", "to_status"], "left_anti")  # a table of fixed size


def launchable(jobs: DataFrame, plans: DataFrame) -> DataFrame:
    """Queued jobs with launchable: a prepared plan of the next revision and the same pipeline is there."""
    p = plans.select(F.col("job_id").alias("_j"), "launch_revision", F.col("pipeline_id").alias("_p"), F.col("pipeline_version").alias("_v"))
    on = (F.col("job_id") == F.col("_j")) & (F.col("launch_revision") == F.col("revision") + 1) & (F.col("pipeline_id") == F.col("_p")) & (F.col("pipeline_version") == F.col("_v"))
    return jobs.filter("status = 'queued'").join(p, on, "left").withColumn("launchable", F.col("_j").isNotNull()).drop("_j", "_p", "_v", "launch_revision")


def priority_rank() -> Column:
    return F.when(F.col("priority") == "high", 0).when(F.col("priority") == "normal", 1).otherwise(2)


def launch_order(jobs: DataFrame, slots: int) -> DataFrame:
    """The queued jobs that start next: by priority, age and id, as many as slots are free."""
    busy = jobs.filter(F.col("status").isin(*HOLDS_SLOT)).limit(slots).count()  # slots at most
    return jobs.filter("status = 'queued'").orderBy(priority_rank(), "created_at", "job_id").limit(max(0, slots - busy))


def job_report(jobs: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """A record for each job with its artifacts (step, port, file) in order."""
    a = artifacts.join(files.select("file_id", "file_name", "size"), "file_id").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("step_id", "port", "file_id", "file_name", "size"))).alias("artifacts"))
    return jobs.join(a, "job_id", "left").withColumn("n_artifacts", F.coalesce(F.size("artifacts"), F.lit(0))).withColumn("n_artifacts", F.greatest("n_artifacts", F.lit(0)))


def unregistered_outputs(listing: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Output files (path, job_id) of jobs that no artifact has."""
    return listing.join(artifacts.select("path").distinct(), "path", "left_anti")


def provenance_conflicts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Registrations of (job_id, step_id, port) that exist with other attributes."""
    keys = ["job_id", "step_id", "port"]
    old = existing.select(*keys, *[F.col(c).alias(f"_{c}") for c in PROVENANCE])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PROVENANCE]
    agree = same[0]
    for s in same[1:]:
        agree = agree & s
    return new.join(old, keys).filter(~agree).select(*new.columns)


def checkpoints(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("job_id").agg(F.max("step_progress").alias("checkpoint"))


def recovered(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Jobs that still hold a slot, interrupted, with the greater of their progress and their artifacts' checkpoint."""
    held = jobs.filter(F.col("status").isin(*HOLDS_SLOT)).join(checkpoints(artifacts), "job_id", "left")
    return held.withColumn("progress", F.greatest("progress", F.coalesce("checkpoint", F.lit(0.0)))).withColumn("status", F.lit("interrupted")).drop("checkpoint")


def progress_rollup(steps: DataFrame, by: str = "job_id") -> DataFrame:
    """Steps (weight, progress) -> each job's weighted progress."""
    r = steps.groupBy(by).agg((F.sum(F.col("weight") * F.col("progress")) / F.sum("weight")).alias("p"))
    return r.select(by, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p"))), 6).alias("progress"))


def dependency_violations(steps: DataFrame) -> DataFrame:
    """Steps (job_id, step_id, progress, depends_on: array) that have begun before one they depend on was done."""
    begun = steps.filter("progress > 0").select("job_id", "step_id", F.explode("depends_on").alias("needs"))
    done = steps.select("job_id", F.col("step_id").alias("needs"), F.col("progress").alias("_p"))
    return begun.join(done, ["job_id", "needs"], "left").filter(F.coalesce("_p", F.lit(0.0)) < 1.0).select("job_id", "step_id", "needs")


def expired(listing: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Files (modified) at least so many days old; those of the future stay."""
    return listing.filter(F.col("modified") <= now - F.make_dt_interval(F.lit(days)))


def _arrival(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("arrival")


def sequence_check(events: DataFrame) -> DataFrame:
    """Events (job_id, sequence, arrival) with verdict: ok, gap, duplicate or out_of_order. The first is 1, each the last plus one."""
    last = F.coalesce(F.max("sequence").over(_arrival("job_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = F.lag("sequence").over(_arrival("job_id"))
    s = F.col("sequence")
    return events.withColumn("_last", last).withColumn("verdict", F.when(s == F.col("_last") + 1, "ok").when(s > F.col("_last") + 1, "gap").when(s.eqNullSafe(seen), "duplicate").otherwise("out_of_order")).drop("_last")


def stale_progress(events: DataFrame) -> DataFrame:
    """Progress events whose value is under an earlier one's."""
    p = events.filter("event_type = 'progress'")
    before = F.max("progress").over(_arrival("job_id").rowsBetween(Window.unboundedPreceding, -1))
    return p.withColumn("before", before).filter(F.col("progress") < F.col("before"))


def newer_events(events: DataFrame) -> DataFrame:
    """Events that are newer than all before them of their job, by (launch_revision, sequence)."""
    at = F.struct("launch_revision", "sequence")
    before = F.max(at).over(_arrival("job_id").rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_b", before).filter(F.col("_b").isNull() | (at > F.col("_b"))).drop("_b")


def heartbeat_gaps(events: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Liveness events (ts) that the next of their job follows only after so many seconds."""
    live = events.filter(F.col("event_type").isin(*LIVENESS))
    w = Window.partitionBy("job_id").orderBy("ts", "sequence")
    return live.withColumn("next_ts", F.lead("ts").over(w)).filter((F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6 >= seconds)


def bounded_log(events: DataFrame, most: int = 200, by: str = "job_id") -> DataFrame:
    """The newest log lines of each key, with how many older ones were dropped."""
    w = Window.partitionBy(by).orderBy(F.desc("sequence"))
    r = events.filter("event_type = 'log'").withColumn("n", F.row_number().over(w)).withColumn("dropped", F.greatest(F.count("*").over(Window.partitionBy(by)) - most, F.lit(0)))
    return r.filter(F.col("n") <= most)
