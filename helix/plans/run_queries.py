"""Queries of run histories derived from customer, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helix.functions.jobs import KINDS, TRANSITIONS, artifact_category, event_error, infer_file_type, job_error
from helix.operators import runs as R
from helix.plans.adapters import duck, table
from helix.registry import query

J, A, E, FI = duck("jobs"), duck("artifacts"), duck("run_events"), duck("files")


def t(name: str):
    return lambda spark, d: table(spark, d, name)


jobs, artifacts, events, plans, files = (t(n) for n in ("jobs", "artifacts", "run_events", "run_plans", "files"))

CATEGORY = "CASE WHEN lower(coalesce(file_type, '')) = 'html' OR lower(port) = 'report' THEN 'report' WHEN lower(coalesce(file_type, '')) IN ('fasta', 'fastq', 'sam', 'bam', 'vcf') OR lower(port) IN ('alignment', 'variants', 'filtered', 'annotated', 'trimmed') THEN 'primary' WHEN lower(coalesce(file_type, '')) IN ('json', 'tsv') OR lower(port) IN ('summary', 'table') THEN 'summary' ELSE 'other' END"


@query("P43_artifact_category", f"{A} SELECT file_type, port, {CATEGORY} AS category, count(*) AS n FROM artifacts GROUP BY ALL")
def _(spark, d):
    return artifacts(spark, d).groupBy("file_type", "port", artifact_category("file_type", "port").alias("category")).agg(F.count("*").alias("n"))


@query("P44_file_type", f"{FI} SELECT file_id, CASE WHEN regexp_matches(lower(trim(file_name)), '\\.(fastq|fq)(\\.gz)?$') THEN 'fastq' WHEN lower(file_name) LIKE '%.fa' THEN 'fasta' WHEN lower(file_name) LIKE '%.bam' THEN 'bam' WHEN trim(file_name) LIKE '%.vcf' THEN 'vcf' WHEN file_name LIKE '%.tsv' THEN 'tsv' END AS type FROM files")
def _(spark, d):
    return files(spark, d).select("file_id", infer_file_type("file_name").alias("type"))


@query("P45_normalize_jobs", f"{J} SELECT job_id, status, coalesce(priority, 'normal') AS priority, greatest(0.0, least(1.0, progress)) AS progress, revision FROM jobs")
def _(spark, d):
    return R.normalize_jobs(jobs(spark, d)).select("job_id", "status", "priority", "progress", "revision")


for kind in ("active", "attention", "completed", "cancellable"):

    @query(f"P46_jobs_{kind}", f"{J} SELECT job_id, status FROM jobs WHERE status IN ({', '.join(repr(s) for s in KINDS[kind])})")
    def _(spark, d, kind=kind):
        return R.filter_jobs(jobs(spark, d), kind).select("job_id", "status")


@query("P47_managed_inputs", f"{FI} SELECT file_id FROM files WHERE storage_mode = 'managed_copy'")
def _(spark, d):
    return R.managed_inputs(files(spark, d)).select("file_id")


@query("P48_job_error", f"{J} SELECT job_id, CASE WHEN status = 'completed' AND progress <> 1 THEN 'incomplete' WHEN status IN ('cancelled', 'completed', 'failed') AND finished_at IS NULL THEN 'no_finish' WHEN status IN ('cancelled', 'completed', 'failed') AND active_step IS NOT NULL THEN 'active_step' WHEN status IN ('preparing', 'running', 'paused', 'cancelling', 'completed', 'failed', 'interrupted') AND started_at IS NULL THEN 'no_start' END AS error FROM jobs")
def _(spark, d):
    return jobs(spark, d).select("job_id", job_error().alias("error"))


EDGES = ", ".join(f"('{a}', '{b}')" for a, bs in TRANSITIONS.items() for b in bs)


@query("P49_transitions", f"{J}, l AS (SELECT job_id, status AS from_status, lead(status) OVER (ORDER BY job_id::BIGINT % 97, job_id::BIGINT) AS to_status FROM jobs) SELECT job_id, from_status, to_status FROM l WHERE to_status IS NOT NULL AND (from_status, to_status) NOT IN ({EDGES})")
def _(spark, d):
    other = jobs(spark, d).select(F.col("job_id").cast("long").alias("k"), "status")
    w = other.withColumn("r", F.struct((F.col("k") % 97).alias("a"), F.col("k").alias("k")))
    # the successor in the order of (id % 97, id): the next id of the same remainder, else the first of the next remainder
    nxt = w.select((F.col("k") - 97).alias("k"), F.col("status").alias("to_status"))
    firsts = w.groupBy("r.a").agg(F.min_by("status", "k").alias("first"))
    last = w.groupBy("r.a").agg(F.max("k").alias("k")).select((F.col("a") + 1).alias("a"), "k").join(firsts, "a").select("k", F.col("first").alias("to_status"))
    log = w.select("k", F.col("status").alias("from_status")).join(nxt.unionByName(last), "k").select(F.col("k").cast("string").alias("job_id"), "from_status", "to_status")
    return R.illegal_transitions(log).select("job_id", "from_status", "to_status")


@query("A25_job_counts", f"{J} SELECT count(*) AS jobs, {', '.join(f'''count_if(status IN ({', '.join(repr(s) for s in KINDS[k])})) AS {k}''' for k in ('active', 'completed', 'attention'))} FROM jobs")
def _(spark, d):
    return R.job_counts(jobs(spark, d))


STEPS = "SELECT job_id, step_id, CAST(file_id % 7 + 1 AS double) AS weight, CASE WHEN file_id % 4 = 0 THEN 1.0 ELSE step_progress END AS progress, CASE WHEN step_id = 's0' THEN NULL ELSE concat('s', cast(substr(step_id, 2, 1) AS int) - 1) END AS needs FROM artifacts"


def steps(spark: SparkSession, d: str) -> DataFrame:
    s = spark.sql(STEPS.replace("FROM artifacts", "FROM {artifacts}"), artifacts=artifacts(spark, d))
    return s.withColumn("depends_on", F.array_compact(F.array("needs")))


@query("A26_progress_rollup", f"{A}, s AS ({STEPS}) SELECT job_id, round(greatest(0.0, least(1.0, sum(weight * progress) / sum(weight))), 6) AS progress FROM s GROUP BY job_id")
def _(spark, d):
    return R.progress_rollup(steps(spark, d))


@query("A26_dependency_violations", f"{A}, s AS ({STEPS}) SELECT a.job_id, a.step_id, a.needs FROM s a LEFT JOIN s b ON a.job_id = b.job_id AND a.needs = b.step_id WHERE a.progress > 0 AND a.needs IS NOT NULL AND coalesce(b.progress, 0) < 1")
def _(spark, d):
    return R.dependency_violations(steps(spark, d))


@query("A27_checkpoints", f"{A} SELECT job_id, max(step_progress) AS checkpoint FROM artifacts GROUP BY job_id")
def _(spark, d):
    return R.checkpoints(artifacts(spark, d))


@query("T9_recovery", f"{duck('jobs', 'artifacts')} SELECT j.job_id, 'interrupted' AS status, greatest(j.progress, coalesce(c, 0)) AS progress FROM jobs j LEFT JOIN (SELECT job_id, max(step_progress) AS c FROM artifacts GROUP BY 1) a USING (job_id) WHERE status IN ('preparing', 'running', 'cancelling')")
def _(spark, d):
    return R.recovered(jobs(spark, d), artifacts(spark, d)).select("job_id", "status", "progress")


@query("J10_O3_F12_job_report", f"{duck('jobs', 'artifacts', 'files')}, a AS (SELECT job_id, count(*) AS n, string_agg(step_id || '/' || port || '/' || file_id || '/' || size, ' ' ORDER BY step_id, port, file_id) AS list FROM artifacts JOIN files USING (file_id) GROUP BY job_id) SELECT job_id, status, coalesce(n, 0)::INT AS n_artifacts, list FROM jobs LEFT JOIN a USING (job_id)")
def _(spark, d):
    r = R.job_report(jobs(spark, d), artifacts(spark, d), files(spark, d))
    return r.select("job_id", "status", "n_artifacts", F.array_join(F.transform("artifacts", lambda a: F.concat_ws("/", a["step_id"], a["port"], a["file_id"].cast("string"), a["size"].cast("string"))), " ").alias("list"))


@query("J11_U3_unregistered", f"{A} SELECT 'outputs/' || job_id || '--' || file_id AS path FROM artifacts WHERE file_id % 5 = 0")
def _(spark, d):
    a = artifacts(spark, d)
    return R.unregistered_outputs(a.select("path"), a.filter("file_id % 5 <> 0"))


@query("J12_launchable", f"{duck('jobs', 'run_plans')} SELECT j.job_id, p.job_id IS NOT NULL AS launchable FROM jobs j LEFT JOIN run_plans p ON j.job_id = p.job_id AND p.launch_revision = j.revision + 1 AND p.pipeline_id = j.pipeline_id AND p.pipeline_version = j.pipeline_version WHERE status = 'queued'")
def _(spark, d):
    return R.launchable(jobs(spark, d), plans(spark, d)).select("job_id", "launchable")


@query("J13_provenance_conflicts", f"{A}, u AS (SELECT * FROM artifacts QUALIFY row_number() OVER (PARTITION BY job_id, step_id, port ORDER BY file_id) = 1) SELECT job_id, step_id, port FROM u WHERE file_id % 8 = 1")
def _(spark, d):
    one = artifacts(spark, d).groupBy("job_id", "step_id", "port").agg(F.min_by(F.struct("file_id", *R.PROVENANCE), "file_id").alias("a")).select("job_id", "step_id", "port", "a.*")
    new = one.withColumn("plugin_version", F.when(F.col("file_id") % 8 == 1, "changed").otherwise(F.col("plugin_version")))
    return R.provenance_conflicts(new, one).select("job_id", "step_id", "port")


@query("W9_launch_order", f"{J} SELECT job_id FROM jobs WHERE status = 'queued' ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, created_at, job_id LIMIT greatest(0, 100000 - (SELECT count(*) FROM jobs WHERE status IN ('preparing', 'running', 'cancelling')))")
def _(spark, d):
    return R.launch_order(jobs(spark, d), 100_000).select("job_id")


@query("O1_O2_listing", f"{J} SELECT job_id, created_at FROM jobs ORDER BY created_at DESC, job_id")
def _(spark, d):
    return jobs(spark, d).select("job_id", "created_at").orderBy(F.desc("created_at"), "job_id")


@query("T10_retention", f"{FI} SELECT file_id FROM files WHERE modified <= TIMESTAMP '1996-01-01' - INTERVAL 30 DAY")
def _(spark, d):
    return R.expired(files(spark, d), F.lit("1996-01-01").cast("timestamp")).select("file_id")


@query("W6_sequence_check", f"{E}, l AS (SELECT job_id, sequence, coalesce(max(sequence) OVER (PARTITION BY job_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last, lag(sequence) OVER (PARTITION BY job_id ORDER BY arrival) AS seen FROM run_events) SELECT job_id, sequence, CASE WHEN sequence = last + 1 THEN 'ok' WHEN sequence > last + 1 THEN 'gap' WHEN sequence IS NOT DISTINCT FROM seen THEN 'duplicate' ELSE 'out_of_order' END AS verdict FROM l")
def _(spark, d):
    return R.sequence_check(events(spark, d)).select("job_id", F.col("sequence").cast("long").alias("sequence"), "verdict")


@query("W7_stale_progress", f"{E}, l AS (SELECT *, max(progress) OVER (PARTITION BY job_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM run_events WHERE event_type = 'progress') SELECT job_id, arrival, progress, before FROM l WHERE progress < before")
def _(spark, d):
    return R.stale_progress(events(spark, d)).select("job_id", "arrival", "progress", "before")


@query("W8_log_tail", f"{E}, l AS (SELECT job_id, arrival, row_number() OVER (PARTITION BY job_id ORDER BY sequence DESC) AS n FROM run_events WHERE event_type = 'log') SELECT job_id, arrival FROM l WHERE n <= 200")
def _(spark, d):
    return R.bounded_log(events(spark, d)).select("job_id", "arrival")


@query("T8_bounded_log", f"{E}, l AS (SELECT job_id, arrival, row_number() OVER (PARTITION BY job_id ORDER BY sequence DESC) AS n, greatest(count(*) OVER (PARTITION BY job_id) - 8, 0) AS dropped FROM run_events WHERE event_type = 'log') SELECT job_id, arrival, dropped FROM l WHERE n <= 8")
def _(spark, d):
    return R.bounded_log(events(spark, d), 8).select("job_id", "arrival", "dropped")


@query("W10_newer_events", f"{E}, k AS (SELECT *, launch_revision * 1000000 + sequence AS cursor FROM run_events), l AS (SELECT *, max(cursor) OVER (PARTITION BY job_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k) SELECT job_id, arrival FROM l WHERE before IS NULL OR cursor > before")
def _(spark, d):
    return R.newer_events(events(spark, d)).select("job_id", "arrival")


@query("W11_heartbeat_gaps", f"{E}, l AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, sequence) AS next_ts FROM run_events WHERE event_type IN ('ready', 'heartbeat', 'progress')) SELECT job_id, arrival FROM l WHERE (epoch_us(next_ts) - epoch_us(ts)) / 1e6 >= 7200")
def _(spark, d):
    return R.heartbeat_gaps(events(spark, d), 7200).select("job_id", "arrival")


T1 = "CASE WHEN job_id = '' THEN 'no_job' WHEN sequence < 1 THEN 'sequence' WHEN type = 'progress' AND progress IS NULL THEN 'missing_field' WHEN type = 'log' AND message IS NULL THEN 'missing_field' WHEN type = 'failed' AND exit_code IS NULL THEN 'missing_field' WHEN type IN ('ready', 'heartbeat', 'log', 'failed') AND progress IS NOT NULL THEN 'unrelated_field' WHEN type = 'progress' AND progress > 1 THEN 'progress_range' WHEN type = 'failed' AND exit_code = 0 THEN 'exit_code' END"
SHAPED = "SELECT arrival, 1 AS protocol_version, CASE WHEN arrival % 101 = 0 THEN '' ELSE job_id END AS job_id, launch_revision AS job_revision, CASE WHEN arrival % 103 = 0 THEN 0 ELSE sequence END AS sequence, event_type AS type, CASE WHEN event_type = 'progress' AND arrival % 7 <> 0 THEN progress + CASE WHEN arrival % 5 = 0 THEN 1 ELSE 0 END WHEN arrival % 107 = 0 THEN 0.5 END AS progress, CASE WHEN event_type = 'log' THEN 'info' END AS log_level, CASE WHEN event_type = 'log' THEN 'c' END AS component, CASE WHEN event_type IN ('log', 'failed') AND arrival % 11 <> 0 THEN 'm' WHEN event_type = 'failed' THEN 'm' END AS message, CASE WHEN event_type = 'failed' AND arrival % 3 <> 0 THEN arrival % 2 END AS exit_code FROM run_events"


@query("T1_event_error", f"{E}, s AS ({SHAPED}) SELECT arrival, {T1} AS error FROM s")
def _(spark, d):
    from helix.functions.jobs import OPTIONAL

    s = spark.sql(SHAPED.replace("FROM run_events", "FROM {run_events}"), run_events=events(spark, d))
    for c in OPTIONAL:
        if c not in s.columns:
            s = s.withColumn(c, F.lit(None).cast("string"))
    return s.select("arrival", event_error().alias("error"))
