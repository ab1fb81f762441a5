"""Worker events as a stream: a state machine for each job, and a view of all jobs that follows it.

The state of a job is its last sequence number, status, progress and the artifacts of the step that is not yet committed; it is
kept in RocksDB by job. A worker that is silent for longer than the timeout interrupts its job, on a processing-time timer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from helix.functions.jobs import LIVENESS, TERMINAL

OUTPUT = "job_id string, launch_revision long, sequence long, type string, action string, status string, progress double, committed int, reason string"
STATE = "revision long, sequence long, status string, progress double, ready boolean, terminal boolean, exit_code long"
ARTIFACT = "step string, port string, module string, path string"


class Lifecycle(StatefulProcessor):
    """Events of a job in order of arrival -> a row for each: what it did, or why it was rejected; and rows for timeouts.

    Input: job_id, job_revision, sequence, type, progress, active_step_id, exit_code, artifact_*; type exit is the end of the process. A job starts
    preparing at its first event's revision.
    """

    def __init__(self, timeout_ms: int = 30_000):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)
        self.pending = handle.getListState("pending", ARTIFACT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.job.get()
        s = dict(zip(("revision", "sequence", "status", "progress", "ready", "terminal", "exit_code"), state, strict=True)) if state else None
        pending = [tuple(x) for x in self.pending.get()]
        live = False
        for e in sorted(rows, key=lambda r: (r["arrival"], r["sequence"] or 0)):
            if s is None:
                s = {"revision": e["job_revision"], "sequence": 0, "status": "preparing", "progress": 0.0, "ready": False, "terminal": False, "exit_code": None}
            reason, action, committed = self.step(s, pending, e)
            if reason is None and e["type"] != "exit":
                s["sequence"] = e["sequence"]
            live |= reason is None and e["type"] in LIVENESS
            yield Row(job_id=key[0], launch_revision=s["revision"], sequence=e["sequence"], type=e["type"], action=action, status=s["status"], progress=s["progress"], committed=committed, reason=reason)
        if s is not None:
            self.job.update(tuple(s.values()))
            self.pending.clear()
            if pending:
                self.pending.put(pending)
        if self.timeout_ms and s is not None and (live or s["status"] in TERMINAL):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if s["status"] not in TERMINAL:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.job.get()
        if state and state[2] in ("preparing", "running", "cancelling"):
            s = list(state)
            s[2] = "interrupted"
            self.job.update(tuple(s))
            self.pending.clear()
            yield Row(job_id=key[0], launch_revision=s[0], sequence=None, type="timeout", action="interrupted", status="interrupted", progress=s[3], committed=0, reason=None)

    @staticmethod
    def step(s: dict, pending: list[tuple], e: Row) -> tuple[str | None, str | None, int]:
        """One event applied to the state -> why it is rejected, what it did, how many artifacts it committed."""
        kind = e["type"]
        if kind == "exit":
            pending.clear()
            if s["terminal"]:
                return ("exit_mismatch" if e["exit_code"] != s["exit_code"] else None), "finalized", 0
            s["status"], s["terminal"] = ("cancelled" if s["status"] == "cancelling" else "interrupted"), True
            return None, s["status"], 0
        if e["job_revision"] != s["revision"]:
            return "wrong_revision", None, 0
        if e["sequence"] != s["sequence"] + 1:
            return "not_contiguous", None, 0
        if s["terminal"]:
            return "after_terminal", None, 0
        if kind == "log":
            return None, "logged", 0
        if kind == "ready":
            if s["ready"] or s["status"] != "preparing":
                return "not_preparing", None, 0
            s["ready"], s["status"] = True, "running"
            return None, "started", 0
        if kind == "failed":
            if s["status"] not in ("preparing", "running", "cancelling"):
                return "not_running", None, 0
            s["status"], s["terminal"], s["exit_code"] = "failed", True, e["exit_code"]
            pending.clear()
            return None, "failed", 0
        if not s["ready"]:
            return "before_ready", None, 0
        if kind == "heartbeat":
            return (None, "observed", 0) if s["status"] in ("preparing", "running", "cancelling") else ("inactive", None, 0)
        if s["status"] != "running":
            return "not_running", None, 0
        if kind == "artifact":
            a = (e["artifact_step_id"], e["artifact_output_port"], e["artifact_module_id"], e["artifact_relative_project_path"])
            if any((p[0], p[2]) != (a[0], a[2]) for p in pending):
                return "other_step", None, 0
            if any(p[1] == a[1] or p[3] == a[3] for p in pending):
                return "duplicate_artifact", None, 0
            pending.append(a)
            return None, "buffered", 0
        if kind == "progress":
            if e["progress"] is None or e["progress"] < s["progress"]:
                return "stale_progress", None, 0
            if pending and e["active_step_id"] != pending[0][0]:
                return "open_batch", None, 0
            n = len(pending)
            pending.clear()
            s["progress"] = e["progress"]
            return None, "progressed", n
        if kind == "completed":
            if pending:
                return "open_batch", None, 0
            s["status"], s["progress"], s["terminal"], s["exit_code"] = "completed", 1.0, True, 0
            return None, "completed", 0
        return "unknown_type", None, 0


def job_lifecycle(events: DataFrame, timeout_ms: int = 30_000) -> DataFrame:
    """A stream of events (with arrival, their order) -> a stream of what each did. Needs the RocksDB state store."""
    return events.groupBy("job_id").transformWithState(statefulProcessor=Lifecycle(timeout_ms), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime" if timeout_ms else "None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def upsert_live_jobs(spark: SparkSession, updates: DataFrame, path: str, batch: int) -> None:
    """Put a batch of updates into the view of jobs at path/v=<batch>: the newest by (revision, sequence), progress never less than before within a
    revision, terminal states kept. Writing a batch again replaces it, so repeated batches do no harm. The last few views stay."""
    new = updates.filter("reason IS NULL").select("job_id", F.col("launch_revision").alias("revision"), F.coalesce("sequence", F.lit(1 << 60)).alias("sequence"), "status", "progress")
    seen = live_jobs(spark, path, batch)
    rows = new if seen is None else new.unionByName(seen)
    cursor = F.struct("revision", F.col("status").isin(*TERMINAL).alias("terminal"), "sequence")
    top = rows.groupBy("job_id", "revision").agg(F.max("progress").alias("progress"), F.max_by(F.struct("status", "sequence"), cursor).alias("s"))
    newest = top.groupBy("job_id").agg(F.max_by(F.struct("revision", "progress", "s"), "revision").alias("t")).select("job_id", F.col("t.revision").alias("revision"), F.col("t.s.sequence").alias("sequence"), F.col("t.s.status").alias("status"), F.col("t.progress").alias("progress"))
    newest.write.mode("overwrite").parquet(f"{path}/v={batch:012d}")
    # a batch that is repeated starts from the view before it, and who reads the one before may still do so
    for name in _views(spark, path)[:-KEPT]:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


#: Views of the jobs that stay.
KEPT = 3


def _views(spark: SparkSession, path: str) -> list[str]:
    """The complete views at a path, oldest first."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(fs_path))
    return [n for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def live_jobs(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest view of the jobs (before a batch); null if there is none."""
    names = [n for n in _views(spark, path) if before is None or int(n[2:]) < before]
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None


def follow(events: DataFrame, checkpoint: str, view: str, timeout_ms: int = 30_000):
    """Start the stream: events through the state machine into the view of jobs."""
    spark = events.sparkSession
    out = job_lifecycle(events, timeout_ms)
    return out.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: upsert_live_jobs(spark, df, view, n))
