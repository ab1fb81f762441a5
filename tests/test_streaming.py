import json

import pytest
from pyspark.sql import functions as F

from helix.sources.vcf import read_events
from helix.streaming.lifecycle import ROCKSDB, Lifecycle, follow, live_jobs


N = iter(range(60))


def event(job, seq, kind, **more):
    """Its time is its place in the log."""
    return {"protocol_version": 1, "type": kind, "job_id": job, "job_revision": 3, "sequence": seq, "timestamp_utc": f"2024-01-01T00:00:{next(N):02d}Z", **more}


ART = {"artifact_step_id": "s1", "artifact_plugin_id": "p", "artifact_plugin_version": "1", "artifact_module_id": "m", "artifact_file_type": "vcf"}
LOG = [
    event("a", 1, "ready"), event("a", 2, "heartbeat"), event("a", 3, "progress", progress=0.5), event("a", 4, "progress", progress=0.4), event("a", 4, "artifact", artifact_output_port="x", artifact_relative_project_path="o/x", **ART),
    event("a", 5, "artifact", artifact_output_port="x", artifact_relative_project_path="o/y", **ART), event("a", 5, "progress", progress=0.9, active_step_id="s1"), event("a", 6, "completed", exit_code=0), event("a", 7, "heartbeat"),
    event("b", 1, "heartbeat"), event("b", 1, "ready"), event("b", 3, "heartbeat"), event("b", 2, "failed", exit_code=2, message="no"),
]
WANT = {"a": ["started", "observed", "progressed", "stale_progress", "buffered", "duplicate_artifact", "progressed", "completed", "after_terminal"], "b": ["before_ready", "started", "not_contiguous", "failed"]}


def test_steps():
    class E(dict):
        def __getitem__(self, k):
            return self.get(k)

    got = {}
    states = {}
    for e in LOG:
        s, pending = states.setdefault(e["job_id"], ({"revision": 3, "sequence": 0, "status": "preparing", "progress": 0.0, "ready": False, "terminal": False, "exit_code": None}, []))
        reason, action, n = Lifecycle.step(s, pending, E(e))
        if reason is None:
            s["sequence"] = e["sequence"]
        got.setdefault(e["job_id"], []).append(reason or action)
    assert got == WANT
    s, pending = states["a"]
    assert Lifecycle.step(s, pending, E(type="exit", exit_code=0)) == (None, "finalized", 0)
    assert Lifecycle.step(s, pending, E(type="exit", exit_code=1))[0] == "exit_mismatch"


def test_event_source_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    cut = 6
    for i, part in enumerate((LOG[:cut], LOG[cut:])):
        (src / f"{i}.json").write_text("\n".join(json.dumps(e) for e in part) + ("" if i else "\n{\n\n"))
    checked = read_events(spark, str(src), streaming=False)
    assert {r["_error"]: r["n"] for r in checked.groupBy("_error").agg(F.count("*").alias("n")).collect()} == {None: 13, "not_json": 1}
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        stream = read_events(spark, str(src), complete=True).filter("_error IS NULL").withColumn("arrival", F.col("timestamp_utc"))
        q = follow(stream, str(tmp_path / "ck"), str(tmp_path / "view"), timeout_ms=0).trigger(availableNow=True).start()
        assert q.awaitTermination(400)
        jobs = {r["job_id"]: (r["status"], r["progress"]) for r in live_jobs(spark, str(tmp_path / "view")).collect()}
        assert jobs == {"a": ("completed", 1.0), "b": ("failed", 0.0)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
