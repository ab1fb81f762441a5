"""Jobs that are silent are interrupted; workflows and registry over files."""

import json
import time

import pytest

from helix import workflows as WF
from helix.options import TrimOptions
from helix.sources.vcf import read_events, read_registry
from helix.streaming.lifecycle import ROCKSDB, follow, live_jobs


def event(job, seq, kind, **more):
    return json.dumps({"protocol_version": 1, "type": kind, "job_id": job, "job_revision": 1, "sequence": seq, "timestamp_utc": f"2024-01-01T00:00:{seq:02d}Z", **more}) + "\n"


def test_a_silent_job_is_interrupted(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    folder, view = tmp_path / "in", str(tmp_path / "view")
    folder.mkdir()
    (folder / "a").write_text(event("silent", 1, "ready") + event("done", 1, "ready") + event("done", 2, "completed", exit_code=0))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        from pyspark.sql import functions as F

        stream = read_events(spark, str(folder)).filter("_error IS NULL").withColumn("arrival", F.col("timestamp_utc"))
        q = follow(stream, str(tmp_path / "ck"), view, timeout_ms=3000).trigger(processingTime="500 milliseconds").start()
        try:
            until, seen, n = time.time() + 120, {}, 1
            while time.time() < until and seen.get("silent") != "interrupted":
                time.sleep(1)
                assert q.exception() is None
                n += 1
                (folder / f"b{n}").write_text(event("other", n - 1, "ready" if n == 2 else "heartbeat"))  # a batch at least each second
                if (live := live_jobs(spark, view)) is not None:
                    seen = {r["job_id"]: r["status"] for r in live.collect()}
        finally:
            q.stop()
        assert seen["silent"] == "interrupted" and seen["done"] == "completed" and seen["other"] == "running"
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_trim_workflow_over_a_file(spark, tmp_path):
    path = tmp_path / "x.fq"
    path.write_text(f"@a\n{'ACGT' * 10}\n+\n{'I' * 35}!!!!!\n@b\nACGT\n+\nIIII\n")
    reads, summary = WF.trim_single(spark, str(path), TrimOptions())
    got = {r["header"]: (r["kept"], len(r["trimmed_seq"] or "")) for r in reads.collect()}
    assert got == {"@a": (True, 35), "@b": (False, 4)} and summary.first()["kept_reads"] == 1


def test_registry_tables_that_are_there(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "jobs"))
    spark.range(2).write.parquet(str(tmp_path / "managed_files"))
    found = read_registry(spark, str(tmp_path))
    assert {k: v.count() for k, v in found.items()} == {"jobs": 3, "managed_files": 2} and read_registry(spark, str(tmp_path / "none")) == {}
