"""Exact deduplication in several calls over one state."""

import pytest
from pyspark.sql import functions as F

from helix.llm.exact_dedup import exact_dedup, sha256

ROWS = [(5, "a  b"), (6, "c"), (7, "a b"), (4, "c"), (8, None), (3, "a b"), (9, "new"), (2, ""), (1, "ac")]


@pytest.mark.parametrize("digest", [sha256, lambda t: (F.length(t) % 2).cast("string")])
def test_later_calls_add_to_the_state(spark, tmp_path, digest):
    parts = []
    for i, rows in enumerate((ROWS[:3], ROWS[3:5], ROWS[5:])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/part{i}")
        parts.append(f"{tmp_path}/part{i}")
        got = exact_dedup(spark.read.parquet(parts[-1]), digest=digest, state_dir=f"file://{tmp_path}/state")
        want = exact_dedup(spark.read.parquet(*parts))
        columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_columns_may_have_the_names_of_places(spark, tmp_path):
    d = spark.createDataFrame([(1, "x", "f", 0), (2, "x", "f", 0), (3, "y", "f", 0)], "doc_id long, text string, _file string, _row long")
    assert sorted((r["doc_id"], r["kept"]) for r in exact_dedup(d).collect()) == [(1, True), (2, False), (3, True)]
