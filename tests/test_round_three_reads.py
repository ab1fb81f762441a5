"""Reads in time that grows with their letters."""

import pyarrow as pa
import pytest

from helix import registry
from helix.functions.fastq import _profiles, adapter_position, profile_expression, quality_profile
from helix.plans import adapters
from tests.compare import duck


@pytest.mark.parametrize("kind", ["reads", "first_reads", "whole_reads"])
def test_reads_are_those_of_the_sql(spark, tmp_path, kind):
    """Texts of each length about the cuts, null and empty ones, other letters and scripts."""
    texts = [None, "", "1 2", "Z", "a" * 19, "b" * 20, "c" * 149, "d" * 150, "e" * 151, "f" * 299, "g" * 300, "h" * 301, "\u00e9\u4e2d Ab-Cd " * 90, "The quick brown fox. " * 500]
    rows = [(i, t, None if i % 3 else "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    names, want = duck(f"{adapters.duck(kind)} SELECT read_id, lang, seq, qual FROM {kind}", str(tmp_path))
    got = adapters.table(spark, str(tmp_path), kind).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(got) > 5


def test_a_document_is_cut_once(spark, tmp_path):
    """F13 to F27: of a document of 1.2 million letters a text of its length was made for each of its 8,000 reads."""
    spark.createDataFrame([(1, "acgtnryk" * 150_000, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    row = registry.QUERIES["F2_fastq_qc"](spark, str(tmp_path)).first()
    assert (row["reads"], row["bases"]) == (8000, 1_200_000)
    plan = registry.QUERIES["P8_P9_reverse"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row for a read that carries its document


def test_profiles_by_bytes_are_those_of_the_expression(spark):
    d = spark.createDataFrame([(q,) for q in ("", None, "I", "!I5?", "~" * 300, "4" * 3 + "5" + ">" + "?")], "q string")
    rows = d.select(quality_profile("q").alias("a"), profile_expression("q").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and len(rows) == 6
    # characters beyond ASCII are one each
    assert _profiles(pa.array(["I\u00e9", "5"])).to_pylist()[0]["high"] == 0xE9 - 33


def test_adapters_at_ends(spark):
    cases = [("", 0), ("AC", 2), ("GGACGTTG", 2), ("GGACGT", 2), ("GGACCT", 2), ("GGACCC", 6), ("ACGTTG", 0), ("TTTTACGTT", 4), (None, None)]
    d = spark.createDataFrame(cases, "s string, want int")
    for r in d.select("s", "want", adapter_position("s", "ACGTTG", 4, 1).alias("at")).collect():
        assert r["at"] == r["want"], r
