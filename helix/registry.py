"""Registered queries of the sequencing operators, each with its DuckDB form where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from helix.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return f

    return register


from helix.plans import alignment_queries, read_queries, round_trip_queries, run_queries, variant_queries, whole_read_queries  # noqa: E402, F401  they register themselves
