"""SQL functions give what the column forms give, and nothing of them runs in Python."""

import pytest
from pyspark.sql import functions as F

from helix.functions import alignment as A
from helix.functions.register import register_functions, scalars, tables
from helix.operators.reads import n50

#: A few values for each type of parameter, odd ones among them.
VALUES = {
    "STRING": ["", "@r1/1 2:x", ">c1 x", "ACGTNRYacgt", "I5!~", "5S3M2D1I4M", "10M", "DP=3;AF=0.5,0.2;X", ".", "PASS", "q10;s50", "A,<DEL>", "A", "G", "+", "*", "=", "é\t'x\\\\y", "a.fastq.gz", "ACGT", "DP", None],
    "INT": [0, 4, 16, 67, 99, 255, 2048, 70_000, -1, None], "BIGINT": [0, 1, 150, -7, None], "DOUBLE": [0.0, 0.5, -3.25, float("nan"), None], "BOOLEAN": [True, False, None],
    "ARRAY<STRING>": [["NM:i:3"], ["XX:Z:a", "NM:i:12"], ["NM:i:1", "NM:i:2"], [], None],
}


def rows(spark, parameters):
    pairs = [p.split(" ", 1) for p in parameters.split(", ")]
    n = 60
    data = [tuple(VALUES[t][(i * (k + 3) + k + i // 7) % len(VALUES[t])] for k, (_, t) in enumerate(pairs)) for i in range(n)]
    return spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in pairs)), ", ".join(c for c, _ in pairs)


@pytest.fixture(scope="module")
def sql(spark):
    register_functions(spark)
    return spark


def test_scalars(sql):
    for name, parameters, column in scalars():
        df, names = rows(sql, parameters)
        got = df.selectExpr(f"helix_{name}({names}) AS x")
        if name == "adapter_position":
            df = df.withColumns({"min_overlap": F.lit(4), "max_mismatches": F.lit(1)})
            got = df.selectExpr(f"helix_{name}({names}) AS x")
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
        assert list(map(repr, got.collect())) == list(map(repr, df.select(column.alias("x")).collect())), name


def test_tables(sql):
    for name, parameters, _, column in tables():
        df, names = rows(sql, parameters)
        df.createOrReplaceTempView("given")
        got = sql.sql(f"SELECT g.*, t.* FROM given g, LATERAL helix_{name}({names}) t")
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
        want = df.select("*", F.explode(column).alias("x")).select(*df.columns, "x.*")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() > 5, name


def test_n50_of_a_large_group(sql):
    d = sql.range(300_000).selectExpr("id % 3 AS g", "cast(pow(id % 1000, 2) AS bigint) AS length").unionByName(sql.range(1).selectExpr("7L AS g", "5L AS length"))
    d.createOrReplaceTempView("lengths")
    got = sql.sql("SELECT g, helix_n50(map_from_entries(collect_list(struct(length, n)))) AS n50 FROM (SELECT g, length, count(*) AS n FROM lengths GROUP BY g, length) GROUP BY g").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, n50(d, "length", ["g"]).collect())) and len(got) == 4
    assert A.FLAGS
