import pytest

from helix import registry
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_duckdb(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLE[name], SF)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
