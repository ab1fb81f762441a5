"""an inferred filter on an array's size doesn't compute the array a second time and more below the projections."""

from pyspark.sql import functions as F

from helix import registry
from helix.operators import variants as V
from helix.plans.variant_queries import OPTIONS
from tests.test_oracles import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_soft_filters_are_computed_once(spark):
    """DP's pattern stood dozens of times in the plan of P37_P38, as the filter had all of it for each of its uses."""
    assert plan(registry.QUERIES["P37_P38_soft_filters"](spark, SF)).count("(?:^|;)DP=") <= 2
    assert "size(" not in "".join(line for line in plan(registry.QUERIES["P37_P38_soft_filters"](spark, SF)).splitlines() if "Filter" in line)


def test_records_without_reasons_have_no_rows(spark):
    """An invalid input filter or no ALT: as posexplode had it."""
    rows = [(1, "chr1", 5, "A", "G,T", "a;a", "DP=9"), (2, "chr1", 6, "A", None, "PASS", "DP=9"), (3, "chr1", 7, "A", "G", ".", "DP=9")]
    qc = V.qc_records(spark.createDataFrame(rows, "ordinal int, chrom string, pos long, ref string, alt string, flt string, info string"), OPTIONS)
    want = qc.select(F.posexplode(F.arrays_zip("alts", "reasons", "soft"))).count()
    assert V.explode_alleles(qc).count() == want
