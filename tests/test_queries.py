"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import pytest

from tests.oracle import differences
from tidemark.plans import catalogue, catalogue_reads  # noqa: F401  the second adds to the first's registry

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLE_SQL:
        found = differences(df, catalogue.ORACLE_SQL[name], SF)
        if found == "no rows":  # two empty results show nothing
            found = differences(catalogue.QUERIES[name](spark, LARGER), catalogue.ORACLE_SQL[name], LARGER)
        assert found == "", found
    else:
        assert df.columns and df.count() > 0


def test_hot_queries_have_no_nested_loops(spark):
    for name in ("feed_page", "feed_primary_only", "matched_sources", "interval_join_unique"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
