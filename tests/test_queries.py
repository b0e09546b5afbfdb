import pytest

import __spark_entry__
from quadrille.queries import ORACLES, QUERIES

from .conftest import plain


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), columns)


def test_comparisons_cover_every_part(spark):
    """No part is left out by its id, also where there are more than the small tables have."""
    found = QUERIES["compare_all"](spark, "/root/testdata/sf0.01")
    assert found.count() == spark.read.parquet("/root/testdata/sf0.01/part.parquet").count() > 301


def test_bound_meets_every_order(spark):
    """No order is left out by its id: every one gives a row in which it is bound."""
    found = QUERIES["if_coalesce_bound"](spark, "/root/testdata/sf0.01")
    assert found.where("has = 'yes' and first >= 0").count() == spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count() > 500


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_nested_loops(spark, small):
    """Equal variables never become a nested loop or a product, and a star is one scan."""
    for name in ("bgp_revenue_by_nation", "optional_filter", "minus", "exists", "values_undef", "optional_then_join"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        if name in ("bgp_revenue_by_nation", "optional_filter", "minus", "exists"):
            assert "Join Cross" not in plan, name
    plan = QUERIES["bgp_star"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PushedFilters" in plan and "c_nationkey" not in plan
