import pytest

import __spark_entry__ as driver
from tests.compare import oracle_rows, query_rows
from topicspark.plans import registry

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert driver.entry(spark).columns == ["cluster", "rank", "term", "score"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert query_rows(registry.queries()[name](spark, SF)) == oracle_rows(registry.oracle_sql()[name], SF)
