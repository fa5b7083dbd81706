import pytest

import __spark_entry__
from quern import queries as catalogue
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.SQL[name], SF)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["rank", "key", "value"] and df.count() > 0


def test_every_query_is_described():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.SQL) == set(catalogue.QUERIES)
