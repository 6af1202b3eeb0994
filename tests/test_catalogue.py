import pytest

import __spark_entry__
from voxframe.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(name, spark, sf_dir, duck, same_rows):
    same_rows(catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
