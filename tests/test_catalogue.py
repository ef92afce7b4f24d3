import pytest

from lexweave.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_oracle(spark, sf, duck, same, name):
    same(catalogue.queries()[name](spark, sf).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df())


def test_every_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert catalogue.FLAGSHIP in catalogue.queries()
