import pytest

from landpanel import plans

from oracle import connect, same


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    same(plans.QUERIES[name](spark, sf_dir), duck, plans.SQL[name])
