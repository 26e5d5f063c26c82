from landpanel import plans
from landpanel.plans.base import WHOLE_GRID, whole_grid

import pytest

from oracle import connect


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_the_grid_grows_and_keeps_all_classes(spark, size):
    d = f"/root/testdata/{size}"
    orders = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey").distinct().count()
    by_code = {r.code: r["count"] for r in whole_grid(spark, d).groupBy("code").count().collect()}
    assert sum(by_code.values()) == orders and sorted(by_code) == [0, 1, 2, 3]
    assert min(by_code.values()) > 0.15 * orders
    assert by_code == dict(connect(d).execute(f"WITH {WHOLE_GRID} SELECT code, count(*) FROM grid GROUP BY 1").fetchall())


def test_grid_queries_tell_classes_apart_on_larger_tables(spark):
    d = "/root/testdata/sf0.1"
    assert plans.QUERIES["a28_area_by_class"](spark, d).count() == 4
    r = plans.QUERIES["a42_seam_ratio"](spark, d).first()
    assert r.ratio is not None and 0 < plans.QUERIES["a29_coverage_dual"](spark, d).first().pixel_share < 1
