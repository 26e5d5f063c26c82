import random

import pytest
from pyspark.sql import functions as F

from landpanel.functions import geo
from landpanel.operators import joins

SQUARES = "region string, ring array<struct<x:double,y:double>>"


def test_a_point_off_the_middle_of_a_long_edge_gets_that_edge(spark):
    long = ("long", [(80.0, 30.0), (100.0, 30.0), (100.0, 40.0), (80.0, 40.0)])
    small = ("small", [(89.9, 28.0), (90.1, 28.0), (90.1, 28.2), (89.9, 28.2)])
    e = joins.edges_of(spark.createDataFrame([long, small], SQUARES))
    p = spark.createDataFrame([(1, 90.0, 29.9), (2, 90.0, 35.0), (3, 90.0, 28.3), (4, -60.0, -30.0)], "row_id bigint, lon double, lat double")
    got = {r.row_id: r for r in joins.attribute_region(p, e).collect()}
    assert (got[1].region, got[1].inside) == ("long", False) and got[1].edge_km == pytest.approx(0.1 * joins.KM_PER_DEG, abs=1e-5)
    assert (got[2].region, got[2].inside, got[2].edge_km) == ("long", True, None)
    assert got[3].region == "small" and got[3].edge_km == pytest.approx(0.1 * joins.KM_PER_DEG, abs=1e-5)
    assert got[4].edge_km > 5000


def test_rings_of_cells_find_what_all_pairs_find(spark):
    r = random.Random(5)
    edges = spark.createDataFrame([(f"r{i}", *(x := (r.uniform(70, 130), r.uniform(-60, 60))), x[0] + r.uniform(-15, 15), x[1] + r.uniform(-15, 15)) for i in range(40)], "region string, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(i, r.uniform(60, 140), r.uniform(-75, 75)) for i in range(200)], "row_id bigint, lon double, lat double")
    foot = joins.edge_foot(*(F.col(c) for c in ("lon", "lat", "x1", "y1", "x2", "y2")))
    km = F.round(geo.haversine_km(F.col("lon"), F.col("lat"), *foot), 6)
    want = p.crossJoin(edges).groupBy("row_id").agg(F.min(F.struct(km.alias("km"), "region")).alias("m")).select("row_id", "m.region", "m.km")
    for start in (5.0, 50.0):
        assert sorted(map(tuple, joins.nearest_edge(p, edges, km=start).collect())) == sorted(map(tuple, want.collect()))
