"""Distance joins against all pairs on the whole globe: across 180 degrees, beside the poles, at all radii."""

import math
import random

import pytest
from pyspark.sql import functions as F

from landpanel.functions import geo
from landpanel.operators import joins, spatial


def km(a, b):
    x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * geo.EARTH_KM * math.asin(min(1.0, math.sqrt(x)))


@pytest.fixture(scope="module")
def globe():
    r = random.Random(4)
    some = [(r.uniform(-180, 180), math.degrees(math.asin(r.uniform(-1, 1)))) for _ in range(120)]
    line = [(r.choice([-180, 180, 179.99, -179.99, 0]) + r.uniform(-0.3, 0.3), r.uniform(-80, 80)) for _ in range(60)]
    line = [((x + 180) % 360 - 180, y) for x, y in line]
    poles = [(r.uniform(-180, 180), s * (90 - r.expovariate(2))) for s in (-1, 1) for _ in range(40)] + [(0.0, 90.0), (120.0, 90.0), (5.0, -90.0), (180.0, 0.0), (-180.0, 0.0)]
    near = [(x + r.uniform(-0.2, 0.2), max(-90.0, min(90.0, y + r.uniform(-0.2, 0.2)))) for x, y in some + line + poles]
    return some + line + poles, near


def frames(spark, globe):
    a, b = ([(i, x, y) for i, (x, y) in enumerate(side)] for side in globe)
    return spark.createDataFrame(a, "a_id bigint, lon double, lat double"), spark.createDataFrame(b, "b_id bigint, lon double, lat double")


@pytest.mark.parametrize(("radius", "deal"), [(0.5, "b"), (25.0, "b"), (25.0, "a"), (400.0, "a"), (3000.0, "b"), (15000.0, "a")])
def test_within_km_finds_all_pairs(spark, globe, radius, deal):
    a, b = frames(spark, globe)
    got = {(r.a_id, r.b_id) for r in joins.within_km(a, b, radius, deal=deal).select("a_id", "b_id").collect()}
    edge = {(i, j) for i, x in enumerate(globe[0]) for j, y in enumerate(globe[1]) if abs(km(x, y) - radius) < 1e-6}
    want = {(i, j) for i, x in enumerate(globe[0]) for j, y in enumerate(globe[1]) if km(x, y) <= radius}
    assert got - edge == want - edge
    assert joins.within_km(a, b, radius, deal=deal).groupBy("a_id", "b_id").count().where("count > 1").count() == 0


def test_nearest_on_the_globe(spark, globe):
    a, b = frames(spark, globe)
    got = {r.a_id: r.km for r in joins.nearest(a, b, km=5.0).collect()}
    assert len(got) == len(globe[0])
    for i, x in enumerate(globe[0]):
        assert got[i] == pytest.approx(min(km(x, y) for y in globe[1]), abs=1e-6)
    odd = spark.createDataFrame([(1, None, 3.0), (2, float("nan"), 1.0), (3, 1.0, 95.0), (4, 1.0, 1.0)], "a_id bigint, lon double, lat double")
    assert [r.a_id for r in joins.nearest(odd, b).collect()] == [4]
    assert joins.nearest(a, b.where("false")).count() == 0


def test_a_point_across_180_degrees_gets_the_edge_beside_it(spark):
    p = spark.createDataFrame([(1, -179.95, 10.0), (2, 179.9, 10.0), (3, 10.0, 89.0)], "row_id bigint, lon double, lat double")
    e = spark.createDataFrame([("east", 179.8, 5.0, 179.8, 15.0), ("west", -170.0, 5.0, -170.0, 15.0), ("north", -175.0, 88.0, -165.0, 88.0)], "region string, x1 double, y1 double, x2 double, y2 double")
    got = {r.row_id: r for r in joins.nearest_edge(p, e).collect()}
    assert got[1].region == "east" and got[1].km == pytest.approx(km((-179.95, 10.0), (179.8, 10.0)), rel=1e-3)
    assert got[2].region == "east" and got[3].region == "north"


def test_thinning_across_180_degrees(spark):
    d = spark.createDataFrame([(1, 179.9999, 0.0), (2, -179.9999, 0.0), (3, 0.0, 89.9999), (4, 180.0, 89.9999), (5, 50.0, 0.0)], "row_id bigint, lon double, lat double")
    assert spatial.thin(d, 1.0).count() == 3


def test_cells_near_the_poles_stay_few(spark):
    d = spark.range(0, 90).select(F.lit(20.0).alias("lon"), (F.col("id") + 0.5).alias("lat"))
    n = F.size(joins.near_cells(F.col("lon"), F.col("lon"), F.col("lat"), F.col("lat"), 1.0, 1.0 / joins.KM_PER_DEG))
    assert d.agg(F.max(n)).first()[0] <= 16


def test_near_any_is_the_rows_of_the_pairs(spark):
    r = random.Random(6)
    side = lambda n, key: spark.createDataFrame([(i, r.choice([179.99, -179.99, 10.0]) + r.uniform(-0.2, 0.2), r.uniform(-0.3, 0.3)) for i in range(n)] + [(-1, None, 1.0)], f"{key} bigint, lon double, lat double")
    a, b = side(200, "a_id").cache(), side(80, "b_id").cache()
    for km in (3.0, 20.0):
        want = {x.a_id for x in joins.within_km(a, b, km).collect()}
        got = [x.a_id for x in joins.near_any(a, b, km).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        assert {x.a_id for x in joins.min_distance_from(a, b, km).collect()} == {x.a_id for x in a.collect()} - want


def test_crowded_places_make_few_pairs(spark):
    from pyspark.sql import Window

    r = random.Random(3)
    place = lambda: (r.choice([r.uniform(-180, 180), r.choice([-179.5, 0.0, 179.5]) + r.uniform(-0.5, 0.5)]), r.choice([r.uniform(-90, 90), r.uniform(-1, 1), 90 - r.random()]))
    a, b = (spark.createDataFrame([(i, *place()) for i in range(n)], f"{key} bigint, lon double, lat double").cache() for n, key in ((300, "a_id"), (250, "b_id")))
    d = a.crossJoin(b.toDF("b_id", "x", "y")).withColumn("km", geo.haversine_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))).where("km <= 300").cache()
    assert sorted(joins.near_any(a, b, 300.0).collect()) == sorted(d.select("a_id").distinct().collect())
    want = d.withColumn("n", F.row_number().over(Window.partitionBy("a_id").orderBy("km", "b_id"))).where("n <= 2").select("a_id", "b_id", "km")
    assert sorted(joins.matched_controls(a, b, 300.0, 2, first=1 / 8).select("a_id", "b_id", "km").collect()) == sorted(want.collect())
    # points in a cell's middle are sure of each other without a distance
    assert spark.range(1).select(joins.sure_cell(F.lit(80.1), F.lit(30.1), 60.0).alias("s")).first().s is not None
