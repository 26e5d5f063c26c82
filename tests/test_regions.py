import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landpanel.operators import joins

RINGS = "region string, ring array<struct<x:double,y:double>>"


def star(cx, cy, r, n, seed):
    rng = np.random.default_rng(seed)
    return [(float(cx + r * rng.uniform(0.4, 1) * math.cos(a)), float(cy + r * rng.uniform(0.4, 1) * math.sin(a) * 0.6)) for a in np.linspace(0, 2 * math.pi, n, endpoint=False)]


def held(rings, lon, lat):
    """Even-odd rule over all rings of a region, for the point and the point once round the globe."""
    for turn in (-360, 0, 360):
        odd = False
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                if (y1 > lat) != (y2 > lat) and lon + turn < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                    odd = not odd
        if odd:
            return True
    return False


@pytest.mark.parametrize("most", [1, 8, 32])
def test_regions_with_holes_and_over_180_degrees_equal_brute_force(spark, most):
    rings = {
        "a": [star(0, 10, 40, 300, 1), star(0, 10, 6, 40, 2), star(2, 9, 1, 7, 3)],  # a hole, and land in the hole
        "b": [star(178, -20, 25, 120, 4), star(182, -20, 5, 12, 5)],  # over 180, the hole as well
        "c": [[(170.0, 50.0), (190.0, 50.0), (190.0, 60.0), (170.0, 60.0)], [(-60.0, 50.0), (-50.0, 50.0), (-50.0, 60.0)]],
        "d": [[(30.0, -60.0), (36.0, -60.0), (36.0, -54.0), (30.0, -54.0)]],  # along the lines of cells
    }
    rng = np.random.default_rng(9)
    xy = [(float(x), float(y)) for x, y in zip(rng.uniform(-180, 180, 3000), rng.uniform(-85, 85, 3000), strict=True)]
    xy += [(float(cx + dx), float(cy + dy)) for cx, cy in ((0, 10), (179, -20), (-178, -21)) for dx, dy in rng.normal(0, 4, (300, 2))]
    xy += [(-175.0, 55.0), (185.0, 55.0), (-179.999, 55.0), (180.0, 55.0), (31.5, -57.0), (33.0, -58.5), (29.9, -57.0)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(xy)], "row_id bigint, lon double, lat double")
    e = joins.edges_of(spark.createDataFrame([(r, ring) for r, all_ in rings.items() for ring in all_], RINGS))
    got = {}
    for r in joins.inside_regions(points, e, most).collect():
        got.setdefault(r.row_id, set()).add(r.region)
    norm = [((x + 180) % 360 - 180, y) for x, y in xy]
    want = {k: s for k, (x, y) in enumerate(norm) if (s := {r for r, all_ in rings.items() if held(all_, x, y)})}
    assert got == want and {r for s in want.values() for r in s} == set(rings)


def test_rings_that_jump_at_180_degrees(spark):
    e = joins.edges_of(spark.createDataFrame([("r", [(170.0, 0.0), (-170.0, 0.0), (-170.0, 10.0), (170.0, 10.0)])], RINGS))
    p = spark.createDataFrame([(1, -175.0, 5.0), (2, 175.0, 5.0), (3, 0.0, 5.0), (4, -165.0, 5.0)], "row_id bigint, lon double, lat double")
    got = {r.row_id: r for r in joins.attribute_region(p, e).collect()}
    assert got[1].inside and got[2].inside and not got[3].inside and not got[4].inside
    assert abs(got[4].edge_km - 5 * joins.KM_PER_DEG * math.cos(math.radians(5))) < 2


def test_only_edges_of_a_points_cell_are_tested(spark):
    e = joins.edges_of(spark.createDataFrame([("r", star(10, 10, 30, 4000, 6))], RINGS))
    cover = joins.polygon_cover(e, 16).cache()
    n = F.size("edges")
    widest, full = cover.agg(F.max(n), F.count_if(n == 0)).first()
    assert widest < 80 and full > 50
    assert cover.where("level = 0").count() < 72


def test_no_points_no_edges(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 3.0), (3, float("nan"), 3.0)], "row_id bigint, lon double, lat double")
    none = joins.edges_of(spark.createDataFrame([], RINGS))
    assert joins.inside_regions(p, none).count() == 0
    assert [r.inside for r in joins.attribute_region(p, none).collect()] == [False] * 3
    assert joins.edges_of(spark.createDataFrame([("r", [])], RINGS)).count() == 0


def test_rows_with_one_position_always_give_the_smallest_id(spark):
    lib = [(5, 1.0, 2.0, "x"), (3, 1.0, 2.0, "y"), (None, 1.0, 2.0, "a"), (9, 4.0, 4.0, "z")]
    pool = spark.createDataFrame([(1, 1.0, 2.0), (2, 4.0, 4.0), (3, 7.0, 7.0)], "pool_id int, lon double, lat double")
    for rows in (lib, lib[::-1], lib[2:] + lib[:2]):
        got = joins.recover_ids(pool, spark.createDataFrame(rows, "row_id int, lon double, lat double, name string").repartition(3)).orderBy("pool_id").collect()
        assert [(r.row_id, r.name, r.matched) for r in got] == [(3, "y", True), (9, "z", True), (None, None, False)]
        dim = spark.createDataFrame(rows, "row_id int, lon double, lat double, name string").repartition(2).select("lon", "name", "row_id")
        look = {r.lon: (r.name, r.row_id) for r in joins.lookup(pool.select("lon"), dim, ["lon"], ["name"]).collect()}
        assert look == {1.0: ("a", None), 4.0: ("z", 9), 7.0: (None, None)}
