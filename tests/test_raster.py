import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from landpanel.functions import geo
from landpanel.operators import raster, spatial


def table(spark, a, row0=0, col0=0):
    rows = [(row0 + y, col0 + x, int(v)) for y, line in enumerate(a) for x, v in enumerate(line) if v >= 0]
    return spark.createDataFrame(rows, "row bigint, col bigint, code int").repartition(3)


@pytest.fixture(scope="module")
def patchy():
    rng = np.random.default_rng(3)
    a = np.kron(rng.integers(0, 3, (8, 9)), np.ones((5, 5), int))
    a[rng.random(a.shape) < 0.03] = -1  # missing
    a[rng.random(a.shape) < 0.03] = 7
    return a


def at(a, y, x):
    return a[y, x] if 0 <= y < a.shape[0] and 0 <= x < a.shape[1] else -1


@pytest.mark.parametrize("side", [7, 64])
def test_windows_and_directions_equal_brute_force(spark, patchy, side):
    a, r0, c0 = patchy, -13, 1000
    got = {(r.row, r.col): r for r in raster.square_windows(table(spark, a, r0, c0), [1, 3], side=side).collect()}
    seen = {(r.row, r.col): r.seen for r in raster.directions(table(spark, a, r0, c0), 7, 4, side).collect()}
    one = {(r.row, r.col): (r.n, r.same) for r in spatial.focal(table(spark, a, r0, c0), 2, code=7).collect()}
    assert len(got) == len(seen) == (a >= 0).sum()
    for (row, col), r in got.items():
        y, x = row - r0, col - c0
        for k, n, same in ((1, r.n_1, r.same_1), (3, r.n_3, r.same_3)):
            w = [at(a, y + i, x + j) for i in range(-k, k + 1) for j in range(-k, k + 1)]
            assert (n, same) == (sum(v >= 0 for v in w), sum(v == a[y, x] for v in w)) and r.code == a[y, x]
        assert seen[row, col] == sum(any(at(a, y + i * k, x + j * k) == 7 for k in range(1, 5)) for i, j in raster.EIGHT)
        w = [at(a, y + i, x + j) for i in range(-2, 3) for j in range(-2, 3)]
        assert one[row, col] == (sum(v >= 0 for v in w), sum(v == 7 for v in w))


@pytest.mark.parametrize("halo", [1, 3, 32])
def test_cores_go_on_across_tiles(spark, halo):
    a = np.zeros((41, 38), int)
    a[:, 30:] = 1
    a[5, 5] = a[38, 12] = -1
    got = {(r.row, r.col): r.depth for r in raster.core_depth(table(spark, a), halo, side=6).collect()}
    for (y, x), depth in got.items():
        k = 0
        while all(at(a, y + i, x + j) == a[y, x] for i in range(-k - 1, k + 2) for j in range(-k - 1, k + 2)):
            k += 1
        assert depth == k
    assert max(got.values()) > 12  # deeper than two tiles


def test_metric_windows_follow_the_latitude(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-1, 3, (40, 60))
    lat0, deg, metres, step = 72.0, 0.01, 3500.0, 111_194.926644559 * 0.01
    got = {(r.row, r.col): (r.n, r.hits) for r in raster.share_within(table(spark, a), 2, metres, deg, lat0, side=16).collect()}
    widths = set()
    for (y, x), (n, hits) in got.items():
        narrow = step * math.cos(math.radians(lat0 - y * deg))
        near = [at(a, y + i, x + j) for i in range(-4, 5) for j in range(-12, 13) if (i * step) ** 2 + (j * narrow) ** 2 <= metres**2]
        widths.add(int(metres // narrow))
        assert (n, hits) == (sum(v >= 0 for v in near), sum(v == 2 for v in near))
    assert min(widths) > 8
    south = {(r.row, r.col): r.n for r in raster.share_within(table(spark, np.ones((9, 9), int), 0, -4), 1, 3000.0, deg, 0.0).collect()}
    assert south[4, 0] == sum(i * i + j * j <= (3000 / step) ** 2 for i in range(-4, 5) for j in range(-4, 5))


def test_a_tile_sees_its_halo_and_cells_are_not_copied_to_all_neighbours(spark):
    g = spark.range(200 * 200).select((F.col("id") % 200).alias("row"), F.floor(F.col("id") / 200).alias("col"), F.lit(1).alias("code"))
    d = raster.square_windows(g, [4], side=64)
    assert d.count() == 40_000 and d.where("n_4 = 81 AND same_4 = 81").count() == 192 * 192
    assert raster.square_windows(g.limit(0), [4]).count() == 0 and raster.core_depth(g.limit(0)).count() == 0


def greedy(rows, km):
    kept = []
    key = lambda r: (((r[0] % 2147483647) * 2654435761) % 2147483647, r[0])
    for r in sorted(rows, key=key):
        if all(distance(r, k) > km for k in kept):
            kept.append(r)
    return {k[0] for k in kept}


def distance(a, b):
    p, q = math.radians(a[2]), math.radians(b[2])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("km", [30.0, 400.0])
def test_thinning_equals_a_greedy_pass_everywhere(spark, km):
    rng = np.random.default_rng(8)
    xy = [(10 + rng.normal(0, 2), 50 + rng.normal(0, 1)) for _ in range(250)]
    xy += [(rng.choice([-1, 1]) * (180 - abs(rng.normal(0, 1))), rng.normal(0, 1)) for _ in range(150)]
    xy += [(rng.uniform(-180, 180), 90 - abs(rng.normal(0, 3))) for _ in range(150)] + [(0.0, 90.0), (77.0, 90.0), (5.0, -90.0)]
    rows = [(i, float(x), float(np.clip(y, -90, 90))) for i, (x, y) in enumerate(xy)]
    got = {r.row_id for r in spatial.thin(spark.createDataFrame(rows, "row_id bigint, lon double, lat double"), km).collect()}
    assert got == greedy(rows, km)


def test_thinning_is_linear_in_a_dense_place_and_keeps_rows_without_position(spark):
    d = spark.range(20_000).select(F.col("id").alias("row_id"), F.lit(7.0).alias("lon"), F.lit(8.0).alias("lat"))
    began = time.time()
    assert spatial.thin(d).count() == 1 and time.time() - began < 60
    odd = spark.createDataFrame([(1, None, 3.0), (2, float("nan"), 3.0), (3, 1.0, 3.0), (4, 1.0, 3.0)], "row_id bigint, lon double, lat double")
    assert sorted(r.row_id for r in spatial.thin(odd).collect())[:2] == [1, 2] and spatial.thin(odd).count() == 3
    assert spatial.thin(odd.limit(0)).count() == 0
