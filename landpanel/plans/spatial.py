"""Queries of coordinates, distance joins, grids and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import diag, joins, model, raster, sampling, spatial
from ..sources.io import table
from .base import HAVERSINE, ORDER_POINTS, POINTS, SEEDED, WHOLE_GRID, lonlat, order_points, points, query, rounded, whole_grid

N, C, RHO0 = geo.albers_constants()
ALBERS = f"""alb0 AS (SELECT *, sin(radians(lat)) AS s FROM points),
alb1 AS (SELECT *, {1 - geo.E2!r}::DOUBLE * (s / (1 - {geo.E2!r}::DOUBLE * s * s) - ln((1 - {geo.E1!r}::DOUBLE * s) / (1 + {geo.E1!r}::DOUBLE * s)) / (2 * {geo.E1!r}::DOUBLE)) AS q FROM alb0),
alb2 AS (SELECT *, {geo.A!r}::DOUBLE * sqrt({C!r}::DOUBLE - {N!r}::DOUBLE * q) / {N!r}::DOUBLE AS rho, {N!r}::DOUBLE * radians(lon - 104) AS theta FROM alb1),
alb AS (SELECT *, rho * sin(theta) AS x, {RHO0!r}::DOUBLE - rho * cos(theta) AS y FROM alb2),
blocks AS (SELECT *, floor(x / 25000)::BIGINT * 100000 + floor(y / 25000)::BIGINT AS block FROM alb)"""


def block():
    return geo.point_block(F.col("lon"), F.col("lat"))


@query(f"WITH {POINTS}, {ALBERS} SELECT row_id, round(x, 3) AS x, round(y, 3) AS y, block FROM blocks")
def g1_albers_block(spark, sf_dir):
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    return rounded(points(spark, sf_dir).select("row_id", x.alias("x"), y.alias("y"), block().alias("block")), "x", "y", digits=3)


@query(f"WITH {POINTS}, {ALBERS}, k AS (SELECT DISTINCT block FROM blocks WHERE block % 4 = 0) SELECT count(*) FILTER (block NOT IN (SELECT block FROM k)) AS n_train, count(*) FILTER (block IN (SELECT block FROM k)) AS n_held FROM blocks")
def g3_holdout_split(spark, sf_dir):
    p = points(spark, sf_dir).drop("v")
    keys = p.select(block().alias("block_key")).where("block_key % 4 = 0").distinct()
    train, held = model.holdout_split(p, keys, block())
    return train.agg(F.count("*").alias("n_train")).join(F.broadcast(held.agg(F.count("*").alias("n_held"))))


@query(f"WITH {POINTS}, t AS (SELECT floor((lon - 73) / 2)::BIGINT AS tx, floor((lat - 18) / 2)::BIGINT AS ty FROM points) SELECT tx * 1000 + ty AS tile, floor(tx / 3)::BIGINT * 1000 + floor(ty / 3)::BIGINT AS region, count(*) AS n FROM t GROUP BY ALL")
def g4_tiles(spark, sf_dir):
    return points(spark, sf_dir).groupBy(geo.tile_id(F.col("lon"), F.col("lat")).alias("tile"), geo.region_id(F.col("lon"), F.col("lat")).alias("region")).agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT row_id, round({HAVERSINE.format('lon', 'lat', '104.0::DOUBLE', '36.0::DOUBLE')}, 6) AS km FROM points")
def g5_haversine(spark, sf_dir):
    return rounded(points(spark, sf_dir).select("row_id", geo.haversine_km(F.col("lon"), F.col("lat"), F.lit(104.0), F.lit(36.0)).alias("km")), "km")


@query(f"WITH {POINTS}, c AS (SELECT row_id, row_number() OVER (PARTITION BY floor(lon / 2)::BIGINT, floor(lat / 2)::BIGINT ORDER BY {SEEDED.format('row_id', 0)}, row_id) AS r FROM points) SELECT row_id FROM c WHERE r = 1")
def g6_cell_dedup(spark, sf_dir):
    return spatial.cell_dedup(points(spark, sf_dir).select("row_id", "lon", "lat"), 2.0).select("row_id")


@query()
def g7_thin(spark, sf_dir):
    return spatial.thin(points(spark, sf_dir).select("row_id", "lon", "lat"), 150.0).select("row_id")


@query(f"WITH {WHOLE_GRID} SELECT row // 3 AS row, col // 3 AS col, code FROM grid WHERE row % 3 = 1 AND col % 3 = 1")
def g8_downsample_nearest(spark, sf_dir):
    return spatial.downsample_nearest(whole_grid(spark, sf_dir), 3)


@query(f"WITH {POINTS} SELECT row_id, floor((90 - lat) / 0.25::DOUBLE)::BIGINT AS row, floor((lon + 180) / 0.25::DOUBLE)::BIGINT AS col FROM points")
def g9_cell_index(spark, sf_dir):
    r, c = geo.cell_index(F.col("lon"), F.col("lat"), 0.25)
    return points(spark, sf_dir).select("row_id", r.alias("row"), c.alias("col"))


FOCAL = "SELECT a.row, a.col, a.code, count(*) AS n, count(*) FILTER (a.code = b.code) AS same FROM grid a JOIN grid b ON b.row BETWEEN a.row - {0} AND a.row + {0} AND b.col BETWEEN a.col - {0} AND a.col + {0} GROUP BY ALL"


@query(f"WITH {WHOLE_GRID}, f AS ({FOCAL.format(1)}) SELECT *, round(same / n, 6) AS share FROM f")
def a27_focal(spark, sf_dir):
    return rounded(spatial.focal(whole_grid(spark, sf_dir), 1), "share")


PIXEL = "pow(6371.0088::DOUBLE * radians(0.25::DOUBLE), 2) * cos(radians(50 - row * 0.25::DOUBLE))"


@query(f"WITH {WHOLE_GRID} SELECT code, count(*) AS pixels, round(sum({PIXEL}), 4) AS km2 FROM grid GROUP BY code")
def a28_area_by_class(spark, sf_dir):
    return rounded(spatial.area_by_class(whole_grid(spark, sf_dir), 0.25, 50 - F.col("row") * F.lit(0.25)), "km2", digits=4)


@query(f"WITH {WHOLE_GRID} SELECT round(avg((code = 1)::INTEGER), 6) AS pixel_share, round(sum(CASE WHEN code = 1 THEN {PIXEL} ELSE 0 END) / sum({PIXEL}), 6) AS km2_share FROM grid")
def a29_coverage_dual(spark, sf_dir):
    return rounded(spatial.coverage_dual(whole_grid(spark, sf_dir), F.col("code") == 1, 0.25, 50 - F.col("row") * F.lit(0.25)), "pixel_share", "km2_share")


@query(f"WITH {WHOLE_GRID}, p AS (SELECT (a.col % 10 = 9) AS e, (a.code <> b.code)::INTEGER AS d FROM grid a JOIN grid b ON b.row = a.row AND b.col = a.col + 1 UNION ALL SELECT (a.row % 10 = 9), (a.code <> b.code)::INTEGER FROM grid a JOIN grid b ON b.col = a.col AND b.row = a.row + 1) SELECT round(avg(d) FILTER (e), 6) AS edge, round(avg(d) FILTER (NOT e), 6) AS inside, round(avg(d) FILTER (e) / avg(d) FILTER (NOT e), 6) AS ratio FROM p")
def a42_seam_ratio(spark, sf_dir):
    return rounded(spatial.seam_ratio(whole_grid(spark, sf_dir), 10), "edge", "inside", "ratio")


PATCHES = "orders0 AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), grid AS (SELECT k % 90 AS row, k // 90 AS col, (CASE WHEN (k * 2654435761) % 97 = 0 THEN 9 ELSE ((k % 90) // 15 + (k // 90) // 15) % 4 END)::INTEGER AS code FROM orders0)"


def patches(spark, sf_dir):
    """A cell for each order in patches of 15 x 15 cells of one code, with a stray cell here and there."""
    k = F.col("l_orderkey")
    code = F.when(k * 2654435761 % 97 == 0, 9).otherwise((F.floor(k % 90 / 15) + F.floor(F.floor(k / 90) / 15)) % 4)
    return table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().select((k % 90).alias("row"), F.floor(k / 90).cast("bigint").alias("col"), code.cast("int").alias("code"))


@query(f"WITH {PATCHES}, a AS ({FOCAL.format(1)}), b AS ({FOCAL.format(4)}) SELECT a.row, a.col, a.code FROM a JOIN b USING (row, col) WHERE a.same = a.n AND b.same / b.n >= 0.7::DOUBLE")
def a27_purity(spark, sf_dir):
    """The operator's own windows and shares: 3 x 3 all of one code, 9 x 9 at least 0.7 of it."""
    return spatial.purity(patches(spark, sf_dir))


@query(f"""WITH {PATCHES}, o AS (SELECT y.i AS y, x.i AS x, greatest(abs(y.i), abs(x.i)) AS far FROM range(-9, 10) y(i), range(-9, 10) x(i)),
d AS (SELECT a.row, a.col, a.code, min(o.far) FILTER (b.code IS NULL OR b.code <> a.code) AS far FROM grid a CROSS JOIN o LEFT JOIN grid b ON b.row = a.row + o.y AND b.col = a.col + o.x GROUP BY ALL)
SELECT row, col, code, far - 1 AS depth FROM d""")
def a27_core_depth(spark, sf_dir):
    """How many erosions each cell survives; rounds of four, so patches of 15 cells need two."""
    return raster.core_depth(patches(spark, sf_dir), halo=4)


@query(f"""WITH {PATCHES}, o AS (SELECT y.i * k.i AS y, x.i * k.i AS x, y.i * 3 + x.i AS way FROM range(-1, 2) y(i), range(-1, 2) x(i), range(1, 4) k(i) WHERE y.i <> 0 OR x.i <> 0)
SELECT a.row, a.col, a.code, count(DISTINCT o.way) FILTER (b.code = 9) AS seen FROM grid a CROSS JOIN o LEFT JOIN grid b ON b.row = a.row + o.y AND b.col = a.col + o.x GROUP BY a.row, a.col, a.code""")
def a27_directions(spark, sf_dir):
    """In how many of eight directions a stray cell lies within three steps."""
    return raster.directions(patches(spark, sf_dir), 9, 3)


@query(f"""WITH {PATCHES}, m AS (SELECT *, radians(60 - row * 0.25::DOUBLE) AS phi FROM grid), o AS (SELECT y.i AS y, x.i AS x FROM range(-2, 3) y(i), range(-5, 6) x(i))
SELECT a.row, a.col, a.code, count(b.code) AS n, count(*) FILTER (b.code = 1) AS hits, round(count(*) FILTER (b.code = 1) / count(b.code), 6) AS share
FROM m a CROSS JOIN o JOIN grid b ON b.row = a.row + o.y AND b.col = a.col + o.x
WHERE pow(o.y * 27798.73166113975::DOUBLE, 2) + pow(o.x * (27798.73166113975::DOUBLE * cos(a.phi)), 2) <= pow(65000, 2) GROUP BY a.row, a.col, a.code""")
def a27_share_within(spark, sf_dir):
    """Share of a code within 65 km, on rows from 60 to 38 degrees north, where the window has two rows and up to four columns to a side."""
    return rounded(raster.share_within(patches(spark, sf_dir), 1, 65_000.0, 0.25, 60.0), "share")


CUST = f"cust AS (SELECT c_custkey AS b_id, {lonlat('(c_custkey + 7)')} FROM customer)"


def customers(spark, sf_dir):
    from .base import lat, lon

    k = F.col("c_custkey") + 7
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("b_id"), lon(k).alias("lon"), lat(k).alias("lat"))


DIST = HAVERSINE.format("p.lon", "p.lat", "c.lon", "c.lat")


@query(f"WITH {POINTS}, {CUST} SELECT row_id FROM points p WHERE NOT EXISTS (SELECT 1 FROM cust c WHERE {DIST} <= 60)")
def j11_min_distance_from(spark, sf_dir):
    return joins.min_distance_from(points(spark, sf_dir).select(F.col("row_id").alias("a_id"), "lon", "lat"), customers(spark, sf_dir), 60.0).select(F.col("a_id").alias("row_id"))


@query(f"WITH {POINTS}, {CUST}, d AS (SELECT row_id AS a_id, b_id, {DIST} AS km FROM points p CROSS JOIN cust c), r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY km, b_id) AS r FROM d) SELECT a_id, b_id, round(km, 6) AS km FROM r WHERE r = 1")
def j12_nearest(spark, sf_dir):
    return rounded(joins.nearest(points(spark, sf_dir).select(F.col("row_id").alias("a_id"), "lon", "lat"), customers(spark, sf_dir)), "km")


@query(f"WITH {POINTS}, {CUST}, d AS (SELECT row_id AS a_id, b_id, {DIST} AS km FROM points p CROSS JOIN cust c), r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY km, b_id) AS r FROM d WHERE km <= 80) SELECT a_id, b_id, round(km, 6) AS km FROM r WHERE r <= 2")
def j14_matched_controls(spark, sf_dir):
    return rounded(joins.matched_controls(points(spark, sf_dir).select(F.col("row_id").alias("a_id"), "lon", "lat"), customers(spark, sf_dir), 80.0, 2), "km")


@query(f"WITH {POINTS}, {CUST}, m AS (SELECT row_id, min({DIST}) AS km FROM points p CROSS JOIN cust c GROUP BY row_id) SELECT count(*) AS n, round(quantile_cont(km, 0.5), 6) AS median_km, round(avg((km < 10)::INTEGER), 6) AS under_10, round(avg((km < 50)::INTEGER), 6) AS under_50 FROM m")
def a18_distance_profile(spark, sf_dir):
    return rounded(diag.distance_profile(points(spark, sf_dir).select(F.col("row_id").alias("a_id"), "lon", "lat"), customers(spark, sf_dir), (10.0, 50.0)), "median_km", "under_10", "under_50")


@query(f"WITH {POINTS}, t AS (SELECT tx, ty FROM range(0, 31) a(tx), range(0, 18) b(ty)), j AS (SELECT tx, ty, row_id, row_number() OVER (PARTITION BY tx, ty ORDER BY {SEEDED.format('row_id', 0)}, row_id) AS r FROM t JOIN points ON floor((lon - 73.0::DOUBLE - 2) / 2) <= tx AND floor((lon - 73.0::DOUBLE + 2) / 2) >= tx AND floor((lat - 18.0::DOUBLE - 2) / 2) <= ty AND floor((lat - 18.0::DOUBLE + 2) / 2) >= ty) SELECT tx, ty, row_id FROM j WHERE r <= 20000")
def j10_borrow(spark, sf_dir):
    """All tiles, with the operator's own limit."""
    tiles = spark.range(0, 31).select(F.col("id").alias("tx"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(17).cast("bigint"))).alias("ty"))
    return joins.borrow(tiles, points(spark, sf_dir).select("row_id", "lon", "lat"))


def regions(spark, sf_dir):
    """Every nation a box, every third with its north-east corner cut off."""
    k = F.col("n_nationkey")
    x, y = F.lit(73.0) + (k % 5) * 12.0, F.lit(18.0) + F.floor(k / 5) * 7.0
    at = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    ring = F.when(k % 3 == 0, F.array(at(0.0, 0.0), at(11.0, 0.0), at(11.0, 3.0), at(6.0, 6.5), at(0.0, 6.5))).otherwise(F.array(at(0.0, 0.0), at(11.0, 0.0), at(11.0, 6.5), at(0.0, 6.5)))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("region"), ring.alias("ring"))


FOOT = HAVERSINE.format("lon", "lat", "(x1 + t * (x2 - x1))", "(y1 + t * (y2 - y1))")


@query(f"""WITH {POINTS}, b AS (SELECT n_name AS region, n_nationkey % 3 = 0 AS c, 73.0::DOUBLE + (n_nationkey % 5) * 12.0::DOUBLE AS x, 18.0::DOUBLE + floor(n_nationkey / 5) * 7.0::DOUBLE AS y FROM nation),
i AS (SELECT row_id, min(region) AS region FROM points JOIN b ON lon >= x AND lon < x + 11 AND lat >= y AND lat < y + 6.5 AND (NOT c OR lat < y + 3 OR lon < x + 11 - (lat - y - 3) / 3.5::DOUBLE * 5) GROUP BY row_id),
e AS (SELECT region, x AS x1, y AS y1, x + 11 AS x2, y AS y2 FROM b UNION ALL SELECT region, x, y + 6.5, x, y FROM b
  UNION ALL SELECT region, x + 11, y, x + 11, y + (CASE WHEN c THEN 3.0 ELSE 6.5 END)::DOUBLE FROM b UNION ALL SELECT region, x + (CASE WHEN c THEN 6.0 ELSE 11.0 END)::DOUBLE, y + 6.5, x, y + 6.5 FROM b
  UNION ALL SELECT region, x + 11, y + 3, x + 6, y + 6.5 FROM b WHERE c),
o AS (SELECT row_id, lon, lat, cos(radians(lat)) AS k FROM points WHERE row_id NOT IN (SELECT row_id FROM i)),
d AS (SELECT o.*, e.*, greatest(0, least(1, ((lon - x1) * k * ((x2 - x1) * k) + (lat - y1) * (y2 - y1)) / (((x2 - x1) * k) * ((x2 - x1) * k) + (y2 - y1) * (y2 - y1)))) AS t FROM o CROSS JOIN e),
m AS (SELECT row_id, region, round({FOOT}, 6) AS km FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY km, region) AS r FROM m)
SELECT row_id, coalesce(i.region, n.region) AS region, i.region IS NOT NULL AS inside, CASE WHEN i.region IS NULL THEN n.km END AS edge_km
FROM points LEFT JOIN i USING (row_id) LEFT JOIN (SELECT row_id, region, km FROM n WHERE r = 1) n USING (row_id)""")
def j13_attribute_region(spark, sf_dir):
    return joins.attribute_region(points(spark, sf_dir), joins.edges_of(regions(spark, sf_dir)))


@query(f"WITH {ORDER_POINTS}, g AS (SELECT cust % 40 AS grp, row_id, row_number() OVER (PARTITION BY cust % 40 ORDER BY {SEEDED.format('row_id', 3)}, row_id) AS r FROM order_points) SELECT grp, row_id FROM g WHERE r <= 15")
def w6_cap_per_group(spark, sf_dir):
    d = order_points(spark, sf_dir).select((F.col("cust") % 40).alias("grp"), "row_id")
    return sampling.cap_per_group(d, ["grp"], 15, seed=3)


QUOTA = f"""{ORDER_POINTS}, g AS (SELECT o_orderstatus AS grp, count(*) AS n, least(count(*) // 3, 200) AS cap FROM order_points GROUP BY 1),
q0 AS (SELECT *, 500::DOUBLE * n::DOUBLE / sum(n) OVER ()::DOUBLE AS x FROM g), q1 AS (SELECT *, floor(x)::BIGINT AS f, 500 - sum(floor(x)::BIGINT) OVER () AS l FROM q0),
q2 AS (SELECT *, row_number() OVER (ORDER BY round(x - f, 9) DESC, grp) AS r FROM q1), q3 AS (SELECT *, least(f + (r <= l)::BIGINT, cap) AS q FROM q2),
q4 AS (SELECT *, 500 - sum(q) OVER () AS rest, coalesce(sum(cap - q) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q3),
quota AS (SELECT grp, n, cap, (q + greatest(0, least(cap - q, rest - before)))::BIGINT AS quota FROM q4)"""


@query(f"WITH {QUOTA} SELECT grp, n, cap, quota FROM quota")
def w10_allocate_quota(spark, sf_dir):
    g = order_points(spark, sf_dir).groupBy(F.col("o_orderstatus").alias("grp")).agg(F.count("*").alias("n")).withColumn("cap", F.least(F.floor(F.col("n") / 3), F.lit(200)))
    return sampling.allocate_quota(g, 500, "n", "cap").select("grp", "n", "cap", "quota")


@query(f"WITH {QUOTA}, r AS (SELECT o_orderstatus AS grp, row_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {SEEDED.format('row_id', 0)}, row_id) AS r FROM order_points) SELECT grp, row_id FROM r JOIN quota USING (grp) WHERE r <= quota")
def q2_quota_sample(spark, sf_dir):
    return sampling.quota_sample(order_points(spark, sf_dir).select(F.col("o_orderstatus").alias("grp"), "row_id"), w10_allocate_quota(spark, sf_dir), "grp")


@query(f"WITH {POINTS}, c AS (SELECT class_new, count(*) AS n FROM points GROUP BY 1), x AS (SELECT *, 100::DOUBLE * sqrt(n) / sum(sqrt(n)) OVER () AS x FROM c), f AS (SELECT *, floor(x)::BIGINT AS f, 100 - sum(floor(x)::BIGINT) OVER () AS l, FROM x), r AS (SELECT *, row_number() OVER (ORDER BY round(x - f, 9) DESC, class_new) AS r FROM f) SELECT class_new, n, (f + (r <= l)::BIGINT)::BIGINT AS quota FROM r")
def q8_sqrt_allocation(spark, sf_dir):
    return sampling.sqrt_allocation(points(spark, sf_dir).groupBy("class_new").agg(F.count("*").alias("n")), 100)


@query(f"WITH {POINTS}, s AS (SELECT class_new, row_id, row_id % 3 = 0 AS side FROM points), q AS (SELECT class_new, least(count(*) FILTER (side), count(*) FILTER (NOT side)) AS q FROM s GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY class_new, side ORDER BY {SEEDED.format('row_id', 0)}, row_id) AS r FROM s JOIN q USING (class_new)) SELECT class_new, row_id FROM r WHERE r <= q")
def q9_balance(spark, sf_dir):
    return sampling.balance(points(spark, sf_dir).select("class_new", "row_id"), F.col("row_id") % 3 == 0, "class_new")


@query(f"WITH {POINTS}, pos AS (SELECT * FROM points WHERE class_new = 3), h AS (SELECT DISTINCT p.row_id FROM points p JOIN pos c ON {DIST} <= 150 WHERE p.class_new <> 3), d AS (SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM h) THEN 'hard' ELSE 'background' END AS kind FROM points WHERE class_new <> 3) SELECT row_id, kind FROM d ORDER BY kind = 'background', {SEEDED.format('row_id', 0)}, row_id LIMIT (SELECT count(*) FROM pos)")
def q3_hard_negatives(spark, sf_dir):
    p = points(spark, sf_dir).select("row_id", "lon", "lat", "class_new")
    return sampling.hard_negatives(p.where("class_new = 3"), p.where("class_new <> 3"), 150.0)


@query(f"WITH {POINTS}, h AS (SELECT province AS region, class_new, count(*) FILTER (row_id % 2 = 0) AS n, count(*) AS available FROM points WHERE province IS NOT NULL GROUP BY ALL), r AS (SELECT DISTINCT province AS region FROM points WHERE province IS NOT NULL), c AS (SELECT class_new::INTEGER AS class_new, class_new = 11 AS mandated FROM range(0, 12) t(class_new)), g AS (SELECT region, class_new, mandated, coalesce(n, 0) AS n, coalesce(available, 0) AS available FROM r CROSS JOIN c LEFT JOIN h USING (region, class_new)) SELECT region, class_new, n, available, CASE WHEN n >= 4 THEN 'KEEP' WHEN available >= 4 THEN 'SUPPLEMENT' WHEN n > 0 THEN 'PROB' ELSE 'MERGE' END AS status, CASE WHEN n >= 4 THEN 'none' WHEN available >= 4 THEN 'short sampling' WHEN mandated THEN 'mandate' ELSE 'data gap' END AS cause FROM g")
def q4_quota_audit(spark, sf_dir):
    p = points(spark, sf_dir).where("province IS NOT NULL").select(F.col("province").alias("region"), "class_new", (F.col("row_id") % 2 == 0).alias("sampled"))
    c = spark.range(0, 12).select(F.col("id").cast("int").alias("class_new"), (F.col("id") == 11).alias("mandated"))
    return sampling.quota_audit(p, p.select("region"), c, 4)


@query(f"WITH {POINTS}, {ALBERS} SELECT row_id, ((((block % 2147483647) + 2147483647) % 2147483647 * 2654435761 % 2147483647) // 128 % 5)::INTEGER AS fold FROM blocks")
def m5_block_folds(spark, sf_dir):
    return sampling.block_folds(points(spark, sf_dir), block(), 5).select("row_id", "fold")


@query(f"WITH {POINTS}, {ALBERS}, b AS (SELECT block, count(*) AS n FROM blocks GROUP BY block), r AS (SELECT n, row_number() OVER (ORDER BY n) AS r FROM b) SELECT (SELECT count(*) FROM (SELECT DISTINCT floor(lon), floor(lat) FROM points)) AS cells_1deg, (SELECT max(k) FROM (SELECT count(*) AS k FROM points GROUP BY floor(lon / 0.25::DOUBLE), floor(lat / 0.25::DOUBLE))) AS max_per_quarter, (SELECT round(2.0::DOUBLE * sum(r * n) / (count(*) * sum(n)) - (count(*) + 1.0::DOUBLE) / count(*), 6) FROM r) AS gini")
def a16_coverage_stats(spark, sf_dir):
    return rounded(diag.coverage_stats(points(spark, sf_dir), block()), "gini")


@query(f"WITH {POINTS}, t AS (SELECT a * 1000 + b AS tile FROM range(0, 31) x(a), range(0, 18) y(b)), h AS (SELECT floor((lon - 73) / 2)::BIGINT * 1000 + floor((lat - 18) / 2)::BIGINT AS tile, count(*) FILTER (class_new < 5) AS p, count(*) FILTER (class_new >= 5) AS q FROM points GROUP BY 1) SELECT count(*) AS tiles, round(avg((p IS NOT NULL)::INTEGER), 6) AS any_share, round(avg(coalesce(p > 0 AND q > 0, false)::INTEGER), 6) AS both_share FROM t LEFT JOIN h USING (tile)")
def a48_unit_coverage(spark, sf_dir):
    tiles = spark.range(0, 31).select(F.explode(F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 17)).alias("tile"))
    p = points(spark, sf_dir).withColumn("tile", geo.tile_id(F.col("lon"), F.col("lat")))
    return rounded(diag.unit_coverage(tiles, p, F.col("class_new") < 5), "any_share", "both_share")
