"""Queries of classifiers and held-out evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import evaluate as E
from ..operators import joins
from ..operators import model as M
from ..operators.forest import local_forests
from ..operators.linear import separability
from .base import NORM, POINTS, SEEDED, points, query, rounded


def split(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.where("row_id % 2 = 0"), p.where("row_id % 2 = 1")


def centres(by: str, where: str) -> str:
    """CTEs m: unit mean vectors of a class, by optional columns."""
    b = f"{by}, " if by else ""
    return f"""m0 AS (SELECT {b}class_new, i, avg(x) AS x FROM (SELECT {b}class_new, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM points WHERE {where}) GROUP BY ALL),
m1 AS (SELECT {b}class_new, list(x ORDER BY i) AS m FROM m0 GROUP BY ALL), m AS (SELECT {b}class_new AS c, list_transform(m, lambda x: x / ({NORM.format('m')} + 1e-12)) AS m FROM m1)"""


UNIT = f"list_transform(p.v, lambda x: x / ({NORM.format('p.v')} + 1e-12))"


@query(f"WITH {POINTS}, {centres('', 'row_id % 2 = 0')}, s AS (SELECT row_id, class_new, c, round(list_dot_product({UNIT}, m), 9) AS s FROM points p CROSS JOIN m WHERE row_id % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, c) AS r FROM s) SELECT row_id, class_new, c AS pred FROM r WHERE r = 1")
def g12_nearest_centroid(spark, sf_dir):
    train, test = split(spark, sf_dir)
    return M.nearest_centroid(test, train).select("row_id", "class_new", "pred")


@query(f"WITH {POINTS}, {centres('province', 'row_id % 2 = 0 AND province IS NOT NULL')}, s AS (SELECT row_id, p.province, c, round(list_dot_product({UNIT}, m), 9) AS s FROM points p JOIN m USING (province) WHERE row_id % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, c) AS r FROM s) SELECT row_id, province, c AS pred FROM r WHERE r = 1")
def m3_regional_models(spark, sf_dir):
    train, test = split(spark, sf_dir)
    return M.local_models(test, train.where("province IS NOT NULL"), ["province"]).select("row_id", "province", "pred")


@query(f"""WITH {POINTS}, tile AS (SELECT row_id, class_new, v, floor((lon - 73.0::DOUBLE) / 8)::BIGINT AS tx, floor((lat - 18.0::DOUBLE) / 8)::BIGINT AS ty, lon, lat, row_id % 2 = 0 AS learn FROM points),
used AS (SELECT DISTINCT tx, ty FROM tile WHERE NOT learn),
dealt AS (SELECT u.tx, u.ty, t.row_id, t.class_new, t.v, row_number() OVER (PARTITION BY u.tx, u.ty ORDER BY {SEEDED.format('t.row_id', 0)}, t.row_id) AS k FROM used u JOIN tile t ON t.learn
  AND floor((t.lon - 73.0::DOUBLE - 8) / 8) <= u.tx AND floor((t.lon - 73.0::DOUBLE + 8) / 8) >= u.tx AND floor((t.lat - 18.0::DOUBLE - 8) / 8) <= u.ty AND floor((t.lat - 18.0::DOUBLE + 8) / 8) >= u.ty),
m0 AS (SELECT tx, ty, class_new, i, avg(x) AS x FROM (SELECT tx, ty, class_new, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM dealt WHERE k <= 20000) GROUP BY ALL),
m1 AS (SELECT tx, ty, class_new, list(x ORDER BY i) AS m FROM m0 GROUP BY ALL), m AS (SELECT tx, ty, class_new AS c, list_transform(m, lambda x: x / ({NORM.format('m')} + 1e-12)) AS m FROM m1),
s AS (SELECT p.row_id, p.tx, p.ty, c, round(list_dot_product({UNIT}, m), 9) AS s FROM tile p JOIN m USING (tx, ty) WHERE NOT p.learn), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, c) AS r FROM s)
SELECT row_id, tx, ty, c AS pred FROM r WHERE r = 1""")
def m3_local_models(spark, sf_dir):
    train, test = split(spark, sf_dir)
    tx, ty = geo.tile_xy(F.col("lon"), F.col("lat"), 8.0)
    tiled = test.withColumns({"tx": tx, "ty": ty})
    sample = joins.borrow(tiled.select("tx", "ty"), train.select("row_id", "lon", "lat"), margin=8.0, deg=8.0)
    return M.local_models(tiled, sample.join(train, "row_id"), ["tx", "ty"]).select("row_id", "tx", "ty", "pred")


@query(f"WITH {POINTS}, g AS (SELECT DISTINCT src AS g FROM points), m0 AS (SELECT g, class_new, i, sum(x) AS x FROM (SELECT src, class_new, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM points) JOIN g ON src <> g GROUP BY ALL), m1 AS (SELECT g, class_new, list(x ORDER BY i) AS m FROM m0 GROUP BY ALL), m AS (SELECT g, class_new AS c, list_transform(m, lambda x: x / ({NORM.format('m')} + 1e-12)) AS m FROM m1), s AS (SELECT row_id, src, c, round(list_dot_product({UNIT}, m), 9) AS s FROM points p JOIN m ON g = src), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, c) AS r FROM s) SELECT row_id, src, c AS pred FROM r WHERE r = 1")
def m6_logo(spark, sf_dir):
    return M.logo_eval(points(spark, sf_dir), "src").select("row_id", "src", "pred")


def centre_oa(name: str, v: str) -> str:
    """CTE {name}: accuracy on odd rows of centres of even rows, on the vector `v` of points."""
    unit = UNIT.replace("p.v", "p.w")
    return f"""{name}p AS (SELECT row_id, class_new, {v} AS w FROM points), {name}0 AS (SELECT class_new, i, avg(x) AS x FROM (SELECT class_new, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM {name}p WHERE row_id % 2 = 0) GROUP BY ALL),
{name}1 AS (SELECT class_new, list(x ORDER BY i) AS m FROM {name}0 GROUP BY ALL), {name}m AS (SELECT class_new AS c, list_transform(m, lambda x: x / ({NORM.format('m')} + 1e-12)) AS m FROM {name}1),
{name}s AS (SELECT row_id, class_new, c, round(list_dot_product({unit}, m), 9) AS s FROM {name}p p CROSS JOIN {name}m WHERE row_id % 2 = 1), {name}r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, c) AS r FROM {name}s),
{name} AS (SELECT avg((c = class_new)::INTEGER) AS oa FROM {name}r WHERE r = 1)"""


XY = "[cos(radians(lat)) * cos(radians(lon)), cos(radians(lat)) * sin(radians(lon)), sin(radians(lat))]"


@query(f"WITH {POINTS}, {centre_oa('f', 'v')}, {centre_oa('g', XY)} SELECT round(f.oa, 6) AS features_oa, round(g.oa, 6) AS coords_oa, round(f.oa - g.oa, 6) AS gain FROM f, g")
def m7_baseline_compare(spark, sf_dir):
    train, test = split(spark, sf_dir)
    return rounded(M.baseline_compare(train, test), "features_oa", "coords_oa", "gain")


@query(f"WITH {POINTS}, q0 AS (SELECT class_new = 3 AS k, i, avg(x) AS x FROM (SELECT class_new, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM points WHERE row_id % 2 = 0) GROUP BY ALL), q1 AS (SELECT k, list(x ORDER BY i) AS m FROM q0 GROUP BY k), q AS (SELECT k, list_transform(m, lambda x: x / ({NORM.format('m')} + 1e-12)) AS m FROM q1), s AS (SELECT row_id, 1 / (1 + exp(-4 * (list_dot_product({UNIT}, a.m) - list_dot_product({UNIT}, b.m)))) AS s FROM points p, q a, q b WHERE a.k AND NOT b.k AND row_id % 2 = 1) SELECT row_id, round(s, 6) AS score, CASE WHEN s >= 0.7 THEN 'P1' WHEN s >= 0.6 THEN 'P2' ELSE 'none' END AS band FROM s")
def m8_score_and_band(spark, sf_dir):
    train, test = split(spark, sf_dir)
    return rounded(M.score_and_band(test, train, 3).select("row_id", "score", "band"), "score")


#: Trees of each of the eight yearly forests of m2, where the operator's own number is 150: eight fits stay below a minute.
FEW = 40


def forest_rows(spark, sf_dir):
    train, test = split(spark, sf_dir)
    return train.withColumn("train_weight", F.coalesce("src_conf", F.lit(0.8))), test


@query()
def m1_random_forest(spark, sf_dir):
    train, test = forest_rows(spark, sf_dir)
    return M.rf_eval(train, test).select("row_id", "class_new", "pred")


@query()
def m2_spatial_eval(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"train_weight": F.coalesce("src_conf", F.lit(0.8)), "zone": F.coalesce("province", F.lit("other")), "year": F.explode(F.sequence(F.lit(2017), F.lit(2024)))})
    block = geo.point_block(F.col("lon"), F.col("lat"), 250_000.0)
    keys = p.select(block.alias("block_key")).where("block_key % 3 = 0").distinct()
    p = p.where((F.col("valid_from") <= F.col("year")) & (F.col("year") <= F.col("valid_to")))
    done = M.spatial_eval(p, p, keys, block, range(2017, 2025), trees=FEW, depth=10)
    return rounded(E.metrics(E.confusion(done, ["year", "zone"], truth="class_new"), ["year", "zone"]), "oa", "macro_f1", "bal_acc", "macro_ua")


@query()
def m4_ensemble(spark, sf_dir):
    train, test = forest_rows(spark, sf_dir)
    return M.ensemble(train, test, [1, 2, 3]).select("row_id", "class_new", "pred")


@query()
def m9_separability(spark, sf_dir):
    """All classes, five folds."""
    return rounded(separability(points(spark, sf_dir), fold=F.col("row_id") % 5), "bal_acc")


@query(f"""WITH {POINTS}, u AS (SELECT row_id, class_new AS c, list_transform(v, lambda x: x / ({NORM.format('v')} + 1e-12)) AS u FROM points),
d AS (SELECT a.row_id, a.c, b.c AS other, avg(1 - list_dot_product(a.u, b.u)) AS d, count(*) AS n FROM u a JOIN u b ON a.row_id <> b.row_id GROUP BY ALL),
s AS (SELECT row_id, max(CASE WHEN c = other THEN d END) AS a, min(CASE WHEN c <> other THEN d END) AS b FROM d GROUP BY row_id)
SELECT (SELECT count(*) FROM points) AS n, round(sum(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) / (SELECT count(*) FROM points), 6) AS silhouette FROM s""")
def g11_silhouette(spark, sf_dir):
    return rounded(M.silhouette(points(spark, sf_dir)), "silhouette")


@query()
def m7_forest_baseline(spark, sf_dir):
    train, test = forest_rows(spark, sf_dir)
    return rounded(M.forest_baseline(train, test), "features_oa", "coords_oa", "gain")


@query()
def g11_centroid_distance(spark, sf_dir):
    return rounded(M.centroid_distance(points(spark, sf_dir)), "distance")


@query()
def m3_local_forests(spark, sf_dir):
    """A forest of 100 trees for each tile of 2 degrees, from at most 20,000 rows within 2 degrees around it."""
    train, test = split(spark, sf_dir)
    tx, ty = geo.tile_xy(F.col("lon"), F.col("lat"))
    tiled = test.withColumns({"tx": tx, "ty": ty})
    sample = joins.borrow(tiled.select("tx", "ty"), train.select("row_id", "lon", "lat"))
    return local_forests(tiled, sample.join(train, "row_id"), ["tx", "ty"]).select("row_id", "tx", "ty", "pred")
