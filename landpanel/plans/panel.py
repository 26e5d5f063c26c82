"""Queries of the point-year panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, vec
from ..operators import clean, joins
from ..operators import panel as P
from .base import NORM, PANEL, POINTS, panel, points, query, rounded

MIN_N = 10

CENTRED = f"""{PANEL}, {POINTS},
checked AS (SELECT *, {NORM.format('v')} AS norm, {NORM.format('v')} > 1e-6 AS emb_valid FROM panel),
mean AS (SELECT class_new, year, i, avg(x) AS x, count(*) AS n FROM (SELECT class_new, year, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM checked WHERE emb_valid) GROUP BY ALL),
centre0 AS (SELECT class_new, year, list(x ORDER BY i) AS m FROM mean WHERE n >= 10 GROUP BY ALL),
centre AS (SELECT class_new, year, list_transform(m, lambda x: x / ({NORM.format('m')} + 1e-12)) AS m FROM centre0),
cosined AS (
  SELECT c.*, CASE WHEN emb_valid THEN list_dot_product(list_transform(c.v, lambda x: x / (c.norm + 1e-12)), m) END AS cos_center
  FROM checked c LEFT JOIN centre USING (class_new, year)),
delta0 AS (
  SELECT *, CASE WHEN lag(year) OVER w = year - 1 THEN list_distance(v, lag(v) OVER w) END AS delta_prev FROM cosined WINDOW w AS (PARTITION BY row_id ORDER BY year)),
delta AS (SELECT *, CASE WHEN lead(year) OVER w = year + 1 THEN lead(delta_prev) OVER w END AS delta_next FROM delta0 WINDOW w AS (PARTITION BY row_id ORDER BY year))"""

QC = CENTRED + """,
win AS (SELECT d.* EXCLUDE (v), p.lon, p.lat, p.tier, p.src, p.src_conf FROM delta d JOIN points p USING (row_id) WHERE year BETWEEN valid_from AND valid_to),
med AS (SELECT class_new, year, quantile_cont(delta_prev, 0.5) AS mp, count(delta_prev) AS np, quantile_cont(delta_next, 0.5) AS mn, count(delta_next) AS nn,
        quantile_cont(cos_center, 0.01) AS q1, quantile_cont(cos_center, 0.05) AS q5, count(cos_center) AS nc FROM win GROUP BY ALL),
mad AS (SELECT class_new, year, quantile_cont(abs(delta_prev - mp), 0.5) AS dp, quantile_cont(abs(delta_next - mn), 0.5) AS dn FROM win JOIN med USING (class_new, year) GROUP BY ALL),
z AS (
  SELECT w.*, CASE WHEN np >= 10 THEN (delta_prev - mp) / (1.4826::DOUBLE * dp + 1e-9) END AS delta_prev_z, CASE WHEN nn >= 10 THEN (delta_next - mn) / (1.4826::DOUBLE * dn + 1e-9) END AS delta_next_z,
         CASE WHEN nc >= 10 THEN q1 END AS p01, CASE WHEN nc >= 10 THEN q5 END AS p05
  FROM win w JOIN med USING (class_new, year) JOIN mad USING (class_new, year)),
qc0 AS (
  SELECT *, CASE WHEN NOT emb_valid THEN 'embedding_invalid' WHEN cos_center < p01 THEN 'class_center_outlier' WHEN cos_center >= p01 AND cos_center < p05 THEN 'class_center_low'
    WHEN (delta_prev_z > 5 AND (delta_next_z IS NULL OR delta_next_z <= 3)) OR (delta_next_z > 5 AND (delta_prev_z IS NULL OR delta_prev_z <= 3)) THEN 'single_year_anomaly'
    WHEN delta_prev_z > 5 AND delta_next_z > 5 THEN 'persistent_change' ELSE '' END AS qc_reason FROM z),
qc1 AS (
  SELECT *, CASE qc_reason WHEN '' THEN 'keep' WHEN 'class_center_low' THEN 'downweight' WHEN 'persistent_change' THEN 'persistent_change' ELSE 'exclude_year' END AS qc_status,
         (CASE qc_reason WHEN '' THEN 1.0 WHEN 'class_center_low' THEN 0.5 WHEN 'persistent_change' THEN 0.3 ELSE 0.0 END)::DOUBLE AS qc_weight FROM qc0),
qc AS (
  SELECT *, (CASE tier WHEN 'gold' THEN 1.0 WHEN 'silver' THEN 0.8 WHEN 'bronze' THEN 0.6 WHEN 'external' THEN 0.7 WHEN 'uncovered' THEN 0.4 ELSE 0.5 END)::DOUBLE
         * qc_weight * (0.7::DOUBLE + 0.3::DOUBLE * coalesce(src_conf, 0.8::DOUBLE)) AS train_weight FROM qc1)"""


def quality(spark, sf_dir):
    return P.quality(panel(spark, sf_dir), points(spark, sf_dir), min_n=MIN_N, min_n_stats=MIN_N)


@query(f"WITH {QC} SELECT class_new, year, count(*) AS n, count(*) FILTER (qc_status = 'keep') AS n_keep, count(*) FILTER (qc_status = 'downweight') AS n_downweight, count(*) FILTER (qc_status = 'exclude_year') AS n_exclude, count(*) FILTER (qc_status = 'persistent_change') AS n_persistent, round(sum(CASE WHEN qc_status <> 'exclude_year' THEN train_weight ELSE 0 END), 6) AS weight FROM qc GROUP BY ALL")
def qc_summary(spark, sf_dir):
    return rounded(P.qc_summary(quality(spark, sf_dir)), "weight")


@query(f"WITH {QC} SELECT row_id, year, class_new, qc_status, qc_reason, round(qc_weight, 6) AS qc_weight, round(train_weight, 6) AS train_weight, emb_valid FROM qc")
def f9_qc_ladder(spark, sf_dir):
    return rounded(quality(spark, sf_dir).select("row_id", "year", "class_new", "qc_status", "qc_reason", "qc_weight", "train_weight", "emb_valid"), "qc_weight", "train_weight")


@query(f"WITH {CENTRED} SELECT row_id, year, emb_valid, round(norm, 6) AS norm FROM checked")
def f1_emb_valid(spark, sf_dir):
    return rounded(P.with_validity(panel(spark, sf_dir)).select("row_id", "year", "emb_valid", "norm"), "norm")


@query(f"WITH {POINTS} SELECT row_id, round({NORM.format('u')}, 6) AS unit_norm FROM (SELECT row_id, list_transform(v, lambda x: x / ({NORM.format('v')} + 1e-12)) AS u FROM points)")
def f2_unit(spark, sf_dir):
    return rounded(points(spark, sf_dir).select("row_id", vec.l2norm(vec.unit("v")).alias("unit_norm")), "unit_norm")


@query(f"WITH {CENTRED} SELECT row_id, year, round(cos_center, 6) AS cos_center FROM cosined")
def a3_cos_to_center(spark, sf_dir):
    return rounded(P.cos_to_center(P.with_validity(panel(spark, sf_dir)), MIN_N).select("row_id", "year", "cos_center"), "cos_center")


@query(f"WITH {PANEL} SELECT b.row_id, b.year, round(list_distance(b.v, a.v), 6) AS delta FROM panel a JOIN panel b ON a.row_id = b.row_id AND b.year = a.year + 1")
def j4_yearly_delta(spark, sf_dir):
    return rounded(P.yearly_delta(panel(spark, sf_dir)), "delta")


@query(f"WITH {CENTRED} SELECT row_id, year, round(delta_prev, 6) AS delta_prev, round(delta_next, 6) AS delta_next FROM delta")
def w1_deltas(spark, sf_dir):
    return rounded(P.with_deltas(panel(spark, sf_dir)).select("row_id", "year", "delta_prev", "delta_next"), "delta_prev", "delta_next")


@query(f"WITH {QC} SELECT row_id, year, CASE WHEN delta_prev_z IS NOT NULL THEN round(greatest(least(delta_prev_z, 100), -100), 4) + 0.0::DOUBLE END AS delta_prev_z, CASE WHEN delta_next_z IS NOT NULL THEN round(greatest(least(delta_next_z, 100), -100), 4) + 0.0::DOUBLE END AS delta_next_z FROM qc")
def a4_robust_z(spark, sf_dir):
    return rounded(quality(spark, sf_dir).select("row_id", "year", *(F.when(F.col(c).isNotNull(), F.greatest(F.least(c, F.lit(100.0)), F.lit(-100.0))).alias(c) for c in ("delta_prev_z", "delta_next_z"))), "delta_prev_z", "delta_next_z", digits=4)


@query(f"WITH {CENTRED} SELECT class_new, year, count(cos_center) AS n, round(quantile_cont(cos_center, 0.01), 6) AS p01, round(quantile_cont(cos_center, 0.05), 6) AS p05 FROM cosined GROUP BY ALL HAVING count(cos_center) >= 10")
def a5_class_percentiles(spark, sf_dir):
    return rounded(P.class_percentiles(P.cos_to_center(P.with_validity(panel(spark, sf_dir)), MIN_N), min_n=MIN_N), "p01", "p05")


@query(f"WITH {POINTS} SELECT row_id, y.year::INTEGER AS year FROM points, range(2017, 2025) y(year) WHERE y.year BETWEEN valid_from AND valid_to")
def j6_expand_years(spark, sf_dir):
    return P.expand_years(points(spark, sf_dir).drop("v")).select("row_id", "year")


@query(f"WITH {PANEL}, {POINTS} SELECT year, count(*) AS n FROM panel JOIN points USING (row_id) WHERE year BETWEEN valid_from AND valid_to GROUP BY year")
def f4_in_window(spark, sf_dir):
    d = panel(spark, sf_dir).drop("v").join(points(spark, sf_dir).select("row_id", "valid_from", "valid_to"), "row_id")
    return d.where(P.in_window(F.col("year"))).groupBy("year").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT row_id, round(0.7::DOUBLE * w * (0.7::DOUBLE + 0.3::DOUBLE * coalesce(src_conf, 0.8::DOUBLE)), 6) AS rare_weight, round(CASE WHEN src = 's1' AND valid_from <> 2018 THEN w * 0.5::DOUBLE ELSE w END, 6) AS off_weight, CASE WHEN w < 3 THEN round(w, 6) ELSE 1.0::DOUBLE END AS clean_weight FROM (SELECT *, (row_id % 5)::DOUBLE AS w FROM points)")
def f8_weights(spark, sf_dir):
    d = points(spark, sf_dir).withColumn("w", (F.col("row_id") % 5).cast("double"))
    odd = F.when(F.col("w") < 3, F.col("w")).otherwise(F.when(F.col("row_id") % 2 == 0, float("nan")).otherwise(float("inf")))
    d = d.select("row_id", scalar.rare_weight(F.col("w"), F.col("src_conf")).alias("rare_weight"), scalar.downweight_offyear(F.col("w"), F.col("src") == "s1", F.col("valid_from"), 2018).alias("off_weight"), scalar.clean_weight(odd).alias("clean_weight"))
    return rounded(d, "rare_weight", "off_weight", "clean_weight")


@query(f"WITH {QC} SELECT year, count(*) AS n, round(sum(train_weight), 6) AS weight, count(*) FILTER (len(v) = 64) AS n_vec FROM qc JOIN panel USING (row_id, year) WHERE qc_status <> 'exclude_year' GROUP BY year")
def s7_yearly_sets(spark, sf_dir):
    p = panel(spark, sf_dir)
    d = P.yearly_set(p, quality(spark, sf_dir)).groupBy("year").agg(F.count("*").alias("n"), F.sum("train_weight").alias("weight"), F.count_if(F.size("v") == 64).alias("n_vec"))
    return rounded(d, "weight")


RARE = "rare AS (SELECT p.*, q.year FROM panel q JOIN points p USING (row_id) WHERE row_id % 13 = 0)"


@query(f"WITH {QC}, {RARE}, b AS (SELECT year, count(*) AS n_base FROM qc WHERE qc_status <> 'exclude_year' GROUP BY year), r AS (SELECT year, count(*) AS n_added FROM rare WHERE year BETWEEN valid_from AND valid_to GROUP BY year) SELECT year, n_base, coalesce(n_added, 0) AS n_added, n_base + coalesce(n_added, 0) AS n_total FROM b LEFT JOIN r USING (year)")
def u7_rare_topup(spark, sf_dir):
    base = P.yearly_set(panel(spark, sf_dir), quality(spark, sf_dir))
    rare = panel(spark, sf_dir).where("row_id % 13 = 0").drop("class_new").join(points(spark, sf_dir).drop("v"), "row_id").withColumn("weight", F.lit(1.0))
    return P.topup_counts(base, rare)


@query(f"WITH {QC}, k AS (SELECT row_id, count(*) FILTER (qc_status <> 'exclude_year') AS k FROM qc GROUP BY row_id) SELECT k, count(*) AS n FROM k GROUP BY k")
def a45_usable_years(spark, sf_dir):
    return P.usable_years(quality(spark, sf_dir))


@query(f"WITH {QC}, k AS (SELECT src, row_id, bool_or(qc_status <> 'exclude_year') AS u FROM qc GROUP BY ALL) SELECT src, count(*) AS n, count(*) FILTER (u) AS n_usable FROM k GROUP BY src")
def a19_usable_by_source(spark, sf_dir):
    return P.usable_by_source(quality(spark, sf_dir))


LABELLED = f"""{PANEL},
labelled AS (
  SELECT row_id, year, class_new AS anchor, (CASE WHEN (row_id * 3 + year) % 5 = 0 OR row_id % 17 = 3 THEN class_new + 1 ELSE class_new END)::INTEGER AS label,
         ((row_id + year) % 10) / 10.0::DOUBLE AS ev_conf, (CASE WHEN row_id % 4 = 0 THEN class_new ELSE class_new + 1 END)::INTEGER AS wide_label, (row_id + year) % 3 = 0 AS evidence FROM panel)"""


def labelled(spark, sf_dir):
    k, y, c = F.col("row_id"), F.col("year"), F.col("class_new")
    return panel(spark, sf_dir).select("row_id", "year", c.alias("anchor"), F.when(((k * 3 + y) % 5 == 0) | (k % 17 == 3), c + 1).otherwise(c).alias("label"), ((k + y) % 10 / F.lit(10.0)).alias("ev_conf"), F.when(k % 4 == 0, c).otherwise(c + 1).alias("wide_label"), ((k + y) % 3 == 0).alias("evidence"))


@query(f"WITH {LABELLED} SELECT row_id, year, CASE WHEN ev_conf >= 0.8::DOUBLE AND label <> anchor AND NOT (wide_label = anchor AND ev_conf < 0.9::DOUBLE) THEN label ELSE anchor END AS out_label FROM labelled")
def f19_relabel_year(spark, sf_dir):
    return P.relabel_year(labelled(spark, sf_dir).withColumnRenamed("label", "ev_label")).select("row_id", "year", F.col("label").alias("out_label"))


@query(f"WITH {LABELLED}, c AS (SELECT row_id, anchor, label, count(*) AS n FROM labelled WHERE label <> anchor GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, label) AS r FROM c), a AS (SELECT row_id, min(anchor) AS anchor FROM labelled GROUP BY row_id) SELECT a.row_id, a.anchor, coalesce(n, 0) AS n_against, CASE WHEN n >= 4 THEN b.label ELSE a.anchor END AS label FROM a LEFT JOIN b ON a.row_id = b.row_id AND r = 1")
def a33_consistency_flip(spark, sf_dir):
    return P.consistency_flip(labelled(spark, sf_dir))


@query(f"WITH {LABELLED}, p AS (SELECT *, lag(label) OVER w AS l, lag(year) OVER w AS y FROM labelled WINDOW w AS (PARTITION BY row_id ORDER BY year)) SELECT count(*) AS n_pairs, count(*) FILTER (label <> l) AS n_flips, count(*) FILTER (label <> l AND evidence) AS n_gated FROM p WHERE y = year - 1")
def a34_gate_flips(spark, sf_dir):
    return P.gate_flips(labelled(spark, sf_dir))


@query(f"WITH {LABELLED} SELECT a.year AS year_a, b.year AS year_b, count(*) AS n, round(avg((a.label = b.label)::INTEGER), 6) AS share FROM labelled a JOIN labelled b ON a.row_id = b.row_id AND a.year < b.year GROUP BY ALL")
def a35_year_agreement(spark, sf_dir):
    return rounded(P.year_agreement(labelled(spark, sf_dir)), "share")


COSINE = f"list_dot_product(a.v, b.v) / (({NORM.format('a.v')} + 1e-12) * ({NORM.format('b.v')} + 1e-12))"


@query(f"WITH {PANEL}, s AS (SELECT b.year, avg({COSINE}) AS same FROM panel a JOIN panel b ON a.row_id = b.row_id AND b.year = a.year + 1 GROUP BY b.year), o AS (SELECT b.year, avg({COSINE}) AS other FROM panel a JOIN panel b ON a.row_id + 1 = b.row_id AND b.year = a.year + 1 GROUP BY b.year) SELECT year, round(same, 6) AS same, round(other, 6) AS other FROM s JOIN o USING (year)")
def g10_yearly_cosine(spark, sf_dir):
    return rounded(P.yearly_cosine(panel(spark, sf_dir)), "same", "other")


@query(f"WITH {PANEL}, {POINTS} SELECT 8 * count(*) AS n_expected, (SELECT count(*) FROM panel) AS n_found FROM points")
def j16_panel(spark, sf_dir):
    full = joins.panel_of(points(spark, sf_dir).select("row_id"), list(range(2017, 2025)), panel(spark, sf_dir).select("row_id", "year", F.lit(1).alias("x")))
    return full.agg(F.count("*").alias("n_expected"), F.count("x").alias("n_found"))


@query(f"WITH {PANEL} SELECT (row_id % 16) AS chunk_id, array_to_string(list_sort(list(DISTINCT year)), ',') AS years FROM panel GROUP BY chunk_id")
def a2_years_by_chunk(spark, sf_dir):
    from ..operators.diag import years_by_chunk

    return years_by_chunk(panel(spark, sf_dir).withColumn("chunk_id", F.col("row_id") % 16)).select("chunk_id", F.array_join("years", ",").alias("years"))


@query(f"WITH {POINTS} SELECT count(*) AS n FROM points WHERE row_id % 9 <> 0")
def f5_drop_nonfinite(spark, sf_dir):
    d = points(spark, sf_dir).withColumn("x", F.when(F.col("row_id") % 18 == 0, float("inf")).when(F.col("row_id") % 9 == 0, float("nan")).otherwise(F.col("lon")))
    return clean.drop_nonfinite(d, ["x", "lat"]).agg(F.count("*").alias("n"))
