"""Queries of accuracy, agreement and effect sizes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import clean, diag, sampling
from ..operators import evaluate as E
from ..sources.io import table
from .base import POINTS, PREDICTIONS, points, predictions, query, rounded

CM = f"{PREDICTIONS}, cm AS (SELECT truth, pred, count(*) AS n FROM predictions GROUP BY ALL)"


def classes(by: str = "", cm: str = "cm") -> str:
    """CTE pc: per class sums of cm, by optional columns."""
    b = f"{by}, " if by else ""
    return f"""pc AS (SELECT {b}class, sum(r)::BIGINT AS n_ref, sum(p)::BIGINT AS n_pred, sum(t)::BIGINT AS tp FROM (
  SELECT {b}truth AS class, n AS r, 0 AS p, CASE WHEN truth = pred THEN n ELSE 0 END AS t FROM {cm} UNION ALL SELECT {b}pred, 0, n, 0 FROM {cm}) GROUP BY ALL)"""


METRICS = """sum(n_ref)::BIGINT AS n, round(sum(tp) / sum(n_ref), 6) AS oa, round(avg(CASE WHEN n_ref > 0 THEN 2.0::DOUBLE * tp / (n_ref + n_pred) END), 6) AS macro_f1,
  round(avg(CASE WHEN n_ref > 0 THEN tp::DOUBLE / n_ref END), 6) AS bal_acc, round(avg(CASE WHEN n_ref > 0 AND n_pred > 0 THEN tp::DOUBLE / n_pred END), 6) AS macro_ua, count(*) FILTER (n_ref > 0) AS n_classes_scored"""
MEASURES = ("oa", "macro_f1", "bal_acc", "macro_ua")


@query(f"WITH {CM} SELECT * FROM cm")
def a7_confusion(spark, sf_dir):
    return E.confusion(predictions(spark, sf_dir))


@query(f"WITH {CM} SELECT truth, coalesce(sum(n) FILTER (pred = 0), 0)::BIGINT AS pred_0, coalesce(sum(n) FILTER (pred = 1), 0)::BIGINT AS pred_1, coalesce(sum(n) FILTER (pred = 10), 0)::BIGINT AS pred_10 FROM cm GROUP BY truth")
def a7_confusion_wide(spark, sf_dir):
    return E.confusion_wide(E.confusion(predictions(spark, sf_dir)), [0, 1, 10])


@query(f"WITH {CM}, {classes()} SELECT class, n_ref, n_pred, tp, round(CASE WHEN n_pred > 0 THEN tp::DOUBLE / n_pred END, 6) AS ua, round(CASE WHEN n_ref > 0 THEN tp::DOUBLE / n_ref END, 6) AS pa, round(2.0::DOUBLE * tp / (n_ref + n_pred), 6) AS f1 FROM pc")
def a8_per_class(spark, sf_dir):
    return rounded(E.per_class(E.confusion(predictions(spark, sf_dir))), "ua", "pa", "f1")


@query(f"WITH {CM}, {classes()} SELECT {METRICS} FROM pc")
def a8_metrics(spark, sf_dir):
    return rounded(E.metrics(E.confusion(predictions(spark, sf_dir))), *MEASURES)


@query(f"""WITH {PREDICTIONS}, cms AS (
  SELECT 'year_zone' AS level, year::VARCHAR AS year, zone, truth, pred, count(*) AS n FROM predictions GROUP BY ALL
  UNION ALL SELECT 'year', year::VARCHAR, 'all', truth, pred, count(*) FROM predictions GROUP BY ALL
  UNION ALL SELECT 'overall', 'all', 'all', truth, pred, count(*) FROM predictions GROUP BY ALL), {classes("level, year, zone", "cms")}
SELECT level, year, zone, {METRICS} FROM pc GROUP BY ALL""")
def a9_metrics_sets(spark, sf_dir):
    return rounded(E.metrics_sets(predictions(spark, sf_dir)), *MEASURES)


@query(f"WITH {PREDICTIONS}, cms AS (SELECT src, truth, pred, count(*) AS n FROM predictions GROUP BY ALL), {classes('src', 'cms')} SELECT src, {METRICS} FROM pc GROUP BY src")
def a10_metrics_by_source(spark, sf_dir):
    return rounded(E.metrics(E.confusion(predictions(spark, sf_dir), ["src"]), ["src"]), *MEASURES)


@query(f"WITH {CM} SELECT * FROM cm")
def a11_merge_confusion(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return E.merge_confusion(*(E.confusion(p.where(F.col("year") == y)) for y in range(2017, 2025)))


@query(f"""WITH {CM}, labels AS (SELECT truth AS class FROM cm UNION SELECT pred FROM cm), w0 AS (SELECT class AS pred, CASE WHEN class < 10 THEN (class + 1) / 60.0::DOUBLE ELSE 0 END AS w FROM labels),
w AS (SELECT pred, w / sum(w) OVER () AS w FROM w0), h AS (SELECT pred, sum(n)::BIGINT AS nh FROM cm GROUP BY pred),
g AS (SELECT l.class, h.pred, nh, w, coalesce(cm.n, 0)::DOUBLE / nh AS p FROM labels l CROSS JOIN h JOIN w USING (pred) LEFT JOIN cm ON cm.truth = l.class AND cm.pred = h.pred),
e AS (SELECT class, sum(w * p) AS est, sqrt(sum(w * w * p * (1 - p) / greatest(nh - 1, 1))) AS se FROM g GROUP BY class)
SELECT class, round(est, 6) AS est, round(se, 6) AS se, round(greatest(0, est - 1.96::DOUBLE * se), 6) AS lo, round(est + 1.96::DOUBLE * se, 6) AS hi FROM e""")
def a12_olofsson(spark, sf_dir):
    prior = spark.range(0, 12).select(F.col("id").cast("int").alias("class"), ((F.col("id") + 1) / F.lit(60.0)).alias("share")).where("class < 10")
    return rounded(E.olofsson(E.confusion(predictions(spark, sf_dir)), prior), "est", "se", "lo", "hi")


OA_BY = f"{PREDICTIONS}, o AS (SELECT zone, year, count(*) AS n, avg((truth = pred)::INTEGER) AS oa FROM predictions GROUP BY ALL)"


@query(f"WITH {OA_BY} SELECT zone, round(max(struct_pack(n := n, oa := oa)).oa, 6) AS oa, sum(n)::BIGINT AS n_total, round(sum(oa * n) / sum(n), 6) AS oa_weighted FROM o GROUP BY zone")
def a13_max_by_n(spark, sf_dir):
    d = predictions(spark, sf_dir).groupBy("zone", "year").agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("pred")).cast("int")).alias("oa"))
    w = E.max_by_n(d, ["zone"], "oa", weighted=True).select("zone", F.col("oa").alias("oa_weighted"))
    return rounded(E.max_by_n(d, ["zone"], "oa").join(w, "zone"), "oa", "oa_weighted")


@query(f"WITH {CM}, {classes()}, s AS (SELECT sum(n_ref)::DOUBLE AS n, sum(tp) AS tp, sum(n_ref * n_pred)::DOUBLE AS e FROM pc) SELECT n::BIGINT AS n, round(tp / n, 6) AS po, round(e / n / n, 6) AS pe, round((tp / n - e / n / n) / (1 - e / n / n), 6) AS kappa FROM s")
def a22_kappa(spark, sf_dir):
    return rounded(E.kappa(E.confusion(predictions(spark, sf_dir))), "po", "pe", "kappa")


SCORED = f"{PREDICTIONS}, scored AS (SELECT score, (truth = pred)::INTEGER AS label, zone, year, row_id FROM predictions)"


def scored(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn("label", (F.col("truth") == F.col("pred")).cast("int"))


@query(f"WITH {SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored), s AS (SELECT sum(label)::BIGINT AS p, (count(*) - sum(label))::BIGINT AS q, sum(CASE WHEN label = 1 THEN r END) AS t FROM r) SELECT p AS n_pos, q AS n_neg, round((t - p * (p + 1) / 2.0::DOUBLE) / (p::DOUBLE * q), 6) AS auc FROM s")
def a23_auc(spark, sf_dir):
    return rounded(E.auc(scored(spark, sf_dir)), "auc")


@query(f"WITH {SCORED} SELECT t.theta::DOUBLE AS theta, count(*) AS n_kept, round(avg(label), 6) AS precision, round(sum(label)::DOUBLE / (SELECT sum(label) FROM scored), 6) AS recall FROM scored JOIN (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) t(theta) ON score >= t.theta GROUP BY ALL")
def a24_threshold_sweep(spark, sf_dir):
    return rounded(E.threshold_sweep(scored(spark, sf_dir), [0.2, 0.5, 0.8]), "precision", "recall")


T2 = f"{SCORED}, t AS (SELECT zone, count(*) FILTER (score > 0.5 AND label = 0)::DOUBLE AS a, count(*) FILTER (score > 0.5 AND label = 1)::DOUBLE AS b, count(*) FILTER (score <= 0.5 AND label = 0)::DOUBLE AS c, count(*) FILTER (score <= 0.5 AND label = 1)::DOUBLE AS d FROM scored GROUP BY zone)"


def sides():
    """(exposed, case)"""
    return F.col("score") > 0.5, F.col("label") == 0


@query(f"WITH {T2}, s AS (SELECT sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM t), o AS (SELECT *, a * d / (b * c) AS r, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se FROM s) SELECT a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, round(r, 6) AS odds_ratio, round(exp(ln(r) - 1.96::DOUBLE * se), 6) AS lo, round(exp(ln(r) + 1.96::DOUBLE * se), 6) AS hi FROM o")
def a20_odds_ratio(spark, sf_dir):
    return rounded(E.odds_ratio(scored(spark, sf_dir), *sides()), "odds_ratio", "lo", "hi")


@query(f"WITH {T2} SELECT count(*) AS n_strata, round(sum(a * d / (a + b + c + d)) / sum(b * c / (a + b + c + d)), 6) AS mh_odds_ratio FROM t")
def a20_mh_odds_ratio(spark, sf_dir):
    return rounded(E.mh_odds_ratio(scored(spark, sf_dir), ["zone"], *sides()), "mh_odds_ratio")


@query(f"WITH {T2} SELECT round((sum(a) / (sum(a) + sum(b))) / (sum(c) / (sum(c) + sum(d))), 6) AS rr, round(sum(a * (c + d) / (a + b + c + d)) / sum(c * (a + b) / (a + b + c + d)), 6) AS mh_rr FROM t")
def a21_risk_ratio(spark, sf_dir):
    return rounded(E.risk_ratio(scored(spark, sf_dir), ["zone"], *sides()), "rr", "mh_rr")


@query()
def a21_permutation_p(spark, sf_dir):
    return E.permutation_p(scored(spark, sf_dir), ["zone"], *sides())


@query(f"WITH {OA_BY}, f AS (SELECT year, avg(CASE WHEN zone < 'p3' THEN oa END) AS a, avg(CASE WHEN zone >= 'p3' THEN oa END) AS b FROM o GROUP BY year) SELECT count(*) AS n, round(avg(a - b), 6) AS mean, round(stddev_samp(a - b), 6) AS sd, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t FROM f")
def a25_paired_t(spark, sf_dir):
    d = predictions(spark, sf_dir).groupBy("zone", "year").agg(F.avg((F.col("truth") == F.col("pred")).cast("int")).alias("oa"))
    return rounded(E.paired_t(d.groupBy("year").agg(F.avg(F.when(F.col("zone") < "p3", F.col("oa"))).alias("a"), F.avg(F.when(F.col("zone") >= "p3", F.col("oa"))).alias("b"))), "mean", "sd", "t")


def folds(spark, sf_dir):
    d = predictions(spark, sf_dir).groupBy("zone", "year").agg(F.avg((F.col("truth") == F.col("pred")).cast("int")).alias("oa"))
    return d.groupBy("year").agg(F.avg(F.when(F.col("zone") < "p3", F.col("oa"))).alias("a"), F.avg(F.when(F.col("zone") >= "p3", F.col("oa"))).alias("b"))


def scattered(k: int) -> str:
    x = f"((k % 2147483647 + {k}) * 2654435761 % 2147483647)"
    y = f"(({x} * {x} + {k}) % 2147483647)"
    return f"(({y} * {y} + {x}) % 2147483647 + 0.5::DOUBLE) / 2147483647.0::DOUBLE"


@query(f"""WITH {OA_BY}, f AS (SELECT year, avg(CASE WHEN zone < 'p3' THEN oa END) AS a, avg(CASE WHEN zone >= 'p3' THEN oa END) AS b FROM o GROUP BY year),
t AS (SELECT count(*) AS n, avg(a - b) AS mean, coalesce(stddev_samp(a - b), 0) AS sd FROM f), k AS (SELECT r, n, mean, sd, r * n + i AS k FROM t, range(20000) x(r), range(1000) y(i) WHERE i < n),
m AS (SELECT r, n, mean, avg(mean + sd * (sqrt(-2.0::DOUBLE * ln({scattered(7)})) * cos(2.0::DOUBLE * 3.141592653589793::DOUBLE * ({scattered(104736)})))) AS m FROM k GROUP BY ALL)
SELECT n, round(mean, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m GROUP BY n, mean""")
def a25_parametric_ci(spark, sf_dir):
    return rounded(E.parametric_ci(folds(spark, sf_dir)), "mean", "lo", "hi")


POISSON = " + ".join(f"(u > {sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))!r}::DOUBLE)::INTEGER" for k in range(8))


@query(f"""WITH {PREDICTIONS}, s AS (SELECT (row_id * 10000 + year) % 2147483647 AS n, (truth = pred)::INTEGER AS label FROM predictions),
a AS (SELECT r, label, 7 + r * 104729 AS k, (n + 7 + r * 104729) * 2654435761 % 2147483647 AS a FROM s, range(1, 1001) t(r)),
b AS (SELECT r, label, a, (a * a + k) % 2147483647 AS b FROM a), u AS (SELECT r, label, ((b * b + a) % 2147483647 + 0.5::DOUBLE) / 2147483647.0::DOUBLE AS u FROM b),
m AS (SELECT r, sum(label * w) / sum(w)::DOUBLE AS m FROM (SELECT r, label, {POISSON} AS w FROM u) GROUP BY r)
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def a25_bootstrap_ci(spark, sf_dir):
    d = predictions(spark, sf_dir).select((F.col("row_id") * 10000 + F.col("year")).alias("k"), (F.col("truth") == F.col("pred")).cast("int").alias("hit"))
    return rounded(E.bootstrap_ci(d, "hit", key="k"), "mean", "lo", "hi")


@query(f"WITH {PREDICTIONS}, s AS (SELECT zone, count(*) AS n, avg((truth = pred)::INTEGER) AS p, length(zone)::DOUBLE + count(DISTINCT src) AS w0 FROM predictions GROUP BY zone), w AS (SELECT *, w0 / sum(w0) OVER () AS w FROM s), r AS (SELECT sum(w * p) AS oa, sqrt(sum(w * w * p * (1 - p) / greatest(n - 1, 1))) AS se FROM w) SELECT round(oa, 6) AS oa, round(se, 6) AS se, round(greatest(0, oa - 1.96::DOUBLE * se), 6) AS lo, round(least(1, oa + 1.96::DOUBLE * se), 6) AS hi FROM r")
def a26_weighted_oa(spark, sf_dir):
    p = predictions(spark, sf_dir)
    w = p.groupBy("zone").agg((F.first(F.length("zone")).cast("double") + F.count_distinct("src")).alias("w"))
    return rounded(E.weighted_oa(p, w, ["zone"], F.expr("truth = pred")), "oa", "se", "lo", "hi")


@query(f"WITH {CM}, m AS (SELECT code, code // 3 AS grp FROM range(0, 11) t(code)), j AS (SELECT x.grp AS ga, y.grp AS gb, sum(n)::BIGINT AS n FROM cm JOIN m x ON x.code = truth JOIN m y ON y.code = pred WHERE pred <> 10 GROUP BY ALL) SELECT ga, gb, n, round(n / sum(n) OVER (PARTITION BY ga), 6) AS share_a, round(n / sum(n) OVER (PARTITION BY gb), 6) AS share_b FROM j")
def a30_agreement(spark, sf_dir):
    m = spark.range(0, 11).select(F.col("id").alias("code"), F.floor(F.col("id") / 3).cast("bigint").alias("group"))
    return rounded(E.agreement(predictions(spark, sf_dir).select(F.col("truth").alias("a"), F.col("pred").alias("b")), m, m.where("code <> 10")), "share_a", "share_b")


@query(f"WITH {CM} SELECT (truth * 10)::BIGINT AS truth, (pred * 10)::BIGINT AS pred, n FROM cm")
def a31_remap_crosstab(spark, sf_dir):
    return E.remap_crosstab(E.confusion(predictions(spark, sf_dir)), spark.range(0, 11).select(F.col("id").alias("old"), (F.col("id") * 10).alias("new")))


@query(f"WITH {PREDICTIONS}, v AS (SELECT row_id, year, unnest([truth, pred, (row_id % 10)::INTEGER]) AS c FROM predictions), k AS (SELECT row_id, year, c, count(*) AS n FROM v GROUP BY ALL) SELECT row_id, year, arg_min(c, (-n) * 1000 + c) AS vote FROM k GROUP BY ALL")
def a32_vote(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn("third", (F.col("row_id") % 10).cast("int")).select("row_id", "year", E.vote(["truth", "pred", "third"]).alias("vote"))


@query(f"WITH {PREDICTIONS} SELECT count(*) AS n, count(*) FILTER ((score > 0.3)::INTEGER + (truth = pred)::INTEGER + (src = 's1')::INTEGER >= 2) AS n_voted FROM predictions")
def a49_vote_min(spark, sf_dir):
    d = predictions(spark, sf_dir).select((F.col("score") > 0.3).alias("a"), F.expr("truth = pred").alias("b"), (F.col("src") == "s1").alias("c"))
    return d.agg(F.count("*").alias("n"), F.count_if(E.vote_min(["a", "b", "c"])).alias("n_voted"))


REVIEW = "review AS (SELECT l.doc_id, d.source, CASE WHEN l.doc_id % 7 = 0 THEN 'unable' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS answer, toxic AS fine, CASE WHEN l.doc_id % 7 = 0 THEN 'unable' WHEN quality = 1 AND l.doc_id % 11 <> 0 THEN 'yes' ELSE 'no' END AS answer2, (CASE WHEN l.doc_id % 5 = 0 THEN 1 - toxic ELSE toxic END)::INTEGER AS fine2 FROM labels l JOIN documents d USING (doc_id))"


def review(spark, sf_dir):
    k, unable = F.col("doc_id"), F.col("doc_id") % 7 == 0
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return d.select(k, "source", F.when(unable, "unable").when(F.col("quality") == 1, "yes").otherwise("no").alias("answer"), F.col("toxic").alias("fine"), F.when(unable, "unable").when((F.col("quality") == 1) & (k % 11 != 0), "yes").otherwise("no").alias("answer2"), F.when(k % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("fine2"))


@query(f"WITH {REVIEW} SELECT source, count(*) FILTER (answer <> 'unable') AS n_reviewed, round(avg(CASE answer WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END), 6) AS precision FROM review GROUP BY source")
def a36_layer_precision(spark, sf_dir):
    return rounded(E.layer_precision(review(spark, sf_dir), ["source"]), "precision")


@query(f"WITH {REVIEW}, r AS (SELECT count(*) AS n, avg((answer = answer2)::INTEGER) AS a, avg(CASE WHEN answer = 'no' THEN (answer2 = 'no')::INTEGER END) AS b, avg(CASE WHEN answer = 'yes' AND answer2 = 'yes' THEN (fine = fine2)::INTEGER END) AS c FROM review) SELECT n, round(a, 6) AS agree3, round(b, 6) AS no_audit, round(c, 6) AS fine_agree, a >= 0.9 AND b >= 0.9 AS passed FROM r")
def a37_review_qc(spark, sf_dir):
    d = review(spark, sf_dir)
    return rounded(E.review_qc(d, d.select("doc_id", F.col("answer2").alias("answer"), F.col("fine2").alias("fine")), "doc_id"), "agree3", "no_audit", "fine_agree")


@query(f"WITH {CM} SELECT least(truth, pred) AS a, greatest(truth, pred) AS b, sum(n)::BIGINT AS n FROM cm WHERE truth <> pred GROUP BY ALL")
def a38_confused_pairs(spark, sf_dir):
    return E.confused_pairs(E.confusion(predictions(spark, sf_dir))).orderBy(F.desc("n"), "a", "b")


@query(f"WITH {PREDICTIONS}, f AS (SELECT truth FROM predictions GROUP BY truth HAVING count(*) >= 30), cms AS (SELECT 'fine' AS level, truth, pred, count(*) AS n FROM predictions WHERE truth IN (SELECT truth FROM f) GROUP BY ALL UNION ALL SELECT 'group', truth // 3, pred // 3, count(*) FROM predictions GROUP BY ALL UNION ALL SELECT 'top', truth // 6, pred // 6, count(*) FROM predictions GROUP BY ALL), {classes('level', 'cms')} SELECT level, {METRICS} FROM pc GROUP BY level")
def a46_metrics_levels(spark, sf_dir):
    m = lambda k: spark.range(0, 11).select(F.col("id").cast("int").alias("code"), F.floor(F.col("id") / k).cast("int").alias("group"))
    return rounded(E.metrics_levels(predictions(spark, sf_dir), {"group": m(3), "top": m(6)}), *MEASURES)


@query(f"WITH {PREDICTIONS}, s AS (SELECT avg(score) FILTER (truth = pred) AS a, avg(score) FILTER (truth <> pred) AS b, var_samp(score) FILTER (truth = pred) AS v, var_samp(score) FILTER (truth <> pred) AS u FROM predictions) SELECT round(a, 6) AS mean_1, round(b, 6) AS mean_0, round((a - b) / sqrt((v + u) / 2), 6) AS smd FROM s")
def a47_smd(spark, sf_dir):
    return rounded(E.smd(predictions(spark, sf_dir), F.expr("truth = pred"), "score"), "mean_1", "mean_0", "smd")


TIERS = ["gold", "silver", "bronze", "external", "uncovered"]


@query(f"WITH {PREDICTIONS}, t AS (SELECT tier, list_position({TIERS}, tier) AS k, count(*) AS n, avg((truth = pred)::INTEGER) AS rate FROM predictions WHERE tier IS NOT NULL GROUP BY tier) SELECT tier, n, round(rate, 6) AS rate, coalesce(rate <= lag(rate) OVER (ORDER BY k), true) AS fine FROM t")
def a44_tier_monotone(spark, sf_dir):
    return rounded(E.tier_monotone(predictions(spark, sf_dir), "tier", F.expr("truth = pred"), TIERS), "rate")


ARMS = f"{PREDICTIONS}, arms AS (SELECT src AS arm, year AS seed, avg((truth = pred)::INTEGER) AS metric FROM predictions GROUP BY ALL)"


@query(f"WITH {ARMS}, g AS (SELECT a.arm, a.metric - b.metric AS g FROM arms a JOIN arms b USING (seed) WHERE b.arm = 's0' AND a.arm <> 's0') SELECT arm, round(avg(g), 6) AS mean_gain, count(*) AS n_seeds, min(g) > 0 OR max(g) < 0 AS same_sign, avg(g) >= 0.02 AND (min(g) > 0 OR max(g) < 0) AS passed FROM g GROUP BY arm")
def m10_compare_arms(spark, sf_dir):
    d = predictions(spark, sf_dir).groupBy(F.col("src").alias("arm"), F.col("year").alias("seed")).agg(F.avg(F.expr("truth = pred").cast("int")).alias("metric"))
    return rounded(E.compare_arms(d, "s0"), "mean_gain")


@query(f"WITH {PREDICTIONS} SELECT zone, pred // 5 AS fold_key, count(*) AS n, round(avg((truth = pred)::INTEGER), 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY zone, pred // 5 ORDER BY (row_id % 2147483647) * 2654435761 % 2147483647, row_id, year) AS r FROM predictions WHERE year = 2020) WHERE r <= 20 GROUP BY ALL")
def a40_fidelity(spark, sf_dir):
    d = predictions(spark, sf_dir).where("year = 2020").withColumn("fold_key", F.floor(F.col("pred") / 5).cast("int"))
    return rounded(sampling.fidelity(d, ["zone", "fold_key"], F.expr("truth = pred"), 20), "share")


@query(f"WITH {POINTS} SELECT src, count(*) AS n, round(avg((class_new > 6)::INTEGER), 6) AS rate, round(avg((class_new > 6)::INTEGER) / max(avg((class_new > 6)::INTEGER)) FILTER (src = 's0') OVER (), 6) AS multiple FROM points GROUP BY src")
def a43_rejection_by_source(spark, sf_dir):
    return rounded(diag.rejection_by_source(points(spark, sf_dir), F.col("class_new") > 6, "s0"), "rate", "multiple")


@query(f"WITH {PREDICTIONS} SELECT year, (CASE WHEN truth IN (2, 3) AND pred IN (7, 8, 9, 4) THEN pred ELSE truth END)::INTEGER AS final, count(*) AS n FROM predictions GROUP BY ALL")
def m11_override(spark, sf_dir):
    from ..operators.model import override

    return predictions(spark, sf_dir).groupBy("year", override(F.col("truth"), F.col("pred"), [4, 7, 8, 9], [2, 3]).alias("final")).agg(F.count("*").alias("n"))


@query(f"WITH {PREDICTIONS} SELECT zone, count(*) AS n, count(*) FILTER (score > 0.9) AS quarantine, count(*) FILTER (score <= 0.9 AND truth <> pred) AS flag, count(*) FILTER (score <= 0.9 AND truth = pred) AS keep, count(*) FILTER (score >= 0.7 AND score < 0.9) AS band_b FROM predictions GROUP BY zone")
def f15_verdicts(spark, sf_dir):
    d = predictions(spark, sf_dir).withColumns({"v": clean.verdict(F.col("score") > 0.9, F.expr("truth <> pred")), "b": clean.banded_verdict(F.col("score"))})
    return d.groupBy("zone").agg(F.count("*").alias("n"), *(F.count_if(F.col("v") == x).alias(x) for x in ("quarantine", "flag", "keep")), F.count_if(F.col("b") == "B").alias("band_b"))
