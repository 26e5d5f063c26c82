"""Classifiers, resampling and sinks that SQL cannot express, against brute force and known figures."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landpanel.operators import clean, evaluate, model, panel, sampling
from landpanel.plans import base
from landpanel.sources import io


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(3)
    rows = [(i, c, f"g{i // 3 % 3}", 70.0 + c * 10 + r.normal(), 30.0 + r.normal(), [float(x) for x in r.normal(size=4) * 0.4 + np.eye(4)[c] * 3], 1.0, 2020 + i % 2, "s", "z") for i, c in enumerate(list(range(3)) * 40)]
    return spark.createDataFrame(rows, "row_id bigint, class_new int, grp string, lon double, lat double, v array<double>, train_weight double, year int, src string, zone string").cache()


def test_forests_learn_and_repeat(spark, blobs):
    train, val = blobs.where("row_id % 2 = 0"), blobs.where("row_id % 2 = 1")
    a = {r.row_id: (r.class_new, r.pred) for r in model.rf_eval(train, val, trees=20, depth=6).collect()}
    assert len(a) == 60 and sum(x == y for x, y in a.values()) >= 57
    assert a == {r.row_id: (r.class_new, r.pred) for r in model.rf_eval(train, val, trees=20, depth=6).collect()}
    voted = model.ensemble(train, val, [1, 2, 3], trees=10, depth=5)
    assert voted.where("pred = class_new").count() >= 57 and set(voted.columns) == {*val.columns, "pred"}
    odd = val.limit(1).withColumn("v", F.array(*[F.lit(float("nan"))] * 4))
    assert model.rf_eval(train, odd, trees=3, depth=3).count() == 0


def test_held_out_blocks_do_not_train(spark, blobs):
    block = F.floor("lon").cast("bigint")
    keys = blobs.select(block.alias("block_key")).where("block_key % 2 = 0").distinct()
    train, held = model.holdout_split(blobs, keys, block)
    assert train.count() + held.count() == 120 and train.where("block_key % 2 = 0").count() == 0 == held.where("block_key % 2 <> 0").count()
    done = model.spatial_eval(blobs, blobs, keys, block, [2020, 2021], trees=10, depth=5)
    assert done.count() == held.count() and done.columns == ["row_id", "year", "class_new", "pred", "src", "zone"]
    counts = {r.year: (r.n_train, r.n_val) for r in model.spatial_eval(blobs, blobs, keys, block, [2020, 2021], validate_only=True).collect()}
    assert sum(a + b for a, b in counts.values()) == 120


def test_deep_forests_are_never_held_by_the_driver(blobs, monkeypatch):
    def fit(*_, **__):
        raise AssertionError("a forest of 150 deep trees on the driver")

    monkeypatch.setattr(model, "fit_forest", fit)
    train, val = blobs.where("row_id % 2 = 0"), blobs.where("row_id % 2 = 1")
    assert model.rf_eval(train, val, trees=12, by=["year"]).count() == 0  # odd years have no training rows
    both = model.rf_eval(blobs, blobs, trees=12, depth=20, by=["year"])
    one = model.rf_eval(blobs.where("year = 2020"), blobs.where("year = 2020"), trees=12, depth=20)
    assert both.count() == 120 and both.where("pred = class_new").count() >= 114 and one.where("pred = class_new").count() >= 57


def test_leaving_a_group_out_equals_plain_means(blobs):
    rows = blobs.collect()
    got = {r.row_id: r.pred for r in model.logo_eval(blobs, "grp").collect()}
    for r in rows[::7]:
        best = {}
        for c in range(3):
            m = np.sum([x.v for x in rows if x.class_new == c and x.grp != r.grp], axis=0)
            best[c] = round(float(np.dot(r.v, m) / np.linalg.norm(r.v) / np.linalg.norm(m)), 9)
        assert got[r.row_id] == min(best, key=lambda c: (-best[c], c))


def test_silhouette_and_distances(spark, blobs):
    rows = blobs.collect()
    u = np.array([np.array(r.v) / np.linalg.norm(r.v) for r in rows])
    c, d = np.array([r.class_new for r in rows]), 1 - u @ u.T
    s = []
    for i in range(len(rows)):
        a = d[i, (c == c[i]) & (np.arange(len(rows)) != i)].mean()
        b = min(d[i, c == k].mean() for k in range(3) if k != c[i])
        s.append((b - a) / max(a, b))
    assert model.silhouette(blobs).first().silhouette == pytest.approx(np.mean(s), abs=1e-9)
    x = np.array([r.v for r in rows])
    means = np.array([x[c == k].mean(axis=0) for k in range(3)])
    cov = sum((x[c == k] - means[k]).T @ (x[c == k] - means[k]) for k in range(3)) / (len(x) - 3)
    for r in model.centroid_distance(blobs, 2).collect():
        diff = means[r.a] - means[r.b]
        assert r.distance == pytest.approx(math.sqrt(diff @ np.linalg.inv(cov) @ diff), rel=1e-6)


def test_features_beat_coordinates_only_where_they_do(blobs):
    train, val = blobs.where("row_id % 2 = 0"), blobs.where("row_id % 2 = 1").withColumn("lon", F.lit(75.0))
    r = model.forest_baseline(train, val, trees=20, depth=5).first()
    assert r.features_oa > 0.95 and r.coords_oa < 0.6 and r.gain == pytest.approx(r.features_oa - r.coords_oa)


def test_permutations_follow_the_hypergeometric_law(spark):
    rows = [(i, "s", i < 10, i < 7 or 10 <= i < 13) for i in range(30)]
    d = spark.createDataFrame(rows, "row_id int, zone string, e boolean, c boolean")
    got = evaluate.permutation_p(d, ["zone"], F.col("e"), F.col("c"), perms=20_000).first()
    assert got.observed == pytest.approx(0.7 - 0.15)
    p = sum(math.comb(10, k) * math.comb(20, 10 - k) for k in range(11) if abs(k / 10 - (10 - k) / 20) >= 0.55 - 1e-12) / math.comb(30, 10)
    assert got.p == pytest.approx(p, abs=0.004)
    assert evaluate.permutation_p(d, ["zone"], F.col("e"), F.col("c"), perms=500).first() == evaluate.permutation_p(d.repartition(5), ["zone"], F.col("e"), F.col("c"), perms=500).first()


def test_intervals_of_means(spark):
    d = spark.createDataFrame([(float(i), float(i) - 1 - (i % 3) / 10) for i in range(9)], "a double, b double")
    r, sd = evaluate.parametric_ci(d).first(), math.sqrt(sum((x - 1.1) ** 2 for x in [1.0, 1.1, 1.2] * 3) / 8)
    assert r.mean == pytest.approx(1.1) and r.hi - r.lo == pytest.approx(2 * 1.96 * sd / 3, rel=0.05)
    z = spark.range(50_000).select(evaluate.normal_draw(F.col("id")).alias("z")).agg(F.avg("z"), F.stddev("z"), F.kurtosis("z")).first()
    assert abs(z[0]) < 0.02 and abs(z[1] - 1) < 0.02 and abs(z[2]) < 0.1
    e = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("x"))
    b = evaluate.bootstrap_ci(e, "x").first()
    assert b.lo < 0.5 < b.hi and b.hi - b.lo == pytest.approx(2 * 1.96 * 0.5 / 20, rel=0.3)


def test_running_sums_over_ranges(spark):
    r = random.Random(2)
    rows = [(i, r.choice([1.0, 2.5, 7.0]), r.randint(0, 9)) for i in range(500)]
    d = spark.createDataFrame(rows, "k int, x double, n int")
    got = {x.k: x.before for x in clean.running(d, ["x", "k"], {"before": F.col("n")}, ranges=7).collect()}
    total = 0
    for k, _, n in sorted(rows, key=lambda q: (q[1], q[0])):
        assert got[k] == total
        total += n
    y = [(r.random(), r.randint(0, 1)) for _ in range(300)]
    pos, neg = ([s for s, t in y if t == v] for v in (1, 0))
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluate.auc(spark.createDataFrame(y, "score double, label int")).first().auc == pytest.approx(want)


def test_hard_negatives_come_first(spark):
    pos = spark.createDataFrame([(i, 100.0 + i, 30.0) for i in range(4)], "row_id bigint, lon double, lat double")
    pool = spark.createDataFrame([(10 + i, 100.0 + i, 30.001) for i in range(2)] + [(50 + i, 10.0 + i, 0.0) for i in range(9)], "row_id bigint, lon double, lat double")
    got = {r.row_id: r.kind for r in sampling.hard_negatives(pos, pool).collect()}
    assert len(got) == 4 and got[10] == got[11] == "hard"


def test_sinks_and_manifest(spark, blobs, tmp_path):
    p = blobs.withColumn("pred", F.col("class_new"))
    io.save_predictions(p, str(tmp_path / "p"))
    back = io.scan(spark, str(tmp_path / "p"))
    assert back.count() == 120 and sorted(x.name for x in (tmp_path / "p").iterdir() if x.is_dir()) == ["year=2020", "year=2021"]
    assert set(back.columns) == {"row_id", "year", "class_new", "pred", "src", "zone"}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.bin").write_bytes(b"abc")
    (tmp_path / "m" / "b.bin").write_bytes(b"x" * 1000)
    got = {r.path.split("/")[-1]: r for r in io.file_manifest(spark, str(tmp_path / "m"), heavy=100).collect()}
    assert got["a.bin"].sha256 == hashlib.sha256(b"abc").hexdigest() and got["a.bin"].md5 == hashlib.md5(b"abc").hexdigest()
    assert got["b.bin"].bytes == 1000 and got["b.bin"].md5 is None


def test_a_range_of_times_reaches_the_scan(spark, sf_dir):
    d = io.scan_between(spark, f"{sf_dir}/lineitem.parquet", "l_shipdate", "1995-01-01", "1996-01-01", ["l_quantity"])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan


def test_quality_reads_the_panel_no_more_than_twice(spark, sf_dir):
    q = panel.qc_summary(panel.quality(base.panel(spark, sf_dir), base.points(spark, sf_dir), min_n=10, min_n_stats=10))
    assert "Scan parquet" not in q._jdf.queryExecution().executedPlan().toString()  # all from the rows without vectors
