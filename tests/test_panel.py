"""Hand-computed cases of the quality ladder, the deltas and the missing-value rules."""

import math

import pytest
from pyspark.sql import functions as F

from landpanel.functions import scalar, vec
from landpanel.operators import panel as P

NAN = float("nan")


@pytest.mark.parametrize(
    ("valid", "cos", "zp", "zn", "status", "reason", "weight"),
    [
        (False, 0.9, 9.0, None, "exclude_year", "embedding_invalid", 0.0),
        (True, 0.05, None, None, "exclude_year", "class_center_outlier", 0.0),
        (True, 0.15, 9.0, None, "downweight", "class_center_low", 0.5),  # never becomes a spike
        (True, 0.9, 6.0, None, "exclude_year", "single_year_anomaly", 0.0),
        (True, 0.9, 6.0, NAN, "exclude_year", "single_year_anomaly", 0.0),
        (True, 0.9, NAN, 1.0, "keep", "", 1.0),  # NaN is unknown, not large
        (True, 0.9, 3.0, 6.0, "exclude_year", "single_year_anomaly", 0.0),
        (True, 0.9, 6.0, 4.0, "keep", "", 1.0),  # neither calm nor strong on the other side
        (True, 0.9, 6.0, 5.5, "persistent_change", "persistent_change", 0.3),
        (True, None, 6.0, 5.5, "persistent_change", "persistent_change", 0.3),
        (True, NAN, 1.0, 1.0, "keep", "", 1.0),
        (True, 0.1, 1.0, 1.0, "downweight", "class_center_low", 0.5),  # exactly P01
        (True, 0.2, 1.0, 1.0, "keep", "", 1.0),  # exactly P05
    ],
)
def test_ladder(spark, valid, cos, zp, zn, status, reason, weight):
    d = spark.createDataFrame([(valid, cos, zp, zn, 0.1, 0.2)], "emb_valid boolean, cos_center double, delta_prev_z double, delta_next_z double, p01 double, p05 double")
    r = P.qc_ladder(d).first()
    assert (r.qc_status, r.qc_reason, r.qc_weight) == (status, reason, weight)


def test_validity_of_vectors(spark):
    rows = [([1.0, 0.0],), ([NAN, 1.0],), ([math.inf, 1.0],), ([0.0, 0.0],), ([1e-7, 0.0],), (None,), ([None, 1.0],)]
    d = spark.createDataFrame(rows, "v array<double>")
    assert [r[0] for r in d.select(vec.emb_valid("v")).collect()] == [True] + [False] * 6


def test_deltas_only_between_adjacent_years(spark):
    d = spark.createDataFrame([(1, 2017, [0.0]), (1, 2018, [3.0]), (1, 2020, [9.0]), (2, 2018, [1.0])], "row_id bigint, year int, v array<double>")
    r = {(x.row_id, x.year): (x.delta_prev, x.delta_next) for x in P.with_deltas(d).collect()}
    assert r == {(1, 2017): (None, 3.0), (1, 2018): (3.0, None), (1, 2020): (None, None), (2, 2018): (None, None)}


def test_small_classes_have_no_statistics(spark):
    d = spark.createDataFrame([(i, 2020, 1, float(i)) for i in range(5)], "row_id bigint, year int, class_new int, x double")
    assert all(r.z is None for r in P.robust_z(d, {"x": "z"}, ["class_new", "year"], 6).collect())
    assert P.robust_z(d, {"x": "z"}, ["class_new", "year"], 5).where("row_id = 2").first().z == 0.0


def test_training_weight(spark):
    d = spark.createDataFrame([("gold", 1.0, 1.0), ("unheard of", 1.0, None), (None, 0.5, 0.0)], "tier string, q double, c double")
    r = [round(x[0], 6) for x in d.select(scalar.train_weight(F.col("tier"), F.col("q"), F.col("c"))).collect()]
    assert r == [1.0, 0.47, 0.175]


def test_partitions_do_not_change_results(spark, sf_dir):
    from landpanel.plans import base

    def rows(n):
        q = P.quality(base.panel(spark, sf_dir).repartition(n, "year"), base.points(spark, sf_dir), min_n=10, min_n_stats=10)
        return sorted(map(str, q.select("row_id", "year", "qc_reason", F.round("train_weight", 9)).collect()))

    assert rows(1) == rows(5)


def test_rows_are_kept_flagged_or_excluded(spark, sf_dir):
    from landpanel import plans

    r = plans.QUERIES["qc_summary"](spark, sf_dir).agg(F.sum("n").alias("n"), F.sum(F.col("n_keep") + F.col("n_downweight") + F.col("n_exclude") + F.col("n_persistent")).alias("m")).first()
    assert r.n == r.m > 0
