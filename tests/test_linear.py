import numpy as np
import pytest
from pyspark.sql import functions as F

from landpanel.operators import linear


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(12)
    mix = rng.normal(0, 1, (6, 6))
    rows = [(i, int(c), [float(x) for x in (rng.normal(0, 1, 6) + 1.1 * np.eye(6)[c]) @ mix]) for i, c in enumerate(rng.choice(4, 400, p=[0.4, 0.3, 0.2, 0.1]))]
    return spark.createDataFrame(rows, "row_id bigint, class_new int, v array<double>").repartition(5).cache()


def closed_form(x, y):
    """Weights and offsets of the textbook discriminants, by two passes over the rows."""
    classes = sorted(set(y.tolist()))
    means = np.array([x[y == c].mean(0) for c in classes])
    cov = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in zip(classes, means, strict=True)) / (len(x) - len(classes))
    w = np.linalg.inv(cov + 1e-6 * np.trace(cov) / len(cov) * np.eye(len(cov))) @ means.T
    return classes, cov, w, np.log([np.mean(y == c) for c in classes]) - 0.5 * np.einsum("cd,dc->c", means, w)


def test_each_fold_equals_the_closed_form(spark, clouds):
    rows = clouds.orderBy("row_id").collect()
    x, y, f = np.array([r.v for r in rows]), np.array([r.class_new for r in rows]), np.array([r.row_id % 5 for r in rows])
    got = {r.row_id: r.pred for r in linear.cross_predicted(clouds, "class_new", F.col("row_id") % 5).collect()}
    want, accuracy = {}, []
    for k in range(5):
        classes, _, w, b = closed_form(x[f != k], y[f != k])
        pred = np.array(classes)[np.argmax(x[f == k] @ w + b, axis=1)]
        want |= dict(zip(np.flatnonzero(f == k).tolist(), pred.tolist(), strict=True))
        accuracy.append(np.mean([np.mean(pred[y[f == k] == c] == c) for c in sorted(set(y[f == k]))]))
    assert got == want
    told = {r.fold: (r.n, r.bal_acc) for r in linear.separability(clouds, fold=F.col("row_id") % 5).collect()}
    assert told == {k: (80, pytest.approx(a)) for k, a in enumerate(accuracy)} and min(accuracy) > 0.4


def test_covariance_comes_from_one_pass_of_sums(clouds):
    rows = clouds.collect()
    want = closed_form(np.array([r.v for r in rows]), np.array([r.class_new for r in rows]))[1]
    got = linear.pooled_covariance(clouds).collect()
    assert len(got) == 36 and all(r.cov == pytest.approx(want[r.i, r.j], rel=1e-9, abs=1e-9) for r in got)
    m = linear.moments(clouds, "class_new", F.col("row_id") % 3)
    assert m.count() == 3 * (4 + 6) and m.where("cls IS NOT NULL").agg(F.sum("n")).first()[0] == 400


def test_rows_without_label_or_finite_vector_take_no_part(spark, clouds):
    odd = clouds.unionByName(spark.createDataFrame([(-1, None, [9.0] * 6), (-2, 1, [float("nan")] * 6), (-3, 1, None), (-4, 2, [])], clouds.schema))
    assert sorted(map(tuple, linear.pooled_covariance(odd).collect()))[:3] == [(r.i, r.j, pytest.approx(r.cov)) for r in sorted(linear.pooled_covariance(clouds).collect())[:3]]
    assert linear.pooled_covariance(clouds.limit(0)).count() == 0 and linear.separability(clouds.limit(0)).count() == 0
