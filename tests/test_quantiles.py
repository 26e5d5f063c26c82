import numpy as np
import pytest
from pyspark.sql import functions as F

from landpanel.operators import quantiles as Q
from landpanel.operators.panel import class_percentiles, robust_z

SHARES = [0.0, 0.01, 0.05, 0.5, 0.73, 0.999, 1.0]


def spread(kind, n, seed):
    rng = np.random.default_rng(seed)
    return {
        "even": lambda: rng.uniform(-5, 5, n), "heavy": lambda: rng.standard_cauchy(n) * 10.0 ** rng.integers(-200, 200, n), "ties": lambda: np.where(rng.random(n) < 0.9, 5.0, rng.uniform(5, 6, n)),
        "two": lambda: np.repeat([1.0, 2.0], [n // 2, n - n // 2]), "one": lambda: np.full(n, -3.5), "ends": lambda: np.concatenate([np.full(n // 3, -np.inf), rng.normal(0, 1, n - 2 * (n // 3)), np.full(n // 3, np.inf)]),
        "steps": lambda: np.floor(rng.exponential(3, n)),
    }[kind]()


@pytest.mark.parametrize("most", [40, 1000, 10**6])
def test_equal_to_the_sorted_values(spark, most):
    kinds, n = ["even", "heavy", "ties", "two", "one", "ends", "steps"], 6001
    rows = [(k if k != "steps" else None, float(x)) for i, k in enumerate(kinds) for x in spread(k, n, i)] + [("even", None), ("even", float("nan")), ("void", None), ("small", 4.0), ("small", 8.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5).cache()
    got = {r.g: r for r in Q.quantiles(df, ["g"], {"x": ("x", SHARES)}, most).collect()}
    assert set(got) == {*kinds[:-1], None, "void", "small"} and got["void"].n_x == 0 and got["void"].p_x is None and got["small"].n_x == 2
    for i, k in enumerate(kinds):
        xs = np.sort(spread(k, n, i))
        with np.errstate(invalid="ignore"):
            want = [xs[int(np.floor(s * (n - 1)))] if float(s * (n - 1)).is_integer() else None for s in SHARES]
        r = got[k if k != "steps" else None]
        assert r.n_x == n
        for s, w, v in zip(SHARES, want, r.p_x, strict=True):
            lo = int(np.floor(s * (n - 1)))
            if w is None:
                part = s * (n - 1) - lo
                w = xs[lo] if xs[lo] == xs[lo + 1] else xs[lo] * (lo + 1 - s * (n - 1)) + xs[lo + 1] * part
            assert v == w or abs(v - w) <= 1e-12 * abs(w), (k, s)


def test_several_columns_and_no_groups(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), F.col("id").cast("double").alias("x"), F.when(F.col("id") < 30, F.col("id")).alias("y"))
    got = Q.quantiles(df, [], {"x": ("x", [0.5, 0.25]), "y": (F.col("y") * 2, [0.5])}, 64).collect()
    assert len(got) == 1 and got[0].n_x == 5000 and got[0].p_x == [2499.5, 1249.75] and got[0].n_y == 30 and got[0].p_y == [29.0]
    none = Q.quantiles(df.limit(0), [], {"x": ("x", [0.5])}, 64).collect()
    assert none[0].n_x == 0 and none[0].p_x is None and Q.quantiles(df.limit(0), ["a"], {"x": ("x", [0.5])}, 64).count() == 0


def test_panel_statistics_do_not_depend_on_the_bound(spark):
    df = spark.range(6000).select((F.col("id") % 3).cast("int").alias("class_new"), F.lit(2020).alias("year"), F.col("id").alias("row_id"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("x")).cache()
    seen = []
    for most in (50, 10**6):
        z = robust_z(df, {"x": "z"}, ["class_new", "year"], most=most).agg(F.round(F.sum(F.abs("z")), 6), F.count("z")).first()
        p = class_percentiles(df, "x", most=most).orderBy("class_new").collect()
        seen.append((z, p))
    assert seen[0] == seen[1]


def test_sketches_are_merged(spark):
    df = spark.range(40_000).select((F.col("id") % 10).alias("day"), (F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("double").alias("x"))
    parts = Q.sketches(df, ["day", "g"], "x")
    got = Q.estimated(Q.merged(parts, ["g"]), [0.01, 0.5, 0.99]).collect()
    assert [r.n for r in got] == [20_000, 20_000]
    for r in got:
        assert all(abs(v / 10_000 - s) < 0.02 for v, s in zip(r.p, (0.01, 0.5, 0.99), strict=True))
    near = class_percentiles(df.withColumnsRenamed({"g": "class_new", "day": "year"}), "x", approx=True).collect()
    assert len(near) == 10 and all(abs(r.p05 - 500) < 150 for r in near)
