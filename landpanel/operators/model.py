"""Classifiers: class-centre models in one aggregation, forests, linear separators with Spark ML, held-out evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..sources.shared import cut
from . import evaluate
from .forest import bin_edges, binned, vote_forests
from .linear import pooled_covariance


def nearest_centroid(test: DataFrame, train: DataFrame, by: list[str] | None = None, min_n: int = 1) -> DataFrame:
    """Adds pred: the class whose centre has the largest cosine, the smaller class at a tie. Centres are labels x groups, so few."""
    by = by or []
    mean = vector_to_array(Summarizer.mean(array_to_vector("v")))
    c = train.groupBy(*by, F.col("class_new").alias("_c")).agg(F.count("*").alias("_n"), mean.alias("_m")).where(F.col("_n") >= min_n).select(*by, "_c", vec.unit("_m").alias("_m"))
    packed = c.groupBy(*by).agg(F.collect_list(F.struct("_c", "_m")).alias("_all"))  # one row a group: its classes
    j = test.join(packed, by) if by else test.join(F.broadcast(packed))
    scored = F.transform("_all", lambda x: F.struct(F.round(vec.dot("_u", x["_m"]), 9).alias("s"), (-x["_c"]).alias("c")))
    return j.withColumn("_u", vec.unit("v")).withColumn("pred", -F.array_max(scored)["c"]).drop("_all", "_u")


def holdout_split(df: DataFrame, keys: DataFrame, block: Column) -> tuple[DataFrame, DataFrame]:
    """(training rows outside the held-out blocks, rows inside)."""
    d = df.withColumn("block_key", block)
    k = keys.select("block_key").distinct()
    return d.join(k, "block_key", "left_anti"), d.join(k, "block_key", "left_semi")


def class_weights(train: DataFrame, label: str = "class_new", weight: str = "train_weight") -> DataFrame:
    """Adds w: row weight times N / (k * n_c)."""
    n = train.groupBy(label).agg(F.count("*").alias("_n"))
    s = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return train.join(F.broadcast(n), label).join(F.broadcast(s)).withColumn("w", F.col(weight) * F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def indexed(df: DataFrame, labels: Sequence[int], label: str = "class_new") -> DataFrame:
    """Adds features and a numeric label by a fixed order of classes."""
    at = F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1
    return df.withColumns({"features": array_to_vector("v"), "_y": at.cast("double")})


def fit_forest(train: DataFrame, labels: Sequence[int], trees: int = 150, seed: int = 42, depth: int = 20, weight: str = "train_weight"):
    """A forest with square-root features, leaves of 2, row weights and balanced classes; no limit on leaves exists here."""
    rows = indexed(class_weights(train, weight=weight), labels)
    rf = RandomForestClassifier(numTrees=trees, minInstancesPerNode=2, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed, weightCol="w", labelCol="_y", featuresCol="features")
    return rf.fit(rows)


def predict(model, test: DataFrame, labels: Sequence[int], out: str = "pred") -> DataFrame:
    d = model.transform(indexed(test, labels))
    return d.withColumn(out, F.get(F.array(*map(F.lit, labels)), F.col("prediction").cast("int"))).drop("features", "_y", "rawPrediction", "probability", "prediction")


def rf_eval(train: DataFrame, val: DataFrame, trees: int = 150, seed: int = 42, depth: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """val with pred, from a forest fitted on training rows with finite vectors and weights, one for each group of `by`.

    Square-root features, leaves of 2, row weights, balanced classes, and the class with the largest sum of leaf shares, as
    in `fit_forest`; but a deep forest's nodes are many, so they stay in the tasks that grow them (`forest.vote_forests`).
    Rows of groups without training rows are missing.
    """
    by, ok = list(by), F.forall("v", vec.finite)
    train = train.where(ok).withColumn("train_weight", F.when(vec.finite(F.col("train_weight")), F.col("train_weight")).otherwise(1.0))
    # balanced within each group: N / (k * n_c)
    n = train.groupBy(*by, "class_new").agg(F.count("*").alias("_n"))
    every = n.groupBy(*by).agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    n = n.join(F.broadcast(every), by) if by else n.join(F.broadcast(every))
    rows = train.join(F.broadcast(n), [*by, "class_new"]).withColumn("w", F.col("train_weight") * F.col("_all") / (F.col("_k") * F.col("_n")))  # groups x classes
    # rows are few bytes and much work, so they are dealt to all cores whatever their files and blocks
    tasks = 4 * train.sparkSession.sparkContext.defaultParallelism
    rows = cut(rows.select(*by, "row_id", "class_new", "v", "w").repartition(tasks, *by, "row_id"))
    val = cut(val.where(ok).repartition(tasks, *by, "row_id").withColumn("_id", F.monotonically_increasing_id()))
    edges = cut(bin_edges(rows, accuracy=10_000))  # 32 bins a component
    told = vote_forests(binned(rows, edges), binned(val.select(*by, "_id", "v"), edges), by, ["_id"], trees, depth, 2, seed, weight="w", soft=True)
    return val.join(told.select("_id", "pred"), "_id").drop("_id")


def spatial_eval(train: DataFrame, val: DataFrame, keys: DataFrame, block: Column, years: Sequence[int], trees: int = 150, depth: int = 20, validate_only: bool = False) -> DataFrame:
    """Predictions (row_id, year, class_new, pred, src, zone) for rows in held-out blocks; with validate_only their counts only.

    The years' forests are grown together; the edges of their bins are those of all years.
    """
    outside, inside = holdout_split(train, keys, block)[0], holdout_split(val, keys, block)[1]
    if validate_only:
        a = outside.groupBy("year").agg(F.count("*").alias("n_train"))
        return a.join(inside.groupBy("year").agg(F.count("*").alias("n_val")), "year", "full")
    asked = F.col("year").isin(*years)
    return rf_eval(outside.where(asked), inside.where(asked), trees, depth=depth, by=["year"]).select("row_id", "year", "class_new", "pred", "src", "zone")


def ensemble(train: DataFrame, val: DataFrame, seeds: Sequence[int], trees: int = 20, depth: int = 10) -> DataFrame:
    """val with pred, the majority of forests that differ by seed."""
    labels = sorted(r[0] for r in train.select("class_new").distinct().collect())
    d = val
    for s in seeds:
        d = predict(fit_forest(train, labels, trees, s, depth), d, labels, f"p{s}")
    return d.withColumn("pred", evaluate.vote([f"p{s}" for s in seeds])).drop(*(f"p{s}" for s in seeds))


def local_models(test: DataFrame, samples: DataFrame, tiles: list[str]) -> DataFrame:
    """Each tile's points are classified by centres of that tile's own borrowed sample: all tiles in one aggregation."""
    return nearest_centroid(test, samples, tiles)


def logo_eval(df: DataFrame, group: str) -> DataFrame:
    """Leave-one-group-out with centres: a group's centres without it are the sums of all rows less its own.

    Sums are one vector for each class, and for each class and group; a group's row packs its own, so no group meets
    another's.
    """
    summed = vector_to_array(Summarizer.sum(array_to_vector("v")))
    own = df.groupBy(group, F.col("class_new").alias("c")).agg(summed.alias("s"))
    total = df.groupBy(F.col("class_new").alias("c")).agg(summed.alias("t")).agg(F.collect_list(F.struct("c", "t")).alias("_total"))  # one row: the classes
    own = own.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("c", "s"))).alias("_own"))
    less = lambda x: F.when(F.map_contains_key("_own", x["c"]), F.zip_with(x["t"], F.try_element_at("_own", x["c"]), lambda p, q: p - q)).otherwise(x["t"])
    rest = own.join(F.broadcast(total)).select(group, F.transform("_total", lambda x: F.struct(x["c"], less(x).alias("m"))).alias("_rest"))
    packed = rest.select(group, F.transform(F.filter("_rest", lambda x: vec.l2norm(x["m"]) > 1e-6), lambda x: F.struct(x["c"], vec.unit(x["m"]).alias("m"))).alias("_all"))
    scored = F.transform("_all", lambda x: F.struct(F.round(vec.dot("_u", x["m"]), 9).alias("s"), (-x["c"]).alias("c")))
    return df.join(packed, group).withColumn("_u", vec.unit("v")).withColumn("pred", -F.array_max(scored)["c"]).drop("_all", "_u")


def baseline_compare(train: DataFrame, val: DataFrame) -> DataFrame:
    """(features_oa, coords_oa, gain): centres of the vectors against centres of coordinates alone."""
    a = nearest_centroid(val, train)
    xy = lambda d: d.withColumn("v", F.array(F.cos(F.radians("lat")) * F.cos(F.radians("lon")), F.cos(F.radians("lat")) * F.sin(F.radians("lon")), F.sin(F.radians("lat"))))
    b = nearest_centroid(xy(val), xy(train))
    oa = lambda d, n: d.agg(F.avg((F.col("pred") == F.col("class_new")).cast("int")).alias(n))
    j = oa(a, "features_oa").join(F.broadcast(oa(b, "coords_oa")))
    return j.withColumn("gain", F.col("features_oa") - F.col("coords_oa"))


def forest_baseline(train: DataFrame, val: DataFrame, trees: int = 150, depth: int = 20) -> DataFrame:
    """(features_oa, coords_oa, gain): the same forest on the vectors and on coordinates alone."""
    xy = lambda d: d.withColumn("v", F.array("lon", "lat"))
    oa = lambda d, n: d.agg(F.avg((F.col("pred") == F.col("class_new")).cast("int")).alias(n))
    a, b = rf_eval(train, val, trees, depth=depth), rf_eval(xy(train), xy(val), trees, depth=depth)
    return oa(a, "features_oa").join(F.broadcast(oa(b, "coords_oa"))).withColumn("gain", F.col("features_oa") - F.col("coords_oa"))


def override(first: Column, second: Column, weak: Sequence[int], hosts: Sequence[int]) -> Column:
    """The second model's class where it is a weak class and the first gave one of its hosts."""
    return F.when(first.isin(*hosts) & second.isin(*weak), second).otherwise(first)


def score_and_band(df: DataFrame, train: DataFrame, positive: int) -> DataFrame:
    """Adds score, the cosine to the positive class's centre less that to the rest, squeezed to 0..1, and its band."""
    from ..functions import scalar

    m = lambda c, n: train.where(c).agg(vec.unit(vector_to_array(Summarizer.mean(array_to_vector("v")))).alias(n))
    j = df.join(F.broadcast(m(F.col("class_new") == positive, "_p"))).join(F.broadcast(m(F.col("class_new") != positive, "_q")))
    u = vec.unit("v")
    return j.withColumn("score", 1 / (1 + F.exp(-4 * (vec.dot(u, "_p") - vec.dot(u, "_q"))))).drop("_p", "_q").withColumn("band", scalar.band(F.col("score")))


def class_means(df: DataFrame) -> DataFrame:
    return df.groupBy("class_new").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m"))


def centroid_distance(df: DataFrame, k: int = 3) -> DataFrame:
    """(a, b, distance, rank): the k nearest classes by distance of centres, whitened with the pooled covariance.

    The d x d matrix is summed on Spark; its inverse square root is taken on the driver (d is the vector's length).
    """
    import numpy as np

    spark, cells = df.sparkSession, pooled_covariance(df).collect()
    d = max(r.i for r in cells) + 1
    s = np.zeros((d, d))
    for r in cells:
        s[r.i, r.j] = r.cov
    value, vector = np.linalg.eigh(s)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-9))) @ vector.T
    w = spark.createDataFrame([(i, [float(x) for x in root[i]]) for i in range(d)], "i int, row array<double>")
    m = class_means(df).join(F.broadcast(w)).groupBy("class_new").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", vec.dot("row", "m").alias("x")))), lambda x: x["x"]).alias("m"))
    from pyspark.sql import Window

    j = m.select(F.col("class_new").alias("a"), F.col("m").alias("ma")).join(F.broadcast(m.select(F.col("class_new").alias("b"), F.col("m").alias("mb")))).where("a <> b")
    j = j.select("a", "b", vec.l2distance("ma", "mb").alias("distance"))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where(F.col("rank") <= k)


def silhouette(df: DataFrame) -> DataFrame:
    """(n, silhouette): mean of (b - a) / max(a, b) over rows, with cosine distances; a class of one counts as 0.

    The mean distance of a row to a class is 1 less its dot product with the class's mean unit vector, so classes are
    summed once and no rows are paired.
    """
    d = df.select(F.col("class_new").alias("c"), vec.unit("v").alias("u"))
    c = d.groupBy("c").agg(vector_to_array(Summarizer.sum(array_to_vector("u"))).alias("s"), F.count("*").alias("n"))
    every = c.agg(F.collect_list(F.struct("c", "s", "n")).alias("_all"))  # one row: the classes
    j = d.join(F.broadcast(every))
    own = F.get(F.filter("_all", lambda x: x["c"] == F.col("c")), F.lit(0))
    a = F.when(own["n"] > 1, 1.0 - (vec.dot("u", own["s"]) - vec.dot("u", "u")) / (own["n"] - 1))
    b = F.array_min(F.transform(F.filter("_all", lambda x: x["c"] != F.col("c")), lambda x: 1.0 - vec.dot("u", x["s"]) / x["n"]))
    s = F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return j.agg(F.count("*").alias("n"), F.avg(s).alias("silhouette"))
