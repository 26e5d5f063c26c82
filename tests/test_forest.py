import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from landpanel.operators.forest import UNIT, bin_edges, binned, chosen_features, drawn, grow, local_forests, vote_forests, votes


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    rows = [(g, 100 * g + i, int(c), [float(x) for x in np.append(rng.normal(0, 1, 3), [c + rng.normal(0, 0.7), rng.normal(0, 1)])]) for g in range(2) for i, c in enumerate(rng.integers(0, 3, 40))]
    return spark.createDataFrame(rows, "g bigint, row_id bigint, class_new int, v array<double>")


def brute(rows, feats, least, depth):
    """Grows one tree: {node: (pred, f, bin)} from [(y, n, w, b)]."""
    made, todo = {}, [(0, rows, 0)]
    while todo:
        node, held, level = todo.pop()
        total = Counter()
        for y, _, w, _ in held:
            total[y] += w
        pred = min(total, key=lambda y: (-total[y], y))
        n_all, w_all = sum(r[1] for r in held), sum(total.values())
        best, base = None, sum(x * x for x in total.values()) / w_all
        for f in feats[node] if level < depth else []:
            for t in sorted({r[3][f] for r in held}):
                left = Counter()
                for y, _, w, b in held:
                    if b[f] <= t:
                        left[y] += w
                n, s = sum(r[1] for r in held if r[3][f] <= t), sum(left.values())
                if n < least or n_all - n < least or s == w_all:
                    continue
                p = sum(x * x for x in left.values()) / s + sum((total[y] - left[y]) ** 2 for y in total) / (w_all - s)
                if p > base * (1 + 1e-9) and (best is None or (-p, f, t) < best):
                    best = (-p, f, t)
        made[node] = (pred, best and best[1], best and best[2])
        if best:
            _, f, t = best
            todo += [(2 * node + 1, [r for r in held if r[3][f] <= t], level + 1), (2 * node + 2, [r for r in held if r[3][f] > t], level + 1)]
    return made


@pytest.mark.parametrize("depth", [2, 20])
def test_forests_equal_brute_force_trees(spark, sample, depth):
    b = binned(sample, bin_edges(sample, 8)).cache()
    trees, least = 3, 2
    model = {(r.g, r.tree, r.node): (r.pred, r.f, r.bin) for r in grow(b, ["g"], trees, depth, least).collect()}
    tree = F.explode(F.array(*map(F.lit, range(trees)))).alias("tree")
    draws = b.select("g", "row_id", "class_new", "b", tree).withColumn("n", drawn(42, "g", "row_id", "tree")).collect()
    nodes = spark.range(0, 5000).select(F.col("id").alias("node"), tree).crossJoin(spark.createDataFrame([(0,), (1,)], "g bigint"))
    feats = defaultdict(dict)
    for r in nodes.withColumn("f", chosen_features(5, 2, 42, "g", "tree", "node")).collect():
        feats[r.g, r.tree][r.node] = r.f
    want = {}
    for g in range(2):
        for t in range(trees):
            rows = [(r.class_new, r.n, r.n * UNIT, r.b) for r in draws if (r.g, r.tree) == (g, t) and r.n]
            made = brute(rows, defaultdict(list, feats[g, t]), least, depth)
            assert max(made) < 5000
            want |= {(g, t, node): x for node, x in made.items()}
    assert model == want and len(model) > 12


def test_all_groups_vote_as_their_own_trees(spark, sample):
    edges = bin_edges(sample, 8)
    b = binned(sample, edges).cache()
    model = grow(b, ["g"], 5)
    down = {(r.g, r.tree, r.node): r for r in model.collect()}
    got = {(r.g, r.row_id): (r.pred, r.share) for r in votes(model, b, ["g"], ["row_id"], 5).collect()}
    for r in b.collect():
        n = Counter()
        for t in range(5):
            at = down[r.g, t, 0]
            while at.f is not None:
                at = down[r.g, t, 2 * at.node + 1 + (r.b[at.f] > at.bin)]
            n[at.pred] += 1
        pred = min(n, key=lambda y: (-n[y], y))
        assert got[r.g, r.row_id] == (pred, n[pred] / 5)
    right = sum(got[r.g, r.row_id][0] == r.class_new for r in b.collect())
    assert right > 0.8 * len(got)


def test_feature_choice_and_bootstrap(spark):
    r = spark.range(4000).select(F.size(F.array_distinct(chosen_features(64, 8, 1, "id"))).alias("m"), drawn(3, "id").alias("n")).agg(F.min("m"), F.max("m"), F.avg("n"), F.avg((F.col("n") == 0).cast("int"))).first()
    assert r[0] == r[1] == 8 and abs(r[2] - 1) < 0.06 and abs(r[3] - math.exp(-1)) < 0.03


def test_empty_groups_and_one_class(spark, sample):
    assert local_forests(sample, sample.limit(0), ["g"]).count() == 0
    one = sample.where("class_new = 1")
    assert {r.pred for r in local_forests(sample.where("g = 0"), one.where("g = 0"), ["g"], trees=4).collect()} == {1}
    assert local_forests(sample.where("g = 1"), one.where("g = 0"), ["g"], trees=4).count() == 0


@pytest.mark.parametrize("most", [200_000, 12])
@pytest.mark.parametrize("depth", [3, 20])
def test_units_of_few_rows_vote_as_the_whole_forest(spark, sample, depth, most):
    b = binned(sample.withColumn("c", 0.5 + F.col("row_id") % 3), bin_edges(sample, 8)).cache()
    args = {"trees": 7, "depth": depth, "weight": "c"}
    want = votes(grow(b, ["g"], **args), b, ["g"], ["row_id"], 7).collect()
    got = vote_forests(b, b, ["g"], ["row_id"], most=most, **args).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 80
    soft = vote_forests(b, b, ["g"], ["row_id"], most=most, soft=True, **args)
    assert soft.join(b, ["g", "row_id"]).where("pred = class_new").count() > 60


def test_bins_are_the_edges_below_a_value(spark):
    rows = [(1, [0.0, -1.0]), (2, [0.5, 2.0]), (3, [None, float("inf")]), (4, [float("nan"), 0.25]), (5, None), (6, []), (7, [3.0])]
    d = spark.createDataFrame(rows, "row_id int, v array<double>").repartition(3)
    edges = spark.createDataFrame([([[0.0, 0.5, 1.0], [0.0, 0.25]],)], "edges array<array<double>>")
    got = {r.row_id: r.b for r in binned(d, edges).collect()}
    assert got == {1: [0, 0], 2: [1, 2], 3: [0, 2], 4: [3, 1], 5: None, 6: [], 7: [3]}


def test_held_out_rows_are_dealt_to_all_cores(spark, sample, monkeypatch):
    from landpanel.operators import model

    parts, cut = [], model.cut
    monkeypatch.setattr(model, "cut", lambda d: parts.append(d.rdd.getNumPartitions()) or cut(d))
    d = sample.withColumn("train_weight", F.lit(1.0)).coalesce(1)  # one block of one file
    assert model.rf_eval(d, d, trees=2, depth=3, by=["g"]).count() == 80
    assert min(parts[:2]) == 4 * spark.sparkContext.defaultParallelism
