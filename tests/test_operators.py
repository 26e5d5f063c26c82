import math
import random

import pytest
from pyspark.sql import functions as F

from landpanel.functions import geo
from landpanel.operators import clean, evaluate, joins, sampling, spatial, textlog
from landpanel.sources import io


def test_albers_published_example(spark):
    n, c, rho0 = geo.albers_constants()
    assert (round(n, 10), round(c, 10), round(rho0, 2)) == (0.5771090015, 1.3072918527, 8788569.32)
    d = spark.createDataFrame([(116.4, 39.9), (90.0, 30.0)], "lon double, lat double")
    assert [r[0] for r in d.select(geo.point_block(F.col("lon"), F.col("lat"))).collect()] == [4100020, -5400024]


def test_metrics_of_a_small_matrix(spark):
    cm = spark.createDataFrame([(1, 1, 8), (1, 2, 2), (2, 2, 5), (2, 1, 5), (3, 1, 1), (2, 9, 1)], "truth int, pred int, n bigint")
    m = evaluate.metrics(cm).first()
    assert (m.n, m.n_classes_scored) == (22, 3)
    assert math.isclose(m.oa, 13 / 22)
    assert math.isclose(m.macro_f1, (16 / 24 + 10 / 18 + 0) / 3)  # class 3 has support and no hit: 0; class 9 has no support
    assert math.isclose(m.macro_ua, (8 / 14 + 5 / 7) / 2)  # class 3 is never predicted: no value


def test_olofsson_with_an_empty_stratum(spark):
    cm = spark.createDataFrame([(1, 1, 8), (2, 1, 2), (2, 2, 10), (3, 2, 0)], "truth int, pred int, n bigint")
    prior = spark.createDataFrame([(1, 0.2), (2, 0.2), (3, 0.1), (7, 0.5)], "class int, share double")
    r = {x["class"]: x for x in evaluate.olofsson(cm, prior).collect()}
    assert math.isclose(r[1].est, 0.4 * 0.8)
    assert math.isclose(r[1].se, math.sqrt(0.16 * 0.8 * 0.2 / 9))
    assert r[3].est == 0 and r[3].lo == 0


def test_auc_with_ties(spark):
    d = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "score double, label int")
    assert evaluate.auc(d).first().auc == 0.875


def test_vote_prefers_the_smallest_code(spark):
    d = spark.createDataFrame([(3, 2, None), (3, 3, 1), (None, None, None)], "a int, b int, c int")
    assert [r[0] for r in d.select(evaluate.vote(["a", "b", "c"])).collect()] == [2, 3, None]


def test_a_mapping_that_merges_codes_is_refused(spark):
    cm = spark.createDataFrame([(1, 1, 1)], "truth int, pred int, n bigint")
    with pytest.raises(ValueError):
        evaluate.remap_crosstab(cm, spark.createDataFrame([(1, 5), (2, 5)], "old int, new int"))


def test_thinning_equals_a_greedy_pass(spark):
    rows = [(i, 100 + (i * 37 % 50) / 1000, 30 + (i * 61 % 50) / 1000) for i in range(120)]
    d = spark.createDataFrame(rows, "row_id bigint, lon double, lat double")
    kept = {r.row_id for r in spatial.thin(d, 1.0).collect()}

    def km(a, b):
        x = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * geo.EARTH_KM * math.asin(math.sqrt(x))

    greedy = []
    for r in sorted(rows, key=lambda r: (r[0] % 2147483647 * 2654435761 % 2147483647, r[0])):
        if all(km(r, g) > 1.0 for g in greedy):
            greedy.append(r)
    assert kept == {g[0] for g in greedy}


def test_points_on_cell_edges_are_not_lost(spark):
    a = spark.createDataFrame([(1, 100.0, 30.0), (2, 0.0, 84.9)], "a_id bigint, lon double, lat double")
    b = spark.createDataFrame([(9, 100.0, 30.0), (8, 0.4, 84.9)], "b_id bigint, lon double, lat double")
    assert {(r.a_id, r.b_id) for r in joins.within_km(a, b, 5.0).collect()} == {(1, 9), (2, 8)}
    assert joins.nearest(a, b).count() == 2


def test_quota_meets_its_total_and_caps(spark):
    g = spark.createDataFrame([("a", 10, 3), ("b", 10, 50), ("c", 1, 50)], "grp string, weight bigint, cap bigint")
    r = {x.grp: x.quota for x in sampling.allocate_quota(g, 20, "weight", "cap").collect()}
    assert sum(r.values()) == 20 and r["a"] == 3


def test_ids_are_dense_and_ordered(spark):
    d = clean.assign_ids(spark.range(0, 1000).select((F.lit(5000) - F.col("id")).alias("k")).repartition(7), ["k"], ranges=8)
    rows = sorted((r.new_id, r.k) for r in d.collect())
    assert [r[0] for r in rows] == list(range(1000)) and [r[1] for r in rows] == sorted(r[1] for r in rows)


def test_replay_warns_and_skips(spark):
    e = [("f", 1, "write", "abc abc", None, None, True), ("f", 2, "edit", None, "b", "X", True), ("f", 3, "edit", None, "zz", "y", True), ("f", 4, "write", "no", None, None, False), ("g", 1, "edit", None, "a", "b", True)]
    d = spark.createDataFrame(e, "path string, ts int, op string, content string, old string, new string, ok boolean")
    r = {x.path: (x.final, x.n_write, x.n_edit, x.n_warn) for x in textlog.replay_log(d).collect()}
    assert r == {"f": ("aXc abc", 1, 1, 1), "g": (None, 0, 0, 1)}


def test_tolerant_scan_lists_broken_files(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    (tmp_path / "t" / "bad.parquet").write_bytes(b"this is no parquet file")
    rows, bad = io.scan_tolerant(spark, str(tmp_path / "t"), schema=spark.range(1).schema)
    assert rows.count() == 5
    assert [r.file.split("/")[-1] for r in bad.collect()] == ["bad.parquet"]


def test_export_is_idempotent_and_years_are_replaced_alone(spark, tmp_path):
    d = spark.createDataFrame([(1, 2017), (2, 2018)], "row_id int, year int")
    assert io.export_if_changed(d, str(tmp_path / "e")) and not io.export_if_changed(d, str(tmp_path / "e"))
    io.save(d, str(tmp_path / "s"))
    io.save(spark.createDataFrame([(9, 2018)], "row_id int, year int"), str(tmp_path / "s"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [(1, 2017), (9, 2018)]
    assert io.scan_year(spark, str(tmp_path / "s"), 2018).count() == 1
    with pytest.raises(ValueError):
        io.scan(spark, str(tmp_path / "e"), schema=spark.range(1).schema)


def test_csv_and_json_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, 2, 3)], "truth int, pred int, n bigint")
    io.write_csv(d, str(tmp_path / "c"))
    assert io.read_csv(spark, str(tmp_path / "c"), "truth int, pred int, n bigint").first() == d.first()
    (tmp_path / "h.json").write_text('{"block_keys":\n [1, 2, 5]}')
    assert sorted(r[0] for r in io.holdout_keys(spark, str(tmp_path / "h.json")).collect()) == [1, 2, 5]


def plain_replay(events):
    out = {}
    for path, _, op, content, old, new, ok in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if not ok:
            continue
        s = out.setdefault(path, [None, 0, 0, 0])
        if op == "write":
            s[0], s[1] = content, s[1] + 1
        elif s[0] is not None and old in s[0]:
            s[0], s[2] = s[0].replace(old, new, 1), s[2] + 1
        else:
            s[3] += 1
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("ranges", [None, 7])
def test_a_hot_key_is_replayed_by_segments(spark, ranges):
    r = random.Random(4)
    e = []
    for t in range(3000):
        path = "hot" if t % 3 == 0 else f"k{r.randrange(60)}"
        write = r.random() < 0.1
        e.append((path, t, "write" if write else "edit", "".join(r.choice("abc") for _ in range(8)) if write else None, None if write else r.choice("abcx"), None if write else r.choice("abcxy"), r.random() < 0.95))
    d = spark.createDataFrame(e, "path string, ts int, op string, content string, old string, new string, ok boolean").repartition(5)
    got = {x.path: (x.final, x.n_write, x.n_edit, x.n_warn) for x in textlog.replay_log(d, ranges=ranges).collect()}
    assert got == plain_replay(e) and got["hot"][1] > 50


def test_running_sums_by_ranges_equal_one_window(spark):
    d = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(900)).alias("k"), "id")
    rows = lambda n: sorted(map(tuple, clean.running(d, ["k", "id"], {"s": F.col("id"), "n": F.lit(1)}, n).collect()))
    assert rows(None) == rows(9) == rows(1)
