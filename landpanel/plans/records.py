"""Queries of key joins, cleaning, ledgers, gates and change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import clean, diag, evaluate, joins, textlog
from ..sources import io, shared
from ..sources.io import table
from ..streaming import ledger, streams
from .base import POINTS, PREDICTIONS, SEEDED, points, predictions, query, rounded


@query("SELECT o_orderkey AS row_id, o_orderpriority AS p FROM orders")
def s1_scan(spark, sf_dir):
    return io.scan(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_orderpriority"]).select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("p"))


@query("SELECT count(*) AS n, round(sum(l_quantity), 4) AS q FROM lineitem WHERE year(l_shipdate) = 1995")
def s2_scan_year(spark, sf_dir):
    d = io.scan_between(spark, f"{sf_dir}/lineitem.parquet", "l_shipdate", "1995-01-01", "1996-01-01", ["l_quantity"])
    return rounded(d.agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")), "q", digits=4)


@query("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n, round(sum(o_totalprice), 2) AS price, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders WHERE year(o_orderdate) IN (1996, 1999) GROUP BY 1")
def s2_scan_index(spark, sf_dir):
    """Chunk files of two or three years each; an index names those that hold the years asked for."""
    at, y = shared.place(spark, "chunks"), F.year("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", y.cast("int").alias("year"))
    chunk = F.floor((F.col("year") - 1995 + F.pmod("o_orderkey", F.lit(2))) / 2).cast("int")
    o.withColumn("chunk_id", chunk).repartition("chunk_id").write.partitionBy("chunk_id").parquet(at)
    io.build_index(spark, at, f"{at}.index", key="o_orderkey")
    d = io.scan_indexed(spark, at, f"{at}.index", [1996, 1999], key="o_orderkey")
    return rounded(d.groupBy("year").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("price"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")), "price", digits=2)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value, 6) END AS value FROM events")
def s8_sanitize(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, float("inf")).otherwise(F.col("value")).alias("value"))
    return rounded(io.sanitize(d), "value")


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, 1::BIGINT AS n_skipped FROM orders")
def s3_scan_tolerant(spark, sf_dir):
    """A copy of the orders beside a file that is no Parquet: all rows are read, the file is named."""
    at, o = shared.place(spark, "tolerant"), table(spark, sf_dir, "orders").select("o_orderkey")
    o.write.parquet(f"{at}/good")
    o.limit(1).select(F.lit("no table").alias("value")).write.text(f"{at}/bad")
    rows, skipped = io.scan_tolerant(spark, at, pattern="part-*", schema=o.schema)
    return rows.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).join(F.broadcast(skipped.agg(F.count("*").alias("n_skipped"))))


@query(f"WITH {PREDICTIONS} SELECT truth, pred, count(*) AS n FROM predictions GROUP BY ALL")
def s5_matrix_csv(spark, sf_dir):
    """The confusion matrix written as CSV and read again."""
    at = shared.place(spark, "matrix")
    io.write_csv(evaluate.confusion(predictions(spark, sf_dir)), at)
    return io.read_csv(spark, at, "truth int, pred int, n bigint")


@query("SELECT true AS first, false AS again, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders")
def s9_export_once(spark, sf_dir):
    """Exported the first time, left alone the second."""
    at, o = shared.place(spark, "export"), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    first, again = io.export_if_changed(o, at), io.export_if_changed(o, at)
    return spark.read.parquet(at).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).select(F.lit(first).alias("first"), F.lit(again).alias("again"), "n", "keys")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS n_first, (SELECT count(*) FROM orders) AS n_second, (SELECT count(*) FROM orders) AS n_third, sum(o_orderkey)::BIGINT AS keys FROM orders")
def x1_copy_new(spark, sf_dir):
    """Files that arrive in two lots: each is copied once, and a third look copies nothing."""
    at, o = shared.place(spark, "arrivals"), table(spark, sf_dir, "orders").select("o_orderkey")
    n = []
    for lot in ("o_orderkey % 3 <> 0", "o_orderkey % 3 = 0", None):
        if lot:
            o.where(lot).write.mode("append").parquet(f"{at}/in")
        n.append(streams.copy_new(spark, f"{at}/in", f"{at}/out", f"{at}/progress", o.schema))
    counts = [F.lit(x).cast("bigint").alias(name) for x, name in zip(n, ("n_first", "n_second", "n_third"), strict=True)]
    return spark.read.parquet(f"{at}/out").agg(F.sum("o_orderkey").alias("keys")).select(*counts, "keys")


@query(f"WITH {PREDICTIONS} SELECT year, count(*) AS n, count(*) FILTER (truth = pred) AS hits, count(DISTINCT zone) AS zones FROM predictions GROUP BY year")
def m12_prediction_sink(spark, sf_dir):
    """Predictions written by year, one year written again, and read back."""
    at, p = shared.place(spark, "predictions"), predictions(spark, sf_dir).withColumnRenamed("truth", "class_new")
    io.save_predictions(p, at)
    io.save_predictions(p.where("year = 2020"), at)
    return io.scan(spark, at).groupBy("year").agg(F.count("*").alias("n"), F.count_if(F.col("class_new") == F.col("pred")).alias("hits"), F.count_distinct("zone").alias("zones"))


@query("SELECT (l_orderkey % 8)::INTEGER AS shard, count(*) AS n FROM lineitem GROUP BY 1")
def s11_shard(spark, sf_dir):
    return io.shard(table(spark, sf_dir, "lineitem"), 8, "l_orderkey").groupBy("shard").agg(F.count("*").alias("n"))


@query()
def s10_file_manifest(spark, sf_dir):
    return io.file_manifest(spark, sf_dir, "*.parquet", heavy=None).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "bytes", "md5", "sha256")


@query("""SELECT '{"l_returnflag":"' || l_returnflag || '","n":' || count(*) || '}' AS value FROM lineitem GROUP BY l_returnflag""")
def s6_report_json(spark, sf_dir):
    return io.report_json(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")))


LIB = f"{POINTS}, pool AS (SELECT row_id AS pool_id, CASE WHEN row_id % 23 = 0 THEN lon + 0.5::DOUBLE ELSE lon END AS lon, lat FROM points WHERE row_id % 2 = 0)"


@query(f"WITH {LIB}, l AS (SELECT lon, lat, min(row_id) AS row_id FROM points GROUP BY ALL) SELECT pool_id, l.row_id, l.row_id IS NOT NULL AS matched FROM pool LEFT JOIN l USING (lon, lat)")
def j2_recover_ids(spark, sf_dir):
    p = points(spark, sf_dir)
    pool = p.where("row_id % 2 = 0").select(F.col("row_id").alias("pool_id"), F.when(F.col("row_id") % 23 == 0, F.col("lon") + 0.5).otherwise(F.col("lon")).alias("lon"), "lat")
    return joins.recover_ids(pool, p.select("row_id", "lon", "lat")).select("pool_id", "row_id", "matched")


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def j3_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    d = joins.lookup(joins.lookup(o, c, ["o_custkey"]), n.unionByName(n), ["n_nationkey"])
    return rounded(d.groupBy("n_name").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("price")), "price", digits=2)


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS n_with, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n_without")
def j5_semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").agg(F.count("*").alias("n_with")).join(F.broadcast(c.join(o, "c_custkey", "left_anti").agg(F.count("*").alias("n_without"))))


@query("SELECT count(*) AS n, count(*) FILTER (o_orderkey % 10 = 0 OR o_orderkey % 7 = 0) AS n_mismatch FROM orders")
def j7_assert_aligned(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("lon"))
    b = o.where("row_id % 10 <> 0").withColumn("lon", F.when(F.col("row_id") % 7 == 0, F.col("lon") + 1).otherwise(F.col("lon")))
    return joins.assert_aligned(o, b)


EX = f"{POINTS}, ids AS (SELECT row_id FROM points WHERE row_id % 7 = 0), xy AS (SELECT lon, lat FROM points WHERE row_id % 11 = 0)"


@query(f"WITH {EX} SELECT count(*) AS n, count(*) FILTER (row_id IN (SELECT row_id FROM ids)) AS n_by_id, count(*) FILTER ((lon, lat) IN (SELECT (lon, lat) FROM xy)) AS n_by_coord, count(*) FILTER (row_id NOT IN (SELECT row_id FROM ids) AND (lon, lat) NOT IN (SELECT (lon, lat) FROM xy)) AS n_left FROM points")
def j8_exclude(spark, sf_dir):
    p = points(spark, sf_dir).select("row_id", "lon", "lat")
    return clean.exclusion_counts(p, p.where("row_id % 7 = 0"), p.where("row_id % 11 = 0"))


@query("SELECT l.ns, count(*) AS n, sum(r.x)::BIGINT AS s FROM (SELECT 'o' AS ns, o_orderkey AS row_id FROM orders UNION ALL SELECT 'c', c_custkey FROM customer) l JOIN (SELECT 'o' AS ns, o_orderkey AS row_id, o_custkey AS x FROM orders UNION ALL SELECT 'c', c_custkey, c_nationkey FROM customer) r USING (ns, row_id) GROUP BY l.ns")
def j9_ns_join(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    a = o.select(F.lit("o").alias("ns"), F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("x")).unionByName(c.select(F.lit("c").alias("ns"), F.col("c_custkey").alias("row_id"), F.col("c_nationkey").cast("bigint").alias("x")))
    return joins.ns_join(a.drop("x"), a).groupBy("ns").agg(F.count("*").alias("n"), F.sum("x").alias("s"))


@query("WITH b AS (SELECT o_orderkey, o_totalprice + (CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 0 END) AS p, o_custkey AS c FROM orders WHERE o_orderkey % 9 <> 0) SELECT x.c AS \"column\", n_both, n_left_only, 0::BIGINT AS n_right_only, d::DOUBLE AS max_abs_diff FROM (SELECT count(*) FILTER (b.o_orderkey IS NOT NULL) AS n_both, count(*) FILTER (b.o_orderkey IS NULL) AS n_left_only, round(max(abs(o_totalprice - p)), 6) AS d1, max(abs(o_custkey - c))::DOUBLE AS d2 FROM orders a LEFT JOIN b USING (o_orderkey)), LATERAL (VALUES ('o_totalprice', d1), ('o_custkey', d2)) x(c, d)")
def j15_table_diff(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    b = a.where("o_orderkey % 9 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 5 == 0, 2.0).otherwise(0.0))
    return rounded(joins.table_diff(a, b, ["o_orderkey"], ["o_totalprice", "o_custkey"]), "max_abs_diff")


@query("WITH l AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'click' GROUP BY 1), n AS (SELECT user_id, max(struct_pack(t := ts, v := event_id)) AS b FROM events JOIN l USING (user_id) WHERE event_type <> 'click' AND ts > last GROUP BY 1) SELECT user_id, last, b.t AS newest_ts, b.v AS newest FROM l LEFT JOIN n USING (user_id)")
def j17_newest_after(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return joins.newest_after(e.where("event_type = 'click'"), e.where("event_type <> 'click'"), "user_id", "ts", "event_id")


BAT = f"""{POINTS}, clim AS (SELECT row_id, (41 + class_new % 6)::INTEGER AS class_new, province AS region, ((row_id * 13) % 600 - 300) / 10.0::DOUBLE AS bio06, ((row_id * 17) % 400 - 100) / 10.0::DOUBLE AS bio01, CASE WHEN row_id % 19 <> 0 THEN ((row_id * 29) % 6000)::DOUBLE END AS elev FROM points),
hits AS (SELECT row_id, region, list_filter([CASE WHEN class_new = 43 AND bio06 < -20 THEN 'R1' END, CASE WHEN class_new = 43 AND bio01 < 0 THEN 'R2' END, CASE WHEN class_new = 42 AND bio01 > 22 THEN 'R3' END, CASE WHEN class_new IN (41, 43) AND bio01 < -5 THEN 'R4' END, CASE WHEN class_new = 46 AND bio01 > 15 THEN 'R5' END, CASE WHEN elev > 4500 AND class_new BETWEEN 43 AND 46 THEN 'R6' END, CASE WHEN elev IS NULL THEN 'R7' END], lambda x: x IS NOT NULL) AS hits FROM clim)"""


def climate(spark, sf_dir):
    k = F.col("row_id")
    d = points(spark, sf_dir).select(k, (F.lit(41) + F.col("class_new") % 6).alias("class_new"), F.col("province").alias("region"), ((k * 13) % 600 - 300).alias("b6"), ((k * 17) % 400 - 100).alias("b1"), F.when(k % 19 != 0, ((k * 29) % 6000)).alias("elev"))
    return d.select("row_id", "class_new", "region", scalar.decode_scaled(F.col("b6")).alias("bio06"), scalar.decode_scaled(F.col("b1")).alias("bio01"), "elev")


@query(f"WITH {BAT}, e AS (SELECT unnest(hits) AS rule, len(hits) > 1 AS more FROM hits) SELECT rule, count(*) AS n, count(*) FILTER (more) AS n_overlap FROM e GROUP BY rule")
def f13_rule_battery(spark, sf_dir):
    return clean.rule_counts(clean.apply_rules(climate(spark, sf_dir), clean.BATTERY))


@query(f"WITH {BAT} SELECT row_id, array_to_string(list_filter(hits, lambda r: r <> 'R4' OR coalesce(region IN ('p1', 'p2'), false)), ',') AS hits FROM hits")
def f14_scoped_rules(spark, sf_dir):
    scope = spark.createDataFrame([("R4", "p1"), ("R4", "p2")], "rule string, region string")
    return clean.apply_rules(climate(spark, sf_dir), clean.BATTERY, scope).select("row_id", F.array_join("hits", ",").alias("hits"))


@query("SELECT CASE WHEN lower(props) LIKE '%mobile%' THEN 'mobile' WHEN event_type LIKE '%click%' THEN 'click' ELSE 'other' END AS layer, count(*) AS n FROM events GROUP BY 1")
def f11_classify_text(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.concat_ws(" ", "event_type", "props"))
    rules = [(F.lower(F.col("props")).contains("mobile"), "mobile"), (scalar.classify_text(F.col("event_type"), [(["click"], "hit")], "") == "hit", "click")]
    return e.groupBy(scalar.ladder(rules, "other").alias("layer")).agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT arm, class_new, count(*) AS n FROM (SELECT 'R0' AS arm, class_new FROM points UNION ALL SELECT 'R4', class_new FROM points WHERE src <> 's2' UNION ALL SELECT 'R6', CASE WHEN src = 's2' THEN 99 ELSE class_new END FROM points UNION ALL SELECT 'R7', class_new FROM points WHERE src = 's2') GROUP BY ALL")
def f12_source_policy(spark, sf_dir):
    return clean.apply_source_policy(points(spark, sf_dir).drop("v"), "s2", 99).groupBy("arm", "class_new").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT count(*) AS n, count(*) FILTER (row_id % 3 = 0) AS n_a, count(*) FILTER (row_id % 4 = 0) AS n_b, sum((CASE WHEN row_id % 3 = 0 THEN row_id ELSE -1 END) + (CASE WHEN row_id % 4 = 0 THEN 1 ELSE -1 END))::BIGINT AS s FROM points")
def f17_combine_sources(spark, sf_dir):
    p = points(spark, sf_dir).select("row_id")
    d = clean.combine_sources(p, {"a": p.where("row_id % 3 = 0").withColumn("value", F.col("row_id")), "b": p.where("row_id % 4 = 0").withColumn("value", F.lit(1))}, "row_id")
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("row_id") % 3 == 0).alias("n_a"), F.count_if(F.col("b") == 1).alias("n_b"), F.sum(F.col("a") + F.col("b")).alias("s"))


@query(f"WITH {POINTS}, a AS (SELECT (row_id * 41) % 1000 - 100 AS a FROM points) SELECT CASE WHEN a > 478 THEN 'deciduous' WHEN a < 178 THEN 'evergreen' ELSE 'undecided' END AS type, count(*) AS n FROM a GROUP BY 1")
def f18_type_by_amplitude(spark, sf_dir):
    s = F.pmod(F.col("row_id") * 41, F.lit(1000))
    return points(spark, sf_dir).groupBy(scalar.type_by_amplitude(s, F.lit(100)).alias("type")).agg(F.count("*").alias("n"))


@query(f"WITH {POINTS}, e AS (SELECT row_id, CASE WHEN row_id % 13 <> 0 THEN class_new END AS l1, CASE WHEN row_id % 13 <> 0 AND row_id % 7 <> 0 THEN (class_new + (row_id % 3 = 0)::INTEGER) END AS l2, (class_new + (row_id % 6 = 0)::INTEGER) AS au, row_id % 5 = 0 AS doubt, row_id % 8 = 0 AS soft, row_id % 29 = 0 AS hard FROM points), t AS (SELECT *, CASE WHEN hard OR (l1 IS NULL AND l2 IS NULL) THEN 'D' WHEN l1 = l2 AND NOT doubt AND NOT soft THEN 'A' WHEN l1 = l2 THEN 'B' WHEN au = l1 OR au = l2 THEN 'B' ELSE 'C' END AS tier FROM e) SELECT tier, count(*) AS n FROM t GROUP BY tier")
def f20_fuse_evidence(spark, sf_dir):
    k, c = F.col("row_id"), F.col("class_new")
    d = points(spark, sf_dir).select(k, F.when(k % 13 != 0, c).alias("l1"), F.when((k % 13 != 0) & (k % 7 != 0), c + (k % 3 == 0).cast("int")).alias("l2"), (c + (k % 6 == 0).cast("int")).alias("authority"), (k % 5 == 0).alias("doubt"), (k % 8 == 0).alias("soft"), (k % 29 == 0).alias("hard"))
    return clean.fuse_evidence(d).groupBy("tier").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS}, w AS (SELECT DISTINCT class_new, province FROM points WHERE row_id % 3 = 0 AND province IS NOT NULL) SELECT p.row_id FROM points p WHERE class_new IN (SELECT class_new FROM w) AND NOT EXISTS (SELECT 1 FROM w WHERE w.class_new = p.class_new AND w.province = p.province)")
def f7_whitelist_violations(spark, sf_dir):
    p = points(spark, sf_dir).select("row_id", "class_new", "province")
    return clean.whitelist_violations(p, p.where("row_id % 3 = 0 AND province IS NOT NULL").select("class_new", F.col("province").alias("region")).distinct()).select("row_id")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def w3_dedup(spark, sf_dir):
    return clean.dedup(table(spark, sf_dir, "lineitem"), ["l_partkey"], [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS new_id FROM orders")
def w4_assign_ids(spark, sf_dir):
    return clean.assign_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], ranges=32).select("o_orderkey", "new_id")


@query("SELECT o_custkey, o_orderkey, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def w5_top_k(spark, sf_dir):
    return clean.top_k(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).drop("o_totalprice")


@query("SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 12")
def u3_todo(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    return diag.todo(o, table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query(f"WITH {PREDICTIONS} SELECT row_id, bool_or(year = 2018) AS in_2018, bool_or(year = 2021) AS in_2021 FROM predictions WHERE (row_id + year) % 4 <> 0 GROUP BY row_id")
def u4_membership(spark, sf_dir):
    return diag.membership(predictions(spark, sf_dir).where("(row_id + year) % 4 <> 0"), [2018, 2021])


@query("SELECT count(*) FILTER (l_orderkey % 50 = 0) AS n_missing, count(*) FILTER (l_orderkey % 70 = 0) AS n_extra FROM lineitem")
def u5_split_check(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return clean.split_check(d, d.where("l_orderkey % 50 <> 0"), d.where("l_orderkey % 70 = 0").withColumn("l_partkey", -F.col("l_partkey")))


@query(f"WITH {POINTS} SELECT 'main' AS a, 'mixed' AS b, count(*) FILTER (class_new < 4 AND row_id % 5 = 0) AS n FROM points")
def u6_overlaps(spark, sf_dir):
    p = points(spark, sf_dir).select("row_id", "class_new")
    return clean.overlaps({"main": p.where("class_new < 4"), "mixed": p.where("row_id % 5 = 0")}, "row_id")


@query(f"WITH {POINTS}, l AS (SELECT CASE WHEN src_conf > 0.6 THEN 'main' WHEN tier = 'gold' THEN 'mixed' ELSE 'probability' END AS layer FROM points) SELECT layer, count(*) AS n FROM l GROUP BY layer")
def q6_layers(spark, sf_dir):
    return points(spark, sf_dir).groupBy(clean.layers(F.col("src_conf") > 0.6, F.col("tier") == "gold").alias("layer")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a1_value_counts(spark, sf_dir):
    return diag.value_counts(table(spark, sf_dir, "events"), "event_type")


LEDGER = "led AS (SELECT 'a' || (user_id % 9) AS acct, user_id AS project, (['RUNNING', 'PENDING', 'SUCCEEDED', 'FAILED'])[event_id % 4 + 1] AS state, value * 10 AS seconds, CASE WHEN event_id % 4 = 3 THEN event_type END AS error, ts, event_id FROM events)"


@query(f"WITH {LEDGER}, x AS (SELECT acct, error, ts, row_number() OVER (PARTITION BY acct ORDER BY ts, error) AS r FROM led WHERE error IS NOT NULL), e AS (SELECT acct, string_agg(error, ',' ORDER BY r) AS errs FROM x WHERE r <= 3 GROUP BY acct) SELECT acct, count(DISTINCT project) AS n_proj, count(*) FILTER (state = 'RUNNING') AS run, count(*) FILTER (state = 'PENDING') AS pend, count(*) FILTER (state = 'SUCCEEDED') AS suc, count(*) FILTER (state = 'FAILED') AS fail, round(sum(CASE WHEN state = 'SUCCEEDED' THEN seconds / 3600 ELSE 0 END), 6) AS hours, errs FROM led LEFT JOIN e USING (acct) GROUP BY acct, errs")
def a14_ops_ledger(spark, sf_dir):
    k = F.col("event_id")
    d = table(spark, sf_dir, "events").select(F.concat(F.lit("a"), F.col("user_id") % 9).alias("acct"), F.col("user_id").alias("project"), F.get(F.array(*map(F.lit, ("RUNNING", "PENDING", "SUCCEEDED", "FAILED"))), (k % 4).cast("int")).alias("state"), (F.col("value") * 10).alias("seconds"), F.when(k % 4 == 3, F.col("event_type")).alias("error"), "ts")
    return rounded(diag.ops_ledger(d).withColumn("errs", F.array_join("errs", ",")), "hours")


@query(f"WITH {PREDICTIONS}, c AS (SELECT truth AS class_new, CASE WHEN truth < 4 AND row_id % 5 <> 1 THEN 's0' ELSE src END AS src, count(*) AS n FROM predictions GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY class_new) AS share FROM c) SELECT class_new, src, n, round(share, 6) AS share FROM s WHERE share > 0.7")
def a15_source_concentration(spark, sf_dir):
    d = predictions(spark, sf_dir).select(F.col("truth").alias("class_new"), F.when((F.col("truth") < 4) & (F.col("row_id") % 5 != 1), "s0").otherwise(F.col("src")).alias("src"))
    return rounded(diag.source_concentration(d), "share")


@query(f"WITH {POINTS}, c AS (SELECT province, count(*) AS n FROM points GROUP BY province), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, province NULLS FIRST) AS r FROM c) SELECT max(struct_pack(n := n, p := province)) FILTER (province IS NOT NULL).p AS largest, min(struct_pack(n := n, p := province)) FILTER (province IS NOT NULL).p AS smallest, round(max(n) FILTER (province IS NOT NULL) / min(n) FILTER (province IS NOT NULL), 6) AS ratio, round(sum(n) FILTER (r <= 5) / sum(n), 6) AS top_share, round(coalesce(sum(n) FILTER (province IS NULL), 0) / sum(n), 6) AS null_share FROM r")
def a17_extremes(spark, sf_dir):
    return rounded(diag.extremes(points(spark, sf_dir), "province"), "ratio", "top_share", "null_share")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(sum(value) / 1600, 6) AS share_of_cap FROM events GROUP BY 1")
def a39_budget(spark, sf_dir):
    return rounded(rounded(diag.budget(table(spark, sf_dir, "events"), "value", 1600.0, ["event_type"]), "total", digits=4), "mean", "share_of_cap")


@query(f"WITH {POINTS} SELECT class_new, count(*) AS n, count(*) FILTER (province IS NOT NULL) AS inside, count(*) FILTER (province IS NOT NULL AND tier = 'gold') AS passed, count(*) FILTER (province IS NOT NULL AND tier = 'gold' AND src_conf > 0.5) AS output FROM points GROUP BY class_new")
def a41_funnel(spark, sf_dir):
    return diag.funnel(points(spark, sf_dir), [("inside", F.col("province").isNotNull()), ("passed", F.col("tier") == "gold"), ("output", F.col("src_conf") > 0.5)], ["class_new"])


@query(f"WITH {POINTS} SELECT x.c AS \"column\", n_null, round(n_null / n, 6) AS share, n_null / n <= 0.05 AS usable FROM (SELECT count(*) AS n, count(*) FILTER (province IS NULL) AS a, count(*) FILTER (tier IS NULL) AS b, count(*) FILTER (lon IS NULL) AS d FROM points), LATERAL (VALUES ('province', a), ('tier', b), ('lon', d)) x(c, n_null)")
def q7_null_audit(spark, sf_dir):
    return rounded(diag.null_audit(points(spark, sf_dir), ["province", "tier", "lon"], 0.05), "share")


@query(f"WITH {PREDICTIONS}, c AS (SELECT zone AS name, avg((truth = pred)::INTEGER) AS value, 0.75 AS least, zone < 'p4' AS hard FROM predictions GROUP BY zone), s AS (SELECT CASE WHEN value >= least THEN 'PASS' WHEN hard THEN 'FAIL' ELSE 'WARN' END AS s FROM c) SELECT count(*) FILTER (s = 'PASS') AS n_pass, count(*) FILTER (s = 'FAIL') AS n_fail, count(*) FILTER (s = 'WARN') AS n_warn, count(*) FILTER (s = 'FAIL') = 0 AS passed FROM s")
def t7_gate(spark, sf_dir):
    c = predictions(spark, sf_dir).groupBy(F.col("zone").alias("name")).agg(F.avg(F.expr("truth = pred").cast("int")).alias("value")).select("name", "value", F.lit(0.75).alias("least"), (F.col("name") < "p4").alias("hard"))
    return diag.gate_summary(c)


@query("SELECT l_orderkey, max(l_linenumber) - min(l_linenumber) + 1 = count(l_linenumber) AND count(DISTINCT l_linenumber) = count(l_linenumber) AS contiguous FROM lineitem GROUP BY 1")
def w8_is_contiguous(spark, sf_dir):
    return diag.is_contiguous(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


EDITS = "ed AS (SELECT conv_id AS path, turn AS ts, CASE WHEN turn = 0 OR turn % 4 = 3 THEN 'write' ELSE 'edit' END AS op, text, substr(text, 1, 3) AS old, '[' || turn || ']' AS new, conv_id % 10 <> 9 OR turn <> 0 AS ok FROM conversations)"


@query(f"""WITH RECURSIVE {EDITS}, o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts) AS k FROM ed WHERE ok),
r AS (SELECT path, k, CASE WHEN op = 'write' THEN text END AS t, (op = 'write')::INTEGER AS w, 0 AS e, (op <> 'write')::INTEGER AS x FROM o WHERE k = 1
  UNION ALL SELECT r.path, o.k, CASE WHEN op = 'write' THEN text WHEN instr(t, old) > 0 THEN substr(t, 1, instr(t, old) - 1) || new || substr(t, instr(t, old) + length(old)) ELSE t END,
  w + (op = 'write')::INTEGER, e + (op = 'edit' AND coalesce(instr(t, old) > 0, false))::INTEGER, x + (op = 'edit' AND NOT coalesce(instr(t, old) > 0, false))::INTEGER FROM r JOIN o ON o.path = r.path AND o.k = r.k + 1)
SELECT path, arg_max(t, k) AS final, arg_max(w, k)::INTEGER AS n_write, arg_max(e, k)::INTEGER AS n_edit, arg_max(x, k)::INTEGER AS n_warn FROM (SELECT path, k, coalesce(t, '<none>') AS t, w, e, x FROM r) GROUP BY path""")
def t1_replay_log(spark, sf_dir):
    k, t = F.col("conv_id"), F.col("turn")
    e = table(spark, sf_dir, "conversations").select(k.alias("path"), t.alias("ts"), F.when((t == 0) | (t % 4 == 3), "write").otherwise("edit").alias("op"), F.col("text").alias("content"), F.substring("text", 1, 3).alias("old"), F.concat(F.lit("["), t, F.lit("]")).alias("new"), ((k % 10 != 9) | (t != 0)).alias("ok"))
    return textlog.replay_log(e).withColumn("final", F.coalesce("final", F.lit("<none>")))


@query("WITH a AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, max(ts) AS snap FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT user_id, last, snap, CASE WHEN snap IS NULL THEN 'MISSING' WHEN snap <= last THEN 'STALE' ELSE 'OK' END AS status FROM a LEFT JOIN b USING (user_id)")
def t2_freshness(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return textlog.freshness(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id")


@query("WITH l AS (SELECT conv_id, turn, text FROM conversations WHERE conv_id % 5 <> 0 OR turn <> 1) SELECT conv_id AS id, count(*) AS n_lines, min(turn + 1) AS first, max(turn + 1) AS last, max(turn) - min(turn) + 1 = count(*) AS contiguous, md5(string_agg(replace(text, chr(10), ' '), chr(10) ORDER BY turn)) AS body_md5 FROM l GROUP BY conv_id")
def t3_parse_numbered(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("conv_id % 5 <> 0 OR turn <> 1")
    line = F.concat((F.col("turn") + 1).cast("string"), F.lit("\t"), F.replace("text", F.lit("\n"), F.lit(" ")))
    texts = c.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return textlog.parse_numbered(texts).select("id", "n_lines", "first", "last", "contiguous", F.md5("body").alias("body_md5"))


@query("SELECT doc_id, md5(replace(replace(text, 'the', 'THE'), 'THEr', 'there')) AS text_md5, contains(replace(replace(text, 'the', 'THE'), 'THEr', 'there'), 'THE') AS has_left FROM documents")
def t4_rewrite_text(spark, sf_dir):
    t = textlog.rewrite_text(F.col("text"), [("the", "THE"), ("THEr", "there")])
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("text_md5"), (F.size(textlog.leftovers(t, ["THE"])) > 0).alias("has_left"))


@query("""WITH a AS (SELECT doc_id, text, replace(text, 'the', 'THE') AS t1, (length(text) - length(replace(text, 'the', ''))) // 3 AS n1 FROM documents),
b AS (SELECT *, replace(t1, 'THEr', 'there') AS t2, (length(t1) - length(replace(t1, 'THEr', ''))) // 4 AS n2 FROM a)
SELECT doc_id, t2 <> text AS changed, n1 AS n_first, n2 AS n_second, contains(t2, 'THE') AS has_left FROM b WHERE t2 <> text OR contains(t2, 'THE')""")
def t4_change_list(spark, sf_dir):
    d = textlog.rewrite_changes(table(spark, sf_dir, "documents"), [("the", "THE"), ("THEr", "there")], ["THE"], "doc_id")
    return d.select("doc_id", "changed", F.get("replaced", F.lit(0)).alias("n_first"), F.get("replaced", F.lit(1)).alias("n_second"), (F.size("left") > 0).alias("has_left"))


@query("SELECT (2000 + o_custkey % 30)::INTEGER AS year, (o_orderkey % 1000 / 1000.0::DOUBLE)::DOUBLE AS oa, (o_custkey % 100 / 100.0::DOUBLE)::DOUBLE AS macro_f1 FROM orders WHERE o_orderkey % 3 <> 0")
def t5_extract_metrics(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    line = F.concat(F.lit("y"), 2000 + c % 30, F.lit(": OA="), F.format_string("%.3f", k % 1000 / 1000.0), F.lit(" macro-F1="), F.format_string("%.2f", c % 100 / 100.0))
    return textlog.extract_metrics(table(spark, sf_dir, "orders").select(F.when(k % 3 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("line")))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) SELECT doc_id, line_no::INTEGER AS line_no, phrase FROM l, (VALUES ('password'), ('thion'), ('License')) p(phrase) WHERE contains(line, phrase)")
def t6_phrase_scan(spark, sf_dir):
    return textlog.phrase_scan(table(spark, sf_dir, "documents"), ["password", "thion", "License"], "doc_id")


@query("WITH p AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-zA-Z]{6,}')) AS phrase FROM benchmark), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) SELECT doc_id, line_no::INTEGER AS line_no, phrase FROM l, p WHERE contains(line, phrase)")
def t6_phrase_table(spark, sf_dir):
    """Lines that hold one of some thousand words of the benchmark."""
    phrases = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]{6,}"), F.lit(0))).alias("phrase"))
    return textlog.phrase_table_scan(table(spark, sf_dir, "documents"), phrases, "doc_id")


@query("WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(url, 'https?://[^/]+')) AS path FROM pages), m AS (SELECT DISTINCT regexp_extract(url, 'https?://[^/]+') AS path FROM pages WHERE page_id % 2 = 0) SELECT path FROM n WHERE path NOT IN (SELECT path FROM m)")
def t8_missing_paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    host = "https?://[^/]+"
    m = p.where("page_id % 2 = 0").select(F.regexp_extract("url", host, 0).alias("path")).distinct()
    return textlog.missing_paths(p, m, host, "url")


@query(r"WITH a AS (SELECT doc_id, regexp_replace(text, '^[^\n]*\n', '') AS a FROM documents), b AS (SELECT doc_id, text AS b FROM documents), j AS (SELECT doc_id, a, b, coalesce(a IS NULL OR strlen(b) > strlen(a) + 200, false) AS t FROM a FULL JOIN b USING (doc_id)) SELECT doc_id, md5(CASE WHEN t THEN b ELSE a END) AS text_md5, CASE WHEN t THEN 'b' ELSE 'a' END AS origin FROM j")
def t9_prefer_longer(spark, sf_dir):
    """All rows and whole texts: the text without its first line against the text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    a = d.select("doc_id", F.regexp_replace("text", r"^[^\n]*\n", "").alias("text"))
    return textlog.prefer_longer(a, d, "doc_id").select("doc_id", F.md5("text").alias("text_md5"), "origin")


@query("SELECT conv_id, arg_max(text, (length(text), turn)) AS text, arg_max(turn, (length(text), turn)) AS ts FROM conversations GROUP BY conv_id")
def w7_best_per_key(spark, sf_dir):
    return textlog.best_per_key(table(spark, sf_dir, "conversations").withColumnRenamed("turn", "ts"), "conv_id")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS owner, count(*) AS n, count(*) FILTER (value > 20) AS n_ok, count(*) FILTER (NOT value > 20) AS n_fail FROM events GROUP BY ALL")
def x2_progress(spark, sf_dir):
    return streams.progress(table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("owner"), (F.col("value") > 20).alias("ok")))


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def x3_finished_once(spark, sf_dir):
    return streams.finished_once(table(spark, sf_dir, "events"), "user_id").agg(F.count("*").alias("n"))


LOTS = """lots AS (SELECT *, least(3, floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 864000000000)::INTEGER + (event_id % 23 = 5)::INTEGER) AS lot FROM events),
marks AS (SELECT l AS lot, (SELECT max(epoch_ms(ts)) - 3600000 FROM lots WHERE lot < l) AS mark FROM range(0, 5) t(l)),
attempts AS (SELECT event_type AS owner, user_id::VARCHAR AS task, ts, value > 20 AS ok, lot, mark FROM lots JOIN marks USING (lot))"""


def lots(spark, sf_dir) -> list:
    """Attempts in four lots of files: ten days each, but every 23rd comes a lot late."""
    e = table(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    first = e.agg(F.min(t)).first()[0] or 0
    late = F.floor((t - first) / 864_000_000_000).cast("int") + (F.col("event_id") % 23 == 5).cast("int")
    d = e.select("ts", F.col("event_type").alias("owner"), F.col("user_id").cast("string").alias("task"), (F.col("value") > 20).alias("ok"), F.least(F.lit(3), late).alias("lot"))
    return [d.where(F.col("lot") == k).drop("lot") for k in range(4)]


@query(f"WITH {LOTS} SELECT date_trunc('day', ts)::TIMESTAMP AS start, owner, count(*) AS n, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_fail FROM attempts WHERE mark IS NULL OR epoch_ms(date_trunc('day', ts)) + 86400000 > mark GROUP BY ALL")
def x2_progress_stream(spark, sf_dir):
    """Days and owners counted by a stream over four lots, restarted for each; what comes too late for its day is dropped."""
    d = ledger.progress_in_lots(spark, lots(spark, sf_dir), shared.place(spark, "progress"))
    return d.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""WITH {LOTS}, kept AS (SELECT * FROM attempts WHERE mark IS NULL OR epoch_us(ts) > mark * 1000),
per AS (SELECT owner, task, min(lot) AS lot, arg_min(epoch_ms(ts), (lot, ts)) + 259200000 AS due, min(lot) FILTER (ok) AS done, count(*) FILTER (ok) AS good, count(*) FILTER (NOT coalesce(ok, false)) AS bad FROM kept GROUP BY ALL),
aged AS (SELECT owner, task, good, bad, (SELECT min(m.lot) - 1 FROM marks m WHERE m.lot > per.lot AND m.mark > due) AS gone, done FROM per),
targets AS (SELECT event_type AS owner, count(DISTINCT user_id) AS target FROM events GROUP BY 1),
sums AS (SELECT owner, sum((good > 0)::INTEGER)::BIGINT AS n_ok, sum(greatest(good - 1, 0))::BIGINT AS n_repeat, sum(bad)::BIGINT AS n_fail, sum((gone IS NOT NULL AND (done IS NULL OR done > gone))::INTEGER)::BIGINT AS n_overdue FROM aged GROUP BY owner)
SELECT owner, coalesce(n_ok, 0) AS n_ok, coalesce(n_repeat, 0) AS n_repeat, coalesce(n_fail, 0) AS n_fail, coalesce(n_overdue, 0) AS n_overdue, target, round(n_ok / target, 6) AS share FROM targets LEFT JOIN sums USING (owner)""")
def x2_ledger_stream(spark, sf_dir):
    """Tasks finished, retried, failed and overdue for each owner, against the number of its tasks."""
    targets = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("owner")).agg(F.count_distinct("user_id").alias("target"))
    path = ledger.in_lots(spark, lots(spark, sf_dir), shared.place(spark, "ledger"), ledger.outcomes)
    return rounded(ledger.measured(spark, path, targets), "share")


@query("SELECT event_type AS owner, user_id::VARCHAR AS task FROM events GROUP BY ALL")
def x3_finished_stream(spark, sf_dir):
    """Each task of an owner once, by a stream over four lots with a watermark that keeps all."""
    once = lambda live: streams.finished_once(live.withColumn("key", F.to_json(F.struct("owner", "task"))), "key", late="400 days").select("owner", "task")
    return spark.read.parquet(ledger.in_lots(spark, lots(spark, sf_dir), shared.place(spark, "finished"), once)).drop("batch")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def x4_missing_outputs(spark, sf_dir):
    return streams.missing_outputs(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query(f"WITH {POINTS} SELECT row_id, {SEEDED.format('row_id', 0)} AS o FROM points ORDER BY o, row_id LIMIT 25")
def o2_first_n(spark, sf_dir):
    return points(spark, sf_dir).select("row_id", joins.seeded("row_id").alias("o")).orderBy("o", "row_id").limit(25)


@query("WITH c AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_suppkey, round(q, 4) AS q, round(sum(q) OVER (ORDER BY q, l_suppkey ROWS UNBOUNDED PRECEDING) / sum(q) OVER (), 6) AS share FROM c")
def w9_cumulative_share(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    d = clean.running(c, ["q", "l_suppkey"], {"before": F.col("q")}).join(F.broadcast(c.agg(F.sum("q").alias("t"))))
    return rounded(rounded(d.select("l_suppkey", "q", ((F.col("before") + F.col("q")) / F.col("t")).alias("share")), "q", digits=4), "share")
