import os
import random
import time

from pyspark.sql import functions as F

from landpanel.operators import textlog
from landpanel.sources import io


def lines_with(rows, phrases):
    return sorted((k, no, p) for k, t in rows if t is not None for no, line in enumerate(t.split("\n"), 1) for p in phrases if p in line)


def test_phrase_tables_equal_a_plain_search(spark):
    r = random.Random(3)
    rows = [(k, "\n".join("".join(r.choice("abé😀 ") for _ in range(r.randrange(30))) for _ in range(r.randrange(6)))) for k in range(200)] + [(900, None), (901, ""), (902, "ab\nab ab\n\n")]
    phrases = sorted({"".join(r.choice("abé😀") for _ in range(r.randint(1, 3))) for _ in range(60)})
    d = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    table = spark.createDataFrame([(p,) for p in [*phrases, *phrases[:3], "", "a\nb", None]], "phrase string")
    want = lines_with(rows, phrases)
    assert want and sorted(map(tuple, textlog.phrase_table_scan(d, table, "id").collect())) == want
    assert sorted(map(tuple, textlog.phrase_table_scan(d, table, "id", most=200).collect())) == want  # in several passes
    assert sorted(map(tuple, textlog.phrase_scan(d, phrases[:3], "id").collect())) == lines_with(rows, phrases[:3])
    assert textlog.phrase_table_scan(d, table.limit(0), "id").count() == 0 and textlog.phrase_table_scan(d.limit(0), table, "id").count() == 0


def test_ten_thousand_phrases_cost_about_what_three_do(spark):
    d = spark.range(4000).select("id", F.repeat(F.concat(F.md5(F.col("id").cast("string")), F.lit(" ")), 60).alias("text")).cache()
    d.count()
    table = lambda n: spark.range(n).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12).alias("phrase"))
    took = []
    for n in (3, 3, 10_000):
        t = table(n).cache()
        t.count()
        began = time.time()
        textlog.phrase_table_scan(d, t, "id").count()
        took.append(time.time() - began)
    assert took[2] < 4 * took[1] + 3


def test_only_files_that_the_index_names_are_read(spark, tmp_path):
    at, index = str(tmp_path / "chunks"), str(tmp_path / "index")
    rows = spark.range(8000).select(F.col("id").alias("row_id"), (F.lit(2017) + F.floor(F.col("id") / 1000)).cast("int").alias("year"), (F.col("id") / 10).alias("x"))
    for k in range(4):  # two years a file, the second file has rows of 2017 at its end
        part = rows.where(F.col("year").between(2017 + 2 * k, 2018 + 2 * k))
        (part.unionByName(rows.where("row_id < 5")) if k == 1 else part).coalesce(1).write.mode("append").parquet(at)
    io.build_index(spark, at, index)
    names = lambda d: {os.path.basename(f) for f in d.inputFiles()}
    for year, files, n in ((2017, 2, 1005), (2018, 1, 1000), (2024, 1, 1000)):
        d = io.scan_indexed(spark, at, index, [year], ["row_id", "x"])
        assert len(names(d)) == files and d.count() == n and d.columns == ["row_id", "x"]
    assert len(names(io.scan_indexed(spark, at, index, [2017, 2020], keys=(0, 3000)))) == 2
    assert io.scan_indexed(spark, at, index, [2017], keys=(2, 3)).count() == 4 and io.scan_indexed(spark, at, index, [1999]).count() == 0
    rows.where("year = 2024").withColumn("year", F.lit(2030)).coalesce(1).write.mode("append").parquet(at)
    io.build_index(spark, at, index)  # new files alone are read
    assert io.scan_indexed(spark, at, index, [2030]).count() == 1000 and spark.read.parquet(index).agg(F.sum("n")).first()[0] == 9005


def test_a_rewrite_lists_its_changes_and_what_is_left(spark):
    rows = [(1, "the other the"), (2, "none"), (3, "TH THE"), (4, None), (5, "aaa the"), (6, "")]
    d = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: (r.changed, list(r.replaced), list(r.left)) for r in textlog.rewrite_changes(d, [("the", "THE"), ("THEr", "there"), ("aa", "aa")], ["THE", "zz"], "id").collect()}
    assert got == {1: (True, [3, 1, 0], ["THE"]), 3: (False, [0, 0, 0], ["THE"]), 5: (True, [1, 0, 1], ["THE"])}


def test_heavy_files_are_registered_without_digest(spark, tmp_path):
    for name, n in (("a", 10), ("b", 5000)):
        (tmp_path / name).write_bytes(b"x" * n)
    got = {r.path[-1]: (r.bytes, r.md5 is None) for r in io.file_manifest(spark, str(tmp_path), heavy=100).collect()}
    assert got == {"a": (10, False), "b": (5000, True)}
