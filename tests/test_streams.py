from pyspark.sql import functions as F

from landpanel.sources.io import table
from landpanel.streaming import streams


def test_only_new_files_are_copied(spark, tmp_path):
    src, dst, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    spark.range(5).write.parquet(src)
    assert streams.copy_new(spark, src, dst, chk, spark.range(1).schema) == 5
    spark.range(5, 8).write.mode("append").parquet(src)
    assert streams.copy_new(spark, src, dst, chk, spark.range(1).schema) == 8
    assert streams.copy_new(spark, src, dst, chk, spark.range(1).schema) == 8


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    e = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("owner"), (F.col("value") > 20).alias("ok"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got, name = [], F.col("start").cast("string").alias("start")
    streams.run_once(streams.progress(live).withColumn("start", name), str(tmp_path / "chk"), lambda d, _: got.append({(r.start, r.owner): tuple(r) for r in d.collect()}), "complete")
    assert got[-1] == {(r.start, r.owner): tuple(r) for r in streams.progress(e).withColumn("start", name).collect()}


def test_a_finished_key_is_not_redone(spark, sf_dir, tmp_path):
    e = table(spark, sf_dir, "events").select("ts", "user_id")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = []
    streams.run_once(streams.finished_once(live, "user_id", late="400 days"), str(tmp_path / "chk"), lambda d, _: got.extend(r.user_id for r in d.collect()))
    assert len(got) == len(set(got)) == e.select("user_id").distinct().count()
