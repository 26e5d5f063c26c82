from datetime import datetime, timedelta

from pyspark.sql import functions as F

from landpanel.streaming import ledger, streams

DAY0 = datetime(2024, 3, 1)
SCHEMA = "owner string, task string, ts timestamp, ok boolean"


def lot(spark, rows):
    return spark.createDataFrame([(o, t, DAY0 + timedelta(hours=h), ok) for o, t, h, ok in rows], SCHEMA).coalesce(1)


def test_tasks_finish_once_and_overdue_tasks_are_told_once(spark, tmp_path):
    first = lot(spark, [("a", "t1", 0, False), ("a", "t1", 1, True), ("a", "t2", 0, False), ("b", "t1", 2, False), ("b", "t9", 5, True), ("b", "t9", 6, True)])
    second = lot(spark, [("a", "t1", 3, True), ("a", "t1", 90, True), ("a", "t2", 100, False), ("b", "t1", 60, True)])  # hour 3 is behind the watermark of hour 5
    third = lot(spark, [("a", "t2", 101, True), ("b", "new", 300, None)])
    path = ledger.in_lots(spark, [first, second, third], str(tmp_path / "s"), ledger.outcomes)
    told = {(r.owner, r.task, r.kind): r.n for r in spark.read.parquet(path).groupBy("owner", "task", "kind").agg(F.sum("n").alias("n")).collect()}
    assert told == {
        ("a", "t1", "fail"): 1, ("a", "t1", "ok"): 1, ("a", "t1", "repeat"): 1, ("a", "t2", "fail"): 2, ("a", "t2", "overdue"): 1, ("a", "t2", "ok"): 1,
        ("b", "t1", "fail"): 1, ("b", "t1", "ok"): 1, ("b", "t9", "ok"): 1, ("b", "t9", "repeat"): 1, ("b", "new", "fail"): 1,
    }
    targets = spark.createDataFrame([("a", 4), ("b", 3), ("none", 2)], "owner string, target bigint")
    got = {r.owner: tuple(r)[1:] for r in ledger.measured(spark, path, targets).collect()}
    assert got == {"a": (2, 1, 3, 1, 4, 0.5), "b": (2, 1, 2, 0, 3, 2 / 3), "none": (0, 0, 0, 0, 2, 0.0)}


def test_a_lot_without_rows_and_a_restart_without_news_change_nothing(spark, tmp_path):
    rows = lot(spark, [("a", "t1", 0, True), ("a", "t1", 30, False)])
    path = ledger.in_lots(spark, [rows, rows.limit(0), rows.limit(0)], str(tmp_path / "s"), ledger.outcomes)
    assert sorted((r.kind, r.n) for r in spark.read.parquet(path).collect()) == [("fail", 1), ("ok", 1)]


def test_all_tasks_of_a_batch_are_settled_at_once(spark, tmp_path):
    first = lot(spark, [("a", f"t{k}", k % 5, k % 3 == 0) for k in range(300)])
    second = lot(spark, [("a", f"t{k}", 100, k % 3 == 1) for k in range(300)]).unionByName(first.where("task = 't0'").withColumn("ts", F.lit(None).cast("timestamp")))
    path = ledger.in_lots(spark, [first, second], str(tmp_path / "s"), ledger.outcomes)
    got = {r.kind: (r.tasks, r.n) for r in spark.read.parquet(path).groupBy("kind").agg(F.count_distinct("task").alias("tasks"), F.sum("n").alias("n")).collect()}
    # without a time there is no telling whether an attempt is late: it is dropped once there is a watermark
    assert got == {"ok": (200, 200), "fail": (300, 400), "overdue": (100, 100)}
    plan = ledger.step(first, None, 1)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Python" not in plan and "Pandas" not in plan


def test_a_repeated_batch_of_attempts_leaves_the_ledger_as_it_was(spark, tmp_path):
    live = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    write = ledger.outcomes(live).write(str(tmp_path / "s"))
    lots = [lot(spark, [("a", "x", 0, True), ("a", "y", 1, False)]), lot(spark, [("a", "x", 2, True), ("a", "y", 90, False)]), lot(spark, [("a", "y", 95, True)])]
    for number in (0, 0, 1, 1, 2, 2):
        write(lots[number], number)
    told = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "s/out")).groupBy("task", "kind").agg(F.sum("n")).collect())
    assert told == [("x", "ok", 1), ("x", "repeat", 1), ("y", "fail", 2), ("y", "ok", 1), ("y", "overdue", 1)]


def test_a_repeated_batch_replaces_itself_and_the_last_one_counts(spark, tmp_path):
    write = ledger.into(str(tmp_path / "out"))
    for number, n in ((0, 1), (1, 5), (1, 7)):
        write(spark.createDataFrame([("k", n)], "key string, n bigint"), number)
    assert [tuple(r) for r in ledger.latest(spark, str(tmp_path / "out"), ["key"]).collect()] == [("k", 7)]


def test_late_rows_are_dropped_from_finished_windows(spark, tmp_path):
    lots = [lot(spark, [("a", "x", 1, True), ("a", "x", 50, True)]), lot(spark, [("a", "x", 2, False), ("a", "x", 47.5, False), ("a", "x", 49, False)])]
    got = {r.start.day: (r.n, r.n_ok, r.n_fail) for r in ledger.progress_in_lots(spark, lots, str(tmp_path / "s")).collect()}
    assert got == {1: (1, 1, 0), 3: (2, 1, 1)}  # hours 2 and 47.5: their days had ended an hour before hour 50


def test_nothing_has_arrived_yet(spark, tmp_path):
    src, dst, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    schema = spark.range(1).schema
    assert streams.copy_new(spark, src, dst, chk, schema) == 0
    (tmp_path / "in").mkdir()
    assert streams.copy_new(spark, src, dst, chk, schema) == 0
    spark.range(3).write.mode("append").parquet(src)
    assert streams.copy_new(spark, src, dst, chk, schema) == 3


def test_the_earliest_row_of_a_key_stays_in_a_batch(spark):
    d = lot(spark, [("b", "k", 2, True), ("a", "k", 1, False), ("c", "k", 1, True), ("c", "j", 4, None)])
    got = sorted((r.task, r.owner) for r in streams.finished_once(d.repartition(3), "task").collect())
    assert got == [("j", "c"), ("k", "a")]
