"""A progress ledger kept by a stream: tasks finish once, overdue tasks are reported, owners are measured against targets."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .streams import progress

KINDS = ("ok", "repeat", "fail", "overdue")


class Kept(NamedTuple):
    """Rows of a stream, and the sink that keeps them: `write(folder)` is called with each batch and its number."""

    rows: DataFrame
    write: Callable[[str], Callable[[DataFrame, int], None]]


def step(rows: DataFrame, held: DataFrame | None, overdue_ms: int, mark: int | None = None) -> DataFrame:
    """(owner, task, first, done, told, and a count for each of KINDS): each task's state after the attempts `rows`.

    `held` has the states before, `mark` is the watermark after the rows, in milliseconds. One grouping for all tasks.
    """
    ok, none = F.coalesce("ok", F.lit(False)), F.lit(None)
    d = rows.select("owner", "task", F.unix_millis("ts").alias("ms"), ok.cast("bigint").alias("good"), (~ok).cast("bigint").alias("bad"), none.cast("bigint").alias("first"), F.lit(False).alias("done"), F.lit(False).alias("told"))
    if held is not None:
        d = d.unionByName(held.select("owner", "task", none.cast("bigint").alias("ms"), F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("bad"), "first", "done", "told"))
    d = d.groupBy("owner", "task").agg(F.coalesce(F.max("first"), F.min("ms")).alias("first"), F.sum("good").alias("good"), F.sum("bad").alias("fail"), F.bool_or("done").alias("was"), F.bool_or("told").alias("before"))
    d = d.withColumns({"done": F.col("was") | (F.col("good") > 0), "ok": (~F.col("was") & (F.col("good") > 0)).cast("bigint")})
    due = F.coalesce(F.col("first") + overdue_ms < F.lit(mark).cast("bigint"), F.lit(False))
    d = d.withColumns({"repeat": F.col("good") - F.col("ok"), "overdue": (due & ~F.col("done") & ~F.col("before")).cast("bigint")})
    return d.select("owner", "task", "first", "done", (F.col("before") | (F.col("overdue") > 0)).alias("told"), *KINDS)


def news(states: DataFrame) -> DataFrame:
    """(owner, task, kind, n) of the states after a step."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in KINDS))
    return states.select("owner", "task", F.inline(F.filter(each, lambda x: x["n"] > 0)))


def outcomes(events: DataFrame, late: str = "1 hour", overdue_ms: int = 3 * 86_400_000) -> Kept | DataFrame:
    """(owner, task, kind, n) of a stream of attempts (owner, task, ts, ok); of a table at once.

    A task's first success is `ok`, further ones are `repeat`, so a finished task counts once however often it is retried.
    Failures are `fail`. A task without success `overdue_ms` after the first attempt of the batch that brought it is reported
    `overdue` once, when the watermark has passed that time. Attempts behind the watermark, `late` before the newest
    attempt of all batches before, are dropped. A task's state is three values. The states of all tasks are a table that a
    batch reads and writes anew, so no task takes a step of its own; those before the last batch stay, for its repetition.
    """
    if not events.isStreaming:
        return news(step(events, None, overdue_ms))

    def write(folder: str):
        keep = into(f"{folder}/out")

        def settle(batch: DataFrame, number: int) -> None:
            spark, (old, new) = batch.sparkSession, (f"{folder}/{{}}/{k % 2}" for k in (number - 1, number))
            mark_of = lambda d: d.select(F.unix_millis(F.timestamp_millis("newest") - F.expr(f"interval {late}"))).first()[0]
            newest = batch.agg(F.unix_millis(F.max(F.col("ts").cast("timestamp"))).alias("newest"))
            held = mark = None
            if number:
                held, seen = (spark.read.parquet(old.format(k)) for k in ("tasks", "newest"))
                mark, newest = mark_of(seen), newest.unionByName(seen).agg(F.max("newest").alias("newest"))
            newest.coalesce(1).write.mode("overwrite").parquet(new.format("newest"))
            rows = batch.withColumn("ts", F.col("ts").cast("timestamp"))
            if mark is not None:
                rows = rows.where(F.col("ts") > F.timestamp_millis(F.lit(mark)))
            after = mark_of(spark.read.parquet(new.format("newest")))
            step(rows, held, overdue_ms, after).write.mode("overwrite").parquet(new.format("tasks"))
            keep(news(spark.read.parquet(new.format("tasks"))), number)

        return settle

    return Kept(events, write)


def into(path: str):
    """A sink for foreachBatch: each batch has a folder of its own, which a repeated batch replaces."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def in_lots(spark: SparkSession, lots: Iterable[DataFrame], folder: str, stream, mode: str = "append") -> str:
    """Write one lot of files after the other and run `stream` on what is new, each time anew from its checkpoint.

    `stream` maps the streaming table to the one that is kept, or to rows with a sink of their own (`Kept`); the path of the
    kept batches is returned.
    """
    for lot in lots:
        lot.write.mode("append").parquet(f"{folder}/in")
        live = spark.readStream.schema(lot.schema).parquet(f"{folder}/in")
        kept = stream(live)
        rows, sink = (kept.rows, kept.write(folder)) if isinstance(kept, Kept) else (kept, into(f"{folder}/out"))
        query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(sink).trigger(availableNow=True)
        query.start().awaitTermination()
    return f"{folder}/out"


def measured(spark: SparkSession, path: str, targets: DataFrame) -> DataFrame:
    """(owner, n_ok, n_repeat, n_fail, n_overdue, target, share) from the batches of `outcomes`, for every owner with a target."""
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in KINDS]
    rows = spark.read.parquet(path).groupBy("owner").agg(*sums)
    d = targets.select("owner", "target").join(rows, "owner", "left").fillna(0, [f"n_{k}" for k in KINDS])
    return d.select("owner", *(f"n_{k}" for k in KINDS), "target", F.try_divide("n_ok", "target").alias("share"))


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of each key the row of the last batch that updated it."""
    d = spark.read.parquet(path)
    rest = [c for c in d.columns if c not in (*keys, "batch")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def progress_in_lots(spark: SparkSession, lots: Iterable[DataFrame], folder: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """`streams.progress` over lots of files, in update mode: a window's row is the last that a batch gave it."""
    path = in_lots(spark, lots, folder, lambda live: progress(live, window, late), "update")
    return latest(spark, path, ["start", "owner"])
