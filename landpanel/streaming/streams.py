"""Structured Streaming: file arrival, progress ledgers, retries and completeness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import exists


def arrivals(spark: SparkSession, path: str, schema, pattern: str = "*.parquet") -> DataFrame:
    """A stream of newly arrived files; a checkpoint remembers what was taken."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def copy_new(spark: SparkSession, source: str, target: str, checkpoint: str, schema) -> int:
    """Append the rows of files that have not been taken before; how many rows the target has now.

    Before the first file, and before the folder itself, has arrived there is nothing to take.
    """
    if not exists(spark, source):
        return 0
    q = arrivals(spark, source, schema).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(target).count() if exists(spark, target) else 0


def watermarked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with a watermark on `ts`, which watermarks need as a time with zone; a batch as it is."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def progress(events: DataFrame, window: str = "1 day", late: str = "1 hour", ts: str = "ts", owner: str = "owner") -> DataFrame:
    """(start, owner, n, n_ok, n_fail) per tumbling window; rows later than `late` behind the newest are dropped in a stream."""
    d = watermarked(events, ts, late)
    d = d.groupBy(F.window(ts, window).alias("w"), owner).agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_fail"))
    return d.select(F.col("w.start").alias("start"), owner, "n", "n_ok", "n_fail")


def run_once(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Everything available now, batch by batch."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()


def finished_once(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once: a repeated success within the watermark changes nothing. In a batch the earliest row of a key stays."""
    if events.isStreaming:
        return watermarked(events, ts, late).dropDuplicatesWithinWatermark([key])
    rest = [F.col(c) for c in events.columns if c not in (key, ts)]
    first = events.groupBy(key).agg(F.min(F.struct(F.col(ts).isNull().alias("_n"), F.col(ts), *rest)).alias("_r"))
    return first.select(*(F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in events.columns))


def missing_outputs(expected: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Keys whose output is not there: the only measure of success."""
    return expected.select(key).distinct().join(written.select(key).distinct(), key, "left_anti")
