"""Seeded samples, caps, quotas and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from .clean import assign_ids
from .joins import near_any, seeded


def cap_per_group(df: DataFrame, by: list[str], k: int | Column, seed: int = 0, key: str = "row_id") -> DataFrame:
    """At most k rows a group, first in the seeded order."""
    w = Window.partitionBy(*by).orderBy(seeded(key, seed), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def allocate_quota(groups: DataFrame, total: int, share: str = "weight", cap: str | None = None, key: str = "grp") -> DataFrame:
    """Adds quota: `total` by share, rounded by largest remainder, none above its cap; what a cap cuts goes to the others once more."""
    everything = Window.partitionBy()
    limit = F.col(cap) if cap else F.lit(total).cast("bigint")
    d = groups.withColumn("_x", F.lit(float(total)) * F.col(share) / F.sum(share).over(everything)).withColumn("_cap", limit.cast("bigint"))
    d = d.withColumn("_f", F.floor("_x").cast("bigint")).withColumn("_left", F.lit(total) - F.sum("_f").over(everything))
    d = d.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), key)))
    d = d.withColumn("quota", F.least(F.col("_f") + (F.col("_r") <= F.col("_left")).cast("bigint"), F.col("_cap")))
    # second pass: the rest goes, in the order of remainders, to groups with room
    d = d.withColumn("_rest", F.lit(total) - F.sum("quota").over(everything)).withColumn("_room", F.col("_cap") - F.col("quota"))
    before = F.coalesce(F.sum("_room").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("quota", F.col("quota") + F.greatest(F.lit(0), F.least(F.col("_room"), F.col("_rest") - before)))
    return d.drop("_x", "_cap", "_f", "_left", "_r", "_rest", "_room")


def sqrt_allocation(classes: DataFrame, total: int, n: str = "n", key: str = "class_new") -> DataFrame:
    """A fixed total by the square roots of class sizes."""
    return allocate_quota(classes.withColumn("_w", F.sqrt(F.col(n).cast("double"))), total, "_w", None, key).drop("_w")


def quota_sample(df: DataFrame, quotas: DataFrame, by: str, seed: int = 0, key: str = "row_id") -> DataFrame:
    """Rows by quota (by, quota), first in the seeded order."""
    return cap_per_group(df.join(quotas.select(by, F.col("quota").alias("_q")), by), [by], F.col("_q"), seed, key).drop("_q")


def hard_negatives(pos: DataFrame, pool: DataFrame, km: float = 2.0, seed: int = 0) -> DataFrame:
    """(row_id, kind): as many negatives as positives, those of other classes near positives first, the rest from the background."""
    near = near_any(pool, pos.select(F.col("row_id").alias("b_id"), "lon", "lat"), km, "row_id").distinct()
    d = pool.join(pos.select("row_id"), "row_id", "left_anti").join(near.withColumn("_h", F.lit(True)), "row_id", "left")
    d = d.select("row_id", F.when(F.col("_h"), "hard").otherwise("background").alias("kind"))
    d = d.withColumns({"_k": (F.col("kind") == "background").cast("int"), "_o": seeded("row_id", seed)})
    n = pos.count()
    return assign_ids(d, ["_k", "_o", "row_id"], "_n").where(F.col("_n") < n).select("row_id", "kind")


def quota_audit(df: DataFrame, regions: DataFrame, classes: DataFrame, least: int = 500) -> DataFrame:
    """(region, class_new, n, available, status, cause) over the full grid; df has region, class_new and a flag `sampled`."""
    grid = regions.select("region").distinct().join(F.broadcast(classes.select("class_new", "mandated").distinct()))
    have = df.groupBy("region", "class_new").agg(F.count_if("sampled").alias("n"), F.count("*").alias("available"))
    d = grid.join(have, ["region", "class_new"], "left").fillna(0, ["n", "available"])
    status = scalar.ladder([(F.col("n") >= least, "KEEP"), (F.col("available") >= least, "SUPPLEMENT"), (F.col("n") > 0, "PROB")], "MERGE")
    cause = scalar.ladder([(F.col("n") >= least, "none"), (F.col("available") >= least, "short sampling"), (F.col("mandated"), "mandate")], "data gap")
    return d.select("region", "class_new", "n", "available", status.alias("status"), cause.alias("cause"))


def balance(df: DataFrame, side: Column, by: str, seed: int = 0, key: str = "row_id") -> DataFrame:
    """Both sides of a split get as many rows in each class: the larger one is trimmed, in the seeded order."""
    d = df.withColumn("_side", side)
    n = d.groupBy(by).agg(F.least(F.count_if("_side"), F.count_if(~F.col("_side"))).alias("_q"))
    return cap_per_group(d.join(n, by), [by, "_side"], F.col("_q"), seed, key).drop("_side", "_q")


def block_folds(df: DataFrame, block: Column, k: int = 5, seed: int = 0) -> DataFrame:
    """Adds fold: whole spatial blocks are dealt to k folds in a seeded way."""
    d = df.withColumn("_b", block)
    return d.withColumn("fold", F.pmod(F.shiftright(seeded("_b", seed), 7), F.lit(k)).cast("int")).drop("_b")


def fidelity(sample: DataFrame, by: list[str], same: Column, m: int, seed: int = 0) -> DataFrame:
    """(by, n, share): m checked cells a tile and the share that matches."""
    return cap_per_group(sample, by, m, seed).groupBy(*by).agg(F.count("*").alias("n"), F.avg(same.cast("int")).alias("share"))
