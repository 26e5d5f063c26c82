"""Cleaning: rules and verdicts, exclusions, deduplication, ids, fusion of sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.vec import finite
from ..sources.shared import cut

#: Climate and terrain rules over columns in units (see functions.scalar.decode_scaled); thresholds are arguments' defaults.
BATTERY = {
    "R1": "class_new = 43 AND bio06 < -20",
    "R2": "class_new = 43 AND bio01 < 0",
    "R3": "class_new = 42 AND bio01 > 22",
    "R4": "class_new IN (41, 43) AND bio01 < -5",
    "R5": "class_new = 46 AND bio01 > 15",
    "R6": "elev > 4500 AND class_new BETWEEN 43 AND 46",
    "R7": "elev IS NULL",
}


def drop_nonfinite(df: DataFrame, cols: Sequence[str], observe: str | None = None) -> DataFrame:
    """Rows whose columns are all finite; with `observe`, the number dropped is recorded under that name as the job runs."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & finite(F.col(c))
    d = df.withColumn("_ok", ok)
    if observe:
        d = d.observe(observe, F.count_if(~F.col("_ok")).alias("dropped"))
    return d.where("_ok").drop("_ok")


def apply_rules(df: DataFrame, rules: Mapping[str, str], scope: DataFrame | None = None, region: str = "region") -> DataFrame:
    """Adds hits, the names of the rules that a row breaks; `scope` (rule, region) says where a rule applies, everywhere if not listed."""
    names = list(rules)
    hit = F.array_compact(F.array(*(F.when(F.coalesce(F.expr(rules[n]), F.lit(False)), F.lit(n)) for n in names)))
    d = df.withColumn("hits", hit)
    if scope is None:
        return d
    allowed = scope.where(F.col("rule").isin(names)).groupBy("region").agg(F.collect_set("rule").alias("_here"))
    listed = scope.agg(F.collect_set("rule").alias("_listed"))
    d = d.join(F.broadcast(allowed.withColumnRenamed("region", region)), region, "left").join(F.broadcast(listed))
    here = F.coalesce("_here", F.array().cast("array<string>"))
    return d.withColumn("hits", F.filter("hits", lambda r: F.array_contains(here, r) | ~F.array_contains(F.col("_listed"), r))).drop("_here", "_listed")


def rule_counts(df: DataFrame) -> DataFrame:
    """(rule, n, n_overlap): rows a rule hits, and those that another rule hits too."""
    return df.select(F.explode("hits").alias("rule"), (F.size("hits") > 1).alias("more")).groupBy("rule").agg(F.count("*").alias("n"), F.count_if("more").alias("n_overlap"))


def verdict(hard: Column, soft: Column) -> Column:
    """keep, flag or quarantine; no row is lost."""
    return scalar.ladder([(hard, "quarantine"), (soft, "flag")], "keep")


def banded_verdict(score: Column, edges: Sequence[float] = (0.9, 0.7, 0.5, 0.3), names: str = "ABCDE") -> Column:
    """Review states A to E by falling score; a missing score goes to the last."""
    return scalar.ladder([(score >= e, n) for e, n in zip(edges, names, strict=False)], names[len(edges)])


def combine_sources(base: DataFrame, sources: Mapping[str, DataFrame], key: str, missing: int = -1) -> DataFrame:
    """Left joins of one-column sources (key, value); what a source lacks is `missing`, so no row is lost to another's gaps.

    Of a key's values in one source the smallest counts.
    """
    out = base
    for name, s in sources.items():
        out = out.join(s.groupBy(key).agg(F.min("value").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(missing)))
    return out


def apply_source_policy(df: DataFrame, source: str, relabel: int | None = None) -> DataFrame:
    """One row for each arm a row belongs to: R0 keeps all, R4 drops the source, R6 relabels it, R7 keeps only it."""
    own = F.col("src") == source
    arms = F.array_compact(F.array(F.lit("R0"), F.when(~own | own.isNull(), F.lit("R4")), F.lit("R6"), F.when(own, F.lit("R7"))))
    d = df.withColumn("arm", F.explode(arms))
    return d.withColumn("class_new", F.when((F.col("arm") == "R6") & own, F.lit(relabel)).otherwise(F.col("class_new"))) if relabel is not None else d


def fuse_evidence(df: DataFrame) -> DataFrame:
    """Adds fused, tier and reason from three labels (l1, l2, authority) and the flags doubt, soft, hard.

    A: two agree without doubt; B: they agree with an objection or soft ambiguity, or the regional authority settles a
    conflict; C: conflict without arbiter; D: hard ambiguity or no evidence.
    """
    agree, any_ = F.col("l1") == F.col("l2"), F.col("l1").isNotNull() | F.col("l2").isNotNull()
    settled = (F.col("authority") == F.col("l1")) | (F.col("authority") == F.col("l2"))
    rules = [(F.col("hard") | ~any_, "D", "none"), (agree & ~F.col("doubt") & ~F.col("soft"), "A", "agree"), (agree, "B", "objection"), (settled, "B", "authority"), (F.col("l1").isNotNull() & F.col("l2").isNotNull(), "C", "conflict")]
    tier, reason = (scalar.ladder([(r[0], r[k]) for r in rules], ("C", "single")[k - 1]) for k in (1, 2))
    fused = F.when(tier == "D", F.lit(None)).when(reason == "authority", F.col("authority")).otherwise(F.coalesce("l1", "l2"))
    return df.withColumns({"fused": fused, "tier": tier, "reason": reason})


def dedup(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


#: Rows that one window without partition may see, and rows of a range beyond that.
PLAIN, RANGE = 100_000, 250_000


def running(df: DataFrame, order: Sequence[str], sums: Mapping[str, Column], ranges: int | None = None) -> DataFrame:
    """Adds, for each name, the sum of a column over the rows before, in a total order, without one task for all rows.

    A range sort into parts that are numbered and written once; sums of the parts, added up; then running sums inside each
    part. There are as many parts as the rows ask for, so the table of their sums has a row for each `RANGE` rows; up to
    `PLAIN` rows take one window.
    """
    if ranges is None:
        n = df.count()
        ranges = -(-n // RANGE) if n > PLAIN else 0
    if not ranges:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})
    d = df.repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id())
    d = cut(d.withColumns({f"_v_{n}": c for n, c in sums.items()}))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy("_p").agg(*(F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums))
    parts = parts.select("_p", *(F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(F.broadcast(parts), "_p")
    return d.withColumns({n: F.col(f"_s_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums}).drop("_p", *(f"_{k}_{n}" for n in sums for k in "vs"))


def assign_ids(df: DataFrame, order: Sequence[str], name: str = "new_id", ranges: int | None = None) -> DataFrame:
    """Dense ids from 0 in a total order, without one task for all rows."""
    return running(df, order, {name: F.lit(1).cast("bigint")}, ranges)


def exclude(df: DataFrame, ids: DataFrame, coords: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows on neither list: by id, or by exact position."""
    return df.join(ids.select(key).distinct(), key, "left_anti").join(coords.select("lon", "lat").distinct(), ["lon", "lat"], "left_anti")


def exclusion_counts(df: DataFrame, ids: DataFrame, coords: DataFrame, key: str = "row_id") -> DataFrame:
    """(n, n_by_id, n_by_coord, n_left)."""
    d = df.join(ids.select(key, F.lit(True).alias("_i")).distinct(), key, "left").join(coords.select("lon", "lat", F.lit(True).alias("_c")).distinct(), ["lon", "lat"], "left")
    return d.agg(F.count("*").alias("n"), F.count("_i").alias("n_by_id"), F.count("_c").alias("n_by_coord"), F.count_if(F.col("_i").isNull() & F.col("_c").isNull()).alias("n_left"))


def whitelist_violations(df: DataFrame, allowed: DataFrame, region: str = "province") -> DataFrame:
    """Rows whose class has a whitelist (class_new, region) that does not hold their region."""
    ruled = allowed.select("class_new").distinct()
    return df.join(ruled, "class_new", "left_semi").join(allowed.select("class_new", F.col("region").alias(region)), ["class_new", region], "left_anti")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def split_check(original: DataFrame, *parts: DataFrame) -> DataFrame:
    """(n_missing, n_extra): multiset difference between a table and the union of its parts, in one aggregation."""
    signed = original.withColumn("_sign", F.lit(1).cast("bigint"))
    for p in parts:
        signed = signed.unionByName(p.withColumn("_sign", F.lit(-1).cast("bigint")))
    more = signed.groupBy(*original.columns).agg(F.sum("_sign").alias("_n"))
    count = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))), F.lit(0)).cast("bigint")
    return more.agg(count(F.col("_n")).alias("n_missing"), count(-F.col("_n")).alias("n_extra"))


def layers(main: Column, mixed: Column) -> Column:
    """Mutually exclusive output layers."""
    return scalar.ladder([(main, "main"), (mixed, "mixed")], "probability")


def overlaps(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(a, b, n): keys that two layers share; empty when they are disjoint."""
    d = None
    for name, p in parts.items():
        one = p.select(key).distinct().withColumn("layer", F.lit(name))
        d = one if d is None else d.unionByName(one)
    j = d.select(key, F.col("layer").alias("a")).join(d.select(key, F.col("layer").alias("b")), key).where("a < b")
    return j.groupBy("a", "b").agg(F.count("*").alias("n"))
