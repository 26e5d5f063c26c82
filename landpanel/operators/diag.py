"""Coverage, concentration, ledgers, gates and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, scalar
from .joins import nearest
from .quantiles import quantiles


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n"))


def years_by_chunk(index: DataFrame) -> DataFrame:
    return index.groupBy("chunk_id").agg(F.sort_array(F.collect_set("year")).alias("years"))


def source_concentration(df: DataFrame, share: float = 0.7) -> DataFrame:
    """(class_new, src, n, share): classes that take more than `share` of their points from one source."""
    c = df.groupBy("class_new", "src").agg(F.count("*").alias("n"))
    c = c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("class_new")))
    return c.where(F.col("share") > share)


def gini(counts: DataFrame, n: str = "n") -> DataFrame:
    """(groups, gini): by ranked cumulative sums over the distinct counts, so the window sees few rows."""
    c = counts.groupBy(F.col(n).alias("v")).agg(F.count("*").alias("k"))
    before = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    r = F.coalesce(F.sum("k").over(before), F.lit(0))
    # the ranks of the k equal values are r + 1 .. r + k
    d = c.withColumn("w", F.col("v") * (F.col("k") * r + F.col("k") * (F.col("k") + 1) / 2.0))
    d = d.agg(F.sum("k").alias("groups"), F.sum("w").alias("w"), F.sum(F.col("k") * F.col("v")).alias("total"))
    return d.select("groups", (2.0 * F.col("w") / (F.col("groups") * F.col("total")) - (F.col("groups") + 1.0) / F.col("groups")).alias("gini"))


def coverage_stats(points: DataFrame, block: Column) -> DataFrame:
    """(cells_1deg, max_per_quarter, gini): occupied 1 degree cells, most points in a 0.25 degree cell, evenness over blocks."""
    one = points.select(geo.cell(F.col("lon"), 1.0), geo.cell(F.col("lat"), 1.0)).distinct().agg(F.count("*").alias("cells_1deg"))
    quarter = points.groupBy(geo.cell(F.col("lon"), 0.25), geo.cell(F.col("lat"), 0.25)).count().agg(F.max("count").alias("max_per_quarter"))
    g = gini(points.groupBy(block.alias("b")).agg(F.count("*").alias("n"))).select("gini")
    return one.join(F.broadcast(quarter)).join(F.broadcast(g))  # one row each


def extremes(df: DataFrame, by: str, top: int = 5) -> DataFrame:
    """(largest, smallest, ratio, top_share, null_share) of the groups of a column."""
    c = df.groupBy(by).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    known = F.col(by).isNotNull()
    c = c.select(by, "n", total.alias("t"), F.row_number().over(Window.orderBy(F.desc("n"), by)).alias("r"))
    return c.agg(
        F.max(F.when(known, F.struct("n", by)))[by].alias("largest"), F.min(F.when(known, F.struct("n", by)))[by].alias("smallest"), F.try_divide(F.max(F.when(known, F.col("n"))), F.min(F.when(known, F.col("n")))).alias("ratio"),
        (F.sum(F.when(F.col("r") <= top, F.col("n"))) / F.max("t")).alias("top_share"), (F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)) / F.max("t")).alias("null_share"),
    )


def distance_profile(a: DataFrame, b: DataFrame, edges: Sequence[float] = (1.0, 5.0, 10.0)) -> DataFrame:
    """(n, median_km, under_1, under_5, under_10): distances to the nearest point of b."""
    d = nearest(a, b)  # rounds written to the shared folder
    half = quantiles(d, [], {"km": ("km", [0.5])}).select(F.get("p_km", F.lit(0)).alias("median_km"))
    shares = d.agg(F.count("*").alias("n"), *(F.avg((F.col("km") < e).cast("int")).alias(f"under_{e:g}") for e in edges))
    return shares.join(F.broadcast(half)).select("n", "median_km", *(f"under_{e:g}" for e in edges))  # one row each


def unit_coverage(tiles: DataFrame, points: DataFrame, positive: Column, key: str = "tile") -> DataFrame:
    """(tiles, any_share, both_share): tiles with a point and with points of both kinds, against all tiles."""
    have = points.groupBy(key).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_q"))
    d = tiles.select(key).distinct().join(have, key, "left")
    return d.agg(F.count("*").alias("tiles"), F.avg(F.col("_p").isNotNull().cast("int")).alias("any_share"), F.avg(F.coalesce((F.col("_p") > 0) & (F.col("_q") > 0), F.lit(False)).cast("int")).alias("both_share"))


def rejection_by_source(df: DataFrame, rejected: Column, main: str) -> DataFrame:
    """(src, n, rate, multiple): rejection rate of a source and its multiple of the main source's."""
    d = df.groupBy("src").agg(F.count("*").alias("n"), F.avg(rejected.cast("int")).alias("rate"))
    base = F.max(F.when(F.col("src") == main, F.col("rate"))).over(Window.partitionBy())
    return d.select("src", "n", "rate", F.try_divide("rate", base).alias("multiple"))


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]], by: list[str] | None = None) -> DataFrame:
    """Rows left after each stage, a column a stage, in one pass."""
    ok, cols = F.lit(True), [F.count("*").alias("n")]
    for name, c in stages:
        ok = ok & F.coalesce(c, F.lit(False))
        cols.append(F.count_if(ok).alias(name))
    return df.groupBy(*(by or [])).agg(*cols)


def ops_ledger(events: DataFrame) -> DataFrame:
    """(acct, n_proj, run, pend, suc, fail, hours, errs): states, hours of succeeded jobs only, the first three errors."""
    n = lambda s: F.count_if(F.col("state") == s)
    first = events.where(F.col("error").isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy("acct").orderBy("ts", "error"))).where("_n <= 3")
    errs = first.groupBy("acct").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "error"))), lambda x: x["error"]).alias("errs"))
    d = events.groupBy("acct").agg(F.count_distinct("project").alias("n_proj"), n("RUNNING").alias("run"), n("PENDING").alias("pend"), n("SUCCEEDED").alias("suc"), n("FAILED").alias("fail"), F.sum(F.when(F.col("state") == "SUCCEEDED", F.col("seconds") / 3600.0).otherwise(0.0)).alias("hours"))
    return d.join(errs, "acct", "left")


def budget(df: DataFrame, cost: str, cap: float, by: list[str] | None = None) -> DataFrame:
    """(by, n, total, mean, share_of_cap)."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sum(cost).alias("total"), F.avg(cost).alias("mean"), (F.sum(cost) / cap).alias("share_of_cap"))


def null_audit(df: DataFrame, cols: Sequence[str], most: float = 0.0) -> DataFrame:
    """(column, n_null, share, usable): regional counts are void if the region is partly null."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in cols))
    d = one.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in cols))).alias("x")).select("x.column", "x.n_null", F.try_divide("x.n_null", "n").alias("share"))
    return d.withColumn("usable", F.col("share") <= most)


def gate(checks: DataFrame) -> DataFrame:
    """Adds status to (name, value, least, hard): PASS, FAIL for hard checks, WARN for others."""
    return checks.withColumn("status", scalar.ladder([(F.col("value") >= F.col("least"), "PASS"), (F.col("hard"), "FAIL")], "WARN"))


def gate_summary(checks: DataFrame) -> DataFrame:
    g = gate(checks)
    n = lambda s: F.count_if(F.col("status") == s)
    return g.agg(n("PASS").alias("n_pass"), n("FAIL").alias("n_fail"), n("WARN").alias("n_warn"), (n("FAIL") == 0).alias("passed"))


def is_contiguous(df: DataFrame, by: list[str], n: str) -> DataFrame:
    """(by, contiguous): whether the numbers are first, first + 1, ... without gaps or repeats."""
    return df.groupBy(*by).agg(((F.max(n) - F.min(n) + 1 == F.count(n)) & (F.count_distinct(n) == F.count(n))).alias("contiguous"))


def todo(assigned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return assigned.join(done.select(key).distinct(), key, "left_anti")


def membership(df: DataFrame, years: Sequence[int], key: str = "row_id") -> DataFrame:
    """(key, in_<year> ...): in which years a point occurs."""
    return df.groupBy(key).agg(*(F.bool_or(F.col("year") == y).alias(f"in_{y}") for y in years))
