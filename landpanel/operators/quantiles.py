"""Exact quantiles of groups of any size in bounded memory, and mergeable sketches beside them.

A group of at most `most` values is left to the built-in percentile. In a larger one each wanted rank is enclosed: a sketch
of the values that are still inside gives a grid of bounds, the counts below and inside the bounds are exact, and the next
pass looks only inside. The grid's error is far below its step, so the bounds hold the rank; each pass leaves about a
hundredth, and when at most `most` values are left, or all that are left are equal, they give the answer. What a task
holds is a sketch or `most` values, whatever the size of the group and however its values are spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

MOST, GRID, ACCURACY = 200_000, 256, 20_000


def number(c: Column | str) -> Column:
    """The value as a double; NaN counts as missing."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


def quantiles(df: DataFrame, by: Sequence[str], values: Mapping[str, tuple[Column | str, Sequence[float]]], most: int = MOST) -> DataFrame:
    """(by, n_<name>, p_<name>) for {name: (value, shares)}: the count and the quantiles, by linear interpolation.

    Without `by` there is one row. A group of missing values alone has null for its quantiles.
    """
    by = list(by)
    held = df.select(*by, *(number(x).alias(f"_x_{n}") for n, (x, _) in values.items()))
    counts = [F.count(f"_x_{n}").alias(f"n_{n}") for n in values]
    exact = [F.percentile(f"_x_{n}", F.array(*map(F.lit, shares))).alias(f"p_{n}") for n, (_, shares) in values.items()]
    top = held.groupBy(*by).agg(*counts).agg(*(F.max(f"n_{n}") for n in values)).first()
    large = [n for n, k in zip(values, top, strict=True) if (k or 0) > most]
    if not large:
        return held.groupBy(*by).agg(*counts, *exact)
    n = cut(held.groupBy(*by).agg(*counts))
    out = n
    for name, (_, shares) in values.items():
        rows = held.select(*by, F.col(f"_x_{name}").alias("x")).where("x IS NOT NULL")
        size = n.select(*by, F.col(f"n_{name}").alias("n"))
        p = F.percentile("x", F.array(*map(F.lit, shares))).alias("p")
        if name not in large:
            found = rows.groupBy(*by).agg(p)
        else:
            big = cut(size.where(F.col("n") > most))
            found = enclosed(rows, big, by, shares, most)
            if by:
                found = joined(rows, size.where(F.col("n") <= most), by).groupBy(*by).agg(p).unionByName(found)
        found = found.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("p").alias(f"p_{name}"))
        on = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.lit(True))
        out = (out.join(found, on, "left") if by else out.join(F.broadcast(found), how="left")).drop(*(f"_{c}" for c in by))
    return out.select(*by, *(f"n_{n}" for n in values), *(f"p_{n}" for n in values))


def joined(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the columns of their group; null keys meet. One group alone is broadcast: it is one row."""
    if not by:
        return rows.join(F.broadcast(groups))
    g = groups.select(*(F.col(c).alias(f"_g_{c}") for c in by), *(c for c in groups.columns if c not in by))
    on = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by))
    return rows.join(g, on).drop(*(f"_g_{c}" for c in by))


def met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row of `a` with one of `b` for equal keys; nulls are equal."""
    there = b.select(*(F.col(c).alias(f"_m_{c}") for c in keys), *(c for c in b.columns if c not in keys))
    return a.join(there, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in keys))).drop(*(f"_m_{c}" for c in keys))


def enclosed(rows: DataFrame, groups: DataFrame, by: list[str], shares: Sequence[float], most: int) -> DataFrame:
    """(by, p) of the groups (by, n), which have more than `most` values x each.

    Every share asks for the values of two ranks, r and the next. The values strictly between lo and hi (null: no bound)
    may be of rank r; `below` is the number of values that are not above lo.
    """
    key, n = [*by, "t"], F.col("n")
    place = lambda s: F.lit(float(s)) * (n - 1)
    ranks = [F.struct(F.lit(2 * i + side).alias("t"), F.least(n - 1, F.floor(place(s)).cast("bigint") + side).alias("r")) for i, s in enumerate(shares) for side in (0, 1)]
    state = groups.select(*by, n, F.explode(F.array(*ranks)).alias("w")).select(*by, "w.t", "w.r", F.lit(0).cast("bigint").alias("below"), n.alias("inside"))
    state = cut(state.withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")}))
    share, told = F.array(*(F.lit(i / GRID) for i in range(GRID + 1))), None
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    inside = (lo.isNull() | (x > lo)) & (hi.isNull() | (x < hi))
    while True:
        todo = cut(state.where(F.col("inside") > most))
        if todo.isEmpty():
            break
        grid = joined(rows, todo, by).where(inside).groupBy(*key).agg(F.percentile_approx("x", share, F.lit(ACCURACY)).alias("grid"))
        at = (F.col("r") - F.col("below")) / F.col("inside") * GRID
        # two steps before the rank and after it: one for the rank's own place, one for the sketch's error
        first, after = F.floor(at).cast("int") - 1, F.ceil(at).cast("int") + 1
        new = met(todo, grid, key).select(*key, "r", F.when(first < 0, lo).otherwise(F.get("grid", first)).alias("lo"), F.when(after > GRID, hi).otherwise(F.get("grid", after)).alias("hi"))
        new = cut(new)
        n_of = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
        counted = joined(rows, new.drop("r"), by).groupBy(*key).agg(n_of(x < lo, "under"), n_of(x == lo, "at_lo"), n_of(inside, "inside"), n_of((x == hi) & ((hi != lo) | lo.isNull()), "at_hi"))
        new = cut(met(new, counted, key).withColumn("below", F.col("under") + F.col("at_lo")))
        left = F.col("r") - F.col("under")
        value = F.when((left >= 0) & (left < F.col("at_lo")), lo).when((left >= F.col("at_lo") + F.col("inside")) & (left < F.col("at_lo") + F.col("inside") + F.col("at_hi")), hi)
        if not new.where((left < 0) | (left >= F.col("at_lo") + F.col("inside") + F.col("at_hi"))).isEmpty():
            raise ArithmeticError("a sketch missed its rank")
        found = new.where(value.isNotNull()).select(*key, value.alias("v"))
        told = found if told is None else told.unionByName(found)
        state = cut(state.where(F.col("inside") <= most).unionByName(new.where(value.isNull()).select(state.columns)))
    few = joined(rows, state, by).where(inside).groupBy(*key, "r", "below").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    few = few.select(*key, F.get("xs", (F.col("r") - F.col("below")).cast("int")).alias("v"))
    told = few if told is None else told.unionByName(few)
    ends = joined(told.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("m")), groups, by)
    between = []
    for i, s in enumerate(shares):
        a, b = F.col("m")[2 * i], F.col("m")[2 * i + 1]
        low = F.floor(place(s))
        between.append(F.when((place(s) == low) | (a == b), a).otherwise((low + 1 - place(s)) * a + (place(s) - low) * b))
    return ends.select(*by, F.array(*between).alias("p"))


def sketches(df: DataFrame, by: Sequence[str], value: Column | str, k: int = 400) -> DataFrame:
    """(by, n, sketch): a KLL sketch of each group's values. Sketches of parts, days or shards can be kept and merged later."""
    x = number(value)
    return df.select(*by, x.alias("_x")).groupBy(*by).agg(F.count("_x").alias("n"), F.kll_sketch_agg_double("_x", F.lit(k)).alias("sketch"))


def merged(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, sketch) of the groups that `by` puts together."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def estimated(parts: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Adds p: the quantiles that each sketch estimates, null for a group without values."""
    return parts.withColumn("p", F.when(F.col("n") > 0, F.array(*(F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))) for s in shares))))
