"""Grids: thinning, focal statistics, resampling, areas and seams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.shared import cut
from . import raster
from .joins import KM_PER_DEG, seeded


def cell_dedup(df: DataFrame, deg: float = 0.005, key: str = "row_id") -> DataFrame:
    """One point a cell, first in the seeded order. Points of two cells may still be close."""
    w = Window.partitionBy("_x", "_y").orderBy(seeded(key), key)
    d = df.withColumns({"_x": geo.cell(F.col("lon"), deg), "_y": geo.cell(F.col("lat"), deg)})
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_x", "_y", "_n")


def thin(df: DataFrame, km: float = 0.25, key: str = "row_id") -> DataFrame:
    """Points no two of which are within `km`: what a greedy pass in the seeded order would keep, found in parallel.

    Two points of one cell are always within `km`, so a cell keeps one point at most. In each round the first point of
    each cell stays if it comes before the first ones of all cells that hold points within `km` of the cell, and the
    points within `km` of it go. No pairs of points are written out: a point meets at most one kept point of each cell
    around. Rows without a position stay.
    """
    side = min(180.0, km / KM_PER_DEG * 0.999 / math.sqrt(2))
    there = (F.abs("lon") < 1e6) & (F.abs("lat") <= 90.0)
    y = F.floor((F.col("lat") + 90.0) / side).cast("bigint")
    low = y * side - 90.0
    wide = F.when((low <= 0) & (low + side >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(low + side)))
    # cells are no wider than high at their widest; how many columns a row of cells has
    columns = lambda w: F.greatest(F.lit(1), F.ceil(360.0 * F.cos(F.radians(w)) / side)).cast("bigint")
    x = F.least(columns(wide) - 1, F.floor(F.pmod(F.col("lon") + 180.0, F.lit(360.0)) / 360.0 * columns(wide)).cast("bigint"))
    p = df.where(there).select(F.col(key).alias("id"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.struct(seeded(key).alias("o"), F.col(key).alias("id")).alias("first"), x.alias("x"), y.alias("y"))
    alive, kept = cut(p), None
    last = math.ceil(180.0 / side)
    rows = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("y") - 2), F.least(F.lit(last).cast("bigint"), F.col("y") + 2))
    reach = min(km / KM_PER_DEG, 180.0) + 1e-9

    def around(lo_lon: Column, hi_lon: Column, far: Column) -> Column:
        """The cells of the rows around that a circle of `km` about points between two longitudes can meet."""
        turn = F.when(far + reach >= 90.0, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(reach, 90.0)))) / F.cos(F.radians(far))))) + 1e-9)

        def across(r: Column) -> Column:
            a = r * side - 90.0
            n = columns(F.when((a <= 0) & (a + side >= 0), F.lit(0.0)).otherwise(F.least(F.abs(a), F.abs(a + side))))
            at = lambda v: F.floor((v + 180.0) / 360.0 * n).cast("bigint")
            left, right = at(lo_lon - turn), at(hi_lon + turn)
            xs = F.when(right - left + 1 >= n, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.transform(F.sequence(left, F.greatest(left, right)), lambda v: F.pmod(v, n)))
            return F.transform(xs, lambda v: F.struct(v.alias("x"), r.alias("y")))

        return F.array_distinct(F.flatten(F.transform(rows, across)))

    own = F.col("lon")
    while not alive.isEmpty():
        cells = cut(alive.groupBy("x", "y").agg(F.min(F.struct("first", "id", "lon", "lat")).alias("m")))
        cell_low = F.col("y") * side - 90.0
        w = F.when((cell_low <= 0) & (cell_low + side >= 0), F.lit(0.0)).otherwise(F.least(F.abs(cell_low), F.abs(cell_low + side)))
        west, width = F.col("x") * 360.0 / columns(w) - 180.0, 360.0 / columns(w)
        told = cells.select("m.first", F.explode(around(west, west + width, F.greatest(F.abs(cell_low), F.abs(cell_low + side)))).alias("c")).groupBy("c.x", "c.y").agg(F.min("first").alias("least"))
        stay = cut(cells.join(told, ["x", "y"]).where(F.col("least") >= F.col("m.first")).select("m.id", "m.lon", "m.lat", "y"))
        kept = stay.select("id") if kept is None else kept.unionByName(stay.select("id"))
        near = stay.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.explode(around(own, own, F.abs("lat"))).alias("c")).select("_lon", "_lat", "c.x", "c.y")
        gone = alive.join(near, ["x", "y"]).where(geo.haversine_km(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")) <= km).select("id")
        alive = cut(alive.join(gone.unionByName(stay.select("id")), "id", "left_anti").select(alive.columns))
    placeless = df.where(~F.coalesce(there, F.lit(False)))
    return placeless if kept is None else df.join(kept.withColumnRenamed("id", key), key, "left_semi").unionByName(placeless)


def focal(grid: DataFrame, radius: int = 1, code: int | None = None) -> DataFrame:
    """(row, col, code, n, same, share): neighbours inside the grid, those of the same code, and their share; with `code`, the share of that code."""
    d = raster.square_windows(grid, [radius], code).withColumnsRenamed({f"n_{radius}": "n", f"same_{radius}": "same"})
    return d.withColumn("share", F.col("same") / F.col("n"))


def purity(grid: DataFrame, inner: int = 1, outer: int = 4, share: float = 0.7) -> DataFrame:
    """Cells whose inner window is all of one code and whose outer window has at least `share` of it; both in one pass."""
    d = raster.square_windows(grid, [inner, outer])
    return d.where((F.col(f"n_{inner}") == F.col(f"same_{inner}")) & (F.col(f"same_{outer}") / F.col(f"n_{outer}") >= share)).select("row", "col", "code")


def downsample_nearest(grid: DataFrame, factor: int) -> DataFrame:
    """One source cell, the one at the middle, for each factor x factor target cell."""
    mid = factor // 2
    return grid.where((F.pmod("row", F.lit(factor)) == mid) & (F.pmod("col", F.lit(factor)) == mid)).select(F.floor(F.col("row") / factor).cast("bigint").alias("row"), F.floor(F.col("col") / factor).cast("bigint").alias("col"), "code")


def area_by_class(grid: DataFrame, deg: float, lat: Column) -> DataFrame:
    """(code, pixels, km2): a pixel's area follows from its latitude."""
    return grid.groupBy("code").agg(F.count("*").alias("pixels"), F.sum(geo.pixel_km2(lat, deg)).alias("km2"))


def coverage_dual(grid: DataFrame, hit: Column, deg: float, lat: Column) -> DataFrame:
    """(pixel_share, km2_share)."""
    a = geo.pixel_km2(lat, deg)
    return grid.agg(F.avg(hit.cast("int")).alias("pixel_share"), F.try_divide(F.sum(F.when(hit, a).otherwise(0.0)), F.sum(a)).alias("km2_share"))


def seam_ratio(grid: DataFrame, tile: int) -> DataFrame:
    """(edge, inside, ratio): disagreement of neighbours to the right and below, across tile edges and inside tiles."""
    shifted = grid.select("row", (F.col("col") - 1).alias("col"), F.col("code").alias("other"), F.lit("h").alias("d")).unionByName(grid.select((F.col("row") - 1).alias("row"), "col", F.col("code").alias("other"), F.lit("v").alias("d")))
    j = grid.join(shifted, ["row", "col"])
    edge = F.pmod(F.when(F.col("d") == "h", F.col("col")).otherwise(F.col("row")), F.lit(tile)) == tile - 1
    bad = (F.col("code") != F.col("other")).cast("int")
    d = j.agg(F.avg(F.when(edge, bad)).alias("edge"), F.avg(F.when(~edge, bad)).alias("inside"))
    return d.withColumn("ratio", F.try_divide("edge", "inside"))
