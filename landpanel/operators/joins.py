"""Joins on keys, positions and distance. Distance joins meet on grid cells, so no plan compares all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.shared import cut

KM_PER_DEG = geo.EARTH_KM * math.pi / 180
HALF_ROUND_KM = geo.EARTH_KM * math.pi


def one_row(df: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """One row of each key: the first by `order`, nulls last, then by the other columns, so the same in every run."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    first = [F.struct(F.col(c).isNull(), F.col(c)) for c in order or []]
    least = F.min(F.struct(*(x.alias(f"_o{k}") for k, x in enumerate(first)), *rest)).alias("_r")
    return df.groupBy(*key).agg(least).select(*(F.col(c) if c in key else F.col(f"_r.`{c}`").alias(c) for c in df.columns))


def recover_ids(pool: DataFrame, library: DataFrame, digits: int | None = None) -> DataFrame:
    """Left join on exact (lon, lat), or on positions rounded to `digits`; the library's columns win, matched tells misses.

    Of library rows on one position the one with the smallest row_id is taken.
    """
    k = (lambda c: F.col(c)) if digits is None else (lambda c: F.round(c, digits).cast("decimal(12,7)"))
    lib = one_row(library.withColumns({"_x": k("lon"), "_y": k("lat")}), ["_x", "_y"], [c for c in ("row_id",) if c in library.columns]).drop("lon", "lat").withColumn("matched", F.lit(True))
    own = [c for c in pool.columns if c in ("lon", "lat") or c not in lib.columns]
    return pool.select(*own).withColumns({"_x": k("lon"), "_y": k("lat")}).join(lib, ["_x", "_y"], "left").drop("_x", "_y").withColumn("matched", F.coalesce("matched", F.lit(False)))


def lookup(df: DataFrame, dim: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """N:1 even if the dimension repeats keys: its first row by `order` counts; adaptive execution broadcasts it when small."""
    return df.join(one_row(dim, key, order), key, "left")


def ns_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (ns, row_id)."""
    return a.join(b, ["ns", "row_id"], how)


def assert_unique(df: DataFrame, key: list[str]) -> None:
    if not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} does not identify rows")


def assert_aligned(a: DataFrame, b: DataFrame, key: str = "row_id", value: str = "lon") -> DataFrame:
    """(n, n_mismatch): rows missing on one side or different in `value`."""
    j = a.select(key, F.col(value).alias("_a"), F.lit(1).alias("_l")).join(b.select(key, F.col(value).alias("_b"), F.lit(1).alias("_r")), key, "full")
    bad = F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))
    return j.agg(F.count("*").alias("n"), F.count_if(bad).alias("n_mismatch"))


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(column, n_both, n_left_only, n_right_only, max_abs_diff)."""
    j = a.select(*keys, *(F.col(v).alias(f"_a_{v}") for v in values), F.lit(1).alias("_l")).join(b.select(*keys, *(F.col(v).alias(f"_b_{v}") for v in values), F.lit(1).alias("_r")), keys, "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    one = j.agg(F.count_if(both).alias("n_both"), F.count_if(F.col("_r").isNull()).alias("n_left_only"), F.count_if(F.col("_l").isNull()).alias("n_right_only"), *(F.max(F.abs(F.col(f"_a_{v}") - F.col(f"_b_{v}"))).alias(f"_{v}") for v in values))
    return one.select(F.explode(F.array(*(F.struct(F.lit(v).alias("column"), F.col(f"_{v}").cast("double").alias("max_abs_diff")) for v in values))).alias("x"), "n_both", "n_left_only", "n_right_only").select("x.column", "n_both", "n_left_only", "n_right_only", "x.max_abs_diff")


def panel_of(points: DataFrame, years: list[int], values: DataFrame) -> DataFrame:
    """Points x years with the values that exist; completeness is the share of non-null values."""
    return points.withColumn("year", F.explode(F.array(*map(F.lit, years)))).join(values, ["row_id", "year"], "left")


def newest_after(a: DataFrame, b: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, last, newest_ts, newest): each key's last change in `a`, and the newest record of `b` later than it."""
    last = a.groupBy(key).agg(F.max(ts).alias("last"))
    later = b.select(key, F.col(ts).alias("_t"), F.col(value).alias("_v")).join(last, key).where(F.col("_t") > F.col("last"))
    best = later.groupBy(key).agg(F.max(F.struct("_t", "_v")).alias("_b"))
    return last.join(best, key, "left").select(key, "last", F.col("_b._t").alias("newest_ts"), F.col("_b._v").alias("newest"))


def columns_of(row: Column, size: float) -> Column:
    """How many cells a row of the globe has: cells are `size` degrees high and at least as wide on the ground at their narrow end."""
    low = row * size - 90.0
    far = F.least(F.lit(90.0), F.greatest(F.abs(low), F.abs(low + size)))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(far)) / size)).cast("bigint")


def cell_of(lon: Column, lat: Column, size: float) -> Column:
    """The cell (x, y) that holds a point; x runs round the globe, so 180 W and 180 E are neighbours."""
    y = F.floor((lat + 90.0) / size).cast("bigint")
    n = columns_of(y, size)
    return F.struct(F.least(n - 1, F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n)).cast("bigint").alias("x"), y.alias("y"))


def near_cells(west: Column, east: Column, south: Column, north: Column, km: float, size: float) -> Column:
    """All cells within km of a box. The reach in longitude is that of a circle on the sphere; where it holds a pole, it is all round."""
    d = min(km / KM_PER_DEG, 180.0) + 1e-9
    top = F.greatest(F.abs(south), F.abs(north))
    reach = F.when(top + d >= 90.0, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(d, 90.0)))) / F.cos(F.radians(top))))) + 1e-9)
    last = math.floor(180.0 / size)
    rows = F.sequence(F.greatest(F.lit(0), F.floor((south - d + 90.0) / size)).cast("bigint"), F.least(F.lit(last), F.floor((north + d + 90.0) / size)).cast("bigint"))

    def across(y: Column) -> Column:
        n = columns_of(y, size)
        at = lambda x: F.floor((x + 180.0) / 360.0 * n).cast("bigint")
        a, b = at(west - reach), at(east + reach)
        xs = F.when(b - a + 1 >= n, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.transform(F.sequence(a, F.greatest(a, b)), lambda x: F.pmod(x, n)))
        return F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))

    return F.flatten(F.transform(rows, across))


def in_cells(d: DataFrame, key: str, name: str, lon: str, lat: str, km: float, deal: bool) -> DataFrame:
    """(name, lon, lat, _x, _y): rows with a position in their cell, or dealt to all cells within `km`."""
    size = min(180.0, max(km / KM_PER_DEG, 1e-6))
    x, y = F.col("lon"), F.col("lat")
    cells = F.explode(near_cells(x, x, y, y, km, size)) if deal else cell_of(x, y, size)
    d = d.where((F.abs(x) < 1e6) & (F.abs(y) <= 90.0)).select(F.col(key).alias(name), x.alias(lon), y.alias(lat), cells.alias("_c"))
    return d.select(name, lon, lat, F.col("_c.x").alias("_x"), F.col("_c.y").alias("_y"))


def sure_cell(lon: Column, lat: Column, km: float) -> Column:
    """The cell of a point, a third of `km` high, if any two points in it are within `km` by its sides alone; else null."""
    size = km / KM_PER_DEG / 3
    cell = cell_of(lon, lat, size)
    low = cell["y"] * size - 90.0
    near = F.when((low <= 0.0) & (low + size >= 0.0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(low + size)))
    wide = F.lit(360.0) / columns_of(cell["y"], size) * F.cos(F.radians(near))
    return F.when((wide + size) * KM_PER_DEG <= km * (1 - 1e-9), cell)


def near_any(a: DataFrame, b: DataFrame, km: float, a_key: str = "a_id", b_key: str = "b_id") -> DataFrame:
    """(a_key) of the rows of `a` that have a row of `b` within `km`: a semi join, which ends at a row's first hit and writes out no pairs.

    Rows whose small cell holds a row of `b` are done without a distance; those left are measured against the rows of `b`
    that can be near them.
    """
    found = None
    if km > 1e-3:
        held = lambda d: d.where((F.abs("lon") < 1e6) & (F.abs("lat") <= 90.0)).withColumn("_s", sure_cell(F.col("lon"), F.col("lat"), km))
        full = cut(held(b.select("lon", "lat")).where("_s IS NOT NULL").select("_s").distinct())
        own = held(a.select(a_key, "lon", "lat"))
        found = own.join(full, "_s", "left_semi").select(a_key)
        a = cut(own.join(full, "_s", "left_anti").drop("_s"))
        if a.isEmpty():
            return found
    left = in_cells(a, a_key, a_key, "_lon", "_lat", km, False)
    right = in_cells(b, b_key, "_b", "_lon2", "_lat2", km, True).withColumnsRenamed({"_x": "_x2", "_y": "_y2"})
    if found is not None:
        right = right.join(left.select(F.col("_x").alias("_x2"), F.col("_y").alias("_y2")).distinct(), ["_x2", "_y2"], "left_semi")
    close = geo.haversine_km(F.col("_lon"), F.col("_lat"), F.col("_lon2"), F.col("_lat2")) <= km
    far = left.join(right, (F.col("_x") == F.col("_x2")) & (F.col("_y") == F.col("_y2")) & close, "left_semi").select(a_key)
    return far if found is None else found.unionByName(far)


def within_km(a: DataFrame, b: DataFrame, km: float, a_key: str = "a_id", b_key: str = "b_id", deal: str = "b") -> DataFrame:
    """(a_id, b_id, km) of all pairs at most `km` apart: the side named by `deal` is dealt to the cells it can reach, the other stands in one cell.

    Rows without a finite position have no pairs.
    """
    left, right = (in_cells(d, k, n, x, y, km, deal == n[0]) for d, k, n, x, y in ((a, a_key, "a_id", "_lon", "_lat"), (b, b_key, "b_id", "_lon2", "_lat2")))
    j = left.join(right, ["_x", "_y"])
    j = j.withColumn("km", geo.haversine_km(F.col("_lon"), F.col("_lat"), F.col("_lon2"), F.col("_lat2")))
    return j.where(F.col("km") <= km).select("a_id", "b_id", "km")


def min_distance_from(a: DataFrame, b: DataFrame, km: float, a_key: str = "a_id", b_key: str = "b_id") -> DataFrame:
    """Rows of `a` that are farther than `km` from every row of `b`."""
    return a.join(near_any(a, b, km, a_key, b_key), a_key, "left_anti")


def nearest(a: DataFrame, b: DataFrame, km: float = 25.0, grow: float = 4.0, a_key: str = "a_id", b_key: str = "b_id") -> DataFrame:
    """(a_id, b_id, km): the nearest row of b, the smaller id at a tie. Rings grow until every row is served; nothing if b is empty.

    A row served within a ring is done, since the ring holds all that is nearer. The rows not yet served, fewer in each
    round, are dealt to the cells; those of b stand in one cell each. Rounds are cut to the shared folder.
    """
    left, found = cut(a.select(F.col(a_key).alias("a_id"), "lon", "lat").where((F.abs("lon") < 1e6) & (F.abs("lat") <= 90.0))), None
    while True:
        hit = cut(within_km(left, b, km, "a_id", b_key, deal="a").groupBy("a_id").agg(F.min(F.struct("km", "b_id")).alias("m")).select("a_id", "m.b_id", "m.km"))
        found = hit if found is None else found.unionByName(hit)
        left = cut(left.join(hit, "a_id", "left_anti"))
        if km > HALF_ROUND_KM or left.isEmpty():
            return found
        km *= grow


def borrow(tiles: DataFrame, points: DataFrame, margin: float = 2.0, k: int = 20000, deg: float = 2.0) -> DataFrame:
    """(tx, ty, row_id): for each tile the points in its box widened by `margin`, at most k in a seeded order.

    Each point is dealt to the tiles it can serve; tiles and points meet on the tile.
    """
    lo, hi = (lambda c, o: geo.cell(F.col(c) - o - margin, deg)), (lambda c, o: geo.cell(F.col(c) - o + margin, deg))
    p = points.withColumn("tx", F.explode(F.sequence(lo("lon", 73.0), hi("lon", 73.0)))).withColumn("ty", F.explode(F.sequence(lo("lat", 18.0), hi("lat", 18.0))))
    j = p.join(tiles.select("tx", "ty").distinct(), ["tx", "ty"])
    w = Window.partitionBy("tx", "ty").orderBy(seeded("row_id"), "row_id")
    return j.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select("tx", "ty", "row_id")


def seeded(key: str, seed: int = 0) -> Column:
    """A fixed scattered order that any engine can compute."""
    return F.pmod((F.pmod(F.col(key).cast("bigint"), F.lit(2147483647)) + F.lit(seed)) * F.lit(2654435761), F.lit(2147483647))


def edges_of(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """(region, x1, y1, x2, y2) from (region, ring: array of (x, y)), the last corner joined to the first.

    A region may have several rows: rings inside others are holes. A ring may cross 180 degrees, written with longitudes
    that run on (170, 190) or jump (170, -170): steps of more than 180 degrees are taken the short way round.
    """
    step = lambda at, x: at + F.pmod(x - at + 180.0, F.lit(360.0)) - 180.0
    start = F.struct(F.element_at(ring, 1)["x"].cast("double").alias("x"), F.array().cast("array<struct<x:double,y:double>>").alias("done"))
    on = F.aggregate(ring, start, lambda s, p: F.struct(step(s["x"], p["x"].cast("double")).alias("x"), F.concat(s["done"], F.array(F.struct(step(s["x"], p["x"].cast("double")).alias("x"), p["y"].cast("double").alias("y")))).alias("done")), lambda s: s["done"])
    jumps = F.exists(F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: F.abs(q["x"] - p["x"])), lambda d: d > 180.0)
    plain = F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    d = polygons.where(F.size(ring) > 0).select("region", F.when(jumps, on).otherwise(plain).alias("_ring"))
    nxt = F.concat(F.slice("_ring", F.lit(2), F.greatest(F.size("_ring") - 1, F.lit(0))), F.slice("_ring", F.lit(1), F.lit(1)))
    e = d.select("region", F.explode(F.arrays_zip(F.col("_ring").alias("a"), nxt.alias("b"))).alias("e"))
    return e.select("region", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def edge_foot(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The place on an edge that is nearest to a point, in the plane in which a degree of longitude is as long as at the point."""
    k = F.cos(F.radians(lat))
    dx, dy = (x2 - x1) * k, y2 - y1
    t = F.coalesce(F.try_divide((lon - x1) * k * dx + (lat - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return x1 + t * (x2 - x1), y1 + t * (y2 - y1)


def cells_of_edge(km: float, size: float) -> Column:
    """All cells within km of an edge: the edge is cut into pieces of at most `size` degrees."""
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / size).cast("int"))

    def around(i: Column) -> Column:
        at = lambda a, b, j: F.col(a) + (F.col(b) - F.col(a)) * j / n
        xa, xb, ya, yb = at("x1", "x2", i), at("x1", "x2", i + 1), at("y1", "y2", i), at("y1", "y2", i + 1)
        return near_cells(F.least(xa, xb), F.greatest(xa, xb), F.least(ya, yb), F.greatest(ya, yb), km, size)

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), around)))


def nearest_edge(a: DataFrame, edges: DataFrame, km: float = 50.0, grow: float = 4.0) -> DataFrame:
    """(row_id, region, km) for each row (row_id, lon, lat): the region of the nearest edge, to a millimetre, the smaller one at a tie.

    Edges are dealt to the cells within `km` of them; rings grow until every row is served. An edge may lie across 180
    degrees from a point: it is measured from the point's own side. Nothing if there are no edges.
    """
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    lon, lat = F.col("lon"), F.col("lat")
    left, found = cut(a.select("row_id", "lon", "lat").where((F.abs(lon) < 1e6) & (F.abs(lat) <= 90.0))), None
    while True:
        size = min(180.0, max(km / KM_PER_DEG, 1e-6))
        e = edges.select("region", *ends, F.explode(cells_of_edge(km, size)).alias("_c")).select("region", *ends, F.col("_c.x").alias("_x"), F.col("_c.y").alias("_y"))
        cell = cell_of(lon, lat, size)
        j = left.withColumns({"_x": cell["x"], "_y": cell["y"]}).join(e, ["_x", "_y"])
        turns = F.round((F.col("x1") + F.col("x2") - 2 * lon) / 720.0) * 360.0
        j = j.withColumn("km", geo.haversine_km(lon, lat, *edge_foot(lon, lat, F.col("x1") - turns, F.col("y1"), F.col("x2") - turns, F.col("y2")))).where(F.col("km") <= km)
        hit = cut(j.groupBy("row_id").agg(F.min(F.struct(F.round("km", 6).alias("km"), "region")).alias("m")).select("row_id", "m.region", "m.km"))
        found = hit if found is None else found.unionByName(hit)
        left = cut(left.join(hit, "row_id", "left_anti"))
        if km > HALF_ROUND_KM or left.isEmpty():
            return found
        km *= grow


#: Sides of the cells of a cover in degrees, each a whole number of the next.
COVER = (30.0, 6.0, 1.5, 0.375, 0.09375)


def crossings(px: Column, py: Column, right: Column, low: Column) -> Column:
    """How often the edge (x1, y1, x2, y2) is crossed on the way from a point east to `right`, then south to `low`."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    at_y = x1 + (x2 - x1) * F.try_divide(py - y1, y2 - y1)
    at_x = y1 + (y2 - y1) * F.try_divide(right - x1, x2 - x1)
    east = ((y1 > py) != (y2 > py)) & (px < at_y) & (at_y <= right)
    south = ((x1 > right) != (x2 > right)) & (low < at_x) & (at_x <= py)
    return F.coalesce(east.cast("int"), F.lit(0)) + F.coalesce(south.cast("int"), F.lit(0))


def touches(west: Column, south: Column, size: float) -> Column:
    """Whether the edge may meet a cell: its part in the cell's latitudes reaches into its longitudes."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    pad = 1e-9
    lo, hi = F.greatest(F.least(y1, y2), south - pad), F.least(F.greatest(y1, y2), south + size + pad)
    at = lambda y, other: F.coalesce(x1 + (x2 - x1) * F.try_divide(y - y1, y2 - y1), other)
    a, b = at(lo, x1), at(hi, x2)
    return (lo <= hi) & (F.least(a, b) <= west + size + pad) & (F.greatest(a, b) >= west - pad)


def polygon_cover(edges: DataFrame, most: int = 32) -> DataFrame:
    """(level, x, y, region, odd, edges): the cells of COVER that polygons fill (no edges) or whose edges must be tested.

    A cell is divided while more than `most` edges meet it. Whether its south-east corner is inside (odd) follows from its
    parent's corner and the edges of the parent that lie between, so each level is one aggregation over edges and the
    cells they meet. Polygons that reach over 180 degrees stand on both sides. Parity makes holes of inner rings.
    """
    reach = edges.groupBy("region").agg(F.min(F.least("x1", "x2")).alias("_w"), F.max(F.greatest("x1", "x2")).alias("_e"))
    turns = F.array_compact(F.array(F.lit(0.0), F.when(F.col("_w") < -180.0, F.lit(360.0)), F.when(F.col("_e") >= 180.0, F.lit(-360.0))))
    here = edges.join(reach, "region").withColumn("_t", F.explode(turns)).select("region", (F.col("x1") + F.col("_t")).alias("x1"), "y1", (F.col("x2") + F.col("_t")).alias("x2"), "y2")
    up, corner_x, corner_y = None, F.lit(1000.0), F.lit(-1000.0)  # the first corner is outside everything
    done = None
    for level, size in enumerate(COVER):
        if level == 0:
            xs, ys = F.array(*map(F.lit, range(round(360 / size)))), F.array(*map(F.lit, range(round(180 / size))))
            cells = here.withColumn("_x", F.explode(xs)).withColumn("_y", F.explode(ys))
        else:
            times = round(COVER[level - 1] / size)
            steps = F.array(*map(F.lit, range(times)))
            corner_x, corner_y = (F.col("_px") + 1) * COVER[level - 1] - 180.0, F.col("_py") * COVER[level - 1] - 90.0
            cells = here.withColumn("_x", F.explode(F.transform(steps, lambda k: F.col("_px") * times + k))).withColumn("_y", F.explode(F.transform(steps, lambda k: F.col("_py") * times + k)))
        west, south = F.col("_x") * size - 180.0, F.col("_y") * size - 90.0
        cells = cells.withColumns({"_cross": crossings(west + size, south, corner_x, corner_y), "_meets": touches(west, south, size)})
        keys = ["region", "_x", "_y"]
        of = cells.groupBy(*keys).agg(F.sum("_cross").alias("c"), F.count_if("_meets").alias("n"))
        if up is not None:
            times = round(COVER[level - 1] / size)
            of = of.withColumns({"_px": F.floor(F.col("_x") / times).cast("int"), "_py": F.floor(F.col("_y") / times).cast("int")}).join(up, ["region", "_px", "_py"])
        odd = (F.col("c") + (F.col("_odd").cast("int") if up is not None else F.lit(0))) % 2 == 1
        of = cut(of.select(*keys, "n", odd.alias("odd")).where("n > 0 OR odd"))
        last = level == len(COVER) - 1
        split = (F.col("n") > most) & F.lit(not last)
        held = cells.where("_meets").join(of.where((F.col("n") > 0) & ~split), keys).groupBy(*keys, "odd").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
        full = of.where("n = 0").select(*keys, "odd", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>").alias("edges"))
        found = full.unionByName(held).select(F.lit(level).alias("level"), F.col("_x").alias("x"), F.col("_y").alias("y"), "region", "odd", "edges")
        done = found if done is None else done.unionByName(found)
        more = of.where(split).select("region", F.col("_x").alias("_px"), F.col("_y").alias("_py"), F.col("odd").alias("_odd"))
        if last or more.isEmpty():
            return done
        up = cut(more)
        here = cut(cells.where("_meets").select("region", "x1", "y1", "x2", "y2", F.col("_x").alias("_px"), F.col("_y").alias("_py")).join(up.drop("_odd"), ["region", "_px", "_py"]))
    return done


def inside_regions(points: DataFrame, edges: DataFrame, most: int = 32) -> DataFrame:
    """(row_id, region) of all polygons that hold a point: the point's cell of each level is joined to the cover."""
    lon = F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0
    p = points.where((F.abs("lon") < 1e6) & (F.abs("lat") <= 90.0)).select("row_id", lon.alias("lon"), F.col("lat").cast("double").alias("lat"))
    at = lambda c, o, size, n: F.least(F.lit(n - 1), F.floor((F.col(c) + o) / size).cast("int"))
    keys = [F.struct(F.lit(k).alias("level"), at("lon", 180.0, size, round(360 / size)).alias("x"), at("lat", 90.0, size, round(180 / size)).alias("y")) for k, size in enumerate(COVER)]
    j = p.withColumn("_k", F.explode(F.array(*keys))).select("row_id", "lon", "lat", "_k.level", "_k.x", "_k.y").join(polygon_cover(edges, most), ["level", "x", "y"])
    size = F.element_at(F.array(*map(F.lit, COVER)), F.col("level") + 1)
    right, low = (F.col("x") + 1) * size - 180.0, F.col("y") * size - 90.0

    def crossed(e: Column) -> Column:
        at_y = e["x1"] + (e["x2"] - e["x1"]) * F.try_divide(F.col("lat") - e["y1"], e["y2"] - e["y1"])
        at_x = e["y1"] + (e["y2"] - e["y1"]) * F.try_divide(right - e["x1"], e["x2"] - e["x1"])
        east = ((e["y1"] > F.col("lat")) != (e["y2"] > F.col("lat"))) & (F.col("lon") < at_y) & (at_y <= right)
        south = ((e["x1"] > right) != (e["x2"] > right)) & (low < at_x) & (at_x <= F.col("lat"))
        return F.coalesce(east.cast("int"), F.lit(0)) + F.coalesce(south.cast("int"), F.lit(0))

    n = F.aggregate("edges", F.col("odd").cast("int"), lambda s, e: s + crossed(e))
    return j.where(n % 2 == 1).select("row_id", "region")


def attribute_region(points: DataFrame, edges: DataFrame, most: int = 32) -> DataFrame:
    """(row_id, region, inside, edge_km): the polygon that holds a point, else the one with the nearest edge and its distance.

    Cells that a polygon fills are resolved by an equi-join; in cells that edges meet, these edges alone are tested. The
    smallest region wins where polygons overlap.
    """
    inside = inside_regions(points, edges, most).groupBy("row_id").agg(F.min("region").alias("region"))
    done = points.select("row_id", "lon", "lat").join(inside, "row_id", "left")
    out = nearest_edge(done.where("region IS NULL"), edges).select("row_id", F.col("region").alias("_near"), "km")
    return done.join(out, "row_id", "left").select("row_id", F.coalesce("region", "_near").alias("region"), F.col("region").isNotNull().alias("inside"), F.when(F.col("region").isNull(), F.col("km")).alias("edge_km"))


def matched_controls(a: DataFrame, b: DataFrame, km: float = 3.0, k: int = 1, first: float = 1 / 32, grow: float = 2.0) -> DataFrame:
    """(a_id, b_id, km): the k nearest points of arm B for each point of arm A, within `km`.

    Rings grow from a part of `km`. A point with k hits in a ring is done, since the ring holds all that is nearer, so in
    dense places few pairs are made.
    """
    w = Window.partitionBy("a_id").orderBy("km", "b_id")
    left, at, found = cut(a.where((F.abs("lon") < 1e6) & (F.abs("lat") <= 90.0)).select("a_id", "lon", "lat")), km * first, None
    while True:
        last = at * grow > km
        hit = cut(within_km(left, b, km if last else at, deal="a").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k))
        served = hit.where(F.col("_n") == k).select("a_id")
        kept = (hit if last else hit.join(served, "a_id", "left_semi")).drop("_n")
        found = kept if found is None else found.unionByName(kept)
        if last:
            return found
        left = cut(left.join(served, "a_id", "left_anti"))
        if left.isEmpty():
            return found
        at *= grow
