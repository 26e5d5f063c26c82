"""Neighbourhoods of grid cells by tiles with a halo: a cell is copied to the tiles that can see it, not to every neighbour.

A tile of `side` x `side` cells with its halo is one array of codes. Square windows are read from integral images, metric ones
from running sums along rows, cores from repeated erosion, which goes on across tiles in rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

SIDE, VOID = 256, -(1 << 31)
EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def by_tiles(grid: DataFrame, rows: int, cols: int | Column, work: Callable, schema: str, side: int = SIDE) -> DataFrame:
    """row, col, code and what `work` gives for every cell of (row, col, code), as columns of `schema`.

    work(codes, first row, own rows, own columns) sees an array of a tile and its halo of `rows` and `cols` cells, VOID
    where there is no cell, and returns arrays of the tile's own part. `cols` may depend on the row.
    """
    span = lambda c, h: F.sequence(F.floor((F.col(c) - h) / side), F.floor((F.col(c) + h) / side))
    halo = cols if isinstance(cols, Column) else F.lit(cols)
    dealt = grid.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("code").cast("int").alias("code"), halo.cast("bigint").alias("_h"))
    dealt = dealt.withColumn("_ty", F.explode(span("row", rows))).withColumn("_tx", F.explode(span("col", F.col("_h"))))

    def run(table):
        import pyarrow as pa

        r, c, code = (table.column(k).to_numpy() for k in ("row", "col", "code"))
        top, left = table.column("_ty")[0].as_py() * side, table.column("_tx")[0].as_py() * side
        wide = int(max(0, left - c.min(), c.max() - left - side + 1))
        codes = np.full((side + 2 * rows, side + 2 * wide), VOID, np.int64)
        codes[r - top + rows, c - left + wide] = code
        own = (r >= top) & (r < top + side) & (c >= left) & (c < left + side)
        y, x = r[own] - top, c[own] - left
        found = work(codes, top - rows, slice(rows, rows + side), slice(wide, wide + side))
        return pa.Table.from_arrays([pa.array(r[own]), pa.array(c[own]), pa.array(code[own]), *(pa.array(v[y, x]) for v in found)], names=["row", "col", "code", *(f.split()[0] for f in schema.split(", "))])

    return dealt.groupBy("_ty", "_tx").applyInArrow(run, f"row bigint, col bigint, code int, {schema}")


def box(hit: np.ndarray, radius: int) -> np.ndarray:
    """Sums over the square windows of all cells, by an integral image."""
    s = np.zeros((hit.shape[0] + 1, hit.shape[1] + 1), np.int64)
    s[1:, 1:] = hit.cumsum(0).cumsum(1)
    y, x = np.arange(hit.shape[0]), np.arange(hit.shape[1])
    a, b = np.maximum(y - radius, 0), np.minimum(y + radius + 1, hit.shape[0])
    c, d = np.maximum(x - radius, 0), np.minimum(x + radius + 1, hit.shape[1])
    return s[b][:, d] - s[a][:, d] - s[b][:, c] + s[a][:, c]


def square_windows(grid: DataFrame, radii: list[int], code: int | None = None, side: int = SIDE) -> DataFrame:
    """(row, col, code, n_<r>, same_<r>): cells in the window of each radius, and those of the same code, or of `code`."""

    def work(codes, _, ys, xs):
        there, out = codes != VOID, []
        for r in radii:
            same = np.zeros(codes.shape, np.int64)
            if code is not None:
                same = box(codes == code, r)
            else:
                for c in np.unique(codes[ys, xs]):
                    if c != VOID:
                        same = np.where(codes == c, box(codes == c, r), same)
            out += [box(there, r)[ys, xs], same[ys, xs]]
        return out

    most = max(radii)
    return by_tiles(grid, most, most, work, ", ".join(f"n_{r} bigint, same_{r} bigint" for r in radii), side)


def directions(grid: DataFrame, code: int, reach: int = 1, side: int = SIDE) -> DataFrame:
    """(row, col, code, seen): in how many of the eight directions a cell of `code` lies within `reach` steps."""

    def work(codes, _, ys, xs):
        hit, seen = np.pad(codes == code, reach), np.zeros(codes.shape, np.int64)
        for dy, dx in EIGHT:
            met = np.zeros(codes.shape, bool)
            for k in range(1, reach + 1):
                met |= hit[reach + k * dy :, reach + k * dx :][: codes.shape[0], : codes.shape[1]]
            seen += met
        return [seen[ys, xs]]

    return by_tiles(grid, reach, reach, work, "seen bigint", side)


def share_within(grid: DataFrame, code: int, metres: float, deg: float, lat0: float, side: int = SIDE) -> DataFrame:
    """(row, col, code, n, hits, share): cells whose middles lie within `metres` of a cell's middle, and the share of `code`.

    Row r lies at latitude lat0 - r * deg. A window is an ellipse of cells: as many rows everywhere, more columns the
    farther from the equator.
    """
    step = 111_194.926644559 * deg  # metres of a row, on the sphere of the library's distances
    rows = int(metres // step)

    def work(codes, first, ys, xs):
        there, hit = codes != VOID, codes == code
        height, width = codes.shape
        sums = [np.concatenate([np.zeros((height, 1), np.int64), m.cumsum(1)], 1) for m in (there, hit)]
        out, x = [np.zeros(codes.shape, np.int64) for _ in sums], np.arange(width)
        for y in np.flatnonzero(there[ys].any(1)) + ys.start:
            narrow = step * np.cos(np.radians(lat0 - (first + y) * deg))
            for dy in range(-rows, rows + 1):
                w = int(min(width, np.sqrt(metres**2 - (dy * step) ** 2) // narrow))
                a, b = np.maximum(x - w, 0), np.minimum(x + w + 1, width)
                for o, s in zip(out, sums, strict=True):
                    o[y] += s[y + dy][b] - s[y + dy][a]
        return [o[ys, xs] for o in out]

    far = F.abs(F.lit(lat0) - F.col("row") * deg) + rows * deg
    cols = F.floor(F.lit(metres) / (step * F.cos(F.radians(F.least(far, F.lit(89.9))))))
    return by_tiles(grid, rows, cols, work, "n bigint, hits bigint", side).withColumn("share", F.col("hits") / F.col("n"))


def core_depth(grid: DataFrame, halo: int = 32, side: int = SIDE) -> DataFrame:
    """(row, col, code, depth): how many erosions by 3 x 3 windows a cell survives; 0 beside another code or a missing cell.

    A round erodes `halo` times inside the tiles. What is left then is a grid of its own, eroded on in the next round, so
    cores wider than a tile come out right; a round reads only what the one before left.
    """

    def work(codes, _, ys, xs):
        inner = np.zeros(codes.shape, bool)
        inner[1:-1, 1:-1] = codes[1:-1, 1:-1] != VOID
        for dy, dx in EIGHT:
            inner[1:-1, 1:-1] &= codes[1:-1, 1:-1] == codes[1 + dy : codes.shape[0] - 1 + dy, 1 + dx : codes.shape[1] - 1 + dx]
        depth = inner.astype(np.int64)
        for _ in range(halo - 1):
            if not inner.any():
                break
            rows = inner.copy()
            rows[1:-1] &= inner[:-2] & inner[2:]
            rows[[0, -1]] = False
            inner = rows.copy()
            inner[:, 1:-1] &= rows[:, :-2] & rows[:, 2:]
            inner[:, [0, -1]] = False
            depth += inner
        return [depth[ys, xs]]

    left, done, before = grid, None, 0
    while True:
        found = cut(by_tiles(left, halo, halo, work, "depth bigint", side))
        deep = found.where(F.col("depth") >= halo)
        more = not deep.isEmpty()
        told = (found.where(F.col("depth") < halo) if more else found).withColumn("depth", F.col("depth") + before)
        done = told if done is None else done.unionByName(told)
        if not more:
            return done
        left, before = deep.select("row", "col", "code"), before + halo
