"""Neighbourhood work on the grid: gradients, filling, resampling, smoothing, pixels and tiles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import EARTH_CIRCUMFERENCE, lat_of, lon_of, mercator_x, mercator_y, norm_lon, wrap_lon

KM_PER_DEGREE = 111.0
#: Degrees: south, north, west, east.
DOMAIN = (26.0, 72.0, 117.0, 246.0)
TILE_SIZE = 256


@dataclass(frozen=True)
class Grid:
    """A regular grid: first latitude and longitude, their steps (either sign) and the numbers of rows and columns."""

    lat0: float
    lat_step: float
    n_lat: int
    lon0: float
    lon_step: float
    n_lon: int

    @property
    def box(self) -> tuple[float, float, float, float]:
        lat1, lon1 = self.lat0 + self.lat_step * (self.n_lat - 1), self.lon0 + self.lon_step * (self.n_lon - 1)
        return min(self.lat0, lat1), max(self.lat0, lat1), min(self.lon0, lon1), max(self.lon0, lon1)


#: Cells of a tile's side; a tile is what one task works on at a time.
TILE_CELLS = 64


def complete(fields: DataFrame, keys: list[str], cells: DataFrame) -> DataFrame:
    """Rows that hold every cell of every key (lat, is_land) and every value of the fields, not yet brought together.

    Keys are few (months, sections). Grouped by key and cell, the greatest of each column makes one row of both.
    """
    asked = cells.join(F.broadcast(fields.select(*keys).distinct()))
    have = fields.select(*keys, "i", "j", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("boolean").alias("is_land"), F.col("value").cast("double").alias("value"))
    return asked.select(*keys, "i", "j", F.col("lat").cast("double").alias("lat"), "is_land", F.lit(None).cast("double").alias("value")).unionByName(have)


def one_each(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each cell of ``complete``'s; values outside the cells go."""
    return rows.groupBy(*by).agg(*(F.max(c).alias(c) for c in ("lat", "is_land", "value"))).where("is_land IS NOT NULL")


def tiles(fields: DataFrame, keys: list[str], cells: DataFrame, halo: int, side: int = TILE_CELLS) -> DataFrame:
    """keys, _ti, _tj, i, j, lat, is_land, value: each cell in its tile and in those that it is at most ``halo`` cells from.

    This is the only shuffle: what follows is work inside tiles, which are dealt by key and place.
    """
    near = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / side)), F.floor((F.col(c) + halo) / side))
    rows = complete(fields, keys, cells).withColumn("_ti", F.explode(near("i"))).withColumn("_tj", F.explode(near("j")))
    return one_each(rows.repartition(*keys, "_ti", "_tj"), [*keys, "_ti", "_tj", "i", "j"])


def _per_tile(rows: DataFrame, keys: list[str], fields: DataFrame, work: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """keys, i, j, value of the cells that ``work`` answers for: it gets a tile's rows and gives their places and values (NaN for none)."""
    schema = fields.select(*keys, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("value").cast("double").alias("value")).schema
    names = [f.name for f in schema][:-1]

    def run(tile: pa.Table) -> pa.Table:
        own, value = work(tile)
        return tile.take(pa.array(own)).select(names).append_column("value", pa.array(value, pa.float64(), mask=np.isnan(value)))

    return rows.groupBy(*keys, "_ti", "_tj").applyInArrow(run, schema).select(*keys, "i", "j", "value")


def gradient(fields: DataFrame, keys: list[str], cells: DataFrame, lat_step: float, lon_step: float, side: int = TILE_CELLS) -> DataFrame:
    """Size of the gradient per 100 km. Land and missing values count as 0 in differences; land gets no value.

    Differences are central inside and one-sided at the ends of each axis, also where the cells end inside of their rectangle.
    One shuffle, of the cells with a margin of one; a tile's differences are those of its dense array.
    """

    def slopes(v: np.ndarray) -> np.ndarray:
        """Along the first axis, with NaN for no cell and where a cell has no neighbour at all."""
        before, after = np.full_like(v, np.nan), np.full_like(v, np.nan)
        before[1:], after[:-1] = v[:-1], v[1:]
        one = np.where(np.isnan(before), after - v, v - before)
        return np.where(np.isnan(before) | np.isnan(after), one, (after - before) / 2)

    def work(tile: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        i, j, lat, value = (tile.column(c).to_numpy() for c in ("i", "j", "lat", "value"))
        land = tile.column("is_land").to_numpy()
        v = np.full((i.max() - i.min() + 1, j.max() - j.min() + 1), np.nan)
        at = i - i.min(), j - j.min()
        v[at] = np.where(land | np.isnan(value), 0.0, value)
        km_lon = np.cos(np.radians(lat)) * abs(lon_step) * KM_PER_DEGREE
        gy, gx = slopes(v)[at] / (abs(lat_step) * KM_PER_DEGREE) * 100, slopes(v.T).T[at] / np.where(km_lon > 0, km_lon, 1.0) * 100
        own = np.flatnonzero((i // side == tile.column("_ti")[0].as_py()) & (j // side == tile.column("_tj")[0].as_py()))
        return own, np.where(land, np.nan, np.sqrt(gx * gx + gy * gy))[own]

    return _per_tile(tiles(fields, keys, cells, 1, side), keys, fields, work)


def nearest_in_line(at: list[int], offset: list[int], row: list[int], asked: list[int]) -> list[int]:
    """For each asked column the index of the best source: least (at - column)² + offset, then least row, then least column.

    Sources are in order of their columns ``at``. Their parabolas' lower envelope is built in one fold, in which each is put
    on and taken off once, and read in one sweep, so work grows with the columns, not with their square. All in whole numbers.
    """
    stack: list[int] = []
    upto: list[tuple[int, int]] = []  # where the one below gives way, as a fraction; both are best at that very place

    def meet(p: int, q: int) -> tuple[int, int]:
        return offset[q] + at[q] ** 2 - offset[p] - at[p] ** 2, 2 * (at[q] - at[p])

    for q in range(len(at)):
        while stack:
            n, d = meet(stack[-1], q)
            if len(stack) > 1 and n * upto[-1][1] < upto[-1][0] * d:
                stack.pop()
                upto.pop()
            else:
                upto.append((n, d))
                break
        stack.append(q)
    out, k = [], 0
    for j in asked:
        while k < len(upto) and upto[k][0] < j * upto[k][1]:
            k += 1
        best, m = stack[k], k
        while m < len(upto) and upto[m][0] == j * upto[m][1]:
            m += 1
            best = min(best, stack[m], key=lambda s: (row[s], at[s]))
        out.append(best)
    return out


def fill_land(fields: DataFrame, keys: list[str], cells: DataFrame) -> DataFrame:
    """Land cells off the border get the value of the nearest ocean cell, in index distance; ties by (i, j).

    Exact in two separable steps: the nearest source within each column by window functions, then for each row the lower
    envelope of its columns' distances (``nearest_in_line``), so work is in proportion to the cells and no task holds a map.
    Windows run from a column's begin, in both orders, as one that runs to its end would be made anew for each cell.
    Without ocean values any value is a source; without any, land gets 0. Two shuffles, by column and by row. The fields are
    read twice, so store costly ones first.
    """
    rows = one_each(complete(fields, keys, cells).repartition(*keys, "j"), [*keys, "j", "i"])
    own = F.col("value").isNotNull()
    whole = rows.groupBy(*keys).agg(F.max(own & ~F.col("is_land")).alias("_ocean"), F.max("i").alias("_last_i"), F.max("j").alias("_last_j"))
    whole = whole.select(*(F.col(k).alias(f"_key_{k}") for k in keys), "_ocean", "_last_i", "_last_j")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    inner = (F.col("i") > 0) & (F.col("j") > 0) & (F.col("i") < F.col("_last_i")) & (F.col("j") < F.col("_last_j"))
    marked = rows.join(F.broadcast(whole), same).select(*keys, "i", "j", "value", (own & (~F.col("is_land") | ~F.col("_ocean"))).alias("_src"), (~own & F.col("is_land") & inner).alias("_fill"))
    column = Window.partitionBy(*keys, "j")
    source = F.when(F.col("_src"), F.struct("i", "value"))
    last = lambda order: F.last(source, True).over(column.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    near = marked.select("*", last(F.col("i").asc()).alias("_up"), last(F.col("i").desc()).alias("_down"))
    option = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.pow(F.col("i") - F.col(f"{c}.i"), 2).cast("long").alias("d2"), F.col(f"{c}.i").alias("si"), F.col(f"{c}.value").alias("v")))
    best = near.withColumn("_best", F.array_min(F.filter(F.array(option("_up"), option("_down")), lambda o: o.isNotNull())))
    lines = best.select(*keys, "i", "j", "value", "_fill", "_best.d2", "_best.si", "_best.v")
    schema = fields.select(*keys, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("value").cast("double").alias("value")).schema
    names = [f.name for f in schema]

    def fill(line: pa.Table) -> pa.Table:
        line = line.sort_by("j")
        columns, value = line.column("j").to_pylist(), line.column("value").to_pylist()
        d2, row, v = (line.column(c).to_pylist() for c in ("d2", "si", "v"))
        known = [k for k, d in enumerate(d2) if d is not None]
        asked = [k for k, f in enumerate(line.column("_fill").to_pylist()) if f]
        found = nearest_in_line([columns[k] for k in known], [d2[k] for k in known], [row[k] for k in known], [columns[k] for k in asked]) if known else [None] * len(asked)
        for k, s in zip(asked, found):
            value[k] = 0.0 if s is None else v[known[s]]
        return line.select(names[:-1]).append_column("value", pa.array(value, pa.float64()))

    return lines.groupBy(*keys, "i").applyInArrow(fill, schema).select(*keys, "i", "j", "value")


def _corners(targets: DataFrame, fi: Column, fj: Column, grid: Grid) -> DataFrame:
    """The four cells around each target with their weights, one row each."""
    i0 = F.least(F.floor(fi), F.lit(grid.n_lat - 2)).cast("int")
    j0 = F.least(F.floor(fj), F.lit(grid.n_lon - 2)).cast("int")
    t, s = fi - i0, fj - j0
    corners = [(0, 0, (1 - t) * (1 - s)), (0, 1, (1 - t) * s), (1, 0, t * (1 - s)), (1, 1, t * s)]
    each = F.explode(F.array(*(F.struct((i0 + a).alias("i"), (j0 + b).alias("j"), w.alias("w")) for a, b, w in corners)))
    return targets.select("*", each.alias("_c")).select("*", "_c.i", "_c.j", "_c.w").drop("_c")


def resample_bilinear(targets: DataFrame, field: DataFrame, grid: Grid) -> DataFrame:
    """target_id, value at each target's lat and lon; NULL outside the grid and where any of the corners is NULL."""
    fi, fj = (F.col("lat") - grid.lat0) / grid.lat_step, (F.col("lon") - grid.lon0) / grid.lon_step
    inside = fi.between(0, grid.n_lat - 1) & fj.between(0, grid.n_lon - 1)
    rows = _corners(targets.where(inside), fi, fj, grid).join(field.select("i", "j", "value"), ["i", "j"], "left")
    found = rows.groupBy("target_id").agg(F.when(F.count("value") == 4, F.sum(F.col("w") * F.col("value"))).alias("value"))
    return targets.select("target_id").join(found, "target_id", "left")


def resample_ocean(targets: DataFrame, field: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """target_id, kind (land, hole, value) and value: corners without a value are left out and weights renormalised.

    Land: less than half of the weight is ocean. Hole: hardly any corner has a value. A latitude may overshoot by one
    step and is moved in; targets outside are left out.
    """
    lon = wrap_lon(F.col("lon"), grid.box[2], grid.box[3])
    fi, fj = (F.col("lat") - grid.lat0) / grid.lat_step, (lon - grid.lon0) / grid.lon_step
    inside = fi.between(-1, grid.n_lat) & lon.between(grid.box[2], grid.box[3])
    clamp = lambda f, n: F.greatest(F.lit(0.0), F.least(F.lit(n - 1.0001), f))
    values = cells.select("i", "j", "is_land").join(field.select("i", "j", "value"), ["i", "j"], "left")
    rows = _corners(targets.where(inside), clamp(fi, grid.n_lat), clamp(fj, grid.n_lon), grid).join(values, ["i", "j"], "left")
    sums = rows.groupBy("target_id").agg(
        F.coalesce(F.sum(F.when(~F.col("is_land"), F.col("w"))), F.lit(0.0)).alias("ocean"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("w"))), F.lit(0.0)).alias("weight"), F.sum(F.col("w") * F.col("value")).alias("total"))
    kind = F.when(F.col("ocean") < 0.5, "land").when(F.col("weight") < 0.01, "hole").otherwise("value")
    return sums.select("target_id", kind.alias("kind"), F.when(kind == "value", F.col("total") / F.nullif("weight", F.lit(0.0))).alias("value"))


def _blur_matrix(first: int, last: int, begin: int, n: int, size: int, sigma: float) -> np.ndarray:
    """Weights by which the cells begin, begin + 1, ... (``size`` of them) make the smoothed ones first to last - 1 of an axis.

    The axis has n cells and is reflected at its ends, as often as the kernel reaches beyond them.
    """
    radius = int(4 * sigma + 0.5)
    offsets = np.arange(-radius, radius + 1)
    kernel = np.exp(-0.5 * (offsets / sigma) ** 2)
    source = (np.arange(first, last)[:, None] + offsets) % (2 * n)
    source = np.where(source < n, source, 2 * n - 1 - source) - begin
    out = np.zeros((last - first, size))
    np.add.at(out, (np.arange(last - first)[:, None], source), kernel / kernel.sum())
    return out


def smooth(fields: DataFrame, keys: list[str], cells: DataFrame, grid: Grid, sigma: float = 4.0) -> DataFrame:
    """Gaussian smoothing over the cells with a value; NULL where they weigh 0.05 or less, or the cell has none.

    Cells are brought to tiles with a margin of the kernel's radius (4 sigma), the only shuffle; a tile is smoothed as two
    products of matrices.
    """
    radius = int(4 * sigma + 0.5)
    side, n_lat, n_lon = max(TILE_CELLS, radius), grid.n_lat, grid.n_lon

    def blur(tile: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ti, tj = tile.column("_ti")[0].as_py(), tile.column("_tj")[0].as_py()
        i, j, value = (tile.column(c).to_numpy() for c in ("i", "j", "value"))
        edges = [(max(0, t * side - radius), min(n, (t + 1) * side + radius), t * side, min(n, (t + 1) * side)) for t, n in ((ti, n_lat), (tj, n_lon))]
        (a0, a1, i0, i1), (b0, b1, j0, j1) = edges
        own = np.flatnonzero((i >= i0) & (i < i1) & (j >= j0) & (j < j1))
        if not len(own):  # a margin beyond the grid
            return own, np.zeros(0)
        known, sums = ~np.isnan(value), np.zeros((2, a1 - a0, b1 - b0))
        sums[0, i[known] - a0, j[known] - b0] = value[known]
        sums[1, i[known] - a0, j[known] - b0] = 1.0
        total, weight = _blur_matrix(i0, i1, a0, n_lat, a1 - a0, sigma) @ sums @ _blur_matrix(j0, j1, b0, n_lon, b1 - b0, sigma).T
        at = i[own] - i0, j[own] - j0
        return own, np.where(known[own] & (weight[at] > 0.05), total[at] / np.maximum(weight[at], 1e-6), np.nan)

    return _per_tile(tiles(fields, keys, cells, radius, side), keys, fields, blur)


def mercator_extent(box: tuple[float, float, float, float] = DOMAIN) -> tuple[Column, Column, Column, Column]:
    """x_min, y_min, x_max, y_max of the domain."""
    south, north, west, east = box
    x0 = mercator_x(F.lit(west))
    return x0, mercator_y(F.lit(south)), x0 + (east - west) / 360.0 * EARTH_CIRCUMFERENCE, mercator_y(F.lit(north))


def pixel_grid(spark: SparkSession, width: int, height: int, box: tuple[float, float, float, float] = DOMAIN, centres: bool = False) -> DataFrame:
    """target_id, px, py, x, y, lat, lon of a width by height picture of the domain, its outer pixels on the extent."""
    x0, y0, x1, y1 = mercator_extent(box=box)
    at = spark.range(width * height).select(F.col("id").alias("target_id"), (F.col("id") % width).cast("int").alias("px"), F.floor(F.col("id") / width).cast("int").alias("py"))
    part = (lambda p, n: (F.col(p) + 0.5) / n) if centres else (lambda p, n: F.col(p) / F.lit(float(max(1, n - 1))))
    placed = at.withColumns({"x": x0 + (x1 - x0) * part("px", width), "y": y1 - (y1 - y0) * part("py", height)})
    return placed.withColumns({"lat": lat_of(F.col("y")), "lon": lon_of(F.col("x"))})


def tile_pixels(points: DataFrame, zoom: int, box: tuple[float, float, float, float] = DOMAIN) -> DataFrame:
    """z, tx, ty of the map tiles that the points (lat, lon, value) fall in: n, vmin, vmax and the values by pixel.

    Tiles outside the domain have no points. A tile holds at most TILE_SIZE squared pixels.
    """
    half, metres = EARTH_CIRCUMFERENCE / 2, EARTH_CIRCUMFERENCE / 2**zoom
    lon = wrap_lon(F.col("lon"), box[2], box[3])
    inside = points.where(F.col("lat").between(box[0], box[1]) & lon.between(box[2], box[3]))
    across, down = (mercator_x(norm_lon(F.col("lon"))) + half) / metres, (F.lit(half) - mercator_y(F.col("lat"))) / metres
    last = F.lit(2**zoom - 1)
    rows = inside.select(F.lit(zoom).alias("z"), F.least(F.floor(across), last).alias("tx"), F.least(F.floor(down), last).alias("ty"), across.alias("_a"), down.alias("_d"), "value")
    pixel = lambda p, t: F.least(F.floor((F.col(p) - F.col(t)) * TILE_SIZE), F.lit(TILE_SIZE - 1)).cast("int")
    cells = rows.groupBy("z", "tx", "ty", pixel("_d", "ty").alias("row"), pixel("_a", "tx").alias("col")).agg(F.avg("value").alias("value"))
    return cells.groupBy("z", "tx", "ty").agg(F.count("*").alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax"), F.array_sort(F.collect_list(F.struct("row", "col", "value"))).alias("pixels"))
