"""Land polygons: halves, rasters and outlines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import fixed, mercator_x, mercator_y
from .grid import DOMAIN, mercator_extent

RING = ("feature_id", "poly_id", "ring_id")
#: name -> (west, south, east, north) in -180..180: the two halves of the domain with their margins. Fixed values.
CLIP_BOXES = {"west": (116.5, 25.5, 180.5, 72.5), "east": (-180.5, 25.5, -114.5, 72.5)}
BREAK_SHARE = 0.3
#: Crossings of edges and pixel rows that a piece of a polygon has at most, unless one row has more, and that are sorted at a time.
PIECE_CROSSINGS, SWEPT_CROSSINGS = 200_000, 1_000_000


def tag_halves(vertices: DataFrame, boxes: dict[str, tuple[float, float, float, float]] = CLIP_BOXES) -> DataFrame:
    """feature_id, poly_id, half of the polygons whose bounding box meets a half's box; one may be in both."""
    bounds = vertices.groupBy("feature_id", "poly_id").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    meets = [F.when((F.col("x0") <= e) & (F.col("x1") >= w) & (F.col("y0") <= n) & (F.col("y1") >= s), F.lit(h)) for h, (w, s, e, n) in boxes.items()]
    return bounds.select("feature_id", "poly_id", F.explode(F.filter(F.array(*meets), lambda h: h.isNotNull())).alias("half"))


def to_pixels(vertices: DataFrame, width: int, height: int, box: tuple[float, float, float, float] = DOMAIN) -> DataFrame:
    """Vertices (with half) with x and y in pixels of the domain's picture; the east half lies one turn on."""
    x0, y0, x1, y1 = mercator_extent(box=box)
    x, y = mercator_x(F.col("lon"), F.col("half") == "east"), mercator_y(F.col("lat"))
    return vertices.withColumns({"x": (x - x0) / (x1 - x0) * width, "y": (y1 - y) / (y1 - y0) * height})


def place_polygons(polys: DataFrame, width: int, height: int, box: tuple[float, float, float, float] = DOMAIN, boxes: dict[str, tuple[float, float, float, float]] = CLIP_BOXES) -> DataFrame:
    """half, feature_id, poly_id, rings of the polygons (rings as arrays of lon, lat) in pixels, a row for each half they meet.

    As ``tag_halves`` and ``to_pixels``, but within a polygon's own row, so nothing is grouped or joined. A ring has the
    columns x and y, arrays of the same length.
    """
    x0, y0, x1, y1 = mercator_extent(box=box)
    points = F.flatten("rings")
    edge = lambda f, k: f(F.transform(points, lambda p: p[k]))
    bounds = polys.withColumns({"_w": edge(F.array_min, 0), "_e": edge(F.array_max, 0), "_s": edge(F.array_min, 1), "_n": edge(F.array_max, 1)})
    meets = [F.when((F.col("_w") <= e) & (F.col("_e") >= w) & (F.col("_s") <= n) & (F.col("_n") >= s), F.lit(h)) for h, (w, s, e, n) in boxes.items()]
    tagged = bounds.select("feature_id", "poly_id", "rings", F.explode(F.array_compact(F.array(*meets))).alias("half"))
    xs = lambda r: F.transform(r, lambda p: (mercator_x(p[0], F.col("half") == "east") - x0) / (x1 - x0) * width)
    ys = lambda r: F.transform(r, lambda p: (y1 - mercator_y(p[1])) / (y1 - y0) * height)
    return tagged.select("half", "feature_id", "poly_id", F.transform("rings", lambda r: F.struct(xs(r).alias("x"), ys(r).alias("y"))).alias("rings"))


def gather_rings(vertices: DataFrame) -> DataFrame:
    """half, feature_id, poly_id, rings from a row for each vertex (x and y in pixels), for ``rasterize``."""
    one = vertices.groupBy("half", *RING).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
    ring = F.struct("ring_id", F.transform("v", lambda p: p["x"]).alias("x"), F.transform("v", lambda p: p["y"]).alias("y"))
    rings = one.groupBy("half", "feature_id", "poly_id").agg(F.array_sort(F.collect_list(ring)).alias("all"))
    return rings.select("half", "feature_id", "poly_id", F.transform("all", lambda r: F.struct(r["x"], r["y"])).alias("rings"))


def pieces(polys: DataFrame, height: int) -> DataFrame:
    """half, feature_id, poly_id, low, high, edges: the polygons, in bands of pixel rows where they cross many.

    Each vertex is paired with its next (the last one with the first) inside the ring's array. An edge keeps the pixel rows
    (first to last) whose middles it crosses; those that cross none go. A polygon of more than ``PIECE_CROSSINGS`` is cut into
    bands, down to one pixel row, each with the edges that cross it, so a continent is spread over many tasks.
    """

    def edges(r, ring):
        follower = lambda k: (k + 1) % F.size(r["x"])
        paired = F.transform(r["x"], lambda x, k: F.struct(x.alias("ax"), r["y"][k].alias("ay"), r["x"][follower(k)].alias("bx"), r["y"][follower(k)].alias("by")))
        level = F.filter(paired, lambda e: e["ay"] != e["by"])
        first = lambda e: F.greatest(F.lit(0), F.ceil(F.least(e["ay"], e["by"]) - 0.5)).cast("int")
        last = lambda e: F.least(F.lit(height - 1), F.ceil(F.greatest(e["ay"], e["by"]) - 0.5) - 1).cast("int")
        crossing = F.transform(level, lambda e: F.struct(ring.alias("ring"), first(e).alias("first"), last(e).alias("last"), e["ax"].alias("ax"), e["ay"].alias("ay"), e["bx"].alias("bx"), e["by"].alias("by")))
        return F.filter(crossing, lambda e: e["first"] <= e["last"])

    keys = ["half", "feature_id", "poly_id"]
    whole = polys.select(*keys, F.flatten(F.array_compact(F.transform("rings", edges))).alias("edges"))
    total = F.aggregate("edges", F.lit(0).cast("long"), lambda n, e: n + e["last"] - e["first"] + 1)
    sized = whole.select(*keys, "edges", F.array_min("edges.first").alias("top"), F.array_max("edges.last").alias("bottom"), total.alias("total"))
    rows = F.greatest(F.lit(1), F.least(F.lit(height), F.floor((F.col("bottom") - F.col("top") + 1) * F.lit(float(PIECE_CROSSINGS)) / F.greatest(F.lit(1), "total")))).cast("int")
    banded = sized.select(*keys, "edges", "bottom", rows.alias("rows"), F.explode(F.sequence("top", "bottom", rows)).alias("low"))
    band = banded.withColumn("high", F.least(F.col("bottom"), F.col("low") + F.col("rows") - 1))
    return band.select(*keys, "low", "high", F.filter("edges", lambda e: (e["first"] <= F.col("high")) & (e["last"] >= F.col("low"))).alias("edges"))


def _begins(*sorted_keys: np.ndarray) -> np.ndarray:
    """Which places of the sorted keys begin a new one."""
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return new


def _sums(step: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Running sums that start anew at each begin."""
    total = np.cumsum(step)
    return total - (total - step)[begin][np.cumsum(begin) - 1]


def _ends(line: np.ndarray, px: np.ndarray, land: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line, px, step of the places where a line's land begins (1) or ends (-1); the first of a line follows water."""
    before = np.zeros(len(land), bool)
    before[1:] = land[:-1]
    turn = land != (before & ~_begins(line))
    return line[turn], px[turn], np.where(land[turn], 1, -1)


def sweep(piece: np.ndarray, edges: list[np.ndarray], width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """py, px, step of the ends of the stretches of pixels that lie in any of the pieces (their numbers ascend).

    In a pixel row each ring is entered at its odd and left at its even crossings; their running sums, of the outer ring and of
    the holes, tell the piece's land. A running sum over the ends of all pieces then tells what they cover together.
    """
    ring, first, last, ax, ay, bx, by = edges
    n, rings = last - first + 1, int(ring.max()) + 1
    edge = np.repeat(np.arange(len(n)), n)
    py = np.arange(len(edge)) - (np.cumsum(n) - n - first)[edge]
    at = ax[edge] + (py + 0.5 - ay[edge]) / (by - ay)[edge] * (bx - ax)[edge]
    # what starts inside a pixel's centre counts from the next pixel on; ends at one place are taken together, in any order
    place = np.clip(np.ceil(at - 0.5), 0, width) + 1
    place = np.where(np.isnan(at), 0, place).astype(np.int64)  # of an edge without an x: the first of its row, and put beyond the last pixel
    swept, place = np.divmod(np.sort((((piece * height)[edge] + py) * rings + ring[edge]) * (width + 2) + place), width + 2)
    line, ring = np.divmod(swept, rings)
    step = np.where(_sums(np.ones(len(line), np.int64), _begins(swept)) % 2 == 1, 1, -1)
    px = np.where(place == 0, width, place - 1)
    order = np.argsort(line * (width + 1) + px, kind="stable")
    line, px, step, outer = line[order], px[order], step[order], ring[order] == 0
    begin, final = _begins(line), np.roll(_begins(line, px), -1)
    land = (_sums(np.where(outer, step, 0), begin) > 0) & (_sums(np.where(outer, 0, step), begin) <= 0)
    line, px, step = _ends(line[final], px[final], land[final])
    place, where = np.unique(line % height * (width + 1) + px, return_inverse=True)
    py, px = np.divmod(place, width + 1)
    depth = _sums(np.bincount(where, step, len(place)).astype(np.int64), _begins(py))
    return _ends(py, px, depth > 0)


def land_ends(dealt: DataFrame, width: int, height: int) -> DataFrame:
    """py, px, step: where stretches of land of the ``pieces`` begin and end, those of a batch taken together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = (batch.column(c).to_numpy() for c in ("low", "high"))
            each = batch.column("edges").value_lengths().to_numpy()
            piece = np.repeat(np.arange(len(each)), each)
            ring, first, last, *ends = (c.to_numpy(zero_copy_only=False) for c in batch.column("edges").flatten().flatten())
            first, last = np.maximum(first, low[piece]).astype(np.int64), np.minimum(last, high[piece]).astype(np.int64)
            n = np.bincount(piece, last - first + 1, len(each))
            share = (np.cumsum(n) // SWEPT_CROSSINGS)[piece]
            for at in np.split(np.arange(len(piece)), np.flatnonzero(np.diff(share)) + 1):
                if len(at):
                    py, px, step = sweep(piece[at], [c[at] for c in (ring, first, last, *ends)], width, height)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in (py, px, step)], ["py", "px", "step"])

    return dealt.select("low", "high", "edges").mapInArrow(run, "py int, px int, step int")


def land_runs(polys: DataFrame, width: int, height: int, tasks: int | None = None) -> DataFrame:
    """py, first, last: the stretches of land pixels of each row, whose centres lie in an outer ring and outside its own holes.

    A sweep over signed crossings. Polygons are dealt (to ``tasks`` if given) before they get crossings, large ones in bands of
    pixel rows, and a task tells what its polygons cover together, so crossings are neither exchanged nor sorted among tasks.
    Of that only the ends of stretches move on, and again a running sum, over all tasks, gives the row's land. One pass over the
    polygons, three exchanges.
    """
    by = ["half", "feature_id", "poly_id", "low"]
    cut = pieces(polys, height)
    ends = land_ends(cut.repartition(tasks, *by) if tasks else cut.repartition(*by), width, height)
    line = Window.partitionBy("py").orderBy("px")
    summed = ends.groupBy("py", "px").agg(F.sum("step").alias("step"))
    depth = summed.select("py", "px", (F.sum("step").over(line) > 0).alias("land"))
    turns = depth.withColumn("before", F.lag("land", 1, False).over(line)).where("land <> before")
    runs = turns.select("py", F.col("px").alias("first"), (F.lead("px", 1, width).over(line) - 1).alias("last"), "land")
    return runs.where(F.col("land") & (F.col("first") < width)).drop("land")


def rasterize(polys: DataFrame, width: int, height: int, tasks: int | None = None) -> DataFrame:
    """px, py of the land pixels of ``land_runs``."""
    return land_runs(polys, width, height, tasks).select(F.explode(F.sequence("first", "last")).alias("px"), "py")


def ocean_pixels(land: DataFrame, width: int, height: int) -> DataFrame:
    """px, py, is_ocean for every pixel."""
    every = land.sparkSession.range(width * height).select((F.col("id") % width).cast("int").alias("px"), F.floor(F.col("id") / width).cast("int").alias("py"))
    return every.join(land.withColumn("_land", F.lit(True)), ["px", "py"], "left").select("px", "py", F.col("_land").isNull().alias("is_ocean"))


def sample_mask(targets: DataFrame, mask: DataFrame, width: int, height: int, box: tuple[float, float, float, float] = DOMAIN) -> DataFrame:
    """The targets (x, y in metres) with is_ocean of the mask's pixel that they fall in, the outermost ones beyond."""
    x0, y0, x1, y1 = mercator_extent(box=box)
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v.cast("int")))
    rows = targets.withColumns({"mx": clip((F.col("x") - x0) / ((x1 - x0) / width), width), "my": clip((y1 - F.col("y")) / ((y1 - y0) / height), height)})
    return rows.join(mask.select(F.col("px").alias("mx"), F.col("py").alias("my"), "is_ocean"), ["mx", "my"], "left").drop("mx", "my")


def ring_paths(vertices: DataFrame, width: int) -> DataFrame:
    """Path text of each ring's segments: broken where x jumps by over 30 % of the width; segments of one point go."""
    ring = Window.partitionBy("half", *RING).orderBy("seq")
    jump = F.abs(F.col("x") - F.lag("x").over(ring)) > width * BREAK_SHARE
    rows = vertices.withColumn("_jump", F.coalesce(jump.cast("int"), F.lit(0)))
    rows = rows.withColumn("segment", F.sum("_jump").over(ring))
    text = F.concat(fixed(F.col("x"), 1), F.lit(","), fixed(F.col("y"), 1))
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", text.alias("at")))), lambda p: p["at"])
    out = rows.groupBy("half", *RING, "segment").agg(F.count("*").alias("n"), points.alias("points")).where("n >= 2")
    return out.select("half", *RING, "segment", F.concat(F.lit("M"), F.array_join("points", "L")).alias("path"))
