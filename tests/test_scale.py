"""Forms of the grid operators that are made for large grids, against plain ones, and the plans that they promise."""

import json
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isogrid.operators import anomalies, climate, colour, grid, observations, points, polygons, quantiles, store
from isogrid.sources import grids
from isogrid.sources.versions import VersionedStore
from test_grid import field_of, grid_of, obs

QUICK = settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Polygons


def inside(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay <= y) != (by <= y) and ax + (y - ay) / (by - ay) * (bx - ax) <= x:
            odd = not odd
    return odd


def placed(spark, polys):
    rows = [("west", f, p, [([x for x, _ in r], [y for _, y in r]) for r in rings]) for f, p, rings in polys]
    return spark.createDataFrame(rows, "half string, feature_id int, poly_id int, rings array<struct<x: array<double>, y: array<double>>>")


def test_rasterize_any_polygons_as_point_in_polygon_does(spark):
    """Stars that cross themselves, holes that reach out of their ring, several at a place, and some beyond the picture."""
    rng = random.Random(3)
    star = lambda x, y, r, n: [(x + r * rng.uniform(0.2, 1) * math.cos(k), y + r * rng.uniform(0.2, 1) * math.sin(k)) for k in sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))]
    polys = [(f, p, [star(rng.uniform(-5, 45), rng.uniform(-5, 35), rng.uniform(2, 15), 9) for _ in range(1 + rng.randrange(3))]) for f in range(12) for p in range(2)]
    got = {(r["px"], r["py"]) for r in polygons.rasterize(placed(spark, polys), 40, 30).collect()}
    want = {(x, y) for x in range(40) for y in range(30) for _, _, rings in polys if inside(rings[0], x + 0.5, y + 0.5) and not any(inside(h, x + 0.5, y + 0.5) for h in rings[1:])}
    assert got == want
    runs = polygons.land_runs(placed(spark, polys), 40, 30).collect()
    assert sum(r["last"] - r["first"] + 1 for r in runs) == len(want)


def test_rasterize_reads_once_and_shuffles_thrice(spark, tmp_path):
    features = spark.createDataFrame([(1, "Polygon", "[[[120, 30], [130, 30], [130, 40], [120, 30]]]")], "feature_id long, type string, coordinates string")
    features.write.parquet(str(tmp_path / "features"))
    polys = polygons.place_polygons(grids.explode_polygons(spark.read.parquet(str(tmp_path / "features"))), 120, 55)
    began = time.perf_counter()
    plan = plan_of(polygons.rasterize(polys, 120, 55))
    assert plan.count("Exchange") == 3 and plan.count("FileScan") == 1 and "Join" not in plan
    assert time.perf_counter() - began < 5


FEATURES = [
    {"type": "Feature", "properties": {"id": 7, "name": "a } { \" ["}, "geometry": {"type": "Polygon", "coordinates": [[[1, 1], [4, 1], [4, 4], [1, 1]], [[2, 2], [3, 2], [3, 3], [2, 2]]]}},
    {"type": "Feature", "properties": {"id": 8}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[5, 5], [6, 5], [6, 6], [5, 5]]], [[[7.5, 7], [8, 7], [8, 8], [7.5, 7]]]]}},
    {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[-1, -1], [0, -1], [0, 0], [-1, -1]]]}, "properties": {"id": 9}},
]


def collection(features, indent=None):
    return json.dumps({"type": "FeatureCollection", "features": features}, indent=indent)


@pytest.mark.parametrize("indent", [None, 0, 3])
def test_collections_are_read_alike_in_parts(spark, tmp_path, indent):
    path = str(tmp_path / "polygons.json")
    many = [{**f, "properties": {**f["properties"], "id": 10 * k + n}} for k in range(200) for n, f in enumerate(FEATURES)]
    (tmp_path / "polygons.json").write_text(collection(many, indent))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        n_parts = spark.read.option("lineSep", grids.FEATURE_MARK).text(path).rdd.getNumPartitions()
        for key in ("id", None):
            whole, parts = grids.read_polygons(spark, path, key), grids.read_polygons_split(spark, path, key)
            assert n_parts > 8 and parts.dtypes == whole.dtypes and parts.exceptAll(whole).count() == 0 and parts.count() == whole.count() > 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_collections_in_another_order_of_members_are_read_whole(spark, tmp_path):
    turned = [dict(reversed(f.items())) for f in FEATURES]
    odd = [{**FEATURES[0], "properties": {"id": 1, "kind": "Feature"}}, FEATURES[1]]
    for name, features in (("turned", turned), ("odd", odd)):
        (tmp_path / name).write_text(collection(features))
        parts, whole = grids.read_polygons_split(spark, str(tmp_path / name), "id"), grids.read_polygons(spark, str(tmp_path / name), "id")
        assert sorted(parts.collect()) == sorted(whole.collect()) and whole.count() > 0


# Percentiles and numbers


@settings(QUICK, max_examples=25)
@given(values=st.lists(st.floats(allow_nan=False), min_size=1, max_size=60))
def test_ordered_bits_are_those_of_the_double(spark, values):
    values += [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, 0.5, 1.0, 2.0, math.nextafter(2.0, 0), math.nextafter(1.0, 2)]
    bits = np.array(values).view(np.int64)
    want = [int(b) if b >= 0 else -int(b & 0x7FFFFFFFFFFFFFFF) for b in bits]
    got = quantiles.with_ordered_bits(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double"), "v", "b").select("k", "b").collect()
    assert [r["b"] for r in sorted(got)] == want


def test_percentiles_of_odd_pools(spark):
    rows = [("a", v) for v in (math.nan, None, -0.0, 0.0, 1e-300, -1e300, 3.0)] + [("b", None)] + [(None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["pct"]): r["value"] for r in quantiles.exact_percentiles(df.where("g IS NOT NULL"), ["g"], "v", (0, 50, 75, 100)).collect()}
    assert got == {("a", float(p)): float(np.percentile([-1e300, 0, 0, 1e-300, 3.0], p)) for p in (0, 50, 75, 100)}
    assert quantiles.exact_percentiles(df.where("false"), ["g"], "v", (50,)).count() == 0


def test_counts_of_parts_add_up_and_name_the_values_to_read(spark):
    """Two parts' counts; of the pool only the values in the bins' ranges are given to the second pass."""
    rng = random.Random(21)
    rows = [(g, rng.choice([-1, 1]) * rng.choice([0.0, 5e-324, 1e200] if rng.random() < 0.1 else [rng.random(), rng.gauss(0, 50)])) for g in "ab" for _ in range(700)] + [("a", math.inf), ("b", -math.inf), ("b", math.nan), ("a", None)]
    rng.shuffle(rows)
    parts = [spark.createDataFrame(rows[a:b], "g string, v double") for a, b in ((0, 500), (500, None))]
    counts = quantiles.bin_counts(parts[0], ["g"], "v").unionByName(quantiles.bin_counts(parts[1], ["g"], "v")).groupBy("g", "bin").agg(F.sum("n").alias("n"))
    bins = quantiles.asked_bins(counts, ["g"], (0.5, 30, 50, 77, 95))
    hit = F.lit(False)
    for low, high in quantiles.bin_ranges(bins):
        assert low <= high
        hit = hit | F.col("v").between(low, high)
    read = parts[0].union(parts[1]).where(hit)
    got = {(r["g"], r["pct"]): r["value"] for r in quantiles.percentiles_in_bins(bins, read, ["g"], "v").collect()}
    for g in "ab":
        values = [v for k, v in rows if k == g and v is not None and not math.isnan(v)]
        for p in (0.5, 30.0, 50.0, 77.0, 95.0):
            assert got[g, p] == pytest.approx(np.percentile(values, p), rel=1e-12, abs=1e-300)
    assert 0 < read.count() < len(rows) / 2


def test_ranges_of_bins_meet_and_end_at_the_infinities(spark):
    width = 1 << 42
    one = lambda *at: quantiles.bin_ranges(spark.createDataFrame([(k,) for k in at], "_d0 long"))
    assert one(0, -1) == [(quantiles._double_of(-width), quantiles._double_of(width - 1))]
    assert one(2047 << 10)[0] == (math.inf, math.inf) and one(-(2047 << 10) - 1)[0][0] == -math.inf
    assert one(1, 5) == [(quantiles._double_of(width), quantiles._double_of(2 * width - 1)), (quantiles._double_of(5 * width), quantiles._double_of(6 * width - 1))]


def test_thousands_of_groups_at_once(spark):
    df = spark.range(60_000).select((F.col("id") % 3000).alias("g"), (F.hash("id") % 1000 / 7.0).alias("v"))
    got = quantiles.exact_percentiles(df, ["g"], "v", (1, 99)).groupBy("g").pivot("pct", [1.0, 99.0]).agg(F.first("value"))
    want = df.groupBy("g").agg(F.percentile("v", 0.01).alias("a"), F.percentile("v", 0.99).alias("b"))
    both = want.join(got, "g")
    assert both.count() == 3000 and both.where("abs(a - `1.0`) > 1e-9 OR abs(b - `99.0`) > 1e-9").count() == 0


def test_row_numbers_are_those_of_a_window_without_one(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise("rest").alias("g"), F.hash("id").alias("o"))
    numbered = quantiles.with_row_numbers(df, ["g"], ["o"], "rn", "n")
    assert "Window [row_number" not in plan_of(numbered)
    by_window = df.selectExpr("g", "o", "cast(row_number() over (partition by g order by o) - 1 as long) as rn", "count(*) over (partition by g) as n")
    assert numbered.exceptAll(by_window).count() == 0 and numbered.count() == 20_000
    assert colour.stride_sample(df, ["g"], ["o"], 100).groupBy("g").count().where("count between 100 and 200").count() == 3


# Neighbourhoods


@QUICK
@given(offsets=st.lists(st.one_of(st.none(), st.integers(0, 12).map(lambda k: k * k), st.integers(0, 90)), min_size=1, max_size=25), seed=st.integers(0, 99))
def test_lower_envelope_keeps_ties(offsets, seed):
    rng = random.Random(seed)
    at = [k for k, o in enumerate(offsets) if o is not None]
    if not at:
        return
    offset, row = [offsets[k] for k in at], [rng.randrange(3) for _ in at]
    asked = list(range(-2, len(offsets) + 2))
    got = grid.nearest_in_line(at, offset, row, asked)
    assert got == [min(range(len(at)), key=lambda s: ((at[s] - j) ** 2 + offset[s], row[s], at[s])) for j in asked]


def test_lower_envelope_is_linear():
    def took(n):
        rng = random.Random(n)
        at, offset = list(range(n)), [rng.randrange(400) ** 2 for _ in range(n)]
        began = time.perf_counter()
        grid.nearest_in_line(at, offset, [0] * n, at)
        return time.perf_counter() - began

    took(2_000)
    assert took(80_000) < 12 * took(20_000)  # four times the columns; a square would be sixteen times


def test_fill_has_no_cross_join(spark):
    field, cells = field_of(spark, np.full((4, 5), 2.0))
    assert "Cartesian" not in plan_of(grid.fill_land(field, ["k"], cells))


def test_gradient_and_smoothing_in_small_tiles(spark):
    """Tiles smaller than the grid, of which the last are partial, give what the whole grid gives; one shuffle of the cells."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(13, 22)) + 10
    v[rng.random(v.shape) < 0.2] = np.nan
    field, cells = field_of(spark, v)
    small, whole = (grid_of(grid.gradient(field, ["k"], cells, -2.0, 3.0, side).collect(), v.shape) for side in (4, 64))
    assert np.allclose(small, whole, equal_nan=True) and np.isnan(small).sum() == np.isnan(v).sum()
    size, sigma = grid.Grid(60.0, -2.0, 13, 120.0, 3.0, 22), 1.0
    pad = np.pad(np.nan_to_num(v), 4, mode="symmetric"), np.pad((~np.isnan(v)).astype(float), 4, mode="symmetric")
    kernel = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    kernel = np.outer(kernel, kernel) / kernel.sum() ** 2
    total, weight = (sum(kernel[a, b] * p[a : a + 13, b : b + 22] for a in range(9) for b in range(9)) for p in pad)
    want = np.where(np.isnan(v) | (weight <= 0.05), np.nan, total / weight)
    before, grid.TILE_CELLS = grid.TILE_CELLS, 5
    try:
        got = grid.smooth(field, ["k"], cells, size, sigma)
        plan = plan_of(got)
        assert np.allclose(grid_of(got.collect(), v.shape), want, equal_nan=True)
        assert plan.count("REPARTITION_BY_COL") == 1 and plan.count("Exchange hashpartitioning") == 2  # the other is of the few keys
    finally:
        grid.TILE_CELLS = before


def test_chunks_round_trip(spark):
    v = np.arange(7 * 11, dtype=float).reshape(7, 11)
    v[2, 3] = np.nan
    field, cells = field_of(spark, v)
    chunks = grids.pack_chunks(field, ["k"], cells, 4).collect()
    assert len(chunks) == 6 and max(len(r["data"]) for r in chunks) == 16 and all(len(r["data"]) == r["n_i"] * r["n_j"] for r in chunks)
    back = grids.unpack_chunks(grids.pack_chunks(field, ["k"], cells, 4), ["k"], 4)
    assert back.exceptAll(field).count() == field.exceptAll(back).count() == 0


def test_nearest_cell_on_irregular_axes(spark):
    rng = random.Random(5)
    lats, lons = [rng.choice([1, 2, 3, 5, 8]) * k / 2 for k in range(-9, 9)], [float(k * k) for k in range(20)] + [25.0]
    pts = [(k, rng.randrange(-300, 300) / 4, rng.randrange(-40, 1700) / 4) for k in range(200)] + [(900, None, 3.0)]
    axis = lambda v, names: spark.createDataFrame(list(enumerate(v)), names)
    got = {r["point_id"]: (r["i"], r["j"]) for r in points.nearest_cell(spark.createDataFrame(pts, "point_id long, lat double, lon double"), axis(lats, "i int, lat double"), axis(lons, "j int, lon double")).collect()}
    near = lambda axis, x: None if x is None else min(range(len(axis)), key=lambda k: (abs(axis[k] - x), k))
    assert got == {p: (near(lats, lat), near(lons, lon)) for p, lat, lon in pts}


# The store

SETTINGS = store.Settings((("p", 2000, 2006), ("q", 2004, None)), ("p",), -2.0, 3.0)


def history(spark):
    rng = random.Random(11)
    rows = [(i, j, y, m, None if rng.random() < 0.1 or (i, j) == (1, 1) else 5.0 if (i, j) == (0, 2) else 10 + i - j + 3 * math.sin(m) + rng.gauss(0, 1) + 0.1 * (y - 2000)) for i in range(3) for j in range(4) for y in range(2000, 2010) for m in (1, 2, 6, 7, 12)]
    return obs(spark, rows)


def compared(a, b, keys):
    """Rows of either side that differ by more than 1e-9, a constant series' maps included."""
    both = a.join(b.withColumnRenamed("value", "other"), keys, "full")
    return both.where("(value IS NULL) != (other IS NULL) OR abs(value - other) > 1e-9 * (1 + abs(other))")


def test_state_gives_the_products(spark):
    every = history(spark)
    plain = climate.products(every, SETTINGS.periods)
    sums = store.regression_state(every, store.season_years(every), SETTINGS.periods)
    keys = ["section", "season_type", "season_idx", "period", "i", "j"]
    assert compared(store.state_products(sums), plain, keys).count() == 0 and plain.count() > 500


def test_refreshed_store_equals_a_new_one(spark, tmp_path, since="2003-02-01"):
    """From the middle of a year on, whose season has some months before; and a second refresh upon the first."""
    every = history(spark)
    cells = observations.land_mask(every)
    whole, grown = VersionedStore(spark, str(tmp_path / "whole")), VersionedStore(spark, str(tmp_path / "grown"))
    store.build(whole, every, cells, SETTINGS)
    late = F.col("ts") >= F.lit(since).cast("timestamp")
    some = late & (F.col("ts") < F.lit("2009-12-01").cast("timestamp"))
    store.build(grown, every.where(~late), cells, SETTINGS)
    before = store.products_of(grown).count()
    store.refresh(grown, every.where(some), SETTINGS)
    assert store.refresh(grown, every.where(late & ~some), SETTINGS) == 3
    keys = ["section", "season_type", "season_idx", "period", "i", "j"]
    assert compared(store.products_of(grown), store.products_of(whole), keys).count() == 0
    assert compared(store.ticks_of(grown), store.ticks_of(whole), ["section", "pct"]).count() == 0
    assert store.products_of(grown, 1).count() == before
    assert compared(store.baselines_of(grown).withColumnRenamed("clim", "value"), store.baselines_of(whole).withColumnRenamed("clim", "value"), ["period", "month", "i", "j"]).count() == 0
    assert {r["section"] for r in store.products_of(grown).select("section").distinct().collect()} >= {"s6", "s7"}


def test_anomalies_and_their_scale_are_refreshed(spark, tmp_path):
    """Baseline p ends in 2006: rows of 2005 and 2006 move it, later ones don't; new dates, and a late row for a stored date."""
    every, cells = history(spark), observations.land_mask(history(spark))
    grown = VersionedStore(spark, str(tmp_path / "grown"))
    two = store.Settings(SETTINGS.periods, ("p", "q"), -2.0, 3.0)
    late = (F.col("year") == 2003) & (F.col("month") == 7) & (F.col("i") == 2)
    first = (F.col("year") < 2005) & ~late
    store.build(grown, every.where(first), cells, two)
    folders = lambda: dict(grown.manifest()["parts"]["anomalies"])
    before = folders()
    store.refresh(grown, every.where((F.col("year").between(2005, 2006) & (F.col("month") < 7)) | late), two)
    middle = folders()
    assert {k for k in before if middle[k] != before[k]} == {k for k in before if k.split("/")[1] in ("month=1", "month=2", "month=6")} | {k for k in before if k.startswith("period=p/month=7/")} | {"period=q/month=7/year=2003"}
    store.refresh(grown, every.where("year > 2006 or year between 2005 and 2006 and month >= 7"), two)
    last = folders()
    assert all(last[k] == middle[k] for k in middle if k.startswith("period=p/") and k.split("/")[1] in ("month=1", "month=2", "month=6"))
    keys = ["period", "month", "year", "i", "j"]
    pool = anomalies.anomaly(every, anomalies.baseline(every, SETTINGS.periods)).select("period", *keys[1:], "value").where("value IS NOT NULL")
    assert compared(store.anomalies_of(grown).where("value IS NOT NULL").drop("sst"), pool, keys).count() == 0 and pool.count() > 500
    left = grown.read("anomaly_counts", store.COUNT_SCHEMA).groupBy("period", "measure").agg(F.sum("n").alias("n")).collect()
    assert {tuple(r) for r in left} == {(r["period"], m, r["count"]) for r in pool.groupBy("period").count().collect() for m in ("value", "size")}
    wide = lambda df: {r["period"]: pytest.approx(tuple(r)[1:], rel=1e-9) for r in df.collect()}
    scale = {r["period"]: tuple(r)[1:] for r in store.anomaly_scale_of(grown).collect()}
    assert scale == wide(colour.anomaly_scale(pool)) and set(scale) == {"p", "q"}
    assert compared(store.anomaly_ticks_of(grown), colour.anomaly_ticks(pool), ["period", "pct"]).count() == 0


def test_a_reader_of_few_anomalies_skips_by_folder_and_value(spark, tmp_path):
    kept = VersionedStore(spark, str(tmp_path / "store"))
    store.build(kept, history(spark), observations.land_mask(history(spark)), SETTINGS)
    rows = store.anomalies_of(kept).where(~store._in_slices([("p", 1)], [(2003, 2), (2003, 6)]) & F.col("value").between(1.0, 1.5)).select("period", "value")
    plan = plan_of(rows)
    assert re.search(r"PartitionFilters: \[[^\]]*month", plan) and "GreaterThanOrEqual(value,1.0)" in plan and "ReadSchema: struct<value:double>" in plan
    found = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
    assert found.count() == store.anomalies_of(kept).where("value between 1.0 and 1.5 and not (period = 'p' and month = 1) and not (year = 2003 and month in (2, 6))").count() > 0


def test_a_store_without_baselines_has_no_anomalies(spark, tmp_path):
    kept, none = VersionedStore(spark, str(tmp_path / "store")), store.Settings((), (), -2.0, 3.0)
    store.build(kept, history(spark).where("year < 2009"), observations.land_mask(history(spark)), none)
    store.refresh(kept, history(spark).where("year = 2009"), none)
    assert store.anomalies_of(kept).count() == store.anomaly_scale_of(kept).count() == store.anomaly_ticks_of(kept).count() == 0
    assert store.products_of(kept).where("section = 's1'").count() > 0


def test_a_failing_writer_shows_nothing(spark, tmp_path):
    kept = VersionedStore(spark, str(tmp_path / "store"))
    table = lambda v: spark.createDataFrame([(k, v) for k in range(4)], "part int, v int")
    kept.commit({"a": table(1), "b": table(1)}, {"a": ["part"]})
    broken = table(2).withColumn("v", F.when(F.col("part") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="no"):
        kept.commit({"a": table(2), "b": broken}, {"a": ["part"]})
    read = lambda t, version=None: sorted((r["part"], r["v"]) for r in kept.read(t, "v INT, part INT", version).collect())
    assert read("a") == read("b") == [(k, 1) for k in range(4)] and kept.versions() == [1]
    held = kept.read("a", "v INT, part INT")
    kept.commit({"a": table(3).where("part = 2"), "b": table(3)}, {"a": ["part"]})
    assert sorted((r["part"], r["v"]) for r in held.collect()) == [(k, 1) for k in range(4)]  # a reader keeps what it began with
    assert read("a") == [(0, 1), (1, 1), (2, 3), (3, 1)] and read("a", 1) == [(k, 1) for k in range(4)]
    kept.vacuum(1)
    assert kept.versions() == [2] and read("a") == [(0, 1), (1, 1), (2, 3), (3, 1)] and read("b") == [(k, 3) for k in range(4)]


def test_a_number_in_use_is_not_taken(spark, tmp_path):
    kept = VersionedStore(spark, str(tmp_path / "store"))
    kept.commit({"a": spark.range(1)})
    with pytest.raises(RuntimeError, match="another writer"):
        kept._publish(kept.manifest(), 1)
