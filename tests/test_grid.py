"""Hand-made frames, independent numpy checks and properties of the grid operators."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isogrid.functions import columns as fn
from isogrid.operators import anomalies, climate, colour, grid, observations, points, polygons, quantiles, series, updates
from isogrid.sources import grids

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
OBS = "i int, j int, lat double, lon double, ts timestamp, year int, month int, ess_idx int, x double, sst double"


def obs(spark, rows):
    """rows: (i, j, year, month, sst)."""
    full = spark.createDataFrame([(i, j, 60.0 - i, 120.0 + j, y, m, None if v is None else float(v)) for i, j, y, m, v in rows], "i int, j int, lat double, lon double, year int, month int, sst double")
    full = full.withColumn("ts", F.make_timestamp("year", "month", F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return observations.with_x(observations.with_season(full)).select(*[c.split()[0] for c in OBS.split(", ")])


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_cleaning_and_time(spark):
    rows = spark.createDataFrame([(0, 273.15), (1, float("nan")), (2, -32767.0), (3, 373.15), (4, 373.16), (5, None)], "valid_time long, sst double")
    got = [r["sst"] for r in observations.clean_sst(rows).orderBy("valid_time").collect()]
    assert got[0] == 0 and got[1] is got[2] is got[4] is got[5] is None and abs(got[3] - 100) < 1e-9
    r = one(observations.decode_time(spark.createDataFrame([(951782400,)], "valid_time long")))
    assert (r["year"], r["month"], r["label"]) == (2000, 2, "2000-02")


def test_december_belongs_to_its_own_year(spark):
    rows = [(0, 0, 2000, m, v) for m, v in ((1, 1), (2, 2), (12, 9))] + [(0, 0, 1999, 12, 100)]
    base = anomalies.baseline(obs(spark, rows), (("p", 1990, 2010),))
    got = {r["ess_idx"]: r["value"] for r in anomalies.anomaly_season(obs(spark, rows), base, 2000).collect()}
    assert abs(got[0] - (4 - (1 + 2 + 54.5) / 3)) < 1e-9


def test_season_statistics_pool_months_but_variance_trend_takes_yearly_means(spark):
    rows = [(0, 0, y, m, 10 * (m % 3) + y - 2000) for y in range(2000, 2006) for m in (3, 4, 5)]
    var = [r["value"] for r in climate.clim_var(obs(spark, rows), "ess").collect()]
    assert abs(var[0] - np.var([10 * (m % 3) + y for y in range(6) for m in (3, 4, 5)])) < 1e-9
    sq = {r["year"]: r["sq"] for r in climate.sq_anomaly(obs(spark, rows), "ess").collect()}
    assert abs(sq[2000] - 2.5**2) < 1e-9


@pytest.mark.parametrize(("n", "known"), [(4, False), (5, True)])
def test_trend_needs_five_values(spark, n, known):
    rows = [(0, 0, 2000 + k, 1, k) for k in range(n)] + [(0, 0, 2010, 1, None)]
    r = one(climate.moments(obs(spark, rows), ("monthly",)))
    assert (r["trend"] is not None) == known and (not known or abs(r["trend"] - 10) < 1e-9 and abs(r["r2"] - 1) < 1e-9 and r["p"] < 1e-6)


def test_constant_series_has_no_trend(spark):
    r = one(climate.moments(obs(spark, [(0, 0, 2000 + k, 1, 7) for k in range(6)]), ("monthly",)))
    assert (r["trend"], r["r2"], r["p"]) == (0, 0, 1) and one(climate.significant_trend(obs(spark, [(0, 0, 2000 + k, 1, 7) for k in range(6)])))["value"] is None


def test_p_value_at_table_values(spark):
    table = {1: 12.706205, 3: 3.182446, 4: 2.776445, 5: 2.570582, 10: 2.228139, 30: 2.042272}
    rows = spark.createDataFrame([(df + 2, t * t / (t * t + df)) for df, t in table.items()], "n long, r2 double")
    for r in rows.select(fn.p_value(F.col("r2"), F.col("n")).alias("p")).collect():
        assert abs(r["p"] - 0.05) < 1e-6


def test_trend_against_closed_form(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=12)
    r = one(climate.moments(obs(spark, [(0, 0, 2000 + k, 6, y[k]) for k in range(12)]), ("monthly",)))
    slope = np.polyfit(np.arange(12), y, 1)[0]
    assert abs(r["trend"] - slope * 10) < 1e-9 and abs(r["r2"] - np.corrcoef(np.arange(12), y)[0, 1] ** 2) < 1e-9 and abs(r["variance"] - y.var()) < 1e-9


@QUICK
@given(a=st.floats(-2, 2), b=st.floats(-20, 20))
def test_line_gives_its_slope(spark, a, b):
    r = one(climate.moments(obs(spark, [(0, 0, 2000 + k, 1, a * k + b) for k in range(8)]), ("monthly",)))
    assert abs(r["trend"] - 10 * a) < 1e-6


def test_rolling_variance_trend(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=9)
    years = [2000, 2001, 2003, 2004, 2005, 2006, 2008, 2009, 2010]
    got = one(climate.rolling_var_trend(obs(spark, [(0, 0, y, 1, x) for y, x in zip(years, v)]), 4, 5))["value"]
    rv, ry = np.array([np.var(v[s : s + 4]) for s in range(6)]), np.array([years[s + 2] for s in range(6)], float)
    ry -= ry.mean()
    assert abs(got - ry @ rv / (ry @ ry) * 10) < 1e-9
    assert one(climate.rolling_var_trend(obs(spark, [(0, 0, y, 1, x) for y, x in zip(years, v)]), 4, 7))["value"] is None


def test_anomalies_over_their_base_period_average_to_zero(spark):
    rng = np.random.default_rng(6)
    o = obs(spark, [(i, 0, y, m, rng.normal()) for i in range(3) for y in range(1990, 1995) for m in range(1, 13)])
    a = anomalies.anomaly(o, anomalies.baseline(o, (("p", 1990, 1994),)))
    assert max(abs(r["v"]) for r in a.groupBy("i", "month").agg(F.avg("value").alias("v")).collect()) < 1e-12


def test_annual_series_pairs_both_sides(spark):
    o = obs(spark, [(0, 0, 2000, 1, 5), (0, 0, 2000, 2, None), (0, 0, 2001, 2, 3), (0, 0, 2002, 1, None)])
    base = anomalies.baseline(o, (("p", 1990, 2010),))
    pts = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "point_id long, i int, j int")
    got = {(r["point_id"], r["year"]): r["value"] for r in points.point_annual(pts, anomalies.anomaly(o, base), "value").collect()}
    assert got == {(p, y): v for p in (1, 2) for y, v in ((2000, 0.0), (2001, 0.0), (2002, None))}


def test_composite_of_equal_maps_is_the_map(spark):
    maps = spark.createDataFrame([("s1", "monthly", m, "all", 0, 0, 4.5 if m % 2 else None) for m in range(12)], grids.PRODUCT_SCHEMA)
    for kind in ("seasonal", "annual"):
        assert {r["value"] for r in climate.composite(maps, kind).collect()} == {4.5}


def field_of(spark, values):
    h, w = values.shape
    cells = spark.createDataFrame([(i, j, 60.0 - 2 * i, 120.0 + 3 * j, bool(np.isnan(values[i, j]))) for i in range(h) for j in range(w)], "i int, j int, lat double, lon double, is_land boolean")
    field = spark.createDataFrame([(1, i, j, None if np.isnan(values[i, j]) else float(values[i, j])) for i in range(h) for j in range(w)], "k int, i int, j int, value double")
    return field, cells


def grid_of(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r["i"], r["j"]] = np.nan if r["value"] is None else r["value"]
    return out


def test_gradient_against_numpy(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(5, 6)) + 10
    v[2, 3] = np.nan
    field, cells = field_of(spark, v)
    got = grid_of(grid.gradient(field, ["k"], cells, -2.0, 3.0).collect(), v.shape)
    gy, gx = np.gradient(np.nan_to_num(v))
    gx /= (np.cos(np.deg2rad(60.0 - 2 * np.arange(5))) * 3 * 111)[:, None]
    want = np.sqrt((gy / 222 * 100) ** 2 + (gx * 100) ** 2)
    want[2, 3] = np.nan
    assert np.allclose(got, want, equal_nan=True)


def test_fill_land_against_brute_force(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(9, 11))
    v[rng.random(v.shape) < 0.6] = np.nan
    field, cells = field_of(spark, v)
    got = grid_of(grid.fill_land(field, ["k"], cells).collect(), v.shape)
    src = [(i, j) for i in range(9) for j in range(11) if not np.isnan(v[i, j])]
    for i in range(9):
        for j in range(11):
            if np.isnan(v[i, j]) and 0 < i < 8 and 0 < j < 10:
                a, b = min(src, key=lambda s: ((s[0] - i) ** 2 + (s[1] - j) ** 2, s[0], s[1]))
                assert got[i, j] == v[a, b]
            else:
                assert got[i, j] == v[i, j] or np.isnan(got[i, j]) and np.isnan(v[i, j])


def test_fill_land_without_any_value_gives_zero(spark):
    field, cells = field_of(spark, np.full((3, 3), np.nan))
    got = grid_of(grid.fill_land(field, ["k"], cells).collect(), (3, 3))
    assert got[1, 1] == 0 and np.isnan(got).sum() == 8


@QUICK
@given(a=st.floats(-3, 3), b=st.floats(-3, 3))
def test_bilinear_is_exact_on_planes(spark, a, b):
    v = np.array([[a * (60.0 - 2 * i) + b * (120.0 + 3 * j) for j in range(4)] for i in range(4)])
    field, _ = field_of(spark, v)
    targets = spark.createDataFrame([(1, 57.3, 123.4), (2, 60.0, 129.0), (3, 54.0, 120.0), (4, 61.0, 121.0)], "target_id long, lat double, lon double")
    got = {r["target_id"]: r["value"] for r in grid.resample_bilinear(targets, field, grid.Grid(60.0, -2.0, 4, 120.0, 3.0, 4)).collect()}
    assert got[4] is None and all(abs(got[t] - (a * lat + b * lon)) < 1e-6 for t, lat, lon in ((1, 57.3, 123.4), (2, 60.0, 129.0), (3, 54.0, 120.0)))


def test_smoothing_keeps_a_constant(spark):
    v = np.full((6, 8), 3.5)
    v[2, 2] = np.nan
    field, cells = field_of(spark, v)
    got = grid_of(grid.smooth(field, ["k"], cells, grid.Grid(60.0, -2.0, 6, 120.0, 3.0, 8), 2.0).collect(), v.shape)
    assert np.isnan(got[2, 2]) and np.allclose(got[~np.isnan(v)], 3.5)


def test_nearest_cell_takes_the_first_of_equals(spark):
    lat = spark.createDataFrame([(0, 60.0), (1, 58.0)], "i int, lat double")
    lon = spark.createDataFrame([(0, 120.0), (1, 123.0)], "j int, lon double")
    pts = spark.createDataFrame([(1, 59.0, 121.5), (2, 10.0, 300.0)], "point_id long, lat double, lon double")
    assert {(r["point_id"], r["i"], r["j"]) for r in points.nearest_cell(pts, lat, lon).collect()} == {(1, 0, 0), (2, 1, 1)}


@QUICK
@given(lat=st.floats(-80, 80), lon=st.floats(0, 359))
def test_mercator_inverse(spark, lat, lon):
    r = one(spark.range(1).select(fn.lat_of(fn.mercator_y(F.lit(lat))).alias("lat"), fn.lon_of(fn.mercator_x(F.lit(lon))).alias("lon")))
    assert abs(r["lat"] - lat) < 1e-9 and abs(r["lon"] - lon) < 1e-9


def test_rasterized_square_with_hole_and_island(spark):
    ring = lambda c, r: [[c - r, c - r], [c + r, c - r], [c + r, c + r], [c - r, c + r], [c - r, c - r]]
    rows = [(0, 0, k, k > 0, s, float(x), float(y), "west") for k, rr in enumerate((8, 4)) for s, (x, y) in enumerate(ring(10, rr))]
    rows += [(1, 0, 0, False, s, float(x), float(y), "west") for s, (x, y) in enumerate(ring(10, 1))]
    v = spark.createDataFrame(rows, "feature_id long, poly_id int, ring_id int, is_hole boolean, seq int, x double, y double, half string")
    v = polygons.gather_rings(v)
    land = {(r["px"], r["py"]) for r in polygons.rasterize(v, 20, 20).collect()}
    want = {(x, y) for x in range(20) for y in range(20) if max(abs(x - 9.5), abs(y - 9.5)) < 8 and not max(abs(x - 9.5), abs(y - 9.5)) < 4 or max(abs(x - 9.5), abs(y - 9.5)) < 1}
    assert land == want and polygons.ocean_pixels(polygons.rasterize(v, 20, 20), 20, 20).where("is_ocean").count() == 400 - len(want)


def test_ring_paths_break_at_jumps_and_drop_single_points(spark):
    xs = [0.0, 5.0, 90.0, 95.0, 1.0]
    v = spark.createDataFrame([(0, 0, 0, s, x, 1.0, "west") for s, x in enumerate(xs)], "feature_id int, poly_id int, ring_id int, seq int, x double, y double, half string")
    assert sorted(r["path"] for r in polygons.ring_paths(v, 100).collect()) == ["M0.0,1.0L5.0,1.0", "M90.0,1.0L95.0,1.0"]


def test_running_mean_and_trend_line(spark):
    v = [1.0, None, 4.0, 6.0, 9.0]
    s = spark.createDataFrame([(1, k, str(k), x) for k, x in enumerate(v)] + [(2, 0, "0", 1.0), (2, 1, "1", 2.0)], "point_id int, seq int, label string, value double")
    got = [r["mean"] for r in series.running_mean(s, 3).where("point_id = 1").orderBy("seq").collect()]
    assert got == [1.0, 2.5, 5.0, pytest.approx(19 / 3), 7.5]
    fit = {(r["point_id"], r["seq"]): r["fit"] for r in series.trend_line(s).collect()}
    a, b = np.polyfit([0, 2, 3, 4], [1, 4, 6, 9], 1)
    assert all(abs(fit[1, k] - (a * k + b)) < 6e-4 for k in range(5)) and fit[2, 0] is None


def test_percentiles_ranges_and_ticks(spark):
    v = np.arange(101.0)
    maps = spark.createDataFrame([("s1", "monthly", 0, "all", k, 0, float(x)) for k, x in enumerate(v)], grids.PRODUCT_SCHEMA)
    ticks = {r["pct"]: r["value"] for r in colour.section_ticks(maps).collect()}
    assert all(abs(ticks[p] - np.percentile(v, p)) < 1e-9 for p in colour.TICK_PERCENTS)
    r = one(colour.value_range(maps, ["section"], F.lit(False)))
    assert (r["vmin"], r["vmax"]) == (1.0, 99.0)
    r = one(colour.value_range(maps.withColumn("value", F.lit(None).cast("double")), ["section"], F.lit(True)))
    assert (r["vmin"], r["vmax"]) == (0.0, 1.0)
    legend = colour.legend_ticks(colour.section_ticks(maps), colour.value_range(maps, ["section"], F.lit(False), 100), ["section"]).orderBy("pct").collect()
    assert [r["pct"] for r in legend][-1] == 99 and len(legend) == 12


def test_color_table_ends_and_truncation(spark):
    lut = {(r["cmap"], r["idx"]): (r["r"], r["g"], r["b"]) for r in colour.color_lut(spark).collect()}
    assert len(lut) == 5 * 256 and lut["YlOrRd", 0] == (255, 255, 204) and lut["Viridis", 255] == (253, 231, 37)
    f = (1 / 255) / 0.25
    assert lut["YlOrRd", 1] == tuple(int(a + f * (b - a)) for a, b in zip((255, 255, 204), (254, 217, 118)))


def test_updates_add_once_and_count_months(spark):
    o = obs(spark, [(0, 0, 2000, m, m) for m in range(1, 7)])
    new = obs(spark, [(0, 0, 2000, m, -m) for m in (5, 6, 7, 7, 8)])
    merged = updates.merge_sorted(o, new)
    assert [r["sst"] for r in merged.collect()] == [1, 2, 3, 4, 5, 6, -7, -7, -8]
    assert updates.append_new(merged, new).count() == 0
    assert [str(r["month_start"]) for r in updates.missing_months(o, "2001-01-15", 3).collect()] == ["2000-07-01", "2000-08-01", "2000-09-01", "2000-10-01"]
    assert updates.missing_months(o, "2000-07-15", 2).count() == 0
    axes = one(updates.request_axes(updates.missing_months(o, "2001-04-01", 2)))
    assert axes["years"] == [2000, 2001] and axes["months"] == ["01", "02", "07", "08", "09", "10", "11", "12"]


def test_products_round_trip_and_period_fallback(spark, tmp_path):
    o = obs(spark, [(i, 0, y, m, y + m + i) for i in range(2) for y in range(2000, 2006) for m in (1, 7)])
    every = climate.products(o, (("p", 2000, 2004),))
    grids.write_products(every, str(tmp_path / "products"))
    assert grids.read_products(spark, str(tmp_path / "products")).count() == every.count()
    plan = grids.read_field(spark, str(tmp_path / "products"), "s1", "monthly", 0, "p")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan
    own, fallback = (grids.read_field(spark, str(tmp_path / "products"), "s1", "monthly", 0, p).orderBy("i").collect() for p in ("p", "q"))
    assert [r["value"] for r in own] == [2003.0, 2004.0] and [r["value"] for r in fallback] == [2003.5, 2004.5]


def test_one_exchange_for_all_statistics(spark):
    o = obs(spark, [(0, 0, 2000, 1, 1)])
    plan = climate.moments(o, ("monthly", "ess"), (observations.ALL_YEARS, ("p", 1990, 2000), ("q", 1995, None)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_labels(spark):
    row = one(spark.range(1).select(fn.fmt_coord(F.lit(-5.25), F.lit(170.5)).alias("c"), fn.fmt_num(F.lit(2.345), 2).alias("n"), fn.fmt_num(F.lit(None).cast("double"), 2).alias("m"), fn.norm_lon(F.lit(246.0)).alias("l")))
    assert row["c"] == "5°15′S 170°30′E" and row["n"] in ("2,35", "2,34") and row["m"] == "—" and row["l"] == -114.0
    assert not math.isnan(row["l"])


def test_pooled_percentiles_equal_sorting(spark):
    """Ties that hold a third of the rows, one value, two values, NULLs, and a group without values."""
    groups = {
        "spread": [((k * 7919) % 1009) / 7.0 for k in range(1009)],
        "hot": [3.5] * 400 + [float(k) for k in range(800)],
        "one": [2.0],
        "two": [1.0, 4.0],
        "some": [None, 5.0, None, -1.0, 2.0],
        "none": [None, None],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    percents = (0, 1, 33.3, 50, 99, 99.9, 100)
    got = {(r["g"], r["pct"]): r["value"] for r in quantiles.exact_percentiles(df, ["g"], "v", percents).collect()}
    want = {(g, float(p)): float(np.percentile(known, p)) for g, vs in groups.items() if (known := [v for v in vs if v is not None]) for p in percents}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
