"""What larger tables brought to light: results, and plans whose work grows no faster than their input."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isogrid.functions import columns as fn
from isogrid.operators import anomalies, climate, colour, observations, polygons, quantiles
from isogrid.plans import fixtures as fx
from isogrid.plans import oracles as ora
from isogrid.plans import queries
from isogrid.sources.scratch import stored_rows, tasks_for

SF = "/root/testdata/sf0.001"
PLACED = "half string, feature_id int, poly_id int, rings array<struct<x: array<double>, y: array<double>>>"


def test_small_negative_numbers_keep_their_sign(spark):
    """As printf writes them: -0.004 is -0,00; halves are those of the double."""
    values = [-0.004, 0.004, -0.0, 0.0, -1.255, 2.5, 2.675, None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(fn.fmt_num(F.col("v"), 2).alias("t")).collect()
    assert [r["t"] for r in rows] == ["-0,00", "0,00", "-0,00", "0,00", "-1,25", "2,50", "2,68", "—"]


def test_legend_labels_keep_the_sign_of_zero(spark):
    ticks = spark.createDataFrame([("s", 5, -0.31), ("s", 10, -0.04), ("s", 20, 0.5)], "section string, pct int, value double")
    ranges = spark.createDataFrame([("s", -0.31, 0.5)], "section string, vmin double, vmax double")
    rows = colour.legend_ticks(ticks, ranges, ["section"]).orderBy("pct").collect()
    assert [r["label"] for r in rows] == ["-0,3", "-0,0", "0,5"]


def test_legend_of_one_value_as_in_sql(spark, monkeypatch):
    """A section may have one value, positive or not, one value many times, or hardly more than one."""
    values = {"s1": [1.5, 2.3, 9.1], "s2": [0.0099], "s3": [0.0, 0.0], "s4": [-3.0] * 5, "s5": [None, 1e-9, 2e-9], "s5_raw": [None]}
    rows = [(s, "monthly", 0, "all", k, 0, v) for s, vs in values.items() for k, v in enumerate(vs)]
    monkeypatch.setattr(queries, "monthly_all", lambda spark, d: spark.createDataFrame(rows, queries.grids.PRODUCT_SCHEMA))
    got = queries.QUERIES["k5_legend_ticks"](spark, SF)
    made = ", ".join(f"('{s}', '{t}', {k}, '{p}', {i}, {j}, CAST({'NULL' if v is None else v} AS DOUBLE))" for s, t, k, p, i, j, v in rows)
    text = f"WITH prod(section, season_type, season_idx, period, i, j, value) AS (VALUES {made})" + queries.ORACLES["k5_legend_ticks"].removeprefix(ora.BASE)
    want = duckdb.sql(text).select(*got.columns).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r[0]: r[3:] for r in want}["s2"] == (1.0, "0,0099")


def test_baselines_of_a_growing_grid_are_not_broadcast(spark):
    """The planner takes cells that are made from few bytes to be few."""
    obs = fx.fine_obs(spark, SF)
    plan = anomalies.anomaly_annual(obs, anomalies.baseline(obs, fx.PERIODS[:2]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1  # the one row of the last year


def test_months_of_a_growing_grid_do_not_move(spark):
    """Cells are dealt before they have months: statistics by cell need no exchange by key."""
    for stats in (climate.significant_trend(fx.fine_obs(spark, SF)), climate.var_trend(fx.fine_obs(spark, SF), "ess"), observations.land_mask(fx.fine_obs(spark, SF))):
        plan = stats._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and plan.count("Exchange rangepartitioning") == 1


def test_tasks_grow_with_the_rows(spark):
    assert tasks_for(spark, 0, 100) == tasks_for(spark, 100, 100) == spark.sparkContext.defaultParallelism
    assert tasks_for(spark, 100_001, 100) == 1001


def test_map_values_are_stored_without_an_exchange(spark, monkeypatch):
    """What percentiles of maps are made of: five columns, written where they are."""
    seen = []
    monkeypatch.setattr(queries, "stored_rows", lambda df, name: seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or stored_rows(df, name))
    for name in ("k1_section_ticks_fine", "k4_value_range_fine"):
        queries.QUERIES[name](spark, SF)
    assert len(seen) == 2
    for columns, plan in seen:
        assert columns == ["section", "season_type", "season_idx", "period", "value"] and "Exchange hashpartitioning" not in plan


def _series(spark, cells: list[list[float | None]], line: int = 2):
    """A cell for each list, ``line`` of them on a line, with its values from January 1995 on; None for a missing month."""
    rows = [(k // line, k % line, 1995 + m // 12, m % 12 + 1, m % 12 // 3, 1995 + m // 12 + m % 12 / 12.0, v) for k, vs in enumerate(cells) for m, v in enumerate(vs)]
    return spark.createDataFrame(rows, "i int, j int, year int, month int, ess_idx int, x double, sst double")


def test_values_of_lines_are_those_of_the_maps(spark):
    """Rising, constant, two-valued, short, gappy and empty series."""
    rng = np.random.default_rng(5)
    noisy = [[float(v) for v in 0.03 * np.arange(96) * k + rng.normal(0, 1, 96)] for k in range(4)]
    gappy = [[v if rng.random() < 0.7 else None for v in vs] for vs in noisy]
    odd = [[4.7] * 96, [3.0 if m // 12 % 2 else 5.0 for m in range(96)], [1.5] * 30, [float(m) for m in range(96)], [None] * 96]
    obs = _series(spark, noisy + gappy + odd)
    long = climate.products(obs, (), season_types=("monthly",)).where("value IS NOT NULL").groupBy("section", "season_idx").agg(F.sort_array(F.collect_list("value")).alias("v")).collect()
    lines = climate.line_values(obs).select("section", "season_idx", F.explode("value.values").alias("v")).groupBy("section", "season_idx").agg(F.sort_array(F.collect_list("v")).alias("v")).collect()
    want, got = ({(r["section"], r["season_idx"]): r["v"] for r in rows} for rows in (long, lines))
    assert got.keys() == want.keys() and {s for s, _ in got} == {"s1", "s2", "s2_raw", "s3", "s4", "s5", "s5_raw"}
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_two_observations_of_a_month_raise(spark):
    obs = _series(spark, [[1.0, 2.0]])
    with pytest.raises(Exception, match="more than one observation"):
        climate.line_values(obs.unionByName(obs)).collect()


def test_percentiles_of_sorted_parts(spark):
    """As of single values, over several orders and both signs; groups in many parts, empty parts, NaN."""
    rng = np.random.default_rng(6)
    values = {"a": [rng.normal(0, 10.0**k, 300) for k in range(-3, 4)] + [np.array([])], "b": [np.array([0.0, -0.0, 5e-324, -1e-310, math.nan, math.inf])], "c": [np.full(50, -2.5)] * 3, "d": [np.array([math.nan])]}
    rows = [(k, v) for k, parts in values.items() for v in parts]
    parts = spark.createDataFrame(pa.table({"k": pa.array([k for k, _ in rows]), "value": quantiles.sorted_pools([v for _, v in rows])}))
    single = spark.createDataFrame([(k, float(x)) for k, v in rows for x in v], "k string, value double")
    got, want = (sorted(map(tuple, d.collect())) for d in (quantiles.sorted_percentiles(parts, ["k"], "value", (0, 1, 5, 50, 99, 100)), quantiles.exact_percentiles(single, ["k"], "value", (0, 1, 5, 50, 99, 100))))
    assert got == want and {k for k, _, _ in got} == {"a", "b", "c"}
    assert dict((p, v) for k, p, v in got if k == "a")[50] == pytest.approx(np.median(np.concatenate(values["a"])))


def test_ticks_make_no_row_of_a_value(spark, monkeypatch):
    """Observations are neither sorted nor numbered by cell, and what is stored has a row for each map of a line."""
    seen = []
    monkeypatch.setattr(queries, "stored_rows", lambda df, name: seen.append((df, stored_rows(df, name))) or seen[-1][1])
    queries.QUERIES["k1_section_ticks_fine"](spark, SF)
    (made, stored), lines = seen[0], fx.fine_grid(spark, SF).n_lat
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort [i#" in plan and "Exchange hashpartitioning" not in plan
    assert stored.count() == lines * 7 * 12


def test_stride_sample_by_lines(spark):
    """The same rows as by ranges: empty lines, NULLs, steps longer and shorter than a line."""
    rows = [(k % 3 if k % 50 else None, k // 97 % 5 if k % 31 else None, k // 7 % 11, k * 7 % 2003) for k in range(2000)]
    df = spark.createDataFrame(rows, "g int, t int, i int, j int")
    for n in (3, 40, 5000):
        by_ranges, by_lines = (sorted(map(str, colour.stride_sample(df, ["g"], ["t", "i", "j"], n, by_lines=lines).collect())) for lines in (False, True))
        assert by_ranges == by_lines


def test_stride_sample_moves_no_rows(spark, tmp_path):
    plan = colour.stride_sample(fx.fine_obs(spark, SF), ["month"], ["ts", "i", "j"], 50, by_lines=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "sst" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_series_of_points_move_once(spark):
    """Points are dealt before they get series; the observations are made of the table once, so their size is known."""
    for name in ("j6_point_timeseries", "a20_annual_mean", "w1_running_mean", "w2_trend_line", "s7_series_json"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(point_id" in line]
        assert len(moved) == 1 and "REPARTITION_BY_NUM" in moved[0] and "lineitem" not in plan, name


def test_polygon_documents_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(fx, "POLYGONS_EACH", 4)
    sizes = [r["count"] for r in fx.feature_parts(spark, SF).groupBy("part").count().collect()]
    assert sum(sizes) == fx.features(spark, SF).count() and max(sizes) <= 4


def test_crossings_do_not_move(spark):
    """Polygons are dealt by number, before they get vertices and as pieces; only ends of what a task covers are exchanged."""
    for name in ("j14_rasterize", "j14_rasterize_fine", "j15_sample_mask"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(half" in line]
        assert plan.count("REPARTITION_BY_NUM") == 2 and len(moved) == 1 and "py#" not in moved[0], name


def test_overlapping_polygons_end_as_one(spark):
    """However many polygons a task has, what it hands on is the outline of them all."""
    square = lambda k: ("west", k, 0, [([5.0 + k % 3, 15.0, 15.0, 5.0 + k % 3], [5.0, 5.0, 15.0, 15.0])])
    polys = spark.createDataFrame([square(k) for k in range(600)], PLACED).coalesce(1)
    assert polygons.land_ends(polygons.pieces(polys, 20), 20, 20).count() == 20
    assert sorted(map(tuple, polygons.land_runs(polys, 20, 20).collect())) == [(py, 5, 14) for py in range(5, 15)]


def test_large_polygons_are_cut_in_bands(spark, monkeypatch):
    """A saw of 2,000 teeth with a hole, one without an edge, and one beyond the picture: bands add up to the whole."""
    saw = ([k / 100 for k in range(4000)] + [40.0, 0.0], [3.0 + 20 * (k % 2) + k % 7 / 8 for k in range(4000)] + [29.0, 29.0])
    hole = ([10.0, 20.0, 20.0, 10.0], [24.0, 24.0, 28.0, 28.0])
    rows = [("west", 0, 0, [saw, hole]), ("west", 1, 0, [([], [])]), ("west", 2, 0, [([1.0, 2.0, 3.0], [90.0, 95.0, 91.0])])]
    polys = spark.createDataFrame(rows, PLACED)
    whole = sorted(map(tuple, polygons.land_runs(polys, 40, 30).collect()))
    assert whole and polygons.pieces(polys, 30).count() == 1
    monkeypatch.setattr(polygons, "PIECE_CROSSINGS", 8_000)
    monkeypatch.setattr(polygons, "SWEPT_CROSSINGS", 10_000)
    pieces = polygons.pieces(polys, 30).collect()
    assert len(pieces) > 5 and all(e["first"] <= r["high"] and e["last"] >= r["low"] for r in pieces for e in r["edges"])
    assert sum(r["high"] - r["low"] + 1 for r in pieces) == max(e["last"] for r in pieces for e in r["edges"]) - min(e["first"] for r in pieces for e in r["edges"]) + 1
    assert sorted(map(tuple, polygons.land_runs(polys, 40, 30).collect())) == whole


def test_filling_reads_observations_once_and_columns_forwards(spark, monkeypatch):
    """The mask and the field are of one pass, and no window runs to a column's end, whose work grows with its square."""
    seen = []
    monkeypatch.setattr(queries, "stored_rows", lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or stored_rows(df, name))
    plan = queries.QUERIES["n2_fill_land_fine"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(seen) == 1 and seen[0].count("Generate") == 1 and "Exchange hashpartitioning" not in seen[0]
    assert "Generate" not in plan and "orders.parquet" not in plan
    assert plan.count("Window ") and "unboundedfollowing" not in plan.lower()
