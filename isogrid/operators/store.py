"""A product store that is built once and refreshed by new rows alone, each change visible as a whole.

Tables: ``products`` (s1 to s7 and the unmasked s2 and s5; a folder for each month or season and period, whose maps change
together), ``ticks``, and what a refresh starts from:
``state`` and ``years`` (``state.regression_state`` and ``state.season_years``) and ``cells``. A refresh reads neither old
observations nor maps of months that new rows don't touch, but for the ticks, which are of all monthly maps.

``anomalies`` are those of every observation against each baseline period, a folder for each month's slice, sorted by value;
``anomaly_counts`` (``quantiles.bin_counts`` of the anomalies and of their sizes) add up, so a refresh adds those of new slices and
exchanges those of slices whose baseline moved. They tell in which bins the asked ranks lie, and only values in these bins are
read to find ``anomaly_ticks`` and ``anomaly_scale`` exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.grids import PRODUCT_SCHEMA
from ..sources.scratch import stored_rows
from ..sources.versions import VersionedStore
from .climate import product
from .colour import SCALE_PERCENTS, TICK_PERCENTS, scale_of, section_ticks
from .grid import gradient
from .observations import Period
from .quantiles import asked_bins, bin_counts, bin_ranges, percentiles_in_bins
from .state import GROUP, STATE_SCHEMA, YEAR_GROUP, YEARS_SCHEMA, merge_state, merge_years, regression_state, season_years, state_products

PARTS = {"products": ["season_type", "season_idx", "period"], "state": ["season_type", "season_idx"], "years": ["season_idx", "year"], "anomalies": ["period", "month", "year"]}
CELL_SCHEMA = "i INT, j INT, lat DOUBLE, lon DOUBLE, is_land BOOLEAN"
TICK_SCHEMA = "section STRING, pct INT, value DOUBLE"
ANOMALY_SCHEMA = "period STRING, month INT, year INT, i INT, j INT, sst DOUBLE, value DOUBLE"
COUNT_SCHEMA = "period STRING, measure STRING, bin LONG, n LONG"
SCALE_SCHEMA = "period STRING, vm_99 DOUBLE, vm_999 DOUBLE, vm_100 DOUBLE"
ANOMALY_TICK_SCHEMA = "period STRING, pct INT, value DOUBLE"
#: Sections whose ticks are kept; those of anomalies are in a table of their own, by period.
TICKED = ("s1", "s2", "s2_raw", "s3", "s4", "s5", "s5_raw", "s6")


@dataclass(frozen=True)
class Settings:
    """What the products of a store are made by: periods, those that are baselines of anomalies, steps of the axes, and limits."""

    periods: tuple[Period, ...]
    baselines: tuple[str, ...]
    lat_step: float
    lon_step: float
    min_n: int = 5
    alpha: float = 0.05


def derived_products(means: DataFrame, cells: DataFrame, settings: Settings) -> DataFrame:
    """s6, the gradient of the means of all years, and s7, the baselines: the monthly means of the periods that are such."""
    keys = ["season_type", "season_idx"]
    steep = gradient(means.where("period = 'all'").select(*keys, "i", "j", "value"), keys, cells, settings.lat_step, settings.lon_step)
    base = means.where((F.col("season_type") == "monthly") & F.col("period").isin(*settings.baselines)).withColumn("section", F.lit("s7"))
    return product(steep.withColumn("period", F.lit("all")), "s6", F.col("value")).unionByName(base.select("section", *keys, "period", "i", "j", "value"))


def _spread(df: DataFrame, parts: list[str]) -> DataFrame:
    """Dealt by folder and block of cells, so that a folder has a file for each block, in order of section and cell."""
    section = ["section"] if "section" in df.columns else []
    return df.repartition(*parts, F.floor(F.col("i") / 256), F.floor(F.col("j") / 256)).sortWithinPartitions(*parts, *section, "i", "j")


def _by_value(slices: DataFrame) -> DataFrame:
    """Dealt by slice and large blocks of cells, in order of value, so that a reader of few bins skips most pages."""
    return slices.repartition(*PARTS["anomalies"], F.floor(F.col("i") / 1024), F.floor(F.col("j") / 1024)).sortWithinPartitions(*PARTS["anomalies"], "value")


def _commit(store: VersionedStore, tables: dict[str, DataFrame]) -> int:
    return store.commit({n: _by_value(t) if n == "anomalies" else _spread(t, PARTS[n]) if n in PARTS else t for n, t in tables.items()}, PARTS)


def build(store: VersionedStore, obs: DataFrame, cells: DataFrame, settings: Settings) -> int:
    """The first version, from all observations; its number."""
    years = stored_rows(season_years(obs), "season-years")
    state = stored_rows(regression_state(obs, years, settings.periods), "regression-state")
    maps = stored_rows(state_products(state, settings.min_n, settings.alpha), "maps")
    mask = stored_rows(cells.select("i", "j", "lat", "lon", "is_land"), "cells")
    every = stored_rows(maps.unionByName(derived_products(maps.where("section = 's1'"), mask, settings)), "products")
    slices = stored_rows(_by_value(_anomalies(_for_each_baseline(obs, settings), _baselines(every))), "anomalies")
    tables = {"cells": mask.coalesce(1), "years": years, "state": state, "products": every, "ticks": section_ticks(every.where(F.col("section").isin(*TICKED))).coalesce(1)}
    return _commit(store, {**tables, **_pooled_anomalies(slices, stored_rows(_bin_counts(slices), "anomaly-counts")), "anomalies": slices})


def products_of(store: VersionedStore, version: int | None = None) -> DataFrame:
    return store.read("products", PRODUCT_SCHEMA, version)


def ticks_of(store: VersionedStore, version: int | None = None) -> DataFrame:
    return store.read("ticks", TICK_SCHEMA, version)


def baselines_of(store: VersionedStore, version: int | None = None) -> DataFrame:
    """period, month, i, j, clim, as ``anomalies.baseline`` gives them, from the stored maps."""
    return _baselines(products_of(store, version))


def _baselines(products: DataFrame) -> DataFrame:
    return products.where("section = 's7'").select("period", (F.col("season_idx") + 1).alias("month"), "i", "j", F.col("value").alias("clim"))


def anomalies_of(store: VersionedStore, version: int | None = None) -> DataFrame:
    """period, month, year, i, j, sst, value of every observation that has a value and a time; value is NULL where its cell has no baseline."""
    return store.read("anomalies", ANOMALY_SCHEMA, version)


def anomaly_scale_of(store: VersionedStore, version: int | None = None) -> DataFrame:
    """As ``colour.anomaly_scale`` gives it of all anomalies."""
    return store.read("anomaly_scale", SCALE_SCHEMA, version)


def anomaly_ticks_of(store: VersionedStore, version: int | None = None) -> DataFrame:
    """As ``colour.anomaly_ticks`` gives them of all anomalies."""
    return store.read("anomaly_ticks", ANOMALY_TICK_SCHEMA, version)


def _for_each_baseline(obs: DataFrame, settings: Settings) -> DataFrame:
    """period, month, year, i, j, sst: the observations once for each baseline period."""
    rows = obs.where("sst IS NOT NULL AND year IS NOT NULL AND month IS NOT NULL")
    return rows.select(F.explode(F.array(*map(F.lit, settings.baselines)).cast("array<string>")).alias("period"), "month", "year", "i", "j", "sst")


def _anomalies(rows: DataFrame, base: DataFrame) -> DataFrame:
    return rows.join(base, ["period", "month", "i", "j"], "left").select("period", "month", "year", "i", "j", "sst", (F.col("sst") - F.col("clim")).alias("value"))


def _measures(slices: DataFrame) -> DataFrame:
    """period, measure, x: each anomaly (value) and its size (size)."""
    both = F.array(*(F.struct(F.lit(name).alias("measure"), x.alias("x")) for name, x in (("value", F.col("value")), ("size", F.abs("value")))))
    return slices.select("period", F.explode(both).alias("m")).select("period", "m.*")


def _bin_counts(slices: DataFrame) -> DataFrame:
    return bin_counts(_measures(slices), ["period", "measure"], "x")


def _pooled_anomalies(slices: DataFrame, counts: DataFrame) -> dict[str, DataFrame]:
    """Counts, ticks and scale of all anomalies, of which only those in the bins of asked ranks are read."""
    keys, of = ["period", "measure"], lambda measure, df: df.where(F.col("measure") == measure)
    ticked, sized = asked_bins(of("value", counts), keys, TICK_PERCENTS), asked_bins(of("size", counts), keys, SCALE_PERCENTS)
    ranges = [*bin_ranges(ticked), *(r for low, high in bin_ranges(sized) for r in ((low, high), (-high, -low)))]
    hit = reduce(Column.__or__, (F.col("value").between(low, high) for low, high in ranges), F.lit(False))
    found = percentiles_in_bins(ticked.unionByName(sized), _measures(slices.where(hit)), keys, "x")
    ticks = of("value", found).select("period", F.col("pct").cast("int").alias("pct"), "value")
    return {"anomaly_counts": counts, "anomaly_ticks": ticks.coalesce(1), "anomaly_scale": scale_of(of("size", found)).coalesce(1)}


def _in_slices(moved: list[tuple[str, int]], dates: list[tuple[int, int]]) -> Column:
    """Slices of a period's months, or of dates (year, month): tests of folders' names, which leave the others unread."""
    months = lambda groups, name: [(F.col(name) == k) & F.col("month").isin(*sorted({m for g, m in groups if g == k})) for k in sorted({g for g, _ in groups})]
    return reduce(Column.__or__, months(moved, "period") + months(dates, "year"), F.lit(False))


def _refreshed_anomalies(store: VersionedStore, new: DataFrame, touched: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """The tables of anomalies after an update, whose new maps are ``touched``.

    Slices are made anew where their month's baseline moved, and where new rows have their date; others stay as they are.
    Both are lists of months, as many as baseline periods and the update have.
    """
    kept, arrived, changed = anomalies_of(store), _for_each_baseline(new, settings), _baselines(touched)
    moved = sorted((r["period"], r["month"]) for r in changed.select("period", "month").distinct().collect())
    dates = sorted((r["year"], r["month"]) for r in new.where("sst IS NOT NULL").select("year", "month").dropna().distinct().collect())
    again = _in_slices(moved, dates)
    base = baselines_of(store).where(F.col("month").isin(*{m for _, m in dates}, *{m for _, m in moved}) & ~_in_slices(moved, [])).unionByName(changed)
    slices = stored_rows(_by_value(_anomalies(kept.where(again).drop("value").unionByName(arrived), base)), "anomalies")
    less = _bin_counts(kept.where(again)).withColumn("n", -F.col("n"))
    every = store.read("anomaly_counts", COUNT_SCHEMA).unionByName(less).unionByName(_bin_counts(slices))
    counts = stored_rows(every.groupBy("period", "measure", "bin").agg(F.sum("n").alias("n")).where("n > 0"), "anomaly-counts")
    return {**_pooled_anomalies(kept.where(~again).unionByName(slices), counts), "anomalies": slices}


def _replaced(old: DataFrame, new: DataFrame, parts: list[str], key: list[str]) -> DataFrame:
    """The parts that ``new`` has rows of, with what they hold besides. Parts are few and named by folders."""
    touched = old.join(F.broadcast(new.select(*parts).distinct()), parts, "left_semi")
    return touched.join(new.select(*key), key, "left_anti").select(*new.columns).unionByName(new)


def refresh(store: VersionedStore, new: DataFrame, settings: Settings) -> int:
    """A version with the new rows taken in (they must not be stored yet, see ``append_new``); its number.

    Maps, state, ticks, anomalies and their scale change together: a reader sees the old or the new version. Cells that are not there yet are not
    added; the land mask stays.
    """
    cells, years, state = store.read("cells", CELL_SCHEMA), store.read("years", YEARS_SCHEMA), store.read("state", STATE_SCHEMA)
    new = stored_rows(new.select("i", "j", "year", "month", "ess_idx", "x", "sst"), "new-rows")
    fresh = season_years(new)
    sums = stored_rows(merge_state(state, years, new, settings.periods), "touched-state")
    kept = products_of(store).where("section NOT IN ('s6', 's7')")
    maps = stored_rows(_replaced(kept, state_products(sums, settings.min_n, settings.alpha), PARTS["products"], ["section", *PARTS["products"], "i", "j"]), "touched-maps")
    every = stored_rows(maps.unionByName(derived_products(maps.where("section = 's1'"), cells, settings)), "touched-products")
    untouched = products_of(store).where(_pooled()).join(F.broadcast(every.where(_pooled()).select(*PARTS["products"]).distinct()), PARTS["products"], "left_anti")
    pool = stored_rows(untouched.select("section", "season_type", "period", "value").unionByName(every.where(_pooled()).select("section", "season_type", "period", "value")), "tick-pool")
    touched_years = years.join(fresh.select(*YEAR_GROUP), list(YEAR_GROUP), "left_semi")
    tables = {
        "years": _replaced(years, merge_years(touched_years, fresh), PARTS["years"], list(YEAR_GROUP)),
        "state": _replaced(state, sums, PARTS["state"], list(GROUP)),
        "products": every,
        "ticks": section_ticks(pool).coalesce(1),
        **_refreshed_anomalies(store, new, every, settings),
    }
    return _commit(store, tables)


def _pooled() -> Column:
    """The maps that ticks are of."""
    return (F.col("season_type") == "monthly") & (F.col("period") == "all") & F.col("section").isin(*TICKED)
