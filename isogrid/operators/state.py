"""Regression state: sums of each cell that merge with an update, so that no history is read again.

A group is a cell, a month or season, and a period. Of its values y at times t it keeps the sums of t, t², u, u², u³, u⁴, t·u
and t·u², where u is y less a value of the group (the anchor), so that the sums are of the size of the variation and a
constant series gives exact zeros. They give mean, variance, trend and R² of y, and, expanded about the mean of the moment,
the trend of its squared anomalies, which change all together when the mean moves. Trends of seasons' variance are of yearly
means, whose sums and counts are kept by year: an update takes a year's old mean out of the sums and puts the new one in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .climate import _maps, _tested, by_calendar, significant
from .observations import ALL_YEARS, Period, with_period

GROUP = ("i", "j", "season_type", "season_idx", "period", "basis")
YEAR_GROUP = ("i", "j", "season_idx", "year")
SUMS = ("n", "t", "tt", "u", "u2", "u3", "u4", "tu", "tu2")
STATE_SCHEMA = "i INT, j INT, season_type STRING, season_idx INT, period STRING, basis STRING, anchor DOUBLE, n LONG, " + ", ".join(f"{c} DOUBLE" for c in SUMS[1:])
YEARS_SCHEMA = "i INT, j INT, season_idx INT, year INT, n LONG, total DOUBLE"
#: Times are counted from this year.
EPOCH = 2000
#: Squared anomalies whose variance is below this share of their mean square are constant but for rounding.
FLAT_SHARE = 1e-13


def _values(obs: DataFrame, periods: tuple[Period, ...]) -> DataFrame:
    """GROUP, y, t, sign of the rows that the pooled statistics and the months' variance trend are of."""
    rows = by_calendar(with_period(obs, periods).select("i", "j", "month", "ess_idx", "period", "x", "sst"))
    return rows.select("i", "j", "season_type", "season_idx", "period", F.lit("rows").alias("basis"), F.col("sst").alias("y"), (F.col("x") - EPOCH).alias("t"), F.lit(1).alias("sign"))


def _yearly(years: DataFrame, periods: tuple[Period, ...], sign: int) -> DataFrame:
    """GROUP, y, t, sign of the yearly season means."""
    mean = F.when(F.col("n") > 0, F.col("total") / F.nullif(F.col("n"), F.lit(0)))
    rows = with_period(years.withColumn("y", mean), periods)
    return rows.select("i", "j", F.lit("ess").alias("season_type"), "season_idx", "period", F.lit("years").alias("basis"), "y", (F.col("year") - EPOCH).cast("double").alias("t"), F.lit(sign).alias("sign"))


def _summed(rows: DataFrame) -> DataFrame:
    """GROUP, anchor and sums of rows that know their anchor."""
    u, t = F.col("y") - F.col("anchor"), F.when(F.col("y").isNotNull(), F.col("t"))
    terms = {"t": t, "tt": t * t, "u": u, "u2": u * u, "u3": u * u * u, "u4": u * u * u * u, "tu": t * u, "tu2": t * u * u}
    n = F.sum(F.when(F.col("y").isNotNull(), F.col("sign")).otherwise(0)).cast("long").alias("n")
    return rows.groupBy(*GROUP).agg(F.max("anchor").alias("anchor"), n, *(F.coalesce(F.sum(v * F.col("sign")), F.lit(0.0)).alias(c) for c, v in terms.items()))


def season_years(obs: DataFrame) -> DataFrame:
    """i, j, season_idx, year, n, total: what yearly season means are made of."""
    return obs.groupBy("i", "j", F.col("ess_idx").alias("season_idx"), "year").agg(F.count("sst").alias("n"), F.coalesce(F.sum("sst"), F.lit(0.0)).alias("total"))


def regression_state(obs: DataFrame, years: DataFrame, periods: tuple[Period, ...] = ()) -> DataFrame:
    """The state of all rows; ``years`` are their ``season_years``. A group's anchor is its least value."""
    every = (ALL_YEARS, *periods)
    rows = _values(obs, every).unionByName(_yearly(years, every, 1))
    anchors = rows.groupBy(*GROUP).agg(F.min("y").alias("anchor"))
    return _summed(rows.join(anchors, list(GROUP)))


def merge_years(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The season years after an update; ``new`` are the season years of its rows alone."""
    return stored.unionByName(new).groupBy(*YEAR_GROUP).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def merge_state(state: DataFrame, years: DataFrame, new: DataFrame, periods: tuple[Period, ...] = ()) -> DataFrame:
    """The groups that new rows touch, with their sums after the update, from the stored state and season years.

    Of what is stored only touched groups, and season years that new rows fall in, are used.
    """
    every = (ALL_YEARS, *periods)
    fresh = season_years(new)
    touched = years.join(fresh.select(*YEAR_GROUP), list(YEAR_GROUP), "left_semi")
    changes = _values(new, every).unionByName(_yearly(touched, every, -1)).unionByName(_yearly(merge_years(touched, fresh), every, 1))
    groups = changes.groupBy(*GROUP).agg(F.min("y").alias("first"))
    known = groups.join(state, list(GROUP), "left").withColumn("anchor", F.coalesce("anchor", "first"))
    added = _summed(changes.join(known.select(*GROUP, "anchor"), list(GROUP)))
    before = known.select(*GROUP, "anchor", *(F.coalesce(c, F.lit(0)).cast("long" if c == "n" else "double").alias(c) for c in SUMS))
    return before.unionByName(added).groupBy(*GROUP).agg(F.max("anchor").alias("anchor"), *(F.sum(c).alias(c) for c in SUMS))


def _fit(n: Column, t: Column, tt: Column, y: Column, yy: Column, ty: Column) -> dict[str, Column]:
    """Variance, slope and R² of sums."""
    least = F.nullif(n.cast("double"), F.lit(0.0))
    sxx, sxy = tt - t * t / least, ty - t * y / least
    syy = F.when(n > 0, F.greatest(F.lit(0.0), yy - y * y / least))
    flat = syy <= yy * FLAT_SHARE
    slope = sxy / F.when(sxx > 0, sxx)
    r2 = F.least(F.lit(1.0), sxy * sxy / F.when((sxx > 0) & ~flat, sxx * syy))
    return {"variance": F.when(flat, 0.0).otherwise(syy / least), "slope": slope, "r2": r2}


def state_products(state: DataFrame, min_n: int = 5, alpha: float = 0.05) -> DataFrame:
    """The product maps s1 to s5 and the unmasked s2 and s5 of the state's groups, as ``climate.products`` gives them."""
    name = [c for c in GROUP if c != "basis"]
    n, least = F.col("n"), F.nullif(F.col("n").cast("double"), F.lit(0.0))
    plain = _fit(n, F.col("t"), F.col("tt"), F.col("u"), F.col("u2"), F.col("tu"))
    means = state.where("basis = 'rows'").select(*name, "n", (F.col("anchor") + F.col("u") / least).alias("mean"), *(v.alias(k) for k, v in plain.items()))
    d = F.col("u") / least
    sq = F.greatest(F.lit(0.0), F.col("u2") - d * F.col("u"))
    sq2 = F.col("u4") - 4 * d * F.col("u3") + 6 * d * d * F.col("u2") - 3 * d * d * d * F.col("u")
    squares = _fit(n, F.col("t"), F.col("tt"), sq, F.greatest(F.lit(0.0), sq2), F.col("tu2") - 2 * d * F.col("tu") + d * d * F.col("t"))
    wanted = (F.col("season_type") == "monthly") | (F.col("basis") == "years")
    spread = state.where(wanted).select(*name, "n", F.lit(None).cast("double").alias("mean"), *(v.alias(k) for k, v in squares.items()))
    s1_to_s4 = {"s1": F.col("mean"), "s2": significant(alpha), "s2_raw": F.col("trend"), "s3": F.col("r2"), "s4": F.col("variance")}
    return _maps(_tested(means, min_n), s1_to_s4).unionByName(_maps(_tested(spread, min_n), {"s5": significant(alpha), "s5_raw": F.col("trend")}))
