"""Baselines and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .climate import moments
from .observations import Period


def baseline(obs: DataFrame, periods: tuple[Period, ...]) -> DataFrame:
    """period, month, i, j, clim: the mean of each month over each period."""
    stats = moments(obs, ("monthly",), periods)
    return stats.select("period", (F.col("season_idx") + 1).alias("month"), "i", "j", F.col("mean").alias("clim"))


def anomaly(obs: DataFrame, base: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """Observations less the baseline of their month.

    Both sides grow with the grid and neither is ever broadcast, however small its files let the planner think it is.
    """
    rows = obs
    if year is not None:
        rows = rows.where(F.col("year") == year)
    if month is not None:
        rows = rows.where(F.col("month") == month)
    return rows.join(base.hint("merge"), ["i", "j", "month"]).withColumn("value", F.col("sst") - F.col("clim")).select("period", "i", "j", "ts", "year", "month", "ess_idx", "sst", "clim", "value")


def _mean_of_both(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the values less mean of their baselines, each skipping its own NULLs."""
    return rows.groupBy(*keys).agg((F.avg("sst") - F.avg("clim")).alias("value"))


def anomaly_season(obs: DataFrame, base: DataFrame, year: int, season: int | None = None) -> DataFrame:
    """Anomaly of each season (or one) of a calendar year."""
    rows = anomaly(obs, base, year)
    rows = rows if season is None else rows.where(F.col("ess_idx") == season)
    return _mean_of_both(rows, ["period", "ess_idx", "i", "j"])


def anomaly_annual(obs: DataFrame, base: DataFrame, year: int | None = None) -> DataFrame:
    """Anomaly of a year over the months that it has; the last year by default."""
    if year is None:
        last = obs.agg(F.max("year").alias("_last"))
        obs = obs.join(F.broadcast(last), F.col("year") == F.col("_last")).drop("_last")
    return _mean_of_both(anomaly(obs, base, year), ["period", "i", "j"])


def anomaly_summary(anomalies: DataFrame, keys: tuple[str, ...] = ("period",)) -> DataFrame:
    return anomalies.groupBy(*keys).agg(F.round(F.avg("value"), 3).alias("mean"), F.round(F.max("value"), 3).alias("max"), F.round(F.min("value"), 3).alias("min"))
