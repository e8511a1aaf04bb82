"""The one map that answers a request for a section, a season and a period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.grids import select_field
from .climate import composite


def _of_period(maps: DataFrame, period: str) -> DataFrame:
    """Maps of the period if there is any, else those of all years."""
    exists = maps.where(F.col("period") == period).limit(1).select(F.lit(True).alias("_has"))
    return maps.join(F.broadcast(exists), how="left").where(F.col("period") == F.when(F.col("_has"), period).otherwise("all")).drop("_has")


def map_field(products: DataFrame, section: str, season_type: str, season_idx: int, period: str, rolling: DataFrame | None = None) -> DataFrame:
    """i, j, value of the map to draw.

    A ``seasonal`` or ``annual`` map is the mean of the 3 or 12 monthly maps of the period, or of all years if the section has
    none of it. The monthly trend of variance (s5) is the period's stored map or else the trend of the rolling variance
    (``rolling``, of ``climate.rolling_var_trend``), if given. Any other map is that of the period, or else of all years.
    """
    if season_type in ("seasonal", "annual"):
        maps = _of_period(products.where((F.col("section") == section) & (F.col("season_type") == "monthly") & F.col("period").isin(period, "all")), period)
        return composite(maps, season_type).where(F.col("season_idx") == (season_idx % 4 if season_type == "seasonal" else 0)).select("i", "j", "value")
    if section == "s5" and season_type == "monthly" and rolling is not None:
        own = products.where((F.col("section") == section) & (F.col("season_type") == season_type) & (F.col("season_idx") == season_idx) & (F.col("period") == period))
        exists = own.limit(1).select(F.lit(True).alias("_has"))
        instead = rolling.where(F.col("season_idx") == season_idx).join(F.broadcast(exists), how="left").where("_has IS NULL")
        return own.select("i", "j", "value").unionByName(instead.select("i", "j", "value"))
    return select_field(products, section, season_type, season_idx, period)
