"""Cleaning, time columns, masks and other operators on the observations themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import celsius, fractional_year, season_of

#: (name, first year or None, last year or None); bounds are inclusive.
Period = tuple[str, int | None, int | None]
ALL_YEARS: Period = ("all", None, None)
DEFAULT_PERIODS: tuple[Period, ...] = (("1981_2010", 1981, 2010), ("1991_2020", 1991, 2020), ("1980_2026", 1980, None))


def clean_sst(df: DataFrame, col: str = "sst") -> DataFrame:
    return df.withColumn(col, celsius(F.col(col)))


def decode_time(df: DataFrame, col: str = "valid_time") -> DataFrame:
    """ts (UTC), year, month and label (yyyy-MM) from epoch seconds."""
    ts = F.timestamp_seconds(F.col(col))
    return df.withColumn("ts", ts).withColumns({"year": F.year("ts"), "month": F.month("ts"), "label": F.date_format("ts", "yyyy-MM")})


def with_season(df: DataFrame) -> DataFrame:
    return df.withColumn("ess_idx", season_of(F.col("month")))


def with_x(df: DataFrame) -> DataFrame:
    return df.withColumn("x", fractional_year(F.col("year"), F.col("month")))


def in_period(period: Period):
    """Whether the row's year lies in the period."""
    _, first, last = period
    inside = F.lit(True)
    if first is not None:
        inside = inside & (F.col("year") >= first)
    return inside if last is None else inside & (F.col("year") <= last)


def with_period(df: DataFrame, periods: tuple[Period, ...]) -> DataFrame:
    """A row for each period that a row's year lies in. Few periods, so they are part of the plan and nothing is joined."""
    names = F.filter(F.array(*(F.when(in_period(p), F.lit(p[0])) for p in periods)), lambda n: n.isNotNull())
    return df.withColumn("period", F.explode(names))


def land_mask(obs: DataFrame, *more: Column) -> DataFrame:
    """The cells, with is_land where no time has a value, and more statistics of their rows if asked for."""
    return obs.groupBy("i", "j").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), (F.count("sst") == 0).alias("is_land"), *more)


def mask_land(field: DataFrame, cells: DataFrame, col: str = "value", drop: bool = False) -> DataFrame:
    """The field with land cells NULL, or dropped. Both sides grow with the grid, so the planner picks the join."""
    land = cells.where("is_land").select("i", "j", F.lit(True).alias("_land"))
    if drop:
        return field.join(land, ["i", "j"], "left_anti")
    return field.join(land, ["i", "j"], "left").withColumn(col, F.when(F.col("_land").isNull(), F.col(col))).drop("_land")


def ocean_only(obs: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows of ocean cells."""
    return obs.join(cells.where("NOT is_land").select("i", "j"), ["i", "j"], "left_semi")


def split_lon(lon_axis: DataFrame) -> DataFrame:
    """j, lon, half (west or east of 180°), and split: the first index of the east half, or the axis's length."""
    whole = Window.partitionBy()
    split = F.coalesce(F.min(F.when(F.col("lon") >= 180, F.col("j"))).over(whole), F.count("*").over(whole))
    return lon_axis.select("j", "lon", F.when(F.col("lon") >= 180, "east").otherwise("west").alias("half"), split.cast("int").alias("split"))


def axes(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, lat) and (j, lon)."""
    return obs.select("i", "lat").distinct(), obs.select("j", "lon").distinct()


def grid_meta(obs: DataFrame) -> DataFrame:
    """One row: ranges and sizes of the axes, years, first and last month, and the last year with all 12 months."""
    months = obs.groupBy("year", "month").agg(F.lit(1).alias("one"))
    years = months.groupBy("year").agg(F.count("*").alias("n"))
    time = years.agg(F.count("*").alias("n_years"), F.sum("n").alias("n_steps"), F.coalesce(F.max(F.when(F.col("n") == 12, F.col("year"))), F.max("year")).alias("last_full_year"))
    space = obs.agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.count_distinct("i").alias("n_lat"), F.count_distinct("j").alias("n_lon"), F.date_format(F.min("ts"), "yyyy-MM").alias("first_label"), F.date_format(F.max("ts"), "yyyy-MM").alias("last_label"))
    return space.join(F.broadcast(time))


def latest(obs: DataFrame) -> DataFrame:
    """The newest stored time step and the newest year."""
    return obs.agg(F.max("ts").alias("ts"), F.max("year").alias("year"))
