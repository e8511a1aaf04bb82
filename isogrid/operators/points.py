"""Values, profiles and series at points.

Points are brought to cells first and series are joined by cell, so many points on one cell share its rows' lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_cell(points: DataFrame, lat_axis: DataFrame, lon_axis: DataFrame) -> DataFrame:
    """The points with i, j of the nearest row and column, found on each axis by itself; the first index wins a tie.

    Each axis is one sorted array in one broadcast row (its size is the grid's side, not its area), searched by halving, so
    axes may be irregular, of either direction and long. NULL for a point without a coordinate.
    """

    def sorted_axis(axis: DataFrame, value: str, index: str, name: str) -> DataFrame:
        first = axis.groupBy(value).agg(F.min(index).alias("k"))
        return first.agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), "k"))).alias(name))

    def nearest(axis: str, value: str) -> Column:
        at, n = F.col(value), F.size(axis)
        steps = F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int"))
        whole = F.struct(F.lit(0).alias("low"), n.alias("high"))  # the first place not below the value lies in low..high

        def halve(a: Column, _: Column) -> Column:
            middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
            below = F.get(axis, middle)["v"] < at
            return F.when(a["low"] >= a["high"], a).otherwise(F.struct(F.when(below, middle + 1).otherwise(a["low"]).alias("low"), F.when(below, a["high"]).otherwise(middle).alias("high")))

        place = F.aggregate(steps, whole, halve, lambda a: a["low"])
        around = F.filter(F.array(F.get(axis, place - 1), F.get(axis, place)), lambda c: c.isNotNull())
        return F.when(at.isNotNull(), F.array_min(F.transform(around, lambda c: F.struct(F.abs(c["v"] - at).alias("d"), c["k"].alias("k"))))["k"])

    rows = points.join(F.broadcast(sorted_axis(lat_axis, "lat", "i", "_lats"))).join(F.broadcast(sorted_axis(lon_axis, "lon", "j", "_lons")))
    return rows.withColumns({"i": nearest("_lats", "lat"), "j": nearest("_lons", "lon")}).drop("_lats", "_lons")


def _cells_of(points: DataFrame) -> DataFrame:
    return points.select("point_id", "i", "j")


def point_timeseries(points: DataFrame, obs: DataFrame) -> DataFrame:
    """The raw series of each point's cell, rounded to 3; labels and values are made once a cell, not once a point."""
    rows = obs.select("i", "j", F.date_format("ts", "yyyy-MM").alias("label"), F.round("sst", 3).alias("value"))
    return _cells_of(points).join(rows, ["i", "j"]).select("point_id", "label", "value")


def field_value(points: DataFrame, field: DataFrame, cells: DataFrame) -> DataFrame:
    """The field's value at each point's cell, rounded to 3; NULL on land and where the field has none."""
    ocean = cells.where("NOT is_land").select("i", "j")
    values = field.select("i", "j", "value").join(ocean, ["i", "j"], "left_semi")
    return _cells_of(points).join(values, ["i", "j"], "left").select("point_id", F.round("value", 3).alias("value"))


def point_profile(points: DataFrame, monthly: DataFrame) -> DataFrame:
    """The 12 monthly values of a product at each point, month 0 to 11 always there, rounded to 4."""
    wanted = _cells_of(points).withColumn("season_idx", F.explode(F.sequence(F.lit(0), F.lit(11))))
    rows = wanted.join(monthly.select("i", "j", "season_idx", "value"), ["i", "j", "season_idx"], "left")
    return rows.select("point_id", F.col("season_idx").alias("seq"), F.round("value", 4).alias("value"))


def point_var_by_year(points: DataFrame, obs: DataFrame) -> DataFrame:
    """Variance of the months inside each year at each point."""
    by_cell = obs.join(_cells_of(points).select("i", "j").distinct(), ["i", "j"], "left_semi").groupBy("i", "j", "year").agg(F.round(F.var_pop("sst"), 4).alias("value"))
    return _cells_of(points).join(by_cell, ["i", "j"]).select("point_id", F.col("year").alias("seq"), "value")


def point_anomaly_series(points: DataFrame, anomalies: DataFrame) -> DataFrame:
    """The monthly anomalies at each point, rounded to 4; made once a cell."""
    rows = anomalies.select("i", "j", "period", F.date_format("ts", "yyyy-MM").alias("label"), F.round("value", 4).alias("value"))
    return _cells_of(points).join(rows, ["i", "j"]).select("point_id", "period", "label", "value")


def point_annual(points: DataFrame, rows: DataFrame, value: str, month: int | None = None, season: int | None = None) -> DataFrame:
    """The yearly mean of ``value`` (a reading, or a paired anomaly) at each point, over all months, one, or a season.

    A season wins over a month. All years are listed, NULL where there is nothing.
    """
    years = rows.select("year").distinct().agg(F.array_sort(F.collect_list("year")).alias("_years"))
    chosen = rows
    if season is not None:
        chosen = rows.where(F.col("ess_idx") == season)
    elif month is not None:
        chosen = rows.where(F.col("month") == month + 1)
    by_cell = chosen.join(_cells_of(points).select("i", "j").distinct(), ["i", "j"], "left_semi").groupBy("i", "j", "year").agg(F.round(F.avg(value), 3).alias("value"))
    wanted = _cells_of(points).join(F.broadcast(years)).withColumn("year", F.explode("_years")).drop("_years")
    return wanted.join(by_cell, ["i", "j", "year"], "left").select("point_id", "year", "value")


def point_stats(points: DataFrame, trends: DataFrame, r2: DataFrame) -> DataFrame:
    """Mean of the significant monthly trends and of R² at each point, 0 where there are none; rounded to 4."""
    mean = lambda f, name: f.groupBy("i", "j").agg(F.avg("value").alias(name))
    rows = _cells_of(points).join(mean(trends, "t"), ["i", "j"], "left").join(mean(r2, "r"), ["i", "j"], "left")
    return rows.select("point_id", F.round(F.coalesce("t", F.lit(0.0)), 4).alias("trend"), F.round(F.coalesce("r", F.lit(0.0)), 4).alias("r2"))
