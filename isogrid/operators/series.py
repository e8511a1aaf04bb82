"""Operators on labelled series (point_id, seq, label, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ordered():
    return Window.partitionBy("point_id").orderBy("seq")


def running_mean(series: DataFrame, width: int) -> DataFrame:
    """Centred mean over floor(width / 2) rows to each side, fewer at the ends; NULLs are skipped."""
    half = width // 2
    return series.withColumn("mean", F.avg("value").over(_ordered().rowsBetween(-half, half)))


def trend_line(series: DataFrame) -> DataFrame:
    """The least-squares line on the row index, at every row, rounded to 3; NULL with fewer than 3 values."""
    at = (F.row_number().over(_ordered()) - 1).cast("double")
    rows, whole = series.withColumn("_x", at), Window.partitionBy("point_id")
    sums = rows.select("*", F.regr_slope("value", "_x").over(whole).alias("_a"), F.regr_intercept("value", "_x").over(whole).alias("_b"), F.count("value").over(whole).alias("_n"))
    return sums.withColumn("fit", F.when(F.col("_n") >= 3, F.round(F.col("_a") * F.col("_x") + F.col("_b"), 3))).drop("_x", "_a", "_b", "_n")


def series_stats(series: DataFrame) -> DataFrame:
    return series.groupBy("point_id").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def annual_mean(series: DataFrame) -> DataFrame:
    """Mean of each year, the first four characters of the label; rounded to 3."""
    return series.groupBy("point_id", F.substring("label", 1, 4).alias("year")).agg(F.round(F.avg("value"), 3).alias("value"))
