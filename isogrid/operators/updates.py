"""Monthly updates: what is missing, appending without duplicates, merging and recomputing (see ``store`` for a whole store)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .climate import moments, product
from .observations import ALL_YEARS, Period

KEY = "ts"


def missing_months(store: DataFrame, today: str, lag: int = 2) -> DataFrame:
    """month_start of each month after the last stored one, up to ``lag`` months before today's."""
    last = F.trunc(F.max(KEY).cast("date"), "month")
    upto = F.add_months(F.trunc(F.lit(today).cast("date"), "month"), -lag)
    one = store.agg(last.alias("last")).withColumn("upto", upto).where(F.add_months("last", 1) <= F.col("upto"))
    return one.select(F.explode(F.sequence(F.add_months("last", 1), F.col("upto"), F.expr("interval 1 month"))).alias("month_start"))


def request_axes(missing: DataFrame) -> DataFrame:
    """One row: the years and two-digit months that a request must name; together they cover more than is missing."""
    return missing.agg(F.array_sort(F.collect_set(F.year("month_start"))).alias("years"), F.array_sort(F.collect_set(F.lpad(F.month("month_start").cast("string"), 2, "0"))).alias("months"))


def covered_months(axes: DataFrame) -> DataFrame:
    """Every month that such a request covers."""
    return axes.select(F.explode("years").alias("year"), "months").select("year", F.explode("months").alias("month"))


def append_new(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming rows of time steps not stored; repeats among the incoming ones stay."""
    return incoming.join(store.select(KEY).distinct(), KEY, "left_anti").select(*store.columns)


def merge_sorted(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """The whole table after the update, in order of time and cell."""
    return store.unionByName(append_new(store, incoming)).orderBy(KEY, "i", "j")


def refresh(store: DataFrame, new: DataFrame, periods: tuple[Period, ...] = (ALL_YEARS,)) -> DataFrame:
    """Means (s1) of just the months and seasons that new rows touch, over the merged table."""
    touched = new.select("month", "ess_idx").distinct()
    merged = store.unionByName(new)
    monthly = moments(merged.join(touched.select("month").distinct(), "month", "left_semi").select(*merged.columns), ("monthly",), periods)
    seasons = moments(merged.join(touched.select("ess_idx").distinct(), "ess_idx", "left_semi").select(*merged.columns), ("ess",), periods)
    return product(monthly, "s1", F.col("mean")).unionByName(product(seasons, "s1", F.col("mean")))
