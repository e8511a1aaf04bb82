"""Tables that a job writes to cut a plan in two: read more than once, or with row numbers that must not change."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of so many narrow rows at most is broadcast.
MOST_BROADCAST = 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder; where that is unset, one of its own on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or tempfile.mkdtemp(prefix="isogrid-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored_rows(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to a new Parquet folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_broadcast(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The rows, marked for a broadcast if a count finds them to be few enough; else the planner joins them by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """How many partitions to deal rows to before they multiply: about ``each`` in one, and work for every core.

    Given as a number, as adaptive execution would merge partitions by the size that they have before that.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))
