"""Streams of monthly slices."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Stands for no time among the months of a batch.
_NO_TIME = datetime.date(1, 1, 1)


def read_slices(spark: SparkSession, folder: str, schema: str, pattern: str | None = None) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def _in_months(batch: DataFrame, time: str) -> Column:
    """A filter on the months that the batch has rows of, which the scan of the store can use to skip files.

    Months that follow each other are one stretch; rows without a time are looked for if the batch has such.
    """
    months = sorted(r[0] for r in batch.select(F.coalesce(F.trunc(F.col(time).cast("date"), "month"), F.lit(_NO_TIME.isoformat()).cast("date"))).distinct().collect())
    wanted = F.col(time).isNull() if months and months[0] == _NO_TIME else F.lit(False)
    stretches: list[list[datetime.date]] = []
    for m in months:
        if m == _NO_TIME:
            continue
        follows = datetime.date(m.year + m.month // 12, m.month % 12 + 1, 1)
        if stretches and stretches[-1][1] == m:
            stretches[-1][1] = follows
        else:
            stretches.append([m, follows])
    for first, end in stretches:
        wanted = wanted | ((F.col(time) >= F.lit(first).cast("timestamp")) & (F.col(time) < F.lit(end).cast("timestamp")))
    return wanted


def stream_append(slices: DataFrame, store: str, checkpoint: str, keys: list[str], time: str = "ts") -> StreamingQuery:
    """Append rows not stored yet to a Parquet store, until the input that is there is used up.

    A row is new if the store has none of its time and keys, however late it comes: nothing is dropped for its age. Repeats
    within a batch count once, and a repeated batch after a restart adds nothing; a NULL time or key is a value like others.
    Of the store only the months that the batch has rows of are read.
    """
    names = [time, *keys]

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([time, *keys])
        try:
            stored = spark.read.schema(batch.schema).parquet(store).where(_in_months(batch, time)).select(*(F.col(c).alias(f"_stored_{c}") for c in names))
            same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_stored_{c}")) for c in names])
            new = new.join(stored, same, "left_anti")
        except AnalysisException as e:  # nothing is stored before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(store)

    return slices.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_anomaly(slices: DataFrame, base: DataFrame) -> DataFrame:
    """New observations joined to a static baseline as they come."""
    return slices.join(base, ["i", "j", "month"]).withColumn("value", F.col("sst") - F.col("clim"))


def stream_anomaly_by_version(slices: DataFrame, base: Callable[[], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """As ``stream_anomaly``, written to a Parquet folder by batch, against the baselines of the moment.

    ``base`` is asked at each batch (a ``VersionedStore`` gives what its last commit made visible), so a baseline that is
    replaced while the stream runs is used from the next batch on. A batch that is run again replaces its own folder.
    """

    def add(batch: DataFrame, number: int) -> None:
        stream_anomaly(batch, base()).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return slices.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's rows to a Parquet folder, until the input that is there is used up."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
