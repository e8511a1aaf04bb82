"""Streams give the batch table: shuffled, repeated and late slices, and a restart."""

import random

from pyspark.sql import functions as F

from isogrid.sources.versions import VersionedStore
from isogrid.streaming import updates as streams

SCHEMA = "ts timestamp, i int, j int, month int, sst double"


def slices(spark, folder, days, copies=1):
    for d in days:
        for _ in range(copies):
            rows = spark.range(4).select(F.make_timestamp(F.lit(2024), F.lit(1), F.lit(d), F.lit(0), F.lit(0), F.lit(0)).alias("ts"), F.col("id").cast("int").alias("i"), F.lit(0).alias("j"), F.lit(1).alias("month"), (F.col("id") + d).cast("double").alias("sst"))
            rows.coalesce(1).write.mode("append").parquet(folder)


def test_stream_append_equals_batch_and_survives_restart(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    days = list(range(3, 20))
    random.Random(1).shuffle(days)
    slices(spark, source, days, copies=2)
    run = lambda: streams.stream_append(streams.read_slices(spark, source, SCHEMA), store, state, ["i", "j"]).awaitTermination()
    run()
    slices(spark, source, [1, 5, 25], copies=2)  # late, repeated and new
    run()
    run()
    got = spark.read.parquet(store)
    want = spark.read.parquet(source).distinct()
    assert got.count() == want.count() == 19 * 4 and got.exceptAll(want).count() == 0


def test_repeats_of_earlier_batches_are_dropped_by_the_store(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    run = lambda: streams.stream_append(streams.read_slices(spark, source, SCHEMA), store, state, ["i", "j"]).awaitTermination()
    slices(spark, source, [1, 20])
    run()
    slices(spark, source, [20, 21])
    run()
    assert spark.read.parquet(store).count() == 3 * 4


def test_late_months_are_kept_whatever_their_age(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))

    def months(*wanted):
        for m in wanted:
            spark.range(3).select(F.make_timestamp(F.lit(2024), F.lit(m), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("ts"), F.col("id").cast("int").alias("i"), F.lit(0).alias("j"), F.lit(m).alias("month"), F.lit(float(m)).alias("sst")).coalesce(1).write.mode("append").parquet(source)
        streams.stream_append(streams.read_slices(spark, source, SCHEMA), store, state, ["i", "j"]).awaitTermination()
        return sorted(r["month"] for r in spark.read.parquet(store).groupBy("month").count().where("count = 3").collect())

    assert months(1, 2, 3, 6) == [1, 2, 3, 6]
    assert months(7) == [1, 2, 3, 6, 7]
    assert months(4, 8, 2) == [1, 2, 3, 4, 6, 7, 8]


def test_stream_anomaly(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    slices(spark, source, [1, 2])
    base = spark.createDataFrame([("p", 1, i, 0, float(i)) for i in range(4)], "period string, month int, i int, j int, clim double")
    streams.run_to_table(streams.stream_anomaly(streams.read_slices(spark, source, SCHEMA), base), out, state).awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(out).collect()) == [1.0] * 4 + [2.0] * 4


def test_rows_without_time_or_key_are_stored_once(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    run = lambda: streams.stream_append(streams.read_slices(spark, source, SCHEMA), store, state, ["i", "j"]).awaitTermination()
    odd = spark.createDataFrame([(None, 1, 1, 1, 5.0), (None, None, 1, 1, 6.0)], SCHEMA).unionByName(spark.sql("select timestamp'2024-01-05' as ts, cast(null as int) as i, 0 as j, 1 as month, 7d as sst"))
    for _ in range(3):
        odd.coalesce(1).write.mode("append").parquet(source)
        run()
    assert sorted(r["sst"] for r in spark.read.parquet(store).collect()) == [5.0, 6.0, 7.0]


def test_a_batch_of_many_months_meets_its_stored_copies(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    months = spark.range(400).selectExpr("timestamp'1980-01-01' + make_interval(0, cast(id as int)) as ts", "0 as i", "0 as j", "1 as month", "cast(id as double) as sst")
    for part in (months.where("sst % 3 != 0"), months, months):
        part.coalesce(1).write.mode("append").parquet(source)
        streams.stream_append(streams.read_slices(spark, source, SCHEMA), store, state, ["i", "j"]).awaitTermination()
    assert spark.read.parquet(store).count() == 400


def test_a_replaced_baseline_is_used_from_the_next_batch_on(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    kept, schema = VersionedStore(spark, str(tmp_path / "store")), "period STRING, month INT, i INT, j INT, clim DOUBLE"
    base = lambda v: spark.createDataFrame([("p", 1, i, 0, v) for i in range(4)], schema)
    run = lambda: streams.stream_anomaly_by_version(streams.read_slices(spark, source, SCHEMA), lambda: kept.read("baselines", schema), out, state).awaitTermination()
    for day, clim in ((1, 0.0), (2, 100.0)):
        kept.commit({"baselines": base(clim)})
        slices(spark, source, [day])
        run()
    assert sorted(r["value"] for r in spark.read.parquet(out).collect()) == [-98.0, -97.0, -96.0, -95.0, 1.0, 2.0, 3.0, 4.0]
