"""Helpers shared by the corpus operators: word splitting, Arrow row mapping, checkpoints, distributed prefix sums."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

#: A word is a run of characters other than these six ASCII white spaces.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Rows that one step of a Python task holds as Python objects at a time.
SLICE_ROWS = 256
#: Rows of a prefix sum are dealt to so many ranges of a hash, each summed by itself.
PREFIX_BUCKETS = 4096
#: Greatest size of a name filter: 16 MB.
MOST_FILTER_BITS = 1 << 27

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table of that name in a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a new folder; a cluster gets an error, as its executors share no such folder.
    """
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="isogrid-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Ask for the disk of finished work back.

    Spark removes shuffle files once the driver's JVM collects the handles of a plan that nothing refers to any more. A
    long job that has just cut its lineage asks for that, or its dead files stay until the JVM happens to.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same rows, written to a new Parquet table in the shared checkpoint folder, and that table's path."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``stored_at``; for wide rows, which compress in Parquet."""
    return stored_at(df, name)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored_at`` that nothing needs any more: what was made of it is itself written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column is called so (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def name_test(names: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test on arrays of 64-bit names, for tasks, that all rows of ``names`` (one column) pass, and few others.

    A Bloom filter of 16 bits a name, MOST_FILTER_BITS at most, so its size is bounded whatever the data; with many more
    names more others pass. It only spares rows a shuffle: what passes is still joined.
    """
    spark, column = names.sparkSession, names.columns[0]
    bits = min(MOST_FILTER_BITS, 1 << max(10, (16 * names.count()).bit_length()))

    def places(values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.stack([mix64(values.astype(np.int64).view(np.uint64) + _M1 * np.uint64(k)) & np.uint64(bits - 1) for k in range(1, 5)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(places(batch.column(0).to_numpy()).reshape(-1))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            ones = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(ones.view(np.int64))], names=["word", "ones"])

    found = names.select(column).mapInArrow(run, "word long, ones long").groupBy("word").agg(F.bit_or("ones").alias("ones")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[found.column("word").to_numpy()] = found.column("ones").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(table)

    def passes(values: np.ndarray) -> np.ndarray:
        at = places(values)
        return ((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(0)

    return passes


def map_slices(df: DataFrame, fn: Callable[..., Iterator[tuple] | Sequence[tuple]], schema: str) -> DataFrame:
    """Apply ``fn`` to lists of column values, a slice of rows at a time; it returns tuples in ``schema``'s order.

    ``fn`` gets one list for each column of ``df``. Memory of a task: one Arrow batch and one slice.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = list(fn(*(c.to_pylist() for c in part.columns)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), type=f.type) for v, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, keep: Callable[[list], list]) -> DataFrame:
    """Rows of ``df``, all columns as they are, for whose ``column`` values ``keep`` returns true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                yield part.filter(pa.array(keep(part.column(column).to_pylist()), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` cuts at just the six ASCII white spaces."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


def chain64(acc: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Append ``x`` to the running hash ``acc``."""
    with np.errstate(over="ignore"):
        return mix64(acc * _M1 + x)


def shuffled(key: Column, seed: str = "") -> Column:
    """A fixed pseudo-random key (32 hex digits) that Spark and any other SQL engine compute alike."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))))


def with_prefix_sums(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], values: dict[str, str], dealt: Column | None = None) -> DataFrame:
    """Add exclusive running sums within ``keys``, in the order of ``order`` and then ``ties``.

    values: name of the new column -> column to sum. No task gets a whole key: rows are dealt to ranges of ``order`` as well
    (``dealt``, which grows with it; by default the first three digits of a hex string), the sums of these ranges (4096 a
    key or so) are accumulated on their own and joined back. The join and the inner window use the same partitioning, so the
    rows move once.
    """
    names = {k: f"_k{n}" for n, k in enumerate(keys)}
    ranges = F.substring(order, 1, 3) if dealt is None else dealt
    rows = df.select("*", ranges.alias("_range"), *(F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(v) for k, v in names.items()))
    by = [*names.values(), "_range"]
    before = Window.partitionBy(*names.values()).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by).agg(*(F.sum(v).alias(f"_t_{n}") for n, v in values.items()))
    starts = totals.select(*by, *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in values))
    inner = Window.partitionBy(*by).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(starts, by).withColumns({n: F.col(f"_s_{n}") + F.coalesce(F.sum(v).over(inner), F.lit(0)) for n, v in values.items()})
    return out.select(*df.columns, *values)
