"""Exact percentiles and row numbers of groups of any size, none of which a task holds whole."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import small_broadcast, stored_rows

#: Bits of the ordered image that each pass counts by, the leading ones first; with the sign they make 64.
PASS_BITS = (22, 21, 21)
_MANTISSA, _LEAST_NORMAL = 1 << 52, 2.0**-1022


def with_ordered_bits(df: DataFrame, column: str, bits: str) -> DataFrame:
    """The rows with a whole number that orders doubles as they order themselves: the bits of a positive one, negated for a negative one.

    Made of exponent and share (size by a power of two, which is exact), in steps so that each is computed once. NULL for NULL
    and NaN; both zeros are 0.
    """
    size, guess, share = F.abs(column), F.col("_guess"), F.col("_share")
    steps = df.withColumn("_guess", F.least(F.lit(1023.0), F.floor(F.log2(F.when(size >= _LEAST_NORMAL, size))).cast("double")))
    steps = steps.withColumn("_share", size / F.pow(F.lit(2.0), guess))
    made = lambda exponent, mantissa: ((exponent + 1022) * float(_MANTISSA)).cast("long") + (mantissa * float(_MANTISSA)).cast("long")
    normal = F.when(share >= 2, made(guess + 1, share / 2)).when(share < 1, made(guess - 1, share * 2)).otherwise(made(guess, share))
    small = (size * F.lit(2.0**1000) * F.lit(2.0**74)).cast("long")
    whole = F.when(size < _LEAST_NORMAL, small).when(size == F.lit(float("inf")), F.lit(2047 * _MANTISSA)).otherwise(normal)
    steps = steps.withColumn("_whole", F.when(~F.isnan(column), whole))
    return steps.withColumn(bits, F.when(F.col(column) < 0, -F.col("_whole")).otherwise(F.col("_whole"))).drop("_guess", "_share", "_whole")


def _asked(percents: tuple[float, ...], n: Column) -> Column:
    """The ranks (from 0) that each percentile lies on or between, with their weights."""
    out = []
    for p in percents:
        at = (n - 1) * F.lit(p / 100)
        low = F.floor(at)
        one = lambda rank, weight: F.struct(F.lit(float(p)).alias("pct"), rank.alias("rank"), weight.alias("w"))
        out += [one(low, low + 1 - at), one(low + 1, at - low)]
    return F.filter(F.array(*out), lambda r: r["w"] > 0)


def _with_bits(pool: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, _x, _bits, _d0: the values that there are, with their leading bits (known not to be NULL, or joins would test the bits where they scan)."""
    values = pool.select(*keys, F.col(column).cast("double").alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)")
    return with_ordered_bits(values, "_x", "_bits").withColumn("_d0", F.coalesce(F.shiftright("_bits", 64 - PASS_BITS[0]), F.lit(0)))


def bin_counts(pool: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, bin, n: how many values of each group share their leading 22 bits. Counts of parts of a pool add up to those of the whole."""
    return _with_bits(pool, keys, column).groupBy(*keys, F.col("_d0").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _ranks_inside(counted: DataFrame, by: list[str], digit: str, *more: str) -> DataFrame:
    """The bins that an asked rank lies in, with the ranks counted from the bin's first value."""
    begin = F.col("_end") - F.col("_c")
    here = F.filter("_asked", lambda r: (r["rank"] >= begin) & (r["rank"] < F.col("_end")))
    inside = F.transform(here, lambda r: F.struct(r["pct"], (r["rank"] - begin).alias("rank"), r["w"]))
    return counted.select(*by, digit, *more, inside.alias("_asked")).where(F.size("_asked") > 0)


def asked_bins(counts: DataFrame, keys: list[str], percents: tuple[float, ...]) -> DataFrame:
    """keys, _d0, _asked: the bins of ``bin_counts`` that the percentiles lie in; written, as all that follows reads them."""
    whole = Window.partitionBy(*keys)
    upto = counts.select(*keys, F.col("bin").alias("_d0"), F.col("n").alias("_c")).withColumn("_end", F.sum("_c").over(whole.orderBy("_d0")))
    return stored_rows(_ranks_inside(upto.withColumn("_asked", _asked(percents, F.sum("_c").over(whole))), keys, "_d0"), "percentile-bins")


def bin_ranges(bins: DataFrame) -> list[tuple[float, float]]:
    """Least and greatest double of each bin, neighbours merged: at most two a group and percentile, so for pools of few groups."""
    out: list[tuple[int, int]] = []
    width = 1 << (64 - PASS_BITS[0])
    for first in sorted(r["_d0"] * width for r in bins.select("_d0").distinct().collect()):
        begin = out.pop()[0] if out and out[-1][1] + 1 == first else first
        out.append((begin, first + width - 1))
    return [(_double_of(a), _double_of(b)) for a, b in out]


def _double_of(bits: int) -> float:
    """The double of an ordered image; beyond the infinities, those."""
    size = struct.unpack("<d", struct.pack("<q", min(abs(bits), 2047 * _MANTISSA)))[0]
    return -size if bits < 0 else size


def _values_in_bins(bins: DataFrame, pool: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, and as ``column`` the values in the group's own bins, written: the one reading of the pool that finds them."""
    by = [*keys, "_d0"]
    rows = _with_bits(pool, keys, column).join(small_broadcast(bins.select(*by)), by)  # one row a bin; a semi join would be pushed below the bits
    return stored_rows(rows.select(*keys, F.col("_x").alias(column)), "percentile-values")


def percentiles_in_bins(bins: DataFrame, pool: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, pct, value, from the bins of ``asked_bins``; of the pool only values in them matter, so a reader may leave out others."""
    by, wanted, shift = [*keys, "_d0"], bins, 64 - PASS_BITS[0]
    known = _with_bits(_values_in_bins(bins, pool, keys, column), keys, column)
    for n, width in enumerate(PASS_BITS[1:], 1):
        shift -= width
        rows = known.withColumn(f"_d{n}", F.coalesce(F.shiftright("_bits", shift), F.lit(0)).bitwiseAND(F.lit((1 << width) - 1)))
        if n > 1:
            rows = rows.join(small_broadcast(wanted.select(*by)), by)
        counted = rows.groupBy(*by, f"_d{n}").agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_x"))
        upto = counted.withColumn("_end", F.sum("_c").over(Window.partitionBy(*by).orderBy(f"_d{n}"))).join(small_broadcast(wanted), by)
        wanted = _ranks_inside(upto, by, f"_d{n}", *(["_x"] if shift == 0 else []))
        wanted, by, known = wanted if shift == 0 else stored_rows(wanted, "percentile-bins"), [*by, f"_d{n}"], rows
    each = wanted.select(*keys, "_x", F.explode("_asked").alias("_r"))
    return each.groupBy(*keys, F.col("_r.pct").alias("pct")).agg(F.sum(F.col("_r.w") * F.col("_x")).alias("value"))


def exact_percentiles(pool: DataFrame, keys: list[str], column: str, percents: tuple[float, ...]) -> DataFrame:
    """keys, pct, value: linear-interpolated percentiles of each group, by radix selection.

    Values are seen as whole numbers in the same order. The first pass counts each group's leading 22 bits, which tells in
    which bin each asked rank lies; the next two count the following bits of the values in such bins alone. Only counts are
    shuffled, and at most 4 million of a group, whatever its size, so groups may be few and large or many and small. The pool
    is read three times, so store a costly one first; the bins found by a pass are written for the next. NULL and NaN are skipped; a group without values gives no row.
    """
    return percentiles_in_bins(asked_bins(bin_counts(pool, keys, column), keys, percents), pool, keys, column)


#: What ``sorted_pools`` makes: values in order, and the stretches of them that share their leading 22 bits.
POOL_TYPE = "struct<values: array<double>, bins: array<struct<bin: bigint, first: int, n: bigint>>>"


def sorted_pools(pools: list[np.ndarray]) -> pa.Array:
    """A row of ``POOL_TYPE`` for each array of values, without its NaN."""
    kept = [np.sort(v[~np.isnan(v)]) for v in pools]
    bins, firsts, counts = [], [], []
    for v in kept:
        size = np.abs(v).view(np.int64)
        bin_ = np.where(v < 0, -size, size) >> (64 - PASS_BITS[0])
        first = np.flatnonzero(np.diff(bin_, prepend=bin_[:1] - 1))
        bins.append(bin_[first])
        firsts.append(first)
        counts.append(np.diff(first, append=len(v)))
    offsets = lambda parts: pa.array(np.cumsum([0] + [len(p) for p in parts]), pa.int32())
    values = pa.ListArray.from_arrays(offsets(kept), pa.array(np.concatenate(kept), pa.float64()))
    each = pa.StructArray.from_arrays([pa.array(np.concatenate(c), t) for c, t in ((bins, pa.int64()), (firsts, pa.int32()), (counts, pa.int64()))], ["bin", "first", "n"])
    return pa.StructArray.from_arrays([values, pa.ListArray.from_arrays(offsets(bins), each)], ["values", "bins"])


def sorted_percentiles(pools: DataFrame, keys: list[str], column: str, percents: tuple[float, ...]) -> DataFrame:
    """As ``exact_percentiles``, of stored rows that each hold a part of a group's values as ``sorted_pools`` makes it.

    The first pass reads how many values share their leading bits, the next cuts the few stretches that an asked rank lies in
    out of the arrays; no other value becomes a row.
    """
    each = pools.select(*keys, F.explode(f"{column}.bins").alias("_b"))
    bins = asked_bins(each.groupBy(*keys, F.col("_b.bin").alias("bin")).agg(F.sum("_b.n").alias("n")), keys, percents)
    wanted = bins.groupBy(*keys).agg(F.collect_list("_d0").alias("_bins"))  # at most two a percentile
    here = F.filter(f"{column}.bins", lambda b: F.array_contains("_bins", b["bin"]))
    inside = F.flatten(F.transform(here, lambda b: F.slice(f"{column}.values", b["first"] + 1, b["n"].cast("int"))))
    values = pools.join(small_broadcast(wanted), keys).select(*keys, F.explode(inside).alias(column))
    return percentiles_in_bins(bins, values, keys, column)


def with_row_numbers(df: DataFrame, keys: list[str], order: list[str], number: str = "row_number", total: str | None = None) -> DataFrame:
    """The rows with their place (from 0) in the order of their group, and the group's size as ``total``.

    Rows are dealt by ranges of keys and order and sorted there; a row's place is its place in its range, plus the sizes of the
    group's earlier ranges, so a hot group is spread over as many tasks as it has ranges. All rows move once. They are written,
    as ranges are cut by a sample and must not be cut anew. Rows that are equal in keys and order are numbered in any order.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = stored_rows(ranged, "row-numbers").withColumn("_range", F.shiftright("_at", 33))
    sizes = rows.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_range").alias("_of"), (F.col("_first") - before).alias("_base"), F.sum("_n").over(whole).alias("_total"))
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    placed = rows.join(small_broadcast(starts), same)
    columns = [(F.col("_at") - F.col("_base")).alias(number), *([F.col("_total").alias(total)] if total else [])]
    return placed.select(*df.columns, *columns)


def line_starts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, all of order but its last column, _before, _in, _total: how many of a group's rows come before each line, lie in it, and are in all.

    A line is what shares keys and order up to the last column. Only counts move, where lines lie whole in a task.
    """
    sizes = stored_rows(df.groupBy(*keys, *order[:-1]).agg(F.count(F.lit(1)).alias("_in")), "lines")
    whole = Window.partitionBy(*keys)
    before = F.sum("_in").over(whole.orderBy(*order[:-1]).rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select(*keys, *order[:-1], F.coalesce(before, F.lit(0)).alias("_before"), "_in", F.sum("_in").over(whole).alias("_total"))
