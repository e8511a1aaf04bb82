"""Percentile ticks, colour ranges, look-up tables and legends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import fmt_num
from ..sources.scratch import small_broadcast
from .quantiles import exact_percentiles, line_starts, sorted_percentiles, with_row_numbers

# The percentiles of legend ticks, colour stops (position and RGB) and the sections' colour maps.
TICK_PERCENTS = (5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99, 100)
SCALE_PERCENTS = (99, 99.9, 100)
STOPS = {
    "RdYlBu_r": [(0.0, 49, 54, 149), (0.125, 69, 117, 180), (0.25, 116, 173, 209), (0.375, 171, 217, 233), (0.5, 255, 255, 191), (0.625, 254, 224, 144), (0.75, 253, 174, 97), (0.875, 244, 109, 67), (1.0, 165, 0, 38)],
    "RdBu_r": [(0.0, 5, 48, 97), (0.25, 33, 102, 172), (0.375, 103, 169, 207), (0.45, 209, 229, 240), (0.5, 247, 247, 247), (0.55, 253, 219, 199), (0.625, 239, 138, 98), (0.75, 178, 24, 43), (1.0, 103, 0, 31)],
    "Viridis": [(0.0, 68, 1, 84), (0.25, 59, 82, 139), (0.5, 33, 145, 140), (0.75, 94, 201, 98), (1.0, 253, 231, 37)],
    "YlOrRd": [(0.0, 255, 255, 204), (0.25, 254, 217, 118), (0.5, 253, 141, 60), (0.75, 227, 26, 28), (1.0, 128, 0, 38)],
    "Hot_r": [(0.0, 255, 255, 255), (0.333, 255, 255, 0), (0.667, 255, 0, 0), (1.0, 0, 0, 0)],
}
SECTION_MAPS = {"s1": ("RdYlBu_r", False), "s2": ("RdBu_r", True), "s3": ("Viridis", False), "s4": ("YlOrRd", False), "s5": ("RdBu_r", True), "s6": ("Hot_r", False), "s7": ("RdBu_r", True)}


def section_ticks(products: DataFrame) -> DataFrame:
    """section, pct, value over the values of all twelve monthly maps of all years; the maps are read twice."""
    pool = products.where("season_type = 'monthly' AND period = 'all'")
    return exact_percentiles(pool, ["section"], "value", TICK_PERCENTS).withColumn("pct", F.col("pct").cast("int"))


def section_ticks_of_lines(lines: DataFrame) -> DataFrame:
    """The same of stored ``climate.line_values``."""
    pool = lines.where("season_type = 'monthly' AND period = 'all'")
    return sorted_percentiles(pool, ["section"], "value", TICK_PERCENTS).withColumn("pct", F.col("pct").cast("int"))


def scale_of(percentiles: DataFrame) -> DataFrame:
    """period, vm_99, vm_999, vm_100 of the percentiles ``SCALE_PERCENTS``."""
    at = lambda p: F.max(F.when(F.col("pct") == p, F.col("value")))
    return percentiles.groupBy("period").agg(at(99.0).alias("vm_99"), at(99.9).alias("vm_999"), at(100.0).alias("vm_100"))


def anomaly_scale(anomalies: DataFrame) -> DataFrame:
    """period, vm_99, vm_999, vm_100: percentiles and maximum of the absolute anomalies."""
    return scale_of(exact_percentiles(anomalies.select("period", F.abs("value").alias("a")), ["period"], "a", SCALE_PERCENTS))


def anomaly_ticks(anomalies: DataFrame) -> DataFrame:
    """period, pct, value over all anomalies of a period."""
    return exact_percentiles(anomalies, ["period"], "value", TICK_PERCENTS).withColumn("pct", F.col("pct").cast("int"))


def stride_sample(df: DataFrame, keys: list[str], order: list[str], n: int, by_lines: bool = False) -> DataFrame:
    """Every k-th row of each group in order, k such that about n remain; sampling is the feature here.

    Rows are numbered by ranges, so no task holds a group. ``by_lines`` is for rows that are dealt by lines (what shares keys and
    order up to the last column), of which a task holds some whole: then lines are counted, and numbered inside where a k-th
    row lies in them. The rows are read twice and none of them moves.
    """
    step = lambda total: F.greatest(F.lit(1), F.floor(F.col(total) / n))
    if not by_lines:
        ranked = with_row_numbers(df, keys, order, "_rn", "_n")
        return ranked.where(F.col("_rn") % step("_n") == 0).select(*df.columns)
    line = [*keys, *order[:-1]]
    starts = line_starts(df, keys, order).withColumn("_step", step("_total"))
    first = F.ceil(F.col("_before") / F.col("_step")) * F.col("_step")
    asked = starts.where(first < F.col("_before") + F.col("_in")).select(*(F.col(c).alias(f"_line_{c}") for c in line), "_before", "_step")
    rows = df.join(small_broadcast(asked), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_line_{c}")) for c in line]))
    number = F.col("_before") + F.row_number().over(Window.partitionBy(*line).orderBy(order[-1])) - 1
    return rows.select(*df.columns, "_step", number.alias("_rn")).where(F.col("_rn") % F.col("_step") == 0).select(*df.columns)


def value_range(fields: DataFrame, keys: list[str], symmetric: Column, percent: float = 99, widen: bool = True) -> DataFrame:
    """vmin, vmax of each field's colours. Symmetric ones reach the percentile of the absolute values on both sides.

    A field without values has the range 0 to 1. A range of one value is widened by 1, unless ``widen`` is off. The fields are
    read three times, so store costly ones first.
    """
    low, high = (0.0, 100.0) if percent >= 100 else (0.1, 99.9) if percent >= 99.9 else (1.0, 99.0)
    kinds = fields.groupBy(*keys).agg(F.first(symmetric).alias("_sym"))
    sized = fields.select(*keys, F.when(symmetric, F.abs("value")).otherwise(F.col("value")).alias("_v"))
    found = exact_percentiles(sized, keys, "_v", (low, high)).groupBy(*keys).agg(F.max(F.when(F.col("pct") == low, F.col("value"))).alias("_low"), F.max(F.when(F.col("pct") == high, F.col("value"))).alias("_high"))
    out = kinds.join(found, keys, "left")
    lo = F.coalesce(F.when(F.col("_sym"), -F.col("_high")).otherwise(F.col("_low")), F.lit(0.0))
    hi = F.coalesce("_high", F.lit(1.0))
    return out.select(*keys, lo.alias("vmin"), (F.when(lo == hi, lo + 1).otherwise(hi) if widen else hi).alias("vmax"))


def anomaly_range(scale: DataFrame, period: str, percent: float = 99) -> DataFrame:
    """vmin, vmax of anomaly maps (s7): one pooled scale, that of a fixed baseline period, on both sides of 0."""
    vm = F.col("vm_100" if percent >= 100 else "vm_999" if percent >= 99.9 else "vm_99")
    return scale.where(F.col("period") == period).select((-vm).alias("vmin"), F.when(vm == 0, 1.0).otherwise(vm).alias("vmax"))


def legend_ticks(ticks: DataFrame, ranges: DataFrame, keys: list[str], gap: float = 0.02, at_ends: bool = False) -> DataFrame:
    """The ticks to draw, with norm in 0..1 and label: one closer than ``gap`` to the last kept is left out.

    Which ticks stay depends on those kept before, so each section's 13 ticks are folded in order. In a range of one value
    (vmin = vmax) all ticks are in the middle; with ``at_ends`` those below it are at the lower end, others at the upper, and
    labels have all four decimals, as a smallest step of 0 asks for.
    """
    span = F.col("vmax") - F.col("vmin")
    alone, alone_digits = (F.when(F.col("value") < F.col("vmin"), 0.0).otherwise(1.0), 4) if at_ends else (F.lit(0.5), 2)
    norm = F.when(span == 0, alone).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("value") - F.col("vmin")) / F.nullif(span, F.lit(0.0)))))
    rows = ticks.join(F.broadcast(ranges), keys).select(*keys, "pct", "value", norm.alias("norm"), span.alias("span"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pct", "value", "norm"))).alias("all"), F.first("span").alias("span"))
    empty = F.expr("cast(array() as array<struct<pct:int,value:double,norm:double>>)")
    far = lambda kept, t: (F.size(kept) == 0) | (F.abs(t["norm"] - F.element_at(kept, -1)["norm"]) >= gap)
    kept = F.aggregate("all", empty, lambda a, t: F.when(far(a, t), F.concat(a, F.array(t))).otherwise(a))
    listed = listed.withColumn("kept", kept)
    steps = F.filter(F.transform(F.sequence(F.lit(1), F.size("kept") - 1), lambda k: F.abs(F.get("kept", k)["value"] - F.get("kept", k - 1)["value"])), lambda s: s > 0)
    only = F.col("span") if at_ends else F.when(F.col("span") > 0, F.col("span")).otherwise(1.0)
    least = F.when(F.size("kept") >= 2, F.coalesce(F.array_min(steps), F.col("span"))).otherwise(only)
    digits = F.when(least > 0, F.greatest(F.lit(0), F.least(F.lit(4), F.ceil(-F.log10(least))))).otherwise(alone_digits).cast("int")
    out = listed.select(*keys, digits.alias("digits"), F.explode("kept").alias("t"))
    text = F.lit(None).cast("string")
    for d in range(5):
        text = F.when(F.col("digits") == d, fmt_num(F.col("t.value"), d)).otherwise(text)
    return out.select(*keys, F.col("t.pct").alias("pct"), F.round("t.value", 4).alias("value"), F.round("t.norm", 4).alias("norm"), text.alias("label"))


def color_lut(spark: SparkSession, names: tuple[str, ...] = tuple(STOPS)) -> DataFrame:
    """cmap, idx 0..255, r, g, b: between two stops each channel is interpolated and truncated."""
    stops = [(n, k, *a, *b) for n in names for k, (a, b) in enumerate(zip(STOPS[n], STOPS[n][1:]))]
    table = spark.createDataFrame(stops, "cmap string, k int, v0 double, r0 int, g0 int, b0 int, v1 double, r1 int, g1 int, b1 int")
    at = spark.range(256).select(F.col("id").cast("int").alias("idx"), (F.col("id") / F.lit(255.0)).alias("v"))
    hit = at.join(F.broadcast(table), F.col("v").between(F.col("v0"), F.col("v1")))
    first = hit.groupBy("cmap", "idx").agg(F.min_by(F.struct("v", "v0", "v1", "r0", "r1", "g0", "g1", "b0", "b1"), "k").alias("s")).select("cmap", "idx", "s.*")
    share = (F.col("v") - F.col("v0")) / (F.col("v1") - F.col("v0"))
    return first.select("cmap", "idx", *((F.col(f"{c}0") + share * (F.col(f"{c}1") - F.col(f"{c}0"))).cast("int").alias(c) for c in "rgb"))


def color_index(value: Column, vmin: Column, vmax: Column, rounded: bool = False, epsilon: float = 0.0) -> Column:
    """0..255, truncated or rounded half up."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - vmin) / (vmax - vmin + epsilon))) * 255
    return (F.floor(scaled + 0.5) if rounded else F.floor(scaled)).cast("int")


def colorize(fields: DataFrame, ranges: DataFrame, keys: list[str], lut: DataFrame, cmap: Column, rounded: bool = False, epsilon: float = 1e-10) -> DataFrame:
    """The fields with colour index and RGB; no colour where there is no value. The table has 256 rows a map."""
    rows = fields.join(F.broadcast(ranges), keys).withColumns({"cmap": cmap, "idx": color_index(F.col("value"), F.col("vmin"), F.col("vmax"), rounded, epsilon)})
    return rows.join(F.broadcast(lut), ["cmap", "idx"], "left").drop("vmin", "vmax")


def contour_bands(fields: DataFrame, ranges: DataFrame, keys: list[str], n_levels: int = 10) -> DataFrame:
    """band: how many of n levels, spread evenly and strictly within the range, lie at or below the value."""
    rows = fields.join(F.broadcast(ranges), keys)
    levels = F.array(*(F.col("vmin") + (F.col("vmax") - F.col("vmin")) * k / (n_levels + 1) for k in range(1, n_levels + 1)))
    return rows.withColumn("band", F.when(F.col("value").isNotNull(), F.size(F.filter(levels, lambda x: x <= F.col("value"))))).drop("vmin", "vmax")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def label_tone(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Tone of a label drawn on a colour, by the two rules in use: on 0..1 light below 0.5; on 0..255 dark above 128."""
    y = luminance(r, g, b)
    return F.when(y / 255 < 0.5, "light").otherwise("dark"), F.when(y > 128, "dark").otherwise("light")
