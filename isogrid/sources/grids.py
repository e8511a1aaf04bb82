"""Sources and sinks of gridded data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.grid import complete, one_each

RAW_SCHEMA = "valid_time BIGINT, latitude DOUBLE, longitude DOUBLE, sst DOUBLE"
CUBE_SCHEMA = "valid_time BIGINT, sst ARRAY<ARRAY<FLOAT>>"
PRODUCT_SCHEMA = "section STRING, season_type STRING, season_idx INT, period STRING, i INT, j INT, value DOUBLE"
#: Cells of the side of a chunk.
CHUNK_CELLS = 256
POLYGON_SCHEMA = "features ARRAY<STRUCT<properties: MAP<STRING, STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"


def read_obs(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = RAW_SCHEMA) -> DataFrame:
    """Observations in a given schema; nothing is inferred, so no extra pass over the files."""
    return spark.read.schema(schema).format(fmt).load(path)


def unpack_cube(cube: DataFrame, lat_axis: DataFrame, lon_axis: DataFrame) -> DataFrame:
    """One row per time and cell from rows with a 2-D array, with indices and axis values.

    The axes are a grid's rows and columns (thousands at most) and are broadcast.
    """
    rows = cube.select("valid_time", F.posexplode("sst").alias("i", "row")).select("valid_time", "i", F.posexplode("row").alias("j", "sst"))
    return rows.join(F.broadcast(lat_axis), "i").join(F.broadcast(lon_axis), "j").select("valid_time", "i", "j", "lat", "lon", F.col("sst").cast("double").alias("sst"))


def write_products(products: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Product maps, one folder for each section, season type and period; rows are dealt by folder and cell block."""
    dealt = products.repartition("section", "season_type", "period", F.floor(F.col("i") / 256), F.floor(F.col("j") / 256))
    dealt.sortWithinPartitions("section", "season_type", "period", "season_idx", "i", "j").write.partitionBy("section", "season_type", "period").mode(mode).option("partitionOverwriteMode", "dynamic").parquet(path)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRODUCT_SCHEMA).parquet(path)


def select_field(products: DataFrame, section: str, season_type: str, season_idx: int, period: str) -> DataFrame:
    """i, j, value of one map: that of the period if it exists, else that of all years.

    The filters are on the folders' columns and reach the scan.
    """
    maps = products.where((F.col("section") == section) & (F.col("season_type") == season_type) & (F.col("season_idx") == season_idx) & F.col("period").isin(period, "all"))
    exists = maps.where(F.col("period") == period).limit(1).select(F.lit(True).alias("_has"))
    chosen = maps.join(F.broadcast(exists), how="left")
    return chosen.where(F.col("period") == F.when(F.col("_has"), period).otherwise("all")).select("i", "j", "value")


def read_field(spark: SparkSession, path: str, section: str, season_type: str, season_idx: int, period: str) -> DataFrame:
    return select_field(read_products(spark, path), section, season_type, season_idx, period)


def _dense(values: str = "value") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("i", "j", values))), lambda c: c[values])


def pack_field(fields: DataFrame, keys: list[str], cells: DataFrame) -> DataFrame:
    """A dense row-major array for each key; cells without a value keep their place as NULL.

    For maps that a row can hold; ``pack_chunks`` is for any size.
    """
    whole = one_each(complete(fields, keys, cells.select("i", "j", F.lit(None).cast("double").alias("lat"), F.lit(False).alias("is_land"))), [*keys, "i", "j"])
    return whole.groupBy(*keys).agg(_dense().alias("data"))


def pack_chunks(fields: DataFrame, keys: list[str], cells: DataFrame, side: int = CHUNK_CELLS) -> DataFrame:
    """keys, chunk_i, chunk_j, n_i, n_j, data: dense row-major arrays of at most side by side cells, and which chunk each is.

    The cells are a whole rectangle; chunks at its end are smaller. Cells without a value keep their place as NULL. Dealt by
    key and chunk, which is the only shuffle, so a map may be larger than a row or a task can hold.
    """
    chunk = lambda c: F.floor(F.col(c) / side).cast("int").alias(f"chunk_{c}")
    named = [*keys, "chunk_i", "chunk_j"]
    marked = cells.select("i", "j", F.lit(None).cast("double").alias("lat"), F.lit(False).alias("is_land"))
    rows = complete(fields, keys, marked).select("*", chunk("i"), chunk("j")).repartition(*named)
    size = lambda c: (F.max(c) - F.min(c) + 1).alias(f"n_{c}")
    return one_each(rows, [*named, "i", "j"]).groupBy(*named).agg(size("i"), size("j"), _dense().alias("data"))


def unpack_chunks(chunks: DataFrame, keys: list[str], side: int = CHUNK_CELLS) -> DataFrame:
    """keys, i, j, value of such chunks."""
    each = chunks.select(*keys, "chunk_i", "chunk_j", "n_j", F.posexplode("data").alias("_at", "value"))
    i, j = F.col("chunk_i") * side + F.floor(F.col("_at") / F.col("n_j")), F.col("chunk_j") * side + F.col("_at") % F.col("n_j")
    return each.select(*keys, i.cast("int").alias("i"), j.cast("int").alias("j"), "value")


def series_json(series: DataFrame) -> DataFrame:
    """labels, values and unit of each point's series as JSON text, nulls kept, in order of seq."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "label", "value")))
    packed = F.struct(F.transform(rows, lambda r: r["label"]).alias("labels"), F.transform(rows, lambda r: r["value"]).alias("values"), F.first("unit").alias("unit"))
    return series.groupBy("point_id").agg(F.to_json(packed, {"ignoreNullFields": "false"}).alias("json"))


def explode_polygons(features: DataFrame) -> DataFrame:
    """feature_id, poly_id, rings (arrays of lon, lat; the first is the outer one) from rows of (feature_id, type, coordinates as JSON text)."""
    polygon = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
    polys = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", polygon))).when(F.col("type") == "MultiPolygon", F.from_json("coordinates", f"ARRAY<{polygon}>"))
    return features.select("feature_id", F.posexplode(polys).alias("poly_id", "rings"))


def explode_rings(features: DataFrame) -> DataFrame:
    """Ring vertices from rows of (feature_id, type, coordinates as JSON text), for polygons and multipolygons alike."""
    rings = explode_polygons(features).select("feature_id", "poly_id", F.posexplode("rings").alias("ring_id", "ring"))
    points = rings.select("feature_id", "poly_id", "ring_id", F.posexplode("ring").alias("seq", "at"))
    return points.select("feature_id", "poly_id", "ring_id", (F.col("ring_id") > 0).alias("is_hole"), "seq", F.col("at")[0].alias("lon"), F.col("at")[1].alias("lat"))


def read_polygons(spark: SparkSession, path: str, id_property: str | None = None) -> DataFrame:
    """Ring vertices of GeoJSON feature collections. Coordinates are kept as text until the type is known.

    feature_id is the named whole-number property, or else the place in its collection (one of a kind in one file only).
    """
    text = spark.read.text(path, wholetext=True)  # the JSON source would read the file anew at each geometry kept as text
    found = text.select(F.from_json("value", POLYGON_SCHEMA).alias("c")).select(F.posexplode("c.features").alias("place", "f"))
    found = found.select((F.col("f.properties")[id_property].cast("long") if id_property else F.col("place")).alias("feature_id"), "f")
    return explode_rings(found.select("feature_id", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates")))


#: What cuts a feature collection into pieces, how a piece must end that another feature follows, and what it then lacks.
FEATURE_MARK = '"Feature"'
_NEXT_FEATURE = r'[\[,]\s*\{\s*"type"\s*:\s*$'
_FEATURE_SCHEMA = "properties MAP<STRING, STRING>, geometry STRUCT<type: STRING, coordinates: STRING>"


def read_polygons_split(spark: SparkSession, path: str, id_property: str | None = None) -> DataFrame:
    """As ``read_polygons``, with a large file read by many tasks.

    The text is cut where a feature says that it is one, which writers put first, so each piece has one feature's properties and
    geometry; Hadoop's reader gives every piece to one task, wherever a file's blocks end. Where a piece does not end with the
    begin of the next feature (another order of members, or that word elsewhere), the collections are read whole instead.
    Without an id property a feature's place is counted from the numbers of pieces in the file's earlier blocks.
    """
    text = spark.read.option("lineSep", FEATURE_MARK).text(path)
    pieces = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    following = pieces.select("file", "block", "at", F.col("value").rlike(_NEXT_FEATURE).alias("next"))
    blocks = following.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("next")).alias("ends"))
    if blocks.groupBy("file").agg(F.sum("ends").alias("ends")).where("ends > 1").limit(1).count():
        return read_polygons(spark, path, id_property)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (F.col("first") - before).alias("base"))
    placed = pieces.join(F.broadcast(starts), ["file", "block"]).withColumn("place", F.col("at") - F.col("base") - 1).where("place >= 0")  # what comes before the first feature is none
    parsed = placed.select("place", F.from_json(F.concat(F.lit('{"type":"Feature"'), "value"), _FEATURE_SCHEMA).alias("f"))
    found = parsed.select((F.col("f.properties")[id_property].cast("long") if id_property else F.col("place").cast("int")).alias("feature_id"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))
    return explode_rings(found)
