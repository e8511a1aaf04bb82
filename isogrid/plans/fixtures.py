"""Adapters that make grid inputs of the given tables. The SQL text runs unchanged on Spark and on DuckDB."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Grid
from ..operators.observations import ALL_YEARS, Period, clean_sst, with_season, with_x
from ..sources.scratch import tasks_for

#: Only seven years of data, so periods and windows are shorter than the defaults.
PERIODS: tuple[Period, ...] = (("p1", 1995, 1999), ("p2", 1997, 2001), ("p3", 1996, None))
EVERY = (ALL_YEARS, *PERIODS)
YEAR, WINDOW, MIN_WINDOWS, TODAY = 2000, 3, 3, "2002-03-15"
GRID = Grid(72.0, -8.0, 6, 117.0, 16.0, 8)
WIDTH, HEIGHT, ZOOM, SIGMA = 120, 55, 3, 4.0
#: The size of a land mask as it is used.
FINE_WIDTH, FINE_HEIGHT = 1200, 550
#: Cells of the growing grid, points (each has a series of 84 months) and polygons that a task works on.
CELLS_EACH, POINTS_EACH, POLYGONS_EACH = 20_000, 10_000, 20_000


RAW = """
SELECT m AS ts, CAST(year(m) AS INT) AS year, CAST(month(m) AS INT) AS month, i, j,
       72.0 - 8.0*i AS lat, 117.0 + 16.0*j AS lon,
       CASE WHEN (i*8 + j) % 7 = 3 THEN -32767.0
            ELSE 273.15 + 12.0 - 1.5*i + 6.0*sin(2*pi()*(month(m) - 3)/12)
                 + (q - 25.5)/10.0 + 0.15*(j - 2)*(year(m) - 1995) END AS sst
FROM (SELECT CAST(l_suppkey % 6 AS INT) AS i, CAST(l_partkey % 8 AS INT) AS j, date_trunc('month', l_shipdate) AS m, avg(l_quantity) AS q
      FROM {lineitem} GROUP BY 1, 2, 3) o"""

#: A second grid, as large as the tables: a cell for each order, 84 months each, about as many rows as columns. Land lies in
#: blocks, and one month in eleven is missing. {each} is the engine's way to spread a list, {width} the number of columns.
FINE_WIDTH_SQL = "(SELECT CAST(ceil(sqrt(max(o_orderkey) + 1)) AS INT) FROM {orders})"
_FINE_MONTHS = """
SELECT CAST(make_date(year, month, 1) AS TIMESTAMP) AS ts, year, month, i, j, 72e0 - 46e0*i/w AS lat, 117e0 + 129e0*j/w AS lon,
       CASE WHEN (floor(i/4e0) + floor(j/6e0)) % 7 = 3 OR (a + k) % 11 = 0 THEN -32767e0
            ELSE 28515e-2 - 20e0*i/w + 6e0*sin(2*pi()*(month - 3)/12e0) + ((b*31 + k*k*17 + a*7) % 101)/20e0 + 15e-2*(b % 5 - 2)*(year - 1995) END AS sst
FROM """
FINE = _FINE_MONTHS + """(SELECT a, b, k, w, CAST(floor(a/CAST(w AS DOUBLE)) AS INT) AS i, CAST(a % w AS INT) AS j, CAST(1995 + floor(k/12e0) AS INT) AS year, CAST(k % 12 + 1 AS INT) AS month
      FROM (SELECT o_orderkey AS a, o_custkey AS b, {width} AS w, {each} AS k FROM {orders}) o) c"""
#: The same on Spark in steps, so that cells are dealt before they have months.
_FINE_PLACES = "SELECT a, b, w, CAST(floor(a/CAST(w AS DOUBLE)) AS INT) AS i, CAST(a % w AS INT) AS j FROM (SELECT o_orderkey AS a, o_custkey AS b, {width} AS w FROM {orders}) o"
_FINE_EACH = "SELECT a, b, k, w, i, j, CAST(1995 + floor(k/12e0) AS INT) AS year, CAST(k % 12 + 1 AS INT) AS month FROM (SELECT *, explode(sequence(0, 83)) AS k FROM {places}) o"

POINTS = "SELECT CAST(c_custkey AS BIGINT) AS point_id, 26.0 + c_custkey % 47 + (c_custkey % 7)/10.0 AS lat, 110.0 + c_custkey % 140 + (c_custkey % 3)/4.0 AS lon FROM {customer}"

#: A square for each customer; every third has a hole, every fifth lies across the antimeridian, every seventh is a
#: multipolygon with a second, smaller square.
SQUARES = """
SELECT CAST(c_custkey AS BIGINT) AS feature_id,
       CASE WHEN c_custkey % 5 = 0 THEN -179.0 + c_custkey % 50 ELSE 120.0 + c_custkey % 55 END + (c_custkey % 10)/10.0 AS x,
       30.0 + c_custkey % 37 + (c_custkey % 8)/8.0 AS y, 2.0 + c_custkey % 3 AS r, c_custkey % 3 = 0 AS hole, c_custkey % 7 = 0 AS multi
FROM {customer}"""

SLICES = "SELECT date_trunc('hour', ts) AS ts, CAST(user_id % 48 AS INT) AS cell FROM {events}"


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(text, **tables)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kelvin observations with fill values on land, all of them DOUBLE as are the axes; the scan reads four columns."""
    rows = _sql(spark, RAW, lineitem=table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_quantity"))
    return rows.withColumns({c: F.col(c).cast("double") for c in ("lat", "lon", "sst")})


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_x(with_season(clean_sst(raw_obs(spark, sf_dir))))


def fine_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of the grid that grows with the tables; its width is asked for once, so that scans of it have no subquery.

    Whole lines of cells are dealt by ranges, before each cell gets its 84 months: a task has about ``CELLS_EACH`` cells at any
    size, and statistics by cell, or along a line, need no exchange of months.
    """
    (last, cells), orders = _fine_size(spark, sf_dir), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    places = _sql(spark, _FINE_PLACES.replace("{width}", str(_fine_width(last))), orders=orders)
    dealt = places.repartitionByRange(tasks_for(spark, cells, CELLS_EACH), "i")
    return with_x(with_season(clean_sst(_sql(spark, _FINE_MONTHS + "{months} c", months=_sql(spark, _FINE_EACH, places=dealt)))))


def _fine_size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """The greatest key and the number of cells, of one aggregate row."""
    last, cells = table(spark, sf_dir, "orders").agg(F.max("o_orderkey"), F.count(F.lit(1))).first()
    return last or 0, cells


def _fine_width(last: int) -> int:
    return ceil(sqrt(last + 1))


def fine_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """Its steps and size."""
    last, _ = _fine_size(spark, sf_dir)
    width = _fine_width(last)
    return Grid(72.0, -46.0 / width, last // width + 1, 117.0, 129.0 / width, width)


def rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, j of all places of that grid, also those without a cell."""
    size = fine_grid(spark, sf_dir)
    return spark.range(size.n_lat * size.n_lon).select(F.floor(F.col("id") / size.n_lon).cast("int").alias("i"), (F.col("id") % size.n_lon).cast("int").alias("j"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql(spark, POINTS, customer=table(spark, sf_dir, "customer"))
    return rows.select("point_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


def dealt_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points, dealt by their number before they get series, which then need no exchange by point."""
    rows = points(spark, sf_dir)
    return rows.repartition(tasks_for(spark, table(spark, sf_dir, "customer").count(), POINTS_EACH), "point_id")


def features(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """feature_id, type, coordinates (JSON text) of the squares; dealt to ``tasks``, if given, before they are made."""
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    s = _sql(spark, SQUARES, customer=customer.repartition(tasks, "c_custkey") if tasks else customer).select("feature_id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "r")), "hole", "multi")

    def ring(r):
        corner = lambda a, b: F.array(F.col("x") + a * r, F.col("y") + b * r)
        return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))

    outer, hole, small = ring(F.col("r")), ring(F.col("r") / 2), ring(F.col("r") / 4)
    poly = F.when(F.col("hole"), F.array(outer, hole)).otherwise(F.array(outer))
    coordinates = F.when(F.col("multi"), F.to_json(F.array(poly, F.array(small)))).otherwise(F.to_json(poly))
    return s.select("feature_id", F.when(F.col("multi"), "MultiPolygon").otherwise("Polygon").alias("type"), coordinates.alias("coordinates"))


def polygon_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the polygons are dealt to before they get vertices, and again before they get crossings."""
    return tasks_for(spark, table(spark, sf_dir, "customer").count(), POLYGONS_EACH)


def feature_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features with the document (part) that each is written to: 8, or as many as keep a document at ``POLYGONS_EACH`` features."""
    n = max(8, ceil(table(spark, sf_dir, "customer").count() / POLYGONS_EACH))
    return features(spark, sf_dir).withColumn("part", F.pmod("feature_id", F.lit(n)).cast("int")).repartition(n, "part")


def slices(events: DataFrame) -> DataFrame:
    """Hourly readings of the cells, a function of hour and cell, so that repeats are exact repeats."""
    rows = events.select(F.date_trunc("hour", "ts").alias("ts"), (F.col("user_id") % 48).cast("int").alias("cell"))
    value = 10 + (F.col("cell") * 7 + F.hour("ts")) % 20 + F.col("cell") / F.lit(10.0)
    return rows.select("ts", F.month("ts").alias("month"), F.floor(F.col("cell") / 8).cast("int").alias("i"), (F.col("cell") % 8).cast("int").alias("j"), value.alias("sst"))


