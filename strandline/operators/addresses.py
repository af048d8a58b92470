"""One table of addresses for all users, kept from run to run.

A point takes the first address within reach, in the order in which addresses came about, or
becomes one itself. That is sequential, but only among neighbours: a point that precedes all undecided
points near it becomes an address whatever happens elsewhere. So rounds
decide all such points at once. A cell of the grid is so small that it holds one address at most, so a
round compares the first point of each cell, never pairs of points: a spot that very many
points share sends one row a task.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.geo import UNITS, distance
from strandline.operators.places import PLACE_M
from strandline.session import shared_dir

DEGREE_M = math.pi * UNITS["m"] / 180
ADDRESS = "place_id string, first_ms long, first_user string, first_seq long, lat double, lng double"


def _side(metres: float) -> float:
    """Degrees of latitude of a cell whose diagonal is under ``metres``."""
    return 0.99 * metres / math.sqrt(2) / DEGREE_M


def _width(row: Column, side: float) -> Column:
    """Degrees of longitude of a row's cells: no wider, in metres, than ``side`` at the row's edge nearest to the equator."""
    near = F.least(F.abs(row), F.abs(row + 1)) * side
    return F.lit(side) / F.greatest(F.cos(F.radians(near)), F.lit(1e-6))


def cell(lat: Column, lng: Column, metres: float) -> Column:
    side = _side(metres)
    row = F.floor(lat / side)
    return F.struct(row.alias("row"), F.floor(lng / _width(row, side)).alias("col"))


def cells_near(lat: Column, lng: Column, metres: float) -> Column:
    """All cells with a point within ``metres``: of five rows those columns that are near enough at the row's end towards the pole."""
    side = _side(metres)

    def of(step: Column) -> Column:
        row = F.floor(lat / side) + step
        far = F.least(F.greatest(F.abs(row), F.abs(row + 1)) * side, F.lit(90.0))
        reach = F.least(F.lit(1.001 * metres / DEGREE_M) / F.greatest(F.cos(F.radians(far)), F.lit(1e-6)), F.lit(360.0))
        width = _width(row, side)
        columns = F.sequence(F.floor((lng - reach) / width), F.floor((lng + reach) / width))
        return F.transform(columns, lambda c: F.struct(row.alias("row"), c.alias("col")))

    return F.flatten(F.transform(F.sequence(F.lit(-2), F.lit(2)).cast("array<bigint>"), of))


ORDER = ("at", "user", "seq")


def _earliest() -> Column:
    return F.struct(*ORDER, "lat", "lng")


def new_addresses(points: DataFrame, table: DataFrame | None = None, *, metres: float = PLACE_M) -> DataFrame:
    """The addresses that ``points(user_key, start, segment, lat, lng)`` add to ``table``, with the columns of ``ADDRESS``.

    Points go by start, user and segment, all after those of ``table``. An address's id says which point it
    was first, so it stays the same in later runs. Points without a position add none, and points of one start, user, segment and
    position are one. A round is a few jobs; there are as many rounds as the longest chain of neighbours in order.
    """
    spark = points.sparkSession
    at, n = f"{shared_dir(spark)}/addresses-{uuid.uuid4().hex}", 0

    def save(df: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        df.write.parquet(f"{at}/{n:04d}")
        return spark.read.schema(df.schema).parquet(f"{at}/{n:04d}")

    def without(left: DataFrame, found: DataFrame) -> DataFrame:
        """Points with no address of ``found`` within reach."""
        near = found.select(F.explode(cells_near(F.col("lat"), F.col("lng"), metres)).alias("cell"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
        close = (left["cell"] == near["cell"]) & (distance(left["lat"], left["lng"], near["_lat"], near["_lng"]) < metres)
        return left.join(near, close, "left_anti")

    located = points.filter("lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng)")
    left = located.select(F.unix_millis("start").alias("at"), F.col("user_key").cast("string").alias("user"), F.col("segment").cast("long").alias("seq"), "lat", "lng", cell(F.col("lat"), F.col("lng"), metres).alias("cell"))
    left = save(left if table is None else without(left, table))
    found = spark.createDataFrame([], T._parse_datatype_string("at long, user string, seq long, lat double, lng double"))
    while not left.isEmpty():
        firsts = save(left.groupBy("cell").agg(F.min(_earliest()).alias("first")))
        near = firsts.select("first", F.explode(cells_near(F.col("first.lat"), F.col("first.lng"), metres)).alias("cell"))
        beside = near.join(firsts.withColumnRenamed("first", "other"), "cell").groupBy("first").agg(F.min("other").alias("least"))
        won = save(beside.filter("first <= least").select("first.*"))
        found = found.unionByName(won)
        left = save(without(left, won))
    name = F.concat_ws("/", "at", F.coalesce("user", F.lit("")), "seq")
    return found.select(name.alias("place_id"), F.col("at").alias("first_ms"), F.col("user").alias("first_user"), F.col("seq").alias("first_seq"), "lat", "lng")


def with_addresses(points: DataFrame, table: DataFrame, *, metres: float = PLACE_M) -> DataFrame:
    """Adds ``place_id`` to ``points(user_key, start, segment, lat, lng, ...)``: the first address within ``metres`` that came before the point or is it; null for points without a position.

    A point meets the few addresses of its cell's surroundings. Repeated rows stay.
    """
    own = F.struct(F.unix_millis("start").alias("at"), F.col("user_key").cast("string").alias("user"), F.col("segment").cast("long").alias("seq"))
    rows = points.withColumn("_own", own).withColumn("_cell", cell(F.col("lat"), F.col("lng"), metres))
    spots = rows.filter("lat IS NOT NULL AND lng IS NOT NULL").select("_own", "_cell", "lat", "lng").distinct()
    near = table.select(F.explode(cells_near(F.col("lat"), F.col("lng"), metres)).alias("_cell"), "place_id", F.struct(F.col("first_ms").alias("at"), F.col("first_user").alias("user"), F.col("first_seq").alias("seq")).alias("_came"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    met = spots.join(near, "_cell").filter((F.col("_came") <= F.col("_own")) & (distance(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng")) < metres))
    named = met.groupBy(F.col("_own").alias("_of"), F.col("lat").alias("_y"), F.col("lng").alias("_x")).agg(F.min_by("place_id", "_came").alias("place_id"))
    out = rows.join(named, F.col("_own").eqNullSafe(F.col("_of")) & (F.col("lat") == F.col("_y")) & (F.col("lng") == F.col("_x")), "left")
    return out.drop("_own", "_cell", "_of", "_y", "_x")


def extend_addresses(points: DataFrame, path: str, *, metres: float = PLACE_M) -> DataFrame:
    """Resolves ``points`` by the table under ``path``, which is extended first; each run adds a folder of its own, complete or not there."""
    spark = points.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    schema = T._parse_datatype_string(ADDRESS)
    read = lambda: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    new_addresses(points, read() if there else None, metres=metres).write.parquet(f"{path}/run-{uuid.uuid4().hex}")
    return with_addresses(points, read(), metres=metres)
