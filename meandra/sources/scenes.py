"""Scene catalogs and what is known of a scene before its pixels: bands, georeference, names, footprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meandra.functions.projection import utm_zone
from meandra.functions.scalar import index_bands


def band_paths(names: DataFrame) -> DataFrame:
    """(name, band, path, index): the file and the band in it for green and swir of each scene name.

    A name that ends in .tif or .TIF is one file with all its bands; any other is a folder with a file a band.
    """
    bands = index_bands(F.col("name"))
    one = F.lower(F.substring(F.col("name"), -4, 4)) == ".tif"
    rows = names.select("name", F.explode(F.array(*(F.struct(F.lit(b).alias("band"), bands[b].alias("nr")) for b in ("green", "swir")))).alias("b")).select("name", "b.band", "b.nr")
    stem = F.regexp_replace("name", "^.*/", "")
    path = F.when(one, F.col("name")).otherwise(F.concat("name", F.lit("/"), stem, F.lit("_B"), F.col("nr").cast("string"), F.lit(".TIF")))
    return rows.select("name", "band", path.alias("path"), F.when(one, F.col("nr")).otherwise(F.lit(1)).alias("index"))


def water_index(cells: DataFrame, value: Column, kind: Column, limit: float) -> DataFrame:
    """Adds water: an index of kind mndwi is cut at `limit`, one of kind ddwi is water already; any other kind is null."""
    cut = F.when(~F.isnan(value) & (value > limit), 1.0).otherwise(0.0)
    return cells.withColumn("water", F.when(kind == "mndwi", cut).when(kind == "ddwi", value))


def georeference(cells: DataFrame, crs: str, left: float, upper: float, dx: float, dy: float) -> DataFrame:
    """(scene, crs, nrows, ncols, left, upper, right, lower): a row for each scene of cells (scene, row, col)."""
    g = cells.groupBy("scene").agg((F.max("row") + 1).alias("nrows"), (F.max("col") + 1).alias("ncols"))
    return g.select("scene", F.lit(crs).alias("crs"), "nrows", "ncols", F.lit(left).alias("left"), F.lit(upper).alias("upper"), (F.lit(left) + F.col("ncols") * dx).alias("right"), (F.lit(upper) + F.col("nrows") * dy).alias("lower"))


def epsg(lon: Column, lat: Column) -> Column:
    """Code of the UTM zone of a place."""
    return F.when(lat < 0, F.lit(32700)).otherwise(F.lit(32600)) + utm_zone(lon)


def crs_of(scenes: DataFrame, year: int) -> DataFrame:
    """(path, row, scene, epsg): the first scene of each path and row in a year, and its UTM code."""
    first = scenes.filter(F.year("acq") == year).groupBy("path", "row").agg(F.min(F.struct("acq", "scene", "lon", "lat")).alias("m"))
    return first.select("path", "row", "m.scene", epsg(F.col("m.lon"), F.col("m.lat")).alias("epsg"))


def find(scenes: DataFrame, name: object, column: str = "scene") -> DataFrame:
    """At most one row: the scene of that name, the earliest if several share it."""
    return scenes.filter(F.col(column) == name).orderBy("acq", column).limit(1)


def first_shapes(rings: DataFrame) -> DataFrame:
    """(file, id, seq, x, y): the ring with the least id of each file, without vertices that repeat the one before."""
    first = rings.join(rings.groupBy("file").agg(F.min("id").alias("id")), ["file", "id"], "left_semi")
    w = Window.partitionBy("file", "id").orderBy("seq")
    again = (F.lag("x").over(w) == F.col("x")) & (F.lag("y").over(w) == F.col("y"))
    return first.withColumn("_again", F.coalesce(again, F.lit(False))).filter("not _again").drop("_again")


def footprints_of(points: DataFrame, shapes: DataFrame, size: float = 16.0) -> DataFrame:
    """(point, shape): shapes that contain points by the even-odd rule. points: (point, x, y); shapes: (shape, xs, ys).

    Shapes are dealt to the squares that their boxes touch, so points meet only the shapes of their square.
    """
    cell = lambda v: F.floor(v / F.lit(size))
    box = {n: f(c) for n, f, c in (("x0", F.array_min, "xs"), ("x1", F.array_max, "xs"), ("y0", F.array_min, "ys"), ("y1", F.array_max, "ys"))}
    dealt = shapes.withColumns(box).withColumn("cx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1")))))
    met = points.select("point", "x", "y", cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy")).join(dealt, ["cx", "cy"])
    met = met.filter("x between x0 and x1 and y between y0 and y1")
    i = F.sequence(F.lit(0), F.size("xs") - 1)

    def crosses(k: Column) -> Column:
        nxt = F.pmod(k + 1, F.size("xs"))
        ax, ay, bx, by = F.get("xs", k), F.get("ys", k), F.get("xs", nxt), F.get("ys", nxt)
        spans = (ay > F.col("y")) != (by > F.col("y"))
        return F.when(spans & (F.col("x") < ax + F.coalesce(F.try_divide((F.col("y") - ay) * (bx - ax), by - ay), F.lit(0.0))), 1).otherwise(0)

    odd = F.aggregate(F.transform(i, crosses), F.lit(0), lambda a, b: a + b) % 2 == 1
    return met.filter(odd).select("point", "shape")


def planet_metadata(files: DataFrame) -> DataFrame:
    """(path, name, day, time, item): what a file's name says; day, time and item are null where it does not say it.

    A name that begins with 20 and is longer than eight characters begins with its day; six digits of time
    follow an underscore; the item is made of the first four parts, if there are as many.
    """
    name = F.regexp_replace("path", "^.*/", "")
    dated = F.col("name").startswith("20") & (F.length("name") > 8)
    parts = F.split(F.regexp_replace("name", r"\.[^.]*$", ""), "_")
    timed = dated & (F.substring("name", 9, 1) == "_")
    return files.withColumn("name", name).select("path", "name", F.when(dated, F.substring("name", 1, 8)).alias("day"), F.when(timed, F.substring("name", 10, 6)).alias("time"), F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, 1, 4), "_")).alias("item"))


def primary_day(metadata: DataFrame, by: str) -> DataFrame:
    """The least day of each group of files and the number of distinct ones; today's where no name has one."""
    return metadata.groupBy(by).agg(F.coalesce(F.min("day"), F.date_format(F.current_date(), "yyyyMMdd")).alias("day"), F.countDistinct("day").alias("days"))
