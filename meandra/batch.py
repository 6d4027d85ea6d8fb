"""Many scenes at once: those of a catalog that are not among the results yet are mapped and written, a folder a scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meandra.operators import mapping, temporal
from meandra.river import River
from meandra.sources import geotiff, scenes, store


def best_scenes(catalog: DataFrame, most_cloud: float, a_year: int) -> DataFrame:
    """Of a catalog (scene, acq, cloud) the clearest scenes of each year, with the collection that serves the year."""
    from meandra.functions.scalar import collection_of

    clear = temporal.best_of_year(catalog.filter(F.col("cloud") < most_cloud), "cloud", a_year)
    return clear.withColumn("collection", collection_of(F.year("acq")))


def map_scenes(spark: SparkSession, cells: DataFrame, value: Column, ends: DataFrame, path: str, pixel: float = 30.0, **how: float) -> int:
    """Map the scenes of `cells` that `path` does not hold yet; the number of scenes that were to do.

    Scenes without water that passes, or without a way between their ends, leave no rows and are tried again next time.
    """
    todo = cells.select("scene").distinct()
    try:
        todo = store.to_do(todo, store.load(spark, path))
    except Exception as missing:  # no results yet
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
    n = todo.count()
    if n:
        water = mapping.water_of_scenes(cells.join(todo, "scene", "left_semi"), value, **how)
        store.save(River(water, ends, pixel).centerline(), path)
    return n


def map_files(spark: SparkSession, folder: str, value: Column, ends: DataFrame, path: str, **how: float) -> int:
    """As map_scenes(), for the raster files of a folder: a scene is a file, numbered in the order of names; planet names give the day."""
    cells = geotiff.read(spark, folder)
    names = cells.select("path").distinct()
    numbered = names.join(scenes.planet_metadata(names), "path").withColumn("scene", F.xxhash64("path"))
    return map_scenes(spark, cells.join(F.broadcast(numbered.select("path", "scene")), "path"), value, ends, path, **how)
