"""A scene catalog as a stream: each scene once, with days since the start of its river."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_scenes(stream: DataFrame, time: str = "acq", late: str = "30 days") -> DataFrame:
    """Scenes as they arrive, each id once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["scene"])


def monthly(stream: DataFrame, time: str = "acq", late: str = "30 days") -> DataFrame:
    """(river, month start, scenes, mean width) of tumbling windows of 30 days."""
    w = F.window(time, "30 days")
    return stream.withWatermark(time, late).groupBy("river", w).agg(F.count("*").alias("scenes"), F.avg("width").alias("mean_width"))


def unprocessed(scenes: DataFrame, done: DataFrame) -> DataFrame:
    """Scenes without a stored result: what a batch run still has to do."""
    return scenes.join(done.select("scene").distinct(), "scene", "left_anti")


def read_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
