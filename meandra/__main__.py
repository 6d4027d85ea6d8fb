"""Map raster files from a shell: python -m meandra FOLDER RESULTS START_ROW START_COL END_ROW END_COL [name=value ...]"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meandra import batch


def value_of(text: str) -> bool | int | float | str:
    """A parameter's value as its text says: true or false, a whole number, a number, or itself."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def main(arguments: list[str]) -> int:
    """The number of scenes that were to do. Parameters after the places are those of mapping.water_of_scenes()."""
    places = [a for a in arguments if "=" not in a]
    if len(places) != 6:
        raise SystemExit(__doc__)
    how = {k: value_of(v) for k, v in (a.split("=", 1) for a in arguments if "=" in a)}
    folder, results, *ends = places
    spark = SparkSession.builder.getOrCreate()
    names = ("start_row", "start_col", "end_row", "end_col")
    every = spark.read.format("binaryFile").load(folder).select(F.xxhash64("path").alias("scene"), *(F.lit(float(v)).alias(n) for n, v in zip(names, ends)))
    n = batch.map_files(spark, folder, F.col("value"), every, results, **how)
    print(f"{n} scenes to do, results in {results}")
    return n


if __name__ == "__main__":
    main(sys.argv[1:])
