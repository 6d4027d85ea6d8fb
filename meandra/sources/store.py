"""Results on disk: parquet by scene, metadata as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save(results: DataFrame, path: str, by: str = "scene") -> None:
    """Append results, one folder a scene; scenes that are there already are replaced, others stay."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def to_geojson(points: DataFrame, kind: str = "LineString") -> DataFrame:
    """(scene, feature): a GeoJSON feature of each ordered path."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"], p["y"]))
    g = points.groupBy("scene").agg(ordered.alias("coordinates"))
    geometry = F.struct(F.lit(kind).alias("type"), "coordinates")
    return g.select("scene", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("scene").alias("properties"), geometry.alias("geometry"))).alias("feature"))


def to_svg(points: DataFrame) -> DataFrame:
    """(scene, path): the path data of a closed SVG outline of each ordered path."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return points.groupBy("scene").agg(F.concat(F.lit("M"), F.array_join(ordered, " L"), F.lit(" Z")).alias("path"))


def to_do(catalog: DataFrame, done: DataFrame, key: str = "scene") -> DataFrame:
    """Rows of a catalog whose key is not among the results yet."""
    return catalog.join(done.select(key).distinct(), key, "left_anti")


def bank_tables(rings: DataFrame) -> DataFrame:
    """(scene, kind, node, vertices, area, length): node 0 is the right bank, 1 the left, both lines; later ones are islands."""
    w = Window.partitionBy("scene", "node").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = rings.withColumns({"nx": F.coalesce(F.lead("x").over(w), F.first("x").over(whole)), "ny": F.coalesce(F.lead("y").over(w), F.first("y").over(whole))})
    side = F.sqrt(F.pow(F.col("nx") - F.col("x"), F.lit(2)) + F.pow(F.col("ny") - F.col("y"), F.lit(2)))
    g = p.groupBy("scene", "node").agg(F.count("*").alias("vertices"), F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"), F.sum(side).alias("length"))
    island = F.col("node") >= 2
    kind = F.when(F.col("node") == 0, "right_bank").when(F.col("node") == 1, "left_bank").otherwise("island")
    return g.select("scene", kind.alias("kind"), "node", "vertices", F.when(island, F.col("area")).alias("area"), F.when(island, F.col("length")).alias("length"))


def frames(nodes: DataFrame, edges: DataFrame, channel: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables to be written of a mapped network: nodes, edges without their arrays of widths, and the channel if there is one."""
    out = {"nodes": nodes, "edges": edges.drop("widths", "h1", "h2")}
    return out | ({"channel": channel} if channel is not None else {})


def save_frames(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of parquet files for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def save_result(results: DataFrame, path: str, metadata: dict[str, str | None]) -> None:
    """Results of one scene with what is known of it as columns; its id is the first of scene_id, item_id, name and date that is set."""
    scene = next((metadata[k] for k in ("scene_id", "item_id", "name", "date") if metadata.get(k)), "unknown")
    columns = {f"meta_{k}": F.lit(v).cast("string") for k, v in metadata.items()}
    save(results.drop("scene").withColumns({"scene": F.lit(scene), **columns}), path)


def load_batch(spark: SparkSession, path: str, least_kb: int = 0) -> DataFrame:
    """Results of the scenes under `path`, in which every file has at least `least_kb` KB; each row keeps its scene."""
    if least_kb <= 0:
        return load(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    small = files.filter(F.col("length") < least_kb * 1024).select(F.regexp_extract("path", "scene=([^/]*)/", 1).alias("_scene")).distinct()
    return load(spark, path).join(F.broadcast(small), F.col("scene").cast("string") == F.col("_scene"), "left_anti")  # as many rows as there are small files
