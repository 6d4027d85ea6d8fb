"""River-shaped views of plain tables, used by the queries and the tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, b): a raster band with one cell for each vector component."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return e.select("row", F.col("col").cast("long").alias("col"), F.floor(F.col("v").cast("double") * 1000).cast("int").alias("b"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene, seq, x, y): ordered points of one path a scene."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").cast("double")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("scene"), (F.row_number().over(w) - 1).cast("long").alias("seq"), x.alias("x"), F.col("value").alias("y"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(river, scene, acq, width): a catalog of dated scenes."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("river"), F.col("o_orderkey").alias("scene"), F.col("o_orderdate").cast("date").alias("acq"), F.col("o_totalprice").alias("width"))


def edges(spark: SparkSession, sf_dir: str, sparse: bool = False, where: Column | None = None) -> DataFrame:
    """(u, v) of a directed graph; the sparse one has dead ends. `where` picks the rows of one date."""
    rows = table(spark, sf_dir, "lineitem")
    if sparse:
        rows = rows.filter(F.col("l_quantity") == 50)
    if where is not None:
        rows = rows.filter(where)
    return rows.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("u"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("v")).distinct()


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, x0, x1, y0, y1, d): dated rectangles with integer areas, dealt by group once for what is done by group next."""
    rows = table(spark, sf_dir, "lineitem")
    y0 = F.col("l_linenumber").cast("long")
    cols = [F.col("l_suppkey").alias("grp"), F.col("l_partkey").alias("x0"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("x1"), y0.alias("y0"), (y0 + 5).alias("y1"), F.col("l_shipdate").cast("date").alias("d")]
    return rows.select(*cols).repartition("grp").distinct()
