"""Rings and rectangles against cells: cover, masks, contiguity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meandra.operators import raster


def rings_of(rects: DataFrame) -> DataFrame:
    """(id, seq, x, y): the corners of rectangles, in order."""
    corners = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x0").alias("x"), F.col("y1").alias("y")))
    return rects.select("id", F.posexplode(corners).alias("seq", "p")).select("id", "seq", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))


def covered(rings: DataFrame, size: float = 1.0) -> DataFrame:
    """(id, row, col): cells whose centre lies in a ring, by the even-odd rule.

    Each edge meets the rows it spans; crossings of a row, in pairs along x, bound the covered cells.
    """
    w = Window.partitionBy("id").orderBy("seq")
    first = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = rings.withColumns({"nx": F.coalesce(F.lead("x").over(w), F.first("x").over(first)), "ny": F.coalesce(F.lead("y").over(w), F.first("y").over(first))})
    low, high = F.least("y", "ny"), F.greatest("y", "ny")
    r0, r1 = F.ceil(low / size - 0.5), F.ceil(high / size - 0.5) - 1
    e = e.filter(r1 >= r0).withColumn("row", F.explode(F.sequence(r0, r1)))
    yc = (F.col("row") + 0.5) * size
    cross = e.select("id", "row", (F.col("x") + (yc - F.col("y")) * (F.col("nx") - F.col("x")) / (F.col("ny") - F.col("y"))).alias("cx"))
    along = Window.partitionBy("id", "row").orderBy("cx")
    c = cross.withColumns({"nr": F.row_number().over(along), "until": F.lead("cx").over(along)}).filter("nr % 2 = 1 and until is not null")
    c0, c1 = F.ceil(F.col("cx") / size - 0.5), F.ceil(F.col("until") / size - 0.5) - 1
    return c.filter(c1 >= c0).select("id", "row", F.explode(F.sequence(c0, c1)).alias("col"))


def water_outside(cells: DataFrame, land: DataFrame) -> DataFrame:
    """(row, col, water): 1 where no land polygon covers the cell."""
    covered_once = land.select("row", "col").distinct().withColumn("land", F.lit(1))
    return cells.select("row", "col").join(covered_once, ["row", "col"], "left").select("row", "col", F.when(F.col("land").isNull(), 1).otherwise(0).alias("water"))


def burned(mask: DataFrame, shapes: DataFrame) -> DataFrame:
    """(row, col, water): the mask with cells under a polygon turned to water."""
    under = shapes.select("row", "col").distinct().withColumn("under", F.lit(1))
    return mask.join(under, ["row", "col"], "left").select("row", "col", F.coalesce("under", "water").alias("water"))


def rook_contiguity(cells: DataFrame) -> DataFrame:
    """(a, b, shared): labels a < b that share cell sides, and how many."""
    right = cells.select("row", (F.col("col") - 1).alias("col"), F.col("label").alias("other"))
    down = cells.select((F.col("row") - 1).alias("row"), "col", F.col("label").alias("other"))
    touch = cells.join(right.unionByName(down), ["row", "col"]).filter("label <> other")
    return touch.groupBy(F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).agg(F.count("*").alias("shared"))


def largest_part(parts: DataFrame, by: str, area: str, tie: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(area), tie)
    return parts.withColumn("_nr", F.row_number().over(w)).filter("_nr = 1").drop("_nr")


def water_mask(cells: DataFrame, land: DataFrame, include_islands: bool = True, buffer: int = 0, fill: int = 1, nodata: int = 0) -> DataFrame:
    """(row, col, water): `fill` where no land (node, row, col) is, else `nodata`. Nodes from 2 on are islands; land grows by `buffer` cells each way."""
    if not include_islands:
        land = land.filter("node < 2")
    land = land.select("row", "col").distinct()
    if buffer:
        around = F.sequence(F.lit(-buffer), F.lit(buffer))
        land = land.select("row", F.explode(F.transform(around, lambda k: F.col("col") + k)).alias("col")).distinct()
        land = land.select(F.explode(F.transform(around, lambda k: F.col("row") + k)).alias("row"), "col").distinct()
    return water_outside(cells, land).withColumn("water", F.when(F.col("water") == 1, F.lit(fill)).otherwise(F.lit(nodata)))


def channel(cells: DataFrame, banks: DataFrame, mouth: DataFrame | None = None) -> DataFrame:
    """(row, col): cells that no bank polygon or island covers, without those of the river's mouth."""
    out = cells.select("row", "col").join(banks.select("row", "col").distinct(), ["row", "col"], "left_anti")
    return out if mouth is None else out.join(mouth.select("row", "col").distinct(), ["row", "col"], "left_anti")


def faces(cells: DataFrame) -> DataFrame:
    """(row, col, face): what lines of cells (row, col, line) enclose. Open sets of cells that reach the border of the raster are no face."""
    open_ = raster.label(cells.filter("line = 0").select("row", "col"), diagonal=False)
    edge = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    outer = open_.crossJoin(F.broadcast(edge)).filter("row = r0 or row = r1 or col = c0 or col = c1").select("label").distinct()  # one row beside all cells
    return open_.join(outer, "label", "left_anti").select("row", "col", F.col("label").alias("face"))


def junctions(cells: DataFrame) -> DataFrame:
    """(row, col, faces): corners of cells at which three labels or more meet; corner (row, col) is the upper left one of that cell."""
    corners = F.explode(F.array(*(F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i in (0, 1) for j in (0, 1))))
    at = cells.select("label", corners.alias("p")).select("p.row", "p.col", "label")
    return at.groupBy("row", "col").agg(F.size(F.collect_set("label")).cast("long").alias("faces")).filter("faces >= 3")


def rook_nodes(cells: DataFrame) -> DataFrame:
    """(label, area, row, col, perimeter, neighbours): a label's cells, their mean place, sides to other labels or to nothing, and labels across."""
    area = cells.groupBy("label").agg(F.count("*").alias("area"), F.avg("row").alias("row"), F.avg("col").alias("col"))
    sides = F.explode(F.array(*(F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1)))))
    across = cells.select("label", sides.alias("p")).select("label", "p.row", "p.col").join(cells.select("row", "col", F.col("label").alias("other")), ["row", "col"], "left")
    outer = across.filter("other is null or other <> label").groupBy("label").agg(F.count("*").alias("perimeter"), F.countDistinct("other").alias("neighbours"))
    return area.join(outer, "label", "left").select("label", "area", "row", "col", F.coalesce("perimeter", F.lit(0)).alias("perimeter"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def utm_rings(rings: DataFrame, width: float, height: float, left: float, upper: float, dx: float, dy: float) -> DataFrame:
    """Rings (node, x, y in cells) in ground units; nodes 0 and 1, the outer ones, are first cut to the image, corner by corner."""
    outer = F.col("node") < 2
    cut = lambda c, most: F.when(outer, F.greatest(F.lit(0.0), F.least(F.lit(most), F.col(c)))).otherwise(F.col(c))
    return rings.withColumns({"x": F.lit(left) + cut("x", width) * dx, "y": F.lit(upper) + cut("y", height) * dy})
