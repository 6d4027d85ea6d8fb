"""Rasters as cells (row, col, value): masks, gates, components, distances, set algebra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meandra.functions import kernels
from meandra.functions.scalar import above, gaussian
from meandra.operators.graph import components


#: Rows of a raster that share a task.
ROWS = 64


def water_mask(cells: DataFrame, value: Column, limit: float) -> DataFrame:
    return cells.withColumn("water", above(value.cast("double"), limit))


def water_fraction(mask: DataFrame, *by: str) -> DataFrame:
    return mask.groupBy(*by).agg(F.sum("water").cast("long").alias("water_cells"), F.count("*").alias("cells")).withColumn("fraction", F.round(F.col("water_cells") / F.col("cells"), 9))


def cloud_gate(mask: DataFrame, most: float = 0.15) -> DataFrame:
    """One row: the fraction of water, and whether the scene is kept."""
    return water_fraction(mask).withColumn("kept", ~(F.col("fraction") > most))


def _key(row: Column, col: Column) -> Column:
    return F.shiftleft(row.cast("long"), 32) + col.cast("long")


def neighbours(cells: DataFrame, diagonal: bool) -> DataFrame:
    """(a, b) keys of touching cells; half of the directions, each pair once. Equi-joins on shifted cells."""
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    moved = cells.select(_key(F.col("row"), F.col("col")).alias("a"), F.explode(F.array(*(F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr, dc in steps))).alias("n"))
    return moved.select("a", F.col("n.row").alias("row"), F.col("n.col").alias("col")).join(cells.select("row", "col"), ["row", "col"]).select("a", _key(F.col("row"), F.col("col")).alias("b"))


def label(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    """(row, col, label): connected components of a cell set; the label is the key of the first cell."""
    found = components(neighbours(cells, diagonal), "a", "b")
    keyed = cells.select("row", "col", _key(F.col("row"), F.col("col")).alias("node"))
    return keyed.join(found, "node", "left").select("row", "col", F.coalesce("root", "node").alias("label"))


def largest_component(cells: DataFrame, diagonal: bool = True) -> DataFrame:
    labelled = label(cells, diagonal)
    top = labelled.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)
    return labelled.join(top, "label", "left_semi")


def fill_holes(mask: DataFrame, smallest: int) -> DataFrame:
    """(row, col, water) with 4-connected land components under `smallest` cells turned to water."""
    land = label(mask.filter("water = 0").select("row", "col"), diagonal=False)
    small = land.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") < smallest)
    filled = land.join(small, "label", "left_semi").select("row", "col", F.lit(1).alias("fill"))
    return mask.join(filled, ["row", "col"], "left").select("row", "col", F.coalesce("fill", "water").alias("water"))


def squared_distance(mask: DataFrame) -> DataFrame:
    """(row, col, d2): squared distance of each water cell to the nearest land cell.

    Separable: nearest land along the column by windows, then the least sum of squares along the row, in blocks of ROWS rows.
    Water of a raster without land gives no rows.
    """
    up = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    # from the far end: a frame that ends unbounded is read anew for each row
    down = Window.partitionBy("col").orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("water") == 0, F.col("row"))
    g = mask.withColumn("above", F.last(at, ignorenulls=True).over(up)).withColumn("below", F.last(at, ignorenulls=True).over(down))
    g = g.withColumn("g", F.least(F.col("row") - F.col("above"), F.col("below") - F.col("row")))
    g = g.select("row", "col", "water", F.coalesce("g", F.lit(-1)).alias("g"), F.floor(F.col("row") / ROWS).alias("block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = (pdf[c].to_numpy() for c in ("row", "col"))
        r0, c0 = row.min(), col.min()
        d2 = np.full((row.max() - r0 + 1, col.max() - c0 + 1), np.inf)
        near = pdf["g"].to_numpy(float)
        d2[row - r0, col - c0] = np.where(near < 0, np.inf, near * near)
        found = kernels.along_rows(d2)[row - r0, col - c0]
        keep = (pdf["water"].to_numpy() == 1) & np.isfinite(found)
        return pd.DataFrame({"row": row[keep], "col": col[keep], "d2": found[keep].astype(np.int64)})

    return g.groupBy("block").applyInPandas(run, "row long, col long, d2 long")


def crop(cells: DataFrame, row0: int, col0: int, rows: int, cols: int) -> DataFrame:
    inside = F.col("row").between(row0, row0 + rows - 1) & F.col("col").between(col0, col0 + cols - 1)
    return cells.filter(inside).withColumns({"row": F.col("row") - row0, "col": F.col("col") - col0})


def downsample(cells: DataFrame, by: int, value: str = "b") -> DataFrame:
    """Mean of blocks of `by` x `by` cells."""
    return cells.groupBy(F.floor(F.col("row") / by).alias("row"), F.floor(F.col("col") / by).alias("col")).agg(F.round(F.avg(value), 6).alias("mean"))


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(row, col, kind): erosion where only later water, deposition where only earlier, channel where both."""
    both = before.select("row", "col", F.lit(1).alias("p")).join(after.select("row", "col", F.lit(1).alias("q")), ["row", "col"], "full")
    return both.select("row", "col", F.when(F.col("p").isNull(), "erosion").when(F.col("q").isNull(), "deposition").otherwise("channel").alias("kind"))


def first_last(cells: DataFrame, time: str) -> DataFrame:
    """(row, col, eroded_at, bar_at): first and last time that a cell was water."""
    return cells.groupBy("row", "col").agg(F.min(time).alias("eroded_at"), F.max(time).alias("bar_at"))


def outline(cells: DataFrame) -> DataFrame:
    """(row, col, side): cell sides between water and what is not water."""
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), (F.col("row") + dr).alias("r2"), (F.col("col") + dc).alias("c2")) for s, dr, dc in (("n", -1, 0), ("s", 1, 0), ("w", 0, -1), ("e", 0, 1)))))
    out = cells.select("row", "col", sides.alias("s")).select("row", "col", "s.side", "s.r2", "s.c2")
    there = cells.select(F.col("row").alias("r2"), F.col("col").alias("c2"))
    return out.join(there, ["r2", "c2"], "left_anti").select("row", "col", "side")


def histogram_threshold(cells: DataFrame, value: str, bins: int = 256, sigma: float = 5.0) -> DataFrame:
    """(scene, threshold): the greatest negative local minimum of the smoothed histogram of a scene's non-zero values; null without one."""
    v = cells.select("scene", F.col(value).cast("double").alias("v")).filter("v <> 0 and not isnan(v)")
    m = v.groupBy("scene").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).filter("hi > lo")
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))))
    counts = v.join(F.broadcast(m), "scene").groupBy("scene", bin_.alias("bin")).agg(F.count("*").alias("k"))
    found = counts.groupBy("scene").agg(F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("k")).join(m, "scene")
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("k", i), F.lit(0)) * bins / (F.col("n") * (F.col("hi") - F.col("lo"))))
    s = found.withColumn("dense", dense).withColumn("smooth", F.transform(gaussian(F.col("dense"), sigma), lambda x: F.round(x, 12)))
    middle = lambda i: F.col("lo") + (i + 0.5) * (F.col("hi") - F.col("lo")) / bins
    low = lambda i: (F.get("smooth", i) < F.get("smooth", i - 1)) & (F.get("smooth", i) < F.get("smooth", i + 1)) & (middle(i) < 0)
    return s.select("scene", F.array_max(F.transform(F.filter(F.sequence(F.lit(1), F.lit(bins - 2)), low), middle)).alias("threshold"))


def stretched(cells: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds v, 0 to 255: the value between two percentiles of its scene."""
    q = cells.groupBy("scene").agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_q"))
    share = F.try_divide(F.col(value) - F.col("_q")[0], F.col("_q")[1] - F.col("_q")[0])
    return cells.join(F.broadcast(q), "scene").withColumn("v", F.floor(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0))))).cast("int")).drop("_q")


def padded(cells: DataFrame, boxes: DataFrame, pad: int) -> DataFrame:
    """Cells of each box (id, r0, r1, c0, c1) with `pad` cells around it, as far as there are any. Boxes meet cells row by row."""
    rows = boxes.withColumn("row", F.explode(F.sequence(F.greatest(F.lit(0), F.col("r0") - pad).cast("long"), (F.col("r1") + pad).cast("long"))))
    met = cells.join(rows, "row").filter(F.col("col").between(F.col("c0") - pad, F.col("c1") + pad))
    return met.select("id", *cells.columns)


def by_solidity(cells: DataFrame, below: float = 0.2) -> DataFrame:
    """(label, cells, solidity) of the components (row, col, label) whose cells fill less than `below` of their convex hull.

    Only the first and last cell of each row of a component can lie on its hull, so tasks hold no more than these.
    """
    ends = cells.groupBy("label", "row").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row, n = pd.concat([pdf["row"], pdf["row"]]).to_numpy(), int(pdf["n"].sum())
        share = kernels.solidity(row, pd.concat([pdf["c0"], pdf["c1"]]).to_numpy(), n)
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "cells": [n], "solidity": [share]})

    return ends.groupBy("label").applyInPandas(run, "label long, cells long, solidity double").filter(F.col("solidity") < below)


def bilinear(cells: DataFrame, scale: float, value: str = "b") -> DataFrame:
    """(row, col, value): a raster of int(rows * scale) by int(cols * scale) cells, each between the four nearest ones; edges repeat."""
    extent = cells.agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))  # one row
    size = lambda c: F.floor(F.col(c) * F.lit(scale)).cast("long")
    lines = extent.filter((size("_h") > 0) & (size("_w") > 0)).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), size("_h") - 1)))
    at = lambda c: (F.col(c) + 0.5) / F.lit(scale) - 0.5
    near = lambda pos, last: F.array(*(F.struct(F.greatest(F.lit(0), F.least(F.col(last) - 1, F.floor(pos) + k)).cast("long").alias("i"), (F.abs(1 - k - (pos - F.floor(pos)))).alias("w")) for k in (0, 1)))
    rows = lines.withColumn("_r", F.explode(near(at("row"), "_h"))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), size("_w") - 1)))
    both = rows.withColumn("_c", F.explode(near(at("col"), "_w"))).select("row", "col", F.col("_r.i").alias("sr"), F.col("_c.i").alias("sc"), (F.col("_r.w") * F.col("_c.w")).alias("w"))
    source = cells.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value).cast("double").alias("_v"))
    return both.join(source, ["sr", "sc"]).groupBy("row", "col").agg(F.sum(F.col("w") * F.col("_v")).alias(value))


def equalised(cells: DataFrame, value: Column, tiles: int = 8, clip: float = 0.01) -> DataFrame:
    """(scene, row, col, shade): a band of 0..1 after contrast-limited equalisation, scene by scene; for previews. A task holds one scene."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = (pdf[c].to_numpy() - pdf[c].min() for c in ("row", "col"))
        image = np.zeros((row.max() + 1, col.max() + 1))
        image[row, col] = pdf["_v"].to_numpy(float)
        return pdf[["scene", "row", "col"]].assign(shade=kernels.clahe(image, tiles, clip)[row, col])

    return cells.select("scene", "row", "col", value.cast("double").alias("_v")).groupBy("scene").applyInPandas(run, "scene long, row long, col long, shade double")
