"""From scenes of cells (scene, row, col, water) to networks, centerlines with widths, and banks. A task holds one scene."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meandra.functions import kernels
from meandra.operators import raster
from meandra.operators.graph import checkpointed


def water_of_scenes(cells: DataFrame, value: Column, limit: float = 0.01, smallest_hole: int = 64, most_water: float = 0.15, largest: bool = True) -> DataFrame:
    """(scene, row, col, water): threshold, small holes filled, largest water body kept, scene by scene.

    A scene with a greater share of water than `most_water` after the holes are filled is taken for clouds and
    gives no rows. All steps are joins and aggregates, so a scene may outgrow a task: scenes are laid out one
    below the other, with a row between them, and labelled together.
    """
    names = cells.select("scene").distinct().withColumn("_nr", F.row_number().over(Window.orderBy("scene")).cast("long"))  # a row a scene
    extent = cells.agg(F.min("row").alias("_low"), (F.max("row") - F.min("row") + 2).alias("_high"))  # one row
    flat = cells.join(F.broadcast(names), "scene").crossJoin(F.broadcast(extent)).withColumn("row", F.col("_nr") * F.col("_high") + F.col("row") - F.col("_low"))
    mask = checkpointed(raster.fill_holes(raster.water_mask(flat, value, limit).select("row", "col", "water"), smallest_hole))
    back = lambda df: df.crossJoin(F.broadcast(extent)).withColumn("_nr", F.floor(F.col("row") / F.col("_high")))
    mask = back(mask)
    kept = mask.groupBy("_nr").agg(F.avg("water").alias("f")).filter(F.round("f", 9) <= most_water).select("_nr")
    mask = mask.join(F.broadcast(kept), "_nr")
    if largest:
        body = back(raster.label(mask.filter("water = 1").select("row", "col")))
        first = Window.partitionBy("_nr").orderBy(F.desc("n"), "label")
        top = body.groupBy("_nr", "label").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(first)).filter("k = 1").select("_nr", "label")
        body = body.join(F.broadcast(top), ["_nr", "label"], "left_semi").select("row", "col", F.lit(1).alias("kept"))
        mask = mask.join(body, ["row", "col"], "left").withColumn("water", F.coalesce("kept", F.lit(0)))
    out = mask.join(F.broadcast(names), "_nr")
    return out.select("scene", (F.col("row") - F.col("_nr") * F.col("_high") + F.col("_low")).alias("row"), "col", "water")


def water_of_scene(cells: DataFrame, value: Column, limit: float = 0.01, smallest_hole: int = 64, most_water: float = 0.15, largest: bool = True) -> DataFrame:
    """(row, col, water) of one scene, as water_of_scenes() gives it."""
    return water_of_scenes(cells.withColumn("scene", F.lit(0)), value, limit, smallest_hole, most_water, largest).drop("scene")


def _grid(pdf: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
    m = np.zeros((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), bool)
    m[pdf["row"] - r0, pdf["col"] - c0] = pdf["water"] == 1
    return m, r0, c0


def networks(cells: DataFrame) -> DataFrame:
    """(scene, u, v, key, seq, row, col): pixels of each edge of a scene's skeleton, from node u to node v."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask, r0, c0 = _grid(pdf)
        _, edges = kernels.skeleton_graph(kernels.thin(mask))
        out, met = [], {}
        for a, b, pts in edges:
            key = met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), -1) + 1
            out.append(pd.DataFrame({"scene": pdf["scene"].iloc[0], "u": a, "v": b, "key": key, "seq": np.arange(len(pts)), "row": pts[:, 0] + r0, "col": pts[:, 1] + c0}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("scene", "u", "v", "key", "seq", "row", "col")})

    return cells.groupBy("scene").applyInPandas(run, "scene long, u long, v long, key long, seq long, row double, col double")


def _ends(pdf: pd.DataFrame, r0: int, c0: int) -> tuple[tuple[float, float], tuple[float, float]]:
    f = pdf.iloc[0]
    return (f["start_row"] - r0, f["start_col"] - c0), (f["end_row"] - r0, f["end_col"] - c0)


def centerlines(cells: DataFrame, ends: DataFrame) -> DataFrame:
    """(scene, seq, row, col, half_width): the cheapest way along the skeleton between a scene's two ends.

    `ends` is (scene, start_row, start_col, end_row, end_col), a row for each scene; scenes without one, or without
    water, give no rows. Gaps are bridged, and without a way the longest part is the line; see kernels.main_line(). Half widths are distances to the nearest cell without water, in cells.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask, r0, c0 = _grid(pdf)
        line, half = kernels.main_line(mask, *_ends(pdf, r0, c0))
        return pd.DataFrame({"scene": pdf["scene"].iloc[0], "seq": np.arange(len(line)), "row": line[:, 0] + r0, "col": line[:, 1] + c0, "half_width": half})

    return cells.join(ends, "scene").groupBy("scene").applyInPandas(run, "scene long, seq long, row double, col double, half_width double")


def banks(cells: DataFrame, ends: DataFrame) -> DataFrame:
    """(scene, side, row, col): middles of the cell sides between water and land, left or right of the centerline."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask, r0, c0 = _grid(pdf)
        line, _ = kernels.main_line(mask, *_ends(pdf, r0, c0))
        s = kernels.outline_segments(mask).astype(float)
        if not len(line):
            s = s[:0]
        middle = np.stack([(s[:, 1] + s[:, 3]) / 2 - 0.5, (s[:, 0] + s[:, 2]) / 2 - 0.5], axis=1)
        return pd.DataFrame({"scene": pdf["scene"].iloc[0], "side": kernels.sides(line, middle), "row": middle[:, 0] + r0, "col": middle[:, 1] + c0})

    found = cells.join(ends, "scene").groupBy("scene").applyInPandas(run, "scene long, side long, row double, col double")
    return found.withColumn("side", F.when(F.col("side") > 0, "left").when(F.col("side") < 0, "right").otherwise("end"))


def smooth_centerlines(cells: DataFrame, ends: DataFrame, step: float = 25.0, residual: float = 1e5, least: float = 0.0, pixel: float = 30.0) -> DataFrame:
    """(scene, seq, x, y): centerlines in ground units, smoothed and resampled about every `step`; scenes with a shorter one than `least` give no rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("seq")
        x, y = (kernels.savgol(p[c].to_numpy(float) * pixel, 21) for c in ("col", "row"))
        x, y = kernels.smoothing_curve(x, y, step, residual)
        keep = float(np.hypot(np.diff(x), np.diff(y)).sum()) >= least
        return pd.DataFrame({"scene": p["scene"].iloc[0], "seq": np.arange(len(x)), "x": x, "y": y})[: len(x) if keep else 0]

    return centerlines(cells, ends).groupBy("scene").applyInPandas(run, "scene long, seq long, x double, y double")
