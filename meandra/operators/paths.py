"""Ordered vertices (scene, seq, x, y): lengths, curvature, bends, widths, matches. Windows stay inside a scene."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from meandra.functions import kernels
from meandra.functions.scalar import gaussian

#: Groups that the scenes of nearest_vertices() share.
BUCKETS = 4_096


def _w() -> Window:
    return Window.partitionBy("scene").orderBy("seq")


def _all() -> Window:
    return Window.partitionBy("scene")


def gradient(v: Column) -> Column:
    """Central differences, one-sided at the ends; 0 for a single vertex."""
    before, after = F.lag(v).over(_w()), F.lead(v).over(_w())
    return F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)


def steps(points: DataFrame) -> DataFrame:
    """Adds ds from central differences, s that sums it, and s0 that starts at zero."""
    g = points.withColumns({"dx": gradient(F.col("x")), "dy": gradient(F.col("y"))})
    g = g.withColumn("ds", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    run = _w().rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("s", F.sum("ds").over(run)).withColumn("s0", F.col("s") - F.first("ds").over(run))


def curvature(points: DataFrame) -> DataFrame:
    """Adds curvature from first and second central differences; null where a vertex repeats."""
    g = points.withColumns({"dx": gradient(F.col("x")), "dy": gradient(F.col("y"))})
    g = g.withColumns({"ddx": gradient(F.col("dx")), "ddy": gradient(F.col("dy"))})
    size = F.pow(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), F.lit(1.5))
    return g.withColumn("curvature", F.try_divide(F.col("dx") * F.col("ddy") - F.col("dy") * F.col("ddx"), size))


def lengths(points: DataFrame) -> DataFrame:
    """(scene, n, length, area): vertices, polyline length, and area of the closed ring."""
    nx, ny = F.lead("x").over(_w()), F.lead("y").over(_w())
    fx, fy = F.first("x").over(_w()), F.first("y").over(_w())
    p = points.withColumns({"nx": nx, "ny": ny, "fx": fx, "fy": fy})
    part = F.sqrt(F.pow(F.col("nx") - F.col("x"), F.lit(2)) + F.pow(F.col("ny") - F.col("y"), F.lit(2)))
    cx, cy = F.coalesce("nx", "fx"), F.coalesce("ny", "fy")
    return p.groupBy("scene").agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0.0)).alias("length"), F.abs(F.sum(F.col("x") * cy - cx * F.col("y")) / 2).alias("area"))


def vertex_tolerance(points: DataFrame, factor: float = 1.5) -> DataFrame:
    part = F.sqrt(F.pow(F.lead("x").over(_w()) - F.col("x"), F.lit(2)) + F.pow(F.lead("y").over(_w()) - F.col("y"), F.lit(2)))
    return points.withColumn("d", part).groupBy("scene").agg(F.coalesce(F.avg("d") * factor, F.lit(0.0)).alias("tolerance"))


def bends(curve: DataFrame, value: str) -> DataFrame:
    """Adds bend: the number of sign changes so far. Zeros keep the sign before them."""
    sign = F.when(F.col(value) > 0, 1).when(F.col(value) < 0, -1)
    run = _w().rowsBetween(Window.unboundedPreceding, 0)
    held = curve.withColumn("sgn", F.coalesce(F.last(sign, ignorenulls=True).over(run), F.lit(0)))
    turn = F.when(F.coalesce(F.lag("sgn").over(_w()) != F.col("sgn"), F.lit(False)), 1).otherwise(0)
    return held.withColumn("turn", turn).withColumn("bend", F.sum("turn").over(run))


def bend_table(curve: DataFrame, value: str) -> DataFrame:
    """(scene, bend, n, peak): vertices of each bend, and its extreme value on the side of its mean."""
    b = bends(curve, value).groupBy("scene", "bend").agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.max(value).alias("hi"), F.min(value).alias("lo"))
    return b.select("scene", "bend", "n", F.when(F.col("m") >= 0, F.col("hi")).otherwise(F.col("lo")).alias("peak"))


def waves(points: DataFrame, curve: str, least_sinuosity: float = 1.1) -> DataFrame:
    """(scene, bend, half_wave, sinuosity, wavelength): chord and arc of each bend with enough sinuosity."""
    b = bends(points, curve)
    nx, ny = F.lead("x").over(_w()), F.lead("y").over(_w())
    b = b.withColumn("part", F.coalesce(F.sqrt(F.pow(nx - F.col("x"), F.lit(2)) + F.pow(ny - F.col("y"), F.lit(2))), F.lit(0.0))).withColumns({"nx": F.coalesce(nx, F.col("x")), "ny": F.coalesce(ny, F.col("y"))})
    g = b.groupBy("scene", "bend").agg(F.sum("part").alias("arc"), F.min_by("x", "seq").alias("x0"), F.min_by("y", "seq").alias("y0"), F.max_by("nx", "seq").alias("x1"), F.max_by("ny", "seq").alias("y1"))
    chord = F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2)))
    g = g.withColumn("half_wave", chord).withColumn("sinuosity", F.try_divide(F.col("arc"), F.col("half_wave")))
    return g.filter(F.col("sinuosity") > least_sinuosity).select("scene", "bend", "half_wave", "sinuosity", (F.col("half_wave") * 2).alias("wavelength"))


def nearest(points: DataFrame, x: float, y: float) -> DataFrame:
    """(scene, seq, d2): vertex of each scene nearest to a place, the first on ties."""
    d2 = F.pow(F.col("x") - x, F.lit(2)) + F.pow(F.col("y") - y, F.lit(2))
    p = points.withColumn("d2", d2)
    return p.groupBy("scene").agg(F.min_by(F.struct("seq", "d2"), F.struct("d2", "seq")).alias("m")).select("scene", "m.seq", "m.d2")


def matching(a: DataFrame, b: DataFrame) -> DataFrame:
    """Vertices of a whose place is a vertex of b."""
    return a.join(b.select("x", "y").distinct(), ["x", "y"], "left_semi")


def where_true(points: DataFrame, condition: Column) -> DataFrame:
    """Vertices at which a condition, or a number, is neither false nor zero nor null."""
    return points.filter(condition.cast("boolean"))


def extended(points: DataFrame, ratio: float, first: int = 1, last: int = 1) -> DataFrame:
    """(scene, x0, y0, x1, y1): places beyond both ends, along the lines from the `first`-th vertex and from the `last`-th before the end."""
    size = F.max("seq").over(_all())
    p = points.withColumn("last", size)
    at = lambda c, k: F.max(F.when(F.col("seq") == k, F.col(c)))
    g = p.groupBy("scene").agg(*(at(c, k).alias(f"{c}{n}") for c in "xy" for n, k in (("a", F.lit(0)), ("b", F.lit(first)), ("y", F.col("last") - last), ("z", F.col("last")))))
    ext = lambda c: (F.col(f"{c}a") - (F.col(f"{c}b") - F.col(f"{c}a")) * ratio, F.col(f"{c}y") + (F.col(f"{c}z") - F.col(f"{c}y")) * (1 + ratio))
    (x0, x1), (y0, y1) = ext("x"), ext("y")
    return g.select("scene", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def sliding_variance(points: DataFrame, value: str, window: int = 50) -> DataFrame:
    half = window // 2
    return points.withColumn("variance", F.var_pop(value).over(_w().rowsBetween(-half, half - 1)))


def smoothed(points: DataFrame, value: str, sigma: float) -> DataFrame:
    """(scene, seq, smooth): a value along each path after a Gaussian, mirrored at the ends. A path's values are one array."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(value).cast("double").alias("v")))), lambda p: p["v"])
    first = points.groupBy("scene").agg(ordered.alias("v"), F.min("seq").alias("first"))
    return first.select("scene", "first", F.posexplode(gaussian(F.col("v"), sigma)).alias("k", "smooth")).select("scene", (F.col("first") + F.col("k")).alias("seq"), "smooth")


def high_variance(points: DataFrame, value: str, window: int, factor: float) -> DataFrame:
    """(scene, run, first, last): stretches whose smoothed sliding variance exceeds the scene's median of it times a factor."""
    v = smoothed(sliding_variance(points, value, window), "variance", max(1, window // 10)).withColumn("smooth", F.round("smooth", 9))
    v = v.join(v.groupBy("scene").agg(F.percentile("smooth", 0.5).alias("mid")), "scene")
    v = v.withColumn("high", F.when(F.col("smooth") > F.round(F.col("mid") * factor, 9), 1).otherwise(0))
    turn = F.when(F.coalesce(F.lag("high").over(_w()), F.lit(0)) != F.col("high"), 1).otherwise(0)
    v = v.withColumn("turn", turn).withColumn("run", F.sum("turn").over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    return v.filter("high = 1").groupBy("scene", "run").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))


def median5(points: DataFrame, value: str) -> DataFrame:
    """Adds median5: middle of five values, zeros beyond the ends."""
    near = F.array(*(F.coalesce(F.lag(value, -k).over(_w()) if k > 0 else F.lag(value, abs(k)).over(_w()), F.lit(0.0)) for k in range(-2, 3)))
    return points.withColumn("median5", F.element_at(F.array_sort(near), 3))


def bend_points(curve: DataFrame, value: str, least: float, share: float, skip: int) -> DataFrame:
    """(scene, seq): of each bend every skip-th vertex at or above a percentile of the values above `least`."""
    b = bends(curve, value).withColumn("size", F.abs(value))
    cut = b.filter(F.col("size") > least).groupBy("scene", "bend").agg(F.percentile("size", share).alias("cut"))
    w = Window.partitionBy("scene", "bend").orderBy("seq")
    kept = b.join(cut, ["scene", "bend"]).filter((F.col("size") > least) & (F.col("size") >= F.col("cut")))
    return kept.withColumn("nr", F.row_number().over(w) - 1).filter(F.col("nr") % skip == 0).select("scene", "seq")


def sampled_mean(points: DataFrame, value: str, least: float, samples: int = 10) -> DataFrame:
    """(scene, mean): contours whose mean over about `samples` evenly spaced vertices is at least `least`."""
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(_all()) / samples))
    p = points.withColumn("_step", step).filter(F.col("seq") % F.col("_step") == 0)
    return p.groupBy("scene").agg(F.avg(value).alias("mean")).filter(F.col("mean") >= least)


def width_and_curvature(points: DataFrame, step: float, residual: float, window: int = 11) -> DataFrame:
    """(scene, seq, x, y, s, width, curvature): each path smoothed and resampled about every `step`.

    points: (scene, seq, x, y, width). Repeated vertices and the last one go; places are smoothed by a polynomial
    window and a penalised curve; widths are those of the nearest vertex; curvature is smoothed and its median of
    five taken. A path too short to smooth comes back as it is. A task holds one path.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("seq")
        x, y, width = (p[c].to_numpy(float) for c in ("x", "y", "width"))
        keep = np.flatnonzero(np.abs(np.diff(x)) + np.abs(np.diff(y)) > 0)
        if len(keep) >= 4:
            sx, sy = kernels.smoothing_curve(kernels.savgol(x[keep], window), kernels.savgol(y[keep], window), step, residual)
        else:
            sx, sy = x, y
        near = kernels.nearest(np.stack([x, y], axis=1), np.stack([sx, sy], axis=1)) if len(x) else np.empty(0, int)
        c = kernels.median5(kernels.savgol(np.nan_to_num(kernels.curvature(sx, sy)), window))
        s = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(sx), np.diff(sy)))])
        return pd.DataFrame({"scene": pdf["scene"].iloc[0], "seq": np.arange(len(sx)), "x": sx, "y": sy, "s": s, "width": width[near], "curvature": c})

    return points.groupBy("scene").applyInPandas(run, "scene long, seq long, x double, y double, s double, width double, curvature double")


def centroids(points: DataFrame) -> DataFrame:
    """(scene, x, y): centroid of each closed ring; a ring without area gives no row."""
    whole = _w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = points.withColumns({"nx": F.coalesce(F.lead("x").over(_w()), F.first("x").over(whole)), "ny": F.coalesce(F.lead("y").over(_w()), F.first("y").over(whole))})
    k = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    g = p.groupBy("scene").agg(F.sum(k).alias("a"), F.sum((F.col("x") + F.col("nx")) * k).alias("sx"), F.sum((F.col("y") + F.col("ny")) * k).alias("sy"))
    return g.filter("a <> 0").select("scene", (F.col("sx") / (3 * F.col("a"))).alias("x"), (F.col("sy") / (3 * F.col("a"))).alias("y"))


def smooth_rings(points: DataFrame, width: int = 21) -> DataFrame:
    """(scene, seq, x, y): each closed ring smoothed across its seam, and simplified if it has over 100 vertices. A task holds one ring."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = kernels.smooth_ring(pdf.sort_values("seq")[["x", "y"]].to_numpy(float), width)
        return pd.DataFrame({"scene": pdf["scene"].iloc[0], "seq": np.arange(len(r)), "x": r[:, 0], "y": r[:, 1]})

    return points.groupBy("scene").applyInPandas(run, "scene long, seq long, x double, y double")


def nearest_vertices(points: DataFrame, line: DataFrame, *keys: str) -> DataFrame:
    """(scene, keys, seq, x, y, pos, distance): the vertex of the scene's line that is nearest to each point, the first on ties.

    Points without a line in their scene give no rows. Scenes share BUCKETS groups, as a call of Python for each takes the time of its
    rows many times over; points meet the line of their scene in blocks, not as rows.
    """
    p = points.select("scene", *keys, "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    schema = StructType([*p.schema.fields, StructField("pos", LongType()), StructField("distance", DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        both = pa.chunked_array([*a["scene"].chunks, *b["scene"].chunks], a["scene"].type).combine_chunks()
        code = np.asarray(both.dictionary_encode("encode").indices)
        mine, line = code[: len(a)], code[len(a) :]
        pos = b["pos"].to_numpy()
        first, then = np.argsort(mine, kind="stable"), np.lexsort((pos, line))
        places, vertices = (np.column_stack([t[c].to_numpy() for c in cs]).astype(float)[o] for t, cs, o in ((a, ("x", "y"), first), (b, ("u", "v"), then)))
        scenes = np.unique(mine)
        bounds = (np.searchsorted(v, scenes, side).tolist() for v in (mine[first], line[then]) for side in ("left", "right"))
        at = np.full(len(a), -1)
        for a0, a1, b0, b1 in zip(*bounds):
            if b1 > b0:
                at[a0:a1] = b0 + kernels.nearest(vertices[b0:b1], places[a0:a1])
        met = at >= 0
        at = at[met]
        distance = np.sqrt(((vertices[at] - places[met]) ** 2).sum(axis=1))
        return a.take(first[met]).append_column("pos", pa.array(pos[then][at].astype(np.int64))).append_column("distance", pa.array(distance)).drop_columns("bucket")

    bucket = F.pmod(F.xxhash64("scene"), F.lit(BUCKETS)).alias("bucket")
    right = line.select(F.col("scene").cast(p.schema["scene"].dataType).alias("scene"), F.col("seq").alias("pos"), F.col("x").cast("double").alias("u"), F.col("y").cast("double").alias("v"))
    return p.select("*", bucket).groupBy("bucket").cogroup(right.select("*", bucket).groupBy("bucket")).applyInArrow(run, schema)


def channel_width(points: DataFrame, samples: DataFrame, method: str = "nearest_neighbor", most: float | None = None) -> DataFrame:
    """(scene, seq, width): channel widths carried over to other vertices of the scene. samples: (scene, seq, x, y, width).

    nearest_neighbor: that of the nearest sample, NaN beyond `most` (three mean spacings of the samples if not given);
    inverse_distance: mean by squared distance, within `most` if given, NaN without a sample in reach; spline_projection:
    between the two neighbours of the nearest sample by the share of the way, the nearest one's where it has no neighbour.
    """
    if method not in ("nearest_neighbor", "inverse_distance", "spline_projection"):
        raise ValueError(f"unknown method {method}")
    p = points.select("scene", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    kind = p.schema.simpleString().removeprefix("struct<").split(",x:")[0].replace(":", " ")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty:
            return pd.DataFrame({"scene": [], "seq": [], "width": []})
        out = np.full(len(a), np.nan)
        if len(b):
            b = b.sort_values("pos")
            places, v, w = a[["x", "y"]].to_numpy(float), b[["u", "v"]].to_numpy(float), b["width"].to_numpy(float)
            out = kernels.carried(places, v, w, method, most)
        return a[["scene", "seq"]].assign(width=out)

    right = samples.select(F.col("scene").alias("of"), F.col("seq").alias("pos"), F.col("x").cast("double").alias("u"), F.col("y").cast("double").alias("v"), F.col("width").cast("double").alias("width"))
    return p.groupBy("scene").cogroup(right.groupBy("of")).applyInPandas(run, f"{kind}, width double")
