"""What surrounds a centerline: discs along banks, the channel belt, river mouths, cuts by polygons, and the directions of a network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meandra.functions import flow, kernels
from meandra.functions.scalar import closest_on_segment
from meandra.operators import raster


def painted(points: DataFrame, most: float = 500.0) -> DataFrame:
    """(id, row, col): cells whose centres lie within w of a vertex (id, row, col, w), for widths up to `most`.

    A vertex gives the spans of its disc row by row, so nothing is joined.
    """
    v = points.filter((F.col("w") >= 0) & (F.col("w") <= most))
    reach = F.floor("w").cast("long")
    v = v.withColumn("_k", F.explode(F.sequence(-reach, reach)))
    half = F.floor(F.sqrt(F.col("w") * F.col("w") - F.col("_k") * F.col("_k"))).cast("long")
    return v.select("id", (F.col("row") + F.col("_k")).alias("row"), F.explode(F.sequence(F.col("col") - half, F.col("col") + half)).alias("col")).distinct()


def ranked_contours(contours: DataFrame) -> DataFrame:
    """(id, contour, score): the best contour of each id by 0.6 of its length and 0.4 of its irregularity, each scaled to 0..1 within the id; the least contour on ties."""
    w = Window.partitionBy("id")

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.coalesce(F.try_divide(F.col(c) - low, high - low), F.lit(0.0))

    s = contours.withColumn("score", F.round(0.6 * scaled("length") + 0.4 * scaled("irregularity"), 9))
    first = Window.partitionBy("id").orderBy(F.desc("score"), "contour")
    return s.withColumn("_nr", F.row_number().over(first)).filter("_nr = 1").select("id", "contour", "score")


def bank_contours(cells: DataFrame) -> DataFrame:
    """(id, contour, length, irregularity) of the connected parts of each id's cells: sides around a part, and its cells over the vertices of its hull."""
    from meandra.operators.graph import checkpointed

    names = cells.select("id").distinct().withColumn("_nr", F.row_number().over(Window.orderBy("id")).cast("long"))  # a row for each id
    extent = cells.agg(F.min("row").alias("_low"), (F.max("row") - F.min("row") + 2).alias("_high"))
    flat = cells.join(F.broadcast(names), "id").crossJoin(F.broadcast(extent)).select("id", (F.col("_nr") * F.col("_high") + F.col("row") - F.col("_low")).alias("row"), "col")
    flat = checkpointed(flat)
    parts = checkpointed(raster.label(flat.select("row", "col")).join(flat, ["row", "col"]))
    sides = raster.outline(flat.select("row", "col")).groupBy("row", "col").agg(F.count("*").alias("n"))
    length = parts.join(sides, ["row", "col"]).groupBy("id", F.col("label").alias("contour")).agg(F.sum("n").alias("length"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = np.concatenate([pdf[["c0", "row"]].to_numpy(float), pdf[["c1", "row"]].to_numpy(float)])
        return pd.DataFrame({"contour": [pdf["label"].iloc[0]], "irregularity": [float(pdf["n"].sum()) / len(kernels.hull(ends))]})

    rows = parts.groupBy("label", "row").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("n"))
    return length.join(rows.groupBy("label").applyInPandas(run, "contour long, irregularity double"), "contour").select("id", "contour", "length", "irregularity")


def belt(cells: DataFrame, line: DataFrame, half_width: float, islands: DataFrame | None = None) -> DataFrame:
    """(row, col, side): cells within `half_width` of a vertex of a line (seq, row, col), on its left, 1, right, -1, or on it, 0.

    The side is that of the nearest vertex, the first on ties, and of the direction there. Cells meet the
    vertices of their own and the neighbouring squares of that size. Island cells are left out.
    """
    w = Window.orderBy("seq")  # one line: its vertices fit a task
    d = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    v = line.select("seq", F.col("row").alias("vr"), F.col("col").alias("vc"), d("row").alias("dr"), d("col").alias("dc"))
    square = lambda c: F.floor(F.col(c) / F.lit(float(half_width)))
    steps = F.array(*(F.struct((F.col("qr") + i).alias("qr"), (F.col("qc") + j).alias("qc")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    v = v.withColumns({"qr": square("vr"), "qc": square("vc")}).withColumn("q", F.explode(steps)).drop("qr", "qc").select("*", "q.qr", "q.qc").drop("q")
    met = cells.select("row", "col").withColumns({"qr": square("row"), "qc": square("col")}).join(v, ["qr", "qc"])
    d2 = F.pow(F.col("row") - F.col("vr"), F.lit(2)) + F.pow(F.col("col") - F.col("vc"), F.lit(2))
    near = met.withColumn("d2", d2).filter(F.col("d2") <= half_width * half_width).groupBy("row", "col").agg(F.min_by(F.struct("vr", "vc", "dr", "dc"), F.struct("d2", "seq")).alias("m"))
    cross = F.col("m.dc") * (F.col("m.vr") - F.col("row")) + F.col("m.dr") * (F.col("col") - F.col("m.vc"))
    out = near.select("row", "col", F.signum(cross.cast("double")).cast("int").alias("side"))
    return out if islands is None else out.join(islands.select("row", "col").distinct(), ["row", "col"], "left_anti")


def mouth(cells: DataFrame, coast: DataFrame, radius: float) -> DataFrame:
    """(row, col): the smaller of the two largest parts that a coast (row, col), painted with discs, divides the cells into."""
    shore = painted(coast.select(F.lit(0).alias("id"), "row", "col", F.lit(float(radius)).alias("w"))).select("row", "col")
    parts = raster.label(cells.select("row", "col").join(shore, ["row", "col"], "left_anti"), diagonal=False)
    size = parts.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(2)
    least = size.orderBy("n", F.desc("label")).limit(1)
    return parts.join(F.broadcast(least.select("label")), "label", "left_semi").select("row", "col")


def without_superposition(edges: DataFrame) -> DataFrame:
    """(edge, end, x, y): new places of second vertices that two edges share at one node, end 0 or 1.

    Of the edges (edge, s, t, xs, ys) at a node that also share the vertex after it, all but the one with the least id
    get theirs moved to the nearest place between the vertices around it.
    """
    at = lambda c, k, end: F.element_at(c, k if end == 0 else -k)
    ends = F.explode(F.array(*(F.struct(F.lit(end).alias("end"), F.col(node).alias("node"), *(at(c, k, end).alias(f"{c[0]}{k}") for k in (1, 2, 3) for c in ("xs", "ys"))) for end, node in ((0, "s"), (1, "t")))))
    e = edges.filter(F.size("xs") >= 3).select("edge", ends.alias("e")).select("edge", "e.*")
    first = e.groupBy("node", "x2", "y2").agg(F.min("edge").alias("least"), F.countDistinct("edge").alias("n")).filter("n > 1")
    moved = e.join(first, ["node", "x2", "y2"]).filter("edge > least")
    x, y = closest_on_segment(F.col("x2"), F.col("y2"), F.col("x1"), F.col("y1"), F.col("x3"), F.col("y3"))
    return moved.select("edge", "end", x.alias("x"), y.alias("y"))


def truncated(edges: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """(edge, part, s, t, xs, ys): what is left of edges outside a polygon.

    An edge that crosses the outline is cut there; the end on it is a new node, named after the edge, the part and the side. An edge
    that lies inside goes. The polygon is a parameter and small; each edge is cut on its own.
    """
    ring = np.array(polygon, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for edge, s, t, xs, ys in zip(pdf["edge"], pdf["s"], pdf["t"], pdf["xs"], pdf["ys"]):
                parts = flow.outside(np.stack([xs, ys], axis=1).astype(float), ring)
                for k, (line, whole_start, whole_end) in enumerate(parts):
                    a, b = (str(s) if whole_start else f"{edge}:{k}:in"), (str(t) if whole_end else f"{edge}:{k}:out")
                    out.append((edge, k, a, b, line[:, 0].tolist(), line[:, 1].tolist()))
            yield pd.DataFrame(out, columns=["edge", "part", "s", "t", "xs", "ys"])

    return edges.select("edge", "s", "t", "xs", "ys").mapInPandas(run, "edge long, part long, s string, t string, xs array<double>, ys array<double>")


def directed(edges: DataFrame, faces: DataFrame, banks: DataFrame, flip_outliers: bool = False) -> DataFrame:
    """(scene, edge, s, t, turned, known): edges in the direction of flow. A task holds one scene's network.

    edges: (scene, edge, s, t, xs, ys); faces: (scene, face, edge), the edges around each island; banks: (scene, bank, seq, x, y),
    the two outer banks from source to mouth. Edges that share over two vertices with an outer bank follow it. From these the
    direction is carried from face to face: an edge without one takes that within 90 degrees of the sum of its face's known
    edges. With `flip_outliers`, edges over 100 degrees off the mean of those within three hops turn. An edge that nothing
    reaches stays as it is, not known.
    """

    def run(key: tuple, e: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        columns = ["scene", "edge", "s", "t", "turned", "known"]
        if e.empty:
            return pd.DataFrame({c: [] for c in columns})
        lines = {i: np.stack([x, y], axis=1).astype(float) for i, x, y in zip(e["edge"], e["xs"], e["ys"])}
        ends = {i: (s, t) for i, s, t in zip(e["edge"], e["s"], e["t"])}
        around = {f: g["edge"].astype(int).tolist() for f, g in rest[rest["kind"] == 0].groupby("a")}
        outer = [g.sort_values("seq")[["x", "y"]].to_numpy(float) for _, g in rest[rest["kind"] == 1].groupby("a")]
        turned, known = flow.directions(lines, ends, around, outer, flip_outliers)
        rows = [(key[0], i, *(ends[i][::-1] if turned[i] else ends[i]), turned[i], known[i]) for i in lines]
        return pd.DataFrame(rows, columns=columns)

    none = lambda t: F.lit(None).cast(t)
    f = faces.select(F.col("scene").alias("of"), F.lit(0).alias("kind"), F.col("face").cast("long").alias("a"), F.col("edge").cast("long").alias("edge"), none("long").alias("seq"), none("double").alias("x"), none("double").alias("y"))
    b = banks.select(F.col("scene").alias("of"), F.lit(1).alias("kind"), F.col("bank").cast("long").alias("a"), none("long").alias("edge"), F.col("seq").cast("long").alias("seq"), "x", "y")
    both = f.unionByName(b)
    return edges.groupBy("scene").cogroup(both.groupBy("of")).applyInPandas(run, "scene long, edge long, s long, t long, turned boolean, known boolean")
