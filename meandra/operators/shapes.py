"""Frames and lines of a mapped network: nodes, edges, widths along paths, ends, trims and cuts. Edges are (edge, s, t, xs, ys, h1, h2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meandra.operators import paths
from meandra.operators.network import array_length, mean_width


def edge_frame(edges: DataFrame) -> DataFrame:
    """(edge, source, target, key, xs, ys, mm_len, width, widths): parallel edges are numbered in the order of their ids."""
    key = F.row_number().over(Window.partitionBy("s", "t").orderBy("edge")) - 1
    return edges.select("edge", F.col("s").alias("source"), F.col("t").alias("target"), key.alias("key"), "xs", "ys", array_length("xs", "ys").alias("mm_len"), mean_width("h1", "h2").alias("width"), F.zip_with("h1", "h2", lambda a, b: a + b).alias("widths"))


def node_frame(edges: DataFrame) -> DataFrame:
    """(node, x, y): where the first edge that has the node begins or ends."""
    ends = F.explode(F.array(*(F.struct(F.col(n).alias("node"), F.lit(i).alias("side"), F.element_at("xs", k).alias("x"), F.element_at("ys", k).alias("y")) for i, (n, k) in enumerate((("s", 1), ("t", -1))))))
    rows = edges.select("edge", ends.alias("e")).select("edge", "e.*")
    return rows.groupBy("node").agg(F.min_by(F.struct("x", "y"), F.struct("edge", "side")).alias("p")).select("node", "p.x", "p.y")


def vertices(edges: DataFrame, *more: str) -> DataFrame:
    """(edge, seq, x, y, ...): a row for each vertex, with the arrays in `more` beside it."""
    zipped = F.arrays_zip("xs", "ys", *more)
    rows = edges.select("edge", F.posexplode(zipped).alias("seq", "p"))
    return rows.select("edge", "seq", F.col("p.xs").alias("x"), F.col("p.ys").alias("y"), *(f"p.{m}" for m in more))


def all_widths(edges: DataFrame) -> DataFrame:
    """(edge, seq, width): the widths of all edges, vertex by vertex."""
    return vertices(edges, "h1", "h2").select("edge", "seq", (F.col("h1") + F.col("h2")).alias("width"))


def along_path(edges: DataFrame, path: DataFrame) -> DataFrame:
    """(scene, seq, x, y, w): vertices of a path's edges one after the other; each edge after the first leaves out its first vertex.

    path: (scene, pos, edge). seq counts through the path.
    """
    rows = path.join(vertices(edges, "h1", "h2").withColumnRenamed("seq", "k"), "edge").filter("pos = 0 or k > 0")
    w = Window.partitionBy("scene").orderBy("pos", "k")
    return rows.select("scene", (F.row_number().over(w) - 1).alias("seq"), "x", "y", (F.col("h1") + F.col("h2")).alias("w"))


def extended_clines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose vertices are turned to begin near node s and get the places of s and t put at their ends."""
    at = lambda n: nodes.select(F.col("node").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    e = edges.join(at("s"), "s").join(at("t"), "t")
    d = lambda k: F.pow(F.element_at("xs", k) - F.col("sx"), F.lit(2)) + F.pow(F.element_at("ys", k) - F.col("sy"), F.lit(2))
    e = e.withColumn("turn", d(1) > d(-1))
    put = lambda c, a, b: F.concat(F.array(a), F.when(F.col("turn"), F.reverse(c)).otherwise(F.col(c)), F.array(b))
    return e.select("edge", "s", "t", put("xs", "sx", "tx").alias("xs"), put("ys", "sy", "ty").alias("ys"))


def nearest_node(nodes: DataFrame, to: object) -> DataFrame:
    """One row (node, distance): the node nearest to node `to`, the least on ties; itself is left out."""
    there = nodes.filter(F.col("node") == to).select(F.col("x").alias("tx"), F.col("y").alias("ty"))
    d2 = F.pow(F.col("x") - F.col("tx"), F.lit(2)) + F.pow(F.col("y") - F.col("ty"), F.lit(2))
    m = nodes.filter(F.col("node") != to).crossJoin(F.broadcast(there)).agg(F.min(F.struct(d2.alias("d2"), "node")).alias("m"))  # one row beside all nodes
    return m.filter("m is not null").select("m.node", F.sqrt("m.d2").alias("distance"))


def end_nodes(edges: DataFrame, nodes: DataFrame, places: DataFrame) -> DataFrame:
    """(place, node): of the nodes with one edge the one nearest to each place (place, px, py), the least on ties."""
    ends = edges.select(F.explode(F.array("s", "t")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).filter("n = 1")
    at = nodes.join(ends, "node", "left_semi").crossJoin(F.broadcast(places))  # a place for each end of a river
    d2 = F.pow(F.col("x") - F.col("px"), F.lit(2)) + F.pow(F.col("y") - F.col("py"), F.lit(2))
    return at.groupBy("place").agg(F.min_by("node", F.struct(d2, "node")).alias("node"))


def trimmed(edges: DataFrame, x: Column, y: Column, at_start: bool = True) -> DataFrame:
    """Edges cut at the vertex nearest to a place: what lies beyond it at their start (or end) goes.

    An edge of two vertices, or whose nearest vertex is that end already, moves its end vertex to the place.
    """
    d2 = F.zip_with("xs", "ys", lambda a, b: F.pow(a - x, F.lit(2)) + F.pow(b - y, F.lit(2)))
    e = edges.withColumn("_d", d2).withColumn("_i", F.array_position("_d", F.array_min("_d")).cast("int")).withColumn("_n", F.size("xs"))
    first, last = F.lit(1), F.col("_n")
    stays = (F.col("_i") == (first if at_start else last)) | (F.col("_n") == 2)

    def cut(c: str, v: Column) -> Column:
        if at_start:
            rest = F.slice(c, F.when(stays, F.lit(2)).otherwise(F.col("_i")), F.col("_n"))
            return F.when(stays, F.concat(F.array(v), rest)).otherwise(rest)
        rest = F.slice(c, F.lit(1), F.when(stays, F.col("_n") - 1).otherwise(F.col("_i")))
        return F.when(stays, F.concat(rest, F.array(v))).otherwise(rest)

    return e.withColumns({"xs": cut("xs", x), "ys": cut("ys", y)}).drop("_d", "_i", "_n")


def half_widths(edge_cells: DataFrame, bank_cells: DataFrame, distance: DataFrame, least: int = 2) -> DataFrame:
    """(edge, node, half_widths): distances to land at an edge's vertices, for each bank that shares over `least` of them.

    edge_cells: (edge, seq, row, col); bank_cells: (node, row, col); distance: (row, col, d2). A vertex
    without a distance lies on land and counts as 0.
    """
    shared = edge_cells.join(bank_cells.distinct(), ["row", "col"]).groupBy("edge", "node").agg(F.count("*").alias("n")).filter(F.col("n") > least).select("edge", "node")
    deep = edge_cells.join(distance, ["row", "col"], "left").select("edge", "seq", F.sqrt(F.coalesce("d2", F.lit(0))).alias("d"))
    lines = deep.groupBy("edge").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "d"))), lambda p: p["d"]).alias("half_widths"))
    return shared.join(lines, "edge")


def split_ring(points: DataFrame, start: tuple[float, float], end: tuple[float, float]) -> DataFrame:
    """(scene, bank, k, x, y): a ring cut at the vertices nearest to two places into the way from start to end, 0, and the way around, 1."""
    near = lambda p: F.min_by("seq", F.struct(F.pow(F.col("x") - p[0], F.lit(2)) + F.pow(F.col("y") - p[1], F.lit(2)), "seq"))
    cuts = points.groupBy("scene").agg(near(start).alias("i"), near(end).alias("j"), F.count("*").alias("n"))
    p = points.join(cuts, "scene").withColumn("from_i", F.pmod(F.col("seq") - F.col("i"), F.col("n"))).withColumn("span", F.pmod(F.col("j") - F.col("i"), F.col("n")))
    one = p.filter("from_i <= span").select("scene", F.lit(0).alias("bank"), F.col("from_i").alias("k"), "x", "y")
    # the other way runs backwards, also from start to end
    two = p.filter("from_i >= span or from_i = 0").select("scene", F.lit(1).alias("bank"), F.pmod(F.col("n") - F.col("from_i"), F.col("n")).alias("k"), "x", "y")
    return one.unionByName(two)


def within_buffer(points: DataFrame, line: DataFrame, distance: float) -> DataFrame:
    """(scene, seq, x, y): the longest run of consecutive points within `distance` of a vertex of the scene's line; the first on ties.

    Points meet the vertices of their own and the neighbouring squares of that size.
    """
    square = lambda c: F.floor(F.col(c) / F.lit(distance))
    steps = F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    cells = line.select("scene", F.col("x").alias("lx"), F.col("y").alias("ly"), square("x").alias("cx"), square("y").alias("cy")).withColumn("c", F.explode(steps)).select("scene", "lx", "ly", "c.cx", "c.cy")
    near = points.withColumns({"cx": square("x"), "cy": square("y")}).join(cells, ["scene", "cx", "cy"])
    near = near.filter(F.pow(F.col("x") - F.col("lx"), F.lit(2)) + F.pow(F.col("y") - F.col("ly"), F.lit(2)) <= distance * distance).select("scene", "seq", "x", "y").distinct()
    w = Window.partitionBy("scene").orderBy("seq")
    runs = near.withColumn("run", F.col("seq") - F.row_number().over(w))
    best = runs.groupBy("scene", "run").agg(F.count("*").alias("n")).groupBy("scene").agg(F.max_by("run", F.struct("n", -F.col("run"))).alias("run"))
    return runs.join(best, ["scene", "run"], "left_semi").select("scene", "seq", "x", "y")


def straightened(points: DataFrame, reference: DataFrame, *rings: str) -> DataFrame:
    """(scene, ring keys, seq, pos, s, off): each point by the nearest vertex of the scene's reference line.

    off: signed distance along the left normal at that vertex; s: how far along the line it is; reference:
    (scene, seq, x, y, dx, dy, s) with vertices of no direction left out. A task holds one scene's line and points.
    """
    ref = reference.filter("dx * dx + dy * dy > 0").select("scene", F.col("seq").alias("pos"), F.col("x").alias("rx"), F.col("y").alias("ry"), "dx", "dy", "s")
    near = paths.nearest_vertices(points.select("scene", *rings, "seq", "x", "y"), ref.select("scene", F.col("pos").alias("seq"), F.col("rx").alias("x"), F.col("ry").alias("y")), *rings)
    m = near.join(ref, ["scene", "pos"])
    off = ((F.col("y") - F.col("ry")) * F.col("dx") - (F.col("x") - F.col("rx")) * F.col("dy")) / F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return m.select("scene", *rings, "seq", "pos", "s", off.alias("off"))


def separated(parts: DataFrame) -> DataFrame:
    """(id, part, seq, x, y): the vertices of all parts with a NaN after the last of each."""
    ends = parts.groupBy("id", "part").agg((F.max("seq") + 1).alias("seq")).withColumns({"x": F.lit(float("nan")), "y": F.lit(float("nan"))})
    return parts.select("id", "part", "seq", "x", "y").unionByName(ends)


def split_path(edges: DataFrame, path: DataFrame, places: DataFrame) -> DataFrame:
    """(scene, segment, pos, edge, xs, ys): a path cut at the vertices nearest to places (scene, place, px, py).

    Segments count from 0 downstream. An edge in which a cut falls comes back in parts, each with the vertex at the
    cut; places that fall on one vertex make one cut, and one at an end of the path none.
    """
    rows = path.join(vertices(edges).withColumnRenamed("seq", "k"), "edge")
    w = Window.partitionBy("scene").orderBy("pos", "k")
    rows = rows.withColumn("seq", F.row_number().over(w) - 1)
    d2 = F.pow(F.col("x") - F.col("px"), F.lit(2)) + F.pow(F.col("y") - F.col("py"), F.lit(2))
    last = rows.groupBy("scene").agg(F.max("seq").alias("last"))
    cuts = rows.join(places, "scene").groupBy("scene", "place").agg(F.min_by("seq", F.struct(d2, "seq")).alias("seq")).select("scene", "seq").distinct()
    cuts = cuts.join(last, "scene").filter("seq > 0 and seq < last").select("scene", "seq", F.lit(1).alias("cut"))
    run = Window.partitionBy("scene").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.join(cuts, ["scene", "seq"], "left").withColumn("cut", F.coalesce("cut", F.lit(0))).withColumn("segment", F.sum("cut").over(run))
    # the vertex at a cut ends one segment and begins the next
    own = F.when(F.col("cut") == 1, F.array(F.col("segment") - 1, F.col("segment"))).otherwise(F.array("segment"))
    parts = cut.withColumn("segment", F.explode(own)).groupBy("scene", "segment", "pos", "edge").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("v"))
    parts = parts.filter(F.size("v") > 1)
    return parts.select("scene", "segment", "pos", "edge", F.transform("v", lambda p: p["x"]).alias("xs"), F.transform("v", lambda p: p["y"]).alias("ys"))
