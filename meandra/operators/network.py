"""Edges with arrays: lengths, widths, orientation, routes."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meandra.functions import kernels
from meandra.operators.graph import checkpointed, degrees, sinks, sources, undirected


def array_length(xs: str, ys: str) -> Column:
    """Length of a polyline held in two arrays."""
    i = F.sequence(F.lit(1), F.size(xs) - 1)
    part = F.transform(i, lambda k: F.sqrt(F.pow(F.get(F.col(xs), k) - F.get(F.col(xs), k - 1), F.lit(2)) + F.pow(F.get(F.col(ys), k) - F.get(F.col(ys), k - 1), F.lit(2))))
    return F.when(F.size(xs) > 1, F.aggregate(part, F.lit(0.0), lambda a, b: a + b)).otherwise(F.lit(0.0))


def mean_width(left: str, right: str) -> Column:
    """Mean over the vertices of the sum of both half widths; null without a vertex."""
    total = F.zip_with(left, right, lambda a, b: a + b)
    return F.try_divide(F.aggregate(total, F.lit(0.0), lambda a, b: a + b), F.size(total))


def oriented(edges: DataFrame, node_x: str, node_y: str) -> DataFrame:
    """Arrays of each edge turned so that they begin at the end nearer to its start node."""
    d = lambda k: F.pow(F.element_at("xs", k) - F.col(node_x), F.lit(2)) + F.pow(F.element_at("ys", k) - F.col(node_y), F.lit(2))
    turn = d(1) > d(-1)
    return edges.withColumn("_turn", turn).withColumns({c: F.when(F.col("_turn"), F.reverse(c)).otherwise(F.col(c)) for c in ("xs", "ys")}).drop("_turn")


def shortest_paths(edges: DataFrame, start: str, most: int | None = None) -> DataFrame:
    """(node, cost): least summed weight from a node over directed (u, v, w), by repeated relaxation.

    Only nodes whose cost fell go into the next round, until there are none; weights are not negative.
    With `most`, an error if that many rounds do not settle it.
    """
    spark = edges.sparkSession
    known = spark.createDataFrame([(start, 0.0)], "node string, cost double")
    front = known
    e = edges.select("u", "v", F.col("w").cast("double").alias("w"))
    for _ in itertools.count() if most is None else range(most):
        step = front.join(e, front.node == e.u).groupBy(F.col("v").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("cost"))
        better = step.join(known.withColumnRenamed("cost", "old"), "node", "left").filter("old is null or cost < old").select("node", "cost")
        front = checkpointed(better)
        if front.isEmpty():
            return known
        known = checkpointed(known.unionByName(front).groupBy("node").agg(F.min("cost").alias("cost")))
    raise RuntimeError("shortest paths did not settle")


def widest_route(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """(path, weight, mean): of the ways from a root down to `depth` edges or a sink the one with the greatest mean weight an edge.

    The first path on ties. For each node and number of edges only the heaviest way so far goes on, so rows do
    not grow with the number of ways; a way does not come back to a node it has.
    """
    e = edges.select("u", "v", F.col("w").cast("double").alias("w"))
    now = edges.sparkSession.createDataFrame([(root, [root], 0.0)], "node string, path array<string>, weight double")
    ends = None
    for _ in range(depth):
        step = now.join(e, (now.node == e.u) & ~F.array_contains(now.path, e.v), "left")
        stuck = step.filter("v is null").select("path", "weight")
        ends = stuck if ends is None else ends.unionByName(stuck)
        on = step.filter("v is not null").select(F.col("v").alias("node"), F.concat("path", F.array("v")).alias("path"), (F.col("weight") + F.col("w")).alias("weight"))
        now = checkpointed(on.groupBy("node").agg(F.min(F.struct((-F.col("weight")).alias("less"), "path")).alias("m")).select("node", "m.path", (-F.col("m.less")).alias("weight")))
    ends = now.select("path", "weight") if ends is None else ends.unionByName(now.select("path", "weight"))
    r = ends.filter(F.size("path") > 1).withColumn("mean", F.col("weight") / (F.size("path") - 1))
    return r.orderBy(F.desc("mean"), "path").limit(1)


def subpaths(edges: DataFrame) -> DataFrame:
    """(start, end, path, edges): the way with the fewest edges from each source to each sink that it reaches, the first on ties."""
    e = checkpointed(edges.select("u", "v").distinct())
    front = sources(e).select(F.col("node").alias("start"), "node", F.array("node").alias("path"))
    known = front
    while True:
        step = front.join(e, front.node == e.u).select("start", F.col("v").alias("node"), F.concat("path", F.array("v")).alias("path"))
        step = step.groupBy("start", "node").agg(F.min_by("path", F.array_join("path", ">")).alias("path"))
        front = checkpointed(step.join(known.select("start", "node"), ["start", "node"], "left_anti"))
        if front.isEmpty():
            break
        known = checkpointed(known.unionByName(front))
    out = known.join(sinks(e), "node", "left_semi").filter(F.size("path") > 1)
    return out.select("start", F.col("node").alias("end"), "path", (F.size("path") - 1).alias("edges"))


def _spliced(pairs: DataFrame, edges: DataFrame, once: bool) -> DataFrame:
    i = F.sequence(F.lit(1), F.size("path") - 1)
    steps = pairs.select("pair", F.explode(F.array("one", "two")).alias("path")).filter(F.size("path") > 1)
    steps = steps.select("pair", F.explode(F.transform(i, lambda k: F.struct(F.get("path", k - 1).alias("u"), F.get("path", k).alias("v")))).alias("s")).select("pair", "s.u", "s.v").distinct()
    wide = steps.join(edges.groupBy("u", "v").agg(F.max("width").alias("width")), ["u", "v"]).groupBy("pair").agg(F.collect_list(F.struct("u", "v", "width")).alias("steps"))

    def run(batches):
        for pdf in batches:
            widths = [{(s["u"], s["v"]): s["width"] for s in (found if found is not None else [])} for found in pdf["steps"]]
            path = [kernels.spliced(list(a), list(b), w, once) for a, b, w in zip(pdf["one"], pdf["two"], widths)]
            yield pd.DataFrame({"pair": pdf["pair"], "path": path})

    return pairs.join(wide, "pair", "left").select("pair", "one", "two", "steps").mapInPandas(run, "pair long, path array<string>")


def spliced_paths(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair, path): path `one` of each pair with those spans of `two` that part from it and are wider on the mean. edges: (u, v, width)."""
    return _spliced(pairs, edges, False)


def spliced_once(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair, path): as spliced_paths, with one span from where the paths first part to where they last meet."""
    return _spliced(pairs, edges, True)


def start_node(edges: DataFrame, most: int = 3) -> DataFrame:
    """One row: the least node among those with under `most` neighbours and the sinks from which another of these is reached.

    Each node keeps the two least candidates that it reaches, so that one of them is not itself.
    """
    e = checkpointed(edges.select("u", "v").distinct())
    few = undirected(e).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n")).filter(F.col("n") < most).select("node")
    some = checkpointed(few.union(sinks(e)).distinct())
    known = some.select("node", F.col("node").alias("to")).filter("false")
    front = some.select("node", F.col("node").alias("to"))
    while True:
        step = e.join(front, e.v == front.node).select(F.col("u").alias("node"), "to").distinct()
        both = checkpointed(known.unionByName(step).distinct().groupBy("node").agg(F.slice(F.array_sort(F.collect_set("to")), 1, 2).alias("to")).select("node", F.explode("to").alias("to")))
        front = checkpointed(both.join(known, ["node", "to"], "left_anti"))
        if front.isEmpty():
            break
        known = both
    return known.filter("node <> to").join(some, "node", "left_semi").agg(F.min("node").alias("node")).filter("node is not null")


def terminals(edges: DataFrame) -> DataFrame:
    """Nodes with one edge, in or out."""
    return degrees(edges).filter("n_in + n_out = 1").select("node")


def traversed(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(node, at): nodes of the widest routes taken one after the other, each from the last one's end.

    Ends where no route goes on, or where a route adds no new node. Each round fetches one route.
    """
    e = checkpointed(edges)
    path, seen = [start], {start}
    while True:
        best = widest_route(e, path[-1], depth).first()
        if best is None or not set(best["path"]) - seen:
            break
        path += best["path"][1:]
        seen |= set(best["path"])
    return edges.sparkSession.createDataFrame([(n, k) for k, n in enumerate(path)], "node string, at long")


def split_at_nearest(edges: DataFrame, x: float, y: float) -> DataFrame:
    """Each edge as two rows, part 0 and 1, cut at its vertex nearest to a place; both hold that vertex."""
    d = F.zip_with("xs", "ys", lambda a, b: F.pow(a - x, F.lit(2)) + F.pow(b - y, F.lit(2)))
    e = edges.withColumn("_d", d).withColumn("_i", F.array_position("_d", F.array_min("_d")).cast("int")).drop("_d")
    head, tail = (lambda c: F.slice(c, F.lit(1), F.col("_i"))), (lambda c: F.slice(c, F.col("_i"), F.size(c)))
    both = F.array(*(F.struct(F.lit(k).alias("part"), f("xs").alias("xs"), f("ys").alias("ys")) for k, f in ((0, head), (1, tail))))
    return e.withColumn("_p", F.explode(both)).drop("xs", "ys", "_i").select("*", "_p.part", "_p.xs", "_p.ys").drop("_p")


def nearest_vertex(vertices: DataFrame, x: float, y: float, *ids: str) -> DataFrame:
    """One row: ids and distance of the vertex nearest to a place, the least ids on ties."""
    d2 = F.pow(F.col("x") - x, F.lit(2)) + F.pow(F.col("y") - y, F.lit(2))
    m = vertices.agg(F.min(F.struct(d2.alias("d2"), *ids)).alias("m"))
    return m.filter("m is not null").select(*(f"m.{c}" for c in ids), F.sqrt("m.d2").alias("distance"))
