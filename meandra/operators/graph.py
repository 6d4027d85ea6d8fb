"""Channel networks as edge tables."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the session's shared checkpoint folder; a local session without one gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="meandra-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, a: str = "u", b: str = "v", rounds: int = 60) -> DataFrame:
    """(node, root): least node reachable from each node that has an edge, by alternating star contraction.

    A node whose only edges lead to itself is its own root.
    """
    alone = edges.filter(F.col(a) == F.col(b)).select(F.col(a).alias("node")).distinct()
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now, before = checkpointed(now), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = both.filter("v > u").join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = checkpointed(moved.unionByName(least.withColumnRenamed("m", "v")).distinct())
        after = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    return found.unionByName(alone.join(found, "node", "left_anti").withColumn("root", F.col("node")))


def undirected(edges: DataFrame) -> DataFrame:
    e = edges.filter("u <> v")
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def remove_dead_ends(edges: DataFrame, keep: list[str] | None = None, rounds: int | None = None) -> DataFrame:
    """(u, v) both ways, after nodes with fewer than two neighbours went, again and again; `keep` stays. With `rounds`, an error if these are too few."""
    now = checkpointed(undirected(edges))
    for _ in itertools.count() if rounds is None else range(rounds):
        loose = now.groupBy("u").agg(F.count("*").alias("n")).filter("n < 2")
        if keep:
            loose = loose.filter(~F.col("u").isin(keep))
        loose = checkpointed(loose.select("u"))
        if loose.isEmpty():
            return now
        now = checkpointed(now.join(loose, "u", "left_anti").join(loose.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v"))
    raise RuntimeError("dead ends are left")


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n_in"))
    both = out.join(into, "node", "full")
    return both.select("node", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def classify_nodes(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out, kind)."""
    i, o = F.col("n_in"), F.col("n_out")
    kind = F.when((i >= 2) & (o == 1), "confluence").when((i == 1) & (o >= 2), "split").when((i == 0) & (o > 0), "source").when((i > 0) & (o == 0), "sink").when((i == 1) & (o == 1), "channel").otherwise("other")
    return degrees(edges).withColumn("kind", kind)


def classify_undirected(edges: DataFrame) -> DataFrame:
    n = F.col("n")
    return undirected(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n")).withColumn("kind", F.when(n >= 3, "junction").when(n == 2, "channel").when(n == 1, "terminal").otherwise("isolated"))


def sources(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node")).distinct().join(edges.select(F.col("v").alias("node")), "node", "left_anti")


def sinks(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("node")).distinct().join(edges.select(F.col("u").alias("node")), "node", "left_anti")


def hops(edges: DataFrame, start: DataFrame, radius: int) -> DataFrame:
    """(node, hop): nodes within `radius` hops of the start nodes, breadth first."""
    both = undirected(edges)
    seen = start.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, radius + 1):
        step = front.select(F.col("node").alias("u")).join(both, "u").select(F.col("v").alias("node")).distinct()
        front = checkpointed(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(front)
    return seen


def matching_subpaths(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of subpaths with equal start and end."""
    return a.select(F.col("path").alias("path_a"), "start", "end").join(b.select(F.col("path").alias("path_b"), "start", "end"), ["start", "end"])


def spliced(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of only the first and only the second path: where a splice can change over."""
    return a.exceptAll(b), b.exceptAll(a)


def exceedance(values: DataFrame, drop: int = 0) -> DataFrame:
    """Adds exceedance to (node, n): 1 - rank / count, ranks from the least n on, after the `drop` largest went.

    Ranks come from the counts of equal values: only nodes of one value share a window, and a row a value the other.
    """
    by = values.groupBy("n").agg(F.count("*").alias("k"))
    before = by.select("n", F.coalesce(F.sum("k").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = values.agg((F.count("*") - drop).alias("c"))
    ranked = values.join(before, "n").withColumn("nr", F.col("before") + F.row_number().over(Window.partitionBy("n").orderBy("node"))).crossJoin(F.broadcast(total))
    return ranked.filter("nr <= c").select("node", "n", (1 - F.col("nr") / F.col("c")).alias("exceedance"))
