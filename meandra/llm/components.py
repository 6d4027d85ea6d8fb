"""Connected components of an edge list that may be larger than any one machine."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meandra.operators import graph


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, root) of every node on an edge between two nodes; root is the component's smallest node. Null ends are left out.

    The star contraction of operators.graph: minima are partial aggregates and rows are joined back to
    them, so a hub with very many neighbours is never gathered: adaptive joins split it. Each round is some ten
    shuffles, whatever the rows, so lists of at most `few` edges are united on the driver, to the same rows; with
    `few`, give edges that are cheap to read twice.
    """
    edges = edges.filter(f"{a} is not null and {b} is not null").select(a, b)
    if few and edges.count() <= few:
        return _united(edges)
    return graph.components(edges, a, b, most_rounds)


def _united(edges: DataFrame) -> DataFrame:
    """(node, root) of an edge list that the driver can hold."""
    above: dict = {}

    def find(x):
        while (up := above[x]) != x:
            above[x] = x = above[up]
        return x

    for x, y in zip(*(column.to_pylist() for column in edges.toArrow().columns)):
        above.setdefault(x, x)
        above.setdefault(y, y)
        x, y = find(x), find(y)
        above[max(x, y)] = min(x, y)
    kind = edges.schema[0].dataType
    made = pa.table({"node": pa.array(list(above), pa.int64()), "root": pa.array([find(x) for x in list(above)], pa.int64())})
    return edges.sparkSession.createDataFrame(made).select(F.col("node").cast(kind), F.col("root").cast(kind))
