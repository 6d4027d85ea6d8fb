import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meandra.functions import kernels
from meandra.functions import scalar as S
from meandra.operators import graph, network, paths, raster
from meandra.plans import lines as _lines  # noqa: F401  adds its queries
from meandra.plans.queries import QUERIES


def test_circle_has_constant_curvature(spark):
    n, radius = 720, 100.0
    rows = [(1, i, radius * math.cos(2 * math.pi * i / n), radius * math.sin(2 * math.pi * i / n)) for i in range(n)]
    c = paths.curvature(spark.createDataFrame(rows, "scene long, seq long, x double, y double")).filter("seq between 5 and 700").agg(F.min("curvature"), F.max("curvature")).first()
    assert abs(c[0] - 1 / radius) < 1e-4 and abs(c[1] - 1 / radius) < 1e-4


def test_zero_over_zero_is_nan_and_land(spark):
    r = spark.createDataFrame([(0.0, 0.0), (2.0, 1.0), (1.0, -1.0)], "a double, b double")
    v = [tuple(x) for x in r.select(S.normalized_difference(F.col("a"), F.col("b")).alias("v")).withColumn("w", S.above(F.col("v"), 0.0)).collect()]
    assert math.isnan(v[0][0]) and v[0][1] == 0 and v[1][1] == 1 and math.isinf(v[2][0])


def test_holes_are_filled_below_the_threshold(spark):
    m = np.ones((8, 8), int)
    m[2, 2] = 0
    m[5:7, 4:7] = 0
    rows = [(i, j, int(m[i, j])) for i in range(8) for j in range(8)]
    out = raster.fill_holes(spark.createDataFrame(rows, "row long, col long, water int"), 3).filter("water = 0")
    assert {(r["row"], r["col"]) for r in out.collect()} == {(i, j) for i in (5, 6) for j in (4, 5, 6)}


def test_dead_ends_go_until_none_is_left(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "u string, v string")
    kept = {tuple(sorted((r["u"], r["v"]))) for r in graph.remove_dead_ends(e).collect()}
    assert kept == {("a", "b"), ("b", "c"), ("a", "c")}
    assert {r["u"] for r in graph.remove_dead_ends(e, keep=["e"]).collect()} == set("abcde")


def test_long_chain_is_one_component(spark):
    e = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert graph.components(e).select("root").distinct().collect()[0][0] == 0


def test_empty_inputs(spark):
    cells = spark.createDataFrame([], "row long, col long")
    assert raster.label(cells).count() == 0 and raster.outline(cells).count() == 0
    assert paths.lengths(spark.createDataFrame([], "scene long, seq long, x double, y double")).count() == 0


def test_bounded_rounds_are_whole_or_errors(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(6)], "u string, v string, w double")
    assert network.shortest_paths(chain, "n0").count() == 7
    for short in (lambda: network.shortest_paths(chain, "n0", most=3), lambda: graph.remove_dead_ends(chain, rounds=2), lambda: graph.components(chain, rounds=1)):
        with pytest.raises(RuntimeError):
            short()


@pytest.mark.parametrize("name", ["r10_distance_transform", "b3_half_widths"])
def test_no_frame_of_a_column_is_read_anew_for_each_row(spark, sf, name):
    # frames that end unbounded took the square of the rows
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan


def test_squared_distance_of_a_tall_raster(spark):
    rows = 20_000
    mask = np.random.default_rng(3).random((rows, 2)) < 0.97
    cells = spark.createDataFrame([(i, j, int(mask[i, j])) for i in range(rows) for j in range(2)], "row long, col long, water int")
    got = {(r["row"], r["col"]): r["d2"] for r in raster.squared_distance(cells).collect()}
    d2 = kernels.distance_transform(mask) ** 2
    assert got == {(i, j): round(d2[i, j]) for i, j in zip(*np.nonzero(mask))}
