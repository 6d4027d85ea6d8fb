import numpy as np
from pyspark.sql import functions as F

from meandra.functions import kernels
from meandra.operators import mapping
from meandra.river import River


def _cells(spark, masks):
    rows = [(s, i, j, int(m[i, j])) for s, m in masks.items() for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, "scene long, row long, col long, water int")


def _ends(spark, rows):
    return spark.createDataFrame(rows, "scene long, start_row double, start_col double, end_row double, end_col double")


def strip(width=5, length=60):
    m = np.zeros((width + 10, length), bool)
    m[5 : 5 + width] = True
    return m


def test_lines_that_meet_make_one_junction():
    m = np.zeros((21, 21), bool)
    m[10, 1:11] = True
    for k in range(1, 9):
        m[10 - k, 10 + k] = m[10 + k, 10 + k] = True
    nodes, edges = kernels.skeleton_graph(m)
    degree = np.bincount([n for a, b, _ in edges for n in (a, b)], minlength=len(nodes))
    assert sorted(degree) == [1, 1, 1, 3] and len(edges) == 3


def test_ring_is_one_edge_back_to_its_node():
    m = np.zeros((9, 9), bool)
    for r, c in [(1, 3), (1, 4), (1, 5), (2, 6), (3, 7), (4, 7), (5, 7), (6, 6), (7, 5), (7, 4), (7, 3), (6, 2), (5, 1), (4, 1), (3, 1), (2, 2)]:
        m[r, c] = True
    nodes, edges = kernels.skeleton_graph(m)
    assert len(nodes) == 1 and len(edges) == 1 and edges[0][0] == edges[0][1] == 0


def test_every_skeleton_pixel_is_in_the_graph():
    rng = np.random.default_rng(5)
    for _ in range(5):
        sk = kernels.thin(rng.random((40, 40)) < 0.6)
        nodes, edges = kernels.skeleton_graph(sk)
        on_edges = {tuple(map(int, p)) for _, _, pts in edges for p in pts}
        degree = sum(np.roll(np.pad(sk, 1), s, (0, 1)).astype(int) for s in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))[1:-1, 1:-1]
        lines = {(int(r), int(c)) for r, c in zip(*np.nonzero(sk & (degree == 2)))}
        assert lines <= on_edges
        assert on_edges <= {(int(r), int(c)) for r, c in zip(*np.nonzero(sk))}


def test_cheapest_route():
    assert kernels.route(4, [(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.0), (1, 3, 1.0)], 0, 3) == [(1, True), (2, True), (3, True)]
    assert kernels.route(3, [(0, 1, 1.0)], 0, 2) is None


def test_strip_has_its_width_and_two_banks(spark):
    river = River(_cells(spark, {1: strip()}), _ends(spark, [(1, 7.0, 0.0, 7.0, 59.0)]), pixel=10.0)
    mid = river.centerline().filter("x between 100 and 500").agg(F.min("width"), F.max("width")).first()
    assert 40 <= mid[0] <= mid[1] <= 60
    s = river.summary().first()
    assert s["scene"] == 1 and 1.0 <= s["sinuosity"] < 1.05
    left = river.banks("left").filter("x between 150 and 450").agg(F.min("y"), F.max("y")).first()
    right = river.banks("right").filter("x between 150 and 450").agg(F.min("y"), F.max("y")).first()
    assert left[0] == left[1] == -50.0 and right[0] == right[1] == -100.0


def test_gaps_are_bridged_and_dry_scenes_give_no_rows(spark):
    broken = strip()
    broken[:, 30] = False
    cells = _cells(spark, {1: broken, 2: np.zeros((4, 4), bool), 3: strip()})
    ends = _ends(spark, [(1, 7.0, 0.0, 7.0, 59.0), (2, 0.0, 0.0, 3.0, 3.0)])
    line = mapping.centerlines(cells, ends).toPandas()  # the gap of one cell is bridged; a scene without water or ends has no line
    assert set(line.scene) == {1} and line.col.min() < 10 and line.col.max() > 50
    assert {r["scene"] for r in mapping.banks(cells, ends).select("scene").distinct().collect()} == {1}
    assert mapping.networks(cells.filter("scene = 2")).count() == 0


def test_clouded_scene_gives_no_rows(spark):
    cells = _cells(spark, {1: strip()}).select("row", "col", F.col("water").alias("b"))
    assert mapping.water_of_scene(cells, F.col("b"), 0.5, most_water=0.1).count() == 0
    assert mapping.water_of_scene(cells, F.col("b"), 0.5, most_water=0.9).agg(F.sum("water")).first()[0] == 300
