import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meandra.functions import kernels, projection
from meandra.operators import network, pairs, polygons, reaches
from meandra.plans import lines as _lines  # noqa: F401  adds its queries
from meandra.plans import reaches as _plans  # noqa: F401  adds its queries
from meandra.plans.queries import QUERIES
from meandra.sources import geotiff


def _points(spark, paths):
    rows = [(s, i, float(x), float(y)) for s, path in paths.items() for i, (x, y) in enumerate(path)]
    return spark.createDataFrame(rows, "scene long, seq long, x double, y double")


def test_equal_fractions_of_a_bent_path(spark):
    p = _points(spark, {1: [(0, 0), (3, 0), (3, 1)], 2: [(5, 5), (5, 5)], 3: [(1, 1)]})
    got = {(r["scene"], r["k"]): (r["x"], r["y"]) for r in reaches.resampled(p, 5).collect()}
    assert [got[1, k] for k in range(5)] == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1)]
    assert [got[2, k] for k in range(5)] == [(5, 5)] * 5
    assert len(got) == 10
    assert reaches.resampled(p.limit(0), 5).count() == 0


def test_a_far_path_is_an_outlier(spark):
    line = lambda dy: [(x, dy) for x in range(20)]
    p = _points(spark, {i: line(i * 0.1) for i in range(9)} | {9: line(500.0), 10: [(0, 0), (1, 0)]})
    d = reaches.drop_outliers(p, overlap=0.0)
    assert {r["scene"] for r in d.collect()} == set(range(9))
    assert reaches.drop_outliers(p.filter("scene < 2"), overlap=0.9).count() == 2


def test_similarity_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    paths = {i: [tuple(v) for v in np.cumsum(rng.normal(0, 8, (12, 2)), axis=0)] for i in range(6)}
    p = _points(spark, paths)
    got = {(r["i"], r["j"]): round(r["share"], 6) for r in reaches.similarity(p, p, 4.0, 10).collect()}
    places = {}
    for r in reaches.resampled(p, 10).collect():
        places.setdefault(r["scene"], []).append((r["x"], r["y"]))

    def far(q, a, b):
        a, b, q = map(np.array, (a, b, q))
        t = np.clip((q - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
        return np.hypot(*(a + t * (b - a) - q))

    want = {}
    for i, path in paths.items():
        for j, qs in places.items():
            n = sum(min(far(q, a, b) for a, b in zip(path, path[1:])) <= 4.0 for q in qs)
            if n:
                want[i, j] = round(n / 10, 6)
    assert got == want


def test_a_branch_is_measured_from_its_junction(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("d", "f"), ("f", "g"), ("a", "z")], "u string, v string")
    got = {(r["component"], r["junction"], r["tip"], r["hops"]) for r in reaches.tributaries(e).collect()}
    assert got == {("d", "c", "g", 3), ("z", "a", "z", 1)}
    assert reaches.tributaries(e, least=2).count() == 1
    assert reaches.tributaries(e.limit(0)).count() == 0


def test_reaches_merge_over_missed_confluences(spark):
    rows = [(r, k, not (k == 2 and r < 3)) for r in range(4) for k in (1, 2, 3)] + [(9, 1, False)]
    got = {tuple(r) for r in reaches.reach_groups(spark.createDataFrame(rows, "river long, k long, near boolean"), 1).collect()}
    assert got == {(None, 1, 4), (1, 3, 3), (1, 2, 1), (2, 3, 1), (3, None, 4)}


def test_traverse_stops_on_a_loop(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 5.0), ("b", "d", 1.0), ("c", "d", 1.0), ("d", "a", 1.0)], "u string, v string, w double")
    nodes = [r["node"] for r in network.traversed(e, "a", 2).orderBy("at").collect()]
    assert nodes[:3] == ["a", "c", "d"]


def test_utm_of_known_places(spark):
    # the central meridian at the equator, and a place whose coordinates follow from the meridian arc alone
    rows = [(3.0, 0.0), (3.0, 45.0), (-177.0, -45.0), (None, 1.0)]
    g = spark.createDataFrame(rows, "lon double, lat double").withColumn("zone", projection.utm_zone(F.col("lon")))
    e, n = projection.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    got = [tuple(r) for r in g.select("zone", e.alias("e"), n.alias("n")).collect()]
    arc = 4984944.378 * 0.9996
    assert got[0] == (31, 500000.0, 0.0)
    assert got[1][0] == 31 and abs(got[1][1] - 500000) < 1e-6 and abs(got[1][2] - arc) < 0.01
    assert got[2][0] == 1 and abs(got[2][2] - (1e7 - arc)) < 0.01
    assert got[3] == (None, None, None)


def test_shifted_line_moves_by_the_shift():
    x = np.arange(0, 300.0)
    one = np.stack([x, np.zeros(300), np.full(300, 10.0)], axis=1)
    two = one + [0, 6.0, 2.0]
    m = pairs.metrics(one, two, 2.0)
    assert abs(m["p90_mr"] - 3.0) < 1e-9 and abs(m["width_diff"] - 2.0) < 1e-9
    assert m["n"] == 300 and m["n_stable_segments"] == 1 and m["stable_data_ratio"] == 1.0
    assert math.isnan(pairs.metrics(one[:2], two[:2], 2.0)["p90_mr"])


def test_pairs_of_one_table(spark):
    rows = [(p, i, float(i), 4.0 * p, 5.0, 1.0) for p in (1, 2, 3) for i in range(40)]
    t = spark.createDataFrame(rows, "pair long, seq long, x double, y double, width double, years double")
    got = {r["pair"]: r["p90_mr"] for r in pairs.analyse(t, t.withColumn("pair", F.col("pair") - 1)).collect()}
    assert set(got) == {1, 2} and all(abs(v - 4.0) < 1e-9 for v in got.values())


def test_solidity():
    r, c = np.indices((4, 5))
    assert kernels.solidity(r.ravel(), c.ravel()) == 1.0
    assert kernels.solidity(np.array([0, 1]), np.array([0, 1])) == pytest.approx(2 / 3)


def test_burning_turns_cells_to_water(spark):
    mask = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 0)], "row long, col long, water int")
    got = {tuple(r) for r in polygons.burned(mask, spark.createDataFrame([(0, 0), (0, 0), (9, 9)], "row long, col long")).collect()}
    assert got == {(0, 0, 1), (0, 1, 1), (1, 0, 0)}


def _tiff(samples, tiled=False, deflate=False, order="<"):
    """A small TIFF file of (rows, columns, bands) samples, in strips of two rows or tiles of 16."""
    h, w, bands = samples.shape
    kind = {"u": 1, "i": 2, "f": 3}[samples.dtype.kind]
    parts = []
    if tiled:
        for r in range(0, h, 16):
            for c in range(0, w, 16):
                tile = np.zeros((16, 16, bands), samples.dtype)
                cut = samples[r : r + 16, c : c + 16]
                tile[: cut.shape[0], : cut.shape[1]] = cut
                parts.append(tile)
    else:
        parts = [samples[r : r + 2] for r in range(0, h, 2)]
    parts = [p.astype(p.dtype.newbyteorder(order)).tobytes() for p in parts]
    parts = [zlib.compress(p) for p in parts] if deflate else parts
    fields = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [samples.dtype.itemsize * 8] * bands), 259: ("H", [8 if deflate else 1]), 277: ("H", [bands]), 339: ("H", [kind] * bands), 33550: ("d", [30.0, 30.0, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 1000.0, 2000.0, 0.0])}
    fields |= {322: ("I", [16]), 323: ("I", [16])} if tiled else {278: ("I", [2])}
    places, sizes = (324, 325) if tiled else (273, 279)
    fields |= {places: ("I", [0] * len(parts)), sizes: ("I", [len(p) for p in parts])}
    codes = {"H": 3, "I": 4, "d": 12}
    start = 8 + 2 + 12 * len(fields) + 4
    extra = sum(struct.calcsize(order + f * len(v)) for f, v in fields.values() if struct.calcsize(order + f * len(v)) > 4)
    at = start + extra
    fields[places] = ("I", [at + sum(map(len, parts[:k])) for k in range(len(parts))])
    out, tail = struct.pack(order + "2sHIH", b"II" if order == "<" else b"MM", 42, 8, len(fields)), b""
    for tag, (f, v) in sorted(fields.items()):
        raw = struct.pack(order + f * len(v), *v)
        if len(raw) > 4:
            tail, raw = tail + raw, struct.pack(order + "I", start + len(tail))
        out += struct.pack(order + "HHI", tag, codes[f], len(v)) + raw.ljust(4, b"\0")
    return out + b"\0" * 4 + tail + b"".join(parts)


@pytest.mark.parametrize("tiled", [False, True])
@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("dtype,order", [("u1", "<"), ("i2", ">"), ("f4", "<")])
def test_geotiff_cells_come_back(spark, tmp_path, tiled, deflate, dtype, order):
    samples = (np.arange(19 * 21 * 2) % 200).reshape(19, 21, 2).astype(dtype)
    (tmp_path / "a.tif").write_bytes(_tiff(samples, tiled, deflate, order))
    rows = geotiff.read(spark, str(tmp_path)).collect()
    assert len(rows) == samples.size
    assert all(r["value"] == samples[r["row"], r["col"], r["band"] - 1] for r in rows)
    assert {(r["x"], r["y"]) for r in rows if r["row"] == 1 and r["col"] == 2} == {(1075.0, 1955.0)}


def test_what_is_no_tiff_is_an_error():
    with pytest.raises(ValueError):
        geotiff.tags(b"PK\3\4" + b"\0" * 20)


def test_pairs_with_one_first_width_have_no_correlation(spark, tmp_path):
    days = [0, 401, 482, 512, 613, 660]  # all five pairs start at the first scene
    rows = [(river, river * 10 + k, 228440.33 if k == 0 else 100000.0 + (river * 31 + k * 7919) % 5000, day) for river in range(400) for k, day in enumerate(days)]
    orders = spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_totalprice double, day int")
    orders = orders.withColumn("o_orderdate", F.expr("cast(date_add(date'1998-08-06', day) as timestamp_ntz)"))
    orders.repartition(8, "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    apart = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {name: spark.conf.get(name) for name in apart}
    try:  # as in a large table: a river's pairs lie in several partitions, whose aggregates are merged
        for name, value in apart.items():
            spark.conf.set(name, value)
        got = QUERIES["a35_classify_pairs"](spark, str(tmp_path)).collect()
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    assert len(got) == 400
    assert {(r["n"], r["pair_class"]) for r in got} == {(5, "insufficient")}


def test_best_matches_equal_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(reaches, "PATHS", 3)
    rng = np.random.default_rng(5)
    paths = {i: np.cumsum(rng.normal(0, 3, (12, 2)), axis=0) + (200.0 * (i % 3), 0) for i in range(14)}
    paths[14] = paths[4].copy()  # a tie
    p = _points(spark, paths)
    shares = reaches.similarity(p, p, 5.0, 10).filter("i <> j")
    want = {(r["i"], r["j"], r["share"]) for r in reaches.most_similar(shares, 0.3).collect()}
    got = reaches.best_matches(p, p, 5.0, 10, 0.3)
    assert {tuple(r) for r in got.select("i", "j", "share").collect()} == want
    assert (14, 4, 1.0) in want and (4, 14, 1.0) in want
    assert all((i - j) % 3 == 0 for i, j, _ in want if 14 not in (i, j))
    assert reaches.best_matches(p.limit(0), p, 5.0).count() == 0


def test_best_matches_ask_no_later_round_once_all_are_whole(spark, monkeypatch):
    # all pairs of blocks took the square of the paths
    monkeypatch.setattr(reaches, "PATHS", 3)
    monkeypatch.setattr(reaches, "ROUND", 2)
    asked, met = [], reaches._met
    monkeypatch.setattr(reaches, "_met", lambda *a: asked.append(1) or met(*a))
    rng = np.random.default_rng(6)
    p = _points(spark, {i: np.cumsum(rng.normal(0, 1, (8, 2)), axis=0) for i in range(30)})
    got = sorted(tuple(r) for r in reaches.best_matches(p, p, 1000.0, 10).collect())
    assert got == [(i, 1 if i == 0 else 0, 1.0) for i in range(30)]
    assert len(asked) <= 2  # the path that is first needs another one


def test_best_matches_by_cells_equal_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    paths = {i: np.cumsum(rng.normal(0, 4, (int(rng.integers(2, 14)), 2)), axis=0) + (30.0 * (i % 2), 0) for i in range(40)}
    paths[40] = np.array([[1.0, 2.0], [np.nan, 3.0], [4.0, 5.0], [6.0, 7.0]])
    paths[41] = np.array([[3.0, 3.0], [3.0, 3.0]])
    p = _points(spark, paths)
    small = {"PATHS": 5, "ROUND": 2, "BATCH": 1, "PAIRS": 10}
    for sizes, buffer, least in ((small, 6.0, 0.5), ({"CELL": 3.0}, 25.0, 0.2), ({}, 6.0, 0.5)):
        with monkeypatch.context() as m:
            for name, value in sizes.items():
                m.setattr(reaches, name, value)
            shares = reaches.similarity(p, p, buffer, 10).filter("i <> j")
            want = sorted(tuple(r) for r in reaches.most_similar(shares, least).collect())
            assert want and sorted(tuple(r) for r in reaches.best_matches(p, p, buffer, 10, least).collect()) == want


def test_edge_similarity_copies_no_piece_for_the_cells_it_nears(spark, sf):
    # copies of pieces, broadcast for a join by cells, filled the driver
    plan = QUERIES["t11_edge_similarity"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan


def test_mappings_copy_no_piece_for_the_cells_it_nears(spark, sf):
    plan = QUERIES["t12_mappings"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "cx#" not in plan and "cy#" not in plan


def test_mappings_are_made_one_after_the_other(spark, sf):
    # sorts and groups of all three at once did not fit the memory that each of them fits
    plan = QUERIES["t12_mappings"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" not in plan and "Window" not in plan


def test_warps_together_equal_plain_ones():
    rng = np.random.default_rng(8)
    costs = [rng.integers(0, 4, (rng.integers(1, 9), rng.integers(1, 9))).astype(float) for _ in range(60)]
    for cost, (total, path) in zip(costs, kernels.warps(costs)):
        n, m = cost.shape
        least = np.full((n + 1, m + 1), np.inf)
        least[0, 0] = 0
        for i in range(n):
            for j in range(m):
                least[i + 1, j + 1] = cost[i, j] + min(least[i, j], least[i, j + 1], least[i + 1, j])
        assert total == least[n, m] == cost[path[:, 0], path[:, 1]].sum()
        assert path[0].tolist() == [0, 0] and path[-1].tolist() == [n - 1, m - 1]
        assert set(map(tuple, np.diff(path, axis=0).tolist())) <= {(0, 1), (1, 0), (1, 1)}
    assert kernels.warps([]) == []


def test_segment_pairs_are_no_group_each_and_equal_the_metrics_one_by_one(spark, sf):
    q = QUERIES["t24_segment_pairs"](spark, sf)
    assert "CoGroups" not in q._jdf.queryExecution().optimizedPlan().toString()  # a call of Python for each pair took the time
    rng = np.random.default_rng(9)
    paths = {s: np.cumsum(rng.normal(5, 3, (int(rng.integers(1, 30)), 2)), axis=0) for s in range(12)}
    p = _points(spark, paths).withColumns({"width": F.lit(2.0) + F.col("seq") % 3, "segment": F.lit(0)})
    catalog = p.select("scene").distinct().withColumn("acq", F.expr("date_add(date'2001-01-01', cast(scene * 100 as int))"))
    got = {(r["scene1"], r["scene2"]): r for r in pairs.segment_groups(p, catalog, 100, 350, window=6, factor=2.0, least=3).collect()}
    assert set(got) == {(a, b) for a in range(12) for b in range(a + 1, min(a + 4, 12))}
    full = {s: np.column_stack([xy, 2.0 + np.arange(len(xy)) % 3]) for s, xy in paths.items()}
    for (a, b), r in got.items():
        for name, value in pairs.metrics(full[a], full[b], (b - a) * 100 / 365.25, 6, 2.0, 3).items():
            assert (r[name] is None) if value != value else r[name] == value, name


def test_nearest_vertices_share_groups_and_equal_plain_ones(spark, monkeypatch):
    from meandra.operators import paths as lines

    monkeypatch.setattr(lines, "BUCKETS", 2, raising=False)
    rng = np.random.default_rng(4)
    points, line = ({s: rng.integers(0, 9, (int(rng.integers(1, 20)), 2)).astype(float) for s in range(lo, lo + 12)} for lo in (0, 3))
    near = lines.nearest_vertices(_points(spark, points), _points(spark, line).withColumn("scene", F.col("scene").cast("int")))
    assert "bucket" in near._jdf.queryExecution().analyzed().toString()  # a group for each scene took the time
    got = sorted(tuple(r) for r in near.select("scene", "seq", "pos", "distance").collect())
    want = []
    for s in range(3, 12):
        for k, p in enumerate(points[s]):
            d = ((line[s] - p) ** 2).sum(axis=1)
            want.append((s, k, int(d.argmin()), float(np.sqrt(d.min()))))
    assert got == want


def test_overlaps_copy_no_row_to_three_buckets(spark):
    from meandra.operators import temporal

    rng = np.random.default_rng(3)
    rows = [(0, k, int(x), int(x) + 40, int(y), int(y) + 5, int(d), int(c)) for k, (x, y, d, c) in enumerate(zip(rng.integers(0, 90, 60), rng.integers(0, 6, 60), rng.integers(0, 4000, 60), rng.integers(0, 4, 60)))]
    r = spark.createDataFrame(rows, "grp long, id long, x0 long, x1 long, y0 long, y1 long, k int, type int").withColumn("d", F.expr("date_add(date'1992-01-01', k)")).drop("k")
    pairs = temporal.overlapping(r, 365)
    assert "+ -1" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for a in rows:
        for b in rows:
            w, h = min(a[3], b[3]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[4], b[4])
            if a[1] < b[1] and w > 0 and h > 0 and abs(a[6] - b[6]) <= 365 and a[7] > 1:
                want.add((a[1], b[1], w * h, 200, 200))
    got = [tuple(x) for x in pairs.select("i", "j", "common", "area_i", "area_j").collect()]
    assert want and len(got) == len(want) and set(got) == want
