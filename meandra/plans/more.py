"""More queries: polygons, networks with arrays, matching and filters over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meandra.functions import scalar as S
from meandra.operators import network, paths, polygons, raster, shapes, temporal
from meandra.plans.queries import GRAD, PIX, RECT, RID, SAM, SCE, SPARSE, W, _pix, _rc, _rects, query, smooth_sql
from meandra.sources import store, views
from meandra.streaming import catalog

SHAPES = f"{RECT}, {RID}"
COVER = "cov AS (SELECT id, r.v AS c, s.v AS r FROM rid, LATERAL (SELECT unnest(range(x0, x1)) AS v) r, LATERAL (SELECT unnest(range(y0, y1)) AS v) s)"


def _cover(spark: SparkSession, d: str) -> DataFrame:
    return polygons.covered(polygons.rings_of(_rects(spark, d)))


@query("r17_rasterize_polygons", f"WITH {SHAPES}, {COVER} SELECT id, count(*) AS cells, min(r) AS r0, max(c) AS c1 FROM cov GROUP BY id")
def r17(spark: SparkSession, d: str) -> DataFrame:
    return _cover(spark, d).groupBy("id").agg(F.count("*").alias("cells"), F.min("row").alias("r0"), F.max("col").alias("c1"))


@query("k7_water_mask_from_polygons", f"WITH {SHAPES}, {COVER}, {PIX}, land AS (SELECT DISTINCT r, c FROM cov) SELECT p.r, p.c, CASE WHEN l.r IS NULL THEN 1 ELSE 0 END AS water FROM pix p LEFT JOIN land l ON p.r = l.r AND p.c = l.c")
def k7(spark: SparkSession, d: str) -> DataFrame:
    return _rc(polygons.water_outside(_pix(spark, d), _cover(spark, d)))


@query("g17_point_in_polygon", f"WITH {SHAPES}, pt AS (SELECT event_id, floor(value)::BIGINT AS c, user_id % 12 AS r FROM events), u AS (SELECT DISTINCT c, r FROM pt), m AS (SELECT u.c, u.r, count(*) AS n, min(rid.id) AS first FROM u JOIN rid ON u.c >= rid.x0 AND u.c < rid.x1 AND u.r >= rid.y0 AND u.r < rid.y1 GROUP BY u.c, u.r) SELECT event_id, n, first FROM pt JOIN m USING (c, r)")
def g17(spark: SparkSession, d: str) -> DataFrame:
    # polygons are counted cell by cell before the points meet them
    cells = _cover(spark, d).groupBy("row", "col").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    e = views.table(spark, d, "events").select("event_id", F.floor("value").alias("col"), (F.col("user_id") % 12).alias("row"))
    return e.join(cells, ["row", "col"]).select("event_id", "n", "first")


@query("g29_union_area", f"WITH {SHAPES}, {COVER} SELECT count(*) AS area FROM (SELECT DISTINCT r, c FROM cov)")
def g29(spark: SparkSession, d: str) -> DataFrame:
    return _cover(spark, d).select("row", "col").distinct().agg(F.count("*").alias("area"))


@query("h17_rook_contiguity", f"WITH {PIX}, l AS (SELECT r, c, floor(b / 100.0)::BIGINT AS label FROM pix), t AS (SELECT a.label AS x, b.label AS y FROM l a JOIN l b ON (a.r = b.r AND b.c = a.c + 1) OR (a.c = b.c AND b.r = a.r + 1)) SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS shared FROM t WHERE x <> y GROUP BY 1, 2")
def h17(spark: SparkSession, d: str) -> DataFrame:
    return polygons.rook_contiguity(_pix(spark, d).select("row", "col", F.floor(F.col("b") / F.lit(100.0)).alias("label")))


@query("g20_largest_part", f"WITH {RECT}, {RID}, k AS (SELECT grp, id, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY grp ORDER BY (x1 - x0) * (y1 - y0) DESC, id) AS nr FROM rid) SELECT grp, id, area FROM k WHERE nr = 1")
def g20(spark: SparkSession, d: str) -> DataFrame:
    parts = _rects(spark, d).select("grp", "id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    return polygons.largest_part(parts, "grp", "area", "id")


@query("r14_filter_half_contours", f"WITH {PIX}, k AS (SELECT r, c, b, count(*) OVER (PARTITION BY r) AS n FROM pix) SELECT r, round(avg(b), 6) AS mean FROM k WHERE c % greatest(1, n // 10) = 0 GROUP BY r HAVING avg(b) >= 20")
def r14(spark: SparkSession, d: str) -> DataFrame:
    points = _pix(spark, d).select(F.col("row").alias("scene"), F.col("col").alias("seq"), "b")
    return paths.sampled_mean(points, "b", 20.0).select(F.col("scene").alias("r"), F.round("mean", 6).alias("mean"))


@query("r16_gaussian_filter", f"WITH {SAM}, l AS (SELECT scene, list(y ORDER BY seq) AS ys FROM sam GROUP BY scene), g AS (SELECT scene, {smooth_sql('ys', 2.0)} AS sm FROM l) SELECT scene, i - 1 AS seq, round(sm[i], 9) AS smooth FROM g, LATERAL (SELECT unnest(range(1, len(sm) + 1)) AS i)")
def r16(spark: SparkSession, d: str) -> DataFrame:
    return paths.smoothed(views.samples(spark, d), "y", 2.0).select("scene", "seq", F.round("smooth", 9).alias("smooth"))


@query("g8_extrapolate", f"WITH {SAM} SELECT scene, seq, round(x + (lead(x) OVER w - x) * 2.5, 6) AS ex, round(y + (lead(y) OVER w - y) * 2.5, 6) AS ey FROM sam {W}")
def g8(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("scene").orderBy("seq")
    x, y = S.extrapolated(F.col("x"), F.col("y"), F.lead("x").over(w), F.lead("y").over(w), 2.5)
    return views.samples(spark, d).select("scene", "seq", F.round(x, 6).alias("ex"), F.round(y, 6).alias("ey"))


@query("g14_count_and_trim_vertices", f"WITH {SAM} SELECT scene, count(*) AS vertices, greatest(count(*) - 2 * 5, 0) AS trimmed, max(seq) FILTER (WHERE seq >= 5) AS last FROM sam GROUP BY scene")
def g14(spark: SparkSession, d: str) -> DataFrame:
    return views.samples(spark, d).groupBy("scene").agg(F.count("*").alias("vertices"), F.greatest(F.count("*") - 10, F.lit(0)).alias("trimmed"), F.max(F.when(F.col("seq") >= 5, F.col("seq"))).alias("last"))


@query("g22_straighten_channel", f"WITH {SAM}, {GRAD}, ref AS (SELECT scene, seq, x, y, dx, dy FROM g2 WHERE dx * dx + dy * dy > 0), p AS (SELECT scene - 1 AS scene, seq, x, y FROM sam), k AS (SELECT p.scene, p.seq, r.seq AS pos, ((p.y - r.y) * r.dx - (p.x - r.x) * r.dy) / sqrt(r.dx * r.dx + r.dy * r.dy) AS off, row_number() OVER (PARTITION BY p.scene, p.seq ORDER BY pow(p.x - r.x, 2) + pow(p.y - r.y, 2), r.seq) AS nr FROM p JOIN ref r ON p.scene = r.scene) SELECT scene, seq, pos, round(off, 4) + 0.0 AS off FROM k WHERE nr = 1")
def g22(spark: SparkSession, d: str) -> DataFrame:
    s = views.samples(spark, d)
    out = shapes.straightened(s.withColumn("scene", F.col("scene") - 1), paths.steps(s))
    return out.select("scene", "seq", "pos", (F.round("off", 4) + F.lit(0.0)).alias("off"))


_OTHER = f"{SAM}, big AS (SELECT scene, seq, x, y * 5000 AS y, y AS width FROM sam), t AS (SELECT scene - 1 AS scene, seq, x, y FROM big), p AS (SELECT t.scene, t.seq, s.seq AS pos, s.width, pow(t.x - s.x, 2) + pow(t.y - s.y, 2) AS d2 FROM t LEFT JOIN big s ON s.scene = t.scene)"


def _widths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    big = views.samples(spark, d).withColumn("width", F.col("y")).withColumn("y", F.col("y") * 5000)
    return big.select((F.col("scene") - 1).alias("scene"), "seq", "x", "y"), big


@query("b15_inverse_distance_width", f"WITH {_OTHER} SELECT scene, seq, CASE WHEN count(*) FILTER (WHERE d2 <= 1e11) = 0 THEN 'nan'::DOUBLE ELSE round(sum(width / greatest(d2, 1e-10)) FILTER (WHERE d2 <= 1e11) / sum(1 / greatest(d2, 1e-10)) FILTER (WHERE d2 <= 1e11), 6) END AS width FROM p GROUP BY scene, seq")
def b15(spark: SparkSession, d: str) -> DataFrame:
    return paths.channel_width(*_widths(spark, d), "inverse_distance", 1e11**0.5).select("scene", "seq", F.round("width", 6).alias("width"))


@query("b15_nearest_width", f"WITH {_OTHER}, l AS (SELECT scene, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM big {W}), g AS (SELECT scene, 3 * avg(sqrt(dx * dx + dy * dy)) AS far FROM l GROUP BY scene), k AS (SELECT scene, seq, arg_min(width, (d2, pos)) AS width, min(d2) AS d2 FROM p GROUP BY scene, seq) SELECT k.scene, k.seq, CASE WHEN sqrt(d2) <= far THEN width ELSE 'nan'::DOUBLE END AS width FROM k LEFT JOIN g ON g.scene = k.scene")
def b15_nearest(spark: SparkSession, d: str) -> DataFrame:
    return paths.channel_width(*_widths(spark, d))


@query("b15_projected_width")
def b15_projected(spark: SparkSession, d: str) -> DataFrame:
    return paths.channel_width(*_widths(spark, d), "spline_projection")


@query("b4_width_weights", "SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: abs(embedding[i]::DOUBLE) + abs(embedding[i + 32]::DOUBLE))) / 32, 6) AS width FROM embeddings")
def b4(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("e"))
    e = e.select("vec_id", F.slice("e", 1, 32).alias("hw1"), F.slice("e", 33, 32).alias("hw2"))
    return e.select("vec_id", F.round(network.mean_width("hw1", "hw2"), 6).alias("width"))


@query("h7_edge_pixel_length", "SELECT vec_id, round(list_sum(list_transform(range(2, 33), lambda i: sqrt(pow(embedding[i]::DOUBLE - embedding[i - 1]::DOUBLE, 2) + pow(embedding[i + 32]::DOUBLE - embedding[i + 31]::DOUBLE, 2)))), 6) AS length FROM embeddings")
def h7(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    e = e.select("vec_id", F.slice("e", 1, 32).alias("xs"), F.slice("e", 33, 32).alias("ys"))
    return e.select("vec_id", F.round(network.array_length("xs", "ys"), 6).alias("length"))


@query("h21_flip_coords", "WITH k AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, CASE WHEN pow(e[1], 2) + pow(e[33], 2) > pow(e[32], 2) + pow(e[64], 2) THEN e[32] ELSE e[1] END AS x0, CASE WHEN pow(e[1], 2) + pow(e[33], 2) > pow(e[32], 2) + pow(e[64], 2) THEN e[33] ELSE e[64] END AS y1 FROM k")
def h21(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    e = e.select("vec_id", F.slice("e", 1, 32).alias("xs"), F.slice("e", 33, 32).alias("ys"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"))
    return network.oriented(e, "nx", "ny").select("vec_id", F.element_at("xs", 1).alias("x0"), F.element_at("ys", -1).alias("y1"))


_CHAIN = "g AS (SELECT 'n' || l_partkey % 60 AS u, 'n' || (l_partkey % 60 + 1 + l_suppkey % 3) AS v, (max(l_partkey) % 7 + 1)::DOUBLE AS w FROM lineitem GROUP BY 1, 2)"


def _chain(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_partkey") % 60
    u, v = F.concat(F.lit("n"), n.cast("string")), F.concat(F.lit("n"), (n + 1 + F.col("l_suppkey") % 3).cast("string"))
    return views.table(spark, d, "lineitem").groupBy(u.alias("u"), v.alias("v")).agg((F.max("l_partkey") % 7 + 1).cast("double").alias("w"))


@query("h3_shortest_path", f"WITH RECURSIVE {_CHAIN}, r(node, cost) AS (SELECT 'n0', 0.0::DOUBLE UNION SELECT g.v, cost + w FROM r JOIN g ON g.u = r.node) SELECT node, min(cost) AS cost FROM r GROUP BY node")
def h3(spark: SparkSession, d: str) -> DataFrame:
    return network.shortest_paths(_chain(spark, d), "n0")


@query("h26_find_subpath", f"WITH RECURSIVE {_CHAIN}, r(node, path, weight, k) AS (SELECT 'n0', ['n0'], 0.0::DOUBLE, 0 UNION ALL SELECT g.v, list_append(path, g.v), weight + w, k + 1 FROM r JOIN g ON g.u = r.node AND NOT list_contains(path, g.v) WHERE k < 6), f AS (SELECT path, weight / k AS mean FROM r WHERE k = 6 OR (k > 0 AND node NOT IN (SELECT u FROM g))) SELECT array_to_string(path, '>') AS path, round(mean, 9) AS mean FROM f ORDER BY mean DESC, path LIMIT 1")
def h26(spark: SparkSession, d: str) -> DataFrame:
    return network.widest_route(_chain(spark, d), "n0", 6).select(F.array_join("path", ">").alias("path"), F.round("mean", 9).alias("mean"))


@query("h8_remove_self_loops", "WITH e AS (SELECT DISTINCT l_suppkey % 50 AS u, l_partkey % 50 AS v FROM lineitem) SELECT u, v FROM e WHERE u <> v")
def h8(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("u"), (F.col("l_partkey") % 50).alias("v")).distinct().filter("u <> v")


@query("t10_nearest_nodes", f"WITH {SAM}, a AS (SELECT scene - 1 AS scene, seq, x, y FROM sam), k AS (SELECT a.scene, a.seq, s.seq AS other, pow(a.x - s.x, 2) + pow(a.y - s.y, 2) AS d2, row_number() OVER (PARTITION BY a.scene, a.seq ORDER BY pow(a.x - s.x, 2) + pow(a.y - s.y, 2), s.seq) AS nr FROM a JOIN sam s ON s.scene = a.scene) SELECT scene, seq, other, round(sqrt(d2), 4) AS distance FROM k WHERE nr = 1 AND sqrt(d2) < 40000")
def t10(spark: SparkSession, d: str) -> DataFrame:
    s = views.samples(spark, d)
    near = paths.nearest_vertices(s.withColumn("scene", F.col("scene") - 1), s)
    return near.filter("distance < 40000").select("scene", "seq", F.col("pos").alias("other"), F.round("distance", 4).alias("distance"))


@query("t15_split_at_points", f"WITH {SAM}, m AS (SELECT scene, arg_min(seq, (abs(x - 600000), seq)) AS a, arg_min(seq, (abs(x - 1500000), seq)) AS b FROM sam GROUP BY scene) SELECT sam.scene, sam.seq, (CASE WHEN seq >= a THEN 1 ELSE 0 END + CASE WHEN seq >= b THEN 1 ELSE 0 END) AS segment FROM sam JOIN m USING (scene)")
def t15(spark: SparkSession, d: str) -> DataFrame:
    s = views.samples(spark, d)
    at = lambda x: F.min_by("seq", F.struct(F.abs(F.col("x") - x), "seq"))
    cuts = s.groupBy("scene").agg(at(600000.0).alias("a"), at(1500000.0).alias("b"))
    return s.join(cuts, "scene").select("scene", "seq", ((F.col("seq") >= F.col("a")).cast("int") + (F.col("seq") >= F.col("b")).cast("int")).alias("segment"))


@query("t18_common_extent", f"WITH {SAM}, n AS (SELECT scene, count(*) AS n FROM sam GROUP BY scene) SELECT sam.scene, arg_min(seq, (CASE WHEN seq < n // 2 THEN abs(x - 300000) END, seq)) FILTER (WHERE seq < n // 2) AS i0, arg_min(seq, (abs(x - 2200000), seq)) FILTER (WHERE seq >= n // 2) AS i1 FROM sam JOIN n USING (scene) GROUP BY sam.scene")
def t18(spark: SparkSession, d: str) -> DataFrame:
    s = views.samples(spark, d)
    s = s.join(s.groupBy("scene").agg(F.floor(F.count("*") / 2).alias("half")), "scene")
    at = lambda x, part: F.min_by(F.when(part, F.col("seq")), F.when(part, F.struct(F.abs(F.col("x") - x), "seq")))
    return s.groupBy("scene").agg(at(300000.0, F.col("seq") < F.col("half")).alias("i0"), at(2200000.0, F.col("seq") >= F.col("half")).alias("i1"))


@query("e6_unprocessed_scenes", f"WITH {SCE} SELECT scene, river FROM sce WHERE scene NOT IN (SELECT scene FROM sce WHERE acq < DATE '1998-01-01')")
def e6(spark: SparkSession, d: str) -> DataFrame:
    s = views.scenes(spark, d)
    return catalog.unprocessed(s, s.filter("acq < date'1998-01-01'")).select("scene", "river")


@query("k10_geojson", f"WITH {SAM} SELECT scene, '{{\"type\":\"Feature\",\"properties\":{{\"scene\":' || scene || '}},\"geometry\":{{\"type\":\"LineString\",\"coordinates\":[' || string_agg('[' || x || ',' || y || ']', ',' ORDER BY seq) || ']}}}}' AS feature FROM sam GROUP BY scene")
def k10(spark: SparkSession, d: str) -> DataFrame:
    return store.to_geojson(views.samples(spark, d))


@query("r12_skeleton_nodes", f"WITH {PIX}, w AS (SELECT r, c FROM pix WHERE b > 100), n AS (SELECT a.r, a.c, count(b.r) AS n FROM w a LEFT JOIN w b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND NOT (a.r = b.r AND a.c = b.c) GROUP BY a.r, a.c) SELECT r, c, n FROM n WHERE n <> 2")
def r12(spark: SparkSession, d: str) -> DataFrame:
    w = _pix(spark, d).filter("b > 100").select("row", "col")
    pairs = raster.neighbours(w, True)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    keyed = w.withColumn("k", F.shiftleft(F.col("row").cast("long"), 32) + F.col("col").cast("long"))
    return _rc(keyed.join(degree, "k", "left").select("row", "col", F.coalesce("n", F.lit(0)).alias("n")).filter("n <> 2"))


@query("n1_numbers_between", "WITH n AS (SELECT o_orderkey, round(o_custkey % 10 + 0.26, 1) AS a, o_custkey % 10 + 0.75 AS z FROM orders) SELECT o_orderkey, len(range((a * 10)::BIGINT, floor(z * 10)::BIGINT + 1)) AS n, a::DOUBLE AS first, round(floor(z * 10) / 10, 1)::DOUBLE AS last FROM n")
def n1(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("o_custkey") % 10).cast("double")
    n = views.table(spark, d, "orders").select("o_orderkey", S.numbers_between(k + 0.26, k + 0.75, 1).alias("x"))
    return n.select("o_orderkey", F.size("x").alias("n"), F.element_at("x", 1).alias("first"), F.element_at("x", -1).alias("last"))
