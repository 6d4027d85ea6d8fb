"""Queries on lines, networks with widths, and results over time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meandra.functions import kernels
from meandra.operators import graph, network, pairs, paths, polygons, raster, shapes, temporal
from meandra.plans.more import _CHAIN, _chain
from meandra.plans.queries import BANDS, DENSE, GRAD, ORACLES, PIX, RECT, RID, SAM, SCE, SPARSE, W, _bands, _pix, _rc, _rects, query
from meandra.plans.reaches import _POS
from meandra.plans.wider import _DT, _EMB, _edges
from meandra.sources import views

# ---- edges with widths ------------------------------------------------------------------------
#: Vertices of the edges of each label, one edge after the other.
_ALONG = f"{_EMB}, lb AS (SELECT vec_id, label AS scene, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings), vx AS (SELECT vec_id, k - 1 AS k, xs[k] AS x, ys[k] AS y, h1[k] + h2[k] AS w FROM edge, range(1, 17) AS t(k)), al AS (SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY pos, k) - 1 AS seq, x, y, w FROM vx JOIN lb USING (vec_id) WHERE pos = 0 OR k > 0)"


def _path(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    return views.table(spark, d, "embeddings").select(F.col("label").alias("scene"), (F.row_number().over(w) - 1).alias("pos"), F.col("vec_id").alias("edge"))


@query("b5_widths_of_edges_along_path", f"WITH {_ALONG}, sam AS (SELECT * FROM al), {GRAD} SELECT scene, seq, round(w, 6) AS w, round(sum(ds) OVER (PARTITION BY scene ORDER BY seq ROWS UNBOUNDED PRECEDING), 6) AS s FROM g2")
def b5_edges(spark: SparkSession, d: str) -> DataFrame:
    along = paths.steps(shapes.along_path(_edges(spark, d), _path(spark, d)))
    return along.select("scene", "seq", F.round("w", 6).alias("w"), F.round("s", 6).alias("s"))


@query("b6_all_widths", f"WITH {_EMB} SELECT vec_id AS edge, k - 1 AS seq, round(h1[k] + h2[k], 6) AS width FROM edge, range(1, 17) AS t(k)")
def b6(spark: SparkSession, d: str) -> DataFrame:
    return shapes.all_widths(_edges(spark, d)).select("edge", "seq", F.round("width", 6).alias("width"))


@query("b7_widths_in_metres", f"WITH {_ALONG}, sam AS (SELECT * FROM al), {GRAD}, z AS (SELECT scene, seq, w * 30 AS width, sum(ds) OVER (PARTITION BY scene ORDER BY seq ROWS UNBOUNDED PRECEDING) * 30 AS s FROM g2) SELECT scene, count(*) AS n, round(max(s), 4) AS length, round(avg(width), 6) AS mean_width FROM z GROUP BY scene")
def b7(spark: SparkSession, d: str) -> DataFrame:
    along = paths.steps(shapes.along_path(_edges(spark, d), _path(spark, d)))
    return along.groupBy("scene").agg(F.count("*").alias("n"), F.round(F.max("s") * 30, 4).alias("length"), F.round(F.avg(F.col("w") * 30), 6).alias("mean_width"))


@query("h10_extended_clines", f"WITH {_EMB}, nd AS (SELECT v AS node, (v * 3 % 17) / 10.0::DOUBLE - 0.8 AS x, (v * 5 % 13) / 10.0::DOUBLE - 0.6 AS y FROM range(40) AS t(v)), j AS (SELECT edge.*, a.x AS sx, a.y AS sy, b.x AS tx, b.y AS ty, pow(xs[1] - a.x, 2) + pow(ys[1] - a.y, 2) > pow(xs[16] - a.x, 2) + pow(ys[16] - a.y, 2) AS turn FROM edge JOIN nd a ON a.node = s JOIN nd b ON b.node = t) SELECT vec_id AS edge, s, t, 18 AS n, sx AS first_x, ty AS last_y, CASE WHEN turn THEN xs[16] ELSE xs[1] END AS second_x FROM j")
def h10(spark: SparkSession, d: str) -> DataFrame:
    e = shapes.extended_clines(_edges(spark, d), _nodes40(spark))
    return e.select("edge", "s", "t", F.size("xs").alias("n"), F.element_at("xs", 1).alias("first_x"), F.element_at("ys", -1).alias("last_y"), F.element_at("xs", 2).alias("second_x"))


def _nodes40(spark: SparkSession) -> DataFrame:
    v = F.col("id")
    return spark.range(40).select(v.alias("node"), ((v * 3 % 17) / F.lit(10.0) - 0.8).alias("x"), ((v * 5 % 13) / F.lit(10.0) - 0.6).alias("y"))


@query("h11_nearest_node", f"WITH {SPARSE}, n AS ({_POS}), k AS (SELECT n.node, pow(n.x - t.x, 2) + pow(n.y - t.y, 2) AS d2 FROM n, (SELECT x, y FROM n WHERE node = 's1') t WHERE n.node <> 's1') SELECT node, round(sqrt(d2), 9) AS distance FROM k ORDER BY d2, node LIMIT 1")
def h11(spark: SparkSession, d: str) -> DataFrame:
    return shapes.nearest_node(_placed(spark, d), "s1").select("node", F.round("distance", 9).alias("distance"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    e = views.edges(spark, d, True)
    i = F.expr("cast(substring(node, 2) as long) + if(startswith(node, 'p'), 11, 0)")
    n = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    return n.select("node", (i * 7 % 37).cast("double").alias("x"), (i * 5 % 23).cast("double").alias("y"))


@query("h25_end_nodes", f"WITH {SPARSE}, n AS ({_POS}), g AS (SELECT node FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e) GROUP BY node HAVING count(*) = 1), p(place, px, py) AS (VALUES ('start', 3.0::DOUBLE, 4.0::DOUBLE), ('end', 30.0::DOUBLE, 20.0::DOUBLE)) SELECT place, arg_min(node, (pow(x - px, 2) + pow(y - py, 2), node)) AS node FROM n SEMI JOIN g ON n.node = g.node, p GROUP BY place")
def h25(spark: SparkSession, d: str) -> DataFrame:
    e = views.edges(spark, d, True).select(F.col("u").alias("s"), F.col("v").alias("t"))
    places = spark.createDataFrame([("start", 3.0, 4.0), ("end", 30.0, 20.0)], "place string, px double, py double")
    return shapes.end_nodes(e, _placed(spark, d), places)


@query("h19_trimmed_edges", f"WITH {_EMB}, k AS (SELECT *, list_transform(range(1, 17), lambda i: pow(xs[i] - 0.1, 2) + pow(ys[i] + 0.05, 2)) AS dd FROM edge), m AS (SELECT *, list_position(dd, list_min(dd)) AS i FROM k) SELECT vec_id AS edge, CASE WHEN i = 1 THEN 16 ELSE 17 - i END AS n, CASE WHEN i = 1 THEN 0.1 ELSE xs[i] END AS x0, CASE WHEN i = 1 THEN -0.05 ELSE ys[i] END AS y0, CASE WHEN i = 16 THEN 16 ELSE i END AS n_end, CASE WHEN i = 16 THEN 0.1 ELSE xs[i] END AS x1 FROM m")
def h19(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    a = shapes.trimmed(e, F.lit(0.1), F.lit(-0.05)).select("edge", F.size("xs").alias("n"), F.element_at("xs", 1).alias("x0"), F.element_at("ys", 1).alias("y0"))
    b = shapes.trimmed(e, F.lit(0.1), F.lit(-0.05), False).select("edge", F.size("xs").alias("n_end"), F.element_at("xs", -1).alias("x1"))
    return a.join(b, "edge")


@query("b3_half_widths", f"WITH {_DT}, ec AS (SELECT r % 80 AS edge, row_number() OVER (PARTITION BY r % 80 ORDER BY r, c) - 1 AS seq, r, c FROM pix WHERE b > 120), bk AS (SELECT DISTINCT c % 9 AS node, r, c FROM pix WHERE b > 180), sh AS (SELECT edge, node FROM ec JOIN bk USING (r, c) GROUP BY edge, node HAVING count(*) > 2), dp AS (SELECT edge, count(*) AS n, round(sum(sqrt(coalesce(d2, 0))), 6) AS total, round(max(sqrt(coalesce(d2, 0))), 6) AS widest FROM ec LEFT JOIN dt USING (r, c) GROUP BY edge) SELECT edge, node, n, total, widest FROM sh JOIN dp USING (edge)")
def b3(spark: SparkSession, d: str) -> DataFrame:
    crop = _pix(spark, d)
    deep = raster.squared_distance(raster.water_mask(crop, F.col("b"), 150.0).select("row", "col", "water"))
    w = Window.partitionBy("edge").orderBy("row", "col")
    lines = crop.filter("b > 120").withColumn("edge", F.col("row") % 80).withColumn("seq", F.row_number().over(w) - 1)
    h = shapes.half_widths(lines.select("edge", "seq", "row", "col"), crop.filter("b > 180").select((F.col("col") % 9).alias("node"), "row", "col"), deep)
    return h.select("edge", "node", F.size("half_widths").alias("n"), F.round(F.aggregate("half_widths", F.lit(0.0), lambda a, b: a + b), 6).alias("total"), F.round(F.array_max("half_widths"), 6).alias("widest"))


@query("b8_banks_within_buffer", f"WITH {SAM}, big AS (SELECT scene, seq, x, y * 5000 AS y FROM sam), bk AS (SELECT scene - 1 AS scene, seq, x, y FROM big), nr AS (SELECT DISTINCT bk.scene, bk.seq, bk.x, bk.y FROM bk JOIN big l ON l.scene = bk.scene WHERE pow(bk.x - l.x, 2) + pow(bk.y - l.y, 2) <= 1e10), ru AS (SELECT *, seq - row_number() OVER (PARTITION BY scene ORDER BY seq) AS run FROM nr), be AS (SELECT scene, arg_max(run, (n, -run)) AS run FROM (SELECT scene, run, count(*) AS n FROM ru GROUP BY scene, run) GROUP BY scene) SELECT scene, seq, x, y FROM ru JOIN be USING (scene, run)")
def b8(spark: SparkSession, d: str) -> DataFrame:
    big = views.samples(spark, d).withColumn("y", F.col("y") * 5000)
    return shapes.within_buffer(big.withColumn("scene", F.col("scene") - 1), big, 100000.0)


@query("b13_nonzero_indices", f"WITH {SAM} SELECT scene, seq FROM sam WHERE floor(y)::BIGINT % 5 <> 0")
def b13(spark: SparkSession, d: str) -> DataFrame:
    return paths.where_true(views.samples(spark, d), F.floor("y") % 5).select("scene", "seq")


# ---- geometry ---------------------------------------------------------------------------------
@query("g6_separated_parts", f"WITH {RECT}, {RID}, v AS (SELECT grp, id, 0 AS seq, x0::DOUBLE AS x, y0::DOUBLE AS y FROM rid UNION ALL SELECT grp, id, 1, x1, y0 FROM rid UNION ALL SELECT grp, id, 2, x1, y1 FROM rid UNION ALL SELECT grp, id, 3, x0, y1 FROM rid UNION ALL SELECT grp, id, 4, 'nan'::DOUBLE, 'nan'::DOUBLE FROM rid) SELECT grp AS id, id AS part, seq, x, y FROM v")
def g6(spark: SparkSession, d: str) -> DataFrame:
    r = _rects(spark, d)
    rings = polygons.rings_of(r).withColumnRenamed("id", "part").join(r.select(F.col("id").alias("part"), F.col("grp").alias("id")), "part")
    return shapes.separated(rings)


@query("g10_extend_line_by_offset", f"WITH {SAM}, n AS (SELECT scene, max(seq) AS m FROM sam GROUP BY scene HAVING max(seq) >= 20) SELECT n.scene, round(a.x - (b.x - a.x) * 0.5, 6) AS x0, round(a.y - (b.y - a.y) * 0.5, 6) AS y0, round(p.x + (z.x - p.x) * 1.5, 6) AS x1, round(p.y + (z.y - p.y) * 1.5, 6) AS y1 FROM n JOIN sam a ON a.scene = n.scene AND a.seq = 0 JOIN sam b ON b.scene = n.scene AND b.seq = 10 JOIN sam p ON p.scene = n.scene AND p.seq = m - 9 JOIN sam z ON z.scene = n.scene AND z.seq = m")
def g10(spark: SparkSession, d: str) -> DataFrame:
    s = views.samples(spark, d)
    long = s.groupBy("scene").agg(F.max("seq").alias("m")).filter("m >= 20")
    return paths.extended(s.join(long, "scene", "left_semi"), 0.5, 10, 9).select("scene", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("g23_straighten_rings", f"WITH {SAM}, {GRAD}, sg AS (SELECT *, sum(ds) OVER (PARTITION BY scene ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM g2), ref AS (SELECT * FROM sg WHERE dx * dx + dy * dy > 0), p AS (SELECT scene - 1 AS scene, seq % 3 AS ring, seq, x, y FROM sam), k AS (SELECT p.scene, p.ring, p.seq, r.seq AS pos, r.s, ((p.y - r.y) * r.dx - (p.x - r.x) * r.dy) / sqrt(r.dx * r.dx + r.dy * r.dy) AS off, row_number() OVER (PARTITION BY p.scene, p.ring, p.seq ORDER BY pow(p.x - r.x, 2) + pow(p.y - r.y, 2), r.seq) AS nr FROM p JOIN ref r ON r.scene = p.scene) SELECT scene, ring, seq, pos, round(s, 3) AS s, round(off, 4) + 0.0 AS off FROM k WHERE nr = 1")
def g23(spark: SparkSession, d: str) -> DataFrame:
    s = views.samples(spark, d)
    p = s.withColumn("scene", F.col("scene") - 1).withColumn("ring", F.col("seq") % 3)
    out = shapes.straightened(p, paths.steps(s), "ring")
    return out.select("scene", "ring", "seq", "pos", F.round("s", 3).alias("s"), (F.round("off", 4) + F.lit(0.0)).alias("off"))


@query("g26_main_channel_banks", f"WITH {SAM}, c AS (SELECT scene, arg_min(seq, (pow(x - 300000, 2) + pow(y - 100, 2), seq)) AS i, arg_min(seq, (pow(x - 1800000, 2) + pow(y - 300, 2), seq)) AS j, count(*) AS n FROM sam GROUP BY scene), k AS (SELECT sam.scene, x, y, ((seq - i) % n + n) % n AS f, ((j - i) % n + n) % n AS span, n FROM sam JOIN c USING (scene)) SELECT scene, 0 AS bank, f AS k, x, y FROM k WHERE f <= span UNION ALL SELECT scene, 1, (n - f) % n, x, y FROM k WHERE f >= span OR f = 0")
def g26(spark: SparkSession, d: str) -> DataFrame:
    return shapes.split_ring(views.samples(spark, d), (300000.0, 100.0), (1800000.0, 300.0))


@query("g12_longer_arc")
def g12(spark: SparkSession, d: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("seq")[["x", "y"]].to_numpy()
        arc = kernels.longer_arc(p, len(p) // 5, 3 * len(p) // 5, 100.0, p[0])
        return pd.DataFrame({"scene": pdf["scene"].iloc[0], "seq": np.arange(len(arc)), "x": arc[:, 0], "y": arc[:, 1]})

    return views.samples(spark, d).groupBy("scene").applyInPandas(run, "scene long, seq long, x double, y double")


@query("b16_width_and_curvature")
def b16(spark: SparkSession, d: str) -> DataFrame:
    s = views.samples(spark, d).withColumn("width", F.col("y")).withColumn("y", F.col("y") * 5000)
    return paths.width_and_curvature(s, 50000.0, 1e10)


# ---- networks ---------------------------------------------------------------------------------
@query("h28_subpaths", f"WITH RECURSIVE {_CHAIN}, e AS (SELECT u, v FROM g WHERE w >= 6), so AS (SELECT DISTINCT u FROM e WHERE u NOT IN (SELECT v FROM e)), si AS (SELECT DISTINCT v FROM e WHERE v NOT IN (SELECT u FROM e)), r(start, node, path, k) AS (SELECT u, u, u, 0 FROM so UNION ALL SELECT r.start, e.v, path || '>' || e.v, k + 1 FROM r JOIN e ON e.u = r.node WHERE k < 70), z AS (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY k, path) AS nr FROM r WHERE node IN (SELECT v FROM si)) SELECT start, node AS \"end\", path, k AS edges FROM z WHERE nr = 1")
def h28(spark: SparkSession, d: str) -> DataFrame:
    s = network.subpaths(_chain(spark, d).filter("w >= 6").select("u", "v"))
    return s.select("start", "end", F.array_join("path", ">").alias("path"), "edges")


def _two(spark: SparkSession) -> DataFrame:
    """Two routes through a small net that part three times, with widths."""
    first, second = ["a", "b", "c", "d", "e", "f", "g", "h"], ["a", "b", "x", "d", "e", "y", "z", "g", "w", "h"]
    return spark.createDataFrame([(1, first, second), (2, second, first), (3, first, first)], "pair long, one array<string>, two array<string>")


@query("h30_splice_paths", "SELECT * FROM (VALUES (1, 'a>b>x>d>e>f>g>h'), (2, 'a>b>x>d>e>f>g>h'), (3, 'a>b>c>d>e>f>g>h')) AS t(pair, path)")
def h30_splice(spark: SparkSession, d: str) -> DataFrame:
    widths = {("b", "c"): 1.0, ("c", "d"): 1.0, ("b", "x"): 4.0, ("x", "d"): 2.0, ("e", "f"): 5.0, ("f", "g"): 5.0, ("e", "y"): 9.0, ("y", "z"): 1.0, ("z", "g"): 2.0, ("g", "h"): 3.0, ("g", "w"): 3.0, ("w", "h"): 3.0}
    e = spark.createDataFrame([(u, v, w) for (u, v), w in widths.items()], "u string, v string, width double")
    return network.spliced_paths(_two(spark), e).select(F.col("pair").cast("int").alias("pair"), F.array_join("path", ">").alias("path"))


@query("h31_splice_once", "SELECT * FROM (VALUES (1, 'a>b>c>d>e>f>g>h'), (2, 'a>b>c>d>e>f>g>h'), (3, 'a>b>c>d>e>f>g>h')) AS t(pair, path)")
def h31(spark: SparkSession, d: str) -> DataFrame:
    widths = {("b", "c"): 4.0, ("c", "d"): 4.0, ("e", "f"): 4.0, ("f", "g"): 4.0, ("d", "e"): 4.0, ("g", "h"): 4.0, ("b", "x"): 1.0, ("x", "d"): 1.0, ("e", "y"): 1.0, ("y", "z"): 1.0, ("z", "g"): 1.0, ("g", "w"): 1.0, ("w", "h"): 1.0, ("a", "b"): 2.0}
    e = spark.createDataFrame([(u, v, w) for (u, v), w in widths.items()], "u string, v string, width double")
    return network.spliced_once(_two(spark), e).select(F.col("pair").cast("int").alias("pair"), F.array_join("path", ">").alias("path"))


@query("h24_first_reaching_node", f"WITH RECURSIVE {_CHAIN}, e AS (SELECT u, v FROM g), s AS (SELECT u, v FROM e UNION SELECT v, u FROM e), dg AS (SELECT u AS node, count(*) AS n FROM s GROUP BY u), c AS (SELECT node FROM dg WHERE n < 6 UNION SELECT v FROM e WHERE v NOT IN (SELECT u FROM e)), r(a, n) AS (SELECT node, node FROM c UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.n) SELECT min(a) AS node FROM r WHERE n <> a AND n IN (SELECT node FROM c)")
def h24_reach(spark: SparkSession, d: str) -> DataFrame:
    return network.start_node(_chain(spark, d).select("u", "v"), 6)


@query("h35_exceedance_without_largest", f"WITH {DENSE}, g AS (SELECT u AS node, count(*) AS n FROM e GROUP BY u), k AS (SELECT *, row_number() OVER (ORDER BY n, node) AS nr, count(*) OVER () AS c FROM g) SELECT node, n, round(1 - nr / (c - 2)::DOUBLE, 9) AS exceedance FROM k WHERE nr <= c - 2")
def h35_less(spark: SparkSession, d: str) -> DataFrame:
    g = views.edges(spark, d).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"))
    return graph.exceedance(g, 2).select("node", "n", F.round("exceedance", 9).alias("exceedance"))


# ---- time -------------------------------------------------------------------------------------
_DATED = f"{PIX}, z AS (SELECT r // 50 AS t, r % 50 AS r, c, CASE WHEN b <= -120 THEN 0 WHEN b <= -40 THEN 2 END AS type FROM pix), aoi AS (SELECT r, c FROM z WHERE t = 0 AND r BETWEEN 3 AND 45 AND c BETWEEN 5 AND 50)"


def _dated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    kind = F.when(F.col("b") <= -120, 0).when(F.col("b") <= -40, 2)
    z = _pix(spark, d).select(F.floor(F.col("row") / 50).alias("t"), (F.col("row") % 50).alias("row"), "col", kind.alias("type"))
    return z, z.filter("t = 0 and row between 3 and 45 and col between 5 and 50").select("row", "col")


@query("t4_channel_and_bar_areas", f"WITH {_DATED}, d AS (SELECT DISTINCT t FROM z WHERE type IS NOT NULL), bk AS (SELECT t, count(*) AS n FROM z JOIN aoi USING (r, c) WHERE type < 2 GROUP BY t), br AS (SELECT t, count(*) AS n FROM z JOIN aoi USING (r, c) WHERE type = 2 GROUP BY t) SELECT t, (SELECT count(*) FROM aoi) - coalesce(bk.n, 0) AS belt, coalesce(br.n, 0) AS bars, (SELECT count(*) FROM aoi) - coalesce(bk.n, 0) - coalesce(br.n, 0) AS channel FROM d LEFT JOIN bk USING (t) LEFT JOIN br USING (t)")
def t4_areas(spark: SparkSession, d: str) -> DataFrame:
    z, aoi = _dated(spark, d)
    return temporal.channel_and_bars(z.filter("type is not null"), aoi, "t")


@query("t5_sets_over_dates", f"WITH {PIX}, w AS (SELECT r % 50 AS r, c, r // 50 AS t FROM pix WHERE b > 100), m AS (SELECT min(t) AS lo, max(t) AS hi FROM w), f AS (SELECT r, c, min(t) AS a, max(t) AS z FROM w GROUP BY r, c) SELECT 'bar' AS kind, z AS t, count(*) AS area FROM f, m WHERE z < hi GROUP BY z UNION ALL SELECT 'erosion', a - 1, count(*) FROM f, m WHERE a > lo GROUP BY a UNION ALL SELECT 'channel', t, count(*) FROM w GROUP BY t")
def t5_sets(spark: SparkSession, d: str) -> DataFrame:
    w = _pix(spark, d).filter("b > 100").select((F.col("row") % 50).alias("row"), "col", F.floor(F.col("row") / 50).alias("t"))
    return temporal.sets_over_dates(w, "t").groupBy("kind", "t").agg(F.count("*").alias("area"))


@query("t8_polygons_of_change", f"WITH RECURSIVE {BANDS}, k AS (SELECT r, c, r * 4294967296 + c AS key, CASE WHEN NOT b > 0 THEN 'erosion' ELSE 'deposition' END AS kind FROM bands WHERE (b > 0) <> (b2 > 0)), reach(a, key, r, c, kind) AS (SELECT key, key, r, c, kind FROM k UNION SELECT reach.a, k.key, k.r, k.c, k.kind FROM reach JOIN k ON k.kind = reach.kind AND abs(k.r - reach.r) + abs(k.c - reach.c) = 1), l AS (SELECT kind, r, c, min(a) AS polygon FROM reach GROUP BY kind, r, c), s AS (SELECT l.kind, l.polygon, count(*) FILTER (WHERE n.r IS NULL) AS length FROM l CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS t(dr, dc) LEFT JOIN l n ON n.kind = l.kind AND n.polygon = l.polygon AND n.r = l.r + dr AND n.c = l.c + dc GROUP BY l.kind, l.polygon) SELECT kind, polygon, count(*) AS area, any_value(length) AS length, '1999-05-01' AS start, '2001-05-01' AS \"end\", 731 AS duration FROM l JOIN s USING (kind, polygon) GROUP BY kind, polygon HAVING count(*) > 3")
def t8_polygons(spark: SparkSession, d: str) -> DataFrame:
    b = _bands(spark, d)
    change = raster.change(b.filter("b > 0"), b.filter("b2 > 0")).filter("kind <> 'channel'")
    dates = spark.sql("select date'1999-05-01' as start, date'2001-05-01' as end")
    out = temporal.change_polygons(change, dates, 3)
    return out.select("kind", "polygon", "area", "length", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "duration")


@query("t12_mappings", f"SELECT 'rook' AS kind, i::VARCHAR AS a, j::VARCHAR AS b, round(iou, 6) AS score FROM ({ORACLES['t9_best_match']}) UNION ALL SELECT 'node', scene || ':' || seq, scene || ':' || other, round(distance, 4) FROM ({ORACLES['t10_nearest_nodes']}) UNION ALL SELECT 'edge', i::VARCHAR, j::VARCHAR, round(share, 6) FROM ({ORACLES['t11_edge_similarity']})")
def t12(spark: SparkSession, d: str) -> DataFrame:
    from meandra.plans.queries import QUERIES

    rook, node, edge = (QUERIES[n](spark, d) for n in ("t9_best_match", "t10_nearest_nodes", "t11_edge_similarity"))
    name = lambda k: F.concat_ws(":", F.col("scene").cast("string"), F.col(k).cast("string"))
    node = node.select(name("seq").alias("a"), name("other").alias("b"), F.round("distance", 4).alias("score"))
    plain = lambda df, v: df.select(F.col("i").cast("string").alias("a"), F.col("j").cast("string").alias("b"), F.round(v, 6).alias("score"))
    return temporal.mappings(plain(rook, "iou"), node, plain(edge, "share"))


_STAGES = f"{SCE}, k AS (SELECT *, lead(acq) OVER w AS acq2, lead(width) OVER w AS width2, lead(scene) OVER w AS scene2 FROM sce WINDOW w AS (PARTITION BY river ORDER BY acq, scene)), q AS (SELECT river AS pair, row_number() OVER (PARTITION BY river ORDER BY acq, scene) - 1 AS seq, width AS width1, width2, (acq2 - acq)::DOUBLE AS rate, scene % 3 AS segment, (scene % 11 - 5)::DOUBLE AS lag, scene % 4 <> 0 AS stable FROM k WHERE scene2 IS NOT NULL)"
_SUMMARY = "SELECT pair, avg(lag) FILTER (WHERE stable) AS lag, quantile_cont(abs(rate), 0.9) AS p90, avg(width1) AS w1, avg(width2) AS w2, count(DISTINCT segment) FILTER (WHERE stable) AS n_stable, avg(CASE WHEN stable THEN 1.0::DOUBLE ELSE 0 END) AS ratio, covar_pop(width1, width2) AS cv, stddev_pop(width1) AS s1, stddev_pop(width2) AS s2, count(*) AS n, any_value(2.0::DOUBLE + pair % 3) AS gap FROM q GROUP BY pair"


@query("a34_summary_of_pairs", f"WITH {_STAGES}, s AS ({_SUMMARY}) SELECT pair, round(lag, 6) AS \"lag (m)\", round(p90, 6) AS \"p90_mr (m/year)\", round(w1, 9) AS width1, round(w2, 9) AS width2, round(w2 - w1, 9) AS \"width_diff (m)\", n_stable AS n_stable_segments, round(ratio, 9) AS stable_data_ratio, round((w1 + w2) / 2, 9) AS \"mean_width (m)\", round(lag / ((w1 + w2) / 2), 9) AS normalized_lag, round(p90 / ((w1 + w2) / 2), 9) AS \"normalized_mr (channel_widths/year)\", gap AS time_gap, round(CASE WHEN s1 > 0 AND s2 > 0 THEN pow(cv / (s1 * s2), 2) END, 6) AS r_squared_width, round(CASE WHEN s1 > 0 THEN cv / (s1 * s1) END, 6) AS width_slope FROM s")
def a34_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = pairs.summary(_pair_points(spark, d))
    rounded = {"lag (m)": 6, "p90_mr (m/year)": 6, "width1": 9, "width2": 9, "width_diff (m)": 9, "stable_data_ratio": 9, "mean_width (m)": 9, "normalized_lag": 9, "normalized_mr (channel_widths/year)": 9, "r_squared_width": 6, "width_slope": 6}
    return s.select("pair", "n_stable_segments", "time_gap", *(F.round(F.col(f"`{c}`"), k).alias(c) for c, k in rounded.items()))


def _pair_points(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("river").orderBy("acq", "scene")
    k = views.scenes(spark, d).withColumns({"acq2": F.lead("acq").over(w), "width2": F.lead("width").over(w), "seq": F.row_number().over(w) - 1}).filter("acq2 is not null")
    return k.select(F.col("river").alias("pair"), "seq", F.col("width").alias("width1"), "width2", F.datediff("acq2", "acq").cast("double").alias("rate"), (F.col("scene") % 3).alias("segment"), (F.col("scene") % 11 - 5).cast("double").alias("lag"), (F.col("scene") % 4 != 0).alias("stable"), (F.lit(2.0) + F.col("river") % 3).alias("time_gap"))


@query("t25_segment_groups", f"WITH {_STAGES}, s AS ({_SUMMARY}) SELECT pair, 'reach ' || (pair % 4) AS segment_label, pair % 4 AS segment_index, 'Mamore' AS river_name, round((w1 + w2) / 2, 9) AS \"mean_width (m)\" FROM s WHERE pair % 4 < 3")
def t25(spark: SparkSession, d: str) -> DataFrame:
    p = _pair_points(spark, d)
    groups = {f"reach {k}": pairs.summary(p.filter(F.col("pair") % 4 == k)) for k in range(3)}
    out = pairs.labelled(groups, "Mamore")
    return out.select("pair", "segment_label", "segment_index", "river_name", F.round(F.col("`mean_width (m)`"), 9).alias("mean_width (m)"))


@query("a38_lag_of_matches", f"WITH {SAM}, n AS (SELECT scene, count(*) AS n FROM sam GROUP BY scene), p AS (SELECT scene, seq AS p, seq * 7 // 10 + k AS q FROM sam, range(2) AS t(k) WHERE seq % 5 <> 4 AND k <= seq % 2), m AS (SELECT scene, p, avg(p - q) * 25.0 / 400 AS lag FROM p GROUP BY scene, p) SELECT sam.scene, sam.seq, coalesce(round(lag, 9), 'nan') AS lag FROM sam LEFT JOIN m ON m.scene = sam.scene AND m.p = sam.seq")
def a38_matches(spark: SparkSession, d: str) -> DataFrame:
    s = views.samples(spark, d)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("seq") % 2))
    path = s.filter("seq % 5 <> 4").select("scene", F.col("seq").alias("p"), k.alias("k")).select("scene", "p", (F.floor(F.col("p") * 7 / 10) + F.col("k")).alias("q"))
    return pairs.mean_lag(s, path, 25.0, 400.0).select("scene", "seq", F.round("lag", 9).alias("lag"))


@query("t24_segment_pairs")
def t24(spark: SparkSession, d: str) -> DataFrame:
    s = views.samples(spark, d).withColumn("y", F.col("y") * 5000)
    p = s.select("scene", "seq", "x", "y", F.lit(300.0).alias("width"), F.floor(F.col("seq") / 25).alias("segment"))
    catalog = p.select("scene").distinct().withColumn("acq", F.expr("date_add(date'2001-06-01', cast(scene * 200 as int))"))
    return pairs.segment_groups(p, catalog, 270, 1000, months=None).select("segment", "scene1", "scene2", "n", "p90_mr", "n_stable_segments")


