"""Queries on sources, sinks and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meandra.operators import polygons, raster, shapes
from meandra.plans.more import COVER, SHAPES, _cover
from meandra.plans.queries import PIX, _pix, _rc, _rects, query
from meandra.sources import scenes, store, views

_NAMES = "n AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'LC08' WHEN o_orderkey % 3 = 1 THEN 'LC09' ELSE 'LT05' END || '_' || strftime(o_orderdate, '%Y%m%d') || CASE WHEN o_orderkey % 2 = 0 THEN '.TIF' ELSE '' END AS name FROM orders), t AS (SELECT name, name[1:4] IN ('LC08', 'LC09') AS new FROM n), b AS (SELECT name, 'green' AS band, CASE WHEN new THEN 3 ELSE 2 END AS nr FROM t UNION ALL SELECT name, 'swir', CASE WHEN new THEN 6 ELSE 5 END FROM t)"


@query("s1_band_paths", f"WITH {_NAMES} SELECT name, band, CASE WHEN right(name, 4) = '.TIF' THEN name ELSE name || '/' || name || '_B' || nr || '.TIF' END AS path, CASE WHEN right(name, 4) = '.TIF' THEN nr ELSE 1 END AS index FROM b")
def s1(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 3 == 0, "LC08").when(k % 3 == 1, "LC09").otherwise("LT05"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd"), F.when(k % 2 == 0, ".TIF").otherwise(""))
    return scenes.band_paths(views.table(spark, d, "orders").select(name.alias("name")).distinct())


@query("s3_water_index", f"WITH {PIX} SELECT r, c, CASE WHEN r % 2 = 0 THEN CASE WHEN b / 1000.0::DOUBLE > 0.1 THEN 1.0::DOUBLE ELSE 0 END ELSE b / 1000.0::DOUBLE END AS water FROM pix")
def s3(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("row") % 2 == 0, "mndwi").otherwise("ddwi")
    return _rc(scenes.water_index(_pix(spark, d), F.col("b") / F.lit(1000.0), kind, 0.1).select("row", "col", "water"))


_CAT = "cat AS (SELECT o_orderkey AS scene, o_custkey % 40 AS path, o_orderkey % 7 AS row, o_orderdate::DATE AS acq, (o_custkey % 40) * 9.0::DOUBLE - 179.5 AS lon, (o_orderkey % 7) * 20.0::DOUBLE - 70 AS lat FROM orders)"


def _cat(spark: SparkSession, d: str) -> DataFrame:
    path, row = F.col("o_custkey") % 40, F.col("o_orderkey") % 7
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("scene"), path.alias("path"), row.alias("row"), F.col("o_orderdate").cast("date").alias("acq"), (path * F.lit(9.0) - 179.5).alias("lon"), (row * F.lit(20.0) - 70).alias("lat"))


@query("s7_scene_crs", f"WITH {_CAT}, k AS (SELECT *, row_number() OVER (PARTITION BY path, row ORDER BY acq, scene) AS nr FROM cat WHERE year(acq) = 1997) SELECT path, row, scene, CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + floor((lon + 180) / 6)::INTEGER % 60 + 1 AS epsg FROM k WHERE nr = 1")
def s7(spark: SparkSession, d: str) -> DataFrame:
    return scenes.crs_of(_cat(spark, d), 1997)


@query("s11_georeference", f"WITH {PIX} SELECT r // 50 AS scene, 'EPSG:32620' AS crs, max(r % 50) + 1 AS nrows, max(c) + 1 AS ncols, 500000.0::DOUBLE AS \"left\", 4000000.0::DOUBLE AS upper, 500000 + (max(c) + 1) * 30.0::DOUBLE AS \"right\", 4000000 - (max(r % 50) + 1) * 30.0::DOUBLE AS lower FROM pix GROUP BY 1")
def s11(spark: SparkSession, d: str) -> DataFrame:
    cells = _pix(spark, d).select(F.floor(F.col("row") / 50).alias("scene"), (F.col("row") % 50).alias("row"), "col")
    return scenes.georeference(cells, "EPSG:32620", 500000.0, 4000000.0, 30.0, -30.0)


@query("s12_first_shapes", f"WITH {SHAPES}, f AS (SELECT * FROM rid WHERE id IN (SELECT min(id) FROM rid GROUP BY grp)), v AS (SELECT grp, id, 0 AS seq, x0 AS x, y0 AS y FROM f UNION ALL SELECT grp, id, 1, x1, y0 FROM f UNION ALL SELECT grp, id, 2, x1, y1 FROM f UNION ALL SELECT grp, id, 3, x0, y1 FROM f) SELECT grp AS file, id, seq, x::DOUBLE AS x, y::DOUBLE AS y FROM v")
def s12(spark: SparkSession, d: str) -> DataFrame:
    r = _rects(spark, d)
    rings = polygons.rings_of(r).join(r.select("id", F.col("grp").alias("file")), "id")
    twice = rings.withColumn("seq", F.col("seq") * 2).unionByName(rings.withColumn("seq", F.col("seq") * 2 + 1))  # each vertex twice
    return scenes.first_shapes(twice).withColumn("seq", F.floor(F.col("seq") / 2).cast("int"))


@query("s13_find_scene", f"WITH {_CAT} SELECT scene, path, row, acq::VARCHAR AS acq FROM cat WHERE scene = 7 LIMIT 1")
def s13(spark: SparkSession, d: str) -> DataFrame:
    return scenes.find(_cat(spark, d), 7).select("scene", "path", "row", F.col("acq").cast("string").alias("acq"))


@query("s14_footprints_of_points", f"WITH {SHAPES}, p AS (SELECT DISTINCT o_custkey AS point, (o_custkey * 7 % 190) + 0.25 AS x, (o_custkey % 11) + 0.5 AS y FROM orders) SELECT point, id AS shape FROM p JOIN rid ON x > x0 AND x < x1 AND y > y0 AND y < y1")
def s14(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "orders").select(F.col("o_custkey").alias("point")).distinct()
    p = p.select("point", (F.col("point") * 7 % 190 + 0.25).cast("double").alias("x"), (F.col("point") % 11 + 0.5).cast("double").alias("y"))
    xs = F.array(*(F.col(c).cast("double") for c in ("x0", "x1", "x1", "x0")))
    ys = F.array(*(F.col(c).cast("double") for c in ("y0", "y0", "y1", "y1")))
    return scenes.footprints_of(p, _rects(spark, d).select(F.col("id").alias("shape"), xs.alias("xs"), ys.alias("ys")))


_FILES = "f AS (SELECT 'dir/' || CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '' END || strftime(ts, '%Y%m%d') || CASE WHEN event_id % 3 = 0 THEN '-' ELSE '_' END || strftime(ts, '%H%M%S') || '_' || (event_id % 100) || CASE WHEN event_id % 2 = 0 THEN '_' || user_id ELSE '' END || '.tif' AS path, user_id FROM events), m AS (SELECT *, path[5:] AS name, string_split(regexp_replace(path[5:], '\\.[^.]*$', ''), '_') AS parts FROM f), z AS (SELECT user_id, path, name, CASE WHEN name[1:2] = '20' AND length(name) > 8 THEN name[1:8] END AS day, CASE WHEN name[1:2] = '20' AND length(name) > 8 AND name[9:9] = '_' THEN name[10:15] END AS time, CASE WHEN len(parts) >= 4 THEN array_to_string(parts[1:4], '_') END AS item FROM m)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    path = F.concat(F.lit("dir/"), F.when(k % 5 == 0, "x").otherwise(""), F.date_format("ts", "yyyyMMdd"), F.when(k % 3 == 0, "-").otherwise("_"), F.date_format("ts", "HHmmss"), F.lit("_"), (k % 100).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("_"), F.col("user_id").cast("string"))).otherwise(""), F.lit(".tif"))
    return views.table(spark, d, "events").select(path.alias("path"), "user_id")


@query("s10_names_of_any_kind", f"WITH {_FILES} SELECT path, name, day, time, item FROM z")
def s10_names(spark: SparkSession, d: str) -> DataFrame:
    return scenes.planet_metadata(_files(spark, d).select("path"))


@query("s10_primary_day", f"WITH {_FILES} SELECT user_id, min(day) AS day, count(DISTINCT day) AS days FROM z GROUP BY user_id HAVING min(day) IS NOT NULL")
def s10_primary(spark: SparkSession, d: str) -> DataFrame:
    m = scenes.planet_metadata(_files(spark, d)).join(_files(spark, d), "path")
    return scenes.primary_day(m, "user_id").filter("days > 0")


@query("e7_files_to_do", f"WITH {_FILES} SELECT path, item FROM z WHERE item IS NOT NULL AND path NOT IN (SELECT path FROM z WHERE time < '060000')")
def e7(spark: SparkSession, d: str) -> DataFrame:
    m = scenes.planet_metadata(_files(spark, d).select("path"))
    return store.to_do(m, m.filter("time < '060000'"), "path").filter("item is not null").select("path", "item")


# ---- sinks ------------------------------------------------------------------------------------
_ORD = f"{SHAPES}, o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS node FROM rid)"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles as nodes of a scene: 0 and 1 are the outer banks, islands follow."""
    return _rects(spark, d).withColumn("node", F.col("id") - F.col("grp") * 1000000 - 1)


@query("k1_bank_tables", f"WITH {_ORD} SELECT grp AS scene, CASE node WHEN 0 THEN 'right_bank' WHEN 1 THEN 'left_bank' ELSE 'island' END AS kind, node, 4 AS vertices, CASE WHEN node >= 2 THEN ((x1 - x0) * (y1 - y0))::DOUBLE END AS area, CASE WHEN node >= 2 THEN 2.0::DOUBLE * (x1 - x0 + y1 - y0) END AS length FROM o")
def k1(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    rings = polygons.rings_of(n).join(n.select("id", F.col("grp").alias("scene"), "node"), "id")
    return store.bank_tables(rings)


_EMB = "emb AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), edge AS (SELECT vec_id, vec_id % 40 AS s, (vec_id * 7 + 3) % 40 AS t, e[1:16] AS xs, e[17:32] AS ys, list_transform(e[33:48], lambda v: abs(v)) AS h1, list_transform(e[49:64], lambda v: abs(v)) AS h2 FROM emb)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """(edge, s, t, xs, ys, h1, h2): edges with vertices and half widths from the vectors."""
    e = views.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    absolute = lambda a: F.transform(a, F.abs)
    return e.select(F.col("vec_id").alias("edge"), (F.col("vec_id") % 40).alias("s"), ((F.col("vec_id") * 7 + 3) % 40).alias("t"), F.slice("e", 1, 16).alias("xs"), F.slice("e", 17, 16).alias("ys"), absolute(F.slice("e", 33, 16)).alias("h1"), absolute(F.slice("e", 49, 16)).alias("h2"))


_LEN = "list_sum(list_transform(range(2, 17), lambda i: sqrt(pow(xs[i] - xs[i - 1], 2) + pow(ys[i] - ys[i - 1], 2))))"


@query("k3_edge_frame", f"WITH {_EMB} SELECT s AS source, t AS target, row_number() OVER (PARTITION BY s, t ORDER BY vec_id) - 1 AS key, round({_LEN}, 6) AS mm_len, round(list_sum(h1) / 16 + list_sum(h2) / 16, 6) AS width, round(h1[1] + h2[1], 6) AS first_width, round(h1[16] + h2[16], 6) AS last_width FROM edge")
def k3(spark: SparkSession, d: str) -> DataFrame:
    f = shapes.edge_frame(_edges(spark, d))
    at = lambda i: F.round(F.element_at("widths", i), 6)
    return f.select("source", "target", F.col("key").cast("long").alias("key"), F.round("mm_len", 6).alias("mm_len"), F.round("width", 6).alias("width"), at(1).alias("first_width"), at(-1).alias("last_width"))


@query("k3_node_frame", f"WITH {_EMB}, n AS (SELECT s AS node, xs[1] AS x, ys[1] AS y, vec_id, 0 AS side FROM edge UNION ALL SELECT t, xs[16], ys[16], vec_id, 1 FROM edge), k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY vec_id, side) AS nr FROM n) SELECT node, x, y FROM k WHERE nr = 1")
def k3_nodes(spark: SparkSession, d: str) -> DataFrame:
    return shapes.node_frame(_edges(spark, d))


@query("k2_frames_without_widths", f"WITH {_EMB}, n AS (SELECT s AS node FROM edge UNION SELECT t FROM edge) SELECT 'edge' AS frame, count(*) AS n, round(sum({_LEN}), 4) AS total FROM edge UNION ALL SELECT 'node', count(*), NULL FROM n")
def k2(spark: SparkSession, d: str) -> DataFrame:
    frames = store.frames(shapes.node_frame(_edges(spark, d)), shapes.edge_frame(_edges(spark, d)))
    edge = frames["edges"].agg(F.lit("edge").alias("frame"), F.count("*").alias("n"), F.round(F.sum("mm_len"), 4).alias("total"))
    return edge.unionByName(frames["nodes"].agg(F.lit("node").alias("frame"), F.count("*").alias("n"), F.lit(None).cast("double").alias("total")))


@query("k8_water_mask_of_river", f"WITH {_ORD}, {PIX}, lr AS (SELECT * FROM o WHERE node < 2), cv AS (SELECT DISTINCT c, unnest(range(y0 - 1, y1 + 1)) AS r FROM (SELECT *, unnest(range(x0 - 1, x1 + 1)) AS c FROM lr)) SELECT p.r, p.c, CASE WHEN cv.r IS NULL THEN 7 ELSE 9 END AS water FROM pix p LEFT JOIN cv ON p.r = cv.r AND p.c = cv.c")
def k8(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    land = polygons.covered(polygons.rings_of(n)).join(n.select("id", "node"), "id")
    return _rc(polygons.water_mask(_pix(spark, d), land, include_islands=False, buffer=1, fill=7, nodata=9))


# ---- rasters ----------------------------------------------------------------------------------
@query("r18_band_stretch", f"WITH {PIX}, q AS (SELECT r // 50 AS scene, quantile_cont(b, 0.02) AS lo, quantile_cont(b, 0.98) AS hi FROM pix GROUP BY 1) SELECT r, c, floor(255 * greatest(0, least(1, (b - lo) / (hi - lo))))::INTEGER AS v FROM pix JOIN q ON r // 50 = scene")
def r18(spark: SparkSession, d: str) -> DataFrame:
    cells = _pix(spark, d).withColumn("scene", F.floor(F.col("row") / 50))
    return _rc(raster.stretched(cells, "b").select("row", "col", "v"))


@query("r19_padded_crop", f"WITH {PIX}, x AS (SELECT floor(b / 50.0)::BIGINT AS id, max(r) AS r1, min(r) AS r0, max(c) AS c1, min(c) AS c0 FROM pix GROUP BY 1) SELECT id, count(*) AS cells, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, sum(b)::BIGINT AS total FROM pix JOIN (SELECT id, r0 AS a0, r1 AS a1, c0 AS e0, c1 AS e1 FROM x) ON r BETWEEN greatest(0, a0 - 5) AND a1 + 5 AND c BETWEEN greatest(0, e0 - 5) AND e1 + 5 GROUP BY id")
def r19(spark: SparkSession, d: str) -> DataFrame:
    boxes = _pix(spark, d).groupBy(F.floor(F.col("b") / F.lit(50.0)).alias("id")).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    p = raster.padded(_pix(spark, d), boxes, 5)
    return p.groupBy("id").agg(F.count("*").alias("cells"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.sum("b").cast("long").alias("total"))


_DT = f"{PIX}, w AS (SELECT r, c FROM pix WHERE b > 150), z AS (SELECT r, c FROM pix WHERE NOT b > 150), dt AS (SELECT w.r, w.c, min((w.r - z.r) * (w.r - z.r) + (w.c - z.c) * (w.c - z.c)) AS d2 FROM w, z GROUP BY w.r, w.c)"
_CROP = f"{PIX}, w AS (SELECT r, c FROM pix WHERE r BETWEEN 20 AND 59 AND b > 150), z AS (SELECT r, c FROM pix WHERE r BETWEEN 20 AND 59 AND NOT b > 150), dt AS (SELECT w.r, w.c, min((w.r - z.r) * (w.r - z.r) + (w.c - z.c) * (w.c - z.c)) AS d2 FROM w, z GROUP BY w.r, w.c)"


@query("b2_distance_in_crop", f"WITH {_CROP} SELECT r - 20 AS r, c, d2 FROM dt")
def b2(spark: SparkSession, d: str) -> DataFrame:
    crop = raster.crop(raster.water_mask(_pix(spark, d), F.col("b"), 150.0), 20, 0, 40, 64).select("row", "col", "water")
    return _rc(raster.squared_distance(crop))


@query("h13_faces", f"WITH RECURSIVE {PIX}, w AS (SELECT r, c, r * 4294967296 + c AS k FROM pix WHERE NOT b > -60), reach(a, k, r, c) AS (SELECT k, k, r, c FROM w UNION SELECT reach.a, w.k, w.r, w.c FROM reach JOIN w ON abs(w.r - reach.r) + abs(w.c - reach.c) = 1), l AS (SELECT r, c, min(a) AS face FROM reach GROUP BY r, c), o AS (SELECT DISTINCT face FROM l WHERE r = 0 OR c = 0 OR r = (SELECT max(r) FROM pix) OR c = 63) SELECT face, count(*) AS cells FROM l WHERE face NOT IN (SELECT face FROM o) GROUP BY face")
def h13(spark: SparkSession, d: str) -> DataFrame:
    cells = _pix(spark, d).withColumn("line", (F.col("b") > -60).cast("int"))
    return polygons.faces(cells.select("row", "col", "line")).groupBy("face").agg(F.count("*").alias("cells"))


# ---- graphs of labelled cells -----------------------------------------------------------------
_LAB = f"{PIX}, lab AS (SELECT r, c, floor(b / 100.0)::BIGINT AS label FROM pix)"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return _pix(spark, d).select("row", "col", F.floor(F.col("b") / F.lit(100.0)).alias("label"))


@query("h16_primal_nodes", f"WITH {_LAB}, q AS (SELECT r + dr AS r, c + dc AS c, label FROM lab, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(dr, dc)) SELECT r, c, count(DISTINCT label) AS faces FROM q GROUP BY r, c HAVING count(DISTINCT label) >= 3")
def h16(spark: SparkSession, d: str) -> DataFrame:
    return _rc(polygons.junctions(_labelled(spark, d)))


@query("h16_primal_edges", f"WITH {_LAB}, t AS (SELECT a.label AS x, b.label AS y, a.r, a.c FROM lab a JOIN lab b ON (a.r = b.r AND b.c = a.c + 1) OR (a.c = b.c AND b.r = a.r + 1)) SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS shared FROM t WHERE x <> y GROUP BY 1, 2 HAVING count(*) >= 20")
def h16_edges(spark: SparkSession, d: str) -> DataFrame:
    return polygons.rook_contiguity(_labelled(spark, d)).filter("shared >= 20")


@query("h18_rook_nodes", f"WITH {_LAB}, s AS (SELECT lab.label, lab.r + dr AS r, lab.c + dc AS c FROM lab, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS t(dr, dc)), m AS (SELECT s.label, n.label AS other FROM s LEFT JOIN lab n ON n.r = s.r AND n.c = s.c), a AS (SELECT label, count(*) AS area, avg(r) AS row, avg(c) AS col FROM lab GROUP BY label) SELECT a.label, any_value(area) AS area, round(any_value(row), 6) AS row, round(any_value(col), 6) AS col, count(*) FILTER (WHERE other IS NULL OR other <> m.label) AS perimeter, count(DISTINCT other) FILTER (WHERE other <> m.label) AS neighbours FROM a JOIN m ON a.label = m.label GROUP BY a.label")
def h18(spark: SparkSession, d: str) -> DataFrame:
    n = polygons.rook_nodes(_labelled(spark, d))
    return n.select("label", "area", F.round("row", 6).alias("row"), F.round("col", 6).alias("col"), "perimeter", "neighbours")


@query("g25_channel", f"WITH {SHAPES}, {COVER}, {PIX}, land AS (SELECT DISTINCT r, c FROM cov) SELECT p.r, p.c FROM pix p LEFT JOIN land l ON p.r = l.r AND p.c = l.c WHERE l.r IS NULL AND NOT (p.r BETWEEN 100 AND 160 AND p.c >= 30)")
def g25(spark: SparkSession, d: str) -> DataFrame:
    mouth = _pix(spark, d).filter("row between 100 and 160 and col >= 30")
    return _rc(polygons.channel(_pix(spark, d), _cover(spark, d), mouth))


