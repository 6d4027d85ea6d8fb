"""Queries on belts, banks, mouths and directions, and on whole scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meandra.batch import best_scenes
from meandra.operators import belts, mapping, paths, polygons, prediction, raster, shapes
from meandra.plans.lines import _ALONG, _path
from meandra.plans.queries import CURV, PIX, RECT, RID, SAM, _pix, _rc, _rects, query
from meandra.plans.reaches import _river
from meandra.plans.wider import _EMB, _edges
from meandra.sources import views


@query("k5_bilinear", f"WITH {PIX}, e AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM pix), o AS (SELECT i, j, (i + 0.5) / 0.4::DOUBLE - 0.5 AS y, (j + 0.5) / 0.4::DOUBLE - 0.5 AS x, h, w FROM e, (SELECT unnest(range(10000)) AS i) a, (SELECT unnest(range(100)) AS j) b WHERE i < floor(h * 0.4::DOUBLE) AND j < floor(w * 0.4::DOUBLE)), q AS (SELECT i, j, greatest(0, least(h - 1, floor(y) + a)) AS r, greatest(0, least(w - 1, floor(x) + b)) AS c, abs(1 - a - (y - floor(y))) * abs(1 - b - (x - floor(x))) AS k FROM o, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b)) SELECT i AS r, j AS c, round(sum(k * b), 6) + 0.0 AS b FROM q JOIN pix ON pix.r = q.r AND pix.c = q.c GROUP BY i, j")
def k5_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return _rc(raster.bilinear(_pix(spark, d), 0.4).select("row", "col", (F.round("b", 6) + F.lit(0.0)).alias("b")))


@query("b1_painted_banks", f"WITH {PIX}, v AS (SELECT r // 100 AS id, r, c, ((r + c) % 7) / 2.0::DOUBLE AS w FROM pix WHERE b > 220) SELECT DISTINCT v.id, v.r + i AS r, v.c + j AS c FROM v, (SELECT unnest(range(-4, 5)) AS i) a, (SELECT unnest(range(-4, 5)) AS j) b WHERE i * i + j * j <= w * w")
def b1_painted(spark: SparkSession, d: str) -> DataFrame:
    v = _pix(spark, d).filter("b > 220").select(F.floor(F.col("row") / 100).alias("id"), "row", "col", (((F.col("row") + F.col("col")) % 7) / F.lit(2.0)).alias("w"))
    return _rc(belts.painted(v))


@query("g16_ranked_contours", f"WITH {SAM}, k AS (SELECT scene % 20 AS id, scene AS contour, count(*) AS length, round(avg(y), 3) AS irregularity FROM sam GROUP BY scene), s AS (SELECT *, round(0.6 * coalesce((length - min(length) OVER p) / nullif(max(length) OVER p - min(length) OVER p, 0), 0) + 0.4 * coalesce((irregularity - min(irregularity) OVER p) / nullif(max(irregularity) OVER p - min(irregularity) OVER p, 0), 0), 9) AS score FROM k WINDOW p AS (PARTITION BY id)), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, contour) AS nr FROM s) SELECT id, contour, score FROM n WHERE nr = 1")
def g16_ranked(spark: SparkSession, d: str) -> DataFrame:
    k = views.samples(spark, d).groupBy(F.col("scene").alias("contour")).agg(F.count("*").alias("length"), F.round(F.avg("y"), 3).alias("irregularity"))
    return belts.ranked_contours(k.withColumn("id", F.col("contour") % 20))


@query("b1_best_bank_contours")
def b1_best(spark: SparkSession, d: str) -> DataFrame:
    v = _pix(spark, d).filter("b > 200").select(F.floor(F.col("row") / 50).alias("id"), "row", "col", ((F.col("row") % 3) + 1).cast("double").alias("w"))
    return belts.ranked_contours(belts.bank_contours(belts.painted(v)))


_LINE = "ln AS (SELECT i AS seq, i * 4 AS vr, 30 + (i * 7) % 9 AS vc FROM (SELECT unnest(range(5000)) AS i) WHERE i * 4 <= (SELECT max(r) FROM pix)), vx AS (SELECT seq, vr, vc, coalesce(lead(vr) OVER w, vr) - coalesce(lag(vr) OVER w, vr) AS dr, coalesce(lead(vc) OVER w, vc) - coalesce(lag(vc) OVER w, vc) AS dc FROM ln WINDOW w AS (ORDER BY seq))"


@query("h14_channel_belt", f"WITH {PIX}, {_LINE}, m AS (SELECT pix.r, pix.c, arg_min(dc * (vr - r) + dr * (c - vc), (pow(r - vr, 2) + pow(c - vc, 2), seq)) AS x FROM pix JOIN vx ON vr BETWEEN r - 12 AND r + 12 AND pow(r - vr, 2) + pow(c - vc, 2) <= 144 WHERE NOT (b > 200) GROUP BY pix.r, pix.c) SELECT r, c, sign(x)::INTEGER AS side FROM m")
def h14(spark: SparkSession, d: str) -> DataFrame:
    cells = _pix(spark, d)
    i = F.col("row")
    line = cells.filter("col = 0 and row % 4 = 0").select((i / 4).cast("long").alias("seq"), "row", (30 + (i / 4 * 7) % 9).cast("long").alias("col"))
    return _rc(belts.belt(cells, line, 12.0, cells.filter("b > 200")))


@query("h15_utm_polygons", f"WITH {RECT}, {RID}, o AS (SELECT *, id - grp * 1000000 - 1 AS node FROM rid), v AS (SELECT *, unnest([0, 1, 2, 3]) AS seq FROM o), p AS (SELECT grp, node, seq, CASE WHEN seq IN (0, 3) THEN x0 ELSE x1 END AS x, CASE WHEN seq < 2 THEN y0 ELSE y1 END AS y FROM v) SELECT grp AS scene, node, seq, 500000 + 30.0::DOUBLE * CASE WHEN node < 2 THEN greatest(0, least(20, x)) ELSE x END AS x, 4000000 - 30.0::DOUBLE * CASE WHEN node < 2 THEN greatest(0, least(8, y)) ELSE y END AS y FROM p")
def h15(spark: SparkSession, d: str) -> DataFrame:
    n = _rects(spark, d).withColumn("node", F.col("id") - F.col("grp") * 1000000 - 1)
    rings = polygons.rings_of(n).join(n.select("id", F.col("grp").alias("scene"), "node"), "id")
    return polygons.utm_rings(rings, 20.0, 8.0, 500000.0, 4000000.0, 30.0, -30.0).select("scene", "node", "seq", "x", "y")


@query("g28_mouth", f"WITH {PIX} SELECT r, c FROM pix WHERE c > 44 + (r // 50) % 3 AND NOT EXISTS (SELECT 1 FROM (VALUES (-2), (-1), (0), (1), (2)) t(k) WHERE r + k BETWEEN 0 AND (SELECT max(r) FROM pix) AND k * k + pow(c - (44 + ((r + k) // 50) % 3), 2) <= 2.25)")
def g28(spark: SparkSession, d: str) -> DataFrame:
    cells = _pix(spark, d)
    coast = cells.filter("col = 0").select("row", (44 + F.floor(F.col("row") / 50) % 3).alias("col"))
    return _rc(belts.mouth(cells, coast, 1.5))


@query("h9_moved_vertices", f"WITH {_EMB}, q AS (SELECT vec_id, s, t, list_transform(xs, lambda v: round(v, 1)) AS xs, list_transform(ys, lambda v: round(v, 1)) AS ys FROM edge), e AS (SELECT vec_id AS edge, 0 AS \"end\", s AS node, xs[1] AS x1, ys[1] AS y1, xs[2] AS x2, ys[2] AS y2, xs[3] AS x3, ys[3] AS y3 FROM q UNION ALL SELECT vec_id, 1, t, xs[16], ys[16], xs[15], ys[15], xs[14], ys[14] FROM q), f AS (SELECT node, x2, y2, min(edge) AS least FROM e GROUP BY node, x2, y2 HAVING count(DISTINCT edge) > 1), m AS (SELECT e.*, greatest(0, least(1, coalesce(((x2 - x1) * (x3 - x1) + (y2 - y1) * (y3 - y1)) / nullif(pow(x3 - x1, 2) + pow(y3 - y1, 2), 0), 0))) AS k FROM e JOIN f USING (node, x2, y2) WHERE edge > least) SELECT edge, \"end\", round(x1 + k * (x3 - x1), 6) + 0.0 AS x, round(y1 + k * (y3 - y1), 6) + 0.0 AS y FROM m")
def h9(spark: SparkSession, d: str) -> DataFrame:
    tenth = lambda c: F.transform(c, lambda v: F.round(v, 1))
    e = _edges(spark, d).select("edge", "s", "t", tenth("xs").alias("xs"), tenth("ys").alias("ys"))
    return belts.without_superposition(e).select("edge", "end", (F.round("x", 6) + F.lit(0.0)).alias("x"), (F.round("y", 6) + F.lit(0.0)).alias("y"))


@query("h23_truncated_edges", f"WITH {_EMB}, g AS (SELECT vec_id, xs[1] AS ax, ys[1] AS ay, xs[16] AS bx, ys[16] AS bz FROM edge), k AS (SELECT *, ax < 0 AS ina, bx < 0 AS inb, -ax / (bx - ax) AS m FROM g) SELECT vec_id AS edge, round(CASE WHEN ina THEN 0 ELSE ax END, 9) + 0.0 AS x0, round(CASE WHEN inb THEN 0 ELSE bx END, 9) + 0.0 AS x1, round(CASE WHEN ina THEN ay + m * (bz - ay) ELSE ay END, 9) + 0.0 AS y0, ina AS cut_start, inb AS cut_end FROM k WHERE NOT (ina AND inb)")
def h23(spark: SparkSession, d: str) -> DataFrame:
    ends = lambda c: F.array(F.element_at(c, 1), F.element_at(c, -1))
    e = _edges(spark, d).select("edge", "s", "t", ends("xs").alias("xs"), ends("ys").alias("ys"))
    kept = belts.truncated(e, [(0.0, -50.0), (0.0, 50.0), (-50.0, 50.0), (-50.0, -50.0)])
    at = lambda c, k: F.round(F.element_at(c, k), 9) + F.lit(0.0)
    return kept.select("edge", at("xs", 1).alias("x0"), at("xs", -1).alias("x1"), at("ys", 1).alias("y0"), F.col("s").contains(":").alias("cut_start"), F.col("t").contains(":").alias("cut_end"))


@query("h20_directed_edges")
def h20(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).withColumn("scene", F.floor(F.col("edge") / 50))
    faces = e.select("scene", F.explode(F.array(F.col("s") % 8, F.col("t") % 8)).alias("face"), "edge")
    nr = F.row_number().over(Window.partitionBy("scene").orderBy("edge", "k"))
    banks = e.filter("edge % 50 < 2").select("scene", "edge", F.posexplode(F.arrays_zip("xs", "ys")).alias("k", "p")).select("scene", (F.col("edge") % 2).alias("bank"), nr.alias("seq"), F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))
    return belts.directed(e.select("scene", "edge", "s", "t", "xs", "ys"), faces, banks, True)


@query("g19_centroids", f"WITH {SAM}, p AS (SELECT scene, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM sam WINDOW w AS (PARTITION BY scene ORDER BY seq)), a AS (SELECT scene, sum(x * ny - nx * y) AS a, sum((x + nx) * (x * ny - nx * y)) AS sx, sum((y + ny) * (x * ny - nx * y)) AS sy FROM p GROUP BY scene) SELECT scene, round(sx / (3 * a), 2) AS x, round(sy / (3 * a), 4) AS y FROM a WHERE a <> 0")
def g19_centroids(spark: SparkSession, d: str) -> DataFrame:
    return paths.centroids(views.samples(spark, d)).select("scene", F.round("x", 2).alias("x"), F.round("y", 4).alias("y"))


@query("e6_best_scenes_to_map", "WITH s AS (SELECT o_orderkey AS scene, o_orderdate::DATE AS acq, (o_totalprice / 1000)::DOUBLE AS cloud FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY year(acq) ORDER BY cloud, scene) AS nr FROM s WHERE cloud < 30) SELECT scene, acq::VARCHAR AS acq, nr, 'LT05' AS collection FROM k WHERE nr <= 25")
def e6_best(spark: SparkSession, d: str) -> DataFrame:
    s = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("scene"), F.col("o_orderdate").cast("date").alias("acq"), (F.col("o_totalprice") / 1000).cast("double").alias("cloud"))
    return best_scenes(s, 30.0, 25).select("scene", F.col("acq").cast("string").alias("acq"), "nr", "collection")


@query("h12_smooth_centerlines")
def h12(spark: SparkSession, d: str) -> DataFrame:
    r = _river(spark, d)
    return mapping.smooth_centerlines(r.cells, r.ends)


@query("e8_waves_of_river")
def e8(spark: SparkSession, d: str) -> DataFrame:
    return _river(spark, d).waves(1.0)


@query("e4_mask_of_bands")
def e4(spark: SparkSession, d: str) -> DataFrame:
    from meandra.river import River

    p = _pix(spark, d)
    bands = p.select(F.floor(F.col("row") / 64).alias("scene"), (F.col("row") % 64).alias("row"), "col", (F.col("b") + 600).alias("green"), F.lit(200).alias("swir"))
    return _rc(River.create_mndwi(bands, _river(spark, d).ends, 0.579, 6).cells)


_SPLIT = "pl AS (SELECT label AS scene, p AS place, (p - 1) * 0.12::DOUBLE AS px, (label % 3 - 1) * 0.1::DOUBLE AS py FROM (SELECT DISTINCT label FROM embeddings), (VALUES (0), (1), (2)) t(p)), vv AS (SELECT scene, pos, lb.vec_id AS edge, k, x, y, row_number() OVER (PARTITION BY scene ORDER BY pos, k) - 1 AS seq FROM vx JOIN lb USING (vec_id)), la AS (SELECT scene, max(seq) AS last FROM vv GROUP BY scene), ct AS (SELECT DISTINCT scene, seq FROM (SELECT vv.scene, place, arg_min(seq, (pow(x - px, 2) + pow(y - py, 2), seq)) AS seq FROM vv JOIN pl ON pl.scene = vv.scene GROUP BY vv.scene, place) JOIN la USING (scene) WHERE seq > 0 AND seq < last), sg AS (SELECT vv.*, ct.seq IS NOT NULL AS cut, sum((ct.seq IS NOT NULL)::INT) OVER (PARTITION BY vv.scene ORDER BY vv.seq ROWS UNBOUNDED PRECEDING) AS segment FROM vv LEFT JOIN ct ON ct.scene = vv.scene AND ct.seq = vv.seq), al2 AS (SELECT scene, pos, edge, k, x, y, segment FROM sg UNION ALL SELECT scene, pos, edge, k, x, y, segment - 1 FROM sg WHERE cut)"


@query("t15_split_edges", f"WITH {_ALONG}, {_SPLIT} SELECT scene, segment::BIGINT AS segment, pos, edge, count(*) AS n, arg_min(x, k) AS x0, arg_max(y, k) AS y1 FROM al2 GROUP BY scene, segment, pos, edge HAVING count(*) > 1")
def t15_edges(spark: SparkSession, d: str) -> DataFrame:
    labels = views.table(spark, d, "embeddings").select(F.col("label").alias("scene")).distinct()
    places = labels.select("scene", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("place"))
    places = places.select("scene", "place", ((F.col("place") - 1) * F.lit(0.12)).alias("px"), ((F.col("scene") % 3 - 1) * F.lit(0.1)).alias("py"))
    s = shapes.split_path(_edges(spark, d), _path(spark, d), places)
    return s.select("scene", "segment", "pos", "edge", F.size("xs").cast("long").alias("n"), F.element_at("xs", 1).alias("x0"), F.element_at("ys", -1).alias("y1"))


@query("p1_predicted_migration", f"WITH {CURV}, z AS (SELECT scene, seq, x / 1000 AS s, coalesce(curvature, 0) * 1000 AS r FROM k), m AS (SELECT a.scene, a.seq, any_value(a.r) AS r, sum(b.r * exp(-0.002::DOUBLE * (a.s - b.s))) / sum(exp(-0.002::DOUBLE * (a.s - b.s))) AS m FROM z a JOIN z b ON a.scene = b.scene AND b.seq <= a.seq GROUP BY a.scene, a.seq) SELECT scene, seq, round(-r + 2.5 * m, 9) + 0.0 AS predicted FROM m")
def p1(spark: SparkSession, d: str) -> DataFrame:
    c = paths.curvature(views.samples(spark, d))
    p = c.select("scene", "seq", (F.col("x") / 1000).alias("s"), prediction.nominal_rate(F.coalesce("curvature", F.lit(0.0)), F.lit(1000.0), 1.0).alias("nominal"))
    return prediction.predicted_rate(p, 0.002).select("scene", "seq", (F.round("predicted", 9) + F.lit(0.0)).alias("predicted"))


@query("g27_smooth_banks")
def g27(spark: SparkSession, d: str) -> DataFrame:
    return paths.smooth_rings(views.samples(spark, d).withColumn("y", F.col("y") * 5000))


@query("r18_equalised_bands")
def r18_clahe(spark: SparkSession, d: str) -> DataFrame:
    cells = raster.stretched(_pix(spark, d).withColumn("scene", F.floor(F.col("row") / 64)), "b")
    return _rc(raster.equalised(cells, F.col("v") / 255).select("scene", "row", "col", "shade"))
