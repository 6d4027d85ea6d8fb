"""Queries on reaches, projections, islands, tributaries and pairs of centerlines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meandra.functions import kernels, projection
from meandra.operators import mapping, network, pairs, paths, polygons, raster, reaches
from meandra.plans.more import COVER, SHAPES, _chain, _cover
from meandra.plans.queries import PIX, SAM, SPARSE, _mask, _pix, _rc, query
from meandra.river import River
from meandra.sources import store, views


# ---- projection -------------------------------------------------------------------------------
_E2 = projection.E2
_EP2 = projection.EP2
_GEO = "geo AS (SELECT c_custkey AS id, c_nationkey * 14.0::DOUBLE - 178 + (c_custkey % 7) * 0.4 AS lon, (c_custkey % 160)::DOUBLE - 79.5 AS lat FROM customer), z AS (SELECT *, floor((lon + 180) / 6)::INTEGER % 60 + 1 AS zone FROM geo)"
_UTM = (
    f"{_GEO}, q AS (SELECT *, radians(lat) AS phi, 6378137.0::DOUBLE / sqrt(1 - {_E2!r}::DOUBLE * pow(sin(radians(lat)), 2)) AS n, pow(tan(radians(lat)), 2) AS t, {_EP2!r}::DOUBLE * pow(cos(radians(lat)), 2) AS c, radians(lon - (zone * 6 - 183)) * cos(radians(lat)) AS a FROM z), "
    f"m AS (SELECT *, 6378137.0::DOUBLE * ({1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256!r}::DOUBLE * phi - {3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024!r}::DOUBLE * sin(2 * phi) + {15 * _E2**2 / 256 + 45 * _E2**3 / 1024!r}::DOUBLE * sin(4 * phi) - {35 * _E2**3 / 3072!r}::DOUBLE * sin(6 * phi)) AS m FROM q)"
)


@query(
    "g2_k6_utm_forward",
    f"WITH {_UTM} SELECT id, zone, round(500000 + 0.9996::DOUBLE * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {_EP2!r}::DOUBLE) * a**5 / 120), 3) AS east, round(0.9996::DOUBLE * (m + n * tan(phi) * (a**2 / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {_EP2!r}::DOUBLE) * a**6 / 720)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS north FROM m",
)
def g2(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "customer")
    geo = c.select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") * F.lit(14.0) - 178 + (F.col("c_custkey") % 7) * F.lit(0.4)).alias("lon"), ((F.col("c_custkey") % 160).cast("double") - 79.5).alias("lat"))
    geo = geo.withColumn("zone", projection.utm_zone(F.col("lon")))
    east, north = projection.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    return geo.select("id", "zone", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


# ---- rasters ----------------------------------------------------------------------------------
@query("r4_burn_polygons", f"WITH {SHAPES}, {COVER}, {PIX}, l AS (SELECT DISTINCT r, c FROM cov) SELECT p.r, p.c, CASE WHEN l.r IS NOT NULL OR p.b > 150 THEN 1 ELSE 0 END AS water FROM pix p LEFT JOIN l ON p.r = l.r AND p.c = l.c")
def r4(spark: SparkSession, d: str) -> DataFrame:
    return _rc(polygons.burned(_mask(spark, d), _cover(spark, d)))


@query("r8_solidity")
def r8(spark: SparkSession, d: str) -> DataFrame:
    return raster.by_solidity(raster.label(_mask(spark, d, 100).filter("water = 1").select("row", "col")), 0.7)


@query("k11_svg_path", f"WITH {SAM} SELECT scene, 'M' || string_agg(floor(x / 1000)::BIGINT || ' ' || floor(y)::BIGINT, ' L' ORDER BY seq) || ' Z' AS path FROM sam GROUP BY scene")
def k11(spark: SparkSession, d: str) -> DataFrame:
    s = views.samples(spark, d).select("scene", "seq", F.floor(F.col("x") / 1000).alias("x"), F.floor("y").alias("y"))
    return store.to_svg(s)


# ---- paths over time --------------------------------------------------------------------------
#: y is stretched so that both axes are of one size.
BIG = f"{SAM}, big AS (SELECT scene, seq, x, y * 5000 AS y FROM sam), sg AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM big WINDOW w AS (PARTITION BY scene ORDER BY seq)), ln AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS part FROM sg WHERE nx IS NOT NULL), cu AS (SELECT *, sum(part) OVER (PARTITION BY scene ORDER BY seq ROWS UNBOUNDED PRECEDING) - part AS start, sum(part) OVER (PARTITION BY scene) AS total FROM ln)"


def _at(n: int) -> str:
    return f"pl AS (SELECT scene, k, total * k / {n - 1} AS t FROM (SELECT DISTINCT scene, total FROM cu), (SELECT unnest(range({n})) AS k)), rs AS (SELECT pl.scene, pl.k, cu.x + greatest(0, least(1, (t - start) / part)) * (nx - x) AS x, cu.y + greatest(0, least(1, (t - start) / part)) * (ny - y) AS y FROM pl ASOF JOIN cu ON pl.scene = cu.scene AND pl.t >= cu.start)"


def _big(spark: SparkSession, d: str) -> DataFrame:
    return views.samples(spark, d).withColumn("y", F.col("y") * 5000)


@query("t17_resampled", f"WITH {BIG}, {_at(100)} SELECT scene, k, round(x, 3) AS x, round(y, 3) AS y FROM rs")
def t17_resampled(spark: SparkSession, d: str) -> DataFrame:
    return reaches.resampled(_big(spark, d), 100).select("scene", "k", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(
    "t17_outlier_paths",
    f"WITH {BIG}, {_at(100)}, md AS (SELECT k, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM rs WHERE scene IN (SELECT scene FROM big GROUP BY scene HAVING count(*) > 10) GROUP BY k), dv AS (SELECT scene, sqrt(pow(x - mx, 2) + pow(y - my, 2)) AS d FROM rs JOIN md USING (k) WHERE scene IN (SELECT scene FROM big GROUP BY scene HAVING count(*) > 10)), ow AS (SELECT scene, avg(d) AS m, stddev_pop(d) AS s FROM dv GROUP BY scene), sh AS (SELECT scene, any_value(m) AS m, avg(CASE WHEN d < s THEN 1.0 ELSE 0.0 END) AS o FROM dv JOIN ow USING (scene) GROUP BY scene) SELECT scene, round(m, 2) AS deviation, round(o, 6) AS overlap FROM sh WHERE (SELECT count(*) FROM sh) < 3 OR (m <= (SELECT avg(m) + 2 * stddev_pop(m) FROM sh) AND o >= 0.3)",
)
def t17(spark: SparkSession, d: str) -> DataFrame:
    return reaches.drop_outliers(_big(spark, d)).select("scene", F.round("deviation", 2).alias("deviation"), F.round("overlap", 6).alias("overlap"))


@query(
    "t11_edge_similarity",
    f"WITH {BIG}, {_at(20)}, nr AS (SELECT DISTINCT cu.scene AS i, rs.scene AS j, rs.k FROM cu, rs WHERE pow(cu.x + greatest(0, least(1, ((rs.x - cu.x) * (nx - cu.x) + (rs.y - cu.y) * (ny - cu.y)) / (part * part))) * (nx - cu.x) - rs.x, 2) + pow(cu.y + greatest(0, least(1, ((rs.x - cu.x) * (nx - cu.x) + (rs.y - cu.y) * (ny - cu.y)) / (part * part))) * (ny - cu.y) - rs.y, 2) <= 1e10), sh AS (SELECT i, j, count(*) / 20.0::DOUBLE AS share FROM nr WHERE i <> j GROUP BY i, j), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY share DESC, j) AS nr FROM sh WHERE share > 0.5) SELECT i, j, round(share, 6) AS share FROM k WHERE nr = 1",
)
def t11(spark: SparkSession, d: str) -> DataFrame:
    s = _big(spark, d)
    return reaches.best_matches(s, s, 100000.0).select("i", "j", F.round("share", 6).alias("share"))


@query("t14_kept_confluences", f"WITH {SAM}, m AS (SELECT scene, floor(x / 20000)::BIGINT AS cluster, x, y FROM sam) SELECT cluster, count(DISTINCT scene) AS scenes, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(sqrt(pow(avg(x) - 0, 2) + pow(avg(y) - 0, 2)), 6) AS distance FROM m GROUP BY cluster HAVING count(DISTINCT scene) >= greatest(1, ceil((SELECT count(DISTINCT scene) FROM sam) * 0.3))")
def t14_kept(spark: SparkSession, d: str) -> DataFrame:
    m = views.samples(spark, d).select("scene", F.floor(F.col("x") / 20000).alias("cluster"), "x", "y")
    c = reaches.common_places(m, 0.3, 0.0, 0.0)
    return c.select("cluster", "scenes", *(F.round(v, 6).alias(v) for v in ("x", "y", "distance")))


@query("t16_reach_groups", "WITH s AS (SELECT o_custkey AS river, year(o_orderdate) AS k, max(o_totalprice) > 300000 AS near FROM orders GROUP BY 1, 2), n AS (SELECT river, k FROM s WHERE near), g AS (SELECT lag(k) OVER (PARTITION BY river ORDER BY k) AS up, k AS down FROM n UNION ALL SELECT max(k), NULL FROM n GROUP BY river) SELECT coalesce(up::VARCHAR, 'start') AS up, coalesce(down::VARCHAR, 'end') AS down, count(*) AS rivers FROM g GROUP BY 1, 2 HAVING count(*) >= 4")
def t16_groups(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("river"), F.year("o_orderdate").cast("long").alias("k"))
    g = reaches.reach_groups(o.agg((F.max("o_totalprice") > 300000).alias("near")))
    return g.select(F.coalesce(F.col("up").cast("string"), F.lit("start")).alias("up"), F.coalesce(F.col("down").cast("string"), F.lit("end")).alias("down"), "rivers")


_POS = "SELECT node, (id * 7 % 37)::DOUBLE AS x, (id * 5 % 23)::DOUBLE AS y, (id * 7 % 37 + id % 4)::DOUBLE AS lx, (id * 5 % 23 + id % 3)::DOUBLE AS ly FROM (SELECT node, node[2:]::BIGINT + CASE WHEN node[1] = 'p' THEN 11 ELSE 0 END AS id FROM (SELECT u AS node FROM e UNION SELECT v FROM e))"


@query("t13_node_deviation", f"WITH {SPARSE}, n AS ({_POS}), m AS (SELECT a.node, avg((b.x - a.x) / nullif(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 0)) AS mx, avg((b.y - a.y) / nullif(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)), 0)) AS my FROM e JOIN n a ON a.node = e.u JOIN n b ON b.node = e.v GROUP BY a.node), k AS (SELECT n.*, mx, my, sqrt(pow(lx - x, 2) + pow(ly - y, 2)) * sqrt(mx * mx + my * my) AS len FROM n LEFT JOIN m USING (node)) SELECT node, round(CASE WHEN lx = x AND ly = y THEN 0 WHEN len > 1e-12 THEN degrees(acos(greatest(-1, least(1, ((lx - x) * mx + (ly - y) * my) / len)))) END, 4) AS degrees FROM k")
def t13_node(spark: SparkSession, d: str) -> DataFrame:
    e = views.edges(spark, d, True)
    n = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    i = F.expr("cast(substring(node, 2) as long) + if(startswith(node, 'p'), 11, 0)")
    now = n.select("node", (i * 7 % 37).cast("double").alias("x"), (i * 5 % 23).cast("double").alias("y"))
    later = n.select("node", (i * 7 % 37 + i % 4).cast("double").alias("x"), (i * 5 % 23 + i % 3).cast("double").alias("y"))
    return reaches.node_deviation(now, later, e).select("node", F.round("degrees", 4).alias("degrees"))


@query("h22_island_flips", f"WITH {SAM}, s AS (SELECT scene, seq, y - 250 AS dx, lead(y) OVER (PARTITION BY scene ORDER BY seq) - 250 AS dy FROM sam), u AS (SELECT scene, seq, dx / sqrt(dx*dx + dy*dy) AS ux, dy / sqrt(dx*dx + dy*dy) AS uy FROM s WHERE dy IS NOT NULL AND dx*dx + dy*dy > 0), m AS (SELECT *, avg(ux) OVER (PARTITION BY scene) AS mx, avg(uy) OVER (PARTITION BY scene) AS my, count(*) OVER (PARTITION BY scene) AS n FROM u), g AS (SELECT scene, seq, n, degrees(acos(greatest(-1, least(1, (ux*mx + uy*my) / sqrt(mx*mx + my*my))))) AS deg FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY deg DESC, seq) AS nr FROM g) SELECT scene AS island, seq AS edge, round(deg, 3) AS degrees FROM k WHERE nr <= greatest(1, n // 4) AND deg > 90")
def h22(spark: SparkSession, d: str) -> DataFrame:
    g = paths.steps(views.samples(spark, d)).select(F.col("scene").alias("island"), F.col("seq").alias("edge"), "y")
    e = g.withColumn("dy", F.lead("y").over(paths.Window.partitionBy("island").orderBy("edge")) - 250).withColumn("dx", F.col("y") - 250)
    return reaches.island_flips(e).select("island", "edge", F.round("degrees", 3).alias("degrees"))


@query("h6_tributaries")
def h6(spark: SparkSession, d: str) -> DataFrame:
    return reaches.tributaries(views.edges(spark, d, True))


@query("h27_traverse")
def h27(spark: SparkSession, d: str) -> DataFrame:
    return network.traversed(_chain(spark, d), "n0", 5)


@query("h2_insert_node", "WITH k AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS xs, embedding[33:64]::DOUBLE[] AS ys FROM embeddings), p AS (SELECT *, list_position(dd, list_min(dd)) AS i FROM (SELECT *, list_transform(range(1, 33), lambda i: xs[i] * xs[i] + ys[i] * ys[i]) AS dd FROM k)), s AS (SELECT vec_id, 0 AS part, xs[1:i] AS xs, ys[1:i] AS ys FROM p UNION ALL SELECT vec_id, 1, xs[i:], ys[i:] FROM p) SELECT vec_id, part, len(xs) AS n, round(list_sum(xs), 6) AS sx, round(list_sum(ys), 6) AS sy FROM s")
def h2(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    e = e.select("vec_id", F.slice("e", 1, 32).alias("xs"), F.slice("e", 33, 32).alias("ys"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, b: a + b), 6)
    return network.split_at_nearest(e, 0.0, 0.0).select("vec_id", "part", F.size("xs").cast("long").alias("n"), total("xs").alias("sx"), total("ys").alias("sy"))


@query("h1_nearest_edge", "WITH k AS (SELECT vec_id, (i - 1)::BIGINT AS seq, pow(embedding[i]::DOUBLE - 0.1, 2) + pow(embedding[i + 32]::DOUBLE + 0.1, 2) AS d2 FROM embeddings, (SELECT unnest(range(1, 33)) AS i)) SELECT vec_id, seq, round(sqrt(d2), 6) AS distance FROM k ORDER BY d2, vec_id, seq LIMIT 1")
def h1(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    p = e.select("vec_id", F.posexplode(F.arrays_zip(F.slice("e", 1, 32).alias("x"), F.slice("e", 33, 32).alias("y"))).alias("seq", "p"))
    return network.nearest_vertex(p.select("vec_id", F.col("seq").cast("long").alias("seq"), "p.x", "p.y"), 0.1, -0.1, "vec_id", "seq").withColumn("distance", F.round("distance", 6))


@query("t23_pair_analysis")
def t23_analysis(spark: SparkSession, d: str) -> DataFrame:
    s = _big(spark, d).select(F.col("scene").alias("pair"), "seq", "x", "y", (F.col("y") / 5000 + 100).alias("width"), F.lit(1.5).alias("years"))
    return pairs.analyse(s, s.withColumn("pair", F.col("pair") - 1), window=20, factor=1.5, least=5)


# ---- mapping ----------------------------------------------------------------------------------
def _scenes(spark: SparkSession, d: str) -> DataFrame:
    """The mask in scenes of 64 rows."""
    return _mask(spark, d, 0).select(F.floor(F.col("row") / 64).alias("scene"), (F.col("row") % 64).alias("row"), "col", "water")


def _river(spark: SparkSession, d: str) -> River:
    cells = _scenes(spark, d)
    ends = cells.select("scene").distinct().select("scene", *(F.lit(v).alias(n) for n, v in (("start_row", 0.0), ("start_col", 0.0), ("end_row", 63.0), ("end_col", 63.0))))
    return River(cells, ends)


@query("r12_skeleton_graph")
def r12_graph(spark: SparkSession, d: str) -> DataFrame:
    e = _river(spark, d).network()
    return e.groupBy("scene", "u", "v", "key").agg(F.count("*").alias("pixels"))


@query("e1_map_centerline")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return _river(spark, d).centerline()


@query("b1_banks")
def b1(spark: SparkSession, d: str) -> DataFrame:
    return _river(spark, d).banks()


@query("e3_summary")
def e3(spark: SparkSession, d: str) -> DataFrame:
    return _river(spark, d).summary()


@query("e5_water_of_scene")
def e5(spark: SparkSession, d: str) -> DataFrame:
    cells = _pix(spark, d).select(F.floor(F.col("row") / 64).alias("scene"), (F.col("row") % 64).alias("row"), "col", "b")
    return _rc(mapping.water_of_scenes(cells, F.col("b"), 150, 6))
