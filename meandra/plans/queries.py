"""A query for each operator, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meandra.functions import kernels
from meandra.functions import scalar as S
from meandra.operators import graph, paths, raster, temporal
from meandra.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PIX = 'pix AS (SELECT vec_id AS r, (generate_subscripts(embedding, 1) - 1)::BIGINT AS c, floor(unnest(embedding)::DOUBLE * 1000)::INTEGER AS b FROM embeddings)'
SAM = "sam AS (SELECT user_id AS scene, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, date_diff('second', TIMESTAMP '2024-01-01', ts)::DOUBLE AS x, value AS y FROM events)"
SCE = "sce AS (SELECT o_custkey AS river, o_orderkey AS scene, o_orderdate::DATE AS acq, o_totalprice AS width FROM orders)"
DENSE = "e AS (SELECT DISTINCT 's' || l_suppkey AS u, 'p' || l_partkey AS v FROM lineitem)"
SPARSE = "e AS (SELECT DISTINCT 's' || l_suppkey AS u, 'p' || l_partkey AS v FROM lineitem WHERE l_quantity = 50)"
RECT = "rect AS (SELECT DISTINCT l_suppkey AS grp, l_partkey AS x0, l_partkey + l_quantity::BIGINT AS x1, l_linenumber::BIGINT AS y0, l_linenumber::BIGINT + 5 AS y1, l_shipdate::DATE AS d FROM lineitem)"
RID = "rid AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY x0, x1, y0, d) + grp * 1000000 AS id FROM rect)"
LIMIT = 150


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _grad(c: str) -> str:
    lag, lead = f"lag({c}) OVER w", f"lead({c}) OVER w"
    return f"CASE WHEN {lag} IS NULL AND {lead} IS NULL THEN 0.0 WHEN {lag} IS NULL THEN {lead} - {c} WHEN {lead} IS NULL THEN {c} - {lag} ELSE ({lead} - {c} + {c} - {lag}) / 2 END".replace(f"({lead} - {c} + {c} - {lag})", f"({lead} - {lag})")


W = "WINDOW w AS (PARTITION BY scene ORDER BY seq)"
GRAD = f"g1 AS (SELECT *, {_grad('x')} AS dx, {_grad('y')} AS dy FROM sam {W}), g2 AS (SELECT *, {_grad('dx')} AS ddx, {_grad('dy')} AS ddy, sqrt(dx*dx + dy*dy) AS ds FROM g1 {W})"
CURV = f"{SAM}, {GRAD}, k AS (SELECT *, CASE WHEN pow(dx*dx + dy*dy, 1.5) = 0 THEN NULL ELSE (dx*ddy - dy*ddx) / pow(dx*dx + dy*dy, 1.5) END AS curvature FROM g2)"
#: Bends of y around 250, a signal with many sign changes.
BEND = f"{SAM}, k AS (SELECT *, y - 250 AS v FROM sam), h AS (SELECT *, coalesce(last_value(CASE WHEN v > 0 THEN 1 WHEN v < 0 THEN -1 END IGNORE NULLS) OVER (PARTITION BY scene ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS sgn FROM k), t AS (SELECT *, CASE WHEN coalesce(lag(sgn) OVER w <> sgn, false) THEN 1 ELSE 0 END AS turn FROM h {W}), bd AS (SELECT *, sum(turn) OVER (PARTITION BY scene ORDER BY seq ROWS UNBOUNDED PRECEDING) AS bend FROM t)"


def _pix(spark: SparkSession, d: str) -> DataFrame:
    return views.pixels(spark, d)


def _mask(spark: SparkSession, d: str, limit: float = LIMIT) -> DataFrame:
    return raster.water_mask(_pix(spark, d), F.col("b"), limit).select("row", "col", "water")


def _water(spark: SparkSession, d: str, limit: float = LIMIT) -> DataFrame:
    return _mask(spark, d, limit).filter("water = 1").select("row", "col")


def _rc(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"row": "r", "col": "c"})


def _bands(spark: SparkSession, d: str) -> DataFrame:
    p = _pix(spark, d)
    right = p.select("row", (F.col("col") - 1).alias("col"), F.col("b").alias("b2"))
    return p.join(right, ["row", "col"])


BANDS = f"{PIX}, bands AS (SELECT p.r, p.c, p.b, q.b AS b2 FROM pix p JOIN pix q ON p.r = q.r AND q.c = p.c + 1)"
_ND = "CASE WHEN b = 0 AND b2 = 0 THEN 'nan'::DOUBLE WHEN b + b2 = 0 THEN CASE WHEN b - b2 > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE (b - b2)::DOUBLE / (b + b2) END"


# ---- sources and scalars ----------------------------------------------------------------------
@query("s2_index_bands", "WITH n AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'LC08' WHEN o_orderkey % 3 = 1 THEN 'LC09' ELSE 'LT05' END || '_232060_' || strftime(o_orderdate, '%Y%m%d') AS name FROM orders) SELECT name, CASE WHEN name[1:4] IN ('LC08', 'LC09') THEN 3 ELSE 2 END AS green, CASE WHEN name[1:4] IN ('LC08', 'LC09') THEN 6 ELSE 5 END AS swir, strptime(name[13:20], '%Y%m%d')::DATE::VARCHAR AS acq FROM n")
def s2(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders")
    mission = F.when(F.col("o_orderkey") % 3 == 0, "LC08").when(F.col("o_orderkey") % 3 == 1, "LC09").otherwise("LT05")
    n = o.select(F.concat(mission, F.lit("_232060_"), F.date_format("o_orderdate", "yyyyMMdd")).alias("name")).distinct()
    b = S.index_bands(F.col("name"))
    return n.select("name", b["green"].alias("green"), b["swir"].alias("swir"), S.scene_date(F.col("name")).cast("string").alias("acq"))


@query("s4_best_scenes_of_year", f"WITH {SCE}, t AS (SELECT *, row_number() OVER (PARTITION BY river, year(acq) ORDER BY width, scene) AS nr FROM sce WHERE width < 300000) SELECT river, year(acq) AS year, scene, nr FROM t WHERE nr <= 2")
def s4(spark: SparkSession, d: str) -> DataFrame:
    return temporal.best_of_year(views.scenes(spark, d).filter("width < 300000"), "width", 2, "river").select("river", F.year("acq").alias("year"), "scene", "nr")


@query("s5_collection_of_year", f"WITH {SCE} SELECT CASE WHEN year(acq) + 16 < 2013 THEN 'LT05' WHEN year(acq) + 16 < 2021 THEN 'LC08' ELSE 'LC09' END AS collection, count(*) AS n FROM sce GROUP BY 1")
def s5(spark: SparkSession, d: str) -> DataFrame:
    return views.scenes(spark, d).groupBy(S.collection_of(F.year("acq") + 16).alias("collection")).agg(F.count("*").alias("n"))


@query("s6_qa_cloud_mask", "SELECT l_orderkey % 64 AS qa, count(*) AS n FROM lineitem WHERE ((l_orderkey % 64) & 8) = 0 AND ((l_orderkey % 64) & 16) = 0 GROUP BY 1")
def s6(spark: SparkSession, d: str) -> DataFrame:
    q = views.table(spark, d, "lineitem").select((F.col("l_orderkey") % 64).alias("qa"))
    return q.filter(S.clear_sky(F.col("qa"))).groupBy("qa").agg(F.count("*").alias("n"))


@query("s10_planet_metadata", "WITH f AS (SELECT strftime(ts, '%Y%m%d_%H%M%S') || '_' || (event_id % 100) || '_' || user_id || '_3B.tif' AS name FROM events) SELECT name, name[1:8] AS day, name[10:15] AS time, array_to_string(string_split(name, '_')[1:4], '_') AS item FROM f")
def s10(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    name = F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), (F.col("event_id") % 100).cast("string"), F.lit("_"), F.col("user_id").cast("string"), F.lit("_3B.tif"))
    return e.select(name.alias("name")).select("name", F.substring("name", 1, 8).alias("day"), F.substring("name", 10, 6).alias("time"), F.array_join(F.slice(F.split("name", "_"), 1, 4), "_").alias("item"))


@query("s15_mosaic", f"WITH {PIX}, a AS (SELECT r, c, b FROM pix WHERE c < 40), z AS (SELECT r, c, b + 1 AS b FROM pix WHERE c >= 24) SELECT coalesce(a.r, z.r) AS r, coalesce(a.c, z.c) AS c, coalesce(a.b, z.b) AS b FROM a FULL JOIN z ON a.r = z.r AND a.c = z.c")
def s15(spark: SparkSession, d: str) -> DataFrame:
    p = _pix(spark, d)
    both = p.filter("col < 40").withColumn("rank", F.lit(1)).unionByName(p.filter("col >= 24").withColumn("b", F.col("b") + 1).withColumn("rank", F.lit(2)))
    return _rc(both.groupBy("row", "col").agg(F.min_by("b", "rank").alias("b")))


# ---- raster -----------------------------------------------------------------------------------
@query("r1_normalized_difference", f"WITH {BANDS} SELECT r, c, round({_ND}, 9) + 0.0 AS nd FROM bands")
def r1(spark: SparkSession, d: str) -> DataFrame:
    return _rc(_bands(spark, d).select("row", "col", (F.round(S.normalized_difference(F.col("b"), F.col("b2")), 9) + F.lit(0.0)).alias("nd")))


@query("r2_water_mask", f"WITH {BANDS}, m AS (SELECT r, {_ND} AS nd FROM bands) SELECT r, sum(CASE WHEN NOT isnan(nd) AND nd > 0.1 THEN 1 ELSE 0 END)::BIGINT AS water_cells, count(*) AS cells, round(sum(CASE WHEN NOT isnan(nd) AND nd > 0.1 THEN 1 ELSE 0 END) / count(*), 9) AS fraction FROM m GROUP BY r")
def r2(spark: SparkSession, d: str) -> DataFrame:
    nd = S.normalized_difference(F.col("b"), F.col("b2"))
    return raster.water_fraction(raster.water_mask(_bands(spark, d), nd, 0.1), "row").withColumnRenamed("row", "r")


@query("r3_to_uint8", f"WITH {PIX} SELECT r, c, (((trunc(b / 1000.0::DOUBLE * 255)::BIGINT % 256) + 256) % 256)::INTEGER AS v FROM pix")
def r3(spark: SparkSession, d: str) -> DataFrame:
    return _rc(_pix(spark, d).select("row", "col", S.to_uint8(F.col("b") / F.lit(1000.0)).alias("v")))


_HOLES = f"{PIX}, l AS (SELECT r, c, r * 4294967296 + c AS k FROM pix WHERE NOT b > -60), reach(a, k, r, c) AS (SELECT k, k, r, c FROM l UNION SELECT reach.a, l.k, l.r, l.c FROM reach JOIN l ON abs(l.r - reach.r) + abs(l.c - reach.c) = 1), lab AS (SELECT r, c, min(a) AS label FROM reach GROUP BY r, c), sm AS (SELECT label FROM lab GROUP BY label HAVING count(*) < 6)"


@query("r5_fill_holes", f"WITH RECURSIVE {_HOLES} SELECT p.r, p.c, CASE WHEN p.b > -60 OR (lab.r IS NOT NULL AND lab.label IN (SELECT label FROM sm)) THEN 1 ELSE 0 END AS water FROM pix p LEFT JOIN lab ON p.r = lab.r AND p.c = lab.c")
def r5(spark: SparkSession, d: str) -> DataFrame:
    return _rc(raster.fill_holes(_mask(spark, d, -60), 6))


@query("r6_cloud_gate", f"WITH {PIX} SELECT sum((b > {LIMIT})::INT)::BIGINT AS water_cells, count(*) AS cells, round(sum((b > {LIMIT})::INT) / count(*), 9) AS fraction, NOT round(sum((b > {LIMIT})::INT) / count(*), 9) > 0.15 AS kept FROM pix")
def r6(spark: SparkSession, d: str) -> DataFrame:
    return raster.cloud_gate(_mask(spark, d))


_REACH = f"{PIX}, w AS (SELECT r, c, r * 4294967296 + c AS k FROM pix WHERE b > {LIMIT}), reach(a, k, r, c) AS (SELECT k, k, r, c FROM w UNION SELECT reach.a, w.k, w.r, w.c FROM reach JOIN w ON w.r BETWEEN reach.r - 1 AND reach.r + 1 AND w.c BETWEEN reach.c - 1 AND reach.c + 1)"


@query("r9_components", f"WITH RECURSIVE {_REACH} SELECT r, c, min(a) AS label FROM reach GROUP BY r, c")
def r9(spark: SparkSession, d: str) -> DataFrame:
    return _rc(raster.label(_water(spark, d)))


@query("r7_largest_component", f"WITH RECURSIVE {_REACH}, l AS (SELECT r, c, min(a) AS label FROM reach GROUP BY r, c), s AS (SELECT label, count(*) AS n FROM l GROUP BY label ORDER BY n DESC, label LIMIT 1) SELECT l.* FROM l JOIN s USING (label)")
def r7(spark: SparkSession, d: str) -> DataFrame:
    return _rc(raster.largest_component(_water(spark, d)).select("row", "col", "label"))


@query("r10_distance_transform", f"WITH {PIX}, w AS (SELECT * FROM pix WHERE b > {LIMIT}), z AS (SELECT * FROM pix WHERE NOT b > {LIMIT}) SELECT w.r, w.c, min((w.r - z.r) * (w.r - z.r) + (w.c - z.c) * (w.c - z.c)) AS d2 FROM w, z GROUP BY w.r, w.c")
def r10(spark: SparkSession, d: str) -> DataFrame:
    return _rc(raster.squared_distance(_mask(spark, d)))


@query("r13_outline", f"WITH {PIX}, w AS (SELECT r, c FROM pix WHERE b > {LIMIT}), s AS (SELECT r, c, side, r + dr AS r2, c + dc AS c2 FROM w, (VALUES ('n', -1, 0), ('s', 1, 0), ('w', 0, -1), ('e', 0, 1)) AS t(side, dr, dc)) SELECT s.r, s.c, side FROM s LEFT JOIN w ON w.r = s.r2 AND w.c = s.c2 WHERE w.r IS NULL")
def r13(spark: SparkSession, d: str) -> DataFrame:
    return _rc(raster.outline(_water(spark, d)))


@query("r11_skeleton")
def r11(spark: SparkSession, d: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf["row"].min(), pdf["col"].min()
        m = np.zeros((pdf["row"].max() - r0 + 1, pdf["col"].max() - c0 + 1), bool)
        m[pdf["row"] - r0, pdf["col"] - c0] = True
        y, x = np.nonzero(kernels.thin(m))
        return pd.DataFrame({"tile": pdf["tile"].iloc[0], "r": y + r0, "c": x + c0})

    tiles = _water(spark, d, 0).withColumn("tile", F.floor(F.col("row") / 64))
    return tiles.groupBy("tile").applyInPandas(run, "tile long, r long, c long")


def smooth_sql(values: str, sigma: float) -> str:
    """Gaussian smoothing of a list in SQL, mirrored at the ends."""
    w = S.gaussian_weights(sigma)
    r, n = len(w) // 2, f"len({values})"
    at = f"(((i + k) % (2 * {n})) + 2 * {n}) % (2 * {n})"
    taps = ", ".join(f"{x!r}::DOUBLE" for x in w)
    return f"list_transform(range({n}), lambda i: list_sum(list_transform(range({-r}, {r + 1}), lambda k: ([{taps}])[k + {r + 1}] * {values}[CASE WHEN {at} < {n} THEN {at} ELSE 2 * {n} - 1 - {at} END + 1])))"


_BINS = f"{PIX}, v AS (SELECT r // 64 AS tile, b FROM pix WHERE b <> 0), m AS (SELECT tile, min(b)::DOUBLE AS lo, max(b)::DOUBLE AS hi, count(*) AS n FROM v GROUP BY tile HAVING max(b) > min(b)), h AS (SELECT tile, least(63, floor((b - lo) * 64 / (hi - lo)))::BIGINT AS bin, count(*) AS k FROM v JOIN m USING (tile) GROUP BY 1, 2), f AS (SELECT m.tile, lo, hi, list(coalesce(k, 0) * 64 / (n * (hi - lo)) ORDER BY g.bin) AS dens FROM m CROSS JOIN (SELECT unnest(range(64)) AS bin) g LEFT JOIN h ON h.tile = m.tile AND h.bin = g.bin GROUP BY m.tile, lo, hi)"


@query("r15_histogram_threshold", f"WITH {_BINS}, s AS (SELECT tile, lo, hi, {smooth_sql('dens', 3.0)} AS sm FROM f), u AS (SELECT tile, lo + (i + 0.5) * (hi - lo) / 64 AS mid, round(sm[i], 12) AS a, round(sm[i + 1], 12) AS b, round(sm[i + 2], 12) AS c FROM s, range(1, 63) AS t(i)) SELECT m.tile, round(max(mid), 6) AS threshold FROM m LEFT JOIN u ON u.tile = m.tile AND b < a AND b < c AND mid < 0 GROUP BY m.tile")
def r15(spark: SparkSession, d: str) -> DataFrame:
    tiles = _pix(spark, d).withColumn("scene", F.floor(F.col("row") / 64))
    return raster.histogram_threshold(tiles, "b", 64, 3.0).select(F.col("scene").alias("tile"), F.round("threshold", 6).alias("threshold"))


@query("k4_crop", f"WITH {PIX} SELECT r - 10 AS r, c - 5 AS c, b FROM pix WHERE r BETWEEN 10 AND 109 AND c BETWEEN 5 AND 24")
def k4(spark: SparkSession, d: str) -> DataFrame:
    return _rc(raster.crop(_pix(spark, d), 10, 5, 100, 20))


@query("k5_downsample", f"WITH {PIX} SELECT r // 4 AS r, c // 4 AS c, round(avg(b), 6) AS mean FROM pix GROUP BY 1, 2")
def k5(spark: SparkSession, d: str) -> DataFrame:
    return _rc(raster.downsample(_pix(spark, d), 4))


@query("g24_one_time_step", f"WITH {BANDS} SELECT r, c, CASE WHEN NOT b > 100 THEN 'erosion' WHEN NOT b2 > 100 THEN 'deposition' ELSE 'channel' END AS kind FROM bands WHERE b > 100 OR b2 > 100")
def g24(spark: SparkSession, d: str) -> DataFrame:
    b = _bands(spark, d)
    return _rc(raster.change(b.filter("b > 100"), b.filter("b2 > 100")))


@query("t5_bars_and_erosion", f"WITH {PIX}, w AS (SELECT r % 50 AS r, c, r // 50 AS t FROM pix WHERE b > 100) SELECT r, c, min(t) AS eroded_at, max(t) AS bar_at FROM w GROUP BY r, c")
def t5(spark: SparkSession, d: str) -> DataFrame:
    w = _pix(spark, d).filter("b > 100").select((F.col("row") % 50).alias("row"), "col", F.floor(F.col("row") / 50).alias("t"))
    return _rc(raster.first_last(w, "t"))


@query("t4_areas_by_date", f"WITH {PIX} SELECT r // 50 AS t, sum((b > 100)::INT)::BIGINT AS channel, sum((b <= 100)::INT)::BIGINT AS bars, count(*) AS belt FROM pix GROUP BY 1")
def t4(spark: SparkSession, d: str) -> DataFrame:
    m = _mask(spark, d, 100)
    return m.groupBy(F.floor(F.col("row") / 50).alias("t")).agg(F.sum("water").cast("long").alias("channel"), F.sum(1 - F.col("water")).cast("long").alias("bars"), F.count("*").alias("belt"))


# ---- geometry and paths -----------------------------------------------------------------------
@query("g1_convert_to_utm", f"WITH {SAM} SELECT scene, seq, round(500000 + 15 + x * 30, 6) AS ux, round(4000000 - 15 - y * 30, 6) AS uy FROM sam")
def g1(spark: SparkSession, d: str) -> DataFrame:
    ux, uy = S.to_utm(F.col("x"), F.col("y"), 500000.0, 4000000.0, 30.0, -30.0)
    return views.samples(spark, d).select("scene", "seq", F.round(ux, 6).alias("ux"), F.round(uy, 6).alias("uy"))


_SEG = f"{SAM}, s AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM sam {W}), f AS (SELECT *, greatest(0, least(1, ((500000 - x) * (nx - x) + (200 - y) * (ny - y)) / ((nx - x) * (nx - x) + (ny - y) * (ny - y)))) AS t FROM s WHERE nx IS NOT NULL)"


@query("g3_closest_point_on_segment", f"WITH {_SEG} SELECT scene, seq, round(x + t * (nx - x), 4) AS px, round(y + t * (ny - y), 4) AS py FROM f")
def g3(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("scene").orderBy("seq")
    s = views.samples(spark, d).withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)}).filter("nx is not null")
    px, py = S.closest_on_segment(F.lit(500000.0), F.lit(200.0), F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))
    return s.select("scene", "seq", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


@query("g4_closest_segment", f"WITH {_SEG}, q AS (SELECT scene, seq, round(pow(x + t * (nx - x) - 500000, 2) + pow(y + t * (ny - y) - 200, 2), 3) AS d2 FROM f) SELECT scene, arg_min(seq, (d2, seq)) AS seq FROM q GROUP BY scene")
def g4(spark: SparkSession, d: str) -> DataFrame:
    p = g3_raw(spark, d)
    d2 = F.round(F.pow(F.col("px") - 500000.0, F.lit(2)) + F.pow(F.col("py") - 200.0, F.lit(2)), 3)
    return p.groupBy("scene").agg(F.min_by("seq", F.struct(d2, "seq")).alias("seq"))


def g3_raw(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("scene").orderBy("seq")
    s = views.samples(spark, d).withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)}).filter("nx is not null")
    px, py = S.closest_on_segment(F.lit(500000.0), F.lit(200.0), F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))
    return s.select("scene", "seq", px.alias("px"), py.alias("py"))


@query("g5_angle_between", f"WITH {SAM}, {GRAD}, a AS (SELECT scene, seq, dx, dy, coalesce(lag(dx) OVER w, 0) AS px, coalesce(lag(dy) OVER w, 0) AS py FROM g2 {W}) SELECT scene, seq, CASE WHEN (dx*dx + dy*dy) * (px*px + py*py) = 0 THEN 'nan'::DOUBLE ELSE round(acos(greatest(-1, least(1, (dx * px + dy * py) / (sqrt(dx*dx + dy*dy) * sqrt(px*px + py*py))))), 5) END AS angle FROM a")
def g5(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("scene").orderBy("seq")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0.0))
    g = paths.steps(views.samples(spark, d)).withColumns({"px": before("dx"), "py": before("dy")})
    return g.select("scene", "seq", F.round(S.angle_between(F.col("dx"), F.col("dy"), F.col("px"), F.col("py")), 5).alias("angle"))


@query("g7_matching_indices", f"WITH {SAM}, o AS (SELECT DISTINCT x, y FROM sam WHERE y > 250) SELECT scene, seq FROM sam SEMI JOIN o ON sam.x = o.x AND sam.y = o.y")
def g7(spark: SparkSession, d: str) -> DataFrame:
    s = views.samples(spark, d)
    return paths.matching(s, s.filter("y > 250")).select("scene", "seq")


@query("g9_extend_line", f"WITH {SAM}, n AS (SELECT scene, max(seq) AS m FROM sam GROUP BY scene) SELECT n.scene, round(a.x - (b.x - a.x) * 0.5, 6) AS x0, round(a.y - (b.y - a.y) * 0.5, 6) AS y0, round(p.x + (z.x - p.x) * 1.5, 6) AS x1, round(p.y + (z.y - p.y) * 1.5, 6) AS y1 FROM n JOIN sam a ON a.scene = n.scene AND a.seq = 0 JOIN sam b ON b.scene = n.scene AND b.seq = 1 JOIN sam p ON p.scene = n.scene AND p.seq = m - 1 JOIN sam z ON z.scene = n.scene AND z.seq = m")
def g9(spark: SparkSession, d: str) -> DataFrame:
    return paths.extended(views.samples(spark, d), 0.5).select("scene", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("g11_closest_point", f"WITH {SAM} SELECT scene, arg_min(seq, (pow(x - 500000, 2) + pow(y - 200, 2), seq)) AS seq FROM sam GROUP BY scene")
def g11(spark: SparkSession, d: str) -> DataFrame:
    return paths.nearest(views.samples(spark, d), 500000.0, 200.0).select("scene", "seq")


@query("g13_vertex_tolerance", f"WITH {SAM}, p AS (SELECT scene, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS d FROM sam {W}) SELECT scene, round(coalesce(avg(d) * 1.5, 0), 4) AS tolerance FROM p GROUP BY scene")
def g13(spark: SparkSession, d: str) -> DataFrame:
    return paths.vertex_tolerance(views.samples(spark, d)).select("scene", F.round("tolerance", 4).alias("tolerance"))


@query("g19_length_and_area", f"WITH {SAM}, p AS (SELECT scene, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM sam {W}) SELECT scene, count(*) AS n, round(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))), 3) AS length, round(abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y) / 2), 1) AS area FROM p GROUP BY scene")
def g19(spark: SparkSession, d: str) -> DataFrame:
    return paths.lengths(views.samples(spark, d)).select("scene", "n", F.round("length", 3).alias("length"), F.round("area", 1).alias("area"))


@query("g15_simplify")
def g15(spark: SparkSession, d: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("seq")
        k = kernels.simplify(p[["x", "y"]].to_numpy(), 50.0)
        return pd.DataFrame({"scene": p["scene"].iloc[0], "seq": np.arange(len(k)), "x": k[:, 0], "y": k[:, 1]})

    return views.samples(spark, d).groupBy("scene").applyInPandas(run, "scene long, seq long, x double, y double")


@query("g16_convex_hull")
def g16(spark: SparkSession, d: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = kernels.hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"scene": [pdf["scene"].iloc[0]], "vertices": [len(pdf)], "hull_vertices": [len(h)], "irregularity": [len(pdf) / len(h)]})

    return views.samples(spark, d).groupBy("scene").applyInPandas(run, "scene long, vertices long, hull_vertices long, irregularity double")


@query("g21_smooth_line")
def g21(spark: SparkSession, d: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("seq")
        return pd.DataFrame({"scene": p["scene"], "seq": p["seq"], "x": kernels.savgol(p["x"].to_numpy(), 21), "y": kernels.savgol(p["y"].to_numpy(), 21)})

    return views.samples(spark, d).groupBy("scene").applyInPandas(run, "scene long, seq long, x double, y double")


@query("b9_resample_and_smooth")
def b9(spark: SparkSession, d: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("seq")
        x, y = p["x"].to_numpy()[:-1], p["y"].to_numpy()[:-1]
        rx, ry = kernels.smoothing_curve(x, y, 5000.0, 1e4)
        return pd.DataFrame({"scene": p["scene"].iloc[0], "seq": np.arange(len(rx)), "x": rx, "y": ry})

    return views.samples(spark, d).groupBy("scene").applyInPandas(run, "scene long, seq long, x double, y double")


@query("b10_s_distance", f"WITH {SAM}, {GRAD} SELECT scene, seq, round(sum(ds) OVER (PARTITION BY scene ORDER BY seq ROWS UNBOUNDED PRECEDING) - first_value(ds) OVER w, 3) AS s FROM g2 {W}")
def b10(spark: SparkSession, d: str) -> DataFrame:
    return paths.steps(views.samples(spark, d)).select("scene", "seq", F.round("s0", 3).alias("s"))


@query("b11_curvature", f"WITH {CURV} SELECT scene, seq, round(curvature, 9) + 0.0 AS curvature FROM k")
def b11(spark: SparkSession, d: str) -> DataFrame:
    return paths.curvature(views.samples(spark, d)).select("scene", "seq", (F.round("curvature", 9) + F.lit(0.0)).alias("curvature"))


def _signal(spark: SparkSession, d: str) -> DataFrame:
    return views.samples(spark, d).withColumn("v", F.col("y") - 250)


@query("b12_zero_crossings", f"WITH {BEND}, g AS (SELECT scene, bend, count(*) AS n, avg(v) AS m, max(v) AS hi, min(v) AS lo FROM bd GROUP BY scene, bend) SELECT scene, bend::BIGINT AS bend, n, round(CASE WHEN m >= 0 THEN hi ELSE lo END, 6) AS peak FROM g")
def b12(spark: SparkSession, d: str) -> DataFrame:
    return paths.bend_table(_signal(spark, d), "v").select("scene", "bend", "n", F.round("peak", 6).alias("peak"))


@query("b14_waves", f"WITH {BEND}, n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM bd {W}), g AS (SELECT scene, bend, sum(coalesce(sqrt(pow(nx - x, 2) + pow(ny - y, 2)), 0)) AS arc, sqrt(pow(arg_max(coalesce(nx, x), seq) - arg_min(x, seq), 2) + pow(arg_max(coalesce(ny, y), seq) - arg_min(y, seq), 2)) AS hw FROM n GROUP BY scene, bend) SELECT scene, bend::BIGINT AS bend, round(hw, 4) AS half_wave, round(arc / hw, 6) AS sinuosity, round(2 * hw, 4) AS wavelength FROM g WHERE hw > 0 AND arc / hw > 1.0001")
def b14(spark: SparkSession, d: str) -> DataFrame:
    return paths.waves(_signal(spark, d), "v", 1.0001).select("scene", "bend", F.round("half_wave", 4).alias("half_wave"), F.round("sinuosity", 6).alias("sinuosity"), F.round("wavelength", 4).alias("wavelength"))


@query("b17_bend_points", f"WITH {BEND}, q AS (SELECT scene, bend, quantile_cont(abs(v), 0.9) AS cut FROM bd WHERE abs(v) > 20 GROUP BY scene, bend), kept AS (SELECT bd.scene, bd.seq, row_number() OVER (PARTITION BY bd.scene, bd.bend ORDER BY bd.seq) - 1 AS nr FROM bd JOIN q USING (scene, bend) WHERE abs(v) > 20 AND abs(v) >= cut) SELECT scene, seq FROM kept WHERE nr % 2 = 0")
def b17(spark: SparkSession, d: str) -> DataFrame:
    return paths.bend_points(_signal(spark, d), "v", 20.0, 0.9, 2)


@query("b18_median_filter", f"WITH {SAM}, m AS (SELECT scene, seq, list_sort([coalesce(lag(y, 2) OVER w, 0), coalesce(lag(y) OVER w, 0), y, coalesce(lead(y) OVER w, 0), coalesce(lead(y, 2) OVER w, 0)])[3] AS median5 FROM sam {W}) SELECT * FROM m")
def b18(spark: SparkSession, d: str) -> DataFrame:
    return paths.median5(views.samples(spark, d), "y").select("scene", "seq", "median5")


@query("t21_high_variance", f"WITH {SAM}, v AS (SELECT scene, seq, var_pop(y) OVER (PARTITION BY scene ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS va FROM sam), l AS (SELECT scene, list(va ORDER BY seq) AS vs FROM v GROUP BY scene), g AS (SELECT scene, {smooth_sql('vs', 2.0)} AS sm FROM l), q AS (SELECT scene, i - 1 AS seq, round(sm[i], 9) AS va FROM g, LATERAL (SELECT unnest(range(1, len(sm) + 1)) AS i)), m AS (SELECT scene, quantile_cont(va, 0.5) AS mid FROM q GROUP BY scene), h AS (SELECT q.scene, seq, CASE WHEN va > round(mid * 1.2, 9) THEN 1 ELSE 0 END AS high FROM q JOIN m ON q.scene = m.scene), t AS (SELECT *, CASE WHEN coalesce(lag(high) OVER w, 0) <> high THEN 1 ELSE 0 END AS turn FROM h {W}), r AS (SELECT *, sum(turn) OVER (PARTITION BY scene ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM t) SELECT scene, run::BIGINT AS run, min(seq) AS first, max(seq) AS last FROM r WHERE high = 1 GROUP BY scene, run")
def t21(spark: SparkSession, d: str) -> DataFrame:
    return paths.high_variance(views.samples(spark, d), "y", 20, 1.2)


@query("t20_migration", f"WITH {SAM}, t AS (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS tx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS ty FROM sam {W}) SELECT t.scene, t.seq, round((-ty * (o.x - t.x) + tx * (o.y + 10 - t.y)) / sqrt(tx * tx + ty * ty), 4) AS distance FROM t JOIN sam o ON o.scene = t.scene AND o.seq = t.seq + 1")
def t20(spark: SparkSession, d: str) -> DataFrame:
    s = views.samples(spark, d)
    m = s.select("scene", "seq", (F.col("seq") + 1).alias("q"))
    return temporal.migration(s, m, s.withColumn("y", F.col("y") + 10)).select("scene", "seq", F.round("distance", 4).alias("distance"))


@query("t19_correlate_curves")
def t19(spark: SparkSession, d: str) -> DataFrame:
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"scene": [], "p": [], "q": [], "cost": []})
        cost, path = kernels.align(a.sort_values("seq")["y"].to_numpy(), b.sort_values("q")["z"].to_numpy())
        return pd.DataFrame({"scene": a["scene"].iloc[0], "p": path[:, 0], "q": path[:, 1], "cost": cost})

    s = views.samples(spark, d)
    later = s.select((F.col("scene") - 1).alias("scene"), F.col("seq").alias("q"), F.col("y").alias("z"))
    return s.groupBy("scene").cogroup(later.groupBy("scene")).applyInPandas(run, "scene long, p long, q long, cost double")


# ---- graphs -----------------------------------------------------------------------------------
@query("h32_classify_nodes", f"WITH {DENSE}, o AS (SELECT u AS node, count(*) AS n_out FROM e GROUP BY u), i AS (SELECT v AS node, count(*) AS n_in FROM e GROUP BY v), j AS (SELECT coalesce(o.node, i.node) AS node, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM o FULL JOIN i ON o.node = i.node) SELECT *, CASE WHEN n_in >= 2 AND n_out = 1 THEN 'confluence' WHEN n_in = 1 AND n_out >= 2 THEN 'split' WHEN n_in = 0 AND n_out > 0 THEN 'source' WHEN n_in > 0 AND n_out = 0 THEN 'sink' WHEN n_in = 1 AND n_out = 1 THEN 'channel' ELSE 'other' END AS kind FROM j")
def h32(spark: SparkSession, d: str) -> DataFrame:
    return graph.classify_nodes(views.edges(spark, d))


@query("h32u_classify_undirected", f"WITH {SPARSE}, s AS (SELECT u, v FROM e UNION SELECT v, u FROM e) SELECT u AS node, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'junction' WHEN count(*) = 2 THEN 'channel' ELSE 'terminal' END AS kind FROM s GROUP BY u")
def h32u(spark: SparkSession, d: str) -> DataFrame:
    return graph.classify_undirected(views.edges(spark, d, True))


@query("h33_sources_and_sinks", f"WITH {SPARSE} SELECT DISTINCT u AS node, 'source' AS kind FROM e WHERE u NOT IN (SELECT v FROM e) UNION ALL SELECT DISTINCT v, 'sink' FROM e WHERE v NOT IN (SELECT u FROM e)")
def h33(spark: SparkSession, d: str) -> DataFrame:
    e = views.edges(spark, d, True)
    return graph.sources(e).withColumn("kind", F.lit("source")).unionByName(graph.sinks(e).withColumn("kind", F.lit("sink")))


@query("h34_connected_components", f"WITH RECURSIVE {SPARSE}, s AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(a, n) AS (SELECT u, u FROM s UNION SELECT r.a, s.v FROM r JOIN s ON r.n = s.u) SELECT n AS node, min(a) AS root FROM r GROUP BY n")
def h34(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(views.edges(spark, d, True))


@query("h35_degree_exceedance", f"WITH {DENSE}, g AS (SELECT u AS node, count(*) AS n FROM e GROUP BY u), k AS (SELECT *, row_number() OVER (ORDER BY n, node) AS nr, count(*) OVER () AS c FROM g) SELECT node, n, round(1 - nr / c::DOUBLE, 9) AS exceedance FROM k")
def h35(spark: SparkSession, d: str) -> DataFrame:
    g = views.edges(spark, d).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"))
    return graph.exceedance(g).select("node", "n", F.round("exceedance", 9).alias("exceedance"))


@query("h5_remove_dead_ends")
def h5(spark: SparkSession, d: str) -> DataFrame:
    return graph.remove_dead_ends(views.edges(spark, d, True))


@query("h4_nodes_within_hops", f"WITH RECURSIVE {SPARSE}, s AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(node, hop) AS (SELECT 's1', 0 UNION SELECT s.v, hop + 1 FROM r JOIN s ON r.node = s.u WHERE hop < 4) SELECT node, min(hop) AS hop FROM r GROUP BY node")
def h4(spark: SparkSession, d: str) -> DataFrame:
    return graph.hops(views.edges(spark, d, True), spark.createDataFrame([("s1",)], "node string"), 4)


#: The dense graph at two dates.
DATED = "a AS (SELECT DISTINCT 's' || l_suppkey AS u, 'p' || l_partkey AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-07-01'), b AS (SELECT DISTINCT 's' || l_suppkey AS u, 'p' || l_partkey AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-07-01')"


def _dated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    early = F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp_ntz")
    return views.edges(spark, d, where=early), views.edges(spark, d, where=~early)


@query("h29_matching_subpaths", f"WITH {DATED} SELECT a.u || '>' || a.v AS path_a, b.u || '>' || b.v AS path_b FROM a JOIN b ON a.u = b.u AND a.v = b.v")
def h29(spark: SparkSession, d: str) -> DataFrame:
    a, b = (e.select(F.concat("u", F.lit(">"), "v").alias("path"), F.col("u").alias("start"), F.col("v").alias("end")) for e in _dated(spark, d))
    return graph.matching_subpaths(a, b).select("path_a", "path_b")


# ---- time -------------------------------------------------------------------------------------
def _rects(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("grp").orderBy("x0", "x1", "y0", "d")
    return views.rects(spark, d).withColumn("id", F.row_number().over(w) + F.col("grp") * 1000000)


STRIPS = "st AS (SELECT *, unnest(range(x0 // 64, x1 // 64 + 1)) AS strip FROM rid)"
PAIRS = f"{RECT}, {RID}, {STRIPS}, pr AS (SELECT a.grp, a.id AS i, b.id AS j, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS common, (a.x1 - a.x0) * (a.y1 - a.y0) AS area_i, (b.x1 - b.x0) * (b.y1 - b.y0) AS area_j FROM st a JOIN st b ON a.grp = b.grp AND a.strip = b.strip AND a.id < b.id WHERE greatest(a.x0, b.x0) // 64 = a.strip AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND abs(a.d - b.d) <= 730), io AS (SELECT *, round(common / (area_i + area_j - common)::DOUBLE, 9) AS iou, round(common / least(area_i, area_j)::DOUBLE, 9) AS iou_min FROM pr)"


@query("t1_t2_iou", f"WITH {PAIRS} SELECT i, j, iou, iou_min FROM io")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return temporal.with_iou(temporal.overlapping(_rects(spark, d))).select("i", "j", "iou", "iou_min")


@query("t9_best_match", f"WITH {PAIRS}, k AS (SELECT i, j, iou, row_number() OVER (PARTITION BY i ORDER BY iou DESC, j) AS nr FROM io WHERE iou > 0.5) SELECT i, j, iou FROM k WHERE nr = 1")
def t9(spark: SparkSession, d: str) -> DataFrame:
    return temporal.best_match(temporal.overlapping(_rects(spark, d)))


@query("t3_cluster_polygons")
def t3(spark: SparkSession, d: str) -> DataFrame:
    return temporal.clusters(temporal.overlapping(_rects(spark, d)), 0.8)


@query("t6_days_since_first", f"WITH {SCE} SELECT river, scene, acq - min(acq) OVER (PARTITION BY river) AS n_days, year(acq) AS year, month(acq) AS month, day(acq) AS day FROM sce")
def t6(spark: SparkSession, d: str) -> DataFrame:
    return temporal.with_days(views.scenes(spark, d), "river").select("river", "scene", "n_days", "year", "month", "day")


@query("t23_scene_pairs", f"WITH {SCE} SELECT a.river, a.scene AS scene1, b.scene AS scene2, b.acq - a.acq AS gap_days, round((b.acq - a.acq) / 365.25, 9) AS years FROM sce a JOIN sce b ON a.river = b.river AND b.acq - a.acq BETWEEN 365 AND 1826")
def t23(spark: SparkSession, d: str) -> DataFrame:
    return temporal.scene_pairs(views.scenes(spark, d), 365, 1826).select("river", "scene1", "scene2", "gap_days", F.round("years", 9).alias("years"))


PCLASS = f"{SCE}, p AS (SELECT a.river, corr(a.width, b.width) AS r, regr_slope(b.width, a.width) AS slope, avg(b.acq - a.acq) / 365.25 AS lag, count(*) AS n FROM sce a JOIN sce b ON a.river = b.river AND b.acq - a.acq BETWEEN 365 AND 1826 GROUP BY a.river HAVING count(*) > 3)"


@query("a35_classify_pairs", f"WITH {PCLASS} SELECT river, n, CASE WHEN r IS NULL OR isnan(r) THEN 'insufficient' WHEN lag > 2.5 THEN 'reversed' WHEN r >= 0.2 THEN CASE WHEN slope < 0.8 OR slope > 1.2 THEN 'stage_mismatch' ELSE 'good' END WHEN abs(r) < 0.2 THEN 'weak' ELSE 'insufficient' END AS pair_class FROM p")
def a35(spark: SparkSession, d: str) -> DataFrame:
    p = temporal.scene_pairs(views.scenes(spark, d), 365, 1826)
    g = p.groupBy("river").agg(S.moment_ratio("width1", "width2", "width1", "width2").alias("r"), F.regr_slope("width2", "width1").alias("slope"), (F.avg("gap_days") / 365.25).alias("lag"), F.count("*").alias("n")).filter("n > 3")
    return g.select("river", "n", S.pair_class(F.col("r"), F.col("slope"), F.col("lag"), far=2.5).alias("pair_class"))


@query("a34_pair_summary", f"WITH {SCE}, p AS (SELECT a.river, a.width AS w1, b.width AS w2, b.acq - a.acq AS gap FROM sce a JOIN sce b ON a.river = b.river AND b.acq - a.acq BETWEEN 365 AND 1826) SELECT river, count(*) AS n, round(quantile_cont(w2 - w1, 0.9), 4) AS p90, round(sum(w1 * gap) / sum(gap), 4) AS weighted_width, round(sum(w1) + sum(w2), 2) AS sum_width, round(avg(gap) / 365.25, 6) AS time_gap FROM p GROUP BY river")
def a34(spark: SparkSession, d: str) -> DataFrame:
    p = temporal.scene_pairs(views.scenes(spark, d), 365, 1826)
    g = p.groupBy("river").agg(F.count("*").alias("n"), F.percentile(F.col("width2") - F.col("width1"), 0.9).alias("p90"), (F.sum(F.col("width1") * F.col("gap_days")) / F.sum("gap_days")).alias("weighted_width"), (F.sum("width1") + F.sum("width2")).alias("sum_width"), (F.avg("gap_days") / 365.25).alias("time_gap"))
    return g.select("river", "n", F.round("p90", 4).alias("p90"), F.round("weighted_width", 4).alias("weighted_width"), F.round("sum_width", 2).alias("sum_width"), F.round("time_gap", 6).alias("time_gap"))


@query("a36_length_anomaly", f"WITH {SCE} SELECT scene FROM sce, (SELECT avg(width) AS m, stddev_pop(width) AS s FROM sce) WHERE width > m - s * 0.5")
def a36(spark: SparkSession, d: str) -> DataFrame:
    return temporal.keep_near_mean(views.scenes(spark, d), "width", 0.5).select("scene")


@query("a37_z_filter", f"WITH {SCE}, z AS (SELECT scene, coalesce(abs(width - avg(width) OVER (PARTITION BY river)) / nullif(stddev_pop(width) OVER (PARTITION BY river), 0), 0) AS z FROM sce) SELECT scene FROM z WHERE z < 1.5")
def a37(spark: SparkSession, d: str) -> DataFrame:
    return temporal.z_filtered(views.scenes(spark, d), "width", "river", 1.5).select("scene")


@query("t26_rates", f"WITH {SCE}, n AS (SELECT river, scene, lead(acq) OVER w - acq AS interval_days, lead(width) OVER w - width AS change FROM sce WINDOW w AS (PARTITION BY river ORDER BY acq, scene)) SELECT river, scene, interval_days, round(CASE WHEN interval_days = 0 THEN 0 ELSE change / interval_days END, 9) + 0.0 AS rate FROM n WHERE interval_days IS NOT NULL")
def t26(spark: SparkSession, d: str) -> DataFrame:
    return temporal.rates(views.scenes(spark, d), F.col("width"), "river").select("river", "scene", "interval_days", (F.round("rate", 9) + F.lit(0.0)).alias("rate"))


@query("t14_common_confluences")
def t14(spark: SparkSession, d: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("seq")
        k = kernels.average_linkage(p[["x", "y"]].to_numpy(), 50000.0)
        g = p.assign(cluster=k).groupby("cluster").agg(n=("seq", "size"), x=("x", "mean"), y=("y", "mean")).reset_index()
        return g.assign(scene=p["scene"].iloc[0])[["scene", "cluster", "n", "x", "y"]]

    return views.samples(spark, d).groupBy("scene").applyInPandas(run, "scene long, cluster long, n long, x double, y double")


@query("ag7_histogram", "SELECT width_bucket AS bucket, count(*) AS n, round(sum(value), 4) AS weight FROM (SELECT least(49, floor(value / 10))::BIGINT AS width_bucket, value FROM events) GROUP BY 1")
def ag7(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").select(F.least(F.lit(49), F.floor(F.col("value") / 10)).alias("bucket"), "value")
    return e.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("weight"))


@query("k12_summary", f"WITH {SAM} SELECT scene, count(*) AS n, round(avg(y), 6) AS mean_width, round(stddev_pop(y), 6) AS std_width, max(y) AS max_width FROM sam GROUP BY scene")
def k12(spark: SparkSession, d: str) -> DataFrame:
    return views.samples(spark, d).groupBy("scene").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean_width"), F.round(F.stddev_pop("y"), 6).alias("std_width"), F.max("y").alias("max_width"))
