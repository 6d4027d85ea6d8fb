"""Scenes and shapes over time: overlaps, clusters, pairs, rates, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meandra.functions.scalar import iou
from meandra.operators import raster
from meandra.operators.graph import checkpointed, components


def overlapping(rects: DataFrame, most_days: int = 730) -> DataFrame:
    """(grp, i, j, common, area_i, area_j): pairs i < j of one group that overlap, at most so many days apart.

    Rectangles meet in strips of their group along x, so a group's rows are not all compared. Where there is a column
    type, rows of type 0 or 1 are never i.
    """
    strip = 64
    r = rects.withColumn("strip", F.explode(F.sequence(F.floor(F.col("x0") / strip), F.floor(F.col("x1") / strip))))
    # dates fall into buckets of `most_days`: only neighbouring ones meet
    r = r.withColumn("era", F.floor(F.unix_date("d") / F.lit(max(1, most_days))))
    a, b = (r.select("grp", "strip", "era", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "x0", "x1", "y0", "y1", "d", *(["type"] if "type" in rects.columns else [])))) for s in "ij")
    # one of a pair asks its own bucket and the next
    a = a.withColumn("own", F.col("era")).withColumn("era", F.explode(F.array(*(F.col("era") + k for k in (0, 1)))))
    w = F.least("x1_i", "x1_j") - F.greatest("x0_i", "x0_j")
    h = F.least("y1_i", "y1_j") - F.greatest("y0_i", "y0_j")
    # each pair once: in the strip where its overlap begins, and from one side where both are of one bucket
    home = F.floor(F.greatest("x0_i", "x0_j") / strip) == F.col("strip")
    less = F.col("id_i") < F.col("id_j")
    once = less | ((F.col("own") < F.col("era")) & (F.col("id_i") != F.col("id_j")))
    m = a.join(b, ["grp", "strip", "era"]).filter(once & (w > 0) & (h > 0) & home & (F.abs(F.datediff("d_i", "d_j")) <= most_days))
    of = lambda i, j: F.when(less, i).otherwise(j)
    if "type" in rects.columns:  # main banks, types 0 and 1, look for no partner
        m = m.filter(~of(F.col("type_i"), F.col("type_j")).isin(0, 1))
    area = lambda s: (F.col(f"x1_{s}") - F.col(f"x0_{s}")) * (F.col(f"y1_{s}") - F.col(f"y0_{s}"))
    return m.select("grp", F.least("id_i", "id_j").alias("i"), F.greatest("id_i", "id_j").alias("j"), (w * h).alias("common"), of(area("i"), area("j")).alias("area_i"), of(area("j"), area("i")).alias("area_j"))


def with_iou(pairs: DataFrame) -> DataFrame:
    cols = F.col("area_i"), F.col("area_j"), F.col("common")
    return pairs.withColumns({"iou": F.round(iou(*cols), 9), "iou_min": F.round(iou(*cols, smaller=True), 9)})


def clusters(pairs: DataFrame, least: float) -> DataFrame:
    """(node, root): shapes tied by overlaps over `least` of the smaller area."""
    return components(with_iou(pairs).filter(F.col("iou_min") > least).select(F.col("i").alias("u"), F.col("j").alias("v")))


def best_match(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """(i, j, iou): for each i the j with the greatest IoU over `least`, the first on ties."""
    w = Window.partitionBy("i").orderBy(F.desc("iou"), "j")
    return with_iou(pairs).filter(F.col("iou") > least).withColumn("nr", F.row_number().over(w)).filter("nr = 1").select("i", "j", "iou")


def with_days(scenes: DataFrame, *by: str) -> DataFrame:
    """Adds n_days since the first date and the calendar parts."""
    w = Window.partitionBy(*by)
    return scenes.withColumns({"n_days": F.datediff("acq", F.min("acq").over(w)), "year": F.year("acq"), "month": F.month("acq"), "day": F.dayofmonth("acq")})


def best_of_year(scenes: DataFrame, cost: str, n: int, *by: str) -> DataFrame:
    """The n scenes of each year with the least cost, ties to the smaller scene."""
    w = Window.partitionBy(*by, F.year("acq")).orderBy(cost, "scene")
    return scenes.withColumn("nr", F.row_number().over(w)).filter(F.col("nr") <= n)


def scene_pairs(scenes: DataFrame, least_days: int, most_days: int) -> DataFrame:
    """(river, scene1, scene2, gap_days, years): pairs of one river, the earlier first, by their gap in days."""
    a = scenes.select("river", F.col("scene").alias("scene1"), F.col("acq").alias("date1"), F.col("width").alias("width1"))
    b = scenes.select("river", F.col("scene").alias("scene2"), F.col("acq").alias("date2"), F.col("width").alias("width2"))
    gap = F.datediff("date2", "date1")
    # a scene of a bucket of days meets those of its own and the next one, so far apart scenes of a river never meet
    bucket = lambda c: F.floor(F.unix_date(c) / F.lit(max(1, most_days)))
    a = a.withColumn("_b", F.explode(F.array(bucket(F.col("date1")), bucket(F.col("date1")) + 1)))
    b = b.withColumn("_b", bucket(F.col("date2")))
    return a.join(b, ["river", "_b"]).drop("_b").withColumn("gap_days", gap).filter((F.col("gap_days") >= least_days) & (F.col("gap_days") <= most_days)).withColumn("years", F.col("gap_days") / 365.25)


def keep_near_mean(rows: DataFrame, value: str, below: float) -> DataFrame:
    """Rows whose value is over mean - below * population deviation."""
    m = rows.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return rows.join(F.broadcast(m), F.col(value) > F.col("_m") - F.col("_s") * below).drop("_m", "_s")


def z_filtered(rows: DataFrame, value: str, by: str, most: float = 3.0) -> DataFrame:
    w = Window.partitionBy(by)
    z = F.try_divide(F.abs(F.col(value) - F.avg(value).over(w)), F.stddev_pop(value).over(w))
    return rows.withColumn("_z", F.coalesce(z, F.lit(0.0))).filter(F.col("_z") < most).drop("_z")


def migration(points: DataFrame, matches: DataFrame, other: DataFrame) -> DataFrame:
    """(scene, seq, distance): signed offset of matched vertices along the left normal, mean over matches."""
    w = Window.partitionBy("scene").orderBy("seq")
    t = lambda c: F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))
    p = points.withColumns({"tx": t("x"), "ty": t("y")})
    p = p.withColumn("size", F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty")))
    o = other.select("scene", F.col("seq").alias("q"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    m = p.join(matches, ["scene", "seq"]).join(o, ["scene", "q"])
    off = F.try_divide(-F.col("ty") * (F.col("ox") - F.col("x")) + F.col("tx") * (F.col("oy") - F.col("y")), F.col("size"))
    return m.groupBy("scene", "seq").agg(F.avg(off).alias("distance"))


def rates(series: DataFrame, value: Column, by: str) -> DataFrame:
    """Adds interval_days to the next date and the change of a value per day, 0 without an interval."""
    w = Window.partitionBy(by).orderBy("acq", "scene")
    s = series.withColumn("interval_days", F.datediff(F.lead("acq").over(w), F.col("acq"))).withColumn("change", F.lead(value).over(w) - value)
    return s.filter("interval_days is not null").withColumn("rate", F.coalesce(F.try_divide("change", "interval_days"), F.lit(0.0)))


def channel_and_bars(cells: DataFrame, area: DataFrame, time: str) -> DataFrame:
    """(time, belt, bars, channel): cells of an area of interest that no main bank (type 0 or 1) covers, those under islands (type 2), and the rest."""
    whole = area.select("row", "col").distinct()
    total = whole.agg(F.count("*").alias("total"))
    dates = cells.select(time).distinct()
    inside = cells.join(whole, ["row", "col"], "left_semi").select(time, "row", "col", "type").distinct()
    flag = lambda condition: F.count(F.when(condition, 1))
    # a cell under both a bank and an island is no part of the belt
    each = inside.groupBy(time, "row", "col").agg((F.min("type") < 2).alias("bank"))
    n = each.groupBy(time).agg(flag(F.col("bank")).alias("banks"), flag(~F.col("bank")).alias("bars"))
    out = dates.join(n, time, "left").crossJoin(F.broadcast(total)).select(time, (F.col("total") - F.coalesce("banks", F.lit(0))).alias("belt"), F.coalesce("bars", F.lit(0)).alias("bars"))
    return out.withColumn("channel", F.col("belt") - F.col("bars"))


def sets_over_dates(cells: DataFrame, time: str) -> DataFrame:
    """(kind, time, row, col): the channel at each date, the bars left after it, and the erosion from it to the next date.

    A cell becomes bar at the last date that it was water, if that is not the last of all, and was eroded before the
    first, if that is not the first of all: cells meet nothing but their own dates.
    """
    dates = cells.select(F.col(time).alias("_t")).distinct()
    dates = dates.select("_t", F.lag("_t").over(Window.orderBy("_t")).alias("_before"), F.lead("_t").over(Window.orderBy("_t")).alias("_after"))  # a row a date
    ends = cells.groupBy("row", "col").agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    bars = ends.join(F.broadcast(dates.filter("_after is not null")), F.col("_last") == F.col("_t")).select(F.lit("bar").alias("kind"), F.col("_last").alias(time), "row", "col")
    gone = ends.join(F.broadcast(dates.filter("_before is not null")), F.col("_first") == F.col("_t")).select(F.lit("erosion").alias("kind"), F.col("_before").alias(time), "row", "col")
    return bars.unionByName(gone).unionByName(cells.select(F.lit("channel").alias("kind"), time, "row", "col").distinct())


def change_polygons(change: DataFrame, dates: DataFrame, least: int = 10) -> DataFrame:
    """(kind, polygon, area, length, start, end, duration): connected parts of over `least` cells of each kind of change.

    length: the sides around a part, holes included. dates: one row with start and end of the interval.
    """
    parts = None
    for kind in ("erosion", "deposition"):
        cells = change.filter(F.col("kind") == kind).select("row", "col")
        sides = raster.outline(cells).groupBy("row", "col").agg(F.count("*").alias("sides"))
        one = raster.label(cells, diagonal=False).join(sides, ["row", "col"], "left").groupBy(F.col("label").alias("polygon")).agg(F.count("*").alias("area"), F.coalesce(F.sum("sides"), F.lit(0)).alias("length"))
        one = one.filter(F.col("area") > least).select(F.lit(kind).alias("kind"), "polygon", "area", "length")
        parts = one if parts is None else parts.unionByName(one)
    return parts.crossJoin(F.broadcast(dates.select("start", "end", F.datediff("end", "start").alias("duration"))))  # one row


def mappings(rook: DataFrame, node: DataFrame, edge: DataFrame) -> DataFrame:
    """(kind, a, b, score): what maps to what between two dates, for islands, nodes and edges.

    The three are made one after the other: tasks of one plan for all would sort and group side by side, in the memory of one.
    """
    tagged = [checkpointed(df.select(F.lit(kind).alias("kind"), "a", "b", "score")) for kind, df in (("rook", rook), ("node", node), ("edge", edge))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
