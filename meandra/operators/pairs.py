"""Migration between two dated centerlines: alignment, offsets, stable stretches, and how they follow curvature."""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meandra.functions import kernels
from meandra.functions.scalar import moment_ratio, pair_class

SCHEMA = "pair long, n long, p90_mr double, lag double, r_curv_mr double, slope_curv_mr double, r_squared_width double, width_slope double, width_intercept double, width_diff double, n_stable_segments long, stable_data_ratio double, combined_cost double"

#: Arrays of a pair's two lines; cells of the matrices that are warped together, unless one alone has more.
_ARRAYS = [f"{c}{k}" for k in (1, 2) for c in "xyw"]
CELLS = 1 << 20


def _shared(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[slice, slice]:
    """Vertices of both curves between the ends they share: the nearest start in the first half, end in the second."""

    def nearest(x: np.ndarray, y: np.ndarray, px: float, py: float, late: bool) -> int:
        half = max(1, len(x) // 2)
        d = np.hypot(x - px, y - py)
        return int(half + d[half:].argmin()) if late and len(x) > half else int(d[:half].argmin())

    a, b = nearest(x1, y1, x2[0], y2[0], False), nearest(x1, y1, x2[-1], y2[-1], True)
    c, e = nearest(x2, y2, x1[0], y1[0], False), nearest(x2, y2, x1[-1], y1[-1], True)
    return slice(a, b + 1), slice(c, e + 1)


def _metrics(one: np.ndarray, two: np.ndarray, years: float, window: int = 50, factor: float = 100.0, least: int = 20) -> Generator:
    """metrics(); yields lists of cost matrices and is sent their warps()."""
    i, j = _shared(one[:, 0], one[:, 1], two[:, 0], two[:, 1])
    a, b = one[i], two[j]
    out = dict.fromkeys(("p90_mr", "lag", "r_curv_mr", "slope_curv_mr", "r_squared_width", "width_slope", "width_intercept", "combined_cost"), np.nan)
    out |= {"n": len(a), "width_diff": float(b[:, 2].mean() - a[:, 2].mean()), "n_stable_segments": 0, "stable_data_ratio": 0.0}
    if len(a) < 3 or len(b) < 3 or not years > 0:
        return out
    [(_, path)] = yield [np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])]
    rate = kernels.offsets(a[:, 0], a[:, 1], b[:, 0], b[:, 1], path) / years
    out["p90_mr"] = float(np.percentile(rate, 90))
    wide = kernels.unstable(rate * years, window, factor)
    calm = path[~wide[path[:, 0]]]
    if len(calm) > 5:
        v, w = a[calm[:, 0], 2], b[calm[:, 1], 2]
        if v.std() > 0 and w.std() > 0:
            out["width_slope"] = slope = float(((v - v.mean()) * (w - w.mean())).mean() / v.var())
            out["width_intercept"] = float(w.mean() - slope * v.mean())
            out["r_squared_width"] = float(np.corrcoef(v, w)[0, 1] ** 2)
    s = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(a[:, 0]), np.diff(a[:, 1])))])
    bend = -np.nan_to_num(kernels.curvature(a[:, 0], a[:, 1])) * a[:, 2].mean()
    parts, rows = [r for r in kernels.runs_of(~wide) if r[1] - r[0] + 1 >= least], []
    scaled = [(kernels.to_unit_range(bend[p : q + 1]), kernels.to_unit_range(rate[p : q + 1])) for p, q in parts]
    aligned = (yield [np.abs(u[:, None] - v[None, :]) ** 0.15 for u, v in scaled]) if parts else []
    for (p, q), (u, v), (cost, way) in zip(parts, scaled, aligned):
        c, m, along = bend[p : q + 1], rate[p : q + 1], s[p : q + 1]
        u, v, pc, pm = u[way[:, 0]], v[way[:, 1]], c[way[:, 0]], m[way[:, 1]]
        r = float(np.corrcoef(u, v)[0, 1]) if u.std() > 0 and v.std() > 0 else np.nan
        k = float(((pc - pc.mean()) * (pm - pm.mean())).mean() / pc.var()) if len(pc) > 5 and pc.var() > 0 else np.nan
        rows.append((len(c), cost, r, k, float((along[way[:, 0]] - along[way[:, 1]]).mean())))
    if rows:
        n, cost, r, k, lag = (np.array(x, float) for x in zip(*rows))
        good = np.isfinite(k)
        out |= {"n_stable_segments": len(rows), "stable_data_ratio": float(n.sum() / len(a)), "combined_cost": float((cost * n).sum() / n.sum()), "lag": float(lag.mean())}
        out["r_curv_mr"] = float(np.nanmean(r)) if np.isfinite(r).any() else np.nan
        out["slope_curv_mr"] = float((k[good] * n[good]).sum() / n[good].sum()) if good.any() else np.nan
    return out


def metrics(one: np.ndarray, two: np.ndarray, years: float, window: int = 50, factor: float = 100.0, least: int = 20) -> dict:
    """Figures of one pair; `one` and `two` hold x, y and width by column. NaN where a figure is not defined."""
    return _together([_metrics(one, two, years, window, factor, least)])[0]


def _together(runs: list[Generator]) -> list[dict]:
    """What each run returns; the warps that they ask for at once are made at once."""
    found: list[dict] = [{} for _ in runs]
    sent: dict[int, list | None] = dict.fromkeys(range(len(runs)))
    while sent:
        asked = {}
        for k, answer in sent.items():
            try:
                asked[k] = runs[k].send(answer)
            except StopIteration as end:
                found[k] = end.value
        made = iter(kernels.warps([c for costs in asked.values() for c in costs]))
        sent = {k: [next(made) for _ in costs] for k, costs in asked.items()}
    return found


def _lines(points: DataFrame, by: list[str], k: int) -> DataFrame:
    """A row for each path, with arrays xk, yk and wk along it; and its years where there are any."""
    at = F.array_sort(F.collect_list(F.struct("seq", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "width")))))
    years = [F.first("years").alias("years")] if "years" in points.columns else []
    made = points.groupBy(*by).agg(at.alias("_at"), *years)
    return made.select(*by, *(F.col(f"_at.{c}").alias(f"{c[0]}{k}") for c in ("x", "y", "width")), *(["years"] if years else []))


def _figures(rows: DataFrame, keep: list[str], how: dict) -> DataFrame:
    """The kept columns and the figures of each row's two lines, x1, y1, w1 and x2, y2, w2, years apart."""
    kinds = [part.split() for part in SCHEMA.split(", ")[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in _ARRAYS}
            ends = {c: np.concatenate(([0], np.cumsum(batch.column(c).value_lengths().to_numpy(zero_copy_only=False)))).astype(int) for c in _ARRAYS}
            line = lambda r, k: np.stack([values[f"{c}{k}"][ends[f"{c}{k}"][r] : ends[f"{c}{k}"][r + 1]] for c in "xyw"], axis=1)
            years = batch.column("years").to_numpy(zero_copy_only=False).astype(float)
            # pairs of like size together, as many as a bounded number of cells holds: each is padded to the largest
            sides = np.maximum(np.diff(ends["x1"]), np.diff(ends["x2"]))
            order, found, lo = np.argsort(sides, kind="stable"), [{}] * batch.num_rows, 0
            while lo < len(order):
                hi = lo + 1
                while hi < len(order) and (hi + 1 - lo) * int(sides[order[hi]]) ** 2 <= CELLS:
                    hi += 1
                part = order[lo:hi].tolist()
                for r, out in zip(part, _together([_metrics(line(r, 1), line(r, 2), years[r], **how) for r in part])):
                    found[r] = out
                lo = hi
            # figures that are not defined are null
            figures = [pa.array([out[name] for out in found], pa.int64() if kind == "long" else pa.float64(), from_pandas=True) for name, kind in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *figures], [*keep, *(name for name, _ in kinds)])

    types = ", ".join(f"`{c}` {kind}" for c, kind in rows.select(*keep).dtypes)
    # a fixed number of tasks: rows are small for the work on them
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keep, *([] if "years" in keep else ["years"]), *_ARRAYS).repartition(tasks, *keep).mapInArrow(run, f"{types}, {', '.join(SCHEMA.split(', ')[1:])}")


def analyse(first: DataFrame, second: DataFrame, window: int = 50, factor: float = 100.0, least: int = 20) -> DataFrame:
    """Figures of each pair of centerlines that `first` and `second` (pair, seq, x, y, width, years) share.

    A row holds one pair. Small pairs are warped together; the matrix of a large one holds the product of both lengths.
    """
    one = _lines(first.select(F.col("pair").cast("long").alias("pair"), "seq", "x", "y", "width", F.col("years").cast("double").alias("years")), ["pair"], 1)
    # another name on the right: both sides may come from one table
    two = _lines(second.select(F.col("pair").cast("long").alias("other"), "seq", "x", "y", "width"), ["other"], 2)
    return _figures(one.join(two, F.col("pair") == F.col("other")), ["pair"], {"window": window, "factor": factor, "least": least})


def summary(points: DataFrame) -> DataFrame:
    """A row for each pair with the columns of a pair summary.

    points: (pair, seq, rate, width1, width2, lag, segment, stable, time_gap), and curv, date1 and date2 where there are
    any. Correlation and slope of rate on curvature are taken within stable segments; the correlations are averaged,
    the slopes weighted by length. Figures that are not defined are null.
    """
    for name, kind in (("curv", "double"), ("date1", "date"), ("date2", "date")):
        if name not in points.columns:
            points = points.withColumn(name, F.lit(None).cast(kind))
    calm = points.filter("stable").groupBy("pair", "segment").agg(F.count("curv").alias("n"), moment_ratio("curv", "rate", "curv", "rate").alias("r"), F.when(F.count("curv") > 5, moment_ratio("curv", "rate", "curv", "curv")).alias("k"))
    known = F.when(F.col("k").isNotNull(), F.col("n"))
    calm = calm.groupBy("pair").agg(F.count("*").alias("n_stable_segments"), F.avg("r").alias("r_curv_mr"), F.try_divide(F.sum(F.col("k") * known), F.sum(known)).alias("slope_curv_mr"))
    g = points.groupBy("pair").agg(
        F.avg(F.when(F.col("stable"), F.col("lag"))).alias("lag (m)"),
        F.percentile(F.abs("rate"), 0.9).alias("p90_mr (m/year)"),
        F.min("date1").alias("date1"),
        F.min("date2").alias("date2"),
        F.avg("width1").alias("width1"),
        F.avg("width2").alias("width2"),
        F.pow(moment_ratio("width1", "width2", "width1", "width2"), F.lit(2)).alias("r_squared_width"),
        moment_ratio("width1", "width2", "width1", "width1").alias("width_slope"),
        F.avg(F.when(F.col("stable"), 1.0).otherwise(0.0)).alias("stable_data_ratio"),
        F.min("time_gap").alias("time_gap"),
    )
    out = g.join(calm, "pair", "left").withColumn("n_stable_segments", F.coalesce("n_stable_segments", F.lit(0)))
    mean = (F.col("width1") + F.col("width2")) / 2
    out = out.withColumns({"r_squared_curv_mr": F.pow("r_curv_mr", F.lit(2)), "width_intercept (m)": F.col("width2") - F.col("width_slope") * F.col("width1"), "width_diff (m)": F.col("width2") - F.col("width1"), "mean_width (m)": mean})
    out = out.withColumns({"normalized_lag": F.try_divide(F.col("`lag (m)`"), mean), "normalized_mr (channel_widths/year)": F.try_divide(F.col("`p90_mr (m/year)`"), mean)})
    return out.withColumn("pair_class", pair_class(F.col("r_curv_mr"), F.col("width_slope"), F.col("normalized_lag")))


def labelled(groups: dict[str, DataFrame], river: str) -> DataFrame:
    """The summaries of several reaches in one frame: segment_label, segment_index in the order given, river_name."""
    out = None
    for k, (label, df) in enumerate(groups.items()):
        one = df.withColumns({"segment_label": F.lit(label), "segment_index": F.lit(k), "river_name": F.lit(river)})
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no groups")
    return out


def mean_lag(points: DataFrame, path: DataFrame, spacing: float, width: float) -> DataFrame:
    """(scene, seq, lag): mean lag of the matches of each vertex in a warping path (scene, p, q), in widths; NaN without one."""
    m = path.groupBy("scene", F.col("p").alias("seq")).agg((F.avg(F.col("p") - F.col("q")) * spacing / width).alias("lag"))
    return points.select("scene", "seq").join(m, ["scene", "seq"], "left").withColumn("lag", F.coalesce("lag", F.lit(float("nan"))))


def segment_groups(points: DataFrame, catalog: DataFrame, least_days: int, most_days: int, months: list[int] | None = None, **how: float) -> DataFrame:
    """Figures of each pair of scenes within each reach. points: (scene, segment, seq, x, y, width); catalog: (scene, acq).

    Pairs are at least and at most so many days apart, of scenes in the given months if there are any; a pair needs
    a path in both scenes.
    """
    dated = catalog if months is None else catalog.filter(F.month("acq").isin(months))
    there = points.select("scene", "segment").distinct().join(dated, "scene")
    a, b = (there.select("segment", F.col("scene").alias(f"scene{k}"), F.col("acq").alias(f"acq{k}")) for k in (1, 2))
    # a scene of a bucket of days meets those of its own and the next ones that the greatest gap reaches
    bucket = lambda c: F.floor(F.unix_date(c) / F.lit(most_days))
    a = a.withColumn("bucket", F.explode(F.array(bucket(F.col("acq1")), bucket(F.col("acq1")) + 1)))
    met = a.join(b.withColumn("bucket", bucket(F.col("acq2"))), ["segment", "bucket"]).withColumn("gap", F.datediff("acq2", "acq1")).filter(F.col("gap").between(least_days, most_days))
    met = met.select("segment", "scene1", "scene2", (F.col("gap") / 365.25).alias("years"))
    for k in (1, 2):
        met = met.join(_lines(points, ["segment", "scene"], k).withColumnRenamed("scene", f"scene{k}"), ["segment", f"scene{k}"])
    return _figures(met, ["segment", "scene1", "scene2", "years"], how)
