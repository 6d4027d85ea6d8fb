"""Column expressions: indices, coordinates, angles, dates and names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); NaN where both are zero, infinite where only the sum is."""
    a, b = a.cast("double"), b.cast("double")
    top, bottom = a - b, a + b
    inf = F.when(top > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when((a == 0) & (b == 0), F.lit(float("nan"))).when(bottom == 0, inf).otherwise(F.try_divide(top, bottom))


def above(v: Column, limit: float) -> Column:
    """1 where v exceeds the limit, else 0; NaN and null are land."""
    return F.when(~F.isnan(v) & (v > limit), 1).otherwise(0)


def to_uint8(v: Column) -> Column:
    """Scaled by 255, cut to an integer, wrapped to a byte."""
    return F.pmod((v * 255).cast("long"), F.lit(256)).cast("int")


def clear_sky(qa: Column) -> Column:
    """Cloud (bit 3) and cloud shadow (bit 4) are both unset."""
    return (qa.bitwiseAND(8) == 0) & (qa.bitwiseAND(16) == 0)


def to_utm(col: Column, row: Column, left: float, upper: float, dx: float, dy: float) -> tuple[Column, Column]:
    return F.lit(left + 0.5 * dx) + col * dx, F.lit(upper + 0.5 * dy) + row * dy


def closest_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """Nearest point of segment ab to p; a point segment is its own answer."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return ax + t * dx, ay + t * dy


def angle_between(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Radians between two vectors; NaN if one has no length."""
    size = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    cos = F.try_divide(ux * vx + uy * vy, size)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def extrapolated(ax: Column, ay: Column, bx: Column, by: Column, ratio: float) -> tuple[Column, Column]:
    return ax + (bx - ax) * ratio, ay + (by - ay) * ratio


def collection_of(year: Column) -> Column:
    """Landsat collection that serves a year."""
    return F.when(year < 2013, "LT05").when(year < 2021, "LC08").otherwise("LC09")


def index_bands(name: Column) -> Column:
    """(green, swir) band numbers by the scene name's prefix."""
    new = name.startswith("LC08") | name.startswith("LC09")
    return F.struct(F.when(new, 3).otherwise(2).alias("green"), F.when(new, 6).otherwise(5).alias("swir"))


def gaussian_weights(sigma: float) -> list[float]:
    """Weights of a Gaussian cut at four deviations; they sum to one."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian(values: Column, sigma: float) -> Column:
    """An array smoothed by a Gaussian, mirrored at its ends."""
    w = gaussian_weights(sigma)
    r, weights, n = len(w) // 2, F.array(*(F.lit(x) for x in w)), F.size(values)

    def at(j: Column) -> Column:
        m = F.pmod(j, 2 * n)
        return F.get(values, F.when(m < n, m).otherwise(2 * n - 1 - m))

    taps = F.sequence(F.lit(-r), F.lit(r))
    one = lambda i: F.aggregate(taps, F.lit(0.0), lambda acc, k: acc + F.get(weights, k + r) * at(i + k))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<double>"))


def numbers_between(start: Column, end: Column, places: int) -> Column:
    """Numbers of so many decimal places from the rounded start up to the end, that included; none if the start is beyond it."""
    scale = 10**places
    low, high = F.round(start, places) * scale, F.floor(F.round(end * scale, 6))
    low = F.round(low).cast("long")
    steps = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<long>"))
    return F.transform(steps, lambda k: F.round(k / F.lit(float(scale)), places))


def scene_date(name: Column) -> Column:
    """Date in characters 12 to 19 of a scene name."""
    return F.to_date(F.substring(name, 13, 8), "yyyyMMdd")


def iou(area_a: Column, area_b: Column, common: Column, smaller: bool = False) -> Column:
    """Common area over the union's, or over the smaller area; 0 where that is empty."""
    base = F.least(area_a, area_b) if smaller else area_a + area_b - common
    return F.coalesce(F.try_divide(common.cast("double"), base.cast("double")), F.lit(0.0))


def moment_ratio(x: Column | str, y: Column | str, a: Column | str, b: Column | str) -> Column:
    """Aggregate: covariance of x and y over the population deviations of a and b; null if a or b is constant.

    Merged partial variances of equal values need not be zero, so constants are told by their bounds.
    """
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b)))


def pair_class(r: Column, slope: Column, lag: Column, weak: float = 0.2, low: float = 0.8, high: float = 1.2, far: float = 5.0) -> Column:
    """Class of a scene pair, in this order: weak, reversed, stage mismatch, good, insufficient."""
    base = F.when(r >= weak, F.when(F.isnan(slope) | (slope < low) | (slope > high), "stage_mismatch").otherwise("good")).when(F.abs(r) < weak, "weak").otherwise("insufficient")
    return F.when(F.isnan(r) | r.isNull(), "insufficient").when(lag > far, "reversed").otherwise(base)
