"""Migration from curvature by upstream weighting, after Howard and Knutson (1984); from the paper, as there is no other text to derive it from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nominal_rate(curvature: Column, width: Column, rate: float) -> Column:
    """Rate that a bend's own curvature would give: it grows with curvature measured in widths."""
    return curvature * width * rate


def predicted_rate(points: DataFrame, decay: Column | float, omega: float = -1.0, gamma: float = 2.5) -> DataFrame:
    """(scene, seq, predicted): omega times the nominal rate and gamma times its upstream mean, weighted by exp(-decay * distance).

    points: (scene, seq, s, nominal), s growing downstream. The weighted sums of a vertex follow from those of the one
    before it, so a path is one pass over its array; decay is 2 k Cf / depth for a friction factor Cf.
    """
    decay = F.lit(decay) if isinstance(decay, float) else decay
    p = points.withColumn("_k", decay.cast("double"))
    rows = p.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("s").cast("double").alias("s"), F.col("nominal").cast("double").alias("r"), F.col("_k").alias("k")))).alias("v"))
    empty = F.expr("named_struct('s', cast(null as double), 'top', 0.0D, 'bottom', 0.0D, 'out', cast(array() as array<struct<seq:bigint,m:double>>))")

    def step(acc: Column, x: Column) -> Column:
        fade = F.coalesce(F.exp(-x["k"] * (x["s"] - acc["s"])), F.lit(0.0))
        top, bottom = acc["top"] * fade + x["r"], acc["bottom"] * fade + 1.0
        out = F.concat(acc["out"], F.array(F.struct(x["seq"].cast("long").alias("seq"), (top / bottom).alias("m"))))
        return F.struct(x["s"].alias("s"), top.alias("top"), bottom.alias("bottom"), out.alias("out"))

    upstream = rows.select("scene", F.explode(F.aggregate("v", empty, step)["out"]).alias("o")).select("scene", "o.seq", "o.m")
    return points.select("scene", "seq", "nominal").join(upstream, ["scene", "seq"]).select("scene", "seq", (omega * F.col("nominal") + gamma * F.col("m")).alias("predicted"))


def residuals(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """(scene, seq, residual): observed less predicted rates, where both are."""
    return observed.join(predicted, ["scene", "seq"]).select("scene", "seq", (F.col("observed") - F.col("predicted")).alias("residual"))
