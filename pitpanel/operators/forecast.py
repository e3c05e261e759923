"""The frozen return model: boosted medians in units of volatility, a scale and a floor chosen before the sealed dates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import written
from ..functions.expressions import clamp
from .boosting import fit_quantiles
from .gram import CLIP, LEAST_VOL, intercept_mode
from .models import crash_classifier, probability
from .validate import shape_prediction

#: Floors of a forecast in units of volatility; next-session forecasts may have the first two only, and no larger scale.
FLOORS, NEXT_FLOOR, NEXT_SCALE = (0.0, 0.04, 0.08, 0.12, 0.16, 0.20, 0.25), 0.04, 0.85


def scale_grid(h: int, low: float = 0.20, high: float = 2.0, steps: int = 30) -> tuple[list[float], list[float]]:
    """K24 the scales and floors that a horizon may choose from."""
    scales = [float(x) for x in np.linspace(low, min(high, NEXT_SCALE) if h == 1 else high, steps)]
    return scales, [f for f in FLOORS if h != 1 or f <= NEXT_FLOOR]


def dispersion_scale(df: DataFrame, y: str, r: str, p_up: str, vol: str, h: int) -> DataFrame:
    """K24 scale, floor, mae, se, dispersion, over10bp and chosen, for every scale and conviction floor of the forecast r.

    Forecasts are shaped (K33) with each pair and summed over the calibration rows. Of the pairs within one standard
    error of the least error that with the widest forecasts is chosen (dispersion, then the share beyond 10 basis points,
    the floor, the scale); at three sessions the best itself. One pass; a row a pair is left.
    """
    scales, floors = scale_grid(h)
    d = df.filter(f"{y} is not null and {r} is not null and {p_up} is not null and {vol} is not null").select(F.col(y).alias("_y"), F.col(r).alias("_r"), F.col(p_up).alias("_p"), F.col(vol).alias("_v"))
    each = d.withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    shaped = F.array(*[F.struct(F.lit(f).alias("floor"), F.col(f"_f{i}").alias("point")) for i, f in enumerate(floors)])
    for i, f in enumerate(floors):
        each = shape_prediction(each.withColumn("_s", F.col("_r") * F.col("scale")), "_s", "_p", "_v", 1.0, f).withColumnRenamed("shaped", f"_f{i}")
    each = each.select("_y", "scale", F.explode(shaped).alias("s"))
    loss = F.abs(F.col("_y") - F.col("s.point"))
    t = each.groupBy("scale", "s.floor").agg(
        F.avg(loss).alias("mae"), (F.stddev_samp(loss) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("se"), (F.stddev_pop("s.point") / F.greatest(F.stddev_pop("_y"), F.lit(1e-12))).alias("dispersion"),
        F.avg((F.abs("s.point") >= 0.001).cast("double")).alias("over10bp"),
    )
    every = Window.partitionBy()  # a row per pair
    t = t.withColumns({c: F.round(c, 12) for c in ("mae", "se", "dispersion", "over10bp")}).withColumn("_best", F.min(F.struct("mae", "scale", "floor", "se")).over(every))
    near = F.when(F.col("mae") <= F.col("_best.mae") + F.col("_best.se"), F.struct("dispersion", "over10bp", "floor", "scale"))
    chosen = F.when(F.lit(h == 3), (F.col("scale") == F.col("_best.scale")) & (F.col("floor") == F.col("_best.floor"))).otherwise(F.coalesce(near == F.max(near).over(every), F.lit(False)))
    return t.withColumn("chosen", chosen).drop("_best")


def market_model(fit: DataFrame, calibrate: DataFrame, rows: DataFrame, features: list[str], y: str, vol: str, h: int, rounds: int = 155, rate: float = 0.065, depth: int = 4, least: int = 180, l2: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """K32 (rows with point, low, high, magnitude and p_up; the frozen choices) of a model of `fit`, frozen on `calibrate`.

    The outcome in units of vol (at least .004, held in +-4) is fitted by trees on absolute error, its size by others,
    P(up) by boosted trees on log loss. The horizon's share of the date's median forecast is taken out (intercept mode).
    On the calibration rows the scale and floor (K24), the residuals' 20 % and 80 % quantiles and the magnitude's scale
    (ratio of medians, held in .5 to 2) are chosen; no later label is used. Rows without features or vol have no point.
    """
    v, z = F.greatest(F.col(vol).cast("double"), F.lit(LEAST_VOL)), F.col(y).cast("double")
    train = written(fit.filter(f"{y} is not null and {vol} is not null").withColumns({"_z": clamp(z / v, -CLIP, CLIP), "_size": clamp(F.abs(z) / v, 0, CLIP), "_up": (z > 0).cast("double")}))
    options = {"rounds": rounds, "rate": rate, "depth": depth, "least": least, "l2": l2}
    point = fit_quantiles(train, features, "_z", (0.5,), **options)
    size = fit_quantiles(train, features, "_size", (0.5,), **options)
    up = crash_classifier(train.select(*features, "_up"), features, "_up", "boosted")

    def raw(df: DataFrame) -> DataFrame:
        out = size.transform(point.transform(df.filter(F.col(vol).isNotNull()), ["_point"]), ["_size"])
        out = probability(up, out, features, "p_up").withColumn("_v", v)
        return written(out.withColumns({"_r": intercept_mode(F.col("_point") * F.col(vol), h, ["date"]), "_m": clamp(F.col("_size"), 0.02, 4.0) * F.col(vol)}))

    known = raw(calibrate).filter(F.col(y).isNotNull())
    choice = dispersion_scale(known, y, "_r", "p_up", vol, h).filter("chosen").first()
    scale, floor = (choice["scale"], choice["floor"]) if choice else (1.0, 0.0)
    shaped = lambda df: shape_prediction(df, "_r", "p_up", vol, scale, floor).withColumnRenamed("shaped", "point")
    sizes = known.agg(F.median(F.abs(F.col(y))).alias("y"), F.median("_m").alias("m")).first()
    stretch = min(2.0, max(0.5, sizes["y"] / max(sizes["m"], 1e-12))) if sizes["m"] is not None else 1.0
    low, high = (shaped(known).agg(F.percentile((F.col(y) - F.col("point")) / F.col("_v"), [0.2, 0.8])).first()[0]) or (0.0, 0.0)
    out = shaped(raw(rows)).withColumns({"low": F.col("point") + low * F.col(vol), "high": F.col("point") + high * F.col(vol), "magnitude": stretch * F.col("_m")})
    frozen = fit.sparkSession.createDataFrame([(scale, floor, float(low), float(high), float(stretch))], "scale double, floor double, q20 double, q80 double, magnitude_scale double")
    return out.select(*rows.columns, "point", "low", "high", "magnitude", "p_up"), frozen
