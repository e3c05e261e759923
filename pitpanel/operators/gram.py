"""Ridge regression from sums of products: block-wise Gram matrices, added up instead of reading the panel again.

Spark adds up 1, x and y times one another by block; a row a block, of a size that depends on the features alone,
reaches the driver. Any set of blocks is then fitted by adding their matrices and solving one small system.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import clamp
from .validate import date_places


def gram(df: DataFrame, key: str, features: list[str], y: str) -> dict[int, np.ndarray]:
    """By key (few whole numbers): the matrix of sums of products of (1, features, y) over rows without nulls in them."""
    v = [F.lit(1.0), *[F.col(c).cast("double") for c in (*features, y)]]
    at = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    whole = df.dropna(subset=[*features, y])
    out = {}
    for r in whole.groupBy(key).agg(*[F.sum(v[i] * v[j]).alias(f"s{i}_{j}") for i, j in at]).collect():
        m = np.zeros((len(v), len(v)))
        for i, j in at:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[int(r[key])] = m
    return out


def ridge(m: np.ndarray, columns: list[int], penalty: float, scaled: bool = False) -> tuple[float, np.ndarray]:
    """Intercept and weights of the ridge fit of y on some columns (from 0) of a Gram matrix; the intercept is free.

    With `scaled` the penalty applies to features of deviation 1 and grows with the rows, as MLlib's does.
    """
    at = np.array(columns) + 1
    n, mean, y_mean = m[0, 0], m[0, at] / m[0, 0], m[0, -1] / m[0, 0]
    xx = m[np.ix_(at, at)] - n * np.outer(mean, mean)
    xy = m[at, -1] - n * mean * y_mean
    sd = np.sqrt(np.maximum(np.diag(xx), 0) / n) if scaled else np.ones(len(at))
    sd = np.where(sd > 1e-12, sd, 1.0)
    w = np.linalg.solve(xx / np.outer(sd, sd) + (n if scaled else 1.0) * penalty * np.eye(len(at)), xy / sd) / sd
    return float(y_mean - w @ mean), w


# ---- K29 ---------------------------------------------------------------------------------------------------------


def date_ics(df: DataFrame, features: list[str], y: str, weights: np.ndarray, least_names: int = 12) -> DataFrame:
    """date, block, ics: the rank correlation of y with each of many linear scores (rows of weights), by date; NaN without one.

    A task holds one date's names and 64 scores of them at a time. Constant scores and dates of fewer names have none.
    """
    known = df.sparkSession.sparkContext.broadcast(weights)  # of a size that the number of splits sets

    def day(rows: pd.DataFrame) -> pd.DataFrame:
        ics = np.full(len(known.value), np.nan)
        if len(rows) >= least_names and np.std(rows[y]) > 1e-12:
            x, a = rows[features].to_numpy(np.float64), rows[y].rank().to_numpy()
            for i in range(0, len(ics), 64):
                p = x @ known.value[i : i + 64].T
                b = pd.DataFrame(np.round(p, 12)).rank().to_numpy()
                with np.errstate(all="ignore"):
                    r = ((a - a.mean()) @ (b - b.mean(axis=0))) / (len(a) * a.std() * b.std(axis=0))
                ics[i : i + 64] = np.where(p.std(axis=0) > 1e-12, r, np.nan)
        return pd.DataFrame({"date": rows["date"].iloc[:1], "block": rows["block"].iloc[:1], "ics": [ics]})

    return df.select("date", "block", y, *features).groupBy("date").applyInPandas(day, "date date, block int, ics array<double>")


def pbo_splits(df: DataFrame, candidates: list[list[str]], y: str, blocks: int = 8, penalty: float = 20.0, least_dates: int = 40, least_rows: int = 500) -> DataFrame:
    """K29 a row for each split of the date blocks in halves: split, train_blocks, selected, selected_is, selected_oos, percentile, rank_corr.

    Each candidate is a set of predictions, stacked by ridge. Every stack is fitted again on the split's training half,
    from the blocks' Gram matrices, and judged by the mean daily rank correlation on both halves. The candidate best in
    sample (the first of equals) has a percentile among the out-of-sample results; rank_corr says how both orders agree
    (three candidates and more). Rows with a null prediction or y are left out; too few dates or rows give no splits.
    """
    features = sorted({f for c in candidates for f in c})
    rows = df.select("date", F.col(y).cast("double").alias(y), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    days = date_places(rows).withColumn("block", F.ntile(blocks).over(Window.orderBy("date")) - 1).filter(F.col("dates") >= least_dates)  # a row per date
    rows = rows.join(days.select("date", "block"), "date")
    grams = gram(rows, "block", features, y)
    splits, plan = [], []
    for train in combinations(range(blocks), blocks // 2):
        m, rest = (sum((grams[b] for b in range(blocks) if (b in train) == inside and b in grams), np.zeros((len(features) + 2,) * 2)) for inside in (True, False))
        if min(m[0, 0], rest[0, 0]) < least_rows:
            continue
        for k, c in enumerate(candidates):
            w = np.zeros(len(features))
            at = [features.index(f) for f in c]
            w[at] = ridge(m, at, penalty)[1]
            plan.append(w)
            splits.append((len(plan) - 1, len(plan) // len(candidates) if k == len(candidates) - 1 else len(plan) // len(candidates) + 1, k, list(train)))
    spark = df.sparkSession
    named = spark.createDataFrame(splits, "at int, split int, candidate int, train_blocks array<int>")
    ics = date_ics(rows, features, y, np.array(plan).reshape(-1, len(features)))
    daily = ics.select("block", F.posexplode("ics").alias("at", "ic")).filter(~F.isnan("ic")).groupBy("block", "at").agg(F.sum("ic").alias("s"), F.count("ic").alias("n"))
    j = named.join(daily, "at", "left").withColumn("_in", F.array_contains("train_blocks", F.col("block")))
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.when(c, F.col("s"))), F.sum(F.when(c, F.col("n")))), F.lit(0.0))
    each = j.groupBy("split", "candidate", "train_blocks").agg(F.round(mean(F.col("_in")), 12).alias("ins"), F.round(mean(~F.col("_in")), 12).alias("outs"))
    per = Window.partitionBy("split")  # a row per candidate
    ties = lambda x: F.rank().over(per.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy("split", x)) - 1) / 2.0
    each = each.withColumns({"_place": F.row_number().over(per.orderBy("outs", "candidate")) - 1, "_best": F.row_number().over(per.orderBy(F.desc("ins"), "candidate")), "_a": ties("ins"), "_b": ties("outs")})
    best = F.max_by(F.struct("candidate", "ins", "outs", "_place"), F.when(F.col("_best") == 1, 1).otherwise(0))
    out = each.groupBy("split", "train_blocks").agg(best.alias("b"), F.corr("_a", "_b").alias("rank_corr"))
    names = F.array(*[F.lit("+".join(c)) for c in candidates])
    corr = F.when(F.lit(len(candidates) >= 3) & ~F.isnan("rank_corr"), F.col("rank_corr"))
    return out.select("split", "train_blocks", names[F.col("b.candidate")].alias("selected"), F.col("b.ins").alias("selected_is"), F.col("b.outs").alias("selected_oos"), ((F.col("b._place") + 0.5) / len(candidates)).alias("percentile"), corr.alias("rank_corr"))


def pbo_refitted(splits: DataFrame) -> DataFrame:
    """K29 of pbo_splits(): splits, pbo (how often the winner lies below the median out of sample), median_rank_corr, median_percentile, generalizes.

    Generalizes: 30 splits or more, pbo at most 0.5, median_rank_corr not below 0. Without splits pbo is 1.
    """
    s = splits.agg(F.count(F.lit(1)).alias("splits"), F.coalesce(F.avg((F.col("percentile") < 0.5).cast("double")), F.lit(1.0)).alias("pbo"), F.median("rank_corr").alias("median_rank_corr"), F.median("percentile").alias("median_percentile"))
    return s.withColumn("generalizes", (F.col("splits") >= 30) & (F.col("pbo") <= 0.5) & (F.coalesce("median_rank_corr", F.lit(0.0)) >= 0))


# ---- K30 ---------------------------------------------------------------------------------------------------------

#: What share of the market-wide part of a forecast stays, by horizon; all elsewhere.
RETENTION = {2: 0.25, 3: 0.0}
LEAST_VOL, CLIP = 0.004, 4.0


def intercept_mode(point: Column, h: int, by: list[str]) -> Column:
    """K32 a forecast less the median of its date (`by`), of which the horizon's share is put back."""
    share = RETENTION.get(h, 1.0)
    return point if share == 1.0 else point - (1 - share) * F.median(point).over(Window.partitionBy(*by))


def folds_of(dates: list, span: int, calibration: int, test: int, folds: int = 3) -> list[tuple]:
    """K30 (calibration start, test start, test end) of each fold, of the ordered dates."""
    starts = [int(x) for x in np.linspace(len(dates) - span, len(dates) - test, folds)]
    if not starts or starts[0] < calibration:
        return []
    return [(dates[s - calibration], dates[s], dates[min(len(dates), s + test) - 1]) for s in starts]


def walk_forward(df: DataFrame, features: list[str], y: str, vol: str, matures: str, h: int = 5, span: int = 240, calibration: int = 60, test: int = 45, penalty: float = 0.1, folds: int = 3) -> tuple[DataFrame, DataFrame]:
    """K30 (forecasts, scales): an expanding walk-forward, refitted at each origin, over a panel (symbol, date, ...).

    Fold by fold: a ridge model of y / vol (held in +-4) on all dates before a calibration window whose labels had
    matured by then; the window sets what is frozen for the test dates after it: intercept mode by horizon, the scale
    (the lower quartile of the best scales of four blocks of its dates) and the 20 % and 80 % residuals in units of vol.
    Training rows are summed by the first fold that may use them, once, and each origin is solved from the running sum.

    forecasts: fold, symbol, date, y, point, low, high of the test rows with features; scales: fold, calibration_start,
    test_start, test_end, rows, scale, q20, q80. Too short a history gives no folds.
    """
    if RETENTION.get(h, 1.0) not in (0.0, 0.25, 1.0):
        raise ValueError("no retention for this horizon")
    d = df.dropna(subset=[*features, vol]).withColumns({f: F.col(f).cast("double") for f in features}).withColumn("_v", F.greatest(F.col(vol).cast("double"), F.lit(LEAST_VOL)))
    dates = [r["date"] for r in df.filter(F.col(y).isNotNull()).select("date").distinct().orderBy("date").collect()]  # a row per session
    windows = folds_of(dates, span, calibration, test, folds)
    spark = df.sparkSession
    if not windows:
        return spark.createDataFrame([], "fold int, symbol long, date date, y double, point double, low double, high double"), spark.createDataFrame([], "fold int, calibration_start date, test_start date, test_end date, rows long, scale double, q20 double, q80 double")
    known = F.greatest("date", matures)  # when a training row is complete
    first = sum((F.when(known >= F.lit(a), 1).otherwise(0) for a, _, _ in windows), F.lit(0))
    z = clamp(F.col(y) / F.col("_v"), -CLIP, CLIP)
    grams = gram(d.filter(F.col(matures).isNotNull()).select(*features, z.alias("_z"), first.alias("_first")).filter(F.col("_first") < len(windows)), "_first", features, "_z")
    total, fits = np.zeros((len(features) + 2,) * 2), []
    for k in range(len(windows)):
        total = total + grams.get(k, 0.0)
        fits.append((*ridge(total, list(range(len(features))), penalty, scaled=True), int(total[0, 0])) if total[0, 0] > len(features) else (0.0, np.zeros(len(features)), 0))
    parts = []
    for k, (a, b, c) in enumerate(windows):
        point = F.lit(fits[k][0]) + sum((float(w) * F.col(f) for w, f in zip(fits[k][1], features, strict=True)), F.lit(0.0))
        part = F.when((F.col("date") >= F.lit(a)) & (F.col("date") < F.lit(b)) & (F.col(matures) < F.lit(b)), "calibrate").when(F.col("date").between(F.lit(b), F.lit(c)), "test")
        parts.append(F.struct(F.lit(k + 1).alias("fold"), part.alias("part"), (point * F.col("_v")).alias("raw")))
    rows = d.filter(F.col("date") >= F.lit(windows[0][0])).withColumn("_p", F.explode(F.array(*parts))).select("symbol", "date", F.col(y).cast("double").alias("y"), "_v", "_p.*").filter("part is not null and y is not null")
    rows = rows.withColumn("raw", intercept_mode(F.col("raw"), h, ["fold", "part", "date"]))
    cal = rows.filter("part = 'calibrate'")
    days = cal.select("fold", "date").distinct().withColumn("block", F.ntile(4).over(Window.partitionBy("fold").orderBy("date")))
    grid = [float(x) for x in np.linspace(0.10, 0.85 if h == 1 else 1.6, 25)]
    tried = cal.join(days, ["fold", "date"]).withColumn("scale", F.explode(F.array(*map(F.lit, grid)))).groupBy("fold", "block", "scale").agg(F.avg(F.abs(F.col("y") - F.col("raw") * F.col("scale"))).alias("mae"))
    best = tried.groupBy("fold", "block").agg(F.min(F.struct(F.round("mae", 12).alias("mae"), "scale")).alias("b"))
    frozen = best.groupBy("fold").agg(F.percentile("b.scale", 0.25).alias("scale"))  # of four blocks
    residual = cal.join(frozen, "fold").withColumn("_r", (F.col("y") - F.col("raw") * F.col("scale")) / F.col("_v"))
    quantiles = residual.groupBy("fold").agg(F.percentile("_r", 0.2).alias("q20"), F.percentile("_r", 0.8).alias("q80"))
    info = spark.createDataFrame([(k + 1, *w, fits[k][2]) for k, w in enumerate(windows)], "fold int, calibration_start date, test_start date, test_end date, rows long")
    scales = info.join(frozen, "fold", "left").join(quantiles, "fold", "left")
    out = rows.filter("part = 'test'").join(scales.select("fold", "scale", "q20", "q80"), "fold").withColumn("point", F.col("raw") * F.col("scale"))
    return out.select("fold", "symbol", "date", "y", "point", (F.col("point") + F.col("q20") * F.col("_v")).alias("low"), (F.col("point") + F.col("q80") * F.col("_v")).alias("high")), scales


def fold_metrics(forecasts: DataFrame, least_names: int = 12) -> DataFrame:
    """K30 by fold: rows, mae, base_mae (of no change), mae_skill, rank_ic (mean of daily rank correlations), coverage of [low, high]."""
    from .validate import daily_rank_ic

    d = forecasts.filter("y is not null and point is not null")
    ic = daily_rank_ic(d.withColumn("date", F.struct("fold", "date")), "y", "point", least_names).groupBy(F.col("date.fold").alias("fold")).agg(F.avg("ic").alias("rank_ic"), F.count("ic").alias("days"))
    mae, base = F.avg(F.abs(F.col("y") - F.col("point"))), F.avg(F.abs("y"))
    m = d.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), mae.alias("mae"), base.alias("base_mae"), (1 - mae / F.greatest(base, F.lit(1e-12))).alias("mae_skill"), F.avg(F.col("y").between(F.col("low"), F.col("high")).cast("double")).alias("coverage"))
    return m.join(ic, "fold", "left")
