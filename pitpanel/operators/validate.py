"""Chronological validation: splits, purging, metrics, calibration maps, bootstraps, gates. All are joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import written
from ..functions.expressions import average_rank, ntile_of, ordered_totals
from ..functions.quantiles import exact_quantiles


def date_places(df: DataFrame) -> DataFrame:
    """date, place (from 0), dates: the ordered dates of a panel; a row per date."""
    d = df.select("date").distinct()
    return d.withColumn("place", F.row_number().over(Window.orderBy("date")) - 1).withColumn("dates", F.count(F.lit(1)).over(Window.partitionBy()))


#: Fold, and the date fractions at which training, calibration and test end (purge gaps follow).
FOLDS = ((1, 0.40, 0.50, 0.60), (2, 0.50, 0.60, 0.70), (3, 0.60, 0.70, 0.85), (4, 0.70, 0.85, 1.00))


def chrono_split(df: DataFrame, purge: int = 5, folds: tuple = FOLDS) -> DataFrame:
    """K1 date, fold, part (train, calibrate, test) for each fold; `purge` dates before each boundary are left out."""
    d = date_places(df)
    out = []
    for fold, a, b, c in folds:
        x, y, z = (F.floor(F.col("dates") * s) for s in (a, b, c))
        part = F.when(F.col("place") < x - purge, "train").when((F.col("place") >= x) & (F.col("place") < y - purge), "calibrate").when((F.col("place") >= y) & (F.col("place") < z), "test")
        out.append(d.select("date", F.lit(fold).alias("fold"), part.alias("part")).filter("part is not null"))
    return reduce(DataFrame.unionByName, out)


def maturity_purge(train: DataFrame, matures: str, test_start: str) -> DataFrame:
    """K2 training rows whose label had matured before the test began."""
    return train.filter(F.col(matures) < F.lit(test_start).cast("date"))


def embargo_blocks(df: DataFrame, h: int) -> DataFrame:
    """K3 date, block: fit to 80 %, point to 85 %, conformal to 90 %, sealed after; each of the first three ends h dates early."""
    d = date_places(df)
    f = lambda s: F.floor(F.col("dates") * s)
    p = F.col("place")
    block = F.when(p < f(0.80) - h, "fit").when((p >= f(0.80)) & (p < f(0.85) - h), "point").when((p >= f(0.85)) & (p < f(0.90) - h), "conformal").when(p >= f(0.90), "sealed")
    return d.select("date", block.alias("block")).filter("block is not null")


def binary_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """K9 confusion, precision, recall, false-positive rate, F1, base rate, enrichment; K13 MCC and balanced accuracy."""
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    c = df.filter(f"{y} is not null and {p} is not null").groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    d = lambda a, b: F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    base = d(tp + fn, tp + fp + fn + tn)
    return c.withColumns({"precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "fpr": d(fp, fp + tn), "f1": d(2 * tp, 2 * tp + fp + fn), "base_rate": base, "enrichment": d(d(tp, tp + fp), base), "mcc": d(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "balanced_accuracy": (d(tp, tp + fn) + d(tn, tn + fp)) / 2})


def areas(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """K10 and K11 in one ordered pass: auc (Mann-Whitney, average ranks) and pr_auc (equal scores form one step)."""
    t = df.filter(f"{y} is not null and {score} is not null").groupBy(*by, score).agg(F.sum((F.col(y) == 1).cast("long")).alias("_p"), F.sum((F.col(y) != 1).cast("long")).alias("_n"))
    t = ordered_totals(t, [score], {"_p_upto": F.col("_p"), "_n_upto": F.col("_n")}, tuple(by))
    t = t.join(t.groupBy(*by).agg(F.sum("_p").alias("_all_p"), F.sum("_n").alias("_all_n")), by)
    hits, rows = F.col("_all_p") - F.col("_p_upto") + F.col("_p"), F.col("_all_p") + F.col("_all_n") - F.col("_p_upto") - F.col("_n_upto") + F.col("_p") + F.col("_n")
    auc = F.try_divide(F.sum(F.col("_p") * (F.col("_n_upto") - F.col("_n") / 2.0)), F.nullif(F.first("_all_p") * F.first("_all_n"), F.lit(0)).cast("double"))
    pr = F.try_divide(F.sum(F.col("_p") * hits / rows), F.nullif(F.first("_all_p"), F.lit(0)).cast("double"))
    return t.groupBy(*by).agg(auc.alias("auc"), pr.alias("pr_auc"))


def roc_auc(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """K10 Mann-Whitney area with average ranks, from counts of equal scores: no row is ranked alone."""
    t = df.filter(f"{y} is not null and {score} is not null").groupBy(*by, score).agg(F.sum((F.col(y) == 1).cast("long")).alias("_p"), F.sum((F.col(y) != 1).cast("long")).alias("_n"))
    t = ordered_totals(t, [score], {"_b": F.col("_n")}, tuple(by)).withColumn("_b", F.col("_b") - F.col("_n"))
    return t.groupBy(*by).agg(F.try_divide(F.sum(F.col("_p") * (F.col("_b") + F.col("_n") / 2.0)), F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0)).cast("double")).alias("auc"))


def pr_auc(df: DataFrame, by: list[str], y: str = "y", score: str = "score", tie: str | None = None) -> DataFrame:
    """K11 average precision; equal scores form one step, or (with `tie`, an ordering column) one step a row."""
    t = df.filter(f"{y} is not null and {score} is not null").withColumn("_down", -F.col(score).cast("double"))
    if tie:
        t = t.withColumns({"_p": (F.col(y) == 1).cast("long"), "_c": F.lit(1)})
    else:
        t = t.groupBy(*by, "_down").agg(F.sum((F.col(y) == 1).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_c"))
    t = ordered_totals(t, ["_down", *([tie] if tie else [])], {"_hits": F.col("_p"), "_rows": F.col("_c")}, tuple(by))
    return t.groupBy(*by).agg(F.try_divide(F.sum(F.col("_p") * F.col("_hits") / F.col("_rows")), F.nullif(F.sum("_p"), F.lit(0)).cast("double")).alias("pr_auc"))


def brier(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """K12 Brier score and its skill against the base rate."""
    b = F.avg(F.pow(F.col(p) - F.col(y), 2))
    base = F.avg(F.col(y).cast("double"))
    return df.filter(f"{y} is not null and {p} is not null").groupBy(*by).agg(b.alias("brier"), (1 - F.try_divide(b, F.nullif(base * (1 - base), F.lit(0.0)))).alias("brier_skill"))


def ece(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10, equal_count: bool = False, key: str = "id") -> DataFrame:
    """K12 calibration error over bins of equal width or count, with the bins' rows; K19 the same table as risk buckets (rate, lift, bounds)."""
    d = df.filter(f"{y} is not null and {p} is not null")
    if equal_count:
        d = ordered_totals(d.select(y, p, key), [p, key], {"_place": F.lit(1)})
        d = d.crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("_n"))))
    bin_ = ntile_of(F.col("_place"), F.col("_n"), bins) if equal_count else F.least(F.floor(F.col(p) * bins) + 1, F.lit(bins)).cast("int")
    t = d.withColumn("bin", bin_).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("rate"), F.avg(p).alias("mean_p"), F.min(p).alias("low"), F.max(p).alias("high"))
    every = Window.partitionBy()
    base = F.sum(F.col("rate") * F.col("n")).over(every) / F.sum("n").over(every)
    return t.withColumns({"lift": F.try_divide("rate", F.nullif(base, F.lit(0.0))), "ece": F.sum(F.abs(F.col("rate") - F.col("mean_p")) * F.col("n")).over(every) / F.sum("n").over(every)})


def cost_threshold(df: DataFrame, y: str = "y", score: str = "score", digits: int = 4, miss: float = 2.0) -> DataFrame:
    """K8 the threshold, among distinct rounded scores, of the least (miss x FN + FP) / n; the larger of equals."""
    t = df.filter(f"{y} is not null and {score} is not null").groupBy(F.round(score, digits).alias("threshold")).agg(F.sum((F.col(y) == 1).cast("long")).alias("_p"), F.sum((F.col(y) != 1).cast("long")).alias("_n"))
    up, every = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    cost = (miss * (F.sum("_p").over(every) - F.sum("_p").over(up)) + F.sum("_n").over(up)) / (F.sum("_p").over(every) + F.sum("_n").over(every))
    return t.withColumn("cost", F.round(cost, 10)).agg(F.min(F.struct("cost", (-F.col("threshold")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.cost").alias("cost"))


def utility_threshold(df: DataFrame, y: str = "y", score: str = "score", grid: tuple[int, ...] = tuple(range(45, 81, 5))) -> DataFrame:
    """K8 by threshold of a grid of scores (0-100): F1, recall, precision, false-positive rate, their utility, and which is chosen (the lowest of the best)."""
    t = df.filter(f"{y} is not null and {score} is not null").select(F.explode(F.array(*[F.lit(g) for g in grid])).alias("threshold"), (F.col(y) == 1).alias("_e"), F.col(score).alias("_s")).withColumn("_w", F.col("_s") >= F.col("threshold"))
    n = lambda c: F.count_if(c).cast("double")
    e, w = F.col("_e"), F.col("_w")
    rate = lambda a, b: F.coalesce(F.try_divide(n(a), F.nullif(n(b), F.lit(0.0))), F.lit(0.0))
    r = t.groupBy("threshold").agg(rate(e & w, w).alias("precision"), rate(e & w, e).alias("recall"), rate(~e & w, ~e).alias("fpr"))
    p, q = F.col("precision"), F.col("recall")
    r = r.withColumn("f1", F.when(p + q > 0, 2 * p * q / (p + q)))
    u = F.round(F.coalesce("f1", F.lit(-1.0)) + 0.08 * q + 0.04 * p - 0.03 * F.col("fpr"), 12)
    return r.withColumn("utility", u).withColumn("chosen", F.col("threshold") == F.min_by("threshold", F.struct(-F.col("utility"), F.col("threshold"))).over(Window.partitionBy()))


def regression_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """K14 MAE, RMSE, skill against 0, dispersion and 90 % ratios, R2, calibration slope and intercept, rows."""
    e = F.abs(F.col(y) - F.col(p))
    d = df.filter(f"{y} is not null and {p} is not null")
    r = F.corr(y, p)
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.avg(e), F.avg(F.abs(y)))).alias("skill"), F.try_divide(F.stddev_pop(p), F.nullif(F.stddev_pop(y), F.lit(0.0))).alias("dispersion_ratio"), F.try_divide(F.percentile(F.abs(p), 0.9), F.nullif(F.percentile(F.abs(y), 0.9), F.lit(0.0))).alias("p90_ratio"), (r * r).alias("r2"), F.regr_slope(y, p).alias("slope"), F.regr_intercept(y, p).alias("intercept"))


def daily_rank_ic(df: DataFrame, y: str = "y", score: str = "score", least: int = 12) -> DataFrame:
    """K15 Spearman correlation of each date with enough names (average ranks)."""
    d = df.filter(f"{y} is not null and {score} is not null")
    d = d.withColumn("_a", average_rank(y, ["date"])).withColumn("_b", average_rank(score, ["date"]))
    return d.groupBy("date").agg(F.corr("_a", "_b").alias("ic"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & F.col("ic").isNotNull() & ~F.isnan("ic"))


def ic_summary(ic: DataFrame) -> DataFrame:
    """K15 mean, deviation, t and share of positive days."""
    sd = F.stddev_samp("ic")
    return ic.agg(F.count("ic").alias("days"), F.avg("ic").alias("mean_ic"), sd.alias("sd_ic"), F.try_divide(F.avg("ic") * F.sqrt(F.count("ic").cast("double")), F.nullif(sd, F.lit(0.0))).alias("t_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_days"))


def _draw(n: Column, *keys: Column | str) -> Column:
    """A reproducible draw from 0 to n - 1."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", *keys).cast("binary")), 1, 8), 16, 10).cast("long"), n)


def bootstrap(daily: DataFrame, x: str, replicates: int = 200, block: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """K16 whole dates drawn again, K17 in blocks of neighbouring dates: mean, 5 %, 50 % and 95 % of the replicates' mean of x.

    daily has a row per date, and per key where `by` names one. Draws are hashes of replicate and place, so reruns and engines agree.
    """
    d = daily.filter(F.col(x).isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("date")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    slots = d.select(*by, F.col("place").alias("slot"), "n").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    start = _draw(F.col("n"), F.col("rep").cast("string"), F.floor(F.col("slot") / block).cast("string"))
    asked = slots.withColumn("place", F.pmod(start + F.col("slot") % block, F.col("n")).cast("int")).select(*by, "rep", "place")
    reps = asked.join(d.select(*by, "place", F.col(x).alias("_x")), [*by, "place"]).groupBy(*by, "rep").agg(F.avg("_x").alias("m"))
    return reps.groupBy(*by).agg(F.count(F.lit(1)).alias("replicates"), F.avg("m").alias("mean"), F.percentile("m", 0.05).alias("q05"), F.percentile("m", 0.5).alias("q50"), F.percentile("m", 0.95).alias("q95"))


def bootstrap_precision(df: DataFrame, unit: str, replicates: int = 200, block: int = 1, y: str = "y", score: str = "score", least: int = 20) -> DataFrame:
    """K16, K17 average precision over whole units drawn again (dates, or symbols as clusters), or over runs of `block` neighbouring units: 2.5 %, 50 % and 97.5 % of the replicates.

    Each unit keeps all its rows. Runs begin anywhere that leaves them whole; the drawn units are cut to as many as
    there are. Replicates of one class are left out; with fewer than `least` units there is no row. Rows are dealt out
    by ranges of the score and never repeated: a task weighs its own by how often each replicate drew their unit, for all
    replicates at once, and starts from the sums of the ranges before. Broadcast is a row a unit; sums by range and
    replicate go through the driver.
    """
    d = written(df.filter(f"{y} is not null and {score} is not null").select(F.col(unit).alias("unit"), (-F.col(score).cast("double")).alias("s"), (F.col(y) == 1).cast("double").alias("p")))
    units = d.select("unit").distinct().withColumn("place", (F.row_number().over(Window.orderBy("unit")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy())).filter(F.col("n") >= least)  # a row per unit
    slots = units.select(F.col("place").alias("slot"), "n").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    start = _draw(F.greatest(F.col("n") - block + 1, F.lit(1)), F.col("rep").cast("string"), F.floor(F.col("slot") / block).cast("string"))
    drawn = slots.withColumn("place", (start + F.col("slot") % block).cast("long")).groupBy("place", "rep").agg(F.count(F.lit(1)).cast("int").alias("times"))
    drawn = drawn.groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("rep", "times"))).alias("_m")).join(units.select("unit", "place"), "place")
    times = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(0)))
    drawn = written(drawn.select("unit", times.alias("times")))
    ranged = written(d.repartitionByRange("s").sortWithinPartitions("s").withColumn("_range", F.spark_partition_id()))
    rows = ranged.join(F.broadcast(drawn), "unit").select("s", "p", "_range", "times")
    sums = rows.mapInArrow(lambda batches: _range_sums(batches, replicates), "range int, rep int, p double, c double").toPandas().sort_values(["range", "rep"])
    before, p, c = {}, np.zeros(replicates), np.zeros(replicates)
    for k, part in sums.groupby("range"):
        before[int(k)] = (p, c)
        p, c = p + part["p"].to_numpy(), c + part["c"].to_numpy()
    reps = rows.mapInArrow(lambda batches: _range_precision(batches, replicates, before), "rep int, a double").groupBy("rep").agg(F.sum("a").alias("a"))
    whole = d.sparkSession.createDataFrame([(i + 1, float(p[i]), float(c[i])) for i in range(replicates)], "rep int, pos double, all double")
    reps = reps.join(F.broadcast(whole), "rep").filter("pos > 0 and pos < all").select((F.col("a") / F.col("pos")).alias("ap"))
    return reps.agg(F.count(F.lit(1)).alias("replicates"), F.percentile("ap", 0.025).alias("low"), F.percentile("ap", 0.5).alias("median"), F.percentile("ap", 0.975).alias("high")).filter("replicates > 0")


def _weights(batch: pa.RecordBatch, replicates: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' weights, and those of events, by replicate."""
    c = batch.column("times").flatten().to_numpy().reshape(-1, replicates).astype(np.float64)
    return batch.column("p").to_numpy()[:, None] * c, c


def _range_sums(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[pa.RecordBatch]:
    """A range's events and rows by replicate."""
    at, p, c = None, np.zeros(replicates), np.zeros(replicates)
    for batch in batches:
        if batch.num_rows:
            at, (events, rows) = batch.column("_range")[0].as_py(), _weights(batch, replicates)
            p, c = p + events.sum(axis=0), c + rows.sum(axis=0)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at] * replicates, pa.int32()), pa.array(range(1, replicates + 1), pa.int32()), pa.array(p), pa.array(c)], names=["range", "rep", "p", "c"])


def _range_precision(batches: Iterator[pa.RecordBatch], replicates: int, before: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """A range's part of the sum, over scores in order, of events x precision so far; equal scores are one step."""
    out, last = np.zeros(replicates), None
    for batch in batches:
        if not batch.num_rows:
            continue
        s, (events, rows) = batch.column("s").to_numpy(), _weights(batch, replicates)
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        gp, gc = np.add.reduceat(events, starts), np.add.reduceat(rows, starts)
        if last is None:
            p, c = before[batch.column("_range")[0].as_py()]
        elif last[0] == s[0]:
            gp[0] += last[1]
            gc[0] += last[2]
        else:
            gp, gc = np.vstack([last[1], gp]), np.vstack([last[2], gc])
        last = (s[-1], gp[-1], gc[-1])  # may go on in the next batch
        cp, cc = p + np.cumsum(gp[:-1], axis=0), c + np.cumsum(gc[:-1], axis=0)
        out += (gp[:-1] * np.divide(cp, cc, out=np.zeros_like(cp), where=cc > 0)).sum(axis=0)
        if len(cp):
            p, c = cp[-1], cc[-1]
    if last is not None:
        cp, cc = p + last[1], c + last[2]
        out += last[1] * np.divide(cp, cc, out=np.zeros_like(cp), where=cc > 0)
        yield pa.RecordBatch.from_arrays([pa.array(range(1, replicates + 1), pa.int32()), pa.array(out)], names=["rep", "a"])


def cluster_bootstrap(df: DataFrame, cluster: str, x: str, replicates: int = 200) -> DataFrame:
    """K17 whole clusters (symbols) drawn again, from their sums."""
    per = df.filter(F.col(x).isNotNull()).groupBy(F.col(cluster).alias("date")).agg(F.sum(x).alias("_s"), F.count(x).alias("_c"))
    d = per.withColumn("place", F.row_number().over(Window.orderBy("date")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    asked = d.select(F.col("place").alias("slot"), "n").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("place", _draw(F.col("n"), F.col("rep").cast("string"), F.col("slot").cast("string")).cast("int"))
    reps = asked.select("rep", "place").join(d.select("place", "_s", "_c"), "place").groupBy("rep").agg((F.sum("_s") / F.sum("_c")).alias("m"))
    return reps.agg(F.count(F.lit(1)).alias("replicates"), F.avg("m").alias("mean"), F.percentile("m", 0.05).alias("q05"), F.percentile("m", 0.95).alias("q95"))


def hac_test(daily: DataFrame, x: str, lags: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """K18 mean of a daily series (of each key, where `by` names one), its Newey-West error (Bartlett weights) and t."""
    w, every = Window.partitionBy(*by).orderBy("date"), Window.partitionBy(*by)
    d = daily.filter(F.col(x).isNotNull()).withColumn("_e", F.col(x) - F.avg(x).over(every))
    d = d.withColumns({f"_l{k}": F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    n = F.count("_e")
    var = F.sum(F.col("_e") * F.col("_e")) + sum((2 * (1 - k / (lags + 1.0)) * F.sum(F.col("_e") * F.col(f"_l{k}")) for k in range(1, lags + 1)), F.lit(0.0))
    se = F.sqrt(F.greatest(var, F.lit(0.0))) / n
    return d.groupBy(*by).agg(n.alias("days"), F.avg(x).alias("mean"), se.alias("se"), F.try_divide(F.avg(x), F.nullif(se, F.lit(0.0))).alias("t"))


def scenario_buckets(df: DataFrame, score: str, y: str, bins: int = 5, least: int = 80) -> DataFrame:
    """K20 bins between quantiles of the score: bounds, rows, positive rate, mean, median, q20, q80; null where rows are too few.

    Cuts and quantiles are exact and found by refinement, so no task holds the table or a bin.
    """
    d = written(df.filter(f"{score} is not null and {y} is not null").select(F.col(score).cast("double").alias("_s"), F.col(y).cast("double").alias("_y")))
    cuts = exact_quantiles(d, [], "_s", {f"c{i}": i / bins for i in range(1, bins)}).first()
    b = d.withColumn("bin", sum((F.when(F.col("_s") > F.lit(c), 1).otherwise(0) for c in cuts or ()), F.lit(0)))
    q = exact_quantiles(b, ["bin"], "_y", {"median": 0.5, "q20": 0.2, "q80": 0.8})
    ok = F.col("n") >= least
    t = b.groupBy("bin").agg(F.min("_s").alias("low"), F.max("_s").alias("high"), F.count("_y").alias("n"), F.avg((F.col("_y") > 0).cast("double")).alias("up_rate"), F.avg("_y").alias("mean")).join(q, "bin")
    return t.select("bin", "low", "high", "n", *[F.when(ok, F.col(c)).alias(c) for c in ("up_rate", "mean", "median", "q20", "q80")])


def bucket_lookup(rows: DataFrame, buckets: DataFrame, score: str) -> DataFrame:
    """K20 each row with its bucket; scores beyond the ends take the end bucket. A handful of buckets travel as an array."""
    b = buckets.agg(F.array_sort(F.collect_list(F.struct("high", "bin", "up_rate", "median"))).alias("_b"))
    pick = F.coalesce(F.try_element_at(F.filter("_b", lambda x: x["high"] >= F.col(score)), F.lit(1)), F.element_at("_b", -1))
    return rows.crossJoin(b).withColumn("_p", pick).select(*rows.columns, F.col("_p.bin").alias("bin"), F.col("_p.up_rate").alias("bucket_up_rate"), F.col("_p.median").alias("bucket_median"))


def conformal_width(df: DataFrame, y: str, low: str, high: str, level: float = 0.6) -> DataFrame:
    """K22 the ceil((n + 1) x level)-th smallest of max(low - y, y - high, 0): by how much to widen intervals."""
    d = df.filter(f"{y} is not null").withColumn("_s", F.greatest(F.col(low) - F.col(y), F.col(y) - F.col(high), F.lit(0.0)))
    d = d.filter("_s is not null").groupBy("_s").agg(F.count(F.lit(1)).alias("_c"))  # most widths may be 0
    d = ordered_totals(d, ["_s"], {"_r": F.col("_c")})
    d = d.crossJoin(F.broadcast(d.agg(F.sum("_c").alias("_n"))))
    return d.agg(F.max("_n").alias("n"), F.min(F.when(F.col("_r") >= F.least(F.ceil((F.col("_n") + 1) * level), F.col("_n")), F.col("_s"))).alias("width"))


def median_bins(df: DataFrame, score: str, y: str, bins: int = 15, key: str = "id") -> DataFrame:
    """K23 equal-count bins of the score: middle of the score, median outcome, rows; monotone() then pools them."""
    d = df.filter(f"{score} is not null and {y} is not null")
    d = ordered_totals(d.select(score, y, key), [score, key], {"_place": F.lit(1)})
    d = d.crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("_n")))).withColumn("bin", ntile_of(F.col("_place"), F.col("_n"), bins))
    return d.groupBy("bin").agg(F.median(score).alias("x"), F.median(y).alias("y"), F.count(F.lit(1)).cast("double").alias("n"))


def monotone(bins: DataFrame) -> DataFrame:
    """K23, K7 rising step values for bins (x, y, n): weighted pool-adjacent-violators as a max-min formula.

    The isotonic fit at i is the largest over j <= i of the smallest over k >= i of the mean of bins j..k; bins are few.
    """
    b = bins.select("x", "y", "n").withColumn("i", F.row_number().over(Window.orderBy("x"))).withColumns({"_w": F.sum("n").over(Window.orderBy("x")), "_s": F.sum(F.col("y") * F.col("n")).over(Window.orderBy("x"))})
    a = b.select(F.col("i").alias("j"), (F.col("_w") - F.col("n")).alias("w0"), (F.col("_s") - F.col("y") * F.col("n")).alias("s0"))
    z = b.select(F.col("i").alias("k"), F.col("_w").alias("w1"), F.col("_s").alias("s1"))
    means = a.join(z, F.col("j") <= F.col("k")).withColumn("m", (F.col("s1") - F.col("s0")) / (F.col("w1") - F.col("w0")))
    at = b.select("x", "y", "n", "i").join(means, (F.col("j") <= F.col("i")) & (F.col("i") <= F.col("k")))
    return at.groupBy("x", "y", "n", "i", "j").agg(F.min("m").alias("m")).groupBy("x", "y", "n", "i").agg(F.max("m").alias("fit"))


def interpolate(rows: DataFrame, knots: DataFrame, x: str, name: str) -> DataFrame:
    """K23 linear interpolation between knots (x, fit), held at the ends; knots travel as an array of a few structs."""
    k = knots.agg(F.array_sort(F.collect_list(F.struct("x", "fit"))).alias("_k"))
    lo = F.try_element_at(F.filter("_k", lambda c: c["x"] <= F.col(x)), F.lit(-1))
    hi = F.try_element_at(F.filter("_k", lambda c: c["x"] > F.col(x)), F.lit(1))
    j = rows.crossJoin(k).withColumns({"_lo": lo, "_hi": hi})
    t = F.try_divide(F.col(x) - F.col("_lo.x"), F.col("_hi.x") - F.col("_lo.x"))
    v = F.when(F.col("_lo").isNull(), F.col("_hi.fit")).when(F.col("_hi").isNull(), F.col("_lo.fit")).otherwise(F.col("_lo.fit") + t * (F.col("_hi.fit") - F.col("_lo.fit")))
    return j.withColumn(name, F.when(F.col(x).isNotNull(), v)).drop("_k", "_lo", "_hi")


def scale_selection(df: DataFrame, y: str, p: str, grid: tuple[float, ...] | None = None, toward: float = 1.0, least: int = 100) -> DataFrame:
    """K24 MAE and its standard error for each scale of p, and the chosen one: of those within one error of the best, the nearest to `toward` (1: identity, 0: no forecast).

    The grid is 39 scales from .05 to 1.25 by default. With fewer than `least` rows the scale nearest to `toward` is chosen.
    """
    scales = grid or tuple(0.05 + 1.2 * i / 38 for i in range(39))
    r = df.filter(f"{y} is not null and {p} is not null").withColumn("scale", F.explode(F.array(*[F.lit(g) for g in scales])))
    e = F.abs(F.col(y) - F.col("scale") * F.col(p))
    t = r.groupBy("scale").agg(F.avg(e).alias("mae"), (F.stddev_samp(e) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("se"), F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy()  # a row per scale
    away = F.round(F.abs(F.col("scale") - toward), 12)
    t = t.withColumn("_best", F.min(F.struct("mae", away.alias("away"), "se")).over(every))
    ok = (F.round("mae", 9) <= F.round(F.col("_best.mae") + F.col("_best.se"), 9)) | (F.col("_n") < least)
    nearest = F.min(F.when(ok, F.struct(away.alias("away"), F.when(F.col("_n") < least, F.lit(0.0)).otherwise(F.col("mae")).alias("mae"), "scale"))).over(every)
    return t.withColumn("chosen", F.col("scale") == nearest["scale"]).drop("_best", "_n")


def pbo(daily: DataFrame, models: list[str], blocks: int = 8) -> DataFrame:
    """K29 probability of backtest overfitting: over all splits of the date blocks in halves, how often the in-sample winner lies below the out-of-sample median.

    daily has a row per date with each model's result. Blocks are summed once; splits work on blocks x models numbers.
    """
    d = daily.withColumn("block", F.ntile(blocks).over(Window.orderBy("date")) - 1)
    per = d.unpivot(["date", "block"], models, "model", "x").groupBy("block", "model").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    splits = F.array(*[F.struct(F.lit(i).alias("split"), F.array(*[F.lit(b) for b in c]).alias("ins")) for i, c in enumerate(combinations(range(blocks), blocks // 2))])
    j = per.withColumn("_s", F.explode(splits)).withColumn("_in", F.array_contains("_s.ins", F.col("block")))
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col("s"))), F.sum(F.when(c, F.col("n"))))
    m = j.groupBy(F.col("_s.split").alias("split"), "model").agg(F.round(mean(F.col("_in")), 12).alias("ins"), F.round(mean(~F.col("_in")), 12).alias("out"))
    won = m.withColumn("_m", F.median("out").over(Window.partitionBy("split"))).groupBy("split").agg(F.max_by(F.struct("out", "_m"), F.struct("ins", "model")).alias("w"))
    return won.agg(F.count(F.lit(1)).alias("splits"), F.avg((F.col("w.out") < F.col("w._m")).cast("double")).alias("pbo"))


def sealed_blocks(df: DataFrame, y: str = "y", score: str = "score", blocks: int = 4) -> DataFrame:
    """K31 IC and MAE by chronological block of the sealed dates, and whether at least 3 ICs are positive and none below -.03."""
    d = date_places(df).withColumn("block", F.ntile(blocks).over(Window.orderBy("date"))).select("date", "block")
    ic = daily_rank_ic(df, y, score).join(d, "date").groupBy("block").agg(F.avg("ic").alias("ic"), F.count("ic").alias("days"))
    every = Window.partitionBy()
    return ic.withColumn("passed", (F.count_if(F.col("ic") > 0).over(every) >= 3) & (F.min("ic").over(every) >= -0.03))


def shape_prediction(df: DataFrame, r: str, p_up: str, vol: str, multiplier: float = 1.0, floor: float = 0.0) -> DataFrame:
    """K33 the forecast r x multiplier: turned where it is small against volatility and a confident probability disagrees, and raised to a floor where it agrees."""
    v, edge = F.col(vol), F.col(p_up) - 0.5
    side, sure, point = F.signum(edge), F.abs(edge), F.col(r) * multiplier
    turned = (sure >= 0.070) & (F.signum(point) != side) & (F.abs(point) <= 0.15 * v)
    point = F.when(turned, side * F.greatest(F.abs(point), 0.06 * v)).otherwise(point)
    if floor > 0:
        aligned = (F.signum(point) == side) | (F.abs(point) <= 0.045 * v)
        least = floor * v * F.least(F.greatest(0.75 + 4.0 * sure, F.lit(0.90)), F.lit(1.45))
        point = F.when((sure >= 0.045) & aligned & (side != 0), side * F.greatest(F.abs(point), least)).otherwise(point)
    return df.withColumn("shaped", point)


#: Tick by price at HOSE (price below, tick), the tick elsewhere, and each venue's limit of a session.
HOSE_TICKS, OTHER_TICK, LIMITS = ((10_000, 10), (50_000, 50), (None, 100)), 100, {"HOSE": 0.07, "HNX": 0.10, "UPCOM": 0.15}


def tick(price: Column, venue: Column) -> Column:
    """K34 the tick of a price at a venue."""
    size = F.lit(HOSE_TICKS[-1][1])
    for below, t in reversed(HOSE_TICKS[:-1]):
        size = F.when(price < below, t).otherwise(size)
    return F.when(F.upper(venue).isin("HNX", "UPCOM"), OTHER_TICK).otherwise(size)


def snap(price: Column, venue: Column, mode: str = "nearest") -> Column:
    """K34 a price on the venue's grid, also across the edges of price bands; the higher of two that are equally near."""
    both = [f(price / t) * t for _, t in HOSE_TICKS for f in (F.floor, F.ceil)]
    grid = F.when(F.upper(venue).isin("HNX", "UPCOM"), F.array(*[f(price / OTHER_TICK) * OTHER_TICK for f in (F.floor, F.ceil)])).otherwise(F.array(*both))
    grid = F.filter(grid, lambda x: (x > 0) & (x % tick(x, venue) == 0))
    if mode == "down":
        return F.coalesce(F.array_max(F.filter(grid, lambda x: x <= price + 1e-9)), F.array_min(grid))
    if mode == "up":
        return F.coalesce(F.array_min(F.filter(grid, lambda x: x >= price - 1e-9)), F.array_max(grid))
    return -F.array_min(F.transform(grid, lambda x: F.struct(F.abs(x - price).alias("d"), (-x).alias("x"))))["x"]


def executable_quotes(df: DataFrame, reference: str, r: str, p_up: str, vol: str, venue: str, h: int) -> DataFrame:
    """K34 the quote of a forecast r over h sessions with probability p_up and volatility vol of those sessions.

    The forecast price is snapped to the grid. A move smaller than the least one (a tick, or a fraction of volatility
    that grows with h and conviction) becomes the least one, in the forecast's direction, or in the probability's where
    the forecast is small against volatility; weak forecasts of one session stay. h sessions' limits hold at last.
    """
    ref, ret, v, at = F.col(reference).cast("double"), F.col(r), F.col(vol), F.col(venue)
    t, edge = tick(ref, at), F.col(p_up) - 0.5
    fraction = 0.065 if h == 1 else 0.095 + 0.008 * (h - 1)
    least = F.greatest(t, F.bround(fraction * (1.0 + F.least(F.abs(edge) * 0.75, F.lit(0.12))) * v * ref / t, 0) * t)
    side = F.when((F.abs(ret) <= 0.15 * v) & (F.abs(edge) >= 0.07), F.signum(edge)).otherwise(F.signum(ret))
    strong = F.lit(True) if h != 1 else ~((F.abs(ret) < 0.06 * v) & (F.abs(edge) < 0.06))
    plain = snap(ref * F.exp(ret), at)
    df = df.withColumns({"_plain": plain, "_least": least, "_side": side, "_limit": F.coalesce(F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv])[F.upper(at)], F.lit(0.07))})
    moved = F.when((F.col("_side") != 0) & strong & (F.abs(F.col("_plain") - ref) < F.col("_least")), snap(ref + F.col("_side") * F.col("_least"), at)).otherwise(F.col("_plain"))
    low, high = snap(ref * F.pow(1 - F.col("_limit"), h), at, "up"), snap(ref * F.pow(1 + F.col("_limit"), h), at, "down")
    df = df.withColumns({"quote_low": low.cast("long"), "quote_high": high.cast("long"), "quote": moved.cast("long")})
    return df.withColumn("quote", F.greatest("quote_low", F.least("quote_high", "quote"))).drop("_plain", "_least", "_side", "_limit")


def gates(metrics: DataFrame, rules: dict[str, str]) -> DataFrame:
    """K37 passed and reasons by rules (name: condition over the metrics' columns); a null condition fails."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(k)) for k, c in rules.items()]))
    return metrics.withColumn("reasons", F.concat_ws(",", reasons)).withColumn("passed", F.size(reasons) == 0)


def reference_percentile(rows: DataFrame, reference: DataFrame, score: str, key: list[str]) -> DataFrame:
    """K38 share of the reference's scores below each row's, equal ones counting half: one ordered stream, no pairs.

    All scores are ordered together; summed by distinct score first, so the window holds one row per score.
    """
    r = reference.groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    a = rows.select(F.col(score).alias("_s")).distinct().withColumn("_n", F.lit(0).cast("long"))
    t = r.unionByName(a).filter("_s is not null").groupBy("_s").agg(F.sum("_n").alias("_n"))
    all_ = F.broadcast(t.agg(F.sum("_n").alias("_all")))
    p = ordered_totals(t, ["_s"], {"_upto": F.col("_n")}).crossJoin(all_).withColumn("percentile", F.try_divide(F.col("_upto") - 0.5 * F.col("_n"), F.col("_all").cast("double"))).select("_s", "percentile")
    return rows.join(p, F.col(score) == F.col("_s"), "left").drop("_s")


def linear_scorer(rows: DataFrame, coefficients: DataFrame, key: list[str]) -> DataFrame:
    """K39 scores from stored coefficients (feature, median, mean, sd, weight; feature '(intercept)'): impute, standardise, weigh, squash."""
    names = [c for c in rows.columns if c not in key]
    c = coefficients.agg(*[F.max(F.when(F.col("feature") == f, F.struct("median", "mean", "sd", "weight"))).alias(f"_c{i}") for i, f in enumerate(names)], F.coalesce(F.sum(F.when(F.col("feature") == "(intercept)", F.col("weight"))), F.lit(0.0)).alias("_c"))
    z = lambda f, i: F.try_divide(F.coalesce(F.col(f), F.col(f"_c{i}.median")) - F.col(f"_c{i}.mean"), F.nullif(F.col(f"_c{i}.sd"), F.lit(0.0)))
    terms = [F.coalesce(z(f, i), F.lit(0.0)) * F.coalesce(F.col(f"_c{i}.weight"), F.lit(0.0)) for i, f in enumerate(names)]
    s = rows.crossJoin(F.broadcast(c)).select(*key, sum(terms, F.lit(0.0)).alias("_z"), "_c")  # one row of coefficients
    return s.withColumn("linear", F.col("_z") + F.col("_c")).withColumn("p", 1 / (1 + F.exp(-F.col("linear")))).drop("_z", "_c")


def backtest_cases(df: DataFrame, n: int = 6) -> DataFrame:
    """K40 each symbol's last n matured forecasts (p50, q20, q80, y): whether the direction and the interval hit."""
    d = df.filter("y is not null and p50 is not null").withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).filter(F.col("_r") <= n)
    return d.withColumns({"hit": F.signum("y") == F.signum("p50"), "inside": F.col("y").between(F.col("q20"), F.col("q80")), "error": F.abs(F.col("y") - F.col("p50"))}).drop("_r")


def index_backtest(df: DataFrame, score: str = "score", dd: str = "fwd_dd") -> DataFrame:
    """K41 per symbol: first 70 % of rows set the event (worst 5 % of drawdowns) and the alert (80th percentile); the rest is judged: rates, recall, lift.

    The bounds are window columns, so df is read once.
    """
    w = Window.partitionBy("symbol")
    d = df.filter(f"{score} is not null and {dd} is not null").withColumn("_t", F.row_number().over(w.orderBy("date")) <= F.floor(F.count(F.lit(1)).over(w) * 0.7))
    cut = d.withColumns({"event_cut": F.percentile(F.when(F.col("_t"), F.col(dd)), 0.05).over(w), "alert_cut": F.percentile(F.when(F.col("_t"), F.col(score)), 0.8).over(w)})
    j = cut.filter("not _t and event_cut is not null").withColumns({"_e": F.col(dd) <= F.col("event_cut"), "_a": F.col(score) >= F.col("alert_cut")})
    r = lambda c: F.count_if(c).cast("double")
    base, prec = F.try_divide(r(F.col("_e")), F.count(F.lit(1))), F.try_divide(r(F.col("_e") & F.col("_a")), F.nullif(r(F.col("_a")), F.lit(0.0)))
    return j.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), base.alias("event_rate"), prec.alias("precision"), F.try_divide(r(F.col("_e") & F.col("_a")), F.nullif(r(F.col("_e")), F.lit(0.0))).alias("recall"), F.try_divide(prec, F.nullif(base, F.lit(0.0))).alias("lift"))


def score_quintiles(df: DataFrame, score: str = "score", dd: str = "fwd_dd") -> DataFrame:
    """K41 per symbol and fifth of the score (by its place among the scores of the first 70 % of rows): rows and event rate of the rest.

    The event's bound, the worst 5 % of those drawdowns, is taken to nine digits: between values of six digits it lies on
    or off a drawdown, which the last bit of an interpolation does not tell.
    """
    w = Window.partitionBy("symbol")
    d = df.filter(f"{score} is not null and {dd} is not null").withColumn("_t", F.row_number().over(w.orderBy("date")) <= F.floor(F.count(F.lit(1)).over(w) * 0.7))
    cut = d.filter("_t").groupBy("symbol").agg(F.round(F.percentile(dd, 0.05), 9).alias("_cut"))
    place = F.sum(F.col("_t").cast("int")).over(w.orderBy(score)) / F.sum(F.col("_t").cast("int")).over(w)  # train scores at or below
    j = d.withColumn("_p", 100 * place).filter("not _t").join(cut, "symbol")
    fifth = F.least(F.floor(F.col("_p") / 20).cast("int") + 1, F.lit(5))
    return j.groupBy("symbol", F.concat(F.lit("Q"), fifth.cast("string")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(dd) <= F.col("_cut")).cast("double")).alias("event_rate"))


def event_study(df: DataFrame, y: str = "y") -> DataFrame:
    """K36 abnormal return of rows with news by sign and class of the news: rows, mean, t."""
    from .studies import abnormal_returns

    d = abnormal_returns(df, y).filter("signed <> 0 and ar is not null")
    se = F.stddev_samp("ar") / F.sqrt(F.count("ar").cast("double"))
    return d.groupBy(F.when(F.col("signed") > 0, "positive").otherwise("negative").alias("sign"), "event").agg(F.count("ar").alias("n"), F.avg("ar").alias("mean"), F.try_divide(F.avg("ar"), F.nullif(se, F.lit(0.0))).alias("t"))


def reliability_weights(metrics: DataFrame) -> DataFrame:
    """K45 weights .55 PR skill + .30 Brier skill + .15 AUC skill, 0 without skill, as shares."""
    s = F.greatest(0.55 * F.col("pr_skill") + 0.30 * F.col("brier_skill") + 0.15 * F.col("auc_skill"), F.lit(0.0))
    return metrics.withColumn("weight", F.coalesce(F.try_divide(s, F.nullif(F.sum(s).over(Window.partitionBy()), F.lit(0.0))), F.lit(0.0)))


def expert_promotion(ic: DataFrame, least_rows: dict[str, int] | None = None, block: int = 4, replicates: int = 200) -> DataFrame:
    """K28 by expert of (expert, date, delta, active): days, active rows, mean IC gain, HAC t, the 5 % bound of the gain by blocks of dates, and whether it is promoted.

    Promoted: enough active rows (least_rows by expert, else 0), gain above 0, one-sided p below .0125 (t above 2.2414)
    and the block bound above 0. All experts are judged together, however many there are.
    """
    need = F.coalesce(F.create_map(*[F.lit(x) for kv in (least_rows or {"": 0}).items() for x in kv])[F.col("expert")], F.lit(0))
    t = hac_test(ic, "delta", by=("expert",))
    rows = ic.groupBy("expert").agg(F.sum("active").alias("active_rows"))
    bound = bootstrap(ic, "delta", replicates, block, by=("expert",)).select("expert", F.col("q05").alias("delta_q05"))
    return t.join(rows, "expert").join(bound, "expert", "left").withColumn("promoted", F.coalesce((F.col("active_rows") >= need) & (F.col("mean") > 0) & (F.col("t") > 2.2414) & (F.col("delta_q05") > 0), F.lit(False)))


def family_choice(errors: DataFrame, base: str, block: int = 20) -> DataFrame:
    """K26 by family of (date, family, mae): edge over the base on the early and late half of the dates; kept if both, and the 5 % bound of the edge by blocks of dates, are above 0."""
    d = date_places(errors).select("date", (F.col("place") * 2 < F.col("dates")).alias("_early"))
    b = errors.filter(F.col("family") == base).select("date", F.col("mae").alias("_b"))
    e = errors.filter(F.col("family") != base).join(b, "date").join(d, "date").withColumn("edge", F.col("_b") - F.col("mae"))
    halves = e.groupBy("family").agg(F.avg(F.when(F.col("_early"), F.col("edge"))).alias("early_edge"), F.avg(F.when(~F.col("_early"), F.col("edge"))).alias("late_edge"), F.count(F.lit(1)).alias("days"))
    bound = bootstrap(e, "edge", block=block, by=("family",)).select("family", F.col("q05").alias("edge_q05"))
    return halves.join(bound, "family", "left").withColumn("kept", F.coalesce((F.col("early_edge") > 0) & (F.col("late_edge") > 0) & (F.col("edge_q05") > 0), F.lit(False)))


def point_families(df: DataFrame, q50: str, score: str) -> DataFrame:
    """K25 candidate point forecasts of a row as long rows (family, point): the median, scaled, deadband, centred, rank residual, market + rank, tail rank, sparse tail.

    y, date and symbol are carried along; family_choice() judges them.
    """
    w = Window.partitionBy("date")
    u = 2 * average_rank(score, ["date"]) - F.try_divide(F.lit(1.0), F.count(score).over(w)) - 1
    d = df.withColumns({"_u": F.round(u, 12), "_m": F.median(q50).over(w), "_a": F.avg(F.abs(q50)).over(w)})
    c = F.col(q50)
    families = {"q50": c, "scaled": 0.5 * c, "deadband": F.when(F.abs(c) < 0.25 * F.col("_a"), 0.0).otherwise(c), "centred": c - F.col("_m"), "rank": F.col("_u") * F.col("_a"), "market_rank": F.col("_m") + F.col("_u") * F.col("_a"), "tail_rank": F.signum("_u") * F.pow(F.abs("_u"), F.lit(3.0)) * F.col("_a"), "sparse_tail": F.when(F.abs("_u") > 0.8, c).otherwise(0.0)}
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("family"), v.cast("double").alias("point")) for k, v in families.items()])).alias("f")
    return d.select("symbol", "date", "y", long).select("symbol", "date", "y", "f.family", "f.point")


def family_errors(long: DataFrame) -> DataFrame:
    return long.filter("y is not null and point is not null").groupBy("date", "family").agg(F.avg(F.abs(F.col("y") - F.col("point"))).alias("mae"))


def gate_table(checks: dict[str, DataFrame]) -> DataFrame:
    """K49 one row per named check; each value is a DataFrame with a boolean column `passed` (all rows must pass)."""
    rows = [df.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed")).select(F.lit(k).alias("check"), "passed") for k, df in checks.items()]
    return reduce(DataFrame.unionByName, rows)


