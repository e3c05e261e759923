"""Institutional flow, funds, fundamentals and macro pressures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol, clamp
from .joins import asof


def flow_ratios(flows: DataFrame, side: str, least: int = 40, back: int = 120) -> DataFrame:
    """I1 net / (|buy| + |sell|) over the side's last 1, 5 and 20 observations; null with fewer than `least` in its last `back` ones.
    I2 z of net over the last 60, held in +-8, and acceleration of the 5-row sum, held in +-5.

    Only rows where the side reports count as observations.
    """
    b, s, n = (F.col(f"{side}_{x}") for x in ("buy", "sell", "net"))
    df = flows.filter(n.isNotNull()).select("symbol", "date", F.abs(F.coalesce(b, F.lit(0.0))).alias("_b"), F.abs(F.coalesce(s, F.lit(0.0))).alias("_s"), n.alias("_n"))
    w = lambda k, end=0: by_symbol().rowsBetween(end - k + 1, end)
    enough = F.count("_n").over(w(back)) >= least
    out = {f"{side}_ratio{k}": F.when(enough, F.try_divide(F.sum("_n").over(w(k)), F.nullif(F.sum(F.col("_b") + F.col("_s")).over(w(k)), F.lit(0.0)))) for k in (1, 5, 20)}
    sd = F.nullif(F.stddev_samp("_n").over(w(60)), F.lit(0.0))
    out[f"{side}_z60"] = F.when(enough, clamp(F.try_divide(F.col("_n") - F.avg("_n").over(w(60)), sd), -8, 8))
    out[f"{side}_accel"] = F.when(enough, clamp(F.try_divide(F.sum("_n").over(w(5)) - F.sum("_n").over(w(5, -5)), 5 * sd), -5, 5))
    return df.withColumns(out).drop("_b", "_s", "_n")


def flow_session_features(sessions: DataFrame, flows: DataFrame, side: str, most_stale: int = 3) -> DataFrame:
    """I3 on the symbol's sessions: mean imbalance of 5 and 20 rows (2 and 5 observations at least), z20; all null once the side is silent for more than `most_stale` sessions."""
    f = flows.select("symbol", "date", F.try_divide(f"{side}_net", F.nullif(F.abs(F.coalesce(f"{side}_buy", F.lit(0.0))) + F.abs(F.coalesce(f"{side}_sell", F.lit(0.0))), F.lit(0.0))).alias("_x"))
    df = sessions.select("symbol", "date").join(f, ["symbol", "date"], "left").withColumn("_i", F.row_number().over(by_symbol()))
    w = lambda k: by_symbol().rowsBetween(-k + 1, 0)
    stale = F.col("_i") - F.last(F.when(F.col("_x").isNotNull(), F.col("_i")), ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn(f"{side}_stale", stale)
    fresh = F.col(f"{side}_stale") <= most_stale
    mean = lambda k, n: F.when(fresh & (F.count("_x").over(w(k)) >= n), F.avg("_x").over(w(k)))
    z = F.when(fresh & (F.count("_x").over(w(20)) >= 8), F.try_divide(F.col("_x") - F.avg("_x").over(w(20)), F.nullif(F.stddev_samp("_x").over(w(20)), F.lit(0.0))))
    return df.withColumns({f"{side}_imb5": mean(5, 2), f"{side}_imb20": mean(20, 5), f"{side}_imb_z": z}).drop("_x", "_i")


def _bands(x: Column, weak: float, strong: float) -> Column:
    return F.when(x >= strong, "STRONG_BUY").when(x >= weak, "BUY").when(x <= -strong, "STRONG_SELL").when(x <= -weak, "SELL").when(x.isNotNull(), "NEUTRAL")


def ratio_state(ratio: str) -> Column:
    """I4 five states of net flow over gross flow: bounds .03 and .12 on either side."""
    return _bands(F.col(ratio), 0.03, 0.12)


def z_state(z: str) -> Column:
    """I4 five states of a flow's z score: bounds .2 and .75 on either side."""
    return _bands(F.col(z), 0.2, 0.75)


def recent_sums(flows: DataFrame, side: str, unit: float = 1.0) -> DataFrame:
    """I5 per symbol: sums of net and its ratio to buy + sell over the last 1, 5 and 20 reported rows, in the source's unit."""
    df = flows.filter(F.col(f"{side}_net").isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    gross = F.coalesce(F.abs(F.col(f"{side}_buy")), F.lit(0.0)) + F.coalesce(F.abs(F.col(f"{side}_sell")), F.lit(0.0))
    aggs = []
    for k in (1, 5, 20):
        net, tot = F.sum(F.when(F.col("_r") <= k, F.col(f"{side}_net"))), F.sum(F.when(F.col("_r") <= k, gross))
        aggs += [(net * unit).alias(f"net{k}"), F.try_divide(net, F.nullif(tot, F.lit(0.0))).alias(f"ratio{k}")]
    return df.groupBy("symbol").agg(*aggs)


def flow_coverage(flows: DataFrame) -> DataFrame:
    """I6 by date: symbols with each side, and both."""
    f, p = F.col("foreign_net").isNotNull(), F.col("prop_net").isNotNull()
    return flows.groupBy("date").agg(F.count_if(f).alias("foreign"), F.count_if(p).alias("prop"), F.count_if(f & p).alias("both"), F.count(F.lit(1)).alias("symbols"))


def fund_features(holdings: DataFrame) -> DataFrame:
    """I7 per snapshot and symbol: holders, total and largest weight, change since the snapshot before, weighted NAV momentum and volatility, number of snapshots so far.

    holdings (fund, as_of, symbol, weight, nav_momentum20, nav_volatility20).
    """
    mean = lambda x: F.try_divide(F.sum(F.col(x) * F.col("weight")), F.nullif(F.sum(F.when(F.col(x).isNotNull(), F.col("weight"))), F.lit(0.0)))
    per = holdings.groupBy("symbol", "as_of").agg(F.countDistinct("fund").alias("holders"), F.sum("weight").alias("fund_weight"), F.max("weight").alias("top_weight"), mean("nav_momentum20").alias("nav_momentum"), mean("nav_volatility20").alias("nav_volatility"))
    w = Window.partitionBy("symbol").orderBy("as_of")
    depth = holdings.select("as_of").distinct().withColumn("snapshots", F.row_number().over(Window.orderBy("as_of")))  # a row per snapshot
    return per.withColumn("weight_change", F.col("fund_weight") - F.lag("fund_weight").over(w)).join(depth, "as_of")


def fund_asof(panel: DataFrame, features: DataFrame, least: int = 4) -> DataFrame:
    """I7, I9 the last snapshot at or before each row, never a later one; usable only from the `least`-th snapshot on."""
    values = ["as_of", "holders", "fund_weight", "weight_change", "nav_momentum", "snapshots"]
    df = asof(panel, features.withColumn("date", F.col("as_of")).select("symbol", "date", *values), "date", "symbol", values)
    return df.withColumn("fund_age", F.datediff("date", "as_of")).withColumn("fund_usable", F.coalesce(F.col("snapshots") >= least, F.lit(False)))


def fund_context(features: DataFrame) -> DataFrame:
    """I9 the newest snapshot's rows: context for today, joined to no earlier date."""
    newest = features.agg(F.max("as_of").alias("_m"))
    return features.join(newest, F.col("as_of") == F.col("_m")).drop("_m")


def nav_stats(nav: DataFrame) -> DataFrame:
    """I8 per fund and date of (fund, date, nav): log momentum over 20 rows and population deviation of 20 log differences."""
    w = Window.partitionBy("fund").orderBy("date")
    df = nav.withColumn("_r", F.log(F.try_divide("nav", F.lag("nav").over(w))))
    k = w.rowsBetween(-19, 0)
    return df.withColumns({"nav_momentum20": F.try_divide("nav", F.lag("nav", 20).over(w)) - 1, "nav_volatility20": F.when(F.count("_r").over(k) >= 20, F.stddev_pop("_r").over(k))}).drop("_r")


def mean_of(*xs: Column) -> Column:
    """Mean of the values that are not null; null if none is."""
    have = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
    return F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)), F.nullif(have, F.lit(0)))


def fundamental_pressure(df: DataFrame) -> DataFrame:
    """I10 0-100 mean of the pressures of roe, pe, debt_equity, margin and growth that are there; null without any.

    Rates above 2 are per cent, debt ratios above 10 too; a price ratio that is not positive says nothing. Where a
    column bank is true, debt says nothing either.
    """
    rate = lambda x: F.when(F.abs(F.col(x)) > 2, F.col(x) / 100).otherwise(F.col(x))
    debt = F.when(F.col("debt_equity") > 10, F.col("debt_equity") / 100).otherwise(F.col("debt_equity"))
    if "bank" in df.columns:
        debt = F.when(~F.coalesce(F.col("bank"), F.lit(False)), debt)
    parts = clamp((0.12 - rate("roe")) / 0.18, 0, 1), F.when(F.col("pe") > 0, clamp((F.col("pe") - 18) / 30, 0, 1)), clamp((debt - 0.7) / 2.0, 0, 1), clamp((0.08 - rate("margin")) / 0.15, 0, 1), clamp(-rate("growth") / 0.20, 0, 1)
    return df.withColumn("fundamental_pressure", 100 * mean_of(*parts))


#: Role of a macro series: how its last level or its 20-row return becomes a pressure (start, span).
MACRO_RAMPS = {"vix": ("level", 17.0, 20.0), "usd": ("rise", 0.0, 0.025), "dxy": ("rise", 0.0, 0.04), "us10y": ("rise", 0.0, 0.08), "brent": ("move", 0.0, 0.18)}


def macro_pressure(macro: DataFrame, roles: dict[str, str], back: int = 20) -> DataFrame:
    """I11 a row per series (series, date, value) that has a role: last level, its simple return over `back` rows (0 where too short), pressure, and the mean as macro_pressure.

    vix presses by its level, usd, dxy and us10y by their rise, brent by its move either way.
    """
    w = Window.partitionBy("series").orderBy("date")
    of = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    r = macro.withColumns({"role": of[F.col("series")], "r": F.try_divide("value", F.lag("value", back).over(w)) - 1}).filter("role is not null")
    last = r.groupBy("series", "role").agg(F.max_by("value", "date").alias("level"), F.max_by(F.coalesce("r", F.lit(0.0)), "date").alias("ret20"))
    pressure = F.lit(None).cast("double")
    for role, (kind, start, span) in MACRO_RAMPS.items():
        x = F.col("level") if kind == "level" else F.abs("ret20") if kind == "move" else F.col("ret20")
        pressure = F.when(F.col("role") == role, clamp((x - start) / span, 0, 1)).otherwise(pressure)
    return last.withColumn("pressure", pressure).withColumn("macro_pressure", 100 * F.avg("pressure").over(Window.partitionBy()))  # a row per series
