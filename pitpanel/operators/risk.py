"""Risk scores, alerts and decisions as column expressions. Weights, ramps and bounds are the published policy's values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol, clamp
from .features import taken


def _fall(x: str | Column, full: float) -> Column:
    """Pressure of a fall: 0 at or above 0, 1 at -full, linear between; null stays null."""
    return clamp(-(F.col(x) if isinstance(x, str) else x) / full, 0, 1)


def _selling(volume: Column, span: float, ret: str, full: float) -> Column:
    """Pressure of heavy volume while the price falls; no volume evidence is no pressure."""
    return F.coalesce(clamp(volume / span, 0, 1) * _fall(ret, full), F.lit(0.0))


#: Weights of the scores' pressures.
INDEX_WEIGHTS = {"p_volatility": 25, "p_drawdown": 20, "p_momentum": 15, "p_trend": 15, "p_shock": 15, "p_volume": 10}
TECHNICAL_WEIGHTS = {"t_drawdown": 0.18, "t_momentum": 0.16, "t_ma50": 0.14, "t_ma200": 0.10, "t_volatility": 0.16, "t_rsi": 0.10, "t_macd": 0.08, "t_volume": 0.08}
SCREENER_WEIGHTS = {"s_drawdown": 0.18, "s_momentum": 0.16, "s_ma50": 0.14, "s_ma200": 0.10, "s_volatility": 0.12, "s_rsi": 0.10, "s_macd": 0.08, "s_volume": 0.06, "s_relative": 0.06}
STOCK_MODULES = {"technical": 0.30, "analog": 0.25, "market": 0.10, "macro": 0.10, "sentiment": 0.10, "fundamental": 0.15}
RADAR_MODULES = {"technical": 0.30, "analog": 0.25, "market": 0.15, "macro": 0.10, "sentiment": 0.10, "fundamental": 0.10}
#: Least mean turnover of an eligible stock.
LEAST_TURNOVER = 500_000_000.0


def weighted_score(df: DataFrame, weights: dict[str, float], name: str, renormalise: bool = True) -> DataFrame:
    """100 x sum of weight x value over the values that are there; their weights are scaled to the whole if asked, and kept as <name>_confidence.

    Evidence that is missing abstains: with no value at all the score is null.
    """
    have = sum((F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    score = 100 * F.try_divide(total, have) * (1.0 if renormalise else have / sum(weights.values()))
    return df.withColumn(name, F.when(have > 0, score)).withColumn(f"{name}_confidence", have / sum(weights.values()))


def index_pressures(df: DataFrame) -> DataFrame:
    """J1's six pressures of a panel row: volatility's place in its year, falls, the latest shock, selling on volume."""
    return df.withColumns({
        "p_volatility": clamp((F.col("vol_pct_incl") - 0.45) / 0.55, 0, 1), "p_drawdown": _fall("dd60", 0.18), "p_momentum": _fall("sret20", 0.12), "p_trend": _fall("gap50", 0.10),
        "p_shock": F.coalesce(_fall("shock_z", 3.09), F.lit(0.0)), "p_volume": _selling(F.col("volume_z_prior"), 3.0, "ret1", 0.04),
    })


def index_score(df: DataFrame) -> DataFrame:
    """J1 six pressures, 100 points."""
    return weighted_score(index_pressures(df), INDEX_WEIGHTS, "index_score")


def technical_score(df: DataFrame) -> DataFrame:
    """J2 eight pressures of a panel row with macd()."""
    df = df.withColumns({
        "t_drawdown": _fall("dd60", 0.22), "t_momentum": _fall("sret20", 0.14), "t_ma50": _fall("gap50", 0.12), "t_ma200": _fall("gap200", 0.18),
        "t_volatility": clamp((F.col("vol_pct") - 0.45) / 0.55, 0, 1), "t_rsi": clamp((45 - F.col("rsi_simple")) / 20, 0, 1), "t_macd": _fall("macd_gap", 0.025), "t_volume": _selling(F.col("volume_z_prior"), 3.0, "ret1", 0.05),
    })
    return weighted_score(df, TECHNICAL_WEIGHTS, "technical_score")


def screener_inputs(df: DataFrame) -> DataFrame:
    """vol_day (per cent a day), volume_ratio10 and turnover30 (mean turnover of 30 rows) of a panel."""
    mean = lambda n: taken(df, "mean", "volume", n)
    return df.withColumns({"vol_day": F.col("vol20") * (100 / 252**0.5), "volume_ratio10": F.try_divide("volume", mean(10)), "turnover30": F.col("close") * mean(30)})


def screener_score(df: DataFrame, market: str | None = "market20") -> DataFrame:
    """J3 nine pressures of a row with screener_inputs(); the one relative to the market abstains where its return is missing.

    Rows without the means of 50 and 200 or the month's return have no score.
    """
    relative = F.col("sret20") - F.col(market) if market else F.lit(None).cast("double")
    df = df.withColumn("relative20", relative).withColumns({
        "s_drawdown": _fall("dd60", 0.22), "s_momentum": _fall("sret20", 0.14), "s_ma50": _fall("gap50", 0.12), "s_ma200": _fall("gap200", 0.18),
        "s_volatility": clamp((F.coalesce("vol_day", F.lit(0.0)) - 1.8) / 5.0, 0, 1), "s_rsi": clamp((45.0 - F.col("rsi_simple")) / 20.0, 0, 1), "s_macd": _fall(F.coalesce("macd_gap", F.lit(0.0)), 0.025),
        "s_volume": _selling(F.coalesce("volume_ratio10", F.lit(0.0)) - 1.0, 2.0, "sret1", 0.05), "s_relative": _fall("relative20", 0.15),
    })
    out = weighted_score(df, SCREENER_WEIGHTS, "screener_score")
    return out.withColumn("screener_score", F.when(F.col("gap50").isNotNull() & F.col("gap200").isNotNull() & F.col("sret20").isNotNull(), F.col("screener_score")))


#: Conditions of the stress flags.
FLAGS = {
    "drawdown": "dd60 <= -0.18", "momentum": "sret20 <= -0.10", "ma50": "gap50 <= -0.10", "ma200": "gap200 <= -0.15", "rsi": "rsi_simple <= 35", "macd": "macd_gap <= -0.008",
    "volatility": "vol_day >= 4.0", "selloff_volume": "sret1 <= -0.04 and volume_ratio10 >= 1.5", "relative_weakness": "relative20 <= -0.12",
}


def stress_flags(df: DataFrame) -> DataFrame:
    """J4 nine flags and how many are up; a flag without data is down."""
    return df.withColumns({f"f_{k}": F.coalesce(F.expr(v), F.lit(False)) for k, v in FLAGS.items()}).withColumn("flags", sum((F.coalesce(F.expr(v), F.lit(False)).cast("int") for v in FLAGS.values()), F.lit(0)))


def state_band(score: str, bounds: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """J5 the name of the band a score lies in: names from low to high, one more than bounds; null stays null."""
    x, out = F.col(score), F.when(F.col(score).isNotNull(), F.lit(names[0]))
    for b, n in zip(bounds, names[1:], strict=True):
        out = F.when(x >= b, F.lit(n)).otherwise(out)
    return out


#: Bands of the scores.
INDEX_BANDS = ((32.0, 55.0, 75.0), ("LOW", "WATCH", "HIGH", "CRITICAL"))
STOCK_BANDS = ((42.0, 55.0, 70.0), ("CLEAR", "WATCH", "GOLD", "RED"))
PROXY_BANDS = ((35.0, 65.0), ("LOW", "WATCH", "HIGH"))


def weak_trend() -> Column:
    """The month's return or the gap to the mean of 50 is negative."""
    return F.coalesce(F.col("sret20") < 0, F.lit(False)) | F.coalesce(F.col("gap50") < 0, F.lit(False))


def scan_status(score: str = "screener_score", liquid: Column | None = None) -> Column:
    """J5 ILLIQUID, RED, YELLOW, WATCH or GREEN by turnover, score, weak trend and number of flags."""
    s, f, weak = F.col(score), F.col("flags"), weak_trend()
    rich = F.col("turnover30") >= LEAST_TURNOVER if liquid is None else liquid
    banded = F.when((s >= 78) & weak & (f >= 3), "RED").when((s >= 65) & weak & (f >= 2), "YELLOW").when((s >= 50) & weak & (f >= 1), "WATCH").otherwise("GREEN")
    return F.when(s.isNull(), None).when(F.coalesce(rich, F.lit(False)), banded).otherwise("ILLIQUID")


def phase(score: str, confidence: str, dd: str = "dd60") -> Column:
    """J6 PRE_CRASH_RED, PRE_CRASH_YELLOW and WATCH by score, weakness and confidence, else ACTIVE_DRAWDOWN or NORMAL."""
    s, sure, weak = F.col(score), F.col(confidence), weak_trend()
    return F.when((s >= 78) & weak & (sure >= 0.70), "PRE_CRASH_RED").when((s >= 65) & weak & (sure >= 0.55), "PRE_CRASH_YELLOW").when((s >= 50) & weak, "WATCH").when(F.col(dd) <= -0.15, "ACTIVE_DRAWDOWN").when(s.isNotNull(), "NORMAL")


def module_aggregate(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """J7 weighted mean of the module scores (0-100) that are available; confidence is the weight they have. Stock weights by default."""
    w = weights or STOCK_MODULES
    scaled = df.withColumns({f"_{k}": F.col(k) / 100 for k in w})
    return weighted_score(scaled, {f"_{k}": v for k, v in w.items()}, "module_score").drop(*[f"_{k}" for k in w])


def drivers(df: DataFrame, weights: dict[str, float], n: int = 4, least: float = 0.012) -> DataFrame:
    """J8 the n largest contributions (weight x pressure) of a bound at least, as an array of names, largest first."""
    items = F.array(*[F.struct((-F.coalesce(F.col(k) * w, F.lit(0.0))).alias("c"), F.lit(k).alias("name")) for k, w in weights.items()])
    top = F.slice(F.array_sort(F.filter(items, lambda x: x["c"] <= -least)), 1, n)
    return df.withColumn("drivers", F.transform(top, lambda x: x["name"]))


def alerts(df: DataFrame, names: tuple[str, ...] = tuple(INDEX_WEIGHTS), bound: float = 0.45, high: float = 0.75, crash: str | None = None) -> DataFrame:
    """J9 a row per pressure at or above the bound, a crash trigger first, or one row 'normal'."""
    item = lambda place, name, pressure: F.struct(F.lit(place).alias("place"), F.lit(name).alias("alert"), pressure.alias("pressure"))
    first = [item(0, "crash", F.when(F.col(crash), 1.0).otherwise(0.0))] if crash else []
    found = F.filter(F.array(*first, *[item(i + 1, k, F.col(k).cast("double")) for i, k in enumerate(names)]), lambda x: x["pressure"] >= bound)
    none = F.array(item(0, "normal", F.lit(0.0)))
    r = df.select("symbol", "date", F.explode(F.when(F.size(found) > 0, found).otherwise(none)).alias("a"))
    return r.select("symbol", "date", "a.place", "a.alert", "a.pressure", F.when(F.col("a.pressure") >= high, "HIGH").when(F.col("a.pressure") >= bound, "WATCH").otherwise("LOW").alias("severity"))


#: What to do in each state.
PLAYBOOK = {"LOW": "normal cadence; standard limits", "WATCH": "review concentration and leverage; stress before adding risk", "HIGH": "escalate; portfolio stress tests; review hedges", "CRITICAL": "escalate at once; severe stress scenarios; reduce risk"}


def narrative(df: DataFrame, score: str, state: str) -> DataFrame:
    """J10 a sentence from score and the two largest drivers, and the state's playbook."""
    book = F.create_map(*[F.lit(x) for kv in PLAYBOOK.items() for x in kv])
    return df.withColumns({"narrative": F.format_string("Risk is %s at %.0f/100, led by %s.", F.lower(F.coalesce(state, F.lit("unknown"))), F.coalesce(score, F.lit(0.0)), F.concat_ws(" and ", F.slice("drivers", 1, 2))), "playbook": book[F.col(state)]})


def analog_scores(analog: DataFrame) -> DataFrame:
    """J11 from analog event rates (score, technical, rate): the horizon score, the module and the market blend."""
    module = 100 * clamp(F.col("rate") / 0.30, 0, 1)
    return analog.withColumns({"horizon_score": 100 * clamp(0.72 * F.col("score") / 100 + 0.28 * clamp(F.col("rate") / 0.25, 0, 1), 0, 1), "analog_module": module, "market_blend": 0.65 * F.col("technical") + 0.35 * module})


def level(status: str) -> Column:
    return F.when(F.col(status) == "RED", 3).when(F.col(status) == "YELLOW", 2).when(F.col(status) == "WATCH", 1).when(F.col(status) == "GREEN", 0)


def transition(df: DataFrame) -> DataFrame:
    """J12 previous -> current status, whether it escalated to YELLOW or RED; BASELINE without a previous one."""
    up = F.coalesce((level("status") > level("prev_status")) & F.col("status").isin("YELLOW", "RED"), F.lit(False))
    return df.withColumns({"transition": F.when(F.col("prev_status").isNull(), "BASELINE").when(F.col("prev_status") == F.col("status"), "UNCHANGED").otherwise(F.concat_ws(" -> ", "prev_status", "status")), "escalated": up})


def breadth_report(scan: DataFrame) -> DataFrame:
    """J13 by date: eligible rows (liquid, with a status), and numbers and shares of the states among them."""
    ok = scan.filter("status <> 'ILLIQUID'")
    n = F.count(F.lit(1))
    names = ("RED", "YELLOW", "WATCH")
    return ok.groupBy("date").agg(n.alias("n"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in names], *[(F.count_if(F.col("status") == s) / n).alias(f"{s.lower()}_share") for s in names])


def crash_diagnostic(bars: DataFrame, k: int = 5, sds: float = 3.09) -> DataFrame:
    """J14 per symbol: the latest k-row log return against mean - sds x deviation of the non-overlapping ones before."""
    i = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))) - 1
    r = F.log(F.try_divide("close", F.lag("close", k).over(by_symbol())))
    d = bars.withColumns({"_i": i, "_r": r}).filter(f"_i % {k} = 0 and _r is not null")
    past = F.when(F.col("_i") > 0, F.col("_r"))
    return d.groupBy("symbol").agg(F.max(F.when(F.col("_i") == 0, F.col("_r"))).alias("latest"), F.avg(past).alias("mean"), F.stddev_samp(past).alias("sd"), F.count(past).alias("n")).withColumn("threshold", F.col("mean") - sds * F.col("sd")).withColumn("crash", F.col("latest") < F.col("threshold"))


def crash_flags(weekly: DataFrame, r: str, sds: float = 3.09) -> DataFrame:
    """J15 weeks whose specific return lies sds deviations below the mean of its symbol and calendar year."""
    w = Window.partitionBy("symbol", F.year("week"))
    return weekly.withColumn("crash", F.coalesce(F.col(r) < F.avg(r).over(w) - sds * F.stddev_samp(r).over(w), F.lit(False)))


def market_residual(weekly: DataFrame) -> DataFrame:
    """J16 specific return ln(1 + e): e from least squares of the weekly return on the market's at lags -2..2, per symbol.

    weekly (symbol, week, r, m). Sums of products are one aggregation per symbol; the 6 x 6 system is solved per symbol.
    """
    w = Window.partitionBy("symbol").orderBy("week")
    x = weekly.withColumns({f"m{i}": F.lag("m", 2 - i).over(w) if i < 2 else F.lead("m", i - 2).over(w) if i > 2 else F.col("m") for i in range(5)}).dropna(subset=["r", *[f"m{i}" for i in range(5)]])
    cols = [F.lit(1.0), *[F.col(f"m{i}") for i in range(5)]]
    sums = x.groupBy("symbol").agg(F.array(*[F.sum(a * b) for a in cols for b in cols]).alias("xx"), F.array(*[F.sum(a * F.col("r")) for a in cols]).alias("xy"))

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.reshape(a, (6, 6)), np.asarray(b), rcond=1e-12)[0].tolist() for a, b in zip(xx, xy, strict=True)])

    b = sums.select("symbol", solve("xx", "xy").alias("b"))
    e = F.col("r") - sum((F.col("b")[i] * c for i, c in enumerate(cols)), F.lit(0.0))
    return x.join(b, "symbol").withColumn("specific", F.when(e > -1, F.log1p(e))).select("symbol", "week", "r", "m", "specific")


def scenarios(df: DataFrame, shocks: dict[str, tuple[float, float, float]]) -> DataFrame:
    """J17 the index score and state under each scenario (name: shock return, volatility multiplier, volume z)."""
    table = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(r)).alias("ret"), F.lit(float(v)).alias("vol"), F.lit(float(z)).alias("z")) for n, (r, v, z) in shocks.items()])
    j = df.withColumn("_s", F.explode(table)).select("*", F.col("_s.scenario").alias("scenario"))
    down = F.greatest(-F.col("_s.ret"), F.lit(0.0))
    moved = {
        "p_shock": F.greatest(F.col("p_shock"), down / 0.08), "p_volatility": F.col("p_volatility") + (F.col("_s.vol") - 1) * 0.35, "p_momentum": F.col("p_momentum") + down / 0.12 * 0.45, "p_drawdown": F.col("p_drawdown") + down / 0.18 * 0.60,
        "p_trend": F.col("p_trend") + down / 0.10 * 0.35, "p_volume": F.greatest(F.col("p_volume"), F.greatest(F.col("_s.z"), F.lit(0.0)) / 3 * clamp(down / 0.04, 0, 1)),
    }
    out = weighted_score(j.withColumns({k: clamp(x, 0, 1) for k, x in moved.items()}), INDEX_WEIGHTS, "scenario_score").drop("_s")
    return out.withColumn("scenario_state", state_band("scenario_score", *INDEX_BANDS))


def recommendation(df: DataFrame) -> DataFrame:
    """J18 a stance from passed horizons (passed), their weighted forecast (expected) and risk (0-100, 50 where unknown)."""
    e, r, p = F.col("expected"), F.coalesce(F.col("risk"), F.lit(50.0)), F.col("passed")
    return df.withColumn("recommendation", F.when(F.coalesce(p, F.lit(0)) == 0, "HOLD / NO ACTION").when(r >= 78, "REDUCE / AVOID NEW RISK").when((e >= 0.012) & (r < 65), "ACCUMULATE").when(e >= 0.004, "HOLD / POSITIVE BIAS").when(e <= -0.012, "REDUCE").when(e <= -0.004, "CAUTION / REDUCE RISK").otherwise("HOLD"))


def evidence_grade(df: DataFrame) -> DataFrame:
    """J19 sufficiency of the evidence (0-100) and its grade.

    Columns: pr_auc, base_rate, brier_skill, events, sessions, samples, articles, publishers, has_market, has_fundamentals.
    """
    c = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    skill = F.coalesce(clamp((F.col("pr_auc") - F.col("base_rate")) / F.greatest(F.lit(0.05), 1 - F.col("base_rate")), 0, 1), F.lit(0.0))
    validation = 0.45 * skill + 0.30 * clamp(c("brier_skill"), 0, 1) + 0.25 * clamp(c("events") / 20, 0, 1)
    history = 0.55 * clamp(c("sessions") / 1400, 0, 1) + 0.45 * clamp(c("samples") / 160, 0, 1)
    news = 0.65 * clamp(c("articles") / 40, 0, 1) + 0.35 * clamp(c("publishers") / 8, 0, 1)
    yes = lambda x: F.coalesce(F.col(x), F.lit(True)).cast("double")
    df = df.withColumn("sufficiency", 100 * (0.38 * validation + 0.22 * history + 0.14 * yes("has_market") + 0.13 * news + 0.13 * yes("has_fundamentals")))
    grade = state_band("sufficiency", (45.0, 62.0, 78.0), ("THIN", "LIMITED", "MODERATE", "STRONG"))
    capped = (c("events") < 10) | (c("pr_auc") < c("base_rate"))
    return df.withColumn("grade", F.when(capped & (grade != "THIN"), "LIMITED").otherwise(grade))


def strategy_readout(df: DataFrame) -> DataFrame:
    """J20 points for trend, mean reversion and breakout; the best with at least 3 points, else NONE (ties: in that order)."""
    points = lambda *of: sum((F.when(F.coalesce(F.expr(c), F.lit(False)), n).otherwise(0) for c, n in of), F.lit(0))
    df = df.withColumns({
        "pt_trend": points(("gap20 > 0", 2), ("sma20 > sma50", 2), ("rsi_simple between 50 and 70", 1), ("macd_hist > 0", 1)),
        "pt_reversion": points(("rsi_simple < 35", 3), ("close < boll_down * 1.01", 2), ("gap20 < 0", 1)),
        "pt_breakout": points(("close > prior_high", 3), ("macd_hist > 0", 1), ("rsi_simple > 55", 1), ("close < prior_low", -1)),
    })
    best = F.greatest("pt_trend", "pt_reversion", "pt_breakout")
    return df.withColumn("strategy", F.when(best < 3, "NONE").when(F.col("pt_trend") == best, "TREND").when(F.col("pt_reversion") == best, "REVERSION").otherwise("BREAKOUT"))


def watch_rank(df: DataFrame) -> DataFrame:
    """J21 by date 100 x (.42 alpha between its deciles + .28 up rate + .18 median + .12 (1 - risk)), and the list a row belongs to.

    Columns alpha, up_rate, median, risk (0-100), status, turnover30. YELLOW and RED without turnover become ILLIQUID;
    `list` is WATCH for liquid rows of other states, else the state.
    """
    bounds = df.groupBy("date").agg(F.percentile("alpha", 0.1).alias("_lo"), F.percentile("alpha", 0.9).alias("_hi"))
    place = F.when(F.col("_hi") > F.col("_lo"), (F.coalesce("alpha", F.lit(0.0)) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    c = lambda x, y: F.coalesce(F.col(x), F.lit(y))
    rank = 100 * (0.42 * clamp(place, 0, 1) + 0.28 * clamp((c("up_rate", 0.5) - 0.35) / 0.3, 0, 1) + 0.18 * clamp((c("median", 0.0) + 0.02) / 0.04, 0, 1) + 0.12 * (1 - F.least(F.lit(1.0), c("risk", 50.0) / 100)))
    liquid = c("turnover30", 0.0) >= LEAST_TURNOVER
    status = F.when(~liquid & c("status", "GREEN").isin("YELLOW", "RED"), "ILLIQUID").otherwise(c("status", "GREEN"))
    return df.join(bounds, "date").withColumn("watch_rank", rank).withColumn("list", F.when(status.isin("YELLOW", "RED", "ILLIQUID"), status).when(liquid, "WATCH").otherwise("NONE")).drop("_lo", "_hi")


def agreement(local: str, pooled: str) -> Column:
    """J22 what a local score (0-100) and a pooled percentile (0-100) say together."""
    a, p = F.col(local), 100 * F.col(pooled)
    return F.when((a >= 65) & (p >= 75), "CONVERGENT").when((a >= 65) & (p < 60), "DIVERGENT").when((a < 65) & (p >= 85), "POOLED_ELEVATION").when(a.isNotNull() & p.isNotNull(), "MIXED")


def alert_rises(df: DataFrame, status: str = "status") -> DataFrame:
    """J23 rows on which the band rises to YELLOW or RED against the row before; studies.greedy_gap then keeps them apart."""
    now, before = level(status), F.lag(level(status)).over(by_symbol())
    return df.withColumn("onset", F.coalesce((now >= 2) & (now > before), F.lit(False)))


def proxy_score(df: DataFrame) -> DataFrame:
    """J24 35 % volatility + 25 % drawdown + 20 % momentum + 20 % anomaly, and its band."""
    out = weighted_score(df, {"p_volatility": 0.35, "p_drawdown": 0.25, "p_momentum": 0.20, "p_shock": 0.20}, "proxy_score")
    return out.withColumn("proxy_band", state_band("proxy_score", *PROXY_BANDS))


def rank_weights(metrics: DataFrame) -> DataFrame:
    """J25 by model (model, pr_auc, auc, base_rate, brier_skill, events, grade): rank weight .75 PR skill + .25 AUC skill, and the capped grade.

    Where no model has skill the structural one gets weight 1. A grade above LIMITED becomes LIMITED where PR-AUC is
    not above the base rate, Brier skill is not positive or there are fewer than 10 events.
    """
    pr = F.coalesce(clamp((F.col("pr_auc") - F.col("base_rate")) / F.greatest(F.lit(0.05), 1 - F.col("base_rate")), 0, 1), F.lit(0.0))
    own = 0.75 * pr + 0.25 * F.coalesce(clamp((F.col("auc") - 0.5) / 0.25, 0, 1), F.lit(0.0))
    none = F.max(own).over(Window.partitionBy()) <= 0  # a row per model
    low = (F.coalesce("pr_auc", F.lit(0.0)) <= F.coalesce("base_rate", F.lit(1.0))) | (F.coalesce("brier_skill", F.lit(-1.0)) <= 0) | (F.coalesce(F.col("events"), F.lit(0)) < 10)
    return metrics.withColumn("weight", F.when(none & (F.col("model") == "structural"), 1.0).otherwise(own)).withColumn("grade", F.when(low & F.col("grade").isin("STRONG", "MODERATE"), "LIMITED").otherwise(F.col("grade")))
