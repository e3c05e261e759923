"""Per-symbol ordered windows: returns, volatility, oscillators, volume, labels. All share one partitioning and order.

Every operator takes bars (symbol, date, open, high, low, close, volume, more) and adds columns. Trailing windows never
see a later row; labels see only later rows. Null closes give null features; a frame too short gives null where the
rule needs all rows, as each docstring says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol, clamp, following, trailing, with_ema, with_emas
from ..functions.frames import Frame, frame_name, with_frames

YEAR = 252


def _lag(x: str, k: int):
    return F.lag(x, k).over(by_symbol())


_TAKEN = {"count": F.count, "mean": F.avg, "sd": F.stddev_samp, "max": F.max}


def taken(df: DataFrame, kind: str, x: str, n: int, last: int = 0, of: Column | None = None) -> Column:
    """The frame's value: the column that with_frames() has made of it, else a window over x (or `of`, where x only names it)."""
    name, w = frame_name(kind, x, n, last), trailing(n, last)
    if name in df.columns:
        return F.col(name)
    v = F.col(x) if of is None else of
    return F.when(F.count(v).over(w) >= n, F.avg(v).over(w)) if kind == "whole" else _TAKEN[kind](v).over(w)


def _named(*frames: Frame) -> dict[str, Frame]:
    return {frame_name(f.kind, f.of, f.n, f.last): f for f in frames}


#: Frames by the columns that the operators below look for: the year's place of D3's volatility (which is one of them), the strength index, traded volume.
YEAR_FRAMES = {"vol20": Frame("sd", "ret1", 20, 0, 20, YEAR**0.5)} | _named(*[Frame(k, "vol20", 252, -1) for k in ("below", "count")])
RSI_FRAMES = _named(Frame("mean", "_up", 14), Frame("mean", "_down", 14), Frame("count", "_d", 14))
TRADED_FRAMES = _named(*[Frame(k, "_traded", 20, -1) for k in ("mean", "sd")])
#: Those of D3, D4, D12 and D13, of D17 and D18, and of the scan's scores.
STATE_FRAMES = YEAR_FRAMES | _named(*[Frame("whole", "close", n) for n in (20, 50, 200)], *[Frame("max", "close", n) for n in (20, 60)])
REVERSAL_FRAMES = RSI_FRAMES | TRADED_FRAMES | _named(*[Frame("sd", "ret1", n) for n in (5, 20)], Frame("mean", "close", 5), Frame("mean", "close", 20), Frame("mean", "_span", 5))
SCAN_FRAMES = YEAR_FRAMES | RSI_FRAMES | TRADED_FRAMES | _named(*[Frame("whole", "close", n) for n in (50, 200)], Frame("max", "close", 60), *[Frame("mean", "volume", n) for n in (10, 30)])


def frame_inputs(df: DataFrame) -> DataFrame:
    """df with the columns that frames are taken of besides its own; before other windows than by symbol and date, they share the sort of returns()."""
    d = F.col("close") - _lag("close", 1)
    return df.withColumns({"_d": d, "_up": _up(d), "_down": _up(-d), "_traded": _traded(), "_span": _span()})


def framed(df: DataFrame, frames: dict[str, Frame], keep: list[str]) -> DataFrame:
    """symbol, date and the columns `keep` of rows with returns() and frame_inputs(), with the frames, all made in one pass.

    Rows are left in the order of symbol and date. The sort also ends the generated method, so that the frames and the
    features made of them do not share one too long to be compiled.
    """
    return with_frames(df, frames, keep).sortWithinPartitions("symbol", "date")


def unframed(df: DataFrame) -> DataFrame:
    """df without the frames, once all features are made of them."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def _up(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def _traded() -> Column:
    return F.when(F.col("volume") > 0, F.col("volume"))


def _span() -> Column:
    return F.try_divide(F.col("high") - F.col("low"), "close")


def returns(bars: DataFrame, log: tuple[int, ...] = (1, 2, 3, 5, 10, 20, 60), simple: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """D1 log returns ret{k}, D2 simple returns sret{k} over k rows."""
    out = {f"ret{k}": F.log(F.try_divide("close", _lag("close", k))) for k in log} | {f"sret{k}": F.try_divide("close", _lag("close", k)) - 1 for k in simple}
    return bars.withColumns(out)


def realized_volatility(df: DataFrame, n: int = 20, annualised: bool = True) -> DataFrame:
    """D3 sample deviation of n log returns as vol{n}: annualised (all n needed), or raw, held in [.002, .09], from n / 2 on."""
    w = trailing(n)
    sd, seen = F.stddev_samp("ret1").over(w), F.count("ret1").over(w)
    return df.withColumn(f"vol{n}", F.when(seen >= n, sd * YEAR**0.5) if annualised else F.when(seen >= n // 2, clamp(sd, 0.002, 0.09)))


def moving_average_gaps(df: DataFrame, spans: tuple[int, ...] = (5, 10, 20, 50, 100, 200)) -> DataFrame:
    """D4 close over its mean of n rows, less 1; null until n rows are there."""
    return df.withColumns({f"gap{n}": F.try_divide("close", taken(df, "whole", "close", n)) - 1 for n in spans})


def exponential_means(df: DataFrame, spans: tuple[int, ...] = (12, 26)) -> DataFrame:
    """D5 recursive exponential means ema{n} with alpha 2 / (n + 1)."""
    return with_emas(df, {f"ema{n}": ("close", 2.0 / (n + 1)) for n in spans})


def macd(df: DataFrame) -> DataFrame:
    """D6 macd, signal, hist and the two ratios to the close."""
    df = exponential_means(df).withColumn("macd", F.col("ema12") - F.col("ema26"))
    df = with_ema(df, "macd_signal", "macd", 0.2)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).withColumn("macd_gap", F.try_divide("macd_hist", "close")).withColumn("macd_ratio", F.try_divide("macd", "close"))


def rsi_wilder(df: DataFrame, n: int = 14) -> DataFrame:
    """D7 relative strength with exponential means (alpha 1 / n) of gains and losses; 100 without losses."""
    d = F.coalesce(F.col("close") - _lag("close", 1), F.lit(0.0))
    df = df.withColumn("_gain", F.greatest(d, F.lit(0.0))).withColumn("_loss", F.greatest(-d, F.lit(0.0)))
    df = with_emas(df, {"_up": ("_gain", 1.0 / n), "_down": ("_loss", 1.0 / n)})
    return df.withColumn("rsi_wilder", F.when(F.col("_down") > 1e-12, 100 - 100 / (1 + F.col("_up") / F.col("_down"))).when(F.col("_up") > 1e-12, 100.0).otherwise(50.0)).drop("_gain", "_loss", "_up", "_down")


def rsi_simple(df: DataFrame, n: int = 14) -> DataFrame:
    """D8 relative strength with plain means of n differences: 50 before n of them, 100 where losses vanish."""
    d = F.col("close") - _lag("close", 1)
    df = df.withColumn("_d", d)
    up, down, seen = taken(df, "mean", "_up", n, of=_up(F.col("_d"))), taken(df, "mean", "_down", n, of=_up(-F.col("_d"))), taken(df, "count", "_d", n)
    return df.withColumn("rsi_simple", F.when(seen < n, 50.0).when(down < 1e-12, 100.0).otherwise(100 - 100 / (1 + F.try_divide(up, down)))).drop("_d")


def stochastic(df: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    """D9 %K of the close in the range of n rows, %D its mean of `smooth` rows."""
    low, high = F.min("low").over(trailing(n)), F.max("high").over(trailing(n))
    df = df.withColumn("stoch_k", F.when(F.count("close").over(trailing(n)) >= n, 100 * F.try_divide(F.col("close") - low, high - low)))
    return df.withColumn("stoch_d", F.when(F.count("stoch_k").over(trailing(smooth)) >= smooth, F.avg("stoch_k").over(trailing(smooth))))


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    """D10 mean true range of n rows (n / 2 at least) over the close."""
    before = _lag("close", 1)
    df = df.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return df.withColumn("atr", F.when(F.count("_tr").over(trailing(n)) >= n // 2, F.try_divide(F.avg("_tr").over(trailing(n)), F.col("close")))).drop("_tr")


def candle_shape(df: DataFrame) -> DataFrame:
    """D11 range, body, gap to the close before, and the close's place in the range (0.5 if flat)."""
    span = F.col("high") - F.col("low")
    return df.withColumns({"range": F.try_divide(span, "close"), "body": F.try_divide(F.col("close") - F.col("open"), "open"), "gap_open": F.try_divide("open", _lag("close", 1)) - 1, "close_place": F.when(span <= 0, 0.5).otherwise(F.try_divide(F.col("close") - F.col("low"), span))})


def drawdowns(df: DataFrame, spans: tuple[int, ...] = (20, 60)) -> DataFrame:
    """D12 close over the highest close of n rows, less 1."""
    return df.withColumns({f"dd{n}": F.try_divide("close", taken(df, "max", "close", n)) - 1 for n in spans})


def volatility_percentile(df: DataFrame, vol: str = "vol20", back: int = 252, least: int = 60) -> DataFrame:
    """D13 share of the trailing volatilities that are at most the current one: vol_pct of those before, vol_pct_incl with the current row."""
    below, seen = frame_name("below", vol, back, -1), frame_name("count", vol, back, -1)
    if below in df.columns:
        df = df.withColumn("_below", F.col(below)).withColumn("_n", F.col(seen))
    else:
        df = df.withColumn("_past", F.collect_list(vol).over(trailing(back, -1)))
        df = df.withColumn("_below", F.size(F.filter("_past", lambda x: x <= F.col(vol)))).withColumn("_n", F.size("_past"))
    known = F.col(vol).isNotNull() & (F.col("_n") >= least)
    return df.withColumns({"vol_pct": F.when(known, F.col("_below") / F.col("_n")), "vol_pct_incl": F.when(known, (F.col("_below") + 1) / (F.col("_n") + 1))}).drop("_past", "_below", "_n")


def volume_scores(df: DataFrame, n: int = 20) -> DataFrame:
    """D14 z of volume against n positive volumes before; D15 z with the current row, ratios to means of 5 and 20."""
    z = lambda x, last, of=None: F.try_divide(F.col("volume") - taken(df, "mean", x, n, last, of), F.nullif(taken(df, "sd", x, n, last, of), F.lit(0.0)))
    out = {"volume_z_prior": z("_traded", -1, _traded()), "volume_z_incl": z("volume", 0)}
    out |= {f"volume_ratio{k}": F.try_divide("volume", taken(df, "mean", "volume", k)) for k in (5, 20)}
    return df.withColumns(out)


def shock(df: DataFrame, n: int = 20) -> DataFrame:
    """D16 z of the return against the n returns before."""
    return df.withColumn("shock_z", F.try_divide(F.col("ret1") - taken(df, "mean", "ret1", n, -1), F.nullif(taken(df, "sd", "ret1", n, -1), F.lit(0.0))))


def reversal_a(df: DataFrame) -> DataFrame:
    """D17 return over volatility turned round, short against long drift, short against long volatility."""
    df = df.withColumns({f"_v{n}": taken(df, "sd", "ret1", n) for n in (5, 20)})
    return df.withColumns({"rev_z": -F.try_divide("ret1", F.nullif("_v20", F.lit(0.0))), "drift_gap": F.col("ret5") / 5 - F.col("ret20") / 20, "vol_ratio": F.try_divide("_v5", F.nullif("_v20", F.lit(0.0)))}).drop("_v5", "_v20")


def reversal_b(df: DataFrame) -> DataFrame:
    """D18 twelve stretch, snap-back, regime and signature features of a panel with rsi_simple and volume_z_prior, each held in a fixed range.

    Volatilities are annualised. Missing inputs count as 0 (the strength index as its middle).
    """
    c = lambda x, low, high, none=0.0: F.coalesce(clamp(x if isinstance(x, Column) else F.col(x), low, high), F.lit(float(none)))
    df = df.withColumns({f"_v{n}": F.greatest(c(taken(df, "sd", "ret1", n) * YEAR**0.5, 0, 2), F.lit(1e-5)) for n in (5, 20)} | {"_g1": c(_span(), 0, 2), "_g5": F.greatest(c(taken(df, "mean", "_span", 5, of=_span()), 0, 2), F.lit(1e-5))})
    df = df.withColumns({f"_r{k}": c(f"ret{k}", -1, 1) for k in (1, 2, 5, 10, 20)})
    df = df.withColumns({f"_t{n}": c(F.try_divide("close", taken(df, "mean", "close", n)) - 1, -2, 2) for n in (5, 20)} | {"_rsi": c(F.col("rsi_simple") / 100, 0, 1, 0.5), "_z": c("volume_z_prior", -8, 8)})
    up = lambda x: F.greatest(F.col(x), F.lit(0.0))
    down = lambda x: F.greatest(-F.col(x), F.lit(0.0))
    oversold, overbought = F.greatest((0.45 - F.col("_rsi")) / 0.45, F.lit(0.0)), F.greatest((F.col("_rsi") - 0.55) / 0.45, F.lit(0.0))
    snap = F.col("_r1") - F.col("_r5") / 5
    return df.withColumns({
        "stretch20_vol": clamp(-F.col("_r20") / (F.col("_v20") * 20**0.5 + 1e-6), -6, 6), "stretch10_vol": clamp(-F.col("_r10") / (F.col("_v20") * 10**0.5 + 1e-6), -6, 6),
        "snapback1v5": clamp(snap, -0.25, 0.25), "snapback2v10": clamp(F.col("_r2") - F.col("_r10") / 5, -0.35, 0.35),
        "vol_regime_shift": clamp(F.col("_v5") / F.col("_v20") - 1, -3, 5), "range_regime_shift": clamp(F.col("_g1") / F.col("_g5") - 1, -3, 5),
        "oversold_pressure": clamp(oversold * down("_r20") * 10, 0, 5), "overbought_pressure": clamp(overbought * up("_r20") * 10, 0, 5),
        "rebound_signature": clamp(down("_r20") * up("_r1") * 100, 0, 5), "breakdown_signature": clamp(up("_r20") * down("_r1") * 100, 0, 5),
        "trend_compression": clamp(F.col("_t5") - F.col("_t20"), -2, 2), "volume_shock": clamp(F.col("_z") * snap, -2, 2),
    }).drop("_v5", "_v20", "_g1", "_g5", *[f"_r{k}" for k in (1, 2, 5, 10, 20)], "_t5", "_t20", "_rsi", "_z")


def turnover(df: DataFrame) -> DataFrame:
    """D19 median of the positive close x volume of 20 rows, mean of 30 rows, and its log1p."""
    df = df.withColumn("_t", F.col("close") * F.col("volume"))
    s = F.array_sort(F.collect_list(F.when(F.col("_t") > 0, F.col("_t"))).over(trailing(20)))
    df = df.withColumn("_s", s)
    n = F.size("_s")
    median = F.when(n > 0, (F.element_at("_s", F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int")) + F.element_at("_s", F.greatest(F.floor((n + 2) / 2), F.lit(1)).cast("int"))) / 2)
    mean = F.avg("_t").over(trailing(30))
    return df.withColumns({"turnover_median20": median, "turnover_mean30": mean, "turnover_log": F.log1p(mean)}).drop("_t", "_s")


def return_lags(df: DataFrame, lags: int = 5) -> DataFrame:
    """D20 the last returns, lag 0 on."""
    return df.withColumns({f"lag{k}": _lag("ret1", k) for k in range(lags)})


def deltas(df: DataFrame, names: tuple[str, ...], k: int = 5) -> DataFrame:
    """D21 each feature less its value k rows earlier."""
    return df.withColumns({f"{c}_delta{k}": F.col(c) - _lag(c, k) for c in names})


def calendar(df: DataFrame, ahead: int = 5) -> DataFrame:
    """D22 day of the week (Monday 0) and the next weekdays."""
    nxt = F.slice(F.filter(F.sequence(F.date_add("date", 1), F.date_add("date", 2 * ahead + 2)), lambda d: F.weekday(d) < 5), 1, ahead)
    return df.withColumns({"weekday": F.weekday("date"), "next_days": nxt})


def label_returns(df: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """D23 log return to the h-th later row, D24 that row's date and close; null until it exists."""
    w = by_symbol()
    return df.withColumns({f"y{h}": F.log(F.try_divide(F.lead("close", h).over(w), F.col("close"))) for h in horizons} | {f"matures{h}": F.lead("date", h).over(w) for h in horizons} | {f"future{h}": F.lead("close", h).over(w) for h in horizons})


def forward_extremes(df: DataFrame, h: int = 20) -> DataFrame:
    """D25 worst close of the next h rows over this one, less 1 (all h needed); D26 with fewer rows allowed; D27 best gain, and both floored at 0 as a loss and a gain."""
    w = following(h)
    low, high, n = F.try_divide(F.min("close").over(w), F.col("close")) - 1, F.try_divide(F.max("close").over(w), F.col("close")) - 1, F.count("close").over(w)
    return df.withColumns({"fwd_dd_strict": F.when(n == h, low), "fwd_dd": low, "fwd_rebound": F.when(n == h, high), "fwd_loss": F.least(low, F.lit(0.0)), "fwd_gain": F.greatest(high, F.lit(0.0))})


def sample_every(df: DataFrame, k: int = 5, by_date: bool = False) -> DataFrame:
    """D28 every k-th row of a symbol, or the rows of every k-th distinct date."""
    if not by_date:
        return df.withColumn("_n", F.row_number().over(by_symbol())).filter(F.col("_n") % k == 0).drop("_n")
    dates = df.select("date").distinct().withColumn("_n", F.row_number().over(Window.orderBy("date"))).filter(F.col("_n") % k == 0).select("date")
    return df.join(dates, "date", "left_semi")


def weekly(df: DataFrame) -> DataFrame:
    """D29 one bar per symbol and week that ends on Friday."""
    friday = F.date_add("date", F.pmod(F.lit(4) - F.weekday("date"), F.lit(7)))
    return df.groupBy("symbol", friday.alias("week")).agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))


def sessions_since(df: DataFrame, condition: str, name: str, most: int = 60) -> DataFrame:
    """D30 rows since the condition last held, at most `most`; `most` where it never did."""
    place = F.row_number().over(by_symbol())
    df = df.withColumn("_p", place).withColumn("_last", F.when(F.expr(condition), F.col("_p")))
    return df.withColumn(name, F.least(F.coalesce(F.col("_p") - F.last("_last", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)), F.lit(most)), F.lit(most))).drop("_p", "_last")


def bands(df: DataFrame, n: int = 20) -> DataFrame:
    """D31 Bollinger bands (mean of n plus and minus 2 population deviations) and cumulative signed volume."""
    mean, sd = F.avg("close").over(trailing(n)), F.stddev_pop("close").over(trailing(n))
    ok = F.count("close").over(trailing(n)) >= n
    df = df.withColumns({"boll_mid": F.when(ok, mean), "boll_up": F.when(ok, mean + 2 * sd), "boll_down": F.when(ok, mean - 2 * sd), "_s": F.coalesce(F.signum(F.col("close") - _lag("close", 1)), F.lit(0.0)) * F.col("volume")})
    return df.withColumn("obv", F.sum("_s").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def prior_range(df: DataFrame, n: int = 20) -> DataFrame:
    """D32 highest and lowest close of the n rows before the current one."""
    return df.withColumns({"prior_high": F.max("close").over(trailing(n, -1)), "prior_low": F.min("close").over(trailing(n, -1))})
