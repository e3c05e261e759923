"""Cleaning, eligibility and quality of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol, finite


def clean_bars(bars: DataFrame) -> DataFrame:
    """B1 closes must be finite and above 0; open, high, low default to the close; volume is 0 or more."""
    c = finite(F.col("close").cast("double"))
    fill = lambda x: F.coalesce(finite(F.col(x).cast("double")), F.col("close"))
    return bars.withColumn("close", c).filter("close > 0").withColumns({"open": fill("open"), "high": fill("high"), "low": fill("low"), "volume": F.greatest(F.coalesce(finite(F.col("volume").cast("double")), F.lit(0.0)), F.lit(0.0))})


def repair_envelope(bars: DataFrame, factor: str | None = None) -> DataFrame:
    """B2 open, high, low scaled by a factor column; high and low stretched over all four prices."""
    f = F.col(factor) if factor else F.lit(1.0)
    scaled = bars.withColumns({x: F.col(x) * f for x in ("open", "high", "low")})
    return scaled.withColumns({"high": F.greatest("open", "high", "low", "close"), "low": F.least("open", "high", "low", "close")})


def dedup_last(rows: DataFrame, arrival: list[str]) -> DataFrame:
    """B3 one row per symbol and date, the last to arrive, with the number of rows it replaced."""
    values = [c for c in rows.columns if c not in ("symbol", "date")]
    best = rows.groupBy("symbol", "date").agg(F.max_by(F.struct(*values), F.struct(*arrival)).alias("_v"), (F.count(F.lit(1)) - 1).alias("removed"))
    return best.select("symbol", "date", *[F.col("_v")[c].alias(c) for c in values], "removed")


def unit_scale(bars: DataFrame, n: int = 120, below: float = 1000.0, by: float = 1000.0) -> DataFrame:
    """B4 prices of symbols whose last n closes have a median below a bound are multiplied."""
    tail = bars.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).filter(F.col("_r") <= n)
    scale = tail.groupBy("symbol").agg(F.when(F.median("close") < below, by).otherwise(1.0).alias("unit"))
    return bars.join(scale, "symbol").withColumns({x: F.col(x) * F.col("unit") for x in ("open", "high", "low", "close")})


def strip_incomplete(bars: DataFrame, now: Column, close_minute: int = 15 * 60 + 20) -> DataFrame:
    """B5 bars of today go until the session is over; weekends have no open session. `now` is local time."""
    open_ = (F.weekday(now) < 5) & (F.hour(now) * 60 + F.minute(now) < close_minute)
    return bars.filter((F.col("date") < F.to_date(now)) | ((F.col("date") == F.to_date(now)) & ~open_))


def quality_report(bars: DataFrame, as_of: Column, most_gap: int = 12, most_stale: int = 5) -> DataFrame:
    """B6 per symbol: rows, start, end, years, gaps of more than `most_gap` days, weekdays stale, PASS or REVIEW."""
    gaps = bars.withColumn("_g", F.datediff("date", F.lag("date").over(by_symbol())))
    per = gaps.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("start"), F.max("date").alias("end"), F.count_if(F.col("_g") > most_gap).alias("gaps"), F.max("_g").alias("longest_gap"))
    stale = F.size(F.filter(F.when(as_of > F.col("end"), F.sequence(F.date_add("end", 1), as_of)).otherwise(F.array().cast("array<date>")), lambda d: F.weekday(d) < 5))
    return per.withColumn("years", F.round(F.datediff("end", "start") / 365.25, 4)).withColumn("weekdays_stale", stale).withColumn("verdict", F.when((F.col("gaps") == 0) & (F.col("weekdays_stale") <= most_stale), "PASS").otherwise("REVIEW"))


def modal_date(bars: DataFrame) -> DataFrame:
    """B7 each symbol's last date, the date most symbols end at (the later of equals), and whether the symbol is stale."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("last_date"))
    modal = last.groupBy("last_date").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("last_date", F.struct("n", "last_date")).alias("modal_date"))
    return last.crossJoin(modal).withColumn("stale", F.col("last_date") != F.col("modal_date"))  # one row on the right


def eligibility(bars: DataFrame, least_rows: int = 240, least_turnover: float = 1e5) -> DataFrame:
    """B8 per symbol: row and turnover counts, reasons against it, eligible."""
    r = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    per = bars.withColumn("_r", r).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.when(F.col("_r") <= 30, F.col("close") * F.col("volume"))).alias("turnover30"), F.count_if(F.col("_r") <= 200).alias("sma200_rows"))
    reasons = F.array_compact(F.array(F.when(F.col("rows") < least_rows, "rows"), F.when(F.col("turnover30") < least_turnover, "turnover"), F.when(F.col("sma200_rows") < 200, "sma200")))
    return per.withColumn("reasons", F.concat_ws(",", reasons)).withColumn("eligible", F.size(reasons) == 0)


def cross_match(screener: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B9 (matched, unmatched): screener rows whose symbol and exchange the listing has, one per symbol; and the rest."""
    known = listing.select("symbol", "exchange").dropDuplicates(["symbol", "exchange"])
    return screener.join(known, ["symbol", "exchange"], "left_semi").dropDuplicates(["symbol"]), screener.join(known, ["symbol", "exchange"], "left_anti")


def delisted_cohort(bars: DataFrame, board: DataFrame, cutoff: str, main: str, least: int = 520) -> DataFrame:
    """B10 symbols with a long history that ended before the cutoff and were on the main board (symbol, venue)."""
    per = bars.groupBy("symbol").agg(F.max("date").alias("end"), F.count(F.lit(1)).alias("rows")).filter((F.col("rows") >= least) & (F.col("end") < F.lit(cutoff).cast("date")))
    return per.join(board.filter(F.col("venue") == main).select("symbol"), "symbol", "left_semi")


def as_of(df: DataFrame, date: str) -> DataFrame:
    """B11 rows up to a date."""
    return df.filter(F.col("date") <= F.lit(date).cast("date"))


def coverage(eligible: DataFrame, modal: DataFrame) -> DataFrame:
    """B12 one row: matched, eligible, stale, illiquid and short symbols with their ratios."""
    j = eligible.join(modal.select("symbol", "stale"), "symbol")
    n = F.count(F.lit(1))
    return j.agg(n.alias("matched"), F.count_if("eligible").alias("eligible"), F.count_if("stale").alias("stale"), F.count_if(F.col("reasons").contains("turnover")).alias("illiquid"), F.count_if(F.col("reasons").contains("rows")).alias("insufficient"), F.round(F.try_divide(F.count_if("eligible").cast("double"), n), 6).alias("eligible_ratio"))


def set_difference(universe: DataFrame, histories: DataFrame, requested: DataFrame) -> DataFrame:
    """B13 symbols of the universe without history ('missing'), and those requested that have one ('available')."""
    u, h, r = (x.select("symbol") for x in (universe, histories, requested))
    return u.exceptAll(h).distinct().withColumn("side", F.lit("missing")).unionByName(h.intersect(r).withColumn("side", F.lit("available")))


def output_sanity(fc: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """B14 rule and number of failing rows (or dates) of forecasts (date, symbol, close, r, price, q20, q50, q80)."""
    rows = fc.agg(F.count_if(~((F.col("q20") <= F.col("q50")) & (F.col("q50") <= F.col("q80")))).alias("quantile_order"), F.count_if(F.abs(F.col("price") - F.col("close") * F.exp("r")) > tolerance * F.col("close")).alias("price_identity"), F.count_if(F.col("r").isNull() | F.isnan("r")).alias("finite"))
    mode = fc.groupBy("date", "r").agg(F.count(F.lit(1)).alias("c")).groupBy("date").agg(F.count(F.lit(1)).alias("u"), (F.max("c") / F.sum("c")).alias("m")).agg(F.count_if((F.col("u") < 3) | (F.col("m") >= 0.95)).alias("collapsed"))
    long = rows.unpivot([], ["quantile_order", "price_identity", "finite"], "rule", "failing").unionByName(mode.unpivot([], ["collapsed"], "rule", "failing"))
    return long.withColumn("passed", F.col("failing") == 0)


def cohort_audit(routes: DataFrame, least_ratio: float = 0.98) -> DataFrame:
    """B15 one row of counts over symbols (symbol, deep, verified, truncated, short, eligible), the verified ratio and the gate."""
    c = routes.agg(*[F.count_if(F.col(x)).alias(x) for x in ("deep", "verified", "truncated", "short")], F.count_if(~F.col("eligible")).alias("ineligible"), F.count(F.lit(1)).alias("symbols"))
    ratio = F.try_divide(F.col("verified").cast("double"), F.nullif("deep", F.lit(0)))
    return c.withColumn("verified_ratio", F.round(ratio, 6)).withColumn("passed", F.coalesce(ratio >= least_ratio, F.lit(False)))


def attempt_counts(log: DataFrame) -> DataFrame:
    """B16 by stage of (stage, ok, seconds): attempts, failures, nearest-rank 95th percentile of the seconds."""
    w = Window.partitionBy("stage").orderBy("seconds")
    n = F.count("seconds").over(Window.partitionBy("stage"))
    r = log.withColumn("_r", F.row_number().over(w)).withColumn("_p", F.ceil(n * 0.95))
    return r.groupBy("stage").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~F.col("ok")).alias("failures"), F.max(F.when(F.col("_r") == F.col("_p"), F.col("seconds"))).alias("p95"))
