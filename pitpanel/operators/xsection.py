"""Per-date cross-sections. Medians over a date use exact percentiles; a date's symbols fit one task up to millions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import average_rank


def percentile_ranks(df: DataFrame, x: str, name: str, descending: bool = False) -> DataFrame:
    """E1 average-tie percentile rank of x within the date."""
    return df.withColumn(name, average_rank(x, ["date"], descending))


def ordinal_rank(df: DataFrame, x: str, name: str) -> DataFrame:
    """E2 place by (x, symbol) from 0 to 1 within the date; 0 where a date has one row."""
    n, nulls = F.count(F.lit(1)).over(Window.partitionBy("date")), F.count_if(F.col(x).isNull()).over(Window.partitionBy("date"))
    row = F.row_number().over(Window.partitionBy("date").orderBy(F.col(x).asc_nulls_last(), "symbol"))
    place = F.when(F.col(x).isNull(), row - (n - nulls)).otherwise(row + nulls)  # nulls come first; they are sorted last, as average ranks sort them
    return df.withColumn(name, F.coalesce(F.try_divide((place - 1).cast("double"), n - 1), F.lit(0.0)))


def market_state(df: DataFrame) -> DataFrame:
    """E3-E9 one row per date: breadth, medians, dispersion, CSAD, shares, herding, concentration, leadership.

    df has ret1, ret5, ret20, vol20, dd60, gap50, vol_pct, volume_ratio20, turnover, risk. The date's median and the
    turnover's order are window columns, so df is read once and dealt out by date once.
    """
    top = Window.partitionBy("date").orderBy(F.desc_nulls_last("turnover"), "symbol")
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    ranked = df.withColumns({"_n": F.row_number().over(top), "_m": F.greatest(F.floor(n * 0.1), F.lit(1)), "_med20": F.median("ret20").over(Window.partitionBy("date"))})
    share = lambda c: F.avg(F.when(c.isNotNull(), c.cast("double")))
    per = ranked.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("ret1") > 0).alias("breadth"), share(F.col("ret20") < 0).alias("weak_share"), share(F.col("gap50") < 0).alias("below50"),
        F.median("ret1").alias("med1"), F.median("ret5").alias("med5"), F.median("ret20").alias("med20"), F.median("vol20").alias("med_vol"), F.median("dd60").alias("med_dd60"),
        F.stddev_pop("ret1").alias("dispersion"), share(F.col("risk") >= 50).alias("risk_share"), share(F.col("volume_ratio20") > 1).alias("volume_breadth"), share(F.col("vol_pct") >= 0.8).alias("high_vol_share"),
        F.try_divide(F.sum(F.when(F.col("_n") <= F.col("_m"), F.col("turnover"))), F.sum("turnover")).alias("concentration"),
        F.when(F.count("ret20") >= 10, F.percentile("ret20", 0.9) - F.median("ret20")).alias("leadership"),
        F.avg(F.abs(F.col("ret20") - F.col("_med20"))).alias("csad20"),
    )
    return per.withColumn("herding", F.abs("med20") / (F.col("csad20") + 1e-6))


def minimum_cross_section(df: DataFrame, least: int = 80) -> DataFrame:
    """E10 rows of dates with at least `least` distinct symbols."""
    return df.join(df.groupBy("date").agg(F.countDistinct("symbol").alias("_n")).filter(F.col("_n") >= least).select("date"), "date", "left_semi")


def relative_returns(df: DataFrame, x: str = "ret5") -> DataFrame:
    """E11 return less the median of its date and sector, with the sector's breadth; E12 less the date's median."""
    s = Window.partitionBy("date", "sector")
    return df.withColumns({"sector_median": F.median(x).over(s), "sector_breadth": F.avg(F.when(F.col(x).isNotNull(), (F.col(x) > 0).cast("double"))).over(s), "vs_sector": F.col(x) - F.median(x).over(s), "vs_market": F.col(x) - F.median(x).over(Window.partitionBy("date"))})


#: How much of the date's common part a horizon's prediction keeps.
CENTER_SHARE = {1: 1.0, 2: 0.25, 3: 0.0, 4: 1.0, 5: 1.0}


def center_blend(df: DataFrame, x: str, h: int, name: str) -> DataFrame:
    """E13 x less its date's median, plus a horizon's share of that median."""
    centred = F.col(x) - F.median(x).over(Window.partitionBy("date"))
    return df.withColumn(name, centred + CENTER_SHARE[h] * (F.col(x) - centred))


def rank_signal(df: DataFrame, x: str, name: str, power: float = 1.0) -> DataFrame:
    """E14 average rank within the date mapped to (-1, 1), bent by a power that keeps its sign."""
    n = F.count(x).over(Window.partitionBy("date"))
    u = 2 * average_rank(x, ["date"]) - F.try_divide(F.lit(1.0), n) - 1
    return df.withColumn("_u", F.round(u, 12)).withColumn(name, F.signum("_u") * F.pow(F.abs("_u"), F.lit(power))).drop("_u")


def vwap(df: DataFrame, by: list[str]) -> DataFrame:
    """E15 mean price weighted by volume; null without volume."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col("close") * F.col("volume")), F.sum("volume")).alias("vwap"))


def market_table(state: DataFrame, k: int = 5) -> DataFrame:
    """E16 date-level table with k-row deltas of its columns; a row per date, so one window over all is small."""
    w = Window.orderBy("date")
    return state.withColumns({f"{c}_delta": F.col(c) - F.lag(c, k).over(w) for c in ("breadth", "med20", "dispersion")})


def top_bottom_spread(df: DataFrame, score: str, y: str, share: float = 0.2) -> DataFrame:
    """E17 by date: mean outcome of the highest scores less that of the lowest."""
    up, down = Window.partitionBy("date").orderBy(F.desc(score), "symbol"), Window.partitionBy("date").orderBy(score, "symbol")
    n = F.greatest(F.floor(F.count(F.lit(1)).over(Window.partitionBy("date")) * share), F.lit(1))
    r = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down), "_n": n})
    return r.groupBy("date").agg((F.avg(F.when(F.col("_u") <= F.col("_n"), F.col(y))) - F.avg(F.when(F.col("_d") <= F.col("_n"), F.col(y)))).alias("spread"), F.count(F.lit(1)).alias("n"))


def group_moments(df: DataFrame, by: str, x: str) -> DataFrame:
    """E18 mean, deviation, skewness and kurtosis of x by group."""
    return df.groupBy(by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))
