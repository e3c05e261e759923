"""Outcomes of archived states: matured, pending or lost; prequential evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .xsection import percentile_ranks


def outcomes(archive: DataFrame, after: int = 20, drop: float = -0.12) -> DataFrame:
    """K47 each archived state (model_date, symbol, close, more) after exactly `after` later archive dates.

    PENDING with fewer later dates, UNRESOLVED_DATA_GAP if a close is missing in between, else MATURED with the worst
    close over the state's, and whether that reached the drop. Dates are numbered once; closes are joined by number,
    `after` rows per state.
    """
    dates = archive.select("model_date").distinct().withColumn("_d", F.row_number().over(Window.orderBy("model_date"))).withColumn("_last", F.max("_d").over(Window.partitionBy()))  # a row per date
    a = archive.join(dates, "model_date")
    asks = a.select("symbol", "model_date", "_d", "_last", F.col("close").alias("_c0"), F.explode(F.sequence(F.lit(1), F.lit(after))).alias("_k")).withColumn("_at", F.col("_d") + F.col("_k"))
    later = a.select("symbol", F.col("_d").alias("_at"), F.col("close").alias("_c"))
    per = asks.join(later, ["symbol", "_at"], "left").groupBy("symbol", "model_date", "_d", "_last").agg(F.count("_c").alias("_n"), F.min(F.try_divide("_c", "_c0")).alias("_worst"))
    status = F.when(F.col("_d") + after > F.col("_last"), "PENDING").when(F.col("_n") < after, "UNRESOLVED_DATA_GAP").otherwise("MATURED")
    per = per.withColumn("outcome", status).withColumn("worst", F.when(F.col("outcome") == "MATURED", F.col("_worst") - 1)).withColumn("event", F.when(F.col("outcome") == "MATURED", F.col("worst") <= drop))
    return archive.join(per.select("symbol", "model_date", "outcome", "worst", "event"), ["symbol", "model_date"])


def track_record(matured: DataFrame) -> DataFrame:
    """K47 by status: states, matured ones, event rate, lift over all matured."""
    every = Window.partitionBy()
    t = matured.groupBy("status").agg(F.count(F.lit(1)).alias("states"), F.count("event").alias("matured"), F.sum(F.col("event").cast("long")).alias("events"))
    rate = F.try_divide(F.col("events").cast("double"), F.nullif("matured", F.lit(0)))
    base = F.try_divide(F.sum("events").over(every).cast("double"), F.nullif(F.sum("matured").over(every), F.lit(0)))
    return t.withColumn("rate", rate).withColumn("lift", F.try_divide(rate, F.nullif(base, F.lit(0.0))))


def prequential(forecasts: DataFrame) -> DataFrame:
    """K48 per origin and horizon of (date, symbol, h, p50, q20, q80, y): IC, hit rate, interval hits, MAE and its skill against 0."""
    d = forecasts.filter("y is not null and p50 is not null").withColumn("_key", F.concat_ws(":", F.col("date").cast("string"), F.col("h").cast("string")))
    r = percentile_ranks(percentile_ranks(d.withColumn("_date", F.col("date")).withColumn("date", F.col("_key")), "p50", "_a"), "y", "_b").withColumn("date", F.col("_date"))
    mae = F.avg(F.abs(F.col("y") - F.col("p50")))
    return r.groupBy("date", "h").agg(F.count(F.lit(1)).alias("n"), F.corr("_a", "_b").alias("ic"), F.avg((F.signum("y") == F.signum("p50")).cast("double")).alias("hit"), F.avg(F.col("y").between(F.col("q20"), F.col("q80")).cast("double")).alias("inside"), mae.alias("mae"), (1 - F.try_divide(mae, F.avg(F.abs("y")))).alias("skill"))
