"""As-of, interval and hierarchy joins over keyed, dated tables. None compares all pairs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str, by: str | None, values: list[str], strict: bool = False) -> DataFrame:
    """F1 left with the values of the last right row at or before (F2 strict: before) its key; null if there is none.

    Both sides are laid in one ordered stream per key and the last right row is carried forward: linear, one shuffle,
    no range join. The values travel as a struct, so a null in the matched row stays null. Of right rows with one key
    the largest values are taken.
    """
    keys = [by] if by else []
    side = F.struct(*values)
    l_ = left.select(*[F.col(k) for k in keys], F.col(on), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(side.alias("s")).schema["s"].dataType).alias("_v"), F.lit(0 if strict else 1).alias("_side"))
    r_ = right.select(*[F.col(k) for k in keys], F.col(on), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_row"), side.alias("_v"), F.lit(1 if strict else 0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(on, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    j = l_.unionByName(r_).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter(F.col("_row").isNotNull())
    return j.select(*[F.col("_row")[c].alias(c) for c in left.columns if c not in values], *[F.col("_last")[v].alias(v) for v in values])


def session_align(sessions: DataFrame, rows: DataFrame, values: list[str]) -> DataFrame:
    """F3 values on exactly the symbol's sessions; no filling forward."""
    return sessions.join(rows.select("symbol", "date", *values), ["symbol", "date"], "left")


def effective_date(at: str = "published_at", cut_minute: int = 15 * 60) -> Column:
    """F4 the calendar day on which an item counts: the next from the cut on, weekends moved to Monday."""
    day = F.date_add(F.to_date(at), F.when(F.hour(at) * 60 + F.minute(at) >= cut_minute, 1).otherwise(0))
    return F.date_add(day, F.when(F.weekday(day) == 5, 2).when(F.weekday(day) == 6, 1).otherwise(0))


def effective_session(items: DataFrame, sessions: DataFrame) -> DataFrame:
    """F4 the first session (symbol, date) at or after each item's effective day; null after the last session.

    A forward as-of join is the backward one with days counted the other way.
    """
    day = items.withColumn("effective", effective_date()).withColumn("_k", -F.unix_date("effective"))
    s = sessions.select("symbol", F.col("date").alias("session"), (-F.unix_date("date")).alias("_k"))
    return asof(day, s, "_k", "symbol", ["session"]).drop("_k")


def benchmark_exact(labels: DataFrame, index: DataFrame, start: str, end: str) -> DataFrame:
    """F5 the index's log return between a row's own two dates; null if the index lacks either."""
    a = index.select(F.col("date").alias(start), F.col("close").alias("_a"))
    b = index.select(F.col("date").alias(end), F.col("close").alias("_b"))
    return labels.join(a, start, "left").join(b, end, "left").withColumn("benchmark", F.log(F.try_divide("_b", "_a"))).drop("_a", "_b")


def trailing_items(sessions: DataFrame, items: DataFrame, days: tuple[int, ...] = (5, 20, 30), weight: str = "weight") -> DataFrame:
    """F6 number and weight of items with date - days <= available <= date, for each session and each span of days.

    Items are summed by day first; sessions and days then share one calendar-range window.
    """
    daily = items.groupBy("symbol", F.col("available").alias("date")).agg(F.count(F.lit(1)).alias("_c"), F.sum(weight).alias("_w"))
    both = sessions.select("symbol", "date", F.lit(True).alias("_s")).unionByName(daily, allowMissingColumns=True).withColumn("_d", F.unix_date("date"))
    for n in days:
        w = Window.partitionBy("symbol").orderBy("_d").rangeBetween(-n, 0)
        both = both.withColumn(f"items{n}", F.coalesce(F.sum("_c").over(w), F.lit(0))).withColumn(f"weight{n}", F.coalesce(F.sum("_w").over(w), F.lit(0.0)))
    return both.filter("_s").drop("_s", "_c", "_w", "_d")


def latest_event(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """F7 the most recent item (id, available) at or before each session."""
    one = items.groupBy("symbol", F.col("available").alias("date")).agg(F.max("id").alias("event_id")).withColumn("event_date", F.col("date"))
    return asof(sessions, one, "date", "symbol", ["event_id", "event_date"]).withColumn("event_age", F.datediff("date", "event_date"))


def analogs_current(df: DataFrame, features: list[str], nearest: int = 40, apart: int = 60, least: int = 80) -> DataFrame:
    """F8 each symbol's own earlier rows nearest to its latest one in z-scored features; candidates end `apart` rows before.

    One join on the symbol with one row per symbol on the right; symbols with fewer than `least` candidates have none.
    """
    whole = Window.partitionBy("symbol")
    ok = df.dropna(subset=features).withColumn("_i", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    z = ok.withColumns({f"_z{k}": F.try_divide(F.col(f) - F.avg(f).over(whole), F.nullif(F.stddev_samp(f).over(whole), F.lit(0.0))) for k, f in enumerate(features)})
    now = z.filter("_i = 1").select("symbol", *[F.col(f"_z{k}").alias(f"_q{k}") for k in range(len(features))])
    distance = sum((F.coalesce(F.pow(F.col(f"_z{k}") - F.col(f"_q{k}"), 2), F.lit(0.0)) for k in range(len(features))), F.lit(0.0))
    d = z.filter(F.col("_i") > apart + 1).join(now, "symbol").withColumn("distance", F.round(F.sqrt(distance), 9)).withColumn("_n", F.count(F.lit(1)).over(whole)).filter(F.col("_n") >= least)
    return d.withColumn("place", F.row_number().over(whole.orderBy("distance", "date"))).filter(F.col("place") <= nearest).drop("_i", "_n", *[f"_{c}{k}" for k in range(len(features)) for c in "zq"])


def analogs_point_in_time(df: DataFrame, features: list[str], states: DataFrame, h: int = 20, nearest: int = 40, apart: int = 60) -> DataFrame:
    """F9 the same for sampled states (symbol, date): candidates are matured and at least `apart` rows older than the state.

    The join is by symbol with an inequality on the place; it is bounded by sampling the states first (D28).
    """
    placed = df.withColumn("_i", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))
    s = placed.join(states.select("symbol", "date"), ["symbol", "date"], "left_semi").select("symbol", F.col("date").alias("state_date"), F.col("_i").alias("_s"), *[F.col(f).alias(f"_q{k}") for k, f in enumerate(features)])
    j = placed.join(s, "symbol").filter((F.col("_i") + max(apart, h) <= F.col("_s")) & (F.col("_i") < F.col("_s") - apart))
    distance = sum((F.pow(F.col(f) - F.col(f"_q{k}"), 2) for k, f in enumerate(features)), F.lit(0.0))
    j = j.withColumn("distance", F.round(F.sqrt(distance), 9)).filter("distance is not null")
    return j.withColumn("place", F.row_number().over(Window.partitionBy("symbol", "state_date").orderBy("distance", "date"))).filter(F.col("place") <= nearest).drop("_i", "_s", *[f"_q{k}" for k in range(len(features))])


def prior_hierarchy(rows: DataFrame, y: str, least: int = 8) -> DataFrame:
    """F10 a prior mean of y by (symbol, event), else (sector, event), else event: the first level with enough rows."""
    out = rows
    for level, keys in (("own", ["symbol", "event"]), ("sector", ["sector", "event"]), ("event", ["event"])):
        out = out.join(rows.groupBy(*keys).agg(F.count(y).alias(f"_n_{level}"), F.avg(y).alias(f"_m_{level}")), keys, "left")
    prior = F.when(F.col("_n_own") >= least, F.col("_m_own")).when(F.col("_n_sector") >= least, F.col("_m_sector")).otherwise(F.col("_m_event"))
    level = F.when(F.col("_n_own") >= least, "own").when(F.col("_n_sector") >= least, "sector").otherwise("event")
    return out.withColumns({"prior": prior, "prior_level": level}).drop(*[f"_{a}_{b}" for a in "nm" for b in ("own", "sector", "event")])


def previous_snapshot(today: DataFrame, before: DataFrame, values: list[str]) -> DataFrame:
    """F11 today's rows with the previous snapshot's values as prev_*."""
    return today.join(before.select("symbol", *[F.col(v).alias(f"prev_{v}") for v in values]), "symbol", "left")


def reject_reasons(items: DataFrame, universe: DataFrame, seen: DataFrame) -> DataFrame:
    """F12 items with the reason against them: outside the universe, seen before, without a title; null is accepted."""
    u, s = universe.select("symbol", F.lit(True).alias("_u")).distinct(), seen.select("id", F.lit(True).alias("_s")).distinct()
    j = items.join(u, "symbol", "left").join(s, "id", "left")
    return j.withColumn("reason", F.when(F.col("_u").isNull(), "outside_universe").when(F.col("_s"), "seen").when(F.coalesce(F.length(F.trim("title")), F.lit(0)) == 0, "no_title")).drop("_u", "_s")


def full_outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """F13 rows of two sources by symbol and date; a side that is missing stays null."""
    return a.join(b, ["symbol", "date"], "full")
