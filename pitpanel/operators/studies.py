"""Aggregations, event and state studies, episodes, top-k."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol


def stats(y: str) -> list[Column]:
    """G1 n, mean, median, positive rate, q20, q80, standard error and t of an outcome."""
    se = F.stddev_samp(y) / F.sqrt(F.count(y).cast("double"))
    return [F.count(y).alias("n"), F.avg(y).alias("mean"), F.median(y).alias("median"), F.avg(F.when(F.col(y).isNotNull(), (F.col(y) > 0).cast("double"))).alias("positive_rate"), F.percentile(y, 0.2).alias("q20"), F.percentile(y, 0.8).alias("q80"), se.alias("se"), F.try_divide(F.avg(y), F.nullif(se, F.lit(0.0))).alias("t")]


def response_stats(df: DataFrame, by: list[str], y: str) -> DataFrame:
    """G1 the statistics by group."""
    return df.groupBy(*by).agg(*stats(y))


def multi_key_study(df: DataFrame, y: str, alone: tuple[str, ...] = ("cluster", "source_class", "stream")) -> DataFrame:
    """G2 the statistics over event, event x label, sector x event, sector x event x label, and each key of `alone` by itself: one pass by grouping sets."""
    names = ("event", "label", "sector", *alone)
    c = {x: F.col(x) for x in names}
    sets = [["event"], ["event", "label"], ["sector", "event"], ["sector", "event", "label"], *[[x] for x in alone]]
    return df.groupingSets([[c[x] for x in keys] for keys in sets], *c.values()).agg(F.grouping_id().cast("long").alias("level"), *stats(y))


def abnormal_returns(df: DataFrame, y: str, least: int = 8) -> DataFrame:
    """G3 outcome less the median of its date, where the date has enough peers."""
    w = Window.partitionBy("date")
    return df.withColumn("ar", F.when(F.count(y).over(w) >= least, F.col(y) - F.median(y).over(w)))


def confirmation(df: DataFrame, by: list[str], after: str = "y2", before: str = "ret5", band: float = 0.01) -> DataFrame:
    """G4 by group: share confirmed after two sessions, share that moved before, and whether news followed the price."""
    sign = F.signum("score")
    ok = F.avg(F.when(F.abs(after) > band, (F.signum(after) == sign).cast("double")))
    pre = F.avg(F.when(F.col(before).isNotNull(), (F.abs(before) > band).cast("double")))
    return df.groupBy(*by).agg(ok.alias("confirmed"), pre.alias("premove"), (pre > F.coalesce(ok, F.lit(0.0))).alias("follows_price"))


def macro_states(macro: DataFrame, weights: dict[str, float], back: int = 20, z_back: int = 252) -> DataFrame:
    """G5 by date: weighted `back`-row returns of the series (weights of missing ones given to the rest), z against the last scores, state.

    macro is long (series, date, value); few series, so the date table is small.
    """
    w = Window.partitionBy("series").orderBy("date")
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    r = macro.withColumn("r", F.log(F.try_divide("value", F.lag("value", back).over(w)))).withColumn("w", weight[F.col("series")]).filter("r is not null and w is not null")
    score = r.groupBy("date").agg(F.try_divide(F.sum(F.col("r") * F.col("w")), F.sum(F.abs("w"))).alias("score"), F.count("r").alias("series_used"))
    past = Window.orderBy("date").rowsBetween(-z_back + 1, 0)
    z = F.try_divide(F.col("score") - F.avg("score").over(past), F.nullif(F.stddev_samp("score").over(past), F.lit(0.0)))
    return score.withColumn("z", z).withColumn("state", F.when(F.col("z") >= 0.75, "SUPPORTIVE").when(F.col("z") <= -0.75, "STRESS").when(F.col("z").isNotNull(), "NEUTRAL"))


def state_study(states: DataFrame, outcomes: DataFrame, keys: list[str], y: str, least: int = 250) -> DataFrame:
    """G5, G6 outcome statistics by state, joined on the keys; flagged where a state has fewer than `least` rows."""
    return states.filter("state is not null").join(outcomes, keys).groupBy("state").agg(*stats(y)).withColumn("sufficient", F.col("n") >= least)


def matured_priors(events: DataFrame, y: str) -> DataFrame:
    """G7 for each event (id, symbol, sector, event, date, matures, y): n_, mean_ and hits_ of the outcomes that had matured by its date.

    Levels: own (symbol and event class), sector (sector and class), market (class). Outcomes are summed by maturity
    day; events ask by day, so a running sum over days carries each key, and outcomes of one day enter together.
    """
    out = events
    for level, keys in (("own", ["symbol", "event"]), ("sector", ["sector", "event"]), ("market", ["event"])):
        told = events.filter(F.col(y).isNotNull() & F.col("matures").isNotNull()).groupBy(*keys, F.col("matures").alias("date")).agg(F.count(y).alias("_n"), F.sum(F.col(y).cast("decimal(28,9)")).alias("_s"), F.count_if(F.col(y) > 0).alias("_h"))
        days = events.select(*keys, "date").distinct().withColumn("_ask", F.lit(True)).join(told, [*keys, "date"], "full_outer")
        w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        n = F.coalesce(F.sum("_n").over(w), F.lit(0))
        run = days.withColumns({f"n_{level}": n, "_t": F.sum("_s").over(w).cast("double"), "_p": F.sum("_h").over(w)}).filter("_ask")
        run = run.select(*keys, "date", f"n_{level}", F.try_divide("_t", F.col(f"n_{level}").cast("double")).alias(f"mean_{level}"), F.try_divide(F.col("_p").cast("double"), F.col(f"n_{level}").cast("double")).alias(f"hits_{level}"))
        out = out.join(run, [*keys, "date"], "left")
    return out


def shrink(df: DataFrame, kappa: float = 16.0, kappa_hits: float = 6.0) -> DataFrame:
    """G8 from matured_priors(): the market's mean and hit rate shrunk by n / 60, the sector's to it by n / 30, the symbol's to that by n / 8.

    A level without outcomes stands on the one above. Also a normal posterior of strength kappa and a Beta posterior
    of strength kappa_hits around the market's, with the uncertainty of either.
    """
    n = lambda x: F.coalesce(F.col(f"n_{x}"), F.lit(0)).cast("double")
    market, sector = {"n": n("market"), "mean": F.coalesce("mean_market", F.lit(0.0)), "hits": F.coalesce("hits_market", F.lit(0.5))}, {}
    for k in ("n", "mean", "hits"):
        sector[k] = F.when(n("sector") > 0, n("sector") if k == "n" else F.col(f"{k}_sector")).otherwise(market[k])
    own = {k: F.when(n("own") > 0, n("own") if k == "n" else F.col(f"{k}_own")).otherwise(sector[k]) for k in ("n", "mean", "hits")}
    wm, ws, wo = (F.least(F.lit(1.0), x["n"] / cap) for x, cap in ((market, 60.0), (sector, 30.0), (own, 8.0)))
    mean = wo * own["mean"] + (1 - wo) * (ws * sector["mean"] + (1 - ws) * wm * market["mean"])
    hit = wo * own["hits"] + (1 - wo) * (ws * sector["hits"] + (1 - ws) * (wm * market["hits"] + (1 - wm) * 0.5))
    k = n("own")
    return df.withColumns({
        "shrunk_mean": mean, "shrunk_hit": hit, "level": F.when(n("own") >= 8, "STOCK").when(n("sector") >= 20, "SECTOR").otherwise("MARKET"), "prior_n": F.when(n("own") > 0, n("own")).when(n("sector") > 0, n("sector")).otherwise(n("market")).cast("long"),
        "posterior_mean": (k * F.coalesce("mean_own", F.lit(0.0)) + kappa * market["mean"]) / (k + kappa), "posterior_hit": (k * F.coalesce("hits_own", F.lit(0.0)) + kappa_hits * market["hits"]) / (k + kappa_hits), "uncertainty": 1 / F.sqrt(k + kappa),
    })


def daily_from_cumulative(df: DataFrame) -> DataFrame:
    """G9 abnormal return of day h from cumulative ones (event_key, h, car): the first as it is, null across gaps of h."""
    w = Window.partitionBy("event_key").orderBy("h")
    return df.withColumn("ar", F.when(F.col("h") == 1, F.col("car")).when(F.lag("h").over(w) == F.col("h") - 1, F.col("car") - F.lag("car").over(w)))


def weighted_evidence(items: DataFrame, by: list[str], x: str, w: str, least: float = 0.01) -> DataFrame:
    """G10 by group: mean of x weighted by w where w is at least a bound, share of items below 0, distinct publishers."""
    ok = F.col(w) >= least
    return items.groupBy(*by).agg(F.try_divide(F.sum(F.when(ok, F.col(x) * F.col(w))), F.sum(F.when(ok, F.col(w)))).alias("evidence"), F.avg((F.col(x) < 0).cast("double")).alias("negative_share"), F.countDistinct("publisher").alias("publishers"), F.count(F.lit(1)).alias("items"))


def tail_rows(df: DataFrame, n: int = 1) -> DataFrame:
    """G11 the last n rows of each symbol."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).filter(F.col("_r") <= n).drop("_r")


def top_attention(scan: DataFrame, n: int = 30) -> DataFrame:
    """G12 the report of the n rows that need attention: escalations, then RED before YELLOW, then score; the symbol breaks ties."""
    order = F.when(F.col("status") == "RED", 0).when(F.col("status") == "YELLOW", 1).otherwise(2)
    return scan.orderBy(F.desc("escalated"), order, F.desc("score"), "symbol").limit(n)


def episodes(df: DataFrame, positive: str, gap: int = 20, alert: str | None = None) -> DataFrame:
    """G13 positive rows of a symbol at most `gap` rows apart form an episode: start, end, rows, and whether an alert fell in it."""
    placed = df.withColumn("_i", F.row_number().over(by_symbol())).filter(positive)
    w = by_symbol()
    new = F.coalesce(F.col("_i") - F.lag("_i").over(w) > gap, F.lit(True))
    told = F.expr(alert) if alert else F.lit(None).cast("boolean")
    ids = placed.withColumn("_new", new.cast("int")).withColumn("_alert", told).withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ids.groupBy("symbol", "episode").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.bool_or("_alert"), F.lit(False)).alias("alerted"))


def episode_recall(found: DataFrame) -> DataFrame:
    """G13 share of episodes with an alert."""
    return found.agg(F.count(F.lit(1)).alias("episodes"), F.count_if("alerted").alias("caught"), F.try_divide(F.count_if("alerted").cast("double"), F.count(F.lit(1))).alias("recall"))


def greedy_gap(df: DataFrame, event: str, gap: int = 30) -> DataFrame:
    """G14 a symbol's events taken in order, each at least `gap` rows after the one taken before.

    Which event is taken depends on the one taken before, so each symbol's event rows (not all its rows) go through a
    Python function, in chunks: a symbol of any length needs constant memory beyond its events.
    """
    placed = df.withColumn("row", F.row_number().over(by_symbol()).cast("long")).filter(event).select("symbol", "date", "row")

    def take(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict = {}
        for chunk in groups:
            keep = []
            for s, r in zip(chunk.symbol, chunk.row, strict=True):
                ok = s not in last or r - last[s] >= gap
                if ok:
                    last = {s: r}  # rows come by symbol, so one symbol is remembered
                keep.append(ok)
            yield chunk[keep]

    return placed.repartition("symbol").sortWithinPartitions("symbol", "row").mapInPandas(take, placed.schema)


def worst_cases(events: DataFrame, score: str, n: int = 8) -> DataFrame:
    """G14 the n events of each symbol with the lowest score."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(score, "date"))).filter(F.col("_r") <= n).drop("_r")


def lead_replay(df: DataFrame, events: DataFrame, values: list[str], leads: tuple[int, ...] = (20, 10, 5, 0)) -> DataFrame:
    """G15 the state 20, 10, 5 and 0 rows before each event (symbol, row)."""
    placed = df.withColumn("at", F.row_number().over(by_symbol()).cast("long")).select("symbol", "at", F.col("date").alias("state_date"), *values)
    asks = events.select("symbol", F.col("date").alias("event_date"), "row", F.explode(F.array(*[F.lit(x) for x in leads])).alias("lead")).withColumn("at", F.col("row") - F.col("lead"))
    return asks.join(placed, ["symbol", "at"]).drop("at", "row")


def coverage_grade(n: str, publishers: str, recent: str) -> Column:
    """G16 STRONG, MODERATE, LIMITED or THIN by numbers of items, publishers and items of the last 180 days."""
    a, b, r = F.col(n), F.col(publishers), F.col(recent)
    return F.when((a >= 35) & (b >= 7) & (r >= 12), "STRONG").when((a >= 18) & (b >= 5) & (r >= 6), "MODERATE").when((a >= 6) & (b >= 3), "LIMITED").otherwise("THIN")


def study_maturity(n: str) -> Column:
    """G16 MATURE, MODERATE, LIMITED or THIN by a study's number of events."""
    return F.when(F.col(n) >= 50, "MATURE").when(F.col(n) >= 20, "MODERATE").when(F.col(n) >= 8, "LIMITED").otherwise("THIN")


def segment_metrics(df: DataFrame, masks: dict[str, str], y: str, score: str, least: int = 500) -> DataFrame:
    """G17 by segment (a row counts in every segment whose condition holds, and in its year): rows, mean, hit rate of the score's sign; INSUFFICIENT below `least`."""
    labels = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in masks.items()], F.concat(F.lit("year "), F.year("date").cast("string"))))
    r = df.filter(f"{y} is not null and {score} is not null").select(F.explode(labels).alias("segment"), y, score)
    out = r.groupBy("segment").agg(F.count(F.lit(1)).alias("rows"), F.avg(y).alias("mean"), F.avg((F.signum(y) == F.signum(score)).cast("double")).alias("hit"))
    return out.withColumn("verdict", F.when(F.col("rows") < least, "INSUFFICIENT").otherwise("OK"))
