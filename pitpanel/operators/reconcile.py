"""Corporate actions and agreement between price sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol
from .joins import asof

GUARD = 0.22


def discontinuity_guard(bars: DataFrame, limit: float = GUARD) -> DataFrame:
    """C1 one-day log returns beyond the limit count as 0; model_close is rebuilt from the first close by the rest; suspect marks them."""
    w = by_symbol()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = bars.withColumn("_r", F.log(F.try_divide("close", F.lag("close").over(w)))).withColumn("suspect", F.coalesce(F.abs("_r") > limit, F.lit(False)))
    kept = F.when(F.col("_r").isNull() | F.col("suspect"), 0.0).otherwise(F.col("_r"))
    return df.withColumn("_k", kept).withColumn("model_close", F.first("close").over(upto) * F.exp(F.sum("_k").over(upto))).drop("_r", "_k")


def apply_factor(bars: DataFrame, adjusted: DataFrame) -> DataFrame:
    """C2 adjusted close = close x factor, the factor (adjusted / raw) being the date's, else the last before, else the first."""
    f = adjusted.select("symbol", "date", F.try_divide("model_close", "close").alias("factor")).filter("factor is not null")
    first = f.groupBy("symbol").agg(F.min_by("factor", "date").alias("_first"))
    df = asof(bars, f, "date", "symbol", ["factor"]).join(first, "symbol", "left")
    return df.withColumn("factor", F.coalesce("factor", "_first", F.lit(1.0))).drop("_first").withColumn("adjusted_close", F.col("close") * F.col("factor"))


def cross_source_mad(a: DataFrame, b: DataFrame, last: int = 300, least: int = 60) -> DataFrame:
    """C3 median difference of daily log returns of two sources (symbol, date, close) over their last common dates; null with too few."""
    w = by_symbol()
    j = a.select("symbol", "date", F.col("close").alias("ca")).join(b.select("symbol", "date", F.col("close").alias("cb")), ["symbol", "date"])
    d = j.withColumn("_d", F.abs(F.log(F.try_divide("ca", F.lag("ca").over(w))) - F.log(F.try_divide("cb", F.lag("cb").over(w))))).withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    return d.filter(F.col("_r") <= last).groupBy("symbol").agg(F.count("_d").alias("n"), F.when(F.count("_d") >= least, F.median("_d")).alias("mad"))


def venue_band(bars: DataFrame, transfers: DataFrame, band: float = 0.07, before: float = 0.15, guard: float = 0.02) -> DataFrame:
    """C5 the log band of a move that ends at a row: +-(band + guard), before a transfer of venue log(1 -+ before) -+ guard."""
    return bars.join(transfers.select("symbol", "transfer_date"), "symbol", "left").withColumns(_bands(F.col("transfer_date"), band, before, guard)).drop("transfer_date")


def _bands(transfer: Column, band: float, before: float = 0.15, guard: float = 0.02) -> dict[str, Column]:
    early = F.coalesce(F.col("date") < transfer, F.lit(False))
    return {"band_low": F.when(early, F.log(F.lit(1 - before)) - guard).otherwise(F.lit(-(band + guard))), "band_high": F.when(early, F.log(F.lit(1 + before)) + guard).otherwise(F.lit(band + guard))}


def splice(bars: DataFrame, reference: DataFrame, transfers: DataFrame, band: float = 0.07) -> DataFrame:
    """C4 each interval between neighbours keeps its return if inside the venue's band, else takes the reference's adjusted return on the same dates if that is inside, else is a violation.

    reference (symbol, date, model_close). model_close is the close times the product of the corrections so far.
    """
    ref = reference.select("symbol", "date", F.col("model_close").alias("_b"))
    return _spliced(venue_band(bars, transfers, band).join(ref, ["symbol", "date"], "left"), "_b").drop("_b")


def splice_beside(bars: DataFrame, reference: str, transfer: Column, band: float = 0.07) -> DataFrame:
    """C4 splice() of bars that hold the reference's close in a column and their symbol's date of transfer (or null): windows by symbol, no join."""
    return _spliced(bars.withColumns(_bands(transfer, band)), reference)


def _spliced(df: DataFrame, reference: str) -> DataFrame:
    """splice() of rows with bands and the reference's close; the reference at the interval's start stands in the row before."""
    w = by_symbol()
    df = df.withColumns({"from_date": F.lag("date").over(w), "raw_return": F.log(F.try_divide("close", F.lag("close").over(w))), "reference_return": F.log(F.try_divide(reference, F.lag(reference).over(w)))})
    inside = lambda x: (F.col(x) >= F.col("band_low")) & (F.col(x) <= F.col("band_high"))
    df = df.withColumn("splice", F.when(F.col("raw_return").isNull() | inside("raw_return"), "kept").when(F.coalesce(inside("reference_return"), F.lit(False)), "reference").otherwise("violation"))
    df = df.withColumn("correction", F.when(F.col("splice") == "reference", F.col("reference_return") - F.col("raw_return")).otherwise(0.0))
    total = F.sum("correction").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("model_close", F.col("close") * F.exp(total))


def violation_classes(spliced: DataFrame, actions: DataFrame, limit: float = 0.03) -> DataFrame:
    """C6 rows of violations by class: a known action (symbol, date), a move the reference corroborates, a guard break."""
    known = actions.select("symbol", "date", F.lit(True).alias("_known"))
    v = spliced.filter("splice = 'violation'").join(known, ["symbol", "date"], "left")
    close = F.coalesce(F.abs(F.col("raw_return") - F.col("reference_return")) <= limit, F.lit(False))
    classes = F.array_compact(F.array(F.when(F.col("_known"), "corporate_action"), F.when(close, "ordinary_move"), F.when(F.coalesce("_known", F.lit(False)) | close, None).otherwise("guard")))
    return v.select("symbol", "date", "raw_return", "reference_return", F.explode(classes).alias("class"))


def largest_jump(bars: DataFrame, close: str = "close") -> DataFrame:
    """C7 per symbol the largest one-row move and its date, the later of equals."""
    df = bars.withColumn("_r", F.log(F.try_divide(close, F.lag(close).over(by_symbol()))))
    return df.groupBy("symbol").agg(F.max_by(F.struct("date", F.col("_r").alias("r")), F.struct(F.abs("_r"), F.col("date"))).alias("_j")).select("symbol", F.col("_j.date").alias("jump_date"), F.col("_j.r").alias("jump"))


def certified_suffix(spliced: DataFrame, least: int = 240) -> DataFrame:
    """C8 rows from a symbol's last violation on, if they are enough to pass the row gate again."""
    w = Window.partitionBy("symbol")
    tail = spliced.withColumn("_break", F.max(F.when(F.col("splice") == "violation", F.col("date"))).over(w)).filter(F.col("_break").isNull() | (F.col("date") >= F.col("_break"))).drop("_break")
    return tail.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") >= least).drop("_n")


def route_audit(routes: DataFrame) -> DataFrame:
    """C9 the chosen source of each symbol, certified against each other source: symbol, source, other, rows, mad, deep, verified.

    routes (symbol, source, priority, date, close, deep, verified): whether a source's history is deep and its corporate
    actions are verified is said by the flags (of all its rows; null is no). A source is tried with each other one, and
    the best try is chosen: deep before not, verified before not, then the least median difference of one-row returns on
    common dates (none last), the most rows, the least priority, the source's name. A symbol's sources are few; they are
    paired within (symbol, date), so no pair of unrelated rows arises. A single source is tried with none. Routes that are
    dealt out by symbol are not shuffled again, and read once.
    """
    flag = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False)).alias(c)
    r = routes.withColumn("r", F.log(F.try_divide("close", F.lag("close").over(Window.partitionBy("symbol", "source").orderBy("date")))))
    row = r.select("symbol", "date", F.struct("source", "priority", "deep", "verified", "r").alias("a"))
    day = row.groupBy("symbol", "date").agg(F.collect_list("a").alias("all"))
    # each row once with none, which counts it, and once with each row of another source on its date
    none = F.array(F.struct(F.lit(None).cast(routes.schema["source"].dataType).alias("source"), F.lit(None).cast("double").alias("r")))
    others = lambda a: F.transform(F.filter("all", lambda b: b["source"] != a["source"]), lambda b: F.struct(b["source"].alias("source"), b["r"].alias("r")))
    pair = day.select("symbol", "all", F.explode("all").alias("a")).select("symbol", "a", F.explode(F.concat(none, others(F.col("a")))).alias("b")).select("symbol", "a.*", F.col("b.source").alias("other"), F.abs(F.col("a.r") - F.col("b.r")).alias("d"))
    of_source = Window.partitionBy("symbol", "source")  # a row a source
    alone = lambda c: F.max(F.when(F.col("other").isNull(), F.col(c))).over(of_source).alias(c)
    tried = pair.groupBy("symbol", "source", "other").agg(F.min("priority").alias("priority"), F.count(F.lit(1)).alias("rows"), flag("deep"), flag("verified"), F.median("d").alias("mad"))
    tried = tried.select("symbol", "source", "other", "mad", *[alone(c) for c in ("priority", "rows", "deep", "verified")], F.count("other").over(of_source).alias("_tries")).filter("other is not null or _tries = 0")
    order = Window.partitionBy("symbol").orderBy(F.desc("deep"), F.desc("verified"), F.asc_nulls_last("mad"), F.desc("rows"), "priority", "source", "other")  # a row a pair of sources
    return tried.withColumn("place", F.row_number().over(order)).filter("place = 1").select("symbol", "source", "other", "rows", "mad", "deep", "verified")


def median_index(bars: DataFrame, least: int = 25, limit: float = 0.35, start: float = 1000.0) -> DataFrame:
    """C10 median one-row return of each date with enough names, compounded from a start; dates are few, so one window holds them."""
    r: Column = F.log(F.try_divide("close", F.lag("close").over(by_symbol())))
    per = bars.withColumn("_r", r).filter(F.abs("_r") < limit).groupBy("date").agg(F.median("_r").alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return per.withColumn("index", F.lit(start) * F.exp(F.sum("r").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))))
