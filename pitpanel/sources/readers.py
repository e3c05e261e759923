"""Readers, merges and sinks: landed files to the panel's tables, and an append-only archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = "array<struct<date:string,open:double,high:double,low:double,close:double,volume:double>>"


def read_bars(histories: DataFrame, least: int = 61) -> DataFrame:
    """A1 histories (map of symbol to array of bars, column `histories`) as rows; symbols with fewer than `least` bars go."""
    rows = histories.select(F.explode("histories").alias("symbol", "bars")).select("symbol", F.inline("bars"))
    rows = rows.withColumn("date", F.to_date("date"))
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).filter(F.col("_n") >= least).drop("_n")


def read_bar_files(spark: SparkSession, path: str) -> DataFrame:
    """A1 one JSON file per symbol: {symbol, history: [...]}."""
    return spark.read.schema(f"symbol string, history {BAR}").json(path).select("symbol", F.inline("history")).withColumn("date", F.to_date("date"))


def read_chart_arrays(charts: DataFrame) -> DataFrame:
    """A2 parallel arrays (symbol, timestamp, open, high, low, close, volume) as rows; epochs to dates, closes above 0 only."""
    rows = charts.select("symbol", F.inline(F.arrays_zip("timestamp", "open", "high", "low", "close", "volume")))
    return rows.filter("close > 0").select("symbol", F.to_date(F.timestamp_seconds("timestamp")).alias("date"), "open", "high", "low", "close", "volume")


#: Names under which sources deliver each logical column.
ALIASES = {"date": ("date", "time", "tradingdate", "trading_date", "ngay"), "open": ("open", "o", "open_price"), "high": ("high", "h", "high_price"), "low": ("low", "l", "low_price"), "close": ("close", "c", "close_price", "adjclose"), "volume": ("volume", "v", "vol", "match_volume")}


def resolve_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A3 each logical column from its first alias that df has, or from a column that ends in _alias; others as null."""
    names, out = {c.lower(): c for c in df.columns}, []
    for logical, known in (aliases or ALIASES).items():
        found = next((names[a] for a in known if a in names), None) or next((names[c] for a in known for c in names if c.endswith("_" + a)), None)
        out.append((F.col(f"`{found}`") if found else F.lit(None)).alias(logical))
    return df.select(*out)


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """A4 RSS items as title, link, published text, publisher (the text after the last " - " of the title)."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string").load(path)
    return split_publisher(items)


def split_publisher(items: DataFrame) -> DataFrame:
    return items.select(F.regexp_replace("title", r"\s+-\s+[^-]+$", "").alias("title"), "link", F.col("pubDate").alias("published"), F.nullif(F.trim(F.regexp_extract("title", r"\s-\s+([^-]+)$", 1)), F.lit("")).alias("publisher"))


def local_number(text: Column) -> Column:
    """A5 numbers written 1.234,5 or with % or -; null where nothing numeric is left."""
    t = F.regexp_replace(F.trim(text), r"[%\s]", "")
    dotted = F.when(t.contains(","), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(t.rlike(r"^-?\d{1,3}(\.\d{3})+$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    return F.when(t != "-", dotted.try_cast("double"))


def read_flow_rows(rows: DataFrame) -> DataFrame:
    """A5 localized flow rows (symbol, date, buy, sell, net as text) as numbers; a missing net is buy less sell."""
    n = rows.select("symbol", F.coalesce(F.try_to_date("date", "dd/MM/yyyy"), F.try_to_date("date", "yyyy-MM-dd")).alias("date"), *[local_number(F.col(c)).alias(c) for c in ("buy", "sell", "net")])
    return n.withColumn("net", F.coalesce("net", F.col("buy") - F.col("sell"))).filter("date is not null")


#: Exchange names and what they are called here.
EXCHANGES = {"HOSE": "HOSE", "HSX": "HOSE", "HNX": "HNX", "HASTC": "HNX", "UPCOM": "UPCOM"}


def read_listing(listing: DataFrame) -> DataFrame:
    """A6 stocks of a reference listing (symbol, exchange, type, name), with exchange aliases resolved."""
    name = F.create_map(*[F.lit(x) for kv in EXCHANGES.items() for x in kv])
    return listing.filter(F.upper("type") == "STOCK").select(F.upper("symbol").alias("symbol"), name[F.upper("exchange")].alias("exchange"), "name").filter("exchange is not null")


def read_fund_snapshots(snapshots: DataFrame) -> DataFrame:
    """A7 fund snapshots (fund, as_of, weight_unit, holdings array) as rows; weights as fractions in [0, 1]."""
    rows = snapshots.select("fund", "as_of", "weight_unit", F.inline("holdings"))
    w = F.when(F.col("weight_unit") == "percent", F.col("weight") / 100).otherwise(F.col("weight"))
    return rows.withColumn("weight", F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))).drop("weight_unit")


def read_statements(wide: DataFrame) -> DataFrame:
    """A8 statements with a column per quarter (YYYY-Qn) as each item's latest quarter, value and growth on the quarter before.

    Growth is null across a gap in the quarters and on a previous value of 0.
    """
    quarters = [c for c in wide.columns if len(c) == 7 and c[4:6] == "-Q"]
    long = wide.unpivot(["symbol", "item_id", "item"], quarters, "quarter", "value").filter("value is not null")
    w = Window.partitionBy("symbol", "item_id").orderBy("quarter")
    place = F.substring("quarter", 1, 4).cast("int") * 4 + F.substring("quarter", 7, 1).cast("int")
    long = long.withColumn("_p", place).withColumn("_v", F.when(F.lag("_p").over(w) == F.col("_p") - 1, F.lag("value").over(w))).withColumn("_r", F.row_number().over(w.orderBy(F.desc("quarter"))))
    return long.filter("_r = 1").select("symbol", "item_id", "item", "quarter", "value", (F.try_divide(F.col("value"), F.nullif("_v", F.lit(0.0))) - 1).alias("growth"))


def upsert_by_key(keys: list[str], *sources: DataFrame) -> DataFrame:
    """A9 union of tables; on equal keys the later table's row counts."""
    parts = [s.withColumn("_priority", F.lit(i)) for i, s in enumerate(sources)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    values = [c for c in df.columns if c not in keys and c != "_priority"]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*values), "_priority").alias("_v"))
    return best.select(*keys, *[F.col("_v")[c].alias(c) for c in values])


def append_scan_close(history: DataFrame, scan: DataFrame) -> DataFrame:
    """A10 history plus a close-only bar from scan (symbol, date, close) where it is newer than all of the symbol's history."""
    last = history.groupBy("symbol").agg(F.max("date").alias("_last"))
    new = scan.select("symbol", "date", "close").join(last, "symbol").filter(F.col("date") > F.col("_last")).drop("_last")
    return history.unionByName(new, allowMissingColumns=True)


def archive_first_write(archive: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A11 (rows to append, revisions): a model date is archived once; another hash for it is a revision, the same is nothing.

    Both have model_date, symbol and snapshot_hash; the caller appends the rows and keeps the revisions aside.
    """
    held = archive.select("model_date", F.col("snapshot_hash").alias("_held")).distinct()
    fresh = snapshot.join(held, "model_date", "left_anti")
    revised = snapshot.select("model_date", "snapshot_hash").distinct().join(held, "model_date").filter("snapshot_hash <> _held").select("model_date", F.col("_held").alias("kept_hash"), F.col("snapshot_hash").alias("new_hash"))
    return fresh, revised


def content_hash(df: DataFrame, by: list[str], order: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """A12 SHA-256 of each group's rows, ordered and rounded, as JSON; a group is one symbol's or one date's rows."""
    kinds = dict(df.dtypes)
    row = F.to_json(F.struct(*order, *[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in values]))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, row.alias("_row")))), lambda x: x["_row"])
    return df.groupBy(*by).agg(F.sha2(F.concat_ws("\n", lines), 256).alias("hash"), F.count(F.lit(1)).alias("rows"))


def verify_archive(df: DataFrame, stored: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """A13 groups whose recomputed hash differs from the stored one, or that lack either."""
    now = content_hash(df, by, order, values)
    return now.join(stored.select(*by, F.col("hash").alias("stored_hash")), by, "full").filter(~F.col("hash").eqNullSafe(F.col("stored_hash"))).select(*by, "hash", "stored_hash")


def write_outputs(df: DataFrame, path: str, by: str = "model_date", kind: str = "parquet") -> None:
    """A14 df partitioned by date as Parquet, JSON or CSV; NaN and infinities become null first."""
    from ..functions.expressions import finite

    clean = df.select(*[finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    clean.repartition(by).write.mode("append").partitionBy(by).format(kind).save(path)


def output_tables(bars: DataFrame, ranked: DataFrame, kept: int = 180, listed: int = 30) -> tuple[DataFrame, DataFrame]:
    """A14 (charts, lists): each symbol's last `kept` bars, and of each list (list, symbol, score) the report of its `listed` best, with their place."""
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc_nulls_last("score"), "symbol"))
    return bars.withColumn("_r", last).filter(F.col("_r") <= kept).drop("_r"), ranked.withColumn("place", place).filter(F.col("place") <= listed)


def merge_horizons(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A15 (merged, conflicts): results per horizon (event_key, h, car, shared_hash) in long form; keys whose shared part differs are conflicts."""
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    bad = df.groupBy("event_key").agg(F.countDistinct("shared_hash").alias("hashes")).filter("hashes > 1")
    return df.join(bad, "event_key", "left_anti"), bad
