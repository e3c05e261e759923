"""The panel's logical tables, derived from the star-schema tables: bars, sectors, ticks, articles, flows, macro series.

A supplier stands for a symbol, a shipping date for a session and the unit price for a quote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, open, high, low, close, volume: one row per symbol and session.

    Lines are dealt out by symbol before they are summed up: a session has few lines of a symbol, so summing on the map
    side would not shrink them, and what comes out is placed and ordered as the windows by symbol and date need it.
    """
    price = F.try_divide("l_extendedprice", "l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    quotes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), price.alias("p"), order.alias("o"), "l_quantity")
    return quotes.repartition("symbol").groupBy("symbol", "date").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("l_quantity").alias("volume"))


BARS_SQL = """bars AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
         first(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS open, max(p) AS high, min(p) AS low,
         last(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2)"""


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector (nation), venue (region)."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("sector"), F.col("r_name").alias("venue"))


SECTORS_SQL = "sectors AS (SELECT s_suppkey AS symbol, n_name AS sector, r_name AS venue FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts (timestamp), symbol, event_type, value of the event stream."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("symbol"), "event_type", "value")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, id, title, text, publisher, published_at of news-like items.

    The title is the text's first line; symbol and time of publication follow from the id.
    """
    d = table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(883612800) + F.col("doc_id") * 9137 % 63072000)
    return d.select((F.col("doc_id") % 97).alias("symbol"), F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"), "text", F.col("source").alias("publisher"), "lang", at.cast("timestamp_ntz").alias("published_at"))


ARTICLES_SQL = """articles AS (
  SELECT doc_id % 97 AS symbol, doc_id AS id, split_part(text, chr(10), 1) AS title, text, source AS publisher, lang,
         TIMESTAMP '1970-01-01' + to_seconds(883612800 + doc_id * 9137 % 63072000) AS published_at FROM documents)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, buy, sell, net of the foreign side (flags A and R) and of the proprietary side (flag N, by status)."""
    v = F.col("l_extendedprice")
    flag = F.col("l_returnflag")
    side = lambda cond: F.sum(F.when(cond, v))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(side(flag == "A").alias("foreign_buy"), side(flag == "R").alias("foreign_sell"), side((flag == "N") & (F.col("l_linestatus") == "O")).alias("prop_buy"), side((flag == "N") & (F.col("l_linestatus") == "F")).alias("prop_sell"))
    net = lambda a, b: F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))
    return rows.withColumn("foreign_net", net("foreign_buy", "foreign_sell")).withColumn("prop_net", net("prop_buy", "prop_sell"))


FLOWS_SQL = """flows AS (
  SELECT *, CASE WHEN foreign_buy IS NOT NULL OR foreign_sell IS NOT NULL THEN coalesce(foreign_buy, 0) - coalesce(foreign_sell, 0) END AS foreign_net,
         CASE WHEN prop_buy IS NOT NULL OR prop_sell IS NOT NULL THEN coalesce(prop_buy, 0) - coalesce(prop_sell, 0) END AS prop_net
  FROM (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) FILTER (l_returnflag = 'A') AS foreign_buy,
               sum(l_extendedprice) FILTER (l_returnflag = 'R') AS foreign_sell,
               sum(l_extendedprice) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS prop_buy,
               sum(l_extendedprice) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS prop_sell FROM lineitem GROUP BY 1, 2))"""


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, date, value: one series per order priority, the mean order value of the day."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))


MACRO_SQL = "macro AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2)"
