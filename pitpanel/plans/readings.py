"""Queries of readers, studies and judgements that the other modules do not register; each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import written
from ..functions.quantiles import exact_quantiles
from ..operators import families, features, flow, forecast, joins, models, risk, studies, text, validate
from ..sources import readers
from ..sources.adapters import ARTICLES_SQL, BARS_SQL, FLOWS_SQL, MACRO_SQL, SECTORS_SQL, articles, bars, flows, macro, sectors, table
from .panel import ORACLES, PANEL_SQL, QUERIES, W, query, rounded
from .studies import _RANK, PRED_SQL, SCAN_SQL, TEXT_SQL, _scan, items, predictions

__all__ = ["ORACLES", "QUERIES"]


# ---- readers -----------------------------------------------------------------------------------------------------


@query("a02_chart_arrays", f"WITH {BARS_SQL} SELECT symbol, date, close, volume FROM bars WHERE close > 0")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 over histories laid out as parallel arrays."""
    b = bars(spark, sf_dir).select("symbol", F.struct((F.unix_date("date").cast("long") * 86400).alias("timestamp"), "open", "high", "low", "close", "volume").alias("s"))
    names = ("timestamp", "open", "high", "low", "close", "volume")
    charts = b.groupBy("symbol").agg(F.array_sort(F.collect_list("s")).alias("s")).select("symbol", *[F.col(f"s.{c}").alias(c) for c in names])
    return readers.read_chart_arrays(charts).select("symbol", "date", "close", "volume")


@query("a03_aliases", "SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n, round(sum(l_extendedprice), 2) AS close, sum(l_quantity) AS volume, count(*) FILTER (false) AS opens FROM lineitem GROUP BY 1")
def a03(spark, sf_dir):
    """A3: columns under other names, one of them only by its ending, others missing."""
    src = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("TradingDate"), F.col("l_extendedprice").alias("vn_c"), F.col("l_quantity").alias("vol"), "l_tax")
    return readers.resolve_columns(src).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 2).alias("close"), F.sum("volume").alias("volume"), F.count("open").alias("opens"))


@query("a04_publishers", f"WITH {ARTICLES_SQL}, t AS (SELECT id, title || ' - ' || publisher AS t FROM articles) SELECT id, regexp_replace(t, '\\s+-\\s+[^-]+$', '') AS title, nullif(trim(regexp_extract(t, '\\s-\\s+([^-]+)$', 1)), '') AS publisher FROM t")
def a04(spark, sf_dir):
    """A4: the publisher behind a title's last dash."""
    a = articles(spark, sf_dir).select(F.concat("title", F.lit(" - "), "publisher").alias("title"), F.col("id").cast("string").alias("link"), F.col("published_at").cast("string").alias("pubDate"))
    return readers.split_publisher(a).select(F.col("link").cast("long").alias("id"), "title", "publisher")


_VENUE = "CASE r_name WHEN 'AFRICA' THEN 'hose' WHEN 'AMERICA' THEN 'HSX' WHEN 'ASIA' THEN 'hnx' WHEN 'EUROPE' THEN 'UPCOM' ELSE 'OTC' END"


@query("a06_listing", f"WITH l AS (SELECT upper(s_name) AS symbol, {_VENUE} AS exchange, CASE WHEN s_suppkey % 5 = 0 THEN 'FUND' ELSE 'stock' END AS type, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT symbol, CASE upper(exchange) WHEN 'HSX' THEN 'HOSE' ELSE upper(exchange) END AS exchange, name FROM l WHERE upper(type) = 'STOCK' AND exchange <> 'OTC'")
def a06(spark, sf_dir):
    """A listing of suppliers, with venues under several names."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return readers.read_listing(j.select(F.lower("s_name").alias("symbol"), F.expr(_VENUE).alias("exchange"), F.when(F.col("s_suppkey") % 5 == 0, "FUND").otherwise("stock").alias("type"), F.col("s_name").alias("name")))


@query("a07_fund_snapshots", "WITH h AS (SELECT l_orderkey % 7 AS fund, CAST(date_trunc('year', l_shipdate) AS DATE) AS as_of, l_suppkey % 20 AS symbol, sum(l_quantity) / 1000 AS w FROM lineitem GROUP BY 1, 2, 3) SELECT fund, as_of, symbol, round(least(greatest(CASE WHEN fund % 2 = 0 THEN w * 40 / 100 ELSE w END, 0), 1), 9) AS weight FROM h")
def a07(spark, sf_dir):
    """Nested holdings in per cent or fractions."""
    h = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 7).alias("fund"), F.trunc("l_shipdate", "year").alias("as_of"), (F.col("l_suppkey") % 20).alias("symbol")).agg((F.sum("l_quantity") / 1000).alias("w"))
    unit = F.when(F.col("fund") % 2 == 0, "percent").otherwise("fraction")
    s = h.withColumn("weight", F.when(unit == "percent", F.col("w") * 40).otherwise(F.col("w"))).groupBy("fund", "as_of").agg(F.collect_list(F.struct("symbol", "weight")).alias("holdings")).withColumn("weight_unit", unit)
    return readers.read_fund_snapshots(s).select("fund", "as_of", "symbol", F.round("weight", 9).alias("weight"))


@query("a14_tables", f"WITH {SCAN_SQL}, l AS (SELECT symbol, status AS list, round(screener_score, 4) AS score FROM scan WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1), t AS (SELECT list, symbol, score, row_number() OVER (PARTITION BY list ORDER BY score DESC NULLS LAST, symbol) AS place FROM l QUALIFY place <= 30), c AS (SELECT symbol, count(*) AS n, min(date) AS first FROM (SELECT symbol, date FROM scan QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 180) GROUP BY 1) SELECT t.list, t.symbol, t.score, t.place, c.n AS chart_rows, c.first AS chart_from FROM t JOIN c USING (symbol)")
def a14(spark, sf_dir):
    """The top lists of the scan's states, and how much of each symbol's chart is kept."""
    s = _scan(spark, sf_dir).filter("status is not null").select("symbol", "date", F.col("status").alias("list"), F.round("screener_score", 4).alias("score"))
    charts, lists = readers.output_tables(bars(spark, sf_dir), studies.tail_rows(s).drop("date"))
    c = charts.groupBy("symbol").agg(F.count(F.lit(1)).alias("chart_rows"), F.min("date").alias("chart_from"))
    return lists.join(c, "symbol").select("list", "symbol", "score", F.col("place").cast("long").alias("place"), "chart_rows", "chart_from")


@query("a15_horizons", f"WITH {PANEL_SQL}, p AS (SELECT symbol || ':' || strftime(date, '%Y-%m-%d') AS event_key, ret1, ret5, symbol % 9 = 0 AND (date - DATE '1990-01-01') % 11 = 0 AS bad FROM panel) SELECT event_key, 1 AS h, round(ret1, 4) AS car FROM p WHERE NOT bad UNION ALL SELECT event_key, 5, round(ret5, 4) FROM p WHERE NOT bad")
def a15(spark, sf_dir):
    """Two horizons of each event; events whose shared part differs are left out."""
    r = features.returns(bars(spark, sf_dir)).withColumn("event_key", F.concat_ws(":", F.col("symbol").cast("string"), F.col("date").cast("string")))
    bad = (F.col("symbol") % 9 == 0) & (F.datediff("date", F.lit("1990-01-01").cast("date")) % 11 == 0)
    part = lambda h, x, mark: r.select("event_key", F.lit(h).alias("h"), F.col(x).alias("car"), mark.alias("shared_hash"))
    merged, _ = readers.merge_horizons([part(1, "ret1", F.lit("h")), part(5, "ret5", F.when(bad, "x").otherwise("h"))])
    return rounded(merged.select("event_key", "h", "car"))


# ---- joins, studies ----------------------------------------------------------------------------------------------


@query("f11_previous", f"WITH {PANEL_SQL}, r AS (SELECT symbol, date, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r FROM panel) SELECT a.symbol, a.close, b.close AS prev_close, b.volume AS prev_volume FROM r a LEFT JOIN r b ON a.symbol = b.symbol AND b.r = 2 WHERE a.r = 1")
def f11(spark, sf_dir):
    """the latest session against the one before."""
    b = bars(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    return joins.previous_snapshot(b.filter("r = 1").select("symbol", "close"), b.filter("r = 2"), ["close", "volume"]).select("symbol", "close", "prev_close", "prev_volume")


_LEVELS = (("event",), ("event", "label"), ("sector", "event"), ("sector", "event", "label"), ("cluster",), ("source_class",), ("stream",))
_KEYS = ("event", "label", "sector", "cluster", "source_class", "stream")


@query("g02_multi_key", f"""WITH {PANEL_SQL}, {TEXT_SQL}, {SECTORS_SQL}, p AS (SELECT symbol, date, round(ln(lead(close, 5) OVER ({W}) / close), 9) AS y FROM panel), e AS (SELECT i.event, i.label, s.sector, i.lang AS cluster, i.source_class, i.stream, p.y FROM items i JOIN sectors s USING (symbol) ASOF JOIN p ON i.symbol = p.symbol AND i.available <= p.date),
 u AS ({' UNION ALL '.join('SELECT ' + ', '.join(k if k in level else f'NULL AS {k}' for k in _KEYS) + f", {sum(1 << (5 - i) for i, k in enumerate(_KEYS) if k not in level)} AS level, count(y) AS n, avg(y) AS mean, median(y) AS median FROM e GROUP BY {', '.join(level)}" for level in _LEVELS)}) SELECT event, label, sector, cluster, source_class, stream, CAST(level AS BIGINT) AS level, n, round(mean, 6) AS mean, round(median, 6) AS median FROM u""")
def g02(spark, sf_dir):
    """Outcomes after articles on seven levels; the language stands for the cluster."""
    p = features.label_returns(bars(spark, sf_dir), (5,)).select("symbol", "date", F.round("y5", 9).alias("y"))
    it = items(spark, sf_dir).select("symbol", "id", "published_at", "event", "label", F.col("lang").alias("cluster"), "source_class", "stream")
    e = joins.effective_session(it, p).filter("session is not null").withColumn("date", F.col("session")).join(p, ["symbol", "date"], "left").join(sectors(spark, sf_dir).select("symbol", "sector"), "symbol")
    return studies.multi_key_study(e, "y").select(*_KEYS, "level", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("g04_confirmation", f"""WITH {PANEL_SQL}, {TEXT_SQL}, p AS (SELECT symbol, date, ret5, ln(lead(close, 2) OVER ({W}) / close) AS y2 FROM panel), e AS (SELECT i.event, i.signed AS score, p.ret5, p.y2 FROM items i ASOF JOIN p ON i.symbol = p.symbol AND i.available <= p.date),
 g AS (SELECT event, avg(CASE WHEN abs(y2) > 0.01 THEN CAST(sign(y2) = sign(score) AS INT) END) AS confirmed, avg(CASE WHEN ret5 IS NOT NULL THEN CAST(abs(ret5) > 0.01 AS INT) END) AS premove FROM e GROUP BY 1) SELECT event, round(confirmed, 6) AS confirmed, round(premove, 6) AS premove, premove > coalesce(confirmed, 0) AS follows_price FROM g""")
def g04(spark, sf_dir):
    """G4."""
    p = features.label_returns(features.returns(bars(spark, sf_dir)), (2,)).select("symbol", "date", "ret5", "y2")
    e = joins.effective_session(items(spark, sf_dir).select("symbol", "id", "published_at", "event", F.col("signed").alias("score")), p).filter("session is not null").withColumn("date", F.col("session")).join(p, ["symbol", "date"])
    return rounded(studies.confirmation(e, ["event"]), 6)


@query("g06_flow_states", f"""WITH {PANEL_SQL}, {FLOWS_SQL}, z AS (SELECT symbol, date, round((foreign_net - avg(foreign_net) OVER w) / nullif(stddev_samp(foreign_net) OVER w, 0), 6) AS z FROM flows WHERE foreign_net IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING)),
 s AS (SELECT symbol, date, CASE WHEN z >= 0.75 THEN 'STRONG_BUY' WHEN z >= 0.2 THEN 'BUY' WHEN z <= -0.75 THEN 'STRONG_SELL' WHEN z <= -0.2 THEN 'SELL' WHEN z IS NOT NULL THEN 'NEUTRAL' END AS state FROM z), y AS (SELECT symbol, date, round(ln(lead(close, 5) OVER ({W}) / close), 9) AS y FROM panel), a AS (SELECT symbol, date, CASE WHEN count(y) OVER (PARTITION BY date) >= 8 THEN y - median(y) OVER (PARTITION BY date) END AS ar FROM y)
 SELECT state, count(ar) AS n, round(avg(ar), 6) AS mean, count(ar) >= 250 AS sufficient FROM s JOIN a USING (symbol, date) WHERE state IS NOT NULL GROUP BY 1""")
def g06(spark, sf_dir):
    """Abnormal outcomes after states of the foreign flow."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-59, 0)
    f = flows(spark, sf_dir).filter("foreign_net is not null")
    z = f.withColumn("z", F.round(F.try_divide(F.col("foreign_net") - F.avg("foreign_net").over(w), F.nullif(F.stddev_samp("foreign_net").over(w), F.lit(0.0))), 6))
    y = features.label_returns(bars(spark, sf_dir), (5,)).select("symbol", "date", F.round("y5", 9).alias("y"))
    r = studies.state_study(z.select("symbol", "date", flow.z_state("z").alias("state")), studies.abnormal_returns(y, "y").select("symbol", "date", "ar"), ["symbol", "date"], "ar")
    return r.select("state", "n", F.round("mean", 6).alias("mean"), "sufficient")


@query("g09_daily_abnormal", f"WITH {BARS_SQL}, r AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) AS h, close FROM bars), c AS (SELECT symbol, h, round(ln(close / first(close) OVER (PARTITION BY symbol ORDER BY h)), 9) AS car FROM r QUALIFY h <= 40 AND h % 7 <> 3) SELECT symbol AS event_key, h, round(CASE WHEN h = 1 THEN car WHEN lag(h) OVER w = h - 1 THEN car - lag(car) OVER w END, 9) AS ar FROM c WINDOW w AS (PARTITION BY symbol ORDER BY h)")
def g09(spark, sf_dir):
    """Each symbol's first sessions as an event, with gaps."""
    w = Window.partitionBy("symbol").orderBy("date")
    c = bars(spark, sf_dir).withColumns({"h": F.row_number().over(w).cast("long"), "car": F.round(F.log(F.col("close") / F.first("close").over(w)), 9)}).filter("h <= 40 and h % 7 <> 3")
    return studies.daily_from_cumulative(c.select(F.col("symbol").alias("event_key"), "h", "car")).select("event_key", "h", F.round("ar", 9).alias("ar"))


@query("g12_attention", f"""WITH {SCAN_SQL}, l AS (SELECT *, coalesce(CASE status WHEN 'RED' THEN 3 WHEN 'YELLOW' THEN 2 END > CASE prev_status WHEN 'RED' THEN 3 WHEN 'YELLOW' THEN 2 WHEN 'WATCH' THEN 1 WHEN 'GREEN' THEN 0 END, false) AS escalated FROM scan QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
 SELECT symbol, status, escalated, round(screener_score, 4) AS score FROM l WHERE status IN ('RED', 'YELLOW') ORDER BY escalated DESC, CASE status WHEN 'RED' THEN 0 ELSE 1 END, round(screener_score, 4) DESC, symbol LIMIT 30""")
def g12(spark, sf_dir):
    """The report of the 30 symbols that need attention."""
    last = studies.tail_rows(risk.transition(_scan(spark, sf_dir))).filter("status in ('RED', 'YELLOW')").withColumn("score", F.round("screener_score", 4))
    return studies.top_attention(last).select("symbol", "status", "escalated", "score")


# ---- text, flow --------------------------------------------------------------------------------------------------


@query("h04_aliases", f"""WITH {ARTICLES_SQL}, a AS (SELECT id, CASE id % 7 WHEN 0 THEN 'Regulatory / legal' WHEN 1 THEN 'Operations / M&A' WHEN 2 THEN 'corporateaction' WHEN 3 THEN 'earnings' WHEN 4 THEN 'M&A' WHEN 5 THEN 'general' END AS event, lower(coalesce(title, '')) || CASE WHEN id % 2 = 0 THEN ' doanh thu' WHEN id % 3 = 0 THEN ' khối ngoại' ELSE '' END AS low FROM articles), d AS (SELECT id, low, upper(replace(coalesce(event, 'GENERAL'), ' ', '_')) AS e FROM a),
 n AS (SELECT id, low, CASE e WHEN 'REGULATORY_/_LEGAL' THEN 'REGULATORY' WHEN 'OPERATIONS_/_M&A' THEN 'OPERATIONS_MA' WHEN 'CORPORATEACTION' THEN 'CORPORATE_ACTION' WHEN 'M&A' THEN 'OPERATIONS_MA' ELSE e END AS e FROM d) SELECT id, CASE WHEN e = 'GENERAL' AND contains(low, 'doanh thu') THEN 'EARNINGS' WHEN e = 'GENERAL' AND contains(low, 'khối ngoại') THEN 'MARKET_FLOW' ELSE e END AS event FROM n""")
def h04(spark, sf_dir):
    """H4: one name for each event."""
    k = F.col("id") % 7
    names = ("Regulatory / legal", "Operations / M&A", "corporateaction", "earnings", "M&A", "general")
    event = F.lit(None).cast("string")
    for i, n in enumerate(names):
        event = F.when(k == i, n).otherwise(event)
    more = F.when(F.col("id") % 2 == 0, " doanh thu").when(F.col("id") % 3 == 0, " khối ngoại").otherwise("")
    a = articles(spark, sf_dir).select("id", event.alias("event"), F.concat(F.coalesce("title", F.lit("")), more).alias("title"))
    return a.select("id", text.event_alias("event").alias("event"))


@query("h06_times", f"WITH {ARTICLES_SQL} SELECT id, CASE id % 4 WHEN 0 THEN published_at WHEN 1 THEN published_at - INTERVAL 7 HOUR WHEN 2 THEN published_at - INTERVAL 7 HOUR ELSE published_at END AS utc FROM articles")
def h06(spark, sf_dir):
    """H6: times written as ISO with Z, RFC-822 with an offset, local ISO, RFC-822 in GMT."""
    at, k = F.col("published_at").cast("timestamp"), F.col("id") % 4
    f = lambda p: F.date_format(at, p)
    stamped = F.when(k == 0, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.concat(f("EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0700"))).when(k == 2, f("yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(f("EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    return articles(spark, sf_dir).select("id", text.publication_time(stamped).cast("timestamp_ntz").alias("utc"))


@query("h12_matches", f"""WITH {ARTICLES_SQL}, t AS (SELECT symbol, id, list_distinct(regexp_extract_all(regexp_replace(coalesce(upper(title), ''), '[^\\x00-\\x7F]', 'z', 'g'), '\\b([A-Z][A-Z0-9]{{2,3}})\\b', 1)) AS found FROM articles), u AS (SELECT DISTINCT symbol, CASE symbol % 4 WHEN 0 THEN 'THE' WHEN 1 THEN 'VON' WHEN 2 THEN 'QUE' ELSE 'LES' END AS ticker FROM articles), n AS (SELECT t.id, t.symbol, unnest(found) AS ticker FROM t), m AS (SELECT n.id, bool_or(u.symbol = n.symbol) AS own, bool_or(u.symbol <> n.symbol) AS other FROM n JOIN u USING (ticker) GROUP BY 1)
 SELECT t.id, coalesce(own, false) OR NOT coalesce(other, false) AS matched, coalesce(own, false) AS strict FROM t LEFT JOIN m USING (id)""")
def h12m(spark, sf_dir):
    """H12, lenient and strict."""
    a = articles(spark, sf_dir).withColumn("title", F.upper("title"))
    k = F.col("symbol") % 4
    u = a.select("symbol").distinct().withColumn("ticker", F.when(k == 0, "THE").when(k == 1, "VON").when(k == 2, "QUE").otherwise("LES"))
    return text.security_match(a, u).select("id", "matched").join(text.security_match(a, u, strict=True).select("id", F.col("matched").alias("strict")), "id")


@query("h19_claim_features", f"""WITH {BARS_SQL}, {TEXT_SQL}, v AS (SELECT symbol, date, CASE WHEN row_number() OVER w > 6 THEN coalesce(ln(1 + avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) / greatest(1, median(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 25 PRECEDING AND 6 PRECEDING))), 0) ELSE 0 END AS lead FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
 r AS (SELECT i.symbol, i.id, i.symbol * 10 + i.id % 3 AS claim, i.available, i.publisher, CASE WHEN i.symbol % 4 = 0 THEN i.available + 5 END AS resolved, CASE i.id % 3 WHEN 0 THEN 'DENIED' WHEN 1 THEN 'CONFIRMED' END AS truth, coalesce(v.lead, 0) AS lead, (i.id % 11) / 100.0 AS premove FROM items i LEFT JOIN v ON v.symbol = i.symbol AND v.date = i.available WHERE i.source_class = 'RUMOR_UNVERIFIED'),
 c AS (SELECT b.symbol, b.date, claim, count(*) AS n, list(publisher) AS pubs, count(*) / (max(available) - min(available) + 1) AS speed, min(CASE WHEN resolved <= b.date THEN coalesce(truth, 'CLARIFIED') ELSE 'UNVERIFIED' END) AS state, sum(lead) AS lead, sum(abs(premove)) AS moved FROM bars b JOIN r ON r.symbol = b.symbol AND b.date >= r.available AND b.date <= r.available + 19 GROUP BY 1, 2, 3),
 p AS (SELECT symbol, date, count(*) AS claims, avg(speed) AS propagation, len(list_distinct(flatten(list(pubs)))) / sum(n) AS diversity, (sum(n) - count(*)) / sum(n) AS duplication, count(*) FILTER (state = 'CONFIRMED') AS confirmed, count(*) FILTER (state = 'DENIED') AS denied, count(*) FILTER (state = 'CLARIFIED') AS clarified, count(*) FILTER (state IN ('UNVERIFIED', 'CLARIFIED')) AS unverified, sum(lead) / sum(n) AS pre_volume, sum(moved) / sum(n) + 0.25 * sum(lead) / sum(n) AS lead_score FROM c GROUP BY 1, 2)
 SELECT b.symbol, b.date, coalesce(claims, 0) AS rumour_claims, round(coalesce(propagation, 0), 7) AS rumour_propagation, round(coalesce(diversity, 0), 7) AS rumour_diversity, round(coalesce(duplication, 0), 7) AS rumour_duplication, coalesce(confirmed, 0) AS rumour_confirmed, coalesce(denied, 0) AS rumour_denied, coalesce(clarified, 0) AS rumour_clarified, coalesce(unverified, 0) AS rumour_unverified, round(coalesce(pre_volume, 0), 7) AS rumour_pre_volume, round(coalesce(lead_score, 0), 7) AS rumour_lead_score FROM bars b LEFT JOIN p USING (symbol, date)""")
def h19(spark, sf_dir):
    """H19, with claims by symbol and remainder of the id."""
    b = bars(spark, sf_dir)
    lead = text.volume_lead(b).select("symbol", F.col("date").alias("available"), "volume_lead")
    k = F.col("id") % 3
    it = items(spark, sf_dir).filter("source_class = 'RUMOR_UNVERIFIED'").withColumns({"claim": F.col("symbol") * 10 + k, "resolved": F.when(F.col("symbol") % 4 == 0, F.date_add("available", 5)), "truth": F.when(k == 0, "DENIED").when(k == 1, "CONFIRMED"), "premove": (F.col("id") % 11) / 100})
    it = it.join(lead, ["symbol", "available"], "left").fillna(0.0, ["volume_lead"])
    return rounded(text.claim_features(b, it), 7)


@query("i08_nav", f"WITH {MACRO_SQL}, r AS (SELECT *, ln(value / lag(value) OVER w) AS r, value / lag(value, 20) OVER w - 1 AS m FROM macro WINDOW w AS (PARTITION BY series ORDER BY date)) SELECT series AS fund, date, round(m, 8) AS nav_momentum20, round(CASE WHEN count(r) OVER k >= 20 THEN stddev_pop(r) OVER k END, 8) AS nav_volatility20 FROM r WINDOW k AS (PARTITION BY series ORDER BY date ROWS 19 PRECEDING)")
def i08(spark, sf_dir):
    """I8."""
    nav = macro(spark, sf_dir).select(F.col("series").alias("fund"), "date", F.col("value").alias("nav"))
    return rounded(flow.nav_stats(nav).select("fund", "date", "nav_momentum20", "nav_volatility20"), 8)


# ---- risk --------------------------------------------------------------------------------------------------------


@query("j11_analog_scores", f"WITH {SCAN_SQL}, a AS (SELECT symbol, date, technical_score AS t, round(vol_pct / 2, 6) AS rate FROM scan WHERE technical_score IS NOT NULL AND vol_pct IS NOT NULL) SELECT symbol, date, round(100 * least(greatest(0.72 * t / 100 + 0.28 * least(greatest(rate / 0.25, 0), 1), 0), 1), 7) AS horizon_score, round(100 * least(greatest(rate / 0.30, 0), 1), 7) AS analog_module, round(0.65 * t + 0.35 * 100 * least(greatest(rate / 0.30, 0), 1), 7) AS market_blend FROM a")
def j11(spark, sf_dir):
    """J11, with the volatility's place standing for the analogs' event rate."""
    a = _scan(spark, sf_dir).filter("technical_score is not null and vol_pct is not null").select("symbol", "date", F.col("technical_score").alias("score"), F.col("technical_score").alias("technical"), F.round(F.col("vol_pct") / 2, 6).alias("rate"))
    return rounded(risk.analog_scores(a).select("symbol", "date", "horizon_score", "analog_module", "market_blend"), 7)


_AREAS = "t AS (SELECT model, s, sum(y) AS p, count(*) - sum(y) AS n FROM m GROUP BY 1, 2), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY model ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(p) OVER (PARTITION BY model ORDER BY s DESC) / sum(p + n) OVER (PARTITION BY model ORDER BY s DESC) AS prec FROM t), a AS (SELECT model, sum(p * (b + n / 2)) / (sum(p) * sum(n)) AS auc, sum(p * prec) / sum(p) AS pr_auc FROM r GROUP BY 1), q AS (SELECT model, avg(y) AS base_rate, sum(y) AS events, 1 - avg(pow(p0 - y, 2)) / nullif(avg(y) * (1 - avg(y)), 0) AS brier_skill FROM m GROUP BY 1)"


@query("j25_rank_weights", f"""WITH {PRED_SQL}, m AS (SELECT CASE symbol % 3 WHEN 0 THEN 'structural' WHEN 1 THEN 'boosted' ELSE 'linear' END AS model, y, -score AS s, round(1 - p, 4) AS p0 FROM pb), {_AREAS},
 w AS (SELECT *, least(greatest((pr_auc - base_rate) / greatest(0.05, 1 - base_rate), 0), 1) AS pr, least(greatest((auc - 0.5) / 0.25, 0), 1) AS ro FROM a JOIN q USING (model)), x AS (SELECT *, coalesce(0.75 * pr, 0) + coalesce(0.25 * ro, 0) AS own FROM w)
 SELECT model, round(CASE WHEN max(own) OVER () <= 0 AND model = 'structural' THEN 1 ELSE own END, 6) AS weight, CASE WHEN pr_auc <= base_rate OR brier_skill <= 0 OR events < 10 THEN 'LIMITED' ELSE 'STRONG' END AS grade FROM x""")
def j25(spark, sf_dir):
    """Three groups of symbols as models, judged by the return turned round."""
    k = F.col("symbol") % 3
    m = predictions(spark, sf_dir).select(F.when(k == 0, "structural").when(k == 1, "boosted").otherwise("linear").alias("model"), "y", (-F.col("score")).alias("score"), F.round(1 - F.col("p"), 4).alias("p"))
    base = m.groupBy("model").agg(F.avg(F.col("y").cast("double")).alias("base_rate"), F.sum("y").alias("events"))
    t = validate.roc_auc(m, ["model"]).join(validate.pr_auc(m, ["model"]), "model").join(validate.brier(m, ["model"]), "model").join(base, "model").withColumn("grade", F.lit("STRONG"))
    return risk.rank_weights(t).select("model", F.round("weight", 6).alias("weight"), "grade")


# ---- validation --------------------------------------------------------------------------------------------------


_HAC = "e AS (SELECT *, x - avg(x) OVER (PARTITION BY expert) AS e FROM d), l AS (SELECT *, " + ", ".join(f"lag(e, {k}) OVER (PARTITION BY expert ORDER BY date) AS l{k}" for k in range(1, 6)) + " FROM e), h AS (SELECT expert, count(*) AS days, sum(active) AS active_rows, avg(x) AS mean, sqrt(greatest(sum(e * e) + " + " + ".join(f"2 * (1 - {k} / 6.0) * sum(e * l{k})" for k in range(1, 6)) + ", 0)) / count(*) AS se FROM l GROUP BY 1)"
_BLOCKS = "p AS (SELECT expert, x, row_number() OVER (PARTITION BY expert ORDER BY date) - 1 AS place, count(*) OVER (PARTITION BY expert) AS n FROM d), s AS (SELECT expert, rep, place AS slot, n FROM p, range(1, 201) t(rep)), a AS (SELECT expert, rep, CAST((CAST('0x' || substr(md5(rep || ':' || (slot // 4)), 1, 8) AS BIGINT) % n + slot % 4) % n AS BIGINT) AS place FROM s), m AS (SELECT expert, rep, avg(x) AS m FROM a JOIN p USING (expert, place) GROUP BY 1, 2), bound AS (SELECT expert, quantile_cont(m, 0.05) AS q FROM m GROUP BY 1)"


_GRID = "SELECT range AS threshold FROM range(45, 81, 5)"


@query("k08_utility", f"""WITH {PRED_SQL}, x AS (SELECT y, round(100 * (1 - p), 4) AS s FROM pb), c AS (SELECT threshold, count(*) FILTER (y = 1 AND s >= threshold) AS tp, count(*) FILTER (y = 0 AND s >= threshold) AS fp, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM x, ({_GRID}) g GROUP BY 1),
 r AS (SELECT threshold, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(pos, 0), 0) AS recall, coalesce(fp / nullif(neg, 0), 0) AS fpr FROM c), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM r), u AS (SELECT *, round(coalesce(f1, -1) + 0.08 * recall + 0.04 * precision - 0.03 * fpr, 12) AS utility FROM f)
 SELECT CAST(threshold AS INT) AS threshold, round(precision, 7) AS precision, round(recall, 7) AS recall, round(fpr, 7) AS fpr, round(f1, 7) AS f1, round(utility, 7) AS utility, threshold = first_value(threshold) OVER (ORDER BY utility DESC, threshold) AS chosen FROM u""")
def k08u(spark, sf_dir):
    """K8, the grid of scores by utility."""
    d = predictions(spark, sf_dir).select("y", F.round(100 * (1 - F.col("p")), 4).alias("score"))
    return rounded(validate.utility_threshold(d), 7)


def _precision_sql(unit: str, block: int) -> str:
    return f"""WITH {PRED_SQL}, d AS (SELECT {unit} AS unit, -score AS s, sum(y) AS p, count(*) AS c FROM pb GROUP BY 1, 2), u AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT unit FROM d) QUALIFY n >= 20), s AS (SELECT rep, place AS slot, n FROM u, range(1, 41) t(rep)),
 a AS (SELECT rep, CAST(CAST('0x' || substr(md5(rep || ':' || (slot // {block})), 1, 8) AS BIGINT) % greatest(n - {block} + 1, 1) + slot % {block} AS BIGINT) AS place, count(*) AS times FROM s GROUP BY 1, 2), t AS (SELECT rep, s, sum(p * times) AS p, sum(c * times) AS c FROM d JOIN u USING (unit) JOIN a USING (place) GROUP BY 1, 2),
 w AS (SELECT *, sum(p) OVER (PARTITION BY rep ORDER BY s) AS cp, sum(c) OVER (PARTITION BY rep ORDER BY s) AS cc FROM t), r AS (SELECT rep, sum(p * cp / cc) / sum(p) AS ap FROM w GROUP BY 1 HAVING sum(p) > 0 AND sum(p) < sum(c)) SELECT count(*) AS replicates, round(quantile_cont(ap, 0.025), 6) AS low, round(quantile_cont(ap, 0.5), 6) AS median, round(quantile_cont(ap, 0.975), 6) AS high FROM r HAVING count(*) > 0"""


@query("k16_precision_dates", _precision_sql("date", 1))
def k16p(spark, sf_dir):
    """Average precision over dates drawn again."""
    return rounded(validate.bootstrap_precision(predictions(spark, sf_dir), "date", 40), 6)


@query("k17_precision_blocks", _precision_sql("date", 4))
def k17b(spark, sf_dir):
    """Average precision over blocks of four dates."""
    return rounded(validate.bootstrap_precision(predictions(spark, sf_dir), "date", 40, 4), 6)


@query("k17_precision_symbols", _precision_sql("symbol", 1))
def k17s(spark, sf_dir):
    """Average precision over symbols drawn again, each with its whole history."""
    return rounded(validate.bootstrap_precision(predictions(spark, sf_dir), "symbol", 40), 6)


@query("k28_promotion", f"""WITH {PRED_SQL}, r AS (SELECT date, {_RANK.format('r')} AS a, {_RANK.format('score')} AS b0, {_RANK.format('p')} AS b1, {_RANK.format('-score')} AS b2, id FROM pb), i AS (SELECT date, count(*) AS n, round(corr(a, b0), 9) AS trend, round(-corr(a, b0), 9) AS reversal FROM r GROUP BY 1 HAVING count(*) >= 5 AND corr(a, b0) IS NOT NULL AND NOT isnan(corr(a, b0))),
 d AS (SELECT 'trend' AS expert, date, trend AS x, n AS active FROM i UNION ALL SELECT 'reversal', date, reversal, n FROM i UNION ALL SELECT 'sparse', date, reversal, 1 FROM i), {_HAC}, {_BLOCKS}
 SELECT h.expert, days, CAST(active_rows AS BIGINT) AS active_rows, round(mean, 6) AS mean, round(mean / nullif(se, 0), 4) AS t, round(q, 6) AS delta_q05, active_rows >= CASE WHEN expert = 'sparse' THEN 1000000000 ELSE 0 END AND mean > 0 AND mean / nullif(se, 0) > 2.2414 AND q > 0 AS promoted FROM h JOIN bound USING (expert)""")
def k28(spark, sf_dir):
    """Daily rank correlations of three experts; one of them is held back for want of rows."""
    ic = written(validate.daily_rank_ic(predictions(spark, sf_dir), "r", "score", 5).withColumn("ic", F.round("ic", 9)))
    part = lambda name, x, n: ic.select(F.lit(name).alias("expert"), "date", x.alias("delta"), n.cast("long").alias("active"))
    d = part("trend", F.col("ic"), F.col("n")).unionByName(part("reversal", -F.col("ic"), F.col("n"))).unionByName(part("sparse", -F.col("ic"), F.lit(1)))
    e = validate.expert_promotion(d, {"sparse": 1_000_000_000})
    return e.select("expert", "days", "active_rows", F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"), F.round("delta_q05", 6).alias("delta_q05"), "promoted")


@query("k36_event_study", f"WITH {PANEL_SQL}, {TEXT_SQL}, y AS (SELECT symbol, date, round(ln(lead(close, 5) OVER ({W}) / close), 9) AS y FROM panel), j AS (SELECT y.*, i.signed, i.event FROM y LEFT JOIN (SELECT symbol, available AS date, event, max(signed) AS signed FROM items GROUP BY 1, 2, 3) i USING (symbol, date)), a AS (SELECT *, CASE WHEN count(y) OVER (PARTITION BY date) >= 8 THEN y - median(y) OVER (PARTITION BY date) END AS ar FROM j) SELECT CASE WHEN signed > 0 THEN 'positive' ELSE 'negative' END AS sign, event, count(ar) AS n, round(avg(ar), 6) AS mean, round(avg(ar) / nullif(stddev_samp(ar) / sqrt(count(ar)), 0), 4) AS t FROM a WHERE signed <> 0 AND ar IS NOT NULL GROUP BY 1, 2")
def k36e(spark, sf_dir):
    """K36."""
    y = features.label_returns(bars(spark, sf_dir), (5,)).select("symbol", "date", F.round("y5", 9).alias("y"))
    i = items(spark, sf_dir).groupBy("symbol", F.col("available").alias("date"), "event").agg(F.max("signed").alias("signed"))
    return validate.event_study(y.join(i, ["symbol", "date"], "left")).select("sign", "event", "n", F.round("mean", 6).alias("mean"), F.round("t", 4).alias("t"))


@query("k39_linear_scorer", f"""WITH {PANEL_SQL}, r AS (SELECT symbol, date, ret5, vol20, gap50 FROM panel), l AS (SELECT symbol, date, 'ret5' AS f, ret5 AS v FROM r UNION ALL SELECT symbol, date, 'vol20', vol20 FROM r UNION ALL SELECT symbol, date, 'gap50', gap50 FROM r), c AS (SELECT f, round(median(v), 6) AS med, round(avg(v), 6) AS mu, round(stddev_samp(v), 6) AS sd, CASE f WHEN 'ret5' THEN -0.4 WHEN 'vol20' THEN 0.3 ELSE 0.2 END AS w FROM l GROUP BY 1)
 SELECT symbol, date, round(1 / (1 + exp(-(sum((coalesce(v, med) - mu) / nullif(sd, 0) * w) - 1.5))), 6) AS p FROM l JOIN c USING (f) GROUP BY 1, 2""")
def k39(spark, sf_dir):
    """Stored coefficients over three features."""
    from .panel import panel

    r = panel(spark, sf_dir).select("symbol", "date", "ret5", "vol20", "gap50")
    weights = {"ret5": -0.4, "vol20": 0.3, "gap50": 0.2}
    r = written(r)
    values = r.unpivot(["symbol", "date"], list(weights), "feature", "v")
    middle = exact_quantiles(values, ["feature"], "v", {"median": 0.5}).withColumn("median", F.round("median", 6))
    long = middle.join(values.groupBy("feature").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd")), "feature").select("feature", "median", "mean", "sd")
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    none = F.lit(None).cast("double")
    coefficients = long.withColumn("weight", w[F.col("feature")]).unionByName(spark.range(1).select(F.lit("(intercept)").alias("feature"), none.alias("median"), none.alias("mean"), none.alias("sd"), F.lit(-1.5).alias("weight")))
    return validate.linear_scorer(r, coefficients, ["symbol", "date"]).select("symbol", "date", F.round("p", 6).alias("p"))


@query("k40_cases", f"WITH {PRED_SQL}, c AS (SELECT symbol, date, r AS y, round(score * 0.1, 6) AS p50 FROM pb QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 6) SELECT symbol, date, sign(y) = sign(p50) AS hit, y BETWEEN p50 - 0.5 AND p50 + 0.5 AS inside, round(abs(y - p50), 6) AS error FROM c")
def k40(spark, sf_dir):
    """Each symbol's last six matured forecasts."""
    p = F.round(F.col("score") * 0.1, 6)
    d = predictions(spark, sf_dir).select("symbol", "date", F.col("r").alias("y"), p.alias("p50"), (p - 0.5).alias("q20"), (p + 0.5).alias("q80"))
    return validate.backtest_cases(d).select("symbol", "date", "hit", "inside", F.round("error", 6).alias("error"))


@query("k41_quintiles", f"""WITH {PANEL_SQL}, a AS (SELECT symbol, date, round(ret5, 6) AS s, round(min(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) / close - 1, 6) AS dd, count(*) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS n FROM panel), b AS (SELECT * FROM a WHERE s IS NOT NULL AND dd IS NOT NULL AND n = 20), c AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) <= floor(count(*) OVER (PARTITION BY symbol) * 0.7::DOUBLE) AS t FROM b), k AS (SELECT symbol, round(quantile_cont(dd, 0.05), 9) AS cut FROM c WHERE t GROUP BY 1),
 p AS (SELECT *, 100 * sum(CAST(t AS INT)) OVER (PARTITION BY symbol ORDER BY s) / sum(CAST(t AS INT)) OVER (PARTITION BY symbol) AS p FROM c) SELECT symbol, 'Q' || CAST(least(floor(p / 20) + 1, 5) AS INT) AS bucket, count(*) AS n, round(avg(CAST(dd <= cut AS INT)), 6) AS event_rate FROM p JOIN k USING (symbol) WHERE NOT t GROUP BY 1, 2""")
def k41q(spark, sf_dir):
    """Event rates by fifth of the score."""
    from .panel import panel

    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(1, 20)
    d = panel(spark, sf_dir).select("symbol", "date", F.round("ret5", 6).alias("score"), F.when(F.count(F.lit(1)).over(w) == 20, F.round(F.min("close").over(w) / F.col("close") - 1, 6)).alias("fwd_dd"))
    return rounded(validate.score_quintiles(d), 6)


@query("k49_gate_table", f"WITH {PRED_SQL} SELECT 'all_dated' AS \"check\", bool_and(date IS NOT NULL) AS passed FROM pb UNION ALL SELECT 'probabilities', bool_and(p BETWEEN 0 AND 1) FROM pb UNION ALL SELECT 'base_rates', bool_and(b < 0.5) FROM (SELECT avg(y) AS b FROM pb GROUP BY symbol) UNION ALL SELECT 'small_returns', bool_and(abs(r) < 0.01) FROM pb")
def k49(spark, sf_dir):
    """Four checks over the predictions, one of which fails."""
    d = predictions(spark, sf_dir)
    base = d.groupBy("symbol").agg((F.avg(F.col("y").cast("double")) < 0.5).alias("passed"))
    return validate.gate_table({"all_dated": d.select(F.col("date").isNotNull().alias("passed")), "probabilities": d.select(F.col("p").between(0, 1).alias("passed")), "base_rates": base, "small_returns": d.select((F.abs("r") < 0.01).alias("passed"))})


@query("k35_contributions")
def k35(spark, sf_dir):
    """What two groups of features add to a ridge forecast on the sealed dates; the parts sum to the whole."""
    d = written(predictions(spark, sf_dir).filter("vol20 is not null"))
    block = validate.embargo_blocks(d, 5)
    train, test = (d.join(F.broadcast(block.filter(F.col("block") == b).select("date")), "date", "left_semi") for b in ("fit", "sealed"))
    names = ["score", "vol20", "gap20", "dd60"]
    values = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in names])).alias("e")).select("e.*")
    found = {r["feature"]: r["median"] for r in exact_quantiles(values, ["feature"], "v", {"median": 0.5}).collect()}  # a row a feature
    medians = {c: found.get(c) for c in names}
    groups = {"PRICE": ["score", "gap20"], "RISK": ["vol20", "dd60"]}
    c = models.group_ablation(models.regressor(train, names, "r"), test, medians, groups, names)
    parts = ["contribution_PRICE", "contribution_RISK", "contribution_NUMERICAL"]
    return rounded(c.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.abs(x)).alias(x) for x in parts], F.max(F.abs(F.col("full") - sum((F.col(x) for x in parts), F.lit(0.0)))).alias("rest")))


# ---- fitted families ---------------------------------------------------------------------------------------------

_FIT_DATES = "fd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM pb))"
_POWERS = (1.0, 1.5, 2.0, 3.0)
_TAILS = ", ".join(f"sign(u) * pow(abs(u), {p}) - avg(sign(u) * pow(abs(u), {p})) OVER (PARTITION BY date) AS t{i}" for i, p in enumerate(_POWERS))
_FAMILIES = [("origin_scale", "0", "score"), ("rank_residual", "q50", "u"), ("zero_rank", "0", "u")] + [(f"tail_rank_{p}", "0", f"t{i}") for i, p in enumerate(_POWERS)]
_FAMILIES += [(f"score_state_{p}_{g}", "0", f"t{i} * pow(st, {g}) - avg(t{i} * pow(st, {g})) OVER (PARTITION BY date)") for i, p in enumerate(_POWERS) for g in (0.5, 1.0)]
FAMILY_SQL = f"""{PRED_SQL}, {_FIT_DATES}, e0 AS (SELECT pb.symbol, pb.date, r AS y, score, score * 0.2 AS q50, count(*) OVER w AS c, rank() OVER (PARTITION BY pb.date ORDER BY score) AS k, count(*) OVER (PARTITION BY pb.date, score) AS same, quantile_cont(score, 0.75) OVER w - quantile_cont(score, 0.25) OVER w AS spread
  FROM pb JOIN fd ON fd.date = pb.date AND fd.p >= floor(fd.n * 0.5) AND fd.p < floor(fd.n * 0.8) WINDOW w AS (PARTITION BY pb.date)),
 e1 AS (SELECT *, CASE WHEN c >= 2 THEN round(2 * ((k + (same - 1) / 2.0) / c) - 1.0 / c - 1, 12) ELSE 0 END AS u, CASE WHEN c >= 8 THEN spread END AS sp FROM e0), us AS (SELECT median(sp) AS usual FROM (SELECT date, min(sp) AS sp FROM e1 WHERE sp IS NOT NULL GROUP BY 1)),
 e2 AS (SELECT *, {_TAILS}, least(greatest(coalesce(greatest(sp, 1e-12) / greatest(usual, 1e-12), 1.0), 0.75), 1.35) AS st FROM e1, us),
 lg AS ({' UNION ALL '.join(f"SELECT '{f}' AS family, CAST(y AS DOUBLE) AS y, CAST({b} AS DOUBLE) AS base, CAST({x} AS DOUBLE) AS x FROM e2" for f, b, x in _FAMILIES)}),
 md AS (SELECT family, median(x) AS mx, median(y) AS my FROM lg GROUP BY 1), sp AS (SELECT family, count(*) AS n, stddev_pop(x) AS sdx, stddev_pop(y) AS sdy, stddev_pop(y - base) AS sdt, quantile_cont(abs(x), 0.9) AS qx, quantile_cont(abs(y), 0.9) AS qy, median(abs(x - mx)) AS madx, median(abs(y - my)) AS mady FROM lg JOIN md USING (family) GROUP BY 1),
 up AS (SELECT *, CASE WHEN family = 'origin_scale' THEN least(30.0, greatest(2.0, 2.5 * mady / greatest(madx, 1e-8))) ELSE least(0.2, greatest(0.003, 3 * sdt / sdx)) END AS upper FROM sp WHERE n >= 120 AND sdx > 1e-10),
 kn AS (SELECT *, CASE WHEN family = 'origin_scale' THEN 0.05 ELSE 0.0 END AS low, CASE WHEN family = 'origin_scale' THEN least(2.0, upper) ELSE least(0.03, upper) END AS top, CASE WHEN family = 'origin_scale' THEN 40 ELSE 81 END AS m1, CASE WHEN family = 'origin_scale' THEN 44 ELSE 48 END AS m2, CASE WHEN family = 'origin_scale' THEN 2.0 ELSE 0.03 END AS knee, CASE WHEN family = 'origin_scale' THEN 1.0 ELSE 0.0 END AS extra FROM up),
 sg AS (SELECT DISTINCT family, round(s, 12) AS scale FROM (SELECT family, unnest(list_concat(list_transform(range(m1), lambda i: low + (top - low) * i / (m1 - 1)), CASE WHEN upper > knee THEN list_transform(range(m2), lambda i: greatest(CASE WHEN low > 0 THEN 0.1 ELSE 0.001 END, top) * pow(upper / greatest(CASE WHEN low > 0 THEN 0.1 ELSE 0.001 END, top), i / (m2 - 1))) ELSE [] END, [extra])) AS s FROM kn)),
 tg AS (SELECT family, n, greatest(lo, least(hi, greatest(0.10 * sdy / greatest(sdx, 1e-10), 0.08 * qy / greatest(qx, 1e-10)))) AS target FROM up JOIN (SELECT family, min(scale) AS lo, max(scale) AS hi FROM sg GROUP BY 1) USING (family)),
 tr AS (SELECT family, scale, round(avg(abs(y - base - scale * x)), 12) AS mae, round(stddev_samp(abs(y - base - scale * x)) / sqrt(count(*)), 12) AS se FROM lg JOIN sg USING (family) GROUP BY 1, 2),
 bs AS (SELECT family, mae AS best_mae, se AS best_se FROM tr QUALIFY row_number() OVER (PARTITION BY family ORDER BY mae, scale) = 1),
 ok AS (SELECT tr.*, best_mae, target, n, count(*) OVER (PARTITION BY family) AS admissible FROM tr JOIN bs USING (family) JOIN tg USING (family) WHERE mae <= best_mae + greatest(best_se, 1e-12))"""


def _family_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = predictions(spark, sf_dir).select("symbol", "date", F.col("r").alias("y"), "score", (F.col("score") * 0.2).alias("q50"))
    days = validate.date_places(d).filter((F.col("place") >= F.floor(F.col("dates") * 0.5)) & (F.col("place") < F.floor(F.col("dates") * 0.8))).select("date")
    return families.signals(d.join(days, "date", "left_semi"), least_names=8)


@query("k25_fitted_families", f"WITH {FAMILY_SQL} SELECT family, n, round(scale, 8) AS scale, round(mae, 8) AS mae, round(best_mae, 8) AS best_mae, round(target, 8) AS target, admissible FROM ok QUALIFY row_number() OVER (PARTITION BY family ORDER BY round(abs(scale - target), 12), mae, scale) = 1")
def k25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scales of origin, rank, tail and score-state families, fitted on the dates from 50 to 80 %."""
    return rounded(families.fit_scales(families.candidates(_family_rows(spark, sf_dir), "y", "q50", "score")), 8)


@query("k25_affine", f"""WITH {FAMILY_SQL}, rs AS (SELECT scale AS slope, y - scale * x AS rest FROM lg JOIN sg USING (family) WHERE family = 'origin_scale'), ic AS (SELECT slope, least(greatest(median(rest), -0.08), 0.08) AS intercept FROM rs GROUP BY 1)
 SELECT slope, round(intercept, 8) AS intercept, round(avg(abs(rest - intercept)), 8) AS mae, count(*) AS n FROM rs JOIN ic USING (slope) GROUP BY slope, intercept ORDER BY round(avg(abs(rest - intercept)), 12), abs(slope - 1) LIMIT 1""")
def k25a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The robust affine forecast of the same dates."""
    return rounded(families.fit_affine(_family_rows(spark, sf_dir), "y", "score"), 8)


_SHAPED = "CASE WHEN sg <> 0 AND sure >= 0.045 AND (sign(tp) = sg OR abs(tp) <= 0.045 * v) AND fl > 0 THEN sg * greatest(abs(tp), fl * v * least(greatest(0.75 + 4 * sure, 0.9), 1.45)) ELSE tp END"


@query("k24_dispersion", f"""WITH {PRED_SQL}, a AS (SELECT r AS y, score / 2 AS f, p, 0.5 + (id % 7) / 10.0 AS v, sign(p - 0.5) AS sg, abs(p - 0.5) AS sure FROM pb), g AS (SELECT a.*, s.scale, fl, f * s.scale AS pt FROM a, (SELECT 0.2::DOUBLE + 1.8::DOUBLE * range / 29 AS scale FROM range(30)) s, (SELECT unnest([0.0, 0.04, 0.08, 0.12, 0.16, 0.20, 0.25]) AS fl)),
 h AS (SELECT *, CASE WHEN sure >= 0.070 AND sign(pt) <> sg AND abs(pt) <= 0.15 * v THEN sg * greatest(abs(pt), 0.06 * v) ELSE pt END AS tp FROM g), k AS (SELECT y, scale, fl, {_SHAPED} AS q FROM h),
 t AS (SELECT scale, fl AS floor, round(avg(abs(y - q)), 12) AS mae, round(stddev_samp(abs(y - q)) / sqrt(count(*)), 12) AS se, round(stddev_pop(q) / greatest(stddev_pop(y), 1e-12), 12) AS dispersion, round(avg(CAST(abs(q) >= 0.001 AS INT)), 12) AS over10bp FROM k GROUP BY 1, 2),
 b AS (SELECT mae + se AS lim FROM t ORDER BY mae, scale, floor LIMIT 1), c AS (SELECT scale, floor FROM t, b WHERE mae <= lim ORDER BY dispersion DESC, over10bp DESC, floor DESC, scale DESC LIMIT 1)
 SELECT round(t.scale, 6) AS scale, CAST(t.floor AS DOUBLE) AS floor, round(mae, 6) AS mae, round(dispersion, 6) AS dispersion, round(over10bp, 6) AS over10bp, t.scale = c.scale AND t.floor = c.floor AS chosen FROM t, c""")
def k24d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K24 toward dispersion: 210 pairs of scale and conviction floor."""
    d = predictions(spark, sf_dir).select(F.col("r").alias("y"), (F.col("score") / 2).alias("f"), "p", (0.5 + (F.col("id") % 7) / 10).alias("v"))
    return rounded(forecast.dispersion_scale(d, "y", "f", "p", "v", 5).select("scale", "floor", "mae", "dispersion", "over10bp", "chosen"), 6)
