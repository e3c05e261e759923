"""Queries of joins, studies, text, flow, risk, validation, models, monitoring and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import written
from ..functions.expressions import trailing
from ..operators import boosting, features, flow, forecast, gram, joins, models, monitor, risk, studies, text, validate
from ..sources import adapters
from ..sources.adapters import ARTICLES_SQL, BARS_SQL, FLOWS_SQL, MACRO_SQL, SECTORS_SQL, articles, bars, flows, macro, sectors, table, ticks
from ..streaming import panels
from .panel import ORACLES, PANEL_SQL, QUERIES, SCORED_SQL, W, _ema_sql, featured, frame, held, panel, query, rounded, scored

POS, NEG = ("the", "und", "que"), ("of", "der", "les")
KINDS = {"A": ("ea", "en", "la"), "B": ("er", "de", "an"), "C": ("on", "in", "es")}


def _hit(terms, of: str = "low") -> str:
    return " + ".join(f"CAST(contains({of}, '{t}') AS INT)" for t in terms)


__all__ = ["ORACLES", "QUERIES"]

#: Words of the test corpus that stand for sources and kinds of titles.
_SOURCES = {"official": ("src0",), "trusted": ("src1", "src2"), "clarify": ("pathetic", "idiot"), "rumour": ("tion",)}
TEXT_SQL = f"""{ARTICLES_SQL}, t0 AS (SELECT *, lower(coalesce(title, '')) AS low, CASE id % 5 WHEN 0 THEN 'RUMOR' WHEN 1 THEN 'OFFICIAL' ELSE 'MAIN' END AS stream FROM articles),
 t1 AS (SELECT *, {_hit(POS)} AS pos, {_hit(NEG)} AS neg, {_hit(KINDS['A'])} AS ha, {_hit(KINDS['B'])} AS hb, {_hit(KINDS['C'])} AS hc,
   CASE WHEN {_hit(_SOURCES['clarify'])} > 0 THEN 'CLARIFICATION' WHEN stream = 'RUMOR' AND {_hit(_SOURCES['rumour'])} > 0 THEN 'RUMOR_UNVERIFIED' WHEN contains(lower(publisher), 'src0') THEN 'OFFICIAL' ELSE 'MAINSTREAM' END AS kind FROM t0),
 items AS (SELECT *, (pos - neg) / greatest(1, pos + neg) AS sentiment, CASE WHEN pos > neg THEN 'POS' WHEN pos < neg THEN 'NEG' ELSE 'NEU' END AS label, CAST(CASE WHEN pos = neg THEN 0 ELSE sign(pos - neg) * least(1, 0.42 + 0.18 * abs(pos - neg)) END AS DOUBLE) AS signed,
   CASE WHEN greatest(ha, hb, hc) = 0 THEN 'GENERAL' WHEN ha >= hb AND ha >= hc THEN 'A' WHEN hb >= hc THEN 'B' ELSE 'C' END AS event, CAST(0.35 + 0.18 * least(greatest(ha, hb, hc), 3) AS DOUBLE) AS materiality,
   CAST(CASE kind WHEN 'OFFICIAL' THEN 1.0 WHEN 'CLARIFICATION' THEN 0.95 WHEN 'RUMOR_UNVERIFIED' THEN 0.35 ELSE CASE WHEN contains(lower(publisher), 'src1') OR contains(lower(publisher), 'src2') THEN 0.9 ELSE 0.62 END END AS DOUBLE) AS quality,
   CASE WHEN kind = 'MAINSTREAM' AND stream = 'OFFICIAL' THEN 'OFFICIAL' WHEN kind = 'MAINSTREAM' AND stream = 'RUMOR' THEN 'RUMOR_UNVERIFIED' ELSE kind END AS source_class,
   CAST(d + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS DATE) AS available
   FROM (SELECT *, CAST(published_at AS DATE) + CASE WHEN hour(published_at) >= 15 THEN 1 ELSE 0 END AS d FROM t1))"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with stream, sentiment, event class, source class and effective day."""
    k = F.col("id") % 5
    df = articles(spark, sf_dir).withColumn("stream", F.when(k == 0, "RUMOR").when(k == 1, "OFFICIAL").otherwise("MAIN"))
    df = text.lexical_sentiment(df, positive=POS, negative=NEG)
    return text.source_class(text.event_class(df, events=KINDS), **_SOURCES).withColumn("available", joins.effective_date())


# ---- joins -------------------------------------------------------------------------------------------------------


@query("f01_asof_macro", f"WITH {BARS_SQL}, {MACRO_SQL}, s AS (SELECT d.date, m.series FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT DISTINCT series FROM macro) m), j AS (SELECT a.date, a.series, a.value AS at_or_before, b.value AS before FROM (SELECT s.*, m.value FROM s ASOF LEFT JOIN macro m ON s.series = m.series AND s.date >= m.date) a JOIN (SELECT s.*, m.value FROM s ASOF LEFT JOIN macro m ON s.series = m.series AND s.date > m.date) b USING (date, series)) SELECT symbol, date, series, at_or_before, before FROM (SELECT DISTINCT symbol, date FROM bars) JOIN j USING (date)")
def f01(spark, sf_dir):
    """F1, F2: each macro series known at, and strictly before, each session."""
    m = macro(spark, sf_dir)
    s = bars(spark, sf_dir).select("symbol", "date")
    series = m.select("series").distinct()  # a handful
    dates = s.select("date").distinct().withColumn("series", F.explode(F.array(*[F.lit(x) for x in sorted(_ROLES)]))).join(series, "series", "left_semi")
    at = joins.asof(dates, m.withColumnRenamed("value", "at_or_before"), "date", "series", ["at_or_before"])
    return s.join(joins.asof(at, m.withColumnRenamed("value", "before"), "date", "series", ["before"], strict=True), "date").select("symbol", "date", "series", "at_or_before", "before")


@query("f04_effective_session", f"WITH {BARS_SQL}, {TEXT_SQL} SELECT i.id, i.available AS effective, b.date AS session FROM items i ASOF LEFT JOIN (SELECT symbol, date FROM bars) b ON i.symbol = b.symbol AND i.available <= b.date")
def f04(spark, sf_dir):
    """F4."""
    return joins.effective_session(articles(spark, sf_dir).select("symbol", "id", "published_at"), bars(spark, sf_dir)).select("id", "effective", "session")


@query("f05_benchmark", f"WITH {PANEL_SQL}, l AS (SELECT symbol, date, lead(date, 5) OVER ({W}) AS m FROM bars), i AS (SELECT date, avg(close) AS close FROM bars WHERE date % 9 <> 0 GROUP BY 1) SELECT l.symbol, l.date, m AS matures5, round(ln(b.close / a.close), 4) AS benchmark FROM l LEFT JOIN i a ON a.date = l.date LEFT JOIN i b ON b.date = l.m".replace("date % 9", "(date - DATE '1970-01-01') % 9"))
def f05(spark, sf_dir):
    """index (mean close) with missing days."""
    b = bars(spark, sf_dir)
    index = b.filter(F.unix_date("date") % 9 != 0).groupBy("date").agg(F.avg("close").alias("close"))
    return rounded(joins.benchmark_exact(features.label_returns(b, (5,)).select("symbol", "date", "matures5"), index, "date", "matures5"))


@query("f06_trailing_items", f"WITH {BARS_SQL}, {TEXT_SQL} SELECT b.symbol, b.date, count(i.id) FILTER (i.available >= b.date - 5) AS items5, count(i.id) AS items30, max(i.available) AS last_event FROM (SELECT symbol, date FROM bars) b LEFT JOIN items i ON i.symbol = b.symbol AND i.available BETWEEN b.date - 30 AND b.date GROUP BY 1, 2")
def f06(spark, sf_dir):
    """calendar windows and the latest item (within 30 days)."""
    it = items(spark, sf_dir).withColumn("weight", F.lit(1.0))
    s = bars(spark, sf_dir).select("symbol", "date")
    w, e = joins.trailing_items(s, it, (5, 30)), joins.latest_event(s, it)
    return w.join(e, ["symbol", "date"]).select("symbol", "date", "items5", "items30", F.when(F.col("event_age") <= 30, F.col("event_date")).alias("last_event"))


@query("f08_analogs", f"WITH {PANEL_SQL}, k AS (SELECT symbol, date, ret5, vol20, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i FROM panel WHERE ret5 IS NOT NULL AND vol20 IS NOT NULL), z AS (SELECT *, (ret5 - avg(ret5) OVER s) / stddev_samp(ret5) OVER s AS a, (vol20 - avg(vol20) OVER s) / stddev_samp(vol20) OVER s AS b FROM k WINDOW s AS (PARTITION BY symbol)), d AS (SELECT z.symbol, z.date, round(sqrt(pow(z.a - q.a, 2) + pow(z.b - q.b, 2)), 9) AS distance, count(*) OVER (PARTITION BY z.symbol) AS n FROM z JOIN z q ON q.symbol = z.symbol AND q.i = 1 WHERE z.i > 61) SELECT symbol, date, round(distance, 5) AS distance FROM d WHERE n >= 80 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY distance, date) <= 40")
def f08(spark, sf_dir):
    """F8."""
    return joins.analogs_current(panel(spark, sf_dir).select("symbol", "date", "ret5", "vol20"), ["ret5", "vol20"]).select("symbol", "date", F.round("distance", 5).alias("distance"))


@query("f09_analogs_pit", f"WITH {PANEL_SQL}, k AS (SELECT symbol, date, round(ret5, 6) AS ret5, row_number() OVER ({W}) AS i FROM panel), s AS (SELECT * FROM k WHERE i % 100 = 0) SELECT s.symbol, s.date AS state_date, k.date, round(abs(k.ret5 - s.ret5), 8) AS distance FROM s JOIN k ON k.symbol = s.symbol AND k.i + 60 <= s.i AND k.i < s.i - 60 WHERE k.ret5 IS NOT NULL AND s.ret5 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s.symbol, s.date ORDER BY round(sqrt(pow(k.ret5 - s.ret5, 2)), 9), k.date) <= 40")
def f09(spark, sf_dir):
    """F9 for every hundredth row of each symbol."""
    p = panel(spark, sf_dir).select("symbol", "date", F.round("ret5", 6).alias("ret5"))
    return joins.analogs_point_in_time(p, ["ret5"], features.sample_every(p, 100)).select("symbol", "state_date", "date", F.round("distance", 8).alias("distance"))


@query("f10_hierarchy", f"WITH {TEXT_SQL}, {SECTORS_SQL}, j AS (SELECT i.id, i.symbol, i.event, s.sector, i.signed AS y FROM items i JOIN sectors s USING (symbol)) SELECT id, round(CASE WHEN count(y) OVER (PARTITION BY symbol, event) >= 8 THEN avg(y) OVER (PARTITION BY symbol, event) WHEN count(y) OVER (PARTITION BY sector, event) >= 8 THEN avg(y) OVER (PARTITION BY sector, event) ELSE avg(y) OVER (PARTITION BY event) END, 6) AS prior, CASE WHEN count(y) OVER (PARTITION BY symbol, event) >= 8 THEN 'own' WHEN count(y) OVER (PARTITION BY sector, event) >= 8 THEN 'sector' ELSE 'event' END AS prior_level FROM j")
def f10(spark, sf_dir):
    """F10."""
    j = items(spark, sf_dir).join(sectors(spark, sf_dir), "symbol").select("id", "symbol", "event", "sector", F.col("signed").alias("y"))
    return rounded(joins.prior_hierarchy(j, "y").select("id", "prior", "prior_level"), 6)


@query("f12_rejects", f"WITH {ARTICLES_SQL}, {SECTORS_SQL} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM (SELECT CASE WHEN symbol NOT IN (SELECT symbol FROM sectors) THEN 'outside_universe' WHEN id % 10 = 0 THEN 'seen' WHEN length(trim(title)) = 0 THEN 'no_title' END AS reason FROM articles) GROUP BY 1")
def f12(spark, sf_dir):
    """F12, F11's shape."""
    a = articles(spark, sf_dir)
    r = joins.reject_reasons(a, sectors(spark, sf_dir), a.filter("id % 10 = 0").select("id"))
    return r.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("f13_full_outer", f"WITH {FLOWS_SQL} SELECT symbol, date, round(foreign_net, 3) AS foreign_net, round(prop_net, 3) AS prop_net FROM flows WHERE foreign_net IS NOT NULL OR prop_net IS NOT NULL")
def f13(spark, sf_dir):
    """the two sides as separate sources."""
    f = flows(spark, sf_dir)
    return rounded(joins.full_outer(f.filter("foreign_net is not null").select("symbol", "date", "foreign_net"), f.filter("prop_net is not null").select("symbol", "date", "prop_net")), 3)


# ---- studies -----------------------------------------------------------------------------------------------------


@query("g01_event_study", f"""WITH {PANEL_SQL}, {TEXT_SQL}, {SECTORS_SQL}, p AS (SELECT symbol, date, ln(lead(close, 5) OVER ({W}) / close) AS y FROM panel), e AS (SELECT i.event, i.label, s.sector, p.y FROM items i ASOF JOIN p ON i.symbol = p.symbol AND i.available <= p.date JOIN sectors s ON s.symbol = i.symbol)
 SELECT event, label, sector, count(y) AS n, round(avg(y), 4) AS mean, round(median(y), 4) AS median, round(avg(CASE WHEN y IS NOT NULL THEN CAST(y > 0 AS INT) END), 6) AS positive_rate, round(quantile_cont(y, 0.2), 4) AS q20 FROM e GROUP BY GROUPING SETS ((event), (event, label), (sector, event), (sector, event, label))""")
def g01(spark, sf_dir):
    """Five-session outcomes after articles, by grouping sets."""
    p = features.label_returns(bars(spark, sf_dir), (5,)).select("symbol", "date", F.col("y5").alias("y"))
    it = items(spark, sf_dir)
    e = joins.effective_session(it.select("symbol", "id", "published_at", "event", "label", "publisher"), p).filter("session is not null").withColumn("date", F.col("session")).join(p, ["symbol", "date"], "left").join(sectors(spark, sf_dir).select("symbol", "sector"), "symbol")
    c = [F.col(x) for x in ("event", "label", "sector")]
    r = e.groupingSets([[c[0]], [c[0], c[1]], [c[2], c[0]], c], *c).agg(*studies.stats("y"))
    return r.select("event", "label", "sector", "n", *[F.round(x, 4).alias(x) for x in ("mean", "median", "q20")], F.round("positive_rate", 6).alias("positive_rate"))


@query("g03_abnormal", f"WITH {PANEL_SQL}, p AS (SELECT symbol, date, ln(lead(close, 5) OVER ({W}) / close) AS y FROM panel) SELECT symbol, date, round(CASE WHEN count(y) OVER (PARTITION BY date) >= 8 THEN y - median(y) OVER (PARTITION BY date) END, 4) AS ar FROM p")
def g03(spark, sf_dir):
    """G3."""
    return rounded(studies.abnormal_returns(features.label_returns(bars(spark, sf_dir), (5,)), "y5").select("symbol", "date", "ar"))


@query("g05_macro_states", f"WITH {MACRO_SQL}, r AS (SELECT date, series, ln(value / lag(value, 20) OVER (PARTITION BY series ORDER BY date)) AS r, CASE series WHEN '1-URGENT' THEN 0.5 WHEN '2-HIGH' THEN 0.3 WHEN '5-LOW' THEN -0.2 END AS w FROM macro), s AS (SELECT date, sum(r * w) / sum(abs(w)) AS score, count(r) AS used FROM r WHERE r IS NOT NULL AND w IS NOT NULL GROUP BY 1), z AS (SELECT *, (score - avg(score) OVER f) / nullif(stddev_samp(score) OVER f, 0) AS z FROM s WINDOW f AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) SELECT date, used AS series_used, round(score, 5) AS score, round(z, 4) AS z, CASE WHEN z >= 0.75 THEN 'SUPPORTIVE' WHEN z <= -0.75 THEN 'STRESS' WHEN z IS NOT NULL THEN 'NEUTRAL' END AS state FROM z")
def g05(spark, sf_dir):
    """G5."""
    m = studies.macro_states(macro(spark, sf_dir), {"1-URGENT": 0.5, "2-HIGH": 0.3, "5-LOW": -0.2})
    return m.select("date", "series_used", F.round("score", 5).alias("score"), F.round("z", 4).alias("z"), "state")


_EVENT_SQL = f"{PANEL_SQL}, {TEXT_SQL}, {SECTORS_SQL}, p AS (SELECT symbol, date, round(ln(lead(close, 5) OVER ({W}) / close), 6) AS y, lead(date, 5) OVER ({W}) AS m FROM panel), e AS (SELECT i.id, i.symbol, s.sector, i.event, p.date, p.y, p.m FROM items i JOIN sectors s USING (symbol) ASOF JOIN p ON i.symbol = p.symbol AND i.available <= p.date), told AS (SELECT a.id, count(b.id) AS n_market, CAST(sum(CAST(b.y AS DECIMAL(28, 9))) AS DOUBLE) AS s_market, count(b.id) FILTER (b.y > 0) AS h_market, count(b.id) FILTER (b.symbol = a.symbol) AS n_own, CAST(sum(CAST(b.y AS DECIMAL(28, 9))) FILTER (b.symbol = a.symbol) AS DOUBLE) AS s_own, count(b.id) FILTER (b.symbol = a.symbol AND b.y > 0) AS h_own, count(b.id) FILTER (b.sector = a.sector) AS n_sector, CAST(sum(CAST(b.y AS DECIMAL(28, 9))) FILTER (b.sector = a.sector) AS DOUBLE) AS s_sector, count(b.id) FILTER (b.sector = a.sector AND b.y > 0) AS h_sector FROM e a LEFT JOIN e b ON b.event = a.event AND b.y IS NOT NULL AND b.m <= a.date GROUP BY 1), prior AS (SELECT *, s_market / nullif(n_market, 0) AS mean_market, h_market / nullif(n_market, 0) AS hits_market, s_own / nullif(n_own, 0) AS mean_own, h_own / nullif(n_own, 0) AS hits_own, s_sector / nullif(n_sector, 0) AS mean_sector, h_sector / nullif(n_sector, 0) AS hits_sector FROM told)"


def priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles' five-session outcomes with what was known of earlier ones."""
    p = features.label_returns(bars(spark, sf_dir), (5,)).select("symbol", "date", F.round("y5", 6).alias("y"), F.col("matures5").alias("matures"))
    e = joins.effective_session(items(spark, sf_dir).select("symbol", "id", "published_at", "event"), p).filter("session is not null").withColumn("date", F.col("session")).join(p, ["symbol", "date"]).join(sectors(spark, sf_dir).select("symbol", "sector"), "symbol")
    return studies.matured_priors(e.select("id", "symbol", "sector", "event", "date", "y", "matures"), "y")


@query("g07_matured_priors", f"WITH {_EVENT_SQL} SELECT id, n_own, n_sector, n_market, mean_own, mean_sector, mean_market, hits_market FROM prior")
def g07(spark, sf_dir):
    """G7."""
    r = priors(spark, sf_dir)
    return r.select("id", "n_own", "n_sector", "n_market", "mean_own", "mean_sector", "mean_market", "hits_market")


@query("g08_shrinkage", f"""WITH {_EVENT_SQL}, a AS (SELECT *, CASE WHEN n_sector > 0 THEN n_sector ELSE n_market END AS sn, CASE WHEN n_sector > 0 THEN mean_sector ELSE coalesce(mean_market, 0) END AS sm, CASE WHEN n_sector > 0 THEN hits_sector ELSE coalesce(hits_market, 0.5) END AS sh FROM prior),
 b AS (SELECT *, CASE WHEN n_own > 0 THEN n_own ELSE sn END AS tn, CASE WHEN n_own > 0 THEN mean_own ELSE sm END AS tm, CASE WHEN n_own > 0 THEN hits_own ELSE sh END AS th, least(1.0, n_market / 60.0) AS wm, least(1.0, sn / 30.0) AS ws FROM a)
 SELECT id, round(least(1.0, tn / 8.0) * tm + (1 - least(1.0, tn / 8.0)) * (ws * sm + (1 - ws) * wm * coalesce(mean_market, 0)), 9) AS shrunk_mean, round(least(1.0, tn / 8.0) * th + (1 - least(1.0, tn / 8.0)) * (ws * sh + (1 - ws) * (wm * coalesce(hits_market, 0.5) + (1 - wm) * 0.5)), 9) AS shrunk_hit,
   CASE WHEN n_own >= 8 THEN 'STOCK' WHEN n_sector >= 20 THEN 'SECTOR' ELSE 'MARKET' END AS level, CASE WHEN n_own > 0 THEN n_own WHEN n_sector > 0 THEN n_sector ELSE n_market END AS prior_n, round((n_own * coalesce(mean_own, 0) + 16 * coalesce(mean_market, 0)) / (n_own + 16), 9) AS posterior_mean, round((n_own * coalesce(hits_own, 0) + 6 * coalesce(hits_market, 0.5)) / (n_own + 6), 9) AS posterior_hit FROM b""")
def g08(spark, sf_dir):
    """G7, G8."""
    return studies.shrink(priors(spark, sf_dir)).select("id", *[F.round(c, 9).alias(c) for c in ("shrunk_mean", "shrunk_hit", "posterior_mean", "posterior_hit")], "level", "prior_n")


@query("g16_coverage", f"""WITH {TEXT_SQL}, g AS (SELECT symbol % 12 AS grp, count(*) AS n, count(DISTINCT publisher) AS publishers, count(*) FILTER (available >= DATE '1999-07-01') AS recent FROM items GROUP BY 1)
 SELECT grp, n, publishers, recent, CASE WHEN n >= 35 AND publishers >= 7 AND recent >= 12 THEN 'STRONG' WHEN n >= 18 AND publishers >= 5 AND recent >= 6 THEN 'MODERATE' WHEN n >= 6 AND publishers >= 3 THEN 'LIMITED' ELSE 'THIN' END AS grade, CASE WHEN n >= 50 THEN 'MATURE' WHEN n >= 20 THEN 'MODERATE' WHEN n >= 8 THEN 'LIMITED' ELSE 'THIN' END AS maturity FROM g""")
def g16(spark, sf_dir):
    """G16."""
    g = items(spark, sf_dir).groupBy((F.col("symbol") % 12).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("publisher").alias("publishers"), F.count_if(F.col("available") >= F.lit("1999-07-01").cast("date")).alias("recent"))
    return g.select("*", studies.coverage_grade("n", "publishers", "recent").alias("grade"), studies.study_maturity("n").alias("maturity"))


@query("g10_evidence", f"WITH {TEXT_SQL} SELECT symbol, event, round(sum(signed * materiality) / sum(materiality), 9) AS evidence, round(avg(CAST(signed < 0 AS INT)), 6) AS negative_share, count(DISTINCT publisher) AS publishers, count(*) AS items FROM items GROUP BY 1, 2")
def g10(spark, sf_dir):
    """G10."""
    e = studies.weighted_evidence(items(spark, sf_dir), ["symbol", "event"], "signed", "materiality")
    return e.select("symbol", "event", F.round("evidence", 9).alias("evidence"), F.round("negative_share", 6).alias("negative_share"), "publishers", "items")


@query("g11_tails", f"WITH {BARS_SQL} SELECT symbol, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 3")
def g11(spark, sf_dir):
    """G11."""
    return studies.tail_rows(bars(spark, sf_dir).select("symbol", "date", "close"), 3)


@query("g13_episodes", f"WITH {PANEL_SQL}, a AS (SELECT symbol, date, dd60, row_number() OVER ({W}) AS i FROM panel), b AS (SELECT *, CASE WHEN i - lag(i) OVER ({W}) > 20 OR lag(i) OVER ({W}) IS NULL THEN 1 ELSE 0 END AS nw FROM a WHERE dd60 < -0.95), c AS (SELECT *, sum(nw) OVER ({W}) AS episode FROM b) SELECT symbol, episode, min(date) AS start, max(date) AS \"end\", count(*) AS rows, bool_or(dd60 < -0.99) AS alerted FROM c GROUP BY 1, 2")
def g13(spark, sf_dir):
    """G13."""
    return studies.episodes(panel(spark, sf_dir), "dd60 < -0.95", 20, "dd60 < -0.99")


@query("g14_onsets", f"WITH RECURSIVE {PANEL_SQL}, a AS (SELECT symbol, date, dd60, row_number() OVER ({W}) AS row FROM panel), e AS (SELECT symbol, date, row FROM a WHERE dd60 < -0.95), t AS (SELECT symbol, min(row) AS row FROM e GROUP BY 1 UNION ALL SELECT t.symbol, (SELECT min(e.row) FROM e WHERE e.symbol = t.symbol AND e.row >= t.row + 30) FROM t WHERE t.row IS NOT NULL) SELECT e.symbol, e.date, e.row FROM e JOIN t ON t.symbol = e.symbol AND t.row = e.row")
def g14(spark, sf_dir):
    """G14."""
    return studies.greedy_gap(panel(spark, sf_dir), "dd60 < -0.95", 30)


_ONSETS_SQL = f"{PANEL_SQL}, a AS (SELECT symbol, date, dd60, vol20, row_number() OVER ({W}) AS row FROM panel), e AS (SELECT symbol, date, row, dd60 FROM a WHERE dd60 < -0.95), t AS (SELECT symbol, min(row) AS row FROM e GROUP BY 1 UNION ALL SELECT t.symbol, (SELECT min(e.row) FROM e WHERE e.symbol = t.symbol AND e.row >= t.row + 30) FROM t WHERE t.row IS NOT NULL)"


@query("g15_lead_replay", f"WITH RECURSIVE {_ONSETS_SQL}, o AS (SELECT e.symbol, e.date, e.row FROM e JOIN t ON t.symbol = e.symbol AND t.row = e.row QUALIFY row_number() OVER (PARTITION BY e.symbol ORDER BY e.row) <= 8) SELECT o.symbol, o.date AS event_date, CAST(l.lead AS INT) AS lead, a.date AS state_date, round(a.dd60, 4) AS dd60, round(a.vol20, 4) AS vol20 FROM o CROSS JOIN (VALUES (20), (10), (5), (0)) l(lead) JOIN a ON a.symbol = o.symbol AND a.row = o.row - l.lead")
def g15(spark, sf_dir):
    """Drawdown and volatility 20, 10, 5 and 0 rows before each of a symbol's first onsets."""
    p = panel(spark, sf_dir)
    return rounded(studies.lead_replay(p, studies.worst_cases(studies.greedy_gap(p, "dd60 < -0.95", 30), "row"), ["dd60", "vol20"]))


@query("g17_segments", f"WITH {PANEL_SQL}, p AS (SELECT *, ln(lead(close, 5) OVER ({W}) / close) AS y FROM panel), q AS (SELECT * FROM p WHERE y IS NOT NULL AND ret5 IS NOT NULL), s AS (SELECT 'calm' AS segment, y, ret5 FROM q WHERE vol_pct < 0.5 UNION ALL SELECT 'deep', y, ret5 FROM q WHERE dd60 < -0.9 UNION ALL SELECT 'year ' || year(date), y, ret5 FROM q) SELECT segment, count(*) AS rows, round(avg(y), 4) AS mean, round(avg(CAST(sign(y) = sign(ret5) AS INT)), 5) AS hit, CASE WHEN count(*) < 500 THEN 'INSUFFICIENT' ELSE 'OK' END AS verdict FROM s GROUP BY 1")
def g17(spark, sf_dir):
    """G17."""
    r = studies.segment_metrics(features.label_returns(panel(spark, sf_dir), (5,)), {"calm": "vol_pct < 0.5", "deep": "dd60 < -0.9"}, "y5", "ret5")
    return r.select("segment", "rows", F.round("mean", 4).alias("mean"), F.round("hit", 5).alias("hit"), "verdict")


# ---- text --------------------------------------------------------------------------------------------------------


@query("h01_sentiment", f"WITH {TEXT_SQL} SELECT id, pos, neg, round(sentiment, 6) AS sentiment, label, round(signed, 6) AS signed, event, round(materiality, 6) AS materiality, source_class, quality, available FROM items")
def h01(spark, sf_dir):
    """H1, H2, H4, H5, with terms of the corpus."""
    return rounded(items(spark, sf_dir).select("id", "pos", "neg", "sentiment", "label", "signed", "event", "materiality", "source_class", "quality", "available"), 6)


@query("h02_published_terms", f"""WITH {ARTICLES_SQL}, a AS (SELECT id, lang, lower(coalesce(title, '')) || ' ' || CASE id % 6 WHEN 0 THEN 'lợi nhuận tăng, cổ tức' WHEN 1 THEN 'khởi tố và thua lỗ' WHEN 2 THEN 'trúng thầu dự án, thoái vốn' WHEN 3 THEN 'mua ròng, khối ngoại' ELSE '' END AS low FROM articles),
 h AS (SELECT id, CAST(contains(low, 'tăng trưởng') AS INT) + CAST(contains(low, 'lợi nhuận tăng') AS INT) + CAST(contains(low, 'lãi tăng') AS INT) + CAST(contains(low, 'kỷ lục') AS INT) + CAST(contains(low, 'mở rộng') AS INT) + CAST(contains(low, 'trúng thầu') AS INT) + CAST(contains(low, 'nâng hạng') AS INT) + CAST(contains(low, 'khuyến nghị mua') AS INT) + CAST(contains(low, 'vượt kế hoạch') AS INT) + CAST(contains(low, 'tăng mạnh') AS INT) + {_hit(('record', 'growth', 'profit rises', 'upgrade', 'buy', 'beat', 'outperform'))} AS pos,
   {_hit(('khởi tố', 'bắt giữ', 'điều tra', 'vi phạm', 'xử phạt', 'truy thu', 'thua lỗ', 'báo lỗ', 'lỗ ròng', 'giảm mạnh', 'lao dốc', 'sụt giảm', 'bán tháo', 'cắt giảm', 'hủy', 'nợ xấu', 'vỡ nợ', 'cảnh báo', 'rủi ro', 'suy giảm', 'đóng cửa', 'trì hoãn', 'downgrade', 'sell', 'fraud', 'investigation', 'loss', 'decline', 'slump', 'warning', 'risk', 'miss'))} AS neg,
   {_hit(('tăng trưởng', 'tăng mạnh', 'bứt phá', 'vượt kế hoạch', 'lợi nhuận tăng', 'lãi tăng', 'kỷ lục', 'trúng thầu', 'mua ròng', 'nâng hạng', 'khởi sắc', 'cổ tức', 'hồi phục', 'tích cực', 'mở rộng', 'được phê duyệt', 'hoàn thành'))} AS sp,
   {_hit(('giảm mạnh', 'lao dốc', 'bán tháo', 'thua lỗ', 'lỗ ròng', 'lợi nhuận giảm', 'bán ròng', 'xả hàng', 'vi phạm', 'xử phạt', 'khởi tố', 'điều tra', 'cảnh báo', 'đình chỉ', 'hủy niêm yết', 'rủi ro', 'suy giảm', 'nợ xấu', 'mất giá', 'bốc hơi', 'phá sản', 'thanh tra', 'tin đồn'))} AS sn, low FROM a),
 k AS (SELECT *, {_hit(('lợi nhuận', 'doanh thu', 'kết quả kinh doanh', 'báo lỗ', 'lỗ ròng', 'biên lợi nhuận'))} AS e1, {_hit(('khởi tố', 'điều tra', 'xử phạt', 'vi phạm', 'thanh tra', 'cảnh báo'))} AS e2, {_hit(('cổ tức', 'phát hành', 'quyền mua', 'chia tách', 'esop', 'cổ phiếu thưởng'))} AS e3, {_hit(('cổ đông lớn', 'thoái vốn', 'đăng ký mua', 'đăng ký bán', 'chủ tịch', 'người nội bộ'))} AS e4,
   {_hit(('trái phiếu', 'nợ vay', 'đáo hạn', 'tín dụng', 'phát hành riêng lẻ'))} AS e5, {_hit(('hợp đồng', 'trúng thầu', 'dự án', 'm&a', 'sáp nhập', 'mua lại', 'thoái vốn'))} AS e6, {_hit(('khuyến nghị', 'giá mục tiêu', 'nâng khuyến nghị', 'hạ khuyến nghị'))} AS e7, {_hit(('mua ròng', 'bán ròng', 'khối ngoại', 'tự doanh', 'room ngoại'))} AS e8 FROM h),
 m AS (SELECT *, greatest(e1, e2, e3, e4, e5, e6, e7, e8) AS e FROM k)
 SELECT id, pos, neg, round((pos - neg) / greatest(1, pos + neg), 6) AS sentiment, CASE WHEN sp > sn THEN 'POS' WHEN sn > sp THEN 'NEG' ELSE 'NEU' END AS signal, round(CAST(CASE WHEN sp = sn THEN 0 ELSE sign(sp - sn) * least(1, 0.42 + 0.18 * abs(sp - sn)) END AS DOUBLE), 6) AS signed,
   CASE WHEN e = 0 THEN 'GENERAL' WHEN e1 = e THEN 'EARNINGS' WHEN e2 = e THEN 'REGULATORY' WHEN e3 = e THEN 'CORPORATE_ACTION' WHEN e4 = e THEN 'OWNERSHIP' WHEN e5 = e THEN 'FINANCING' WHEN e6 = e THEN 'OPERATIONS_MA' WHEN e7 = e THEN 'ANALYST' ELSE 'MARKET_FLOW' END AS event, round(CAST(0.35 + 0.18 * least(3, e) AS DOUBLE), 6) AS materiality FROM m""")
def h02(spark, sf_dir):
    """H1, H2, H4 with the published terms, over titles with a published phrase put behind two thirds of them."""
    k = F.col("id") % 6
    more = F.when(k == 0, "lợi nhuận tăng, cổ tức").when(k == 1, "khởi tố và thua lỗ").when(k == 2, "trúng thầu dự án, thoái vốn").when(k == 3, "mua ròng, khối ngoại").otherwise("")
    a = articles(spark, sf_dir).withColumn("title", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), more))
    a = text.lexical_sentiment(a).select("id", "title", "pos", "neg", "sentiment")
    a = a.withColumnsRenamed({"pos": "p", "neg": "n", "sentiment": "s"})
    a = text.event_class(text.lexical_sentiment(a, positive=text.SIGNAL_POSITIVE, negative=text.SIGNAL_NEGATIVE))
    return rounded(a.select("id", F.col("p").alias("pos"), F.col("n").alias("neg"), F.col("s").alias("sentiment"), F.col("label").alias("signal"), "signed", "event", "materiality"), 6)


@query("h03_override", f"WITH {TEXT_SQL} SELECT id, CASE WHEN regexp_matches(title, '(?i)idiot') THEN 'NEG' WHEN regexp_matches(title, '(?i)^the') THEN 'POS' WHEN regexp_matches(title, 'der') THEN 'NEU' ELSE label END AS label FROM items")
def h03(spark, sf_dir):
    """H3."""
    return text.rule_override(items(spark, sf_dir), "(?i)idiot", "(?i)^the", "der").select("id", "label")


@query("h07_exact_titles", f"WITH {ARTICLES_SQL}, k AS (SELECT *, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS k FROM articles) SELECT symbol, id, count(*) OVER (PARTITION BY symbol, k) AS copies FROM k QUALIFY row_number() OVER (PARTITION BY symbol, k ORDER BY published_at, id) = 1")
def h07(spark, sf_dir):
    """H7."""
    return text.exact_titles(articles(spark, sf_dir)).select("symbol", "id", "copies")


_TOKENS = f"{ARTICLES_SQL}, k AS (SELECT symbol, id, CAST(published_at AS DATE) AS d, list_distinct(list_filter(string_split(regexp_replace(translate(lower(title), 'àáảãạăằắẳẵặâầấẩẫậäåāçđèéẻẽẹêềếểễệëēìíỉĩịîïīñòóỏõọôồốổỗộơờớởỡợöøōùúủũụưừứửữựûüūỳýỷỹỵÿ', 'aaaaaaaaaaaaaaaaaaaacdeeeeeeeeeeeeeiiiiiiiinoooooooooooooooooooouuuuuuuuuuuuuuyyyyyy'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS t FROM articles), pairs AS (SELECT a.symbol, a.id AS a, b.id AS b, a.d AS da, b.d AS db, coalesce(len(list_intersect(a.t, b.t)) / nullif(len(list_distinct(a.t || b.t)), 0), 0) AS s FROM k a JOIN k b ON a.symbol = b.symbol AND a.id <> b.id)"


@query("h08_near_titles", f"WITH {_TOKENS}, n AS (SELECT symbol, id, trim(regexp_replace(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM articles) SELECT p.symbol, b AS id, min(a) AS first_like, round(max(s), 6) AS similarity FROM pairs p JOIN n x ON x.symbol = p.symbol AND x.id = a JOIN n y ON y.symbol = p.symbol AND y.id = b WHERE a < b AND (s >= 0.82 OR s >= 0.6 AND 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) >= 0.91) GROUP BY 1, 2")
def h08(spark, sf_dir):
    """H8."""
    return rounded(text.near_duplicates(articles(spark, sf_dir)), 6)


@query("h09_novelty", f"WITH {_TOKENS} SELECT k.id, round(1 - coalesce(max(s), 0), 6) AS novelty FROM k LEFT JOIN pairs p ON p.b = k.id AND p.da < p.db AND p.da >= p.db - 30 GROUP BY 1")
def h09(spark, sf_dir):
    """H9."""
    return rounded(text.novelty(articles(spark, sf_dir)).select("id", "novelty"), 6)


@query("h12_entities", f"""WITH {_TOKENS}, g AS (SELECT symbol, CASE WHEN list_contains(t, 'the') THEN 'ticker' WHEN list_contains(t, 'idiot') THEN 'collision' WHEN list_contains(t, 'thth') AND list_contains(t, 'er') THEN 'company' WHEN list_contains(t, 'of') AND list_contains(t, 'is') THEN 'brand' WHEN list_contains(t, 'of') THEN 'ambiguous' ELSE 'no_mention' END AS reason FROM k)
 SELECT reason, count(*) AS items, count(DISTINCT symbol) AS symbols, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM g GROUP BY 1""")
def h12(spark, sf_dir):
    """Articles against rules that take a title word as ticker and brand."""
    a = articles(spark, sf_dir)
    rules = a.select("symbol").distinct().select("symbol", F.lit("the").alias("ticker"), F.array(F.lit("thth"), F.lit("er")).alias("tokens"), F.lit("of").alias("brand"), F.array(F.lit("is")).alias("context"), F.array(F.lit("idiot")).alias("collision"))
    gated = text.entity_gate(text.security_match(a, rules.select("symbol", "ticker")), rules)
    return rounded(text.entity_audit(gated), 6)


@query("h14_recency", f"WITH {TEXT_SQL}, w AS (SELECT *, quality * materiality * exp(-(DATE '1999-06-30' - CAST(published_at AS DATE)) / 45.0) AS w FROM items WHERE CAST(published_at AS DATE) <= DATE '1999-06-30') SELECT symbol, round(sum(signed * w) / sum(w), 5) AS news_score, count(*) AS items FROM w GROUP BY 1")
def h14(spark, sf_dir):
    """H14."""
    return rounded(text.recency_score(items(spark, sf_dir), "1999-06-30"), 5)


@query("h15_news_windows", f"WITH {BARS_SQL}, {TEXT_SQL}, d AS (SELECT symbol, available AS date, count(*) AS n, sum(materiality * quality) AS w, sum(signed * materiality * quality) AS s FROM items GROUP BY 1, 2), j AS (SELECT b.symbol, b.date, n, w, s FROM bars b LEFT JOIN d USING (symbol, date)) SELECT symbol, date, CAST(coalesce(sum(n) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING), 0) AS BIGINT) AS news_n5, CAST(coalesce(sum(n) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), 0) AS BIGINT) AS news_n20, round(sum(s) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) / sum(w) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), 5) AS news_sent20 FROM j")
def h15(spark, sf_dir):
    """H15, H6's times."""
    return rounded(text.news_windows(bars(spark, sf_dir), items(spark, sf_dir).withColumn("novelty", F.lit(1.0))).select("symbol", "date", "news_n5", "news_n20", "news_sent20"), 5)


@query("h10_relevance", f"""WITH {ARTICLES_SQL}, {SECTORS_SQL}, n AS (SELECT symbol, 'ti' AS ticker, lower(s_name) || ' the ' || lower(sector) AS name FROM sectors JOIN supplier ON s_suppkey = symbol), j AS (SELECT a.id, lower(trim(coalesce(title, ''))) AS low, string_split(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9à-ỹ]+', ' ', 'g'), ' ') AS words, list_filter(string_split(regexp_replace(name, '[^a-z0-9à-ỹ]+', ' ', 'g'), ' '), lambda x: length(x) > 2) AS own, ticker FROM articles a JOIN n USING (symbol)),
 s AS (SELECT *, len(list_filter(own, lambda x: list_contains(words, x))) / greatest(len(own), 1) AS share FROM j WHERE low <> '' AND NOT starts_with(low, 'untitled') AND NOT starts_with(low, 'cw.') AND NOT contains(low, 'covered warrant')) SELECT id, CAST(CASE WHEN list_contains(words, ticker) THEN 1.0 WHEN share >= 0.65 THEN 0.9 WHEN share >= 0.35 THEN 0.72 ELSE 0.45 END AS DOUBLE) AS relevance FROM s""")
def h10(spark, sf_dir):
    """H10."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), "s_name")
    names = sectors(spark, sf_dir).join(s, "symbol").select("symbol", F.lit("ti").alias("ticker"), F.concat(F.lower("s_name"), F.lit(" the "), F.lower("sector")).alias("name"))
    return text.relevance(articles(spark, sf_dir), names).select("id", "relevance")


_KNOWN = ("n", "w", "s", "m", "q", "o", "c", "r", "rw", "rs", "e", "ew", "es", "f", "fw", "fs")


def _known(partition: str, names: tuple[str, ...], days: int, prefix: str = "") -> str:
    return ", ".join(f"coalesce(sum({k}) OVER ({partition} ORDER BY d RANGE BETWEEN {days - 1} PRECEDING AND CURRENT ROW), 0) AS {prefix}{k}{days}" for k in names)


@query("h16_evidence_features", f"""WITH {BARS_SQL}, {TEXT_SQL}, {SECTORS_SQL}, w AS (SELECT i.*, sector, available - DATE '1970-01-01' AS dn, greatest(0.01, quality * materiality * 0.5) AS wt FROM items i JOIN sectors USING (symbol)),
 day AS (SELECT symbol, sector, dn AS d, count(*) AS n, sum(wt) AS w, sum(wt * signed) AS s, sum(wt * materiality) AS m, sum(wt * quality) AS q, count(*) FILTER (source_class = 'OFFICIAL') AS o, count(*) FILTER (source_class = 'CLARIFICATION') AS c, count(*) FILTER (source_class = 'RUMOR_UNVERIFIED') AS r, sum(wt) FILTER (source_class = 'RUMOR_UNVERIFIED') AS rw, sum(wt * signed) FILTER (source_class = 'RUMOR_UNVERIFIED') AS rs,
   count(*) FILTER (event = 'A') AS e, sum(wt) FILTER (event = 'A') AS ew, sum(wt * signed) FILTER (event = 'A') AS es, count(*) FILTER (event IN ('A', 'B')) AS f, sum(wt) FILTER (event IN ('A', 'B')) AS fw, sum(wt * signed) FILTER (event IN ('A', 'B')) AS fs FROM w GROUP BY 1, 2, 3),
 link AS (SELECT DISTINCT symbol, sector FROM w), ask AS (SELECT b.symbol, sector, date, date - DATE '1970-01-01' AS d FROM bars b LEFT JOIN link USING (symbol)),
 own AS (SELECT symbol, d, {_known('PARTITION BY symbol', ('n', 'r'), 5)}, {_known('PARTITION BY symbol', _KNOWN, 20)} FROM (SELECT DISTINCT symbol, d FROM ask) a0 FULL JOIN day USING (symbol, d)),
 sec AS (SELECT sector, d, {_known('PARTITION BY sector', ('n', 'w', 's'), 20, 'x')} FROM (SELECT DISTINCT sector, d FROM ask WHERE sector IS NOT NULL) FULL JOIN (SELECT sector, d, sum(n) AS n, sum(w) AS w, sum(s) AS s FROM day GROUP BY 1, 2) USING (sector, d)),
 mkt AS (SELECT d, {_known('', ('w', 's'), 20, 'y')} FROM (SELECT DISTINCT d FROM ask) FULL JOIN (SELECT d, sum(w) AS w, sum(s) AS s FROM day GROUP BY 1) USING (d))
 SELECT a.symbol, a.date, CAST(n5 AS DOUBLE) AS news_n5, CAST(n20 AS DOUBLE) AS news_n20, round(coalesce(s20 / nullif(w20, 0), 0), 5) AS news_sent20, round(coalesce(m20 / nullif(w20, 0), 0), 5) AS news_materiality20, round(coalesce(q20 / nullif(w20, 0), 0), 5) AS news_quality20, round(coalesce(o20 / nullif(n20, 0), 0), 5) AS official_share20, CAST(c20 AS DOUBLE) AS clarification_n20,
   round(n20 / (n20 + 5.0) * coalesce(s20 / nullif(w20, 0), 0) + (1 - n20 / (n20 + 5.0)) * (coalesce(xn20, 0) / (coalesce(xn20, 0) + 30.0) * coalesce(xs20 / nullif(xw20, 0), 0) + (1 - coalesce(xn20, 0) / (coalesce(xn20, 0) + 30.0)) * coalesce(ys20 / nullif(yw20, 0), 0)), 5) AS hier_sent20,
   CAST(r5 AS DOUBLE) AS rumour_n5, CAST(r20 AS DOUBLE) AS rumour_n20, round(coalesce(rs20 / nullif(rw20, 0), 0), 5) AS rumour_sent20, round(r5 / greatest(1, r20 / 4.0), 5) AS rumour_velocity, CAST(e20 AS DOUBLE) AS earnings_n20, round(coalesce(es20 / nullif(ew20, 0), 0), 5) AS earnings_sent20, CAST(f20 AS DOUBLE) AS fundamental_n20, round(coalesce(fs20 / nullif(fw20, 0), 0), 5) AS fundamental_sent20
 FROM ask a LEFT JOIN own USING (symbol, d) LEFT JOIN sec ON sec.sector = a.sector AND sec.d = a.d LEFT JOIN mkt ON mkt.d = a.d""")
def h16(spark, sf_dir):
    """H16, G10."""
    it = items(spark, sf_dir).join(sectors(spark, sf_dir).select("symbol", "sector"), "symbol").withColumns({"confidence": F.lit(0.5), "novelty": F.lit(1.0)})
    return rounded(text.evidence_features(bars(spark, sf_dir).select("symbol", "date"), it, "A", ("A", "B")).drop("news_novelty20"), 5)


_STOP = "[" + ", ".join(f"'{w}'" for w in ("công", "ty", "ctcp", "và", "của", "cho", "với", "một", "các", "được", "theo", "trong", "trên", "sẽ", "đã", "tại")) + "]"
_CLAIM_WORDS = f"list_filter(list_distinct(string_split(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9à-ỹ]+', ' ', 'g'), ' ')), lambda w: len(w) >= 3 AND NOT list_contains({_STOP}, w))"
_SIMILAR = "len(list_intersect(c.words, n.t)) / greatest(1, len(list_distinct(list_concat(c.words, n.t))))"
_TOLD = "CASE id % 7 WHEN 0 THEN title || ' bác bỏ' WHEN 1 THEN title || ' Xác Nhận' ELSE title END"
CLAIMS_SQL = f"""{TEXT_SQL}, told AS (SELECT * REPLACE (CASE WHEN publisher IN ('src0', 'src1') THEN {_TOLD} ELSE title END AS title) FROM items), ru AS (SELECT symbol, id, available, event, {_CLAIM_WORDS} AS t, row_number() OVER (PARTITION BY symbol ORDER BY available, published_at, id) AS k FROM told WHERE publisher IN ('src3', 'src4', 'src5')),
 walk(symbol, k, id, claim, claims) AS (SELECT symbol, k, id, id, [{{'id': id, 'last': available, 'event': event, 'words': t}}] FROM ru WHERE k = 1 UNION ALL
  SELECT symbol, k, id, CASE WHEN pick > 0 THEN reach[pick].id ELSE id END, CASE WHEN pick > 0 THEN list_concat(reach[:pick - 1], [{{'id': reach[pick].id, 'last': greatest(reach[pick].last, available), 'event': reach[pick].event, 'words': list_distinct(list_concat(reach[pick].words, t))}}], reach[pick + 1:]) ELSE list_append(reach, {{'id': id, 'last': available, 'event': event, 'words': t}}) END
  FROM (SELECT *, CASE WHEN list_max(sims) > 0 THEN list_max(list_filter(range(1, len(sims) + 1), lambda i: sims[i] = list_max(sims))) ELSE 0 END AS pick
   FROM (SELECT *, list_transform(reach, lambda c: CASE WHEN len(list_intersect(c.words, t)) / greatest(1, len(list_distinct(list_concat(c.words, t)))) >= CASE WHEN c.event = event THEN 0.28 ELSE 0.5 END THEN len(list_intersect(c.words, t)) / greatest(1, len(list_distinct(list_concat(c.words, t)))) ELSE 0 END) AS sims
    FROM (SELECT n.*, w.claims[coalesce(list_max(list_filter(range(1, len(w.claims) + 1), lambda i: n.available - w.claims[i].last > 30)), 0) + 1:] AS reach FROM walk w JOIN ru n ON n.symbol = w.symbol AND n.k = w.k + 1)))),
 cl AS (SELECT r.symbol, r.id, r.available, r.event, r.t, w.claim FROM ru r JOIN walk w USING (symbol, k)), st AS (SELECT claim, min(symbol) AS symbol, min(available) AS start FROM cl GROUP BY 1),
 off AS (SELECT symbol, id AS official_id, available AS told_on, published_at, event, title, {_CLAIM_WORDS} AS ot FROM told WHERE publisher IN ('src0', 'src1')),
 pr AS (SELECT st.claim, o.official_id, o.told_on, o.published_at, o.title, o.ot, list_distinct(flatten(list(c.t))) AS kt, bool_or(c.event = o.event) AS same FROM st JOIN off o ON o.symbol = st.symbol AND o.told_on >= st.start AND o.told_on - st.start <= 90 JOIN cl c ON c.claim = st.claim AND c.available <= o.told_on GROUP BY ALL),
 sm AS (SELECT *, len(list_intersect(kt, ot)) / nullif(len(list_distinct(list_concat(kt, ot))), 0) AS s FROM pr),
 solved AS (SELECT claim, official_id, s, CASE WHEN regexp_matches(lower(title), 'bác bỏ|bac bo|phủ nhận|phu nhan|đính chính|dinh chinh|không đúng|khong dung|tin đồn sai|tin don sai|sai sự thật|sai su that') THEN 'DENIED' WHEN regexp_matches(lower(title), 'xác nhận|xac nhan|đã ký|da ky|ký kết|ky ket|phê duyệt|phe duyet|thông qua|thong qua|chấp thuận|chap thuan|hoàn tất|hoan tat') THEN 'CONFIRMED' ELSE 'CLARIFIED' END AS truth
  FROM sm WHERE s >= CASE WHEN same THEN 0.24 ELSE 0.45 END QUALIFY row_number() OVER (PARTITION BY claim ORDER BY told_on, published_at, official_id) = 1)"""


@query("h17_rumours", f"WITH RECURSIVE {CLAIMS_SQL} SELECT symbol, id, claim, official_id, round(s, 9) AS similarity, truth FROM cl LEFT JOIN solved USING (claim)")
def h17(spark, sf_dir):
    """Articles of some publishers as rumours, of others as official items, of which some deny and some confirm."""
    k, told = F.col("id") % 7, F.col("title")
    it = items(spark, sf_dir).withColumn("title", F.when(F.col("publisher").isin("src0", "src1"), F.when(k == 0, F.concat(told, F.lit(" bác bỏ"))).when(k == 1, F.concat(told, F.lit(" Xác Nhận"))).otherwise(told)).otherwise(told))
    rumours = it.filter("publisher in ('src3', 'src4', 'src5')")
    claims = text.rumour_claims(rumours)
    solved = text.claim_resolution(claims.join(rumours.select("id", "title"), "id"), it.filter("publisher in ('src0', 'src1')"))
    return claims.join(solved, "claim", "left").select("symbol", "id", "claim", "official_id", F.round("similarity", 9).alias("similarity"), "truth")


@query("h08_kept_titles")
def h08k(spark, sf_dir):
    """H8 over the last 60 kept titles of each symbol; matching blocks are beyond SQL."""
    return text.kept_titles(articles(spark, sf_dir), last=60)


_FOLDED = _TOKENS[_TOKENS.index("translate(lower(title)") :].split("')", 1)[0] + "')"
_VOCABULARY = f"""{ARTICLES_SQL}, wd AS (SELECT id, list_filter(string_split(regexp_replace({_FOLDED}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: len(x) > 1) AS w FROM (SELECT id, coalesce(title, '') AS title FROM articles)),
 tm AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM wd), vc AS (SELECT term, count(DISTINCT id) AS titles, count(*) AS n FROM tm GROUP BY 1 HAVING count(DISTINCT id) >= 3 AND count(DISTINCT id) <= 0.93 * (SELECT count(*) FROM articles))"""


@query("h20_vocabulary", f"WITH {_VOCABULARY} SELECT term, titles, CAST(n AS BIGINT) AS n, row_number() OVER (ORDER BY n DESC, term) AS place FROM vc ORDER BY n DESC, term LIMIT 5000")
def h20v(spark, sf_dir):
    """H20's dictionary: the commonest words and pairs of titles, within bounds on the titles that have them."""
    v = text.headline_vocabulary(articles(spark, sf_dir))
    return v.select("term", "titles", "n", F.col("place").cast("long").alias("place"))


@query("h20_topics")
def h20t(spark, sf_dir):
    """The heaviest terms of each cluster of titles."""
    a = articles(spark, sf_dir)
    return text.headline_topics(a, text.headline_vocabulary(a, most=500), 8, top=5)[1].withColumn("weight", F.round("weight", 6))


@query("h20_clusters")
def h20(spark, sf_dir):
    """Clusters of titles, with a hashed-text model's mean probability of the POS label."""
    it = items(spark, sf_dir).withColumn("is_pos", (F.col("label") == "POS").cast("double"))
    c = text.headline_clusters(it.select("id", "title", "is_pos"), 8)
    m = text.hashed_text_model(it.select("id", "title", "is_pos"), "is_pos")
    from pyspark.ml.functions import vector_to_array

    p = m.transform(c.withColumn("w", text.tokens(F.coalesce("title", F.lit("")))))
    return p.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(vector_to_array("probability")[1]), 3).alias("p_pos"))


@query("h22_latest_evidence", f"WITH {TEXT_SQL} SELECT symbol, id, CAST(row_number() OVER (PARTITION BY symbol ORDER BY available DESC, id DESC) AS BIGINT) AS place FROM items WHERE available <= DATE '1999-06-30' QUALIFY place <= 12")
def h22(spark, sf_dir):
    """H22."""
    return text.latest_evidence(articles(spark, sf_dir), "1999-06-30").select("symbol", "id", F.col("place").cast("long").alias("place"))


# ---- flow --------------------------------------------------------------------------------------------------------


def _fr(n: int, back: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1 + back} PRECEDING AND {back} PRECEDING)"


@query("i01_flow_ratios", f"WITH {FLOWS_SQL}, f AS (SELECT symbol, date, abs(coalesce(foreign_buy, 0)) + abs(coalesce(foreign_sell, 0)) AS g, foreign_net AS n FROM flows WHERE foreign_net IS NOT NULL), x AS (SELECT *, count(n) OVER {_fr(120)} >= 40 AS ok, nullif(stddev_samp(n) OVER {_fr(60)}, 0) AS sd FROM f) SELECT symbol, date, " + ", ".join(f"round(CASE WHEN ok THEN sum(n) OVER {_fr(k)} / nullif(sum(g) OVER {_fr(k)}, 0) END, 5) AS foreign_ratio{k}" for k in (5, 20)) + f", round(CASE WHEN ok AND sd IS NOT NULL THEN least(greatest((n - avg(n) OVER {_fr(60)}) / sd, -8), 8) END, 4) AS foreign_z60 FROM x")
def i01(spark, sf_dir):
    """I1, I2."""
    r = flow.flow_ratios(flows(spark, sf_dir), "foreign")
    return r.select("symbol", "date", *[F.round(c, 5).alias(c) for c in ("foreign_ratio5", "foreign_ratio20")], F.round("foreign_z60", 4).alias("foreign_z60"))


@query("i03_flow_sessions", f"""WITH {BARS_SQL}, {FLOWS_SQL}, f AS (SELECT symbol, date, foreign_net / nullif(abs(coalesce(foreign_buy, 0)) + abs(coalesce(foreign_sell, 0)), 0) AS x FROM flows), j AS (SELECT b.symbol, b.date, x, row_number() OVER w AS i FROM bars b LEFT JOIN f USING (symbol, date) WINDOW w AS (PARTITION BY b.symbol ORDER BY b.date)),
 t AS (SELECT *, i - last(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS stale, avg(x) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) AS m5, count(x) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) AS c5, avg(x) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS m20, count(x) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS c20 FROM j)
 SELECT symbol, count(CASE WHEN stale <= 3 AND c5 >= 2 THEN m5 END) AS n, round(avg(CASE WHEN stale <= 3 AND c5 >= 2 THEN m5 END), 6) AS imb5, round(avg(CASE WHEN stale <= 3 AND c20 >= 5 THEN m20 END), 6) AS imb20 FROM t GROUP BY 1""")
def i03(spark, sf_dir):
    """Session-aligned imbalance."""
    s = flow.flow_session_features(bars(spark, sf_dir), flows(spark, sf_dir), "foreign")
    return s.groupBy("symbol").agg(F.count("foreign_imb5").alias("n"), F.round(F.avg("foreign_imb5"), 6).alias("imb5"), F.round(F.avg("foreign_imb20"), 6).alias("imb20"))


def _state_sql(x: str, weak: float, strong: float) -> str:
    return f"CASE WHEN {x} >= {strong} THEN 'STRONG_BUY' WHEN {x} >= {weak} THEN 'BUY' WHEN {x} <= -{strong} THEN 'STRONG_SELL' WHEN {x} <= -{weak} THEN 'SELL' WHEN {x} IS NOT NULL THEN 'NEUTRAL' END"


@query("i04_flow_states", f"WITH {FLOWS_SQL}, r AS (SELECT symbol, date, round(foreign_net / nullif(abs(coalesce(foreign_buy, 0)) + abs(coalesce(foreign_sell, 0)), 0), 6) AS r FROM flows), z AS (SELECT *, round((r - avg(r) OVER d) / nullif(stddev_samp(r) OVER d, 0), 6) AS z FROM r WINDOW d AS (PARTITION BY symbol)) SELECT symbol, date, {_state_sql('r', 0.03, 0.12)} AS ratio_state, {_state_sql('z', 0.2, 0.75)} AS z_state FROM z")
def i04(spark, sf_dir):
    """I4, both band sets."""
    r = flows(spark, sf_dir).withColumn("r", F.round(F.try_divide("foreign_net", F.nullif(F.abs(F.coalesce("foreign_buy", F.lit(0.0))) + F.abs(F.coalesce("foreign_sell", F.lit(0.0))), F.lit(0.0))), 6))
    own = Window.partitionBy("symbol")
    z = r.withColumn("z", F.round(F.try_divide(F.col("r") - F.avg("r").over(own), F.nullif(F.stddev_samp("r").over(own), F.lit(0.0))), 6))
    return z.select("symbol", "date", flow.ratio_state("r").alias("ratio_state"), flow.z_state("z").alias("z_state"))


@query("i05_recent_sums", f"WITH {FLOWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS r, abs(coalesce(prop_buy, 0)) + abs(coalesce(prop_sell, 0)) AS g FROM flows WHERE prop_net IS NOT NULL) SELECT symbol, round(sum(prop_net) FILTER (r <= 5) / 1000, 3) AS net5, round(sum(prop_net) FILTER (r <= 20) / nullif(sum(g) FILTER (r <= 20), 0), 5) AS ratio20 FROM r GROUP BY 1")
def i05(spark, sf_dir):
    """I5."""
    return flow.recent_sums(flows(spark, sf_dir), "prop", 0.001).select("symbol", F.round("net5", 3).alias("net5"), F.round("ratio20", 5).alias("ratio20"))


@query("i06_flow_coverage", f"WITH {FLOWS_SQL} SELECT date, count(*) FILTER (foreign_net IS NOT NULL) AS \"foreign\", count(*) FILTER (prop_net IS NOT NULL) AS prop, count(*) FILTER (foreign_net IS NOT NULL AND prop_net IS NOT NULL) AS both, count(*) AS symbols FROM flows GROUP BY 1")
def i06(spark, sf_dir):
    """I6."""
    return flow.flow_coverage(flows(spark, sf_dir))


_HOLD = "hold AS (SELECT l_orderkey % 7 AS fund, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS as_of, l_suppkey AS symbol, sum(l_quantity) / 10000 AS weight, avg(l_discount) AS nav_momentum20, avg(l_tax) AS nav_volatility20 FROM lineitem GROUP BY 1, 2, 3)"


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fund snapshots: orders by their key's remainder as funds, quarters as snapshots."""
    li = adapters.table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 7).alias("fund"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("as_of"), F.col("l_suppkey").alias("symbol")).agg((F.sum("l_quantity") / 10000).alias("weight"), F.avg("l_discount").alias("nav_momentum20"), F.avg("l_tax").alias("nav_volatility20"))


@query("i07_fund_features", f"WITH {_HOLD}, f AS (SELECT symbol, as_of, count(DISTINCT fund) AS holders, sum(weight) AS fund_weight, sum(nav_momentum20 * weight) / sum(weight) AS nav_momentum FROM hold GROUP BY 1, 2), d AS (SELECT as_of, row_number() OVER (ORDER BY as_of) AS snapshots FROM (SELECT DISTINCT as_of FROM hold)) SELECT symbol, as_of, holders, round(fund_weight, 8) AS fund_weight, round(nav_momentum, 8) AS nav_momentum, round(fund_weight - lag(fund_weight) OVER (PARTITION BY symbol ORDER BY as_of), 8) AS weight_change, snapshots FROM f JOIN d USING (as_of)")
def i07(spark, sf_dir):
    """I7, A7's rows."""
    return rounded(flow.fund_features(holdings(spark, sf_dir)).select("symbol", "as_of", "holders", "fund_weight", "nav_momentum", "weight_change", F.col("snapshots").cast("long").alias("snapshots")), 8)


@query("i09_fund_asof", f"WITH {BARS_SQL}, {_HOLD}, f AS (SELECT symbol, as_of, sum(weight) AS w FROM hold GROUP BY 1, 2), d AS (SELECT as_of, row_number() OVER (ORDER BY as_of) AS snapshots FROM (SELECT DISTINCT as_of FROM hold)) SELECT b.symbol, b.date, round(f.w, 6) AS fund_weight, b.date - f.as_of AS fund_age, coalesce(d.snapshots >= 4, false) AS fund_usable FROM (SELECT symbol, date FROM bars) b ASOF LEFT JOIN f ON f.symbol = b.symbol AND f.as_of <= b.date LEFT JOIN d ON d.as_of = f.as_of")
def i09(spark, sf_dir):
    """I7, I9."""
    p = flow.fund_asof(bars(spark, sf_dir).select("symbol", "date"), flow.fund_features(holdings(spark, sf_dir)))
    return p.select("symbol", "date", F.round("fund_weight", 6).alias("fund_weight"), F.col("fund_age").cast("long").alias("fund_age"), "fund_usable")


@query("i10_fundamentals", f"""WITH f AS (SELECT c_custkey AS id, c_acctbal / 300 AS roe, c_acctbal / 200 AS pe, abs(c_acctbal) / 800 AS de, c_acctbal / 20000 AS margin, (c_acctbal - 4000) / 9000 AS growth, c_custkey % 4 = 0 AS bank FROM customer),
 p AS (SELECT id, {held('(0.12 - CASE WHEN abs(roe) > 2 THEN roe / 100 ELSE roe END) / 0.18')} AS p1, CASE WHEN pe > 0 THEN {held('(pe - 18) / 30')} END AS p2, CASE WHEN NOT bank THEN {held('(CASE WHEN de > 10 THEN de / 100 ELSE de END - 0.7) / 2')} END AS p3, {held('(0.08 - CASE WHEN abs(margin) > 2 THEN margin / 100 ELSE margin END) / 0.15')} AS p4, {held('-CASE WHEN abs(growth) > 2 THEN growth / 100 ELSE growth END / 0.20')} AS p5 FROM f)
 SELECT id, round(100 * (coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0) + coalesce(p4, 0) + coalesce(p5, 0)) / (CAST(p1 IS NOT NULL AS INT) + CAST(p2 IS NOT NULL AS INT) + CAST(p3 IS NOT NULL AS INT) + CAST(p4 IS NOT NULL AS INT) + CAST(p5 IS NOT NULL AS INT)), 7) AS fundamental_pressure FROM p""")
def i10(spark, sf_dir):
    """I10 over ratios made of the customers' balances."""
    b = F.col("c_acctbal")
    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (b / 300).alias("roe"), (b / 200).alias("pe"), (F.abs(b) / 800).alias("debt_equity"), (b / 20000).alias("margin"), ((b - 4000) / 9000).alias("growth"), (F.col("c_custkey") % 4 == 0).alias("bank"))
    return rounded(flow.fundamental_pressure(f).select("id", "fundamental_pressure"), 7)


_ROLES = {"1-URGENT": "vix", "2-HIGH": "usd", "3-MEDIUM": "dxy", "4-NOT SPECIFIED": "us10y", "5-LOW": "brent"}


@query("i11_macro_pressure", f"""WITH {MACRO_SQL}, r AS (SELECT series, date, value / 8000 AS value, coalesce(value / lag(value, 20) OVER (PARTITION BY series ORDER BY date) - 1, 0) AS r FROM macro), l AS (SELECT series, arg_max(value, date) AS level, arg_max(r, date) AS ret20 FROM r GROUP BY 1),
 p AS (SELECT *, CASE series WHEN '1-URGENT' THEN {held('(level - 17) / 20')} WHEN '2-HIGH' THEN {held('ret20 / 0.025')} WHEN '3-MEDIUM' THEN {held('ret20 / 0.04')} WHEN '4-NOT SPECIFIED' THEN {held('ret20 / 0.08')} WHEN '5-LOW' THEN {held('abs(ret20) / 0.18')} END AS pressure FROM l) SELECT series, round(level, 4) AS level, round(ret20, 5) AS ret20, round(pressure, 5) AS pressure, round(100 * avg(pressure) OVER (), 3) AS macro_pressure FROM p""")
def i11(spark, sf_dir):
    """I11."""
    m = macro(spark, sf_dir).withColumn("value", F.col("value") / 8000)
    return flow.macro_pressure(m, _ROLES).select("series", F.round("level", 4).alias("level"), F.round("ret20", 5).alias("ret20"), F.round("pressure", 5).alias("pressure"), F.round("macro_pressure", 3).alias("macro_pressure"))


# ---- risk --------------------------------------------------------------------------------------------------------


@query("j01_index_bands", f"WITH {SCORED_SQL} SELECT symbol, date, CASE WHEN round(index_score, 4) >= 75 THEN 'CRITICAL' WHEN round(index_score, 4) >= 55 THEN 'HIGH' WHEN round(index_score, 4) >= 32 THEN 'WATCH' WHEN index_score IS NOT NULL THEN 'LOW' END AS state FROM scored")
def j01(spark, sf_dir):
    """J1, J5."""
    return scored(spark, sf_dir).withColumn("s", F.round("index_score", 4)).select("symbol", "date", risk.state_band("s", *risk.INDEX_BANDS).alias("state"))


_SCAN_RETURNS = ("ret1", "ret5", "ret20", "sret1", "sret20")


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with the screener's score, flags and states; the market's month is the date's median.

    Medians are taken aside and broadcast, a row a date, so the panel keeps its place by symbol.
    Its frames are made in one pass, after the exponential means, whose sort they share.
    """
    months = features.returns(bars(spark, sf_dir), (), (20,)).filter("sret20 is not null").groupBy("date").agg(F.median("sret20").alias("market20"))
    df = features.framed(features.macd(features.frame_inputs(features.returns(bars(spark, sf_dir)))), features.SCAN_FRAMES, ["open", "high", "low", "close", "volume", *_SCAN_RETURNS, "macd_gap", "macd_hist"])
    rest = features.returns(df, (2, 3, 10, 60), (5,))  # windows, for those who take them
    p = features.unframed(risk.screener_inputs(featured(rest))).join(F.broadcast(months), "date", "left").sortWithinPartitions("symbol", "date")
    s = risk.stress_flags(risk.screener_score(risk.technical_score(risk.index_pressures(p))))
    s = s.withColumn("status", risk.scan_status(liquid=F.col("turnover30") >= LIQUID))
    return s.withColumn("prev_status", F.lag("status").over(Window.partitionBy("symbol").orderBy("date")))


#: The star schema's prices are not the policy's currency: turnover from which a symbol counts as liquid here.
LIQUID = 1000.0
#: The scan in SQL, with the policy's numbers written out.
SCAN_SQL = f"""{PANEL_SQL}, e1 AS (SELECT *, row_number() OVER ({W}) - 1 AS i FROM panel), e2 AS (SELECT *, {_ema_sql('close', 2 / 13)} - ({_ema_sql('close', 2 / 27)}) AS macd FROM e1), e3 AS (SELECT *, {_ema_sql('macd', 0.2)} AS macd_signal FROM e2),
 sc1 AS (SELECT *, (macd - macd_signal) / close AS macd_gap, 100 * vol20 / sqrt(252) AS vol_day, volume / avg(volume) OVER {frame(10)} AS volume_ratio10, close * avg(volume) OVER {frame(30)} AS turnover30, median(sret20) OVER (PARTITION BY date) AS market20 FROM e3),
 sc2 AS (SELECT *, sret20 - market20 AS relative20, {held('-dd60 / 0.22')} AS a1, {held('-sret20 / 0.14')} AS a2, {held('-gap50 / 0.12')} AS a3, {held('-gap200 / 0.18')} AS a4, {held('(vol_pct - 0.45) / 0.55')} AS a5, {held('(45 - rsi_simple) / 20')} AS a6, {held('-macd_gap / 0.025')} AS a7,
   coalesce({held('volume_z_prior / 3')} * {held('-ret1 / 0.05')}, 0) AS a8, {held('(coalesce(vol_day, 0) - 1.8) / 5')} AS b5, {held('-coalesce(macd_gap, 0) / 0.025')} AS b7, coalesce({held('(coalesce(volume_ratio10, 0) - 1) / 2')} * {held('-sret1 / 0.05')}, 0) AS b8, {held('-(sret20 - market20) / 0.15')} AS b9 FROM sc1),
 sc3 AS (SELECT *, {' + '.join(f'CASE WHEN a{i} IS NULL THEN 0 ELSE {w} END' for i, w in enumerate((0.18, 0.16, 0.14, 0.10, 0.16, 0.10, 0.08, 0.08), 1))} AS tw, {' + '.join(f'coalesce({w} * a{i}, 0)' for i, w in enumerate((0.18, 0.16, 0.14, 0.10, 0.16, 0.10, 0.08, 0.08), 1))} AS ts FROM sc2),
 sc4 AS (SELECT *, 100 * ts / tw AS technical_score, tw AS technical_confidence, CASE WHEN gap50 IS NOT NULL AND gap200 IS NOT NULL AND sret20 IS NOT NULL THEN 100 * (0.18 * a1 + 0.16 * a2 + 0.14 * a3 + 0.10 * a4 + 0.12 * b5 + 0.10 * a6 + 0.08 * b7 + 0.06 * b8 + coalesce(0.06 * b9, 0)) / CASE WHEN b9 IS NULL THEN 0.94 ELSE 1 END END AS screener_score,
   {' + '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END' for c in ('dd60 <= -0.18', 'sret20 <= -0.10', 'gap50 <= -0.10', 'gap200 <= -0.15', 'rsi_simple <= 35', 'macd_gap <= -0.008', 'vol_day >= 4', 'sret1 <= -0.04 AND volume_ratio10 >= 1.5', 'relative20 <= -0.12'))} AS flags, coalesce(sret20 < 0, false) OR coalesce(gap50 < 0, false) AS weak FROM sc3),
 sc5 AS (SELECT *, CASE WHEN screener_score IS NULL THEN NULL WHEN NOT coalesce(turnover30 >= 1000, false) THEN 'ILLIQUID' WHEN screener_score >= 78 AND weak AND flags >= 3 THEN 'RED' WHEN screener_score >= 65 AND weak AND flags >= 2 THEN 'YELLOW' WHEN screener_score >= 50 AND weak AND flags >= 1 THEN 'WATCH' ELSE 'GREEN' END AS status FROM sc4),
 scan AS (SELECT *, lag(status) OVER ({W}) AS prev_status FROM sc5)"""


@query("j02_scores", f"WITH {SCAN_SQL} SELECT symbol, date, round(technical_score, 4) AS technical_score, round(screener_score, 4) AS screener_score, CAST(flags AS BIGINT) AS flags FROM scan")
def j02(spark, sf_dir):
    """J2, J3, J4."""
    return _scan(spark, sf_dir).select("symbol", "date", F.round("technical_score", 4).alias("technical_score"), F.round("screener_score", 4).alias("screener_score"), F.col("flags").cast("long").alias("flags"))


@query("j03_market_scan", f"""WITH {SCAN_SQL}, r AS (SELECT *, CASE status WHEN 'RED' THEN 3 WHEN 'YELLOW' THEN 2 WHEN 'WATCH' THEN 1 WHEN 'GREEN' THEN 0 END AS now, CASE prev_status WHEN 'RED' THEN 3 WHEN 'YELLOW' THEN 2 WHEN 'WATCH' THEN 1 WHEN 'GREEN' THEN 0 END AS was FROM scan),
 p AS (SELECT *, status IN ('YELLOW', 'RED') AND now > was AS rose, CASE WHEN round(technical_score, 9) >= 78 AND weak AND round(technical_confidence, 9) >= 0.7 THEN 'PRE_CRASH_RED' WHEN round(technical_score, 9) >= 65 AND weak AND round(technical_confidence, 9) >= 0.55 THEN 'PRE_CRASH_YELLOW' WHEN round(technical_score, 9) >= 50 AND weak THEN 'WATCH' WHEN dd60 <= -0.15 THEN 'ACTIVE_DRAWDOWN' WHEN technical_score IS NOT NULL THEN 'NORMAL' END AS phase FROM r)
 SELECT date, count(*) AS n, count(*) FILTER (status = 'RED') AS red, count(*) FILTER (status = 'YELLOW') AS yellow, count(*) FILTER (status = 'WATCH') AS watch, round(avg(CAST(status = 'RED' AS INT)), 6) AS red_share, round(avg(CAST(status = 'YELLOW' AS INT)), 6) AS yellow_share, round(avg(CAST(status = 'WATCH' AS INT)), 6) AS watch_share,
   count(*) FILTER (rose) AS escalations, count(*) FILTER (prev_status <> status) AS changes, count(*) FILTER (phase = 'PRE_CRASH_RED') AS pre_red, count(*) FILTER (phase = 'PRE_CRASH_YELLOW') AS pre_yellow, count(*) FILTER (phase = 'ACTIVE_DRAWDOWN') AS active FROM p WHERE status <> 'ILLIQUID' GROUP BY 1""")
def j03(spark, sf_dir):
    """The scan's states by date. Phases take scores to nine digits, as sums of doubles reach a limit or just miss it."""
    s = risk.transition(_scan(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("technical_score", "technical_score_confidence")}).withColumn("phase", risk.phase("technical_score", "technical_score_confidence"))
    more = s.filter("status <> 'ILLIQUID'").groupBy("date").agg(F.count_if("escalated").alias("escalations"), F.count_if(F.col("transition").contains(" -> ")).alias("changes"), F.count_if(F.col("phase") == "PRE_CRASH_RED").alias("pre_red"), F.count_if(F.col("phase") == "PRE_CRASH_YELLOW").alias("pre_yellow"), F.count_if(F.col("phase") == "ACTIVE_DRAWDOWN").alias("active"))
    return rounded(risk.breadth_report(s).join(more, "date"), 6)


@query("j07_modules", f"""WITH {SCAN_SQL}, m AS (SELECT symbol, date, technical_score AS t, CASE WHEN i % 2 = 0 THEN rsi_simple END AS a, 100 * vol_pct AS k, CASE WHEN i % 3 = 0 THEN 50.0 END AS c FROM scan)
 SELECT symbol, date, round((coalesce(0.30 * t, 0) + coalesce(0.25 * a, 0) + coalesce(0.10 * k, 0) + coalesce(0.10 * c, 0)) / nullif(w, 0), 4) AS stock, round((coalesce(0.30 * t, 0) + coalesce(0.25 * a, 0) + coalesce(0.15 * k, 0) + coalesce(0.10 * c, 0)) / nullif(v, 0), 4) AS radar, round(CAST(w AS DOUBLE), 4) AS stock_confidence, round(CAST(v AS DOUBLE), 4) AS radar_confidence
 FROM (SELECT *, CASE WHEN t IS NULL THEN 0 ELSE 0.30 END + CASE WHEN a IS NULL THEN 0 ELSE 0.25 END + CASE WHEN k IS NULL THEN 0 ELSE 0.10 END + CASE WHEN c IS NULL THEN 0 ELSE 0.10 END AS w, CASE WHEN t IS NULL THEN 0 ELSE 0.30 END + CASE WHEN a IS NULL THEN 0 ELSE 0.25 END + CASE WHEN k IS NULL THEN 0 ELSE 0.15 END + CASE WHEN c IS NULL THEN 0 ELSE 0.10 END AS v FROM m)""")
def j07(spark, sf_dir):
    """J7 with both weight sets; modules that a row lacks abstain."""
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("date")) - 1
    none = F.lit(None).cast("double")
    m = _scan(spark, sf_dir).select("symbol", "date", F.col("technical_score").alias("technical"), F.when(i % 2 == 0, F.col("rsi_simple")).alias("analog"), (100 * F.col("vol_pct")).alias("market"), F.when(i % 3 == 0, 50.0).alias("macro"), none.alias("sentiment"), none.alias("fundamental"))
    m = risk.module_aggregate(m).withColumnsRenamed({"module_score": "stock", "module_score_confidence": "stock_confidence"})
    m = risk.module_aggregate(m, risk.RADAR_MODULES).withColumnsRenamed({"module_score": "radar", "module_score_confidence": "radar_confidence"})
    return rounded(m.select("symbol", "date", "stock", "radar", "stock_confidence", "radar_confidence"))


_INDEX = (("p_volatility", 25), ("p_drawdown", 20), ("p_momentum", 15), ("p_trend", 15), ("p_shock", 15), ("p_volume", 10))


def _shocked(down: float, vol: float, z: float) -> str:
    moved = {"p_shock": f"greatest(p_shock, {down} / 0.08)", "p_volatility": f"p_volatility + ({vol} - 1) * 0.35", "p_momentum": f"p_momentum + {down} / 0.12 * 0.45", "p_drawdown": f"p_drawdown + {down} / 0.18 * 0.60", "p_trend": f"p_trend + {down} / 0.10 * 0.35", "p_volume": f"greatest(p_volume, {z} / 3 * least({down} / 0.04, 1))"}
    have = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {w} END" for k, w in _INDEX)
    return f"100 * ({' + '.join(f'coalesce({w} * ({held(moved[k])}), 0)' for k, w in _INDEX)}) / ({have})"


@query("j08_drivers_alerts", f"""WITH {SCORED_SQL}, l AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
 d AS (SELECT symbol, string_agg(k, ',' ORDER BY c DESC, k) FILTER (r <= 4) AS drivers, string_agg(k, ' and ' ORDER BY c DESC, k) FILTER (r <= 2) AS two FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY c DESC, k) AS r FROM (
   {' UNION ALL '.join(f"SELECT symbol, '{k}' AS k, coalesce({w} * {k} / 100.0, 0) AS c FROM l" for k, w in _INDEX)}) WHERE c >= 0.012) GROUP BY 1),
 a AS (SELECT symbol, string_agg(k || ':' || s, ',' ORDER BY place) AS alerts FROM (SELECT symbol, place, k, CASE WHEN p >= 0.75 THEN 'HIGH' ELSE 'WATCH' END AS s FROM ({' UNION ALL '.join(f"SELECT symbol, {i} AS place, '{k}' AS k, {k} AS p FROM l" for i, (k, _) in enumerate(_INDEX))}) WHERE p >= 0.45) GROUP BY 1),
 x AS (SELECT symbol, greatest({_shocked(0.03, 1.5, 1)}, {_shocked(0.08, 2.5, 3)}) AS worst FROM l)
 SELECT l.symbol, coalesce(d.drivers, '') AS drivers, CASE WHEN index_score >= 75 THEN 'CRITICAL' WHEN index_score >= 55 THEN 'HIGH' WHEN index_score >= 32 THEN 'WATCH' ELSE 'LOW' END AS state, 'Risk is ' || CASE WHEN index_score >= 75 THEN 'critical' WHEN index_score >= 55 THEN 'high' WHEN index_score >= 32 THEN 'watch' ELSE 'low' END || ', led by ' || coalesce(two, '') AS narrative, coalesce(a.alerts, 'normal:LOW') AS alerts, round(worst, 3) AS worst_scenario,
   CASE WHEN worst >= 75 THEN 'CRITICAL' WHEN worst >= 55 THEN 'HIGH' WHEN worst >= 32 THEN 'WATCH' ELSE 'LOW' END AS worst_state FROM l LEFT JOIN d USING (symbol) LEFT JOIN a USING (symbol) JOIN x USING (symbol)""")
def j08(spark, sf_dir):
    """The latest row's drivers, alerts, text, and its score after a shock. The rows, one a symbol, are written once for the three."""
    last = written(studies.tail_rows(scored(spark, sf_dir)).select("symbol", "date", "index_score", *risk.INDEX_WEIGHTS))
    last = risk.narrative(risk.drivers(last, {k: v / 100 for k, v in risk.INDEX_WEIGHTS.items()}).withColumn("state", risk.state_band("index_score", *risk.INDEX_BANDS)), "index_score", "state")
    a = risk.alerts(last).groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "alert", "severity"))), lambda x: F.concat_ws(":", x["alert"], x["severity"])), ",").alias("alerts"))
    shock = risk.scenarios(last.select("symbol", *risk.INDEX_WEIGHTS), {"mild": (-0.03, 1.5, 1.0), "severe": (-0.08, 2.5, 3.0)}).groupBy("symbol").agg(F.max("scenario_score").alias("worst_scenario"), F.max_by("scenario_state", "scenario_score").alias("worst_state"))
    short = F.regexp_replace("narrative", r" at \d+/100, led by (.*)\.$", ", led by $1")
    return rounded(last.select("symbol", F.concat_ws(",", "drivers").alias("drivers"), "state", short.alias("narrative")).join(a, "symbol").join(shock, "symbol"), 3)


@query("j14_crash", f"WITH {PANEL_SQL}, i AS (SELECT symbol, ret5 AS r, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1 AS i FROM panel), f AS (SELECT * FROM i WHERE i % 5 = 0 AND r IS NOT NULL) SELECT symbol, round(max(r) FILTER (i = 0), 4) AS latest, round(avg(r) FILTER (i > 0), 4) AS mean, round(stddev_samp(r) FILTER (i > 0), 4) AS sd, count(r) FILTER (i > 0) AS n FROM f GROUP BY 1")
def j14(spark, sf_dir):
    """J14."""
    return rounded(risk.crash_diagnostic(bars(spark, sf_dir)).select("symbol", "latest", "mean", "sd", "n"))


@query("j16_market_residual")
def j16(spark, sf_dir):
    """Weekly returns against the market's at five lags; weeks of crash."""
    w = Window.partitionBy("symbol").orderBy("week")
    r = features.weekly(bars(spark, sf_dir)).withColumn("r", F.log(F.try_divide("close", F.lag("close").over(w)))).filter("r is not null")
    m = r.groupBy("week").agg(F.median("r").alias("m"))
    s = risk.crash_flags(risk.market_residual(r.join(m, "week").select("symbol", "week", "r", "m")), "specific")
    return rounded(s.groupBy("symbol").agg(F.count(F.lit(1)).alias("weeks"), F.count_if("crash").alias("crashes"), F.avg("specific").alias("mean_specific")))


@query("j20_strategy", f"""WITH {SCAN_SQL}, b AS (SELECT *, avg(close) OVER {frame(20)} AS sma20, avg(close) OVER {frame(50)} AS sma50, CASE WHEN count(close) OVER {frame(20)} >= 20 THEN avg(close) OVER {frame(20)} - 2 * stddev_pop(close) OVER {frame(20)} END AS boll_down, max(close) OVER {frame(20, -1)} AS prior_high, min(close) OVER {frame(20, -1)} AS prior_low FROM scan),
 s AS (SELECT *, {' + '.join(f'CASE WHEN {c} THEN {n} ELSE 0 END' for c, n in (('gap20 > 0', 2), ('sma20 > sma50', 2), ('rsi_simple BETWEEN 50 AND 70', 1), ('macd > macd_signal', 1)))} AS pt, {' + '.join(f'CASE WHEN {c} THEN {n} ELSE 0 END' for c, n in (('rsi_simple < 35', 3), ('close < boll_down * 1.01', 2), ('gap20 < 0', 1)))} AS pr, {' + '.join(f'CASE WHEN {c} THEN {n} ELSE 0 END' for c, n in (('close > prior_high', 3), ('macd > macd_signal', 1), ('rsi_simple > 55', 1), ('close < prior_low', -1)))} AS pb,
   coalesce(CASE status WHEN 'RED' THEN 3 WHEN 'YELLOW' THEN 2 END > CASE prev_status WHEN 'RED' THEN 3 WHEN 'YELLOW' THEN 2 WHEN 'WATCH' THEN 1 WHEN 'GREEN' THEN 0 END, false) AS onset, {held('(vol_pct_incl - 0.45) / 0.55')} AS q1, {held('-dd60 / 0.18')} AS q2, {held('-sret20 / 0.12')} AS q3, coalesce({held('-shock_z / 3.09')}, 0) AS q4 FROM b),
 l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
 SELECT symbol, CASE WHEN greatest(pt, pr, pb) < 3 THEN 'NONE' WHEN pt = greatest(pt, pr, pb) THEN 'TREND' WHEN pr = greatest(pt, pr, pb) THEN 'REVERSION' ELSE 'BREAKOUT' END AS strategy, onset, round(100 * (0.35 * q1 + 0.25 * q2 + 0.20 * q3 + 0.20 * q4), 3) AS proxy_score,
   CASE WHEN 100 * (0.35 * q1 + 0.25 * q2 + 0.20 * q3 + 0.20 * q4) >= 65 THEN 'HIGH' WHEN 100 * (0.35 * q1 + 0.25 * q2 + 0.20 * q3 + 0.20 * q4) >= 35 THEN 'WATCH' ELSE 'LOW' END AS proxy_band,
   CASE WHEN screener_score >= 65 AND 100 * vol_pct >= 75 THEN 'CONVERGENT' WHEN screener_score >= 65 AND 100 * vol_pct < 60 THEN 'DIVERGENT' WHEN screener_score < 65 AND 100 * vol_pct >= 85 THEN 'POOLED_ELEVATION' WHEN screener_score IS NOT NULL AND vol_pct IS NOT NULL THEN 'MIXED' END AS agreement FROM l""")
def j20(spark, sf_dir):
    """Readouts of the latest rows."""
    p = features.prior_range(features.bands(_scan(spark, sf_dir)), 20)
    p = p.withColumns({f"sma{n}": F.avg("close").over(trailing(n)) for n in (20, 50)})
    last = studies.tail_rows(risk.proxy_score(risk.alert_rises(risk.strategy_readout(p))))
    return rounded(last.withColumn("agreement", risk.agreement("screener_score", "vol_pct")).select("symbol", "strategy", "onset", "proxy_score", "proxy_band", "agreement"), 3)


@query("j21_watch_rank", f"""WITH {SCAN_SQL}, b AS (SELECT symbol, date, round(ret5, 6) AS alpha, vol_pct AS up_rate, round(ret20, 6) AS median, screener_score AS risk, coalesce(status, 'GREEN') AS status, turnover30 * 1000000 AS t FROM scan), q AS (SELECT date, quantile_cont(alpha, 0.1) AS lo, quantile_cont(alpha, 0.9) AS hi FROM b GROUP BY 1),
 s AS (SELECT b.*, CASE WHEN hi > lo THEN (coalesce(alpha, 0) - lo) / (hi - lo) ELSE 0.5 END AS place, CASE WHEN coalesce(t, 0) < 500000000 AND status IN ('YELLOW', 'RED') THEN 'ILLIQUID' ELSE status END AS st FROM b JOIN q USING (date))
 SELECT symbol, date, round(100 * (0.42 * least(greatest(place, 0), 1) + 0.28 * least(greatest((coalesce(up_rate, 0.5) - 0.35) / 0.3, 0), 1) + 0.18 * least(greatest((coalesce(median, 0) + 0.02) / 0.04, 0), 1) + 0.12 * (1 - least(1, coalesce(risk, 50) / 100))), 3) AS watch_rank, CASE WHEN st IN ('YELLOW', 'RED', 'ILLIQUID') THEN st WHEN t >= 500000000 THEN 'WATCH' ELSE 'NONE' END AS list FROM s""")
def j21(spark, sf_dir):
    """J21."""
    x = _scan(spark, sf_dir).select("symbol", "date", F.round("ret5", 6).alias("alpha"), F.col("vol_pct").alias("up_rate"), F.round("ret20", 6).alias("median"), F.col("screener_score").alias("risk"), "status", (F.col("turnover30") * 1000000).alias("turnover30"))
    return rounded(risk.watch_rank(x).select("symbol", "date", "watch_rank", "list"), 3)


@query("j18_stance", f"""WITH {SCAN_SQL}, x AS (SELECT symbol, date, ret5 / 50 AS e, screener_score AS r, i % 4 AS p FROM scan)
 SELECT symbol, date, CASE WHEN p = 0 THEN 'HOLD / NO ACTION' WHEN coalesce(r, 50) >= 78 THEN 'REDUCE / AVOID NEW RISK' WHEN e >= 0.012 AND coalesce(r, 50) < 65 THEN 'ACCUMULATE' WHEN e >= 0.004 THEN 'HOLD / POSITIVE BIAS' WHEN e <= -0.012 THEN 'REDUCE' WHEN e <= -0.004 THEN 'CAUTION / REDUCE RISK' ELSE 'HOLD' END AS recommendation FROM x""")
def j18(spark, sf_dir):
    """J18."""
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("date")) - 1
    x = _scan(spark, sf_dir).select("symbol", "date", (F.col("ret5") / 50).alias("expected"), F.col("screener_score").alias("risk"), (i % 4).alias("passed"))
    return risk.recommendation(x).select("symbol", "date", "recommendation")


@query("j19_evidence", """WITH d AS (SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, avg(n_chars) AS c FROM documents GROUP BY 1), e AS (SELECT *, n % 30 AS events, 0.1 + (n % 7) / 10.0 AS pr, 0.3 AS base, (n % 5) / 10.0 - 0.1 AS brier FROM d),
 s AS (SELECT source, events, pr, base, 100 * (0.38 * (0.45 * least(greatest((pr - base) / greatest(0.05, 1 - base), 0), 1) + 0.30 * least(greatest(brier, 0), 1) + 0.25 * least(events / 20, 1)) + 0.22 * (0.55 * least(c / 1400, 1) + 0.45 * least(n / 160, 1)) + 0.14 * CASE WHEN langs > 1 THEN 1 ELSE 0 END + 0.13 * (0.65 * least(n / 40, 1) + 0.35 * least(langs / 8, 1)) + 0.13) AS suff FROM e)
 SELECT source, round(suff, 3) AS sufficiency, CASE WHEN suff < 45 THEN 'THIN' WHEN events < 10 OR pr < base THEN 'LIMITED' WHEN suff >= 78 THEN 'STRONG' WHEN suff >= 62 THEN 'MODERATE' ELSE 'LIMITED' END AS grade FROM s""")
def j19(spark, sf_dir):
    """J19 over the sources of documents."""
    n = F.count(F.lit(1))
    d = table(spark, sf_dir, "documents").groupBy("source").agg(n.alias("samples"), F.countDistinct("lang").alias("publishers"), F.avg("n_chars").alias("sessions"))
    d = d.withColumns({"events": F.col("samples") % 30, "pr_auc": 0.1 + (F.col("samples") % 7) / 10, "base_rate": F.lit(0.3), "brier_skill": (F.col("samples") % 5) / 10 - 0.1, "articles": F.col("samples"), "has_market": F.col("publishers") > 1, "has_fundamentals": F.lit(True)})
    return risk.evidence_grade(d).select("source", F.round("sufficiency", 3).alias("sufficiency"), "grade")


# ---- validation --------------------------------------------------------------------------------------------------

PRED_SQL = f"{PANEL_SQL}, pred AS (SELECT symbol, date, symbol * 100000 + (date - DATE '1990-01-01') AS id, round(ret5, 6) AS score, round(ln(lead(close, 5) OVER ({W}) / close), 6) AS r, lead(date, 5) OVER ({W}) AS matures FROM panel), pb AS (SELECT *, CAST(r < -0.5 AS INT) AS y, round(1 / (1 + exp(-score)), 4) AS p FROM pred WHERE score IS NOT NULL AND r IS NOT NULL)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel rows with a score (the last five-row return), the next five-row return r, the event y and a probability p."""
    p = features.label_returns(panel(spark, sf_dir), (5,))
    p = p.select("symbol", "date", (F.col("symbol") * 100000 + F.datediff("date", F.lit("1990-01-01").cast("date"))).alias("id"), F.round("ret5", 6).alias("score"), F.round("y5", 6).alias("r"), F.col("matures5").alias("matures"), "vol20", "gap20", "dd60", "volume_z_prior")
    return p.filter("score is not null and r is not null").withColumns({"y": (F.col("r") < -0.5).cast("int"), "p": F.round(1 / (1 + F.exp(-F.col("score"))), 4)})


@query("k01_splits", f"WITH {PRED_SQL}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM pb)), f AS (SELECT * FROM (VALUES (1, 0.40, 0.50, 0.60), (2, 0.50, 0.60, 0.70), (3, 0.60, 0.70, 0.85), (4, 0.70, 0.85, 1.00)) t(fold, a, b, c)) SELECT fold, part, count(*) AS dates, min(date) AS first, max(date) AS last FROM (SELECT fold, date, CASE WHEN p < floor(n * a::DOUBLE) - 5 THEN 'train' WHEN p >= floor(n * a::DOUBLE) AND p < floor(n * b::DOUBLE) - 5 THEN 'calibrate' WHEN p >= floor(n * b::DOUBLE) AND p < floor(n * c::DOUBLE) THEN 'test' END AS part FROM d, f) WHERE part IS NOT NULL GROUP BY 1, 2")
def k01(spark, sf_dir):
    """K1, K2, K3: what each fold's parts hold."""
    return validate.chrono_split(predictions(spark, sf_dir)).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("dates"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("k08_threshold", f"WITH {PRED_SQL}, t AS (SELECT round(score, 4) AS th, sum(y) AS p, count(*) - sum(y) AS n FROM pb GROUP BY 1), c AS (SELECT th, (2 * (sum(p) OVER () - sum(p) OVER (ORDER BY th DESC)) + sum(n) OVER (ORDER BY th DESC)) / (sum(p) OVER () + sum(n) OVER ()) AS cost FROM t) SELECT th AS threshold, round(cost, 10) AS cost FROM c ORDER BY round(cost, 10), th DESC LIMIT 1")
def k08(spark, sf_dir):
    """K8."""
    return validate.cost_threshold(predictions(spark, sf_dir))


@query("k09_binary", f"WITH {PRED_SQL}, c AS (SELECT symbol, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM pb GROUP BY 1) SELECT symbol, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc FROM c")
def k09(spark, sf_dir):
    """K9, K13."""
    return rounded(validate.binary_metrics(predictions(spark, sf_dir), ["symbol"]).select("symbol", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "mcc"), 6)


@query("k10_areas", f"WITH {PRED_SQL}, t AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS n FROM pb GROUP BY 1), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(p) OVER (ORDER BY score DESC) / sum(p + n) OVER (ORDER BY score DESC) AS prec FROM t) SELECT round(sum(p * (b + n / 2)) / (sum(p) * sum(n)), 6) AS auc, round(sum(p * prec) / sum(p), 6) AS pr_auc FROM r")
def k10(spark, sf_dir):
    """K10, K11."""
    d = predictions(spark, sf_dir).select("y", "score").withColumn("k", F.lit(1))
    return rounded(validate.areas(d, ["k"]).drop("k"), 6)


@query("k12_calibration", f"WITH {PRED_SQL}, b AS (SELECT ntile(10) OVER (ORDER BY p, id) AS bin, y, p FROM pb) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(avg(y), 6) AS rate, round(avg(p), 6) AS mean_p, min(p) AS low, max(p) AS high FROM b GROUP BY 1")
def k12(spark, sf_dir):
    """K12, K19."""
    e = validate.ece(predictions(spark, sf_dir), equal_count=True)
    return e.select(F.col("bin").cast("long").alias("bin"), "n", F.round("rate", 6).alias("rate"), F.round("mean_p", 6).alias("mean_p"), "low", "high")


@query("k12_brier", f"WITH {PRED_SQL} SELECT symbol, round(avg(pow(p - y, 2)), 6) AS brier, round(1 - avg(pow(p - y, 2)) / nullif(avg(y) * (1 - avg(y)), 0), 5) AS brier_skill FROM pb GROUP BY 1")
def k12b(spark, sf_dir):
    """K12."""
    b = validate.brier(predictions(spark, sf_dir), ["symbol"])
    return b.select("symbol", F.round("brier", 6).alias("brier"), F.round("brier_skill", 5).alias("brier_skill"))


@query("k14_regression", f"WITH {PRED_SQL} SELECT symbol, count(*) AS n, round(avg(abs(r - score)), 5) AS mae, round(sqrt(avg(pow(r - score, 2))), 5) AS rmse, round(1 - avg(abs(r - score)) / avg(abs(r)), 5) AS skill, round(pow(corr(r, score), 2), 5) AS r2, round(regr_slope(r, score), 5) AS slope, round(regr_intercept(r, score), 5) AS intercept FROM pb GROUP BY 1")
def k14(spark, sf_dir):
    """K14."""
    return rounded(validate.regression_metrics(predictions(spark, sf_dir), ["symbol"], "r", "score").select("symbol", "n", "mae", "rmse", "skill", "r2", "slope", "intercept"), 5)


_RANK = "(rank() OVER (PARTITION BY date ORDER BY {0}) + (count(*) OVER (PARTITION BY date, {0}) - 1) / 2.0)"
_IC = f"ic AS (SELECT date, corr(a, b) AS ic, count(*) AS n FROM (SELECT date, {_RANK.format('r')} AS a, {_RANK.format('score')} AS b FROM pb) GROUP BY 1 HAVING count(*) >= 5 AND corr(a, b) IS NOT NULL AND NOT isnan(corr(a, b)))"


@query("k15_rank_ic", f"WITH {PRED_SQL}, {_IC} SELECT date, n, round(ic, 6) AS ic FROM ic")
def k15(spark, sf_dir):
    """K15."""
    return rounded(validate.daily_rank_ic(predictions(spark, sf_dir), "r", "score", 5), 6)


@query("k16_bootstrap", f"WITH {PRED_SQL}, d AS (SELECT date, avg(r) AS x FROM pb GROUP BY 1), p AS (SELECT x, row_number() OVER (ORDER BY date) - 1 AS place, count(*) OVER () AS n FROM d), s AS (SELECT rep, place AS slot, n FROM p, range(1, 101) t(rep)), a AS (SELECT rep, CAST((CAST('0x' || substr(md5(rep || ':' || (slot // 4)), 1, 8) AS BIGINT) % n + slot % 4) % n AS BIGINT) AS place FROM s), m AS (SELECT rep, avg(x) AS m FROM a JOIN p USING (place) GROUP BY 1) SELECT count(*) AS replicates, round(avg(m), 5) AS mean, round(quantile_cont(m, 0.05), 5) AS q05, round(quantile_cont(m, 0.5), 5) AS q50, round(quantile_cont(m, 0.95), 5) AS q95 FROM m")
def k16(spark, sf_dir):
    """Blocks of four dates."""
    d = predictions(spark, sf_dir).groupBy("date").agg(F.avg("r").alias("x"))
    return rounded(validate.bootstrap(d, "x", 100, 4), 5)


@query("k18_hac", f"WITH {PRED_SQL}, d AS (SELECT date, avg(r) AS x FROM pb GROUP BY 1), e AS (SELECT date, x, x - avg(x) OVER () AS e FROM d), l AS (SELECT *, " + ", ".join(f"lag(e, {k}) OVER (ORDER BY date) AS l{k}" for k in range(1, 6)) + " FROM e), v AS (SELECT count(*) AS days, avg(x) AS mean, sqrt(greatest(sum(e * e) + " + " + ".join(f"2 * (1 - {k} / 6.0) * sum(e * l{k})" for k in range(1, 6)) + ", 0)) / count(*) AS se FROM l) SELECT days, round(mean, 6) AS mean, round(se, 6) AS se, round(mean / nullif(se, 0), 4) AS t FROM v")
def k18(spark, sf_dir):
    """K18."""
    h = validate.hac_test(predictions(spark, sf_dir).groupBy("date").agg(F.avg("r").alias("x")), "x")
    return h.select("days", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round("t", 4).alias("t"))


@query("k20_buckets", f"WITH {PRED_SQL}, c AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS c FROM pb), b AS (SELECT len(list_filter(c, lambda x: x < score)) AS bin, score, r FROM pb, c) SELECT CAST(bin AS BIGINT) AS bin, min(score) AS low, max(score) AS high, count(*) AS n, round(avg(CAST(r > 0 AS INT)), 6) AS up_rate, round(median(r), 5) AS median, round(quantile_cont(r, 0.2), 5) AS q20 FROM b GROUP BY 1")
def k20(spark, sf_dir):
    """K20."""
    b = validate.scenario_buckets(predictions(spark, sf_dir), "score", "r")
    return b.select(F.col("bin").cast("long").alias("bin"), "low", "high", "n", F.round("up_rate", 6).alias("up_rate"), F.round("median", 5).alias("median"), F.round("q20", 5).alias("q20"))


@query("k22_conformal", f"WITH {PRED_SQL}, s AS (SELECT greatest(score - 1 - r, r - score - 1, 0) AS s FROM pb), o AS (SELECT s, row_number() OVER (ORDER BY s) AS k, count(*) OVER () AS n FROM s) SELECT max(n) AS n, round(min(s) FILTER (k >= least(ceil((n + 1) * 0.6), n)), 7) AS width FROM o")
def k22(spark, sf_dir):
    """K22."""
    d = predictions(spark, sf_dir).withColumns({"lo": F.col("score") - 1, "hi": F.col("score") + 1})
    return rounded(validate.conformal_width(d, "r", "lo", "hi"), 7)


@query("k23_monotone", f"""WITH {PRED_SQL}, b AS (SELECT ntile(15) OVER (ORDER BY score, id) AS bin, score, r FROM pb), m AS (SELECT median(score) AS x, median(r) AS y, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY bin), i AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(n) OVER (ORDER BY x) AS w, sum(n * y) OVER (ORDER BY x) AS s FROM m),
 j AS (SELECT a.i AS j, z.i AS k, (z.s - a.s + a.y * a.n) / (z.w - a.w + a.n) AS m FROM i a JOIN i z ON a.i <= z.i), f AS (SELECT i.i, j.j, min(j.m) AS m FROM i JOIN j ON j.j <= i.i AND i.i <= j.k GROUP BY 1, 2) SELECT round(x, 7) AS x, round(y, 7) AS y, n, round(max(m), 7) AS fit FROM f JOIN i USING (i) GROUP BY x, y, n, i""")
def k23(spark, sf_dir):
    """K7's pooling and K23: medians of 15 bins made monotone."""
    return rounded(validate.monotone(validate.median_bins(predictions(spark, sf_dir), "score", "r")).select("x", "y", "n", "fit"), 7)


_SCALES = f"{PRED_SQL}, g AS (SELECT scale, abs(r - scale * score) AS e FROM pb, (SELECT 0.05::DOUBLE + 1.2::DOUBLE * range / 38 AS scale FROM range(39))), a AS (SELECT scale, avg(e) AS mae, stddev_samp(e) / sqrt(count(*)) AS se FROM g GROUP BY 1)"


@query("k24_scales", f"""WITH {_SCALES}, b1 AS (SELECT mae + se AS lim FROM a ORDER BY mae, round(abs(scale - 1), 12) LIMIT 1), b0 AS (SELECT mae + se AS lim FROM a ORDER BY mae, round(scale, 12) LIMIT 1), c1 AS (SELECT scale FROM a, b1 WHERE round(mae, 9) <= round(lim, 9) ORDER BY round(abs(scale - 1), 12), mae LIMIT 1), c0 AS (SELECT scale FROM a, b0 WHERE round(mae, 9) <= round(lim, 9) ORDER BY scale LIMIT 1)
 SELECT round(scale, 6) AS scale, round(mae, 5) AS mae, round(se, 6) AS se, scale = (SELECT scale FROM c1) AS toward_identity, scale = (SELECT scale FROM c0) AS toward_zero FROM a""")
def k24(spark, sf_dir):
    """K24, with either target."""
    d = written(predictions(spark, sf_dir))
    s, z = validate.scale_selection(d, "r", "score"), validate.scale_selection(d, "r", "score", toward=0.0)
    return s.join(z.select("scale", F.col("chosen").alias("toward_zero")), "scale").select(F.round("scale", 6).alias("scale"), F.round("mae", 5).alias("mae"), F.round("se", 6).alias("se"), F.col("chosen").alias("toward_identity"), "toward_zero")


_POINTS = {"q50": "c", "scaled": "0.5 * c", "deadband": "CASE WHEN abs(c) < 0.25 * a THEN 0 ELSE c END", "centred": "c - m", "rank": "u * a", "market_rank": "m + u * a", "tail_rank": "sign(u) * pow(abs(u), 3) * a", "sparse_tail": "CASE WHEN abs(u) > 0.8 THEN c ELSE 0 END"}


@query("k26_families", f"""WITH {PRED_SQL}, f0 AS (SELECT date, r AS y, score * 0.2 AS c, round(2 * ((rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0) / count(*) OVER (PARTITION BY date)) - 1.0 / count(*) OVER (PARTITION BY date) - 1, 12) AS u, median(score * 0.2) OVER (PARTITION BY date) AS m, avg(abs(score * 0.2)) OVER (PARTITION BY date) AS a FROM pb),
 fe AS ({' UNION ALL '.join(f"SELECT date, '{k}' AS family, avg(abs(y - ({v}))) AS mae FROM f0 GROUP BY 1" for k, v in _POINTS.items())}), dt AS (SELECT date, (row_number() OVER (ORDER BY date) - 1) * 2 < count(*) OVER () AS early FROM (SELECT DISTINCT date FROM fe)),
 ed AS (SELECT family, date, early, b.mae - f.mae AS x, row_number() OVER (PARTITION BY family ORDER BY date) - 1 AS place, count(*) OVER (PARTITION BY family) AS n FROM fe f JOIN (SELECT date, mae FROM fe WHERE family = 'q50') b USING (date) JOIN dt USING (date) WHERE family <> 'q50'),
 dr AS (SELECT family, rep, CAST((CAST('0x' || substr(md5(rep || ':' || (place // 20)), 1, 8) AS BIGINT) % n + place % 20) % n AS BIGINT) AS place FROM ed, range(1, 201) t(rep)), rm AS (SELECT family, rep, avg(x) AS m FROM dr JOIN ed USING (family, place) GROUP BY 1, 2), bd AS (SELECT family, quantile_cont(m, 0.05) AS q FROM rm GROUP BY 1),
 hv AS (SELECT family, avg(x) FILTER (early) AS e, avg(x) FILTER (NOT early) AS l, count(*) AS days FROM ed GROUP BY 1) SELECT family, round(e, 5) AS early_edge, round(l, 5) AS late_edge, days, round(q, 5) AS edge_q05, e > 0 AND l > 0 AND q > 0 AS kept FROM hv JOIN bd USING (family)""")
def k26(spark, sf_dir):
    """Point families judged on early and late dates and by blocks."""
    d = predictions(spark, sf_dir).select("symbol", "date", F.col("r").alias("y"), "score", (F.col("score") * 0.2).alias("q50"))
    return rounded(validate.family_choice(validate.family_errors(validate.point_families(d, "q50", "score")), "q50"), 5)


@query("k29_pbo", f"""WITH {PRED_SQL}, g AS (SELECT p.*, ps.vol20, ps.dd60, ps.gap20 FROM pb p JOIN panel ps USING (symbol, date) WHERE ps.vol20 IS NOT NULL AND ps.dd60 IS NOT NULL), d AS (SELECT date, avg(r * sign(score)) AS a, avg(r * sign(gap20)) AS b, avg(-r * sign(score)) AS c FROM g GROUP BY 1), k AS (SELECT *, ntile(8) OVER (ORDER BY date) - 1 AS block FROM d),
 l AS (SELECT block, 'a' AS model, sum(a) AS s, count(a) AS n FROM k GROUP BY 1 UNION ALL SELECT block, 'b', sum(b), count(b) FROM k GROUP BY 1 UNION ALL SELECT block, 'c', sum(c), count(c) FROM k GROUP BY 1),
 v AS (SELECT m.mask, model, round(sum(s) FILTER ((m.mask >> block) & 1 = 1) / sum(n) FILTER ((m.mask >> block) & 1 = 1), 12) AS ins, round(sum(s) FILTER ((m.mask >> block) & 1 = 0) / sum(n) FILTER ((m.mask >> block) & 1 = 0), 12) AS out FROM l CROSS JOIN (SELECT CAST(range AS BIGINT) AS mask FROM range(256) WHERE bit_count(range) = 4) m GROUP BY 1, 2),
 w AS (SELECT *, median(out) OVER (PARTITION BY mask) AS med FROM v QUALIFY row_number() OVER (PARTITION BY mask ORDER BY ins DESC, model DESC) = 1) SELECT count(*) AS splits, round(avg(CAST(out < med AS INT)), 6) AS pbo FROM w""")
def k29(spark, sf_dir):
    """K29 over daily results of three signals."""
    d = predictions(spark, sf_dir).filter("vol20 is not null and dd60 is not null")
    daily = d.groupBy("date").agg(F.avg(F.col("r") * F.signum("score")).alias("a"), F.avg(F.col("r") * F.signum("gap20")).alias("b"), F.avg(-F.col("r") * F.signum("score")).alias("c"))
    return rounded(validate.pbo(daily, ["a", "b", "c"]), 6)


@query("k31_sealed", f"WITH {PRED_SQL}, {_IC}, d AS (SELECT date, ntile(4) OVER (ORDER BY date) AS block FROM (SELECT DISTINCT date FROM pb)) SELECT CAST(block AS BIGINT) AS block, count(*) AS days, round(avg(ic), 6) AS ic FROM ic JOIN d USING (date) GROUP BY 1".replace(">= 5 AND", ">= 12 AND"))
def k31(spark, sf_dir):
    """K31."""
    return rounded(validate.sealed_blocks(predictions(spark, sf_dir), "r", "score").select(F.col("block").cast("long").alias("block"), "days", "ic"), 6)


def _snap_sql(x: str, mode: str, v: str = "venue") -> str:
    t = f"CASE WHEN {v} <> 'HOSE' THEN 100 WHEN y < 10000 THEN 10 WHEN y < 50000 THEN 50 ELSE 100 END"
    grid = f"list_filter(CASE WHEN {v} <> 'HOSE' THEN [floor(({x}) / 100) * 100, ceil(({x}) / 100) * 100] ELSE [floor(({x}) / 10) * 10, ceil(({x}) / 10) * 10, floor(({x}) / 50) * 50, ceil(({x}) / 50) * 50, floor(({x}) / 100) * 100, ceil(({x}) / 100) * 100] END, lambda y: y > 0 AND y % {t} = 0)"
    if mode == "nearest":
        return f"-(list_min(list_transform({grid}, lambda y: {{'d': abs(y - ({x})), 'y': -y}}))).y"
    side, best, other = ("<=", "max", "min") if mode == "down" else (">=", "min", "max")
    edge = "+ 0.000000001" if mode == "down" else "- 0.000000001"
    return f"coalesce(list_{best}(list_filter({grid}, lambda y: y {side} ({x}) {edge})), list_{other}({grid}))"


_QUOTE_SQL = f"""{PRED_SQL}, c AS (SELECT pb.*, b.close AS ref, CASE symbol % 3 WHEN 0 THEN 'HOSE' WHEN 1 THEN 'HNX' ELSE 'UPCOM' END AS venue, score / 10 AS fc, 0.02 + (id % 7) / 100.0 AS vol FROM pb JOIN bars b USING (symbol, date)),
 g AS (SELECT *, CASE WHEN venue <> 'HOSE' THEN 100 WHEN ref < 10000 THEN 10 WHEN ref < 50000 THEN 50 ELSE 100 END AS tick, CASE venue WHEN 'HOSE' THEN 0.07 WHEN 'HNX' THEN 0.10 ELSE 0.15 END AS lim, CASE WHEN abs(fc) <= 0.15 * vol AND abs(p - 0.5) >= 0.07 THEN sign(p - 0.5) ELSE sign(fc) END AS side FROM c),
 m AS (SELECT *, greatest(tick, round_even(0.111 * (1 + least(abs(p - 0.5) * 0.75, 0.12)) * vol * ref / tick, 0) * tick) AS least_move, {_snap_sql('ref * exp(fc)', 'nearest')} AS plain FROM g),
 q AS (SELECT *, CASE WHEN side <> 0 AND abs(plain - ref) < least_move THEN {_snap_sql('ref + side * least_move', 'nearest')} ELSE plain END AS moved, {_snap_sql('ref * pow(1 - lim, 3)', 'up')} AS low, {_snap_sql('ref * pow(1 + lim, 3)', 'down')} AS high FROM m)"""


@query("k34_quotes", f"WITH {BARS_SQL}, v AS (SELECT symbol, date, close, CASE symbol % 3 WHEN 0 THEN 'HOSE' WHEN 1 THEN 'HNX' ELSE 'UPCOM' END AS venue FROM bars) SELECT symbol, date, CAST({_snap_sql('close', 'nearest')} AS BIGINT) AS nearest, CAST({_snap_sql('close', 'down')} AS BIGINT) AS down, CAST({_snap_sql('close', 'up')} AS BIGINT) AS up FROM v")
def k34(spark, sf_dir):
    """K34's grid at three venues."""
    v = F.element_at(F.array(F.lit("HOSE"), F.lit("HNX"), F.lit("UPCOM")), (F.col("symbol") % 3 + 1).cast("int"))
    return bars(spark, sf_dir).select("symbol", "date", *[validate.snap(F.col("close"), v, m).cast("long").alias(m) for m in ("nearest", "down", "up")])


@query("k34_executable", f"WITH {_QUOTE_SQL} SELECT id, CAST(greatest(low, least(high, moved)) AS BIGINT) AS quote, CAST(low AS BIGINT) AS quote_low, CAST(high AS BIGINT) AS quote_high FROM q")
def k34x(spark, sf_dir):
    """Quotes of three-session forecasts at three venues."""
    v = F.element_at(F.array(F.lit("HOSE"), F.lit("HNX"), F.lit("UPCOM")), (F.col("symbol") % 3 + 1).cast("int"))
    d = predictions(spark, sf_dir).join(bars(spark, sf_dir).select("symbol", "date", F.col("close").alias("ref")), ["symbol", "date"])
    d = d.withColumns({"venue": v, "fc": F.col("score") / 10, "vol": 0.02 + (F.col("id") % 7) / 100})
    return validate.executable_quotes(d, "ref", "fc", "p", "vol", "venue", 3).select("id", "quote", "quote_low", "quote_high")


@query("k33_shape", f"""WITH {PRED_SQL}, a AS (SELECT id, score / 10 AS r, p, 0.02 + (id % 7) / 100.0 AS v FROM pb), b AS (SELECT *, CASE WHEN abs(p - 0.5) >= 0.07 AND sign(r) <> sign(p - 0.5) AND abs(r) <= 0.15 * v THEN sign(p - 0.5) * greatest(abs(r), 0.06 * v) ELSE r END AS t FROM a)
 SELECT id, round(CASE WHEN abs(p - 0.5) >= 0.045 AND (sign(t) = sign(p - 0.5) OR abs(t) <= 0.045 * v) AND p <> 0.5 THEN sign(p - 0.5) * greatest(abs(t), 0.2 * v * least(greatest(0.75 + 4 * abs(p - 0.5), 0.9), 1.45)) ELSE t END, 9) AS shaped FROM b""")
def k33(spark, sf_dir):
    """K33."""
    d = predictions(spark, sf_dir).select("id", (F.col("score") / 10).alias("r"), "p", (0.02 + (F.col("id") % 7) / 100).alias("v"))
    return validate.shape_prediction(d, "r", "p", "v", 1.0, 0.2).select("id", F.round("shaped", 9).alias("shaped"))


@query("k36_news_study", f"WITH {PANEL_SQL}, {TEXT_SQL}, p AS (SELECT symbol, date, ln(lead(close, 5) OVER ({W}) / close) AS y FROM panel), a AS (SELECT symbol, date, CASE WHEN count(y) OVER (PARTITION BY date) >= 8 THEN y - median(y) OVER (PARTITION BY date) END AS ar FROM p), j AS (SELECT i.event, i.signed, a.ar FROM a JOIN items i ON i.symbol = a.symbol AND i.available = a.date WHERE i.signed <> 0 AND a.ar IS NOT NULL) SELECT CASE WHEN signed > 0 THEN 'positive' ELSE 'negative' END AS sign, event, count(*) AS n, round(avg(ar), 4) AS mean FROM j GROUP BY 1, 2")
def k36(spark, sf_dir):
    """K36."""
    a = studies.abnormal_returns(features.label_returns(bars(spark, sf_dir), (5,)), "y5").select("symbol", "date", "ar")
    j = a.join(items(spark, sf_dir).select("symbol", F.col("available").alias("date"), "event", "signed"), ["symbol", "date"]).filter("signed <> 0 and ar is not null")
    return rounded(j.groupBy(F.when(F.col("signed") > 0, "positive").otherwise("negative").alias("sign"), "event").agg(F.count("ar").alias("n"), F.avg("ar").alias("mean")))


@query("k38_reference_percentile", f"WITH {PRED_SQL}, s AS (SELECT score, count(*) AS n FROM pb GROUP BY 1), c AS (SELECT score, (coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 0.5 * n) / sum(n) OVER () AS p FROM s) SELECT pb.id, round(c.p, 6) AS percentile FROM pb JOIN c USING (score)")
def k38(spark, sf_dir):
    """K38."""
    d = predictions(spark, sf_dir)
    return rounded(validate.reference_percentile(d, d, "score", ["id"]).select("id", "percentile"), 6)


@query("k41_index_backtest", f"WITH {SCORED_SQL}, a AS (SELECT symbol, date, round(index_score, 4) AS s, round(min(close) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) / close - 1, 6) AS dd FROM scored), b AS (SELECT *, row_number() OVER ({W}) <= floor(count(*) OVER (PARTITION BY symbol) * 0.7) AS t FROM a WHERE s IS NOT NULL AND dd IS NOT NULL), c AS (SELECT symbol, quantile_cont(dd, 0.05) AS e, quantile_cont(s, 0.8) AS al FROM b WHERE t GROUP BY 1) SELECT b.symbol, count(*) AS rows, round(avg(CAST(dd <= e AS INT)), 6) AS event_rate, round(count(*) FILTER (dd <= e AND s >= al) / nullif(count(*) FILTER (s >= al), 0), 6) AS precision, round(count(*) FILTER (dd <= e AND s >= al) / nullif(count(*) FILTER (dd <= e), 0), 6) AS recall FROM b JOIN c USING (symbol) WHERE NOT t GROUP BY 1")
def k41(spark, sf_dir):
    """K41."""
    d = features.forward_extremes(scored(spark, sf_dir)).select("symbol", "date", F.round("index_score", 4).alias("score"), F.round("fwd_dd", 6).alias("fwd_dd"))
    return rounded(validate.index_backtest(d).select("symbol", "rows", "event_rate", "precision", "recall"), 6)


@query("k47_outcomes", f"WITH {BARS_SQL}, w AS (SELECT DISTINCT date AS md FROM bars WHERE isodow(date) = 5), d AS (SELECT md, row_number() OVER (ORDER BY md) AS d, count(*) OVER () AS last FROM w), a AS (SELECT symbol, md, d, last, close FROM bars JOIN d ON md = date), j AS (SELECT a.symbol, a.md, a.d, a.last, count(b.close) AS n, min(b.close / a.close) AS w FROM a LEFT JOIN a b ON b.symbol = a.symbol AND b.d BETWEEN a.d + 1 AND a.d + 4 GROUP BY ALL) SELECT symbol, md AS model_date, CASE WHEN d + 4 > last THEN 'PENDING' WHEN n < 4 THEN 'UNRESOLVED_DATA_GAP' ELSE 'MATURED' END AS outcome, round(CASE WHEN d + 4 <= last AND n = 4 THEN w - 1 END, 5) AS worst FROM j")
def k47(spark, sf_dir):
    """Fridays as archive dates, four later ones to mature."""
    a = bars(spark, sf_dir).filter(F.weekday("date") == 4).select("symbol", F.col("date").alias("model_date"), "close")
    return rounded(monitor.outcomes(a, 4).select("symbol", "model_date", "outcome", "worst"), 5)


@query("k48_prequential", f"WITH {PRED_SQL}, x AS (SELECT date, r, score, {_RANK.format('r')} AS a, {_RANK.format('score')} AS b FROM pb) SELECT date, count(*) AS n, round(avg(CAST(sign(r) = sign(score) AS INT)), 6) AS hit, round(avg(CAST(r BETWEEN score - 1 AND score + 1 AS INT)), 6) AS inside, round(avg(abs(r - score)), 8) AS mae FROM x GROUP BY 1")
def k48(spark, sf_dir):
    """K48."""
    f = predictions(spark, sf_dir).select("date", "symbol", F.lit(5).alias("h"), F.col("score").alias("p50"), (F.col("score") - 1).alias("q20"), (F.col("score") + 1).alias("q80"), F.col("r").alias("y"))
    return monitor.prequential(f).select("date", "n", F.round("hit", 6).alias("hit"), F.round("inside", 6).alias("inside"), F.round("mae", 8).alias("mae"))


FEATURES = ["score", "vol20", "gap20", "dd60", "volume_z_prior"]


@query("k05_crash_models")
def k05(spark, sf_dir):
    """Models of the event by kind, calibrated, judged on later dates, gated and weighed."""
    d = written(predictions(spark, sf_dir))
    split = written(validate.chrono_split(d).filter("fold = 4"))
    part = {p: d.join(F.broadcast(split.filter(F.col("part") == p).select("date")), "date", "left_semi") for p in ("train", "calibrate", "test")}
    start = split.filter("part = 'calibrate'").agg(F.min("date")).first()[0]
    train = validate.maturity_purge(part["train"], "matures", str(start))
    out = None
    for kind in ("logistic", "forest", "boosted"):
        m = models.crash_classifier(train, FEATURES, "y", kind)
        scored_ = [models.probability(m, part[p].withColumnRenamed("score", "score0").withColumn("score", F.col("score0")), FEATURES, "s") for p in ("calibrate", "test")]
        cal = models.platt(scored_[0], "s")
        t = models.apply_platt(cal, scored_[1], "s", "q") if cal else scored_[1].withColumn("q", F.col("s"))
        t = t.withColumn("model", F.lit(kind))
        out = t.select("model", "y", "q") if out is None else out.unionByName(t.select("model", "y", "q"))
    out = written(out)
    base = out.groupBy("model").agg(F.avg(F.col("y").cast("double")).alias("base_rate"))
    r = validate.roc_auc(out, ["model"], "y", "q").join(validate.pr_auc(out, ["model"], "y", "q"), "model").join(validate.brier(out, ["model"], "y", "q"), "model").join(base, "model")
    skills = {"pr_skill": F.greatest((F.col("pr_auc") - F.col("base_rate")) / F.greatest(F.lit(0.05), 1 - F.col("base_rate")), F.lit(0.0)), "auc_skill": F.greatest((F.col("auc") - 0.5) / 0.25, F.lit(0.0))}
    g = validate.gates(r.withColumns(skills), {"auc": "auc > 0.5", "brier": "brier_skill > -1"})
    return rounded(validate.reliability_weights(g).select("model", "auc", "brier", "weight", "reasons", "passed"), 3)


@query("k27_expert_stack")
def k27(spark, sf_dir):
    """Out-of-fold experts and their stack, by fold."""
    d = written(predictions(spark, sf_dir))
    s = models.expert_stack(d, written(validate.chrono_split(d)), {"price": ["score", "gap20"], "risk": ["vol20", "dd60", "volume_z_prior"]}, "r", "matures")
    return rounded(s.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.corr("r", "stacked").alias("corr"), F.avg(F.abs(F.col("r") - F.col("stacked"))).alias("mae")), 3)


@query("k32_return_model")
def k32(spark, sf_dir):
    """The return models' errors on the sealed dates."""
    d = written(predictions(spark, sf_dir).withColumn("vol", F.col("vol20") / 252**0.5).filter("vol is not null").select("date", "r", "y", "vol", "score", "vol20", "gap20", "dd60"))
    block = written(validate.embargo_blocks(d, 5))
    train, test = (d.join(F.broadcast(block.filter(F.col("block") == b).select("date")), "date", "left_semi") for b in ("fit", "sealed"))
    fs = ["score", "vol20", "gap20", "dd60"]
    rm = validate.shape_prediction(models.return_model(train.withColumn("target", F.col("r")).drop("y"), test.drop("y").withColumnRenamed("r", "actual"), fs, "target", "vol"), "r", "p_up", "vol", 1.0, 0.2)
    mp = models.market_plus_alpha(train.drop("y"), test.drop("y"), ["score", "vol20"], fs, "r")
    fz = models.fuzzy_least_squares(train, test, ["score", "gap20"], [[-1.0, -0.5], [0.0, 0.0], [1.0, 0.5]], 1.0, "r")
    e = lambda df, p, y, n: df.agg(F.lit(n).alias("model"), F.count(p).alias("n"), F.round(F.avg(F.abs(F.col(p) - F.col(y))), 3).alias("mae"))
    regimes = models.regime_kmeans(d, fs, "y").agg(F.lit("regimes").alias("model"), F.sum("n").alias("n"), F.round(F.max("event_rate"), 2).alias("mae"))
    return e(rm, "shaped", "actual", "return").unionByName(e(mp, "forecast", "r", "market_plus_alpha")).unionByName(e(fz, "fuzzy", "r", "fuzzy")).unionByName(regimes)


@query("k21_quantiles")
def k21(spark, sf_dir):
    """Rows whose outcome lies below each conditional quantile."""
    d = predictions(spark, sf_dir)
    q = models.conditional_quantiles(d, d, "score", "r")
    return rounded(q.agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col("r") < F.col(c)).cast("double")).alias(c) for c in ("q20", "q50", "q80")]), 4)


@query("k21_boosted_quantiles")
def k21b(spark, sf_dir):
    """K21, K22 of the sealed dates: q20, q50, q80 of r given the score by trees that never fall, fitted to 85 % of the dates, widened on the next 5 %."""
    d = written(predictions(spark, sf_dir).select("symbol", "date", "score", "r"))
    block = validate.embargo_blocks(d, 5)
    fit, conformal, sealed = (written(d.join(block.filter(F.col("block").isin(*b)).select("date"), "date", "left_semi")) for b in (("fit", "point"), ("conformal",), ("sealed",)))
    model = boosting.fit_quantiles(fit, ["score"], "r", rounds=12, rate=0.25, rising={"score": 1})
    names = ["q20", "q50", "q80"]
    width = validate.conformal_width(model.transform(conformal, names), "r", "q20", "q80")
    out = model.transform(sealed, names).crossJoin(F.broadcast(width.select("width")))
    return rounded(out.select("symbol", "date", "r", "score", (F.col("q20") - F.col("width")).alias("q20"), "q50", (F.col("q80") + F.col("width")).alias("q80")), 6)


MARKET_FEATURES = ["score", "vol20", "gap20", "dd60"]


@query("k32_market_model")
def k32m(spark, sf_dir):
    """The frozen return model's point, interval, magnitude and P(up) on the sealed dates."""
    d = predictions(spark, sf_dir).withColumn("vol", F.col("vol20") / 252**0.5 * 5**0.5).filter("vol is not null").select("symbol", "date", "r", "vol", *MARKET_FEATURES)
    d = written(d)
    block = validate.embargo_blocks(d, 5)
    parts = [written(d.join(block.filter(F.col("block").isin(*b)).select("date"), "date", "left_semi")) for b in (("fit",), ("point", "conformal"), ("sealed",))]
    out, _ = forecast.market_model(*parts, MARKET_FEATURES, "r", "vol", 5, rounds=8, rate=0.3)
    return rounded(out.select("symbol", "date", "r", "point", "low", "high", "magnitude", "p_up"), 6)


@query("k30_walk_forward")
def k30(spark, sf_dir):
    """Rows, errors, rank correlation and coverage of three refitted folds."""
    d = written(predictions(spark, sf_dir).withColumn("vol", F.col("vol20") / 252**0.5 * 5**0.5))
    out, scales = gram.walk_forward(d, MARKET_FEATURES, "r", "vol", "matures", 5)
    return rounded(gram.fold_metrics(written(out), 5).join(scales, "fold").select("fold", "n", "mae", "base_mae", "mae_skill", "rank_ic", "coverage", "scale", "calibration_start", "test_start", "test_end"), 6)


@query("k29_refitted")
def k29r(spark, sf_dir):
    """Ridge stacks of three signals, fitted again on each of 70 splits."""
    d = written(predictions(spark, sf_dir).select("date", "r", "score", "gap20", "dd60"))
    return rounded(gram.pbo_splits(d, [["score"], ["gap20"], ["score", "gap20"], ["score", "gap20", "dd60"]], "r").drop("train_blocks"), 6)


# ---- streams -----------------------------------------------------------------------------------------------------

BARS_OF_TICKS = "SELECT user_id AS symbol, CAST(ts AS DATE) AS day, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS ticks FROM events GROUP BY 1, 2"


@query("n02_bars_from_ticks", BARS_OF_TICKS)
def n02(spark, sf_dir):
    """N2 as the batch form of the stream (tests run the stream and compare)."""
    b = panels.bars_from_ticks(ticks(spark, sf_dir))
    return b.select("symbol", F.to_date("start").alias("day"), "open", "high", "low", "close", "ticks")


@query("n01_late_guard", "SELECT event_type, count(*) AS n FROM events WHERE hour(ts) * 60 + minute(ts) >= 940 OR isodow(ts) >= 6 GROUP BY 1")
def n01(spark, sf_dir):
    """N1."""
    return panels.late_guard(ticks(spark, sf_dir)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("n06_sessions", "WITH e AS (SELECT user_id AS symbol, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM events WHERE value >= 20 WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY ts) AS k FROM e) SELECT symbol, count(*) AS rows, max(value) AS peak, CAST(floor(epoch(min(ts))) AS BIGINT) AS start FROM s GROUP BY symbol, k")
def n06(spark, sf_dir):
    """N6."""
    return panels.event_sessions(ticks(spark, sf_dir), "value >= 20").select("symbol", "rows", "peak", F.unix_timestamp("start").alias("start"))


_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _streamed(df: DataFrame, run) -> DataFrame:
    """What `run` writes, to a folder of its own, of df read as a bounded stream in the shared checkpoint folder."""
    spark = df.sparkSession
    written(df.limit(0))  # the session's checkpoint folder is set
    place = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    df.write.parquet(f"{place}/in")
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, _ROCKSDB)
    try:
        return run(spark.readStream.schema(df.schema).parquet(f"{place}/in"), place)
    finally:
        spark.conf.set(key, before)


def _to_table(out: DataFrame, place: str) -> DataFrame:
    out.writeStream.format("parquet").option("checkpointLocation", f"{place}/c").trigger(availableNow=True).start(f"{place}/out").awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{place}/out")


@query("n03_transitions", "SELECT symbol, \"at\", before, level FROM (SELECT user_id AS symbol, epoch_us(ts) AS \"at\", CAST(floor(value / 20) AS BIGINT) AS level, lag(CAST(floor(value / 20) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE level > before")
def n03(spark, sf_dir):
    """N3 over the events as a stream: rises of a symbol's level."""
    t = ticks(spark, sf_dir).select("symbol", "event_id", F.unix_micros("ts").alias("at"), F.floor(F.col("value") / 20).cast("long").alias("level"))
    return _streamed(t, lambda stream, place: _to_table(panels.status_transitions(stream), place))


@query("n04_maturation", f"""WITH {BARS_SQL}, f AS (SELECT symbol, date, CASE WHEN (symbol + (date - DATE '1990-01-01')) % 11 <> 0 THEN close END AS close, symbol % 3 = 0 AS signal FROM bars WHERE isodow(date) = 5),
 w AS (SELECT *, count(*) OVER n AS later, count(close) OVER n AS known, min(close) OVER n AS least FROM f WINDOW n AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))
 SELECT symbol, date, CASE WHEN known < 4 THEN 'UNRESOLVED_DATA_GAP' ELSE 'MATURED' END AS outcome, CASE WHEN known = 4 THEN round(least / close - 1, 6) END AS worst FROM w WHERE signal AND close IS NOT NULL AND later = 4""")
def n04(spark, sf_dir):
    """N4 over Fridays' closes as a stream, some missing: what became of signals four rows later."""
    gap = (F.col("symbol") + F.datediff("date", F.lit("1990-01-01").cast("date"))) % 11 == 0
    f = bars(spark, sf_dir).filter(F.weekday("date") == 4).select("symbol", "date", F.when(~gap, F.col("close").cast("double")).alias("close"), (F.col("symbol") % 3 == 0).alias("signal"))
    return rounded(_streamed(f, lambda stream, place: _to_table(panels.outcome_maturation(stream, 4), place)), 6)


@query("n05_archive", f"WITH {BARS_SQL} SELECT date AS model_date, count(*) AS rows, round(sum(close), 7) AS total FROM bars GROUP BY 1")
def n05(spark, sf_dir):
    """A stream of dated rows in two batches, the second with all dates of the first again, changed; the first write stays."""
    b = bars(spark, sf_dir).select(F.col("date").alias("model_date"), "symbol", F.col("close").cast("double").alias("close"), F.lit("a").alias("snapshot_hash"))

    def run(stream: DataFrame, place: str) -> DataFrame:
        sink = lambda: panels.archive_sink(stream, f"{place}/archive", f"{place}/c").trigger(availableNow=True).start().awaitTermination()
        sink()
        again = b.withColumns({"close": F.when(F.dayofmonth("model_date") <= 20, 0.0).otherwise(F.col("close")), "snapshot_hash": F.lit("b")})
        again.write.mode("append").parquet(f"{place}/in")
        sink()
        return panels.read_archive(spark, f"{place}/archive", b.schema)

    kept = _streamed(b.filter(F.dayofmonth("model_date") <= 20), run)
    return rounded(kept.groupBy("model_date").agg(F.count(F.lit(1)).alias("rows"), F.sum("close").alias("total")), 7)
