"""News and text jobs over tables of articles: sentiment, classes, entities, novelty, duplicates, rumours."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import written
from ..functions.expressions import fold
from .joins import effective_date

#: Terms by tone of the module's sentiment.
POSITIVE = (
    "tăng trưởng", "lợi nhuận tăng", "lãi tăng", "kỷ lục", "mở rộng", "trúng thầu", "nâng hạng", "khuyến nghị mua", "vượt kế hoạch", "tăng mạnh", "record", "growth",
    "profit rises", "upgrade", "buy", "beat", "outperform",
)
NEGATIVE = (
    "khởi tố", "bắt giữ", "điều tra", "vi phạm", "xử phạt", "truy thu", "thua lỗ", "báo lỗ", "lỗ ròng", "giảm mạnh", "lao dốc", "sụt giảm", "bán tháo", "cắt giảm", "hủy", "nợ xấu",
    "vỡ nợ", "cảnh báo", "rủi ro", "suy giảm", "đóng cửa", "trì hoãn", "downgrade", "sell", "fraud", "investigation", "loss", "decline", "slump", "warning", "risk", "miss",
)
#: Terms by tone of the signed sentiment.
SIGNAL_POSITIVE = (
    "tăng trưởng", "tăng mạnh", "bứt phá", "vượt kế hoạch", "lợi nhuận tăng", "lãi tăng", "kỷ lục", "trúng thầu", "mua ròng", "nâng hạng", "khởi sắc", "cổ tức", "hồi phục", "tích cực",
    "mở rộng", "được phê duyệt", "hoàn thành",
)
SIGNAL_NEGATIVE = (
    "giảm mạnh", "lao dốc", "bán tháo", "thua lỗ", "lỗ ròng", "lợi nhuận giảm", "bán ròng", "xả hàng", "vi phạm", "xử phạt", "khởi tố", "điều tra", "cảnh báo", "đình chỉ",
    "hủy niêm yết", "rủi ro", "suy giảm", "nợ xấu", "mất giá", "bốc hơi", "phá sản", "thanh tra", "tin đồn",
)
#: Keywords by event class, in the order in which equals are decided.
EVENTS = {
    "EARNINGS": ("lợi nhuận", "doanh thu", "kết quả kinh doanh", "báo lỗ", "lỗ ròng", "biên lợi nhuận"),
    "REGULATORY": ("khởi tố", "điều tra", "xử phạt", "vi phạm", "thanh tra", "cảnh báo"),
    "CORPORATE_ACTION": ("cổ tức", "phát hành", "quyền mua", "chia tách", "esop", "cổ phiếu thưởng"),
    "OWNERSHIP": ("cổ đông lớn", "thoái vốn", "đăng ký mua", "đăng ký bán", "chủ tịch", "người nội bộ"),
    "FINANCING": ("trái phiếu", "nợ vay", "đáo hạn", "tín dụng", "phát hành riêng lẻ"),
    "OPERATIONS_MA": ("hợp đồng", "trúng thầu", "dự án", "m&a", "sáp nhập", "mua lại", "thoái vốn"),
    "ANALYST": ("khuyến nghị", "giá mục tiêu", "nâng khuyến nghị", "hạ khuyến nghị"),
    "MARKET_FLOW": ("mua ròng", "bán ròng", "khối ngoại", "tự doanh", "room ngoại"),
}
#: Names of official and trusted publishers, words of clarifications and rumours.
OFFICIAL = ("sở giao dịch chứng khoán", "ho chi minh stock exchange", "hose", "hsx.vn", "ủy ban chứng khoán", "state securities commission", "ubck", "ssc.gov.vn")
TRUSTED = (
    "cafef", "vietstock", "vnexpress", "vneconomy", "vietnambiz", "baodautu", "znews", "dantri", "dân trí", "tuổi trẻ", "tuoitre", "laodong", "lao động", "bnews", "ndh", "nguoiquansat",
    "người quan sát", "nhip song kinh doanh", "markettimes",
)
CLARIFY = ("bác bỏ", "phủ nhận", "đính chính", "làm rõ", "phản hồi tin đồn")
RUMOUR = ("tin đồn", "đồn đoán", "rộ tin", "lan truyền", "chưa xác nhận", "chưa kiểm chứng", "rumor")


def hits(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur anywhere in a text, whatever its case; null has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))


def tokens(text: Column) -> Column:
    """Distinct folded words of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def lexical_sentiment(items: DataFrame, text: str = "title", positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> DataFrame:
    """H1 (positive - negative) / max(1, hits); H2 its label and the signed score within +-.42 + .18 per hit."""
    p, n = hits(F.col(text), positive), hits(F.col(text), negative)
    df = items.withColumns({"pos": p, "neg": n})
    d = F.col("pos") - F.col("neg")
    size = F.least(F.lit(1.0), 0.42 + 0.18 * F.abs(d))
    return df.withColumns({"sentiment": d / F.greatest(F.lit(1), F.col("pos") + F.col("neg")), "label": F.when(d > 0, "POS").when(d < 0, "NEG").otherwise("NEU"), "signed": F.when(d > 0, size).when(d < 0, -size).otherwise(0.0)})


def module_risk(items: DataFrame, by: list[str]) -> DataFrame:
    """H1 risk of a group of articles: 100 x (.65 (1 - mean) / 2 + .35 share of negatives)."""
    return items.groupBy(*by).agg((100 * (0.65 * (1 - F.avg("sentiment")) / 2 + 0.35 * F.avg((F.col("sentiment") < 0).cast("double")))).alias("news_risk"), F.count(F.lit(1)).alias("items"))


def rule_override(items: DataFrame, negative: str, positive: str, neutral: str, text: str = "title") -> DataFrame:
    """H3 patterns decide over a label that is given: negative before positive before neutral."""
    t = F.coalesce(F.col(text), F.lit(""))
    return items.withColumn("label", F.when(t.rlike(negative), "NEG").when(t.rlike(positive), "POS").when(t.rlike(neutral), "NEU").otherwise(F.col("label")))


def event_class(items: DataFrame, text: str = "title", events: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """H4 the class with most keyword hits (the first of equals; GENERAL without hits) and its materiality."""
    best = F.array_max(F.array(*[F.struct(hits(F.col(text), terms).alias("h"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, terms) in enumerate((events or EVENTS).items())]))
    df = items.withColumn("_b", best)
    return df.withColumns({"event": F.when(F.col("_b.h") > 0, F.col("_b.k")).otherwise("GENERAL"), "materiality": 0.35 + 0.18 * F.least(F.col("_b.h"), F.lit(3))}).drop("_b")


def event_alias(event: str, title: str = "title") -> Column:
    """H4 the one name of an event that sources spell differently; general items with words of results or flows become those."""
    raw = F.regexp_replace(F.upper(F.coalesce(F.col(event), F.lit("GENERAL"))), " ", "_")
    #: Spellings of event names.
    names = {"CORPORATEACTION": "CORPORATE_ACTION", "CAPITAL_/_CORPORATE_ACTION": "CORPORATE_ACTION", "REGULATORY_/_LEGAL": "REGULATORY", "OWNERSHIP_/_GOVERNANCE": "OWNERSHIP", "FINANCING_/_LEVERAGE": "FINANCING", "OPERATIONS_/_M&A": "OPERATIONS_MA", "M&A": "OPERATIONS_MA"}
    direct = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[raw], raw)
    t = F.col(title)
    return F.when((direct == "GENERAL") & (hits(t, ("lợi nhuận", "doanh thu", "báo cáo tài chính", "bán niên")) > 0), "EARNINGS").when((direct == "GENERAL") & (hits(t, ("mua ròng", "bán ròng", "tự doanh", "khối ngoại")) > 0), "MARKET_FLOW").otherwise(direct)


def source_class(items: DataFrame, official: tuple[str, ...] = OFFICIAL, trusted: tuple[str, ...] = TRUSTED, clarify: tuple[str, ...] = CLARIFY, rumour: tuple[str, ...] = RUMOUR) -> DataFrame:
    """H5 class of an item's source and its quality.

    A clarifying title comes first, then a rumour's title in the stream RUMOR, then an official publisher; quality is
    that class's, .9 or .62 for trusted and other mainstream publishers. Afterwards a stream OFFICIAL or RUMOR
    (column stream, if there is one) decides the class of what is MAINSTREAM.
    """
    stream = F.col("stream") if "stream" in items.columns else F.lit(None).cast("string")
    title, publisher = F.col("title"), F.col("publisher")
    kind = F.when(hits(title, clarify) > 0, "CLARIFICATION").when((stream == "RUMOR") & (hits(title, rumour) > 0), "RUMOR_UNVERIFIED").when(hits(publisher, official) > 0, "OFFICIAL").otherwise("MAINSTREAM")
    df = items.withColumn("_k", kind)
    k = F.col("_k")
    quality = F.when(k == "OFFICIAL", 1.0).when(k == "CLARIFICATION", 0.95).when(k == "RUMOR_UNVERIFIED", 0.35).when(hits(publisher, trusted) > 0, 0.9).otherwise(0.62)
    plain = k == "MAINSTREAM"
    final = F.when(plain & (stream == "OFFICIAL"), "OFFICIAL").when(plain & (stream == "RUMOR"), "RUMOR_UNVERIFIED").otherwise(k)
    return df.withColumns({"quality": quality, "source_class": final}).drop("_k")


def source_type(df_class: str = "source_class", stream: str = "stream") -> Column:
    """H5 RUMOR, CLARIFICATION, OFFICIAL or NARRATIVE from class and stream."""
    k, s = F.col(df_class), F.coalesce(F.col(stream), F.lit(""))
    return F.when((k == "RUMOR_UNVERIFIED") | (s == "RUMOR"), "RUMOR").when(k == "CLARIFICATION", "CLARIFICATION").when((s == "OFFICIAL") | (k == "OFFICIAL"), "OFFICIAL").otherwise("NARRATIVE")


def publication_time(text: Column, offset_hours: int = 7) -> Column:
    """H6 UTC time of ISO or RFC-822 text; text without an offset is local time (UTC + offset)."""
    rfc = F.regexp_replace(text, r"^[A-Za-z]{3}, ", "")
    zoned = text.rlike(r"(?:Z|[+-]\d{2}:?\d{2}|GMT|UTC)$")
    local = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss")))
    return F.when(zoned, F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")))).otherwise(local - F.make_interval(hours=F.lit(offset_hours)))


def title_key(text: str = "title") -> Column:
    return F.sha1(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")))


def exact_titles(items: DataFrame) -> DataFrame:
    """H7 the first item (by time, id) of each symbol and normalised title, with the number of items it stands for."""
    w = Window.partitionBy("symbol", "key").orderBy("published_at", "id")
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol", "key"))
    return items.withColumn("key", title_key()).withColumn("_r", F.row_number().over(w)).withColumn("copies", n).filter("_r = 1").drop("_r")


def similar_titles(items: DataFrame, least: float, text: str = "title") -> DataFrame:
    """Pairs (symbol, a, b, similarity) of a symbol's items whose title words reach a Jaccard similarity.

    Words are indexed in prefixes of rising frequency, so only items that share one of their rarer words are compared.
    """
    t = items.select("symbol", "id", tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")).filter(F.size("t") > 0)
    words = t.select("symbol", "id", F.explode("t").alias("w"))
    freq = words.groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol", "id"))
    rare = words.join(freq, "w").withColumns({"_r": F.row_number().over(Window.partitionBy("symbol", "id").orderBy("f", "w")), "_n": n}).filter(F.col("_r") <= F.col("_n") - F.ceil(F.col("_n") * least) + 1).select("symbol", "id", "w")
    cand = rare.join(rare.withColumnRenamed("id", "b"), ["symbol", "w"]).filter("id < b").select("symbol", F.col("id").alias("a"), "b").distinct()
    j = cand.join(t.select("symbol", F.col("id").alias("a"), F.col("t").alias("ta")), ["symbol", "a"]).join(t.select("symbol", F.col("id").alias("b"), F.col("t").alias("tb")), ["symbol", "b"])
    return j.withColumn("similarity", jaccard(F.col("ta"), F.col("tb"))).filter(F.col("similarity") >= least).select("symbol", "a", "b", "similarity")


def near_duplicates(items: DataFrame, least: float = 0.82, ratio: float = 0.91, floor: float = 0.6) -> DataFrame:
    """H8 items of which an earlier item of the symbol (by id) has nearly the same title: the first such and the best word similarity.

    Nearly the same: a word similarity of `least`, or of `floor` and letters that agree in order to `ratio` (one minus
    the edit distance over the longer title).
    """
    t = items.select("symbol", "id", F.trim(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}\p{N}]+", " ")).alias("t"))
    pairs = similar_titles(items, floor).join(t.select("symbol", F.col("id").alias("a"), F.col("t").alias("ta")), ["symbol", "a"]).join(t.select("symbol", F.col("id").alias("b"), F.col("t").alias("tb")), ["symbol", "b"])
    same = 1 - F.levenshtein("ta", "tb") / F.greatest(F.length("ta"), F.length("tb"))
    return pairs.filter((F.col("similarity") >= least) | (same >= ratio)).groupBy("symbol", F.col("b").alias("id")).agg(F.min("a").alias("first_like"), F.max("similarity").alias("similarity"))


def title_ratio(a: str, b: str, least: float = 0.0) -> float:
    """H8 twice the letters in matching blocks over all letters of both titles; 0 where it cannot reach `least`."""
    return ratio_of(a, Counter(a), b, Counter(b), least)


def ratio_of(a: str, letters_a: Counter, b: str, letters_b: Counter, least: float = 0.0) -> float:
    """title_ratio() of titles whose letters are counted.

    Blocks are matched only where lengths, letters in common, and letters in common in the same order allow `least`:
    matching blocks are such letters, so each bounds the ratio from above.
    """
    both = len(a) + len(b)
    if both and (2.0 * min(len(a), len(b)) / both < least or 2.0 * (letters_a & letters_b).total() / both < least or 2.0 * in_order(a, b) / both < least):
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


def in_order(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each letter of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    free = whole
    for c in b:
        hit = free & at.get(c, 0)
        free = (free + hit | free - hit) & whole
    return len(a) - free.bit_count()


def kept_titles(items: DataFrame, last: int = 220, least: float = 0.82, ratio: float = 0.91) -> DataFrame:
    """H8 symbol, id, kept: an item stays unless its title nearly repeats one of the symbol's last kept titles (220, or 60 live).

    Nearly repeats: a word similarity of `least`, or a ratio of matching blocks of `ratio`. Titles are lower-cased and
    their punctuation dropped; a symbol's items are taken by time and id. What is kept depends on what was kept before,
    so a symbol passes through one Python function in order, which holds `last` titles. Null titles count as empty.
    """
    rows = items.select("symbol", "id", "published_at", F.trim(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}\p{N}]+", " ")).alias("t"))

    def keep(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, chosen = None, deque(maxlen=last)
        for chunk in chunks:
            out = []
            for r in chunk.itertuples():
                if r.symbol != symbol:
                    symbol, chosen = r.symbol, deque(maxlen=last)
                words, letters = set(r.t.split()), Counter(r.t)
                again = any(t == r.t for t, _, _ in chosen) or any(len(words & w) / max(1, len(words | w)) >= least or ratio_of(r.t, letters, t, c, ratio) >= ratio for t, w, c in chosen)
                if not again:
                    chosen.append((r.t, words, letters))
                out.append(not again)
            yield chunk[["symbol", "id"]].assign(kept=out)

    return rows.repartition("symbol").sortWithinPartitions("symbol", "published_at", "id").mapInPandas(keep, "symbol long, id long, kept boolean")


def _most_alike(rows: pd.DataFrame, days: int) -> pd.DataFrame:
    """id and the largest word similarity with the rows that are not `own` of the days before, for each own row that has such."""
    past, own = rows[~rows["own"]].sort_values("d"), rows[rows["own"]]
    at, day = past["d"].to_numpy(), own["d"].to_numpy()
    size = past["t"].str.len().to_numpy()
    code, _ = pd.factorize(np.concatenate([*past["t"], *own["t"], np.array([], object)]))
    words, own_ends = code[: size.sum()], np.cumsum(own["t"].str.len().to_numpy()) + size.sum()
    order = np.argsort(words, kind="stable")
    holder, ends = np.repeat(np.arange(len(past)), size)[order], np.searchsorted(words[order], np.arange(code.max(initial=-1) + 2))
    low, high = np.searchsorted(at, day - days), np.searchsorted(at, day)
    ids, best = [], []
    for i, id_ in enumerate(own["id"]):
        if low[i] == high[i]:
            continue
        mine = code[own_ends[i - 1] if i else size.sum() : own_ends[i]]
        both = np.bincount(np.concatenate([np.array([], int), *[holder[ends[w] : ends[w + 1]] for w in mine]]), minlength=len(past))[low[i] : high[i]]
        either = size[low[i] : high[i]] + len(mine) - both
        ids.append(id_)
        best.append(float(np.max(both / np.maximum(either, 1))))
    return pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "_s": pd.Series(best, dtype="float64")})


def novelty(items: DataFrame, days: int = 30) -> DataFrame:
    """H9 1 - the largest title similarity with the symbol's items of the days before; 1 without any.

    Items meet by symbol and 30-day bucket (its own and the one before), so a group is bounded in time. Within it words
    in common are counted by lists of the titles that hold a word: all pairs of a group still count, as numbers in an
    array instead of rows with two lists of words.
    """
    t = items.select("symbol", F.col("id").cast("long").alias("id"), tokens(F.coalesce("title", F.lit(""))).alias("t"), F.unix_date(F.to_date("published_at")).alias("d")).filter("symbol is not null and d is not null")
    bucket = F.floor(F.col("d") / days)
    side = F.explode(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), *[F.struct((bucket + k).alias("b"), F.lit(False).alias("own")) for k in (0, 1)]))
    met = t.withColumn("_x", side).select("symbol", "_x.b", "_x.own", "id", "t", "d")
    best = met.groupBy("symbol", "b").applyInPandas(lambda rows: _most_alike(rows, days), "id long, _s double").groupBy("id").agg(F.max("_s").alias("_s"))
    return items.join(best, "id", "left").withColumn("novelty", 1 - F.coalesce("_s", F.lit(0.0))).drop("_s")


def noisy(title: str = "title") -> Column:
    """H10 whether a title is empty, untitled or about a covered warrant."""
    t = F.lower(F.trim(F.coalesce(F.col(title), F.lit(""))))
    return (t == "") | t.startswith("untitled") | t.startswith("cw.") | (hits(t, ("chứng quyền", "covered warrant")) > 0)


def relevance(items: DataFrame, names: DataFrame) -> DataFrame:
    """H10 1 for a ticker among the title's words, .9 / .72 for .65 / .35 of the name's words of 3 letters and more, else .45; noise goes.

    names (symbol, ticker, name); items of symbols without a name go, too.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9à-ỹ]+", " ")
    j = items.join(names.select("symbol", "ticker", "name"), "symbol").filter(~noisy())
    words, own = F.split(plain(F.col("title")), " "), F.filter(F.split(plain(F.col("name")), " "), lambda x: F.length(x) > 2)
    share = F.size(F.filter(own, lambda x: F.array_contains(words, x))) / F.greatest(F.size(own), F.lit(1))
    return j.withColumn("relevance", F.when(F.array_contains(words, F.lower("ticker")), 1.0).when(share >= 0.65, 0.9).when(share >= 0.35, 0.72).otherwise(0.45))


def entity_gate(items: DataFrame, rules: DataFrame) -> DataFrame:
    """H11 items with accepted and reason by rules (symbol, ticker, tokens array, brand, context array, collision array).

    An explicit ticker accepts; a collision rejects; all company words accept; the brand needs a context word.
    """
    j = items.join(rules, "symbol", "left").withColumn("_t", tokens(F.coalesce("title", F.lit(""))))
    has = lambda c: F.coalesce(F.size(F.array_intersect("_t", c)) > 0, F.lit(False))
    ticker = F.coalesce(F.array_contains("_t", fold(F.col("ticker"))), F.lit(False))
    whole = F.coalesce((F.size("tokens") > 0) & (F.size(F.array_except("tokens", "_t")) == 0), F.lit(False))
    brand = F.coalesce(F.array_contains("_t", fold(F.col("brand"))), F.lit(False))
    reason = F.when(F.col("ticker").isNull(), "no_rule").when(ticker, "ticker").when(has("collision"), "collision").when(whole, "company").when(brand & has("context"), "brand").when(brand, "ambiguous").otherwise("no_mention")
    return j.withColumn("reason", reason).withColumn("accepted", reason.isin("ticker", "company", "brand")).select(*items.columns, "accepted", "reason")


def security_match(items: DataFrame, universe: DataFrame, strict: bool = False) -> DataFrame:
    """H12 titles that name another ticker of the universe and not their own are rejected; strict: their own must be named.

    universe (symbol, ticker): tickers found in the titles are joined to it, not compared one by one.
    """
    mark = F.explode_outer(F.array_distinct(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(r"\b([A-Z][A-Z0-9]{2,3})\b"), 1)))
    named = items.select("id", F.col("symbol").alias("_own"), mark.alias("ticker")).join(universe, "ticker").groupBy("id").agg(F.bool_or(F.col("symbol") == F.col("_own")).alias("_self"), F.bool_or(F.col("symbol") != F.col("_own")).alias("_other"))
    j = items.join(named, "id", "left")
    own, other = F.coalesce("_self", F.lit(False)), F.coalesce("_other", F.lit(False))
    return j.withColumn("matched", own if strict else own | ~other).drop("_self", "_other")


def entity_audit(gated: DataFrame) -> DataFrame:
    """H13 items and symbols by reason, with the share of all items."""
    return gated.groupBy("reason").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("symbol").alias("symbols")).withColumn("share", F.col("items") / F.sum("items").over(Window.partitionBy()))


def recency_score(items: DataFrame, as_of: str, half: float = 45.0) -> DataFrame:
    """H14 per symbol: mean signed sentiment weighted by quality, materiality and exp(-age / half) up to a date."""
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("published_at"))
    w = F.col("quality") * F.col("materiality") * F.exp(-age / half)
    ok = items.withColumn("_w", w).filter(age >= 0)
    return ok.groupBy("symbol").agg(F.try_divide(F.sum(F.col("signed") * F.col("_w")), F.sum("_w")).alias("news_score"), F.count(F.lit(1)).alias("items"))


def news_windows(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """H15 sentiment, counts and acceleration over the last 1, 5 and 20 sessions of each symbol.

    Items are weighted, summed by effective day, laid on sessions exactly (F3) and then summed by rows.
    """
    w = F.col("materiality") * F.col("quality") * (0.65 + 0.35 * F.col("novelty"))
    day = items.withColumn("date", effective_date()).withColumn("_w", w).groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_w"), F.sum(F.col("signed") * F.col("_w")).alias("_s"))
    df = sessions.select("symbol", "date").join(day, ["symbol", "date"], "left")
    for k in (1, 5, 20):
        rows = Window.partitionBy("symbol").orderBy("date").rowsBetween(-k + 1, 0)
        df = df.withColumns({f"news_n{k}": F.coalesce(F.sum("_n").over(rows), F.lit(0)), f"news_sent{k}": F.try_divide(F.sum("_s").over(rows), F.sum("_w").over(rows))})
    return df.withColumn("news_accel", F.col("news_n5") - F.col("news_n20") / 4.0).drop("_n", "_w", "_s")


#: Event classes that count as fundamental.
FUNDAMENTAL_EVENTS = ("EARNINGS", "FINANCING")


def evidence_features(sessions: DataFrame, items: DataFrame, earnings: str = "EARNINGS", fundamental: tuple[str, ...] = FUNDAMENTAL_EVENTS) -> DataFrame:
    """H16 what was known of each symbol at each session (symbol, date): items of the last 5 and 20 calendar days, nothing later.

    items (symbol, sector, id, available, signed, materiality, quality, confidence, novelty, source_class, event).
    Means are weighted by quality x materiality x confidence (.2 at least), .01 at least. The hierarchical sentiment
    shrinks the symbol's mean of 20 days to its sector's by n / (n + 5), and that to the market's by n / (n + 30).
    Sums by day are laid on days and added up over ranges of days, for symbols, sectors and the market alike.
    """
    w = F.greatest(F.lit(0.01), F.col("quality") * F.col("materiality") * F.greatest(F.lit(0.2), F.col("confidence")))
    it = items.withColumns({"_w": w, "_d": F.unix_date("available"), "_rumour": F.col("source_class") == "RUMOR_UNVERIFIED", "_all": F.lit(1)})
    part = lambda c, x: F.sum(F.when(c, F.col("_w") * F.col(x)))
    earn, fund = F.col("event") == earnings, F.col("event").isin(*fundamental)
    sums = {
        "n": F.count(F.lit(1)), "w": F.sum("_w"), "sent": F.sum(F.col("_w") * F.col("signed")), "mat": F.sum(F.col("_w") * F.col("materiality")), "quality": F.sum(F.col("_w") * F.col("quality")), "novelty": F.sum(F.col("_w") * F.col("novelty")),
        "official": F.count_if(F.col("source_class") == "OFFICIAL"), "clar": F.count_if(F.col("source_class") == "CLARIFICATION"), "rumour": F.count_if("_rumour"), "rumour_w": F.sum(F.when(F.col("_rumour"), F.col("_w"))), "rumour_sent": part(F.col("_rumour"), "signed"),
        "earn": F.count_if(earn), "earn_w": F.sum(F.when(earn, F.col("_w"))), "earn_sent": part(earn, "signed"), "fund": F.count_if(fund), "fund_w": F.sum(F.when(fund, F.col("_w"))), "fund_sent": part(fund, "signed"),
    }

    def windows(keys: list[str], asks: DataFrame, names: list[str], spans: tuple[int, ...]) -> DataFrame:
        """asks (keys, _d) with the sums over the last days, the day itself included; a day's items and the ask share one row."""
        day = it.groupBy(*keys, "_d").agg(*[x.cast("double").alias(f"_{k}") for k, x in sums.items() if k in names])
        both = asks.select(*keys, "_d").distinct().withColumn("_ask", F.lit(True)).join(day, [*keys, "_d"], "full_outer")
        out = {f"{k}{span}": F.coalesce(F.sum(f"_{k}").over(Window.partitionBy(*keys).orderBy("_d").rangeBetween(1 - span, 0)), F.lit(0.0)) for span in spans for k in names}
        return both.withColumns(out).filter("_ask").select(*keys, "_d", *out)

    link = items.select("symbol", "sector").dropDuplicates(["symbol"])
    asks = sessions.select("symbol", "date", F.unix_date("date").alias("_d")).join(link, "symbol", "left")
    own = windows(["symbol"], asks, list(sums), (5, 20))
    sector = windows(["sector"], asks.filter("sector is not null"), ["n", "w", "sent"], (20,)).withColumnsRenamed({f"{k}20": f"sector_{k}" for k in ("n", "w", "sent")})
    market = windows(["_all"], asks.withColumn("_all", F.lit(1)), ["w", "sent"], (20,)).select("_d", F.try_divide("sent20", F.nullif("w20", F.lit(0.0))).alias("market_sent"))
    j = asks.join(own, ["symbol", "_d"], "left").join(sector, ["sector", "_d"], "left").join(market, "_d", "left")
    mean = lambda x, of: F.coalesce(F.try_divide(F.col(x), F.nullif(F.col(of), F.lit(0.0))), F.lit(0.0))
    c = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    a, b = c("n20") / (c("n20") + 5), c("sector_n") / (c("sector_n") + 30)
    hier = a * mean("sent20", "w20") + (1 - a) * (b * mean("sector_sent", "sector_w") + (1 - b) * c("market_sent"))
    return j.select(
        "symbol", "date", c("n5").alias("news_n5"), c("n20").alias("news_n20"), mean("sent20", "w20").alias("news_sent20"), mean("mat20", "w20").alias("news_materiality20"), mean("quality20", "w20").alias("news_quality20"), mean("novelty20", "w20").alias("news_novelty20"),
        mean("official20", "n20").alias("official_share20"), c("clar20").alias("clarification_n20"), hier.alias("hier_sent20"), c("rumour5").alias("rumour_n5"), c("rumour20").alias("rumour_n20"), mean("rumour_sent20", "rumour_w20").alias("rumour_sent20"),
        (c("rumour5") / F.greatest(F.lit(1.0), c("rumour20") / 4)).alias("rumour_velocity"), c("earn20").alias("earnings_n20"), mean("earn_sent20", "earn_w20").alias("earnings_sent20"), c("fund20").alias("fundamental_n20"), mean("fund_sent20", "fund_w20").alias("fundamental_sent20"),
    )


#: Words of no weight in claims; what denies a claim, and what confirms it.
CLAIM_STOP = ("công", "ty", "ctcp", "và", "của", "cho", "với", "một", "các", "được", "theo", "trong", "trên", "sẽ", "đã", "tại")
DENY = ("bác bỏ", "bac bo", "phủ nhận", "phu nhan", "đính chính", "dinh chinh", "không đúng", "khong dung", "tin đồn sai", "tin don sai", "sai sự thật", "sai su that")
CONFIRM = (
    "xác nhận", "xac nhan", "chính thức xác nhận", "chinh thuc xac nhan", "đã ký", "da ky", "ký kết", "ky ket", "phê duyệt", "phe duyet", "thông qua", "thong qua", "chấp thuận",
    "chap thuan", "hoàn tất", "hoan tat",
)


def claim_words(title: Column) -> Column:
    """H17 the distinct words of a title of at least 3 letters or digits that are no stop words."""
    plain = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9à-ỹ]+", " ")
    return F.array_except(F.array_distinct(F.filter(F.split(plain, " "), lambda x: F.length(x) >= 3)), F.array(*map(F.lit, CLAIM_STOP)))


def rumour_claims(rumours: DataFrame, days: int = 30, same: float = 0.28, other: float = 0.5) -> DataFrame:
    """H17 claims: symbol, id, available, event, claim (the id of its first item) of rumours (symbol, id, available, event, title, perhaps published_at).

    A symbol's rumours are taken by day, time and id. Claims are tried from the newest to the oldest, up to the first
    whose last item is more than `days` old; of those similar enough (`same` for one event class, else `other`) the most
    similar takes the item, the newest of equals, and its words. Which claim an item joins depends on those before it,
    so rumours pass through a Python function in order, which keeps the claims within reach only. A pause of more than
    `days` ends all claims, so the stretches between pauses are spread over tasks.
    """
    time = F.col("published_at") if "published_at" in rumours.columns else F.col("available").cast("timestamp_ntz")
    rows = rumours.select("symbol", "id", "available", "event", claim_words(F.col("title")).alias("t"), time.alias("_time"))
    order = Window.partitionBy("symbol").orderBy("available", "_time", "id")
    pause = F.datediff("available", F.lag("available").over(order)) > days
    rows = rows.withColumn("_stretch", F.sum(F.coalesce(pause.cast("int"), F.lit(0))).over(order))

    def assign(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, reach = None, []  # claims as [id, last day, event, words], the oldest first
        for chunk in chunks:
            out = []
            for r in chunk.itertuples():
                if (r.symbol, r.stretch) != at:
                    at, reach = (r.symbol, r.stretch), []
                words, best, chosen = set(r.t), 0.0, None
                for i in range(len(reach) - 1, -1, -1):
                    claim = reach[i]
                    if (r.available - claim[1]).days > days:
                        del reach[: i + 1]  # no later item gets beyond it
                        break
                    similar = len(words & claim[3]) / max(1, len(words | claim[3]))
                    if similar > best and similar >= (same if claim[2] == r.event else other):
                        best, chosen = similar, claim
                if chosen is None:
                    chosen = [r.id, r.available, r.event, set()]
                    reach.append(chosen)
                chosen[1] = max(chosen[1], r.available)
                chosen[3] |= words
                out.append(chosen[0])
            yield chunk[["symbol", "id", "available", "event"]].assign(claim=out)

    ordered = rows.repartition("symbol", "_stretch").sortWithinPartitions("symbol", "_stretch", "available", "_time", "id").withColumnRenamed("_stretch", "stretch")
    return ordered.select("symbol", "id", "available", "event", "t", "stretch").mapInPandas(assign, "symbol long, id long, available date, event string, claim long")


def truth_label(title: Column) -> Column:
    """H18 DENIED, else CONFIRMED, by the published terms; else CLARIFIED."""
    return F.when(hits(title, DENY) > 0, "DENIED").when(hits(title, CONFIRM) > 0, "CONFIRMED").otherwise("CLARIFIED")


def claim_resolution(claims: DataFrame, official: DataFrame, days: int = 90, same: float = 0.24, other: float = 0.45) -> DataFrame:
    """H18 the first official item within `days` of a claim's start that is similar to what was known of it by then: claim, official_id, at, similarity, truth.

    claims (symbol, claim, available, event, title): the items of claims; official (symbol, id, available, event, title,
    perhaps published_at). Known by then: the words of all the claim's items up to the official item's day; `same` is
    asked where one of those has its event class, else `other`. Claims and official items meet over a shared word and
    a stretch of days, so neither a symbol nor a common word joins all with all.
    """
    items = claims.select("symbol", "claim", "available", "event", claim_words(F.col("title")).alias("t"))
    heads = items.groupBy("claim").agg(F.min("available").alias("start"))
    words = items.select("symbol", "claim", "available", F.explode("t").alias("w")).groupBy("symbol", "claim", "w").agg(F.min("available").alias("first"))
    stretch = lambda d: F.floor(F.unix_date(d) / (days + 1))
    time = F.col("published_at") if "published_at" in official.columns else F.col("available").cast("timestamp_ntz")
    o = official.select("symbol", F.col("id").alias("official_id"), F.col("available").alias("at"), time.alias("time"), "event", truth_label(F.col("title")).alias("truth"), claim_words(F.col("title")).alias("ot"))
    asked = o.select("symbol", "official_id", "at", F.explode("ot").alias("w"), stretch(F.col("at")).alias("_s")).withColumn("_s", F.explode(F.array(F.col("_s"), F.col("_s") - 1)))
    met = words.join(heads, "claim").withColumn("_s", stretch(F.col("start"))).join(asked, ["symbol", "w", "_s"]).filter((F.col("at") >= F.col("first")) & (F.datediff("at", "start") <= days))
    shared = met.groupBy("claim", "official_id").agg(F.count(F.lit(1)).alias("both"))
    by = Window.partitionBy("claim").orderBy("first")  # a row for each day on which a claim gained words
    gained = words.groupBy("claim", "first").agg(F.count(F.lit(1)).alias("n")).withColumns({"size": F.sum("n").over(by), "until": F.lead("first").over(by)})
    j = shared.join(o.drop("symbol").withColumn("n_ot", F.size("ot")).drop("ot"), "official_id").join(gained, "claim").filter((F.col("first") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    j = j.withColumn("similarity", F.col("both") / (F.col("size") + F.col("n_ot") - F.col("both")))
    classes = items.groupBy("claim", "event").agg(F.min("available").alias("known"))
    j = j.join(classes, ["claim", "event"], "left").withColumn("_same", F.coalesce(F.col("known") <= F.col("at"), F.lit(False)))
    ok = j.filter(F.col("similarity") >= F.when(F.col("_same"), same).otherwise(other))
    first = ok.groupBy("claim").agg(F.min(F.struct("at", "time", "official_id", "similarity", "truth")).alias("o"))
    return first.select("claim", "o.official_id", "o.at", "o.similarity", "o.truth")


def volume_lead(bars: DataFrame) -> DataFrame:
    """H19 bars with volume_lead: log of one plus the mean volume of the 5 rows before over the median of the 20 before those; 0 without 6 rows before."""
    by = Window.partitionBy("symbol").orderBy("date")
    held = F.array_sort(F.collect_list("volume").over(by.rowsBetween(-25, -6)))
    n = F.size(held)
    base = (F.try_element_at(held, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(held, F.floor(n / 2).cast("int") + 1)) / 2  # the median
    lead = F.log1p(F.avg("volume").over(by.rowsBetween(-5, -1)) / F.greatest(F.lit(1.0), base))
    return bars.withColumn("volume_lead", F.when(F.row_number().over(by) > 6, F.coalesce(lead, F.lit(0.0))).otherwise(0.0))


def claim_features(sessions: DataFrame, items: DataFrame, days: int = 20) -> DataFrame:
    """H19 at each session (symbol, date): what the rumours of the last `days` calendar days look like, as known then.

    items (symbol, id, claim, available, publisher, resolved, truth, volume_lead, premove): a claim counts as resolved
    from its day on; CLARIFIED ones stay unverified, too. An item counts on the days it is recent, so it meets the
    sessions by symbol and date, without a range join. Sessions without rumours have zeros.
    """
    recent = items.withColumn("date", F.explode(F.sequence("available", F.date_add("available", days - 1)))).join(sessions.select("symbol", "date"), ["symbol", "date"])
    none = F.lit("Unknown")
    known = F.when(F.col("resolved") <= F.col("date"), F.coalesce("truth", F.lit("CLARIFIED"))).otherwise("UNVERIFIED")
    claim = recent.groupBy("symbol", "date", "claim").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.coalesce("publisher", none)).alias("sources"), (F.count(F.lit(1)) / (F.datediff(F.max("available"), F.min("available")) + 1)).alias("speed"), F.min(known).alias("state"), F.sum("volume_lead").alias("lead"), F.sum(F.abs("premove")).alias("moved"))
    n, claims = F.sum("n"), F.count(F.lit(1))
    state = lambda *names: F.count_if(F.col("state").isin(*names))
    per = claim.groupBy("symbol", "date").agg(
        claims.alias("rumour_claims"), F.avg("speed").alias("rumour_propagation"), (F.size(F.array_distinct(F.flatten(F.collect_list("sources")))) / n).alias("rumour_diversity"), ((n - claims) / n).alias("rumour_duplication"),
        state("CONFIRMED").alias("rumour_confirmed"), state("DENIED").alias("rumour_denied"), state("CLARIFIED").alias("rumour_clarified"), state("UNVERIFIED", "CLARIFIED").alias("rumour_unverified"), (F.sum("lead") / n).alias("rumour_pre_volume"), (F.sum("moved") / n + 0.25 * F.sum("lead") / n).alias("rumour_lead_score"),
    )
    names = [c for c in per.columns if c not in ("symbol", "date")]
    return sessions.select("symbol", "date").join(per, ["symbol", "date"], "left").fillna(0, names)


def headline_clusters(items: DataFrame, k: int | None = None, seed: int = 7) -> DataFrame:
    """H20 k-means on TF-IDF of title words and pairs; k from the number of items if not given. Items get a cluster."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, SQLTransformer

    n = items.count()
    k = k or int(min(56, max(18, (n / 18) ** 0.5)))
    df = items.withColumn("w", tokens(F.coalesce("title", F.lit(""))))
    stages = [NGram(n=2, inputCol="w", outputCol="b"), SQLTransformer(statement="SELECT *, concat(w, b) AS g FROM __THIS__"), HashingTF(numFeatures=4096, inputCol="g", outputCol="tf"), IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="x"), KMeans(k=min(k, max(1, n)), seed=seed, featuresCol="x", predictionCol="cluster", maxIter=10)]
    return Pipeline(stages=stages).fit(df).transform(df).select(*items.columns, "cluster")


def headline_terms(title: Column) -> Column:
    """H20 the words of two letters and more of a title, in order, and its pairs of neighbours."""
    words = F.filter(F.split(F.regexp_replace(fold(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda x: F.length(x) > 1)
    less = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, less), F.slice(words, 2, less), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def headline_vocabulary(items: DataFrame, least: int = 3, share: float = 0.93, most: int = 5000) -> DataFrame:
    """H20 term, titles, n, place: the `most` commonest terms (then by letters) in at least `least` titles and at most a share of them."""
    terms = items.select("id", F.explode(headline_terms(F.col("title"))).alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("n"))
    known = terms.groupBy("term").agg(F.count(F.lit(1)).alias("titles"), F.sum("n").alias("n"))
    fits = known.crossJoin(F.broadcast(items.agg(F.count(F.lit(1)).alias("_all")))).filter((F.col("titles") >= least) & (F.col("titles") <= share * F.col("_all"))).drop("_all")
    best = fits.orderBy(F.desc("n"), "term").limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "term")))  # `most` rows


def headline_topics(items: DataFrame, vocabulary: DataFrame, k: int, top: int = 10, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """H20 items with a cluster, by k-means on normalised TF-IDF over a vocabulary, and (cluster, place, term, weight): the heaviest terms of each centre.

    The vocabulary and the centres are of bounded size and pass through the driver. An empty vocabulary has no clusters.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer

    terms = [r["term"] for r in vocabulary.orderBy("place").select("term").collect()]
    spark = items.sparkSession
    if not terms:
        return items.withColumn("cluster", F.lit(None).cast("int")), spark.createDataFrame([], "cluster int, place int, term string, weight double")
    counts = CountVectorizerModel.from_vocabulary(terms, "_terms", "_tf")
    rows = written(counts.transform(items.withColumn("_terms", headline_terms(F.col("title")))).drop("_terms"))
    model = Pipeline(stages=[IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_x"), KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster", maxIter=10)]).fit(rows)
    heavy = [(i, place + 1, terms[j], float(c[j])) for i, c in enumerate(model.stages[-1].clusterCenters()) for place, j in enumerate(sorted(range(len(c)), key=lambda j: (-round(c[j], 12), terms[j]))[:top]) if c[j] > 0]  # noqa: B023
    return model.transform(rows).select(*items.columns, "cluster"), spark.createDataFrame(heavy, "cluster int, place int, term string, weight double")


def hashed_text_model(items: DataFrame, label: str, buckets: int = 256):
    """H21 logistic regression on hashed title words and pairs; the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, NGram, Normalizer, SQLTransformer

    df = items.withColumn("w", tokens(F.coalesce("title", F.lit("")))).withColumn("label", F.col(label).cast("double"))
    return Pipeline(stages=[NGram(n=2, inputCol="w", outputCol="b"), SQLTransformer(statement="SELECT *, concat(w, b) AS g FROM __THIS__"), HashingTF(numFeatures=buckets, inputCol="g", outputCol="tf"), Normalizer(inputCol="tf", outputCol="x"), LogisticRegression(featuresCol="x", labelCol="label", regParam=0.01, maxIter=30)]).fit(df)


def latest_evidence(items: DataFrame, as_of: str, n: int = 12) -> DataFrame:
    """H22 each symbol's last n items that were available at a date, newest first."""
    ok = items.withColumn("available", effective_date()).filter(F.col("available") <= F.lit(as_of).cast("date"))
    return ok.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("available"), F.desc("id")))).filter(F.col("place") <= n)


