"""Quality rules with risk-controlled thresholds.

Each rule rejects a document when a statistic passes a cutoff. The cutoffs are not set by hand: for each stratum
(language), labelled documents show how often a cutoff would reject a good document, and a cutoff is used only if an
exact binomial test shows that this happens in less than RISK of cases. RISK and the confidence are shared over all
rules and strata (Bonferroni); within a rule the cutoffs are tested from the most lenient to the strictest and the
first that fails ends the row (fixed-sequence testing, which needs no further correction). A stratum with too few
labels gets no cutoff and keeps everything but the base rules' rejects.
"""

from __future__ import annotations

from collections import Counter
from math import exp, lgamma, log, log1p

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, map_columns, words_of

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Base rules: fewest words, and the largest share of repeated words in percent.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: The largest false-rejection rate of a stratum over all rules together, and the chance that any bound is wrong.
RISK, ERROR = 0.05, 0.05
#: name: (per cent of what: the statistic's numerator and denominator, +1 rejects above or -1 below, cutoffs from lenient to strict)
RULES = {
    "symbols": ("n_symbols", "n_words", 1, (400, 300, 200, 150, 100, 75, 50, 30, 20, 10)),
    "long_words": ("word_chars", "n_words", 1, (3000, 2000, 1500, 1200, 1100, 1000, 900, 800)),
    "short_words": ("word_chars", "n_words", -1, (120, 150, 200, 250, 300, 350)),
    "repeats": ("n_repeat_words", "n_words", 1, (18, 15, 12, 10, 8, 6, 4, 2)),
    "lines": ("n_dup_lines", "n_words", 1, (20, 15, 10, 8, 6, 4, 2, 1)),
}
STATS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window found at least twice in the text, the first find included."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 5 - max(i, end)
            end = i + 5
    return covered


def base_counts(text: str | None, words: list[bytes] | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null has no words."""
    text = text or ""
    words = words_of(text) if words is None else words
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the base counts of every row of docs; one pass, no shuffle."""

    def counts(ids, langs, texts):
        return (ids, langs, *zip(*map(base_counts, texts), strict=True))

    return map_columns(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")), counts, STATS, size_of=2)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X, exactly but for rounding.

    The terms are added up from k away from the mean, where they fall geometrically, until they no longer count.
    """
    if k < 0 or k >= n:
        return float(k >= n)
    term = lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p))
    below = k < n * p
    total, i = 0.0, k if below else k + 1
    while 0 <= i <= n and (t := term(i)) > total * 1e-17:
        total, i = total + t, i - 1 if below else i + 1
    return min(1.0, total) if below else max(0.0, 1.0 - total)


def _beyond(rule: str, cutoff):
    over, under, sign, _ = RULES[rule]
    left, right = F.col(over) * 100, F.col(under) * cutoff
    return left > right if sign > 0 else left < right


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per stratum with labels: lang, n_good, and a cutoff for each rule (null: the rule is not used there).

    labels (doc_id, quality): a document labelled more than once counts once, as good if any label says so; so does
    one that stats has several rows of (the least of them). Good documents are counted by stratum and cutoff in one
    aggregation; what leaves it is a few counts per stratum.
    """
    good = labels.select(F.col("doc_id").alias("_id"), "quality").groupBy("_id").agg(F.max("quality").alias("_q")).filter("_q = 1")
    rows = stats.join(good, F.col("doc_id") == F.col("_id"), "left_semi").filter((F.col("n_words") >= LEAST_WORDS) & (F.col("n_repeat_words") * 100 <= F.col("n_words") * MOST_REPEATED))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*[c for c in stats.columns if c != "doc_id"])).alias("one")).select("doc_id", "one.*")  # the bound counts documents
    tests = [(rule, c) for rule, (*_, grid) in RULES.items() for c in grid]
    counted = rows.groupBy("lang").agg(F.count("*").alias("n_good"), *[F.count_if(_beyond(rule, c)).alias(f"{rule}_{c}") for rule, c in tests])
    strata = counted.withColumn("n_strata", F.count("*").over(Window.partitionBy()))  # a row per language, no document

    def choose(groups: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in groups.to_dict("records"):
            row = {"lang": r["lang"], "n_good": r["n_good"]}
            for rule, (*_, grid) in RULES.items():
                row[rule] = None
                for c in grid:
                    if binomial_tail(int(r[f"{rule}_{c}"]), int(r["n_good"]), risk / len(RULES)) > error / (len(RULES) * r["n_strata"]):
                        break
                    row[rule] = c
            out.append(row)
        return pd.DataFrame(out, columns=["lang", "n_good", *RULES])

    return strata.groupBy("lang").applyInPandas(choose, "lang string, n_good long, " + ", ".join(f"{rule} long" for rule in RULES))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text, lang, more) with its base counts, base_failed and kept.

    kept is false if a base rule fails or a statistic passes its stratum's cutoff. Null and empty texts have no words
    and fail the base rules; a null lang is a stratum; without labels only the base rules act. Repeated rows are
    judged alike. An empty table gives no rows.
    """
    stats = checkpointed(statistics(docs))
    limits = cutoffs(stats, labels).withColumnRenamed("lang", "stratum")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    passed = [F.coalesce(_beyond(rule, F.col(rule)), F.lit(False)) for rule in RULES]
    rejected = passed[0]
    for x in passed[1:]:
        rejected = rejected | x
    rows = stats.join(limits, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))
