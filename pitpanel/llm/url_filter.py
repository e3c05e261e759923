"""URL rules, and a logistic regression on hashed character n-grams for the URLs that no rule decides.

The model learns from a small labelled URL table (url, label 1 = block). The n-grams are made by DataFrame functions
and hashed by MLlib, so judging URLs needs no Python and no shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import url_labels
from .common import LOWER, UPPER

#: The rules of the query, (rule, verdict).
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
SIZES, BUCKETS = (3, 4, 5), 1 << 14
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where no :// is."""
    u = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(u, _PARTS, 1), UPPER, LOWER), F.regexp_extract(u, _PARTS, 2)


def fits(rule: str) -> Column:
    """Whether a rule fits columns host and path: the rule's host or a subdomain of it, and a path that starts with the rule's."""
    at = rule.index("/")
    host, path = rule[:at], rule[at:]
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def n_grams(name: str) -> Column:
    """The character n-grams of a column, marked by the column's name and with its ends shown."""
    s = F.concat(F.lit("^"), F.col(name), F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(name[0] + str(n)), F.substring(s, i, F.lit(n))))

    grams = [of_size(n) for n in SIZES]
    return F.concat(*grams)


def featured(urls: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_grams", outputCol="_features").transform(urls.withColumn("_grams", F.concat(n_grams("host"), n_grams("path")))).drop("_grams")


def train(labelled: DataFrame) -> LogisticRegressionModel | None:
    """The model of a labelled table (host, path, label); None if the table is empty."""
    rows = featured(labelled.select("host", "path", F.col("label").cast("double").alias("label")))
    if rows.isEmpty():
        return None
    return LogisticRegression(featuresCol="_features", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_prediction", regParam=1e-3, maxIter=40).fit(rows)


def judge(pages: DataFrame, rules: tuple = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """Every row of pages (page_id, url, more): page_id, host, path, rule, verdict, block_score.

    The longest rule that fits decides; where none fits the model does (block at 0.5 or more). labelled: a table
    (host, path, label); by default that of url_labels. What the rules say is never learnt. Null URLs and URLs
    without :// have empty host and path and are judged as such; with no labelled URL at all the rest is allowed.
    Repeated rows are judged alike.
    """
    host, path = parts()
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    by_length = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    ruled = urls.withColumn("rule", F.coalesce(F.lit(None).cast("string"), *[F.when(fits(r), F.lit(r)) for r, _ in by_length]))
    said = F.lit(None).cast("string")
    for r, verdict in rules:
        said = F.when(F.col("rule") == r, F.lit(verdict)).otherwise(said)
    ruled = ruled.withColumn("verdict", said)
    model = train(url_labels.table(pages.sparkSession) if labelled is None else labelled)
    if model is None:
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("block_score"))
    scored = model.transform(featured(ruled)).withColumn("block_score", vector_to_array("_p")[1])
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")
