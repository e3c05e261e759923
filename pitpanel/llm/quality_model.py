"""A quality classifier: histogram gradient-boosted trees over document statistics.

Training: a bounded sample of labelled documents (MOST_LABELLED rows, those with the smallest hash of the doc_id) is
turned into statistics inside Spark tasks; each statistic is binned at quantiles, and trees of fixed depth are grown
level by level on histograms of gradients. Scoring: the trees are complete and lie in flat arrays, so that a batch of
documents walks a tree with DEPTH vectorised steps. The label, lang, source and doc_id are never statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns, words_of
from .quality_rules import base_counts

MOST_LABELLED = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_HESSIAN = 80, 4, 64, 0.2, 1.0, 2.0
STATISTICS = ("words", "chars", "word_length", "symbols", "upper", "digits", "marks", "exclaims", "distinct", "repeats", "dup_lines", "same_next", "lines", "line_words", "one_char", "longest", "stops", "not_ascii")
_CLASSES = np.zeros((256, 6))
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?", "!", ".?")):
    _CLASSES[list(_chars.encode()), _i] = 1
_CLASSES[128:, 5] = 1


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a text; null counts as empty, for which all are 0."""
    text = text or ""
    words = words_of(text)
    n, chars, symbols, dup_lines, repeats = base_counts(text, words)
    if not n:
        return [0.0, float(np.log1p(len(text))), *[0.0] * (len(STATISTICS) - 2)]
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper, digits, marks, exclaims, stops, high = (np.bincount(data, minlength=256) @ _CLASSES).tolist()
    lengths, lines = np.fromiter(map(len, words), np.int64, n), text.count("\n") + 1
    same = sum(map(eq, words, islice(words, 1, None)))
    return [
        np.log1p(n), np.log1p(len(text)), chars / n, symbols / n, upper / n, digits / n, marks / n, exclaims / n, len(set(words)) / n, repeats / n, dup_lines / lines,
        same / n, np.log1p(lines), n / lines, int((lengths == 1).sum()) / n, np.log1p(lengths.max()), stops / n, high / n,
    ]


@dataclass
class Trees:
    """base: the score's logit before any tree; feature, cut: trees x inner nodes; leaf: trees x leaves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees by second-order boosting of the log loss. One class alone, or no rows: a constant score."""
    inner, leaves, k = 2**DEPTH - 1, 2**DEPTH, x.shape[1] if x.ndim == 2 else len(STATISTICS)
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    out = Trees(float(np.log(prior / (1 - prior))), np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)))
    if not len(y) or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    logit, offset = np.full(len(y), out.base), np.arange(k) * BINS
    for t in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        grad, hess, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            slot = ((node - first) * (k * BINS))[:, None] + offset + binned
            g = np.bincount(slot.ravel(), np.repeat(grad, k), width * k * BINS).reshape(width, k, BINS).cumsum(axis=2)
            h = np.bincount(slot.ravel(), np.repeat(hess, k), width * k * BINS).reshape(width, k, BINS).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(h < LEAST_HESSIAN) | (all_h - h < LEAST_HESSIAN)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i in range(width):
                j, b = divmod(int(best[i]), BINS)
                if gain[i, j, b] > 1e-9 and b < len(edges[j]):
                    out.feature[t, first + i], out.cut[t, first + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.cut[t, node])
        at = node - inner
        out.leaf[t] = RATE * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + RIDGE)
        logit += out.leaf[t, at]
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt: crc32 of the doc_id as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Trees:
    """Trees fitted to at most `most` labelled rows outside the held-out third.

    The sample is the rows of labels with the smallest hash of their doc_id, so it does not depend on partitions; its
    ids (at most `most` of them) are broadcast, and at most `most` rows of statistics come back to the driver: of
    several rows with one doc_id that with the least statistics.
    """
    one_each = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    sample = one_each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"), F.col("y").cast("long"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")
    got = map_columns(rows, lambda ids, texts, ys: (ids, [statistics(t) for t in texts], ys), "doc_id long, x array<double>, y long", size_of=1)
    got = got.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("one")).select("doc_id", "one.*").toPandas().sort_values("doc_id", kind="stable")
    return fit(np.array(got.x.tolist(), float).reshape(len(got), len(STATISTICS)), got.y.to_numpy(float))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs; one pass, no shuffle."""

    def scores(ids, out, texts):
        s = trees.probability(np.array([statistics(t) for t in texts], float).reshape(len(texts), len(STATISTICS)))
        return ids, out, s, (s >= 0.5).astype(np.int32)

    return map_columns(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")), scores, "doc_id long, held_out boolean, score double, predicted int", size_of=2)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text, more) scored for quality as `labels` (doc_id, quality) marks it.

    Null texts count as empty and get a score, too. A null doc_id is not held out and never learnt from. A document
    labelled more than once counts once, as good if any label says so. Labels of one class, or none: a constant score.
    """
    return score(docs, train(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with docs' own columns; no shuffle."""
    trees = train(docs, labels)
    names = docs.columns
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("text"))
    return kept.filter(_good(trees)(F.col("text"))).select(*[F.col("row").getField(c).alias(c) for c in names])


def _good(trees: Trees):
    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        keep = np.ones(len(texts), bool)
        for a in range(0, len(texts), 512):
            part = texts.iloc[a : a + 512]
            keep[a : a + 512] = trees.probability(np.array([statistics(t) for t in part], float).reshape(len(part), len(STATISTICS))) >= 0.5
        return pd.Series(keep)

    return good
