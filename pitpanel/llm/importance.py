"""Target-distribution importance resampling over hashed n-grams, found by one overlapped scan of each text.

A text's separators collapse to single spaces; a regular expression with boundary look-arounds is then matched at every
word (finditer with overlapped=True). One match spans the 1-, 2- and 3-gram that begin there, as nested groups, so each
n-gram's CRC-32 goes on from that of the n-gram it extends and no byte is read twice for one match. Buckets of a text
are kept as one small compressed blob, so the counts over all documents and the weights of each need no second scan.

Documents are drawn by the largest perturbed weight (Gumbel noise from a hash of the doc_id), which samples without
replacement in proportion to importance and gives the same draw on every run. Ranks come from one sort by range; only
the number of rows of each range is added up.
"""

from __future__ import annotations

import hashlib
import math
import operator
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed, map_columns, shuffle_partitions, slices

BUCKETS, LONGEST, SEED = 10_000, 3, 42
#: Documents of fewer words are never drawn; of the others, PERCENT % are.
LEAST_WORDS, PERCENT = 20, 5
#: Everything but 0-9, a-z and what is not ASCII separates words, once A-Z are lower-cased.
_SPACED = bytes(ord(LOWER[UPPER.index(chr(i))]) if chr(i) in UPPER else i if i > 0x7F or chr(i).isdigit() or chr(i) in LOWER else 0x20 for i in range(256))
#: At each word: the word, and with a space before it each of the next two, where there are any.
_GRAMS = regex.compile(rb"(?<![^ ])([^ ]++)( [^ ]++)?( [^ ]++)?(?![^ ])")
_groups = operator.methodcaller("groups", b"")
#: So many matches are held at a time, however long a text is.
_MATCHES = 200_000


def grams(text: str | None) -> tuple[np.ndarray, int]:
    """The sorted buckets of all n-grams of a text, repeats included, and its number of words."""
    spaced = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_SPACED).split())
    found, words = [], 0
    matches = map(_groups, _GRAMS.finditer(spaced, overlapped=True))
    while part := list(islice(matches, _MATCHES)):
        first, second, third = zip(*part, strict=True)
        one = list(map(zlib.crc32, first))
        two = list(map(zlib.crc32, second, one))
        three = list(map(zlib.crc32, third, two))
        words += len(one)
        ones, twos = sum(map(bool, second)), sum(map(bool, third))  # what is missing is missing at the text's end
        found.append(np.fromiter(chain(one, two[:ones], three[:twos]), np.int64, len(one) + ones + twos) % BUCKETS)
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64), words


def pack(buckets: np.ndarray) -> bytes:
    """Sorted buckets as compressed differences, low bytes before high bytes."""
    return zlib.compress(np.diff(buckets, prepend=0).astype(np.uint16).view(np.uint8).reshape(-1, 2).T.tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(2, -1)
    return np.cumsum(planes[0].astype(np.int64) + (planes[1].astype(np.int64) << 8))


def scanned(texts: DataFrame, key: str) -> DataFrame:
    """key (long), n_words, n_features and the packed buckets of every row's text (column `text`)."""

    def scan(keys, texts_):
        found = [grams(t) for t in texts_]
        return keys, [n for _, n in found], [len(b) for b, _ in found], [pack(b) for b, _ in found]

    return map_columns(texts.select(F.col(key).cast("long"), F.col("text").cast("string")), scan, f"{key} long, n_words long, n_features long, buckets binary", size_of=1)


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many features of all rows fall in each bucket: one row a bucket and task, added up by Spark; BUCKETS rows in the end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(unpack(blob.as_py()), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counts = rows.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[counts.bucket.to_numpy(np.int64)] = counts.n.to_numpy(np.int64)
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target to that in the source, floored."""
    of_source, of_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_source / ((s + 1.0) * of_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variate that depends on the doc_id alone, floored; a null doc_id counts as empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of scanned documents."""
    known = rows.sparkSession.sparkContext.broadcast(gains)  # BUCKETS numbers, whatever the data

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch, 4096, 0, None):
                ids, words, features, blobs = (c.to_pylist() for c in batch.slice(a, b - a).columns)
                weights = [int(known.value[unpack(x)].sum()) for x in blobs]
                scores = [w + noise(i) for w, i in zip(weights, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, words, features, weights, scores)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return rows.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, order: list, parts: int) -> DataFrame:
    """rows with place: 1, 2, 3... by `order`. Rows are dealt out and sorted by range; each range's offset is a sum over the ranges before."""
    placed = checkpointed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("range", F.shiftright("at", 33)).withColumn("within", F.col("at").bitwiseAND((1 << 33) - 1))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    offsets = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(F.broadcast(offsets), "range").withColumn("place", F.col("before") + F.col("within") + 1).drop("at", "range", "within", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text, more), drawn toward target (text, more).

    A-Z are lower-cased; words are runs of 0-9, a-z and characters beyond ASCII; features are all runs of 1 to 3 words.
    Of the documents with at least least_words words, percent % (floored) with the highest scores are drawn: they have a
    rank, ties going to the smaller doc_id (null last; then to fewer features). Null, empty and wordless texts have no
    features and weight 0 and are never drawn; repeated rows are documents of their own with equal scores; an empty
    target only smooths, an empty docs gives no rows.
    """
    rows = checkpointed(scanned(docs, "doc_id"))
    goal = target.select(F.lit(0).alias("key"), F.col("text").cast("string").alias("text"))
    gains = bucket_gains(bucket_counts(rows), bucket_counts(scanned(goal, "key")))
    scored = checkpointed(weighed(rows, gains).withColumn("drawable", F.col("n_words") >= least_words))
    drawn = percent * scored.filter("drawable").count() // 100
    order = [F.col("drawable").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    return ranked(scored, order, shuffle_partitions(docs.sparkSession)).select("doc_id", "n_features", "weight", "score", F.when(F.col("drawable") & (F.col("place") <= drawn), F.col("place")).alias("rank"))
