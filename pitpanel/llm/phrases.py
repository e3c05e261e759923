"""Phrase collocation mining with count streams in prefix and suffix order.

Counting. Words are counted first. Every part of a phrase that occurs 100 times occurs as often, so only pairs of
frequent words can be frequent, and only runs of frequent pairs longer ones. Two passes therefore tally n-grams by the
leading 32 bits of their hashes, as differences of sorted values, which a shuffle compresses well; a tally can only be
too high, so an n-gram whose tally is too low is never frequent. A last pass counts exactly those that remain. What
remains is told by bit filters of fixed size, which let some strangers pass and withhold no member.

Streams. The counts of all frequent phrases, 1 to 5 words, are one stream. Each candidate is cut after its first k
words, and the cuts are merged with the stream twice by sort-merge joins: ordered by their first part (prefix order)
they meet f(first part), ordered by the rest (suffix order) f(rest). In prefix order each phrase also passes its count
to the phrase that it extends to the right, in suffix order to that which it extends to the left: as counts fall with
length, a phrase lies in a longer one as often found if and only if one of these one-word extensions has its count.
No table of phrases is hashed in memory or broadcast, and a key that many phrases share can be split, as the stream has
one row a phrase.

Phrases are sequences of 64-bit word hashes until the best are known; then the dictionary of frequent words names them.
For n distinct words the chance that two share a hash is n * n / 2^65.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed, hashes_of_words, map_columns, mix, shuffle_partitions, slices, window_hashes
from .membership import bit_filter, passes

LONGEST, LEAST, BEST = 5, 100, 2000
UNKNOWN = "und"
#: A-Z are lower-cased, what ends a piece becomes a line feed, a tab a space.
_PIECES = bytes.maketrans(UPPER.encode() + b".,;:!?\x0b\x0c\r\t", LOWER.encode() + b"\n" * 9 + b" ")
#: Tables of fewer languages are broadcast; larger ones are joined by shuffle.
MOST_BROADCAST = 10_000
#: A ranking is first cut in so many parts a language.
SALTS = 64
#: N-grams that a task of the last pass gathers before it sends them on, added up.
MOST_HELD = 1_000_000
#: Characters for each range of hash values that one task tallies.
RANGE_CHARS = 64_000_000


def by_lang(langs: list[str], texts: list[str | None]) -> Iterator[tuple[str, bytes]]:
    """The pieces of each language's texts: words with spaces between them, pieces with line feeds."""
    found: dict[str, list[bytes]] = {}
    for lang, t in zip(langs, texts, strict=True):
        if t:
            found.setdefault(lang, []).append(t.encode("utf-8", "surrogatepass").translate(_PIECES))
    for lang, parts in found.items():
        yield lang, b"\n".join([*parts, b""])


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n of all words of docs (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emit() -> pa.RecordBatch:
            langs, words = zip(*held, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array([w.decode("utf-8", "surrogatepass") for w in words]), pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for a, b in slices(batch, 512, 4_000_000, 1):
                for lang, data in by_lang(*(c.to_pylist() for c in batch.slice(a, b - a).columns)):
                    for word, n in Counter(data.split()).items():
                        held[lang, word] += n
                if len(held) > 500_000:
                    yield emit()
        if held:
            yield emit()

    return docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def salt_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def named_words(words: DataFrame) -> DataFrame:
    """words (lang, word, n) with h, the word's hash, which differs by language."""

    def name(langs, texts, ns):
        _, h = hashes_of_words(b"\n".join([*(w.encode("utf-8", "surrogatepass") for w in texts), b""]))
        return langs, texts, ns, mix(h ^ np.array([salt_of(x) for x in langs], np.uint64)).view(np.int64)

    return map_columns(words.select("lang", "word", "n"), name, "lang string, word string, n long, h long", rows=4096)


class Runs:
    """The words of some pieces of one language as hashes, and which of their n-grams may be frequent."""

    def __init__(self, lang: str, data: bytes, filters: list[np.ndarray]) -> None:
        starts, h = hashes_of_words(data)
        self.words = mix(h ^ salt_of(lang))
        ends = np.cumsum(np.frombuffer(data, np.uint8) == 10)
        self.piece = ends[starts]
        self.filters = filters
        self.fits = {1: passes(filters[0], self.words)}  # by length: whether the n-gram at a place may be frequent

    def names(self, k: int) -> np.ndarray:
        return window_hashes(self.words, k)

    def possible(self, k: int) -> np.ndarray:
        """Where an n-gram of k words lies within a piece and its parts of k - 1 words may be frequent."""
        part = self.found(k - 1)
        n = len(self.words) - k + 1
        return part[:n] & part[1 : n + 1] & (self.piece[:n] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, bool)

    def found(self, k: int) -> np.ndarray:
        """Where an n-gram of k words may be frequent: possible, and not ruled out by the filter of its length."""
        if k not in self.fits:
            here = self.possible(k)
            if k - 1 < len(self.filters) and here.any():
                here[here] = passes(self.filters[k - 1], self.names(k)[here])
            self.fits[k] = here
        return self.fits[k]


def _tallied(docs: DataFrame, filters: list[np.ndarray], lengths: tuple[int, ...], ranges: int, least: int) -> DataFrame:
    """length, name: the leading 32 bits of hashes that n-grams of these lengths were found under at least `least` times."""
    known = docs.sparkSession.sparkContext.broadcast(filters)  # 8 MB each
    width = -(-(1 << 32) // ranges)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {k: [] for k in lengths}
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for k, parts in held.items():
                if parts:
                    values, counts = np.unique(np.concatenate(parts), return_counts=True)
                    cuts = np.searchsorted(values, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
                    at = [i for i in range(ranges) if cuts[i] < cuts[i + 1]]
                    blobs = [[_planes(x) for x in (np.diff(values[cuts[i] : cuts[i + 1]], prepend=np.uint32(0)), counts[cuts[i] : cuts[i + 1]].astype(np.uint32))] for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array([x for x, _ in blobs], pa.binary()), pa.array([x for _, x in blobs], pa.binary())], names=["length", "part", "names", "counts"])
                    parts.clear()

        for batch in batches:
            for a, b in slices(batch, 512, 4_000_000, 1):
                for lang, data in by_lang(*(c.to_pylist() for c in batch.slice(a, b - a).columns)):
                    runs = Runs(lang, data, known.value)
                    for k in lengths:
                        here = runs.possible(k)
                        if here.any():
                            held[k].append((runs.names(k)[here] >> np.uint64(32)).astype(np.uint32))
                            size += len(held[k][-1])
                if size > 4_000_000:
                    yield from emit()
                    size = 0
        yield from emit()

    def total(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([np.cumsum(_unplaned(x), dtype=np.uint64) for x in blobs.names])
        counts = np.concatenate([_unplaned(x) for x in blobs.counts]).astype(np.int64)
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        starts = np.flatnonzero(np.diff(values, prepend=np.uint64(1 << 40)) != 0)
        often = values[starts][np.add.reduceat(counts, starts) >= least]
        return pd.DataFrame({"length": np.full(len(often), key[0], np.int32), "name": (often << np.uint64(32)).view(np.int64)})

    return docs.mapInArrow(tally, "length int, part int, names binary, counts binary").groupBy("length", "part").applyInPandas(total, "length int, name long")


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def _counted(docs: DataFrame, filters: list[np.ndarray], ranges: int, least: int) -> DataFrame:
    """lang, words (hashes), n of the n-grams of 2 words and more that pass the filters and occur at least `least` times.

    Tasks add up what they find, deal it out by ranges of the n-grams' hashes and send each range as one packed row.
    """
    known = docs.sparkSession.sparkContext.broadcast(filters)  # 8 MB each
    width = -(-(1 << 64) // ranges)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, k), parts in held.items():
                names, words, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
                names, first, of = np.unique(names, return_index=True, return_inverse=True)
                words, counts = words[first], np.bincount(of, counts).astype(np.int64)
                cuts = np.append(np.searchsorted(names, np.array([i * width for i in range(ranges)], np.uint64)), len(names))
                at = [i for i in range(ranges) if cuts[i] < cuts[i + 1]]
                blobs = [pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in at], pa.binary()) for x in (names, counts, words)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array([k] * len(at), pa.int32()), pa.array(at, pa.int32()), *blobs], names=["lang", "length", "part", "names", "counts", "words"])
            held.clear()

        for batch in batches:
            for a, b in slices(batch, 512, 4_000_000, 1):
                for lang, data in by_lang(*(c.to_pylist() for c in batch.slice(a, b - a).columns)):
                    runs = Runs(lang, data, known.value)
                    for k in range(2, len(filters) + 1):
                        at = np.flatnonzero(runs.found(k))
                        if not len(at):
                            break
                        names, first, counts = np.unique(runs.names(k)[at], return_index=True, return_counts=True)
                        held.setdefault((lang, k), []).append((names, runs.words[at[first][:, None] + np.arange(k)].view(np.int64), counts))
                        size += len(names)
                if size > MOST_HELD:
                    yield from emit()
                    size = 0
        yield from emit()

    def total(key: tuple, blobs: pa.Table) -> pa.Table:
        k = key[1].as_py()
        names, counts, words = (np.concatenate([np.frombuffer(x, kind) for x in blobs.column(c).to_pylist()]) for c, kind in (("names", np.uint64), ("counts", np.int64), ("words", np.int64)))
        _, first, of = np.unique(names, return_index=True, return_inverse=True)
        n = np.bincount(of, counts).astype(np.int64)
        often = n >= least
        kept = words.reshape(-1, k)[first[often]]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, kept.size + 1, k), pa.int32()), pa.array(kept.ravel(), pa.int64()))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(kept), pa.string()), "words": lists, "n": pa.array(n[often], pa.int64())})

    packed = docs.mapInArrow(count, "lang string, length int, part int, names binary, counts binary, words binary")
    return packed.groupBy("lang", "length", "part").applyInArrow(total, "lang string, words array<long>, n long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (lang, text): (lang, n words), (lang, word, h, n) of the frequent words, (lang, words, n) of all frequent phrases."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(16, shuffle_partitions(docs.sparkSession), chars // RANGE_CHARS)
    counted = checkpointed(word_counts(docs))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = checkpointed(named_words(counted.filter(F.col("n") >= least)))
    filters = [bit_filter(words.select("h"))]
    for lengths in ((2,), tuple(range(3, longest + 1))):  # pairs of frequent words; then runs of frequent pairs
        if lengths:
            tallied = checkpointed(_tallied(docs, filters, lengths, ranges, least))
            filters += [bit_filter(tallied.filter(F.col("length") == k).select("name")) for k in lengths]
    longer = _counted(docs, filters[:longest], ranges, least)
    return totals, words, checkpointed(words.select("lang", F.array("h").alias("words"), "n").unionByName(longer))


def scored(stream: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, words, a, l, r, n, score of the candidates of a stream (lang, words, n) that no longer one replaces.

    Sort-merge joins in prefix and in suffix order; the score is exact in decimals of 38 digits.
    """
    size = F.size("words")
    candidates = stream.filter(size > 1).withColumnRenamed("n", "a")
    up = lambda start: candidates.select("lang", F.slice("words", start, size - 1).alias("part"), "a")
    extended = up(1).unionByName(up(2)).groupBy("lang", "part").agg(F.max("a").alias("most")).withColumnRenamed("part", "words")
    kept = candidates.hint("merge").join(extended.hint("merge"), ["lang", "words"], "left").filter(F.coalesce("most", F.lit(0)) < F.col("a")).drop("most")
    cuts = kept.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.slice("words", 1, F.col("cut"))).withColumn("rest", F.slice("words", F.col("cut") + 1, F.size("words") - F.col("cut")))
    part = lambda name, count: stream.select("lang", F.col("words").alias(name), F.col("n").alias(count)).hint("merge")
    cuts = cuts.hint("merge").join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    few = totals.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    cuts = cuts.join(F.broadcast(totals) if few else totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("cast(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(19,0)) as decimal(38,0))")
    cuts = cuts.withColumn("up", score).withColumn("down", (exact("l") * exact("r")).cast("decimal(38,0)")).withColumn("score", F.expr("up div down"))
    worst = F.min(F.struct("score", "cut", "l", "r", "a", "n"))
    return cuts.groupBy("lang", "words").agg(worst.alias("w")).select("lang", "words", "w.a", "w.l", "w.r", "w.n", "w.score")


def best_phrases(docs: DataFrame, least: int = LEAST, best: int = BEST, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of 2 to `longest` words in docs (lang, text, more).

    A-Z are lower-cased; texts are split at . , ; : ! ? and line ends into pieces, these at spaces and tabs into words.
    n is the number of words of the language (null: und). A phrase is a candidate if it occurs at least `least` times
    within pieces, overlaps included (a). Cut after some first words it gives l and r, the counts of both parts, and the
    score floor(1000 * a * n / (l * r)); the lowest cut counts, of equal ones the shortest first part. Candidates that
    lie in a longer candidate with as many occurrences are left out. Ranks go by score and a, both falling, then by the
    phrase's bytes. Null and empty texts have no words, repeated rows count again, an empty table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    totals, words, stream = frequent_phrases(texts, least, longest)
    found = checkpointed(scored(stream, totals))
    order = [F.col("score").desc(), F.col("a").desc()]
    for salted in (True, False):  # ties stay in, whatever their number, until the phrases are known
        part = Window.partitionBy("lang", *([F.pmod(F.xxhash64("words"), F.lit(SALTS))] if salted else [])).orderBy(*order)
        found = found.withColumn("place", F.rank().over(part)).filter(F.col("place") <= best)
    found = checkpointed(found.drop("place"))
    each = found.select("lang", "words", F.posexplode("words").alias("at", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
    names = each.groupBy("lang", "words").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x.word)).alias("phrase"))
    place = Window.partitionBy("lang").orderBy(*order, "phrase")
    return found.join(names, ["lang", "words"]).withColumn("rank", F.row_number().over(place).cast("long")).filter(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
