"""Substring de-duplication: words in a window of 35 that starts anywhere else too are removed.

Windows meet in shards of the corpus, and each shard is searched with an FM-index. What decides the shard is content:
a window's anchor is the least hash of its 8-word runs, so equal windows have equal anchors and meet, whichever
documents they come from, without any document visiting more than the shards of its own anchors. Consecutive windows
with one anchor travel together as a segment (they share most of their words).

1. Places are counted by anchor. Only anchors found twice can hold a repeated window; they set the bits of a filter
   of fixed size.
2. Segments of such anchors are dealt to shards by anchor, with their words; a task sends a segment at most twice (a
   third copy changes nothing) and its words once. Where an anchor has one segment only, which stands in several
   places, one of these sends it and the count another row. Anchors whose segments differ and that are found extremely often
   would make one shard large: their windows travel one by one and are dealt by the hash of the whole window. The
   number of shards follows the counted words.
3. A shard builds an FM-index over its distinct segments, marked where they were sent again, and streams the segments
   against it, many at a time: backward search over a wavelet matrix takes their matching statistics. Spans of
   35 words and more that are found twice are reported, exact copies' and all others' alike.
4. Spans are joined back to the places of their segments. Of the texts, only those with a span are shuffled.

Words, windows and texts are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_KNOWN, checkpointed, map_columns, mix, shuffle_partitions, slices, word_hashes, words_of
from .fm_index import FMIndex
from .membership import bit_filter, passes

WINDOW, ANCHOR = 35, 8
#: Windows that one backward search can cover.
REACH = FMIndex.DEPTH - WINDOW
#: Anchors found so often, or more often where more than MOST_HOT would be, are hot.
LEAST_HOT, MOST_HOT = 5_000, 1 << 16
#: Words that a shard holds at most on average, as they are found (a task sends each segment once).
SHARD_WORDS = 4_000_000


def sliding_least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k neighbours."""
    width = 1
    while 2 * width <= k:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    return np.minimum(x[: len(x) - (k - width)], x[k - width :]) if k > width else x


#: An odd multiplier and its inverse.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """The first n powers of a number; they are made once and as many as a longest slice needs."""
    if len(known.get(base, ())) < n:
        out = np.full(max(4096, 2 * n), base, np.uint64)
        out[0] = 1
        known[base] = np.cumprod(out)
    return known[base][:n]


class Words:
    """The word hashes of several texts, laid end to end, and 64-bit names of any runs of them.

    A name is the sum of the words times falling powers of an odd number, shifted to the run's start and scrambled, so
    equal words have equal names wherever they stand.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes, self.counts = hashes, counts
        self.begins = np.cumsum(counts) - counts
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BACK, len(hashes)))))

    def names(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The names (uint64) of words first..last-1."""
        return mix((self.total[last] - self.total[first]) * _powers(_STEP, len(self.total)).take(first) + (last - first).astype(np.uint64))

    def runs(self, k: int) -> np.ndarray:
        """The names of all runs of k words, those from one text into the next included."""
        n = max(0, len(self.hashes) - k + 1)
        return mix((self.total[k:] - self.total[:n]) * _powers(_STEP, n) + np.uint64(k)) if n else self.hashes[:0]


class Segments:
    """The segments of some texts: anchor, text, first word and first word of the last window + 1, and name of each.

    Windows of hot anchors stand alone, with the window's own name as anchor. runs and of_window are kept for places().
    """

    def __init__(self, words: Words, hot: np.ndarray | None = None) -> None:
        self.words = words
        n = len(words.hashes)
        text = np.repeat(np.arange(len(words.counts)), words.counts)
        at = np.arange(max(0, n - WINDOW + 1))
        self.valid = at + WINDOW <= (words.begins + words.counts)[text[: len(at)]]
        self.runs = words.runs(ANCHOR)
        self.of_window = sliding_least(self.runs, WINDOW - ANCHOR + 1) if len(at) else self.runs[:0]
        windows = np.flatnonzero(self.valid)
        anchors, of = self.of_window[windows], text[windows]
        new = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (of[1:] != of[:-1]))) if len(windows) else np.zeros(0, bool)
        if hot is not None and len(hot) and (alone := np.isin(anchors, hot)).any():
            new |= alone
            new[1:] |= alone[:-1]
            anchors = np.where(alone, words.names(windows, windows + WINDOW), anchors)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(windows)) if len(starts) else starts
        self.anchor, self.text, self.first, self.last = anchors[starts], of[starts], windows[starts], windows[ends - 1] + 1
        self.name = words.names(self.first, self.last + (WINDOW - 1)).view(np.int64)
        self.of_word = text

    def further_places(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, how often): places that are some window's anchor beyond the segments', in texts to keep.

        A place is one if its run's name is the largest of the anchors of all windows over it: they can't be larger.
        Equal windows have their anchors at different places, even where one segment holds both (a text that goes round).
        """
        k = WINDOW - ANCHOR + 1
        edge = np.zeros(k - 1, np.uint64)
        largest = ~sliding_least(~np.concatenate((edge, np.where(self.valid, self.of_window, 0).astype(np.uint64), edge)), k) if len(self.of_window) else self.runs[:0]
        place = np.flatnonzero((largest == self.runs[: len(largest)]) & keep[self.of_word[: len(largest)]])
        mine = np.flatnonzero(keep[self.text])
        if len(place) == len(mine):
            return self.runs[:0], np.empty(0, np.int64)
        key = lambda anchor, text: mix(anchor ^ mix(text.astype(np.uint64)))
        values, index, counts = np.unique(key(self.runs[place], self.of_word[place]), return_index=True, return_counts=True)
        own, known = np.unique(key(self.anchor[mine], self.text[mine]), return_counts=True)
        counts[np.searchsorted(values, own)] -= known
        return self.runs[place[index[counts > 0]]], counts[counts > 0]


def text_name(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _texts(batch: pa.RecordBatch, hot: np.ndarray | None = None) -> Iterator[tuple[int, Segments, list[int]]]:
    """(first row, segments, names of the texts) of the slices of a batch; the text is its last column."""
    own = batch.num_columns - 1
    for a, b in slices(batch, 512, 1_000_000, own):
        words = Words(*word_hashes(batch.column(own).slice(a, b - a).to_pylist()))
        ends = words.begins + words.counts
        yield a, Segments(words, hot), [text_name(words.hashes[x:y]) for x, y in zip(words.begins.tolist(), ends.tolist(), strict=True)]


def _place(ids: np.ndarray, segments: Segments) -> np.ndarray:
    """A number for where each segment stands: its document's id and its place in it."""
    return mix(ids[segments.text].view(np.uint64) ^ mix((segments.first - segments.words.begins[segments.text]).astype(np.uint64))).view(np.int64)


def _with_id(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("text").cast("string"))


def anchor_sums(docs: DataFrame) -> DataFrame:
    """anchor, n, least, most, windows, place of anchors found at least twice: places, least and largest name of a segment, most windows of one, and the least of the segments' places.

    A task counts copies of a text that follow within MOST_KNOWN others twice at most. A segment with its anchor in several places counts as differing ones, as its
    windows may repeat one another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, found, names in _texts(batch):
                keep = np.zeros(len(names), bool)
                for i, name in enumerate(names):
                    seen[name] = seen.get(name, 0) + 1
                    keep[i] = seen[name] <= 2
                if len(seen) > MOST_KNOWN:
                    seen.clear()
                mine, (more, often) = keep[found.text], found.further_places(keep)
                rows = [found.anchor, found.name, found.last - found.first, np.ones(len(mine), np.int64), _place(ids[a : a + len(names)], found)]
                zeros = np.zeros(len(more), np.int64)
                columns = [np.concatenate((x[mine], y)) for x, y in zip(rows, (more, zeros, zeros, often, zeros + np.iinfo(np.int64).max), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["anchor", "segment", "windows", "n", "place"])

    rows = _with_id(docs).mapInArrow(run, "anchor long, segment long, windows long, n long, place long")
    return rows.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("segment").alias("least"), F.max("segment").alias("most"), F.max("windows").alias("windows"), F.min("place").alias("place")).filter("n > 1")


def search_rows(docs: DataFrame, mixed: np.ndarray, chosen: np.ndarray, hot: np.ndarray) -> DataFrame:
    """anchor, segment, words of the segments to search.

    Of anchors whose segments differ (or may) a task sends at most two rows a segment, with the words in the first. Of
    the others, which have one segment each, only the chosen places are sent; the filters may let some more pass,
    never fewer.
    """
    context = docs.sparkSession.sparkContext
    bits, homes, often = context.broadcast(mixed), context.broadcast(chosen), context.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, int] = {}
        sent: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, found, names in _texts(batch, often.value):
                keep = np.zeros(len(names), bool)
                for i, name in enumerate(names):
                    texts[name] = texts.get(name, 0) + 1
                    keep[i] = texts[name] <= 2
                if len(texts) > MOST_KNOWN:
                    texts.clear()
                differ = (passes(bits.value, found.anchor) | ((found.last - found.first == 1) & (len(often.value) > 0))) & keep[found.text]
                home = passes(homes.value, _place(ids[a : a + len(names)], found).view(np.uint64)) & ~differ
                rows = np.flatnonzero(differ | home)
                anchors, segments, words = [], [], []
                hashes = found.words.hashes
                for anchor, segment, x, y in zip(found.anchor[rows].view(np.int64).tolist(), found.name[rows].tolist(), found.first[rows].tolist(), (found.last[rows] + WINDOW - 1).tolist(), strict=True):
                    before = sent.get(segment, 0)
                    if before < 2:
                        anchors.append(anchor)
                        segments.append(segment)
                        words.append(None if before else hashes[x:y].tobytes())
                        sent[segment] = before + 1
                if len(sent) > MOST_KNOWN:
                    sent.clear()
                if anchors:
                    yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(segments, pa.int64()), pa.array(words, pa.binary())], names=["anchor", "segment", "words"])

    return _with_id(docs).mapInArrow(run, "anchor long, segment long, words binary")


def places(docs: DataFrame, repeated: np.ndarray, hot: np.ndarray) -> DataFrame:
    """segment, name, start: which text has the segments of repeated anchors where; once a text and task."""
    context = docs.sparkSession.sparkContext
    bits, often = context.broadcast(repeated), context.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: set[int] = set()
        for batch in batches:
            for _, found, names in _texts(batch, often.value):
                keep = np.zeros(len(names), bool)
                for i, name in enumerate(names):
                    keep[i] = name not in texts
                    texts.add(name)
                if len(texts) > MOST_KNOWN:
                    texts.clear()
                rows = np.flatnonzero((passes(bits.value, found.anchor) | ((found.last - found.first == 1) & (len(often.value) > 0))) & keep[found.text])
                of = found.text[rows]
                yield pa.RecordBatch.from_arrays([pa.array(found.name[rows]), pa.array(np.array(names, np.int64)[of]), pa.array((found.first[rows] - found.words.begins[of]).astype(np.int32))], names=["segment", "name", "start"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "segment long, name long, start int")


def _spans_of(index: FMIndex, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, first window, last window + 1) of the spans of windows that are found twice, of sequences streamed against an index."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    text, begins, windows = index.codes(np.concatenate(sequences)), np.cumsum(lengths) - lengths, lengths - (WINDOW - 1)
    pieces = -(-windows // REACH)
    of = np.repeat(np.arange(len(sequences)), pieces)
    low = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * REACH
    high = np.minimum(low + REACH, windows[of])  # windows low..high-1 of the sequence are still open
    out = [np.empty((3, 0), np.int64)]
    while len(of):
        end = high + WINDOW - 1
        got = index.longest(text, begins[of] + end, end - low)
        hit = got >= WINDOW
        first = end - got  # words first..end-1 are found twice, and so are the windows first..high-1
        out.append(np.stack((of[hit], first[hit], high[hit])))
        # with the word before `first` no window that reaches `end` is: go on with windows up to `first - 1`
        high = np.where(hit, first, high - 1)
        more = high > low
        of, low, high = of[more], low[more], high[more]
    return tuple(np.concatenate(out, axis=1))


def repeated_windows(sequences: list[np.ndarray], weights: np.ndarray, some: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of all sequences, streamed `some` at a time against the index of them all."""
    index, out = FMIndex(sequences, weights), []
    for a in range(0, len(sequences), some):
        of, first, last = _spans_of(index, sequences[a : a + some])
        out.append((of + a, first, last))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _search(shard: pd.DataFrame) -> pd.DataFrame:
    weights = shard.groupby("segment").size()
    known = shard[shard.words.notna()].drop_duplicates("segment")
    sequences = [np.frombuffer(w, np.uint64) for w in known.words]
    if not sequences:
        return pd.DataFrame({"segment": [], "first": [], "last": []}).astype("int64")
    of, first, last = repeated_windows(sequences, weights.loc[known.segment].to_numpy(np.int64))
    return pd.DataFrame({"segment": known.segment.to_numpy()[of], "first": first, "last": last})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """name, spans: for each text with a repeated window, the word spans [from, to) that such windows cover."""
    sums = checkpointed(anchor_sums(docs))
    mixed, single = sums.filter("least <> most"), sums.filter("least = most")
    words, total = sums.agg(F.sum(F.when(F.col("least") == F.col("most"), 1).otherwise(F.least("n", F.lit(1000))) * (F.col("windows") + WINDOW - 1)), F.sum(F.when(F.col("least") != F.col("most"), F.col("n")))).first()
    often = mixed.filter(F.col("n") >= max(LEAST_HOT, -(-(total or 0) // MOST_HOT))).select("anchor").toPandas()
    hot = often.anchor.to_numpy(np.int64).view(np.uint64)
    shards = max(shuffle_partitions(docs.sparkSession), -(-(words or 0) // SHARD_WORDS))
    rows = search_rows(docs, bit_filter(mixed.select("anchor")), bit_filter(single.select("place")), hot)
    rows = rows.unionByName(single.select("anchor", F.col("least").alias("segment"), F.lit(None).cast("binary").alias("words")))  # where a single segment is found again
    spans = rows.select(F.pmod("anchor", F.lit(shards)).cast("int").alias("shard"), "segment", "words").groupBy("shard").applyInPandas(_search, "segment long, first long, last long")
    covered = places(docs, bit_filter(sums.select("anchor")), hot).join(spans, "segment").select("name", (F.col("start") + F.col("first")).alias("from"), (F.col("start") + F.col("last") + WINDOW - 1).alias("to")).distinct()
    return covered.groupBy("name").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Every row of docs (doc_id, text, more): doc_id, n_words, n_removed, kept_sha256 (and kept_text on demand).

    A word goes if a window of WINDOW consecutive words that covers it starts anywhere else too, in this document or
    another; windows are judged on the input. Kept words are joined by one space. Null, empty and shorter texts lose
    nothing. Repeated rows repeat every window, so both lose them. An empty table gives no rows.
    """
    spans = checkpointed(repeated_spans(docs))
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(spans.select("name")))

    def describe(ids, texts):
        hashes, counts = word_hashes(texts)
        names = [text_name(h) for h in np.split(hashes, np.cumsum(counts)[:-1])]
        hit = passes(bits.value, np.array(names, np.int64).view(np.uint64))
        kept = [None if h else b" ".join(words_of(t)) for h, t in zip(hit, texts, strict=True)]
        return ids, names, counts, [t if h else None for h, t in zip(hit, texts, strict=True)], [None if k is None else hashlib.sha256(k).hexdigest() for k in kept], [k.decode("utf-8", "surrogatepass") if with_text and k is not None else None for k in kept]

    rows = map_columns(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), describe, "doc_id long, name long, n_words long, text string, sha string, kept string", rows=256, chars=2_000_000, size_of=1)
    joined = rows.join(spans.withColumnRenamed("name", "_name"), F.col("name") == F.col("_name"), "left").select("doc_id", "n_words", "text", "sha", "kept", "spans")

    def remove(ids, counts, texts, shas, keeps, spans_):
        removed, out_sha, out_text = [], [], []
        for n, text, sha, keep, ranges in zip(counts, texts, shas, keeps, spans_, strict=True):
            if sha is None:
                words, gone = words_of(text), np.zeros(n + 1, np.int64)
                for r in ranges or ():
                    gone[r["from"]] += 1
                    gone[r["to"]] -= 1
                stay = np.cumsum(gone[:-1]) == 0
                kept = b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s])
                removed.append(n - int(stay.sum()))
                out_sha.append(hashlib.sha256(kept).hexdigest())
                out_text.append(kept.decode("utf-8", "surrogatepass"))
            else:
                removed.append(0)
                out_sha.append(sha)
                out_text.append(keep)
        return (ids, counts, removed, out_sha, *([out_text] if with_text else []))

    return map_columns(joined, remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text, rows=512, chars=4_000_000, size_of=2)
