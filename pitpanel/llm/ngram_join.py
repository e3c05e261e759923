"""N-gram Jaccard join with token-combination prefixes.

A document's set holds the hashes of its distinct 5-word shingles. Sets are ordered with rare shingles first, frequent
ones last. Two sets that reach the threshold differ in few shingles, so a prefix of that order must share something:

* a rare shingle of the prefix is indexed by itself;
* frequent shingles are dealt out to classes, and of each class the 2-combinations in the prefix are indexed. A class
  with c shingles in the prefix shares a combination unless c - 1 of them are missing on the other side, so the prefix
  is extended until (rare shingles) + sum(c - 1) exceeds the number of shingles that may differ. Then two sets over the
  threshold always share an entry, whatever is frequent: the classes only decide how selective the index is.

The number of classes follows the size band of the smaller set; a set is indexed for its own band and for that of the
smallest partner it can have.

Positions. Each entry says how many shingles must be allowed to differ before it belongs to the prefix (`at`). How many
may differ in a pair follows from both sizes, and two sets over the threshold share an entry that lies in both prefixes
of that length. Entries further back make no pair: copies of one original that have strayed too far to link with it
have enough rare shingles of their own, and so no longer meet in what is frequent.

Groups of copies. Documents with one and the same set are one node. Each node is first compared with one pivot only,
that of the entries it shares most of; then nodes that share an entry but lie in different components are compared, so
n copies of an original take n comparisons. No link between components is lost, and links inside a component cannot
change the result. Pairs are verified in two steps: bitmaps of the sets bound the difference from below, and only
pairs that pass have their sets fetched and intersected exactly.

Entries of which very many sets may be found are dealt out to several tasks, and large entries are joined by size
class, so that no task meets a whole group.

Sets and shingles are named by 64-bit hashes; for n distinct sets the chance that two share a name is n * n / 2^65.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import MOST_KNOWN, checkpointed, mix, shuffle_partitions, slices, window_hashes, word_hashes
from .components import components
from .membership import bit_filter, passes

SHINGLE, PERCENT = 5, 80
#: A shingle is frequent if it was found so often (a power of 2), or more often where more than MOST_FREQUENT would be.
LEAST_FREQUENT, MOST_FREQUENT = 16, 1 << 22
#: One class of frequent shingles for so many shingles of a set's size band.
CLASS_SHINGLES = 4
#: Shingles found so often are hot; entries of two of them are dealt out to SALTS tasks. Other entries have fewer rows.
HOT, SALTS = 4096, 64
#: Entries with so many rows are joined by classes of sizes, each CLASS_RATIO times the one before.
LARGE, CLASS_RATIO = 64, 1.05
#: Characters for each range of shingle values that one task tallies.
RANGE_CHARS = 64_000_000


class Frequent(NamedTuple):
    """Sorted leading 32 bits of the frequent shingles, and of those that are hot."""

    tokens: np.ndarray
    hot: np.ndarray


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer words the whole sequence's; none for null or no words."""
    hashes, counts = word_hashes(texts, lower=True)
    windows, at, out = window_hashes(hashes, size), 0, []
    for n in counts.tolist():
        found = windows[at : at + n - size + 1] if n >= size else window_hashes(hashes[at : at + n], n) if n else hashes[:0]
        found = np.sort(found)
        out.append(found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) > 1 else found)
        at += n
    return out


def set_name(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def may_differ(n: int, percent: int = PERCENT) -> int:
    """How many members of a set of n may be missing from a set that reaches the threshold with it."""
    return n - -(-percent * n // 100)


def band(n: int) -> int:
    """The size band of a set: sizes of one band differ by less than a quarter."""
    return int(math.log(n) / math.log(1.25) + 1e-9)


def bands(n: int, percent: int = PERCENT) -> range:
    """Size bands of the smaller set of any pair that a set of n can be part of."""
    return range(band(-(-percent * n // 100)), band(n) + 1)


def overlap(n, m, percent: int = PERCENT):
    """How many shingles sets of n and m (numbers or columns of integers) must share to reach the threshold."""
    if isinstance(n, Column):
        return F.floor(((n + m) * percent + (99 + percent)) / (100 + percent))
    return -(-percent * (n + m) // (100 + percent))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array known."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def index_entries(tokens: np.ndarray, frequent: Frequent, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index entries of a set, where each stands (`at`), and whether it may be found in very many sets.

    Entries of single shingles are even, those of combinations odd. An entry belongs to the prefix for a partner that
    may lack k of the set's shingles if at <= k. A set of one token has none: it links with equal sets only.
    """
    n = len(tokens)
    if n < 2:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    most, one = may_differ(n, percent), np.uint64(1)
    short = (tokens >> np.uint64(32)).astype(np.uint32)
    common = _among(short, frequent.tokens)
    rare = tokens[~common][: most + 1]
    out, at, hot = [mix(rare) & ~one], [np.arange(len(rare))], [np.zeros(len(rare), bool)]
    often, very = tokens[common], _among(short[common], frequent.hot)
    for of_size in bands(n, percent):
        least = max(math.ceil(1.25**of_size - 1e-6), -(-percent * n // 100))  # the smallest partner of the band
        k = n - overlap(n, min(least, n), percent)
        if len(rare) > k:
            continue
        classes = max(1, int(1.25**of_size) // CLASS_SHINGLES)
        of = (mix(often) % np.uint64(classes)).astype(np.int64)
        first = np.zeros(len(often), bool)
        first[np.unique(of, return_index=True)[1]] = True
        before = np.cumsum(~first) - ~first + len(rare)
        upto = int(np.searchsorted(before, k, "right"))
        order = np.argsort(of[:upto], kind="stable")
        of, prefix, place, many = of[order], often[order], before[order], very[order]
        for step in range(1, upto):
            same = of[step:] == of[:-step]
            if not same.any():
                break
            out.append(mix(mix(prefix[:-step][same] + np.uint64(of_size)) * np.uint64(3) + prefix[step:][same]) | one)
            at.append(place[step:][same])
            hot.append(many[:-step][same] & many[step:][same])
    entries, index = np.unique(np.concatenate(out), return_index=True)
    return entries, np.concatenate(at)[index], np.concatenate(hot)[index]


def _frequency_blobs(docs: DataFrame, ranges: int) -> DataFrame:
    """part, tokens, counts: the leading 32 bits of each task's shingles with their counts, dealt out by value.

    A text that a task has seen shortly before is not counted again. Values are sorted, stored as differences and by byte
    planes, which Spark's shuffle compression then packs.
    """
    width = -(-(1 << 32) // ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def emit(found: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(found), return_counts=True)
            cuts = np.searchsorted(values, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
            parts = [i for i in range(ranges) if cuts[i] < cuts[i + 1]]
            gaps = [np.diff(values[cuts[i] : cuts[i + 1]], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for i in parts]
            tally = [counts[cuts[i] : cuts[i + 1]].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for i in parts]
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(gaps, pa.binary()), pa.array(tally, pa.binary())], names=["part", "tokens", "counts"])

        found, held = [], 0
        for batch in batches:
            for a, b in slices(batch, 256, 2_000_000, 0):
                for tokens in shingle_sets(batch.column(0).slice(a, b - a).to_pylist()):
                    name = set_name(tokens)
                    if len(tokens) > 1 and name not in seen:
                        seen.add(name)
                        found.append((tokens >> np.uint64(32)).astype(np.uint32))
                        held += len(tokens)
                if held > 4_000_000:
                    yield emit(found)
                    found, held = [], 0
                if len(seen) > MOST_KNOWN:
                    seen.clear()
        if found:
            yield emit(found)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "part int, tokens binary, counts binary")


def _tally(blobs: pd.DataFrame) -> pd.DataFrame:
    planes = lambda x: np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
    values = np.concatenate([np.cumsum(planes(x), dtype=np.uint64) for x in blobs.tokens])
    counts = np.concatenate([planes(x) for x in blobs.counts]).astype(np.int64)
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    starts = np.flatnonzero(np.diff(values, prepend=np.uint64(2**40)) != 0)
    values, counts = values[starts], np.add.reduceat(counts, starts)
    often = counts >= LEAST_FREQUENT
    return pd.DataFrame({"token": values[often].astype(np.int64), "n": counts[often]})


def frequent_tokens(docs: DataFrame) -> Frequent:
    """The frequent shingles of all docs; at most MOST_FREQUENT, so 16 MB.

    Every shingle is counted. The threshold is LEAST_FREQUENT times the least power of 2 that leaves MOST_FREQUENT of them.
    """
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    ranges = max(16, shuffle_partitions(docs.sparkSession), chars // RANGE_CHARS)
    counted = checkpointed(_frequency_blobs(docs, ranges).groupBy("part").applyInPandas(_tally, "token long, n long"))
    sizes = counted.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("tokens")).toPandas()  # a row for each power of 2
    least = LEAST_FREQUENT
    while sizes.tokens[sizes.power >= least.bit_length() - 1].sum() > MOST_FREQUENT:
        least *= 2
    found = counted.filter(F.col("n") >= least).select("token", (F.col("n") >= HOT).alias("hot")).toPandas()
    short = found.token.to_numpy(np.int64).astype(np.uint32)
    return Frequent(np.unique(short), np.unique(short[found.hot.to_numpy(bool)]))


def shared_entries(docs: DataFrame, frequent: Frequent, percent: int = PERCENT) -> DataFrame:
    """entry, node, n, at, other: index entries that at least two different sets have; one shuffle, by entry.

    n is the size of the node's set. An entry of just two sets is one row, which names the other node, and only if it
    lies in both prefixes; elsewhere `other` is null. Entries of two hot shingles are dealt out by node too and not tested.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in slices(batch, 64, 500_000, 0):
                nodes, found = [], []
                for tokens in shingle_sets(batch.column(0).slice(a, b - a).to_pylist()):
                    name = set_name(tokens)
                    if len(tokens) > 1 and name not in seen:
                        seen.add(name)
                        nodes.append((name, len(tokens)))
                        found.append(index_entries(tokens, known.value, percent))
                if len(seen) > MOST_KNOWN:
                    seen.clear()
                if not nodes:
                    continue
                entries, at, hot = (np.concatenate(x) for x in zip(*found, strict=True))
                node, n = (np.repeat(np.array(x, np.int64), [len(f[0]) for f in found]) for x in zip(*nodes, strict=True))
                salt = np.where(hot, 1 + (node.view(np.uint64) % np.uint64(SALTS)).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(entries.view(np.int64)), pa.array(node), *(pa.array(x.astype(np.int32)) for x in (n, at, salt))], names=["entry", "node", "n", "at", "salt"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "entry long, node long, n int, at int, salt int")
    of = Window.partitionBy("entry", "salt")
    dealt = rows.repartition(shuffle_partitions(docs.sparkSession), "entry", "salt")
    shared = dealt.withColumn("least", F.min("node").over(of)).withColumn("most", F.max("node").over(of)).filter("least < most or salt > 0")
    shared = shared.dropDuplicates(["entry", "salt", "node"]).select("entry", "node", F.col("n").alias("na"), F.col("at").alias("ata"), "salt")
    last = F.max(F.struct("node", F.col("na").alias("nb"), F.col("ata").alias("atb"))).over(of)
    shared = shared.withColumn("last", last).withColumn("two", (F.col("salt") == 0) & (F.count(F.lit(1)).over(of) == 2)).select("*", "last.nb", "last.atb")
    kept = shared.filter(~F.col("two") | ((F.col("node") != F.col("last.node")) & _in_prefixes(percent)))
    return kept.select("entry", "node", F.col("na").alias("n"), F.col("ata").alias("at"), F.when(F.col("two"), F.col("last.node")).alias("other"))


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each token's remainder; the number of bits is a power of 2, at least twice the number of tokens.

    Folded to one length by OR, the bitmaps of two sets differ in no more bits than the sets differ in tokens.
    """
    bits = np.zeros(1 << max(6, (2 * len(tokens) - 1).bit_length()), bool)
    bits[(mix(tokens) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def bits_differ(x: bytes, y: bytes) -> int:
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_or.reduce(b.reshape(-1, len(a)))).sum())


@F.pandas_udf(LongType())
def _bits_differ(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([bits_differ(a, b) for a, b in zip(x, y, strict=True)], dtype="int64")


def _each_set(docs: DataFrame, keep: np.ndarray, columns: list[Column], schema: str, described: Callable[[np.ndarray], object], kind: pa.DataType) -> DataFrame:
    """columns of docs, node (null without words), n, and what `described` says of the set where node may be in a filter, once a task."""
    bits, names = docs.sparkSession.sparkContext.broadcast(keep), [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            own = batch.num_columns - 1
            for a, b in slices(batch, 256, 2_000_000, own):
                found = shingle_sets(batch.column(own).slice(a, b - a).to_pylist())
                nodes = [set_name(x) if len(x) else None for x in found]
                wanted = passes(bits.value, np.array([n or 0 for n in nodes], np.int64).view(np.uint64)).tolist()
                said = []
                for node, x, may in zip(nodes, found, wanted, strict=True):
                    said.append(described(x) if may and node is not None and node not in seen else None)
                    seen.add(node)
                if len(seen) > MOST_KNOWN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(own)), pa.array(nodes, pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(said, kind)], names=names)

    return docs.select(*columns, F.col("text").cast("string")).mapInArrow(run, schema)


def named_rows(docs: DataFrame, bitmaps_for: np.ndarray) -> DataFrame:
    """doc_id, text_hash, node, n of every row of docs, and the bitmap of sets that may be in a filter."""
    columns = [F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))]
    return _each_set(docs, bitmaps_for, columns, "doc_id long, text_hash long, node long, n long, bits binary", bitmap, pa.binary())


def sets_of(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """node, tokens: the sets that may be in a filter, one row each."""
    rows = _each_set(docs, wanted, [], "node long, n long, tokens array<long>", lambda x: x.view(np.int64), pa.list_(pa.int64()))
    return checkpointed(rows.filter("tokens is not null").select("node", "tokens").dropDuplicates(["node"]))


def _in_prefixes(percent: int) -> Column:
    """Whether a shared entry lies in both prefixes that the pair's sizes call for (columns na, ata, nb, atb)."""
    need = overlap(F.col("na"), F.col("nb"), percent)
    return (F.col("ata") <= F.col("na") - need) & (F.col("atb") <= F.col("nb") - need)


def _pivot_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """a, b: each node with the pivot that it shares most entries with, where the pair may link.

    The pivot of an entry is the node in whose prefix it comes first: an original has fewer rare shingles than copies.
    """
    first = F.min(F.struct(F.col("at").alias("atb"), F.col("node").alias("b"), F.col("n").alias("nb")))
    pivots = checkpointed(entries.groupBy("entry").agg(first.alias("p"), (F.min("node") < F.max("node")).alias("shared")).filter("shared").select("entry", "p.*"))
    near = entries.select("entry", F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("ata")).join(pivots, "entry").filter((F.col("a") != F.col("b")) & _in_prefixes(percent))
    best = near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).groupBy("a").agg(F.max(F.struct("k", "b")).alias("best"))
    return best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(CLASS_RATIO)).cast("int")


def _pairs_apart(entries: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """a, b: nodes of different components that share an entry in both their prefixes.

    Of an entry's rows only those outside its commonest component look for partners, so a group that is one component
    already makes no pairs. In large entries a row looks only into the size classes that its place in the prefix allows.
    """
    rows = entries.join(comp, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per = rows.groupBy("entry", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("entry").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("c"), F.count(F.lit(1)).alias("labels"))
    several = checkpointed(per.filter("labels > 1").select("entry", F.col("top.label").alias("top"), (F.col("c") >= LARGE).alias("large")))
    open_ = checkpointed(rows.join(several, "entry"))
    n, none = F.col("n"), F.lit(-1)
    least = F.ceil(n * percent / 100)
    most = F.least(F.floor((n - F.col("at")) * (100 + percent) / percent) - n, F.floor(n * 100 / percent))
    sizes = F.when(F.col("large"), F.sequence(_size_class(least), _size_class(F.greatest(most, least)))).otherwise(F.array(none))
    seek = open_.filter("label <> top").select("entry", F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("ata"), F.col("label").alias("la"), F.explode(sizes).alias("class"))
    there = open_.select("entry", F.when(F.col("large"), _size_class(n)).otherwise(none).alias("class"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("at").alias("atb"), F.col("label").alias("lb"), "top")
    met = seek.join(there, ["entry", "class"]).filter((F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("top")) | (F.col("a") < F.col("b"))) & _in_prefixes(percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _both(pairs: DataFrame, of_node: DataFrame, *columns: str) -> DataFrame:
    """pairs with columns of a's node (suffix a) and of b's (suffix b)."""
    for x in "ab":
        pairs = pairs.join(of_node.select(F.col("node").alias(x), *[F.col(c).alias(c + x) for c in columns]), x)
    return pairs


def _may_link(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps (node, n, bits) do not differ in more bits than linked sets can in tokens."""
    most = F.col("na") + F.col("nb") - 2 * overlap(F.col("na"), F.col("nb"), percent)
    return _both(pairs, bitmaps, "n", "bits").filter(_bits_differ("bitsa", "bitsb") <= most).select("a", "b")


def _linked(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """u, v: the pairs (a, b) whose sets reach the threshold."""
    met = _both(pairs, tokens, "tokens").withColumn("k", F.size(F.array_intersect("tokensa", "tokensb")))
    return met.filter(F.col("k") >= overlap(F.size("tokensa"), F.size("tokensb"), percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def labelled_rows(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n, label of every row of docs; rows of one label are linked, null has no words."""
    found = checkpointed(shared_entries(docs, frequent_tokens(docs), percent))
    entries, twos = found.filter("other is null").drop("other"), found.filter("other is not null")
    pairs = checkpointed(_pivot_pairs(entries, percent).unionByName(twos.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))).distinct())
    rows = checkpointed(named_rows(docs, bit_filter(entries.select("node").unionByName(_nodes(pairs)))))
    bitmaps = checkpointed(rows.filter("bits is not null").select("node", "n", "bits").dropDuplicates(["node"]))
    close = checkpointed(_may_link(pairs, bitmaps, percent))
    links = checkpointed(_linked(close, sets_of(docs, bit_filter(_nodes(close))), percent))
    apart = _pairs_apart(entries, components(links), percent).join(pairs, ["a", "b"], "left_anti")
    close = checkpointed(_may_link(apart, bitmaps, percent))
    if not close.isEmpty():
        links = checkpointed(links.unionByName(_linked(close, sets_of(docs, bit_filter(_nodes(close))), percent)))
    comp = components(links).withColumnRenamed("node", "_node")
    return rows.select("doc_id", "text_hash", "node", "n").join(comp, F.col("node") == F.col("_node"), "left").select("doc_id", "text_hash", "n", F.coalesce("label", "node").alias("label"))


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every row of docs (doc_id, text, more): doc_id, n_shingles, component_id.

    A-Z are lower-cased; a set holds the distinct 5-word shingles, or the whole sequence of fewer words. Sets link
    when 100 * (size of the intersection) >= percent * (size of the union), and component_id is the smallest doc_id
    that links lead to, the row's own included. Null, empty and wordless texts have n_shingles 0 and link with
    nothing. Rows with a null doc_id belong to components without naming them; null is the id of a component of such
    rows alone. Repeated rows have equal sets, so they link. An empty table gives no rows.
    """
    rows = checkpointed(labelled_rows(docs, percent))
    least = checkpointed(rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")).withColumnRenamed("label", "_label"))  # a plain side, so that a hot label's rows can be split
    return rows.join(least, F.col("label") == F.col("_label"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near copies, with docs' own columns, whatever their names.

    The row with the smallest doc_id stays (null last); of several, that with the smallest hash of its text, and of
    rows equal in both the least by all columns that can be ordered. Documents without words are no one's copy: all
    stay. An empty table gives no rows.
    """
    rows = checkpointed(labelled_rows(docs, percent))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    chosen = rows.filter("label is not null").groupBy("label").agg(F.min(key).alias("k")).select(F.col("k.doc_id").alias("keep_id"), F.col("k.text_hash").alias("keep_hash"))
    wordless = rows.filter("label is null").select(F.col("doc_id").alias("keep_id"), F.col("text_hash").alias("keep_hash")).distinct()
    times = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"), F.max(F.col("label").isNotNull()).alias("words"))
    kept = chosen.unionByName(wordless).join(times, F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("keep_hash") == F.col("text_hash"))).select("keep_id", "keep_hash", (F.col("words") & (F.col("times") > 1)).alias("again"))
    kept = checkpointed(kept)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = row.withColumn("id", F.col("row.doc_id").cast("long")).withColumn("hash", F.xxhash64(F.col("row.text").cast("string")))
    match = row["id"].eqNullSafe(kept["keep_id"]) & (row["hash"] == kept["keep_hash"])
    once = row.join(kept.filter("not again"), match, "left_semi").select("row")
    ordered = [f"row.`{c}`" for c, kind in docs.dtypes if "map<" not in kind]
    first = row.join(kept.filter("again"), match, "left_semi").groupBy("id", "hash").agg(F.min_by("row", F.struct(*ordered)).alias("row")).select("row")
    return once.unionByName(first).select("row.*")
