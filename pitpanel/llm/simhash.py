"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

Each 64-bit fingerprint is mapped to the bit counts of its 32 segments of two bits: a point whose Manhattan distance
from another is a lower bound of the fingerprints' Hamming distance. Counts are written in thermometer code (0, 1, 2 as
00, 01, 11), so that a whole point is one 64-bit number and the Manhattan distance of two points is the number of
differing bits of their codes.

Grid. Points within a distance of 3 are within 1 of each other in one half of their coordinates. A half is a cell of a
grid of step 1; each point stands in its own cell of each half and looks into the cells one step up along each
coordinate, so that of two points within one step one meets the other. Of what meets, the Manhattan distance over all
coordinates is tested, then the Hamming distance itself.

Groups. Equal fingerprints are one point. Points are first compared with one pivot a cell; then points that share a
cell but lie in different components are compared, so a crowded cell of one component makes no pairs. No link between
components is lost, and links inside a component cannot change the result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_columns, shuffle_partitions, words_of
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Points that one task finds the cells of.
POINTS = 20_000
_EVEN = 0x5555555555555555
_HALF = 0xFFFFFFFF


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit number; 0 without words.

    A bit is set if it is set in over half of the shingles' XXH64, repeats included; fewer words are one shingle.
    """
    words = words_of(text, lower=True)
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(size, len(words))
    starts, ends = (ends - lengths)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 100_000):
        ones += np.unpackbits(hashes[i : i + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp of every row of docs (doc_id, text, more)."""
    return map_columns(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), lambda ids, texts: (ids, [fingerprint(t) for t in texts]), "doc_id long, fp long", size_of=1)


def embedded(fp: Column) -> Column:
    """The bit counts of a fingerprint's 2-bit segments, in thermometer code."""
    next_ = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(next_).bitwiseAND(_EVEN).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_).bitwiseAND(_EVEN), 1))


def _cells(point: Column) -> Column:
    """The cells of a point: (cell, home), its own of each half, and those one step up, where `home` is false.

    A cell is the half's 32 bits; the upper half's cells have bit 32 set.
    """
    out = []
    for half in (0, 1):
        own = F.shiftrightunsigned(point, 32 * half).bitwiseAND(_HALF).bitwiseOR(half << 32)
        out.append(F.array(F.struct(own.alias("cell"), F.lit(True).alias("home"))))
        for i in range(16):
            low, high = 1 << (2 * i), 2 << (2 * i)
            up = own.bitwiseOR(F.when(own.bitwiseAND(low) == 0, F.lit(low).cast("long")).otherwise(F.lit(high).cast("long")))
            out.append(F.when(own.bitwiseAND(high) == 0, F.array(F.struct(up.alias("cell"), F.lit(False).alias("home")))).otherwise(F.array().cast("array<struct<cell:bigint,home:boolean>>")))
    return F.flatten(F.array(*out))


def _near(a: str, b: str, distance: int) -> Column:
    """Whether two fingerprints are within a distance, the Manhattan distance of their points first."""
    bound = F.bit_count(embedded(F.col(a)).bitwiseXOR(embedded(F.col(b)))) <= distance
    return bound & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance)


def _links(points: DataFrame, distance: int) -> DataFrame:
    """u, v: links that connect all of points (fp) which chains of links within the distance connect."""
    spread = points.repartition(max(shuffle_partitions(points.sparkSession), -(-points.count() // POINTS)))  # some 26 cells a point
    rows = spread.select("fp", F.explode(_cells(embedded(F.col("fp")))).alias("c")).select("c.cell", "c.home", "fp")
    met = rows.groupBy("cell").agg(F.min(F.when(F.col("home"), F.col("fp"))).alias("pivot"), F.count(F.lit(1)).alias("n")).filter("pivot is not null and n > 1").select("cell", "pivot")
    entries = checkpointed(rows.hint("merge").join(met, "cell"))  # as rows are laid out after the shuffle, Spark takes them for small and would broadcast them
    first = checkpointed(entries.filter("fp <> pivot").filter(_near("fp", "pivot", distance)).select(F.col("fp").alias("u"), F.col("pivot").alias("v")).distinct())
    comp = components(first).withColumnRenamed("node", "fp")
    entries = entries.drop("pivot").join(comp, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    per = entries.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("cell").agg(F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    several = checkpointed(entries.join(per.filter("labels > 1").select("cell", F.col("top.label").alias("top")), "cell"))
    seek = several.filter("label <> top").select("cell", F.col("fp").alias("a"), F.col("home").alias("ha"), F.col("label").alias("la"))
    there = several.select("cell", F.col("fp").alias("b"), F.col("home").alias("hb"), F.col("label").alias("lb"), "top")
    apart = seek.join(there, "cell").filter((F.col("la") != F.col("lb")) & (F.col("ha") | F.col("hb")) & ((F.col("lb") == F.col("top")) | (F.col("a") < F.col("b"))) & _near("a", "b", distance))
    return first.unionByName(apart.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())


def near_fingerprints(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Every row of docs (doc_id, text, more): doc_id, fingerprint (16 hex digits) and component_id.

    Fingerprints link if they differ in at most `distance` bits (3 or fewer, what the grid is made for); component_id is
    the smallest doc_id that links lead to, the row's own included. Null, empty and wordless texts have the fingerprint
    0, which links like any other. Rows with a null doc_id belong to components without naming them; null is the id of
    a component of such rows alone. Repeated rows have equal fingerprints, so they link. An empty table gives no rows.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the grid finds distances of 0 to 3 bits")
    rows = checkpointed(fingerprints(docs))
    points = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(_links(points, distance)).withColumnRenamed("node", "fp")
    labelled = checkpointed(points.join(comp, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.select("fp", "label").join(least, "label").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
