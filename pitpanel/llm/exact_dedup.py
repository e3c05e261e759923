"""Exact de-duplication against a history of digests held in minimal perfect hash tables.

History: the distinct digests of texts seen before, dealt out over shards by their last bits. Each shard is one
minimal perfect hash: n slots for n digests, found through a seed per small bucket of digests (buckets are placed
largest first; a bucket of one stores its slot outright). A slot holds the whole digest, the winner's locator (its
doc_id) and the group's size. History is an ordinary table of shards that can be written and read again.

Batch: each row looks its digest up. The slot's 32 bytes are compared, so a digest that is not in the history never
passes for one that is. Members are repeats: they only move the slot's locator and size on. What is not in the
history is grouped by itself and joins it afterwards.

Within one table the rows whose hashed doc_id is even are the history, the others the batch; which rows are which
changes nothing in the result. Tasks sum up equal digests before they send them, so a digest that a third of the rows
share costs a shard no more than another; only the plain join back to the rows meets that key, and there the unique
side is the small one and adaptive execution splits the large one. The number of shards follows the counted rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed, mix, shuffle_partitions

INDEX = "shard int, n int, seeds binary, digests binary, keep_ids binary, sizes binary"
ENTRIES = "digest binary, keep_id long, n long, member boolean"
KEYS_PER_BUCKET = 4
#: Rows for each shard, at most on average.
SHARD_ROWS = 500_000
#: The locator of a group whose rows have no doc_id; it loses to any other.
NO_ID = -(1 << 63)


def digest(text: str = "text"):
    """SHA-256 (32 bytes) of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER).cast("binary"), 256))


def _locator(doc_id: str = "doc_id"):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def _slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of keys (last axis: four words) under seeds; both are broadcast against each other."""
    return (mix(keys[..., 1] ^ mix(seeds + keys[..., 2])) % np.uint64(n)).astype(np.int64)


def build_table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds of the buckets, slot of each key) of a minimal perfect hash over distinct keys, an n x 4 uint64 array.

    A seed below zero is -1 - slot. All buckets of one size try their next seeds together; of those that fit, a bucket
    is placed if it is the first to claim all its slots, and the others go on.
    """
    n = len(keys)
    buckets = (n + KEYS_PER_BUCKET - 1) // KEYS_PER_BUCKET
    seeds, slots = np.zeros(buckets, np.int64), np.full(n, -1, np.int64)
    bucket = (keys[:, 0] % np.uint64(max(buckets, 1))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    used, sizes = np.zeros(n, bool), np.diff(starts)
    for size in range(int(sizes.max(initial=0)), 1, -1):
        todo = np.flatnonzero(sizes == size)
        members, seed = order[starts[todo][:, None] + np.arange(size)], np.zeros(len(todo), np.int64)
        while len(todo):
            width = max(1, min(1024, 200_000 // (len(todo) * size)))
            tries = seed[:, None] + np.arange(width)
            at = _slots(keys[members][:, None], tries[:, :, None].astype(np.uint64), n)
            fits = ~used[at].any(axis=2) & (np.diff(np.sort(at, axis=2), axis=2) > 0).all(axis=2)
            some, first = fits.any(axis=1), fits.argmax(axis=1)
            picked, seed = at[np.arange(len(todo)), first], seed + np.where(some, first, width)
            rows = np.flatnonzero(some)
            claimed = np.zeros(len(rows) * size, bool)
            claimed[np.unique(picked[rows], return_index=True)[1]] = True
            done = rows[claimed.reshape(-1, size).all(axis=1)]
            seeds[todo[done]], slots[members[done]], used[picked[done]] = seed[done], picked[done], True
            left = np.ones(len(todo), bool)
            left[done] = False
            todo, members, seed = todo[left], members[left], seed[left]
    free, single = np.flatnonzero(~used), np.flatnonzero(sizes == 1)
    seeds[single], slots[order[starts[single]]] = -1 - free, free
    return seeds, slots


def find_slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot that each key would have; meaningful only if the slot holds that key."""
    seed = seeds[(keys[:, 0] % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(seed < 0, -1 - seed, _slots(keys, np.maximum(seed, 0).astype(np.uint64), n))


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def summed(rows: DataFrame, shards: int) -> DataFrame:
    """shard, digest, keep_id, n: rows (digest, keep_id) with equal digests of an Arrow batch summed up; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.Table.from_batches([batch]).group_by("digest").aggregate([("keep_id", "max"), ("keep_id", "count")])
            digests = got.column("digest").combine_chunks()
            shard = np.frombuffer(b"".join(x[-4:] for x in digests.to_pylist()), ">u4").astype(np.int64) % shards
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), digests, got.column("keep_id_max").combine_chunks(), got.column("keep_id_count").combine_chunks()], names=["shard", "digest", "keep_id", "n"])

    return rows.select("digest", "keep_id").mapInArrow(run, "shard int, digest binary, keep_id long, n long")


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    groups = rows.groupby("digest", sort=False).agg(keep_id=("keep_id", "max"), n=("n", "sum"))
    keys = _keys(groups.index)
    seeds, slots = build_table(keys)
    order = np.argsort(slots)
    pack = lambda x: x.to_numpy(np.int64)[order].tobytes()
    return pd.DataFrame([[rows.shard.iloc[0], len(keys), seeds.tobytes(), keys[order].tobytes(), pack(groups.keep_id), pack(groups.n)]], columns=["shard", "n", "seeds", "digests", "keep_ids", "sizes"])


def build_history(rows: DataFrame) -> DataFrame:
    """A row per shard (INDEX): the minimal perfect hash over the distinct digests of summed() rows."""
    return rows.groupBy("shard").applyInPandas(_build, INDEX)


def _probe(batch: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    columns, out = ["digest", "keep_id", "n"], []
    for r in index.itertuples():  # one at most
        slots, keep, size = np.frombuffer(r.digests, np.uint64).reshape(r.n, 4), np.frombuffer(r.keep_ids, np.int64).copy(), np.frombuffer(r.sizes, np.int64).copy()
        if len(batch):
            keys = _keys(batch.digest)
            slot = find_slots(keys, np.frombuffer(r.seeds, np.int64), r.n)
            hit = (slots[slot] == keys).all(axis=1)
            np.maximum.at(keep, slot[hit], batch.keep_id.to_numpy(np.int64)[hit])
            np.add.at(size, slot[hit], batch.n.to_numpy(np.int64)[hit])
            batch = batch[~hit]
        out.append(pd.DataFrame({"digest": [x.tobytes() for x in slots], "keep_id": keep, "n": size, "member": True}))
    return pd.concat([*out, batch[columns].assign(member=False)], ignore_index=True).astype({"keep_id": "int64", "n": "int64", "member": bool})


def look_up(batch: DataFrame, history: DataFrame) -> DataFrame:
    """ENTRIES: the history's slots, moved on by the members of batch (summed() rows), and batch's rows that are no members."""
    return batch.groupBy("shard").cogroup(history.groupBy("shard")).applyInPandas(_probe, ENTRIES)


def verdicts(rows: DataFrame) -> DataFrame:
    """One row per distinct digest of rows (digest, keep_id): digest, keep_id (the largest), group_size."""
    shards = max(shuffle_partitions(rows.sparkSession), -(-rows.count() // SHARD_ROWS))
    old = F.pmod(F.xxhash64("keep_id"), F.lit(2)) == 0
    history = checkpointed(build_history(summed(rows.filter(old), shards)))
    found = checkpointed(look_up(summed(rows.filter(~old), shards), history))
    fresh = found.filter("not member").groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return found.filter("member").select("digest", "keep_id", F.col("n").alias("group_size")).unionByName(fresh)


def exact_groups(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text, more) with its group of equal texts.

    Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. Returns doc_id, keep_id
    (the largest doc_id of the group), group_size, kept, text_sha256. Null doc_ids lose to any other; where all are
    null, keep_id is null and the rows count as one. Rows that repeat the winner's doc_id and text are that document
    again and say kept, too (deduplicate() lets one through). An empty table gives no rows.
    """
    rows = checkpointed(docs.select(F.col("doc_id"), _locator().alias("id"), digest().alias("digest")))  # texts are read and hashed once
    found = verdicts(rows.select("digest", F.col("id").alias("keep_id")))
    keep = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return rows.join(found, "digest").select("doc_id", keep.alias("keep_id"), "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of equal texts, the one with the largest doc_id, with docs' own columns.

    Of rows that repeat the winner's doc_id and text the least by all columns that can be ordered stays; only for such
    rows is more than the digest compared, and they combine before they are shuffled, so copies meet in no one task.
    Columns may have any names; null texts count as empty, and a null doc_id stays only where its group has no other.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest().alias("digest"), _locator().alias("id"))
    keys = checkpointed(row.select("digest", "id"))
    times = keys.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("times"))
    winners = verdicts(keys.select("digest", F.col("id").alias("keep_id"))).select("digest", F.col("keep_id").alias("id"))
    kept = checkpointed(winners.join(times, ["digest", "id"]).select("digest", "id", (F.col("times") > 1).alias("again")))
    once = row.join(kept.filter("not again"), ["digest", "id"], "left_semi").select("row")
    if kept.filter("again").isEmpty():
        return once.select("row.*")
    ordered = F.struct(*[f"row.`{c}`" for c, kind in docs.dtypes if "map<" not in kind])
    first = row.join(kept.filter("again"), ["digest", "id"], "left_semi").groupBy("digest", "id").agg(F.min_by("row", ordered).alias("row"))
    return once.unionByName(first.select("row")).select("row.*")
