"""Byte-level BPE encoding and decoding with segment trees.

A piece of text (one match of the pattern) starts as single bytes. Each neighbouring pair of live tokens has the rank
of the token that it would merge into. A segment tree over the byte positions keeps the leftmost pair of least rank at
its root; a merge rewrites the leaf of the merged pair, of the pair before it and of the pair that disappears, and
with each the path to the root. Pieces of up to LANE bytes are merged side by side, one row of a numpy array per
piece; longer ones (of any length) in a tree of their own, in n log n steps.

Pieces that a worker has seen are looked up in a bounded cache, so a batch merges only its new pieces.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import map_columns, slices

LANE = 64
#: Entries of a worker's cache before it starts anew, and the longest piece kept in it.
MOST_CACHED, LONGEST_CACHED = 300_000, 64
_NONE = np.int64(2**62)


class Vocabulary:
    """Ranks of a .tiktoken file: tokens by id, and the id that each pair of tokens merges into."""

    def __init__(self, data: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        # \s is spelled out: the classes of regex and of the reference tokenizer differ in the separators 1C-1F
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                a, b = ranks.get(token[:at]), ranks.get(token[at:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.cache: dict[str, tuple[int, ...]] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it does not merge (or either id is negative: nothing is there)."""
        key = (a << 32) | (b & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], _NONE)

    def merge_lane(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """The tokens of pieces of at most `width` bytes (a power of 2)."""
        count = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(count, width)
        ids = np.full((count, width + 1), -1, np.int64)  # the last column stands for the end
        ids[:, :width] = np.where(np.arange(width) < lengths[:, None], self.bytes[raw], -1)
        after = np.tile(np.minimum(np.arange(1, width + 2), width), (count, 1))
        before = np.tile(np.arange(-1, width), (count, 1))
        tree = np.full((count, 2 * width), _NONE, np.int64)
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, width)
        tree[:, width:] = np.where(ranks < _NONE, ranks * width + np.arange(width), _NONE)  # the leftmost of equal ranks is the least
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            rank, i = np.divmod(tree[live, 1], width)
            j = after[live, i]
            k = after[live, j]
            h = before[live, i]
            ids[live, i], ids[live, j], after[live, i], before[live, k] = rank, -1, k, i
            self._update(tree, width, live, j, np.full(len(live), _NONE))
            self._update(tree, width, live, i, self.pair_ranks(rank, ids[live, k]))
            some = h >= 0
            self._update(tree, width, live[some], h[some], self.pair_ranks(ids[live[some], h[some]], rank[some]))
            live = live[tree[live, 1] < _NONE]
        flat, kept = ids[:, :width], ids[:, :width] >= 0
        values, ends = flat[kept].tolist(), kept.sum(axis=1).cumsum().tolist()
        return [tuple(values[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _update(tree: np.ndarray, width: int, rows: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> None:
        node = width + at
        tree[rows, node] = np.where(ranks < _NONE, ranks * width + at, _NONE)
        while len(node) and node[0] > 1:  # all leaves lie equally deep
            node = node // 2
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of a piece of any length, in a tree of its own."""
        n, pairs, none = len(piece), self.pairs, int(_NONE)
        width = 1 << (n - 1).bit_length()
        start = self.bytes[np.frombuffer(piece, np.uint8)]
        ranks = np.full(width, _NONE, np.int64)
        ranks[: n - 1] = self.pair_ranks(start[:-1], start[1:])
        levels = [np.where(ranks < _NONE, ranks * width + np.arange(width), _NONE)]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [none, *chain.from_iterable(x.tolist() for x in reversed(levels))]
        ids, after, before = [*start.tolist(), -1], list(range(1, n + 2)), list(range(-1, n))

        def update(at: int, a: int, b: int) -> None:
            rank = pairs.get(a << 32 | b, none) if a >= 0 and b >= 0 else none
            node = width + at
            tree[node] = rank * width + at if rank < none else none
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                tree[node] = left if left < right else right
                node >>= 1

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i], before[k] = rank, -1, k, i
            update(j, -1, -1)
            update(i, rank, ids[k])
            if before[i] >= 0:
                update(before[i], ids[before[i]], rank)
        return tuple(x for x in ids if x >= 0)

    def encode_pieces(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Tokens of each piece; a piece that is a token as a whole is that token."""
        out, lanes = {}, {}
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(b)
            if whole is not None:
                out[p] = (whole,)
            elif len(b) > LANE:
                out[p] = self.merge_long(b)
            else:
                lanes.setdefault(1 << (len(b) - 1).bit_length(), []).append((p, b))
        for width, some in lanes.items():
            step = max(256, (1 << 20) // width)
            for a in range(0, len(some), step):
                part = some[a : a + step]
                out.update(zip((p for p, _ in part), self.merge_lane([b for _, b in part], width), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The tokens of each text, without special tokens."""
        split = [self.pattern.findall(t) for t in texts]
        fresh = set(chain.from_iterable(split)).difference(self.cache)
        got = self.encode_pieces(fresh)
        if len(self.cache) + len(got) > MOST_CACHED:
            self.cache = {}
            got |= self.encode_pieces(set(chain.from_iterable(split)).difference(got))
        known = {**{p: got[p] for p in got if len(p) > LONGEST_CACHED}}
        self.cache.update((p, t) for p, t in got.items() if len(p) <= LONGEST_CACHED)
        find = (lambda p: self.cache.get(p) or known[p]) if known else self.cache.__getitem__
        return [list(chain.from_iterable(map(find, pieces))) for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(data: bytes, pattern: str) -> Vocabulary:
    """The worker's own copy, built once per process."""
    key = (hashlib.md5(data, usedforsecurity=False).hexdigest(), pattern)
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(data, pattern)
    return _vocabularies[key]


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver; its size is that of a vocabulary (some MB at most) and not of the data."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """docs with a column `ids` (array of token ids of the whole text) added; null and empty texts have none.

    A column `ids` that docs has already is replaced. Rows are independent: no shuffle.
    """
    data, kept = docs.sparkSession.sparkContext.broadcast(ranks), docs.drop("ids")
    text = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(data.value, pattern)
        for batch in batches:
            for a, b in slices(batch, 128, 500_000, text):
                part = batch.slice(a, b - a)
                ids = [np.array(x, np.int32) for x in v.encode([t or "" for t in part.column(text).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names, "ids"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decode_documents(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """docs with a column `decoded` (binary) added: the bytes of the tokens in column `ids`; null ids give none."""
    data, names = docs.sparkSession.sparkContext.broadcast(ranks), [c for c in docs.columns if c != "decoded"]

    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        v = vocabulary(data.value, pattern)
        return pd.Series([b"" if x is None else v.decode([int(i) for i in x]) for x in ids], index=ids.index)

    return docs.select(*[F.col(f"`{c}`") for c in names], decoded(F.col("ids")).alias("decoded"))


def round_trip(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs (doc_id, text, more).

    The ids are written in decimal and joined by commas; the decoded bytes come from the ids alone. Null and empty
    texts have no tokens, and the hashes of nothing. Repeated rows repeat their result. One pass, no shuffle, and the
    tokens never leave the task.
    """
    data = docs.sparkSession.sparkContext.broadcast(ranks)

    def digests(ids, texts):
        v, counts, idents, back = vocabulary(data.value, pattern), [], [], []
        for tokens in v.encode([t or "" for t in texts]):
            counts.append(len(tokens))
            idents.append(hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest())
            back.append(hashlib.sha256(v.decode(tokens)).hexdigest())
        return ids, counts, idents, back

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_columns(rows, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=2048, chars=2_000_000, size_of=1)
