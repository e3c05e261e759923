"""Boosted trees on quantile loss, fitted by histograms: several quantiles in the same passes over the rows.

Rows are binned once by approximate quantiles of each feature and written to the checkpoint folder, packed: a record
holds the bins, outcomes and predictions of some thousands of rows, so a pass hands few records to Python, and a task
adds its counts up before it sends them. A tree takes one pass a level: tasks count rows, and rows above the current prediction, by (quantile, node, feature, bin), Spark adds the
counts up, and the driver picks the splits from tables whose size depends on the parameters alone. The gradient of the
quantile loss has two values, so these counts are all it takes, and being whole numbers they add up alike in any order.

A leaf's value is the exact order statistic of its residuals, found by refining histograms: count by value bin, go on
within the bin that holds it until that bin has one value. No task holds a leaf, no residual is sent to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.checkpoints import written

#: Bins of a round of the search for an order statistic.
FINE = 16_384
#: Trees after which predictions are written anew, so that a pass never applies more.
REFRESH = 8


class Tree(NamedTuple):
    """Nodes in heap order (children of i: 2 i + 1, 2 i + 2): feature (-1: a leaf), the last bin that goes left, value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n))

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row (of a matrix of bins) ends in."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            f = self.feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (bins[rows, np.maximum(f, 0)] > self.cut[node]), node)
        return node


class QuantileModel(NamedTuple):
    features: list[str]
    edges: list[np.ndarray]
    alphas: tuple[float, ...]
    start: np.ndarray
    trees: list[list[Tree]]  # one a quantile in each round

    def binned(self, values: np.ndarray) -> np.ndarray:
        """Bins of a matrix of values: 0 for null, else 1 + the number of edges below."""
        return np.stack([np.where(np.isnan(x), 0, 1 + np.searchsorted(e, x, "left")) for x, e in zip(values.T, self.edges, strict=True)], axis=1).astype(np.uint8)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return added(np.tile(self.start, (len(bins), 1)), bins, self.trees)

    def transform(self, df: DataFrame, names: list[str], crossing: bool = False) -> DataFrame:
        """df with a column for each quantile; crossing ones are sorted unless `crossing`. Null features go left at every split."""

        @F.pandas_udf(ArrayType(DoubleType()))
        def score(*columns: pd.Series) -> pd.Series:
            out = self.predict(self.binned(np.stack([c.to_numpy(np.float64) for c in columns], axis=1)))
            return pd.Series(list(out if crossing else np.sort(out, axis=1)))

        scored = df.withColumn("_quantiles", score(*[F.col(f).cast("double") for f in self.features]))
        return scored.withColumns({n: F.col("_quantiles")[i] for i, n in enumerate(names)}).drop("_quantiles")


def added(f: np.ndarray, bins: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    """Predictions f (a column a quantile) moved on by trees."""
    for round_ in trees:
        f = f + np.stack([t.value[t.leaf_of(bins)] for t in round_], axis=1)
    return f


def cut_points(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """At most bins - 1 rising edges of each feature: approximate quantiles of its values."""
    asked = [F.percentile_approx(F.col(f).cast("double"), [i / bins for i in range(1, bins)], 100 * bins) for f in features]
    return [np.unique(np.array(x or [], np.float64)) for x in df.agg(*asked).first()]


Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def _blocks(batches: Iterator[pa.RecordBatch], width: int, start: np.ndarray) -> Iterator[Block]:
    """(bins, y, f) of each packed record, a row of a matrix for each row, with `start` added to f."""
    for batch in batches:
        for bins, y, f in zip(batch.column("bins"), batch.column("y"), batch.column("f"), strict=True):
            yield np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, width), np.frombuffer(y.as_buffer()), np.frombuffer(f.as_buffer()).reshape(-1, len(start)) + start


def _packed(bins: np.ndarray, y: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (bins, y, f)], names=["bins", "y", "f"])


def _tasks(state: DataFrame, count: Callable[[Iterator[Block]], tuple[np.ndarray, ...]], names: tuple[str, ...], width: int, start: np.ndarray) -> DataFrame:
    """What `count` makes of all blocks of a task: equally long arrays, a long key first, doubles after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = count(_blocks(batches, width, start))
        if len(got[0]):
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), *(pa.array(x, pa.float64()) for x in got[1:])], names=list(names))

    return state.mapInArrow(run, ", ".join(f"{n} {'double' if i else 'long'}" for i, n in enumerate(names)))


def order_statistics(state: DataFrame, width: int, residuals: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], ranks: dict[int, int], start: np.ndarray, low: float, high: float) -> dict[int, float]:
    """The ranks[t]-th smallest residual (from 1) of each target t, exactly; residuals() gives (targets, values), -1: none.

    low and high only say where most values lie. A round costs one pass; it ends where each target's bin has one value.
    """
    bounds, left, out = dict.fromkeys(ranks, (low, high, -math.inf, math.inf)), dict(ranks), {}
    while left:
        known = {t: bounds[t] for t in left}

        def count(blocks, known=known):
            size = len(known) * FINE
            ns, lows, highs = np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf)
            for block in blocks:
                target, value = residuals(*block)
                for k, (t, (a, b, least, most)) in enumerate(known.items()):
                    x = value[(target == t) & (value >= least) & (value <= most)]
                    if not len(x):
                        continue
                    at = np.clip((x - a) / (b - a) * FINE, 0, FINE - 1).astype(np.int64) if b > a else np.zeros(len(x), np.int64)
                    order = np.argsort(at, kind="stable")
                    cell, starts = np.unique(at[order], return_index=True)
                    cell += k * FINE
                    lows[cell] = np.minimum(lows[cell], np.minimum.reduceat(x[order], starts))
                    highs[cell] = np.maximum(highs[cell], np.maximum.reduceat(x[order], starts))
                    ns[cell] += np.diff(np.append(starts, len(x)))
            at = np.flatnonzero(ns)
            return np.array(list(known), np.int64)[at // FINE] * FINE + at % FINE, lows[at], highs[at], ns[at]

        cells = _tasks(state, count, ("key", "low", "high", "n"), width, start).groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        cells = cells.withColumn("t", F.floor(F.col("key") / FINE)).toPandas().sort_values("key")  # FINE rows a target at most
        for t, part in cells.groupby("t"):
            t, upto = int(t), part.n.cumsum().to_numpy()
            i = int(np.searchsorted(upto, left[t]))
            row = part.iloc[i]
            left[t] -= int(upto[i] - row.n)
            bounds[t] = (row.low, row.high, row.low, row.high)
            if row.low == row.high or left[t] == 1 or left[t] == row.n:
                out[t] = float(row.high if left[t] == row.n else row.low)
                del left[t]
    return out


def _level(state: DataFrame, trees: list[Tree], pending: list[list[Tree]], nodes: range, width: int, most: int, start: np.ndarray) -> np.ndarray:
    """Counts by (quantile, node of the level, feature, bin): rows, and rows above the prediction."""
    alphas = len(trees)
    shape = (alphas, len(nodes), width, most)

    def count(blocks):
        total = np.zeros((2, math.prod(shape)))
        for bins, y, f in blocks:
            f = added(f, bins, pending)
            for a, tree in enumerate(trees):
                node = tree.leaf_of(bins) - nodes.start
                rows = np.flatnonzero(node >= 0)  # those that ended above are in a leaf
                if len(rows):
                    above = (y[rows] > f[rows, a]).astype(np.float64)
                    for j in range(width):
                        low = (a * len(nodes) * width + j) * most
                        key = node[rows] * width * most + bins[rows, j]
                        n = (len(nodes) - 1) * width * most + most
                        total[0, low : low + n] += np.bincount(key, minlength=n)
                        total[1, low : low + n] += np.bincount(key, above, n)
        at = np.flatnonzero(total[0])
        return at, total[0][at], total[1][at]

    got = _tasks(state, count, ("key", "n", "above"), width, start).groupBy("key").agg(F.sum("n").alias("n"), F.sum("above").alias("above")).toPandas()  # of the shape's size at most
    out = np.zeros((2, math.prod(shape)))
    out[:, got.key.to_numpy(np.int64)] = got[["n", "above"]].to_numpy().T
    return out.reshape(2, *shape)


def best_split(n: np.ndarray, above: np.ndarray, alpha: float, least: int, l2: float, rising: list[int]) -> tuple[int, int] | None:
    """(feature, last bin that goes left) of the largest gain in a node's counts by (feature, bin), the first of equals; None without gain.

    With rising[j] = 1 (-1) a split of feature j must not fall (rise).
    """
    total, pull = n[0].sum(), above[0].sum() - (1 - alpha) * n[0].sum()  # the negative gradients' sum
    left_n = n.cumsum(axis=1)[:, :-1]
    left = above.cumsum(axis=1)[:, :-1] - (1 - alpha) * left_n
    right_n, right = total - left_n, pull - left
    gain = left**2 / (left_n + l2) + right**2 / (right_n + l2) - pull**2 / (total + l2)
    slope = (right / (right_n + l2) - left / (left_n + l2)) * np.array(rising)[:, None]
    gain = np.where((left_n >= least) & (right_n >= least) & (slope >= 0), gain, -np.inf)
    if not gain.size or gain.max() <= 1e-9:
        return None
    j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return int(j), int(cut)


def keep_order(tree: Tree, rising: list[int]) -> None:
    """Hold the leaves on both sides of each split of a monotone feature apart, at the mean of both sides' means."""

    def leaves(i: int) -> list[int]:
        return [i] if tree.feature[i] < 0 else leaves(2 * i + 1) + leaves(2 * i + 2)

    for i in np.flatnonzero(tree.feature >= 0):
        way = rising[tree.feature[i]]
        if way:
            low, high = (leaves(2 * i + 1), leaves(2 * i + 2))[::way]
            middle = (tree.value[low].mean() + tree.value[high].mean()) / 2
            tree.value[low] = np.minimum(tree.value[low], middle)
            tree.value[high] = np.maximum(tree.value[high], middle)


def rank_of(alpha: float, n: int) -> int:
    """The place of the alpha-quantile among n sorted values: the least with that share at or below it."""
    return max(1, math.ceil(round(alpha * n, 9)))


def fit_quantiles(df: DataFrame, features: list[str], y: str, alphas: tuple[float, ...] = (0.2, 0.5, 0.8), rounds: int = 100, rate: float = 0.04, depth: int = 2, least: int = 100, l2: float = 1.0, bins: int = 128, rising: dict[str, int] | None = None) -> QuantileModel:
    """K21, K32 trees boosted on quantile loss for each of `alphas` (0.5: absolute error), on rows with a y.

    A split has at least `least` rows on both sides; `rising` names features in which predictions must not fall (1) or
    rise (-1). Nulls of a feature count as its lowest value. With no row the model predicts null.
    """
    if not 2 <= bins <= 254:
        raise ValueError("bins must be between 2 and 254")
    width, ways = len(features), [(rising or {}).get(f, 0) for f in features]
    d = df.filter(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))).select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(y).cast("double").alias("y"))
    edges = cut_points(d, [f"x{i}" for i in range(width)], bins)
    model = QuantileModel(features, edges, tuple(alphas), np.full(len(alphas), np.nan), [])
    most = max(map(len, edges), default=0) + 2

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[:-1]], axis=1)
                yield _packed(model.binned(values), batch.column(width).to_numpy(), np.zeros((batch.num_rows, len(alphas))))

    def spans(blocks):
        found = [(len(y), y.min(), y.max()) for _, y, _ in blocks]
        return np.arange(len(found)), *np.array(found, np.float64).reshape(-1, 3).T

    packed = "bins binary, y binary, f binary"
    state, start = written(d.mapInArrow(bin_rows, packed)), np.zeros(len(alphas))
    n, low, high = _tasks(state, spans, ("key", "n", "low", "high"), width, start).agg(F.sum("n").cast("long"), F.min("low"), F.max("high")).first()
    if not n:
        return model
    found = order_statistics(state, width, lambda bins_, y_, f: (np.repeat(np.arange(len(alphas)), len(y_)), np.tile(y_, len(alphas))), {a: rank_of(q, n) for a, q in enumerate(alphas)}, start, low, high)
    model.start[:] = [found[a] for a in range(len(alphas))]
    start, span, pending = model.start.copy(), high - low, []
    for k in range(rounds):
        trees, sizes = [Tree.empty(depth) for _ in alphas], [{0: n} for _ in alphas]
        for level in range(depth):
            nodes = range(2**level - 1, 2 ** (level + 1) - 1)
            counts = _level(state, trees, pending, nodes, width, most, start)
            for a, tree in enumerate(trees):
                for i in nodes:
                    if i in sizes[a]:
                        rows, above = counts[:, a, i - nodes.start]
                        split = best_split(rows, above, alphas[a], least, l2, ways)
                        if split:
                            tree.feature[i], tree.cut[i] = split
                            smaller = int(rows[split[0], : split[1] + 1].sum())
                            total = sizes[a].pop(i)
                            sizes[a] |= {2 * i + 1: smaller, 2 * i + 2: total - smaller}
        size = len(trees[0].feature)

        def residuals(bins_, y_, f, trees=trees, pending=tuple(pending), size=size):
            f = added(f, bins_, list(pending))
            return np.concatenate([a * size + t.leaf_of(bins_) for a, t in enumerate(trees)]), np.concatenate([y_ - f[:, a] for a in range(len(trees))])

        ranks = {a * size + i: rank_of(alphas[a], m) for a in range(len(alphas)) for i, m in sizes[a].items()}
        for t, v in order_statistics(state, width, residuals, ranks, start, -span, span).items():
            trees[t // size].value[t % size] = v
        for tree in trees:
            keep_order(tree, ways)
            tree.value[:] *= rate
        model.trees.append(trees)
        pending.append(trees)
        if len(pending) == REFRESH and k + 1 < rounds:

            def moved(batches: Iterator[pa.RecordBatch], pending=tuple(pending), start=start) -> Iterator[pa.RecordBatch]:
                for bins_, y_, f in _blocks(batches, width, start):
                    yield _packed(bins_, y_, added(f, bins_, list(pending)))

            state, pending, start = written(state.mapInArrow(moved, packed)), [], np.zeros(len(alphas))
    return model
