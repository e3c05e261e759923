"""Trailing frames of many lengths over the same rows, made in one pass over each symbol's values.

A window takes every row's frame anew, value by value; here all rows of a symbol are taken at once. Spark deals out and
groups the rows; what is held at a time is one symbol's bars, at most one a session.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Frame(NamedTuple):
    """What is taken of the n rows that end `-last` rows before each row; null where fewer than `least` values are there.

    Kinds: count, mean, whole (the mean where all n are there), sd (of a sample), max; below counts the values that are at most the row's own.
    """

    kind: str
    of: str
    n: int
    last: int = 0
    least: int = 1
    scale: float = 1.0


def frame_name(kind: str, of: str, n: int, last: int = 0) -> str:
    return f"_{kind}_{of}_{n}_{-last}"


def _lagged(x: np.ndarray, k: int) -> np.ndarray:
    """Rows (the last axis) k later; 0 before the first."""
    out = np.zeros_like(x)
    out[..., k:] = x[..., : max(x.shape[-1] - k, 0)]
    return out


def _over(n: int, part: tuple, merge, lagged=_lagged) -> tuple:
    """The merge of n rows' parts, by doubling: parts of 1, 2, 4 ... rows make up the frame, the older rows on the left."""
    whole, done, width = None, 0, 1
    while True:
        if n & width:
            older = tuple(lagged(x, done) for x in part)
            whole, done = older if whole is None else merge(older, whole), done + width
        if 2 * width > n:
            return whole
        part, width = merge(tuple(lagged(x, width) for x in part), part), 2 * width


def _added(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def _moments(a: tuple, b: tuple) -> tuple:
    """Counts, means and squared deviations put together; equal values deviate by nothing at all, missing ones change nothing."""
    (n, mean, squares), (k, other, more) = a, b
    total, delta = n + k, np.where(n > 0, np.where(k > 0, other - mean, 0.0), 0.0)
    share = k / np.maximum(total, 1.0)
    return total, np.where(n > 0, mean + delta * share, other), squares + more + delta * delta * n * share


def _lowest(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), -np.inf), x[: max(len(x) - k, 0)]])


#: Rows whose frames are compared at a time.
ROWS = 4096


def _below(x: np.ndarray, has: np.ndarray, n: int, back: int, seen: np.ndarray) -> np.ndarray:
    own, m = np.where(has, x, np.nan), len(x)
    past = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n + back - 1, np.nan), own]), n)[:m]
    count = np.concatenate([(past[i : i + ROWS] <= own[i : i + ROWS, None]).sum(axis=1) for i in range(0, m, ROWS)])
    return np.where(has & np.isnan(x), seen, count)  # all are at most NaN, as Spark orders it


def _together(frames: dict[str, Frame], have: dict) -> None:
    """Adds the frames, values and whether they are there, to `have`; frames of one kind and length are made together."""
    seen: dict = {}
    base: dict = {}
    for key in dict.fromkeys((f.kind, f.n) for f in frames.values() if f.of in have):
        kind, n = key
        names = list(dict.fromkeys(f.of for f in frames.values() if (f.kind, f.n) == key and f.of in have))
        there = np.array([have[k][1] for k in names], float)
        x = np.where(there > 0, np.array([have[k][0] for k in names]), 0.0)
        upto = np.cumsum(there, axis=1)
        n = min(n, x.shape[1])
        count = upto - _lagged(upto, n)
        if kind in ("mean", "whole"):
            values = _over(n, (x,), _added)[0] / np.maximum(count, 1.0)
        elif kind == "sd":
            values = np.sqrt(_over(n, (there, x, np.zeros_like(x)), _moments)[2] / np.maximum(count - 1.0, 1.0))
        elif kind == "max":
            values = [_over(n, (np.where(have[k][1], have[k][0], -np.inf),), lambda a, b: (np.maximum(a[0], b[0]),), _lowest)[0] for k in names]
        else:
            values = count
        base |= {(*key, k): v for k, v in zip(names, values, strict=True)}
        seen |= {(*key, k): v for k, v in zip(names, count, strict=True)}
    for name, f in frames.items():
        at = (f.kind, f.n, f.of)
        if at in base and name not in have:
            count = _lagged(seen[at], -f.last)
            if f.kind == "below":
                have[name] = _below(*have[f.of], min(f.n, len(count)), -f.last, count), np.ones(len(count), bool)
            elif f.kind == "count":
                have[name] = count, np.ones(len(count), bool)
            else:
                have[name] = _lagged(base[at], -f.last) * f.scale, count >= max(f.least, {"sd": 2, "whole": f.n}.get(f.kind, 1))


#: Flags of missing values are kept as bits, so many columns to a number.
BITS = 62


def with_frames(df: DataFrame, frames: dict[str, Frame], keep: list[str], by: str = "symbol", order: str = "date") -> DataFrame:
    """`by`, `order`, the columns `keep` and the frames by name, of rows in the order of (by, order), a date.

    Columns are numbers of at most 2^53. A frame may be taken of a frame before it. Rows stay where `by` has dealt them.
    """
    types = dict(df.dtypes) | {k: "bigint" if f.kind in ("count", "below") else "double" for k, f in frames.items()}
    sent = list(dict.fromkeys([*keep, *[f.of for f in frames.values() if f.of not in frames]]))
    out = [order, *keep, *frames]

    @F.arrow_udf("struct<v: array<array<double>>, has: array<array<bigint>>>")
    def rows(*columns: pa.Array) -> dict:
        if len(columns[0]) > 1:
            days = columns[0].to_numpy(zero_copy_only=False)
            if not (days[1:] > days[:-1]).all():
                at = pc.sort_indices(columns[0], null_placement="at_start")
                columns = tuple(c.take(at) for c in columns)
        have = {k: (c.to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False) if c.null_count else np.ones(len(c), bool)) for k, c in zip([order, *sent], columns, strict=True)}
        with np.errstate(all="ignore"):
            while any(k not in have for k in frames):  # again for frames of frames
                _together({k: f for k, f in frames.items() if k not in have}, have)
        there = np.array([have[k][1] for k in out])
        flags = [np.left_shift(there[j : j + BITS].astype(np.int64), np.arange(len(there[j : j + BITS]))[:, None]).sum(axis=0) for j in range(0, len(out), BITS)]
        return {"v": [have[k][0] for k in out], "has": flags}

    grouped = df.groupBy(by).agg(rows(F.unix_date(order).cast("double"), *[F.col(c).cast("double") for c in sent]).alias("_s"))
    flags = [f"_has_{j}" for j in range(0, len(out), BITS)]
    zipped = F.arrays_zip(*[F.col("_s.v")[i].alias(k) for i, k in enumerate(out)], *[F.col("_s.has")[i].alias(k) for i, k in enumerate(flags)])

    def back(i: int, k: str):
        v = F.date_from_unix_date(F.col(k).cast("int")) if k == order else F.col(k).cast(types[k])
        return F.when(F.col(flags[i // BITS]).bitwiseAND(F.lit(1 << i % BITS)) != 0, v).alias(k)

    return grouped.select(by, F.inline(zipped)).select(by, *[back(i, k) for i, k in enumerate(out)])
