"""Column expressions shared by the operators; all are built-in functions, so plans stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import written


def by_symbol(symbol: str = "symbol", date: str = "date"):
    """The one window order of all per-symbol features, so that Spark sorts once for them."""
    return Window.partitionBy(symbol).orderBy(date)


def trailing(n: int, last: int = 0):
    """The n rows that end `-last` rows before the current one (last = 0: the current row is the last)."""
    return by_symbol().rowsBetween(last - n + 1, last)


def following(n: int):
    """The n rows after the current one."""
    return by_symbol().rowsBetween(1, n)


def clamp(x: Column, low: float, high: float) -> Column:
    """x held within [low, high]; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def finite(x: Column) -> Column:
    """x, with NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def logit(p: Column, edge: float = 1e-5) -> Column:
    p = clamp(p, edge, 1 - edge)
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def full(x: Column, window, n: int) -> Column:
    """x where the window holds n non-null rows of what x is made from, else null; for rules that need all rows."""
    return F.when(F.count(F.lit(1)).over(window) >= n, x)


def average_rank(order: str, partition: list[str], descending: bool = False) -> Column:
    """Percentile rank with ties at their average rank: (rank + (ties - 1) / 2) / count. Null values have none.

    The rows up to a value and those below it (the others' count) give rank and ties, so one order of the partition, with
    nulls last, serves all; a window by value would sort the rows again.
    """
    by = Window.partitionBy(*partition).orderBy(F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last())
    upto, ties = F.count(order).over(by.rangeBetween(Window.unboundedPreceding, 0)), F.count(order).over(by.rangeBetween(0, 0))
    return F.when(F.col(order).isNotNull(), (upto - (ties - 1) / 2.0) / F.count(order).over(Window.partitionBy(*partition)))


#: Rows of a block of exponential means: short enough for powers to stay in range and long enough for what lies before the last block to vanish, for the decays in use.
BLOCK = 1024


def ema_block(alpha: float) -> int:
    """Rows of a block for a decay: BLOCK, so that means share their blocks, unless the decay needs another length."""
    slow = -math.log(1.0 - alpha) if alpha < 1 else math.inf
    return BLOCK if 40 <= BLOCK * slow <= 600 else max(2, int(600 / slow))


def _blocked(block: int):
    """Windows within a symbol's block and over the rows before: both in the order of (symbol, block, date), so that one sort serves them."""
    at = f"_block_{block}"
    return Window.partitionBy("symbol", at).orderBy("date").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("symbol").orderBy(at, "date").rowsBetween(Window.unboundedPreceding, -1)


def ema(x: str, alpha: float) -> Column:
    """Recursive exponential mean, seeded by the first value: e = a x + (1 - a) e'.

    In closed form, e_i = q^i (x_0 + a sum x_j q^-j). Rows are taken in blocks so short that q^-j stays in range and
    so long that what lies more than one block back has vanished; a block takes over the last value of the one before.
    Needs the row's place in its symbol, from 0, as column `_i` and its block (see with_emas).
    """
    q, block = 1.0 - alpha, ema_block(alpha)
    j = F.col("_i") % block
    weight = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    return F.pow(F.lit(q), j) * F.sum(weight * F.col(x) * F.pow(F.lit(q), -j)).over(_blocked(block)[0])


def ema_carry(local: str, alpha: float) -> Column:
    """What ema() needs from the blocks before; zero for series of one block."""
    q, block = 1.0 - alpha, ema_block(alpha)
    ended = F.last(F.when(F.col("_i") % block == block - 1, F.col(local)), ignorenulls=True).over(_blocked(block)[1])
    return F.col(local) + F.pow(F.lit(q), F.col("_i") % block + 1) * F.coalesce(ended, F.lit(0.0))


def with_emas(df, means: dict[str, tuple[str, float]]):
    """df with the exponential means named in `means` (name: column and alpha); rows in the order of (symbol, date).

    Their places `_i` and blocks stay as columns: means of means then need no other sort.
    """
    placed = df if "_i" in df.columns else df.withColumn("_i", F.row_number().over(by_symbol()) - 1)
    blocks = {ema_block(a) for _, a in means.values()}
    placed = placed.withColumns({f"_block_{b}": F.floor(F.col("_i") / b) for b in blocks if f"_block_{b}" not in placed.columns})
    local = placed.withColumns({f"_local_{k}": ema(x, a) for k, (x, a) in means.items()})
    return local.withColumns({k: ema_carry(f"_local_{k}", a) for k, (_, a) in means.items()}).drop(*[f"_local_{k}" for k in means])


def with_ema(df, name: str, x: str, alpha: float):
    """df with the exponential mean of column x as column `name`; rows in the order of (symbol, date)."""
    return with_emas(df, {name: (x, alpha)})


#: Accented letters of Vietnamese and Western European text, and the letters they fold to.
_ACCENTS = {
    "a": "àáảãạăằắẳẵặâầấẩẫậäåā", "c": "ç", "d": "đ", "e": "èéẻẽẹêềếểễệëē", "i": "ìíỉĩịîïī", "n": "ñ",
    "o": "òóỏõọôồốổỗộơờớởỡợöøō", "u": "ùúủũụưừứửữựûüū", "y": "ỳýỷỹỵÿ",
}


def fold(text: Column) -> Column:
    """Lower case without accents."""
    source = "".join(_ACCENTS.values())
    return F.translate(F.lower(text), source, "".join(k * len(v) for k, v in _ACCENTS.items()))


def ordered_totals(df: DataFrame, order: list[str], values: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """df with the running total of each value in the order of columns, the row itself included; within `by`, if given.

    Rows are dealt out by ranges of (by, order), as many as the session shuffles into, so no task holds all rows or, as
    long as `order` tells rows apart, one value. Each range is summed up in its own order and starts from the sums of
    those before, which are a row a range. The table is written to the checkpoint folder between both steps: the ranges
    must not change. Rows equal in `order` share a range and come in any order: sum them up first where they are many.
    """
    own = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranged = df.repartitionByRange(*[F.col(c) for c in (*by, *order)]).withColumn("_range", F.spark_partition_id())
    placed = written(ranged.withColumns({k: F.sum(v).over(own) for k, v in values.items()} | {f"_own_{k}": v for k, v in values.items()}))
    sums = placed.groupBy(*by, "_range").agg(*[F.sum(f"_own_{k}").alias(f"_{k}") for k in values])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = sums.select(*by, "_range", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in values])
    out = placed.join(starts if by else F.broadcast(starts), [*by, "_range"])
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(0)) + F.col(f"_{k}") for k in values}).drop("_range", *[f"_{k}" for k in values], *[f"_own_{k}" for k in values])


def ntile_of(place: Column, n: Column, bins: int) -> Column:
    """The bin, from 1, of the row at a place from 1 of n, as ntile deals them out: the first n % bins bins hold one row more."""
    q, r = F.floor(n / bins), n % bins
    return F.when(place <= r * (q + 1), F.floor((place - 1) / (q + 1)) + 1).otherwise(F.floor(F.try_divide(place - 1 - r, q)) + 1).cast("int")
