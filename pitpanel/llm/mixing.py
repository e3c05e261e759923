"""Mixing sources to target weights with hash thresholds; DataFrame operations only.

Sizes are summed by source and hash bucket. A source's budget is whole passes over the source plus a rest; the rest
is met by a threshold on the documents' hashes. The threshold is found digit by digit: the histogram of the leading
digits shows in which bucket the budget runs out, and only that bucket is split further. A document is then taken once
more or not by comparing its hash with its source's threshold: no sort, and nothing is kept by document but its hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SQL, checkpointed

#: Hexadecimal digits of the hash that each level of the histogram takes: 12 bits, then 10 digits in three more steps.
LEVELS = (3, 3, 3, 3)
#: A source is repeated at most so often.
MOST_PASSES = 3
#: Up to so many sources, their plan is broadcast.
MOST_BROADCAST = 20_000


def word_count(text: str = "text") -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_SQL)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight and target of each source of `sizes` (source, size).

    Sources in order of code points, null last, weigh 1, 2, 3, 1, 2, ... The total is shared by weight; a share stops
    at MOST_PASSES times its source's size and the rest is shared again. The result is min(weight x level, stop) with
    one level for all sources: sources stop in the order of stop / weight, so the level is found by running sums.
    One row per source; the windows over all sources hold no document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per.withColumn("weight", ((F.row_number().over(in_order) - 1) % 3 + 1).cast("double")).withColumn("stop", F.col("source_size") * float(MOST_PASSES))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_stop.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = weighed.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))).withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the first source, in the order of stopping, that does not stop fixes the level
    level = F.min(F.when(F.col("rest") / F.col("weights") <= F.col("stop") / F.col("weight"), F.struct(F.col("stop") / F.col("weight"), F.col("rest") / F.col("weights")))).over(everything)
    return left.withColumn("level", F.coalesce(level["col2"], F.lit(float("inf")))).select("source", "source_size", "weight", F.least(F.col("weight") * F.col("level"), F.col("stop")).alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """source and cut: documents of `docs` (source, size, h) with h < cut sum to the source's `rest`, as nearly as whole hashes allow.

    Level by level: sums by source and the next digits of h within the boundary bucket, and the bucket in which the
    rest runs out. On the last level the bucket (one hash) is taken too if that comes nearer.
    """
    state = budgets.select("source", F.lit("").alias("prefix"), F.col("rest"))
    digits = 0
    for step in LEVELS:
        digits += step
        inside = docs.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & F.col("h").startswith(F.col("prefix")))
        bucket = inside.groupBy("source", F.substring("h", 1, digits).alias("bucket")).agg(F.sum("size").alias("tokens"), F.first("rest").alias("rest"), F.first("prefix").alias("prefix"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        run = bucket.withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
        last = digits == sum(LEVELS)
        take = F.col("before") + F.col("tokens") <= F.col("rest") if not last else F.col("before") + F.col("tokens") / 2.0 <= F.col("rest")
        # the first bucket that no longer fits; where all fit, what comes after all hashes with this prefix
        edge = run.groupBy("source").agg(F.min(F.when(~take, F.struct("bucket", "before", "rest"))).alias("edge"), F.first("prefix").alias("prefix"))
        state = edge.select("source", F.coalesce("edge.bucket", F.concat("prefix", F.lit("g"))).alias("prefix"), F.coalesce(F.col("edge.rest") - F.col("edge.before"), F.lit(0.0)).alias("rest"), F.col("edge").isNull().alias("whole"))
        if not last:
            # a source whose boundary is already decided (all of it is taken) keeps its state
            done = state.filter("whole").select("source", "prefix", "rest")
            state = state.filter("not whole").select("source", "prefix", "rest")
            over = done if digits == LEVELS[0] else over.unionByName(done)
    return over.unionByName(state.select("source", "prefix", "rest")).select("source", F.col("prefix").alias("cut"))


def _hash() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def _planned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, size, h of every row; and s, source_size, target, passes, cut of every source."""
    rows = checkpointed(docs.select("doc_id", "source", word_count().alias("size"), _hash().alias("h")))
    passes = F.least(F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))), F.lit(MOST_PASSES)).cast("long")
    budgets = checkpointed(source_targets(rows).withColumn("passes", passes).withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))))
    cuts = thresholds(rows.filter("size > 0"), budgets).withColumnRenamed("source", "s")
    plan = budgets.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "passes", F.coalesce("cut", F.lit("")).alias("cut"))
    return rows, checkpointed(plan)


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their source's plan: broadcast if it has at most MOST_BROADCAST sources (some MB), else joined by shuffle."""
    small = plan.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return rows.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("s")))


def _times() -> Column:
    return F.col("passes") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)


def mix_sources(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text, source, more) with the words the mix takes of it.

    Returns doc_id, size (words), source_size, target (of its source) and taken: whole passes over the source plus
    one more pass over the documents below its threshold, so at most MOST_PASSES times the size. The hash is MD5 of
    the doc_id, so reruns agree; rows with equal or null doc_ids go together. Empty and null texts have size 0 and
    nothing taken; a source of only such texts has target 0; a null source is a source. An empty table gives no rows.
    The sources' plan (a row per source) is counted and broadcast up to MOST_BROADCAST sources, else joined by shuffle.
    """
    rows, plan = _planned(docs)
    return _with_plan(rows, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with docs' own columns.

    Rows without words weigh nothing and are passed on once. The texts are not shuffled.
    """
    _, plan = _planned(docs)
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source"), _hash().alias("h"), word_count().alias("size"))
    often = _with_plan(rows, plan).select("row", F.when(F.col("size") == 0, 1).otherwise(_times()).cast("int").alias("times"))
    return often.filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col("row").getField(c).alias(c) for c in names])
