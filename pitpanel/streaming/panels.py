"""Structured Streaming forms of the panel's batch operators; each gives the batch result once its input has ended.

The keyed-state operators (N3, N4) need the RocksDB state store: spark.sql.streaming.stateStore.providerClass set to
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType


def late_guard(ticks: DataFrame, delay: str = "2 hours", close_minute: int = 15 * 60 + 40, key: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """N1 rows of sessions that had closed by the row's own time, each key once within the watermark: a late copy replaces nothing."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    rows = ticks.withWatermark("ts", delay)
    return (rows.dropDuplicatesWithinWatermark(list(key)) if ticks.isStreaming else rows.dropDuplicates(list(key))).filter((minute >= close_minute) | (F.weekday("ts") >= 5))


def bars_from_ticks(ticks: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "2 days") -> DataFrame:
    """N2 open, high, low, close, volume per symbol and window of the events' time; tumbling, or sliding with `slide`."""
    rows = ticks.withWatermark("ts", delay) if ticks.isStreaming else ticks
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    order = F.struct("ts", "event_id")
    return rows.groupBy(w.alias("w"), "symbol").agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("ticks")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "ticks")


def event_sessions(ticks: DataFrame, condition: str, gap: str = "6 hours", delay: str = "2 days") -> DataFrame:
    """N6 runs of rows that meet a condition with at most `gap` between neighbours: start, end and rows per symbol."""
    rows = (ticks.withWatermark("ts", delay) if ticks.isStreaming else ticks).filter(condition)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "symbol").agg(F.count(F.lit(1)).alias("rows"), F.max("value").alias("peak")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "peak")


_TRANSITION = StructType([StructField("symbol", LongType()), StructField("at", LongType()), StructField("before", LongType()), StructField("level", LongType())])


class Transitions(StatefulProcessor):
    """State: a symbol's last level. Emits a row when the level rises."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", StructType([StructField("level", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, last = [], self.level.get()[0] if self.level.exists() else None
        for r in sorted((x for chunk in rows for x in chunk.itertuples()), key=lambda x: (x.at, x.event_id)):
            if last is not None and r.level > last:
                out.append((key[0], r.at, last, r.level))
            last = r.level
        if last is not None:
            self.level.update((int(last),))
        yield pd.DataFrame(out, columns=[f.name for f in _TRANSITION])

    def close(self) -> None:
        pass


def status_transitions(levels: DataFrame) -> DataFrame:
    """N3 a row whenever a symbol's level (symbol, event_id, at, level) rises; the state is one number per symbol."""
    return levels.groupBy("symbol").transformWithStateInPandas(statefulProcessor=Transitions(), outputStructType=_TRANSITION, outputMode="append", timeMode="None")


_OUTCOME = StructType([StructField("symbol", LongType()), StructField("date", DateType()), StructField("outcome", StringType()), StructField("worst", DoubleType())])


class Maturation(StatefulProcessor):
    """State: the signals of a symbol that wait, each with its close, worst close and number of later dates (at most `after`)."""

    def __init__(self, after: int = 20) -> None:
        self.after = after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", StructType([StructField("date", DateType())]), StructType([StructField("close", DoubleType()), StructField("worst", DoubleType()), StructField("seen", LongType()), StructField("missing", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {k[0]: list(v) for k, v in self.waiting.iterator()}
        known, out = set(held), []
        for r in sorted((x for chunk in rows for x in chunk.itertuples()), key=lambda x: x.date):
            gone = pd.isna(r.close)
            for date, s in list(held.items()):
                if date < r.date:
                    s[2] += 1
                    s[3] += int(gone)
                    if not gone:
                        s[1] = min(s[1], r.close)
                    if s[2] == self.after:
                        out.append((key[0], date, "UNRESOLVED_DATA_GAP" if s[3] else "MATURED", None if s[3] else s[1] / s[0] - 1))
                        del held[date]
            if not gone and r.signal:
                held[r.date] = [float(r.close), float("inf"), 0, 0]
        for date in known - held.keys():
            self.waiting.removeKey((date,))
        for date, s in held.items():
            self.waiting.updateValue((date,), tuple(s))
        yield pd.DataFrame(out, columns=[f.name for f in _OUTCOME])

    def close(self) -> None:
        pass


def outcome_maturation(closes: DataFrame, after: int = 20) -> DataFrame:
    """N4 each signal row of (symbol, date, close, signal) held until `after` later rows of its symbol, then its outcome.

    A row without a close is a data gap. Replays are made harmless by the archive's first write (archive_sink).
    """
    return closes.groupBy("symbol").transformWithStateInPandas(statefulProcessor=Maturation(after), outputStructType=_OUTCOME, outputMode="append", timeMode="None")


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and what makes paths of it: the archive may lie in any store that Spark writes to."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def read_archive(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """N5 the rows of all committed batches of an archive; none if it does not exist."""
    fs, of = _files(spark, path)
    done = [str(x.getPath()) for x in fs.listStatus(of(path)) if x.getPath().getName().startswith("batch-")] if fs.exists(of(path)) else []
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def commit_batch(batch: DataFrame, path: str, name: str, between: Callable[[], None] = lambda: None) -> bool:
    """N5 append a batch's new model dates to an archive under a name, once: True, or False if the name is committed already.

    Dates that other committed batches have are left out (the first write wins). The rest is written aside and renamed
    to batch-<name>; the rename is the commit, and the directories are the ledger. A batch that dies before it leaves
    nothing that a reader sees and is written anew by its replay; one that dies after it is recognised by its name.
    `between` is called between both steps (tests fail there).
    """
    from ..sources.readers import archive_first_write

    fs, of = _files(batch.sparkSession, path)
    target, staged = of(f"{path}/batch-{name}"), f"{path}/_staged/{name}"
    if fs.exists(target):
        return False
    fresh, _revisions = archive_first_write(read_archive(batch.sparkSession, path, batch.schema), batch)
    fresh.write.mode("overwrite").parquet(staged)
    between()
    if not fs.rename(of(staged), target):
        raise OSError(f"could not commit {target}")
    return True


def archive_sink(stream: DataFrame, path: str, checkpoint: str):
    """N5 a writer that archives each model date of a stream exactly once; read the archive by read_archive().

    Batches are named by the stream's checkpoint folder and number, which a restarted stream repeats for the batch that
    it did not finish. A stream that starts over needs a new checkpoint folder, as always.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def append(batch: DataFrame, number: int) -> None:
        commit_batch(batch, path, f"{run}-{number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
