"""A stream's result equals the batch operator's on the same rows."""

from pyspark.sql import functions as F

from pitpanel.sources.adapters import ticks
from pitpanel.streaming import panels

SF = "/root/testdata/sf0.001"


def run(spark, tmp_path, df, mode="append"):
    q = df.writeStream.format("memory").queryName("q" + tmp_path.name.replace("-", "")).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(q.name)


def source(spark, tmp_path):
    batch = ticks(spark, SF)
    batch.write.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))


def test_bars_from_ticks(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    got = {tuple(r) for r in run(spark, tmp_path, panels.bars_from_ticks(stream), "complete").collect()}
    assert got == {tuple(r) for r in panels.bars_from_ticks(batch).collect()}


def test_transitions(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    level = lambda df: df.select("symbol", "event_id", F.unix_micros("ts").alias("at"), F.floor(F.col("value") / 20).cast("long").alias("level"))
    got = run(spark, tmp_path, panels.status_transitions(level(stream))).count()
    rows, last, n = level(batch).orderBy("at", "event_id").collect(), {}, 0
    for r in rows:
        n += r["symbol"] in last and r["level"] > last[r["symbol"]]
        last[r["symbol"]] = r["level"]
    assert got == n > 0


def test_maturation(spark, tmp_path):
    import datetime as dt

    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(5)]
    rows = [(1, days[0], 10.0, True), (1, days[1], 9.0, False), (1, days[2], 8.0, True), (1, days[3], None, False), (1, days[4], 7.0, False)]
    df = spark.createDataFrame(rows, "symbol long, date date, close double, signal boolean")
    df.write.parquet(str(tmp_path / "in"))
    out = run(spark, tmp_path, panels.outcome_maturation(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2)).orderBy("date").collect()
    assert [(r["date"], r["outcome"]) for r in out] == [(days[0], "MATURED"), (days[2], "UNRESOLVED_DATA_GAP")] and abs(out[0]["worst"] + 0.2) < 1e-12


def test_archive_commits_a_batch_once(spark, tmp_path):
    import datetime as dt

    import pytest

    day = lambda i: dt.date(2024, 1, i)
    schema = "model_date date, symbol long, snapshot_hash string"
    rows = lambda *x: spark.createDataFrame([(day(d), s, h) for d, s, h in x], schema)
    place = str(tmp_path / "archive")
    held = lambda: {(r["model_date"].day, r["symbol"], r["snapshot_hash"]) for r in panels.read_archive(spark, place, rows((1, 1, "a")).schema).collect()}

    def dies():
        raise RuntimeError("the batch dies here")

    assert held() == set()
    with pytest.raises(RuntimeError):
        panels.commit_batch(rows((1, 1, "a"), (1, 2, "a")), place, "x-0", dies)
    assert held() == set()  # written aside only
    assert panels.commit_batch(rows((1, 1, "a"), (1, 2, "a")), place, "x-0") and not panels.commit_batch(rows((1, 1, "a"), (1, 2, "a")), place, "x-0")
    assert held() == {(1, 1, "a"), (1, 2, "a")}
    assert panels.commit_batch(rows((1, 1, "b"), (2, 1, "b")), place, "x-1") and held() == {(1, 1, "a"), (1, 2, "a"), (2, 1, "b")}
    assert panels.commit_batch(rows((3, 1, "c")).limit(0), place, "x-2") and len(held()) == 3


def test_archive_stream_restarts_where_it_died(spark, tmp_path, monkeypatch):
    import datetime as dt

    df = spark.createDataFrame([(dt.date(2024, 1, 1 + i % 5), i, "h") for i in range(40)], "model_date date, symbol long, snapshot_hash string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    real, calls = panels.commit_batch, []

    def late(batch, path, name):
        real(batch, path, name)
        calls.append(name)
        if len(calls) == 1:
            raise RuntimeError("after the commit, before the stream's own")

    monkeypatch.setattr(panels, "commit_batch", late)
    go = lambda: panels.archive_sink(stream, str(tmp_path / "a"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    try:
        go()
    except Exception as e:
        assert "before the stream" in str(e)
    go()
    assert calls[0] == calls[1] and panels.read_archive(spark, str(tmp_path / "a"), df.schema).count() == 40
