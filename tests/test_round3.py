"""Small tests of the third round's findings: what is written, what is joined, and scores at their limits."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pitpanel.functions import quantiles
from pitpanel.operators import families, models, validate
from pitpanel.plans import panel, readings, studies


def test_losses_of_all_scales_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(f, float(y), float(b), float(x)) for f in ("a", "b") for y, b, x in zip(rng.normal(size=400), rng.normal(size=400), np.r_[rng.normal(size=380), np.zeros(20)])]
    rows += [("a", 0.5, 0.0, 1.0), ("a", -0.5, 0.0, -1.0)]  # bend on a scale
    steps = {"a": [0.0, 0.25, 0.5, 2.0], "b": [0.05, 1.0]}
    got = {(r["family"], r["scale"]): r for r in families._losses(spark.createDataFrame(rows, "family string, y double, base double, x double").repartition(3), steps).collect()}
    assert len(got) == 6
    for (f, s), r in got.items():
        loss = np.array([abs(y - b - s * x) for g, y, b, x in rows if g == f])
        assert r["n"] == len(loss)
        np.testing.assert_allclose([r["mae"], r["sd"]], [loss.mean(), loss.std(ddof=1)], rtol=1e-10)


def test_exact_quantiles_write_only_what_may_hold_them(spark, monkeypatch):
    seen, before = [], quantiles.written
    def counted(df):
        out = before(df)
        seen.append(out.count())
        return out
    monkeypatch.setattr(quantiles, "written", counted)
    x = np.random.default_rng(1).normal(size=4000)
    d = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(x)], "k int, x double")
    got = {r["k"]: (r["m"], r["q"]) for r in quantiles.exact_quantiles(d, ["k"], "x", {"m": 0.5, "q": 0.9}).collect()}
    for k in (0, 1):
        np.testing.assert_allclose(got[k], np.quantile(x[k::2], [0.5, 0.9]), rtol=1e-12)
    assert max(seen) < 400


def test_linear_scorer_does_not_shuffle_rows(spark):
    rows = spark.createDataFrame([(1, 0.5, None), (2, None, 2.0)], "id int, a double, b double")
    c = spark.createDataFrame([("a", 1.0, 0.0, 2.0, 0.5), ("b", 3.0, 1.0, 0.0, 9.0), ("(intercept)", None, None, None, -1.0)], "feature string, median double, mean double, sd double, weight double")
    out = validate.linear_scorer(rows, c, ["id"])
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["linear"] for r in out.collect()} == {1: -0.875, 2: -0.75}


def test_contributions_find_medians_by_refinement(spark, monkeypatch):
    found, before = [], readings.exact_quantiles
    monkeypatch.setattr(readings, "exact_quantiles", lambda *a: found.append(a[1:]) or before(*a))
    rest = readings.QUERIES["k35_contributions"](spark, "/root/testdata/sf0.001").first()["rest"]
    assert rest is None or rest < 1e-6
    assert found == [(["feature"], "v", {"median": 0.5})]


def test_class_weights_are_broadcast(spark):
    d = spark.range(1000).select((F.col("id") % 10 == 0).cast("double").alias("y"))
    b = models.balanced(d.withColumn("x", F.lit(1.0)), "y")
    assert "rightHint=(strategy=broadcast)" in b._jdf.queryExecution().analyzed().toString() or "ResolvedHint (strategy=broadcast)" in b._jdf.queryExecution().analyzed().toString()
    assert {r["y"]: round(r["s"], 6) for r in b.groupBy("y").agg(F.sum("weight").alias("s")).collect()} == {0.0: 500.0, 1.0: 500.0}


def test_flagship_takes_the_deepest_by_unrounded_drawdown(spark, tmp_path):
    last = {1: 203.0, 2: 198.0} | {s: 100.0 for s in range(3, 22)}
    rows = [(s, 1, s, 1, p, 1.0, d) for s, q in last.items() for p, d in ((100000.0, "2000-01-03"), (q, "2000-01-04"))]
    t = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_extendedprice double, l_quantity double, d string")
    t.withColumn("l_shipdate", F.to_timestamp("d")).drop("d").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["symbol"] for r in panel.QUERIES["flagship_technical_state"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == {r[0] for r in c.execute(panel.ORACLES["flagship_technical_state"]).fetchall()} == set(range(2, 22))


def test_market_scan_phases_take_scores_that_just_miss_a_limit(spark, monkeypatch):
    d = spark.createDataFrame([(1, 64.99999999999999), (2, 65.0), (3, 64.9)], "symbol int, technical_score double")
    d = d.withColumns({"date": F.lit("2000-01-03").cast("date"), "status": F.lit("WATCH"), "prev_status": F.lit("WATCH"), "technical_score_confidence": F.lit(0.55 - 1e-16), "dd60": F.lit(-0.2), "sret20": F.lit(-0.1), "gap50": F.lit(-0.1)})
    monkeypatch.setattr(studies, "_scan", lambda *a: d)
    assert studies.QUERIES["j03_market_scan"](spark, "").first()["pre_yellow"] == 2
