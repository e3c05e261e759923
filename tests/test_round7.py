"""Small tests of the findings of FINDINGS_r04."""

import numpy as np
from pyspark.sql import functions as F

from pitpanel.llm import simhash
from pitpanel.operators import models, reconcile
from pitpanel.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_points_are_not_broadcast(spark, monkeypatch):
    plans, write = [], simhash.checkpointed

    def kept(df):
        out = write(df)
        plans.append(plan(df))
        return out

    monkeypatch.setattr(simhash, "checkpointed", kept)
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('one two ', id % 90, ' three ', id % 7, ' four') AS text")
    assert simhash.near_fingerprints(docs).count() == 300
    laid_out = [p for p in plans if "Generate explode" in p]
    assert laid_out and not [p for p in laid_out if "BroadcastExchange" in p]


def test_violations_deal_bars_out_few_times_and_join_no_reference(spark):
    p = plan(registry.QUERIES["c06_violations"](spark, "/root/testdata/sf0.001"))
    assert p.count("REPARTITION_BY_COL") <= 4  # violations, known actions, tails, routes; all but the actions are the same shuffle
    assert p.count("Join") == 1  # violations and known actions


def test_splice_beside_is_splice_by_join(spark):
    d = spark.sql("SELECT s AS symbol, date_add(date'2020-01-01', cast(i * s as int)) AS date, i FROM VALUES (1, 60), (2, 40), (3, 1) AS t(s, n) LATERAL VIEW explode(sequence(1, n)) AS i")
    price = lambda *c: F.when(F.pmod(F.hash(*c), F.lit(11)) > 0, 10 + F.pmod(F.hash(*c), F.lit(7)))
    b = d.select("symbol", "date", price("i", "symbol").alias("close"), price("symbol", "i").alias("open"))
    moves = b.select("symbol").distinct().filter("symbol = 2").withColumn("transfer_date", F.lit("2020-02-10").cast("date"))
    ref = b.filter("open is not null").select("symbol", "date", F.col("open").alias("model_close"))
    names = ["symbol", "date", "from_date", "splice", "raw_return", "reference_return", "band_low", "model_close"]
    at = F.when(F.col("symbol") == 2, F.lit("2020-02-10").cast("date"))
    joined, beside = (x.select(*names).orderBy("symbol", "date").collect() for x in (reconcile.splice(b, ref, moves), reconcile.splice_beside(b, "open", at)))
    assert joined == beside and {r["splice"] for r in beside} == {"kept", "reference", "violation"}
    kept = {(r["symbol"], r["date"]) for r in reconcile.certified_suffix(reconcile.splice_beside(b, "open", at), 1).select("symbol", "date").collect()}
    last = {s: max((r["date"] for r in beside if r["symbol"] == s and r["splice"] == "violation"), default=None) for s in (1, 2, 3)}
    assert kept == {(r["symbol"], r["date"]) for r in beside if last[r["symbol"]] is None or r["date"] >= last[r["symbol"]]}


def outcomes(spark):
    """400 rows of 20 dates; a and b have nulls, a an infinite value."""
    u = lambda k: F.pmod(F.hash("id", F.lit(k)), F.lit(2001)) / 1000.0 - 1
    d = spark.range(0, 400, 1, 4).withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 20).cast("int"))).withColumns({"a": F.when(F.col("id") == 7, float("inf")).when(F.col("id") != 8, u(1)), "b": F.when(F.col("id") != 9, u(2)), "vol": 0.1 + F.abs(u(3))})
    return d.withColumn("y", F.coalesce(F.when(F.abs("a") < 2, F.col("a")), F.lit(0.5)) * 0.7 + u(4) * 0.2).localCheckpoint()


def test_fuzzy_rules_are_not_computed_anew_for_a_filter(spark):
    d = outcomes(spark)
    centres = [[-1.0, -0.5], [0.0, 0.0], [1.0, 0.5]]
    out = models.fuzzy_least_squares(d, d, ["a", "b"], centres, 1.0, "y")
    assert "atleastnnonnulls" not in plan(out).lower()
    got = {r["id"]: r["fuzzy"] for r in out.collect()}
    rows = d.filter("id not in (7, 8, 9)").collect()
    assert got.keys() == {r["id"] for r in rows}
    x, y = np.array([[r["a"], r["b"]] for r in rows]), np.array([r["y"] for r in rows])
    fire = np.exp(-((x[:, None] - np.array(centres)) ** 2).sum(2) / 2)
    z = (fire / (fire.sum(1, keepdims=True) + 1e-12))[:, :, None] * np.column_stack([np.ones(len(x)), x])[:, None]
    z = z.reshape(len(x), -1)
    want = z @ np.linalg.solve(z.T @ z / len(x) + 1e-4 * np.eye(z.shape[1]), z.T @ y / len(x))
    assert np.allclose([got[r["id"]] for r in rows], want, atol=0.02)


def test_market_part_needs_no_window_over_a_dates_rows(spark, monkeypatch):
    d = outcomes(spark).withColumn("a", F.when(F.abs("a") < 2, F.col("a")))
    plans, fit = [], models.regressor
    monkeypatch.setattr(models, "regressor", lambda t, *a: plans.append(plan(t)) or fit(t, *a))
    out = models.market_plus_alpha(d, d, ["a", "vol"], ["b", "vol"], "y")
    assert len(plans) == 2 and not [p for p in plans if "Window" in p]
    assert out.count() == 400 and out.filter("forecast is null").isEmpty()
    got = {r["date"]: r["market_part"] for r in out.select("date", "market_part").distinct().collect()}
    dates = d.groupBy("date").agg(F.median("y").alias("m"), F.avg("a").alias("a"), F.avg("vol").alias("vol")).localCheckpoint()
    want = {r["date"]: r["w"] for r in models.predict(fit(dates, ["a", "vol"], "m"), dates, ["a", "vol"], "w").collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_return_model_writes_its_vectors_once(spark, monkeypatch):
    d = outcomes(spark).withColumn("a", F.when(F.abs("a") < 2, F.col("a")))
    wrote, write = [], models.written
    monkeypatch.setattr(models, "written", lambda df: wrote.append(df.columns) or write(df))
    rows = d.drop("y")
    got = {r["id"]: (r["r"], r["p_up"]) for r in models.return_model(d, rows, ["a", "b"], "y", "vol").collect()}
    assert wrote == [["_t", "_up", "x"]]
    t = d.withColumns({"_t": models.clamp(F.col("y") / F.col("vol"), -4, 4), "_up": (F.col("y") > 0).cast("double")})
    z = models.predict(models.regressor(t, ["a", "b"], "_t", "absolute"), rows, ["a", "b"], "_z")
    each = models.probability(models.crash_classifier(t.drop("y"), ["a", "b"], "_up", "boosted"), z, ["a", "b"], "p_up").collect()
    assert len(got) == len(each) == 400
    assert np.allclose([got[r["id"]] for r in each], [(r["_z"] * r["vol"], r["p_up"]) for r in each])
