"""Small tests of the findings F15, F27 and F30 of FINDINGS_r03: long trailing frames are made in one pass, with the windows' values."""

import math

from pyspark.sql import functions as F

from pitpanel.operators import features
from pitpanel.plans import registry
from pitpanel.plans.panel import featured


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def bars(spark):
    """Of a long, a flat, a short and a one-day symbol, with closes and volumes missing."""
    d = spark.sql("SELECT s AS symbol, date_add(date'2020-01-01', cast(i as int)) AS date, i FROM VALUES (1, 400), (2, 90), (3, 7), (4, 1) AS t(s, n) LATERAL VIEW explode(sequence(1, n)) AS i")
    close = F.when(F.col("symbol") == 2, 7.1).when(F.pmod(F.hash("symbol", "i"), F.lit(23)) > 0, 50 + F.pmod(F.hash("i", "symbol"), F.lit(997)) / 7)
    d = d.withColumn("close", close).withColumn("volume", F.when(F.col("symbol") == 2, 3.3).otherwise(F.pmod(F.hash("i"), F.lit(11)) * 1.7))
    return d.select("symbol", "date", F.col("close").alias("open"), (F.col("close") * 1.1).alias("high"), (F.col("close") * 0.9).alias("low"), "close", "volume")


def test_frames_have_the_values_of_windows(spark):
    frames = features.STATE_FRAMES | features.REVERSAL_FRAMES | features.SCAN_FRAMES
    r = features.frame_inputs(features.returns(bars(spark)))
    ready = features.framed(r.orderBy(F.rand(1)), frames, ["high", "low", "close", "volume", *[f"ret{k}" for k in (1, 2, 5, 10, 20)]])
    assert "hashpartitioning(symbol" in plan(ready)
    names = ["symbol", "date", "vol20", "vol_pct", "vol_pct_incl", "gap20", "gap50", "gap200", "dd20", "dd60", "rsi_simple", "volume_z_prior", "shock_z", "rev_z", "vol_ratio", "vol_regime_shift", "range_regime_shift", "trend_compression"]
    got, want = ({(x["symbol"], x["date"]): x for x in features.reversal_b(features.reversal_a(featured(d))).select(*names).collect()} for d in (ready, features.realized_volatility(r)))
    assert got.keys() == want.keys() and len(got) == 498
    for k, x in want.items():
        for c in names[2:]:
            a, b = got[k][c], x[c]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (k, c, a, b)


def test_long_frames_are_not_taken_anew_by_row(spark):
    for q in ("d03_volatility_gaps", "j02_scores"):
        p = plan(registry.QUERIES[q](spark, "/root/testdata/sf0.001"))
        assert "RowFrame, -199, " not in p and "collect_list" not in p and p.count("ArrowAggregatePython") == 1
