"""Small tests of the findings of FINDINGS_r03: limits that bind exactly, one shuffle of bars, passes over packed rows."""

import datetime

import duckdb

from pitpanel.operators import boosting, text, validate
from pitpanel.plans import registry

DAY = datetime.date(2000, 1, 1)


def test_quintiles_hold_a_drawdown_that_equals_the_bound(spark):
    train = [-0.500001, -0.499901, *[-0.1] * 12]  # 14 of 20 rows: the bound lies .65 between the first two, at -.499936
    for at in (-0.499936, -0.499935):
        rows = [(1, DAY + datetime.timedelta(i), 0.5, dd) for i, dd in enumerate([*train, *[at] * 6])]
        got = validate.score_quintiles(spark.createDataFrame(rows, "symbol long, date date, score double, fwd_dd double")).collect()
        assert [(r["n"], r["event_rate"]) for r in got] == [(6, float(at <= -0.499936))]
    cut = duckdb.execute("SELECT round(quantile_cont(x, 0.05), 9) FROM (SELECT unnest(?) AS x)", [train]).fetchone()[0]
    assert cut == -0.499936


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exponential_means_share_one_sort(spark):
    p = plan(registry.QUERIES["d05_ema_macd"](spark, "/root/testdata/sf0.001"))
    assert p.count("Sort [") == 2 and p.count("Exchange ") == 1  # lines by symbol and date; bars by block


def test_scan_is_dealt_out_once(spark):
    p = plan(registry.QUERIES["j18_stance"](spark, "/root/testdata/sf0.001"))
    assert p.count("Exchange hashpartitioning(symbol") == 2 and p.count("Exchange hashpartitioning(date") == 1  # the scan's and the medians' lines; medians


def test_boosting_passes_over_packed_rows(spark, monkeypatch):
    seen, before = [], boosting.written
    def counted(df):
        out = before(df)
        seen.append(out.count())
        return out
    monkeypatch.setattr(boosting, "written", counted)
    d = spark.range(0, 1000, 1, 2).selectExpr("cast(id % 7 as double) AS x", "cast(id % 7 + id % 3 as double) AS y")
    model = boosting.fit_quantiles(d, ["x"], "y", (0.5,), rounds=9, depth=2, least=5)
    assert len(model.trees) == 9 and seen == [2, 2]  # a record a task, at the start and after eight trees


def test_titles_are_matched_only_where_a_bound_allows_it(monkeypatch):
    assert [text.in_order(*x) for x in (("abcbdab", "bdcaba"), ("", "a"), ("abc", "abc"), ("ab", "ba"))] == [4, 0, 3, 1]
    a, b = "abcdefgh" * 12, "hgfedcba" * 12  # the same letters in another order
    want = text.title_ratio(a, b)
    assert want < 0.91 and text.title_ratio(a, a, 0.91) == 1.0 == text.title_ratio("", "", 0.91)
    monkeypatch.setattr(text, "SequenceMatcher", None)
    assert text.title_ratio(a, b, 0.91) == 0.0


def test_bootstrap_does_not_repeat_rows_by_replicate(spark, monkeypatch):
    seen, before = [], validate.written
    def counted(df):
        out = before(df)
        seen.append((out.count(), len(out.columns)))
        return out
    monkeypatch.setattr(validate, "written", counted)
    d = spark.range(0, 3000, 1, 3).selectExpr("id % 30 AS unit", "cast(id % 7 = 0 as int) AS y", "cast(id * 7919 % 101 as double) AS score")
    r = validate.bootstrap_precision(d, "unit", 40).first()
    assert r["replicates"] == 40 and 0.05 < r["low"] <= r["median"] <= r["high"] < 0.4
    assert sorted(n for n, _ in seen)[-2:] == [3000, 3000] and len(seen) == 3
