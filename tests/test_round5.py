"""Small tests of the findings of FINDINGS_r03 that the round after took up."""

import pytest

from pitpanel.functions.checkpoints import written
from pitpanel.operators import models, text, validate, xsection
from pitpanel.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_expert_stack_joins_no_rows(spark):
    d = written(spark.range(4000).selectExpr("id % 40 AS symbol", "date_add(date'2000-01-01', cast(id div 40 as int)) AS date", "date_add(date'2000-01-03', cast(id div 40 as int)) AS matures", "cast(id % 7 as double) AS a", "cast(id * 31 % 11 as double) AS b", "cast(id % 7 + 2 * (id * 31 % 11) as double) AS r"))
    s = models.expert_stack(d, written(validate.chrono_split(d)), {"one": ["a"], "two": ["b"]}, "r", "matures")
    p = plan(s)
    assert "Inner" not in p and "LeftSemi" in p  # dates choose rows; no part is joined to another by row
    assert s.count() == s.select("symbol", "date", "fold").distinct().count() > 0
    assert s.columns == ["symbol", "date", "fold", "r", "e_one", "e_two", "stacked"]
    assert max(abs(x["r"] - x["stacked"]) for x in s.collect()) < 1.5  # r is a sum of both experts' features


def test_ranks_share_one_sort(spark):
    p = plan(registry.QUERIES["e01_ranks"](spark, "/root/testdata/sf0.001"))
    by_date = p[: p.index("SortAggregate")] if "SortAggregate" in p else p
    assert by_date.count("Sort [date") == 1 and p.count("Exchange hashpartitioning(date") == 1


def test_ranks_keep_their_places_with_nulls_and_ties(spark):
    rows = [("d", i, x) for i, x in enumerate([None, 2.0, 1.0, 2.0, None])]
    df = spark.createDataFrame(rows, "date string, symbol long, x double")
    r = sorted(xsection.rank_signal(xsection.percentile_ranks(xsection.percentile_ranks(xsection.ordinal_rank(df, "x", "o"), "x", "up"), "x", "down", True), "x", "s").collect(), key=lambda r: r["symbol"])
    assert [x["o"] for x in r] == [0.0, 0.75, 0.5, 1.0, 0.25]
    third = 1 / 3
    assert [x["up"] for x in r] == [None, pytest.approx(2.5 * third), pytest.approx(third), pytest.approx(2.5 * third), None]
    assert [x["down"] for x in r] == [None, pytest.approx(1.5 * third), pytest.approx(3 * third), pytest.approx(1.5 * third), None]


def test_panel_is_read_once(spark):
    """Of the backtest's bounds and rows, and of the latest rows' drivers, alerts and scenarios."""
    assert plan(registry.QUERIES["k41_index_backtest"](spark, "/root/testdata/sf0.001")).count("Scan parquet") == 1
    assert plan(registry.QUERIES["j08_drivers_alerts"](spark, "/root/testdata/sf0.001")).count("Scan parquet") == 0  # written before


def test_novelty_makes_no_row_a_pair(spark):
    at = lambda d: f"timestamp'2000-01-01' + make_interval(0, 0, 0, {d})"
    items = spark.sql("SELECT * FROM VALUES (1, 1L, 'a b c d', 0), (1, 2L, 'a b c e', 3), (1, 3L, 'x', 3), (1, 4L, 'a b c d', 33), (1, 5L, '', 34), (2, 6L, 'a b c d', 40), (1, 7L, 'e x', 30), (1, 8L, cast(null as string), 64), (1, 9L, 'a b c d', 64) t(symbol, id, title, day)").selectExpr("symbol", "id", "title", f"{at('day')} AS published_at")
    got = text.novelty(items)
    assert {r["id"]: round(r["novelty"], 6) for r in got.collect()} == {1: 1.0, 2: 0.4, 3: 1.0, 4: 0.4, 5: 1.0, 6: 1.0, 7: 0.5, 8: 1.0, 9: 1.0}
    assert plan(text.novelty(items)).count("Join") == 1  # items with their own best
