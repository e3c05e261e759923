"""Models that are fitted here, each against a plain numpy version on the smallest tables."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.functions.quantiles import exact_quantiles
from pitpanel.operators import boosting, families, forecast, gram
from pitpanel.plans import studies

SF = "/root/testdata/sf0.001"
ALPHAS = (0.2, 0.5, 0.8)


@pytest.fixture(scope="module")
def panel(spark):
    d = studies.predictions(spark, SF).select("symbol", "date", "score", "vol20", "gap20", "dd60", "r", "matures").checkpoint()
    return d, d.toPandas()


def grown(x, y, edges, alpha, rounds, rate, depth, least, l2, ways):
    """Boosting on quantile loss, split by split and leaf by leaf."""
    b = np.stack([np.where(np.isnan(c), 0, 1 + np.searchsorted(e, c, "left")) for c, e in zip(x.T, edges, strict=True)], 1)
    f = np.full(len(y), np.sort(y)[boosting.rank_of(alpha, len(y)) - 1])

    def grow(rows, left):
        pull = lambda part: (y[part] > f[part]).sum() - (1 - alpha) * len(part)
        best = None
        for j in range(b.shape[1] if left else 0):
            for cut in range(max(map(len, edges)) + 1):
                low, high = rows[b[rows, j] <= cut], rows[b[rows, j] > cut]
                if min(len(low), len(high)) < least or (pull(high) / (len(high) + l2) - pull(low) / (len(low) + l2)) * ways[j] < 0:
                    continue
                gain = pull(low) ** 2 / (len(low) + l2) + pull(high) ** 2 / (len(high) + l2) - pull(rows) ** 2 / (len(rows) + l2)
                if best is None or gain > best[0]:
                    best = (gain, j, low, high)
        if best is None or best[0] <= 1e-9:
            return [rows, np.sort(y[rows] - f[rows])[boosting.rank_of(alpha, len(rows)) - 1]]
        return {"j": best[1], "low": grow(best[2], left - 1), "high": grow(best[3], left - 1)}

    leaves = lambda t: [t] if isinstance(t, list) else leaves(t["low"]) + leaves(t["high"])
    for _ in range(rounds):
        tree = grow(np.arange(len(y)), depth)
        todo = [tree]
        for t in todo:
            if isinstance(t, dict):
                if ways[t["j"]]:
                    low, high = (leaves(t["low"]), leaves(t["high"]))[:: ways[t["j"]]]
                    middle = (np.mean([v for _, v in low]) + np.mean([v for _, v in high])) / 2
                    for leaf in low:
                        leaf[1] = min(leaf[1], middle)
                    for leaf in high:
                        leaf[1] = max(leaf[1], middle)
                todo += [t["low"], t["high"]]
        step = np.zeros(len(y))
        for rows, v in leaves(tree):
            step[rows] = rate * v
        f = f + step
    return f


def test_boosted_quantiles_equal_plain_trees(spark, panel):
    d, p = panel
    d = d.withColumn("gap20", F.when(F.col("symbol") % 5 != 0, F.col("gap20")))  # some nulls
    model = boosting.fit_quantiles(d, ["score", "gap20"], "r", ALPHAS, rounds=10, rate=0.2, depth=2, least=20, bins=24, rising={"score": 1})
    got = model.transform(d, ["a", "b", "c"], crossing=True).select("symbol", "date", "score", "gap20", "r", "a", "b", "c").toPandas()
    x, y = got[["score", "gap20"]].to_numpy(float), got.r.to_numpy(float)
    for alpha, name in zip(ALPHAS, "abc", strict=True):
        assert np.allclose(got[name], grown(x, y, model.edges, alpha, 10, 0.2, 2, 20, 1.0, [1, 0]), atol=1e-12)
        assert abs((y <= got[name]).mean() - alpha) < 0.02
    flat = spark.createDataFrame([(1.0, 5.0)] * 30, "x double, y double")
    one = boosting.fit_quantiles(flat, ["x"], "y", rounds=2, least=5).transform(flat, ["a", "b", "c"]).distinct().collect()
    assert len(one) == 1 and (one[0]["a"], one[0]["c"]) == (5.0, 5.0)
    none = boosting.fit_quantiles(flat.limit(0), ["x"], "y", rounds=2).transform(flat.limit(2), ["a", "b", "c"]).collect()
    assert len(none) == 2 and all(r["b"] is None for r in none)


def test_rising_quantiles_never_fall(panel):
    d, _ = panel
    got = boosting.fit_quantiles(d, ["score"], "r", ALPHAS, rounds=9, rate=0.3, depth=2, least=30, rising={"score": 1}).transform(d, ["a", "b", "c"]).select("score", "a", "b", "c").toPandas().sort_values("score")
    for c in "abc":
        assert (np.diff(got[c]) >= -1e-12).all()
    assert (got.a <= got.b).all() and (got.b <= got.c).all()


def ic_of(y, p, dates, least):
    out = []
    for rows in pd.Series(np.arange(len(y))).groupby(dates).indices.values():
        if len(rows) >= least and np.std(y[rows]) > 1e-12 and np.std(p[rows]) > 1e-12:
            out.append(np.corrcoef(pd.Series(y[rows]).rank(), pd.Series(np.round(p[rows], 12)).rank())[0, 1])
    return np.mean(out) if out else 0.0


def test_pbo_equals_refitting_each_split(spark, panel, monkeypatch):
    d, p = panel
    candidates, blocks = [["score"], ["gap20"], ["score", "dd60"], ["dd60", "gap20", "score"]], 4
    real = gram.date_ics
    monkeypatch.setattr(gram, "date_ics", lambda *a: real(*a, least_names=3))
    got = gram.pbo_splits(d, candidates, "r", blocks=blocks, penalty=20.0, least_rows=50)
    p = p.dropna(subset=["score", "gap20", "dd60", "r"])
    of = {day: i for i, part in enumerate(np.array_split(np.array(sorted(p.date.unique())), blocks)) for day in part}
    block, y, want = p.date.map(of).to_numpy(), p.r.to_numpy(float), []
    for train in combinations(range(blocks), blocks // 2):
        inside = np.isin(block, train)
        ins, outs = [], []
        for c in candidates:
            x = p[c].to_numpy(float)
            mean = x[inside].mean(0)
            w = np.linalg.solve((x[inside] - mean).T @ (x[inside] - mean) + 20.0 * np.eye(len(c)), (x[inside] - mean).T @ (y[inside] - y[inside].mean()))
            ins.append(round(ic_of(y[inside], x[inside] @ w, p.date[inside].to_numpy(), 3), 12))
            outs.append(round(ic_of(y[~inside], x[~inside] @ w, p.date[~inside].to_numpy(), 3), 12))
        best = int(np.argmax(ins))
        place = list(np.argsort(outs, kind="stable")).index(best)
        want.append(("+".join(candidates[best]), round(ins[best], 6), round(outs[best], 6), (place + 0.5) / len(candidates), round(float(np.corrcoef(pd.Series(ins).rank(), pd.Series(outs).rank())[0, 1]), 6)))
    rows = got.orderBy("split").collect()
    assert [(r["selected"], round(r["selected_is"], 6), round(r["selected_oos"], 6), r["percentile"], round(r["rank_corr"], 6)) for r in rows] == want
    s = gram.pbo_refitted(got).first()
    assert s["splits"] == 6 and abs(s["pbo"] - np.mean([w[3] < 0.5 for w in want])) < 1e-12
    assert gram.pbo_refitted(gram.pbo_splits(d.limit(30), candidates, "r")).first()["pbo"] == 1.0


@pytest.mark.parametrize("h", [1, 2, 3, 5])
def test_walk_forward_equals_a_plain_loop(panel, h):
    d, p = panel
    features = ["score", "gap20", "dd60"]
    d, p = d.withColumn("v", F.col("vol20") / 16), p.assign(v=p.vol20 / 16)
    got, scales = gram.walk_forward(d, features, "r", "v", "matures", h, span=900, calibration=200, test=150)
    dates = np.array(sorted(p.date.unique()))
    p = p.dropna(subset=[*features, "v"]).reset_index(drop=True)
    v = np.maximum(p.v.to_numpy(float), 0.004)
    x, y, z = p[features].to_numpy(float), p.r.to_numpy(float), np.clip(p.r.to_numpy(float) / v, -4, 4)
    found = {(r["fold"], r["symbol"], r["date"]): r for r in got.collect()}
    frozen = {r["fold"]: r for r in scales.collect()}
    seen = 0
    for k, start in enumerate(np.linspace(len(dates) - 900, len(dates) - 150, 3, dtype=int)):
        a, b, c = dates[start - 200], dates[start], dates[start + 149]
        train = ((p.date < a) & (p.matures < a)).to_numpy()
        mean, sd = x[train].mean(0), x[train].std(0)
        s = (x[train] - mean) / sd
        w = np.linalg.solve(s.T @ s + 0.1 * train.sum() * np.eye(3), s.T @ (z[train] - z[train].mean()))
        raw = (z[train].mean() + (x - mean) / sd @ w) * v
        cal, test = ((p.date >= a) & (p.date < b) & (p.matures < b)).to_numpy(), ((p.date >= b) & (p.date <= c)).to_numpy()
        for part in (cal, test):
            keep = {2: 0.25, 3: 0.0}.get(h, 1.0)
            if keep < 1:
                raw[part] -= (1 - keep) * pd.Series(raw[part]).groupby(p.date[part].to_numpy()).transform("median").to_numpy()
            if part is cal:
                days = np.array_split(np.array(sorted(p.date[cal].unique())), 4)
                grid = np.linspace(0.1, 0.85 if h == 1 else 1.6, 25)
                best = [min(grid, key=lambda g: round(np.abs(y[rows] - raw[rows] * g).mean(), 12)) for rows in (cal & p.date.isin(part_).to_numpy() for part_ in days)]  # noqa: B023
                scale = np.quantile(best, 0.25)
                low, high = np.quantile((y[cal] - raw[cal] * scale) / v[cal], [0.2, 0.8])
        assert np.allclose([frozen[k + 1][n] for n in ("scale", "q20", "q80")], [scale, low, high]) and frozen[k + 1]["rows"] == train.sum()
        for i in np.flatnonzero(test):
            r = found[k + 1, p.symbol[i], p.date[i]]
            assert np.allclose([r["point"], r["low"], r["high"]], [raw[i] * scale, raw[i] * scale + low * v[i], raw[i] * scale + high * v[i]])
        seen += test.sum()
        m = gram.fold_metrics(got, 3).filter(F.col("fold") == k + 1).first()
        assert np.isclose(m["mae"], np.abs(y[test] - raw[test] * scale).mean()) and m["n"] == test.sum()
        assert np.isclose(m["coverage"], ((y[test] >= raw[test] * scale + low * v[test]) & (y[test] <= raw[test] * scale + high * v[test])).mean())
        assert np.isclose(m["rank_ic"], ic_of(y[test], raw[test], p.date[test].to_numpy(), 3), atol=1e-6)
    assert seen == len(found)


def test_walk_forward_needs_history(panel):
    d, _ = panel
    got, scales = gram.walk_forward(d.withColumn("v", F.col("vol20")), ["score"], "r", "v", "matures", span=5000)
    assert got.count() == 0 and scales.count() == 0


def test_exact_quantiles_equal_percentile(spark):
    r = np.random.default_rng(4)
    rows = [("a", float(x)) for x in r.normal(size=3000)] + [("b", float(x)) for x in np.exp(r.normal(scale=12, size=900))] + [("c", 0.0)] * 500 + [("c", 1e-12), ("d", -7.5), (None, 1.0), (None, 2.0), ("e", None), ("f", float("nan"))]
    rows += [("g", float(2.0**k)) for k in range(-1000, 1000)] + [("h", float(k % 3)) for k in range(1000)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    qs = {"q01": 0.01, "q20": 0.2, "half": 0.5, "q80": 0.8, "most": 1.0, "least": 0.0}
    want = {x["k"]: tuple(x["v"]) for x in df.filter("x is not null and not isnan(x)").groupBy("k").agg(F.percentile("x", list(qs.values())).alias("v")).collect()}
    got = {x["k"]: tuple(x[n] for n in qs) for x in exact_quantiles(df, ["k"], "x", qs).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12, atol=0) for k in want)
    assert exact_quantiles(df, [], "x", {"m": 0.5}).first()["m"] == df.filter("not isnan(x)").agg(F.percentile("x", 0.5)).first()[0]
    assert exact_quantiles(df.limit(0), ["k"], "x", {"m": 0.5}).count() == 0


def test_market_model_freezes_its_choices_before_the_sealed_dates(panel):
    d, p = panel
    d = d.withColumn("v", F.col("vol20") / 7).filter("v is not null").select("symbol", "date", "r", "v", "score", "gap20")
    cut = [d.filter(c) for c in ("date < '1999-01-01'", "date >= '1999-01-01' and date < '2000-06-01'", "date >= '2000-06-01'")]
    options = {"rounds": 4, "rate": 0.4, "depth": 2, "least": 30}
    out, frozen = forecast.market_model(*cut, ["score", "gap20"], "r", "v", 2, **options)
    got, f = out.toPandas(), frozen.first()
    other, f2 = forecast.market_model(cut[0], cut[1], cut[2].withColumn("r", -F.col("r")), ["score", "gap20"], "r", "v", 2, **options)
    again, f2 = other.toPandas(), f2.first()
    assert f == f2 and np.allclose(got.sort_values(["symbol", "date"]).point, again.sort_values(["symbol", "date"]).point)  # no sealed label is used
    assert len(got) == cut[2].count() and 0.5 <= f["magnitude_scale"] <= 2 and f["q20"] < f["q80"]
    assert np.allclose(got.high - got.low, (f["q80"] - f["q20"]) * got.v) and got.p_up.between(0, 1).all() and (got.magnitude > 0).all()
    inside = ((got.r >= got.low) & (got.r <= got.high)).mean()
    assert 0.45 < inside < 0.75 and np.corrcoef(got.r, got.point)[0, 1] > 0.2
    grid = forecast.dispersion_scale(cut[1].withColumns({"f": F.col("score") / 2, "p": F.lit(0.6)}), "r", "f", "p", "v", 1).toPandas()
    assert len(grid) == 60 and grid.chosen.sum() == 1 and grid.scale.max() <= 0.85 and set(grid.floor) == {0.0, 0.04}


def test_fitted_scales_follow_the_one_error_rule(spark, panel):
    d, p = panel
    long = d.filter("r is not null and score is not null").select(F.lit("origin_scale").alias("family"), "symbol", "date", F.col("r").alias("y"), F.lit(0.0).alias("base"), F.col("score").alias("x"))
    got = families.fit_scales(long, 5).first()
    y, x = p.r.to_numpy(float), p.score.to_numpy(float)
    mad = lambda v: np.median(np.abs(v - np.median(v)))
    upper = min(30.0, max(2.0, 2.5 * mad(y) / mad(x)))
    grid = np.unique(np.round(np.concatenate([np.linspace(0.05, min(2.0, upper), 40), np.geomspace(max(0.1, min(2.0, upper)), upper, 44) if upper > 2 else [], [1.0]]), 12))
    loss = np.abs(y[:, None] - x[:, None] * grid)
    mae, se = loss.mean(0), loss.std(0, ddof=1) / np.sqrt(len(y))
    best = mae.argmin()
    near = np.flatnonzero(mae <= mae[best] + se[best])
    target = np.clip(max(0.10 * y.std() / x.std(), 0.08 * np.quantile(np.abs(y), 0.9) / np.quantile(np.abs(x), 0.9)), grid.min(), grid.max())
    pick = near[np.abs(grid[near] - target).argmin()]
    assert np.allclose([got["scale"], got["mae"], got["best_mae"], got["target"]], [grid[pick], mae[pick], mae[best], target]) and got["admissible"] == len(near)
    assert families.fit_scales(long.limit(50), 5).count() == 0
