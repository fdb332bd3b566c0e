"""The learned filter: its trees against plain loops, its folds, and its verdict against SQL over the p it wrote."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tickloom.operators import boosting as G
from tickloom.operators import labels as L
from tickloom.plans import registry
from tickloom.plans import research_queries as Q

SF = "/root/testdata/sf0.01"


def data(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    x[:, 2] = rng.integers(0, 3, n)
    chance = G.sigmoid(3 * (x[:, 0] > 0.3) * (x[:, 2] > 0) - 1 + x[:, 1])
    return x, (rng.random(n) < chance).astype(float)


def stump(x, g):
    """The split of lowest squared error over every feature and every middle between two values."""
    best = (np.inf, None, None)
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for cut in (v[1:] + v[:-1]) / 2:
            left = x[:, f] <= cut
            error = sum(((g[s] - g[s].mean()) ** 2).sum() for s in (left, ~left))
            if error < best[0] - 1e-9:
                best = error, f, cut
    return best


def test_the_first_split_is_the_best_there_is():
    x, y = data(60)
    start, features, edges, values = G.fit(x, y, G.Boosting(iterations=1, depth=1, subsample=1.0), 0)
    error, f, cut = stump(x, y - y.mean())
    left = x[:, features[0, 0]] <= edges[0, 0]
    g = y - y.mean()
    assert sum(((g[s] - g[s].mean()) ** 2).sum() for s in (left, ~left)) == pytest.approx(error)
    assert start == pytest.approx(np.log(y.mean() / (1 - y.mean())))
    h = y.mean() * (1 - y.mean())
    assert values[0].tolist() == pytest.approx([0.05 * g[left].mean() / h, 0.05 * g[~left].mean() / h])


def test_trees_learn_and_predict_what_they_scored():
    x, y = data(2000)
    how = G.Boosting(iterations=80)
    model = G.fit(x[:1000], y[:1000], how, 1)
    p = G.predicted(x[1000:], *model)
    rank = pd.Series(p).rank()
    won = y[1000:] == 1
    auc = (rank[won].sum() - won.sum() * (won.sum() + 1) / 2) / (won.sum() * (~won).sum())
    assert auc > 0.75
    loss = [-np.log(np.where(y[:1000] == 1, q, 1 - q)).mean() for q in (G.predicted(x[:1000], *G.fit(x[:1000], y[:1000], G.Boosting(iterations=k), 1)) for k in (1, 20, 80))]
    assert loss[0] > loss[1] > loss[2]


def test_a_node_that_cannot_split_sends_all_left():
    x, y = np.ones((20, 2)), np.array([0.0, 1.0] * 10)
    start, features, edges, values = G.fit(x, y, G.Boosting(iterations=3, subsample=1.0), 0)
    assert np.isinf(edges).all() and G.predicted(x, start, features, edges, values) == pytest.approx([0.5] * 20)


def test_folds_learn_only_from_what_was_before(spark):
    x, y = data(240)
    rows = [(i, f"2024-01-{i % 28 + 1:02d}", i // 60, None if i < 60 else i // 60 * 60 - 10, *map(float, v), int(w)) for i, (v, w) in enumerate(zip(x, y))]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "place long, date string, fold int, train_end long, a double, b double, c double, d double, win int")
    how = G.Boosting(iterations=10)
    models = G.fit_folds(df, {1: 50, 2: 110, 3: 170}, names, "win", how)
    got = {r.place: r.p for r in G.score_folds(df, models, names, how.depth).collect()}
    want = {}
    for k, end in ((1, 50), (2, 110), (3, 170)):
        want |= dict(zip(range(60 * k, 60 * k + 60), G.predicted(x[60 * k : 60 * k + 60], *G.fit(x[:end], y[:end], how, k))))
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)
    # A bound on the sample takes about as many rows; one class alone gives no model.
    assert G.fit_folds(df, {3: 170}, names, "win", G.Boosting(iterations=1, most=60)).count() == 1
    assert G.fit_folds(df.withColumn("win", df.fold * 0), {3: 170}, names, "win", how).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_verdict_on_the_learnt_p_equals_sql(spark, monkeypatch, tmp_path):
    learnt = registry.queries()["gbt_walkforward"](spark, SF)
    learnt.write.parquet(str(tmp_path / "p"))
    kept = spark.read.parquet(str(tmp_path / "p"))
    monkeypatch.setattr(Q, "_learnt", lambda s, d: kept)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW q AS SELECT * FROM '{tmp_path}/p/*.parquet'")
    folds = registry.queries()["walkforward_folds"](spark, SF).toPandas().set_index("fold")
    tested = folds[folds.train_end >= 0]
    assert duck.sql("SELECT fold, count(*) FROM q GROUP BY fold ORDER BY fold").fetchall() == [(k, n) for k, n in sorted(tested.n.items())]
    assert duck.sql("SELECT min(p) > 0 AND max(p) < 1 AND count(DISTINCT p) > 100 FROM q").fetchall()[0][0]
    table = duck.sql("""SELECT t.top, count(*), avg(win) * 100, avg(r), avg(r) - (SELECT avg(r) FROM q)
        FROM q, (VALUES (100), (70), (50), (30), (20)) AS t(top) WHERE p >= CASE top WHEN 70 THEN (SELECT quantile_cont(p, 0.3) FROM q) WHEN 50 THEN (SELECT quantile_cont(p, 0.5) FROM q)
        WHEN 30 THEN (SELECT quantile_cont(p, 0.7) FROM q) WHEN 20 THEN (SELECT quantile_cont(p, 0.8) FROM q) ELSE 0 END GROUP BY t.top ORDER BY t.top""").fetchall()
    got = [tuple(r) for r in registry.queries()["gbt_selectivity"](spark, SF).orderBy("top").collect()]
    assert [r[:2] for r in got] == [r[:2] for r in table]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in table], atol=2e-6)
    pairs = duck.sql("SELECT avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) FROM q a, q b WHERE a.win = 1 AND b.win = 0").fetchall()[0][0]
    gold = duck.sql("SELECT count(*), avg(r) FILTER (p >= (SELECT quantile_cont(p, 0.5) FROM q WHERE symbol = '3-MEDIUM')) - avg(r) FROM q WHERE symbol = '3-MEDIUM'").fetchall()[0]
    v = registry.queries()["gbt_verdict"](spark, SF).first()
    assert (v.n, v.gold_n) == (len(learnt.toPandas()), gold[0])
    assert v.auc == pytest.approx(pairs, abs=2e-6) and v.gold_gain == pytest.approx(gold[1], abs=2e-6)
    assert v.skilled == bool(pairs >= 0.52 and table[1][4] > 0.02) and table[1][0] == 30


@pytest.mark.parametrize("ranges", [2, 5, 64])
def test_quantiles_are_exact(spark, ranges):
    from tickloom.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(ranges)
    groups = {"a": rng.normal(size=500), "b": rng.integers(0, 4, 301).astype(float), "c": np.array([3.5]), "d": np.zeros(40)}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    shares = {"q0": 0.0, "q1": 0.13, "q5": 0.5, "q9": 0.9, "q10": 1.0}
    got = {r.g: list(r)[1:] for r in exact_quantiles(df, ["g"], "x", shares, ranges).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        assert got[g] == pytest.approx(np.quantile(values, list(shares.values())).tolist(), abs=1e-12)
    assert exact_quantiles(df.where("false"), [], "x", shares, ranges).collect() == []


def test_the_registered_walk_forward_boosts_as_often_as_the_reference():
    assert (G.Boosting().iterations, G.Boosting().depth, G.Boosting().rate, G.Boosting().subsample) == (160, 3, 0.05, 0.8)
    assert L.walk_forward.__defaults__ == (G.Boosting(),)
