"""Boosted trees: splits, patience, contributions, grouped fits, permutation importance and the run log."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.operators import boosting, learners, sentiment, serve


def problem(n=1200, features=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, features))
    y = ((x[:, 0] > 0) * 2 + (x[:, 1] * x[:, 2] > 0)).astype(int)
    bins = np.stack([np.searchsorted(np.quantile(c, np.arange(1, 32) / 32), c) for c in x.T]).astype(np.uint8)
    return x, bins, y


def test_first_tree_takes_the_best_splits():
    """Depth 1 on all rows and features: gain and leaf values against a search over all cuts."""
    _, bins, y = problem(300)
    p = boosting.Params(rounds=1, depth=1, row_fraction=1.0, feature_fraction=1.0, min_weight=5.0, min_rows=10)
    model = boosting.train(bins, y, np.zeros(300, bool), p)
    for c in range(5):
        g, h = 0.2 - (y == c), np.full(300, 2 * 0.2 * 0.8)
        shrunk = lambda v: np.sign(v) * max(abs(v) - p.alpha, 0)
        score = lambda m: shrunk(g[m].sum()) ** 2 / (h[m].sum() + p.lam)
        gains = {(f, b): score(bins[f] <= b) + score(bins[f] > b) - score(np.ones(300, bool)) for f in range(6) for b in range(31)
                 if min((bins[f] <= b).sum(), (bins[f] > b).sum()) >= 10 and min(h[bins[f] <= b].sum(), h[bins[f] > b].sum()) >= p.min_weight}
        root = model.roots[0, c]
        if model.feature[root] < 0:
            assert max(gains.values()) <= 1e-9
            continue
        f, b = int(model.feature[root]), int(model.cut[root])
        assert gains[f, b] == pytest.approx(max(gains.values()))
        left = bins[f] <= b
        for child, m in ((0, left), (1, ~left)):
            assert model.value[model.child[root] + child] == pytest.approx(-p.step * shrunk(g[m].sum()) / (h[m].sum() + p.lam))


def test_patience_and_truncation():
    """The loop runs 50 rounds past the best one and keeps the rounds up to it; more trees fit better without watchers."""
    x, bins, y = problem()
    noisy = np.where(np.random.default_rng(1).random(len(y)) < 0.6, np.random.default_rng(2).integers(0, 5, len(y)), y)
    watching = np.arange(len(y)) >= 800
    model = boosting.train(bins, noisy, watching, boosting.Params(rounds=400, step=0.2))
    assert model.rounds_run == len(model.roots) + 50 < 400
    prob = boosting.softmax(model.margins(bins))[watching]
    assert -np.log(prob[np.arange(len(prob)), noisy[watching]]).mean() == pytest.approx(model.best_loss)
    clean = boosting.train(bins, y, watching, boosting.Params(rounds=150, step=0.2))
    assert (clean.margins(bins)[watching].argmax(axis=1) == y[watching]).mean() > 0.9
    free = boosting.train(bins, y, np.zeros(len(y), bool), boosting.Params(rounds=20, leaves=4, min_rows=5))
    assert free.rounds_run == len(free.roots) == 20
    assert all((free.feature[a:b] < 0).sum() <= 5 * 4 for a, b in zip(free.roots[:, 0], [*free.roots[1:, 0], len(free.feature)]))


def test_contributions_add_up():
    _, bins, y = problem(400)
    model = boosting.train(bins, y, np.zeros(400, bool), boosting.Params(rounds=15))
    parts, bias = model.contributions(bins)
    assert np.allclose(parts.sum(axis=2) + bias, model.margins(bins))
    again = boosting.Model.from_bytes(model.to_bytes())
    assert (again.margins(bins) == model.margins(bins)).all()


def test_empty_and_single_class():
    none = boosting.train(np.zeros((3, 0), np.uint8), np.zeros(0, int), np.zeros(0, bool), boosting.Params(rounds=5))
    assert none.margins(np.zeros((3, 4), np.uint8)).tolist() == [[0.0] * 5] * 4
    _, bins, _ = problem(100)
    one = boosting.train(bins, np.full(100, 3), np.zeros(100, bool), boosting.Params(rounds=5))
    assert (one.margins(bins).argmax(axis=1) == 3).all()


@pytest.fixture(scope="module")
def table(spark):
    x, _, y = problem(500)
    rows = [("S", i, int(y[i]), *map(float, x[i])) for i in range(500)] + [("S", 500, 1, None, float("nan"), 0.0, 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "symbol string, date int, label int, f0 double, f1 double, f2 double, f3 double, f4 double, f5 double")


COLS = [f"f{i}" for i in range(6)]


def test_grouped_fits_and_scores(spark, table):
    """Fits of a call agree with a fit by itself, reruns agree, and scoring gives the model's probabilities."""
    rows = table.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("fit"), "symbol", "date", "label", (F.col("date") >= 400).alias("watching"), *COLS)
    params = {1: boosting.Params(rounds=12), 2: boosting.Params(rounds=12, depth=2)}
    edges, models = learners.boosted_fit(rows, COLS, params)
    again = learners.boosted_fit(rows.repartition(7), COLS, params)[1]
    scored = learners.boosted_predict(table, COLS, edges, models[1], ["date", "label"]).orderBy("date").collect()
    probs = np.array([r.probs for r in scored])
    assert len(scored) == 501 and np.allclose(probs.sum(axis=1), 1)
    assert (probs.argmax(axis=1) == [r.label for r in scored]).mean() > 0.8
    assert all((models[k].roots == again[k].roots).all() and (models[k].value == again[k].value).all() for k in params)
    assert len(models[2].feature) < len(models[1].feature)
    bounded = boosting.bounded(rows, ["fit"], ["date"], 100).groupBy("fit").count().collect()
    assert all(60 <= r["count"] <= 140 for r in bounded)


def test_every_row_learns(spark):
    """A tree of one node tells how many rows it has seen; 60,000 are more than a fit took before."""
    rows = spark.range(60_000).selectExpr("0 AS fit", "'S' AS symbol", "id AS date", "int(id % 3) AS label", "id % 10 = 0 AS watching", "double(id % 7) AS f0")
    params = {0: boosting.Params(rounds=1, depth=0, alpha=0.0, row_fraction=1.0)}
    model = learners.boosted_fit(rows, ["f0"], params)[1][0]
    counts = np.array([18_000, 18_000, 18_000, 0, 0])
    g, h = 54_000 * 0.2 - counts, 54_000 * 2 * 0.2 * 0.8
    assert model.value[model.roots[0]] == pytest.approx(-0.05 * g / (h + 1.0), rel=1e-9)


def test_spread_fit_equals_a_group(spark, table, monkeypatch):
    """Fits over blocks of rows, by Spark, against fits of one group: loss, rounds and margins; margins are written on the way."""
    rows = table.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("fit"), "symbol", "date", "label", (F.col("date") >= 400).alias("watching"), *COLS)
    every = {"row_fraction": 1.0, "feature_fraction": 1.0, "min_weight": 8.0}
    params = {1: boosting.Params(rounds=5, depth=2, **every), 2: boosting.Params(rounds=40, depth=2, step=2.0, patience=2, leaves=3, min_rows=4, **every)}
    edges, whole = learners.boosted_fit(rows, COLS, params)
    for name, value in (("GROUP_ROWS", 100), ("BLOCK_ROWS", 64), ("WRITE_EVERY", 2)):
        monkeypatch.setattr(boosting, name, value)
    spread = learners.boosted_fit(rows, COLS, params)[1]
    bins = boosting.as_matrix(boosting.binned(table, COLS, edges, ["date"]).toArrow().column("bins"), len(COLS))
    assert whole[2].rounds_run < 40
    for k, model in whole.items():
        assert (spread[k].rounds_run, len(spread[k].roots)) == (model.rounds_run, len(model.roots))
        assert spread[k].best_loss == pytest.approx(model.best_loss)
        assert np.allclose(spread[k].margins(bins), model.margins(bins))
    drawn = {1: boosting.Params(rounds=3, depth=2, row_fraction=0.5)}
    one, two = (learners.boosted_fit(x.where("fit = 1"), COLS, drawn)[1][1] for x in (rows, rows.repartition(5)))
    assert np.allclose(one.margins(bins), two.margins(bins)) and len(one.roots) == 3


def test_explained_predictions_add_up(spark, table):
    rows = table.select(F.lit(0).alias("fit"), "symbol", "date", "label", F.lit(False).alias("watching"), *COLS)
    edges, models = learners.boosted_fit(rows, COLS, {0: boosting.Params(rounds=10)})
    told = boosting.explain(boosting.binned(table, COLS, edges, ["date"]), models[0], COLS, ["date"])
    for r in told.collect():
        assert r.bias + sum(r.contributions) == pytest.approx(r.margin)
    top = serve.prediction_features(told, COLS, 2).collect()
    assert len(top) == 2 * 501
    sums = {}
    for r in top:
        sums.setdefault(r.date, [r.bias + r.other, r.margin])[0] += r.contribution
    assert all(a == pytest.approx(b) for a, b in sums.values())


def test_search_marks_one_best_trial(spark, table):
    trials = learners.random_search(table.where("date < 350"), table.where("date >= 350"), COLS, trials=4, rounds=20).collect()
    assert len(trials) == 4 and sum(t.is_best for t in trials) == 1
    assert max(t.macro_f1 for t in trials) == next(t.macro_f1 for t in trials if t.is_best) > 0.3
    assert all(t.best_round <= t.rounds_run <= 20 for t in trials)


def test_run_log_replaces_its_own_run(spark, tmp_path):
    metrics = spark.createDataFrame([("S", "rf", 0.5)], "symbol string, model string, macro_f1 double")
    folds = spark.createDataFrame([("S", 1, "rf", 0.25)], "symbol string, fold int, model string, macro_f1 double")
    path = f"{tmp_path}/log"
    for run, value in (("a", 1), ("b", 2), ("a", 3)):
        learners.append_run(learners.experiment_log(run, metrics, {"depth": value}, folds), path)
    got = {(r.run, r.kind, r.key): r.value for r in spark.read.parquet(path).collect()}
    assert len(got) == 6 and got["a", "param", "depth"] == "3" and got["b", "param", "depth"] == "2" and got["a", "fold_f1", "1"] == "0.25"


def test_headline_scorer(spark):
    """Held-out rows of a separable corpus; null texts get the failure result."""
    words = {"negative": "plunge loss", "neutral": "meeting agenda", "positive": "profit surge"}
    rows = [(i, f"{w} report {i} of day {i % 7}", lab) for i, (lab, w) in enumerate(list(words.items()) * 40)]
    data = spark.createDataFrame(rows, "position int, headline string, label string")
    model = sentiment.fit_scorer(data.where("position < 90"), kept_terms=20)
    got = sentiment.score_with_model(data.where("position >= 90").drop("label").union(spark.createDataFrame([(999, None)], "position int, headline string")), model)
    truth = {r.position: r.label for r in data.collect()}
    for r in got.collect():
        if r.position == 999:
            assert (r.label, r.score, r.confidence) == sentiment.FAILED_SCORE
        else:
            assert r.label == truth[r.position] and r.score == {"negative": -1, "neutral": 0, "positive": 1}[r.label] and 0.4 < r.confidence <= 1
