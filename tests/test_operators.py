"""Operator tests on hand-made edge frames and properties (no oracle needed)."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.operators import balance, drift, ewm, features, indicators, labels, metrics, quality
from marketframe.operators import serve, sets, splits, stack
from marketframe.operators.bars import period_days, upsert_bars

D0 = dt.date(2020, 1, 1)


def bars_frame(spark, closes, symbol="S", opens=None, highs=None, lows=None, vols=None):
    n = len(closes)
    opens = opens or closes
    highs = highs or [max(o, c) for o, c in zip(opens, closes)]
    lows = lows or [min(o, c) for o, c in zip(opens, closes)]
    vols = vols or [100.0] * n
    rows = [(symbol, D0 + dt.timedelta(days=i), float(opens[i]), float(highs[i]), float(lows[i]),
             float(closes[i]), float(vols[i])) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, "
                                       "close double, volume double")


def random_walk(n, seed=0, start=100.0):
    rng = np.random.default_rng(seed)
    return list(start * np.exp(np.cumsum(rng.normal(0, 0.01, n))))


# ---- labels -------------------------------------------------------------------------------------

def test_label_edges(spark):
    rets = [0.02, 0.0200001, 0.005, 0.0050001, -0.005, -0.0050001, -0.02, -0.0200001, 0.0]
    df = spark.createDataFrame([(r,) for r in rets], "r double")
    got = df.select(labels.label_class(F.col("r")).alias("a"), labels.forecast_class(F.col("r")).alias("b")).collect()
    assert [r.a for r in got] == [3, 4, 2, 3, 2, 1, 1, 0, 2]
    # forecast classes use '>' at every edge: exactly -0.5 % -> 1, exactly -2 % -> 0
    assert [r.b for r in got] == [3, 4, 2, 3, 1, 1, 0, 0, 2]


# ---- EWM kernel -----------------------------------------------------------------------------------

def test_ewm_matches_recurrence_with_nulls(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=1500)
    x[[0, 1, 400, 401, 402, 999]] = np.nan
    rows = [("S", D0 + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, date date, x double")
    df = df.withColumn("_i", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"])
                                                 .Window.partitionBy("symbol").orderBy("date")) - 1)
    out = ewm.ewm_columns(df, [ewm.Ewm("r", "x", 14, "rma"), ewm.Ewm("e", "x", 10, "ema")])
    got = out.orderBy("date").toPandas()
    s = pd.Series(x)
    want_rma = s.ewm(alpha=1 / 14, min_periods=14, adjust=True, ignore_na=False).mean()
    assert np.allclose(got["r"].astype(float), want_rma, equal_nan=True, atol=1e-10)
    # seeded EMA (its inputs only ever have leading nulls): mean of the first 10
    # observed values, then the recurrence
    y = x.copy()
    y[[400, 401, 402, 999]] = 0.5
    rows = [("S", D0 + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for i, v in enumerate(y)]
    df2 = spark.createDataFrame(rows, "symbol string, date date, x double")
    df2 = df2.withColumn("_i", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"])
                                                   .Window.partitionBy("symbol").orderBy("date")) - 1)
    got2 = ewm.ewm_columns(df2, [ewm.Ewm("e", "x", 10, "ema")]).orderBy("date").toPandas()
    e = np.full(len(y), np.nan)
    e[11] = y[2:12].mean()
    a = 2 / 11
    for t in range(12, len(y)):
        e[t] = a * y[t] + (1 - a) * e[t - 1]
    assert np.allclose(got2["e"].astype(float).to_numpy(), e, equal_nan=True, atol=1e-10)


# ---- indicators -------------------------------------------------------------------------------------

def test_flat_series_indicators(spark):
    b = bars_frame(spark, [100.0] * 60)
    ind = indicators.compute_indicators(b).orderBy("date").toPandas()
    last = ind.iloc[-1]
    assert last["sma_50"] == pytest.approx(100.0)
    assert last["stoch_k"] == 0.0              # zero range -> 0 (epsilon in the denominator)
    assert pd.isna(last["willr_14"])           # 0 / 0
    assert pd.isna(last["cci_20"])             # zero mean deviation
    assert pd.isna(last["rsi_14"])             # no gains, no losses


def test_bounded_oscillators(spark):
    c = random_walk(400, seed=5)
    b = bars_frame(spark, c, highs=[v * 1.01 for v in c], lows=[v * 0.99 for v in c],
                   opens=[v * 1.001 for v in c], vols=[float(100 + i % 7) for i in range(400)])
    ind = indicators.compute_indicators(b).toPandas()
    for col in ("rsi_7", "rsi_14", "mfi_14", "stoch_k", "stoch_d", "aroon_up", "aroon_down", "adx"):
        v = ind[col].dropna()
        assert ((v >= -1e-9) & (v <= 100 + 1e-9)).all(), col


def test_aroon_ties_most_recent(spark):
    c = [10, 12, 11, 12, 9, 9, 10, 11, 10, 10, 10, 10, 10, 10, 10, 10]
    b = bars_frame(spark, c)
    ind = indicators.compute_indicators(b).orderBy("date").toPandas()
    row = ind.iloc[14]                         # window rows 0..14: highs tie at 1 and 3 -> most recent = 3
    assert row["aroon_up"] == pytest.approx(100 * (1 - (14 - 3) / 14))
    assert row["aroon_down"] == pytest.approx(100 * (1 - (14 - 5) / 14))


def test_zero_volume_gives_null_then_fill(spark):
    c = random_walk(260, seed=7)
    v = [100.0] * 260
    v[200] = 0.0
    b = bars_frame(spark, c, vols=v)
    ind = indicators.compute_indicators(b).orderBy("date").toPandas()
    assert pd.isna(ind.loc[205, "volume_roc"])   # prior volume 0 -> null (inf in pandas)
    f = features.engineer_features(b).orderBy("date").toPandas()
    d205 = D0 + dt.timedelta(days=205)
    d204 = D0 + dt.timedelta(days=204)
    assert f.set_index("date").loc[d205, "volume_roc"] == f.set_index("date").loc[d204, "volume_roc"]


def test_short_series_all_rolling_null(spark):
    b = bars_frame(spark, random_walk(30))
    ind = indicators.compute_indicators(b).toPandas()
    assert ind["sma_50"].isna().all() and ind["sma_200"].isna().all()
    assert features.engineer_features(b).count() == 0   # warm-up drop removes everything


def test_no_look_ahead(spark):
    c = random_walk(320, seed=11)
    full = features.engineer_features(bars_frame(spark, c)).orderBy("date").toPandas()
    cut = features.engineer_features(bars_frame(spark, c[:300])).orderBy("date").toPandas()
    cols = [x for x in indicators.FEATURE_COLUMNS]
    # the last kept row of the truncated series is row 298; rows before it agree
    merged = cut.merge(full, on=["symbol", "date"], suffixes=("_c", "_f"))
    for col in cols:
        assert np.allclose(merged[col + "_c"], merged[col + "_f"], atol=1e-9), col


def test_processed_shape_and_warmup(spark):
    c = random_walk(300, seed=2)
    f = features.engineer_features(bars_frame(spark, c))
    assert f.columns[2:] == features.PROCESSED_COLUMNS and len(f.columns) == 67
    assert f.count() == 300 - 49 - 1
    pdf = f.toPandas()
    assert (pdf.loc[:, "sma_200"].iloc[:150] == 0.0).all()   # null before row 199 -> 0 after fill


# ---- quality, sets ----------------------------------------------------------------------------------

def test_bad_ohlc_rules(spark):
    rows = [("S", D0, -1.0, 5.0, 1.0, 6.0, None), ("S", D0 + dt.timedelta(days=1), 2.0, 3.0, 1.0, 2.0, 10.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, "
                                     "close double, volume double")
    t = quality.raw_rule_table(df).first()
    assert t["open_gt_0"] == 1 and t["volume_not_null"] == 1 and t["high_ge_close"] == 1
    assert quality.keep_valid(df).count() == 0


def test_dups_upsert_last_wins(spark):
    a = bars_frame(spark, [1.0, 2.0, 3.0]).withColumn("_batch", F.lit(1))
    b = bars_frame(spark, [9.0, 8.0]).withColumn("_batch", F.lit(2))
    assert quality.duplicate_dates(a.unionByName(b)).count() == 2
    out = upsert_bars(a, b).orderBy("date").select("close").toPandas()["close"].tolist()
    assert out == [9.0, 8.0, 3.0]


def test_order_violations_across_buckets(spark):
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m) for m in [0, 1, 2, 1, 5, 4, 6, 7]]
    rows = [(i, ts[i], "a") for i in range(8)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, k string")
    for bucket in (1, 2, 3, 100):
        got = quality.order_violations(df, "k", "id", "ts", bucket_rows=bucket).first()["order_violations"]
        assert got == 2


def test_dedupe_first_occurrence(spark):
    df = spark.createDataFrame([("S", "b", 3), ("S", "a", 1), ("S", "b", 2)], "symbol string, headline string, position int")
    got = sorted(tuple(r) for r in sets.dedupe_first(df, ["symbol", "headline"], "position").collect())
    assert got == [("S", "a", 1), ("S", "b", 2)]


def test_period_days():
    assert period_days("5y") == 1825 and period_days("6m") == 180 and period_days("10d") == 10
    assert period_days("3w") == 1825 and period_days("") == 1825


# ---- splits, metrics, serving -------------------------------------------------------------------------

def test_folds_train_strictly_before_test(spark):
    b = bars_frame(spark, random_walk(120)).withColumn("label", F.lit(2))
    f = splits.time_series_folds(b).toPandas().sort_values("date")
    n = 120
    ts = n // 6
    assert (f["fold"] == -1).sum() == n - 5 * ts
    for j in range(5):
        test_dates = f[f.fold == j].date
        train_dates = f[f.fold < j].date
        assert len(test_dates) == ts and train_dates.max() < test_dates.min()


def test_rare_class_metrics(spark):
    rows = [("S", "m", 0, 0), ("S", "m", 1, 0), ("S", "m", 2, 2), ("S", "m", 2, 2)]
    df = spark.createDataFrame(rows, "symbol string, model string, y_true int, y_pred int")
    m = metrics.classification_metrics(df).first()
    # classes present in y or p: 0, 1, 2 -> F1 = 2/3, 0, 1
    assert m["macro_f1"] == pytest.approx((2 / 3 + 0 + 1) / 3)
    assert m["accuracy"] == pytest.approx(0.75)
    assert m["sell_f1"] == pytest.approx((2 / 3 + 0) / 2)
    assert m["buy_f1"] == 0.0
    cm = metrics.confusion_matrix(df).orderBy("y_true").toPandas()
    assert len(cm) == 5 and cm.loc[4, ["pred_0", "pred_1", "pred_2", "pred_3", "pred_4"]].sum() == 0


def test_argmax_ties_lowest(spark):
    df = spark.createDataFrame([([0.2, 0.2, 0.2, 0.2, 0.2],), ([0.1, 0.4, 0.4, 0.05, 0.05],)], "p array<double>")
    from marketframe import functions as fn
    got = [r[0] for r in df.select(fn.argmax_class(F.col("p"))).collect()]
    assert got == [0, 1]


def test_forecast_probabilities_sum_to_one(spark):
    b = bars_frame(spark, random_walk(200, seed=9))
    p = serve.forecast_distribution(b).toPandas()
    sums = p["probs"].map(lambda v: sum(v))
    assert np.allclose(sums, 1.0)
    assert (p.iloc[:64]["probs"].map(lambda v: list(v) == [0.2] * 5)).all()


def test_symbol_normalisation(spark):
    from marketframe import functions as fn
    df = spark.createDataFrame([(" infy.ns ",), ("reliance",), ("TCS.BO",), ("X.US",)], "s string")
    got = df.select(fn.normalize_symbol(F.col("s")).alias("n")).select("n", fn.symbol_valid(F.col("n")).alias("v")).collect()
    assert [(r.n, r.v) for r in got] == [("INFY.NS", True), ("RELIANCE.NS", True), ("TCS.BO", True), ("X.US", False)]


def test_empty_news_and_recency(spark):
    from marketframe.operators.sentiment import daily_sentiment
    days = spark.createDataFrame([("S", dt.date(2024, 1, 10)), ("S", dt.date(2024, 3, 1)), ("T", dt.date(2024, 3, 1))],
                                 "symbol string, date date")
    scored = spark.createDataFrame([("S", dt.date(2024, 1, 10), 1, "h1", 1.0, 0.8),
                                    ("S", dt.date(2024, 3, 1), 2, "h2", -1.0, 0.9)],
                                   "symbol string, date date, position long, headline string, score double, confidence double")
    out = {(r.symbol, r.date): r for r in daily_sentiment(days, scored, "2024-04-09").collect()}
    assert out[("S", dt.date(2024, 1, 10))].sentiment_score == 1.0         # 90 days before as-of -> still recent
    assert out[("S", dt.date(2024, 3, 1))].sentiment_score == -1.0
    assert out[("T", dt.date(2024, 3, 1))].sentiment_confidence == 0.5     # no headline -> neutral
    out2 = {(r.symbol, r.date): r for r in daily_sentiment(days, scored, "2024-04-10").collect()}
    assert out2[("S", dt.date(2024, 1, 10))].news_count_7d == 0.0          # 91 days -> neutral


# ---- drift, balancing ------------------------------------------------------------------------------------

def test_drift_shifted_vs_same(spark):
    rng = np.random.default_rng(1)
    n = 2000
    same = rng.normal(size=n)
    shifted = np.concatenate([rng.normal(size=int(n * 0.8)), rng.normal(3.0, 1.0, n - int(n * 0.8))])
    rows = [("A", D0 + dt.timedelta(days=i), float(same[i]), 0) for i in range(n)] + \
           [("B", D0 + dt.timedelta(days=i), float(shifted[i]), 0) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, date date, x double, label int")
    rep = {r.symbol: r for r in drift.drift_report(df, ["x"]).collect()}
    assert rep["A"].method == "wasserstein" and not rep["A"].drifted
    assert rep["B"].drifted


def test_knn_exact_against_brute_force(spark):
    rng = np.random.default_rng(4)
    pts = rng.normal(size=(120, 6))
    rows = [("G", int(i % 2), int(i), *map(float, p)) for i, p in enumerate(pts)]
    cols = [f"f{j}" for j in range(6)]
    df = spark.createDataFrame(rows, "g string, label int, _id long, " + ", ".join(f"{c} double" for c in cols))
    k = spark.createDataFrame([("G", 0, 3), ("G", 1, 3)], "g string, label int, k int")
    nn = balance.nearest_neighbours(df, ["g"], cols, k).toPandas()
    for i in range(120):
        same = [j for j in range(120) if j % 2 == i % 2 and j != i]
        d = sorted(((np.linalg.norm(pts[i] - pts[j]), j) for j in same))[:3]
        got = nn[nn._id == i].sort_values("nn_rank").nn_id.tolist()
        assert got == [j for _, j in d]


def test_knn_across_blocks_with_ties_and_missing_values(spark, monkeypatch):
    monkeypatch.setattr(balance, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    pts = rng.integers(0, 3, size=(150, 3)).astype(float)     # many equal points
    pts[7, 1] = np.nan
    rows = [("G", 0, i, *map(float, p)) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "g string, label int, _id long, a double, b double, c double")
    k = spark.createDataFrame([("G", 0, 5)], "g string, label int, k int")
    nn = balance.nearest_neighbours(df, ["g"], ["a", "b", "c"], k).toPandas()
    assert 7 not in set(nn._id) | set(nn.nn_id)
    for i in set(range(150)) - {7}:
        want = sorted((np.linalg.norm(pts[i] - pts[j]), j) for j in range(150) if j not in (i, 7))[:5]
        assert nn[nn._id == i].sort_values("nn_rank").nn_id.tolist() == [j for _, j in want]


def test_smote_balances_classes(spark):
    rng = np.random.default_rng(8)
    rows = []
    for cls, n in ((0, 30), (1, 8), (2, 15)):
        for i in range(n):
            rows.append(("S", D0 + dt.timedelta(days=len(rows)), cls, *map(float, rng.normal(cls, 1.0, 3))))
    df = spark.createDataFrame(rows, "symbol string, date date, label int, a double, b double, c double")
    out = balance.smote(df, ["a", "b", "c"], ["symbol"])
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 30, 1: 30, 2: 30}
    syn = out.where("synthetic").toPandas()
    assert len(syn) == 22 + 15 and syn[["a", "b", "c"]].notna().all().all()


def test_stack_learns_from_training_rows_only(spark):
    rng = np.random.default_rng(9)
    rows = [(s, D0 + dt.timedelta(days=i), int(rng.integers(0, 3)), [0.2] * 5, *map(float, rng.normal(i, 1.0, 2)))
            for s in ("A", "B") for i in range(72)]
    df = spark.createDataFrame(rows, "symbol string, date date, label int, forecast_probs array<double>, a double, b double")
    t = splits.chrono_split(df).drop("_i")
    folded = splits.time_series_folds(t.where("split = 'train'"))
    runs = stack.stack_runs(folded, t.where("split = 'test'"), ["a", "b"])
    assert runs.groupBy("symbol", "date", "run").count().where("count > 1").isEmpty()
    # statistics come from training rows: those, and only those, are centred
    train = runs.where("fold < run").groupBy("symbol", "run").agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"))
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in train.collect())
    assert all(r.m > 1 for r in runs.where("fold = run").groupBy("symbol", "run").agg(F.avg("a").alias("m")).collect())
    balanced = stack.balanced_runs(runs, ["a", "b"])
    # synthetic rows carry no date, so that none can be a scored row
    assert balanced.where("synthetic AND date IS NOT NULL").isEmpty()
    real = balanced.where("NOT synthetic").join(runs.where("fold = run"), ["symbol", "run", "date"], "left_semi")
    assert real.isEmpty()
    sizes = balanced.groupBy("symbol", "run", "label").count().groupBy("symbol", "run").agg(F.countDistinct("count").alias("n"))
    assert all(r.n == 1 for r in sizes.collect())


def test_coercion_report_counts_new_nulls(spark):
    df = spark.createDataFrame([("a", "1.5"), ("a", "x"), ("a", None)], "k string, v string")
    r = quality.coercion_report(df, {"v": "DOUBLE"}, ["k"]).first()
    assert (r.n_rows, r.v_newly_null) == (3, 1)


def test_feature_groups_name_a_missing_group(spark):
    df = spark.createDataFrame([("a", 1.0, 1)], "symbol string, rsi_14 double, label int")
    found = {r.feature_group: r.present for r in quality.feature_groups_present(df).collect()}
    assert found["momentum"] and found["label"] and not found["volume"] and not found["returns"]


def test_registered_learners_have_full_size(spark):
    """No cut in rounds, depth, trees or iterations against the reference's sizes."""
    from marketframe.operators import boosting, learners
    from marketframe.plans import q_learn

    gbt = boosting.Params(**q_learn.PARAMS["gbt"])
    assert (gbt.rounds, gbt.depth, gbt.patience) == (1000, 6, 50)
    draws = learners.draw_params(50)
    assert all(200 <= d.rounds <= 1000 and 20 <= d.leaves <= 150 and 4 <= d.depth <= 12 and d.patience == 50 for d in draws)
    assert learners.sequence_learner(20, **q_learn.PARAMS["mlp"]).getMaxIter() == 50


def test_digest_per_request(spark):
    from marketframe.operators import serve

    records = spark.createDataFrame([("B", "Buy", 0.5), ("A", "Hold", 0.25), ("C", "Sell", 0.75)], "symbol string, signal string, confidence double")
    requests = spark.createDataFrame([(1, "B"), (1, "A"), (1, "B"), (2, "C"), (2, "Z"), (3, "Z")], "batch long, symbol string")
    got = {r.batch: r.summary for r in serve.digest(records, requests).collect()}
    assert got == {1: "A: Hold (conf=25%)\nB: Buy (conf=50%)", 2: "C: Sell (conf=75%)", 3: "No predictions available."}
