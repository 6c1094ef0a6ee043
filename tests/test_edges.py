"""Edge inputs: long flat and unobserved stretches, zero prices, long texts, near-equal samples."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.operators.drift import ks_p_value
from marketframe.operators.ewm import rma
from marketframe.operators.indicators import compute_indicators
from marketframe.operators.labels import with_labels


def _bars(spark, closes):
    days = pd.date_range("2000-01-03", periods=len(closes))
    rows = [("A", d.date(), c, c + 1.0, c - 1.0, c, 10.0) if c is not None else ("A", d.date(), None, None, None, None, 10.0)
            for d, c in zip(days, closes)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_rsi_stays_on_a_long_flat(spark):
    closes = [100.0 + 5 * math.sin(i / 7.0) for i in range(600)]
    closes += [closes[-1]] * 1800
    got = compute_indicators(_bars(spark, closes)).orderBy("date").toPandas()
    flat = got.rsi_14.iloc[600:]
    assert flat.notna().all()
    assert (flat - flat.iloc[0]).abs().max() < 1e-6


def test_rma_over_a_long_unobserved_stretch(spark):
    xs = [float(i % 13) for i in range(300)] + [None] * 2200 + [float(i % 7) for i in range(200)]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(xs)], "symbol string, date int, x double") \
        .withColumn("_i", F.col("date"))
    got = rma(df, "m", "x", 14).orderBy("date").toPandas().m
    want = pd.Series(xs, dtype=float).ewm(alpha=1 / 14, min_periods=14, adjust=True).mean()
    assert got.isna().equals(want.isna())
    assert (got - want).abs().max() < 1e-9


def test_zero_close_does_not_abort(spark):
    closes = [100.0 + i for i in range(80)]
    closes[40] = 0.0
    got = with_labels(compute_indicators(_bars(spark, closes))).toPandas()
    assert len(got) == 80 and got.loc[got._i == 40, "fwd_return"].isna().all()


def test_sma_needs_all_its_values(spark):
    closes = [100.0 + i for i in range(80)]
    closes[60] = None
    got = compute_indicators(_bars(spark, closes)).orderBy("date").toPandas()
    assert got.sma_5.iloc[60:65].isna().all() and got.sma_5.iloc[65] == pytest.approx(163.0)
    assert got.sma_50.iloc[60:].isna().all()


def test_headlines_keep_the_whole_text(spark, tmp_path):
    from marketframe.operators.sets import dedupe_first
    from marketframe.sources.fixtures import headlines

    base = "x" * 300
    spark.createDataFrame([(0, base + "a"), (6 * 103, base + "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = headlines(spark, str(tmp_path))
    assert {len(r.headline) for r in got.collect()} == {301}
    assert dedupe_first(got, ["headline"], "position").count() == 2


@pytest.mark.parametrize("lam,want", [(0.0, 1.0), (0.0012, 1.0), (0.005, 1.0), (0.5, 0.9639452436), (1.0, 0.2699996717), (2.0, 0.0006709253)])
def test_ks_p_value(spark, lam, want):
    got = spark.range(1).select(ks_p_value(F.lit(lam)).alias("p")).first().p
    assert got == pytest.approx(want, abs=1e-9)


def test_lexicon_scores(spark):
    from marketframe.operators.sentiment import score_with_lexicon
    texts = ["Strong GROWTH, weak sales", "Profit!gain", "x " * 5000 + "loss", "", None, "good/bad"]
    df = spark.createDataFrame(list(enumerate(texts)), "position long, headline string")
    got = {r.position: (r.label, r.score, round(r.confidence, 6)) for r in score_with_lexicon(df).collect()}
    assert got == {0: ("positive", 1.0, 0.6), 1: ("positive", 1.0, 0.75), 2: ("negative", -1.0, round(2 / 3, 6)),
                   3: ("neutral", 0.0, 0.5), 4: ("neutral", 0.0, 0.5), 5: ("neutral", 0.0, 0.5)}


def test_latest_forecast_needs_only_the_last_bars(spark):
    from marketframe.operators.serve import forecast_distribution, latest_forecast, latest_rows
    import datetime as dt
    day = dt.date(2024, 1, 1)
    rows = [(s, day + dt.timedelta(days=i), 100.0 + (i * 7 % 13) * (1 + i % 3)) for s, n in (("A", 200), ("B", 65), ("C", 64))
            for i in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    get = lambda df: sorted((r.symbol, r.date, tuple(r.probs)) for r in df.collect())
    assert get(latest_forecast(bars)) == get(latest_rows(forecast_distribution(bars)))
