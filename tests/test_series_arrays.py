"""The feature table of whole series as arrays against the window expressions, and wide tables rounded as arrays."""

import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketframe.config import DEFAULT
from marketframe.operators import features, series_arrays
from marketframe.operators.bars import most_bars
from marketframe.plans import catalog

DAY = dt.date(2020, 1, 1)
BARS = "symbol string, date date, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    """Series of several lengths: nulls here and there, flat and zero stretches, a null symbol, a null date."""
    rng, rows = np.random.default_rng(3), []
    for symbol, n in (("A", 320), ("B", 1), ("C", 2), ("D", 60), ("E", 130), (None, 90), ("F", 260)):
        for i in range(n):
            c = 100.0 if symbol == "F" and 80 <= i < 140 else 100 + 10 * rng.random()
            row = [c + rng.normal(), c + 2 + rng.random(), c - 2 - rng.random(), c, float(rng.integers(0, 50))]
            if symbol == "F" and 100 <= i < 130:
                row = [100.0] * 4 + [0.0]
            if symbol in ("E", None) and rng.random() < 0.06:
                row[rng.integers(0, 5)] = None
            rows.append((symbol, None if symbol == "A" and i == 0 else DAY + dt.timedelta(days=i), *row))
    return spark.createDataFrame(rows, BARS).repartition(5)


def _sorted(df):
    return df.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)


def test_arrays_equal_windows(bars):
    want, got = _sorted(features.features_by_windows(bars, keep_index=True)), _sorted(features.engineer_features(bars, keep_index=True))
    assert len(want) > 400
    pd.testing.assert_frame_equal(got, want, rtol=1e-8, atol=1e-9)


def test_sentiment_passes_through(spark, bars):
    sent = bars.where("symbol = 'A'").select("symbol", "date", (F.dayofmonth("date") / 31).alias("sentiment_score"))
    pd.testing.assert_frame_equal(_sorted(features.engineer_features(bars, sent)), _sorted(features.features_by_windows(bars, sent)), rtol=1e-8, atol=1e-9)


def test_no_window_function_over_short_series(bars, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(features.engineer_features(bars)) and features.engineer_features(bars.limit(0)).count() == 0
    monkeypatch.setattr(features, "SERIES_ROWS", 200)
    assert "Window" in plan(features.engineer_features(bars))


def test_bars_are_bounded_without_building_them(spark):
    ticks = spark.createDataFrame([("A", DAY + dt.timedelta(days=d)) for d in (0, 0, 0, 2, 2, 4)] + [("B", DAY)] * 5 + [("B", None), ("C", None), (None, DAY)],
                                  "symbol string, date date")
    assert {r.symbol: r["count"] for r in most_bars(ticks, F.col("symbol"), F.col("date")).collect()} == {"A": 5, "B": 2, "C": 1, None: 1}


def test_runs_and_batches_change_nothing(bars, monkeypatch):
    x = bars.where("date IS NOT NULL").orderBy("symbol", "date").selectExpr(
        "symbol", "date", *series_arrays.PRICES, "1D AS day_of_week", "double(month(date)) AS month", "1D AS quarter", "0D AS is_month_end").toArrow()
    run = series_arrays.processed_batches("symbol", ["symbol", "date"], ["symbol", "date", "_i", *features.PROCESSED_COLUMNS], DEFAULT.labels)
    whole = pa.Table.from_batches(run(iter(x.combine_chunks().to_batches())))
    monkeypatch.setattr(series_arrays, "CELLS", 100)
    parts = pa.Table.from_batches(run(iter(x.combine_chunks().to_batches(max_chunksize=37))))
    pd.testing.assert_frame_equal(parts.to_pandas(), whole.to_pandas(), rtol=0, atol=0)


def test_wide_tables_round_as_spark_does(spark):
    values = [float("nan"), float("inf"), -float("inf"), 0.5e-6, -0.5e-6, 1.0000005, 2.5e-6, 123456.1234565, -0.0, 4.6e9 + 1 / 3, 1e17, 1e300,
              0.1234565, 98765432.1234565, None, *np.random.default_rng(0).normal(size=50).tolist()]
    df = spark.createDataFrame([(v, "x") for v in values], "v double, name string")
    wide = catalog.rounded(df.select("name", *[F.col("v").alias(f"c{k}") for k in range(catalog.WIDE)]))
    assert "MapInArrow" in wide._jdf.queryExecution().executedPlan().toString()
    assert list(map(str, (r.c0 for r in wide.collect()))) == list(map(str, (r.v for r in catalog.rounded(df).collect())))


def test_equal_values_stay_equal(spark):
    """Drift counts distinct values: stoch_k, whose values recur, is the windows' to the last bit."""
    rng = np.random.default_rng(11)
    rows = [("A", DAY + dt.timedelta(days=i), *(100 + rng.integers(0, 9, 4) / 7).tolist(), 1.0) for i in range(400)]
    bars = spark.createDataFrame(rows, BARS).selectExpr("symbol", "date", "open", "greatest(high, low) AS high", "least(high, low) AS low", "close", "volume")
    got, want = (_sorted(f(bars))["stoch_k"] for f in (features.engineer_features, features.features_by_windows))
    assert (got == want).all() and want.nunique() < len(want)
