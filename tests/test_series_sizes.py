"""Work that follows the rows: drift of short series, partitions of the bars, texts that move once."""

import contextlib
import datetime as dt
import io

import numpy as np
import pandas as pd

from marketframe.operators import drift
from marketframe.operators.sets import lookback_union
from marketframe.operators.windows import by_series

DAY = dt.date(2020, 1, 1)


def _ordered(df):
    return df.toPandas().sort_values(["symbol", "feature"]).reset_index(drop=True)


def test_drift_by_series_equals_drift_by_range(spark):
    rng = np.random.default_rng(0)
    rows = [(s, DAY + dt.timedelta(days=i), float(rng.normal()), float(rng.integers(0, 2)), 1.0, None if i % 3 == 0 else float(rng.integers(0, 4)),
             float("nan") if i < n * 0.9 else 2.0, None)
            for s, n in (("A", 400), ("B", 3), ("C", 1), ("D", 900), (None, 5)) for i in range(n)]
    cols = list("abcdef")
    df = spark.createDataFrame(rows, "symbol string, date date, " + ", ".join(f"{c} double" for c in cols))
    want = _ordered(drift.drift_statistics(drift.value_counts(drift.drift_long(df, cols))))
    assert len(want) == 17
    pd.testing.assert_frame_equal(_ordered(drift.statistics_by_series(df, cols)), want)
    pd.testing.assert_frame_equal(_ordered(drift.statistics_of(df, cols, most=500)), want)  # D by range, the others by series
    assert drift.statistics_of(df.limit(0), cols).count() == 0


def test_partitions_follow_the_bars(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(20 * (cores + 1)).selectExpr("cast(id as string) AS symbol")
    assert by_series(df, rows=20).rdd.getNumPartitions() == cores + 1
    assert sorted(r.symbol for r in by_series(df, rows=20).collect()) == sorted(r.symbol for r in df.collect())


def test_texts_meet_the_days_before_they_are_repeated(spark):
    text = spark.createDataFrame([("A", DAY, 1, "x"), ("A", DAY, 1, "x"), ("A", DAY + dt.timedelta(days=6), 2, "y"), ("B", DAY, 3, "z"),
                                  (None, DAY, 4, "n"), ("A", None, 5, "m")], "symbol string, date date, position int, headline string")
    days = spark.createDataFrame([("A", DAY + dt.timedelta(days=d)) for d in (0, 0, 6, 7)] + [(None, DAY), ("A", None)], "symbol string, date date")
    got = lookback_union(text, days)
    assert got.columns == ["symbol", "as_of", "date", "position", "headline"]
    assert sorted((r.symbol, (r.as_of - DAY).days, r.headline) for r in got.collect()) \
        == [("A", 0, "x"), ("A", 0, "x"), ("A", 6, "x"), ("A", 6, "x"), ("A", 6, "y"), ("A", 7, "y")]
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        got.explain()
    plan = said.getvalue()
    assert plan.index("Generate") < plan.index("Join")


def test_drift_of_rows_in_order_moves_nothing(spark):
    """Series whose rows lie together give the same statistics as grouped ones, without a shuffle or a window."""
    rng = np.random.default_rng(7)
    rows = [(s, DAY + dt.timedelta(days=i), float(rng.normal()), float(rng.integers(0, 3)), None if i % 4 == 0 else 1.0, float("nan") if i < n * 0.9 else 2.0)
            for s, n in (("A", 400), ("B", 3), ("C", 1), (None, 5)) for i in range(n)]
    cols = list("abcd")
    df = spark.createDataFrame(rows, "symbol string, date date, " + ", ".join(f"{c} double" for c in cols)).coalesce(1)
    got = drift.statistics_by_series(df, cols, in_order=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    pd.testing.assert_frame_equal(_ordered(got), _ordered(drift.statistics_by_series(df, cols)))
