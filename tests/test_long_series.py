"""Chunks of a long series against the whole series in one task."""

import numpy as np
import pandas as pd
import pytest

from marketframe.operators.indicators import FEATURE_COLUMNS, compute_indicators
from marketframe.operators.long_series import (CHUNK, HALO, IS_HALO, PLACE, compute_indicators_chunked, with_chunks,
                                               with_positions_by_bucket)
from pyspark.sql import functions as F


def _bars(n, seed=3, symbol="L"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    flat = slice(700, 1400)                           # over whole chunks
    close[flat] = close[flat][:1]
    open_ = close * (1 + rng.normal(0, 0.002, n))
    open_[flat] = close[flat]
    high = np.maximum(open_, close) * (1 + np.abs(rng.normal(0, 0.002, n)))
    low = np.minimum(open_, close) * (1 - np.abs(rng.normal(0, 0.002, n)))
    high[900:1200] = low[900:1200] = close[900:1200]  # ranges of zero
    return pd.DataFrame({"symbol": symbol, "date": pd.date_range("1990-01-01", periods=n).date, "open": open_, "high": high,
                         "low": low, "close": close, "volume": rng.integers(1, 1000, n).astype(float)})


@pytest.fixture(scope="module")
def bars(spark):
    both = pd.concat([_bars(2600), _bars(HALO + 10, 4, "S"), _bars(3, 5, "T")])
    return spark.createDataFrame(both).repartition(5)


def _sorted(df):
    return df.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)


@pytest.mark.parametrize("chunk_rows", [HALO, 1000])
def test_chunks_equal_whole_series(bars, chunk_rows):
    want = _sorted(compute_indicators(bars))
    got = _sorted(compute_indicators_chunked(bars, chunk_rows))
    assert list(got.columns) == list(want.columns)
    assert got["_i"].tolist() == want["_i"].tolist()
    for c in FEATURE_COLUMNS:
        x, y = want[c].to_numpy(float), got[c].to_numpy(float)
        assert (np.isnan(x) == np.isnan(y)).all(), c
        np.testing.assert_allclose(y, x, rtol=1e-7, atol=1e-7, equal_nan=True, err_msg=c)


def test_no_task_holds_the_series(bars):
    """A chunk has its own rows and its halo, whatever the length of the series."""
    dealt = with_chunks(with_positions_by_bucket(bars, F.trunc("date", "MM")), HALO)
    sizes = dealt.groupBy("symbol", CHUNK).agg(F.count("*").alias("n"), F.min(PLACE).alias("k")).collect()
    assert max(r.n for r in sizes) <= 2 * HALO and min(r.k for r in sizes) == -HALO
    own = dealt.where(f"NOT {IS_HALO}")
    assert own.count() == bars.count() == own.select("symbol", "date").distinct().count()
    assert own.where("symbol = 'L'").select(CHUNK).distinct().count() == 11


def test_edges(spark, bars):
    assert compute_indicators_chunked(bars.limit(0), HALO).count() == 0
    with pytest.raises(ValueError):
        with_chunks(bars, HALO - 1)
