"""Spark queries against their DuckDB oracles on the smallest scale factor."""

import pytest

import __spark_entry__ as entry
from scripts_compare import frames_equal

from conftest import SF_SMALL

# A representative slice of the registry (the full registry runs in scripts/check_oracle.py).
KEYS = [
    "features_full", "src_08_bars_from_ticks", "lbl_01_label", "lbl_02_forecast_class",
    "ind_12_macd", "ind_13_adx", "ind_14_aroon", "ind_28_long_series", "prj_04_inf_ffill_zero",
    "dq_01_raw_range_rules", "dq_03_arrival_order", "dq_04_duplicate_dates",
    "set_01_upsert_last_wins", "set_03_dedupe_first", "set_04_lookback_union",
    "sen_02_daily_sentiment", "sen_03_live_sentiment", "agg_07_confusion_matrix",
    "eval_05_class_report", "eval_06_comparison", "spl_03_time_series_folds", "scl_01_fold_zscore",
    "top_08_argmax", "fn_02_normalize_symbol", "fn_08_explanation", "join_04_batch_requests",
    "drf_02_psi", "drf_05_wasserstein_js", "ml_08_oof_pool",
]


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    got = entry.queries()[key](spark, SF_SMALL).toPandas()
    want = duck.sql(entry.oracle_sql()[key]).df()
    ok, why = frames_equal(got, want)
    assert ok, why


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "label" in df.columns and len(df.columns) == 67
