"""Queries: indicators (IND-*), labels (LBL-*), projections (PRJ-*), the full
feature table and the bar builder (SRC-08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import (CORE_COLUMNS, PROCESSED_COLUMNS, candle_rows, clean_fill,
                                  drop_last_row, drop_warmup, engineer_features, feature_columns,
                                  gated_features)
from ..operators.indicators import FEATURE_COLUMNS, INT_FEATURES, compute_indicators
from ..operators.labels import forecast_class, forward_return, label_class, with_labels
from ..operators.long_series import compute_indicators_chunked
from ..sources import fixtures as fx
from . import oracle as O
from .catalog import register, rounded, sql_round


def _ind_sql(cols: list[str]) -> str:
    dbl = [c for c in cols if c not in INT_FEATURES]
    ints = [c for c in cols if c in INT_FEATURES]
    sel = ", ".join(filter(None, [sql_round(dbl), ", ".join(ints)]))
    return O.with_bars(O.BARS_FLAG, O.INDICATOR_CTES, body=f"SELECT symbol, date, {sel} FROM feat3")


def _ind_query(cols: list[str]):
    def run(spark, sf):
        ind = compute_indicators(fx.bars_flag(spark, sf))
        return rounded(ind.select("symbol", "date", *cols))
    return run


# Operator id -> indicator columns it produces.
INDICATOR_GROUPS = {
    "ind_01_log_returns": [f"log_return_{n}d" for n in [1, 3, 5, 10, 20]],
    "ind_02_overnight_gap": ["overnight_gap"],
    "ind_03_sma": [f"sma_{n}" for n in [5, 10, 20, 50, 200]],
    "ind_04_price_sma_ratio": [f"price_sma{n}_ratio" for n in [5, 10, 20, 50, 200]],
    "ind_05_ema": [f"ema_{n}" for n in [5, 10, 20, 50]],
    "ind_06_price_ema_ratio": [f"price_ema{n}_ratio" for n in [5, 10, 20, 50]],
    "ind_07_rsi": ["rsi_7", "rsi_14"],
    "ind_08_stoch": ["stoch_k", "stoch_d"],
    "ind_09_willr": ["willr_14"],
    "ind_10_cci": ["cci_20"],
    "ind_11_roc": ["roc_10", "roc_20"],
    "ind_12_macd": ["macd", "macd_hist", "macd_signal"],
    "ind_13_adx": ["adx"],
    "ind_14_aroon": ["aroon_down", "aroon_up"],
    "ind_15_bbands": ["bb_lower", "bb_mid", "bb_upper"],
    "ind_16_bb_width_pctb": ["bb_width", "bb_pct_b"],
    "ind_17_atr": ["atr_14"],
    "ind_18_hist_vol": ["hist_vol_20"],
    "ind_19_obv": ["obv"],
    "ind_20_vwap": ["vwap"],
    "ind_21_mfi": ["mfi_14"],
    "ind_22_volume_sma_ratio": ["volume_sma_ratio"],
    "ind_23_volume_roc": ["volume_roc"],
    "ind_24_candle_ratios": ["body_size", "upper_shadow", "lower_shadow"],
    "ind_25_doji_hammer": ["doji", "hammer"],
    "ind_26_bullish_engulf": ["bullish_engulf"],
    "ind_27_calendar": ["day_of_week", "month", "quarter", "is_month_end"],
}

for _key, _cols in INDICATOR_GROUPS.items():
    register(_key, _ind_sql(_cols))(_ind_query(_cols))


@register("ind_28_long_series", _ind_sql(FEATURE_COLUMNS))
def ind_28(spark, sf):
    """All indicators with each series spread over chunks of 512 rows."""
    ind = compute_indicators_chunked(fx.bars_flag(spark, sf), chunk_rows=512)
    return rounded(ind.select("symbol", "date", *FEATURE_COLUMNS))


# ---- bars (SRC-08) -------------------------------------------------------------

@register("src_08_bars_from_ticks", O.with_bars(O.BARS_FLAG, body=f"SELECT symbol, date, {sql_round(['open', 'high', 'low', 'close', 'volume'])} FROM bars"))
def src_08(spark, sf):
    return rounded(fx.bars_flag(spark, sf))


@register("src_08_bars_supplier", O.with_bars(O.BARS_SUPPLIER, body=f"SELECT symbol, date, {sql_round(['open', 'high', 'low', 'close', 'volume'])} FROM bars"))
def src_08_supplier(spark, sf):
    return rounded(fx.bars_supplier(spark, sf))


@register("src_08_bars_event_hour", O.with_bars(O.BARS_EVENT_HOUR, body=f"SELECT symbol, date, {sql_round(['open', 'high', 'low', 'close', 'volume'])} FROM bars"))
def src_08_event(spark, sf):
    return rounded(fx.bars_event_hour(spark, sf))


# ---- labels --------------------------------------------------------------------

_FWD_SQL = "lead(close, 1) OVER (PARTITION BY symbol ORDER BY date) / close - 1.0"


@register("lbl_01_label", O.with_bars(O.BARS_FLAG, body=f"""
SELECT symbol, date, round(fwd, 6) + 0.0 AS fwd_return,
       CAST(CASE WHEN fwd > 0.02 THEN 4 WHEN fwd > 0.005 THEN 3 WHEN fwd < -0.02 THEN 0
            WHEN fwd < -0.005 THEN 1 ELSE 2 END AS INTEGER) AS label
FROM (SELECT symbol, date, {_FWD_SQL} AS fwd FROM bars)"""))
def lbl_01(spark, sf):
    return rounded(with_labels(fx.bars_flag(spark, sf)).select("symbol", "date", "fwd_return", "label"))


@register("lbl_02_forecast_class", O.with_bars(O.BARS_FLAG, body=f"""
SELECT symbol, date, round(fwd, 6) + 0.0 AS fwd_return,
       CAST(CASE WHEN fwd > 0.02 THEN 4 WHEN fwd > 0.005 THEN 3 WHEN fwd > -0.005 THEN 2
            WHEN fwd > -0.02 THEN 1 ELSE 0 END AS INTEGER) AS forecast_class
FROM (SELECT symbol, date, {_FWD_SQL} AS fwd FROM bars) WHERE fwd IS NOT NULL"""))
def lbl_02(spark, sf):
    b = fx.bars_flag(spark, sf).select("symbol", "date", forward_return().alias("fwd_return"))
    b = b.where(F.col("fwd_return").isNotNull())
    return rounded(b.select("symbol", "date", "fwd_return", forecast_class(F.col("fwd_return")).alias("forecast_class")))


# ---- the processed feature table ---------------------------------------------------

_PROC_DBL = [c for c in PROCESSED_COLUMNS if c not in INT_FEATURES and c != "label"]
_PROC_INT = [c for c in PROCESSED_COLUMNS if c in INT_FEATURES or c == "label"]
FEATURES_SQL = O.with_bars(O.BARS_FLAG, O.PROCESSED, body=f"""
SELECT symbol, date, {sql_round(_PROC_DBL)}, {", ".join(_PROC_INT)} FROM processed""")


@register("features_full", FEATURES_SQL)
def features_full(spark, sf):
    return rounded(engineer_features(fx.bars_flag(spark, sf)))


# event values have two decimals, so that means of them end in a 5 at the seventh: moved off the ties of rounding
_OFF_TIES = 3e-8
# the gate's rules in words of SQL: rows enough, no price or volume missing or out of range, high on top
_GATE = """
WHERE symbol IN (
  SELECT symbol FROM all_bars GROUP BY symbol
  HAVING count(*) >= 200 AND count(*) = count(open) AND count(*) = count(high) AND count(*) = count(low)
    AND count(*) = count(close) AND count(*) = count(volume) AND min(open) > 0 AND min(high) > 0 AND min(low) > 0
    AND min(close) > 0 AND min(volume) >= 0 AND bool_and(high >= low AND high >= open AND high >= close))"""


@register("features_gated", O.with_bars(
    O.BARS_EVENT_HOUR.replace("bars AS (", "all_bars AS (", 1), f"bars AS (SELECT * FROM all_bars {_GATE})", O.PROCESSED,
    body=f"""
SELECT symbol, date, {", ".join(f"round({c} + {_OFF_TIES}, 6) + 0.0 AS {c}" for c in _PROC_DBL)}, {", ".join(_PROC_INT)}
FROM processed"""))
def features_gated(spark, sf):
    x = gated_features(fx.bars_event_hour(spark, sf))
    return rounded(x.withColumns({c: F.col(c) + _OFF_TIES for c in _PROC_DBL}))


@register("prj_01_feature_columns", O.with_bars(O.BARS_FLAG, O.PROCESSED, body="""
SELECT symbol, count(*) AS n_rows, CAST(64 AS BIGINT) AS n_features
FROM processed GROUP BY symbol"""))
def prj_01(spark, sf):
    feat = engineer_features(fx.bars_flag(spark, sf))
    n = len(feature_columns(feat))
    return feat.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.lit(n).cast("long").alias("n_features"))


@register("prj_02_drop_last_row", O.with_bars(O.BARS_FLAG, body=f"""
SELECT symbol, date, round(close, 6) + 0.0 AS close FROM (
  SELECT symbol, date, close, lead(close) OVER (PARTITION BY symbol ORDER BY date) AS nxt FROM bars)
WHERE nxt IS NOT NULL"""))
def prj_02(spark, sf):
    return rounded(drop_last_row(fx.bars_flag(spark, sf)).select("symbol", "date", "close"))


@register("prj_03_warmup_drop", O.with_bars(O.BARS_FLAG, O.INDICATOR_CTES, body="""
SELECT symbol, min(date) AS first_date, count(*) AS n_rows FROM feat3
WHERE rsi_14 IS NOT NULL AND macd IS NOT NULL AND sma_50 IS NOT NULL GROUP BY symbol"""))
def prj_03(spark, sf):
    ind = compute_indicators(fx.bars_flag(spark, sf))
    kept = drop_warmup(ind, CORE_COLUMNS)
    return kept.groupBy("symbol").agg(F.min("date").alias("first_date"), F.count("*").alias("n_rows"))


@register("prj_04_inf_ffill_zero", O.with_bars(O.BARS_FLAG, O.PROCESSED, body=f"""
SELECT symbol, date, {sql_round(['sma_200', 'price_sma200_ratio', 'willr_14', 'cci_20', 'volume_roc', 'adx'])}
FROM processed"""))
def prj_04(spark, sf):
    feat = engineer_features(fx.bars_flag(spark, sf))
    return rounded(feat.select("symbol", "date", "sma_200", "price_sma200_ratio", "willr_14", "cci_20",
                               "volume_roc", "adx"))


@register("prj_05_candle_rows", O.with_bars(O.BARS_FLAG, body=f"""
SELECT symbol, date, {sql_round(['open', 'high', 'low', 'close'])} FROM bars
WHERE date IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL"""))
def prj_05(spark, sf):
    return rounded(candle_rows(fx.bars_flag(spark, sf)).select("symbol", "date", "open", "high", "low", "close"))


@register("features_supplier", O.with_bars(O.BARS_SUPPLIER, O.PROCESSED, body=f"""
SELECT symbol, date, {sql_round(_PROC_DBL)}, {", ".join(_PROC_INT)} FROM processed"""))
def features_supplier(spark, sf):
    """Many short series (bench shape): the full feature table over supplier bars."""
    return rounded(engineer_features(fx.bars_supplier(spark, sf), lengths=fx.bars_supplier_lengths(spark, sf)))
