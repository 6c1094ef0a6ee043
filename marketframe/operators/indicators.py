"""Technical indicators (60 columns) as partitioned window expressions.

Input: a bar table ``(symbol, date, open, high, low, close, volume)``.
Output: the same rows with a 0-based row index ``_i`` and the 60 feature columns
in ``FEATURE_COLUMNS`` order. "n days" always means n rows of the symbol's series.
Every rolling value is null until its frame holds n observed values.

All expressions are SQL strings over one window ``PARTITION BY symbol ORDER BY
date``; Catalyst merges the window expressions of each projection into one
Window operator per frame family, so the table needs one exchange on ``symbol``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .ewm import Ewm, ewm_columns
from .windows import IDX, SYMBOL, DATE, by_series

# Lookbacks and output column order of the indicator table.
RETURN_LAGS = [1, 3, 5, 10, 20]
SMA_LENGTHS = [5, 10, 20, 50, 200]
EMA_LENGTHS = [5, 10, 20, 50]
EPS = 2.220446049250313e-16      # float epsilon, replaces a zero high-low range
CANDLE_EPS = 1e-9                # candle ratio denominators
BB_LENGTH, BB_STD = 5, 2.0
AROON_LENGTH = 14                # window of AROON_LENGTH + 1 rows
EXACT_SUM_MIN = 50               # SMA frames this long use an exact running-sum difference
CCI_CONSTANT = 0.015

FEATURE_COLUMNS = (
    [f"log_return_{n}d" for n in RETURN_LAGS]
    + ["overnight_gap"]
    + [c for n in SMA_LENGTHS for c in (f"sma_{n}", f"price_sma{n}_ratio")]
    + [c for n in EMA_LENGTHS for c in (f"ema_{n}", f"price_ema{n}_ratio")]
    + ["rsi_7", "rsi_14", "stoch_k", "stoch_d", "willr_14", "cci_20", "roc_10", "roc_20",
       "macd", "macd_hist", "macd_signal", "adx", "aroon_down", "aroon_up",
       "bb_lower", "bb_mid", "bb_upper", "bb_width", "bb_pct_b", "atr_14", "hist_vol_20",
       "obv", "vwap", "mfi_14", "volume_sma_ratio", "volume_roc",
       "body_size", "upper_shadow", "lower_shadow", "doji", "hammer", "bullish_engulf",
       "day_of_week", "month", "quarter", "is_month_end"]
)
INT_FEATURES = {"doji", "hammer", "bullish_engulf", "day_of_week", "month", "quarter", "is_month_end"}

#: Volume with the sign of the price change (needs the base columns).
SIGNED_VOLUME = f"CASE WHEN {IDX} = 0 THEN 1D ELSE signum(_diff) END * volume"

BAR_COLUMNS = ["symbol", "date", "open", "high", "low", "close", "volume"]


class _W:
    """SQL window clauses over one series spec."""

    def __init__(self, by: str, order: str):
        self.w = f"PARTITION BY {by} ORDER BY {order}"

    def over(self) -> str:
        return f"OVER ({self.w})"

    def last(self, n: int) -> str:
        return f"OVER ({self.w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def running(self) -> str:
        return f"OVER ({self.w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _rolled(agg: str, x: str, n: int, W: _W) -> str:
    """Rolling aggregate, null until n non-null values are in the frame."""
    return f"CASE WHEN count({x}) {W.last(n)} = {n} THEN {agg}({x}) {W.last(n)} END"


def with_row_index(df: DataFrame, by: str = SYMBOL, order: str = DATE) -> DataFrame:
    if IDX in df.columns:
        return df
    return df.selectExpr("*", f"row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS {IDX}")


def base_columns(df: DataFrame, by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """Row index and the few helper series the EWM batch reads (kept narrow: every
    column added here is carried through each following window operator)."""
    W = _W(by, order)
    df = with_row_index(df, by, order)
    df = df.selectExpr(
        "*",
        f"lag(close, 1) {W.over()} AS _c1",
        f"high - lag(high, 1) {W.over()} AS _up",
        f"lag(low, 1) {W.over()} AS _l1",
    )
    hl = f"CASE WHEN high = low THEN {EPS!r}D ELSE high - low END"
    df = df.selectExpr(
        "*",
        "close - _c1 AS _diff",
        f"CASE WHEN _c1 IS NOT NULL THEN greatest(abs({hl}), abs(high - _c1), abs(_c1 - low)) END AS _tr",
        "_l1 - low AS _dn",
    )
    pos = "CASE WHEN _up > _dn AND _up > 0 THEN _up ELSE 0D END"
    neg = "CASE WHEN _dn > _up AND _dn > 0 THEN _dn ELSE 0D END"
    return df.selectExpr(
        *[f"`{c}`" for c in df.columns if c not in ("_l1", "_c1")],
        "CASE WHEN _diff > 0 THEN _diff WHEN _diff IS NOT NULL THEN 0D END AS _gain",
        "CASE WHEN _diff < 0 THEN -_diff WHEN _diff IS NOT NULL THEN 0D END AS _loss",
        f"CASE WHEN _up IS NOT NULL THEN (CASE WHEN abs({pos}) < {EPS!r}D THEN 0D ELSE {pos} END) END AS _pdm",
        f"CASE WHEN _up IS NOT NULL THEN (CASE WHEN abs({neg}) < {EPS!r}D THEN 0D ELSE {neg} END) END AS _ndm",
    )


def second_base(df: DataFrame, by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """Helpers read inside window aggregates (which cannot nest a window function)."""
    W = _W(by, order)
    df = df.selectExpr("*", f"try_divide(close, lag(close, 1) {W.over()}) - 1.0D AS _pct", "(high + low + close) / 3.0D AS _tp",
                       f"sum(CAST(close AS DECIMAL(28, 12))) {W.running()} AS _csum")
    return df.selectExpr("*", f"lag(_tp, 1) {W.over()} AS _tp1")


def first_ewms() -> list[Ewm]:
    """The EWM series over helper columns: EMAs, RSI, ATR, directional movement."""
    first = [Ewm(f"_ema{n}", "close", n, "ema") for n in EMA_LENGTHS + [12, 26]]
    # gain and loss are observed exactly where the price change is; +DM and -DM
    # exactly where the previous high/low exist: those pairs share counts and weights
    for n in (7, 14):
        first += [Ewm(f"_ag{n}", "_gain", n, "rma", "_diff IS NOT NULL"),
                  Ewm(f"_al{n}", "_loss", n, "rma", "_diff IS NOT NULL")]
    return first + [Ewm("_atr", "_tr", 14, "rma"), Ewm("_pdm14", "_pdm", 14, "rma", "_up IS NOT NULL"),
                    Ewm("_ndm14", "_ndm", 14, "rma", "_up IS NOT NULL")]


def second_ewms() -> list[Ewm]:
    """The EWM series over outputs of the first batch."""
    return [Ewm("_macds", "_macd", 9, "ema"), Ewm("_adx", "_dx", 14, "rma")]


def macd_and_dx(df: DataFrame) -> DataFrame:
    """Inputs of the second batch; the spent helpers go."""
    dmp, dmn = "(try_divide(100D, _atr) * _pdm14)", "(try_divide(100D, _atr) * _ndm14)"
    spent = {"_gain", "_loss", "_tr", "_pdm", "_ndm", "_up", "_dn", "_ema12", "_ema26", "_pdm14", "_ndm14"}
    return df.selectExpr(*[f"`{c}`" for c in df.columns if c not in spent], "_ema12 - _ema26 AS _macd",
                         f"try_divide(100D * abs({dmp} - {dmn}), {dmp} + {dmn}) AS _dx")


def ewm_stage_columns(df: DataFrame, by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """All EWM-based series in two batches: EMAs/RSI/ATR/DM first, then the MACD
    signal and ADX, which smooth first-batch outputs."""
    df = macd_and_dx(ewm_columns(df, first_ewms(), by=by, order=order))
    return ewm_columns(df, second_ewms(), by=by, order=order).drop("_dx")


def indicator_exprs(by: str = SYMBOL, order: str = DATE) -> dict[str, str]:
    """SQL of the first-stage features over a frame with base + ewm columns."""
    W = _W(by, order)
    i = IDX
    lag_c = {n: f"lag(close, {n}) {W.over()}" for n in RETURN_LAGS}
    out: dict[str, str] = {}
    for n in RETURN_LAGS:
        out[f"log_return_{n}d"] = f"ln(try_divide(close, {lag_c[n]}))"
    out["overnight_gap"] = f"ln(try_divide(open, {lag_c[1]}))"
    for n in SMA_LENGTHS:
        if n >= EXACT_SUM_MIN:
            # long frames: difference of an exact decimal running sum, O(1) per row
            # instead of re-aggregating n rows (the mean is correctly rounded to double)
            sma = (f"CASE WHEN count(close) {W.last(n)} = {n} THEN CAST((_csum - coalesce(lag(_csum, {n}) {W.over()}, 0)) "
                   f"/ {n} AS DOUBLE) END")
        else:
            sma = _rolled("avg", "close", n, W)
        out[f"sma_{n}"] = sma
        out[f"price_sma{n}_ratio"] = f"try_divide(close, {sma})"
    for n in EMA_LENGTHS:
        out[f"ema_{n}"] = f"_ema{n}"
        out[f"price_ema{n}_ratio"] = f"try_divide(close, _ema{n})"
    for n in (7, 14):
        out[f"rsi_{n}"] = f"try_divide(100D * _ag{n}, _ag{n} + abs(_al{n}))"
    ll14, hh14 = f"min(low) {W.last(14)}", f"max(high) {W.last(14)}"
    out["_stoch_raw"] = (f"CASE WHEN count(low + high) {W.last(14)} = 14 THEN (CASE WHEN {hh14} = {ll14} THEN 0D "
                         f"ELSE 100D * (close - {ll14}) / ({hh14} - {ll14}) END) END")
    out["willr_14"] = f"CASE WHEN count(low + high) {W.last(14)} = 14 THEN 100D * (try_divide(close - {ll14}, {hh14} - {ll14}) - 1D) END"
    out["cci_20"] = "_cci_placeholder"
    out["roc_10"] = f"100D * try_divide(close - lag(close, 10) {W.over()}, lag(close, 10) {W.over()})"
    out["roc_20"] = f"100D * try_divide(close - {lag_c[20]}, {lag_c[20]})"
    out["macd"] = "_macd"
    out["macd_hist"] = "_macd - _macds"
    out["macd_signal"] = "_macds"
    out["adx"] = "_adx"
    # aroon over 15 rows; ties resolve to the most recent row
    wa = W.last(AROON_LENGTH + 1)
    lo_at = f"min(named_struct('v', low, 'j', -{i})) {wa}.j"
    hi_at = f"max(named_struct('v', high, 'j', {i})) {wa}.j"
    out["aroon_down"] = f"CASE WHEN {i} >= {AROON_LENGTH} THEN 100D * (1D - ({i} + {lo_at}) / {AROON_LENGTH}D) END"
    out["aroon_up"] = f"CASE WHEN {i} >= {AROON_LENGTH} THEN 100D * (1D - ({i} - {hi_at}) / {AROON_LENGTH}D) END"
    mid = _rolled("avg", "close", BB_LENGTH, W)
    sd = _rolled("stddev_pop", "close", BB_LENGTH, W)
    out["bb_lower"] = f"{mid} - {BB_STD!r}D * {sd}"
    out["bb_mid"] = mid
    out["bb_upper"] = f"{mid} + {BB_STD!r}D * {sd}"
    out["bb_width"] = "_bb_placeholder"
    out["bb_pct_b"] = "_bb_placeholder"
    out["atr_14"] = "_atr"
    out["hist_vol_20"] = f"{_rolled('stddev_samp', '_pct', 20, W)} * {math.sqrt(252.0)!r}D"
    out["obv"] = f"sum({SIGNED_VOLUME}) {W.running()}"
    out["vwap"] = f"try_divide(sum(close * volume) {W.running()}, sum(volume) {W.running()})"
    dtp = "(_tp - _tp1)"
    psum = f"sum(CASE WHEN {dtp} > 0 THEN _tp * volume ELSE 0D END) {W.last(14)}"
    nsum = f"sum(CASE WHEN {dtp} < 0 THEN _tp * volume ELSE 0D END) {W.last(14)}"
    out["mfi_14"] = f"CASE WHEN count(_tp * volume) {W.last(14)} = 14 THEN try_divide(100D * {psum}, {psum} + {nsum}) END"
    out["volume_sma_ratio"] = f"try_divide(volume, {_rolled('avg', 'volume', 20, W)})"
    out["volume_roc"] = f"try_divide(volume, lag(volume, 5) {W.over()}) - 1D"
    rng = f"(high - low + {CANDLE_EPS!r}D)"
    out["body_size"] = f"abs(close - open) / {rng}"
    out["upper_shadow"] = f"(high - greatest(close, open)) / {rng}"
    out["lower_shadow"] = f"(least(close, open) - low) / {rng}"
    out["doji"] = "_candle_placeholder"
    out["hammer"] = "_candle_placeholder"
    c1, o1 = lag_c[1], f"lag(open, 1) {W.over()}"
    out["bullish_engulf"] = (f"CAST(coalesce(open < {c1} AND close > {o1} AND close > open AND {c1} < {o1}, false) "
                             "AS INT)")
    out["day_of_week"] = f"CAST(weekday({order}) AS INT)"
    out["month"] = f"CAST(month({order}) AS INT)"
    out["quarter"] = f"CAST(quarter({order}) AS INT)"
    out["is_month_end"] = f"CAST(to_date({order}) = last_day({order}) AS INT)"
    # cci: mean absolute deviation about each window's own mean (bounded 20-row list)
    tp_mean = f"avg(_tp) {W.last(20)}"
    out["_tp_list"] = f"collect_list(_tp) {W.last(20)}"
    out["_tp_mean"] = tp_mean
    return out


def compute_indicators(bars: DataFrame, by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """Bars -> bars + ``_i`` + the 60 indicator columns (helper columns dropped)."""
    df = base_columns(by_series(bars, by), by, order)
    df = ewm_stage_columns(df, by, order)
    df = second_base(df, by, order)
    return feature_columns_of(df, bars.columns + [IDX], indicator_exprs(by, order), by, order)


def feature_columns_of(df: DataFrame, kept: list[str], exprs: dict[str, str], by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """The columns ``kept`` and the 60 indicator columns, out of base, EWM and second-base columns."""
    keep = [f"`{c}`" for c in kept]
    first = {k: v for k, v in exprs.items() if "_placeholder" not in v}
    staged = df.selectExpr(*keep, *[f"{e} AS {n}" for n, e in first.items()])
    W = _W(by, order)
    stoch_k = _rolled("avg", "_stoch_raw", 3, W)
    staged = staged.selectExpr(
        "*",
        f"{stoch_k} AS stoch_k",
        f"CASE WHEN size(_tp_list) = 20 THEN try_divide((high + low + close) / 3.0D - _tp_mean, {CCI_CONSTANT!r}D * "
        f"(aggregate(_tp_list, 0D, (acc, x) -> acc + abs(x - _tp_mean)) / 20D)) END AS cci_20",
        "CAST(body_size < 0.1D AS INT) AS doji",
        "CAST(lower_shadow > 2D * body_size AND upper_shadow < 0.1D AS INT) AS hammer",
        "try_divide(bb_upper - bb_lower, bb_mid) AS bb_width",
        f"try_divide(close - bb_lower, bb_upper - bb_lower + {CANDLE_EPS!r}D) AS bb_pct_b",
    )
    staged = staged.selectExpr("*", f"{_rolled('avg', 'stoch_k', 3, W)} AS stoch_d")
    return staged.selectExpr(*keep, *FEATURE_COLUMNS)
