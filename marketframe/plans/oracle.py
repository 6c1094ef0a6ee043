"""Independent DuckDB SQL for the registered queries.

Each oracle is self-contained: it starts from the pre-registered base tables
(lineitem, documents, labels, events, ...) and rebuilds the fixture shapes with
CTEs. Exponential averages are computed by ``WITH RECURSIVE`` over the row index,
i.e. by their defining recurrence, not by the block formula the Spark side uses.
"""

from __future__ import annotations

# Fixture definitions (must agree with sources/fixtures.py).
PRICE = "(100 + l_extendedprice / 20011.0)"
KEY = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"

BARS_FLAG = f"""
bars AS (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date,
         arg_min({PRICE}, {KEY}) AS open, max({PRICE}) AS high, min({PRICE}) AS low,
         arg_max({PRICE}, {KEY}) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume
  FROM lineitem GROUP BY 1, 2)"""

BARS_ORDERDATE = f"""
bars2 AS (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(o_orderdate AS DATE) AS date,
         arg_min({PRICE}, {KEY}) AS open, max({PRICE}) AS high, min({PRICE}) AS low,
         arg_max({PRICE}, {KEY}) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""

BARS_SUPPLIER = f"""
bars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
         arg_min({PRICE}, {KEY}) AS open, max({PRICE}) AS high, min({PRICE}) AS low,
         arg_max({PRICE}, {KEY}) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume
  FROM lineitem GROUP BY 1, 2)"""

BARS_EVENT_HOUR = """
bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS date,
         arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""

HEADLINES = """
headlines AS (
  SELECT (['AF','AO','NF','NO','RF','RO'])[CAST(doc_id % 6 AS INTEGER) + 1] AS symbol,
         CAST(DATE '2001-07-25' + CAST((doc_id // 6) % 103 AS INTEGER) AS DATE) AS date,
         doc_id AS position,
         trim(text) AS headline
  FROM documents)"""

SCORED = HEADLINES + """,
scored AS (
  SELECT h.symbol, h.date, h.position, h.headline,
         CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
         CASE WHEN l.toxic = 1 THEN -1.0 WHEN l.quality = 1 THEN 1.0 ELSE 0.0 END AS score,
         CASE WHEN l.toxic = 1 THEN 0.9 WHEN l.quality = 1 THEN 0.8 ELSE 0.5 END AS confidence
  FROM headlines h LEFT JOIN labels l ON h.position = l.doc_id)"""

W = "PARTITION BY symbol ORDER BY date"
EPS = "2.220446049250313e-16"


def _last(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RUN = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

# Indicator stages over `bars` (symbol, date, open, high, low, close, volume).
_EMA_N = [5, 10, 20, 50, 12, 26]


def _ema_rec(n: int, prev: str, cur: str) -> str:
    a = 2.0 / (n + 1)
    return (f"CASE WHEN b.i < {n - 1} THEN NULL WHEN b.i = {n - 1} THEN b.seed{n} "
            f"ELSE {a!r} * b.{cur} + {1 - a!r} * r.{prev} END")


INDICATOR_CTES = f"""
b0 AS (
  SELECT *, row_number() OVER ({W}) - 1 AS i,
         lag(close, 1) OVER ({W}) AS c1, lag(open, 1) OVER ({W}) AS o1,
         lag(high, 1) OVER ({W}) AS h1, lag(low, 1) OVER ({W}) AS l1,
         lag(volume, 5) OVER ({W}) AS v5, lag(close, 3) OVER ({W}) AS cl3,
         lag(close, 5) OVER ({W}) AS cl5, lag(close, 10) OVER ({W}) AS cl10,
         lag(close, 20) OVER ({W}) AS cl20, (high + low + close) / 3.0 AS tp
  FROM bars),
b1 AS (
  SELECT *, close - c1 AS diff, close / c1 - 1.0 AS pct,
         CASE WHEN c1 IS NOT NULL THEN greatest(CASE WHEN high = low THEN {EPS} ELSE high - low END,
              abs(high - c1), abs(c1 - low)) END AS tr,
         lag(tp, 1) OVER ({W}) AS tp1, high - h1 AS up, l1 - low AS dn,
         {", ".join(f"avg(close) {_last(n)} AS seed{n}" for n in _EMA_N)}
  FROM b0),
b2 AS (
  SELECT *,
         CASE WHEN diff > 0 THEN diff WHEN diff IS NOT NULL THEN 0.0 END AS gain,
         CASE WHEN diff < 0 THEN -diff WHEN diff IS NOT NULL THEN 0.0 END AS loss,
         CASE WHEN up IS NOT NULL THEN (CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END) END AS pdm,
         CASE WHEN up IS NOT NULL THEN (CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END) END AS ndm
  FROM b1),
r1 AS (
  SELECT symbol, i,
         {", ".join(f"CAST(CASE WHEN i = {n - 1} THEN seed{n} END AS DOUBLE) AS e{n}" for n in _EMA_N)},
         CAST(coalesce(gain, 0.0) AS DOUBLE) AS g7, CAST(coalesce(loss, 0.0) AS DOUBLE) AS l7,
         CAST(CASE WHEN gain IS NULL THEN 0.0 ELSE 1.0 END AS DOUBLE) AS d7,
         CAST(coalesce(gain, 0.0) AS DOUBLE) AS g14, CAST(coalesce(loss, 0.0) AS DOUBLE) AS l14,
         CAST(CASE WHEN gain IS NULL THEN 0.0 ELSE 1.0 END AS DOUBLE) AS d14,
         CAST(coalesce(tr, 0.0) AS DOUBLE) AS tr14, CAST(coalesce(pdm, 0.0) AS DOUBLE) AS p14,
         CAST(coalesce(ndm, 0.0) AS DOUBLE) AS n14
  FROM b2 WHERE i = 0
  UNION ALL
  SELECT b.symbol, b.i,
         {", ".join(_ema_rec(n, f"e{n}", "close") + f" AS e{n}" for n in _EMA_N)},
         {6/7!r} * r.g7 + coalesce(b.gain, 0.0), {6/7!r} * r.l7 + coalesce(b.loss, 0.0),
         {6/7!r} * r.d7 + CASE WHEN b.gain IS NULL THEN 0.0 ELSE 1.0 END,
         {13/14!r} * r.g14 + coalesce(b.gain, 0.0), {13/14!r} * r.l14 + coalesce(b.loss, 0.0),
         {13/14!r} * r.d14 + CASE WHEN b.gain IS NULL THEN 0.0 ELSE 1.0 END,
         {13/14!r} * r.tr14 + coalesce(b.tr, 0.0), {13/14!r} * r.p14 + coalesce(b.pdm, 0.0),
         {13/14!r} * r.n14 + coalesce(b.ndm, 0.0)
  FROM r1 r JOIN b2 b ON b.symbol = r.symbol AND b.i = r.i + 1),
b3 AS (
  SELECT b.*, r.e5, r.e10, r.e20, r.e50, r.e12 - r.e26 AS macd,
         CASE WHEN b.i >= 7 THEN r.g7 / r.d7 END AS ag7, CASE WHEN b.i >= 7 THEN r.l7 / r.d7 END AS al7,
         CASE WHEN b.i >= 14 THEN r.g14 / r.d14 END AS ag14, CASE WHEN b.i >= 14 THEN r.l14 / r.d14 END AS al14,
         CASE WHEN b.i >= 14 THEN r.tr14 / r.d14 END AS atr,
         CASE WHEN b.i >= 14 THEN r.p14 / r.d14 END AS pdm14,
         CASE WHEN b.i >= 14 THEN r.n14 / r.d14 END AS ndm14
  FROM b2 b JOIN r1 r ON b.symbol = r.symbol AND b.i = r.i),
b4 AS (
  SELECT *, avg(macd) {_last(9)} AS seed_sig,
         100.0 * abs(100.0 / atr * pdm14 - 100.0 / atr * ndm14)
           / nullif(100.0 / atr * pdm14 + 100.0 / atr * ndm14, 0) AS dx,
         count(100.0 * abs(100.0 / atr * pdm14 - 100.0 / atr * ndm14)
           / nullif(100.0 / atr * pdm14 + 100.0 / atr * ndm14, 0)) {RUN} AS dx_seen
  FROM b3),
r2 AS (
  SELECT symbol, i, CAST(NULL AS DOUBLE) AS sig, CAST(coalesce(dx, 0.0) AS DOUBLE) AS nx,
         CAST(CASE WHEN dx IS NULL THEN 0.0 ELSE 1.0 END AS DOUBLE) AS dxd
  FROM b4 WHERE i = 0
  UNION ALL
  SELECT b.symbol, b.i,
         CASE WHEN b.i < 33 THEN NULL WHEN b.i = 33 THEN b.seed_sig ELSE {0.2!r} * b.macd + {0.8!r} * r.sig END,
         {13/14!r} * r.nx + coalesce(b.dx, 0.0),
         {13/14!r} * r.dxd + CASE WHEN b.dx IS NULL THEN 0.0 ELSE 1.0 END
  FROM r2 r JOIN b4 b ON b.symbol = r.symbol AND b.i = r.i + 1),
b5 AS (
  SELECT b.*, r.sig AS macds, CASE WHEN b.dx_seen >= 14 THEN r.nx / r.dxd END AS adx
  FROM b4 b JOIN r2 r ON b.symbol = r.symbol AND b.i = r.i),
feat AS (
  SELECT symbol, date, i, close,
    ln(close / c1) AS log_return_1d, ln(close / cl3) AS log_return_3d, ln(close / cl5) AS log_return_5d,
    ln(close / cl10) AS log_return_10d, ln(close / cl20) AS log_return_20d,
    ln(open / c1) AS overnight_gap,
    {", ".join(f"CASE WHEN i >= {n - 1} THEN avg(close) {_last(n)} END AS sma_{n}, close / nullif(CASE WHEN i >= {n - 1} THEN avg(close) {_last(n)} END, 0) AS price_sma{n}_ratio" for n in [5, 10, 20, 50, 200])},
    {", ".join(f"e{n} AS ema_{n}, close / nullif(e{n}, 0) AS price_ema{n}_ratio" for n in [5, 10, 20, 50])},
    100.0 * ag7 / nullif(ag7 + abs(al7), 0) AS rsi_7,
    100.0 * ag14 / nullif(ag14 + abs(al14), 0) AS rsi_14,
    CASE WHEN i >= 13 THEN (CASE WHEN max(high) {_last(14)} = min(low) {_last(14)} THEN 0.0
         ELSE 100.0 * (close - min(low) {_last(14)}) / (max(high) {_last(14)} - min(low) {_last(14)}) END) END AS stoch_raw,
    CASE WHEN i >= 13 THEN 100.0 * ((close - min(low) {_last(14)}) / nullif(max(high) {_last(14)} - min(low) {_last(14)}, 0) - 1.0) END AS willr_14,
    list(tp) {_last(20)} AS tp_list, avg(tp) {_last(20)} AS tp_mean, tp AS tp_now,
    100.0 * (close - lag(close, 10) OVER ({W})) / nullif(lag(close, 10) OVER ({W}), 0) AS roc_10,
    100.0 * (close - cl20) / nullif(cl20, 0) AS roc_20,
    macd, macd - macds AS macd_hist, macds AS macd_signal, adx,
    CASE WHEN i >= 14 THEN 100.0 * (1.0 - (i - max({{'v': low * -1.0, 'j': i}}) {_last(15)}.j) / 14.0) END AS aroon_down,
    CASE WHEN i >= 14 THEN 100.0 * (1.0 - (i - max({{'v': high, 'j': i}}) {_last(15)}.j) / 14.0) END AS aroon_up,
    CASE WHEN i >= 4 THEN avg(close) {_last(5)} - 2.0 * stddev_pop(close) {_last(5)} END AS bb_lower,
    CASE WHEN i >= 4 THEN avg(close) {_last(5)} END AS bb_mid,
    CASE WHEN i >= 4 THEN avg(close) {_last(5)} + 2.0 * stddev_pop(close) {_last(5)} END AS bb_upper,
    atr AS atr_14,
    CASE WHEN count(pct) {_last(20)} = 20 THEN stddev_samp(pct) {_last(20)} END * sqrt(252.0) AS hist_vol_20,
    sum(CASE WHEN i = 0 THEN 1.0 ELSE sign(diff) END * volume) {RUN} AS obv,
    sum(close * volume) {RUN} / nullif(sum(volume) {RUN}, 0) AS vwap,
    CASE WHEN i >= 13 THEN 100.0 * sum(CASE WHEN tp - tp1 > 0 THEN tp * volume ELSE 0.0 END) {_last(14)}
         / nullif(sum(CASE WHEN tp - tp1 > 0 THEN tp * volume ELSE 0.0 END) {_last(14)}
                + sum(CASE WHEN tp - tp1 < 0 THEN tp * volume ELSE 0.0 END) {_last(14)}, 0) END AS mfi_14,
    volume / nullif(CASE WHEN i >= 19 THEN avg(volume) {_last(20)} END, 0) AS volume_sma_ratio,
    volume / nullif(v5, 0) - 1.0 AS volume_roc,
    abs(close - open) / (high - low + 1e-9) AS body_size,
    (high - greatest(close, open)) / (high - low + 1e-9) AS upper_shadow,
    (least(close, open) - low) / (high - low + 1e-9) AS lower_shadow,
    CAST(coalesce(open < c1 AND close > o1 AND close > open AND c1 < o1, false) AS INTEGER) AS bullish_engulf,
    CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
    CAST(quarter(date) AS INTEGER) AS quarter, CAST(date = last_day(date) AS INTEGER) AS is_month_end,
    lead(close, 1) OVER ({W}) / close - 1.0 AS fwd_return
  FROM b5),
feat2 AS (
  SELECT *,
    CASE WHEN count(stoch_raw) {_last(3)} = 3 THEN avg(stoch_raw) {_last(3)} END AS stoch_k,
    CASE WHEN i >= 19 THEN (tp_now - tp_mean) / nullif(0.015 * (list_sum(list_transform(tp_list,
         lambda x: abs(x - tp_mean))) / 20.0), 0) END AS cci_20,
    CAST(body_size < 0.1 AS INTEGER) AS doji,
    CAST(lower_shadow > 2.0 * body_size AND upper_shadow < 0.1 AS INTEGER) AS hammer,
    (bb_upper - bb_lower) / nullif(bb_mid, 0) AS bb_width,
    (close - bb_lower) / nullif(bb_upper - bb_lower + 1e-9, 0) AS bb_pct_b
  FROM feat),
feat3 AS (
  SELECT *, CASE WHEN count(stoch_k) {_last(3)} = 3 THEN avg(stoch_k) {_last(3)} END AS stoch_d,
    CASE WHEN fwd_return > 0.02 THEN 4 WHEN fwd_return > 0.005 THEN 3 WHEN fwd_return < -0.02 THEN 0
         WHEN fwd_return < -0.005 THEN 1 ELSE 2 END AS label
  FROM feat2),
kept AS (
  SELECT * FROM feat3
  WHERE fwd_return IS NOT NULL AND rsi_14 IS NOT NULL AND macd IS NOT NULL AND sma_50 IS NOT NULL)"""


# The 60 indicator columns in table order (same list as the Spark side).
FEATURES = (
    [f"log_return_{n}d" for n in [1, 3, 5, 10, 20]] + ["overnight_gap"]
    + [c for n in [5, 10, 20, 50, 200] for c in (f"sma_{n}", f"price_sma{n}_ratio")]
    + [c for n in [5, 10, 20, 50] for c in (f"ema_{n}", f"price_ema{n}_ratio")]
    + ["rsi_7", "rsi_14", "stoch_k", "stoch_d", "willr_14", "cci_20", "roc_10", "roc_20",
       "macd", "macd_hist", "macd_signal", "adx", "aroon_down", "aroon_up",
       "bb_lower", "bb_mid", "bb_upper", "bb_width", "bb_pct_b", "atr_14", "hist_vol_20",
       "obv", "vwap", "mfi_14", "volume_sma_ratio", "volume_roc",
       "body_size", "upper_shadow", "lower_shadow", "doji", "hammer", "bullish_engulf",
       "day_of_week", "month", "quarter", "is_month_end"]
)
INT_FEATURES = {"doji", "hammer", "bullish_engulf", "day_of_week", "month", "quarter", "is_month_end"}


def _filled(c: str) -> str:
    if c in INT_FEATURES:
        return f"CAST(coalesce(last_value({c} IGNORE NULLS) {RUN}, 0) AS INTEGER) AS {c}"
    clean = f"CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END"
    return f"CAST(coalesce(last_value({clean} IGNORE NULLS) {RUN}, 0.0) AS DOUBLE) AS {c}"


PROCESSED = (INDICATOR_CTES + """,
processed AS (
  SELECT symbol, date, i, close, """ + ", ".join(_filled(c) for c in FEATURES) + """,
    0.0 AS sentiment_score, 0.5 AS sentiment_confidence, 0.0 AS news_count_7d, 0.0 AS sentiment_trend_3d,
    CAST(label AS INTEGER) AS label
  FROM kept)""")


def with_bars(bars: str, *ctes: str, body: str) -> str:
    """Assemble ``WITH RECURSIVE <bars>, <ctes...> <body>``."""
    parts = [bars.strip()] + [c.strip() for c in ctes]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


# ---- forecast slot, serving predictions, headline fetches -------------------------

_W64 = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)"
FORECAST = f"""
fc0 AS (
  SELECT symbol, date, open, high, low, close, volume,
         row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i,
         close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1.0 AS ret
  FROM bars),
fc1 AS (
  SELECT *, CASE WHEN ret > 0.02 THEN 4 WHEN ret > 0.005 THEN 3 WHEN ret > -0.005 THEN 2
                 WHEN ret > -0.02 THEN 1 ELSE 0 END AS cls FROM fc0),
fc AS (
  SELECT symbol, date, open, high, low, close, volume, i,
         CASE WHEN i >= 64 THEN [{", ".join(f"sum(CASE WHEN ret IS NOT NULL AND cls = {k} THEN 1 ELSE 0 END) {_W64} / 64.0" for k in range(5))}]
              ELSE [0.2, 0.2, 0.2, 0.2, 0.2] END AS probs
  FROM fc1)"""

SIGNAL_NAMES_SQL = "['Strong Sell', 'Sell', 'Hold', 'Buy', 'Strong Buy']"

PREDICTIONS = FORECAST + f""",
latest AS (
  SELECT * FROM fc WHERE (symbol, date) IN (SELECT (symbol, max(date)) FROM fc GROUP BY symbol)),
pred AS (
  SELECT symbol || '.NS' AS symbol, date, probs,
         CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS signal_class,
         {SIGNAL_NAMES_SQL}[list_position(probs, list_max(probs))] AS signal,
         round(probs[list_position(probs, list_max(probs))], 4) AS confidence
  FROM latest)"""

FETCHED = SCORED + """,
fetched AS (
  SELECT symbol, date, headline, position, score, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY position) AS rn FROM (
      SELECT symbol, date, headline, min(position) AS position, arg_min(score, position) AS score,
             arg_min(confidence, position) AS confidence
      FROM scored GROUP BY symbol, date, headline))
  WHERE rn <= 20)"""

DAILY_SENTIMENT = FETCHED + """,
day_agg AS (
  SELECT symbol, date, avg(score) AS s, avg(confidence) AS c, CAST(count(*) AS DOUBLE) AS n
  FROM fetched GROUP BY symbol, date),
daily0 AS (
  SELECT d.symbol, d.date,
         CASE WHEN DATE '2001-11-04' - d.date <= 90 AND a.n IS NOT NULL THEN a.s ELSE 0.0 END AS sentiment_score,
         CASE WHEN DATE '2001-11-04' - d.date <= 90 AND a.n IS NOT NULL THEN a.c ELSE 0.5 END AS sentiment_confidence,
         CASE WHEN DATE '2001-11-04' - d.date <= 90 AND a.n IS NOT NULL THEN a.n ELSE 0.0 END AS news_count_7d
  FROM (SELECT DISTINCT symbol, date FROM bars) d LEFT JOIN day_agg a ON a.symbol = d.symbol AND a.date = d.date),
daily AS (
  SELECT *, coalesce(sentiment_score - lag(sentiment_score, 3) OVER (PARTITION BY symbol ORDER BY date), 0.0)
         AS sentiment_trend_3d FROM daily0)"""

LIVE_SENTIMENT = FETCHED + """,
as_of_days AS (SELECT symbol, max(date) AS date FROM bars GROUP BY symbol),
pool AS (
  SELECT a.symbol, a.date AS as_of, f.headline, min(f.position) AS position,
         arg_min(f.score, f.position) AS score, arg_min(f.confidence, f.position) AS confidence
  FROM as_of_days a JOIN fetched f ON f.symbol = a.symbol AND f.date BETWEEN a.date - INTERVAL 6 DAY AND a.date
  GROUP BY a.symbol, a.date, f.headline),
live AS (
  SELECT a.symbol, a.date, coalesce(p.s, 0.0) AS sentiment_score, coalesce(p.c, 0.5) AS sentiment_confidence,
         coalesce(p.n, 0.0) AS news_count_7d, 0.0 AS sentiment_trend_3d
  FROM as_of_days a LEFT JOIN (SELECT symbol, as_of, avg(score) AS s, avg(confidence) AS c,
                                CAST(count(*) AS DOUBLE) AS n FROM pool GROUP BY symbol, as_of) p
    ON p.symbol = a.symbol AND p.as_of = a.date)"""
