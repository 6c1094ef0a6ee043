"""Queries: sentiment (SEN-*, AGG-01, WIN-01, JOIN-01/03), aggregations (AGG-*),
top-k (TOP-*), scalar functions (FN-*), joins and serving tables (JOIN-*, SRV-*),
and the forecast slot (ML-04, ML-12, WIN-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..config import CLASS_NAMES
from ..operators import serve as sv
from ..operators.features import align_close, engineer_features
from ..operators.indicators import FEATURE_COLUMNS
from ..operators.metrics import comparison_table, confusion_matrix
from ..operators.sentiment import (NEGATIVE_WORDS, POSITIVE_WORDS, aggregate_scores, daily_sentiment,
                                   fetched_headlines, live_sentiment, score_with_lexicon, search_query)
from ..sources import fixtures as fx
from . import oracle as O
from .catalog import register, rounded, sql_round

AS_OF = "2001-11-04"
SENT = ["sentiment_score", "sentiment_confidence", "news_count_7d", "sentiment_trend_3d"]


def _flag(spark, sf):
    return fx.bars_flag(spark, sf)


def serving_predictions(spark, sf) -> DataFrame:
    """Latest row per symbol, scored by the forecast slot, keyed 'SYMBOL.NS'."""
    latest = sv.latest_forecast(_flag(spark, sf)).select("symbol", "date", "probs")
    return sv.signals(latest.withColumn("symbol", F.concat("symbol", F.lit(".NS"))))


def serving_sentiment(spark, sf) -> DataFrame:
    bars = _flag(spark, sf)
    as_of = bars.groupBy("symbol").agg(F.max("date").alias("date"))
    live = live_sentiment(fx.scored_headlines(spark, sf), as_of)
    return live.withColumn("symbol", F.concat("symbol", F.lit(".NS")))


def serving_top_features(spark, sf) -> DataFrame:
    feat = engineer_features(_flag(spark, sf))
    imp = sv.label_correlation_importance(feat, FEATURE_COLUMNS)
    return sv.top_feature_lists(imp).withColumn("symbol", F.concat("symbol", F.lit(".NS")))


# ---- sentiment -------------------------------------------------------------------------

@register("sen_01_score_headlines", O.with_bars(O.BARS_FLAG, O.SCORED, body="""
SELECT symbol, date, position, label, score, confidence FROM scored"""))
def sen_01(spark, sf):
    return fx.scored_headlines(spark, sf).select("symbol", "date", "position", "label", "score", "confidence")


@register("sen_01_lexicon", O.with_bars(O.BARS_FLAG, O.HEADLINES, body=f"""
SELECT symbol, date, position, CASE WHEN p > n THEN 'positive' WHEN p < n THEN 'negative' ELSE 'neutral' END AS label,
       CASE WHEN p > n THEN 1.0 WHEN p < n THEN -1.0 ELSE 0.0 END AS score,
       round(CASE WHEN p = n THEN 0.5 ELSE (greatest(p, n) + 1.0) / (p + n + 2.0) END, 6) AS confidence
FROM (SELECT symbol, date, position, len(list_filter(w, lambda x: x IN {tuple(POSITIVE_WORDS)})) AS p,
             len(list_filter(w, lambda x: x IN {tuple(NEGATIVE_WORDS)})) AS n
      FROM (SELECT *, string_split_regex(lower(coalesce(headline, '')), '[^a-z]+') AS w FROM headlines))"""))
def sen_01_lexicon(spark, sf):
    scored = score_with_lexicon(fx.headlines(spark, sf))
    return rounded(scored.select("symbol", "date", "position", "label", "score", "confidence"))


@register("agg_01_headline_batch", O.with_bars(O.BARS_FLAG, O.FETCHED, body=f"""
SELECT symbol, date, {sql_round(['sentiment_score', 'sentiment_confidence', 'news_count_7d'])} FROM (
  SELECT symbol, date, avg(score) AS sentiment_score, avg(confidence) AS sentiment_confidence,
         CAST(count(*) AS DOUBLE) AS news_count_7d FROM fetched GROUP BY symbol, date)"""))
def agg_01(spark, sf):
    return rounded(aggregate_scores(fetched_headlines(fx.scored_headlines(spark, sf)), ["symbol", "date"]))


@register("sen_02_daily_sentiment", O.with_bars(O.BARS_FLAG, O.DAILY_SENTIMENT, body=f"""
SELECT symbol, date, {sql_round(SENT)} FROM daily"""))
def sen_02(spark, sf):
    return rounded(daily_sentiment(_flag(spark, sf), fx.scored_headlines(spark, sf), AS_OF))


@register("win_01_sentiment_trend", O.with_bars(O.BARS_FLAG, O.DAILY_SENTIMENT, body=f"""
SELECT symbol, date, {sql_round(['sentiment_trend_3d'])} FROM daily WHERE sentiment_trend_3d <> 0"""))
def win_01(spark, sf):
    d = daily_sentiment(_flag(spark, sf), fx.scored_headlines(spark, sf), AS_OF)
    return rounded(d.where(F.col("sentiment_trend_3d") != 0).select("symbol", "date", "sentiment_trend_3d"))


@register("join_01_sentiment_merge", O.with_bars(O.BARS_FLAG, O.PROCESSED, O.DAILY_SENTIMENT, body=f"""
SELECT p.symbol, p.date, {", ".join(f"round(coalesce(d.{c}, {v}), 6) + 0.0 AS {c}" for c, v in
                          zip(SENT, ['0.0', '0.5', '0.0', '0.0']))}, round(p.rsi_14, 6) + 0.0 AS rsi_14, p.label
FROM processed p LEFT JOIN daily d ON d.symbol = p.symbol AND d.date = p.date"""))
def join_01(spark, sf):
    bars = _flag(spark, sf)
    sent = daily_sentiment(bars, fx.scored_headlines(spark, sf), AS_OF)
    feat = engineer_features(bars, sent)
    return rounded(feat.select("symbol", "date", *SENT, "rsi_14", "label"))


@register("sen_03_live_sentiment", O.with_bars(O.BARS_FLAG, O.LIVE_SENTIMENT, body=f"""
SELECT symbol, date, {sql_round(SENT)} FROM live"""))
def sen_03(spark, sf):
    bars = _flag(spark, sf)
    as_of = bars.groupBy("symbol").agg(F.max("date").alias("date"))
    return rounded(live_sentiment(fx.scored_headlines(spark, sf), as_of))


_COMPANY_SQL = ", ".join(f"('{k}', '{v}')" for k, v in {
    "RELIANCE.NS": "Reliance Industries", "TCS.NS": "Tata Consultancy Services TCS", "INFY.NS": "Infosys",
    "HDFCBANK.NS": "HDFC Bank", "WIPRO.NS": "Wipro"}.items())
_REQ_SQL = """
req AS (
  SELECT s.symbol || '#' || CAST(v.k - 1 AS VARCHAR) AS request_id,
         CASE v.k WHEN 1 THEN s.symbol WHEN 2 THEN lower(s.symbol) WHEN 3 THEN ' ' || lower(s.symbol) || '.ns '
                  WHEN 4 THEN s.symbol || '.US' WHEN 5 THEN s.symbol || '.BO' ELSE reverse(s.symbol) END AS requested
  FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT range AS k FROM range(1, 7)) v),
norm AS (
  SELECT request_id, requested,
         CASE WHEN contains(upper(trim(requested)), '.') THEN upper(trim(requested))
              ELSE upper(trim(requested)) || '.NS' END AS symbol FROM req)"""


@register("sen_04_search_query", O.with_bars(O.BARS_FLAG, _REQ_SQL, body=f"""
SELECT n.symbol, coalesce(c.company, replace(replace(n.symbol, '.NS', ''), '.BO', '')) AS company,
       coalesce(c.company, replace(replace(n.symbol, '.NS', ''), '.BO', '')) || ' stock NSE news' AS query
FROM (SELECT DISTINCT symbol FROM norm) n LEFT JOIN (VALUES {_COMPANY_SQL}) c(sym, company) ON c.sym = n.symbol"""))
def sen_04(spark, sf):
    req = fx.request_symbols(_flag(spark, sf))
    syms = req.select(fn.normalize_symbol(F.col("requested")).alias("symbol")).distinct()
    return search_query(syms)


@register("join_03_company_lookup", O.with_bars(O.BARS_FLAG, body=f"""
SELECT n.symbol, coalesce(c.company, replace(replace(n.symbol, '.NS', ''), '.BO', '')) AS company
FROM (SELECT DISTINCT symbol || '.NS' AS symbol FROM bars) n LEFT JOIN (VALUES {_COMPANY_SQL}) c(sym, company)
  ON c.sym = n.symbol"""))
def join_03(spark, sf):
    syms = _flag(spark, sf).select(F.concat("symbol", F.lit(".NS")).alias("symbol")).distinct()
    return search_query(syms).select("symbol", "company")


# ---- aggregations ----------------------------------------------------------------------

@register("agg_02_label_distribution", O.with_bars(O.BARS_FLAG, O.PROCESSED, body="""
SELECT symbol, label, count(*) AS n FROM processed GROUP BY symbol, label"""))
def agg_02(spark, sf):
    return engineer_features(_flag(spark, sf)).groupBy("symbol", "label").agg(F.count("*").alias("n"))


# Columns of the correlation matrix.
CORR_FEATURES = ["log_return_1d", "rsi_14", "macd", "bb_width", "atr_14", "obv", "sentiment_score", "volume_sma_ratio", "label"]
_PAIRS = [(a, b) for a in CORR_FEATURES for b in CORR_FEATURES]


@register("agg_03_correlation", O.with_bars(O.BARS_FLAG, O.PROCESSED, body="SELECT symbol, feature_a, feature_b, round(c, 6) + 0.0 AS corr FROM ("
          + " UNION ALL ".join(f"SELECT symbol, '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS c FROM processed GROUP BY symbol" for a, b in _PAIRS) + ")"))
def agg_03(spark, sf):
    feat = engineer_features(_flag(spark, sf))
    from ..operators.windows import safe_corr
    wide = feat.groupBy("symbol").agg(*[safe_corr(a, b).alias(f"{a}__{b}") for a, b in _PAIRS])
    pairs = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                               F.col(f"{a}__{b}").alias("corr")) for a, b in _PAIRS])
    return rounded(wide.select("symbol", F.explode(pairs).alias("_p")).select("symbol", "_p.*"))


@register("agg_04_row_counts", O.with_bars(O.BARS_FLAG, O.DAILY_SENTIMENT, body="""
SELECT symbol, count(*) AS n_rows, CAST(sum(CASE WHEN news_count_7d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS news_days
FROM daily GROUP BY symbol"""))
def agg_04(spark, sf):
    d = daily_sentiment(_flag(spark, sf), fx.scored_headlines(spark, sf), AS_OF)
    return d.groupBy("symbol").agg(F.count("*").alias("n_rows"),
                                   F.sum(F.when(F.col("news_count_7d") > 0, 1).otherwise(0)).cast("long").alias("news_days"))


_BATCH_SQL = O.PREDICTIONS + "," + _REQ_SQL + """,
batch AS (
  SELECT n.request_id, n.requested, n.symbol,
         CASE WHEN NOT regexp_matches(n.symbol, '\\.(NS|BO)$') THEN NULL WHEN p.signal IS NULL THEN NULL ELSE p.signal END AS signal,
         CASE WHEN NOT regexp_matches(n.symbol, '\\.(NS|BO)$') THEN 'Symbol must end with .NS (NSE) or .BO (BSE)'
              WHEN p.signal IS NULL THEN 'No trained model found for ' || n.symbol END AS error
  FROM norm n LEFT JOIN pred p ON p.symbol = n.symbol)"""


def _batch(spark, sf):
    return sv.batch_results(fx.request_symbols(_flag(spark, sf)), serving_predictions(spark, sf))


@register("agg_05_batch_success", O.with_bars(O.BARS_FLAG, _BATCH_SQL, body="""
SELECT count(*) AS total, count(*) FILTER (WHERE error IS NULL) AS succeeded FROM batch"""))
def agg_05(spark, sf):
    return _batch(spark, sf).agg(F.count("*").alias("total"), F.count(F.when(F.col("error").isNull(), 1)).alias("succeeded"))


@register("agg_06_class_histogram", O.with_bars(O.BARS_FLAG, O.FORECAST, body="""
SELECT symbol, """ + ", ".join(f"round(sum(CASE WHEN cls = {k} THEN 1 ELSE 0 END) / count(*), 6) + 0.0 AS p{k}" for k in range(5)) + """
FROM fc1 WHERE ret IS NOT NULL GROUP BY symbol"""))
def agg_06(spark, sf):
    fc = _flag(spark, sf)
    from ..operators.labels import forecast_class
    from pyspark.sql import Window
    w = Window.partitionBy("symbol").orderBy("date")
    r = fc.select("symbol", (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1.0).alias("ret"))
    r = r.where(F.col("ret").isNotNull()).withColumn("cls", forecast_class(F.col("ret")))
    h = sv.histogram_probs(r, ["symbol"], "cls")
    return rounded(h.select("symbol", *[F.col("probs")[k].alias(f"p{k}") for k in range(5)]))


_PERSIST = """
lab AS (
  SELECT symbol, date, CASE WHEN fwd > 0.02 THEN 4 WHEN fwd > 0.005 THEN 3 WHEN fwd < -0.02 THEN 0
                            WHEN fwd < -0.005 THEN 1 ELSE 2 END AS y_true
  FROM (SELECT symbol, date, lead(close) OVER (PARTITION BY symbol ORDER BY date) / close - 1.0 AS fwd FROM bars)
  WHERE fwd IS NOT NULL),
lab2 AS (SELECT *, lag(y_true) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM lab),
preds AS (
  SELECT symbol, date, 'persistence' AS model, y_true, prev AS y_pred FROM lab2 WHERE prev IS NOT NULL
  UNION ALL
  SELECT symbol, date, 'always_hold' AS model, y_true, 2 AS y_pred FROM lab2 WHERE prev IS NOT NULL)"""


@register("agg_07_confusion_matrix", O.with_bars(O.BARS_FLAG, _PERSIST, body="""
SELECT s.symbol, s.model, s.y_true, """ + ", ".join(f"count(p.y_pred) FILTER (WHERE p.y_pred = {k}) AS pred_{k}" for k in range(5)) + """
FROM (SELECT DISTINCT symbol, model, k AS y_true FROM preds, (SELECT range AS k FROM range(5))) s
LEFT JOIN preds p ON p.symbol = s.symbol AND p.model = s.model AND p.y_true = s.y_true
GROUP BY s.symbol, s.model, s.y_true"""))
def agg_07(spark, sf):
    return confusion_matrix(fx.predictions_persistence(_flag(spark, sf)))


_DIGEST_SQL = O.with_bars(O.BARS_FLAG, O.PREDICTIONS, body="""
SELECT coalesce(string_agg(symbol || ': ' || signal || ' (conf=' || printf('%.0f', confidence * 100) || '%)', chr(10)
       ORDER BY symbol), 'No predictions available.') AS summary FROM pred""")


@register("agg_08_digest", _DIGEST_SQL)
def agg_08(spark, sf):
    return sv.digest(serving_predictions(spark, sf))


# ---- top-k -------------------------------------------------------------------------------

_METRICS_SQL = _PERSIST + """,
cc AS (
  SELECT symbol, model, cls, sum(s) AS support, sum(q) AS predicted, sum(t) AS tp FROM (
    SELECT symbol, model, y_true AS cls, 1 AS s, 0 AS q, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS t FROM preds
    UNION ALL SELECT symbol, model, y_pred AS cls, 0, 1, 0 FROM preds) GROUP BY symbol, model, cls),
cf AS (SELECT *, coalesce(2.0 * tp / nullif(support + predicted, 0), 0.0) AS f1 FROM cc),
metrics AS (
  SELECT symbol, model, sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1,
         sum(f1 * support) / sum(support) AS weighted_f1,
         sum(CASE WHEN cls IN (3, 4) THEN f1 ELSE 0.0 END) / 2 AS buy_f1,
         sum(CASE WHEN cls IN (0, 1) THEN f1 ELSE 0.0 END) / 2 AS sell_f1
  FROM cf GROUP BY symbol, model)"""


@register("top_01_comparison_order", O.with_bars(O.BARS_FLAG, _METRICS_SQL, body="""
SELECT row_number() OVER (PARTITION BY symbol ORDER BY round(macro_f1, 4) DESC, model) AS rank, symbol, model,
       round(macro_f1, 4) + 0.0 AS macro_f1 FROM metrics"""))
def top_01(spark, sf):
    t = comparison_table(fx.predictions_persistence(_flag(spark, sf)))
    from pyspark.sql import Window
    w = Window.partitionBy("symbol").orderBy(F.col("macro_f1").desc(), F.col("model"))
    ranked = t.select(F.row_number().over(w).alias("rank"), "symbol", "model", "macro_f1")
    return rounded(ranked).orderBy("symbol", "rank")


@register("top_02_last_candles", O.with_bars(O.BARS_FLAG, body=f"""
SELECT symbol, date, {sql_round(['close'])} FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 21"""))
def top_02(spark, sf):
    return rounded(sv.last_n(_flag(spark, sf), 21).select("symbol", "date", "close"))


@register("top_03_latest_row", O.with_bars(O.BARS_FLAG, O.PROCESSED, body=f"""
SELECT symbol, date, {sql_round(['rsi_14', 'macd', 'obv'])}, label FROM processed
WHERE (symbol, date) IN (SELECT (symbol, max(date)) FROM processed GROUP BY symbol)"""))
def top_03(spark, sf):
    feat = engineer_features(_flag(spark, sf))
    return rounded(sv.latest_rows(feat.select("symbol", "date", "rsi_14", "macd", "obv", "label")))


_IMPORTANCE_SQL = O.PROCESSED + """,
longf AS (
  SELECT symbol, label, unnest([""" + ", ".join(f"'{f}'" for f in FEATURE_COLUMNS) + """]) AS feature,
         unnest([""" + ", ".join(f"CAST({f} AS DOUBLE)" for f in FEATURE_COLUMNS) + """]) AS v FROM processed),
corrs AS (
  SELECT symbol, feature, corr(v, CAST(label AS DOUBLE)) AS c FROM longf GROUP BY symbol, feature),
imp AS (
  SELECT symbol, feature, round(abs(c), 4) AS importance,
         row_number() OVER (PARTITION BY symbol ORDER BY abs(c) DESC, feature) AS rank
  FROM corrs WHERE c IS NOT NULL AND NOT isnan(c))"""


@register("top_04_top_features", O.with_bars(O.BARS_FLAG, _IMPORTANCE_SQL, body="""
SELECT symbol, feature, importance + 0.0 AS importance, rank FROM imp WHERE rank <= 5"""))
def top_04(spark, sf):
    feat = engineer_features(_flag(spark, sf))
    return sv.label_correlation_importance(feat, FEATURE_COLUMNS).withColumn("rank", F.col("rank").cast("long"))


@register("top_06_chart_range", O.with_bars(O.BARS_FLAG, body=f"""
SELECT symbol, date, {sql_round(['open', 'close'])} FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 63"""))
def top_06(spark, sf):
    return rounded(sv.last_n(_flag(spark, sf), fn.RANGE_ROWS["3m"]).select("symbol", "date", "open", "close"))


_REPORTS_SQL = """
reports AS (
  SELECT symbol || '.NS_' || strftime(date, '%Y%m%d') || CASE WHEN rn = 1 THEN '_020000' ELSE '_013000' END
         || '_drift_report.html' AS name
  FROM (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars
        WHERE suffix(symbol, 'F')) WHERE rn <= 2),
latest_rep AS (
  SELECT regexp_extract(name, '^(.*)_\\d{8}_\\d{6}_drift_report\\.html$', 1) AS symbol,
         arg_max(name, regexp_extract(name, '\\d{8}_\\d{6}', 0)) AS latest_report,
         max(regexp_extract(name, '\\d{8}_\\d{6}', 0)) AS report_date
  FROM reports GROUP BY 1)"""


@register("top_07_latest_report", O.with_bars(O.BARS_FLAG, _REPORTS_SQL, body="""
SELECT symbol, latest_report, report_date FROM latest_rep"""))
def top_07(spark, sf):
    return sv.latest_reports(fx.report_files(_flag(spark, sf)))


@register("top_08_argmax", O.with_bars(O.BARS_FLAG, O.FORECAST, body="""
SELECT symbol, date, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS signal_class FROM fc"""))
def top_08(spark, sf):
    fc = sv.forecast_distribution(_flag(spark, sf))
    return fc.select("symbol", "date", fn.argmax_class(F.col("probs")).alias("signal_class"))


# ---- forecast slot / fallbacks / context -----------------------------------------------------

@register("ml_04_forecast_slot", O.with_bars(O.BARS_FLAG, O.FORECAST, body="""
SELECT symbol, date, """ + ", ".join(f"round(probs[{k + 1}], 6) + 0.0 AS p{k}" for k in range(5)) + " FROM fc"))
def ml_04(spark, sf):
    fc = sv.forecast_distribution(_flag(spark, sf))
    return rounded(fc.select("symbol", "date", *[F.col("probs")[k].alias(f"p{k}") for k in range(5)]))


@register("ml_12_uniform_fallback", O.with_bars(O.BARS_FLAG, O.FORECAST, body="""
SELECT symbol, count(*) FILTER (WHERE probs = [0.2, 0.2, 0.2, 0.2, 0.2]) AS n_fallback, count(*) AS n_rows
FROM fc GROUP BY symbol"""))
def ml_12(spark, sf):
    fc = sv.forecast_distribution(_flag(spark, sf))
    fb = F.col("probs") == sv.uniform_probs()
    return fc.groupBy("symbol").agg(F.count(F.when(fb, 1)).alias("n_fallback"), F.count("*").alias("n_rows"))


@register("win_02_trailing_context", O.with_bars(O.BARS_FLAG, body=f"""
SELECT symbol, date, CAST(len(ctx) AS INTEGER) AS n_context, {sql_round(['ctx_first', 'ctx_last'])} FROM (
  SELECT symbol, date, ctx, ctx[1] AS ctx_first, ctx[len(ctx)] AS ctx_last FROM (
    SELECT symbol, date, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 >= 64 THEN
      list(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 63 PRECEDING AND CURRENT ROW) END AS ctx
    FROM bars)) WHERE ctx IS NOT NULL"""))
def win_02(spark, sf):
    c = sv.trailing_context(_flag(spark, sf)).where(F.col("context").isNotNull())
    return rounded(c.select("symbol", "date", F.size("context").alias("n_context"),
                            F.element_at("context", 1).alias("ctx_first"),
                            F.element_at("context", -1).alias("ctx_last")))


# ---- scalar functions ------------------------------------------------------------------------

@register("fn_01_math", O.with_bars(O.BARS_FLAG, body=f"""
SELECT symbol, date, {sql_round(['ln_c', 'abs_d', 'sqrt_v', 'exp_r', 'round_c', 'hi', 'lo'])} FROM (
  SELECT symbol, date, ln(close) AS ln_c, abs(close - open) AS abs_d, sqrt(volume) AS sqrt_v,
         exp((close - open) / open) AS exp_r, round(close, 2) AS round_c, greatest(open, close) AS hi,
         least(open, close) AS lo FROM bars)"""))
def fn_01(spark, sf):
    b = _flag(spark, sf)
    return rounded(b.select("symbol", "date", F.log("close").alias("ln_c"), F.abs(F.col("close") - F.col("open")).alias("abs_d"),
                            F.sqrt("volume").alias("sqrt_v"), F.exp((F.col("close") - F.col("open")) / F.col("open")).alias("exp_r"),
                            F.round("close", 2).alias("round_c"), F.greatest("open", "close").alias("hi"),
                            F.least("open", "close").alias("lo")))


@register("fn_02_normalize_symbol", O.with_bars(O.BARS_FLAG, _REQ_SQL, body="SELECT request_id, requested, symbol FROM norm"))
def fn_02(spark, sf):
    r = fx.request_symbols(_flag(spark, sf))
    return r.select("request_id", "requested", fn.normalize_symbol(F.col("requested")).alias("symbol"))


@register("fn_03_validate_symbol", O.with_bars(O.BARS_FLAG, _REQ_SQL, body="""
SELECT request_id, symbol, regexp_matches(symbol, '\\.(NS|BO)$') AS valid FROM norm"""))
def fn_03(spark, sf):
    r = fx.request_symbols(_flag(spark, sf)).select("request_id", fn.normalize_symbol(F.col("requested")).alias("symbol"))
    return r.select("request_id", "symbol", fn.symbol_valid(F.col("symbol")).alias("valid"))


@register("fn_04_size_predicates", O.with_bars(O.BARS_FLAG, O.HEADLINES, _REQ_SQL, body="""
SELECT 'query' AS kind, CAST(sum(CASE WHEN length(headline) BETWEEN 5 AND 500 THEN 1 ELSE 0 END) AS BIGINT) AS n_ok,
       count(*) AS n FROM headlines
UNION ALL
SELECT 'batch', CAST(sum(CASE WHEN k BETWEEN 1 AND 20 THEN 1 ELSE 0 END) AS BIGINT), count(*) FROM (
  SELECT split_part(request_id, '#', 1) AS g, count(*) AS k FROM req GROUP BY 1)"""))
def fn_04(spark, sf):
    hl = fx.headlines(spark, sf)
    q = hl.agg(F.lit("query").alias("kind"), F.sum(fn.query_length_ok(F.col("headline")).cast("int")).cast("long").alias("n_ok"),
               F.count("*").alias("n"))
    req = fx.request_symbols(_flag(spark, sf))
    groups = req.groupBy(F.split("request_id", "#")[0].alias("g")).agg(F.collect_list("requested").alias("symbols"))
    b = groups.agg(F.lit("batch").alias("kind"), F.sum(fn.batch_size_ok(F.col("symbols")).cast("int")).cast("long").alias("n_ok"),
                   F.count("*").alias("n"))
    return q.unionByName(b)


@register("fn_05_class_name", O.with_bars(O.BARS_FLAG, O.PREDICTIONS, body="SELECT symbol, signal_class, signal FROM pred"))
def fn_05(spark, sf):
    return serving_predictions(spark, sf).select("symbol", "signal_class", "signal")


@register("fn_06_sentiment_label", O.with_bars(O.BARS_FLAG, O.DAILY_SENTIMENT, body="""
SELECT symbol, date, CASE WHEN sentiment_score > 0.1 THEN 'positive' WHEN sentiment_score < -0.1 THEN 'negative'
       ELSE 'neutral' END AS sentiment_label FROM daily"""))
def fn_06(spark, sf):
    d = daily_sentiment(_flag(spark, sf), fx.scored_headlines(spark, sf), AS_OF)
    return d.select("symbol", "date", fn.sentiment_label(F.col("sentiment_score")).alias("sentiment_label"))


@register("fn_07_probability_map", O.with_bars(O.BARS_FLAG, O.PREDICTIONS, body="SELECT symbol, "
          + ", ".join(f"round(probs[{k + 1}], 4) + 0.0 AS {n}" for k, n in enumerate(CLASS_NAMES)) + " FROM pred"))
def fn_07(spark, sf):
    p = serving_predictions(spark, sf)
    return rounded(p.select("symbol", *[F.col("probabilities")[n].alias(n) for n in CLASS_NAMES]))


def _explain_sql() -> str:
    body = """
SELECT p.symbol, p.symbol || ' shows ' || ['very strong bearish signals', 'bearish signals', 'neutral or mixed signals',
         'bullish signals', 'very strong bullish signals'][p.signal_class + 1]
       || ' (confidence ' || printf('%.0f', p.confidence * 100) || '%). Key drivers: '
       || coalesce(t.txt, '') || '. News sentiment is '
       || CASE WHEN coalesce(l.sentiment_score, 0.0) > 0.1 THEN 'positive' WHEN coalesce(l.sentiment_score, 0.0) < -0.1
               THEN 'negative' ELSE 'neutral' END
       || ' (score: ' || CASE WHEN round_even(coalesce(l.sentiment_score, 0.0), 2) >= 0 THEN '+' ELSE '' END
       || printf('%.2f', round_even(coalesce(l.sentiment_score, 0.0), 2)) || '). '
       || '[Note: Install Ollama + Granite 4.1-3B for detailed AI explanations: brew install ollama && ollama pull granite4.1:3b]'
       AS explanation
FROM pred p
LEFT JOIN (SELECT symbol || '.NS' AS symbol, sentiment_score FROM live) l ON l.symbol = p.symbol
LEFT JOIN (SELECT symbol || '.NS' AS symbol, string_agg(replace(feature, '_', ' ') || '=' || printf('%.2f', importance), ', '
                  ORDER BY rank) AS txt FROM imp WHERE rank <= 3 GROUP BY symbol) t ON t.symbol = p.symbol"""
    return O.with_bars(O.BARS_FLAG, O.PREDICTIONS, O.LIVE_SENTIMENT, _IMPORTANCE_SQL, body=body)


def _records(spark, sf) -> DataFrame:
    return sv.prediction_records(serving_predictions(spark, sf), serving_sentiment(spark, sf),
                                 serving_top_features(spark, sf))


@register("fn_08_explanation", _explain_sql())
def fn_08(spark, sf):
    return _records(spark, sf).select("symbol", "explanation")


@register("fn_09_date_text", O.with_bars(O.BARS_FLAG, O.HEADLINES, body="""
SELECT symbol, position, substr(CAST(date AS VARCHAR), 1, 10) AS day, DATE '2001-11-04' - date AS age_days,
       strftime(date, '%Y-%m-%d') AS iso FROM headlines"""))
def fn_09(spark, sf):
    h = fx.headlines(spark, sf)
    return h.select("symbol", "position", fn.date10(F.col("date")).alias("day"),
                    F.datediff(F.to_date(F.lit(AS_OF)), F.col("date")).cast("long").alias("age_days"),
                    F.date_format("date", "yyyy-MM-dd").alias("iso"))


@register("fn_10_report_stamp", O.with_bars(O.BARS_FLAG, _REPORTS_SQL, body="""
SELECT name, regexp_extract(name, '\\d{8}_\\d{6}', 0) AS stamp FROM reports"""))
def fn_10(spark, sf):
    r = fx.report_files(_flag(spark, sf))
    return r.select("name", fn.report_stamp(F.col("name")).alias("stamp"))


@register("fn_11_array_blocks", O.with_bars(O.BARS_FLAG, O.FORECAST, body="""
SELECT symbol, date, CAST(len(blocks) AS INTEGER) AS n_meta, round(list_sum(blocks[-5:]), 6) + 0.0 AS last_block_sum,
       round(blocks[6], 6) + 0.0 AS second_first FROM (
  SELECT symbol, date, list_concat(probs, [0.2, 0.2, 0.2, 0.2, 0.2], probs, [0.2, 0.2, 0.2, 0.2, 0.2]) AS blocks FROM fc)"""))
def fn_11(spark, sf):
    fc = sv.forecast_distribution(_flag(spark, sf))
    blocks = F.concat(F.col("probs"), sv.uniform_probs(), F.col("probs"), sv.uniform_probs())
    x = fc.select("symbol", "date", blocks.alias("b"))
    last = F.slice("b", -5, 5)
    return rounded(x.select("symbol", "date", F.size("b").alias("n_meta"),
                            F.aggregate(last, F.lit(0.0), lambda a, v: a + v).alias("last_block_sum"),
                            F.element_at("b", 6).alias("second_first")))


@register("fn_12_projection_cone", O.with_bars(O.BARS_FLAG, O.PREDICTIONS, """
ms AS (
  SELECT symbol, mu, sqrt(list_sum(list_transform(list_zip(probs, r), lambda x: x[1] * (x[2] - mu) * (x[2] - mu)))) AS sigma
  FROM (SELECT symbol, probs, r, list_sum(list_transform(list_zip(probs, r), lambda x: x[1] * x[2])) AS mu
        FROM (SELECT symbol, probs, [-0.025, -0.0125, 0.0, 0.0125, 0.025] AS r FROM pred))),
pts AS (SELECT symbol, mu, sigma, step, step * 21.0 / 40 AS t FROM ms CROSS JOIN (SELECT range AS step FROM range(41)))""",
          body="""
SELECT symbol, step, round(t, 6) + 0.0 AS t, round(100 * exp(mu * t), 6) + 0.0 AS mean,
       round(100 * exp(mu * t + 1.645 * sigma * sqrt(t)), 6) + 0.0 AS high,
       round(100 * exp(mu * t - 1.645 * sigma * sqrt(t)), 6) + 0.0 AS low FROM pts"""))
def fn_12(spark, sf):
    c = sv.projection_cone(serving_predictions(spark, sf), "month")
    return rounded(c.withColumn("step", F.col("step").cast("long")))


@register("fn_13_candle_flags", O.with_bars(O.BARS_FLAG, body="""
SELECT symbol, count(*) FILTER (WHERE close >= open) AS up_days, round(arg_max(close, date), 6) + 0.0 AS last_close
FROM bars GROUP BY symbol"""))
def fn_13(spark, sf):
    c = sv.candles(_flag(spark, sf)).select("symbol", "time", "up_day")
    b = _flag(spark, sf)
    last = b.groupBy("symbol").agg(F.max_by("close", "date").alias("last_close"))
    up = c.groupBy("symbol").agg(F.count(F.when(F.col("up_day"), 1)).alias("up_days"))
    return rounded(up.join(last, "symbol"))


# ---- joins and serving tables ----------------------------------------------------------------

@register("join_02_align_close", O.with_bars(O.BARS_FLAG, O.PROCESSED, body="""
SELECT p.symbol, p.date, round(last_value(b.close IGNORE NULLS) OVER (PARTITION BY p.symbol ORDER BY p.date
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) + 0.0 AS close
FROM processed p LEFT JOIN bars b ON b.symbol = p.symbol AND b.date = p.date"""))
def join_02(spark, sf):
    bars = _flag(spark, sf)
    feat = engineer_features(bars)
    return rounded(align_close(feat.select("symbol", "date"), bars))


@register("join_04_batch_requests", O.with_bars(O.BARS_FLAG, _BATCH_SQL, body="SELECT * FROM batch"))
def join_04(spark, sf):
    return _batch(spark, sf)


_STATUS_SQL = """
SELECT s.symbol, CASE WHEN r.latest_report IS NULL THEN 'no_reports' ELSE 'ok' END AS status, r.latest_report, r.report_date
FROM (SELECT DISTINCT symbol || '.NS' AS symbol FROM bars) s LEFT JOIN latest_rep r ON r.symbol = s.symbol"""


@register("join_05_drift_status", O.with_bars(O.BARS_FLAG, _REPORTS_SQL, body=_STATUS_SQL))
def join_05(spark, sf):
    syms = _flag(spark, sf).select(F.concat("symbol", F.lit(".NS")).alias("symbol")).distinct()
    return sv.drift_status(syms, fx.report_files(_flag(spark, sf)))


@register("join_06_prediction_record", O.with_bars(O.BARS_FLAG, O.PREDICTIONS, O.LIVE_SENTIMENT, body="""
SELECT p.symbol, p.signal, p.signal_class, p.confidence + 0.0 AS confidence,
       CASE WHEN coalesce(l.sentiment_score, 0.0) > 0.1 THEN 'positive' WHEN coalesce(l.sentiment_score, 0.0) < -0.1
            THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       CAST(coalesce(l.news_count_7d, 0.0) AS INTEGER) AS news_count, CAST(p.date AS VARCHAR) AS data_as_of
FROM pred p LEFT JOIN (SELECT symbol || '.NS' AS symbol, sentiment_score, news_count_7d FROM live) l ON l.symbol = p.symbol"""))
def join_06(spark, sf):
    r = _records(spark, sf)
    return r.select("symbol", "signal", "signal_class", (F.col("confidence") + 0.0).alias("confidence"),
                    F.col("sentiment.label").alias("sentiment_label"), F.col("sentiment.news_count").alias("news_count"),
                    "data_as_of")


@register("srv_01_prediction_records", O.with_bars(O.BARS_FLAG, O.PREDICTIONS, O.LIVE_SENTIMENT, body="""
SELECT p.symbol, p.signal, p.signal_class, p.confidence + 0.0 AS confidence, 'forecast_distribution' AS model_used,
       p.symbol AS sentiment_symbol, round(coalesce(l.sentiment_score, 0.0), 4) + 0.0 AS sentiment_score,
       CASE WHEN coalesce(l.sentiment_score, 0.0) > 0.1 THEN 'positive' WHEN coalesce(l.sentiment_score, 0.0) < -0.1
            THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       round(coalesce(l.sentiment_confidence, 0.5), 4) + 0.0 AS sentiment_confidence,
       CAST(coalesce(l.news_count_7d, 0.0) AS INTEGER) AS news_count, CAST(p.date AS VARCHAR) AS data_as_of,
       CAST(5 AS INTEGER) AS n_probabilities, CAST(5 AS INTEGER) AS n_top_features
FROM pred p LEFT JOIN (SELECT symbol || '.NS' AS symbol, sentiment_score, sentiment_confidence, news_count_7d FROM live) l
     ON l.symbol = p.symbol"""))
def srv_01(spark, sf):
    """The records, flattened; fn_08 checks their explanation, which names probabilities and top features."""
    r = _records(spark, sf)
    return rounded(r.select(
        "symbol", "signal", "signal_class", "confidence", "model_used",
        F.col("sentiment.symbol").alias("sentiment_symbol"), F.col("sentiment.score").alias("sentiment_score"),
        F.col("sentiment.label").alias("sentiment_label"), F.col("sentiment.confidence").alias("sentiment_confidence"),
        F.col("sentiment.news_count").alias("news_count"), "data_as_of",
        F.size("probabilities").alias("n_probabilities"), F.size("top_features").alias("n_top_features")))


@register("srv_02_candles", O.with_bars(O.BARS_FLAG, body="""
SELECT symbol, substr(CAST(date AS VARCHAR), 1, 10) AS time, round(open, 2) + 0.0 AS open, round(high, 2) + 0.0 AS high,
       round(low, 2) + 0.0 AS low, round(close, 2) + 0.0 AS close, coalesce(CAST(trunc(volume) AS BIGINT), 0) AS volume,
       close >= open AS up_day FROM bars"""))
def srv_02(spark, sf):
    return rounded(sv.candles(_flag(spark, sf)), 2)


@register("srv_03_digest", _DIGEST_SQL)
def srv_03(spark, sf):
    return sv.digest(serving_predictions(spark, sf))


@register("srv_04_batch_result", O.with_bars(O.BARS_FLAG, _BATCH_SQL, body="""
SELECT count(*) FILTER (WHERE error IS NULL) AS total, count(*) FILTER (WHERE error IS NOT NULL) AS n_errors FROM batch"""))
def srv_04(spark, sf):
    b = _batch(spark, sf)
    return b.agg(F.count(F.when(F.col("error").isNull(), 1)).alias("total"),
                 F.count(F.when(F.col("error").isNotNull(), 1)).alias("n_errors"))


@register("srv_05_drift_status", O.with_bars(O.BARS_FLAG, _REPORTS_SQL, body=_STATUS_SQL))
def srv_05(spark, sf):
    return join_05(spark, sf)
