"""Queries: quality rules (DQ-*), file sources/sinks (SRC-*), upserts and dedupe (SET-*)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import quality as dq
from ..operators.bars import filter_period, incremental_rows, next_missing_date, upsert_bars
from ..operators.features import engineer_features
from ..operators.sets import cap_per_group, dedupe_first, lookback_union
from ..sources import fixtures as fx
from ..sources import io
from . import oracle as O
from .catalog import register, rounded, sql_round
from .q_features import FEATURES_SQL
from .q_models import METRIC_COLS, _PERSIST_SQL

# the raw rules once more, written for the oracle alone
_SQL_PRICES = {
    "open_not_null": "open IS NULL", "high_not_null": "high IS NULL", "low_not_null": "low IS NULL",
    "close_not_null": "close IS NULL", "volume_not_null": "volume IS NULL",
    "open_gt_0": "NOT open > 0", "high_gt_0": "NOT high > 0", "low_gt_0": "NOT low > 0",
    "close_gt_0": "NOT close > 0", "volume_ge_0": "NOT volume >= 0"}
_SQL_OHLC = {"high_ge_low": "NOT high >= low", "high_ge_open": "NOT high >= open", "high_ge_close": "NOT high >= close"}


def _rules_sql(rules: dict[str, str]) -> str:
    return ", ".join(f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, c in rules.items())


@register("dq_01_raw_range_rules", O.with_bars(O.BARS_EVENT_HOUR, body=f"""
SELECT symbol, count(*) AS n_rows, {_rules_sql(_SQL_PRICES)} FROM bars GROUP BY symbol"""))
def dq_01(spark, sf):
    t = dq.raw_rule_table(fx.bars_event_hour(spark, sf))
    return t.select("symbol", "n_rows", *dq.RAW_RULES)


@register("dq_02_min_rows", O.with_bars(O.BARS_FLAG, body="""
SELECT symbol, count(*) AS n_rows, count(*) >= 200 AS passed FROM bars GROUP BY symbol"""))
def dq_02(spark, sf):
    return dq.row_count_rule(fx.bars_flag(spark, sf))


@register("dq_03_arrival_order", """
SELECT event_type AS symbol, CAST(sum(CASE WHEN prev > ts THEN 1 ELSE 0 END) AS BIGINT) AS order_violations
FROM (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS prev FROM events)
GROUP BY event_type""")
def dq_03(spark, sf):
    ev = fx.read_table(spark, sf, "events", ["event_id", "ts", "event_type"])
    return dq.order_violations(ev, "event_type", "event_id", "ts", bucket_rows=1000)


@register("dq_04_duplicate_dates", O.with_bars(O.BARS_FLAG, O.BARS_ORDERDATE, body="""
SELECT symbol, date, count(*) AS n FROM (SELECT symbol, date FROM bars UNION ALL SELECT symbol, date FROM bars2)
GROUP BY symbol, date HAVING count(*) > 1"""))
def dq_04(spark, sf):
    both = fx.bars_flag(spark, sf).unionByName(fx.bars_flag_orderdate(spark, sf))
    return dq.duplicate_dates(both)


@register("dq_05_ohlc_rules", O.with_bars(O.BARS_FLAG, body=f"""
SELECT symbol, {_rules_sql(_SQL_OHLC)} FROM bars GROUP BY symbol"""))
def dq_05(spark, sf):
    return dq.raw_rule_table(fx.bars_flag(spark, sf)).select("symbol", *dq.OHLC_RULES)


_GROUPS_SQL = ", ".join(f"('{g}')" for g in (
    "returns", "moving_avg", "momentum", "volatility", "volume", "sentiment", "label"))


@register("dq_06_feature_groups", O.with_bars(O.BARS_FLAG, body=f"""
SELECT s.symbol, g.feature_group, true AS present
FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (VALUES {_GROUPS_SQL}) g(feature_group)"""))
def dq_06(spark, sf):
    return dq.feature_groups_present(engineer_features(fx.bars_flag(spark, sf)))


_PROC_RULES = {"label_not_null": "label IS NULL", "label_in_range": "label NOT IN (0, 1, 2, 3, 4)",
               **{f"{c}_not_null": f"{c} IS NULL" for c in
                  ["sentiment_score", "sentiment_confidence", "news_count_7d", "sentiment_trend_3d"]}}


@register("dq_07_processed_rules", O.with_bars(O.BARS_FLAG, O.PROCESSED, body=f"""
SELECT *, n_rows >= 100 AND {" AND ".join(f"{r} = 0" for r in _PROC_RULES)} AS passed FROM (
SELECT symbol, count(*) AS n_rows, {_rules_sql(_PROC_RULES)} FROM processed GROUP BY symbol)"""))
def dq_07(spark, sf):
    return dq.processed_rule_table(engineer_features(fx.bars_flag(spark, sf)))


@register("dq_08_keep_valid", O.with_bars(O.BARS_EVENT_HOUR, body=f"""
SELECT symbol, count(*) AS n_rows FROM bars WHERE symbol IN (
  SELECT symbol FROM bars GROUP BY symbol
  HAVING count(*) >= 200 AND {" AND ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) = 0" for c in (_SQL_PRICES | _SQL_OHLC).values())})
GROUP BY symbol"""))
def dq_08(spark, sf):
    return dq.keep_valid(fx.bars_event_hour(spark, sf)).groupBy("symbol").agg(F.count("*").alias("n_rows"))


@register("dq_09_coercion", """
SELECT event_type, count(*) AS n_rows,
  CAST(sum(CASE WHEN try_cast(CAST(value AS VARCHAR) AS DOUBLE) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS value_newly_null,
  CAST(sum(CASE WHEN try_cast(props AS DOUBLE) IS NULL AND props IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS props_newly_null,
  CAST(sum(CASE WHEN try_cast(CAST(user_id AS VARCHAR) AS BIGINT) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS user_id_newly_null
FROM events GROUP BY event_type""")
def dq_09(spark, sf):
    ev = fx.read_table(spark, sf, "events", ["event_type", "value", "props", "user_id"])
    raw = ev.select("event_type", F.col("value").cast("string").alias("value"), "props",
                    F.col("user_id").cast("string").alias("user_id"))
    return dq.coercion_report(raw, {"value": "DOUBLE", "props": "DOUBLE", "user_id": "BIGINT"}, ["event_type"])


# ---- sources and sinks ---------------------------------------------------------------

_OHLCV = ["open", "high", "low", "close", "volume"]
_BARS_SQL = O.with_bars(O.BARS_FLAG, body=f"SELECT symbol, date, {sql_round(_OHLCV)} FROM bars")


@register("src_01_read_bars_csv", _BARS_SQL)
def src_01(spark, sf):
    path = io.scratch_path(spark, "bars-csv")
    io.write_bars(fx.bars_flag(spark, sf), path)
    return rounded(io.read_bars(spark, path).select("symbol", "date", *_OHLCV))


@register("src_02_write_bars_per_symbol", O.with_bars(O.BARS_SUPPLIER, body=f"""
SELECT symbol, count(*) AS n_rows, {", ".join(f"round(sum({c}), 4) + 0.0 AS {c}" for c in _OHLCV)}
FROM bars GROUP BY symbol"""))
def src_02(spark, sf):
    path = io.scratch_path(spark, "bars-parquet")
    io.write_bars(fx.bars_supplier(spark, sf), path, fmt="parquet")
    got = io.read_per_symbol(spark, path).groupBy("symbol").agg(
        F.count("*").alias("n_rows"), *[F.sum(c).alias(c) for c in _OHLCV])
    return rounded(got.withColumn("symbol", F.col("symbol").cast("string")), 4)


@register("src_03_write_features", FEATURES_SQL)
def src_03(spark, sf):
    path = io.scratch_path(spark, "features")
    io.write_features(engineer_features(fx.bars_flag(spark, sf)), path)
    return rounded(spark.read.parquet(path))


@register("src_04_load_processed", O.with_bars(O.BARS_FLAG, O.PROCESSED, body=f"""
SELECT symbol, date, {sql_round(['close_ratio'])}, label FROM (
  SELECT symbol, date, price_sma20_ratio AS close_ratio, label FROM processed WHERE symbol = 'AF')"""))
def src_04(spark, sf):
    path = io.scratch_path(spark, "features")
    io.write_features(engineer_features(fx.bars_flag(spark, sf)), path)
    got = io.load_processed(spark, path, "AF")
    return rounded(got.select("symbol", "date", F.col("price_sma20_ratio").alias("close_ratio"), "label"))


@register("src_05_headline_cache", O.with_bars(O.BARS_FLAG, O.FETCHED, body="""
SELECT symbol, date, '2001-11-04T00:00:00' AS fetched_at, headline,
       CAST(row_number() OVER (PARTITION BY symbol, date ORDER BY position) - 1 AS INTEGER) AS pos FROM fetched"""))
def src_05(spark, sf):
    path = io.scratch_path(spark, "news")
    io.write_headline_cache(fx.headlines(spark, sf), path, fetched_at="2001-11-04T00:00:00")
    return io.read_headline_cache(spark, path)


@register("src_06_metrics_json", O.with_bars(O.BARS_FLAG, _PERSIST_SQL, body=f"""
SELECT '2001-11-04T00:00:00' AS trained_at, symbol, model, {sql_round(METRIC_COLS)} FROM metrics"""))
def src_06(spark, sf):
    from ..operators.metrics import classification_metrics
    preds = fx.predictions_persistence(fx.bars_flag(spark, sf))
    path = io.scratch_path(spark, "metrics")
    io.write_metrics_json(classification_metrics(preds), path, trained_at="2001-11-04T00:00:00")
    records = io.read_metrics_json(spark, path).select("trained_at", "symbol", F.explode("metrics").alias("model", "m"))
    return rounded(records.select("trained_at", "symbol", "model", *[F.col("m")[c].alias(c) for c in METRIC_COLS]))


@register("src_07_comparison_csv", O.with_bars(O.BARS_FLAG, _PERSIST_SQL, body="""
SELECT symbol, model, """ + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in METRIC_COLS) + " FROM metrics"))
def src_07(spark, sf):
    from ..operators.metrics import comparison_table
    preds = fx.predictions_persistence(fx.bars_flag(spark, sf))
    stamp = datetime(2001, 11, 4).strftime("%Y%m%d_%H%M%S")
    path = io.scratch_path(spark, f"model_comparison_{stamp}")
    io.write_comparison_csv(comparison_table(preds), path)
    schema = ", ".join(["symbol string", "model string"] + [f"{c} double" for c in METRIC_COLS])
    return rounded(spark.read.schema(schema).option("header", True).csv(path))


@register("src_09_period_filter", O.with_bars(O.BARS_FLAG, body=f"""
SELECT symbol, date, {sql_round(['close'])} FROM bars WHERE date >= DATE '2001-11-04' - INTERVAL 180 DAY"""))
def src_09(spark, sf):
    return rounded(filter_period(fx.bars_flag(spark, sf), "6m", "2001-11-04").select("symbol", "date", "close"))


@register("src_10_standardise_columns", _BARS_SQL)
def src_10(spark, sf):
    b = fx.bars_flag(spark, sf)
    provider = b.select("symbol", F.col("date").alias("Date"), F.col("open").alias("Open"),
                        F.col("high").alias("High"), F.col("low").alias("Low"),
                        F.col("close").alias("Adj Close"), F.col("volume").alias("Volume"))
    return rounded(io.standardise_columns(provider))


# ---- set operations ------------------------------------------------------------------

@register("set_01_upsert_last_wins", O.with_bars(O.BARS_FLAG, O.BARS_ORDERDATE, body=f"""
SELECT symbol, date, {sql_round(['open', 'high', 'low', 'close', 'volume'])}, _batch FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY _batch DESC) AS rn FROM (
    SELECT *, 1 AS _batch FROM bars UNION ALL SELECT *, 2 AS _batch FROM bars2))
WHERE rn = 1"""))
def set_01(spark, sf):
    old = fx.bars_flag(spark, sf).withColumn("_batch", F.lit(1))
    new = fx.bars_flag_orderdate(spark, sf).withColumn("_batch", F.lit(2))
    return rounded(upsert_bars(old, new))


@register("set_02_next_missing_date", O.with_bars(O.BARS_FLAG, O.BARS_ORDERDATE, body="""
SELECT n.symbol, n.next_date, count(b2.date) AS n_new FROM
  (SELECT symbol, CAST(max(date) + INTERVAL 1 DAY AS DATE) AS next_date FROM bars GROUP BY symbol) n
  LEFT JOIN bars2 b2 ON b2.symbol = n.symbol AND b2.date >= n.next_date
GROUP BY n.symbol, n.next_date"""))
def set_02(spark, sf):
    stored = fx.bars_flag(spark, sf)
    nxt = next_missing_date(stored)
    new = incremental_rows(stored, fx.bars_flag_orderdate(spark, sf)).groupBy("symbol").agg(
        F.count("*").alias("n_new"))
    return (nxt.join(new, "symbol", "left")
            .select("symbol", "next_date", F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new")))


@register("set_03_dedupe_first", O.with_bars(O.BARS_FLAG, O.HEADLINES, body="""
SELECT symbol, headline, min(position) AS position FROM headlines GROUP BY symbol, headline"""))
def set_03(spark, sf):
    hl = fx.headlines(spark, sf).select("symbol", "headline", "position")
    return dedupe_first(hl, ["symbol", "headline"], "position")


@register("set_04_lookback_union", O.with_bars(O.BARS_FLAG, O.HEADLINES, body="""
SELECT b.symbol, b.date AS as_of, h.position, h.headline FROM (SELECT DISTINCT symbol, date FROM bars) b
JOIN headlines h ON h.symbol = b.symbol AND h.date BETWEEN b.date - INTERVAL 6 DAY AND b.date"""))
def set_04(spark, sf):
    out = lookback_union(fx.headlines(spark, sf), fx.bars_flag(spark, sf))
    return out.select("symbol", "as_of", "position", "headline")


@register("set_05_union_models", O.with_bars(O.BARS_FLAG, body="""
SELECT m.model, count(*) AS n_rows FROM (
  SELECT row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, count(*) OVER (PARTITION BY symbol) AS n
  FROM bars) b CROSS JOIN (VALUES ('persistence'), ('always_hold')) m(model)
WHERE rn >= 2 AND rn <= n - 1 GROUP BY m.model"""))
def set_05(spark, sf):
    preds = fx.predictions_persistence(fx.bars_flag(spark, sf))
    return preds.groupBy("model").agg(F.count("*").alias("n_rows"))


@register("top_05_headline_cap", O.with_bars(O.BARS_FLAG, O.HEADLINES, body="""
SELECT symbol, date, position, headline FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY position) AS rn FROM (
    SELECT symbol, date, headline, min(position) AS position FROM headlines GROUP BY symbol, date, headline))
WHERE rn <= 20"""))
def top_05(spark, sf):
    hl = fx.headlines(spark, sf).select("symbol", "date", "headline", "position")
    d = dedupe_first(hl, ["symbol", "date", "headline"], "position")
    return cap_per_group(d, ["symbol", "date"], "position", 20).select("symbol", "date", "position", "headline")


# ---- streaming (SET-01 inside foreachBatch) ----------------------------------------------------

STREAM_FILE_ROWS = 10_000


@register("set_01_stream_upsert", O.with_bars(O.BARS_FLAG, body=f"""
SELECT symbol, date, {sql_round(['open', 'high', 'low', 'close', 'volume'])} FROM bars"""))
def set_01_stream(spark, sf):
    """The lineitem table read as a stream (available-now trigger) of several files over at least four
    triggers; the merged bars equal the bars of the whole table."""
    import os
    from ..operators.bars import bar_states
    from ..streaming import run_bar_stream
    from .. sources.tables import table_path
    base = io.scratch_path(spark, "stream")
    staged = os.path.join(base, "source")
    ticks = spark.read.parquet(table_path(sf, "lineitem"))
    ticks.write.option("maxRecordsPerFile", STREAM_FILE_ROWS).parquet(staged)
    n_files = len(spark.read.parquet(staged).inputFiles())

    def to_states(batch):
        return bar_states(batch, F.concat("l_returnflag", "l_linestatus"), F.col("l_shipdate"),
                          100.0 + F.col("l_extendedprice") / fx.PRICE_DIVISOR, F.col("l_quantity"),
                          [F.col(c) for c in fx.TIEBREAK])
    out = run_bar_stream(spark, staged, ticks.schema, to_states, os.path.join(base, "bars"),
                         os.path.join(base, "ckpt"), max_files_per_trigger=max(1, n_files // 4))
    return rounded(out)
