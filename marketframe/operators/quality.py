"""Data-quality rules as one aggregation per table (rule table per symbol).

Each rule is a conditional count, so a whole rule set is one ``groupBy(symbol)``
with partial aggregation before the shuffle, whatever the skew of a symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, SENTIMENT_FEATURES
from .windows import SYMBOL, DATE

# Raw bar rules (violation conditions).
RAW_RULES = {
    "open_not_null": "open IS NULL",
    "high_not_null": "high IS NULL",
    "low_not_null": "low IS NULL",
    "close_not_null": "close IS NULL",
    "volume_not_null": "volume IS NULL",
    "open_gt_0": "open <= 0",
    "high_gt_0": "high <= 0",
    "low_gt_0": "low <= 0",
    "close_gt_0": "close <= 0",
    "volume_ge_0": "volume < 0",
}
OHLC_RULES = {
    "high_ge_low": "high < low",
    "high_ge_open": "high < open",
    "high_ge_close": "high < close",
}

# Processed-table feature groups; each needs at least one column present.
REQUIRED_FEATURE_GROUPS = {
    "returns": ["log_return_1d", "log_return_5d", "log_return_20d"],
    "moving_avg": ["sma_20", "ema_20", "price_sma200_ratio"],
    "momentum": ["rsi_14", "macd", "stoch_k"],
    "volatility": ["bb_width", "atr_14"],
    "volume": ["obv", "mfi_14"],
    "sentiment": ["sentiment_score", "sentiment_confidence", "news_count_7d", "sentiment_trend_3d"],
    "label": ["label"],
}


def _violations(rules: dict[str, str]) -> list:
    return [F.sum(F.when(F.expr(cond), 1).otherwise(0)).cast("long").alias(name) for name, cond in rules.items()]


def raw_rule_table(bars: DataFrame, by: str = SYMBOL) -> DataFrame:
    """DQ-01 + DQ-05: per-symbol violation counts of the range and OHLC rules."""
    return bars.groupBy(by).agg(F.count("*").alias("n_rows"), *_violations({**RAW_RULES, **OHLC_RULES}))


def row_count_rule(bars: DataFrame, min_rows: int = DEFAULT.min_raw_rows, by: str = SYMBOL) -> DataFrame:
    """DQ-02: at least ``min_rows`` rows per symbol."""
    return bars.groupBy(by).agg(F.count("*").alias("n_rows")).withColumn(
        "passed", F.col("n_rows") >= min_rows)


def order_violations(df: DataFrame, by: str, arrival: str, ts: str, bucket_rows: int = 100_000) -> DataFrame:
    """DQ-03: count adjacent pairs (in arrival order per symbol) whose timestamp decreases.

    Exact and skew-proof: arrival order is cut into buckets of ``bucket_rows``
    ids; pairs inside a bucket are checked with a window over (symbol, bucket);
    pairs that straddle buckets are checked on a small table of each bucket's
    first and last timestamp, ordered by bucket."""
    bkt = F.floor(F.col(arrival) / bucket_rows)
    x = df.select(F.col(by).alias("symbol"), F.col(arrival).alias("_a"), F.col(ts).alias("_t"), bkt.alias("_b"))
    w_in = Window.partitionBy("symbol", "_b").orderBy("_a")
    inner = (x.withColumn("_prev", F.lag("_t").over(w_in))
             .groupBy("symbol").agg(F.sum(F.when(F.col("_prev") > F.col("_t"), 1).otherwise(0)).alias("_n")))
    ends = x.groupBy("symbol", "_b").agg(F.min_by("_t", "_a").alias("_first"), F.max_by("_t", "_a").alias("_last"))
    w_b = Window.partitionBy("symbol").orderBy("_b")
    edges = (ends.withColumn("_prev_last", F.lag("_last").over(w_b))
             .groupBy("symbol").agg(F.sum(F.when(F.col("_prev_last") > F.col("_first"), 1).otherwise(0)).alias("_e")))
    return (inner.join(edges, "symbol", "full")
            .select("symbol", (F.coalesce("_n", F.lit(0)) + F.coalesce("_e", F.lit(0))).cast("long").alias("order_violations")))


def duplicate_dates(bars: DataFrame, by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """DQ-04: (symbol, date) keys that occur more than once."""
    return bars.groupBy(by, order).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def feature_groups_present(processed: DataFrame, by: str = SYMBOL) -> DataFrame:
    """DQ-06: per symbol and required group, whether any of its columns exists."""
    cols = set(processed.columns)
    flags = [F.struct(F.lit(g).alias("feature_group"), F.lit(any(c in cols for c in members)).alias("present"))
             for g, members in REQUIRED_FEATURE_GROUPS.items()]
    syms = processed.select(by).distinct()
    return syms.select(by, F.explode(F.array(*flags)).alias("_g")).select(by, "_g.feature_group", "_g.present")


def processed_rule_table(processed: DataFrame, min_rows: int = DEFAULT.min_processed_rows,
                         by: str = SYMBOL) -> DataFrame:
    """DQ-07: label in 0..4 and not null, sentiment columns not null, >= min_rows rows."""
    rules = {"label_not_null": "label IS NULL", "label_in_range": "label NOT IN (0, 1, 2, 3, 4)"}
    rules.update({f"{c}_not_null": f"{c} IS NULL" for c in SENTIMENT_FEATURES if c in processed.columns})
    t = processed.groupBy(by).agg(F.count("*").alias("n_rows"), *_violations(rules))
    ok = F.col("n_rows") >= min_rows
    for r in rules:
        ok = ok & (F.col(r) == 0)
    return t.withColumn("passed", ok)


def passing_symbols(bars: DataFrame, min_rows: int = DEFAULT.min_raw_rows, by: str = SYMBOL) -> DataFrame:
    """Symbols that pass every raw rule (DQ-01, DQ-02, DQ-05)."""
    t = raw_rule_table(bars, by)
    ok = F.col("n_rows") >= min_rows
    for r in list(RAW_RULES) + list(OHLC_RULES):
        ok = ok & (F.col(r) == 0)
    return t.where(ok).select(by)


def keep_valid(bars: DataFrame, min_rows: int = DEFAULT.min_raw_rows, by: str = SYMBOL) -> DataFrame:
    """DQ-08: fail-soft filter: drop symbols that fail, keep the others (semi join)."""
    return bars.join(passing_symbols(bars, min_rows, by), by, "left_semi")


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """DQ-09: try_cast columns to declared types; what cannot be cast becomes null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS {t})") for c, t in types.items()})


def coercion_report(df: DataFrame, types: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """DQ-09: per group, the rows and how many values of each column ``coerce`` turns into null."""
    both = coerce(df.withColumns({f"_old_{c}": F.col(c) for c in types}), types)
    return both.groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), *[
        F.count(F.when(F.col(f"_old_{c}").isNotNull() & F.col(c).isNull(), 1)).alias(f"{c}_newly_null") for c in types])
