"""Assembly of the processed feature table (60 indicators + 4 sentiment + label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..config import DEFAULT, NEUTRAL_SENTIMENT, SENTIMENT_FEATURES, Config
from ..session import arrow_map
from .indicators import FEATURE_COLUMNS, INT_FEATURES, compute_indicators
from .labels import with_labels
from .quality import keep_valid
from .series_arrays import CALENDAR, CORE_COLUMNS, PRICES, SERIES_ROWS, processed_batches
from .windows import IDX, SYMBOL, DATE, by_series, running, series

PROCESSED_COLUMNS = FEATURE_COLUMNS + SENTIMENT_FEATURES + ["label"]


def merge_sentiment(df: DataFrame, sentiment: DataFrame | None, by: str = SYMBOL,
                    order: str = DATE) -> DataFrame:
    """JOIN-01: align daily sentiment to the bar dates (left join); missing -> neutral.
    A missing table, or a missing column, becomes the neutral constant."""
    if sentiment is None:
        return df.withColumns({k: F.lit(v).cast("double") for k, v in NEUTRAL_SENTIMENT.items()})
    present = [c for c in SENTIMENT_FEATURES if c in sentiment.columns]
    sent = sentiment.select(by, order, *[F.col(c).cast("double").alias(c) for c in present])
    out = df.join(sent, [by, order], "left")
    return out.withColumns({
        k: (F.coalesce(F.col(k), F.lit(v)) if k in present else F.lit(v)).cast("double")
        for k, v in NEUTRAL_SENTIMENT.items()
    })


def drop_last_row(df: DataFrame, close: str = "close", by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """PRJ-02: the last row of each series has no forward return."""
    nxt = "_next_close"
    return (df.withColumn(nxt, F.lead(close, 1).over(series(by, order)))
            .where(F.col(nxt).isNotNull()).drop(nxt))


def drop_warmup(df: DataFrame, cols: list[str] = CORE_COLUMNS) -> DataFrame:
    """PRJ-03: drop a row when ANY of the core indicators is null."""
    present = [c for c in cols if c in df.columns]
    return df.dropna(how="any", subset=present) if present else df


def clean_fill(df: DataFrame, cols: list[str], by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """PRJ-04: +-inf and NaN -> null, forward-fill within the series, then 0.0."""
    w = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    todo = set(cols)
    exprs = []
    for c in df.columns:
        if c not in todo:
            exprs.append(f"`{c}`")
        elif c in INT_FEATURES or c == "label":
            exprs.append(f"CAST(coalesce(last({c}, true) {w}, 0) AS INT) AS {c}")
        else:
            clean = (f"CASE WHEN isnan({c}) OR {c} IN (double('inf'), double('-inf')) "
                     f"THEN NULL ELSE {c} END")
            exprs.append(f"CAST(coalesce(last({clean}, true) {w}, 0D) AS DOUBLE) AS {c}")
    return df.selectExpr(*exprs)


def feature_columns(df: DataFrame) -> list[str]:
    """PRJ-01: every column except the label (and the keys)."""
    return [c for c in df.columns if c not in ("label", SYMBOL, DATE)]


def engineer_features(bars: DataFrame, sentiment: DataFrame | None = None,
                      cfg: Config = DEFAULT, by: str = SYMBOL, order: str = DATE,
                      keep_index: bool = False, lengths: DataFrame | None = None) -> DataFrame:
    """Bars -> processed feature table: indicators, sentiment, label, last-row and
    warm-up drop, inf/forward-fill/zero clean-up. One exchange on ``symbol``, after which each task
    computes whole series as arrays (``series_arrays``); the rows of a series leave together, in order.
    Where a series has more than SERIES_ROWS bars, the same as window expressions. ``lengths`` (``by``, count): a
    bound of each series' bars that is cheaper than counting them."""
    size = (bars.groupBy(by).count() if lengths is None else lengths).agg(F.max("count"), F.sum("count")).first()
    if (size[0] or 0) > SERIES_ROWS:
        return features_by_windows(bars, sentiment, cfg, by, order, keep_index)
    df = bars if sentiment is None else merge_sentiment(bars, sentiment, by, order)
    kept = [by, order] + (SENTIMENT_FEATURES if sentiment is not None else [])
    out = [by, order] + ([IDX] if keep_index else []) + PROCESSED_COLUMNS
    calendar = [f"weekday({order})", f"month({order})", f"quarter({order})", f"CAST(to_date({order}) = last_day({order}) AS INT)"]
    narrow = by_series(df, by, total=size[1] or 0).sortWithinPartitions(by, order).selectExpr(
        *kept, *[f"CAST({c} AS DOUBLE) AS {c}" for c in PRICES], *[f"CAST({e} AS DOUBLE) AS {c}" for e, c in zip(calendar, CALENDAR)])
    whole = {*INT_FEATURES, "label", IDX}
    schema = StructType([narrow.schema[c] if c in kept else StructField(c, IntegerType() if c in whole else DoubleType()) for c in out])
    return arrow_map(narrow, processed_batches(by, kept, out, cfg.labels), schema)


def features_by_windows(bars: DataFrame, sentiment: DataFrame | None = None, cfg: Config = DEFAULT, by: str = SYMBOL,
                        order: str = DATE, keep_index: bool = False) -> DataFrame:
    """``engineer_features`` for series of any length: one lazy plan, one exchange on ``symbol`` for all windows
    (sentiment is joined on the bars' (symbol, date) partitioning before the windows)."""
    df = merge_sentiment(bars, sentiment, by, order)
    df = compute_indicators(df, by, order)
    df = with_labels(df, "close", by, order, cfg.labels)
    df = df.where(F.col("fwd_return").isNotNull())
    df = drop_warmup(df)
    df = clean_fill(df, FEATURE_COLUMNS, by, order)
    cols = [by, order] + ([IDX] if keep_index else []) + PROCESSED_COLUMNS
    return df.select(*cols)


def gated_features(bars: DataFrame, sentiment: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """The processed table of the symbols that pass every raw rule (DQ-08); the others are left out."""
    return engineer_features(keep_valid(bars, cfg.min_raw_rows), sentiment, cfg)


def align_close(processed: DataFrame, raw: DataFrame, by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """JOIN-02: raw close re-aligned to the processed dates, then forward-filled."""
    closes = raw.select(by, order, F.col("close").alias("raw_close"))
    out = processed.join(closes, [by, order], "left")
    return out.withColumn("close", F.last("raw_close", ignorenulls=True).over(running(by, order))).drop("raw_close")


def candle_rows(df: DataFrame) -> DataFrame:
    """PRJ-05: drop bars with a null date or price."""
    return df.dropna(subset=["date", "open", "high", "low", "close"])
