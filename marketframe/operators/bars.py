"""Bar construction, period filters and incremental upserts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import SYMBOL, DATE


def bars_from_ticks(ticks: DataFrame, symbol: Column, ts: Column, price: Column,
                    qty: Column | None, tiebreak: list[Column], bucket: str = "day") -> DataFrame:
    """SRC-08: aggregate a tick/transaction table to OHLCV bars.

    open/close are the prices at the smallest/largest tie-break key inside the
    bucket, so the result does not depend on row order. ``min_by``/``max_by``,
    ``min``, ``max`` and ``sum`` all aggregate partially before the shuffle, so a
    hot symbol is reduced map-side and only one row per (symbol, bucket, task)
    crosses the network.
    """
    key = F.struct(*tiebreak)
    when = F.to_date(ts) if bucket == "day" else F.date_trunc(bucket, ts)
    volume = F.sum(qty) if qty is not None else F.count(F.lit(1))
    return (ticks.groupBy(symbol.alias(SYMBOL), when.alias(DATE))
            .agg(F.min_by(price, key).alias("open"),
                 F.max(price).alias("high"),
                 F.min(price).alias("low"),
                 F.max_by(price, key).alias("close"),
                 volume.cast("double").alias("volume")))


def most_bars(ticks: DataFrame, symbol: Column, ts: Column) -> DataFrame:
    """(symbol, count): no symbol has more daily bars than ticks, or than days from its first to its last one and a null
    day. One small aggregation, where counting the bars would group all ticks by day."""
    day = F.to_date(ts)
    days = F.coalesce(F.datediff(F.max(day), F.min(day)) + 1, F.lit(0)) + F.max(day.isNull().cast("int"))
    return ticks.groupBy(symbol.alias(SYMBOL)).agg(F.least(F.count("*"), days.cast("long")).alias("count"))


def bar_states(ticks: DataFrame, symbol: Column, ts: Column, price: Column, qty: Column | None,
               tiebreak: list[Column], bucket: str = "day") -> DataFrame:
    """Bars that can be merged later: next to OHLCV, the tie-break keys of the first and the last tick."""
    key = F.struct(*tiebreak)
    when = F.to_date(ts) if bucket == "day" else F.date_trunc(bucket, ts)
    volume = F.sum(qty) if qty is not None else F.count(F.lit(1))
    return (ticks.groupBy(symbol.alias(SYMBOL), when.alias(DATE))
            .agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"),
                 F.min_by(price, key).alias("open"), F.max(price).alias("high"),
                 F.min(price).alias("low"), F.max_by(price, key).alias("close"),
                 volume.cast("double").alias("volume")))


def merge_bar_states(states: DataFrame, by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """One state per (symbol, date) out of any number of partial ones, in any order. The result equals
    the state of all their ticks together, as long as no tick is in two of them."""
    return states.groupBy(by, order).agg(
        F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"),
        F.min_by("open", "first_key").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "last_key").alias("close"),
        F.sum("volume").alias("volume"))


# Period units in days (unknown unit -> five years).
PERIOD_DAYS = {"y": 365, "m": 30, "d": 1}
DEFAULT_PERIOD_DAYS = 365 * 5


def period_days(period: str) -> int:
    """SRC-09: '5y' -> 1825, '6m' -> 180, '10d' -> 10; anything else -> 1825."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z])\s*", period or "")
    if not m or m.group(2).lower() not in PERIOD_DAYS:
        return DEFAULT_PERIOD_DAYS
    return int(m.group(1)) * PERIOD_DAYS[m.group(2).lower()]


def filter_period(bars: DataFrame, period: str, as_of: Column | str, order: str = DATE) -> DataFrame:
    """SRC-09: keep bars on or after as_of minus the period (as_of is a parameter)."""
    as_of_col = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return bars.where(F.col(order) >= F.date_sub(as_of_col, period_days(period)))


def upsert_bars(old: DataFrame, new: DataFrame, by: str = SYMBOL, order: str = DATE,
                batch_col: str = "_batch") -> DataFrame:
    """SET-01: old union new, the LAST batch wins per (symbol, date).

    Bars carry a batch ordinal; the row with the highest ordinal per key is kept.
    ``max_by`` over the key is a plain aggregation (partial before the shuffle),
    no window and no sort."""
    cols = [c for c in old.columns if c not in (by, order, batch_col)]
    both = old.unionByName(new, allowMissingColumns=True)
    rec = F.struct(F.col(batch_col).alias("_o"), *[F.col(c) for c in cols])
    return (both.groupBy(by, order).agg(F.max(rec).alias("_r"))
            .select(by, order, *[F.col("_r")[c].alias(c) for c in cols], F.col("_r._o").alias(batch_col)))


def next_missing_date(bars: DataFrame, by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """SET-02: per symbol, the day after the last stored date."""
    return bars.groupBy(by).agg(F.date_add(F.max(order), 1).alias("next_date"))


def incremental_rows(bars: DataFrame, incoming: DataFrame, by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """SET-02 as a filter: incoming rows strictly after the symbol's last stored date
    (symbols never seen are kept whole)."""
    nxt = next_missing_date(bars, by, order)
    return (incoming.join(nxt, by, "left")
            .where(F.col("next_date").isNull() | (F.col(order) >= F.col("next_date")))
            .drop("next_date"))
