"""Dedupe, lookback unions and caps over headline tables (SET-03/04, TOP-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT


def dedupe_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SET-03: order-preserving dedupe, the first occurrence (smallest ``order``) wins.

    Expressed as ``min_by`` over the key, a plain aggregation that combines
    partially before the shuffle, so a key repeated millions of times costs one
    row per task, not one group in one task."""
    others = [c for c in df.columns if c not in keys]
    rec = F.min(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in others if c != order]))
    out = df.groupBy(*keys).agg(rec.alias("_r"))
    return out.select(*keys, F.col("_r._o").alias(order),
                      *[F.col(f"_r.{c}").alias(c) for c in others if c != order])


def lookback_union(headlines: DataFrame, days: DataFrame, lookback: int = DEFAULT.news_lookback_days) -> DataFrame:
    """SET-04: for each (symbol, day) in ``days``, the headlines dated day-(lookback-1)..day.

    The days are fanned out, not the headlines: a (symbol, date) gets the list of the at most ``lookback`` days
    it serves, and a headline meets it in one equi-join on (symbol, date) and is repeated after it. So a
    text moves at most once."""
    dates = F.explode(F.sequence(F.date_sub("as_of", lookback - 1), F.col("as_of"))).alias("date")
    served = days.select("symbol", F.col("date").alias("as_of")).distinct().select("symbol", "as_of", dates) \
        .groupBy("symbol", "date").agg(F.collect_list("as_of").alias("as_of"))
    others = [c for c in headlines.columns if c != "symbol"]
    return headlines.join(served, ["symbol", "date"]).select("symbol", F.explode("as_of").alias("as_of"), *others)


def cap_per_group(df: DataFrame, keys: list[str], order: str, n: int = DEFAULT.max_headlines_per_stock) -> DataFrame:
    """TOP-05: keep the first n rows per group in ``order`` (a cap that is the feature)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
