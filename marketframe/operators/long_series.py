"""The indicator table over series too long for one task.

``compute_indicators`` keeps a series in one task. Here a series is cut into chunks of ``chunk_rows``
rows, and every window is partitioned by ``(symbol, chunk)``, so that one series uses all cores:

* positions without a window over a whole series: rows are numbered inside calendar buckets, and each
  bucket's first position is a running sum over the buckets' counts;
* halo rows: a chunk carries copies of the last HALO rows before it, so that bounded frames (lags,
  moving means, rolling extrema, lists) find all their rows. They are dropped at the end;
* carries: running sums and exponentially weighted sums start at zero in every chunk. Their values at
  the chunks' ends, one row per chunk, are composed over the series,
  carry(c) = end(c - 1) + r^rows(c - 1) * carry(c - 1), and N(t) = local(t) + r^(k + 1) * carry(c) for
  the k-th row of the chunk (r = 1 for counts and running sums). Nothing is truncated.

The expressions are those of ``indicators`` and ``ewm``, over another partitioning. Order values and
symbols must not be null, and closes must have no gaps (bars have none); an empty table gives an empty
result. Three intermediate tables are cut with reliable checkpoints, as each carry needs the local sums twice.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ewm import Ewm, Sum, ewm_batch, ewm_sums
from .indicators import (FEATURE_COLUMNS, SIGNED_VOLUME, base_columns, feature_columns_of, first_ewms, indicator_exprs,
                         macd_and_dx, second_base, second_ewms)
from .windows import DATE, IDX, SYMBOL

CHUNK_ROWS = 65_536
HALO = 256              # rows of the longest bounded frame (200, and chains of shorter ones), rounded up
CHUNK, PLACE, IS_HALO = "_chunk", "_k", "_halo"


def with_positions_by_bucket(bars: DataFrame, bucket: Column, by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """Adds ``_i``, the 0-based position in the series. ``bucket`` must not fall along ``order``; a
    task holds one bucket of one series."""
    inside = Window.partitionBy(by, "_bucket").orderBy(order)
    rows = cut_lineage(bars.withColumn("_bucket", bucket).withColumn("_in", F.row_number().over(inside) - 1))
    counts = rows.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return rows.join(first, [by, "_bucket"]).withColumn(IDX, F.col("_first") + F.col("_in")) \
        .select(*bars.columns, IDX)


def with_chunks(indexed: DataFrame, chunk_rows: int = CHUNK_ROWS, by: str = SYMBOL) -> DataFrame:
    """Deals rows to chunks: adds the chunk, the place in it (negative for halo rows) and the halo mark."""
    if chunk_rows < HALO:
        raise ValueError(f"chunk_rows must be {HALO} or more")
    own = F.floor(F.col(IDX) / chunk_rows).cast("long")
    near_end = F.col(IDX) % chunk_rows >= chunk_rows - HALO
    chunks = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return indexed.select("*", F.explode(chunks).alias(CHUNK)) \
        .withColumn(PLACE, F.col(IDX) - F.col(CHUNK) * chunk_rows) \
        .withColumn(IS_HALO, F.col(PLACE) < 0).repartition(by, CHUNK)


def carries(df: DataFrame, decays: dict[str, float], by: str = SYMBOL) -> DataFrame:
    """(by, chunk, ``_carry<column>``...): what comes into each chunk, composed over the chunks' ends."""
    names = list(decays)
    ends = df.where(f"NOT {IS_HALO}").groupBy(by, CHUNK).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.max_by(F.col(n).cast("double"), PLACE).alias(n) for n in names])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        out = pdf[[by, CHUNK]].copy()
        for n in names:
            carry, into = 0.0, []
            for end, rows in zip(pdf[n].fillna(0.0), pdf["_rows"]):
                into.append(carry)
                carry = end + decays[n] ** rows * carry
            out["_carry" + n] = into
        return out

    key = ends.select(by, CHUNK).schema.simpleString()[len("struct<"):-1]
    return ends.groupBy(by).applyInPandas(compose, f"{key}, " + ", ".join(f"`_carry{n}` double" for n in names))


def _without(df: DataFrame, gone: set[str]) -> list[str]:
    return [f"`{c}`" for c in df.columns if c not in gone]


def running_sums(df: DataFrame, sums: dict[str, str], by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """Adds running sums over the whole series: column -> SQL expression (null counts as 0)."""
    run = f"PARTITION BY {by}, {CHUNK} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    local = df.selectExpr("*", *[f"sum(CASE WHEN {IS_HALO} THEN 0D ELSE coalesce({x}, 0D) END) OVER ({run}) AS {n}"
                                 for n, x in sums.items()])
    into = carries(local, dict.fromkeys(sums, 1.0), by)
    return local.join(into, [by, CHUNK]).selectExpr(*_without(local, set(sums)), *[f"{n} + _carry{n} AS {n}" for n in sums])


def chunked_ewm_columns(df: DataFrame, series: list[Ewm], also: dict[str, str] | None = None, by: str = SYMBOL,
                        order: str = DATE) -> DataFrame:
    """``ewm_columns`` over chunks; ``also`` names running sums that ride along with the counts."""
    key = f"{by}, {CHUNK}"
    batch = ewm_batch(series, key, order)
    seen = {name: f"CASE WHEN {test} THEN 1D ELSE 0D END" for test, name in batch.seen.items()}
    df = running_sums(df, seen | (also or {}), by, order)
    own = [Sum(s.name, f"CASE WHEN NOT {IS_HALO} THEN {s.y} END", s.alpha) for s in batch.sums]
    local = cut_lineage(ewm_sums(df.selectExpr("*", *batch.seeds), own, key, order, PLACE))
    into = carries(local, {s.name: 1.0 - s.alpha for s in own}, by)
    whole = local.join(into, [by, CHUNK]).selectExpr(
        *_without(local, {s.name for s in own}),
        *[f"{s.name} + power({1.0 - s.alpha!r}D, {PLACE} + 1) * _carry{s.name} AS {s.name}" for s in own])
    return whole.selectExpr(*_without(whole, batch.helpers), *batch.outs)


def compute_indicators_chunked(bars: DataFrame, chunk_rows: int = CHUNK_ROWS, bucket: Column | None = None,
                               by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """The result of ``indicators.compute_indicators`` with chunks in place of whole series. ``bucket``
    numbers rows in parallel; by default the calendar month of ``order``."""
    key = f"{by}, {CHUNK}"
    bucket = F.trunc(order, "MM") if bucket is None else bucket
    df = base_columns(with_chunks(with_positions_by_bucket(bars, bucket, by, order), chunk_rows, by), key, order)
    totals = {"_obv": SIGNED_VOLUME, "_pv": "close * volume", "_vol": "volume"}
    df = macd_and_dx(chunked_ewm_columns(df, first_ewms(), totals, by, order))
    df = second_base(chunked_ewm_columns(df, second_ewms(), None, by, order).drop("_dx"), key, order)
    exprs = indicator_exprs(key, order) | {"obv": "_obv", "vwap": "try_divide(_pv, _vol)"}
    kept = bars.columns + [IDX]
    return feature_columns_of(df, kept + [CHUNK, IS_HALO], exprs, key, order).where(f"NOT {IS_HALO}") \
        .select(*kept, *FEATURE_COLUMNS)
