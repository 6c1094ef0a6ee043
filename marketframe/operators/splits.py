"""Chronological splits, expanding time-series folds, fold-wise scaling and
sequence windows. All per symbol, with no shuffling of time order and no look-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from .windows import SYMBOL, DATE


def with_positions(df: DataFrame, by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """Adds ``_i`` (0-based position) and ``_n`` (series length)."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumns({"_i": F.row_number().over(w) - 1,
                           "_n": F.count(F.lit(1)).over(Window.partitionBy(by))})


def chrono_split(df: DataFrame, test_size: float = DEFAULT.test_size, by: str = SYMBOL,
                 order: str = DATE) -> DataFrame:
    """SPL-01: rows before int(n * (1 - test_size)) are 'train', the rest 'test'."""
    x = with_positions(df, by, order)
    cut = F.floor(F.col("_n") * (1.0 - test_size))
    return x.withColumn("split", F.when(F.col("_i") < cut, "train").otherwise("test")).drop("_n")


def inner_split(df: DataFrame, val_size: float = DEFAULT.test_size, by: str = SYMBOL,
                order: str = DATE) -> DataFrame:
    """SPL-02: on top of SPL-01, the last ``val_size`` of the train rows become 'val'."""
    x = chrono_split(df, val_size, by, order)
    n_tr = F.count(F.when(F.col("split") == "train", 1)).over(Window.partitionBy(by))
    cut = F.floor(n_tr * (1.0 - val_size))
    return x.withColumn("inner", F.when(F.col("split") != "train", None)
                        .when(F.col("_i") < cut, "fit").otherwise("val"))


def fold_expr(i: Column, n: Column, k: int = DEFAULT.cv_folds) -> Column:
    """SPL-03 fold of position i in a series of n rows: expanding splits with test
    blocks of n // (k+1) rows; rows before the first test block are fold -1."""
    ts = F.floor(n / (k + 1))
    first = n - k * ts
    return F.when(i < first, F.lit(-1)).otherwise(F.floor((i - first) / ts)).cast("int")


def time_series_folds(train: DataFrame, k: int = DEFAULT.cv_folds, by: str = SYMBOL,
                      order: str = DATE) -> DataFrame:
    """SPL-03 over the train rows of each symbol: fold j tests block j and trains on
    every earlier row (``fold < j``)."""
    x = with_positions(train.drop("_i", "_n"), by, order)
    return x.withColumn("fold", fold_expr(F.col("_i"), F.col("_n"), k)).drop("_n")


def fold_training_rows(folded: DataFrame, k: int = DEFAULT.cv_folds) -> DataFrame:
    """Each row once per fold it trains (folds j > its own fold): a fan-out of at
    most k, so per-fold statistics are plain grouped aggregations."""
    j = F.explode(F.sequence(F.greatest(F.col("fold") + 1, F.lit(0)), F.lit(k - 1)))
    return folded.where(F.col("fold") < k - 1).select("*", j.alias("train_fold"))


def zscore_stats(train: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Mean and population std per group of the training rows; a std of zero becomes 1."""
    std = lambda c: F.stddev_pop(c)
    return train.groupBy(*by).agg(*[x for c in cols for x in (
        F.avg(c).alias(f"{c}__mean"), F.when(std(c) == 0, 1.0).otherwise(std(c)).alias(f"{c}__std"))])


def zscore(df: DataFrame, stats: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Every row z-scored with its group's statistics; rows of groups without training rows go."""
    return df.join(stats, by).select(
        *[c for c in df.columns if c not in cols],
        *[((F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std")).alias(c) for c in cols])


def fold_scaler(folded: DataFrame, cols: list[str], k: int = DEFAULT.cv_folds, by: str = SYMBOL) -> DataFrame:
    """SCL-01 fit: per (symbol, fold) mean and population std over that fold's
    training rows; a zero std becomes 1."""
    tr = fold_training_rows(folded, k)
    return zscore_stats(tr, cols, [by, "train_fold"]).withColumnRenamed("train_fold", "fold")


def apply_fold_scaler(folded: DataFrame, stats: DataFrame, cols: list[str], by: str = SYMBOL) -> DataFrame:
    """SCL-01 transform: z-score each fold's test rows with that fold's train statistics.
    The stats table has one row per (symbol, fold), joined on both keys."""
    return zscore(folded.where(F.col("fold") >= 0), stats, cols, [by, "fold"])


def sequences(df: DataFrame, cols: list[str], length: int = DEFAULT.sequence_length,
              by: str | list[str] = SYMBOL, order: str = DATE) -> DataFrame:
    """SEQ-01: row t gets the feature rows t-length .. t-1 (t itself excluded) as a
    bounded list of arrays; the first ``length`` rows get null (uniform fallback)."""
    w = Window.partitionBy(by).orderBy(order)
    vec = F.array(*[F.col(c).cast("double") for c in cols])
    x = df.withColumn("_vec", vec)
    lst = F.collect_list("_vec").over(w.rowsBetween(-length, -1))
    i = F.row_number().over(w) - 1
    return x.withColumn("sequence", F.when(i >= length, lst)).drop("_vec")


def spread(df: DataFrame, by: str = SYMBOL, order: str = DATE) -> DataFrame:
    """Deals rows with sequences evenly: they are ``length`` times as wide as the rows they were built from
    and lie by symbol, which a fit need not keep."""
    return df.repartition(by, order)
