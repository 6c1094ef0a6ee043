"""Five-class signal labels from forward or forecast returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, LabelThresholds
from .windows import SYMBOL, DATE, series


def forward_return(close: str = "close", by: str = SYMBOL, order: str = DATE) -> Column:
    """Next row's close over this close, minus one (null on the last row and after a zero close)."""
    return F.try_divide(F.lead(close, 1).over(series(by, order)), F.col(close)) - 1.0


def label_class(ret: Column, t: LabelThresholds = DEFAULT.labels) -> Column:
    """Training label: strong moves strictly beyond +-2 %, buy/sell strictly beyond
    +-0.5 %; exact lower edges fall in the milder class; null return -> hold (2)."""
    return (F.when(ret > t.strong_buy, 4)
            .when(ret > t.buy, 3)
            .when(ret < t.strong_sell, 0)
            .when(ret < t.sell, 1)
            .otherwise(2).cast("int"))


def forecast_class(ret: Column, t: LabelThresholds = DEFAULT.labels) -> Column:
    """Forecast label: a strict '>' at every edge, so exactly -0.5 % -> 1 and
    exactly -2 % -> 0 (differs from ``label_class`` at the two lower edges)."""
    return (F.when(ret > t.strong_buy, 4)
            .when(ret > t.buy, 3)
            .when(ret > t.sell, 2)
            .when(ret > t.strong_sell, 1)
            .otherwise(0).cast("int"))


def with_labels(df: DataFrame, close: str = "close", by: str = SYMBOL, order: str = DATE,
                t: LabelThresholds = DEFAULT.labels) -> DataFrame:
    """LBL-01: add ``fwd_return`` and ``label``."""
    fwd = forward_return(close, by, order)
    return df.withColumn("fwd_return", fwd).withColumn("label", label_class(F.col("fwd_return"), t))
