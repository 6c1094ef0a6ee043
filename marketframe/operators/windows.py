"""Shared window specifications and guarded rolling helpers.

Every ordered computation in the engine runs over one spec,
``partitionBy(symbol).orderBy(date)``: Catalyst merges window expressions that
share partitioning and ordering into one Window operator, so the whole indicator
table needs one exchange on ``symbol`` and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SYMBOL = "symbol"
DATE = "date"
IDX = "_i"


def series(by: str = SYMBOL, order: str = DATE) -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def trailing(n: int, by: str = SYMBOL, order: str = DATE) -> WindowSpec:
    """The last n rows up to and including the current row."""
    return series(by, order).rowsBetween(-(n - 1), 0)


def running(by: str = SYMBOL, order: str = DATE) -> WindowSpec:
    return series(by, order).rowsBetween(Window.unboundedPreceding, 0)


def row_index(by: str = SYMBOL, order: str = DATE) -> Column:
    """0-based position of a row inside its series."""
    return F.row_number().over(series(by, order)) - 1


def rolled(x: Column | str, n: int, agg=F.avg, by: str = SYMBOL, order: str = DATE) -> Column:
    """Rolling aggregate that is null until n non-null values are in the frame."""
    x = F.col(x) if isinstance(x, str) else x
    w = trailing(n, by, order)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


ROWS_PER_PARTITION = 100_000     # bars of a task: its rows grow about 20 times wider in the windows


def by_series(df, by: str = SYMBOL, rows: int = ROWS_PER_PARTITION, total: int | None = None):
    """Hash-partition by the series key: the one exchange every series window needs.

    The number of partitions follows the rows, so that a task's rows do not grow with the table (adaptive
    execution merges by the size of the narrow bars, up to ``spark.sql.shuffle.partitions``). Tables of few
    rows for each core keep the session's number. ``total`` is the count where it is known."""
    n = -(-(df.count() if total is None else total) // rows)
    return df.repartition(by) if n <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(n, by)


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation that is null (not an error) when either side is constant."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def div(a: Column, b: Column) -> Column:
    """Division that yields null for a zero or null divisor."""
    return F.try_divide(a, b)
