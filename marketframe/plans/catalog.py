"""Registered queries: one Spark plan per operator row, each with its SQL oracle
when SQL can express it. Keys are the lower-cased operator id plus a slug.

Every query reads the driver's base tables (lineitem, documents, labels, events)
through the fixture adapters, so its work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..session import arrow_map

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    key: str
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[key] = Query(key, fn, sql)
        return fn
    return deco


WIDE = 30             # floating columns from which a table is rounded as arrays


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Spark's ``round``: the shortest decimals of x, halves away from zero. Products that are too near to a half, or too
    large, to tell by themselves go through decimals."""
    scaled = x * 10.0**digits
    near = np.rint(scaled)
    out = near / 10.0**digits
    unsure = np.isfinite(x) & ((np.abs(np.abs(scaled - near) - 0.5) <= 2 * np.spacing(np.abs(scaled))) | (np.abs(scaled) >= 1e15))
    if unsure.any():
        exact, unit = Context(prec=400, rounding=ROUND_HALF_UP), Decimal(1).scaleb(-digits)
        out[unsure] = [float(Decimal(repr(float(v))).quantize(unit, context=exact)) for v in x[unsure]]
    return np.where(np.isinf(x), x, out)


def _rounded_arrays(df: DataFrame, names: set[str], digits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            with np.errstate(all="ignore"):
                yield pa.RecordBatch.from_arrays([
                    pa.array(half_up(c.to_numpy(zero_copy_only=False).astype(float), digits) + 0.0, pa.float64(), mask=np.asarray(c.is_null()))
                    if n in names else c for n, c in zip(x.schema.names, x.columns)], names=x.schema.names)

    return arrow_map(df, run, df.schema)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (the oracle rounds the same columns the same way;
    adding 0.0 maps -0.0 to 0.0). Wide tables are rounded as arrays: Spark's code for so many columns is too large
    to be compiled, and cost as much as all else."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)}
    if len(doubles) >= WIDE and not any(isinstance(f.dataType, FloatType) for f in df.schema.fields):
        return _rounded_arrays(df, doubles, digits)
    return df.select(*[
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def sql_round(cols: list[str], digits: int = 6) -> str:
    # "+ 0.0" turns a rounded -0.0 into 0.0 on both sides
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)
