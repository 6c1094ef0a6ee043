"""Classification metrics over a long prediction table (symbol, model, y_true, y_pred).

All metrics come from one per-class count table built by a single grouped
aggregation (partial before the shuffle): for each row, the true class gains a
support count and the predicted class a prediction count; F1_c = 2 TP / (support +
predicted), 0 when both are 0. Everything after that works on <= 5 rows per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_CLASSES = 5
# Classes averaged for the buy and sell scores.
BUY_CLASSES = [3, 4]
SELL_CLASSES = [0, 1]


def class_counts(preds: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(keys..., cls, support, predicted, tp) for every class seen in y or p."""
    hit = (F.col(y) == F.col(p)).cast("long")
    items = F.array(
        F.struct(F.col(y).cast("int").alias("cls"), F.lit(1).cast("long").alias("s"),
                 F.lit(0).cast("long").alias("q"), hit.alias("t")),
        F.struct(F.col(p).cast("int").alias("cls"), F.lit(0).cast("long").alias("s"),
                 F.lit(1).cast("long").alias("q"), F.lit(0).cast("long").alias("t")))
    x = preds.select(*keys, F.explode(items).alias("_e"))
    return x.groupBy(*keys, F.col("_e.cls").alias("cls")).agg(
        F.sum("_e.s").alias("support"), F.sum("_e.q").alias("predicted"), F.sum("_e.t").alias("tp"))


def per_class_report(preds: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """EVAL-05: precision, recall, F1 and support per class (0 where undefined)."""
    c = class_counts(preds, keys, y, p)
    return c.select(
        *keys, "cls",
        F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0)).cast("double").alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0)).cast("double").alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0)).alias("f1"),
        "support")


def classification_metrics(preds: DataFrame, keys: list[str] | None = None,
                           y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """EVAL-01..04: accuracy, macro F1 (classes in y or p), support-weighted F1 and
    the buy/sell F1 (mean over two fixed classes, missing classes count 0)."""
    keys = keys or ["symbol", "model"]
    c = class_counts(preds, keys, y, p)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    c = c.withColumn("f1", f1)
    f1 = F.col("f1")
    return c.groupBy(*keys).agg(
        F.try_divide(F.sum("tp"), F.sum("support")).cast("double").alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
        F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).cast("double").alias("weighted_f1"),
        (F.sum(F.when(F.col("cls").isin(BUY_CLASSES), f1).otherwise(0.0)) / len(BUY_CLASSES)).alias("buy_f1"),
        (F.sum(F.when(F.col("cls").isin(SELL_CLASSES), f1).otherwise(0.0)) / len(SELL_CLASSES)).alias("sell_f1"))


def comparison_table(preds: DataFrame, digits: int = 4) -> DataFrame:
    """EVAL-06 + TOP-01: symbol x model metrics rounded, ordered by symbol then macro F1 desc."""
    m = classification_metrics(preds)
    cols = ["accuracy", "macro_f1", "weighted_f1", "buy_f1", "sell_f1"]
    return (m.select("symbol", "model", *[F.round(c, digits).alias(c) for c in cols])
            .orderBy(F.col("symbol").asc(), F.col("macro_f1").desc(), F.col("model").asc()))


def confusion_matrix(preds: DataFrame, keys: list[str] | None = None,
                     y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """AGG-07: 5 x 5 confusion matrix per group, zero-filled (a 5-row spine per group)."""
    keys = keys or ["symbol", "model"]
    counts = preds.groupBy(*keys, F.col(y).cast("int").alias("y_true")).pivot(p, list(range(N_CLASSES))).count()
    spine = preds.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(N_CLASSES - 1))).alias("y_true"))
    out = spine.join(counts, keys + ["y_true"], "left")
    return out.select(*keys, "y_true", *[F.coalesce(F.col(str(k)), F.lit(0)).cast("long").alias(f"pred_{k}")
                                         for k in range(N_CLASSES)])
