"""Adapters that turn the driver's tables into the pipeline's input shapes.

* ``bars_flag``       few long series: symbol = returnflag || linestatus
* ``bars_supplier``   many short series: symbol = supplier key
* ``bars_event_hour`` hourly bars of the event stream (negative quality cases)
* ``headlines``       first line of each document, keyed to a bar symbol and date
* ``scored_headlines`` headlines scored through the label table
* ``predictions_persistence`` a model-free baseline prediction table
* ``request_symbols`` / ``report_files`` serving inputs derived from the bar symbols
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bars import bars_from_ticks, most_bars
from ..operators.labels import label_class
from ..operators.sentiment import score_from_labels
from ..operators.windows import series
from .tables import read_table

# Fixture constants.
PRICE_DIVISOR = 20011.0
TIEBREAK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
HEADLINE_SYMBOLS = ["AF", "AO", "NF", "NO", "RF", "RO"]
HEADLINE_START = "2001-07-25"
HEADLINE_DAYS = 103
HEADLINE_AS_OF = "2001-11-04"


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = sorted(set(TIEBREAK + ["l_returnflag", "l_linestatus", "l_shipdate"]))
    return read_table(spark, sf_dir, "lineitem", cols)


def _price() -> Column:
    return 100.0 + F.col("l_extendedprice") / PRICE_DIVISOR


def bars_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem(spark, sf_dir)
    return bars_from_ticks(li, F.concat("l_returnflag", "l_linestatus"), F.col("l_shipdate"),
                           _price(), F.col("l_quantity"), [F.col(c) for c in TIEBREAK])


def bars_flag_orderdate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second bar batch over the same symbols, dated by the order date
    (lineitem joined to orders): shares many (symbol, date) keys with
    ``bars_flag`` but has different prices, as a re-fetched batch would."""
    li = _lineitem(spark, sf_dir)
    od = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    return bars_from_ticks(j, F.concat("l_returnflag", "l_linestatus"), F.col("o_orderdate"),
                           _price(), F.col("l_quantity"), [F.col(c) for c in TIEBREAK])


def bars_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", sorted(set(TIEBREAK + ["l_shipdate"])))
    return bars_from_ticks(li, F.col("l_suppkey").cast("string"), F.col("l_shipdate"),
                           _price(), F.col("l_quantity"), [F.col(c) for c in TIEBREAK])


def bars_supplier_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most so many bars of each symbol of ``bars_supplier``: (symbol, count)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate"])
    return most_bars(li, F.col("l_suppkey").cast("string"), F.col("l_shipdate"))


def bars_event_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"])
    return bars_from_ticks(ev, F.col("event_type"), F.col("ts"), F.col("value"), None,
                           [F.col("event_id")], bucket="hour")


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    sym = F.element_at(F.array(*[F.lit(s) for s in HEADLINE_SYMBOLS]),
                       (F.col("doc_id") % len(HEADLINE_SYMBOLS) + 1).cast("int"))
    day = F.date_add(F.to_date(F.lit(HEADLINE_START)),
                     (F.floor(F.col("doc_id") / len(HEADLINE_SYMBOLS)) % HEADLINE_DAYS).cast("int"))
    return docs.select(
        sym.alias("symbol"), day.alias("date"), F.col("doc_id").alias("position"),
        F.trim("text").alias("headline"))


def scored_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines scored by the label table (toxic -> negative, quality -> positive)."""
    hl = headlines(spark, sf_dir)
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    label = (F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
             .otherwise("neutral"))
    score = F.when(F.col("toxic") == 1, -1.0).when(F.col("quality") == 1, 1.0).otherwise(0.0)
    conf = F.when(F.col("toxic") == 1, 0.9).when(F.col("quality") == 1, 0.8).otherwise(0.5)
    scored = lab.select(F.col("doc_id").alias("position"), label.alias("label"), score.alias("score"),
                        conf.alias("confidence"))
    return score_from_labels(hl, scored)


def labelled_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headlines that the label table knows, with its label (text and label only meet by id)."""
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return headlines(spark, sf_dir).join(lab.select(F.col("doc_id").alias("position"), label.alias("label")), "position")


def predictions_persistence(bars: DataFrame) -> DataFrame:
    """Long prediction table (symbol, date, model, y_true, y_pred).

    ``persistence`` predicts the previous row's label (its return ends at t, so it
    is known at t); ``always_hold`` predicts class 2. Rows without a label (the
    last of each series) or without a previous label (the first) are left out."""
    w = series()
    fwd = F.lead("close", 1).over(w) / F.col("close") - 1.0
    lab = bars.select("symbol", "date", fwd.alias("_fwd"))
    lab = lab.where(F.col("_fwd").isNotNull()).withColumn("y_true", label_class(F.col("_fwd")))
    lab = lab.withColumn("_prev", F.lag("y_true", 1).over(w)).where(F.col("_prev").isNotNull())
    persist = lab.select("symbol", "date", F.lit("persistence").alias("model"), "y_true",
                         F.col("_prev").cast("int").alias("y_pred"))
    hold = lab.select("symbol", "date", F.lit("always_hold").alias("model"), "y_true",
                      F.lit(2).cast("int").alias("y_pred"))
    return persist.unionByName(hold)


# Request variants built from each bar symbol.
REQUEST_VARIANTS = ["{s}", "lower({s})", "' ' || lower({s}) || '.ns '", "{s} || '.US'",
                    "{s} || '.BO'", "reverse({s})"]


def request_symbols(bars: DataFrame) -> DataFrame:
    """Serving requests derived from the bar symbols: the bare symbol, lower case,
    padded lower case with suffix, a rejected suffix, a valid but unknown suffix and
    an unknown symbol (the reversed code)."""
    syms = bars.select("symbol").distinct()
    variants = [F.expr(v.format(s="symbol")) for v in REQUEST_VARIANTS]
    return syms.select(F.posexplode(F.array(*variants)).alias("variant", "requested"), "symbol") \
        .select(F.concat_ws("#", "symbol", "variant").alias("request_id"), "requested")


def report_files(bars: DataFrame) -> DataFrame:
    """Drift report names for symbols whose code ends in 'F': one per each of the
    symbol's last two bar dates; other symbols have none."""
    w = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    last2 = (bars.where(F.col("symbol").endswith("F"))
             .select("symbol", "date", F.row_number().over(w).alias("_r")).where("_r <= 2"))
    name = F.concat(F.col("symbol"), F.lit(".NS_"), F.date_format("date", "yyyyMMdd"),
                    F.when(F.col("_r") == 1, F.lit("_020000")).otherwise(F.lit("_013000")),
                    F.lit("_drift_report.html"))
    return last2.select(name.alias("name"))
