"""File sources and sinks: bar CSVs, feature Parquet, headline JSON cache,
metrics JSON and comparison CSV. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

BARS_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

HEADLINE_CACHE_SCHEMA = T.StructType([
    T.StructField("headlines", T.ArrayType(T.StringType())),
    T.StructField("fetched_at", T.StringType()),
])

REQUIRED_BAR_COLUMNS = ["open", "high", "low", "close", "volume"]
# Provider column names renamed to close when close is missing.
ADJ_CLOSE_NAMES = ["adj close", "adj_close"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "mf-io", f"{name}-{uuid.uuid4().hex[:12]}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_symbol(df: DataFrame) -> DataFrame:
    """Rows clustered by symbol, in as many partitions as the session sets for a shuffle. The cost of a write by symbol
    is its files, not its bytes: without a number, adaptive execution merges partitions by their bytes to about one
    per core, and a few left over make a second wave as long as the first."""
    return df.repartition(shuffle_partitions(df.sparkSession), "symbol")


def write_bars(bars: DataFrame, path: str, fmt: str = "csv") -> None:
    """SRC-02: one folder per symbol (the partition directory replaces the file name). Rows are clustered
    by symbol first, so that a folder holds one file, not one per task; a symbol's bars are bounded by the
    calendar."""
    w = by_symbol(bars).write.mode("overwrite").partitionBy("symbol")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: bar CSVs with header and a declared schema; the symbol comes from the
    ``symbol=...`` partition folder."""
    schema = T.StructType(BARS_SCHEMA.fields + [T.StructField("symbol", T.StringType())])
    return spark.read.schema(schema).option("header", True).csv(path)


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_per_symbol(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with a folder per symbol. Spark lists the folders in up to 10,000 tasks of about one folder each,
    which cost far more than the listing; here in as many as a shuffle has."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, shuffle_partitions(spark))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(LISTING, before)


def write_features(processed: DataFrame, path: str) -> None:
    """SRC-03: processed features as Parquet partitioned by symbol (clustered as in ``write_bars``)."""
    by_symbol(processed).write.mode("overwrite").partitionBy("symbol").parquet(path)


def load_processed(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """SRC-04: one symbol's processed rows (partition pruning); error if absent."""
    df = spark.read.parquet(path).where(F.col("symbol") == symbol)
    if df.limit(1).count() == 0:
        raise FileNotFoundError(f"no processed data for {symbol}")
    return df


def write_headline_cache(headlines: DataFrame, path: str, fetched_at: str,
                         cap: int = 20) -> None:
    """SRC-05 sink: one JSON record per (symbol, date) with the ordered headline list of
    that day's fetch (deduped, first ``cap`` by position), so ``collect_list`` holds at
    most ``cap`` entries whatever the input volume. One folder per symbol; the date is in the record."""
    from ..operators.sets import cap_per_group, dedupe_first
    uniq = dedupe_first(headlines.select("symbol", "date", "headline", "position"),
                        ["symbol", "date", "headline"], "position")
    capped = cap_per_group(uniq, ["symbol", "date"], "position", cap)
    rec = (capped.groupBy("symbol", "date")
           .agg(F.array_sort(F.collect_list(F.struct("position", "headline"))).alias("_h"))
           .select("symbol", "date", F.col("_h.headline").alias("headlines"),
                   F.lit(fetched_at).alias("fetched_at")))
    by_symbol(rec).write.mode("overwrite").partitionBy("symbol").json(path)


def read_headline_cache(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05 source: PERMISSIVE read (a corrupt file yields null headlines), one row
    per headline with its position in the cached list."""
    schema = T.StructType(HEADLINE_CACHE_SCHEMA.fields + [
        T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return raw.select("symbol", "date", "fetched_at",
                      F.posexplode_outer("headlines").alias("pos", "headline"))


def metrics_records(metrics: DataFrame, trained_at: str) -> DataFrame:
    """SRC-06 record shape: long (symbol, model, metric...) table -> one nested record
    per symbol ``{trained_at, symbol, metrics: map<model, struct<metric...>>}``; the
    free-text ``report`` field is dropped. Records are per symbol (not one record for
    all symbols) so no task ever holds the whole run."""
    cols = [c for c in metrics.columns if c not in ("symbol", "model", "report")]
    return (metrics.groupBy("symbol")
            .agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct(*cols)))).alias("metrics"))
            .select(F.lit(trained_at).alias("trained_at"), "symbol", "metrics"))


def write_metrics_json(metrics: DataFrame, path: str, trained_at: str) -> None:
    """SRC-06 sink: the nested records as JSON lines."""
    metrics_records(metrics, trained_at).write.mode("overwrite").json(path)


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([
        T.StructField("trained_at", T.StringType()), T.StructField("symbol", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())))])
    return spark.read.schema(schema).json(path)


def write_comparison_csv(comparison: DataFrame, path: str) -> None:
    """SRC-07: comparison table as CSV with header (timestamped folder name)."""
    comparison.write.mode("overwrite").option("header", True).csv(path)


def standardise_columns(df: DataFrame) -> DataFrame:
    """SRC-10: lower-case names; rename an adjusted-close column to ``close`` only if a
    required column is missing."""
    out = df.toDF(*[c.lower() for c in df.columns])
    if not set(REQUIRED_BAR_COLUMNS).issubset(out.columns):
        for name in ADJ_CLOSE_NAMES:
            if name in out.columns and "close" not in out.columns:
                out = out.withColumnRenamed(name, "close")
    return out
