"""Incremental bar maintenance with Structured Streaming.

Each micro-batch of ticks is aggregated to mergeable bar states (OHLCV with the keys of the first and the
last tick) and appended as ``delta=<epoch>``; nothing that is stored already is read or rewritten for it.
A reader merges the states of one (symbol, date), so a day whose ticks come in several batches keeps them
all. Every ``COMPACT_EVERY`` batches the states are merged into ``base=<epoch>``; the folders that it
replaces go once it is committed.

Folders are immutable and hold a ``_SUCCESS`` mark once complete. A batch that is run again writes its own
folder again, or does nothing when a base covers it already, so every tick counts once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..operators.bars import merge_bar_states

COMPACT_EVERY = 16


def _hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` (local, HDFS, object store) and the path's class."""
    path_class = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path_class(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path_class


def _committed(spark: SparkSession, table: str, kind: str) -> list[int]:
    """Epochs of the complete ``kind=<epoch>`` folders, in order."""
    fs, path = _hadoop(spark, table)
    if not fs.exists(path(table)):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(path(table))]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{kind}=")
                  and fs.exists(path(os.path.join(table, n, "_SUCCESS"))))


def _live(spark: SparkSession, table: str) -> tuple[int, list[str]]:
    """The newest base's epoch (-1: none) and the folders that make up the table now."""
    base = max(_committed(spark, table, "base"), default=-1)
    deltas = [e for e in _committed(spark, table, "delta") if e > base]
    names = ([f"base={base}"] if base >= 0 else []) + [f"delta={e}" for e in deltas]
    return base, [os.path.join(table, n) for n in names]


def stored_states(spark: SparkSession, table: str) -> DataFrame | None:
    """One state per (symbol, date); None before the first batch."""
    folders = _live(spark, table)[1]
    return merge_bar_states(spark.read.parquet(*folders)) if folders else None


def latest_bars(spark: SparkSession, table: str) -> DataFrame | None:
    """The bars of all ticks so far; None before the first batch."""
    states = stored_states(spark, table)
    return None if states is None else states.drop("first_key", "last_key")


def _drop_replaced(spark: SparkSession, table: str) -> None:
    base = _live(spark, table)[0]
    fs, path = _hadoop(spark, table)
    for kind in ("base", "delta"):
        for epoch in _committed(spark, table, kind):
            if epoch < base or (kind == "delta" and epoch == base):
                fs.delete(path(os.path.join(table, f"{kind}={epoch}")), True)


def upsert_batch(to_states, table: str, compact_every: int = COMPACT_EVERY):
    """foreachBatch body: ticks -> states -> one delta, and a new base now and then."""
    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if _live(spark, table)[0] < epoch:
            to_states(batch).write.mode("overwrite").parquet(os.path.join(table, f"delta={epoch}"))
            if (epoch + 1) % compact_every == 0:
                stored_states(spark, table).write.mode("overwrite").parquet(os.path.join(table, f"base={epoch}"))
        _drop_replaced(spark, table)
    return run


def run_bar_stream(spark: SparkSession, source_dir: str, schema, to_states, table: str, checkpoint_path: str,
                   max_files_per_trigger: int | None = None, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Stream every file under ``source_dir`` into the bar table (available-now trigger), wait for
    completion and return the bars."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    q = (stream.writeStream.foreachBatch(upsert_batch(to_states, table, compact_every))
         .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_bars(spark, table)
