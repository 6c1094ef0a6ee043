"""Structured Streaming bars: micro-batches of one (symbol, date) are merged, none is lost."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from marketframe.operators.bars import bar_states, bars_from_ticks
from marketframe.streaming import run_bar_stream, upsert_batch

SCHEMA = "sym string, ts timestamp, price double, qty double, seq long"
T0 = dt.datetime(2024, 1, 1, 10)
DAY, HOUR = dt.timedelta(days=1), dt.timedelta(hours=1)
BATCHES = [
    [("A", T0, 10.0, 1.0, 1), ("A", T0 + DAY, 11.0, 2.0, 4)],
    [("A", T0 + DAY + HOUR, 20.0, 5.0, 5), ("A", T0 + 2 * DAY, 12.0, 1.0, 6)],
    [("A", T0 + HOUR, 8.0, 3.0, 2), ("A", T0 + DAY - HOUR, 9.0, 1.0, 3)],
]


def to_states(batch):
    return bar_states(batch, F.col("sym"), F.col("ts"), F.col("price"), F.col("qty"), [F.col("seq")])


def rows(bars):
    return sorted((r.symbol, r.date, r.open, r.high, r.low, r.close, r.volume) for r in bars.collect())


def folders(path):
    return sorted(n for n in os.listdir(path) if "=" in n)


@pytest.mark.parametrize("compact_every, left", [(16, ["delta=0", "delta=1", "delta=2"]), (2, ["base=1", "delta=2"])])
def test_stream_merges_batches(spark, compact_every, left):
    base = tempfile.mkdtemp(prefix="mf-stream-test-", dir="/tmp")
    staged = os.path.join(base, "staged")
    # one file per append: the file source orders them by modification time
    for batch in BATCHES:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(staged)
    table = os.path.join(base, "bars")
    out = run_bar_stream(spark, staged, spark.createDataFrame([], SCHEMA).schema, to_states, table,
                         os.path.join(base, "ckpt"), max_files_per_trigger=1, compact_every=compact_every)
    assert folders(table) == left
    whole = bars_from_ticks(spark.createDataFrame(sum(BATCHES, []), SCHEMA), F.col("sym"), F.col("ts"),
                            F.col("price"), F.col("qty"), [F.col("seq")])
    assert rows(out) == rows(whole)
    got = {r.date: r for r in out.collect()}
    assert got[dt.date(2024, 1, 2)].volume == 8.0 and got[dt.date(2024, 1, 2)].close == 20.0


def test_batch_run_again_counts_once(spark):
    table = tempfile.mkdtemp(prefix="mf-stream-test-", dir="/tmp")
    run = upsert_batch(to_states, table, compact_every=2)
    for epoch in (0, 0, 1, 1, 2, 2):
        run(spark.createDataFrame(BATCHES[epoch], SCHEMA), epoch)
    from marketframe.streaming import latest_bars
    assert sum(r[-1] for r in rows(latest_bars(spark, table))) == 13.0
