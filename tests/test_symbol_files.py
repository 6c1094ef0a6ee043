"""Tables with a folder per symbol: one file a symbol, written and listed in as many tasks as a shuffle has."""

from pathlib import Path

from pyspark.sql import functions as F

from marketframe.sources import io


def test_files_per_symbol(spark, tmp_path):
    path = str(tmp_path / "bars")
    symbol = F.when(F.col("id") % 100 != 99, F.concat(F.lit("s"), F.col("id") % 100))
    bars = spark.range(1000).select(symbol.alias("symbol"), F.col("id").cast("double").alias("close"))
    io.write_bars(bars.unionByName(bars), path, fmt="parquet")
    files = list(Path(path).rglob("*.parquet"))
    assert len(files) == len({f.parent for f in files}) == 100
    assert len({f.name.split("-")[1] for f in files}) == io.shuffle_partitions(spark) > 1

    before = spark.conf.get(io.LISTING)
    spark.sparkContext.setJobGroup("listing", "")
    got = io.read_per_symbol(spark, path)
    spark.sparkContext.setJobGroup("", "")
    assert spark.conf.get(io.LISTING) == before
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= io.shuffle_partitions(spark)
    rows = sorted(map(tuple, got.select(F.coalesce("symbol", F.lit("null")), "close").collect()))
    assert rows == sorted((f"s{i % 100}" if i % 100 != 99 else "null", float(i)) for i in range(1000) for _ in range(2))
