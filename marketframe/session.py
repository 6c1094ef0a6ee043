"""SparkSession construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "marketframe") -> SparkSession:
    """Session for local runs and tests; on a cluster pass the cluster's master."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    if shuffle_partitions or master.startswith("local["):
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    if master.startswith("local["):
        # small test data, many window functions per row: keep partitions that are small in bytes
        builder = builder.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    spark = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; set a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder; it is used as is.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    scratch = tempfile.mkdtemp(prefix="mf-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", scratch)
    sc.setCheckpointDir(scratch)
    return scratch


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that Spark wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow``; on a table that came from here the functions run one after the other in Python, as one pass, so
    that wide rows between them are never turned into Spark's rows and back."""
    source, before = (df, None) if df.is_cached else getattr(df, "_mapped", (df, None))
    run = fn if before is None else lambda batches: fn(before(batches))
    out = source.mapInArrow(run, schema)
    out._mapped = source, run
    return out


FIT_ROWS, FIT_TASKS = 5000, 12


def packed(df: DataFrame, rows: int = FIT_ROWS, least: int = FIT_TASKS) -> DataFrame:
    """A checkpointed table in one partition per ``rows`` rows (``least`` at any rate), if it has more. An iterative fit
    starts a task per partition in each of its hundreds of passes, and a shuffle makes as many as the session sets."""
    return df.coalesce(max(least, -(-df.count() // rows)))


_SHARED: dict[tuple[str, str], DataFrame] = {}


def shared_table(spark: SparkSession, key: str, build) -> DataFrame:
    """Build ``build()`` once per application, checkpoint it into the shared folder and
    hand the same checkpointed table to every later caller (several queries read the
    same processed / training table)."""
    k = (spark.sparkContext.applicationId, key)
    if k not in _SHARED:
        _SHARED[k] = cut_lineage(build())
    return _SHARED[k]
