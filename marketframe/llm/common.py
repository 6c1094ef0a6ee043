"""Helpers shared by the training-data operators.

Conventions that hold for every operator of the package:

* Helper columns start with ``__mf_``; an input column that has the name of an output column is
  replaced by the output.
* A null text counts as an empty text.
* Intermediate tables are cut with reliable ``checkpoint()`` into the folder that the session names
  in ``spark.checkpoint.dir``; a scratch folder is chosen only in local mode when none is set.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAP = " \t\n\x0b\x0c\r"
WORD_SPLIT = "[ \\x09-\\x0D]+"
#: Spark's bound on the bytes of a batch of rows that crosses to Python, its default, and the operators' own.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own, else a scratch folder in local mode."""
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    if not (named := spark.conf.get("spark.checkpoint.dir", None)):
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="mf-llm-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; later stages read the shared files, so lost executors cost nothing more."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(spark: SparkSession) -> None:
    """Rows cross to Python about BATCH_BYTES at a time, unless the session has a bound of its own. A batch of texts
    is held several times over by the JVM and by Python, for every task of an executor. Plans are made after an
    operator returns, so the setting stays in the session."""
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """All words of the text, in order."""
    return F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words without keeping them: gaps are folded to one blank, then blanks are counted."""
    folded = F.trim(F.regexp_replace(text, WORD_SPLIT, " "))
    blanks = F.length(folded) - F.length(F.replace(folded, F.lit(" "), F.lit("")))
    return F.when(folded == "", F.lit(0)).otherwise(blanks + 1).cast("long")


def row_key(ident: str, text: Column) -> list[Column]:
    """96 bits that name a row by its id and text. Rows equal in both share the key, and every
    operator that joins on it gives such rows the same result."""
    return [F.xxhash64(F.col(ident).isNull(), F.col(ident), text).alias("__mf_r1"),
            F.hash(text, F.col(ident)).alias("__mf_r2")]


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) fixed by the seed and the columns: 52 bits of an md5, so reruns and other
    engines agree. Null reads as the letter n."""
    parts = [F.coalesce(c.cast("string"), F.lit("n")) for c in cols]
    hexed = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 13)
    return (F.conv(hexed, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def apart(df: DataFrame, key: str) -> DataFrame:
    """An aggregate that is to be joined on its own key, dealt out by another one. The join then has an
    exchange of its own on both sides, so that adaptive execution can split a hot key on the other."""
    return df.repartition(F.xxhash64(F.lit(1), key))


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)
