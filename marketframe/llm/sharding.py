"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt into blocks. For every block the counts that go to each part are drawn from the exact
multivariate hypergeometric law given the parts' sizes (the communication matrix of a uniform
permutation), each block is permuted on its own and dealt by its counts, the rows are exchanged, and
each part is permuted again. A shard is a run of parts, so no task ever holds a shard.

No one draws the whole matrix: a block descends a binary tree over the blocks and draws, at each
node, how the node's places split between its halves (log2 of the blocks draws of one row each,
seeded by node), so all blocks agree without exchanging anything.

Defined results: shard sizes differ by one at most, slots run from 0 without gaps, whatever the nulls,
ties or repeated rows; fewer rows than shards leave empty shards; an empty table gives an empty
result. Input columns named shard or slot are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import ceil_div, cut

#: Rows of one block and of one part, about; both counts stay under MAX_BLOCKS, and rows a block grow.
BLOCK_ROWS, MAX_BLOCKS = 4096, 65536
SEED = 11


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Draws without replacement. numpy's sampler is used where it works (under 10**9); beyond, the
    ratio-of-uniforms rejection method on the exact log probabilities."""
    total = good + bad
    if drawn == 0 or good == 0:
        return 0
    if bad == 0:
        return drawn
    if drawn == total:
        return good
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, drawn))

    def log_p(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(drawn - k + 1) + math.lgamma(bad - drawn + k + 1))

    low, high = max(0, drawn - bad), min(drawn, good)
    mode = min(high, max(low, (good + 1) * (drawn + 1) // (total + 2)))
    top = log_p(mode)
    mean = drawn * good / total
    sd = math.sqrt(max(1e-9, mean * (bad / total) * ((total - drawn) / (total - 1))) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * sd + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / max(u, 1e-300))
        if low <= k <= high and 2 * math.log(max(u, 1e-300)) <= log_p(k) - top:
            return k


def split_places(rng: np.random.Generator, places: np.ndarray, drawn: int) -> np.ndarray:
    """How many of ``drawn`` rows fall on each part, given the free places of the parts."""
    total = int(places.sum())
    if total < 10**9:
        return rng.multivariate_hypergeometric(places, drawn, method="marginals") if drawn else np.zeros_like(places)
    out = np.zeros_like(places)
    for i, n in enumerate(places.tolist()):
        total -= n
        out[i] = hypergeometric(rng, n, total, drawn)
        drawn -= int(out[i])
    return out


def matrix_row(block: int, block_sizes: np.ndarray, part_sizes: np.ndarray, seed: int) -> np.ndarray:
    """Row ``block`` of the communication matrix: how many of its rows go to each part."""
    low, high, places, ends = 0, len(block_sizes), part_sizes.astype(np.int64), np.r_[0, np.cumsum(block_sizes)]
    while high - low > 1:
        mid = (low + high) // 2
        left = split_places(np.random.default_rng([seed, low, high]), places, int(ends[mid] - ends[low]))
        low, high, places = (low, mid, left) if block < mid else (mid, high, places - left)
    return places


def part_layout(rows: int, shards: int, part_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per part: its size, its shard and its first slot there. Shard sizes differ by one at most."""
    sizes, shard, first = [], [], []
    for s in range(shards):
        own = rows // shards + (s < rows % shards)
        parts = max(1, ceil_div(own, part_rows))
        cuts = [own * i // parts for i in range(parts + 1)]
        sizes += [b - a for a, b in zip(cuts, cuts[1:])]
        shard += [s] * parts
        first += cuts[:-1]
    return np.array(sizes, np.int64), np.array(shard, np.int64), np.array(first, np.int64)


def shard(docs: DataFrame, shards: int = 16, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with shard (int) and slot (long), uniformly permuted, shard sizes at most one apart."""
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    # the row numbers are written down, so that a recomputed task deals the same rows again
    rows = cut(docs.select(*own, F.monotonically_increasing_id().alias("__mf_row")))
    n = rows.count()
    size = max(block_rows, ceil_div(n, MAX_BLOCKS - shards))
    n_blocks = max(1, ceil_div(n, size))
    rows = rows.withColumn("__mf_block", F.pmod(F.xxhash64(F.lit(seed), "__mf_row"), F.lit(n_blocks)).cast("int"))
    counted = {r[0]: r[1] for r in rows.groupBy("__mf_block").count().collect()}  # at most MAX_BLOCKS rows
    block_sizes = np.array([counted.get(b, 0) for b in range(n_blocks)], np.int64)
    part_sizes, part_shard, part_first = part_layout(n, shards, size)

    def deal(block: pa.Table) -> pa.Table:
        b = block.column("__mf_block")[0].as_py()
        to = np.repeat(np.arange(len(part_sizes)), matrix_row(b, block_sizes, part_sizes, seed))
        parts = np.empty(len(to), np.int32)
        parts[np.argsort(block.column("__mf_row").to_numpy())] = np.random.default_rng([seed, b, 1]).permutation(to)
        return block.append_column("__mf_part", pa.array(parts))

    schema = StructType([*rows.schema.fields, StructField("__mf_part", IntegerType())])
    dealt = rows.groupBy("__mf_block").applyInArrow(deal, schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            p = x.column(x.schema.get_field_index("__mf_part")).to_numpy()
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(part_shard[p].astype(np.int32)), pa.array(part_first[p])],
                                             names=[*x.schema.names, "shard", "__mf_first"])

    # the second permutation: order inside the part by a keyed hash
    inside = Window.partitionBy("__mf_part").orderBy(F.xxhash64(F.lit(seed + 1), "__mf_row"), "__mf_row")
    placed = dealt.withColumn("__mf_at", F.row_number().over(inside) - 1).mapInArrow(
        place, StructType([*schema.fields, StructField("__mf_at", IntegerType()), StructField("shard", IntegerType()),
                           StructField("__mf_first", LongType())]))
    return placed.select(*own, "shard", (F.col("__mf_first") + F.col("__mf_at")).alias("slot"))
