"""Conflict-constrained best-fit packing of documents into training sequences.

A sequence (bin) holds ``capacity`` words. Documents longer than that are cut into full sequences and
a remainder, nothing is dropped. Two pieces conflict when they come from one duplicate cluster, or
when a bin already holds ``per_source`` pieces of the piece's source. Bins are ordered by their
residual; each bin carries a bitmap of the duplicate clusters it holds and ``per_source`` bitmaps of
sources (bit s of plane j: it holds more than j pieces of source s). A piece goes to the compatible
bin with the least residual that fits it: the successor search starts at the piece's size and goes on
to larger residuals until a bin's bitmaps allow the piece, else a new bin is opened.

Blocks of about ``block_docs`` documents are packed independently, so memory and time of a task do not
grow with the table. Inside a block, pieces of one (size, cluster, source) come together and the
search of each goes on where the last one stopped, so a block full of copies does not rescan its bins.

Defined results: a null or empty text is a piece of no words and takes part in conflicts like any
other; null sources are one source; a null cluster conflicts with nothing; repeated rows (equal in id
and cluster) are separate pieces; an empty table gives an empty result; other input columns are left
out.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ceil_div, cut, n_words, text_or_empty

CAPACITY, PER_SOURCE, BLOCK_DOCS = 4096, 4, 4096
SEED = 5


class Bins:
    """Bins in order of (residual, number), with their bitmaps."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.used: list[int] = []

    def find(self, size: int, cluster: int, source: int, start: tuple[int, int]) -> int | None:
        """Place in ``order`` of the tightest compatible bin at or after ``start``."""
        last = self.per_source - 1
        for at in range(bisect_left(self.order, max(start, (size, -1))), len(self.order)):
            number = self.order[at][1]
            if not self.clusters[number] & cluster and not self.sources[number][last] & source:
                return at
        return None

    def put(self, size: int, cluster: int, source: int, start: tuple[int, int]) -> tuple[int, int, tuple[int, int]]:
        """Places a piece; returns the bin, the words before it and where an equal piece may go on."""
        at = self.find(size, cluster, source, start)
        if at is None:
            residual, number = self.capacity, len(self.used)
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
            self.used.append(0)
        else:
            residual, number = self.order.pop(at)
        before = self.used[number]
        self.used[number] += size
        self.clusters[number] |= cluster
        planes = self.sources[number]
        for j in range(self.per_source):
            if not planes[j] & source:
                planes[j] |= source
                break
        insort(self.order, (residual - size, number))
        return number, before, (residual, number)


def pack_block(sizes, clusters, sources, capacity: int, per_source: int) -> tuple[list[int], list[int], int]:
    """Bins and offsets of pieces already in packing order. Clusters and sources are small integers;
    -1 as cluster conflicts with nothing."""
    bins, out, offset, last, start = Bins(capacity, per_source), [], [], None, (0, -1)
    for size, cluster, source in zip(sizes, clusters, sources):
        bit = 1 << cluster if cluster >= 0 else 0
        # bins that refused a piece refuse the next equal one; a piece without a cluster may return
        if (size, cluster, source) != last or not bit:
            start = (0, -1)
        number, before, start = bins.put(size, bit, 1 << source, start)
        last = (size, cluster, source)
        out.append(number)
        offset.append(before)
    return out, offset, len(bins.used)


def pack(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None,
         capacity: int = CAPACITY, per_source: int = PER_SOURCE, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """One row per piece: doc id, source, piece (0, 1, ...), first_word, n_words, block, bin, bin_offset,
    bin_words. (block, bin) names a sequence. Without ``cluster``, documents with equal texts are a
    cluster."""
    body = text_or_empty(text)
    cluster = F.xxhash64(body) if cluster is None else cluster
    sized = docs.select(F.col(ident).alias(ident), F.col(source).alias("source"), n_words(body).alias("__mf_size"),
                        cluster.cast("string").alias("__mf_cluster"),
                        F.xxhash64(F.col(ident), body).alias("__mf_hash"),
                        F.monotonically_increasing_id().alias("__mf_row"))
    # the row numbers are written down, so that a recomputed task deals the same rows again
    sized = cut(sized)
    blocks = max(1, ceil_div(sized.count(), block_docs))
    # documents of one id and text are dealt by their row number too, so no block gets all copies
    sized = sized.withColumn("__mf_block", F.pmod(F.xxhash64(
        F.lit(seed), "__mf_hash", "__mf_row"), F.lit(blocks)).cast("int"))

    def fill(table: pa.Table) -> pa.Table:
        ids, named = table.column(0), table.column(1)
        words, names = table.column(2).to_numpy(), pd.Series(table.column(3).to_numpy(zero_copy_only=False), dtype=object)
        full = words // capacity
        rest = words - full * capacity
        pieces = full + ((rest > 0) | (full == 0))
        row = np.repeat(np.arange(len(words)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.where(piece < full[row], capacity, rest[row])
        # only clusters with several pieces in the block can conflict; the others need no bit
        many = names.map(names.value_counts()).fillna(0).to_numpy() > 1
        code = pd.factorize(names.where(many | (pieces > 1)))[0]
        places = named.combine_chunks().dictionary_encode("encode").indices.to_numpy()
        key = table.column(4).to_numpy()  # a hash of id and text orders equal pieces
        order = np.lexsort((piece, key[row], places[row], code[row], -size))
        number, offset, count = pack_block(size[order].tolist(), code[row][order].tolist(), places[row][order].tolist(), capacity, per_source)
        number, at = np.array(number, np.int64), pa.array(row[order])
        held = np.bincount(number, size[order], count).astype(np.int32)
        return pa.table([ids.take(at), named.take(at), pa.array(piece[order].astype(np.int32)), pa.array(piece[order] * capacity),
                         pa.array(size[order]), table.column(5).take(at), pa.array(number.astype(np.int32)),
                         pa.array(np.array(offset, np.int32)), pa.array(held[number])],
                        names=[ident, "source", "piece", "first_word", "n_words", "block", "bin", "bin_offset", "bin_words"])

    kinds = dict(sized.dtypes)
    return sized.drop("__mf_row").groupBy("__mf_block").applyInArrow(
        fill, f"`{ident}` {kinds[ident]}, source {kinds['source']}, piece int, first_word long, n_words long, block int, bin int, "
        "bin_offset int, bin_words int")
