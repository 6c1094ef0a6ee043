"""Periodic runs of words by online dyadic square catching.

A run is a stretch of words with smallest period q, at least ``max(shortest, 2 * q)`` words long, that no
neighbouring word extends. The finder reads a stream of words. Whenever a block of L = 2^k words that starts
at a multiple of L is complete, a catcher is set up for it: it watches the distances 2L-1 to 4L-2 (each
period belongs to one level k) and compares the L last words of the stream with its block. Every stretch of
2L-1 words holds a whole block of its level, so no square x x with a period of the level passes its
catchers, and each appended word meets two catchers a level. Caught blocks are extended on both sides to the
whole stretch that agrees with itself at that distance; overlapping catches merge into one run.

Comparisons are of 64-bit names of 1, 2, 4, ... words, built by doubling, so that a word costs O(log n) and
an extension O(log n) steps. Slabs of appended words are compared by numpy at once. Several documents make
one stream with a number between them that never repeats; no run crosses it.

Defined results: null, empty and blank texts have no words and no runs (the collapsed text is empty); rows
are independent of each other, so repeated rows, null ids and extra columns change nothing; an empty table
gives an empty result. Input columns named like an output (n_words, runs, collapsed) are replaced. A task
holds one slab (``SLAB_WORDS``, or one longer text) at a time; a text of n words takes about 8 log2(n) bytes
a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import text_or_empty

SHORTEST, SLAB_WORDS = 12, 100_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
OUTPUT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit names of two neighbouring windows' names."""
    x = (left ^ (left >> np.uint64(31))) * _M1 + right
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


class SquareCatchers:
    """The catchers of one stream of word numbers. ``longest``: no square is longer than that."""

    def __init__(self, longest: int | None = None):
        self.longest, self.n = longest, 0
        self.names: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.caught: list[list[tuple[np.ndarray, np.ndarray, int]]] = [[]]

    def _watched(self, level: int) -> bool:
        """Whether a square of the level's least period, 2L-1, has room."""
        room = self.n if self.longest is None else min(self.n, self.longest)
        return 2 * (2 * (1 << level) - 1) <= room

    def append(self, words: np.ndarray) -> int:
        """Advances every catcher by the appended words; returns how many blocks were caught again."""
        self.n += len(words)
        self.names[0] = np.concatenate([self.names[0], _named(words.astype(np.uint64), np.uint64(0))])
        level, new = 0, 0
        while self._watched(level):
            wide = 1 << level
            if level == len(self.names):
                self.names.append(np.zeros(0, np.uint64))
                self.caught.append([])
            if level:
                below, done = self.names[level - 1], len(self.names[level])
                count = self.n - wide + 1
                fresh = _named(below[done:count], below[done + wide // 2:count + wide // 2])
                self.names[level] = np.concatenate([self.names[level], fresh])
            new += self._catch(level)
            level += 1
        return new

    def _catch(self, level: int) -> int:
        """Compares the windows not compared yet with the two blocks whose catchers watch them."""
        wide, names = 1 << level, self.names[level]
        begin = self.caught[level][-1][2] if self.caught[level] else 0
        at = np.arange(max(begin, 2 * wide - 1), len(names))
        # the nearest block starts at the last multiple of L that is 2L-1 words or more back
        nearest = (at - (2 * wide - 1)) >> level << level
        found = []
        for block in (nearest, nearest - wide):
            hit = np.flatnonzero((names[at] == names[block]) & (block >= 0))
            found.append((block[hit], (at - block)[hit]))
        block, period = (np.concatenate(f) for f in zip(*found))
        self.caught[level].append((block, period, len(names)))
        return len(block)

    def _extended(self, level: int, place: np.ndarray, period: np.ndarray, step: int) -> np.ndarray:
        """How many words (fewer than L) the agreement goes on from ``place``; step -1 looks to the left."""
        place = place.copy()
        for k in range(level - 1, -1, -1):
            wide, names = 1 << k, self.names[k]
            at = place - wide if step < 0 else place
            inside = (at >= 0) & (at + period < len(names))
            ok = np.zeros(len(at), bool)
            ok[inside] = names[at[inside]] == names[at[inside] + period[inside]]
            place[ok] += step * wide
        return place

    def runs(self, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, smallest period) of every run, sorted by start and period."""
        parts = []
        for level, caught in enumerate(self.caught):
            wide = 1 << level
            block, period = (np.concatenate([c[i] for c in caught]) if caught else np.zeros(0, np.int64) for i in (0, 1))
            if not len(block):
                continue
            order = np.lexsort((block, period))
            block, period = block[order], period[order]
            # catches of neighbouring blocks at one distance are parts of one stretch
            opens = np.ones(len(block), bool)
            opens[1:] = (period[1:] != period[:-1]) | (block[1:] != block[:-1] + wide)
            first = np.flatnonzero(opens)
            last = np.r_[first[1:], len(block)] - 1
            period = period[first]
            left = self._extended(level, block[first], period, -1)
            right = self._extended(level, block[last] + wide, period, 1)
            whole = right - left + period >= np.maximum(shortest, 2 * period)
            parts.append((left[whole], (right + period)[whole], period[whole]))
        start, end, period = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        # a stretch caught at a multiple of its smallest period has the same bounds
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        least = np.ones(len(start), bool)
        least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[least], end[least], period[least]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _slab(texts: list[list[bytes]], shortest: int) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed text of each document (a list of words)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    numbers = _Numbers()
    stream = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    for at, words in zip(first.tolist(), texts):
        stream[at:at + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    stream[first + sizes] = len(numbers) + np.arange(len(texts))
    catchers = SquareCatchers(int(sizes.max(initial=0)))
    catchers.append(stream)
    start, end, period = catchers.runs(shortest)
    owner = np.searchsorted(first, start, side="right") - 1
    runs: list[list[dict]] = [[] for _ in texts]
    for doc, s, e, q in zip(owner.tolist(), (start - first[owner]).tolist(), (end - first[owner]).tolist(), period.tolist()):
        runs[doc].append({"start": s, "length": e - s, "period": q})
    over = np.zeros(len(stream) + 1, np.int64)
    np.add.at(over, start + period, 1)
    np.add.at(over, end, -1)
    dropped = np.cumsum(over) > 0
    collapsed = []
    for doc, (at, words) in enumerate(zip(first.tolist(), texts)):
        if runs[doc]:
            words = [words[i] for i in np.flatnonzero(~dropped[at:at + len(words)]).tolist()]
        collapsed.append(b" ".join(words))
    return runs, collapsed


def find_runs(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with n_words, runs (sorted by start and period; start is a word number from 0) and collapsed:
    the words, joined by one blank, without those that a run holds after its first period."""
    kept = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    rows = docs.select(*kept, text_or_empty(text).cast("binary").alias("__mf_text"))
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL(OUTPUT).fields])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(part: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
            runs, collapsed = _slab(texts, shortest)
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, run_type),
                       pa.array(collapsed, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=schema.names)

        for x in batches:
            texts, size, at = [], 0, 0
            for t in x.column(x.num_columns - 1):
                texts.append(t.as_py().split())  # bytes are parted at blank, tab, LF, VT, FF and CR alone
                size += len(texts[-1]) + 1
                if size >= SLAB_WORDS:
                    yield flush(x.slice(at, len(texts)), texts)
                    at, texts, size = at + len(texts), [], 0
            if texts:
                yield flush(x.slice(at, len(texts)), texts)

    return rows.mapInArrow(find, schema)
