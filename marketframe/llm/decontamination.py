"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are folded to word text: A-Z become a-z, every character below 0x80 that is no digit or letter parts
words, and words are parted by one blank, with a blank at both ends. The patterns are all windows of ``WINDOW``
consecutive words of a benchmark item, or a shorter item's words as a whole, with their blanks, so that an
occurrence covers whole words.

The search works on bytes. Patterns are put in classes by length (each twice as long as the one before), so
that a short pattern does not shorten the shifts of long ones. In a class, m is the least length, and only
blocks of the first m bytes of each pattern enter the tables:

* the shift table gives, for the hash of a block of ``BLOCK`` bytes, how far the window may move without
  passing an occurrence (blocks that no pattern has: m - BLOCK + 1);
* where the shift is 0, a bucket, by the hash of the window's last block and of its first one, names the
  patterns that may start here;
* each pattern of the bucket is compared directly with the text.

A text is cut into lanes, whose windows move at the same time (numpy); each lane starts where a window may
start, so nothing is lost at a cut.

Patterns reach the tasks as a broadcast of at most ``PATTERN_BYTES`` bytes. A benchmark with more is dealt
into so many groups by hash; each group is searched in a pass of its own, which adds to the hits that the row
already has, with the rows cut between passes. No text is moved in any case.

Defined results: null, empty and wordless texts have no words, no hits and no items; null and wordless items
have no windows; an item id that occurs twice counts once; a null item id counts as an item named "". Rows are
independent of each other, so repeated rows, null doc ids and extra columns change nothing; input columns named
like an output (n_words, hits, items) are replaced; an empty table on either side gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ceil_div, cut, text_or_empty

WINDOW, BLOCK, LANE, SLAB_BYTES, PATTERN_BYTES, TABLE_BITS = 10, 8, 2048, 2_000_000, 64_000_000, 20
OUTPUT = "n_words long, hits array<struct<start: long, end: long>>, items array<string>"
_BLANK, _EDGE, _PAD = 0x20, 0x01, 16
_FOLD = np.full(256, _BLANK, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _FOLD[_low:_high] = np.arange(_low, _high)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_M = np.uint64(0x9E3779B97F4A7C15)


def fold(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word text of all texts, with an edge byte before each, and where each starts)."""
    joined = np.frombuffer(b"\x00 " + b" \x00 ".join([*texts, b""]), np.uint8)[:-1]
    edges = np.cumsum([0, *(len(t) + 3 for t in texts)])
    text = _FOLD[joined]
    text[edges] = _EDGE
    keep = text != _BLANK
    keep[1:] |= keep[:-1]  # the first blank after a word or an edge stays
    place = np.cumsum(keep) - 1
    out = text[keep]
    return out, place[edges]


def as_patterns(windows: list[bytes]) -> list[bytes]:
    return [b" " + w + b" " for w in windows]


def _words_at(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; the buffer ends in padding."""
    return np.lib.stride_tricks.as_strided(buffer[:8].view(np.uint64), (len(buffer) - 7,), (1,))


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << (8 * min(size, 8))) - 1)


class _Class:
    """The tables of the patterns of one length class."""

    def __init__(self, patterns: list[bytes], numbers: np.ndarray):
        self.sizes = np.array([len(p) for p in patterns], np.int64)
        self.m = int(self.sizes.min())
        self.block = min(BLOCK, self.m)
        self.text = np.frombuffer(b"".join(patterns) + bytes(_PAD), np.uint8)
        self.first = np.cumsum(self.sizes) - self.sizes
        at = _words_at(self.text)
        self.shift = np.full(1 << TABLE_BITS, self.m - self.block + 1, np.int64)
        for end in range(self.block, self.m + 1):
            np.minimum.at(self.shift, self._slot(at[self.first + end - self.block]), self.m - end)
        key = self._bucket(at, self.first)
        order = np.argsort(key, kind="stable")
        self.numbers, self.sizes, self.first = numbers[order], self.sizes[order], self.first[order]
        self.keys, self.begin, self.count = np.unique(key[order], return_index=True, return_counts=True)

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return ((block & _mask(self.block)) * _M >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _bucket(self, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        last = at[start + self.m - self.block] & _mask(self.block)
        return (last * _M) ^ ((at[start] & _mask(self.block)) + (last >> np.uint64(7)))

    def search(self, text: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern number) of every occurrence in the first ``size`` bytes of the text."""
        begin = np.arange(0, max(size - self.m + 1, 0), LANE)
        stop, found = np.minimum(begin + LANE, size - self.m + 1), []
        while len(begin):
            step = self.shift[self._slot(at[begin + self.m - self.block])]
            if len(stay := begin[step == 0]):
                found.append(stay)
            begin = begin + np.maximum(step, 1)
            on = begin < stop
            begin, stop = begin[on], stop[on]
        return self._confirmed(at, np.concatenate(found)) if found else (np.zeros(0, np.int64),) * 2

    def _confirmed(self, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self._bucket(at, place)
        bucket = np.searchsorted(self.keys, key)
        bucket[bucket == len(self.keys)] = 0
        ours = self.keys[bucket] == key
        place, bucket = place[ours], bucket[ours]
        own, out = _words_at(self.text), []
        rank = 0
        while len(place):
            pattern = self.begin[bucket] + rank
            first, size, same = self.first[pattern], self.sizes[pattern], np.arange(len(place))
            done = 0
            while len(same):  # eight bytes at a time, while some pattern agrees and goes on
                left = size[same] - done
                wide = np.where(left >= 8, _mask(8), (np.uint64(1) << (np.uint64(8) * np.clip(left, 0, 7).astype(np.uint64))) - np.uint64(1))
                inside = place[same] + done < len(at)
                look = np.where(inside, place[same] + done, 0)
                agree = inside & (((at[look] ^ own[np.minimum(first[same] + done, len(own) - 1)]) & wide) == 0)
                done += 8
                over = agree & (left <= 8)
                out.append((place[same[over]], self.numbers[pattern[same[over]]]))
                same = same[agree & (left > 8)]
            rank += 1
            more = self.count[bucket] > rank
            place, bucket = place[more], bucket[more]
        if not out:
            return (np.zeros(0, np.int64),) * 2
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


class WuManber:
    """Finds all occurrences of byte patterns. Patterns are numbered by their place in the list."""

    def __init__(self, patterns: list[bytes]):
        rank = np.array([len(p).bit_length() for p in patterns], np.int64)
        self.classes = []
        for r in np.unique(rank):
            own = np.flatnonzero(rank == r)
            self.classes.append(_Class([patterns[i] for i in own], own))

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate([text, np.zeros(_PAD, np.uint8)])
        at = _words_at(padded)
        hits = [c.search(text, at, len(text)) for c in self.classes]
        if not hits:
            return (np.zeros(0, np.int64),) * 2
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def windows(items: DataFrame, ident: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(pattern binary, item string): the distinct windows of the items."""
    rows = items.select(F.coalesce(F.col(ident).cast("string"), F.lit("")).alias("item"), text_or_empty(text).cast("binary").alias("text"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for item, t in zip(x.column(0), x.column(1)):
                body, _ = fold([t.as_py()])
                split = body.tobytes().strip(b"\x01").split()
                found = {b" ".join(split[i:i + window]) for i in range(max(1, len(split) - window + 1))} if split else set()
                yield pa.RecordBatch.from_arrays([pa.array(as_patterns(sorted(found)), pa.binary()), pa.array([item.as_py()] * len(found), pa.string())],
                                                 names=["pattern", "item"])

    return rows.mapInArrow(cut_up, "pattern binary, item string").distinct()


class _Searcher:
    """The patterns of one group, their items and their tables, built once in each worker."""

    def __init__(self, rows: list[tuple[bytes, str]]):
        rows = sorted(rows)
        self.patterns = sorted({p for p, _ in rows})
        number = {p: i for i, p in enumerate(self.patterns)}
        self.owner = np.array([number[p] for p, _ in rows], np.int64)
        self.items = [item for _, item in rows]
        self.begin = np.searchsorted(self.owner, np.arange(len(self.patterns) + 1))
        self.n_words = np.array([p.count(b" ") - 1 for p in self.patterns], np.int64)
        self.engine = WuManber(self.patterns)

    def hits(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Of each text: number of words, hit stretches of words and the items that occur."""
        body, edges = fold(texts)
        opens = np.zeros(len(body) + 1, np.int64)  # words that start before a place
        opens[1:] = np.cumsum((body == _BLANK) & (np.r_[body[1:], np.uint8(_EDGE)] != _EDGE))
        n_words = (opens[edges[1:]] - opens[edges[:-1]]).tolist()
        place, pattern = self.engine.search(body)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        if len(place):
            order = np.argsort(place, kind="stable")
            place, pattern = place[order], pattern[order]
            doc = np.searchsorted(edges, place, side="right") - 1
            word = opens[place] - opens[edges[doc]]
            for d, a, b in zip(doc.tolist(), word.tolist(), (word + self.n_words[pattern]).tolist()):
                spans[d].append((a, b))
            pairs = np.unique(doc * len(self.patterns) + pattern)
            for d, p in zip((pairs // len(self.patterns)).tolist(), (pairs % len(self.patterns)).tolist()):
                items[d].update(self.items[self.begin[p]:self.begin[p + 1]])
        return list(zip(n_words, spans, items))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of stretches, as stretches that neither meet nor touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(docs: DataFrame, group: list[tuple[bytes, str]]) -> DataFrame:
    """Adds the hits of one group of patterns. ``docs``: rows whose last columns are the output's and __mf_text."""
    shared = docs.sparkSession.sparkContext.broadcast(group)
    schema = docs.schema

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _Searcher(shared.value)
        hit_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def flush(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            n, spans, items = [], [], []
            before = zip(part.column("hits"), part.column("items"))
            for (words, new, names), (old, old_names) in zip(searcher.hits(texts), before):
                old = [(s["start"], s["end"]) for s in old.as_py() or []]
                n.append(words)
                spans.append([{"start": a, "end": b} for a, b in merged(old + new)])
                items.append(sorted(names | set(old_names.as_py() or [])))
            columns = [*part.columns[:-4], pa.array(n, pa.int64()), pa.array(spans, hit_type), pa.array(items, pa.list_(pa.string())), part.columns[-1]]
            return pa.RecordBatch.from_arrays(columns, names=part.schema.names)

        for x in batches:
            texts, size, at = [], 0, 0
            for t in x.column(x.num_columns - 1):
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= SLAB_BYTES:
                    yield flush(x.slice(at, len(texts)), texts)
                    at, texts, size = at + len(texts), [], 0
            if texts:
                yield flush(x.slice(at, len(texts)), texts)

    return docs.mapInArrow(search, schema)


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", ident: str = "item_id", item_text: str = "text",
               window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """``docs`` with n_words, hits (stretches of word numbers, end excluded, that occurrences of benchmark windows
    cover) and items (sorted ids, as text, of the items with an occurrence)."""
    found = cut(windows(items, ident, item_text, window))
    groups = max(1, ceil_div(found.agg(F.sum(F.length("pattern") + F.length("item"))).first()[0] or 0, pattern_bytes))
    kept = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(OUTPUT).fields]
    rows = docs.select(*kept, *empty, text_or_empty(text).cast("binary").alias("__mf_text"))
    for number in range(groups):
        group = found.where(F.pmod(F.xxhash64("pattern"), F.lit(groups)) == number)
        rows = _pass(rows if number == 0 else cut(rows), [(bytes(r.pattern), r["item"]) for r in group.collect()])
    return rows.drop("__mf_text")
