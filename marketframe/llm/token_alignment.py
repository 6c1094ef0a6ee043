"""Cross-tokenizer alignment.

Two tokenizers cut the same bytes (a blank and the text) differently. For each batch the tokens of both sides
become tables (document, first byte), and pandas ``merge_asof``, keyed by document, finds for each token's
start the other side's token that covers it. The union of both directions is every overlap; overlapping tokens
with equal ends close a group. All tokens A and B of a group are linked.

``align`` returns the groups. ``link_statistics`` adds corpus-wide counts: an id pair's count is the number of
documents that hold it linked. Its steps:

1. one scan aligns and writes, for each document, its figures and its distinct id pairs, as numbers in a
   table of the pairs of its block (a run of documents of one task, ``BLOCK_PAIRS`` pairs);
2. the blocks' tables, which hold each pair once, are summed by pair, the greatest count of each A id is
   found, and both go back to the blocks that hold the pair;
3. each block's documents meet the block's counts in one group.

So neither tokens nor pairs of documents are ever rows of a shuffle, and nothing is collected or broadcast.

Texts are cut, before both tokenizers see them, at blanks that follow a character that is no white space.
There a byte-level pre-tokenizer begins anew, and no piece of the other vocabulary crosses the place (checked
when it is loaded; else texts stay whole). Each distinct part is encoded once and remembered
(``CACHE_PARTS``).

Defined results: texts that are null, empty, or whose joined tokens are not the bytes of a blank and the text
have no tokens: zeros, and '' for the groups. Rows are counted one by one, so repeated rows and null ids count
like others; an empty table gives an empty result. Columns of the input, but for the text, are passed on;
those named like an output are replaced. A group of very many tokens is expanded from its distinct ids, in
runs of ``RUN_PAIRS`` pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import apart, checkpoint_dir, text_or_empty

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
SLAB_CHARS, CACHE_PARTS, CHUNK_PARTS, BLOCK_PAIRS, RUN_PAIRS, LARGE_GROUP = 300_000, 200_000, 256, 1_500_000, 1_000_000, 4096
FIGURES = "n_a long, n_b long, n_groups long, n_links long"
_ODD = re.compile(r"\s |\A | \Z")
_CUT = re.compile(r"(?<=\S)(?= +[^ ])")


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the
    others follow each other from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Growing:
    """Token ids of the parts seen, end to end."""

    def __init__(self):
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.sizes = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.sizes, sizes.astype(np.int32)])

    def of(self, parts: np.ndarray, first: np.ndarray) -> np.ndarray:
        count = self.sizes[parts].astype(np.int64)
        skip = first[parts] - (np.cumsum(count) - count)
        return self.ids[np.repeat(skip, count) + np.arange(int(count.sum()))].astype(np.int64)


def _same_bytes(lists: list[list[int]], table: list[bytes], sizes: np.ndarray, want: list[bytes]) -> np.ndarray:
    """Whether the tokens of each list are the wanted bytes."""
    flat = [i for x in lists for i in x]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    got = np.bincount(owner, sizes[np.array(flat, np.int64)], len(lists)).astype(np.int64)
    length = np.array([len(w) for w in want], np.int64)
    same = got == length
    left, right = (np.frombuffer(b"".join(x), np.uint8) for x in (map(table.__getitem__, flat), want))
    left, right = left[np.repeat(same, got)], right[np.repeat(same, length)]
    same[np.repeat(np.flatnonzero(same), length[same])[left != right]] = False
    return same


class Tokenizers:
    """Both tokenizers, and what they made of the parts seen so far."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        chars = byte_characters()
        n = self.a.get_vocab_size()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [t.encode() if t in special else bytes(chars[c] for c in t) for t in map(self.a.id_to_token, range(n))]
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_len, self.b_len = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        before = json.loads(self.a.to_str())["pre_tokenizer"] or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") \
            and not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(self.b_bytes)))
        # how tokens are written: an A token goes on or ends its side, a B token goes on or ends its group
        self.shown = np.array([f"{i}{mark}" for size, marks in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;"))
                               for mark in marks for i in range(size)], object)
        self.forget()

    def forget(self) -> None:
        self.parts: dict[str, int] = {}
        self.tokens_a, self.tokens_b, self.whole = _Growing(), _Growing(), np.zeros(0, bool)

    def cut(self, text: str) -> list[str]:
        """The parts of a blank and the text, each without its first blank."""
        if not self.cuts:
            return [text]
        return [p[1:] for p in _CUT.split(" " + text)] if _ODD.search(text) else text.split(" ")

    def _encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids A and B of a blank and each text (B puts the blank there itself), and whether both are its bytes."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b, want = self.b.encode(texts, num_threads=1), [(" " + t).encode() for t in texts]
        return a, b, _same_bytes(a, self.a_bytes, self.a_len, want) & _same_bytes(b, self.b_bytes, self.b_len, want)

    def learn(self, parts: list[str]) -> None:
        """Encodes the parts not known yet, many in a chunk: at a blank between two of them both tokenizers cut."""
        new = list(set(parts).difference(self.parts))
        if not new:
            return
        plain = [p for p in new if self.cuts and p and not p[0].isspace() and not p[-1].isspace()]
        chunks = [plain[i:i + CHUNK_PARTS] for i in range(0, len(plain), CHUNK_PARTS)]
        a, b, same = self._encode([" ".join(c) for c in chunks])
        chosen = [c for c, ok in zip(chunks, same) if ok]
        known = [p for c in chosen for p in c]
        ends = np.cumsum([len(p.encode()) + 1 for p in known]) if known else np.zeros(0, np.int64)
        sides = []
        for lists, sizes in ((a, self.a_len), (b, self.b_len)):
            ids = np.array([i for x, ok in zip(lists, same) if ok for i in x], np.int64)
            reach = np.cumsum(sizes[ids])
            # every part ends where one of the tokens does
            last = np.searchsorted(reach, ends)
            if len(ends) and not (reach[last] == ends).all():
                known, sides = [], []
                break
            sides.append((ids, np.diff(last, prepend=-1)))
        known_set = set(known)
        rest = [p for p in new if p not in known_set]
        if known:
            for side, (ids, sizes) in zip((self.tokens_a, self.tokens_b), sides):
                side.add(ids, sizes)
        a, b, alike = self._encode(rest)
        for side, lists in ((self.tokens_a, a), (self.tokens_b, b)):
            side.add(np.array([i for x in lists for i in x], np.int64), np.array([len(x) for x in lists], np.int64))
        for p in (*known, *rest):
            self.parts[p] = len(self.parts)
        self.whole = np.concatenate([self.whole, np.ones(len(known), bool), alike])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids A, documents A, ids B, documents B) of the texts' tokens; a text is a document."""
        if len(self.parts) > CACHE_PARTS:
            self.forget()
        cut = [self.cut(t) if t else [] for t in texts]
        flat = [p for c in cut for p in c]
        self.learn(flat)
        part = np.fromiter(map(self.parts.__getitem__, flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        firsts = [np.cumsum(t.sizes) - t.sizes for t in (self.tokens_a, self.tokens_b)]
        for d in np.unique(doc[~self.whole[part]]).tolist():
            own = part[doc == d]
            sides = [b"".join([table[i] for i in t.of(own, first).tolist()])
                     for t, first, table in zip((self.tokens_a, self.tokens_b), firsts, (self.a_bytes, self.b_bytes))]
            if not sides[0] == sides[1] == (" " + texts[d]).encode():
                part, doc = part[doc != d], doc[doc != d]
        return tuple(x for t, first in zip((self.tokens_a, self.tokens_b), firsts) for x in (t.of(part, first), np.repeat(doc, t.sizes[part])))


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(*paths: str) -> Tokenizers:
    if paths not in _LOADED:
        _LOADED[paths] = Tokenizers(*paths)
    return _LOADED[paths]


def close_groups(start_a: np.ndarray, end_a: np.ndarray, doc_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray,
                 doc_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each token A, and each token B, is the last one of its side of a group."""
    a = pd.DataFrame({"at": start_a, "doc": doc_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"at": start_b, "doc": doc_b, "b": np.arange(len(start_b))})
    cover_a = pd.merge_asof(a, b, on="at", by="doc")["b"].to_numpy()
    cover_b = pd.merge_asof(b, a, on="at", by="doc")["a"].to_numpy()
    later = start_b != start_a[cover_b]  # the others are overlaps found before
    pair_a, pair_b = np.r_[a["a"].to_numpy(), cover_b[later]], np.r_[cover_a, b["b"].to_numpy()[later]]
    equal = end_a[pair_a] == end_b[pair_b]
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[pair_a[equal]] = True
    last_b[pair_b[equal]] = True
    return last_a, last_b


def _condensed(group: np.ndarray, ids: np.ndarray, large: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times): tokens as they are, but each distinct id of a large group once."""
    if not large.any():
        return group, ids, np.ones(len(ids), np.int64)
    many = large[group]
    key, times = np.unique(group[many] * size + ids[many], return_counts=True)
    group = np.r_[group[~many], key // size]
    order = np.argsort(group, kind="stable")
    return group[order], np.r_[ids[~many], key % size][order], np.r_[np.ones(int((~many).sum()), np.int64), times][order]


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(times, first) if len(first) else times


class Aligned:
    """The alignment of a run of texts: figures of each, its id pairs, and its groups as text."""

    def __init__(self, tokenizers: Tokenizers, texts: list[str]):
        self.tokenizers, self.n = tokenizers, len(texts)
        self.a, self.doc_a, self.b, self.doc_b = tokenizers.encode(texts)
        size_a, size_b = tokenizers.a_len[self.a], tokenizers.b_len[self.b]
        # both sides have the same bytes, so that places in all texts laid end to end agree
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        self.last_a, self.last_b = close_groups(end_a - size_a, end_a, self.doc_a, end_b - size_b, end_b, self.doc_b)
        self.group_a, self.group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        self.doc = self.doc_a[self.last_a]
        self.in_a, self.in_b = (np.bincount(g, minlength=len(self.doc)) for g in (self.group_a, self.group_b))

    def figures(self) -> list[np.ndarray]:
        """n_a, n_b, n_groups, n_links of each text."""
        links = np.zeros(self.n, np.int64)
        np.add.at(links, self.doc, self.in_a * self.in_b)
        return [np.bincount(d, minlength=self.n) for d in (self.doc_a, self.doc_b, self.doc)] + [links]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair number a * |B| + b, number of links), sorted by text and pair."""
        wide_a, wide_b = len(self.tokenizers.a_bytes), len(self.tokenizers.b_bytes)
        large = self.in_a * self.in_b > LARGE_GROUP
        group, a, times_a = _condensed(self.group_a, self.a, large, wide_a)
        group_b, b, times_b = _condensed(self.group_b, self.b, large, wide_b)
        in_b = np.bincount(group_b, minlength=len(self.doc))
        first_b = np.cumsum(in_b) - in_b
        reach = np.cumsum(in_b[group])
        runs, at = [], 0
        while at < len(group):
            stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + RUN_PAIRS, side="right")))
            count = in_b[group[at:stop]]
            own = np.repeat(np.arange(at, stop), count)
            other = np.repeat(first_b[group[at:stop]] - (np.cumsum(count) - count), count) + np.arange(len(own))
            key = (self.doc[group[own]] * wide_a + a[own]) * wide_b + b[other]
            runs.append(_summed(key, times_a[own] * times_b[other]))
            at = stop
        key, times = runs[0] if len(runs) == 1 else _summed(*(np.concatenate(x) for x in zip(*runs))) if runs else (np.zeros(0, np.int64),) * 2
        return key // (wide_a * wide_b), key % (wide_a * wide_b), times

    def shown(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        wide_a, wide_b = len(self.tokenizers.a_bytes), len(self.tokenizers.b_bytes)
        code = np.zeros(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + (np.cumsum(self.in_b) - self.in_b)[self.group_a]] = self.a + wide_a * self.last_a
        code[np.arange(len(self.b)) + np.cumsum(self.in_a)[self.group_b]] = 2 * wide_a + self.b + wide_b * self.last_b
        written = self.tokenizers.shown[code].tolist()
        ends = np.cumsum(sum(np.bincount(d, minlength=self.n) for d in (self.doc_a, self.doc_b))).tolist()
        return ["".join(written[s:e])[:-1] for s, e in zip([0, *ends], ends)]


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes, seven bits each, the least first, the high bit set but in the last; and how many each takes."""
    size = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        on = size > k
        out[first[on] + k] = (numbers[on] >> 7 * k & 127) | ((size[on] > k + 1) << 7)
    return out, size


def unpacked(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(x < 128)
    first = np.r_[0, last[:-1] + 1] if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        on = first + k <= last
        out[on] |= (x[first[on] + k].astype(np.int64) & 127) << 7 * k
    return out


def _runs(column: pa.Array) -> Iterator[list[str]]:
    run, size = [], 0
    for t in column:
        run.append(t.as_py())
        size += len(run[-1])
        if size > SLAB_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def _rows(docs: DataFrame, text: str, outputs: str) -> tuple[DataFrame, StructType]:
    added = StructType.fromDDL(outputs).fields
    kept = [c for c in docs.columns if c != text and c not in {f.name for f in added}]
    rows = docs.select(*kept, text_or_empty(text).alias("__mf_text"))
    return rows, StructType([*rows.schema.fields[:-1], *added])


def align(docs: DataFrame, text: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """``docs`` without the text, with n_a, n_b (tokens), n_groups, n_links and groups: ids A and B of every
    group in order, as ``a1,a2|b1;a3|b2,b3``."""
    rows, schema = _rows(docs, text, f"{FIGURES}, groups string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _tokenizers(byte_level, pieces)
        for x in batches:
            at = 0
            for texts in _runs(x.column(x.num_columns - 1)):
                found = Aligned(tokenizers, texts)
                columns = [*map(pa.array, found.figures()), pa.array(found.shown(), pa.string())]
                yield pa.RecordBatch.from_arrays([*x.slice(at, len(texts)).columns[:-1], *columns], names=schema.names)
                at += len(texts)

    return rows.mapInArrow(run, schema)


_BLOCK = "__mf_block long, __mf_first binary, __mf_times binary"


def _scanned(docs: DataFrame, text: str, byte_level: str, pieces: str) -> DataFrame:
    """Rows of documents: figures, groups_sha256, block, and the document's pairs (steps between their numbers in
    the block's table; times less one). For each block a row more, with __mf_table true: its pairs (steps between
    pair numbers) and in how many documents each is."""
    rows, schema = _rows(docs, text, f"{FIGURES}, groups_sha256 string, __mf_table boolean, {_BLOCK}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, blocks = _tokenizers(byte_level, pieces), 0

        def block(held: list[tuple[list[pa.Array], int, list[pa.Array], np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32 | blocks
            table, local, seen = np.unique(np.concatenate([h[4] for h in held]), return_inverse=True, return_counts=True)
            at = 0
            for kept, n, columns, doc, pair, times in held:
                own = local[at:at + len(pair)]
                at += len(pair)
                new = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
                steps = np.r_[own[:1], np.diff(own)]
                steps[new] = own[new]
                count = np.bincount(doc, minlength=n)
                blobs = []
                for numbers in (steps, times - 1):
                    data, size = packed(numbers)
                    ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(count)]].tolist()
                    blobs.append(pa.array([data[s:e].tobytes() for s, e in zip(ends, ends[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [*kept, *columns, pa.array([False] * n), pa.array([number] * n, pa.int64()), *blobs],
                    names=schema.names)
            last = [pa.nulls(1, c.type) for c in (*kept, *columns)]
            last += [pa.array([True]), pa.array([number], pa.int64())]
            last += [pa.array([packed(numbers)[0].tobytes()], pa.binary()) for numbers in (np.diff(table, prepend=0), seen)]
            yield pa.RecordBatch.from_arrays(last, names=schema.names)

        held, size = [], 0
        for x in batches:
            at = 0
            for texts in _runs(x.column(x.num_columns - 1)):
                found = Aligned(tokenizers, texts)
                hashes = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in found.shown()]
                # copies: a column of the batch would keep all of it
                held.append(([c.take(pa.array(np.arange(at, at + len(texts)))) for c in x.columns[:-1]], len(texts), [*map(pa.array, found.figures()), pa.array(hashes, pa.string())], *found.pairs()))
                size += len(held[-1][4])
                at += len(texts)
                if size >= BLOCK_PAIRS:
                    yield from block(held)
                    held, size, blocks = [], 0, blocks + 1
        if held:
            yield from block(held)

    return rows.mapInArrow(run, schema)


def link_statistics(docs: DataFrame, text: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """``docs`` without the text, with n_a, n_b, n_groups, n_links, groups_sha256 (of ``align``'s groups; '' without
    tokens), n_best (links whose pair has its A id's greatest count) and count_sum (of the counts of all links)."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/token_alignment-{uuid.uuid4().hex}"
    _scanned(docs.drop("n_best", "count_sum"), text, byte_level, pieces).write.option("compression", "zstd").parquet(path)
    table = spark.read.parquet(path)
    wide_b = len(_tokenizers(byte_level, pieces).b_bytes)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for number, steps, seen in zip(*(c.to_pylist() for c in x.columns)):
                pair, seen = np.cumsum(unpacked(steps)), unpacked(seen)
                for at in range(0, len(pair), 100_000):
                    some = pair[at:at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array(np.arange(at, at + len(some))),
                                                      pa.array(some), pa.array(seen[at:at + 100_000])], names=["block", "at", "pair", "seen"])

    asked = table.where("__mf_table").select("__mf_block", "__mf_first", "__mf_times").mapInArrow(
        listed, "block long, at long, pair long, seen long")
    counts = asked.groupBy("pair").agg(F.sum("seen").alias("count")).withColumn("a", F.expr(f"pair div {wide_b}"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    counts = counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.select("block", "at", "pair").join(apart(counts, "pair"), "pair").select("block", "at", "count", "best")
    own = [c for c in table.columns if not c.startswith("__mf_")]
    schema = StructType([*table.select(*own).schema.fields, *StructType.fromDDL("n_best long, count_sum long").fields])

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right.column("at").to_numpy()
        count[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy()
        sums: list[list[int]] = [[], []]
        for steps, times in zip(left.column("__mf_first"), left.column("__mf_times")):
            pair, times = np.cumsum(unpacked(steps.as_py())), unpacked(times.as_py()) + 1
            for out, value in zip(sums, (best, count)):
                out.append(int((value[pair] * times).sum()))
        return left.select(own).append_column("n_best", pa.array(sums[0], pa.int64())).append_column("count_sum", pa.array(sums[1], pa.int64()))

    return table.where("not __mf_table").groupBy("__mf_block").cogroup(answers.groupBy("block")).applyInArrow(answered, schema)
