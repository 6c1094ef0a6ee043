"""Suffix-array dedup: merged Burrows-Wheeler transforms find every repeated passage of ``LENGTH`` bytes.

What is asked of each byte offset p is whether the LENGTH bytes from p on start anywhere else too.

1. Routing. Every LENGTH-byte window picks an anchor: the least hash among its SEED-byte substrings
   (rightmost on ties). Equal windows pick equal anchors at equal places, so windows need only be
   compared under one anchor. A scan writes one narrow row per (document, anchor): the hash of the
   anchor, the hash of the piece (all windows that picked it) and where it lies. Anchors seen once are
   dropped; equal pieces are counted before they move.
2. Merging. The distinct pieces of an anchor come together in a task. They are dealt to shards, each
   shard gets its Burrows-Wheeler transform (of the cyclic shifts of its pieces, over symbols of STEP
   bytes), and the transforms are merged by iterative interleave refinement: the interleave starts as
   the shards one after another; each round reads the transforms in the order of the interleave and
   deals it out stably by symbol, which orders it by STEP more bytes. Block borders are carried along:
   two neighbours still in one block after LENGTH / STEP rounds have a common prefix of LENGTH bytes.
   No suffix is sorted again. Blocks that hold two windows, or one window of a piece that occurs twice,
   are repeated intervals.
3. The repeated windows go back to all places of their piece, and each document's spans are united.

An anchor with more than HOT distinct pieces meets in no task: its windows are cut into parts by their
place in steps of PART bytes. Equal windows share the part's core, the bytes that all windows of such a
step hold, so parts whose core is met once are dropped. Parts that are met again as a whole are repeated;
the windows of the others are counted one by one, by hash. Counts are added up before they move, so no
group of pieces grows with the table.

Defined results: null text is empty; texts under LENGTH bytes have no spans; rows that repeat in id
and text are repeats of each other; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import apart, bound_batches, cut, row_key, text_or_empty

LENGTH, SEED, STEP = 200, 50, 25
HOT, PART = 2000, 16
CHUNK = 1 << 17
BATCH = 60_000
ROWS = 5_000
SHARD = 16_384
_LOW = np.uint64((1 << 20) - 1)
_BASE, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Anchors of byte strings, many at a time."""

    def __init__(self):
        n = 2 * CHUNK
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text number, first window, anchor less first window, last window less first, anchor hash,
        piece hash) per anchor. All texts together hold fewer than 2 * CHUNK bytes."""
        joined = np.frombuffer(b"".join(texts), np.uint8)
        n = len(joined)
        if n < LENGTH:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        seeds = (sums[SEED:] - sums[:-SEED]) * self.down[:n - SEED + 1]
        seeds ^= seeds >> np.uint64(32)
        seeds *= np.uint64(0xBF58476D1CE4E5B9)
        seeds ^= seeds >> np.uint64(29)
        # the least hash, then the rightmost place, in one number; windowed by doubling
        least = (seeds & ~_LOW) | (_LOW - np.arange(len(seeds), dtype=np.uint64))
        width, want = 1, LENGTH - SEED + 1
        while width * 2 <= want:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if want > width:
            least = np.minimum(least[:-(want - width)], least[want - width:])
        at = (_LOW - (least & _LOW)).astype(np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)[:len(at)]
        inside = np.arange(len(at)) + LENGTH <= (starts + sizes)[owner]
        change = np.ones(len(at), bool)
        change[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(change)
        last = np.r_[first[1:], len(at)] - 1
        ok = inside[first]
        first, last = first[ok], last[ok]
        piece = (sums[last + LENGTH] - sums[first]) * self.down[first]
        piece = (piece ^ (piece >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + (last - first).astype(np.uint64)
        return owner[first], first - starts[owner[first]], at[first] - first, last - first, seeds[at[first]], piece


def _scan(texts: DataFrame) -> DataFrame:
    """(fp, ph, r1, r2, at): at holds the place of the first window in the text, how far the anchor lies
    behind it, and the number of windows less one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for x in batches:
            r1, r2 = x.column(0).to_numpy(), x.column(1).to_numpy()
            run: list[tuple[int, int, bytes]] = []
            size = 0

            def rows():
                number, place, gap, more, fp, ph = anchors.of([t for _, _, t in run])
                doc = np.array([d for d, _, _ in run], np.int64)[number]
                at = (np.array([o for _, o, _ in run], np.int64)[number] + place) << 17 | gap << 9 | more
                return pa.RecordBatch.from_arrays([pa.array(c) for c in (fp.view(np.int64), ph.view(np.int64), r1[doc], r2[doc], at)],
                                                  names=["fp", "ph", "r1", "r2", "at"])

            for d, body in enumerate(x.column(2)):
                view = body.as_buffer()
                if len(view) < LENGTH:
                    continue
                # a long text goes in runs of CHUNK windows, each with the bytes its last window needs
                for o in range(0, len(view) - LENGTH + 1, CHUNK):
                    part = view.slice(o, min(CHUNK + LENGTH - 1, len(view) - o)).to_pybytes()
                    if size + len(part) > CHUNK + LENGTH and run:
                        yield rows()
                        run, size = [], 0
                    run.append((d, o, part))
                    size += len(part)
            if run:
                yield rows()

    return texts.select("__mf_r1", "__mf_r2", "__mf_bytes").mapInArrow(scan, "fp long, ph long, r1 long, r2 int, at long")


def dense(x: np.ndarray) -> np.ndarray:
    """Equal values to equal small numbers, in 16 bits where they fit."""
    names, code = np.unique(x, return_inverse=True)
    return code.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32)


def step_symbols(text: np.ndarray, ahead) -> np.ndarray:
    """The STEP bytes from each place on (cyclic in its piece) as one small number, doubled up from 8."""
    eight = np.zeros(len(text), np.uint64)
    for j in range(8):
        eight = (eight << np.uint64(8)) | text[ahead(j)]
    code, width = dense(eight), 8
    while width < STEP:
        more = min(width, STEP - width)
        wide = code.astype(np.uint64)
        code, width = dense((wide << np.uint64(32)) | wide[ahead(more)]), width + more
    return code


def shard_transform(symbols: np.ndarray, ahead, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per shard, the places in the order of their next LENGTH bytes, and the transform: the symbol
    that comes before each of them. Shards follow each other."""
    order = np.arange(len(symbols))
    for k in range(LENGTH // STEP - 1, -1, -1):
        order = order[np.argsort(symbols[ahead(k * STEP)][order], kind="stable")]
    order = order[np.argsort(shard[order], kind="stable")]
    return order, symbols[ahead(-STEP)][order]


def merge_transforms(transforms: np.ndarray, shard_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement of transforms that follow each other. Returns the interleave (the shard of
    every place of the merged order) and the borders (true where the common prefix with the place
    before is under LENGTH bytes)."""
    interleave = np.repeat(np.arange(len(shard_sizes), dtype=np.uint16 if len(shard_sizes) < 1 << 16 else np.uint32), shard_sizes)
    block = np.zeros(len(interleave), np.int32)
    for _ in range(LENGTH // STEP):
        read = np.empty_like(transforms)
        read[np.argsort(interleave, kind="stable")] = transforms  # each shard's symbols in their own order
        to = np.argsort(read, kind="stable")
        interleave, symbol, block = interleave[to], read[to], block[to]
        border = np.ones(len(to), bool)
        border[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(border, dtype=np.int32)
    return interleave, border


def repeated_windows(pieces: list[bytes], weights: np.ndarray, n_windows: np.ndarray) -> list[np.ndarray]:
    """Per piece, which of its first n_windows offsets start a LENGTH-byte string that occurs twice,
    counting a piece ``weights`` times."""
    sizes = np.array([len(p) for p in pieces], np.int32)
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    text = np.frombuffer(b"".join(pieces), np.uint8)
    size, here = np.repeat(sizes, sizes), np.arange(len(text), dtype=np.int32)
    offset = here - np.repeat(starts.astype(np.int32), sizes)

    def ahead(n: int) -> np.ndarray:
        if n < 0:
            return here + n + size * (offset < -n)
        return here + n - size * (offset + n >= size) if n else here

    symbols = step_symbols(text, ahead)
    shard_of_piece = starts // SHARD
    shard = np.repeat(shard_of_piece, sizes).astype(np.uint16)
    order, transforms = shard_transform(symbols, ahead, shard)
    shard_sizes = np.bincount(shard)
    interleave, border = merge_transforms(transforms, shard_sizes)
    merged = np.empty_like(order)
    merged[np.argsort(interleave, kind="stable")] = order  # places of the text in merged order
    real = (offset < np.repeat(n_windows, sizes))[merged]
    interval = np.cumsum(border) - 1
    held = np.bincount(interval, np.repeat(weights, sizes)[merged] * real)
    hit = np.zeros(len(text), bool)
    hit[merged] = real & (held[interval] >= 2)
    return [hit[a:a + n] for a, n in zip(starts, n_windows)]


def runs(hit: np.ndarray) -> list[int]:
    """First, end, first, end, ... of the runs of true."""
    return np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0])).tolist()


def _pieces(joined: DataFrame) -> DataFrame:
    """Cuts the wanted pieces out of their text: (fp, ph, weight, piece)."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out: list[tuple] = []
            body, wanted = (x.column(x.schema.get_field_index(c)) for c in ("__mf_bytes", "__mf_wanted"))
            for d in range(len(x)):
                text = body[d].as_buffer().to_pybytes()
                for w in wanted[d].as_py():
                    place, more = w["at"] >> 17, w["at"] & 511
                    out.append((w["fp"], w["ph"], w["weight"], text[place:place + more + LENGTH]))
                if len(out) > ROWS:
                    yield batch(out)
                    out = []
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["fp", "ph", "weight", "piece"])

    return joined.mapInArrow(slices, "fp long, ph long, weight long, piece binary")


def _parts(joined: DataFrame) -> DataFrame:
    """Cuts the wanted pieces of hot anchors into parts of PART windows: (g, fp, ph, from, weight, part);
    g is the hash of the anchor, the place and the core of the part."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for x in batches:
            out: list[tuple] = []
            body, wanted = (x.column(x.schema.get_field_index(c)) for c in ("__mf_bytes", "__mf_wanted"))
            for d in range(len(x)):
                text = body[d].as_buffer().to_pybytes()
                for w in wanted[d].as_py():
                    place, more, fp = w["at"] >> 17, w["at"] & 511, w["fp"]
                    # the windows of a part share the bytes from the last one's start to the first one's end
                    anchor = place + (w["at"] >> 9 & 255)
                    near, far = anchor - place - more, anchor - place
                    for a in range(near // PART * PART, far + 1, PART):
                        low, high = anchor - min(far, a + PART - 1), anchor - max(near, a)
                        core = text[anchor - a:anchor - a - PART + 1 + LENGTH]
                        g = xxhash.xxh64_intdigest(core, fp & _ALL ^ a)
                        out.append((g - (g >> 63 << 64), fp, w["ph"], low - place, w["weight"], text[low:high + LENGTH]))
                if len(out) > ROWS:
                    yield batch(out)
                    out = []
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["g", "fp", "ph", "from", "weight", "part"])

    return joined.mapInArrow(slices, "g long, fp long, ph long, `from` int, weight long, part binary")


def _counted(parts: DataFrame) -> DataFrame:
    """(fp, ph, runs) of the pieces of hot anchors, as ``_merge``. A repeated row brings its parts twice,
    but its pieces weigh 2 already."""
    # dealt by the whole key: the counts and the joins read one exchange
    names = lambda x: (F.xxhash64(F.lit(1), x), F.xxhash64(F.lit(2), x))
    p1, p2 = names("part")
    parts = parts.select("*", p1.alias("p1"), p2.alias("p2")).repartition("fp", "ph", "from")
    shared = parts.groupBy(F.col("g").alias("core")).agg(F.sum("weight").alias("n")).where("n > 1").select("core")
    equal = parts.groupBy(F.col("p1").alias("e1"), F.col("p2").alias("e2")).agg(F.sum("weight").alias("n")).where("n > 1").select("e1", "e2")
    again = parts.join(apart(shared, "core"), F.col("g") == F.col("core")) \
        .join(apart(equal, "e1"), (F.col("p1") == F.col("e1")) & (F.col("p2") == F.col("e2")), "left") \
        .select("fp", "ph", "from", "weight", "part", F.col("e1").isNotNull().alias("whole")).repartition("fp", "ph", "from")
    w1, w2 = names(F.substring("part", F.col("i") + 1, F.lit(LENGTH)))
    windows = again.select("*", F.explode(F.sequence(F.lit(0), F.octet_length("part") - LENGTH)).alias("i")).select(
        "fp", "ph", "weight", "whole", (F.col("from") + F.col("i")).alias("place"), w1.alias("w1"), w2.alias("w2"))
    twice = windows.groupBy(F.col("w1").alias("t1"), F.col("w2").alias("t2")).agg(F.sum("weight").alias("n")).where("n > 1").select("t1", "t2")
    # a part that is met again as a whole needs no look at its windows
    hits = windows.where(~F.col("whole")).join(apart(twice, "t1"), (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")))
    one = hits.select("fp", "ph", F.array("place", F.col("place") + 1).alias("run"))
    all_of_it = again.where("whole").select("fp", "ph", F.array("from", F.col("from") + F.octet_length("part") - LENGTH + 1).alias("run"))
    # at most LENGTH - SEED + 1 runs a piece
    return one.unionByName(all_of_it).groupBy("fp", "ph").agg(F.flatten(F.collect_set("run")).alias("runs"))


def _merge(pieces: DataFrame) -> DataFrame:
    """(fp, ph, runs): the runs of repeated windows of every piece that has one. The pieces of an anchor
    (HOT at most) stream through in order of fp; whole anchors are merged together, about BATCH bytes at
    a time."""

    def solve(group: list, batch: dict) -> pa.RecordBatch:
        texts = list(batch)
        hits = repeated_windows([t for _, t in texts], np.array([batch[t][0] for t in texts], float),
                                np.array([len(t) - LENGTH + 1 for _, t in texts], np.int64))
        found = [runs(h) for h in hits]
        rows = [(fp, ph, found[batch[key][1]]) for fp, ph, key in group if found[batch[key][1]]]
        cols = list(zip(*rows)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32()))],
                                          names=["fp", "ph", "runs"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []  # (fp, ph, key) of every piece
        batch: dict[tuple, list] = {}  # key: weight, number; equal pieces of an anchor are one
        size, last, seen = 0, None, set()
        for x in batches:
            for fp, ph, weight, piece in zip(*[c.to_pylist() for c in x.columns]):
                if fp != last:
                    if size >= BATCH:
                        yield solve(group, batch)
                        group, batch, size = [], {}, 0
                    last, seen = fp, set()
                if ph in seen:  # a repeated row brings its pieces twice
                    continue
                seen.add(ph)
                key = (fp, piece)
                if key in batch:
                    batch[key][0] += weight
                else:
                    batch[key] = [weight, len(batch)]
                    size += len(piece)
                group.append((fp, ph, key))
        if group:
            yield solve(group, batch)

    return pieces.repartition("fp").sortWithinPartitions("fp").mapInArrow(stream, "fp long, ph long, runs array<int>")


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", whole_characters: bool = False) -> DataFrame:
    """``docs`` without ``text``, with n_bytes, n_removed, n_spans and kept (binary: the bytes that no
    repeated window covers). With ``whole_characters`` a character goes only if all its bytes go, so
    that kept is UTF-8 again."""
    bound_batches(docs.sparkSession)
    added = ("n_bytes", "n_removed", "n_spans", "kept")
    own = [c for c in docs.columns if c != text and c not in added]
    keys = row_key(ident, text_or_empty(text))
    body = text_or_empty(text).cast("binary").alias("__mf_bytes")
    scanned = _scan(docs.select(*keys, body))
    twice = scanned.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    places = cut(scanned.join(apart(twice, "fp"), "fp"))
    distinct = places.groupBy("fp", "ph").agg(F.count("*").alias("weight"), F.min(F.struct("r1", "r2", "at")).alias("x"))
    hot = distinct.groupBy("fp").agg((F.count("*") > HOT).alias("hot"))
    wanted = distinct.join(apart(hot, "fp"), "fp").groupBy(F.col("x.r1").alias("__mf_r1"), F.col("x.r2").alias("__mf_r2")).agg(
        F.collect_list(F.struct("fp", "ph", F.col("x.at").alias("at"), "weight", "hot")).alias("__mf_wanted"))
    # the same exchange of the texts serves the cutting of pieces and the removal
    texts = docs.select(*own, *keys, body)
    hot_or_not = lambda hot: wanted.withColumn("__mf_wanted", F.filter("__mf_wanted", lambda w: w.hot == F.lit(hot))).where(F.size("__mf_wanted") > 0)
    found = _merge(_pieces(texts.join(hot_or_not(False), ["__mf_r1", "__mf_r2"]))).unionByName(
        _counted(_parts(texts.join(hot_or_not(True), ["__mf_r1", "__mf_r2"]))))
    # rows equal in id and text bring equal places: the set holds each once
    spans = places.join(found, ["fp", "ph"]).groupBy(F.col("r1").alias("__mf_r1"), F.col("r2").alias("__mf_r2")).agg(
        F.collect_set(F.struct(F.shiftright("at", 17).alias("place"), "runs")).alias("__mf_spans"))
    joined = texts.join(spans, ["__mf_r1", "__mf_r2"], "left").select(*own, "__mf_bytes", "__mf_spans")

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out: list[tuple] = []
            for body, spans in zip(x.column(len(own)), x.column(len(own) + 1)):
                whole = body.as_py()
                kept, removed, count = without(whole, spans.as_py(), whole_characters) if spans.is_valid else (whole, 0, 0)
                out.append((len(whole), removed, count, kept))
            cols = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([*x.columns[:len(own)], *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                                             names=[*own, *added])

    schema = StructType([*joined.schema.fields[:len(own)], *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary").fields])
    return joined.mapInArrow(trim, schema)


def without(whole: bytes, spans: list[dict], whole_characters: bool) -> tuple[bytes, int, int]:
    """The bytes that no repeated window covers, how many are covered and in how many spans."""
    edge = np.zeros(len(whole) + 1, np.int64)
    for s in spans:
        marks = np.array(s["runs"], np.int64) + s["place"]
        np.add.at(edge, marks[::2], 1)
        np.add.at(edge, marks[1::2] - 1 + LENGTH, -1)
    cover = np.cumsum(edge[:-1]) > 0
    data = np.frombuffer(whole, np.uint8)
    if whole_characters:
        start = (data & 0xC0) != 0x80
        start[:1] = True
        cover = np.logical_and.reduceat(cover, np.flatnonzero(start))[np.cumsum(start) - 1]
    return data[~cover].tobytes(), int(cover.sum()), len(runs(cover)) // 2
