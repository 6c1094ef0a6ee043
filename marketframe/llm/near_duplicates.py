"""N-gram Jaccard join by MinHash banding.

Documents are sets of five-word shingles (words parted by blanks and control spaces, case kept; a
shorter text is one shingle). Documents with equal sets are one class. Classes that agree in a band of
MinHash values are candidates; the number of bands is the least that reaches ``RECALL`` at the
threshold (``choose_bands``). Every candidate pair is verified on the full sets, inside blocks, and
only counts and links to the least partner leave a task, so a large group of near copies never becomes
rows for all its pairs.

Steps: one scan makes signatures; band values are joined to the least class of their bucket (a star,
not all pairs); the stars' connected components bound where partners can be. Each component has a hub (its
least class), and the full set of every other class is written as its difference from the hub's: two sorted
lists, which for near copies are a few numbers in place of the set. Exact shared counts follow from the
differences alone. Components are cut into blocks by bytes and classes (``BLOCK_BYTES``, ``BLOCK``), and every
pair of blocks is compared in one task, in tiles; a near-copy group of some thousand documents is one block, so
that what is shuffled grows with the sets, each moved once, and not with the square of a group.

Defined results: null and empty texts are one class without links; repeated rows are one class; null
ids are counted like others (class_id and group_id are the least id that is not null, else null); an
empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD_GAP, apart, bound_batches, ceil_div, cut, row_key, text_or_empty
from .components import components

SHINGLE, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.99999, 4
CHUNK_WORDS, CACHE_WORDS, HUB_CLASSES = 100_000, 50_000, 512
BLOCK, BLOCK_BYTES, TILE, COLUMNS, PAIRS = 4096, 6_000_000, 512, 1024, 250_000
_GAPS = str.maketrans({c: " " for c in WORD_GAP})
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands that finds a pair at the threshold with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts. Remembers word hashes up to a bound."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def word_hashes(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > CACHE_WORDS:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        words: list[str] = []
        ends = [0]
        for t in texts:
            words += [w for w in t.translate(_GAPS).split(" ") if w]
            ends.append(len(words))
        h, out = self.word_hashes(words), []
        base, whole = np.uint64(0x9E3779B97F4A7C15), np.zeros(0, np.uint64)
        if len(h) >= SHINGLE:
            whole = h[:len(h) - SHINGLE + 1].copy()
            for j in range(1, SHINGLE):
                whole *= base
                whole += h[j:len(h) - SHINGLE + 1 + j]
            whole = mixed(whole)
        for a, b in zip(ends, ends[1:]):
            if b - a >= SHINGLE:
                out.append(np.unique(whole[a:b - SHINGLE + 1]))
            else:
                short = b - a
                for x in h[a:b].tolist():
                    short = (short * int(base) + x) & 0xFFFFFFFFFFFFFFFF
                out.append(mixed(np.array([short], np.uint64)) if b > a else np.zeros(0, np.uint64))
        return out


def text_chunks(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch in runs of about CHUNK_WORDS words, to bound memory."""
    run, size = [], 0
    for t in column:
        run.append(t.as_py() or "")
        size += len(run[-1])
        if size > 6 * CHUNK_WORDS:
            yield run
            run, size = [], 0
    if run:
        yield run


def signatures(docs: DataFrame, ident: str, text: str, bands: int) -> DataFrame:
    """(id, row key, s1, s2: 128 bits that name the shingle set, bands: one value per band, null when
    there is no shingle)."""
    rng = np.random.default_rng(8)
    factors = rng.integers(0, 2**63, bands * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, bands * ROWS, dtype=np.uint64)
    rows = docs.select(F.col(ident).alias("id"), *row_key(ident, text_or_empty(text)), text_or_empty(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for x in batches:
            at = 0
            for texts in text_chunks(x.column(3)):
                sets = shingler.sets(texts)
                part, full = x.slice(at, len(texts)), np.array([len(s) > 0 for s in sets])
                at += len(texts)
                s1, s2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                values = np.zeros((len(sets), bands), np.uint64)
                if full.any():
                    flat = np.concatenate(sets)
                    starts = np.cumsum([0, *[len(s) for s in sets if len(s)]])[:-1]
                    s1[full] = np.add.reduceat(mixed(flat), starts)
                    s2[full] = np.add.reduceat(mixed(flat ^ _M2), starts)
                    for b in range(bands):
                        v = np.full(len(starts), np.uint64(b + 1))
                        for r in range(b * ROWS, (b + 1) * ROWS):
                            v = mixed(v * _M1 + np.minimum.reduceat(flat * factors[r] + shifts[r], starts))
                        values[full, b] = v
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(values.ravel().view(np.int64)))
                lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(~full))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists],
                                                 names=["id", "__mf_r1", "__mf_r2", "s1", "s2", "bands"])

    schema = StructType([*rows.schema.fields[:3], *StructType.fromDDL("s1 long, s2 long, bands array<long>").fields])
    return rows.mapInArrow(sign, schema)


def shared_counts(flat: np.ndarray, owner: np.ndarray, left: int, right: int) -> np.ndarray:
    """Matrix (left, right): how many values members x < left and left + y have in common. ``flat`` holds the
    members' distinct values end to end, ``owner`` the member of each. Values that many members hold are counted
    by dense products over runs of COLUMNS values, the others by their pairs, in runs of PAIRS."""
    shared = np.zeros((left, right), np.float32)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    code = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(flat)]))
    on_left = owner < left
    n_left, n_right = (np.bincount(code[m], minlength=len(first)) for m in (on_left, ~on_left))
    both = (n_left > 0) & (n_right > 0)
    dense = both & (n_left * n_right > 0.02 * left * right)
    names = np.cumsum(dense) - 1
    keep = dense[code]
    number, member = names[code[keep]], owner[keep]
    for at in range(0, int(dense.sum()), COLUMNS):
        a, b = np.searchsorted(number, [at, at + COLUMNS])
        x = np.zeros((left + right, min(COLUMNS, int(dense.sum()) - at)), np.float32)
        x[member[a:b], number[a:b] - at] = 1
        shared += x[:left] @ x[left:].T
    # the members on the right of each value lie end to end, and each member on the left meets them
    rare = (both & ~dense)[code]
    rows, row_code, cols = owner[rare & on_left], code[rare & on_left], owner[rare & ~on_left] - left
    count = np.where(both & ~dense, n_right, 0)
    begin, reach = (np.cumsum(count) - count)[row_code], np.cumsum(count[row_code])
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + PAIRS, side="right")))
        own = count[row_code[at:stop]]
        place = np.repeat(begin[at:stop] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        np.add.at(shared.reshape(-1), np.repeat(rows[at:stop], own) * right + cols[place], np.float32(1))
        at = stop
    return shared


class Members:
    """Classes of one component, by their differences from its hub: ``listed``, places in the hub's set, are those
    that the class lacks, or those that it has (``has``); ``extra`` are its shingles that the hub lacks."""

    def __init__(self, hub_size: int, sizes: np.ndarray, has: np.ndarray, listed: list[np.ndarray], extra: list[np.ndarray]):
        self.hub_size, self.sizes, self.has, self.listed, self.extra = hub_size, sizes, has, listed, extra

    def linked(self, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
        """Boolean matrix: true where members x and y reach the threshold."""
        if min(self.sizes[x].max(), self.sizes[y].max()) < threshold * max(self.sizes[x].min(), self.sizes[y].min()) - 1e-9:
            return np.zeros((len(x), len(y)), bool)

        def counts(lists: list[np.ndarray]) -> np.ndarray:
            own = [lists[k] for k in (*x, *y)]
            return shared_counts(np.concatenate(own), np.repeat(np.arange(len(own)), [len(v) for v in own]), len(x), len(y))

        n = np.array([len(v) for v in self.listed], np.float64)
        common, has_x, has_y = counts(self.listed).astype(np.float64), self.has[x][:, None], self.has[y][None, :]
        n_x, n_y = n[x][:, None], n[y][None, :]
        # places of the hub that both have, by what their lists say
        in_hub = np.where(has_x & has_y, common, np.where(has_x, n_x - common, np.where(has_y, n_y - common, self.hub_size - n_x - n_y + common)))
        shared = in_hub + counts(self.extra)
        union = self.sizes[x][:, None] + self.sizes[y][None, :] - shared
        return (shared >= threshold * union - 1e-9) & (union > 0)


def differences(hub: np.ndarray, own: np.ndarray) -> tuple[bool, np.ndarray, np.ndarray]:
    """(has, listed, extra) of a sorted set against the hub's."""
    inside = np.isin(hub, own, assume_unique=True)
    has = bool(2 * int(inside.sum()) < len(hub))
    return has, np.flatnonzero(inside if has else ~inside).astype(np.uint32), own[~np.isin(own, hub, assume_unique=True)]


def local_roots(names: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The least name that each member reaches through the pairs (member, member)."""
    root = names.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, pairs[:, 0], before[pairs[:, 1]])
        np.minimum.at(root, pairs[:, 1], before[pairs[:, 0]])
        if (before == root).all():
            return root


_DIFFERENCE = "comp long, s1 long, s2 long, size int, hub int, has boolean, listed binary, extra binary"


def _differences(sets: DataFrame) -> DataFrame:
    """Every class against its component's hub; sets: comp, s1, s2, members (of the component), items."""
    parts = F.ceil(F.col("members") / HUB_CLASSES).cast("int")
    # a large component's classes are dealt to several copies of the hub
    hubs = sets.where("s1 = comp").groupBy("comp").agg(F.min_by("items", "s2").alias("hub"), F.first(parts).alias("parts"))
    hubs = hubs.select("comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "hub")
    rows = sets.withColumn("part", F.pmod(F.xxhash64("s1", "s2"), parts).cast("int")).join(hubs, ["comp", "part"]) \
        .select("comp", "s1", "s2", "hub", "items")

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, HUB_CLASSES):
                part, out = x.slice(at, HUB_CLASSES), []
                for hub, own in zip(part.column(3), part.column(4)):
                    hub, own = (np.frombuffer(v.as_buffer(), np.uint64) for v in (hub, own))
                    has, listed, extra = differences(hub, own)
                    out.append((len(own), len(hub), has, listed.tobytes(), extra.tobytes()))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=["comp", "s1", "s2", "size", "hub", "has", "listed", "extra"])

    return rows.mapInArrow(against, _DIFFERENCE)


def _verify(members: DataFrame, threshold: float) -> DataFrame:
    """(s1, s2, links, root, several) per class and task; members: g, i, j, blk and the columns of _differences."""

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        comp, s1, s2, blk, size, hub = (table.column(c).to_numpy() for c in ("comp", "s1", "s2", "blk", "size", "hub"))
        has, listed, extra = np.array(table.column("has").to_pylist(), bool), table.column("listed"), table.column("extra")
        order, out = np.lexsort((size, blk, comp)), []
        for own in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            left = int((blk[own] == i).sum()) if j > i >= 0 else 0
            if len(own) < 2 or j > i >= 0 and left in (0, len(own)):
                continue
            lists = [[np.frombuffer(c[int(k)].as_buffer(), t) for k in own] for c, t in ((listed, np.uint32), (extra, np.uint64))]
            members, links, root = Members(int(hub[own[0]]), size[own], has[own], *lists), np.zeros(len(own), np.int64), s1[own].copy()
            tiles = [np.arange(a, min(a + TILE, len(own))) for a in range(0, len(own), TILE)]
            if left:
                tiles = [t for t in (*(np.arange(a, min(a + TILE, left)) for a in range(0, left, TILE)),
                                     *(np.arange(a, min(a + TILE, len(own))) for a in range(left, len(own), TILE)))]
            for n, x in enumerate(tiles):
                for y in tiles[n:]:
                    if left and (x[0] < left) == (y[0] < left):
                        continue  # pairs inside a block are counted where the block meets itself
                    hit = members.linked(x, y, threshold)
                    if x is y:
                        np.fill_diagonal(hit, False)
                    else:
                        links[y] += hit.sum(axis=0)
                    links[x] += hit.sum(axis=1)
                    pairs = np.argwhere(hit)
                    if len(pairs):
                        root = local_roots(root, np.stack([x[pairs[:, 0]], y[pairs[:, 1]]], axis=1))
            out.append((s1[own], s2[own], links, root))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([*map(pa.array, cols), pa.array(np.full(len(cols[0]), i >= 0))], names=["s1", "s2", "links", "root", "several"])

    return members.groupBy("g", "i", "j").applyInArrow(compare, "s1 long, s2 long, links long, root long, several boolean")


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    recall: float = RECALL) -> DataFrame:
    """One row per document: id, __mf_r1, __mf_r2 (its row key), class_id (least id with an equal shingle
    set), n_links (other classes at the threshold), group_id (least id of its connected group), and
    root, a number that names the group."""
    bound_batches(docs.sparkSession)
    signed = cut(signatures(docs, ident, text, choose_bands(threshold, recall)))
    classes = cut(signed.groupBy("s1", "s2").agg(F.min("id").alias("class_id"), F.first("bands").alias("bands"),
                                                 F.min(F.struct("__mf_r1", "__mf_r2")).alias("r")))
    in_bands = classes.select("s1", F.explode("bands").alias("band"))
    hubs = in_bands.groupBy("band").agg(F.min("s1").alias("hub"), F.max("s1").alias("far")).where("hub <> far").drop("far")
    stars = in_bands.join(apart(hubs, "band"), "band").select(F.col("s1").alias("u"), F.col("hub").alias("v"))
    found = components(stars)
    sizes = found.groupBy("root").count()
    needed = (classes.select("s1", "s2", F.col("r.__mf_r1"), F.col("r.__mf_r2"))
              .join(found.join(apart(sizes, "root"), "root").select(F.col("node").alias("s1"), F.col("root").alias("comp"), F.col("count").alias("members")), "s1"))
    texts = docs.select(*row_key(ident, text_or_empty(text)), text_or_empty(text).alias("text"))
    # rows equal in id and text bring a class more than once
    rows = texts.join(needed, ["__mf_r1", "__mf_r2"]).select("comp", "s1", "s2", "members", "text").dropDuplicates(["s1", "s2"])

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for x in batches:
            at = 0
            for run in text_chunks(x.column(4)):
                items = pa.array([s.tobytes() for s in shingler.sets(run)], pa.binary())
                yield pa.RecordBatch.from_arrays([*x.slice(at, len(run)).columns[:4], items], names=[*x.schema.names[:4], "items"])
                at += len(run)

    sets = cut(rows.mapInArrow(shingle, "comp long, s1 long, s2 long, members long, items binary"))
    compact = cut(_differences(sets)).withColumn("bytes", 100 + F.octet_length("listed") + F.octet_length("extra"))
    weights = compact.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("nb"),
                                          F.sum("bytes").alias("bytes"))
    weights = cut(weights)
    shared_tasks = ceil_div(weights.where("nb = 1").agg(F.sum("bytes")).first()[0] or 0, BLOCK_BYTES) or 1
    one = F.col("nb") == 1
    # small components share tasks; a block of a large one meets each block of its component
    other = F.explode(F.when(one, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("nb") - 1))).alias("other")
    members = compact.drop("bytes").join(apart(weights.drop("bytes"), "comp"), "comp") \
        .withColumn("blk", F.pmod(F.xxhash64("s1", "s2"), "nb").cast("int")).select("*", other).select(
        F.when(one, F.pmod(F.xxhash64("comp"), F.lit(shared_tasks))).otherwise(F.col("comp")).alias("g"),
        F.when(one, -1).otherwise(F.least("blk", "other")).alias("i"), F.when(one, -1).otherwise(F.greatest("blk", "other")).alias("j"),
        "blk", "comp", "s1", "s2", "size", "hub", "has", "listed", "extra")
    verified = cut(_verify(members, threshold))
    links = verified.groupBy("s1", "s2").agg(F.sum("links").alias("n_links"), F.min("root").alias("root"))
    # a component of several blocks is joined up from the groups found in each pair of blocks
    joined = components(verified.where("several").select(F.col("s1").alias("u"), F.col("root").alias("v")))
    links = links.join(joined.select(F.col("node").alias("root"), F.col("root").alias("__mf_top")), "root", "left") \
        .select("s1", "s2", "n_links", F.coalesce("__mf_top", "root").alias("root"))
    full = classes.select("s1", "s2", "class_id").join(links, ["s1", "s2"], "left") \
        .withColumn("root", F.coalesce("root", "s1")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    full = cut(full)
    groups = full.groupBy("root").agg(F.min("class_id").alias("group_id"))
    return signed.drop("bands").join(full.join(apart(groups, "root"), "root"), ["s1", "s2"]).select(
        F.col("id").alias(ident), "__mf_r1", "__mf_r2", "class_id", "n_links", "group_id", "root")


def keep_one_per_group(docs: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without all but one document of each near-duplicate group: the least id stays (null
    last), of rows equal in id and text one."""
    found = near_duplicates(docs, ident, text, threshold)
    rank = F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("id"), F.col("__mf_r1"), F.col("__mf_r2"))
    chosen = found.groupBy("root").agg(F.min(rank).alias("x")).select("x.__mf_r1", "x.__mf_r2")
    own = docs.columns
    # rows equal in id and text share the key; one of them is kept before the join
    keyed = docs.select("*", *row_key(ident, text_or_empty(text))).dropDuplicates(["__mf_r1", "__mf_r2"])
    return keyed.join(chosen, ["__mf_r1", "__mf_r2"]).select(*own)
