"""Exact top-k search over binary codes by incremental multi-index hashing, as joins.

A vector's code has one bit per dimension (set where the value is above 0). Each 64-bit word of a code is
cut into even segments, so long that a segment's value is shared by about PER_VALUE codes (a value probed is a
row that is made, moved and sorted, which costs about as much as comparing that many codes met), and one table holds, for each code and segment, the segment's value. For a query, radius r = 0, 1, 2, ... joins all values within r bits of the query's segments
with the table, and verifies the codes met on all bits. By the pigeonhole principle, once radius r is done
in the first a of m segments (and r - 1 in the others) every code within m * r + a - 1 bits has been met. So
a query is proven as soon as its kth verified distance is covered; it probes no segment past that, and
leaves the rounds. The result is exact, and every row of it was met by a probe.

A code is verified once per query: by the first segment among those nearest to the query's. A query's
state is one row with its best k + 1 (one more, as the query itself may be among them), a code farther
than the worst of them goes before any shuffle, and rows are cut to the k + 1 best of a query before they
move. Equal codes are one entry that carries its k + 1 least ids, and equal query codes are searched
once, so copies cost nothing. Each round is cut with a reliable checkpoint.

Defined results: null vectors and vectors with a null or NaN value at some place have that bit unset
(a null vector is neither found nor a query); vectors of other lengths are padded with unset bits; a
query does not find its own id; fewer than k others give fewer rows; null ids are left out; of equal ids
the one with the least code counts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ceil_div, cut

K, LONGEST, PER_VALUE = 10, 16, 10


@dataclass(frozen=True)
class Segment:
    number: int
    word: int
    shift: int
    bits: int

    def value(self, word: Column) -> Column:
        return F.shiftrightunsigned(word, self.shift).bitwiseAND(F.lit((1 << self.bits) - 1).cast("long"))


def segments(bits: int, n_codes: int) -> list[Segment]:
    """Even segments of about log2(n_codes / PER_VALUE) bits (at most LONGEST), none across two words."""
    length = min(LONGEST, max(1, round(math.log2(max(2, n_codes / PER_VALUE)))))
    found: list[Segment] = []
    for word in range(ceil_div(bits, 64)):
        left, at = min(64, bits - 64 * word), 0
        for parts in range(ceil_div(left, length), 0, -1):
            size = ceil_div(left, parts)
            found.append(Segment(len(found), word, at, size))
            at, left = at + size, left - size
    return found


def binary_codes(vectors: DataFrame, ident: str, vector: str, bits: int) -> DataFrame:
    """(id, code): ceil(bits / 64) longs per row."""
    words = []
    for w in range(ceil_div(bits, 64)):
        word = F.lit(0).cast("long")
        for b in range(min(64, bits - 64 * w)):
            value = F.get(F.col(vector), F.lit(64 * w + b))
            on = F.coalesce((value > 0) & ~F.isnan(value), F.lit(False))
            word = word.bitwiseOR(F.when(on, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return vectors.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).select(F.col(ident).alias("id"), F.array(*words).alias("code"))


def segment_table(entries: DataFrame, parts: list[Segment]) -> DataFrame:
    """(s, v, code, ids): a row per code and segment."""
    each = F.array(*[F.struct(F.lit(p.number).alias("s"), p.value(F.col("code")[p.word]).alias("v")) for p in parts])
    return entries.select("code", "ids", F.explode(each).alias("e")).select("e.s", "e.v", "code", "ids")


def _masks(bits: int, radius: int) -> Column:
    """All numbers of ``bits`` bits of which ``radius`` are set."""
    values = [x for x in range(1 << bits) if x.bit_count() == radius]
    return F.expr(f"array({', '.join(map(str, values))})").cast("array<bigint>")


def probe(asked: DataFrame, table: DataFrame, parts: list[Segment], radius: int) -> DataFrame:
    """(q, distance, ids): the codes that radius ``radius`` meets first, verified on all bits, without those
    farther than ``kth`` (null: not known yet). asked: q, kth."""
    m = len(parts)
    # segments past these are not needed to prove the kth distance
    wanted = F.least(F.lit(m), F.greatest(F.lit(0), F.coalesce(F.col("kth") - m * radius + 1, F.lit(m)))).cast("int")
    each = F.array(*[F.struct(F.lit(p.number).alias("s"), F.lit(p.bits).alias("bits"), p.value(F.col("q")[p.word]).alias("own")) for p in parts])
    masks = F.lit(None).cast("array<bigint>")
    for bits in sorted({p.bits for p in parts if p.bits >= radius}):
        masks = F.when(F.col("bits") == bits, _masks(bits, radius)).otherwise(masks)
    values = asked.select("q", "kth", F.explode(F.slice(each, F.lit(1), wanted)).alias("e")).select("q", "kth", "e.*") \
        .select("q", "kth", "s", "own", F.explode(masks).alias("mask"))
    met = values.select("q", "kth", "s", F.col("own").bitwiseXOR(F.col("mask")).alias("v")).join(table, ["s", "v"])

    def word(w: int) -> Column:
        return F.col("q")[w].bitwiseXOR(F.col("code")[w])

    apart = F.array(*[F.bit_count(p.value(word(p.word))) for p in parts])
    first = (F.array_min(apart) == radius) & (F.array_position(apart, radius) == F.col("s") + 1)
    distance = sum((F.bit_count(word(w)) for w in range(1, parts[-1].word + 1)), F.bit_count(word(0)))
    return met.where(first).select("q", "kth", distance.cast("long").alias("distance"), "ids") \
        .where(F.col("kth").isNull() | (F.col("distance") <= F.col("kth"))).select("q", "distance", "ids")


def search(vectors: DataFrame, queries: DataFrame, ident: str = "vec_id", vector: str = "embedding", k: int = K,
           report: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest codes of ``vectors`` for every row of ``queries``,
    by Hamming distance, then id. ``report`` gets (radius, query codes, codes verified) for each round."""
    bits = vectors.agg(F.max(F.size(vector))).first()[0]
    bits = max(1, bits or 1)
    least = Window.partitionBy("code").orderBy("id")
    one_each = binary_codes(vectors, ident, vector, bits).groupBy("id").agg(F.min("code").alias("code"))
    entries = cut(one_each.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
                  .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n_codes, n_ids = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    parts = segments(bits, n_codes)
    m, most = len(parts), min(k + 1, n_ids)
    table = cut(segment_table(entries, parts).repartition("s", "v"))
    asked = binary_codes(queries, ident, vector, bits).groupBy("id").agg(F.min("code").alias("code"))
    pair = F.struct("distance", "id")
    best = Window.partitionBy("q").orderBy("distance", "id")
    nothing = F.array().cast("array<struct<distance:bigint,id:bigint>>")
    state = cut(asked.select(F.col("code").alias("q")).distinct().withColumn("best", nothing))
    proven = state.where("false")
    for radius in range(max(p.bits for p in parts) + 1):
        if not most or state.isEmpty():
            break
        kth = F.get(F.col("best"), F.lit(most - 1))["distance"]
        met = probe(state.select("q", kth.alias("kth")), table, parts, radius)
        if report is not None:
            report.append((radius, state.count(), met.count()))
        nearest = met.select("q", "distance", F.explode("ids").alias("id")).withColumn("n", F.row_number().over(best)) \
            .where(F.col("n") <= k + 1).groupBy("q").agg(F.collect_list(pair).alias("new"))
        merged = F.slice(F.array_sort(F.concat("best", F.coalesce("new", nothing))), 1, k + 1)
        state = cut(state.join(nearest, "q", "left").select("q", merged.alias("best")))
        done = F.coalesce(kth <= m * (radius + 1) - 1, F.lit(False))
        if n_ids <= k + 1:  # the best are all there is
            done = done | (F.size("best") >= n_ids)
        proven, state = proven.unionByName(state.where(done)), state.where(~done)
    found = proven.unionByName(state).select("q", F.explode("best").alias("e")).select("q", "e.*")
    others = asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(found, "q").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
