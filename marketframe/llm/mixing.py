"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words: its weight's share of all words, but at most ``MAX_REPEAT``
times its own size; the excess is reshared by weight (water filling). A source whose target is f times
its size takes every document floor(f) times for certain. The rest is a sample without replacement
with unequal inclusion probabilities: documents are ranked by their random odds U/(1-U) divided by
their inclusion odds p/(1-p), and taken in that order until the words taken come nearest to the rest
of the target. p is the rest's share tilted by document length (longer documents are likelier), scaled
so that the expected words equal the rest.

The rank is never computed by one sort of a source: ranks are cut into ``BUCKETS`` ordered buckets,
their words are summed before the shuffle, and only the bucket in which the target is reached is
ordered, a row for each distinct document: rows equal in id and text are one item of that order, with their
number. Where the target falls inside such an item, as many of its rows are taken as come nearest to it; they
are numbered by task first and then inside each task's rows, so that no task holds them all.

Defined results: null text has size 0; documents of size 0 take nothing; a null source is a source of
its own; sources without words have target 0; rows equal in id and text have one rank, and it is open which of
them are taken (not how many). An empty table gives an empty result. Input columns that have the name of an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, text_or_empty, uniform

MAX_REPEAT = 3.0
BUCKETS = 4096
BROADCAST_SOURCES = 100_000
SEED = 17


def weight_by_order(weights: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Weights of the sources in code-point order, null last, repeating."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))


def water_fill(sources: DataFrame, total_share: float = 1.0) -> DataFrame:
    """``sources`` (source, source_size, weight, ...) with target = min(MAX_REPEAT * size, level * weight).

    The sources are ordered by the level at which they are full; below the right level all are full,
    above it all share by weight. One row per source, so the ordering is small.
    """
    cap = F.col("source_size") * MAX_REPEAT
    full_first = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    here_on = full_first.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * total_share - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) \
        / F.sum("weight").over(here_on)
    return (sources.withColumn("__mf_level", level)
            .withColumn("__mf_full", F.col("__mf_level") * F.col("weight") >= cap)
            .withColumn("__mf_open", F.max(F.when(~F.col("__mf_full"), F.col("__mf_level"))).over(everything))
            .withColumn("target", F.when(F.col("__mf_full"), cap).otherwise(
                F.least(cap, F.col("__mf_open") * F.col("weight"))).cast("double"))
            .drop("__mf_level", "__mf_full", "__mf_open"))


def _ranked(docs: DataFrame, ident: str, text: str, seed: int) -> DataFrame:
    """Adds size, the document's random number, a tie-breaker and the tilt of its length."""
    digest = F.md5(text_or_empty(text).cast("binary"))
    return (docs.withColumn("size", n_words(text_or_empty(text))).withColumn("__mf_tie", digest)
            .withColumn("__mf_u", uniform(seed, F.col(ident), F.col("__mf_tie")))
            .withColumn("__mf_tilt", (1 + F.length(F.conv(F.col("size"), 10, 2))).cast("double")))


def _order(u: Column, p: Column, size: Column) -> Column:
    """Odds ratio x = u(1-p) / (p(1-u)) as x / (1 + x): in [0, 1], same order; p of 1 ranks first."""
    up, down = u * (1.0 - p), (1.0 - u) * p
    return F.when((p <= 0) | (size == 0), F.lit(1.0)).otherwise(up / (up + down))


def _first_rows(rows: DataFrame, k: Column) -> DataFrame:
    """``rows`` (of each source, rows that are all equal) with __mf_one: true for ``k`` rows of each source. Rows are
    counted by task; a task's rows are numbered from the sum of the tasks before it."""
    rows = cut(rows.withColumn("__mf_k", k).withColumn("__mf_place", F.monotonically_increasing_id())
               .withColumn("__mf_task", F.shiftright("__mf_place", 33)))
    before = Window.partitionBy("__mf_source").orderBy("__mf_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = rows.groupBy("__mf_source", "__mf_task").count() \
        .select(F.col("__mf_source").alias("__mf_s"), F.col("__mf_task").alias("__mf_t"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__mf_from"))
    number = F.row_number().over(Window.partitionBy("__mf_source", "__mf_task").orderBy("__mf_place"))
    joined = rows.withColumn("__mf_number", number).join(tasks, F.col("__mf_source").eqNullSafe(F.col("__mf_s")) & (F.col("__mf_task") == F.col("__mf_t")))
    return joined.withColumn("__mf_one", F.col("__mf_from") + F.col("__mf_number") <= F.col("__mf_k")) \
        .drop("__mf_k", "__mf_place", "__mf_task", "__mf_s", "__mf_t", "__mf_from", "__mf_number")


def mix(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text",
        weight: Column | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, copies (how often the mix takes the document) and taken.

    A narrow table (no text) is cut once; the sums, the buckets and the cut of each source come from
    it. The last pass reads ``docs`` again and compares each row with its source's cut, so texts are
    never shuffled.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    narrow = cut(_ranked(docs, ident, text, seed).select(
        F.col(source).alias("source"), F.col(ident).alias("__mf_id"), "size", "__mf_tie", "__mf_u", "__mf_tilt"))
    sums = narrow.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("__mf_tilt") * F.col("size")).alias("__mf_tilted"))
    sums = water_fill(sums.withColumn("weight", weight_by_order() if weight is None else weight))
    has = F.col("source_size") > 0
    sums = sums.withColumn("__mf_rate", F.when(has, F.col("target") / F.col("source_size")).otherwise(0.0))
    sums = cut(sums.select(
        F.col("source").alias("__mf_source"), "source_size", "target", F.floor("__mf_rate").alias("__mf_whole"),
        (F.col("target") - F.floor("__mf_rate") * F.col("source_size")).alias("__mf_rest"),
        F.when(has, (F.col("__mf_rate") - F.floor("__mf_rate")) * F.col("source_size") / F.col("__mf_tilted"))
        .otherwise(0.0).alias("__mf_per_tilt")))
    n_sources = sums.count()

    def small(df: DataFrame) -> DataFrame:
        # a row per source: its number is checked before it is broadcast, beyond it the planner decides
        return F.broadcast(df) if n_sources <= BROADCAST_SOURCES else df

    p = F.least(F.lit(1.0), F.col("__mf_per_tilt") * F.col("__mf_tilt"))
    ranked = narrow.join(small(sums), narrow["source"].eqNullSafe(sums["__mf_source"])) \
        .withColumn("__mf_q", _order(F.col("__mf_u"), p, F.col("size"))) \
        .withColumn("__mf_bucket", F.least(F.lit(BUCKETS - 1), F.floor(F.col("__mf_q") * BUCKETS)).cast("int"))
    upto = Window.partitionBy("__mf_source").orderBy("__mf_bucket").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("__mf_rest")
    edge = (ranked.groupBy("__mf_source", "__mf_bucket").agg(F.sum("size").alias("__mf_words"), F.first("__mf_rest").alias("__mf_rest"))
            .withColumn("__mf_before", F.coalesce(F.sum("__mf_words").over(upto), F.lit(0)))
            .where((F.col("__mf_before") < rest) & (F.col("__mf_before") + F.col("__mf_words") >= rest))
            .select(F.col("__mf_source").alias("__mf_s"), F.col("__mf_bucket").alias("__mf_edge"), "__mf_before"))
    rank = F.struct(F.col("__mf_q").alias("q"), F.col("__mf_tie").alias("tie"), F.col("__mf_id").alias("id"))
    inside = ranked.join(small(edge), ranked["__mf_source"].eqNullSafe(edge["__mf_s"]) & (F.col("__mf_bucket") == F.col("__mf_edge"))) \
        .groupBy("__mf_s", "__mf_edge", "__mf_q", "__mf_tie", "__mf_id", "size", "__mf_before", "__mf_rest").agg(F.count("*").alias("__mf_n"))
    order = Window.partitionBy("__mf_s").orderBy("__mf_q", "__mf_tie", F.col("__mf_id").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.col("size") * F.col("__mf_n")).over(order), F.lit(0)) + F.col("__mf_before")
    # nearest to the rest: a document counts while its middle lies below it
    taken = F.floor((rest - F.col("__mf_seen")) / F.nullif("size", F.lit(0)) + 0.5)
    last = (inside.withColumn("__mf_seen", seen)
            .withColumn("__mf_k", F.when(F.col("size") == 0, F.when(F.col("__mf_seen") <= rest, F.col("__mf_n")).otherwise(0))
                        .otherwise(F.greatest(F.lit(0), F.least(F.col("__mf_n"), taken))))
            .groupBy("__mf_s", "__mf_edge").agg(F.max(F.when(F.col("__mf_k") > 0, F.struct(
                rank.alias("rank"), F.col("__mf_k").alias("k"), F.col("__mf_n").alias("n")))).alias("__mf_last")))
    cuts = cut(sums.join(last, sums["__mf_source"].eqNullSafe(last["__mf_s"]), "left").drop("__mf_s"))
    full = _ranked(docs.select(*own), ident, text, seed)
    full = full.withColumn("__mf_id", F.col(ident)).join(small(cuts), F.col(source).eqNullSafe(F.col("__mf_source"))) \
        .withColumn("__mf_q", _order(F.col("__mf_u"), p, F.col("size"))) \
        .withColumn("__mf_bucket", F.least(F.lit(BUCKETS - 1), F.floor(F.col("__mf_q") * BUCKETS)).cast("int"))
    at_edge = (F.col("__mf_bucket") == F.col("__mf_edge")) & F.col("__mf_last").isNotNull()
    parted = F.coalesce(at_edge & (rank == F.col("__mf_last.rank")) & (F.col("__mf_last.k") < F.col("__mf_last.n")), F.lit(False))
    # a source with no edge takes none if its rest is nothing, else (by rounding) all
    one = F.when(F.col("__mf_edge").isNull(), rest > 0.5).when(F.col("__mf_bucket") != F.col("__mf_edge"), F.col("__mf_bucket") < F.col("__mf_edge")) \
        .otherwise(F.coalesce(rank <= F.col("__mf_last.rank"), F.lit(False)))
    if cuts.where("__mf_last.k < __mf_last.n").isEmpty():
        full = full.withColumn("__mf_one", one)
    else:
        whole = full.where(~parted).withColumn("__mf_one", one)
        full = whole.unionByName(_first_rows(full.where(parted), F.col("__mf_last.k")))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("__mf_whole") + F.when(F.col("__mf_one"), 1).otherwise(0)).cast("long")
    return full.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long")) \
        .select(*own, "size", "source_size", "target", "copies", "taken")
