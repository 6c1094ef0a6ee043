"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-cased words and their leading four and five characters (insults are
inflected), hashed into ``2**HASH_BITS`` buckets. The buckets that tell the labels apart in the sample
(chi-square, the ``MAX_TERMS`` best above ``MIN_CHI2``) are the model's inputs, as present or absent,
so length does not dilute a score. The machine scores

    logit = bias + sum_i w_i + 1/2 * ((sum_i v_i)^2 - sum_i v_i^2)

over the present terms: the second part learns pairs, such as an insult together with the mention of
a group, that additive weights miss. It is trained by AdaGrad on at most ``MAX_SAMPLE`` labelled rows
(a bounded sample of the documents with a label, by hash of id and text; rows equal in both are one; the
bound is the parameter ``max_sample``). Scoring reads every
whole text in one pass without a shuffle.

Defined results: a null or empty text has no term and scores the bias; ids that repeat in the labels
count as toxic if any of their labels is; null labels and labels of unknown ids are left out; without
labelled rows of both classes every score is the prior (0.5 without any); repeated rows get equal
scores; extra columns pass through, input columns named score or predicted are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import bound_batches, cut, text_or_empty

HASH_BITS, MAX_TERMS, MIN_CHI2, MAX_SAMPLE = 20, 8192, 12.0, 20_000
FACTORS, EPOCHS, RATE, DECAY, SEED = 8, 30, 0.1, 1e-4, 3
CACHE_WORDS, SLICE_CHARS = 50_000, 1_000_000
_WORD = re.compile(r"\w+")


def word_buckets(word: str) -> tuple[int, ...]:
    mask = (1 << HASH_BITS) - 1
    terms = {"w" + word, "p" + word[:4], "q" + word[:5]}
    return tuple(zlib.crc32(t.encode("utf-8", "replace")) & mask for t in terms)


class Buckets:
    """Distinct wanted buckets of a text; remembers the words it has seen, up to a bound."""

    def __init__(self, wanted: dict[int, int] | None = None):
        self.wanted, self.seen = wanted, {}

    def of(self, text: str) -> list[int]:
        out: set[int] = set()
        for w in set(_WORD.findall(text.lower())):
            got = self.seen.get(w)
            if got is None:
                if len(self.seen) >= CACHE_WORDS:
                    self.seen.clear()
                got = word_buckets(w)
                if self.wanted is not None:
                    got = tuple(self.wanted[b] for b in got if b in self.wanted)
                self.seen[w] = got
            out.update(got)
        return sorted(out)


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    wanted: dict[int, int]

    def scores(self, texts: Iterable[str | None], terms: Buckets | None = None) -> np.ndarray:
        """Scores of the texts, which are read in slices of about SLICE_CHARS characters."""
        terms, out, flat, ends, size = terms or Buckets(self.wanted), [np.zeros(0)], [], [0], 0
        for t in texts:
            flat += terms.of(t or "")
            ends.append(len(flat))
            size += len(t or "")
            if size >= SLICE_CHARS:
                out.append(self.logits(np.array(flat, np.int64), np.array(ends)))
                flat, ends, size = [], [0], 0
        out.append(self.logits(np.array(flat, np.int64), np.array(ends)))
        return 1.0 / (1.0 + np.exp(-np.clip(np.concatenate(out), -30, 30)))

    def logits(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Logits of texts whose terms lie end to end in ``flat``."""
        out, full = np.full(len(ends) - 1, self.bias), np.flatnonzero(np.diff(ends))
        if len(full):
            v, at = self.v[flat], ends[full]
            pairs = np.add.reduceat(v, at) ** 2 - np.add.reduceat(v * v, at)
            out[full] += np.add.reduceat(self.w[flat], at) + 0.5 * pairs.sum(axis=1)
        return out


def train(rows: list[list[int]], labels: np.ndarray, n_terms: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by AdaGrad over shuffled rows in small batches."""
    rng = np.random.default_rng(SEED)
    prior = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias, w, v = float(np.log(prior / (1 - prior))), np.zeros(n_terms), rng.normal(0, 0.02, (n_terms, FACTORS))
    gw, gv, gb = np.full(n_terms, 1e-6), np.full((n_terms, FACTORS), 1e-6), 1e-6
    lengths = np.array([len(r) for r in rows])
    starts = np.r_[0, np.cumsum(lengths)]
    flat = np.fromiter((i for r in rows for i in r), np.int64, int(starts[-1]))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(rows) // 256)):
            at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in batch]) if len(batch) else np.array([], int)
            ids, doc = flat[at], np.repeat(np.arange(len(batch)), lengths[batch])
            ve = v[ids]
            s = np.zeros((len(batch), FACTORS))
            np.add.at(s, doc, ve)
            squares = np.zeros(len(batch))
            np.add.at(squares, doc, (ve * ve).sum(axis=1))
            logit = bias + np.bincount(doc, w[ids], len(batch)) + 0.5 * ((s * s).sum(axis=1) - squares)
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[batch]) / len(batch)
            dw = np.bincount(ids, err[doc], n_terms) + DECAY * w * (np.bincount(ids, minlength=n_terms) > 0)
            dv = np.zeros_like(v)
            np.add.at(dv, ids, err[doc, None] * (s[doc] - ve) + DECAY * ve / len(batch))
            db = err.sum()
            gw += dw * dw
            gv += dv * dv
            gb += db * db
            w -= RATE * dw / np.sqrt(gw)
            v -= RATE * dv / np.sqrt(gv)
            bias -= RATE * db / np.sqrt(gb)
    return bias, w, v


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic",
        max_sample: int = MAX_SAMPLE) -> Machine:
    """Fits on at most ``max_sample`` labelled documents. Only hashed buckets of the sample, its
    MAX_TERMS best buckets and the rows restricted to these reach the driver."""
    bound_batches(docs.sparkSession)
    known = (labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull()).groupBy(F.col(ident).alias("__mf_id"))
             .agg(F.max(F.col(label).cast("int")).alias("__mf_y")))
    texts = docs.select(F.col(ident).alias("__mf_id"), text_or_empty(text).alias("__mf_text")).withColumn("__mf_h", F.xxhash64("__mf_text"))
    # labelled rows without their texts, one per id and text: the bound counts rows that are there
    pick = cut(texts.select("__mf_id", "__mf_h").distinct().join(known, "__mf_id")
               .orderBy(F.xxhash64(F.lit(SEED), "__mf_id", "__mf_h"), "__mf_id", "__mf_h").limit(max_sample))
    # at most max_sample rows: a bounded broadcast, the texts stay where they are
    sample = texts.join(F.broadcast(pick), ["__mf_id", "__mf_h"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Buckets()
        for x in batches:
            b = pa.array([terms.of(t.as_py()) for t in x.column(3)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*x.columns[:3], b], names=["id", "h", "y", "b"])

    kind = pick.schema["__mf_id"].dataType.simpleString()
    rows = cut(sample.select("__mf_id", "__mf_h", "__mf_y", "__mf_text").mapInArrow(hashed, f"id {kind}, h long, y int, b array<int>").dropDuplicates(["id", "h"]))
    sums = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    neg, pos = sums.get(0, 0), sum(v for k, v in sums.items() if k != 0)
    if not neg or not pos:
        prior = pos / (pos + neg) if pos + neg else 0.5
        return Machine(float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))), np.zeros(0), np.zeros((0, FACTORS)), {})
    n = float(neg + pos)
    seen, hit = F.col("seen"), F.col("hit")
    gap = hit * n - seen * pos
    best = (rows.select(F.explode("b").alias("b"), (F.col("y") != 0).cast("int").alias("y")).groupBy("b")
            .agg(F.count("*").alias("seen"), F.sum("y").alias("hit")).where((seen >= 3) & (seen < n))
            .withColumn("chi2", n * gap * gap / (seen * (n - seen) * F.lit(float(pos) * neg)))
            .where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "b").limit(MAX_TERMS).collect())
    wanted = {r["b"]: i for i, r in enumerate(best)}
    # at most MAX_TERMS rows: a bounded broadcast
    few = F.broadcast(rows.sparkSession.createDataFrame([(b,) for b in wanted], "b int"))
    present = rows.select("id", "h", F.explode("b").alias("b")).join(few, "b").groupBy("id", "h").agg(F.sort_array(F.collect_list("b")).alias("b"))
    got = rows.select("id", "h", "y").join(present, ["id", "h"], "left").orderBy("id", "h").select("y", F.coalesce("b", F.array().cast("array<int>")).alias("b")).collect()
    bias, w, v = train([[wanted[b] for b in r["b"]] for r in got], np.array([float(r["y"] != 0) for r in got]), len(wanted))
    return Machine(bias, w, v, wanted)


def score(docs: DataFrame, model: Machine, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 where the score is 0.5 or more)."""
    bound_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    rest, at = docs.select(*own), own.index(text) if text in own else -1
    if at < 0 or not isinstance(rest.schema[text].dataType, StringType):  # else the text crosses to Python once
        rest, at = docs.select(*own, text_or_empty(text).alias("__mf_text")), len(own)
    schema = StructType([*rest.schema.fields[:len(own)], StructField("score", DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Buckets(model.wanted)
        for x in batches:
            got = pa.array(model.scores((t.as_py() for t in x.column(at)), terms))
            yield pa.RecordBatch.from_arrays([*x.columns[:len(own)], got], names=schema.names)

    return rest.mapInArrow(rate, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
