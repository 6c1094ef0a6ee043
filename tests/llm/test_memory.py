"""What a task of the training-data operators holds at once."""

import random
import sys
import tracemalloc
import uuid
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from marketframe.llm import near_duplicates, suffix_dedup, toxicity
from marketframe.llm.common import BATCH_BYTES, BATCH_SETTING


def remove_repeats(spark, docs):
    return suffix_dedup.remove_repeats(docs)


def keep_one_per_group(spark, docs):
    return near_duplicates.keep_one_per_group(docs)


def drop_toxic(spark, docs):
    labels = spark.range(2000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    return toxicity.score(docs, toxicity.fit(docs, labels))


@pytest.mark.parametrize("operator", [remove_repeats, keep_one_per_group, drop_toxic])
def test_texts_cross_to_python_in_small_batches(spark, monkeypatch, tmp_path, operator):
    """12 MB of texts in one partition never are one batch, and all of them cross."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=500))) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(1).write.parquet(f"{tmp_path}/docs")
    docs, folder = spark.read.parquet(f"{tmp_path}/docs").coalesce(1), str(tmp_path)
    plain = type(docs).mapInArrow

    def noted(self, f, schema, *more, **named):
        def noting(batches):
            def seen():
                with open(f"{folder}/seen-{uuid.uuid4().hex}", "a") as out:
                    for x in batches:
                        out.write(f"{x.nbytes}\n")
                        yield x

            yield from f(seen())

        return plain(self, noting, schema, *more, **named)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.unset(BATCH_SETTING)
    try:
        assert operator(spark, docs).count() == 3000
        sizes = [int(n) for p in tmp_path.glob("seen-*") for n in p.read_text().split()]
        assert sum(sizes) > 3000 * 3900 and max(sizes) < 2 * BATCH_BYTES
        spark.conf.set(BATCH_SETTING, "1m")  # a session's own bound stays
        operator(spark, docs.limit(5))
        assert spark.conf.get(BATCH_SETTING) == "1m"
    finally:
        spark.conf.set(BATCH_SETTING, before)


def peak_mb(f) -> float:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_scan_holds_few_windows():
    """A task's tables and the windows of one run."""
    text = np.random.default_rng(1).integers(97, 123, suffix_dedup.CHUNK + suffix_dedup.LENGTH - 1).astype(np.uint8).tobytes()
    assert peak_mb(lambda: suffix_dedup.Anchors().of([text])) < 25


def test_tile_of_near_copies_is_small():
    """Two tiles of classes against each other, whose differences hold common and rare values."""
    rng, n = np.random.default_rng(2), 2 * near_duplicates.TILE
    listed = [np.unique(rng.integers(0, 300, 60)).astype(np.uint32) for _ in range(n)]
    extra = [np.unique(rng.integers(0, 4000, 60)).astype(np.uint64) for _ in range(n)]
    sizes = np.array([400 - len(a) + len(b) for a, b in zip(listed, extra)])
    members = near_duplicates.Members(400, sizes, np.zeros(n, bool), listed, extra)
    x, y = np.arange(n // 2), np.arange(n // 2, n)
    assert peak_mb(lambda: members.linked(x, y, 0.5)) < 40
