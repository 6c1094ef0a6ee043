"""Hostile, repeated and clashing inputs of the training-data operators, and parts against brute force."""

import json
import random
import sys
import time
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from marketframe.llm import chat, html_extract, mixing, near_duplicates, oracles, suffix_dedup, toxicity
from marketframe.llm.html_dom import parse
from scripts_compare import frames_equal


def test_mixing_meets_its_target_on_repeated_rows(spark, tmp_path):
    """A thousand rows equal in id and text: as many are taken as come nearest to the target, as SQL says."""
    rows = [(7, " ".join(["w"] * 50), "a")] * 1000 + [(i, " ".join(["x"] * (i % 90 + 1)), "b") for i in range(500)] \
        + [(9, " ".join(["y"] * 20), None)] * 300 + [(None, None, "c"), (None, "", "c"), (3, "q " * 9, "c")] * 7
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    mixed = mixing.mix(docs)
    got = mixed.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken").toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    ok, why = frames_equal(got, con.sql(oracles.OP9).df())
    assert ok, why
    near = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= r.size / 2 for r in near)


BROKEN = ["<a ", '<a "', "<a '\"", "<![CDATA[", "<!", "<!--", "</script", "<video><script>", "<video>", "<b>", "<div>", "</x>", '<p class="x', "<",
          "<svg>", "<?", "<a b='\"'<", "<li>", '<a "<a""', "<b></x>"]


@pytest.mark.parametrize("part", BROKEN)
def test_reader_is_linear(part):
    """A megabyte of broken markup in seconds (by a quadratic reader: hours)."""
    page = (part * (1_000_000 // len(part) + 1))[:1_000_000]
    start = time.process_time()
    parse(page)
    assert time.process_time() - start < 10


def test_reader_on_deep_markup():
    for page in ("<i><table>" + "<b>" * 50_000 + "</i>" * 50_000, "<div>" * 50_000 + "deep" + "</div>" * 50_000 + "tail"):
        start = time.process_time()
        nodes = parse(page)
        assert time.process_time() - start < 5
    assert [x.text for x in nodes if x.tag == "#text"] == ["deep", "tail"]


def test_reader_keeps_text_of_broken_tags():
    nodes = parse('<div>a<p>b < c <a href="x>y</a> z</p></div><p>1 <b')
    assert [x.text for x in nodes if x.tag == "#text"] == ["a", "b < c y z", "1"]


def test_marks_of_real_pages_mean_nothing(spark):
    page = "<body><div data-y='12px'><p>one</p></div><div data-y=1>two</div></body>"
    assert all(x.label is None for x in parse(page))
    assert {x.label for x in parse("<div data-y='1'>x</div>", marked=True)} == {None, 1}
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None)], "page_id long, url string, html string")
    assert html_extract.extract(pages, html_extract.fit(pages)).count() == 2


def test_layouts_beside_other_fields(spark):
    """Columns and fields that another mapping names do not hide a layout."""
    rows = spark.createDataFrame([(1, 0, "user", "hi", "be kind", "x", 5), (1, 1, "assistant", "yes", None, "y", 6)],
                                 "conv_id long, turn long, role string, text string, system string, prompt string, input long")
    assert [tuple(r) for r in chat.canonical_turns(rows).orderBy("turn").collect()] == [(1, 0, "user", "hi"), (1, 1, "assistant", "yes")]
    records = [{"messages": [{"role": "user", "content": "a"}], "prompt": "x"}, {"instruction": "do", "output": "done", "weight": 1, "answer": "no"},
               {"messages": [], "question": "q?"}, {"messages": [{"role": "user", "content": "b"}, "loose"]}, {"other": 1}, ["list"], 5]
    table = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(99, None)], "id long, raw string")
    got = {}
    for r in chat.canonical_from_json(table, "id", "raw").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.layout, r.role, r.text))
    assert got[0] == [("messages", "user", "a")]
    assert got[1] == [("instruction", "user", "do"), ("instruction", "assistant", "done")]
    assert got[3] == [("messages", "user", "b"), ("messages", "", "loose")]
    assert got[4] == got[5] == got[6] == got[99] == [(None, None, None)]


def test_repeats_with_clashing_columns(spark):
    text = "the same passage of some length " * 10
    docs = spark.createDataFrame([(i, f"{i} {text} {i}", "s", 1, "p", 2) for i in range(3)],
                                 "doc_id long, text string, spans string, wanted int, place string, runs int")
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == 3 and all(r.n_removed > 200 and r.spans == "s" and r.wanted == 1 and r.runs == 2 for r in got)


def brute_links(sets, threshold):
    return {(i, j) for i, j in combinations(range(len(sets)), 2)
            if (u := len(sets[i] | sets[j])) and len(sets[i] & sets[j]) >= threshold * u - 1e-9}


def test_differences_give_exact_links(monkeypatch):
    """Links from differences against a hub, for near copies, unlike sets and small tiles."""
    monkeypatch.setattr(near_duplicates, "COLUMNS", 7)
    monkeypatch.setattr(near_duplicates, "PAIRS", 11)
    rng = random.Random(4)
    for _ in range(60):
        base = rng.sample(range(1000), rng.choice([5, 40, 100]))
        sets = [set(base)]
        for _ in range(rng.randint(2, 30)):
            s = set(rng.choice([base, rng.sample(range(1000), 30), list(sets[-1])]))
            s -= set(rng.sample(sorted(s), min(len(s) - 1, rng.randint(0, 6))))
            sets.append(s | set(rng.sample(range(1000), rng.randint(0, 6))))
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        has, listed, extra = zip(*(near_duplicates.differences(arrays[0], a) for a in arrays))
        members = near_duplicates.Members(len(arrays[0]), np.array([len(a) for a in arrays]), np.array(has), list(listed), list(extra))
        cut = rng.randint(1, len(sets) - 1)
        x, y = np.arange(cut), np.arange(cut, len(sets))
        found = {(i, j + o) for a, b, o in ((x, x, 0), (y, y, cut), (x, y, cut)) for i, j in
                 ((int(a[i]), int(j)) for i, j in np.argwhere(members.linked(a, b, 0.8))) if i < j + o}
        assert found == brute_links(sets, 0.8)


def test_near_copies_are_compared_by_small_differences(spark, monkeypatch):
    """Three thousand near copies of one text: what the comparison moves is far less than their sets, each class once."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(3000):
        w = list(words)
        w[rng.randrange(400)] = f"x{i}"
        docs.append((i, " ".join(w)))
    moved = {}
    verify = near_duplicates._verify

    def spy(members, threshold):
        moved["rows"], moved["bytes"] = members.agg(F.count("*"), F.sum(F.octet_length("listed") + F.octet_length("extra"))).first()
        return verify(members, threshold)

    monkeypatch.setattr(near_duplicates, "_verify", spy)
    got = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.n_links == 2999 and r.group_id == 0 for r in got)
    assert moved["rows"] == 3000 and moved["bytes"] < 0.1 * 3000 * 396 * 8


def test_machine_is_the_sum_over_pairs():
    """Logits against the explicit sum over pairs of present terms; texts without terms get the bias."""
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(-0.3, rng.normal(size=20), rng.normal(size=(20, 4)), {})
    rows = [sorted(rng.choice(20, n, replace=False).tolist()) for n in (0, 1, 2, 7, 0, 20, 0)]
    want = [machine.bias + machine.w[r].sum() + sum(machine.v[i] @ machine.v[j] for i, j in combinations(r, 2)) for r in rows]
    got = machine.logits(np.array([i for r in rows for i in r], np.int64), np.cumsum([0, *map(len, rows)]))
    assert np.allclose(got, want)


def test_scoring_slices_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"you are a vile zog {i}" if i % 2 else f"a calm day by the sea {i}") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    machine = toxicity.fit(docs, labels)
    texts = ["you vile zog", None, "", "calm sea", "zog " * 50]
    whole = machine.scores(texts)
    monkeypatch.setattr(toxicity, "SLICE_CHARS", 5)
    assert np.allclose(machine.scores(texts), whole) and whole[0] > 0.5 > whole[3] and whole[1] == whole[2]
    odd = spark.createDataFrame([(1, None, "x", 3.0), (2, "", None, None), (3, "you vile zog", "y", 1.0)], "doc_id long, text string, predicted string, score double")
    got = {r.doc_id: r for r in toxicity.score(odd, machine).collect()}
    assert got[3].predicted == 1 and got[1].score == got[2].score == whole[1]


def test_pipeline_on_edge_tables(spark, tmp_path):
    """Nulls, empty and repeated rows run through every stage; so does an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"plain words about topic {i} " * 8 + f"end {i * 7919}", "en", "s" + str(i % 3), 10) for i in range(40)]
    rows += rows[:5] + [(None, None, None, None, None), (100, "", "en", None, 0), (None, "some text without an id", "en", "s1", 5), (101, " \n ", None, "s9", 1)]
    labels = spark.createDataFrame([(i, 1, int(i < 3)) for i in range(20)], "doc_id long, quality int, toxic int")
    for name, table in (("full", spark.createDataFrame(rows, schema)), ("empty", spark.createDataFrame([], schema))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        (labels if name == "full" else labels.limit(0)).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for k, (stage, step) in enumerate(corpus_pipeline.STAGES):
            step(spark, docs, f"{tmp_path}/{name}").write.parquet(f"{tmp_path}/{name}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == corpus_pipeline.COLUMNS
        assert (docs.count() > 0) == (name == "full")
