"""Training-data operators: edge tables, brute force, round trips, held-out accuracy, DuckDB oracles."""

import hashlib
import json
import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from marketframe.llm import (boosting, chat, hamming_search, html_extract, mixing, near_duplicates, packing, quality, queries, sharding,
                             suffix_dedup, toxicity)
from marketframe.llm.components import components
from marketframe.llm.html_dom import parse
from scripts_compare import frames_equal

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, size int, root int"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [(1, "a b c d e f g", "en", "s1", 1, "x", "y", 0, 0), (1, "a b c d e f g", "en", "s1", 1, "x", "y", 0, 0), (2, "a b c d e f g", None, None, None, None, None, None, None),
            (None, None, None, None, None, None, None, None, None), (None, "", "en", "s1", 0, "x", "y", 0, 0), (3, " \n\t ", "en", "s2", 3, "x", "y", 0, 0),
            (4, long, "en", "s2", len(long), "x", "y", 0, 0), (5, "tiny", "de", "s3", 4, "x", "y", 0, 0), (6, "é☃ ünï\x0bcode", "fr", "s1", 9, "x", "y", 0, 0)]
    return spark.createDataFrame(rows, DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_oracle(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ok, why = frames_equal(queries.QUERIES[key](spark, SF).toPandas(), con.sql(queries.ORACLES[key]).df())
    assert ok, why


def test_quality_edges(edge):
    got = quality.quality_rules(edge).toPandas()
    assert len(got) == 9 and got[got.text.isna()].n_words.tolist() == [0] and not got[got.n_words < 50].kept.any()
    long = got[got.doc_id == 4].iloc[0]
    w = words(long.text)
    seen = Counter(zip(w, w[1:], w[2:]))
    assert long.n_repeat_words == len({i + d for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for d in range(3)})
    assert quality.quality_rules(edge.limit(0)).count() == 0


def test_packing(edge, spark):
    got = packing.pack(edge, capacity=64, per_source=2).toPandas()
    assert got.n_words.sum() == sum(len(words(r.text)) for r in edge.collect())
    assert (got.groupby(["block", "bin"]).n_words.sum() <= 64).all()
    assert got.groupby(["block", "bin", got.source.fillna("-")]).size().max() <= 2
    assert packing.pack(edge.limit(0)).count() == 0


def test_best_fit_against_brute_force():
    rng = random.Random(1)
    pieces = sorted(((rng.randint(0, 60), rng.choice([-1, -1, 0, 1, 2]), rng.randrange(4)) for _ in range(400)), reverse=True)
    got, offset, n = packing.pack_block(*zip(*pieces), 100, 2)
    bins = []
    for (size, cluster, source), number, before in zip(pieces, got, offset):
        fits = [(100 - b["used"], k) for k, b in enumerate(bins) if b["used"] + size <= 100 and cluster not in b["c"] and b["s"][source] < 2]
        want = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"used": 0, "c": set(), "s": Counter()})
        b = bins[want]
        assert (number, before) == (want, b["used"])
        b["used"] += size
        b["s"][source] += 1
        if cluster >= 0:
            b["c"].add(cluster)
    assert n == len(bins)


def test_sharding(edge, spark):
    got = sharding.shard(edge.withColumnRenamed("root", "slot"), 4).toPandas()
    assert len(got) == 9 and sorted(got.groupby("shard").size()) == [2, 2, 2, 3]
    many = sharding.shard(spark.range(5000), 16, block_rows=300).toPandas()
    assert many.id.nunique() == 5000
    for _, own in many.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own))) and len(own) in (312, 313)
    # every id falls on every shard alike: the share of low ids in a shard is about a half
    assert abs((many[many.id < 2500].groupby("shard").size() / 312.5 - 0.5)).max() < 0.15
    assert sharding.shard(edge.limit(0)).count() == 0


def test_matrix_margins_and_large_draws():
    blocks, parts = np.array([5, 0, 7, 9, 3]), np.array([6, 6, 6, 6])
    rows = np.stack([sharding.matrix_row(b, blocks, parts, 2) for b in range(5)])
    assert (rows.sum(axis=1) == blocks).all() and (rows.sum(axis=0) == parts).all() and (rows >= 0).all()
    rng = np.random.default_rng(0)
    draws = [sharding.hypergeometric(rng, 10**10, 3 * 10**10, 1000) for _ in range(2000)]
    assert abs(np.mean(draws) - 250) < 2 and abs(np.std(draws) - (1000 * 0.25 * 0.75) ** 0.5) < 1


def test_html():
    rng = random.Random(7)
    texts = [" ".join(rng.choices("alpha beta gamma delta one, two. three".split(), k=30)) for _ in range(40)]
    main = [("h1", "A title")] + [("p", t) for t in texts[:6]]
    xs, ys = [], []
    for _ in range(250):
        nodes = parse(html_extract.compose(main[:rng.randint(2, 7)], texts, rng))
        y = html_extract.labelled(nodes)
        xs.append(html_extract.features(nodes)[y >= 0])
        ys.append(y[y >= 0])
    x, y = np.concatenate(xs), np.concatenate(ys).astype(float)
    model = boosting.fit(x, y, np.ones(len(y)))
    hit = 0
    for _ in range(60):
        nodes = parse(html_extract.compose(main, texts, rng))
        hit += html_extract.decode(nodes, model.logits(html_extract.features(nodes))) == [n.text for n in nodes if n.tag == "#text" and n.label == 1]
    assert hit >= 45


def test_html_reader():
    nodes = parse('<body><p>a &amp; b<br>c<p>d <b>e</b>f<ul><li>x<li>y</ul><script>"</p>"</script><!-- z -->tail <a href="q">l</a><di')
    assert [n.text for n in nodes if n.tag == "#text"] == ["a & b c", "d ef", "x", "y", "tail l"]
    for odd in ("", "<", "</p></div>", "<p", "a<b", "<script>never closed", "<!-- never closed", "<p a='>x", "x" * 100_000):
        parse(odd)


@pytest.mark.parametrize("page", [
    "<video src=x>no player<p>one</p><p>two</p>", "<div><object data=x>none</div><p>one<p>two", "<map name=m><area><p>one<p>two",
    "<svg><path d=x><text>no</text><article><p>one<p>two</article>", "<svg><title>no<p>one<p>two", "<noscript><p>one<p>two",
    "<video>no<p>one</p><video>no</video><p>two", "<div><video>no</div><p>one</p></video><p>two", "<canvas><audio>no<div>one</div>two",
    "<object><p>no</p></div><object>no</object></object><p>one<p>two", "<noscript><div>no</p></noscript><p>one<svg><g/><text>no</svg><p>two"])
def test_html_reader_silent_elements(page):
    assert [n.text for n in parse(page) if n.tag == "#text"] == ["one", "two"]


def test_html_reader_math_and_raw_text():
    assert [n.text for n in parse("<p>so <math><mi>x</mi> = 1</math> holds<script>no") if n.tag == "#text"] == ["so x = 1 holds"]


@pytest.mark.parametrize("n", [10, 300])
def test_html_equal_siblings(n):
    nodes = parse("<div>" + "<p>x</p>" * n + "<h2>y</h2></div>")
    equal = html_extract.features(nodes)[:, 2 * html_extract.N_TAGS + 2 * html_extract.N_KINDS + 4]
    assert [e for x, e in zip(nodes, equal) if x.tag in ("p", "h2")] == [n] * n + [1]


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (None, None, "", "y"), (2, "u", "<article><p>one</article>", "z"), (2, "u", "<article><p>one</article>", "z")],
                                  "page_id long, url string, html string, text string")
    got = html_extract.extract(pages, html_extract.fit(pages)).toPandas()
    assert len(got) == 4 and got[got.page_id != 2].n_chars.tolist() == [0, 0] and got.text.notna().all()
    assert html_extract.extract(pages.limit(0), html_extract.fit(pages.limit(0))).count() == 0


def test_toxicity(spark, edge):
    docs, labels = queries.table(spark, SF.replace("0.001", "0.1"), "documents"), queries.table(spark, SF.replace("0.001", "0.1"), "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = toxicity.score(docs, toxicity.fit(docs, labels.where(~held))).join(labels.where(held), "doc_id").toPandas()
    ranks, pos = got.score.rank(), got.toxic == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.9 and (got.predicted == got.toxic).mean() > 0.95 and got[~pos].predicted.mean() < 0.02
    none = spark.createDataFrame([(None, None), (1, None)], "doc_id long, toxic int")
    scored = toxicity.score(edge, toxicity.fit(edge, none)).toPandas()
    assert len(scored) == 9 and scored.score.between(0, 1).all()


def test_toxicity_sample_counts_labelled_rows(spark, monkeypatch):
    """Labels of unknown ids take no places of the sample, and copies of a row are one."""
    seen, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, labels, n: (seen.append(len(rows)), train(rows, labels, n))[1])
    texts = [(i, f"you awful word{i}" if i % 2 else f"some nice word{i}") for i in range(40)]
    docs = spark.createDataFrame(texts + [texts[3]] * 500 + [texts[4]] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, max_sample=30)
    toxicity.fit(docs, labels, max_sample=1000)
    assert seen == [30, 40]


def test_machine_learns_pairs():
    rng, rows, y = random.Random(2), [], []
    for _ in range(3000):  # label is the exclusive or of two terms: no additive weights can tell
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append([0] * a + [1] * b + [2])
        y.append(float(a != b))
    bias, w, v = toxicity.train(rows, np.array(y), 3)
    m = toxicity.Machine(bias, w, v, {})
    flat, ends = np.concatenate([np.array(r) for r in rows]), np.cumsum([0, *map(len, rows)])
    assert (((m.logits(flat, ends) > 0) == np.array(y)).mean()) > 0.95


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "␛0␛3 ␛", "<s>\n</s>\n", "", "a\nb", "<|im_start|><<SYS>>", "␛␛1</s", "<"]
    rows = [(c, i, r, t) for c in (1, None) for i, (r, t) in enumerate(zip(["user", "assistant", "x\ny", None] * 2, nasty))] + [(2, 0, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(turns)
    for conv in (1, None, 2):
        whole = "".join(r.formatted for r in formatted.where(F.col("conv_id").eqNullSafe(F.lit(conv))).orderBy("turn").collect())
        assert chat.parse_formatted(whole) == [(r or "", t or "") for c, _, r, t in rows if c == conv]
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    loss = "".join(t or "" for c, _, r, t in rows if c == 1 and r == "assistant")
    assert got[1].loss_chars == len(loss) and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[None].turns_sha256 == got[1].turns_sha256 and got[2].n_turns == 1
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_chat_layouts(spark):
    records = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"instruction": "q", "output": "a"},
               {"prompt": "q", "completion": "a"}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"other": 1}]
    table = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, None), (10, "{")], "id long, raw string")
    got = chat.canonical_from_json(table, "id", "raw").toPandas()
    for i in range(4):
        own = got[got.conv_id == i].sort_values("turn")
        assert list(zip(own.role, own.text)) == [("user", "q"), ("assistant", "a")]
    assert got[got.conv_id >= 4].layout.isna().all() and len(got) == 11
    nested = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert [(r.turn, r.role, r.text) for r in chat.canonical_turns(nested).orderBy("turn").collect()] == [(0, "user", "q"), (1, "assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1))


def test_chat_records_with_more_fields(spark):
    records = [{"id": 7, "messages": [{"role": "user", "content": "q", "weight": 1}, {"role": "assistant", "content": "a"}]},
               {"source": "s", "prompt": "q", "completion": "a"}, {"system": "s", "conversations": [], "id": 1}, {"messages": []}, {"messages": "x"}]
    table = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, raw string")
    got = [(r.conv_id, r.layout, r.role, r.text) for r in chat.canonical_from_json(table, "id", "raw").orderBy("conv_id", "turn").collect()]
    assert got == [(0, "messages", "user", "q"), (0, "messages", "assistant", "a"), (1, "prompt", "user", "q"), (1, "prompt", "assistant", "a"),
                   (2, "share", "system", "s"), (4, None, None, None)]


def test_hamming_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 70)).round(2)
    x[50:120] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (900, None), (901, [None, float("nan"), 1.0]), (902, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hamming_search.search(table, table.where("vec_id % 50 = 0"), k=7).toPandas()
    bits = {i: tuple(bool(v[j] is not None and v[j] > 0) if j < len(v) else False for j in range(70)) for i, v in rows if i is not None and v is not None}
    for q in [i for i in bits if i % 50 == 0]:
        want = sorted((sum(a != b for a, b in zip(bits[q], c)), i) for i, c in bits.items() if i != q)[:7]
        own = got[got.query_id == q].sort_values("rank")
        assert list(zip(own.distance, own.id)) == want
    assert hamming_search.search(table.limit(0), table.limit(0)).count() == 0


def test_hamming_search_probes(spark):
    """Rounds meet every code at most once per query, verify few of all pairs, and leave none of the nearest out."""
    rng = np.random.default_rng(6)
    n = 20_000
    x = rng.integers(0, 2**63, n, dtype=np.int64)
    x[n // 2:] = x[:n // 2] ^ (np.int64(1) << rng.integers(0, 63, n // 2)) ^ (np.int64(1) << rng.integers(0, 63, n // 2))
    x[100:1200] = x[100]  # a hot code
    rows = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x)], "vec_id long, c long")
    table = rows.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("c", b).cast("double")).alias("embedding"))
    report = []
    got = hamming_search.search(table, table.where("vec_id % 500 = 0"), k=1, report=report).toPandas()
    distance = np.bitwise_count(x[::500, None].view(np.uint64) ^ x[None].view(np.uint64))
    for at, q in enumerate(range(0, n, 500)):
        want = min((int(d), i) for i, d in enumerate(distance[at]) if i != q)
        own = got[got.query_id == q]
        assert list(zip(own.distance, own.id)) == [want]
    codes = len(np.unique(x))
    assert sum(v for _, _, v in report) < 0.1 * report[0][1] * codes
    assert [asked for _, asked, _ in report] == sorted((asked for _, asked, _ in report), reverse=True)


@pytest.mark.parametrize("bits, n", [(1, 1), (64, 2000), (70, 5), (768, 10**9)])
def test_hamming_segments(bits, n):
    """Segments cover every bit once and stay inside a word."""
    parts = hamming_search.segments(bits, n)
    covered = [64 * p.word + p.shift + b for p in parts for b in range(p.bits)]
    assert covered == list(range(bits)) and all(p.shift + p.bits <= 64 and p.bits <= 16 for p in parts)


@pytest.mark.parametrize("n", [10_256, 51_282, 256_410, 2_500_000])
def test_hamming_segments_weigh_values_probed(n):
    """Random codes: no other number of segments costs much less, where a value probed weighs as ten codes met."""
    kth = next(d for d in range(65) if n * sum(math.comb(64, i) for i in range(d + 1)) >= (hamming_search.K + 1) * 2**64)

    def cost(sizes):
        probed = [(math.comb(b, r), b) for r in range(65) for b in sizes[:max(0, kth - len(sizes) * r + 1)]]
        return sum(values * (10 + n / 2**b) for values, b in probed)

    chosen = [p.bits for p in hamming_search.segments(64, n)]
    others = [[64 // m + (i < 64 % m) for i in range(m)] for m in range(4, 17)]
    assert cost(chosen) <= 1.2 * min(cost(sizes) for sizes in others)


def test_hamming_search_equal_ids_and_few_rows(spark):
    rows = [(1, [1.0, 1.0]), (1, [-1.0, 1.0]), (2, [1.0, -1.0]), (3, [1.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hamming_search.search(table, table, k=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 2), (1, 3), (2, 3), (2, 1), (3, 2), (3, 1)]


def test_near_duplicates(spark, edge):
    got = near_duplicates.near_duplicates(edge).toPandas()
    assert len(got) == 9 and got[got.doc_id.isin([1, 2])].class_id.tolist() == [1, 1, 1]
    assert near_duplicates.keep_one_per_group(edge).count() == got.root.nunique()
    assert near_duplicates.near_duplicates(edge.limit(0)).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(300)] = f"x{rng.random()}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(f"y{rng.random()}" for _ in range(80))) for i in range(20)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).toPandas().set_index("doc_id")
    sets = {i: frozenset(zip(*[words(t)[k:] for k in range(5)])) for i, t in docs}
    classes = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    for i, s in sets.items():
        links = [o for o in classes if o != s and 5 * len(s & o) >= 4 * len(s | o)]
        assert (got.class_id[i], got.n_links[i]) == (classes[s], len(links))
    assert got.group_id[got.index >= 100].nunique() == 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 7), (200, 201), (201, 200), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 0, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mixing(spark, edge):
    got = mixing.mix(edge).toPandas()
    assert len(got) == 9 and (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    sums = spark.createDataFrame([("a", 10, 1.0), ("b", 1000, 2.0), (None, 1, 3.0)], "source string, source_size long, weight double")
    target = {r.source: r.target for r in mixing.water_fill(sums).collect()}
    assert target == {"a": 30.0, None: 3.0, "b": 978.0}
    assert mixing.mix(edge.limit(0)).count() == 0


def brute_force_spans(texts):
    n = suffix_dedup.LENGTH
    seen = Counter(b[p:p + n] for b in texts for p in range(len(b) - n + 1))
    out = []
    for b in texts:
        cover = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen[b[p:p + n]] > 1:
                cover[p:p + n] = b"\1" * n
        out.append(bytes(c for c, k in zip(b, cover) if not k))
    return out


@pytest.mark.parametrize("hot", [2000, 3])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 4096)
    monkeypatch.setattr(suffix_dedup, "BATCH", 4000)
    monkeypatch.setattr(suffix_dedup, "SHARD", 1500)
    rng = random.Random(hot)
    passage = "".join(rng.choices("abcdé ", k=700))
    texts = [passage[rng.randrange(200):rng.randrange(400, 700)].join(["".join(rng.choices("xyz ", k=rng.randint(0, 300))) for _ in range(2)]) for _ in range(25)]
    texts += ["ab" * 400, "q" * 9000, "", "short", texts[0], "".join(rng.choices("abc", k=9000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (77, texts[3]), (77, texts[3])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    want = Counter((i, k) for (i, _), k in zip(rows, brute_force_spans([(t or "").encode() for _, t in rows])))
    assert Counter((None if pd.isna(i) else int(i), bytes(k)) for i, k in zip(got.doc_id, got.kept)) == want


def test_suffix_dedup_bounds_what_meets(spark, monkeypatch):
    """One passage in many surroundings: no key of the merge brings more than HOT pieces together."""
    seen, merge = [], suffix_dedup._merge
    monkeypatch.setattr(suffix_dedup, "HOT", 8)
    monkeypatch.setattr(suffix_dedup, "_merge", lambda pieces: (seen.append(pieces), merge(pieces))[1])
    rng = random.Random(5)
    passage = "".join(rng.choices("abcde ", k=260))
    around = lambda: "".join(rng.choices("uvwxyz ", k=250))
    texts = [around() + passage + around() for _ in range(60)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id")
    assert [bytes(got.kept[i]) for i in range(60)] == brute_force_spans([t.encode() for t in texts])
    key = seen[0].columns[0]
    assert (seen[0].groupBy(key).count().agg(F.max("count")).first()[0] or 0) <= 8


def test_suffix_dedup_edges(edge):
    got = suffix_dedup.remove_repeats(edge, whole_characters=True).toPandas()
    assert len(got) == 9 and (got.n_bytes == got.n_removed + got.kept.map(len)).all()
    for k in got.kept:
        bytes(k).decode("utf-8")
    assert suffix_dedup.remove_repeats(edge.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        left.append(docs.count())
    total = docs.agg(F.sum(F.size(F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != "")))).first()[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.agg(F.sum("n_words")).first()[0] == total and left[0] > left[2] > 0
