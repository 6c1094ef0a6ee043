"""Periodic runs, cross-tokenizer alignment and benchmark decontamination: brute force, edge tables, oracles."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from marketframe.llm import decontamination, periodic_runs, queries, token_alignment
from scripts_compare import frames_equal

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n_words string, runs int, hits string, items int, n_a string, n_links int, count_sum string, pattern int"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, extra columns named like outputs."""
    rest = ("x", 1, "h", 2, "a", 3, "c", 4)
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [(1, "a b " * 10, "en", *rest)] * 2 + [(2, long, "de", *rest), (None, None, None, *[None] * 8), (None, "a b c", "en", *rest),
                                                 (3, "", "en", *rest), (4, " \n\t ", "en", *rest), (5, "x" * 100_000, "en", *rest),
                                                 (6, "é☃ ünï\x0bcode ▁ \x00 漢字", "fr", *rest)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("key", ["op11_periodic_runs", "op13_decontamination"])
def test_oracle_on_edges(spark, edge, key, tmp_path):
    """The queries over a table of edge rows against their SQL."""
    edge.select("doc_id", "text").where("doc_id <> 5 or doc_id is null").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "a b a b a b a b a b a"), (1, "b a b a b a b a b a b"), (2, "W3, W4!"), (None, "w7 w8"), (3, None), (4, " .. "), (5, "c")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[key](spark, str(tmp_path))
    ok, why = frames_equal(got.toPandas(), con.sql(queries.ORACLES[key]).df())
    assert ok, why


def brute_runs(words, shortest=12):
    """Every maximal stretch that agrees with itself at a distance, under its smallest period."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            first = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > first and i - first + p >= max(shortest, 2 * p):
                found.setdefault((first, i + p), p)
            i += 1
    return sorted((a, p, b) for (a, b), p in found.items())


def some_words(rng):
    w = [rng.randrange(rng.choice([1, 2, 2, 3, 5, 40])) for _ in range(rng.randint(0, rng.choice([10, 60, 200])))]
    if len(w) > 20 and rng.random() < 0.5:
        a = rng.randrange(len(w))
        p = 1 + (len(w) - a) // rng.randint(3, 9)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    return w


def test_catchers_against_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        texts = [some_words(rng) for _ in range(4)]
        runs, collapsed = periodic_runs._slab([[b"%d" % x for x in t] for t in texts], 12)
        for t, r, c in zip(texts, runs, collapsed):
            want = brute_runs(t)
            assert [(x["start"], x["period"], x["start"] + x["length"]) for x in r] == want
            gone = {i for a, p, b in want for i in range(a + p, b)}
            assert c.decode() == " ".join(str(x) for i, x in enumerate(t) if i not in gone)


def test_catchers_word_by_word():
    """Appending one word at a time, or in slabs of any size, finds the same runs; a square shows when it is complete."""
    rng = random.Random(6)
    for _ in range(40):
        t = np.array(some_words(rng), np.int64)
        single, slabs, at = periodic_runs.SquareCatchers(), periodic_runs.SquareCatchers(), 0
        for i, x in enumerate(t):
            single.append(np.array([x]))
            if i % 17 == 0:
                s, e, p = single.runs()
                assert list(zip(s.tolist(), p.tolist(), e.tolist())) == brute_runs(t[:i + 1].tolist())
        while at < len(t):
            step = rng.randint(1, 50)
            slabs.append(t[at:at + step])
            at += step
        for catchers in (single, slabs):
            s, e, p = catchers.runs()
            assert list(zip(s.tolist(), p.tolist(), e.tolist())) == brute_runs(t.tolist())


def test_catchers_cost_two_comparisons_a_level():
    """A text of one word only: 2 n catches a level, and one run."""
    catchers = periodic_runs.SquareCatchers()
    caught = catchers.append(np.zeros(50_000, np.int64))
    assert caught <= 2 * 50_000 * len(catchers.names)
    assert [x.tolist() for x in catchers.runs()] == [[0], [50_000], [1]]


def test_runs_edges(edge):
    got = periodic_runs.find_runs(edge)
    assert set(got.columns) == set(edge.columns) | {"collapsed"}
    rows = got.collect()
    assert len(rows) == 9
    same = [r for r in rows if r.doc_id == 1]
    assert len(same) == 2 and all([tuple(x) for x in r.runs] == [(0, 20, 2)] and r.collapsed == "a b" for r in same)
    assert [(r.n_words, r.runs, r.collapsed) for r in rows if r.text is None] == [(0, [], "")]
    long = next(r for r in rows if r.doc_id == 2)
    assert [tuple(x) for x in long.runs] == [(0, 20_000, 977)] and len(long.collapsed.split()) == 977
    assert periodic_runs.find_runs(edge.limit(0)).count() == 0


def test_planted_repeats(spark):
    """The query's own repeated texts, by the rule of its contract."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    planted = {r.doc_id: r.text for r in queries.with_repeats(docs).collect()}
    for r in docs.collect():
        h = zlib.crc32(str(r.doc_id).encode())
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        if h % 10 or not w:
            assert planted[r.doc_id] == r.text
            continue
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert planted[r.doc_id].split(" ") == [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_wu_manber_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        alphabet = rng.choice(["ab", "abC", "aé ☃"])

        def text(n):
            return "".join(rng.choice([*alphabet, " ", " ", ".", "\n", "Z", "0", "\x00", "\x01", "𝄞"]) for _ in range(n))

        window = rng.choice([2, 3, 10])
        items = [(str(rng.randrange(6)), text(rng.randint(0, rng.choice([3, 40, 80])))) for _ in range(5)]
        texts = [text(rng.randint(0, 9)) + rng.choice(["", " ", "-"]) + rng.choice(items)[1].upper() * rng.choice([0, 1, 2]) + text(5) for _ in range(6)] + ["", "  ", "\x00"]
        patterns = defaultdict(set)
        for item, t in items:
            w = folded(t)
            for k in range(max(1, len(w) - window + 1) if w else 0):
                patterns[tuple(w[k:k + window])].add(item)
        searcher = decontamination._Searcher([(" ".join(["", *p, ""]).encode(), i) for p, own in patterns.items() for i in own])
        for t, (n, spans, found) in zip(texts, searcher.hits([t.encode() for t in texts])):
            w = folded(t)
            at = [(i, p) for p in patterns for i in range(len(w)) if tuple(w[i:i + len(p)]) == p]
            assert n == len(w) and found == {i for _, p in at for i in patterns[p]}
            assert {k for a, b in spans for k in range(a, b)} == {k for i, p in at for k in range(i, i + len(p))}


def test_shifts_skip():
    """A text without benchmark words is left in steps of nearly a whole window."""
    own = decontamination._Class([b" " + b"benchmark words " * 4], np.array([0]))
    assert own.m == 65 and own.shift.max() == own.m - decontamination.BLOCK + 1 and own.shift.mean() > 57


def test_leaks_edges(spark, edge):
    items = spark.createDataFrame([(1, "a b a b a b a b a b a"), (2, "W3, W4!"), (None, "b c"), (3, None), (4, " .. ")], "item_id long, text string")
    got = decontamination.find_leaks(edge, items)
    assert set(got.columns) == set(edge.columns)
    rows = got.collect()
    assert len(rows) == 9
    assert all([tuple(h) for h in r.hits] == [(0, 20)] and r["items"] == ["1"] for r in rows if r.doc_id == 1)
    assert [(r.n_words, r.hits, r["items"]) for r in rows if r.text is None] == [(0, [], [])]
    assert [(r["items"], [tuple(h) for h in r.hits]) for r in rows if r.text == "a b c"] == [([""], [(1, 3)])]
    assert next(r for r in rows if r.doc_id == 2)["items"] == ["2"]
    # several groups of patterns, each in a pass of its own, find the same
    several = decontamination.find_leaks(edge, items, pattern_bytes=20).collect()
    assert sorted(map(str, several)) == sorted(map(str, rows))
    assert decontamination.find_leaks(edge.limit(0), items).count() == 0
    assert not any(r.hits for r in decontamination.find_leaks(edge, items.limit(0)).collect())


def brute_alignment(tokenizers, text):
    if not text:
        return None
    a, b = tokenizers.a.encode(" " + text, add_special_tokens=False).ids, tokenizers.b.encode(text)
    if not b"".join(tokenizers.a_bytes[i] for i in a) == b"".join(tokenizers.b_bytes[i] for i in b) == (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum(tokenizers.a_len[a]).tolist(), np.cumsum(tokenizers.b_len[b]).tolist()
    groups, begin = [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        groups.append(tuple([i for i, e in zip(ids, ends) if begin < e <= end] for ids, ends in ((a, ends_a), (b, ends_b))))
        begin = end
    return groups


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups or [])


def test_alignment_against_whole_texts():
    """Parts, merge_asof and groups against encoding each whole text and comparing ends."""
    tokenizers = token_alignment._tokenizers(token_alignment.BYTE_LEVEL, token_alignment.PIECES)
    assert tokenizers.cuts
    rng = random.Random(1)
    bits = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "ü", "☃", "𝄞", "漢", "字", "\xa0", "\r", "\x1c", "\x85", "<", "</s>", "<0x41>", "<|endoftext|>",
            "'s", "'", "1", "23", ".", "!!", "ﬁ", "é", "　", "\x00", "==", "    "]
    for turn in range(100):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(20)]
        if turn % 20 == 0:
            texts[3:5] = ["a▁b c", "=-" * 3000 + "x" * 5000 + "漢" * 900]
        found = token_alignment.Aligned(tokenizers, texts)
        figures, shown, (doc, pair, times) = np.array(found.figures()).T, found.shown(), found.pairs()
        for i, text in enumerate(texts):
            groups = brute_alignment(tokenizers, text) or []
            assert shown[i] == written(groups)
            assert figures[i].tolist() == [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(len(a) * len(b) for a, b in groups)]
            links = Counter(x * len(tokenizers.b_bytes) + y for a, b in groups for x in a for y in b)
            assert dict(zip(pair[doc == i].tolist(), times[doc == i].tolist())) == links


def test_large_group_is_condensed(monkeypatch):
    """Groups with many links are expanded from distinct ids, in short runs, to the same pairs."""
    tokenizers = token_alignment._tokenizers(token_alignment.BYTE_LEVEL, token_alignment.PIECES)
    texts = ["漢字 ☃" * 20, "plain words here"]
    plain = token_alignment.Aligned(tokenizers, texts).pairs()
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", 1)
    monkeypatch.setattr(token_alignment, "RUN_PAIRS", 3)
    for x, y in zip(plain, token_alignment.Aligned(tokenizers, texts).pairs()):
        assert x.tolist() == y.tolist()


def test_packed_numbers():
    numbers = np.r_[np.arange(300), 2**40, random.Random(1).sample(range(2**50), 50), 0]
    assert (token_alignment.unpacked(token_alignment.packed(numbers)[0].tobytes()) == numbers).all()
    assert len(token_alignment.unpacked(b"")) == 0


def test_token_alignment_query(spark, monkeypatch):
    """The whole query, counts of the corpus included, against brute force."""
    monkeypatch.setattr(token_alignment, "BLOCK_PAIRS", 5000)
    got = {r.doc_id: r for r in queries.op12_token_alignment(spark, SF).collect()}
    tokenizers = token_alignment._tokenizers(token_alignment.BYTE_LEVEL, token_alignment.PIECES)
    docs = {r.doc_id: brute_alignment(tokenizers, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    links = {d: Counter((x, y) for a, b in g or [] for x in a for y in b) for d, g in docs.items()}
    count, top = Counter(p for c in links.values() for p in c), Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    assert got.keys() == docs.keys()
    for d, groups in docs.items():
        r = got[d]
        assert (r.n_groups, r.n_links) == (len(groups or []), sum(links[d].values()))
        assert r.groups_sha256 == (hashlib.sha256(written(groups).encode()).hexdigest() if groups else "")
        assert r.n_best == sum(n for p, n in links[d].items() if count[p] == top[p[0]])
        assert r.count_sum == sum(n * count[p] for p, n in links[d].items())


def test_token_alignment_edges(edge):
    got = token_alignment.link_statistics(edge).collect()
    assert len(got) == 9
    empty = [r for r in got if r.n_a == 0]
    assert sorted(str(r.doc_id) for r in empty) == ["3", "6", "None"]  # 6 has U+2581 in its text
    assert all((r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (0, 0, 0, 0, 0, "") for r in empty)
    one, two = [r for r in got if r.doc_id == 1]
    assert one == two and one.n_best > 0 and one.lang == "en" and one["items"] == 2
    plain = {r.doc_id: r for r in token_alignment.align(edge).collect() if r.doc_id}
    assert all(hashlib.sha256(plain[r.doc_id].groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.doc_id and r.n_a)
    assert token_alignment.link_statistics(edge.limit(0)).count() == 0
