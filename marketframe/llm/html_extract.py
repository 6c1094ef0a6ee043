"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Every block element and text run is a node with features: its tag, the kinds of its attribute tokens
and of its ancestors', text, link and punctuation density of its subtree, depth, place among its
siblings and on the page. Trees give each node the chance that it is main text. Decoding minimises the
cost over the whole tree: a subtree is all main text, all rest, or (for a small price) decided child by
child. So a child never contradicts an ancestor that was decided as a whole.

The trees are trained on at most ``MAX_SAMPLE`` pages of the table (by hash of the id), of at most
``MAX_SAMPLE_CHARS`` characters (parameters of ``fit``). Their own
markup (article, main and the like) says which of their blocks are main text; these blocks are then
set into ``COMPOSED`` pages of many layouts, with and without telling tags and names, beside menus,
notices, adverts, forms and reader comments made of other pages' texts.

Defined results: a null or empty page, or one without text, has an empty text; a page whose blocks are
all judged main text keeps them all; repeated rows get equal results; ``br`` is white space; extra
columns pass through, input columns named like the output are replaced.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import boosting
from .html_dom import Node, parse

MAX_SAMPLE, MAX_SAMPLE_CHARS, COMPOSED, MIXED_PRICE = 200, 1_000_000, 500, 2.0
# What the tokens of class, id and role attributes tell, by kind.
KINDS = {
    "main": "article content post entry story main text body prose markdown",
    "menu": "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager tabs toc skip",
    "advert": "ad ads adv advert advertisement banner promo promotion sponsor sponsored adsense teaser offer",
    "comment": "comment comments commentlist discuss discussion disqus reply replies respond responses review reviews feedback",
    "foot": "footer foot bottom copyright legal colophon imprint",
    "side": "sidebar side aside widget related recommended recommend popular trending latest more rail",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay toast message paywall newsletter subscribe subscription signup",
    "share": "share sharing social follow tags tag meta byline author bio",
    "form": "form login search searchbox input field contact register",
    "head": "header head masthead topbar top logo brand site-title hero",
}
_KIND_OF = {w: i for i, words in enumerate(KINDS.values()) for w in words.split()}
_SPLIT = re.compile(r"[^a-z]+")
TAGS = [("article", "main"), ("section",), ("div",), ("p", "blockquote", "pre"), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "menu", "dl"),
        ("li", "dt", "dd"), ("nav",), ("aside",), ("footer",), ("header",), ("form", "fieldset", "label", "button", "select", "option", "legend"),
        ("table", "tbody", "tr", "td", "th"), ("figure", "figcaption"), ("#text",)]
_TAG_OF = {t: i for i, ts in enumerate(TAGS) for t in ts}
N_TAGS, N_KINDS = len(TAGS), len(KINDS)


def token_kinds(attrs: str) -> list[int]:
    return sorted({_KIND_OF[w] for w in _SPLIT.split(attrs) if w in _KIND_OF}) if attrs else []


def features(nodes: list[Node]) -> np.ndarray:
    """One row per node."""
    n = len(nodes)
    chars, links, dots, leaves, longest, words = ([0] * n for _ in range(6))
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if x.tag == "#text":
            t = x.text
            chars[i], links[i], leaves[i], longest[i] = len(t), x.links, 1, len(t)
            dots[i], words[i] = t.count(".") + t.count(",") + t.count("!") + t.count("?"), t.count(" ") + 1
        p = x.parent
        if p >= 0:
            chars[p] += chars[i]
            links[p] += links[i]
            dots[p] += dots[i]
            leaves[p] += leaves[i]
            words[p] += words[i]
            longest[p] = max(longest[p], longest[i])
    flags = np.zeros((n, N_TAGS + N_TAGS + 2 * N_KINDS), np.float32)
    rest = np.zeros((n, 6), np.float32)  # place among siblings, siblings, equal siblings, neighbours' text, offset
    offset = 0
    starts = [0] * n
    for i, x in enumerate(nodes):
        starts[i] = offset
        if x.tag == "#text":
            offset += chars[i]
        row = flags[i]
        if x.parent >= 0:
            row[N_TAGS:2 * N_TAGS] = flags[x.parent][N_TAGS:2 * N_TAGS]
            row[2 * N_TAGS + N_KINDS:] = flags[x.parent][2 * N_TAGS + N_KINDS:]
        if (t := _TAG_OF.get(x.tag)) is not None:
            row[t] = row[N_TAGS + t] = 1
        for k in token_kinds(x.attrs):
            row[2 * N_TAGS + k] = row[2 * N_TAGS + N_KINDS + k] = 1
        own = x.children
        for j, c in enumerate(own):
            r = rest[c]
            r[0], r[1] = j, len(own)
            r[2] = chars[own[j - 1]] if j else 0
            r[3] = chars[own[j + 1]] if j + 1 < len(own) else 0
        if len(own) > 1:
            tags = Counter(nodes[c].tag for c in own)
            for c in own:
                rest[c][4] = tags[nodes[c].tag]
    c, p = np.array(chars, np.float64), np.array([max(x.parent, 0) for x in nodes])
    total, w = max(1.0, c[0]), np.maximum(1, words)
    start, safe = np.array(starts), np.maximum(1.0, c)
    rest[:, 2:4] = np.log1p(rest[:, 2:4])
    rest[:, 5] = (start + c) / total
    body = np.stack([np.log1p(c), links / safe, np.array(dots) / w, c / np.maximum(1, leaves), np.log1p(leaves), np.log1p(longest), c / w,
                     c / np.maximum(1.0, c[p]), c / total, start / total, np.full(n, np.log1p(total)),
                     np.array([x.depth for x in nodes], float), np.array(links)[p] / safe[p]], axis=1)
    return np.concatenate([flags, rest, body], axis=1)


def decode(nodes: list[Node], logits: np.ndarray) -> list[str]:
    """The blocks of main text, in page order."""
    n = len(nodes)
    weight = [1.0] * n
    chars = [len(x.text) for x in nodes]
    for i in range(n - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
    inside = np.logaddexp(0, -logits)  # -log p
    outside = np.logaddexp(0, logits)
    weight = np.log1p(np.array(chars, float))
    all_in, all_out = (inside * weight).tolist(), (outside * weight).tolist()
    best, choice = [0.0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        own = nodes[i].children
        if own:
            split = MIXED_PRICE + sum(best[c] for c in own)
            all_in[i] += sum(all_in[c] for c in own)
            all_out[i] += sum(all_out[c] for c in own)
        else:
            split = float("inf")
        best[i], choice[i] = min((all_in[i], 1), (all_out[i], 0), (split, 2))
    out, verdict = [], [2] * n
    for i, x in enumerate(nodes):
        above = verdict[x.parent] if x.parent >= 0 else 2
        verdict[i] = above if above != 2 else choice[i]
        if x.tag == "#text" and verdict[i] == 1:
            out.append(x.text)
    return out


_MAIN, _REST = {"article", "main"}, {"nav", "aside", "footer", "form", "header"}


def sampled_blocks(page: str) -> tuple[list[tuple[str, str]], list[str]]:
    """(tag, text) of the blocks that the page's own markup calls main text, and the other texts. Without
    such markup, long runs of text with few links count as main."""
    nodes = parse(page)
    tells = any(x.tag in _MAIN or " main" in x.attrs for x in nodes)
    state, main, rest = [0] * len(nodes), [], []
    for i, x in enumerate(nodes):
        state[i] = state[x.parent] if x.parent >= 0 else 0
        if x.tag in _MAIN or x.attrs == " main":
            state[i] = 1
        kinds = token_kinds(x.attrs)
        if x.tag in _REST or kinds and 0 not in kinds:
            state[i] = -1
        if x.tag == "#text":
            if state[i] == 1 if tells else state[i] == 0 and len(x.text) > 80 and x.links * 4 < len(x.text):
                main.append((nodes[x.parent].tag, x.text))
            else:
                rest.append(x.text)
    return main, rest


def compose(main: list[tuple[str, str]], texts: list[str], rng: random.Random) -> str:
    """A page of a random layout that holds the blocks as main text; data-y marks every part."""
    esc = html_lib.escape

    def some(low: int, high: int) -> str:
        words = rng.choice(texts).split()
        at = rng.randrange(max(1, len(words)))
        return esc(" ".join(words[at:at + rng.randint(low, high)]) or "more")

    def names(kind: str) -> str:
        if rng.random() < 0.15:
            return ""
        token = rng.choice(KINDS[kind].split())
        token = rng.choice([token, token, f"{rng.choice(['site', 'page', 'block', 'js', 'c'])}-{token}", f"{token}-{rng.choice(['wrap', 'box', 'list', 'area'])}"])
        return f' {rng.choice(["class", "class", "id"])}="{token}"'

    def links(k: int) -> str:
        item = [f'<a href="/{i}">{some(1, 4)}</a>' for i in range(k)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in item) + "</ul>" if rng.random() < 0.7 else " | ".join(item)

    def paragraphs(k: int, low: int = 5, high: int = 60) -> str:
        return "".join(f"<p>{some(low, high)}</p>" for _ in range(k))

    def part(kind: str) -> str:
        div = rng.choice(["div", "div", "section"])
        tag, body = {
            "menu": (rng.choice(["nav", div, "ul"]), links(rng.randint(3, 12))),
            "head": (rng.choice(["header", div]), some(1, 5) if rng.random() < 0.5 else f"<a href='/'>{some(1, 4)}</a><p>{some(2, 9)}</p>"),
            "foot": (rng.choice(["footer", "footer", div]), f"&copy; {some(2, 30)}" if rng.random() < 0.6 else f"<p>{some(3, 40)}</p>" + links(4)),
            "side": (rng.choice(["aside", "aside", div]), f"<h3>{some(1, 4)}</h3>" + (links(rng.randint(2, 9)) if rng.random() < 0.6 else paragraphs(rng.randint(1, 3), 4, 40))),
            "advert": (rng.choice([div, "aside"]), some(3, 40) if rng.random() < 0.6 else paragraphs(1, 3, 40)),
            "notice": (rng.choice([div, "div", "aside", "dialog"]), rng.choice([some(4, 40), paragraphs(1, 4, 40) + "<button>OK</button>"])),
            "comment": (rng.choice([div, "section", "ol", "ul"]), "".join(
                rng.choice(["<div class='comment'>{0}</div>", "<li>{0}</li>", "<p>{0}</p>", "<article class='comment'><h4>{1}</h4><p>{0}</p></article>"])
                .format(some(4, 60), some(1, 3)) for _ in range(rng.randint(1, 6)))),
            "form": ("form", f"<label>{some(1, 4)}</label><input name=q><select><option>{some(1, 2)}<option>{some(1, 2)}</select><p>{some(2, 25)}</p><button>{some(1, 2)}</button>"),
            "share": (div, links(rng.randint(2, 5)) if rng.random() < 0.7 else some(2, 15)),
        }[kind]
        bare = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6
        return f'<{tag}{"" if bare else names(kind)} data-y="0">{body}</{tag}>'

    inner = [f"<{t if t in ('h1', 'h2', 'h3', 'h4', 'li', 'blockquote', 'pre') and rng.random() < 0.9 else 'p'}>{esc(x)}"
             + rng.choice(["</p>" if t not in ("h1", "h2", "h3", "h4", "li", "blockquote", "pre") else f"</{t}>"]) for t, x in main]
    for _ in range(rng.choice([0, 0, 1, 2])):
        inner.insert(rng.randint(1, len(inner)), part(rng.choice(["advert", "share", "side", "notice", "form"])))
    tag = rng.choice(["article", "article", "main", "div", "div", "section", "td"])
    body = f'<{tag}{names("main") if rng.random() < 0.6 else ""} data-y="1">{"".join(inner)}</{tag}>'
    if tag == "td":
        body = f"<table><tr><td data-y='0'>{links(4)}</td>{body}</tr></table>"
    around = [part(k) for k in ("menu", "head", "advert", "notice", "share") if rng.random() < 0.5]
    after = [part(k) for k in ("comment", "side", "foot", "form", "advert", "share", "notice") if rng.random() < 0.45]
    rng.shuffle(around)
    for _ in range(rng.choice([0, 0, 1, 2])):
        body = f"<div{rng.choice(['', ' id=wrap', ' class=container'])}>{body}{after.pop() if after and rng.random() < 0.4 else ''}</div>"
    return f"<html><head><title>{some(2, 8)}</title></head><body>{''.join(around)}{body}{''.join(after)}</body></html>"


def labelled(nodes: list[Node]) -> np.ndarray:
    """1, 0, or -1 (mixed or unknown) per node: a node is what all its text runs are."""
    low, high = [2] * len(nodes), [-1] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        if x.tag == "#text":
            low[i] = high[i] = x.label if x.label is not None else 0
        if x.parent >= 0 and high[i] >= 0:
            low[x.parent], high[x.parent] = min(low[x.parent], low[i]), max(high[x.parent], high[i])
    return np.array([b if a == b else -1 for a, b in zip(low, high)])


def fit(pages: DataFrame, ident: str = "page_id", html: str = "html", max_sample: int = MAX_SAMPLE,
        max_chars: int = MAX_SAMPLE_CHARS) -> boosting.Trees:
    """Trains on pages composed from at most ``max_sample`` pages of the table, of at most ``max_chars`` characters
    each (both bound what reaches the driver; extraction reads pages of any length)."""
    got = (pages.where((F.length(html) > 0) & (F.length(html) <= max_chars)).select(F.col(html).alias("h"), F.xxhash64(F.lit(9), ident, html).alias("k"))
           .orderBy("k").limit(max_sample).collect())
    blocks = [sampled_blocks(r["h"]) for r in got]
    mains = [m for m, _ in blocks if m] or [[("p", "no page of the table has main text")]]
    texts = [t for m, _ in blocks for _, t in m] + [t for _, r in blocks for t in r] or ["none"]
    rng, xs, ys = random.Random(4), [], []
    for k in range(COMPOSED):
        nodes = parse(compose(mains[k % len(mains)][:rng.randint(1, 40)], texts, rng), marked=True)
        y = labelled(nodes)
        x = features(nodes)
        xs.append(x[y >= 0])
        ys.append(y[y >= 0])
    x, y = np.concatenate(xs), np.concatenate(ys).astype(float)
    return boosting.fit(x, y, np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)))


def extract(pages: DataFrame, model: boosting.Trees, html: str = "html") -> DataFrame:
    """``pages`` without the html column, with text and n_chars (code points)."""
    own = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(*own, F.coalesce(F.col(html).cast("string"), F.lit("")).alias("__mf_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out: list[str] = []
            source = x.column(len(own))
            for at in range(0, len(x), 200):
                trees = [parse(h.as_py()) for h in source[at:at + 200]]
                ends = np.cumsum([len(t) for t in trees])
                logits = np.split(model.logits(np.concatenate([features(t) for t in trees])), ends[:-1])
                out += ["\n\n".join(decode(t, s)) for t, s in zip(trees, logits)]
            yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                                             names=[*own, "text", "n_chars"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("text", StringType()), StructField("n_chars", LongType())]))
