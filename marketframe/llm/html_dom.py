"""A small tolerant HTML reader: block elements and the text runs between them, for html_extract."""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

# The elements that HTML lays out as blocks, and those whose content is no text: raw text, which
# ends at its end tag alone, and elements whose text is not shown.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead "
    "tr ul button".split())
RAW = frozenset("script style textarea title iframe".split())
SILENT = frozenset("noscript template svg object canvas audio video map".split())
CLOSED, UNCLOSED = -2, -3  # on the stack, in place of a node: an element of SILENT with or without an end tag
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes the open elements that it names, up to the nearest of the others.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_P_STAYS = frozenset("body html button label option select legend caption td th tr tbody thead tfoot".split())
#: A tag ends at a bracket outside quotes, so that no unfinished tag is read beyond the next one; where quotes do not
#: pair up, at the first bracket.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>")
_ATTR = re.compile(r"\b(class|id|role|itemprop|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MAX_OPEN = 512  # deeper elements are read as part of the one above, as browsers do


class Node:
    """A block element, or (tag #text) a run of text inside one."""
    __slots__ = ("tag", "attrs", "parent", "children", "text", "links", "depth", "label")

    def __init__(self, tag: str, attrs: str, parent: int, depth: int, label):
        self.tag, self.attrs, self.parent, self.depth, self.label = tag, attrs, parent, depth, label
        self.children: list[int] = []
        self.text, self.links = "", 0


def ended(html: str, tag: str) -> set[int]:
    """Where the opening tags of an element end that have an end tag: each end tag is that of the last one open."""
    found, opened = set(), []
    for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>", html, re.I):
        if not m[1]:
            if not m[2].endswith("/"):
                opened.append(m.end())
        elif opened:
            found.add(opened.pop())
    return found


class _Tokens:
    """Text and tags of a page in order: (text before, end, name, attributes); name is null for text and for markup
    that is neither. Every part of the page is looked at a bounded number of times."""

    def __init__(self, html: str):
        self.html, self.n, self.gone = html, len(html), set()

    def _find(self, what: str, at: int) -> int:
        """Where ``what`` comes next; what was not found once is not looked for again."""
        if what in self.gone:
            return -1
        if (found := self.html.find(what, at)) < 0:
            self.gone.add(what)
        return found

    def next(self, at: int) -> tuple[int, int, str | None, tuple[str, str, str] | None]:
        """(where the markup begins, where it ends, the text it stands for, (slash, name, attributes))."""
        html, begin = self.html, at
        while (begin := html.find("<", begin)) >= 0:
            mark = html[begin + 1:begin + 2]
            if mark in ("!", "?"):
                if html.startswith("<!--", begin):
                    end = self._find("-->", begin + 4)
                    return begin, self.n if end < 0 else end + 3, None, None
                if html.startswith("<![CDATA[", begin) and (end := self._find("]]>", begin)) >= 0:
                    return begin, end + 3, html[begin + 9:end], None
                if (end := self._find(">", begin)) >= 0:
                    return begin, end + 1, None, None
            elif m := _TAG.match(html, begin):
                return begin, m.end(), None, (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            begin += 1
        return -1, self.n, None, None

    def end_of_raw(self, tag: str, at: int) -> int:
        """Where the end tag of a raw element ends, or -1."""
        if tag in self.gone:
            return -1
        if m := re.compile(rf"</{re.escape(tag)}\b[^<>]*+>", re.I).search(self.html, at):
            return m.end()
        self.gone.add(tag)
        return -1


def parse(html: str, marked: bool = False) -> list[Node]:
    """Nodes in page order; node 0 is the root. Unclosed, crossed and truncated markup is accepted. An
    element of SILENT without an end tag hides the text up to the next block. ``marked``: the page was made by the
    trainer, whose own attribute names each block's label; on other pages that attribute means nothing."""
    nodes = [Node("#root", "", -1, 0, None)]
    open_tags: list[tuple[str, int]] = []  # (tag, node, or -1 for an inline element, CLOSED, UNCLOSED)
    run: list[str] = []
    state = [0, 0, 0, 0, 0]  # current block, open links, link characters of the run, open CLOSED and UNCLOSED
    ends: dict[str, set[int]] = {}
    tokens, places = _Tokens(html), defaultdict(list)  # places: of the open tags, by name

    def push(tag: str, number: int) -> None:
        places[tag].append(len(open_tags))
        if number == CLOSED and tag in ("noscript", "template", "object"):
            places["#closed"].append(len(open_tags))
        open_tags.append((tag, number))

    def text(raw: str) -> None:
        if raw and not state[3] and not state[4]:
            if "&" in raw:
                raw = unescape(raw)
            run.append(raw)
            if state[1]:
                state[2] += len(raw)

    def end_run() -> None:
        if run:
            whole = " ".join("".join(run).split())
            if whole:
                parent = nodes[state[0]]
                leaf = Node("#text", "", state[0], parent.depth + 1, parent.label)
                leaf.text, leaf.links = whole, min(state[2], len(whole))
                parent.children.append(len(nodes))
                nodes.append(leaf)
            run.clear()
        state[2] = 0

    def close(upto: int) -> None:
        while len(open_tags) > upto:
            tag, number = open_tags.pop()
            places[tag].pop()
            if places["#closed"] and places["#closed"][-1] == len(open_tags):
                places["#closed"].pop()
            if number >= 0:
                end_run()
                state[0] = nodes[number].parent
            elif number < -1:
                state[3 if number == CLOSED else 4] -= 1
            elif tag == "a":
                state[1] = max(0, state[1] - 1)

    at, n = 0, len(html)
    while at < n:
        begin, end, inside, found = tokens.next(at)
        if begin < 0:
            rest = html[at:]
            # an unfinished tag at the end of a truncated page is markup
            cut = rest.rfind("<")
            text(rest[:cut] if cut >= 0 and re.match(r"[/!?a-zA-Z]", rest[cut + 1:cut + 2]) else rest)
            break
        if begin > at:
            text(html[at:begin])
        at = end
        if inside is not None:
            text(inside)
        if found is None:
            continue
        slash, tag, attributes = found
        tag = tag.lower()
        if slash:
            if not places[tag]:
                if tag == "p":
                    end_run()
                continue
            k = places[tag][-1]
            # no end tag inside these reaches out of them
            walls = ("#closed",) if tag in BLOCK else ("#closed", "table", "td", "th", "body")
            if not any(places[w] and places[w][-1] > k for w in walls):
                close(k)
            continue
        if tag == "head":
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = tokens.end_of_raw(tag, at)
                at = end if end >= 0 else at if state[3] or state[4] else n
            continue
        if tag in SILENT:
            if not attributes.endswith("/") and len(open_tags) < MAX_OPEN:
                if tag not in ends:
                    ends[tag] = ended(html, tag)
                kind = CLOSED if at in ends[tag] else UNCLOSED
                push(tag, kind)
                state[3 if kind == CLOSED else 4] += 1
            continue
        if state[3]:
            if tag not in VOID and not attributes.endswith("/") and len(open_tags) < MAX_OPEN:
                push(tag, -1)
                state[1] += tag == "a"
            continue
        if state[4]:
            if tag in BLOCK:
                close(next(k for k, (_, number) in enumerate(open_tags) if number == UNCLOSED))
            elif tag == "br":
                continue
        if tag == "br":
            run.append(" ")
        if tag == "hr":
            end_run()
        if tag in VOID:
            continue
        if tag in CLOSES:
            shut, stop = CLOSES[tag]
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] in stop:
                    break
                if open_tags[k][0] in shut:
                    close(k)
                    if tag not in ("tr",):
                        break
        if tag in BLOCK and tag not in _P_STAYS:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == "p":
                    close(k)
                    break
                if open_tags[k][0] in ("table", "td", "th", "button", "form", "div", "article", "section"):
                    break
        if tag in BLOCK:
            end_run()
        if len(open_tags) >= MAX_OPEN:
            continue
        if tag in BLOCK:
            attrs, label = "", nodes[state[0]].label
            if "=" in attributes:
                for a in _ATTR.finditer(attributes):
                    value = a[2] or a[3] or a[4] or ""
                    if a[1].lower() != "data-y":
                        attrs += " " + value.lower()
                    elif marked:
                        label = int(value)
            parent = nodes[state[0]]
            node = Node(tag, attrs, state[0], parent.depth + 1, label)
            parent.children.append(len(nodes))
            push(tag, len(nodes))
            state[0] = len(nodes)
            nodes.append(node)
        else:
            push(tag, -1)
            if tag == "a":
                state[1] += 1
    close(0)
    end_run()
    return nodes
