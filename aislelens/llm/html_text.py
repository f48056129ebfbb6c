"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and attribute vocabulary of HTML pages.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "select", "button", "object", "title")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What the names of an element say about the text in it, as log odds of being content.
# Names that tell a purpose outweigh long sentences; ones that page builders give to anything
# (widget, form) say little.
TAG_ODDS = {"article": 2.5, "main": 2.5, "nav": -7.0, "footer": -7.0, "menu": -7.0, "dialog": -7.0, "aside": -6.0, "header": -3.0, "form": -0.5}
ROLE_ODDS = {"main": 2.5, "article": 2.5} | dict.fromkeys(
    "navigation banner contentinfo complementary search dialog alert menu menubar".split(), -7.0
)
WORD_ODDS = (
    dict.fromkeys("article content entry main post story".split(), 1.5)
    | dict.fromkeys(
        "ad ads adv advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus disclaimer footer "
        "login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion replies respond search "
        "share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar".split(), -7.0,
    )
    | dict.fromkeys("banner related reply teaser".split(), -4.0)
    | dict.fromkeys("form header widget".split(), -0.5)
)

TITLES = ("h1", "h2")

_ATTRS = "(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<(?P<raw>{'|'.join(RAW)})\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|$)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>{_ATTRS}|[^<>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Weights of the block classifier beside names, as log odds, set by hand, as no page is labelled: a lone word is rather
#: chrome (BIAS), a few words or a sentence bring it near even, many words up to MOST make it content, links alone chrome.
BIAS, LINKED, PER_LOG_WORD, MOST, SENTENCE, HEADING = -1.0, -4.0, 0.8, 100, 0.6, 1.0
#: What the name of an outer element counts for beside that of the next one inside it.
OUTER = 0.3
#: Log odds of blocks in the text's container, and around it; names below CHROME make chrome of running text.
INSIDE, OUTSIDE, CHROME, CONTAINED = 1.0, -3.0, -2.0, 0.75
#: A class or id of an element with more than this share of the page's text ("has-sidebar") doesn't tell what the text is.
PAGE_SHARE = 0.8
#: Capacity of the edge between two blocks below one parent: neighbours, and the next block of the same tag there. Each
#: level of the tree between them divides it by LEVEL, so it is a block's nearness in the document tree.
SMOOTH, SIBLING, LEVEL = 2.0, 0.75, 3.0


class Element:
    """Names of an element as log odds: of its tag and role, and of its class and id (0: they say nothing)."""

    __slots__ = ("tag", "purpose", "label")

    def __init__(self, tag: str, attrs: str):
        purpose, label = [TAG_ODDS.get(tag, 0.0)], [0.0]
        for m in _NAMES.finditer(attrs) if attrs and tag not in ("html", "body") else ():
            words = _WORD.findall((m[2] or m[3] or m[4] or "").lower())
            if m[1].lower() == "role":
                purpose += [ROLE_ODDS.get(w, 0.0) for w in words]
            else:
                label += [WORD_ODDS.get(w, 0.0) for w in words]
        self.tag, self.purpose, self.label = tag, *(min(x) if min(x) < 0 else max(x) for x in (purpose, label))


class Block:
    """Text between the edges of block elements; path: the numbers of the elements around it."""

    __slots__ = ("path", "parts", "linked", "text")

    def __init__(self, path: tuple[int, ...]):
        self.path, self.parts, self.linked, self.text = path, [], 0, ""


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """Text blocks of a page in order, and its block elements by number."""
    out: list[Block] = []
    elements: list[Element] = []
    stack: list[tuple[str, int]] = []  # tag, element number
    at, links = 0, 0
    body = re.search(r"<body\b", page, re.I)
    head = re.search(r"<head\b.*?(?:</head\s*>|(?=<body\b))", page[: body.start() + 5] if body else page, re.I | re.S)
    if head:
        page = page[: head.start()] + page[head.end() :]
    now: Block | None = None

    def add(text: str) -> None:
        nonlocal now
        if now is None:
            if not text.strip():
                return
            now = Block(tuple(s[1] for s in stack))
            out.append(now)
        now.parts.append(text)
        if links:
            now.linked += len(text)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
        elif tag in BLOCK:
            now = None
            if m["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif tag not in VOID:
                while stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
                    stack.pop()
                stack.append((tag, len(elements)))
                elements.append(Element(tag, m["attrs"]))
            links = 0
        elif tag == "a":
            links = 0 if m["end"] else 1
    if at < len(page):
        add(page[at:])
    for b in out:
        b.text = " ".join(entities.unescape("".join(b.parts)).split())
    return [b for b in out if b.text], elements


def log_odds(found: list[Block], elements: list[Element]) -> list[float]:
    """The classifier: log odds that each block is content by its words, links, sentences and tag alone, no names."""
    out = []
    for b in found:
        words = b.text.count(" ") + 1
        score = BIAS + PER_LOG_WORD * math.log(min(words, MOST)) + LINKED * min(1.0, b.linked / len(b.text))
        score += SENTENCE * min(3, sum(b.text.count(c) for c in ".!?")) if words > 4 else 0.0
        tag = elements[b.path[-1]].tag if b.path else ""
        out.append(score + (HEADING if tag[:1] == "h" and tag[1:].isdigit() else 0.0))
    return out


def tree_of(found: list[Block], elements: list[Element]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Nodes of the document tree for the cut: (log odds of each, edges), numbered from len(found) on.

    A node is an element whose names say something, the text's container (the innermost element
    with CONTAINED of the running text outside of chrome), or the page around that. Its log odds
    count once for each block below it. A block is tied to the innermost node around it by that
    node's odds, and a node to the next one outside it by OUTER of that one's for each block
    below: who is in company of whom is decided by the cut.
    """
    held, below, running = [0] * len(elements), [0] * len(elements), [0] * len(elements)
    for b in found:
        for e in b.path:
            held[e] += len(b.text)
            below[e] += 1
    most = PAGE_SHARE * sum(len(b.text) for b in found)
    names: dict[int, float] = {}  # element -> its odds
    inside: dict[int, float] = {-1: 0.0}  # element -> odds of the innermost node around and including it
    for b in found:
        outer = -1
        for e in b.path:
            if e not in inside:
                x, around = elements[e], inside[outer]
                label = 0.0 if x.label < 0 and held[e] > most else x.label
                purpose = 0.0 if x.tag == "header" and around > 0 else x.purpose  # an article's own header
                names[e] = min(label, purpose) if min(label, purpose) < 0 else max(label, purpose)
                inside[e] = names[e] or around
            outer = e
    total = 0
    for b in found:
        if inside[b.path[-1] if b.path else -1] > CHROME:
            total += len(b.text) - b.linked
            for e in b.path:
                running[e] += len(b.text) - b.linked
    holders = [e for e in inside if e >= 0 and running[e] > CONTAINED * total]
    container = max(holders, default=-1)  # elements are numbered outside in
    if container >= 0 and elements[container].tag not in ("html", "body") and below[container] > 1:
        names[container] = names[container] or INSIDE
    else:
        container = -1
    odds: list[float] = []
    edges: list[tuple[int, int, float]] = []
    node: dict[int, int] = {}
    one: list[float] = []  # a node's odds for one block
    if container >= 0:
        node[-1] = 0
        one.append(OUTSIDE)
        odds.append(OUTSIDE * len(found))
    seen: dict[int, int] = {-1: node.get(-1, -1)}
    for i, b in enumerate(found):
        outer = -1
        for e in b.path:
            if e not in seen:
                seen[e] = seen[outer]
                if names[e]:
                    seen[e] = len(odds)
                    odds.append(names[e] * below[e])
                    one.append(names[e])
                    if seen[outer] >= 0 and seen[outer] != node.get(-1):
                        edges.append((len(found) + seen[e], len(found) + seen[outer], OUTER * abs(one[seen[outer]]) * below[e]))
            outer = e
        if seen[outer] >= 0:
            edges.append((i, len(found) + seen[outer], abs(one[seen[outer]])))
    if container >= 0:  # a title beside the container, or beside an element around it, goes with it
        around = next(b.path[: b.path.index(container)] for b in found if container in b.path)
        for i, b in enumerate(found):
            if len(b.path) > 1 and elements[b.path[-1]].tag in TITLES and b.path[-2] in around and seen[b.path[-1]] == node[-1]:
                edges.append((i, len(found) + seen[container], -OUTSIDE))
    return odds, edges


def edges_of(found: list[Block], elements: list[Element]) -> list[tuple[int, int, float]]:
    """Smoothness edges (i, j, capacity): neighbours on the page, and the next block of the same tag below the same grandparent or parent."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            shared = sum(1 for x, y in zip(a.path[:-1], b.path[:-1], strict=False) if x == y)
            out.append((i - 1, i, SMOOTH / LEVEL ** min(60, max(len(a.path), len(b.path)) - 1 - shared)))
        for up in (1, 2):
            key = (up, b.path[:-up], elements[b.path[-1]].tag if b.path else "")
            if len(b.path) >= up and last.get(key, i - 1) != i - 1:
                out.append((last[key], i, SIBLING / LEVEL ** (up - 1)))
            last[key] = i
    return out


def minimum_cut(gain: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut: gain[i] is (from source, to sink), edges work both ways.

    What a node passes straight from source to sink flows at once. The rest flows in phases: each
    numbers nodes by their distance from those with flow left, and fills all paths on which this
    distance grows, so that distances to the sink grow from phase to phase. Nodes that flow left
    over still reaches at the end are the source's side.
    """
    n = len(gain)
    spare = [a - min(a, b) for a, b in gain]
    room = [b - min(a, b) for a, b in gain]
    ends: list[int] = []  # edge k leads to ends[k], edge k ^ 1 back
    left: list[float] = []
    links: list[list[int]] = [[] for _ in range(n)]
    for i, j, c in edges:
        links[i].append(len(ends))
        links[j].append(len(ends) + 1)
        ends += (j, i)
        left += (c, c)
    while True:
        level = [0 if x > 1e-9 else -1 for x in spare]
        queue = deque(i for i in range(n) if level[i] == 0)
        starts, reached = list(queue), False
        while queue:
            i = queue.popleft()
            reached = reached or room[i] > 1e-9
            for k in links[i]:
                if left[k] > 1e-9 and level[ends[k]] < 0:
                    level[ends[k]] = level[i] + 1
                    queue.append(ends[k])
        if not reached:
            return [x >= 0 for x in level]
        tried = [0] * n
        for start in starts:
            i, path = start, []
            while spare[start] > 1e-9:
                if room[i] > 1e-9:
                    flow = min(spare[start], room[i], *(left[k] for k in path))
                    spare[start] -= flow
                    room[i] -= flow
                    for k in path:
                        left[k] -= flow
                        left[k ^ 1] += flow
                    i, path = start, []
                    continue
                while tried[i] < len(links[i]):
                    k = links[i][tried[i]]
                    if left[k] > 1e-9 and level[ends[k]] == level[i] + 1:
                        break
                    tried[i] += 1
                else:
                    if not path:
                        break
                    i = ends[path.pop() ^ 1]
                    tried[i] += 1
                    continue
                path.append(k)
                i = ends[k]


def main_text(page: str | None) -> str:
    """Text of the blocks that the cut labels content, joined by one space."""
    found, elements = blocks(page or "")
    names, ties = tree_of(found, elements)
    gain = [(math.log1p(math.exp(x)), math.log1p(math.exp(-x))) for x in log_odds(found, elements)] + [(max(0.0, x), max(0.0, -x)) for x in names]
    on = minimum_cut(gain, edges_of(found, elements) + ties)
    return " ".join(b.text for b, content in zip(found, on, strict=False) if content)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html): the main text.

    A page is cut into blocks at block elements; raw elements, the head and comments go. Each
    block's classifier odds (words, sentences, links) become its capacities from the source
    (content) and to the sink; so do those of elements whose names or share of the text say
    something (tree_of). Blocks are tied to the innermost such element around them, and to blocks
    next to them or siblings in the document tree, the stronger the nearer they are in the tree,
    whatever their names. The minimum cut says which blocks are content. White space in a block is one space, character references are decoded, nothing
    else is changed. A quote that is never closed ends with its tag. Null or empty html, or no
    content: text '' and 0. Nulls in other columns are passed on; repeated rows each count; a
    very long page is one page, its cut taken as a whole; extra columns, whatever their names,
    are not looked at; no rows give no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return given.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
