"""Main text of web pages by minimum cut (operator 9).

A page falls into blocks of text. A classifier of each block's elements, their names, links,
length against the page's and punctuation gives its log odds of being content: the
capacities to the two terminals. Blocks that follow each other and blocks under one element
are joined by edges whose capacity, the price of labelling them differently, halves with
each step that they are further apart in the document tree. Odds and prices are of one
size, so a lone misjudged block goes with its neighbours. The minimum cut, found by
Dinic's maximum flow, parts content from boilerplate at the least total cost.

Defined results: null or empty html has an empty text; markup that never ends is text up
to its `<`; unclosed elements end with their parents; character references are decoded
once; white space, no-break space too, becomes one space; every block labelled content is
kept whole; of several minimum cuts the one with the least content is taken; repeated rows
are each extracted; columns other than id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by their part in a page.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "math", "canvas", "audio", "video", "head", "title", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset"}
CONTENT = {"article", "main"}
WHOLE = {"html", "body", "main"}
#: What a main, an article by itself and one within a main or article are measured against.
PEERS = {"main": ("main",), "article": ("main", "article", "inner"), "inner": ("article", "inner")}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in a class, id, role or label that speak against a part, and for one.
AGAINST = re.compile(r"(?<![a-z])(?:ads?|advert(?:s|isement|ising|orial)?|adsense|banner|billboard|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|copyright|disclaimer|discussion|disqus|feedback|footer|gdpr|legal|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|alert|overlay|pager|pagination|popup|promo|promoted|promotion|recommend(?:ed|ations)?|related|replies|reply|respond|search|share|sharing|sidebar|signup|skip|social|sponsor(?:ed|s)?|subscribe|subscription|tags|toolbar|tracking|widget|topbar|warning)(?![a-z])")
FOR = re.compile(r"(?<![a-z])(?:article|articlebody|entry|main|maincontent|post|postbody|story|text|content|body)(?![a-z])")

# The classifier: log odds of content, set by hand, for pages have no labels.
W_AGAINST, W_FOR, W_HIDDEN, W_LINKS, W_OUTSIDE = -4.0, 1.5, -6.0, -1.5, -3.0
W_PARAGRAPH, W_HEADING, W_SENTENCE, W_LENGTH = 0.5, 1.0, 0.3, 0.6
#: Prices of labelling neighbours differently: one after the other, and next under one element; at most, at two steps.
NEXT, SIBLING = 1.0, 0.5
#: Steps in the document tree beyond which blocks aren't near.
FAR = 8
#: Capacities are whole numbers of this share of log odds.
UNIT = 1e-4

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']*+(?:\"[^\"]*+\"|'[^']*+'))*+[^>\"']*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|!--(?:.*?)(?:--!?>|\Z)|[!?/][^>]*+>)", re.DOTALL)
_ATTR = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def element_weight(tag: str, attrs: str, within_content: bool, within_article: bool) -> tuple[float, bool]:
    """What an element says of the text in it, and whether its name speaks against it. Names on
    html, body and main tell the page's state, not a part's role; so do an article's, unless
    a whole word of them speaks against it or it stands in another article."""
    w, against = 0.0, False
    if tag in BOILERPLATE or tag == "header" and not within_content:
        w += W_AGAINST
    elif tag in CONTENT:
        w += W_FOR
    if attrs:
        if _HIDDEN.search(attrs):
            w += W_HIDDEN
        names = " ".join(_CAMEL.sub("-", a or b or c) for a, b, c in _ATTR.findall(attrs)).lower()
        if tag == "article" and not within_article:
            against = any(AGAINST.fullmatch(x) for x in names.split())
        elif tag not in WHOLE:
            against = AGAINST.search(names) is not None
        if names and not against and not w and FOR.search(names):
            w += W_FOR / 2
    return w, against


class Block:
    __slots__ = ("doubts", "element", "holder", "links", "parts", "tag", "text", "weight")

    def __init__(self, tag: str, weight: float, element: int, holder: str, doubts: int):
        self.tag, self.weight, self.element, self.parts, self.links = tag, weight, element, [], 0
        self.holder, self.doubts = holder, doubts  # innermost article or main, and names against it


def blocks(page: str) -> tuple[list[Block], list[int], list[int]]:
    """The page's blocks of text in order; each element's parent, and its depth."""
    # an open element: tag, lowest and highest weight so far, number; then the lowest weight by a
    # name and how many names spoke against, both since the innermost article or main, that
    # one's place in PEERS, and how many spoke against it
    stack: list[tuple[str, float, float, int, float, int, str, int]] = [("", 0.0, 0.0, 0, 0.0, 0, "", 0)]
    parent, depth = [0], [0]
    out: list[Block] = []
    now: Block | None = None
    links, pos, size = 0, 0, len(page)

    def put(text: str) -> None:
        nonlocal now
        if now is None:
            if text.isspace():
                return
            tag, low, high, number, named, _, holder, doubts = stack[-1]
            low = min(low, named)
            now = Block(tag, low if low < 0 else high, number, holder, doubts)
            out.append(now)
        text = html_lib.unescape(text) if "&" in text else text
        now.parts.append(text)
        if links:
            now.links += len(text)

    while pos < size:
        lt = page.find("<", pos)
        if lt < 0:
            put(page[pos:])
            break
        m = _TAG.match(page, lt)
        if m is None:
            put(page[pos : lt + 1])
            pos = lt + 1
            continue
        if lt > pos:
            put(page[pos:lt])
        pos = m.end()
        close, tag, attrs = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not close:
            if attrs.endswith("/") and tag in ("svg", "math"):
                continue
            end = re.compile(rf"</{tag}(?![a-z0-9-])[^>]*>|(?=<body[\s>])" if tag == "head" else rf"</{tag}(?![a-z0-9-])[^>]*>", re.IGNORECASE).search(page, pos)
            pos = end.end() if end else (pos if tag == "head" else size)
        elif tag == "br":
            if now is not None:
                now.parts.append(" ")
        elif tag == "a":
            links = 0 if close else 1
        elif tag in BLOCK:
            now = None
            if tag in VOID:
                continue
            if close:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                continue
            if stack[-1][0] == "p":  # a paragraph ends where another block starts
                stack.pop()
            if tag in CLOSES and stack[-1][0] in CLOSES[tag]:
                stack.pop()
            _, low, high, up, named, names, holder, doubts = stack[-1]
            w, against = element_weight(tag, attrs, high >= W_FOR, holder in ("article", "inner"))
            if tag in CONTENT and w >= W_FOR:  # lifts what names around it say; `settle` weighs them
                named, names, holder, doubts = 0.0, 0, "inner" if tag == "article" and holder else tag, doubts + names + against
            elif against:
                named, names = min(named, w + W_AGAINST), names + 1
            parent.append(up)
            depth.append(depth[up] + 1)
            stack.append((tag, min(low, w), max(high, w), len(parent) - 1, named, names, holder, doubts))
    kept = []
    for b in out:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            kept.append(b)
    return kept, parent, depth


def settle(found: list[Block]) -> None:
    """Names against an article or main count only where the page has one with fewer of them."""
    least: dict[str, int] = {}
    for b in found:
        if b.weight >= W_FOR:
            least[b.holder] = min(b.doubts, least.get(b.holder, b.doubts))
    for b in found:
        if b.weight >= W_FOR and b.doubts > min(least[p] for p in PEERS[b.holder] if p in least):
            b.weight += W_AGAINST


def costs(found: list[Block]) -> list[float]:
    """Each block's log odds of being content."""
    marked = any(b.weight >= W_FOR for b in found)  # some element says that it holds the article
    texts = [len(b.text) for b in found if 2 * b.links < len(b.text)]
    usual = median(texts) if texts else 0
    out = []
    for b in found:
        n = len(b.text)
        z = b.weight
        z += W_LENGTH * max(-4.0, min(1.0, math.log2((n + 8) / (usual + 8))))
        z += W_LINKS * min(1.0, b.links / n) * (1 if marked else 2)  # where no element tells, links tell more
        if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            z += W_HEADING
        elif b.tag in ("p", "blockquote", "pre", "td", "dd", "figcaption"):
            z += W_PARAGRAPH
        if b.text[-1] in ".!?…:;":
            z += W_SENTENCE
        if not marked:
            z += 0.5
        elif not b.weight:
            z += W_OUTSIDE
        out.append(z)
    return out


def steps(a: int, b: int, parent: list[int], depth: list[int]) -> int:
    """Steps from an element to another over the one that holds both; FAR if more."""
    n = 0
    while a != b and n < FAR:
        if depth[a] >= depth[b]:
            a = parent[a]
        else:
            b = parent[b]
        n += 1
    return n


def neighbours(found: list[Block], parent: list[int], depth: list[int]) -> list[tuple[int, int, float]]:
    """Edges (block, block, capacity) of blocks that follow each other or are next under one element."""
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            n = steps(found[i - 1].element, b.element, parent, depth)
            if n < FAR:
                alike = 1.0 if b.weight == found[i - 1].weight else 0.5
                edges.append((i - 1, i, NEXT * alike / 2 ** max(0, n - 2)))
        before = last.get((parent[b.element], b.tag))
        if before is not None and before < i - 1 and found[before].weight == b.weight:
            edges.append((before, i, SIBLING))
        last[parent[b.element], b.tag] = i
    return edges


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node stays on the source's side of the least minimum cut. Flow straight
    through a node goes first; then Dinic's phases: levels from all nodes with source left,
    and a blocking flow along them."""
    n = len(source)
    s = [round(x / UNIT) for x in source]
    t = [round(x / UNIT) for x in sink]
    for i in range(n):
        f = min(s[i], t[i])
        s[i] -= f
        t[i] -= f
    to: list[list[int]] = [[] for _ in range(n)]  # arcs of a node; arc k ends at head[k], its reverse is k ^ 1
    head, room = [], []
    for a, b, c in edges:
        for u, v in ((a, b), (b, a)):
            to[u].append(len(head))
            head.append(v)
            room.append(round(c / UNIT))
    while True:
        level = [-1] * n
        layer = [i for i in range(n) if s[i]]
        for i in layer:
            level[i] = 0
        order, open_ = list(layer), False
        for u in order:
            open_ = open_ or bool(t[u])
            for k in to[u]:
                if room[k] and level[head[k]] < 0:
                    level[head[k]] = level[u] + 1
                    order.append(head[k])
        if not open_:
            return [x >= 0 for x in level]
        at = [0] * n
        for start in layer:
            path: list[int] = []  # arcs from start
            u = start
            while s[start]:
                if t[u]:
                    f = min([s[start], t[u], *[room[k] for k in path]])
                    s[start] -= f
                    t[u] -= f
                    cut = len(path)
                    for j, k in enumerate(path):
                        room[k] -= f
                        room[k ^ 1] += f
                        if not room[k] and j < cut:
                            cut = j
                    if cut < len(path):  # go on from the first arc that is full
                        u = head[path[cut] ^ 1]
                        del path[cut:]
                    continue
                while at[u] < len(to[u]):
                    k = to[u][at[u]]
                    if room[k] and level[head[k]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(to[u]):
                    path.append(to[u][at[u]])
                    u = head[path[-1]]
                elif path:
                    u = head[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break


def labelled(page: str) -> tuple[list[Block], list[float], list[bool]]:
    """A page's blocks, their log odds and whether the cut leaves them with the content."""
    found, parent, depth = blocks(page)
    settle(found)
    z = costs(found)
    return found, z, min_cut([max(0.0, x) for x in z], [max(0.0, -x) for x in z], neighbours(found, parent, depth))


def main_text(page: str) -> str:
    found, _, keep = labelled(page)
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(id, url, text, n_chars), one row per page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col).cast("bigint").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).mapInArrow(run, f"`{id_col}` bigint, `{url_col}` string, text string, n_chars bigint")
