"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A small fixed classifier turns each block's ancestors, length and links into a log-odds
of being content; that is the capacity of its edge from the source (content) or to the sink (boilerplate). Blocks that
follow each other, and blocks with the same parent, are joined by edges that weigh more the nearer they are in the
document tree. The minimum cut labels all blocks of the page at once; its source side is the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Callable
from html import unescape
from math import exp, log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag, in which > may stand between quotes.
_REST = re.compile(r"""((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content isn't markup; it is skipped to their end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stay inside the block they stand in.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br nobr label".split())
#: Boilerplate by their name, and by a word of their class, id or role.
OFF_TAGS = frozenset("nav footer aside form button select option menu dialog head noscript template svg canvas object video audio map fieldset datalist".split())
OFF_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall "
    "newsletter subscribe subscription signup signin login share sharing social related recommend recommended recommendations trending popular comment comments respond disqus reply replies "
    "discussion reviews sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs footer footnav masthead topbar toolbar copyright legal disclaimer search searchbox pagination pager "
    "tags tagcloud complementary contentinfo form hidden skip".split()
)
ON_TAGS = {"article": 3.0, "main": 3.0}
ON_WORDS = frozenset("article content post entry story body text main prose maincontent articlebody".split())
_NO = frozenset("has with no without show hide is".split())
#: Open elements that a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of a block that counts as prose, and prose that a page's text has at least.
PROSE_BLOCK, PROSE_PAGE = 5, 20
#: Steps in the tree beyond which a distance counts as so many.
FARTHEST = 60
#: How strongly neighbours hold together, and how that falls off with each step between them in the tree.
TOGETHER, FALL = 1.0, 1.6
_kinds: dict[tuple[str, str], tuple[float | None, bool]] = {}


def _kind(tag: str, attributes: str) -> tuple[float | None, bool]:
    """What an element says about the text in it as log-odds (None if nothing), and whether a mere name says that it is boilerplate."""
    key = (tag, attributes)
    if key not in _kinds:
        if len(_kinds) > 50_000:
            _kinds.clear()
        said, named = None, False
        if tag in OFF_TAGS:
            said = -6.0
        elif tag not in ("html", "body"):
            words = []
            for _, value in _NAMED.findall(attributes):
                for name in value.strip("\"'").split():
                    parts = [p.lower() for p in _PART.findall(name)]
                    words += [] if parts and parts[0] in _NO else parts
            if re.search(r"\bhidden\b|display\s*:\s*none", attributes, re.I):
                said = -5.0
            elif OFF_WORDS.intersection(words):
                said, named = -5.0, True
            elif tag in ON_TAGS:
                said = ON_TAGS[tag]
            elif ON_WORDS.intersection(words):
                said = 2.0
            elif tag == "header":
                said = -5.5
        _kinds[key] = said, named
    return _kinds[key]


class Node:
    """An open element: its tag, the element it stands in, how deep that is, and what it or the nearest one above says.

    own is what it says itself; mark the nearest element, this one included, whose name alone says boilerplate.
    """

    __slots__ = ("depth", "mark", "own", "prose", "said", "tag", "up", "void")

    def __init__(self, tag: str, up: Node | None, own: float | None, named: bool):
        self.tag, self.up, self.own = tag, up, own
        self.depth = up.depth + 1 if up else 1
        above = up.said if up else None
        self.said = above if own is None else own
        self.mark = self if named else up.mark if up else None
        self.prose, self.void = 0, False


class Block:
    __slots__ = ("at", "links", "text")

    def __init__(self, text: str, links: int, at: Node | None):
        self.text, self.links, self.at = text, links, at

    @property
    def said(self) -> float | None:
        return self.at.said if self.at else None

    @property
    def tag(self) -> str:
        return self.at.tag if self.at else ""


def tokens_of(html: str):
    """(text, tag, closing, attributes) by turns: the text before each tag, and the tag; tag is empty for what is none.

    Every character is looked at a bounded number of times, whatever the page.
    """
    start = at = 0
    last = html.rfind(">")
    ends: Callable[[int], int] | None = None
    while True:
        i = html.find("<", at)
        if i >= 0 and html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            yield html[start:i], "", False, ""
            start = at = len(html) if end < 0 else end + 3
            continue
        if i < 0 or i > last:
            yield html[start:], "", False, ""
            return
        if html.startswith(("<!", "<?"), i):
            yield html[start:i], "", False, ""
            start = at = html.find(">", i) + 1
            continue
        name = _NAME.match(html, i + 1)
        if not name:
            at = i + 1
            continue
        rest = _REST.match(html, name.end()) if ends is None else None
        if rest:
            end = rest.end()
        else:
            # a quote without its end: from here on the page's quotes are looked up in a table
            ends = ends or _tag_ends(html)
            end = ends(name.end()) + 1 or html.find(">", name.end()) + 1
        attributes = html[name.end() : end - 1]
        tag = name[2].lower()
        yield html[start:i], tag, bool(name[1]), attributes
        start = at = end
        if tag in RAW and not name[1]:
            found = _RAW_END[tag].search(html, end)
            start = at = found.end() if found else len(html)


def _tag_ends(html: str) -> Callable[[int], int]:
    """Where the first > outside quotes stands from a position on, -1 if nowhere: what _REST finds, in one go for a whole page."""
    places = [m.start() for m in re.finditer("[\"'>]", html)]
    following: dict[str, int] = {}
    found = [-1] * (len(places) + 1)
    for k in range(len(places) - 1, -1, -1):
        sign = html[places[k]]
        if sign == ">":
            found[k] = places[k]
        else:
            partner = following.get(sign)  # the quote that ends this one
            found[k] = found[partner + 1] if partner is not None else -1
            following[sign] = k
    return lambda at: found[bisect_left(places, at)]


_RAW_END = {tag: re.compile(rf"</{tag}\s*>?", re.I) for tag in RAW}


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in order: references decoded, white space made single spaces, no empty ones."""
    out: list[Block] = []
    stack: list[Node] = []
    opened: Counter[str] = Counter()
    nodes: list[Node] = []
    parts: list[str] = []
    links = in_link = 0
    in_body = False

    def flush():
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(links, len(text)), stack[-1] if stack else None))
            parts.clear()
        links = 0

    def leave(upto: int) -> None:
        while len(stack) > upto:
            opened[stack.pop().tag] -= 1

    for raw, tag, closing, attributes in tokens_of(html):
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                links += len(text.strip())
        if not tag or tag in RAW and not closing:
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = not closing
            continue
        flush()
        in_link = 0
        if closing:
            if opened[tag]:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            continue
        if tag in VOID:
            continue
        if stack and stack[-1].tag == "p":
            leave(len(stack) - 1)
        ends = ENDS.get(tag)
        while ends and stack and stack[-1].tag in ends:
            leave(len(stack) - 1)
        if tag == "body" and not in_body:
            in_body = True
            leave(next((i for i, s in enumerate(stack) if s.tag != "html"), len(stack)))
        said, named = _kind(tag, attributes)
        above = stack[-1].said if stack else None
        if tag == "header" and said == -5.5 and above is not None and above > 0:
            said = None  # an article's own header
        stack.append(Node(tag, stack[-1] if stack else None, said, named))
        nodes.append(stack[-1])
        opened[tag] += 1
    flush()
    _trust_names(out, nodes)
    return out


def _trust_names(blocks: list[Block], nodes: list[Node]) -> None:
    """Names such as social-history or reply don't make a page's only text boilerplate.

    Where what no name or element calls boilerplate has hardly any prose, the element that has most of the prose which
    only names speak against is taken at its text: its name, and those of the elements around it, say nothing.
    """
    free, marks = 0, {}
    for b in blocks:
        words = b.text.count(" ") + 1
        prose = int(words * (1 - b.links / len(b.text))) if words >= PROSE_BLOCK else 0
        if b.said is None or b.said > 0:
            free += prose
        elif b.at.mark and b.said == b.at.mark.own and prose:
            marks[id(b.at.mark)] = b.at.mark
            b.at.mark.prose += prose
    if free >= PROSE_PAGE or not marks:
        return
    node = max(marks.values(), key=lambda m: m.prose)
    if node.prose < PROSE_PAGE:
        return
    while node:
        node.void = True
        node = node.up.mark if node.up else None
    for n in nodes:  # those above come first
        above = n.up.said if n.up else None
        n.said = above if n.own is None or n.void else n.own


def log_odds(b: Block) -> float:
    """The classifier: positive for content."""
    share = b.links / len(b.text)
    score = (-0.3 if b.said is None else b.said) + min(3.0, max(-1.5, 0.8 * (log2(1 + b.text.count(" ") + 1) - 2.5)))
    if share > 0.3:
        score -= 5.0 * share
    if b.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"):
        score += 0.5
    if b.text[-1] in ".!?\"”":
        score += 0.3
    if b.text[0] == "©" or "All rights reserved" in b.text:
        score -= 3.0
    return score


def _steps(a: Node | None, b: Node | None) -> int:
    """Steps in the tree from one element to another, less two; FARTHEST at most."""
    steps = 0
    while a is not b and steps < FARTHEST + 2:
        if a is None or b is not None and b.depth >= a.depth:
            b = b.up
        else:
            a = a.up
        steps += 1
    return max(0, steps - 2)


def neighbours(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges (i, j, weight) between blocks that follow each other and between the nearest blocks of one parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for j, b in enumerate(blocks):
        if j:
            edges[j - 1, j] = TOGETHER * exp(-_steps(blocks[j - 1].at, b.at) / FALL)
        parent = id(b.at.up) if b.at else 0
        i = last.get(parent)
        if i is not None and i != j - 1:
            edges[i, j] = TOGETHER / 2
        last[parent] = j
    return [(i, j, w) for (i, j), w in edges.items()]


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut (the largest boilerplate side among equally good cuts).

    Nodes whose own capacity is no less than all their edges together are settled first and hand their edges on as
    capacities of their neighbours, which leaves the minimum as it is; the rest is solved by shortest augmenting paths.
    """
    n = len(odds)
    beside: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        beside[i][j] = beside[i].get(j, 0.0) + w
        beside[j][i] = beside[j].get(i, 0.0) + w
    own = list(odds)
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None:
            continue
        held = sum(beside[i].values())
        if own[i] > held or own[i] <= -held:
            label[i] = own[i] > held
            for j, w in beside[i].items():
                del beside[j][i]
                own[j] += w if label[i] else -w
                todo.append(j)
            beside[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, on in zip(left, _max_flow_side(left, own, beside)):
            label[i] = on
    return label


def _max_flow_side(nodes: list[int], own: list[float], beside: list[dict[int, float]]) -> list[bool]:
    """Dinic's algorithm with source -1 and sink -2; True for what the source still reaches."""
    rest: dict[int, dict[int, float]] = {-1: {}, -2: {}}
    for i in nodes:
        rest[i] = dict(beside[i])
        if own[i] > 0:
            rest[-1][i], rest[i][-1] = own[i], 0.0
        elif own[i] < 0:
            rest[i][-2], rest[-2][i] = -own[i], 0.0
    tiny = 1e-12
    while True:
        level, todo = {-1: 0}, deque([-1])
        while todo:
            u = todo.popleft()
            for v, c in rest[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    todo.append(v)
        if -2 not in level:
            return [i in level for i in nodes]
        ways, tried, path = {u: list(rest[u]) for u in level}, dict.fromkeys(level, 0), [-1]
        while path:
            u = path[-1]
            if u == -2:
                push = min(rest[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    rest[a][b] -= push
                    rest[b][a] = rest[b].get(a, 0.0) + push
                path = [-1]
                continue
            while tried[u] < len(ways[u]):
                v = ways[u][tried[u]]
                if rest[u][v] > tiny and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
                tried[u] += 1
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1  # nothing gets through there any more


def main_text(html: str | None) -> str:
    """The blocks that the cut calls content, one to a line; empty for null and for pages without any."""
    blocks = blocks_of(html or "")
    keep = min_cut([log_odds(b) for b in blocks], neighbours(blocks))
    return "\n".join(b.text for b, on in zip(blocks, keep) if on)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every row; the whole page is read and nothing of the text is left out for length.

    Null and empty html give an empty text; null ids and urls and rows that repeat stay; an empty table gives an empty
    one; other columns are left out, so their names can't clash. A page takes time in proportion to its length.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([main_text(h.as_py()) for h in part.column(2)], pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(lean(run), f"page_id {kinds[0]}, url {kinds[1]}, text string")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page (null html: empty) and its length; see extract_text."""
    return extract_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
ORACLES: dict[str, str] = {}
