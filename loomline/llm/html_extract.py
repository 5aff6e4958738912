"""Main-text extraction from HTML by minimum-cut labelling of text blocks.

A page is read into text blocks with their place in the element tree. A naive Bayes classifier gives each block the cost of
calling it content and of calling it boilerplate: its terminal capacities. Blocks next to each other on the page and blocks
close in the tree are joined by smoothness edges. The minimum cut, by maximum flow, is the labelling of least total cost.

The classifier learns from the pages themselves: blocks within article or main elements count as content, those within
navigation, footers, forms, adverts and the like as boilerplate, and all others only get scored. Fixed pseudo-counts stand for what a
corpus may not show.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need_columns, ship, text_or_empty

#: Pages from which the classifier learns, about so many, drawn by a hash of the page: a bound on the sample, whatever the input.
LEARN_PAGES = 2000
#: Rows that a worker has as Python objects at a time.
SLICE = 64

TAG_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
COMMENT_END, TAG_STOP = re.compile("--!?>"), re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|["']""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# fixed values of HTML: elements whose content is no text, elements without content, elements within a line of text
NO_TEXT = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "head", "title", "textarea", "select", "datalist"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEAD = {"html", "head", "title", "meta", "link", "base", "script", "style", "noscript", "template"}  # what a head may have; anything else ends it
INLINE = {"audio", "canvas", "datalist", "embed", "input", "math", "meter", "object", "optgroup", "option", "output", "param", "picture", "progress", "select", "source", "svg", "track", "video"} | {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"thead", "tr"}, "tfoot": {"tbody", "tr"}}
SCOPES = {"table", "ul", "ol", "dl", "article", "section", "div", "main", "body", "nav", "aside", "footer", "header", "form"}

# fixed values: elements, and words in class, id or role, that say what a part of a page is
KIND_OF_TAG = {"article": "body", "main": "body", "nav": "nav", "menu": "nav", "footer": "foot", "header": "head", "aside": "side", "form": "form", "button": "form", "label": "form", "fieldset": "form", "dialog": "notice"}
KIND_OF_WORD = (
    dict.fromkeys(("nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "tabs", "skip"), "nav")
    | dict.fromkeys(("footer", "foot", "colophon", "contentinfo", "copyright"), "foot")
    | dict.fromkeys(("header", "masthead", "topbar"), "head")
    | dict.fromkeys(("sidebar", "aside", "widget", "related", "recommended", "complementary", "share", "sharing", "social", "popular", "trending"), "side")
    | dict.fromkeys(("form", "login", "signup", "subscribe", "newsletter", "search"), "form")
    | dict.fromkeys(("cookie", "cookies", "consent", "gdpr", "notice", "banner", "alert", "popup", "modal", "overlay", "dialog", "paywall"), "notice")
    | dict.fromkeys(("ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "outbrain", "taboola"), "ad")
    | dict.fromkeys(("comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "discussion"), "comment")
    | dict.fromkeys(("article", "articlebody", "entry", "story", "post", "main"), "body")
)
#: Words that make a name one of a state or of what something has, not of what it is: "has-sidebar", "comments-open".
STATES = {"has", "with", "without", "no", "not", "is", "open", "opened", "closed", "enabled", "disabled", "active", "hide", "show"}
#: Attributes whose words name a part.
NAMED_BY = ("class", "id", "role", "itemprop", "aria-label")
BOILER = {"nav", "foot", "side", "form", "notice", "ad", "comment", "hidden"}

# fixed pseudo-counts (content, boilerplate) of the feature values; others start at one each
PRIOR = {
    ("kind", "body"): (400, 20), ("kind", "none"): (60, 60), ("kind", "head"): (2, 400), ("kind", "nav"): (0.2, 400), ("kind", "foot"): (0.2, 400), ("kind", "side"): (0.2, 300),
    ("kind", "form"): (0.2, 300), ("kind", "notice"): (0.2, 300), ("kind", "ad"): (0.2, 300), ("kind", "comment"): (0.2, 300), ("kind", "hidden"): (0.2, 300),
    ("links", 0): (300, 120), ("links", 1): (40, 20), ("links", 2): (10, 60), ("links", 3): (3, 300),
    ("words", -1): (40, 40), ("words", 0): (5, 40), ("words", 1): (10, 60), ("words", 2): (20, 50), ("words", 3): (60, 40), ("words", 4): (120, 25), ("words", 5): (120, 8),
    ("stop", None): (60, 60), ("stop", True): (300, 100), ("stop", False): (60, 240), ("tag", "p"): (300, 60), ("tag", "heading"): (60, 30), ("tag", "li"): (30, 150), ("tag", "other"): (60, 120),
}
#: What counts from the corpus is scaled to so many blocks at most, so that fixed knowledge keeps its say.
LEARNED_WEIGHT = 400
#: Capacities are whole numbers, in such parts of a nat.
UNIT = 1000
NEXT_WEIGHT, TREE_WEIGHT = 0.6, 0.9


class Node:
    """An element that is no part of a line, and the one it is in."""

    __slots__ = ("above", "depth")

    def __init__(self, above: Node | None):
        self.above, self.depth = above, above.depth + 1 if above else 0


class Block:
    __slots__ = ("text", "tag", "part", "kind", "node", "links")

    def __init__(self, text: str, tag: str, part: Part | None, node: Node, links: float):
        self.text, self.tag, self.part, self.node, self.links, self.kind = text, tag, part, node, links, "none"


def attributes(text: str) -> dict[str, str]:
    """Names, in small letters, and values without their quotes; of an attribute that is there twice the first counts, as in HTML."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        if m[1]:
            value = m[2] or ""
            out.setdefault(m[1].lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return out


def _own_kind(tag: str, text: str) -> str | None:
    """What part of the page an element is by its own name and attributes. The words of body and html tell of the whole page, not of a part."""
    kind = KIND_OF_TAG.get(tag)
    if not text or tag in ("html", "body"):
        return kind
    given = attributes(text)
    if "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or UNSEEN.search(given.get("style", "")):
        return "hidden"
    for name in NAMED_BY:
        for token in given.get(name, "").split():
            words = [w.lower() for w in WORD.findall(token)]
            if STATES.isdisjoint(words):
                for found in map(KIND_OF_WORD.get, words):
                    if found in BOILER or (found and kind is None):
                        kind = found
    return kind


class Part:
    """An element that says what part of the page it is, the nearest such one around it, and what it holds: characters, and whether there are signs of the page's own text in it."""

    __slots__ = ("kind", "tag", "above", "size", "main", "said")

    def __init__(self, kind: str, tag: str, above: Part | None):
        self.kind, self.tag, self.above, self.size, self.main, self.said = kind, tag, above, 0, False, "none"


def settle(blocks: list[Block], parts: list[Part]) -> None:
    """Gives each block its kind: the outermost boilerplate part that it is in, else the nearest other one. parts: each after the one that it is in.

    A boilerplate part that holds over half of the page's text and, unless it is a form, a first heading, an article or a main element too, is the page's wrapper: its kind says nothing.
    """
    whole = sum(len(b.text) for b in blocks)
    for b in blocks:
        if b.part is not None:
            b.part.size += len(b.text)
    for p in reversed(parts):
        if p.above is not None:
            p.above.size += p.size
            p.above.main |= p.main
    for p in parts:
        around = p.above.said if p.above is not None else "none"
        wraps = p.kind in BOILER and 2 * p.size > whole and (p.main or p.tag == "form")
        p.said = around if around in BOILER or wraps or p.kind == "head" and around == "body" else p.kind  # the heading of an article is part of it
    for b in blocks:
        b.kind = b.part.said if b.part is not None else "none"


def tokens(html: str) -> Iterator[tuple[str, bool, str]]:
    """The text and the tags of a page in order: ("", False, text), or (name, whether it ends the element, attributes). Each character is passed a fixed number of times.

    Comments end as HTML has it, also in --!>, and <!--> and <!---> are whole ones; one without an end goes on to the end of the page. A quote opens a value only after =.
    A tag that would reach the end of the page inside a quoted value ends at the first > instead, and from there on all tags do. Where no > follows at all, the rest is text.
    """
    at = start = 0
    last, careless = html.rfind(">"), False
    unclosed: set[str] = set()
    while (lt := html.find("<", at)) >= 0:
        if lt > last and not html.startswith("<!--", lt):
            break
        if html.startswith("<!--", lt):
            if html.startswith((">", "->"), lt + 4):
                end = html.index(">", lt) + 1
            else:
                end = found.end() if (found := COMMENT_END.search(html, lt + 4)) else len(html)
            name = None
        elif found := TAG_NAME.match(html, lt):
            name, end = found[1].lower(), -1
            stop = found.end()
            while not careless and end < 0:
                mark = TAG_STOP.search(html, stop)
                if mark is None:
                    careless = True
                elif mark[0] == ">":
                    end = mark.end()
                elif mark[0] in unclosed or not html[max(found.end(), mark.start() - 40) : mark.start()].rstrip().endswith("="):
                    stop = mark.end()
                elif (close := html.find(mark[0], mark.end())) < 0:
                    unclosed.add(mark[0])
                    stop = mark.end()
                else:
                    stop = close + 1
            if end < 0:
                end = html.index(">", found.end()) + 1
        elif html.startswith(("<!", "<?", "</"), lt):
            name, end = None, html.index(">", lt) + 1
        else:
            at = lt + 1
            continue
        if start < lt:
            yield "", False, html[start:lt]
        at = start = end
        if name is None:
            continue
        ending, attrs = html[lt + 1] == "/", html[found.end() : end - 1]
        yield name, ending, attrs
        if name in RAW and not ending and not attrs.endswith("/"):
            close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
            at = start = html.find(">", close.end()) + 1 or len(html) if close else len(html)
    if start < len(html):
        yield "", False, html[start:]


class Open:
    """The elements that are open at a place of a page; the nearest of given names is found without going through the others."""

    def __init__(self):
        self.stack: list[tuple] = []  # tag, part, node, no text, in a link, tag and part of the nearest element that is no piece of a line
        self.places: dict[str, list[int]] = {}
        self.push("", None, Node(None), False, False)

    def push(self, tag: str, part: Part | None, node: Node, silent: bool, linked: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        own = self.stack[-1][5] if tag in INLINE and self.stack else (tag, part)
        self.stack.append((tag, part, node, silent, linked, own))

    def _nearest(self, names: set[str]) -> int:
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)

    def close(self, names: set[str], stop: set[str]) -> None:
        """Closes the nearest element of the names and all in it, unless one of stop is nearer."""
        at = self._nearest(names)
        if at and at > self._nearest(stop):
            for tag, *_ in self.stack[at:]:
                self.places[tag].pop()
            del self.stack[at:]


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in page order, with their kinds. Whatever is malformed is read as far as it goes; nothing is left out for its length or depth.

    A head that is not closed ends where an element or a text comes that a head can't have.
    """
    out: list[Block] = []
    kinds: list[Part] = []
    open_ = Open()
    stack = open_.stack
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(text, *stack[-1][5], stack[-1][2], min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    for tag, ending, rest in tokens(html):
        if stack[-1][0] == "head" and (tag not in HEAD if tag else not rest.isspace()):
            open_.close({"head"}, set())
        if not tag or tag == "br":
            if not stack[-1][3]:
                text = unescape(rest) if not tag else " "
                parts.append(text)
                if stack[-1][4]:
                    linked += len(text.strip())
            continue
        inline = tag in INLINE or stack[-1][3]  # within a drawing, a choice or the like nothing ends the line around it
        if not inline:
            flush()
        if ending:
            open_.close({tag}, SCOPES - {tag} if tag in INLINE or tag == "p" else set())
            continue
        if not inline:
            open_.close({"p"}, SCOPES)
            if tag in CLOSED_BY:
                open_.close(CLOSED_BY[tag], {"table", "ul", "ol", "dl", "select"} - {tag})
        if tag in RAW or tag in EMPTY or rest.endswith("/"):  # of raw elements nothing comes
            continue
        top = stack[0] if tag == "body" else stack[-1]
        part, own = top[1], _own_kind(tag, rest)
        if part is not None and (own == "body" or tag == "h1"):
            part.main = True
        if own:
            part = Part(own, tag, part)
            kinds.append(part)
        open_.push(tag, part, top[2] if inline else Node(top[2]), top[3] or tag in NO_TEXT, top[4] or tag == "a")
    flush()
    settle(out, kinds)
    return out


def features(b: Block) -> tuple:
    words = b.text.count(" ") + 1
    tag = b.tag if b.tag in ("p", "li") else "heading" if re.fullmatch("h[1-6]", b.tag) else "other"
    head = tag == "heading"  # short and without a full stop as a matter of course
    return (
        ("kind", b.kind),
        ("links", 0 if b.links < 0.05 else 1 if b.links < 0.35 else 2 if b.links < 0.7 else 3),
        ("words", -1 if head else 0 if words < 3 else 1 if words < 6 else 2 if words < 11 else 3 if words < 26 else 4 if words < 61 else 5),
        ("stop", None if head else b.text[-1] in ".!?…\"»”:;"),
        ("tag", tag),
    )


def weak_label(b: Block) -> int | None:
    return 1 if b.kind == "body" else 0 if b.kind in BOILER else None


class Classifier:
    """Naive Bayes over the feature values of blocks: log-odds that a block is content."""

    def __init__(self, counts: dict[tuple, tuple[int, int]] | None = None):
        counts = counts or {}
        most = [max([1, *(c[i] for k, c in counts.items() if k[0] == "words")]) for i in (0, 1)]
        scale = [min(1.0, LEARNED_WEIGHT / x) for x in most]
        values = {k: [PRIOR.get(k, (1, 1))[i] + counts.get(k, (0, 0))[i] * scale[i] for i in (0, 1)] for k in {*PRIOR, *counts}}
        totals = {name: [sum(v[i] for k, v in values.items() if k[0] == name) for i in (0, 1)] for name in {k[0] for k in values}}
        self.odds = {k: math.log(v[0] / totals[k[0]][0]) - math.log(v[1] / totals[k[0]][1]) for k, v in values.items()}

    def score(self, b: Block) -> float:
        return sum(self.odds.get(x, 0.0) for x in features(b))


def minimum_cut(costs: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it is on the source side of a minimum cut.

    costs: what it costs to put a node on the source side, and on the sink side. edges: (a, b, cost of parting a and b).
    Maximum flow by blocking flows over shortest paths. Nodes that could be on either side go to the source side.
    """
    n = len(costs)
    spare = [sink - source for source, sink in costs]  # what is left after flow straight through a node
    if all(x >= 0 for x in spare):
        return [True] * n
    if all(x < 0 for x in spare):
        return [False] * n
    to: list[int] = []
    room: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n + 2)]
    source, sink = n, n + 1

    def join(a: int, b: int, there: int, back: int) -> None:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, x in enumerate(spare):
        join(source, i, x, 0) if x > 0 else join(i, sink, -x, 0) if x < 0 else None
    for a, b, cost in edges:
        join(a, b, cost, cost)
    while True:
        # distances to the sink: what still reaches it
        level = [-1] * (n + 2)
        level[sink] = 0
        queue = deque([sink])
        while queue:
            v = queue.popleft()
            for e in arcs[v]:
                if room[e ^ 1] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[source] < 0:
            return [x < 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                most = min(room[e] for e in path)
                for e in path:
                    room[e] -= most
                    room[e ^ 1] += most
                first = next(i for i, e in enumerate(path) if not room[e])
                v = to[path[first] ^ 1]
                del path[first:]
            while tried[v] < len(arcs[v]):
                e = arcs[v][tried[v]]
                if room[e] and level[to[e]] == level[v] - 1:
                    path.append(e)
                    v = to[e]
                    break
                tried[v] += 1
            else:
                if v == source:
                    break
                level[v] = -1
                v = to[path.pop() ^ 1]
                tried[v] += 1


def label(blocks: list[Block], classifier: Classifier) -> list[bool]:
    """Whether each block is content."""
    costs = []
    for b in blocks:
        z = max(-30.0, min(30.0, classifier.score(b)))
        soft = math.log1p(math.exp(-abs(z)))
        costs.append((round(UNIT * (soft + max(0.0, -z))), round(UNIT * (soft + max(0.0, z)))))
    edges = []
    last_of: dict[Node, int] = {}
    for i, b in enumerate(blocks):
        if i:
            apart = _apart(blocks[i - 1].node, b.node)
            edges.append((i - 1, i, round(UNIT * NEXT_WEIGHT / (1 + apart))))
        around = b.node.above  # the last block with the same parent, or grandparent
        for _ in range(2):
            if around is None or around.depth == 0:
                break
            if (j := last_of.get(around)) is not None and j != i - 1:
                edges.append((j, i, round(UNIT * TREE_WEIGHT / (1 + _apart(blocks[j].node, b.node)))))
            last_of[around] = i
            around = around.above
    return minimum_cut(costs, edges)


def _apart(a: Node, b: Node) -> int:
    """Elements on the way in the tree from one block to the other, but for the two themselves.

    For blocks that follow each other, these are elements that ended and began between them, so that all ways together are no longer than the page.
    """
    above_a = above_b = 0
    while a is not b:
        if a.depth >= b.depth:
            a, above_a = a.above, above_a + 1
        else:
            b, above_b = b.above, above_b + 1
    return max(0, above_a - 1) + max(0, above_b - 1)


def main_text(html: str | None, classifier: Classifier) -> str:
    """The content blocks of a page, white space in each turned into single spaces, joined by newlines."""
    blocks = blocks_of(html or "")
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks, classifier), strict=True) if keep)


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = LEARN_PAGES) -> Classifier:
    """The classifier from about ``most`` pages, drawn by a hash of the id; counts of feature values come back, no pages.

    Pages without an id, or under one id, are drawn together or not at all; if none is, fixed counts do.
    """
    ship(pages.sparkSession)
    share = min(1.0, most / max(1, pages.count()))
    sample = pages.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < int(share * (1 << 20))).select(F.col(html_col).cast("string").alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for html in b.column(0).to_pylist():
                for block in blocks_of(html or ""):
                    if (y := weak_label(block)) is not None:
                        seen.update((name, str(value), y) for name, value in features(block))
        names, values, ys = zip(*seen, strict=True) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string()), pa.array(ys, pa.int32()), pa.array(list(seen.values()), pa.int64())], ["name", "value", "y", "n"])

    rows = sample.mapInArrow(work, "name string, value string, y int, n long").groupBy("name", "value", "y").agg(F.sum("n").alias("n")).collect()  # a few dozen rows
    typed = {(name, str(value)): (name, value) for name, value in PRIOR}
    counts: dict[tuple, list[int]] = {}
    for r in rows:
        counts.setdefault(typed.get((r["name"], r["value"]), (r["name"], r["value"])), [0, 0])[1 - r["y"]] += r["n"]
    return Classifier({k: tuple(v) for k, v in counts.items()})


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", classifier: Classifier | None = None) -> DataFrame:
    """All columns of pages but html_col, with text and n_chars (code points) of the main text.

    A null html counts as empty; pages without content have an empty text. Repeated rows come out as often as they go in, an
    empty table gives no rows. Columns of pages named text or n_chars are replaced.
    """
    need_columns(pages, id_col, html_col)
    ship(pages.sparkSession)
    classifier = classifier or learn(pages, id_col, html_col)
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*kept, text_or_empty(html_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                texts = [main_text(html, classifier) for html in b.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])

    return rows.mapInArrow(work, rows.withColumn("n_chars", F.lit(0).cast("long")).schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
