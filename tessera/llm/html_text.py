"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text. A linear classifier gives each block a cost of being content and a cost of
being boilerplate, from its length, link density, element, the names of its containers, and the share of
the page's prose that those hold; these become terminal capacities. Blocks that follow one another and
blocks that share a DOM container are tied by smoothness edges; a maximum flow finds the cheapest cut, and
the blocks on the source's side are the text. No name is a veto: a container that holds nearly all of a
page's prose is the article, whatever it is called; only what a browser would not show (`hidden`,
`aria-hidden="true"`, `display:none`) is. Pages are independent: one pass, no shuffle. Markup is scanned in one
go; each end tag takes away what it closes, so time grows with the length, however broken the page is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

# Fixed values of HTML: elements by the way they lay out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
UNREAD = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "p": "p"}
SCOPE = frozenset("table ul ol dl body html article section div main".split())
#: Elements, roles and names of what is beside the text, by how sure they are: 1 may be, 2 is, 3 nearly always is; 4 is not shown.
MAYBE, BESIDE, ALWAYS, UNSEEN = 1, 2, 3, 4
SIDE_TAGS = {"aside": MAYBE, "form": MAYBE, "fieldset": MAYBE, "nav": ALWAYS, "footer": BESIDE, "menu": ALWAYS, "dialog": BESIDE, "search": ALWAYS}
SIDE_ROLES = {"complementary": MAYBE, "form": MAYBE, "banner": MAYBE, "contentinfo": BESIDE, "dialog": BESIDE, "alertdialog": ALWAYS, "alert": BESIDE, "navigation": ALWAYS, "search": ALWAYS, "menu": ALWAYS, "menubar": ALWAYS, "toolbar": ALWAYS}
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner notice alert "
    "nav navbar navigation menu pager footer masthead topbar toolbar sidebar aside rail widget related recommended recommendations "
    "share sharing social follow signup login register search comment comments commentlist disqus replies reply respond disclaimer".split()
)
ALWAYS_WORDS = frozenset("cookie cookies consent gdpr popup modal overlay breadcrumb breadcrumbs pagination newsletter subscribe subscription copyright".split())
TEXT_WORDS = frozenset("article content post entry body story main text prose".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
_ANSWER = re.compile(r"comment|reply|replies")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_SENTENCE = re.compile(r"[.!?…:;。！？][\"'”’)\]]*$")


@dataclass
class Block:
    text: str
    chars: int
    link_chars: int
    tag: str
    in_article: bool
    named_text: bool
    box: int  # its container's number


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])  # of containers
    marks: list[int] = field(default_factory=lambda: [0])  # how sure it is that a container is beside the text


class _Open:
    """An open element that is not inline; of inline ones inside it only their number by tag is kept."""

    __slots__ = ("tag", "article", "named", "box", "unread", "inline", "around", "inside")

    def __init__(self, tag, article, named, box, unread, around):
        self.tag, self.article, self.named, self.box, self.unread = tag, article, named, box, unread
        self.inline: dict[str, int] = {}
        #: Open elements by tag in the scope around this one, and in the one inside it.
        self.around = around
        self.inside: dict[str, int] = {} if tag in SCOPE or around is None else around


def _attributes(attrs: str) -> dict[str, str]:
    """Values by name, unquoted; the first of a name counts."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'").lower())
    return found


def _names(own: dict[str, str]) -> tuple[int, bool]:
    """(how sure the names say beside the text, whether they name the text)."""
    mark, named = SIDE_ROLES.get(own.get("role", ""), 0), False
    for value in (own.get("class", ""), own.get("id", "")):
        found, text = 0, False
        for word in value.split():
            parts = [x for x in _SPLIT.split(word) if x]
            if not parts or {"with", "has", "no", "without"} & set(parts):
                continue
            if word in ALWAYS_WORDS or parts[-1] in ALWAYS_WORDS or ALWAYS_WORDS & set(parts) and SIDE_WORDS & set(parts):
                found = ALWAYS
            elif word in SIDE_WORDS or parts[-1] in SIDE_WORDS:
                found = max(found, BESIDE)
            elif not (SIDE_WORDS | ALWAYS_WORDS).isdisjoint(parts):
                found = max(found, MAYBE)
            text = text or not TEXT_WORDS.isdisjoint(parts)
        mark = max(mark, min(found, MAYBE) if text and found == BESIDE else found)
        named = named or text
    if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", ""):
        mark = UNSEEN
    return mark, named


def parse(source: str) -> Page:
    """Blocks of text in page order, with what their open elements say about them."""
    page = Page()
    stack = [_Open("", False, False, 0, False, None)]
    opened: dict[str, int] = {}  # elements on the stack by tag
    last, loose = source.rfind(">"), False  # loose: a quote was never closed, so quotes count no more
    parts: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = sum(len(t.strip()) for t, link in parts if link)
                own = stack[-1]
                page.blocks.append(Block(text, len(text), min(linked, len(text)), own.tag, own.article, own.named, own.box))
            parts = []

    def close(at: int) -> None:
        nonlocal links
        for o in stack[at:]:
            links -= o.inline.get("a", 0)
            opened[o.tag] -= 1
            o.around[o.tag] -= 1
        del stack[at:]

    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not stack[-1].unread:
            raw = source[at:lt]
            parts.append((html.unescape(raw) if "&" in raw else raw, links > 0))
        if lt >= n:
            break
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if source[lt + 1 : lt + 2] in ("!", "?"):
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(source, lt) if lt < last else None
        rest = _REST.match(source, m.end()) if m and not loose else None
        if m and not rest and m.end() <= last:
            loose, end = True, source.find(">", m.end())
        elif rest:
            end = rest.end() - 1
        else:
            m = None
        if not m:
            if not stack[-1].unread:
                parts.append(("<", links > 0))
            at = lt + 1
            continue
        tag, attrs, at = m[2].lower(), source[m.end() : end], end + 1
        if m[1]:
            if tag in INLINE:
                if (inside := stack[-1].inline).get(tag):
                    links -= tag == "a"
                    inside[tag] -= 1
                continue
            flush()
            if not opened.get(tag):
                continue
            close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag == "br":
            parts.append((" ", links > 0))
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        inline = tag in INLINE
        if not inline and tag not in UNREAD or tag in SAME:
            flush()
            if tag in CLOSES_P or tag in SAME:
                ends = {"p"} if tag in CLOSES_P else set(SAME[tag].split())
                if any(stack[-1].inside.get(x) for x in ends):
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ends))
        up = stack[-1]
        if inline:
            if tag == "a":
                links += 1
            up.inline[tag] = up.inline.get(tag, 0) + 1
            continue
        if tag in RAW:
            closing = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            end = source.find(">", closing.end()) if closing else -1
            at = n if end < 0 else end + 1
            continue
        own = _attributes(attrs) if attrs else {}
        mark, named = _names(own) if own else (0, False)
        if tag in ("html", "body"):
            mark, named = 0, False
        article = up.article or tag in ("article", "main") or own.get("role") == "main"
        if tag in ("article", "main"):
            mark = mark if mark >= ALWAYS or _ANSWER.search(f"{own.get('class', '')} {own.get('id', '')}") else 0
        mark = max(mark, SIDE_TAGS.get(tag, 0), BESIDE if tag == "header" and not up.article else 0)
        page.parents.append(up.box)
        page.marks.append(mark)
        stack.append(_Open(tag, article, up.named or named, len(page.parents) - 1, up.unread or tag in UNREAD, up.inside))
        opened[tag] = opened.get(tag, 0) + 1
        up.inside[tag] = up.inside.get(tag, 0) + 1
    flush()
    return page


#: What a container's mark costs its blocks at most, and how fast the cost falls as it holds more of the page's prose.
MOST, FALL = 12.0, {0: 0.0, MAYBE: 16.0, BESIDE: 30.0, ALWAYS: 60.0}


def penalties(page: Page) -> list[float]:
    """For each container, the largest cost that its own mark or one around it puts on being content."""
    held = [0] * len(page.parents)  # characters of prose
    for block in page.blocks:
        if block.chars >= 40 and 4 * block.link_chars < block.chars:
            held[block.box] += block.chars
    for box in range(len(held) - 1, 0, -1):  # containers come after those around them
        held[page.parents[box]] += held[box]
    out = [0.0] * len(held)
    for box in range(1, len(held)):
        beside, mark = 1 - held[box] / held[0] if held[0] else 1.0, page.marks[box]
        out[box] = max(out[page.parents[box]], MOST if mark == UNSEEN else min(MOST, FALL[mark] * beside))
    return out


def leaning(block: Block, has_article: bool, penalty: float) -> float:
    """The classifier: positive leans to content, negative to boilerplate; the size is the cost of the other label."""
    density = block.link_chars / block.chars
    score = -0.8 + min(block.chars / 60.0, 3.0) - 4.0 * density - penalty
    score += 0.8 if _SENTENCE.search(block.text) else 0.0
    score += {"p": 1.0, "blockquote": 1.0, "pre": 0.8, "h1": 0.8, "h2": 0.6, "h3": 0.6, "h4": 0.4, "li": -0.3, "td": -0.3}.get(block.tag, 0.0)
    score += 4.0 if block.in_article else -4.0 if has_article else 0.0
    return score + (1.0 if block.named_text else 0.0)


def leanings(page: Page) -> list[float]:
    cost = penalties(page)
    has_article = any(b.in_article and cost[b.box] < 4.0 for b in page.blocks)
    return [leaning(b, has_article, cost[b.box]) for b in page.blocks]


class Flow:
    """Maximum flow by blocking flows on layered graphs."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def tie(self, a: int, b: int, there: float, back: float) -> None:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += (b, a)
        self.room += (there, back)

    def levels(self, s: int) -> list[int]:
        level = [-1] * len(self.out)
        level[s] = 0
        queue = [s]
        for u in queue:
            for e in self.out[u]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        while (level := self.levels(s))[t] >= 0:
            at = [0] * len(self.out)
            path: list[int] = []
            u = s
            while True:
                if u == t:
                    low = min(self.room[e] for e in path)
                    back = 0
                    for i, e in enumerate(path):
                        self.room[e] -= low
                        self.room[e ^ 1] += low
                        if self.room[e] <= 1e-9 and not back:
                            back = i + 1
                    del path[back - 1 :]
                    u = self.to[path[-1]] if path else s
                    continue
                edges = self.out[u]
                while at[u] < len(edges):
                    e = edges[at[u]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(edges):
                    path.append(edges[at[u]])
                    u = self.to[path[-1]]
                elif path:
                    e = path.pop()
                    u = self.to[e ^ 1]
                    at[u] += 1
                else:
                    break
        return [x >= 0 for x in level]


#: Smoothness: consecutive blocks, block to its container, container to its parent.
NEXT, INSIDE, NESTED = 0.4, 0.5, 0.2


def ties(page: Page) -> tuple[int, list[tuple[int, int, float]]]:
    """(nodes, smoothness edges): blocks come first, then the containers that hold some."""
    n, boxes = len(page.blocks), {}
    edges = []
    for i, block in enumerate(page.blocks):
        if i and page.blocks[i - 1].box == block.box or i and page.parents[page.blocks[i - 1].box] == page.parents[block.box]:
            edges.append((i - 1, i, NEXT))
        box, below = block.box, i
        weight = INSIDE
        while box > 0:
            known = box in boxes
            node = boxes.setdefault(box, n + len(boxes))
            edges.append((below, node, weight))
            if known:
                break
            below, box, weight = node, page.parents[box], NESTED
    return n + len(boxes), edges


def content_labels(page: Page) -> list[bool]:
    """Which blocks are content: the labels of least cost."""
    lean = leanings(page)
    if all(x > 0 for x in lean) or all(x <= 0 for x in lean):
        return [x > 0 for x in lean]
    n, edges = ties(page)
    flow = Flow(n + 2)
    for i, x in enumerate(lean):
        if x > 0:
            flow.tie(n, i, x, 0.0)
        elif x < 0:
            flow.tie(i, n + 1, -x, 0.0)
    for a, b, weight in edges:
        flow.tie(a, b, weight, weight)
    return flow.source_side(n, n + 1)[: len(lean)]


def main_text(source: str | None) -> str:
    """The page's content blocks, joined by one line break."""
    if not source:
        return ""
    page = parse(source)
    return "\n".join(b.text for b, keep in zip(page.blocks, content_labels(page)) if keep)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages' other columns, with text and n_chars (code points) in place of the html.

    A null or empty page has an empty text; repeated rows are read each; an empty table gives no rows. Broken markup is read as browsers do, roughly: elements left
    open are closed by their successors, text outside any element counts. Columns named text or n_chars are replaced.
    """
    others = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]
    schema = pages.select(*[f.name for f in others]).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*(f.name for f in others), "text", "n_chars"])

    return pages.select(*[F.col(f.name) for f in others], F.col(html_col)).mapInArrow(run, schema)
