"""Main-text extraction by minimum cut.

A page becomes a list of text blocks in order.  A classifier gives each block the cost of
calling it content and that of calling it boilerplate, from its text (length, links,
punctuation) and from the names, classes and ids of the elements around it; these are the
capacities to the two terminals.  Blocks that follow each other, and blocks of one parent
element, are joined by edges whose capacity is the cost of parting them.  The minimum cut is
the cheapest labelling: weak evidence (a short line, one paragraph with a doubtful class)
gives way to the blocks around it, strong evidence stands.

The cut is found in two steps.  A block with at most two neighbours left is taken out and
replaced by an edge and terminal capacities that let the same flow through.  Elements nest,
so edges between blocks of one parent never cross, and these steps take out every block of a
page: the time is linear.  Whatever graph may be left (the function takes any) is solved by
augmenting paths, and the blocks taken out are labelled backwards.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# HTML's element names by their role, and words that sites use in class and id.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp")
UNSEEN = {"head", "template", "svg", "math", "select", "object", "canvas", "audio", "video", "button", "datalist", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp",
    "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr", "img", "br", "wbr", "input", "embed",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}
ELEMENTS = {"nav": -8.0, "footer": -8.0, "aside": -8.0, "menu": -8.0, "dialog": -8.0, "form": -6.0, "fieldset": -4.0, "header": -5.0, "address": -2.0, "article": 5.0, "main": 4.0}
LEAVES = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "td", "th", "pre", "figcaption")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_SCOPES = ("ul", "ol", "dl", "table", "tbody", "thead", "div", "article", "section", "nav")
BAD_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "disqus", "dropdown", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager",
    "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor",
    "sponsored", "subscribe", "subscription", "tags", "toolbar", "topbar", "tracking", "widget", "copyright", "disclaimer", "skip", "alert",
}
GOOD_WORDS = {"article", "articlebody", "body", "content", "entry", "main", "post", "story", "text", "prose"}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_ROUGH = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass
class Block:
    """``place``: score of the elements around, positive for content.  ``parent``: number of
    the enclosing element.  ``linked``: characters inside links."""

    text: str
    place: float
    parent: int
    linked: int
    heading: bool


@dataclass
class _Element:
    """An open element with what follows from it and all around it: ``place`` (scores from
    the inside out, each 0.35 of the one before), whether its text is unseen, lies in an
    article or in a heading, and the number of the element that holds its blocks."""

    name: str
    place: float
    unseen: bool
    inside: bool
    heading: bool
    holder: int


_PAGE = _Element("", 0.0, False, False, False, 0)


def _own_score(name: str, attrs: str, inside_article: bool) -> tuple[float | None, bool]:
    """What an element says about its text, or None; and whether it is hidden."""
    score = ELEMENTS.get(name)
    if name == "header" and inside_article:
        score = None
    hidden = False
    if attrs:
        bad = good = False
        for m in _NAMES.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                hidden = True
            elif key in ("class", "id", "role"):
                words = {w.lower() for w in _PART.findall(value)}
                bad |= bool(words & BAD_WORDS) and not (inside_article and words & {"header", "body"} and len(words & BAD_WORDS) == 1)
                good |= bool(words & GOOD_WORDS)
        if name not in ("html", "body", "article", "main"):
            if bad:  # on a single line of text it says less than on a box
                score = min(score or 0.0, -3.0 if name in LEAVES else -7.0)
            elif good and score is None:
                score = 3.0
    return score, hidden


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order.  Markup may be broken, cut short or nested without
    bounds."""
    out: list[Block] = []
    stack: list[_Element] = [_PAGE]
    open_: Counter[str] = Counter()
    text: list[str] = []
    linked = number = 0
    in_link = False
    pos, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            s = " ".join(html.unescape("".join(text)).split())
            e = stack[-1]
            if s and not e.unseen:
                out.append(Block(s, e.place, e.holder, min(linked, len(s)), e.heading))
            text.clear()
        linked = 0

    def add(s: str) -> None:
        nonlocal linked
        text.append(s)
        if in_link:
            linked += len(s.strip())

    def close(i: int) -> None:
        """The i-th open element and all inside it end."""
        for e in stack[i:]:
            open_[e.name] -= 1
        del stack[i:]

    while pos < end:
        lt = page.find("<", pos)
        if lt < 0:
            add(page[pos:])
            break
        if lt > pos:
            add(page[pos:lt])
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            if page.startswith("<!--", lt):
                at = page.find("-->", lt + 4)
                pos = end if at < 0 else at + 3
            else:
                at = page.find(">", lt)
                pos = end if at < 0 else at + 1
            continue
        m = _TAG.match(page, lt) or _ROUGH.match(page, lt)
        if not m:
            if nxt == "/" or nxt.isalpha():
                if page.find(">", lt) < 0:
                    break  # a tag cut off by the end of the page
                pos = page.find(">", lt) + 1
            else:
                add("<")
                pos = lt + 1
            continue
        pos = m.end()
        closing, name, attrs = m[1], m[2].lower(), m[3]
        if name in RAW and not closing:
            found = _RAW_END[name].search(page, pos)
            pos = found.end() if found else end
            continue
        if name in INLINE:
            if name == "a":
                in_link = not closing
            elif name == "br":
                add(" ")
            continue
        flush()
        if closing:
            if open_[name]:
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                close(i)
            in_link = False
            continue
        if name in VOID:
            continue
        if name in CLOSES_P and open_["p"]:
            i = len(stack) - 1
            while stack[i].name in _HEADINGS:
                i -= 1
            if stack[i].name == "p":
                close(i)
        ends = SIBLINGS.get(name)
        if ends and any(open_[n] for n in ends):
            i = len(stack) - 1
            while i and stack[i].name not in ends and stack[i].name not in _SCOPES:
                i -= 1
            if stack[i].name in ends:
                close(i)
        if name == "body" and stack[-1].name == "head":
            close(len(stack) - 1)
        number += 1
        up = stack[-1]
        score, hidden = _own_score(name, attrs, up.inside)
        stack.append(
            _Element(
                name, up.place if score is None else score + 0.35 * up.place, up.unseen or hidden or name in UNSEEN, up.inside or name in ("article", "main"),
                up.heading or name in ("h1", "h2"), up.holder if name in _HEADINGS or name in ("p", "li") else number,
            )
        )
        open_[name] += 1
    flush()
    return out


def costs(b: Block) -> tuple[float, float]:
    """(cost of calling it boilerplate, cost of calling it content)."""
    words = b.text.count(" ") + 1
    score = b.place + min(3.0, 0.15 * words)
    if b.text[-1:] in ".!?…:;\"”»)":
        score += 0.8
    if b.heading:
        score += 0.5
    density = b.linked / max(1, len(b.text))
    if density > 0.5:
        score -= 4.0 * density
    if words < 4 and b.place <= 0:
        score -= 0.8
    if "©" in b.text[:3]:
        score -= 3.0
    return max(score, 0.0), max(-score, 0.0)


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of a cheapest cut: True on the source side.  source[i] and sink[i] are the
    capacities to the terminals, edges undirected; ties go to the sink.

    Series and leaf reductions first: with v on the source side at cost b and on the sink side
    at cost a, and edges p to i and q to j, the least cost over v's label is a function of the
    labels of i and j, which terminal capacities and one edge between them express exactly.
    A step touches at most two neighbours."""
    n = len(source)
    gain = [a - b for a, b in zip(source, sink)]  # what calling it content saves
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        if i != j and c > 0:
            near[i][j] = near[i].get(j, 0.0) + c
            near[j][i] = near[j].get(i, 0.0) + c
    queue = deque(i for i in range(n) if len(near[i]) <= 2)
    done, taken = [False] * n, []
    while queue:
        v = queue.popleft()
        if done[v] or len(near[v]) > 2:
            continue
        done[v] = True
        at = list(near[v].items())
        taken.append((v, gain[v], at))
        a, b = max(gain[v], 0.0), max(-gain[v], 0.0)
        p, q = (at + [(0, 0.0), (0, 0.0)])[0][1], (at + [(0, 0.0), (0, 0.0)])[1][1]
        f11, f00, f10, f01 = min(b, a + p + q), min(b + p + q, a), min(b + q, a + p), min(b + p, a + q)
        w = max(0.0, (f10 + f01 - f00 - f11) / 2) if len(at) == 2 else 0.0
        for (i, _), one in zip(at, (f10, f01)):
            gain[i] -= (f11 if len(at) == 1 else one - w) - f00
            del near[i][v]
        if w > 0:
            i, j = at[0][0], at[1][0]
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
        queue.extend(i for i, _ in at if len(near[i]) <= 2)
    label = [False] * n
    rest = [i for i in range(n) if not done[i]]
    if rest:
        for i in _augmented(rest, gain, near):
            label[i] = True
    for v, g, at in reversed(taken):
        label[v] = g + sum(c if label[i] else -c for i, c in at) > 1e-9
    return label


def _augmented(nodes: list[int], gain: list[float], near: list[dict[int, float]]) -> set[int]:
    """The source side of the minimum cut of what no reduction takes out: shortest augmenting
    paths from nodes with capacity left at the source to those with capacity left at the sink."""
    left = {i: max(gain[i], 0.0) for i in nodes}
    right = {i: max(-gain[i], 0.0) for i in nodes}
    while True:
        came = {i: -1 for i in nodes if left[i] > 1e-9}
        queue, goal = deque(came), -1
        while queue:
            i = queue.popleft()
            if right[i] > 1e-9:
                goal = i
                break
            for j, c in near[i].items():
                if c > 1e-9 and j not in came:
                    came[j] = i
                    queue.append(j)
        if goal < 0:
            return set(came)
        path = [goal]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        flow = min(right[goal], left[path[-1]], *(near[b][a] for a, b in zip(path, path[1:])))
        right[goal] -= flow
        left[path[-1]] -= flow
        for a, b in zip(path, path[1:]):
            near[b][a] -= flow
            near[a][b] += flow


@dataclass(frozen=True)
class HtmlText:
    """Costs of parting two blocks that follow each other, more if they have one parent; and
    two blocks of one parent with others between them."""

    adjacent: float = 0.3
    same_parent: float = 0.7
    around: float = 0.4


def main_blocks(page: str | None, p: HtmlText = HtmlText()) -> list[str]:
    found = blocks(page) if page else []
    if not found:
        return []
    both = [costs(b) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, p.adjacent + (p.same_parent if found[i - 1].parent == b.parent else 0.0)))
        if b.parent in last and last[b.parent] < i - 1:
            edges.append((last[b.parent], i, p.around))
        last[b.parent] = i
    keep = minimum_cut([a for a, _ in both], [b for _, b in both], edges)
    return [b.text for b, k in zip(found, keep) if k]


def main_text(page: str | None, p: HtmlText = HtmlText()) -> str:
    return "\n".join(main_blocks(page, p))


def extract(pages: DataFrame, p: HtmlText = HtmlText()) -> DataFrame:
    """page_id, url, text, n_chars for every row of (page_id, url, html), repeated rows
    included.  Null or empty html: empty text, 0.  Whole pages are read."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([main_text(h, p) for h in series], dtype=object)

    out = pages.select("page_id", "url", run(F.col("html").cast("string")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
