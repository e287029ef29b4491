"""Main text of web pages by tree scoring.

A page is parsed into a tree.  What is never article text (scripts, styles, forms, navigation, page headers
and footers, asides, hidden elements and roles of the kind) is cut off; a form or field set that holds the article (an article or main element, or the text around it but for next to
nothing) loses its controls only, and the header of an article is its own.  Each paragraph then gives points, for its length and
its commas, to its ancestors: all to the parent, half to the grandparent, less further up.  A node's points are discounted by
its link density.  The best node is the container of the article, up to the article or main element that holds it; siblings
that look like parts of the article, other article elements first, are kept with it.

Names of classes and ids only help: an element named like an advert, a notice, a menu or reader comments is no part of the article, but
never an ``article`` or ``main`` element, nor one that holds one, nor one with another name that speaks for an article,
nor one that holds most of the page's text where no article or main element and next to nothing is left without it.

Everything is one pass over the page and a few over its nodes, without recursion or backtracking: deep nesting, unclosed tags and
very long pages take time and memory in proportion to their length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import own_columns, table

NAME = re.compile(r"[^\s/>]*")
GAP = re.compile(r"[\s/]*")
KEY = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt td th tr tbody thead tfoot".split()
)
#: A start tag ends an open element of these kinds, up to the bounding kinds.
SIBLINGS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["tbody", "thead", "tfoot", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
P_BOUND = frozenset("button caption html table td th article body div section main blockquote li dd".split())

NEVER = frozenset(
    "script style noscript template iframe object embed nav footer aside menu select button input textarea svg canvas dialog head title noembed noframes audio video map".split()
)
#: What is cut unless the article stands in it; then only their labels are.
FRAMES = frozenset(["form", "fieldset"])
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form status note tooltip".split())
#: Words of a class or id that name something other than the article.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar aside comment comments commentlist disqus reply replies discussion menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead toolbar share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget form search tags tagcloud skip hidden copyright disclaimer outbrain taboola".split()
)
#: Words of a class that tell a state or a subject of an element, not what it is.
STATES = frozenset("has with without no not is in on off open opened closed enabled disabled active category tagged tag type format status author".split())
READERS = frozenset("comment comments commentlist disqus reply replies discussion".split())
LIKELY = frozenset("article body content entry main page post story text blog hentry".split())
LIKELY_POINTS = 25
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
MIN_CHARS = 25
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
P = frozenset(["p"])
LEVELS = 5


def _words(value: str) -> list[str]:
    return [w.lower() for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", value) if w]


class Tree:
    """Nodes in page order; node 0 is the root.  ``inside`` holds node numbers and strings of text, ``attrs`` the attributes."""

    def __init__(self, page: str):
        self.tag, self.parent = ["#root"], [-1]
        self.attrs: list[dict[str, str]] = [{}]
        self.inside: list[list[int | str]] = [[]]
        self._open = [0]
        self._depths: dict[str, list[int]] = {}
        self._page = page
        self._no_more: set[str] = set()
        self._read(page)

    def _push(self, tag: str, attrs: dict[str, str]) -> int:
        at = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self._open[-1])
        self.attrs.append(attrs)
        self.inside.append([])
        self.inside[self._open[-1]].append(at)
        return at

    def inside_of(self, node: int, tag: str) -> bool:
        """Whether an element of this kind is above a node."""
        up = self.parent[node]
        while up > 0 and self.tag[up] != tag:
            up = self.parent[up]
        return up > 0

    def _pop_to(self, depth: int) -> None:
        for n in self._open[depth:]:
            self._depths[self.tag[n]].pop()
        del self._open[depth:]

    def _innermost(self, kinds: frozenset[str]) -> int:
        return max((d[-1] for k in kinds if (d := self._depths.get(k))), default=0)

    def _close(self, kinds: frozenset[str], bound: frozenset[str]) -> None:
        """End the innermost open element of these kinds unless a bounding element is further in."""
        depth = self._innermost(kinds)
        if depth and depth > self._innermost(bound - kinds):
            self._pop_to(depth)

    def _find(self, what: str, at: int) -> int:
        """As ``find``, but what isn't in the rest of the page is looked for once only."""
        if what in self._no_more:
            return -1
        found = self._page.find(what, at)
        if found < 0:
            self._no_more.add(what)
        return found

    def _attributes(self, at: int) -> tuple[int, dict[str, str], bool]:
        """From a place behind a tag's name: the place behind its ">" (-1 if the page ends before), the attributes, whether it
        closes itself.  A quote that nothing ends is an ordinary character."""
        page, out, slash = self._page, {}, False
        while True:
            gap = GAP.match(page, at)
            slash, at = gap[0].endswith("/"), gap.end()
            if at >= len(page):
                return -1, out, False
            if page[at] == ">":
                return at + 1, out, slash
            key = KEY.match(page, at)
            at, value = key.end(), ""
            equals = EQUALS.match(page, at)
            if equals:
                at = equals.end()
                mark = page[at : at + 1]
                end = self._find(mark, at + 1) if mark in ("'", '"') else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = BARE.match(page, at)
                    value, at = bare[0], bare.end()
            out.setdefault(key[0].lower(), value)

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            lt = page.find("<", at)
            if lt != at:
                self._text(page[at : lt if lt >= 0 else n])
            if lt < 0:
                return
            mark = page[lt + 1 : lt + 2]
            if mark in ("!", "?"):
                close = "]]>" if page.startswith("<![CDATA[", lt) else "-->" if page.startswith("<!--", lt) else ">"
                start = lt + 2 if close == "-->" else lt + 1  # "<!-->" is a whole comment
                end = page.find(close, start)
                if end < 0:
                    return
                at = end + len(close)
                continue
            ends = mark == "/"
            first = page[lt + 1 + ends : lt + 2 + ends]
            if not (first.isascii() and first.isalpha()):
                if ends and self._find(">", lt) >= 0:  # "</>" and the like are no text
                    at = page.find(">", lt) + 1
                else:
                    self._text("<")
                    at = lt + 1
                continue
            name = NAME.match(page, lt + 1 + ends)
            at, attrs, slash = self._attributes(name.end())
            if at < 0:  # the page ends inside a tag
                return
            self._tag(name[0].lower(), attrs, ends, slash)
            if not ends and name[0].lower() in RAW:
                end = re.compile(rf"</{re.escape(name[0])}[\s/>]", re.I).search(page, at)
                if end is None:
                    return
                at = page.find(">", end.start()) + 1 or n

    def _tag(self, tag: str, attrs: dict[str, str], ends: bool, slash: bool) -> None:
        if ends:
            if self._depths.get(tag):
                self._pop_to(self._depths[tag][-1])
            return
        if tag in CLOSES_P:
            self._close(P, P_BOUND)
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        node = self._push(tag, attrs)
        if tag not in RAW and tag not in VOID and not (slash and tag not in INLINE and tag not in CLOSES_P):
            self._depths.setdefault(tag, []).append(len(self._open))
            self._open.append(node)

    def _text(self, text: str) -> None:
        self.inside[self._open[-1]].append(html.unescape(text) if "&" in text else text)


def _said(attrs: dict[str, str]) -> tuple[bool, bool, bool]:
    """Whether a class or id speaks against an article, speaks for one by itself, names reader comments."""
    against = speaks = readers = False
    for token in html.unescape(f"{attrs.get('class', '')} {attrs.get('id', '')}").split():
        words = _words(token)
        if any(w in STATES for w in words):
            continue
        if any(w in UNLIKELY for w in words):
            against = True
            readers |= any(w in READERS for w in words)
        elif any(w in LIKELY for w in words):
            speaks = True
    return against, speaks, readers


def _frames(t: Tree, bad: list[bool]) -> None:
    """Mark forms and field sets that don't hold the article, and the labels in all of them."""
    n = len(t.tag)
    if not any(tag in FRAMES for tag in t.tag):
        return
    gone, within, framed = bad[:], [0] * n, [False] * n  # within: the innermost article or main element, else the page
    said, holds = [0] * n, [False] * n
    for i in range(1, n):
        p = t.parent[i]
        gone[i] |= gone[p]
        within[i] = i if t.tag[i] in ("article", "main") else within[p]
        framed[i] = framed[p] or t.tag[i] in FRAMES
    for i in range(n - 1, 0, -1):
        if gone[i]:
            continue
        own = sum(len(x.strip()) for x in t.inside[i] if isinstance(x, str))
        said[i] += own
        holds[i] |= t.tag[i] in ("article", "main") and said[i] > 0
        said[t.parent[i]] += said[i]
        holds[t.parent[i]] |= holds[i]
    outside = any(t.tag[i] in ("article", "main") and said[i] > 0 and not framed[i] for i in range(1, n))
    for i in range(1, n):
        if t.tag[i] in FRAMES and not holds[i] and (said[within[i]] - said[i] > said[i] / 10 or not within[i] and outside):
            bad[i] = True
        elif t.tag[i] == "label" and framed[i]:
            bad[i] = True


def _cut_off(t: Tree) -> tuple[list[bool], list[bool]]:
    """For each node: whether it isn't article text by itself; whether its class or id speaks for an article."""
    n = len(t.tag)
    bad, good, names, readers = [False] * n, [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        tag, a = t.tag[i], t.attrs[i]
        if tag in NEVER:
            bad[i] = True
        elif a:
            against, good[i], readers[i] = _said(a)
            style = a.get("style", "")
            bad[i] = "hidden" in a or a.get("aria-hidden") == "true" or bool(style) and HIDDEN.search(style) is not None or a.get("role", "").strip().lower() in NEVER_ROLES
            names[i] = against and tag not in ("html", "body", "main", "article")
            if tag == "article" and readers[i] and not good[i]:  # a comment marked up as an article
                names[i] = True
        if tag == "header":
            names[i], good[i] = not t.inside_of(i, "article"), False
    _frames(t, bad)
    gone, size, holds = bad[:], [0] * n, [False] * n
    for i in range(1, n):
        gone[i] |= gone[t.parent[i]]
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            size[i] += sum(len(x.strip()) for x in t.inside[i] if isinstance(x, str))
            size[t.parent[i]] += size[i]
            if t.tag[i] in ("article", "main") and not names[i]:
                holds[i] = True
            holds[t.parent[i]] |= holds[i]
    cut = [False] * n
    most = size[0] / 2
    for i in range(1, n):
        cut[i] = names[i] and not holds[i] and (size[i] <= most or readers[i] and not good[i])
    # of what holds most of the page, the names count only if enough is left without it
    left, under, stands = 0, cut[:], False
    big = [names[i] and not holds[i] and not cut[i] for i in range(n)]
    for i in range(1, n):
        under[i] |= under[t.parent[i]] or gone[i] or big[i]
        if not under[i]:
            stands |= t.tag[i] in ("article", "main") and size[i] > 0
            left += sum(len(x.strip()) for x in t.inside[i] if isinstance(x, str))
    for i in range(1, n):
        if big[i] and (stands or not good[i] and left >= max(MIN_CHARS, size[i] / 10)):
            cut[i] = True
    return [b or c for b, c in zip(bad, cut, strict=True)], good


def _blocks(t: Tree, roots: list[int], gone: list[bool]) -> list[str]:
    """The blocks of text below the roots, white space made single."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            s = " ".join("".join(held).split())
            held.clear()
            if s:
                out.append(s)

    for r in roots:
        flush()
        stack: list[tuple[int, int]] = [(r, 0)]
        while stack:
            node, k = stack.pop()
            inside = t.inside[node]
            while k < len(inside):
                x = inside[k]
                k += 1
                if isinstance(x, str):
                    held.append(x)
                    continue
                if gone[x]:
                    if t.tag[x] not in INLINE:
                        flush()
                    continue
                if t.tag[x] == "br":
                    held.append(" ")
                    continue
                if t.tag[x] not in INLINE:
                    flush()
                stack.append((node, k))
                stack.append((x, 0))
                break
            else:
                if t.tag[node] not in INLINE:
                    flush()
    flush()
    return out


def main_text(page: str | None) -> str:
    """The blocks of the page's article, one a line; empty for null, empty and article-less pages."""
    if not page:
        return ""
    t = Tree(page)
    n = len(t.tag)
    bad, good = _cut_off(t)
    gone = bad[:]
    link = [tag == "a" for tag in t.tag]
    for i in range(1, n):
        p = t.parent[i]
        gone[i] |= gone[p]
        link[i] |= link[p]
    chars, commas, linked, direct = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if gone[i]:
            continue
        for x in t.inside[i]:
            if isinstance(x, str):
                s = " ".join(x.split())
                direct[i] += len(s)
                commas[i] += sum(s.count(c) for c in ",،、，")
        chars[i] += direct[i]
        linked[i] += direct[i] if link[i] else 0
        p = t.parent[i]
        if p >= 0:
            chars[p] += chars[i]
            commas[p] += commas[i]
            linked[p] += linked[i]
    if not chars[0]:
        return ""
    points = [0.0] * n
    never = INLINE | {"h1", "h2", "h3", "h4", "h5", "h6", "body", "html"}
    for least in (MIN_CHARS, 1):
        for i in range(1, n):
            if gone[i]:
                continue
            paragraph = t.tag[i] in PARAGRAPHS
            size = chars[i] if paragraph else direct[i]
            if size < least or not paragraph and t.tag[i] in never:
                continue
            own = 1 + commas[i] + min(size / 100, 3)
            node, level = (t.parent[i], 0) if paragraph else (i, 0)
            while node > 0 and level < LEVELS:
                points[node] += own / (1 if level == 0 else 2 if level == 1 else level * 3)
                node, level = t.parent[node], level + 1
        if any(points):
            break
    for i in range(1, n):
        if points[i]:
            if good[i] or t.tag[i] in ("article", "main"):
                points[i] += LIKELY_POINTS
            points[i] *= 1 - linked[i] / chars[i] if chars[i] else 0
    best = max(range(n), key=lambda i: (points[i], -i))
    if not points[best]:
        body = next((i for i in range(n) if t.tag[i] == "body"), 0)
        return "\n".join(_blocks(t, [body], gone))
    for i in range(1, n):  # what lies outside of the page's main element doesn't win over it
        if t.tag[i] == "main" and points[i] and not gone[i]:
            best = i
            break
    up, holder = best, 0
    while up > 0:  # the outermost article; main, if there is none
        if t.tag[up] == "article" or t.tag[up] == "main" and t.tag[holder] != "article":
            holder = up
        up = t.parent[up]
    best = holder or best
    roots = [best]
    if t.tag[best] not in ("main", "body", "html") and best > 0:
        roots, least = [], 0.2 * points[best]
        for x in t.inside[t.parent[best]]:
            if isinstance(x, str) or gone[x]:
                continue
            density = linked[x] / chars[x] if chars[x] else 1.0
            if t.tag[best] == "article":
                part = t.tag[x] == "article" and density < 0.5
            else:
                part = points[x] >= least or t.tag[x] == "p" and (density < 0.25 and chars[x] > 80 or density == 0 and chars[x] > 0) or t.tag[x] in ("h1", "h2") and x < best
            if x == best or part:
                roots.append(x)
    return "\n".join(_blocks(t, roots, gone))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pages = b.column(2)
        texts = [main_text(pages[i].as_py()) for i in range(len(pages))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without article text, have an empty text.  Repeated rows and null ids and URLs stay as
    they are.  An empty table gives an empty result; other columns are not read.
    """
    out = own_columns(pages, page_id="long", url="string", html="string").mapInArrow(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
