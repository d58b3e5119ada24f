"""Main-text extraction from HTML by tree scoring.

A forgiving tokeniser builds the element tree. Every block of text passes
points (one, plus one a comma, plus its length) to the elements above it, in
full to its container, half to the next and less further up, discounted by the
block's share of linked text. The element with the most points, discounted by
its own link density, is the main container. Inside an article (or else a main)
element, what surrounds the container up to that element is kept too, unless most
of it is links; elsewhere siblings that score near it, that are running text, or
that are sections (a heading and text, few links). Elements that are no article
text by their tag, role or class (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments) never count, unless they enclose the
article; inside an article, a block named only like a widget (share, menu) counts
if it holds running text without links.

Edge cases: null, empty or textless html gives an empty text. Unclosed and
stray tags, comments and quotes are read as browsers do, to the end of the page
if need be. Each text node's references are decoded by themselves. Pages of any
length and depth are read in linear time. Repeated rows each get their text; ties
go to the element that opens first. An empty table gives an empty result. Other
columns, whatever their names, are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreemill.llm.common import col, small_batches

#: Element names by how they behave.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dd dt td th figcaption caption summary".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED = frozenset("head title nav footer aside form script style noscript iframe noembed noframes textarea select option optgroup button input svg math canvas audio video object applet template dialog menu datalist search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations sidebar aside nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead comment comments disqus reply replies respond toolbar".split()
)
#: Names of widgets, which hold no running text; other things may be called so.
WIDGETS = frozenset("share sharing social menu toolbar login signup pagination pager".split())
WIDGET_CHARS = 80
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A header with one of these belongs to the article.
OWN_HEADERS = frozenset("article post entry story content main title section".split())
#: Start tag -> open elements that it ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "thead": ("tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",), "thead": ("table",)}

_open = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
#: The rest of a tag: quotes count only after an equals sign.
_rest = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_attribute = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>]++)))?+""")
_name_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_closers = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_blank = re.compile(r"\s+")


class _Page:
    """Elements by number: tag, parent, whether they never count (hard) or count only
    where they hold the article (soft); and the blocks of text: (owner, text, linked)."""

    def __init__(self) -> None:
        self.tag, self.parent, self.hard, self.soft, self.widget = ["#root"], [-1], [False], [False], [False]
        self.stack = [0]
        self.holders = [0]
        self.opened: dict[str, list[int]] = {}
        self.blocks: list[tuple[int, str, int]] = []
        self.parts: list[str] = []
        self.linked = self.links = self.muted = 0

    def text(self, raw: str) -> None:
        """A text node; its references are decoded by themselves."""
        if raw and not self.muted:
            own = unescape(raw) if "&" in raw else raw
            self.parts.append(own)
            if self.links:
                self.linked += len(own)

    def flush(self) -> None:
        if self.parts:
            text = _blank.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append((self.holders[-1], text, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def start(self, tag: str, attributes: str, closed: bool) -> None:
        if tag in BLOCKS:
            if self.opened.get("p") and tag not in ("html", "head", "body", "option", "optgroup", "caption", "li", "dd", "dt", "legend"):
                self.end("p")
            for other in ENDS.get(tag, ()):
                at = self.opened.get(other)
                if at and all(at[-1] > where[-1] for s in SCOPES[tag] if (where := self.opened.get(s))):
                    self.end(other)
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        hard, soft, widget = tag in DROPPED, tag == "header", tag != "header"
        for name, a, b, c in _attribute.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "hidden" or (name == "style" and _hidden.search(value)) or (name == "role" and value.lower() in ROLES) or (name == "aria-hidden" and value.lower() == "true"):
                hard = True
            elif name in ("class", "id") and tag not in ("html", "body", "main"):
                parts = {p.lower() for p in _name_parts.findall(value)}
                other = bool(parts & NAMES - WIDGETS) or ("header" in parts and not parts & OWN_HEADERS)
                soft, widget = soft or other or bool(parts & WIDGETS), widget and not other
        if closed and tag not in BLOCKS:
            return
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.hard.append(hard)
        self.soft.append(soft)
        self.widget.append(soft and widget)
        self.opened.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)
        if tag in BLOCKS:
            self.holders.append(node)
        self.links += tag == "a"
        self.muted += self._mutes(node)

    def _mutes(self, node: int) -> bool:
        """Inline elements to leave out, without ending the block around them."""
        return self.tag[node] not in BLOCKS and (self.hard[node] or self.soft[node])

    def pop(self) -> str:
        node = self.stack[-1]
        tag = self.tag[node]
        if tag in BLOCKS:
            self.flush()
            self.holders.pop()
        self.stack.pop()
        self.opened[tag].pop()
        self.links -= tag == "a"
        self.muted -= self._mutes(node)
        return tag

    def end(self, tag: str) -> None:
        """Close the innermost such element; an inline one only within its block."""
        if tag == "br":
            self.parts.append(" ")
        if not self.opened.get(tag) or tag in ("html", "body"):
            return
        if tag not in BLOCKS and self.stack[self.opened[tag][-1]] < self.holders[-1]:
            return
        while self.pop() != tag:
            pass


def parse(html: str) -> _Page:
    page, at, n = _Page(), 0, len(html)
    while at < n:
        m = _open.search(html, at)
        if not m:
            page.text(html[at:])
            break
        page.text(html[at : m.start()])
        if m[0] == "<!--":
            k = html.find("-->", m.start() + 2)
            at = n if k < 0 else k + 3
            continue
        if not m[2]:
            at = html.find(">", m.end()) + 1 or n
            continue
        rest = _rest.match(html, m.end())
        if not rest:
            break
        at = rest.end()
        tag, attributes = m[2].lower(), html[m.end() : at - 1]
        if m[1]:
            page.end(tag)
            continue
        page.start(tag, attributes.rstrip("/"), attributes.endswith("/"))
        if tag in RAW and page.tag[page.stack[-1]] == tag:
            close = _closers[tag].search(html, at)
            page.text(html[at : close.start()] if close else html[at:])
            at = close.start() if close else n
    while len(page.stack) > 1:
        page.pop()
    page.flush()
    return page


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = parse(html)
    n = len(page.tag)
    holds = [t in ("article", "main", "h1") and not s for t, s in zip(page.tag, page.soft, strict=True)]
    share, tied = [0] * n, [0] * n
    for owner, text, links in page.blocks:
        share[owner] += len(text)
        tied[owner] += links
    for i in range(n - 1, 0, -1):
        share[page.parent[i]] += 0 if page.hard[i] else share[i]
        tied[page.parent[i]] += tied[i]
        if holds[i]:
            holds[page.parent[i]] = True
    holds = [h and 2 * x > share[0] for h, x in zip(holds, share, strict=True)]
    dropped = [False] * n
    inside = [t in ("article", "main") for t in page.tag]
    articles = page.tag.count("article")
    nested = [False] * n  # inside an article
    for i in range(1, n):
        up = page.parent[i]
        nested[i] = nested[up] or page.tag[up] == "article"
        own = page.tag[i] == "article" and articles == 1 and not nested[i]
        soft = page.soft[i] and not own and not (page.tag[i] == "header" and inside[up]) and not (page.tag[i] != "header" and holds[i])
        soft = soft and not (page.widget[i] and inside[up] and share[i] >= WIDGET_CHARS and not tied[i])
        dropped[i] = dropped[up] or page.hard[i] or soft
        inside[i] = inside[i] or inside[up]
    blocks = [b for b in page.blocks if not dropped[b[0]]]
    if not blocks:
        return ""
    points, size, linked = [0.0] * n, [0] * n, [0] * n
    heads, texts = [False] * n, [False] * n
    for owner, text, links in blocks:
        size[owner] += len(text)
        heads[owner] = heads[owner] or page.tag[owner] in HEADINGS
        texts[owner] = texts[owner] or (page.tag[owner] == "p" and links < 0.25 * len(text))
        linked[owner] += links
        worth = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))
        node = page.parent[owner] if page.tag[owner] in LEAVES else owner
        for share in (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12):
            if node < 0:
                break
            points[node] += worth * share
            node = page.parent[node]
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
        linked[page.parent[i]] += linked[i]
        heads[page.parent[i]] |= heads[i]
        texts[page.parent[i]] |= texts[i]
    density = [linked[i] / size[i] if size[i] else 0.0 for i in range(n)]
    final = [points[i] * (1 - density[i]) for i in range(n)]
    best = max(range(n), key=lambda i: (final[i], -i))
    kept = [False] * n
    path, top = {best}, best
    node, wide = best, -1
    while node > 0:  # the article that holds the best container, or else its main element
        if page.tag[node] == "article" or (page.tag[node] == "main" and wide < 0):
            wide = node
        node = page.parent[node]
    while wide >= 0 and top != wide:
        top = page.parent[top]
        path.add(top)
    kept[best] = True
    for i in range(1, n):
        up = page.parent[i]
        if i not in path and not dropped[i]:
            if up in path and up != best and wide >= 0:
                kept[i] = density[i] < 0.5
            elif up == page.parent[best]:
                running = page.tag[i] in LEAVES and page.tag[i] != "li" and density[i] < 0.25
                section = heads[i] and texts[i] and density[i] < 0.1
                kept[i] = running or section or final[i] > 0.2 * final[best]
    for i in range(1, n):
        kept[i] = kept[i] or (kept[page.parent[i]] and i not in path)
    beside = {page.parent[best]} | (path if wide >= 0 else set())
    return "\n\n".join(text for owner, text, links in blocks if kept[owner] or (owner in beside and links < 0.25 * len(text)))


def extract(html: Column) -> Column:
    """The main text of an html column."""
    small_batches()

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(h.as_py()) for h in batch], pa.string())

    return text(html)


def page_texts(pages: DataFrame) -> DataFrame:
    """The op5 query."""
    found = pages.select("page_id", "url", extract(col("html")).alias("text"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
