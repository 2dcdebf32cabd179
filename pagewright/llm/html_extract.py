"""HTML extraction by tree scoring.

A page becomes a tree of elements. Each paragraph (the text of a block) passes points for its
length and commas to its ancestors, halved at each step up to the third; an element's score is
discounted by its link density. The best container and those of its siblings that score well or
read as prose are kept; within them, parts that are no article text (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) are left out, by tag, role,
class and id. White space inside a block becomes one space; blocks are joined by one space.

Defined cases: null, empty and text-less pages give the empty text; a page without any block uses
its whole body; unclosed and mis-nested tags are closed as browsers do for paragraphs, list items
and table cells; a page cut off in a tag loses that tag only; a quote opens a value only after an
equals sign and if it is closed somewhere, else it is a character of the tag; repeated rows each get
theirs. Time and memory are linear in the page's length, however deep its tags are nested.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import small_batches

#: Names of the HTML standard, and words that name a part's use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("nav header footer aside form button select option dialog menu head audio video canvas object embed fieldset".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
OFF = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|nav\w*|menus?|breadcrumbs?|sidebars?|side|aside|footers?|foot|headers?|masthead|topbar|toolbar|"
    r"comments?|comment\w*|disqus|replies|reply|respond|cookies?|consent|gdpr|notices?|popups?|modal|overlay|newsletter|subscri\w*|signup|login|social|"
    r"shares?|sharing|related|recommend\w*|widgets?|pagination|pager|skip|legal|copyright|disclaimer|search|tags?|teasers?|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
ON = re.compile(r"article|main|content|body|post|story|entry|text", re.I)
PARAGRAPHS = frozenset("p pre blockquote td th li dd dt h1 h2 h3 h4 h5 h6 figcaption div section article main".split())
#: Possessive repeats: nothing is tried twice.
MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: The end of a sentence.
SENTENCE = re.compile(r"[.!?。](?=\s|$)")
SCOPES = frozenset("ul ol dl table tbody thead tfoot article section main div body html".split())


class Element:
    """``stop``: the innermost scope or paragraph from here up; ``open``: the outermost element of each
    tag in CLOSES from here up to the innermost scope; ``inner``: the innermost inline element of each
    tag from here up to the innermost block."""

    __slots__ = ("tag", "marks", "parent", "children", "off", "depth", "stop", "open", "inner")

    def __init__(self, tag: str, marks: dict, parent):
        self.tag, self.marks, self.parent, self.children = tag, marks, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.stop = self if parent is None or tag == "p" or tag in SCOPES else parent.stop
        self.open = {} if parent is None or tag in SCOPES else parent.open
        if tag in CLOSES and tag not in self.open:
            self.open = {**self.open, tag: self}
        self.inner = {**parent.inner, tag: self} if parent and tag in INLINE else {}
        role = marks.get("role", "").lower()
        names = f"{marks.get('class', '')} {marks.get('id', '')}"
        self.off = (
            tag in SKIPPED
            or role in SKIPPED_ROLES
            or "hidden" in marks
            or marks.get("aria-hidden", "").lower() == "true"
            or "display:none" in marks.get("style", "").replace(" ", "").lower()
            or (tag not in ("html", "body", "article", "main") and bool(OFF.search(names)))
        )


def parse(page: str) -> Element:
    """The page's tree; text nodes are str children, with character references decoded."""
    root = at = Element("html", {}, None)
    place, n = 0, len(page)
    on_path = Counter(["html"])
    ends: dict[str, re.Pattern] = {}

    def text(a: int, z: int) -> None:
        if z > a:
            at.children.append(html.unescape(page[a:z]))

    def leave(to: Element) -> None:
        """Makes ``to``, which is above, the element that is open; each element is left once."""
        nonlocal at
        while at is not to:
            on_path[at.tag] -= 1
            at = at.parent

    while place < n:
        m = MARKUP.search(page, place)
        if not m:
            last = page.rfind("<", place)  # a page cut off in a tag
            text(place, last if last >= 0 and re.match(r"</?[a-zA-Z!]", page[last : last + 3]) else n)
            break
        text(place, m.start())
        place = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:  # it closes no block
                up = at.inner.get(tag)
            else:
                up = at if on_path[tag] else None
                while up is not None and up.tag != tag:
                    up = up.parent
            if up is not None and up.parent is not None:
                leave(up.parent)
            continue
        if tag in RAW:
            if tag not in ends:
                ends[tag] = re.compile(rf"</{re.escape(tag)}\s*+>", re.I)
            end = ends[tag].search(page, place)
            place = end.end() if end else n
            continue
        if tag in ("html", "body") and at.parent is None:
            continue
        if tag in VOID:
            at.children.append(Element(tag, {}, at))
            continue
        if tag not in INLINE and at.stop.tag == "p":
            leave(at.stop.parent)
        if tag in CLOSES and (found := [at.open[t] for t in CLOSES[tag] if t in at.open]):
            leave(min(found, key=lambda e: e.depth).parent)
        marks = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in ATTRIBUTE.findall(m[3])} if m[3].strip(" /") else {}
        new = Element(tag, marks, at)
        at.children.append(new)
        if not m[0].endswith("/>") or tag in INLINE or tag in PARAGRAPHS:
            at = new
            on_path[tag] += 1
    return root


def blocks(nodes: list) -> list[str]:
    """The kept texts of elements and text nodes and of all below, block by block, white space as one
    space."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if said := " ".join("".join(run).split()):
            out.append(said)
        run.clear()

    stack = [iter(nodes)]
    ends = [False]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if ends.pop():
                flush()
        elif isinstance(child, str):
            run.append(child)
        elif not child.off:
            block = child.tag not in INLINE
            if block:
                flush()
            stack.append(iter(child.children))
            ends.append(block)
    flush()
    return out


def _walk(root: Element):
    """Elements that are not left out, each before its children."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.off)


def _own_text(nodes: list) -> tuple[int, int, int]:
    """Characters, commas and characters inside links of a block's own text (not of inner blocks)."""
    chars = commas = linked = 0
    stack = [(c, False) for c in nodes]
    while stack:
        c, link = stack.pop()
        if isinstance(c, str):
            size = len(c) - c.count(" ") // 2 if c.strip() else 0
            chars, commas, linked = chars + size, commas + c.count(","), linked + size * link
        elif c.tag in INLINE and not c.off:
            link = link or c.tag == "a"
            stack.extend((x, link) for x in c.children)
    return chars, commas, linked


def score(root: Element) -> tuple[dict[int, float], dict[int, float]]:
    """Points and link density of each element, by id()."""
    points: dict[int, float] = {}
    totals: dict[int, list[int]] = {}
    nodes = list(_walk(root))
    for node in nodes:
        if node.tag in INLINE:
            continue
        chars, commas, linked = _own_text(node.children)
        if not chars:
            continue
        gain = 1 + commas + min(chars / 100, 3) if node.tag in PARAGRAPHS and chars >= 25 else 0
        up, share = node if node.tag not in ("p", "pre", "td", "li") else node.parent, 1.0
        for _ in range(3):
            if up is None:
                break
            points[id(up)] = points.get(id(up), 0) + gain * share
            up, share = up.parent, share / 2
        totals[id(node)] = [chars, linked]
    for node in reversed(nodes):  # children before their parents
        if node.parent is not None and (own := totals.get(id(node))):
            above = totals.setdefault(id(node.parent), [0, 0])
            above[0] += own[0]
            above[1] += own[1]
    density = {k: linked / max(chars, 1) for k, (chars, linked) in totals.items()}
    for node in nodes:
        if id(node) in points:
            named = f"{node.marks.get('class', '')} {node.marks.get('id', '')}"
            points[id(node)] += 25 * (node.tag in ("article", "main")) + 10 * bool(ON.search(named))
    return {k: v * (1 - density.get(k, 0)) for k, v in points.items()}, density


def _prose(said: list[str], density: float) -> bool:
    """Long and with few links, or a sentence without any."""
    return density < 0.25 and sum(map(len, said)) > 80 or density == 0 and any(SENTENCE.search(s) for s in said)


def main_text(page: str | None) -> str:
    """The article's text."""
    if not page or not page.strip():
        return ""
    root = parse(page)
    points, density = score(root)
    nodes = [n for n in _walk(root) if id(n) in points and n.tag not in INLINE]
    if not nodes:
        return " ".join(blocks([root]))
    best = max(nodes, key=lambda n: points[id(n)])
    if best.parent is None:
        return " ".join(blocks([best]))
    limit = max(10.0, 0.2 * points[id(best)])
    named = best.parent.tag in ("article", "main")
    kept: list[str] = []
    loose: list = []  # text and inline elements between the siblings

    def settle() -> None:
        said = blocks(loose)
        chars, _, linked = _own_text(loose)
        if said and (named or _prose(said, linked / max(chars, 1))):
            kept.extend(said)
        loose.clear()

    for c in best.parent.children:
        if isinstance(c, str) or (c.tag in INLINE and id(c) not in points):
            loose.append(c)
            continue
        settle()
        if c.off:
            continue
        if c is best or points.get(id(c), 0) >= limit:
            kept += blocks([c])
        elif c.tag == "p" or named:
            said = blocks([c])
            if named or _prose(said, density.get(id(c), 0)):
                kept += said
    settle()
    return " ".join(kept)


def _extract(batches):
    for b in batches:
        texts = [main_text(p) for p in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def html_extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars (code points)."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
