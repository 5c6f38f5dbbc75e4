"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each with its root-to-leaf path of block tags. Text length,
punctuation and link text are added up per path; their ratios per block are smoothed
over neighbours in page order and fused into one value per path, and paths above a
share of the largest value are content. The elements that hold the content blocks
(articles or main elements, else in each child of the body the lowest common ancestor
of its content blocks, and headings right before) give the text: all blocks in them but
those of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, and those on paths below the threshold that hold hardly anything but links.
Elements are told by name and role, or by class and id unless they hold most of the page. How long the content is plays no part in what holds it.

Character references are decoded, white space in a block becomes one space, blocks are
joined by two line ends. Null and empty pages, and pages without text, give an empty
text; cut-off pages are read to their end. Extra columns are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import small_batches

# Element names by their role in a page.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
DROPPED = set("aside button dialog footer form head menu nav noscript object select svg template audio video canvas".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HOLDERS = {"article", "main"}
WHOLE = {"", "html", "body"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
# An element that may stand open when the named one begins is closed by it.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_UP_TO = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
HINT = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|discussion|menu|modal|nav|navbar|navigation|newsletter"
    r"|notice|pager|pagination|popup|promo\w*|recommend\w*|related|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[-_\s])",
    re.I,
)
OUTER_HINT = re.compile(r"(?:^|[-_\s])(?:header|footer|masthead|login|search)(?:$|[-_\s])", re.I)

#: A quote opens a value only after an equals sign.
TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+(?:\"|$)|=\s*+'[^']*+(?:'|$)|=)*+)(>|$)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")

#: An element that its class or id names as something beside the article stays if it holds this share of the page's unlinked text.
MOST = 0.5
#: A path of at least so many blocks inside an article is a list of links if this share of its text is.
LINKS, LINKED = 3, 0.9
#: A path is content if its fused value reaches this share of the largest one.
THRESHOLD = 0.25


@dataclass(eq=False)
class Element:
    """``hint``: its class or id names something beside the article; ``holder``: it is, or stands in, an article or main element."""

    tag: str
    parent: Element | None
    bad: bool
    holder: bool
    hint: bool = False
    path: tuple[str, ...] = ()
    depth: int = 0


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _is_bad(tag: str, attributes: str, within: bool) -> tuple[bool, bool]:
    """Does an element begin something beside the article, by its name or role, and by its class or id? ``within``: it stands in an article."""
    if tag in DROPPED or (tag == "header" and not within):
        return True, False
    hint = False
    for name, value in ATTRIBUTE.findall(attributes) if attributes and "=" in attributes else ():
        value = value.strip("\"'")
        if name.lower() == "role":
            if value.lower() in ROLES:
                return True, False
        elif HINT.search(value) or (not within and OUTER_HINT.search(value)):
            hint = tag not in ("body", "html", "main") and (tag not in HOLDERS or within)
    return False, hint


def _unhinted(blocks: list[Block]) -> list[Block]:
    """Blocks outside elements whose class or id names something beside the article.

    Themes mark wrappers of the whole page with such words too. So an element stays that
    holds most of the unlinked text, or the only articles of the page.
    """
    held: dict[int, int] = {}
    hinted: dict[int, Element] = {}
    within: list[list[int]] = []
    articles: list[set[int]] = []
    total = 0
    for b in blocks:
        free, chain, e, article = max(len(b.text) - b.linked, 0), [], b.element, False
        total += free
        while e is not None:
            if e.hint:
                chain.append(id(e))
                hinted[id(e)] = e
                held[id(e)] = held.get(id(e), 0) + free
            article = article or e.tag in HOLDERS
            e = e.parent
        within.append(chain)
        if article and free:
            articles.append({k for k in chain if not hinted[k].holder})
    if not hinted:
        return blocks
    around = set.intersection(*articles) if articles else set()
    bad = {k for k in hinted if k not in around and held[k] < MOST * total}
    return [b for b, chain in zip(blocks, within, strict=True) if not bad.intersection(chain)]


def blocks_of(page: str) -> list[Block]:
    """Blocks with text outside the parts that are never read, in page order."""
    root = Element("", None, False, False)
    now, block, out, links = root, None, [], 0
    at = 0

    def text(raw: str) -> None:
        nonlocal block
        if not raw or now.bad:
            return
        if block is None or block.element is not anchor(now):
            if raw.isspace() and block is None:
                return
            block = Block(anchor(now))
            out.append(block)
        block.parts.append(raw)
        if links:
            block.linked += len(raw.strip())

    def anchor(e: Element) -> Element:
        while e.parent is not None and e.tag not in BLOCKS:
            e = e.parent
        return e

    def close(tags: set[str], stop: set[str]) -> None:
        """Leave the innermost open element of ``tags`` unless one of ``stop`` is nearer."""
        nonlocal now, block, links
        e = now
        while e.parent is not None and e.tag not in tags:
            if e.tag in stop:
                return
            e = e.parent
        if e.parent is None:
            return
        while True:
            links -= now.tag == "a"
            left, now = now, now.parent
            if left.tag in BLOCKS:
                block = None
            if left is e:
                return

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            rest = page[at:]
            cut = rest.rfind("<")
            text(rest if cut < 0 or not re.match(r"</?[a-zA-Z!?]|</?$", rest[cut:]) else rest[:cut])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None or not m[4]:
            continue  # a comment, a declaration, or a tag that the end cuts off
        tag = m[2].lower()
        if m[1]:
            if tag not in VOID:
                close({tag}, {"td", "th", "table"} if tag not in BLOCKS else set())
            continue
        if tag in CLOSES:
            close(CLOSES[tag], CLOSES_UP_TO[tag])
        elif tag in BLOCKS:
            close({"p"}, {"td", "th", "table", "article", "section", "div", "blockquote", "li"})
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag == "hr":
                block = None
            else:
                text(" " if tag in ("br", "wbr") else "")
            continue
        inside = now.holder
        bad, hint = _is_bad(tag, m[3], inside)
        path = (*now.path, tag) if tag in BLOCKS else now.path
        now = Element(tag, now, now.bad or bad, inside or tag in HOLDERS, hint, path, now.depth + 1)
        links += tag == "a"
        if tag in BLOCKS:
            block = None
        if m[3].rstrip().endswith("/") and tag not in BLOCKS and tag != "a":
            close({tag}, set())
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return _unhinted([b for b in out if b.text])


def link_paths(blocks: list[Block]) -> set[tuple[str, ...]]:
    """Paths of several blocks that hold hardly anything but links."""
    sums: dict[tuple[str, ...], list[int]] = {}
    for b in blocks:
        own = sums.setdefault(b.element.path, [0, 0, 0])
        own[0] += 1
        own[1] += len(b.text)
        own[2] += min(b.linked, len(b.text))
    return {p for p, (count, chars, linked) in sums.items() if count >= LINKS and linked >= LINKED * chars}


def content_paths(blocks: list[Block]) -> set[tuple[str, ...]]:
    """Paths whose smoothed and fused ratios reach the threshold."""
    sums: dict[tuple[str, ...], list[float]] = {}
    for b in blocks:
        own = sums.setdefault(b.element.path, [0, 0, 0, 0])
        own[0] += 1
        own[1] += len(b.text)
        own[2] += len(PUNCTUATION.findall(b.text))
        own[3] += min(b.linked, len(b.text))
    lengths = [sums[b.element.path][1] / sums[b.element.path][0] for b in blocks]
    marks = [sums[b.element.path][2] / sums[b.element.path][0] for b in blocks]

    def smooth(x: list[float]) -> list[float]:
        return [(x[max(i - 1, 0)] + 2 * x[i] + x[min(i + 1, len(x) - 1)]) / 4 for i in range(len(x))]

    fused: dict[tuple[str, ...], float] = {}
    for b, length, mark in zip(blocks, smooth(lengths), smooth(marks), strict=True):
        count, chars, _, linked = sums[b.element.path]
        value = (length * (1 + mark)) ** 0.5 * (1 - linked / chars)
        fused[b.element.path] = fused.get(b.element.path, 0.0) + value / count
    top = max(fused.values())
    return {p for p, v in fused.items() if v >= THRESHOLD * top and v > 0}


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    paths = content_paths(blocks)
    chosen = [b for b in blocks if b.element.path in paths]
    holders: list[Element] = []
    for b in chosen:
        e, outer = b.element, None
        while e is not None:
            outer = e if e.tag in HOLDERS else outer
            e = e.parent
        if outer is not None and outer not in holders:
            holders.append(outer)
    if holders:
        menus = link_paths(blocks) - paths
        kept = [b for b in blocks if _within(b.element, holders) and b.element.path not in menus]
        return "\n\n".join(b.text for b in kept)
    within: dict[int, Element] = {}
    for b in chosen:
        if (branch := _branch(b.element)) is not None:
            own = within.get(id(branch))
            within[id(branch)] = b.element if own is None else _common(own, b.element)
    held, kept, after = {id(e) for e in within.values()}, [], None
    for b in reversed(blocks):
        heads = b.element.tag in HEADINGS and bool(kept) and kept[-1] is after
        if heads or b.element.path in paths or _held(b.element, held):
            kept.append(b)
        after = b
    return "\n\n".join(b.text for b in reversed(kept))


def _branch(e: Element | None) -> Element | None:
    """The outermost element around (or at) ``e`` that is more than the whole page; None for text of the page itself."""
    top = None
    while e is not None:
        top = e if e.tag not in WHOLE else top
        e = e.parent
    return top


def _common(a: Element, b: Element) -> Element:
    """Lowest common ancestor of two elements of a page."""
    while a is not b:
        if a.depth < b.depth:
            a, b = b, a
        a = a.parent
    return a


def _held(e: Element | None, ids: set[int]) -> bool:
    while e is not None:
        if id(e) in ids:
            return True
        e = e.parent
    return False


def _within(e: Element | None, holders: list[Element]) -> bool:
    while e is not None:
        if any(e is h for h in holders):
            return True
        e = e.parent
    return False


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of each whole page."""

    @F.arrow_udf("string")
    def extracted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([main_text(x) for x in column.to_pylist()], pa.string())

    small_batches(df.sparkSession)
    return df.withColumn(out, extracted(F.coalesce(F.col(page), F.lit(""))))
