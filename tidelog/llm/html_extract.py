"""Main text of web pages by tag-path ratios (operator 10).

Text nodes are grouped by their root-to-leaf tag path. A path's text ratio is its text
length per node, its punctuation ratio the punctuation per node; both are smoothed over the
page's sequence of nodes, fused by multiplication and thresholded by their spread. The
smallest element that holds nearly all selected text is the article; its blocks and those of
every section with other selected text are the result, but for parts that are marked as
something else (navigation, forms, comments ...).
A mark is a hint: it is void on an element that holds the page's article.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches

#: A tag whose quotes don't close before the page ends is read up to its first ">" (the last but one alternative).
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<torn>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content isn't read as HTML and is left out; without an end tag it is the rest of the page, but for an <iframe>, which is empty then.
RAW = frozenset("script style textarea title iframe".split())
#: Elements in which "/>" ends any element, what in them holds HTML again, and the HTML tags that end them.
FOREIGN = frozenset(("svg", "math"))
HTML_IN_FOREIGN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var "
    "article aside details dialog fieldset figcaption figure footer form header hgroup main nav section summary".split()
)
#: A tag in one of these doesn't end an element around it.
WALLS = frozenset("button foreignobject marquee math mtext noembed noframes noscript object svg template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul xmp".split())
#: An open element that a new tag of the same family ends.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
AWAY = frozenset("nav aside form footer head script style noscript noembed noframes template iframe button select textarea svg canvas object dialog menu fieldset label audio video".split())
#: Marked tags that also just wrap a page or its article, as a form does in ASP.NET.
WRAPS = frozenset("form fieldset label object canvas audio video".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Words that mark an element as something other than the article. A class or id that consists of them and of words that say
#: nothing by themselves (PLACES, COMPANIONS) is a hint; with any other word it is a doubt, which the page's structure and ratios settle.
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar aside rail footer masthead topbar toolbar comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert "
    "popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login search pagination pager widget widgets form discussion discussions".split()
)
#: Words that are a hint beside any other.
STRONG_WORDS = frozenset("comment comments commentlist disqus advert adverts advertisement advertising adsense".split())
COMPANIONS = frozenset("user users reader readers guest thread threads post posts slot unit google button buttons icon icons link links message messages count item items story stories more your our".split())
#: With these, a class says what else a page has.
ABOUT = frozenset("with without has no".split())
#: Classes that a comment's date or author has.
_RECORD_SIGN = re.compile(r"\b(?:author|byline|date|datetime|timestamp|posted|avatar|username|user-?name|permalink)\b", re.I)
PLACES = frozenset("site page main primary secondary top bottom left right area list container wrapper wrap box block section bar header".split())
NEVER_AWAY = frozenset(("html", "body", "article", "main"))
#: Tags that don't end an open <head>.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，、؛؟…]")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Blocks that are parts of a section.
PARTS = HEADINGS | frozenset("p ul ol li menu dl dt dd blockquote pre xmp table caption thead tbody tfoot tr th td figure figcaption hgroup hr".split())
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in (*RAW, "xmp")}


#: Tags that end an open element, or keep it from being ended.
_FAMILIES = WALLS | {"p"} | {t for ends, bars in CLOSES.values() for t in f"{ends} {bars}".split()}


class Node:
    """An element. What it takes from those around it is found once, so that a page takes time in proportion to its length at any depth."""

    __slots__ = ("away", "depth", "firm_above", "foreign", "held", "in_link", "in_main", "linked", "main", "mark", "near", "parent", "path", "picked", "records", "signed", "tag", "under_main", "whole")

    def __init__(self, tag: str, parent: Node | None, attrs: str, paths: dict[tuple[int, str], int]) -> None:
        self.tag, self.parent, self.away = tag, parent, False
        self.depth = parent.depth + 1 if parent else 0
        #: Number of the root-to-leaf tag path.
        self.path = paths.setdefault((parent.path if parent else -1, tag), len(paths))
        self.mark = _mark(tag, attrs, parent) if parent else ""
        #: Whether it is, or is in, an <article> or <main>.
        self.in_main = parent is not None and parent.in_main or tag in ("article", "main")
        #: The nearest element, itself included, that ends others or is ended by others.
        self.near = self if tag in _FAMILIES else parent and parent.near
        #: The <svg> or <math> whose syntax holds in this element.
        self.foreign = self if tag in FOREIGN else None if parent is None or tag in HTML_IN_FOREIGN else parent.foreign
        self.main = tag == "main" or tag == "article" and _hinted(tag, attrs) != "hint"
        #: Whether an element that is main, or firmly marked, is around or is this one.
        self.under_main = parent is not None and parent.under_main or self.main
        self.firm_above = parent is not None and parent.firm_above or self.mark == "firm"
        self.held, self.whole = 0, False
        #: Whether it is, or is in, a link; text in links and text that the ratios select in it; whether it has a date or an author, and how many children of each tag do.
        self.in_link = tag == "a" or parent is not None and parent.in_link
        self.linked = self.picked = 0
        self.signed = tag == "time" or _RECORD_SIGN.search(attrs) is not None
        self.records: Counter[str] | None = None


def _values(attrs: str) -> list[tuple[str, str]]:
    return [(name.lower(), html.unescape(a or b or c)) for name, a, b, c in _ATTR.findall(attrs)] if attrs.strip() else []


def _hinted(tag: str, attrs: str) -> str:
    """Whether a class or id names something other than an article ("hint"), or may do so ("doubt"). Ids of headings are made of their text, and those of sections may be."""
    found = ""
    for name, value in _values(attrs):
        if name == "class" or name == "id" and tag not in HEADINGS:
            for token in value.split():
                words = {w.lower() for w in _WORDS.findall(token) if len(w) > 1}
                away = set() if words & ABOUT else words & AWAY_WORDS
                if away & STRONG_WORDS or away and words <= AWAY_WORDS | PLACES | COMPANIONS and not (name == "id" and tag == "section"):
                    return "hint"
                found = "doubt" if away else found
    return found


def _mark(tag: str, attrs: str, parent: Node) -> str:
    """How the element itself says that it isn't part of an article: "firm", by a "hint", as one that "wraps", or not ("")."""
    if tag in NEVER_AWAY:
        return ""
    if tag in AWAY and tag not in WRAPS and not (tag == "template" and "shadowrootmode" in attrs.lower()):
        return "firm"
    if tag == "header" and not parent.in_main:
        return "firm"
    for name, value in _values(attrs):
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "firm"
        if name == "role" and value.lower() in AWAY_ROLES:
            return "wraps" if value.lower() == "form" else "firm"
    return "wraps" if tag in WRAPS else _hinted(tag, attrs)


def _up(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _near(node: Node) -> Iterator[Node]:
    """The elements around, itself included, that end others or are ended by others."""
    n = node.near
    while n is not None:
        yield n
        n = n.parent and n.parent.near


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str | None]]]:
    """All elements, parents first, and the text nodes in page order: element, raw text; None where a block in the element begins or ends."""
    paths: dict[tuple[int, str], int] = {}
    root = Node("", None, "", paths)
    open_, out, at, elements = root, [], 0, [root]
    count: Counter[str] = Counter()

    def end_to(node: Node) -> Node:
        """Ends the open elements up to, but not with, ``node``."""
        n = open_
        while n is not node:
            count[n.tag] -= 1
            n = n.parent
        return node

    while at < len(page):
        m = _TOKEN.match(page, at)
        if m is None:  # an unfinished tag at the end
            break
        at = m.end()
        if (text := m["text"]) is not None:
            if open_.tag == "head" and not text.isspace():
                open_ = end_to(open_.parent)
            out.append((open_, text))
        elif (tag := m["tag"] or m["torn"]) is not None:
            tag, attrs = tag.lower(), m["attrs"] if m["tag"] else m["rest"]
            closed = attrs.endswith("/")
            while open_.foreign is not None and tag in BREAKS_OUT:
                open_ = end_to(open_.foreign.parent)
            if tag in RAW:
                if not (closed and (tag == "iframe" or open_.foreign is not None)):
                    end = ENDS[tag].search(page, at)
                    at = end.end() if end else at if tag == "iframe" else len(page)
                continue
            if open_.tag == "head" and tag not in IN_HEAD:
                open_ = end_to(open_.parent)
            if tag == "body" and count["head"]:
                open_ = end_to(next(n.parent for n in _up(open_) if n.tag == "head"))
            if tag in BLOCK and count["p"]:
                found = next((n for n in _near(open_) if n.tag == "p" or n.tag in WALLS), None)
                if found is not None and found.tag == "p":
                    open_ = end_to(found.parent)
            if tag in CLOSES:
                ends, bars = (x.split() for x in CLOSES[tag])
                if any(count[x] for x in ends):
                    for n in _near(open_):
                        if n.tag in bars or n.tag in WALLS:
                            break
                        if n.tag in ends:
                            open_ = end_to(n.parent)
            if tag in BLOCK:
                out.append((open_, None))
            if tag == "br":
                out.append((open_, " "))
            if tag not in VOID and not closed:
                open_ = Node(tag, open_, attrs, paths)
                elements.append(open_)
                count[tag] += 1
                if tag == "xmp" and (end := ENDS[tag].search(page, at)):  # shown as it is written
                    out.append((open_, html.escape(page[at : end.start()], quote=False)))
                    at = end.start()
        elif (tag := m["end"]) is not None:
            tag = tag.lower()
            if count[tag]:
                open_ = end_to(next(n.parent for n in _up(open_) if n.tag == tag))
            if tag in BLOCK:
                out.append((open_, None))
        elif m["cdata"]:
            out.append((open_, m["cdata"]))
    return elements, out


def hold(elements: list[Node], texts: list[tuple[Node, str]], picked: list[bool]) -> int:
    """Sets ``held``, the selected text in every element; returns all of it."""
    for n in elements:
        n.held = 0
    for (node, text), ok in zip(texts, picked):
        if ok:
            node.held += len(text)
    for n in reversed(elements):
        if n.parent is not None:
            n.parent.held += n.held
    return elements[0].held


def _smoothed(values: list[float], width: int = 2) -> list[float]:
    kernel = [math.exp(-k * k / 2) for k in range(-width, width + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - width), min(len(values), i + width + 1)
        w = kernel[lo - i + width : hi - i + width]
        out.append(sum(x * y for x, y in zip(values[lo:hi], w)) / sum(w))
    return out


def content_nodes(texts: list[tuple[Node, str]]) -> list[bool]:
    """Which text nodes the fused and thresholded path ratios select."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, text in texts:
        length[node.path] += len(text)
        marks[node.path] += len(_PUNCTUATION.findall(text))
        count[node.path] += 1
    text_ratio = _smoothed([length[n.path] / count[n.path] for n, _ in texts])
    mark_ratio = _smoothed([marks[n.path] / count[n.path] for n, _ in texts])
    fused = [a * (1 + b) for a, b in zip(text_ratio, mark_ratio)]
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    least = min(mean, 0.8 * spread) if spread else mean
    return [x >= least for x in fused]


def find_records(elements: list[Node]) -> None:
    """Marks elements, in no <article> or <main> and not yet marked, that hold three or more like records with a date or an author each, as reader comments are."""
    for n in reversed(elements):
        up = n.parent
        if up is not None and n.signed:
            up.signed = True
            if n.tag in ("div", "section") and n.held:
                up.records = up.records or Counter()
                up.records[n.tag] += 1
    for n in elements:
        if not n.mark and not n.in_main and n.tag not in NEVER_AWAY and n.records and max(n.records.values()) >= 3:
            n.mark = "hint"


def settle_doubts(elements: list[Node], texts: list[tuple[Node, str]], picked: list[bool]) -> None:
    """A doubt becomes a hint where most of the element's text is in links, or the ratios select less than half of it; else it is dropped."""
    doubts = [n for n in elements if n.mark == "doubt"]
    if not doubts:
        return
    for (node, text), ok in zip(texts, picked):
        node.linked += len(text) * node.in_link
        node.picked += len(text) * ok
    for n in reversed(elements):
        if n.parent is not None:
            n.parent.linked += n.linked
            n.parent.picked += n.picked
    for n in doubts:
        n.mark = "hint" if 2 * n.linked >= n.held or 2 * n.picked < n.held else ""


def put_away(elements: list[Node], texts: list[tuple[Node, str]]) -> None:
    """Sets ``away`` on the elements that are marked, or in such an element, unless the mark is void.

    A hint, or a tag that only wraps, is void on an element that holds an <article> or <main>;
    a firm mark if no <article> or <main> is outside firm marks. On a page without any of these
    (or with none that holds selected text) every mark is void on an element that holds more
    than half of the selected text, and that of a tag that only wraps is on any page.
    """
    if not any(n.mark or n.signed for n in elements):
        return
    hold(elements, texts, [True] * len(texts))
    find_records(elements)
    if not any(n.mark for n in elements):
        return
    mains, around = [n for n in elements if n.main and n.held], set()  # an empty one says nothing
    for n in mains:
        for a in _up(n.parent):
            if a in around:
                break
            around.add(a)
    picked = content_nodes(texts)
    settle_doubts(elements, texts, picked)
    total = hold(elements, texts, picked)
    within = any(ok and node.under_main for (node, _), ok in zip(texts, picked))
    lost = all(n.parent.firm_above for n in mains)
    for n in elements:
        most = 2 * n.held > total
        if n.mark == "firm":
            void = n in around and lost or most and not within
        else:
            void = n in around or most and (n.mark == "wraps" or not within)
        n.away = n.parent is not None and n.parent.away or n.mark != "" and not void


def article(elements: list[Node], texts: list[tuple[Node, str]], picked: list[bool], share: float = 0.9) -> Node:
    """The smallest element that holds ``share`` of the selected text; <article> and <main> win over what is in them."""
    least = share * hold(elements, texts, picked)
    best = max((n for n in elements if n.held >= least), key=lambda n: n.depth)
    while best.parent is not None and best.tag not in BLOCK:
        best = best.parent
    if best.tag == "p" or best.tag in HEADINGS:  # a single paragraph: its siblings belong to it
        best = best.parent or best
    outer = [n for n in _up(best) if n.tag in ("article", "main")]
    return next((n for n in outer if n.tag == "article"), outer[0] if outer else best)


def sections(elements: list[Node], around: set[Node]) -> dict[Node, Node]:
    """What a selected text in an element belongs to outside the article.

    Its outermost <article> or <main>, or else its nearest container, but nothing ``around``
    the article; a text right in what is around it, to that.
    """
    outer: dict[Node, Node] = {}
    box: dict[Node, Node] = {}
    for n in elements:
        if n in around:
            box[n] = n
            continue
        inner = n.parent not in around
        if inner and n.parent in outer:
            outer[n] = outer[n.parent]
        elif n.tag in ("article", "main"):
            outer[n] = n
        box[n] = n if not inner or n.tag in BLOCK and n.tag not in PARTS else box[n.parent]
    return box | outer


def extract(page: str) -> str:
    """The main text: blocks of the article and of the other selected sections in page order, one a line."""
    elements, nodes = parse(page)
    nodes = [(node, text and html.unescape(text)) for node, text in nodes]
    texts = [(node, t) for node, text in nodes if text and (t := " ".join(text.split()))]
    if texts:
        put_away(elements, texts)
        texts = [(node, t) for node, t in texts if not node.away]
    if not texts:
        return ""
    picked = content_nodes(texts)
    top = article(elements, texts, picked)
    of = sections(elements, set(_up(top)))
    whole = {top, *(of[node] for (node, _), ok in zip(texts, picked) if ok)}
    for n in elements:
        n.whole = n in whole or n.parent is not None and n.parent.whole
    selected = iter(picked)
    blocks: list[list[str]] = [[]]
    keep = [False]
    for node, text in nodes:
        if node.away:
            continue
        if text is None:
            blocks.append([])
            keep.append(False)
        else:
            blocks[-1].append(text)
            if text.strip():
                keep[-1] |= next(selected) or node.whole
    lines = (" ".join("".join(parts).split()) for parts, ok in zip(blocks, keep) if ok)
    return "\n".join(x for x in lines if x)


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    for part in sliced(batches, "html"):
        texts = [extract(x or "") for x in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url").cast(pa.string()), pa.array(texts, pa.string())], schema=schema)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text: the main text of every row, empty if there is none.

    Character references are decoded, white space inside a block becomes one space, blocks
    are joined by one line feed; nothing else is dropped or cut. A null or empty page gives
    an empty text; repeated rows each give theirs. Other columns are ignored; an empty
    table gives no rows.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_map, "page_id long, url string, text string")
