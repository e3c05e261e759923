"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped so that each block element becomes one line. A line weighs what it holds outside links. What the page
says about itself only raises or lowers weights: lines inside its article weigh SURGE more, lines beside an article that
holds most of the text weigh nothing, and lines of navigation, headers, footers, sidebars, notices, adverts, forms and
reader comments, as their elements, roles and names say, weigh nothing and are never kept.

The weights are summed over sliding windows of WINDOW lines. The text surges where a window's sum reaches SURGE and
dives where nothing is left in the window. At both edges, where a window reaches over the end of the text, lines stay
only if they carry weight themselves or share an element with lines that do, so that reference lists and short
paragraphs stay and captions of foreign boxes go. Where nothing surges, every line with weight is kept.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

WINDOW, SURGE = 3, 80
#: A line of so much weight is text of its own.
CORE = 40
#: Elements whose content is never text.
RAW = frozenset("script style noscript template title textarea svg iframe object canvas select option datalist".split())
#: Inline elements that are controls if a line holds nothing else.
CONTROLS = frozenset("button label".split())
#: Elements that hold no part of an article.
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
#: Elements that hold none as a rule, but may wrap a whole page.
WRAPPERS = frozenset("form fieldset".split())
#: Elements that begin and end lines.
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | BOILERPLATE | WRAPPERS
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose end tag may be missing, and what they cannot reach beyond to the next of their kind.
LOOSE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
#: Words of class and id names, and roles, of what is no part of an article as a rule; pages may be wrapped in them.
NAMES = frozenset(
    "sponsor sponsored promo promotion notice notices alert popup modal overlay nav navbar navigation menu sidebar sidebars aside widget widgets footer masthead topbar toolbar "
    "signup login related recommended social search form".split()
)
#: Of what never is, however much text it holds: reader comments, adverts, consent, sharing.
FOREIGN_NAMES = frozenset(
    "comment comments disqus respond reply replies discussion ad ads advert advertisement advertising adverts banner cookie cookies consent gdpr "
    "breadcrumb breadcrumbs subscribe subscription newsletter share sharing pagination pager skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
#: Class names that say what a page has or allows, not what the element is.
_STATE = re.compile(r"^(?:has|with|no|is)[-_]|[-_](?:open|closed|enabled|disabled|on|off)$")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
KEPT, NAMED, FOREIGN, SKIPPED = range(4)
FREE, LINK, CONTROL = range(3)


def _clean(text: str) -> str:
    return _SPACE.sub(" ", unescape(text)).strip()


def _kind(name: str, attributes: str, in_article: bool) -> int:
    """SKIPPED: no text, whatever it holds; FOREIGN and NAMED: none as names say; else KEPT."""
    if name in BOILERPLATE or (name == "header" and not in_article):
        return SKIPPED
    found = NAMED if name in WRAPPERS else KEPT
    if not attributes.strip() or name in ("html", "body", "main", "h1"):
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or (key == "role" and value in ROLES):
            return SKIPPED
        if key in ("class", "id"):
            words = {w for token in value.split() if not _STATE.search(token) for w in re.split(r"[^a-z0-9]+", token)}
            found = FOREIGN if words & FOREIGN_NAMES else max(found, NAMED) if words & NAMES else found
        elif key == "role" and value == "form":
            found = max(found, NAMED)
    return found


class Element:
    """A block of the page, or an inline element that a name tells apart."""

    __slots__ = ("dropped", "held", "kind", "name", "parent", "size")

    def __init__(self, name: str, parent: Element | None, kind: int) -> None:
        self.name, self.parent, self.kind = name, parent, kind
        self.size = 0  # unlinked characters inside, without those of skipped elements
        self.held = False  # whether it holds a main or h1, or the page's article
        self.dropped = kind == SKIPPED or (parent is not None and parent.dropped)

    def path(self):
        e = self
        while e is not None:
            yield e
            e = e.parent


class Line:
    __slots__ = ("element", "free", "pieces", "text")

    def __init__(self, pieces: list) -> None:
        self.pieces, self.element = pieces, pieces[0][2]
        self.text, self.free = "", 0


def parse(html: str) -> tuple[list[Line], list[Element]]:
    """The page's lines as pieces (text; free, in a link or in a control; element), and its elements, the root first."""
    root = Element("", None, KEPT)
    elements, stack, lines, pieces = [root], [root], [], []
    at = links = controls = 0

    def flush() -> None:
        nonlocal pieces
        if pieces:
            lines.append(Line(pieces))
            pieces = []

    def add(piece: str) -> None:
        if piece and not stack[-1].dropped:
            pieces.append((piece, CONTROL if controls else LINK if links else FREE, stack[-1]))

    def leave(name: str) -> None:
        while stack[-1].name != name:
            stack.pop()
        stack.pop()

    for m in iter(lambda: _TOKEN.search(html, at), None):
        add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        closing, name = bool(m[1]), m[2].lower()
        if name in RAW:
            if not closing and not m[3].endswith("/"):
                at = re.compile(rf"</{re.escape(name)}\s*>|\Z", re.I).search(html, at).end()
            continue
        if name in BLOCKS:
            flush()
            links = 0 if name != "li" or closing else links
        if name in VOID:
            if name == "br":
                add(" ")
        elif closing:
            if name == "a":
                links = 0
            elif name in CONTROLS:
                controls = max(0, controls - 1)
            if any(e.name == name for e in stack[1:]):
                leave(name)
        else:
            if name in BLOCKS and stack[-1].name == "p":
                stack.pop()
            if name in LOOSE:
                for e in reversed(stack):
                    if e.name in LOOSE[name]:
                        break
                    if e.name == name or (LOOSE[name] == LOOSE.get(e.name)):
                        leave(e.name)
                        break
            kind = _kind(name, m[3], any(e.name in ("article", "main") for e in stack))
            if name in BLOCKS or kind != KEPT:
                elements.append(Element(name, stack[-1], kind))
                if kind == SKIPPED and not stack[-1].dropped and name in BLOCKS:
                    lines.append(Line([("", FREE, elements[-1])]))  # what is skipped keeps a place among the lines
                stack.append(elements[-1])
            if name == "a":
                links = 1
            elif name in CONTROLS:
                controls += 1
    add(html[at:])
    flush()
    return lines, elements


def _decide(elements: list[Element]) -> list[Element]:
    """Drop what names call boilerplate, and tell the elements that mark the page's article, if any does.

    A named element stays if it holds a main, an h1 or the article, or more than half of the text; comments, adverts and
    the like only in the first case. Of several articles without a main, those of less than a third of the largest are other stories.
    """
    live = [e for e in elements if not e.dropped]
    articles = [e for e in live if e.name == "article" and (e.kind == KEPT or 2 * e.size > elements[0].size) and not any(p.kind == FOREIGN or (p.name == "article" and p is not e) for p in e.path())]
    most = max((e.size for e in articles), default=0)
    chosen = [e for e in articles if 3 * e.size >= most and e.size]
    mains = [e for e in live if e.name == "main" and e.size]
    for e in live:
        if e.name == "main" or (e.name == "h1" and e.size) or e in chosen:
            for p in e.path():
                if e.name != "article" or p.kind != FOREIGN:
                    p.held = True
    other = [e for e in articles if e not in chosen]
    total, gone = elements[0].size, dict.fromkeys(live, 0)  # what dropped elements inside held
    for e in sorted((e for e in live if e.kind in (NAMED, FOREIGN)), key=lambda e: e.size):
        own = e.size - gone[e]
        if not e.held and (e.kind == FOREIGN or 2 * own <= total):
            e.dropped = True
            total -= own
            for p in e.parent.path():
                gone[p] += own
    for e in other:
        e.dropped = True
    for e in elements[1:]:
        e.dropped = e.dropped or e.parent.dropped
    return [e for e in mains or chosen if not e.dropped]


def weigh(lines: list[Line], marks: list[Element]) -> list[float]:
    """What each line weighs: its letters outside links, raised inside the marked article, lowered beside it."""
    inside = [any(m in line.element.path() for m in marks) for line in lines]
    within = sum(line.free for line, x in zip(lines, inside, strict=True) if x)
    beside = sum(line.free for line, x in zip(lines, inside, strict=True) if not x)
    share = 1.0 if not within else max(0.0, 1 - within / beside) if beside else 0.0
    out = []
    for line, x in zip(lines, inside, strict=True):
        if not line.text:
            out.append(0.0)
        elif x:
            out.append(line.free + SURGE)
        else:
            out.append(0.0 if _RIGHTS.match(line.text) else line.free * share)
    return out


def regions(weights: list[float]) -> list[tuple[int, int]]:
    """[from, to) of each stretch of lines from a surge of the windows' sums to their dive."""
    sums, out, i = [sum(weights[i : i + WINDOW]) for i in range(len(weights))], [], 0
    while i < len(weights):
        if sums[i] >= SURGE and weights[i]:
            end = i
            while end < len(weights) and sums[end]:
                end += 1
            out.append((i, end))
            i = end
        else:
            i += 1
    return out


def _trimmed(lines: list[Line], weights: list[float], start: int, end: int, floor: int, top: int) -> tuple[int, int]:
    """A region without foreign lines at its edges, and with the lines beyond them that share an element with its text."""
    core = [i for i in range(start, end) if weights[i] >= CORE]
    if not core:
        return start, end
    homes = {id(lines[i].element.parent) for i in core}
    wide = {id(lines[i].element.parent) for i in core if lines[i].element.parent is not None and lines[i].element.parent.name not in ("", "body", "html")}

    def shares(i: int) -> bool:
        parent = lines[i].element.parent
        return bool(lines[i].text) and (id(parent) in homes or (parent is not None and any(id(p) in wide for p in parent.path())))

    def stays(i: int) -> bool:
        return weights[i] >= CORE or shares(i)

    while start < core[0] and not stays(start) and not (lines[start].element.name in HEADINGS and start + 1 == core[0]):
        start += 1
    while not stays(end - 1):
        end -= 1
    at = end  # beyond the dive: reference lists and short ends
    while at < top and (shares(at) or not lines[at].text):
        at += 1
        end = at if lines[at - 1].text else end
    at = start
    while at > floor and (shares(at - 1) or not lines[at - 1].text):
        at -= 1
        start = at if lines[at].text else start
    return start, end


def main_text(html: str | None) -> str:
    """The article of a page, one line per block; empty if there is none. Null counts as empty."""
    lines, elements = parse(html or "")
    for line in lines:
        for piece, flag, e in line.pieces:
            if piece and flag == FREE:
                n = len(_clean(piece))
                for p in e.path():
                    p.size += n
    marks = _decide(elements)
    for line in lines:
        left = [(p, flag) for p, flag, e in line.pieces if not e.dropped]
        if all(flag == CONTROL for p, flag in left if not p.isspace()):
            continue  # a control on its own is no text
        line.text = _clean("".join(p for p, _ in left))
        free = _clean("".join(p for p, flag in left if flag == FREE))
        line.free = len(line.text) if len(free) == len(line.text) else len(free) if 2 * len(free) >= len(line.text) else sum(map(str.isalnum, free))
    weights = weigh(lines, marks)
    found = regions(weights)
    if not found:  # a short page
        return "\n".join(line.text for line, w in zip(lines, weights, strict=True) if w)
    keep, last = [], 0
    for k, (a, b) in enumerate(found):
        a, b = _trimmed(lines, weights, max(a, last), max(b, last), last, found[k + 1][0] if k + 1 < len(found) else len(lines))
        keep += [line.text for line, w in zip(lines[a:b], weights[a:b], strict=True) if line.text and (w or not marks)]
        last = max(last, b)
    return "\n".join(keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html, more).

    Null, empty and text-free pages have an empty text; null page_ids and urls stay null; repeated rows repeat their
    result. Nothing is cut, whatever a page's length. One pass, no shuffle.
    """

    def texts(ids, urls, pages_):
        got = [main_text(h) for h in pages_]
        return ids, urls, got, [len(t) for t in got]

    return map_columns(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), texts, "page_id long, url string, text string, n_chars long", size_of=2)
