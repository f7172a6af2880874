"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page. The length of the text in a sliding window of lines
makes a curve; a surge point, where the curve rises over the threshold, opens the main text and a dive point, where
it falls to nothing, closes it. Lines of boilerplate containers (menus, adverts, forms, comments ...) are left out,
unless the container is a wrapper that holds most of the page's text. An article element is a bonus: its lines count
double, links included, and its borders are those of the curve.
"""

from __future__ import annotations

import html as htmllib
import itertools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import of_texts, one_by_one

WINDOW = 3
THRESHOLD = 80

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</?([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?([a-zA-Z][\w:-]*)([^>]*)>", re.S)
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "select", "object", "canvas")}
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot"
    " th thead tr ul video audio".split()
)
_DROPPED = frozenset("nav footer aside form head button menu dialog fieldset".split())
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|side-?bar\w*|footer|foot|header|masthead|top-?bar"
    r"|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*"
    r"|comments?|comment-\w+|commentlist|discussion|disqus|replies|responses|widget|pagination|pager|skip-link|toolbar|legal|copyright)(?=$|[\s_-])",
    re.I,
)
#: What a paragraph or heading of its own may be beside text.
_NOISY_TEXT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe|breadcrumbs?|copyright)(?=$|[\s_-])", re.I)
_TEXT_BLOCKS = ("p", "h1", "h2", "h3")
_ROLES = re.compile(r"\brole\s*=\s*[\"']?(navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu)\b", re.I)
_NAMED = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_MAIN = frozenset(("article", "main"))
#: Containers that are no wrappers of main text, however much they hold.
_NEVER_WRAPS = frozenset("nav footer aside button menu dialog head article main".split())
_TALK = re.compile(r"(?:^|[\s_-])(?:comments?|comment-\w+|commentlist|discussion|disqus|replies|responses|related|recommend\w*)(?=$|[\s_-])", re.I)
_TEASER = re.compile(r"(?:^|[\s_-])(?:teasers?|cards?|previews?)(?=$|[\s_-])", re.I)


class _Container:
    """A boilerplate container: the lines from start to stop."""

    def __init__(self, name: str, attrs: str, start: int):
        self.name, self.start, self.stop = name, start, -1
        self.depth = 1  # how often its name is open
        self.article = -1  # the line where the first article in it starts
        self.hidden = bool(attrs and _HIDDEN.search(attrs))
        self.wraps = not (self.hidden or name in _NEVER_WRAPS or any(_TALK.search(a or b or c) for a, b, c in _NAMED.findall(attrs)))


def _noisy(name: str, attrs: str, in_main: bool) -> bool:
    if name in _DROPPED or (name == "header" and not in_main):
        return True
    if not attrs or name in ("body", "html"):
        return False
    if name in _TEXT_BLOCKS:
        return any(_NOISY_TEXT.search(a or b or c) for a, b, c in _NAMED.findall(attrs))
    if _ROLES.search(attrs) or _HIDDEN.search(attrs):
        return True
    return any(_NOISE.search(a or b or c) or (name == "article" and _TEASER.search(a or b or c)) for a, b, c in _NAMED.findall(attrs))


def _left(lines: list[tuple[str, int, bool]], containers: list[_Container]) -> list[tuple[str, int, bool]]:
    """The lines outside boilerplate. A wrapper that holds most of the text isn't boilerplate, nor is anything but what is hidden if else no line is left."""
    for c in containers:
        if c.stop < 0:  # never closed: a menu ends where the article starts
            c.stop = c.article if c.article >= 0 else len(lines)
    if not containers:
        return lines
    sizes = [n for _, n, _ in lines]
    for c in containers:
        if c.hidden:
            sizes[c.start : c.stop] = [0] * (c.stop - c.start)

    def most_of(sizes: list[int]) -> Callable[[_Container], bool]:
        before = list(itertools.accumulate(sizes, initial=0))
        return lambda c: 2 * (before[c.stop] - before[c.start]) > before[-1]

    def without(dropped: list[_Container]) -> list[bool]:
        gone = [False] * len(lines)
        for c in dropped:
            gone[c.start : c.stop] = [True] * (c.stop - c.start)
        return gone

    gone = without(containers)
    holds = most_of([0 if out else n for n, out in zip(sizes, without([c for c in containers if not c.wraps]), strict=True)])
    has_main = any(line[2] and not out for line, out in zip(lines, gone, strict=True))
    wrappers = [c for c in containers if c.wraps and holds(c) and (not has_main or any(x[2] for x in lines[c.start : c.stop]))]
    if wrappers:
        gone = without([c for c in containers if c not in wrappers])
    if all(gone):
        holds = most_of(sizes)
        gone = without([c for c in containers if c.hidden or not holds(c)])
    return [line for line, out in zip(lines, gone, strict=True) if not out]


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """Lines of a page outside boilerplate: text, length outside links, and whether an article element holds it."""
    lines: list[tuple[str, int, bool]] = []
    buffer: list[str] = []
    linked = in_link = 0
    mains: list[int] = []  # the open articles: how many containers were open before
    containers: list[_Container] = []
    inside: list[_Container] = []  # those that are open

    def flush() -> None:
        nonlocal linked
        text = " ".join(htmllib.unescape("".join(buffer)).split()) if buffer else ""
        buffer.clear()
        if text:
            lines.append((text, max(0, len(text) - linked), bool(mains)))
        linked = 0

    def leave(count: int) -> None:
        """Close all containers but the outer ones."""
        flush()
        for c in inside[count:]:
            c.stop = len(lines)
        del inside[count:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            piece = page[at:stop]
            buffer.append(piece)
            if in_link and piece.strip():
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[1] or m[3] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                buffer.append(htmllib.escape(m[0][9:-3]))
            continue
        closing, attrs = m[0][1] == "/", m[2] or m[4] or ""
        if name in _RAW and not closing:
            if attrs.endswith("/"):
                continue
            done = _RAW[name].search(page, at)
            at = done.end() if done else (page.find("<", at) if name == "title" and page.find("<", at) >= 0 else end)
            continue
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            buffer.append(" ")
        if name in _BLOCKS:
            flush()
            in_link = 0
        if name == "body" and not closing and inside:
            leave(0)
        for i, c in enumerate(inside):
            if c.name == name:
                c.depth += -1 if closing else 1
                if not c.depth:
                    leave(i)
                    break
        else:
            if closing:
                if name in _MAIN and mains:
                    leave(max(0, mains[-1]))
                    mains.pop()
            elif name not in _VOID and not attrs.endswith("/") and _noisy(name, attrs, bool(mains)):
                flush()
                inside.append(_Container(name, attrs, len(lines)))
                containers.append(inside[-1])
            elif name in _MAIN:
                mains.append(len(inside))
                for c in inside:
                    if c.article < 0:
                        c.article = len(lines)
        if mains and mains[-1] > len(inside):  # what held the article has ended
            flush()
            while mains and mains[-1] > len(inside):
                mains.pop()
    flush()
    return _left(lines, containers)


def main_span(lines: list[tuple[str, int, bool]], window: int = WINDOW, threshold: int = THRESHOLD) -> list[str]:
    """The lines between surge and dive points of the curve of window sums.

    Lines that are mostly links have length 0. The curve is broken at the borders of article elements; in one, links
    count and lengths are doubled, and if the curve reaches the threshold, or the articles hold most of the text, all
    of its lines stay. A page whose curve never reaches the threshold gives all its lines.
    """
    sizes = [2 * len(t) if inside else n if 2 * n >= len(t) else 0 for t, n, inside in lines]
    most = 2 * sum(n for _, n, inside in lines if inside) > sum(n for _, n, _ in lines)
    kept: list[str] = []
    found = False
    for inside, run in itertools.groupby(range(len(lines)), key=lambda i: lines[i][2]):
        places = list(run)
        own = [sizes[i] for i in places]
        sums = [sum(own[i : i + window]) for i in range(len(own))]
        surges = max(sums) >= threshold
        if inside:
            if surges or most:
                found = True
                kept += [lines[i][0] for i in places]
            continue
        found = found or surges
        is_open = False
        for i, size, total in zip(places, own, sums, strict=True):
            if not is_open and total >= threshold:
                is_open = True  # surge
            if is_open and not total:
                is_open = False  # dive
            if is_open and size:
                kept.append(lines[i][0])
    return kept if found else [t for (t, _, _), n in zip(lines, sizes, strict=True) if n]


def extract_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    return "\n".join(main_span(page_lines(page), window, threshold)) if page else ""


def extract(df: DataFrame, html: str | Column = "html", text_column: str = "text", window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """Add the main text of each page as text_column, and its code points as n_chars; they replace columns of these names.

    Null or empty html gives an empty text. A tag whose quotes don't close ends at its first >; one that never ends is
    text, and what is left open is closed at the end of the page. Nothing is cut from long pages; rows, repeated or not, stay as they are,
    each read on its own, and an empty table stays empty.
    """

    @F.arrow_udf("string")
    def text_of(pages: pa.Array) -> pa.Array:
        return pa.array((extract_text(x, window, threshold) for x in one_by_one(pages)), pa.string())

    return of_texts(df).withColumn(text_column, text_of(html)).withColumn("n_chars", F.char_length(text_column).cast("long"))
