"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text nodes, each with its path of tags from the
root (as the number of that path in the page).  For each path the lengths and the punctuation of its nodes are summed and
set in relation to the number of nodes; both ratios are smoothed over the
neighbours in page order and fused by their product.  A path is content if its
fused ratio is high against the page.  Paths below elements that can not be
content (navigation, scripts, adverts and the like, told by tag, role or class)
do not take part.  Class words and forms only hold for an element without an
article or main element in it, and not at all where the page has no sentence
besides.  Headings belong to the content that they stand before.

Every page is worked on where it is read, without a shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values of HTML: elements without content, elements that end a block,
# and elements whose text is not text of the page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math object canvas".split())
AWAY = frozenset("nav header footer aside button select option menu dialog head".split())
# elements that often wrap a whole page or article: told away like a class word
SOFT = frozenset("form label fieldset".split())
# class words do not speak of the page as a whole
WHOLE = frozenset("html body main article".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
AWAY_NAMES = re.compile(
    r"(?:.*[_-])?(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|footer|foot|header|masthead|cookies?|consent|gdpr|"
    r"notices?|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|disqus|replies|reply|respond|pagination|pager|widget\w*|login|signup|search)"
    r"(?:[_-].*)?|side",
    re.IGNORECASE,
)
# words that say that something is there or not, not what the element is
STATES = re.compile(r"(?:no|not|has|have|with|without|show|hide|is|single|full)[_-]|.*[_-](?:open|closed|on|off|enabled|disabled|count)$", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
# a quote counts where a value begins; one without its pair is a sign like others
PIECE = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# elements whose text runs to the end of the page if they are not closed
ENDLESS = frozenset("script style textarea title iframe noembed noframes xmp".split())
SENTENCE = re.compile(r"[.!?。！？…]")
WHITE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?。、，！？…]")
HEADING = re.compile(r"h[1-6]$")
# elements that only change the look of text inside a block
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
# an open p, li and so on ends where one of these begins
CLOSES = {"p": BLOCK - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
SMOOTHED = 2
SHARE = 0.1


# what an element says of the text in it: nothing, a soft and a hard no
ABLE, DOUBTED, GONE = range(3)


def _verdict(name: str, attributes: str) -> int:
    if name in AWAY:
        return GONE
    found = DOUBTED if name in SOFT else ABLE
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "role" and value.lower() in AWAY_ROLES or key in ("hidden", "aria-hidden") and value.lower() in ("", "true", "hidden"):
            return GONE
        if key == "style" and HIDDEN.search(value):
            return GONE
        if key in ("class", "id") and name not in WHOLE and any(AWAY_NAMES.fullmatch(t) and not STATES.match(t) for t in value.split()):
            found = DOUBTED
    return found


class Open:
    """An open element: its path, and what it and those around it say of their text."""

    __slots__ = ("name", "path", "gone", "doubt", "article", "heading")

    def __init__(self, name: str, path: int, verdict: int, around: Open | None):
        self.name, self.path = name, path
        self.gone = verdict == GONE or around is not None and around.gone
        # number of the innermost doubted element, 0 for none
        self.doubt = around.doubt if around else 0
        self.article = around.article if around else 0
        self.heading = bool(HEADING.match(name)) or around is not None and around.heading


def text_nodes(page: str) -> list[tuple[int, str, bool, int, bool]]:
    """Blocks of text in page order.

    A block is (path, text, whether it can be content, path of its outermost
    article or 0, whether it is in a heading).  Doubted elements that hold an
    article are believed to be content; if no other block has a sentence, all are.
    """
    out: list[tuple[int, str, Open | None]] = []
    stack: list[Open] = []
    opened: dict[str, int] = defaultdict(int)
    paths: dict[tuple[int, str], int] = {}
    # each doubted element knows the one around it, and whether an article is in it
    around: list[int] = [0]
    cleared: list[bool] = [True]
    held: list[str] = []

    def flush() -> None:
        text = WHITE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((stack[-1].path if stack else 0, text, stack[-1] if stack else None))

    def shut(k: int) -> None:
        for e in stack[k:]:
            opened[e.name] -= 1
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        m = PIECE.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK or name in AWAY:
                flush()
            if opened[name]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == name:
                        shut(k)
                        break
                    if name in INLINE and stack[k].name not in INLINE:
                        break
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            if name in BLOCK:
                flush()
            close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else size if name in ENDLESS else at
            continue
        if name in BLOCK:
            flush()
            while stack and name in CLOSES.get(_block(stack), ()):
                k = len(stack) - 1
                while k > 0 and stack[k].name in INLINE:
                    k -= 1
                shut(k)
        if name not in VOID and not m[3].endswith("/"):
            outer = stack[-1] if stack else None
            path = outer.path if outer else 0
            if name not in INLINE:
                path = paths.setdefault((path, name), len(paths) + 1)
            verdict = _verdict(name, m[3])
            e = Open(name, path, verdict, outer)
            if name in ("article", "main") and not e.gone:
                e.article = e.article or path
                d = e.doubt
                while not cleared[d]:
                    cleared[d] = True
                    d = around[d]
            if verdict == DOUBTED:
                around.append(e.doubt)
                cleared.append(False)
                e.doubt = len(around) - 1
            stack.append(e)
            opened[name] += 1
    flush()

    # whether an element or one around it stays doubted; outer ones have smaller numbers
    doubted = [False]
    for d in range(1, len(around)):
        doubted.append(not cleared[d] or doubted[around[d]])
    nodes = []
    for path, text, e in out:
        doubt = doubted[e.doubt] if e else False
        nodes.append((path, text, not (e and e.gone), doubt, e.article if e else 0, bool(e and e.heading)))
    said = any(able and not doubt and len(text) >= 25 and SENTENCE.search(text) for _, text, able, doubt, _, _ in nodes)
    return [(path, text, able and not (doubt and said), article, heading) for path, text, able, doubt, article, heading in nodes]


def _block(stack: list[Open]) -> str:
    return next((e.name for e in reversed(stack) if e.name not in INLINE), "")


def _smooth(x: list[float]) -> list[float]:
    """Gaussian weights over SMOOTHED neighbours on each side."""
    w = [math.exp(-(k * k) / 2) for k in range(-SMOOTHED, SMOOTHED + 1)]
    out = []
    for i in range(len(x)):
        part = [(w[k + SMOOTHED], x[i + k]) for k in range(-SMOOTHED, SMOOTHED + 1) if 0 <= i + k < len(x)]
        out.append(sum(a * b for a, b in part) / sum(a for a, _ in part))
    return out


def main_text(page: str) -> str:
    """Blocks of the main text, joined by line breaks; empty if there is none."""
    nodes = [(p, t, a, h) for p, t, able, a, h in text_nodes(page) if able]
    if not nodes:
        return ""
    count: dict = defaultdict(int)
    length: dict = defaultdict(int)
    marks: dict = defaultdict(int)
    for path, text, _, _ in nodes:
        count[path] += 1
        length[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
    by_text = _smooth([length[p] / count[p] for p, *_ in nodes])
    by_marks = _smooth([1 + marks[p] / count[p] for p, *_ in nodes])
    fused = [a * b for a, b in zip(by_text, by_marks)]
    best: dict = defaultdict(float)
    for (path, *_), f in zip(nodes, fused):
        best[path] = max(best[path], f)
    top = max(best.values())
    content = {p for p in best if best[p] >= SHARE * top}
    # the article around the content: its headings and short blocks belong to it
    inside = {a for p, _, a, _ in nodes if a and p in content}
    # whether a heading's next node that is none is content
    heads, after = [False] * len(nodes), None
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i][3]:
            heads[i] = after in content
        else:
            after = nodes[i][0]
    keep = [a in inside if inside else path in content or heads[i] for i, (path, _, a, _) in enumerate(nodes)]
    return "\n".join(t for (_, t, _, _), k in zip(nodes, keep) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x or "") for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    A null or empty page has an empty text.  Other columns are ignored, whatever
    their names; rows that repeat a page are worked on each for itself.  Paths
    of equal ratio are kept or dropped together.  Time grows with the length of
    a page, whatever its depth; a tag or element without an end is read up to
    the end of its tag, scripts and the like up to the end of the page.
    """
    ids = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {ids}, url string, text string, n_chars bigint")
