"""HTML extraction by line-block distribution.

Markup is stripped to lines: every block of a page (paragraph, heading, list item, cell, ...) is one line of text with a weight, its
length without the text of its links (a paragraph counts half its length at least). Over these lines the weights are
summed in sliding windows. Where the sums leave zero they rise, where a whole window has no weight any more is a dive, and a window of
`surge` characters between (or of the page's highest sum, if that is less) is a surge. The text from a rise with a surge to its
dive is kept, with lines of links alone that lie between; a longer list of links is a dive.

Tags are weights of the distribution:

* Menus, headers and footers of the page, sidebars, notices, adverts, forms and reader comments (known by tag, role, class or id) weigh
  nothing and are not kept. Those that stand beside the text leave empty lines, adverts and notices in it leave none. An
  element that is so named but holds an article, a main element, a headline or more than half of the page's text (two thirds beside an article) wraps the text and
  counts as an ordinary one (comments never do).
* If the page's article elements hold half of the weight, all other lines weigh nothing, theirs weigh their whole text, lists of links too, and any weight is a
  surge; likewise for main. Articles that hold less are teasers and have no privilege.
* Where only elements that stand beside the text lie between two runs, they do not end the text: paragraphs that follow a surge, or lead to one, are
  kept without a surge of their own.

Inside a block, character references are decoded and white space becomes one space; a line break element is white space.

Defined cases: null or empty html gives an empty text; repeated rows are extracted each; an unclosed element ends with the one
around it or with the page, a choice list also with the next block; an empty table gives an empty result; a page of any length is
read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlens.llm.common import text_slices

SLICE_BYTES = 1 << 20
WINDOW = 3
SURGE = 86  # fixed value: the published height of a surge

_TAG = regex.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", regex.S)
_ATTRIBUTE = regex.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = regex.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+|[^\sA-Za-z0-9]|\s+")

#: Names of HTML elements and roles, and words that sites use for what surrounds an article.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe"}
SKIPPED = {"svg", "math", "canvas", "object", "video", "audio", "select", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
BESIDE = {"nav", "footer", "menu", "head"}
WITHIN = {"aside", "button", "dialog"}
FORMS = {"form", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "footer", "gdpr", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "pager", "popup", "promo", "promotion", "recommended", "related", "sharing",
    "share", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "alert", "announcement", "paywall", "privacy", "teaser",
}
COMMENTS = {"comment", "comments", "disqus", "respond", "replies"}
HEADS = {"header", "masthead", "banner", "topbar"}
OF_ARTICLE = {"article", "entry", "post", "story"}  # a header so named holds the headline
STARTS = ("advert", "breadcrumb", "cookie", "newsletter", "sidebar", "sponsor", "subscri")
LAYOUT = {"has", "with", "no", "without", "hide", "show"}  # before such a word: says how a page is laid out
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
ARTICLES = {"article", "main"}
ENDS_PARAGRAPH = {"p", "div", "ul", "ol", "table", "section", "article", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "form", "nav", "aside", "footer", "header", "main", "hr", "figure", "address", "dl", "fieldset"}


@dataclass
class Mark:
    """An element that is named like something around the text. gap: the empty lines it leaves."""

    kind: str  # beside, within, form, words, heads, comments
    gap: int
    holds: bool = False  # an article, a main element or a headline


@dataclass
class Line:
    text: str
    links: int  # characters of its links' text
    tag: str
    article: bool
    main: bool
    marks: tuple[Mark, ...]
    gap: bool = False  # stands for a mark's empty lines


def _named(value: str) -> set[str]:
    """The words of a class or id, but for those that tell of the layout (has-sidebar)."""
    out, before = set(), ""
    for word in _NAME.findall(value):
        low = word.lower()
        if low[0].isalpha():
            if before not in LAYOUT:
                out.add(low)
            before = low
        elif low[0].isspace():
            before = ""
    return out


def _mark(tag: str, text: str, in_article: bool, window: int) -> Mark | None:
    """What an element is by its name, if not text."""
    if tag in BESIDE:
        return Mark("beside", window)
    if tag in WITHIN:
        return Mark("within", 1)
    attributes = [(name.lower(), a or b or c) for name, a, b, c in _ATTRIBUTE.findall(text)] if text and not text.isspace() else []
    of_article = in_article or any(_named(v) & OF_ARTICLE for n, v in attributes if n in ("class", "id"))
    if tag == "header" and not of_article:
        return Mark("heads", window)
    if tag in ("html", "body"):
        return None
    words: set[str] = set()
    for name, value in attributes:
        if name == "role" and value.lower() in ROLES:
            return Mark("beside", window) if value.lower() in ("navigation", "banner", "contentinfo") else Mark("within", 1)
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and regex.search(r"display\s*:\s*none", value):
            return Mark("within", 0)
        if name in ("class", "id"):
            words |= _named(value)
    if tag in ARTICLES and "article" in words:
        words -= COMMENTS  # an article about or open to comments
    elif words & COMMENTS or any(w.startswith("comment") and not w.startswith(("commentar", "commentat")) for w in words):
        return Mark("comments", window)
    if tag not in ARTICLES and words & HEADS and not of_article:
        return Mark("heads", window)
    if words & WORDS or any(w.startswith(STARTS) for w in words):
        return Mark("words", window if words & {"nav", "navbar", "menu", "navigation", "sidebar", "footer"} else 0)
    return Mark("form", 1) if tag in FORMS else None


def page_lines(html: str, window: int = WINDOW) -> list[Line]:
    """Lines of a page in order, whatever they belong to."""
    lines: list[Line] = []
    parts: list[str] = []
    stack: list[str] = []  # open elements
    marked: list[tuple[int, Mark]] = []  # depth and mark of open elements
    articles: list[tuple[int, str]] = []  # depth and tag of open article and main elements
    links = link_depth = 0
    skip_at: int | None = None  # depth of the skipped element that is open
    at = 0

    def close_block() -> None:
        nonlocal links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                block = next((t for t in reversed(stack) if t not in INLINE), "")
                lines.append(Line(text, links, block, any(t == "article" for _, t in articles), any(t == "main" for _, t in articles), tuple(m for _, m in marked)))
            parts.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if skip_at is None and text:
            parts.append(text)
            if link_depth:
                links += len(" ".join(unescape(text).split()))

    def pop_to(depth: int) -> None:
        nonlocal skip_at, link_depth
        for tag in stack[depth:]:
            link_depth -= tag == "a"
        del stack[depth:]
        if skip_at is not None and depth <= skip_at:
            skip_at = None
        while articles and depth <= articles[-1][0]:
            articles.pop()
        while marked and depth <= marked[-1][0]:
            marked.pop()

    def last(tag: str) -> int:
        return len(stack) - 1 - stack[::-1].index(tag)

    while m := _TAG.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), (m[3] or m[6] or "")
        if closing:
            if tag in stack:
                depth = last(tag)
                guard = skip_at if skip_at is not None else marked[-1][0] if marked else -1
                if depth < guard and tag in INLINE | {"p", "li"}:
                    continue  # a stray end tag does not end a named element around it
                if tag not in INLINE and skip_at is None:
                    close_block()
                pop_to(depth)
            elif tag not in INLINE and skip_at is None:
                close_block()
            continue
        if tag in RAW:
            end = regex.compile(rf"</{regex.escape(tag)}\s*>", regex.I).search(html, at)
            if not attributes.rstrip().endswith("/"):
                at = end.end() if end else len(html)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr" and skip_at is None:
                close_block()
            continue
        if tag in ENDS_PARAGRAPH and skip_at is not None and stack[skip_at] == "select":
            pop_to(skip_at)
        if tag in ENDS_PARAGRAPH and "p" in stack and (skip_at is None or last("p") >= skip_at):
            depth = last("p")
            if skip_at is None:
                close_block()
            pop_to(depth)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1] == tag:
            if skip_at is None:
                close_block()
            pop_to(len(stack) - 1)
        if skip_at is None:
            inline = tag in INLINE
            mark = _mark(tag, attributes, bool(articles), window) if tag != "a" and (attributes or not inline) else None
            if not inline:
                close_block()
            if mark is not None and inline or tag in SKIPPED:
                skip_at = len(stack)
            elif mark is not None:
                marked.append((len(stack), mark))
                lines += [Line("", 0, tag, False, False, (mark,), True)] * mark.gap
            if (tag in ARTICLES or tag == "h1") and not (mark and mark.kind == "comments"):
                for _, around in marked:
                    around.holds |= tag != "h1" or around.kind != "heads"
            if tag in ARTICLES:
                articles.append((len(stack), tag))
        stack.append(tag)
        link_depth += tag == "a"
    add(html[at:])
    close_block()
    return lines


def weight(line: Line) -> int:
    """Characters of a line that are not its links'; a paragraph counts half its length at least."""
    plain = max(0, len(line.text) - line.links)
    if line.tag in PARAGRAPHS:
        return max(plain, (len(line.text) + 1) // 2)
    return plain if plain >= line.links else 0


def _wraps(lines: list[Line]) -> set[int]:
    """Marks (by identity) of elements that wrap the text instead of standing around it."""
    marks: dict[int, Mark] = {}
    sizes: dict[int, int] = {}
    total = 0
    for line in lines:
        n = weight(line)
        total += n
        for mark in line.marks:
            marks[id(mark)] = mark
            sizes[id(mark)] = sizes.get(id(mark), 0) + n
    may = {i for i, m in marks.items() if m.kind in ("form", "words", "heads")}
    least = 2 / 3 if any(line.article or line.main for line in lines if not line.marks) else 1 / 2
    return {i for i in may if marks[i].holds or marks[i].kind != "heads" and sizes[i] > least * total}


def runs_of(weights: np.ndarray, window: int, surge: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """From each rise to its dive (exclusive), where a whole window is 0 again, if there is a surge between. joined: for each line whether it leaves runs around it joined."""
    if not len(weights):
        return []
    sums = np.convolve(weights, np.ones(window, np.int64))[window - 1 :]  # of lines i to i + window - 1
    least = min(surge, int(sums.max()))
    live = np.concatenate([[False], sums > 0, [False]])
    edges = np.flatnonzero(live[1:] != live[:-1]).reshape(-1, 2)
    rises = [s + int(np.flatnonzero(weights[s:])[0]) for s, _ in edges]  # windows reach the first weight before it
    runs, high = [(rise, int(e)) for rise, (_, e) in zip(rises, edges)], [sums[s:e].max() >= least for s, e in edges]
    if joined is not None:
        near = [joined[before[1] : after[0]].all() for before, after in zip(runs, runs[1:])]
        for i in [*range(1, len(runs)), *range(len(runs) - 2, -1, -1)]:  # forwards, then backwards
            other = i - 1 if i and high[i - 1] and near[i - 1] else i + 1 if i + 1 < len(runs) and high[i + 1] and near[i] else None
            high[i] = high[i] or other is not None and bool(joined[runs[i][0] : runs[i][1]].any())
    return [run for run, kept in zip(runs, high) if kept]


def extract_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of a page.

    >>> extract_text("<nav><a>Home</a></nav><article><h1>A</h1><p>b &amp; c<p>d</article><footer>x</footer>")
    'A\\n\\nb & c\\n\\nd'
    """
    lines = page_lines(html or "", window)
    if any(line.marks for line in lines):
        wraps = _wraps(lines)
        lines = [line for line in lines if line.gap and id(line.marks[0]) not in wraps or not line.gap and all(id(m) in wraps for m in line.marks)]
    own = np.array([weight(line) for line in lines], np.int64)
    inside = np.ones(len(lines), bool)
    for region in (np.array([line.article for line in lines], bool), np.array([line.main for line in lines], bool)):
        if own.any() and 2 * own[region].sum() >= own.sum():
            inside, surge = region, 1
            own = np.array([len(line.text) for line in lines], np.int64)
            break
    own = np.where(inside, own, 0)
    joined = np.array([line.gap or line.tag in PARAGRAPHS and n > 0 for line, n in zip(lines, own.tolist())], bool)
    return "\n\n".join(lines[i].text for s, e in runs_of(own, window, surge, joined) for i in range(s, e) if inside[i] and lines[i].text)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text and n_chars (its code points) for each page."""
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pages_html in text_slices(batch, "_html", SLICE_BYTES):
                texts = [extract_text(h.decode()) for h in pages_html.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"]
                )

    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    return rows.mapInArrow(each, f"`{id_col}` {fields[id_col]}, `{url_col}` {fields[url_col]}, text string, n_chars long")
