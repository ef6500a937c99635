"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one line a block: block tags end a line, inline tags
do not.  The lengths of the lines' running text, without that inside links, are
summed over sliding windows; the text surges where a window's sum rises over the
threshold and dives where it falls back, and the lines between are kept.

The threshold is SURGE, or half of the page's largest sum where that is less, so short
pages are read by the same rule.  The strip uses what the markup states as weights and
borders of lines: those in navigation, headers, footers, sidebars, forms, adverts and
comments weigh nothing, also articles inside articles, which hold readers' words; scripts and
styles never become lines.  Where articles bound the text, each is a run of lines of its own,
lines outside weigh nothing, and a surge goes on both ways to where a whole window has no running
text.  Articles bound it where the only one surges by its lengths alone, or where all hold no less
running text than the rest; beside a longer story outside, such as teasers, they are lines like
others.  Elsewhere short lines outside paragraphs and headings weigh nothing, and a surge
goes on over the paragraphs and headings beside it in its container.  Class names, ids and roles mark
containers by whole names; such a mark does not hold where its container encloses the article
or most of the running text.

Defined results: a null or empty page, and one without text, give an empty string;
unclosed tags end with their container; a page cut in the middle keeps what
it has, without an unfinished tag; repeated rows are extracted each; pages of any length
are read whole; an empty table gives no row; columns named text and n_chars are replaced,
all others (null or not) pass through.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines of a window, and the characters of running text it must exceed.
WINDOW, SURGE = 3, 86
#: Lines of less weight do not begin or end a surge.
SHORT = 12

# HTML's raw-text, void and block elements.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select", "title", "head", "canvas", "audio", "video", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
TITLE = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks of running text.
TEXT = TITLE | {"p", "blockquote", "pre"}
#: Containers that hold no running text of the article.
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
#: Class names, ids and roles that mark such containers, whole and with one affix.
MARKED = {
    "ad", "ads", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "discussion", "disqus",
    "footer", "gdpr", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "replies", "reply", "respond", "reviews", "search", "share",
    "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget",
}
#: Among them those of readers' words, which may be longer than the article.
READERS = {"comment", "comments", "discussion", "disqus", "replies", "reply", "respond", "reviews"}
#: What may stand before or after such a name.
AFFIX = {"area", "bar", "block", "body", "bottom", "box", "container", "form", "global", "inner", "left", "links", "list", "right", "section", "site", "slot", "thread", "top", "user", "wrap", "wrapper"}
#: Kinds of marks: of those by name and by readers' words, wrappers of the page are let go.
FIRM, BY_READERS, BY_NAME = 1, 2, 3

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|![^>]*(?:>|\Z)|\?[^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A) for name in RAW}
_PART = re.compile(r"[-_\d]+")
_SPACE = re.compile(r"\s+")


def _name(value: str) -> str | None:
    """The listed name that a class name, id or role is, alone or with affixes."""
    if value in MARKED:
        return value
    parts = [x for x in _PART.split(value) if x]
    listed = [x for x in parts if x in MARKED]
    return listed[0] if listed and all(x in MARKED or x in AFFIX for x in parts) else None


def _marked(attributes: str) -> int:
    """0 without a mark, or FIRM, BY_READERS, BY_NAME."""
    found = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
            return FIRM
        if name in ("class", "id", "role"):
            for x in map(_name, value.split()):
                if x:
                    found = BY_READERS if x in READERS or found == BY_READERS else BY_NAME
    return found


def _let_go(lines: list[tuple], kinds: list[int]) -> set[int]:
    """Marks that do not hold: their containers enclose the article or most of the running text.

    ``lines`` are (text, loose, marks around it, article, marks around that, ...), marks as places in ``kinds``.
    """
    gone: set[int] = set()
    soft = {BY_NAME}
    while any(k in soft for k in kinds):
        free = free_article = 0
        whole: dict[int, int] = {}
        articles: dict[int, int] = {}
        for _, loose, marks, article, within, *_ in lines:
            held = [m for m in marks if m not in gone]
            if not held:
                free += loose
                free_article += loose if article else 0
            elif all(kinds[m] in soft for m in held):
                whole[held[0]] = whole.get(held[0], 0) + loose
                if article and marks.index(held[0]) < within:
                    articles[held[0]] = articles.get(held[0], 0) + loose
        total = free + sum(whole.values())
        found = [m for m, n in articles.items() if n > free]
        if not found and not free_article:
            found = [m for m, n in whole.items() if n > SURGE and 2 * n > total]
        if found:
            gone.add(max(found, key=lambda m: whole[m]))
        elif BY_READERS not in soft and total <= SURGE:  # nothing but readers' words
            soft = {BY_NAME, BY_READERS}
        else:
            break
    return gone


def lines_of(html: str) -> list[tuple[str, int, bool, int, int]]:
    """(text, characters outside links, inside an aside container, number of the outermost article or 0, container or 0) of each line.

    The container is the number of the element around a paragraph or heading; other lines have 0.
    """
    out: list[tuple[str, int, tuple[int, ...], int, int, int]] = []
    parts: list[str] = []
    loose = at = 0
    #: Open elements: name, is an aside container, is an article, number.
    stack: list[tuple[str, bool, bool, int]] = []
    #: Kinds of all marks, those that are open, and how many were when the article began.
    kinds: list[int] = []
    marks: list[int] = []
    article = links = titles = articles = within = elements = nested = 0

    def container() -> int:
        k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK), -1)
        if k < 0 or stack[k][0] not in TEXT:
            return 0
        return stack[k - 1][3] if k else 1

    def end_line():
        nonlocal parts, loose
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append((text, loose, tuple(marks), articles if article else 0, within, container()))
        parts, loose = [], 0

    def text(piece: str):
        nonlocal loose
        if piece:
            parts.append(piece)
            if not links or article and titles:  # an article's title may link to itself
                loose += len(piece)

    def close(n: int):
        """Closes open elements until ``n`` are left."""
        nonlocal article, links, titles, nested
        while len(stack) > n:
            name, is_aside, is_article, _ = stack.pop()
            nested -= name == "article"
            article, links = article - is_article, links - (name == "a")
            if is_aside:
                marks.pop()
            titles -= name in TITLE

    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            break
        tag = _TAG.match(html, start)
        if not tag:  # a sign, not markup
            text(html[at : start + 1])
            at = start + 1
            continue
        text(html[at:start])
        at = tag.end()
        if tag[2] is None or not tag[4] and at >= len(html):
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        if name in BLOCK:
            end_line()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name in RAW and not tag[3].endswith("/"):
            if name != "head":
                stop = _END[name].search(html, at)
                if not stop:
                    break
                at = html.find(">", stop.start()) + 1 or len(html)
            continue
        if name in VOID or tag[3].endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "option"):  # a sibling ends its like
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        is_article = name in ("article", "main")
        if is_article and not article:
            articles, within = articles + 1, len(marks)
        kind = 0
        if not (name == "header" and article):
            if name in ASIDE and name != "form":
                kind = FIRM
            elif name not in ("html", "body", "main"):
                kind = _marked(tag[3]) or (BY_NAME if name == "form" else BY_NAME if name == "article" and nested else 0)
        elements += 1
        nested += name == "article"
        stack.append((name, kind > 0, is_article, elements + 1))
        if kind:
            kinds.append(kind)
            marks.append(len(kinds) - 1)
        article, links = article + is_article, links + (name == "a")
        titles += name in TITLE
    end_line()
    gone = _let_go(out, kinds)
    return [(text, loose, not gone.issuperset(held), k, c) for text, loose, held, k, _, c in out]


def sums_of(lengths: list[int]) -> list[int]:
    """The sum of the window around each line."""
    return [sum(lengths[max(0, i - WINDOW // 2) : i + WINDOW // 2 + 1]) for i in range(len(lengths))]


def spans_of(lengths: list[int], surge: float = SURGE, short: int = SHORT) -> list[tuple[int, int]]:
    """(surge, dive) line ranges: neighbouring windows over the threshold, without short lines at the ends."""
    n, sums = len(lengths), sums_of(lengths)
    out, i = [], 0
    while i < n:
        if sums[i] <= surge:
            i += 1
            continue
        j = i
        while j < n and sums[j] > surge:
            j += 1
        a, b = i, j
        while a < b and lengths[a] < short:
            a += 1
        while b > a and lengths[b - 1] < short:
            b -= 1
        if a < b:
            out.append((a, b))
        i = j
    return out


def _bounded(running: list[int], articles: list[int]) -> bool:
    """Whether the text lies in articles (numbers by line, 0 outside)."""
    inside = [w if k else 0 for w, k in zip(running, articles)]
    if len({k for w, k in zip(inside, articles) if w}) == 1 and spans_of(inside):
        return True
    return 0 < sum(inside) >= sum(running) - sum(inside)


def _threshold(runs: list[list[int]]) -> tuple[float, int]:
    """What a window of any run has to exceed, and the least weight of lines at the ends of a surge."""
    most = max((x for r in runs for x in sums_of(r)), default=0)
    return min(SURGE, most / 2), min(SHORT, max((x for r in runs for x in r), default=0))


def _in_articles(lines: list[tuple], running: list[int]) -> list[int]:
    """Kept lines where articles bound the text: surges of each article, until a window has no running text."""
    runs: dict[int, list[int]] = {}
    for i, (_, _, aside, article, _) in enumerate(lines):
        if article and not aside:
            runs.setdefault(article, []).append(i)
    weights = {k: [running[i] for i in run] for k, run in runs.items()}
    surge, short = _threshold(list(weights.values()))
    kept = []
    for k, run in runs.items():
        sums, at = sums_of(weights[k]), 0
        for a, b in spans_of(weights[k], surge, short):
            while a > at and sums[a - 1] > 0:
                a -= 1
            a = max(a, at)
            while b < len(run) and sums[b] > 0:
                b += 1
            # Lines that are links alone stay in paragraphs and between others, not at the ends.
            alone = [not w and not lines[i][4] for w, i in zip(weights[k], run)]
            while a < b and alone[a]:
                a += 1
            while b > a and alone[b - 1]:
                b -= 1
            kept += run[a:b]
            at = max(at, b)
    return sorted(kept)


def _in_lines(lines: list[tuple], running: list[int]) -> list[int]:
    """Kept lines of a page that no article bounds."""
    weights = [w if c or w >= SHORT else 0 for w, (*_, c) in zip(running, lines)]
    kept: set[int] = set()
    for a, b in spans_of(weights, *_threshold([weights])):
        own = [i for i in range(a, b) if running[i]]
        for edge, step in ((own[0], -1), (own[-1], 1)):
            i = edge + step
            while lines[edge][4] and 0 <= i < len(lines) and (lines[i][2] or running[i] and lines[i][4] == lines[edge][4]):
                if not lines[i][2]:
                    own.append(i)
                i += step
        kept.update(own)
    return sorted(kept)


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by one space."""
    lines = lines_of(html or "")
    running = [0 if aside else loose for _, loose, aside, *_ in lines]
    choose = _in_articles if _bounded(running, [k for *_, k, _ in lines]) else _in_lines
    return " ".join(lines[i][0] for i in choose(lines, running))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with text and n_chars; columns of these names are replaced."""
    pages = pages.drop("text", "n_chars")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), "text string, n_chars long"])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [main_text(h) for h in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], [*part.schema.names, "text", "n_chars"])

    return pages.mapInArrow(run, schema)
