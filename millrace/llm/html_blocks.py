"""Main text of web pages by line-block distribution.

Markup is stripped so that each block-level element is one line. A line weighs
its text's length; lines of boilerplate (menus, notices, forms and so on, by
element, role or class; links only; outside the page's article) weigh nothing, and
lines of an article several times their length.
The weights are summed over a sliding window of lines. The sum surges where text
begins and dives where a whole window is empty. The text between a surge and the
next dive is kept, and what lies between two such stretches or in the same
article as one.

The sum alone can't tell a long reader comment or advert from prose, nor keep a
one-word paragraph, so the weights take the element and its class into account.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import field, sliced

#: Lines in a window, the sum at which text surges, and what an article's lines weigh for each character.
WINDOW, SURGE, INSIDE = 3, 80, 4

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Their content is not markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr".split())
DROPPED = set("head script style noscript template svg math nav footer aside form button select textarea iframe object canvas audio video dialog menu title noframes noembed xmp".split())
#: Words in a class, id or role that mark boilerplate, and ones that mark content in spite of them.
BOILERPLATE = re.compile(
    r"(ad|ads|adv|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|sidebar|sidenav|side|complementary|menu|menubar|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended|recommendations|comments?|commentlist|commentform|reply|replies|disqus|respond|footer|contentinfo|header|masthead|widgets?|pagination|pager|toolbar|form)"
)
CONTENT = re.compile(r"(article|post|entry|content|main|story|body)")
MAIN_WORDS = re.compile(r"(article|main)")


def _matches(tokens: list[re.Match]) -> tuple[list[int], list[int]]:
    """For each start tag the index of its end tag, and of the first token after the element; -1 if it is never closed.

    A p ends at the next p as well.
    """
    ends, after, stacks = [-1] * len(tokens), [-1] * len(tokens), {}
    for i, token in enumerate(tokens):
        if not (name := token[2]):
            continue
        name = name.lower()
        stack = stacks.setdefault(name, [])
        if token[1]:
            if stack:
                ends[k := stack.pop()] = i
                after[k] = i + 1
        elif name not in VOID:
            if name == "p" and stack:
                after[stack.pop()] = i
            stack.append(i)
    return ends, after


def _tokens(html: str) -> list[re.Match]:
    """Tags and comments in order, none from within scripts and other raw text."""
    out, at = [], 0
    while token := TOKEN.search(html, at):
        out.append(token)
        at = token.end()
        if token[2] and not token[1] and (name := token[2].lower()) in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            at = close.start() if close else len(html)
    return out


def _words(attributes: str) -> tuple[list[str], bool]:
    """The words of class, id and role, and whether the element is hidden."""
    words, hidden = [], False
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true" or name.lower() == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif name.lower() in ("class", "id", "role"):
            words += re.split(r"[\s_-]+", value)
    return words, hidden


def lines(html: str) -> list[tuple[str, int, bool]]:
    """(text, article, only links) of each line; article numbers the outermost article it is in, 0 for none, -1 for boilerplate."""
    tokens = _tokens(html)
    ends, after = _matches(tokens)
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = plain = 0
    at = i = article = articles = main = 0
    article_end = main_end = link_end = -1

    def close() -> None:
        nonlocal linked, plain
        if parts and (text := " ".join(unescape("".join(parts)).split())):
            out.append((text, article or main, linked > 0 and plain == 0))
        parts.clear()
        linked = plain = 0

    def add(text: str) -> None:
        nonlocal linked, plain
        if text:
            parts.append(text)
            n = len(text.strip())
            if i <= link_end:
                linked += n
            else:
                plain += n

    while i < len(tokens):
        token = tokens[i]
        add(html[at : token.start()])
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            i += 1
            continue
        if name not in INLINE:
            close()
        elif name in ("br", "td", "th"):
            parts.append(" ")
        if token[1]:
            if i == article_end:
                article, article_end = 0, -1
            if i == main_end:
                main, main_end = 0, -1
            i += 1
            continue
        words, hidden = _words(token[3]) if token[3] else ((), False)
        boilerplate = name in DROPPED or name == "header" and not article or hidden
        if not boilerplate and words and name not in ("html", "body", "article", "main"):
            boilerplate = any(map(BOILERPLATE.fullmatch, words)) and not any(map(CONTENT.fullmatch, words))
        if boilerplate:
            close()
            out += [("", -1, False)] * WINDOW
            if name not in VOID:
                stop = after[i]
                if stop < 0:  # never closed: it reaches to the next article
                    stop = next((k for k in range(i + 1, len(tokens)) if not tokens[k][1] and (tokens[k][2] or "").lower() in ("article", "main", "body")), len(tokens))
                closed = ends[i] >= 0
                at = tokens[stop - 1].end() if closed else tokens[stop].start() if stop < len(tokens) else len(html)
                i = stop
            else:
                i += 1
            continue
        if name == "a":
            link_end = ends[i]
        if not article and (name == "article" or "article" in words):
            articles += 1
            article, article_end = 2 * articles, ends[i]
        elif not main and (name == "main" or "main" in words):
            main, main_end = 1, ends[i]
        i += 1
    add(html[at:])
    close()
    return out


def main_text(html: str | None) -> str:
    """The text of a page's article, its blocks joined by line feeds; empty for null, empty or textless pages."""
    if not html:
        return ""
    found = lines(html)
    sums: dict[int, int] = {}
    for text, article, _ in found:
        sums[article] = sums.get(article, 0) + len(text)
    inside = max((a for a in sums if a > 1), key=lambda a: (sums[a], -a), default=1 if sums.get(1) else 0)
    weights = [len(text) * (INSIDE if inside else 1) if article == inside and (inside or not only_links) else 0 for text, article, only_links in found]
    stretches = surges(weights)
    if not stretches:
        return ""
    first, end = (0, len(found)) if inside else (stretches[0][0], stretches[-1][1])
    surged = {k for a, b in stretches for k in range(a, b)}
    return "\n".join(found[k][0] for k in range(first, end) if found[k][0] and found[k][1] == inside and (weights[k] or k in surged))


def surges(weights: list[int]) -> list[tuple[int, int]]:
    """The stretches (first line, last + 1) from a surge of the window sums to the next dive.

    A dive is a window without weight. Light lines right before a surge, as
    headings, belong to it. Where no sum surges the greatest one counts as one.
    """
    padded = [*weights, *[0] * (WINDOW - 1)]
    window = [sum(padded[i : i + WINDOW]) for i in range(len(weights))]
    least = min(SURGE, max(window, default=0)) or 1
    out, begin = [], None
    for i, total in enumerate([*window, 0]):
        if total >= least and begin is None:
            begin = i
            while begin and weights[begin - 1]:
                begin -= 1
        elif not total and begin is not None:
            filled = [k for k in range(begin, i) if weights[k]]
            out.append((filled[0], filled[-1] + 1))
            begin = None
    return out


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, kept columns, text) of every page, from its whole html.

    One row for each row, repeated rows and null ids included. A null or empty
    page, or one without text, has an empty text. Columns that aren't named are
    ignored. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [main_text(html) for html in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "text"])

    columns = [id_col, *keep]
    schema = T.StructType([*(field(pages, c) for c in columns), T.StructField("text", T.StringType())])
    return pages.select(html_col, *columns).mapInArrow(run, schema)
