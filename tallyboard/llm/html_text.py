"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element names of the HTML standard, and words of class and id names that mark page furniture.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("aside button dialog footer head menu nav object option select title".split())
FURNITURE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager "
    "pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social "
    "sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
DENIED = frozenset("has no non not with without".split())  # first in a name: the page has it or not, the element is something else
SOCIAL = frozenset("bar button buttons follow icon icons link links media menu nav network networks share sharing".split())
RAW_TAGS = frozenset("audio canvas iframe math noscript script style svg template textarea video".split())
OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-z][^\s/>]*+))", re.IGNORECASE)
QUOTE_OR_END = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"(?<![^\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
WINDOW = 3  # lines that a window sums
SURGE = 80  # characters in a window that make a surge


HARD, SOFT, COMMENTS = 3, 1, 2  # furniture by its element; by its name, or a form; reader comments by their name


@dataclass
class Line:
    text: str
    furniture: bool
    article: int  # number of the outermost article or main element around it, 0 outside
    linked: int  # characters of it that are links


def _named_furniture(name: str) -> int:
    """How one of the names of a class or id marks an element; 0 not at all."""
    words = [w.lower() for w in NAME_PARTS.findall(name)]
    if not words or words[0] in DENIED or words[-1] == "free":
        return 0
    found = 0
    for at, word in enumerate(words):
        last = at == len(words) - 1
        if word not in FURNITURE_WORDS or (word in ("widget", "widgets") and at and not last):
            continue
        if word == "social" and not last and words[at + 1] not in SOCIAL:
            continue
        found = max(found, COMMENTS if word in COMMENT_WORDS else SOFT)
    return found


def _furniture(tag: str, attrs: str, in_article: bool) -> int:
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article):
        return HARD
    found = SOFT if tag == "form" else 0
    if not attrs or tag in ("html", "body", "article", "main"):
        return found
    for name, *values in ATTRIBUTE.findall(attrs):
        value, name = "".join(values), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return HARD
        if name == "role" and value.lower() in FURNITURE_ROLES:
            found = max(found, SOFT if value.lower() == "form" else HARD)
        if name in ("class", "id"):
            found = max([found, *map(_named_furniture, value.split())])
    return found


class _Tags:
    """The markup of a page in order, in linear time: (start, end, closing, tag, attributes); no tag for what is skipped."""

    def __init__(self, page: str):
        self.page, self.last_end, self.open_quote = page, page.rfind(">"), 0

    def _end(self, at: int) -> int:
        """Where the tag ends whose name ends at `at`: the next > outside of quotes, or any where a quote stays open."""
        page, first = self.page, at
        while at >= self.open_quote:
            found = QUOTE_OR_END.search(page, at)
            if found and found[0] == ">":
                return found.end()
            at = page.find(found[0], found.end()) + 1 if found else 0
            if not at:  # no tag before this quote, the last one of its kind, or before the end need try again
                self.open_quote = found.end() if found else len(page) + 1
        return page.find(">", first) + 1

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        page, at = self.page, 0
        while found := OPENING.search(page, at):
            start = found.start()
            if found[0] == "<!--":
                at = (page.find("-->", found.end()) + 3) if page.find("-->", found.end()) >= 0 else len(page)
                yield start, at, False, "", ""
                continue
            if start > self.last_end:
                return
            tag = (found[2] or "").lower()
            at = self._end(found.end()) if tag else page.find(">", found.end()) + 1
            attrs = page[found.end() : at - 1]
            if tag in RAW_TAGS and not found[1]:
                if not (tag in ("svg", "math") and attrs.endswith("/")):
                    end = re.compile(rf"</{tag}\s*+>", re.IGNORECASE).search(page, at)
                    at = end.end() if end else len(page)
                tag = ""
            yield start, at, bool(found[1]), tag, attrs


class _Open:
    """The open elements of a page, and where those of each tag stand."""

    def __init__(self):
        self.items: list[tuple[str, int, bool, int]] = []  # tag, furniture, article, named element around it
        self.places: dict[str, list[int]] = {}

    def last(self, *tags: str) -> int:
        """Place of the innermost of these tags, -1 if none is open."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=-1)

    def push(self, tag: str, furniture: int, article: bool, around: int) -> None:
        self.places.setdefault(tag, []).append(len(self.items))
        self.items.append((tag, furniture, article, around))

    def pop(self) -> tuple[str, int, bool, int]:
        item = self.items.pop()
        self.places[item[0]].pop()
        return item


@dataclass
class _Named:
    """An element that its name, or being a form, marks as furniture."""

    around: int  # the next such element around it, 0 for none
    kind: int
    form: bool
    in_article: bool
    landmark: bool = False  # holds an article, a main element or a first heading
    chars: int = 0


def page_lines(page: str) -> list[Line]:
    """The blocks of a page in order, markup stripped, with what is known of the elements around them.

    Furniture inside a block is left out of its text. Names can mislead: where they leave hardly any text, elements that hold
    most of what they took are read as content, see `_content`.
    """
    blocks: list[tuple[list[tuple[str, int]], bool, int, int]] = []  # pieces by named element, hard furniture, article, linked
    opened, named = _Open(), [_Named(0, 0, False, False)]
    parts: list[tuple[str, int]] = []
    state = {"hard": 0, "article": 0, "links": 0, "articles": 0, "linked": 0, "named": 0, "dropped": 0}

    def read(text: str) -> None:
        if state["hard"]:
            state["dropped"] += not text.isspace()
            return
        parts.append((text, state["named"]))
        if state["links"]:
            state["linked"] += len(text)

    def flush() -> None:
        if any(not text.isspace() for text, _ in parts) or state["dropped"]:
            blocks.append((list(parts), state["dropped"] > 0, state["articles"] if state["article"] else 0, state["linked"]))
        parts.clear()
        state["linked"] = state["dropped"] = 0

    def close(upto: int) -> None:
        while len(opened.items) > upto:
            tag, furniture, article, around = opened.pop()
            state["hard"] -= furniture == HARD
            state["article"] -= article
            state["links"] -= tag == "a"
            state["named"] = around

    at = 0
    for start, end, closing, tag, attrs in _Tags(page):
        if start > at:
            read(page[at:start])
        at = end
        if not tag:
            continue
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            read("\n")
        if closing:
            if (place := opened.last(tag)) >= 0:
                close(place)
            continue
        if tag in BLOCK_TAGS:  # a paragraph ends where the next block begins
            place = opened.last("p", "li")
            if place >= 0 and (opened.items[place][0] == "p" or tag == "li") and opened.last("ul", "ol", "table", "div") < place:
                close(place)
        if tag == "body":
            close(0)
        if tag in VOID_TAGS or attrs.endswith("/"):
            continue
        article = tag in ("article", "main")
        state["articles"] += article and not state["article"]
        furniture = _furniture(tag, attrs, state["article"] > 0)
        opened.push(tag, furniture, article, state["named"])
        if article or tag == "h1":
            outer = state["named"]
            while outer and not named[outer].landmark:
                named[outer].landmark = True
                outer = named[outer].around
        if furniture in (SOFT, COMMENTS):
            named.append(_Named(state["named"], furniture, tag == "form", state["article"] > 0))
            state["named"] = len(named) - 1
        state["hard"] += furniture == HARD
        state["article"] += article
        state["links"] += tag == "a"
    read(page[at:])
    flush()
    content = _content(blocks, named)
    lines = []
    for pieces, dropped, number, linked in blocks:
        text = " ".join(html.unescape("".join(text for text, by in pieces if content[by])).split())
        if text:
            lines.append(Line(text, False, number, linked))
        elif dropped or any(not text.isspace() for text, _ in pieces):
            lines.append(Line("", True, number, 0))
    return lines


def _content(blocks: list[tuple[list[tuple[str, int]], bool, int, int]], named: list[_Named]) -> list[bool]:
    """Which of the named elements hold content; the first stands for the rest of the page.

    None does, as a rule. Where the rest, or the rest of its articles if there are any, has less than `SURGE` characters, an element
    that has three times as many and over half of the text of all named ones does. It must hold an article, a main element or a
    first heading, or, unless it is a form, stand in an article. Reader comments never count.
    """
    articles = any(number for *_, number, _ in blocks)
    for pieces, _, number, _ in blocks:
        for text, by in pieces:
            if by or number or not articles:
                named[by].chars += len(text.strip())
    rest, taken = named[0].chars, sum(element.chars for element in named[1:])
    for element in reversed(named[1:]):  # elements inside come after those around them
        if element.around:
            named[element.around].chars += element.chars
    content = [True]
    for element in named[1:]:
        may = element.kind == SOFT and (element.landmark or (element.in_article and not element.form))
        large = rest < SURGE <= element.chars and element.chars >= 3 * rest and 2 * element.chars > taken
        content.append(may and large and content[element.around])
    return content


def main_lines(lines: list[Line]) -> list[str]:
    """Lines between the surge and the dive of the text lengths summed over sliding windows.

    Furniture counts as length 0. A surge takes `SURGE` characters in a window, or a third of the highest window where that
    is less. On pages with article or main elements lines outside of them weigh nothing, unless no window inside reaches
    `SURGE` and one of the whole page has as much for each of its lines. Elsewhere lines that are mostly links weigh nothing.
    """
    length = np.array([0 if line.furniture else len(line.text) for line in lines], dtype=np.int64)
    if not length.any():
        return []
    inside = length * [line.article > 0 for line in lines]
    page = length * [2 * line.linked <= len(line.text) for line in lines]
    # windows ending at each line, and after the last
    in_articles, on_page = (np.convolve(x, np.ones(WINDOW, dtype=np.int64)) for x in (inside, page))
    whole = not inside.any() or (in_articles.max() < SURGE and on_page.max() >= WINDOW * SURGE)
    length, sums = (page, on_page) if whole else (inside, in_articles)
    level = min(SURGE, sums.max() / 3)
    kept: list[str] = []
    start = 0
    while start < len(length):
        if not length[start]:
            start += 1
            continue
        end = start  # from the surge on until a whole window is empty: the dive
        while end < len(length) and sums[end]:
            end += 1
        if sums[start : end + 1].max() >= level:
            kept += [line.text for line, n in zip(lines[start:end], length[start:end]) if n]
        start = end + 1
    return kept


def main_text(page: str | None) -> str:
    """Main text of one page, its blocks joined by line breaks; null and pages without text give an empty one."""
    return "\n".join(main_lines(page_lines(page))) if isinstance(page, str) and page else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """`pages` with `text` and `n_chars`; columns of these names are replaced, all others stay. Every row gives a row."""

    @F.pandas_udf("string")
    def texts(found: pd.Series) -> pd.Series:
        return found.map(main_text)

    kept = [c for c in pages.columns if c not in ("text", "n_chars") or c == column]
    return pages.select(*kept, texts(F.col(column)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
