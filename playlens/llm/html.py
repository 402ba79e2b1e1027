"""Main text of web pages by line-block distribution.

Markup is stripped so that each block of text is one line. The text lengths of
sliding windows of lines rise where the article begins (surge) and fall to nothing where it
ends (dive); what lies between is kept. Elements that never belong to an article, and
lines that are mostly links, count as empty lines, as many as a window is long, so the
distribution falls to zero there. An advert or the like between two lines of one container is no
end: the lines around it stay together. Where an element marks the article (<article>, <main>),
that decides instead of the distribution: whatever lies outside of it counts as empty, and any text
inside it is a surge.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 3
#: Characters that a window needs where no element marks the article, unless no window of the page has so many.
SURGE = 80
#: Share of link text from which a line counts as empty.
LINKED = 0.5
#: Share of a page's text from which an element is no aside, whatever its name (but for those in ALWAYS).
MOST = 0.5

# Fixed values of HTML.
RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("head nav header footer aside form menu button dialog".split())
ARTICLE = frozenset("article main".split())
CONTAINER = frozenset("html body div section article main td li dd figure blockquote center".split())
BLOCK_START = frozenset("article main section h1 h2 h3 h4 h5 h6 p div ul ol table nav header footer aside body".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
    "disqus disclaimer footer menu nav navbar navigation newsletter notice popup promo promoted related respond share "
    "sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo".split())
#: Of these, what may well be longer than the article.
ALWAYS = frozenset("comment comments disqus respond footer contentinfo menu nav navbar navigation cookie cookies".split())
#: In a compound name these say that the element has or lacks something, not that it is it.
ABOUT = frozenset("has have no non not with without free less is hide hidden show enable enabled disable disabled".split())


@dataclass(slots=True)
class Tag:
    """A tag, or (name "") a stretch that is no text: a comment, a declaration, an element with raw content."""

    start: int
    end: int
    name: str
    closes: bool
    attributes: str


def tags(page: str) -> Iterator[Tag]:
    """All tags, by one pass over the page. Each step moves on, and a failed look to the end happens once.

    A quote that is never closed is taken for a plain character from then on; a tag that is never closed
    ends with the page.
    """
    pattern, at = TAG, page.find("<")
    while at >= 0:
        following = page[at + 1:at + 2]
        if following in ("!", "?"):
            close = "-->" if page.startswith("<!--", at) else ">"
            end = page.find(close, at + 4 if close == "-->" else at + 2)
            end = len(page) if end < 0 else end + len(close)
            yield Tag(at, end, "", False, "")
        elif not (following.isascii() and following.isalpha()) and not (following == "/" and page[at + 2:at + 3].isalpha()):
            end = at + 1  # a plain character
        else:
            found = pattern.match(page, at)
            if found is None and pattern is TAG:
                pattern = LOOSE
                found = pattern.match(page, at)
            if found is None:
                end = at + 1
                if page.find(">", at) < 0:
                    yield Tag(at, len(page), "", False, "")
                    return
            else:
                end, name = found.end(), found[2].lower()
                if name in RAW and not found[1]:
                    close = RAW_END[name].search(page, end)
                    stop = page.find(">", close.start()) if close else -1
                    end = len(page) if stop < 0 else stop + 1
                    yield Tag(at, end, "", False, "")
                elif name not in RAW:
                    yield Tag(at, end, name, bool(found[1]), found[3])
                else:
                    yield Tag(at, end, "", False, "")
        at = page.find("<", end)


@functools.lru_cache(maxsize=10_000)
def _names(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role name an aside, and whether one that is always an aside."""
    aside = always = False
    if "=" in attributes:
        for groups in NAMED.findall(attributes):
            for token in "".join(groups).lower().split():
                parts = frozenset(re.split(r"[^a-z0-9]+", token))
                if token in NAMES or not NAMES.isdisjoint(parts) and ABOUT.isdisjoint(parts):
                    aside = True
                    always |= not ALWAYS.isdisjoint(parts)
    return aside, always


class Page:
    """The tags of a page, what belongs together, and how much text lies in between."""

    def __init__(self, page: str):
        self.page, self.tags = page, list(tags(page))
        self.closing: dict[int, int] = {}
        stacks: dict[str, list[int]] = {}
        before, at = [0], 0  # visible characters in front of each tag
        for i, tag in enumerate(self.tags):
            text = page[at:tag.start]
            before.append(before[-1] + len(text) - text.count(" "))
            at = tag.end
            if tag.name and not tag.closes:
                stacks.setdefault(tag.name, []).append(i)
            elif tag.name and stacks.get(tag.name):
                self.closing[stacks[tag.name].pop()] = i
        rest = page[at:]
        self.before = [*before[1:], before[-1] + len(rest) - rest.count(" ")]
        #: The elements that mark the article, those in comments and the like apart, and the longest of them.
        self.marks, hidden = [], 0
        for i, tag in enumerate(self.tags):
            if tag.closes or not tag.name:
                continue
            if i in self.closing and (tag.name in ASIDE or tag.name not in ARTICLE and _names(tag.attributes)[1]):
                hidden = max(hidden, self.closing[i])
            elif tag.name in ARTICLE and i >= hidden:
                self.marks.append(i)
        mains = [i for i in self.marks if self.tags[i].name == "main"]
        self.anchor = max(mains or self.marks, key=lambda i: (self.chars(i), -i), default=None)

    def end(self, i: int) -> int:
        """The tag that closes element i; without one, the end of the page."""
        return self.closing.get(i, len(self.tags))

    def chars(self, i: int) -> int:
        return self.before[self.end(i)] - self.before[i]

    def foreign(self, i: int, depth: int) -> bool:
        """Whether an element is no part of an article. The header of an article is."""
        tag = self.tags[i]
        if tag.name in ASIDE:
            return not (tag.name == "header" and depth)
        if tag.name in VOID | INLINE | ARTICLE or tag.name in ("html", "body"):
            return False
        aside, always = _names(tag.attributes)
        if not aside:
            return False
        if i in self.closing and self.anchor is not None and i < self.anchor < self.end(i):
            return False  # a wrapper of the article
        if i not in self.closing or always:
            return True
        return self.chars(i) <= MOST * self.before[-1]


def lines(page: str) -> tuple[list[str], list[int], bool]:
    """The page as lines, the text length of each that counts, and whether an element marks
    the article. Lines that don't count are empty or have length 0."""
    doc = Page(page)
    marked = bool(doc.marks)
    texts, sizes, places, parts = [], [], [], []  # places: the container of a line, or of a gap as (container,)
    containers: list[tuple[int, int]] = []  # (number of the tag that closes it, its own)
    chars = linked = depth = links = 0
    inside = not marked

    def end_line() -> None:
        nonlocal chars, linked
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            counts = inside and (marked or linked <= LINKED * chars)
            texts.append(text)
            sizes.append(len(text) if counts else 0)
            places.append(containers[-1][1] if containers else -1)
        chars = linked = 0

    def gap(within: bool) -> None:
        end_line()
        texts.append("")
        sizes.append(0)
        places.append((containers[-1][1] if containers else -1,) if within else ())

    at, i = 0, 0
    while i <= len(doc.tags):
        stop = doc.tags[i].start if i < len(doc.tags) else len(page)
        piece = page[at:stop]
        if piece:
            parts.append(piece)
            visible = len(piece) - piece.count(" ")
            chars += visible
            linked += visible if links else 0
        if i == len(doc.tags):
            break
        tag = doc.tags[i]
        while containers and containers[-1][0] <= i:
            end_line()
            containers.pop()
        at = tag.end
        if not tag.name:
            parts.append(" ")
        elif tag.name == "a":
            links = max(0, links + (-1 if tag.closes else 1))
        elif tag.name == "br":
            parts.append(" ")
        if tag.name and not tag.closes and doc.foreign(i, depth):
            gap(within=True)
            last = doc.closing.get(i)
            if last is None:  # never closed: it ends before the next block, or with the page
                last = i + 1
                while last < len(doc.tags) and not (doc.tags[last].name in BLOCK_START and not doc.tags[last].closes):
                    last += 1
                at = doc.tags[last].start if last < len(doc.tags) else len(page)
                i = last
            else:
                at, i = doc.tags[last].end, last + 1
            links = 0
            continue
        if marked and tag.name in ARTICLE:
            gap(within=False)
            depth = max(0, depth + (-1 if tag.closes else 1))
            inside = depth > 0
        elif tag.name and tag.name not in INLINE:
            end_line()
        if tag.name in CONTAINER and not tag.closes:
            containers.append((doc.end(i), i))
        i += 1
    end_line()
    return *_with_gaps(texts, sizes, places), marked


def _with_gaps(texts: list[str], sizes: list[int], places: list) -> tuple[list[str], list[int]]:
    """Gaps as WINDOW empty lines; none for gaps that lie between two lines of their own container."""
    out_texts, out_sizes, i = [], [], 0
    while i < len(texts):
        if not isinstance(places[i], tuple):
            out_texts.append(texts[i])
            out_sizes.append(sizes[i])
            i += 1
            continue
        stop = i
        while stop < len(texts) and isinstance(places[stop], tuple):
            stop += 1
        around = {*places[i:stop], (places[i - 1],) if i else (), (places[stop],) if stop < len(texts) else ()}
        if len(around) > 1 or () in around:
            out_texts += [""] * WINDOW
            out_sizes += [0] * WINDOW
        i = stop
    return out_texts, out_sizes


def kept_lines(sizes: list[int], marked: bool) -> list[int]:
    """Positions of the lines between surge and dive.

    A run of windows with any text is kept if one of them reaches the surge: any text where the article is
    marked, else SURGE characters, or as many as the longest window of the page has.
    """
    if not any(sizes):
        return []
    sums = np.convolve(sizes, np.ones(WINDOW, int))[WINDOW - 1:]  # over lines i, i+1 .. i+WINDOW-1
    surge = 1 if marked else min(SURGE, int(sums.max()))
    kept, start, high = [], None, False
    for i, total in enumerate([*sums.tolist(), 0]):
        if total and start is None:
            start, high = i, False
        high |= total >= surge
        if not total and start is not None:
            if high:
                kept += [at for at in range(start, min(i, len(sizes))) if sizes[at]]
            start = None
    return kept


def main_text(page: str) -> str:
    """The article of one page; empty if there is none."""
    texts, sizes, marked = lines(page)
    return "\n".join(texts[at] for at in kept_lines(sizes, marked))


def extracted(page: Column) -> Column:
    """The main text of a page in HTML. Null, empty pages and pages without an article give an empty text.

    A page of any length is read whole, in time that grows with its length.
    """
    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py() or "") for p in pages], pa.string())

    return extract(page)


def digest(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of `pages`; repeated rows are extracted each, an empty table gives none."""
    return pages.select("page_id", "url", extracted(F.col("html")).alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("bigint")
    )
