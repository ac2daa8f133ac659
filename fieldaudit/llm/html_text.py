"""Main text of web pages: flat text blocks, classified by a decision tree (operator 9).

A page is cut into blocks at its block-level tags. A block has its number of words, its share of words inside links, the same
of its two neighbours, the words of the run of link-poor blocks that it stands in, and three facts on where it stands: inside an
article element, inside a part that its tag, role, class or id names as page furniture, and in a heading. A class or id name marks furniture only where the page bears it out: an element
that holds an article element, or more than half of the page's words in long, link-poor blocks, is a wrapper and its name is
outvoted; and no name reaches into an article element. A decision tree, grown by Gini impurity on ``LABELLED`` (a small table of blocks
judged by hand), keeps or drops each block. Kept blocks are joined in page order.

A step on each page alone: no shuffle, and no page waits for another.

Defined cases: a null, empty or wordless page has an empty text; unclosed, unknown and misnested tags never end the page early;
character references are decoded once; a page without an article element is judged by its text alone; other columns pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|!--|[/!?])")
#: What may come next in a tag: a quoted value, or its end.
NEXT = re.compile(r"=\s*([\"'])|>")
RAW = frozenset("script style noscript template textarea iframe select option datalist title head".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption button label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Fixed list: parts of class and id names of page furniture.
FURNITURE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|footer|sidebar\w*|side|widget\w*|cookies?|consent|gdpr|notice|notices|"
    r"popup|modal|overlay|newsletter|subscribe|signup|login|comments?|commentlist|disqus|replies|respond|related|recommended|share|sharing|social|"
    r"toolbar|masthead|topbar|pagination|pager|tags|copyright|legal|disclaimer|skip)(?:$|[\s_-])", re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
ARTICLE_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Block(NamedTuple):
    text: str
    words: int
    link_words: int
    article: bool
    furniture: bool
    heading: bool
    names: tuple[int, ...] = ()  # elements around it whose class or id names furniture


#: A block of so many words, and at most this share of them in links, counts as text of the page.
LONG, LINK_POOR = 20, 0.34


def is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article):
        return True
    if "=" in attributes or "hidden" in attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = "".join(values), name.lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                return True
            if name == "role" and value.lower() in FURNITURE_ROLES:
                return True
    return False


def has_furniture_name(tag: str, attributes: str) -> bool:
    if "=" in attributes and tag not in ("html", "body", "article", "main"):
        for name, *values in ATTRIBUTE.findall(attributes):
            if name.lower() in ("class", "id") and FURNITURE_NAMES.search(re.sub(r"([a-z])([A-Z])", r"\1-\2", "".join(values))):
                return True
    return False


def has_target(attributes: str) -> bool:
    """Whether an a element is a link: all but those that only name a place."""
    names = {name.lower() for name, *_ in ATTRIBUTE.findall(attributes)}
    return "href" in names or not names & {"name", "id"}


def tag_end(page: str, at: int, failed: set[int]) -> tuple[int, int]:
    """(end of the attributes from ``at`` on, end of the tag), past quoted values of any length.

    A tag without an end, or with a quote that nothing closes, ends at its first ">" all the same. ``failed`` are the values of
    such tags on this page: a tag that meets one of them fares alike, so the page is read in linear time.
    """
    k, seen = at, []
    while m := NEXT.search(page, k):
        if not m.group(1):
            return m.span()
        if m.start() in failed:
            break
        seen.append(m.start())
        close = page.find(m.group(1), m.end())
        if close < 0:
            break
        k = close + 1
    failed.update(seen)
    end = page.find(">", at)
    return (len(page), len(page)) if end < 0 else (end, end + 1)


def outvoted(found: list[Block], wrappers: set[int]) -> list[Block]:
    """Blocks with the names settled: one marks furniture unless its element is among ``wrappers`` or holds most of the text."""
    total, inside = 0, Counter()
    for b in found:
        if b.words >= LONG and b.link_words <= LINK_POOR * b.words and not b.furniture:
            total += b.words
            inside.update(dict.fromkeys(b.names, b.words))
    text = wrappers | {k for k, n in inside.items() if 2 * n > total}
    return [b._replace(furniture=b.furniture or not text.issuperset(b.names), names=()) for b in found]


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, tuple[int, ...]]] = [("", False, False, False, ())]  # tag, article, furniture, heading, names
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag in the stack
    unclosed: set[str] = set()  # raw tags that nothing closes from here on
    wrappers: set[int] = set()
    named = 0
    parts: list[str] = []
    link_words = in_link = 0

    def flush() -> None:
        nonlocal link_words
        if parts:
            words = "".join(parts).split()
            if words:
                _, article, furniture, heading, names = stack[-1]
                out.append(Block(" ".join(words), len(words), min(link_words, len(words)), article, furniture, heading, names))
            parts.clear()
        link_words = 0

    def push(tag: str, *facts) -> None:
        places[tag].append(len(stack))
        stack.append((tag, *facts))

    def pop() -> None:
        places[stack.pop()[0]].pop()

    def say(raw: str) -> None:
        nonlocal link_words
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                link_words += len(text.split())

    at, end, failed = 0, len(page), set()
    while at < end:
        m = OPEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at:m.start()])
        tag = (m.group(2) or "").lower()
        if not tag:
            close = "-->" if m.group() == "<!--" else ">"
            at = page.find(close, m.end())
            at = end if at < 0 else at + len(close)
            continue
        stop, at = tag_end(page, m.end(), failed)
        if stop == end:
            break
        attributes = page[m.end():stop]
        if m.group(1):
            if tag == "a":
                in_link = 0
            elif tag in BLOCK:
                flush()
                in_link = 0
            if places[tag]:
                place = places[tag][-1]
                # A stray end tag does not leave the article.
                if tag in ("body", "html") or not any(places[t] and places[t][-1] > place for t in ARTICLE_TAGS):
                    while len(stack) > place:
                        pop()
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                close = None if tag in unclosed else re.compile(rf"</{tag}(?![\w-])", re.I).search(page, at)
                stop = page.find(">", close.end()) if close else -1
                if stop < 0:
                    unclosed.add(tag)
                at = stop + 1 if stop >= 0 else end if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = int(has_target(attributes))
        if tag in BLOCK:
            flush()
            in_link = 0
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", *HEADINGS) and stack[-1][0] == tag:
                pop()
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in BLOCK or tag == "span":
            _, article, furniture, heading, names = stack[-1]
            here, name = is_furniture(tag, attributes, article), has_furniture_name(tag, attributes)
            if tag in ARTICLE_TAGS:
                wrappers.update(names)
                names = ()
            if name:
                named += 1
                names = (*names, named)
            if tag == "span" and not (here or name):
                push(tag, article, furniture, heading, names)
            else:
                if tag == "span":
                    flush()
                push(tag, article or tag in ARTICLE_TAGS, furniture or here, tag in HEADINGS, names)
    flush()
    return outvoted(out, wrappers)


#: Columns of LABELLED; the neighbours' words and link shares are 0 at either end of a page. ``run``: the words of the longest run of
#: link-poor blocks outside furniture around the block, its own included; rows that do not state it stand beside their neighbours only.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "furniture", "heading", "run")
#: Blocks judged by hand: their features, and 1 for main text.
LABELLED = (
    # menus, and links beside them
    ((1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), 0), ((2, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), 0), ((3, 1.0, 2, 1.0, 40, 0.0, 0, 1, 0), 0), ((6, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0), 0),
    ((1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), 0), ((4, 0.8, 3, 1.0, 2, 1.0, 0, 0, 0), 0), ((12, 0.9, 4, 1.0, 9, 0.9, 0, 0, 0), 0), ((30, 0.9, 12, 1.0, 20, 0.8, 0, 0, 0), 0),
    # headers, adverts, notices, forms, sidebars
    ((5, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0), 0), ((9, 0.0, 2, 1.0, 8, 0.0, 0, 1, 0), 0), ((14, 0.2, 3, 1.0, 80, 0.0, 0, 1, 0), 0), ((35, 0.1, 60, 0.0, 70, 0.0, 1, 1, 0), 0),
    ((60, 0.0, 4, 0.5, 90, 0.0, 0, 1, 0), 0), ((120, 0.0, 10, 0.0, 3, 0.0, 0, 1, 0), 0), ((22, 0.0, 100, 0.0, 5, 0.0, 1, 1, 0), 0), ((3, 0.0, 2, 0.0, 2, 0.0, 0, 1, 1), 0),
    ((8, 0.0, 30, 0.0, 12, 1.0, 1, 1, 1), 0), ((2, 0.0, 6, 0.0, 1, 0.0, 0, 0, 0), 0), ((7, 0.0, 2, 1.0, 3, 0.0, 0, 0, 0), 0), ((5, 0.2, 3, 0.0, 4, 1.0, 0, 0, 0), 0),
    # footers and reader comments
    ((8, 0.0, 30, 0.0, 0, 0.0, 0, 1, 0), 0), ((12, 0.3, 4, 1.0, 0, 0.0, 0, 1, 0), 0), ((5, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0), 0), ((9, 0.4, 5, 0.0, 0, 0.0, 0, 0, 0), 0),
    ((25, 0.0, 4, 0.0, 18, 0.0, 0, 1, 0), 0), ((70, 0.0, 3, 0.0, 45, 0.0, 1, 1, 0), 0), ((4, 1.0, 70, 0.0, 25, 0.0, 1, 1, 0), 0), ((1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0), 0),
    # articles, in an element of their own
    ((8, 0.0, 9, 0.0, 120, 0.0, 1, 0, 1), 1), ((3, 0.0, 0, 0.0, 60, 0.0, 1, 0, 1), 1), ((120, 0.0, 8, 0.0, 70, 0.0, 1, 0, 0), 1), ((70, 0.1, 120, 0.0, 1, 0.0, 1, 0, 0), 1),
    ((1, 0.0, 70, 0.0, 2, 0.0, 1, 0, 0), 1), ((2, 0.0, 1, 0.0, 1, 0.0, 1, 0, 0), 1), ((1, 0.0, 2, 0.0, 8, 0.0, 1, 0, 0), 1), ((5, 0.0, 40, 0.0, 7, 0.2, 1, 0, 0), 1),
    ((40, 0.4, 30, 0.0, 20, 0.0, 1, 0, 0), 1), ((6, 1.0, 50, 0.0, 60, 0.0, 1, 0, 0), 1), ((300, 0.0, 3, 0.0, 9, 0.0, 1, 0, 0), 1), ((15, 0.6, 12, 0.0, 33, 0.1, 1, 0, 0), 1),
    ((9, 0.0, 1, 1.0, 14, 0.0, 1, 0, 0), 1), ((1, 1.0, 30, 0.0, 25, 0.0, 1, 0, 0), 1), ((3, 0.0, 5, 1.0, 4, 1.0, 1, 0, 0), 1), ((11, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0), 1),
    # lists of links in an article
    ((5, 1.0, 6, 1.0, 7, 1.0, 1, 0, 0), 0), ((7, 1.0, 5, 1.0, 3, 0.9, 1, 0, 0), 0), ((3, 1.0, 4, 1.0, 6, 1.0, 1, 0, 0), 0),
    # pages without an article element
    ((90, 0.0, 6, 0.0, 70, 0.0, 0, 0, 0), 1), ((70, 0.1, 90, 0.0, 5, 0.0, 0, 0, 0), 1), ((45, 0.2, 20, 0.0, 30, 0.1, 0, 0, 0), 1), ((25, 0.0, 3, 1.0, 60, 0.0, 0, 0, 0), 1),
    ((6, 0.0, 60, 0.0, 80, 0.0, 0, 0, 0), 1), ((3, 0.0, 45, 0.1, 30, 0.0, 0, 0, 0), 1), ((1, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0), 1), ((7, 0.0, 2, 1.0, 90, 0.0, 0, 0, 1), 1),
    ((5, 0.0, 70, 0.0, 40, 0.0, 0, 0, 1), 1), ((4, 0.0, 1, 1.0, 25, 0.0, 0, 0, 1), 1), ((18, 0.0, 40, 0.0, 6, 0.0, 0, 0, 0), 1), ((200, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0), 1),
    ((16, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0), 1), ((60, 0.3, 2, 1.0, 5, 1.0, 0, 0, 0), 1), ((3, 0.0, 2, 1.0, 4, 1.0, 0, 0, 1), 0), ((2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0), 0),
    ((60, 0.0, 70, 0.0, 3, 0.0, 0, 0, 0), 1), ((40, 0.0, 50, 0.1, 0, 0.0, 0, 0, 0), 1), ((28, 0.0, 35, 0.0, 4, 0.6, 0, 0, 0), 1), ((33, 0.1, 15, 0.0, 2, 1.0, 0, 0, 0), 1),
    ((2, 1.0, 1, 1.0, 60, 0.0, 0, 0, 0), 0), ((1, 1.0, 3, 1.0, 35, 0.0, 0, 0, 0), 0), ((4, 1.0, 2, 1.0, 90, 0.0, 0, 0, 0), 0), ((3, 1.0, 50, 0.0, 40, 0.0, 0, 0, 0), 0),
    ((5, 0.0, 2, 1.0, 12, 0.0, 0, 0, 0), 0), ((9, 0.0, 3, 1.0, 10, 0.0, 0, 0, 0), 0), ((6, 0.0, 0, 0.0, 9, 0.0, 0, 0, 0), 0), ((4, 0.0, 8, 0.0, 7, 0.0, 0, 0, 0), 0),
    ((8, 0.5, 6, 0.8, 50, 0.0, 0, 0, 0), 0), ((10, 0.7, 30, 0.0, 12, 0.8, 0, 0, 0), 0),
    # their headings and short blocks, and short blocks that stand among no text
    ((9, 0.0, 2, 1.0, 80, 0.0, 0, 0, 1), 1), ((10, 0.0, 40, 0.0, 60, 0.0, 0, 0, 1), 1), ((8, 0.0, 0, 0.0, 45, 0.0, 0, 0, 1), 1), ((9, 0.0, 60, 0.0, 30, 0.0, 0, 0, 1), 1),
    ((8, 0.0, 50, 0.0, 70, 0.0, 0, 0, 0), 1), ((9, 0.0, 70, 0.0, 40, 0.0, 0, 0, 0), 1), ((10, 0.0, 35, 0.0, 90, 0.0, 0, 0, 0), 1), ((9, 0.0, 40, 0.0, 60, 0.0, 0, 0, 0), 1),
    ((10, 0.0, 60, 0.0, 8, 0.0, 0, 0, 0), 1), ((8, 0.0, 45, 0.0, 9, 0.0, 0, 0, 0), 1), ((9, 0.0, 8, 0.0, 50, 0.0, 0, 0, 0), 1), ((5, 0.0, 60, 0.0, 7, 0.0, 0, 0, 0), 1),
    ((7, 0.0, 40, 0.0, 6, 0.0, 0, 0, 0), 1), ((6, 0.0, 7, 0.0, 60, 0.0, 0, 0, 0), 1), ((4, 0.0, 50, 0.0, 3, 0.0, 0, 0, 1), 1), ((8, 0.0, 30, 0.0, 12, 0.0, 0, 0, 1), 1),
    ((9, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0), 0), ((10, 0.0, 4, 1.0, 5, 0.6, 0, 0, 0), 0), ((8, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0), 0), ((9, 0.0, 1, 1.0, 0, 0.0, 0, 0, 0), 0),
    ((10, 0.0, 3, 1.0, 4, 0.0, 0, 0, 0), 0), ((8, 0.0, 5, 0.0, 3, 1.0, 0, 0, 0), 0), ((3, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0), 0), ((6, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0), 0),
    ((9, 0.0, 70, 0.0, 0, 0.0, 0, 0, 0), 0), ((4, 0.0, 90, 0.0, 2, 1.0, 0, 0, 0), 0), ((7, 0.0, 50, 0.0, 1, 1.0, 0, 0, 0), 0),
    # links among text, paragraphs of few words, and last paragraphs
    ((2, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0), 0), ((1, 1.0, 0, 0.0, 80, 0.0, 0, 0, 0), 0), ((8, 1.0, 50, 0.0, 60, 0.0, 0, 0, 0), 0), ((12, 0.9, 40, 0.0, 70, 0.0, 0, 0, 0), 0),
    ((15, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0), 0), ((20, 0.8, 60, 0.0, 40, 0.0, 0, 0, 0), 0), ((30, 0.9, 40, 0.0, 50, 0.0, 0, 0, 0), 0), ((5, 1.0, 60, 0.0, 70, 0.0, 0, 0, 0), 0),
    ((3, 0.7, 0, 0.0, 40, 0.0, 0, 0, 0), 0), ((9, 0.8, 30, 0.0, 50, 0.0, 0, 0, 0), 0), ((5, 0.0, 25, 0.0, 30, 0.0, 0, 0, 0), 1), ((4, 0.0, 22, 0.0, 25, 0.0, 0, 0, 0), 1),
    ((20, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0), 1), ((14, 0.0, 60, 0.0, 1, 1.0, 0, 0, 0), 1), ((20, 0.0, 40, 0.0, 1, 1.0, 0, 0, 0), 1), ((24, 0.0, 50, 0.0, 0, 0.0, 0, 0, 0), 1),
    ((2, 0.0, 1, 1.0, 70, 0.0, 0, 0, 1), 1), ((3, 0.0, 2, 1.0, 80, 0.0, 0, 0, 1), 1), ((1, 0.0, 0, 0.0, 50, 0.0, 0, 0, 1), 1), ((9, 0.0, 3, 0.0, 60, 0.0, 0, 0, 0), 1),
    ((10, 0.0, 2, 1.0, 80, 0.0, 0, 0, 0), 1), ((8, 0.0, 1, 0.0, 70, 0.0, 0, 0, 0), 1),
    # the same in an article element
    ((9, 0.0, 60, 0.0, 30, 0.0, 1, 0, 1), 1), ((8, 0.0, 50, 0.0, 70, 0.0, 1, 0, 0), 1), ((9, 0.0, 8, 0.0, 50, 0.0, 1, 0, 0), 1), ((10, 0.0, 60, 0.0, 8, 0.0, 1, 0, 0), 1),
    ((7, 0.0, 40, 0.0, 6, 0.0, 1, 0, 0), 1), ((3, 0.0, 8, 0.0, 12, 0.0, 1, 0, 0), 1), ((2, 0.0, 7, 0.0, 3, 0.0, 1, 0, 0), 1), ((9, 0.0, 2, 1.0, 2, 1.0, 1, 0, 0), 1),
    ((8, 0.0, 0, 0.0, 1, 1.0, 1, 0, 0), 1), ((9, 0.0, 1, 1.0, 0, 0.0, 1, 0, 0), 1), ((10, 0.0, 3, 1.0, 4, 0.0, 1, 0, 0), 1), ((8, 0.0, 5, 0.0, 3, 1.0, 1, 0, 0), 1),
    ((3, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0), 1), ((9, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0), 1), ((4, 0.0, 90, 0.0, 2, 1.0, 1, 0, 0), 1), ((6, 0.0, 7, 0.0, 60, 0.0, 1, 0, 0), 1),
    # and in furniture
    ((9, 0.0, 60, 0.0, 30, 0.0, 0, 1, 1), 0), ((8, 0.0, 50, 0.0, 70, 0.0, 0, 1, 0), 0), ((9, 0.0, 8, 0.0, 50, 0.0, 1, 1, 0), 0), ((10, 0.0, 60, 0.0, 8, 0.0, 0, 1, 0), 0),
    ((7, 0.0, 40, 0.0, 6, 0.0, 1, 1, 0), 0), ((40, 0.0, 60, 0.0, 50, 0.0, 0, 1, 0), 0), ((90, 0.0, 60, 0.0, 70, 0.0, 1, 1, 0), 0), ((6, 0.0, 7, 0.0, 60, 0.0, 0, 1, 0), 0),
    ((30, 0.0, 80, 0.0, 0, 0.0, 0, 1, 0), 0), ((200, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0), 0), ((5, 0.0, 70, 0.0, 40, 0.0, 0, 1, 1), 0), ((3, 0.0, 45, 0.1, 30, 0.0, 1, 1, 0), 0),
    # pages of short paragraphs only: what counts is the run that they make
    ((11, 0.0, 12, 0.0, 11, 0.0, 0, 0, 0, 80), 1), ((3, 0.0, 3, 0.0, 3, 0.0, 0, 0, 0, 45), 1), ((5, 0.0, 6, 0.0, 4, 0.0, 0, 0, 0, 60), 1), ((9, 0.0, 8, 0.0, 10, 0.0, 0, 0, 0, 50), 1),
    ((15, 0.0, 14, 0.0, 15, 0.0, 0, 0, 0, 100), 1), ((7, 0.0, 2, 0.0, 8, 0.0, 0, 0, 0, 45), 1), ((4, 0.0, 2, 1.0, 5, 0.0, 0, 0, 0, 48), 1), ((12, 0.0, 1, 1.0, 11, 0.0, 0, 0, 0, 75), 1),
    ((8, 0.0, 9, 0.0, 0, 0.0, 0, 0, 0, 60), 1), ((3, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 50), 1), ((12, 0.0, 11, 0.0, 0, 0.0, 0, 0, 0, 70), 1), ((6, 0.0, 5, 0.0, 1, 1.0, 0, 0, 0, 42), 1),
    ((3, 0.0, 3, 0.0, 1, 1.0, 0, 0, 0, 90), 1), ((14, 0.0, 13, 0.0, 2, 1.0, 0, 0, 0, 85), 1), ((2, 0.0, 2, 1.0, 11, 0.0, 0, 0, 1, 70), 1), ((4, 0.0, 0, 0.0, 3, 0.0, 0, 0, 1, 45), 1),
    ((3, 0.0, 12, 0.0, 12, 0.0, 0, 0, 1, 90), 1), ((1, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0, 55), 1), ((10, 0.0, 1, 0.0, 11, 0.0, 0, 0, 0, 65), 1), ((8, 0.0, 0, 0.0, 7, 0.0, 0, 0, 0, 50), 1),
    ((3, 0.0, 0, 0.0, 3, 0.0, 0, 0, 0, 45), 1), ((13, 0.0, 0, 0.0, 12, 0.0, 0, 0, 0, 80), 1), ((20, 0.0, 9, 0.0, 0, 0.0, 0, 0, 0, 40), 1), ((5, 0.0, 20, 0.0, 6, 0.0, 0, 0, 0, 60), 1),
    ((9, 0.0, 9, 0.0, 0, 0.0, 0, 0, 0, 54), 1), ((10, 0.0, 10, 0.0, 0, 0.0, 0, 0, 0, 60), 1), ((11, 0.0, 11, 0.0, 0, 0.0, 0, 0, 0, 66), 1), ((15, 0.0, 15, 0.0, 0, 0.0, 0, 0, 0, 90), 1),
    ((5, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0, 70), 1), ((7, 0.0, 7, 0.0, 0, 0.0, 0, 0, 0, 280), 1), ((4, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 56), 1), ((9, 0.0, 9, 0.0, 2, 1.0, 0, 0, 0, 54), 1),
    # and short blocks that make no run
    ((4, 0.0, 5, 0.0, 6, 0.0, 0, 0, 0, 20), 0), ((3, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 12), 0), ((8, 0.0, 7, 0.0, 0, 0.0, 0, 0, 0, 22), 0), ((6, 0.0, 2, 1.0, 5, 0.0, 0, 0, 0, 18), 0),
    ((9, 0.0, 8, 0.0, 2, 1.0, 0, 0, 0, 25), 0), ((5, 1.0, 4, 0.0, 5, 0.0, 0, 0, 0, 0), 0), ((3, 1.0, 11, 0.0, 12, 0.0, 0, 0, 0, 0), 0), ((4, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0, 300), 0),
    ((8, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 400), 0), ((5, 0.0, 45, 0.0, 2, 1.0, 0, 0, 0, 250), 0), ((3, 0.0, 25, 0.0, 1, 1.0, 0, 0, 0, 120), 0),
)


def with_run(features: tuple) -> tuple:
    """A labelled row with its run: stated, or its own words and those of link-poor neighbours."""
    if len(features) == len(FEATURES):
        return features
    words, links, before, links_before, after, links_after, _, furniture, _ = features
    run = 0 if furniture or links > LINK_POOR else words + before * (links_before <= LINK_POOR) + after * (links_after <= LINK_POOR)
    return (*features, run)


def gini(labels: list[int]) -> float:
    p = sum(labels) / len(labels)
    return 2 * p * (1 - p)


def grow(rows, depth: int = 8):
    """A tree as nested (feature, border, below or equal, above), or a label."""
    labels = [y for _, y in rows]
    if depth == 0 or len(set(labels)) == 1:
        return int(2 * sum(labels) >= len(labels))
    best = None
    # The facts on where a block stands come first among equally good splits.
    for k in sorted(range(len(FEATURES)), key=lambda k: FEATURES[k] not in ("furniture", "article", "heading")):
        values = sorted({x[k] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            border = (a + b) / 2
            parts = [[r for r in rows if r[0][k] <= border], [r for r in rows if r[0][k] > border]]
            cost = sum(len(p) * gini([y for _, y in p]) for p in parts)
            if best is None or cost < best[0] - 1e-9:
                best = (cost, k, border, parts)
    if best is None:
        return int(2 * sum(labels) >= len(labels))
    return (best[1], best[2], grow(best[3][0], depth - 1), grow(best[3][1], depth - 1))


def classify(tree, features: tuple) -> int:
    while not isinstance(tree, int):
        k, border, low, high = tree
        tree = low if features[k] <= border else high
    return tree


def runs(found: list[Block]) -> list[int]:
    """For every block the words of its run; 0 for blocks of links or in furniture, which end runs."""
    out, first, total = [0] * len(found), 0, 0
    for k, b in enumerate([*found, None]):
        if b is not None and not b.furniture and b.link_words <= LINK_POOR * b.words:
            total += b.words
            continue
        out[first:k] = [total] * (k - first)
        first, total = k + 1, 0
    return out


def block_features(found: list[Block]) -> list[tuple]:
    run = runs(found)
    words = [0, *(b.words for b in found), 0]
    links = [0.0, *(b.link_words / b.words for b in found), 0.0]
    return [(words[k], links[k], words[k - 1], links[k - 1], words[k + 1], links[k + 1], int(b.article), int(b.furniture), int(b.heading), run[k - 1])
            for k, b in enumerate(found, 1)]


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, x in zip(found, block_features(found)) if classify(tree, x))


def extractor(labelled=LABELLED):
    """A function of a column of html, with a tree grown from the labelled table."""
    tree = grow([(with_run(x), y) for x, y in labelled])

    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return F.pandas_udf(extract, "string")


def extracted(pages: DataFrame, page: str = "html", labelled=LABELLED) -> DataFrame:
    """One row per page: ``row`` (all its columns) and text."""
    extract: Column = extractor(labelled)(F.col(page))
    return pages.select(F.struct("*").alias("row"), extract.alias("text"))
