"""Main text of HTML pages by two passes of block rules.

Markup is read once, from left to right, and cut into blocks: runs of text between block-level tags. Pass one gives
each block a score. Length with a density of stop words, as running text has it, speaks for a block; link density
speaks against it. So do, less or more, the elements and names (class, id, role) that it stands under; an article or
main element around it counts for little. A high score makes a block text, a low one makes it furniture, and what is
between, such as a short block, stays open. Pass two gives each open block the label of its nearest decided neighbours.
On a page whose text has hardly any of the known stop words, in another language, length alone stands for running text.

An element named like furniture that holds most of the page's stop words, and an article or all of its running text,
is no furniture.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common short words of the languages in the corpus.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they
    this to was we were which will with you
    au aux avec ce ces dans de des du elle en est et il la le les leur mais ne on ou par pas pour qu que qui sa se ses
    son sur un une
    als am auch auf aus bei das dass dem den der die ein eine einem einen einer es für hat ich im ist mit nicht sich
    sie sind so über um und von war was wie wir zu zum zur
    al como con del el ella ellos entre era esta este ha las lo los más no para pero por se sin su sus una y ya""".split()
)

#: Elements that begin and end a block.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p
    pre section select summary table tbody td tfoot th thead tr ul head title button textarea""".split()
)
#: Elements whose content is never text of the page; they end at their first end tag.
RAW_TAGS = frozenset("script style noscript template iframe object svg math textarea title canvas audio video select noembed noframes".split())
#: Of those, the ones that a browser reads to the end of the page if they are not closed.
OPEN_RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes"))
#: Elements that hold a page's furniture. A header inside an article is the article's own.
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button head header".split())
#: Of those, the ones that end where an article begins, if they were not closed before.
BEFORE_ARTICLE = frozenset(("nav", "menu", "head", "header", "button"))
#: Elements that are not closed by an end tag of their own.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ARTICLE_TAGS = frozenset(("article", "main"))
#: Words in class, id or role that name furniture, whole or as a part of a hyphened name.
STRONG_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs byline comment
    comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer disqus footer foot gdpr
    masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain pager pagination
    popup promo promotion replies reply respond search share sharing sidebar side-bar signup skip social sponsor
    sponsored subscribe taboola toolbar topbar""".split()
)
#: Words that furniture and articles both are named by.
WEAK_NAMES = frozenset("header related recommended recommendations teaser widget widgets".split())
#: Last parts of names that say which part or shape of something it is; what is named is in the part before.
NEUTRAL = frozenset(
    """area author bar block body box btn button buttons center column container content count element field form frame
    full group head holder icon icons inner input item items label layout left line link links list main media meta
    module outer overlay panel post right row section slot small template text thread title toggle top unit wrap
    wrapper zone""".split()
)
#: First parts of names that say what a page or wrapper has, not what it is.
ABOUT = frozenset("has no with without is not hide show".split())

#: Link text over this part of a block's characters makes it furniture.
LINK_DENSITY = 0.5
#: Blocks of fewer characters are too short to tell.
SHORT = 70
#: Running text has at least this part of stop words; a page with less than the second part is in an unknown language.
STOP_DENSITY, SPOKEN_DENSITY = 0.08, 0.02
#: Scores: running text, an article around, text beside the page's articles, names, and what decides a block.
RUNNING, IN_ARTICLE, BESIDE, WEAK, STRONG, LINKS = 2, 1, -1, -1, -4, -4
TEXT, FURNITURE = 2, -1

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_GAP = re.compile(r"[\s/]*")
_NAME = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_WORD = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Block(NamedTuple):
    """A block that has text: its element, the characters of it inside links, its stop words, its article (0: none) and
    the strongest name that it stands under."""

    text: str
    heading: bool
    linked: int
    stops: int
    words: int
    article: int
    name: int


def tokens(markup: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, value, attributes) in page order: text, or an open or close tag in lower case.

    Each character is read a bounded number of times. Comments, declarations and raw elements give nothing. A badly
    quoted tag ends where a browser ends it; one that the page does not close takes the rest of the page with it.
    """
    at, n, unclosed, ends = 0, len(markup), set(), {}
    while at < n:
        lt = markup.find("<", at)
        while 0 <= lt < n - 1 and not (markup[lt + 1] in "!?/" or markup[lt + 1].isascii() and markup[lt + 1].isalpha()):
            lt = markup.find("<", lt + 1)
        if lt < 0 or lt == n - 1:
            yield "text", markup[at:], {}
            return
        if lt > at:
            yield "text", markup[at:lt], {}
        m = _TAG.match(markup, lt)
        if m is None:  # a comment, a declaration, or an end tag without a name
            close = "-->" if markup.startswith("<!--", lt) else "]]>" if markup.startswith("<![CDATA[", lt) and "]]>" not in unclosed else ">"
            end = markup.find(close, lt + 2)
            if end < 0 and close == "]]>":
                unclosed.add(close)
                end, close = markup.find(">", lt), ">"
            at = n if end < 0 else end + len(close)
            continue
        tag, attributes, at = m[2].lower(), {}, m.end()
        while True:
            at = _GAP.match(markup, at).end()
            if at >= n:
                return
            if markup[at] == ">":
                at += 1
                break
            name = _NAME.match(markup, at)
            at, value = name.end(), ""
            if equals := _EQUALS.match(markup, at):
                at = equals.end()
                if markup[at : at + 1] in ('"', "'"):
                    end = markup.find(markup[at], at + 1)
                    if end < 0:
                        return
                    value, at = markup[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(markup, at)
                    value, at = bare[0], bare.end()
            attributes.setdefault(name[0].lower(), value)
        if not m[1] and tag in RAW_TAGS:
            if tag not in unclosed:
                ends.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I))
                if end := ends[tag].search(markup, at):
                    at = end.end()
                else:
                    unclosed.add(tag)
            if tag in unclosed and tag in OPEN_RAW:
                return
            yield "raw", tag, {}
        else:
            yield "close" if m[1] else "open", tag, attributes


def _called(word: str) -> int:
    """How strongly one name says furniture. A compound is what its last part is called ("user-comments" are comments,
    a "share-price" is a price), neutral parts and numbers aside; a part before that is a weak sign only."""
    if word in STRONG_NAMES:
        return STRONG
    pieces = [x for x in re.split(r"[-_]+", word) if x]
    if not pieces:
        return 0
    found = 0 if (STRONG_NAMES | WEAK_NAMES).isdisjoint(pieces) else WEAK
    if pieces[0] in ABOUT:
        return found
    while len(pieces) > 1 and (pieces[-1] in NEUTRAL or pieces[-1].isdigit()):
        pieces.pop()
    return STRONG if pieces[-1] in STRONG_NAMES else found


def _named(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    """How strongly an element says that it is furniture: STRONG, WEAK or 0."""
    if tag in FURNITURE_TAGS and not (tag == "header" and in_article):
        return STRONG
    if not attributes or tag in ("html", "body"):
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", "").lower()):
        return STRONG
    found = min((_called(w) for name in ("class", "id", "role") for w in attributes.get(name, "").lower().split()), default=0)
    return found if found == STRONG or tag not in HEADINGS else 0


class _Named:
    """An element that is named like furniture: the one around it, what it says, its stop words, an article inside."""

    __slots__ = ("article", "parent", "running", "says", "stops")

    def __init__(self, parent: int, says: int):
        self.parent, self.says, self.stops, self.running, self.article = parent, says, 0, 0, False


def blocks_of(markup: str) -> list[Block]:
    """All blocks that have text, in page order."""
    named = [_Named(-1, 0)]  # what is under no named element
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # open block elements: tag, innermost named element, article
    opened: Counter[str] = Counter()
    menus: list[int] = []  # places in the stack of elements that end where an article begins
    raw: list[list] = []  # parts, linked, tag, named element, article
    articles, link_depth = 0, 0  # depth of the stack at which the open link began; 0: none

    def begin(tag: str, name: int, article: int) -> None:
        if raw and not raw[-1][0]:
            raw.pop()
        raw.append([[], 0, tag, name, article])

    begin("", 0, 0)
    for kind, value, attributes in tokens(markup):
        if kind == "text":
            text = html.unescape(value)
            raw[-1][0].append(text)
            if link_depth:
                raw[-1][1] += sum(map(len, text.split()))
        elif kind == "raw":
            if value in BLOCK_TAGS:
                begin("", *stack[-1][1:])
        elif value == "a":
            link_depth = len(stack) if kind == "open" and "href" in attributes else 0
        elif value == "br":
            raw[-1][0].append(" ")
        elif value in BLOCK_TAGS:
            if kind == "close":
                while opened[value]:
                    tag = stack.pop()[0]
                    opened[tag] -= 1
                    if menus and menus[-1] == len(stack):
                        menus.pop()
                    if tag == value:
                        break
                if link_depth > len(stack):
                    link_depth = 0
                begin("", *stack[-1][1:])
                continue
            if value in ARTICLE_TAGS and not stack[-1][2] and menus:
                # Unclosed menus end where the article begins. What stands in the stack above the first of them goes on
                # under the names that were around that one; it is looked at once, as no menu is left in it.
                first = menus[0]
                around, above = stack[first - 1][1:], stack[first:]
                for t, _, _ in above:
                    opened[t] -= t in BEFORE_ARTICLE
                stack[first:] = [(t, *around) for t, _, _ in above if t not in BEFORE_ARTICLE]
                menus.clear()
                link_depth = 0
            _, inside, article = stack[-1]
            if value in ARTICLE_TAGS:
                articles += 1
                article = articles
                up = inside
                while up and not named[up].article:
                    named[up].article, up = True, named[up].parent
            if says := _named(value, attributes, article > 0):
                named.append(_Named(inside, says))
                inside = len(named) - 1
            if value not in VOID_TAGS and value != "p":
                if value in BEFORE_ARTICLE and not article:
                    menus.append(len(stack))
                stack.append((value, inside, article))
                opened[value] += 1
            begin(value, inside, article)
    found = []
    for parts, linked, tag, name, article in raw:
        text = " ".join("".join(parts).split())
        if text:
            words = _WORD.findall(text.lower())
            found.append((text, tag in HEADINGS, linked, sum(w in STOP_WORDS for w in words), len(words), article, name))
    return _weigh(found, named)


def _weigh(found: list[tuple], named: list[_Named]) -> list[Block]:
    """The blocks with the strongest name around each, once it is known which named elements are furniture."""
    blocks = list(map(Block._make, found))
    spoken = _spoken(blocks)
    for block in blocks:
        if not _is_link(block):
            named[block.name].stops += block.stops if spoken else len(block.text) * _is_running(block, spoken)
            named[block.name].running += _is_running(block, spoken)
    free = named[0].running
    for x in reversed(named[1:]):  # an element comes after the one around it
        named[x.parent].stops += x.stops
    says = [0]
    for x in named[1:]:
        own = 0 if 2 * x.stops > named[0].stops and (x.article or not free) else x.says
        says.append(min(own, says[x.parent]))
    return [Block(*x[:6], says[x[6]]) for x in found]


def _is_link(b: Block) -> bool:
    return b.linked > LINK_DENSITY * len(b.text.replace(" ", ""))


def _spoken(blocks: list[Block]) -> bool:
    """Whether the page's text has the stop words of a known language."""
    words = [(b.stops, b.words) for b in blocks if not _is_link(b)]
    return sum(s for s, _ in words) >= SPOKEN_DENSITY * sum(w for _, w in words)


def _is_running(b: Block, spoken: bool = True) -> bool:
    return len(b.text) >= SHORT and (not spoken or b.stops >= STOP_DENSITY * max(1, b.words))


def decide(blocks: list[Block]) -> list[bool | None]:
    """Pass one: text, furniture, or open."""
    beside = any(b.article and b.name == 0 and not _is_link(b) for b in blocks)
    spoken = _spoken(blocks)
    out: list[bool | None] = []
    for b in blocks:
        score = b.name + (IN_ARTICLE if b.article else BESIDE if beside else 0)
        if _is_link(b):
            score += 0 if b.heading and b.article else LINKS  # the heading of an article may be its link
        elif _is_running(b, spoken):
            score += RUNNING
        out.append(True if score >= TEXT else False if score <= FURNITURE else None)
    return out


def inherit(blocks: list[Block], label: list[bool | None]) -> list[bool]:
    """Pass two: each open block takes the label of its nearest decided neighbours in its own article, or beside all.

    If the two differ and are equally near, a heading goes with what follows it, other blocks of an article are text,
    and blocks beside articles are not. If there are none, a block of an article is text unless it is link text; beside
    articles it is text only on a page that has nothing decided.
    """
    before, after = _sweep(blocks, label), [x and (len(blocks) - 1 - x[0], x[1]) for x in reversed(_sweep(blocks[::-1], label[::-1]))]
    nothing, out = all(x is None for x in label), []
    for i, b in enumerate(blocks):
        if label[i] is not None:
            out.append(label[i])
            continue
        near = [(abs(x[0] - i), x[1]) for x in (before[i], after[i]) if x]
        if not near:
            out.append(not _is_link(b) and (b.article > 0 or nothing))
        elif len(near) == 2 and near[0][0] == near[1][0]:
            out.append(near[1][1] if near[0][1] == near[1][1] or b.heading else b.article > 0 and not _is_link(b))
        else:
            out.append(min(near)[1])
    return out


def _sweep(blocks: list[Block], label: list[bool | None]) -> list[tuple[int, bool] | None]:
    """For each block the place and label of the last decided one before it in its article, in one pass."""
    last: dict[int, tuple[int, bool]] = {}
    out = []
    for i, b in enumerate(blocks):
        out.append(last.get(b.article))
        if label[i] is not None:
            last[b.article] = i, label[i]
    return out


def main_text(markup: str | None) -> str:
    """The text blocks of the article in page order, joined by one line feed; empty if there are none (or no html)."""
    if not isinstance(markup, str):
        return ""
    blocks = blocks_of(markup)
    return "\n".join(b.text for b, keep in zip(blocks, inherit(blocks, decide(blocks)), strict=True) if keep)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points) instead of the html; one row for each row.

    Null and empty html, and pages without an article, give an empty text. Columns named text or n_chars are replaced;
    all others are kept as they are. Repeated rows are read each. Very long and broken pages are read whole, one at a
    time, in time that grows with their length. An empty table gives no rows.
    """
    kept = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([main_text(x) for x in b], dtype=object)

    return pages.select(*(F.col(f"`{c}`") for c in kept), run(F.col(html_column)).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
