"""HTML extraction: the main text of a page, by two passes of block rules.

A page is cut into blocks at block-level tags; text of scripts, styles, hidden
elements and the like never becomes a block.

The first pass measures every block: its length, the share of its characters
that are links, and the share of its words that are stop words. Link-rich blocks
are bad, long blocks of many stop words good, shorter ones nearly good; blocks
too short to tell stay open. In the second pass open and nearly good blocks take
the label of the nearest decided blocks before and after them.

Mark-up moves the limits of the measures:

* In a region that is marked as the text (an article, the main part) a block is
  bad only when nearly all of it is links, and it is no paragraph or heading
  element: menus in an article go. There few stop words leave a block open, to be
  settled by its neighbours, and elsewhere a paragraph element that has some.
* A paragraph or heading element that stands at the end of a region goes with its
  one decided neighbour; other blocks there are bad.
* A lesser mark, such as "comment-policy", makes nearly good blocks open.
* No length or stop word can tell a reader's comment from the text. So regions
  that are marked as something other than the text (a menu, header, footer,
  sidebar, form, advert, notice, comments) are taken out beside the method. Tags
  and roles are taken at their word; a class or id only when the mark is its head
  word ("post-comments", not "comment-policy"; "post-header" is a text's own) and
  the page has prose outside of it.

Neighbours are looked for in a block's own region. A region without a decided
block is good if it is marked as the text. A page without a good block is read
again with lower limits.

Where a page states a language without a stop-word list, length and links decide
alone; where it states none, the lists of all languages count.

Pages are independent, so this is one pass over the table without a shuffle;
each page is read in time proportional to its length.

Defined cases: null html is an empty page with an empty text. Very long pages
are read whole. Tags that are never closed end with what contains them; an
unfinished tag at the end of a page is dropped; a "<" that begins no tag is text.
A block between a good and a bad neighbour is a tie: it is good as a paragraph, in
a region that is marked as the text or beside a nearly good block, else bad; where a region that
is marked as the text ends counts as good. Repeated rows come
back each. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published lengths and link density of the two-pass method.
LENGTH_LOW = 70
LENGTH_HIGH = 200
MAX_LINK_DENSITY = 0.2
#: Shares of stop words: lower than the published ones, as the lists below hold about a hundred words each and those several hundred.
STOPWORDS_LOW = 0.15
STOPWORDS_HIGH = 0.20
#: A paragraph element with fewer than one stop word in a hundred is bad, as any other block with fewer than STOPWORDS_LOW.
STOPWORDS_LEAST = 0.01
#: The share of links up to which a block may be good in a region that is marked as the text.
MENU_DENSITY = 0.8

# Common function words.
STOP_WORDS = {
    "en": "the of and to a in is it that was for on are as with his they i at be this have from or one had by but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has two more no way could my than been who its now did get come made may over",
    "fr": "le la les un une des de du et en à au aux que qui ne pas pour par sur avec dans ce cette ces il elle ils elles on nous vous je tu se sa son ses leur leurs mais ou où donc ni car est sont était être avoir a ont fait plus tout comme si sans sous y d l s n c qu",
    "de": "der die das den dem des ein eine einer eines einem einen und oder aber nicht mit von zu zum zur im in am an auf aus bei für ist sind war waren wird werden hat haben ich du er sie es wir ihr sich als auch wie noch nur so nach vor über unter durch um bis dass wenn kein keine man sein",
    "es": "el la los las un una unos unas de del a al y e o u en que no se por para con su sus es son era ser ha han lo le les como más pero si sin sobre este esta estos estas yo tú él ella ellos nos me te mi muy ya hay fue entre cuando todo",
}

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg math canvas textarea select title".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd td th tr tbody thead tfoot body".split())
_ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_ASIDE_TAGS = frozenset("nav footer aside form menu dialog button head".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar note".split())
_TEXT_ROLES = frozenset(("main", "article"))
#: Names of what is not the text.
_ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner banners"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager topbar toolbar masthead header"
    " footer footnav colophon copyright legal"
    " sidebar sidebars aside widget widgets related recommended recommendations trending popular"
    " cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login paywall"
    " comment comments commentlist disqus respond response responses reply replies feedback guestbook reader discussion share sharing social".split()
)
_TEXT_NAMES = frozenset("article post entry story".split())
#: Elements that running text is set in.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
#: Words that say where or how large a thing is; the head of a name stands before them.
_QUALIFIERS = frozenset("left right top bottom main inner outer wrap wrapper container content contents body text area section block box list item unit slot holder group row col column panel pane fixed sticky mobile desktop large small primary secondary".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_OWN_HEADER = re.compile(rf"(?:{'|'.join(sorted(_TEXT_NAMES))})[-_]*header", re.I)
_WORD = re.compile(r"[^\W\d_]+")


class Region(NamedTuple):
    """What the mark-up around a block says of it."""

    number: int = 0
    hidden: bool = False
    aside: str = ""  # marked as something other than the text: by "tag", by "form" or only by "name"
    text: bool = False  # marked as the text
    doubt: bool = False  # a lesser mark


def _name_says(value: str) -> tuple[bool, bool, bool]:
    """Of a class or id: is it a name of something else, of the text, or does it only mention something else?"""
    aside = text = mention = False
    for name in value.split():
        parts = [x.lower() for x in _NAME_PART.findall(name)]
        while len(parts) > 1 and (parts[-1] in _QUALIFIERS or parts[-1].isdigit()):
            parts.pop()
        if parts[-1:] == ["header"] and not _TEXT_NAMES.isdisjoint(parts):
            continue  # a text's own header
        if parts:
            aside |= parts[-1] in _ASIDE_NAMES
            text |= parts[-1] in _TEXT_NAMES
            mention |= not _ASIDE_NAMES.isdisjoint(parts)
    return aside, text, mention


def _region(tag: str, attributes: str, around: Region, number: int) -> Region:
    """The region that an element makes, or the one around it where the element says nothing new."""
    aside, text, doubt, hidden = around.aside, around.text, around.doubt, around.hidden
    if tag in _ASIDE_TAGS or (tag == "header" and not text and not _OWN_HEADER.search(attributes)):
        aside = "tag" if tag != "form" else aside if aside == "tag" else "form"
    elif tag in ("article", "main"):
        text = True
        aside = "" if aside == "form" else aside  # a form around a whole page is no form of its own
    if attributes and tag not in ("html", "body"):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN_STYLE.search(value)):
                hidden = True
            elif name == "role":
                aside = "tag" if value.lower() in _ASIDE_ROLES else aside
                text |= value.lower() in _TEXT_ROLES
            elif name == "itemprop":
                text |= value == "articleBody"
            elif name in ("class", "id"):
                other, own, mention = _name_says(value)
                if other and tag not in ("article", "main", *_HEADINGS):
                    aside = aside or "name"
                text |= own and not other
                doubt |= mention and not other
    if (aside, text, doubt, hidden) == around[2:] + around[1:2]:
        return around
    return Region(number, hidden, aside, text, doubt)


class Block:
    """Text between two block-level tags."""

    __slots__ = ("text", "region", "linked", "prose", "heading", "label")

    def __init__(self, text: str, region: Region, linked: int, prose: bool, heading: bool) -> None:
        self.text, self.region, self.linked, self.prose, self.heading, self.label = text, region, linked, prose, heading, ""


def _squeezed(pieces: list[str]) -> str:
    text = "".join(pieces)
    return " ".join((html_module.unescape(text) if "&" in text else text).split())


def blocks_of(page: str) -> tuple[list[Block], str]:
    """The blocks of a page in order, and its stated language."""
    out: list[Block] = []
    stack: list[tuple[str, Region]] = []  # open elements, without plain inline ones
    pieces: list[str] = []
    links: list[str] = []
    in_link, language, at, made = False, "", 0, 0
    whole = Region()

    def close() -> None:
        if pieces:
            region = stack[-1][1] if stack else whole
            text = "" if region.hidden else _squeezed(pieces)
            if text:
                tags = [x[0] for x in stack[-3:]]
                out.append(Block(text, region, len(_squeezed(links)) if links else 0, any(x in _PROSE for x in tags[-2:]), any(x in _HEADINGS for x in tags)))
            pieces.clear()
            links.clear()

    def add(text: str) -> None:
        if text:
            pieces.append(text)
            if in_link:
                links.append(text)

    position = 0
    search = _TAG.search
    while True:
        found = search(page, position)
        if found is None:
            add(page[position:])
            break
        at = found.start()
        add(page[position:at])
        position = found.end()
        slash, tag, attributes = found.group(1), found.group(2), found.group(3)
        if tag is None:
            slash, tag, attributes = found.group(4), found.group(5), found.group(6)
            if tag is None:
                continue
        tag = tag.lower()
        if tag == "a":
            in_link = not slash
        if tag == "br":
            add(" ")
            continue
        if slash:
            if tag in _INLINE:
                if any(x[0] == tag for x in stack[-1:]):
                    close()
                    stack.pop()
                continue
            close()
            if tag not in ("a",):
                in_link = False
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        around = stack[-1][1] if stack else whole
        if tag in _RAW:
            if not attributes.endswith("/"):
                end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, position)
                position = end.start() if end else len(page)
            continue
        if tag in _VOID:
            if tag not in ("img", "input", "wbr", "link", "meta", "source", "track"):
                close()
            continue
        if tag in _INLINE:
            # An inline element matters only where it is marked as no part of the text.
            if attributes and not attributes.endswith("/") and tag != "a":
                inner = _region(tag, attributes, around, made + 1)
                if (inner.aside and not around.aside) or (inner.hidden and not around.hidden):
                    close()
                    made += 1
                    stack.append((tag, inner))
            continue
        close()
        in_link = False
        if tag in _CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        if tag in _ITEMS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _ITEMS[tag]:
                    break
                if stack[k][0] == tag or (tag in ("td", "th") and stack[k][0] in ("td", "th")) or (tag in ("dt", "dd") and stack[k][0] in ("dt", "dd")):
                    del stack[k:]
                    break
        if tag == "html":
            language = next((a or b or c for n, a, b, c in _ATTRIBUTE.findall(attributes) if n.lower() == "lang"), "")
        if tag == "body":  # what the head left open ends here
            stack.clear()
        if not attributes.endswith("/"):
            inner = _region(tag, attributes, stack[-1][1] if stack else whole, made + 1)
            made += 1
            stack.append((tag, inner))
    close()
    return out, language[:2].lower()


_STOP_SETS = {k: frozenset(v.split()) for k, v in STOP_WORDS.items()}
_ALL_STOPS = frozenset().union(*_STOP_SETS.values())


def measured(block: Block, stops: frozenset[str] | None, link_limit: float = MAX_LINK_DENSITY) -> str:
    """What length, links and stop words say of a block: good, near, short, poor (few stop words), none (hardly any) or linked. ``stops``: None where none are known."""
    length = len(block.text)
    if block.linked > link_limit * length:
        return "linked"
    if length < LENGTH_LOW:
        return "linked" if block.linked and link_limit <= MAX_LINK_DENSITY else "short"
    share = 1.0
    if stops is not None:
        words = _WORD.findall(block.text.lower())
        share = sum(w in stops for w in words) / len(words) if words else 0.0
    if share >= STOPWORDS_HIGH:
        return "good" if length > LENGTH_HIGH else "near"
    return "near" if share >= STOPWORDS_LOW else "poor" if share >= STOPWORDS_LEAST else "none"


def _first_pass(block: Block, said: str) -> str:
    """good, bad, near or open: what a block's measures say under the limits of its region."""
    region = block.region
    if said == "linked":
        return "open" if region.text and block.prose else "bad"
    if said in ("poor", "none"):
        return "open" if region.text or (block.prose and said == "poor") else "bad"
    if said == "near" and region.doubt and not region.text:
        return "open"
    return said if said in ("good", "near") else "open"


def _nearest(labels: list[str], keys: list[int]) -> tuple[list[str], list[str]]:
    """For each block the nearest good or bad label before and after it in its region, or nothing where the region ends."""
    before, after = [""] * len(labels), [""] * len(labels)
    for side, order in ((before, range(len(labels))), (after, range(len(labels) - 1, -1, -1))):
        last: dict[int, str] = {}
        for i in order:
            side[i] = last.get(keys[i], "")
            if labels[i] in ("good", "bad"):
                last[keys[i]] = labels[i]
    return before, after


def _settled(block: Block, before: str, after: str, beside_near: bool) -> str:
    """The label of an open block between its nearest decided neighbours; nothing stands for the end of a region."""
    text = block.region.text
    if text:
        before, after = before or "good", after or "good"
    if not before or not after:
        return (before or after) if block.prose else "bad" if before or after else ""
    if before == after:
        return before
    if block.heading:  # belongs to what follows
        return after
    return "good" if text or block.prose or beside_near else "bad"


def _both_passes(blocks: list[Block], first: list[str]) -> list[str]:
    """good or bad for every block from its label after the first pass, or open in a region without a decided block."""
    keys = [b.region.number for b in blocks]
    before, after = _nearest(first, keys)
    second = list(first)
    for i, block in enumerate(blocks):
        if first[i] == "open":
            beside = i - 1 if before[i] == "bad" else i + 1
            near = 0 <= beside < len(first) and first[beside] == "near" and keys[beside] == keys[i]
            second[i] = _settled(block, before[i], after[i], near) or "open"
    before, after = _nearest(second, keys)
    for i, block in enumerate(blocks):
        if second[i] == "near":
            second[i] = "bad" if before[i] == after[i] == "bad" and not block.region.text else "good"
    return second


def labels_of(blocks: list[Block], language: str) -> list[str]:
    """good or bad for every block of a page's regions of text, by the two passes.

    A page of which nothing is good is read again with lower limits: there nearly
    good paragraphs are good, and if that gives nothing, all without links are.
    """
    stops = _STOP_SETS.get(language) if language else _ALL_STOPS
    first = [_first_pass(b, measured(b, stops, MENU_DENSITY if b.region.text else MAX_LINK_DENSITY)) for b in blocks]
    out = _both_passes(blocks, first)
    if "good" not in out:
        out = _both_passes(blocks, ["good" if x == "near" and b.prose else x for b, x in zip(blocks, first)])
    if "good" not in out:
        out = ["good" if b.prose and x != "bad" else "bad" for b, x in zip(blocks, first)]
    return ["bad" if x == "open" else x for x in out]


def classify(blocks: list[Block], language: str) -> None:
    """Give every block the label good or bad."""
    stops = _STOP_SETS.get(language) if language else _ALL_STOPS
    names_count = any(b.region.text or (not b.region.aside and measured(b, stops) == "good") for b in blocks)
    inner = []
    for block in blocks:
        block.label = "bad"
        if not block.region.aside or (block.region.aside == "name" and not names_count):
            inner.append(block)
    for block, label in zip(inner, labels_of(inner, language)):
        block.label = label


def main_text(page: str | None) -> str:
    """The good blocks of a page, in order, a line each."""
    if not page:
        return ""
    blocks, language = blocks_of(page)
    classify(blocks, language)
    return "\n".join(b.text for b in blocks if b.label == "good")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points), a row per row of ``pages`` (page_id, url, html)."""
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return held.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
