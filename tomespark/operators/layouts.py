"""Result lists of web pages, learned for each host.

A list shows in the mark-up: children of one element with one signature (tag and
classes), three or more, of which most hold a link of their own. Where pages lie,
each of their lists is measured; Spark scores the lists, adds up the scores of a
layout over all pages of a host, and the best layout of a host is read off all of
its pages, also those with one or two results. A page on which it finds nothing is
read by its own best list.

A layout is the signature of the list's element with up to two elements around
it, and the signature of an item. Lists in menus, headers, footers and sidebars
are used only where a host, or a page, has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What a list must have, and how lists are weighed.
LEAST, LINKED, SHORT, LONG, ITEMS, CHROME = 3, 0.6, 8, 300, 1.5, 0.3
# Fixed value: elements around a page's content.
CHROME_TAGS = ("nav", "header", "footer", "aside")
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": ("li",), "p": ("p",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_WALLS = frozenset("ul ol dl table select div section article body".split())

LISTS = "target string, host string, parent string, item string, at int, members int, results int, hrefs int, chars long, items int, chrome boolean"
RESULTS = "target string, n int, title string, url string, extra string"


class _Node:
    __slots__ = ("tag", "sig", "parent", "text", "links", "end", "links_end")

    def __init__(self, tag: str, sig: str, parent: int, text: int, links: int) -> None:
        self.tag, self.sig, self.parent, self.text, self.links, self.end, self.links_end = tag, sig, parent, text, links, -1, -1


class _Tree(HTMLParser):
    """The elements of a page, with the range of its text and links that each holds."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[_Node] = []
        self.open: list[int] = []
        self.pieces: list[str] = []
        self.links: list[list] = []  # address, text, within a heading
        self.link: int | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.open and (last := self.nodes[self.open[-1]].tag) in _CLOSES.get(tag, ()) and last not in _WALLS:
            self._close()
        named = dict(attrs)
        sig = ".".join([tag, *sorted((named.get("class") or "").split())])
        self.nodes.append(_Node(tag, sig, self.open[-1] if self.open else -1, len(self.pieces), len(self.links)))
        self.open.append(len(self.nodes) - 1)
        if tag == "a" and "href" in named:
            heading = any(len(t) == 2 and t[0] == "h" and t[1] in "123456" for t in (self.nodes[i].tag for i in self.open))
            self.link = len(self.links)
            self.links.append([named["href"] or "", [], heading])
        if tag in _EMPTY:
            self._close()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _EMPTY:
            self.handle_endtag(tag)

    def _close(self) -> None:
        node = self.nodes[self.open.pop()]
        node.end, node.links_end = len(self.pieces), len(self.links)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.link = None
        if any(self.nodes[i].tag == tag for i in self.open):
            while self.nodes[self.open[-1]].tag != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if self.open and self.nodes[self.open[-1]].tag in ("script", "style"):
            return
        self.pieces.append(data)
        if self.link is not None:
            self.links[self.link][1].append(data)

    def whole(self, page: str | None) -> _Tree:
        self.feed(page or "")
        self.close()
        while self.open:
            self._close()
        return self

    def path(self, i: int) -> str:
        """The signature of an element and up to two around it, outermost first."""
        parts: list[str] = []
        while i >= 0 and len(parts) < 3:
            parts.append(self.nodes[i].sig)
            i = self.nodes[i].parent
        return " > ".join(reversed(parts))

    def in_chrome(self, i: int) -> bool:
        while i >= 0:
            if self.nodes[i].tag in CHROME_TAGS:
                return True
            i = self.nodes[i].parent
        return False

    def groups(self) -> dict[tuple[int, str], list[_Node]]:
        """Children by parent and signature, in the order of the page."""
        out: dict[tuple[int, str], list[_Node]] = {}
        for node in self.nodes:
            if node.parent >= 0:
                out.setdefault((node.parent, node.sig), []).append(node)
        return out

    def text(self, node: _Node) -> str:
        return _squeezed("".join(self.pieces[node.text : node.end]))


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def host_of(address: str | None) -> str:
    try:
        return (urlsplit(address or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def _same_site(a: str, b: str) -> bool:
    return a == b or a.endswith(f".{b}") or b.endswith(f".{a}")


def _result(tree: _Tree, node: _Node, base: str) -> tuple[str, str, str, str] | None:
    """Title, address, what else an item says, and its whole text; the link is the one in a heading, or with the longest text."""
    best, most = None, -1
    for address, pieces, heading in tree.links[node.links : node.links_end]:
        address = address.strip()
        if not address or address.startswith("#") or address.lower().startswith("javascript:"):
            continue
        title = _squeezed("".join(pieces))
        score = len(title) + 1000 * heading
        if len(title) < 3 or score <= most:
            continue
        try:
            to = urldefrag(urljoin(base, address)).url
            if urlsplit(to).scheme in ("http", "https") and _same_site(host_of(to), host_of(base)):
                best, most = (title, to), score
        except ValueError:
            continue
    if best is None:
        return None
    text = tree.text(node)
    extra = _squeezed(text.replace(best[0], "", 1)).strip(" ,;·-–—|")
    return *best, extra if len(extra) <= 160 else extra[:157] + "…", text


def _measured(tree: _Tree, base: str) -> Iterator[tuple]:
    """A row for each list of a page."""
    depth = urlsplit(base).path.strip("/").count("/")
    for (parent, item), members in tree.groups().items():
        if len(members) < LEAST:
            continue
        found = [r for r in (_result(tree, m, base) for m in members) if r]
        parts = [urlsplit(r[1]) for r in found]
        items = sum(any(c.isdigit() for c in p.path + p.query) or p.path.strip("/").count("/") >= depth for p in parts)
        chars = sum(min(len(r[3]), LONG) for r in found)
        yield tree.path(parent), item, parent, len(members), len(found), len({r[1] for r in found}), chars, items, tree.in_chrome(parent)


def _address(url: str | None) -> str:
    try:
        urlsplit(url or "")
    except ValueError:
        return ""
    return url or ""


def lists(pages: DataFrame) -> DataFrame:
    """The lists of pages (target, url, html), measured where the pages lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LISTS.split(", ")]
        for batch in batches:
            rows = []
            for target, url, page in zip(batch["target"], batch["url"], batch["html"]):
                base = _address(url)
                rows += [(target, host_of(base), *r) for r in _measured(_Tree().whole(page), base)]
            yield pd.DataFrame(rows, columns=names)

    return pages.select("target", "url", "html").mapInPandas(run, LISTS)


def scored(found: DataFrame) -> DataFrame:
    """Lists that can be result lists, with their score."""
    mean = F.col("chars") / F.col("results")
    fit = found.where((F.col("results") >= LEAST) & (F.col("hrefs") >= LEAST) & (F.col("results") >= LINKED * F.col("members"))).where(mean >= SHORT)
    score = F.col("chars") * F.when(F.col("items") * 2 >= F.col("results"), ITEMS).otherwise(1.0) * F.when(F.col("chrome"), CHROME).otherwise(1.0)
    return fit.withColumn("score", score)


def learned(fit: DataFrame) -> DataFrame:
    """(host, parent, item, pages, score): the layout of each host, by the scores of all its pages."""
    sums = fit.groupBy("host", "parent", "item", "chrome").agg(F.count_distinct("target").alias("pages"), F.sum("score").alias("score"))
    best = Window.partitionBy("host").orderBy("chrome", F.desc("score"), "parent", "item")
    return sums.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("host", "parent", "item", "pages", "score")


def own_layouts(fit: DataFrame) -> DataFrame:
    """(target, own_parent, own_item): the best list of each page; of equal ones the first."""
    best = Window.partitionBy("target").orderBy("chrome", F.desc("score"), "at", "item")
    return fit.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("target", F.col("parent").alias("own_parent"), F.col("item").alias("own_item"))


def _read_off(tree: _Tree, base: str, parent: str | None, item: str | None) -> list[tuple[str, str, str]]:
    if not parent or not item:
        return []
    out = []
    for (i, sig), members in tree.groups().items():
        if sig == item and tree.path(i) == parent:
            out += [r[:3] for r in (_result(tree, m, base) for m in members) if r]
    return out


def results(pages: DataFrame, layouts: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(target, n, title, url, extra): what the layouts of their hosts find on pages (target, host, url, html), and where that is nothing their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULTS.split(", ")]
        for batch in batches:
            rows = []
            for target, url, page, parent, item, own_parent, own_item in batch.itertuples(index=False):
                tree, base = _Tree().whole(page), _address(url)
                found = _read_off(tree, base, parent, item) or _read_off(tree, base, own_parent, own_item)
                rows += [(target, n, *r) for n, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=names)

    laid = pages.join(layouts.select("host", "parent", "item"), "host", "left")
    nothing = F.lit(None).cast("string")
    laid = laid.withColumns({"own_parent": nothing, "own_item": nothing}) if own is None else laid.join(own, "target", "left")
    return laid.select("target", "url", "html", "parent", "item", "own_parent", "own_item").mapInPandas(run, RESULTS)
