"""Stories inside a book's page, and books without their wrapping; all in the JVM.

A page becomes tag rows, each with the text before it. Headings, anchors and links
are told by windows over the rows of their own page; a link is joined to its
anchor, the anchor to the heading that it stands in or right before, and a piece
runs from there to the next heading of its rank or higher.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomespark.operators.repair import TITLE_SMALL, pieces

# The fewest and most words of a piece.
LEAST_WORDS, MOST_WORDS = 700, 25_000
# What a contents list names that is no story, chapters of one, and parts of a serial.
NOT_PIECE = (
    r"(?i)\b(contents|illustrations?|preface|introduction|introductory|foreword|prefatory|index|notes|footnotes|"
    r"transcriber|advertis\w*|appendix|glossary|errata|bibliography|readers'? corner|correspondence|letters to|the eyrie|"
    r"book reviews?|reviews|announcements?|list of|table of|chronolog\w*|acknowledg\w*|dedication|frontispiece|title page|"
    r"copyright|cover design|editor'?s? (table|drawer|easy chair|note)|literary notices|monthly record|science and arts|"
    r"notices to correspondents|answers to correspondents|poetry|verses|poems|sonnets)\b"
)
CHAPTER = r"(?i)^(chapter|book|part|section|canto|letter|scene|act|stave|fytte)\b|^[ivxlcdm]+\.?$|^\d+\.?$"
SERIAL = (
    r"(?i)\b(part[- ]novel|(beginning|conclusion|end) of|in (two|three|four|five|six) parts|"
    r"part (one|two|three|four|five|i|ii|iii|iv|v|\d) of|to be continued|concluded from|continued from|"
    r"(second|third|fourth|fifth|final|last) (part|instal+ment)|(part|chapter)s? [ivx\d]+ (to|and|-) [ivx\d]+)\b"
)
# The marks around a book's text, and what stands for a picture.
WRAP_START, WRAP_END = r"\*\*\*\s*START OF (THE|THIS) PROJECT GUTENBERG", r"\*\*\*\s*END OF (THE|THIS) PROJECT GUTENBERG"
END_MARK = "*** END OF"
_TAG = r"(?s)<!--.*?-->|<[^>]*>"


def _attribute(tag: Column, names: str) -> Column:
    found = lambda quote: F.regexp_extract(tag, rf"(?is)\s(?:{names})\s*=\s*{quote}", 1)
    return F.coalesce(*(F.nullif(found(q), F.lit("")) for q in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")))


def unescaped(text: Column) -> Column:
    """The commonest character references as what they stand for."""
    for name, sign in (("nbsp", " "), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return text


def tags(pages: DataFrame) -> DataFrame:
    """(target, n, gap, tag, level, closes, id, to): the tags of pages (target, html) with the text before each; after the last tag a row without one."""
    rows = pages.select("target", F.posexplode(pieces(F.coalesce("html", F.lit("")), _TAG)).alias("n", "p"))
    raw = F.coalesce(F.col("p.match"), F.lit(""))
    name = F.lower(F.regexp_extract(raw, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    closes = raw.startswith("</")
    level = F.nullif(F.regexp_extract(name, "^h([1-4])$", 1), F.lit("")).cast("int")
    to = F.when((name == "a") & ~closes, F.nullif(F.regexp_extract(_attribute(raw, "href"), "^#(.+)$", 1), F.lit("")))
    return rows.select("target", "n", F.col("p.gap").alias("gap"), name.alias("tag"), level.alias("level"), closes.alias("closes"), F.when(~closes, _attribute(raw, "id|name")).alias("id"), to.alias("to"))


def title_of(text: Column) -> Column:
    """Titles in capitals are set in title case, with small words small."""
    words = F.split(F.lower(text), " ")
    big = lambda w: F.regexp_replace(w, "[a-z].*$", "")  # noqa: E731  what stands before the first letter
    lead = lambda w: F.concat(big(w), F.upper(F.substring(w, F.char_length(big(w)) + 1, F.lit(1))), F.substring(w, F.char_length(big(w)) + 2, F.char_length(w)))
    cased = F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*TITLE_SMALL), w).otherwise(lead(w))), " ")
    return F.when(F.upper(text) == text, cased).otherwise(text)


def stories(pages: DataFrame, least: int = LEAST_WORDS, most: int = MOST_WORDS) -> DataFrame:
    """(target, id, title, begin, end, words): what the contents of a page (target, html) link to that is a whole story of a length to read.

    ``begin`` and ``end`` number the tags that a story lies between; end is null for the end of the page.
    """
    order = Window.partitionBy("target").orderBy("n")
    so_far, later = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    rows = tags(pages)
    heads = F.col("level").isNotNull() & ~F.col("closes")
    filled = F.when(F.regexp_replace("gap", r"(?U)\s+", "") != "", 1).otherwise(0)
    told = rows.withColumns(
        {
            "said": F.sum(filled).over(so_far),
            "open": F.last(F.when(heads, F.col("n")), True).over(so_far),
            "shut": F.last(F.when(F.col("level").isNotNull() & F.col("closes"), F.col("n")), True).over(so_far),
            "link": F.last(F.when(F.col("to").isNotNull(), F.col("n")), True).over(so_far),
            "unlink": F.last(F.when((F.col("tag") == "a") & (F.col("closes") | F.col("to").isNull()), F.col("n")), True).over(so_far),
        }
    )
    next_head = F.first(F.when(heads, F.struct("n", "said")), True).over(later)
    ends = {f"end{k}": F.first(F.when(heads & (F.col("level") <= k), F.col("n")), True).over(later) for k in (2, 3, 4)}
    inside = F.col("open").isNotNull() & (F.col("shut").isNull() | (F.col("shut") < F.col("open")) | (F.col("shut") == F.col("n")))
    told = told.withColumn("next", next_head).withColumns(ends)
    told = told.withColumn("head", F.when(inside, F.col("open")).when(F.col("next.said") == F.col("said"), F.col("next.n")))
    anchors = told.where("id IS NOT NULL").groupBy("target", "id").agg(F.min(F.struct("n", "head")).alias("a")).select("target", F.col("id").alias("to"), F.col("a.n").alias("at"), F.col("a.head").alias("head")).where("head IS NOT NULL")
    in_link = F.col("link").isNotNull() & (F.col("unlink").isNull() | (F.col("unlink") < F.col("link")))
    # The text before a tag is a link's when the tag before it left one open.
    spans = told.withColumn("of", F.lag(F.when(in_link, F.col("link"))).over(order)).where("of IS NOT NULL")
    texts = spans.groupBy("target", F.col("of").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("k"), "gap"))).alias("t"))
    squeezed = F.trim(F.regexp_replace(unescaped(F.array_join(F.transform("t", lambda x: x["gap"]), "")), r"(?U)\s+", " "))
    links = told.where("to IS NOT NULL").select("target", "n", "to").join(texts.select("target", "n", squeezed.alias("text")), ["target", "n"])
    # Of the links to one heading the first decides; links back are none.
    first = links.join(anchors, ["target", "to"]).where(F.col("at") > F.col("n")).groupBy("target", "head").agg(F.min_by(F.struct("to", "text"), "n").alias("l"))
    named = first.select("target", "head", F.col("l.to").alias("id"), F.col("l.text").alias("title")).where((F.col("title") != "") & ~F.col("title").rlike(NOT_PIECE) & ~F.col("title").rlike(CHAPTER))
    headings = told.where(heads).select("target", F.col("n").alias("head"), "level", F.when(F.col("level") == 2, F.col("end2")).when(F.col("level") == 3, F.col("end3")).otherwise(F.col("end4")).alias("end"))
    pieces_ = named.join(headings, ["target", "head"]).where("level > 1")
    # Pieces of one page may lie within each other, so their text is gathered for each.
    gaps = told.select("target", "n", "gap").where("gap <> ''")
    held = pieces_.join(gaps, "target").where((F.col("n") > F.col("head")) & (F.col("end").isNull() | (F.col("n") <= F.col("end"))))
    bodies = held.groupBy("target", "head", "id", "title", "end").agg(F.array_sort(F.collect_list(F.struct("n", "gap"))).alias("t"))
    text = unescaped(F.substring_index(F.array_join(F.transform("t", lambda x: x["gap"]), " "), END_MARK, 1))
    counted = bodies.withColumn("text", text).withColumn("words", F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")))
    whole = counted.where(F.col("words").between(least, most) & ~F.col("text").rlike(SERIAL))
    return whole.select("target", "id", title_of(F.col("title")).alias("title"), F.col("head").alias("begin"), "end", "words")


def unwrapped(blocks: DataFrame) -> DataFrame:
    """Blocks (target, block_no, text, ...) without the wrapping of a book: what stands up to its start mark and from its end mark on, and marks for pictures. Books without marks are left as they are."""
    own = Window.partitionBy("target")
    ends = blocks.withColumn("_end", F.min(F.when(F.col("text").rlike(WRAP_END), F.col("block_no"))).over(own))
    before = F.col("_end").isNull() | (F.col("block_no") < F.col("_end"))
    starts = ends.withColumn("_start", F.min(F.when(before & F.col("text").rlike(WRAP_START), F.col("block_no"))).over(own))
    marked = F.col("_start").isNotNull() | F.col("_end").isNotNull()
    inner = (F.col("_start").isNull() | (F.col("block_no") > F.col("_start"))) & before & (F.btrim(F.trim("text"), F.lit("[]")) != "Illustration")
    return starts.where(~marked | F.coalesce(inner, F.lit(True))).drop("_start", "_end")
