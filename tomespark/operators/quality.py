"""Judging pages by rule, and mending scanned text.

A page is a set of block rows (target, block_no, kind, in_list, text, link_words,
set_lines, set_words) with kind one of paragraph, heading, pre, cell; the last two
count the lines with words, and their words, of paragraphs set in three lines or
more. Measures are one aggregation over the blocks; verdicts are expressions over
the measures.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomespark.functions.text import collapse_space, sentence_end
from tomespark.operators.repair import replaced, with_value
from tomespark.sources.shared import told

LONG_PARAGRAPH = 30
VERSE_LINE, VERSE_LINES, STANZA = 10.0, 4, 3
CLEAN_WORDS = 150
# Fixed value: where the poetry sites keep their poems.
POEM_ADDRESS = r"poets\.org/poem/|poetryfoundation\.org/poems/"

# The fewest words of a page of each shelf.
SHELF_BARS = {"literature": 600, "fiction": 600, "weird": 600, "knowledge": 600, "print": 600, "esoteric": 400, "nature": 400, "sufism": 300, "folklore": 300, "encyclopedic": 300, "textfiles": 200, "smallweb": 200, "underground": 200}
DEFAULT_BAR = 300
INFORMAL = ("textfiles", "smallweb", "underground")
# What the texts of error pages say.
ERROR_WORDS = ["404", "not found", "access denied", "forbidden", "enable javascript", "just a moment", "page not found", "error"]
# Fixed value: titles of lists, reviews, news, indexes and galleries.
NOT_WHOLE = (
    r"(?i)^(\d{1,3}|ten|five|seven|eight|nine|twelve|fifteen|twenty)\s+(\S+\s+){0,4}?(books|novels|stories|poems|poets|essays|writers|authors|memoirs|collections|works|titles|reads|things|ways|reasons|films|movies|graphic novels|picks)\b"
    r"|\b(books|novels|stories|reads) (about|for|to read|that|you should|we can't wait)\b"
    r"|^(book )?reviews?\b|\breview:|\bin review\b|\ba review of\b|\breviewed\b"
    r"|\b(event|conference|symposium|seminar) report\b|\breport on the\b.*\b(event|conference|symposium|seminar|meeting)\b"
    r"|^news\b|\bnews (roundup|digest|briefs?)\b|\b(roundup|round-up|this week in|week in review|what we're reading|newsletter)\b"
    r"|\b(gallery|galleries|index of|table of contents|site ?map|bibliography)\b"
    r"|^(encyclopedia|dictionary|glossary|index)\s+[a-z](-[a-z])?$|^contents$|^index$|^home$|^welcome\b"
)
# Every title that NOT_WHOLE finds holds one of these in small letters; they are sought much faster.
NOT_WHOLE_STEMS = "books novels stories poems poets essays writers authors memoirs collections works titles reads things ways reasons films movies picks review report news roundup round-up galler index contents site bibliography encyclopedia dictionary glossary home welcome".split() + ["this week in", "what we're reading"]
# The marks before a text's first word, and what separates the parts of a title.
_OPEN_MARKS = r"^(?:[\s\"“‘'(*_—–]|\[[^\]]{0,20}\]|\d+\s)+"
_TITLE_PARTS = r"\s*(?:[-|–—]|--)\s+"


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def plain_blocks(docs: DataFrame) -> DataFrame:
    """Block rows of plain text documents (target, title, text): a paragraph for every line with a word.

    A line is set when it lies in a run of STANZA lines or more without a blank one.
    """
    split = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), collapse_space)
    held = docs.select("target", split.alias("l"))
    filled = lambda at: F.when(at >= 0, F.coalesce(F.get("l", at) != "", F.lit(False))).otherwise(False)
    run = lambda i: (filled(i - 2) & filled(i - 1)) | (filled(i - 1) & filled(i + 1)) | (filled(i + 1) & filled(i + 2))
    lines = held.select("target", F.posexplode(F.transform("l", lambda x, i: F.struct(x.alias("text"), run(i).alias("set")))).alias("block_no", "x")).where("x.text <> ''")
    text = F.col("x.text")
    # Blanks are single spaces here, and none stands at an end.
    words = (F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("int")
    return lines.select("target", "block_no", F.lit("paragraph").alias("kind"), F.lit(False).alias("in_list"), text.alias("text"), F.lit(0).alias("link_words"), F.when(F.col("x.set"), 1).otherwise(0).alias("set_lines"), F.when(F.col("x.set"), words).otherwise(0).alias("set_words"), words.alias("words"))


def measures(blocks: DataFrame) -> DataFrame:
    """One row per page: words by kind, paragraph shares, first and last paragraph. Blocks may bring their words counted."""
    w = F.col("words") if "words" in blocks.columns else n_words(F.col("text"))
    prose = F.col("kind").isin("paragraph", "pre") & ~F.col("in_list")
    rows = blocks.withColumn("w", w).withColumn("prose", prose)
    opened = F.regexp_replace("text", _OPEN_MARKS, "")
    lower = opened.rlike(r"^\p{Ll}")
    counted = F.col("prose") & (F.col("w") >= 8)
    return rows.groupBy("target").agg(
        F.sum(F.when(F.col("prose"), F.col("w")).otherwise(0)).alias("prose"),
        F.sum(F.when(~F.col("prose") & (F.col("kind") != "heading"), F.col("w")).otherwise(0)).alias("list_words"),
        F.sum(F.when(F.col("kind") == "heading", F.col("w")).otherwise(0)).alias("head_words"),
        F.sum("link_words").alias("link_words"),
        F.count_if(F.col("prose")).alias("paras"),
        F.sum("set_lines").alias("set_lines"),
        F.sum("set_words").alias("set_words"),
        F.sum(F.when(F.col("prose") & (F.col("w") >= LONG_PARAGRAPH), F.col("w")).otherwise(0)).alias("long_words"),
        F.count_if(counted).alias("starts"),
        F.count_if(counted & lower).alias("lower_starts"),
        F.min_by(F.col("text"), F.when(counted, F.col("block_no"))).alias("first"),
        F.max_by(F.col("text"), F.when(F.col("prose") & (F.col("w") >= LONG_PARAGRAPH) & (F.col("kind") == "paragraph"), F.col("block_no"))).alias("last"),
    )


def not_whole_title(title: Column) -> Column:
    """A part of the title says that the page is not a whole piece."""
    parts = F.exists(F.split(title, _TITLE_PARTS), lambda p: p.rlike(NOT_WHOLE))
    return with_value(F.lower(title), lambda low: F.when(reduce(or_, [F.contains(low, F.lit(s)) for s in NOT_WHOLE_STEMS]), parts).otherwise(F.when(title.isNotNull(), False)))


def opens_badly(first: Column) -> Column:
    rest = F.regexp_replace(first, _OPEN_MARKS, "")
    return (rest != "") & rest.rlike(r"^[\p{Ll},;.)\-]")


def cut_off(last: Column) -> Column:
    trimmed = F.regexp_replace(last, r"[ \t*]+$", "")
    return (trimmed != "") & ~sentence_end(trimmed) & trimmed.rlike(r"[\p{Ll},\-]$")


def opens_on(first: Column, title: Column) -> Column:
    """The text opens on the first word of its title, as an entry does on its headword."""
    head = F.split(F.lower(F.trim(title)), " ")[0]
    return (head != "") & F.startswith(F.lower(F.regexp_replace(first, _OPEN_MARKS, "")), head)


def with_clean(measured: DataFrame, blocks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The measures with ``clean``, the share of a page's prose that the vocabulary has; null for fewer than CLEAN_WORDS words."""
    prose = blocks.where(F.col("kind").isin("paragraph", "pre") & ~F.col("in_list")).select("target", "text")
    enough = F.when(F.col("known") + F.col("unknown") >= CLEAN_WORDS, F.col("clean"))
    return measured.join(cleanliness(prose, vocabulary).select("target", enough.alias("clean")), "target", "left")


def verdicts(measured: DataFrame, family: Column, title: Column, address: Column | None = None, headword: Column | None = None) -> DataFrame:
    """words, shares and the reasons against a page, in a fixed order; no reason means that it passes.

    ``clean`` comes from with_clean(); measures without it, or with null, are never garbled.
    ``headword`` is the title that an entry may open on in small letters.
    """
    clean = F.col("clean") if "clean" in measured.columns else F.lit(None).cast("double")
    poem = F.lit(False) if address is None else F.coalesce(address.rlike(POEM_ADDRESS), F.lit(False))
    set_short = (F.col("set_lines") >= VERSE_LINES) & (F.col("set_words") * 2 >= F.col("prose")) & (F.col("set_words") <= VERSE_LINE * F.col("set_lines"))
    verse = set_short | poem
    starts_badly = opens_badly(F.col("first"))
    if headword is not None:
        starts_badly = starts_badly & ~F.coalesce(opens_on(F.col("first"), headword), F.lit(False))
    words = F.col("prose") + F.col("list_words")
    everything = words + F.col("head_words") + F.col("link_words")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    bars = F.create_map(*[F.lit(x) for pair in SHELF_BARS.items() for x in pair])
    out = measured.withColumns({"words": words, "bar": F.coalesce(F.try_element_at(bars, family), F.lit(DEFAULT_BAR)), "link_share": share(F.col("link_words"), everything), "list_share": share(F.col("list_words") + F.col("head_words"), everything), "long_share": share(F.col("long_words"), F.col("prose"))})
    low = F.lower(F.concat_ws(" ", title, F.coalesce("first", F.lit(""))))
    error = (F.col("words") < 300) & F.exists(F.array(*map(F.lit, ERROR_WORDS)), lambda e: F.contains(low, e))
    formal = ~family.isin(*INFORMAL)
    small_hand = (F.col("starts") >= 3) & (F.col("lower_starts") * 2 > F.col("starts"))
    reasons = [
        F.when(error, "error page"),
        F.when(F.when(verse, (F.col("set_lines") < VERSE_LINES) & (F.col("words") < 40)).otherwise(F.col("words") < F.col("bar")), "short"),
        F.when(F.col("link_share") > 0.5, "links"),
        F.when(F.col("list_share") > 0.6, "lists"),
        F.when(~verse & (F.col("words") >= 50) & (F.col("long_share") < 0.2), "fragments"),
        F.when(~verse & not_whole_title(title), "title"),
        F.when(formal & ~verse & ~small_hand & F.coalesce(starts_badly, F.lit(False)), "starts mid-text"),
        F.when(formal & ~verse & (F.col("words") < 3000) & F.coalesce(cut_off(F.col("last")), F.lit(False)), "ends mid-text"),
        F.when(formal & (F.col("words") >= 400) & (clean >= 0.5) & (clean < 0.7), "garbled"),
    ]
    return out.withColumn("verse", verse).withColumn("reasons", F.array_compact(F.array(*reasons)))


def cleanliness(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(target, known, unknown, clean): the share of a text's plain words that the vocabulary has.

    A vocabulary that may be told to every task is looked up where the words lie,
    and only counts are shuffled. Else words are counted per document before it is joined.
    """
    words = docs.select("target", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), 0)).alias("word"))
    known, small = told(vocabulary.select("word", F.lit(True).alias("_k")))
    own = words.withColumn("n", F.lit(1)) if small else words.groupBy("target", "word").agg(F.count("*").alias("n"))
    marked = own.join(known, "word", "left")
    counts = marked.groupBy("target").agg(F.sum(F.when(F.col("_k"), F.col("n")).otherwise(0)).alias("known"), F.sum(F.when(F.col("_k").isNull(), F.col("n")).otherwise(0)).alias("unknown"))
    return counts.withColumn("clean", F.col("known") / (F.col("known") + F.col("unknown")))


# The commonest words of English.
SMALL_WORDS = """the of and to a in is that it was he for on are as with his they i at be this from or
had by not but what all were when we there can an your which their said if do will each about how up out them then
she many some so these would other into has her two like him see time could no make than first been its who now
people my made over did down only way find use may water long little very after""".split()


def readable(text: Column) -> Column:
    """Whether a text reads as printed English: enough words of plain shape, small words, few digits, and no more of the letter f than print without a long s has."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""))
    n, joined = F.size(words), F.array_join(bare, "")
    plain = F.size(F.filter(bare, lambda w: w.rlike(r"^[\p{L}'’-]+$") & F.regexp_count(w, F.lit(r"\p{L}")).between(1, 14)))
    small = F.size(F.filter(bare, lambda w: F.lower(w).isin(*SMALL_WORDS)))
    letters, f, digits = (F.regexp_count(joined, F.lit(x)) for x in (r"\p{L}", "[fF]", r"\p{Nd}"))
    total = F.char_length(joined)
    shaped = (plain >= 0.8 * n) & (letters >= 3 * n) & (letters <= 9 * n) & (letters * 10 >= total * 9)
    return (n >= 40) & shaped & (small >= 0.33 * n) & (f <= 0.043 * F.greatest(letters, F.lit(1))) & (digits <= 0.02 * F.greatest(total, F.lit(1)))


#: Words that sell: a choice of this library.
AD_WORDS = "buy sale discount offer price order shipping free subscribe deal coupon shop cart checkout save".split()


def ad_share(text: Column) -> Column:
    """The share of a text's words that sell."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.isin(*AD_WORDS))) / F.size(words)).otherwise(0.0)


def joined_paragraphs(lines: DataFrame) -> DataFrame:
    """Lines (target, n, text) made paragraphs: one that stops on no sentence goes on in a next one that starts small."""
    order = Window.partitionBy("target").orderBy("n")
    before = F.lag("text").over(order)
    goes_on = before.isNotNull() & ~sentence_end(before) & F.col("text").rlike(r"^\p{Ll}")
    numbered = lines.withColumn("_p", F.sum(F.when(goes_on, 0).otherwise(1)).over(order))
    rows = numbered.groupBy("target", "_p").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("l"))
    return rows.select("target", F.col("_p").alias("paragraph"), F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"))


def without_running_heads(pages: DataFrame, share: float = 0.6, least_pages: int = 4) -> DataFrame:
    """Pages (book, page, lines) without first and last lines that repeat over a book, digits aside, and bare numbers there."""
    norm = lambda x: F.regexp_replace(F.lower(F.trim(x)), r"\d+", "#")
    ends = pages.select("book", "page", norm(F.get("lines", F.lit(0))).alias("head"), norm(F.element_at("lines", -1)).alias("foot"))
    size = ends.groupBy("book").agg(F.count("*").alias("pages"))
    heads = ends.groupBy("book", F.col("head").alias("line")).agg(F.count("*").alias("n")).withColumn("at", F.lit("head"))
    feet = ends.groupBy("book", F.col("foot").alias("line")).agg(F.count("*").alias("n")).withColumn("at", F.lit("foot"))
    often = heads.unionByName(feet).join(size, "book").where((F.col("pages") >= least_pages) & (F.col("n") * 10 >= F.col("pages") * share * 10)).select("book", "line", "at")
    bare = lambda x: x.rlike(r"^#$")
    marked = (
        pages.withColumns({"_h": norm(F.get("lines", F.lit(0))), "_f": norm(F.element_at("lines", -1))})
        .join(often.where("at = 'head'").select("book", F.col("line").alias("_h"), F.lit(True).alias("_dh")), ["book", "_h"], "left")
        .join(often.where("at = 'foot'").select("book", F.col("line").alias("_f"), F.lit(True).alias("_df")), ["book", "_f"], "left")
    )
    first = F.when(F.coalesce("_dh", F.lit(False)) | bare(F.col("_h")), 2).otherwise(1)
    last = F.when(F.coalesce("_df", F.lit(False)) | bare(F.col("_f")), F.size("lines") - 1).otherwise(F.size("lines"))
    return marked.select("book", "page", F.slice("lines", first, F.greatest(last - first + 1, F.lit(0))).alias("lines"))


# Cyrillic letters that scans put for Latin ones, in the order of the pairs.
LOOKALIKE_FROM, LOOKALIKE_TO = "АВСЕНІКМОРТХУасеіорхукптвнГг", "ABCEHIKMOPTXYaceiopxyknmbhIr"
# Ligatures, doubled quotes and hyphens of other kinds.
MARK_PAIRS = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "‘‘": "“", "’’": "”", "``": "“", "''": '"'}
# Single marks; those without a counterpart go.
MARK_FROM, MARK_TO = "|¬\u00ad_~^", " --"
# Contractions of I as a typewriter face is read.
CONTRACTIONS = {"Pll|TIl|Tll": "I'll", "Pd": "I'd", "Pm": "I'm", "Pve": "I've"}
# Verbs before which a lone T is an I.
I_VERBS = "never was am have had will would think know can could do did shall must should see want guess suppose mean say said hope wish thought".split()
# Small words that a scan may give a capital.
CAPITAL_SMALL = "Is In Its It If Of On To As At By And But Or".split()


def latin(text: Column) -> Column:
    """Lookalike letters, ligatures and marks as print has them."""

    def paired(t: Column) -> Column:
        for pair, mark in MARK_PAIRS.items():
            t = F.replace(t, F.lit(pair), F.lit(mark))
        return t

    # One search for a ligature or a doubled mark takes less than nine.
    text = with_value(text, lambda t: F.when(t.rlike(r"[\ufb00-\ufb04]|([‘’`'])\1"), paired(t)).otherwise(t))
    # Letters are translated one by one, which takes long, and most texts have none of them: Cyrillic ones are sought as one range.
    return with_value(text, lambda t: F.when(t.rlike(rf"[\u0400-\u04ff{re.escape(MARK_FROM)}]"), F.translate(t, LOOKALIKE_FROM + MARK_FROM, LOOKALIKE_TO + MARK_TO)).otherwise(t))


def _where(text: Column, held: list[str], mend: Callable[[Column], Column]) -> Column:
    """``mend`` of a text that holds one of some strings, which are sought much faster than a pattern is; the text is computed once."""
    return with_value(text, lambda t: F.when(reduce(or_, [F.contains(t, F.lit(h)) for h in held]), mend(t)).otherwise(t))


def mended_marks(text: Column) -> Column:
    """A paragraph with the small marks of a scan mended; words are left to the repair by vocabulary.

    Most texts hold few of the marks, so patterns are tried only where what they must hold is there.
    """
    out = _where(latin(text), [w + m for w in "Ww" for m in "'’-"], lambda t: F.regexp_replace(t, r"\b([Ww])['’-]([a-z])", "$1$2"))
    out = F.regexp_replace(out, r"^([A-Z]) ([A-Z]{2,})\b", "$1$2")
    out = _where(out, ["*"], lambda t: F.regexp_replace(t, r"(^|\s)\*+\s?(\p{L})", "$1“$2"))
    out = _where(out, [f" {m}" for m in ".,;:!?"], lambda t: F.regexp_replace(t, r" +([.,;:!?])", "$1"))
    out = F.regexp_replace(out, r"^\d{1,4} (\p{Ll})", "$1")
    for wrong, right in CONTRACTIONS.items():
        out = _where(out, wrong.split("|"), lambda t, wrong=wrong, right=right: F.regexp_replace(t, rf"(^|[\s\"“‘'(])(?:{wrong})\b", "$1" + right))
    out = _where(out, ["T "], lambda t: F.regexp_replace(t, rf"(^|[\s\"“‘'(])T ({'|'.join(I_VERBS)})\b", "$1I $2"))
    # Words with a capital after a plain small word, however many follow each other.
    run = rf"(?<![^ ])\p{{Ll}}+(?: (?:{'|'.join(CAPITAL_SMALL)}))+(?![^ ])"
    lowered = lambda t: F.when(t.rlike(run), replaced(t, run, lambda m, gap, first: F.lower(m))).otherwise(t)
    # Most have nothing but single blanks; the ranges hold every other white space.
    out = with_value(out, lambda t: F.when(F.contains(t, F.lit("  ")) | t.rlike(r"[\t-\r\u0085-\u00a0\u1680\u2000-\u3000]"), collapse_space(t)).otherwise(F.trim(t)))
    # One pattern is faster than a search for each of so many words.
    return with_value(out, lambda t: F.when(t.rlike(f" (?:{'|'.join(CAPITAL_SMALL)})"), lowered(t)).otherwise(t))


def token_class(token: Column) -> Column:
    """clean, grey or junk, by the make-up of a token."""
    letters = F.regexp_count(token, F.lit(r"\p{L}"))
    return F.when(token.rlike(r"^[\"'“‘(]*\p{L}[\p{L}'’-]*[.,;:!?\"'”’)]*$"), "clean").when(letters * 2 >= F.char_length(token), "grey").when(token.rlike(r"^[\d.,;:!?()'\"-]+$"), "grey").otherwise("junk")


def junk_runs(docs: DataFrame, least: int = 3) -> DataFrame:
    """(target, start, size): runs of junk tokens, grey ones within them included, with at least ``least`` tokens."""
    tokens = docs.select("target", F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")).alias("n", "token"))
    order = Window.partitionBy("target").orderBy("n")
    bad = tokens.withColumn("bad", token_class(F.col("token")) != "clean").withColumn("junk", token_class(F.col("token")) == "junk")
    marked = bad.withColumn("_run", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(order)).where("bad")
    return marked.groupBy("target", "_run").agg(F.min("n").alias("start"), F.count("*").alias("size"), F.count_if("junk").alias("junk")).where((F.col("size") >= least) & (F.col("junk") >= 1)).drop("_run", "junk")
