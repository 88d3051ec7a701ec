"""Repair of scanned text against a vocabulary.

The vocabulary is a table of words. It is never asked word by word: the distinct
unknown words of a corpus are spelt in every way that a scan may have confused,
and one join says which of these are words. The few that can be mended go back to
the documents that hold them, and there the text is put together again in one
expression.

Paragraphs of noise are cut the same way: tokens get a class by a join, those that
are not clean go back to their paragraphs, and runs are found there by a pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomespark.functions.text import SPACES
from tomespark.sources.shared import told, written

WORD = r"\p{L}+(?:['’]\p{L}+)*"
# A match begins where a word does, or where the last match ended, so a word is not tried from each of its letters. A letter before it may have two code units.
_HYPHEN = r"(?:\G|(?<!\p{L}{1,2}))(\p{L}++)-\s+(\p{Ll}+)"
# Whether a text has such a pair; found in one pass.
_BROKEN = r"\p{L}-\s+\p{Ll}"

# Letters that scans take for one another, both ways.
CONFUSED = [("b", "h"), ("e", "c"), ("u", "n"), ("i", "l"), ("i", "u"), ("f", "s"), ("li", "h"), ("ii", "u"), ("ii", "n"), ("rn", "m"), ("vv", "w"), ("tl", "th")]
# Little words that are run onto the word before them.
TAILS = ["of", "to", "in", "at", "the", "and", "for", "with", "was", "that", "but", "a"]
# Words after a hyphen that belongs to the text.
HYPHEN_KEEPS = ["and", "or", "nor", "to", "of", "but"]
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "mr mrs dr st capt gen col lieut gov sen rep hon messrs prof vs no ft co inc corp bros mt rev jr sr etc jan feb mar apr aug sept oct nov dec ave blvd mme".split()
# What is trimmed off a token, and the marks that belong to no text.
TOKEN_EDGES, NO_TEXT = ".,;:!?\"“”‘’'()—–-$%/&", r"[■»«<>{}\[\]^=#@°§¢£•¦\\]"
# Small words that titles keep in lower case.
TITLE_SMALL = ["of", "the", "and", "in", "a", "an", "to", "for", "on", "at", "by", "with", "from", "or"]
# Lengths and shares that a paragraph must have.
SCRAP, PARAGRAPH, COUNTED, CLEAN, NOISE_RUN = 40, 60, 8, 0.85, 3


def pieces(text: Column, pattern: str | Column) -> Column:
    """(gap, first, match): each match with what lies before it, and at the end what lies behind the last, with a null match.

    Both arrays are made once; inside a lambda they would be made again for every element.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    gaps = F.transform(F.split(text, pattern, -1), lambda g, i: F.struct(g.alias("gap"), (i == 0).alias("first")))
    return F.zip_with(gaps, F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, m: F.struct(g["gap"].alias("gap"), g["first"].alias("first"), m.alias("match")))


def replaced(text: Column, pattern: str | Column, by: Callable[[Column, Column, Column], Column]) -> Column:
    """``text`` with every match of ``pattern`` replaced by ``by(match, gap, first)``; the gap lies before the match, and before the first match there is no other."""
    return F.array_join(F.transform(pieces(text, pattern), lambda p: F.concat(p["gap"], F.when(p["match"].isNull(), "").otherwise(by(p["match"], p["gap"], p["first"])))), "")


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_small(word: Column) -> Column:
    return F.lower(word) == word


def is_capitalised(word: Column) -> Column:
    """A capital and small letters."""
    return word.rlike(r"^\p{Lu}\p{Ll}*$") & (F.octet_length(word) > 1)


def may_mend(word: Column) -> Column:
    return (F.octet_length(word) >= 3) & ~F.contains(word, F.lit("'")) & ~F.contains(word, F.lit("’")) & (is_small(word) | is_capitalised(word))


def confused(word: Column) -> Column:
    """Every other spelling of a word with one place confused."""
    rules = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for pair in CONFUSED for a, b in (pair, pair[::-1])))
    places = F.sequence(F.lit(1), F.greatest(F.char_length(word), F.lit(1)))

    def at(rule: Column, i: Column) -> Column:
        n = F.char_length(rule["a"])
        return F.when(F.substring(word, i, n) == rule["a"], F.concat(F.substring(word, F.lit(1), i - 1), rule["b"], F.substring(word, i + n, F.char_length(word))))

    return F.array_distinct(F.array_compact(F.flatten(F.transform(rules, lambda r: F.transform(places, lambda i: at(r, i))))))


def outline(word: Column) -> Column:
    """What a word and all that confused() makes of it have in common: letters that are taken for one another are one, and so are runs of it."""
    return F.regexp_replace(F.replace(F.replace(F.translate(word, "bhiluef", "nnnnncs"), F.lit("m"), F.lit("rn")), F.lit("w"), F.lit("vv")), "n+", "n")


def unknown_words(docs: DataFrame, vocabulary: DataFrame, *key: str) -> DataFrame:
    """(key, as_is, word): the different words of each text (key, text) that may be mended and that the vocabulary does not have; word in small letters."""
    # A vocabulary that may be told to every task leaves out what it has where the words lie.
    return _may_be_mended(docs, *key).join(told(vocabulary.select("word").distinct())[0], "word", "left_anti").select(*key, "as_is", "word")


def _may_be_mended(docs: DataFrame, *key: str) -> DataFrame:
    """(key, as_is, word): the different words of each text (key, text) that may be mended; word in small letters."""
    # Whether a word may be mended is asked once for each different word of a text.
    words = docs.select(*key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("as_is"))
    return words.where(may_mend(F.col("as_is"))).withColumn("word", F.lower("as_is"))


def word_mends(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, split, mended): the unknown words of the texts that come apart, or become a word by one place, in one way only."""
    # Written, since it is read twice and made of all texts.
    return mends_of(written(unknown_words(docs, vocabulary).select("word").distinct(), "unknown"), vocabulary)


def mends_of(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, split, mended) of the words (word) that can be mended; ``unknown`` is read twice."""
    known = vocabulary.select("word").distinct()
    # Most have the outline of no word, and are not spelt anew.
    likely = unknown.join(known.select(outline(F.col("word")).alias("_o")), outline(F.col("word")) == F.col("_o"), "left_semi")
    spelt = likely.select("word", F.explode(confused(F.col("word"))).alias("mended")).join(known.withColumnRenamed("word", "mended"), "mended", "left_semi")
    mended = spelt.groupBy("word").agg(F.count("*").alias("n"), F.min("mended").alias("mended")).where("n = 1").drop("n")
    tails = F.explode(F.array(*map(F.lit, TAILS))).alias("tail")
    apart = unknown.where(F.octet_length("word") >= 5).select("word", tails).where(F.endswith("word", "tail"))
    apart = apart.withColumn("head", F.substring("word", F.lit(1), F.char_length("word") - F.char_length("tail"))).where(F.octet_length("head") >= 4)
    apart = apart.join(known.withColumnRenamed("word", "head"), "head", "left_semi")
    split = apart.groupBy("word").agg(F.count("*").alias("n"), F.min(F.concat_ws(" ", "head", "tail")).alias("split")).where("n = 1").drop("n")
    return split.join(mended, "word", "full").select("word", "split", "mended")


def _maps(own: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(target, name): a map from the keys of each target to their values."""
    return own.groupBy("target").agg(F.collect_set(F.struct(F.col(key).alias("k"), value.alias("v"))).alias(name)).select("target", F.map_from_entries(name).alias(name))


def sentence_opens(before: Column, first: Column) -> Column:
    """Whether a word stands at the start of a sentence; ``before`` is what lies between it and the word before."""
    bare = F.rtrim(before, F.lit(" \"“‘'("))
    return F.when(bare == "", first).otherwise(F.right(bare, F.lit(1)).isin(".", "!", "?", ":", "\n"))


def with_mended_words(docs: DataFrame, mends: DataFrame) -> DataFrame:
    """``docs`` (target, text, ...) with words mended by word_mends(). Names inside a sentence and words in capitals stay."""
    return _mended(docs, _may_be_mended(docs, "target").join(mends, "word"))


def with_repaired_words(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``docs`` (target, text, ...) with their own word_mends() applied: texts are cut into words once, and only unknown words are kept for both steps."""
    own = written(unknown_words(docs, vocabulary, "target"), "unknown-words")
    mends = written(mends_of(written(own.select("word").distinct(), "unknown"), vocabulary), "mends")
    return _mended(docs, own.join(told(mends)[0], "word"))


def _mended(docs: DataFrame, own: DataFrame) -> DataFrame:
    """Texts with the mends of their words, ``own`` (target, as_is, split, mended).

    A text is searched for the words that it has mends for, and all between these stays one piece.
    """
    as_title = F.concat(F.upper(F.substring("mended", 1, 1)), F.substring("mended", F.lit(2), F.char_length("mended")))
    # What is not small has a capital: it is mended where a sentence opens, and does not come apart.
    by = own.withColumn("by", F.when(is_small(F.col("as_is")), F.coalesce("split", "mended")).otherwise(as_title)).where("by IS NOT NULL")
    marked = docs.join(_maps(by, "as_is", F.col("by"), "_mends"), "target", "left")
    # Whole words: no letter and no joining apostrophe beside them.
    asked = F.concat(F.lit(r"(?<!\p{L}{1,2}['’]?)(?:"), F.array_join(F.map_keys("_mends"), "|"), F.lit(r")(?!['’]?\p{L})"))

    def mend(word: Column, gap: Column, first: Column) -> Column:
        return F.when(is_small(word) | sentence_opens(gap, F.lit(False)), F.try_element_at(F.col("_mends"), word)).otherwise(word)

    # A line's end before the text opens its first sentence, as the text's start does.
    whole = replaced(F.concat(F.lit("\n"), F.col("text")), F.col("_pattern"), mend)
    marked = marked.withColumn("_pattern", asked)
    return marked.withColumn("text", F.when(F.col("_mends").isNull(), F.col("text")).otherwise(F.substring(whole, 2, 2**31 - 1))).drop("_mends", "_pattern")


def with_joined_lines(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``docs`` (target, text, ...) with words joined that a line's end broke.

    Two halves that make a word, or of which one is none, are joined; two words
    keep their hyphen without the blank; a hanging hyphen stays.
    """
    pair = lambda m: F.struct(F.lower(F.regexp_extract(m, _HYPHEN, 1)).alias("l"), F.regexp_extract(m, _HYPHEN, 2).alias("r"))
    keys = F.transform(F.regexp_extract_all("text", F.lit(_HYPHEN), F.lit(0)), pair)
    broken = docs.where(F.col("text").rlike(_BROKEN))
    known = vocabulary.select("word").distinct()
    asked = broken.select(F.explode(F.array_distinct(keys)).alias("pair")).distinct()
    is_word = lambda c, name: known.select(F.col("word").alias(c), F.lit(True).alias(name))
    asked = asked.withColumns({"both": F.concat("pair.l", "pair.r"), "l": F.col("pair.l"), "r": F.col("pair.r")})
    asked = asked.join(is_word("both", "_b"), "both", "left_anti").join(is_word("l", "_l"), "l", "left").join(is_word("r", "_r"), "r", "left")
    keeps = F.col("r").isin(*HYPHEN_KEEPS)
    # Of pairs that do not make a word: those that stay as they are, and those of two words.
    special = asked.where(keeps | (F.col("_l") & F.col("_r"))).select("pair", keeps.alias("hangs"))
    own = broken.select("target", F.explode(F.array_distinct(keys)).alias("pair")).join(special, "pair")
    marked = docs.join(_maps(own, "pair", F.col("hangs"), "_pairs"), "target", "left")

    def mend(m: Column, gap: Column, first: Column) -> Column:
        left, right = F.regexp_extract(m, _HYPHEN, 1), F.regexp_extract(m, _HYPHEN, 2)
        hangs = F.try_element_at(F.col("_pairs"), pair(m))
        return F.when(hangs, m).when(~hangs, F.concat(left, F.lit("-"), right)).otherwise(F.concat(left, right))

    text = F.when(F.col("text").rlike(_BROKEN), replaced(F.col("text"), _HYPHEN, mend)).otherwise(F.col("text"))
    return marked.withColumn("text", text).drop("_pairs")


# Sentences


# A dot after one letter, none or an abbreviation ends none; İ is two letters when small. Marks are sought first, as letters are many.
_NO_END = rf"(?<!\p{{L}}{{1,2}})(?i:{'|'.join(ABBREVIATIONS)}|[\p{{L}}&&[^İ]]?)\."
_END = rf"[.!?](?<!{_NO_END})[\"”’')\]]*"
# What opens a whole sentence: a capital or a number, but no lone letter before a small one.
_QUOTES = "\"“‘'(—- "
_START = r"(?!(?![AIO])\p{Lu} \p{Ll})[\p{Lu}\p{Nd}]"


def ends_sentence(text: Column) -> Column:
    """Whether nothing follows the last whole sentence of a paragraph."""
    bare = F.rtrim(F.replace(text, F.lit("\n"), F.lit(" ")))
    # No sentence ends inside a token, so the last one says it.
    return (bare == "") | F.substring_index(bare, " ", -1).rlike(_END + r"\z")


def starts_sentence(text: Column) -> Column:
    return F.ltrim(text, F.lit(_QUOTES)).rlike("^" + _START)


def whole_sentences(text: Column) -> Column:
    """A paragraph without the end of a sentence that began elsewhere and the start of one that ends elsewhere."""
    # A line for each sentence, and last what follows the last of them; then from the first line that starts one to the last that ends one.
    lines = F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), _END + "(?= |$)", "$0\n")
    whole = F.regexp_extract(lines, rf"(?s)(?:\A|\n)([{re.escape(_QUOTES)}]*+{_START}.*)\n", 1)
    return F.coalesce(F.trim(F.replace(whole, F.lit("\n"), F.lit(""))), F.lit(""))


# Noise


def token_classes(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, class) of the distinct tokens that are not clean: 1 for a name or noise next to noise, 2 for junk."""
    bare = F.btrim("token", F.lit(TOKEN_EDGES))
    each = tokens.select("token").distinct().withColumn("bare", bare)
    open_ = each.where((F.col("bare") != "") & ~F.col("bare").rlike(NO_TEXT) & ~F.col("bare").rlike("[0-9]"))
    runs = open_.select("token", F.explode_outer(F.regexp_extract_all("bare", F.lit(WORD), F.lit(0))).alias("run")).withColumn("word", F.lower("run"))
    marked = runs.join(vocabulary.select("word", F.lit(True).alias("known")).distinct(), "word", "left")
    of_run = F.when(F.col("run").isNull(), 2).when(F.col("known") | F.col("run").rlike("^[A-Z]$"), 0).when(is_capitalised(F.col("run")), 1).otherwise(2)
    classes = marked.groupBy("token").agg(F.max(of_run).alias("class")).where("class > 0")
    return classes.unionByName(each.where((F.col("bare") != "") & F.col("bare").rlike(NO_TEXT)).select("token", F.lit(2).alias("class")))


def _classed(paragraphs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(target, n, at, class) of the tokens of paragraphs (target, n, text) that are not clean, by their place.

    Most tokens hold one word, and the vocabulary is asked for it where they lie;
    only those that hold several have their class in a table.
    """
    tokens = lambda d: d.select("target", "n", F.posexplode(_tokens(F.col("text"))).alias("at", "token"))
    several = F.col("token").rlike(_SEVERAL)
    table = paragraphs.where(F.col("text").rlike(_SEVERAL)).select(F.explode(F.array_distinct(_tokens(F.col("text")))).alias("token")).where(several)
    # Written, since it is read twice and made of all texts.
    classes = written(token_classes(written(table.distinct(), "tokens"), vocabulary), "classes")
    each = tokens(paragraphs).withColumn("run", F.regexp_extract("token", WORD, 0)).withColumn("word", F.lower("run"))
    known = vocabulary.where(F.col("word").rlike(rf"^{WORD}$")).select("word", F.lit(True).alias("known")).distinct()
    marked = each.join(told(known)[0], "word", "left")
    if not classes.isEmpty():
        marked = marked.join(told(classes)[0], "token", "left")
    else:
        marked = marked.withColumn("class", F.lit(None).cast("int"))
    of_run = F.when(F.col("known"), 0).when(F.col("run").between("A", "Z") & (F.octet_length("run") == 1), 0).when(is_capitalised(F.col("run")), 1).otherwise(2)
    beside = F.when(F.col("token").rlike(NO_TEXT), 2).when(F.col("token").rlike("[0-9]"), 0).when(F.col("run") == "", F.when(F.btrim("token", F.lit(TOKEN_EDGES)) == "", 0).otherwise(2)).when(several, F.coalesce("class", F.lit(0))).otherwise(of_run)
    # A class is made once, which a filter on it would do twice.
    return marked.select("target", "n", "at", F.explode(F.array_remove(F.array(F.when(F.col("run") == F.col("token"), of_run).otherwise(beside)), 0)).alias("class"))


# A token with more than one word.
_SEVERAL = r"\p{L}(?!['’]\p{L})[^\p{L}\s]++\p{L}"


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def split_junk(paragraphs: DataFrame, vocabulary: DataFrame, least: int = NOISE_RUN) -> DataFrame:
    """Paragraphs (target, n, text) cut where ``least`` tokens or more in a row are noise: (target, n, part, text).

    Noise spreads over the names next to it from both sides, so a run of tokens
    that are not clean is noise as soon as one of them is junk.
    """
    # Only tokens that are not clean go back to their paragraphs, each with its place: no token is sought in a list of them.
    bad = _classed(paragraphs, vocabulary).groupBy("target", "n").agg(F.array_sort(F.collect_list(F.col("at") * 4 + F.col("class"))).alias("_bad"))
    classed = paragraphs.select("target", "n", "text").join(bad, ["target", "n"], "left").select("target", "n", _tokens(F.col("text")).alias("t"), "_bad")
    # A digit for each token, so runs are found by a pattern.
    zeros = lambda n: F.repeat(F.lit("0"), n)
    at = lambda x: F.shiftright(x, 2)
    upto = lambda x, i: F.concat(zeros(at(x) - F.coalesce(at(F.get("_bad", i - 1)), F.lit(-1)) - 1), x.bitwiseAND(F.lit(3)).cast("string"))
    digits = F.when(F.col("_bad").isNull(), zeros(F.size("t"))).otherwise(F.concat(F.array_join(F.transform("_bad", upto), ""), zeros(F.size("t") - 1 - at(F.element_at("_bad", -1)))))
    noise = rf"(?<![12])(?=[12]{{{least}}})[12]*2[12]*(?![12])"
    size = lambda c: F.coalesce(F.char_length(c), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,size:int>>").alias("parts"))
    step = lambda s, p: F.struct((s["at"] + size(p["gap"]) + size(p["match"])).alias("at"), F.concat(s["parts"], F.array(F.struct(s["at"].alias("at"), size(p["gap"]).alias("size")))).alias("parts"))
    # Parts are made inside the generator: as a column they would be made again for the filter that Spark puts before it.
    parts = F.filter(F.aggregate(pieces(F.col("_d"), noise), start, step)["parts"], lambda p: p["size"] > 0)
    cut = classed.withColumn("_d", digits).select("target", "n", "t", F.posexplode(parts).alias("part", "_p"))
    return cut.select("target", "n", "part", F.array_join(F.slice("t", F.col("_p.at"), F.col("_p.size")), " ").alias("text"))


_OPENS = "\x01"


def word_counts(texts: DataFrame, vocabulary: DataFrame, key: list[str]) -> DataFrame:
    """(key, good, bad): words of a text that are words, with possessives and the first part of contractions, and those that are not; names inside a sentence do not count, three marks of no print are a bad word."""
    # A mark before a word with a capital says that it opens a sentence; the texts' own such marks become others.
    opened = F.regexp_replace(F.replace("text", F.lit(_OPENS), F.lit("#")), r"(?:\A|[.!?:\n])[ \"“‘'(]*+(?=\p{Lu})", "$0" + _OPENS)
    junk = F.regexp_count("text", F.lit(r"[<>{}=\\@#$%&+*\[\]]"))
    # Beside a generator, marks would be counted anew for every word.
    each = texts.withColumn("junk", junk).select(*key, "junk", F.explode_outer(F.regexp_extract_all(opened, F.lit(f"{_OPENS}?{WORD}"), F.lit(0))).alias("w"))
    each = each.withColumn("spelt", F.replace(F.replace(F.lower("w"), F.lit("’"), F.lit("'")), F.lit(_OPENS), F.lit("")))
    # A word is good as it stands, or without its possessive, or by what lies before an apostrophe.
    known = vocabulary.select("word").distinct()
    quoted = texts.where(F.col("text").rlike(r"['’]\p{L}")).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"(?<!\p{{L}}{{1,2}}){WORD[:-1]}+"), F.lit(0)))).alias("w"))
    quoted = quoted.select(F.replace(F.lower("w"), F.lit("’"), F.lit("'")).alias("spelt")).distinct()
    forms = F.array(F.regexp_replace("spelt", "'s$", ""), F.regexp_replace("spelt", "s'$", ""), F.substring_index("spelt", "'", 1))
    parts = quoted.select("spelt", F.explode(forms).alias("word")).join(known, "word", "left_semi").select(F.col("spelt").alias("word"))
    good = written(known.unionByName(parts).distinct(), "good-words").select(F.col("word").alias("spelt"), F.lit(True).alias("good"))
    each = each.join(told(good)[0], "spelt", "left").select(*key, "junk", "w", F.coalesce("good", F.lit(False)).alias("good"))
    count = lambda c: F.count_if(c).alias
    sums = each.groupBy(*key).agg(count(F.col("w").isNotNull() & F.col("good"))("good"), count(F.col("w").isNotNull() & ~F.col("good") & ~is_capitalised(F.col("w")))("bad"), F.max("junk").alias("junk"))
    return sums.select(*key, "good", (F.col("bad") + F.floor(F.col("junk") / 3)).alias("bad"))


# From pages to paragraphs


def once(df: DataFrame) -> DataFrame:
    """``df`` (..., text) with its text made before a filter asks for it: a filter on an expression would have it made again for each mention."""
    rest = [c for c in df.columns if c != "text"]
    return df.select(*rest, F.explode(F.array("text")).alias("text"))


def fragment(p: Column) -> Column:
    """A short piece of a sentence, and not a page number or a running head."""
    words = F.filter(F.split(p, " "), lambda w: w != "")
    mark = r"[.,;:!?)”’\"'—-]"
    small = F.exists(words, lambda w: F.regexp_replace(w, r"^\P{L}+|\P{L}+$", "").rlike(r"^\p{Ll}+$") & ~F.regexp_replace(w, r"^\P{L}+|\P{L}+$", "").isin(*TITLE_SMALL))
    closed = (F.size(words) >= 2) | F.regexp_replace(p, mark + "+$", "").rlike(r"^\p{Ll}+$")
    return (F.upper(p) != p) & F.when(p.rlike(mark + "$"), closed).otherwise(small)


def goes_on(p: Column) -> Column:
    """A paragraph begins with a plain word in lower case."""
    return F.regexp_replace(F.substring_index(p, " ", 1), r"[.,;:!?)”’\"'—]+$", "").rlike(r"^\p{Ll}+$")


def scan_paragraphs(pages: DataFrame, vocabulary: DataFrame, mended_marks: Callable[[Column], Column]) -> DataFrame:
    """Scanned pages (target, page, text) of a work as its paragraphs of whole sentences: (target, paragraph, text).

    Broken words are joined, marks and words mended, and scraps left out. A
    paragraph that stops inside a sentence goes on in the next one that begins
    small, over the end of a page as within one. Noise is cut out, and what is
    short, opens on a lost letter or holds too few words goes.
    """
    key = F.struct("target", "page").alias("target")
    # A work's last line of a page and its first of the next are one text to a broken word.
    lines = with_joined_lines(pages.select(key, F.regexp_replace("text", "\r\n", "\n").alias("text")), vocabulary)
    split = lines.select("target", F.posexplode(F.split("text", r"\n[ \t]*\n+")).alias("n", "text"))
    # Written, since all that follows reads it several times.
    scraps = split.select("target.target", "target.page", "n", mended_marks(F.trim(F.regexp_replace("text", r"[ \t\n]+", " "))).alias("text"))
    # A number for each, so words carry little; it is written with them and stays.
    scraps = written(scraps.select(F.struct("target", "page", "n").alias("place"), F.monotonically_increasing_id().alias("target"), "text"), "scraps")
    scraps = once(with_repaired_words(scraps, vocabulary))
    scraps = scraps.where((F.char_length("text") >= SCRAP) | fragment(F.col("text"))).select("place.target", "place.page", "place.n", "text")
    order = Window.partitionBy("target").orderBy("page", "n")
    # Whether a paragraph ends is said once for each, before the window.
    ended = scraps.withColumns({"_ends": ends_sentence(F.col("text")), "_on": goes_on(F.col("text"))})
    new = F.when(F.coalesce(~F.lag("_ends").over(order), F.lit(False)) & F.col("_on"), 0).otherwise(1)
    numbered = ended.withColumn("_new", new).withColumn("_p", F.sum("_new").over(order))
    joined = numbered.groupBy("target", F.col("_p").alias("n")).agg(F.array_sort(F.collect_list(F.struct("page", F.col("n").alias("at"), "text"))).alias("t"))
    paragraphs = written(joined.select("target", "n", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text")), "paragraphs")
    parts = once(split_junk(paragraphs, vocabulary).withColumn("text", whole_sentences(F.col("text")))).where(F.char_length("text") >= PARAGRAPH)
    first = F.regexp_replace(F.substring_index("text", " ", 1), r"^\P{L}+|\P{L}+$", "")
    parts = parts.withColumn("word", F.lower(first)).withColumn("_capitals", (F.octet_length(first) >= 3) & (F.upper(first) == first))
    parts = parts.join(vocabulary.select("word", F.lit(True).alias("_known")).distinct(), "word", "left").where(~F.col("_capitals") | F.coalesce("_known", F.lit(False)))
    parts = written(parts.select("target", "n", "part", "text"), "parts")
    counts = word_counts(parts, vocabulary, ["target", "n", "part"])
    clean = parts.join(counts, ["target", "n", "part"]).where((F.col("good") + F.col("bad") < COUNTED) | (F.col("good") >= CLEAN * (F.col("good") + F.col("bad"))))
    return clean.select("target", F.row_number().over(Window.partitionBy("target").orderBy("n", "part")).alias("paragraph"), "text")
