"""Text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks, and the base letter of each.
FOLD_FROM = "ışğüöçáàâäãåāăąéèêëēėęěíìîïīįóòôõøōőúùûūůűųñńňýÿćčďłľřśšťźżž’‘"
FOLD_TO = "isguocaaaaaaaaaeeeeeeeeiiiiiiooooooouuuuuuunnnyyccdllrsstzzz''"
#: Blanks in the sense of Unicode.
SPACES = r"(?U)\s+"


def fold(s: Column) -> Column:
    """Lower case without marks, one character for one character.

    The dotted capital I goes first: its lower case has two characters.
    """
    return F.translate(F.lower(F.translate(s, "İ", "i")), FOLD_FROM, FOLD_TO)


def collapse_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, SPACES, " "))


def slug(s: Column, longest: int = 32) -> Column:
    """ASCII letters and digits joined by single hyphens."""
    joined = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.trim(F.substring(joined, 1, longest), F.lit("-"))


def base_subject(s: Column) -> Column:
    """A subject without its reply prefixes, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.trim(s), r"(?i)^((re|aw|sv|antw)\s*(\[\d+\])?\s*:\s*)+", "")))


def natural_key(s: Column, width: int = 9) -> Column:
    """A sort key under which digit runs compare as numbers: each is padded to ``width`` places."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"(\d+|\D+)"), 1)
    pad = lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.right(F.regexp_replace(p, r"^0+(?=\d)", ""), F.lit(width)), width, "0")).otherwise(p)
    return F.array_join(F.transform(parts, pad), "")


_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def roman_value(s: Column) -> Column:
    """The number of a Roman numeral, read from the right; 0 for other text."""
    digits = F.reverse(F.filter(F.split(F.lower(s), ""), lambda c: c != ""))
    value = F.create_map(*[F.lit(x) for pair in _ROMAN.items() for x in pair])
    step = lambda acc, c: F.struct(
        F.when(F.try_element_at(value, c) < acc["prev"], acc["total"] - F.try_element_at(value, c)).otherwise(acc["total"] + F.coalesce(F.try_element_at(value, c), F.lit(0))).alias("total"),
        F.greatest(acc["prev"], F.coalesce(F.try_element_at(value, c), F.lit(0))).alias("prev"),
    )
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("prev"))
    return F.when(s.rlike("(?i)^[ivxlc]+$"), F.aggregate(digits, start, step, lambda acc: acc["total"])).otherwise(0)


# The numerals in descending order.
_NUMERALS = ((100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman_numeral(n: Column) -> Column:
    """The Roman numeral of a number below 400."""
    out, rest = F.lit(""), n
    for value, sign in _NUMERALS:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return out


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB."""
    text = lambda unit, size: F.concat(F.format_string("%.1f", n / size), F.lit(f" {unit}"))
    return F.when(n >= 1 << 30, text("GB", float(1 << 30))).when(n >= 1 << 20, text("MB", float(1 << 20))).when(n >= 1 << 10, F.concat(F.format_string("%d", F.floor(n / 1024)), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def markdown_escape(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\`*_\[\]<>])", r"\\$1")


def markdown_unescape(s: Column) -> Column:
    return F.regexp_replace(s, r"\\([\\`*_\[\]<>])", "$1")


def markdown_link(text: Column, href: Column) -> Column:
    """A link; addresses with blanks or brackets stand in angle brackets."""
    address = F.when(href.rlike(r"[\s()]"), F.concat(F.lit("<"), href, F.lit(">"))).otherwise(href)
    return F.concat(F.lit("["), markdown_escape(text), F.lit("]("), address, F.lit(")"))


def sentence_end(s: Column) -> Column:
    """Whether a text stops on a sentence's end, closing quotes and brackets aside."""
    return F.rtrim(s).rlike("[.!?…:][\"'”’)\\]]*$")


def clip(s: Column, longest: int) -> Column:
    return F.when(F.char_length(s) > longest, F.concat(F.rtrim(F.substring(s, 1, longest - 1)), F.lit("…"))).otherwise(s)


# Words that stay small inside a title.
_SMALL = ("a", "an", "and", "as", "at", "but", "by", "for", "in", "nor", "of", "on", "or", "the", "to", "with")


def title_case(s: Column) -> Column:
    """Words with a capital, small words aside unless they come first."""
    words = F.split(F.lower(s), " ")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.char_length(w)))
    return F.array_join(F.transform(words, lambda w, i: F.when(w.isin(*_SMALL) & (i > 0), w).otherwise(capital(w))), " ")


def upper_in(s: Column, lang: Column) -> Column:
    """Upper case; Turkish and Azerbaijani keep the dot of their i."""
    return F.when(lang.isin("tr", "az"), F.upper(F.translate(s, "iı", "İI"))).otherwise(F.upper(s))


def poster_name(sender: Column) -> Column:
    """The name in a From header, else the address before its at sign."""
    quoted = F.regexp_extract(sender, r'^\s*"?([^"<]*?)"?\s*<', 1)
    comment = F.regexp_extract(sender, r"\(([^)]*)\)\s*$", 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(comment, F.lit("")), F.regexp_extract(sender, r"^\s*<?([^@<>\s]*)", 1))


def series_key(title: Column) -> Column:
    """A title without its part number and its marks of finality, folded."""
    bare = F.regexp_replace(fold(title), r"[\[(](?:final|update[ds]?|end)[^\])]*[\])]", "")
    return F.trim(F.regexp_replace(bare, r"[\s,:;|–—-]*[\[(]?\b(?:part|pt\.?|chapter|ch\.?|#)\s*(?:\d+|[ivxlc]+)\b[\])]?.*$", ""))


def part_number(title: Column) -> Column:
    """The part number of a title, in figures or Roman numerals; 0 without one."""
    number = F.regexp_extract(F.lower(title), r"\b(?:part|pt\.?|chapter|ch\.?|#)\s*(\d+|[ivxlc]+)\b", 1)
    return F.coalesce(number.try_cast("int"), roman_value(number), F.lit(0))


def file_name(title: Column, longest: int = 80) -> Column:
    """A title as a safe file name."""
    safe = collapse_space(F.regexp_replace(title, r'[\\/:*?"<>|\x00-\x1f]', " "))
    return F.regexp_replace(F.substring(safe, 1, longest), r"[. ]+$", "")


def same_word(a: Column, b: Column) -> Column:
    """Whether a scan may have read one word as the other: four letters alike and nearly one length."""
    return (F.substring(fold(a), 1, 4) == F.substring(fold(b), 1, 4)) & (F.abs(F.char_length(a) - F.char_length(b)) <= 1)


# Numbers that are written out.
NUMBER_WORDS = ["no", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]


def number_word(n: Column) -> Column:
    """A small number as a word, others in digits."""
    known = F.array(*map(F.lit, NUMBER_WORDS))
    return F.coalesce(F.get(known, F.when(n.between(0, len(NUMBER_WORDS) - 1), n).cast("int")), n.cast("string"))


# Letters of file names and what they are compared as.
NAME_FROM = "_-.ışğüöçáàâäãåéèêëíìîïóòôõúùûñýÿ"
NAME_TO = "   isguocaaaaaaeeeeiiiioooouuunyy"


def name_fold(s: Column) -> Column:
    """A file name for comparison: lower case without marks, separators as spaces, ligatures spelt out."""
    plain = F.translate(F.lower(F.translate(s, "İ", "i")), NAME_FROM, NAME_TO)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "æ", "ae"), "œ", "oe"), "ß", "ss")


def is_plain_word(w: Column) -> Column:
    """A headword of 3 to 14 small ASCII letters."""
    return w.rlike("^[a-z]{3,14}$")


def word_at(s: Column) -> Column:
    """The first word of a text without what is no letter, hyphen or apostrophe around it."""
    bare = F.regexp_replace(F.regexp_replace(s, r"^[^\p{L}'-]+", ""), r"[^\p{L}'-]+$", "")
    return F.regexp_extract(bare, r"(?U)^(\S*)", 1)


def text_length(s: Column) -> Column:
    """Bytes of a text without its white space."""
    return F.octet_length(F.regexp_replace(s, SPACES, ""))


def capped(s: Column, most: int = 200 * 1024) -> Column:
    """A text cut to at most so many bytes, at the boundary of a character."""
    raw = F.encode(s, "UTF-8")
    # A byte 10xxxxxx continues a character: step back over up to three of them.
    continues = lambda at: F.substring(F.hex(F.substring(raw, at, F.lit(1))), 1, 1).isin("8", "9", "A", "B")
    end = F.lit(most)
    cut = F.when(~continues(end + 1), end).when(~continues(end), end - 1).when(~continues(end - 1), end - 2).otherwise(end - 3)
    return F.when(F.octet_length(s) <= most, s).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def issue_number(base: Column) -> Column:
    """The last number in the name of an issue; 0 where there is none."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(base, F.lit(r"\d+(?:\.\d+)?"), 0), F.lit(-1)).cast("double"), F.lit(0.0))
