"""The steps of scanned_paragraphs: what is made once, and the sentences against a plain rule."""

import random
import re

from pyspark.sql import functions as F

from tomespark.operators import quality, repair

WORDS = "the house of king boy old is well known went".split()
ATOMS = ["the", "Mr", "mr", "St", "X", "A", "İ", "ſt", "etc", "été", "𐐀b", "'", "’", "”", ")", ".", "..", "...", "!", "?", "“", "(", "-", "—", "12", "\r", "\n", "\u0085", "  ", " ", " ", " ", ". ", "! ", ".” "]


def ends(text):
    """A match and whether a sentence ends there, from the left."""
    return [(m.end(), not re.match(r"[^\W\d_]*\.", m[0]) or not (len(w := re.match(r"[^\W\d_]*", m[0])[0].lower()) <= 1 or w in repair.ABBREVIATIONS)) for m in re.finditer(r"[^\W\d_]*[.!?][\"”’')\]]*(?= |\Z|[\r\x85]\Z)", text)]


def plain(text):
    """(ends, whole) of a paragraph by its list of sentences."""
    text, parts, at = text.replace("\n", " "), [], 0
    for end, is_end in ends(text):
        if is_end:
            parts, at = [*parts, text[at:end]], end
    opened = [s.strip(" ").lstrip("\"“‘'(—- ") for s in parts]
    starts = [bool(s) and (s[0].isupper() or s[0].isdecimal()) and not (s[0].isupper() and s[0] not in "AIO" and s[1:2] == " " and s[2:3].islower()) for s in opened]
    return text[at:].strip(" ") == "", "".join(parts[starts.index(True) :]).strip(" ") if True in starts else ""


def test_sentences_by_patterns_are_those_of_a_list(spark):
    r = random.Random(5)
    rows = ["", " ", "Mr.", "No end", "A b.", "B b.", "X. The “A”.", "Go.\r", "x İ. The end."] + ["".join(r.choices(ATOMS, k=r.randint(1, 30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    got = df.select("text", repair.ends_sentence(F.col("text")).alias("e"), repair.whole_sentences(F.col("text")).alias("w"))
    assert [(x["e"], x["w"]) for x in got.collect()] == [plain(t) for t in rows]
    # No list of sentences is walked through.
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert spark.createDataFrame([(None,)], "text string").select(repair.whole_sentences(F.col("text"))).first()[0] == ""


def test_marks_are_counted_once_for_a_text(spark):
    """A generator's neighbours are made anew for each of its rows."""
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    rows = spark.createDataFrame([(0, "The king's boys’ house. xq’s Xq {{{ The Xq: Xq"), (1, None), (2, "{{{"), (3, "\x01Xq \x01xq")], "k int, text string")
    got = repair.word_counts(rows, words, ["k"])
    assert {x["k"]: (x["good"], x["bad"]) for x in got.collect()} == {0: (4, 4), 1: (0, None), 2: (0, 1), 3: (0, 1)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("[<>{}=") > plan.index("Generate explode")


def test_only_tokens_of_several_words_get_a_table(spark, monkeypatch):
    """Tables of all tokens that are not clean grow past what can be told to every task."""
    kept, plainly = {}, repair.written

    def written(df, name):
        kept[name] = plainly(df, name)
        return kept[name]

    monkeypatch.setattr(repair, "written", written)
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    text = "the xq zz# Xq-xq well-known (King) o'xq x.y, 3a-b --- Qq.Qq old"
    got = repair.split_junk(spark.createDataFrame([("a", 0, text), ("b", 0, "the xq zz# Zz old")], "target string, n int, text string"), words, 3)
    assert sorted((x["target"], x["text"]) for x in got.collect()) == [("a", "the"), ("a", "well-known (King) o'xq x.y, 3a-b --- Qq.Qq old"), ("b", "old"), ("b", "the")]
    assert {x["token"] for x in kept["classes"].collect()} == {"Xq-xq", "x.y,", "Qq.Qq"}


def test_a_text_is_cut_at_its_mends_only(spark):
    docs = spark.createDataFrame([("a", "Tbe house tbe's xtbe tbex. Tbe ’tbe’ tbe’s, Tbe (Tbe: “Tbe"), ("b", "the house")], "target string, text string")
    mends = spark.createDataFrame([("tbe", None, "the"), ("houseof", "house of", None)], "word string, split string, mended string")
    got = repair.with_mended_words(docs, mends)
    assert {x["target"]: x["text"] for x in got.collect()} == {"a": "The house tbe's xtbe tbex. The ’the’ tbe’s, Tbe (Tbe: “The", "b": "the house"}


def test_rare_marks_are_sought_by_one_pattern(spark):
    rows = ["ﬁne ‘‘x’’ ''y''", "АВ|¬x", "one In  two three Of", "plain"]
    got = spark.createDataFrame([(t,) for t in rows], "text string").select(quality.mended_marks(F.col("text")))
    assert [x[0] for x in got.collect()] == ["fine “x” \"y\"", "AB -x", "one in two three of", "plain"]
