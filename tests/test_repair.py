"""Repair of scans: literal cases, and whole pages against a plain program."""

import random
import re

import pytest

from pyspark.sql import functions as F

from tomespark.operators import quality, repair

WORDS = (
    "the when they went house barn is red mountain range governor was elected for no reason at all three twenty five dollars year years city of than well known man side tracked by it a "
    "old walked down to shore and looked sea long time as he did every morning his life tide coming in over flat sand birds ran along edge water thought men who had gone out boats not come back "
    "sat on stone rest came home from boating trip with girl arms her hair streamed away pale face boat sprung leak far afloat probability small case that we have so random holding greater average one "
    "clean sentence nothing wrong second page runs two lines word broken end mended here third begins cut off foot goes top next then last whole fourth this"
).split()


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "word string").cache()


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "target int, text string")


def result(df):
    return [r["text"] for r in df.orderBy("target").collect()]


def test_words_one_place_from_one_word(spark, vocabulary):
    cases = {
        "tbe house. Tbe barn": "the house. The barn",
        "tlie man": "the man",
        "by Hoyt tbe": "by Hoyt the",
        "NVC xqzv house": "NVC xqzv house",
        "Tbe end. And Tbe end": "The end. And Tbe end",
        "yearsof it, cityof it, thana man, xqzvwof": "years of it, city of it, than a man, xqzvwof",
        "“Tbe man” (tbe)": "“The man” (the)",
        "": "",
    }
    docs = texts(spark, *cases)
    assert result(repair.with_mended_words(docs, repair.word_mends(docs, vocabulary))) == list(cases.values())
    none = texts(spark, None)
    assert result(repair.with_mended_words(none, repair.word_mends(none, vocabulary))) == [None]


def test_lines_are_joined_and_compounds_kept(spark, vocabulary):
    cases = {
        "twenty-\nfive dollars": "twenty-five dollars",
        "was elected Gover- nor": "was elected Governor",
        "for no rea-\nson at all": "for no reason at all",
        "the pre- and post-war": "the pre- and post-war",
        "a well-known man": "a well-known man",
        "the moun-\n\n tain range": "the mountain range",
        "side-\ntracked by it": "side-tracked by it",
        "qxq- zvz": "qxqzvz",
        "": "",
    }
    assert result(repair.with_joined_lines(texts(spark, *cases), vocabulary)) == list(cases.values())
    assert result(repair.with_joined_lines(texts(spark, None), vocabulary)) == [None]


def test_marks_of_scans(spark):
    cases = {
        '*Five sacks?" Faye grinned': '“Five sacks?" Faye grinned',
        "when w'hen they went": "when when they went",
        "T HEY fought it out": "THEY fought it out",
        "to the participants In history": "to the participants in history",
        "as If In the end. In the end": "as if in the end. In the end",
        "164 from some wagon train.": "from some wagon train.",
        '"Pll lay he did," she said': '"I\'ll lay he did," she said',
        '"T never put my leg across one"': '"I never put my leg across one"',
        "the road , and then": "the road, and then",
        "Сап you come? Tom соте": "Can you come? Tom come",
        "‘‘oﬃce’’ ~a_b|c": "“office” ab c",
    }
    assert result(texts(spark, *cases).withColumn("text", quality.mended_marks(F.col("text")))) == list(cases.values())


def test_sentences(spark):
    rows = {
        "The old man": True, "“The old man”": True, "1. An assumed law": True, "‘only given him one of": False, "and then he went": False,
        "X be given increased": False, "I be given": True, "A man walked": True, "J. P. Morgan came to us": True, "": False,
    }
    got = texts(spark, *rows).withColumn("s", repair.starts_sentence(F.col("text"))).orderBy("target").collect()
    assert [r["s"] for r in got] == list(rows.values())
    cases = {
        "cut off here. The old man sat. He": "The old man sat.",
        "Mr. Hoyt came home. The boat had": "Mr. Hoyt came home.",
        "no end at all": "",
        "He said “Go.” And went...": "He said “Go.”",
        "small. but no start. at all.": "",
        "Was it J. P. Morgan? Yes!": "Was it J. P. Morgan? Yes!",
    }
    assert result(texts(spark, *cases).withColumn("text", repair.whole_sentences(F.col("text")))) == list(cases.values())


def test_noise_is_cut(spark, vocabulary):
    p = 'The probability is small in every case that we have so far. "i u»m je;»iejo nu Sdtptoh Ilimh ■TT"D J° at random, the holding time is greater than the average one.'
    rows = [p, "A clean sentence, with nothing wrong in it at all.", "Xx »a »b »c", "»a the »b »c the", ""]
    paragraphs = spark.createDataFrame([(n, 0, t) for n, t in enumerate(rows)], "target int, n int, text string")
    got = {}
    for r in repair.split_junk(paragraphs, vocabulary).orderBy("target", "part").collect():
        got.setdefault(r["target"], []).append(r["text"])
    assert len(got[0]) == 2 and got[0][0].endswith("so far.") and got[0][1].startswith("at random")
    assert got[1] == [rows[1]] and 2 not in got and got[3] == [rows[3]] and 4 not in got


def test_noise_spreads_from_both_sides(spark, vocabulary):
    """Against two scans over the tokens, one from each side."""
    r = random.Random(2)
    kinds = {"the": 0, "Nomen": 1, "»x": 2, "—": 0}
    rows = [[r.choice(list(kinds)) for _ in range(r.randrange(14))] for _ in range(150)]
    want = {}
    for k, tokens in enumerate(rows):
        junk, grey = [kinds[t] == 2 for t in tokens], [kinds[t] == 1 for t in tokens]
        for i in range(1, len(tokens)):
            junk[i] |= grey[i] and junk[i - 1]
        for i in range(len(tokens) - 2, -1, -1):
            junk[i] |= grey[i] and junk[i + 1]
        cut = re.sub("1{3,}", lambda m: "x" * len(m[0]), "".join("01"[j] for j in junk))
        parts, at = [], 0
        for piece in re.split("(x+)", cut):
            if piece and "x" not in piece:
                parts.append(" ".join(tokens[at : at + len(piece)]))
            at += len(piece)
        if parts:
            want[k] = parts
    paragraphs = spark.createDataFrame([(k, 0, " ".join(t)) for k, t in enumerate(rows)], "target int, n int, text string")
    got = {}
    for x in repair.split_junk(paragraphs, vocabulary).orderBy("target", "part").collect():
        got.setdefault(x["target"], []).append(x["text"])
    assert got == want


def test_paragraphs_join_columns_and_pages(spark, vocabulary):
    columns = [
        "cut off at the top of the and then a whole sentence. The old man walked down to the shore and looked at the sea for a long time, as he did every morning of his life.",
        "The tide was coming in over the flat sand, and the birds ran along the edge of the water. He thought of the men who had gone out in the boats and",
        "had not come back, and he sat down on a stone to rest. 47",
        "Mr. Hoyt came home from the boating trip with the girl in his arms, and her hair streamed away from her pale face. The boat had sprung a leak far from shore and gone down",
    ]
    pages = [("a", 1, "\n\n".join(columns)), ("b", 1, "\n\n".join(columns[:2])), ("b", 2, "\r\n".join(["had not come back, and he", "sat down on a stone to rest. 47", "", "  ", "THE SHORE 12"]))]
    rows = repair.scan_paragraphs(spark.createDataFrame(pages, "target string, page int, text string"), vocabulary, quality.mended_marks).orderBy("target", "paragraph").collect()
    a, b = ([x["text"] for x in rows if x["target"] == t] for t in "ab")
    assert len(a) == 3 and a[0].startswith("The old man walked")
    assert "gone out in the boats and had not come back, and he sat down on a stone to rest." in a[1]
    assert a[2].startswith("Mr. Hoyt came home") and a[2].endswith("pale face.")
    assert b == a[:2] and [x["paragraph"] for x in rows if x["target"] == "a"] == [1, 2, 3]
    assert repair.scan_paragraphs(spark.createDataFrame([("a", 1, None)], "target string, page int, text string"), vocabulary, quality.mended_marks).collect() == []


def test_counts_of_words(spark, vocabulary):
    rows = ["The man's boats' don’t. Hoyt came with Hoyt", "xq zv {{{ +++", "", "The the THE"]
    held = spark.createDataFrame([(n, t) for n, t in enumerate(rows)], "k int, text string")
    got = {r["k"]: (r["good"], r["bad"]) for r in repair.word_counts(held, vocabulary, ["k"]).collect()}
    assert got == {0: (5, 2), 1: (0, 4), 2: (0, 0), 3: (3, 0)}


def test_readable(spark):
    prose = "The old naturalist walked down to the shore every morning and wrote what he saw in a small book, for he held that nothing seen once is ever seen twice. " * 3
    others = [
        "Goldfinch Mexican, 178. Grackle, boat-tailed, 85, 129, 130. Grosbeak, blue, 91. " * 8,
        "Postquam exhausta palus terraque ardore dehiscunt exsilit in siccum flammantia lumina torquens " * 5,
        "The farmer faw the fheep in the foft meadow and the fhepherd fang of fifh and fire " * 4,
        "|| -- ~~ // __ ## ** " * 40, "too short",
    ]
    got = texts(spark, prose, *others).withColumn("r", quality.readable(F.col("text"))).orderBy("target").collect()
    assert [r["r"] for r in got] == [True] + [False] * len(others)


def test_other_spellings_keep_their_outline(spark, tmp_path):
    words = ["modern", "when", "libel", "filth", "niihau", "rniddle", "wavvy", "hubbub", "e", "ünlü", "mm"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    spelt = df.select("word", F.explode(repair.confused(F.col("word"))).alias("other"))
    assert spelt.count() > 60 and spelt.where(repair.outline(F.col("word")) != repair.outline(F.col("other"))).count() == 0
    junk = spark.createDataFrame([(" ".join(["tlie", *(f"{a}z{c}qx" for a in "behlu" for c in "ncf")]),)], "text string")
    got = repair.word_mends(junk, spark.createDataFrame([("the",), ("thing",)], "word string"))
    assert [tuple(r) for r in got.collect()] == [("tlie", None, "the")]
    # What follows reads the unknown words, not the texts.
    assert got._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 0


def test_noise_is_cut_within_a_row(spark):
    """Tokens of a paragraph are no rows when its runs are found: no window, and nothing is sorted by place."""
    words = spark.createDataFrame([("good",), ("word",)], "word string")
    texts = ["good xq zz# good word", "good xq zz# qp Good word", "xq zz# qp", "xq zz# qp good  xq word q# q# q#", "", None, "Xy Xz Xw good"]
    got = repair.split_junk(spark.createDataFrame([("a", n, t) for n, t in enumerate(texts)], "target string, n int, text string"), words)
    assert sorted((r["n"], r["part"], r["text"]) for r in got.collect()) == [(0, 0, "good xq zz# good word"), (1, 0, "good"), (1, 1, "Good word"), (3, 0, "good xq word"), (6, 0, "Xy Xz Xw good")]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
