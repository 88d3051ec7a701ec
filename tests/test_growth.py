"""What keeps queries over many texts within their limits: one test for each finding of round 3."""

import random
import re

from pyspark.sql import functions as F

from tomespark.operators import quality, repair, search
from tomespark.plans import texts

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "w'ould W-hen W’e law-yers w'", "A BCD went", "* star ** two *\tthree a*b", "a , b . c;  !", "12 small 12345 small", "Pll go; \"Pd say TIl, (Pve xPm Pm", "T know T never xT was T knows",
       "then In It Is As on But", "thEn In x", "ln In\nIt  of  If.", "a b \t c  In", "ﬁ ‘‘x’’ АВ|¬x", "In of", "an In Its"]


def plain_marks(text):
    """The patterns of mended_marks() one after the other, each over every text."""
    out = F.regexp_replace(quality.latin(text), r"\b([Ww])['’-]([a-z])", "$1$2")
    for pattern, by in [(r"^([A-Z]) ([A-Z]{2,})\b", "$1$2"), (r"(^|\s)\*+\s?(\p{L})", "$1“$2"), (r" +([.,;:!?])", "$1"), (r"^\d{1,4} (\p{Ll})", "$1")]:
        out = F.regexp_replace(out, pattern, by)
    for wrong, right in quality.CONTRACTIONS.items():
        out = F.regexp_replace(out, rf"(^|[\s\"“‘'(])(?:{wrong})\b", "$1" + right)
    out = F.regexp_replace(out, rf"(^|[\s\"“‘'(])T ({'|'.join(quality.I_VERBS)})\b", "$1I $2")
    run = rf"(?<![^ ])\p{{Ll}}+(?: (?:{'|'.join(quality.CAPITAL_SMALL)}))+(?![^ ])"
    return quality.replaced(quality.collapse_space(out), run, lambda m, gap, first: F.lower(m))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_marks_are_sought_only_where_they_may_be(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "text string")
    got = rows.select("text", quality.mended_marks(F.col("text")).alias("a"), plain_marks(F.col("text")).alias("b")).collect()
    assert [x["a"] for x in got] == [x["b"] for x in got] and sum(x["a"] != x["text"] for x in got) > 8
    # A single file is worked on by all cores, and rare patterns stand behind a plain search.
    query = texts.mended_texts(spark, SF)
    assert query.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert len(re.findall("contains", plan(query), re.I)) >= 20


def test_the_vocabulary_is_looked_up_where_the_words_lie(spark):
    docs = spark.createDataFrame([(str(k % 40), f"common words w{'x' * (k % 7)} Common été") for k in range(60)] + [("none", None)], "target string, text string")
    once = spark.createDataFrame(docs.dropDuplicates(["target"]).collect(), docs.schema)
    for d in (docs, once):
        words = [(t, w) for t, text in d.collect() for w in re.findall(r"[^\W\d_]{3,}", (text or "").lower())]
        wanted = {(w, len({t for t, x in words if x == w}), sum(x == w for _, x in words)) for w in {w for _, w in words}}
        got = search.vocabulary(d, 6, 10)
        assert {tuple(x) for x in got.collect()} == {x for x in wanted if x[1] >= 6 and x[2] >= 10}
    # No text and no word of a document is shuffled, only sums.
    assert "hashpartitioning(target" not in plan(search.vocabulary(once, 6, 10))
    asked = quality.cleanliness(docs, spark.createDataFrame([("common",), ("words",)], "word string"))
    assert "BroadcastHashJoin" in plan(asked) and "hashpartitioning(target" in plan(asked) and "hashpartitioning(word" not in plan(asked)
    assert {x["known"] for x in asked.where("target <> '5'").collect()} <= {3, 6}


def test_a_long_vocabulary_is_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "one two two six"), ("b", "ten")], "target string, text string")
    words = spark.createDataFrame([("two",), ("six",)], "word string")
    at_once = sorted(map(tuple, quality.cleanliness(docs, words).collect()))
    monkeypatch.setattr("tomespark.sources.shared.TOLD", 1)
    assert sorted(map(tuple, quality.cleanliness(docs, words).collect())) == at_once == [("a", 3, 1, 0.75), ("b", 0, 1, 0.0)]


def test_titles_and_lines_are_judged_by_cheap_signs_first(spark):
    r = random.Random(3)
    parts = "ten Books FILMS poems of the a Review: in review report on the event meeting news Roundup this week in what we're reading GALLERY index of galleries contents site map sitemap Encyclopedia a-b glossary home welcome graphic novels that - | — x 12 newsletter bibliography conference".split(" ")
    titles = [(" ".join(r.choices(parts, k=r.randint(0, 5))),) for _ in range(3000)] + [(None,), ("Contents",), ("What we're reading",), ("This week in x",), ("site  map",), ("Site map",)]
    rows = spark.createDataFrame(titles, "t string")
    plain = F.exists(F.split("t", quality._TITLE_PARTS), lambda p: p.rlike(quality.NOT_WHOLE))
    assert rows.where(~quality.not_whole_title(F.col("t")).eqNullSafe(plain)).count() == 0 < rows.where(plain).count()
    blocks = quality.plain_blocks(spark.createDataFrame([("a", "one  two\n three four \t five \n\n x")], "target string, text string"))
    assert [(x["text"], x["words"]) for x in blocks.orderBy("block_no").collect()] == [("one two", 2), ("three four five", 3), ("x", 1)]
    # The vocabulary is asked of whole texts, not of their lines once more.
    assert plan(texts.text_verdicts(spark, SF)).lower().count("generate posexplode") == 1


def test_texts_are_cut_into_words_once_to_be_repaired(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "Tbe house ofthe king. Tbe Tbe tbe, “Tbe TBE houseof"), ("b", "Houseof tbe. Tbe"), ("c", "the house"), ("d", None), ("e", ""), ("f", "\n'Tbe' tbe’s tbe\nTbe")], "target string, text string")
    words = spark.createDataFrame([(w,) for w in "the house king of".split()], "word string")
    two_steps = {x["target"]: x["text"] for x in repair.with_mended_words(docs, repair.word_mends(docs, words)).collect()}
    got = repair.with_repaired_words(docs, words)
    assert {x["target"]: x["text"] for x in got.collect()} == two_steps
    assert two_steps["b"] == "Houseof the. The" and two_steps["f"] == "\n'The' tbe’s the\nThe" and two_steps["a"].endswith("TBE house of") and (two_steps["d"], two_steps["e"]) == (None, "")
    # What is mended comes from the unknown words that were kept, not from the texts again.
    assert "array_distinct" not in plan(got)
    monkeypatch.setattr("tomespark.sources.shared.TOLD", 1)
    assert {x["target"]: x["text"] for x in repair.with_repaired_words(docs, words).collect()} == two_steps


def test_noise_is_not_sought_in_lists(spark):
    words = spark.createDataFrame([(w,) for w in "the house king".split()], "word string")
    texts_ = [("a", 0, "the house ##1 @@ xq§ the king"), ("a", 1, "@@ ## «» the"), ("b", 0, "the @@ house"), ("c", 0, ""), ("d", 0, "the king Zq @@ ##"), ("e", 0, "@@ @@ @@")]
    got = repair.split_junk(spark.createDataFrame(texts_, "target string, n int, text string"), words)
    assert {tuple(x) for x in got.collect()} == {("a", 0, 0, "the house"), ("a", 0, 1, "the king"), ("a", 1, 0, "the"), ("b", 0, 0, "the @@ house"), ("d", 0, 0, "the king")}
    assert "map_from_entries" not in plan(got) and "try_element_at" not in plan(got)
    # The text of a filter is made once.
    made = spark.createDataFrame(texts_, "target string, n int, text string").withColumn("text", F.regexp_replace("text", "h", "H"))
    assert plan(repair.once(made).where("char_length(text) > 3 AND text <> 'x'")).count("regexp_replace") == 1


def test_parts_of_texts_stay_small(spark, monkeypatch):
    monkeypatch.setattr("tomespark.plans.inputs.PART", 20_000)
    docs = texts.texts(spark, SF)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    whole = texts.reindexed_documents(spark, SF)
    # What documents are dealt by also deals their terms: no posting is shuffled.
    assert set(re.findall(r"hashpartitioning\(([^)]*)", plan(whole))) and not re.findall(r"hashpartitioning\(target#\d+, term", plan(whole))
    assert max(int(n) for n in re.findall(r"hashpartitioning\(target#\d+, (\d+)\)", plan(whole))) >= size // 20_000 > 8
