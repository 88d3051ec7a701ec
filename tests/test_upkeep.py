"""State upkeep, reports and small functions on literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tomespark.functions import dates, text, urls
from tomespark.operators import feeds, reports, search, upkeep
from tomespark.sources import feeds as feed_source


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_feed_states(spark):
    schema = "feed_id string, url string, title string, last_sync long, last_ok long, last_error string"
    old = spark.createDataFrame([("a", "u", "Known", 1, 1, ""), ("b", "u", "Other", 1, 1, "")], schema)
    tries = spark.createDataFrame([("a", "v", "", 5, 0, "timed out", 1), ("a", "w", "New", 6, 6, "", 2), ("a", "x", "", 7, 0, "again", 3), ("c", "n", "", 2, 0, "lost", 1)], schema + ", seq long")
    got = {r["feed_id"]: (r["url"], r["title"], r["last_sync"], r["last_ok"], r["last_error"]) for r in upkeep.feed_states(old, tries).collect()}
    assert got == {"a": ("x", "New", 7, 6, "again"), "b": ("u", "Other", 1, 1, ""), "c": ("n", "", 2, 0, "lost")}


def test_books_come_back(spark):
    schema = "path string, format string, title string, author string, lang string, source string, chapters long, added long"
    old = spark.createDataFrame([("p", "epub", "T", "A", "en", "disk", 9, 1, 50, 3, 0.5, True), ("q", "epub", "Q", "A", "en", "disk", 9, 1, 0, 0, 0.0, True)], schema + ", opened long, chapter long, pos double, missing boolean")
    got = {r["path"]: r for r in upkeep.books(old, spark.createDataFrame([("p", "epub", "T2", "B", "en", "", 0, 99, 1), ("n", "pdf", "N", "", "", "", 0, 7, 1)], schema + ", seq long")).collect()}
    assert (got["p"]["title"], got["p"]["source"], got["p"]["chapters"], got["p"]["added"], got["p"]["opened"], got["p"]["missing"]) == ("T2", "disk", 9, 1, 50, False)
    assert got["q"]["missing"] and not got["n"]["missing"] and got["n"]["added"] == 7 and got["n"]["opened"] == 0


def test_a_finished_comic_stays_finished(spark):
    comics = spark.createDataFrame([("a", 0, 0, False), ("b", 0, 0, True)], "path string, page int, opened long, finished boolean")
    turns = spark.createDataFrame([("a", 9, 10, 1, 1), ("a", 2, 10, 2, 2), ("b", 1, 10, 3, 3)], "path string, page int, pages int, at long, seq long")
    assert {tuple(r) for r in upkeep.progressed(comics, turns).collect()} == {("a", 2, 2, True), ("b", 1, 3, True)}


def test_read_sets(spark):
    groups = spark.createDataFrame([("new", 250), ("few", 30), ("old", 20)], "name string, hi long")
    known = spark.createDataFrame([("old", 1, 5)], "name string, lo long, hi long")
    marks = spark.createDataFrame([("old", 6), ("old", 9), ("few", None), ("new", 200)], "name string, num long")
    got = sorted(tuple(r[c] for c in ("name", "lo", "hi")) for r in upkeep.read_sets(groups, known, marks).collect())
    assert got == [("few", 1, 30), ("new", 1, 150), ("new", 200, 200), ("old", 1, 6), ("old", 9, 9)]


@pytest.mark.parametrize("value", ["", "abc", "é" * 10, "aé" * 7, "日本語" * 5, "🙂🙂🙂🙂", "x" * 20])
@pytest.mark.parametrize("most", [4, 9, 13])
def test_capped(spark, value, most):
    want = value.encode()[:most].decode("utf-8", "ignore")
    assert one(spark, lambda c: text.capped(c, most), value) == [want]


def test_wording(spark):
    assert one(spark, lambda c: text.number_word(c.cast("int")), "0", "12", "13", "-1") == ["no", "twelve", "13", "-1"]
    assert one(spark, text.name_fold, "Æon_Straße-İI.tar") == ["aeon strasse ii tar"]
    assert one(spark, text.word_at, "  «Don't stop", "123", "well-known, yes", "--x y") == ["Don't", "", "well-known,", "--x"]
    assert one(spark, text.is_plain_word, "word", "Word", "ab", "a" * 15) == [True, False, False, False]
    assert one(spark, text.issue_number, "Saga 12 (v2.5)", "None", "07") == [2.5, 0.0, 7.0]
    now = dt.datetime(2024, 1, 10, 12)
    ago = lambda c: dates.ago(c.cast("timestamp_ntz"), F.lit(now))
    assert one(spark, ago, "2024-01-10 11:59:30", "2024-01-10 11:10:00", "2024-01-08 12:00:01", "2024-01-08 12:00:00") == ["just now", "50 min ago", "47 h ago", "2 days ago"]
    assert one(spark, lambda c: dates.untouched(c.cast("int")), "0", "1", "3", "40") == ["since today", "one day", "three days", "40 days"]


def test_addresses(spark):
    assert one(spark, urls.is_prose, "http://scp-wiki.wikidot.com/scp-173", "http://scp-wiki.wikidot.com/a-tale", "https://www.gutenberg.org/x", "https://a.example/") == [False, True, True, False]
    assert one(spark, urls.source_of, "textfiles/a · b", "fiction/r/x · y", "weird/archived worlds: z", "smallweb/Wiby · w") == ["textfiles", "fiction/reddit", "weird/archived worlds", "smallweb/Wiby"]
    assert one(spark, urls.post_key, "https://reddit.com/r/a/comments/1x/part_one/", "https://a.example/p/q") == ["1x", "/p/q"]


def test_comments_whose_parent_is_lost_are_roots(spark):
    rows = spark.createDataFrame([("a", None, 1), ("b", "a", 2), ("c", "gone", 3), ("d", "b", 10), ("e", "b", 9)], "id string, parent string, num long")
    got = sorted((r["order"], r["root"], r["id"], r["depth"]) for r in reports.comment_tree(rows, spark).collect())
    assert [(root, name, depth) for _, root, name, depth in got] == [("a", "a", 0), ("a", "b", 1), ("a", "e", 2), ("a", "d", 2), ("c", "c", 0)]


def test_a_page_tells_whether_more_follow(spark):
    rows = spark.range(7).toDF("n")
    got = [[tuple(r) for r in reports.page_with_more(rows, [F.desc("n")], p, 3).collect()] for p in (1, 2, 3, 4)]
    assert got == [[(6, True), (5, True), (4, True)], [(3, True), (2, True), (1, True)], [(0, False)], []]


def test_hits_among_what_was_read(spark):
    hits = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0), ("d", 9.0)], "target string, score double")
    reads = spark.createDataFrame([("a", 5), ("b", 50), ("c", 1), ("x", 1)], "target string, last long")
    assert [r["target"] for r in search.among_read(hits, reads, "none", 10).collect()] == ["a", "c"]
    assert [r["target"] for r in search.among_read(hits, reads, "a", 10).collect()] == ["c"]


def test_folders_of_any_depth(spark):
    deep = "".join(f'<outline text="F{k}">' for k in range(12)) + "<outline text='A &amp; B' xmlUrl='http://a?x=1&amp;y=2'/>" + "</outline>" * 12
    body = f'<opml><body><!-- <outline text="no" xmlUrl="http://no"/> -->{deep}<outline title="T" xmlUrl="http://t"></outline><outline text="Own"><outline text="C" xmlUrl="http://c"><outline text="D" xmlUrl="http://d"/></outline></outline></body></opml>'
    got = {(r["title"], r["url"], r["shelf"]) for r in feed_source.opml_feeds(spark.createDataFrame([("l", body), ("n", None), ("e", "<opml/>")], "list string, body string")).collect()}
    assert got == {("A & B", "http://a?x=1&y=2", "F11"), ("T", "http://t", ""), ("C", "http://c", "Own"), ("D", "http://d", "C")}


def test_the_latest_of_equal_guids_counts(spark):
    rows = spark.createDataFrame([("f", "g", 1, 10, "old"), ("f", "g", 2, 20, "new"), ("f", "h", 3, 5, "x"), ("f", "h", 4, 5, "y")], "feed_id string, guid string, item_id long, published long, title string")
    assert sorted(r["title"] for r in feeds.latest(rows).collect()) == ["new", "y"]


def test_numbers_of_books(spark):
    got = one(spark, lambda c: urls.book_number(c, F.lit(7)), "gutenberg:345", "libgen:ab", "se:author/A-Book", "site:my-cat.alog:http://x", "disk", "")
    assert got == ["BK·GUT·345", "BK·LG·ab", "BK·SE·a-book", "BK·MYCATALO·7", "BK·LOC·7", "BK·LOC·7"]
    assert one(spark, urls.call_number, "https://www.example.org/a/My%20Page", "https://example.org/A+b")[0] == "WEB·EXAMPLE·my page"
