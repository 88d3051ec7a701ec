"""Operators on small literal cases."""

import io
import json
import math
import os
import random
import struct
import time
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tomespark.functions import text as fn
from tomespark.functions import urls
from tomespark.operators import feeds, history, intervals, ordering, quality, sampling, search, state, threads
from tomespark.sources import feeds as feed_source
from tomespark.sources import files, logs, texts
from tomespark.streaming import visits as stream

NOW = datetime(2024, 1, 31, 12)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def of(spark, f, *values):
    return one(spark, f(*(F.lit(v) for v in values)))


def test_fold_keeps_length(spark):
    for s, want in {"KAFATASI Kafatası": "kafatasi kafatasi", "İstanbul": "istanbul", "Éreau’s": "ereau's", "": ""}.items():
        assert of(spark, fn.fold, s) == want and len(want) == len(s)


def test_names_and_numbers(spark):
    assert of(spark, fn.slug, "--The Wanderer's: Library!--") == "the-wanderer-s-library"
    assert [of(spark, fn.part_number, t) for t in ("A, Part 12", "A (Part IV)", "A chapter 3: b", "A")] == [12, 4, 3, 0]
    assert of(spark, fn.series_key, "The Tale [FINAL] - Part 3") == "the tale"
    assert of(spark, fn.title_case, "THE WAY OF THE KING") == "The Way of the King"
    assert spark.range(1).select(fn.upper_in(F.lit("ilık"), F.lit("tr"))).collect()[0][0] == "İLIK"
    assert of(spark, fn.file_name, 'a/b:c*?"d"... ') == "a b c d"
    assert of(spark, fn.base_subject, "Re: AW: Re[2]: Hello") == "hello"
    assert [of(spark, fn.roman_value, s) for s in ("xiv", "XC", "no")] == [14, 90, 0]
    assert [of(spark, fn.human_size, n) for n in (12, 2048, 5 << 20, 3 << 30)] == ["12 B", "2 KB", "5.0 MB", "3.0 GB"]
    assert sorted(["a10", "a2", "A1"], key=lambda s: of(spark, fn.natural_key, s)) == ["A1", "a2", "a10"]
    assert of(spark, fn.markdown_link, "a[b]", "http://x/ (y)") == "[a\\[b\\]](<http://x/ (y)>)"
    assert of(spark, fn.same_word, "statue", "statues") and not of(spark, fn.same_word, "statue", "status quo")


def test_addresses(spark):
    assert of(spark, urls.call_number, "http://scp-wiki.wikidot.com/scp-173") == "FIC·SCP·173"
    assert of(spark, urls.page_kind, "gemini://x.example/") == "smallweb"
    assert of(spark, urls.last_segment, "/a/b/") == "b"
    assert of(spark, urls.unwrapped, "https://d.example/l/?uddg=https%3A%2F%2Fx.example%2Fa&z=1") == "https://x.example/a"
    assert of(spark, urls.feed_key, "https://www.X.example/feed/") == "x.example/feed"


def test_items_lifecycle(spark):
    schema = "item_id long, feed_id string, guid string, title string, published timestamp, content string, added timestamp, read boolean, starred boolean"
    old = spark.createDataFrame([(1, "f", "a", "One", NOW, "long content", NOW, True, False), (2, "f", "b", "Two", NOW, "x", NOW, False, True)], schema)
    new = spark.createDataFrame([(9, "f", "a", "One again", NOW, "short", NOW, False, False, 1), (3, "f", "c", "Three", NOW, "new", NOW, False, False, 1), (2, "f", "b", "Two", NOW, "longer", NOW, False, False, 1)], schema + ", seq int")
    got = {r["guid"]: r for r in feeds.upsert(old, new).collect()}
    assert (got["a"]["title"], got["a"]["content"], got["a"]["read"], got["a"]["new"]) == ("One again", "long content", True, False)
    assert got["b"]["content"] == "longer" and got["b"]["starred"] and got["c"]["new"]
    assert feeds.counts(feeds.upsert(old, new)).collect()[0].asDict() == {"feed_id": "f", "unread": 2, "total": 3}


def test_chapters_merge(spark):
    known = spark.createDataFrame([(1, "u1", "One", 1), (1, "u2", "Two", 2)], "serial_id int, url string, title string, n long")
    listed = spark.createDataFrame([(1, "u2", "", 0), (1, "u3", "Three", 1)], "serial_id int, url string, title string, place int")
    got = {r["url"]: (r["n"], r["title"]) for r in feeds.merge_chapters(known, listed).collect()}
    assert got == {"u1": (1, "One"), "u2": (2, "Two"), "u3": (3, "Three")}
    assert feeds.merge_chapters(known, listed.limit(0)).count() == 2


def test_ledger(spark):
    rows = [("f/1", "feed", NOW - timedelta(days=2)), ("w/1", "web", NOW - timedelta(days=20)), ("w/1", "web", NOW - timedelta(days=1)), ("w/2", "web", NOW - timedelta(hours=1))]
    log = spark.createDataFrame([(t, k, "", at, n) for n, (t, k, at) in enumerate(rows)], "target string, kind string, title string, seen_at timestamp, pos int")
    got = {r["kind"]: [r[f"{c}_{s}"] for c in ("days", "opens", "pages") for s in ("7", "30", "all")] for r in history.ledger(log, NOW).collect()}
    assert got == {None: [3, 4, 4, 3, 4, 4, 3, 3, 3], "feed": [1, 1, 1, 1, 1, 1, 1, 1, 1], "web": [2, 3, 3, 2, 3, 3, 2, 2, 2]}


def test_tombstones(spark):
    rows = [("a/1", 1, False, False), ("a", 2, False, False), ("a", 3, True, True), ("a/1", 4, False, False), ("ab", 1, False, False), ("b", 5, False, False), ("b", 6, True, False), ("b/x", 5, False, False)]
    log = spark.createDataFrame(rows, "target string, pos int, forget boolean, under boolean").withColumn("kind", F.lit("web"))
    assert sorted((r["target"], r["pos"]) for r in history.without_forgotten(log).collect()) == [("a/1", 4), ("ab", 1), ("b/x", 5)]


def test_intervals_against_sets(spark):
    draw = random.Random(3)
    rows = [(k, lo := draw.randrange(200), lo + draw.randrange(9)) for k in range(3) for _ in range(40)]
    got = intervals.merged(spark.createDataFrame(rows, "k int, lo long, hi long"), "k").collect()
    for k in range(3):
        want = {x for key, lo, hi in rows if key == k for x in range(lo, hi + 1)}
        own = sorted((r["lo"], r["hi"]) for r in got if r["k"] == k)
        assert {x for lo, hi in own for x in range(lo, hi + 1)} == want and all(b + 1 < c for (_, b), (c, _) in zip(own, own[1:]))
    ranges = intervals.parse(F.lit("1-500, 503"))
    assert one(spark, intervals.count_in(ranges, F.lit(490).cast("long"), F.lit(600).cast("long"))) == 12
    assert one(spark, intervals.has(ranges, F.lit(503))) and not one(spark, intervals.has(ranges, F.lit(502)))


DOCS = [("1", "web", "The Statue", "An old statue stands in the square", 1), ("2", "feed", "Other", "A statue, and a statuette near by", 2), ("3", "book", "Kafatası", "nothing of the kind", 3)]


@pytest.fixture(scope="module")
def indexed(spark):
    docs = spark.createDataFrame(DOCS, "target string, kind string, title string, text string, updated int").cache()
    return docs, search.postings(docs).cache()


@pytest.mark.parametrize("q,want", [("statue", ["1", "2"]), ("kafatasi", ["3"]), ('"old statue"', ["1"]), ("stat near", ["2"]), ("AND near", ["2"]), ('"', []), ("NEAR(", ["2"]), ("title:x", []), ("an", ["1"])])
def test_search(indexed, q, want):
    assert [r["target"] for r in search.search(*indexed, q).collect()] == want


def test_search_by_kind_and_replacement(indexed, spark):
    docs, index = indexed
    assert [r["target"] for r in search.search(docs, index, "statue", kind="feed").collect()] == ["2"]
    changed = spark.createDataFrame([("1", "web", "Empty", "no more of it", 4)], docs.schema)
    assert [r["target"] for r in search.search(changed.unionByName(docs.where("target <> '1'")), search.reindexed(index, changed), "statue").collect()] == ["2"]


def test_kin_of_pages_read_before(spark):
    letters = lambda n: "".join(chr(97 + int(d)) for d in f"{n:05d}")
    rare = "quasar nebula"
    rows = [(f"f{n}", f"T{letters(n)}", letters(n), n) for n in range(400)]
    rows += [("w5f:s/ch/2", "Story Two", rare, 1010), ("w5f:s/ch/1", "Story One", rare, 1001), ("copy", "STORY TWO", rare, 1002), ("later", "Later", rare, 1011), ("unread", "Unread", rare, None), ("long", "Long", rare + " and so on" * 20, 1003), ("short", "Short", rare, 1004)]
    docs = spark.createDataFrame(rows, "target string, title string, text string, last long")
    asked = docs.where("target = 'w5f:s/ch/2'").select("target", F.col("last").alias("before"))
    got = search.read_kin(docs.select("target", "title", "text"), docs.select("target", "last"), asked).collect()
    assert [tuple(r) for r in got] == [("w5f:s/ch/2", "short", 2)]
    assert search.read_kin(docs.select("target", "title", "text"), docs.select("target", "last"), asked.withColumn("before", F.lit(1003).cast("long"))).count() == 0


def test_judge(spark):
    para = " ".join(["Words"] + ["words"] * 79) + "."
    docs = spark.createDataFrame([("good", "fiction", "A tale", "\n".join([para] * 12)), ("short", "fiction", "A tale", "\n".join([para] * 5)), ("small", "smallweb", "A tale", "\n".join([para] * 5)), ("list", "fiction", "10 best books of the year", "\n".join([para] * 12))], "target string, kind string, title string, text string")
    measured = quality.measures(quality.plain_blocks(docs)).join(docs.select("target", "kind", "title"), "target")
    got = {r["target"]: (r["words"], r["reasons"]) for r in quality.verdicts(measured, F.col("kind"), F.col("title")).collect()}
    assert got == {"good": (960, []), "short": (400, ["short"]), "small": (400, []), "list": (960, ["title"])}


def test_judge_knows_verse_and_bad_print(spark):
    poem = "\n\n".join("\n".join(["the sea lies grey,"] * 4) for _ in range(12))
    scan = "\n".join([" ".join(["Known"] + ["known"] * 29 + ["qzx"] * 20) + "."] * 14)
    docs = spark.createDataFrame([("poem", "fiction", "News", poem), ("scan", "weird", "A tale", scan), ("web", "smallweb", "A tale", scan), ("few", "weird", "A tale", scan[:900])], "target string, kind string, title string, text string")
    blocks = quality.plain_blocks(docs)
    words = spark.createDataFrame([("known",), ("the",), ("sea",), ("lies",), ("grey",)], "word string")
    measured = quality.with_clean(quality.measures(blocks), blocks, words).join(docs.select("target", "kind", "title"), "target")
    got = {r["target"]: (r["verse"], r["reasons"]) for r in quality.verdicts(measured, F.col("kind"), F.col("title")).collect()}
    assert got == {"poem": (True, []), "scan": (False, ["garbled"]), "web": (False, []), "few": (False, ["short"])}


def test_judge_of_pages(spark):
    lines = "<br>".join(["the sea lies grey,"] * 30)
    para = "<p>and so it " + " ".join(["went"] * 400) + " on,</p>"
    pages = spark.createDataFrame([("poem", "http://a.org/x", f"<title>Sea</title><p>{lines}"), ("cut", "http://a.org/y", f"<title>News &amp; more</title>{para}"), ("own", "http://a.org/z", f"<title> And so\n</title>{para}"), ("at", "https://poets.org/poem/z", f"<p>{'word ' * 50}"), ("none", None, None)], "target string, url string, html string")
    titles = files.page_titles(pages)
    assert {r["target"]: r["title"] for r in titles.collect()} == {"poem": "Sea", "cut": "News & more", "own": "And so", "at": "", "none": ""}
    rows = titles.join(quality.measures(files.page_blocks(pages)), "target")
    got = {r["target"]: r["reasons"] for r in quality.verdicts(rows, F.lit("web"), F.col("title"), F.col("url"), F.col("title")).collect()}
    assert got == {"poem": [], "cut": ["title", "starts mid-text", "ends mid-text"], "own": ["ends mid-text"], "at": []}


def test_threads(spark):
    rows = [(1, "Hello", "<1>", []), (2, "Re: Hello", "<2>", ["<1>"]), (3, "Re: Hello", "<3>", ["<0>", "<2>"]), (4, "Re: Hello", "<4>", ["<gone>"]), (5, "Other", "<5>", []), (6, "x", "<6>", ["<6>"])]
    posts = spark.createDataFrame([("g", n, s, m, r, n) for n, s, m, r in rows], "g string, num long, subject string, message_id string, references array<string>, date long")
    assert {r["num"]: r["parent"] for r in threads.parents(posts, "g").collect()} == {1: None, 2: 1, 3: 2, 4: 1, 5: None, 6: None}
    got = {r["num"]: (r["root"], r["depth"]) for r in threads.threads(spark, posts, "g").collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 1), 5: (5, 0), 6: (6, 0)}


def test_eviction_drops_what_was_read_longest_ago(spark):
    cache = spark.createDataFrame([(k, 10, 100 - k) for k in range(100)], "k int, size long, read int")
    kept = {r["k"] for r in ordering.trimmed(cache, 500).collect()}
    assert kept == set(range(45))


def test_unique_names_split_one_name(spark):
    order = list(range(3000))
    random.Random(5).shuffle(order)
    rows = [(n, "hot" if n % 3 else None if n % 2 else f"n{n % 7}") for n in order] + [(None, "hot")]
    df = ordering.unique_names(spark.createDataFrame(rows, "k long, name string"), "name", "k")
    seen, want = {}, set()
    for k, name in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        seen[name] = n = seen.get(name, 0) + 1
        want.add((k, name, name if n == 1 else "-".join(x for x in (name, str(n)) if x)))
    got = df.collect()
    assert df.columns == ["k", "name", "unique_name"] and len(got) == len(rows) and set(map(tuple, got)) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(name#" in plan and all(", _b#" in part.split("windowspecdefinition(name#")[1][:60] for part in plan.splitlines() if "windowspecdefinition(name#" in part)


def test_dice(spark):
    with pytest.raises(ValueError):
        sampling.parse_dice("101d6")
    rolls = [r[0] for r in spark.range(2000).select(sampling.rolled("4d6kh3+2", 1, F.col("id"))).collect()]
    assert min(rolls) >= 5 and max(rolls) == 20 and 13.5 < sum(rolls) / 2000 < 15
    first = spark.range(3000).select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in ((1, 8.0), (2, 1.0), (3, 1.0))))).alias("x"), "id")
    draws = first.select("id", "x.k", (-F.log(sampling.uniform(3, F.col("id"), F.col("x.k"))) / F.col("x.w")).alias("d")).groupBy("id").agg(F.min_by("k", "d").alias("k")).where("k = 1").count()
    assert draws >= 2000


def test_state(spark):
    changes = spark.createDataFrame([("hp", 1, 90), ("hp", 2, 30), ("hp", 3, -20), ("xp", 1, -5)], "name string, pos int, delta int")
    assert {r["name"]: r["value"] for r in state.counters(changes).collect()} == {"hp": 80, "xp": 0}
    words = spark.createDataFrame([(1, "Apple"), (2, "apply"), (3, "bee")], "entry int, word string")
    assert [r["word"] for r in state.suggestions(words, "APP", 5).collect()] == ["Apple", "apply"]
    synonyms = spark.createDataFrame([("bumble", 3)], "synonym string, entry int")
    assert [r["word"] for r in state.looked_up(words, synonyms, "Bumble").collect()] == ["bee"]
    options = spark.createDataFrame([("s", k, k) for k in range(3)], "subject string, option int, i int")
    said = spark.createDataFrame([("s", 0, 5), ("s", 1, 9)], "subject string, option int, pos int")
    assert state.least_recent(options, said, 0).collect()[0]["option"] == 2


def test_feeds_are_parsed(spark):
    rss = """<?xml version="1.0"?><rss version="2.0"><channel><title>T</title><item><title>A &amp; B</title><guid isPermaLink="false">g1</guid><link>http://x/1</link><pubDate>Wed, 03 Jan 2024 10:00:00 +0000</pubDate><description>&lt;p&gt;s</description></item><item><title>B</title><link>http://x/2</link></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><entry><title type="html">C</title><id>u:1</id><link rel="self" href="http://s"/><link href="http://y/1"/><updated>2024-01-02T00:00:00Z</updated><content type="html">body</content></entry><entry><title>D</title><id>u:2</id><link href="http://y/2"/><updated>2024-01-05T00:00:00Z</updated></entry></feed>"""
    js = json.dumps({"version": "1", "title": "T", "items": [{"id": "j1", "url": "http://z/1", "title": "D", "content_text": "t", "date_published": "2030-01-01T00:00:00Z"}]})
    bodies = spark.createDataFrame([("r", rss), ("a", atom), ("j", js), ("n", "<html>"), ("e", None)], "feed_id string, body string")
    got = {(r["feed_id"], r["guid"]): r for r in feed_source.feed_items(bodies, NOW).collect()}
    assert set(got) == {("r", "g1"), ("r", "http://x/2"), ("a", "u:1"), ("a", "u:2"), ("j", "j1")}
    assert got["r", "g1"]["title"] == "A & B" and got["r", "g1"]["published"] == datetime(2024, 1, 3, 10)
    assert got["a", "u:1"]["link"] == "http://y/1" and got["a", "u:1"]["content"] == "body" and got["j", "j1"]["published"] == NOW


def test_opml(spark):
    body = """<opml version="2.0"><head><title>t</title></head><body><outline text="Top" xmlUrl="http://t"/><outline text="Shelf"><outline text="A" xmlUrl="http://a" htmlUrl="http://h"/><outline text="Inner"><outline title="B" text="b" xmlUrl="http://b"/></outline></outline></body></opml>"""
    got = {(r["title"], r["url"], r["shelf"]) for r in feed_source.opml_feeds(spark.createDataFrame([("l", body)], "list string, body string")).collect()}
    assert got == {("Top", "http://t", ""), ("A", "http://a", "Shelf"), ("B", "http://b", "Inner")}
    listed = spark.createDataFrame([("1", "A<", "S", ["http://a"]), ("2", "B", "S", ["http://b"]), ("3", "C", "S", [])], "id string, name string, shelf string, url array<string>")
    worked = spark.createDataFrame([("2", "http://b2"), ("1", "")], "id string, url string")
    out = feed_source.to_opml(listed, worked).collect()[0]["outline"]
    assert out == '<outline text="S"><outline type="rss" text="A&lt;" xmlUrl="http://a"/><outline type="rss" text="B" xmlUrl="http://b2"/></outline>'


def test_plain_formats(spark):
    def docs(text):
        return spark.createDataFrame([("t", text)], "target string, text string")

    assert [(r["kind"], r["text"]) for r in texts.paragraphs(docs("# Title\n\none\ntwo\n\n\nthree")).orderBy("block_no").collect()] == [("heading", "Title"), ("paragraph", "one two"), ("paragraph", "three")]
    gem = texts.gemtext(docs("# H\n=> gemini://x A link\n=> /y\n```\na\n b\n```\n* item\n> said\nplain")).orderBy("block_no").collect()
    assert [(r["kind"], r["text"], r["href"]) for r in gem] == [("heading", "H", ""), ("link", "A link", "gemini://x"), ("link", "/y", "/y"), ("pre", "a\n b", ""), ("item", "item", ""), ("quote", "said", ""), ("paragraph", "plain", "")]
    menu = texts.gopher_menu(docs("iHello\tx\ty\t70\n0Text\t/a\th.example\t70\nhWeb\tURL:http://w\th\t70\n.")).orderBy("n").collect()
    assert [(r["type"], r["label"], r["href"]) for r in menu] == [("i", "Hello", ""), ("0", "Text", "gopher://h.example/0/a"), ("h", "Web", "http://w")]
    note = texts.front_matter(docs('---\ntitle: "A"\ntags: b\n---\nbody')).collect()[0]
    assert [tuple(x) for x in note["meta"]] == [("title", "A"), ("tags", "b")] and note["body"] == "body"
    queue = texts.queue_entries(docs("own line\n## Later\n- [ ] [A \\[b\\]](http://a) · cat\n- [x] [B](<http://b c>)")).orderBy("n").collect()
    assert [(r["section"], r["done"], r["title"], r["url"], r["catalog"]) for r in queue] == [("Later", False, "A [b]", "http://a", "cat"), ("Later", True, "B", "http://b c", "")]


def test_books_and_dictionaries(spark, tmp_path):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="urn:y"><manifest><item id="b" href="2.html"/><item id="a" href="1.html"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("O/1.html", "<h1>First</h1><p>x")
        z.writestr("O/2.html", "<title>Second</title>")
    (tmp_path / "books").mkdir()
    (tmp_path / "books/a.epub").write_bytes(book.getvalue())
    (tmp_path / "books/bad.epub").write_bytes(b"no")
    assert {r["size"] for r in files.file_list(spark, str(tmp_path / "books"), files.BOOKS).collect()} == {len(book.getvalue()), 2}
    raw = spark.read.format("binaryFile").load(str(tmp_path / "books"))
    assert [(r["n"], r["title"]) for r in files.epub_chapters(raw).orderBy("n").collect()] == [(0, "First"), (1, "Second")]
    assert {r["v"] for r in raw.select(files.sniffed(F.col("content")).alias("v")).collect()} == {"zip", ""}
    (tmp_path / "dict").mkdir()
    entries, at, body = b"", 0, b""
    for word, text in (("ant", b"an insect"), ("bée", "flies é".encode())):
        entries += word.encode() + b"\0" + struct.pack(">II", len(body), len(text))
        body += text
    (tmp_path / "dict/d.idx").write_bytes(entries)
    (tmp_path / "dict/d.dict").write_bytes(body)
    assert {(r["word"], r["text"]) for r in files.dictionary(spark, str(tmp_path / "dict")).collect()} == {("ant", "an insect"), ("bée", "flies é")}


def test_mail(spark):
    raw = b"Message-ID: <1@x>\r\nSubject: =?utf-8?q?Caf=C3=A9?=\r\nFrom: A <a@x>\r\nReferences: <0@x> <9@x>\r\nContent-Type: text/plain; charset=iso-8859-1; format=flowed\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\none =\r\n\r\ntwo =E9\r\n"
    got = files.articles(spark.createDataFrame([(1, bytearray(raw))], "num long, content binary")).collect()[0]
    assert (got["subject"], got["references"], got["message_id"]) == ("Café", ["<0@x>", "<9@x>"], "<1@x>") and "two é" in got["body"]
    lines = spark.createDataFrame([("1\ts\tf\td\t<m>\t<a> <b>\t10\t5",), ("2\tshort",)], "value string")
    assert [(r["num"], r["references"], r["lines"]) for r in files.overviews(lines).collect()] == [(1, ["<a>", "<b>"], 5)]


def test_page_blocks(spark):
    page = "<html><head><title>no</title></head><body><nav>no</nav><h2>Head</h2><p>one <a href='/x'>two</a><p>three<ul><li>item</ul><pre>code</pre><table><tr><td>c</table><script>no</script>"
    pages = spark.createDataFrame([("p", page), ("n", None)], "target string, html string")
    rows = files.page_blocks(pages).orderBy("block_no").collect()
    assert [(r["kind"], r["in_list"], r["text"], r["link_words"]) for r in rows] == [("heading", False, "Head", 0), ("paragraph", False, "one two", 1), ("paragraph", False, "three", 0), ("paragraph", True, "item", 0), ("pre", False, "code", 0), ("cell", False, "c", 0)]
    assert [r["href"] for r in files.page_links(pages).collect()] == ["/x"]
    assert files.as_markdown(files.page_blocks(pages)).collect()[0]["markdown"].startswith("## Head\n\none two\n\nthree\n\n- item")


def test_logs(spark, tmp_path):
    folder = str(tmp_path / "log")
    os.makedirs(folder)
    with open(f"{folder}/a.json", "w") as f:
        f.write('{"t":"w/1","ti":"T","k":"web","at":1706000000000000000}\n{"t":"","at":1}\n{"t":"w/1","at":1706000001000000000,"f":true}\n{"t":"w/2","at":17060')
    got = logs.read_visits(spark, folder).orderBy("at").collect()
    assert [(r["target"], r["title"], r["forget"]) for r in got] == [("w/1", "T", False), ("w/1", "", True)]
    logs.append_visits(logs.read_visits(spark, folder), folder)
    assert logs.read_visits(spark, folder).count() == 4


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "log")
    os.makedirs(folder)
    day = 86_400 * 10**9
    for n, at in enumerate((19_700 * day, 19_700 * day + 10**9, 19_705 * day)):
        with open(f"{folder}/{n}.json", "w") as f:
            f.write(json.dumps({"t": f"w/{n % 2}", "ti": f"T{n}", "k": "web", "at": at}) + "\n")
        os.utime(f"{folder}/{n}.json", (1_700_000_000 + n,) * 2)
    visits = stream.stream_visits(spark, folder, 1)
    q = stream.running_history(visits).writeStream.outputMode("complete").format("memory").queryName("hist").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["target"]: (r["opens"], r["title"]) for r in spark.table("hist").collect()} == {"w/0": (2, "T2"), "w/1": (1, "T1")}
    q = stream.windowed_opens(stream.stream_visits(spark, folder, 1)).writeStream.outputMode("append").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["kind"], r["opens"]) for r in spark.table("days").collect()] == [("web", 2)]


def test_feed_upkeep_stream(spark, tmp_path):
    schema = "item_id long, feed_id string, guid string, title string, published timestamp, content string, added timestamp, read boolean, starred boolean"
    source = str(tmp_path / "in")
    now = datetime.now()
    for n, rows in enumerate(([(1, "f", "a", "One", now, "xx", now, False, False)], [(9, "f", "a", "Again", now, "x", now, False, False), (2, "f", "b", "Two", now, "y", now, False, False)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    batches = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.upkeep(batches, str(tmp_path / "items"), str(tmp_path / "check")).awaitTermination(180)
    last = max(x for x in os.listdir(tmp_path / "items") if x.startswith("v"))
    got = {r["guid"]: (r["title"], r["content"]) for r in spark.read.parquet(str(tmp_path / "items" / last)).collect()}
    assert got == {"a": ("Again", "xx"), "b": ("Two", "y")}


def test_kin_pairs_are_no_rows(spark, monkeypatch):
    """Words of one document in fifty and more: pairs are compared in blocks, and the best of all is found whatever the blocks are."""
    rng = random.Random(3)
    marks = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(60)]
    words = {w: rng.sample(range(600), 12) for w in marks}
    docs = {f"d{n:03d}": " ".join(["common", *(w for w in marks if n in words[w])]) for n in range(600)}
    table = spark.createDataFrame(list(docs.items()), "target string, text string")
    held = {t: set(x.split()) for t, x in docs.items()}
    df = {w: sum(w in h for h in held.values()) for h in held.values() for w in h}
    want = {}
    for t, own in held.items():
        rare = sorted((w for w in own if 2 <= df[w] <= 12 and 5 <= len(w) <= 24 and w.isalpha()), key=lambda w: (-round(math.log(601 / df[w]), 9), w))[:10]
        found = sorted((-len(h.intersection(rare)), k) for k, h in held.items() if k != t and len(h.intersection(rare)) >= 2)
        if found:
            want[t] = (found[0][1], -found[0][0])
    for size in (1 << 30, 150):
        monkeypatch.setattr(search, "ASKED_WORDS", size)
        monkeypatch.setattr(search, "HELD_WORDS", size)
        monkeypatch.setattr(search, "PAIRS", min(size, 64))
        got = search.kin(table)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert {r["target"]: (r["kin"], r["shared"]) for r in got.collect()} == want and want
        # No join of the asking words with all that hold them is left in the plan.
        assert "FlatMapCoGroupsInArrow" in plan


def test_a_task_holds_few_blocks(monkeypatch):
    """However many pages a batch has, blocks go on after a bounded number of characters."""
    import pyarrow as pa

    monkeypatch.setattr(files, "BLOCK_CHARS", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{n}" for n in range(30)]), pa.array(["<h1>A</h1><p>some words of a page</p>"] * 29 + [None])], names=["target", "html"])
    out = list(files._block_rows(iter([batch])))
    assert len(out) == 6 and max(b.num_rows for b in out) <= 10
    assert [(r["block_no"], r["kind"], r["text"]) for b in out for r in b.to_pylist() if r["target"] == "p3"] == [(0, "heading", "A"), (1, "paragraph", "some words of a page")]
