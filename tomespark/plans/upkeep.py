"""Queries over state upkeep, lists and reports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomespark.functions import dates, text, urls
from tomespark.operators import reports, search, upkeep
from tomespark.plans.inputs import ITEMS, TEXTS, VISITS, items, table, texts, visits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = datetime(2024, 1, 31)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH old AS (SELECT c_custkey AS feed_id, 'http://old/' || c_name AS url, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS title, c_custkey % 50 AS last_sync, c_custkey % 4 AS last_ok, 'e' AS last_error FROM customer),
tries AS (SELECT o_custkey AS feed_id, 'http://new/' || o_orderstatus AS url, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE '' END AS title, o_orderkey AS seq,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE 0 END AS ok, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'failed' END AS err FROM orders),
t AS (SELECT feed_id, arg_max(url, seq) AS url, arg_max(title, seq) FILTER (WHERE title <> '') AS title, max(seq) AS last_sync, arg_max(ok, seq) FILTER (WHERE ok <> 0) AS last_ok, arg_max(err, seq) AS last_error FROM tries GROUP BY 1)
SELECT feed_id, coalesce(t.url, o.url) AS url, coalesce(t.title, o.title, '') AS title, coalesce(t.last_sync, o.last_sync) AS last_sync, coalesce(t.last_ok, o.last_ok, 0) AS last_ok, coalesce(t.last_error, o.last_error) AS last_error
FROM old o FULL JOIN t USING (feed_id)""")
def feed_state_upsert(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    key = F.col("c_custkey")
    old = c.select(key.alias("feed_id"), F.concat(F.lit("http://old/"), "c_name").alias("url"), F.when(key % 3 == 0, "").otherwise(F.col("c_name")).alias("title"), (key % 50).alias("last_sync"), (key % 4).alias("last_ok"), F.lit("e").alias("last_error"))
    n = F.col("o_orderkey")
    ok = n % 3 == 0
    tries = o.select(F.col("o_custkey").alias("feed_id"), F.concat(F.lit("http://new/"), "o_orderstatus").alias("url"), F.when(n % 4 == 0, F.col("o_orderpriority")).otherwise("").alias("title"), n.alias("last_sync"), F.when(ok, n).otherwise(F.lit(0).cast("long")).alias("last_ok"), F.when(ok, "").otherwise("failed").alias("last_error"), n.alias("seq"))
    return upkeep.feed_states(old, tries)


_BOOKS = """old AS (SELECT p_partkey AS path, p_type AS format, p_name AS title, p_brand AS author, 'en' AS lang, 'disk' AS source, p_size AS chapters, p_partkey AS added, p_size * 3 AS opened, p_size % 4 AS chapter, p_size / 100.0 AS pos, p_partkey % 4 = 0 AS missing FROM part WHERE p_partkey % 2 = 0)"""
_EVERY_BOOK = _BOOKS.replace(" WHERE p_partkey % 2 = 0", "")


def _old_books(spark, sf):
    return _every_book(spark, sf).where("path % 2 = 0")


def _every_book(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("path"), F.col("p_type").alias("format"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.lit("en").alias("lang"), F.lit("disk").alias("source"),
        size.alias("chapters"), F.col("p_partkey").alias("added"), (size * 3).alias("opened"), (size % 4).alias("chapter"), (size / 100.0).alias("pos"), (F.col("p_partkey") % 4 == 0).alias("missing"),
    )


@query(f"""WITH {_BOOKS}, scan AS (SELECT p_partkey AS path, 'epub' AS format, upper(p_name) AS title, p_brand AS author, 'tr' AS lang, CASE WHEN p_partkey % 6 = 0 THEN 'net' ELSE '' END AS source, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE 7 END AS chapters, 5 AS added FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 <> 0)
SELECT coalesce(s.path, o.path) AS path, coalesce(s.format, o.format) AS format, coalesce(s.title, o.title) AS title, coalesce(s.author, o.author) AS author, coalesce(s.lang, o.lang) AS lang,
 coalesce(nullif(s.source, ''), o.source, s.source) AS source, coalesce(nullif(s.chapters, 0), o.chapters, s.chapters) AS chapters, coalesce(o.added, s.added) AS added,
 coalesce(opened, 0) AS opened, coalesce(chapter, 0) AS chapter, coalesce(pos, 0.0) AS pos, coalesce(o.missing, false) AND s.path IS NULL AS missing FROM old o FULL JOIN scan s ON o.path = s.path""")
def book_upsert(spark, sf):
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    scan = p.where("p_partkey % 3 = 0 OR p_partkey % 2 <> 0").select(key.alias("path"), F.lit("epub").alias("format"), F.upper("p_name").alias("title"), F.col("p_brand").alias("author"), F.lit("tr").alias("lang"), F.when(key % 6 == 0, "net").otherwise("").alias("source"), F.when(key % 9 == 0, 0).otherwise(7).alias("chapters"), F.lit(5).cast("long").alias("added"), key.alias("seq"))
    return upkeep.books(_old_books(spark, sf), scan)


_COMICS = "comics AS (SELECT p_partkey AS path, p_brand AS series, p_size % 20 AS number, p_name AS title, 10 AS pages, p_size % 2 = 0 AS rtl, p_partkey AS added, p_size AS opened, p_size % 10 AS page, p_size % 5 = 0 AS finished, p_partkey % 7 = 0 AS missing FROM part)"


def _comics(spark, sf):
    p, size = table(spark, sf, "part"), F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("path"), F.col("p_brand").alias("series"), (size % 20).alias("number"), F.col("p_name").alias("title"), F.lit(10).alias("pages"), (size % 2 == 0).alias("rtl"),
        F.col("p_partkey").alias("added"), size.alias("opened"), (size % 10).alias("page"), (size % 5 == 0).alias("finished"), (F.col("p_partkey") % 7 == 0).alias("missing"),
    )


@query(f"""WITH {_COMICS}, scan AS (SELECT p_partkey + 3 AS path, 'S' AS series, 1 AS number, p_name AS title, 12 AS pages, true AS rtl, 9 AS added FROM part WHERE p_partkey % 5 = 0)
SELECT coalesce(s.path, o.path) AS path, coalesce(s.series, o.series) AS series, coalesce(s.number, o.number) AS number, coalesce(s.title, o.title) AS title, coalesce(s.pages, o.pages) AS pages, coalesce(s.rtl, o.rtl) AS rtl,
 coalesce(o.added, s.added) AS added, coalesce(opened, 0) AS opened, coalesce(page, 0) AS page, coalesce(finished, false) AS finished, coalesce(o.missing, false) AND s.path IS NULL AS missing FROM comics o FULL JOIN scan s ON o.path = s.path""")
def comic_upsert(spark, sf):
    scan = table(spark, sf, "part").where("p_partkey % 5 = 0").select((F.col("p_partkey") + 3).alias("path"), F.lit("S").alias("series"), F.lit(1).alias("number"), F.col("p_name").alias("title"), F.lit(12).alias("pages"), F.lit(True).alias("rtl"), F.lit(9).cast("long").alias("added"), F.col("p_partkey").alias("seq"))
    return upkeep.comics(_comics(spark, sf), scan)


@query("""WITH old AS (SELECT c_custkey AS url, 'rr' AS kind, c_name AS title, c_mktsegment AS author, '' AS summary, c_custkey AS added, c_custkey % 2 = 0 AS followed, c_custkey % 7 AS seen, c_nationkey AS opened FROM customer WHERE c_custkey % 3 <> 0),
f AS (SELECT o_custkey AS url, arg_max(o_orderstatus, o_orderkey) AS kind, arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS title, min(o_orderkey) AS added FROM orders GROUP BY 1)
SELECT url, coalesce(f.kind, o.kind) AS kind, coalesce(f.title, o.title, '') AS title, coalesce(o.author, '') AS author, coalesce(o.summary, '') AS summary, coalesce(o.added, f.added) AS added, coalesce(followed, false) AS followed, coalesce(seen, 0) AS seen, coalesce(opened, 0) AS opened FROM old o FULL JOIN f USING (url)""")
def serial_upsert(spark, sf):
    c, key = table(spark, sf, "customer"), F.col("c_custkey")
    old = c.where("c_custkey % 3 <> 0").select(key.alias("url"), F.lit("rr").alias("kind"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"), F.lit("").alias("summary"), key.alias("added"), (key % 2 == 0).alias("followed"), (key % 7).alias("seen"), F.col("c_nationkey").alias("opened"))
    n = F.col("o_orderkey")
    found = table(spark, sf, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderstatus").alias("kind"), F.when(n % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("title"), F.lit("").alias("author"), F.lit("").alias("summary"), n.alias("added"), n.alias("seq"))
    return upkeep.serials(old, found)


@query(f"""WITH {ITEMS}, acts AS (SELECT l_orderkey % 4000 AS item_id, CASE l_linenumber WHEN 1 THEN 'read' WHEN 2 THEN 'unread' WHEN 3 THEN 'star' ELSE 'all_read' END AS action,
  CASE l_orderkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'other' END AS feed_id, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_linenumber <= 3 OR (l_linenumber = 4 AND l_orderkey % 100 = 1)),
every AS (SELECT feed_id, max(seq) AS s FROM acts WHERE action = 'all_read' GROUP BY 1),
sets AS (SELECT item_id, arg_max(action, seq) AS action, max(seq) AS s FROM acts WHERE action IN ('read', 'unread') GROUP BY 1),
stars AS (SELECT item_id, count(*) % 2 = 1 AS turned FROM acts WHERE action = 'star' GROUP BY 1)
SELECT i.item_id, i.feed_id, CASE WHEN every.s > coalesce(sets.s, -1) THEN true WHEN sets.action IS NOT NULL THEN sets.action = 'read' ELSE i.read END AS read, i.starred <> coalesce(turned, false) AS starred
FROM items i LEFT JOIN every USING (feed_id) LEFT JOIN sets USING (item_id) LEFT JOIN stars USING (item_id)""")
def flagged_items(spark, sf):
    n, line = F.col("l_orderkey"), F.col("l_linenumber")
    kind = F.when(line == 1, "read").when(line == 2, "unread").when(line == 3, "star").otherwise("all_read")
    feed = F.when(n % 3 == 0, "click").when(n % 3 == 1, "view").otherwise("other")
    acts = table(spark, sf, "lineitem").where("l_linenumber <= 3 OR (l_linenumber = 4 AND l_orderkey % 100 = 1)").select((n % 4000).alias("item_id"), kind.alias("action"), feed.alias("feed_id"), (n * 10 + line).alias("seq"))
    return upkeep.flagged(items(spark, sf), acts).select("item_id", "feed_id", "read", "starred")


@query(f"""WITH {_COMICS}, t AS (SELECT l_partkey AS path, arg_max(l_linenumber + l_quantity % 7, (l_orderkey * 10 + l_linenumber) * 100 + l_linenumber + l_quantity % 7) AS page, max(l_orderkey * 10 + l_linenumber) AS at, bool_or(l_linenumber + l_quantity % 7 >= 9) AS ended FROM lineitem GROUP BY 1)
SELECT path, CAST(coalesce(t.page, c.page) AS BIGINT) AS page, coalesce(t.at, c.opened) AS opened, finished OR coalesce(ended, false) AS finished FROM comics c LEFT JOIN t USING (path)""")
def comic_progress(spark, sf):
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    page = F.col("l_linenumber") + F.col("l_quantity") % 7
    turns = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("path"), page.alias("page"), F.lit(10).alias("pages"), at.alias("at"), (at * 100 + page).alias("seq"))
    return upkeep.progressed(_comics(spark, sf), turns).select("path", F.col("page").cast("long").alias("page"), F.col("opened").cast("long").alias("opened"), "finished")


@query("""WITH s AS (SELECT c_custkey AS url, c_custkey % 2 = 0 AS followed, c_custkey % 7 AS seen, 'old' AS error FROM customer WHERE c_custkey % 5 <> 0),
ch AS (SELECT o_custkey AS url, count(*) AS n FROM orders GROUP BY 1),
checks AS (SELECT o_custkey AS url, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'timed out' WHEN o_orderkey % 4 = 0 THEN 'no chapters found' ELSE '' END AS err FROM orders WHERE o_orderkey % 2 = 0),
k AS (SELECT url, arg_max(err, seq) AS err, bool_or(err = '') AS good FROM checks GROUP BY 1)
SELECT url, coalesce(followed, false) AS followed, CASE WHEN s.followed IS NULL THEN coalesce(n, 0) ELSE seen END AS seen, coalesce(err, s.error, '') AS error
FROM s FULL JOIN k USING (url) LEFT JOIN ch USING (url) WHERE s.followed IS NOT NULL OR good""")
def checked_serials(spark, sf):
    c, o, n = table(spark, sf, "customer"), table(spark, sf, "orders"), F.col("o_orderkey")
    known = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("url"), (F.col("c_custkey") % 2 == 0).alias("followed"), (F.col("c_custkey") % 7).alias("seen"), F.lit("old").alias("error"))
    checks = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("url"), F.when(n % 3 == 0, "timed out").otherwise("").alias("error"), (n % 4).alias("found"), n.alias("seq"))
    return upkeep.checked(known, o.select(F.col("o_custkey").alias("url")), checks)


@query("SELECT coalesce(sum(c_custkey % 3), 0) AS new, count(*) FILTER (WHERE c_nationkey = 3) AS failed, min(c_name) FILTER (WHERE c_nationkey = 3) AS first_failed, count(*) AS checked FROM customer")
def sync_report(spark, sf):
    return upkeep.sync_report(table(spark, sf, "customer").select(F.col("c_name").alias("feed_id"), (F.col("c_custkey") % 3).alias("new"), F.when(F.col("c_nationkey") == 3, "failed").otherwise("").alias("error")))


@query("""WITH g AS (SELECT o_custkey AS name, max(o_orderkey) AS hi FROM orders GROUP BY 1),
known AS (SELECT o_custkey AS name, min(o_orderkey) AS lo, min(o_orderkey) + 40 AS hi FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1),
spans AS (SELECT * FROM known UNION ALL SELECT name, 1, hi - 100 FROM g WHERE name % 2 <> 0 UNION ALL SELECT o_custkey, o_orderkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT name, 1, hi FROM g WHERE name % 11 = 0),
m AS (SELECT name, lo, hi, max(hi) OVER (PARTITION BY name ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM spans WHERE hi >= lo),
n AS (SELECT name, lo, hi, sum(CASE WHEN b IS NULL OR lo > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT name, min(lo) AS lo, max(hi) AS hi FROM n GROUP BY name, i""")
def newsgroup_read_sets(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("num"))
    groups = o.groupBy("name").agg(F.max("num").alias("hi"))
    known = o.where("name % 2 = 0").groupBy("name").agg(F.min("num").alias("lo"), (F.min("num") + 40).alias("hi"))
    marks = o.where("num % 3 = 0").unionByName(groups.where("name % 11 = 0").select("name", F.lit(None).cast("long").alias("num")))
    return upkeep.read_sets(groups, known, marks)


@query("""WITH b AS (SELECT c_custkey AS serial_id, c_name FROM customer), gone AS (SELECT s_nationkey * 50 AS serial_id FROM supplier)
SELECT 'serial' AS what, count(*) AS n FROM b WHERE serial_id NOT IN (SELECT serial_id FROM gone)
UNION ALL SELECT 'chapter', count(*) FROM orders WHERE o_custkey NOT IN (SELECT serial_id FROM gone)""")
def after_forgetting_serials(spark, sf):
    gone = table(spark, sf, "supplier").select((F.col("s_nationkey") * 50).alias("serial_id"))
    left = lambda rows, what: upkeep.without(rows, gone, "serial_id").agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return left(table(spark, sf, "customer").select(F.col("c_custkey").alias("serial_id")), "serial").unionByName(left(table(spark, sf, "orders").select(F.col("o_custkey").alias("serial_id")), "chapter"))


@query(f"WITH {VISITS} SELECT count(*) FILTER (WHERE starts_with(target, '1')) AS n FROM visits")
def visits_under_prefix(spark, sf):
    return visits(spark, sf).agg(F.count_if(upkeep.under(F.col("target"), "1")).alias("n"))


@query(f"WITH {TEXTS} SELECT target, title FROM texts WHERE NOT starts_with(target, '1')")
def documents_after_prefix_delete(spark, sf):
    return texts(spark, sf).where(~upkeep.under(F.col("target"), "1")).select("target", "title")


@query("""WITH f AS (SELECT regexp_replace(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '/+$', '') AS key FROM pages WHERE page_id % 3 = 0),
w AS (SELECT page_id AS pos, 'page ' || page_id AS name, regexp_replace(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '/+$', '') AS key FROM pages WHERE page_id % 3 <> 0)
SELECT key, name, pos FROM w WHERE key NOT IN (SELECT key FROM f) QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) = 1""")
def new_subscriptions(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("pos"), F.concat(F.lit("page "), "page_id").alias("name"), urls.feed_key(F.col("url")).alias("key"))
    return upkeep.new_subscriptions(p.where("pos % 3 = 0"), p.where("pos % 3 <> 0"))


@query(f"WITH {_COMICS} SELECT series, count(*) AS issues, count(*) FILTER (WHERE NOT finished) AS unread, max(opened) AS opened FROM comics WHERE NOT missing GROUP BY 1")
def comic_series(spark, sf):
    return reports.series_list(_comics(spark, sf))


@query(f"WITH {_COMICS} SELECT path, number, row_number() OVER (ORDER BY number, path) AS place FROM comics WHERE NOT missing AND series = 'Brand#11'")
def issues_of_series(spark, sf):
    place = F.row_number().over(Window.partitionBy("series").orderBy("number", "path"))
    return reports.issues_of(_comics(spark, sf), "Brand#11").select("path", "number", place.cast("long").alias("place"))


@query(f"WITH {_COMICS} SELECT path, finished, opened FROM comics WHERE NOT missing AND opened > 0 ORDER BY finished, opened DESC, path LIMIT 25")
def recent_comics(spark, sf):
    return reports.recent_comics(_comics(spark, sf), 25).select("path", "finished", "opened")


@query(f"WITH {_EVERY_BOOK} SELECT path, author, title FROM old WHERE NOT missing ORDER BY lower(author), lower(title), path LIMIT 40")
def books_by_author(spark, sf):
    return reports.books_in_order(_every_book(spark, sf), "author", 40).select("path", "author", "title")


@query(f"WITH {_EVERY_BOOK} SELECT path, opened FROM old WHERE NOT missing AND opened > 0 ORDER BY opened DESC, path LIMIT 40")
def books_opened_last(spark, sf):
    return reports.books_in_order(_every_book(spark, sf), "recent", 40).select("path", "opened")


@query(f"WITH {_EVERY_BOOK} SELECT path, added FROM old WHERE NOT missing ORDER BY added DESC, path LIMIT 40")
def books_added_last(spark, sf):
    return reports.books_in_order(_every_book(spark, sf), "added", 40).select("path", "added")


@query("""SELECT event_type AS family, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-24 00:00:00') AS week, count(*) AS month FROM events
WHERE ts > TIMESTAMP '2024-01-01 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1""")
def shelf_draws(spark, sf):
    return reports.shelf_draws(table(spark, sf, "events").select(F.col("event_type").alias("family"), F.col("ts").alias("at")), NOW)


_KIND = "CASE doc_id % 5 WHEN 0 THEN 'weird' WHEN 1 THEN 'folklore' WHEN 2 THEN 'queue' WHEN 3 THEN 'unknown' ELSE 'periodical' END"


@query(f"""SELECT CASE k WHEN 'periodical' THEN 1 WHEN 'weird' THEN 2 WHEN 'folklore' THEN 6 ELSE 12 END AS place, k AS kind, count(*) AS n FROM (SELECT {_KIND} AS k FROM documents) WHERE k <> 'unknown' GROUP BY k""")
def cover_counts(spark, sf):
    return reports.cover_counts(table(spark, sf, "documents").select(F.expr(_KIND).alias("kind"))).withColumn("place", F.col("place").cast("int"))


@query("SELECT coalesce(sum(octet_length(encode(text))), 0) AS bytes, count(*) AS files FROM documents WHERE lang IN ('en', 'de') AND doc_id % 9 <> 0")
def cache_size(spark, sf):
    d = table(spark, sf, "documents").select(F.concat_ws("/", "lang", "source", "doc_id").alias("path"), F.octet_length("text").alias("length"), (F.col("doc_id") % 9 == 0).alias("link"))
    return reports.cache_size(d, ["en", "de"])


@query("SELECT lang AS folder, sum(octet_length(encode(text))) AS bytes, count(*) AS files FROM documents GROUP BY 1")
def folder_sizes(spark, sf):
    return reports.folder_sizes(table(spark, sf, "documents").select(F.concat_ws("/", "lang", "source", "doc_id").alias("path"), F.octet_length("text").alias("length")))


@query(f"WITH {VISITS}, h AS (SELECT target, max(seen_at) AS last FROM visits GROUP BY 1) SELECT target, last, (SELECT count(*) > 100 FROM h) AS more FROM h ORDER BY last DESC, target LIMIT 50 OFFSET 50")
def history_second_page(spark, sf):
    h = visits(spark, sf).groupBy("target").agg(F.max("seen_at").alias("last"))
    return reports.page_with_more(h, [F.desc("last"), F.asc("target")], 2, 50)


@query("SELECT p_partkey FROM part WHERE contains(replace(replace(lower(p_name), '-', ' '), '_', ' '), '1') AND contains(replace(replace(lower(p_name), '-', ' '), '_', ' '), '2')")
def files_with_all_words(spark, sf):
    return table(spark, sf, "part").where(reports.has_all_words(text.name_fold(F.col("p_name")), ["1", "2"])).select("p_partkey")


@query("""WITH RECURSIVE c AS (SELECT conv_id || '-' || turn AS id, CASE WHEN turn = 0 OR turn % 5 = 4 THEN NULL ELSE conv_id || '-' || (turn - 1 - turn % 2) END AS parent, turn AS num FROM conversations),
k AS (SELECT c.id, CASE WHEN p.id IS NULL THEN NULL ELSE c.parent END AS parent, lpad(CAST(c.num AS VARCHAR), 12, '0') AS own FROM c LEFT JOIN c p ON p.id = c.parent),
t AS (SELECT id AS root, id, 0 AS depth, own AS "order" FROM k WHERE parent IS NULL UNION ALL SELECT t.root, k.id, t.depth + 1, t."order" || '/' || k.own FROM t JOIN k ON k.parent = t.id)
SELECT root, id, depth, "order" FROM t""")
def comment_tree(spark, sf):
    turn = F.col("turn")
    name = lambda t: F.concat_ws("-", F.col("conv_id"), t)
    c = table(spark, sf, "conversations").select(name(turn).alias("id"), F.when((turn != 0) & (turn % 5 != 4), name(turn - 1 - turn % 2)).alias("parent"), turn.alias("num"))
    return reports.comment_tree(c, spark)


@query("""SELECT p_partkey, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' WHEN 4 THEN 'four' WHEN 5 THEN 'five' WHEN 6 THEN 'six' WHEN 7 THEN 'seven' WHEN 8 THEN 'eight' WHEN 9 THEN 'nine' WHEN 10 THEN 'ten' WHEN 11 THEN 'eleven' WHEN 12 THEN 'twelve' WHEN 0 THEN 'no' ELSE CAST(p_size AS VARCHAR) END AS words,
 CASE WHEN p_size = 1 THEN 'one day' WHEN p_size = 0 THEN 'since today' WHEN p_size <= 12 THEN (['two','three','four','five','six','seven','eight','nine','ten','eleven','twelve'])[p_size - 1] || ' days' ELSE p_size || ' days' END AS untouched FROM part""")
def numbers_in_words(spark, sf):
    n = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", text.number_word(n).alias("words"), dates.untouched(n).alias("untouched"))


@query("""WITH e AS (SELECT event_id, epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)) AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || ' min ago' WHEN s < 172800 THEN CAST(floor(s / 3600) AS BIGINT) || ' h ago' ELSE CAST(floor(s / 86400) AS BIGINT) || ' days ago' END AS ago FROM e""")
def events_ago(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.ago(F.col("ts"), F.lit(NOW)).alias("ago"))


@query(r"""SELECT doc_id, octet_length(encode(regexp_replace(text, '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g'))) AS bytes FROM documents""")
def text_lengths(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.text_length(F.col("text")).alias("bytes"))


@query("""SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 1000 THEN text ELSE left(text, list_max(list_filter(range(0, 1001), lambda n: octet_length(encode(left(text, n))) <= 1000))) END AS text FROM documents""")
def capped_texts(spark, sf):
    """Texts within a limit of bytes."""
    return table(spark, sf, "documents").select("doc_id", text.capped(F.col("text"), 1000).alias("text"))


@query(r"""SELECT doc_id, regexp_extract(regexp_replace(regexp_replace(text, '^[^\p{L}''-]+', ''), '[^\p{L}''-]+$', ''), '^([^\s\x0B\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]*)', 1) AS word,
 regexp_full_match(regexp_extract(text, '^(\S*)', 1), '[a-z]{3,14}') AS plain FROM documents""")
def first_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.word_at(F.col("text")).alias("word"), text.is_plain_word(F.regexp_extract("text", r"^(\S*)", 1)).alias("plain"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'textfiles' WHEN event_id % 4 = 1 THEN 'fiction/reddit' WHEN event_id % 4 = 2 THEN 'weird/archived worlds' ELSE 'literature/' || event_type END AS source FROM events""")
def draw_sources(spark, sf):
    n = F.col("event_id")
    why = F.when(n % 4 == 0, F.concat(F.lit("textfiles/"), n, F.lit(" · x"))).when(n % 4 == 1, F.concat(F.lit("fiction/r/"), n)).when(n % 4 == 2, F.concat(F.lit("weird/archived worlds "), n)).otherwise(F.concat(F.lit("literature/"), "event_type", F.lit(" · a page")))
    return table(spark, sf, "events").select("event_id", urls.source_of(why).alias("source"))


_ADDRESS = """CASE c_custkey % 6 WHEN 0 THEN 'http://scp-wiki.wikidot.com/scp-' || (100 + c_custkey % 800) WHEN 1 THEN 'http://scp-wiki.wikidot.com/a-tale-' || c_custkey WHEN 2 THEN 'https://www.royalroad.com/fiction/' || c_custkey
 WHEN 3 THEN 'https://example.org/' || c_custkey WHEN 4 THEN 'https://www.reddit.com/r/nosleep/comments/' || c_custkey || '/part_one' ELSE 'http://wanderers-library.wikidot.com/' || c_custkey END"""


@query(f"""SELECT c_custkey, c_custkey % 6 IN (1, 2, 5) AS prose,
 CASE c_custkey % 6 WHEN 4 THEN CAST(c_custkey AS VARCHAR) WHEN 0 THEN '/scp-' || (100 + c_custkey % 800) WHEN 1 THEN '/a-tale-' || c_custkey WHEN 2 THEN '/fiction/' || c_custkey ELSE '/' || c_custkey END AS post FROM customer""")
def prose_addresses(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.expr(_ADDRESS).alias("url"))
    return c.select("c_custkey", urls.is_prose(F.col("url")).alias("prose"), urls.post_key(F.col("url")).alias("post"))


@query("SELECT p_partkey, CAST(coalesce(nullif(regexp_extract('Vol 3 ' || p_name || ' #' || (p_size / 2.0), '.*?(\\d+(?:\\.\\d+)?)\\D*$', 1), ''), '0') AS DOUBLE) AS number FROM part")
def issue_numbers(spark, sf):
    name = F.concat(F.lit("Vol 3 "), "p_name", F.lit(" #"), (F.col("p_size") / 2.0).cast("decimal(11,1)").cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.issue_number(name).alias("number"))


@query()
def found_among_read(spark, sf):
    """The best hits of a query among the pages read before a time, one page left out."""
    read = visits(spark, sf).groupBy("target").agg(F.max("seen_at").alias("last"))
    docs = texts(spark, sf)
    hits = search.search(docs, search.postings(docs), "the")
    return search.among_read(hits, read, "7", datetime(2024, 1, 30)).select("target", "title", "last")
