"""Queries over visits and feed items."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomespark.operators import feeds, history, intervals, sampling
from tomespark.plans.inputs import ITEMS, VISITS, items, table, visits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = datetime(2024, 1, 31)
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {ITEMS} SELECT item_id, feed_id, guid, title, published, '' AS content FROM items
WHERE feed_id IN ('view', 'click') AND NOT read ORDER BY published DESC, item_id DESC LIMIT 100""")
def item_page(spark, sf):
    return feeds.item_page(items(spark, sf), ["view", "click"], unread=True)


@query(f"WITH {ITEMS} SELECT item_id, feed_id, guid, title, published, '' AS content FROM items WHERE starred ORDER BY published DESC, item_id DESC LIMIT 30 OFFSET 30")
def starred_second_page(spark, sf):
    return feeds.item_page(items(spark, sf), starred=True, limit=30, offset=30)


@query(f"WITH {ITEMS} SELECT * FROM items WHERE item_id = 77")
def item_by_id(spark, sf):
    return items(spark, sf).where("item_id = 77").limit(1)


@query(f"WITH {ITEMS} SELECT feed_id, count(*) FILTER (WHERE NOT read) AS unread, count(*) AS total FROM items GROUP BY feed_id")
def feed_counts(spark, sf):
    return feeds.counts(items(spark, sf))


@query(f"WITH {ITEMS} SELECT count(*) FILTER (WHERE starred) AS starred FROM items")
def starred_count(spark, sf):
    return items(spark, sf).agg(F.count_if("starred").alias("starred"))


_SHELVES = [("click", "busy"), ("view", "busy"), ("purchase", ""), ("error", "dull")]


@query(f"""WITH {ITEMS}, shelves(feed_id, shelf) AS (VALUES ('click','busy'),('view','busy'),('purchase',''),('error','dull'))
SELECT coalesce(nullif(shelf, ''), i.feed_id) AS shelf, count(*) FILTER (WHERE NOT read) AS unread, count(*) AS total, count(DISTINCT i.feed_id) AS feeds
FROM items i LEFT JOIN shelves USING (feed_id) GROUP BY 1""")
def shelf_totals(spark, sf):
    return feeds.shelf_totals(items(spark, sf), spark.createDataFrame(_SHELVES, "feed_id string, shelf string"))


@query(f"WITH {ITEMS} SELECT item_id, feed_id, published FROM items QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY published DESC, item_id DESC) <= 200")
def newest_of_feeds(spark, sf):
    return feeds.newest(items(spark, sf), 200).select("item_id", "feed_id", "published")


@query(f"""WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY published DESC, item_id DESC) AS rank FROM items)
SELECT item_id FROM r WHERE rank <= 200 OR starred OR NOT (read OR added < TIMESTAMP '2024-01-10 00:00:00')""")
def pruned_items(spark, sf):
    return feeds.pruned(items(spark, sf), 200, datetime(2024, 1, 10)).select("item_id")


@query(f"""WITH {ITEMS}, old AS (SELECT * FROM items WHERE item_id % 2 = 0),
batch AS (SELECT item_id, feed_id, guid, 'new ' || title AS title, published, CASE WHEN item_id % 4 = 0 THEN content || ' and more' ELSE 'x' END AS content FROM items WHERE item_id % 3 = 0 OR item_id % 2 <> 0)
SELECT coalesce(o.feed_id, n.feed_id) AS feed_id, coalesce(o.guid, n.guid) AS guid, coalesce(n.title, o.title) AS title,
 CASE WHEN o.item_id IS NULL OR length(n.content) > length(o.content) THEN n.content ELSE o.content END AS content,
 coalesce(o.read, false) AS read, coalesce(o.starred, false) AS starred, o.item_id IS NULL AS new
FROM old o FULL JOIN batch n ON o.feed_id = n.feed_id AND o.guid = n.guid""")
def item_upsert(spark, sf):
    every = items(spark, sf)
    content = F.when(F.col("item_id") % 4 == 0, F.concat("content", F.lit(" and more"))).otherwise("x")
    batch = every.where("item_id % 3 = 0 OR item_id % 2 <> 0").select("item_id", "feed_id", "guid", F.concat(F.lit("new "), "title").alias("title"), "published", content.alias("content"), F.col("item_id").alias("seq"))
    return feeds.upsert(every.where("item_id % 2 = 0"), batch).drop("item_id", "published")


@query(SQL["item_upsert"])
def every_item_upsert(spark, sf):
    """As item_upsert: every item is in one side at least, the odd ones in the batch."""
    every = items(spark, sf)
    content = F.when(F.col("item_id") % 4 == 0, F.concat("content", F.lit(" and more"))).otherwise("x")
    batch = every.where("item_id % 3 = 0 OR item_id % 2 <> 0").select("item_id", "feed_id", "guid", F.concat(F.lit("new "), "title").alias("title"), "published", content.alias("content"), F.col("item_id").alias("seq"))
    return feeds.upsert(every.where("item_id % 2 = 0"), batch).drop("item_id", "published")


@query(f"WITH {ITEMS} SELECT item_id, feed_id FROM items WHERE NOT (item_id % 2 = 0)")
def items_to_index(spark, sf):
    every = items(spark, sf)
    docs = every.where("item_id % 2 = 0").select(F.concat(F.lit("item/"), "item_id").alias("target"))
    return feeds.not_indexed(every, docs).select("item_id", "feed_id")


@query("SELECT c_name AS path, (c_custkey % 3 <> 0) AS missing FROM customer")
def missing_books(spark, sf):
    books = table(spark, sf, "customer").select(F.col("c_name").alias("path"), F.lit(False).alias("missing"), "c_custkey")
    return feeds.mark_missing(books.drop("c_custkey"), books.where("c_custkey % 3 = 0"))


@query("""WITH entries AS (
 SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS shelf, false AS disabled, 0 AS own FROM nation
 UNION ALL SELECT CAST(n_nationkey * 2 AS VARCHAR), 'own ' || n_name, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'mine' END, n_nationkey % 5 = 0, 1 FROM nation
), w AS (SELECT id, name, disabled, own, coalesce(nullif(shelf, ''), lead(shelf) OVER (PARTITION BY id ORDER BY own DESC), '') AS shelf, row_number() OVER (PARTITION BY id ORDER BY own DESC) AS r FROM entries)
SELECT id, name, shelf FROM w WHERE r = 1 AND NOT disabled""")
def catalog_overlay(spark, sf):
    n = table(spark, sf, "nation")
    base = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("shelf"), F.lit(False).alias("disabled"))
    user = n.select((F.col("n_nationkey") * 2).cast("string").alias("id"), F.concat(F.lit("own "), "n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("mine").alias("shelf"), (F.col("n_nationkey") % 5 == 0).alias("disabled"))
    return feeds.overlay(base, user).select("id", "name", "shelf")


@query("""SELECT coalesce(sum(greatest(0, coalesce(n, 0) - seen)), 0) AS new_chapters
FROM (SELECT c_custkey AS serial_id, c_custkey % 7 AS seen FROM customer WHERE c_custkey % 2 = 0) s
LEFT JOIN (SELECT o_custkey AS serial_id, count(*) AS n FROM orders GROUP BY 1) USING (serial_id)""")
def new_chapter_total(spark, sf):
    serials = table(spark, sf, "customer").select(F.col("c_custkey").alias("serial_id"), (F.col("c_custkey") % 2 == 0).alias("followed"), (F.col("c_custkey") % 7).alias("seen"))
    return feeds.new_chapters(serials, table(spark, sf, "orders").select(F.col("o_custkey").alias("serial_id")))


@query("""WITH o AS (SELECT o_custkey AS serial_id, CAST(o_orderkey AS VARCHAR) AS url, o_orderpriority AS title, o_orderkey AS place FROM orders),
known AS (SELECT serial_id, url, title, row_number() OVER (PARTITION BY serial_id ORDER BY place) AS n FROM o WHERE place % 3 <> 0),
listed AS (SELECT serial_id, url, CASE WHEN place % 2 = 0 THEN '' ELSE 'new ' || title END AS title, place FROM o WHERE place % 4 <> 1 OR place % 3 = 0),
top AS (SELECT serial_id, max(n) AS top FROM known GROUP BY 1),
j AS (SELECT coalesce(k.serial_id, l.serial_id) AS serial_id, coalesce(k.url, l.url) AS url, k.n, k.title AS kt, l.title AS lt, l.place FROM known k FULL JOIN listed l ON k.serial_id = l.serial_id AND k.url = l.url)
SELECT serial_id, url, coalesce(j.n, coalesce(top, 0) + row_number() OVER (PARTITION BY serial_id, j.n IS NULL ORDER BY place)) AS n, coalesce(nullif(lt, ''), kt, '') AS title
FROM j LEFT JOIN top USING (serial_id)""")
def chapter_merge(spark, sf):
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("serial_id"), F.col("o_orderkey").cast("string").alias("url"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("place"))
    known = o.where("place % 3 <> 0").withColumn("n", F.row_number().over(Window.partitionBy("serial_id").orderBy("place"))).drop("place")
    listed = o.where("place % 4 <> 1 OR place % 3 = 0").withColumn("title", F.when(F.col("place") % 2 == 0, "").otherwise(F.concat(F.lit("new "), "title")))
    return feeds.merge_chapters(known, listed)


@query(SQL["chapter_merge"])
def every_chapter_merge(spark, sf):
    """As chapter_merge: every chapter is in one side at least, the unknown ones are all listed."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("serial_id"), F.col("o_orderkey").cast("string").alias("url"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("place"))
    known = o.where("place % 3 <> 0").withColumn("n", F.row_number().over(Window.partitionBy("serial_id").orderBy("place"))).drop("place")
    listed = o.where("place % 4 <> 1 OR place % 3 = 0").withColumn("title", F.when(F.col("place") % 2 == 0, "").otherwise(F.concat(F.lit("new "), "title")))
    return feeds.merge_chapters(known, listed)


@query(f"WITH {VISITS} SELECT target, kind, title, seen_at, pos FROM visits WHERE seen_at >= {_NOW} - INTERVAL 3 DAY")
def visits_since(spark, sf):
    return history.visits_since(visits(spark, sf), datetime(2024, 1, 28))


@query(f"""WITH {VISITS} SELECT target, min(seen_at) AS "first", max(seen_at) AS "last", count(*) AS opens, arg_max(title, pos_at) AS title, arg_max(kind, pos_at) AS kind
FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY seen_at, pos) AS pos_at FROM visits) GROUP BY target""")
def visit_history(spark, sf):
    return history.history(visits(spark, sf))


@query(f"""WITH {VISITS} SELECT kind,
 count(*) FILTER (WHERE w) AS opens_7, count(DISTINCT target) FILTER (WHERE w) AS pages_7, count(DISTINCT d) FILTER (WHERE w) AS days_7,
 count(*) FILTER (WHERE m) AS opens_30, count(DISTINCT target) FILTER (WHERE m) AS pages_30, count(DISTINCT d) FILTER (WHERE m) AS days_30,
 count(*) AS opens_all, count(DISTINCT target) AS pages_all, count(DISTINCT d) AS days_all
FROM (SELECT *, seen_at >= {_NOW} - INTERVAL 7 DAY AS w, seen_at >= {_NOW} - INTERVAL 30 DAY AS m, CAST(seen_at AS DATE) AS d FROM visits) GROUP BY GROUPING SETS ((), (kind))""")
def ledger(spark, sf):
    return history.ledger(visits(spark, sf), NOW)


@query(f"WITH {VISITS} SELECT target, count(*) AS opens, max(seen_at) AS \"last\" FROM visits GROUP BY target HAVING count(*) >= 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 5")
def most_returned(spark, sf):
    return history.most_returned(visits(spark, sf))


@query(f"WITH {VISITS} SELECT count(DISTINCT CAST(seen_at AS DATE)) AS days FROM visits WHERE seen_at >= {_NOW} - INTERVAL 7 DAY")
def reading_days(spark, sf):
    return history.reading_days(visits(spark, sf), NOW)


@query(f"""WITH {VISITS}, h AS (SELECT target, max(seen_at) AS "last", (CAST(target AS BIGINT) % 100) / 100.0 AS pos FROM visits GROUP BY target),
aside AS (SELECT target, max(seen_at) AS put FROM visits WHERE kind = 'purchase' GROUP BY target)
SELECT h.target, "last" FROM h LEFT JOIN aside USING (target) WHERE h.pos > 0.05 AND h.pos < 0.95 AND (put IS NULL OR put < "last")""")
def unfinished(spark, sf):
    hist = visits(spark, sf).groupBy("target").agg(F.max("seen_at").alias("last")).withColumns({"pos": (F.col("target").cast("long") % 100) / 100, "kind": F.lit("web")})
    return history.unfinished(hist, visits(spark, sf).where("kind = 'purchase'")).select("target", "last")


@query(f"""WITH v AS (SELECT 'u/' || user_id % 20 || '/' || user_id AS target, event_id AS pos, event_type = 'error' AS forget, event_type = 'error' AND event_id % 2 = 0 AS under, user_id FROM events),
f AS (SELECT CASE WHEN under THEN 'u/' || user_id % 20 ELSE target END AS target, pos, forget, under FROM v)
SELECT target, pos FROM f WHERE NOT forget AND NOT EXISTS (SELECT 1 FROM f t WHERE t.forget AND t.pos > f.pos AND (t.target = f.target OR (t.under AND starts_with(f.target, t.target || '/'))))""")
def visits_after_forgetting(spark, sf):
    e = table(spark, sf, "events")
    forget = F.col("event_type") == "error"
    under = forget & (F.col("event_id") % 2 == 0)
    branch = F.concat(F.lit("u/"), F.col("user_id") % 20)
    log = e.select(F.when(under, branch).otherwise(F.concat_ws("/", branch, "user_id")).alias("target"), F.col("event_id").alias("pos"), forget.alias("forget"), under.alias("under"))
    return history.without_forgotten(log).select("target", "pos")


@query(f"""WITH {VISITS}, g AS (SELECT *, CASE WHEN seen_at > lag(seen_at) OVER w + INTERVAL 6 HOUR OR lag(seen_at) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM visits WINDOW w AS (PARTITION BY target ORDER BY seen_at, pos)),
s AS (SELECT *, sum(new) OVER (PARTITION BY target ORDER BY seen_at, pos) AS session FROM g)
SELECT target, session, min(seen_at) AS "begin", max(seen_at) AS "end", count(*) AS opens FROM s GROUP BY target, session""")
def visit_sessions(spark, sf):
    return history.sessions(visits(spark, sf), 360)


@query("""WITH r AS (SELECT user_id AS k, event_id // 7 AS lo, event_id // 7 + event_id % 5 AS hi FROM events),
m AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT k, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY k, island""")
def merged_ranges(spark, sf):
    e = table(spark, sf, "events")
    lo = F.floor(F.col("event_id") / 7)
    return intervals.merged(e.select(F.col("user_id").alias("k"), lo.alias("lo"), (lo + F.col("event_id") % 5).alias("hi")), "k")


@query("""SELECT event_id, event_id % 50 + 1 AS lo, greatest(0, least(40, 61 - greatest(0, least(30, event_id % 50 + 61) - (event_id % 50 + 1) + 1) - CASE WHEN 35 BETWEEN event_id % 50 + 1 AND event_id % 50 + 61 THEN 1 ELSE 0 END)) AS unread,
 (event_id % 50 + 1 <= 30 OR event_id % 50 + 1 = 35) AS has_first FROM events""")
def newsgroup_unread(spark, sf):
    lo = (F.col("event_id") % 50 + 1).cast("long")
    ranges = intervals.parse(F.lit("1-30, 35"))
    out = intervals.unread(ranges, lo, lo + 60, F.lit(40).cast("long"))
    return table(spark, sf, "events").select("event_id", lo.alias("lo"), out.alias("unread"), intervals.has(ranges, lo).alias("has_first"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size * 1000 AS size, sum(p_size * 1000) OVER (ORDER BY p_retailprice, p_partkey) - p_size * 1000 AS before, sum(p_size * 1000) OVER () AS total FROM part)
SELECT k FROM p WHERE NOT (total - before > 0.9 * 20000000)""")
def cache_after_trim(spark, sf):
    from tomespark.operators.ordering import trimmed

    cache = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 1000).cast("long").alias("size"), F.col("p_retailprice").alias("read"))
    return trimmed(cache, 20_000_000).select("k")


@query("""SELECT event_type AS feed_id, event_type || ' per ' || strftime(min(ts), '%Y-%m-%d') AS title FROM events GROUP BY event_type""")
def feed_first_days(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("feed_id")).agg(F.min("ts").alias("t")).select("feed_id", F.concat("feed_id", F.lit(" per "), F.date_format("t", "yyyy-MM-dd")).alias("title"))


@query("""SELECT event_id, ts, year(ts) * 400 + dayofyear(ts) AS day_number, date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) % 2 AS side,
 CASE date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE 'on ' || day(ts) || ' ' || strftime(ts, '%B') END AS said,
 CAST(floor(date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-31 00:00:00') / 86400.0) AS BIGINT) AS whole_days FROM events""")
def day_numbers(spark, sf):
    from tomespark.functions import dates

    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", "ts", dates.day_number(ts).alias("day_number"), dates.side(ts).alias("side"), dates.when(ts, NOW).alias("said"), dates.whole_days(ts, NOW).alias("whole_days"))


@query()
def weighted_draw(spark, sf):
    return sampling.weighted_order(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey", "p_size", 7).select("p_partkey", "p_size", "draw")


@query()
def one_of_each_kind(spark, sf):
    return sampling.one_per_kind(items(spark, sf).select("item_id", "feed_id"), "feed_id", "item_id", 7, 2)


@query()
def dice_throws(spark, sf):
    key = F.col("event_id")
    lines = sampling.hexagram_lines(7, key)
    roll = sampling.rolled("d100", 5, key)
    return table(spark, sf, "events").select("event_id", sampling.rolled("4d6kh3+2", 7, key).alias("total"), roll.alias("roll"), sampling.oracle(roll, 65).alias("answer"), lines.alias("lines"), sampling.changed_lines(lines).alias("changed"))
