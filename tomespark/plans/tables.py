"""Queries over the small relational tables: orders, lookups, state from events."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomespark.functions import text as fn
from tomespark.operators import bags, chains, feeds, history, ordering, packets, state
from tomespark.plans.inputs import ITEMS, VISITS, dealt, items, table, visits

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


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 300")
def articles_before(spark, sf):
    return ordering.keyset_page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5000, 300)


@query("SELECT p_partkey, 'Part ' || p_partkey AS name, 'part ' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS key FROM part")
def natural_keys(spark, sf):
    name = F.concat(F.lit("Part "), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", name.alias("name"), fn.natural_key(name).alias("key"))


@query("""WITH n AS (SELECT p_partkey, p_brand AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)
SELECT p_partkey, CASE WHEN k = 1 THEN name ELSE name || '-' || k END AS unique_name FROM n""")
def unique_brands(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("name"))
    return ordering.unique_names(rows, "name", "p_partkey").select("p_partkey", "unique_name")


@query("""SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, c_custkey) AS r FROM customer) WHERE r = 1""")
def preferred_customers(spark, sf):
    rank = ordering.by_preference(["MACHINERY", "BUILDING"], F.col("c_mktsegment"))
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", (rank * F.lit(1 << 40) + F.col("c_custkey")).alias("at"))
    return ordering.first_of_each(rows, ["c_nationkey"], "at").select("c_nationkey", "c_custkey")


@query("""WITH e AS (SELECT user_id % 500 AS u, CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'done' WHEN 'purchase' THEN 'move' WHEN 'error' THEN 'remove' END AS action, props, event_id % 7 AS section, event_id AS pos FROM events WHERE event_type <> 'signup'),
s AS (SELECT u AS url, arg_max(props, pos) FILTER (WHERE action = 'add') AS title, arg_max(section, pos) FILTER (WHERE action IN ('add', 'move')) AS section,
 max(pos) FILTER (WHERE action = 'add') AS a, max(pos) FILTER (WHERE action = 'done') AS d, max(pos) FILTER (WHERE action = 'remove') AS g FROM e GROUP BY u)
SELECT url, title, section, coalesce(d > a, false) AS done FROM s WHERE a IS NOT NULL AND (g IS NULL OR g < a)""")
def reading_queue(spark, sf):
    e = table(spark, sf, "events").where("event_type <> 'signup'")
    action = F.when(F.col("event_type") == "view", "add").when(F.col("event_type") == "click", "done").when(F.col("event_type") == "purchase", "move").when(F.col("event_type") == "error", "remove")
    return state.folded_queue(e.select((F.col("user_id") % 500).alias("url"), action.alias("action"), F.col("props").alias("title"), (F.col("event_id") % 7).alias("section"), F.col("event_id").alias("pos")))


@query(f"WITH {VISITS} SELECT target, kind, pos FROM visits QUALIFY row_number() OVER (PARTITION BY kind ORDER BY pos DESC) <= 300")
def last_shown(spark, sf):
    return state.last_shown(visits(spark, sf), "kind").select("target", "kind", "pos")


@query(f"WITH {VISITS} SELECT DISTINCT target FROM visits WHERE target NOT IN (SELECT target FROM visits WHERE seen_at >= TIMESTAMP '2024-01-29 00:00:00')")
def not_shown_lately(spark, sf):
    v = visits(spark, sf)
    return state.not_shown(v.select("target").distinct(), v, datetime(2024, 1, 29))


@query("""WITH r AS (SELECT p_partkey AS pos, p_brand || p_size AS key, p_name AS title, p_type AS extra FROM part),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) = 1)
SELECT pos, key FROM a QUALIFY row_number() OVER (PARTITION BY lower(title), lower(extra) ORDER BY pos) = 1""")
def merged_results(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.concat("p_brand", "p_size").alias("key"), F.col("p_name").alias("title"), F.col("p_type").alias("extra"))
    return state.merged_results(rows).select("pos", "key")


@query("SELECT DISTINCT p_name AS word FROM part WHERE lower(p_name) LIKE 'b%' ORDER BY lower(p_name), p_name LIMIT 20")
def suggestions(spark, sf):
    return state.suggestions(table(spark, sf, "part").select(F.col("p_name").alias("word")).distinct(), "B", 20)


@query("""SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%a%' AND lower(p_brand) LIKE '%1%' AND p_size = 7""")
def field_search(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"), F.col("p_size").alias("year"))
    conditions, _ = state.field_query("title:A publisher:1 year:7 tales")
    return p.where(state.and_all(conditions)).select("p_partkey")


@query(f"""WITH {ITEMS}, {VISITS}, facts AS (
 SELECT 'absent' AS fact, CAST(floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(seen_at)))) / 86400) AS BIGINT) AS n FROM visits
 UNION ALL SELECT 'unread', count(*) FILTER (WHERE NOT read) FROM items
 UNION ALL SELECT 'queue', count(*) FROM customer WHERE c_acctbal > 0
 UNION ALL SELECT 'habit', count(DISTINCT CAST(seen_at AS DATE)) FROM visits WHERE seen_at >= TIMESTAMP '2024-01-24 00:00:00'),
f AS (SELECT * FROM facts WHERE n >= CASE fact WHEN 'absent' THEN 3 WHEN 'unread' THEN 15 WHEN 'queue' THEN 3 ELSE 5 END)
SELECT fact, n FROM f WHERE fact = 'absent' OR NOT EXISTS (SELECT 1 FROM f WHERE fact = 'absent')""")
def desk_facts(spark, sf):
    v = visits(spark, sf)
    queue = table(spark, sf, "customer").select((F.col("c_acctbal") <= 0).alias("done"))
    return state.desk_facts(history.history(v), feeds.counts(items(spark, sf)), queue, history.reading_days(v, NOW), NOW)


@query("""SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name || ' OF THE ' || r_name), ' '), lambda w: CASE WHEN w IN ('of', 'the') THEN w ELSE upper(left(w, 1)) || substr(w, 2) END), ' ') AS title
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def titles_in_case(spark, sf):
    both = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", fn.title_case(F.concat("n_name", F.lit(" OF THE "), "r_name")).alias("title"))


@query(SQL["titles_in_case"])
def every_title_in_case(spark, sf):
    both = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", fn.title_case(F.concat("n_name", F.lit(" OF THE "), "r_name")).alias("title"))


_NEXT = """n AS (SELECT event_id AS id, user_id, row_number() OVER w AS place, min(event_id) OVER (PARTITION BY user_id) AS head, max(event_id) OVER (PARTITION BY user_id) AS tail,
 count(*) OVER (PARTITION BY user_id) AS pages FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


def _next_links(spark, sf):
    """Events as pages: each leads to the next of its user, and the last of every fifth user to the first."""
    own = Window.partitionBy("user_id")
    order = own.orderBy("event_id")
    following = F.coalesce(F.lead("event_id").over(order), F.when(F.col("user_id") % 5 == 0, F.min("event_id").over(own)))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), following.alias("next"))


@query(f"WITH {_NEXT} SELECT id, head, place, user_id % 5 = 0 AND pages > 1 AS cycle FROM n")
def next_chains(spark, sf):
    return chains.chained(_next_links(spark, sf))


@query(f"WITH {_NEXT} SELECT head, user_id % 5 = 0 AND pages > 1 AS cycle, pages, tail AS \"last\" FROM n WHERE id = head")
def chain_sizes(spark, sf):
    return chains.chain_sizes(chains.chained(_next_links(spark, sf)))


@query("WITH n AS (SELECT event_id AS id, row_number() OVER (ORDER BY event_id) AS place, min(event_id) OVER () AS head FROM events) SELECT id, head, place, false AS cycle FROM n")
def one_long_chain(spark, sf):
    """All events are one chain, by the numbers that follow each other."""
    return chains.chained(table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("event_id") + 1).alias("next")))


_WEIGHTS = {"fiction": 3, "knowledge": 2, "print": 2, "plates": 2, "literature": 1, "folklore": 1}


@query(f"""WITH w(family, weight) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in _WEIGHTS.items())})
SELECT c_custkey AS user, family, 2 * weight AS n FROM customer, w""")
def bag_counts(spark, sf):
    """Two whole bags of every user hold each family twice as often as it weighs."""
    users = bags.new_users(dealt(table(spark, sf, "customer").select(F.col("c_custkey").alias("user"))))
    return bags.counts(bags.draw(users, _WEIGHTS, 2 * sum(_WEIGHTS.values()), seed=7))


@query(f"SELECT c_custkey AS user, 0 AS alike, {len(_WEIGHTS)} AS in_first_round, 3 AS bags FROM customer")
def bag_neighbours(spark, sf):
    """Drawn one after the other with the state kept between: no family follows itself, and each comes before any comes again in its round."""
    state_of = bags.new_users(dealt(table(spark, sf, "customer").select(F.col("c_custkey").alias("user"))))
    first = bags.draw(state_of, _WEIGHTS, 14, seed=7)
    second = bags.draw(first.withColumnRenamed("drawn", "before"), _WEIGHTS, 14, seed=7)
    both = second.select("user", F.concat("before", "drawn").alias("d"), "bags")
    alike = F.size(F.filter(F.zip_with(F.slice("d", 1, 27), F.slice("d", 2, 27), lambda a, b: a == b), lambda x: x))
    return both.select("user", alike.alias("alike"), F.size(F.array_distinct(F.slice("d", 1, 11))).alias("in_first_round"), "bags")


_KINDS = ["story", "poem", "letter", "plate", "word", "puzzle"]


@query("SELECT c_custkey AS user, 4 AS kinds, 0 AS left_out, 2 AS bags FROM customer")
def sections_drawn(spark, sf):
    """Four sections of every user twice: all different, none of the two left out."""
    none = bags.new_users(table(spark, sf, "customer").select(F.col("c_custkey").alias("user")))
    first = bags.sections(none, _KINDS, 4, ["word", "plate"], seed=7)
    second = bags.sections(first.select("user", "bag", "bags"), _KINDS, 4, ["word", "plate"], seed=7)
    return second.select("user", F.size(F.array_distinct("drawn")).alias("kinds"), F.size(F.filter("drawn", lambda k: k.isin("word", "plate"))).alias("left_out"), "bags")


_DAY = date(1996, 6, 30)
_PAPERS = """items AS (SELECT l_suppkey AS u, l_partkey AS target, p_brand AS feed, p_type AS shelf, max(l_shipdate) AS published, max(p_name) AS title FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4),
shown AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS target, p_brand AS feed, p_type AS shelf, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
lately AS (SELECT * FROM shown WHERE d > DATE '1996-05-31' AND d <= DATE '1996-06-30')"""


def _papers(spark, sf):
    """Lines of orders as the unread items of suppliers, and those that came back as what they were shown."""
    both = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    key = [F.col("l_suppkey").alias("user"), F.col("l_partkey").alias("target"), F.col("p_brand").alias("feed"), F.col("p_type").alias("shelf")]
    items = both.groupBy(*key).agg(F.max("l_shipdate").alias("published"), F.max("p_name").alias("title"))
    return items, both.where("l_returnflag = 'R'").select(*key, F.to_date("l_shipdate").alias("at")).distinct()


@query(f"""WITH {_PAPERS}, fresh AS (SELECT * FROM items WHERE title <> '' AND NOT EXISTS (SELECT 1 FROM lately l WHERE l.u = items.u AND l.target = items.target)),
newest AS (SELECT *, row_number() OVER (PARTITION BY u, feed ORDER BY published DESC, target) AS nth, count(*) OVER (PARTITION BY u, feed) AS many FROM fresh),
one AS (SELECT * FROM newest WHERE nth = CAST('0x' || left(md5('7|' || u || '|' || feed), 8) AS BIGINT) % least(many, 3) + 1),
aged AS (SELECT o.*, (SELECT max(d) FROM lately l WHERE l.u = o.u AND l.feed = o.feed) AS feed_last, (SELECT max(d) FROM lately l WHERE l.u = o.u AND l.shelf = o.shelf) AS shelf_last FROM one o),
ranked AS (SELECT *, row_number() OVER (PARTITION BY u, shelf ORDER BY feed_last NULLS FIRST, md5('7|' || u || '|' || feed), feed) AS round,
 dense_rank() OVER (PARTITION BY u ORDER BY shelf_last NULLS FIRST, md5('7|' || u || '|' || shelf), shelf) AS s FROM aged),
placed AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round, s) AS place FROM ranked WHERE round <= 2)
SELECT u AS "user", CAST(place AS INTEGER) AS place, target, feed, shelf FROM placed WHERE place <= 3""")
def daily_periodicals(spark, sf):
    """Three items for every user, of different shelves where there are such, and none shown in the last 30 days."""
    return packets.periodicals(*_papers(spark, sf), _DAY, seed=7)
