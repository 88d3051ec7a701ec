"""Queries over web pages: addresses, blocks, links, verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomespark.functions import urls
from tomespark.operators import layouts, quality, state
from tomespark.plans.inputs import table
from tomespark.plans.texts import stored_vocabulary
from tomespark.sources import files, shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("target"), "url", "html")


@query(r"""WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)
SELECT page_id, h AS host, p AS path, 'web' AS kind,
 'WEB·' || substr(upper(regexp_replace(split_part(h, '.', 1), '[^A-Za-z0-9]', '', 'g')), 1, 8) || '·' || substr(CASE WHEN trim(p, '/') = '' THEN 'home' ELSE string_split(trim(p, '/'), '/')[-1] END, 1, 24) AS number FROM p""")
def page_numbers(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.page_kind(u).alias("kind"), urls.call_number(u).alias("number"))


@query(r"""SELECT page_id, n - 1 AS n, hrefs[n] AS href FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS hrefs FROM pages) p, unnest(range(1, len(hrefs) + 1)) AS u(n)""")
def page_links(spark, sf):
    return files.page_links(_pages(spark, sf)).select(F.col("target").cast("long").alias("page_id"), "n", "href")


@query("""SELECT row_number() OVER (PARTITION BY k ORDER BY page_id) AS nth, page_id FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS k FROM pages) QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_id) = 1""")
def first_of_addresses(spark, sf):
    from tomespark.operators.ordering import first_of_each

    keyed = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("k"))
    return first_of_each(keyed, ["k"], "page_id").select(F.lit(1).cast("long").alias("nth"), "page_id")


@query()
def page_blocks(spark, sf):
    return files.page_blocks(_pages(spark, sf)).drop("set_lines", "set_words")


@query()
def page_verdicts(spark, sf):
    pages = _pages(spark, sf)
    blocks = files.page_blocks(pages)
    measured = quality.with_clean(quality.measures(blocks), blocks, stored_vocabulary(spark, sf))
    # A page without a block has no words. Addresses name no shelf of SHELF_BARS, so pages are judged as those of a shelf of one's own.
    rows = files.page_titles(pages).join(measured, "target", "left").fillna(0, [c for c in measured.columns if c not in ("target", "first", "last", "clean")])
    found = quality.verdicts(rows, F.coalesce(urls.page_kind(F.col("url")), F.lit("")), F.col("title"), F.col("url"), F.col("title"))
    return found.select("target", "words", F.round("link_share", 6).alias("link_share"), F.array_join("reasons", ", ").alias("reasons"))


@query()
def thin_pages(spark, sf):
    measured = quality.measures(files.page_blocks(_pages(spark, sf)))
    return measured.where(F.col("prose") - F.col("link_words") < 80).select("target", "prose")


@query()
def pages_as_markdown(spark, sf):
    return files.as_markdown(files.page_blocks(_pages(spark, sf)))


@query("""WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS h, length(url) AS n FROM pages)
SELECT h AS host, arg_max(page_id, n * 1000000 - page_id) AS page_id FROM l GROUP BY h""")
def longest_of_hosts(spark, sf):
    u = F.col("url")
    host = F.regexp_extract(u, r"^[a-z]+://([^/?#:]*)", 1)
    links = table(spark, sf, "pages").select(host.alias("host"), u.alias("text"), F.lit(False).alias("in_heading"), F.col("page_id").alias("n"), F.col("page_id").alias("href"))
    return state.best_links(links, "host").select("host", F.col("href").alias("page_id"))


@query("""WITH RECURSIVE l AS (SELECT page_id AS t, page_id * 2 + 1 AS h FROM pages UNION ALL SELECT page_id, page_id * 2 + 2 FROM pages),
w AS (SELECT 0::BIGINT AS t, 0 AS depth UNION SELECT l.h, w.depth + 1 FROM w JOIN l ON l.t = w.t WHERE w.depth < 4)
SELECT CAST(t AS VARCHAR) AS target, min(depth) AS depth FROM w GROUP BY t""")
def pages_within_four_links(spark, sf):
    p = table(spark, sf, "pages").select("page_id")
    name = lambda c: c.cast("string")
    links = p.select(name(F.col("page_id")).alias("target"), F.explode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2)).alias("h")).select("target", name(F.col("h")).alias("href"))
    return state.walked(links, spark.range(1).select(name(F.col("id")).alias("target")), 4)


def _page_lists(spark, sf):
    pages = _pages(spark, sf).withColumn("host", F.coalesce(urls.host(F.col("url")), F.lit("")))
    return pages, shared.written(layouts.scored(layouts.lists(pages).withColumn("host", F.coalesce("host", F.lit("")))), "lists")


@query()
def learned_layouts(spark, sf):
    """The result list of each host, by the lists of all its pages."""
    return layouts.learned(_page_lists(spark, sf)[1])


@query()
def listed_results(spark, sf):
    """What the layouts of their hosts, or their own, find on all pages."""
    pages, fit = _page_lists(spark, sf)
    return layouts.results(pages, layouts.learned(fit), layouts.own_layouts(fit))
