"""Feed items: listing, counting, incremental upkeep.

An item has item_id, feed_id, guid, title, published, content, added, read and
starred. Missing text is the empty string, never null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def item_page(items: DataFrame, feeds: list[str] | None = None, unread: bool = False, starred: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the newest items; their content is not read."""
    found = items
    if feeds is not None:
        found = found.where(F.col("feed_id").isin(feeds))
    if unread:
        found = found.where("NOT read")
    if starred:
        found = found.where("starred")
    found = found.select("item_id", "feed_id", "guid", "title", "published", F.lit("").alias("content"))
    return found.orderBy(F.desc("published"), F.desc("item_id")).offset(offset).limit(limit)


def counts(items: DataFrame) -> DataFrame:
    return items.groupBy("feed_id").agg(F.count_if(~F.col("read")).alias("unread"), F.count("*").alias("total"))


def shelf_totals(items: DataFrame, shelves: DataFrame) -> DataFrame:
    """Unread, total and feeds per shelf; a feed without a shelf is a shelf of its own."""
    counted = counts(items)  # as many rows as feeds, so the join moves little
    shelf = F.coalesce(F.nullif(F.col("shelf"), F.lit("")), F.col("feed_id"))
    return counted.join(shelves, "feed_id", "left").groupBy(shelf.alias("shelf")).agg(F.sum("unread").alias("unread"), F.sum("total").alias("total"), F.count("*").alias("feeds"))


def newest(items: DataFrame, k: int) -> DataFrame:
    """The newest k of each feed. Spark drops later ranks before the shuffle, so a large feed sends k rows a task."""
    order = Window.partitionBy("feed_id").orderBy(F.desc("published"), F.desc("item_id"))
    return items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def latest(batch: DataFrame) -> DataFrame:
    """One item of each feed and guid: that published last, of equal ones that with the largest item_id."""
    order = Window.partitionBy("feed_id", "guid").orderBy(F.desc("published"), F.desc("item_id"))
    return batch.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def pruned(items: DataFrame, k: int, month_ago) -> DataFrame:
    """Items that stay: the newest k of each feed, starred ones, and unread ones added within the month."""
    keep = newest(items.select("item_id", "feed_id", "published"), k).select("item_id")
    others = items.join(keep, "item_id", "left_anti").where(F.col("starred") | ~(F.col("read") | (F.col("added") < F.lit(month_ago))))
    return items.join(keep, "item_id", "left_semi").unionByName(others)


def upsert(items: DataFrame, batch: DataFrame) -> DataFrame:
    """New items are added; known ones take title and, when it is longer, content. Read and starred stay."""
    latest = batch.withColumn("_r", F.row_number().over(Window.partitionBy("feed_id", "guid").orderBy(F.desc("seq")))).where("_r = 1").drop("_r", "seq")
    old, new = items.alias("o"), latest.alias("n")
    joined = old.join(new, ["feed_id", "guid"], "full_outer")
    known = F.col("o.item_id").isNotNull()
    longer = F.char_length("n.content") > F.char_length("o.content")
    return joined.select(
        "feed_id",
        "guid",
        F.coalesce("o.item_id", "n.item_id").alias("item_id"),
        F.coalesce("n.title", "o.title").alias("title"),
        F.coalesce("o.published", "n.published").alias("published"),
        F.when(~known | F.coalesce(longer, F.lit(False)), F.col("n.content")).otherwise(F.col("o.content")).alias("content"),
        F.coalesce("o.read", F.lit(False)).alias("read"),
        F.coalesce("o.starred", F.lit(False)).alias("starred"),
        (~known).alias("new"),
    )


def not_indexed(items: DataFrame, docs: DataFrame, batch: int | None = None) -> DataFrame:
    """Items that have no document yet, oldest first."""
    targets = docs.select(F.col("target").alias("_t"))
    left = items.join(targets, F.concat(F.lit("item/"), F.col("item_id")) == F.col("_t"), "left_anti")
    return left.orderBy("item_id").limit(batch) if batch else left


def mark_missing(books: DataFrame, seen: DataFrame) -> DataFrame:
    """Books with ``missing`` set by whether the scan saw their path."""
    paths = seen.select("path").distinct().withColumn("_seen", F.lit(True))
    return books.drop("missing").join(paths, "path", "left").withColumn("missing", F.col("_seen").isNull()).drop("_seen")


def overlay(base: DataFrame, user: DataFrame) -> DataFrame:
    """Catalog entries, the user's replacing those of the same id; disabled ones go; a shelf is kept where the user gives none."""
    both = base.withColumn("_own", F.lit(0)).unionByName(user.withColumn("_own", F.lit(1)), allowMissingColumns=True)
    own = Window.partitionBy("id").orderBy(F.desc("_own"))
    shelf = F.coalesce(F.nullif(F.col("shelf"), F.lit("")), F.lead("shelf").over(own), F.lit(""))
    return both.withColumn("shelf", shelf).withColumn("_r", F.row_number().over(own)).where("_r = 1 AND NOT disabled").drop("_r", "_own")


def new_chapters(serials: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters of followed serials that were not seen; 0 where nothing is followed."""
    n = chapters.groupBy("serial_id").agg(F.count("*").alias("n"))
    left = serials.where("followed").join(n, "serial_id", "left")
    return left.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) - F.col("seen"))), F.lit(0)).alias("new_chapters"))


def merge_chapters(known: DataFrame, listed: DataFrame) -> DataFrame:
    """Chapters after a listing (serial_id, url, title, place): known ones keep their number, new ones follow in listed order, vanished ones stay.

    An empty title does not clear a known one. A serial with an empty listing is left as it is.
    """
    joined = known.alias("k").join(listed.alias("l"), ["serial_id", "url"], "full_outer")
    top = known.groupBy("serial_id").agg(F.max("n").alias("top"))
    new = Window.partitionBy("serial_id", F.col("k.n").isNull()).orderBy("l.place")
    numbered = joined.withColumn("_i", F.row_number().over(new)).join(top, "serial_id", "left")
    return numbered.select(
        "serial_id",
        "url",
        F.coalesce("k.n", F.coalesce("top", F.lit(0)) + F.col("_i")).cast("long").alias("n"),
        F.coalesce(F.nullif(F.col("l.title"), F.lit("")), F.col("k.title"), F.lit("")).alias("title"),
    )
