"""Lists and reports over comics, books, draws, caches and threads of comments."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds of an issue in the order in which its cover names them.
COVER_KINDS = ["periodical", "weird", "fiction", "esoteric", "sufism", "folklore", "knowledge", "encyclopedic", "public", "archive", "smallweb", "queue"]


def no_case(c: Column) -> Column:
    """A sort key that folds ASCII letters only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def series_list(comics: DataFrame) -> DataFrame:
    """Issues, unread issues and last opening of each series that is there."""
    return comics.where("NOT missing").groupBy("series").agg(F.count("*").alias("issues"), F.count_if(~F.col("finished")).alias("unread"), F.max("opened").alias("opened")).orderBy(no_case(F.col("series")), "series")


def issues_of(comics: DataFrame, series: str) -> DataFrame:
    return comics.where(~F.col("missing") & (F.col("series") == series)).orderBy("number", "path")


def recent_comics(comics: DataFrame, limit: int) -> DataFrame:
    """The comics opened last, unfinished ones first."""
    return comics.where("NOT missing AND opened > 0").orderBy("finished", F.desc("opened"), "path").limit(limit)


def books_in_order(books: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """The library by ``recent``, ``added`` or ``author``."""
    found = books.where("NOT missing")
    if order == "recent":
        found = found.where("opened > 0").orderBy(F.desc("opened"), "path")
    elif order == "added":
        found = found.orderBy(F.desc("added"), "path")
    else:
        found = found.orderBy(no_case(F.col("author")), no_case(F.col("title")), "path")
    return found.limit(limit) if limit else found


def shelf_draws(draws: DataFrame, now: datetime) -> DataFrame:
    """Draws (family, at) of each shelf in the last 7 and 30 days."""
    age = lambda days: (F.col("at") > F.lit(now - timedelta(days=days))) & (F.col("at") <= F.lit(now))
    return draws.where(age(30)).groupBy("family").agg(F.count_if(age(7)).alias("week"), F.count("*").alias("month"))


def cover_counts(pages: DataFrame, kinds: list[str] = COVER_KINDS) -> DataFrame:
    """(place, kind, n): how many pages of each kind an issue holds, in the cover's order; other kinds are not named."""
    known = F.array(*map(F.lit, kinds))
    counted = pages.groupBy("kind").agg(F.count("*").alias("n"))
    return counted.select(F.array_position(known, F.col("kind")).alias("place"), "kind", "n").where("place > 0").orderBy("place")


def cache_size(files: DataFrame, parts: list[str]) -> DataFrame:
    """Bytes and number of the files (path, length, link) in some top folders of a cache; links are not followed and not counted."""
    top = F.substring_index(F.col("path"), "/", 1)
    return files.where(top.isin(parts) & ~F.col("link")).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def folder_sizes(files: DataFrame) -> DataFrame:
    """Bytes and files of each top folder."""
    return files.groupBy(F.substring_index(F.col("path"), "/", 1).alias("folder")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


def page_with_more(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """The rows of a page counted from 1, each with whether a further page follows: one row more is read, and not shown."""
    probed = rows.orderBy(*order).offset((page - 1) * size).limit(size + 1)
    more = probed.agg((F.count("*") > size).alias("more"))  # one row
    return probed.orderBy(*order).limit(size).crossJoin(F.broadcast(more))


def has_all_words(column: Column, words: list[str]) -> Column:
    """Whether a folded text contains every one of some folded words."""
    held = F.lit(True)
    for w in words:
        held = held & column.contains(w)
    return held


def comment_tree(comments: DataFrame, spark: SparkSession) -> DataFrame:
    """(root, id, depth, order) of comments (id, parent, num): replies under what they answer, in order of their numbers.

    A comment whose parent is null or not there is a root. Each level is one join; ``order`` is the
    path of numbers, padded, by which a reader meets the comments.
    """
    lone = comments.join(comments.select(F.col("id").alias("parent"), F.lit(True).alias("there")), "parent", "left")
    pad = F.lpad(F.col("num").cast("string"), 12, "0")
    level = lone.where("there IS NULL").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), pad.alias("order"))
    out = level
    answers = lone.where("there").select(F.col("id"), F.col("parent"), pad.alias("own"))
    depth = 0
    while True:
        depth += 1
        level = answers.join(level.select("root", F.col("id").alias("parent"), F.col("order").alias("above")), "parent").select("root", "id", F.lit(depth).alias("depth"), F.concat_ws("/", "above", "own").alias("order"))
        level = level.checkpoint() if spark.sparkContext.getCheckpointDir() else level.persist()
        if not level.limit(1).count():
            return out
        out = out.unionByName(level)
