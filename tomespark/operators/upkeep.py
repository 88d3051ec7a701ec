"""State upkeep: what a batch of records does to the rows that are kept of them.

Old rows and batch rows are put under each other and folded by key in one
aggregation, so an upsert is one shuffle that combines before it, whatever the
number of records of a key. Missing text is the empty string, never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomespark.operators import intervals


def folded(old: DataFrame, batch: DataFrame, key: str, latest: list[str] = (), filled: list[str] = (), first: list[str] = (), state: dict[str, object] | None = None) -> DataFrame:
    """Old rows after a batch with an order ``seq``.

    ``latest`` columns take the batch's last value, ``filled`` ones its last that
    is neither empty nor 0, ``first`` ones keep the first value ever, and ``state``
    ones are never in a batch: they stay, and new keys get the value given.
    """
    state = state or {}
    kept = [key, *latest, *filled, *first]
    both = old.select(*kept, *state, F.lit(None).cast("long").alias("_seq")).unionByName(batch.select(*kept, F.col("seq").cast("long").alias("_seq")), allowMissingColumns=True)
    at = F.coalesce(F.col("_seq"), F.lit(-1).cast("long"))
    blank = lambda c: F.col(c).cast("string").isin("", "0") | F.col(c).isNull()
    columns = [F.max_by(c, at).alias(c) for c in latest]
    columns += [F.coalesce(F.max_by(c, F.when(~blank(c), at)), F.max_by(c, at)).alias(c) for c in filled]
    columns += [F.min_by(c, at).alias(c) for c in first]
    columns += [F.coalesce(F.max(F.when(F.col("_seq").isNull(), F.col(c))), F.lit(v)).alias(c) for c, v in state.items()]
    return both.groupBy(key).agg(*columns, F.bool_or(F.col("_seq").isNotNull()).alias("touched"))


def feed_states(states: DataFrame, attempts: DataFrame) -> DataFrame:
    """Feeds after sync attempts: an empty title and a last success of 0 do not clear the known ones."""
    return folded(states, attempts, "feed_id", latest=["url", "last_sync", "last_error"], filled=["title", "last_ok"]).drop("touched")


def books(old: DataFrame, scanned: DataFrame) -> DataFrame:
    """Books after a scan: they take its description, keep their reading state and when they were added, and are no longer missing."""
    out = folded(old, scanned, "path", latest=["format", "title", "author", "lang"], filled=["source", "chapters"], first=["added"], state={"opened": 0, "chapter": 0, "pos": 0.0, "missing": False})
    return out.withColumn("missing", F.col("missing") & ~F.col("touched")).drop("touched")


def comics(old: DataFrame, scanned: DataFrame) -> DataFrame:
    """Comics after a scan; as books, but every description is taken whole."""
    out = folded(old, scanned, "path", latest=["series", "number", "title", "pages", "rtl"], first=["added"], state={"opened": 0, "page": 0, "finished": False, "missing": False})
    return out.withColumn("missing", F.col("missing") & ~F.col("touched")).drop("touched")


def serials(old: DataFrame, found: DataFrame) -> DataFrame:
    """Serials after they were looked up: empty texts do not clear known ones; following, progress and what was seen stay."""
    return folded(old, found, "url", latest=["kind"], filled=["title", "author", "summary"], first=["added"], state={"followed": False, "seen": 0, "opened": 0}).drop("touched")


def flagged(items: DataFrame, actions: DataFrame) -> DataFrame:
    """Items after actions (action, item_id, feed_id, seq).

    ``read`` and ``unread`` set one item, ``all_read`` every item of a feed, and
    ``star`` turns one item's star over. The last that reaches an item counts.
    """
    own = actions.where("action IN ('read', 'unread', 'star')").groupBy("item_id").agg(
        F.max_by(F.col("action") == "read", F.when(F.col("action") != "star", F.col("seq"))).alias("_set"),
        F.max(F.when(F.col("action") != "star", F.col("seq"))).alias("_at"),
        (F.count_if(F.col("action") == "star") % 2 == 1).alias("_turned"),
    )
    whole = actions.where("action = 'all_read'").groupBy("feed_id").agg(F.max("seq").alias("_all"))  # a row a feed
    joined = items.join(own, "item_id", "left").join(whole, "feed_id", "left")
    later = F.coalesce(F.col("_all") > F.coalesce("_at", F.lit(-1)), F.lit(False))
    read = F.when(later, True).otherwise(F.coalesce("_set", "read"))
    starred = F.col("starred") != F.coalesce("_turned", F.lit(False))
    return joined.withColumns({"read": read, "starred": starred}).select(*items.columns)


def progressed(comics: DataFrame, turns: DataFrame) -> DataFrame:
    """Comics after page turns (path, page, pages, at, seq): the last page counts; reaching the end finishes a comic, turning back does not undo it."""
    ended = F.bool_or((F.col("pages") > 0) & (F.col("page") >= F.col("pages") - 1))
    last = turns.groupBy("path").agg(F.max_by("page", "seq").alias("_page"), F.max_by("at", "seq").alias("_at"), ended.alias("_ended"))
    joined = comics.join(last, "path", "left")
    changed = {"page": F.coalesce("_page", "page"), "opened": F.coalesce("_at", "opened"), "finished": F.col("finished") | F.coalesce("_ended", F.lit(False))}
    return joined.withColumns(changed).select(*comics.columns)


def checked(serials: DataFrame, chapters: DataFrame, checks: DataFrame) -> DataFrame:
    """Serials after update checks (url, error, found, seq), a row a check; ``found`` is how many chapters were listed.

    A failed check or an empty listing leaves its error; a good one clears it. A serial that the
    check adds has nothing new: all its chapters count as seen.
    """
    error = F.when((F.col("error") == "") & (F.col("found") == 0), F.lit("no chapters found")).otherwise(F.col("error"))
    last = checks.groupBy("url").agg(F.max_by(error, "seq").alias("_error"), F.max(F.when(error == "", F.lit(True))).alias("_good"))
    known = chapters.groupBy("url").agg(F.count("*").alias("_n"))
    joined = serials.join(last, "url", "full_outer").join(known, "url", "left").where("followed IS NOT NULL OR _good")
    added = F.col("followed").isNull()
    return joined.select(
        "url",
        F.coalesce("followed", F.lit(False)).alias("followed"),
        F.when(added, F.coalesce("_n", F.lit(0))).otherwise(F.col("seen")).alias("seen"),
        F.coalesce("_error", "error", F.lit("")).alias("error"),
    )


def sync_report(results: DataFrame) -> DataFrame:
    """One row of a sync's results (feed_id, new, error): new items, feeds that failed and the first of them by name."""
    failed = F.col("error") != ""
    return results.agg(F.coalesce(F.sum("new"), F.lit(0)).alias("new"), F.count_if(failed).alias("failed"), F.min(F.when(failed, F.col("feed_id"))).alias("first_failed"), F.count("*").alias("checked"))


def read_sets(groups: DataFrame, known: DataFrame, marks: DataFrame, newest: int = 100) -> DataFrame:
    """(name, lo, hi): what has been read of each newsgroup, as disjoint intervals.

    ``known`` (name, lo, hi) are read sets; a group (name, hi) without one starts with all but
    its newest articles. ``marks`` (name, num) mark one article, or with a null ``num`` all.
    """
    fresh = groups.join(known.select("name").distinct(), "name", "left_anti").select("name", F.lit(1).cast("long").alias("lo"), (F.col("hi") - newest).cast("long").alias("hi"))
    every = marks.where("num IS NULL").select("name").distinct().join(groups, "name").select("name", F.lit(1).cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    single = marks.where("num IS NOT NULL").select("name", F.col("num").cast("long").alias("lo"), F.col("num").cast("long").alias("hi"))
    spans = known.select("name", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).unionByName(fresh).unionByName(every).unionByName(single)
    return intervals.merged(spans.where("hi >= lo").distinct(), "name")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not forgotten."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def under(column: Column, prefix: str) -> Column:
    """Whether a target begins with a prefix."""
    return column.startswith(prefix)


def new_subscriptions(feeds: DataFrame, wanted: DataFrame) -> DataFrame:
    """Subscriptions (name, key, pos) whose address no feed has; of equal ones the first by position."""
    first = wanted.groupBy("key").agg(F.min_by(F.struct("name", "pos"), "pos").alias("f")).select("key", "f.name", "f.pos")
    return first.join(feeds.select("key").distinct(), "key", "left_anti")
