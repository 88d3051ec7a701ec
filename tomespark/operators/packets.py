"""The packet of a day, for every user at once: periodicals, rotating sections, and the reading queue.

All choices are ranks within a user. Periodicals come from different shelves as
long as there are any, those not in a recent packet first; of a shelf the feed not
in a recent packet, and of a feed one of its three newest unread items. A second
feed of a shelf follows only when there are fewer shelves than places. Sections
are drawn from their pools up to three times. Nothing shown in the last 30 days is
taken. Orders come from a hash of seed, user and name, so a packet can be made
again.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Items, days of memory, newest items of a feed, and draws of a section.
PLACES, DAYS, NEWEST, DRAWS = 3, 30, 3, 3


def drawn(seed: int, *columns: str) -> Column:
    """A hash of names to order by."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def number(hashed: Column, below: Column) -> Column:
    """A number from 0 up to ``below`` of a hash."""
    return F.pmod(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long"), below)


def recent(shown: DataFrame, day: date, days: int = DAYS) -> DataFrame:
    """What was shown in the days before, and on, a day. ``shown`` has user, target, feed, shelf and at, a date."""
    return shown.where((F.col("at") > F.lit(day - timedelta(days=days))) & (F.col("at") <= F.lit(day)))


def periodicals(items: DataFrame, shown: DataFrame, day: date, places: int = PLACES, seed: int = 0) -> DataFrame:
    """(user, place, target, feed, shelf): up to ``places`` unread items (user, target, feed, shelf, published, title) of each user."""
    lately = recent(shown, day)
    fresh = items.where("title <> ''").join(lately.select("user", "target"), ["user", "target"], "left_anti")
    own = Window.partitionBy("user", "feed")
    newest = fresh.withColumns({"nth": F.row_number().over(own.orderBy(F.desc("published"), "target")), "many": F.count("*").over(own)})
    pick = number(drawn(seed, "user", "feed"), F.least("many", F.lit(NEWEST))) + 1
    one = newest.where(F.col("nth") == pick).select("user", "target", "feed", "shelf")
    last = lambda *key: lately.groupBy(*key).agg(F.max("at").alias(f"{key[-1]}_last"))
    aged = one.join(last("user", "feed"), ["user", "feed"], "left").join(last("user", "shelf"), ["user", "shelf"], "left")
    # Never shown comes first, then what was shown longest ago.
    within = Window.partitionBy("user", "shelf").orderBy(F.asc_nulls_first("feed_last"), drawn(seed, "user", "feed"), "feed")
    shelves = Window.partitionBy("user").orderBy(F.asc_nulls_first("shelf_last"), drawn(seed, "user", "shelf"), "shelf")
    ranked = aged.withColumns({"round": F.row_number().over(within), "s": F.dense_rank().over(shelves)}).where("round <= 2")
    place = F.row_number().over(Window.partitionBy("user").orderBy("round", "s"))
    return ranked.withColumn("place", place).where(F.col("place") <= places).select("user", "place", "target", "feed", "shelf")


def sections(chosen: DataFrame, pools: DataFrame, shown: DataFrame, day: date, seed: int = 0) -> DataFrame:
    """(user, place, kind, target): what the kinds of each user (user, drawn: array) give that was not shown lately.

    ``pools`` (kind, nth, target) number what a kind has from 0 on. A kind whose
    draws were all shown lately is left out.
    """
    sizes = pools.groupBy("kind").agg(F.count("*").alias("many"))
    each = chosen.select("user", F.posexplode("drawn").alias("place", "kind")).join(sizes, "kind")
    tries = each.withColumn("try", F.explode(F.array(*map(F.lit, range(DRAWS))))).withColumn("day", F.lit(day.isoformat()))
    tries = tries.withColumn("nth", number(drawn(seed, "user", "kind", "day", "try"), F.col("many")))
    fresh = tries.join(pools, ["kind", "nth"]).join(recent(shown, day).select("user", "target"), ["user", "target"], "left_anti")
    return fresh.groupBy("user", "place", "kind").agg(F.min_by("target", "try").alias("target"))


def first_open(queue: DataFrame) -> DataFrame:
    """(user, target): the first entry (user, n, target, done) of each queue that is not done."""
    return queue.where("NOT done").groupBy("user").agg(F.min_by("target", "n").alias("target"))


def packets(items: DataFrame, chosen: DataFrame, pools: DataFrame, queue: DataFrame, shown: DataFrame, day: date, seed: int = 0) -> DataFrame:
    """(user, place, kind, target, feed, shelf): the packet of each user; a part that is missing is skipped."""
    nothing = F.lit(None).cast("string")
    papers = periodicals(items, shown, day, seed=seed).select("user", (F.col("place") - 1).alias("place"), F.lit("periodical").alias("kind"), "target", "feed", "shelf")
    drawn_ = sections(chosen, pools, shown, day, seed).select("user", (F.col("place") + PLACES).alias("place"), "kind", "target", nothing.alias("feed"), nothing.alias("shelf"))
    waiting = first_open(queue).select("user", F.lit(1000).alias("place"), F.lit("queue").alias("kind"), "target", nothing.alias("feed"), nothing.alias("shelf"))
    every = papers.unionByName(drawn_).unionByName(waiting)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("user").orderBy("place")))


def remembered(shown: DataFrame, packet: DataFrame, day: date) -> DataFrame:
    """The memory after a packet; the reading queue is not part of it, nor what is too old to matter."""
    new = packet.where("kind <> 'queue'").select("user", "target", "feed", "shelf", F.lit(day).alias("at"))
    return recent(shown, day).select("user", "target", "feed", "shelf", "at").unionByName(new)
