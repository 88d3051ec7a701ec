"""Chains of next links: the head of every chain and each page's place in it, by pointer doubling.

A page names at most one next page. Where several name the same, the least of
them comes before it, and the others end their own chain there. So every page
has at most one before it, and the pages fall into paths and cycles.

Each page keeps a pointer back and how far it reaches. A round joins every open
page to the page that it points to and takes that one's pointer: reaches double,
and a chain of n pages is ranked in log2(n) rounds. Pages that reached a head are
done and are looked up but do not look. No two open pages of a chain point to one
page, so no key is hot. As long as a path has open pages, every round brings some
to their head; when none came and no least page changed, what is open lies on
cycles, and each is named by its least page and broken before it.

Doubling takes every page through every round, so long chains are shortened first.
A page whose hash is less than those of its neighbours is taken out, and the one
after it keeps how far it stands from the one before: a sixth to a third of the
pages go at once, so all rounds together move a few times the pages. When few are
left they are ranked by doubling, and those taken out are put back, last round
first, each behind the page before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomespark.sources.shared import written

#: Pages that are ranked by doubling alone, and the share of pages that a round of shortening must take out to go on.
FEW, WORTH = 200_000, 0.05


def _taken() -> Column:
    """Whether a page (id, back, next) is taken out: no two neighbours are, nor a head, nor a page less than both neighbours, so a cycle keeps its least page."""
    mine = F.xxhash64("id")
    least = (F.col("id") < F.col("back")) & (F.col("next").isNull() | (F.col("id") < F.col("next")))
    return F.col("back").isNotNull() & ~least & (mine < F.xxhash64("back")) & (F.col("next").isNull() | (mine < F.xxhash64("next")))


def _shortened(pages: DataFrame, few: int) -> tuple[DataFrame, list[DataFrame]]:
    """(id, back, reach) of the pages that are left of ``pages`` (id, back, reach) when few are, and what each round took out."""
    out: list[DataFrame] = []
    n = pages.count()
    if n <= few:
        return pages, out
    after = pages.where("back IS NOT NULL").select(F.col("back").alias("id"), F.col("id").alias("next"))
    pages = written(pages.join(after, "id", "left").withColumn("gone", _taken()), "pages")
    while n > few:
        gone, stay = pages.where("gone"), pages.where("NOT gone").drop("gone")
        taken = gone.count()
        if taken < WORTH * n:
            break
        out.append(gone.select("id", "back", "reach"))
        before = gone.where("next IS NOT NULL").select(F.col("next").alias("id"), F.col("back").alias("_back"), F.col("reach").alias("_reach"))
        behind = gone.select(F.col("back").alias("id"), F.col("next").alias("_next"), F.lit(True).alias("_was"))
        moved = stay.join(before, "id", "left").join(behind, "id", "left")
        moved = moved.select("id", F.coalesce("_back", "back").alias("back"), (F.col("reach") + F.coalesce("_reach", F.lit(0))).alias("reach"), F.when(F.col("_was"), F.col("_next")).otherwise(F.col("next")).alias("next"))
        pages, n = written(moved.withColumn("gone", _taken()), "pages"), n - taken
    return pages.select("id", "back", "reach"), out


def chained(links: DataFrame, few: int = FEW) -> DataFrame:
    """(id, head, place, cycle) of pages (id, next): places count from 1, ``cycle`` says whether the last page leads to the head.

    A next page that is null, not there or the page itself is none. Rows that
    repeat an id count once, with the least next page; a null id takes no part.
    """
    pages = links.where("id IS NOT NULL").groupBy("id").agg(F.min("next").alias("next"))
    pages = written(pages, "links")
    ids = pages.select(F.col("id").alias("to"))
    before = pages.where("next <> id").join(ids, F.col("next") == F.col("to"), "left_semi").groupBy(F.col("next").alias("id")).agg(F.min("id").alias("back"))
    # Reaches of 1; a head points nowhere.
    every = written(pages.select("id").join(before, "id", "left").withColumn("reach", F.when(F.col("back").isNull(), 0).otherwise(1).cast("long")), "backs")
    short, gone = _shortened(every, few)
    ranked = _ranked(short)
    for taken in reversed(gone):
        ranked = written(ranked, "ranked")
        behind = taken.join(ranked.select(F.col("id").alias("back"), "head", "place", "cycle"), "back")
        ranked = ranked.unionByName(behind.select("id", "head", (F.col("place") + F.col("reach")).alias("place"), "cycle"))
    return ranked


def _ranked(every: DataFrame) -> DataFrame:
    """(id, head, place, cycle) of pages (id, back, reach) by doubling."""
    # ``least`` is the least page on the way.
    state = every.select("id", "back", "reach", F.least("id", F.coalesce("back", "id")).alias("least"), F.coalesce("back", "id").alias("top"))
    state, left = written(state.withColumn("new", F.lit(True)), "chains"), -1
    while True:
        # One row: how many pages are open, and whether any of them learnt of a lesser page.
        open_, learnt = state.agg(F.count("back"), F.count_if(F.col("back").isNotNull() & F.col("new"))).first()
        if not open_ or (open_ == left and not learnt):
            break
        left = open_
        mine = state.where("back IS NOT NULL")
        theirs = state.select(F.col("id").alias("at"), F.col("back").alias("_back"), F.col("reach").alias("_reach"), F.col("least").alias("_least"), F.col("top").alias("_top"))
        both = mine.join(theirs, F.col("back") == F.col("at"))
        moved = both.select("id", F.col("_back").alias("back"), (F.col("reach") + F.col("_reach")).alias("reach"), F.least("least", "_least").alias("least"), F.col("_top").alias("top"), (F.col("_least") < F.col("least")).alias("new"))
        state = written(state.where("back IS NULL").unionByName(moved), "chains")
    paths = state.where("back IS NULL").select("id", F.col("top").alias("head"), (F.col("reach") + 1).alias("place"), F.lit(False).alias("cycle"))
    if not open_:
        return paths
    rings = written(state.where("back IS NOT NULL").select("id", F.col("least").alias("head")).join(every.select("id", "back", "reach"), "id"), "rings")
    # A ring is cut before its least page, and is a path then.
    opens = F.col("id") == F.col("head")
    cut = rings.select("id", "head", F.when(~opens, F.col("back")).alias("back"), F.when(opens, 0).otherwise(F.col("reach")).cast("long").alias("reach"))
    cut = written(cut, "cut")
    while cut.where("back IS NOT NULL").limit(1).count():
        theirs = cut.select(F.col("id").alias("at"), F.col("back").alias("_back"), F.col("reach").alias("_reach"))
        moved = cut.where("back IS NOT NULL").join(theirs, F.col("back") == F.col("at")).select("id", "head", F.col("_back").alias("back"), (F.col("reach") + F.col("_reach")).alias("reach"))
        cut = written(cut.where("back IS NULL").unionByName(moved), "cut")
    return paths.unionByName(cut.select("id", "head", (F.col("reach") + 1).alias("place"), F.lit(True).alias("cycle")))


def chain_sizes(ranked: DataFrame) -> DataFrame:
    """(head, cycle, pages, last): how many pages each chain has, and its last page."""
    return ranked.groupBy("head", "cycle").agg(F.count("*").alias("pages"), F.max_by("id", "place").alias("last"))


def continued(ranked: DataFrame, known: DataFrame) -> DataFrame:
    """(head, id, place): what follows the last known page of a chain; ``known`` are ids."""
    marked = ranked.join(known.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    last = marked.groupBy("head").agg(F.max(F.when(F.col("known"), F.col("place"))).alias("last"))
    return ranked.join(last.where("last IS NOT NULL"), "head").where(F.col("place") > F.col("last")).select("head", "id", "place")
