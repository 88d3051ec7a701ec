"""Current state from events and small ledgers: queues, counters, flags, memory, facts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded_queue(events: DataFrame) -> DataFrame:
    """(url, title, section, done) after queue events (url, action, title, section, pos): add, done, move, remove.

    The last event of each kind decides; adding re-opens what was done and brings
    back what was removed.
    """
    last = lambda *actions: F.max(F.when(F.col("action").isin(*actions), F.col("pos")))
    state = events.groupBy("url").agg(
        F.max_by("title", F.when(F.col("action") == "add", F.col("pos"))).alias("title"),
        F.max_by("section", F.when(F.col("action").isin("add", "move"), F.col("pos"))).alias("section"),
        last("add").alias("_add"),
        last("done").alias("_done"),
        last("remove").alias("_gone"),
    )
    return state.where("_add IS NOT NULL AND (_gone IS NULL OR _gone < _add)").select("url", "title", "section", F.coalesce(F.col("_done") > F.col("_add"), F.lit(False)).alias("done"))


def counters(changes: DataFrame, low: int = 0, high: int = 100) -> DataFrame:
    """(name, value) after changes (name, delta, pos), kept between bounds at every step.

    A counter's changes are folded in order, so they meet in one row: they are the moves of one game at one table.
    """
    steps = changes.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", "delta"))).alias("_s"))
    clamp = lambda x: F.least(F.greatest(x, F.lit(low).cast("long")), F.lit(high).cast("long"))
    return steps.select("name", F.aggregate("_s", F.lit(low).cast("long"), lambda acc, s: clamp(acc + s["delta"])).alias("value"))


def last_shown(shown: DataFrame, key: str, ring: int = 300) -> DataFrame:
    """The latest ``ring`` targets of a memory (key, target, pos)."""
    order = Window.partitionBy(key).orderBy(F.desc("pos"))
    return shown.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= ring).drop("_r")


def not_shown(candidates: DataFrame, shown: DataFrame, since: datetime) -> DataFrame:
    """Candidates whose target was not shown since a time."""
    return candidates.join(shown.where(F.col("seen_at") >= F.lit(since)).select("target"), "target", "left_anti")


def least_recent(options: DataFrame, said: DataFrame, seed: int) -> DataFrame:
    """(subject, option) of each subject the option said longest ago; those never said come first, in an order set by the seed."""
    last = said.groupBy("subject", "option").agg(F.max("pos").alias("last"))
    n = F.count("*").over(Window.partitionBy("subject"))
    order = Window.partitionBy("subject").orderBy(F.coalesce("last", F.lit(-1)), F.pmod(F.col("i") - seed, F.col("_n")))
    return options.join(last, ["subject", "option"], "left").withColumn("_n", n).withColumn("_r", F.row_number().over(order)).where("_r = 1").select("subject", "option")


def best_links(links: DataFrame, group: str) -> DataFrame:
    """(group, href): of each group the link with the longest text, a heading's counting 1000 more; the first of equals."""
    score = F.char_length("text") + F.when(F.col("in_heading"), 1000).otherwise(0)
    return links.groupBy(group).agg(F.max_by("href", F.struct(score, -F.col("n"))).alias("href"))


def merged_results(results: DataFrame) -> DataFrame:
    """Results (url, title, extra, pos) without later ones of an equal address, then without later ones of equal title and extra."""
    by_url = results.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("pos"))).where("_r = 1").drop("_r")
    name = F.concat_ws("\x01", F.lower("title"), F.lower("extra"))
    return by_url.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy("pos"))).where("_r = 1").drop("_r")


def suggestions(words: DataFrame, prefix: str, n: int) -> DataFrame:
    """The first ``n`` headwords that begin with a prefix, ASCII case aside."""
    return words.where(F.lower("word").startswith(prefix.lower())).orderBy(F.lower("word"), "word").limit(n)


def looked_up(words: DataFrame, synonyms: DataFrame, word: str) -> DataFrame:
    """Entries of a headword, and those that a synonym of this spelling leads to."""
    direct = words.where(F.lower("word") == word.lower())
    leads = synonyms.where(F.lower("synonym") == word.lower()).select("entry").distinct()
    return direct.unionByName(words.join(leads, "entry", "left_semi")).distinct()


def desk_facts(history: DataFrame, unread: DataFrame, queue: DataFrame, days: DataFrame, now: datetime) -> DataFrame:
    """(fact, n): what is worth saying today. Absence of three days is urgent, so it stands alone if it holds."""
    away = history.agg(F.floor((F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.max("last").cast("timestamp"))) / 86400).alias("n")).select(F.lit("absent").alias("fact"), "n").where("n >= 3")
    waiting = unread.agg(F.sum("unread").alias("n")).select(F.lit("unread").alias("fact"), "n").where("n >= 15")
    open_items = queue.agg(F.count_if(~F.col("done")).alias("n")).select(F.lit("queue").alias("fact"), "n").where("n >= 3")
    habit = days.select(F.lit("habit").alias("fact"), F.col("days").alias("n")).where("n >= 5")
    every = away.unionByName(waiting).unionByName(open_items).unionByName(habit)  # four rows at most
    urgent = F.max(F.col("fact") == "absent").over(Window.partitionBy())
    return every.withColumn("_u", urgent).where("NOT _u OR fact = 'absent'").drop("_u")


def walked(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(target, depth): pages reached from ``start`` over links (target, href), breadth first, each at its least depth.

    Each round joins only the frontier and is cut from its lineage; pages seen
    before are left out, so a round's work is that of its new pages.
    """
    frontier = start.select("target").distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for d in range(1, depth + 1):
        reached = links.join(frontier.select("target"), "target").select(F.col("href").alias("target")).distinct()
        frontier = reached.join(seen.select("target"), "target", "left_anti").withColumn("depth", F.lit(d))
        frontier = frontier.checkpoint() if links.sparkSession.sparkContext.getCheckpointDir() else frontier
        seen = seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def and_all(conditions: list[Column]) -> Column:
    """All of some conditions; none is true."""
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def field_query(text: str) -> tuple[list[Column], str]:
    """Conditions of a query such as ``ext:epub lang:en year:1999 author:poe tales``, and its plain words."""
    found: list[Column] = []
    plain = []
    for word in text.split():
        field, _, value = word.partition(":")
        if not value or field not in ("ext", "lang", "year", "author", "title", "publisher"):
            plain.append(word)
        elif field == "ext":
            found.append(F.lower("extension").isin(*value.lower().split(",")))
        elif field in ("lang", "year"):
            found.append(F.lower(F.col("language" if field == "lang" else "year").cast("string")) == value.lower())
        else:
            found.append(F.contains(F.lower(F.col(field)), F.lit(value.lower())))
    return found, " ".join(plain)
