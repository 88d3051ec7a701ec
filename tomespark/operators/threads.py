"""Conversations: posts (num, message_id, subject, references, date) joined to threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomespark.functions.text import base_subject

MAX_DEPTH = 8


def parents(posts: DataFrame, group: str) -> DataFrame:
    """(group, num, parent): the last known reference, else the first earlier root with the same subject if the post refers to anything."""
    refs = posts.select(group, "num", "message_id", F.posexplode("references").alias("at", "ref"))
    known = posts.select(group, F.col("message_id").alias("ref"), F.col("num").alias("found"))
    by_ref = refs.join(known, [group, "ref"]).where("ref <> message_id").groupBy(group, "num").agg(F.max_by("found", "at").alias("by_ref"))
    placed = posts.select(group, "num", base_subject(F.col("subject")).alias("_s"), (F.size("references") > 0).alias("_refers")).join(by_ref, [group, "num"], "left")
    # A post that refers to nothing known begins a thread unless an earlier one with its subject did.
    starts = F.col("by_ref").isNull()
    first = F.min(F.when(starts, F.col("num"))).over(Window.partitionBy(group, "_s").orderBy("num").rowsBetween(Window.unboundedPreceding, -1))
    parent = F.when(~starts, F.col("by_ref")).when(F.col("_refers"), first)
    return placed.select(group, "num", parent.alias("parent"))


def threads(spark, posts: DataFrame, group: str) -> DataFrame:
    """(group, num, root, depth, path): every post below a root; posts on a cycle of references are below none.

    A recursive query walks one level of all threads at a time; its rows are the
    posts, and a path is at most as long as a thread is deep.
    """
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the walk has a row a post, however many those are
    found = parents(posts, group)
    if spark.sparkContext.getCheckpointDir():  # every level reads them
        found = found.checkpoint()
    return spark.sql(f"""
        WITH RECURSIVE walk(g, num, root, depth, path) MAX RECURSION LEVEL 10000 AS (
          SELECT `{group}`, num, num, 0, array(num) FROM {{found}} WHERE parent IS NULL
          UNION ALL
          SELECT p.`{group}`, p.num, w.root, w.depth + 1, array_append(w.path, p.num)
          FROM walk w JOIN {{found}} p ON p.`{group}` = w.g AND p.parent = w.num
        )
        SELECT g AS `{group}`, num, root, least(depth, {MAX_DEPTH}) AS depth, path FROM walk
    """, found=found)


def activity(walked: DataFrame, posts: DataFrame, group: str) -> DataFrame:
    """Posts, answers and last date of each thread."""
    return walked.join(posts.select(group, "num", "date"), [group, "num"]).groupBy(group, "root").agg(F.count("*").alias("posts"), F.max("date").alias("last"), F.max("depth").alias("depth"))


def without_killed(posts: DataFrame, patterns: list[str], columns: list[str]) -> DataFrame:
    """Posts none of whose columns contains a pattern, case aside. Patterns are the reader's own few."""
    wanted = [p.strip().lower() for p in patterns if p.strip()]
    hit = F.lit(False)
    for p in wanted:
        for c in columns:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(p))
    return posts.where(~hit)


def ordered_parts(parts: DataFrame, series: str) -> DataFrame:
    """Parts of a series in order: by part number when all have different ones, else by time."""
    summed = parts.groupBy(series, "part").agg(F.count("*").alias("n")).groupBy(series).agg(F.max("n").alias("_most"), F.min("part").alias("_least"))
    by_number = (F.col("_least") > 0) & (F.col("_most") == 1)
    order = Window.partitionBy(series).orderBy(F.when(F.col("_by_number"), F.col("part")), "posted", "id")
    marked = parts.join(summed, series).withColumn("_by_number", by_number)
    return marked.withColumn("place", F.row_number().over(order)).drop("_by_number", "_most", "_least")
