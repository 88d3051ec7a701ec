"""The visit log: one row per opened page, and what is counted over it.

A visit has target, kind, title, seen_at (any orderable time). ``forget`` rows are
tombstones: they wipe the visits before them of one target, or of everything
under it.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visits_since(log: DataFrame, since: datetime) -> DataFrame:
    return log.where(F.col("target").isNotNull() & (F.col("target") != "") & (F.col("seen_at") >= F.lit(since)))


def history(visits: DataFrame) -> DataFrame:
    """First, last, opens and the latest title and kind of each target."""
    order = F.struct("seen_at", "pos")
    return visits.groupBy("target").agg(F.min("seen_at").alias("first"), F.max("seen_at").alias("last"), F.count("*").alias("opens"), F.max_by("title", order).alias("title"), F.max_by("kind", order).alias("kind"))


def without_forgotten(log: DataFrame) -> DataFrame:
    """Visits of a log (target, title, kind, at, pos, forget, under) that no later tombstone wipes.

    Exact tombstones are one number per target and are joined; those with
    ``under`` reach all targets that begin with theirs and a slash, so every
    target is matched to the tombstones on its own path prefixes by equality.
    """
    tombs = log.where("forget")
    exact = tombs.groupBy(F.col("target").alias("t")).agg(F.max("pos").alias("gone"))
    under = tombs.where("under").groupBy(F.col("target").alias("t")).agg(F.max("pos").alias("gone"))
    visits = log.where("NOT forget")
    targets = visits.select("target").distinct()
    parts = F.split("target", "/")
    prefixes = targets.select("target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("t"))
    wiped = prefixes.where("t <> target").join(under, "t").select("target", "gone").union(targets.join(exact, targets.target == exact.t).select("target", "gone"))
    last = wiped.groupBy("target").agg(F.max("gone").alias("gone"))
    return visits.join(last, "target", "left").where("gone IS NULL OR pos > gone").drop("gone")


def ledger(visits: DataFrame, now: datetime) -> DataFrame:
    """Opens, different pages and days over 7 days, 30 days and all time, for all kinds and each kind."""
    week, month = F.col("seen_at") >= F.lit(now - timedelta(days=7)), F.col("seen_at") >= F.lit(now - timedelta(days=30))
    day = F.to_date("seen_at")
    spans = {"7": week, "30": month, "all": F.lit(True)}
    columns: list[Column] = []
    for name, inside in spans.items():
        columns += [F.count_if(inside).alias(f"opens_{name}"), F.count_distinct(F.when(inside, F.col("target"))).alias(f"pages_{name}"), F.count_distinct(F.when(inside, day)).alias(f"days_{name}")]
    return visits.groupingSets([[], [F.col("kind")]], F.col("kind")).agg(*columns)


def most_returned(visits: DataFrame, k: int = 5, least: int = 2) -> DataFrame:
    """The targets opened most often, by opens, then the latest, then by name."""
    counted = visits.groupBy("target").agg(F.count("*").alias("opens"), F.max("seen_at").alias("last"))
    return counted.where(F.col("opens") >= least).orderBy(F.desc("opens"), F.desc("last"), "target").limit(k)


def unfinished(hist: DataFrame, aside: DataFrame) -> DataFrame:
    """Targets left between 5 and 95 percent, without books and without those set aside since their last opening."""
    left = hist.where("pos > 0.05 AND pos < 0.95 AND kind <> 'book'")
    put = aside.groupBy("target").agg(F.max("seen_at").alias("put"))
    return left.join(put, "target", "left").where("put IS NULL OR put < last").drop("put")


def reading_days(visits: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    return visits.where(F.col("seen_at") >= F.lit(now - timedelta(days=days))).agg(F.count_distinct(F.to_date("seen_at")).alias("days"))


def sessions(visits: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Runs of a target's visits with no longer pause than the gap (an extension)."""
    w = Window.partitionBy("target").orderBy("seen_at", "pos")
    late = F.col("seen_at").cast("timestamp") > F.lag(F.col("seen_at").cast("timestamp")).over(w) + F.expr(f"INTERVAL {gap_minutes} MINUTES")
    numbered = visits.withColumn("session", F.sum(F.when(F.coalesce(late, F.lit(True)), 1).otherwise(0)).over(w))
    return numbered.groupBy("target", "session").agg(F.min("seen_at").alias("begin"), F.max("seen_at").alias("end"), F.count("*").alias("opens"))
