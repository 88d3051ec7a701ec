"""Sets of whole numbers as sorted, disjoint intervals (lo, hi), both ends included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(rows: DataFrame, key: str) -> DataFrame:
    """Intervals of each key with those that overlap or touch made one."""
    order = Window.partitionBy(key).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(key, "lo", "hi", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0).alias("_new"))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def parse(text: Column) -> Column:
    """"1-500,503" as an array of intervals."""
    parts = F.filter(F.split(F.regexp_replace(text, r"\s", ""), ","), lambda p: p.rlike(r"^\d+(-\d+)?$"))
    low = lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("long")
    high = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"-(\d+)$", 1), F.lit("")).cast("long"), low(p))
    return F.transform(parts, lambda p: F.struct(low(p).alias("lo"), high(p).alias("hi")))


def has(ranges: Column, n: Column) -> Column:
    return F.exists(ranges, lambda r: (r["lo"] <= n) & (n <= r["hi"]))


def count_in(ranges: Column, lo: Column, hi: Column) -> Column:
    """How many numbers of the set lie between two ends."""
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda acc, r: acc + F.greatest(F.lit(0).cast("long"), F.least(r["hi"], hi) - F.greatest(r["lo"], lo) + 1))


def unread(ranges: Column, lo: Column, hi: Column, count: Column) -> Column:
    """Articles of a span that are not in the set, no fewer than none and no more than there are."""
    return F.greatest(F.lit(0).cast("long"), F.least(count, hi - lo + 1 - count_in(ranges, lo, hi)))
