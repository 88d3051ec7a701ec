"""Orders and evictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trimmed(cache: DataFrame, limit: int, share: float = 0.9, buckets: int = 256) -> DataFrame:
    """What stays of a cache (k, size, read): those read longest ago go until ``share`` of the limit holds the rest.

    The running total over all files is made of bucket totals: files are dealt
    by range of ``read``, so no task sorts all of them.
    """
    ends = cache.select(F.percentile_approx("read", [i / buckets for i in range(1, buckets)], 10_000).alias("ends"))
    placed = cache.crossJoin(F.broadcast(ends)).withColumn("_b", F.size(F.filter("ends", lambda e: e < F.col("read")))).drop("ends")
    sums = placed.groupBy("_b").agg(F.sum("size").alias("_sum"))  # at most ``buckets`` rows
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_sum").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    inside = F.sum("size").over(Window.partitionBy("_b").orderBy("read", "k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    running = placed.join(F.broadcast(before.drop("_sum")), "_b").withColumn("_at", F.col("_before") + inside)
    return running.where(~(F.col("_total") - F.col("_at") > share * limit)).drop("_b", "_before", "_total", "_at")


def first_of_each(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row of each key, by position. Later ranks are dropped before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(position)
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def by_preference(formats: list[str], column: Column) -> Column:
    """A sort key: the place of a value in a list, unknown ones last."""
    known = F.array(*map(F.lit, formats))
    at = F.array_position(known, column)
    return F.when(at == 0, len(formats) + 1).otherwise(at)


def unique_names(rows: DataFrame, name: str, order: str, buckets: int = 256) -> DataFrame:
    """Names made unique by -2, -3 and so on in order, which is a number or a time.

    Rows are dealt by name and range of ``order``, so no task sorts all of one
    name. Ranges follow from quantiles of the whole column; a name's numbers go
    on from the counts of its earlier ranges.
    """
    ends = rows.select(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000).alias("_ends"))  # one row
    range_of = F.coalesce(F.size(F.filter("_ends", lambda e: e < F.col(order))), F.lit(0))
    placed = rows.crossJoin(F.broadcast(ends)).withColumn("_b", range_of).drop("_ends")
    counts = placed.groupBy(F.col(name).alias("_name"), F.col("_b").alias("_range")).agg(F.count("*").alias("_n"))  # at most ``buckets`` rows a name
    earlier = Window.partitionBy("_name").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_name", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = placed.withColumn("_at", F.row_number().over(Window.partitionBy(name, "_b").orderBy(order)))
    numbered = inside.join(before, F.col(name).eqNullSafe(F.col("_name")) & (F.col("_b") == F.col("_range")))
    n = F.col("_before") + F.col("_at")
    return numbered.select(*rows.columns, n.alias("_n")).withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat_ws("-", name, "_n"))).drop("_n")


def keyset_page(rows: DataFrame, column: str, before: int | None, size: int) -> DataFrame:
    """The ``size`` rows below a number, largest first."""
    found = rows.where(F.col(column) < before) if before is not None else rows
    return found.orderBy(F.desc(column)).limit(size)
