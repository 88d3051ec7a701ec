"""Append-only logs of JSON lines: visits, and table-game entries by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line of the visit log: target, title, kind, catalog, nanoseconds, tombstone marks.
VISIT_LINE = "t string, ti string, k string, c string, at long, f boolean, u boolean, _corrupt string"
GAME_LINE = "time timestamp, kind string, input string, result string, detail string, source string, link string, manual boolean, _corrupt string"


def as_visits(lines: DataFrame, *keep: str) -> DataFrame:
    """Lines as visits and tombstones; torn lines and lines without a target are left out."""
    good = lines.where("_corrupt IS NULL AND t IS NOT NULL AND t <> ''")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return good.select(F.col("t").alias("target"), F.coalesce("ti", F.lit("")).alias("title"), F.coalesce("k", F.lit("")).alias("kind"), F.coalesce("c", F.lit("")).alias("catalog"), "at", F.expr("timestamp_micros(at div 1000)").alias("seen_at"), flag("f").alias("forget"), flag("u").alias("under"), *keep)


def read_visits(spark: SparkSession, path: str) -> DataFrame:
    """The visit log. ``pos`` orders lines by the age of their file, then by its name and as they stand in it."""
    lines = spark.read.schema(VISIT_LINE).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    # Within a block the ids rise with the lines; across blocks and files they follow how Spark packed those.
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return as_visits(lines.withColumn("pos", place), "pos")


def append_visits(visits: DataFrame, path: str) -> None:
    """Visits (target, title, kind, catalog, at, forget, under) as lines of the log."""
    visits.select(F.col("target").alias("t"), F.col("title").alias("ti"), F.col("kind").alias("k"), F.nullif(F.col("catalog"), F.lit("")).alias("c"), "at", F.nullif(F.col("forget"), F.lit(False)).alias("f"), F.nullif(F.col("under"), F.lit(False)).alias("u")).write.mode("append").json(path)


def recent_entries(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The latest ``n`` table-game entries over day files named by date, newest first."""
    lines = spark.read.schema(GAME_LINE).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    named = lines.withColumn("day", F.regexp_extract("_metadata.file_name", r"(\d{4}-\d{2}-\d{2})", 1))
    return named.where("_corrupt IS NULL AND time IS NOT NULL").drop("_corrupt").orderBy(F.desc("day"), F.desc("time")).limit(n)
