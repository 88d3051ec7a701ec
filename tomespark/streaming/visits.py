"""The visit log as a stream: history kept up to date, windowed counts, and feed upkeep batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tomespark.operators import feeds
from tomespark.sources.logs import VISIT_LINE, as_visits


def stream_visits(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New lines of the log's files as they come."""
    lines = spark.readStream.schema(VISIT_LINE).option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_per_batch).json(path)
    return as_visits(lines)


def running_history(visits: DataFrame) -> DataFrame:
    """First, last, opens, latest title and kind of each target; run it in update mode."""
    seen = visits.where("NOT forget")
    return seen.groupBy("target").agg(F.min("seen_at").alias("first"), F.max("seen_at").alias("last"), F.count("*").alias("opens"), F.max_by("title", "at").alias("title"), F.max_by("kind", "at").alias("kind"))


def windowed_opens(visits: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Opens and different pages of each kind and window. Visits later than the watermark are dropped, so state stays bounded; pages are counted by sketch."""
    return (
        visits.where("NOT forget")
        .withWatermark("seen_at", late)
        .groupBy(F.window("seen_at", window), "kind")
        .agg(F.count("*").alias("opens"), F.approx_count_distinct("target").alias("pages"))
        .select(F.col("window.start").alias("begin"), F.col("window.end").alias("end"), "kind", "opens", "pages")
    )


def upkeep(batches: DataFrame, folder: str, checkpoint: str, keep: int = 200, newest: int = 100) -> StreamingQuery:
    """Feed sync: each micro-batch takes the newest items of every feed, upserts them into the items and prunes.

    Item tables are written as numbered versions, the number being that of the
    batch: a batch that runs again after a failure replaces its own version.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = feeds.newest(feeds.latest(batch), newest).drop("rank").withColumn("seq", F.lit(number))
        if number == 0:
            items = fresh.drop("seq")
        else:
            old = spark.read.parquet(f"{folder}/v{number - 1}")
            items = feeds.upsert(old, fresh).drop("new").join(old.select("feed_id", "guid", "added"), ["feed_id", "guid"], "left").withColumn("added", F.coalesce("added", F.current_timestamp()))
        feeds.pruned(items, keep, F.current_timestamp() - F.expr("INTERVAL 1 MONTH")).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return batches.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
