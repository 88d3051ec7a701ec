"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feed items: a feed for each event type."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("item_id"),
        F.col("event_type").alias("feed_id"),
        F.col("event_id").cast("string").alias("guid"),
        F.col("props").alias("title"),
        F.col("ts").alias("published"),
        F.col("props").alias("content"),
        F.col("ts").alias("added"),
        (F.col("event_id") % 3 == 0).alias("read"),
        (F.col("event_id") % 17 == 0).alias("starred"),
    )


ITEMS = """items AS (
  SELECT event_id AS item_id, event_type AS feed_id, CAST(event_id AS VARCHAR) AS guid, props AS title, ts AS published,
         props AS content, ts AS added, event_id % 3 = 0 AS read, event_id % 17 = 0 AS starred FROM events
)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as visits: a target for each user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("target"), F.col("event_type").alias("kind"), F.col("props").alias("title"), F.col("ts").alias("seen_at"), F.col("event_id").alias("pos"))


VISITS = "visits AS (SELECT CAST(user_id AS VARCHAR) AS target, event_type AS kind, props AS title, ts AS seen_at, event_id AS pos FROM events)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as indexed texts; the first line is the title."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("target"), F.col("source").alias("kind"), F.substring_index("text", "\n", 1).alias("title"), F.col("text"), F.col("doc_id").alias("updated"), F.col("lang"))


TEXTS = "texts AS (SELECT CAST(doc_id AS VARCHAR) AS target, source AS kind, split_part(text, chr(10), 1) AS title, text, doc_id AS updated, lang FROM documents)"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as posts: each refers to the two turns before it, every fifth to a lost one only."""
    c = table(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws("-", F.col("conv_id"), t)
    turn = F.col("turn")
    refs = F.when(turn == 0, F.array().cast("array<string>")).when(turn % 5 == 4, F.array(F.lit("lost"))).otherwise(F.array(name(turn - 2), name(turn - 1)))
    subject = F.concat(F.when(turn > 0, "Re: ").otherwise(""), F.lit("Talk "), F.col("conv_id"))
    return c.select("conv_id", turn.alias("num"), name(turn).alias("message_id"), subject.alias("subject"), refs.alias("references"), turn.alias("date"), F.col("role").alias("sender"), F.col("text").alias("body"))


#: Bytes of text in a part of parted().
PART = 8 << 20


def parted(docs: DataFrame) -> DataFrame:
    """Texts (target, title, text, ...) dealt by target into parts of about PART bytes, so what a task holds of them does not grow with the table."""
    size = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + F.octet_length(F.coalesce("title", F.lit(""))))).first()[0] or 0
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART)), "target")


def dealt(df: DataFrame) -> DataFrame:
    """A table in as many parts as there are cores at least; a single file would be worked on by one of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
