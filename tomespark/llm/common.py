"""What the corpus operators share: tables, the word rule and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words and that lines are stripped of.
BLANKS = " \t\n\x0b\x0c\r"
#: One or more of them, as a Java regular expression.
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made and set, but only
    with a local master; on a cluster it would not be shared, and this is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tomespark-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A small frame, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stash(df: DataFrame, name: str) -> DataFrame:
    """A larger frame, written once as compressed Parquet in the shared folder."""
    path = f"{session_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def session_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/tomespark-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what ``stash`` wrote for this application. Results that were not written yet are lost with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(*columns: str) -> F.Column:
    """128 bits over the given columns, as a struct of two hashes."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("again"), *reversed(columns)).alias("b"))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name like ``wanted`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def without_rows(df: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``df`` whose ``row_key`` over ``columns`` is not the single column of ``gone``."""
    name = free_name(df, "gone")
    return df.join(gone.toDF(name), row_key(*columns) == F.col(name), "left_anti")


#: A key with more rows than this, and more than one in HOT_KEYS of all rows, never goes to one task.
HOT_ROWS = 50_000
HOT_KEYS = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, key: list[str]) -> DataFrame:
    """Inner join of ``rows`` to ``keyed``, which has a row per key and in ``n_rows`` how many rows have it.

    Keys with more rows than HOT_ROWS and a HOT_KEYS-th of all are broadcast, so
    their rows stay where they are; there are fewer than HOT_KEYS of them. All
    others are joined by a shuffle. ``rows`` and ``keyed`` are read twice, so they
    should be stashed.
    """
    total = keyed.agg(F.sum("n_rows")).first()[0] or 0
    if total <= HOT_ROWS:
        return rows.join(keyed.drop("n_rows"), key)
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = cut(keyed.where(F.col("n_rows") > least).drop("n_rows"))
    cold = keyed.where(F.col("n_rows") <= least).drop("n_rows")
    if not hot.limit(1).count():
        return rows.join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key))


def words_column(text: F.Column) -> F.Column:
    """The words of a text as an array: runs of characters other than BLANKS."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))
