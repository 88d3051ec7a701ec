"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is not set, a temporary one is made and set with a local master; elsewhere it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tomespark-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def kept(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; where there is none yet, it is made beside it and renamed when it is whole."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        beside = f"{path}.{uuid.uuid4().hex}"
        make().write.parquet(beside)
        # Another job may have been first; then its table is as good.
        if not fs.exists(place) and not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), place):
            raise RuntimeError(f"could not rename {beside}")
    return spark.read.parquet(path)


#: Rows of a table of words that is told to every task; a longer one is joined by a shuffle.
TOLD = 1_000_000


def told(table: DataFrame, most: int | None = None) -> tuple[DataFrame, bool]:
    """A small table to be joined where the other rows lie, and whether it is one: it was counted to have at most TOLD rows."""
    small = table.limit((TOLD if most is None else most) + 1).count() <= (TOLD if most is None else most)
    return (F.broadcast(table) if small else table), small


def written(df: DataFrame, name: str) -> DataFrame:
    """A frame that is read more than once, written to the shared folder."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tomespark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
