"""Written stages and joins on hot keys, for operators of several steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, and from so many rows; at most 1 / SHARE keys are.
SHARE, LEAST = 1 / 1000, 1000

_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder below the one that the cluster shares (spark.checkpoint.dir); in local mode without one, a temporary folder."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="lexweave-")
        base = _local[app]
    return f"{base.rstrip('/')}/{app}"


_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run within go as soon as it ends."""
    before = spark.conf.get(_CLEANED)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANED, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back: lineage ends at files that a lost executor doesn't take along. Its shuffle files go at once."""
    return appended([df], name)


def appended(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Frames of one schema, written one after the other as one table and read back: each one's shuffle files go before the next begins."""
    path = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        with cleaned(spark):
            df.write.mode("append").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table.written_to = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has one row for each key and in ``weight`` how many rows of left that key has.

    The rows of hot keys stay where they are, as the few rows of right that they need are sent to all
    tasks: with weights that sum up to ``total``, at most 1 / SHARE. All others are shuffled by key.
    """
    is_hot = F.col(weight) >= max(LEAST, total * SHARE)
    hot, cold = right.filter(is_hot).drop(weight), right.filter(~is_hot).drop(weight)
    usual = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return left.join(F.broadcast(hot), key).unionByName(usual)
