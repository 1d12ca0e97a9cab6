"""Imports that count what they read, as they read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The column that holds a line which isn't a record.
BROKEN = "_broken"


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines of a file or folder, gzip ones too, with BROKEN set and all else null for lines that aren't records."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*schema.fields, StructField(BROKEN, StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)


def import_lines(spark: SparkSession, path: str, schema: StructType | str, target: str, relevance: Column | None = None, least: int = 3) -> dict[str, int]:
    """Append the relevant records of JSON lines to a Parquet folder; returns how many lines were read, malformed, irrelevant and kept.

    The counts come from the very pass that writes. Broken lines are never kept; without ``relevance``
    all others are.
    """
    whole = F.col(BROKEN).isNull()
    kept = whole if relevance is None else whole & F.coalesce(relevance >= least, F.lit(False))
    seen = Observation("import")
    counts = F.count("*").alias("read"), F.count_if(~whole).alias("malformed"), F.count_if(whole & ~kept).alias("irrelevant"), F.count_if(kept).alias("kept")
    read_lines(spark, path, schema).withColumn("__kept", kept).observe(seen, *counts).filter("__kept").drop("__kept", BROKEN).write.mode("append").parquet(target)
    return seen.get
