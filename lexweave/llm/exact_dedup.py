"""Exact deduplication against a persistent digest index, with built-in functions only.

The index is a table of one row per distinct text: its SHA-256 digest, the document that stays, the
group's size and the batch that brought it. It is bucketed and sorted by digest, so a new batch is
compared by a sort-merge anti-join that moves the batch's digests but never the index, and what is new
is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.shared import ROW, forget, hot_join, keep_rows, lower_ascii, numbered, saved


class DigestIndex:
    """A bucketed table (digest, keep_id, keep_row, group_size, batch).

    ``path`` may name a folder; a later session registers it again by giving the same path and
    number of buckets. Without it, the table lives in the warehouse.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(table):
            spark.sql(
                f"CREATE TABLE {table} (digest BINARY, keep_id BIGINT, keep_row BIGINT, group_size BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS" + (f" LOCATION '{path}'" if path else "")
            )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame) -> None:
        """Append groups whose digests the index lacks."""
        (
            groups.select("digest", "keep_id", "keep_row", "group_size", "batch")
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)

    def drop(self) -> None:
        """Drop the table, of which nothing may be read any more."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _digest() -> Column:
    return F.unhex(F.sha2(lower_ascii(F.col("text").cast("string")).cast("binary"), 256))


def _add(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Append the digests of rows, a written table (doc_id, digest, ROW), that the index lacks.

    Returns each digest of rows with its last row and its size there, as a written table.
    """
    groups = saved(
        rows.groupBy("digest")
        .agg(F.max(F.struct(F.col("doc_id").cast("long").alias("doc_id"), ROW)).alias("last"), F.count("*").alias("group_size"))
        .select("digest", F.col("last.doc_id").alias("keep_id"), F.col(f"last.{ROW}").alias("keep_row"), "group_size", F.lit(batch).alias("batch")),
        "digest-groups",
    )
    index.append(groups.join(index.read().select("digest").hint("merge"), "digest", "left_anti"))
    return groups


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Compare docs (doc_id, text, ...) with the index and among themselves; append what is new.

    Texts, of any length, are equal when they agree after lower-casing A-Z; null counts as the empty
    text. Of equal texts that the index lacks, the row with the largest doc_id stays; a null doc_id is
    smaller than any other, and of repeated rows with one doc_id exactly one stays. A text that an
    earlier batch brought is dropped, the very same row delivered again included. ``batch`` names the
    batch: giving the name again with the same docs repeats a batch that failed half-way, with the
    results that it would have had. Returns every row of docs with ``digest``, ``keep_id``,
    ``group_size`` (rows of this text in the batch that brought it) and ``kept``; columns of docs with
    these names are replaced, all others stay. An empty table gives an empty result.
    """
    batch = batch or uuid.uuid4().hex
    docs = numbered(docs)
    own = {"digest", "keep_id", "group_size", "kept"}
    rest = [c for c in docs.columns if c.lower() not in own]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), ROW)
    rows = saved(rows, "digests")
    groups = _add(rows, index, batch)
    known = index.read().select("digest", "keep_id", "keep_row", F.col("group_size").alias("size"), F.col("batch").alias("by"))
    mine = saved(groups.select("digest", F.col("group_size").alias("weight")).join(known.hint("merge"), "digest"), "digest-known")
    judged = hot_join(rows, mine, "digest", "weight", rows.count())
    judged = judged.select(ROW, "digest", "keep_id", F.col("size").alias("group_size"), ((F.col("by") == batch) & (F.col("keep_row") == F.col(ROW))).alias("kept"))
    return docs.select(*(F.col(f"`{c}`") for c in rest)).join(judged, ROW).drop(ROW)


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) without the rows that deduplicate drops; all columns stay as they are.

    Nulls, empty and very long texts, ties and repeated rows are treated as there: null and empty texts
    are one group, of which one row stays. Without an index, a table of this call's own is used and
    dropped. An empty table gives an empty table.
    """
    docs, batch = numbered(docs), batch or uuid.uuid4().hex
    own = index or DigestIndex(docs.sparkSession, f"digest_index_{uuid.uuid4().hex}")
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), ROW), "digests")
    groups = _add(rows, own, batch)
    known = own.read().select("digest", "keep_row", F.col("batch").alias("by")).hint("merge")
    kept = saved(groups.select("digest").join(known, "digest").filter(F.col("by") == batch).select(F.col("keep_row").alias(ROW)), "digest-kept")
    forget(rows, groups)
    if index is None:
        own.drop()
    return keep_rows(docs, kept)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays, the group's size and the text's digest.

    The documents come in two deliveries, those with larger ids first, so that the second one meets
    the first in the index and the largest doc_id of equal texts stays over both.
    """
    docs = numbered(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), ROW), "digests")
    middle = rows.agg(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    first = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
    groups = [_add(part, index, name) for name, part in (("first", rows.filter(first)), ("second", rows.filter(~first)))]
    sizes = groups[0].unionByName(groups[1]).groupBy("digest").agg(F.sum("group_size").alias("weight"))
    named = saved(sizes.join(index.read().select("digest", "keep_id", "keep_row").hint("merge"), "digest"), "digest-named")
    forget(*groups)
    index.drop()
    found = hot_join(rows, named, "digest", "weight", rows.count())
    return found.select("doc_id", "keep_id", F.col("weight").alias("group_size"), (F.col("keep_row") == F.col(ROW)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
