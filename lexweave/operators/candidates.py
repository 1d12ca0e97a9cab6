"""The staging table of the two-stage filter: its views, its import and what reads full texts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import legal
from lexweave.operators import duplicates


def pipeline_view(candidates: DataFrame) -> DataFrame:
    """By status and source: count, means of score and confidence, oldest and newest."""
    return candidates.groupBy("status", "source").agg(
        F.count("*").alias("n"), F.round(F.avg("stage1_score"), 4).alias("mean_stage1"), F.round(F.avg("stage2_confidence"), 4).alias("mean_confidence"),
        F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"),
    )


def review_queue(candidates: DataFrame) -> DataFrame:
    """Candidates to review, surest first, then oldest, then by id."""
    return candidates.filter(F.col("status") == legal.REVIEW_REQUIRED).orderBy(F.desc("stage2_confidence"), "created_at", "id")


def full_text_row(df: DataFrame, text: str = "full_text_anonymized") -> DataFrame:
    """(id, title, full_text, sections, anonymization_applied): a sentence for a missing text, the sections as a struct."""
    names = ("leitsatz", "tenor", "tatbestand", "entscheidungsgruende")
    have = [F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names]
    full = F.coalesce(F.nullif(F.col(text), F.lit("")), F.lit("Kein Text verfügbar"))
    return df.select("id", "title", full.alias("full_text"), F.struct(*(c.alias(n) for c, n in zip(have, names, strict=True))).alias("sections"), "anonymization_applied")


def languages(df: DataFrame, first: int = 100, key: str = "id", language: str = "language") -> DataFrame:
    """Languages of the first rows by key, null as unknown."""
    return df.orderBy(key).limit(first).groupBy(F.coalesce(language, F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"))


def compliance_report(df: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """(source, n, anonymised, rate) of what was created in the days before."""
    recent = df.filter(F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{days}' DAY"))
    done = F.count_if("anonymization_applied")
    return recent.groupBy("source").agg(F.count("*").alias("n"), done.alias("anonymised"), F.round(100.0 * done / F.count("*"), 2).alias("rate"))


def successors(df: DataFrame, key: str = "id", to: str = "successor_id") -> DataFrame:
    """df with successor: the key of the row that replaces it, where that row is there."""
    return df.join(df.select(F.col(key).alias("successor")), F.col(to) == F.col("successor"), "left")


def any_equal(df: DataFrame, **values: object) -> DataFrame:
    """Rows of which at least one column has its value."""
    has = F.lit(False)
    for name, value in values.items():
        has = has | (F.col(name) == F.lit(value))
    return df.filter(F.coalesce(has, F.lit(False)))


def sampled(docs: DataFrame, text: str, terms: list[str], n: int, key: str = "id") -> DataFrame:
    """n rows by key of those that hold a term, filled up with the first others: one top-n, no second pass."""
    low, has = F.lower(F.col(text)), F.lit(False)
    for term in terms:
        has = has | low.contains(term.lower())
    return docs.orderBy(F.when(has, 0).otherwise(1), key).limit(n)


def imported(new: DataFrame, existing: DataFrame, relevance: Column, least: int = 3, keys: tuple[str, ...] = ("source", "source_id")) -> tuple[DataFrame, DataFrame]:
    """What an import adds, and one row of counters: processed, irrelevant, existing, imported.

    Both come from the same plan: rows are judged once, and nothing is written, so that a dry run takes the
    counters only.
    """
    judged = new.withColumn("__relevant", relevance >= least)
    known = existing.select(*keys).distinct().withColumn("__known", F.lit(True))
    judged = judged.join(known, list(keys), "left")
    fresh = judged.filter(F.col("__relevant") & F.col("__known").isNull()).drop("__relevant", "__known")
    added = duplicates.absent(fresh, existing.limit(0), *keys)
    repeated = F.count_if(F.col("__relevant") & F.col("__known").isNull()) - F.count_distinct(F.when(F.col("__relevant") & F.col("__known").isNull(), F.struct(*keys)))
    counters = judged.agg(
        F.count("*").alias("processed"), F.count_if(~F.col("__relevant")).alias("irrelevant"), (F.count_if(F.col("__relevant") & F.col("__known").isNotNull()) + repeated).alias("existing"),
    )
    return added, counters.withColumn("imported", F.col("processed") - F.col("irrelevant") - F.col("existing"))


def reevaluated(stored: DataFrame, candidates: DataFrame, config: legal.FilterConfig = legal.FilterConfig()) -> DataFrame:
    """candidates (id, stage1_score, stage2_confidence, status, created_at) with the states that the two-stage filter gives stored rows (with created_at) now; new ones are added with their own time."""
    columns = ["id", "stage1_score", "stage2_confidence", "status", "created_at"]
    states = legal.two_stage(stored, config).withColumnRenamed("confidence", "stage2_confidence").select(*columns)
    return duplicates.upserted(candidates.select(*columns), states, ("id",), ("stage1_score", "stage2_confidence", "status"))


def hits(df: DataFrame, matching: Column) -> DataFrame:
    """(total): how many rows match, whatever the page."""
    return total(df.filter(matching))


def total(found: DataFrame) -> DataFrame:
    """(total) of what a search found."""
    return found.agg(F.count("*").alias("total"))
