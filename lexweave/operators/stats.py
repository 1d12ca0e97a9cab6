"""Aggregations over decisions: rankings, timelines, article and court statistics, co-occurrence."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.filters import since

#: Court types in the order in which their codes are looked for. Fixed values.
COURT_GROUPS = ["BGH", "BVerwG", "BAG", "BFH", "BSG", "OLG", "LG", "AG", "VG", "OVG"]


def group_count(df: DataFrame, key: str | Column, name: str, top: int | None = None, keep_null: bool = True) -> DataFrame:
    """Rows by key, most first, ties by key."""
    key = F.col(key) if isinstance(key, str) else key
    counted = df.select(key.alias(name))
    counted = (counted if keep_null else counted.filter(F.col(name).isNotNull())).groupBy(name).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.col(name).asc_nulls_last()).limit(top) if top else counted


def element_count(df: DataFrame, arrays: str, name: str, top: int | None = None) -> DataFrame:
    """Occurrences of array elements, most first, ties by element."""
    return group_count(df.select(F.explode(arrays).alias(name)), name, name, top)


def by_year(df: DataFrame, top: int = 10) -> DataFrame:
    years = df.filter("decision_date IS NOT NULL").groupBy(F.year("decision_date").alias("year")).agg(F.count("*").alias("n"))
    return years.orderBy(F.desc("year")).limit(top)


def timeline(df: DataFrame, unit: str = "month", iso_year: bool = False) -> DataFrame:
    """Decisions, courts and sources by day, week, month, quarter or year.

    A week is written as calendar year and ISO week, so the last days of December can come under
    week 01 of their own year; iso_year uses the year of the week.
    """
    date = F.col("decision_date")
    week_year = F.expr("extract(YEAROFWEEK FROM decision_date)") if iso_year else F.year(date)
    periods = {
        "day": F.date_format(date, "yyyy-MM-dd"),
        "week": F.format_string("%04d-%02d", week_year.cast("int"), F.weekofyear(date)),
        "month": F.date_format(date, "yyyy-MM"),
        "quarter": F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string")),
        "year": F.year(date).cast("string"),
    }
    if unit not in periods:
        raise ValueError(f"unknown unit {unit}")
    return df.filter(date.isNotNull()).groupBy(periods[unit].alias("period")).agg(F.count("*").alias("n"), F.countDistinct("court").alias("courts"), F.countDistinct("source").alias("sources"))


def article_statistics(df: DataFrame, most_courts: int = 5) -> DataFrame:
    """By article: decisions, courts, sources, first and last date, and the first courts by name."""
    rows = df.select("id", "court", "source", "decision_date", F.explode("gdpr_articles").alias("article"))
    courts = F.sort_array(F.collect_set("court"))
    by = rows.groupBy("article").agg(
        F.countDistinct("id").alias("decisions"), F.countDistinct("court").alias("courts"), F.countDistinct("source").alias("sources"),
        F.min("decision_date").alias("first_date"), F.max("decision_date").alias("last_date"), courts.alias("names"),
    )
    return by.withColumn("names", truncated("names", most_courts))


def truncated(arrays: str, most: int) -> Column:
    """At most so many elements, then one that tells how many more there are."""
    size = F.size(arrays)
    return F.when(size > most, F.concat(F.slice(arrays, 1, most), F.array(F.format_string("... und %d weitere", size - most)))).otherwise(F.col(arrays))


def co_occurrence(df: DataFrame, arrays: str = "gdpr_articles", top: int | None = 20) -> DataFrame:
    """Pairs of elements that stand in one array, the smaller first.

    The pairs are made from each row's array, so there is no join; repeated elements count as often.
    """
    a = F.col(arrays)
    pairs = F.flatten(F.transform(a, lambda x: F.transform(F.filter(a, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    counted = df.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("first"), F.col("p.b").alias("second")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "first", "second").limit(top) if top else counted


def court_statistics(df: DataFrame, top: int = 50, most_articles: int = 5) -> DataFrame:
    """By court: decisions, sources, dates, share anonymised, first articles by name."""
    rows = df.filter("court IS NOT NULL")
    base = rows.groupBy("court").agg(
        F.count("*").alias("decisions"), F.countDistinct("source").alias("sources"), F.min("decision_date").alias("first_date"), F.max("decision_date").alias("last_date"),
        F.round(F.avg(F.coalesce(F.col("anonymization_applied").cast("int"), F.lit(0))), 4).alias("anonymized"),
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set("gdpr_articles")))), 1, most_articles).alias("articles"),
    )
    return base.orderBy(F.desc("decisions"), "court").limit(top)


def court_group(court: Column) -> Column:
    """The first code that stands in the name, else Andere; AG also takes LAG and BAG's like, VG also OVG."""
    found = F.lit("Andere")
    for code in reversed(COURT_GROUPS):
        found = F.when(court.contains(code), code).otherwise(found)
    return found


def court_groups(df: DataFrame, most: int = 5) -> DataFrame:
    """By court type: courts, decisions, and the courts with most decisions."""
    by_court = df.filter("court IS NOT NULL").groupBy("court").agg(F.count("*").alias("n")).withColumn("kind", court_group(F.col("court")))
    order = Window.partitionBy("kind").orderBy(F.desc("n"), "court")
    ranked = by_court.withColumn("rank", F.row_number().over(order))
    top = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "court")))), lambda x: x["court"])
    return ranked.groupBy("kind").agg(F.count("*").alias("courts"), F.sum("n").alias("decisions"), F.array_join(top, "|").alias("top"))


def summary(df: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Eight figures in one scan."""
    total = F.count("*")
    share = lambda c: F.round(100.0 * F.count_if(c) / F.greatest(total, F.lit(1)), 1)
    return df.agg(
        total.alias("total"),
        F.countDistinct("court").alias("courts"),
        F.countDistinct("source").alias("sources"),
        F.count_if(since("created_at", as_of, days)).alias("recent"),
        share(F.coalesce(F.col("anonymization_applied"), F.lit(False))).alias("anonymized_share"),
        share(F.coalesce(F.size("gdpr_articles") > 0, F.lit(False))).alias("article_share"),
        F.min("decision_date").alias("first_date"),
        F.max("decision_date").alias("last_date"),
    )


def dedup_statistics(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.countDistinct("case_number").alias("unique_cases")).withColumn("duplicates", F.col("total") - F.col("unique_cases"))


def quality_view(df: DataFrame) -> DataFrame:
    """By source: rows, filled columns, mean quality and rows with articles."""
    return df.groupBy("source").agg(
        F.count("*").alias("n"), F.count("court").alias("with_court"), F.count("decision_date").alias("with_date"),
        F.round(F.avg("quality_score"), 6).alias("quality"), F.count_if(F.coalesce(F.size("gdpr_articles") > 0, F.lit(False))).alias("with_articles"),
    )


def coverage(df: DataFrame) -> DataFrame:
    """Share of rows, in per cent, in which each column is filled."""
    filled = lambda c: F.round(100.0 * F.count(c) / F.greatest(F.count("*"), F.lit(1)), 2)
    return df.agg(*(filled(c).alias(f"{c}_filled") for c in ("court", "decision_date", "gdpr_articles", "leitsatz", "tenor")))


def latest_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key: the first by the order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__rank = 1").drop("__rank")


def score_histogram(df: DataFrame, score: str) -> DataFrame:
    """By score, highest first: rows, their share, and the share of rows with this score or more."""
    by = df.groupBy(score).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    upper = F.sum("n").over(Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0))
    return by.select(score, "n", F.round(100.0 * F.col("n") / total, 4).alias("share"), F.round(100.0 * upper / total, 4).alias("share_upper"))


def facets(matched: DataFrame, top: int = 10) -> DataFrame:
    """(facet, value, n): the most frequent sources, courts and articles of the matched decisions, in one shuffle."""
    arms = F.concat(
        F.array(F.struct(F.lit("source").alias("facet"), F.col("source").alias("value")), F.struct(F.lit("court").alias("facet"), F.col("court").alias("value"))),
        F.transform(F.coalesce("gdpr_articles", F.array().cast("array<string>")), lambda x: F.struct(F.lit("article").alias("facet"), x.alias("value"))),
    )
    counted = matched.select(F.explode(arms).alias("f")).select("f.*").filter("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).drop("rank")


def suggestions(df: DataFrame, start: str, top: int = 10, articles: int = 5) -> DataFrame:
    """Different keywords that begin with start, in any case; where start speaks of articles, the most cited ones as well."""
    found = df.select(F.explode("keywords").alias("keyword")).filter(F.lower("keyword").startswith(start.lower())).distinct().orderBy("keyword").limit(top)
    if "art" in start.lower():
        cited = element_count(df, "gdpr_articles", "keyword", articles).select("keyword")
        found = found.unionByName(cited).distinct()
    return found.orderBy("keyword").limit(top)


def quality_metrics(df: DataFrame, text: str, metadata: list[str], score: Column) -> DataFrame:
    """One row: how many rows, the mean length of their texts, how many per cent of the metadata are filled, and the mean of a score of the texts."""
    filled = sum((F.count(c) for c in metadata), F.lit(0))
    return df.agg(F.count("*").alias("total"), F.round(F.avg(F.length(text)), 4).alias("mean_length"), F.round(100.0 * filled / (len(metadata) * F.count("*")), 2).alias("metadata_completeness"), F.round(F.avg(F.when(F.col(text).isNotNull(), score)), 4).alias("mean_score"))
