"""Predicates, projections, sorting and pages over decisions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.schema import all_of

SORTABLE = ("decision_date", "created_at", "updated_at", "title", "court", "source", "quality_score")
MOST_PER_PAGE = 100


@dataclass
class DecisionFilter:
    """Conditions that are all to hold; None or empty leaves one out."""

    source: str | None = None
    sources: list[str] = field(default_factory=list)
    court: str | None = None
    courts: list[str] = field(default_factory=list)
    article: str | None = None
    articles: list[str] = field(default_factory=list)
    date_from: date | datetime | None = None
    date_to: date | datetime | None = None
    has_anonymization: bool | None = None
    has_pdf: bool | None = None
    keyword: str | None = None

    def __post_init__(self) -> None:
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from lies after date_to")

    def condition(self) -> Column:
        c = F.col
        parts = [
            c("source") == self.source if self.source else None,
            c("source").isin(self.sources) if self.sources else None,
            contains_any_case(c("court"), self.court) if self.court else None,
            any_court(self.courts) if self.courts else None,
            F.array_contains("gdpr_articles", self.article) if self.article else None,
            F.arrays_overlap("gdpr_articles", F.array(*map(F.lit, self.articles))) if self.articles else None,
            c("decision_date") >= F.lit(self.date_from) if self.date_from else None,
            c("decision_date") <= F.lit(self.date_to) if self.date_to else None,
            c("anonymization_applied") == self.has_anonymization if self.has_anonymization is not None else None,
            c("pdf_extracted") == self.has_pdf if self.has_pdf is not None else None,
            contains_any_case(c("title"), self.keyword) | F.array_contains("keywords", self.keyword) if self.keyword else None,
        ]
        return all_of([p for p in parts if p is not None])

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.condition())


def contains_any_case(col: Column, part: str) -> Column:
    """The part, in which % and _ match as in LIKE, stands anywhere in the column, in any case."""
    return col.ilike(f"%{part}%")


def any_court(courts: list[str]) -> Column:
    found = contains_any_case(F.col("court"), courts[0])
    for court in courts[1:]:
        found = found | contains_any_case(F.col("court"), court)
    return found


def since(col: str, as_of: datetime, days: int) -> Column:
    """The column lies within the days before as_of, or after it."""
    return F.col(col) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{days}' DAY")


def at_least_priority(col: str, least: str) -> Column:
    ranks = ("info", "low", "medium", "high", "critical")
    if least not in ranks:
        raise ValueError(f"unknown priority {least}")
    return F.col(col).isin(list(ranks[ranks.index(least) :]))


def sorted_by(df: DataFrame, column: str = "decision_date", descending: bool = True, tie: str = "id") -> DataFrame:
    """Sort as PostgreSQL does: nulls first when descending, last when ascending; ties by the key."""
    if column not in SORTABLE:
        raise ValueError(f"can't sort by {column}")
    order = F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(order, F.col(tie))


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """The rows of a page from 1 on, with total, pages, has_next and has_prev.

    The rows come from a top-k by the order; the total from a count beside it.
    """
    if number < 1 or not 1 <= size <= MOST_PER_PAGE:
        raise ValueError("page or size out of bounds")
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    pages = F.ceil(F.col("total") / size)
    return rows.withColumn("total", total.scalar()).withColumn("pages", pages).withColumn("has_next", F.lit(number) < pages).withColumn("has_prev", F.lit(number > 1))


def api_row(df: DataFrame) -> DataFrame:
    """The columns that a listing shows, null arrays as empty ones."""
    empty = F.array().cast("array<string>")
    return df.select("id", "source", "source_id", "title", "court", "case_number", "decision_date", F.coalesce("gdpr_articles", empty).alias("gdpr_articles"), F.coalesce("keywords", empty).alias("keywords"), "anonymization_applied", "pdf_extracted", "quality_score")


def export_row(df: DataFrame, *more: Column) -> DataFrame:
    """The columns of the CSV export, and any more."""
    yes = lambda c: F.when(F.col(c), "Ja").otherwise("Nein")
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    return df.select(
        "id", "title", "court", "case_number", "source",
        F.date_format("decision_date", "yyyy-MM-dd").alias("date"),
        joined("gdpr_articles").alias("articles"),
        joined("keywords").alias("keywords"),
        F.concat(F.substring("leitsatz", 1, 200), F.lit("...")).alias("headnote"),
        yes("anonymization_applied").alias("anonymized"),
        yes("pdf_extracted").alias("pdf"),
        *more,
    )


#: The CSV export's columns, by the names of export_row and of the decisions.
CSV_NAMES = {
    "id": "ID", "case_number": "Aktenzeichen", "title": "Titel", "court": "Gericht", "date": "Datum", "articles": "DSGVO-Artikel",
    "keywords": "Keywords", "headnote": "Leitsatz", "source": "Quelle", "source_url": "URL", "anonymized": "Anonymisiert",
}


def csv_row(df: DataFrame, *more: Column) -> DataFrame:
    """The CSV export's columns under their own names, and any more, in the order of df; no address gives an empty one."""
    url = F.coalesce(F.col("source_url"), F.lit("")) if "source_url" in df.columns else F.lit("")
    rows = export_row(df, url.alias("source_url"), *more)
    return rows.select(*(F.col(name).alias(shown) for name, shown in CSV_NAMES.items()), *rows.columns[len(rows.columns) - len(more) :])


# The columns of the export for administrators.
ADMIN_NAMES = ("id", "title", "court", "case_number", "decision_date", "source", "quality_score", "anonymization_applied", "created_at")


def admin_row(df: DataFrame) -> DataFrame:
    """The nine columns of the export for administrators, as they are stored."""
    return df.select(*ADMIN_NAMES)


# Sources, and the lengths that a search text may have.
KNOWN_SOURCES = ("openlegaldata", "gdprhub", "ris", "manual", "swiss")
QUERY_LENGTHS = (3, 200)


def checked_query(query: str) -> str:
    """A search text without signs that could be markup or statements; raises where it is too short or too long."""
    clean = re.sub(r"[<>;\"'`\\\\]", "", query).strip()
    if not QUERY_LENGTHS[0] <= len(clean) <= QUERY_LENGTHS[1]:
        raise ValueError(f"a query has {QUERY_LENGTHS[0]} to {QUERY_LENGTHS[1]} characters")
    return clean


def checked_sources(sources: list[str]) -> list[str]:
    """The names in lower case; raises for one that isn't known."""
    names = [s.strip().lower() for s in sources]
    if unknown := [s for s in names if s not in KNOWN_SOURCES]:
        raise ValueError(f"unknown source: {', '.join(unknown)}")
    return names


def checked_dates(first: str | None, last: str | None) -> tuple[date | None, date | None]:
    """Two ISO dates; raises for other forms and where the last is before the first."""
    a, b = (None if d is None else date.fromisoformat(d) for d in (first, last))
    if a and b and b < a:
        raise ValueError("the last date is before the first")
    return a, b
