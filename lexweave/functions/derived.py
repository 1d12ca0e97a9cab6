"""Values derived from several fields: titles, keywords, identities, states, findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions import legal

# Short words that are no keywords, and court types by code, in order.
STOP_WORDS = ["der", "die", "das", "und", "oder", "vom", "am", "im"]
COURT_TYPES = [("BGH", "Bundesgerichtshof"), ("OLG", "Oberlandesgericht"), ("LG", "Landgericht"), ("AG", "Amtsgericht")]
RELEVANT_TERMS = ["dsgvo", "gdpr", "datenschutz-grundverordnung", "art. 6 dsgvo", "art. 7 dsgvo", "personenbezogene daten"]
# Signs of an attack in a request's path, in order.
ATTACKS = [
    ("sql_injection", ["union select", "drop table", "1=1", "or 1=1"]),
    ("xss_attempt", ["<script", "javascript:", "onerror="]),
    ("path_traversal", ["../", "..\\"]),
    ("command_injection", ["|", ";", "&&", "`"]),
]
# What must not be left in an anonymised text.
RESIDUALS = {"email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "phone": r"(\+49|0)[1-9]\d{1,14}", "insurance": r"\b\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{2}\b"}


def _any(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def title(court: Column, kind: Column, docket: Column, date: Column) -> Column:
    """Court, type, (docket) and vom date, as far as they are filled; else a default."""
    some = lambda c: F.nullif(c, F.lit(""))
    out = F.concat_ws(" ", some(court), some(kind), F.concat(F.lit("("), some(docket), F.lit(")")), F.concat(F.lit("vom "), some(date)))
    return F.when(out == "", "Unbenannte Entscheidung").otherwise(out)


def keywords(title: Column, court: Column, articles: Column) -> Column:
    """Up to ten of: five longer words of the title, the court's type, and the first three articles."""
    words = F.slice(F.filter(F.split(F.coalesce(title, F.lit("")), r"\s+"), lambda w: (F.length(w) > 3) & ~F.lower(w).isin(STOP_WORDS)), 1, 5)
    kind = F.lit(None).cast("string")
    for code, name in reversed(COURT_TYPES):
        kind = F.when(court.contains(code), name).otherwise(kind)
    cited = F.transform(F.slice(articles, 1, 3), lambda a: F.concat(F.lit("Art. "), a, F.lit(" DSGVO")))
    own = F.when(F.size(articles) > 0, F.concat(F.array(F.lit("DSGVO")), cited)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(words, F.array_compact(F.array(kind)), own)), 1, 10)


def relevant(articles: Column, text: Column) -> Column:
    """Has articles, or a term in its text."""
    return F.coalesce(F.size(articles) > 0, F.lit(False)) | _any(F.lower(F.coalesce(text, F.lit(""))), RELEVANT_TERMS)


def fallback_id(title: Column, date: Column) -> Column:
    """MD5 of title and date, for sources without ids."""
    return F.md5(F.concat(F.coalesce(title, F.lit("")), F.lit("_"), F.coalesce(date, F.lit(""))).cast("binary"))


def first_date(*fields: Column) -> Column:
    """The first field that is a date with time, a day with dots or a day with hyphens."""
    def one(c: Column) -> Column:
        return F.coalesce(F.try_to_timestamp(F.regexp_replace(c, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(c, F.lit("dd.MM.yyyy")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")

    return F.coalesce(*map(one, fields))


def attack(path: Column) -> Column:
    """The first kind of attack that the path looks like, else null."""
    low, out = F.lower(path), F.lit(None).cast("string")
    for kind, signs in reversed(ATTACKS):
        out = F.when(_any(low, signs), kind).otherwise(out)
    return out


def security_event(status: Column) -> Column:
    return F.when(status.isin(401, 403), "authentication_failure").when(status == 429, "rate_limit_exceeded")


def duration_priority(duration: Column, slow: float = 1000, critical: float = 5000) -> Column:
    return F.when(duration > critical, "critical").when(duration > slow, "medium").otherwise("info")


def duration_type(duration: Column, slow: float = 1000) -> Column:
    return F.when(duration > slow, "performance_degradation").otherwise("system_metric")


def residuals(text: Column) -> Column:
    """Which kinds of personal data are left in a text."""
    return F.array_compact(F.array(*(F.when(text.rlike(pattern), name) for name, pattern in RESIDUALS.items())))


def promoted(status: Column) -> Column:
    """The state after the first stage: only from pending_stage1."""
    return F.when(status == legal.PENDING_STAGE1, legal.PENDING_STAGE2).otherwise(status)


def decided(status: Column, confidence: Column) -> Column:
    """The state after the second stage: only from pending_stage2."""
    result = F.when(confidence >= 80, legal.APPROVED).when(confidence >= 50, legal.REVIEW_REQUIRED).otherwise(legal.REJECTED)
    return F.when(status == legal.PENDING_STAGE2, result).otherwise(status)
