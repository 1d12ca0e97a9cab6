"""What titles, texts and addresses of pages and requests tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles of decisions, whole words of them, and dates of a page in order.
DECISION_TITLES = [r"^[A-Z]+\s*\([A-Za-z]+\)\s*-\s*", r"^[A-Z]{2,}\s*-\s*[A-Z]?\d+", r"^\w+\s+court\s*-\s*"]
DECISION_WORDS = [
    "court", "gericht", "tribunal", "DPA", "DSB", "CNIL", "ICO", "AEPD", "Garante", "authority", "behörde", "commission",
    "BGH", "BVerfG", "BAG", "BVerwG", "OLG", "OVG", "VG", "LG", "AG", "VwGH", "OGH", "EuGH", "CJEU", "ECJ", "ECtHR",
]
PAGE_DATES = [r"Date of Decision:\s*(\d{1,2}[\s\-\.]\w+[\s\-\.]\d{4})", r"Decided on:\s*(\d{1,2}[\s\-\.]\w+[\s\-\.]\d{4})", r"(\d{1,2}[\s\-\.]\w+[\s\-\.]\d{4})"]
# Milliseconds that requests of a kind may take.
ALLOWED_MS = {"auth": 1000, "search": 500, "export": 5000, "admin": 2000, "crud": 300}
DEFAULT_MS = 500


def is_decision_page(title: Column) -> Column:
    """Whether a title begins like a decision's or has one of the words, in any case."""
    return title.rlike("(?iU)" + "|".join([*DECISION_TITLES, rf"\b(?:{'|'.join(DECISION_WORDS)})\b"]))


def page_date(text: Column) -> Column:
    """The date as written, by the first pattern that fits; null without one."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, f"(?iU){p}", 1), F.lit("")) for p in PAGE_DATES))


def document_type(title: Column) -> Column:
    """court_decision for titles that name a court, else dpa_decision."""
    return F.when(F.lower(title).contains("court"), "court_decision").otherwise("dpa_decision")


def document_type_of_court(court: Column) -> Column:
    """dpa_decision for a data protection authority, else court_decision."""
    return F.when(F.lower(court).contains("datenschutz"), "dpa_decision").otherwise("court_decision")


def endpoint_kind(path: Column, kinds: dict[str, list[str]]) -> Column:
    """The first kind of which a part stands in the path, else default."""
    out, low = F.lit("default"), F.lower(path)
    for kind, parts in reversed(kinds.items()):
        has = F.lit(False)
        for part in parts:
            has = has | low.contains(part)
        out = F.when(has, kind).otherwise(out)
    return out


def request_impact(status: Column, kind: Column, duration_ms: Column) -> Column:
    """high, medium or low by status, by how far the duration is above what the kind may take, and by kind."""
    allowed = F.lit(DEFAULT_MS)
    for name, ms in ALLOWED_MS.items():
        allowed = F.when(kind == name, ms).otherwise(allowed)
    return (
        F.when(status >= 500, "high")
        .when(status >= 400, "medium")
        .when(duration_ms > allowed * 3, "high")
        .when(duration_ms > allowed * 2, "medium")
        .when(kind.isin("auth", "search", "export"), "medium")
        .otherwise("low")
    )


# Words of task names by kind, in order, and the minutes that a task of a kind may take, and takes at worst.
TASK_WORDS = {
    "crawler": ["crawl", "scrape", "fetch", "collect"], "processing": ["process", "parse", "extract", "analyze"], "export": ["export", "generate", "create_report"],
    "maintenance": ["cleanup", "backup", "optimize", "maintenance"], "notification": ["send_email", "notify", "alert"],
}
TASK_MINUTES = {"crawler": (30, 60), "processing": (10, 30), "export": (5, 15), "maintenance": (60, 120), "notification": (2, 5), "default": (15, 45)}
TASK_IMPACT = {"crawler": "high", "processing": "high", "export": "medium", "maintenance": "low", "notification": "medium"}


def task_kind(name: Column) -> Column:
    """The first kind of which a word stands in the task's name, else default."""
    return endpoint_kind(name, TASK_WORDS)


def task_impact(kind: Column, state: Column, minutes: Column) -> Column:
    """high, medium or low: for what failed by its kind, else by how long it took, else by its kind."""
    most, worst, usual = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit("low")
    for name, (allowed, critical) in TASK_MINUTES.items():
        most, worst = F.when(kind == name, allowed).otherwise(most), F.when(kind == name, critical).otherwise(worst)
        usual = F.when(kind == name, TASK_IMPACT.get(name, "low")).otherwise(usual)
    failed = F.when(kind.isin("crawler", "processing"), "high").otherwise("medium")
    return F.when(state.isin("FAILURE", "REVOKED"), failed).when(minutes > worst, "high").when(minutes > most, "medium").otherwise(usual)
