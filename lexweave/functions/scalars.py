"""Smaller text and value functions as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Court codes in the order in which they are looked for in the upper-cased name.
COURT_CODES = ["BGH", "BVerfG", "BVerwG", "BSG", "BAG", "BFH", "OLG", "OVG", "LSG", "LAG", "FG", "LG", "VG", "SG", "ArbG", "AG"]
# Which source is preferred as master of duplicates.
SOURCE_PRIORITY = {"manual": 4, "gdprhub": 3, "openlegaldata": 2, "ris": 1}
# Finality patterns, first match counts.
FINALITY = [
    ("rechtskraeftig", r"rechtskräftig|ist\s+rechtskräftig|Rechtskraft\s+eingetreten|bestandskräftig"),
    ("berufung_moeglich", r"Berufung\s+(?:ist\s+)?zulässig|kann\s+Berufung\s+eingelegt\s+werden|Rechtsmittel(?:belehrung)?"),
    ("berufung_eingelegt", r"Berufung\s+(?:wurde\s+)?eingelegt|hat\s+Berufung\s+eingelegt|Berufungsverfahren\s+anhängig"),
    ("aufgehoben", r"(?:wurde\s+)?aufgehoben|Aufhebung\s+(?:der|des)|hebt\s+auf"),
    ("vergleich", r"Vergleich\s+geschlossen|haben\s+sich\s+verglichen|Prozessvergleich"),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def normalized(text: Column) -> Column:
    """Lower case, everything but word characters and blanks a blank, blanks squeezed, trimmed."""
    clean = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(clean, r"(?U)\s+", " "))


def content_hash(text: Column, chars: int = 5000) -> Column:
    """MD5 of the normalised first characters."""
    return F.md5(normalized(F.substring(text, 1, chars)).cast("binary"))


def text_hash(text: Column) -> Column:
    """SHA-256 of the text, empty for an empty or null one."""
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.sha2(text.cast("binary"), 256))


def court_code(court: Column, strict: bool = False) -> Column:
    """The first code in the upper-cased name, else null. strict looks for codes as words, in their own case."""
    out = F.lit(None).cast("string")
    for code in reversed(COURT_CODES):
        out = F.when(court.rlike(rf"\b{code}\b") if strict else F.upper(court).contains(code), code).otherwise(out)
    return out


def source_priority(source: Column) -> Column:
    out = F.lit(0)
    for name, priority in SOURCE_PRIORITY.items():
        out = F.when(source == name, priority).otherwise(out)
    return out


def completeness(weights: dict[str, int], text: str | None = None) -> Column:
    """The weights of filled columns, and a point for each full 1,000 characters of the text."""
    total = F.lit(0)
    for name, weight in weights.items():
        total = total + F.when(F.coalesce(F.length(F.col(name).cast("string")), F.lit(0)) > 0, weight).otherwise(0)
    return total + F.coalesce(F.floor(F.length(text) / 1000), F.lit(0)).cast("int") if text else total


def finality(text: Column) -> Column:
    out = F.lit("unbekannt")
    for name, pattern in reversed(FINALITY):
        out = F.when(text.rlike(f"(?iUd){pattern}"), name).otherwise(out)
    return out


def fine_eur(text: Column) -> Column:
    """The first amount in euro as a whole number, without its separators."""
    before = F.regexp_extract(text, r"(?iU)(?:EUR|€)\s*([\d][\d.,]*)", 1)
    after = F.regexp_extract(text, r"(?iU)([\d][\d.,]*)\s*(?:EUR|Euro|€)", 1)
    amount = F.when(before != "", before).otherwise(after)
    return F.regexp_replace(amount, "[.,]", "").try_cast("long")


def title_parts(title: Column) -> Column:
    """(authority, country, case) of a title like Authority (Country) - Case; nulls where it isn't one."""
    pattern = r"^(.+?)\s*\(([^)]+)\)\s*-\s*(.+)$"
    ok = title.rlike(pattern)
    return F.struct(*(F.when(ok, F.regexp_extract(title, pattern, k)).alias(n) for k, n in ((1, "authority"), (2, "country"), (3, "case"))))


def language(text: Column) -> Column:
    """de if der, die or das stands anywhere, also within a word; else en."""
    low = F.lower(text)
    return F.when(low.contains("der") | low.contains("die") | low.contains("das"), "de").otherwise("en")


def source_bucket(source: Column) -> Column:
    low = F.lower(source)
    return F.when(low.contains("gdprhub"), "gdprhub").when(low.contains("openlegaldata"), "openlegaldata").otherwise("andere")


def shortened(text: Column, most: int) -> Column:
    """The text, or its first characters and three dots, at most so long."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def parsed_date(text: Column) -> Column:
    """The first of four date formats that fits, after cutting a time zone offset."""
    cut = F.split_part(text, F.lit("+"), F.lit(1))
    cut = F.regexp_replace(cut, "Z$", "")
    formats = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd", "dd.MM.yyyy"]
    return F.coalesce(*(F.try_to_timestamp(cut, F.lit(f)) for f in formats)).cast("timestamp_ntz")


def normal_url(url: Column) -> Column:
    """The URL with only its title parameter; without one, without any."""
    base = F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    title = F.call_function("try_parse_url", url, F.lit("QUERY"), F.lit("title"))
    return F.when(title.isNotNull(), F.concat(base, F.lit("?title="), title)).otherwise(base)


def last_path_part(url: Column) -> Column:
    return F.regexp_extract(F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), r"([^/]+)/?$", 1)


# What wrongly decoded signs stand for, in order.
MOJIBAKE = {"Ã¼": "ü", "Ã¶": "ö", "Ã¤": "ä", "Ãœ": "Ü", "Ã–": "Ö", "Ã„": "Ä", "ÃŸ": "ß", "â€™": "'", "â€œ": '"', "â€": '"', 'â€"': "—"}


def clean_text(text: Column) -> Column:
    """Wrongly decoded umlauts and quotes mended, control characters out, blanks squeezed, at most one empty line."""
    for wrong, right in MOJIBAKE.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n"))


def field_name(name: str) -> str:
    """A column name for a CSV header: lower case, blanks and hyphens as underscores."""
    return "".join("_" if c in " -" else c for c in name.strip().lower())


def typed(value: Column) -> Column:
    """(bool, int, float, text) of a CSV value: the first type that fits is set; empty and null-like values set none."""
    low = F.lower(F.trim(value))
    none = value.isNull() | low.isin("", "null", "none", "n/a")
    as_bool = F.when(~none & low.isin("true", "false"), low == "true")
    as_int = F.when(~none & as_bool.isNull(), value.try_cast("long"))
    as_float = F.when(~none & as_bool.isNull() & as_int.isNull(), value.try_cast("double"))
    return F.struct(as_bool.alias("bool"), as_int.alias("int"), as_float.alias("float"), F.when(~none & as_bool.isNull() & as_int.isNull() & as_float.isNull(), value).alias("text"))


def masked_sql(statement: Column) -> Column:
    """The statement with literals masked, at most 500 characters."""
    out = F.regexp_replace(statement, r"'[^']*'", "'?'")
    return F.substring(F.regexp_replace(out, r"\b\d+\b", "?"), 1, 500)


def sql_kind(statement: Column) -> Column:
    up = F.upper(F.trim(statement))
    out = F.lit("other")
    for kind in ("DROP", "ALTER", "CREATE", "DELETE", "UPDATE", "INSERT", "SELECT"):
        out = F.when(up.startswith(kind), kind.lower()).otherwise(out)
    return out


def resource_status(value: Column, warn: float, critical: float, low_is_bad: bool = False) -> Column:
    worse = (lambda limit: value < limit) if low_is_bad else (lambda limit: value > limit)
    return F.when(worse(critical), "critical").when(worse(warn), "warning").otherwise("healthy")


def overall_status(*states: Column) -> Column:
    """unhealthy if one of the states is critical, else degraded if one is a warning, else healthy."""
    every = F.array(*states)
    return F.when(F.array_contains(every, "critical"), "unhealthy").when(F.array_contains(every, "warning"), "degraded").otherwise("healthy")
