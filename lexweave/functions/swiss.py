"""Relevance, court and citations of Swiss decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.legal import FLAGS, gdpr_articles, weighted

# Fixed values: (weight, patterns); each weight counts once.
RELEVANCE = [
    (10, [r"\bDSG\b", r"\bFADP\b", r"Datenschutzgesetz", r"Bundesgesetz über den Datenschutz", r"Art\.?\s*\d+\s+DSG", r"Artikel\s+\d+\s+DSG", r"LPD", r"LFPD"]),
    (8, [r"\bDSGVO\b", r"\bGDPR\b", r"\bRGPD\b", r"EU-?Datenschutz", r"Privacy Shield", r"Angemessenheitsbeschluss"]),
    (7, [r"EDÖB", r"PFPDT", r"Datenschutzbeauftragter", r"Öffentlichkeitsbeauftragter"]),
    (6, [r"Auskunftsrecht", r"Löschung.*Daten", r"Berichtigung.*Daten", r"Datenportabilität", r"Widerspruchsrecht", r"Informationspflicht", r"droit d'accès", r"droit de rectification"]),
    (4, [r"Personendaten", r"données personnelles", r"besonders schützenswerte", r"Persönlichkeitsverletzung", r"Datensicherheit", r"Datenbearbeitung", r"traitement de données"]),
]
# Courts and the names that tell them in a text, in order.
COURTS = [("Bundesgericht", ["Bundesgericht", "Tribunal fédéral", "Tribunale federale"]), ("Bundesverwaltungsgericht", ["Bundesverwaltungsgericht", "Tribunal administratif fédéral"]), ("Bundesstrafgericht", ["Bundesstrafgericht", "Tribunal pénal fédéral"])]


def relevance(text: Column, title: Column, summary: Column, canton: Column, area: Column, court: Column) -> Column:
    """The weights over all fields, 3 for the federal court, 5 for a fitting area; at most 50."""
    every = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (text, title, summary, canton, area))))
    federal = F.coalesce(F.lower(court).rlike("bundesgericht|tribunal fédéral"), F.lit(False))
    fitting = F.coalesce(F.lower(area).rlike("datenschutz|persönlichkeit|privacy"), F.lit(False))
    return F.least(weighted(every, RELEVANCE) + F.when(federal, 3).otherwise(0) + F.when(fitting, 5).otherwise(0), F.lit(50))


def court_of(court: Column, text: Column, canton: Column) -> Column:
    """The given court, else the first that the text's first 500 characters name, else the canton's, else a general name."""
    head = F.substring(text, 1, 500)
    named = F.lit(None).cast("string")
    for name, signs in reversed(COURTS):
        has = F.lit(False)
        for sign in signs:
            has = has | head.contains(sign)
        named = F.when(has, name).otherwise(named)
    return F.coalesce(court, named, F.concat(F.lit("Kantonsgericht "), canton), F.lit("Schweizer Gericht"))


def references(text: Column, most: int = 10, whole_words: bool = True) -> Column:
    """Cited articles of the Swiss act and of the GDPR, distinct, sorted, the first ones.

    whole_words leaves longer abbreviations that begin like the act's, such as DSGVO, to the GDPR; without
    it, they count for both.
    """
    text = F.coalesce(text, F.lit(""))
    pattern = FLAGS + r"Art\.?\s*(\d+)\s+(?:DSG|FADP|LPD)" + (r"\b" if whole_words else "")
    own = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit("DSG Art. "), x))
    return F.slice(F.sort_array(F.array_distinct(F.concat(own, gdpr_articles(text)))), 1, most)
