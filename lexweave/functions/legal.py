"""Citations, keywords, relevance scores and the two-stage filter, as native column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.scalars import let

# Citation patterns with groups article, paragraph, letter. In RANGE the groups are first and last.
ARTICLE_PATTERNS = [
    r"Art\.?\s*(\d+)\s*(?:Abs\.?\s*(\d+))?\s*(?:lit\.?\s*([a-z]))?\s*DSGVO",
    r"Artikel\s*(\d+)\s*(?:Absatz\s*(\d+))?\s*(?:Buchstabe\s*([a-z]))?\s*(?:der\s*)?DSGVO",
    r"Art\.?\s*(\d+)\s*(?:Abs\.?\s*(\d+))?\s*(?:lit\.?\s*([a-z]))?\s*DS-?GVO",
    r"Art\.?\s*(\d+)\s*\((\d+)\)\s*(?:\(([a-z])\))?\s*DSGVO",
    r"Art\.?\s*(\d+)\s*(?:Abs\.?\s*(\d+))?\s*(?:lit\.?\s*([a-z]))?\s*GDPR",
    r"Article\s*(\d+)\s*(?:\((\d+)\))?\s*(?:\(([a-z])\))?\s*GDPR",
    r"Art\.?\s*(\d+)(?:\s*,\s*\d+)*()()\s*DSGVO",
    r"Art\.?\s*(\d+)\s*([IVX]+)\s*(?:lit\.?\s*([a-z]))?\s*DSGVO",
    r"Art\.?\s*(\d+)\s*(?:Abs\.?\s*(\d+))?\s*(?:lit\.?\s*([a-z]))?\s*(?:der\s*)?Verordnung\s*\(EU\)\s*2016/679",
    r"Artikel\s*(\d+)\s*(?:Absatz\s*(\d+))?\s*(?:Buchstabe\s*([a-z]))?\s*der\s*Verordnung(?:\s*\(EU\)\s*2016/679)?",
]
RANGE = r"Art\.?\s*(\d+)\s*(?:bis|-|–)\s*(\d+)\s*DSGVO"
SECTION = r"§\s*(\d+)\s*(?:Abs\.?\s*(\d+))?\s*BDSG"
SECTIONS = r"§§\s*(\d+)\s*bis\s*(\d+)\s*BDSG"
# Keyword patterns, in order.
KEYWORD_PATTERNS = [
    r"\b(Einwilligung)\b", r"\b(Rechtsgrundlage)\b", r"\b(Verarbeitung)\b", r"\b(personenbezogene[nr]?\s+Daten)\b", r"\b(Verantwortliche[rn]?)\b",
    r"\b(Auftragsverarbeiter)\b", r"\b(Betroffene[rn]?)\b", r"\b(Datenschutzverstoß)\b", r"\b(Bußgeld)\b", r"\b(Schadensersatz)\b", r"\b(Löschung)\b",
    r"\b(Auskunft)\b", r"\b(Widerspruch)\b", r"\b(Datenübertragbarkeit)\b", r"\b(Profiling)\b", r"\b(automatisierte\s+Entscheidung)\b",
]
# Fixed values: (weight, patterns) of the case dump's relevance; each weight counts once.
RELEVANCE = [
    (10, [r"\bDSGVO\b", r"\bGDPR\b", r"Datenschutz-?Grundverordnung", r"Art\.?\s*\d+\s+DSGVO", r"Artikel\s+\d+\s+DSGVO", r"Verordnung\s*\(EU\)\s*2016/679", r"EU-?Datenschutz-?grundverordnung"]),
    (7, [r"personenbezogene(?:n)?\s+Daten", r"Betroffenenrechte", r"Datenschutzverstoß", r"Datenschutzverletzung", r"Verarbeitung.*personenbezogener.*Daten", r"Auftragsverarbeitung", r"Datenschutz-?Folgenabschätzung", r"Privacy\s*by\s*Design"]),
    (5, [r"\bBDSG-?neu\b", r"§\s*26\s+BDSG\b", r"§\s*\d+\s+BDSG\b", r"Bundesdatenschutzgesetz", r"\bBDSG\s*n\.?F\.?\b"]),
    (8, [r"Auskunftsrecht.*(?:personenbezogen|Daten)", r"Löschungsanspruch.*(?:personenbezogen|Daten)", r"Recht auf Vergessenwerden", r"Recht auf Berichtigung.*(?:personenbezogen|Daten)", r"Recht auf Datenübertragbarkeit", r"Datenportabilität", r"Widerspruchsrecht.*(?:Datenverarbeitung|personenbezogen)", r"Einschränkung der Verarbeitung.*(?:personenbezogen|Daten)"]),
    (6, [r"Bußgeld.*Datenschutz", r"Datenschutzbehörde", r"Aufsichtsbehörde.*Datenschutz", r"\bBfDI\b|\bLfDI\b|\bDSK\b", r"Datenschutzbeauftragter", r"Schadensersatz.*Datenschutz"]),
    (3, [r"Einwilligung.*Datenverarbeitung", r"Datenschutzerklärung", r"Informationspflicht.*(?:Daten|DSGVO|BDSG)", r"Zweckbindung.*(?:personenbezogen|Daten)", r"Datenminimierung", r"Transparenz.*Datenverarbeitung"]),
]
# Fixed values: (weight, patterns) of the two-stage filter's first stage.
STAGE1 = [
    (10, [r"\bDSGVO\b", r"\bGDPR\b", r"\bDatenschutz", r"EU-?Datenschutz", r"Verordnung.*2016/679", r"Art\.?\s*\d+\s+DSGVO", r"§\s*\d+\s+BDSG"]),
    (5, [r"personenbezogen", r"Betroffenenrecht", r"Datenschutzbehörde", r"Aufsichtsbehörde", r"Bußgeld.*Daten", r"Schadensersatz.*Daten"]),
    (2, [r"Verarbeitung.*Daten", r"Einwilligung", r"Lösch", r"Auskunft", r"Widerspruch", r"Datenübertrag", r"Transparenz"]),
    (7, [r"\bBfDI\b", r"\bLfDI\b", r"\bDSK\b", r"Landesbeauftragt.*Datenschutz", r"Datenschutzkonferenz"]),
]
# Patterns of the second stage, by category, and those that count against.
CONTEXT = [
    [r"Art(?:ikel)?\.?\s*(\d+)(?:\s*(?:Abs\.?|Absatz)\s*\d+)?\s*(?:DSGVO|GDPR|der Verordnung)", r"Artikel\s*(\d+)\s*der\s*(?:DSGVO|Datenschutz-?Grundverordnung)"],
    [r"(?:Bußgeld|Geldbuße|Strafe).*?(?:EUR|Euro|€)\s*[\d.,]+", r"Schadensersatz.*?(?:EUR|Euro|€)\s*[\d.,]+", r"(?:Unterlassung|Löschung|Sperrung).*?(?:angeordnet|verpflichtet)"],
    [r"(?:Verarbeitung|Erhebung|Speicherung).*?personenbezogen.*?Daten", r"Daten(?:schutz)?.*?(?:Verstoß|Verletzung|Vorfall)", r"(?:rechtswidrig|unbefugt|ohne Einwilligung).*?(?:verarbeitet|erhoben|gespeichert)"],
    [r"Recht\s*auf.*?(?:Auskunft|Löschung|Berichtigung|Widerspruch)", r"Betroffene.*?(?:informier|benachrichtig|aufgeklärt)", r"(?:Einwilligung|Zustimmung).*?(?:fehlt|ungültig|widerrufen)"],
]
AGAINST = [r"Widerspruchsrecht(?!.*?(?:Daten|DSGVO|personenbezogen))", r"Informationspflicht(?!.*?(?:Daten|DSGVO|Art\.))", r"Transparenz(?!.*?(?:Daten|Verarbeitung))"]
CONTEXT_TERMS = ["personenbezogen", "datenschutz", "dsgvo", "verarbeitung"]
TENOR_TERMS = ["datenschutz", "dsgvo", "personenbezogen", "bußgeld"]

#: Unicode case and classes, and \n as the only line end.
FLAGS = "(?iUd)"


def literal(pattern: str) -> str:
    """The longest run of letters, in lower case, that every match of the pattern holds; empty where none is sure."""
    if re.search(r"\|", re.sub(r"\([^()]*\)", "", pattern)):  # alternatives
        return ""
    sure = re.sub(r"\[[^\]]*\][*+?]?|\\[bsdwW.][*+?]?", " ", re.sub(r"\((?:[^()]|\([^()]*\))*\)[*+?]?", " ", pattern))
    return max(re.findall(r"[^\W\d_]+(?![^\W\d_]*[?*])", sure, re.UNICODE), key=len, default="").lower()


def _parts(pattern: str) -> tuple[list[str], list[tuple[str, str]]]:
    """The alternatives of a pattern outside of its groups, and its outermost groups with the sign that follows each."""
    parts, groups, depth, begin, start, at = [], [], 0, 0, 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[":
            at = pattern.index("]", at)
        elif c == "(":
            start, depth = (at if depth == 0 else start), depth + 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                groups.append((pattern[start + 1 : at], pattern[at + 1 : at + 2]))
        elif c == "|" and depth == 0:
            parts.append(pattern[begin:at])
            begin = at + 1
        at += 1
    return [*parts, pattern[begin:]], groups


def needed(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of texts in lower case: every match of the pattern holds one of each set. None where nothing is sure."""

    def sets(part: str) -> list[tuple[str, ...]]:
        own = part.lower() if re.fullmatch(r"[^\W\d_]+(?: [^\W\d_]+)*", part) else literal(part)
        inner = [needed(g.removeprefix("?:")) for g, after in _parts(part)[1] if after not in ("?", "*", "{") and (g.startswith("?:") or not g.startswith("?"))]
        return sorted({*([(own,)] if own else []), *(x for found in inner for x in found)}, key=lambda x: (-min(map(len, x)), x))  # those that rarely hold come first

    parts = [sets(part) for part in _parts(pattern)[0]]
    if len(parts) == 1:
        return tuple(parts[0])
    return (tuple(dict.fromkeys(w for part in parts for w in part[0])),) if all(parts) else ()


def _may(low: Column, sets: tuple[tuple[str, ...], ...]) -> Column:
    """Whether a lower-cased text may hold a match; the long s and the dotted I are letters to patterns that stay or fall apart in lower-cased texts."""
    if not sets:
        return F.lit(True)
    any_of = lambda words: reduce(lambda a, b: a | b, (low.contains(word) for word in words))
    return reduce(lambda a, b: a & b, map(any_of, sets)) | low.contains("\u017f") | low.contains("i\u0307")


def found(text: Column, *patterns: str, flags: str = FLAGS, low: Column | None = None) -> Column:
    """Whether any of the patterns matches. Where matches hold one of some words, the text is searched for these first, in ``low``, its lower-cased form."""
    low = F.lower(text) if low is None else low
    guarded: dict[tuple, list[str]] = {}
    for pattern in patterns:
        guarded.setdefault(needed(pattern) if flags == FLAGS else (), []).append(pattern)
    out = F.lit(False)
    for sets, group in guarded.items():
        out = out | _may(low, sets) & text.rlike(flags + "|".join(f"(?:{p})" for p in group))
    return out


def _groups(text: Column, pattern: str, n: int) -> Column:
    """For each match an array of its groups. The text is looked through once; groups are taken from the short matches."""

    def parts(match: Column) -> Column:
        return F.struct(*(F.regexp_extract(match, FLAGS + pattern, k + 1).alias(f"g{k}") for k in range(n)))

    return F.transform(F.regexp_extract_all(text, F.lit(FLAGS + pattern), F.lit(0)), parts)


def article_name(article: Column, paragraph: Column, letter: Column) -> Column:
    """Art. N[ Abs. P][ lit. x] DSGVO; empty parts are left out."""
    return F.concat(F.lit("Art. "), article, F.when(paragraph != "", F.concat(F.lit(" Abs. "), paragraph)).otherwise(""), F.when(letter != "", F.concat(F.lit(" lit. "), letter)).otherwise(""), F.lit(" DSGVO"))


def gdpr_articles(text: Column) -> Column:
    """All cited articles, distinct and sorted by code point; ranges stay ranges."""
    text = F.coalesce(text, F.lit(""))
    lists = [F.transform(_groups(text, p, 3), lambda m: article_name(m["g0"], m["g1"], m["g2"])) for p in ARTICLE_PATTERNS]
    lists.append(F.transform(_groups(text, RANGE, 2), lambda m: F.concat(F.lit("Art. "), m["g0"], F.lit("-"), m["g1"], F.lit(" DSGVO"))))
    return F.sort_array(F.array_distinct(F.concat(*lists)))


def bdsg_sections(text: Column) -> Column:
    """All cited sections, with ranges written out, distinct and sorted."""
    text = F.coalesce(text, F.lit(""))
    one = F.transform(_groups(text, SECTION, 2), lambda m: F.concat(F.lit("§ "), m["g0"], F.when(m["g1"] != "", F.concat(F.lit(" Abs. "), m["g1"])).otherwise(""), F.lit(" BDSG")))
    first, last = (lambda m: m["g0"].cast("long")), (lambda m: m["g1"].cast("long"))
    many = F.flatten(F.transform(F.filter(_groups(text, SECTIONS, 2), lambda m: first(m) <= last(m)), lambda m: F.transform(F.sequence(first(m), last(m)), lambda k: F.concat(F.lit("§ "), k.cast("string"), F.lit(" BDSG")))))
    return F.sort_array(F.array_distinct(F.concat(one, many)))


def keywords(text: Column) -> Column:
    """The first match of each keyword pattern, in the patterns' order, distinct."""
    text = F.coalesce(text, F.lit(""))
    hits = [F.regexp_extract(text, FLAGS + p, 1) for p in KEYWORD_PATTERNS]
    return F.array_distinct(F.array_remove(F.array(*hits), ""))


def weighted(text: Column, weights: list[tuple[int, list[str]]], most: int = 50, low: Column | None = None) -> Column:
    """The sum of the weights of which a pattern matches, up to ``most``; ``low`` is the lower-cased text where that is at hand."""
    total = F.lit(0)
    for weight, patterns in weights:
        total = total + F.when(found(text, *patterns, low=low), weight).otherwise(0)
    return F.least(total, F.lit(most))


def relevance(*fields: Column) -> Column:
    """The case dump's relevance over its fields, nulls as empty."""
    low = F.lower(F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in fields)))
    return let(low, lambda x: weighted(x, RELEVANCE, low=x))


# The states of a candidate.
PENDING_STAGE1, PENDING_STAGE2, APPROVED, REJECTED, IMPORTED, REVIEW_REQUIRED = "pending_stage1", "pending_stage2", "approved", "rejected", "imported", "review_required"


@dataclass(frozen=True)
class FilterConfig:
    """Thresholds of the two-stage filter."""

    least_stage1: int = 2
    approved_from: float = 80.0
    review_from: float = 50.0
    use_context: bool = True
    use_structure: bool = True
    use_metadata: bool = True


def stage1_keywords(text: Column, low: Column | None = None) -> Column:
    """Up to ten first matches, of up to 50 characters, in the patterns' order; ``low`` as for found()."""
    low = F.lower(text) if low is None else low
    hits = [F.when(_may(low, needed(p)), F.substring(F.regexp_extract(text, f"{FLAGS}({p})", 1), 1, 50)).otherwise("") for _, patterns in STAGE1 for p in patterns]
    return F.slice(F.array_distinct(F.array_remove(F.array(*hits), "")), 1, 10)


def context_score(content: Column, words: Column, low: Column | None = None) -> Column:
    """20 for each category of context, less 10 for each pattern against, 5 for each of five keywords with a context term within 200 characters; up to 100, without a floor."""
    low, score = F.lower(content) if low is None else low, F.lit(0.0)
    for patterns in CONTEXT:
        score = score + F.when(found(content, *patterns, low=low), 20.0).otherwise(0.0)
    for pattern in AGAINST:
        score = score - F.when(found(content, pattern, low=low), 10.0).otherwise(0.0)

    def near(word: Column) -> Column:
        def window(at: Column) -> Column:
            start = F.greatest(F.lit(0), at - 1 - 200)
            return F.when(at > 0, F.call_function("substring", low, start + 1, at - 1 + F.length(word) + 200 - start))

        def has(text: Column) -> Column:
            out = F.lit(False)
            for term in CONTEXT_TERMS:
                out = out | text.contains(term)
            return out

        # each value once: a lambda works out what it names as often as it names it
        return let(let(F.call_function("locate", F.lower(word), low), window), has)

    return F.least(score + 5.0 * F.size(F.filter(F.slice(words, 1, 5), near)), F.lit(100.0))


def structure_score(content: Column, low: Column | None = None) -> Column:
    """40 for a tenor that concerns data protection, 10 each for headnote and reasons, 5 for a remedy."""
    low = F.lower(content) if low is None else low

    def about(tenor: Column) -> Column:
        has = F.lit(False)
        for term in TENOR_TERMS:
            has = has | tenor.contains(term)
        return has

    tenor = F.lower(F.regexp_extract(content, r"(?isUd)<h[1-4]>.*?Tenor.*?</h[1-4]>(.*?)(?:<h[1-4]>|$)", 1))
    return (
        F.when(found(content, r"<h[1-4]>.*?Tenor.*?</h[1-4]>", low=low) & let(tenor, about), 40.0).otherwise(0.0)
        + F.when(found(content, r"Leitsatz|Orientierungssatz", low=low), 10.0).otherwise(0.0)
        + F.when(found(content, r"<h[1-4]>.*?(?:Gründe|Entscheidungsgründe).*?</h[1-4]>", low=low), 10.0).otherwise(0.0)
        + F.when(found(content, r"Rechtsmittel|Revision|Berufung|Beschwerde", low=low), 5.0).otherwise(0.0)
    )


def metadata_score(court: Column, case_number: Column, decision_date: Column, title: Column) -> Column:
    """Authority 50, else administrative court 20; docket 30; date from 2018-05-25 10; title 20; up to 100."""
    court, title = F.lower(F.coalesce(court, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    any_of = lambda col, *terms: col.rlike("|".join(terms))
    return F.least(
        F.when(any_of(court, "datenschutz", "bfdi", "lfdi"), 50.0).when(any_of(court, "verwaltungsgericht", "vg", "ovg", "vgh"), 20.0).otherwise(0.0)
        + F.when(found(F.coalesce(case_number, F.lit("")), "DSB|BfDI|LfDI|DSGVO"), 30.0).otherwise(0.0)
        + F.when(decision_date >= F.lit("2018-05-25").cast("timestamp_ntz"), 10.0).otherwise(0.0)
        + F.when(any_of(title, "datenschutz", "dsgvo", "gdpr", "personenbezogen"), 20.0).otherwise(0.0),
        F.lit(100.0),
    )


def confidence(stage1: Column, context: Column, structure: Column, metadata: Column) -> Column:
    return F.least(stage1 / 50.0 * 100 * 0.2 + context * 0.4 + structure * 0.2 + metadata * 0.2, F.lit(100.0))


def two_stage(df: DataFrame, config: FilterConfig = FilterConfig(), title: str = "title", content: str = "content", court: str = "court", case_number: str = "case_number", decision_date: str = "decision_date") -> DataFrame:
    """df with stage1_score, context_score, structure_score, metadata_score, confidence, status and rejection_reason.

    Texts that fail the first stage are rejected there and have no scores of the second. The reason is
    null for what isn't rejected.
    """
    text = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in (title, content, court)))
    # columns of their own, so that each is worked out once
    out = df.withColumns({"__text": text, "__body": F.coalesce(F.col(content), F.lit(""))}).withColumns({"__low": F.lower("__text"), "__low_body": F.lower("__body")})
    text, low, body, low_body = (F.col(c) for c in ("__text", "__low", "__body", "__low_body"))
    out = out.withColumn("stage1_score", weighted(text, STAGE1, low=low)).withColumn("stage1_keywords", stage1_keywords(text, low))
    passed = F.col("stage1_score") >= config.least_stage1
    parts = {
        "context_score": context_score(body, F.col("stage1_keywords"), low_body) if config.use_context else F.lit(0.0),
        "structure_score": structure_score(body, low_body) if config.use_structure else F.lit(0.0),
        "metadata_score": metadata_score(F.col(court), F.col(case_number), F.col(decision_date), F.col(title)) if config.use_metadata else F.lit(0.0),
    }
    for name, part in parts.items():
        out = out.withColumn(name, F.when(passed, part))
    out = out.withColumn("confidence", F.when(passed, confidence(F.col("stage1_score"), F.col("context_score"), F.col("structure_score"), F.col("metadata_score"))).otherwise(0.0))
    status = F.when(~passed, REJECTED).when(F.col("confidence") >= config.approved_from, APPROVED).when(F.col("confidence") >= config.review_from, REVIEW_REQUIRED).otherwise(REJECTED)
    low = F.concat(F.lit("Stage 1 Score zu niedrig: "), F.col("stage1_score").cast("string"))
    unsure = F.concat(F.lit("Confidence zu niedrig: "), F.format_number("confidence", 1), F.lit("%"))
    return out.withColumn("status", status).withColumn("rejection_reason", F.when(~passed, low).when(F.col("status") == REJECTED, unsure)).drop("__text", "__low", "__body", "__low_body")


def pass_rates(filtered: DataFrame, least_stage1: int = 2) -> DataFrame:
    """Share in per cent that pass the first stage, are approved of those, and overall; and the review queue's size."""
    total, first, good = F.count("*"), F.count_if(F.col("stage1_score") >= least_stage1), F.count_if(F.col("status") == APPROVED)
    share = lambda a, b: F.round(100.0 * a / F.greatest(b, F.lit(1)), 2)
    return filtered.agg(share(first, total).alias("stage1_rate"), share(good, first).alias("approval_rate"), share(good, total).alias("overall_rate"), F.count_if(F.col("status") == REVIEW_REQUIRED).alias("review"))
