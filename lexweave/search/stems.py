"""German stems as column expressions, by the published Snowball rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.scalars import let

# Vowels, and the letters after which the endings s and st go.
VOWELS = "aeiouyäöü"
BEFORE_S, BEFORE_ST = "bdfghklmnrt", "bdfghklmnt"


def _marked(word: Column) -> Column:
    """struct<w, r1, r2>: u and y between vowels in capitals, as they count as consonants, and where the regions begin."""
    w = F.regexp_replace(F.lower(word), "ß", "ss")
    for c in "uy":
        w = F.regexp_replace(w, f"(?<=[{VOWELS}]){c}(?=[{VOWELS}])", c.upper())

    def regions(w: Column) -> Column:
        step = f"[^{VOWELS}]*+[{VOWELS}]++[^{VOWELS}]"
        ends = [F.length(F.regexp_extract(w, f"^(?:{step}){{{k}}}", 0)) for k in (1, 2)]
        first, second = (F.when(n > 0, n).otherwise(F.length(w)) for n in ends)
        return F.struct(w.alias("w"), F.greatest(first, F.lit(3)).alias("r1"), second.alias("r2"))

    return let(w, regions)


def _ending(word: Column, *endings: str) -> Column:
    """The longest of the endings, or empty."""
    return F.regexp_extract(word, f"({'|'.join(sorted(endings, key=len, reverse=True))})$", 1)


def _without(word: Column, n: Column | int) -> Column:
    return F.substr(word, F.lit(1), F.length(word) - n)


def _step(x: Column, endings: tuple[str, ...], region: str, cut) -> Column:
    """x with cut(word, ending) in place of its word where one of the endings lies in the region."""
    def apply(e: Column) -> Column:
        inside = (e != "") & (F.length(x["w"]) - F.length(e) >= x[region])
        return F.struct(F.when(inside, cut(x["w"], e)).otherwise(x["w"]).alias("w"), x["r1"].alias("r1"), x["r2"].alias("r2"))

    return let(_ending(x["w"], *endings), apply)


def _first(w: Column, e: Column) -> Column:
    rest = _without(w, F.length(e))
    niss = F.when(rest.endswith("niss"), _without(rest, 1)).otherwise(rest)
    return F.when(e.isin("em", "ern", "er"), rest).when(e == "s", F.when(rest.rlike(f"[{BEFORE_S}]$"), rest).otherwise(w)).otherwise(niss)


def _second(w: Column, e: Column) -> Column:
    rest = _without(w, F.length(e))
    return F.when(e != "st", rest).when(rest.rlike(f"...[{BEFORE_ST}]$"), rest).otherwise(w)


def _third(x: Column) -> Column:
    """The derivational endings, which may leave another one to go."""
    def cut(w: Column, e: Column) -> Column:
        rest = _without(w, F.length(e))
        n = F.length(rest)
        ig = F.when(rest.rlike("[^e]ig$") & (n - 2 >= x["r2"]), _without(rest, 2)).otherwise(rest)
        er = F.when(rest.rlike("(er|en)$") & (n - 2 >= x["r1"]), _without(rest, 2)).otherwise(rest)
        lich = F.when(rest.endswith("lich") & (n - 4 >= x["r2"]), _without(rest, 4)).when(rest.endswith("ig") & (n - 2 >= x["r2"]), _without(rest, 2)).otherwise(rest)
        plain = F.when(rest.endswith("e"), w).otherwise(rest)
        return F.when(e.isin("end", "ung"), ig).when(e.isin("ig", "ik", "isch"), plain).when(e == "keit", lich).otherwise(er)

    return _step(x, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"), "r2", cut)


def stemmed(word: Column) -> Column:
    """The stem of a German word, lower-cased and without umlauts."""
    one = lambda x: _step(x, ("em", "ern", "er", "e", "en", "es", "s"), "r1", _first)
    two = lambda x: _step(x, ("en", "er", "est", "st"), "r1", _second)
    return let(let(let(let(_marked(word), one), two), _third), lambda x: F.translate(x["w"], "UYäöü", "uyaou"))
