"""Similar titles by an exact join.

Two titles of the ratio t (twice the matched signs over all signs) share at least t / 2 of their signs as
bags, so the join runs on bags: signs are numbered (the third e is e3), ordered by rarity, and only
the first n - ceil(t / (2 - t) * n) + 1 of each title are joined, as two bags with enough in common share
one of these. Length and position filters, the count of common signs and the ratio itself follow. None of
them loses a pair.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.scalars import court_code, let, normalized
from lexweave.stages import written

#: Fixed value: least similarity of titles.
TITLE_FROM = 0.85
#: Titles of a bucket that one task takes.
TASK_ROWS = 20_000


def bag(text: Column) -> Column:
    """The signs of a text, numbered among their equals."""
    signs = F.sort_array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    return let(signs, lambda s: F.transform(s, lambda c, i: F.concat(c, (i - F.array_position(s, c) + 1).cast("string"))))


def titles_once(df: DataFrame) -> DataFrame:
    """(kind, title, norm, id) of df (id, title, court): each title of a court type once as it stands, so that it is normalised once, with its smallest id."""
    rows = df.select("id", "title", court_code(F.col("court")).alias("kind")).filter("kind IS NOT NULL AND title IS NOT NULL")
    once = rows.groupBy("kind", "title").agg(F.min("id").alias("id"))
    return once.select("kind", "title", normalized(F.col("title")).alias("norm"), "id").filter("norm <> ''")


def distinct_titles(titles: DataFrame) -> DataFrame:
    """(kind, norm, id) of what titles_once gives: each normalised title of a court type once, with its smallest id."""
    return titles.groupBy("kind", "norm").agg(F.min("id").alias("id"))


def bag_pairs(titles: DataFrame, least: float = TITLE_FROM) -> DataFrame:
    """(a, b, x, y, shared), a < b: titles (kind, norm, id) of one kind whose bags have ``least`` / 2 of all signs in common."""
    bags = titles.select("kind", "id", "norm", bag(F.col("norm")).alias("bag"))
    often = bags.select(F.explode("bag").alias("sign")).groupBy("sign").agg(F.count("*").alias("c"))
    ranked = bags.select("kind", "id", F.explode("bag").alias("sign")).join(often, "sign").groupBy("kind", "id").agg(F.sort_array(F.collect_list(F.struct("c", "sign"))).alias("s"))
    n = F.size("s")
    first = F.slice("s", 1, n - F.ceil(n * (least / (2 - least)) - 1e-9).cast("int") + 1)
    entries = ranked.select("kind", "id", n.alias("n"), F.posexplode(first).alias("at", "s")).select("kind", "id", "n", "at", "s.sign")
    large = entries.groupBy("kind", "sign").agg(F.count("*").alias("rows")).filter(F.col("rows") > TASK_ROWS)
    sized = entries.join(large, ["kind", "sign"], "left").withColumn("parts", F.ceil(F.coalesce("rows", F.lit(1)) / TASK_ROWS).cast("int"))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
    copied = sized.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    enough = f"{least / 2} * (l.n + r.n) - 1e-9"
    fits = f"l.kind = r.kind AND l.sign = r.sign AND l.part = r.part AND l.id < r.id AND least(l.n, r.n) >= {enough} AND least(l.n - l.at, r.n - r.at) >= {enough}"
    pairs = dealt.alias("l").join(copied.alias("r"), F.expr(fits)).select(F.col("l.kind").alias("kind"), F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    for c, text in (("a", "x"), ("b", "y")):
        pairs = pairs.join(bags.select("kind", F.col("id").alias(c), F.col("norm").alias(text), F.col("bag").alias(f"bag_{c}")), ["kind", c])
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    return pairs.withColumn("shared", shared).filter(shared >= least / 2 * (F.size("bag_a") + F.size("bag_b")) - 1e-9).select("a", "b", "x", "y", "shared")


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, x, y) -> (a, b, similarity): the larger ratio of both directions, as the matching depends on them."""
    for batch in batches:
        got = [max(difflib.SequenceMatcher(None, x, y).ratio(), difflib.SequenceMatcher(None, y, x).ratio()) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got, pa.float64())], ["a", "b", "similarity"])


def title_pairs(df: DataFrame, least: float = TITLE_FROM) -> DataFrame:
    """(a, b, similarity), a < b: decisions (id, title, court) of one court type whose normalised titles are similar.

    Of equal titles of a court type the smallest id stands for all. Titles without words and courts
    of no known type have no pairs; an empty table has none.
    """
    return pairs_among(written(distinct_titles(titles_once(df)), "titles"), least)


def pairs_among(titles: DataFrame, least: float = TITLE_FROM) -> DataFrame:
    """title_pairs of a written table that distinct_titles gives."""
    pairs = bag_pairs(titles, least).select("a", "b", "x", "y")
    ids = pairs.schema
    kinds = f"a {ids['a'].dataType.simpleString()}, b {ids['b'].dataType.simpleString()}, similarity double"
    return pairs.mapInArrow(_ratios, kinds).filter(F.col("similarity") >= least)
