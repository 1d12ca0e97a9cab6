"""Benchmark passages in documents, by spaced-seed hashing.

Fixed masks pick some positions of a window of words and ignore the others, so a window still
matches where ignored words were replaced. The hashes of all windows of the test items are joined
with those of all windows of the documents; each hit puts an item at an offset of a document. Offsets
with enough hits are compared word by word around the hits: an item is found if enough of its words
stand in place, or if a stretch of it does, wherever that lies in the item and the document. A stretch
scores one for each word in place and loses GAP for each other; the best one decides.

The masks are all of three words within five places. Let m of an item's n words stand in place. The
m - 2 runs of three such words next to each other span 2 (n - 2) places at most, taken together, and
two at least each; so at least m - 2 - 2 (n - m) / 3 of them lie within five places, which is more than
0 from SHARE and LEAST on. Each is a hit of one mask, whichever words were replaced. In a stretch of
score STRETCH, at least STRETCH - 2 of such runs do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.shared import ROW, numbered, saved, small_batches
from lexweave.llm.words import NOT_ALNUM, hashed, mix

#: Positions that count (1) and that are ignored (0).
MASKS = ("111", "1101", "1011", "11001", "10101", "10011")
#: An item is found where this share of its words, and at least LEAST of them, stand in place.
SHARE, LEAST = 0.5, 8
#: Or where a stretch of it scores so much, with so much lost for each word that isn't in place.
STRETCH, GAP = 30, 2
#: Bits of the filter that skips windows which no item has: 16 for each of the items' hashes, within these bounds (4 MB at most).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 25
SHIFTS = (0, 20, 40)
#: So many rows of test hashes may be broadcast; more take a shuffle join.
MOST_BROADCAST = 1_000_000


def _windows(words: np.ndarray, bounds: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that lie within one text, and their hashes."""
    span = len(mask)
    if len(words) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(words) - span + 1
    acc = np.full(n, int(mask, 2) + (span << 32), np.uint64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1":
                acc = acc + words[k : k + n] * (mix(np.array([k + 1], np.uint64))[0] | np.uint64(1))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.flatnonzero(text[:n] == text[span - 1 :])
    return start, mix(acc[start])


def _passed(bits: np.ndarray, start: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows whose three bits are all set."""
    for shift in SHIFTS:
        bit = (hashes >> np.uint64(shift)) & np.uint64(8 * len(bits) - 1)
        keep = np.flatnonzero((bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
        start, hashes = start[keep], hashes[keep]
    return start, hashes


def _items(batches: Iterator[pa.RecordBatch], masks: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) -> (item_id, n, words, hits of (pos, hash))"""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("hash", pa.int64())]))
    for batch in batches:
        for at, words, bounds in hashed(batch.column("text"), NOT_ALNUM):
            for i in range(len(bounds) - 1):
                own = words[bounds[i] : bounds[i + 1]]
                hits = []
                if len(own):
                    here = masks if len(own) >= max(map(len, masks)) else [m for m in masks if len(m) <= len(own)] or ["1" * len(own)]
                    for mask in here:
                        start, h = _windows(own, np.array([0, len(own)]), mask)
                        hits += [{"pos": int(p), "hash": int(x)} for p, x in zip(start, h.view(np.int64), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id")[at + i : at + i + 1], pa.array([len(own)], pa.int32()), pa.array([own.view(np.int64)], pa.list_(pa.int64())), pa.array([hits], kind)],
                    ["item_id", "n_words", "item_words", "hits"],
                )


def _documents(batches: Iterator[pa.RecordBatch], masks: tuple[str, ...], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(ROW, text) -> (ROW, hits) of texts with a window that the filter lets through."""
    for batch in batches:
        for at, words, bounds in hashed(batch.column("text"), NOT_ALNUM):
            found_at, found = [], []
            for mask in masks:
                start, h = _windows(words, bounds, mask)
                start, h = _passed(bits, start, h)
                found_at.append(start)
                found.append(h)
            starts, hashes = np.concatenate(found_at), np.concatenate(found)
            if not len(starts):
                continue
            text = np.searchsorted(bounds, starts, "right") - 1
            order = np.argsort(text, kind="stable")
            starts, hashes, text = starts[order], hashes[order], text[order]
            docs, first = np.unique(text, return_index=True)
            first = np.append(first, len(text))
            hits = pa.StructArray.from_arrays([pa.array((starts - bounds[text]).astype(np.int32)), pa.array(hashes.view(np.int64))], ["pos", "hash"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW).take(pa.array(at + docs)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), hits)],
                [ROW, "hits"],
            )


def _doc_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ROW, doc_id, text) -> (ROW, doc_id, doc_words)"""
    for batch in batches:
        for at, words, bounds in hashed(batch.column("text"), NOT_ALNUM):
            own = pa.LargeListArray.from_arrays(pa.array(bounds.astype(np.int64)), pa.array(words.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(ROW).slice(at, len(own)), batch.column("doc_id").slice(at, len(own)), own], [ROW, "doc_id", "doc_words"])


def find_passages(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """Items (item_id, text) that stand in docs (doc_id, text): ROW, doc_id, item_id, n_words, matched, stretch, first_word, share.

    Words are runs of letters and digits (any non-ASCII character counts as a letter), A-Z
    lower-cased. A row means that at one offset at least ``share`` of the item's words, and at least
    ``least`` of them or all of a shorter item, equal the document's words in place (matched), or that
    the best stretch of the item there scores STRETCH or more (stretch: the words in place less GAP for
    each other between them). The offset with the most words in place is given, the first on ties (it is
    negative where the document starts within the item). Repeated rows of docs are reported each;
    repeated rows of an item once, by item_id and words. With MASKS, nothing is missed from a share of
    0.5 and a least of 8 words on. Words put in or left out split an item over two offsets, of which each
    counts alone. Null or empty texts, and items without words, are never reported; an item of a few
    words is found wherever all of them stand, so leave out items too short to tell. Null item_ids are
    reported as null. Texts of any length are taken whole. Other columns are ignored. Empty tables give
    an empty result.
    """
    return _find(numbered(docs), items, masks, share, least)


def _find(docs: DataFrame, items: DataFrame, masks: tuple[str, ...], share: float, least: int) -> DataFrame:
    spark = docs.sparkSession
    kind = "array<struct<pos:int,hash:bigint>>"
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    tests = tests.mapInArrow(lambda it: _items(it, masks), f"item_id bigint, n_words int, item_words array<bigint>, hits {kind}").filter("n_words > 0").distinct()
    tests = saved(tests.withColumn("item", F.xxhash64("item_id", "item_words")), "items")
    # fewest hits that an item that is found has at its offset
    wanted = F.ceil(F.least(F.col("n_words").cast("double"), F.greatest(F.lit(float(least)), F.lit(share) * F.col("n_words"))))
    enough = F.least(F.lit(STRETCH - 2), F.greatest(F.lit(1), F.ceil((5 * wanted - 2 * F.col("n_words") - 6) / 3))) if set(masks) == set(MASKS) else F.lit(1)
    hashes = tests.select("item", enough.cast("int").alias("enough"), F.explode("hits").alias("t")).select("item", "enough", F.col("t.pos").alias("item_pos"), F.col("t.hash").alias("hash"))
    # items have no more words than hashes, so this bounds both tables
    n_hashes = hashes.count()
    small = F.broadcast if n_hashes <= MOST_BROADCAST else (lambda x: x)
    # a Bloom filter over the items' hashes, put together by Spark: one row for each byte that is not 0
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n_hashes).bit_length()))
    bit = F.explode(F.array(*(F.shiftrightunsigned("hash", k).bitwiseAND(F.lit(size - 1)) for k in SHIFTS))).alias("bit")
    filled = hashes.select(bit).groupBy(F.shiftright("bit", 3).alias("at")).agg(F.bit_or(F.expr("1 << cast(bit & 7 as int)")).alias("byte")).toPandas()
    bits = np.zeros(size >> 3, np.uint8)
    bits[filled["at"].to_numpy()] = filled["byte"].to_numpy()
    lengths = [r[0] for r in tests.filter(f"n_words < {min(map(len, masks))}").select("n_words").distinct().collect()]  # fewer than a mask has places
    every = (*masks, *("1" * n for n in lengths))

    texts = docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(bits)
    found = texts.select(ROW, "text").mapInArrow(lambda it: _documents(it, every, shared.value), f"{ROW} bigint, hits {kind}")
    seeds = found.select(ROW, F.explode("hits").alias("h")).select(ROW, F.col("h.pos").alias("doc_pos"), F.col("h.hash").alias("hash"))
    places = seeds.join(small(hashes), "hash").groupBy(ROW, "item", (F.col("doc_pos") - F.col("item_pos")).alias("offset")).agg(F.count("*").alias("c"), F.first("enough").alias("enough"))
    places = saved(places.filter("c >= enough").select(ROW, "item", "offset"), "seed-places")
    shared.destroy()
    rows = places.select(ROW).distinct()
    own = texts.join(F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows, ROW, "left_semi").mapInArrow(_doc_words, f"{ROW} bigint, doc_id bigint, doc_words array<bigint>")
    pairs = places.join(small(tests.select("item", "item_id", "n_words", "item_words")), "item").join(own, ROW)
    begin, length = F.greatest(F.lit(0), -F.col("offset")), F.least(F.col("n_words"), F.size("doc_words") - F.col("offset"))
    same = F.zip_with(F.slice("doc_words", F.col("offset") + begin + 1, length - begin), F.slice("item_words", begin + 1, length - begin), lambda x, y: (x == y).cast("int"))
    matched = F.aggregate("same", F.lit(0), lambda a, x: a + x).cast("long")
    # the best stretch so far, and the best one that ends here
    run = F.aggregate(
        "same",
        F.struct(F.lit(0).alias("best"), F.lit(0).alias("here")),
        lambda a, x: F.struct(F.greatest(a["best"], a["here"] + F.when(x == 1, 1).otherwise(-GAP)).alias("best"), F.greatest(F.lit(0), a["here"] + F.when(x == 1, 1).otherwise(-GAP)).alias("here")),
        lambda a: a["best"],
    ).cast("long")
    compared = pairs.select(ROW, "doc_id", "item", "item_id", "n_words", "offset", same.alias("same")).select(ROW, "doc_id", "item", "item_id", "n_words", "offset", matched.alias("matched"), run.alias("stretch"))
    best = (
        compared.filter((F.col("matched") >= F.least(F.col("n_words").cast("double"), F.greatest(F.lit(float(least)), F.lit(share) * F.col("n_words")))) | (F.col("stretch") >= STRETCH))
        .groupBy(ROW, "doc_id", "item", "item_id", "n_words")
        .agg(F.max(F.struct("matched", (-F.col("offset")).alias("o"), "stretch")).alias("best"))
    )
    return best.select(ROW, "doc_id", "item_id", F.col("n_words").cast("long").alias("n_words"), "best.matched", "best.stretch", (-F.col("best.o")).cast("long").alias("first_word"), (F.col("best.matched") / F.col("n_words")).alias("share"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows in which find_passages finds an item; all columns stay.

    Each row, repeated ones too, is judged on its whole text; null and empty texts stay. Without items,
    nothing goes. An empty table gives an empty table.
    """
    docs = numbered(docs)
    hit = saved(_find(docs, items, MASKS, SHARE, LEAST).select(ROW).distinct(), "contaminated")
    if hit.count() <= MOST_BROADCAST:
        return docs.join(F.broadcast(hit), ROW, "left_anti").drop(ROW)
    return docs.join(hit, ROW, "left_anti").drop(ROW)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items: one row for each document and item."""
    small_batches(spark)
    return find_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop(ROW)
