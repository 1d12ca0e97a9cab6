"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's set of word shingles gives a signature of 65 minima of 12 bits, cut into 13 pieces of 5.
If two signatures differ in at most 25 symbols, then by pigeonhole some piece differs in at most one,
since 13 * (1 + 1) > 25. So each piece is entered once for every symbol left out, and signatures
within the distance share an entry for sure. At a similarity of 0.8, a symbol differs with a chance
of 0.2, and more than 25 of 65 do with about 2e-4. Candidates are confirmed on the full shingle sets.

Texts with equal sets form one class, and all joins run on classes. Entries are resolved in two
passes that never list all pairs of a large bucket: first each class meets the smallest and the
largest leader of its buckets, and in a few turns members of its buckets' largest groups; what is
linked is contracted; then only rows outside a bucket's largest group meet the rows of other groups.
A bucket of mutual copies thus costs its length, and no link between components is lost, for every
pair of rows of different components is still met: in the first entry that the two share, if their
sizes and images allow the similarity. An image has 1,024 bits, of which each shingle flips one, so
bits by which two images differ are shingles by which the sets differ: this rules out no similar pair,
and nearly every other one of texts of up to some hundred words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.shared import ROW, components, forget, hot_join, keep_rows, numbered, saved, small_batches
from lexweave.llm.words import hashed, mix, pair

PIECES, PLACES, BITS, DISTANCE = 13, 5, 12, 25
SYMBOLS = PIECES * PLACES
IMAGE_BITS = 1024
SIMILARITY = 80  # per cent
#: So many class numbers (16 MB) may be broadcast; more take a shuffle join.
MOST_BROADCAST = 1_000_000
#: Turns in which rows meet members of their buckets' largest groups before the rest is met.
ROUNDS = 4

#: A bit for each symbol of a piece, in which all its bits are gathered.
_FOLDED = sum(1 << (BITS * k) for k in range(PLACES))
_WORDS = [f"w{k}" for k in range(PIECES + IMAGE_BITS // 64)]


def _seeds(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
    return seeds[:n], seeds[n:] | np.uint64(1)


_XOR, _TIMES = _seeds(SYMBOLS, 1)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text (its whole word sequence where shorter) and their bounds."""
    lengths = np.diff(bounds)
    counts = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    rolled = words.copy()
    for k in range(1, width):
        if len(rolled) > k:
            rolled[:-k] = pair(rolled[:-k], words[k:])
    for i in np.flatnonzero((lengths > 0) & (lengths < width)):
        acc = words[bounds[i]]
        for k in range(bounds[i] + 1, bounds[i + 1]):
            acc = pair(acc[None] if acc.ndim == 0 else acc, words[k : k + 1])
        rolled[bounds[i]] = mix(np.atleast_1d(acc) ^ np.uint64(lengths[i]))[0]
    place = np.arange(len(words)) - np.repeat(bounds[:-1], lengths)
    return rolled[place < np.repeat(counts, lengths)], np.concatenate([[0], np.cumsum(counts)])


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(ROW, doc_id, text) -> (ROW, doc_id, cls, n, sig)"""
    for batch in batches:
        for at, words, bounds in hashed(batch.column("text")):
            shingles, cuts = shingle_hashes(words, bounds, width)
            m = len(cuts) - 1
            n, cls, full = np.zeros(m, np.int32), np.zeros(m, np.int64), np.flatnonzero(np.diff(cuts))
            for i in full:
                own = np.unique(shingles[cuts[i] : cuts[i + 1]])
                n[i] = len(own)
                with np.errstate(over="ignore"):
                    cls[i] = mix(np.array([mix(own).sum(dtype=np.uint64) ^ np.uint64(len(own))]))[0].view(np.int64)
            sig = np.zeros((m, PIECES), np.uint64)
            if len(full):
                for k in range(SYMBOLS):
                    with np.errstate(over="ignore"):
                        values = (shingles ^ _XOR[k]) * _TIMES[k]
                    symbol = mix(np.minimum.reduceat(values, cuts[full])) & np.uint64((1 << BITS) - 1)
                    sig[full, k // PLACES] |= symbol << np.uint64(BITS * (k % PLACES))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(ROW)[at : at + m],
                    batch.column("doc_id")[at : at + m],
                    pa.array(cls),
                    pa.array(n),
                    pa.array([x.tobytes() for x in sig], pa.binary()),
                ],
                [ROW, "doc_id", "cls", "n", "sig"],
            )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, n, sig) -> (key, at, cls, n), a row for each piece and symbol left out; at is the symbol."""
    for batch in batches:
        for c in range(0, batch.num_rows, 1000):
            part = batch.slice(c, 1000)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint64).reshape(-1, PIECES)
            keys = np.empty((len(sig), SYMBOLS), np.uint64)
            for k in range(SYMBOLS):
                left = ~np.uint64(((1 << BITS) - 1) << (BITS * (k % PLACES)))
                keys[:, k] = mix((sig[:, k // PLACES] & left) ^ (np.uint64(k + 1) << np.uint64(60)) ^ mix(np.array([k + 1], np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.ravel().view(np.int64)),
                    pa.array(np.tile(np.arange(SYMBOLS, dtype=np.int32), len(sig))),
                    pa.array(np.repeat(part.column("cls").to_numpy(), SYMBOLS)),
                    pa.array(np.repeat(part.column("n").to_numpy(), SYMBOLS)),
                ],
                ["key", "at", "cls", "n"],
            )


def _imaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, sig, own) -> (cls, w0, w1, ...): the signature's pieces and the image, 64 bits a column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.empty((batch.num_rows, len(_WORDS)), np.uint64)
        for i, (sig, own) in enumerate(zip(batch.column("sig"), batch.column("own"), strict=True)):
            bits = np.bincount((np.frombuffer(own.as_buffer(), np.uint64) % np.uint64(IMAGE_BITS)).astype(np.int64), minlength=IMAGE_BITS) & 1
            rows[i] = np.concatenate([np.frombuffer(sig.as_buffer(), np.uint64), np.packbits(bits.astype(np.uint8)).view(np.uint64)])
        yield pa.RecordBatch.from_arrays([batch.column("cls"), *(pa.array(rows[:, k].copy().view(np.int64)) for k in range(len(_WORDS)))], ["cls", *_WORDS])


def _first_met(similarity: int) -> str:
    """SQL for rows l and r of one entry: images and signatures are near, and this is the first entry that they share.

    The images come first, as they are cheap to compare and few pairs pass. In a piece without a
    difference, all entries are shared, and the first one counts.
    """
    apart = " + ".join(f"bit_count(l.w{k} ^ r.w{k})" for k in range(PIECES, len(_WORDS)))
    fold = "x -> x | shiftrightunsigned(x, 6)", "x -> x | shiftrightunsigned(x, 3)", f"x -> bit_count((x | shiftrightunsigned(x, 1) | shiftrightunsigned(x, 2)) & {_FOLDED}L)"
    differ = "zip_with(l.pieces, r.pieces, (x, y) -> x ^ y)"
    for step in fold:
        differ = f"transform({differ}, {step})"
    piece = f"cast(floor(l.at / {PLACES}) as int)"
    met = f"forall(transform({differ}, (d, i) -> struct(d as d, i as i)), s -> s.i > {piece} OR (s.i < {piece} AND s.d > 1) OR (s.i = {piece} AND (s.d = 1 OR l.at % {PLACES} = 0)))"
    near = f"aggregate({differ}, 0, (a, d) -> a + d) <= {DISTANCE}"
    return f"{100 + similarity} * ({apart}) <= {100 - similarity} * (l.n + r.n) AND {met} AND {near}"


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(ROW, text) -> (ROW, own) with the sorted shingle hashes."""
    for batch in batches:
        for at, words, bounds in hashed(batch.column("text")):
            shingles, cuts = shingle_hashes(words, bounds, width)
            own = [np.unique(shingles[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(ROW)[at : at + len(own)], pa.array(own, pa.binary())], [ROW, "own"])


def _confirmed(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """(a, b, own_a, own_b) -> the pairs (a, b) that are similar enough on their full sets."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column("own_a"), batch.column("own_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= similarity * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) of classes that hold on full sets, as a written table."""
    wide = pairs.join(sets.select(F.col("cls").alias("b"), F.col("own").alias("own_b")), "b").join(sets.select(F.col("cls").alias("a"), F.col("own").alias("own_a")), "a")
    return saved(wide.mapInArrow(lambda it: _confirmed(it, similarity), "a bigint, b bigint"), "near-links")


def _pointers(links: DataFrame) -> DataFrame:
    """(cls, component): the class that three steps along links to the smallest neighbour reach; enough to contract by in turns."""
    up = links.select(F.greatest("a", "b").alias("cls"), F.least("a", "b").alias("to")).groupBy("cls").agg(F.min("to").alias("to"))
    far = up.select(F.col("cls").alias("to"), F.col("to").alias("next"))
    two = up.join(far, "to", "left").select("cls", F.coalesce("next", "to").alias("to"))
    return two.join(far, "to", "left").select("cls", F.coalesce("next", "to").alias("component"))


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, own) for the classes wanted (ROW, cls), from the text of the row ROW; a written table."""
    small = F.broadcast if wanted.count() <= MOST_BROADCAST else (lambda x: x)
    texts = docs.select(ROW, "text").join(small(wanted.select(ROW)), ROW)
    sets = texts.mapInArrow(lambda it: _sets(it, width), f"{ROW} bigint, own binary")
    return saved(sets.join(small(wanted), ROW).select("cls", "own"), "near-sets")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """For each row of docs (doc_id, text): ROW, doc_id, n_shingles, component_id, kept.

    Words are runs of anything but blanks, A-Z lower-cased. Rows are linked when their sets of
    ``width``-word shingles agree by ``similarity`` per cent or more (Jaccard); a text with fewer
    words is one shingle; a text without words, or null, is linked with nothing and is its own
    component. component_id is the smallest doc_id that links reach; null doc_ids are passed over
    where the component has another. kept marks each row of that doc_id, or one row where all ids
    of a component are null. Other columns of docs are ignored, whatever their names. An empty
    table gives an empty result.

    Classes are numbered by 64 bits of a hash of their set: among n different texts, about
    n * n / 2**65 pairs are wrongly one class.
    """
    return _near(numbered(docs), width, similarity)


def _near(docs: DataFrame, width: int, similarity: int) -> DataFrame:
    docs = docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = saved(docs.mapInArrow(lambda it: _signed(it, width), f"{ROW} bigint, doc_id bigint, cls bigint, n int, sig binary"), "near-rows")
    sized = rows.filter("n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("rep"), F.min(ROW).alias(ROW), F.count("*").alias("copies"))
    sized = saved(sized, "near-classes")
    classes = rows.select(ROW, "sig").join(sized.select(ROW, "cls", "n"), ROW)
    entries = classes.select("cls", "n", "sig").mapInArrow(_entries, "key bigint, at int, cls bigint, n int")
    shared = entries.groupBy("key").agg(F.count("*").alias("c"), F.min("cls").alias("first")).filter("c > 1")
    hits = saved(entries.join(shared.select("key", "first"), "key"), "near-hits")
    wanted = saved(sized.select(ROW, "cls").join(hits.select("cls").distinct(), "cls"), "near-wanted")
    sets = _full_sets(docs, wanted, width)

    stars = hits.filter("cls <> first").groupBy("cls").agg(F.min("first").alias("lo"), F.max("first").alias("hi"))
    stars = stars.select(F.col("cls").alias("b"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("a")).select("a", "b")
    links = _links(stars, sets, similarity)

    # contract what is linked; rows outside a bucket's largest group then meet a few members of it, in turn
    hits_ = hits.drop("first")
    for turn in range(ROUNDS):
        groups = saved(_pointers(links) if turn < ROUNDS - 1 else components(links, "near-groups").withColumnRenamed("node", "cls"), "near-groups")
        parts = hits_.join(groups, "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
        sums = parts.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min(F.xxhash64("cls", F.lit(turn))).alias("h"))
        main = sums.groupBy("key").agg(F.max(F.struct("c", "comp", "h")).alias("main"), F.count("*").alias("k")).filter("k > 1").select("key", F.col("main.comp").alias("main"), F.col("main.h").alias("h"))
        mixed = saved(parts.join(main, "key"), "near-mixed")
        if turn == ROUNDS - 1:
            break
        old = links
        heads = mixed.filter(F.xxhash64("cls", F.lit(turn)) == F.col("h")).filter("comp = main").select("key", F.col("cls").alias("a"))
        met = mixed.filter("comp <> main").join(heads, "key").groupBy("cls").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
        met = met.select(F.col("cls").alias("b"), F.explode(F.array_distinct(F.array("lo", "hi"))).alias("a")).select("a", "b")
        more = _links(met, sets, similarity)
        links = saved(old.unionByName(more), "near-links")
        forget(old, more, mixed, groups)
    forget(hits)
    hits = mixed.drop("h")
    left = hits.select("cls").distinct().join(sized.select(ROW, "cls"), "cls")
    images = saved(rows.select(ROW, "sig").join(left, ROW).join(sets, "cls").select("cls", "sig", "own").mapInArrow(_imaged, "cls bigint, " + ", ".join(f"{w} bigint" for w in _WORDS)), "near-images")
    hits = hits.join(images, "cls").withColumn("pieces", F.array(*_WORDS[:PIECES])).drop(*_WORDS[:PIECES])
    fits = f"100 * least(l.n, r.n) >= {similarity} * greatest(l.n, r.n)"
    cross = hits.filter("comp <> main").alias("l").join(hits.alias("r"), F.expr(f"l.key = r.key AND l.comp <> r.comp AND (r.comp = r.main OR l.cls < r.cls) AND {fits} AND {_first_met(similarity)}"))
    cross = saved(cross.select(F.expr("least(l.cls, r.cls)").alias("a"), F.expr("greatest(l.cls, r.cls)").alias("b")), "near-cross")
    more = _links(cross, sets, similarity)

    # what is met last links components, of which few are left: their smallest classes are linked instead
    named_by = lambda c: groups.select(F.col("cls").alias(c), F.col("component").alias(f"of_{c}"))
    ends = more.join(named_by("a"), "a", "left").join(named_by("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    last = saved(components(ends, "near-components").select(F.col("node").alias("component"), F.col("component").alias("whole")), "near-last")
    named = saved(sized.join(groups, "cls", "left").select("cls", "rep", ROW, "copies", F.coalesce("component", "cls").alias("component")), "near-members")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.min(ROW).alias("first_row"), F.count("*").alias("size"))
    least = saved(least.join(last, "component", "left").withColumn("whole", F.coalesce("whole", "component")), "near-least")
    wholes = saved(least.groupBy("whole").agg(F.min("component_id").alias("component_id"), F.min("first_row").alias("first_row"), F.count("*").alias("parts")), "near-wholes")
    least = saved(hot_join(least.select("component", "size", "whole"), wholes, "whole", "parts", least.count()).drop("whole", "parts"), "near-least")
    named = saved(hot_join(named, least, "component", "size", named.count()).select("cls", "component_id", "first_row", "copies"), "near-named")
    forget(mixed, images, sets, links, more, wanted, groups, cross, last)
    full = rows.filter("n > 0").select(ROW, "doc_id", "cls", "n")
    out = hot_join(full, named, "cls", "copies", full.count()).select(ROW, "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "first_row")
    bare = rows.filter("n = 0").select(ROW, "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col(ROW).alias("first_row"))
    return out.unionByName(bare).withColumn("kept", F.when(F.col("component_id").isNull(), F.col(ROW) == F.col("first_row")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))).drop("first_row")


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """docs without near duplicates: of each component of near_duplicates one row stays, with all columns.

    It is the row with the smallest doc_id (of repeated rows one; of null ids one, where a component has
    no other). Texts without words, null included, are linked with nothing, but repeated rows of one
    doc_id count as one document. Texts of any length are taken whole. An empty table gives an empty table.
    """
    docs = numbered(docs)
    found = _near(docs, width, similarity).filter("kept")
    # repeated rows of the doc_id that stays are one document
    kept = found.groupBy(F.coalesce(F.col("component_id"), F.col(ROW)), F.col("component_id").isNull(), F.col("n_shingles") > 0).agg(F.min(ROW).alias(ROW))
    return keep_rows(docs, kept)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shingle count and near-duplicate component, by 2-word shingles at 0.8."""
    small_batches(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2).select("doc_id", "n_shingles", "component_id", "kept")
