"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped for scoring.

Spark counts words and writes their 64-bit hashes as sorted arrays, in which a word's place is its
number. N-grams of the highest order are rows of numbers. Tasks count them by runs of texts and send
them to parts, equal ranges of a hash of their context (all words but the last), as columns that are
packed, so that a row takes some five bytes of the shuffle. A part sums its n-grams up, writes them as
lists of last words and counts by context, and sends what follows for the next lower order: n-grams of
that order with the number of different words before them, again by ranges of their hash. As those are
the contexts of the order above, each in the same part and at the same place, no context is written
twice. A context with a single word takes five bytes of its own and no list. Workers map the files
into memory and look sorted keys up, so that a lookup moves forward through the files and the operating
system shares their pages among workers. The driver only sees the list of files and the counts of
counts that the discounts need (Chen and Goodman, 1999).

P(w | v) = max(0, c(v w) - D) / c(v .) + g(v) * P1(w), where g(v) is the mass that discounting freed;
P1 interpolates the continuation counts N1+(. w) in the same way with 1 / (V + 1), the share of any
unknown word. In a model of a higher order n, P(w | u) of the n - 1 words u before w interpolates raw
counts of n-grams likewise with the next lower order, and all lower orders take the number of different
words before an n-gram for its count. A text is preceded by n - 1 start marks and followed by an end
mark, which is predicted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import arrays
from lexweave.llm.shared import cleaned, forget, saved, schema_with, shared_dir, small_batches
from lexweave.llm.words import BLANKS, column, hashed, mix, pair

#: The hash that stands for the end mark (no word has it but by chance).
END = np.uint64(0x454E44)
#: The order of the model where none is given.
ORDER = 3
#: Counts that a task gathers before it sends them on.
GATHERED = 1 << 21
#: Tokens for each part of the model, on average, so that a part fits a task's memory.
PART = 1 << 21
#: Turns in which a lower order is dealt out, so that its shuffle takes a fraction of the disk at a time.
TURNS = 4
#: Tokens that are looked up at a time.
TOGETHER = 1 << 19

#: What an n-gram has below the two highest orders: its count, and as a context the sum of the counts after it and how many of these are 1, 2 and more.
_SUMS = ["c", "total", "once", "twice", "more"]
_ROWS = "part int, size int, packed binary"


@dataclass
class Model:
    order: int
    words: arrays.Sorted  # by hash; value: count
    n_tokens: int
    n_words: int
    levels: list[arrays.Sorted]  # orders from 1 to the last but one, by the hash of the numbers; values: the count and, but for the last, _SUMS
    lists: list[tuple[str, list[int]]]  # of the highest order, by part of the last level: the file and where its sections begin
    discounts: list[tuple[float, float, float]]  # of orders from 1 on
    types: int  # the sum of the counts of order 1
    unknown: float  # P1 of an unknown word


class _Gather:
    """Sums counts by key and gives them out in sorted runs."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, c = np.unique(keys, return_counts=True)
        self.runs.append((key, c))
        self.size += len(key)
        if self.size > GATHERED:
            yield from self.flush(GATHERED // 2)

    def flush(self, most: int = 0) -> Iterator[pa.RecordBatch]:
        """Put the runs together; give them out if they are more than ``most``."""
        if not self.runs:
            return
        key, at = np.unique(np.concatenate([k for k, _ in self.runs]), return_inverse=True)
        c = np.bincount(at, np.concatenate([c for _, c in self.runs])).astype(np.int64)
        if len(key) <= most:
            self.runs, self.size = [(key, c)], len(key)
            return
        self.runs, self.size = [], 0
        for a in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 100_000]), pa.array(c[a : a + 100_000])], ["key", "c"])


def _with_ends(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with an end mark after each text, and the new bounds."""
    return np.insert(words, bounds[1:], END), bounds + np.arange(len(bounds))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gather = _Gather()
    for batch in batches:
        for _, words, bounds in hashed(column(batch, "text"), BLANKS):
            yield from gather.add(_with_ends(words, bounds)[0].view(np.int64))
    yield from gather.flush()


def _numbers(model_words: arrays.Sorted, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words' numbers (-1 for unknown ones), and each word's place among the distinct."""
    key, at = np.unique(words.view(np.int64), return_inverse=True)
    return model_words.find(key), at


def _windows(number: np.ndarray, bounds: np.ndarray, order: int, start: int) -> np.ndarray:
    """A row for each token: the numbers of the order - 1 tokens before it, start marks where the text begins, and its own."""
    place = np.arange(len(number)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = np.full((len(number), order), start, np.int64)
    for back in range(order):
        out[back:, order - 1 - back] = number[: len(number) - back]
        out[place < back, order - 1 - back] = start
    return out


def _keys(grams: np.ndarray) -> np.ndarray:
    """Hashes of rows of numbers."""
    key = mix(grams[:, 0].astype(np.uint64))
    for k in range(1, grams.shape[1]):
        key = pair(key, grams[:, k].astype(np.uint64))
    return key.view(np.int64)


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key, of so many equal ranges."""
    return (((keys >> 33) + (1 << 30)) * parts) >> 31


def _planes(x: np.ndarray) -> np.ndarray:
    """The lowest bytes of all values, then the next ones, and so on: most are 0 and take no space when compressed."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.ravel()


def _packed(grams: np.ndarray, sums: np.ndarray, keys: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of numbers and of their sums as _ROWS, a row for each part that the keys are in."""
    part = _parts_of(keys, parts)
    order = np.lexsort((*grams[:, 1::-1].T, part))
    grams, sums, part = grams[order].astype("<i4"), sums[order].astype("<i8"), part[order]
    codec, cuts = pa.Codec("zstd", compression_level=1), np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        columns = [np.diff(grams[a:b, 0], prepend=np.int32(0)), *grams[a:b, 1:].T, *sums[a:b].T]
        rows.append((int(part[a]), int(b - a), codec.compress(np.concatenate([_planes(x) for x in columns]), asbytes=True)))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["part", "size", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch], order: int, n_sums: int) -> tuple[int, np.ndarray, np.ndarray] | None:
    """The part, numbers and sums of a task's _ROWS, which are of one part."""
    codec, part, grams, sums = pa.Codec("zstd"), -1, [], []
    for batch in batches:
        for row in batch.to_pylist():
            if part not in (-1, row["part"]):
                raise RuntimeError("a task takes one part")
            part, size = row["part"], row["size"]
            data = np.frombuffer(codec.decompress(row["packed"], size * (4 * order + 8 * n_sums)), np.uint8)
            take = lambda at, width, kind: np.ascontiguousarray(data[at * size : (at + width) * size].reshape(width, size).T).view(kind).ravel()  # noqa: B023, E731
            columns = [take(4 * k, 4, "<i4") for k in range(order)]
            columns[0] = np.cumsum(columns[0], dtype=np.int32)
            grams.append(np.stack(columns, axis=1))
            sums.append(np.stack([take(4 * order + 8 * k, 8, "<i8") for k in range(n_sums)], axis=1))
    return (part, np.concatenate(grams), np.concatenate(sums)) if grams else None


def _summed(keys: np.ndarray, grams: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each key, in their order."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], grams[order[first]], np.add.reduceat(sums[order], first, axis=0)


def _grams(batches: Iterator[pa.RecordBatch], words: arrays.Sorted, order: int, start: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(text) -> n-grams with their counts, by run of texts, as _ROWS in the part of the context.

    The n - 1 last tokens of a text are a context too, that of the number -1, which isn't counted.
    """
    runs, size = [], 0

    def flush(most: int) -> Iterator[pa.RecordBatch]:
        nonlocal runs, size
        if not runs:
            return
        keys, grams, c = _summed(*(np.concatenate(x) for x in zip(*runs, strict=True)))
        if len(keys) <= most:
            runs, size = [(keys, grams, c)], len(keys)
            return
        runs, size = [], 0
        yield from _packed(grams, c, _keys(grams[:, :-1]), parts)

    for batch in batches:
        for tokens, bounds in _together(column(batch, "text")):
            number, at = _numbers(words, tokens)
            number = np.insert(number[at], bounds[1:], -1)
            grams = _windows(number, bounds + np.arange(len(bounds)), order, start)
            runs.append(_summed(_keys(grams), grams.astype(np.int32), (number >= 0).astype(np.int64)[:, None]))
            size += len(runs[-1][0])
            if size > GATHERED:
                yield from flush(GATHERED // 2)
    yield from flush(0)


def _together(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words and end marks of some texts, and their bounds."""
    some, n = [], 0

    def out() -> tuple[np.ndarray, np.ndarray]:
        tokens = np.concatenate([x for x, _ in some])
        return tokens, np.append(0, np.cumsum(np.concatenate([np.diff(b) for _, b in some])))

    for _, words, bounds in hashed(text, BLANKS):
        some.append(_with_ends(words, bounds))
        n += len(some[-1][0])
        if n > TOGETHER:
            yield out()
            some, n = [], 0
    if some:
        yield out()


def _counts(c: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4, and 3 or more, and their sum."""
    return [*(int((c == k).sum()) for k in (1, 2, 3, 4)), int((c >= 3).sum()), int(c.sum())]


def _said(**found: object) -> pa.RecordBatch:
    """What the driver learns of a part, as a row of _ROWS without a part."""
    return pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([json.dumps(found).encode()], pa.binary())], ["part", "size", "packed"])


def _highest(batches: Iterator[pa.RecordBatch], order: int, start: int, parts: int, uri: str) -> Iterator[pa.RecordBatch]:
    """The n-grams of a part to its file, and the n-grams of the next lower order as _ROWS in the parts of their own keys.

    The file has for each context, in the order of their keys, how many tokens it has, if they are of one word
    and fewer than 255 (else 255, and 0 if there is none), and that word or the number of its list; for each list
    its begin, _SUMS and words with their counts.
    """
    got = _unpacked(batches, order, 1)
    if got is None:
        return
    part, grams, c = got
    contexts, w = _keys(grams[:, :-1]), grams[:, -1]
    by = np.lexsort((w, contexts))
    contexts, w = contexts[by], w[by]
    new = np.append(True, contexts[1:] != contexts[:-1])
    first = np.flatnonzero(new | np.append(True, w[1:] != w[:-1]))
    c, grams, w, at = np.add.reduceat(c[by, 0], first), grams[by[first]], w[first], np.cumsum(new)[first] - 1
    n, real = int(new.sum()), w >= 0
    c, grams, w, at = c[real], grams[real], w[real], at[real]
    words, total = np.bincount(at, minlength=n), np.bincount(at, c, n).astype(np.int64)
    listed = (words > 1) | (total >= 255)
    kind = np.where(listed, 255, total).astype(np.uint8)
    x = np.zeros(n, "<i4")
    x[at] = w
    x[listed] = np.arange(listed.sum())
    some = listed[at]
    sums = [np.bincount(at, k, n).astype(np.int64)[listed] for k in (c == 1, c == 2, c >= 3)]
    begins = np.append(0, np.cumsum(words[listed])).astype("<i8")
    file, sections = arrays.write_sections(f"{uri}/lists", [kind, x, begins, *(arrays.small(v) for v in (total[listed], *sums)), w[some].astype("<i4"), arrays.small(c[some])])
    yield _said(part=part, size=n, file=file, sections=sections, counts=_counts(c))
    lower = np.append(grams[:, 1:], np.full((1, order - 1), start, np.int32), axis=0)
    ones = np.append(np.ones(len(grams), np.int64), 0)[:, None]
    keys, lower, sums = _summed(_keys(lower), lower, ones)
    yield from _packed(lower, sums, keys, parts)


def _lower(batches: Iterator[pa.RecordBatch], order: int, n_sums: int, parts: int, uri: str) -> Iterator[pa.RecordBatch]:
    """The n-grams of a part, in the order of their keys, to its files; for the next lower order the n-grams with what they have as ends and as contexts, as _ROWS."""
    got = _unpacked(batches, order, n_sums)
    if got is None:
        return
    part, grams, sums = got
    keys, grams, sums = _summed(_keys(grams), grams, sums)
    files = [arrays.write(f"{uri}/keys-{order}", keys.astype("<i8")), *(arrays.write(f"{uri}/{name}-{order}", arrays.small(x)) for name, x in zip(_SUMS, sums.T, strict=False))]
    grams, c = grams[sums[:, 0] > 0], sums[sums[:, 0] > 0, 0]
    yield _said(part=part, size=len(keys), first=int(keys[0]), files=files, counts=_counts(c))
    if order > 1:
        none = np.zeros_like(c)
        lower = np.concatenate([grams[:, 1:], grams[:, :-1]])
        own = np.stack([np.ones_like(c), none, none, none, none], axis=1), np.stack([none, c, c == 1, c == 2, c >= 3], axis=1)
        keys, lower, own = _summed(_keys(lower), lower, np.concatenate(own))
        yield from _packed(lower, own, keys, parts)


def _heard(*tables: DataFrame) -> list[dict]:
    """What the parts said, in the order of the parts."""
    return sorted((json.loads(r.packed) for t in tables for r in t.filter("part < 0").select("packed").collect()), key=lambda x: x["part"])


def _whole(batches: Iterator[pa.RecordBatch], columns: list[str]) -> list[np.ndarray]:
    """A partition's columns, which are fixed-width."""
    parts = [[batch.column(c).to_numpy(zero_copy_only=False) for c in columns] for batch in batches]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else []


def _written(df: DataFrame, key: str, values: dict[str, str], uri: str) -> arrays.Sorted:
    """Range-partition and sort df by key, and write each partition's key and values as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _whole(batches, [key, *values])
        if own:
            files = [arrays.write(uri, x.astype(k)) for x, k in zip(own, ("<i8", *values.values()), strict=True)]
            yield pa.RecordBatch.from_pydict({"first": [int(own[0][0])], "size": [len(own[0])], "file": [files[0]], "others": [files[1:]]})

    parts = df.repartitionByRange(key).sortWithinPartitions(key).select(key, *values).mapInArrow(run, "first bigint, size bigint, file string, others array<string>")
    return arrays.Sorted([(r.first_, r.size, r.file, r.others) for r in parts.withColumnRenamed("first", "first_").collect()], list(values.values()))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many n-grams occur once, twice, three and four times."""
    n1, n2, n3, n4 = (float(x or 0) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    one = 1 - 2 * y * n2 / n1 if n1 else 0.5
    two = 2 - 3 * y * n3 / n2 if n2 else 1.0
    more = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return tuple(min(max(d, 0.01), top) for d, top in ((one, 1.0), (two, 2.0), (more, 3.0)))


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """Count docs (text); null counts as empty. At most 2**31 - 1 distinct words; order is 2 at least."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    uri = f"{shared_dir(spark)}/kneser-ney"
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counted = saved(texts.mapInArrow(_words, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c")), "words")
    n_tokens = counted.agg(F.sum("c")).first()[0] or 0
    with cleaned(spark):
        words = _written(counted, "key", {"c": "<i8"}, f"{uri}/words")
    forget(counted)
    n_words = int(words.begin[-1])
    if not n_words:
        return Model(order, words, 0, 0, [arrays.Sorted([], ["small"] * len(_SUMS))] * (order - 1), [], [(0.5, 1.0, 1.5)] * order, 0, 1.0)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // PART))
    dealt = texts.mapInArrow(lambda it: _grams(it, words, order, n_words, parts), _ROWS).repartitionById(parts, F.col("part"))
    rows = [saved(dealt.mapInArrow(lambda it: _highest(it, order, n_words, parts, uri), _ROWS), "grams")]
    lists = _heard(*rows)
    counts, levels = [np.sum([x["counts"] for x in lists], axis=0)], []
    for k in range(order - 1, 0, -1):
        n_sums, turns = (1 if k == order - 1 else len(_SUMS)), (TURNS if k > 1 else 1)
        run = lambda it, k=k, n_sums=n_sums: _lower(it, k, n_sums, parts, uri)
        sent = [x.filter("part >= 0") for x in rows]
        now = []
        for turn in range(turns):
            some = [x.filter(F.col("part") % turns == turn) for x in sent]
            both = some[0]
            for x in some[1:]:
                both = both.unionByName(x)
            now.append(saved(both.repartitionById(-(-parts // turns), F.floor(F.col("part") / turns).cast("int")).mapInArrow(run, _ROWS), "grams"))
        forget(*rows)
        rows, heard = now, _heard(*now)
        levels.append(arrays.Sorted([(x["first"], x["size"], x["files"][0], x["files"][1:]) for x in heard], ["small"] * n_sums))
        counts.append(np.sum([x["counts"] for x in heard], axis=0))
        if k == order - 1 and [(x["part"], x["size"]) for x in heard] != [(x["part"], x["size"]) for x in lists]:
            raise RuntimeError("the contexts of the highest order aren't the n-grams of the next lower one")
    forget(*rows)
    off = [discounts([int(n) for n in x[:4]]) for x in counts[::-1]]
    once, twice, _, _, more, types = (int(n) for n in counts[-1])
    unknown = (off[0][0] * once + off[0][1] * twice + off[0][2] * more) / types / (n_words + 1)
    return Model(order, words, n_tokens, n_words, levels[::-1], [(x["file"], x["sections"]) for x in lists], off, types, unknown)


def _after(model: Model, places: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For contexts at places of the last level and words: the count of the word after the context, and the context's _SUMS but for its own count."""
    out = np.zeros((5, len(places)), np.int64)
    for k, at in model.levels[-1].by_part(places):
        kinds, xs, begins, *sums, listed, counts = arrays.sections(*model.lists[k], ["u1", "<i4", "<i8", "u1", "u1", "u1", "u1", "<i4", "u1"])
        own, word = places[at] - model.levels[-1].begin[k], w[at]
        kind, x = kinds[own].astype(np.int64), xs[own]
        out[:, at] = np.where(x == word, kind, 0), kind, kind == 1, kind == 2, kind > 2
        many = np.flatnonzero(kind == 255)
        if not len(many):
            continue
        number, word = x[many], word[many]
        low, end = begins[number], begins[number + 1]
        high = end.copy()
        while len(still := np.flatnonzero(low < high)):
            middle = (low[still] + high[still]) >> 1
            less = listed[middle] < word[still]
            low[still], high[still] = np.where(less, middle + 1, low[still]), np.where(less, high[still], middle)
        found = (low < end) & (listed[np.minimum(low, len(listed) - 1)] == word)
        c = np.zeros(len(many), np.int64)
        c[found] = arrays.small_at(counts, len(listed), low[found])
        out[:, at[many]] = c, *(arrays.small_at(x, len(begins) - 1, number) for x in sums)
    return out


def _less(c: np.ndarray, off: tuple[float, float, float]) -> np.ndarray:
    return c - np.select([c >= 3, c == 2, c == 1], off[::-1], 0.0)


def _scored(text: pa.Array, model: Model) -> Iterator[list[np.ndarray]]:
    """For runs of texts: tokens, known ones, base score and the model's score of each."""
    for tokens, bounds in _together(text):
        number, at = _numbers(model.words, tokens)
        count = model.words.values(number, 0)
        own = number[at]
        before = np.arange(-1, len(own) - 1)
        before[bounds[:-1]] = len(own)  # the start marks, which come last below
        p = np.full(len(own), model.unknown)
        for k in range(1, model.order):
            grams = np.append(_windows(own, bounds, k, model.n_words), np.full((1, k), model.n_words), axis=0)
            keys, place = np.unique(np.where((grams < 0).any(axis=1), -1, _keys(grams)), return_inverse=True)
            level = model.levels[k - 1]
            found = level.find(keys)
            if k == 1 and model.types:
                c = level.values(found, 0)[place[:-1]]
                p = _less(c, model.discounts[0]) / model.types + model.unknown
            if k > 1:
                p = _interpolated(p, level.values(found, 0)[place[:-1]], sums, model.discounts[k - 1])
            sums = [level.values(found, i)[place[before]] for i in range(1, len(_SUMS))] if k < model.order - 1 else None
        c, *sums = _after(model, found[place[before]], own)
        p = _interpolated(p, c, sums, model.discounts[-1])
        known = own >= 0
        base = np.log10((count[at] + 1.0) / (model.n_tokens + model.n_words + 1.0))
        cut = bounds[:-1]
        yield [np.diff(bounds), np.add.reduceat(known.astype(np.int64), cut), np.add.reduceat(base, cut), np.add.reduceat(np.log10(p), cut)]


def _interpolated(lower: np.ndarray, c: np.ndarray, sums: list[np.ndarray], off: tuple[float, float, float]) -> np.ndarray:
    """The probabilities of n-grams, given those of the next lower order; a context that training hasn't seen leaves these as they are."""
    total, once, twice, more = sums
    freed = off[0] * once + off[1] * twice + off[2] * more
    return np.where(total > 0, (_less(c, off) + freed * lower) / np.maximum(total, 1), lower)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with n_tokens, n_known, train_tokens, base_score, score and perplexity of each whole text.

    Tokens are blank-separated words, A-Z lower-cased, and an end mark, so a null or empty text has
    one token. n_known are the tokens that training has seen; base_score is the log10 probability by
    add-one unigrams, score the model's. Every row is scored; columns of the new names are replaced.
    """
    new = {"n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double", "perplexity": "double"}
    schema = schema_with(docs, new)
    rest = schema.names[: -len(new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(_scored(column(batch, "text"), model))
            if parts:
                n, known, base, own = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.n_tokens)), pa.array(base), pa.array(own), pa.array(10.0 ** (-own / n))], schema.names)

    return docs.mapInArrow(run, schema)


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model of those that are not held out."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.expr("coalesce(crc32(cast(doc_id as string)) % 7 = 2, false)")
    model = fit(docs.filter(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
