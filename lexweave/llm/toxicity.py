"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts in how many toxic and clean labelled texts each token stands: words, and heads of
words, so that forms which share a stem share evidence. The log-odds ratio with an informative
Dirichlet prior (Monroe, Colaresi and Quinn, 2008) becomes the token's score; a word takes that of
its longest token with a significant one, and all other words share a small negative score. A
linear-time scan (Ruzzo and Tompa, 1999) gives all maximal segments of a text. In a clean text of n
words, a segment of score S or more has the chance p = 1 - exp(-K n exp(-lambda S)) (Karlin and
Altschul, 1990): lambda follows from the scores' distribution in clean texts, K from their best
segments. A text's score is the posterior probability of being toxic, given the p of its best segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.shared import forget, saved, schema_with, small_batches
from lexweave.llm.words import NOT_ALNUM, column, hashed_with_heads

#: Labelled texts to learn from, at most (by a hash of doc_id; a few per cent more by chance).
MOST_TRAINED = 20_000
#: Least |z| of a token's log-odds, and the prior's weight as a share of all counts. At 2, a token of four
#: toxic texts and no clean one counts; at 1, chance tokens of single texts hide the real ones.
LEAST_Z, PRIOR_SHARE = 2.0, 0.05
#: Bytes of the heads of longer words that count as tokens besides the words.
HEADS = (4, 5, 6, 7, 8)
#: A text counts as toxic from this score on; a passage as significant up to this p-value.
TOXIC_FROM, SIGNIFICANT = 0.3, 0.01


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    scores: np.ndarray
    other: float  # score of any other word
    decay: float = 1.0  # lambda
    k: float = 1.0
    share: float = 0.1  # of toxic texts
    none: tuple[float, float] = (0.5, 0.5)  # shares of clean and of toxic texts without a segment
    shape: tuple[float, float] = (1.0, 1.0)  # of Beta(shape, 1), as which p is distributed in the others

    def p_value(self, n: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Chance that a clean text of n words has a segment this good; 1 without a segment."""
        return np.where(best > 0, np.maximum(-np.expm1(-self.k * np.maximum(n, 1) * np.exp(-self.decay * best)), 1e-30), 1.0)

    def posterior(self, p: np.ndarray) -> np.ndarray:
        clean, toxic = (np.where(p >= 1, none, (1 - none) * a * p ** (a - 1)) for none, a in zip(self.none, self.shape, strict=True))
        return self.share * toxic / (self.share * toxic + (1 - self.share) * clean)


def maximal_segments(at: np.ndarray, gains: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a text whose words at ``at`` score ``gains`` and all others ``other`` < 0.

    Ruzzo and Tompa's scan; words with negative scores only matter through the running sum, so the
    list holds candidates for words with positive scores.
    """
    total, last, found = 0.0, -1, []  # found: (first, last, sum before, sum after)
    for i, gain in zip(at.tolist(), gains.tolist(), strict=True):
        total += other * (i - last - 1)
        last = i
        before, total = total, total + gain
        if gain <= 0:
            continue
        new = (i, i, before, total)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:]
    return [(a, b, r - l) for a, b, l, r in found]


def _look_up(model: Model, words: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that have a score of their own, and those scores: of the word, else of its longest head."""
    if not len(model.words):
        return np.zeros(0, np.int64), np.zeros(0)
    score = np.full(len(words), np.nan)
    for tokens in (*parts, words):
        at = np.flatnonzero(np.isin(tokens & np.uint64(0xFFFF), model.words & np.uint64(0xFFFF), kind="table"))
        place = np.minimum(np.searchsorted(model.words, tokens[at]), len(model.words) - 1)
        good = model.words[place] == tokens[at]
        score[at[good]] = model.scores[place[good]]
    at = np.flatnonzero(~np.isnan(score))
    return at, score[at]


def _scan(batch: pa.RecordBatch, model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Words and maximal segments of each text."""
    sizes, segments = [], []
    for _, words, bounds, parts in hashed_with_heads(column(batch, "text"), NOT_ALNUM, HEADS):
        at, gains = _look_up(model, words, parts)
        cuts = np.searchsorted(at, bounds)
        sizes.append(np.diff(bounds))
        for i in range(len(bounds) - 1):
            own = slice(cuts[i], cuts[i + 1])
            segments.append(maximal_segments(at[own] - bounds[i], gains[own], model.other) if cuts[i] < cuts[i + 1] and (gains[own] > 0).any() else [])
    return np.concatenate(sizes) if sizes else np.zeros(0, np.int64), segments


def _best(segments: list[list[tuple[int, int, float]]]) -> np.ndarray:
    return np.array([max((s for _, _, s in x), default=0.0) for x in segments], float)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (word, toxic, c) with c the texts that hold the token"""
    for batch in batches:
        label = batch.column("toxic").to_numpy()
        for at, words, bounds, parts in hashed_with_heads(column(batch, "text"), NOT_ALNUM, HEADS):
            own: tuple[list, list] = ([], [])
            for i in range(len(bounds) - 1):
                tokens = np.unique(np.concatenate([words[bounds[i] : bounds[i + 1]], parts[:, bounds[i] : bounds[i + 1]].ravel()]))
                own[label[at + i]].append(tokens[tokens != 0])
            for toxic, found in enumerate(own):
                word, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.full(len(word), toxic, np.int32)), pa.array(c)], ["word", "toxic", "c"])


def labelled(docs: DataFrame, labels: DataFrame, column: str, held_out: str, most: int) -> DataFrame:
    """(text, column) of about ``most`` labelled docs, at most a few per cent more, none of which the SQL condition held_out takes.

    The sample goes by a hash of doc_id. Where several labels of a doc_id differ, the largest counts.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias(column)).dropna()
    labels = labels.filter(f"NOT ({held_out})").groupBy("doc_id").agg((F.max(column) > 0).cast("int").alias(column))
    share = min(1.0, most / max(1, labels.count()))
    labels = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(labels), "doc_id").select("text", column)


def fit(docs: DataFrame, labels: DataFrame, held_out: str = "crc32(cast(doc_id as string)) % 4 = 2", most: int = MOST_TRAINED) -> Model:
    """Learn from docs (doc_id, text) whose labels (doc_id, toxic) the condition ``held_out`` leaves.

    Without labels of both kinds, the model has no words and gives every text the same score.
    """
    train = saved(labelled(docs, labels, "toxic", held_out, most), "toxic-train")
    counts = saved(train.mapInArrow(_counted, "word bigint, toxic int, c bigint").groupBy("word").agg(F.sum(F.expr("if(toxic = 1, c, 0)")).alias("t"), F.sum(F.expr("if(toxic = 0, c, 0)")).alias("n")), "toxic-words")
    nt, nn = (x or 0 for x in counts.agg(F.sum("t"), F.sum("n")).first())
    texts = dict(train.groupBy("toxic").count().collect())
    if not nt or not nn:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -1.0)
    a0 = PRIOR_SHARE * (nt + nn)
    prior = (F.col("t") + F.col("n")) * F.lit(PRIOR_SHARE)
    a, b = F.col("t") + prior, F.col("n") + prior
    odds = F.log(a / (F.lit(nt + a0) - a)) - F.log(b / (F.lit(nn + a0) - b))
    scored = counts.select("word", "t", "n", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z")).filter(F.abs("z") >= LEAST_Z)
    top = scored.toPandas()
    forget(counts)
    # at most one token in four of the bounded sample gets here
    words = top["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(words)
    odds, t, n = (top[c].to_numpy(float)[order] for c in ("odds", "t", "n"))
    if not (odds > 0).any():
        return Model(np.zeros(0, np.uint64), np.zeros(0), -1.0)
    # what the tokens with high scores take of toxic texts, the others lose there
    other = min(-0.02, float(np.log1p(-min(0.5, t[odds > 0].sum() / nt)) - np.log1p(-min(0.5, n[odds > 0].sum() / nn))))
    model = Model(words[order], odds, other, share=texts.get(1, 0) / sum(texts.values()))
    model.decay = _decay(np.append(odds, other), np.append(n + 0.5, max(1.0, nn - n.sum())))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, segments = _scan(batch, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(sizes.astype(np.int64)), pa.array(_best(segments))], ["toxic", "n", "best"])

    seen = train.mapInArrow(best, "toxic int, n bigint, best double").toPandas()
    shared.destroy()
    forget(train)
    toxic, size, s = (seen[c].to_numpy() for c in ("toxic", "n", "best"))
    size = np.maximum(size, 1)
    clean = toxic == 0
    middle = np.median(s[clean & (s > 0)]) if (clean & (s > 0)).any() else odds[odds > 0].min()
    model.k = float(((s[clean] >= middle).sum() + 0.5) / (size[clean].sum() * np.exp(-model.decay * middle)))
    p = model.p_value(size, s)
    for kind in (0, 1):
        own = p[toxic == kind]
        some = own[own < 1]
        none = (len(own) - len(some) + 0.5) / (len(own) + 1)
        shape = (len(some) + 1) / (1 - np.log(some).sum())
        model.none = (none, model.none[1]) if kind == 0 else (model.none[0], none)
        model.shape = (shape, model.shape[1]) if kind == 0 else (model.shape[0], shape)
    return model


def _decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive solution x of E[exp(x * score)] = 1."""
    p = weights / weights.sum()
    low, high = 0.0, 1.0
    if (p * scores).sum() >= 0 or scores.max() <= 0:
        return 1.0
    while (p * np.exp(high * scores)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return high


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with score, predicted, n_passages and best_passage <first word, last word, score>.

    Each row, repeated ones too, is scored on its whole text, however long; null and empty texts have no
    passage and get what texts without a segment get. Of passages that score alike, the first is the
    best. Other columns come along; columns of the new names are replaced. An empty table gives an
    empty table.
    """
    new = {"score": "double", "predicted": "int", "n_passages": "int", "best_passage": "struct<first:bigint,last:bigint,score:double>"}
    schema = schema_with(docs, new)
    rest = schema.names[: -len(new)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, segments = _scan(batch, shared.value)
            p = shared.value.p_value(sizes, _best(segments))
            post = shared.value.posterior(p)
            of, found = np.repeat(np.arange(len(segments)), [len(x) for x in segments]), np.array([s for x in segments for _, _, s in x])
            count = np.bincount(of[shared.value.p_value(sizes[of], found) <= SIGNIFICANT], minlength=len(segments))
            top = [dict(zip(("first", "last", "score"), max(x, key=lambda y: y[2]), strict=True)) if x else None for x in segments]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(post), pa.array((post >= TOXIC_FROM).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(top, pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))],
                [*rest, *new],
            )

    return docs.mapInArrow(run, schema)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage of docs (doc_id, text): doc_id, first_word, last_word, score, p_value."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, segments = _scan(batch, shared.value)
            rows = [(i, *x) for i, found in enumerate(segments) for x in found]
            i, first, last, s = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
            p = shared.value.p_value(sizes[i], s)
            good = np.flatnonzero(p <= SIGNIFICANT)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").take(pa.array(i[good])), *(pa.array(x[good].astype(t)) for x, t in ((first, np.int64), (last, np.int64), (s, float), (p, float)))],
                ["doc_id", "first_word", "last_word", "score", "p_value"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id bigint, first_word bigint, last_word bigint, score double, p_value double")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) without the rows that a model fitted on them rejects; all columns stay as they are.

    Each row, repeated ones too, is judged on its whole text alone; null and empty texts have no
    passage and stay. Without labels of both kinds nothing is rejected. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, segments = _scan(batch, shared.value)
            yield batch.filter(pa.array(shared.value.posterior(shared.value.p_value(sizes, _best(segments))) < TOXIC_FROM))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, with what was learnt from the labels that are not held out."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)").alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", "predicted", "n_passages")
