"""A quality classifier from positive and unlabelled texts.

The risk is the non-negative unbiased one of Kiryo et al. (2017): the prior times the trusted
positives' loss, plus what unlabelled texts lose as negatives less the positives' share of that, which
is kept from falling below 0. Texts known to be bad are never used. The class prior is the least ratio
of unlabelled to positive texts above a threshold of a first classifier (Garg et al., 2021). Features
are shares of characters, word and line statistics; each is cut into bins, and the model is additive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.shared import saved, schema_with, small_batches
from lexweave.llm.words import BLANKS, column, hashed, pair

#: Trusted positives, and unlabelled texts, to learn from: about so many at most, by a hash of doc_id.
MOST_POSITIVE, MOST_UNLABELLED = 10_000, 20_000
#: Bins of a feature, steps and step size of the descent, weight of the ridge penalty.
BINS, STEPS, RATE, RIDGE = 12, 400, 0.05, 1e-4
#: A text counts as good from this score on.
GOOD_FROM = 0.3

_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
_NEWLINE_ONLY = np.arange(256) == 10
N_FEATURES = len(_PUNCTUATION) + 15


def features(text: pa.Array) -> np.ndarray:
    """A row of features for each text; zeros for an empty or null one."""
    text = text.cast(pa.large_string()).fill_null("")
    out = np.zeros((len(text), N_FEATURES))
    raw = [x.encode() for x in text.to_pylist()]
    for i, data in enumerate(raw):
        if not data:
            continue
        b = np.frombuffer(data, np.uint8)
        n = len(b)
        count = np.bincount(b, minlength=256)
        letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
        symbols = count[_PUNCTUATION]
        out[i, : len(_PUNCTUATION)] = symbols / n
        out[i, len(_PUNCTUATION) : len(_PUNCTUATION) + 8] = (
            np.log(n),
            count[65:91].sum() / max(1, count[65:91].sum() + count[97:123].sum()),
            count[48:58].sum() / n,
            count[[9, 10, 11, 12, 13, 32]].sum() / n,
            count[128:].sum() / n,
            letters / n,
            symbols.sum() / n,
            (symbols.sum() - count[[39, 44, 45, 46]].sum()) / n,
        )
    at_word = len(_PUNCTUATION) + 8
    for at, words, bounds in hashed(text, BLANKS):
        for i in range(len(bounds) - 1):
            own = words[bounds[i] : bounds[i + 1]]
            if len(own):
                _, c = np.unique(own, return_counts=True)
                two = np.unique(pair(own[:-1], own[1:])) if len(own) > 1 else own
                out[at + i, at_word : at_word + 5] = (np.log(len(own)), len(raw[at + i]) / len(own), len(c) / len(own), c.max() / len(own), len(two) / max(1, len(own) - 1))
    at_line = at_word + 5
    for at, lines, bounds in hashed(text, _NEWLINE_ONLY):
        for i in range(len(bounds) - 1):
            own = lines[bounds[i] : bounds[i + 1]]
            if len(own):
                out[at + i, at_line : at_line + 2] = (np.log(len(own)), len(np.unique(own)) / len(own))
    return out


@dataclass
class Model:
    edges: np.ndarray  # (features, BINS - 1)
    weights: np.ndarray  # (features, BINS)
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        cell = _cells(x, self.edges)
        return self.bias + sum(self.weights[k, cell[:, k]] for k in range(x.shape[1]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cells(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[k], x[:, k], "right") for k in range(x.shape[1])], 1) if len(x) else np.zeros(x.shape, np.int64)


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the non-negative risk of cells p and u; with no prior, the plain risk of p against u."""
    k = p.shape[1]
    offset = np.arange(k) * BINS
    w, b = np.zeros(k * BINS), 0.0
    m, v = np.zeros(k * BINS + 1), np.zeros(k * BINS + 1)
    p, u = p + offset, u + offset

    def grad(cells: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(cells.ravel(), np.repeat(g, k), k * BINS), g.sum())

    for step in range(1, STEPS + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(b + w[c].sum(1), -30, 30))) for c in (p, u))
        good = grad(p, (sp - 1) / len(p))  # of the positives' loss as positives
        bad_p, bad_u = grad(p, sp / len(p)), grad(u, su / len(u))  # of their and the others' loss as negatives
        if prior is None:
            g = good + bad_u
        else:
            negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
            g = prior * good + (bad_u - prior * bad_p) if negative >= 0 else -(bad_u - prior * bad_p)
        g[:-1] += RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w.reshape(k, BINS), float(b)


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives in u, from scores that a classifier of p against u gives to texts it hasn't seen."""
    cuts = np.quantile(p, np.linspace(0.02, 0.9, 45))
    share_p, share_u = ((x[None] >= cuts[:, None]).mean(1) for x in (p, u))
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = np.argmin((share_u + slack) / np.maximum(share_p, 1e-9))
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.99))


def learn(p: np.ndarray, u: np.ndarray, prior: float | None = None) -> Model:
    """Fit on features of positives and of unlabelled texts."""
    both = np.concatenate([p, u])
    edges = np.sort(np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T, 1)
    cp, cu = _cells(p, edges), _cells(u, edges)
    if prior is None:
        weights, bias = _descend(cp[::2], cu[::2], None)
        first = Model(edges, weights, bias, 0.5)
        prior = class_prior(first.margin(p[1::2]), first.margin(u[1::2]))
    weights, bias = _descend(cp, cu, prior)
    return Model(edges, weights, bias, prior)


def _sample(docs: DataFrame, most: int, salt: str) -> DataFrame:
    share = min(1.0, most / max(1, docs.count()))
    return docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(share * 1_000_000))


def _collected(texts: DataFrame) -> np.ndarray:
    """The features of a bounded sample's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    rows = texts.select("text").mapInArrow(run, "x binary").toArrow().column("x")
    return np.frombuffer(b"".join(rows.to_pylist()), float).reshape(-1, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, held_out: str = "crc32(cast(doc_id as string)) % 5 = 0", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Learn from docs (doc_id, text), of which labels (doc_id, quality) name trusted ones: quality 1 and not held_out.

    Unlabelled texts are a sample of docs whose labels aren't looked at. Without positives, the model
    gives every text 0.5.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    trusted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    trusted = trusted.filter(f"NOT ({held_out})").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality > 0").select("doc_id")
    trusted = _sample(trusted, most_positive, "positive")
    p = _collected(saved(docs.join(F.broadcast(trusted), "doc_id"), "quality-positive"))
    u = _collected(saved(_sample(docs, most_unlabelled, "unlabelled"), "quality-unlabelled"))
    if len(p) < 4 or len(u) < 4:
        return Model(np.zeros((N_FEATURES, BINS - 1)), np.zeros((N_FEATURES, BINS)), 0.0, 0.5)
    return learn(p, u)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with score (probability of good quality) and predicted, by the whole text.

    Every row is scored, null and empty texts as texts without characters. Other columns come along;
    columns named score and predicted are replaced.
    """
    new = {"score": "double", "predicted": "int"}
    schema = schema_with(docs, new)
    rest = schema.names[:-2]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                good = shared.value.score(features(column(part, "text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(good), pa.array((good >= GOOD_FROM).astype(np.int32))], schema.names)

    return docs.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, with what was learnt from trusted positives that are not held out."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)").alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", "predicted")
