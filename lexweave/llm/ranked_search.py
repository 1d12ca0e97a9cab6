"""Ranked lexical search by accumulator-limited term-at-a-time evaluation.

One pass over the texts writes an inverted index of the query terms in shards of documents: for each
term of a shard its documents and their counts. A shard is evaluated by one task, for all queries: a
query's terms come rarest first, and each adds to the accumulators of its documents. Once the bounds of
the terms left can't lift a new document to the k-th best partial score, no accumulators are created
any more; those that can still reach it are kept up to date exactly, the others are given up.

A few pilot shards are evaluated first. Any k documents bound the k-th best score from below, so their
k-th scores are a floor for all shards, which then return few documents each, whatever their number.
Only bounds come from the pilot: every shard is evaluated, and ties at the floor are kept.

Terms are compared by 64-bit hashes: one of v query terms is mistaken for one of n words with a chance
of about v * n / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.shared import ROW, forget, numbered, saved, small_batches
from lexweave.llm.words import NOT_ALNUM, hashed

#: Documents and postings at which a task closes a shard; some 20 MB.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1 << 20
#: Shards that give the floor of scores.
PILOT = 16
#: Pairs of a query and a term that are evaluated at a time (16 MB); more queries take further passes.
MOST_PAIRS = 1_000_000

_SHARD = "shard bigint, n_docs bigint, n_terms bigint, ids binary, known binary, sizes binary, terms binary, starts binary, places binary, counts binary"


@dataclass(frozen=True)
class Queries:
    """A block of queries: rows, and from ``starts`` on the places of their terms in the vocabulary, rarest first, with weights."""

    rows: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    n_docs: int
    n_terms: int


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ROW, text) -> (ROW, term), a row for each different term."""
    for batch in batches:
        rows = batch.column(ROW).to_numpy()
        for at, words, bounds in hashed(batch.column("text"), NOT_ALNUM):
            own = [np.unique(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows[at : at + len(own)], [len(x) for x in own])), pa.array(np.concatenate(own).view(np.int64))], [ROW, "term"])


def _shard(first: int, ids: list[pa.Array], sizes: list[np.ndarray], parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """One shard as a row, its postings sorted by term and then document."""
    key = pa.concat_arrays(ids)
    size = np.concatenate(sizes)
    term, place, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(term, kind="stable")
    terms, starts = np.unique(term[order], return_index=True)
    blobs = [key.fill_null(0).to_numpy(), key.is_valid().to_numpy(zero_copy_only=False), size, terms.astype(np.int32), np.append(starts, len(order)), place[order].astype(np.int32), count[order].astype(np.int32)]
    values = [pa.array([x], pa.int64()) for x in (first, int((size > 0).sum()), int(size.sum()))] + [pa.array([x.tobytes()], pa.binary()) for x in blobs]
    return pa.RecordBatch.from_arrays(values, [x.split()[0] for x in _SHARD.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(ROW, doc_id, text) -> shards; a term is named by its place in the sorted vocabulary."""
    first, ids, sizes, parts, docs, postings = None, [], [], [], 0, 0
    for batch in batches:
        for at, words, bounds in hashed(batch.column("text"), NOT_ALNUM):
            m = len(bounds) - 1
            first = batch.column(ROW)[at].as_py() if first is None else first
            place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            wanted = vocabulary[place] == words
            pairs, count = np.unique(place[wanted] * m + np.repeat(np.arange(m), np.diff(bounds))[wanted], return_counts=True)
            ids.append(batch.column("doc_id")[at : at + m])
            sizes.append(np.diff(bounds).astype(np.int64))
            parts.append((pairs // m, pairs % m + docs, count))
            docs, postings = docs + m, postings + len(pairs)
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield _shard(first, ids, sizes, parts)
                first, ids, sizes, parts, docs, postings = None, [], [], [], 0, 0
    if docs:
        yield _shard(first, ids, sizes, parts)


def _frequencies(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(terms, starts) of shards -> (place, df)"""
    df = np.zeros(size, np.int64)
    for batch in batches:
        for terms, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
            df[np.frombuffer(terms.as_buffer(), np.int32)] += np.diff(np.frombuffer(starts.as_buffer(), np.int64))
    found = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(df[found])], ["place", "df"])


def accumulate(weights: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], size: int, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the documents, among ``size``, that may be among the k best and reach ``floor`` (1 at least).

    Each term, rarest first, has a weight and a list (places, impacts); a score is the sum of weight * impact.
    Scores returned are exact, and every document that reaches the floor and belongs to the k best is returned.
    """
    floor, alive, scores = max(floor, 1), None, np.zeros(size, np.int64)
    left = np.append(np.cumsum(np.array([w * x.max() for w, (_, x) in zip(weights, lists, strict=True)], np.int64)[::-1])[::-1], 0)
    for i, (weight, (places, impacts)) in enumerate(zip(weights, lists, strict=True)):
        if alive is None and left[i] < floor:  # a document without an accumulator can't get there
            alive = scores + left[i] >= floor
        if alive is None:
            scores[places] += weight * impacts
            if size >= k:
                floor = max(floor, int(np.partition(scores, size - k)[size - k]))
        else:
            kept = alive[places]
            scores[places[kept]] += weight * impacts[kept]
            alive &= scores + left[i + 1] >= floor
            if not alive.any():
                break
    best = np.flatnonzero(scores >= floor if alive is None else alive & (scores >= floor))
    if len(best) > k:
        best = best[scores[best] >= np.partition(scores[best], len(best) - k)[len(best) - k]]
    return best, scores[best]


def _evaluated(batches: Iterator[pa.RecordBatch], queries: Queries, vocabulary: int, floors: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Shards -> (query, doc_id, score): what each shard has to offer to the k best of each query."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
            starts, places, counts = np.frombuffer(row["starts"], np.int64), np.frombuffer(row["places"], np.int32), np.frombuffer(row["counts"], np.int32).astype(np.int64)
            slot = np.full(vocabulary, -1)
            slot[np.frombuffer(row["terms"], np.int32)] = np.arange(len(starts) - 1)
            measure = 100 - 90 + 90 * np.frombuffer(row["sizes"], np.int64) * queries.n_docs // max(queries.n_terms, 1)
            impacts = 1_000_000_000 * counts // (1000 * counts + 8 * measure[places])
            out: list[tuple[np.ndarray, ...]] = []
            for q in range(len(queries.rows)):
                terms, weights = queries.terms[queries.starts[q] : queries.starts[q + 1]], queries.weights[queries.starts[q] : queries.starts[q + 1]]
                here = (slot[terms] >= 0) & (weights > 0)
                spans = [(starts[s], starts[s + 1]) for s in slot[terms[here]]]
                if not spans:
                    continue
                found, scores = accumulate(weights[here], [(places[a:b], impacts[a:b]) for a, b in spans], len(ids), int(floors[q]), k)
                order = np.lexsort((ids[found], ~known[found], -scores))[:k]
                out.append((np.full(len(order), q), found[order], scores[order]))
            if out:
                q, found, scores = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(ids[found], mask=~known[found]), pa.array(scores)], ["query", "doc_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(docs: DataFrame, queries: DataFrame, terms: pa.Table, k: int) -> DataFrame:
    """(ROW, rank, doc_id, score) of the queries whose terms (ROW, term) are given, as a written table."""
    spark = docs.sparkSession
    words, rows = terms.column("term").to_numpy().view(np.uint64), terms.column(ROW).to_numpy()
    vocabulary, term = np.unique(words, return_inverse=True)
    shared = spark.sparkContext.broadcast(vocabulary)
    shards = saved(docs.mapInArrow(lambda it: _shards(it, shared.value), _SHARD), "search-shards")
    shared.destroy()

    size = len(vocabulary)
    n_docs, n_terms = (x or 0 for x in shards.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    counts = shards.select("terms", "starts").mapInArrow(lambda it: _frequencies(it, size), "place int, df bigint").groupBy("place").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(size, np.int64)
    df[counts["place"].to_numpy()] = counts["df"].to_numpy()
    weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2 * df + 1))).astype(np.int64)

    order = np.lexsort((term, df[term], rows))
    each, starts = np.unique(rows[order], return_index=True)
    block = spark.sparkContext.broadcast(Queries(each, np.append(starts, len(order)), term[order], weights[term[order]], n_docs, n_terms))

    def evaluated(part: DataFrame, floors: np.ndarray) -> DataFrame:
        return part.mapInArrow(lambda it: _evaluated(it, block.value, size, floors, k), "query bigint, doc_id bigint, score bigint")

    none = np.zeros(len(each), np.int64)
    first = [r[0] for r in shards.select("shard").orderBy(F.xxhash64("shard")).limit(PILOT).collect()]
    pilot = saved(evaluated(shards.filter(F.col("shard").isin(first)), none), "search-pilot")
    floors = none.copy()
    for r in _best(pilot, k).filter(F.col("rank") == k).select("query", "score").collect():
        floors[r["query"]] = r["score"]
    rest = evaluated(shards.filter(~F.col("shard").isin(first)), floors)
    names = spark.createDataFrame(pa.table({"query": np.arange(len(each)), ROW: each}))
    out = saved(_best(pilot.unionByName(rest), k).join(F.broadcast(names), "query").select(ROW, "rank", "doc_id", "score"), "search-best")
    forget(shards, pilot)
    block.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs (doc_id, text) for each row of items (item_id, text).

    Terms are the runs of anything but ASCII signs, A-Z lower-cased, of whole texts, however long. Among N
    documents with terms, L terms in all, a term of df documents has the weight
    w = floor(1000 * ln((2N + 2) / (2df + 1))), and a document of n terms, tf times the term, scores
    w * (10**9 * tf div (1000 * tf + 8 * (10 + 90 * n * N div L))) for each different term of the item.
    Ranks begin at 1; equal scores go by ascending doc_id, null last, and rows that agree in both in any
    order. Documents that score 0 aren't listed, so an item without known terms, null and empty texts
    included, has no rows. Repeated rows are documents or items of their own. Other columns are ignored;
    an empty table on either side gives an empty result.
    """
    items = numbered(items)
    pairs = saved(items.select(ROW, F.col("text").cast("string").alias("text")).mapInArrow(_query_terms, f"{ROW} bigint, term bigint"), "search-terms")
    docs = numbered(docs).select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-pairs.count() // MOST_PAIRS))
    found = items.sparkSession.createDataFrame([], f"{ROW} bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        terms = pairs.filter(F.pmod(F.xxhash64(ROW), F.lit(blocks)) == block).toArrow()
        if len(terms):
            found = found.unionByName(_block(docs, items, terms, k))
    forget(pairs)
    return items.select(ROW, "item_id").join(found, ROW).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    small_batches(spark)
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS o, doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS docs, sum(len(t))::BIGINT AS terms FROM d),
q AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
p AS (SELECT o, doc_id, term, n, count(*) AS tf FROM (SELECT o, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
r AS (SELECT item_id, o, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, o, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
