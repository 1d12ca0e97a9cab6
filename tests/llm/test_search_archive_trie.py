"""Ranked search, the archive and the trie against brute force."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from conftest import ALNUM, words
from pyspark.sql import functions as F

from lexweave.llm import prefix_trie, ranked_search, warc_archive

LONG = 10**18


def brute_search(docs, items, k=10):
    sets = [(i, collections.Counter(words(t, ALNUM))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in sets), sum(c.total() for _, c in sets)
    df = collections.Counter(t for _, c in sets for t in c)
    out = []
    for item, text in items:
        rows = []
        for doc, c in sets:
            score = 0
            for t in set(words(text, ALNUM)) & set(c):
                m = 100 - 90 + (90 * c.total() * n_docs) // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                rows.append((-score, LONG if doc is None else doc, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(rows, key=lambda x: x[:2])[:k], 1)]
    return out


def _corpus(rng, n):
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["ÄÖ", "ä1"]
    return [(i, None if i % 50 == 7 else " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 20, 60])))) for i in range(n)]


@pytest.mark.parametrize(("shard", "pilot", "pairs"), [(16_384, 16, 1_000_000), (25, 2, 1_000_000), (40, 1, 60)])
def test_search(spark, table, monkeypatch, shard, pilot, pairs):
    """Few and many shards, a small pilot, and several blocks of queries."""
    for name, value in (("SHARD_DOCS", shard), ("PILOT", pilot), ("MOST_PAIRS", pairs)):
        monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(1)
    docs = _corpus(rng, 400)
    docs += [(i + 1000, t) for i, t in docs[:60]] + [(None, docs[3][1]), (5, docs[5][1]), (7000, " ".join(["w1"] * 300_000) + " selten")]
    items = [(i, t) for i, t in _corpus(rng, 30) if t is None or t] + [(99, "selten W1, w2!"), (98, "nirgends"), (97, ""), (99, "w3")]
    frame = spark.createDataFrame(items, "item_id bigint, text string").withColumn("score", F.lit("x"))
    got = ranked_search.search(table(docs), frame)
    rows = sorted(((r.item_id, r.rank, LONG if r.doc_id is None else r.doc_id, r.score) for r in got.collect()))
    assert rows == sorted((i, r, LONG if d is None else d, s) for i, r, d, s in brute_search(docs, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_of_nothing(spark, table):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert ranked_search.search(table([(1, "a")]).limit(0), items).count() == 0
    assert ranked_search.search(table([(1, "a")]), items.limit(0)).count() == 0


def test_accumulators_are_limited_and_exact():
    """Against all scores, over random lists with a floor; and few accumulators are made where one rare term decides."""
    rng = np.random.default_rng(7)
    for trial in range(200):
        size, k = 60, 5
        weights = np.sort(rng.integers(1, 50, rng.integers(1, 8)))[::-1]
        lists = []
        for _ in weights:
            places = np.sort(rng.choice(size, rng.integers(1, size), replace=False))
            lists.append((places, rng.integers(1, 9, len(places))))
        scores = np.zeros(size, np.int64)
        for w, (places, impacts) in zip(weights, lists, strict=True):
            scores[places] += w * impacts
        floor = int(rng.choice([0, np.sort(scores)[-k], scores.max()]))
        kth = np.sort(scores)[-k]
        found, got = ranked_search.accumulate(weights, lists, size, floor, k)
        assert (scores[found] == got).all(), trial
        assert set(np.flatnonzero((scores >= max(kth, floor, 1)))) <= set(found), trial


def brute_archive(pages, least=0):
    first = {}
    for at, (page, _, html) in enumerate(pages):
        first[html or ""] = min(first.get(html or "", (True, LONG, at)), (page is None, LONG if page is None else page, at))
    rows = []
    for at, (page, _, html) in enumerate(pages):
        data = (html or "").encode()
        own = len(data) < least or first[html or ""][2] == at
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        rows.append((page, data, digest, "response" if own else "revisit"))
    return rows


PAGES = [
    (3, "http://a/1", "gleich"), (1, "http://a/2", "gleich"), (2, "http://a/ä b\r\nWARC-Type: x", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"), (4, None, None), (5, "", ""),
    (1, "http://a/3", "gleich"), (None, "http://a/4", "allein"), (6, "http://a/5", "ä€\U0001f600\n" * 30_000), (None, "http://a/6", "gleich"), (7, "u", "kurz"), (8, "u", "kurz"),
]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "pages.parquet")
    spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "'x' AS digest", "1 AS payload", "2 AS kind", "3 AS header").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("least", [0, 5])
def test_archive(spark, tmp_path, pages, least):
    archive = warc_archive.Archive(spark, str(tmp_path / "archive"), 3)
    archive.write(pages, least)
    want = brute_archive(PAGES, least)
    key = lambda rows: sorted(rows, key=str)
    got = warc_archive.parsed(archive.records()).collect()
    assert key((r.page_id, r.payload_digest, r.kind) for r in got) == key((p, d, k) for p, _, d, k in want)
    assert key((r.page_id, bytes(r.payload)) for r in got if r.kind == "response") == key((p, b) for p, b, _, k in want if k == "response")
    assert all(not r.payload for r in got if r.kind == "revisit")
    assert archive.payloads().count() == len({b for _, b, _, _ in want if len(b) >= least})
    assert {r.uri for r in got if r.page_id == 2} == {"http://a/%C3%A4%20b%0D%0AWARC-Type:%20x".replace("%C3%A4", "ä")}


def test_archive_files(spark, tmp_path, pages):
    archive = warc_archive.Archive(spark, str(tmp_path / "archive"), 3)
    archive.write(pages)
    want = sorted(bytes(r.record) for r in archive.records().collect())
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        warc_archive.write_warc(archive.records().repartition(2), path, compression)
        assert sorted(bytes(r.record) for r in warc_archive.read_warc(spark, path).collect()) == want


def test_damaged_payloads_are_found(spark, tmp_path, pages):
    archive = warc_archive.Archive(spark, str(tmp_path / "archive"), 3)
    archive.write(pages)
    records = archive.responses()
    broken = records.withColumn("record", F.expr("concat(substring(record, 1, octet_length(record) - 1), X'00')"))
    with pytest.raises(Exception, match="digest"):
        warc_archive.parsed(broken.filter("page_id = 7")).select("payload").collect()
    with pytest.raises(Exception, match="Content-Length"):
        warc_archive.parsed(records.withColumn("record", F.expr("concat(record, X'00')"))).select("payload").collect()


def test_archive_of_nothing(spark, tmp_path, pages):
    archive = warc_archive.Archive(spark, str(tmp_path / "archive"), 3)
    archive.write(pages.limit(0))
    assert archive.records().count() == 0


def brute_trie(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        seq = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), LONG if not p else min(members[p[:-1]]), len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def _conversations(rng, n):
    rows = []
    for c in range(n):
        c = c * 7 - 350
        for t in range(rng.choice([1, 2, 3, 9])):
            rows.append((c, None if rng.random() < 0.05 and t == 0 else t, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "ä€", None, "x" * 40])))
    many = [(10_000 + c, t, "user", "gleich") for c in range(150) for t in range(8)]
    deep = [(20_000 + c, t, "bot", "tief" if t < c else f"ab {c}") for c in range(40) for t in range(c + 2)]
    return rows + many + deep + [(None, 0, "user", "niemand")]


@pytest.mark.parametrize(("most", "chunk"), [(1000, 1 << 16), (3, 40), (1, 1)])
def test_trie(spark, monkeypatch, most, chunk):
    """Hundreds of equal conversations, prefixes that branch at every depth, and containers of one sequence."""
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = _conversations(random.Random(3), 120)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'x' AS name", "1 AS at", "2 AS key", "3 AS depth").repartition(5)
    got = prefix_trie.trie(df, most)
    assert sorted((r.conv_id, r.depth, LONG if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got.collect()) == brute_trie(rows)


def test_trie_of_repeated_rows_and_nothing(spark):
    rows = [(100, 0, "u", "a"), (100, 0, "u", "a"), (100, 0, "a", "u"), (200, 1, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = prefix_trie.trie(df)
    assert got.filter("depth > 0").count() == 4 and got.agg(F.max("depth")).first()[0] == 3
    assert prefix_trie.trie(df.limit(0)).count() == 0


def test_trie_has_one_long_conversation(spark):
    df = spark.range(60_000).select(F.lit(100).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.lit("t").alias("text"))
    got = prefix_trie.trie(df)
    assert got.count() == 60_001 and got.agg(F.max("depth"), F.sum("saved_tokens")).first() == (60_000, 0)
