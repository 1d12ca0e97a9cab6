import hashlib
import random
import time
from collections import defaultdict

import pytest
from conftest import AZ, words
from pyspark.sql import functions as F

from lexweave.llm import exact_dedup, line_dedup, minhash_dedup, shared
from lexweave.llm.shared import ROW, components, numbered

EDGE = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (4, "a B"), (None, "a b"), (5, "É"), (6, "é"), (7, "word " * 30000), (8, "word " * 30000), (9, "one"), (10, " \n\t ")]


def test_exact(spark, table):
    got = exact_dedup.deduplicate(table(EDGE), exact_dedup.DigestIndex(spark, "t_exact"))
    assert {"score", "row_nr", "n", "cls"} <= set(got.columns)
    rows = got.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256((r.text or "").translate(AZ).encode()).digest()].append(r)
    assert len(rows) == len(EDGE)
    for digest, own in groups.items():
        assert {bytes(r.digest) for r in own} == {digest}
        assert {r.group_size for r in own} == {len(own)} and sum(r.kept for r in own) == 1
        last = max((r.doc_id for r in own if r.doc_id is not None), default=None)
        assert {r.keep_id for r in own} == {last}


def test_exact_against_earlier_batches(spark, table):
    index = exact_dedup.DigestIndex(spark, "t_batches", buckets=4)
    first = table([(1, "a"), (2, "b")])
    assert exact_dedup.drop_exact_duplicates(first, index, "one").count() == 2
    assert exact_dedup.drop_exact_duplicates(first, index, "one").count() == 2  # the same batch again
    assert exact_dedup.drop_exact_duplicates(first, index).count() == 0  # the same rows in another batch
    assert [r.kept for r in exact_dedup.deduplicate(table([(1, "A"), (None, "b")]), index).collect()] == [False, False]
    new = exact_dedup.drop_exact_duplicates(table([(9, "A"), (8, "c"), (7, "C")]), index)
    assert [(r.doc_id, r.text, r.score) for r in new.collect()] == [(8, "c", "x")]
    assert index.read().count() == 3
    text = index.read().join(index.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text  # bucketed on both sides
    assert exact_dedup.deduplicate(table([]), index).count() == 0


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_components(rows, width):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                both = len(x & y)
                if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
                    label[i] = label[j] = min(label[i], label[j])
    return sets, label


def noisy(base, share, rnd):
    return " ".join(rnd.choice(["neu", "alt", "rot"]) + str(rnd.randrange(99)) if rnd.random() < share else w for w in base)


def test_near(spark, table):
    rnd = random.Random(3)
    rows = []
    for g in range(6):
        base = [f"w{g}_{rnd.randrange(500)}" for _ in range(rnd.choice([3, 12, 60, 150]))]
        rows += [(len(rows) + k, noisy(base, rnd.choice([0, 0.01, 0.03, 0.08]), rnd)) for k in range(14)]
    rows += [(900, None), (901, ""), (902, "Solo"), (903, "solo"), (904, "ab cd"), (905, "cd ab"), (906, "x " * 40000), (906, "x " * 40000)]
    sets, label = brute_components(rows, 2)
    want = sorted((i, len(s), rows[k][0]) for (i, _), s, k in zip(rows, sets, label, strict=True))
    got = minhash_dedup.near_duplicates(table(rows), width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_large_group(spark, table):
    """Many near copies of one text, of which some are linked with none: every link is found, no other is made."""
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(70)]
    rows = [(k, noisy(base, rnd.choice([0.01, 0.04, 0.07, 0.1]), rnd)) for k in range(150)]
    sets, label = brute_components(rows, 2)
    got = minhash_dedup.near_duplicates(table(rows), width=2).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, rows[k][0]) for (i, _), k in zip(rows, label, strict=True)}
    assert 10 < len(set(label)) < 140


def test_near_edges(spark, table):
    got = minhash_dedup.near_duplicates(table([(None, "a b c d e f"), (None, "a b c d e f"), (None, None)]), width=5).collect()
    assert [r.component_id for r in got] == [None] * 3 and sum(r.kept for r in got) == 2
    assert minhash_dedup.near_duplicates(table([])).count() == 0
    kept = minhash_dedup.drop_near_duplicates(table([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)])).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3] and kept[0].score == "x"


def test_lines(spark, table):
    rnd = random.Random(4)
    lines = [" ".join(f"v{rnd.randrange(400)}" for _ in range(rnd.choice([1, 4, 6, 20, 60]))) for _ in range(25)]
    rows = [(k, "\n".join(noisy(rnd.choice(lines).split(), rnd.choice([0, 0, 0.05, 0.15]), rnd) for _ in range(rnd.choice([0, 1, 6])))) for k in range(60)]
    rows += [(100, None), (None, "a b c d e f"), (101, "A b c d e f\n\nf e d c b a"), (102, "long " * 20000 + "\nshort"), (103, rows[1][1])]
    seen, want = [], {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for no, line in enumerate((text or "").split("\n")):
            s = set(words(line))
            want[key, no] = bool(s) and any(9 * len(s & t) >= 4 * (len(s) + len(t)) for t in seen)
            seen.append(s)
    docs = table(rows)
    assert {(r.doc_id, r.line_no): r.removed for r in line_dedup.find_repeats(docs).collect()} == want
    cleaned = {r.doc_id: r.text for r in line_dedup.drop_repeats(docs).collect()}
    assert cleaned[101] == "\n" if want[101, 2] and want[101, 0] else cleaned[101]
    assert cleaned[100] is None
    assert line_dedup.find_repeats(table([])).count() == 0


def brute_repeats(rows, least=1):
    seen, want = [], {}
    for key, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            s = set(words(line))
            want[key, no] = len(s) >= least and any(9 * len(s & t) >= 4 * (len(s) + len(t)) for t in seen)
            if len(s) >= least:
                seen.append(s)
    return want


def test_short_lines(spark, table):
    """Repeats of lines of one to four words go as well, and lines without words stay."""
    rnd = random.Random(13)
    rows = [(k, "\n".join(" ".join(rnd.choice("abcdefghijk") for _ in range(rnd.choice([0, 1, 2, 3, 4, 6]))) for _ in range(5))) for k in range(30)]
    want = brute_repeats(rows)
    docs = table(rows)
    assert {(r.doc_id, r.line_no): r.removed for r in line_dedup.find_repeats(docs).collect()} == want
    assert {(r.doc_id, r.line_no): r.removed for r in line_dedup.find_repeats(docs, least=5).collect()} == brute_repeats(rows, 5)
    assert any(want.values()) and line_dedup.drop_repeats(table([(1, "Of.\nx"), (2, "of.\n\ny")])).orderBy("doc_id").collect()[1].text == "\ny"


def test_large_buckets(spark, table, monkeypatch):
    """A group of near copies beyond LARGE, dealt over several tasks, loses nothing."""
    monkeypatch.setattr(line_dedup, "LARGE", 4)
    monkeypatch.setattr(line_dedup, "TASK_ROWS", 7)
    rnd = random.Random(14)
    base = [f"b{k}" for k in range(30)]
    rows = [(k, noisy(base, rnd.choice([0.02, 0.1, 0.2, 0.3]), rnd)) for k in range(120)]
    assert {(r.doc_id, r.line_no): r.removed for r in line_dedup.find_repeats(table(rows)).collect()} == brute_repeats(rows)


def test_lines_clashing_columns(spark, table):
    docs = table([(1, "a b\na b"), (2, None), (3, "")]).selectExpr("doc_id", "text AS TEXT", "1 AS gone_", "2 AS line_no", "3 AS n", "4 AS removed")
    got = {r.doc_id: r for r in line_dedup.drop_repeats(docs).collect()}
    assert got[1].TEXT == "a b" and got[2].TEXT is None and got[3].TEXT == "" and got[1].gone_ == 1 and got[1].removed == 4
    assert line_dedup.drop_repeats(docs.filter("doc_id > 9")).columns == docs.columns


def test_numbered(spark, table):
    docs = table([(k, "x\ny") for k in range(20)])
    for df in (docs, docs.select("doc_id"), docs.filter("doc_id > 3"), docs.selectExpr("doc_id", "explode(split(text, 'x')) AS text"), docs.join(docs.select("doc_id"), "doc_id"), docs.unionByName(docs), docs.orderBy("text").limit(5)):
        got = numbered(df)
        assert got.select(ROW).distinct().count() == df.count() == got.count()
    with pytest.raises(ValueError):
        numbered(docs.withColumnRenamed("score", ROW))


def test_saved_stages_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark._jsparkSession.sparkContext().env().blockManager().diskBlockManager().getAllFiles()
        return {f for f in str(files.mkString("\n")).split("\n") if "shuffle_" in f}

    before = shuffled()
    table = shared.saved(spark.range(20_000).groupBy((F.col("id") % 999).alias("k")).count(), "counts")
    end = time.time() + 20  # files go in the background
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before
    assert table.count() == 999
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_line_sets_meet_their_likeliest_first(spark, monkeypatch):
    """Of many alike earlier lines a line meets one, and the others only where that one isn't similar enough."""
    words = [f"w{k}" for k in range(20)]
    rows = [(k, " ".join([*words, f"own{k}"])) for k in range(30)] + [(99, "quite another line of five")]
    seen, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, sets: seen.append(pairs.count()) or verified(pairs, sets))
    got = {r.doc_id: r.removed for r in line_dedup.find_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {k: 0 < k < 99 for k, _ in rows}
    assert sum(seen) == 29


def test_near_plans_are_small(spark, table, monkeypatch):
    """No written step of near_duplicates plans more than 12 exchanges: the driver's memory grows with its plans."""
    rnd, planned, write = random.Random(31), [], shared.saved
    base = [f"w{rnd.randrange(5000)}" for _ in range(60)]
    rows = [(i, " ".join(base) if i % 3 else noisy(base, 0.03, rnd)) for i in range(60)] + [(100 + i, f"other text {i} {i * i} {i % 7}") for i in range(60)]

    def saved(df, name):
        planned.append((df._jdf.queryExecution().executedPlan().toString().count("Exchange "), name))
        return write(df, name)

    monkeypatch.setattr(shared, "saved", saved)
    monkeypatch.setattr(minhash_dedup, "saved", saved)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(table(rows), 2).collect()}
    assert got == {i: rows[k][0] for (i, _), k in zip(rows, brute_components(rows, 2)[1], strict=True)}
    assert max(planned)[0] <= 12, planned
