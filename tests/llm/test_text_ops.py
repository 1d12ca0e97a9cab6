import hashlib
import random
import time

import numpy as np
import pytest
import tiktoken
from conftest import ALNUM, words

import public_tokenizers
from lexweave.llm import byte_bpe, decontaminate, license_scan, url_filter

EDGE = [(None, None), (1, ""), (2, "x " * 60000), (2, "x " * 60000)]


def test_license_scan_of_a_very_long_text(spark, table):
    """A text costs its length: a million words take seconds, where carrying the words along with each place took minutes."""
    began = time.time()
    row = license_scan.scan(table([(1, "wort " * 1_000_000 + "all rights reserved")])).first()
    assert (row.n_words, row.n_base, row.first_word, row.labels) == (1_000_003, 1, 1_000_000, "reserved") and time.time() - began < 60


def test_license_base_places(spark, table):
    rnd = random.Random(8)
    vocabulary = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x", "CC-BY", "é"]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 80)))) for i in range(80)] + EDGE
    rows.append((90, "text\nThis work is licensed under the GNU General Public License, version 3.\nmore"))
    rows.append((91, "permission is hereby granted free of charge to any nice person obtaining a copy of this software and documentation files"))
    got = sorted(license_scan.scan(table(rows)).collect(), key=lambda r: (r.doc_id or -1, r.n_words))
    assert len(got) == len(rows)
    for r, (i, text) in zip(got, sorted(rows, key=lambda x: (x[0] or -1, len(words(x[1], ALNUM)))), strict=True):
        w = words(text, ALNUM)
        places = [(k, label) for phrase, label in license_scan.PHRASES.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
        starts = [k for k, _ in places]
        want = (i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[90].labels == "gpl,gpl-3.0" and by[91].labels == "mit" and by[91].base_labels == ""
    assert license_scan.scan(table([])).count() == 0


def test_url_filter(spark):
    urls = [
        (1, "https://WWW.Example.com/en/1"), (2, "http://a.example.com/en/1?x=1"), (3, "http://a.example.com/en"), (4, "http://b.net/es/1"), (5, "http://b.net/de/1"), (6, None), (7, "no url"),
        (8, "http://plain.org/a#f"), (9, "http://alias.org/x?utm_source=f"), (9, "http://alias.org/x?utm_source=f"), (10, "http://c.org/y"), (11, "x://net/fr/"), (12, "http://mynet/es/1"),
    ]
    pages = spark.createDataFrame(urls, "page_id bigint, url string").selectExpr("*", "'h' AS host", "1 AS node")
    edges = spark.createDataFrame([("http://alias.org/x", "http://b.net/fr/9"), ("http://alias.org/x", "http://d.org/z"), ("http://c.org/y", "http://b.net/fr/8"), ("http://c.org/y", "http://www.example.com/en/2")], "a string, b string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages, edges, rules).collect()}
    want = {1: ("www.example.com/en/", "allow"), 2: ("example.com/en/", "block"), 3: ("com/", "allow"), 4: ("net/es/", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "block"), 10: (None, "allow"), 11: ("net/fr/", "block"), 12: (None, "allow")}
    assert {k: (r.rule, r.verdict) for k, r in got.items()} == want
    assert (got[1].host, got[1].path, got[6].host, got[7].path) == ("www.example.com", "/en/1", "", "")
    assert url_filter.judge(pages, edges, rules).count() == len(urls)
    assert url_filter.judge(pages.limit(0), edges, rules).count() == 0
    assert url_filter.judge(pages, edges.limit(0), rules.limit(0)).filter("verdict = 'block'").count() == 0


def test_alias_edges(spark):
    html = "<html><link href='http://a.org/1' rel='canonical'><link rel=canonical href='../up?q#f'><link rel=canonical href=/root><link rel=canonical href='//o.org/x'><link rel=canonical href='mailto:x'><link rel='canonical' href='a/./b'><meta content='0; url=http://b.org/2' http-equiv=refresh></html>"
    pages = spark.createDataFrame([(1, "http://x.org/d/e/f?g", html), (2, "http://y.org/", None), (3, None, html), (4, "no url", "<link rel=canonical href=x>")], "page_id bigint, url string, html string")
    got = url_filter.alias_edges(pages).collect()
    want = ["http://a.org/1", "http://b.org/2", "http://o.org/x", "http://x.org/d/e/a/b", "http://x.org/d/up?q#f", "http://x.org/root"]
    assert sorted(r.b for r in got) == want and {r.a for r in got} == {"http://x.org/d/e/f?g"}


def test_url_filter_on_graphs(spark):
    """Random redirect graphs against a search from every page."""
    rnd = random.Random(16)
    hosts = ["a.org", "b.net", "www.example.com", "example.com", "c.org", "x.example.com"]
    urls = sorted({f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'es', 'de', 'fr'])}/{rnd.randrange(20)}" for _ in range(150)})
    edges = [(rnd.choice(urls), rnd.choice(urls)) for _ in range(70)]
    near = {u: {u} for u in urls}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)

    def own(url):
        host, path = url[7:].split("/", 1)
        fits = [(len(rule), verdict) for verdict, rule in url_filter.RULES for h, _, p in [rule.partition("/")] if (host == h or host.endswith("." + h)) and ("/" + path).startswith("/" + p)]
        return max(fits)[1] if fits else None

    want = {}
    for u in urls:
        seen, todo = {u}, [u]
        while todo:
            for v in near[todo.pop()] - seen:
                seen.add(v)
                todo.append(v)
        votes = {own(v) for v in seen}
        want[u] = own(u) or ("block" if "block" in votes and "allow" not in votes else "allow")
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id bigint, url string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, rule string")
    got = {urls[r.page_id]: r.verdict for r in url_filter.judge(pages, spark.createDataFrame(edges, "a string, b string"), rules).collect()}
    assert got == want and sum(own(u) is None and v == "block" for u, v in want.items()) > 3


def test_byte_bpe(spark, table):
    tokens = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    texts = [None, "", "Hello  world's\n\n x", "日本語 🎉🎉", "a" * 5000, " \t " * 40, "é\x00\x01 \u2028 ß'LL", "word " * 30000, "<|endoftext|>"]
    docs = table([*enumerate(texts), (None, "x"), (0, "Zwei")])
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs, tokens).collect() if r.doc_id}
    for i, text in enumerate(texts):
        if i:
            ids = np.array(own.encode_ordinary(text or ""), "<u4").tobytes()
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    back = byte_bpe.decode(byte_bpe.encode(docs, tokens), tokens)
    assert back.count() == len(texts) + 2 and all(bytes(r.decoded).decode() == (r.text or "") for r in back.collect())
    assert byte_bpe.round_trip(table([]), tokens).count() == 0


def test_missing_ranks(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"YQ== 0\nYg== 1\nYWI= 3\n")
    tokens = byte_bpe.read_ranks(str(path))
    codec = byte_bpe.Codec(tokens, ".+")
    assert tokens == [b"a", b"b", b"", b"ab"] and codec.decode(codec.encode(["aab"])[0]) == b"aab"
    assert list(np.frombuffer(codec.encode(["aab"])[0], "<u4")) == [0, 3]


@pytest.fixture
def items(spark):
    rnd = random.Random(9)
    rows = [(k, " ".join(f"t{rnd.randrange(10**6)}" for _ in range(rnd.choice([4, 6, 9, 15, 40])))) for k in range(30)] + [(99, None), (98, ""), (3, "doppelt " * 9)]
    return rows, spark.createDataFrame(rows, "item_id bigint, text string").selectExpr("*", "1 AS words")


def test_decontaminate(spark, table, items):
    rows, frame = items
    rnd = random.Random(10)
    docs, want = [], set()
    for i in range(120):
        text = [f"d{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 90))]
        if i % 3 == 0:
            key, item = rnd.choice(rows[:30])
            w = item.upper().split()
            for k in rnd.sample(range(len(w)), len(w) // 10):
                w[k] = "ersetzt"
            text[len(text) // 2 : len(text) // 2] = [", ".join(w)]
            want.add((i, key))
        docs.append((i, " ".join(text)))
    docs += EDGE
    got = decontaminate.find_passages(table(docs), frame).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    by = {i: words(t, ALNUM) for i, t in docs}
    own = {i: words(t, ALNUM) for i, t in rows[:30]}
    for r in got:
        assert r.matched == max(sum(0 <= o + k < len(by[r.doc_id]) and by[r.doc_id][o + k] == w for k, w in enumerate(own[r.item_id])) for o in range(-len(own[r.item_id]), len(by[r.doc_id])))
    kept = decontaminate.drop_contaminated(table(docs), frame)
    assert kept.count() == len(docs) - len({i for i, _ in want}) and kept.first().score == "x"
    assert decontaminate.find_passages(table([]), frame).count() == 0
    assert decontaminate.find_passages(table(docs), frame.limit(0)).count() == 0


def test_decontaminate_at_share(spark, table):
    """Copies with up to half of their words replaced, at random and in regular patterns, against brute force."""
    rnd = random.Random(12)
    items = [(k, [f"t{rnd.randrange(10**6)}" for _ in range(n)]) for k, n in enumerate([9, 10, 13, 16, 17, 20, 24, 40, 59] * 2)]
    docs = []
    for key, item in items:
        n = len(item)
        least = max(8, -(-n // 2))
        for gone in (range(1, n, 2), range(0, n, 5), [n // 2], *(rnd.sample(range(n), n - least + late) for late in (0, 0, 0, 1))):
            gone = set(list(gone)[: n - least] if isinstance(gone, range) else gone)
            lead = [f"d{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 30))]
            docs.append((len(docs), " ".join([*lead, *(f"r{rnd.randrange(10**6)}" if k in gone else w for k, w in enumerate(item)), *lead])))
    want = set()
    for i, text in docs:
        w = text.split()
        for key, item in items:
            best = max(sum(w[o + k] == x for k, x in enumerate(item) if 0 <= o + k < len(w)) for o in range(-len(item), len(w)))
            if best >= max(8, len(item) / 2):
                want.add((i, key, best))
    frame = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.matched) for r in decontaminate.find_passages(table(docs), frame).collect()}
    assert got == want and len(want) == len(docs) * 6 // 7


def test_decontaminate_parts(spark, table):
    """Pieces of long items, some with words replaced, against a search at all offsets."""
    rnd = random.Random(15)
    items = [(k, [f"t{rnd.randrange(10**6)}" for _ in range(n)]) for k, n in enumerate([1, 2, 3, 7, 70, 150, 400])]
    docs = []
    for _ in range(60):
        _, item = items[rnd.randrange(4, 7)]
        a, n = rnd.randrange(len(item)), rnd.choice([25, 29, 30, 35, 60, 150])
        piece = [w if rnd.random() > share else "neu" for share in [rnd.choice([0, 0, 0.05, 0.2])] for w in item[a : a + n]]
        docs.append((len(docs), " ".join([*(f"d{rnd.randrange(10**6)}" for _ in range(rnd.randrange(30))), *piece, "ende"])))
    docs += [(100 + k, "a " + " ".join(item) + " b") for k, item in items[:4]]
    want = set()
    for i, text in docs:
        w = text.split()
        for key, item in items:
            found = []
            for o in range(-len(item), len(w)):
                same = [w[o + k] == x for k, x in enumerate(item) if 0 <= o + k < len(w)]
                here = top = 0
                for x in same:
                    here = max(0, here + (1 if x else -2))
                    top = max(top, here)
                if sum(same) >= min(len(item), max(8, len(item) / 2)) or top >= 30:
                    found.append((sum(same), -o, top))
            if found:
                want.add((i, key, *max(found)))
    frame = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.matched, -r.first_word, r.stretch) for r in decontaminate.find_passages(table(docs), frame).collect()}
    assert got == want and 10 < len(want) < len(docs)
