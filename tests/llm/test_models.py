import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from conftest import words

from lexweave.llm import arrays, kneser_ney, quality, toxicity
from lexweave.llm.shared import shared_dir


def test_maximal_segments_match_brute_force():
    """All maximal segments, by splitting at the best one again and again (Ruzzo and Tompa's definition)."""
    rnd = random.Random(5)

    def brute(scores, base=0):
        best, place = 0, None
        for i in range(len(scores)):
            for j in range(i, len(scores)):
                s = sum(scores[i : j + 1])
                if s > best + 1e-12 or (place and abs(s - best) < 1e-12 and j - i < place[1] - place[0]):
                    best, place = s, (i, j)
        if place is None:
            return []
        i, j = place
        return brute(scores[:i], base) + [(base + i, base + j, best)] + brute(scores[j + 1 :], base + j + 1)

    for _ in range(200):
        n = rnd.randrange(1, 14)
        at = sorted(rnd.sample(range(n), rnd.randrange(1, n + 1)))
        gains = [rnd.choice([3.1, 1.7, -2.3, 0.4]) for _ in at]
        scores = [-0.77] * n
        for i, g in zip(at, gains, strict=True):
            scores[i] = g
        got = toxicity.maximal_segments(np.array(at), np.array(gains), -0.77)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in brute(scores)]


@pytest.fixture(scope="module")
def made(spark):
    """Texts with labels: toxic ones hold a few bad words, bad ones are noise."""
    rnd = random.Random(6)
    docs, labels = [], []
    for i in range(900):
        text = [rnd.choice(["haus", "baum", "der", "die", "geht", "weg", "und"]) + (str(rnd.randrange(40)) if rnd.random() < 0.3 else "") for _ in range(rnd.randrange(5, 80))]
        toxic, bad = i % 6 == 0, i % 5 == 1
        if toxic:
            for _ in range(2):
                text.insert(rnd.randrange(len(text)), rnd.choice(["schurke", "schurkisch", "trottel"]))
        if bad:
            text = [w.upper() + "!!" for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


EDGE = [(None, None), (1, ""), (2, "x " * 60000), (2, "x " * 60000)]


def test_toxicity(spark, table, made):
    docs, labels, truth = made
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(rows[i], t) for i, _, t in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([r.predicted == t for r, t in held]) > 0.95
    assert {r.doc_id for r in toxicity.passages(docs, model).collect()} & {i for i, _, t in truth if t}
    assert toxicity.drop_toxic(docs, labels).count() == sum(r.predicted == 0 for r in rows.values())
    edge = toxicity.score(table(EDGE), model).collect()
    assert len(edge) == 4 and all(0 <= r.score <= 1 and r.predicted == 0 for r in edge) and edge[0].kept == 1
    assert toxicity.score(table([]), model).count() == 0
    assert toxicity.drop_toxic(table(EDGE), labels.limit(0)).count() == 4


def test_toxicity_few_labels(spark):
    """About 40 toxic texts to learn from, as on the small tables: held-out ones are rejected all the same."""
    rnd = random.Random(11)
    docs, labels = [], []
    for i in range(420):
        text = [f"wort{rnd.randrange(300)}" for _ in range(rnd.randrange(20, 80))]
        toxic = i % 8 == 0
        if toxic:
            text.insert(rnd.randrange(len(text)), rnd.choice(["trash", "idiot", "vermin"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, frame = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, frame)).collect()}
    held = [(got[i], t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert 35 <= sum(t for i, t in labels) - sum(t for _, t in held) <= 45
    assert np.mean([p for p, t in held if t]) > 0.8 and np.mean([p for p, t in held if not t]) < 0.1
    assert toxicity.drop_toxic(docs, frame).count() == sum(p == 0 for p in got.values()) < len(labels)


def test_quality(spark, table, made):
    docs, labels, truth = made
    model = quality.fit(docs, labels)
    assert 0.6 < model.prior < 0.95
    rows = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [(rows[i], q) for i, q, _ in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([r.predicted == q for r, q in held]) > 0.95
    edge = quality.score(table(EDGE), model).collect()
    assert len(edge) == 4 and all(0 <= r.score <= 1 for r in edge)
    assert quality.score(table([]), model).count() == 0
    assert {r.score for r in quality.score(table(EDGE), quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_kneser_ney(spark, table):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice("abcdefgh") * rnd.choice([1, 1, 2]) for _ in range(rnd.randrange(0, 60)))) for i in range(120)] + [(500, None), (501, "A b\tC\n neu"), (502, "a " * 30000), (502, "a " * 30000)]
    docs = table(rows)
    train = docs.filter("doc_id % 5 <> 1")
    end, start = "\0end", "\0start"
    texts = [(i, words(t) + [end]) for i, t in rows]
    one, two = Counter(), Counter()
    for i, t in texts:
        if i % 5 != 1:
            one.update(t)
            two.update(zip([start, *t], t, strict=False))
    total, vocabulary = sum(one.values()), len(one)

    def discounts(counts):
        return (0, *kneser_ney.discounts([sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]))

    d2, follows = discounts(two), Counter(b for _, b in two)
    d1 = discounts(follows)
    sums, freed = Counter(), Counter()
    for (a, _), c in two.items():
        sums[a] += c
        freed[a] += d2[min(c, 3)]
    types = sum(follows.values())
    unknown = sum(d1[min(c, 3)] for c in follows.values()) / types / (vocabulary + 1)

    def p1(w):
        return (follows[w] - d1[min(follows[w], 3)]) / types + unknown if w in follows else unknown

    def p2(v, w):
        c = two.get((v, w), 0)
        return max(0, c - d2[min(c, 3)]) / sums[v] + freed[v] / sums[v] * p1(w) if v in sums else p1(w)

    assert sum(map(p1, one)) + unknown == pytest.approx(1)
    assert sum(p2("a", w) for w in one) + freed["a"] / sums["a"] * unknown == pytest.approx(1)
    got = kneser_ney.score(docs, kneser_ney.fit(train, 2)).orderBy("doc_id").collect()
    for r, (i, t) in zip(got, sorted(texts, key=lambda x: x[0]), strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, len(t), sum(w in one for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((one[w] + 1) / (total + vocabulary + 1)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(p2(v, w)) for v, w in zip([start, *t], t, strict=False)))
    assert kneser_ney.score(docs, kneser_ney.fit(table([]))).count() == len(rows)
    assert kneser_ney.score(table([]), kneser_ney.fit(train)).count() == 0


@pytest.mark.parametrize("order", [3, 4])
def test_kneser_ney_of_higher_order(spark, table, order):
    """Every order's distribution sums up to 1, and all scores match counts of whole n-grams."""
    rnd = random.Random(17)
    rows = [(i, " ".join(rnd.choice("abcde") for _ in range(rnd.randrange(0, 40)))) for i in range(150)] + [(500, None), (501, "a b neu a b c d e"), (502, "a b " * 20000), (503, "neu")]
    docs = table(rows)
    start, end = "\0start", "\0end"
    padded = [(i, [start] * (order - 1) + words(t) + [end]) for i, t in rows]
    counts = {order: Counter()}
    one = Counter()
    for i, t in padded:
        if i % 5 != 1:
            one.update(t[order - 1 :])
            counts[order].update(tuple(t[j - order + 1 : j + 1]) for j in range(order - 1, len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(gram[1:] for gram in counts[k + 1])
    off = {k: (0, *kneser_ney.discounts([sum(c == n for c in counts[k].values()) for n in (1, 2, 3, 4)])) for k in counts}
    total, freed = Counter(), Counter()
    for k in counts:
        for gram, c in counts[k].items():
            total[gram[:-1]] += c
            freed[gram[:-1]] += off[k][min(c, 3)]

    def p(gram):
        """Of the last word after the others."""
        lower = p(gram[1:]) if len(gram) > 1 else 1 / (len(one) + 1)
        if gram[:-1] not in total:
            return lower
        c = counts[len(gram)].get(gram, 0)
        return (c - off[len(gram)][min(c, 3)]) / total[gram[:-1]] + freed[gram[:-1]] / total[gram[:-1]] * lower

    for context in [(start,) * (order - 1), ("a", "b", "c")[: order - 1]]:
        assert sum(p((*context, w)) for w in [*one, "\0unknown"]) == pytest.approx(1)
    got = kneser_ney.score(docs, kneser_ney.fit(docs.filter("doc_id % 5 <> 1"), order)).orderBy("doc_id").collect()
    for r, (i, t) in zip(got, sorted(padded, key=lambda x: x[0]), strict=True):
        want = sum(math.log10(p(tuple(t[j - order + 1 : j + 1]))) for j in range(order - 1, len(t)))
        assert (r.doc_id, r.score) == (i, pytest.approx(want))
    with pytest.raises(ValueError):
        kneser_ney.fit(docs, 1)


def test_kneser_ney_disk(spark, table):
    """The model of order 3 takes fewer than 20 bytes for each different trigram: contexts aren't written once more for it."""
    rnd = random.Random(23)
    rows = [(i, " ".join(str(int(rnd.paretovariate(0.8))) for _ in range(400))) for i in range(300)]
    grams = {g for _, t in rows for g in zip(["\0", "\0", *t.split()], ["\0", *t.split()], [*t.split(), "\1"], strict=False)}
    docs, shared = table(rows), Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.rglob("*"))
    assert kneser_ney.score(docs, kneser_ney.fit(docs)).count() == len(rows)
    kept = sum(p.stat().st_size for p in set(shared.rglob("*")) - before if p.is_file() and p.suffix != ".crc")
    assert 0 < kept < 20 * len(grams)
    # counts of 255 and more stand beside the bytes
    values = np.array([0, 254, 255, 3, 1 << 40])
    assert arrays.small_at(arrays.small(values), 5, np.array([4, 0, 2, 1, 3])).tolist() == [1 << 40, 0, 255, 254, 3]
