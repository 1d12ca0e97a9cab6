"""Operators that split large groups, against brute force."""

import difflib
import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexweave import stages
from lexweave.functions.scalars import normalized
from lexweave.operators import duplicates, event_stats, graph, ordered, titles
from lexweave.search import index, stems


def test_components_of_chains_and_stars(spark):
    chain = spark.range(9_999).select((F.col("id") + 7).alias("a"), (F.col("id") + 8).alias("b"))
    star = spark.range(1, 1_000_001).select((F.col("id") + 2_000_000).alias("a"), F.lit(2_000_000).cast("long").alias("b"))
    odd = spark.createDataFrame([(1, 1), (None, 2), (3, None)], "a bigint, b bigint")
    found = graph.components(chain.unionByName(star).unionByName(odd))
    sizes = {r["group"]: (r.n, r.least) for r in found.groupBy("group").agg(F.count("*").alias("n"), F.min("id").alias("least")).collect()}
    assert sizes == {7: (10_000, 7), 2_000_000: (1_000_001, 2_000_000)}


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(330)]
    group = {x: x for e in edges for x in e}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        group[high] = low
    want = {x: top(x) for a, b in edges if a != b for x in (a, b)}
    got = graph.components(spark.createDataFrame(edges, "a string, b string"))
    assert {r.id: r["group"] for r in got.collect()} == want
    assert graph.components(spark.createDataFrame([("x", "x")], "a string, b string")).count() == 0


def test_stars_of_first_ids_go_in_one_round(spark, monkeypatch):
    names, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: names.append(name) or written(df, name))
    links = spark.range(1000).select((F.col("id") - F.col("id") % 100).alias("a"), F.col("id").alias("b"))
    got = {r.id: r["group"] for r in graph.components(links).collect()}
    assert got == {k: k - k % 100 for k in range(1000)} and names.count("graph-names") == 1


def test_titles_are_normalised_once(spark):
    df = spark.createDataFrame([(1, "Urteil A", "BGH"), (2, "urteil a!", "BGH"), (3, "Urteil A", "BGH"), (4, "Urteil A", "LG Bonn"), (5, None, "BGH"), (6, "?", "BGH"), (7, "Urteil A", None)], "id bigint, title string, court string")
    once = titles.titles_once(df)
    assert sorted((r.title, r.norm, r.id) for r in once.collect()) == [("Urteil A", "urteil a", 1), ("Urteil A", "urteil a", 4), ("urteil a!", "urteil a", 2)]
    assert sorted(r.id for r in titles.distinct_titles(once).collect()) == [1, 4]
    cases = df.withColumns({"case_number": F.lit(None).cast("string"), "decision_date": F.lit(None).cast("timestamp_ntz")})
    assert sorted((r.a, r.b) for r in duplicates.find_duplicates(cases).collect()) == [(1, 2), (1, 3)]


def test_title_join_loses_no_pair(spark):
    rng = random.Random(3)
    words = ["Entscheidung", "Bußgeld", "Müller", "Auskunft", "Gericht", "über", "17", "4711", "Klage", "x", "ab\U0001f600"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))), rng.choice(["BGH", "LG Bonn", None])) for k in range(160)]
    # titles that differ in their three rarest words, by one sign each
    rows += [(900, "Beschluss zum Aktenzeichen qzx1 wvy2 jkl3 der Kammer", "BGH"), (901, "Beschluss zum Aktenzeichen qzx4 wvy5 jkl6 der Kammer", "BGH"), (902, None, "BGH"), (903, "!!", "BGH")]
    df = spark.createDataFrame(rows, "id bigint, title string, court string")
    norm = {r.id: r.n for r in df.select("id", normalized(F.col("title")).alias("n")).collect()}
    first = {}
    for k, title, court in rows:
        if title is not None and norm[k] and court:
            first.setdefault((court[:2], norm[k]), k)
    want = set()
    for ((c, x), a), ((d, y), b) in itertools.combinations(first.items(), 2):
        if c == d and max(difflib.SequenceMatcher(None, x, y).ratio(), difflib.SequenceMatcher(None, y, x).ratio()) >= 0.85:
            want.add((min(a, b), max(a, b)))
    got = {(r.a, r.b) for r in titles.title_pairs(df).collect()}
    assert got == want and (900, 901) in got and len(want) > 5
    assert titles.title_pairs(df.limit(0)).count() == 0


def test_large_buckets_of_titles_are_dealt(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"Urteil Nummer {k} der Kammer", "BGH") for k in range(60)], "id bigint, title string, court string")
    want = sorted(titles.title_pairs(df).select("a", "b").collect())
    monkeypatch.setattr(titles, "TASK_ROWS", 7)
    assert sorted(titles.title_pairs(df).select("a", "b").collect()) == want and len(want) > 100


def _events(spark, n=4000, keys=2):
    rng = random.Random(11)
    rows = [(k, f"c{k % keys}", "op", 1_700_000_000 + rng.randrange(9000), rng.choice([rng.random() * 100, 5.0, None])) for k in range(n)]
    df = spark.createDataFrame(rows, "event_id bigint, component string, operation string, s bigint, duration_ms double")
    return df.withColumn("timestamp", F.timestamp_seconds("s").cast("timestamp_ntz")), rows


def test_percentiles_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BRACKETED_FROM", 100)
    monkeypatch.setattr(ordered, "HALF", 0.02)
    events, rows = _events(spark)
    for r in event_stats.performance(events).collect():
        values = sorted(x[4] for x in rows if x[1] == r.component and x[4] is not None)
        at = lambda share: values[min(int(len(values) * share), len(values) - 1)]  # noqa: B023, E731
        assert (r.n, r.median, r.p95, r.p99, r.least, r.most) == (len(values), at(0.5), at(0.95), at(0.99), values[0], values[-1])
    values = sorted(x[4] for x in rows if x[4] is not None)
    whole = events.withColumns({"memory_mb": F.lit(1.0), "cpu_percent": F.lit(None).cast("double")})
    got = event_stats.resource_summary(whole).first()
    middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
    assert (got.n, got.median, got.cpu_most) == (len(values), round(middle, 4), None)


def test_a_bracketed_group_is_not_gathered(spark, monkeypatch):
    """What the last window sees of one group of 200,000 different values is the brackets' share of them."""
    df = spark.range(200_000).select(F.lit("all").alias("k"), (F.hash("id").cast("double") + F.col("id") / 1e7).alias("v"))
    seen = []
    original = F.sum
    monkeypatch.setattr(ordered, "Window", type("W", (), {"partitionBy": staticmethod(lambda *c: seen.append(c) or Window.partitionBy(*c))}))
    out = ordered.order_statistics(df, ["k"], "v", {"p95": 0.95})
    values = sorted(r.v for r in df.select("v").collect())
    assert out.first().p95 == values[int(200_000 * 0.95)] and seen and original is F.sum
    bounds = df.agg(F.percentile_approx("v", F.array(F.lit(0.95 - ordered.HALF), F.lit(0.95 + ordered.HALF)), ordered.ACCURACY)).first()[0]
    assert df.filter(F.col("v").between(*bounds)).count() < 0.001 * 200_000


@pytest.mark.parametrize("seconds", [60, 5000])
def test_windows_in_blocks(spark, seconds):
    events, _ = _events(spark)
    got = ordered.over_last_seconds(events, ["component"], "timestamp", seconds, block=100, n=F.count("*"))
    window = Window.partitionBy("component").orderBy("s").rangeBetween(-seconds, 0)
    assert sorted((r.event_id, r.n) for r in got.collect()) == sorted(map(tuple, events.select("event_id", F.count("*").over(window)).collect()))
    last = ordered.over_last_rows(events, ["component"], "timestamp", "event_id", last=7, rows=20, n=F.count("*"), top=F.max("event_id"))
    window = Window.partitionBy("component").orderBy("s", "event_id").rowsBetween(-6, 0)
    assert sorted((r.event_id, r.n, r.top) for r in last.collect()) == sorted(map(tuple, events.select("event_id", F.count("*").over(window), F.max("event_id").over(window)).collect()))


def test_block_numbers_and_ranges_of_rows_are_two_functions(spark):
    """Blocks of time take several keys; numbers run on over blocks, as the percentiles of the last durations need them."""
    events, rows = _events(spark, 600)
    got = ordered.block_numbers(events, ["component", "operation"], "timestamp", "event_id", seconds=700)
    window = Window.partitionBy("component").orderBy("s", "event_id")
    assert sorted((r.event_id, r["__n"]) for r in got.collect()) == sorted(map(tuple, events.select("event_id", F.row_number().over(window)).collect()))
    found = {r.event_id: (r.median, r.p95, r.p99) for r in event_stats.baseline_percentiles(events).collect()}
    for c in ("c0", "c1"):
        of = sorted((x[3], x[0], x[4]) for x in rows if x[1] == c)
        for k, (_, event, _) in enumerate(of):
            d = sorted(x[2] for x in of[max(0, k - 99) : k + 1] if x[2] is not None)
            assert found[event] == tuple(d[min(int(len(d) * p), len(d) - 1)] if d else None for p in (0.5, 0.95, 0.99))


def test_baselines_of_two_keys(spark):
    """An outlier among the last durations of its component and operation is an anomaly; another operation's rows don't count."""
    rows = [(k, "c", f"op{k % 2}", 1_700_000_000 + 900 * k, 900.0 if k in (6, 60) else 10.0 + k % 3) for k in range(80)]
    df = spark.createDataFrame(rows, "event_id bigint, component string, operation string, s bigint, duration_ms double")
    df = df.withColumn("timestamp", F.timestamp_seconds("s").cast("timestamp_ntz"))
    found = event_stats.baselines(df).collect()
    assert {r.event_id: r.seen for r in found} == {k: k // 2 + 1 for k in range(80)} and [r.event_id for r in found if r.anomaly] == [60]


def test_metric_issues_of_two_keys(spark):
    """Issues of a measurement itself, and one that only its baseline tells."""
    rows = [(k, "c", f"op{k % 2}", 1_700_000_000 + 900 * k, {60: 900.0, 61: 6000.0}.get(k, 10.0 + k % 3), 501.0 if k == 7 else None, 81.0 if k == 9 else 5.0) for k in range(80)]
    df = spark.createDataFrame(rows, "event_id bigint, component string, operation string, s bigint, duration_ms double, memory_mb double, cpu_percent double")
    found = event_stats.metric_issues(df.withColumn("timestamp", F.timestamp_seconds("s").cast("timestamp_ntz"))).collect()
    odd = {7: (["high_memory"], "medium"), 9: (["high_cpu"], "medium"), 60: (["duration_anomaly"], "medium"), 61: (["critical_duration"], "critical")}
    assert {r.event_id: (r.issues, r.priority) for r in found} == {k: odd.get(k, ([], "info")) for k in range(80)}


def test_index_finds_appended_batches_and_reads_no_text(spark, tmp_path):
    rows = [(1, "Die Einwilligung der Betroffenen", ["Daten"]), (2, "Einwilligungen und Bußgelder", None), (3, None, ["Bußgeld"]), (4, "nichts davon", [])]
    df = spark.createDataFrame(rows, "id bigint, title string, keywords array<string>")
    found = index.PostingsIndex(spark, "test_postings", "id", {"title": "A", "keywords": "B"}, stems.stemmed, path=str(tmp_path / "i"))
    found.append(df.filter("id < 3"), "first")
    ids = lambda q: sorted(r.id for r in found.find(q).collect())
    assert ids("Einwilligung") == [1, 2] and ids("Bußgeld") == [2]
    found.append(df.filter("id >= 3"), "second")
    found.append(df.filter("id >= 3"), "second")
    assert ids("Bußgeld") == [2, 3] and ids("Einwilligung & !Bußgelder") == [1] and ids("!Einwilligung") == [3, 4] and ids("Daten | Bußgeld NOT Einwilligung") == [1, 3]
    assert found.table("documents").count() == 4
    assert {r.lexeme: r.docs for r in found.frequencies("bussgeld", "einwill").collect()} == {"bussgeld": 2, "einwill": 2}
    plan = found.page("Einwilligung & Bußgeld")._jdf.queryExecution().executedPlan().toString()
    assert "test_postings_postings" in plan and "title" not in plan and "In(lexeme, [bussgeld,einwill])" in plan
    shown = {r.id: r for r in index.results(found.page("Bußgeld"), df, "id", "title", "Bußgeld", stems.stemmed).collect()}
    assert shown[2].snippet == "Einwilligungen und <mark>Bußgelder</mark>" and shown[3].snippet == "..." and shown[3].gdpr_articles == []
    assert tuple(index.results(found.page("Bußgeld"), df, "id", "title", "Bußgeld").columns) == index.RESULT


def test_alternatives():
    a = index.Alternative
    assert index.alternatives("a b") == [a(("a", "b"))]
    assert index.alternatives("a AND NOT b OR DS-GVO") == [a(("a",), ("b",)), a(("ds", "gvo"))]
    assert index.alternatives("a & !b | !c") == [a(("a",), ("b",)), a((), ("c",))]
    assert index.alternatives("(a) ; 'b'") == [a(("a", "b"))] and index.alternatives("%%") == [a((index.DEFAULT_QUERY,))]


def test_cover_density(spark):
    def brute(tokens, wanted):
        last, begin, total = {}, 0, 0.0
        for i, t in enumerate(tokens, 1):
            if t in wanted:
                last[t] = i
                if len(last) == len(wanted) and min(last.values()) > begin:
                    begin = min(last.values())
                    total += 1 / (i - begin + 1)
        return total / (total + 1)

    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 30))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    found = index.PostingsIndex(spark, "test_dense", "id", {"t": "C"})
    found.append(df)
    got = {r.id: r.relevance for r in found.find("a & b", dense=True).collect()}
    want = {i: brute(t.split(), ["a", "b"]) for i, t in enumerate(texts) if "a" in t and "b" in t}
    assert got == pytest.approx(want) and len(want) > 20


def test_headline(spark):
    def one(text, **kw):
        return spark.createDataFrame([(text,)], "t string").select(index.headline(F.col("t"), ["ziel"], **kw)).first()[0]

    words = [f"wort{k}" for k in range(40)]
    assert one(" ".join(words[:10] + ["Ziel!", "ab"] + words[10:]), least=1, most=3) == "wort9 <mark>Ziel!</mark>"
    assert one(" ".join(words), least=2, most=3) == "wort0 wort1 wort2" and one(None) is None and one("") == ""


def test_stems(spark):
    want = {
        "aufeinander": "aufeinand", "kategorien": "kategori", "häuser": "haus", "jährlichen": "jahrlich", "verarbeitung": "verarbeit", "einwilligungen": "einwill", "verzeichnisse": "verzeichnis", "richtlinien": "richtlini",
        "rechtmäßigkeit": "rechtmass", "freundlichkeit": "freundlich", "schnellsten": "schnell", "arbeits": "arbeit", "bauern": "bau", "quelle": "quell", "daten": "dat", "betroffenen": "betroff", "sicherheit": "sich", "an": "an", "": "",
    }
    got = spark.createDataFrame([(w,) for w in want], "w string").select("w", stems.stemmed(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == want


def test_groups_over_links_of_all_kinds(spark):
    """Exact, title and content links make groups together; 60 deliveries of one docket are one group."""
    from lexweave.operators import duplicates

    words = [f"wort{k}" for k in range(40)]
    rows = [(f"a{k:02d}", f"Titel ganz eigener Art {k * 7919}", "BGH", "1 ZR 1/20", f"2020-01-{k % 28 + 1:02d}", None) for k in range(60)]
    rows += [("b1", "Urteil zum Bußgeld gegen die Bank", "LG Bonn", "2 O 1/20", "2020-01-01", None), ("b2", "Urteil zum Bussgeld gegen die Bank", "LG Bonn", "9 O 9/20", "2020-05-01", " ".join(words))]
    rows += [("c1", "Ganz anderes", None, None, "2020-06-01", " ".join(words[:39] + ["neu"])), ("c2", "Noch etwas", None, None, "2021-06-01", " ".join(reversed(words))), ("c3", "Allein", None, None, "2024-06-01", " ".join(words))]
    df = spark.createDataFrame(rows, "id string, title string, court string, case_number string, d string, text string").withColumn("decision_date", F.to_timestamp("d").cast("timestamp_ntz"))
    links = duplicates.find_duplicates(df, "text")
    assert {(r.a, r.b, r.kind) for r in links.filter("kind <> 'exact'").collect()} >= {("b1", "b2", "title"), ("b2", "c1", "content"), ("b2", "c2", "content")}
    got = {r.id: r["group"] for r in duplicates.grouped(links).collect()}
    assert {i for i, g in got.items() if g == "a00"} == {f"a{k:02d}" for k in range(60)} and {i for i, g in got.items() if g == "b1"} == {"b1", "b2", "c1", "c2"} and "c3" not in got


def test_sources_put_together(spark):
    from lexweave.operators import duplicates

    one = spark.createDataFrame([("1", "ris", "k", "BGH"), ("2", "ris", None, "BGH")], "id string, source string, case_number string, court string")
    two = spark.createDataFrame([("3", "manual", "k", "BGH", "neu"), ("4", "swiss", None, "BGH", None)], "id string, source string, case_number string, court string, more string")
    got = {r.id: (r["group"], r.master, r.more) for r in duplicates.collected(one, two).collect()}
    assert got == {"1": ("1", False, None), "2": ("2", True, None), "3": ("1", True, "neu"), "4": ("4", True, None)}


def test_postings_stand_where_their_row_stands(spark):
    """No shuffle before the one by lexeme; several rows of one key, and classes that share a word, are put together."""
    df = spark.createDataFrame([(1, "b a b", ["a"]), (2, "", None), (3, None, ["c", "c d"])], "id bigint, t string, k array<string>")
    found = index.postings(df, "id", {"t": "A", "k": "B"})
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted((r.lexeme, r.id, r.weight, r.positions, r.first) for r in df.collect())
    assert rows(found) == [("a", 1, "A", [2], True), ("a", 1, "B", [1], False), ("b", 1, "A", [1, 3], True), ("c", 3, "B", [1, 2], True), ("d", 3, "B", [3], True)]
    twice = df.unionByName(df.limit(1))
    assert rows(index.postings(twice, "id", {"t": "A"})) == [("a", 1, "A", [2, 2], True), ("b", 1, "A", [1, 1, 3, 3], True)]


def test_a_word_of_all_rows_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    spark.range(4000).selectExpr("id", "concat('immer wort', id) AS t").write.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(index, "PART_BYTES", 2_000)
    df = spark.read.parquet(str(tmp_path / "in"))
    found = index.PostingsIndex(spark, "test_dealt", "id", {"t": "C"}, buckets=2, path=str(tmp_path / "i"))
    found.append(df)
    files = found.table("postings").filter("lexeme = 'immer'").groupBy(F.col("_metadata.file_name").alias("f")).count().collect()
    assert len(files) > 3 and max(r["count"] for r in files) < 2 * 4000 / len(files)
    assert found.find("immer & wort7").collect()[0].id == 7 and found.find("immer").count() == 4000
    assert found.frequencies("immer", "wort3").orderBy("lexeme").collect() == [("immer", 4000, 4000), ("wort3", 1, 1)]


def test_row_numbers_of_ranges(spark, monkeypatch):
    """As one window numbers them, nulls first, without a task for a whole key."""
    rng = random.Random(8)
    rows = [(rng.choice(["de", "en", None]), k if k else None) for k in rng.sample(range(3000), 3000)]
    df = spark.createDataFrame(rows, "lang string, id bigint")
    seen = []
    monkeypatch.setattr(ordered, "Window", type("W", (), {"partitionBy": staticmethod(lambda *c: seen.append(c) or Window.partitionBy(*c))}))
    got = ordered.row_numbers(df, "lang", "id", "k")
    want = df.select("lang", "id", F.row_number().over(Window.partitionBy("lang").orderBy("id")).alias("k"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and ("lang", "__part") in seen


def test_content_join_is_exact_whatever_the_cells(spark, monkeypatch):
    """The same pairs as brute force, with cells that many words share; words aren't joined with their counts."""
    from lexweave.operators import duplicates

    rng = random.Random(4)
    base = [[f"w{rng.randrange(300)}" for _ in range(30)] for _ in range(12)]
    rows = [(k, " ".join([*base[k % 12][: 30 - k % 4], f"n{k % 5}"]), 2000 + k % 3) for k in range(150)] + [(900, None, 2000), (901, "!", 2000)]
    df = spark.createDataFrame(rows, "id bigint, text string, year int")
    sets, first = {}, {}
    for k, text, year in rows:
        words = frozenset(w for w in (text or "").split() if w != "!")
        if words and (year, words) not in first:
            first[year, words] = k
            sets[k] = (year, words)
    want = {(a, b) for a, (y, v) in sets.items() for b, (z, w) in sets.items() if a < b and abs(y - z) <= 1 and 10 * len(v & w) >= 9 * len(v | w)}
    for bits in (18, 2):
        monkeypatch.setattr(duplicates, "CELL_BITS", bits)
        found = duplicates.similar_contents(df)
        assert {(r.a, r.b) for r in found.collect()} == want and len(want) > 20
    monkeypatch.setattr(duplicates, "written", lambda df, name: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or stages.written(df, name))
    seen = []
    duplicates.similar_contents(df)
    assert len(seen) == 2 and "Join" not in seen[1]


def test_contents_are_compared_in_rounds(spark, monkeypatch):
    """Whole sets are written without a shuffle and read by rounds of pairs; equal sets of different years take no set along."""
    rng = random.Random(6)
    base = [[f"w{rng.randrange(400)}" for _ in range(40)] for _ in range(10)]
    rows = [(k, " ".join([*base[k % 10][: 40 - k % 3], f"n{k % 4}"]), 2000 + k // 45) for k in range(90)]
    rows += [(k + 200, text, year) for k, text, year in rows[:5]]
    df = spark.createDataFrame(rows, "id bigint, text string, year int")
    want = sorted(map(tuple, duplicates.similar_contents(df).collect()))
    groups = sorted(map(tuple, duplicates.grouped(duplicates.content_links(df)).collect()))
    sets = {k: frozenset(text.split()) for k, text, _ in rows}
    assert all(abs(s - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) < 1e-9 for a, b, s in want)
    assert len(want) > 40 and any(s == 1 for *_, s in want) and len({g for _, g in groups}) <= 10 and len(groups) == 95
    parts, plans = [], []
    monkeypatch.setattr(duplicates, "ROUND_SHARE", 0)
    monkeypatch.setattr(duplicates, "ROUND_WORDS", 500)
    monkeypatch.setattr(duplicates, "appended", lambda frames, name: stages.appended([parts.append(name) or f for f in frames], name))
    monkeypatch.setattr(duplicates, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stages.written(df, name))
    assert sorted(map(tuple, duplicates.similar_contents(df).collect())) == want and parts.count("contents-similar") > 3
    assert "Exchange" not in plans[0]
    assert sorted(map(tuple, duplicates.grouped(duplicates.content_links(df)).collect())) == groups


def test_postings_are_put_together_in_arrow_tasks(spark, monkeypatch):
    """No expression over each word's neighbours is left, and runs of rows, classes, nulls and empty texts keep their places."""
    monkeypatch.setattr(index, "GATHERED_ROWS", 3)
    rng = random.Random(8)
    texts = [(k, rng.choice([None, "", " ".join(rng.choice("abcdé") for _ in range(rng.randrange(9)))]), rng.choice([None, "a b a", "e"]), rng.choice([None, "c a"])) for k in range(40)]
    df = spark.createDataFrame(texts, "id bigint, t string, u string, v string")
    want = {}
    for k, *fields in texts:
        for kind, text in zip("CAC", fields, strict=True):
            for at, word in enumerate((text or "").split(), 1):
                want.setdefault((word, k), {}).setdefault(kind, []).append(at)
    expected = sorted((w, k, kind, sorted(at), kind == min(kinds)) for (w, k), kinds in want.items() for kind, at in kinds.items())
    found = index.postings(df, "id", {"t": "C", "u": "A", "v": "C"})
    assert sorted((r.lexeme, r.id, r.weight, r.positions, r["first"]) for r in found.collect()) == expected
    assert "lambdafunction(struct" not in found._jdf.queryExecution().executedPlan().toString()
    assert index.postings(df.limit(0), "id", {"t": "C"}).count() == 0


def test_buckets_of_many_short_rows_are_dealt(spark, monkeypatch, tmp_path):
    """A word of all rows isn't sorted by one task, even where the files are small."""
    monkeypatch.setattr(index, "PART_ROWS", 100)
    df = spark.range(1000).select("id", F.lit("alle").alias("t"))
    made = index.PostingsIndex(spark, "short_rows", "id", {"t": "A"}, buckets=2, path=str(tmp_path / "short_rows"))
    made.append(df)
    postings = made.table("postings")
    per_file = [r["count"] for r in postings.groupBy(F.input_file_name()).count().collect()]
    assert len(per_file) == 10 and sum(per_file) == 1000 and max(per_file) < 200
    assert made.find("alle").count() == 1000
