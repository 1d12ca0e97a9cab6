"""Paged listings, counted imports, binary files, event files and streams with state; fields of several forms, references and names."""

import json
import re
import statistics
from datetime import date, datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.functions import anonymise, names, references, variants
from lexweave.operators import filters
from lexweave.sources import binaries, counted, paged, readers, sinks
from lexweave.streaming import jobs


def _listing(root, term, n, size, first_day=1):
    """Answers for a term, newest first for a batch; items have ids from n down."""
    for page in range(1, -(-n // size) + 1):
        folder = root / f"term={term}" / f"page={page}"
        folder.mkdir(parents=True, exist_ok=True)
        items = [{"id": i, "updated_date": f"2024-01-{i + first_day:02d}"} for i in range(n - 1 - (page - 1) * size, max(-1, n - 1 - page * size), -1)]
        (folder / "answer.json").write_text(json.dumps({"count": n, "results": items}))


def _read(spark, root, **options):
    spark.dataSource.register(paged.PagedSource)
    return spark.read.format("paged").options(path=str(root), **options).load()


def test_paged_batches(spark, tmp_path):
    _listing(tmp_path, "DSGVO", 23, 5)
    _listing(tmp_path, "GDPR", 2, 5)
    rows = _read(spark, tmp_path, terms="DSGVO, GDPR,nichts", page_size="5", pages_per_task="2")
    got = sorted((r.term, r.page, r.place, int(r.id)) for r in rows.collect())
    assert got == sorted([("DSGVO", k // 5 + 1, k, 22 - k) for k in range(23)] + [("GDPR", 1, k, 1 - k) for k in range(2)])
    assert rows.rdd.getNumPartitions() == 4
    assert _read(spark, tmp_path, terms="DSGVO", page_size="5", max_pages="2").count() == 10
    fresh = _read(spark, tmp_path, terms="DSGVO", page_size="5", updated_after="2024-01-20")
    assert sorted(int(r.id) for r in fresh.collect()) == [20, 21, 22]
    with pytest.raises(Exception, match="page_size"):
        _read(spark, tmp_path, terms="DSGVO", page_size="0").count()


def test_paged_stream_resumes_within_a_page(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)

    def listing(n):
        for page in range(1, -(-n // 4) + 1):
            folder = tmp_path / "in" / "term=a" / f"page={page}"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / "answer.json").write_text(json.dumps({"count": n, "results": [{"id": i} for i in range((page - 1) * 4, min(n, page * 4))]}))

    for n in (6, 6, 11):
        listing(n)
        stream = spark.readStream.format("paged").options(path=str(tmp_path / "in"), terms="a", page_size="4", pages_per_task="1").load()
        jobs.import_available(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert sorted(int(r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(n))


def test_counted_import(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "s": 5}\n{"id": 2, "s": 1}\n\n{broken\n{"id": 3}\n{"id": 4, "s": 3}\n')
    got = counted.import_lines(spark, str(tmp_path / "a.jsonl"), "id bigint, s int", str(tmp_path / "out"), F.col("s"))
    assert got == {"read": 5, "malformed": 1, "irrelevant": 2, "kept": 2}
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 4]
    assert counted.import_lines(spark, str(tmp_path / "a.jsonl"), "id bigint", str(tmp_path / "all"))["kept"] == 4
    assert readers.document_count(spark, str(tmp_path / "a.jsonl")) == 4


def test_file_rules(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n')
    (tmp_path / "empty.jsonl").write_text("")
    assert readers.validated(spark, str(tmp_path / "a.jsonl")) == []
    assert readers.validated(spark, str(tmp_path / "none.jsonl"))[0].startswith("not found")
    assert [e.split(":")[0] for e in readers.validated(spark, str(tmp_path / "empty.jsonl"))] == [f"empty", "no documents"]
    assert readers.validated(spark, str(tmp_path / "a.jsonl"), large=3)[0].startswith("very large")


def test_broken_elements_harm_no_other(spark, tmp_path):
    (tmp_path / "n.xml").write_text("<ALL><NOTICE><CELEX_NUMBER>1</CELEX_NUMBER><TITLE>A & B</TITLE></NOTICE><NOTICE><CELEX_NUMBER>2</CELEX_NUMBER><X></NOTICE><NOTICE><CELEX_NUMBER>3</CELEX_NUMBER><TITLE>A &amp; B</TITLE></NOTICE><NOTICE><CELEX_NUMBER>4</CELEX_NUMBER><TITLE>&nbsp;</TITLE></NOTICE></ALL>")
    assert [(r.id, r.title) for r in readers.read_eurlex(spark, str(tmp_path / "n.xml")).collect()] == [("3", "A & B")]


def test_binary_texts(spark, tmp_path):
    def numbers(content):
        return [str(int(content))]

    (tmp_path / "a.txt").write_text("eins\f\fdrei")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_text("x" * 100)
    (tmp_path / "d.txt").write_text("\f")
    got = {r.path.rsplit("/", 1)[1]: r for r in binaries.read_texts(spark, str(tmp_path), numbers, binaries.plain_pages, most_bytes=50).collect()}
    assert (got["a.txt"].text, got["a.txt"].pages, got["a.txt"].method, got["a.txt"].error) == ("--- Seite 1 ---\neins\n\n--- Seite 3 ---\ndrei", 3, "plain_pages", None)
    assert got["b.bin"].text is None and "UnicodeDecodeError" in got["b.bin"].error and "numbers: ValueError" in got["b.bin"].error
    assert got["c.txt"].text is None and got["c.txt"].error == "too large: 100 bytes" and "ValueError" in got["d.txt"].error
    assert binaries.read_texts(spark, str(tmp_path), pattern="a.*", most_pages=1).first().text == "--- Seite 1 ---\neins"


def test_event_files_rotate_and_age(spark, tmp_path):
    rows = [(str(k), datetime(2024, 1, 1 + k % 4, 10, 0, 0, k), None if k == 0 else "c", "error") for k in range(400)]
    events = spark.createDataFrame(rows, "id string, timestamp timestamp, component string, category string").coalesce(1)
    path = str(tmp_path / "log")
    sinks.write_batch(events, path, 1, most_bytes=2000)
    sinks.write_batch(events, path, 1, most_bytes=2000)
    files = list((tmp_path / "log").rglob("*.json.gz"))
    assert len(files) > 20 and all(f.stat().st_size < 2000 for f in files)
    back = readers.event_log(spark, path)
    assert back.count() == 400 and back.agg(F.max("timestamp")).first()[0] == datetime(2024, 1, 4, 10, 0, 0, 399) and back.filter("component IS NULL").count() == 1
    assert set(sinks.drop_old_days(spark, path, date(2024, 2, 1), 30)) == {"day=2024-01-01"}
    assert readers.event_log(spark, path).count() == 300


def test_rotating_stream_restarts(spark, tmp_path):
    schema = "id string, timestamp timestamp, component string, category string"
    for k in range(2):
        spark.createDataFrame([(f"{k}{i}", datetime(2024, 1, 1), "c", "usage") for i in range(5)], schema).write.mode("append").json(str(tmp_path / "in"))
        stream = jobs.documents(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        for _ in range(2):
            jobs.rotating_sink(stream, str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.id for r in readers.event_log(spark, str(tmp_path / "log")).collect()) == sorted(f"{a}{i}" for a in range(k + 1) for i in range(5))


def test_rolling():
    rng = np.random.default_rng(4)
    last, values = rng.normal(1e6, 1, 7), rng.normal(1e6, 1, 60)
    n, mean, deviation = jobs.rolling(last, values, 20)
    every = [*last, *values]
    for i in range(60):
        window = every[max(0, 8 + i - 20) : 8 + i]
        assert n[i] == len(window) and mean[i] == pytest.approx(statistics.mean(window)) and deviation[i] == pytest.approx(statistics.stdev(window), rel=1e-6)


def test_state_survives_a_restart(spark, tmp_path):
    """The second start goes on from the first one's state; once another key's event has moved the time on for days, the key is forgotten."""
    before = spark.conf.get(jobs.STATE_STORE[0])
    spark.conf.set(*jobs.STATE_STORE)
    schema = "component string, operation string, timestamp timestamp, duration_ms double"
    deliveries = [[("c", "o", datetime(2024, 1, day, k, i), 100.0 if (k, i) == (1, 4) else 1.0 + i % 3) for i in range(20)] for k, day in enumerate((1, 1, 9))]
    deliveries.insert(2, [("d", "o", datetime(2024, 1, 8), 1.0), ("c", "p", datetime(2024, 1, 8), None)])
    try:
        for rows in deliveries:
            spark.createDataFrame(rows, schema).write.mode("append").json(str(tmp_path / "in"))
            stream = jobs.judged_events(jobs.documents(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema))
            query = stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            done = query.awaitTermination(60)
            query.stop()
            assert done
        got = spark.read.schema(jobs.JUDGED_SCHEMA).json(str(tmp_path / "out")).filter("component = 'c'").orderBy("timestamp").collect()
        assert [r.seen for r in got] == [*range(1, 41), *range(1, 21)] and [k for k, r in enumerate(got) if r.anomaly] == [24]
    finally:
        spark.conf.set(jobs.STATE_STORE[0], before)


def test_csv_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Akten-Zeichen;Titel\n 1 O 2 ;n/a\n;\n")
    jobs.import_available(jobs.csv_documents(spark, str(tmp_path / "in"), ["Akten-Zeichen", "Titel"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("1 O 2", None)]


def test_variants(spark):
    cells = [" true ", "12", "-1.5", "1e3", "[1, 2]", '{"a": "b"}', "{broken", 'say "x"', "N/A", "", None, "7d", "99999999999999999999"]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(variants.kind(variants.cell(F.col("c"))).alias("k"), F.try_variant_get(variants.cell(F.col("c")), "$", "string").alias("s")).collect()
    assert [r.k for r in got] == ["bool", "int", "float", "float", "list", "object", "text", "text", None, None, None, "text", "float"]
    assert got[7].s == 'say "x"' and got[6].s == "{broken"
    forms = ['{"c": {"name": "BGH"}}', '{"c": "LG"}', '{"c": null}', '{"c": ["x", "y"]}', '{"c": {"name": "", "slug": "ag"}}', "{}"]
    v = F.variant_get(F.try_parse_json("c"), "$.c", "variant")
    got = spark.createDataFrame([(c,) for c in forms], "c string").select(variants.named(v, "name", "slug").alias("n"), variants.listed(v).alias("l")).collect()
    assert [r.n for r in got] == ["BGH", "LG", None, None, "ag", None]
    assert [r.l for r in got] == [None, ["LG"], None, ["x", "y"], None, None]


def test_references(spark):
    references.register(spark)
    spark.createDataFrame([(1, "Art. 6 Abs. 1 lit. f DSGVO; § 26 BDSG. Ää Article 17(1) GDPR Art. 6 Abs. 1 lit. f DSGVO"), (2, "nichts"), (3, None)], "id bigint, t string").createOrReplaceTempView("test_references")
    got = spark.sql("SELECT d.id, r.* FROM test_references d, LATERAL extract_references(d.t) r ORDER BY start").collect()
    assert [tuple(r) for r in got] == [(1, "DSGVO", "6", "1", "f", 0), (1, "BDSG", "26", None, None, 28), (1, "DSGVO", "17", "1", None, 42), (1, "DSGVO", "6", "1", "f", 61)]
    assert "Python" not in spark.sql("SELECT r.* FROM test_references d, LATERAL extract_references(d.t) r")._jdf.queryExecution().executedPlan().toString()


TABLE = [
    ("Anna Berg traf Berg.", "[Person 1] traf [Person 2]."),
    ("Bergmann, Annaberg", "Bergmann, Annaberg"),
    ("Anna Berg Anna Berg Werke", "[Person 1] [Organisation 1]"),
    ("Kläger Berg", "Kläger [Person 1]"),
    ("Berg, Anna Berg, Berg", "[Person 1], [Person 2], [Person 1]"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("most", [1, 200_000])
def test_names(spark, monkeypatch, most):
    monkeypatch.setattr(names, "MOST_NAMES", most)
    known = spark.createDataFrame([("Anna Berg", "PERSON"), ("Berg", "PERSON"), ("Anna Berg Werke", "ORGANIZATION"), ("Kläger", "PERSON"), (" ", "PERSON"), (None, "PERSON")], "name string, kind string")
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(TABLE)], "id bigint, t string")
    got = {r.id: r for r in names.anonymised_by(docs, "t", "names", known).collect()}
    assert [got[k].anonymised for k in range(len(TABLE))] == [want for _, want in TABLE]
    assert got[0].names == {"[Person 1]": "Anna Berg", "[Person 2]": "Berg"} and got[0].error is None
    assert names.without_names(docs, "t", known.limit(0)).filter("t = anonymised OR t IS NULL").count() == len(TABLE)


def test_backends(spark):
    docs = spark.createDataFrame([("Herr Max Muster klagt",)], "t string")
    assert names.anonymised_by(docs, "t", "names").first().anonymised == "[Person 1] klagt"
    with pytest.raises(ValueError, match="unknown backend"):
        names.anonymised_by(docs, "t", "spacy")
    assert "Antragsgegnerin" in anonymise.ROLES


def test_names_of_the_query(spark, data):
    """The query's names against a plain search."""
    from lexweave.plans.catalogue import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    found = {m[1] for t in docs.values() if (m := re.match(r"([^\W\d_]{5,})\b", t or ""))} - set(anonymise.ROLES)
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, found), key=len, reverse=True)) + r")(?!\w)")
    for r in QUERIES["masked_names"](spark, data).collect():
        numbers = {}

        def tag(m, numbers=numbers):
            kind = "Person" if len(m[0]) % 2 == 0 else "Organisation"
            return numbers.setdefault(m[0], f"[{kind} {1 + sum(t.startswith('[' + kind) for t in numbers.values())}]")

        assert r.anonymised == pattern.sub(tag, docs[r.doc_id] or "") and r.n_names == len(numbers) and r.error is None


def test_parameters():
    assert filters.checked_query(" Daten<b>; ") == "Datenb" and filters.checked_sources([" RIS "]) == ["ris"]
    for bad in ("ab", "x" * 201):
        with pytest.raises(ValueError, match="characters"):
            filters.checked_query(bad)
    with pytest.raises(ValueError, match="unknown source"):
        filters.checked_sources(["x"])
    assert filters.checked_dates("2024-01-02", None) == (date(2024, 1, 2), None)
    with pytest.raises(ValueError, match="before"):
        filters.checked_dates("2024-01-02", "2024-01-01")


def test_reports(spark):
    perf = spark.createDataFrame([("c", 3, 1.5, 2.5)], "component string, n bigint, mean double, p95 double")
    errors = spark.createDataFrame([("type", "E", 2)], "kind string, value string, n bigint")
    assert json.loads(sinks.daily_report_json(perf, errors, "Tag")) == {"title": "Tag", "performance": [{"component": "c", "n": 3, "mean": 1.5, "p95": 2.5}], "errors": [{"kind": "type", "value": "E", "n": 2}]}


def test_html_text_and_links(spark):
    from lexweave.functions import html

    page = "<!DOCTYPE html><p> A&amp;B <b>fett</b><script>var t='</p>';</script></p><!-- <a href='no'>x</a> -->\n[1]\n<style>p{}</style><a class='c' title=' T &lt; ' href='/x?a=1&amp;b=2'>L<i>k</i></a><a href=\"/y\"> zwei </a>"
    row = spark.createDataFrame([(page,), (None,)], "h string").select(html.main_text(F.col("h")).alias("t"), html.links(F.col("h")).alias("l")).collect()
    assert row[0].t == "A&B\nfett\n\nL\nk\nzwei" and [tuple(x) for x in row[0].l] == [("T <", "/x?a=1&b=2", "Lk"), ("zwei", "/y", "zwei")]
    assert (row[1].t, row[1].l) == ("", [])
    listing = "<ul class='mw-contributions-list'><li>10:12, 3 May 2024 <a href='/index.php?title=A' title='DPA (Italy) - 1'>x</a> (<a href='/index.php?h'>hist</a>)</li></ul><ul class='mw-contributions-list'><li><a href='/index.php?title=U' title='User:U'>x</a></li><li><a href='/other' title='B'>x</a></li></ul>"
    category = "<div id='mw-pages'><ul><li><a href='/a' title='CJEU - C-1'>x</a></li><li><a href='/b' title='Category:Y'>x</a></li><li>leer</li></ul></div>"
    got = spark.createDataFrame([(listing, category)], "l string, c string").select(html.new_pages(F.col("l")).alias("l"), html.category_pages(F.col("c")).alias("c")).first()
    assert [tuple(x) for x in got.l] == [("DPA (Italy) - 1", "/index.php?title=A", "10:12, 3 May 2024")] and [tuple(x) for x in got.c] == [("CJEU - C-1", "/a", None)]


def test_clean_text(spark):
    from lexweave.functions import scalars

    assert spark.createDataFrame([(" FÃ¼r â€œGrÃ¶ÃŸeâ€™s\x07  \t x\n\n\n\ny ",)], "t string").select(scalars.clean_text(F.col("t"))).first()[0] == "Für \"Größe's x\n\ny"


def test_excel(spark, tmp_path, data):
    import xml.etree.ElementTree as ET
    import zipfile
    from io import BytesIO

    from lexweave.plans.views import Views
    from lexweave.sources import excel

    d = Views(spark, data).decisions.limit(50).withColumns({"title": F.concat(F.lit("<&\x01>"), "title"), "court": F.when(F.col("id") > "2", "BGH").otherwise(F.col("court"))})
    row = excel.excel(d, {"Quelle": "alle"}).first()
    book = zipfile.ZipFile(BytesIO(bytes(row.workbook)))
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    sheets = {ET.fromstring(book.read(n)) for n in book.namelist() if "sheets/sheet" in n}
    assert all(ET.fromstring(book.read(n)) is not None for n in book.namelist()) and len(sheets) == 2
    rows = [[c.findtext("m:is/m:t", namespaces=ns) for c in r.findall("m:c", ns)] for r in ET.fromstring(book.read("xl/worksheets/sheet1.xml")).iter(f"{{{ns['m']}}}row")]
    assert row.n == 50 and len(rows) == 51 and rows[0][:3] == ["ID", "Aktenzeichen", "Titel"] and rows[0][-1] == "Qualität" and rows[1][2].startswith("<&>Entscheidung")
    styles = {c.get("s") for r in ET.fromstring(book.read("xl/worksheets/sheet1.xml")).iter(f"{{{ns['m']}}}c") for c in [r]}
    assert {"0", "1", "2"} >= styles and "2" in styles
    assert excel.excel(d.limit(0)).count() == 0


def test_datasets(spark, tmp_path):
    (tmp_path / "a" / "train").mkdir(parents=True)
    (tmp_path / "a" / "train" / "x.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "b" / "data").mkdir(parents=True)
    spark.range(3).toPandas().to_parquet(tmp_path / "b" / "data" / "test-00000-of-00001.parquet")
    assert readers.read_dataset(spark, str(tmp_path / "a")).count() == 2 and readers.read_dataset(spark, str(tmp_path / "b"), "test").count() == 3
    with pytest.raises(ValueError, match="no split"):
        readers.read_dataset(spark, str(tmp_path / "b"), "train")


def test_flat_eurlex_elements_need_no_parser(spark, tmp_path):
    """What the pattern takes is read as the parser reads it; all else, broken or not, is left to the parser."""
    bodies = ["<CELEX_NUMBER>{}</CELEX_NUMBER>\n <TITLE> a\tb > c </TITLE><TEXT></TEXT><TEXT>x</TEXT><TEXT> </TEXT><AUTHOR/>", "<CELEX_NUMBER>{}</CELEX_NUMBER><TITLE>ä \U0001f600</TITLE><TITLE>zwei</TITLE><TEXT>x</TEXT><TEXT> y</TEXT>", "<CELEX_NUMBER>{}</CELEX_NUMBER><TITLE>a &amp; b</TITLE>",
              "<A><CELEX_NUMBER>{}</CELEX_NUMBER><TITLE k='1'>in</TITLE></A>", "<CELEX_NUMBER>{}</CELEX_NUMBER><TITLE><![CDATA[<c>]]></TITLE>", "<CELEX_NUMBER>{}</CELEX_NUMBER><TITLE>a ]]> b</TITLE>", "<CELEX_NUMBER>{}</CELEX_NUMBER><TITLE>a</TITEL>",
              "<CELEX_NUMBER>{}</CELEX_NUMBER><TITLE>\x0b</TITLE>", "<TITLE>{}</TITLE>", "<CELEX_NUMBER>{}</CELEX_NUMBER>text", "<!-- <TITLE>no</TITLE> --><CELEX_NUMBER>{}</CELEX_NUMBER>", "<CELEX_NUMBER>{}</CELEX_NUMBER>" + "<X>1</X>" * 500]
    whole = [f"<NOTICE>{b.format(k)}</NOTICE>" for k, b in enumerate(bodies)]
    df = spark.createDataFrame(list(enumerate(whole)), "k int, x string")
    assert [r.k for r in df.filter(F.col("x").rlike(readers.flat("NOTICE"))).orderBy("k").collect()] == [1, 8]
    (tmp_path / "e").mkdir()
    (tmp_path / "e/x.xml").write_text("\n".join([*whole, whole[0].replace("<AUTHOR/>", "").replace(">0<", ">12<")]), encoding="utf-8")
    got = {r.id: (r.title, r.court, r.text) for r in readers.read_eurlex(spark, str(tmp_path / "e")).collect()}
    assert got["12"] == got["0"] == ("a\tb > c", None, "x  ") and got["1"] == ("ä \U0001f600", None, "x  y")
    assert got["2"][0] == "a & b" and got["3"][0] == "in" and got["4"][0] == "<c>" and got["10"][0] is None and got["11"] == (None, None, None) and not {"6", "7", "8"} & set(got)


def test_names_of_several_blocks_are_looked_for_one_after_another(spark, monkeypatch):
    """A task has one automaton at a time, and few rows as Python values, with the same results."""
    words = [f"Name{k}" for k in range(30)]
    docs = spark.createDataFrame([(k, f"{words[k % 30]} und {words[(k * 7) % 30]}, Name, {words[k % 30]}x") for k in range(500)] + [(500, None), (501, "Name3 " * 3000)], "id bigint, t string").coalesce(1)
    table = spark.createDataFrame([(w, "PERSON" if k % 2 else "LOCATION") for k, w in enumerate(words)], "name string, kind string")
    want = sorted(map(str, names.without_names(docs, "t", table).collect()))
    monkeypatch.setattr(names, "MOST_NAMES", 8)
    got = names.without_names(docs, "t", table)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2 and sorted(map(str, got.collect())) == want
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 10] * 1000 + [None]})
    assert [b.num_rows for b in names._slices(iter([batch]), "t")] == [200] * 5 + [1]
