import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexweave.operators import duplicates
from lexweave.sources import readers, sinks
from lexweave.streaming import jobs


def test_json_forms(spark, tmp_path):
    docs = [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]
    (tmp_path / "a.json").write_text(json.dumps(docs))
    (tmp_path / "b.jsonl").write_text("\n".join([json.dumps(docs[0]), "", "{broken", json.dumps(docs[1])]))
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, docs)))
    for name, kind in (("a.json", "json"), ("b.jsonl", "jsonl"), ("c.jsonl.gz", "jsonl")):
        path = str(tmp_path / name)
        assert readers.detect_format(spark, path) == kind
        assert readers.read_documents(spark, path).filter("id IS NOT NULL").count() == 2
    assert readers.gzip_lines(tmp_path / "c.jsonl.gz") == 2
    assert readers.validated(spark, str(tmp_path / "a.json")) == []
    assert readers.validated(spark, str(tmp_path / "missing.json"))


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Urteilsdatum;Akten-Zeichen;Urteilstext\n01.02.2020;n/a;Text\n")
    row = readers.swiss_csv(readers.read_csv(spark, str(tmp_path / "a.csv"))).first()
    assert (row.date, row.akten_zeichen, row.text, row.source) == ("01.02.2020", None, "Text", "swiss_csv")


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><decision id='7'><title>T</title><court>A</court><court>B</court></decision></r>")
    row = readers.read_documents(spark, str(tmp_path / "a.xml")).first()
    assert (row.attribute_id, row.title, list(row.court)) == (7, "T", ["A", "B"])


def test_swiss_standard(spark):
    df = spark.createDataFrame([("", "u1", "x", "t", "13.07.2021", "k"), ("1", "u2", "", "t", "", "k")], "id string, uuid string, text string, header string, date string, extra string")
    (row,) = readers.swiss_standard(df).collect()
    assert (row.id, row.title, row.metadata, row.decision_date) == ("u1", "t", {"extra": "k"}, datetime(2021, 7, 13))


def test_html(spark):
    row = spark.createDataFrame([("<p>A<script>no</script></p><a href='/x'>L</a>",)], "h string").select(readers.parsed_html(F.col("h")).alias("p")).first().p
    assert row.text == "A\nL" and (row.links[0].title, row.links[0].href) == ("L", "/x")


def test_export(spark, tmp_path, data):
    from lexweave.plans.views import Views

    d = Views(spark, data).decisions
    sinks.write_csv(d, str(tmp_path / "out"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "out")).count() == d.count()
    with pytest.raises(LookupError):
        sinks.write_csv(d.filter("false"), str(tmp_path / "none"))


def test_upsert_and_absent(spark):
    old = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "id string, t string, s int")
    new = spark.createDataFrame([("2", "x", 5), ("3", "c", 3), ("3", "d", 4)], "id string, t string, s int")
    assert {tuple(r) for r in duplicates.upserted(old, new.filter("t <> 'd'"), ("id",), ("s",)).collect()} == {("1", "a", 1), ("2", "b", 5), ("3", "c", 3)}
    assert [r.id for r in duplicates.absent(new, old, "id").collect()] == ["3"]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    schema = "id string, component string, operation string, timestamp timestamp, duration_ms double, user_id string"
    rows = [(str(i % 15), "c", "o", datetime(2024, 1, 1, 0, i % 50), float(i), "u") for i in range(30)]
    spark.createDataFrame(rows, schema).write.json(str(source))
    stream = jobs.documents(spark, str(source), spark.createDataFrame([], schema).schema)
    jobs.import_available(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    jobs.import_available(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30

    def drained(df, mode):
        q = df.writeStream.format("memory").queryName("t").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table("t").collect()

    assert len(drained(jobs.first_seen(stream, ["id"]), "append")) == 15
    assert sum(r.n for r in drained(jobs.hourly(stream), "complete")) == 30
    (last,) = drained(jobs.rolling_baselines(stream), "update")
    assert last.seen == 30


def test_schema(spark):
    from lexweave import schema

    df = schema.conform(spark.createDataFrame([("1", "t", "x"), ("1", None, "3")], "id string, title string, quality_score string"))
    assert df.columns[:3] == ["id", "source", "source_id"] and [r.quality_score for r in df.collect()] == [None, 3]
    assert schema.duplicated_keys(df, "id").first().n == 2
    assert sorted(r.broken for r in schema.violations(df).collect()) == [["source"], ["title", "source"]]


def test_event_round_trip(spark, tmp_path):
    from lexweave.schema import EVENT

    row = spark.createDataFrame([], EVENT).schema
    event = {"id": "1", "timestamp": datetime(2024, 1, 2), "component": "c", "category": "error", "performance": {"duration_ms": 5.0}, "error": {"type": "E"}, "triage": {"tags": ["a"], "requires_analysis": True, "priority_score": 90}}
    events = spark.createDataFrame([event], row)
    sinks.write_events(events, str(tmp_path / "log"))
    flat = readers.flat_events(spark.read.schema(EVENT).json(str(tmp_path / "log"))).first()
    assert (flat.id, flat.duration_ms, flat.error_type, flat.priority_score, flat.component) == ("1", 5.0, "E", 90, "c")
    assert sinks.kept_events(events, datetime(2024, 1, 20)).count() == 1 and sinks.kept_events(events, datetime(2024, 3, 1)).count() == 0


def test_eurlex(spark, tmp_path):
    path = tmp_path / "notices.xml"
    path.write_text("<ALL>\n<NOTICE><CELEX_NUMBER>62019CJ1</CELEX_NUMBER><A><TITLE>T</TITLE></A><TEXT>eins</TEXT><TEXT>zwei</TEXT></NOTICE>\n<NOTICE><TITLE>ohne</TITLE></NOTICE>\n<JUDGMENT x='1'><CELEX_NUMBER>62020CJ2</CELEX_NUMBER><AUTHOR>CJEU</AUTHOR></JUDGMENT></ALL>")
    got = {r.id: r for r in readers.read_eurlex(spark, str(path)).collect()}
    assert set(got) == {"62019CJ1", "62020CJ2"} and got["62019CJ1"].title == "T" and got["62019CJ1"].text == "eins zwei" and got["62020CJ2"].court == "CJEU" and got["62020CJ2"].text is None
