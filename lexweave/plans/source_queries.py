"""Queries through sources and sinks: tables are written in a format and read back, each with its SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave import stages
from lexweave.functions import references, variants
from lexweave.functions.names import anonymised_by
from lexweave.operators import filters, ordered
from lexweave.plans.queries import query
from lexweave.sources import counted, excel, readers, sinks
from lexweave.sources.paged import PagedSource

#: Folders that one task writes.
FOLDERS_PER_TASK = 100


def _folder(v, name: str) -> str:
    return f"{stages.folder(v.spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


# --- JSON


@query("""SELECT count(*) AS read, count(*) FILTER (id::INT % 10 = 7) AS malformed, count(*) FILTER (id::INT % 10 <> 7 AND quality_score < 3) AS irrelevant, count(*) FILTER (id::INT % 10 <> 7 AND quality_score >= 3) AS kept,
  count(*) FILTER (id::INT % 10 <> 7 AND quality_score >= 3) AS stored FROM decisions""")
def imported_lines(v):
    """An import of gzip JSON lines, of which every tenth is cut off, that counts in the pass that writes."""
    path, target = _folder(v, "lines"), _folder(v, "imported")
    line = F.to_json(F.struct("id", "title", "quality_score"))
    lines = v.decisions.select(F.when(F.col("id").cast("int") % 10 == 7, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    lines.write.option("compression", "gzip").text(path)
    counts = counted.import_lines(v.spark, path, "id string, title string, quality_score int", target, F.col("quality_score"))
    row = v.spark.createDataFrame([tuple(counts[k] for k in ("read", "malformed", "irrelevant", "kept"))], "read bigint, malformed bigint, irrelevant bigint, kept bigint")
    return row.crossJoin(v.spark.read.parquet(target).agg(F.count("*").alias("stored")))  # one row each


@query("SELECT doc_id, length(text) AS chars, doc_id // 100 AS file FROM documents")
def json_arrays(v):
    """Files that each are one JSON array, of a hundred documents, read whole."""
    path = _folder(v, "arrays")
    arrays = v.documents.groupBy(F.floor(F.col("doc_id") / 100).alias("file")).agg(F.to_json(F.collect_list(F.struct("doc_id", "text"))).alias("value"))
    arrays.repartition("file").write.partitionBy("file").option("compression", "gzip").text(path)
    docs = readers.read_documents(v.spark, path, "json")
    return docs.select("doc_id", F.length("text").cast("long").alias("chars"), F.col("file").cast("long").alias("file"))


@query("SELECT id, title FROM decisions ORDER BY id LIMIT 30 OFFSET 50")
def read_from_offset(v):
    path = _folder(v, "offset")
    _lines(v.decisions, "id", "title").write.text(path)
    return readers.after(readers.read_documents(v.spark, path, "jsonl"), 50, 30, "id").select("id", "title")


@query("SELECT count(*) AS documents, count(*) AS counted, TRUE AS files, TRUE AS valid, 'jsonl' AS format FROM documents")
def file_facts(v):
    """What is known of a folder of JSON lines: documents by file and in all, whether it is valid, its format by content."""
    path = _folder(v, "facts")
    _lines(v.documents, "doc_id", "text").write.text(path)
    info = readers.file_info(readers.read_documents(v.spark, path, "jsonl"))
    kind, errors, n = readers.detect_format(v.spark, path), readers.validated(v.spark, path), readers.document_count(v.spark, path)
    return info.agg(F.sum("documents").alias("documents"), (F.min("size") > 0).alias("files")).select("documents", F.lit(n).cast("long").alias("counted"), "files", F.lit(not errors).alias("valid"), F.lit(kind).alias("format"))


@query("""SELECT id, title, court, n.total AS total_records, 'ris' AS source, TIMESTAMP '2001-08-01' AS export_date FROM decisions, (SELECT count(*) AS total FROM decisions WHERE source = 'ris') n WHERE source = 'ris'""")
def json_export(v):
    """A JSON export, its lines and its metadata read back."""
    path = _folder(v, "export")
    sinks.write_json_export(v.decisions.filter("source = 'ris'"), path, {"source": "ris"}, datetime(2001, 8, 1))
    meta = v.spark.read.schema("export_date timestamp_ntz, total_records bigint, filters_applied map<string,string>").json(f"{path}/metadata")
    rows = v.spark.read.schema("id string, title string, court string").json(f"{path}/decisions")
    return rows.crossJoin(F.broadcast(meta)).select("id", "title", "court", "total_records", F.col("filters_applied")["source"].alias("source"), "export_date")


# --- CSV, XML, Parquet


@query("""SELECT id, case_number AS aktenzeichen, title AS titel, court AS gericht, strftime(decision_date, '%Y-%m-%d') AS datum, nullif(array_to_string(coalesce(gdpr_articles, []), ', '), '') AS dsgvo_artikel,
  nullif(array_to_string(coalesce(keywords, []), ', '), '') AS keywords, left(leitsatz, 200) || '...' AS leitsatz, source AS quelle, NULL::VARCHAR AS url, CASE WHEN anonymization_applied THEN 'Ja' ELSE 'Nein' END AS anonymisiert FROM decisions ORDER BY id LIMIT 10000""")
def csv_export(v):
    """The CSV export, read back and cleaned; it holds 10,000 rows at most, by id."""
    path = _folder(v, "csv")
    sinks.write_csv(v.decisions, path)
    rows = readers.read_csv(v.spark, path, ";")
    return rows.toDF(*(c.replace("\ufeff", "") for c in rows.columns))


@query("SELECT least(count(*), 10000) AS n, TRUE AS zipped FROM decisions")
def excel_export(v):
    """The spreadsheet of the first 10,000 decisions: its rows, and that it is a zip file."""
    return excel.excel(v.decisions, {"Export": "Test"}).select("n", (F.hex(F.substring("workbook", 1, 2)) == "504B").alias("zipped"))


@query("SELECT id, title, court, case_number, decision_date, source, quality_score, anonymization_applied, created_at FROM decisions")
def admin_rows(v):
    return filters.admin_row(v.decisions)


@query("SELECT strftime(decision_date, '%d.%m.%Y') AS date, case_number AS file_number, court, title AS text, 'swiss_csv' AS source, id AS kennung FROM decisions")
def swiss_csv_rows(v):
    path = _folder(v, "swiss")
    v.decisions.select(F.date_format("decision_date", "dd.MM.yyyy").alias("Urteilsdatum"), F.col("case_number").alias("Aktenzeichen"), F.col("court").alias("Gericht"), F.concat(F.lit(" "), "title").alias("Urteilstext"), F.col("id").alias("Kennung")).write.option("header", True).option("sep", ";").csv(path)
    return readers.swiss_csv(readers.read_csv(v.spark, path))


@query("""SELECT id, title AS text, court, decision_date, CASE WHEN id::INT % 2 = 0 THEN NULL ELSE source END AS source FROM decisions WHERE title <> '' AND (id::INT % 2 = 0 OR id::INT % 3 <> 0)""")
def swiss_parquet_rows(v):
    """Two Parquet files of different columns, by their standard names; rows without text go."""
    d, even = v.decisions, F.col("id").cast("int") % 2 == 0
    day = F.date_format("decision_date", "yyyy-MM-dd'T'HH:mm:ss")
    paths = [_folder(v, "even"), _folder(v, "odd")]
    d.filter(even).select(F.col("id").alias("decision_id"), F.col("title").alias("full_text"), F.col("court").alias("chamber"), day.alias("date")).write.parquet(paths[0])
    d.filter(~even).select("id", F.when(F.col("id").cast("int") % 3 != 0, F.col("title")).otherwise("").alias("text"), "court", day.alias("decision_date"), "source").write.parquet(paths[1])
    rows = readers.swiss_standard(readers.read_parquet_files(v.spark, *paths))
    return rows.select("id", "text", "court", "decision_date", F.col("metadata")["source"].alias("source"))


def _escaped(column: str) -> Column:
    return F.replace(F.replace(F.coalesce(column, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@query("SELECT CASE id::INT % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'case' ELSE 'judgment' END AS element, id::BIGINT AS id, title, court, CASE WHEN id::INT % 3 = 1 THEN case_number END AS docket FROM decisions")
def xml_elements(v):
    """Files of elements of three names, of which one has a field of its own."""
    path, k = _folder(v, "xml"), F.col("id").cast("int") % 3
    for n, tag in enumerate(readers.DECISION_TAGS):
        rows = v.decisions.filter(k == n).select(F.col("id").alias("attribute_id"), "title", "court", *([F.col("case_number").alias("docket")] if tag == "case" else []))
        rows.write.format("xml").option("rootTag", "decisions").option("rowTag", tag).option("attributePrefix", "attribute_").save(f"{path}/{tag}")
    rows = readers.read_xml(v.spark, f"{path}/*")
    return rows.select("element", F.col("attribute_id").alias("id"), "title", "court", "docket")


@query("""SELECT 'eurlex' AS source, '6' || id AS id, title, court, CASE WHEN id::INT % 4 = 0 THEN NULL ELSE title || ' ' || case_number END AS text FROM decisions WHERE id::INT % 10 <> 7""")
def eurlex_rows(v):
    """Notices and judgments, of which every tenth is broken by a bare ampersand."""
    path, k = _folder(v, "eurlex"), F.col("id").cast("int")
    tag = F.when(k % 2 == 0, "NOTICE").otherwise("JUDGMENT")
    part = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    texts = F.when(k % 4 == 0, "").otherwise(F.concat(part("TEXT", _escaped("title")), part("TEXT", _escaped("case_number"))))
    author = F.when(F.col("court").isNotNull(), part("AUTHOR", _escaped("court"))).otherwise("")
    title = F.concat(_escaped("title"), F.when(k % 10 == 7, " & Co").otherwise(""))
    body = F.concat(F.lit("<"), tag, F.lit(">"), part("CELEX_NUMBER", F.concat(F.lit("6"), "id")), part("TITLE", title), author, texts, F.lit("</"), tag, F.lit(">"))
    v.decisions.select(body.alias("value")).write.text(path)
    return readers.read_eurlex(v.spark, path).select("source", "id", "title", "court", "text")


# --- events


@query("SELECT event_id::VARCHAR AS id, timestamp, component, duration_ms, cpu_percent, error_type, feature, priority_score FROM event_log WHERE timestamp >= (SELECT date_trunc('day', max(timestamp)) - INTERVAL 10 DAY FROM event_log)")
def event_files(v):
    """Events as nested records in gzip JSON lines by day, of which ten days before the newest are kept, flat again."""
    path = _folder(v, "events")
    rows = v.events.select(F.col("event_id").cast("string").alias("id"), F.col("timestamp").cast("timestamp").alias("timestamp"), F.lit("system_metric").alias("event_type"), "priority", "category", "component", "operation", "duration_ms", "memory_mb", "cpu_percent", "error_type", "user_impact", "feature", "requires_analysis", F.col("priority_score").cast("int").alias("priority_score"))
    sinks.write_batch(readers.nested_events(rows), path, 0, days=10)
    found = readers.flat_events(readers.event_log(v.spark, path))
    return found.select("id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "component", "duration_ms", "cpu_percent", "error_type", "feature", "priority_score")


# --- listings


@query("SELECT lang AS term, ((k - 1) // 20 + 1)::INT AS page, k - 1 AS place, doc_id::VARCHAR AS id, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents WHERE lang IN ('de', 'en', 'fr'))")
def paged_listing(v):
    """Listings of the documents of three languages, twenty a page, read through the data source of paged listings."""
    path = _folder(v, "listing")
    docs = ordered.row_numbers(v.documents.filter("lang IN ('de', 'en', 'fr')").select("lang", "doc_id", F.length("text").alias("chars")), "lang", "doc_id", "k")
    counts = docs.groupBy("lang").agg(F.count("*").alias("count"))
    item = F.struct("k", F.col("doc_id").alias("id"), F.lit("2024-01-01").alias("updated_date"), "chars")
    pages = docs.groupBy("lang", (F.floor((F.col("k") - 1) / 20) + 1).alias("page")).agg(F.sort_array(F.collect_list(item)).alias("results"))
    answers = pages.join(counts, "lang").select(F.col("lang").alias("term"), "page", F.to_json(F.struct("count", "results")).alias("value"))
    n = docs.count() // (20 * FOLDERS_PER_TASK) + 1  # a number of its own: by size, all folders would be one task's
    answers.repartition(n, "term", "page").write.partitionBy("term", "page").text(path)
    v.spark.dataSource.register(PagedSource)
    rows = v.spark.read.format("paged").options(path=path, terms="de,en,fr", page_size="20", pages_per_task="3").load()
    return rows.select("term", "page", "place", "id", F.get_json_object("document", "$.chars").cast("long").alias("chars"))


# --- fields of several forms, references, names


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'object' WHEN 1 THEN 'float' WHEN 2 THEN 'text' WHEN 3 THEN 'int' WHEN 4 THEN 'bool' END AS kind, CASE WHEN event_id % 6 = 0 THEN (props->>'$.k')::BIGINT END AS k, CASE WHEN event_id % 6 = 1 THEN value + 0.5 END AS number, CASE WHEN event_id % 6 = 2 THEN event_type END AS word FROM events""")
def typed_cells(v):
    """Cells of all types in one column: JSON, numbers, words, truth values and null-like texts."""
    k = F.col("event_id") % 6
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit(" "), (F.col("value") + 0.5).cast("string"))).when(k == 2, F.col("event_type")).when(k == 3, F.col("event_id").cast("string")).when(k == 4, F.lit("TRUE")).otherwise(" N/A ")
    cells = v.table("events").select("event_id", variants.cell(text).alias("c"))
    return cells.select("event_id", variants.kind(F.col("c")).alias("kind"), F.try_variant_get("c", "$.k", "bigint").alias("k"), F.when(k == 1, F.try_variant_get("c", "$", "double")).alias("number"), F.when(k == 2, F.try_variant_get("c", "$", "string")).alias("word"))


@query("SELECT id, court, CASE WHEN id::INT % 3 = 0 THEN id ELSE id || '|x' END AS numbers FROM decisions")
def fields_of_several_forms(v):
    """A court that is an object or its name, and numbers that are a list or one of them, in JSON records."""
    k = F.col("id").cast("int")
    court = F.when(k % 2 == 0, F.to_json(F.struct(F.struct(F.col("court").alias("name"), F.lit("x").alias("slug")).alias("court")), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct("court"), {"ignoreNullFields": "false"}))
    numbers = F.when(k % 3 == 0, F.to_json(F.struct(F.col("id").alias("n")))).otherwise(F.to_json(F.struct(F.array("id", F.lit("x")).alias("n"))))
    records = v.decisions.select("id", F.try_parse_json(court).alias("c"), F.try_parse_json(numbers).alias("n"))
    at = lambda c, path: F.variant_get(c, path, "variant")
    return records.select("id", variants.named(at("c", "$.court")).alias("court"), F.array_join(variants.listed(at("n", "$.n")), "|").alias("numbers"))


_REFERENCE_SQL = "UNION ALL".join(
    f""" SELECT doc_id, '{law}' AS law, nullif(regexp_extract(m, '{p}', 1, 'i'), '') AS article, nullif(regexp_extract(m, '{p}', 2, 'i'), '') AS paragraph, {f"nullif(regexp_extract(m, '{p}', 3, 'i'), '')" if letter else 'NULL'} AS letter,
    (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::INT AS start
    FROM (SELECT doc_id, f, g, unnest(f) AS m, generate_subscripts(f, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0, 'i') AS f, string_split_regex(text, '(?i){p}') AS g FROM legal_docs)) """
    for law, p, letter in references.LAWS
)


@query(f"WITH r AS ({_REFERENCE_SQL}) SELECT DISTINCT doc_id, law, article, paragraph, letter, start FROM r")
def extracted_references(v):
    """References with their places, through SQL and the table function."""
    references.register(v.spark)
    v.legal_docs.createOrReplaceTempView("legal_docs_of_references")
    return v.spark.sql("SELECT d.doc_id, r.* FROM legal_docs_of_references d, LATERAL extract_references(d.text) r")


@query()
def masked_names(v):
    """The texts without the longer words that texts begin with, taken as a table of names; tests compare it with brute force."""
    first = F.regexp_extract("text", r"^([\p{L}]{5,})\b", 1)
    names = v.documents.select(first.alias("name")).filter("name <> ''").distinct().select("name", F.when(F.length("name") % 2 == 0, "PERSON").otherwise("ORGANIZATION").alias("kind"))
    found = anonymised_by(v.documents.select("doc_id", "text"), "text", "names", names)
    return found.select("doc_id", "anonymised", F.size("names").alias("n_names"), "error")
