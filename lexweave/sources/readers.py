"""Readers for document dumps: format detection, validation, dialects and standard columns."""

from __future__ import annotations

import gzip
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexweave.functions import html as pages
from lexweave.functions.scalars import field_name, parsed_date, typed
from lexweave.schema import EVENT

SUFFIXES = {".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".xml": "xml", ".parquet": "parquet"}
# German column names of the Swiss CSV dialect.
SWISS_CSV = {
    "urteilsdatum": "date", "aktenzeichen": "file_number", "gericht": "court", "kanton": "canton", "rechtsgebiet": "legal_area",
    "urteilstext": "text", "zusammenfassung": "summary", "sprache": "language", "bge_nummer": "bge_id",
}
# Alternative column names of the Swiss Parquet dialect.
SWISS_NAMES = {
    "id": ["id", "decision_id", "uuid"], "text": ["text", "full_text", "content", "considerations", "facts"], "title": ["title", "header", "file_name"],
    "court": ["court", "chamber", "origin_court"], "canton": ["canton", "origin_canton"], "legal_area": ["legal_area", "law_area"], "language": ["language", "lang"], "date": ["date", "decision_date"],
}


def detect_format(spark: SparkSession, path: str) -> str:
    """json, jsonl, csv, xml or parquet by the suffix, also before .gz; where that doesn't tell, by the first lines."""
    name = path.rstrip("/").removesuffix(".gz")
    for suffix, kind in SUFFIXES.items():
        if name.endswith(suffix):
            return kind
    first = [r[0] for r in spark.read.text(path).filter("trim(value) <> ''").limit(2).collect()]
    if first and first[0].lstrip()[:1] in "[{":
        try:
            json.loads(first[0])
            return "jsonl" if first[0].lstrip().startswith("{") else "json"
        except ValueError:
            return "json"
    raise ValueError(f"unknown format: {path}")


def read_documents(spark: SparkSession, path: str, kind: str | None = None, schema: StructType | None = None, row_tag: str = "decision") -> DataFrame:
    """The documents of a file or folder. Malformed JSON lines are dropped; a .gz file is one task until repartitioned."""
    kind = kind or detect_format(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "json":
        return reader.option("multiLine", True).json(path)
    if kind == "jsonl":
        return reader.option("mode", "DROPMALFORMED").json(path)
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "xml":
        return reader.format("xml").option("rowTag", row_tag).option("attributePrefix", "attribute_").option("valueTag", "value").load(path)
    return reader.parquet(path)


# Fixed value: the elements that a decision may be.
DECISION_TAGS = ("decision", "case", "judgment")


def read_xml(spark: SparkSession, path: str, *tags: str) -> DataFrame:
    """The elements of several names in XML files, with all their columns and ``element``, the name; a broken element gives no row."""
    parts = []
    for tag in tags or DECISION_TAGS:
        rows = spark.read.format("xml").option("rowTag", tag).option("mode", "DROPMALFORMED").option("attributePrefix", "attribute_").option("valueTag", "value").load(path)
        if rows.columns:
            parts.append(rows.withColumn("element", F.lit(tag)))
    if not parts:
        raise ValueError(f"no elements {', '.join(tags or DECISION_TAGS)}: {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_parquet_files(spark: SparkSession, *paths: str, limit: int | None = None) -> DataFrame:
    """The rows of several Parquet files or folders with all their columns, at most so many."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(spark.read.parquet, paths))
    return rows if limit is None else rows.limit(limit)


def read_dataset(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """A split of a published dataset that was downloaded: <split>/ or data/<split>-*, of Parquet files or JSON lines."""
    where = spark._jvm.org.apache.hadoop.fs.Path
    system = where(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for folder, pattern in ((f"{path}/{split}", "*"), (f"{path}/data", f"{split}-*"), (path, f"{split}-*")):
        for suffix, kind in ((".parquet", "parquet"), (".jsonl", "json"), (".jsonl.gz", "json")):
            if system.globStatus(where(f"{folder}/{pattern}{suffix}")):
                return spark.read.option("pathGlobFilter", f"{pattern}{suffix}").format(kind).load(folder)
    raise ValueError(f"no split {split}: {path}")


def document_count(spark: SparkSession, path: str, kind: str | None = None) -> int:
    """How many documents a file or folder has; blank and broken lines aren't any."""
    kind = kind or detect_format(spark, path)
    if kind != "jsonl":
        return read_documents(spark, path, kind).count()
    line = F.trim("value")
    return spark.read.text(path).filter(line.startswith("{") & F.try_parse_json(line).isNotNull()).count()


# Elements of a EUR-Lex document, by the names of its columns.
EURLEX = {"id": "CELEX_NUMBER", "title": "TITLE", "date": "DATE_DOCUMENT", "court": "AUTHOR", "legal_area": "SUBJECT_MATTER", "procedure_type": "PROCEDURE_TYPE"}


def flat(tag: str) -> str:
    """A pattern of elements that hold nothing but up to 100 plain ones without attributes, entities and signs that XML changes or forbids: well-formed, and to be read by patterns."""
    plain = r"[^<&\]\x00-\x08\x0B-\x1F\x{D800}-\x{DFFF}\x{FFFE}\x{FFFF}]*+"
    return rf"^<{tag}>(?:\s*+<([A-Z_]++)>{plain}</\1>){{0,100}}+\s*+</{tag}>$"


def read_eurlex(spark: SparkSession, path: str) -> DataFrame:
    """(source, id, title, date, court, legal_area, procedure_type, text) of the NOTICE and JUDGMENT elements that have a CELEX number.

    A file is split where an element ends, so that large files are read by many tasks; texts are joined
    by a blank, missing elements are null. A broken element gives no row and harms no other. Flat
    elements, as most are, are read by patterns; only others take an XML parser, which reads them once a field.
    """
    parts, value = [], lambda element: f"<{element}>([^<]*)</{element}>"
    for tag in ("NOTICE", "JUDGMENT"):
        opened = spark.read.option("lineSep", f"</{tag}>").text(path).select(F.regexp_extract("value", rf"(?s)<{tag}[\s>].*", 0).alias("open")).filter("open <> ''")
        xml = opened.select(F.concat("open", F.lit(f"</{tag}>")).alias("xml")).withColumn("flat", F.col("xml").rlike(flat(tag)))
        # xpath raises on what isn't well-formed, so such elements go first
        parsed = F.from_xml("xml", "CELEX_NUMBER STRING, _broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
        whole = xml.filter(F.col("flat") | (parsed["_broken"].isNull() & ~F.col("xml").rlike(r"&(?!(amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)")))
        either = lambda pattern, path: F.when(F.col("flat"), pattern).otherwise(path)
        fields = [F.nullif(F.trim(either(F.regexp_extract("xml", value(element), 1), F.call_function("xpath_string", "xml", F.lit(f"//{element}")))), F.lit("")).alias(name) for name, element in EURLEX.items()]
        texts = either(F.regexp_extract_all("xml", F.lit(value("TEXT")), F.lit(1)), F.call_function("xpath", "xml", F.lit("//TEXT/text()")))
        text = F.nullif(F.array_join(F.array_remove(texts, ""), " "), F.lit("")).alias("text")
        parts.append(whole.select(F.lit("eurlex").alias("source"), *fields, text))
    return parts[0].unionByName(parts[1]).filter("id IS NOT NULL")


def delimiter(spark: SparkSession, path: str) -> str:
    """The separator that the header has most of."""
    head = spark.read.text(path).limit(1).collect()
    return max(";,\t|", key=(head[0][0] if head else "").count)


def cleaned(df: DataFrame) -> DataFrame:
    """df with normalised column names and trimmed texts; empty and null-like values are null, and rows without any value go."""
    clean = lambda c: F.when(~F.lower(F.trim(c)).isin("", "null", "none", "n/a"), F.trim(c))
    rows = df.select(*(clean(F.col(f"`{c}`")).alias(field_name(c)) for c in df.columns))
    return rows.dropna("all")


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A CSV file with normalised column names, all as text; empty and null-like values are null."""
    return cleaned(spark.read.option("header", True).option("sep", sep or delimiter(spark, path)).option("multiLine", True).option("escape", '"').csv(path))


def typed_columns(df: DataFrame) -> DataFrame:
    """Each text column as struct<bool, int, float, text>, of which the first type that fits is set."""
    return df.select(*(typed(F.col(c)).alias(c) for c in df.columns))


def swiss_csv(df: DataFrame) -> DataFrame:
    """The Swiss CSV dialect with English names and its source."""
    return df.withColumnsRenamed({k: v for k, v in SWISS_CSV.items() if k in df.columns}).withColumn("source", F.lit("swiss_csv"))


def filled(*columns: Column) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns))


def swiss_standard(df: DataFrame) -> DataFrame:
    """Standard columns from the first filled of their alternative names, the others as metadata; rows without text go."""
    used = {c for names in SWISS_NAMES.values() for c in names}
    out = {name: filled(*(F.col(c) for c in names if c in df.columns)) if any(c in df.columns for c in names) else F.lit(None).cast("string") for name, names in SWISS_NAMES.items()}
    rest = [c for c in df.columns if c not in used]
    meta = F.map_filter(F.create_map(*(x for c in rest for x in (F.lit(c), F.col(c).cast("string")))), lambda k, v: v.isNotNull()) if rest else F.lit(None).cast("map<string,string>")
    standard = df.select(*(c.alias(n) for n, c in out.items()), meta.alias("metadata")).filter("text IS NOT NULL")
    return standard.withColumn("decision_date", parsed_date(F.col("date")))


def document_id(*candidates: Column, text: Column) -> Column:
    """The first filled candidate, else 16 digits of the MD5 of the text's first 1,000 characters."""
    return F.coalesce(filled(*candidates), F.substring(F.md5(F.substring(text, 1, 1000).cast("binary")), 1, 16))


#: Fixed value: bytes from which on a file should be looked at.
LARGE_FILE = 10 * 1024**3


def validated(spark: SparkSession, path: str, samples: int = 3, large: int = LARGE_FILE) -> list[str]:
    """What is wrong with a file or folder: that it isn't there, is empty or very large, has an unknown format, can't be read or holds no documents."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(where):
        return [f"not found: {path}"]
    size = system.getContentSummary(where).getLength()
    errors = [f"empty: {path}"] if size == 0 else [f"very large: {size} bytes"] if size > large else []
    try:
        kind = detect_format(spark, path)
        rows = read_documents(spark, path, kind)
        rows = rows.dropna("all") if rows.columns else rows
        if not rows.columns or not rows.limit(samples).count():
            errors.append("no documents")
    except Exception as e:  # a reader's error is the answer
        errors.append(f"{type(e).__name__}: {str(e).splitlines()[0]}")
    return errors


def file_info(df: DataFrame) -> DataFrame:
    """(file, size, documents) of what a scan reads."""
    meta = df.metadataColumn("_metadata")
    return df.select(meta["file_path"].alias("file"), meta["file_size"].alias("size")).groupBy("file", "size").agg(F.count("*").alias("documents"))


def after(df: DataFrame, skip: int, limit: int | None = None, *order: str) -> DataFrame:
    """The rows behind the first ``skip`` in a stated order."""
    if not order:
        raise ValueError("an offset needs an order")
    out = df.orderBy(*order).offset(skip)
    return out if limit is None else out.limit(limit)


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """The nested event records below a folder of JSON lines, gzip ones too."""
    return spark.read.schema(EVENT).option("recursiveFileLookup", True).json(path)


def nested_events(rows: DataFrame) -> DataFrame:
    """Flat event rows as the nested records of the log, the other way of flat_events; a part of which nothing is set is null."""

    def part(**fields: str) -> Column:
        has = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in fields.values()))
        return F.when(has, F.struct(*(F.col(c).alias(name) for name, c in fields.items())))

    return rows.select(
        "id", "timestamp", "event_type", "priority", "category", "component", "operation",
        part(duration_ms="duration_ms", memory_mb="memory_mb", cpu_percent="cpu_percent").alias("performance"),
        part(user_impact="user_impact", feature_affected="feature").alias("business_impact"), part(type="error_type").alias("error"),
        part(requires_analysis="requires_analysis", priority_score="priority_score").alias("triage"),
    )


def flat_events(events: DataFrame) -> DataFrame:
    """The columns that the analytics use, from nested records."""
    return events.select(
        "id", "timestamp", "event_type", "priority", "category", "component", "operation", "performance.duration_ms", "performance.memory_mb", "performance.cpu_percent",
        F.col("error.type").alias("error_type"), F.col("business_impact.user_impact").alias("user_impact"), F.col("business_impact.feature_affected").alias("feature"),
        F.col("triage.requires_analysis").alias("requires_analysis"), F.col("triage.priority_score").alias("priority_score"),
    )


def parsed_html(html: Column) -> Column:
    """struct<text, links array<struct<title, href>>> of a page; a link's title is its text."""
    shown = F.transform(pages.links(html), lambda x: F.struct(x["text"].alias("title"), x["href"].alias("href")))
    return F.struct(pages.main_text(html).alias("text"), shown.alias("links"))


def gzip_lines(path: str) -> int:
    """Lines of a local gzip file that aren't blank; for small files on the driver."""
    with gzip.open(path, "rt") as file:
        return sum(bool(line.strip()) for line in file)
