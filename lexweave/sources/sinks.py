"""Writers: exports, reports and retention."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.filters import csv_row

#: Rows of an export for people, at most.
MOST_EXPORTED = 10_000


def write_csv(df: DataFrame, path: str, order: str = "id") -> None:
    """The CSV export: a byte order mark, semicolons, a header, at most MOST_EXPORTED rows. Raises where there is nothing."""
    rows = csv_row(df.orderBy(order).limit(MOST_EXPORTED))
    if rows.isEmpty():
        raise LookupError("nothing to export")
    rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    rows.coalesce(1).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text for each decision; the full text only if it is anonymised."""
    shown = df.withColumn("full_text", F.when(F.col("anonymization_applied"), F.col("full_text"))) if "full_text" in df.columns else df
    return shown.select(F.to_json(F.struct(*shown.columns)).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("overwrite").text(path)


def export_metadata(df: DataFrame, filters: dict[str, str] | None = None, as_of: datetime | None = None) -> DataFrame:
    """One row: the block that goes with a JSON export, of when it was made, how many rows it has, and its filters."""
    filled = F.create_map(*(F.lit(x) for pair in (filters or {}).items() for x in pair)) if filters else F.lit(None).cast("map<string,string>")
    when = F.lit(as_of).cast("timestamp_ntz") if as_of else F.current_timestamp().cast("timestamp_ntz")
    return df.agg(F.count("*").alias("total_records")).select(when.alias("export_date"), "total_records", filled.alias("filters_applied"))


def write_json_export(df: DataFrame, path: str, filters: dict[str, str] | None = None, as_of: datetime | None = None) -> None:
    """A JSON export below path: metadata, one object, and decisions, a line for each."""
    export_metadata(df, filters, as_of).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    write_json(df, f"{path}/decisions")


def write_events(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, by day, component and category."""
    _by_day(events).write.mode("append").option("timestampFormat", _MICROS).partitionBy("day", "of_component", "of_category").json(path)


#: Times in event files, with all their digits.
_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _by_day(events: DataFrame) -> DataFrame:
    """Events with what names their folders; the records keep their own fields."""
    return events.withColumns({"day": F.to_date("timestamp"), "of_component": F.coalesce("component", F.lit("unknown")), "of_category": F.col("category")})


#: Bytes of an event file, and days for which events are kept.
MOST_BYTES, KEPT_DAYS = 100 * 1024 * 1024, 30


def write_batch(events: DataFrame, path: str, batch: int, most_bytes: int = MOST_BYTES, days: int = KEPT_DAYS) -> None:
    """Write a micro-batch of events as gzip JSON lines below path/batch=<n>, by day, component and category, and let old days go.

    A file ends after as many rows as make ``most_bytes`` of text on average. The newest event tells what is
    old, so a replay gives the same files. Writing a batch again replaces it.
    """
    rows = _by_day(events)
    line = F.octet_length(F.to_json(F.struct(*events.columns))) + 1
    n, size, newest = rows.agg(F.count("*"), F.avg(line), F.max("day")).first()
    if not n:
        return
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", max(1, int(most_bytes / size))).option("compression", "gzip").option("timestampFormat", _MICROS)
    writer.partitionBy("day", "of_component", "of_category").json(f"{path}/batch={batch}")
    drop_old_days(events.sparkSession, path, newest, days)


def drop_old_days(spark: SparkSession, path: str, today: date, days: int = KEPT_DAYS) -> list[str]:
    """Delete the folders of days more than so many days before today below path/batch=*; returns their names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/day=*")
    system = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    gone = []
    for status in system.globStatus(root) or []:
        folder = status.getPath()
        if folder.getName().removeprefix("day=") < (today - timedelta(days=days)).isoformat():
            system.delete(folder, True)
            gone.append(folder.getName())
    return gone


def kept_events(events: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Events of the last days; with files by day this prunes whole folders."""
    return events.filter(F.col("timestamp") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL '{days}' DAY"))


def daily_report_json(performance: DataFrame, errors: DataFrame, title: str) -> str:
    """The same report as a JSON text."""
    rows = {"performance": performance.orderBy("component"), "errors": errors.orderBy("kind", "value")}
    return json.dumps({"title": title} | {name: [r.asDict() for r in df.limit(1000).collect()] for name, df in rows.items()}, ensure_ascii=False, default=str)


def daily_report(performance: DataFrame, errors: DataFrame, title: str) -> str:
    """A Markdown report of two small aggregates."""
    lines = [f"# {title}", "", "| component | n | mean | p95 |", "|-|-|-|-|"]
    lines += [f"| {r.component} | {r.n} | {r['mean']:.1f} | {r.p95:.1f} |" for r in performance.orderBy("component").limit(1000).collect()]
    lines += ["", "| kind | value | errors |", "|-|-|-|"]
    lines += [f"| {r.kind} | {r.value} | {r.n} |" for r in errors.orderBy("kind", "value").limit(1000).collect()]
    return "\n".join(lines) + "\n"
