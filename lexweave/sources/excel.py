"""The spreadsheet export: a workbook of at most MOST_EXPORTED rows, written in one task."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators.filters import CSV_NAMES, csv_row
from lexweave.sources.sinks import MOST_EXPORTED

# The columns' widths, the court types whose rows are coloured, and the colours of header and rows.
WIDTHS = (20, 20, 50, 25, 12, 30, 30, 50, 15, 40, 12, 10)
COURT_COLOURS = {"BGH": "FFE6F3FF", "EuGH": "FFFFF2E6"}
HEADER_COLOUR = "FF366092"

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _column(k: int) -> str:
    return (chr(64 + k // 26) if k // 26 else "") + chr(65 + k % 26)


def _cells(row: int, values: list, style: int) -> str:
    return f'<row r="{row}">' + "".join(f'<c r="{_column(k)}{row}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(_clean(v))}</t></is></c>' for k, v in enumerate(values)) + "</row>"


def _clean(value: object) -> str:
    """A value as text that XML can hold."""
    return "".join(c for c in ("" if value is None else str(value))[:32_767] if c in "\t\n\r" or " " <= c < "￾" or c > "￿")


def _sheet(header: list[str], rows: list[tuple[list, int]], filtered: bool) -> str:
    columns = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{w}" customWidth="1"/>' for k, w in enumerate(WIDTHS[: len(header)]))
    body = _cells(1, header, 1) + "".join(_cells(n, values, style) for n, (values, style) in enumerate(rows, 2))
    auto = f'<autoFilter ref="A1:{_column(len(header) - 1)}{len(rows) + 1}"/>' if filtered else ""
    return f'<worksheet xmlns="{_MAIN}"><cols>{columns}</cols><sheetData>{body}</sheetData>{auto}</worksheet>'


def workbook(header: list[str], rows: list[list], court: int, metadata: list[tuple[str, str]]) -> bytes:
    """A workbook with the sheets Entscheidungen, its rows coloured by court type, and Metadaten."""
    styles = list(COURT_COLOURS)
    shown = [(r, next((k + 2 for k, name in enumerate(styles) if name in (r[court] or "")), 0)) for r in rows]
    sheets = {"Entscheidungen": _sheet(header, shown, True), "Metadaten": _sheet(["Feld", "Wert"], [([a, b], 0) for a, b in metadata], False)}
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in (HEADER_COLOUR, *COURT_COLOURS.values()))
    formats = '<xf fontId="0" fillId="0"/><xf fontId="1" fillId="2" applyFill="1" applyFont="1"/>' + "".join(f'<xf fontId="0" fillId="{k + 3}" applyFill="1"/>' for k in range(len(styles)))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in (1, 2)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_DOCUMENT}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOCUMENT}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{_DOCUMENT}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in (1, 2)) + f'<Relationship Id="r3" Type="{_DOCUMENT}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts><fills count="{2 + 1 + len(styles)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellXfs count="{2 + len(styles)}">{formats}</cellXfs></styleSheet>',
        **{f"xl/worksheets/sheet{k}.xml": sheet for k, sheet in enumerate(sheets.values(), 1)},
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for name, content in parts.items():
            file.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + content)
    return out.getvalue()


def _books(batches: Iterator[pa.RecordBatch], court: int, metadata: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    table = [batch for batch in batches if batch.num_rows]
    if table:
        rows = [list(r.values()) for batch in table for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([workbook(table[0].schema.names, rows, court, [*metadata, ("Anzahl", str(len(rows)))])], pa.binary()), pa.array([len(rows)], pa.int64())], ["workbook", "n"])


def excel(df: DataFrame, metadata: dict[str, str] | None = None, order: str = "id") -> DataFrame:
    """(workbook, n): one row with the spreadsheet's bytes and its rows: the CSV export's columns and the quality, of at most MOST_EXPORTED rows by ``order``; no row where there is nothing."""
    quality = F.col("quality_score").cast("string") if "quality_score" in df.columns else F.lit(None).cast("string")
    top = df.orderBy(order).limit(MOST_EXPORTED)
    names = list(CSV_NAMES.values())
    rows = csv_row(top.withColumn("quality_score", quality), F.col("quality_score").alias("Qualität")).select(*(F.col(c).cast("string").alias(c) for c in (*names, "Qualität")))
    pairs = list((metadata or {}).items())
    return rows.coalesce(1).mapInArrow(lambda it: _books(it, names.index(CSV_NAMES["court"]), pairs), "workbook binary, n bigint")
