"""Texts of binary files, by an extractor that may fail for some of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file and pages of it that are read at most.
MOST_BYTES, MOST_PAGES = 10 * 1024 * 1024, 100

Extractor = Callable[[bytes], list[str]]


def plain_pages(content: bytes) -> list[str]:
    """The pages of a UTF-8 text, which form feeds part."""
    return content.decode("utf-8").split("\f")


def marked_pages(pages: list[str]) -> str | None:
    """Pages that have a text, each behind a line with its number."""
    return "\n\n".join(f"--- Seite {i} ---\n{page}" for i, page in enumerate(pages, 1) if page) or None


def _texts(batches: Iterator[pa.RecordBatch], extractors: list[Extractor], most_pages: int) -> Iterator[pa.RecordBatch]:
    """(path, length, content) -> (path, length, text, pages, method, error); content is null for files that are too large."""
    for batch in batches:
        for path, length, content in zip(*(batch.column(c) for c in ("path", "length", "content")), strict=True):
            row = {"path": path.as_py(), "length": length.as_py(), "text": None, "pages": 0, "method": None, "error": None}
            if not content.is_valid:
                row["error"] = f"too large: {row['length']} bytes"
            errors = []
            for extract in extractors if content.is_valid else []:
                try:
                    pages = extract(content.as_py())
                    row |= {"text": marked_pages(pages[:most_pages]), "pages": len(pages), "method": extract.__name__}
                    if row["text"]:
                        break
                except Exception as e:  # the error is this file's result; the others go on
                    errors.append(f"{extract.__name__}: {type(e).__name__}: {e}")
            if content.is_valid and not row["text"]:
                row["error"] = "; ".join(errors) or "no text"
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), ("length", pa.int64()), ("text", pa.string()), ("pages", pa.int32()), ("method", pa.string()), ("error", pa.string())]))


def read_texts(spark: SparkSession, path: str, *extractors: Extractor, pattern: str = "*", most_bytes: int = MOST_BYTES, most_pages: int = MOST_PAGES) -> DataFrame:
    """(path, length, text, pages, method, error), a row for each file below path that has bytes at all.

    Extractors, by default that of plain texts, are tried in turn until one finds a text; they take the
    bytes and return pages, of which the first ``most_pages`` are kept. Whatever such a file does, it has
    its row: text is null and error says why where none succeeded or the file is larger than ``most_bytes``,
    which then isn't read at all.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    small, large = files.filter(F.col("length") <= most_bytes), files.filter(F.col("length") > most_bytes)
    rows = small.select("path", "length", "content").unionByName(large.select("path", "length", F.lit(None).cast("binary").alias("content")))
    kinds = "path string, length bigint, text string, pages int, method string, error string"
    return rows.mapInArrow(lambda it: _texts(it, list(extractors) or [plain_pages], most_pages), kinds)
