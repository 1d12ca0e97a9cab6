"""Names without a titled form, replaced by numbered placeholders: those of a table of names, or by patterns where there is none."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.anonymise import ROLES, anonymised
from lexweave.stages import written

#: Names of one automaton (some 100 MB in a task); more are looked for in further passes over the same batches.
MOST_NAMES = 200_000
# Placeholders by kind.
PLACEHOLDERS = {"PERSON": "Person", "ORGANIZATION": "Organisation", "LOCATION": "Ort"}

#: Rows and bytes of text that a task holds as Python values at once, whatever the size of the Arrow batches.
SLICE_ROWS, SLICE_BYTES = 200, 4 << 20

_SPANS = "array<struct<begin:int,end:int,kind:string>>"


def _automaton(names: list[tuple[str, str]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for name, kind in names:
        made.add_word(name, (len(name), kind))
    made.make_automaton()
    return made


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts of up to SLICE_ROWS rows, or of one row where it is so long."""
    for batch in batches:
        mean = max(1, batch.column(text).nbytes // max(1, batch.num_rows))
        step = max(1, min(SLICE_ROWS, SLICE_BYTES // mean))
        for begin in range(0, max(1, batch.num_rows), step):
            yield batch.slice(begin, step)


def _found(batches: Iterator[pa.RecordBatch], names: list[tuple[str, str]], text: str) -> Iterator[pa.RecordBatch]:
    """Adds the places where a name stands as whole words to the column of spans."""
    automaton = _automaton(names)
    for batch in _slices(batches, text):
        every = []
        for value, spans in zip(batch.column(text).to_pylist(), batch.column("__spans").to_pylist(), strict=True):
            spans = spans or []
            for last, (size, kind) in automaton.iter(value or ""):
                begin, end = last + 1 - size, last + 1
                if not (begin and value[begin - 1].isalnum()) and not (end < len(value) and value[end].isalnum()):
                    spans.append({"begin": begin, "end": end, "kind": kind})
            every.append(spans)
        at = batch.schema.get_field_index("__spans")
        yield batch.set_column(at, batch.schema.field(at), pa.array(every, batch.schema.field(at).type))


def chosen(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of places (begin, end, kind) that overlap, the one that begins first, of these the longest."""
    kept: list[tuple[int, int, str]] = []
    for begin, end, kind in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if not kept or begin >= kept[-1][1]:
            kept.append((begin, end, kind))
    return kept


def replaced(text: str, spans: list[tuple[int, int, str]]) -> tuple[str, dict[str, str]]:
    """The text with numbered placeholders, and what each stands for: equal texts of a kind have one number, by their first place; replaced from the right, so that places hold."""
    numbers: dict[tuple[str, str], str] = {}
    places = chosen(spans)
    for begin, end, kind in places:
        same = sum(k == kind for k, _ in numbers)
        numbers.setdefault((kind, text[begin:end]), f"[{PLACEHOLDERS.get(kind, kind)} {same + 1}]")
    for begin, end, kind in reversed(places):
        text = text[:begin] + numbers[kind, text[begin:end]] + text[end:]
    return text, {tag: name for (_, name), tag in numbers.items()}


def _texts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    kinds = [("anonymised", pa.string()), ("names", pa.map_(pa.string(), pa.string())), ("error", pa.string())]
    for batch in _slices(batches, text):
        rows = []
        for value, spans in zip(batch.column(text).to_pylist(), batch.column("__spans").to_pylist(), strict=True):
            try:
                new, names = replaced(value or "", [(s["begin"], s["end"], s["kind"]) for s in spans or []])
                rows.append((new, list(names.items()), None))
            except Exception as e:  # one text's error is its result; the others go on
                rows.append(("", [], f"{type(e).__name__}: {e}"))
        columns = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [[]] * 3, kinds, strict=True)]
        keep = [k for k, name in enumerate(batch.schema.names) if name != "__spans"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *columns], [*(batch.schema.names[k] for k in keep), *(n for n, _ in kinds)])


def without_names(docs: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """docs with anonymised (the text), names (placeholder -> what it stands for) and error, by a table of names (name, kind).

    Names are found as whole words, in their own case, the longest of those that begin together. Roles
    in court are never names. A null text gives an empty one; a text that fails has an empty result and its
    error. The table may have any size: it is taken in blocks of MOST_NAMES.
    """
    spark = docs.sparkSession
    known = names.select(F.trim("name").alias("name"), "kind").filter(F.col("name").isNotNull() & (F.col("name") != "") & ~F.col("name").isin(*ROLES)).groupBy("name").agg(F.min("kind").alias("kind"))
    blocks = max(1, -(-known.count() // MOST_NAMES))
    rows = docs.withColumn("__spans", F.lit(None).cast(_SPANS))
    for block in range(blocks):
        part = [(r["name"], r["kind"]) for r in known.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).collect()]
        if part:
            sent = spark.sparkContext.broadcast(part)
            rows = written(rows, "names") if block else rows  # otherwise the automata of all blocks stand in memory together
            rows = rows.mapInArrow(lambda it, sent=sent: _found(it, sent.value, text), rows.schema)
    out = docs.withColumns({"anonymised": F.lit(""), "names": F.lit(None).cast("map<string,string>"), "error": F.lit(None).cast("string")}).schema
    return rows.mapInArrow(lambda it: _texts(it, text), out)


def anonymised_by(docs: DataFrame, text: str, backend: str = "names", names: DataFrame | None = None) -> DataFrame:
    """docs with anonymised, names and error by a backend: "names", where a table of them is given, or "patterns"."""
    if backend not in ("names", "patterns"):
        raise ValueError(f"unknown backend: {backend}")
    if backend == "names" and names is not None:
        return without_names(docs, text, names)
    return docs.withColumn("__a", anonymised(F.col(text))).select(*docs.columns, F.col("__a.text").alias("anonymised"), F.col("__a.hashes").alias("names"), F.lit(None).cast("string").alias("error"))
