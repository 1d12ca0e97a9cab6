"""Full-text search on a stored index: lexemes, postings, matching, ranks and snippets.

A query is a list of alternatives, each with the words that it wants and those that it forbids. The index
is a table of postings bucketed and sorted by lexeme, so a query reads the buckets of its words only; no
text is read but those of the page that is shown.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.scalars import let

#: Weights of a field's class, as in common full-text engines.
CLASS_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
DEFAULT_QUERY = "datenschutz"
#: Bytes of input files for each task that writes postings.
PART_BYTES = 8_000_000
#: Rows whose postings of one bucket one task sorts, however well their files are packed.
PART_ROWS = 500_000
_BETWEEN = r"[^\p{L}\p{N}]+"


def lexemes(text: Column) -> Column:
    """Lower-cased words in order, without stop words or stemming."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN), lambda x: x != "")


@dataclass(frozen=True)
class Alternative:
    """All wanted words and none of the forbidden ones."""

    wanted: tuple[str, ...]
    forbidden: tuple[str, ...] = ()


def alternatives(query: str) -> list[Alternative]:
    """The alternatives of a query with the signs & | ! or the words AND OR NOT.

    Other signs are blanks, and words side by side are all meant. A word with inner signs is all its
    lexemes. A query without words means DEFAULT_QUERY.
    """
    for name, sign in (("AND", "&"), ("OR", "|"), ("NOT", "!")):
        query = re.sub(rf"(^|\s){name}(?=\s)", rf"\1{sign}", query)
    found = []
    for part in re.sub(r"[^\w\s&|!-]", " ", query).split("|"):
        words = [(bool(no), w) for no, word in re.findall(r"(!?)\s*([^\s&|!]+)", part) for w in re.split(r"[\W_]+", word.lower()) if w]
        if words:
            found.append(Alternative(*(tuple(dict.fromkeys(w for no, w in words if no == forbidden)) for forbidden in (False, True))))
    return found or [Alternative((DEFAULT_QUERY,))]


def wanted_words(query: list[Alternative]) -> list[str]:
    return list(dict.fromkeys(w for a in query for w in a.wanted))


def _all_words(query: list[Alternative]) -> list[str]:
    return list(dict.fromkeys(w for a in query for w in (*a.wanted, *a.forbidden)))


def matches(query: str | list[Alternative], words: Column) -> Column:
    """Whether an array of lexemes fits the query."""
    fits = F.lit(False)
    for a in alternatives(query) if isinstance(query, str) else query:
        one = F.lit(True)
        for word in a.wanted:
            one = one & F.array_contains(words, word)
        for word in a.forbidden:
            one = one & ~F.array_contains(words, word)
        fits = fits | one
    return fits


#: Rows whose words a task puts together at a time.
GATHERED_ROWS = 500


def _put_together(key: pa.Array, fields: list[pa.Array], kinds: np.ndarray) -> list[pa.Array]:
    """Of rows' keys and fields array<array<string>>, the words of each text, the columns lexeme, key, weight, positions and first."""
    words, row, at, kind = [], [], [], []
    for number, texts in enumerate(fields):
        inner = texts.flatten()
        sizes = pc.list_value_length(inner).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = pc.list_parent_indices(texts).to_numpy(zero_copy_only=False)
        words.append(inner.flatten())
        row.append(np.repeat(rows, sizes))
        at.append(np.arange(1, sizes.sum() + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        kind.append(np.full(len(row[-1]), np.searchsorted(np.unique(kinds), kinds[number])))
    coded = pc.dictionary_encode(pa.concat_arrays(words))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row, at, kind = (np.concatenate(x) for x in (row, at, kind))
    word = row * max(1, len(coded.dictionary)) + code  # a number for each row and word
    order = np.lexsort((at, kind, word))
    word, kind = word[order], kind[order]
    first = np.append(True, word[1:] != word[:-1])[: len(word)]
    starts = np.flatnonzero(first | np.append(True, kind[1:] != kind[:-1])[: len(word)])
    positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(word)), pa.int32()), pa.array(at[order], pa.int32()))
    return [coded.dictionary.take(pa.array(code[order][starts])), key.take(pa.array(row[order][starts])), pa.array(np.unique(kinds)[kind[starts]].tolist(), pa.string()), positions, pa.array(first[starts])]


def postings(df: DataFrame, key: str, fields: dict[str, str], stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """The inverted index (lexeme, key, weight class, positions from 1, first) of the fields with their classes; array fields are joined by blanks.

    A row's words are put together where the row stands, some hundred rows at a time in Arrow tasks, so that
    nothing is shuffled; only where a key has several rows, these are gathered. ``first`` holds for one row of
    each lexeme and key.
    """
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}

    def arm(column: str) -> Column:
        words = lexemes(F.array_join(column, " ") if column in arrays else F.col(column))
        return F.transform(words, stem) if stem else words

    names = [f"f{i}" for i in range(len(fields))]
    kinds = np.array(list(fields.values()))
    repeated = not df.groupBy(key).count().filter("count > 1").isEmpty()
    rows = df.select(F.col(key).alias("key"), *((arm(c) if repeated else F.array(arm(c))).alias(f) for c, f in zip(fields, names, strict=True)))
    if repeated:
        rows = rows.groupBy("key").agg(*(F.collect_list(f).alias(f) for f in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, GATHERED_ROWS):
                part = batch.slice(a, GATHERED_ROWS)
                yield pa.RecordBatch.from_arrays(_put_together(part.column("key"), [part.column(f) for f in names], kinds), ["lexeme", "key", "weight", "positions", "first"])

    return rows.mapInArrow(run, f"lexeme string, key {df.schema[key].dataType.simpleString()}, weight string, positions array<int>, first boolean").withColumnRenamed("key", key)


def _bytes(df: DataFrame) -> int:
    """The size of the files that df comes from."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    paths = (jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles())
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


class PostingsIndex:
    """A stored index of the ``fields`` (with their classes) of rows named by ``key``.

    Its tables are postings (lexeme, key, weight, positions, first, batch), bucketed and sorted by lexeme,
    counts (lexeme, docs, n, batch) and documents (key, batch), in the warehouse or below ``path``. With
    ``stem``, words of texts and queries are compared by their stems. A bucket is written by as many tasks
    as the input's size and rows ask for, dealt by key, so that a word of all rows is no single task's.
    """

    def __init__(self, spark: SparkSession, name: str, key: str, fields: dict[str, str], stem: Callable[[Column], Column] | None = None, buckets: int | None = None, path: str | None = None):
        self.spark, self.name, self.key, self.fields, self.stem, self.path = spark, name, key, fields, stem, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _append(self, rows: DataFrame, part: str, by: str) -> None:
        writer = rows.write.format("parquet").bucketBy(self.buckets, by).sortBy(by).mode("append")
        (writer.option("path", f"{self.path}/{part}") if self.path else writer).saveAsTable(f"{self.name}_{part}")
        self.spark.catalog.refreshTable(f"{self.name}_{part}")

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def append(self, df: DataFrame, batch: str | None = None) -> None:
        """Add the rows of df, whose keys the index must not have yet. A batch that the index holds whole is passed over."""
        batch = batch or uuid.uuid4().hex
        known = self.spark.catalog.tableExists(f"{self.name}_documents")
        if known and not self.table("documents").filter(F.col("batch") == batch).isEmpty():
            return
        parts = max(1, -(-_bytes(df) // (PART_BYTES * self.buckets)), -(-df.count() // PART_ROWS))
        at = F.pmod(F.hash("lexeme"), F.lit(self.buckets)) * parts + F.pmod(F.hash(self.key), F.lit(parts))
        rows = postings(df, self.key, self.fields, self.stem).repartitionById(self.buckets * parts, at.cast("int"))
        rows = rows.sortWithinPartitions("lexeme")  # the writer's own sort, which begins with the bucket, can't go by the words' first bytes
        self._append(rows.withColumn("batch", F.lit(batch)), "postings", "lexeme")
        added = self.table("postings").filter(F.col("batch") == batch).select(F.concat("lexeme", F.lit("")).alias("lexeme"), "first", F.size("positions").alias("n"))  # not by buckets, which have many files
        counts = added.groupBy("lexeme").agg(F.count_if("first").alias("docs"), F.sum("n").cast("long").alias("n"), F.lit(batch).alias("batch"))
        self._append(counts, "counts", "lexeme")
        self._append(df.select(self.key, F.lit(batch).alias("batch")).repartition(self.buckets, self.key), "documents", self.key)  # last: it marks the batch as whole

    def frequencies(self, *words: str) -> DataFrame:
        """(lexeme, docs, n): how many documents have each word, and how often it stands in them, of all words where none is named."""
        counts = self.table("counts")
        return (counts.filter(F.col("lexeme").isin(*words)) if words else counts).groupBy("lexeme").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))

    def _stemmed(self, query: list[Alternative]) -> list[Alternative]:
        if not self.stem:
            return query
        words = _all_words(query)
        rows = self.spark.createDataFrame([(w,) for w in words], "w string").select("w", self.stem(F.col("w"))).collect()
        stems = dict(map(tuple, rows))
        return [Alternative(*(tuple(dict.fromkeys(stems[w] for w in ws)) for ws in (a.wanted, a.forbidden))) for a in query]

    def find(self, query: str | list[Alternative], dense: bool = False) -> DataFrame:
        """(key, relevance) of all documents that match.

        A document is judged by its postings of the query's words alone, gathered by key. An alternative
        that only forbids words is looked up among all documents.
        """
        query = self._stemmed(alternatives(query) if isinstance(query, str) else query)
        wanted, words = wanted_words(query), _all_words(query)
        weight = F.lit(0.0)
        for kind, value in CLASS_WEIGHTS.items():
            weight = F.when(F.col("weight") == kind, value).otherwise(weight)
        counted = F.when(F.col("lexeme").isin(*wanted), weight * (1 - F.pow(F.lit(2.0), -F.size("positions")))).otherwise(0.0) if wanted else F.lit(0.0)
        rows = self.table("postings").filter(F.col("lexeme").isin(*words))
        places = F.sort_array(F.flatten(F.collect_list(F.when(F.col("lexeme").isin(*wanted), F.transform("positions", lambda p: F.struct(p.alias("at"), F.col("lexeme").alias("word"))))))) if dense and wanted else F.lit(None)
        hits = rows.groupBy(self.key).agg(F.collect_set("lexeme").alias("have"), F.sum(counted).alias("score"), places.alias("places"))
        if any(not a.wanted for a in query):
            hits = self.table("documents").select(self.key).join(hits, self.key, "left").withColumns({"have": F.coalesce("have", F.array().cast("array<string>")), "score": F.coalesce("score", F.lit(0.0))})
        hits = hits.filter(matches(query, F.col("have")))
        score = cover_density(F.col("places"), wanted) if dense and wanted else F.col("score") / max(1, len(wanted))
        return hits.select(self.key, F.least(score, F.lit(1.0)).alias("relevance"))

    def page(self, query: str | list[Alternative], limit: int = 20, offset: int = 0, dense: bool = False, among: DataFrame | None = None) -> DataFrame:
        """(key, relevance) of a page of matches, best first, ties by key; ``among`` (key) leaves others out."""
        found = self.find(query, dense)
        if among is not None:
            found = found.join(among.select(self.key), self.key, "left_semi")
        return found.orderBy(F.desc("relevance"), self.key).offset(offset).limit(limit)


def rank(words: Column, wanted: list[str], weight: float) -> Column:
    """Weighted term frequency that saturates for each word: w * (1 - 2 ** -n), over the words' mean."""
    def times(word: str) -> Column:
        return F.size(F.filter(words, lambda x: x == F.lit(word)))

    total = F.lit(0.0)
    for word in wanted:
        n = times(word)
        total = total + F.when(n > 0, weight * (1 - F.pow(F.lit(2.0), -n))).otherwise(0.0)
    return total / max(1, len(wanted))


def cover_density(places: Column, wanted: list[str]) -> Column:
    """Cover density (Clarke, Cormack and Tudhope, 2000), r / (r + 1), of sorted places array<struct<at, word>>.

    Each shortest stretch with all wanted words adds one over its length: one fold over the places, which
    keeps where each word stood last.
    """
    numbers = F.create_map(*(x for i, w in enumerate(wanted) for x in (F.lit(w), F.lit(i))))
    start = F.struct(F.array(*[F.lit(0)] * len(wanted)).alias("last"), F.lit(0).alias("begin"), F.lit(0.0).alias("total"))

    def add(state: Column, place: Column) -> Column:
        last = F.transform(state["last"], lambda x, i: F.when(i == numbers[place["word"]], place["at"]).otherwise(x))

        def cover(last: Column) -> Column:
            low = F.array_min(last)
            new = low > state["begin"]  # 0 until all words were seen
            return F.struct(last.alias("last"), F.when(new, low).otherwise(state["begin"]).alias("begin"), F.when(new, state["total"] + F.lit(1.0) / (place["at"] - low + 1)).otherwise(state["total"]).alias("total"))

        return let(last, cover)

    total = F.aggregate(places, start, add, lambda s: s["total"])
    return total / (total + 1)


def headline(text: Column, wanted: list[str], least: int = 25, most: int = 50, short: int = 3, stem: Callable[[Column], Column] | None = None) -> Column:
    """A stretch of the text around the first wanted word, with wanted words marked.

    It has up to ``most`` words; short ones at its end go while more than ``least`` are left. A null text gives null.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    plain = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")
    same = [stem(F.lit(w)) if stem else F.lit(w) for w in wanted]
    meant = lambda w: F.array_contains(F.array(*same).cast("array<string>"), stem(plain(w)) if stem else plain(w))

    def cut(words: Column) -> Column:
        at = F.coalesce(F.array_min(F.filter(F.transform(words, lambda w, i: F.when(meant(w), i)), lambda i: i.isNotNull())), F.lit(0))
        start = F.greatest(F.lit(0), F.least(at - (most - least) // 2, F.size(words) - most))
        return F.slice(words, start + 1, most)

    def ended(shown: Column) -> Column:
        long = F.filter(F.transform(shown, lambda w, i: F.when(F.length(plain(w)) > short, i + 1)), lambda i: i.isNotNull())
        return F.slice(shown, 1, F.greatest(F.coalesce(F.array_max(long), F.lit(0)), F.least(F.size(shown), F.lit(least))))

    marked = F.transform(let(let(words, cut), ended), lambda w: F.when(meant(w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w))
    return F.array_join(marked, " ")


# The fields of a search result.
RESULT = ("id", "title", "court", "decision_date", "snippet", "relevance", "gdpr_articles", "source", "source_url")


def results(page: DataFrame, df: DataFrame, key: str, text: str, query: str, stem: Callable[[Column], Column] | None = None) -> DataFrame:
    """A page (key, relevance) with the nine fields of RESULT from df; the snippet of a row without text is its title's first 200 characters and three dots.

    The page is small, so df is read once and its texts only for the rows of the page.
    """
    wanted = wanted_words(alternatives(query))
    kinds = {"gdpr_articles": "array<string>", "decision_date": "timestamp_ntz"}
    have = {c: F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, "string")) for c in RESULT if c not in ("snippet", "relevance")}
    rows = df.join(F.broadcast(page), key)
    snippet = F.nullif(headline(F.col(text), wanted, stem=stem), F.lit(""))
    title = F.concat(F.substring(F.coalesce(have["title"], F.lit("")), 1, 200), F.lit("..."))
    values = {**have, "id": F.col(key), "snippet": F.coalesce(snippet, title), "relevance": F.col("relevance"), "gdpr_articles": F.coalesce(have["gdpr_articles"], F.array().cast("array<string>"))}
    return rows.select(*(values[name].alias(name) for name in RESULT)).orderBy(F.desc("relevance"), "id")


def probe(index: PostingsIndex, query: str) -> DataFrame:
    """One row: how many rows match, and their mean relevance."""
    return index.find(query).agg(F.count("*").alias("matches"), F.round(F.avg("relevance"), 6).alias("mean_relevance"))


def search(index: PostingsIndex, df: DataFrame, text: str, query: str, limit: int = 20, offset: int = 0, dense: bool = False) -> DataFrame:
    """(key, relevance, snippet) of a page of matches, best first, ties by key."""
    page = index.page(query, limit, offset, dense)
    top = df.join(F.broadcast(page), index.key).orderBy(F.desc("relevance"), index.key)
    return top.select(index.key, "relevance", headline(F.col(text), wanted_words(alternatives(query)), stem=index.stem).alias("snippet"))
