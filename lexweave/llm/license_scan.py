"""License notices in texts, by diagonal voting, with built-in functions only.

All rolling word k-grams of a text are hashed and joined with the k-grams of the notices; a match
votes for the diagonal, the text's position less the notice's. All k-grams of a phrase voting for one
diagonal is a place where the phrase stands. For a longer notice, neighbouring diagonals are merged,
so that words put in or left out don't break it, and the span is verified: enough of the notice's
k-grams stand in it, and it isn't much longer than the notice. The notices are a fixed list, so they
go to all tasks and the texts' k-grams are never moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.shared import ROW, lower_ascii, numbered

#: Phrases and their base labels. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices (at most 63 k-grams each) and the labels that the method adds.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
K = 2
#: A notice counts with this share of its k-grams; diagonals up to GAP apart are one; a span may be so many words longer.
COVER, GAP, LONGER = 0.75, 3, 6
#: Words are runs of anything but these.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _templates(spark: SparkSession) -> DataFrame:
    """(hash, gram, template, label, at, grams) for each k-gram of each notice; template -1 marks a text itself."""
    phrases = [(label, text, True) for text, label in PHRASES.items()] + [(label, text, False) for label, text in NOTICES]
    rows = [(-1, "", False, 0, 1, ["", ""])]
    for number, (label, text, base) in enumerate(phrases):
        words = text.split()
        rows += [(number, label, base, at, len(words) - K + 1, words[at : at + K]) for at in range(len(words) - K + 1)]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, at int, grams int, gram array<string>")
    return table.withColumn("hash", F.xxhash64(F.col("gram")[0], F.col("gram")[1]))


def scan(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): the words, the base phrases' places, all labels and a score.

    Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. n_base counts the
    places where a phrase's words stand one after another, first_word and last_word are the smallest
    and largest start, from 0 (null without a place). base_labels has the phrases' labels, labels
    also those of notices found with at least COVER of their k-grams: distinct, sorted, joined by
    commas. score is 1 with a base place, else the largest share of a notice's k-grams found, 0 for
    none. Null and empty texts have no words. Every row of docs, repeated ones too, gives one row;
    other columns are ignored. An empty table gives an empty result.
    """
    words = F.array_remove(F.split(lower_ascii(F.col("text").cast("string")), SEPARATORS), "")
    texts = numbered(docs).select(ROW, F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    n = F.size("words")
    # a k-gram carries its own words only, so that a text costs no more than its length
    grams = F.zip_with(F.slice("words", 1, F.greatest(n - 1, F.lit(0))), F.slice("words", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # in front of the k-grams, one that stands for the text, so that texts without a match stay
    first = F.struct(F.lit("").alias("a"), F.lit("").alias("b"))
    # counted before the k-grams are listed, or each would come with the whole text
    listed = texts.select(ROW, "doc_id", n.cast("long").alias("n_words"), F.concat(F.array(first), grams).alias("listed"))
    places = listed.select(ROW, "doc_id", "n_words", F.posexplode("listed").alias("p", "g"))
    places = places.select(ROW, "doc_id", "n_words", "p", "g.a", "g.b", F.xxhash64("g.a", "g.b").alias("hash"))
    templates = _templates(docs.sparkSession)
    place = F.col("p") - 1
    same = (F.col("a") == F.col("gram")[0]) & (F.col("b") == F.col("gram")[1])
    votes = places.join(F.broadcast(templates), "hash").filter(F.when(F.col("template") < 0, F.col("p") == 0).otherwise((F.col("p") > 0) & same))
    votes = votes.select(ROW, "doc_id", "n_words", "template", "label", "base", "grams", (place - F.col("at")).alias("diagonal"), "at", place.alias("place")).repartition(ROW)

    # one row for each diagonal: which of the notice's k-grams voted for it, and where
    key = [ROW, "doc_id", "n_words", "template", "label", "base", "grams"]
    lines = votes.groupBy(*key, "diagonal").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("seen"), F.min("place").alias("begin"), F.max("place").alias("end"))
    order = Window.partitionBy(ROW, "template").orderBy("diagonal")
    lines = lines.withColumn("new", F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > GAP), 1).otherwise(0))
    lines = lines.withColumn("run", F.sum("new").over(order))
    whole = lines.groupBy(*key, "run").agg(F.bit_or("seen").alias("seen"), F.max(F.bit_count("seen")).alias("one"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("diagonal").alias("start"))
    # verified: all diagonals of a run within a span about as long as the notice, or else its best diagonal
    cover = F.when(F.col("end") - F.col("begin") + 1 <= F.col("grams") + LONGER, F.bit_count("seen")).otherwise(F.col("one")) / F.col("grams")
    found = whole.withColumn("cover", F.when(F.col("template") < 0, F.lit(0.0)).otherwise(cover))
    base = F.col("base") & (F.col("cover") == 1.0)
    named = (F.col("template") >= 0) & ~F.col("base") & (F.col("cover") >= COVER)
    out = found.groupBy(ROW, "doc_id", "n_words").agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("start").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("start").cast("long"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(base | named, F.col("label")))), ",").alias("labels"),
        F.max(F.when(base, 1.0).when(F.col("template") >= 0, F.when(F.col("base"), 0.0).otherwise(F.col("cover"))).otherwise(0.0)).alias("score"),
    )
    return out.drop(ROW)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    notices = [(label, text, True) for text, label in PHRASES.items()] + [(label, text, False) for label, text in NOTICES]
    values = ", ".join(f"({k}, '{label}', {str(base).lower()}, '{text}')" for k, (label, text, base) in enumerate(notices))
    return rf"""
WITH t AS (SELECT template, label, base, string_split(text, ' ') AS w FROM (VALUES {values}) x(template, label, base, text)),
tg AS (SELECT template, label, base, len(w) - 1 AS grams, k, w[k + 1] AS a, w[k + 2] AS b FROM (SELECT *, unnest(range(len(w) - 1)) AS k FROM t)),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
),
g AS (SELECT r, p, w[p + 1] AS a, w[p + 2] AS b FROM (SELECT r, w, unnest(range(greatest(len(w) - 1, 0))) AS p FROM d)),
l AS (
  SELECT r, template, label, base, grams, p - k AS diagonal, bit_or(1::BIGINT << k::INT) AS seen, min(p) AS b, max(p) AS e
  FROM g JOIN tg USING (a, b) GROUP BY ALL
),
n AS (SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {GAP} THEN 1 ELSE 0 END AS new FROM l),
u AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS run FROM n),
f AS (
  SELECT r, template, label, base, min(diagonal) AS start,
    CASE WHEN max(e) - min(b) + 1 <= grams + {LONGER} THEN bit_count(bit_or(seen)) ELSE max(bit_count(seen)) END::DOUBLE / grams AS cover
  FROM u GROUP BY r, template, label, base, grams, run
),
h AS (
  SELECT r, count(*) FILTER (base AND cover = 1) AS n_base, min(start) FILTER (base AND cover = 1) AS first_word, max(start) FILTER (base AND cover = 1) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (base AND cover = 1)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label) FILTER (CASE WHEN base THEN cover = 1 ELSE cover >= {COVER} END)), ',') AS labels,
    max(CASE WHEN base THEN (cover = 1)::INT ELSE cover END) AS score
  FROM f GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN h USING (r)
"""


ORACLE = _oracle()
