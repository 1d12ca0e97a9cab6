"""References to laws as rows, by a table function for SQL.

    SELECT d.id, r.* FROM decisions d, LATERAL extract_references(d.full_text) r
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.legal import ARTICLE_PATTERNS, FLAGS, SECTION

#: (law, pattern, whether it names a letter)
LAWS = [*(("DSGVO", p, True) for p in ARTICLE_PATTERNS), ("BDSG", SECTION, False)]
REFERENCE = "law string, article string, paragraph string, letter string, start int"


def _quoted(pattern: str) -> str:
    return "'" + (FLAGS + pattern).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _one_pattern(law: str, pattern: str, letter: bool) -> str:
    """SQL for the references of one pattern in the text x: the text is cut at the matches once, which tells where they begin."""
    p = _quoted(pattern)
    group = lambda k: f"nullif(regexp_extract(m, {p}, {k}), '')"
    start = f"aggregate(slice(f.gaps, 1, i + 1), 0, (a, g) -> a + char_length(g)) + aggregate(slice(f.found, 1, i), 0, (a, g) -> a + char_length(g))"
    struct = f"named_struct('law', '{law}', 'article', {group(1)}, 'paragraph', {group(2)}, 'letter', {group(3) if letter else 'cast(null AS string)'}, 'start', {start})"
    return f"get(transform(array(named_struct('found', regexp_extract_all(x, {p}, 0), 'gaps', split(x, {p}))), f -> transform(f.found, (m, i) -> {struct})), 0)"


def references_sql(text: str) -> str:
    """SQL for array<struct<law, article, paragraph, letter, start>>: the references in a text, by place, each once; start counts characters from 0."""
    lists = ", ".join(_one_pattern(*law) for law in LAWS)
    by_place = "(l, r) -> CASE WHEN l.start < r.start THEN -1 WHEN l.start > r.start THEN 1 ELSE 0 END"
    return f"get(transform(array(coalesce({text}, '')), x -> array_sort(array_distinct(flatten(array({lists}))), {by_place})), 0)"


def references(column: str) -> Column:
    """As references_sql, of a column."""
    return F.expr(references_sql(f"`{column}`"))


def register(spark: SparkSession) -> None:
    """Make the table function extract_references(text) known to SQL: (law, article, paragraph, letter, start), a row for each reference. It is native, no Python runs."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION extract_references(text STRING) RETURNS TABLE ({REFERENCE.replace('string', 'STRING').replace('int', 'INT')}) RETURN SELECT r.* FROM (SELECT explode({references_sql('extract_references.text')}) AS r)")
