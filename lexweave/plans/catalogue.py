"""All queries of the engine and their SQL."""

from lexweave.plans import filter_queries, queries, report_queries, source_queries  # noqa: F401  (its queries register themselves)

QUERIES, ORACLE_SQL = queries.QUERIES, queries.ORACLE_SQL
