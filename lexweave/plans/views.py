"""The domain's tables as views over the star-schema test tables, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COURTS = ["BGH", "BVerwG", "BAG", "OLG Hamm", "LG Berlin", "AG Mainz", "VG Wiesbaden", "OVG Greifswald", "LAG Hessen", "ArbG Trier", "SG Ulm", "LSG Bayern", "FG Kassel", "BFH", "BSG", "Verwaltungsgericht Stade"]
SOURCES = {"BUILDING": "openlegaldata", "AUTOMOBILE": "gdprhub", "MACHINERY": "ris", "HOUSEHOLD": "manual", "FURNITURE": "swiss"}


class Views:
    """The views of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def decisions(self) -> DataFrame:
        items = (
            self.table("lineitem")
            .join(self.table("part"), F.expr("l_partkey = p_partkey"))
            .groupBy("l_orderkey")
            .agg(
                F.sort_array(F.collect_set(F.expr("concat('Art. ', l_partkey % 99 + 1, ' DSGVO')"))).alias("gdpr_articles"),
                F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.split("p_name", " "))))).alias("keywords"),
            )
        )
        courts = F.array(*map(F.lit, COURTS))
        sources = F.create_map(*(F.lit(x) for pair in SOURCES.items() for x in pair))
        base = self.table("orders").join(self.table("customer"), F.expr("o_custkey = c_custkey"))
        base = base.join(items, F.expr("o_orderkey = l_orderkey"), "left")
        court = F.when(F.expr("c_nationkey % 7 = 0"), None).otherwise(F.get(courts, F.expr("c_nationkey % 16")))
        return base.select(
            F.col("o_orderkey").cast("string").alias("id"),
            sources[F.col("c_mktsegment")].alias("source"),
            F.expr("concat('s', o_orderkey)").alias("source_id"),
            court.alias("court"),
            F.expr("concat('Entscheidung ', o_custkey % 50, ' ', o_orderpriority)").alias("title"),
            F.expr("concat(o_orderkey % 100, ' O ', o_custkey, '/', lpad(year(o_orderdate) % 100, 2, '0'))").alias("case_number"),
            F.expr("if(o_orderkey % 13 = 0, null, o_orderdate)").alias("decision_date"),
            F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 30 as int))").alias("created_at"),
            F.expr("if(o_orderkey % 11 = 0, null, gdpr_articles)").alias("gdpr_articles"),
            F.col("keywords"),
            F.expr("o_orderstatus = 'F'").alias("anonymization_applied"),
            F.expr("o_orderkey % 3 = 0").alias("pdf_extracted"),
            F.expr("cast(substring(o_orderpriority, 1, 1) as int)").alias("quality_score"),
            F.expr("if(o_orderkey % 4 = 0, null, concat('Leitsatz ', o_custkey % 50))").alias("leitsatz"),
            F.expr("if(o_orderkey % 5 = 0, null, concat('Tenor ', o_orderkey % 20))").alias("tenor"),
        )

    @cached_property
    def events(self) -> DataFrame:
        """Event log rows: component, operation, duration and so on."""
        k = F.get_json_object("props", "$.k").cast("int")
        return self.table("events").select(
            "event_id",
            F.col("ts").alias("timestamp"),
            F.col("event_type").alias("component"),
            F.concat(F.lit("op"), (k % 7).cast("string")).alias("operation"),
            F.round(F.col("value") * 40, 2).alias("duration_ms"),
            F.round(F.col("value") * 10, 2).alias("memory_mb"),
            F.when(F.col("event_id") % 9 == 0, None).otherwise((k % 100).cast("double")).alias("cpu_percent"),
            F.get(F.array(*map(F.lit, ("info", "low", "medium", "high", "critical"))), (F.col("event_id") % 5).cast("int")).alias("priority"),
            F.when(F.col("event_type") == "error", "error").otherwise("usage").alias("category"),
            F.when(F.col("event_type") == "error", F.when(k % 4 == 0, None).otherwise(F.concat(F.lit("E"), (k % 4).cast("string")))).alias("error_type"),
            F.when(k % 6 == 0, None).otherwise(F.concat(F.lit("feature"), (k % 6).cast("string"))).alias("feature"),
            F.when(k % 10 == 0, "high").when(k % 10 < 4, "medium").otherwise("low").alias("user_impact"),
            "user_id",
            (F.col("event_id") % 4 == 0).alias("requires_analysis"),
            (k + 1).alias("priority_score"),
        )

    @cached_property
    def legal_docs(self) -> DataFrame:
        """Whole document texts behind a legal sentence that depends on doc_id."""
        lead = (
            "concat('Gemäß Art. ', doc_id % 99 + 1, ' Abs. ', doc_id % 5 + 1, ' lit. b DSGVO und § ', doc_id % 40 + 1, ' BDSG wird die Einwilligung geprüft. ', "
            "if(doc_id % 3 = 0, concat('Art. ', doc_id % 20 + 1, '-', doc_id % 20 + 4, ' DSGVO. §§ ', doc_id % 10 + 1, ' bis ', doc_id % 10 + 3, ' BDSG. Bußgeld EUR 20.000. '), ''), "
            "if(doc_id % 4 = 0, 'Die Verarbeitung personenbezogener Daten. Article 17(1) GDPR. ', ''), coalesce(text, ''))"
        )
        return self.table("documents").select("doc_id", "source", "lang", F.expr(lead).alias("text"))

    @cached_property
    def crawl_logs(self) -> DataFrame:
        """A crawl for each order of 1999 or later."""
        return self.table("orders").filter("o_orderdate >= TIMESTAMP_NTZ '1999-01-01 00:00:00'").selectExpr(
            "o_orderkey AS id", "concat('source', o_custkey % 6) AS source", "o_orderdate AS started_at",
            "if(o_orderkey % 5 = 0, null, o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 90 as int))) AS finished_at",
            "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'running' END AS status",
            "cast(o_orderkey % 500 as int) AS total_fetched", "cast(o_orderkey % 400 as int) AS total_processed", "cast(o_orderkey % 40 as int) AS total_errors",
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")


_COURT_LIST = ", ".join(f"'{c}'" for c in COURTS)
_SOURCE_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCES.items())

#: The same views for DuckDB, to be put in front of a query.
VIEWS_SQL = f"""
WITH items AS (
  SELECT l_orderkey, list_sort(list_distinct(list('Art. ' || (l_partkey % 99 + 1) || ' DSGVO'))) AS gdpr_articles,
         list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))) AS keywords
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
),
decisions AS (
  SELECT o_orderkey::VARCHAR AS id, CASE c_mktsegment {_SOURCE_CASE} END AS source, 's' || o_orderkey AS source_id,
    CASE WHEN c_nationkey % 7 <> 0 THEN [{_COURT_LIST}][c_nationkey % 16 + 1] END AS court,
    'Entscheidung ' || (o_custkey % 50) || ' ' || o_orderpriority AS title,
    (o_orderkey % 100) || ' O ' || o_custkey || '/' || strftime(o_orderdate, '%y') AS case_number,
    CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS decision_date,
    o_orderdate + to_days((o_orderkey % 30)::INTEGER) AS created_at,
    CASE WHEN o_orderkey % 11 <> 0 THEN gdpr_articles END AS gdpr_articles, keywords,
    o_orderstatus = 'F' AS anonymization_applied, o_orderkey % 3 = 0 AS pdf_extracted, left(o_orderpriority, 1)::INTEGER AS quality_score,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'Leitsatz ' || (o_custkey % 50) END AS leitsatz,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'Tenor ' || (o_orderkey % 20) END AS tenor
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN items ON o_orderkey = l_orderkey
),
raw_events AS (SELECT *, (props->>'$.k')::INTEGER AS k FROM events),
event_log AS (
  SELECT event_id, ts AS timestamp, event_type AS component, 'op' || (k % 7) AS operation, round(value * 40, 2) AS duration_ms, round(value * 10, 2) AS memory_mb,
    CASE WHEN event_id % 9 <> 0 THEN (k % 100)::DOUBLE END AS cpu_percent, ['info', 'low', 'medium', 'high', 'critical'][event_id % 5 + 1] AS priority,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'usage' END AS category,
    CASE WHEN event_type = 'error' AND k % 4 <> 0 THEN 'E' || (k % 4) END AS error_type, CASE WHEN k % 6 <> 0 THEN 'feature' || (k % 6) END AS feature,
    CASE WHEN k % 10 = 0 THEN 'high' WHEN k % 10 < 4 THEN 'medium' ELSE 'low' END AS user_impact, user_id, event_id % 4 = 0 AS requires_analysis, k + 1 AS priority_score
  FROM raw_events
),
legal_docs AS (
  SELECT doc_id, source, lang, 'Gemäß Art. ' || (doc_id % 99 + 1) || ' Abs. ' || (doc_id % 5 + 1) || ' lit. b DSGVO und § ' || (doc_id % 40 + 1) || ' BDSG wird die Einwilligung geprüft. ' ||
    CASE WHEN doc_id % 3 = 0 THEN 'Art. ' || (doc_id % 20 + 1) || '-' || (doc_id % 20 + 4) || ' DSGVO. §§ ' || (doc_id % 10 + 1) || ' bis ' || (doc_id % 10 + 3) || ' BDSG. Bußgeld EUR 20.000. ' ELSE '' END ||
    CASE WHEN doc_id % 4 = 0 THEN 'Die Verarbeitung personenbezogener Daten. Article 17(1) GDPR. ' ELSE '' END || coalesce(text, '') AS text
  FROM documents
),
crawl_logs AS (
  SELECT o_orderkey AS id, 'source' || (o_custkey % 6) AS source, o_orderdate AS started_at, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + to_minutes(o_orderkey % 90) END AS finished_at,
    CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'running' END AS status, (o_orderkey % 500)::INT AS total_fetched, (o_orderkey % 400)::INT AS total_processed, (o_orderkey % 40)::INT AS total_errors
  FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'
)
"""
