"""The canonical schemas and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The canonical decision, as DDL.
DECISION = (
    "id string, source string, source_id string, source_url string, document_type string, title string, case_number string, court string, "
    "decision_date timestamp_ntz, publication_date timestamp_ntz, gdpr_articles array<string>, bdsg_sections array<string>, keywords array<string>, "
    "full_text_original string, full_text_anonymized string, leitsatz string, tenor string, tatbestand string, entscheidungsgruende string, "
    "anonymization_applied boolean, pdf_extracted boolean, processing_errors string, metadata map<string,string>, language string, quality_score int, "
    "user_feedback string, feedback_count int, avg_quality_score double, rechtskraft_status string, rechtskraft_datum date, "
    "nachfolge_entscheidung_id string, created_at timestamp_ntz, updated_at timestamp_ntz, last_crawled_at timestamp_ntz"
)

#: The nested event record, as DDL.
EVENT = (
    "id string, timestamp timestamp, event_type string, priority string, category string, message string, component string, operation string, "
    "context map<string,string>, metadata map<string,string>, performance struct<duration_ms:double,memory_mb:double,cpu_percent:double>, "
    "business_impact struct<user_impact:string,revenue_impact:string,feature_affected:string>, error struct<type:string,message:string,stack_trace:string>, "
    "request struct<id:string,user_id:string,endpoint:string,method:string,status_code:int>, technical struct<environment:string,version:string,host:string>, "
    "triage struct<tags:array<string>,requires_analysis:boolean,priority_score:int>"
)

DOCUMENT_TYPES = ("court_decision", "authority_decision", "guideline", "opinion")
QUALITY_RANGE = (1, 5)


def conform(df: DataFrame, schema: str | StructType = DECISION) -> DataFrame:
    """df with exactly the schema's columns: missing ones null, present ones cast (null where that fails)."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = set(df.columns)
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def duplicated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number: empty where the keys are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def violations(df: DataFrame) -> DataFrame:
    """Rows of decisions that break a constraint, with the names of the constraints they break."""
    rules = {
        "title": F.col("title").isNull(),
        "source": F.col("source").isNull() | F.col("source_id").isNull(),
        "quality_score": ~F.col("quality_score").between(*QUALITY_RANGE),
    }
    broken = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items() if name == "source" or name in df.columns)))
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def all_of(conditions: list) -> object:
    """The conjunction of the conditions; true for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
