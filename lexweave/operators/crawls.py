"""Crawl logs and access tokens."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUCCESS = ("completed", "success")


def crawl_status(logs: DataFrame, sources: list[str], as_of: datetime, hour: int = 2) -> DataFrame:
    """Each source's newest log: status, last and next run, counts; never_run without one."""
    newest = logs.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("started_at"), "id"))).filter("rank = 1")
    every = logs.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    last = F.coalesce("finished_at", "started_at")
    at = F.date_trunc("day", last).cast("timestamp_ntz") + F.expr(f"INTERVAL '{hour}' HOUR")
    due = F.when(at <= F.lit(as_of).cast("timestamp_ntz"), at + F.expr("INTERVAL '1' DAY")).otherwise(at)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total_fetched", "total_processed", "total_errors")]
    return F.broadcast(every).join(newest, "source", "left").select("source", F.coalesce("status", F.lit("never_run")).alias("status"), last.alias("last_run"), due.alias("next_run"), *counts)


def success_rate(logs: DataFrame, success: tuple[str, ...] = SUCCESS) -> DataFrame:
    total, good = F.count("*"), F.count_if(F.col("status").isin(*success))
    return logs.agg(total.alias("total"), good.alias("successful"), F.coalesce(F.round(100.0 * good / F.nullif(total, F.lit(0)), 2), F.lit(0.0)).alias("success_rate"))


def progress(logs: DataFrame) -> DataFrame:
    """Seconds, fetched per second and share of successes of each crawl."""
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at"))
    return logs.select(
        "id", seconds.alias("seconds"), F.round(F.col("total_fetched") / F.greatest(seconds, F.lit(1)), 2).alias("rate"),
        F.round(100.0 * (F.col("total_processed") - F.col("total_errors")) / F.greatest("total_processed", F.lit(1)), 2).alias("success"),
    )


def valid_tokens(tokens: DataFrame, users: DataFrame, as_of: datetime) -> DataFrame:
    """Tokens that are unused and not expired, of active users."""
    live = tokens.filter(F.col("used_at").isNull() & (F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz")))
    return live.join(users.filter("is_active").select("user_id", "username"), "user_id")


def token_statistics(tokens: DataFrame, as_of: datetime) -> DataFrame:
    expired = F.col("expires_at") <= F.lit(as_of).cast("timestamp_ntz")
    return tokens.agg(
        F.count("*").alias("total"), F.count_if(F.col("used_at").isNotNull()).alias("used"),
        F.count_if(F.col("used_at").isNull() & expired).alias("expired"), F.count_if(F.col("used_at").isNull() & ~expired).alias("active"),
    )
