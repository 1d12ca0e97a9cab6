"""Analytics over the event log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators.ordered import order_statistics, over_last_rows, over_last_seconds


def performance(events: DataFrame, key: str = "component", value: str = "duration_ms") -> DataFrame:
    """By component: durations' count, mean, upper median, 95th and 99th percentile, least and most.

    A percentile is the element at floor(n * share), from 0, of the sorted values, without interpolation;
    order_statistics finds it without gathering a component's events in one task.
    """
    found = order_statistics(events, [key], value, {"median": 0.5, "p95": 0.95, "p99": 0.99}, mean=F.round(F.avg(value), 4), least=F.min(value), most=F.max(value))
    return found.select(key, "n", "mean", "median", "p95", "p99", "least", "most")


def resource_summary(events: DataFrame) -> DataFrame:
    """One row: count and mean of durations, their true median, and mean and maximum of memory and CPU over values that aren't 0."""
    memory, cpu = F.nullif("memory_mb", F.lit(0.0)), F.nullif("cpu_percent", F.lit(0.0))
    found = order_statistics(
        events, [], "duration_ms", {"low": 0.5 - 1e-9, "high": 0.5 + 1e-9}, lambda n, share: F.floor((n - (1 if share < 0.5 else 0)) / 2),
        mean=F.round(F.avg("duration_ms"), 4), memory_mean=F.round(F.avg(memory), 4), memory_most=F.max(memory), cpu_mean=F.round(F.avg(cpu), 4), cpu_most=F.max(cpu),
    )
    return found.select("n", "mean", F.round((F.col("low") + F.col("high")) / 2, 4).alias("median"), "memory_mean", "memory_most", "cpu_mean", "cpu_most")


def troubled(events: DataFrame) -> DataFrame:
    """Events that count as errors: of category error, or of high or critical priority."""
    return events.filter((F.col("category") == "error") | F.col("priority").isin("high", "critical"))


def error_rate(events: DataFrame, hours: float = 24) -> DataFrame:
    """One row: how many events are troubled, how many an hour, and how many of them are critical."""
    return troubled(events).agg(F.count("*").alias("errors"), F.round(F.count("*") / hours, 4).alias("per_hour"), F.count_if(F.col("priority") == "critical").alias("critical"))


def critical_errors(events: DataFrame) -> DataFrame:
    return events.filter("priority = 'critical'").select("event_id", "timestamp", "component", "error_type", "user_impact")


#: Fixed values: (priority, category, title, condition of an event, more than so many of them).
RECOMMENDATIONS = [
    ("high", "performance", "Optimize Slow Operations", "duration_ms > 2000", 10),
    ("critical", "reliability", "Reduce Error Rate", "priority IN ('high', 'critical')", 20),
    ("medium", "resource_optimization", "Memory Usage Optimization", "memory_mb > 100", 5),
]


def recommendations(events: DataFrame) -> DataFrame:
    """(priority, category, title, n) of the rules that enough events fulfil, from one pass."""
    counts = events.agg(*(F.count_if(F.coalesce(F.expr(rule), F.lit(False))).alias(f"n{k}") for k, (*_, rule, _) in enumerate(RECOMMENDATIONS)))
    rows = [F.struct(F.lit(p).alias("priority"), F.lit(c).alias("category"), F.lit(t).alias("title"), F.col(f"n{k}").alias("n"), F.lit(most).alias("most")) for k, (p, c, t, _, most) in enumerate(RECOMMENDATIONS)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("n > most").drop("most")


def newest(events: DataFrame, limit: int = 100) -> DataFrame:
    return events.orderBy(F.desc("timestamp"), "event_id").limit(limit)


def chosen(events: DataFrame, begin: datetime | None = None, end: datetime | None = None, component: str | None = None, category: str | None = None, priority: str | None = None) -> DataFrame:
    """Events within a closed range of times, and of a component, category and priority, where given."""
    for name, value in (("component", component), ("category", category), ("priority", priority)):
        if value is not None:
            events = events.filter(F.col(name) == value)
    if begin is not None:
        events = events.filter(F.col("timestamp") >= F.lit(begin).cast("timestamp_ntz"))
    return events if end is None else events.filter(F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))


def insights(performance_rows: DataFrame) -> DataFrame:
    """What is slow: (component, insight)."""
    rules = [(F.col("p95") > 2000, "high p95"), (F.col("mean") > 1000, "slow on average"), (F.col("most") > 10000, "very slow single operation")]
    return performance_rows.select("component", F.explode(F.array_compact(F.array(*(F.when(rule, name) for rule, name in rules)))).alias("insight"))


def by_hour(events: DataFrame) -> DataFrame:
    return events.groupBy(F.hour("timestamp").alias("hour")).agg(F.round(F.avg("duration_ms"), 4).alias("mean"), F.count("*").alias("n"))


def errors(events: DataFrame) -> DataFrame:
    """(kind, value, n): errors by type, with Unknown for none, and by component."""
    arms = F.array(F.struct(F.lit("type").alias("kind"), F.coalesce("error_type", F.lit("Unknown")).alias("value")), F.struct(F.lit("component").alias("kind"), F.col("component").alias("value")))
    return events.filter("category = 'error'").select(F.explode(arms).alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("n"))


def feature_usage(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("feature", F.lit("unknown")).alias("feature")).agg(F.count("*").alias("n"), F.count_if(F.col("user_impact") == "high").alias("high_impact"))


def health(events: DataFrame) -> DataFrame:
    """By component: 100 less 1,000 times the error rate, from 0, and what that means."""
    rate = F.count_if(F.col("category") == "error") / F.count("*")
    by = events.groupBy("operation").agg(F.round(F.greatest(F.lit(0.0), 100 - rate * 1000), 4).alias("score"))
    return by.withColumn("status", F.when(F.col("score") > 90, "healthy").when(F.col("score") > 70, "degraded").otherwise("unhealthy"))


def slowest(events: DataFrame, top: int = 10) -> DataFrame:
    return events.orderBy(F.desc("duration_ms"), "event_id").limit(top).select("event_id", "component", "operation", "duration_ms")


def triage(events: DataFrame, least: int = 70, top: int = 20) -> DataFrame:
    """The events to look at first."""
    return events.filter(F.col("requires_analysis") & (F.col("priority_score") >= least)).orderBy(F.desc("priority_score"), "event_id").limit(top).select("event_id", "priority_score")


BASELINE_EVENTS, LEAST_EVENTS = 100, 10


def baselines(events: DataFrame) -> DataFrame:
    """Each event with mean, deviation and size of its last BASELINE_EVENTS, itself included, and whether it is an anomaly.

    An event is one if its duration is above the mean by more than two deviations, with LEAST_EVENTS or more.
    """
    rows = events.select("event_id", "component", "operation", "timestamp", "duration_ms")
    out = over_last_rows(rows, ["component", "operation"], "timestamp", "event_id", last=BASELINE_EVENTS, mean=F.avg("duration_ms"), deviation=F.stddev_samp("duration_ms"), seen=F.count("duration_ms"))
    odd = (F.col("seen") >= LEAST_EVENTS) & (F.col("mean") != 0) & (F.col("duration_ms") > F.col("mean") + 2 * F.col("deviation"))
    return out.drop("timestamp").withColumn("anomaly", F.coalesce(odd, F.lit(False)))


def baseline_percentiles(events: DataFrame) -> DataFrame:
    """Each event with the upper median, the 95th and the 99th percentile of its last BASELINE_EVENTS durations, itself included."""
    rows = events.select("event_id", "component", "operation", "timestamp", "duration_ms")
    sorted_ = over_last_rows(rows, ["component", "operation"], "timestamp", "event_id", last=BASELINE_EVENTS, d=F.collect_list("duration_ms")).select("event_id", F.sort_array("d").alias("d"))

    def at(share: float) -> Column:
        return F.get("d", F.least(F.floor(F.size("d") * F.lit(share)), F.size("d") - 1).cast("int"))

    return sorted_.select("event_id", at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def stepped(value: Column, *steps: tuple[float, int]) -> Column:
    """The penalty of the first limit that the value exceeds, else 0; limits from the largest."""
    out = F.lit(0)
    for limit, penalty in reversed(steps):
        out = F.when(value > limit, penalty).otherwise(out)
    return out


def performance_score(duration: Column, mean: Column, memory: Column, cpu: Column) -> Column:
    """100 less penalties for the ratio to the baseline, for memory in MB and for CPU in per cent, from 0."""
    ratio = stepped(F.when(mean > 0, duration / mean), (3, 40), (2, 25), (1.5, 15))
    return F.greatest(F.lit(0), 100 - ratio - stepped(memory, (1000, 20), (500, 10)) - stepped(cpu, (90, 20), (70, 10)))


def recent_requests(events: DataFrame, key: str = "user_id", seconds: int = 60, most: int = 60) -> DataFrame:
    """Each event with how many its key had in the seconds before, itself included, and whether that is allowed."""
    rows = over_last_seconds(events.select("event_id", key, "timestamp"), [key], "timestamp", seconds, requests=F.count("*"))
    return rows.select("event_id", key, "requests", (F.col("requests") <= most).alias("allowed"))


def issue_list(duration: Column, memory: Column, cpu: Column) -> Column:
    """What is wrong with one measurement."""
    return F.array_compact(F.array(F.when(duration > 5000, "critical duration").when(duration > 1000, "slow"), F.when(memory > 500, "memory"), F.when(cpu > 80, "cpu")))


def metric_issues(events: DataFrame) -> DataFrame:
    """(event_id, issues, priority): what is wrong with each measurement, its duration against its baseline too, and how urgent that is."""
    rows = baselines(events).select("event_id", "anomaly").join(events.select("event_id", "duration_ms", "memory_mb", "cpu_percent"), "event_id")
    slow = F.when(F.col("duration_ms") > 5000, "critical_duration").when(F.col("duration_ms") > 1000, "slow_duration").when(F.col("anomaly"), "duration_anomaly")
    issues = F.array_compact(F.array(slow, F.when(F.col("memory_mb") > 500, "high_memory"), F.when(F.col("cpu_percent") > 80, "high_cpu")))
    rows = rows.select("event_id", issues.alias("issues"))
    return rows.withColumn("priority", F.when(F.array_contains("issues", "critical_duration"), "critical").when(F.size("issues") > 0, "medium").otherwise("info"))


def error_insights(events: DataFrame) -> DataFrame:
    """(insight, error_type, n): whether there are many troubled events, over 100 or over 50, and their most common type if it has over 10."""
    types = troubled(events).groupBy(F.coalesce("error_type", F.lit("Unknown")).alias("error_type")).agg(F.count("*").alias("n"))
    most = types.agg(F.sum("n").alias("total"), F.max(F.struct("n", F.lit(0))).alias("m"), F.min(F.struct(-F.col("n"), "error_type")).alias("first"))
    many = F.when(F.col("total") > 100, "high error rate").when(F.col("total") > 50, "elevated error rate")
    common = F.when(F.col("m.n") > 10, F.struct(F.lit("most common error").alias("insight"), F.col("first.error_type").alias("error_type"), F.col("m.n").alias("n")))
    rate = F.when(many.isNotNull(), F.struct(many.alias("insight"), F.lit(None).cast("string").alias("error_type"), F.col("total").alias("n")))
    return most.select(F.explode(F.array_compact(F.array(rate, common))).alias("i")).select("i.*")


# Words that make an event critical, and those that tell its impact, in order.
CRITICAL_WORDS = ["error", "exception", "failed", "crash", "timeout", "security", "breach", "unauthorized", "injection", "performance", "slow", "degradation", "bottleneck"]
IMPACT_WORDS = {
    "high": ["payment", "checkout", "login", "signup", "billing", "critical", "critical_feature"],
    "medium": ["search", "export", "dashboard", "report"],
    "low": ["analytics", "logging", "cache", "background"],
}
COMPONENT_IMPACT = {"flask": "medium", "fastapi": "medium", "celery": "low", "database": "low"}
BASE_SCORES = {"critical": 90, "high": 70, "medium": 50, "low": 30}
EVENT_TYPES = {"performance": "performance_degradation", "security": "security_incident", "business": "business_metric", "user_experience": "user_action"}
CRITICAL_MS = 5000


def _has(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def classified(events: DataFrame) -> DataFrame:
    """Events (event_id, message, endpoint, feature, component, priority, category, duration_ms, error_type, error_message) with their class.

    That is user_impact, priority, category, event_type, tags, requires_analysis and score. Words of the
    message come first, then impact, then durations, which make an event critical whatever it was, then
    errors.
    """
    message = F.lower(F.coalesce("message", F.lit("")))
    whole = F.concat_ws(" ", message, F.lower(F.coalesce("endpoint", F.lit(""))), F.lower(F.coalesce("feature", F.lit(""))))
    impact, by_component = F.lit(None).cast("string"), F.lit("none")
    for level, words in reversed(IMPACT_WORDS.items()):
        impact = F.when(_has(whole, words), level).otherwise(impact)
    for name, level in COMPONENT_IMPACT.items():
        by_component = F.when(F.col("component") == name, level).otherwise(by_component)
    alarming, slow = _has(message, CRITICAL_WORDS), F.coalesce(F.col("duration_ms") > CRITICAL_MS, F.lit(False))
    wrong = (F.coalesce("error_type", F.lit("")) != "") | (F.coalesce("error_message", F.lit("")) != "")
    flags = events.select("*", F.coalesce(impact, by_component).alias("__impact"), alarming.alias("__alarming"), slow.alias("__slow"), wrong.alias("__wrong"))
    serious = F.col("__impact") == "high"
    priority = F.when(F.col("__alarming") | F.col("__slow"), "critical").when(serious, "high").when(F.col("__wrong") & (F.col("priority") == "info"), "medium").otherwise(F.col("priority"))
    category = F.when(F.col("__wrong"), "error").when(F.col("__slow"), "performance").otherwise(F.col("category"))
    tags = F.array_compact(F.array(F.when(F.col("__alarming"), "critical_pattern"), F.when(serious, "business_critical"), F.when(F.col("__slow"), "performance_critical"), F.when(F.col("__wrong"), "error_analysis")))
    out = flags.select("event_id", F.col("__impact").alias("user_impact"), priority.alias("priority"), category.alias("category"), tags.alias("tags"), (F.col("__alarming") | serious | F.col("__slow")).alias("requires_analysis"), "duration_ms", "error_type")
    kind = F.lit("system_metric")
    for name, event_type in EVENT_TYPES.items():
        kind = F.when(F.col("category") == name, event_type).otherwise(kind)
    kind = F.when((F.col("category") == "error") & (F.col("priority") == "critical"), "critical_error").otherwise(kind)
    base = F.lit(10)
    for name, points in BASE_SCORES.items():
        base = F.when(F.col("priority") == name, points).otherwise(base)
    more = F.when(F.col("user_impact") == "high", 10).otherwise(0) + F.when(F.col("duration_ms") > 1000, 5).otherwise(0) + F.when(F.coalesce("error_type", F.lit("")) != "", 5).otherwise(0)
    return out.withColumns({"event_type": kind, "score": F.least(base + more, F.lit(100))}).drop("duration_ms", "error_type")
