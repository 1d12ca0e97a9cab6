"""The engine's queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import stages
from lexweave.functions import anonymise, derived, legal, scalars, sections, swiss
from lexweave.operators import crawls, duplicates, event_stats, filters, stats, titles
from lexweave.plans.views import VIEWS_SQL, Views
from lexweave.search import index, stems

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = datetime(2001, 8, 1)


def query(sql: str | None = None) -> Callable:
    """Register a function of the views under its name, and its SQL over the same views."""

    def add(f: Callable[[Views], DataFrame]) -> Callable:
        assert f.__name__ not in QUERIES, f.__name__
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            own = sql.strip()
            views = VIEWS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) if own.startswith("WITH RECURSIVE ") else VIEWS_SQL
            own = own.removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
            ORACLE_SQL[f.__name__] = views.rstrip() + ("\n" if own == sql.strip() else ",\n") + own
        return f

    return add


# --- filters, sorting, pages


@query("SELECT id, source, decision_date FROM decisions WHERE source = 'ris' AND decision_date >= TIMESTAMP '1996-01-01' AND decision_date <= TIMESTAMP '1998-12-31'")
def filter_source_dates(v):
    return filters.DecisionFilter(source="ris", date_from=datetime(1996, 1, 1), date_to=datetime(1998, 12, 31)).apply(v.decisions).select("id", "source", "decision_date")


@query("SELECT id, source FROM decisions WHERE source IN ('ris', 'gdprhub')")
def filter_in_list(v):
    return filters.DecisionFilter(sources=["ris", "gdprhub"]).apply(v.decisions).select("id", "source")


@query("SELECT id, court FROM decisions WHERE court ILIKE '%vg%' OR court ILIKE '%olg%'")
def filter_courts_any_case(v):
    return filters.DecisionFilter(courts=["vg", "olg"]).apply(v.decisions).select("id", "court")


@query("SELECT id FROM decisions WHERE list_contains(gdpr_articles, 'Art. 6 DSGVO')")
def filter_article(v):
    return filters.DecisionFilter(article="Art. 6 DSGVO").apply(v.decisions).select("id")


@query("SELECT id FROM decisions WHERE list_has_any(gdpr_articles, ['Art. 6 DSGVO', 'Art. 9 DSGVO'])")
def filter_any_article(v):
    return filters.DecisionFilter(articles=["Art. 6 DSGVO", "Art. 9 DSGVO"]).apply(v.decisions).select("id")


@query("SELECT id FROM decisions WHERE anonymization_applied AND NOT pdf_extracted")
def filter_flags(v):
    return filters.DecisionFilter(has_anonymization=True, has_pdf=False).apply(v.decisions).select("id")


@query("SELECT id, title FROM decisions WHERE title ILIKE '%urgent%' OR list_contains(keywords, 'urgent')")
def filter_keyword(v):
    return filters.DecisionFilter(keyword="urgent").apply(v.decisions).select("id", "title")


@query("SELECT id, court FROM decisions WHERE id = '77'")
def point_lookup(v):
    return v.decisions.filter("id = '77'").select("id", "court")


@query("SELECT id FROM decisions WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY")
def filter_recent(v):
    return v.decisions.filter(filters.since("created_at", AS_OF, 90)).select("id")


@query("SELECT event_id FROM event_log WHERE priority IN ('high', 'critical')")
def events_from_priority(v):
    return v.events.filter(filters.at_least_priority("priority", "high")).select("event_id")


@query("SELECT event_id, duration_ms FROM event_log WHERE component = 'click' AND timestamp >= TIMESTAMP '2024-01-10' AND timestamp <= TIMESTAMP '2024-01-20'")
def events_filtered(v):
    return v.events.filter("component = 'click' AND timestamp >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND timestamp <= TIMESTAMP_NTZ '2024-01-20 00:00:00'").select("event_id", "duration_ms")


@query("SELECT id, decision_date FROM decisions ORDER BY decision_date DESC NULLS FIRST, id LIMIT 25")
def sorted_nulls_first(v):
    return filters.sorted_by(v.decisions).limit(25).select("id", "decision_date")


@query("SELECT id, n.total, ceil(n.total / 20.0)::BIGINT AS pages, TRUE AS has_next, TRUE AS has_prev FROM decisions, (SELECT count(*) AS total FROM decisions) n ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def third_page(v):
    return filters.page(v.decisions, 3, 20, F.desc("created_at"), F.col("id")).select("id", "total", "pages", "has_next", "has_prev")


@query("SELECT id, court, case_number FROM decisions ORDER BY created_at DESC, id LIMIT 10")
def newest(v):
    return v.decisions.orderBy(F.desc("created_at"), "id").limit(10).select("id", "court", "case_number")


@query("SELECT id, source, source_id, title, court, case_number, decision_date, array_to_string(coalesce(gdpr_articles, []), '|') AS articles, quality_score FROM decisions")
def api_rows(v):
    return filters.api_row(v.decisions).select("id", "source", "source_id", "title", "court", "case_number", "decision_date", F.array_join("gdpr_articles", "|").alias("articles"), "quality_score")


# --- exports


@query("""SELECT id, title, court, case_number, source, strftime(decision_date, '%Y-%m-%d') AS date, array_to_string(coalesce(gdpr_articles, []), ', ') AS articles,
  array_to_string(coalesce(keywords, []), ', ') AS keywords, left(leitsatz, 200) || '...' AS headnote, CASE WHEN anonymization_applied THEN 'Ja' ELSE 'Nein' END AS anonymized,
  CASE WHEN pdf_extracted THEN 'Ja' ELSE 'Nein' END AS pdf FROM decisions""")
def export_rows(v):
    return filters.export_row(v.decisions)


@query("""SELECT 'source' AS section, source AS name, count(*) AS n FROM decisions GROUP BY source UNION ALL
  (SELECT 'court', court, count(*) FROM decisions WHERE court IS NOT NULL GROUP BY court ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL
  (SELECT 'article', a, count(*) FROM (SELECT unnest(gdpr_articles) AS a FROM decisions) GROUP BY a ORDER BY 3 DESC, 2 LIMIT 10)""")
def export_statistics(v):
    d = v.decisions
    parts = [stats.group_count(d, "source", "name"), stats.group_count(d, "court", "name", 10, keep_null=False), stats.element_count(d, "gdpr_articles", "name", 10)]
    parts = [p.select(F.lit(s).alias("section"), "name", "n") for s, p in zip(("source", "court", "article"), parts, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- statistics


@query("SELECT source, count(*) AS n FROM decisions GROUP BY source")
def count_by_source(v):
    return stats.group_count(v.decisions, "source", "source")


@query("SELECT court, count(*) AS n FROM decisions WHERE court IS NOT NULL GROUP BY court ORDER BY n DESC, court LIMIT 10")
def top_courts(v):
    return stats.group_count(v.decisions, "court", "court", 10, keep_null=False)


@query("SELECT year(decision_date) AS year, count(*) AS n FROM decisions WHERE decision_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 10")
def count_by_year(v):
    return stats.by_year(v.decisions)


@query("SELECT article, count(*) AS n FROM (SELECT unnest(gdpr_articles) AS article FROM decisions) GROUP BY article ORDER BY n DESC, article LIMIT 15")
def top_articles(v):
    return stats.element_count(v.decisions, "gdpr_articles", "article", 15)


@query("SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM decisions) GROUP BY keyword ORDER BY n DESC, keyword LIMIT 20")
def top_keywords(v):
    return stats.element_count(v.decisions, "keywords", "keyword", 20)


@query("SELECT strftime(decision_date, '%Y-%m') AS period, count(*) AS n, count(DISTINCT court) AS courts, count(DISTINCT source) AS sources FROM decisions WHERE decision_date IS NOT NULL GROUP BY 1")
def timeline_month(v):
    return stats.timeline(v.decisions, "month")


@query("SELECT strftime(decision_date, '%Y-%V') AS period, count(*) AS n, count(DISTINCT court) AS courts, count(DISTINCT source) AS sources FROM decisions WHERE decision_date IS NOT NULL GROUP BY 1")
def timeline_week(v):
    return stats.timeline(v.decisions, "week")


@query("SELECT year(decision_date) || '-Q' || quarter(decision_date) AS period, count(*) AS n, count(DISTINCT court) AS courts, count(DISTINCT source) AS sources FROM decisions WHERE decision_date IS NOT NULL GROUP BY 1")
def timeline_quarter(v):
    return stats.timeline(v.decisions, "quarter")


@query("""WITH a AS (SELECT id, court, source, decision_date, unnest(gdpr_articles) AS article FROM decisions),
  g AS (SELECT article, count(DISTINCT id) AS decisions, count(DISTINCT court) AS courts, count(DISTINCT source) AS sources, min(decision_date) AS first_date, max(decision_date) AS last_date,
        list_sort(list(DISTINCT court) FILTER (court IS NOT NULL)) AS names FROM a GROUP BY article)
  SELECT article, decisions, courts, sources, first_date, last_date,
    array_to_string(CASE WHEN len(names) > 5 THEN list_append(names[1:5], '... und ' || (len(names) - 5) || ' weitere') ELSE names END, '|') AS names FROM g""")
def article_statistics(v):
    return stats.article_statistics(v.decisions).withColumn("names", F.array_join("names", "|"))


@query("""WITH a AS (SELECT id, unnest(gdpr_articles) AS article FROM decisions)
  SELECT x.article AS first, y.article AS second, count(*) AS n FROM a x JOIN a y ON x.id = y.id AND x.article < y.article GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20""")
def article_co_occurrence(v):
    return stats.co_occurrence(v.decisions)


@query("""WITH g AS (SELECT court, count(*) AS decisions, count(DISTINCT source) AS sources, min(decision_date) AS first_date, max(decision_date) AS last_date,
    round(avg(coalesce(anonymization_applied::INT, 0)), 4) AS anonymized FROM decisions WHERE court IS NOT NULL GROUP BY court),
  a AS (SELECT court, list_sort(list(DISTINCT article)) AS articles FROM (SELECT court, unnest(gdpr_articles) AS article FROM decisions) GROUP BY court)
  SELECT g.*, array_to_string(articles[1:5], '|') AS articles FROM g LEFT JOIN a USING (court) ORDER BY decisions DESC, court LIMIT 50""")
def court_statistics(v):
    return stats.court_statistics(v.decisions).withColumn("articles", F.array_join("articles", "|"))


@query(f"""WITH g AS (SELECT court, count(*) AS n, CASE {' '.join(f"WHEN contains(court, '{c}') THEN '{c}'" for c in stats.COURT_GROUPS)} ELSE 'Andere' END AS kind FROM decisions WHERE court IS NOT NULL GROUP BY court),
  r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, court) AS k FROM g)
  SELECT kind, count(*) AS courts, sum(n)::BIGINT AS decisions, string_agg(court, '|' ORDER BY k) FILTER (k <= 5) AS top FROM r GROUP BY kind""")
def court_groups(v):
    return stats.court_groups(v.decisions)


@query("""SELECT count(*) AS total, count(DISTINCT court) AS courts, count(DISTINCT source) AS sources, count(*) FILTER (created_at >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAY) AS recent,
  round(100.0::DOUBLE * count(*) FILTER (anonymization_applied) / count(*), 1) AS anonymized_share, round(100.0::DOUBLE * count(*) FILTER (len(gdpr_articles) > 0) / count(*), 1) AS article_share,
  min(decision_date) AS first_date, max(decision_date) AS last_date FROM decisions""")
def summary(v):
    return stats.summary(v.decisions, AS_OF)


@query("SELECT count(*) AS total, count(DISTINCT case_number) AS unique_cases, count(*) - count(DISTINCT case_number) AS duplicates FROM decisions")
def dedup_statistics(v):
    return stats.dedup_statistics(v.decisions)


@query("SELECT source, count(*) AS n, count(court) AS with_court, count(decision_date) AS with_date, round(avg(quality_score), 6) AS quality, count(*) FILTER (len(gdpr_articles) > 0) AS with_articles FROM decisions GROUP BY source")
def quality_view(v):
    return stats.quality_view(v.decisions)


@query("""SELECT round(100.0::DOUBLE * count(court) / count(*), 2) AS court_filled, round(100.0::DOUBLE * count(decision_date) / count(*), 2) AS decision_date_filled, round(100.0::DOUBLE * count(gdpr_articles) / count(*), 2) AS gdpr_articles_filled,
  round(100.0::DOUBLE * count(leitsatz) / count(*), 2) AS leitsatz_filled, round(100.0::DOUBLE * count(tenor) / count(*), 2) AS tenor_filled FROM decisions""")
def coverage(v):
    return stats.coverage(v.decisions)


@query("SELECT id, source, created_at FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, id) AS k FROM decisions) WHERE k = 1")
def latest_per_source(v):
    return stats.latest_per_key(v.decisions, "source", F.desc("created_at"), F.col("id")).select("id", "source", "created_at")


@query("""WITH g AS (SELECT quality_score, count(*) AS n FROM decisions GROUP BY 1)
  SELECT quality_score, n, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS share, round(100.0::DOUBLE * sum(n) OVER (ORDER BY quality_score DESC) / sum(n) OVER (), 4) AS share_upper FROM g""")
def quality_histogram(v):
    return stats.score_histogram(v.decisions, "quality_score")


@query("""WITH m AS (SELECT * FROM decisions WHERE title ILIKE '%urgent%'),
  u AS (SELECT 'source' AS facet, source AS value FROM m UNION ALL SELECT 'court', court FROM m UNION ALL SELECT 'article', unnest(gdpr_articles) FROM m),
  g AS (SELECT facet, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY 1, 2)
  SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS k FROM g) WHERE k <= 10""")
def facets(v):
    return stats.facets(v.decisions.filter(filters.contains_any_case(F.col("title"), "urgent")))


@query("SELECT DISTINCT keyword FROM (SELECT unnest(keywords) AS keyword FROM decisions) WHERE starts_with(lower(keyword), 'b') ORDER BY keyword LIMIT 10")
def suggestions(v):
    return stats.suggestions(v.decisions, "b")


@query("""SELECT DISTINCT keyword FROM ((SELECT DISTINCT keyword FROM (SELECT unnest(keywords) AS keyword FROM decisions) WHERE starts_with(lower(keyword), 'art') ORDER BY 1 LIMIT 10) UNION ALL
  (SELECT article FROM (SELECT unnest(gdpr_articles) AS article FROM decisions) GROUP BY article ORDER BY count(*) DESC, article LIMIT 5)) ORDER BY 1 LIMIT 10""")
def suggestions_with_articles(v):
    return stats.suggestions(v.decisions, "Art")


# --- duplicates


@query("""SELECT a.id AS a, b.id AS b FROM decisions a JOIN decisions b ON a.case_number = b.case_number AND a.court = b.court AND a.id < b.id""")
def exact_duplicates(v):
    return duplicates.exact_pairs(v.decisions)


@query("SELECT title, court, min(id) AS first_id, count(*) AS n FROM decisions GROUP BY title, court HAVING count(*) > 1")
def duplicate_groups(v):
    return duplicates.groups_by_key(v.decisions, "title", "court")


@query("""SELECT id, title, court FROM (SELECT *, row_number() OVER (PARTITION BY title, court ORDER BY CASE source WHEN 'manual' THEN 4 WHEN 'gdprhub' THEN 3 WHEN 'openlegaldata' THEN 2 WHEN 'ris' THEN 1 ELSE 0 END DESC, id) AS k FROM decisions) WHERE k = 1""")
def masters(v):
    return duplicates.masters(v.decisions, "title", "court").select("id", "title", "court")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY title, court ORDER BY CASE source WHEN 'manual' THEN 4 WHEN 'gdprhub' THEN 3 WHEN 'openlegaldata' THEN 2 WHEN 'ris' THEN 1 ELSE 0 END DESC, id) AS k FROM decisions)
  SELECT title, court, arg_min(id, k) AS master, coalesce(array_to_string(list_sort(list_distinct(flatten(list(gdpr_articles) FILTER (gdpr_articles IS NOT NULL)))), '|'), '') AS gdpr_articles, arg_min(leitsatz, k) FILTER (leitsatz IS NOT NULL) AS leitsatz,
    arg_min(tenor, k) FILTER (tenor IS NOT NULL) AS tenor, count(*) AS n FROM r GROUP BY title, court""")
def merged(v):
    out = duplicates.merged(v.decisions, "title", "court")
    return out.select("title", "court", "master", F.array_join("gdpr_articles", "|").alias("gdpr_articles"), "leitsatz", "tenor", F.size("merged_ids").cast("long").alias("n"))


@query("""WITH e AS (SELECT DISTINCT case_number, source FROM decisions WHERE quality_score <= 2)
  SELECT id FROM (SELECT d.id, row_number() OVER (PARTITION BY d.case_number, d.source ORDER BY d.id) AS k FROM decisions d WHERE quality_score > 2 AND NOT EXISTS (SELECT 1 FROM e WHERE e.case_number = d.case_number AND e.source = d.source)) WHERE k = 1""")
def insert_if_absent(v):
    old, new = v.decisions.filter("quality_score <= 2"), v.decisions.filter("quality_score > 2")
    return duplicates.absent(new, old, "case_number", "source").select("id")


@query("""WITH o AS (SELECT id, title, quality_score FROM decisions WHERE quality_score <= 4), w AS (SELECT id, 'neu' AS title, quality_score + 1 AS quality_score FROM decisions WHERE quality_score >= 3)
  SELECT coalesce(o.id, w.id) AS id, CASE WHEN o.id IS NULL THEN w.title ELSE o.title END AS title, coalesce(w.quality_score, o.quality_score) AS quality_score FROM o FULL JOIN w ON o.id = w.id""")
def upsert(v):
    old = v.decisions.filter("quality_score <= 4").select("id", "title", "quality_score")
    new = v.decisions.filter("quality_score >= 3").select("id", F.lit("neu").alias("title"), (F.col("quality_score") + 1).alias("quality_score"))
    return duplicates.upserted(old, new, ("id",), ("quality_score",))


@query("SELECT id FROM decisions WHERE created_at >= TIMESTAMP '1996-01-01' OR source <> 'ris'")
def delete_older(v):
    gone = v.decisions.filter("created_at < TIMESTAMP_NTZ '1996-01-01 00:00:00' AND source = 'ris'")
    return duplicates.without(v.decisions, gone).select("id")


@query(r"""WITH h AS (SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(left(text, 5000)), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS content_hash FROM documents)
  SELECT content_hash, min(doc_id) AS first, count(*) AS n FROM h GROUP BY 1 HAVING count(*) > 1""")
def same_content(v):
    return duplicates.same_content(v.documents)


@query()
def similar_titles(v):
    return titles.title_pairs(v.decisions)


@query(rf"""WITH k AS (SELECT id, CASE {' '.join(f"WHEN contains(upper(court), '{c}') THEN '{c}'" for c in scalars.COURT_CODES)} END AS kind, trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM decisions),
  t AS (SELECT kind, norm, min(id) AS id, length(norm) AS n FROM k WHERE kind IS NOT NULL AND norm <> '' GROUP BY kind, norm),
  c AS (SELECT kind, id, n, s, count(*) AS m FROM (SELECT kind, id, n, unnest(string_split(norm, '')) AS s FROM t) GROUP BY ALL)
  SELECT l.id AS a, r.id AS b, sum(least(l.m, r.m))::BIGINT AS shared FROM c l JOIN c r ON l.kind = r.kind AND l.s = r.s AND l.id < r.id GROUP BY l.id, r.id, l.n, r.n HAVING 200 * sum(least(l.m, r.m)) >= 85 * (l.n + r.n)""")
def title_bags(v):
    """Pairs of titles that share enough signs to be similar: all that the exact join has to compare."""
    return titles.bag_pairs(titles.distinct_titles(titles.titles_once(v.decisions))).select("a", "b", F.col("shared").cast("long").alias("shared"))


# --- events


@query("""WITH g AS (SELECT component, list_sort(list(duration_ms)) AS d, count(*) AS n, round(avg(duration_ms), 4) AS mean FROM event_log GROUP BY component)
  SELECT component, n, mean, d[floor(n * 0.5)::INT + 1] AS median, d[floor(n * 0.95)::INT + 1] AS p95, d[floor(n * 0.99)::INT + 1] AS p99, d[1] AS least, d[n] AS most FROM g""")
def event_performance(v):
    return event_stats.performance(v.events)


@query("""WITH g AS (SELECT component, list_sort(list(duration_ms)) AS d, count(*) AS n, avg(duration_ms) AS mean FROM event_log GROUP BY component),
  i AS (SELECT component, unnest([CASE WHEN d[floor(n * 0.95)::INT + 1] > 2000 THEN 'high p95' END, CASE WHEN mean > 1000 THEN 'slow on average' END, CASE WHEN d[n] > 10000 THEN 'very slow single operation' END]) AS insight FROM g)
  SELECT * FROM i WHERE insight IS NOT NULL""")
def event_insights(v):
    return event_stats.insights(event_stats.performance(v.events))


@query("SELECT hour(timestamp)::INT AS hour, round(avg(duration_ms), 4) AS mean, count(*) AS n FROM event_log GROUP BY 1")
def events_by_hour(v):
    return event_stats.by_hour(v.events)


@query("SELECT 'type' AS kind, coalesce(error_type, 'Unknown') AS value, count(*) AS n FROM event_log WHERE category = 'error' GROUP BY 2 UNION ALL SELECT 'component', component, count(*) FROM event_log WHERE category = 'error' GROUP BY 2")
def event_errors(v):
    return event_stats.errors(v.events)


@query("SELECT coalesce(feature, 'unknown') AS feature, count(*) AS n, count(*) FILTER (user_impact = 'high') AS high_impact FROM event_log GROUP BY 1")
def feature_usage(v):
    return event_stats.feature_usage(v.events)


@query("""WITH g AS (SELECT operation, round(greatest(0.0, 100 - count(*) FILTER (category = 'error')::DOUBLE / count(*) * 1000), 4) AS score FROM event_log GROUP BY 1)
  SELECT *, CASE WHEN score > 90 THEN 'healthy' WHEN score > 70 THEN 'degraded' ELSE 'unhealthy' END AS status FROM g""")
def operation_health(v):
    return event_stats.health(v.events)


@query("SELECT event_id, component, operation, duration_ms FROM event_log ORDER BY duration_ms DESC, event_id LIMIT 10")
def slowest_events(v):
    return event_stats.slowest(v.events)


@query("SELECT event_id, priority_score FROM event_log WHERE requires_analysis AND priority_score >= 70 ORDER BY priority_score DESC, event_id LIMIT 20")
def triage_queue(v):
    return event_stats.triage(v.events)


@query("""WITH b AS (SELECT event_id, duration_ms, avg(duration_ms) OVER w AS mean, stddev_samp(duration_ms) OVER w AS deviation, count(*) OVER w AS seen FROM event_log
    WINDOW w AS (PARTITION BY component, operation ORDER BY timestamp, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
  SELECT event_id, seen, coalesce(seen >= 10 AND mean <> 0 AND duration_ms > mean + 2 * deviation, FALSE) AS anomaly FROM b""")
def event_baselines(v):
    return event_stats.baselines(v.events).select("event_id", "seen", "anomaly")


@query("""WITH b AS (SELECT *, avg(duration_ms) OVER (PARTITION BY component) AS mean FROM event_log)
  SELECT event_id, greatest(0, 100 - CASE WHEN duration_ms / mean > 3 THEN 40 WHEN duration_ms / mean > 2 THEN 25 WHEN duration_ms / mean > 1.5 THEN 15 ELSE 0 END - CASE WHEN memory_mb > 1000 THEN 20 WHEN memory_mb > 500 THEN 10 ELSE 0 END
    - CASE WHEN cpu_percent > 90 THEN 20 WHEN cpu_percent > 70 THEN 10 ELSE 0 END) AS score FROM b""")
def performance_scores(v):
    from pyspark.sql import Window

    mean = F.avg("duration_ms").over(Window.partitionBy("component"))
    rows = v.events.select("event_id", "duration_ms", "memory_mb", "cpu_percent", mean.alias("mean"))
    return rows.select("event_id", event_stats.performance_score(F.col("duration_ms"), F.col("mean"), F.col("memory_mb"), F.col("cpu_percent")).alias("score"))


@query("""SELECT event_id, user_id, count(*) OVER w AS requests, count(*) OVER w <= 3 AS allowed FROM event_log WINDOW w AS (PARTITION BY user_id ORDER BY timestamp RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW)""")
def request_rate(v):
    return event_stats.recent_requests(v.events, seconds=600, most=3)


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN duration_ms > 5000 THEN 'critical duration' WHEN duration_ms > 1000 THEN 'slow' END, CASE WHEN memory_mb > 500 THEN 'memory' END, CASE WHEN cpu_percent > 80 THEN 'cpu' END], lambda x: x IS NOT NULL), '|') AS issues FROM event_log""")
def event_issues(v):
    return v.events.select("event_id", F.array_join(event_stats.issue_list(F.col("duration_ms"), F.col("memory_mb"), F.col("cpu_percent")), "|").alias("issues"))


# --- legal texts


def _articles_sql(pattern: str) -> str:
    g = lambda k: f"regexp_extract_all(text, '{pattern}', {k}, 'i')"
    return f"list_transform(list_zip({g(1)}, {g(2)}, {g(3)}), lambda m: 'Art. ' || m[1] || CASE WHEN m[2] <> '' THEN ' Abs. ' || m[2] ELSE '' END || CASE WHEN m[3] <> '' THEN ' lit. ' || m[3] ELSE '' END || ' DSGVO')"


_RANGE_SQL = f"list_transform(list_zip(regexp_extract_all(text, '{legal.RANGE}', 1, 'i'), regexp_extract_all(text, '{legal.RANGE}', 2, 'i')), lambda m: 'Art. ' || m[1] || '-' || m[2] || ' DSGVO')"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(flatten([{', '.join(map(_articles_sql, legal.ARTICLE_PATTERNS))}, {_RANGE_SQL}]))), '|') AS articles FROM legal_docs")
def cited_articles(v):
    return v.legal_docs.select("doc_id", F.array_join(legal.gdpr_articles(F.col("text")), "|").alias("articles"))


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(
    list_transform(list_zip(regexp_extract_all(text, '{legal.SECTION}', 1, 'i'), regexp_extract_all(text, '{legal.SECTION}', 2, 'i')), lambda m: '§ ' || m[1] || CASE WHEN m[2] <> '' THEN ' Abs. ' || m[2] ELSE '' END || ' BDSG'),
    flatten(list_transform(list_zip(regexp_extract_all(text, '{legal.SECTIONS}', 1, 'i'), regexp_extract_all(text, '{legal.SECTIONS}', 2, 'i')), lambda m: list_transform(range(m[1]::BIGINT, m[2]::BIGINT + 1), lambda k: '§ ' || k || ' BDSG')))))), '|') AS sections FROM legal_docs""")
def cited_sections(v):
    return v.legal_docs.select("doc_id", F.array_join(legal.bdsg_sections(F.col("text")), "|").alias("sections"))


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join(f"regexp_extract(text, '{p}', 1, 'i')" for p in legal.KEYWORD_PATTERNS)}], lambda x: x <> ''), '|') AS keywords FROM legal_docs")
def legal_keywords(v):
    return v.legal_docs.select("doc_id", F.array_join(legal.keywords(F.col("text")), "|").alias("keywords"))


def weights_sql(weights: list, text: str) -> str:
    return "least(50, " + " + ".join(f"CASE WHEN {' OR '.join(f"regexp_matches({text}, '{p}', 'i')" for p in patterns)} THEN {w} ELSE 0 END" for w, patterns in weights) + ")"


@query(f"SELECT doc_id, {weights_sql(legal.RELEVANCE, "lower(text || ' ' || source)")} AS score FROM legal_docs")
def relevance_scores(v):
    return v.legal_docs.select("doc_id", legal.relevance(F.col("text"), F.col("source")).alias("score"))


@query(f"SELECT doc_id, {weights_sql(legal.STAGE1, "source || ' ' || text")} AS stage1_score FROM legal_docs")
def stage1_scores(v):
    return v.legal_docs.select("doc_id", legal.weighted(F.concat_ws(" ", "source", "text"), legal.STAGE1).alias("stage1_score"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'der') OR contains(lower(text), 'die') OR contains(lower(text), 'das') THEN 'de' ELSE 'en' END AS language FROM documents")
def language_guess(v):
    return v.documents.select("doc_id", scalars.language(F.col("text")).alias("language"))


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE sha256(text) END AS text_hash FROM documents")
def text_hashes(v):
    return v.documents.select("doc_id", scalars.text_hash(F.col("text")).alias("text_hash"))


@query(f"SELECT id, CASE {' '.join(f"WHEN contains(upper(court), '{c}') THEN '{c}'" for c in scalars.COURT_CODES)} END AS code FROM decisions")
def court_codes(v):
    return v.decisions.select("id", scalars.court_code(F.col("court")).alias("code"))


@query("SELECT id, (title <> '')::INT + 2 + CASE WHEN court IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN decision_date IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN leitsatz IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN tenor IS NOT NULL THEN 3 ELSE 0 END AS score FROM decisions")
def completeness_scores(v):
    weights = {"title": 1, "case_number": 2, "court": 2, "decision_date": 1, "leitsatz": 3, "tenor": 3}
    return v.decisions.select("id", scalars.completeness(weights).alias("score"))


@query(r"SELECT doc_id, regexp_replace(regexp_extract(text, '(?:EUR|€)\s*([\d][\d.,]*)', 1, 'i'), '[.,]', '', 'g')::BIGINT AS fine FROM legal_docs WHERE regexp_matches(text, '(?:EUR|€)\s*\d', 'i')")
def fines(v):
    return v.legal_docs.select("doc_id", scalars.fine_eur(F.col("text")).alias("fine")).filter("fine IS NOT NULL")


@query()
def anonymised_texts(v):
    return v.documents.select("doc_id", anonymise.anonymised(F.col("text")).alias("a")).select("doc_id", "a.text", F.size("a.hashes").alias("n"))


@query("SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS url, regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '([^/]+)/?$', 1) AS last FROM pages")
def page_urls(v):
    return v.table("pages").select("page_id", scalars.normal_url(F.col("url")).alias("url"), scalars.last_path_part(F.col("url")).alias("last"))


@query(f"SELECT doc_id, {weights_sql(swiss.RELEVANCE, "lower(text || ' ' || source || '    ')").replace("d'accès", "d''accès")} + CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END AS score FROM legal_docs")
def swiss_scores(v):
    none, court = F.lit(""), F.when(F.col("doc_id") % 2 == 0, "Bundesgericht").otherwise("Obergericht")
    return v.legal_docs.select("doc_id", swiss.relevance(F.col("text"), F.col("source"), none, none, none, court).alias("score"))


@query("""SELECT doc_id, CASE WHEN contains(left(text, 500), 'Bundesgericht') THEN 'Bundesgericht' WHEN doc_id % 2 = 0 THEN 'Kantonsgericht ' || lang ELSE 'Schweizer Gericht' END AS court FROM legal_docs""")
def swiss_courts(v):
    canton = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return v.legal_docs.select("doc_id", swiss.court_of(F.lit(None).cast("string"), F.col("text"), canton).alias("court"))


@query()
def text_sections(v):
    text = F.concat(F.lit("Leitsatz:\nEin Leitsatz über Einwilligung und Daten.\nTenor:\nDie Klage wird abgewiesen, Kosten trägt jeder.\nGründe:\n"), "text")
    return v.legal_docs.select("doc_id", sections.sections(text).alias("s")).select("doc_id", "s.leitsatz", "s.tenor", F.length("s.entscheidungsgruende").alias("n"))


@query(r"""SELECT doc_id, nullif(regexp_extract(left(text, 1000), '(\b\d{1,2}\.\s*\d{1,2}\.\s*\d{4}\b)', 1), '') AS date FROM legal_docs""")
def head_dates(v):
    return v.legal_docs.select("doc_id", sections.head_data(F.col("text")).alias("h")).select("doc_id", "h.date")


@query("""SELECT id, CASE WHEN court IS NULL THEN '' ELSE court || ' ' END || 'Urteil (' || case_number || ')' || CASE WHEN decision_date IS NULL THEN '' ELSE ' vom ' || strftime(decision_date, '%Y-%m-%d') END AS title FROM decisions""")
def generated_titles(v):
    return v.decisions.select("id", derived.title(F.col("court"), F.lit("Urteil"), F.col("case_number"), F.date_format("decision_date", "yyyy-MM-dd")).alias("title"))


@query("""WITH w AS (SELECT *, list_filter(string_split(title, ' '), lambda x: len(x) > 3 AND lower(x) NOT IN ('der', 'die', 'das', 'und', 'oder', 'vom', 'am', 'im'))[1:5] AS words,
    CASE WHEN contains(court, 'BGH') THEN ['Bundesgerichtshof'] WHEN contains(court, 'OLG') THEN ['Oberlandesgericht'] WHEN contains(court, 'LG') THEN ['Landgericht'] WHEN contains(court, 'AG') THEN ['Amtsgericht'] ELSE [] END AS kind FROM decisions)
  SELECT id, array_to_string(list_concat(words, kind, CASE WHEN len(gdpr_articles) > 0 THEN list_concat(['DSGVO'], list_transform(gdpr_articles[1:3], lambda a: 'Art. ' || a || ' DSGVO')) ELSE [] END)[1:10], '|') AS keywords FROM w""")
def derived_keywords(v):
    return v.decisions.select("id", F.array_join(derived.keywords(F.col("title"), F.col("court"), F.col("gdpr_articles")), "|").alias("keywords"))


@query("SELECT id, md5(title || '_' || coalesce(strftime(decision_date, '%Y-%m-%d'), '')) AS fallback_id FROM decisions")
def fallback_ids(v):
    return v.decisions.select("id", derived.fallback_id(F.col("title"), F.date_format("decision_date", "yyyy-MM-dd")).alias("fallback_id"))


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in derived.RESIDUALS.items()) + "], lambda x: x IS NOT NULL), '|') AS left_over FROM documents")
def residual_data(v):
    return v.documents.select("doc_id", F.array_join(derived.residuals(F.col("text")), "|").alias("left_over"))


@query("SELECT event_id, CASE WHEN duration_ms > 5000 THEN 'critical' WHEN duration_ms > 1000 THEN 'medium' ELSE 'info' END AS priority, CASE WHEN duration_ms > 1000 THEN 'performance_degradation' ELSE 'system_metric' END AS kind FROM event_log")
def duration_priorities(v):
    return v.events.select("event_id", derived.duration_priority(F.col("duration_ms")).alias("priority"), derived.duration_type(F.col("duration_ms")).alias("kind"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'pending_stage1' WHEN 1 THEN 'pending_stage2' ELSE 'approved' END AS status, priority_score AS c FROM event_log)
  SELECT event_id, CASE WHEN status <> 'pending_stage2' THEN CASE status WHEN 'pending_stage1' THEN 'pending_stage2' ELSE status END WHEN c >= 80 THEN 'approved' WHEN c >= 50 THEN 'review_required' ELSE 'rejected' END AS status FROM s""")
def staging_states(v):
    status = F.when(F.col("event_id") % 3 == 0, "pending_stage1").when(F.col("event_id") % 3 == 1, "pending_stage2").otherwise("approved")
    return v.events.select("event_id", F.when(status == "pending_stage1", derived.promoted(status)).otherwise(derived.decided(status, F.col("priority_score"))).alias("status"))


# --- crawls


@query("""WITH s AS (SELECT unnest(['source0', 'source1', 'source2', 'other']) AS source), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id) AS k FROM crawl_logs),
  l AS (SELECT s.source, status, coalesce(finished_at, started_at) AS last_run, total_fetched, total_processed, total_errors FROM s LEFT JOIN n ON s.source = n.source AND k = 1)
  SELECT source, coalesce(status, 'never_run') AS status, last_run, date_trunc('day', last_run) + INTERVAL 2 HOUR + CASE WHEN date_trunc('day', last_run) + INTERVAL 2 HOUR <= TIMESTAMP '2001-08-01' THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS next_run,
    coalesce(total_fetched, 0) AS total_fetched, coalesce(total_processed, 0) AS total_processed, coalesce(total_errors, 0) AS total_errors FROM l""")
def crawl_status(v):
    return crawls.crawl_status(v.crawl_logs, ["source0", "source1", "source2", "other"], AS_OF)


@query("SELECT count(*) AS total, count(*) FILTER (status IN ('completed', 'success')) AS successful, round(100.0::DOUBLE * count(*) FILTER (status IN ('completed', 'success')) / count(*), 2) AS success_rate FROM crawl_logs")
def crawl_success(v):
    return crawls.success_rate(v.crawl_logs)


@query("""SELECT id, date_diff('second', started_at, finished_at) AS seconds, round(total_fetched::DOUBLE / greatest(date_diff('second', started_at, finished_at), 1), 2) AS rate,
  round(100.0::DOUBLE * (total_processed - total_errors) / greatest(total_processed, 1), 2) AS success FROM crawl_logs""")
def crawl_progress(v):
    return crawls.progress(v.crawl_logs)


# --- search

_INDEXES: dict[tuple, index.PostingsIndex] = {}


def stored_index(v, name: str, rows: DataFrame, key: str, fields: dict[str, str], stem: Callable | None = None) -> index.PostingsIndex:
    """The stored index of a view of this folder's tables, written once in a session as long as their files stay as they are."""
    app, tables = v.spark.sparkContext.applicationId, sorted(rows.inputFiles())
    changed = max((str(v.spark.read.parquet(*tables).agg(F.max("_metadata.file_modification_time")).first()[0]),), default="")
    known = (app, name, *tables, changed)
    if known not in _INDEXES:
        table = f"{name}_{uuid.uuid4().hex}"
        made = index.PostingsIndex(v.spark, table, key, fields, stem, path=f"{stages.folder(v.spark)}/{table}")
        made.append(rows)
        _INDEXES[known] = made
    return _INDEXES[known]


def text_index(v) -> index.PostingsIndex:
    return stored_index(v, "texts", v.documents.select("doc_id", "text"), "doc_id", {"text": "C"})


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)
  SELECT doc_id FROM w WHERE (list_contains(w, 'the') AND NOT list_contains(w, 'of')) OR list_contains(w, 'nicht')""")
def search_matches(v):
    return text_index(v).find("the & !of | nicht").select("doc_id")


@query(r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS lexeme FROM documents)
  SELECT lexeme, count(DISTINCT doc_id) AS docs, count(*) AS n FROM w GROUP BY lexeme""")
def lexeme_counts(v):
    return text_index(v).frequencies()


RANKED_SQL = r"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
  n AS (SELECT doc_id, text, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'was')) AS b FROM w),
  r AS (SELECT doc_id, text, least(1.0, %s * ((1 - pow(2.0, -a)) + (1 - pow(2.0, -b))) / 2) AS relevance FROM n WHERE a > 0 AND b > 0)""" % index.CLASS_WEIGHTS["C"]


@query(rf"""{RANKED_SQL},
  t AS (SELECT doc_id, relevance, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM r ORDER BY relevance DESC, doc_id LIMIT 20),
  m AS (SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]', '', 'g')) AS p FROM t),
  a AS (SELECT *, greatest(0, least(coalesce(list_min(list_filter([list_position(p, 'the'), list_position(p, 'was')], lambda x: x > 0)), 1) - 1 - 12, len(w) - 50)) AS start FROM m),
  s AS (SELECT doc_id, relevance, w[start + 1 : start + 50] AS w, p[start + 1 : start + 50] AS p FROM a),
  e AS (SELECT *, greatest(coalesce(list_max(list_filter(range(1, len(w) + 1), lambda i: len(p[i]) > 3)), 0), least(len(w), 25)) AS n FROM s)
  SELECT doc_id, round(relevance, 6) AS relevance, array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN p[i] IN ('the', 'was') THEN '<mark>' || w[i] || '</mark>' ELSE w[i] END), ' ') AS snippet FROM e""")
def search_ranked(v):
    return index.search(text_index(v), v.documents, "text", "the & was").withColumn("relevance", F.round("relevance", 6))


@query("""WITH m AS (SELECT *, CASE WHEN leitsatz IS NULL THEN 1 / 3.0 ELSE 0.4 END AS relevance FROM decisions WHERE title LIKE '%URGENT%' AND (leitsatz IS NULL OR leitsatz <> 'Leitsatz 7' AND tenor IS DISTINCT FROM 'Tenor 7' AND title NOT LIKE 'Entscheidung 7 %'))
  SELECT id, title, court, decision_date, coalesce(tenor, title || '...') AS snippet, relevance, array_to_string(coalesce(gdpr_articles, []), '|') AS gdpr_articles, source, NULL::VARCHAR AS source_url FROM m ORDER BY relevance DESC, id LIMIT 20""")
def search_results(v):
    """A page with all fields, by German stems: Entscheidungen finds Entscheidung, a word of a field may be forbidden, and titles stand in for missing texts."""
    fields = {"title": "A", "leitsatz": "B", "tenor": "C"}
    found = stored_index(v, "decisions", v.decisions.select("id", *fields), "id", fields, stems.stemmed)
    page = found.page("Entscheidungen & URGENT & !leitsatz | Urgent & Entscheidung & Leitsätze & !7", among=v.decisions)
    return index.results(page, v.decisions, "id", "tenor", "Entscheidungen & Urgent", stems.stemmed).withColumn("gdpr_articles", F.array_join("gdpr_articles", "|"))


_V, _C = stems.VOWELS, f"[^{stems.VOWELS}]"
_MARK = "x"
for _sign in "uuyy":  # twice, as matches may touch
    _MARK = f"regexp_replace({_MARK}, '([{_V}]){_sign}([{_V}])', '\\1{_sign.upper()}\\2', 'g')"


@query(rf"""WITH l AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS lexeme FROM documents),
  m AS (SELECT lexeme, {_MARK.replace('(x,', "(replace(lexeme, 'ß', 'ss'),")} AS w FROM l),
  r AS (SELECT *, length(regexp_extract(w, '^(?:{_C}*[{_V}]+{_C})', 0)) AS a, length(regexp_extract(w, '^(?:{_C}*[{_V}]+{_C}){{2}}', 0)) AS b FROM m),
  p AS (SELECT lexeme, w, greatest(3, CASE WHEN a > 0 THEN a ELSE length(w) END) AS r1, CASE WHEN b > 0 THEN b ELSE length(w) END AS r2, regexp_extract(w, '(ern|em|er|en|es|e|s)$', 1) AS e FROM r),
  q AS (SELECT *, left(w, length(w) - length(e)) AS h FROM p),
  s AS (SELECT lexeme, r1, r2, CASE WHEN e = '' OR length(h) < r1 THEN w WHEN e IN ('em', 'ern', 'er') THEN h WHEN e = 's' THEN CASE WHEN regexp_matches(h, '[{stems.BEFORE_S}]$') THEN h ELSE w END WHEN ends_with(h, 'niss') THEN left(h, length(h) - 1) ELSE h END AS w FROM q),
  t AS (SELECT *, regexp_extract(w, '(est|en|er|st)$', 1) AS e FROM s),
  u AS (SELECT *, left(w, length(w) - length(e)) AS h FROM t),
  x AS (SELECT lexeme, r1, r2, CASE WHEN e = '' OR length(h) < r1 THEN w WHEN e <> 'st' OR regexp_matches(h, '...[{stems.BEFORE_ST}]$') THEN h ELSE w END AS w FROM u),
  y AS (SELECT *, regexp_extract(w, '(isch|lich|heit|keit|end|ung|ig|ik)$', 1) AS e FROM x),
  z AS (SELECT *, left(w, length(w) - length(e)) AS h, length(w) - length(e) AS n FROM y),
  o AS (SELECT lexeme, CASE WHEN e = '' OR n < r2 THEN w WHEN e IN ('end', 'ung') THEN CASE WHEN regexp_matches(h, '[^e]ig$') AND n - 2 >= r2 THEN left(h, n - 2) ELSE h END
    WHEN e IN ('ig', 'ik', 'isch') THEN CASE WHEN ends_with(h, 'e') THEN w ELSE h END WHEN e = 'keit' THEN CASE WHEN ends_with(h, 'lich') AND n - 4 >= r2 THEN left(h, n - 4) WHEN ends_with(h, 'ig') AND n - 2 >= r2 THEN left(h, n - 2) ELSE h END
    WHEN regexp_matches(h, '(er|en)$') AND n - 2 >= r1 THEN left(h, n - 2) ELSE h END AS w FROM z)
  SELECT lexeme, translate(w, 'UYäöü', 'uyaou') AS stem FROM o""")
def stemmed_words(v):
    """The German stem of each different word of all texts."""
    return text_index(v).frequencies().select("lexeme", stems.stemmed(F.col("lexeme")).alias("stem"))
