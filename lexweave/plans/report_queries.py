"""Queries over duplicates, candidates, reports, pages and texts, each with its SQL where SQL can say it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lexweave.functions import anonymise, derived, legal, pages, scalars, sections, swiss
from lexweave.operators import candidates, crawls, duplicates, event_stats
from lexweave.plans.queries import AS_OF, RANKED_SQL, query, text_index
from lexweave.search import index

_TS = "TIMESTAMP '2001-08-01'"


# --- duplicates


@query("SELECT * FROM (SELECT id, min(id) OVER w AS first_id, count(*) OVER w AS n FROM decisions WHERE title IS NOT NULL AND court IS NOT NULL WINDOW w AS (PARTITION BY title, court)) WHERE n > 1")
def title_members(v):
    return duplicates.members(v.decisions, "title", "court")


def _dated_texts(v):
    return v.documents.select(F.col("doc_id").alias("id"), "text", (F.lit(2000) + F.col("doc_id") % 4).cast("int").alias("year"))


@query(r"""WITH s AS (SELECT doc_id AS id, 2000 + doc_id % 4 AS year, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> ''))) AS w FROM documents),
  c AS (SELECT year, w, len(w) AS n, min(id) AS id FROM s WHERE len(w) > 0 GROUP BY year, w),
  p AS (SELECT l.id AS a, r.id AS b, len(list_intersect(l.w, r.w)) AS k, l.n + r.n AS n FROM c l JOIN c r ON l.id < r.id AND abs(l.year - r.year) <= 1 AND 10 * least(l.n, r.n) >= 9 * greatest(l.n, r.n))
  SELECT a, b, round(k / (n - k), 6) AS similarity FROM p WHERE 10 * k >= 9 * (n - k)""")
def similar_contents(v):
    return duplicates.similar_contents(_dated_texts(v)).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(r"""WITH s AS (SELECT doc_id AS id, 2000 + doc_id % 4 AS year, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> ''))) AS w FROM documents)
  SELECT id, min(id) OVER (PARTITION BY year, w) AS first_id FROM s WHERE len(w) > 0""")
def content_members(v):
    return duplicates.content_classes(_dated_texts(v))


@query("""WITH s AS (SELECT *, (title <> '')::INT + 2 + CASE WHEN court IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN decision_date IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN leitsatz IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN tenor IS NOT NULL THEN 3 ELSE 0 END AS score FROM decisions)
  SELECT title, id, score FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY score DESC, id) AS k FROM s) WHERE k = 1""")
def complete_masters(v):
    score = scalars.completeness({"title": 1, "case_number": 2, "court": 2, "decision_date": 1, "leitsatz": 3, "tenor": 3})
    return duplicates.masters(v.decisions.withColumn("score", score), "title", by=F.col("score")).select("title", "id", "score")


@query("""WITH k AS (SELECT id, source, case WHEN court IS NULL THEN 'n' || id ELSE 'k' || case_number || '|' || court END AS k FROM decisions)
  SELECT id, min(id) OVER (PARTITION BY k) AS "group", row_number() OVER (PARTITION BY k ORDER BY CASE source WHEN 'manual' THEN 4 WHEN 'gdprhub' THEN 3 WHEN 'openlegaldata' THEN 2 WHEN 'ris' THEN 1 ELSE 0 END DESC, id) = 1 AS master FROM k""")
def collected_sources(v):
    """The decisions of each source by itself, put together again, grouped and with a master for each group."""
    parts = [v.decisions.filter(F.col("source") == s) for s in ("openlegaldata", "gdprhub", "ris", "manual", "swiss")]
    return duplicates.collected(*parts).select("id", "group", "master")


@query()
def linked_groups(v):
    """Groups over exact and title links; SQL has no components."""
    return duplicates.grouped(duplicates.find_duplicates(v.decisions))


@query(r"""WITH RECURSIVE s AS (SELECT doc_id AS id, 2000 + doc_id % 4 AS year, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> ''))) AS w FROM documents),
  p AS (SELECT l.id AS a, r.id AS b, len(list_intersect(l.w, r.w)) AS k, len(l.w) + len(r.w) AS n FROM s l JOIN s r ON l.id <> r.id AND abs(l.year - r.year) <= 1 AND len(l.w) > 0 AND len(r.w) > 0 AND 10 * least(len(l.w), len(r.w)) >= 9 * greatest(len(l.w), len(r.w))),
  e AS MATERIALIZED (SELECT a, b FROM p WHERE 10 * k >= 9 * (n - k)),
  f(id, reached) AS (SELECT a, a FROM e UNION SELECT f.id, e.b FROM f JOIN e ON e.a = f.reached)
  SELECT id, min(reached) AS "group" FROM f GROUP BY id""")
def content_groups(v):
    """Documents of alike contents, directly or through others, by content links alone."""
    return duplicates.grouped(duplicates.content_links(_dated_texts(v)))


# --- events


@query("""SELECT count(*) AS n, round(avg(duration_ms), 4) AS mean, round(median(duration_ms), 4) AS median, round(avg(nullif(memory_mb, 0)), 4) AS memory_mean, max(nullif(memory_mb, 0)) AS memory_most,
  round(avg(nullif(cpu_percent, 0)), 4) AS cpu_mean, max(nullif(cpu_percent, 0)) AS cpu_most FROM event_log WHERE duration_ms IS NOT NULL""")
def event_resources(v):
    return event_stats.resource_summary(v.events)


@query("SELECT count(*) AS errors, round(count(*) / 24.0::DOUBLE, 4) AS per_hour, count(*) FILTER (priority = 'critical') AS critical FROM event_log WHERE category = 'error' OR priority IN ('high', 'critical')")
def event_error_rate(v):
    return event_stats.error_rate(v.events)


@query("""WITH d AS (SELECT event_id, list_sort(list(duration_ms) OVER (PARTITION BY component, operation ORDER BY timestamp, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) AS d FROM event_log)
  SELECT event_id, d[least(floor(len(d) * 0.5), len(d) - 1)::INT + 1] AS median, d[least(floor(len(d) * 0.95), len(d) - 1)::INT + 1] AS p95, d[least(floor(len(d) * 0.99), len(d) - 1)::INT + 1] AS p99 FROM d""")
def event_baseline_percentiles(v):
    return event_stats.baseline_percentiles(v.events)


@query("SELECT event_id, timestamp, component, error_type, user_impact FROM event_log WHERE priority = 'critical'")
def critical_events(v):
    return event_stats.critical_errors(v.events)


@query("""WITH n AS (SELECT count(*) FILTER (duration_ms > 2000) AS a, count(*) FILTER (priority IN ('high', 'critical')) AS b, count(*) FILTER (memory_mb > 100) AS c FROM event_log)
  SELECT 'high' AS priority, 'performance' AS category, 'Optimize Slow Operations' AS title, a AS n FROM n WHERE a > 10 UNION ALL
  SELECT 'critical', 'reliability', 'Reduce Error Rate', b FROM n WHERE b > 20 UNION ALL SELECT 'medium', 'resource_optimization', 'Memory Usage Optimization', c FROM n WHERE c > 5""")
def event_recommendations(v):
    return event_stats.recommendations(v.events)


@query("SELECT event_id, timestamp FROM event_log ORDER BY timestamp DESC, event_id LIMIT 100")
def newest_events(v):
    return event_stats.newest(v.events).select("event_id", "timestamp")


@query("SELECT event_id FROM event_log WHERE component = 'error' AND category = 'error' AND priority = 'high' AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-25'")
def events_chosen(v):
    return event_stats.chosen(v.events, datetime(2024, 1, 5), datetime(2024, 1, 25), "error", "error", "high").select("event_id")


_MESSAGES = {0: "Login abgelehnt", 1: "Bericht: export fertig", 2: "request TIMEOUT", 3: "cache geleert", 4: "ok"}


def _message_events(v):
    message = F.get(F.array(*map(F.lit, _MESSAGES.values())), (F.col("event_id") % 5).cast("int"))
    component = F.get(F.array(*map(F.lit, ("flask", "celery", "worker"))), (F.col("event_id") % 3).cast("int"))
    error = F.when(F.col("event_id") % 11 == 0, "kaputt").when(F.col("event_id") % 11 == 1, "")
    return v.events.withColumns({"message": message, "endpoint": F.concat(F.lit("/api/"), "component"), "component": component, "error_message": error, "category": F.when(F.col("event_id") % 4 == 0, "security").otherwise(F.col("category"))})


def _words_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@query(f"""WITH m AS (SELECT event_id, priority, duration_ms, coalesce(error_type, '') AS e, CASE event_id % 5 {' '.join(f"WHEN {k} THEN '{m}'" for k, m in _MESSAGES.items())} END AS message, '/api/' || component AS endpoint, feature,
    ['flask', 'celery', 'worker'][event_id % 3 + 1] AS component, CASE WHEN event_id % 11 = 0 THEN 'kaputt' ELSE '' END AS em, CASE WHEN event_id % 4 = 0 THEN 'security' ELSE category END AS category FROM event_log),
  t AS (SELECT *, lower(message) AS msg, lower(message) || ' ' || endpoint || ' ' || coalesce(feature, '') AS txt, coalesce(duration_ms > 5000, FALSE) AS slow, e <> '' OR em <> '' AS wrong FROM m),
  u AS (SELECT *, {_words_sql('msg', event_stats.CRITICAL_WORDS)} AS alarm, CASE {' '.join(f"WHEN {_words_sql('txt', w)} THEN '{k}'" for k, w in event_stats.IMPACT_WORDS.items())} WHEN component = 'flask' THEN 'medium' WHEN component = 'celery' THEN 'low' ELSE 'none' END AS impact FROM t),
  w AS (SELECT *, CASE WHEN alarm OR slow THEN 'critical' WHEN impact = 'high' THEN 'high' WHEN wrong AND priority = 'info' THEN 'medium' ELSE priority END AS p, CASE WHEN wrong THEN 'error' WHEN slow THEN 'performance' ELSE category END AS c FROM u)
  SELECT event_id, impact AS user_impact, p AS priority, c AS category, array_to_string(list_filter([CASE WHEN alarm THEN 'critical_pattern' END, CASE WHEN impact = 'high' THEN 'business_critical' END, CASE WHEN slow THEN 'performance_critical' END, CASE WHEN wrong THEN 'error_analysis' END], lambda x: x IS NOT NULL), '|') AS tags,
    alarm OR slow OR impact = 'high' AS requires_analysis, CASE WHEN c = 'error' AND p = 'critical' THEN 'critical_error' WHEN c = 'performance' THEN 'performance_degradation' WHEN c = 'security' THEN 'security_incident' ELSE 'system_metric' END AS event_type,
    least(100, CASE p WHEN 'critical' THEN 90 WHEN 'high' THEN 70 WHEN 'medium' THEN 50 WHEN 'low' THEN 30 ELSE 10 END + CASE WHEN impact = 'high' THEN 10 ELSE 0 END + CASE WHEN duration_ms > 1000 THEN 5 ELSE 0 END + CASE WHEN e <> '' THEN 5 ELSE 0 END) AS score FROM w""")
def classified_events(v):
    return event_stats.classified(_message_events(v)).withColumn("tags", F.array_join("tags", "|"))


# --- candidates and reports


def _candidates(v):
    status = F.get(F.array(*map(F.lit, ("pending_stage1", "review_required", "approved", "rejected"))), (F.col("id").cast("int") % 4))
    return v.decisions.select("id", "source", "title", "created_at", status.alias("status"), (F.col("id").cast("int") % 50).alias("stage1_score"), (F.col("id").cast("int") % 101).cast("double").alias("stage2_confidence"))


_CANDIDATES_SQL = "WITH c AS (SELECT id, source, title, created_at, ['pending_stage1', 'review_required', 'approved', 'rejected'][id::INT % 4 + 1] AS status, id::INT % 50 AS stage1_score, (id::INT % 101)::DOUBLE AS stage2_confidence FROM decisions)"


@query(f"{_CANDIDATES_SQL} SELECT status, source, count(*) AS n, round(avg(stage1_score), 4) AS mean_stage1, round(avg(stage2_confidence), 4) AS mean_confidence, min(created_at) AS oldest, max(created_at) AS newest FROM c GROUP BY status, source")
def pipeline_view(v):
    return candidates.pipeline_view(_candidates(v))


@query(f"{_CANDIDATES_SQL} SELECT id, stage2_confidence, created_at FROM c WHERE status = 'review_required' ORDER BY stage2_confidence DESC, created_at, id")
def review_queue(v):
    return candidates.review_queue(_candidates(v)).select("id", "stage2_confidence", "created_at")


@query("SELECT id, title, CASE WHEN id::INT % 6 = 0 THEN 'Kein Text verfügbar' ELSE 'Text von ' || id END AS full_text, leitsatz, tenor, NULL::VARCHAR AS tatbestand, anonymization_applied FROM decisions")
def full_texts(v):
    text = F.when(F.col("id").cast("int") % 6 != 0, F.concat(F.lit("Text von "), "id"))
    rows = candidates.full_text_row(v.decisions.withColumn("full_text_anonymized", text))
    return rows.select("id", "title", "full_text", "sections.leitsatz", "sections.tenor", "sections.tatbestand", "anonymization_applied")


@query("SELECT coalesce(lang, 'unknown') AS language, count(*) AS n FROM (SELECT lang FROM documents ORDER BY doc_id LIMIT 100) GROUP BY 1")
def first_languages(v):
    return candidates.languages(v.documents, key="doc_id", language="lang")


@query(f"SELECT source, count(*) AS n, count(*) FILTER (anonymization_applied) AS anonymised, round(100.0::DOUBLE * count(*) FILTER (anonymization_applied) / count(*), 2) AS rate FROM decisions WHERE created_at >= {_TS} - INTERVAL 300 DAY GROUP BY source")
def compliance_report(v):
    return candidates.compliance_report(v.decisions, AS_OF, 300)


@query("SELECT d.id, e.id AS successor FROM decisions d LEFT JOIN decisions e ON e.id = (d.id::INT + 1)::VARCHAR")
def successor_rows(v):
    return candidates.successors(v.decisions.withColumn("successor_id", (F.col("id").cast("int") + 1).cast("string"))).select("id", "successor")


@query("SELECT id FROM decisions WHERE id = '33' OR court = 'BGH'")
def any_equal(v):
    return candidates.any_equal(v.decisions, id="33", court="BGH").select("id")


@query("SELECT doc_id FROM (SELECT doc_id, contains(lower(text), 'daten') OR contains(lower(text), 'data') AS has FROM documents) ORDER BY has DESC, doc_id LIMIT 60")
def sampled_texts(v):
    return candidates.sampled(v.documents.withColumn("text", F.coalesce("text", F.lit(""))), "text", ["Daten", "data"], 60, "doc_id").select("doc_id")


def _deliveries(v):
    d = v.decisions
    return d, d.filter("source = 'ris'")


@query("""WITH j AS (SELECT id::INT % 10 >= 3 AS relevant, source = 'ris' AS known FROM decisions)
  SELECT count(*) AS processed, count(*) FILTER (NOT relevant) AS irrelevant, count(*) FILTER (relevant AND known) AS existing, count(*) FILTER (relevant AND NOT known) AS imported FROM j""")
def import_counters(v):
    new, old = _deliveries(v)
    return candidates.imported(new, old, F.col("id").cast("int") % 10)[1]


@query("SELECT id FROM decisions WHERE id::INT % 10 >= 3 AND source <> 'ris'")
def imported_rows(v):
    new, old = _deliveries(v)
    return candidates.imported(new, old, F.col("id").cast("int") % 10)[0].select("id")


@query("SELECT id FROM decisions WHERE source = 'ris'")
def present_rows(v):
    new, old = _deliveries(v)
    return duplicates.present(new, old, "source", "source_id").select("id")


@query(r"""WITH w AS (SELECT list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents) SELECT count(*) AS total FROM w WHERE list_contains(w, 'the') OR list_contains(w, 'nicht')""")
def search_total(v):
    return candidates.total(text_index(v).find("the | nicht"))


# --- tokens


def _tokens(v):
    at = F.col("timestamp")
    return v.events.select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, at).alias("used_at"), (at + F.expr("INTERVAL '1' DAY")).alias("expires_at"))


@query("""WITH t AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN timestamp END AS used_at, timestamp + INTERVAL 1 DAY AS expires_at FROM event_log)
  SELECT count(*) AS total, count(*) FILTER (used_at IS NOT NULL) AS used, count(*) FILTER (used_at IS NULL AND expires_at <= TIMESTAMP '2024-01-15') AS expired, count(*) FILTER (used_at IS NULL AND expires_at > TIMESTAMP '2024-01-15') AS active FROM t""")
def token_statistics(v):
    return crawls.token_statistics(_tokens(v), datetime(2024, 1, 15))


@query("""WITH t AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN timestamp END AS used_at, timestamp + INTERVAL 1 DAY AS expires_at FROM event_log)
  SELECT event_id, c_name AS username FROM t JOIN customer ON user_id = c_custkey WHERE used_at IS NULL AND expires_at > TIMESTAMP '2024-01-15' AND c_acctbal > 0""")
def valid_tokens(v):
    users = v.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), (F.col("c_acctbal") > 0).alias("is_active"))
    return crawls.valid_tokens(_tokens(v), users, datetime(2024, 1, 15)).select("event_id", "username")


# --- pages, titles and requests


def _titles(v):
    kinds = F.array(*map(F.lit, ("DPA (Italy) - Fall ", "CJEU - C-", "Regional court - ", "Hauptseite ", "Hinweise zum AG ", "Seite ")))
    return v.documents.select("doc_id", F.concat(F.get(kinds, (F.col("doc_id") % 6).cast("int")), F.col("doc_id").cast("string")).alias("title"))


_TITLES_SQL = "WITH t AS (SELECT doc_id, ['DPA (Italy) - Fall ', 'CJEU - C-', 'Regional court - ', 'Hauptseite ', 'Hinweise zum AG ', 'Seite '][doc_id % 6 + 1] || doc_id AS title FROM documents)"


@query(rf"""{_TITLES_SQL} SELECT doc_id, regexp_matches(title, '{'|'.join([*pages.DECISION_TITLES, rf"\b(?:{'|'.join(pages.DECISION_WORDS)})\b"])}', 'i') AS decision, CASE WHEN contains(lower(title), 'court') THEN 'court_decision' ELSE 'dpa_decision' END AS kind,
  nullif(regexp_extract(title, '^(.+?)\s*\(([^)]+)\)\s*-\s*(.+)$', 2), '') AS country, CASE WHEN len(title) > 12 THEN left(title, 9) || '...' ELSE title END AS short FROM t""")
def title_facts(v):
    title = F.col("title")
    return _titles(v).select("doc_id", pages.is_decision_page(title).alias("decision"), pages.document_type(title).alias("kind"), scalars.title_parts(title)["country"].alias("country"), scalars.shortened(title, 12).alias("short"))


@query(f"SELECT id, CASE WHEN contains(lower(court), 'datenschutz') THEN 'dpa_decision' ELSE 'court_decision' END AS kind, CASE WHEN contains(lower(source), 'gdprhub') THEN 'gdprhub' WHEN contains(lower(source), 'openlegaldata') THEN 'openlegaldata' ELSE 'andere' END AS bucket FROM decisions")
def document_types(v):
    return v.decisions.select("id", pages.document_type_of_court(F.col("court")).alias("kind"), scalars.source_bucket(F.col("source")).alias("bucket"))


@query(r"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Decided on: ' || (doc_id % 28 + 1) || ' May 2020. ' WHEN 1 THEN 'Date of Decision: 01.02.2021 ' ELSE 'am 3-4-2019 ' END || coalesce(text, '') AS text FROM documents)
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN (doc_id % 28 + 1) || ' May 2020' WHEN 1 THEN '01.02.2021' ELSE '3-4-2019' END AS date FROM t""")
def page_dates(v):
    k = F.col("doc_id")
    lead = F.when(k % 3 == 0, F.concat(F.lit("Decided on: "), (k % 28 + 1).cast("string"), F.lit(" May 2020. "))).when(k % 3 == 1, "Date of Decision: 01.02.2021 ").otherwise("am 3-4-2019 ")
    return v.documents.select("doc_id", pages.page_date(F.concat(lead, F.coalesce("text", F.lit("")))).alias("date"))


_KINDS = {"auth": ["/login", "/token"], "search": ["/search"], "export": ["/export"], "admin": ["/admin"]}
_PATHS = ["/api/login", "/api/search?q", "/api/Export/csv", "/api/admin", "/api/x"]


@query(f"""WITH r AS (SELECT event_id, {_PATHS}[event_id % 5 + 1] AS path, CASE event_id % 7 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END AS status, duration_ms FROM event_log),
  k AS (SELECT *, CASE WHEN contains(lower(path), '/login') OR contains(lower(path), '/token') THEN 'auth' WHEN contains(lower(path), '/search') THEN 'search' WHEN contains(lower(path), '/export') THEN 'export' WHEN contains(lower(path), '/admin') THEN 'admin' ELSE 'default' END AS kind FROM r),
  a AS (SELECT *, CASE kind WHEN 'auth' THEN 1000 WHEN 'search' THEN 500 WHEN 'export' THEN 5000 WHEN 'admin' THEN 2000 ELSE 500 END AS allowed FROM k)
  SELECT event_id, kind, CASE WHEN status >= 500 THEN 'high' WHEN status >= 400 THEN 'medium' WHEN duration_ms > 3 * allowed THEN 'high' WHEN duration_ms > 2 * allowed THEN 'medium' WHEN kind IN ('auth', 'search', 'export') THEN 'medium' ELSE 'low' END AS impact FROM a""")
def request_impacts(v):
    path = F.get(F.array(*map(F.lit, _PATHS)), (F.col("event_id") % 5).cast("int"))
    status = F.when(F.col("event_id") % 7 == 0, 500).when(F.col("event_id") % 7 == 1, 404).otherwise(200)
    rows = v.events.select("event_id", "duration_ms", status.alias("status"), pages.endpoint_kind(path, _KINDS).alias("kind"))
    return rows.select("event_id", "kind", pages.request_impact(F.col("status"), F.col("kind"), F.col("duration_ms")).alias("impact"))


@query("""WITH s AS (SELECT event_id, ['SELECT * FROM t WHERE a = ''x'' AND b = 12', ' delete from t where id = 7', 'EXPLAIN q', 'Insert INTO t VALUES (1)'][event_id % 4 + 1] AS q FROM event_log)
  SELECT event_id, left(regexp_replace(regexp_replace(q, '''[^'']*''', '''?''', 'g'), '\\b\\d+\\b', '?', 'g'), 500) AS masked, CASE WHEN starts_with(upper(trim(q)), 'SELECT') THEN 'select' WHEN starts_with(upper(trim(q)), 'DELETE') THEN 'delete' WHEN starts_with(upper(trim(q)), 'INSERT') THEN 'insert' ELSE 'other' END AS kind FROM s""")
def masked_statements(v):
    q = F.get(F.array(*map(F.lit, ("SELECT * FROM t WHERE a = 'x' AND b = 12", " delete from t where id = 7", "EXPLAIN q", "Insert INTO t VALUES (1)"))), (F.col("event_id") % 4).cast("int"))
    return v.events.select("event_id", q.alias("q")).select("event_id", scalars.masked_sql(F.col("q")).alias("masked"), scalars.sql_kind(F.col("q")).alias("kind"))


@query("""WITH s AS (SELECT event_id, ['2020-05-01T10:00:00+02:00', '13.07.2021', '2019-12-31', 'unbekannt'][event_id % 4 + 1] AS d FROM event_log)
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2020-05-01 10:00:00' WHEN 1 THEN TIMESTAMP '2021-07-13' WHEN 2 THEN TIMESTAMP '2019-12-31' END AS at, CASE event_id % 4 WHEN 1 THEN TIMESTAMP '2021-07-13' WHEN 2 THEN TIMESTAMP '2019-12-31' END AS first FROM s""")
def parsed_dates(v):
    d = F.get(F.array(*map(F.lit, ("2020-05-01T10:00:00+02:00", "13.07.2021", "2019-12-31", "unbekannt"))), (F.col("event_id") % 4).cast("int"))
    return v.events.select("event_id", d.alias("d")).select("event_id", scalars.parsed_date(F.col("d")).alias("at"), derived.first_date(F.lit("x"), F.col("d")).alias("first"))


# --- texts


_NAMES = "Herr Anton Berg und Frau Eva Tal klagen gegen die Haus Werke GmbH. "


@query("""SELECT doc_id, u.p AS placeholder, sha256(u.n) AS hash, u.k AS kind FROM documents, (VALUES ('[Person 1]', 'Herr Anton Berg', 'PERSON'), ('[Person 2]', 'Frau Eva Tal', 'PERSON'), ('[Organisation 1]', 'Haus Werke GmbH', 'ORGANIZATION')) u(p, n, k)""")
def mapped_names(v):
    """A row for each numbered name of the documents, behind a sentence with three."""
    named = v.documents.select("doc_id", anonymise.anonymised(F.concat(F.lit(_NAMES), F.coalesce("text", F.lit("")))).alias("a"))
    return anonymise.mapping_rows(named, "doc_id", "a")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN NULL ELSE greatest(0, least(100, 100 - 5 * (" + " + ".join(f"len(regexp_extract_all(text, '{p}', 0, 'i'))" for p in anonymise.LEFT_OVER) + ") + 2 * (" + " + ".join(f"contains(text, '{t}')::INT" for t in anonymise.KEPT_TERMS) + "))) END AS quality FROM documents WHERE text IS NOT NULL")
def anonymisation_quality(v):
    """Null for texts with letters beyond ASCII, of which SQL's patterns take word ends otherwise."""
    return v.documents.filter("text IS NOT NULL").select("doc_id", F.when(~F.col("text").rlike("[^\\x00-\\x7F]"), anonymise.quality(F.col("text"))).alias("quality"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['Art. ' || (doc_id % 9 + 1) || ' DSGVO', 'DSG Art. ' || (doc_id % 40 + 1)] WHEN 1 THEN ['Art. ' || (doc_id % 9 + 1) || ' DSGVO'] ELSE ['DSG Art. 4'] END::VARCHAR AS refs FROM documents""")
def swiss_references(v):
    k, s = F.col("doc_id"), (lambda c: c.cast("string"))
    text = F.when(k % 3 == 0, F.concat(F.lit("Nach Art. "), s(k % 40 + 1), F.lit(" DSG und Art. "), s(k % 9 + 1), F.lit(" DSGVO"))).when(k % 3 == 1, F.concat(F.lit("Art. "), s(k % 9 + 1), F.lit(" DSGVO"))).otherwise("Art. 4 LPD")
    return v.documents.select("doc_id", F.concat(F.lit("["), F.array_join(swiss.references(text), ", "), F.lit("]")).alias("refs"))


_ROMAN_SQL = r"(?:^|\n)[ \t]*(?:I{1,3}|IV|V|VI{0,3}|IX|X)\.\s*[A-Z]"


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^[:\s]+|\s+$', '', 'g'), '\n{3,}', '\n\n', 'g'), '\n\s*-\s*\d+\s*-\s*\n', '\n', 'g') AS b FROM legal_docs WHERE NOT regexp_matches(text, '(^|\n)\s*(Tenor|Tatbestand|Sachverhalt|Kostenentscheidung|Rechtsmittelbelehrung|Unterschriften|[IVXB]+\.)', 'i'))
  SELECT doc_id, 'Ein Leitsatz über Einwilligung und Daten.' AS leitsatz, 'Die Klage wird abgewiesen, Kosten trägt jeder.' AS tenor, CASE WHEN len(b) > 5000 THEN left(b, 4997) || '...' WHEN len(b) >= 20 THEN b END AS reasons FROM t""".replace(r"'\n\n'", "chr(10) || chr(10)").replace(r"'\n'", "chr(10)"))
def reasons_of_texts(v):
    """Sections of the texts that hold no heading of their own."""
    text = F.concat(F.lit("Leitsatz:\nEin Leitsatz über Einwilligung und Daten.\nTenor:\nDie Klage wird abgewiesen, Kosten trägt jeder.\nGründe:\n"), "text")
    plain = v.legal_docs.filter(~F.col("text").rlike(r"(?i)(^|\n)\s*(Tenor|Tatbestand|Sachverhalt|Kostenentscheidung|Rechtsmittelbelehrung|Unterschriften|[IVXB]+\.)"))
    return plain.select("doc_id", sections.sections(text).alias("s")).select("doc_id", "s.leitsatz", "s.tenor", F.col("s.entscheidungsgruende").alias("reasons"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'rechtskraeftig' ELSE 'unbekannt' END AS status, doc_id % 2 = 0 AS relevant FROM documents")
def finality_states(v):
    text = F.when(F.col("doc_id") % 3 == 0, "Das Urteil ist rechtskräftig.").otherwise("Das Urteil ist da.")
    articles = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Art. 6 DSGVO")))
    return v.documents.select("doc_id", scalars.finality(text).alias("status"), derived.relevant(articles, F.lit("nichts")).alias("relevant"))


@query("""SELECT event_id, ['path_traversal', NULL][event_id % 2 + 1] AS attack, CASE WHEN event_id % 5 IN (1, 3) THEN 'authentication_failure' WHEN event_id % 5 = 2 THEN 'rate_limit_exceeded' END AS kind FROM event_log""")
def security_events(v):
    path = F.when(F.col("event_id") % 2 == 0, "/x/../y").otherwise("/ok")
    status = F.get(F.array(*map(F.lit, (200, 401, 429, 403, 500))), (F.col("event_id") % 5).cast("int"))
    return v.events.select("event_id", derived.attack(path).alias("attack"), derived.security_event(status).alias("kind"))


@query("SELECT event_id, CASE WHEN cpu_percent > 90 THEN 'critical' WHEN cpu_percent > 70 THEN 'warning' ELSE 'healthy' END AS cpu FROM event_log")
def cpu_states(v):
    return v.events.select("event_id", scalars.resource_status(F.col("cpu_percent"), 70, 90).alias("cpu"))


@query(f"{RANKED_SQL} SELECT doc_id, round(relevance, 6) AS relevance FROM r")
def search_relevance(v):
    return text_index(v).find("the & was").withColumn("relevance", F.round("relevance", 6))


@query(f"{RANKED_SQL} SELECT count(*) AS matches, round(avg(relevance), 6) AS mean_relevance FROM r")
def search_probe(v):
    return index.probe(text_index(v), "the & was")


_TAGS_SQL = "text"
for _pattern, _tag in [*anonymise.TAGS, anonymise.ADDRESS]:
    _TAGS_SQL = f"regexp_replace({_TAGS_SQL}, '{_pattern}', '{_tag}', 'g')"


@query(f"SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[^\\x00-\\x7F]') THEN {_TAGS_SQL} END AS text FROM documents")
def tagged_texts(v):
    """Null for texts with letters beyond ASCII, of which SQL's patterns take word ends otherwise."""
    text = F.regexp_replace(anonymise.tagged(F.col("text")), f"(?U){anonymise.ADDRESS[0]}", anonymise.ADDRESS[1])
    return v.documents.select("doc_id", F.when(~F.col("text").rlike("[^\\x00-\\x7F]"), text).alias("text"))
