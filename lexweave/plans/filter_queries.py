"""Queries of the two-stage filter, metric issues, tasks and quality, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import anonymise, derived, html, legal, pages, scalars
from lexweave.operators import candidates, event_stats, stats
from lexweave.plans.queries import query, weights_sql

# --- the two-stage filter


def _any_sql(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}', 'i')" for p in patterns) + ")"


def _against_sql(pattern: str) -> str:
    """A word that nothing of the terms follows in its line: SQL's patterns look at what stands behind the last one of a line."""
    head, terms = pattern[:-1].split("(?!.*?")
    return f"len(list_filter(string_split(content, chr(10)), lambda l: regexp_matches(l, '{head}', 'i') AND NOT regexp_matches(regexp_extract(l, '.*{head}(.*)', 1, 'i'), '{terms}', 'i'))) > 0"


_HITS = ", ".join(f"left(regexp_extract(whole, '({p})', 1, 'i'), 50)" for _, patterns in legal.STAGE1 for p in patterns)
_NEAR = " OR ".join(f"contains(substring(low, greatest(0, strpos(low, lower(k)) - 201) + 1, strpos(low, lower(k)) - 1 + length(k) + 200 - greatest(0, strpos(low, lower(k)) - 201)), '{t}')" for t in legal.CONTEXT_TERMS)
_CONTEXT = " + ".join([f"CASE WHEN {_any_sql('content', p)} THEN 20 ELSE 0 END" for p in legal.CONTEXT] + [f"CASE WHEN {_against_sql(p)} THEN -10 ELSE 0 END" for p in legal.AGAINST])
_TENOR = r"lower(regexp_extract(content, '<h[1-4]>.*?Tenor.*?</h[1-4]>(.*?)(?:<h[1-4]>|$)', 1, 'is'))"
_STRUCTURE = f"""CASE WHEN regexp_matches(content, '<h[1-4]>.*?Tenor.*?</h[1-4]>', 'i') AND ({' OR '.join(f"contains({_TENOR}, '{t}')" for t in legal.TENOR_TERMS)}) THEN 40 ELSE 0 END
  + CASE WHEN regexp_matches(content, 'Leitsatz|Orientierungssatz', 'i') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(content, '<h[1-4]>.*?(?:Gründe|Entscheidungsgründe).*?</h[1-4]>', 'i') THEN 10 ELSE 0 END
  + CASE WHEN regexp_matches(content, 'Rechtsmittel|Revision|Berufung|Beschwerde', 'i') THEN 5 ELSE 0 END"""


def _two_stage_sql(content: str = "text", config: legal.FilterConfig = legal.FilterConfig()) -> str:
    """CTEs of which f has all scores, the status and the reason."""
    return f"""WITH s AS (SELECT doc_id, coalesce(source, '') AS title, coalesce({content}, '') AS content, coalesce(source, '') || ' ' || coalesce({content}, '') || ' VG Wiesbaden' AS whole FROM legal_docs),
  h AS (SELECT *, {weights_sql(legal.STAGE1, 'whole')} AS stage1_score, [{_HITS}] AS hits, lower(content) AS low FROM s),
  w AS (SELECT *, list_filter(hits, lambda x, i: x <> '' AND list_position(hits, x) = i)[1:5] AS words FROM h),
  c AS (SELECT *, stage1_score >= {config.least_stage1} AS passed, least(100.0::DOUBLE, {_CONTEXT} + 5 * len(list_filter(words, lambda k: strpos(low, lower(k)) > 0 AND ({_NEAR})))) AS ctx, ({_STRUCTURE})::DOUBLE AS str,
    (20 + 10 + CASE WHEN regexp_matches(lower(title), 'datenschutz|dsgvo|gdpr|personenbezogen') THEN 20 ELSE 0 END)::DOUBLE AS meta FROM w),
  p AS (SELECT *, CASE WHEN passed THEN least(100.0::DOUBLE, stage1_score::DOUBLE / 50 * 100 * 0.2::DOUBLE + ctx * 0.4::DOUBLE + str * 0.2::DOUBLE + meta * 0.2::DOUBLE) ELSE 0 END AS confidence FROM c),
  q AS (SELECT *, CASE WHEN NOT passed THEN 'rejected' WHEN confidence >= {config.approved_from} THEN 'approved' WHEN confidence >= {config.review_from} THEN 'review_required' ELSE 'rejected' END AS status FROM p),
  f AS (SELECT doc_id, stage1_score, CASE WHEN passed THEN ctx END AS context_score, CASE WHEN passed THEN str END AS structure_score, CASE WHEN passed THEN meta END AS metadata_score, confidence, status,
    CASE WHEN NOT passed THEN 'Stage 1 Score zu niedrig: ' || stage1_score WHEN status = 'rejected' THEN 'Confidence zu niedrig: ' || format('{{:.1f}}', confidence) || '%' END AS rejection_reason FROM q)"""


#: Thresholds that let texts of the tables reach all states.
_LOW = legal.FilterConfig(approved_from=35.0, review_from=25.0)


def _stored(v, content=None):
    return v.legal_docs.select(
        "doc_id", F.col("source").alias("title"), (F.col("text") if content is None else content).alias("content"), F.lit("VG Wiesbaden").alias("court"),
        F.lit("6 K 1/19").alias("case_number"), F.lit("2019-01-01").cast("timestamp_ntz").alias("decision_date"),
    )


_HEADED_SQL = "CASE WHEN doc_id % 2 = 0 THEN '<h2>Tenor</h2> Der Datenschutz <h3>Gründe</h3> ' || text ELSE text END"


@query(f"{_two_stage_sql()} SELECT doc_id, stage1_score, context_score, structure_score, metadata_score, confidence, status FROM f")
def two_stage_filter(v):
    return legal.two_stage(_stored(v)).select("doc_id", "stage1_score", "context_score", "structure_score", "metadata_score", "confidence", "status")


@query(f"{_two_stage_sql(_HEADED_SQL, _LOW)} SELECT doc_id, structure_score, round(confidence, 6) AS confidence, status, rejection_reason FROM f")
def judged_texts(v):
    """States and reasons, with headings in every other text and low thresholds."""
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<h2>Tenor</h2> Der Datenschutz <h3>Gründe</h3> "), "text")).otherwise(F.col("text"))
    return legal.two_stage(_stored(v, content), _LOW).select("doc_id", "structure_score", F.round("confidence", 6).alias("confidence"), "status", "rejection_reason")


@query(f"{_two_stage_sql()} SELECT round(100.0::DOUBLE * count(*) FILTER (stage1_score >= 2) / greatest(count(*), 1), 2) AS stage1_rate, round(100.0::DOUBLE * count(*) FILTER (status = 'approved') / greatest(count(*) FILTER (stage1_score >= 2), 1), 2) AS approval_rate, round(100.0::DOUBLE * count(*) FILTER (status = 'approved') / greatest(count(*), 1), 2) AS overall_rate, count(*) FILTER (status = 'review_required') AS review FROM f")
def filter_pass_rates(v):
    return legal.pass_rates(legal.two_stage(_stored(v)))


def _reevaluated(v, config):
    stored = _stored(v).select(F.col("doc_id").alias("id"), "title", "content", "court", "case_number", "decision_date", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 50 as int))").alias("created_at"))
    known = v.documents.filter("lang = 'de'").select(F.col("doc_id").alias("id"), F.lit(0).alias("stage1_score"), F.lit(0.0).alias("stage2_confidence"), F.lit(legal.REJECTED).alias("status"), F.lit("2023-01-01").cast("timestamp_ntz").alias("created_at"))
    return candidates.reevaluated(stored, known, config)


@query(f"{_two_stage_sql()} SELECT doc_id AS id, stage1_score, confidence, status FROM f")
def reevaluated(v):
    """The two-stage filter over all texts, upserted into candidates of which half are known."""
    return _reevaluated(v, legal.FilterConfig()).select("id", "stage1_score", F.col("stage2_confidence").alias("confidence"), "status")


@query(f"{_two_stage_sql('text', _LOW)} SELECT f.doc_id AS id, round(confidence, 6) AS confidence, CASE WHEN lang = 'de' THEN TIMESTAMP '2023-01-01' ELSE TIMESTAMP '2024-01-01' + to_days((f.doc_id % 50)::INT) END AS created_at FROM f JOIN documents d USING (doc_id) WHERE status = 'review_required'")
def reevaluated_queue(v):
    """What stands in the review queue after all texts were judged again; known candidates keep the time at which they came."""
    return candidates.review_queue(_reevaluated(v, _LOW)).select("id", F.round("stage2_confidence", 6).alias("confidence"), "created_at")


# --- events, tasks and states


@query("""WITH b AS (SELECT event_id, duration_ms, memory_mb, cpu_percent, avg(duration_ms) OVER w AS mean, stddev_samp(duration_ms) OVER w AS dev, count(duration_ms) OVER w AS seen FROM event_log
    WINDOW w AS (PARTITION BY component, operation ORDER BY timestamp, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
  i AS (SELECT event_id, CASE WHEN duration_ms > 5000 THEN 'critical_duration' WHEN duration_ms > 1000 THEN 'slow_duration' WHEN seen >= 10 AND mean <> 0 AND duration_ms > mean + 2 * dev THEN 'duration_anomaly' END AS d,
    CASE WHEN memory_mb > 500 THEN 'high_memory' END AS m, CASE WHEN cpu_percent > 80 THEN 'high_cpu' END AS c FROM b)
  SELECT event_id, array_to_string(list_filter([d, m, c], lambda x: x IS NOT NULL), '|') AS issues, CASE WHEN d = 'critical_duration' THEN 'critical' WHEN d IS NOT NULL OR m IS NOT NULL OR c IS NOT NULL THEN 'medium' ELSE 'info' END AS priority FROM i""")
def metric_issues(v):
    """What is wrong with each measurement, seen against its baseline, and how urgent that is."""
    return event_stats.metric_issues(v.events).select("event_id", F.array_join("issues", "|").alias("issues"), "priority")


@query("""WITH e AS (SELECT coalesce(error_type, 'Unknown') AS t, count(*) AS n FROM event_log WHERE category = 'error' OR priority IN ('high', 'critical') GROUP BY 1), s AS (SELECT sum(n)::BIGINT AS n FROM e), m AS (SELECT t, n FROM e ORDER BY n DESC, t LIMIT 1)
  SELECT CASE WHEN n > 100 THEN 'high error rate' ELSE 'elevated error rate' END AS insight, NULL AS error_type, n FROM s WHERE n > 50 UNION ALL SELECT 'most common error', t, n FROM m WHERE n > 10""")
def error_insights(v):
    return event_stats.error_insights(v.events)


_TASKS = ["tasks.crawl_all", "tasks.parse_texts", "tasks.export_csv", "tasks.backup_db", "tasks.notify_admins", "tasks.other"]


@query(f"""WITH t AS (SELECT event_id, component || ' ' || {_TASKS}[event_id % 6 + 1] AS task, CASE WHEN priority = 'critical' THEN 'FAILURE' ELSE 'SUCCESS' END AS state, duration_ms / 300 AS minutes FROM event_log),
  k AS (SELECT *, CASE {' '.join(f"WHEN {' OR '.join(f"contains(lower(task), '{w}')" for w in words)} THEN '{k}'" for k, words in pages.TASK_WORDS.items())} ELSE 'default' END AS kind FROM t),
  a AS (SELECT *, CASE kind {' '.join(f"WHEN '{k}' THEN {a}" for k, (a, _) in pages.TASK_MINUTES.items())} END AS most, CASE kind {' '.join(f"WHEN '{k}' THEN {b}" for k, (_, b) in pages.TASK_MINUTES.items())} END AS worst FROM k)
  SELECT event_id, kind, CASE WHEN state = 'FAILURE' THEN CASE WHEN kind IN ('crawler', 'processing') THEN 'high' ELSE 'medium' END WHEN minutes > worst THEN 'high' WHEN minutes > most THEN 'medium' WHEN kind IN ('crawler', 'processing') THEN 'high' WHEN kind = 'maintenance' THEN 'low' WHEN kind IN ('export', 'notification') THEN 'medium' ELSE 'low' END AS impact FROM a""")
def task_impacts(v):
    task = F.concat("component", F.lit(" "), F.get(F.array(*map(F.lit, _TASKS)), (F.col("event_id") % 6).cast("int")))
    state = F.when(F.col("priority") == "critical", "FAILURE").otherwise("SUCCESS")
    rows = v.events.select("event_id", pages.task_kind(task).alias("kind"), state.alias("state"), (F.col("duration_ms") / 300).alias("minutes"))
    return rows.select("event_id", "kind", pages.task_impact(F.col("kind"), F.col("state"), F.col("minutes")).alias("impact"))


@query("""WITH s AS (SELECT event_id, CASE WHEN cpu_percent > 90 THEN 'critical' WHEN cpu_percent > 70 THEN 'warning' ELSE 'healthy' END AS cpu, CASE WHEN memory_mb > 900 THEN 'critical' WHEN memory_mb > 600 THEN 'warning' ELSE 'healthy' END AS memory FROM event_log)
  SELECT event_id, CASE WHEN 'critical' IN (cpu, memory) THEN 'unhealthy' WHEN 'warning' IN (cpu, memory) THEN 'degraded' ELSE 'healthy' END AS status FROM s""")
def overall_states(v):
    cpu, memory = scalars.resource_status(F.col("cpu_percent"), 70, 90), scalars.resource_status(F.col("memory_mb"), 600, 900)
    return v.events.select("event_id", scalars.overall_status(cpu, memory).alias("status"))


# --- quality


@query("""SELECT count(*) AS total, round(avg(length(text)), 4) AS mean_length, round(100.0::DOUBLE * (count(source) + count(lang)) / (2 * count(*)), 2) AS metadata_completeness,
  round(avg(greatest(0, least(100, 100 - 5 * (""" + " + ".join(f"len(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'), '{p}', 0, 'i'))" for p in anonymise.LEFT_OVER) + ") + 2 * (" + " + ".join(f"contains(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'), '{t}')::INT" for t in anonymise.KEPT_TERMS) + ")))), 4) AS mean_score FROM documents")
def quality_metrics(v):
    """Lengths, completeness and the mean anonymisation score, of texts with other letters as x so that SQL's word ends are the same."""
    return stats.quality_metrics(v.documents, "text", ["source", "lang"], anonymise.quality(F.regexp_replace("text", r"[^\x00-\x7F]", "x")))


# --- functions over whole columns


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}', 'i') THEN '{name}'" for name, p in scalars.FINALITY) + " ELSE 'unbekannt' END AS status, coalesce(" + " OR ".join(f"contains(lower(text), '{t}')" for t in derived.RELEVANT_TERMS) + ", FALSE) AS relevant FROM legal_docs")
def finality_of_texts(v):
    return v.legal_docs.select("doc_id", scalars.finality(F.col("text")).alias("status"), derived.relevant(F.lit(None).cast("array<string>"), F.col("text")).alias("relevant"))


@query("SELECT page_id, " + "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(html), '{s}')" for s in signs)} THEN '{k}'" for k, signs in derived.ATTACKS) + " END AS attack FROM pages")
def attacks_in_pages(v):
    return v.table("pages").select("page_id", derived.attack(F.col("html")).alias("attack"))


@query(r"""SELECT doc_id, left(regexp_replace(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '''[^'']*''', '''?''', 'g'), '\b\d+\b', '?', 'g'), 500) AS masked, CASE WHEN len(text) > 50 THEN left(text, 47) || '...' ELSE text END AS short FROM documents""")
def masked_texts(v):
    """Literals masked in whole texts, other letters as x so that SQL's word ends are the same; and texts for display."""
    return v.documents.select("doc_id", scalars.masked_sql(F.regexp_replace("text", r"[^\x00-\x7F]", "x")).alias("masked"), scalars.shortened(F.col("text"), 50).alias("short"))


@query("SELECT id, decision_date AS plain, decision_date AS with_zone, date_trunc('day', decision_date) AS dotted FROM decisions")
def dates_of_texts(v):
    """Dates written in three forms and read again."""
    d = F.col("decision_date")
    forms = F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")), F.date_format(d, "dd.MM.yyyy")
    return v.decisions.select("id", scalars.parsed_date(forms[0]).alias("plain"), scalars.parsed_date(forms[1]).alias("with_zone"), derived.first_date(F.lit("x"), forms[2]).alias("dotted"))


@query("""SELECT id, court AS authority, source AS country, case_number AS "case" FROM decisions""")
def parts_of_titles(v):
    made = F.concat("court", F.lit(" ("), "source", F.lit(") - "), "case_number")
    return v.decisions.select("id", "court", "source", "case_number", scalars.title_parts(made).alias("p")).select("id", F.col("p.authority"), F.coalesce("p.country", "source").alias("country"), F.coalesce("p.case", "case_number").alias("case"))


# --- pages


def _replaced_sql(text: str, pairs: list[tuple[str, str]], plain: bool = True) -> str:
    for a, b in pairs:
        a, b = a.replace("'", "''"), b.replace("'", "''")
        text = f"replace({text}, '{a}', '{b}')" if plain else f"regexp_replace({text}, '{a}', '{b}', 'g')"
    return text


_BARE_SQL = _replaced_sql("coalesce(html, '')", [(p, "") for p in html.NO_TEXT], plain=False)
_ENTITY_PAIRS = list(html.ENTITIES.items())


@query(rf"""WITH p AS (SELECT page_id, list_filter(list_transform(string_split_regex({_BARE_SQL}, '{html.TAG}'), lambda x: regexp_replace({_replaced_sql('x', _ENTITY_PAIRS)}, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS w FROM pages)
  SELECT page_id, regexp_replace(regexp_replace(array_to_string(w, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)^\[\d+\]', '', 'g') AS text FROM p""")
def page_texts(v):
    return v.table("pages").select("page_id", html.main_text(F.col("html")).alias("text"))


_LINK_SQL = html.LINK.replace("'", "''")


@query(rf"""WITH l AS (SELECT page_id, unnest(regexp_extract_all({_BARE_SQL}, '{_LINK_SQL}')) AS a FROM pages),
  t AS (SELECT page_id, regexp_replace({_replaced_sql("regexp_replace(regexp_extract(a, '(?is)^<a[^>]*>(.*)</a>$', 1), '<[^>]*>', '', 'g')", _ENTITY_PAIRS)}, '^\s+|\s+$', '', 'g') AS title FROM l)
  SELECT page_id, title, count(*) AS n FROM t GROUP BY page_id, title""")
def page_links(v):
    """The links of each page by their titles."""
    found = v.table("pages").select("page_id", F.explode(html.links(F.col("html"))).alias("l"))
    return found.groupBy("page_id", F.col("l.title").alias("title")).agg(F.count("*").alias("n"))
