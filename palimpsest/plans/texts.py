"""Queries over archives and documents as text files, over process documents and
signals, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import documents, health, ingest, search, signals
from ..session import spread, table
from .conversations import _strip

PHRASE = "next step"
WORDS = "quota ledger"


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Archives that were written, under the names their numbers give them."""
    return table(spark, d, "archive_result").where("log_number > 0").select(
        F.format_string("conversation-%03d.md", "log_number").alias("file"), F.col("full_content").alias("text")
    )


def _docs(spark: SparkSession, d: str, *sources: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return (rows.where(F.col("source").isin(*sources)) if sources else rows).select(F.col("doc_id").alias("file"), "source", "text")


def line_search(spark, d):
    return search.line_search(_files(spark, d), PHRASE)


def line_search_context(spark, d):
    return search.line_search_context(_files(spark, d), PHRASE, 2)


def highlighted(spark, d):
    hits = search.line_search(_files(spark, d), PHRASE)
    return hits.select("file", "line_num", text.highlight(F.col("line"), PHRASE, "<b>", "</b>").alias("line"))


def ranked_search(spark, d):
    rows = search.ranked_search(_files(spark, d), WORDS, 10)
    return rows.select("file", "match_count", F.round("score", 6).alias("score"), F.array_join("previews", "\n").alias("previews"))


def ranked_search_phrase(spark, d):
    return search.ranked_search_phrase(_files(spark, d), PHRASE, 10).select("file", F.round("score", 6).alias("score"))


def near_duplicate_lines(spark, d):
    return health.repeated_lines(_docs(spark, d), "file", "text")


def section_sizes(spark, d):
    return health.section_sizes(_docs(spark, d), "file", "text")


def largest_sections(spark, d):
    return health.largest_sections(health.section_sizes(_docs(spark, d), "file", "text"))


def empty_sections(spark, d):
    return health.empty_sections(_docs(spark, d), "file", "text").select("file", "section")


def stale_dates(spark, d):
    return health.stale_lines(_files(spark, d), "file", "text", "2020-04")


def memory_health(spark, d):
    return health.memory_health(_docs(spark, d), "file", "text", most_lines=20)


def store_health(spark, d):
    stats = health.archive_stats(table(spark, d, "archive_result").where("log_number > 0"), "full_content", "archived_at")
    lines = health.memory_health(_docs(spark, d), "file", "text").agg(F.max("lines").alias("lines"))
    both = stats.withColumn("one", F.lit(1)).join(lines.withColumn("one", F.lit(1)), "one")
    as_of = F.lit("2020-02-20 12:00:00").cast("timestamp_ntz")
    return both.select("archives", "bytes", "oldest", "newest", text.format_bytes(F.col("bytes")).alias("size"),
                       health.assess(F.col("lines"), F.col("archives"), F.col("newest"), as_of).alias("level"))


def distill_plan(spark, d):
    return health.distill(_docs(spark, d), "file", "text", most_lines=30, long_section=10)


def normalize_titles(spark, d):
    return table(spark, d, "entity").select("entity_id", text.normalize_key(F.col("name")).alias("key"), text.slug(F.col("name")).alias("slug"))


def document_sections(spark, d):
    return documents.sections(_docs(spark, d), "file", "text").select("file", "section_no", "title", F.md5(F.col("section")).alias("section_md5"))


# The documents of the test tables have no process headings of their own, so theirs are given by their numbers.
_HEADS = {
    "learning": ("Active Threads",), "thoughts": ("Active", "Graduated", "Dissolved"), "curiosity": ("Open Questions", "Themes", "Explored"),
    "reflections": ("Observations", "Patterns"), "praxis": ("Active", "Phronesis", "Retired"),
}
_STATES = {
    "learning": (("active", None),), "thoughts": (("active", None), ("graduated", None), ("dissolved", None)), "curiosity": (("active", None), ("active", "theme"), ("explored", None)),
    "reflections": (("active", None), ("active", "pattern")), "praxis": (("active", None), ("active", "phronesis"), ("retired", None)),
}


def _process(spark, d) -> DataFrame:
    rows = spread(_docs(spark, d, *_HEADS).where("text is not null"))
    pick = lambda heads: F.element_at(F.array(*(F.lit(h) for h in heads)), (F.col("file") % len(heads) + 1).cast("int"))
    head = F.coalesce(*(F.when(F.col("source") == k, pick(v)) for k, v in _HEADS.items()))
    inner = F.regexp_replace(F.regexp_replace("text", r"\r\n", "\n"), r"(?m)^##? ", "### ")
    inner = F.replace(inner, F.lit("**Connected to**:"), F.lit("Connected to:"))
    return rows.select("file", "source", F.concat(F.lit("## "), head, F.lit("\n\n"), inner).alias("text"))


def pipeline_parse(spark, d):
    parsed = documents.parse(_process(spark, d), "file", "source", "text")
    return parsed.select(
        "file", "entry_no", "stage", "status", "sub_type", "entity_type", "title", F.md5(F.col("body")).alias("body_md5"), F.array_join("connected", "|").alias("connected"),
        F.coalesce("source_ref", F.lit("")).alias("source_ref"), F.coalesce("destination", F.lit("")).alias("destination"), F.coalesce("date", F.lit("")).alias("date"),
    )


def pipeline_entities(spark, d):
    parsed = documents.parse(_process(spark, d), "file", "source", "text")
    return documents.as_entities(parsed).select("name", "entity_type", "abstract_text", "source")


def pipeline_relationships(spark, d):
    parsed = documents.parse(_process(spark, d), "file", "source", "text")
    return documents.infer_relationships(parsed, F.struct("file", "section_no", "entry_no")).distinct()


def pipeline_diff(spark, d):
    parsed = documents.parse(_process(spark, d), "file", "source", "text")
    return documents.report(documents.diff(parsed, table(spark, d, "entity")))


def signal_sync(spark, d):
    """Events of a day as signal vectors; what the first half of the days measured is known."""
    events = table(spark, d, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    vectors = events.groupBy(day.alias("timestamp")).agg(
        F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("vocabulary_diversity"), F.lit(None).cast("double").alias("question_generation"),
        F.count_if(F.col("event_type") == "click").cast("double").alias("thought_lifecycle"), F.lit(None).cast("double").alias("evidence_grounding"),
    ).withColumn("trigger", F.lit("daily"))
    known = vectors.where("timestamp < '2024-01-15'").select("timestamp")
    return signals.new_signals(vectors, known).select(
        "timestamp", F.col("thought_lifecycle").cast("long").alias("clicks"), signals.signal_abstract().alias("abstract_text")
    )


def outcome_sync(spark, d):
    events = table(spark, d, "events")
    rows = events.select(
        F.col("event_id").cast("string").alias("task_id"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), F.col("event_type").alias("domain"),
        F.when(F.col("event_type") == "purchase", "success").otherwise("partial").alias("outcome"),
    )
    known = rows.where("timestamp < '2024-01-15'").select("task_id", "timestamp")
    named = table(spark, d, "entity").withColumn("name", F.when(F.col("entity_type") == "tool", F.lit("click")).otherwise(F.col("name")))
    return signals.outcome_links(signals.new_outcomes(rows, known), named).select("task_id", "entity_id", "description")


def local_entity_merge(spark, d):
    rows = table(spark, d, "entity").select(
        F.element_at(F.split("name", r"[_ -]"), 1).alias("name"), "entity_type", F.coalesce("abstract_text", F.lit("")).alias("abstract_text"), "overview",
        F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("attributes"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"),
    ).where("name != ''")
    merged = ingest.local_merge(rows.groupBy("name", "at").agg(*(F.min(c).alias(c) for c in ("entity_type", "abstract_text", "overview", "content", "attributes"))), ["at"])
    return merged.select("key", "name", "entity_type", "abstract_text", F.md5(F.coalesce("overview", F.lit(""))).alias("overview_md5"))


def display_forms(spark, d):
    rows = table(spark, d, "archive_result").where("full_content is not null")
    n = F.octet_length("full_content").cast("long")
    return rows.select("archive_id", text.format_bytes(n).alias("size"), text.format_tokens(n * 37).alias("tokens"), text.progress_bar(F.least(F.lit(100), F.floor(n / 100))).alias("bar"))


def truncated(spark, d):
    rows = table(spark, d, "archive_result").where("full_content is not null")
    return rows.select("archive_id", F.octet_length(text.cut_bytes(F.col("full_content"), 1999)).alias("bytes"), F.length(text.cut_bytes(F.col("full_content"), 1999)).alias("chars"))


_F = "files AS (SELECT 'conversation-' || CASE WHEN log_number < 1000 THEN lpad(CAST(log_number AS VARCHAR), 3, '0') ELSE CAST(log_number AS VARCHAR) END || '.md' AS file, full_content AS text FROM archive_result WHERE log_number > 0)"
_SPLIT = "regexp_split_to_array(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n')"


def _lines(source: str) -> str:
    return f"lines AS (SELECT file, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_num FROM (SELECT file, {_SPLIT} AS l FROM {source} WHERE text IS NOT NULL AND text <> ''))"


def _key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


_PROCESS = (
    "process AS (SELECT doc_id AS file, source, '## ' || CASE source "
    + " ".join(f"WHEN '{k}' THEN {list(v)}[doc_id % {len(v)} + 1]" for k, v in _HEADS.items())
    + " END || E'\\n\\n' || replace(regexp_replace(replace(text, E'\\r\\n', E'\\n'), '(?m)^##? ', '### ', 'g'), '**Connected to**:', 'Connected to:') AS text FROM documents WHERE text IS NOT NULL AND source IN ("
    + ", ".join(f"'{k}'" for k in _HEADS)
    + "))"
)
_ENTRY = f"""parts AS (
  SELECT file, source, list_filter(string_split(replace(E'\\n' || text, E'\\n### ', chr(1) || '### '), chr(1)), lambda p: starts_with(p, '### ')) AS l FROM process
), each AS (
  SELECT file, source, unnest(l) AS p, generate_subscripts(l, 1) AS k FROM parts
), raw AS (
  SELECT file, source, k, trim(regexp_extract(p, '^### ([^\\n]*)', 1)) AS title, {_strip("regexp_replace(p, '^### [^\\n]*', '')")} AS body FROM each
), entry AS (
  SELECT file, source AS stage, CAST(row_number() OVER (PARTITION BY file ORDER BY k) AS INTEGER) AS entry_no, body, title AS raw_title,
    CASE source WHEN 'thoughts' THEN trim(regexp_replace(replace(title, '~~', ''), '→.*$', ''))
      WHEN 'learning' THEN CASE WHEN regexp_matches(title, '\\([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\)\\s*$') THEN trim(regexp_replace(title, '\\([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\)\\s*$', '')) ELSE title END
      ELSE title END AS title,
    CASE source WHEN 'learning' THEN 'thread' WHEN 'thoughts' THEN 'thought' WHEN 'curiosity' THEN 'question' WHEN 'reflections' THEN 'observation' ELSE 'policy' END AS entity_type,
    list_filter(list_transform(flatten(list_transform(regexp_extract_all(body, '(?i)connected to:([^\\n]*)', 1), lambda x: string_split(x, ','))),
      lambda p: trim(regexp_replace(trim(p), '^(and )+', ''))), lambda p: p <> '') AS connected
  FROM raw WHERE title <> ''
)"""
_OF = lambda part: "CASE stage " + " ".join(
    f"WHEN '{k}' THEN [{', '.join('NULL' if x[part] is None else repr(x[part]) for x in v)}][file % {len(v)} + 1]" for k, v in _STATES.items()
) + " END"
_FIELD = lambda name: rf"nullif(regexp_extract(body, '(?m)^[ \t]*\*\*{name}\*\*:[ \t]*(\S[^\n]*?)[ \t\r]*$', 1), '')"
_ON = r"nullif(regexp_extract(raw_title, '\(([0-9]{4}-[0-9]{2}-[0-9]{2})\)\s*$', 1), '')"
_HEADLINE = "regexp_matches(line, '^##? ')"

SQL = {
    "line_search": f"WITH {_F}, {_lines('files')} SELECT file, line_num, line FROM lines WHERE contains(lower(line), '{PHRASE}')",
    "line_search_context": f"""WITH {_F}, {_lines('files')} SELECT m.file, m.line_num AS match_line, l.line_num, l.line, l.line_num = m.line_num AS is_match
FROM lines m JOIN lines l ON l.file = m.file AND l.line_num BETWEEN m.line_num - 2 AND m.line_num + 2 WHERE contains(lower(m.line), '{PHRASE}')""",
    "highlighted": f"WITH {_F}, {_lines('files')} SELECT file, line_num, regexp_replace(line, '(?i)({PHRASE})', '<b>\\1</b>', 'g') AS line FROM lines WHERE contains(lower(line), '{PHRASE}')",
    "ranked_search": f"""WITH {_F}, p AS (SELECT file, lower(text) AS t, text, row_number() OVER (ORDER BY file) - 1 AS pos, count(*) OVER () AS n FROM files),
s AS (SELECT file, text, CAST((length(t) - length(replace(t, 'quota', ''))) / 5 + (length(t) - length(replace(t, 'ledger', ''))) / 6 AS INTEGER) AS match_count,
  CASE WHEN n > 1 THEN 0.5 + 0.5 * (pos / (n - 1)) ELSE 1.0 END * CASE WHEN contains(t, E'### user\\n\\n{WORDS[:20]}') THEN 1.5 ELSE 1.0 END AS w
  FROM p WHERE contains(t, 'quota') AND contains(t, 'ledger'))
SELECT file, match_count, round(match_count * w, 6) AS score, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\r?\\n'),
  lambda x: (contains(lower(x), 'quota') OR contains(lower(x), 'ledger')) AND trim(x) <> '' AND NOT regexp_matches(trim(x), '^(#|---|```)'))[:3], lambda x: trim(x)), E'\\n') AS previews
FROM s ORDER BY match_count * w DESC, file LIMIT 10""",
    "ranked_search_phrase": f"""WITH {_F}, p AS (SELECT file, lower(text) AS t, row_number() OVER (ORDER BY file) AS k, count(*) OVER () AS n FROM files)
SELECT file, round(((length(t) - length(replace(t, '{PHRASE}', ''))) // {len(PHRASE)} * 1.0 + k / n) * CASE WHEN contains(t, E'### user\\n\\n{PHRASE}') THEN 1.5 ELSE 1.0 END, 6) AS score
FROM p WHERE contains(t, '{PHRASE}') ORDER BY 2 DESC, file LIMIT 10""",
    "near_duplicate_lines": f"""WITH docs AS (SELECT doc_id AS file, text FROM documents), {_lines('docs')}, k AS (SELECT file, line_num, {_key('line')} AS norm FROM lines)
SELECT file, first_line, line_num FROM (SELECT *, min(line_num) OVER (PARTITION BY file, norm) AS first_line FROM k WHERE strlen(norm) >= 20) WHERE line_num <> first_line""",
    "section_sizes": f"""WITH docs AS (SELECT doc_id AS file, text FROM documents), {_lines('docs')}, h AS (
  SELECT *, sum(CAST({_HEADLINE} AS INTEGER)) OVER (PARTITION BY file ORDER BY line_num) AS k FROM lines
), s AS (SELECT file, k, arg_min(trim(regexp_replace(line, '^#+', '')), line_num) AS section, count(*) AS lines FROM h WHERE k > 0 GROUP BY 1, 2)
SELECT file, CAST(k AS INTEGER) AS section_no, section, CAST(lines AS INTEGER) AS lines FROM s WHERE section <> ''""",
    "largest_sections": f"""WITH docs AS (SELECT doc_id AS file, text FROM documents), {_lines('docs')}, h AS (
  SELECT *, sum(CAST({_HEADLINE} AS INTEGER)) OVER (PARTITION BY file ORDER BY line_num) AS k FROM lines
), s AS (SELECT file, k, arg_min(trim(regexp_replace(line, '^#+', '')), line_num) AS section, count(*) AS lines FROM h WHERE k > 0 GROUP BY 1, 2)
SELECT file, CAST(k AS INTEGER) AS section_no, section, CAST(lines AS INTEGER) AS lines, CAST(row_number() OVER (PARTITION BY file ORDER BY lines DESC, k) AS INTEGER) AS rank
FROM s WHERE section <> '' QUALIFY row_number() OVER (PARTITION BY file ORDER BY lines DESC, k) <= 3""",
    "empty_sections": f"""WITH docs AS (SELECT doc_id AS file, replace(text, E'\\r\\n', E'\\n') AS text FROM documents), l AS (
  SELECT file, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1) AS line_num FROM docs WHERE text IS NOT NULL
), h AS (SELECT *, sum(CAST({_HEADLINE} AS INTEGER)) OVER (PARTITION BY file ORDER BY line_num) AS k FROM l),
s AS (SELECT file, k, arg_min(line, line_num) AS head, count(*) FILTER (NOT {_HEADLINE} AND {_strip('line')} <> '' AND NOT starts_with(line, '<!--')) AS filled FROM h WHERE k > 0 GROUP BY 1, 2)
SELECT file, trim(regexp_replace(head, '^#+', '')) AS section FROM s WHERE starts_with(head, '## ') AND filled = 0""",
    "stale_dates": f"""WITH {_F}, {_lines("(SELECT * FROM files WHERE contains(text, '202'))")}, m AS (SELECT file, regexp_extract(line, '^.*?(202.{{4}})', 1) AS mo FROM lines)
SELECT file, count(*) AS stale FROM m WHERE regexp_matches(mo, '^.{{4}}-') AND mo < '2020-04'
AND (2020 - TRY_CAST(split_part(mo, '-', 1) AS INTEGER)) * 12 + 4 - TRY_CAST(split_part(mo, '-', 2) AS INTEGER) > 1 GROUP BY 1""",
    "memory_health": f"""WITH m AS (SELECT doc_id AS file, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len({_SPLIT}) END AS n FROM documents)
SELECT file, CAST(n AS INTEGER) AS lines, CAST(floor(n * 100 / 20) AS INTEGER) AS percent, CASE WHEN n > 18 THEN 'alert' WHEN n > 15 THEN 'watch' ELSE 'healthy' END AS level FROM m""",
    "store_health": f"""WITH a AS (SELECT count(*) AS archives, CAST(coalesce(sum(strlen(full_content)), 0) AS BIGINT) AS bytes, min(archived_at) AS oldest, max(archived_at) AS newest
  FROM archive_result WHERE log_number > 0), m AS (SELECT max(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len({_SPLIT}) END) AS n FROM documents)
SELECT a.*, CASE WHEN bytes >= 1048576 THEN printf('%.1f MB', bytes / 1048576.0) WHEN bytes >= 1024 THEN printf('%.1f KB', bytes / 1024.0) ELSE bytes || ' B' END AS size,
  CASE WHEN n > 180 THEN 'alert' WHEN n > 150 OR archives = 0 OR newest < TIMESTAMP '2020-02-20 12:00:00' - INTERVAL 7 DAY THEN 'watch' ELSE 'healthy' END AS level FROM a, m""",
    "distill_plan": f"""WITH docs AS (SELECT doc_id AS file, text FROM documents WHERE len(regexp_split_to_array(coalesce(text, ''), '\\r?\\n')) > 25), {_lines('docs')}, h AS (
  SELECT *, sum(CAST({_HEADLINE} AS INTEGER)) OVER (PARTITION BY file ORDER BY line_num) AS k FROM lines
), s AS (SELECT file, k, arg_min(trim(regexp_replace(line, '^#+', '')), line_num) AS section, count(*) AS lines FROM h WHERE k > 0 GROUP BY 1, 2)
SELECT file, section, CAST(lines AS INTEGER) AS lines, regexp_replace(regexp_replace(lower(section), '[^\\p{{L}}\\p{{N}}]', '-', 'g'), '^-+|-+$', '', 'g') || '.md' AS target FROM s WHERE section <> '' AND lines > 10""",
    "normalize_titles": f"SELECT entity_id, {_key('name')} AS key, regexp_replace(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM entity",
    "document_sections": f"""WITH p AS (SELECT doc_id AS file, list_filter(list_filter(string_split(replace(E'\\n' || replace(text, E'\\r\\n', E'\\n'), E'\\n## ', chr(1) || '## '), chr(1)), lambda x: starts_with(x, '## ')),
  lambda x: trim(regexp_extract(x, '^## ([^\\n]*)', 1)) <> '') AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT file, unnest(l) AS p, CAST(generate_subscripts(l, 1) AS INTEGER) AS section_no FROM p)
SELECT file, section_no, trim(regexp_extract(p, '^## ([^\\n]*)', 1)) AS title, md5({_strip("regexp_replace(p, '^## [^\\n]*', '')")}) AS section_md5 FROM e""",
    "pipeline_parse": f"""WITH {_PROCESS}, {_ENTRY} SELECT file, entry_no, stage, {_OF(0)} AS status, {_OF(1)} AS sub_type, entity_type, title, md5(body) AS body_md5, array_to_string(connected, '|') AS connected,
  coalesce(CASE WHEN stage = 'curiosity' THEN coalesce({_FIELD('Source')}, {_FIELD('Origin')}) ELSE {_FIELD('Source')} END, '') AS source_ref,
  coalesce(CASE WHEN stage <> 'curiosity' THEN {_FIELD('Destination')} END, '') AS destination,
  coalesce(CASE stage WHEN 'learning' THEN {_ON} WHEN 'thoughts' THEN coalesce({_FIELD('Graduated')}, {_FIELD('Dissolved')}, {_ON}) WHEN 'curiosity' THEN coalesce({_FIELD('Date explored')}, {_ON})
    WHEN 'reflections' THEN nullif(regexp_extract(raw_title, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?:\\s*\\([^)]*\\))?\\s*[—–-]\\s*', 1), '') ELSE coalesce({_FIELD('Added')}, {_ON}) END, '') AS date FROM entry""",
    "pipeline_entities": f"""WITH {_PROCESS}, {_ENTRY} SELECT title AS name, entity_type, CASE WHEN strlen(body) > 200 THEN substr(body, 1, 200) || '...' ELSE body END AS abstract_text,
  'pipeline:' || stage AS source FROM entry""",
    "pipeline_relationships": f"""WITH {_PROCESS}, {_ENTRY}, wanted AS (SELECT DISTINCT title AS source, unnest(connected) AS ref FROM entry), refs AS (SELECT DISTINCT ref, lower(ref) AS low FROM wanted),
names AS (SELECT file, entry_no, title, lower(title) AS name FROM entry), hit AS (
  SELECT ref, 1 AS tier, file, entry_no, title FROM refs JOIN names ON low = name
  UNION ALL SELECT ref, 2, file, entry_no, title FROM refs JOIN names ON strlen(name) >= 5 AND (contains(low, name) OR contains(name, low))
  UNION ALL SELECT ref, 3, file, entry_no, title FROM refs JOIN names ON list_contains(regexp_extract_all(low, '"([^"]+)"', 1), name)
), best AS (SELECT ref, title AS target FROM hit QUALIFY row_number() OVER (PARTITION BY ref ORDER BY tier, file, entry_no) = 1)
SELECT DISTINCT source, target, 'CONNECTED_TO' AS rel_type, wanted.ref AS description FROM wanted JOIN best ON best.ref = wanted.ref""",
    "pipeline_diff": f"""WITH {_PROCESS}, {_ENTRY}, new AS (SELECT entity_type, {_key('title')} AS key, body, {_OF(0)} AS status FROM entry), have AS (
  SELECT entity_id, entity_type, {_key('name')} AS key, created_at, overview, json_extract_string(attributes, '$.pipeline_status') AS status FROM entity
  WHERE json_extract_string(attributes, '$.pipeline_stage') IS NOT NULL
), first AS (SELECT * FROM have QUALIFY row_number() OVER (PARTITION BY entity_type, key ORDER BY created_at, entity_id) = 1), m AS (
  SELECT CASE WHEN f.entity_id IS NULL THEN 'create' WHEN f.status IS DISTINCT FROM new.status OR f.overview IS DISTINCT FROM new.body THEN 'update' ELSE 'keep' END AS action, f.entity_id
  FROM new LEFT JOIN first f ON f.entity_type = new.entity_type AND f.key = new.key
) SELECT action, count(*) AS n FROM (SELECT action FROM m UNION ALL SELECT 'archive' FROM have
  WHERE entity_id NOT IN (SELECT entity_id FROM m WHERE entity_id IS NOT NULL) AND coalesce(status, '') <> 'archived' AND EXISTS (SELECT 1 FROM new)) GROUP BY 1""",
    "signal_sync": """SELECT strftime(ts, '%Y-%m-%d') AS timestamp, count(*) FILTER (event_type = 'click') AS clicks, CASE WHEN avg(value) FILTER (event_type = 'view') IS NULL THEN printf('Signal measurement: thought_lifecycle=%.2f (trigger: daily)', CAST(count(*) FILTER (event_type = 'click') AS DOUBLE))
    ELSE printf('Signal measurement: vocab=%.2f, thought_lifecycle=%.2f (trigger: daily)', avg(value) FILTER (event_type = 'view'), CAST(count(*) FILTER (event_type = 'click') AS DOUBLE)) END AS abstract_text
FROM events WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-15' GROUP BY 1""",
    "outcome_sync": """WITH named AS (SELECT entity_id FROM entity WHERE entity_type = 'tool' ORDER BY created_at, entity_id LIMIT 1)
SELECT CAST(event_id AS VARCHAR) AS task_id, entity_id, 'partial in click' AS description FROM events, named WHERE event_type = 'click' AND strftime(ts, '%Y-%m-%d') >= '2024-01-15'""",
    "local_entity_merge": r"""WITH r AS (SELECT regexp_split_to_array(name, '[_ -]')[1] AS name, min(entity_type) AS entity_type, min(coalesce(abstract_text, '')) AS a, min(overview) AS o, created_at AS made
  FROM entity WHERE regexp_split_to_array(name, '[_ -]')[1] <> '' GROUP BY regexp_split_to_array(name, '[_ -]')[1], created_at)
SELECT lower(name) AS key, arg_min(name, made) AS name, arg_min(entity_type, made) AS entity_type, (list(a ORDER BY strlen(a) DESC, made))[1] AS abstract_text,
  md5(coalesce(string_agg(o, E'\n\n' ORDER BY made), '')) AS overview_md5 FROM r GROUP BY 1""",
    "truncated": """WITH s AS (SELECT archive_id, full_content AS t, list_filter(generate_series(least(1999, length(full_content)), 0, -1), lambda n: strlen(substr(full_content, 1, n)) <= 1999)[1] AS n
  FROM archive_result WHERE full_content IS NOT NULL)
SELECT archive_id, CAST(strlen(substr(t, 1, n)) AS INTEGER) AS bytes, CAST(n AS INTEGER) AS chars FROM s""",
    "display_forms": """WITH s AS (SELECT archive_id, strlen(full_content) AS n, least(100, strlen(full_content) // 100) AS p FROM archive_result WHERE full_content IS NOT NULL)
SELECT archive_id, CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE n || ' B' END AS size,
  CASE WHEN n * 37 >= 1000000 THEN printf('%.1fM', n * 37 / 1000000.0) WHEN n * 37 >= 1000 THEN printf('%.0fK', n * 37 / 1000.0) ELSE CAST(n * 37 AS VARCHAR) END AS tokens,
  repeat('█', CAST(p * 20 // 100 AS INTEGER)) || repeat('░', CAST(20 - p * 20 // 100 AS INTEGER)) AS bar FROM s""",
}
QUERIES = {name: globals()[name] for name in SQL}
