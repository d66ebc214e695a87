"""Queries over transcript_entry, archive_result and documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import conversation, ingest
from ..session import materialize, spread, table
from ..sources import files


def _items(spark: SparkSession, d: str) -> DataFrame:
    return conversation.entries(spread(table(spark, d, "transcript_entry")))


def _written(spark: SparkSession, d: str) -> DataFrame:
    """The items of operators that read them more than once."""
    return materialize(_items(spark, d), "items")


def _archives(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "archive_result")


def transcript_entries(spark, d):
    return _items(spark, d).select("entry_id", "pos", "session_id", "kind", "tool", "is_error", F.md5("text").alias("text_md5"))


def conversation_stats(spark, d):
    return conversation.stats(_items(spark, d))


def conversation_spans(spark, d):
    return conversation.spans(table(spark, d, "transcript_entry"))


def conversation_topics(spark, d):
    return conversation.topics(_written(spark, d))


def conversation_summary(spark, d):
    return conversation.summary(_written(spark, d))


def conversation_tags(spark, d):
    return conversation.tags(_items(spark, d))


def conversation_markdown(spark, d):
    return conversation.markdown_lines(_written(spark, d)).select(
        "entry_id", "pos", F.md5("part").alias("part_md5")
    )


def conversation_condensed(spark, d):
    return conversation.condensed(_items(spark, d))


def archive_index(spark, d):
    return conversation.archive_index(_written(spark, d), table(spark, d, "transcript_entry"))


def archive_numbering(spark, d):
    return files.next_archive_number(_archives(spark, d))


def front_matter(spark, d):
    return conversation.front_matter(_archives(spark, d), "archive_id", "full_content").withColumn("topics", F.array_join("topics", "|"))


def front_matter_rendered(spark, d):
    rows = conversation.front_matter(_archives(spark, d), "archive_id", "full_content")
    again = conversation.front_matter(rows.select("archive_id", conversation.render_front_matter().alias("t")), "archive_id", "t")
    return again.withColumn("topics", F.array_join("topics", "|"))


def unarchived_sessions(spark, d):
    return conversation.unarchived(table(spark, d, "transcript_entry"), _archives(spark, d))


def uningested_archives(spark, d):
    # Episodes exist for the archives that documents were written from.
    done = table(spark, d, "documents").where("source = 'episode'").select("session_id")
    return _archives(spark, d).where("log_number > 0").join(done, "session_id", "left_anti").select("log_number")


def episode_chunks(spark, d):
    return conversation.episodes(_archives(spark, d), "archive_id", "full_content").select(
        "archive_id", "chunk_no", "abstract_text", F.md5(F.col("content")).alias("content_md5")
    )


def token_budget(spark, d):
    rows = _archives(spark, d).where("log_number > 0")
    parts = F.size(text.chunks(F.coalesce("full_content", F.lit(""))))
    return conversation.token_budget(rows, "log_number", ingest.token_estimate(parts, F.lit(0)), 500_000)


def ephemeral_entries(spark, d):
    rows = table(spark, d, "documents").where("source = 'ephemeral'")
    return conversation.ephemeral_entries(rows, "doc_id", "text").select("doc_id", "entry_no", F.md5(F.col("entry")).alias("entry_md5"))


def ephemeral_window(spark, d):
    rows = table(spark, d, "documents").where("source = 'ephemeral'")
    return conversation.ephemeral_window(rows, "doc_id", "text").select("doc_id", "entries", F.md5(F.col("kept")).alias("kept_md5"))


def session_lengths(spark, d):
    rows = table(spark, d, "session_metadata")
    return rows.select("record_id", F.coalesce(text.duration(F.col("started_at"), F.col("ended_at")), F.lit("unknown")).alias("length"))


_WS = r"[\s\x{a0}\x{2028}\x{2029}\x{3000}\x{85}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x0b]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_ITEMS = f"""once AS (
  SELECT *, lower(trim(role)) AS who FROM transcript_entry WHERE session_id IS NOT NULL AND content IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY session_id, coalesce(entry_uuid, 'row:' || entry_id) ORDER BY entry_id) = 1
), lean AS (
  SELECT *, regexp_matches(content, '^\\s*\\[\\s*(\\{{|\\])') AS listed FROM once
  WHERE lower(trim(role)) IN ('user', 'assistant') AND coalesce(lower(trim(entry_type)) NOT IN ('queue-operation', 'summary'), true)
), block AS (
  SELECT session_id, entry_id, who, unnest(CAST(content AS JSON[])) AS b, generate_subscripts(CAST(content AS JSON[]), 1) - 1 AS pos
  FROM (SELECT * FROM lean WHERE listed AND json_valid(content))
), part AS (
  SELECT session_id, entry_id, pos, who, b, json_extract_string(b, '$.type') AS t, json_extract_string(b, '$.text') AS tx,
    coalesce(json_extract_string(b, '$.name'), 'unknown') AS name, json_extract(b, '$.input') AS input FROM block
), items AS (
  SELECT session_id, entry_id, 0 AS pos, who AS kind, content AS text, NULL AS tool, false AS is_error FROM lean WHERE NOT listed
  UNION ALL SELECT session_id, entry_id, pos, who, tx, NULL, coalesce(CAST(json_extract(b, '$.is_error') AS BOOLEAN), false) FROM part WHERE who = 'assistant' AND t = 'text' AND tx <> ''
  UNION ALL SELECT session_id, entry_id, pos, 'tool_use', CASE WHEN input IS NULL THEN ''
      WHEN name IN ('Read', 'Edit', 'Write') THEN coalesce('`' || json_extract_string(input, '$.file_path') || '`', '')
      WHEN name = 'Bash' THEN coalesce('`' || json_extract_string(input, '$.command') || '`', '')
      WHEN name = 'Grep' THEN '`' || coalesce(json_extract_string(input, '$.pattern'), '') || '` in `' || coalesce(json_extract_string(input, '$.path'), '') || '`'
      WHEN name = 'Glob' THEN coalesce('`' || json_extract_string(input, '$.pattern') || '`', '') ELSE CAST(input AS VARCHAR) END,
    name, coalesce(CAST(json_extract(b, '$.is_error') AS BOOLEAN), false) FROM part WHERE who = 'assistant' AND t = 'tool_use'
  UNION ALL SELECT session_id, entry_id, pos, 'tool_result',
    CASE WHEN strlen(c) <= 2000 THEN c ELSE substr(c, 1, list_filter(generate_series(least(2000, length(c)), 0, -1), lambda n: strlen(substr(c, 1, n)) <= 2000)[1]) || E'...\\n\\n[truncated, ' || strlen(c) || ' chars total]' END, NULL, err
  FROM (SELECT *, coalesce(json_extract_string(b, '$.content'), '') AS c, coalesce(CAST(json_extract(b, '$.is_error') AS BOOLEAN), false) AS err FROM part WHERE who = 'user' AND t = 'tool_result')
)"""


def _prefix(x: str) -> str:
    """strip_channel_prefix in SQL."""
    s = _strip(x)
    b = f"(CASE WHEN regexp_matches({s}, '(?s)^\\[.*?\\]\\n') THEN {_strip(f'regexp_replace({s}, $$(?s)^\\[.*?\\]\\n$$, $$$$)')} WHEN regexp_matches({s}, '(?s)^\\[.*?\\] ') THEN {_strip(f'regexp_replace({s}, $$(?s)^\\[.*?\\] $$, $$$$)')} ELSE {s} END)"
    c = f"regexp_replace({b}, '^User message: ', '')"
    return f"(CASE WHEN starts_with({c}, 'User message:') THEN {_strip(f'substr({c}, 14)')} ELSE {c} END)"


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_WORDS)
_TOPICS = f"""said AS (
  SELECT session_id, {_prefix('text')} AS s FROM items WHERE kind = 'user'
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY entry_id, pos) <= 5
), w AS (
  SELECT session_id, regexp_replace(lower(unnest(regexp_split_to_array({_strip('s')}, '{_WS}+'))), '[^\\p{{L}}\\p{{N}}_-]', '', 'g') AS topic, 1 AS w FROM said
), used AS (SELECT session_id, lower(regexp_replace(split_part(text, '/', -1), '^`+|`+$', '', 'g')) AS target, lower(tool) AS tool FROM items WHERE kind = 'tool_use'),
weights AS (
  SELECT session_id, topic, sum(w) AS weight FROM (
    SELECT * FROM w WHERE strlen(topic) >= 3 AND topic NOT IN ({_STOP})
    UNION ALL SELECT session_id, split_part(target, '.', 1), 2 FROM used WHERE strlen(target) >= 3 AND NOT contains(target, '(') AND split_part(target, '.', 1) <> ''
    UNION ALL SELECT session_id, tool, 1 FROM used WHERE tool NOT IN ({_STOP})) GROUP BY 1, 2
), topics AS (
  SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, topic) AS INTEGER) AS rank, topic, CAST(weight AS BIGINT) AS weight FROM weights
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, topic) <= 5
)"""


def _seconds(c: str) -> str:
    p = f"regexp_extract({c}, '^([0-9]+)-([0-9]+)-([0-9]+)T([0-9]+):([0-9]+):([0-9]+)(?:[.][^Z+]*)?Z*(?:[+]00:00)*$'"
    n = lambda i: f"TRY_CAST({p}, {i}) AS BIGINT)"
    return f"(({n(1)} * 365 + {n(2)} * 30 + {n(3)}) * 86400 + {n(4)} * 3600 + {n(5)} * 60 + {n(6)})"


def _length(a: str, b: str) -> str:
    diff = f"abs({_seconds(b)} - {_seconds(a)})"
    return f"""(CASE WHEN {diff} IS NULL THEN 'unknown' WHEN {diff} < 60 THEN '< 1m' WHEN {diff} < 3600 THEN CAST({diff} // 60 AS VARCHAR) || 'm'
      WHEN {diff} % 3600 // 60 = 0 THEN CAST({diff} // 3600 AS VARCHAR) || 'h'
      ELSE CAST({diff} // 3600 AS VARCHAR) || 'h' || lpad(CAST({diff} % 3600 // 60 AS VARCHAR), 2, '0') || 'm' END)"""


_SPANS = f"""spans AS (
  SELECT session_id, arg_min(entry_timestamp, entry_id) AS first_ts, arg_max(entry_timestamp, entry_id) AS last_ts FROM transcript_entry
  WHERE session_id IS NOT NULL AND entry_timestamp IS NOT NULL AND coalesce(lower(trim(entry_type)) NOT IN ('queue-operation', 'summary'), true) GROUP BY 1
)"""
_COUNTS = """counts AS (
  SELECT session_id, count(*) FILTER (kind = 'user') AS users, count(*) FILTER (kind = 'assistant') AS assistants,
    count(*) FILTER (kind = 'tool_use') AS tool_uses, count(*) FILTER (kind = 'tool_result') AS tool_results FROM items GROUP BY 1
)"""
# Greedy packing, segment by segment.
_CHUNKS = f"""RECURSIVE seg AS (
  SELECT archive_id, unnest(string_split(full_content, E'\\n---\\n')) AS s, generate_subscripts(string_split(full_content, E'\\n---\\n'), 1) AS i
  FROM archive_result WHERE full_content IS NOT NULL AND {_strip('full_content')} <> ''
), walk AS (
  SELECT archive_id, i, s AS open, CAST(NULL AS VARCHAR) AS done FROM seg WHERE i = 1
  UNION ALL SELECT w.archive_id, g.i,
    CASE WHEN w.open <> '' AND strlen(w.open) + strlen(g.s) > 2000 THEN g.s WHEN w.open = '' THEN g.s ELSE w.open || E'\\n---\\n' || g.s END,
    CASE WHEN w.open <> '' AND strlen(w.open) + strlen(g.s) > 2000 THEN {_strip('w.open')} END
  FROM walk w JOIN seg g ON g.archive_id = w.archive_id AND g.i = w.i + 1
), chunk AS (
  SELECT archive_id, i, done AS c FROM walk WHERE done IS NOT NULL
  UNION ALL SELECT archive_id, 1000000000, {_strip('arg_max(open, i)')} FROM walk GROUP BY 1 HAVING {_strip('arg_max(open, i)')} <> ''
)"""
_FRONT = f"""held AS (
  SELECT archive_id, {_strip('full_content')} AS s FROM archive_result WHERE full_content IS NOT NULL
), lines AS (
  SELECT archive_id, list_filter(list_transform(regexp_split_to_array(regexp_extract(s, '(?s)^---(.*?)---', 1), '\\r?\\n'), lambda x: {_strip('x')}), lambda x: x <> '') AS l
  FROM held WHERE regexp_matches(s, '(?s)^---.*?---')
), got AS (
  SELECT archive_id, l, map_from_entries(list_transform(list_distinct(list_transform(l, lambda x: {_strip("split_part(x, ':', 1)")})),
    lambda k: {{'k': k, 'v': list_filter(l, lambda y: {_strip("split_part(y, ':', 1)")} = k)[-1]}})) AS m
  FROM lines WHERE len(list_filter(l, lambda x: NOT contains(x, ':'))) = 0
), val AS (
  SELECT archive_id, map_from_entries(list_transform(map_entries(m), lambda e: {{'k': e.key, 'v': regexp_replace({_strip("regexp_replace(e.value, '^[^:]*:', '')")}, '^"+|"+$', '', 'g')}})) AS m FROM got
)
SELECT archive_id, TRY_CAST(m['log'] AS BIGINT) AS log, m['date'] AS date, coalesce(m['session_id'], '') AS session_id,
  coalesce(TRY_CAST(m['message_count'] AS BIGINT), 0) AS message_count, coalesce(m['duration'], '') AS duration, coalesce(m['source'], '') AS source,
  coalesce(array_to_string(list_filter(list_transform(string_split(regexp_replace(m['topics'], '^[\\[\\]]+|[\\[\\]]+$', '', 'g'), ','),
    lambda t: regexp_replace(trim(t), '^"+|"+$', '', 'g')), lambda t: t <> ''), '|'), '') AS topics
FROM val WHERE TRY_CAST(m['log'] AS BIGINT) IS NOT NULL AND m['date'] IS NOT NULL"""
_EPHEMERAL = f"""e AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, E'\\n---\\n'), lambda x: {_strip('x')}), lambda x: x <> '') AS l
  FROM documents WHERE source = 'ephemeral' AND text IS NOT NULL
)"""


def _marked(markers, whole: bool, least: int) -> str:
    """All marked sentences of said(session_id, entry_id, pos, text)."""
    out = []
    for i, m in enumerate(markers):
        q = m.replace("'", "''")
        at = f"strpos(lower(text), '{q}')"
        tail = f"substr(text, {at} + {len(m)})"
        stop = f"(CASE WHEN regexp_matches({tail}, '[.\\n]') THEN length(regexp_extract({tail}, '^([^.\\n]*[.\\n])', 1)) ELSE 0 END)"
        end = f"(CASE WHEN {stop} > 0 THEN {at} + {len(m)} + {stop} ELSE least(length(text) + 1, {at} + {len(m)} + 100) END)"
        head = f"substr(text, 1, {at} - 1)"
        begin = f"(CASE WHEN regexp_matches({head}, '[.\\n]') THEN length(regexp_extract({head}, '(?s)^(.*[.\\n])', 1)) + 1 ELSE {at} END)" if whole else at
        sentence = _strip(f"substr(text, {begin}, {end} - {begin})")
        out.append(f"SELECT session_id, entry_id, pos, {i} AS i, {sentence} AS item FROM spoken WHERE {at} > 0 AND strlen({sentence}) BETWEEN {least} AND 200")
    return " UNION ALL ".join(out)


def _project() -> str:
    words = []
    for m in text.PROJECT_MARKERS:
        w = f"regexp_extract(substr(text, strpos(lower(text), '{m}') + {len(m)}), '^{_WS}*([\\p{{L}}\\p{{N}}_-]+)', 1)"
        words.append(f"CASE WHEN strpos(lower(text), '{m}') > 0 AND strlen({w}) >= 2 THEN {w} END")
    return f"coalesce({', '.join(words)})"


def _five(tag: str) -> str:
    return f"""SELECT session_id, '{tag}' AS tag, CAST(row_number() OVER (PARTITION BY session_id ORDER BY entry_id, pos, i) AS INTEGER) AS n, item
  FROM (SELECT * FROM {tag}s QUALIFY row_number() OVER (PARTITION BY session_id, lower(item) ORDER BY entry_id, pos, i, item) = 1)
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY entry_id, pos, i) <= 5"""


SQL = {
    "conversation_stats": f"WITH {_ITEMS}, {_COUNTS} SELECT * FROM counts",
    "conversation_spans": f"WITH {_SPANS} SELECT *, {_length('first_ts', 'last_ts')} AS length FROM spans",
    "conversation_topics": f"WITH {_ITEMS}, {_TOPICS} SELECT * FROM topics",
    "conversation_summary": f"""WITH {_ITEMS}, s AS (
  SELECT session_id, {_prefix('text')} AS s, entry_id, pos FROM items WHERE kind = 'user'
), f AS (SELECT session_id, s FROM s WHERE s <> '' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY entry_id, pos) = 1)
SELECT i.session_id, coalesce(CASE WHEN length(s) > 200 THEN substr(s, 1, 200) || '...' ELSE s END, 'Empty session') AS summary
FROM (SELECT DISTINCT session_id FROM items) i LEFT JOIN f ON f.session_id = i.session_id""",
    "conversation_tags": f"""WITH {_ITEMS}, spoken AS (SELECT * FROM items WHERE kind IN ('user', 'assistant')),
decisions AS ({_marked(text.DECISION_MARKERS, True, 10)}), actions AS ({_marked(text.ACTION_MARKERS, False, 5)}),
projects AS (SELECT session_id, {_project()} AS item FROM spoken WHERE {_project()} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY entry_id, pos) = 1),
files AS (SELECT DISTINCT session_id, regexp_replace(text, '^`+|`+$', '', 'g') AS item FROM items WHERE kind = 'tool_use'),
tools AS (SELECT DISTINCT session_id, tool AS item FROM items WHERE kind = 'tool_use')
SELECT * FROM ({_five('decision')}) UNION ALL SELECT * FROM ({_five('action')}) UNION ALL SELECT session_id, 'project', 1, item FROM projects
UNION ALL SELECT * FROM (SELECT session_id, 'file', CAST(row_number() OVER (PARTITION BY session_id ORDER BY item) AS INTEGER) AS n, item FROM files
  WHERE item <> '' AND regexp_matches(item, '[/.]') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY item) <= 10)
UNION ALL SELECT session_id, 'tool', CAST(row_number() OVER (PARTITION BY session_id ORDER BY item) AS INTEGER), item FROM tools""",
    "conversation_condensed": f"""WITH {_ITEMS} SELECT session_id, entry_id, pos,
  CASE kind WHEN 'tool_use' THEN '[Tool: ' || tool || ' → ' || text || ']'
    ELSE CASE kind WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END END AS line
FROM items WHERE kind <> 'tool_result'""",
    "conversation_markdown": f"""WITH {_ITEMS}, m AS (
  SELECT entry_id, pos, lag(kind) OVER (PARTITION BY session_id ORDER BY entry_id, pos) IS DISTINCT FROM kind AS heading FROM items WHERE kind IN ('user', 'assistant')
) SELECT i.entry_id, i.pos, md5(CASE kind WHEN 'tool_use' THEN '> **' || tool || '**: `' || text || E'`\\n\\n'
    WHEN 'tool_result' THEN '<details><summary>' || CASE WHEN is_error THEN 'Error' ELSE 'Result' END || E'</summary>\\n\\n```\\n' || text || E'\\n```\\n\\n</details>\\n\\n'
    ELSE CASE WHEN heading THEN E'---\\n\\n### ' || CASE kind WHEN 'user' THEN 'User' ELSE 'Assistant' END || E'\\n\\n' ELSE '' END || text || E'\\n\\n' END) AS part_md5
FROM items i LEFT JOIN m ON m.entry_id = i.entry_id AND m.pos = i.pos""",
    "archive_index": f"""WITH {_ITEMS}, {_COUNTS}, {_SPANS}, {_TOPICS}, r AS (
  SELECT c.session_id, coalesce(first_ts, '') AS begun, users + assistants AS messages, {_length('first_ts', 'last_ts')} AS length,
    coalesce((SELECT string_agg(topic, ', ' ORDER BY rank) FROM topics t WHERE t.session_id = c.session_id), '—') AS topics
  FROM counts c LEFT JOIN spans s ON s.session_id = c.session_id WHERE users > 0
), n AS (SELECT *, row_number() OVER (ORDER BY begun, session_id) AS log, split_part(begun, 'T', 1) AS date FROM r)
SELECT log, date, session_id, topics, messages, length,
  '| ' || CASE WHEN log < 1000 THEN lpad(CAST(log AS VARCHAR), 3, '0') ELSE CAST(log AS VARCHAR) END || ' | ' || date || ' | ' || session_id || ' | ' || topics || ' | ' || messages || ' | ' || length || ' |' AS line FROM n""",
    "archive_numbering": "SELECT coalesce(max(log_number), 0) + 1 AS next_number FROM archive_result",
    "front_matter": "WITH " + _FRONT,
    "front_matter_rendered": "WITH " + _FRONT,
    "unarchived_sessions": "SELECT DISTINCT session_id FROM transcript_entry WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM archive_result WHERE session_id IS NOT NULL)",
    "uningested_archives": """SELECT log_number FROM archive_result a WHERE log_number > 0
AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = 'episode' AND d.session_id = a.session_id)""",
    "episode_chunks": f"""WITH {_CHUNKS} SELECT archive_id, CAST(row_number() OVER (PARTITION BY archive_id ORDER BY i) AS INTEGER) AS chunk_no,
  {_strip('substr(c, 1, 200)')} || CASE WHEN length(c) > 200 THEN '...' ELSE '' END AS abstract_text, md5(c) AS content_md5 FROM chunk""",
    "token_budget": f"""WITH {_CHUNKS}, k AS (
  SELECT log_number, 2500 * (SELECT count(*) FROM chunk c WHERE c.archive_id = a.archive_id) AS cost FROM archive_result a WHERE log_number > 0
) SELECT log_number, cost, CAST(coalesce(before, 0) AS BIGINT) AS before FROM (
  SELECT *, sum(cost) OVER (ORDER BY log_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k) WHERE coalesce(before, 0) < 500000""",
    "ephemeral_entries": f"WITH {_EPHEMERAL} SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS entry_no, md5(unnest(l)) AS entry_md5 FROM e",
    "ephemeral_window": f"""WITH {_EPHEMERAL} SELECT doc_id, CAST(len(l) AS INTEGER) AS entries,
  md5(array_to_string(l[greatest(1, len(l) - 4):], E'\\n\\n---\\n\\n')) AS kept_md5 FROM e""",
    "session_lengths": f"SELECT record_id, {_length('started_at', 'ended_at')} AS length FROM session_metadata",
}

QUERIES = {
    f.__name__: f
    for f in (
        transcript_entries, conversation_stats, conversation_spans, conversation_topics, conversation_summary, conversation_tags,
        conversation_markdown, conversation_condensed, archive_index, archive_numbering, front_matter, front_matter_rendered, unarchived_sessions,
        uningested_archives, episode_chunks, token_budget, ephemeral_entries, ephemeral_window, session_lengths,
    )
}
SQL["transcript_entries"] = f"WITH {_ITEMS} SELECT entry_id, pos, session_id, kind, tool, is_error, md5(text) AS text_md5 FROM items"
