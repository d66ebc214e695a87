"""Queries over archives as episodes with vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import jobs
from ..functions import text
from ..operators import conversation, graph, search, state
from ..schema import EPISODE
from ..session import materialize, table
from ..sources import files
from .conversations import _CHUNKS, _EPHEMERAL, _ITEMS, _strip
from .graph import _NOW, _Q, _SIM, _STEPS, _SCORE, AS_OF, _query_vector


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    """Each archive as one episode, with the test vector of its number."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("archive_id"), "embedding")
    rows = table(spark, d, "archive_result").where("log_number > 0").join(vectors, "archive_id", "left")
    return rows.select(
        F.concat(F.lit("episode:"), F.col("archive_id").cast("string")).alias("episode_id"), "session_id", F.col("archived_at").alias("timestamp"),
        F.substring("full_content", 1, 200).alias("abstract_text"), F.lit(None).cast("string").alias("overview"), F.col("full_content").alias("content"),
        "embedding", "log_number", (F.col("archive_id") % 3 == 0).alias("extracted"),
    )


def _vector(spark: SparkSession, d: str):
    row = table(spark, d, "embeddings").where("embedding is not null").orderBy("vec_id").select("embedding").first()
    return search.literal_vector(row[0] if row else None)


def episodes_by_session(spark, d):
    """Of the session whose archive has the highest log."""
    e = _episodes(spark, d)
    last = e.agg(F.max_by("session_id", "log_number").alias("s")).first()
    return graph.episodes_of_session(e, last["s"]).select("episode_id", "session_id", "log_number", "timestamp")


def episode_by_log(spark, d):
    return graph.episode_by_log(_episodes(spark, d), 7).select("episode_id", "log_number")


def search_episodes(spark, d):
    return search.search_episodes(_episodes(spark, d), _vector(spark, d), 15).select("episode_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


def hybrid_with_episodes(spark, d):
    e = table(spark, d, "entity")
    found = search.hybrid(e, table(spark, d, "relates_to"), _query_vector(e), AS_OF, 10)
    episodes = search.search_episodes(_episodes(spark, d), _vector(spark, d), 10)
    return found.select(F.col("entity_id").alias("id"), "found_by", F.round("score", 6).alias("score")).unionByName(
        episodes.select(F.col("episode_id").alias("id"), F.lit("episode").alias("found_by"), F.round("score", 6).alias("score"))
    )


def unextracted_logs(spark, d):
    return state.unextracted_logs(_episodes(spark, d))


def mark_extracted(spark, d):
    e = _episodes(spark, d)
    return state.mark_extracted(e, e.where("log_number % 2 = 0").select("log_number")).select("episode_id", "extracted")


def archive_ingestion(spark, d):
    """Episodes after ingesting the archives of which none is known by its log number."""
    known = _episodes(spark, d).where("extracted").select(*(f.name for f in EPISODE.fields))
    archives = table(spark, d, "archive_result").where("log_number > 0 and full_content is not null").select("session_id", "log_number", "full_content")
    after = jobs.ingest_archives(archives, known, AS_OF)
    return after.groupBy("log_number").agg(F.count("*").alias("episodes"), F.sum(F.length("abstract_text")).alias("chars"), F.min(F.md5("content")).alias("least"))


def archive_metadata(spark, d):
    rows = table(spark, d, "archive_result").where("log_number > 0").select(
        F.when(F.col("log_number") % 2 == 0, F.format_string("conversation-%03d.md", "log_number")).otherwise(F.format_string("archive-log-%d.md", "log_number")).alias("file"),
        F.col("full_content").alias("text"),
    )
    return files.archive_metadata(rows)


def archive_files(spark, d):
    logs = table(spark, d, "archive_result").where("log_number > 0").select("log_number")
    have = F.when(F.col("log_number") % 3 == 0, F.array(F.format_string("conversation-%d.md", "log_number"), F.format_string("archive-log-%03d.md", "log_number"))).when(
        F.col("log_number") % 3 == 1, F.array(F.format_string("archive-log-%d.md", "log_number"))
    )
    return files.find_archives(logs.select(F.explode(have).alias("file")), logs)


def checkpoint_placeholders(spark, d):
    """Sessions that ended without a transcript."""
    known = table(spark, d, "transcript_entry").where("session_id is not null")
    return jobs.checkpoint(table(spark, d, "hook_input").where("session_id is not null"), known, "precompact", AS_OF).select("session_id", "source")


def summary_prompts(spark, d):
    """The text of each session a model is shown, cut at 4,000 bytes."""
    items = materialize(conversation.entries(table(spark, d, "transcript_entry")), "items")
    return jobs.summary_prompts(items).select("session_id", F.octet_length("prompt").alias("bytes"), F.md5("prompt").alias("prompt_md5"))


def ephemeral_fields(spark, d):
    rows = table(spark, d, "documents").where("source = 'ephemeral'")
    return conversation.ephemeral_fields(rows, "doc_id", "text")


def times_read(spark, d):
    seen = table(spark, d, "session_metadata").select("record_id", text.parse_datetime(F.col("started_at")).alias("t"))
    return seen.select("record_id", F.coalesce(F.unix_micros(F.col("t").cast("timestamp")), F.lit(-1)).alias("micros"))


_EPISODES = """ep AS (
  SELECT 'episode:' || a.archive_id AS episode_id, a.archive_id, session_id, archived_at, full_content, log_number, a.archive_id % 3 = 0 AS extracted, CAST(v.embedding AS DOUBLE[]) AS v
  FROM archive_result a LEFT JOIN embeddings v ON v.vec_id = a.archive_id WHERE log_number > 0
), eq AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1
), es AS (SELECT episode_id, list_cosine_similarity(v, q) AS similarity FROM ep, eq WHERE v IS NOT NULL AND len(v) = len(q))"""

SQL = {
    "episodes_by_session": f"WITH {_EPISODES} SELECT episode_id, session_id, log_number, archived_at AS timestamp FROM ep WHERE session_id = (SELECT session_id FROM ep ORDER BY log_number DESC LIMIT 1)",
    "episode_by_log": f"WITH {_EPISODES} SELECT episode_id, log_number FROM ep WHERE log_number = 7",
    "search_episodes": f"WITH {_EPISODES} SELECT episode_id, round(similarity, 6) AS similarity, round(similarity, 6) AS score FROM es WHERE NOT isnan(similarity) ORDER BY es.similarity DESC, episode_id LIMIT 15",
    "hybrid_with_episodes": f"""WITH {_Q}, {_SIM}, {_STEPS}, {_EPISODES}, seeds AS (
  SELECT entity_id, {_SCORE} AS score FROM (SELECT * FROM sim ORDER BY similarity DESC, entity_id LIMIT 20)
), best AS (SELECT * FROM seeds ORDER BY score DESC, entity_id LIMIT 3),
near AS (
  SELECT s."to" AS entity_id, b.score * s.eff AS score FROM steps s JOIN best b ON s.at = b.entity_id
  WHERE s."to" NOT IN (SELECT entity_id FROM seeds)
  QUALIFY row_number() OVER (PARTITION BY s."to" ORDER BY b.score DESC, b.entity_id, s.way, s.rel_id) = 1
), every AS (
  SELECT entity_id, 'semantic' AS found_by, score FROM seeds UNION ALL SELECT entity_id, 'graph', score FROM near WHERE entity_id IN (SELECT entity_id FROM entity)
) SELECT * FROM (SELECT entity_id AS id, found_by, round(score, 6) AS score FROM every ORDER BY every.score DESC, entity_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT episode_id, 'episode', round(similarity, 6) FROM es WHERE NOT isnan(similarity) ORDER BY similarity DESC, episode_id LIMIT 10)""",
    "unextracted_logs": f"WITH {_EPISODES} SELECT DISTINCT log_number FROM ep WHERE NOT extracted",
    "mark_extracted": f"WITH {_EPISODES} SELECT episode_id, extracted OR log_number % 2 = 0 AS extracted FROM ep",
    "archive_ingestion": f"""WITH {_CHUNKS}, made AS (
  SELECT log_number, {_strip('substr(c, 1, 200)')} || CASE WHEN length(c) > 200 THEN '...' ELSE '' END AS abstract_text, c AS content
  FROM chunk JOIN archive_result a ON a.archive_id = chunk.archive_id WHERE log_number > 0 AND a.archive_id % 3 <> 0
), every AS (SELECT * FROM made UNION ALL SELECT log_number, substr(full_content, 1, 200), full_content FROM archive_result WHERE log_number > 0 AND archive_id % 3 = 0)
SELECT log_number, count(*) AS episodes, CAST(sum(length(abstract_text)) AS BIGINT) AS chars, min(md5(content)) AS least FROM every GROUP BY 1""",
    "archive_metadata": r"""WITH n AS (SELECT *, CASE WHEN log_number < 1000 THEN lpad(CAST(log_number AS VARCHAR), 3, '0') ELSE CAST(log_number AS VARCHAR) END AS p,
  regexp_extract_all(regexp_extract(full_content, '(?s)^---(.*?)---', 1), '(?m)^[ \t]*session_id:[ \t]*([^\r\n]*)', 1) AS s FROM archive_result WHERE log_number > 0)
SELECT CASE WHEN log_number % 2 = 0 THEN 'conversation-' || p || '.md' ELSE 'archive-log-' || log_number || '.md' END AS file, log_number,
  CASE WHEN len(s) > 0 THEN regexp_replace(trim(s[-1]), '^"+|"+$', '', 'g') ELSE 'unknown' END AS session_id FROM n""",
    "archive_files": """WITH n AS (SELECT log_number, CASE WHEN log_number < 1000 THEN lpad(CAST(log_number AS VARCHAR), 3, '0') ELSE CAST(log_number AS VARCHAR) END AS p FROM archive_result WHERE log_number > 0)
SELECT log_number, CASE log_number % 3 WHEN 0 THEN 'conversation-' || log_number || '.md' ELSE 'archive-log-' || log_number || '.md' END AS file FROM n WHERE log_number % 3 < 2""",
    "checkpoint_placeholders": """SELECT DISTINCT session_id, 'precompact' AS source FROM hook_input
WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM transcript_entry WHERE session_id IS NOT NULL)""",
    "summary_prompts": f"""WITH {_ITEMS}, l AS (SELECT session_id, entry_id, pos,
  CASE kind WHEN 'tool_use' THEN '[Tool: ' || tool || ' → ' || text || ']'
    ELSE CASE kind WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END END AS line
  FROM items WHERE kind <> 'tool_result'
), b AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY session_id ORDER BY entry_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
j AS (SELECT session_id, string_agg(line, E'\\n' ORDER BY entry_id, pos) AS t FROM b WHERE before <= 4000 GROUP BY 1),
c AS (SELECT session_id, t, list_filter(generate_series(least(4000, length(t)), 0, -1), lambda n: strlen(substr(t, 1, n)) <= 4000)[1] AS n FROM j),
p AS (SELECT session_id, CASE WHEN strlen(t) > 4000 THEN substr(t, 1, n) || E'\\n… (conversation truncated)' ELSE t END AS prompt FROM c)
SELECT session_id, CAST(strlen(prompt) AS INTEGER) AS bytes, md5(prompt) AS prompt_md5 FROM p""",
    "ephemeral_fields": f"""WITH {_EPHEMERAL}, x AS (SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS entry_no, unnest(l) AS entry FROM e),
y AS (SELECT *, regexp_extract(entry, '^([^\\n]*)', 1) AS first, trim(regexp_extract(entry, '(?m)^[^\\n]*\\*\\*Duration\\*\\*[^\\n~]*~([^|~\\n]*)', 1)) AS len,
  TRY_CAST(regexp_extract(entry, '\\*\\*Messages\\*\\*:\\s*(\\d+)', 1) AS INTEGER) AS told, TRY_CAST(regexp_extract(entry, '\\((\\d+) messages', 1) AS INTEGER) AS counted,
  trim(regexp_extract(entry, '\\*\\*Summary\\*\\*:([^\\n]*)', 1)) AS s FROM x)
SELECT doc_id, entry_no, CASE WHEN contains(first, '—') THEN trim(string_split(first, '—')[2]) WHEN contains(first, ' - ') THEN trim(string_split(first, ' - ')[2]) ELSE '' END AS date,
  CASE WHEN len <> '' THEN len ELSE '—' END AS duration, coalesce(told, counted, 0) AS messages,
  CASE WHEN strlen(s) > 50 THEN substr(s, 1, list_filter(generate_series(least(47, length(s)), 0, -1), lambda n: strlen(substr(s, 1, n)) <= 47)[1]) || '...' ELSE s END AS summary FROM y""",
    "times_read": r"""SELECT record_id, coalesce(CASE
  WHEN regexp_full_match(started_at, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})') THEN epoch_us(TRY_CAST(started_at AS TIMESTAMPTZ))
  WHEN regexp_full_match(started_at, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?') THEN epoch_us(TRY_CAST(started_at AS TIMESTAMP)) END, -1) AS micros FROM session_metadata""",
}
QUERIES = {name: globals()[name] for name in SQL}
