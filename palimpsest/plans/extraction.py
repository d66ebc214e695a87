"""Queries of what a model's answers become, of references and of lines, and their SQL.
The provider of these queries answers with its prompt, so the answers are in the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import jobs
from ..functions import text
from ..operators import conversation, documents, ingest, search
from ..session import materialize, table
from .conversations import _ITEMS
from .graph import _NAMED, _SCORE, AS_OF, _edges, _entities, _r
from .texts import _F, PHRASE, _files, _lines


class Echo:
    """A provider that answers with its prompt."""

    def complete(self, system: str, user: str, most: int) -> str:
        return user


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    """An extraction of every project, its answer fenced or wordy for some."""
    about = F.coalesce("abstract_text", F.lit(""))
    none = F.lit(None).cast("string")
    answer = F.to_json(
        F.struct(
            F.array(F.struct("name", F.lit("Tool").alias("type"), about.alias("abstract"), F.lit("seen").alias("overview"))).alias("entities"),
            F.array(F.struct(F.col("name").alias("source"), F.lit("nobody").alias("target"), F.lit("USES").alias("rel_type"), none.alias("description"), F.lit("explicit").alias("confidence"))).alias("relationships"),
            F.array(F.struct(F.col("name").alias("problem"), about.alias("solution"), none.alias("context"))).alias("cases"),
            F.array(F.struct(F.concat("name", F.lit(" way")).alias("name"), about.alias("process"), F.lit("always").alias("conditions"))).alias("patterns"),
            F.array(F.struct(F.lit("style").alias("facet"), F.col("name").alias("value"), none.alias("context"))).alias("preferences"),
        )
    )
    shown = F.when(F.col("access_count") % 3 == 0, answer).when(F.col("access_count") % 3 == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).otherwise(
        F.concat(F.lit("Here it is: "), answer, F.lit(" as asked."))
    )
    chunks = _entities(spark, d).where("entity_type = 'project'").select("entity_id", shown.alias("content"))
    return ingest.extract(chunks, Echo, "system", ["entity_id"])[0]


def extracted_entities(spark, d):
    return ingest.flatten(_extracted(spark, d), ["entity_id"])


def extraction_failures(spark, d):
    """Chunks whose answer holds no object: contents of entities as they are."""
    chunks = _entities(spark, d).where("entity_type = 'tool' and content is not null").select("entity_id", "content")
    return ingest.extract(chunks, Echo, "system", ["entity_id"])[1].select("entity_id", "error")


def _decided(spark: SparkSession, d: str) -> DataFrame:
    tools = _entities(spark, d).where("entity_type in ('tool', 'event')")
    merge = F.to_json(F.struct(F.lit("Merge").alias("decision"), F.col("name").alias("target")))
    answer = F.when(F.col("access_count") % 4 == 0, '{"decision": "skip"}').when(F.col("access_count") % 4 == 1, 'I say {"decision": "create"}').when(F.col("access_count") % 4 == 2, merge).otherwise("none")
    return ingest.decide(tools.select("entity_id", answer.alias("answer")), "entity_id", _entities(spark, d))


def dedup_decisions(spark, d):
    return _decided(spark, d).select("entity_id", "action", "target_id")


def resolved_names(spark, d):
    e = _entities(spark, d)
    cands = e.where("entity_type in ('tool', 'event')").select("entity_id", F.concat(F.lit("the "), "name").alias("name"))
    return ingest.name_map(cands, _decided(spark, d), e, "entity_id")


def merged_values(spark, d):
    e = _entities(spark, d)
    cand = e.where("entity_type = 'tool'").select(
        "entity_id", F.when(F.col("access_count") % 2 == 0, F.concat(F.coalesce("abstract_text", F.lit("")), F.lit(" more"))).otherwise("x").alias("abstract_text"),
        F.lit("later").alias("overview"), F.when(F.col("access_count") % 3 > 0, F.lit("told")).alias("content"), F.lit(None).cast("string").alias("attributes"),
    )
    return ingest.merged_values(e, cand, "entity_id").select("entity_id", "abstract_text", "overview", "content")


def matched_relationships(spark, d):
    edges = _edges(spark, d)
    both = edges.select("src_id", "dst_id", "rel_type").unionByName(edges.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), "rel_type")).distinct()
    return ingest.match_relationships(both.withColumn("certainty", F.lit("explicit")), edges).select("src_id", "dst_id", "rel_type", "rel_id", _r("confidence"))


def process_extraction(spark, d):
    """Counts of what processing the extractions does to a graph that has only the concepts."""
    e = _entities(spark, d).where("entity_type = 'concept'")
    embed = ingest.embedding(ingest.HashingEmbedder)
    x = materialize(_extracted(spark, d), "extracted")
    _, _, report = jobs.process_extraction(x, e, _edges(spark, d), Echo, "system", AS_OF, "test", embed, ["entity_id"], "processed")
    return report.where("what in ('estimated_tokens', 'relationships_failed', 'relationships_created')")


def dedup_candidates_near(spark, d):
    """As dedup_candidates at the threshold of the operator itself, of all kinds of candidates."""
    e = _entities(spark, d)
    asked = e.where("size(embedding) = 384").select(F.col("entity_id").alias("candidate"), "embedding")
    return ingest.similar_entities(asked, e, AS_OF, "candidate").select("candidate", "entity_id", _r("score"))


def missing_edges(spark, d):
    """Edges whose entity has no active edge of their type."""
    wanted = _edges(spark, d).select(F.col("src_id").alias("entity_id"), F.col("dst_id").alias("target_id"), "rel_type")
    return documents.missing_edges(wanted, _edges(spark, d)).select("entity_id", "target_id", "rel_type")


def missing_edges_strict(spark, d):
    wanted = _edges(spark, d).select(F.col("src_id").alias("entity_id"), F.col("dst_id").alias("target_id"), "rel_type")
    return documents.missing_edges(wanted, _edges(spark, d), strict=True).select("entity_id", "target_id", "rel_type")


def episode_references(spark, d):
    parsed = _entities(spark, d).select(F.col("entity_id").alias("title"), F.concat(F.lit("Conversation #"), (F.col("access_count") % 50).cast("string"), F.lit(", see log 3")).alias("source_ref"))
    episodes = table(spark, d, "archive_result").where("log_number > 0").select("log_number", F.col("archive_id").cast("string").alias("episode_id"))
    return documents.episode_references(parsed, episodes)


def user_blocks(spark, d):
    """Entries of the adapter that reads the user's text blocks too."""
    return conversation.entries(table(spark, d, "transcript_entry"), user_blocks=True).groupBy("session_id", "kind").agg(F.count("*").alias("n"))


def tool_subjects(spark, d):
    rows = table(spark, d, "transcript_entry").where("lower(trim(role)) = 'assistant'").where(F.col("content").rlike(r"^\s*\[\s*\{"))
    blocks = rows.select("entry_id", F.posexplode(F.from_json("content", conversation.BLOCK)).alias("pos", "b")).where("b.type = 'tool_use' and b.input is not null")
    return blocks.select("entry_id", "pos", conversation.tool_subject(F.col("b.input")).alias("subject"))


def line_search_few(spark, d):
    return search.line_search_few(_files(spark, d), PHRASE, 2)


def fences(spark, d):
    body = F.concat(F.lit(" ```json\n"), F.coalesce("abstract_text", F.lit("")), F.lit("\n``` "))
    return _entities(spark, d).select("entity_id", text.strip_fencing(body).alias("bare"))


def token_estimates(spark, d):
    counts = _entities(spark, d).groupBy("entity_type").agg(F.count("*").alias("candidates"), F.sum("access_count").alias("chunks"))
    return counts.select("entity_type", ingest.token_estimate(F.col("chunks"), F.col("candidates")).cast("long").alias("tokens"))


_DECIDED = f"""{_NAMED}, decided AS (
  SELECT e.entity_id, e.name, CASE access_count % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'create' WHEN 2 THEN CASE WHEN n.mutable THEN 'merge' ELSE 'create' END ELSE 'error' END AS action,
    CASE WHEN access_count % 4 = 2 AND n.mutable THEN n.entity_id END AS target_id
  FROM entity e JOIN named n ON n.name = e.name WHERE entity_type IN ('tool', 'event'))"""
_CUT = "substr(name, 1, list_filter(generate_series(least(60, length(name)), 0, -1), lambda n: strlen(substr(name, 1, n)) <= 60)[1])"

SQL = {
    "extracted_entities": f"""WITH p AS (SELECT entity_id, name, coalesce(abstract_text, '') AS a FROM entity WHERE entity_type = 'project')
SELECT entity_id, 0 AS seq, name, 'tool' AS entity_type, a AS abstract_text, 'seen' AS overview, CAST(NULL AS VARCHAR) AS content, CAST(NULL AS VARCHAR) AS attributes FROM p
UNION ALL SELECT entity_id, 1, 'Case: ' || {_CUT}, 'case', 'Problem: ' || name || ' Solution: ' || a, NULL, 'Problem: ' || name || E'\\nSolution: ' || a || E'\\nContext: none', NULL FROM p
UNION ALL SELECT entity_id, 2, name || ' way', 'pattern', a, 'always', NULL, NULL FROM p
UNION ALL SELECT entity_id, 3, 'Preference: style', 'preference', 'style: ' || name, NULL, NULL, NULL FROM p""",
    "extraction_failures": "SELECT entity_id, 'no object in the answer' AS error FROM entity WHERE entity_type = 'tool' AND content IS NOT NULL",
    "dedup_decisions": f"WITH {_DECIDED} SELECT entity_id, action, target_id FROM decided",
    "resolved_names": f"WITH {_DECIDED} SELECT 'the ' || d.name AS name, coalesce(t.name, 'the ' || d.name) AS resolved FROM decided d LEFT JOIN entity t ON t.entity_id = d.target_id WHERE action <> 'error'",
    "merged_values": """WITH c AS (SELECT *, CASE WHEN access_count % 2 = 0 THEN coalesce(abstract_text, '') || ' more' ELSE 'x' END AS n, CASE WHEN access_count % 3 > 0 THEN 'told' END AS t FROM entity WHERE entity_type = 'tool')
SELECT entity_id, CASE WHEN strlen(n) > strlen(coalesce(abstract_text, '')) THEN n END AS abstract_text, CASE WHEN coalesce(overview, '') = '' THEN 'later' ELSE overview || E'\\n\\nlater' END AS overview,
  CASE WHEN t IS NULL THEN NULL WHEN content IS NULL THEN t ELSE content || E'\\n\\n' || t END AS content FROM c""",
    "matched_relationships": """WITH w AS (SELECT src_id, dst_id, rel_type FROM relates_to UNION SELECT dst_id, src_id, rel_type FROM relates_to),
h AS (SELECT * FROM relates_to QUALIFY row_number() OVER (PARTITION BY src_id, dst_id, rel_type ORDER BY valid_from, rel_id) = 1)
SELECT w.*, rel_id, round(CASE WHEN rel_id IS NULL THEN CAST(CAST(0.9 AS FLOAT) AS DOUBLE) ELSE (confidence * 10.0 + 1.0) / 11.0 END, 6) AS confidence
FROM w LEFT JOIN h ON h.src_id = w.src_id AND h.dst_id = w.dst_id AND h.rel_type = w.rel_type""",
    "process_extraction": """WITH p AS (SELECT name FROM entity WHERE entity_type = 'project'), c AS (SELECT lower(name) AS k FROM p UNION SELECT lower(name || ' way') FROM p
  UNION SELECT 'case: ' || lower(substr(name, 1, list_filter(generate_series(least(60, length(name)), 0, -1), lambda n: strlen(substr(name, 1, n)) <= 60)[1])) FROM p UNION SELECT 'preference: style')
SELECT 'relationships_created' AS what, 0 AS n UNION ALL SELECT 'relationships_failed', (SELECT count(*) FROM p)
UNION ALL SELECT 'estimated_tokens', (SELECT count(*) FROM p) * 2500 + (SELECT count(*) FROM c) * 600""",
    "dedup_candidates_near": f"""WITH ok AS (SELECT *, CAST(embedding AS DOUBLE[384]) AS v FROM entity WHERE len(embedding) = 384
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.entity_id AS candidate, b.entity_id, array_cosine_similarity(a.v, b.v) AS similarity, b.access_count, b.updated_at, b.utility_score FROM ok a JOIN ok b ON true),
best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY similarity DESC, entity_id) <= 5)
SELECT candidate, entity_id, round({_SCORE}, 6) AS score FROM best WHERE {_SCORE} > 0.7""",
    "missing_edges": """WITH a AS (SELECT src_id AS e, rel_type FROM relates_to WHERE valid_until IS NULL UNION SELECT dst_id, rel_type FROM relates_to WHERE valid_until IS NULL)
SELECT src_id AS entity_id, dst_id AS target_id, rel_type FROM relates_to r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.e = r.src_id AND a.rel_type = r.rel_type)""",
    "missing_edges_strict": """WITH a AS (SELECT src_id AS e, dst_id AS o, rel_type FROM relates_to WHERE valid_until IS NULL UNION SELECT dst_id, src_id, rel_type FROM relates_to WHERE valid_until IS NULL)
SELECT src_id AS entity_id, dst_id AS target_id, rel_type FROM relates_to r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.e = r.src_id AND a.o = r.dst_id AND a.rel_type = r.rel_type)""",
    "episode_references": """WITH w AS (SELECT entity_id AS title, access_count % 50 AS n FROM entity UNION ALL SELECT entity_id, 3 FROM entity)
SELECT title, log_number, CAST(archive_id AS VARCHAR) AS episode_id FROM w JOIN archive_result ON log_number = n WHERE log_number > 0""",
    "user_blocks": f"""WITH {_ITEMS}, u AS (SELECT session_id, kind FROM items UNION ALL SELECT session_id, 'user' FROM part WHERE who = 'user' AND t = 'text' AND tx <> '')
SELECT session_id, kind, count(*) AS n FROM u GROUP BY 1, 2""",
    "tool_subjects": r"""WITH l AS (SELECT entry_id, CAST(content AS JSON[]) AS bs FROM transcript_entry WHERE lower(trim(role)) = 'assistant' AND regexp_matches(content, '^\s*\[\s*\{') AND json_valid(content)),
b AS (SELECT entry_id, CAST(generate_subscripts(bs, 1) - 1 AS INTEGER) AS pos, unnest(bs) AS b FROM l), i AS (SELECT entry_id, pos, json_extract(b, '$.input') AS i FROM b WHERE json_extract_string(b, '$.type') = 'tool_use')
SELECT entry_id, pos, coalesce(json_extract_string(i, '$.file_path'), json_extract_string(i, '$.path'), substr(json_extract_string(i, '$.command'), 1, 80), json_extract_string(i, '$.pattern'),
  json_extract_string(i, '$.query'), json_extract_string(i, '$.url'), '') AS subject FROM i WHERE i IS NOT NULL""",
    "line_search_few": f"""WITH {_F}, {_lines('files')} SELECT file, line_num, line FROM lines WHERE contains(lower(line), '{PHRASE}')
QUALIFY row_number() OVER (PARTITION BY file ORDER BY line_num) <= 2""",
    "fences": "SELECT entity_id, trim(coalesce(abstract_text, ''), ' ') AS bare FROM entity",
    "token_estimates": "SELECT entity_type, CAST(sum(access_count) * 2500 + count(*) * 600 AS BIGINT) AS tokens FROM entity GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
