"""Queries over entity, relates_to and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import feedback, gc, graph, ingest, search, state

from ..session import table
from ..streaming import streams

AS_OF = "2020-02-20 12:00:00"
_NOW = f"TIMESTAMP '{AS_OF}'"


def _r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relates_to")


def _query_vector(entities: DataFrame):
    """The vector of the first entity of full width, as a literal."""
    row = entities.where("size(embedding) = 384 and not exists(embedding, x -> x is null or isnan(x)) and exists(embedding, x -> x != 0)").orderBy("entity_id").select("embedding").first()
    return search.literal_vector(row[0] if row else None)


# Shared pieces of SQL.
_Q = """q AS (
  SELECT CAST(embedding AS DOUBLE[384]) AS v FROM entity
  WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  ORDER BY entity_id LIMIT 1
)"""
_SIM = """sim AS (
  SELECT e.*, array_cosine_similarity(CAST(e.embedding AS DOUBLE[384]), q.v) AS similarity
  FROM (SELECT * FROM entity WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0) e, q
)"""
_HOT = f"((1.0 + access_count) / (2.0 + access_count) * pow(0.5, date_sub('hour', updated_at, {_NOW}) / 24.0 / 7.0))"
_SCORE = f"(0.45 * similarity + 0.30 * {_HOT} + 0.25 * coalesce(utility_score, 0.5))"
_DAYS = f"(date_sub('hour', coalesce(last_reinforced, valid_from), {_NOW}) / 24.0)"
_EFF = f"(CASE WHEN {_DAYS} IS NULL OR {_DAYS} <= 0 THEN confidence ELSE greatest(confidence * pow(0.5, {_DAYS} / 90.0), 0.05) END)"
_AGE = f"date_sub('day', valid_from, {_NOW})"
_STEPS = f"""steps AS (
  SELECT src_id AS at, dst_id AS "to", 0 AS way, rel_id, {_EFF} AS eff FROM relates_to WHERE valid_until IS NULL AND {_EFF} >= 0.1
  UNION ALL SELECT dst_id, src_id, 1, rel_id, {_EFF} FROM relates_to WHERE valid_until IS NULL AND {_EFF} >= 0.1 AND src_id <> dst_id
)"""
_STAGED = """staged AS (
  SELECT *, json_extract_string(attributes, '$.pipeline_stage') AS stage, json_extract_string(attributes, '$.pipeline_status') AS status,
    json_extract_string(attributes, '$.sub_type') AS sub_type FROM entity
)"""
_PIPE = "(coalesce(starts_with(source, 'pipeline:'), false) OR coalesce(list_contains(json_keys(attributes), 'pipeline_stage'), false))"
_LABELS = f"""labels AS (
  SELECT *, CASE WHEN valid_until IS NULL AND {_EFF} < 0.5 AND {_AGE} >= 30 THEN 'stale' WHEN {_EFF} < 0.2 AND {_AGE} >= 14 THEN 'dead' END AS kind FROM relates_to
), orphan AS (
  SELECT entity_id FROM entity WHERE access_count = 0 AND NOT {_PIPE}
    AND entity_id NOT IN (SELECT src_id FROM labels WHERE kind IS NULL UNION SELECT dst_id FROM labels WHERE kind IS NULL)
)"""


def knn_search(spark, d):
    e = _entities(spark, d)
    return search.search(e, _query_vector(e), AS_OF, 20).select("entity_id", "name", _r("similarity"), _r("score"))


def knn_filtered(spark, d):
    e = _entities(spark, d)
    return search.search(e, _query_vector(e), AS_OF, 20, entity_type="tool", keyword="run").select("entity_id", "name", _r("similarity"), _r("score"))


def knn_prefiltered(spark, d):
    e = _entities(spark, d)
    return search.search(e, _query_vector(e), AS_OF, 20, entity_type="tool", rank_by="score", prefilter=True).select("entity_id", _r("similarity"), _r("score"))


def hybrid_query(spark, d):
    e = _entities(spark, d)
    return search.hybrid(e, _edges(spark, d), _query_vector(e), AS_OF, 20).select("entity_id", "found_by", _r("score"))


def hybrid_depth0(spark, d):
    e = _entities(spark, d)
    return search.hybrid(e, _edges(spark, d), _query_vector(e), AS_OF, 20, depth=0).select("entity_id", "found_by", _r("score"))


def edge_effective_confidence(spark, d):
    return _edges(spark, d).select("rel_id", F.round(scoring.edge_confidence(AS_OF), 6).alias("effective"))


def decay_report(spark, d):
    return graph.decay_report(_edges(spark, d), AS_OF).select("rel_id", _r("stored"), _r("effective"), _r("decay"))


def decay_summary(spark, d):
    return graph.decay_summary(_edges(spark, d), AS_OF).select("edges", "decayed", _r("average_decay"))


def entity_hotness(spark, d):
    hot = scoring.hotness(F.col("access_count"), F.col("updated_at"), AS_OF)
    return _entities(spark, d).select("entity_id", F.round(hot, 6).alias("hotness"))


def bayes_reinforce(spark, d):
    # Each event of a user is an observation of the edge its number falls on.
    edges = _edges(spark, d)
    numbered = edges.select("rel_id", F.regexp_extract("rel_id", r"(\d+)$", 1).cast("long").alias("k"))
    seen = table(spark, d, "events").select(
        F.col("user_id").alias("k"), F.struct("ts", "event_id").alias("seq"), (F.col("event_type") != "error").alias("corroborates")
    )
    obs = seen.join(numbered, "k").select("rel_id", "seq", "corroborates")
    return state.reinforce(edges, obs, AS_OF).select("rel_id", _r("confidence"), "last_reinforced")


def graph_stats(spark, d):
    return graph.stats(_entities(spark, d), _edges(spark, d), table(spark, d, "archive_result"))


def entity_type_counts(spark, d):
    return graph.type_counts(_entities(spark, d))


def entities_by_type(spark, d):
    return _entities(spark, d).where("entity_type = 'tool'").select("entity_id", "name").orderBy("name", "entity_id")


def entity_by_name(spark, d):
    return graph.first_by_name(_entities(spark, d))


def entity_summaries(spark, d):
    return graph.summaries(_entities(spark, d))


def stage_counts(spark, d):
    return graph.stage_counts(_entities(spark, d))


def stage_entities(spark, d):
    return graph.stage_entities(_entities(spark, d), "thoughts", "active").select("entity_id", "name", "updated_at")


def degree(spark, d):
    return graph.degrees(_edges(spark, d))


def relationships_of(spark, d):
    hub = _edges(spark, d).groupBy("src_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src_id").first()
    return graph.relationships(_edges(spark, d), hub["src_id"] if hub else "", "both").select("rel_id", "src_id", "dst_id", "rel_type")


def one_hop(spark, d):
    return graph.one_hop(_edges(spark, d), _entities(spark, d).where("entity_type = 'person'"), AS_OF).select(
        "entity_id", "neighbour_id", "rel_id", "way", _r("effective")
    )


def _k_hop(spark, d, k):
    seeds = _entities(spark, d).where("entity_type = 'person'").select("entity_id")
    return graph.k_hop(_edges(spark, d), seeds, k, AS_OF).select("entity_id", "hops", _r("confidence"))


def k_hop_2(spark, d):
    return _k_hop(spark, d, 2)


def k_hop_3(spark, d):
    return _k_hop(spark, d, 3)


def path_confidence(spark, d):
    return graph.path_confidences(_edges(spark, d), AS_OF).select("first_id", "last_id", _r("confidence"))


def gc_candidates(spark, d):
    return gc.candidates(_entities(spark, d), _edges(spark, d), AS_OF)


def gc_report(spark, d):
    return gc.report(_entities(spark, d), _edges(spark, d), AS_OF)


def gc_collect(spark, d):
    e, r = gc.collect(_entities(spark, d), _edges(spark, d), AS_OF)
    return e.select(F.lit("entity").alias("what"), F.col("entity_id").alias("id")).unionByName(r.select(F.lit("relates_to").alias("what"), F.col("rel_id").alias("id")))


def gc_health(spark, d):
    return gc.health(_entities(spark, d), _edges(spark, d), AS_OF)


def pipeline_stale(spark, d):
    return graph.stale(_entities(spark, d), _edges(spark, d), AS_OF, 7).select("entity_id", "kind")


def pipeline_orphans(spark, d):
    return graph.orphans(_entities(spark, d), _edges(spark, d)).select("entity_id")


def pipeline_movement(spark, d):
    return graph.last_movement(_entities(spark, d))


def pipeline_flow(spark, d):
    return graph.flow(_entities(spark, d), _edges(spark, d))


def access_increment(spark, d):
    e = _entities(spark, d)
    hits = _edges(spark, d).select(F.col("dst_id").alias("entity_id"))
    return state.count_access(e, hits).select("entity_id", "access_count")


def supersede(spark, d):
    edges = _edges(spark, d)
    weak = edges.where("valid_until is null and confidence < 0.3")
    new = weak.select(
        F.col("rel_id").alias("old_id"), F.concat(F.lit("new:"), "rel_id").alias("rel_id"), "src_id", "dst_id", "rel_type", "description",
        F.lit(0.6).alias("confidence"), F.lit("correction").alias("source"),
    )
    return state.supersede(edges, new, AS_OF).select("rel_id", "valid_from", "valid_until", _r("confidence"))


def delete_entity(spark, d):
    e, r = state.delete_entities(_entities(spark, d), _edges(spark, d), _entities(spark, d).where("entity_type = 'person'"))
    return e.select(F.lit("entity").alias("what"), F.col("entity_id").alias("id")).unionByName(r.select(F.lit("relates_to").alias("what"), F.col("rel_id").alias("id")))


def update_entity(spark, d):
    e = _entities(spark, d)
    changes = e.where("overview is null or entity_type = 'tool'").select("entity_id", F.concat(F.lit("seen as "), "name").alias("overview"), F.lit('{"checked": true}').alias("attributes"))
    return state.update_entities(e, changes, AS_OF).select("entity_id", "overview", "attributes", "updated_at")


def json_merge(spark, d):
    merged = state.merge_json(F.col("attributes"), F.lit('{"pipeline_status": "seen", "n": 1}'))
    rows = _entities(spark, d).where("attributes is not null").select("entity_id", merged.alias("m"))
    return rows.select(
        "entity_id", F.get_json_object("m", "$.pipeline_status").alias("status"), F.get_json_object("m", "$.n").alias("n"),
        F.get_json_object("m", "$.sub_type").alias("sub_type"), F.get_json_object("m", "$.pipeline_stage").alias("stage"),
    )


def add_relationship(spark, d):
    e = _entities(spark, d)
    wanted = e.where("entity_type = 'question'").select(
        F.col("name").alias("from_name"), F.when(F.col("access_count") % 2 == 0, F.lit("no such name")).otherwise(F.col("name")).alias("to_name"),
        F.lit("PROMPTED_BY").alias("rel_type"), F.lit(None).cast("string").alias("description"), F.lit(0.9).alias("confidence"), F.lit("test").alias("source"),
    )
    table_, rejected = state.add_relationships(_edges(spark, d), e, wanted, AS_OF)
    return table_.select("src_id", "dst_id", _r("confidence")).unionByName(
        rejected.select(F.lit("rejected").alias("src_id"), F.col("to_name").alias("dst_id"), F.round("confidence", 6).alias("confidence"))
    )


# Events as outcomes: purchase success, click partial, error failed; others were retrieved but not used.
_OUTCOMES = {"purchase": "success", "click": "partial", "error": "failed"}


def _feedback_steps(spark, d):
    events = table(spark, d, "events")
    outcome = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in _OUTCOMES.items()))
    return events.select(F.col("user_id").alias("entity_id"), outcome.alias("outcome"), outcome.isNotNull().alias("used"), F.struct("ts", "event_id").alias("at"))


def utility_feedback(spark, d):
    starts = table(spark, d, "embeddings").select(F.col("vec_id").alias("entity_id"), F.lit(0.5).alias("utility"))
    return feedback.utilities(starts, _feedback_steps(spark, d)).select("entity_id", _r("utility"), "updates")


def contribution_stats(spark, d):
    events = table(spark, d, "events").withColumn("session_id", F.col("event_id").cast("string"))
    outcome = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in _OUTCOMES.items()), F.lit("partial"))
    outcomes = events.select("session_id", outcome.alias("outcome"), F.col("ts").alias("at"))
    retrieved = events.select("session_id", F.col("user_id").cast("string").alias("entity_id"))
    used = retrieved.join(events.where(F.col("event_type").isin(*_OUTCOMES)).select("session_id"), "session_id", "left_semi")
    return feedback.contribution_stats(feedback.contributions(outcomes, retrieved, used))


def dedup_candidates(spark, d):
    """Stored entities that the questions, taken as candidates, resemble."""
    e = _entities(spark, d)
    asked = e.where("entity_type = 'question' and size(embedding) = 384").select(F.col("entity_id").alias("candidate"), "embedding")
    return ingest.similar_entities(asked, e.where("entity_type != 'question'"), AS_OF, "candidate", 5, 0.3).select("candidate", "entity_id", _r("similarity"), _r("score"))


def gap_sessions(spark, d):
    rows = streams.gap_sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "events")


def tpch_edge_health(spark, d):
    """Orders as edges customer -> part: counts of active, traversable and faded ones."""
    edges = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        (1 - 9 * F.col("l_discount")).alias("confidence"), F.col("o_orderdate").alias("valid_from"),
        F.when(F.col("l_shipdate") > F.col("o_orderdate"), F.col("l_shipdate")).alias("last_reinforced"),
        (F.col("l_returnflag") != "R").alias("active"), "l_linestatus",
    )
    eff = scoring.edge_confidence("2001-12-01 00:00:00")
    return edges.groupBy(F.col("l_linestatus").alias("rel_type")).agg(
        F.count("*").alias("edges"), F.count_if("active").alias("active"), F.count_if(F.col("active") & (eff >= 0.1)).alias("traversable"),
        F.round(F.avg(eff), 6).alias("average"),
    )


_NAMED = "named AS (SELECT name, entity_id, mutable FROM entity QUALIFY row_number() OVER (PARTITION BY name ORDER BY created_at, entity_id) = 1)"


def _hops(k: int) -> str:
    levels = ["h0 AS (SELECT entity_id, 0 AS hops, 1.0::DOUBLE AS c FROM entity WHERE entity_type = 'person')"]
    for i in range(1, k + 1):
        seen = " UNION ALL ".join(f"SELECT entity_id FROM h{j}" for j in range(i))
        levels.append(
            f"""h{i} AS (SELECT s."to" AS entity_id, {i} AS hops, max(h.c * s.eff) AS c FROM h{i - 1} h JOIN steps s ON s.at = h.entity_id
              WHERE s."to" NOT IN ({seen}) GROUP BY 1)"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM h{j}" for j in range(k + 1))
    return f"WITH {_STEPS}, " + ", ".join(levels) + f" SELECT entity_id, hops, round(c, 6) AS confidence FROM ({every})"


SQL = {
    "knn_search": f"WITH {_Q}, {_SIM} SELECT entity_id, name, round(similarity, 6) AS similarity, round({_SCORE}, 6) AS score FROM sim ORDER BY similarity DESC, entity_id LIMIT 20",
    "knn_filtered": f"""WITH {_Q}, {_SIM}, hits AS (SELECT * FROM sim ORDER BY similarity DESC, entity_id LIMIT 80)
SELECT entity_id, name, round(similarity, 6) AS similarity, round({_SCORE}, 6) AS score FROM hits
WHERE entity_type = 'tool' AND (contains(lower(name), 'run') OR contains(lower(abstract_text), 'run')) ORDER BY hits.similarity DESC, entity_id LIMIT 20""",
    "knn_prefiltered": f"""WITH {_Q}, {_SIM}, hits AS (SELECT * FROM sim WHERE entity_type = 'tool' ORDER BY similarity DESC, entity_id LIMIT 20)
SELECT entity_id, round(similarity, 6) AS similarity, round({_SCORE}, 6) AS score FROM hits""",
    "hybrid_query": f"""WITH {_Q}, {_SIM}, {_STEPS}, seeds AS (
  SELECT entity_id, {_SCORE} AS score FROM (SELECT * FROM sim ORDER BY similarity DESC, entity_id LIMIT 40)
), best AS (SELECT * FROM seeds ORDER BY score DESC, entity_id LIMIT 3),
near AS (
  SELECT s."to" AS entity_id, b.score * s.eff AS score FROM steps s JOIN best b ON s.at = b.entity_id
  WHERE s."to" NOT IN (SELECT entity_id FROM seeds)
  QUALIFY row_number() OVER (PARTITION BY s."to" ORDER BY b.score DESC, b.entity_id, s.way, s.rel_id) = 1
), every AS (
  SELECT entity_id, 'semantic' AS found_by, score FROM seeds UNION ALL SELECT entity_id, 'graph', score FROM near WHERE entity_id IN (SELECT entity_id FROM entity)
) SELECT entity_id, found_by, round(score, 6) AS score FROM every ORDER BY every.score DESC, entity_id LIMIT 20""",
    "hybrid_depth0": f"""WITH {_Q}, {_SIM}, seeds AS (
  SELECT entity_id, {_SCORE} AS score FROM (SELECT * FROM sim ORDER BY similarity DESC, entity_id LIMIT 40)
) SELECT entity_id, 'semantic' AS found_by, round(score, 6) AS score FROM seeds ORDER BY seeds.score DESC, entity_id LIMIT 20""",
    "edge_effective_confidence": f"SELECT rel_id, round({_EFF}, 6) AS effective FROM relates_to",
    "decay_report": f"""SELECT rel_id, round(confidence, 6) AS stored, round({_EFF}, 6) AS effective, round(confidence - {_EFF}, 6) AS decay
FROM relates_to WHERE valid_until IS NULL AND confidence - {_EFF} >= 0.001""",
    "decay_summary": f"""SELECT count(*) AS edges, count(*) FILTER (confidence - {_EFF} > 0.001) AS decayed, round(avg(confidence - {_EFF}), 6) AS average_decay
FROM relates_to WHERE valid_until IS NULL""",
    "entity_hotness": f"SELECT entity_id, round({_HOT}, 6) AS hotness FROM entity",
    "bayes_reinforce": f"""WITH obs AS (
  SELECT r.rel_id, list(CASE WHEN e.event_type <> 'error' THEN 1.0 ELSE 0.0 END ORDER BY e.ts, e.event_id) AS o
  FROM relates_to r JOIN events e ON e.user_id = CAST(regexp_extract(r.rel_id, '([0-9]+)$', 1) AS BIGINT) GROUP BY 1
) SELECT r.rel_id, round(CASE WHEN o IS NULL THEN confidence ELSE list_reduce(list_prepend(confidence::DOUBLE, o), lambda c, x: (c * 10.0 + x) / 11.0) END, 6) AS confidence,
  CASE WHEN o IS NULL THEN last_reinforced ELSE {_NOW} END AS last_reinforced
FROM relates_to r LEFT JOIN obs ON obs.rel_id = r.rel_id""",
    "graph_stats": """SELECT 'entity' AS what, count(*) AS n FROM entity UNION ALL SELECT 'relates_to', count(*) FROM relates_to
UNION ALL SELECT 'episode', count(*) FROM archive_result""",
    "entity_type_counts": "SELECT entity_type, count(*) AS n FROM entity GROUP BY 1",
    "entities_by_type": "SELECT entity_id, name FROM entity WHERE entity_type = 'tool'",
    "entity_by_name": f"WITH {_NAMED} SELECT name, entity_id FROM named",
    "entity_summaries": "SELECT entity_id, name, entity_type, abstract_text FROM entity",
    "stage_counts": f"WITH {_STAGED} SELECT stage, coalesce(status, 'unknown') AS status, count(*) AS n FROM staged WHERE stage IS NOT NULL GROUP BY 1, 2",
    "stage_entities": f"WITH {_STAGED} SELECT entity_id, name, updated_at FROM staged WHERE stage = 'thoughts' AND status = 'active'",
    "degree": """SELECT entity_id, count(*) AS degree FROM (
  SELECT src_id AS entity_id FROM relates_to UNION ALL SELECT dst_id FROM relates_to WHERE src_id <> dst_id) GROUP BY 1""",
    "relationships_of": """WITH hub AS (SELECT src_id AS h FROM relates_to GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT rel_id, src_id, dst_id, rel_type FROM relates_to, hub WHERE src_id = h OR dst_id = h""",
    "one_hop": f"""WITH {_STEPS} SELECT steps."at" AS entity_id, "to" AS neighbour_id, rel_id, way, round(eff, 6) AS effective
FROM steps WHERE steps."at" IN (SELECT entity_id FROM entity WHERE entity_type = 'person')""",
    "k_hop_2": _hops(2),
    "k_hop_3": _hops(3),
    "path_confidence": f"""WITH e AS (SELECT src_id, dst_id, {_EFF} AS eff FROM relates_to WHERE valid_until IS NULL AND {_EFF} >= 0.1)
SELECT a.src_id AS first_id, b.dst_id AS last_id, round(max(a.eff * b.eff), 6) AS confidence FROM e a JOIN e b ON a.dst_id = b.src_id
WHERE a.src_id <> b.dst_id AND a.dst_id <> a.src_id AND a.dst_id <> b.dst_id GROUP BY 1, 2""",
    "gc_candidates": f"WITH {_LABELS} SELECT kind, rel_id AS id FROM labels WHERE kind IS NOT NULL UNION ALL SELECT 'orphan', entity_id FROM orphan",
    "gc_report": f"""WITH {_LABELS} SELECT kind, count(*) AS n FROM (
  SELECT kind FROM labels WHERE kind IS NOT NULL UNION ALL SELECT 'orphan' FROM orphan) GROUP BY 1""",
    "gc_collect": f"""WITH {_LABELS} SELECT 'entity' AS what, entity_id AS id FROM entity WHERE entity_id NOT IN (SELECT entity_id FROM orphan)
UNION ALL SELECT 'relates_to', rel_id FROM labels WHERE kind IS NULL""",
    "gc_health": f"""SELECT e.*, r.* FROM (
  SELECT count(*) AS total_entities, count(*) FILTER ({_PIPE}) AS pipeline_entities, count(*) FILTER (access_count = 0) AS zero_access_entities FROM entity) e, (
  SELECT count(*) AS total_relationships, count(*) FILTER ({_EFF} < 0.5) AS low_confidence, count(*) FILTER ({_EFF} < 0.2) AS very_low_confidence,
    count(*) FILTER (valid_until IS NOT NULL) AS superseded FROM relates_to) r""",
    "pipeline_stale": f"""WITH {_STAGED}, fresh AS (
  SELECT id, max(valid_from) AS latest FROM (SELECT src_id AS id, valid_from FROM relates_to UNION ALL SELECT dst_id, valid_from FROM relates_to) GROUP BY 1
) SELECT entity_id, CASE stage WHEN 'thoughts' THEN 'thought' ELSE 'question' END AS kind
FROM staged LEFT JOIN fresh ON id = entity_id
WHERE status = 'active' AND (
  (stage = 'thoughts' AND updated_at < {_NOW} - INTERVAL 7 DAY AND coalesce(latest <= {_NOW} - INTERVAL 7 DAY, true))
  OR (stage = 'curiosity' AND sub_type IS NULL AND updated_at < {_NOW} - INTERVAL 14 DAY AND coalesce(latest <= {_NOW} - INTERVAL 14 DAY, true)))""",
    "pipeline_orphans": f"""WITH {_STAGED} SELECT entity_id FROM staged WHERE stage IS NOT NULL AND status = 'active'
AND entity_id NOT IN (SELECT src_id FROM relates_to UNION SELECT dst_id FROM relates_to)""",
    "pipeline_movement": f"WITH {_STAGED} SELECT max(updated_at) AS last_movement FROM staged WHERE status IN ('graduated', 'dissolved', 'explored')",
    "pipeline_flow": """SELECT rel_id, a.name AS source, rel_type, b.name AS target FROM relates_to
JOIN entity a ON a.entity_id = src_id JOIN entity b ON b.entity_id = dst_id
WHERE valid_until IS NULL AND rel_type IN ('EVOLVED_FROM', 'CRYSTALLIZED_FROM', 'INFORMED_BY', 'EXPLORES', 'GRADUATED_TO', 'ARCHIVED_FROM', 'CONNECTED_TO')""",
    "access_increment": """SELECT e.entity_id, access_count + coalesce(n, 0) AS access_count FROM entity e
LEFT JOIN (SELECT dst_id, count(*) AS n FROM relates_to GROUP BY 1) h ON h.dst_id = e.entity_id""",
    "supersede": f"""SELECT rel_id, valid_from, CASE WHEN valid_until IS NULL AND confidence < 0.3 THEN {_NOW} ELSE valid_until END AS valid_until, round(confidence, 6) AS confidence
FROM relates_to UNION ALL SELECT 'new:' || rel_id, {_NOW}, NULL, 0.6 FROM relates_to WHERE valid_until IS NULL AND confidence < 0.3""",
    "delete_entity": """WITH gone AS (SELECT entity_id FROM entity WHERE entity_type = 'person')
SELECT 'entity' AS what, entity_id AS id FROM entity WHERE entity_id NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'relates_to', rel_id FROM relates_to WHERE src_id NOT IN (SELECT * FROM gone) AND dst_id NOT IN (SELECT * FROM gone)""",
    "update_entity": f"""SELECT entity_id, CASE WHEN hit THEN 'seen as ' || name ELSE overview END AS overview, CASE WHEN hit THEN '{{"checked": true}}' ELSE attributes END AS attributes,
  CASE WHEN hit THEN {_NOW} ELSE updated_at END AS updated_at FROM (SELECT *, overview IS NULL OR entity_type = 'tool' AS hit FROM entity)""",
    "json_merge": """WITH m AS (SELECT entity_id, json_merge_patch(attributes::JSON, '{"pipeline_status": "seen", "n": 1}'::JSON) AS m FROM entity WHERE attributes IS NOT NULL)
SELECT entity_id, json_extract_string(m, '$.pipeline_status') AS status, json_extract_string(m, '$.n') AS n,
  json_extract_string(m, '$.sub_type') AS sub_type, json_extract_string(m, '$.pipeline_stage') AS stage FROM m""",
    "add_relationship": f"""WITH {_NAMED}, wanted AS (
  SELECT name AS f, CASE WHEN access_count % 2 = 0 THEN 'no such name' ELSE name END AS t FROM entity WHERE entity_type = 'question'
) SELECT coalesce(CASE WHEN b.entity_id IS NOT NULL THEN a.entity_id END, 'rejected') AS src_id, coalesce(b.entity_id, t) AS dst_id,
  round(CASE WHEN b.entity_id IS NULL THEN 0.9 ELSE CAST(CAST(0.9 AS FLOAT) AS DOUBLE) END, 6) AS confidence
FROM wanted LEFT JOIN named a ON a.name = f LEFT JOIN named b ON b.name = t
UNION ALL SELECT src_id, dst_id, round(confidence, 6) FROM relates_to""",
    "utility_feedback": """WITH steps AS (
  SELECT user_id, list(CASE event_type WHEN 'purchase' THEN [0.9, 0.1] WHEN 'click' THEN [0.9, 0.05] WHEN 'error' THEN [0.9, 0.0] ELSE [0.95, 0.015] END
    ORDER BY ts, event_id) AS s, count(*) AS n FROM events GROUP BY 1
) SELECT vec_id AS entity_id, round(CASE WHEN s IS NULL THEN 0.5
    ELSE list_reduce(list_prepend([0.5, 0.0]::DOUBLE[], s::DOUBLE[][]), lambda u, x: [u[1] * x[1] + x[2], 0.0]::DOUBLE[])[1] END, 6) AS utility, coalesce(n, 0) AS updates
FROM embeddings LEFT JOIN steps ON user_id = vec_id""",
    "contribution_stats": """SELECT CAST(user_id AS VARCHAR) AS entity_id, count(*) AS contributions, count(*) FILTER (event_type IN ('purchase', 'click', 'error')) AS used,
  count(*) FILTER (event_type = 'purchase') AS successes, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1""",
    "dedup_candidates": f"""WITH ok AS (SELECT *, CAST(embedding AS DOUBLE[384]) AS v FROM entity WHERE len(embedding) = 384
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.entity_id AS candidate, b.entity_id, array_cosine_similarity(a.v, b.v) AS similarity, b.access_count, b.updated_at, b.utility_score
  FROM ok a JOIN ok b ON a.entity_type = 'question' AND b.entity_type <> 'question'),
best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY similarity DESC, entity_id) <= 5)
SELECT candidate, entity_id, round(similarity, 6) AS similarity, round({_SCORE}, 6) AS score FROM best WHERE {_SCORE} > 0.3""",
    "gap_sessions": """WITH m AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS fresh, event_id FROM events),
n AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
SELECT user_id, min(ts) AS start, count(*) AS events FROM n GROUP BY user_id, k""",
    "tpch_edge_health": """WITH e AS (SELECT 1 - 9 * l_discount AS c, l_returnflag <> 'R' AS active, l_linestatus,
  date_sub('hour', CASE WHEN l_shipdate > o_orderdate THEN l_shipdate ELSE o_orderdate END, TIMESTAMP '2001-12-01') / 24.0 AS days
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), f AS (SELECT *, CASE WHEN days <= 0 THEN c ELSE greatest(c * pow(0.5, days / 90.0), 0.05) END AS eff FROM e)
SELECT l_linestatus AS rel_type, count(*) AS edges, count(*) FILTER (active) AS active, count(*) FILTER (active AND eff >= 0.1) AS traversable, round(avg(eff), 6) AS average
FROM f GROUP BY 1""",
}

QUERIES = {name: globals()[name] for name in SQL}
