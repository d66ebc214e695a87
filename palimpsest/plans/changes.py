"""Queries of look-ups, searches that count, feedback and changes of the graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import feedback, graph, search, state
from ..operators.ordering import positions
from ..schema import is_mutable
from ..session import table
from .graph import _EFF, _NOW, _Q, _SIM, AS_OF, _edges, _entities, _query_vector, _r


def entity_by_id(spark, d):
    first = _entities(spark, d).agg(F.min("entity_id").alias("i")).first()
    return graph.entity_by_id(_entities(spark, d), first["i"]).select("entity_id", "name", "entity_type")


def search_access(spark, d):
    """Access counts after a search."""
    e = _entities(spark, d)
    return search.search_counting(e, _query_vector(e), AS_OF, 20)[1].select("entity_id", "access_count")


def utility_of(spark, d):
    ids = _edges(spark, d).select(F.col("dst_id").alias("entity_id")).distinct().unionByName(spark.createDataFrame([("entity:none",)], "entity_id string"))
    return feedback.utility_of(_entities(spark, d), ids).select("entity_id", _r("utility"))


def decay_of_entity(spark, d):
    hub = _edges(spark, d).groupBy("src_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src_id").first()
    return graph.decay_report(_edges(spark, d), AS_OF, True, hub["src_id"] if hub else "").select("rel_id", _r("stored"), _r("effective"), _r("decay"))


def decay_report_all(spark, d):
    return graph.decay_report(_edges(spark, d), AS_OF, True).select("rel_id", _r("decay"))


def relationships_out(spark, d):
    hub = _edges(spark, d).groupBy("src_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src_id").first()
    ways = [graph.relationships(_edges(spark, d), hub["src_id"] if hub else "", w).select("rel_id", F.lit(w).alias("direction")) for w in ("outgoing", "incoming")]
    return ways[0].unionByName(ways[1])


def delete_relationships(spark, d):
    edges = _edges(spark, d)
    return state.delete_relationships(edges, edges.where("confidence < 0.4").select("rel_id")).select("rel_id")


def set_confidence(spark, d):
    edges = _edges(spark, d)
    changes = edges.where("rel_type = 'CONNECTED_TO' or confidence < 0.4").select("rel_id", F.lit(0.75).alias("confidence"))
    return state.set_confidence(edges, changes, AS_OF).select("rel_id", _r("confidence"), "last_reinforced")


def add_entity(spark, d):
    """The table with every tool added again as an event and as a concept, twice each."""
    e = _entities(spark, d)
    kinds = F.explode(F.array(F.lit("event"), F.lit("concept"), F.lit("event"), F.lit("concept")))
    new = e.where("entity_type = 'tool'").select("name", kinds.alias("entity_type"), "abstract_text", F.lit("again").alias("source"))
    after = state.add_entities(e, new, AS_OF)
    return after.groupBy("name", "entity_type", "mutable").agg(F.count("*").alias("rows"), F.countDistinct("entity_id").alias("ids"), F.max("created_at").alias("newest"))


def priors(spark, d):
    kinds = F.element_at(F.array(*(F.lit(k) for k in ("authoritative", "explicit", "inferred", "speculative", "hearsay"))), (F.length("rel_id") % 5 + 1).cast("int"))
    return _edges(spark, d).select("rel_id", F.round(scoring.prior(kinds), 6).alias("prior"))


def mutability(spark, d):
    return _entities(spark, d).groupBy("entity_type").agg(F.min(is_mutable(F.col("entity_type"))).alias("mutable"), F.max(is_mutable(F.col("entity_type"))).alias("at_most"))


def short_ids(spark, d):
    return _edges(spark, d).select("rel_id", graph.short_id(F.concat(F.lit("relates_to:x:"), "rel_id")).alias("short"))


def ages(spark, d):
    seconds = F.unix_micros(F.lit(AS_OF).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))
    n = F.col("access_count") % 220
    return _entities(spark, d).select(
        "entity_id", text.format_age(F.floor(seconds / 1_000_000)).alias("age"), text.format_age(F.col("access_count") * 20).alias("soon"),
        text.memory_bar(n, 200).alias("bar"), text.memory_word(n, 200).alias("word"),
    )


# Events as outcomes of sessions of one event each, as for contribution_stats.
_OUTCOMES = {"purchase": "success", "click": "partial", "error": "failed"}


def feedback_recorded(spark, d):
    """Utilities of entities after events: each event of a user is about the entity of that place."""
    events = table(spark, d, "events")
    outcome = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in _OUTCOMES.items()), F.lit("partial"))
    outcomes = events.select(F.col("event_id").cast("string").alias("session_id"), outcome.alias("outcome"), F.col("ts").alias("at"))
    numbered = positions(_entities(spark, d).select("entity_id"), "entity_id").select("entity_id", F.col("pos").alias("user_id"))
    retrieved = events.join(numbered, "user_id").select(F.col("event_id").cast("string").alias("session_id"), "entity_id")
    used = retrieved.join(outcomes.where("outcome != 'partial'").select("session_id"), "session_id", "left_semi")
    after, _ = feedback.record(_entities(spark, d), outcomes, retrieved, used, AS_OF)
    return after.where("entity_type != 'outcome' or source is distinct from 'feedback'").select("entity_id", _r("utility_score"), "utility_updates", "updated_at")


def feedback_report(spark, d):
    events = table(spark, d, "events")
    outcomes = events.groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.lit("success").alias("outcome"), F.max("ts").alias("at"))
    retrieved = events.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("entity_id"))
    return feedback.feedback_report(feedback.contributions(outcomes, retrieved))


_HUB = "hub AS (SELECT src_id AS h FROM relates_to GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_AGE = lambda s: f"CASE WHEN {s} < 60 THEN 'just now' WHEN {s} < 3600 THEN {s} // 60 || 'm ago' WHEN {s} < 86400 THEN {s} // 3600 || 'h ago' ELSE {s} // 86400 || 'd ago' END"

SQL = {
    "entity_by_id": "SELECT entity_id, name, entity_type FROM entity ORDER BY entity_id LIMIT 1",
    "search_access": f"""WITH {_Q}, {_SIM}, hits AS (SELECT entity_id FROM sim ORDER BY similarity DESC, entity_id LIMIT 20)
SELECT entity_id, access_count + CASE WHEN entity_id IN (SELECT entity_id FROM hits) THEN 1 ELSE 0 END AS access_count FROM entity""",
    "utility_of": """SELECT i.entity_id, round(coalesce(utility_score, 0.5), 6) AS utility FROM (SELECT DISTINCT dst_id AS entity_id FROM relates_to UNION ALL SELECT 'entity:none') i
LEFT JOIN entity e ON e.entity_id = i.entity_id""",
    "decay_of_entity": f"""WITH {_HUB} SELECT rel_id, round(confidence, 6) AS stored, round({_EFF}, 6) AS effective, round(confidence - {_EFF}, 6) AS decay
FROM relates_to, hub WHERE src_id = h OR dst_id = h""",
    "decay_report_all": f"SELECT rel_id, round(confidence - {_EFF}, 6) AS decay FROM relates_to WHERE valid_until IS NULL",
    "relationships_out": f"""WITH {_HUB} SELECT rel_id, 'outgoing' AS direction FROM relates_to, hub WHERE src_id = h
UNION ALL SELECT rel_id, 'incoming' FROM relates_to, hub WHERE dst_id = h""",
    "delete_relationships": "SELECT rel_id FROM relates_to WHERE NOT confidence < 0.4",
    "set_confidence": f"""SELECT rel_id, CASE WHEN rel_type = 'CONNECTED_TO' OR confidence < 0.4 THEN 0.75 ELSE round(confidence, 6) END AS confidence,
  CASE WHEN rel_type = 'CONNECTED_TO' OR confidence < 0.4 THEN {_NOW} ELSE last_reinforced END AS last_reinforced FROM relates_to""",
    "add_entity": f"""WITH every AS (SELECT entity_id, name, entity_type, mutable, created_at FROM entity
  UNION ALL SELECT 'new:' || entity_id || k, name, t, t = 'concept', {_NOW} FROM entity, (VALUES (1, 'event'), (2, 'concept'), (3, 'event'), (4, 'concept')) v(k, t) WHERE entity_type = 'tool')
SELECT name, entity_type, mutable, count(*) AS rows, count(DISTINCT entity_id) AS ids, max(created_at) AS newest FROM every GROUP BY 1, 2, 3""",
    "priors": "SELECT rel_id, [1.0, 0.9, 0.6, 0.3, 0.6][length(rel_id) % 5 + 1]::DOUBLE AS prior FROM relates_to",
    "mutability": """SELECT entity_type, entity_type NOT IN ('decision', 'event', 'case', 'observation', 'measurement', 'outcome') AS mutable,
  entity_type NOT IN ('decision', 'event', 'case', 'observation', 'measurement', 'outcome') AS at_most FROM entity GROUP BY 1""",
    "short_ids": "SELECT rel_id, split_part(rel_id, ':', -1) AS short FROM relates_to",
    "ages": f"""WITH a AS (SELECT entity_id, (epoch_us({_NOW}) - epoch_us(updated_at)) // 1000000 AS s, access_count * 20 AS t, access_count % 220 AS n FROM entity)
SELECT entity_id, {_AGE('s')} AS age, {_AGE('t')} AS soon, repeat('█', CAST(least(10, n * 10 // 200) AS INTEGER)) || repeat('░', CAST(10 - least(10, n * 10 // 200) AS INTEGER)) AS bar,
  CASE WHEN n > 180 THEN 'full' WHEN n > 150 THEN 'warning' ELSE 'ok' END AS word FROM a""",
    "feedback_recorded": f"""WITH s AS (SELECT e.entity_id, list(CASE event_type WHEN 'purchase' THEN [0.9, 0.1] WHEN 'error' THEN [0.9, 0.0] ELSE [0.95, 0.015] END
    ORDER BY ts, CAST(event_id AS VARCHAR)) AS l, count(*) AS n FROM events JOIN (SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS k FROM entity) e ON k = user_id GROUP BY 1)
SELECT e.entity_id, round(CASE WHEN l IS NULL THEN utility_score ELSE list_reduce(list_prepend([coalesce(utility_score, 0.5), 0.0]::DOUBLE[], l::DOUBLE[][]), lambda u, x: [u[1] * x[1] + x[2], 0.0]::DOUBLE[])[1] END, 6) AS utility_score,
  utility_updates + coalesce(n, 0) AS utility_updates, CASE WHEN l IS NULL THEN updated_at ELSE {_NOW} END AS updated_at FROM entity e LEFT JOIN s ON s.entity_id = e.entity_id""",
    "feedback_report": "SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS edges_created, count(DISTINCT event_type) AS entities_updated FROM events GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
