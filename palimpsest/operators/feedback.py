"""Outcome feedback: which retrieved entities helped, and their utility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from .ordering import affine_fold


def contributions(outcomes: DataFrame, retrieved: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Edges (src_id, dst_id, outcome_result, was_used, session_id, timestamp) from each
    retrieved entity to its session's outcome (session_id, outcome, at).  Without
    `used` (session_id, entity_id) all that was retrieved was used."""
    edges = retrieved.select("session_id", "entity_id").join(outcomes, "session_id")
    if used is None:
        edges = edges.withColumn("was_used", F.lit(True))
    else:
        mark = used.select("session_id", "entity_id", F.lit(True).alias("mark")).distinct()
        edges = edges.join(mark, ["session_id", "entity_id"], "left").withColumn("was_used", F.coalesce("mark", F.lit(False)))
    return edges.select(
        F.col("entity_id").alias("src_id"), F.concat(F.lit("entity:outcome-"), "session_id").alias("dst_id"), F.col("outcome").alias("outcome_result"),
        "was_used", "session_id", F.col("at").alias("timestamp"),
    )


def composed(steps: DataFrame) -> DataFrame:
    """(entity_id, keep, add, n): all steps (entity_id, outcome, used and any sortable `at`)
    of an entity, in order, as one: u -> keep u + add.

    Each step is linear, u -> (1 - rate) u + rate goal, with the result inside 0..1 as
    long as the start is, so slices of a hot entity's steps are folded apart."""
    rate = F.when(F.col("used"), F.lit(scoring.USED_RATE)).otherwise(F.lit(scoring.UNUSED_RATE))
    goal = F.when(F.col("used"), scoring.reward(F.col("outcome"))).otherwise(F.lit(scoring.UNUSED_REWARD))
    return affine_fold(steps.select("entity_id", "at", (1.0 - rate).alias("keep"), (rate * goal).alias("add")), "entity_id", "at")


def utilities(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """(entity_id, utility, updates) of starts (entity_id, utility) after the steps, folded in order."""
    return starts.join(composed(steps), "entity_id", "left").select(
        "entity_id",
        F.coalesce(F.col("keep") * F.col("utility") + F.col("add"), F.col("utility")).alias("utility"),
        F.coalesce("n", F.lit(0)).alias("updates"),
    )


def record(entities: DataFrame, outcomes: DataFrame, retrieved: DataFrame, used: DataFrame | None, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(entities, new contributed_to edges) after the outcomes (session_id, outcome, at) of
    sessions that retrieved something: an outcome entity for each, an edge from every
    entity retrieved, and its utility moved, which also counts as an update."""
    told = outcomes.join(retrieved.select("session_id"), "session_id", "left_semi")
    edges = contributions(told, retrieved, used)
    steps = edges.select(F.col("src_id").alias("entity_id"), F.col("outcome_result").alias("outcome"), F.col("was_used").alias("used"), F.struct("timestamp", "session_id").alias("at"))
    new = utilities(entities.select("entity_id", F.coalesce("utility_score", F.lit(0.5)).alias("utility")), steps).select(
        "entity_id", F.col("utility").alias("new_utility"), F.col("updates").alias("more")
    )
    moved = F.col("more") > 0
    out = {
        "utility_score": F.when(moved, F.col("new_utility")).otherwise(F.col("utility_score")), "utility_updates": F.col("utility_updates") + F.col("more"),
        "updated_at": F.when(moved, scoring.literal_time(as_of)).otherwise(F.col("updated_at")),
    }
    changed = entities.join(new, "entity_id").select(*(out.get(c, F.col(c)).alias(c) for c in entities.columns))
    made = told.select(
        F.concat(F.lit("entity:outcome-"), "session_id").alias("entity_id"), F.concat(F.lit("outcome-"), "session_id").alias("name"), F.lit("outcome").alias("entity_type"),
        F.concat(F.lit("Session ended: "), "outcome").alias("abstract_text"), F.lit(False).alias("mutable"), F.lit(0).cast("long").alias("access_count"),
        F.lit(0.5).alias("utility_score"), F.lit(0).cast("long").alias("utility_updates"), scoring.literal_time(as_of).alias("created_at"),
        scoring.literal_time(as_of).alias("updated_at"), F.lit("feedback").alias("source"),
    )
    return changed.unionByName(made, allowMissingColumns=True), edges


def contribution_stats(edges: DataFrame) -> DataFrame:
    """(entity_id, contributions, used, successes, failures) over contributed_to."""
    return edges.groupBy(F.col("src_id").alias("entity_id")).agg(
        F.count("*").alias("contributions"), F.count_if("was_used").alias("used"),
        F.count_if(F.col("outcome_result") == "success").alias("successes"), F.count_if(F.col("outcome_result") == "failed").alias("failures"),
    )


def utility_of(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity_id, utility) of the ids asked for; 0.5 where the entity or its score is unknown."""
    known = entities.select("entity_id", "utility_score")
    return ids.select("entity_id").join(known, "entity_id", "left").select("entity_id", F.coalesce("utility_score", F.lit(0.5)).alias("utility"))


def feedback_report(edges: DataFrame) -> DataFrame:
    """(session_id, edges_created, entities_updated) of the edges record() has made."""
    return edges.groupBy("session_id").agg(F.count("*").alias("edges_created"), F.countDistinct("src_id").alias("entities_updated"))
