"""Finding knowledge that has gone stale: edges to close out, entities nobody needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring


@dataclass(frozen=True)
class Limits:
    stale_days: int = 30
    stale_confidence: float = 0.5
    dead_days: int = 14
    dead_confidence: float = 0.2


def is_pipeline() -> Column:
    """Protected: from the pipeline by its source, or with a stage among its attributes."""
    keys = F.coalesce(F.json_object_keys("attributes"), F.array().cast("array<string>"))
    return F.coalesce(F.col("source").startswith("pipeline:"), F.lit(False)) | F.array_contains(keys, "pipeline_stage")


def label_edges(edges: DataFrame, as_of: str, limits: Limits = Limits()) -> DataFrame:
    """Every edge with `effective`, `age_days` and `kind`: stale (active, faint and
    old enough), else dead (fainter, superseded ones too), else null."""
    rows = edges.withColumn("effective", scoring.edge_confidence(as_of)).withColumn("age_days", scoring.whole_days(F.col("valid_from"), as_of))
    stale = F.col("valid_until").isNull() & (F.col("effective") < limits.stale_confidence) & (F.col("age_days") >= limits.stale_days)
    dead = (F.col("effective") < limits.dead_confidence) & (F.col("age_days") >= limits.dead_days)
    return rows.withColumn("kind", F.when(stale, "stale").when(dead, "dead"))


def orphaned(entities: DataFrame, labelled: DataFrame) -> DataFrame:
    """Entities never accessed, not protected, and at no edge that would survive."""
    kept = labelled.where("kind is null")
    ends = kept.select(F.col("src_id").alias("entity_id")).unionByName(kept.select(F.col("dst_id").alias("entity_id")))
    return entities.where("access_count = 0").where(~is_pipeline()).join(ends, "entity_id", "left_anti")


def candidates(entities: DataFrame, edges: DataFrame, as_of: str, limits: Limits = Limits()) -> DataFrame:
    """(kind, id): all that a run would remove."""
    labelled = label_edges(edges, as_of, limits)
    gone = labelled.where("kind is not null").select("kind", F.col("rel_id").alias("id"))
    return gone.unionByName(orphaned(entities, labelled).select(F.lit("orphan").alias("kind"), F.col("entity_id").alias("id")))


def report(entities: DataFrame, edges: DataFrame, as_of: str, limits: Limits = Limits()) -> DataFrame:
    return candidates(entities, edges, as_of, limits).groupBy("kind").agg(F.count("*").alias("n"))


def collect(entities: DataFrame, edges: DataFrame, as_of: str, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """The two tables after a run: what would remain."""
    labelled = label_edges(edges, as_of, limits)
    gone = orphaned(entities, labelled).select("entity_id")
    return entities.join(gone, "entity_id", "left_anti"), edges.join(labelled.where("kind is null").select("rel_id"), "rel_id", "left_semi")


def health(entities: DataFrame, edges: DataFrame, as_of: str) -> DataFrame:
    """One row of counters, a single pass over each table."""
    e = entities.agg(
        F.count("*").alias("total_entities"), F.count_if(is_pipeline()).alias("pipeline_entities"),
        F.count_if(F.col("access_count") == 0).alias("zero_access_entities"),
    )
    eff = scoring.edge_confidence(as_of)
    r = edges.agg(
        F.count("*").alias("total_relationships"), F.count_if(eff < 0.5).alias("low_confidence"), F.count_if(eff < 0.2).alias("very_low_confidence"),
        F.count_if(F.col("valid_until").isNotNull()).alias("superseded"),
    )
    return e.withColumn("one", F.lit(1)).join(r.withColumn("one", F.lit(1)), "one").drop("one")


def age(edges: DataFrame, as_of: str) -> DataFrame:
    return edges.select("rel_id", scoring.whole_days(F.col("valid_from"), as_of).alias("age_days"))

