"""Schemas and fixed vocabularies of the memory graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The entity types, and those whose entities never change once written.
ENTITY_TYPES = (
    "person", "project", "tool", "service", "preference", "decision", "event", "concept", "case", "pattern", "thread",
    "thought", "question", "observation", "policy", "measurement", "outcome",
)
IMMUTABLE_TYPES = ("decision", "event", "case", "observation", "measurement", "outcome")

ENTITY = T.StructType(
    [
        T.StructField("entity_id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("abstract_text", T.StringType()),
        T.StructField("overview", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("mutable", T.BooleanType()),
        T.StructField("access_count", T.LongType()),
        T.StructField("utility_score", T.DoubleType()),
        T.StructField("utility_updates", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("source", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
RELATES_TO = T.StructType(
    [
        T.StructField("rel_id", T.StringType(), False),
        T.StructField("src_id", T.StringType()),
        T.StructField("dst_id", T.StringType()),
        T.StructField("rel_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("valid_from", T.TimestampNTZType()),
        T.StructField("valid_until", T.TimestampNTZType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("last_reinforced", T.TimestampNTZType()),
        T.StructField("source", T.StringType()),
    ]
)
EPISODE = T.StructType(
    [
        T.StructField("episode_id", T.StringType(), False),
        T.StructField("session_id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("abstract_text", T.StringType()),
        T.StructField("overview", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("log_number", T.LongType()),
        T.StructField("extracted", T.BooleanType()),
    ]
)
CONTRIBUTED_TO = T.StructType(
    [
        T.StructField("src_id", T.StringType()),
        T.StructField("dst_id", T.StringType()),
        T.StructField("outcome_result", T.StringType()),
        T.StructField("was_used", T.BooleanType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)
TABLES = {"entity": ENTITY, "relates_to": RELATES_TO, "episode": EPISODE, "contributed_to": CONTRIBUTED_TO}

# Column tiers: what a traversal, a search, and an edit need.
SUMMARY = ("entity_id", "name", "entity_type", "abstract_text")
DETAIL = (*SUMMARY, "overview", "attributes", "access_count", "utility_score", "updated_at", "source")


def is_mutable(entity_type: Column) -> Column:
    return ~entity_type.isin(*IMMUTABLE_TYPES)


def attribute(name: str, column: str = "attributes") -> Column:
    """A scalar of the free attribute object; null if absent, JSON null or no object."""
    return F.get_json_object(F.col(column), f"$.{name}")


def with_stage(entities: DataFrame) -> DataFrame:
    """The attributes the pipeline queries filter by, as real columns."""
    return entities.withColumns(
        {"stage": attribute("pipeline_stage"), "status": attribute("pipeline_status"), "sub_type": attribute("sub_type")}
    )
