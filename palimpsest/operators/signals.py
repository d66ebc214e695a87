"""Signal vectors and task outcomes written into the graph once each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import first_by_name


def signal_abstract() -> Column:
    """The metrics present, with their trigger, of columns as the signal files name them."""
    show = lambda label, c, fmt: F.when(F.col(c).isNotNull(), F.format_string(f"{label}={fmt}", c))
    parts = F.concat_ws(
        ", ", show("vocab", "vocabulary_diversity", "%.2f"), show("questions", "question_generation", "%.1f"),
        show("thought_lifecycle", "thought_lifecycle", "%.2f"), show("evidence", "evidence_grounding", "%.2f"),
    )
    tail = F.concat(F.lit(" (trigger: "), "trigger", F.lit(")"))
    return F.when(parts == "", F.concat(F.lit("Signal measurement"), tail)).otherwise(F.concat(F.lit("Signal measurement: "), parts, tail))


def new_signals(signals: DataFrame, known: DataFrame, dedupe: bool = False) -> DataFrame:
    """Signals whose timestamp no known measurement (timestamp) has; repeats within the
    batch stay unless `dedupe`."""
    fresh = signals.join(known.select("timestamp").where("timestamp is not null"), "timestamp", "left_anti")
    return fresh.dropDuplicates(["timestamp"]) if dedupe else fresh


def signal_entities(signals: DataFrame) -> DataFrame:
    return signals.select(
        F.concat(F.lit("signal-"), "timestamp").alias("name"), F.lit("measurement").alias("entity_type"), signal_abstract().alias("abstract_text"),
        F.to_json(
            F.struct(
                "timestamp", "trigger", F.lit("signal").alias("source_type"), "vocabulary_diversity", "question_generation",
                "thought_lifecycle", "evidence_grounding",
            )
        ).alias("attributes"),
    )


def new_outcomes(outcomes: DataFrame, known: DataFrame) -> DataFrame:
    """Outcomes whose (task_id, timestamp) no known outcome has."""
    return outcomes.join(known.select("task_id", "timestamp").distinct(), ["task_id", "timestamp"], "left_anti")


def outcome_links(outcomes: DataFrame, entities: DataFrame) -> DataFrame:
    """(task_id, entity_id, rel_type, description): outcomes whose domain names an entity."""
    named = first_by_name(entities).select(F.col("name").alias("domain"), "entity_id")
    return outcomes.join(named, "domain").select(
        "task_id", "entity_id", F.lit("RESULTED_IN").alias("rel_type"), F.concat("outcome", F.lit(" in "), "domain").alias("description")
    )
