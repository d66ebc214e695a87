"""Changes to the graph tables as transformations: old state and changes in, new state out.

Nothing is updated in place; sources.snapshots writes each result as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..schema import is_mutable
from ..session import stable_id
from .graph import first_by_name
from .ordering import affine_fold


def each_copy(rows: DataFrame) -> DataFrame:
    """The rows with `copy`, which counts equal ones from 0: what tells them apart."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__n")


def add_entities(entities: DataFrame, new: DataFrame, as_of: str, embed=None) -> DataFrame:
    """The table with `new` (name, entity_type, abstract_text, and optionally overview,
    content, attributes, source) appended.  Names need not be unique.  `embed`
    makes the vector of an abstract; without it the vector is null.  Equal rows get
    different ids."""
    new = each_copy(new)
    now = scoring.literal_time(as_of)
    have = set(new.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    made = {
        "entity_id": F.concat(F.lit("entity:"), F.substring(stable_id(*(F.col(c) for c in sorted(have)), now.alias("at")), 1, 20)),
        "name": F.col("name"), "entity_type": F.col("entity_type"), "abstract_text": F.col("abstract_text"), "overview": text("overview"),
        "content": text("content"), "attributes": text("attributes"), "mutable": is_mutable(F.col("entity_type")), "access_count": F.lit(0).cast("long"),
        "utility_score": F.lit(0.5), "utility_updates": F.lit(0).cast("long"), "created_at": now, "updated_at": now, "source": text("source"),
        "embedding": embed(F.col("abstract_text")) if embed else F.lit(None).cast("array<float>"),
    }
    return entities.unionByName(new.select(*(made[c].alias(c) for c in entities.columns if c in made)), allowMissingColumns=True)


def merge_json(base: Column, overlay: Column) -> Column:
    """The overlay's keys over the base's, one level deep; an overlay that is no
    object, or over a base that is none, stands alone."""
    kind = "map<string,variant>"
    a, b = (F.from_json(x, kind) for x in (base, overlay))
    kept = F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k))
    return F.when(overlay.isNull(), base).when(a.isNull() | b.isNull(), overlay).otherwise(F.to_json(F.map_concat(kept, b)))


def update_entities(entities: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """The table after `changes` (entity_id and any of abstract_text, overview, content,
    attributes): a null leaves the value, updated_at always moves; unknown ids change nothing."""
    fields = [c for c in ("abstract_text", "overview", "content", "attributes") if c in changes.columns]
    given = changes.select("entity_id", *(F.col(c).alias(f"new_{c}") for c in fields), F.lit(True).alias("changed"))
    joined = entities.join(given, "entity_id", "left")
    out = {c: F.coalesce(f"new_{c}", c) for c in fields} | {"updated_at": F.when(F.col("changed"), scoring.literal_time(as_of)).otherwise(F.col("updated_at"))}
    return joined.select(*(out.get(c, F.col(c)).alias(c) for c in entities.columns))


def delete_entities(entities: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without those entities and the edges at them."""
    gone = ids.select("entity_id").distinct()
    kept = edges
    for end in ("src_id", "dst_id"):
        kept = kept.join(gone.select(F.col("entity_id").alias(end)), end, "left_anti")
    return entities.join(gone, "entity_id", "left_anti"), kept.select(*edges.columns)


def add_relationships(edges: DataFrame, entities: DataFrame, new: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(the table with `new` (from_name, to_name, rel_type, description, confidence,
    source) appended, the rows of `new` whose ends are unknown).  Edges alike, even in
    all fields, are edges of their own."""
    now = scoring.literal_time(as_of)
    named = first_by_name(entities)
    a = named.select(F.col("name").alias("from_name"), F.col("entity_id").alias("src_id"))
    b = named.select(F.col("name").alias("to_name"), F.col("entity_id").alias("dst_id"))
    joined = each_copy(new).join(a, "from_name", "left").join(b, "to_name", "left")
    good = joined.where("src_id is not null and dst_id is not null").select(
        F.concat(F.lit("relates_to:"), F.substring(stable_id("src_id", "dst_id", "rel_type", "description", "confidence", "source", "copy", now.alias("at")), 1, 20)).alias("rel_id"),
        "src_id", "dst_id", "rel_type", "description", now.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_until"),
        F.coalesce("confidence", F.lit(1.0)).cast("float").cast("double").alias("confidence"), now.alias("last_reinforced"), "source",
    )
    return edges.unionByName(good), joined.where("src_id is null or dst_id is null").select(*new.columns)


def set_confidence(edges: DataFrame, changes: DataFrame, as_of: str | None = None) -> DataFrame:
    """The table with the confidences of `changes` (rel_id, confidence); with `as_of`
    the edges count as reinforced then."""
    given = changes.select("rel_id", F.col("confidence").alias("given"))
    joined = edges.join(given, "rel_id", "left")
    at = F.col("last_reinforced") if as_of is None else F.when(F.col("given").isNotNull(), scoring.literal_time(as_of)).otherwise(F.col("last_reinforced"))
    out = {"confidence": F.coalesce("given", "confidence"), "last_reinforced": at}
    return joined.select(*(out.get(c, F.col(c)).alias(c) for c in edges.columns))


def reinforce(edges: DataFrame, observations: DataFrame, as_of: str) -> DataFrame:
    """The table after observations (rel_id, seq, corroborates) of its edges, folded in
    order of seq: each moves the confidence by one eleventh."""
    keep, step = scoring.PSEUDOCOUNT / (scoring.PSEUDOCOUNT + 1.0), 1.0 / (scoring.PSEUDOCOUNT + 1.0)
    steps = observations.select("rel_id", "seq", F.lit(keep).alias("keep"), F.when(F.col("corroborates"), step).otherwise(0.0).alias("add"))
    folded = affine_fold(steps, "rel_id", "seq", "observations").withColumnRenamed("add", "more").select("rel_id", "keep", "more")
    joined = edges.join(folded, "rel_id", "left")
    seen = F.col("keep").isNotNull()
    out = {
        "confidence": F.when(seen, F.col("confidence") * F.col("keep") + F.col("more")).otherwise(F.col("confidence")),
        "last_reinforced": F.when(seen, scoring.literal_time(as_of)).otherwise(F.col("last_reinforced")),
    }
    return joined.select(*(out.get(c, F.col(c)).alias(c) for c in edges.columns))


def supersede(edges: DataFrame, replacements: DataFrame, as_of: str) -> DataFrame:
    """The table with each `old_id` of replacements (old_id and the columns of a new
    edge) closed and the new edge opened."""
    now = scoring.literal_time(as_of)
    old = replacements.select(F.col("old_id").alias("rel_id"), F.lit(True).alias("closing")).distinct()
    closed = edges.join(old, "rel_id", "left")
    until = F.when(F.col("closing") & F.col("valid_until").isNull(), now).otherwise(F.col("valid_until"))
    opened = replacements.withColumns({"valid_from": now, "last_reinforced": now, "valid_until": F.lit(None).cast("timestamp_ntz")})
    return closed.select(*((until if c == "valid_until" else F.col(c)).alias(c) for c in edges.columns)).unionByName(opened.select(*edges.columns))


def delete_relationships(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select("rel_id"), "rel_id", "left_anti")


def count_access(entities: DataFrame, hits: DataFrame) -> DataFrame:
    """access_count plus one for each row of hits (entity_id); updated_at stays."""
    counted = hits.groupBy("entity_id").agg(F.count("*").alias("more"))
    joined = entities.join(counted, "entity_id", "left")
    more = F.col("access_count") + F.coalesce("more", F.lit(0))
    return joined.select(*((more if c == "access_count" else F.col(c)).alias(c) for c in entities.columns))


def mark_extracted(episodes: DataFrame, logs: DataFrame) -> DataFrame:
    done = logs.select("log_number", F.lit(True).alias("done")).distinct()
    joined = episodes.join(done, "log_number", "left")
    return joined.select(*((F.coalesce("done", "extracted") if c == "extracted" else F.col(c)).alias(c) for c in episodes.columns))


def unextracted_logs(episodes: DataFrame) -> DataFrame:
    return episodes.where("not extracted and log_number is not null").select("log_number").distinct()
