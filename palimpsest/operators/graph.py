"""Traversal, degrees, decay reports and flows over the memory graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..schema import SUMMARY, with_stage
from ..session import materialize
from .search import both_ways, traversable

# Edge types of the reflection pipeline.
FLOW_TYPES = (
    "EVOLVED_FROM", "CRYSTALLIZED_FROM", "INFORMED_BY", "EXPLORES", "GRADUATED_TO", "ARCHIVED_FROM", "CONNECTED_TO",
)


PATHS_AT_ONCE = 1_000_000  # paths through one entity made in one task


def first_by_name(entities: DataFrame) -> DataFrame:
    """One entity per name: the first created, then the smaller id."""
    best = entities.groupBy("name").agg(F.min(F.struct("created_at", "entity_id")).alias("first"))
    return best.select("name", F.col("first.entity_id").alias("entity_id"))


def relationships(edges: DataFrame, entity_id: str, direction: str = "both") -> DataFrame:
    """Edges of an entity, closed ones too: outgoing, incoming or both (a loop once)."""
    out, back = F.col("src_id") == entity_id, F.col("dst_id") == entity_id
    return edges.where({"outgoing": out, "incoming": back, "both": out | back}[direction])


def entity_by_id(entities: DataFrame, entity_id: str) -> DataFrame:
    """The entity of that id: one row or none."""
    return entities.where(F.col("entity_id") == entity_id).limit(1)


def episodes_of_session(episodes: DataFrame, session_id: str) -> DataFrame:
    """A session's episodes in order of time."""
    return episodes.where(F.col("session_id") == session_id).orderBy("timestamp", "episode_id")


def episode_by_log(episodes: DataFrame, log_number: int) -> DataFrame:
    """One episode of that log number, the first by id."""
    return episodes.where(F.col("log_number") == log_number).orderBy("episode_id").limit(1)


def short_id(record_id: Column) -> Column:
    """What follows the last colon of an id."""
    return F.substring_index(record_id, ":", -1)


def degrees(edges: DataFrame) -> DataFrame:
    """(entity_id, degree): edges at each entity, closed ones too, a loop once."""
    return both_ways(edges.select("rel_id", "src_id", "dst_id")).groupBy(F.col("at").alias("entity_id")).agg(F.count("*").alias("degree"))


def one_hop(edges: DataFrame, seeds: DataFrame, as_of: str) -> DataFrame:
    """(entity_id, neighbour_id, rel_id, way, effective) of the seeds' traversable edges."""
    steps = both_ways(traversable(edges, as_of).select("rel_id", "src_id", "dst_id", "effective"))
    return steps.join(seeds.select(F.col("entity_id").alias("at")), "at", "left_semi").select(
        F.col("at").alias("entity_id"), F.col("to").alias("neighbour_id"), "rel_id", "way", "effective"
    )


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int, as_of: str, name: str = "hop") -> DataFrame:
    """(entity_id, hops, confidence): all entities within `depth` steps of the seeds,
    with the fewest steps and the best product of confidences on so short a way.

    Breadth first: each level is one join of the frontier with the steps and an
    anti-join with what was seen, written to the shared folder so that the plan
    stays short and a lost executor costs one level."""
    steps = materialize(
        both_ways(traversable(edges, as_of).select("rel_id", "src_id", "dst_id", "effective"))
        .groupBy("at", "to").agg(F.max("effective").alias("effective")),
        name,
    )
    seen = materialize(seeds.select("entity_id", F.lit(0).alias("hops"), F.lit(1.0).alias("confidence")).distinct(), name)
    frontier = seen
    for level in range(1, depth + 1):
        reached = (
            steps.join(frontier.select(F.col("entity_id").alias("at"), "confidence"), "at")
            .groupBy(F.col("to").alias("entity_id"))
            .agg(F.max(F.col("confidence") * F.col("effective")).alias("confidence"))
        )
        frontier = materialize(
            reached.join(seen.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.lit(level).alias("hops"), "confidence"), name
        )
        seen = seen.unionByName(frontier)
    return seen


def traverse_tree(
    entities: DataFrame, edges: DataFrame, name: str, depth: int, as_of: str, entity_type: str | None = None, most: int = 100_000
) -> dict:
    """The depth-first tree below the entity of that name, as nested dicts.

    A node hangs where the walk meets it first (outgoing edges before incoming
    ones, then by type, name and id); nodes of another type than asked for are
    passed over.  Only the sub-graph within `depth` comes to the driver, after its
    size was checked; beyond `most` edges k_hop is the operator to use.
    """
    root = first_by_name(entities).where(F.col("name") == name).limit(1).collect()
    if not root:
        raise LookupError(f"no entity is named {name!r}")
    start = root[0]["entity_id"]
    near = k_hop(edges, entities.sparkSession.createDataFrame([(start,)], "entity_id string"), max(depth - 1, 0), as_of, "tree")
    steps = both_ways(traversable(edges, as_of).select("rel_id", "rel_type", "src_id", "dst_id", "effective"))
    local = (
        steps.join(near.select(F.col("entity_id").alias("at")), "at", "left_semi")
        .join(entities.select(F.col("entity_id").alias("to"), F.col("name").alias("to_name"), F.col("entity_type").alias("to_type")), "to")
    )
    rows = local.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges within {depth} steps; use k_hop")
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["way"], r["rel_type"] or "", r["to_name"] or "", r["to"], r["rel_id"])):
        by.setdefault(r["at"], []).append(r)
    visited = {start}

    def walk(node: str, left: int) -> list[dict]:
        out = []
        for r in by.get(node, []) if left > 0 else []:
            if r["to"] in visited or (entity_type and r["to_type"] != entity_type):
                continue
            visited.add(r["to"])
            out.append(
                {
                    "rel_type": r["rel_type"], "direction": "outgoing" if r["way"] == 0 else "incoming", "confidence": r["effective"],
                    "entity_id": r["to"], "name": r["to_name"], "entity_type": r["to_type"], "edges": walk(r["to"], left - 1),
                }
            )
        return out

    return {"entity_id": start, "name": name, "edges": walk(start, depth)}


def render_tree(node: dict, indent: int = 0) -> str:
    """The tree as indented lines, with the confidence where it is below 1."""
    lines = [node["name"]] if not indent else []
    for e in node["edges"]:
        arrow = "->" if e["direction"] == "outgoing" else "<-"
        sure = "" if e["confidence"] >= 1.0 else f" [{e['confidence']:.0%}]"
        lines.append("  " * (indent + 1) + f"{arrow} {e['rel_type']}{sure} {e['name']} ({e['entity_type']})")
        lines += [x for x in [render_tree(e, indent + 1)] if x]
    return "\n".join(lines)


def decay_report(edges: DataFrame, as_of: str, show_all: bool = False, entity_id: str | None = None) -> DataFrame:
    """(rel_id, stored, effective, decay) of the active edges, or of all edges at one
    entity; those that have hardly decayed (< 0.001) only with `show_all`."""
    chosen = edges.where("valid_until is null") if entity_id is None else relationships(edges, entity_id)
    rows = chosen.select(
        "rel_id", "src_id", "dst_id", "rel_type", F.col("confidence").alias("stored"), scoring.edge_confidence(as_of).alias("effective")
    ).withColumn("decay", F.col("stored") - F.col("effective"))
    return rows if show_all else rows.where("decay >= 0.001")


def decay_summary(edges: DataFrame, as_of: str) -> DataFrame:
    rows = decay_report(edges, as_of, True)
    return rows.agg(
        F.count("*").alias("edges"), F.count_if(F.col("decay") > 0.001).alias("decayed"), F.avg("decay").alias("average_decay")
    )


def stats(entities: DataFrame, edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """(what, n): rows of each table."""
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return one(entities, "entity").unionByName(one(edges, "relates_to")).unionByName(one(episodes, "episode"))


def type_counts(entities: DataFrame) -> DataFrame:
    """(entity_type, n), the commonest first, then by name."""
    return _type_counts(entities).orderBy(F.desc("n"), "entity_type")


def _type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count("*").alias("n"))


def stage_counts(entities: DataFrame) -> DataFrame:
    """(stage, status, n) of the pipeline's entities; a missing status is `unknown`."""
    return (
        with_stage(entities).where("stage is not null")
        .groupBy("stage", F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))
    )


def stage_entities(entities: DataFrame, stage: str, status: str | None = None) -> DataFrame:
    rows = with_stage(entities).where(F.col("stage") == stage)
    return (rows.where(F.col("status") == status) if status else rows).orderBy(F.desc("updated_at"), "entity_id")


def stale(entities: DataFrame, edges: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(entity_id, kind): active thoughts not updated for `days`, and active plain
    questions for twice that, without a younger edge at either end.

    The two ends are exploded, so both the joins are equi-joins."""
    now = scoring.literal_time(as_of)
    ends = both_ways(edges.select("rel_id", "src_id", "dst_id", "valid_from")).select(F.col("at").alias("entity_id"), "valid_from")
    latest = ends.groupBy("entity_id").agg(F.max("valid_from").alias("latest"))
    rows = with_stage(entities).where("status = 'active'").join(latest, "entity_id", "left")

    def old(d: int):
        limit = now - F.make_dt_interval(F.lit(d))
        return (F.col("updated_at") < limit) & F.coalesce(F.col("latest") <= limit, F.lit(True))

    kind = F.when((F.col("stage") == "thoughts") & old(days), "thought").when(
        (F.col("stage") == "curiosity") & F.col("sub_type").isNull() & old(2 * days), "question"
    )
    return rows.select("entity_id", "updated_at", kind.alias("kind")).where("kind is not null")


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Active pipeline entities at no edge, closed edges included."""
    ends = edges.select(F.col("src_id").alias("entity_id")).unionByName(edges.select(F.col("dst_id").alias("entity_id")))
    return with_stage(entities).where("stage is not null and status = 'active'").join(ends, "entity_id", "left_anti")


def last_movement(entities: DataFrame) -> DataFrame:
    return with_stage(entities).where("status in ('graduated', 'dissolved', 'explored')").agg(F.max("updated_at").alias("last_movement"))


def flow(entities: DataFrame, edges: DataFrame, names: DataFrame | None = None, types: tuple[str, ...] = FLOW_TYPES) -> DataFrame:
    """(source, rel_type, target) of the active pipeline edges at the named entities
    (all entities if no names are given)."""
    active = edges.where("valid_until is null").where(F.col("rel_type").isin(*types)).select("rel_id", "src_id", "dst_id", "rel_type")
    if names is not None:
        at = first_by_name(entities).join(names, "name", "left_semi").select(F.col("entity_id").alias("at"))
        rels = both_ways(active.select("rel_id", "src_id", "dst_id")).join(at, "at", "left_semi").select("rel_id").distinct()
        active = active.join(rels, "rel_id", "left_semi")
    end = lambda side, label: entities.select(F.col("entity_id").alias(side), F.col("name").alias(label))
    return active.join(end("src_id", "source"), "src_id").join(end("dst_id", "target"), "dst_id").select("rel_id", "source", "rel_type", "target")


def path_confidences(edges: DataFrame, as_of: str) -> DataFrame:
    """(first_id, last_id, confidence) of all paths of two outgoing traversable edges:
    the best product between two different ends."""
    e = traversable(edges, as_of).select("src_id", "dst_id", "effective").where("src_id != dst_id")
    best = e.groupBy("src_id", "dst_id").agg(F.max("effective").alias("effective"))  # of parallel edges
    best = materialize(best, "paths")
    # A hub of many edges in and out is spread: its incoming edges over parts, its outgoing ones to each.
    into, out = (best.groupBy(F.col(c).alias("mid")).agg(F.count("*").alias(n)) for c, n in (("dst_id", "into"), ("src_id", "out")))
    parts = into.join(out, "mid").select("mid", F.least(F.col("into"), F.ceil(F.col("into") * F.col("out") / F.lit(PATHS_AT_ONCE))).cast("int").alias("parts"))
    left = best.select(F.col("src_id").alias("first_id"), F.col("dst_id").alias("mid"), F.col("effective").alias("a")).join(parts, "mid")
    right = best.select(F.col("src_id").alias("mid"), F.col("dst_id").alias("last_id"), F.col("effective").alias("b")).join(parts, "mid")
    left = left.withColumn("part", F.pmod(F.xxhash64("first_id"), F.col("parts")).cast("int")).drop("parts")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return (
        left.join(right, ["mid", "part"]).where("first_id != last_id")
        .groupBy("first_id", "last_id").agg(F.max(scoring.path_confidence(F.array("a", "b"))).alias("confidence"))
    )


def summaries(entities: DataFrame) -> DataFrame:
    return entities.select(*SUMMARY)


