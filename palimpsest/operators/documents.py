"""Process documents: parsing, references between entries, reconciliation with the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import with_stage
from ..session import materialize, spread

# Stage, heading (exact, or held in the heading if it starts with *), status, sub-type.
RULES = (
    ("learning", "*active thread", "active", None),
    ("thoughts", "active", "active", None),
    ("thoughts", "graduated", "graduated", None),
    ("thoughts", "dissolved", "dissolved", None),
    ("curiosity", "*open question", "active", None),
    ("curiosity", "themes", "active", "theme"),
    ("curiosity", "explored", "explored", None),
    ("reflections", "observations", "active", None),
    ("reflections", "patterns", "active", "pattern"),
    ("praxis", "active", "active", None),
    ("praxis", "*phronesis", "active", "phronesis"),
    ("praxis", "retired", "retired", None),
)
# The entity type of each stage's entries, and the stages' order.
STAGE_TYPES = {"learning": "thread", "thoughts": "thought", "curiosity": "question", "reflections": "observation", "praxis": "policy"}


def blocks(body: Column, mark: str) -> Column:
    """Array of (title, body) of the blocks begun by lines `mark`, bodies trimmed."""
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(body, r"\r\n", "\n")), f"\n(?={mark} )")
    held = F.filter(parts, lambda p: p.startswith(f"{mark} "))
    one = F.transform(
        held,
        lambda p: F.struct(
            F.trim(F.regexp_extract(p, f"^{mark} ([^\\n]*)", 1)).alias("title"), text.strip(F.regexp_replace(p, f"^{mark} [^\\n]*", "")).alias("body")
        ),
    )
    return F.filter(one, lambda b: b["title"] != "")


def sections(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, section_no, title, section) of all `## ` sections."""
    return docs.where(F.col(body).isNotNull()).select(F.col(key), F.posexplode(blocks(F.col(body), "##")).alias("i", "b")).select(
        key, (F.col("i") + 1).alias("section_no"), F.col("b.title").alias("title"), F.col("b.body").alias("section")
    )


def parse(docs: DataFrame, key: str, stage: str, body: str, rules: tuple = RULES) -> DataFrame:
    """(key, section_no, entry_no, stage, status, sub_type, entity_type, title, body, date,
    source_ref, destination, connected): the entries of the five kinds of documents.

    One parser and a table of rules for all stages; a section no rule knows is
    skipped, the first rule that fits counts.
    """
    parts = docs.where(F.col(body).isNotNull()).select(
        F.col(key), F.col(stage).alias("stage"), F.posexplode(blocks(F.col(body), "##")).alias("si", "section")
    )
    heading = F.lower("section.title")
    status = sub = F.lit(None).cast("string")
    fits = F.lit(False)
    for st, head, state, kind in reversed(rules):
        hit = (F.col("stage") == st) & (heading.contains(head[1:]) if head[0] == "*" else heading == head)
        status, sub, fits = F.when(hit, F.lit(state)).otherwise(status), F.when(hit, F.lit(kind)).otherwise(sub), hit | fits
    rows = parts.where(fits).select(
        key, "stage", (F.col("si") + 1).alias("section_no"), status.alias("status"), sub.alias("sub_type"),
        F.posexplode(blocks(F.col("section.body"), "###")).alias("ei", "e"),
    )
    title, entry = F.col("e.title"), F.col("e.body")
    st = F.col("stage")
    get = lambda n: text.field(entry, n)
    date = (
        F.when(st == "learning", text.heading_date(title))
        .when(st == "thoughts", F.coalesce(get("Graduated"), get("Dissolved"), text.heading_date(title)))
        .when(st == "curiosity", F.coalesce(get("Date explored"), text.heading_date(title)))
        .when(st == "reflections", text.reflection_date(title))
        .otherwise(F.coalesce(get("Added"), text.heading_date(title)))
    )
    clean = (
        F.when(st == "learning", text.without_heading_date(title)).when(st == "thoughts", text.thought_title(title))
        .when(st == "reflections", text.without_reflection_date(title)).otherwise(title)
    )
    kinds = F.coalesce(*(F.when(st == k, F.lit(v)) for k, v in STAGE_TYPES.items()))
    return rows.select(
        key, "section_no", (F.col("ei") + 1).alias("entry_no"), "stage", "status", "sub_type", kinds.alias("entity_type"), clean.alias("title"),
        entry.alias("body"), date.alias("date"),
        F.when(st == "curiosity", F.coalesce(get("Source"), get("Origin"))).otherwise(get("Source")).alias("source_ref"),
        F.when(st != "curiosity", get("Destination")).alias("destination"), text.connected_to(entry).alias("connected"),
    )


def as_entities(parsed: DataFrame) -> DataFrame:
    """(name, entity_type, abstract_text, overview, attributes, source) of parsed entries."""
    head = F.substring("body", 1, 200)
    return parsed.select(
        F.col("title").alias("name"), "entity_type",
        F.when(F.octet_length("body") > 200, F.concat(head, F.lit("..."))).otherwise(F.col("body")).alias("abstract_text"),
        F.col("body").alias("overview"),
        F.to_json(
            F.struct(
                F.col("stage").alias("pipeline_stage"), F.col("status").alias("pipeline_status"), "date", "source_ref", "destination", "sub_type"
            )
        ).alias("attributes"),
        F.concat(F.lit("pipeline:"), F.col("stage")).alias("source"),
    )


def _trigrams(c: Column) -> Column:
    """Hashes of the different three-letter pieces of a text."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.xxhash64(F.substring(c, i, F.lit(3))))
    return F.array_distinct(F.when(F.length(c) >= 3, pieces).otherwise(F.array().cast("array<bigint>")))


def _held_in(held: DataFrame, holders: DataFrame) -> DataFrame:
    """(held_id, holder_id) of all pairs of texts (id, low) one of which stands in the other.

    A text of three letters or more is looked for by that three-letter piece of it that
    the fewest holders have, if they have all its pieces; only numbers are exploded and
    joined, and only the pairs left are compared.  A shorter one is itself a piece."""
    long, short = held.where(F.length("low") >= 3), held.where(F.length("low").between(1, 2))
    has = holders.select(F.col("id").alias("holder_id"), F.explode(_trigrams(F.col("low"))).alias("g"))
    counts = has.groupBy("g").agg(F.count("*").alias("df"))
    wanted = long.select("id", F.size(_trigrams(F.col("low"))).alias("n"), F.explode(_trigrams(F.col("low"))).alias("g"))
    rarest = (
        wanted.join(counts, "g").groupBy("id", "n").agg(F.count("*").alias("known"), F.min_by("g", F.struct("df", "g")).alias("g")).where("known = n")
        .select(F.col("id").alias("held_id"), "g")
    )
    pairs = rarest.join(has, "g").select("held_id", "holder_id")
    texts = lambda df, side: df.select(F.col("id").alias(f"{side}_id"), F.col("low").alias(side))
    found = pairs.join(texts(long, "held"), "held_id").join(texts(holders, "holder"), "holder_id").where(F.contains("holder", "held"))
    pieces = F.array_distinct(
        F.flatten(F.transform(F.sequence(F.lit(1), F.length("low")), lambda i: F.array(F.substring("low", i, F.lit(1)), F.substring("low", i, F.lit(2)))))
    )
    small = holders.where(F.col("low") != "").select(F.col("id").alias("holder_id"), F.explode(pieces).alias("low")).join(short.select(F.col("id").alias("held_id"), "low"), "low")
    return found.select("held_id", "holder_id").unionByName(small.select("held_id", "holder_id"))


def resolve_references(references: DataFrame, titles: DataFrame, name: str = "references") -> DataFrame:
    """(ref, target): the title each free-text reference (ref) means, among titles
    (seq, title), the smallest seq of the best tier: the same text, one within the
    other (titles of 5 bytes or more), a quoted part of it.

    Of titles alike in lower case the first alone is compared, and each different
    reference once.  All joins are equi-joins."""
    refs = references.select("ref").where("ref is not null").distinct().select("ref", F.lower("ref").alias("low"), F.monotonically_increasing_id().alias("id"))
    refs = spread(materialize(refs, name))
    firsts = titles.where("title is not null").groupBy(F.lower("title").alias("low")).agg(F.min("seq").alias("seq"), F.min_by("title", "seq").alias("title"))
    names = spread(materialize(firsts.withColumn("id", F.monotonically_increasing_id()), f"{name}-titles"))
    hit = lambda df, tier: df.select("ref", F.lit(tier).alias("tier"), "seq", "title")
    named = names.select("low", "seq", "title")
    same = hit(refs.join(named, "low"), 1)
    quoted = hit(refs.select("ref", F.explode(F.regexp_extract_all("low", F.lit('"([^"]+)"'), F.lit(1))).alias("low")).join(named, "low"), 3)
    asked, long = refs.where("low != ''").select("id", "low"), names.where(F.octet_length("low") >= 5).select("id", "low")
    inside = _held_in(long, asked).select(F.col("held_id").alias("name_id"), F.col("holder_id").alias("ref_id")).unionByName(
        _held_in(asked, long).select(F.col("holder_id").alias("name_id"), F.col("held_id").alias("ref_id"))
    )
    # Of the names about a reference only the first is needed, and it is found before any title moves.
    best = inside.join(names.select(F.col("id").alias("name_id"), "seq"), "name_id").groupBy("ref_id").agg(F.min_by("name_id", "seq").alias("name_id"))
    within = hit(
        best.join(refs.select(F.col("id").alias("ref_id"), "ref"), "ref_id").join(names.select(F.col("id").alias("name_id"), "seq", "title"), "name_id"), 2
    )
    return same.unionByName(within).unionByName(quoted).groupBy("ref").agg(F.min_by("title", F.struct("tier", "seq")).alias("target"))


def infer_relationships(parsed: DataFrame, seq: Column, name: str = "parsed") -> DataFrame:
    """(source, target, rel_type, description): graduations, sources and connections
    whose reference names an entry; `seq` orders the entries."""
    rows = materialize(parsed.withColumn("seq", seq), name)
    graduated = rows.where("status = 'graduated' and destination is not null").select(
        "title", F.col("destination").alias("ref"), F.lit("GRADUATED_TO").alias("rel_type"), F.concat(F.lit("Graduated from thoughts to "), "destination").alias("description")
    )
    kind = F.when(F.col("stage") == "thoughts", "EVOLVED_FROM").when(F.col("stage") == "reflections", "CRYSTALLIZED_FROM").when(
        F.col("stage") == "praxis", "INFORMED_BY"
    ).otherwise("CONNECTED_TO")
    evolved = rows.where("source_ref is not null").select(
        "title", F.col("source_ref").alias("ref"), kind.alias("rel_type"), F.concat(F.lit("From source: "), "source_ref").alias("description")
    )
    connected = rows.select("title", F.explode("connected").alias("ref"), F.lit("CONNECTED_TO").alias("rel_type")).withColumn("description", F.col("ref"))
    wanted = materialize(graduated.unionByName(evolved).unionByName(connected), f"{name}-wanted")
    found = resolve_references(wanted, rows)
    return wanted.join(found, "ref").select(F.col("title").alias("source"), "target", "rel_type", "description")


def diff(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """(action, entity_type, key, title, entity_id): what reconciling the documents with
    the pipeline's entities does: create, update (status or text differs), keep, or
    archive what no document names any more.  Without any entry nothing is archived."""
    new = parsed.select("entity_type", text.normalize_key(F.col("title")).alias("key"), "title", F.col("status").alias("new_status"), F.col("body").alias("new_body"))
    have = with_stage(entities).where("stage is not null").select(
        "entity_type", text.normalize_key(F.col("name")).alias("key"), "entity_id", "created_at", F.col("status").alias("old_status"),
        F.col("overview").alias("old_body"),
    )
    first = have.groupBy("entity_type", "key").agg(
        F.min_by(F.struct("entity_id", "old_status", "old_body"), F.struct("created_at", "entity_id")).alias("old")
    )
    matched = new.join(first, ["entity_type", "key"], "left").select(
        F.when(F.col("old").isNull(), "create")
        .when(~F.col("new_status").eqNullSafe(F.col("old.old_status")) | ~F.col("new_body").eqNullSafe(F.col("old.old_body")), "update")
        .otherwise("keep").alias("action"),
        "entity_type", "key", "title", F.col("old.entity_id").alias("entity_id"),
    )
    any_entry = parsed.limit(1).select(F.lit(1).alias("one"))
    named = new.join(first, ["entity_type", "key"]).select(F.col("old.entity_id").alias("entity_id"))
    gone = have.join(named, "entity_id", "left_anti").where("coalesce(old_status, '') != 'archived'").withColumn("one", F.lit(1)).join(
        F.broadcast(any_entry), "one", "left_semi"
    )
    return matched.unionByName(gone.select(F.lit("archive").alias("action"), "entity_type", "key", F.lit(None).cast("string").alias("title"), "entity_id"))


def report(changes: DataFrame) -> DataFrame:
    return changes.groupBy("action").agg(F.count("*").alias("n"))


def missing_edges(wanted: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """The wanted edges (entity_id, target_id, rel_type) whose entity has no active edge
    of that type yet, at either end; `strict` also compares the target."""
    active = edges.where("valid_until is null")
    ends = active.select(F.col("src_id").alias("entity_id"), F.col("dst_id").alias("target_id"), "rel_type").unionByName(
        active.select(F.col("dst_id").alias("entity_id"), F.col("src_id").alias("target_id"), "rel_type")
    )
    return wanted.join(ends, ["entity_id", "rel_type", "target_id"] if strict else ["entity_id", "rel_type"], "left_anti")


def episode_references(parsed: DataFrame, episodes: DataFrame) -> DataFrame:
    """(title, log_number, episode_id): episodes an entry's source mentions by number."""
    logs = parsed.select("title", F.explode(F.regexp_extract_all("source_ref", F.lit(r"(?i)(?:conversation|log|archive)[ #-]*(\d+)"), F.lit(1))).alias("n"))
    return logs.select("title", F.col("n").cast("long").alias("log_number")).join(episodes.select("log_number", "episode_id"), "log_number")
