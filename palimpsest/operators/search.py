"""Retrieval: exact top-k by embedding, hybrid retrieval, text search."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..functions.scoring import Weights
from ..schema import DETAIL
from ..session import materialize
from .ordering import positions

EXPANDED = 3  # best hits whose neighbours are looked up
OVER_FETCH = 4  # hits fetched for each one asked for, if a filter follows


def literal_vector(values: list[float] | None) -> Column:
    """A vector as one constant, not as an expression per number; null for none."""
    return F.from_json(F.lit(None if values is None else json.dumps([float(x) for x in values])), "array<double>")


def knn(rows: DataFrame, query: Column, limit: int, key: str = "entity_id") -> DataFrame:
    """The `limit` rows nearest to the query vector, with `similarity`; ties go to
    the smaller key, rows without a comparable embedding are left out.

    One scan: each task keeps its own best `limit`, nothing else moves."""
    return (
        rows.withColumn("similarity", scoring.cosine(F.col("embedding"), query))
        .where("similarity is not null and not isnan(similarity)")
        .orderBy(F.desc("similarity"), key)
        .limit(limit)
    )


def scored(rows: DataFrame, as_of: str, weights: Weights = Weights()) -> DataFrame:
    hot = scoring.hotness(F.col("access_count"), F.col("updated_at"), as_of)
    return rows.withColumn("score", scoring.blended_score(F.col("similarity"), hot, F.coalesce("utility_score", F.lit(0.5)), weights))


def search(
    entities: DataFrame,
    query: Column,
    as_of: str,
    limit: int = 10,
    entity_type: str | None = None,
    keyword: str | None = None,
    weights: Weights = Weights(),
    rank_by: str = "similarity",
    prefilter: bool = False,
) -> DataFrame:
    """Semantic search with a blended score; rows in order of similarity.

    With a filter, four times the limit is fetched and filtered afterwards, so
    fewer rows than asked for can remain; `prefilter` filters first instead.
    A limit of 0 means 10.
    """
    limit = limit or 10
    conditions = []
    if entity_type:
        conditions.append(F.col("entity_type") == entity_type)
    if keyword:
        low = keyword.lower()
        conditions.append(F.coalesce(F.lower("name").contains(low) | F.lower("abstract_text").contains(low), F.lit(False)))
    if prefilter:
        for c in conditions:
            entities = entities.where(c)
        conditions = []
    hits = knn(entities, query, limit * OVER_FETCH if conditions else limit)
    for c in conditions:
        hits = hits.where(c)
    order = F.desc("score") if rank_by == "score" else F.desc("similarity")
    found = scored(hits, as_of, weights).orderBy(order, "entity_id").limit(limit)
    return found.select(*(c for c in DETAIL if c in found.columns), "similarity", "score")


def search_episodes(episodes: DataFrame, query: Column, limit: int = 5) -> DataFrame:
    """Nearest episodes; the score is the similarity."""
    return knn(episodes, query, limit, "episode_id").withColumn("score", F.col("similarity"))


def search_counting(entities: DataFrame, query: Column, as_of: str, limit: int = 10, **options) -> tuple[DataFrame, DataFrame]:
    """(hits, the entity table with the access of every hit counted), as a search leaves it."""
    from .state import count_access

    hits = materialize(search(entities, query, as_of, limit, **options), "hits")
    return hits, count_access(entities, hits)


def hybrid_with_episodes(entities: DataFrame, edges: DataFrame, episodes: DataFrame, query: Column, as_of: str, limit: int = 10, **options) -> tuple[DataFrame, DataFrame]:
    """(entities as of hybrid, the `limit` nearest episodes)."""
    return hybrid(entities, edges, query, as_of, limit, **options), search_episodes(episodes, query, limit)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from its source (way 0) and from its target (way 1); a loop once."""
    out = edges.select(F.col("src_id").alias("at"), F.col("dst_id").alias("to"), F.lit(0).alias("way"), "*")
    back = edges.where("src_id != dst_id").select(F.col("dst_id").alias("at"), F.col("src_id").alias("to"), F.lit(1).alias("way"), "*")
    return out.unionByName(back)


def traversable(edges: DataFrame, as_of: str, least: float = scoring.LEAST_CONFIDENCE) -> DataFrame:
    """Active edges whose confidence, as of then, has not faded below `least`."""
    return edges.where("valid_until is null").withColumn("effective", scoring.edge_confidence(as_of)).where(F.col("effective") >= least)


def hybrid(
    entities: DataFrame,
    edges: DataFrame,
    query: Column,
    as_of: str,
    limit: int = 10,
    depth: int = 1,
    entity_type: str | None = None,
    keyword: str | None = None,
    weights: Weights = Weights(),
) -> DataFrame:
    """Semantic hits, widened by the neighbours of the best three.

    Twice the limit is searched; a neighbour not among the hits scores its
    parent's score times the edge's effective confidence, the first parent (in
    order of score), direction and edge counting; the type filter holds for
    neighbours too, the keyword does not.  The three parents are the only side
    that is broadcast: at most three rows.
    """
    seeds = search(entities, query, as_of, 2 * limit, entity_type, keyword, weights).select("entity_id", "name", "entity_type", "score")
    if depth > 0:  # used three times, and never more than 2 x limit rows
        seeds = materialize(seeds, "seeds")
    hits = seeds.select("*", F.lit("semantic").alias("found_by"), F.lit(None).cast("string").alias("parent_id"))
    if depth > 0:
        best = seeds.orderBy(F.desc("score"), "entity_id").limit(EXPANDED)
        near = (
            both_ways(traversable(edges, as_of).select("rel_id", "src_id", "dst_id", "effective"))
            .join(F.broadcast(best.select(F.col("entity_id").alias("at"), F.col("score").alias("parent_score"))), "at")
            .select(F.col("to").alias("entity_id"), "way", "rel_id", F.col("at").alias("parent_id"), "parent_score", "effective")
            .join(seeds.select("entity_id"), "entity_id", "left_anti")
        )
        first = F.min_by(
            F.struct((F.col("parent_score") * F.col("effective")).alias("score"), "parent_id"),
            F.struct(-F.col("parent_score"), F.col("parent_id"), F.col("way"), F.col("rel_id")),
        )
        near = near.groupBy("entity_id").agg(first.alias("best"))
        known = entities.select("entity_id", "name", "entity_type")
        if entity_type:
            known = known.where(F.col("entity_type") == entity_type)
        hits = hits.unionByName(
            known.join(near, "entity_id").select(
                "entity_id", "name", "entity_type", "best.score", F.lit("graph").alias("found_by"), "best.parent_id"
            )
        )
    return hits.orderBy(F.desc("score"), "entity_id").limit(limit)


# --- text ---------------------------------------------------------------------


def lines_of(files: DataFrame, key: str = "file", body: str = "text") -> DataFrame:
    """(file, line_num, line): lines counted from 1, line ends of any kind removed;
    a final line end begins no further line."""
    trimmed = F.regexp_replace(F.col(body), r"\r?\n\z", "")
    return files.where(F.col(body).isNotNull() & (F.col(body) != "")).select(
        F.col(key).alias("file"), F.posexplode(F.split(trimmed, r"\r?\n")).alias("i", "line")
    ).select("file", (F.col("i") + 1).alias("line_num"), "line")


def line_search(files: DataFrame, query: str, key: str = "file", body: str = "text") -> DataFrame:
    """Lines that hold the query, case ignored.  Files without it are left out before
    anything is split."""
    low = query.lower()
    holding = files.where(F.lower(F.col(body)).contains(low))
    return lines_of(holding, key, body).where(F.lower("line").contains(low))


def line_search_context(files: DataFrame, query: str, context: int, key: str = "file", body: str = "text") -> DataFrame:
    """(file, match_line, line_num, line, is_match): each match with the lines around
    it; where matches are close, lines come once for each."""
    low = query.lower()
    holding = files.where(F.lower(F.col(body)).contains(low)).select(
        F.col(key).alias("file"), F.split(F.regexp_replace(F.col(body), r"\r?\n\z", ""), r"\r?\n").alias("lines")
    )
    matches = holding.select("file", "lines", F.posexplode("lines").alias("i", "hit")).where(F.lower("hit").contains(low))
    around = matches.select(
        "file", "lines", "i",
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("i") - context), F.least(F.size("lines") - 1, F.col("i") + context))).alias("k"),
    )
    return around.select(
        "file", (F.col("i") + 1).alias("match_line"), (F.col("k") + 1).alias("line_num"), F.get("lines", F.col("k")).alias("line"),
        (F.col("i") == F.col("k")).alias("is_match"),
    )


def ranked_search(files: DataFrame, query: str, limit: int = 10, key: str = "file", body: str = "text") -> DataFrame:
    """(file, match_count, score, previews): files that hold every word, scored by how
    often, weighted by how late they come (0.5 to 1) and by 1.5 if a user turn begins
    with the query."""
    low = query.lower()
    terms = low.split()
    content = F.lower("body")
    count = F.lit(0)
    for w in terms if len(terms) > 1 else [low]:
        count = count + text.occurrences(content, w)
    boost = F.when(content.contains("### user\n\n" + low[:20]), 1.5).otherwise(1.0)
    hit = F.lit(True)
    for w in terms:
        hit = hit & content.contains(w)

    def shows(line: Column) -> Column:
        some = F.lower(line).contains(low)
        for w in terms if len(terms) > 1 else []:
            some = some | F.lower(line).contains(w)
        trimmed = F.trim(line)
        return some & (trimmed != "") & ~trimmed.rlike(r"^(#|---|```)")

    previews = F.transform(F.slice(F.filter(F.split("body", r"\r?\n"), shows), 1, 3), lambda x: F.trim(x))
    texts = files.select(F.col(key).alias("file"), F.col(body).alias("body"))
    found = texts.where(hit).select("file", count.alias("match_count"), (count * boost).alias("weight"), previews.alias("previews"))
    recency = F.when(F.col("n") > 1, 0.5 + 0.5 * (F.col("pos") / (F.col("n") - 1))).otherwise(1.0)
    return (
        found.join(positions(files.select(F.col(key).alias("file")), "file"), "file")
        .select("file", "match_count", (F.col("weight") * recency).alias("score"), "previews")
        .orderBy(F.desc("score"), "file")
        .limit(limit)
    )


def ranked_search_phrase(files: DataFrame, query: str, limit: int = 10, key: str = "file", body: str = "text") -> DataFrame:
    """(file, score): files that hold the phrase, scored by how often, by the share of
    its words found and by how late they come, 1.5 times if a user turn begins so."""
    low = query.lower()
    terms = low.split()
    content = F.lower("body")
    found = F.lit(0)
    for w in terms:
        found = found + F.when(content.contains(w), 1).otherwise(0)
    boost = F.when(content.contains("### user\n\n" + low), 1.5).otherwise(1.0)
    weight = text.occurrences(content, low) * (found / F.lit(float(max(1, len(terms)))))
    texts = files.select(F.col(key).alias("file"), F.col(body).alias("body"))
    hits = texts.where(content.contains(low)).select("file", weight.alias("weight"), boost.alias("boost"))
    score = (F.col("weight") + (F.col("pos") + 1) / F.col("n")) * F.col("boost")
    return (
        hits.join(positions(files.select(F.col(key).alias("file")), "file"), "file").select("file", score.alias("score"))
        .orderBy(F.desc("score"), "file").limit(limit)
    )


def line_search_few(files: DataFrame, query: str, each: int = 5, key: str = "file", body: str = "text") -> DataFrame:
    """Lines that hold the query, the first `each` of every file."""
    low = query.lower()
    lines = F.transform(F.split(F.regexp_replace(F.col(body), r"\r?\n\z", ""), r"\r?\n"), lambda x, i: F.struct((i + 1).alias("line_num"), x.alias("line")))
    first = F.slice(F.filter(lines, lambda x: F.lower(x["line"]).contains(low)), 1, each)
    return files.where(F.lower(F.col(body)).contains(low)).select(F.col(key).alias("file"), F.explode(first).alias("x")).select("file", "x.*")
