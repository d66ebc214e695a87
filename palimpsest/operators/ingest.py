"""From archives to knowledge: chunks, extraction by a model, merging, resolving."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring, text
from ..session import materialize
from .graph import first_by_name
from .state import merge_json

DEDUP_SCORE, DEDUP_HITS = 0.7, 5
CANDIDATES_AT_ONCE = 16_384  # vectors compared in one pass, broadcast
TOKENS_PER_CHUNK, TOKENS_PER_CANDIDATE = 2500, 600


class Provider(Protocol):
    """A model that completes a prompt; made once per task."""

    def complete(self, system: str, user: str, most: int) -> str: ...


class Retrying:
    """A provider that tries again, waiting longer each time, on errors that may pass."""

    def __init__(self, inner: Provider, tries: int = 3, wait: float = 1.0, passing=("429", "500", "502", "503", "504", "timed out")) -> None:
        self.inner, self.tries, self.wait, self.passing = inner, tries, wait, passing

    def complete(self, system: str, user: str, most: int) -> str:
        for attempt in range(1, self.tries + 1):
            try:
                return self.inner.complete(system, user, most)
            except Exception as e:  # noqa: BLE001
                if attempt == self.tries or not any(p in str(e) for p in self.passing):
                    raise
                time.sleep(self.wait * attempt)
        raise AssertionError


class Paced:
    """A provider that pauses after each call."""

    def __init__(self, inner: Provider, pause: float = 0.1) -> None:
        self.inner, self.pause = inner, pause

    def complete(self, system: str, user: str, most: int) -> str:
        try:
            return self.inner.complete(system, user, most)
        finally:
            time.sleep(self.pause)


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Deterministic vectors from hashed words, for tests and as a stand-in for a model."""

    def __init__(self, dimensions: int = 384) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        import numpy as np

        out = []
        for t in texts:
            v = np.zeros(self.dimensions, dtype=np.float32)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dimensions] += 1.0 if h & 0x10000 else -1.0
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return out


def embedding(make: Callable[[], Embedder]) -> Callable[[Column], Column]:
    """A vectorised column function from an embedder; one embedder per task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(model.embed(texts.fillna("").tolist()))

    return run


def balanced_object(raw: str | None) -> str | None:
    """The first stretch of balanced braces of a text (braces inside strings count too)."""
    at = (raw or "").find("{")
    depth = 0
    for i in range(max(at, 0), len(raw or "")) if at >= 0 else ():
        depth += (raw[i] == "{") - (raw[i] == "}")
        if not depth:
            return raw[at : i + 1]
    return None


@F.pandas_udf(T.StringType())
def json_object(texts: pd.Series) -> pd.Series:
    """The JSON object in a model's answer: the answer without fences if it parses, else
    its first balanced object if that parses, else null."""

    def one(raw):
        if raw is None:
            return None
        bare = raw.strip()
        if bare.startswith("```"):
            bare = bare.split("\n", 1)[-1]
            bare = bare.rsplit("```", 1)[0].strip()
        for option in (bare, balanced_object(bare)):
            try:
                if option and isinstance(json.loads(option), dict):
                    return option
            except ValueError:
                continue
        return None

    return texts.map(one)


# The lists of an extraction answer and their fields.
_DDL = (
    "entities array<struct<name:string,type:string,abstract:string,overview:string,content:string,attributes:string>>,"
    "relationships array<struct<source:string,target:string,rel_type:string,description:string,confidence:string>>,"
    "cases array<struct<problem:string,solution:string,context:string>>,"
    "patterns array<struct<name:string,process:string,conditions:string>>,"
    "preferences array<struct<facet:string,value:string,context:string>>"
)


def complete(rows: DataFrame, prompt: str, make: Callable[[], Provider], system: str, most: int, keys: list[str]) -> DataFrame:
    """(keys, answer, error): the model's answer to each row's prompt; a failure fills
    `error` and never ends the job.  Concurrency is tasks times executor cores."""

    def run(batches):
        provider = make()
        for pdf in batches:
            answers, errors = [], []
            for p in pdf[prompt]:
                try:
                    answers.append(provider.complete(system, p, most))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(str(e))
            yield pdf[keys].assign(answer=answers, error=errors)

    schema = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    return rows.select(*keys, prompt).mapInPandas(run, f"{schema}, answer string, error string")


def extract(chunks: DataFrame, make: Callable[[], Provider], system: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(chunks with their parsed extraction `x`, failed chunks to be put aside)."""
    answered = complete(chunks, "content", make, system, 8192, keys).withColumn("object", json_object(F.col("answer")))
    good = answered.where("object is not null").select(*keys, F.from_json("object", _DDL).alias("x"))
    return good, answered.where("object is null").select(*keys, F.coalesce("error", F.lit("no object in the answer")).alias("error"))


def flatten(extracted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, name, entity_type, abstract_text, overview, content, attributes): named
    entities first, then cases, patterns and preferences as entities."""
    none = F.lit(None).cast("string")
    row = lambda part, *c: F.struct(F.lit(part).alias("part"), *(x.alias(n) for x, n in zip(c, ("name", "entity_type", "abstract_text", "overview", "content", "attributes"))))
    lists = [
        F.transform("x.entities", lambda e: row(0, e["name"], F.lower(e["type"]), e["abstract"], e["overview"], e["content"], e["attributes"])),
        F.transform(
            "x.cases",
            lambda c: row(
                1, F.concat(F.lit("Case: "), text.cut_bytes(c["problem"], 60)), F.lit("case"),
                F.concat(F.lit("Problem: "), c["problem"], F.lit(" Solution: "), c["solution"]), c["context"],
                F.concat(F.lit("Problem: "), c["problem"], F.lit("\nSolution: "), c["solution"], F.lit("\nContext: "), F.coalesce(c["context"], F.lit("none"))),
                none,
            ),
        ),
        F.transform("x.patterns", lambda p: row(2, p["name"], F.lit("pattern"), p["process"], p["conditions"], none, none)),
        F.transform(
            "x.preferences",
            lambda p: row(3, F.concat(F.lit("Preference: "), p["facet"]), F.lit("preference"), F.concat(p["facet"], F.lit(": "), p["value"]), p["context"], none, none),
        ),
    ]
    empty = F.filter(lists[0], lambda x: F.lit(False))
    every = F.concat(*(F.coalesce(x, empty) for x in lists))
    return extracted.select(*keys, F.posexplode(every).alias("seq", "e")).select(*keys, "seq", "e.*").drop("part")


def local_merge(candidates: DataFrame, order: list[str]) -> DataFrame:
    """One row per name, case ignored: the first name and type, the longest abstract (the
    first of equals), overviews and contents joined in order, attributes overlaid."""
    at = F.struct(*order)
    listed = lambda c: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v"))))), lambda x: x["v"]), "\n\n"
    )
    merged = candidates.groupBy(F.lower("name").alias("key")).agg(
        F.min_by("name", at).alias("name"), F.min_by("entity_type", at).alias("entity_type"),
        F.min_by("abstract_text", F.struct(-F.octet_length(F.coalesce("abstract_text", F.lit(""))), *order)).alias("abstract_text"),
        listed("overview").alias("overview"), listed("content").alias("content"),
        F.array_sort(F.collect_list(F.when(F.col("attributes").isNotNull(), F.struct(*order, F.col("attributes").alias("v"))))).alias("attrs"),
        F.min(at).alias("first"),
    )
    folded = F.aggregate("attrs", F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x["v"]).otherwise(merge_json(a, x["v"])))
    null_if_empty = lambda c: F.when(F.col(c) != "", F.col(c))
    return merged.select(
        "key", "name", "entity_type", "abstract_text", null_if_empty("overview").alias("overview"), null_if_empty("content").alias("content"),
        folded.alias("attributes"), "first",
    )


def similar_entities(candidates: DataFrame, entities: DataFrame, as_of: str, key: str, hits: int = DEDUP_HITS, least: float = DEDUP_SCORE) -> DataFrame:
    """(key, entity_id, similarity, score): of each candidate's nearest entities those
    whose blended score passes; what a model then decides about.

    The candidates' vectors are broadcast, CANDIDATES_AT_ONCE at most; more are compared
    in several passes over the entities.  No more than `hits` per candidate and task
    are shuffled."""
    spark = candidates.sparkSession
    rows = materialize(candidates.select(key, F.col("embedding").cast("array<double>").alias("q")).where(f"{key} is not null and size(q) > 0"), "candidates")
    stored = entities.where("embedding is not null").select("entity_id", "embedding", "access_count", "updated_at", "utility_score")
    kinds = dict(rows.dtypes)[key], dict(stored.dtypes)["updated_at"]
    schema = f"{key} {kinds[0]}, entity_id string, similarity double, access_count long, updated_at {kinds[1]}, utility_score double"
    passes = max(1, -(-rows.count() // CANDIDATES_AT_ONCE))

    def against(block: int) -> DataFrame:
        import numpy as np

        by: dict[int, tuple[list, list]] = {}
        for r in rows.where(F.pmod(F.xxhash64(key), F.lit(passes)) == block).toLocalIterator():
            vector = np.asarray(r["q"], dtype=np.float64)
            norm = np.linalg.norm(vector)
            if norm > 0 and np.isfinite(norm):
                names, vectors = by.setdefault(len(vector), ([], []))
                names.append(r[key])
                vectors.append(vector / norm)
        asked_of = spark.sparkContext.broadcast({w: (np.asarray(n, dtype=object), np.stack(v)) for w, (n, v) in by.items()})

        def run(batches):
            held: dict[int, pd.DataFrame] = {}
            for pdf in batches:
                sizes = pdf["embedding"].map(len)
                for width, (names, q) in asked_of.value.items():
                    own = pdf[sizes == width]
                    if not len(own):
                        continue
                    x = np.stack(own["embedding"].to_numpy()).astype(np.float64)
                    norm = np.linalg.norm(x, axis=1)
                    good = np.isfinite(norm) & (norm > 0)
                    own, x = own[good], x[good] / norm[good][:, None]
                    sims = q @ x.T
                    bar = np.partition(sims, -hits, axis=1)[:, -hits] if sims.shape[1] > hits else np.full(len(q), -2.0)
                    a, b = np.nonzero(sims >= bar[:, None])
                    fresh = own.iloc[b][["entity_id", "access_count", "updated_at", "utility_score"]].assign(n=a, similarity=sims[a, b])
                    both = pd.concat([held[width], fresh]) if width in held else fresh
                    held[width] = both.sort_values(["n", "similarity", "entity_id"], ascending=[True, False, True]).groupby("n").head(hits)
            for width, frame in held.items():
                yield frame.assign(**{key: asked_of.value[width][0][frame["n"].to_numpy()]})[[key, "entity_id", "similarity", "access_count", "updated_at", "utility_score"]]

        return stored.mapInPandas(run, schema)

    pairs = against(0)
    for block in range(1, passes):
        pairs = pairs.unionByName(against(block))
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), "entity_id")
    best = pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= hits)
    hot = scoring.hotness(F.col("access_count"), F.col("updated_at"), as_of)
    return best.withColumn("score", scoring.blended_score(F.col("similarity"), hot, F.col("utility_score"))).where(F.col("score") > least).select(
        key, "entity_id", "similarity", "score"
    )


def dedup_prompt(candidates: DataFrame, similar: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(key, prompt) of the candidates that have similar entities."""
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "entity_type", F.lit("): "), F.coalesce("abstract_text", F.lit("")))
    shown = similar.join(entities.select("entity_id", line.alias("line")), "entity_id").groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "line"))), lambda x: x["line"]), "\n").alias("lines")
    )
    return candidates.join(shown, key).select(
        key,
        F.concat(F.lit("Candidate: "), "name", F.lit(" ("), "entity_type", F.lit(")\n"), F.coalesce("abstract_text", F.lit("")), F.lit("\n\nExisting:\n"), "lines").alias("prompt"),
    )


def decide(answers: DataFrame, key: str, entities: DataFrame) -> DataFrame:
    """(key, action, target_id): skip, create or merge as the answers say; merging into
    an unknown or immutable entity creates instead, an unreadable answer is `error`."""
    got = answers.withColumn("object", json_object(F.col("answer"))).select(
        key, F.lower(F.get_json_object("object", "$.decision")).alias("decision"), F.get_json_object("object", "$.target").alias("target")
    )
    named = first_by_name(entities).join(entities.select("entity_id", "mutable"), "entity_id").select(F.col("name").alias("target"), F.col("entity_id").alias("found_id"), "mutable")
    return got.join(named, "target", "left").select(
        key,
        F.when(F.col("decision") == "skip", "skip").when(F.col("decision") == "create", "create")
        .when((F.col("decision") == "merge") & F.col("mutable"), "merge").when(F.col("decision") == "merge", "create").otherwise("error").alias("action"),
        F.when((F.col("decision") == "merge") & F.col("mutable"), F.col("found_id")).alias("target_id"),
    )


def merged_values(target: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """(entity_id, abstract_text, overview, content, attributes): what merging each
    candidate (key = entity_id) changes; null where nothing changes."""
    t = target.select("entity_id", *(F.col(c).alias(f"t_{c}") for c in ("abstract_text", "overview", "content", "attributes")))
    joined = candidate.select(F.col(key).alias("entity_id"), "abstract_text", "overview", "content", "attributes").join(t, "entity_id")
    longer = F.octet_length("abstract_text") > F.octet_length(F.coalesce("t_abstract_text", F.lit("")))
    join = lambda c, blank: F.when(F.col(c).isNull(), F.lit(None)).when(blank, F.col(c)).otherwise(F.concat(f"t_{c}", F.lit("\n\n"), c))
    return joined.select(
        "entity_id", F.when(longer, F.col("abstract_text")).alias("abstract_text"),
        join("overview", F.coalesce(F.col("t_overview"), F.lit("")) == "").alias("overview"), join("content", F.col("t_content").isNull()).alias("content"),
        F.when(F.col("attributes").isNotNull(), merge_json(F.col("t_attributes"), F.col("attributes"))).alias("attributes"),
    )


def match_relationships(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """The wanted edges (src_id, dst_id, rel_type, certainty) with the edge already there
    (closed ones count too), if any: `rel_id`, and the confidence to store: the stored
    one corroborated, or the prior of the stated certainty."""
    have = edges.groupBy("src_id", "dst_id", "rel_type").agg(F.min_by(F.struct("rel_id", "confidence"), F.struct("valid_from", "rel_id")).alias("e"))
    joined = wanted.join(have, ["src_id", "dst_id", "rel_type"], "left")
    value = F.when(F.col("e").isNull(), scoring.prior(F.col("certainty"))).otherwise(scoring.bayesian_update(F.col("e.confidence"), True))
    return joined.select("src_id", "dst_id", "rel_type", F.col("e.rel_id").alias("rel_id"), value.alias("confidence"))


def name_map(candidates: DataFrame, decided: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(name, resolved): the name each candidate (key, name) goes by after the decisions
    (key, action, target_id): that of the entity it was merged into, else its own.
    Candidates whose decision failed have none."""
    targets = entities.select(F.col("entity_id").alias("target_id"), F.col("name").alias("target_name"))
    return (
        candidates.select(key, "name").join(decided.where("action != 'error'").select(key, "target_id"), key).join(targets, "target_id", "left")
        .select("name", F.coalesce("target_name", "name").alias("resolved"))
    )


def mapped_relationships(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """The wanted edges (source, target, ...) with both ends by their resolved names; an
    end nobody resolved keeps its own."""
    out = wanted
    for end in ("source", "target"):
        known = names.groupBy(F.col("name").alias(end)).agg(F.min("resolved").alias(f"{end}_name"))
        out = out.join(known, end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end))
    return out


def token_estimate(n_chunks: Column, n_candidates: Column) -> Column:
    return n_chunks * TOKENS_PER_CHUNK + n_candidates * TOKENS_PER_CANDIDATE
