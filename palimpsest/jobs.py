"""Whole jobs: what runs when a session ends, when documents change, or on demand.

Each takes tables and returns new ones; `Store` versions hold the state between runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scoring, text
from .operators import conversation, documents, gc, graph, ingest, ordering, signals, state
from .schema import EPISODE
from .session import materialize, stable_id

PARTS_PER_VOLUME = 10_000  # entries of one archive text; a row of a table cannot hold a session of any length
SUMMARY_BYTES = 4000  # of a session's condensed text that a model is shown


def summary_prompts(items: DataFrame) -> DataFrame:
    """(session_id, prompt): the condensed lines of each session, in order, cut at
    SUMMARY_BYTES.  Lines that begin beyond that never leave their task."""
    lines = conversation.condensed(items).withColumn("size", F.octet_length("line") + 1)
    w = ordering.running(lines, ["session_id"], ["entry_id", "pos"], "size", "before", "condensed").where(F.col("before") <= SUMMARY_BYTES)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("before", "entry_id", "pos", "line"))), lambda x: x["line"]), "\n")
    return w.groupBy("session_id").agg(listed.alias("all")).select("session_id", conversation.condensed_text(F.col("all"), SUMMARY_BYTES).alias("prompt"))


def model_summaries(items: DataFrame, make: Callable[[], ingest.Provider], system: str) -> DataFrame:
    """(session_id, summary, topics, decisions, action_items): a model's, five of each at
    most; where it fails or answers no JSON, the summary and topics without one."""
    prompts = summary_prompts(items)
    answered = ingest.complete(prompts, "prompt", make, system, 500, ["session_id"]).withColumn("object", ingest.json_object(F.col("answer")))
    got = answered.select("session_id", F.from_json("object", "summary string, topics array<string>, decisions array<string>, action_items array<string>").alias("m"))
    plain = conversation.summary(items).select("session_id", F.col("summary").alias("plain"))
    topics = conversation.topics(items).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "topic"))).alias("t"))
    none = F.array().cast("array<string>")
    five = lambda c: F.slice(F.coalesce(c, none), 1, 5)
    return plain.join(topics, "session_id", "left").join(got, "session_id", "left").select(
        "session_id", F.when(F.col("m").isNull(), F.col("plain")).otherwise(F.coalesce("m.summary", F.lit(""))).alias("summary"),
        F.when(F.col("m").isNull(), F.coalesce("t.topic", none)).otherwise(five(F.col("m.topics"))).alias("topics"),
        five(F.col("m.decisions")).alias("decisions"), five(F.col("m.action_items")).alias("action_items"),
    )


def tags_section(tags: DataFrame) -> DataFrame:
    """(session_id, section): the footer of an archive."""
    of = lambda t: F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == t, F.struct("n", "item")))), lambda x: x["item"])
    lists = tags.groupBy("session_id").agg(*(of(t).alias(t) for t in ("project", "decision", "action", "file", "tool")))
    bullets = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n**{label}**:\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""))).otherwise("")
    inline = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n**{label}**: "), F.array_join(c, ", "), F.lit("\n"))).otherwise("")
    return lists.select(
        "session_id",
        F.concat(F.lit("\n## Tags\n"), inline("Project", F.col("project")), bullets("Decisions", F.col("decision")), bullets("Action Items", F.col("action")),
                 inline("Files", F.col("file")), inline("Tools", F.col("tool"))).alias("section"),
    )


def archive(
    rows: DataFrame, archives: DataFrame, source: str, now: str, name: str = "archive", parts_per_volume: int = PARTS_PER_VOLUME
) -> tuple[DataFrame, DataFrame]:
    """(new archives (log_number, session_id, volume, file, full_content), their index rows)
    of the sessions no archive names yet.

    A session without user messages is none.  The text of a session is put together
    in volumes of at most `parts_per_volume` entries, so no session, however long, is
    collected whole; nothing is left out, and all but the longest have one volume."""
    todo = conversation.unarchived(rows, archives)
    fresh = materialize(conversation.entries(rows.join(todo, "session_id", "left_semi")), name)
    highest = archives.agg(F.coalesce(F.max("log_number"), F.lit(0)).alias("h")).first()["h"]
    index = materialize(conversation.archive_index(fresh, rows, highest, name), f"{name}-index")
    parts = ordering.numbered(conversation.markdown_lines(fresh, name), ["session_id"], ["entry_id", "pos"], "n", name)
    body = parts.groupBy("session_id", F.floor((F.col("n") - 1) / parts_per_volume).cast("int").alias("volume")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "").alias("body")
    )
    last = body.groupBy("session_id").agg(F.max("volume").alias("last"))
    head = index.join(conversation.summary(fresh), "session_id").join(tags_section(conversation.tags(fresh)), "session_id", "left").join(last, "session_id").select(
        "session_id", "log", "last", F.coalesce("section", F.lit("")).alias("section"), "summary",
        *(c.alias(a) for a, c in {
            "date": F.lit(now), "message_count": F.col("messages"), "duration": F.col("length"), "source": F.lit(source),
            "topics": F.when(F.col("topics") == "—", F.array().cast("array<string>")).otherwise(F.split("topics", ", ")),
        }.items()),
    )
    head = head.withColumn("front", conversation.render_front_matter())
    file = F.format_string("conversation-%03d.md", "log")
    first = F.concat("front", F.lit("\n\n## Summary\n\n"), "summary", F.lit("\n\n"), F.format_string("# Conversation %03d\n\n", "log"))
    texts = body.join(head, "session_id").select(
        F.col("log").alias("log_number"), "session_id", "volume", file.alias("file"),
        F.concat(F.when(F.col("volume") == 0, first).otherwise(""), "body", F.when(F.col("volume") == F.col("last"), F.concat(F.lit("\n"), "section")).otherwise("")).alias("full_content"),
    )
    return texts, index


def ephemeral_lines() -> Column:
    """A session of the short-term file, of the columns of archive_index and its summary."""
    shown = F.replace(F.replace("date", F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(" UTC"))
    return F.concat(
        F.lit("## Session "), "session_id", F.lit(" — "), shown, F.lit("\n**Duration**: ~"), "length", F.lit(" | **Messages**: "), F.col("messages").cast("string"),
        F.lit(" | **Archive**: "), F.format_string("conversation-%03d.md", "log"), F.lit("\n**Summary**: "), "summary",
    )


def ephemeral(index: DataFrame, summaries: DataFrame, most: int = 5) -> DataFrame:
    """(log, entry): the last `most` sessions, oldest first."""
    last = ordering.kept_last(index, [F.col("log")], most)
    return last.join(summaries, "session_id").select("log", ephemeral_lines().alias("entry")).orderBy("log")


def checkpoint(hook: DataFrame, known: DataFrame, trigger: str, now: str) -> DataFrame:
    """(session_id, source, date, content): what a compaction leaves of sessions whose
    transcript is not there: a placeholder for each, so that the log has no gap."""
    return hook.select("session_id").distinct().join(known.select("session_id"), "session_id", "left_anti").select(
        "session_id", F.lit(trigger).alias("source"), F.lit(now).alias("date"), F.lit("No transcript available at this checkpoint.").alias("content")
    )


def checkpoint_sessions(hook: DataFrame, rows: DataFrame, archives: DataFrame, trigger: str, now: str, name: str = "checkpoint") -> DataFrame:
    """(log_number, session_id, volume, full_content): archives of the sessions of `hook`
    as they stand at a compaction, numbered on from the highest log: those with a
    transcript from its rows, whether archived before or not, then placeholders."""
    sessions = hook.select("session_id").where("session_id is not null").distinct()
    told = rows.join(sessions, "session_id", "left_semi")
    # The highest log alone: sessions archived before are archived again as they stand.
    highest = archives.agg(F.max("log_number").alias("log_number")).withColumn("session_id", F.lit(None).cast("string"))
    texts, index = archive(told, highest, trigger, now, name)
    texts = materialize(texts.select(F.col("log_number").cast("long").alias("log_number"), "session_id", "volume", "full_content"), f"{name}-texts")
    logs = index.select(F.col("log").cast("long").alias("log_number")).unionByName(highest.select(F.col("log_number").cast("long").alias("log_number")))
    last = logs.agg(F.coalesce(F.max("log_number"), F.lit(0)).alias("last")).withColumn("one", F.lit(1))
    empty = ordering.numbered(checkpoint(sessions, texts, trigger, now), [], ["session_id"], "n", f"{name}-empty").withColumn("one", F.lit(1))
    number = F.col("last") + F.col("n")
    body = F.format_string('---\nlog: %d\ndate: "%s"\nsession_id: "%s"\nsource: "%s"\n---\n\n%s\n', number, "date", "session_id", "source", "content")
    more = empty.join(last, "one").select(number.cast("long").alias("log_number"), "session_id", F.lit(0).alias("volume"), body.alias("full_content"))
    return texts.unionByName(more)


def ingest_archives(archives: DataFrame, episodes: DataFrame, now: str, embed=None, tokens: int = 500) -> DataFrame:
    """The episodes with those of archives not ingested yet (by log number; archives
    without one are always ingested)."""
    known = episodes.select("log_number").where("log_number is not null").distinct()
    todo = archives.join(known, "log_number", "left_anti")
    made = todo.select("session_id", "log_number", F.posexplode(text.chunks(F.col("full_content"), tokens)).alias("i", "content")).withColumn(
        "abstract_text", text.episode_abstract(F.col("content"))
    )
    values = {
        "episode_id": F.concat(F.lit("episode:"), F.substring(stable_id("session_id", "log_number", "i", "content"), 1, 20)), "session_id": F.col("session_id"),
        "timestamp": scoring.literal_time(now), "abstract_text": F.col("abstract_text"), "overview": F.lit(None).cast("string"), "content": F.col("content"),
        "embedding": embed(F.col("abstract_text")) if embed else F.lit(None).cast("array<float>"), "log_number": F.col("log_number").cast("long"), "extracted": F.lit(False),
    }
    return episodes.unionByName(made.select(*(values[f.name].alias(f.name) for f in EPISODE.fields)))


def extract(episodes: DataFrame, make: Callable[[], ingest.Provider], system: str, most_tokens: int = 5_000_000, name: str = "extract") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, failed (log_number, episode_id, error), logs done): one run over the
    episodes not extracted yet, in order of log, as far as the token budget goes.  A
    failed chunk is tried once more, then put aside; its log is not done."""
    todo = episodes.where("not extracted and log_number is not null")
    per_log = todo.groupBy("log_number").agg((F.count("*") * ingest.TOKENS_PER_CHUNK).alias("cost"))
    chosen = materialize(conversation.token_budget(per_log, "log_number", F.col("cost"), most_tokens, name), name)
    chunks = todo.join(chosen.select("log_number"), "log_number", "left_semi").select("log_number", "episode_id", "content")
    keys = ["log_number", "episode_id"]
    good, failed = (materialize(x, name) for x in ingest.extract(materialize(chunks, name), make, system, keys))
    again, lost = ingest.extract(chunks.join(failed.select("episode_id"), "episode_id", "left_semi"), make, system, keys)
    lost = materialize(lost, f"{name}-lost")
    done = chosen.select("log_number").join(lost.select("log_number"), "log_number", "left_anti")
    return ingest.flatten(good.unionByName(again), keys), lost, done


def process_extraction(
    extracted: DataFrame, entities: DataFrame, edges: DataFrame, make: Callable[[], ingest.Provider], system: str, now: str, source: str, embed, keys: list[str],
    name: str = "process",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, report (what, n)) after an extraction (keys, x): candidates are
    merged by name, those like stored entities are decided about by the model, the rest
    created; relationships go by the resolved names, known ones are corroborated.

    All candidates see the same stored state; those of one name are one candidate."""
    flat = ingest.flatten(extracted, keys)
    merged = ingest.local_merge(flat, [*keys, "seq"]).drop("first")
    cands = materialize(merged.withColumn("embedding", embed(F.coalesce("abstract_text", F.lit("")))), name)
    similar = materialize(ingest.similar_entities(cands, entities, now, "key"), f"{name}-similar")
    prompts = ingest.dedup_prompt(cands, similar, entities, "key")
    answers = materialize(ingest.complete(prompts, "prompt", make, system, 300, ["key"]), f"{name}-answers")
    asked = ingest.decide(answers, "key", entities)
    fresh = cands.select("key").join(answers.select("key"), "key", "left_anti").select("key", F.lit("create").alias("action"), F.lit(None).cast("string").alias("target_id"))
    decided = materialize(fresh.unionByName(asked), f"{name}-decided")
    of = lambda action: decided.where(F.col("action") == action)
    values = ["abstract_text", "overview", "content", "attributes"]
    merging = cands.join(of("merge").select("key", "target_id"), "key")
    # Of several candidates merged into one entity the values are joined in order of their names.
    one = ingest.local_merge(merging.select(F.col("target_id").alias("name"), "key", "entity_type", *values), ["key"]).withColumn("entity_id", F.col("name"))
    changes = ingest.merged_values(entities, one, "entity_id")
    created = cands.join(of("create").select("key"), "key", "left_semi").select("name", "entity_type", *values, F.lit(source).alias("source"))
    grown = materialize(state.add_entities(state.update_entities(entities, changes, now), created, now, embed), f"{name}-entities")
    names = ingest.name_map(cands, decided, entities, "key")
    rels = extracted.select(F.explode("x.relationships").alias("r")).select(F.col("r.source").alias("source"), F.col("r.target").alias("target"), "r.rel_type", "r.description", F.col("r.confidence").alias("certainty"))
    wanted = materialize(ingest.mapped_relationships(rels, names), f"{name}-wanted")
    ids = graph.first_by_name(grown)
    named = lambda end, id_: ids.select(F.col("name").alias(end), F.col("entity_id").alias(id_))
    ends = wanted.join(named("source_name", "src_id"), "source_name", "left").join(named("target_name", "dst_id"), "target_name", "left")
    matched = materialize(ingest.match_relationships(ends.where("src_id is not null and dst_id is not null"), edges), f"{name}-matched")
    again = matched.where("rel_id is not null")
    # Each further mention of a known edge is one more observation.
    counted = again.select("rel_id", F.struct("src_id", "dst_id", F.monotonically_increasing_id().alias("n")).alias("seq"), F.lit(True).alias("corroborates"))
    kept = state.reinforce(edges, counted, now)
    unknown = matched.where("rel_id is null").select("src_id", "dst_id", "rel_type").distinct()
    pairs = unknown.join(named("source_name", "src_id"), "src_id").join(named("target_name", "dst_id"), "dst_id")
    keys = ["source_name", "target_name", "rel_type"]
    new = wanted.join(pairs.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.min(F.struct("description", "certainty")).alias("first"), F.count("*").alias("mentions"))
    fold = F.aggregate(F.sequence(F.lit(1), F.col("mentions") - 1), scoring.prior(F.col("first.certainty")), lambda c, _: scoring.bayesian_update(c, True))
    confidence = F.when(F.col("mentions") > 1, fold).otherwise(scoring.prior(F.col("first.certainty")))
    rows = new.select(
        F.col("source_name").alias("from_name"), F.col("target_name").alias("to_name"), "rel_type", F.col("first.description").alias("description"),
        confidence.alias("confidence"), F.lit(source).alias("source"),
    )
    more, _ = state.add_relationships(kept, grown, rows, now)
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    report = (
        decided.groupBy(F.concat(F.lit("entities_"), "action").alias("what")).agg(F.count("*").alias("n"))
        .unionByName(count(rows, "relationships_created")).unionByName(count(again, "relationships_skipped"))
        .unionByName(count(ends.where("src_id is null or dst_id is null"), "relationships_failed"))
    )
    spent = extracted.select(F.lit(1).alias("chunk"), F.lit(0).alias("candidate")).unionByName(cands.select(F.lit(0).alias("chunk"), F.lit(1).alias("candidate")))
    tokens = spent.agg(F.coalesce(F.sum("chunk"), F.lit(0)).alias("c"), F.coalesce(F.sum("candidate"), F.lit(0)).alias("k"))
    report = report.unionByName(tokens.select(F.lit("estimated_tokens").alias("what"), ingest.token_estimate(F.col("c"), F.col("k")).cast("long").alias("n")))
    return grown, more, report


def hand_off(steps: dict[str, Callable[[], object]]) -> tuple[dict[str, object], dict[str, str]]:
    """(results, errors) of the named steps after an archive: one that fails is noted and
    never stops the others."""
    results, errors = {}, {}
    for name, step in steps.items():
        try:
            results[name] = step()
        except Exception as e:  # noqa: BLE001
            errors[name] = str(e)
    return results, errors


def after_archive(
    config, archives: DataFrame, episodes: DataFrame, docs: Callable[[str], DataFrame], entities: DataFrame, edges: DataFrame, now: str, embed=None
) -> tuple[dict[str, object], dict[str, str]]:
    """(results, errors) of what follows an archive: its episodes, and, if the settings ask
    for it and name a folder, the reconciliation of the process documents there."""
    steps: dict[str, Callable[[], object]] = {"episodes": lambda: ingest_archives(archives.where("log_number > 0"), episodes, now, embed)}
    if config.pipeline.auto_sync:

        def sync():
            if not config.pipeline.docs_dir:
                raise ValueError("auto_sync is on but no docs_dir is set")
            return sync_documents(docs(config.pipeline.docs_dir).withColumn("k", F.col("stage")), "k", "stage", "text", entities, edges, now)

        steps["documents"] = sync
    return hand_off(steps)


def sync_documents(docs: DataFrame, key: str, stage: str, body: str, entities: DataFrame, edges: DataFrame, now: str, name: str = "sync") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, report) after reconciling the five documents with the graph:
    new entries are created, changed ones updated, missing ones archived, and the
    relationships they name added where the entity has none of that type yet."""
    parsed = materialize(documents.parse(docs, key, stage, body), name)
    changes = materialize(documents.diff(parsed, entities), name)
    made = documents.as_entities(parsed).withColumn("key", text.normalize_key(F.col("name")))
    of = lambda action: changes.where(F.col("action") == action)
    new = made.join(of("create").select("entity_type", "key"), ["entity_type", "key"], "left_semi").drop("key")
    updated = made.join(of("update").select("entity_type", "key", "entity_id"), ["entity_type", "key"]).select("entity_id", "abstract_text", "overview", "attributes")
    gone = of("archive").select("entity_id").join(entities.select("entity_id", "attributes"), "entity_id").select(
        "entity_id", F.lit(None).cast("string").alias("abstract_text"), F.lit(None).cast("string").alias("overview"),
        state.merge_json(F.coalesce("attributes", F.lit("{}")), F.lit('{"pipeline_status":"archived"}')).alias("attributes"),
    )
    entities = materialize(state.add_entities(state.update_entities(entities, updated.unionByName(gone), now), new, now), name)
    wanted = documents.infer_relationships(parsed, F.struct(key, "section_no", "entry_no"), name)
    named = graph.first_by_name(entities)
    ends = wanted.join(named.select(F.col("name").alias("source"), "entity_id"), "source").join(named.select(F.col("name").alias("target"), F.col("entity_id").alias("target_id")), "target")
    missing = documents.missing_edges(ends, edges).dropDuplicates(["entity_id", "rel_type"])
    rows = missing.select(
        F.col("source").alias("from_name"), F.col("target").alias("to_name"), "rel_type", "description", F.lit(1.0).alias("confidence"), F.lit("pipeline:sync").alias("source")
    )
    more, _ = state.add_relationships(edges, entities, rows, now)
    report = documents.report(changes).unionByName(rows.agg(F.count("*").alias("n")).select(F.lit("relate").alias("action"), "n"))
    return entities, more, report


def sync_signals(vectors: DataFrame, entities: DataFrame, now: str, embed=None) -> DataFrame:
    """The entities with a measurement for each signal whose time none has yet."""
    known = entities.where("entity_type = 'measurement'").select(F.get_json_object("attributes", "$.timestamp").alias("timestamp"))
    made = signals.signal_entities(signals.new_signals(vectors, known)).withColumn("source", F.lit("signals"))
    return state.add_entities(entities, made, now, embed)


def signal_report(before: DataFrame, entities: DataFrame, edges_before: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n) of what syncing signals and outcomes has added to the tables."""
    added = entities.join(before.select("entity_id"), "entity_id", "left_anti").groupBy("entity_type").agg(F.count("*").alias("n"))
    linked = edges.join(edges_before.select("rel_id"), "rel_id", "left_anti").agg(F.count("*").alias("n"))
    return added.select(F.concat("entity_type", F.lit("s_created")).alias("what"), "n").unionByName(linked.select(F.lit("relationships_created").alias("what"), "n"))


def sync_outcomes(outcomes: DataFrame, entities: DataFrame, edges: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) with an outcome entity for each task outcome not there yet, and an
    edge to the entity its domain names."""
    attrs = lambda k: F.get_json_object("attributes", f"$.{k}").alias(k)
    known = entities.where("entity_type = 'outcome'").select(attrs("task_id"), attrs("timestamp"))
    fresh = signals.new_outcomes(outcomes, known)
    name = F.concat(F.lit("outcome-"), "task_id", F.lit("-"), "timestamp")
    made = fresh.select(
        name.alias("name"), F.lit("outcome").alias("entity_type"), F.concat("outcome", F.lit(": "), "description").alias("abstract_text"),
        F.to_json(F.struct("task_id", "timestamp", "domain", "task_type", "outcome", "tokens_used", "tool_rounds")).alias("attributes"), F.lit("outcomes").alias("source"),
    )
    grown = state.add_entities(entities, made, now)
    wanted = fresh.select(
        name.alias("from_name"), F.col("domain").alias("to_name"), F.lit("RESULTED_IN").alias("rel_type"), F.concat("outcome", F.lit(" in "), "domain").alias("description"),
        F.lit(1.0).alias("confidence"), F.lit("outcomes").alias("source"),
    )
    more, _ = state.add_relationships(edges, grown, wanted, now)
    return grown, more


def collect_garbage(entities: DataFrame, edges: DataFrame, as_of: str, dry_run: bool = True, limits: gc.Limits = gc.Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, report); a dry run reports and changes nothing."""
    report = gc.report(entities, edges, as_of, limits)
    return (entities, edges, report) if dry_run else (*gc.collect(entities, edges, as_of, limits), report)
