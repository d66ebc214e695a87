"""python -m palimpsest ROOT COMMAND ...: the operators from a shell.

ROOT holds `graph/` (versioned tables), `conversations/` (archives), the curated
MEMORY.md, the short-term EPHEMERAL.md and the process documents.
"""

from __future__ import annotations

import argparse
import os
from datetime import UTC, datetime

from pyspark.sql import functions as F

from . import jobs
from .functions import text
from .operators import conversation, graph, health, ingest, search, state
from .session import local_session
from .sources import config, files
from .sources.snapshots import Store

TEMPLATES = {"MEMORY.md": "# Memory\n", "EPHEMERAL.md": "", "ARCHIVE.md": "", "config.toml": ""}


def initialise(root: str) -> list[str]:
    """Makes what is missing; what is there stays as it is."""
    os.makedirs(os.path.join(root, "conversations"), exist_ok=True)
    made = []
    for name, body in TEMPLATES.items():
        path = os.path.join(root, name)
        if not os.path.exists(path):
            with open(path, "w", encoding="utf-8") as f:
                f.write(body)
            made.append(name)
    return made


def health_status(root: str) -> tuple[str, str]:
    """(Healthy, Degraded or Down, what is missing) of a folder."""
    if not os.path.isdir(root):
        return "Down", "memory directory not found"
    if not os.path.exists(os.path.join(root, "MEMORY.md")):
        return "Degraded", "MEMORY.md not found"
    if not os.path.isdir(os.path.join(root, "conversations")):
        return "Degraded", "conversations directory not found"
    return "Healthy", ""


def consume(root: str) -> str | None:
    """The short-term file, trimmed; none if it is missing or blank.  It is not cleared."""
    try:
        with open(os.path.join(root, "EPHEMERAL.md"), encoding="utf-8") as f:
            return f.read().strip() or None
    except OSError:
        return None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    p.add_argument("root")
    sub = p.add_subparsers(dest="command")
    sub.add_parser("init")
    sub.add_parser("status")
    sub.add_parser("consume")
    sub.add_parser("distill")
    sub.add_parser("health")
    sub.add_parser("dashboard")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--ranked", action="store_true")
    s.add_argument("-C", "--context", type=int, default=0)
    s.add_argument("--max-results", type=int, default=10)
    c = sub.add_parser("config")
    c.add_argument("key", nargs="?")
    c.add_argument("value", nargs="?")
    a = sub.add_parser("archive")
    a.add_argument("transcripts")
    for name in ("stats", "ingest"):
        sub.add_parser(name)
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("--limit", type=int, default=10)
    q.add_argument("--type")
    q.add_argument("--keyword")
    q.add_argument("--depth", type=int, default=1)
    t = sub.add_parser("traverse")
    t.add_argument("name")
    t.add_argument("--depth", type=int, default=2)
    t.add_argument("--type")
    e = sub.add_parser("add-entity")
    e.add_argument("--name", required=True)
    e.add_argument("--type", required=True)
    e.add_argument("--abstract", required=True)
    r = sub.add_parser("relate")
    r.add_argument("source")
    r.add_argument("rel")
    r.add_argument("target")
    r.add_argument("--confidence", type=float, default=1.0)
    g = sub.add_parser("gc")
    g.add_argument("--execute", action="store_true")
    d = sub.add_parser("decay")
    d.add_argument("--all", action="store_true")
    d.add_argument("--entity")
    y = sub.add_parser("sync")
    y.add_argument("docs")
    w = sub.add_parser("stale")
    w.add_argument("--days", type=int, default=7)
    f = sub.add_parser("flow")
    f.add_argument("name")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    root, command = args.root, args.command or "status"
    if command == "init":
        print("\n".join(initialise(root)) or "nothing to do")
        return 0
    if command == "consume":
        print(consume(root) or "")
        return 0
    if command == "health":
        state_, why = health_status(root)
        print(state_, why)
        return int(state_ == "Down")
    settings = os.path.join(root, "config.toml")
    if command == "config":
        cfg = config.load(settings)
        if args.key:
            with open(settings, "w", encoding="utf-8") as f:
                f.write(config.dumps(config.set_key(cfg, args.key, args.value)))
        print(config.dumps(cfg))
        return 0
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    store = Store(spark, os.path.join(root, "graph"))
    now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
    entities, edges, episodes = (store.read(n) for n in ("entity", "relates_to", "episode"))
    embed = ingest.embedding(ingest.HashingEmbedder)
    talks = os.path.join(root, "conversations")

    def archives():
        return files.archives(spark, talks)

    if command == "status":
        memory = spark.read.text(os.path.join(root, "MEMORY.md"), wholetext=True).select(F.lit("MEMORY.md").alias("file"), F.col("value").alias("text"))
        health.memory_health(memory, "file", "text").withColumn("bar", text.progress_bar(F.least(F.lit(100), F.col("percent")))).show(truncate=False)
        archives().agg(F.count("*").alias("archives"), F.sum("bytes").alias("bytes"), F.max("modified").alias("newest")).show(truncate=False)
    elif command == "dashboard":
        memory = spark.read.text(os.path.join(root, "MEMORY.md"), wholetext=True).select(F.lit("MEMORY.md").alias("file"), F.col("value").alias("text"))
        recent = conversation.ephemeral_entries(spark.createDataFrame([("EPHEMERAL.md", consume(root) or "")], "file string, text string"), "file", "text")
        stored = archives().withColumn("modified", F.col("modified").cast("timestamp_ntz"))
        health.dashboard(memory, "file", "text", stored, "text", "modified", recent, now).orderBy("line_no").show(truncate=False)
    elif command == "distill":
        memory = spark.read.text(os.path.join(root, "MEMORY.md"), wholetext=True).select(F.lit("MEMORY.md").alias("file"), F.col("value").alias("text"))
        for df in (health.largest_sections(health.section_sizes(memory, "file", "text")), health.repeated_lines(memory, "file", "text"),
                   health.empty_sections(memory, "file", "text"), health.stale_lines(memory, "file", "text", now[:7]), health.distill(memory, "file", "text"), health.suggestions(memory, "file", "text", now[:7])):
            df.show(truncate=False)
    elif command == "search":
        found = search.ranked_search(archives(), args.query, args.max_results) if args.ranked else search.line_search_context(archives(), args.query, args.context)
        found.show(1000, truncate=False)
    elif command == "archive":
        rows = files.transcripts(spark, args.transcripts)
        known = archives().select("log_number", F.regexp_extract("text", r'session_id: "([^"]*)"', 1).alias("session_id"))
        texts, index = jobs.archive(rows, known, "jsonl", now)
        files.write_archives(texts.select("file", F.col("full_content").alias("text")), os.path.join(talks, "new"))
        index.select("line").show(1000, truncate=False)
    elif command == "ingest":
        rows = archives().select(F.regexp_extract("text", r'session_id: "([^"]*)"', 1).alias("session_id"), "log_number", F.col("text").alias("full_content"))
        print(store.write("episode", jobs.ingest_archives(rows, episodes, now, embed)))
        results, errors = jobs.after_archive(config.load(settings), rows.limit(0), episodes, lambda folder: files.process_documents(spark, folder), entities, edges, now, embed)
        if "documents" in results:
            kept, left, report = results["documents"]
            report.show()
            store.write("entity", kept)
            store.write("relates_to", left)
        for name, why in errors.items():
            print(f"{name}: {why}")
    elif command == "stats":
        graph.stats(entities, edges, episodes).unionByName(graph.type_counts(entities).withColumnRenamed("entity_type", "what")).show(100, truncate=False)
    elif command == "query":
        vector = search.literal_vector(ingest.HashingEmbedder().embed([args.text])[0])
        search.hybrid(entities, edges, vector, now, args.limit, args.depth, args.type, args.keyword, config.load(settings).graph.weights()).show(args.limit, truncate=False)
    elif command == "traverse":
        print(graph.render_tree(graph.traverse_tree(entities, edges, args.name, args.depth, now, args.type)))
    elif command == "add-entity":
        new = spark.createDataFrame([(args.name, args.type, args.abstract)], "name string, entity_type string, abstract_text string")
        print(store.write("entity", state.add_entities(entities, new, now, embed)))
    elif command == "relate":
        new = spark.createDataFrame([(args.source, args.target, args.rel, None, args.confidence, None)], "from_name string, to_name string, rel_type string, description string, confidence double, source string")
        more, rejected = state.add_relationships(edges, entities, new, now)
        if rejected.count():
            raise SystemExit("an end is unknown")
        print(store.write("relates_to", more))
    elif command == "gc":
        kept, left, report = jobs.collect_garbage(entities, edges, now, not args.execute)
        report.show()
        if args.execute:
            store.write("entity", kept)
            store.write("relates_to", left)
    elif command == "decay":
        at = graph.first_by_name(entities).where(F.col("name") == args.entity).first() if args.entity else None
        if args.entity and not at:
            raise SystemExit(f"no entity is named {args.entity!r}")
        graph.decay_report(edges, now, args.all, at["entity_id"] if at else None).show(1000, truncate=False)
    elif command == "sync":
        kept, left, report = jobs.sync_documents(files.process_documents(spark, args.docs).withColumn("k", F.col("stage")), "k", "stage", "text", entities, edges, now)
        report.show()
        store.write("entity", kept)
        store.write("relates_to", left)
    elif command == "stale":
        graph.stale(entities, edges, now, args.days).show(1000, truncate=False)
    elif command == "flow":
        graph.flow(entities, edges, spark.createDataFrame([(args.name,)], "name string")).show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
