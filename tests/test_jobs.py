import json

import pytest
from pyspark.sql import functions as F

from palimpsest import __main__ as cli
from palimpsest import jobs
from palimpsest.operators import conversation
from palimpsest.schema import EPISODE
from test_documents_and_ingest import PRAXIS, THOUGHTS, scripted
from test_graph import AS_OF, edge, edges, entities

ROWS = [
    (1, "u1", "s", "user", "user", "We decided to go with plan A. TODO: write it", "2026-01-01T10:00:00Z"),
    (2, "u2", "s", "assistant", "assistant", json.dumps([{"type": "text", "text": "Fine"}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls src/x"}}]), "2026-01-01T10:05:00Z"),
    (3, "u3", "t", "user", "user", "hello there", "2026-01-02T10:00:00Z"), (4, "u4", "v", "assistant", "assistant", "alone", "2026-01-03T10:00:00Z"),
]


def rows(spark):
    return spark.createDataFrame(ROWS, "entry_id long, entry_uuid string, session_id string, entry_type string, role string, content string, entry_timestamp string")


def test_archive_and_ingest(spark):
    known = spark.createDataFrame([("t", 7)], "session_id string, log_number long")
    texts, index = jobs.archive(rows(spark), known, "jsonl", "2026-02-01T00:00:00Z")
    got = texts.collect()
    assert [(x.session_id, x.log_number, x.file, x.volume) for x in got] == [("s", 8, "conversation-008.md", 0)]
    t = got[0].full_content
    assert t.startswith('---\nlog: 8\ndate: "2026-02-01') and "### User" in t and "**Tools**: Bash" in t and "- decided to go with plan A." in t
    assert conversation.front_matter(texts, "file", "full_content").first().message_count == 2
    entry = jobs.ephemeral(index, conversation.summary(conversation.entries(rows(spark))), 1).collect()
    assert len(entry) == 1 and "**Messages**: 2" in entry[0].entry
    empty = spark.createDataFrame([], EPISODE)
    eps = jobs.ingest_archives(texts.select("session_id", "log_number", "full_content"), empty, "2026-02-01 00:00:00")
    assert eps.count() >= 1 and jobs.ingest_archives(texts.select("session_id", "log_number", "full_content"), eps, "2026-02-01 00:00:00").count() == eps.count()


def test_model_summary_falls_back(spark):
    class Model:
        def complete(self, system, user, most):
            if "hello" in user:
                raise RuntimeError("down")
            return '{"summary": "S", "topics": ["a", "b", "c", "d", "e", "f"]}'

    got = {x.session_id: x for x in jobs.model_summaries(conversation.entries(rows(spark)), Model, "sys").collect()}
    assert got["s"].summary == "S" and len(got["s"].topics) == 5 and got["t"].summary == "hello there" and "hello" in got["t"].topics


def test_extract_puts_failures_aside(spark):
    base = dict.fromkeys((f.name for f in EPISODE.fields))
    eps = [tuple({**base, "episode_id": f"e{i}", "content": c, "log_number": n, "extracted": False}[f.name] for f in EPISODE.fields) for i, (c, n) in enumerate([("good", 1), ("boom", 2), ("later", 3)])]
    found, lost, done = jobs.extract(spark.createDataFrame(eps, EPISODE), scripted(), "sys", 5000)
    assert {x.episode_id for x in found.collect()} == {"e0"} and [x.episode_id for x in lost.collect()] == ["e1"] and [x.log_number for x in done.collect()] == [1]


def test_sync_is_idempotent(spark):
    docs = spark.createDataFrame([(1, "thoughts", THOUGHTS), (2, "praxis", PRAXIS)], "f int, stage string, text string")
    e, r, report = jobs.sync_documents(docs, "f", "stage", "text", entities(spark, []), edges(spark, []), AS_OF)
    assert {x.action: x.n for x in report.collect()} == {"create": 4, "relate": 3}
    e2, r2, again = jobs.sync_documents(docs, "f", "stage", "text", e, r, AS_OF)
    assert {x.action: x.n for x in again.collect()} == {"keep": 4, "relate": 0} and e2.count() == 4 and r2.count() == r.count()
    only = docs.where("stage = 'praxis'")
    e3, _, third = jobs.sync_documents(only, "f", "stage", "text", e2, r2, AS_OF)
    assert {x.action: x.n for x in third.collect()}["archive"] == 2 and e3.where("attributes like '%archived%'").count() == 2


def test_signals_outcomes_and_gc(spark):
    v = spark.createDataFrame([("t1", "x", 0.5, None, None, None)], "timestamp string, trigger string, vocabulary_diversity double, question_generation double, thought_lifecycle double, evidence_grounding double")
    e = jobs.sync_signals(v, entities(spark, [dict(entity_id="d", name="dom")]), AS_OF)
    assert e.count() == 2 and jobs.sync_signals(v, e, AS_OF).count() == 2
    o = spark.createDataFrame([("k", "t", "dom", "tt", "desc", "success", 1, 2)], "task_id string, timestamp string, domain string, task_type string, description string, outcome string, tokens_used long, tool_rounds long")
    e2, r2 = jobs.sync_outcomes(o, e, edges(spark, []), AS_OF)
    assert e2.count() == 3 and r2.first().dst_id == "d"
    assert jobs.sync_outcomes(o, e2, r2, AS_OF)[0].count() == 3
    kept, left, report = jobs.collect_garbage(e2, r2, AS_OF)
    assert kept.count() == 3 and {x.kind for x in report.collect()} == {"orphan"}
    assert jobs.collect_garbage(e2, r2, AS_OF, dry_run=False)[0].count() < 3
    hook = spark.createDataFrame([("a",), ("a",), ("b",)], "session_id string")
    assert jobs.checkpoint(hook, hook.where("session_id = 'b'"), "precompact", "now").count() == 1


def test_short_turns_keep_their_text_up_to_the_bytes(spark):
    short = [(i, f"u{i}", "s", "user", "user", f"m{i}", "2026-01-01T10:00:00Z") for i in range(700)]
    items = conversation.entries(spark.createDataFrame(short, rows(spark).schema).repartition(5))
    got = jobs.summary_prompts(items).first().prompt
    whole = "\n".join(f"User: m{i}" for i in range(700))
    assert got == whole[:4000] + "\n… (conversation truncated)" and got.count("\n") > 350


def test_volumes_lose_nothing(spark):
    texts, _ = jobs.archive(rows(spark), spark.createDataFrame([], "session_id string, log_number long"), "jsonl", "now", parts_per_volume=1)
    whole, _ = jobs.archive(rows(spark), spark.createDataFrame([], "session_id string, log_number long"), "jsonl", "now")
    parts = {}
    for x in texts.orderBy("session_id", "volume").collect():
        parts[x.session_id] = parts.get(x.session_id, "") + x.full_content
    assert parts == {x.session_id: x.full_content for x in whole.collect()} and texts.count() > whole.count()


def test_extraction_end_to_end(spark):
    x = [("1", json.dumps({"entities": [{"name": "Old Tool", "type": "Tool", "abstract": "a much longer abstract"}, {"name": "New", "type": "Concept", "abstract": "n"}],
                           "relationships": [{"source": "Old Tool", "target": "New", "rel_type": "USES", "confidence": "explicit"}, {"source": "Old Tool", "target": "Base", "rel_type": "IS"},
                                             {"source": "New", "target": "nobody", "rel_type": "IS"}]})),
         ("2", json.dumps({"entities": [{"name": "new", "type": "concept", "abstract": "n again"}], "relationships": [{"source": "Old Tool", "target": "New", "rel_type": "USES", "confidence": "explicit"}]}))]

    class Model:
        def complete(self, system, user, most):
            return user if user.startswith("{") else '{"decision": "merge", "target": "Tool of old"}'

    from palimpsest.operators import ingest

    chunks = spark.createDataFrame(x, "k string, content string")
    found, failed = ingest.extract(chunks, Model, "sys", ["k"])
    embed = ingest.embedding(ingest.HashingEmbedder)
    vector = ingest.HashingEmbedder().embed(["a much longer abstract"])[0]
    e = entities(spark, [dict(entity_id="t", name="Tool of old", abstract_text="short", embedding=vector, access_count=50), dict(entity_id="b", name="Base")])
    r = edges(spark, [edge(1, "t", "b", rel_type="IS", confidence=0.5)])
    grown, more, report = jobs.process_extraction(found, e, r, Model, "sys", AS_OF, "s", embed, ["k"])
    got = {x.name: x for x in grown.collect()}
    assert failed.count() == 0 and set(got) == {"Tool of old", "Base", "New"} and got["Tool of old"].abstract_text == "a much longer abstract"
    rel = {(x.src_id, x.rel_type): x for x in more.collect()}
    assert len(rel) == 2 and rel["t", "IS"].confidence == pytest.approx((0.5 * 10 + 1) / 11)
    assert rel["t", "USES"].dst_id == got["New"].entity_id and rel["t", "USES"].confidence == pytest.approx((0.9 * 10 + 1) / 11, abs=1e-6)
    assert {x.what: x.n for x in report.collect()} == {
        "entities_merge": 1, "entities_create": 1, "relationships_created": 1, "relationships_skipped": 1, "relationships_failed": 1, "estimated_tokens": 2 * 2500 + 2 * 600
    }


def test_checkpoint_of_sessions_with_and_without_transcripts(spark):
    hook = spark.createDataFrame([("s",), ("s",), ("gone",), ("lost",), (None,)], "session_id string")
    known = spark.createDataFrame([(7, "s")], "log_number long, session_id string")
    got = {x.session_id: x for x in jobs.checkpoint_sessions(hook, rows(spark), known, "precompact", "now").collect()}
    assert {k: x.log_number for k, x in got.items()} == {"s": 8, "gone": 9, "lost": 10}
    assert 'source: "precompact"' in got["s"].full_content and "No transcript" in got["gone"].full_content


def test_what_follows_an_archive(spark):
    class Settings:
        pipeline = type("P", (), {"auto_sync": False, "docs_dir": ""})()

    docs = lambda folder: spark.createDataFrame([("thoughts", THOUGHTS)], "stage string, text string") if folder == "d" else 1 / 0
    archives = spark.createDataFrame([("s", 3, "text"), ("z", 0, "none")], "session_id string, log_number long, full_content string")
    run = lambda: jobs.after_archive(Settings, archives, spark.createDataFrame([], EPISODE), docs, entities(spark, []), edges(spark, []), AS_OF)
    results, errors = run()
    assert set(results) == {"episodes"} and results["episodes"].count() == 1 and not errors
    Settings.pipeline.auto_sync = True
    results, errors = run()
    assert set(results) == {"episodes"} and "docs_dir" in errors["documents"]
    Settings.pipeline.docs_dir = "d"
    results, errors = run()
    assert results["documents"][0].count() == 2 and not errors


def test_health_and_dashboard(spark, tmp_path):
    assert cli.health_status(str(tmp_path / "x"))[0] == "Down" and cli.health_status(str(tmp_path))[0] == "Degraded"
    cli.initialise(str(tmp_path))
    assert cli.health_status(str(tmp_path)) == ("Healthy", "")
    from palimpsest.operators import health

    body = "# M\n" + "\n".join(["## Long", *[f"line number {i} of the section" for i in range(40)], "## Empty", "", "## Twice", *["the very same line here, twice"] * 2, "on 2023-01-02 it was", *["x"] * 140])
    memory = spark.createDataFrame([("m", body), ("small", "# S"), ("none", None)], "file string, text string")
    got = [x.suggestion for x in health.suggestions(memory, "file", "text", "2024-06").orderBy("rule", "nth").collect()]
    assert any(x.startswith('Section "Long" is 41 lines') for x in got) and any("1 potential duplicate" in x for x in got) and 'Section "Empty" appears empty — remove it' in got
    assert any(x.startswith("1 entries reference dates") for x in got) and got[-1].startswith("Over 170 lines")
    stored = spark.createDataFrame([("a", "x" * 2048, "2024-05-31 22:00:00")], "file string, text string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    board = {x.label: x.value for x in health.dashboard(memory, "file", "text", stored, "text", "at", spark.range(2), AS_OF).collect()}
    assert board["archive"] == "1 conversations (2.0 KB)" and board["freshness"] == "2h ago" and board["sessions"] == "2/5 entries" and board["health"] == "alert"
    assert board["memory"].endswith("full") and board["largest"].startswith("Twice (")
    empty = {x.label: x.value for x in health.dashboard(memory.limit(0), "file", "text", stored.limit(0), "text", "at", spark.range(0), AS_OF).collect()}
    assert empty["freshness"] == "never" and empty["health"] == "watch"


def test_shell(spark, tmp_path, capsys):
    root = str(tmp_path / "r")
    assert cli.main([root, "init"]) == 0 and cli.main([root, "init"]) == 0 and "nothing to do" in capsys.readouterr().out
    (tmp_path / "r/EPHEMERAL.md").write_text("  hi \n")
    cli.main([root, "consume"])
    assert capsys.readouterr().out == "hi\n"
    cli.main([root, "config", "ephemeral.max_entries", "7"])
    assert "max_entries = 7" in capsys.readouterr().out
    for n in ("alpha tool", "beta tool"):
        cli.main([root, "add-entity", "--name", n, "--type", "tool", "--abstract", f"about {n}"])
    cli.main([root, "relate", "alpha tool", "USES", "beta tool", "--confidence", "0.5"])
    with pytest.raises(SystemExit):
        cli.main([root, "relate", "alpha tool", "USES", "nobody"])
    capsys.readouterr()
    cli.main([root, "query", "about alpha tool"])
    cli.main([root, "traverse", "alpha tool"])
    cli.main([root, "stats"])
    cli.main([root, "gc"])
    out = capsys.readouterr().out
    assert "alpha tool" in out and "-> USES [50%] beta tool" in out
