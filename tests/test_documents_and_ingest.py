import json

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import conversation, documents, feedback, health, ingest, search, signals
from test_graph import AS_OF, NOW, edge, edges, entities

THOUGHTS = """# T
## Active
### Metacognitive signal
**Source**: conversation 42
Connected to: Deep work, and Quiet rest
## Graduated
### ~~Old idea~~ → GRADUATED 2026-01-02
**Destination**: the "Deep work" practice
**Graduated**: 2026-01-02
## Dissolved
## Other
### Ignored
"""
PRAXIS = "## Active\n### Deep work\n**Source**: Metacognitive signal notes\ntext\n## Documented Phronesis\n### Quiet rest\n**Added**: 2026-02-03\n## Retired\n"


def parsed(spark):
    df = spark.createDataFrame([(1, "thoughts", THOUGHTS), (2, "praxis", PRAXIS), (3, "learning", None), (4, "learning", "")], "f int, stage string, text string")
    return documents.parse(df, "f", "stage", "text")


def test_parse(spark):
    rows = {x.title: x for x in parsed(spark).collect()}
    assert set(rows) == {"Metacognitive signal", "Old idea", "Deep work", "Quiet rest"}
    assert rows["Old idea"].status == "graduated" and rows["Old idea"].date == "2026-01-02"
    assert rows["Metacognitive signal"].connected == ["Deep work", "Quiet rest"] and rows["Quiet rest"].sub_type == "phronesis" and rows["Quiet rest"].date == "2026-02-03"


def test_relationships_by_three_tiers(spark):
    got = {(x.source, x.rel_type, x.target) for x in documents.infer_relationships(parsed(spark), F.struct("f", "section_no", "entry_no")).collect()}
    assert got == {("Metacognitive signal", "CONNECTED_TO", "Deep work"), ("Metacognitive signal", "CONNECTED_TO", "Quiet rest"),
                   ("Old idea", "GRADUATED_TO", "Deep work"), ("Deep work", "INFORMED_BY", "Metacognitive signal")}


def brute_target(ref, titles):
    low = ref.lower()
    for _, t in titles:
        if t.lower() == low:
            return t
    for _, t in titles:
        if len(t.encode()) >= 5 and (t.lower() in low or low in t.lower()):
            return t
    return None


def test_references_against_brute_force(spark):
    titles = [(i, t) for i, t in enumerate(["ab", "Alpha beta", "beta gamma ray", "gamma", "Alpha", "xyz long title"])]
    refs = ["a", "be", "alpha", "the beta gamma ray", "GAMMA", "xyz", "nothing", "ab", "see gamma and alpha", ""]
    got = {x.ref: x.target for x in documents.resolve_references(spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame(titles, "seq int, title string")).collect()}
    assert got == {r: t for r in refs if r and (t := brute_target(r, titles))}


def test_diff(spark):
    at = '{"pipeline_stage": "thoughts", "pipeline_status": "%s"}'
    e = entities(spark, [dict(entity_id="1", name="metacognitive  Signal!", entity_type="thought", attributes=at % "active", overview="other"),
                         dict(entity_id="2", name="Gone", entity_type="thought", attributes=at % "active"), dict(entity_id="3", name="Long gone", entity_type="thought", attributes=at % "archived")])
    got = {x.action: x.n for x in documents.report(documents.diff(parsed(spark), e)).collect()}
    assert got == {"create": 3, "update": 1, "archive": 1}
    assert documents.diff(parsed(spark).limit(0), e).count() == 0


def test_missing_edges(spark):
    r = edges(spark, [edge(1, "a", "b", rel_type="X"), edge(2, "c", "d", rel_type="X", valid_until=NOW)])
    wanted = spark.createDataFrame([("a", "z", "X"), ("b", "z", "X"), ("c", "d", "X")], "entity_id string, target_id string, rel_type string")
    assert {x.entity_id for x in documents.missing_edges(wanted, r).collect()} == {"c"}
    assert documents.missing_edges(wanted, r, strict=True).count() == 3


def scripted():
    """A provider class that travels to the workers by value."""

    class Scripted:
        def complete(self, system, user, most):
            if "boom" in user:
                raise RuntimeError("429")
            if "bad" in user:
                return "no json"
            found = {"entities": [{"name": "Tool", "type": "tool", "abstract": user[:5]}], "cases": [{"problem": "p" * 70, "solution": "s"}],
                     "patterns": [{"name": "P", "process": "q"}], "preferences": [{"facet": "f", "value": "v"}]}
            return "Sure:\n```json\n" + json.dumps(found) + "\n```"

    return Scripted


def test_extraction(spark):
    chunks = spark.createDataFrame([(1, "hello"), (2, "boom"), (3, "bad")], "k int, content string")
    good, failed = ingest.extract(chunks, scripted(), "sys", ["k"])
    assert {x.k: x.error for x in failed.collect()} == {2: "429", 3: "no object in the answer"}
    flat = ingest.flatten(good, ["k"]).collect()
    assert [x.entity_type for x in flat] == ["tool", "case", "pattern", "preference"] and flat[1].name == "Case: " + "p" * 60 and flat[3].abstract_text == "f: v"


def test_local_merge_and_merge_values(spark):
    rows = [(1, "Tool", "tool", "ab", "o1", None, '{"a": 1}'), (2, "tool", "event", "abcd", "o2", "c", '{"b": 2}'), (3, "X", "tool", "x", None, None, None)]
    df = spark.createDataFrame(rows, "seq int, name string, entity_type string, abstract_text string, overview string, content string, attributes string")
    got = {x.key: x for x in ingest.local_merge(df, ["seq"]).collect()}
    t = got["tool"]
    assert (t.name, t.entity_type, t.abstract_text, t.overview, t.content, json.loads(t.attributes)) == ("Tool", "tool", "abcd", "o1\n\no2", "c", {"a": 1, "b": 2})
    assert got["x"].overview is None
    target = entities(spark, [dict(entity_id="e", abstract_text="longer text", overview="", content="old")])
    cand = spark.createDataFrame([("e", "short", "ov", "new", '{"a":1}')], "id string, abstract_text string, overview string, content string, attributes string")
    m = ingest.merged_values(target, cand, "id").first()
    assert (m.abstract_text, m.overview, m.content, m.attributes) == (None, "ov", "old\n\nnew", '{"a":1}')


def test_resolution(spark):
    e = entities(spark, [dict(entity_id="a", name="A", embedding=[1.0, 0.0], access_count=50), dict(entity_id="b", name="B", embedding=[0.0, 1.0], mutable=False)])
    cand = spark.createDataFrame([("c", "C", "tool", "x", [1.0, 0.0])], "key string, name string, entity_type string, abstract_text string, embedding array<float>")
    similar = ingest.similar_entities(cand, e, AS_OF, "key")
    assert [x.entity_id for x in similar.collect()] == ["a"]
    assert "- A (tool)" in ingest.dedup_prompt(cand, similar, e, "key").first().prompt
    answers = spark.createDataFrame([(1, '{"decision": "merge", "target": "A"}'), (2, '{"decision":"merge","target":"B"}'), (3, 'x {"decision": "skip"} y'), (4, "??")], "key int, answer string")
    assert {x.key: (x.action, x.target_id) for x in ingest.decide(answers, "key", e).collect()} == {1: ("merge", "a"), 2: ("create", None), 3: ("skip", None), 4: ("error", None)}


def test_relationship_matching(spark):
    r = edges(spark, [edge(1, "a", "b", confidence=0.6, valid_until=NOW)])
    wanted = spark.createDataFrame([("a", "b", "R", "explicit"), ("a", "c", "R", "explicit")], "src_id string, dst_id string, rel_type string, certainty string")
    got = {x.dst_id: (x.rel_id, round(x.confidence, 3)) for x in ingest.match_relationships(wanted, r).collect()}
    assert got == {"b": ("r1", 0.636), "c": (None, 0.9)}


def test_embedder_and_objects(spark):
    f = ingest.embedding(lambda: ingest.HashingEmbedder(8))
    assert len(spark.range(1).select(f(F.lit("a b")).alias("v")).first().v) == 8
    assert ingest.balanced_object('x {"a": {"b": 1}} y }') == '{"a": {"b": 1}}' and ingest.balanced_object("none") is None and ingest.balanced_object("{") is None


def test_conversation_entries(spark):
    b = lambda *x: json.dumps(x)
    rows = [
        (1, "u1", "s", "user", "user", "[ch] User message: fix the parser please", "t1"), (2, "u1", "s", "user", "user", "[ch] User message: fix the parser please", "t1"),
        (3, "u2", "s", "assistant", "assistant", b({"type": "thinking", "thinking": "x"}, {"type": "text", "text": "On it."}, {"type": "tool_use", "name": "Read", "input": {"file_path": "src/a.rs"}}), "t2"),
        (4, "u3", "s", "user", "user", b({"type": "tool_result", "content": "body", "is_error": True}, {"type": "text", "text": "typed"}), "t3"),
        (5, "u4", "s", "summary", "user", "skip", "t4"), (6, None, "s", "assistant", "assistant", '[{"type": "te', "t5"), (7, "u7", None, "user", "user", "x", "t"), (8, "u8", "z", "user", "system", None, None),
    ]
    df = spark.createDataFrame(rows, "entry_id long, entry_uuid string, session_id string, entry_type string, role string, content string, entry_timestamp string")
    items = conversation.entries(df)
    got = [(x.entry_id, x.kind, x.text, x.tool, x.is_error) for x in items.orderBy("entry_id", "pos").collect()]
    assert got == [(1, "user", rows[0][5], None, False), (3, "assistant", "On it.", None, False), (3, "tool_use", "`src/a.rs`", "Read", False), (4, "tool_result", "body", None, True)]
    assert conversation.entries(df, user_blocks=True).where("text = 'typed'").count() == 1
    assert conversation.summary(items).first().summary == "fix the parser please"
    top = {x.topic: x.weight for x in conversation.topics(items).collect()}
    assert top["a.rs"] == 2 if "a.rs" in top else top["a"] == 2
    parts = [x.part for x in conversation.markdown_lines(items).orderBy("entry_id", "pos").collect()]
    assert parts[0].startswith("---\n\n### User") and parts[1].startswith("---\n\n### Assistant") and "Error" in parts[3]
    assert conversation.archive_index(items, df).first().line.startswith("| 001 |")
    assert conversation.entries(df.limit(0)).count() == 0


def test_front_matter(spark):
    good = '---\nlog: 7\ndate: "2026-01-01T00:00:00Z"\nsession_id: "x"\ntopics: ["a", "b"]\n---\n\nbody'
    df = spark.createDataFrame([(1, good), (2, "---\nlog: 7\nbroken\n---"), (3, "---\ndate: x\n---"), (4, None), (5, "no header")], "k int, t string")
    rows = conversation.front_matter(df, "k", "t").collect()
    assert [(x.k, x.log, x.date, x.topics, x.message_count) for x in rows] == [(1, 7, "2026-01-01T00:00:00Z", ["a", "b"], 0)]


def test_health_and_lines(spark):
    md = "# Top\n\n## A\nsame line that is long enough\n## Empty\n<!-- c -->\n\n## B\nSame line, that is long enough!\n2026-01-05 old\n"
    df = spark.createDataFrame([(1, md), (2, None), (3, "")], "file int, text string")
    assert [(x.section, x.lines) for x in health.section_sizes(df, "file", "text").collect()] == [("Top", 2), ("A", 2), ("Empty", 3), ("B", 3)]
    assert [x.section for x in health.empty_sections(df, "file", "text").collect()] == ["Empty"]
    assert [(x.first_line, x.line_num) for x in health.repeated_lines(df, "file", "text").collect()] == [(4, 9)]
    assert [(x.file, x.stale) for x in health.stale_lines(df, "file", "text", "2026-03").collect()] == [(1, 1)]
    assert {x.file: x.level for x in health.memory_health(df, "file", "text", 10).collect()} == {1: "alert", 2: "healthy", 3: "healthy"}
    assert search.line_search(df, "LONG enough").count() == 2
    ctx = search.line_search_context(df, "old", 1).collect()
    assert [(x.line_num, x.is_match) for x in ctx] == [(9, False), (10, True)]
    files = spark.createDataFrame([("a", "x quota"), ("b", "### User\n\nquota ledger\nledger")], "file string, text string")
    assert [(x.file, x.match_count, x.score) for x in search.ranked_search(files, "quota ledger").collect()] == [("b", 3, 4.5)]
    assert [x.file for x in search.ranked_search_phrase(files, "quota").collect()] == ["b", "a"]


def test_signals(spark):
    df = spark.createDataFrame([("t1", "x", 0.5, None, None, 0.25), ("t2", "x", None, None, None, None), ("t1", "y", None, 1.0, None, None)],
                               "timestamp string, trigger string, vocabulary_diversity double, question_generation double, thought_lifecycle double, evidence_grounding double")
    known = spark.createDataFrame([("t2",)], "timestamp string")
    assert signals.new_signals(df, known).count() == 2 and signals.new_signals(df, known, dedupe=True).count() == 1
    texts = [x[0] for x in df.select(signals.signal_abstract()).collect()]
    assert texts[0] == "Signal measurement: vocab=0.50, evidence=0.25 (trigger: x)" and texts[1] == "Signal measurement (trigger: x)"
    assert json.loads(signals.signal_entities(df).first().attributes)["timestamp"] == "t1"


@pytest.mark.parametrize("most, want", [(0, 3), (5000, 2), (1, 1)])
def test_token_budget(spark, most, want):
    df = spark.createDataFrame([(3,), (1,), (2,)], "k int")
    assert conversation.token_budget(df, "k", F.lit(2500), most).count() == want


def test_small_parsers(spark):
    entry = "## Session x — 2026-01-02 UTC\n**Duration**: ~5m | **Messages**: 12 | **Archive**: f\n**Summary**: short\n\n---\n\n## Other - today\n- a (3 messages)"
    df = spark.createDataFrame([(1, entry), (2, None)], "k int, t string")
    got = [tuple(x)[1:] for x in conversation.ephemeral_fields(df, "k", "t").orderBy("entry_no").collect()]
    assert got == [(1, "2026-01-02 UTC", "5m", 12, "short"), (2, "today", "—", 3, "")]
    raw = [('{"command": "%s"}' % ("x" * 90),), ('{"url": "u", "pattern": "p"}',), ("{}",)]
    assert [x[0] for x in spark.createDataFrame(raw, "r string").select(conversation.tool_subject(F.col("r"))).collect()] == ["x" * 80, "p", ""]
    times = [("2026-01-01T00:00:00Z",), ("2026-01-01T00:00:00",), ("2026-01-01",), ("x",)]
    read = [x[0] is None for x in spark.createDataFrame(times, "t string").select(text.parse_datetime(F.col("t"))).collect()]
    assert read == [False, False, True, True]


def test_retrying():
    class Flaky:
        def __init__(self, error, fails):
            self.error, self.fails = error, fails

        def complete(self, system, user, most):
            self.fails -= 1
            if self.fails >= 0:
                raise RuntimeError(self.error)
            return "ok"

    assert ingest.Retrying(Flaky("503", 2), wait=0).complete("", "", 1) == "ok"
    with pytest.raises(RuntimeError):
        ingest.Retrying(Flaky("401", 1), wait=0).complete("", "", 1)
    with pytest.raises(RuntimeError):
        ingest.Retrying(Flaky("429", 3), wait=0).complete("", "", 1)


def test_feedback_record(spark):
    e = entities(spark, [dict(entity_id="a"), dict(entity_id="b"), dict(entity_id="c")])
    o = spark.createDataFrame([("s", "success", NOW), ("empty", "failed", NOW)], "session_id string, outcome string, at timestamp_ntz")
    got = spark.createDataFrame([("s", "a"), ("s", "b")], "session_id string, entity_id string")
    after, links = feedback.record(e, o, got, got.where("entity_id = 'a'"), "2025-01-01 00:00:00")
    rows = {x.entity_id: x for x in after.collect()}
    assert len(rows) == 4 and rows["a"].utility_score == pytest.approx(0.55) and rows["b"].utility_score == pytest.approx(0.49) and rows["c"].utility_score == 0.5
    assert rows["a"].updated_at.year == 2025 and rows["c"].updated_at == NOW and rows["entity:outcome-s"].embedding is None
    assert {(x.src_id, x.was_used) for x in links.collect()} == {("a", True), ("b", False)}


def test_distilled(spark):
    md = "# T\n## Long part\n" + "x\n" * 40 + "## Short\ny\n"
    got = {x.target: x.text for x in health.distilled(spark.createDataFrame([("m", md)], "file string, text string"), "file", "text").collect()}
    assert got[None] == "# T\n## Long part\nSee long-part.md\n## Short\ny\n" and got["long-part.md"].startswith("## Long part\nx")
