import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import feedback, gc, graph, ordering, search, state
from palimpsest.schema import ENTITY, RELATES_TO

NOW = datetime(2024, 6, 1)
AS_OF = "2024-06-01 00:00:00"


def entities(spark, rows):
    base = dict(name=None, entity_type="tool", abstract_text="", overview=None, content=None, attributes=None, mutable=True, access_count=0,
                utility_score=0.5, utility_updates=0, created_at=NOW, updated_at=NOW, source=None, embedding=None)
    full = [{**base, "name": r["entity_id"], **r} for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in ENTITY.fields) for r in full], ENTITY)


def edges(spark, rows):
    base = dict(rel_type="R", description=None, valid_from=NOW, valid_until=None, confidence=1.0, last_reinforced=None, source=None)
    full = [{**base, **r} for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in RELATES_TO.fields) for r in full], RELATES_TO)


def edge(i, a, b, **more):
    return dict(rel_id=f"r{i}", src_id=a, dst_id=b, **more)


@pytest.mark.parametrize(
    "age, reinforced, until, confidence, kind",
    [(45, None, None, 0.3, "stale"), (45, None, None, 0.8, None), (5, None, None, 0.3, None), (45, None, 45, 0.3, None), (20, None, None, 0.1, "dead"),
     (180, None, None, 0.6, "stale"), (180, 5, None, 0.6, None), (300, None, 10, 0.6, "dead")],
)
def test_gc_labels(spark, age, reinforced, until, confidence, kind):
    ago = lambda d: None if d is None else NOW - timedelta(days=d)
    df = edges(spark, [edge(1, "a", "b", valid_from=ago(age), last_reinforced=ago(reinforced), valid_until=ago(until), confidence=confidence)])
    assert gc.label_edges(df, AS_OF).first().kind == kind


def test_gc_orphans_and_protection(spark):
    e = entities(spark, [dict(entity_id="a"), dict(entity_id="b"), dict(entity_id="c", source="pipeline:x"), dict(entity_id="d", access_count=3),
                         dict(entity_id="e", attributes='{"pipeline_stage": null}'), dict(entity_id="f", attributes="broken")])
    r = edges(spark, [edge(1, "a", "a")])
    got = {x.id for x in gc.candidates(e, r, AS_OF).where("kind = 'orphan'").collect()}
    assert got == {"b", "f"}
    kept, left = gc.collect(e, r, AS_OF)
    assert kept.count() == 4 and left.count() == 1
    h = gc.health(e, r, AS_OF).first()
    assert (h.total_entities, h.pipeline_entities, h.zero_access_entities, h.total_relationships) == (6, 2, 5, 1)


def test_hops_and_tree(spark):
    e = entities(spark, [dict(entity_id=x, entity_type=t) for x, t in zip("abcde", ["tool", "tool", "person", "tool", "tool"])])
    r = edges(spark, [edge(1, "a", "b", confidence=0.5), edge(2, "a", "c"), edge(3, "b", "d"), edge(4, "c", "d", confidence=0.5), edge(5, "d", "e"),
                      edge(6, "e", "a", valid_until=NOW), edge(7, "a", "a")])
    seeds = e.where("entity_id = 'a'").select("entity_id")
    got = {x.entity_id: (x.hops, x.confidence) for x in graph.k_hop(r, seeds, 2, AS_OF).collect()}
    assert got == {"a": (0, 1.0), "b": (1, 0.5), "c": (1, 1.0), "d": (2, 0.5)}
    tree = graph.traverse_tree(e, r, "a", 2, AS_OF)
    assert [x["entity_id"] for x in tree["edges"]] == ["b", "c"] and [x["entity_id"] for x in tree["edges"][0]["edges"]] == ["d"]
    assert "[50%]" in graph.render_tree(tree)
    assert [x["entity_id"] for x in graph.traverse_tree(e, r, "a", 2, AS_OF, "person")["edges"]] == ["c"]
    with pytest.raises(LookupError):
        graph.traverse_tree(e, r, "nobody", 1, AS_OF)
    assert {x.entity_id: x.degree for x in graph.degrees(r).collect()} == {"a": 4, "b": 2, "c": 2, "d": 3, "e": 2}


def test_search_and_hybrid(spark):
    vec = lambda *x: [float(i) for i in x]
    e = entities(spark, [dict(entity_id="a", embedding=vec(1, 0)), dict(entity_id="b", embedding=vec(1, 0.1)), dict(entity_id="c", embedding=vec(0, 1), entity_type="person"),
                         dict(entity_id="d"), dict(entity_id="e", embedding=vec(float("nan"), 1)), dict(entity_id="f", embedding=vec(1, 0))])
    q = F.array(F.lit(1.0), F.lit(0.0))
    assert [x.entity_id for x in search.search(e, q, AS_OF, 3).collect()] == ["a", "f", "b"]
    assert [x.entity_id for x in search.search(e, q, AS_OF, 5, entity_type="person").collect()] == ["c"]
    assert search.search(e, q, AS_OF, 1, keyword="C").count() == 1
    r = edges(spark, [edge(1, "a", "d", confidence=0.5), edge(2, "c", "a"), edge(3, "f", "d")])
    got = {x.entity_id: x for x in search.hybrid(e, r, q, AS_OF, 2).collect()}
    assert len(got) == 2
    wide = {x.entity_id: x for x in search.hybrid(e.where("entity_id != 'c'"), r, q, AS_OF, 10).collect()}
    assert wide["d"].found_by == "graph" and wide["d"].parent_id == "a"
    assert wide["d"].score == pytest.approx(wide["a"].score * 0.5, abs=1e-6)
    assert search.search(e.limit(0), q, AS_OF, 3).count() == 0 and search.hybrid(e.limit(0), r, q, AS_OF).count() == 0


def test_state(spark):
    e = entities(spark, [dict(entity_id="a", name="A", overview="x", attributes='{"k": 1, "l": 2}'), dict(entity_id="b", name="B")])
    r = edges(spark, [edge(1, "a", "b"), edge(2, "b", "b")])
    up = state.update_entities(e, spark.createDataFrame([("a", None, "new"), ("zz", "q", "q")], "entity_id string, overview string, abstract_text string"), "2025-01-01 00:00:00")
    rows = {x.entity_id: x for x in up.collect()}
    assert len(rows) == 2 and (rows["a"].overview, rows["a"].abstract_text) == ("x", "new") and rows["a"].updated_at.year == 2025 and rows["b"].updated_at == NOW
    ents, left = state.delete_entities(e, r, spark.createDataFrame([("a",)], "entity_id string"))
    assert ents.count() == 1 and [x.rel_id for x in left.collect()] == ["r2"]
    new = spark.createDataFrame([("A", "B", "USES", None, None, None), ("A", "?", "USES", None, 0.9, None)], "from_name string, to_name string, rel_type string, description string, confidence double, source string")
    more, rejected = state.add_relationships(r, e, new, AS_OF)
    assert more.count() == 3 and rejected.first().to_name == "?"
    assert state.add_entities(e, spark.createDataFrame([("N", "event", "t")], "name string, entity_type string, abstract_text string"), AS_OF).where("not mutable").count() == 1
    counted = state.count_access(e, spark.createDataFrame([("a",), ("a",), ("q",)], "entity_id string"))
    assert {x.entity_id: x.access_count for x in counted.collect()} == {"a": 2, "b": 0}
    merged = spark.range(1).select(state.merge_json(F.lit('{"a":1,"b":2}'), F.lit('{"b":3,"c":4}'))).first()[0]
    assert __import__("json").loads(merged) == {"a": 1, "b": 3, "c": 4}
    swap = spark.createDataFrame([("r1", "n1", "a", "b", "R", None, 0.6, None)], "old_id string, rel_id string, src_id string, dst_id string, rel_type string, description string, confidence double, source string")
    after = {x.rel_id: x for x in state.supersede(r, swap, AS_OF).collect()}
    assert after["r1"].valid_until == NOW and after["n1"].valid_until is None and after["r2"].valid_until is None
    assert state.set_confidence(r, spark.createDataFrame([("r1", 0.2)], "rel_id string, confidence double"), AS_OF).where("confidence = 0.2").first().last_reinforced == NOW


def test_edges_alike_are_edges_of_their_own(spark):
    e = entities(spark, [dict(entity_id="a", name="A"), dict(entity_id="b", name="B")])
    row = ("A", "B", "USES", "d", 0.9, "s")
    new = spark.createDataFrame([row, row, (*row[:3], "other", *row[4:]), row], "from_name string, to_name string, rel_type string, description string, confidence double, source string")
    more, _ = state.add_relationships(edges(spark, []), e, new, AS_OF)
    ids = [x.rel_id for x in more.collect()]
    assert len(ids) == len(set(ids)) == 4
    left = state.delete_relationships(more, spark.createDataFrame([(ids[0],)], "rel_id string"))
    assert left.count() == 3
    twice = state.add_entities(e, spark.createDataFrame([("N", "event", "t")] * 3, "name string, entity_type string, abstract_text string"), AS_OF)
    assert twice.select("entity_id").distinct().count() == 5


def test_a_hot_edge_is_folded_in_slices(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SLICE", 7)
    r = random.Random(8)
    told = [("r1" if k % 4 else "r2", k, r.random() < 0.6) for k in range(300)]
    got = {x.rel_id: x.confidence for x in state.reinforce(edges(spark, [edge(1, "a", "b", confidence=0.4), edge(2, "b", "a"), edge(3, "a", "a", confidence=0.3)]),
                                                            spark.createDataFrame(told, "rel_id string, seq long, corroborates boolean").repartition(5), AS_OF).collect()}
    want = {"r1": 0.4, "r2": 1.0, "r3": 0.3}
    for i, _, good in told:
        want[i] = (want[i] * 10 + good) / 11
    assert got == pytest.approx(want)


def test_paths_through_a_hub_are_spread(spark, monkeypatch):
    monkeypatch.setattr(graph, "PATHS_AT_ONCE", 6)
    r = random.Random(4)
    made = [edge(i, f"s{i % 9}", "hub", confidence=r.random()) for i in range(15)] + [edge(20 + i, "hub", f"t{i % 8}", confidence=r.random()) for i in range(12)]
    got = {(x.first_id, x.last_id): x.confidence for x in graph.path_confidences(edges(spark, made), AS_OF).collect()}
    want = {}
    for a in made:
        for b in made:
            if a["dst_id"] == b["src_id"] and min(a["confidence"], b["confidence"]) >= 0.1:
                k = a["src_id"], b["dst_id"]
                want[k] = max(want.get(k, 0), a["confidence"] * b["confidence"])
    assert got == pytest.approx(want)


def test_look_ups(spark):
    e = entities(spark, [dict(entity_id="entity:a", utility_score=0.7), dict(entity_id="entity:b")])
    assert graph.entity_by_id(e, "entity:a").count() == 1 and graph.entity_by_id(e, "entity:z").count() == 0
    eps = spark.createDataFrame([("2", "s", 2, 9), ("1", "s", 1, 9), ("3", "t", 3, None)], "episode_id string, session_id string, timestamp int, log_number long")
    assert [x.episode_id for x in graph.episodes_of_session(eps, "s").collect()] == ["1", "2"] and graph.episode_by_log(eps, 9).first().episode_id == "1"
    assert graph.episode_by_log(eps, 8).count() == 0 and spark.range(1).select(graph.short_id(F.lit("entity:x:abc"))).first()[0] == "abc"
    ids = spark.createDataFrame([("entity:a",), ("entity:z",)], "entity_id string")
    assert {x.entity_id: x.utility for x in feedback.utility_of(e, ids).collect()} == {"entity:a": 0.7, "entity:z": 0.5}


def test_feedback_folds_in_order(spark):
    r = random.Random(2)
    rows = [("hot" if k % 2 else f"e{k % 7}", r.choice(["success", "partial", "failed"]), r.random() < 0.7, r.randrange(10**6), k) for k in range(400)]
    want = {}
    for e, o, used, at, k in sorted(rows, key=lambda x: (x[3], x[4])):
        rate, goal = (0.1, {"success": 1.0, "partial": 0.5, "failed": 0.0}[o]) if used else (0.05, 0.3)
        want[e] = (1 - rate) * want.get(e, 0.5) + rate * goal
    steps = spark.createDataFrame(rows, "entity_id string, outcome string, used boolean, t long, k long").select("entity_id", "outcome", "used", F.struct("t", "k").alias("at"))
    starts = spark.createDataFrame([(e, 0.5) for e in [*want, "none"]], "entity_id string, utility double")
    got = {x.entity_id: x.utility for x in feedback.utilities(starts, steps).collect()}
    assert got.pop("none") == 0.5 and got == pytest.approx(want)


def test_ordering_across_partitions(spark):
    rows = [("h" if k % 3 else "g", (k * 7919) % 1000, chr(97 + k % 26)) for k in range(1000)]
    df = spark.createDataFrame(rows, "g string, o long, v string").repartition(6)
    got = {(x.g, x.o): x for x in ordering.numbered(df, ["g"], ["o"]).collect()}
    prev = {(x.g, x.o): x.p for x in ordering.previous(df, ["g"], ["o"], "v", "p").collect()}
    for g in "gh":
        last = None
        for n, (_, o, v) in enumerate(sorted(x for x in rows if x[0] == g), 1):
            assert got[g, o].n == n and prev[g, o] == last
            last = v
    pos = sorted((x.pos, x.o, x.n) for x in ordering.positions(df, "o").collect())
    assert [p for p, _, _ in pos] == list(range(1000)) and [o for _, o, _ in pos] == list(range(1000)) and pos[0][2] == 1000
    assert ordering.positions(df.limit(0), "o").count() == 0 and ordering.numbered(df.limit(0), ["g"], ["o"]).count() == 0


def test_stale_and_orphans(spark):
    old = NOW - timedelta(days=30)
    at = '{"pipeline_stage": "%s", "pipeline_status": "active"}'
    e = entities(spark, [dict(entity_id="t", attributes=at % "thoughts", updated_at=old), dict(entity_id="u", attributes=at % "thoughts", updated_at=old),
                         dict(entity_id="q", attributes=at % "curiosity", updated_at=old), dict(entity_id="n", updated_at=old)])
    r = edges(spark, [edge(1, "u", "n", valid_from=NOW), edge(2, "t", "n", valid_from=old)])
    assert {(x.entity_id, x.kind) for x in graph.stale(e, r, AS_OF).collect()} == {("t", "thought"), ("q", "question")}
    assert [x.entity_id for x in graph.orphans(e, r).collect()] == ["q"]
