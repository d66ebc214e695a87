import heapq
import json
import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import conversations, encodings, near_duplicates, neighbours, packing, private_details, splitting, tokens

ENTRY = "entry_id long, entry_uuid string, parent_uuid string, session_id string, entry_type string, entry_timestamp string, role string, content string, key string, text string"


def entry(i, s, kind, at, content, role=None, parent=None, uid=None):
    return (i, uid or f"u{i}", parent, s, kind, at, role, content, "clash", "clash")


def test_times(spark):
    good = {"2020-01-06T00:27:11.747Z": 1578270431747000, "2020-01-06 00:27:11": 1578270431000000, "2020-01-06T06:22:21.831+05:30": 1578271941831000,
            "1578271872102": 1578271872102000, "2020-01-05T19:35:39.869-08:00": 1578281739869000}
    bad = ["", "n/a", "0000-00-00T00:00:00Z", "2020-13-01T00:00:00Z", "2020-01-06", None, "Invalid Date", "2020-01-06T25:00:00Z"]
    rows = [(t,) for t in [*good, *bad]]
    got = [x[0] for x in spark.createDataFrame(rows, "t string").select(conversations.instant_micros(F.col("t"))).collect()]
    assert got == [*good.values(), *[None] * len(bad)]


def test_broken_sessions(spark):
    b = lambda *x: json.dumps(x)
    t = lambda n: f"2020-01-01T00:00:{n:02d}Z"
    rows = [
        entry(1, "ok", " User", t(1), "hi"), entry(2, "ok", "assistant", t(2), b({"type": "text", "text": "yo"}), "model", "u1"), entry(3, "ok", "assistant", t(2), b({"type": "text", "text": "yo"}), "model", "u1", "u2"),
        entry(4, "unanswered", "user", t(1), "a"), entry(5, "unanswered", "user", t(2), "b"), entry(6, "unanswered", "assistant", t(3), "c"),
        entry(7, "last", "user", t(1), "a"), entry(8, "last", "assistant", t(2), "b"), entry(9, "last", "user", t(3), "c"),
        entry(10, "noreply", "user", t(1), "a"), entry(11, "noreply", "assistant", t(2), b({"type": "tool_use", "name": "x"})),
        entry(12, "time", "user", "n/a", "a"), entry(13, "time", "assistant", t(2), "b"),
        entry(14, "role", "user", t(1), "a", "assistant"), entry(15, "role", "assistant", t(2), "b"),
        entry(16, "parent", "user", t(1), "a", None, "nobody"), entry(17, "parent", "assistant", t(2), "b"),
        entry(18, "damaged", "user", t(1), "a"), entry(19, "damaged", "assistant", t(2), "b"), entry(20, "damaged", "assistant", t(3), '[{"type": "te'),
        entry(21, "late", "assistant", t(5), "b"), entry(22, "late", "user", t(4), "a"), entry(23, "late", "system", None, "x", None, "gone"),
        entry(24, "blank", "user", t(1), "  \n"), entry(25, "blank", "assistant", t(2), "b"), entry(26, "none", "system", None, None), entry(27, None, "user", t(1), "x"),
    ]
    df = spark.createDataFrame(rows, ENTRY).repartition(4)
    assert {x[0] for x in conversations.broken_sessions(df).collect()} == {"unanswered", "last", "noreply", "time", "role", "parent", "damaged", "blank", "none"}
    got = [tuple(x)[:3] + (x.content,) for x in conversations.rebuild(df).orderBy("session_id", "turn_no").collect()]
    assert got == [("late", 1, "user", "a"), ("late", 2, "assistant", "b"), ("ok", 1, "user", "hi"), ("ok", 2, "assistant", "yo")]
    assert conversations.broken_sessions(df.limit(0)).count() == 0 and conversations.rebuild(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.integers(0, 12))
def test_the_automaton_and_its_composition(symbols, cut):
    spoken = [s for s in symbols if s in (conversations.USER, conversations.ASSISTANT)]
    answered = all(b == conversations.ASSISTANT for a, b in zip(spoken, [*spoken[1:], None]) if a == conversations.USER)
    good = conversations.FAULT not in symbols and set(spoken) == {conversations.USER, conversations.ASSISTANT} and answered
    assert (conversations.run_automaton(symbols) in conversations.ACCEPTING) == good
    assert conversations.run_automaton(symbols[cut:], conversations.run_automaton(symbols[:cut])) == conversations.run_automaton(symbols)


def test_a_hot_session_runs_over_many_partitions(spark):
    rows = [entry(i, "hot", "user" if i % 2 == 0 else "assistant", str(1578271872000 + i * 1000), "x") for i in range(2000)]
    df = spark.createDataFrame(rows, ENTRY).repartition(7)
    assert conversations.broken_sessions(df).count() == 0
    got = [x.turn_no for x in conversations.rebuild(df).orderBy("entry_id").collect()]
    assert got == list(range(1, 2001))
    one_less = df.where("entry_id != 1001")
    assert [x[0] for x in conversations.broken_sessions(one_less).collect()] == ["hot"]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab .,\n\r#-é漢🙂`"), max_size=600), st.sampled_from([(60, 10), (40, 4), (100, 0)]))
def test_split_round_trip(s, limits):
    limit, overlap = limits
    raw = s.encode()
    pieces = splitting.split_text(s, limit, overlap)
    assert b"".join(raw[b:e] for _, b, e in pieces) == raw
    for n, (a, b, e) in enumerate(pieces):
        assert e - a <= limit and e > b
        raw[a:e].decode()
        if n:
            assert b - a <= overlap and (b - a > overlap - 4 or a == pieces[n - 1][0])
        else:
            assert a == b == 0
    assert (len(pieces) > 1) == (len(raw) > limit)


def test_split_prefers_strong_boundaries(spark):
    s = "\n\n".join(f"Paragraph {i}. " + "word " * 30 for i in range(20))
    pieces = splitting.split_text(s, 1000, 50)
    assert all(s.encode()[b:].startswith(b"Paragraph") for _, b, _ in pieces)
    df = spark.createDataFrame([(1, s), (2, None), (3, ""), (1, "short"), (4, "x" * 9001)], "key int, text string")
    got = splitting.split_table(df, "key", "text").collect()
    assert {x.key for x in got} == {1, 4} and all(len(x.piece.encode()) <= 4000 for x in got)
    assert splitting.split_table(df.limit(0), "key", "text").count() == 0


GIVEN, FAMILY = ["Briena", "Calena", "Dovena", "Fenena", "Bririn", "Calrin", "Dovrin", "Briaxa", "Fenaxa", "Calaxa"], ["Orberby", "Kellerby", "Vanderby", "Orbström", "Kellström", "Vandström"]
FINDER = private_details.Finder(GIVEN, FAMILY)


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail a.b+c@example.org.", "mail [EMAIL]."), ("x_1 [at] post [dot] example [dot] org ok", "[EMAIL] ok"), ("a(at)b.test", "[EMAIL]"), ("HEAD@{3} @own/pkg@1.2.3 git@box-1:repo.git", None),
        ("call +44 7700 900123 now", "call [PHONE] now"), ("0044 20 7946 0270 18:52:33 INFO", "[PHONE] 18:52:33 INFO"), ("(921) 555-0115 or 572.555.0194", "[PHONE] or [PHONE]"),
        ("030/23125-669, 01 99 00 38 79", "[PHONE], [PHONE]"), ("job 20201113-5638 on 192.0.2.172 port 8127 at 48.6053,11.3522", None),
        ("id 951-10-5228 and QQ 34 03 37 D, XW6459695; 97003217800", "id [ID_NUMBER] and [ID_NUMBER], [ID_NUMBER]; [ID_NUMBER]"), ("141332-3390.", "[ID_NUMBER]."), ("REC-12345 toolu_666490082498 1578271872102", None),
        ("to 593 Orberby St.\nBrindleford, ZZ 87313.", "to [ADDRESS]."), ("Flat 24, 231 Thornhill Road, Ravelstow QX1 7ZZ, please", "[ADDRESS], please"),
        ("78 rue des Thornhills, 62687 Brindleford, x", "[ADDRESS], x"), ("Calle Pelkéry 68, 87130 Astermouth.", "[ADDRESS]."), ("Larkspurweg 104, 69310 Fennwick", "[ADDRESS]"), ("P.O. Box 1439, Astermouth 52801.", "[ADDRESS]."),
        ("Signed: Briena K. Orberby-Vanderby", "Signed: [NAME]"), ("cc Kellström, Fenrin.", "cc [NAME]."), ("thanks, calrin", "thanks, [NAME]"), ("src/Briena.rs Briena_run Briena::go `Briena`", None), ("", ""),
        ("we talked to briena yesterday", "we talked to [NAME] yesterday"), ("use briena CLI, the briena: tool, briena/x, bririn said", None),
        ("GB29 NWBK 6016 1331 9268 19, NL91ABNA0417164300", "[ID_NUMBER], [ID_NUMBER]"), ("IE29AIBK93115212345678", "[ID_NUMBER]"), ("GB29 NWBK 6016 1331 9268 18", None),
        ("4111 1111 1111 1111 or visa 4111111111111111", "[ID_NUMBER] or visa [ID_NUMBER]"), ("4111111111111111 bytes, 4111 1111 1111 1112", None), ("SSN: 951105228", "SSN: [ID_NUMBER]"),
        ("build 12345678901 at 000-12-3456", None), ("(0)20 7946 0958", "[PHONE]"), ("tel:+442079460958 phone: 5125550199", "tel:[PHONE] phone: [PHONE]"), ("mailto:a.b@example.org?subject=x", "mailto:[EMAIL]?subject=x"),
        ("Signed: Alice Johnson", "Signed: [NAME]"), ("My name is Maria Garcia and I", "My name is [NAME] and I"), ("Dear Alice,", "Dear [NAME],"), ("Mr. O'Brien called", "Mr. [NAME] called"),
        ("Dear Team, Hello World; signed: Release Team; Mr FooBar, see Dr Config.toml, my name is foo", None),
    ],
)
def test_redaction(text, want):
    assert private_details.redact(text, FINDER)[0] == (text if want is None else want)


def test_redaction_in_json_and_tables(spark):
    raw = '[{"type": "text", "text": "I am Briena Kellstr\\u00f6m\\nmail a@b.test"}]'
    assert private_details.redact(raw, FINDER) == ('[{"type": "text", "text": "I am [NAME]\\nmail [EMAIL]"}]', ["name", "email"])
    assert json.loads(private_details.redact(raw, FINDER)[0])
    lexicon = spark.createDataFrame([(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY] + [(None, None)], "name_part string, part_kind string")
    df = spark.createDataFrame([(1, raw, "k"), (1, raw, "k"), (2, None, "k"), (3, "", "k"), (4, "x" * 100_000 + " a@b.test", "k")], "id long, content string, kinds string")
    got = sorted(tuple(x) for x in private_details.found_kinds(df, lexicon, "id", "content", "t").collect())
    assert got == sorted([("t", "1", "name"), ("t", "1", "email")] * 2 + [("t", "4", "email")])
    assert private_details.redact_table(df, lexicon, "id", "content", "t").count() == 5
    assert private_details.found_kinds(df.limit(0), lexicon.limit(0), "id", "content", "t").count() == 0


def test_name_blocks_recombine():
    assert {"bririn", "fenrin", "dovaxa"} <= private_details.name_model(GIVEN) and "runner" not in private_details.name_model(GIVEN)


def jaccard_pairs(sets, t):
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9 and sets[a] and sets[b]}


@pytest.mark.parametrize("t, words", [(0.6, 40), (0.8, 300), (0.5, 25)])
def test_similar_pairs_against_brute_force(spark, t, words):
    r = random.Random(words)
    vocabulary = [f"w{i}" for i in range(words)]
    sets = {}
    for i in range(220):
        if sets and r.random() < 0.6:
            s = set(sets[r.choice(list(sets))])
            for _ in range(r.randrange(4)):
                s.symmetric_difference_update({r.choice(vocabulary)})
        else:
            s = set(r.sample(vocabulary, r.randrange(1, 20)))
        sets[f"k{i:03d}"] = s
    rows = [(k, " ".join(s), "x", "y") for k, s in sets.items()] + [("none", None, "x", "y"), ("blank", " - ", "x", "y"), (None, "w1", "x", "y"), ("k001", " ".join(sets["k001"]), "x", "y")]
    df = spark.createDataFrame(rows, "id string, txt string, rep string, words string").repartition(5)
    got = [tuple(x) for x in near_duplicates.similar_pairs(df, "id", F.col("txt"), t).collect()]
    want = jaccard_pairs(sets, t)
    assert len(got) == len(set(got)) and set(got) == want
    groups = {x.key: x for x in near_duplicates.similar_groups(df, "id", F.col("txt"), t).collect()}
    assert {k: g.links for k, g in groups.items()} == {k: sum(k in p for p in want) for k in sets if sets[k]}
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in want:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {k: g.group_id for k, g in groups.items()} == {k: find(k) for k in sets if sets[k]}


@pytest.mark.parametrize("hot, list_block", [(3, 7), (10**9, 7), (3, 10**9)])
def test_long_lists_are_spread(spark, monkeypatch, hot, list_block):
    monkeypatch.setattr(near_duplicates, "CLUSTER_PART", 2)
    r = random.Random(3)
    sets = {f"k{i:02d}": set(r.sample([f"w{j}" for j in range(12)], r.choice([1, 2, 3, 6, 7]))) for i in range(50)}
    for i in range(50, 70):
        sets[f"k{i}"] = {f"v{j}" for j in range(30)} - {f"v{i % 7}"} | ({f"x{i}"} if i % 2 else set())
    df = spark.createDataFrame([(k, " ".join(s)) for k, s in sets.items()], "id string, txt string")
    got = [tuple(x) for x in near_duplicates.similar_pairs(df, "id", F.col("txt"), 0.6, hot=hot, list_block=list_block).collect()]
    assert len(got) == len(set(got)) and set(got) == jaccard_pairs(sets, 0.6)
    assert near_duplicates.similar_pairs(df.limit(0), "id", F.col("txt"), 0.6).count() == 0


def test_pairs_of_small_sets_whose_leaders_share_nothing(spark):
    words = spark.createDataFrame([(f"w{i}",) for i in range(14)], "w string").withColumn("tok", F.xxhash64("w"))
    hashes = {r[0]: tuple(r[1:]) for r in words.select("w", *(F.xxhash64(F.lit(i), F.col("tok")) for i in (1, 2, 3))).collect()}
    below = lambda v, w: all(p < q for p, q in zip(hashes[v], hashes[w]))
    # {a} leads {a, b} and {b, x} leads {a, b, x}, as their three minimum hashes are equal.
    x, a, b = next((x, a, b) for x in hashes for a in hashes for b in hashes if below(x, a) and below(a, b))
    sets = {1: {a}, 2: {a, b}, 3: {b, x}, 4: {a, b, x}}
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in sets.items()], "id long, txt string")
    assert {tuple(r) for r in near_duplicates.similar_pairs(df, "id", F.col("txt"), 0.6).collect()} == jaccard_pairs(sets, 0.6)


@pytest.mark.parametrize("sizes", [{}, {"leaf_size": 16, "upper_leaves": 3, "refine": 40, "shelf": 30}])
def test_neighbours_against_brute_force(spark, sizes):
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 384))
    x = np.concatenate([b + 0.3 * r.normal(size=(12, 384)) for b in base]).astype(np.float32)
    x[5] = x[6] = x[7]
    rows = [(f"e{i:04d}", [float(v) for v in row], "x") for i, row in enumerate(x)]
    bad = [("null", None, "x"), ("short", [1.0], "x"), ("zero", [0.0] * 384, "x"), ("nan", [float("nan")] + [1.0] * 383, "x"), ("inf", [float("inf")] + [1.0] * 383, "x"), ("hole", [None] + [1.0] * 383, "x")]
    df = spark.createDataFrame(rows + bad, "id string, v array<float>, rep string").repartition(3)
    found, recall = neighbours.nearest(df, "id", "v", **sizes)
    got = {}
    for q in found.orderBy("key", "rank").collect():
        got.setdefault(q.key, []).append(q.other)
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 10)
    np.fill_diagonal(s, -2)
    hits = total = 0
    for i in range(len(x)):
        want = [f"e{j:04d}" for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.7]
        mine = got.get(f"e{i:04d}", [])
        assert len(mine) <= 5 and f"e{i:04d}" not in mine
        hits += len(set(want) & set(mine))
        total += len(want)
    assert recall >= 0.9 and hits / total >= 0.95
    assert neighbours.nearest(df.limit(0), "id", "v", **sizes)[0].count() == 0
    assert got["e0005"][:2] == ["e0006", "e0007"]


def test_a_class_of_a_third_of_all_vectors_is_searched_once(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(120, 384)).astype(np.float32)
    x[:40] = x[0]
    x[50] = x[0] + 0.05 * r.normal(size=384)
    x[60] = -0.0 * x[60] + np.eye(384)[0]
    rows = [(f"e{i:03d}", [float(v) for v in row]) for i, row in enumerate(x)] + [("e005", [float(v) for v in x[0]])]
    df = spark.createDataFrame(rows, "key string, vec array<float>").repartition(5)
    found, _ = neighbours.nearest(df, "key", "vec", leaf_size=8, shelf=16)
    got = {}
    for q in found.orderBy("key", "rank").collect():
        got.setdefault(q.key, []).append(q.other)
    for i in range(40):
        assert got[f"e{i:03d}"] == [f"e{j:03d}" for j in range(6) if j != i][:5]
    assert got["e050"] == [f"e{j:03d}" for j in range(5)] and set(got) == {f"e{i:03d}" for i in range(40)} | {"e050"}


def test_vectors_are_stored_once_and_sent_in_passes(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = np.concatenate([b + 0.4 * r.normal(size=(12, 384)) for b in r.normal(size=(30, 384))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<float>").repartition(3)
    stored, planned = [], []
    write, plan = neighbours.materialize, neighbours._passes

    def write_and_count(table, name, **how):
        out = write(table, name, **how)
        if "vec" in out.columns and name != "truth":
            stored.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "materialize", write_and_count)
    monkeypatch.setattr(neighbours, "_passes", lambda *a: planned.extend(plan(*a)) or planned)
    monkeypatch.setattr(neighbours, "_calibrated", lambda *a: (64, 1.0))  # all bins, so all shelves
    found, _ = neighbours.nearest(df, "id", "v", leaf_size=16, upper_leaves=3, refine=40, shelf=60, most_sent=400)
    got = {}
    for q in found.orderBy("key", "rank").collect():
        got.setdefault(q.key, []).append(q.other)
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 10)
    np.fill_diagonal(sims, -2)
    want = {i: [int(j) for j in np.argsort(-s, kind="stable")[:5] if s[j] >= 0.7] for i, s in enumerate(sims)}
    assert got == {i: w for i, w in want.items() if w}
    assert max(stored) <= len(x) and len(planned) > 3


def test_passes_take_every_cell_once_and_keep_to_their_rows():
    units = [(1000, [20.0, 5.0], 0), (0, [3.0], 0), (700, [500.0], neighbours.TREE_BYTES), (40, [1.0, 30.0], 9)]
    passes = list(neighbours._passes(units, 10, 200, 2))
    cells = [(unit, s, cell) for p in passes for unit, s, _, _, first, last in p for cell in range(first, last)]
    made = {(unit, s): parts * slices for p in passes for unit, s, parts, slices, _, _ in p}
    assert len(cells) == len(set(cells)) == sum(made.values()) and len(made) == 6
    for p in passes:
        rows = [(last - first) * (units[u][0] / slices + units[u][1][s] / parts) for u, s, parts, slices, first, last in p]
        assert sum(rows) <= 200 and sum(units[u][2] for u in {c[0] for c in p}) <= neighbours.TREE_BYTES


def test_tree_walk_reaches_all_leaves():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = neighbours.Tree(x, 20)
    leaves = {i for i, k in enumerate(tree.kids) if not k}
    assert set(tree.leaf_of(x)) <= leaves and all(set(o) == leaves for o in tree.best_bins(x[:5], 99))
    near = x[:50] @ tree.centroids.T
    for i, o in enumerate(tree.best_bins(x[:50], 7)):
        queue, want = [(0.0, 0)], []
        while len(want) < 7:
            _, node = heapq.heappop(queue)
            if tree.kids[node]:
                for kid in tree.kids[node]:
                    heapq.heappush(queue, (-float(near[i, kid]), kid))
            else:
                want.append(node)
        assert list(o) == want


TEXTS = st.text(st.sampled_from("ab  \n\t'sdé漢字。🙂1- 　"), max_size=400)


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXTS, max_size=4), st.sampled_from([9, 33, 1 << 14]))
def test_tokens_equal_plain_encoding(texts, longest):
    plain = tokens.encoding()
    own = tokens.Encoder(longest=longest)
    for _ in range(2):
        assert own.encode_many(texts) == [plain.encode_ordinary(t) if t else [] for t in texts]


def test_token_tables(spark):
    r = random.Random(0)
    long = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(2000)) * 9
    df = spark.createDataFrame([(1, "hello"), (2, None), (3, ""), (4, long), (4, long)], "key long, text string")
    got = [(x.key, x.ids) for x in tokens.encode_table(df, "key", "text").collect()]
    plain = tokens.encoding()
    assert sorted(got) == sorted([(1, plain.encode_ordinary("hello")), (2, []), (3, []), *[(4, plain.encode_ordinary(long))] * 2])
    assert {x.key: x.n_tokens for x in tokens.count_table(df, "key", "text").collect()}[4] == len(plain.encode_ordinary(long))
    e = tokens.Encoder()
    e.encode(long)
    assert e.reused > e.encoded
    assert tokens.encode_table(df.limit(0), "key", "text").count() == 0


def best_fit_bins(rows):
    left = []
    for n in sorted((x.n_units for x in rows), reverse=True):
        fits = [r for r in left if r >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left.append(2048 - n)
    return len(left)


def test_packing(spark):
    r = random.Random(1)
    sizes = [(i, r.choice([0, 1, 5, 700, 1023, 1024, 1025, 2048, 2049, 5000, r.randrange(1, 3000)])) for i in range(3000)] + [(9000, None), (9001, -4), (1, 7)]
    df = spark.createDataFrame(sizes, "key long, size long").repartition(3)
    rows = packing.pack_table(df, "key", "size", items_per_task=700).collect()
    room, pieces = {}, {}
    for x in rows:
        room[x.container] = room.get(x.container, 0) + x.n_units
        pieces.setdefault(x.key, []).append((x.piece_no, x.first_unit, x.n_units))
    total = sum(s for _, s in sizes if s and s > 0)
    assert max(room.values()) <= 2048 and sum(room.values()) == total and len(room) <= 1.05 * best_fit_bins(rows) + 6
    for k, s in sizes:
        if k != 1 and s and s > 0:
            assert [p for p, _, _ in sorted(pieces[k])] == list(range(1, -(-s // 2048) + 1)) and sum(n for _, _, n in pieces[k]) == s
    assert packing.pack_table(df.limit(0), "key", "size").count() == 0


def test_harmonic_containers_have_their_fixed_count():
    r = np.random.default_rng(2)
    sizes = r.integers(1, 2049, 4000)
    kind = packing.classes_of(sizes, 2048, 16)
    bins = packing.pack(sizes, 2048, 16, fill=False)
    for i in range(1, 16):
        counts = np.unique(bins[kind == i], return_counts=True)[1]
        assert (counts == i).sum() >= len(counts) - 1 and set(bins[kind == i]).isdisjoint(bins[kind != i])
    assert np.bincount(bins, weights=sizes).max() <= 2048


@pytest.mark.parametrize("seed", range(6))
def test_classes_and_filling_change_the_containers(seed):
    r = np.random.default_rng(seed)
    sizes = np.minimum(2048, np.exp(r.normal(5.5, 1.2, 3000)).astype(int) + 1)
    n = {}
    for classes, fill in ((1, True), (4, False), (4, True), (64, False), (64, True)):
        bins = packing.pack(sizes, 2048, classes, fill)
        load = np.bincount(bins, weights=sizes)
        assert load.max() <= 2048 and load.min() > 0
        n[classes, fill] = len(load)
    assert n[64, True] < n[64, False] and n[64, True] < n[1, True] and n[64, True] <= 1.02 * sizes.sum() / 2048 + 1
    assert (packing.pack(sizes, 2048, 4) != packing.pack(sizes, 2048, 64)).any()
    assert len(packing.pack(sizes[:0], 2048)) == 0 and set(packing.pack(np.full(7, 2048))) == set(range(7))


CLEAN = {
    "fr": ["La règle est très détaillée depuis que le fichier a été déplacé.", "Où se trouve la requête créée par l’équipe ?", "Nous avons décidé de garder la boîte, même périmée."],
    "de": ["Die Größe ist mühsam, weil der Schlüssel geändert wurde.", "Könntest du die Warteschlange bitte prüfen und löschen?", "Früher hieß der Einträge Überblick größer."],
    "ru": ["Вчера таблица была лишняя, сегодня уже нет.", "Проверь, пожалуйста, где лежит копия и сколько там строк.", "Наша граница снова полная, потому что файл изменился."],
    "en": ["The letter Ã sorts after A in the table, Â before it, which the chunk ignores.", "A naïve lock costs about 815 µs per key.", "That’s the path of every stream, and it isn’t partial."],
}
MODEL = encodings.Model([(" ".join(CLEAN[tag][i % 3 :] + CLEAN[tag][: i % 3]) + f" {i}", tag) for i in range(60) for tag in CLEAN])


@pytest.mark.parametrize("tag", ["fr", "de", "ru"])
@pytest.mark.parametrize("read, written", [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8"), ("cp1251", "utf-8"), ("koi8-r", "utf-8"), ("cp850", "utf-8")])
def test_garbled_sentences_come_back(tag, read, written):
    for s in CLEAN[tag]:
        raw = s.encode(written)
        bad = encodings._text_of(raw, read)
        assert MODEL.restore(bad)[0] == s and MODEL.suspicious(bad)


def test_parts_beside_correct_signs_come_back():
    fr, ru = CLEAN["fr"][0], CLEAN["ru"][0]
    quoted = encodings._text_of(fr[:-1].encode(), "cp1252")
    for bad, good in ((f"« {quoted}” — 🙂", f"« {fr[:-1]}” — 🙂"), (quoted.replace("Ã©e ", "Ã©e” ", 1), fr[:-1].replace("ée ", "ée” ", 1))):
        assert MODEL.restore(bad)[0] == good
    assert MODEL.restore(encodings._text_of(ru.encode("cp1251"), "cp1252") + " 🙂")[0] == ru + " 🙂"
    for s in (*CLEAN["fr"], *CLEAN["ru"], *CLEAN["de"]):
        assert MODEL.restore(s + " 🙂 — “x”")[1] == ()


def test_double_and_single_byte_chains():
    s = CLEAN["fr"][0]
    twice = encodings._text_of(encodings._text_of(s.encode(), "cp1252").encode(), "cp1252")
    assert MODEL.restore(twice)[0] == s
    ru = CLEAN["ru"][0]
    assert MODEL.restore(encodings._text_of(ru.encode("cp1251"), "cp1252"))[0] == ru
    assert MODEL.restore(encodings._text_of(ru.encode("koi8-r"), "cp1251"))[0] == ru


@pytest.mark.parametrize("read", ["cp437", "mac_roman", "cp850", "cp1250", "cp1251", "koi8-r"])
def test_what_is_often_garbled_alike_is_still_found(read):
    texts = [(" ".join(CLEAN[tag][i % 3 :] + CLEAN[tag][: i % 3]) + f" {i}", tag) for i in range(60) for tag in CLEAN]
    often = [(encodings._text_of(t.encode(), read), tag) if n % 5 == 0 and tag == "fr" else (t, tag) for n, (t, tag) in enumerate(texts)]
    model = encodings.Model(often)
    for (t, tag), (bad, _) in zip(texts, often):
        assert model.repair(bad) == (t, t != bad, False)


def test_usual_pairs_are_counted_in_all_of_every_text(spark):
    late = "x" * (encodings.SAMPLE_CHARS + 10) + ". Le garçon déjà là."
    df = spark.createDataFrame([(i, late, " FR-ca") for i in range(50)] + [(50 + i, "Grün", "de") for i in range(3)] + [(60, "ñu", "un"), (61, " ", "fr")], "id long, text string, lang string").repartition(3)
    model = encodings.fit(df, "id", "text", "lang")
    assert encodings.pairs_of("Le garçon déjà là.") | encodings.pairs_of("Grün") == model.usual
    assert encodings.fit(df.limit(0), "id", "text", "lang").usual == set()


def test_dictionaries_are_of_all_texts(spark):
    long = "0123456789 " * 400
    rows = [(i, f"{long}. Le garçon numéro{i % 300} déjà là.", "fr") for i in range(2500)] + [(9000 + i, f"{long}Grün {i % 2}", "de") for i in range(9)]
    df = spark.createDataFrame(rows, "id long, text string, lang string").repartition(5)
    content = encodings.fit(df, "id", "text", "lang").content
    assert all(f"numéro{i} ".encode() in content["fr"] for i in range(300))
    assert content == encodings.Model([(text, lang) for _, text, lang in rows]).content
    assert encodings.fit(df.limit(0), "id", "text", "lang").content == {}


def test_a_garbled_piece_stays_out_of_the_dictionary():
    made = MODEL.dictionary({"déjà vu": 50, "dÈj‡ vu": 30, "plain": 9, "once": 1}, encodings.pairs_of("déjà vu") | encodings.pairs_of("dÈj‡ vu"))
    assert "déjà vu".encode() in made and "dÈj‡ vu".encode() not in made and b"plain" in made and b"once" not in made


def test_clean_texts_stay(spark):
    for texts in CLEAN.values():
        for s in texts:
            assert MODEL.repair(s) == (s, False, False)
    rows = [(i, " ".join(v), k, "x") for k, v in CLEAN.items() for i in range(40)]
    rows += [(100, None, "fr", "x"), (101, "", None, "x"), (102, "plain ascii", "en", "x"), (103, "d�cid�", "fr", "x"), (104, CLEAN["fr"][0].encode().decode("latin-1") + "\nfine", "fr", "x")]
    df = spark.createDataFrame(rows, "id long, text string, lang string, key string").repartition(3)
    got = {x.id: x for x in encodings.repair_table(df.where("id >= 100 or id < 40"), "id", "text", "lang").where("id >= 100").collect()}
    assert {k for k, x in got.items() if x.garbled} == {103, 104} and got[103].lost and got[104].text == CLEAN["fr"][0] + "\nfine" and got[100].text is None
    assert encodings.repair_table(df.limit(0), "id", "text", "lang").count() == 0


def test_entry_adds_these_queries():
    import __spark_entry__ as e

    assert {f"p{n}_found" for n in (1, 3, 4, 5, 6, 9)} | {"p7_ids", "p8_containers"} <= set(e.queries())
