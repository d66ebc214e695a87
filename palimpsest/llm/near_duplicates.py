"""Records that are nearly the same: an exact set-similarity self-join.

Word sets are joined by prefix filtering over inverted lists, with two ways of not
doing work again:

* lists are sorted by set size; sizes and positions bound how far a set has to look
  along its list, and blocks of a list whose best position cannot reach the required
  overlap are skipped as a whole;
* equal sets are one class from the start, and a set within an edit or so of a
  leader is its follower: only leaders are joined, with a threshold lowered by what
  followers may add, and a follower's overlaps are derived from its leader's by
  counting only the words in which they differ.

Words are ordered by a table of counters of fixed size, rarest first.  The list of a
word that very many sets hold is replaced by the lists of it with each later word, as
any two sets in question share a second one.  A parity bitmap per set bounds the
symmetric difference before any pair leaves its list.  Every pair that reaches the
threshold is found.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread

THRESHOLD = 0.6
INSERTED, DELETED = 1, 2  # how far a follower may be from its leader, in words
COUNTERS = 1 << 20  # of word frequencies, which order the words
HOT = 5_000  # sets that hold a word, from which its list is split by a second word
LIST_BLOCK = 20_000  # members of one list handled at once; longer lists are spread
SKIP_BLOCK = 64
PAIRS_AT_ONCE = 1 << 20
CLUSTER_PART = 1_000  # followers of one leader handled at once
EPS = 1e-9


def word_set(text: Column) -> Column:
    """The distinct runs of letters and digits of a lower-cased text, as 64-bit hashes in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def classes(rows: DataFrame, key: str, text: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(copies (key, rep), reps (rep, toks)): rows with equal word sets are one class,
    named by its smallest key; copies has the classes of several keys only.  Rows with
    a null key or an empty word set are left out."""
    told = spread(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), text.alias("text")))
    sets = told.select("key", word_set(F.col("text")).alias("toks")).where("size(toks) > 0")
    sets = materialize(sets.withColumns({"h1": F.xxhash64("toks"), "h2": F.xxhash64(F.lit("second"), F.col("toks"))}), f"{name}-sets")
    # Most classes have one row, and numbers are counted without their keys.
    several = sets.groupBy("h1", "h2").agg(F.count("*").alias("rows")).where("rows > 1").select("h1", "h2")
    among = sets.select("key", "h1", "h2").join(several, ["h1", "h2"]).distinct()
    copies = materialize(
        among.join(among.groupBy("h1", "h2").agg(F.min("key").alias("rep")), ["h1", "h2"]).select("key", "rep"), f"{name}-copies"
    )
    single = sets.join(copies.select("key"), "key", "left_anti").select(F.col("key").alias("rep"), "toks")
    # A repeated key is among the copies, so its set comes once from here.
    shared = sets.join(copies.where("key = rep").select("key"), "key").dropDuplicates(["key"]).select(F.col("key").alias("rep"), "toks")
    return copies, single.unionByName(shared)


def _flat(batch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each."""
    lists = batch.column(column)
    sizes = np.diff(np.asarray(lists.offsets))
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes)


def word_counts(reps: DataFrame) -> np.ndarray:
    """COUNTERS numbers: how many words fall on each, over all sets.  Summed in the
    tasks first; the table that comes to the driver has this size at most."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            toks, _ = _flat(batch, "toks")
            counts += np.bincount(toks & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    got = reps.select("toks").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return counts


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Well-mixed 64-bit numbers of numbers."""
    z = x.view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _ordered_sets(reps: DataFrame, counts_of) -> DataFrame:
    """(rep, n, toks, b0..b3, k1, k2): words rarest first, parities by hash, and a
    128-bit name of the set's three minimum hashes."""
    kind = dict(reps.dtypes)["rep"]

    def run(batches):
        import pyarrow as pa

        counts = counts_of.value
        for batch in batches:
            if not batch.num_rows:
                continue
            toks, of = _flat(batch, "toks")
            order = np.lexsort((toks, counts[toks & (COUNTERS - 1)], of))
            n = np.bincount(of, minlength=batch.num_rows)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            parity = []
            for w in range(4):
                bits = np.where((toks >> 6) & 3 == w, np.uint64(1) << (toks & 63).astype(np.uint64), np.uint64(0))
                parity.append(pa.array(np.bitwise_xor.reduceat(bits, starts).view(np.int64)))
            least = [np.minimum.reduceat(_mixed(toks, i), starts) for i in (1, 2, 3)]
            names = [
                _mixed(_mixed(_mixed(least[0], s) ^ least[1], s + 1) ^ least[2], s + 2).view(np.int64) for s in (11, 21)
            ]
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(toks)).astype(np.int32)), pa.array(toks[order]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("rep")), pa.array(n.astype(np.int32)), lists, *parity, *map(pa.array, names)],
                names=["rep", "n", "toks", "b0", "b1", "b2", "b3", "k1", "k2"],
            )

    schema = f"rep {kind}, n int, toks array<long>, b0 long, b1 long, b2 long, b3 long, k1 long, k2 long"
    return reps.select("rep", "toks").mapInArrow(run, schema)


def _least_led(t: float) -> int:
    """The smallest size from which a set may lead or follow: the leaders of any two
    sets of that size that reach the threshold have a word in common.

    A set of n words shares t n or more with any that reaches the threshold, and each
    leader lacks at most INSERTED words of its follower."""
    return math.floor((2 * INSERTED + EPS) / max(t, EPS)) + 1


def _follow(sets: DataFrame, t: float) -> DataFrame:
    """(rep, leader, ins, del): a set's leader is the first of those that share
    three minimum hashes with it, if it is near enough, else the set itself.  Small
    sets, whose leaders need not share a word, are their own leaders.

    Where very many sets have one leader, its words are given to several parts."""
    sets = sets.where(F.col("n") >= _least_led(t))
    alike = sets.groupBy("k1", "k2").agg(F.count("*").alias("sets")).where("sets > 1")
    among = sets.select("rep", "k1", "k2").join(alike, ["k1", "k2"])
    leads = among.groupBy("k1", "k2").agg(F.min("rep").alias("leader"), F.first("sets").alias("sets"))
    parts = F.ceil(F.col("sets") / F.lit(CLUSTER_PART)).cast("int")
    leaders = (
        sets.select("rep", "toks").join(leads, F.col("rep") == F.col("leader"))
        .select("k1", "k2", "leader", F.col("toks").alias("lead_toks"), parts.alias("parts"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    led = sets.select("rep", "toks", "k1", "k2").join(alike, ["k1", "k2"]).withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    return (
        led.join(leaders, ["k1", "k2", "part"]).where("rep != leader")
        .select("rep", "leader", F.array_except("toks", "lead_toks").alias("ins"), F.array_except("lead_toks", "toks").alias("del"))
        .where((F.size("ins") <= INSERTED) & (F.size("del") <= DELETED))
    )


def _grown(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths: the run of each element and its place in the run."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _postings(t: float, counts_of, hot: int):
    """The lists each leader stands on: (list, n, low, high, ins, pos, b0..b3, rep)."""

    def run(batches):
        import pyarrow as pa

        counts = counts_of.value
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            n, low, ins = get("n").astype(np.int64), get("low").astype(np.int64), get("ins").astype(np.int64)
            toks, of = _flat(batch, "toks")
            starts = np.cumsum(n) - n
            # Whatever the partner, so many words are shared.
            common = np.maximum(1, np.ceil(low * t - EPS).astype(np.int64) - ins - INSERTED)
            row, pos = _grown(np.minimum(n, n - common + 1))
            tok = toks[starts[row] + pos]
            count = counts[tok & (COUNTERS - 1)]
            shared = count > 1  # a word of one set only has no partner
            row, pos, tok, many = row[shared], pos[shared], tok[shared], (count > hot)[shared]
            alone = ~many | (common[row] < 2)
            at = np.flatnonzero(many)
            second = np.minimum(n, n - common + 2)[row[at]]
            again, step = _grown(np.maximum(0, second - pos[at] - 1))
            at = at[again]
            later = toks[starts[row[at]] + pos[at] + 1 + step]
            lists = np.concatenate([tok[alone], _mixed(tok[at] ^ _mixed(later, 5).view(np.int64), 7).view(np.int64)])
            row, pos = np.concatenate([row[alone], row[at]]), np.concatenate([pos[alone], pos[at]])
            names = ["n", "low", "high", "ins", "b0", "b1", "b2", "b3", "rep"]
            taken = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row)) for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(pos.astype(np.int32)), *taken], names=["list", "pos", *names])

    return run


def pairs_on_lists(lists: np.ndarray, f: dict[str, np.ndarray], t: float, other: np.ndarray | None = None):
    """Index pairs of rows of one list that may reach the threshold.  Rows are sorted
    by (list, low).  With `other`, only pairs of rows that differ in it."""
    n, low, high, ins, rem = f["n"], f["low"], f["high"], f["ins"], f["n"] - f["pos"]
    share = t / (1 + t)
    number = np.cumsum(np.concatenate([[0], (np.diff(lists) != 0).astype(np.int64)]))
    width = int(low.max()) + 2
    # How large a partner may be, by size and by what is left after this position.
    upto = np.minimum(high / t, (rem + ins + INSERTED) / share - low) + 1e-6
    upto = np.clip(np.floor(upto), -1, width - 1).astype(np.int64)
    end = np.searchsorted(number * width + low, number * width + upto, side="right")
    start = np.arange(len(low)) + 1
    live = np.flatnonzero(end > start)
    if not len(live):
        return
    edges = np.arange(0, len(low), SKIP_BLOCK)
    most, least, slack = np.maximum.reduceat(rem, edges), np.minimum.reduceat(low, edges), np.maximum.reduceat(ins, edges)
    first = start[live] // SKIP_BLOCK
    blocks = (end[live] - 1) // SKIP_BLOCK - first + 1
    done = np.cumsum(blocks)
    for part in np.split(np.arange(len(live)), np.searchsorted(done, np.arange(PAIRS_AT_ONCE // SKIP_BLOCK, done[-1], PAIRS_AT_ONCE // SKIP_BLOCK))):
        if not len(part):
            continue
        of, step = _grown(blocks[part])
        i, block = live[part][of], first[part][of] + step
        # A block is skipped as a whole if even its best position cannot do.
        keep = np.minimum(most[block], rem[i]) >= np.ceil(share * (low[i] + least[block]) - EPS) - ins[i] - slack[block]
        i, block = i[keep], block[keep]
        a, b = np.maximum(start[i], block * SKIP_BLOCK), np.minimum(end[i], (block + 1) * SKIP_BLOCK)
        of, step = _grown(b - a)
        i, j = i[of], a[of] + step
        need = np.ceil(share * (low[i] + low[j]) - EPS) - ins[i] - ins[j]
        keep = (np.minimum(rem[i], rem[j]) >= need) & (high[j] >= t * low[i])
        if other is not None:
            keep &= other[i] != other[j]
        i, j, need = i[keep], j[keep], need[keep]
        differ = np.zeros(len(i), dtype=np.int64)
        for w in ("b0", "b1", "b2", "b3"):
            differ += np.bitwise_count(f[w][i] ^ f[w][j])
        keep = differ <= n[i] + n[j] - 2 * need
        if keep.any():
            yield i[keep], j[keep]


def _candidates(t: float, spread: bool):
    """(a, b) pairs off the lists; `spread` for lists whose blocks `one` and `two` meet here."""

    def run(batches):
        import pyarrow as pa

        held = None

        def close(table):
            table = table.combine_chunks().to_batches()[0]
            get = lambda c: table.column(c).to_numpy(zero_copy_only=False)
            keys = ("list", "one", "two") if spread else ("list",)
            lists = get("list")
            if spread:
                lists = _mixed(lists + get("one"), 3).view(np.int64) ^ get("two")
            rep = get("rep")
            low = get("low").astype(np.int64)
            order = np.lexsort((low, lists))
            f = {c: get(c).astype(np.int64)[order] for c in ("n", "low", "high", "ins", "pos")}
            f |= {c: get(c)[order].view(np.uint64) for c in ("b0", "b1", "b2", "b3")}
            rep = rep[order]
            sides = None
            if spread:  # pairs within a block come once, from the triangle's diagonal
                across = (get("one") != get("two"))[order]
                sides = np.where(across, get("block")[order], -1 - np.arange(len(rep)))
            for i, j in pairs_on_lists(lists[order], f, t, sides):
                a, b = rep[i], rep[j]
                swap = a > b
                keep = a != b
                a, b = np.where(swap, b, a)[keep], np.where(swap, a, b)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column("rep").type
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            ends = [table.column(c).to_numpy() for c in (("list", "one", "two") if spread else ("list",))]
            same = np.logical_and.reduce([e == e[-1] for e in ends])
            cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0
            if cut:
                yield from close(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and len(held):
            yield from close(held)

    return run


def similar_sets(reps: DataFrame, threshold: float = THRESHOLD, name: str = "sets", hot: int = HOT, list_block: int = LIST_BLOCK) -> DataFrame:
    """(a, b, overlap, union_size), a < b: all pairs of word sets whose Jaccard
    similarity is at least the threshold."""
    t = float(threshold)
    kind = dict(reps.dtypes)["rep"]
    counts_of = reps.sparkSession.sparkContext.broadcast(word_counts(reps))  # COUNTERS numbers
    sets = materialize(_ordered_sets(reps, counts_of), name)
    followers = materialize(_follow(sets, t), f"{name}-followers")
    clusters = materialize(
        followers.join(sets.select("rep", F.col("n").alias("own")), "rep").groupBy("leader").agg(
            F.min("own").alias("least"), F.max("own").alias("most"), F.max(F.size("ins")).alias("inserted"), F.count("*").alias("followers")
        ),
        f"{name}-clusters",
    )
    leaders = (
        sets.drop("k1", "k2").join(followers.select("rep"), "rep", "left_anti")
        .join(clusters.drop("followers").withColumnRenamed("leader", "rep"), "rep", "left")
        .select(
            "rep", "n", "toks", "b0", "b1", "b2", "b3", F.least("n", F.coalesce("least", "n")).alias("low"),
            F.greatest("n", F.coalesce("most", "n")).alias("high"), F.coalesce("inserted", F.lit(0)).alias("ins"),
        )
    )
    fields = f"list long, pos int, n int, low int, high int, ins int, b0 long, b1 long, b2 long, b3 long, rep {kind}"
    postings = materialize(leaders.mapInArrow(_postings(t, counts_of, hot), fields), f"{name}-postings")
    # Lists that are still too long, spread as triangles of block pairs.
    long = materialize(postings.groupBy("list").agg(F.count("*").alias("members")).where(F.col("members") > list_block), f"{name}-long")
    pair = f"a {kind}, b {kind}"
    found = (
        postings.join(long.select("list"), "list", "left_anti").repartition("list").sortWithinPartitions("list").mapInArrow(_candidates(t, False), pair)
    )
    if long.limit(1).count():
        blocks = F.ceil(F.col("members") / F.lit(list_block)).cast("int")
        spread = (
            postings.join(long, "list")
            .withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("other", "members")
        )
        found = found.unionByName(
            spread.repartition("list", "one", "two").sortWithinPartitions("list", "one", "two").mapInArrow(_candidates(t, True), pair)
        )
    candidates = materialize(found.distinct(), f"{name}-candidates")
    # Words of the sets that are in question only.
    asked = candidates.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(clusters.select(F.col("leader").alias("rep"))).distinct()
    words = materialize(sets.select("rep", "toks").join(asked, "rep"), f"{name}-words")
    tokens = lambda end: words.select(F.col("rep").alias(end), F.col("toks").alias(f"{end}_toks"))
    lows = lambda end: clusters.select(
        F.col("leader").alias(end), F.col("least").alias(f"{end}_least"), F.col("inserted").alias(f"{end}_ins"), F.col("followers").alias(f"{end}_size")
    )
    low = lambda e: F.least(F.size(f"{e}_toks"), F.coalesce(f"{e}_least", F.size(f"{e}_toks")))
    slack = F.coalesce("a_ins", F.lit(0)) + F.coalesce("b_ins", F.lit(0))
    answers = materialize(
        candidates.join(tokens("a"), "a").join(tokens("b"), "b").join(lows("a"), "a", "left").join(lows("b"), "b", "left")
        .withColumn("overlap", F.size(F.array_intersect("a_toks", "b_toks")))
        .where(F.col("overlap") >= F.ceil(F.lit(t / (1 + t)) * (low("a") + low("b")) - EPS) - slack)
        .select("a", "b", "a_toks", "b_toks", "overlap", F.coalesce("a_size", F.lit(0)).alias("a_size"), F.coalesce("b_size", F.lit(0)).alias("b_size")),
        f"{name}-answers",
    )
    alone = (F.col("a_size") == 0) & (F.col("b_size") == 0)
    plain = answers.where(alone).select("a", "b", "overlap", (F.size("a_toks") + F.size("b_toks") - F.col("overlap")).alias("union_size"))
    inside = clusters.select(F.col("leader").alias("rep"), F.col("followers").alias("size")).join(words, "rep").select(
        F.col("rep").alias("a"), F.col("rep").alias("b"), F.col("toks").alias("a_toks"), F.col("toks").alias("b_toks"), F.size("toks").alias("overlap"),
        F.col("size").alias("a_size"), F.col("size").alias("b_size"),
    )
    # The answers of a leader of many are derived in parts of its followers.
    parts = lambda size: F.ceil((size + 1) / F.lit(CLUSTER_PART)).cast("int")
    derive = (
        answers.where(~alone).unionByName(inside)
        .withColumn("a_part", F.explode(F.sequence(F.lit(0), parts(F.col("a_size")) - 1)))
        .withColumn("b_part", F.explode(F.sequence(F.lit(0), parts(F.col("b_size")) - 1)))
        .drop("a_size", "b_size")
    )
    none = F.array().cast("array<bigint>")
    led = followers.join(clusters.select("leader", "followers"), "leader").select("leader", "rep", "ins", "del", "followers")
    # Leaders that only answer for others have no followers of their own, but take part themselves.
    themselves = derive.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(
        clusters.select(F.col("leader").alias("rep"), "followers"), "rep", "left"
    ).select(F.col("rep").alias("leader"), "rep", none.alias("ins"), none.alias("del"), F.coalesce("followers", F.lit(0).cast("long")).alias("followers"))
    members = materialize(
        led.unionByName(themselves).withColumn("part", F.pmod(F.xxhash64("rep"), parts(F.col("followers"))).cast("int")).drop("followers"), f"{name}-members"
    )
    side = lambda s, end: members.select(
        F.col("leader").alias(end), F.col("part").alias(f"{end}_part"), F.col("rep").alias(s), F.col("ins").alias(f"{s}_ins"), F.col("del").alias(f"{s}_del")
    )
    inter = lambda x, y: F.size(F.array_intersect(x, y))
    derived = derive.join(side("y", "a"), ["a", "a_part"]).join(side("z", "b"), ["b", "b_part"]).where("a != b or y < z")
    # |y & b| from |a & b|, then |y & z| from |y & b|, by the differing words alone.
    y_b = F.col("overlap") - inter("y_del", "b_toks") + inter("y_ins", "b_toks")
    in_y = lambda words: inter(words, "a_toks") - inter(words, "y_del") + inter(words, "y_ins")
    size = lambda s, end: F.size(f"{end}_toks") + F.size(f"{s}_ins") - F.size(f"{s}_del")
    derived = derived.withColumn("shared", y_b - in_y("z_del") + in_y("z_ins")).select(
        F.least("y", "z").alias("a"), F.greatest("y", "z").alias("b"), F.col("shared").alias("overlap"),
        (size("y", "a") + size("z", "b") - F.col("shared")).alias("union_size"),
    )
    return plain.unionByName(derived).where(F.col("overlap") >= F.lit(t) * F.col("union_size") - EPS)


def similar_pairs(rows: DataFrame, key: str, text: Column, threshold: float = THRESHOLD, name: str = "pairs", **options) -> DataFrame:
    """(key_1, key_2), key_1 < key_2, of all rows whose word sets reach the
    threshold.  Rows with a null key or without any word take no part; a repeated
    key counts once; an empty table gives no pairs."""
    copies, reps = classes(rows, key, text, name)
    pairs = similar_sets(reps, threshold, name, **options)
    one = lambda n, r: copies.select(F.col("key").alias(n), F.col("rep").alias(r))
    across = (
        pairs.select("a", "b").join(one("x", "a"), "a", "left").join(one("y", "b"), "b", "left")
        .select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    )
    within = one("x", "a").join(one("y", "a"), "a").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("key_1"), F.greatest("x", "y").alias("key_2"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of the edges (a, b): the smallest node reached, found by
    rounds of minimum labels and pointer jumping, each written to the shared folder."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), name)
    while True:
        heard = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        near = labels.join(heard, "a").select("a", "label", F.least("label", "heard").alias("next"))
        jump = labels.select(F.col("a").alias("next"), F.col("label").alias("far"))
        new = materialize(near.join(jump, "next", "left").select("a", "label", F.least("next", F.coalesce("far", "next")).alias("new")), name)
        if new.where("label != new").limit(1).count() == 0:
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
        labels = new.select("a", F.col("new").alias("label"))


def similar_groups(rows: DataFrame, key: str, text: Column, threshold: float = THRESHOLD, name: str = "groups", **options) -> DataFrame:
    """(key, group_id, links): every row with words, the smallest key of its group
    (connected by similar sets or equal ones) and how many other rows it is
    similar to.  Copies count as links but are never expanded into pairs."""
    copies, reps = classes(rows, key, text, name)
    pairs = materialize(similar_sets(reps, threshold, name, **options).select("a", "b"), f"{name}-links")
    sizes = copies.groupBy("rep").agg(F.count("*").alias("copies"))
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    reached = (
        ends.join(sizes.select(F.col("rep").alias("other"), "copies"), "other", "left").groupBy("rep").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("others"))
    )
    comp = components(pairs, f"{name}-components")
    per_class = (
        reps.select("rep").join(sizes, "rep", "left").join(reached, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "rep", F.coalesce("component", "rep").alias("group_id"),
            (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).alias("links"),
        )
    )
    return per_class.join(copies, "rep", "left").select(F.coalesce("key", "rep").alias("key"), "group_id", "links")
