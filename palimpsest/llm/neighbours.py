"""The most similar vectors of every vector, by a hierarchical k-means tree.

The upper tree is fitted on a bounded sample and broadcast.  Where one of its leaves
holds more than `refine` vectors, a tree of its own is fitted below it, in parallel and
on a bounded sample of that leaf, so the cells that are compared hold about LEAF_SIZE
vectors however many there are.  Trees are walked best bin first with a priority queue;
how many bins are visited is widened until the calibrated recall, measured against
brute force over all vectors, reaches the target.

Neighbouring cells stand together on a shelf, which one task compares.  A vector is
sent to its own shelf once, and as a query only to the other shelves it visits; a shelf
that grows beyond its size is spread over parts, and its queries over slices.  However
many shelves are visited, the vectors are stored once, with a bit for each upper leaf
visited, and sent in passes of one and a half times the rows of the table; what a pass has
shuffled is removed before the next one.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize, shuffles_removed

WIDTH = 384
K, LEAST_SIMILARITY = 5, 0.7
FIT_SAMPLE = 8_192  # vectors one tree is fitted on, at most
CALIBRATION_QUERIES = 256
TARGET_RECALL = 0.999
LEAF_SIZE, BRANCHES = 256, 8
REFINE = 16 * LEAF_SIZE  # a leaf of the upper tree with more vectors gets its own tree
SHELF = 16_384  # vectors compared in one task
SLICE = 4  # queries from elsewhere in one task at most, as a multiple of that
LEAST_SENT = 131_072  # rows a pass may send at least
BROADCAST_KEYS = 100_000
TREE_BYTES = 1 << 25  # of trees broadcast for a pass
SLACK = 1e-5  # of similarities in single precision


class Tree:
    """Unit centroids of all nodes; children of node i are kids[i] (empty: a leaf)."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.kids: list[list[int]] = [[]]
        centroids = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1] if sample.ndim == 2 else WIDTH)]
        parts = {0: np.arange(len(sample))}
        ready = {0}
        n_leaves = 1
        while ready and n_leaves < leaves:
            node = max(ready, key=lambda i: (len(parts[i]), -i))
            ready.discard(node)
            own = parts[node]
            groups = self._kmeans(sample[own], min(BRANCHES, leaves - n_leaves + 1), rng)
            if len(groups) < 2:
                continue
            del parts[node]
            for members in groups:
                child = len(centroids)
                x = sample[own[members]].mean(axis=0)
                centroids.append(x / max(np.linalg.norm(x), 1e-12))
                self.kids.append([])
                self.kids[node].append(child)
                parts[child] = own[members]
                ready.add(child)
            n_leaves += len(groups) - 1
        self.centroids = np.asarray(centroids, dtype=np.float32)
        self.fitted = {leaf: len(own) for leaf, own in parts.items()}  # sample vectors of each leaf
        self.is_leaf = np.array([not k for k in self.kids])

    @staticmethod
    def _kmeans(x: np.ndarray, k: int, rng) -> list[np.ndarray]:
        if len(x) < 2 * k:
            return []
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(10):
            at = np.argmax(x @ c.T, axis=1)
            new = np.stack([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(k)])
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
            if np.allclose(new, c):
                break
            c = new
        at = np.argmax(x @ c.T, axis=1)
        return [g for j in range(k) if len(g := np.flatnonzero(at == j))]

    def in_order(self) -> list[int]:
        """The leaves from left to right, so that relatives stand side by side."""
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            if self.kids[node]:
                stack += self.kids[node][::-1]
            else:
                out.append(node)
        return out

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf each vector belongs to, by the nearest child at every level."""
        at = np.zeros(len(x), dtype=np.int64)
        todo = np.arange(len(x))
        while len(todo):
            following = []
            for node in np.unique(at[todo]):
                kids = self.kids[node]
                rows = todo[at[todo] == node]
                if kids:
                    at[rows] = np.asarray(kids)[np.argmax(x[rows] @ self.centroids[kids].T, axis=1)]
                    following.append(rows)
            todo = np.concatenate(following) if following else np.empty(0, dtype=np.int64)
        return at

    def best_bins(self, x: np.ndarray, visits: int) -> np.ndarray:
        """For each query the first `visits` leaves, best bin first (-1: no more).

        Every row has its own priority queue; in each round all rows take the best
        entry of theirs, and only the children of nodes taken are compared."""
        n = len(x)
        visits = min(visits, int(self.is_leaf.sum()))
        out = np.full((n, visits), -1, dtype=np.int64)
        got = np.zeros(n, dtype=np.int64)
        held = np.zeros(n, dtype=np.int64)
        near = np.full((n, 4 * BRANCHES), -np.inf, dtype=np.float32)
        node = np.zeros((n, 4 * BRANCHES), dtype=np.int64)
        near[:, 0], held[:] = np.inf, 1
        rows = np.arange(n)
        while len(rows):
            best = np.argmax(near[rows], axis=1)
            taken = node[rows, best]
            alive = near[rows, best] > -np.inf
            near[rows, best] = -np.inf
            rows, taken = rows[alive], taken[alive]
            leaf = self.is_leaf[taken]
            done = rows[leaf]
            out[done, got[done]] = taken[leaf]
            got[done] += 1
            inner, at = rows[~leaf], taken[~leaf]
            order = np.argsort(at, kind="stable")
            inner, at = inner[order], at[order]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1) if len(at) else ():
                kids, mine = self.kids[at[part[0]]], inner[part]
                need = int(held[mine].max()) + len(kids)
                if need > near.shape[1]:
                    wider = max(need, 2 * near.shape[1]) - near.shape[1]
                    near = np.pad(near, ((0, 0), (0, wider)), constant_values=-np.inf)
                    node = np.pad(node, ((0, 0), (0, wider)))
                slots = held[mine][:, None] + np.arange(len(kids))
                near[mine[:, None], slots] = x[mine] @ self.centroids[kids].T
                node[mine[:, None], slots] = kids
                held[mine] += len(kids)
            rows = rows[got[rows] < visits]
        return out


def _shelves(order: list[int], sizes: dict[int, float], most: int) -> dict[int, int]:
    """A shelf number for each leaf: neighbours share one up to `most` vectors."""
    out, shelf, load = {}, 0, 0.0
    for leaf in order:
        n = sizes.get(leaf, 0)
        if load and load + n > most:
            shelf, load = shelf + 1, 0.0
        out[leaf] = shelf
        load += n
    return out


def _sound(batch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vectors of an Arrow batch (key, vec, ...) that take part: key and
    vector not null, `width` wide, finite and not all zero."""
    import pyarrow as pa
    import pyarrow.compute as pc

    keep = pc.and_(pc.is_valid(batch.column(0)), pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), width), False))
    at = np.flatnonzero(keep.to_numpy(zero_copy_only=False))
    values = batch.column(1).take(pa.array(at)).flatten()
    x = values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)  # a null becomes NaN
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[ok], x[ok] + np.float32(0)  # no negative zero


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision, normed in double precision."""
    wide = x.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def _packed(x: np.ndarray):
    """Rows of numbers as an Arrow array of bytes, without a copy per row."""
    import pyarrow as pa

    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize if x.ndim == 2 else 0
    offsets = (np.arange(len(x) + 1) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


def _unpacked(column, width: int, kind=np.float32) -> np.ndarray:
    if not len(column):
        return np.empty((0, width), dtype=kind)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=kind, count=len(column) * width, offset=int(ends[0])).reshape(-1, width)


def _share(rows: DataFrame, key: str, salt: str, most: int, total: int) -> DataFrame:
    """At most `most` rows: the share by hash of the key that gives about as many."""
    slots = 1 << 30
    share = min(slots, int(slots * 0.95 * most / total)) if total > most else slots
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), F.col(key).cast("string")), F.lit(slots)) < share).limit(most)


def _place(tree_of, width: int):
    """(key, h1, h2, leaf, vec): a vector that stood in this task before comes without vec."""

    def run(batches):
        import pyarrow as pa

        tree, seen = tree_of.value, set()
        for batch in batches:
            at, x = _sound(batch, width)
            if not len(at):
                continue
            prints = [xxhash.xxh3_128_intdigest(row.tobytes()) for row in x]
            fresh = np.empty(len(at), dtype=bool)
            for i, p in enumerate(prints):
                fresh[i] = p not in seen
                seen.add(p)
            low = np.array([p & (1 << 64) - 1 for p in prints], dtype=np.uint64).view(np.int64)
            high = np.array([p >> 64 for p in prints], dtype=np.uint64).view(np.int64)
            leaf = np.zeros(len(at), dtype=np.int32)
            leaf[fresh] = tree.leaf_of(_unit(x[fresh]))
            vec = _packed(x)
            if not fresh.all():
                vec = pa.array([v if f else None for v, f in zip(vec, fresh)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(low), pa.array(high), pa.array(leaf), vec], names=["key", "h1", "h2", "leaf", "vec"]
            )

    return run


def _brute(queries_of, k: int, least: float, width: int):
    """Per batch and query the k best of the batch (its own vector left out)."""

    def run(batches):
        import pyarrow as pa

        q, prints = queries_of.value
        for batch in batches:
            x = _unpacked(batch.column("vec"), width)
            if not len(x):
                continue
            sims = q @ _unit(x).T
            h1 = batch.column("h1").to_numpy()
            sims[prints[:, None] == h1[None, :]] = -2
            bar = np.full(len(q), least, dtype=np.float32)
            if len(x) > k:
                bar = np.maximum(bar, np.partition(sims, -k, axis=1)[:, -k])
            r, c = np.nonzero(sims >= bar[:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(r.astype(np.int32)), batch.column("leaf").take(pa.array(c)), pa.array(sims[r, c].astype(np.float64)), batch.column("vec").take(pa.array(c))],
                names=["q", "leaf", "sim", "vec"],
            )

    return run


def _fit_below(shares: dict[int, tuple[float, int]], width: int, leaf_size: int, shelf: int):
    """A tree for each leaf of the upper one that is too large, on its sample."""

    def run(key, pdf):
        x = _unit(np.frombuffer(b"".join(pdf["vec"]), dtype=np.float32).reshape(-1, width))
        n = shares[int(key[0])][1]
        tree = Tree(x, int(max(1, min(n // leaf_size, len(x) // 4))))
        scale = n / max(len(x), 1)
        sizes = {leaf: c * scale for leaf, c in tree.fitted.items()}
        tree.shelf = _shelves(tree.in_order(), sizes, shelf)
        loads = np.bincount([tree.shelf[leaf] for leaf in sizes], weights=list(sizes.values()))
        return pd.DataFrame({"leaf": [int(key[0])], "tree": [pickle.dumps(tree)], "loads": [loads.tolist()]})

    return run


_ROWS = "shelf long, salt int, role byte, key {kind}, vec binary, cell long, cells array<long>"


def _route(tree_of, visits: int, width: int):
    """(key, h1, leaf, vec, route): the leaves of the upper tree that a vector visits, its own
    among them, as a bit for each leaf from left to right."""

    def run(batches):
        import pyarrow as pa

        tree = tree_of.value
        order = tree.in_order()
        column = np.zeros(len(tree.kids), dtype=np.int64)
        column[order] = np.arange(len(order))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = tree.best_bins(_unit(_unpacked(batch.column("vec"), width)), visits)
            visited = np.zeros((len(bins), len(order)), dtype=bool)
            q, col = np.nonzero(bins >= 0)
            visited[q, column[bins[q, col]]] = True
            visited[np.arange(len(bins)), column[batch.column("leaf").to_numpy()]] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, _packed(np.packbits(visited, axis=1))], names=["key", "h1", "leaf", "vec", "route"])

    return run


def _visited(column, leaves: int) -> np.ndarray:
    """Routes as one row of truths for each vector."""
    bits = _unpacked(column, (leaves + 7) // 8, np.uint8)
    return np.unpackbits(bits, axis=1, count=leaves).view(bool)


def _visitors(units: list[np.ndarray], leaves: int):
    """(unit, n): how many vectors visit each unit, a set of leaves."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(len(units), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                visited = _visited(batch.column("route"), leaves)
                counts += [np.count_nonzero(visited[:, columns].any(axis=1)) for columns in units]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(units), dtype=np.int32)), pa.array(counts)], names=["unit", "n"])

    return run


def _passes(units: list[tuple[int, list[float], int]], shelf: int, most: int, cores: int):
    """Passes over the shelves: lists of (unit, shelf within it, parts, slices, first, last).

    `units` has the visitors of each, the vectors of its shelves and the bytes of its tree.
    The vectors of a large shelf are in several parts, the queries of a much visited one in
    several slices; each part meets each slice once, in the cells numbered part * slices +
    slice.  A pass takes cells for `most` rows, or one."""
    queries = max(shelf, min(SLICE * shelf, most // cores))  # of a slice
    now, rows, trees, last_unit = [], 0.0, 0, None
    for unit, (visitors, loads, size) in enumerate(units):
        for s, load in enumerate(loads):
            parts = max(1, int(np.ceil(load / (2 * shelf))))
            slices = max(1, int(np.ceil(visitors / queries)))
            each = max(1.0, visitors / slices + load / parts)
            first, end = 0, parts * slices
            while first < end:
                more = 0 if unit == last_unit else size
                room = int((most - rows) // each) if trees + more <= TREE_BYTES else 0
                if room < 1 and now:
                    yield now
                    now, rows, trees, last_unit = [], 0.0, 0, None
                    continue
                last = min(end, first + max(1, room))
                now.append((unit, s, parts, slices, first, last))
                rows += (last - first) * each
                trees, last_unit, first = trees + more, unit, last
    if now:
        yield now


def _sent(batch, rows: np.ndarray, raw: np.ndarray, q, cell, shelf, own, own_shelf, plan: np.ndarray, base: int):
    """Rows for the shelves of a pass from visits (q, cell, shelf) of the vectors `rows`; `own`
    and `own_shelf` (-1: elsewhere) are where each stands, `plan` has parts, slices, first
    and last of each shelf."""
    import pyarrow as pa

    live = plan[shelf, 3] > plan[shelf, 2]
    q, cell, shelf = q[live], cell[live], shelf[live]
    order = np.lexsort((cell, shelf, q))
    q, cell, shelf = q[order], cell[order], shelf[order]
    once = np.ones(len(q), dtype=bool)
    once[1:] = (np.diff(q) != 0) | (np.diff(cell) != 0)
    q, cell, shelf = q[once], cell[once], shelf[once]
    if not len(q):
        return None
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(q) != 0) | (np.diff(shelf) != 0)]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(q)).astype(np.int32)), pa.array(cell + base))
    who, where = q[starts], shelf[starts]
    home = own_shelf[who] == where
    parts, slices, first, last = plan[where].T
    mixed = batch.column("h1").to_numpy()[rows[who]].view(np.uint64)
    my_part = ((mixed >> np.uint64(32)) % parts.astype(np.uint64)).astype(np.int64)
    my_slice = ((mixed & np.uint64(0xFFFFFFFF)) % slices.astype(np.uint64)).astype(np.int64)
    # As a query to every part, in its slice; in its own part it is also one of the vectors.
    asks = np.repeat(np.arange(len(who)), parts)
    part = np.arange(len(asks)) - np.repeat(np.cumsum(parts) - parts, parts)
    # The vectors of a part come to all slices; their cells, to be asked for, to one.
    at_home = np.flatnonzero(home)
    stands = np.repeat(at_home, slices[at_home])
    slot = np.arange(len(stands)) - np.repeat(np.cumsum(slices[at_home]) - slices[at_home], slices[at_home])
    other = slot != my_slice[stands]
    stands, slot = stands[other], slot[other]
    at = np.concatenate([asks, stands])
    salt = np.concatenate([part * slices[asks] + my_slice[asks], my_part[stands] * slices[stands] + slot])
    role = np.concatenate([np.where(home[asks] & (part == my_part[asks]), 0, 1), np.zeros(len(stands), dtype=np.int64)])
    silent = np.arange(len(at)) >= len(asks)
    here = (salt >= first[at]) & (salt < last[at])
    at, salt, role, silent = at[here], salt[here], role[here], silent[here]
    if not len(at):
        return None
    return pa.RecordBatch.from_arrays(
        [
            pa.array(where[at] + base), pa.array(salt.astype(np.int32)), pa.array(role.astype(np.int8)), batch.column("key").take(pa.array(rows[who[at]])),
            _packed(raw[who[at]]), pa.array(own[who[at]] + base), lists.take(pa.array(at, mask=silent)),
        ],
        names=["shelf", "salt", "role", "key", "vec", "cell", "cells"],
    )


def _send(order: list[int], small: np.ndarray, plan_of_small: np.ndarray, below_of, width: int):
    """Vectors and queries to the shelves of a pass: those of the upper tree (`small` has the
    shelf of each leaf, -1 for none) and those of the trees below it that the pass has."""

    def run(batches):
        below = [(leaf, pickle.loads(tree), plan) for leaf, tree, plan in below_of.value]
        leaves = np.asarray(order)
        column = {leaf: i for i, leaf in enumerate(order)}
        shelf_at = small[leaves]
        live = np.flatnonzero((shelf_at >= 0) & (plan_of_small[shelf_at, 3] > plan_of_small[shelf_at, 2]))
        for batch in batches:
            if not batch.num_rows:
                continue
            visited, leaf = _visited(batch.column("route"), len(leaves)), batch.column("leaf").to_numpy().astype(np.int64)
            x = _unpacked(batch.column("vec"), width)
            q, col = np.nonzero(visited[:, live])
            cells = leaves[live[col]]
            out = [_sent(batch, np.arange(len(x)), x, q, cells, small[cells], leaf, small[leaf], plan_of_small, 0)]
            for top, tree, plan in below:
                rows = np.flatnonzero(visited[:, column[top]])
                if not len(rows):
                    continue
                raw, table = x[rows], np.zeros(len(tree.kids), dtype=np.int64)
                for cell, s in tree.shelf.items():
                    table[cell] = s
                u = _unit(raw)
                bins = tree.best_bins(u, tree.visits)
                q, col = np.nonzero(bins >= 0)
                at_home = np.flatnonzero(leaf[rows] == top)
                own, own_shelf = np.full(len(rows), -1, dtype=np.int64), np.full(len(rows), -1, dtype=np.int64)
                own[at_home] = tree.leaf_of(u[at_home])
                own_shelf[at_home] = table[own[at_home]]
                # The own cell is always visited.
                q, cells = np.concatenate([q, at_home]), np.concatenate([bins[q, col], own[at_home]])
                out.append(_sent(batch, rows, raw, q, cells, table[cells], own, own_shelf, plan, (top + 1) << 32))
            yield from (b for b in out if b is not None)

    return run


def _best_of_shelf(ids, x, u, norm, spans, keys, q, cells_flat, cells_of, own_index, k, least):
    """(query, other, similarity) frames of the k best of each query in this shelf."""
    uq = _unit(q)
    order = np.argsort(cells_flat, kind="stable")
    sorted_cells, owners = cells_flat[order], cells_of[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(sorted_cells) != 0])) if len(order) else []
    found = []
    for a, b in zip(starts, [*starts[1:], len(order)]):
        span = spans.get(int(sorted_cells[a]))
        if span is None:
            continue
        who = owners[a:b]
        for i in range(0, len(who), 2048):
            mine = who[i : i + 2048]
            sims = uq[mine] @ u[span[0] : span[1]].T
            bar = np.full(len(mine), least - 10 * SLACK, dtype=np.float32)
            if sims.shape[1] > k + 1:
                bar = np.maximum(bar, np.partition(sims, -(k + 1), axis=1)[:, -(k + 1)] - SLACK)
            r, c = np.nonzero(sims >= bar[:, None])
            found.append((mine[r], c + span[0], sims[r, c]))
    if not found:
        return None
    who, other, sim = (np.concatenate(p) for p in zip(*found))
    keep = ids[other] != keys[who] if own_index is None else other != own_index[who]
    who, other, sim = who[keep], other[keep], sim[keep]
    order = np.lexsort((-sim, who))
    who, other, sim = who[order], other[order], sim[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(who) != 0])) if len(who) else np.empty(0, dtype=np.int64)
    counts = np.diff(np.append(starts, len(who)))
    kth = np.where(counts >= k, sim[np.minimum(starts + k - 1, len(sim) - 1)] if len(sim) else 0, -2) if len(starts) else np.empty(0)
    keep = sim >= np.repeat(kth, counts) - SLACK
    who, other = who[keep], other[keep]
    exact = np.empty(len(who))
    for i in range(0, len(who), 16_384):
        w, o = who[i : i + 16_384], other[i : i + 16_384]
        a, b = q[w].astype(np.float64), x[o].astype(np.float64)
        exact[i : i + 16_384] = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * norm[o])
    exact = np.round(exact, 10)
    frame = pd.DataFrame({"who": who, "rep": keys[who], "other": ids[other], "sim": exact})
    frame = frame[frame["sim"] >= least].sort_values(["who", "sim", "other"], ascending=[True, False, True])
    return frame.groupby("who", sort=False).head(k)[["rep", "other", "sim"]]


def _compare(k: int, least: float, width: int):
    """Queries of a shelf against its vectors, which come first."""

    def run(batches):
        import pyarrow as pa

        current, parts, shelf, kind = None, [], None, None

        def lists_of(part):
            cells = part.column("cells")
            n = np.diff(np.asarray(cells.offsets))
            return cells.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(cells)), n)

        def close():
            """The shelf as one block, its vectors in order of their cells; then its own queries."""
            table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            ids = table.column("key").to_numpy(zero_copy_only=False)
            raw = _unpacked(table.column("vec"), width)
            once = np.flatnonzero(~pd.Series(ids).duplicated().to_numpy())
            order = once[np.argsort(table.column("cell").to_numpy()[once], kind="stable")]
            cell, x, ids = table.column("cell").to_numpy()[order], raw[order], ids[order]
            edges = np.flatnonzero(np.concatenate([[True], np.diff(cell) != 0, [True]]))
            spans = {int(cell[a]): (int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])}
            norm = np.linalg.norm(x.astype(np.float64), axis=1)
            block = (ids, x, _unit(x), norm, spans)
            flat, of = lists_of(table)
            place = np.full(len(raw), -1)
            place[order] = np.arange(len(order))
            keep = place[of] >= 0
            own = _best_of_shelf(*block, ids, x, flat[keep], place[of[keep]], np.arange(len(ids)), k, least)
            return block, own

        def out(frame):
            if frame is not None and len(frame):
                keys = (pa.array(frame[c], kind) for c in ("rep", "other"))
                yield pa.RecordBatch.from_arrays([*keys, pa.array(frame["sim"])], names=["rep", "other", "sim"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column("key").type
            at = batch.column("shelf").to_numpy() * 100_003 + batch.column("salt").to_numpy()
            role = batch.column("role").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0) | (np.diff(role) != 0)) + 1, [len(at)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                here = (int(at[a]), int(batch.column("salt")[a].as_py()))
                if here != current:
                    if parts:
                        shelf, own = close()
                        yield from out(own)
                    current, parts, shelf = here, [], None
                part = batch.slice(a, b - a)
                if role[a] == 0:
                    parts.append(part)
                    continue
                if parts:
                    shelf, own = close()
                    parts = []
                    yield from out(own)
                if shelf is None:
                    continue
                q = _unpacked(part.column("vec"), width)
                found = _best_of_shelf(*shelf, part.column("key").to_numpy(zero_copy_only=False), q, *lists_of(part), None, k, least)
                yield from out(found)
        if parts:
            yield from out(close()[1])

    return run


def _calibrated(spark, placed, tree, trees, big, total, k, least, target, width) -> tuple[int, float]:
    """(visits, recall): how many bins until sampled queries find what brute force finds."""
    got = _share(placed.where("vec is not null"), "key", "ask", CALIBRATION_QUERIES, total).select("vec", "h1").toArrow()
    if not len(got):
        return 1, 1.0
    q = _unit(np.frombuffer(b"".join(got.column("vec").to_pylist()), dtype=np.float32).reshape(-1, width))
    queries_of = spark.sparkContext.broadcast((q, got.column("h1").to_numpy()))
    best = placed.where("vec is not null").select("h1", "leaf", "vec").mapInArrow(_brute(queries_of, k, least, width), "q int, leaf int, sim double, vec binary")
    top = best.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "leaf", "vec")), asc=False), 1, k).alias("top"))
    truth = top.select("q", F.explode("top").alias("t")).select("q", "t.leaf", "t.vec")  # k rows a query
    if big:
        truth = materialize(truth, "truth")
    if not len(told := truth.select("q", "leaf").toPandas()):
        return 1, 1.0
    bins = tree.best_bins(q, len(tree.kids))
    rank = np.full((len(q), len(tree.kids)), len(tree.kids), dtype=np.int64)
    r, c = np.nonzero(bins >= 0)
    rank[r, bins[r, c]] = c + 1
    needed = rank[told["q"], told["leaf"]]
    if big:

        def ranks_below(rows):
            for pdf in rows:
                out = []
                for n, vec, raw in zip(pdf["q"], pdf["vec"], pdf["tree"]):
                    below = pickle.loads(raw)
                    leaf = below.leaf_of(_unit(np.frombuffer(vec, dtype=np.float32).reshape(1, -1)))[0]
                    out.append(int(np.flatnonzero(below.best_bins(q[n : n + 1], len(below.kids))[0] == leaf)[0]) + 1)
                yield pd.DataFrame({"q": pdf["q"], "leaf": pdf["leaf"], "rank": out})

        below = truth.join(trees.select("leaf", "tree"), "leaf").mapInPandas(ranks_below, "q int, leaf int, rank int").toPandas()
        # The upper leaf is reached and so is the cell below it.
        upper = needed[~np.isin(told["leaf"], list(big))]
        needed = np.concatenate([upper, np.maximum(rank[below["q"], below["leaf"]], below["rank"])])
    visits = 1
    while (recall := float((needed <= visits).mean())) < target:
        visits *= 2
    return visits, recall


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best of the hits (rep, other, sim) of each rep."""
    best = hits.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("minus"), "other"))).alias("all"))
    return best.select("rep", F.explode(F.slice("all", 1, k)).alias("hit")).select("rep", F.col("hit.other").alias("other"), (-F.col("hit.minus")).alias("sim"))


def _all_hits(routed, order, sizes, shares, trees, visits, k, least, width, shelf, most, name) -> DataFrame:
    """(rep, other, sim) of all shelves, pass by pass: a pass sends at most `most` rows, and
    what it shuffled is removed before the next."""
    spark, kind = routed.sparkSession, dict(routed.dtypes)["key"]
    total = sum(sizes.values())
    shelf_of = _shelves([leaf for leaf in order if leaf not in shares], sizes, shelf)
    small = np.full(max(order) + 1, -1, dtype=np.int64)
    for leaf, s in shelf_of.items():
        small[leaf] = s
    loads = np.bincount(list(shelf_of.values()), weights=[sizes.get(leaf, 0) for leaf in shelf_of]) if shelf_of else np.empty(0)
    about = {r["leaf"]: r for r in trees.select("leaf", "loads", F.length("tree").alias("size")).collect()} if shares else {}  # a row per leaf
    tops = [leaf for leaf in order if leaf in shares]
    columns = small[order]
    sets = [np.flatnonzero(columns == s) for s in range(len(loads))] + [np.array([order.index(leaf)]) for leaf in tops]
    counted = routed.select("route").mapInArrow(_visitors(sets, len(order)), "unit int, n long").groupBy("unit").agg(F.sum("n").alias("n")).collect()
    visitors = {r["unit"]: r["n"] for r in counted}
    units = [(visitors.get(s, 0), [load], 0) for s, load in enumerate(loads)]
    units += [(visitors.get(len(loads) + i, 0), about[leaf]["loads"], about[leaf]["size"]) for i, leaf in enumerate(tops)]
    hits, held, rows = None, [], 0
    for n, plan in enumerate(_passes(units, shelf, most, spark.sparkContext.defaultParallelism)):
        plan_of_small = np.zeros((len(loads) + 1, 4), dtype=np.int64)  # the last one, of no shelf, stays without rows
        plan_of_small[:, :2] = 1
        plans: dict[int, np.ndarray] = {}
        for unit, s, *numbers in plan:
            if unit < len(loads):
                plan_of_small[unit] = numbers
            else:
                leaf = tops[unit - len(loads)]
                plans.setdefault(leaf, np.tile([1, 1, 0, 0], (len(about[leaf]["loads"]), 1)))[s] = numbers
        below = []
        for r in trees.where(F.col("leaf").isin(list(plans))).select("leaf", "tree").collect() if plans else ():  # at most TREE_BYTES, or one
            tree = pickle.loads(r["tree"])
            tree.visits = visits
            below.append((r["leaf"], pickle.dumps(tree), plans[r["leaf"]]))
        sent = routed.mapInArrow(_send(order, small, plan_of_small, spark.sparkContext.broadcast(below), width), _ROWS.format(kind=kind))
        found = (
            sent.repartition("shelf", "salt").sortWithinPartitions("shelf", "salt", "role")
            .mapInArrow(_compare(k, least, width), f"rep {kind}, other {kind}, sim double")
        )
        with shuffles_removed(spark):
            held.append(materialize(found, f"{name}-hits-{n}"))
        rows += held[-1].count()
        # Hits that later ones outdo do not pile up.
        if len(held) > 1 and rows > 2 * k * total:
            with shuffles_removed(spark):
                folded = materialize(_best(reduce(DataFrame.unionAll, held), k), f"{name}-best-{n}")
            for table in held:
                discard(table)
            held, rows = [folded], folded.count()
    if not held:
        return spark.createDataFrame([], f"rep {kind}, other {kind}, sim double")
    return reduce(DataFrame.unionAll, held)


def nearest(
    rows: DataFrame,
    key: str,
    vector: str,
    k: int = K,
    least: float = LEAST_SIMILARITY,
    width: int = WIDTH,
    target: float = TARGET_RECALL,
    name: str = "vectors",
    leaf_size: int = LEAF_SIZE,
    refine: int = REFINE,
    shelf: int = SHELF,
    upper_leaves: int | None = None,
    most_sent: int | None = None,
) -> tuple[DataFrame, float]:
    """((key, other, similarity, rank), calibrated recall): for each sound vector
    its k most similar others of cosine `least` or more; equal similarity puts the
    smaller key first.

    Equal vectors are one class: the class is searched once, and each member gets
    the other members and those of the classes found.  Unsound vectors take no
    part; a key that comes twice counts with one of its vectors and is never its own
    neighbour; an empty table gives no rows.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vec")).where(F.size("vec") == width)
    kind = dict(rows.dtypes)[key]
    about = rows.count()
    # Samples are shares by hash, so no task or driver sorts vectors for them.
    sample = _share(given, "key", "fit", FIT_SAMPLE, about).toArrow().combine_chunks().to_batches()
    x = _unit(_sound(sample[0], width)[1]) if sample else np.zeros((0, width), dtype=np.float32)
    leaves = max(1, min(about // leaf_size, len(x) // 4, upper_leaves or FIT_SAMPLE))
    tree = Tree(x, leaves)
    tree_of = spark.sparkContext.broadcast(tree)
    placed = materialize(
        given.mapInArrow(_place(tree_of, width), f"key {kind}, h1 long, h2 long, leaf int, vec binary"), name
    )
    sizes = {r["leaf"]: r["n"] for r in placed.where("vec is not null").groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row per leaf
    total = sum(sizes.values())
    shares = {leaf: (min(1.0, FIT_SAMPLE / n), n) for leaf, n in sizes.items() if n > refine}
    big = set(shares)
    trees = None
    if big:
        share = spark.createDataFrame([(leaf, s) for leaf, (s, _) in shares.items()], "leaf int, share double")
        picked = (
            placed.where("vec is not null").join(F.broadcast(share), "leaf")
            .where(F.pmod(F.xxhash64(F.lit("below"), "h1"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("leaf", "vec")
        )
        trees = materialize(picked.groupBy("leaf").applyInPandas(_fit_below(shares, width, leaf_size, shelf), "leaf int, tree binary, loads array<double>"), f"{name}-trees")
    visits, recall = _calibrated(spark, placed, tree, trees, big, total, k, least, target, width) if total else (1, 1.0)

    # Classes of equal vectors; most have one member.
    several = placed.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    among = placed.select("key", "h1", "h2", F.when(F.col("vec").isNotNull(), F.col("key")).alias("with_vec")).join(several, ["h1", "h2"])
    chosen = among.groupBy("h1", "h2").agg(F.min("with_vec").alias("rep"))
    copies = materialize(among.select("h1", "h2", "key").distinct().join(chosen, ["h1", "h2"]).select("key", "rep"), f"{name}-copies")
    others = copies.where("key != rep").select("key")
    # Where there are many, their keys are built into tables of hashes; sorting the vectors would write them twice.
    others = others.hint("broadcast" if others.count() <= BROADCAST_KEYS else "shuffle_hash")
    reps = placed.where("vec is not null").join(others, "key", "left_anti")
    order = tree.in_order()
    routed = materialize(
        reps.select("key", "h1", "leaf", "vec").mapInArrow(_route(tree_of, visits, width), f"key {kind}, h1 long, leaf int, vec binary, route binary"),
        f"{name}-routed",
    )
    discard(placed)
    hits = _all_hits(routed, order, sizes, shares, trees, visits, k, least, width, shelf, most_sent or max(total * 3 // 2, LEAST_SENT), name)
    # Best k classes per class, then the smallest k + 1 keys of each class.
    best = _best(hits, k)
    smallest = materialize(_smallest(copies, k + 1), f"{name}-smallest")
    options = (
        best.join(smallest.select(F.col("rep").alias("other"), "keys"), "other", "left")
        .select("rep", F.explode(F.coalesce("keys", F.array("other"))).alias("key"), "sim")
        .unionByName(smallest.select("rep", F.explode("keys").alias("key"), F.lit(1.0).alias("sim")))
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("minus"), "key"))).alias("options"))
        .select("rep", F.slice("options", 1, k + 1).alias("options"))
    )
    result = (
        options.join(copies.select("rep", F.col("key").alias("member")), "rep", "left")
        .withColumn("me", F.coalesce("member", "rep"))
        .select(F.col("me").alias("key"), F.posexplode(F.slice(F.filter("options", lambda o: o["key"] != F.col("me")), 1, k)).alias("rank", "o"))
        .select("key", F.col("o.key").alias("other"), (-F.col("o.minus")).alias("similarity"), (F.col("rank") + 1).alias("rank"))
    )
    return result, recall


def _smallest(members: DataFrame, n: int) -> DataFrame:
    """(rep, keys): the n smallest keys of each class, kept small before and after
    the shuffle so that a class of a third of all rows is no burden."""
    spread = members.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(64)))
    for by in (["rep", "slot"], ["rep"]):
        spread = spread.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("n") <= n)
    return spread.groupBy("rep").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def neighbour_pairs(rows: DataFrame, key: str, vector: str, **options) -> DataFrame:
    """(key_1, key_2), key_1 < key_2: pairs in which one is a neighbour of the other."""
    found, _ = nearest(rows, key, vector, **options)
    return found.select(F.least("key", "other").alias("key_1"), F.greatest("key", "other").alias("key_2")).distinct()
