"""Filling containers of fixed capacity with items.

Harmonic packing: an item of size s is of class i = capacity // s, so that any i
items of the class fit into one container, and every container of the class is given
exactly i of them, in the order they come, without a look at their sizes.  Sizes below
capacity / CLASSES are the last class and go in one after another.  Workers pack their
own items, so nothing about containers is shared.

The fixed count leaves room, which a second step uses: the containers of the smallest
classes, as many as fill the room of all larger ones, are dissolved, and their items
go, largest first, where they leave the least room.  What does not fit is packed the
same way again.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
CLASSES = 64
ITEMS_PER_TASK = 200_000


def classes_of(sizes: np.ndarray, capacity: int, classes: int) -> np.ndarray:
    """The class of every size: how many of it one container takes, at most `classes`."""
    return np.minimum(capacity // sizes, classes)


def harmonic(sizes: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES) -> np.ndarray:
    """A container number for every size (1..capacity), each class by itself."""
    kind = classes_of(sizes, capacity, classes)
    bins = np.empty(len(sizes), dtype=np.int64)
    done = 0
    for i in np.unique(kind).tolist():
        own = np.flatnonzero(kind == i)
        if i < classes:
            bins[own] = done + np.arange(len(own)) // i
        else:
            room = 0
            n = done - 1
            for j, size in zip(own.tolist(), sizes[own].tolist()):
                if size > room:
                    n, room = n + 1, capacity
                bins[j] = n
                room -= size
        done = int(bins[own[-1]]) + 1
    return bins


class Rooms:
    """Containers by the room they have left."""

    def __init__(self, room: np.ndarray) -> None:
        self.by: dict[int, list[int]] = {}
        for b in np.flatnonzero(room > 0).tolist():
            self.by.setdefault(int(room[b]), []).append(b)
        self.sizes = sorted(self.by)

    def put(self, size: int) -> int | None:
        """The container in which an item of that size leaves the least room."""
        k = bisect.bisect_left(self.sizes, size)
        if k == len(self.sizes):
            return None
        room = self.sizes[k]
        here = self.by[room]
        b = here.pop()
        if not here:
            del self.by[room]
            self.sizes.pop(k)
        left = room - size
        if left:
            if left not in self.by:
                bisect.insort(self.sizes, left)
            self.by.setdefault(left, []).append(b)
        return b


def pack(sizes: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES, fill: bool = True) -> np.ndarray:
    """A container number for every size (1..capacity); without `fill` the harmonic
    containers as they are."""
    if not fill:
        return harmonic(sizes, capacity, classes)
    out = np.empty(len(sizes), dtype=np.int64)
    rest, done = np.arange(len(sizes)), 0
    while len(rest):
        mine = sizes[rest]
        bins = harmonic(mine, capacity, classes)
        kind = classes_of(mine, capacity, classes)
        room = np.full(int(bins.max()) + 1, capacity) - np.bincount(bins, weights=mine).astype(np.int64)
        level = np.zeros(len(room), dtype=np.int64)
        level[bins] = kind
        first = int(level.min())
        # From the smallest class on: the classes whose items are as much as the others' room.
        held = np.bincount(kind, weights=mine, minlength=classes + 2)
        spare = np.bincount(level, weights=room, minlength=classes + 2)
        cut = classes
        while cut > first + 1 and held[cut:].sum() < spare[:cut].sum():
            cut -= 1
        stays = (kind < cut) | (kind == first)
        out[rest[stays]] = done + bins[stays]
        open_bins = Rooms(np.where((level < cut) | (level == first), room, 0))
        movers = np.flatnonzero(~stays)
        movers = movers[np.argsort(-mine[movers], kind="stable")]
        left = []
        for j, size in zip(movers.tolist(), mine[movers].tolist()):
            b = open_bins.put(size)
            if b is None:
                left.append(j)
            else:
                out[rest[j]] = done + b
        done += len(room)
        rest = rest[np.sort(np.asarray(left, dtype=np.int64))]
    return np.unique(out, return_inverse=True)[1] if len(out) else out


def pack_table(
    sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, items_per_task: int = ITEMS_PER_TASK, classes: int = CLASSES, fill: bool = True
) -> DataFrame:
    """(key, piece_no, first_unit, n_units, container) of all items with a size
    of 1 or more; null and non-positive sizes are no items.

    An item within the capacity is one piece.  A longer one is cut into full
    containers and one remainder, which is packed like any other item.  Equal
    keys are separate items.  Containers never overflow; their names hold the
    number of the task that filled them.
    """
    kind = dict(sizes.dtypes)[key]
    items = sizes.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).where("size > 0")
    pieces = items.select(
        "key", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(capacity).cast("long"))).alias("piece_no", "first_unit"), "size"
    ).select("key", (F.col("piece_no") + 1).alias("piece_no"), "first_unit", F.least(F.lit(capacity), F.col("size") - F.col("first_unit")).alias("n_units"))

    def run(batches):
        from pyspark import TaskContext

        task, done = TaskContext.get().partitionId(), 0
        held: list[pd.DataFrame] = []
        count = 0

        def fill(held):
            nonlocal done
            pdf = pd.concat(held, ignore_index=True)
            bins = pack(pdf["n_units"].to_numpy(), capacity, classes, fill) + done
            done = int(bins.max()) + 1
            return pdf.assign(container=[f"{task}-{b}" for b in bins])

        for pdf in batches:
            if len(pdf):
                held.append(pdf)
                count += len(pdf)
            if count >= items_per_task:
                yield fill(held)
                held, count = [], 0
        if held:
            yield fill(held)

    return pieces.mapInPandas(run, f"key {kind}, piece_no int, first_unit long, n_units long, container string").withColumnRenamed("key", key)
