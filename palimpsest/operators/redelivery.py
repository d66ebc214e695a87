"""Messages delivered more than once: keep exactly one copy of each.

Rows are put into time buckets.  Every bucket has a Bloom filter of two bits: was an
identifier seen, was it seen twice; one coarse filter spans all buckets.  Rows are
screened where they are read: what the coarse filter has not seen twice, or no bucket's
filter confirms, is new for certain and never moves.  Possible repeats alone are
reduced to one row per identifier and bucket, stored by bucket, and verified exactly by
an equi-join with the storage of just the buckets their filters name.

Filters are broadcast up to FILTER_BYTES.  Beyond that the hashed identifiers, one
row per identifier and bucket, are spread by slices of their hash, and each slice is
screened in order of buckets by filters of its own, bounded by IDS_PER_SLICE.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BITS_PER_ID = 12
HASHES = 6
FILTER_BYTES = 32 << 20
IDS_PER_SLICE = 2_000_000
ALL = -(1 << 40)  # stands for the filter over all buckets


def canonical_uuid(text: Column) -> Column:
    """The 32 lower-case hexadecimal digits of a UUID however it is written.

    Upper case, outer blanks, braces, a urn:uuid: prefix and missing or odd
    hyphens do not matter.  A text that denotes no UUID stays as it is, trimmed
    and in lower case, as an identifier of its own; null and blank give null.
    """
    bare = F.lower(F.regexp_replace(text, r"(?U)^[\s{(]+|[\s})]+$", ""))
    digits = F.regexp_replace(F.regexp_replace(bare, r"^urn:uuid:", ""), r"[-{}]", "")
    return F.when(digits.rlike(r"^[0-9a-f]{32}$"), digits).when(bare != "", bare)


def filter_bits(ids: int) -> int:
    """Bits of a filter for so many identifiers: a power of two."""
    return 1 << max(6, (BITS_PER_ID * ids - 1).bit_length())


def positions(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    steps = np.arange(HASHES, dtype=np.uint64)[:, None]
    return ((h1[None, :] + steps * (h2[None, :] | np.uint64(1))) >> np.uint64(7)) & np.uint64(bits - 1)


class SeenTwice:
    """A Bloom filter that also knows what was added twice; its bits are packed."""

    def __init__(self, bits: int, seen: bytes | None = None, twice: bytes | None = None) -> None:
        self.bits = bits
        self.seen = np.zeros(bits // 8, dtype=np.uint8) if seen is None else np.frombuffer(seen, dtype=np.uint8).copy()
        self.twice = np.zeros(bits // 8, dtype=np.uint8) if twice is None else np.frombuffer(twice, dtype=np.uint8).copy()

    @staticmethod
    def _get(array: np.ndarray, at: np.ndarray) -> np.ndarray:
        return array[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1

    @staticmethod
    def _set(array: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(array, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        at = positions(h1, h2, self.bits)
        at.sort(axis=0)  # a position of one identifier counts once
        once = np.ones(at.shape, dtype=bool)
        once[1:] = at[1:] != at[:-1]
        at, times = np.unique(at[once], return_counts=True)
        self._set(self.twice, at[(times > 1) | (self._get(self.seen, at) == 1)])
        self._set(self.seen, at)

    def merge(self, other: SeenTwice) -> None:
        self.twice |= other.twice | (self.seen & other.seen)
        self.seen |= other.seen

    def held(self, h1: np.ndarray, h2: np.ndarray, twice: bool = False) -> np.ndarray:
        """May the filter hold these identifiers (twice)?"""
        array = self.twice if twice else self.seen
        return self._get(array, positions(h1, h2, self.bits)).astype(bool).all(axis=0)


class Screen:
    """The filters of all buckets, and one over all of them."""

    def __init__(self, filters: dict[int, SeenTwice]) -> None:
        self.all = filters.get(ALL)
        self.buckets = {b: f for b, f in sorted(filters.items()) if b != ALL}

    def matched(self, bucket: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> list[list[int]]:
        """For each row the buckets that may hold another row of its identifier."""
        out: list[list[int]] = [[] for _ in range(len(bucket))]
        maybe = np.flatnonzero(self.all.held(h1, h2, True)) if self.all is not None else np.empty(0, dtype=np.int64)
        for b, f in self.buckets.items() if len(maybe) else ():
            own = bucket[maybe] == b
            hit = np.where(own, f.held(h1[maybe], h2[maybe], True), f.held(h1[maybe], h2[maybe]))
            for i in maybe[hit].tolist():
                out[i].append(b)
        return out


def _unsigned(column) -> np.ndarray:
    return np.asarray(column).astype(np.int64).view(np.uint64)


def _filters(hashed: DataFrame, sizes: dict[int, int]) -> dict[int, SeenTwice]:
    """The filters of the buckets (bucket, h1, h2), each built by every task for its own
    rows and put together bit by bit; their size was checked before."""
    bits = {b: filter_bits(n) for b, n in sizes.items()}

    def build(batches):
        import pyarrow as pa

        mine: dict[int, SeenTwice] = {}
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            h1, h2 = _unsigned(batch.column(1)), _unsigned(batch.column(2))
            for b in [*np.unique(bucket).tolist(), ALL]:
                own = np.flatnonzero(bucket == b) if b != ALL else slice(None)
                mine.setdefault(b, SeenTwice(bits[b])).add(h1[own], h2[own])
        if mine:
            packed = [[zlib.compress(a.tobytes(), 1) for a in (f.seen, f.twice)] for f in mine.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(mine), pa.int64()), *(pa.array([p[i] for p in packed], pa.binary()) for i in (0, 1))], names=["bucket", "seen", "twice"]
            )

    out: dict[int, SeenTwice] = {}
    for r in hashed.select("bucket", "h1", "h2").mapInArrow(build, "bucket long, seen binary, twice binary").toLocalIterator():
        part = SeenTwice(bits[r["bucket"]], zlib.decompress(r["seen"]), zlib.decompress(r["twice"]))
        if r["bucket"] in out:
            out[r["bucket"]].merge(part)
        else:
            out[r["bucket"]] = part
    return out


def _screen_slices(batches):
    """Rows (ident, bucket, first, n, h1, h2) of whole slices in order of buckets: the
    earlier buckets that may hold their identifier.  Every bucket of a slice has a
    filter; what one over all of them lacks is new."""
    filters: list[tuple[int, SeenTwice]] = []
    whole = SeenTwice(filter_bits(IDS_PER_SLICE))
    for pdf in batches:
        matched: dict[int, list[int]] = {}
        for bucket, part in pdf.groupby("bucket", sort=True):
            h1, h2 = _unsigned(part["h1"]), _unsigned(part["h2"])
            maybe = np.flatnonzero(whole.held(h1, h2))
            hits = [(b, f.held(h1[maybe], h2[maybe])) for b, f in filters if b != bucket] if len(maybe) else []
            for k, i in enumerate(maybe.tolist()):
                matched[part.index[i]] = sorted({b for b, hit in hits if hit[k]})
            own = SeenTwice(filter_bits(len(part)))
            own.add(h1, h2)
            filters.append((int(bucket), own))
            whole.add(h1, h2)
        yield pdf[["ident", "bucket", "first"]].assign(matched=[matched.get(i, []) for i in pdf.index])


def split_deliveries(
    rows: DataFrame, key: str, ident: str, at: str, bucket_days: int = 7, name: str = "redelivery", filter_bytes: int = FILTER_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(kept, surplus) of a table of UUID-identified messages.

    Kept: every row that is the earliest, by (at, key), of its identifier, and
    every row without a usable identifier (null or blank), which is nobody's
    copy.  Surplus: all other rows.  A null time counts as the earliest.  Extra
    columns go through; an empty table gives two empty ones.  Keys are unique.
    """
    time = F.coalesce(F.col(at).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz"))
    days = F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date"))
    named = canonical_uuid(F.col(ident))
    parts = {
        "__ident": named, "__bucket": F.floor(days / F.lit(bucket_days)).cast("long"),
        "__h1": F.xxhash64(named), "__h2": F.xxhash64(F.lit("second"), named), "__at": time,
    }
    hashed = materialize(
        rows.select(F.col(key).alias("key"), *(c.alias(n.strip("_")) for n, c in parts.items())).where("ident is not null"), f"{name}-hashed"
    )
    kind = dict(rows.dtypes)[key]
    sizes = {r["bucket"]: r["n"] for r in hashed.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row per bucket of days
    total = sum(sizes.values())
    first = F.min(F.struct("at", "key")).alias("first")
    if sum(filter_bits(n) for n in (*sizes.values(), total)) // 4 <= filter_bytes:
        screen_of = rows.sparkSession.sparkContext.broadcast(Screen(_filters(hashed, sizes | {ALL: total})))

        def screen(batches):
            import pyarrow as pa

            for batch in batches:
                matched = screen_of.value.matched(batch.column(0).to_numpy(), _unsigned(batch.column(1)), _unsigned(batch.column(2)))
                at = [i for i, m in enumerate(matched) if m]
                kept = [batch.column(i).take(pa.array(at, pa.int64())) for i in (3, 4, 5, 0)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([matched[i] for i in at], pa.list_(pa.int64()))], names=["key", "at", "ident", "bucket", "matched"])

        possible = materialize(
            hashed.select("bucket", "h1", "h2", "key", "at", "ident").mapInArrow(
                screen, f"key {kind}, at timestamp_ntz, ident string, bucket long, matched array<long>"
            ),
            f"{name}-possible",
        )
        storage = possible.groupBy("ident", "bucket").agg(first, F.first("matched").alias("matched"))
    else:
        slices = total // IDS_PER_SLICE + 1
        once = hashed.groupBy("ident", "bucket", "h1", "h2").agg(first, F.count("*").alias("n"))
        placed = once.repartition(slices, F.pmod("h1", F.lit(slices))).sortWithinPartitions("bucket")
        storage = placed.mapInPandas(_screen_slices, f"ident string, bucket long, first struct<at:timestamp_ntz,key:{kind}>, matched array<long>")
        possible = hashed.select("key")
    # Stored by bucket, so that the verification reads none but the buckets named.
    storage = materialize(storage.hint("rebalance", "bucket"), f"{name}-storage", partition_by=["bucket"])
    asked = storage.select("ident", "bucket", F.explode(F.filter("matched", lambda b: b < F.col("bucket"))).alias("earlier"))
    buckets = [r["earlier"] for r in asked.select("earlier").distinct().collect()]
    held = storage.where(F.col("bucket").isin(buckets)).select("ident", F.col("bucket").alias("earlier"))
    later = asked.join(held, ["ident", "earlier"], "left_semi").select("ident", "bucket").distinct()
    firsts = storage.join(later, ["ident", "bucket"], "left_anti").select(F.col("first.key").alias(key))
    surplus = materialize(possible.select(F.col("key").alias(key)).join(firsts, key, "left_anti"), f"{name}-surplus")
    return rows.join(surplus, key, "left_anti"), rows.join(surplus, key, "left_semi")
