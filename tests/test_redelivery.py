import random
import uuid
from datetime import datetime, timedelta

import pytest

from palimpsest.operators import redelivery
from palimpsest.operators.redelivery import SeenTwice, canonical_uuid, split_deliveries
from pyspark.sql import functions as F

SCHEMA = "k long, sid string, at timestamp_ntz, first string, ident string"


def spelled(u: str, how: int) -> str:
    return [u, u.upper(), " " + u, u + "\n", "{" + u + "}", "urn:uuid:" + u, u.replace("-", ""), u.replace("-", "").upper()][how % 8]


def brute(rows):
    seen, surplus = set(), set()
    for k, s, at, *_ in sorted((r for r in rows if r[1] and r[1].strip()), key=lambda r: (r[2] or datetime.min, r[0])):
        name = s.strip().lower().replace("urn:uuid:", "").strip("{}").replace("-", "")
        if name in seen:
            surplus.add(k)
        seen.add(name)
    return surplus


@pytest.mark.parametrize("filter_bytes", [redelivery.FILTER_BYTES, 0])
def test_against_brute_force_with_a_hot_identifier(spark, filter_bytes):
    r = random.Random(5)
    ids = [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(150)]
    rows = []
    for k in range(900):
        u = ids[0] if k % 3 == 0 else r.choice(ids)
        rows.append((k, spelled(u, r.randrange(8)), datetime(2024, 1, 1) + timedelta(hours=r.randrange(3000)), "x", "y"))
    rows += [(1000, None, datetime(2024, 1, 1), None, None), (1001, "  ", None, None, None), (1002, ids[1], None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept, surplus = split_deliveries(df, "k", "sid", "at", bucket_days=3, filter_bytes=filter_bytes)
    got = {x.k for x in surplus.collect()}
    assert got == brute(rows)
    assert {x.k for x in kept.collect()} == {x[0] for x in rows} - got
    assert kept.columns == df.columns


def test_empty_and_repeated_times(spark):
    kept, surplus = split_deliveries(spark.createDataFrame([], SCHEMA), "k", "sid", "at")
    assert kept.count() == surplus.count() == 0
    u = str(uuid.uuid4())
    rows = [(k, u, datetime(2024, 5, 5), None, None) for k in (3, 1, 2)]
    kept, _ = split_deliveries(spark.createDataFrame(rows, SCHEMA), "k", "sid", "at")
    assert [x.k for x in kept.collect()] == [1]


def test_look_alikes_stay_apart(spark):
    u = "7d793037-a076-4891-a2b5-0f2b1c6b7c11"
    df = spark.createDataFrame([(u,), (u[:-1] + "2",), (u[:-1],), ("not-a-uuid",), (None,), ("",)], "s string")
    names = [x[0] for x in df.select(canonical_uuid(F.col("s"))).collect()]
    assert names[0] == u.replace("-", "") and len(set(names[:4])) == 4 and names[4] is None and names[5] is None


def test_filters_never_miss():
    import numpy as np

    r = np.random.default_rng(1)
    h = r.integers(0, 2**63, size=(2, 5000)).astype(np.uint64)
    parts = [SeenTwice(redelivery.filter_bits(5000)) for _ in range(2)]
    parts[0].add(h[0, :3000], h[1, :3000])
    parts[0].add(h[0, 2900:3000], h[1, 2900:3000])
    parts[1].add(np.concatenate([h[0, 2500:], h[0, 4900:]]), np.concatenate([h[1, 2500:], h[1, 4900:]]))
    parts[0].merge(parts[1])
    assert parts[0].held(*h).all()
    twice = parts[0].held(*h, True)
    assert twice[2500:3000].all() and twice[4900:].all() and twice[:2500].mean() < 0.03
    other = r.integers(0, 2**63, size=(2, 5000)).astype(np.uint64)
    assert parts[0].held(*other).mean() < 0.05


def test_only_possible_repeats_move_and_only_named_buckets_are_read(spark):
    ids = [str(uuid.UUID(int=i * 7919)) for i in range(300)]
    rows = [(k, u, datetime(2024, 1, 1) + timedelta(days=k), None, None) for k, u in enumerate(ids)] + [(900, ids[3], datetime(2024, 9, 1), None, None)]
    kept, surplus = split_deliveries(spark.createDataFrame(rows, SCHEMA), "k", "sid", "at", name="named")
    assert [x.k for x in surplus.collect()] == [900] and kept.count() == 300
    import glob

    where = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    newest = max(glob.glob(f"{where}/palimpsest/named-storage-*"), key=__import__("os").path.getmtime)
    stored = spark.read.parquet(newest)
    assert stored.count() < 40 and stored.rdd.getNumPartitions() >= 1 and "bucket" in stored.columns


@pytest.mark.parametrize("tables", ["p2_found", "p2_kept"])
def test_the_queries_run_on_the_small_tables(spark, tables):
    from palimpsest.plans import catalog

    assert catalog.queries()[tables](spark, "/root/testdata/sf0.001").count() > 0
