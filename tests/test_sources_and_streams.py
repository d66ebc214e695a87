import json
import os
import tomllib

import pytest

from palimpsest.operators import conversation, feedback
from palimpsest.schema import ENTITY
from palimpsest.session import cleanup, materialize, scratch
from palimpsest.sources import config, files
from palimpsest.sources.snapshots import Store
from palimpsest.streaming import streams
from pyspark.sql import functions as F


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_transcripts_and_archives(spark, tmp_path):
    lines = [json.dumps({"type": "user", "timestamp": "t", "uuid": "1", "message": {"role": "user", "content": "hi"}}), "garbage {", "",
             json.dumps({"type": "assistant", "uuid": "2", "parentUuid": "1", "message": {"role": "assistant", "content": [{"type": "text", "text": "yo"}]}})]
    write(f"{tmp_path}/t/deep/sess.jsonl", "\n".join(lines))
    rows = files.transcripts(spark, f"{tmp_path}/t")
    got = conversation.entries(rows).orderBy("entry_id").collect()
    assert [(x.session_id, x.kind, x.text) for x in got] == [("sess", "user", "hi"), ("sess", "assistant", "yo")]
    write(f"{tmp_path}/c/conversation-007.md", "a\n")
    write(f"{tmp_path}/c/archive-log-12.md", "b")
    write(f"{tmp_path}/c/other.md", "c")
    arch = files.archives(spark, f"{tmp_path}/c")
    assert sorted(x.log_number for x in arch.collect()) == [7, 12] and files.next_archive_number(arch).first()[0] == 13
    write(f"{tmp_path}/d/THOUGHTS.md", "## Active")
    docs = {x.stage: x.text for x in files.process_documents(spark, f"{tmp_path}/d").collect()}
    assert docs["thoughts"] == "## Active" and docs["praxis"] == "" and len(docs) == 5
    write(f"{tmp_path}/s.json", json.dumps([{"timestamp": "t", "trigger": "x", "signals": {"vocabulary_diversity": 0.5}}]))
    assert files.signals(spark, f"{tmp_path}/s.json").first().vocabulary_diversity == 0.5


def test_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("entity").count() == 0
    row = spark.createDataFrame([tuple({"entity_id": "a", "mutable": True}.get(f.name) for f in ENTITY.fields)], ENTITY)
    assert store.write("entity", row) == 1
    assert store.write("entity", store.read("entity").unionByName(row)) == 2
    assert store.read("entity").count() == 2 and store.read("entity", 1).count() == 1
    os.remove(tmp_path / "store/entity/v000000002/_SUCCESS")
    assert store.read("entity").count() == 1
    store.register()
    assert spark.sql("select count(*) from episode").first()[0] == 0


def test_config():
    c = config.loads('[ephemeral]\nmax_entries = 99\n[graph.scoring]\nhotness = 0.5\n[pipeline]\nauto_sync = "x"')
    assert c.ephemeral.max_entries == 5 and c.graph.weights().hotness == 0.5 and c.graph.similarity == 0.45 and c.pipeline.auto_sync is False
    assert config.loads("not toml =").ephemeral.max_entries == 5 and config.load("/nowhere").llm.model == ""
    config.set_key(c, "llm.model", "m")
    assert tomllib.loads(config.dumps(c))["llm"]["model"] == "m"
    with pytest.raises(KeyError):
        config.set_key(c, "llm.nothing", "m")
    with pytest.raises(ValueError):
        config.set_key(c, "ephemeral.max_entries", "0")


def run(query, name, spark):
    q = query.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streamed_utility_equals_batch(spark, tmp_path):
    rows = [(f"e{k % 3}", ["success", "failed", "partial"][k % 3 - k % 2], k % 4 > 0, k, k) for k in range(40)]
    df = spark.createDataFrame(rows, "entity_id string, outcome string, used boolean, at long, event_id long")
    df.write.parquet(str(tmp_path / "in"))
    got = {x.entity_id: x.utility for x in run(streams.utilities(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "u", spark).collect()}
    starts = spark.createDataFrame([(f"e{i}", 0.5) for i in range(3)], "entity_id string, utility double")
    batch = feedback.utilities(starts, df.select("entity_id", "outcome", "used", F.struct("at", "event_id").alias("at")))
    assert got == pytest.approx({x.entity_id: x.utility for x in batch.collect()})


def test_folded_stream_over_batches_equals_batch(spark, tmp_path):
    rows = [("hot" if k % 3 else "e", ["success", "failed", "partial"][k % 3], k % 4 > 0, k, k) for k in range(60)]
    schema = "entity_id string, outcome string, used boolean, at long, event_id long"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.fold_utilities(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch").distinct().count() == 3
    got = {x.entity_id: (x.u, x.n) for x in out.groupBy("entity_id").agg(F.max_by("utility", "seq").alias("u"), F.max("updates").alias("n")).collect()}
    df = spark.createDataFrame(rows, schema)
    batch = feedback.utilities(df.select("entity_id", F.lit(0.5).alias("utility")).distinct(), df.select("entity_id", "outcome", "used", F.struct("at", "event_id").alias("at")))
    for x in batch.collect():
        assert got[x.entity_id] == pytest.approx((x.utility, x.updates))


def test_streamed_episodes_come_once(spark, tmp_path):
    schema = "session_id string, log_number long, full_content string"
    for rows in ([("s", 1, "one"), ("t", 2, "two\n---\nmore")], [("s", 1, "one again"), ("u", 3, "three")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.ingest_episodes(source, str(tmp_path / "out"), str(tmp_path / "cp"), "2024-01-01 00:00:00").awaitTermination()
    got = sorted((x.log_number, x.content) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "one"), (2, "two\n---\nmore"), (3, "three")]


def test_large_transcripts_are_read_in_blocks_and_in_order(spark, tmp_path):
    lines = [json.dumps({"type": "user", "uuid": f"u{i}", "timestamp": str(i), "message": {"role": "user", "content": f"line {i}"}}) for i in range(400)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.jsonl").write_text("\n".join(lines[:300]) + "\nnot json\n")
    (tmp_path / "two.jsonl").write_text("\r\n".join(lines[300:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        df = files.transcripts(spark, str(tmp_path))
        rows = sorted((x.session_id, x.entry_id, x.entry_uuid) for x in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [u for s, _, u in rows if s == "one"] == [f"u{i}" for i in range(300)] and [u for s, _, u in rows if s == "two"] == [f"u{i}" for i in range(300, 400)]
    assert len({i for _, i, _ in rows}) == 400 and len({i >> 27 for _, i, _ in rows}) > 3


def test_archive_names_and_headers(spark):
    df = spark.createDataFrame([("conversation-007.md", '---\nsession_id: "s"\n---\nx'), ("archive-log-7.md", "no header"), ("conversation-12.md", None), ("other.md", "---\na: b\n---")], "file string, text string")
    got = {x.file: (x.log_number, x.session_id) for x in files.archive_metadata(df).collect()}
    assert got == {"conversation-007.md": (7, "s"), "archive-log-7.md": (7, "unknown"), "conversation-12.md": (12, "unknown"), "other.md": (None, "unknown")}
    found = files.find_archives(df, spark.createDataFrame([(7,), (12,), (13,)], "log_number long"))
    assert {x.log_number: x.file for x in found.collect()} == {7: "conversation-007.md", 12: "conversation-12.md"}


def test_store_is_created_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"))
    assert set(store.create()) == {"entity", "relates_to", "episode", "contributed_to"} and store.create() == []
    assert store.read("entity").count() == 0 and store.versions("episode") == [1]


def test_streamed_once_and_ingest(spark, tmp_path):
    u = "7d793037-a076-4891-a2b5-0f2b1c6b7c11"
    df = spark.createDataFrame([(u, "2024-01-01 00:00:00"), (u.upper(), "2024-01-01 00:00:05"), ("", "2024-01-01 00:00:06")], "sid string, t string").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "d"))
    got = run(streams.once(spark.readStream.schema(df.schema).parquet(str(tmp_path / "d")), "sid", "t", "1 hour"), "o", spark)
    assert got.count() == 1
    rows = spark.createDataFrame([(1, "a", "s", "user", "user", "hi")], "entry_id long, entry_uuid string, session_id string, entry_type string, role string, content string")
    rows.write.parquet(str(tmp_path / "t"))
    q = streams.ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "t")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_streamed_last_sessions_and_reinforcement(spark, tmp_path):
    df = spark.createDataFrame([("o", f"s{k}", k) for k in range(9)], "owner string, session_id string, at long")
    df.write.parquet(str(tmp_path / "l"))
    got = run(streams.last_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "l")), 3), "l", spark)
    assert sorted(x.session_id for x in got.collect()) == ["s6", "s7", "s8"]
    obs = spark.createDataFrame([("r", 0.6, k, True) for k in range(2)], "rel_id string, prior double, seq long, corroborates boolean")
    obs.write.parquet(str(tmp_path / "r"))
    value = run(streams.reinforcement(spark.readStream.schema(obs.schema).parquet(str(tmp_path / "r"))), "r", spark).first().confidence
    assert value == pytest.approx(((0.6 * 10 + 1) / 11 * 10 + 1) / 11)


def test_gap_sessions(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 03:00:00")], "u int, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(x.events for x in streams.gap_sessions(df, "u", "t").collect()) == [1, 2]


def test_written_tables_can_be_removed(spark):
    df = materialize(spark.range(5), "x")
    assert df.count() == 5 and cleanup(spark) >= 1 and cleanup(spark) == 0
    kept = materialize(spark.range(3), "kept")
    with scratch(spark):
        inner = materialize(spark.range(4), "inner")
        assert inner.count() == 4
    assert kept.count() == 3 and not os.path.exists(inner.inputFiles()[0].removeprefix("file://")) and cleanup(spark) == 1
