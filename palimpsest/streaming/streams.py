"""The event-driven operators as Structured Streaming; each equals its batch form on
the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import jobs
from ..functions import scoring
from ..operators import conversation, feedback
from ..operators.redelivery import canonical_uuid
from ..schema import EPISODE


def once(messages: DataFrame, ident: str, at: str, late: str) -> DataFrame:
    """The first delivery of each UUID within the time deliveries may come late; state of
    older ones is dropped by the watermark."""
    named = messages.withColumn("ident", canonical_uuid(F.col(ident))).where("ident is not null").withColumn(at, F.col(at).cast("timestamp"))
    return named.withWatermark(at, late).dropDuplicatesWithinWatermark(["ident"]).drop("ident")


def ingest(transcripts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Entries of new transcript rows, appended below `target`; a batch that is run again
    after a failure replaces what it had written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        conversation.entries(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return transcripts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(spark, target: str, schema: str, batch_id: int) -> DataFrame:
    """What the batches before this one have written below `target`."""
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(target).where(F.col("batch") < batch_id).drop("batch")
    except AnalysisException:  # the first batch: nothing is there
        return spark.createDataFrame([], schema)


def ingest_episodes(archives: DataFrame, target: str, checkpoint: str, now: str, embed=None) -> StreamingQuery:
    """Episodes of new archives (session_id, log_number, full_content), appended below
    `target`; an archive whose log number has episodes already gives none."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EPISODE.fields)

    def write(batch: DataFrame, batch_id: int) -> None:
        known = _written(batch.sparkSession, target, schema, batch_id)
        todo = batch.join(known.select("log_number").where("log_number is not null").distinct(), "log_number", "left_anti")
        made = jobs.ingest_archives(todo, batch.sparkSession.createDataFrame([], EPISODE), now, embed)
        made.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return archives.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_utilities(steps: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """(entity_id, utility, updates) after each batch of steps, below `target`, the newest
    batch of an entity counting.  The steps of a batch are folded in slices, so an
    entity with a third of them is spread; a batch run again replaces what it wrote."""
    kind = dict(steps.dtypes)["entity_id"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folded = feedback.composed(batch.select("entity_id", "outcome", "used", F.struct("at", "event_id").alias("at")))
        before = _written(spark, target, f"entity_id {kind}, utility double, updates long, seq long", batch_id)
        last = before.groupBy("entity_id").agg(F.max_by("utility", "seq").alias("utility"), F.max_by("updates", "seq").alias("updates"))
        after = folded.join(last, "entity_id", "left").select(
            "entity_id", (F.col("keep") * F.coalesce("utility", F.lit(0.5)) + F.col("add")).alias("utility"), (F.coalesce("updates", F.lit(0)) + F.col("n")).alias("updates"),
            F.lit(batch_id).cast("long").alias("seq"),
        )
        after.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return steps.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _utility(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    value, n = state.get if state.exists else (0.5, 0)
    rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
    for outcome, used in zip(rows["outcome"], rows["used"]):
        rate = scoring.USED_RATE if used else scoring.UNUSED_RATE
        goal = scoring.REWARDS.get(outcome, 0.0) if used else scoring.UNUSED_REWARD
        value = min(1.0, max(0.0, (1.0 - rate) * value + rate * goal))
        n += 1
    state.update((value, n))
    yield pd.DataFrame({"entity_id": [key[0]], "utility": [value], "updates": [n]})


def utilities(steps: DataFrame) -> DataFrame:
    """(entity_id, utility, updates) after each batch of steps (entity_id, outcome, used,
    at, event_id), the running value kept per entity.  An entity's steps of one batch are
    one task's; fold_utilities spreads them."""
    return steps.groupBy("entity_id").applyInPandasWithState(
        _utility, f"entity_id {dict(steps.dtypes)['entity_id']}, utility double, updates long", "value double, n long", "update", "NoTimeout"
    )


def _confidence(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["seq"])
    value = state.get[0] if state.exists else float(rows["prior"].iloc[0])
    for agrees in rows["corroborates"]:
        value = (value * scoring.PSEUDOCOUNT + (1.0 if agrees else 0.0)) / (scoring.PSEUDOCOUNT + 1.0)
    state.update((value,))
    yield pd.DataFrame({"rel_id": [key[0]], "confidence": [value]})


def reinforcement(observations: DataFrame) -> DataFrame:
    """(rel_id, confidence) after each batch of observations (rel_id, prior, seq, corroborates)."""
    return observations.groupBy("rel_id").applyInPandasWithState(
        _confidence, "rel_id string, confidence double", "value double", "update", "NoTimeout"
    )


def _last(n: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids, ats = (list(x) for x in state.get) if state.exists else ([], [])
        for pdf in batches:
            ids += pdf["session_id"].tolist()
            ats += pdf["at"].tolist()
        kept = sorted(zip(ats, ids))[-n:]
        state.update(([i for _, i in kept], [a for a, _ in kept]))
        yield pd.DataFrame({"owner": key[0], "session_id": [i for _, i in kept], "at": [a for a, _ in kept]})

    return run


def last_sessions(sessions: DataFrame, n: int = 5) -> DataFrame:
    """The last n sessions of each owner after each batch of (owner, session_id, at long)."""
    return sessions.groupBy("owner").applyInPandasWithState(
        _last(n), "owner string, session_id string, at long", "ids array<string>, ats array<long>", "update", "NoTimeout"
    )


def gap_sessions(events: DataFrame, user: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, events): stretches of a user's events without a longer gap."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(at, late)
    return timed.groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count("*").alias("events")).select(
        user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events"
    )
