"""Rebuilding ordered conversations from message rows.

Plan: reduce every row to a few fixed-width columns (no text is shuffled),
deduplicate by entry id, range-partition by (session, instant, entry) so that a
session is contiguous and a hot one spans many partitions, and run a finite-state
automaton over each stretch.  A stretch is summarised by where it leads from each
state; summaries of one session are composed in order, so no session ever has to
fit into one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

BLOCKS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))

# Automaton over all turns of a session in order.  Symbols: a turn without text, a user's
# and an assistant's turn with text, and a faulty one (unreadable time, conflicting
# speakers, damaged content, unknown parent).
BLANK, USER, ASSISTANT, FAULT = range(4)
EMPTY, OPENED, ASKED, ANSWERED, BROKEN = range(5)  # OPENED: an assistant, no user yet
STEP = (
    (EMPTY, OPENED, ASKED, ANSWERED, BROKEN),
    (ASKED, ASKED, BROKEN, ASKED, BROKEN),
    (OPENED, OPENED, ANSWERED, ANSWERED, BROKEN),
    (BROKEN,) * 5,
)
ACCEPTING = (ANSWERED,)  # both have spoken, and the last user was answered


def speaker_of(text: Column) -> Column:
    """1 for the user, 2 for the assistant, else 0; case and outer blanks do not matter."""
    bare = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.when(bare.isin("user", "human"), 1).when(bare.isin("assistant", "model"), 2).otherwise(0)


def turn_kind(text: Column) -> Column:
    """1 for entry type user, 2 for assistant, else 0 (no turn)."""
    bare = F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    return F.when(bare == "user", 1).when(bare == "assistant", 2).otherwise(0)


def instant_micros(text: Column) -> Column:
    """Microseconds since 1970 of ISO 8601 (T or a blank, fraction and offset
    optional, no offset means UTC) or of epoch milliseconds; null for all else.
    Independent of the session's time zone."""
    iso = r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d(?::\d\d)?)(?:[.,](\d{1,9}))?(?:Z|([+-])(\d\d):?(\d\d)?)?$"
    part = lambda i: F.regexp_extract(text, iso, i)
    local = F.concat_ws(" ", part(1), F.when(F.length(part(2)) == 5, F.concat(part(2), F.lit(":00"))).otherwise(part(2)))
    fraction = F.rpad(F.substring(part(3), 1, 6), 6, "0").try_cast("long")
    number = lambda i: F.coalesce(part(i).try_cast("long"), F.lit(0))
    offset = (number(5) * 3600 + number(6) * 60) * F.when(part(4) == "-", -1).otherwise(1)
    seconds = F.datediff(local.try_cast("timestamp_ntz").cast("date"), F.lit("1970-01-01").cast("date")) * F.lit(86400).cast("long")
    clock = F.split(F.substring(local, 12, 8), ":")
    seconds = seconds + clock[0].try_cast("long") * 3600 + clock[1].try_cast("long") * 60 + clock[2].try_cast("long")
    micros = (seconds - offset) * 1_000_000 + F.coalesce(fraction, F.lit(0))
    valid = local.try_cast("timestamp_ntz").isNotNull() & (number(5) < 24) & (number(6) < 60)
    return F.when(text.rlike(iso), F.when(valid, micros)).when(text.rlike(r"^-?\d{1,15}$"), text.try_cast("long") * 1000)


def content_blocks(content: Column) -> Column:
    """The blocks of a content that is a complete JSON list, else null."""
    looks = content.rlike(r"(?s)^\s*\[\s*(\{.*)?\]\s*$")
    return F.when(looks, F.from_json(content, BLOCKS))


def spoken_text(content: Column) -> Column:
    """Plain text of a turn: the content itself, or its non-blank text blocks
    joined by an empty line; null if there is none."""
    blocks = content_blocks(content)
    texts = F.transform(
        F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].rlike(r"(?U)\S")), lambda b: b["text"]
    )
    plain = F.when(content.rlike(r"(?U)\S"), content)
    return F.when(blocks.isNull(), plain).otherwise(F.when(F.size(texts) > 0, F.array_join(texts, "\n\n")))


def is_damaged(content: Column) -> Column:
    """The content starts like a block list but is no complete JSON."""
    return F.coalesce(content.startswith('[{"type"') & content_blocks(content).isNull(), F.lit(False))


def slim_entries(entries: DataFrame) -> DataFrame:
    """One row of fixed-width columns per entry; rows without a session are left out.

    Rows with equal entry_uuid are one entry (the smallest entry_id stands for
    it); a null entry_uuid makes a row an entry of its own.  Identifiers become
    two 64-bit hashes, a parent, which is looked for within its session only, one.
    """
    pair = lambda c: (F.xxhash64(c), F.xxhash64(F.lit("second"), c))
    own = F.coalesce(F.col("entry_uuid"), F.concat(F.lit("row:"), F.col("entry_id").cast("string")))
    kind, role = turn_kind(F.col("entry_type")), speaker_of(F.col("role"))
    instant = instant_micros(F.col("entry_timestamp"))
    text = spoken_text(F.col("content"))
    slim = (
        entries.where("session_id is not null")
        .select(
            "session_id",
            *(c.alias(a) for c, a in zip(pair(own), ("u1", "u2"))),
            F.when(F.col("parent_uuid").isNotNull(), F.xxhash64("parent_uuid")).alias("parent"),
            F.col("entry_id").cast("long").alias("entry_id"),
            kind.cast("tinyint").alias("kind"),
            instant.alias("instant"),
            ((kind > 0) & text.isNotNull()).alias("has_text"),
            (
                (kind > 0)
                & (instant.isNull() | is_damaged(F.col("content")) | ((role > 0) & (role != kind)))
            ).alias("broken"),
        )
    )
    return slim.groupBy("session_id", "u1", "u2").agg(
        F.min("entry_id").alias("entry_id"),
        F.min("parent").alias("parent"),
        F.max("kind").alias("kind"),
        F.min("instant").alias("instant"),
        F.max("has_text").alias("has_text"),
        F.max("broken").alias("broken"),
    )


def run_automaton(symbols: list[int], state: int = EMPTY) -> int:
    for s in symbols:
        state = STEP[s][state]
    return state


def _stretches(batches):
    """Where each stretch of a session leads from each state.  Rows arrive sorted
    by (session, instant, entry); `piece` orders the stretches of this task."""
    current, leads, piece = None, None, 0
    part = None
    for pdf in batches:
        out = []
        for session, symbol, part in zip(pdf["session_id"], pdf["symbol"], pdf["part"]):
            if session != current:
                if current is not None:
                    out.append((current, part, piece, leads))
                    piece += 1
                current, leads = session, [EMPTY, OPENED, ASKED, ANSWERED, BROKEN]
            if symbol:
                step = STEP[symbol]
                leads = [step[s] for s in leads]
        yield pd.DataFrame(out, columns=["session_id", "part", "piece", "leads"])
    if current is not None:
        yield pd.DataFrame([(current, part, piece, leads)], columns=["session_id", "part", "piece", "leads"])


def session_verdicts(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slim entries, one row (session_id, dropped) per session).

    A session is dropped if the automaton does not accept it: it has no user or no
    assistant turn with text, a faulty turn (unreadable time, conflicting speakers,
    damaged content, a parent unknown in the session), or a user turn with text that
    no assistant turn with text answers before the next one or the end.
    """
    slim = materialize(slim_entries(entries), "entries")
    known = slim.select("session_id", F.col("u1").alias("parent"))
    orphans = slim.where("kind > 0 and parent is not null").select("session_id", "parent").join(known, ["session_id", "parent"], "left_anti")
    symbol = lambda rows, s: rows.select("session_id", F.lit(None).cast("long").alias("instant"), F.lit(None).cast("long").alias("entry_id"), F.lit(s).alias("symbol"))
    # One symbol of each session, so that the automaton decides about those without any turn too.
    extra = materialize(symbol(orphans.select("session_id"), FAULT).unionByName(symbol(slim.select("session_id").distinct(), BLANK)), "extra")
    read = F.when(F.col("broken"), FAULT).when(~F.col("has_text"), BLANK).when(F.col("kind") == 1, USER).otherwise(ASSISTANT)
    ordered = (
        slim.where("kind > 0").select("session_id", "instant", "entry_id", read.alias("symbol")).unionByName(extra)
        .repartitionByRange("session_id", "instant", "entry_id")
        .sortWithinPartitions("session_id", "instant", "entry_id")
        .select("session_id", F.col("symbol").cast("byte").alias("symbol"), F.spark_partition_id().alias("part"))
    )
    stretches = ordered.mapInPandas(_stretches, "session_id string, part int, piece int, leads array<int>")
    # A session has one stretch per partition it reaches into: a short list.
    verdicts = stretches.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("part", "piece", "leads"))).alias("all")).select(
        "session_id",
        (~F.aggregate("all", F.lit(EMPTY), lambda s, x: F.element_at(x["leads"], s + 1)).isin(*ACCEPTING)).alias("dropped"),
    )
    return slim, verdicts


def broken_sessions(entries: DataFrame) -> DataFrame:
    """session_id of every session to drop."""
    return session_verdicts(entries)[1].where("dropped").select("session_id")


def _numbered(batches):
    current, n = None, 0
    for pdf in batches:
        local = []
        for session in pdf["session_id"]:
            n = n + 1 if session == current else 1
            current = session
            local.append(n)
        yield pdf.assign(local=local)


def rebuild(entries: DataFrame) -> DataFrame:
    """(session_id, turn_no, speaker, entry_id, said_at_micros, content) of the
    sessions kept, turn_no counting the turns with text from 1 in order of time.

    Ordering is by (instant, entry_id).  Numbers run through a hot session by
    adding the counts of its earlier partitions, never by one window over it.
    Nulls: an entry without session is left out; empty input gives no rows.
    """
    slim, verdicts = session_verdicts(entries)
    kept = slim.where("kind > 0 and has_text").join(verdicts.where("not dropped").select("session_id"), "session_id", "left_semi")
    ranged = materialize(
        kept.select("session_id", "instant", "entry_id", "kind")
        .repartitionByRange("session_id", "instant", "entry_id")
        .sortWithinPartitions("session_id", "instant", "entry_id")
        .select("session_id", "instant", "entry_id", "kind", F.spark_partition_id().alias("part"))
        .mapInPandas(_numbered, "session_id string, instant long, entry_id long, kind byte, part int, local long"),
        "turns",
    )
    # One row per (session, partition): small even for the hottest session.
    spans = ranged.groupBy("session_id", "part").agg(F.max("local").alias("n"))
    before = Window.partitionBy("session_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select("session_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = ranged.join(offsets, ["session_id", "part"])
    texts = entries.select(F.col("entry_id").cast("long").alias("entry_id"), spoken_text(F.col("content")).alias("content"))
    return numbered.join(texts, "entry_id").select(
        "session_id",
        (F.col("local") + F.col("offset")).alias("turn_no"),
        F.when(F.col("kind") == 1, "user").otherwise("assistant").alias("speaker"),
        "entry_id",
        F.col("instant").alias("said_at_micros"),
        "content",
    )
