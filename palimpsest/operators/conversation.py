"""From transcript rows to conversations: entries, topics, summaries, tags, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..session import materialize
from .ordering import numbered, previous, ranged

SKIPPED_TYPES = ("queue-operation", "summary")
BLOCK = T.ArrayType(
    T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("input", T.StringType()),
            T.StructField("content", T.StringType()),
            T.StructField("is_error", T.BooleanType()),
        ]
    )
)


def tool_input(name: Column, raw: Column) -> Column:
    """What a tool call is about, by tool: its path, command or pattern; for others
    the input itself, cut at 200 bytes."""
    get = lambda k: F.get_json_object(raw, f"$.{k}")
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    blank = F.lit("")
    return (
        F.when(raw.isNull(), blank)
        .when(name.isin("Read", "Edit", "Write"), F.coalesce(tick(get("file_path")), blank))
        .when(name == "Bash", F.coalesce(tick(text.truncate(get("command"), 200)), blank))
        .when(name == "Grep", F.concat(tick(F.coalesce(get("pattern"), blank)), F.lit(" in "), tick(F.coalesce(get("path"), blank))))
        .when(name == "Glob", F.coalesce(tick(get("pattern")), blank))
        .otherwise(text.truncate(raw, 200))
    )


def tool_subject(raw: Column) -> Column:
    """The first of a tool input's path, command (80 characters), pattern, query and address."""
    get = lambda k: F.get_json_object(raw, f"$.{k}")
    return F.coalesce(get("file_path"), get("path"), F.substring(get("command"), 1, 80), get("pattern"), get("query"), get("url"), F.lit(""))


def entries(rows: DataFrame, user_blocks: bool = False) -> DataFrame:
    """(session_id, entry_id, pos, kind, text, tool, is_error), a row per message,
    tool call or tool result; kind is user, assistant, tool_use or tool_result.

    Deliveries of one entry_uuid count once.  Operational types, other roles,
    unreadable block lists and thinking are skipped.  Text blocks of the user are
    skipped unless `user_blocks` (the two adapters of transcripts differ in that).
    """
    once = F.coalesce(F.col("entry_uuid"), F.concat(F.lit("row:"), F.col("entry_id").cast("string")))
    lean = rows.where(F.col("session_id").isNotNull() & F.col("content").isNotNull())
    # Only what was delivered again needs a look at the others; texts are not shuffled for it.
    names = lean.select("session_id", F.xxhash64(once).alias("u1"), F.xxhash64(F.lit("second"), once).alias("u2"), "entry_id")
    again = names.groupBy("session_id", "u1", "u2").agg(F.min("entry_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    surplus = names.join(again, ["session_id", "u1", "u2"]).where("entry_id != first").select("entry_id")
    role, kind_of_entry = F.lower(F.trim("role")), F.lower(F.trim("entry_type"))
    lean = lean.where(F.coalesce(~kind_of_entry.isin(*SKIPPED_TYPES), F.lit(True)) & role.isin("user", "assistant"))
    lean = lean.select("session_id", "entry_id", role.alias("role"), "content").join(surplus, "entry_id", "left_anti")
    listed = F.col("content").rlike(r"^\s*\[\s*(\{|\])")
    # A plain text is one block of its own kind, so that all is read in one pass.
    none = F.lit(None).cast("string")
    plain = F.array(F.struct(F.lit("").alias("type"), F.col("content").alias("text"), none.alias("name"), none.alias("input"), none.alias("content"), F.lit(False).alias("is_error")))
    blocks = lean.select("session_id", "entry_id", "role", F.posexplode(F.when(listed, F.from_json("content", BLOCK)).otherwise(plain)).alias("pos", "b"))
    kind = (
        F.when(F.col("b.type") == "", F.when(F.col("b.text").isNotNull(), F.col("role")))
        .when((F.col("role") == "user") & (F.col("b.type") == "tool_result"), "tool_result")
        .when((F.col("role") == "assistant") & (F.col("b.type") == "tool_use"), "tool_use")
        .when((F.col("b.type") == "text") & (F.col("b.text") != "") & ((F.col("role") == "assistant") | F.lit(user_blocks)), F.col("role"))
    )
    name = F.coalesce("b.name", F.lit("unknown"))
    shown = (
        F.when(kind == "tool_result", text.truncate(F.coalesce("b.content", F.lit("")), 2000))
        .when(kind == "tool_use", tool_input(name, F.col("b.input")))
        .otherwise(F.col("b.text"))
    )
    return blocks.select(
        "session_id", "entry_id", "pos", kind.alias("kind"), shown.alias("text"), F.when(kind == "tool_use", name).alias("tool"),
        F.coalesce("b.is_error", F.lit(False)).alias("is_error"),
    ).where("kind is not null")


def stats(items: DataFrame) -> DataFrame:
    """(session_id, users, assistants, tool_uses, tool_results) per session."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return items.groupBy("session_id").agg(
        n("user").alias("users"), n("assistant").alias("assistants"), n("tool_use").alias("tool_uses"), n("tool_result").alias("tool_results")
    )


def spans(rows: DataFrame) -> DataFrame:
    """(session_id, first_ts, last_ts, length): first and last time in file order."""
    seen = rows.where(
        "session_id is not null and entry_timestamp is not null"
    ).where(F.coalesce(~F.lower(F.trim("entry_type")).isin(*SKIPPED_TYPES), F.lit(True)))
    both = seen.groupBy("session_id").agg(
        F.min_by("entry_timestamp", "entry_id").alias("first_ts"), F.max_by("entry_timestamp", "entry_id").alias("last_ts")
    )
    return both.withColumn("length", text.duration(F.col("first_ts"), F.col("last_ts")))


def first_messages(items: DataFrame, n: int = 5) -> DataFrame:
    """The first n user messages of each session; Spark keeps no more than n of a
    session per map task before the shuffle."""
    w = Window.partitionBy("session_id").orderBy("entry_id", "pos")
    return items.where("kind = 'user'").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def topics(items: DataFrame, most: int = 5) -> DataFrame:
    """(session_id, rank, topic, weight): words of the first five user messages count
    1 each, the stem of a tool's target 2, the tool's name 1; ties by word.

    The items are read twice, for messages and for tools: hand over a written table
    if they are dear to compute."""
    spoken = first_messages(items).select("session_id", F.explode(text.words(text.strip_channel_prefix(F.col("text")))).alias("topic"), F.lit(1).alias("w"))
    target = F.lower(F.regexp_replace(F.element_at(F.split("text", "/"), -1), r"^`+|`+$", ""))
    stem = F.element_at(F.split(target, r"\."), 1)
    tool = F.lower("tool")
    marks = F.array(
        F.when((F.octet_length(target) >= 3) & ~target.contains("(") & (stem != ""), F.struct(stem.alias("topic"), F.lit(2).alias("w"))),
        F.when(~tool.isin(*text.STOP_WORDS), F.struct(tool.alias("topic"), F.lit(1).alias("w"))),
    )
    used = items.where("kind = 'tool_use'").select("session_id", F.explode(F.array_compact(marks)).alias("m")).select("session_id", "m.topic", "m.w")
    weights = spoken.unionByName(used).groupBy("session_id", "topic").agg(F.sum("w").alias("weight"))
    w = Window.partitionBy("session_id").orderBy(F.desc("weight"), "topic")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("session_id", "rank", "topic", "weight")


def summary(items: DataFrame) -> DataFrame:
    """(session_id, summary): the first user message that is not empty, 200 characters of it."""
    said = items.where("kind = 'user'").select("session_id", "entry_id", "pos", text.strip_channel_prefix(F.col("text")).alias("said")).where("said != ''")
    # Only the first 201 characters can matter; nothing longer is shuffled.
    first = said.withColumn("said", F.substring("said", 1, 201)).groupBy("session_id").agg(F.min_by("said", F.struct("entry_id", "pos")).alias("said"))
    return items.select("session_id").distinct().join(first, "session_id", "left").select(
        "session_id", F.coalesce(text.preview(F.col("said")), F.lit("Empty session")).alias("summary")
    )


MOST_TAGS = {"decision": 5, "action": 5, "project": 1, "file": 10}


def tags(items: DataFrame) -> DataFrame:
    """(session_id, tag, n, item): decisions and action items (the first 5 different
    ones each), the project, files (10) and tools, the last two sorted.

    One pass: each item gives all its tags, equal ones meet once a task before they
    are shuffled."""
    said = F.col("kind").isin("user", "assistant")
    about = F.regexp_replace("text", r"^`+|`+$", "")
    tag = lambda t, item, i, key: F.struct(F.lit(t).alias("tag"), key.alias("key"), i.cast("int").alias("i"), item.alias("item"))
    listed = lambda t, f: F.transform(f(F.col("text")), lambda x, i: tag(t, x, i, F.lower(x)))
    one = lambda t, item, key: F.filter(F.array(tag(t, item, F.lit(0), key)), lambda x: x["item"].isNotNull())
    project = text.project(F.col("text"))
    of_talk = F.concat(listed("decision", text.decisions), listed("action", text.action_items), one("project", project, F.lit("")))
    path = F.when((about != "") & about.rlike(r"[/.]"), about)
    of_tool = F.concat(one("file", path, path), one("tool", F.col("tool"), F.col("tool")))
    found = items.where(said | (F.col("kind") == "tool_use")).select("session_id", "entry_id", "pos", F.explode(F.when(said, of_talk).otherwise(of_tool)).alias("t"))
    placed = F.col("t.tag").isin("file", "tool")  # sorted by themselves, the others by where they first stand
    at = F.struct(
        F.when(placed, F.lit(0).cast("long")).otherwise(F.col("entry_id")).alias("entry_id"), F.when(placed, 0).otherwise(F.col("pos")).alias("pos"), F.col("t.i").alias("i"), F.col("t.item").alias("item")
    )
    once = found.groupBy("session_id", F.col("t.tag").alias("tag"), F.col("t.key").alias("key")).agg(F.min(at).alias("f"))
    w = Window.partitionBy("session_id", "tag").orderBy("f")
    most = F.coalesce(*(F.when(F.col("tag") == t, F.lit(n)) for t, n in MOST_TAGS.items()))
    return once.withColumn("n", F.row_number().over(w)).where(most.isNull() | (F.col("n") <= most)).select("session_id", "tag", "n", F.col("f.item").alias("item"))


def markdown_lines(items: DataFrame, name: str = "markdown") -> DataFrame:
    """(session_id, entry_id, pos, part): each entry as rendered in an archive.  A role
    heading comes where the speaker differs from the last message; tool entries
    do not count as messages."""
    said = items.where("kind in ('user', 'assistant')")
    before = previous(said.select("session_id", "entry_id", "pos", "kind"), ["session_id"], ["entry_id", "pos"], "kind", "before", name)
    heads = before.where("before is null or before != kind").select("entry_id", "pos", F.lit(True).alias("head"))
    joined = items.join(heads, ["entry_id", "pos"], "left")
    who = F.when(F.col("kind") == "user", "User").otherwise("Assistant")
    part = (
        F.when(F.col("kind") == "tool_use", F.concat(F.lit("> **"), F.col("tool"), F.lit("**: `"), F.col("text"), F.lit("`\n\n")))
        .when(
            F.col("kind") == "tool_result",
            F.concat(
                F.lit("<details><summary>"), F.when(F.col("is_error"), "Error").otherwise("Result"), F.lit("</summary>\n\n```\n"),
                text.truncate(F.col("text"), 2000), F.lit("\n```\n\n</details>\n\n"),
            ),
        )
        .otherwise(F.concat(F.when(F.col("head"), F.concat(F.lit("---\n\n### "), who, F.lit("\n\n"))).otherwise(""), F.col("text"), F.lit("\n\n")))
    )
    return joined.select("session_id", "entry_id", "pos", part.alias("part"))


def condensed(items: DataFrame, per_message: int = 300) -> DataFrame:
    """(session_id, entry_id, pos, line): the lines a summary is made from."""
    cut = F.when(F.length("text") > per_message, F.concat(F.substring("text", 1, per_message), F.lit("…"))).otherwise(F.col("text"))
    line = (
        F.when(F.col("kind") == "user", F.concat(F.lit("User: "), cut))
        .when(F.col("kind") == "assistant", F.concat(F.lit("Assistant: "), cut))
        .when(F.col("kind") == "tool_use", F.concat(F.lit("[Tool: "), F.col("tool"), F.lit(" → "), F.col("text"), F.lit("]")))
    )
    return items.select("session_id", "entry_id", "pos", line.alias("line")).where("line is not null")


def condensed_text(lines: Column, most: int = 4000) -> Column:
    """The joined lines cut at `most` bytes, with a note if anything was cut."""
    return F.when(F.octet_length(lines) > most, F.concat(text.cut_bytes(lines, most), F.lit("\n… (conversation truncated)"))).otherwise(lines)


def archive_index(items: DataFrame, rows: DataFrame, highest: int = 0, name: str = "index") -> DataFrame:
    """(log, date, session_id, topics, messages, length, line): the index row of every
    session with a user message, numbered on from the highest log in order of time."""
    counted = stats(items).where("users > 0").join(spans(rows), "session_id", "left")
    listed = topics(items).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "topic"))).alias("t"))
    rowset = counted.join(listed, "session_id", "left").select(
        "session_id", F.coalesce("first_ts", F.lit("")).alias("at"), F.element_at(F.split(F.coalesce("first_ts", F.lit("")), "T"), 1).alias("date"),
        F.coalesce(F.array_join("t.topic", ", "), F.lit("—")).alias("topics"), (F.col("users") + F.col("assistants")).alias("messages"),
        F.coalesce("length", F.lit("unknown")).alias("length"),
    )
    logged = numbered(materialize(rowset, name), [], ["at", "session_id"], "log", name).withColumn("log", F.col("log") + highest)
    line = F.format_string("| %03d | %s | %s | %s | %d | %s |", "log", "date", "session_id", "topics", "messages", "length")
    return logged.select("log", "date", "session_id", "topics", "messages", "length", line.alias("line"))


# --- archives -------------------------------------------------------------------


def front_matter(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, log, date, session_id, message_count, duration, source, topics) of each
    text that begins with a header; a line without a colon in it, or no log or date,
    makes the header invalid and the row is left out."""
    trimmed = text.strip(F.col(body))
    block = F.regexp_extract(trimmed, r"(?s)^---(.*?)---", 1)
    lines = F.filter(F.transform(F.split(block, r"\r?\n"), text.strip), lambda x: x != "")
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            text.strip(F.substring_index(x, ":", 1)).alias("k"),
            F.regexp_replace(text.strip(F.regexp_replace(x, r"^[^:]*:", "")), r'^"+|"+$', "").alias("v"),
        ),
    )
    value = lambda k: F.element_at(F.filter("pairs", lambda p: p["k"] == k), -1)["v"]  # noqa: E731, ARG005
    get = lambda k: F.when(F.size(F.filter("pairs", lambda p: p["k"] == k)) > 0, value(k))
    topic_list = F.filter(
        F.transform(F.split(F.regexp_replace(get("topics"), r"^[\[\]]+|[\[\]]+$", ""), ","), lambda t: F.regexp_replace(F.trim(t), r'^"+|"+$', "")),
        lambda t: t != "",
    )
    held = files.where(trimmed.rlike(r"(?s)^---.*?---")).select(F.col(key), lines.alias("lines"), pairs.alias("pairs"))
    return (
        held.where(~F.exists("lines", lambda x: ~x.contains(":")))
        .select(
            key, get("log").try_cast("long").alias("log"), get("date").alias("date"), F.coalesce(get("session_id"), F.lit("")).alias("session_id"),
            F.coalesce(get("message_count").try_cast("long"), F.lit(0)).alias("message_count"), F.coalesce(get("duration"), F.lit("")).alias("duration"),
            F.coalesce(get("source"), F.lit("")).alias("source"), F.coalesce(topic_list, F.array().cast("array<string>")).alias("topics"),
        )
        .where("log is not null and date is not null")
    )


def render_front_matter() -> Column:
    """The header of columns named as front_matter names them."""
    quoted = F.transform("topics", lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    return F.concat(
        F.lit("---\nlog: "), F.col("log").cast("string"), F.lit('\ndate: "'), "date", F.lit('"\nsession_id: "'), "session_id", F.lit('"\nmessage_count: '),
        F.col("message_count").cast("string"), F.lit('\nduration: "'), "duration", F.lit('"\nsource: "'), "source", F.lit('"\ntopics: ['),
        F.array_join(quoted, ", "), F.lit("]\n---"),
    )


def unarchived(sessions: DataFrame, archives: DataFrame) -> DataFrame:
    """Sessions no archive names."""
    return sessions.select("session_id").where("session_id is not null").distinct().join(archives.select("session_id"), "session_id", "left_anti")


def episodes(archives: DataFrame, key: str, body: str, tokens: int = 500) -> DataFrame:
    """(key, chunk_no, abstract_text, content): the episodes an archive gives."""
    parts = archives.where(F.col(body).isNotNull()).select(F.col(key), F.posexplode(text.chunks(F.col(body), tokens)).alias("i", "content"))
    return parts.select(key, (F.col("i") + 1).alias("chunk_no"), text.episode_abstract(F.col("content")).alias("abstract_text"), "content")


def token_budget(archives: DataFrame, key: str, cost: Column, most: int, name: str = "budget") -> DataFrame:
    """Archives in order of key as long as the costs before them are below `most`
    (0: no limit).  Sums cross partitions as one number each."""
    priced = archives.select(F.col(key).alias("key"), cost.cast("long").alias("cost"))
    if not most:
        return priced.withColumn("before", F.lit(0).cast("long")).withColumnRenamed("key", key)


    placed = ranged(priced, ["key"], name)
    inside = F.sum("cost").over(Window.partitionBy("__part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    totals = placed.groupBy("__part").agg(F.sum("cost").alias("here"))  # a row per partition
    earlier = F.sum("here").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("__part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    with_sums = placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(offsets), "__part")
    return with_sums.select("key", "cost", (F.col("inside") + F.col("earlier")).alias("before")).where(F.col("before") < most).withColumnRenamed("key", key)


def ephemeral_entries(texts: DataFrame, key: str, body: str) -> DataFrame:
    """(key, entry_no, entry): the sessions of a short-term file, oldest first."""
    parts = F.filter(F.transform(F.split(F.col(body), "\n---\n"), text.strip), lambda x: x != "")
    return texts.where(F.col(body).isNotNull()).select(F.col(key), F.posexplode(parts).alias("i", "entry")).select(key, (F.col("i") + 1).alias("entry_no"), "entry")


def ephemeral_fields(texts: DataFrame, key: str, body: str) -> DataFrame:
    """(key, entry_no, date, duration, messages, summary) of the entries of a short-term
    file: the date after the dash of the first line, the labelled fields, or a number
    of messages in brackets; missing ones are empty, a dash, 0 and empty."""
    first = F.regexp_extract("entry", r"^([^\n]*)", 1)
    dashed = F.trim(F.element_at(F.split(first, "—"), F.when(first.contains("—"), 2).otherwise(1)))
    date = F.when(first.contains("—"), dashed).when(first.contains(" - "), F.trim(F.get(F.split(first, " - "), F.lit(1)))).otherwise("")
    length = F.trim(F.regexp_extract("entry", r"(?m)^[^\n]*\*\*Duration\*\*[^\n~]*~([^|~\n]*)", 1))
    labelled = F.regexp_extract("entry", r"\*\*Messages\*\*:\s*(\d+)", 1).try_cast("int")
    counted = F.regexp_extract("entry", r"\((\d+) messages", 1).try_cast("int")
    told = F.trim(F.regexp_extract("entry", r"\*\*Summary\*\*:([^\n]*)", 1))
    cut = F.when(F.octet_length(told) > 50, F.concat(text.cut_bytes(told, 47), F.lit("..."))).otherwise(told)
    return ephemeral_entries(texts, key, body).select(
        key, "entry_no", date.alias("date"), F.when(length != "", length).otherwise("—").alias("duration"), F.coalesce(labelled, counted, F.lit(0)).alias("messages"), cut.alias("summary")
    )


def ephemeral_window(texts: DataFrame, key: str, body: str, most: int = 5) -> DataFrame:
    """The same file with only its last `most` entries."""
    parts = F.filter(F.transform(F.split(F.col(body), "\n---\n"), text.strip), lambda x: x != "")
    last = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - most + 1), F.lit(most))
    return texts.where(F.col(body).isNotNull()).select(F.col(key), F.size(parts).alias("entries"), F.array_join(last, "\n\n---\n\n").alias("kept"))
