"""Readers of transcripts, archives, process documents, signals and hook messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import positions

DOCUMENT_NAMES = ("learning", "thoughts", "curiosity", "reflections", "praxis")
SIGNALS_DDL = (
    "timestamp string, trigger string, signals struct<vocabulary_diversity:double,question_generation:double,thought_lifecycle:double,"
    "evidence_grounding:double>"
)
OUTCOMES_DDL = (
    "task_id string, timestamp string, domain string, task_type string, description string, outcome string, tokens_used long, tool_rounds long"
)
_LINE = "type string, timestamp string, uuid string, parentUuid string, message struct<role:string,content:string>"


_ROW_BITS = 27  # of an entry's number: its row among those of the task that read it


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Rows as in transcript_entry of all `*.jsonl` files under a folder.

    One row per line that is JSON; others are skipped.  A content that is a list
    stays the JSON text of that list.  The session is the file's name.  Files are read
    by lines, large ones in blocks by several tasks; entry_id is the number of the block,
    in order of file and place, and the row within it."""
    at = lambda c: F.col(f"_metadata.{c}")
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path).select(
        "value", at("file_name").alias("file_name"), F.concat_ws(" ", at("file_path"), F.lpad(at("file_block_start").cast("string"), 20, "0")).alias("block"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"),
    )
    numbers = positions(raw.select("block").distinct(), "block", "transcripts").select("block", "pos")
    number = F.when(F.col("row") < 1 << _ROW_BITS, F.col("pos") * (1 << _ROW_BITS) + F.col("row"))
    lines = raw.where(F.trim("value") != "").join(numbers, "block").withColumn(
        "entry_id", F.coalesce(number, F.raise_error(F.lit("too many lines in one task; lower spark.sql.files.maxPartitionBytes")).cast("long"))
    )
    parsed = lines.withColumn("j", F.from_json("value", _LINE)).where(F.try_parse_json("value").isNotNull() & F.col("j").isNotNull())
    return parsed.select(
        F.col("entry_id").cast("long").alias("entry_id"), F.col("j.uuid").alias("entry_uuid"), F.col("j.parentUuid").alias("parent_uuid"),
        F.regexp_extract("file_name", r"^(.*)\.jsonl$", 1).alias("session_id"), F.col("j.type").alias("entry_type"), F.col("j.timestamp").alias("entry_timestamp"),
        F.col("j.message.role").alias("role"), F.col("j.message.content").alias("content"),
    )


def archive_metadata(rows: DataFrame) -> DataFrame:
    """(file, log_number, session_id) of archives (file, text): the number from the name,
    the session from the header, `unknown` without one."""
    number = F.regexp_extract("file", r"^(?:conversation-|archive-log-)(\d+)\.md$", 1)
    header = F.regexp_extract("text", r"(?s)^---(.*?)---", 1)
    found = F.regexp_extract_all(header, F.lit(r"(?m)^[ \t]*session_id:[ \t]*([^\r\n]*)"), F.lit(1))
    session = F.regexp_replace(F.trim(F.element_at(found, -1)), r'^"+|"+$', "")
    return rows.select("file", number.try_cast("long").alias("log_number"), F.when(F.size(found) > 0, session).otherwise("unknown").alias("session_id"))


def find_archives(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """(log_number, file) of the numbers asked for: of the four names an archive may have
    the first that is there (either prefix, first with the number in three digits)."""
    options = F.array(
        *(F.struct(F.lit(i).alias("rank"), F.format_string(p, "log_number").alias("file")) for i, p in enumerate(
            ("conversation-%03d.md", "conversation-%d.md", "archive-log-%03d.md", "archive-log-%d.md")
        ))
    )
    wanted = numbers.select("log_number", F.explode(options).alias("o")).select("log_number", "o.rank", "o.file")
    return wanted.join(rows.select("file"), "file", "left_semi").groupBy("log_number").agg(F.min_by("file", "rank").alias("file"))


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, log_number, text, bytes, modified) of a folder's `conversation-*.md`; the
    number comes from the name, whichever of the two prefixes it has."""
    raw = spark.read.option("pathGlobFilter", "{conversation-,archive-log-}*.md").text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    return raw.select(
        name.alias("file"), F.regexp_extract(name, r"^(?:conversation-|archive-log-)0*(\d+)\.md$", 1).try_cast("long").alias("log_number"),
        F.col("value").alias("text"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("modified"),
    )


def next_archive_number(archives: DataFrame) -> DataFrame:
    return archives.agg((F.coalesce(F.max("log_number"), F.lit(0)) + 1).alias("next_number"))


def process_documents(spark: SparkSession, path: str) -> DataFrame:
    """(stage, text) of the five process documents; a missing one is empty."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    stage = F.regexp_extract(F.lower("_metadata.file_name"), r"^(.*)\.md$", 1)
    found = raw.select(stage.alias("stage"), F.col("value").alias("text"))
    names = spark.createDataFrame([(n,) for n in DOCUMENT_NAMES], "stage string")
    return names.join(found, "stage", "left").select("stage", F.coalesce("text", F.lit("")).alias("text"))


def signals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIGNALS_DDL).json(path, multiLine=True).select("timestamp", "trigger", "signals.*")


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUTCOMES_DDL).json(path, multiLine=True)


def hook_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("session_id string, transcript_path string, cwd string, hook_event_name string").json(path)


def write_archives(rows: DataFrame, path: str) -> None:
    """(file, text) as one text file per row's `file`, below a folder of its name."""
    rows.select("file", F.col("text").alias("value")).write.mode("append").partitionBy("file").text(path)
