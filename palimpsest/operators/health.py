"""Analyses of curated files and of the archive: sizes, repeats, staleness, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .search import lines_of

LEAST_REPEAT_BYTES = 20
# The wording of suggestions.
LONG_SECTION = 'Section "%s" is %d lines — consider moving details to a topic file'
REPEATS = "Found %d potential duplicate entries — consider merging:"
REPEATED_PAIR = "    Lines %d and %d"
STALE_ENTRIES = "%d entries reference dates >30 days old — review for relevance"
EMPTY_SECTION = 'Section "%s" appears empty — remove it'
CROWDED = "Over %d lines — extract detailed sections into topic files in memory/"


def section_sizes(files: DataFrame, key: str, body: str) -> DataFrame:
    """(file, section_no, section, lines): from each heading of level 1 or 2 to the next."""
    lines = F.split(F.regexp_replace(F.col(body), r"\r?\n\z", ""), r"\r?\n")
    start = F.struct(
        F.array().cast("array<struct<name:string,lines:int>>").alias("done"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("n")
    )

    def step(acc: Column, line: Column) -> Column:
        head = line.rlike("^##? ")
        closed = F.when(
            head & acc["name"].isNotNull(), F.array_append(acc["done"], F.struct(acc["name"].alias("name"), acc["n"].alias("lines")))
        ).otherwise(acc["done"])
        name = F.when(head, F.trim(F.regexp_replace(line, r"^#+", ""))).otherwise(acc["name"])
        return F.struct(closed.alias("done"), name.alias("name"), F.when(head, 1).otherwise(acc["n"] + 1).alias("n"))

    def finish(acc: Column) -> Column:
        return F.when(acc["name"].isNotNull(), F.array_append(acc["done"], F.struct(acc["name"].alias("name"), acc["n"].alias("lines")))).otherwise(acc["done"])

    parts = files.where(F.col(body).isNotNull() & (F.col(body) != "")).select(F.col(key).alias("file"), F.posexplode(F.aggregate(lines, start, step, finish)).alias("i", "s"))
    return parts.where("s.name != ''").select("file", (F.col("i") + 1).alias("section_no"), F.col("s.name").alias("section"), F.col("s.lines").alias("lines"))


def largest_sections(sizes: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("file").orderBy(F.desc("lines"), "section_no")
    return sizes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def empty_sections(files: DataFrame, key: str, body: str) -> DataFrame:
    """(file, line_num, section): `## ` headings with nothing but blanks and comments up
    to the next heading of level 1 or 2."""
    norm = F.concat(F.lit("\n"), F.regexp_replace(F.col(body), r"\r\n", "\n"))
    parts = F.split(norm, r"\n(?=##? )")
    bare = F.transform(
        F.filter(parts, lambda p: p.startswith("## ")),
        lambda p: F.struct(
            F.trim(F.regexp_replace(F.regexp_extract(p, r"^([^\n]*)", 1), r"^#+", "")).alias("section"),
            F.exists(F.slice(F.split(p, "\n"), 2, 2_000_000_000), lambda x: (text.strip(x) != "") & ~x.startswith("<!--")).alias("full"),
        ),
    )
    return files.where(F.col(body).isNotNull()).select(F.col(key).alias("file"), F.posexplode(bare).alias("i", "s")).where(~F.col("s.full")).select(
        "file", (F.col("i") + 1).alias("nth"), F.col("s.section").alias("section")
    )


def repeated_lines(files: DataFrame, key: str, body: str) -> DataFrame:
    """(file, first_line, line_num): lines that repeat an earlier one of their file, with
    case, signs and blanks ignored; short ones (under 20 bytes then) do not count.

    The lines of a file are hashed and sorted within its row; only hashes that stand
    there more than once leave it."""
    lines = F.split(F.regexp_replace(F.col(body), r"\r?\n\z", ""), r"\r?\n")
    norms = F.transform(lines, lambda x, i: F.struct(text.normalize_key(x).alias("norm"), (i + 1).alias("line_num")))
    long = F.filter(norms, lambda x: F.octet_length(x["norm"]) >= LEAST_REPEAT_BYTES)
    hashed = F.transform(long, lambda x: F.struct(F.xxhash64(x["norm"]).alias("h"), F.xxhash64(F.lit("second"), x["norm"]).alias("g"), x["line_num"].alias("line_num")))
    rows = files.where(F.col(body).isNotNull() & (F.col(body) != "")).select(F.col(key).alias("file"), F.array_sort(hashed).alias("s"))
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))
    twice = F.filter("s", lambda x, i: same(x, F.get("s", i - 1)) | same(x, F.get("s", i + 1)))
    again = rows.select("file", F.explode(twice).alias("x")).select("file", "x.*")
    first = again.groupBy("file", "h", "g").agg(F.min("line_num").alias("first_line"))
    return again.join(first, ["file", "h", "g"]).where("line_num != first_line").select("file", "first_line", "line_num")


def months_before(month: Column, now: Column) -> Column:
    """Whole calendar months between two `YYYY-MM`."""
    part = lambda c, i: F.element_at(F.split(c, "-"), i).try_cast("int")
    return (part(now, 1) - part(month, 1)) * 12 + part(now, 2) - part(month, 2)


def stale_lines(files: DataFrame, key: str, body: str, as_of_month: str) -> DataFrame:
    """(file, stale): lines whose first date-like `202x-mm` is more than a month old."""
    found = F.regexp_extract("line", r"^.*?(202.{4})", 1)
    rows = lines_of(files.where(F.col(body).contains("202")), key, body).select("file", found.alias("month")).where(
        F.col("month").rlike(r"^.{4}-") & (F.col("month") < as_of_month)
    )
    old = rows.where(months_before(F.col("month"), F.lit(as_of_month)) > 1)
    return old.groupBy("file").agg(F.count("*").alias("stale"))


def archive_stats(archives: DataFrame, body: str, at: str) -> DataFrame:
    """One row: archives, bytes, first and last time."""
    return archives.agg(
        F.count("*").alias("archives"), F.coalesce(F.sum(F.octet_length(body)), F.lit(0)).alias("bytes"), F.min(at).alias("oldest"), F.max(at).alias("newest")
    )


def memory_health(files: DataFrame, key: str, body: str, most_lines: int = 200, watch: int = 75, alert: int = 90) -> DataFrame:
    """(file, lines, percent, level) of curated files by their share of the line limit."""
    n = F.when(F.coalesce(F.col(body), F.lit("")) == "", 0).otherwise(F.size(F.split(F.regexp_replace(F.col(body), r"\r?\n\z", ""), r"\r?\n")))
    return files.select(F.col(key).alias("file"), n.alias("lines")).select(
        "file", "lines", F.floor(F.col("lines") * 100 / most_lines).cast("int").alias("percent"),
        F.when(F.col("lines") > most_lines * alert // 100, "alert").when(F.col("lines") > most_lines * watch // 100, "watch").otherwise("healthy").alias("level"),
    )


def assess(memory_lines: Column, archives: Column, newest: Column, as_of: Column, most_lines: int = 200) -> Column:
    """Health of the whole store: alert above 90 % of the line limit; watch above 75 %,
    without archives, or if the last is over 7 days old; else healthy."""
    old = newest.isNotNull() & ((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(newest.cast("timestamp"))) > 7 * 86_400_000_000)
    return (
        F.when(memory_lines > most_lines * 90 // 100, "alert")
        .when((memory_lines > most_lines * 75 // 100) | (archives == 0) | old, "watch").otherwise("healthy")
    )


def distilled(files: DataFrame, key: str, body: str, long_section: int = 30) -> DataFrame:
    """(file, target, text): each file with its long `## ` sections replaced by pointers
    (target null), and the sections moved out under their own names."""
    norm = F.concat(F.lit("\n"), F.regexp_replace(F.col(body), r"\r\n", "\n"))
    parts = F.split(norm, r"\n(?=##? )")
    cut = files.where(F.col(body).isNotNull()).select(F.col(key).alias("file"), parts.alias("parts"))
    long = lambda p: p.startswith("## ") & (F.size(F.split(p, "\n")) > long_section)
    title = lambda p: F.trim(F.regexp_replace(F.regexp_extract(p, r"^([^\n]*)", 1), r"^#+", ""))
    target = lambda p: F.concat(text.slug(title(p)), F.lit(".md"))
    pointer = lambda p: F.concat(F.lit("## "), title(p), F.lit("\nSee "), target(p))
    kept = F.array_join(F.transform("parts", lambda p: F.when(long(p), pointer(p)).otherwise(p)), "\n")
    whole = cut.select("file", F.lit(None).cast("string").alias("target"), F.regexp_replace(kept, r"^\n", "").alias("text"))
    moved = cut.select("file", F.explode(F.filter("parts", long)).alias("p")).select("file", target(F.col("p")).alias("target"), F.col("p").alias("text"))
    return whole.unionByName(moved)


def distill(files: DataFrame, key: str, body: str, most_lines: int = 200, share: int = 85, long_section: int = 30) -> DataFrame:
    """(file, section, lines, target): sections to move out of files that fill more than
    `share` percent of the limit, and the file each goes to."""
    full = files.where(F.size(F.split(F.coalesce(F.col(body), F.lit("")), r"\r?\n")) > most_lines * share // 100)
    return section_sizes(full, key, body).where(F.col("lines") > long_section).select(
        "file", "section", "lines", F.concat(text.slug(F.col("section")), F.lit(".md")).alias("target")
    )


def suggestions(files: DataFrame, key: str, body: str, as_of_month: str, least_lines: int = 140, long_section: int = 30, crowded: int = 170) -> DataFrame:
    """(file, rule, nth, suggestion) of curated files of `least_lines` or more: long
    sections, repeated lines (three shown), stale dates, empty sections, extraction."""
    n = F.size(F.split(F.regexp_replace(F.col(body), r"\r?\n\z", ""), r"\r?\n"))
    full = files.where(F.col(body).isNotNull() & (F.col(body) != "") & (n >= least_lines))
    out = section_sizes(full, key, body).where(F.col("lines") > long_section).select(
        "file", F.lit(1).alias("rule"), F.col("section_no").alias("nth"),
        F.format_string(LONG_SECTION, "section", "lines").alias("suggestion"),
    )
    again = repeated_lines(full, key, body)
    w = Window.partitionBy("file").orderBy("line_num")
    shown = again.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= 3)
    out = out.unionByName(
        again.groupBy("file").agg(F.count("*").alias("n")).select(
            "file", F.lit(2).alias("rule"), F.lit(0).alias("nth"), F.format_string(REPEATS, "n").alias("suggestion")
        )
    ).unionByName(shown.select("file", F.lit(2).alias("rule"), "nth", F.format_string(REPEATED_PAIR, "first_line", "line_num").alias("suggestion")))
    out = out.unionByName(
        stale_lines(full, key, body, as_of_month).select(
            "file", F.lit(3).alias("rule"), F.lit(0).alias("nth"), F.format_string(STALE_ENTRIES, "stale").alias("suggestion")
        )
    )
    out = out.unionByName(
        empty_sections(full, key, body).select("file", F.lit(4).alias("rule"), "nth", F.format_string(EMPTY_SECTION, "section").alias("suggestion"))
    )
    over = full.where(n > crowded).select(
        F.col(key).alias("file"), F.lit(5).alias("rule"), F.lit(0).alias("nth"),
        F.format_string(CROWDED, F.lit(crowded)).alias("suggestion"),
    )
    return out.unionByName(over)


def dashboard(memory: DataFrame, key: str, body: str, archives: DataFrame, text_column: str, at: str, sessions: DataFrame, as_of: str, most_lines: int = 200, most_sessions: int = 5) -> DataFrame:
    """(line_no, label, value) of the overview: curated file, sessions, archive, freshness,
    health and the three largest sections.  Each table is read once for its numbers."""
    now = F.lit(as_of).cast("timestamp_ntz")
    lines = memory_health(memory, key, body, most_lines).agg(F.coalesce(F.max("lines"), F.lit(0)).alias("lines"))
    stored = archive_stats(archives, text_column, at)
    kept = sessions.agg(F.count("*").alias("sessions"))
    largest = section_sizes(memory, key, body).orderBy(F.desc("lines"), "file", "section_no").limit(3)
    top = largest.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("lines")).alias("l"), "section_no", "section"))), lambda x: F.format_string("%s (%d lines)", x["section"], -x["l"])), ", ").alias("largest"))
    one = lambda df: df.withColumn("one", F.lit(1))
    row = one(lines).join(one(stored), "one").join(one(kept), "one").join(one(top), "one")
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 1_000_000
    shown = (
        ("memory", F.format_string(f"%d/{most_lines} %s %s", "lines", text.memory_bar(F.col("lines"), most_lines), text.memory_word(F.col("lines"), most_lines))),
        ("sessions", F.format_string(f"%d/{most_sessions} entries", "sessions")),
        ("archive", F.format_string("%d conversations (%s)", "archives", text.format_bytes(F.col("bytes")))),
        ("freshness", F.when(F.col("newest").isNull(), "never").otherwise(text.format_age(F.floor(seconds)))),
        ("health", assess(F.col("lines"), F.col("archives"), F.col("newest"), now, most_lines)),
        ("largest", F.col("largest")),
    )
    entries = F.array(*(F.struct(F.lit(i).alias("line_no"), F.lit(label).alias("label"), value.alias("value")) for i, (label, value) in enumerate(shown, 1)))
    return row.select(F.explode(entries).alias("e")).select("e.*")
