"""Text expressions: keys, previews, summaries, fields of markdown, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no topics.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "shall", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "about", "like", "through",
    "after", "over", "between", "out", "up", "down", "off", "then", "than", "too", "very", "just", "also", "not", "no", "but", "or", "and", "if",
    "so", "yet", "both", "this", "that", "these", "those", "it", "its", "i", "you", "we", "they", "he", "she", "me", "my", "your", "our", "their",
    "him", "her", "us", "them", "what", "which", "who", "when", "where", "how", "why", "all", "each", "every", "some", "any", "most", "other", "new",
    "old", "first", "last", "next", "now", "here", "there", "only", "one", "two", "get", "got", "make", "made", "let", "let's", "use", "need", "want",
    "know", "think", "see", "look", "find", "give", "tell", "say", "said", "go", "going", "come", "take", "thing", "things", "way", "work", "right",
    "good", "yeah", "yes", "okay", "ok", "sure", "well", "don't", "doesn't", "didn't", "can't", "won't", "isn't", "aren't", "wasn't", "file", "code",
    "run", "set", "add", "put", "try",
)

# Phrases that mark decisions, action items and projects, in order of priority.
DECISION_MARKERS = (
    "decided to", "decision:", "we'll go with", "going with", "let's use", "chose to", "choosing", "settled on", "agreed on", "switched to",
    "instead of", "rather than", "the approach is", "plan is to",
)
ACTION_MARKERS = (
    "todo:", "todo -", "action item:", "next step:", "need to", "needs to", "should be", "will need", "follow up", "follow-up", "remaining:",
    "still need", "don't forget", "remember to", "make sure to",
)
PROJECT_MARKERS = ("project:", "repo:", "repository:", "working on", "in the")


def quoted(text: str) -> str:
    """A literal inside a regular expression that both Java and RE2 read."""
    return "".join(c if c.isalnum() or c in " _'" or ord(c) > 127 else "\\" + c for c in text)


def strip(c: Column) -> Column:
    """Without white space at both ends (any Unicode white space)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_key(title: Column) -> Column:
    """Lower case, letters and digits and single blanks only."""
    kept = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "-"), r"^-+|-+$", "")


def strip_channel_prefix(text: Column) -> Column:
    """Without a leading bracketed channel and a `User message:` label."""
    s = strip(text)
    bracket = F.when(s.rlike(r"(?s)^\[.*?\]\n"), strip(F.regexp_replace(s, r"(?s)^\[.*?\]\n", ""))).when(
        s.rlike(r"(?s)^\[.*?\] "), strip(F.regexp_replace(s, r"(?s)^\[.*?\] ", ""))
    )
    s = F.coalesce(bracket, s)
    s = F.regexp_replace(s, r"^User message: ", "")
    return F.when(s.startswith("User message:"), strip(F.substring(s, 14, 2_000_000_000))).otherwise(s)


def preview(text: Column, chars: int = 200) -> Column:
    """The first characters, with dots if any were cut."""
    head = F.substring(text, 1, chars)
    return F.when(F.length(text) > chars, F.concat(head, F.lit("..."))).otherwise(head)


def episode_abstract(chunk: Column) -> Column:
    head = strip(F.substring(chunk, 1, 200))
    return F.when(F.length(chunk) > 200, F.concat(head, F.lit("..."))).otherwise(head)


def cut_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within `most` bytes of UTF-8."""
    # The length in bytes grows with that in characters: the last that fits, bit by bit.
    guess = F.aggregate(
        F.array(*(F.lit(1 << b) for b in range(most.bit_length(), -1, -1))),
        F.lit(0),
        lambda n, step: F.when(F.octet_length(F.substring(text, F.lit(1), n + step)) <= most, n + step).otherwise(n),
    )
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(text, F.lit(1), guess))


def truncate(text: Column, most: int) -> Column:
    """Cut at `most` bytes, with a note of the whole length if anything was cut."""
    note = F.format_string("...\n\n[truncated, %d chars total]", F.octet_length(text))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut_bytes(text, most), note))


def occurrences(text: Column, needle: str) -> Column:
    """How often the needle occurs, without overlaps."""
    if not needle:
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def highlight(text: Column, needle: str, before: str = "\x1b[33m\x1b[1m", after: str = "\x1b[0m") -> Column:
    return F.regexp_replace(text, f"(?i)({quoted(needle)})", f"{before}$1{after}") if needle else text


def field(body: Column, name: str) -> Column:
    """Value of the first non-empty `**name**: value` line; null if there is none."""
    value = F.regexp_extract(body, rf"(?m)^[ \t]*\*\*{quoted(name)}\*\*:[ \t]*(\S[^\n]*?)[ \t\r]*$", 1)
    return F.when(value != "", value)


def connected_to(body: Column) -> Column:
    """The references listed after `connected to:`, in order."""
    lists = F.regexp_extract_all(body, F.lit(r"(?i)connected to:([^\n]*)"), F.lit(1))
    # As in **Connected to**: the stars that close the label belong to it.
    parts = F.flatten(F.transform(lists, lambda x: F.split(x, ",")))
    cleaned = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.trim(p), r"^(and )+", "")))
    return F.filter(cleaned, lambda p: p != "")


def heading_date(title: Column) -> Column:
    date = F.regexp_extract(title, r"\((\d{4}-\d{2}-\d{2})\)\s*$", 1)
    return F.when(date != "", date)


def without_heading_date(title: Column) -> Column:
    return F.when(heading_date(title).isNull(), title).otherwise(F.trim(F.regexp_replace(title, r"\(\d{4}-\d{2}-\d{2}\)\s*$", "")))


_DATED = r"^(\d{4}-\d{2}-\d{2})(?:\s*\([^)]*\))?\s*[—–-]\s*"


def reflection_date(title: Column) -> Column:
    date = F.regexp_extract(title, _DATED, 1)
    return F.when(date != "", date)


def without_reflection_date(title: Column) -> Column:
    return F.when(reflection_date(title).isNull(), title).otherwise(F.trim(F.regexp_replace(title, _DATED, "")))


def thought_title(title: Column) -> Column:
    """Without strike-through marks and everything from an arrow on."""
    return F.trim(F.regexp_replace(F.replace(title, F.lit("~~"), F.lit("")), r"→.*$", ""))


def duration(start: Column, end: Column) -> Column:
    """Length between two ISO times on a calendar of 365-day years and 30-day
    months: `< 1m`, `45m`, `2h`, `2h05m`; `unknown` if one is unreadable."""

    def seconds(ts: Column) -> Column:
        pattern = r"^(\d+)-(\d+)-(\d+)T(\d+):(\d+):(\d+)(?:\.[^Z+]*)?Z*(?:\+00:00)*$"
        n = lambda i: F.regexp_extract(ts, pattern, i).try_cast("long")
        return (n(1) * 365 + n(2) * 30 + n(3)) * 86400 + n(4) * 3600 + n(5) * 60 + n(6)

    diff = F.abs(seconds(end) - seconds(start))
    hours, minutes = F.floor(diff / 3600), F.floor(F.pmod(diff, F.lit(3600)) / 60)
    return (
        F.when(diff.isNull(), "unknown")
        .when(diff < 60, "< 1m")
        .when(diff < 3600, F.concat(minutes.cast("string"), F.lit("m")))
        .when(minutes == 0, F.concat(hours.cast("string"), F.lit("h")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h"), F.lpad(minutes.cast("string"), 2, "0"), F.lit("m")))
    )


def format_bytes(n: Column) -> Column:
    mega, kilo = 1024.0 * 1024.0, 1024.0
    return (
        F.when(n >= int(mega), F.format_string("%.1f MB", n / mega))
        .when(n >= int(kilo), F.format_string("%.1f KB", n / kilo))
        .otherwise(F.format_string("%d B", n))
    )


def format_tokens(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000.0))
        .when(n >= 1_000, F.concat(F.bround(n / 1_000.0).cast("long").cast("string"), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def memory_bar(count: Column, most: int, width: int = 10) -> Column:
    """How full the curated file is, in blocks."""
    full = F.least(F.lit(width), F.floor(count * width / most)).cast("int") if most else F.lit(0)
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def memory_word(count: Column, most: int) -> Column:
    return F.when(count > most * 90 // 100, "full").when(count > most * 75 // 100, "warning").otherwise("ok")


def format_age(seconds: Column) -> Column:
    """`just now`, minutes, hours or days ago."""
    ago = lambda n, unit: F.format_string(f"%d{unit} ago", F.floor(seconds / n))
    return F.when(seconds < 60, "just now").when(seconds < 3600, ago(60, "m")).when(seconds < 86_400, ago(3600, "h")).otherwise(ago(86_400, "d"))


def progress_bar(percent: Column, width: int = 20) -> Column:
    full = F.least(F.lit(width), F.floor(percent * width / 100)).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def chunks(text: Column, tokens: int = 500) -> Column:
    """Segments between `---` lines packed greedily up to tokens * 4 bytes; a longer
    segment stays whole; pieces are trimmed; a blank text has none."""
    most = tokens * 4
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("open"))

    def step(acc: Column, seg: Column) -> Column:
        full = (acc["open"] != "") & (F.octet_length(acc["open"]) + F.octet_length(seg) > most)
        done = F.when(full, F.array_append(acc["done"], strip(acc["open"]))).otherwise(acc["done"])
        rest = F.when(full | (acc["open"] == ""), seg).otherwise(F.concat(acc["open"], F.lit("\n---\n"), seg))
        return F.struct(done.alias("done"), rest.alias("open"))

    def finish(acc: Column) -> Column:
        return F.when(strip(acc["open"]) != "", F.array_append(acc["done"], strip(acc["open"]))).otherwise(acc["done"])

    return F.when(strip(text) == "", empty).otherwise(F.aggregate(F.split(text, "\n---\n"), start, step, finish))


def marked_sentences(text: Column, markers: tuple[str, ...], whole: bool, least: int, most: int = 200) -> Column:
    """For each marker its first place in the text: the sentence around it
    (`whole`) or from it on; those of least..most bytes, in order of the markers."""
    found = []
    for m in markers:
        at = F.locate(m, F.lower(text))
        after = at + len(m)
        tail = F.substring(text, after, F.lit(2_000_000_000))
        stop = F.regexp_instr(tail, F.lit(r"[.\n]"))
        end = F.when(stop > 0, after + stop).otherwise(F.least(F.length(text) + 1, after + 100))
        head = F.substring(text, F.lit(1), at - 1)
        begin = F.when(head.rlike(r"[.\n]"), F.length(F.regexp_extract(head, r"(?s)^(.*[.\n])", 1)) + 1).otherwise(at) if whole else at
        sentence = strip(F.substring(text, begin, end - begin))
        found.append(F.when((at > 0) & F.octet_length(sentence).between(least, most), sentence))
    return F.array_compact(F.array(*found))


def decisions(text: Column) -> Column:
    return marked_sentences(text, DECISION_MARKERS, True, 10)


def action_items(text: Column) -> Column:
    return marked_sentences(text, ACTION_MARKERS, False, 5)


def project(text: Column) -> Column:
    """The word after the first project marker, by priority of the markers."""
    options = []
    for m in PROJECT_MARKERS:
        word = F.regexp_extract(F.substring(text, F.locate(m, F.lower(text)) + len(m), F.lit(2_000_000_000)), r"(?U)^\s*([\p{L}\p{N}_-]+)", 1)
        options.append(F.when((F.locate(m, F.lower(text)) > 0) & (F.octet_length(word) >= 2), word))
    return F.coalesce(*options)


def parse_datetime(value: Column) -> Column:
    """A time written as RFC 3339 or as a local `YYYY-mm-ddTHH:MM:SS[.f]`; else null."""
    iso = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?"
    zoned = F.when(value.rlike(iso + r"(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(value))
    return F.coalesce(zoned, F.when(value.rlike(iso + "$"), F.try_to_timestamp(F.concat(value, F.lit("Z")))))


def words(text: Column) -> Column:
    """Topic words: lower case, letters, digits, - and _, of 3 bytes or more, no stop words."""
    cleaned = F.transform(F.split(strip(text), r"(?U)\s+"), lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}_-]", ""))
    return F.filter(cleaned, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*STOP_WORDS))


def strip_fencing(text: Column) -> Column:
    """Without a surrounding ``` fence and its language label."""
    s = F.trim(text)
    s = F.regexp_replace(s, r"^```(?:json)?[ \t]*\n?", "")
    return F.trim(F.regexp_replace(s, r"\n?```[ \t]*$", ""))
