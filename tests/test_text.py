import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import text


def col(spark, f, *values):
    return [x[0] for x in spark.createDataFrame([(v,) for v in values], "s string").select(f(F.col("s"))).collect()]


def test_keys_and_slugs(spark):
    assert col(spark, text.normalize_key, "Idea → Plan  B!", None) == ["idea plan b", None]
    assert col(spark, text.slug, "## My Section!") == ["my-section"]


def test_channel_prefixes(spark):
    got = col(spark, text.strip_channel_prefix, "[chan]\nUser message: hi", "[chan] rest", "User message:  x ", "plain", "[1, 2]")
    assert got == ["hi", "rest", " x", "plain", "[1, 2]"]


@pytest.mark.parametrize(
    "a, b, want",
    [("2026-01-01T10:00:00Z", "2026-01-01T10:45:00Z", "45m"), ("2026-01-01T10:00:00Z", "2026-01-01T12:30:00.5Z", "2h30m"),
     ("2026-01-01T10:00:00Z", "2026-01-01T10:00:30Z", "< 1m"), ("garbage", "2026-01-01T10:00:30Z", "unknown"), ("2026-01-01T10:00:00+00:00", "2026-01-01T12:00:00Z", "2h")],
)
def test_duration(spark, a, b, want):
    assert spark.range(1).select(text.duration(F.lit(a), F.lit(b))).first()[0] == want


def test_cut_bytes_and_truncate(spark):
    samples = ["", "abc", "é" * 30, "a€𝄞z" * 20, "x" * 33]
    for most in (0, 1, 7, 32):
        got = col(spark, lambda c: text.cut_bytes(c, most), *samples)  # noqa: B023
        assert got == [s.encode()[:most].decode("utf-8", "ignore") for s in samples]
    assert col(spark, lambda c: text.truncate(c, 4), "abcdef") == ["abcd...\n\n[truncated, 6 chars total]"]


def chunks(s, tokens):
    if not s.strip():
        return []
    out, cur = [], ""
    for seg in s.split("\n---\n"):
        if cur and len(cur.encode()) + len(seg.encode()) > tokens * 4:
            out.append(cur.strip())
            cur = ""
        cur = cur + "\n---\n" + seg if cur else seg
    return out + ([cur.strip()] if cur.strip() else [])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab é", max_size=30), max_size=8))
def test_chunks(spark, parts):
    s = "\n---\n".join(parts)
    assert col(spark, lambda c: text.chunks(c, 5), s) == [chunks(s, 5)]


def test_markers(spark):
    s = "Intro. We decided to use Rust. Next step: test it\nNeed to rest"
    assert col(spark, text.decisions, s) == [["We decided to use Rust."]]
    assert col(spark, text.action_items, s)[0] == ["Next step: test it", "Need to rest"]
    assert col(spark, text.project, "I am working on tool-x now", "Project: abc in the sea", "nothing") == ["tool-x", "abc", None]


def test_fields_and_references(spark):
    body = "**Source**: the log\nConnected to: A thing, and B thing\nx"
    assert col(spark, lambda c: text.field(c, "Source"), body, "no") == ["the log", None]
    assert col(spark, text.connected_to, body)[0][1] == "B thing"
    assert col(spark, text.thought_title, "~~Old~~ → GRADUATED 2026-01-01") == ["Old"]
    assert col(spark, text.reflection_date, "2026-01-02 — Title", "Title") == ["2026-01-02", None]
    assert col(spark, text.without_heading_date, "Title (2026-01-02)") == ["Title"]


def test_display(spark):
    n = lambda f, v: spark.range(1).select(f(F.lit(v).cast("long"))).first()[0]
    assert [n(text.format_bytes, v) for v in (500, 2048, 5 * 1024 * 1024)] == ["500 B", "2.0 KB", "5.0 MB"]
    assert n(text.format_tokens, 2500) == "2K" and n(text.progress_bar, 50) == "█" * 10 + "░" * 10
    assert col(spark, lambda c: text.occurrences(c, "aa"), "aaaa", "b") == [2, 0]
    assert col(spark, lambda c: text.highlight(c, "a.b", "<", ">"), "xA.By axb") == ["x<A.B>y axb"]
    assert col(spark, text.strip_fencing, "```json\n{}\n```") == ["{}"]
