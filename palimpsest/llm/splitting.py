"""Splitting oversized texts at natural boundaries.

Each text is cut into atomic segments with a strength at every boundary between
neighbours.  Adjacent pairs wait in a heap; the weakest boundary is merged first
as long as the merged piece, with the overlap it will start with, stays within
the limit.  Pieces are contiguous stretches of the text, so their bodies joined
give the text back byte for byte.
"""

from __future__ import annotations

import heapq
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame

from ..session import spread

LIMIT, OVERLAP = 4000, 200

# Strengths of boundaries, strongest last.
CHARACTER, WORD, CLAUSE, SENTENCE, CODE_LINE, LINE, PARAGRAPH, SECTION = range(8)

LINE_END = re.compile(r"\r\n|\n|\r| | ")
SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*[^\S\r\n]+(?=\S)|(?<=[。！？])(?=\S)")
CLAUSE_END = re.compile(r"(?<=[,;:])\s+(?=\S)|(?<=[、，；：])")
WORD_END = re.compile(r"\s+(?=\S)")
HEADING = re.compile(r"#{1,6}\s|-{3,}\s*$|={3,}\s*$|\*{3,}\s*$")
FENCE = re.compile(r"\s*(```|~~~)")


def _lines(text: str) -> list[tuple[int, int]]:
    """(start, strength of the boundary before it) of every line."""
    out, start, blank, fenced, first = [], 0, False, False, True
    ends = [m.end() for m in LINE_END.finditer(text)]
    for end in [*ends, len(text)]:
        if end == start:
            continue
        line = text[start:end]
        is_blank = not line.strip()
        if first:
            strength = SECTION
        elif fenced:
            strength = CODE_LINE
        elif HEADING.match(line):
            strength = SECTION
        elif blank and not is_blank:
            strength = PARAGRAPH
        elif is_blank:
            strength = CODE_LINE  # a blank line stays with what it ends
        else:
            strength = LINE
        out.append((start, strength))
        if FENCE.match(line):
            fenced = not fenced
        blank, first, start = is_blank, False, end
    return out


def _finer(text: str, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Cuts within [start, end), whose pieces have at most `most` bytes each."""
    cuts = [start]
    strengths = {}
    for pattern, strength in ((SENTENCE_END, SENTENCE), (CLAUSE_END, CLAUSE), (WORD_END, WORD)):
        fresh = []
        for a, b in zip(cuts, [*cuts[1:], end]):
            if strength != SENTENCE and len(text[a:b].encode()) <= most:
                continue
            for m in pattern.finditer(text, a, b):
                if a < m.end() < b:
                    fresh.append(m.end())
                    strengths[m.end()] = strength
        cuts = sorted({*cuts, *fresh})
    out = []
    for a, b in zip(cuts, [*cuts[1:], end]):
        if a != start:
            out.append((a, strengths[a]))
        if len(text[a:b].encode()) > most:
            size = 0
            for i in range(a, b):
                size += len(text[i].encode())
                if size > most:
                    # do not part a base character from its marks
                    at = i
                    while at > a + 1 and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
                        at -= 1
                    at = at if len(text[at : i + 1].encode()) <= most // 2 else i
                    out.append((at, CHARACTER))
                    size = len(text[at : i + 1].encode())
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces of a text as byte offsets (start, body start, end) of its UTF-8 form.

    A piece is the bytes [start, end), the first body start - start of which
    repeat the end of the piece before.  A text within the limit is one piece,
    the empty text none.
    """
    raw = text.encode("utf-8")
    if not raw:
        return []
    if len(raw) <= limit:
        return [(0, 0, len(raw))]
    room = limit - overlap
    cuts: list[tuple[int, int]] = []
    lines = _lines(text)
    for (start, strength), end in zip(lines, [*(s for s, _ in lines[1:]), len(text)]):
        cuts.append((start, strength))
        cuts += _finer(text, start, end, room)
    # offsets in bytes
    at, last = [], 0
    position = 0
    for start, _ in cuts:
        position += len(text[last:start].encode("utf-8"))
        at.append(position)
        last = start
    at.append(len(raw))
    n = len(cuts)
    strength = [s for _, s in cuts]
    begin, end = at[:-1].copy(), at[1:].copy()
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    version = [0] * n

    def fits(i: int, j: int) -> bool:
        return end[j] - begin[i] <= (limit if begin[i] == 0 else room)

    def entry(i: int) -> tuple:
        j = right[i]
        return (strength[j], end[j] - begin[i], begin[i], i, j, version[i], version[j])

    heap = [entry(i) for i in range(n - 1) if fits(i, i + 1)]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, _, _, i, j, vi, vj = heapq.heappop(heap)
        if not (alive[i] and alive[j] and version[i] == vi and version[j] == vj):
            continue
        end[i], right[i] = end[j], right[j]
        alive[j] = False
        version[i] += 1
        if right[j] >= 0:
            left[right[j]] = i
        if right[i] >= 0 and fits(i, right[i]):
            heapq.heappush(heap, entry(i))
        if left[i] >= 0 and fits(left[i], i):
            heapq.heappush(heap, entry(left[i]))
    pieces: list[tuple[int, int, int]] = []
    i = 0
    while i >= 0:
        start = begin[i]
        if pieces:
            start = max(pieces[-1][0], begin[i] - overlap)
            while start < begin[i] and raw[start] & 0xC0 == 0x80:
                start += 1
        pieces.append((start, begin[i], end[i]))
        i = right[i]
    return pieces


def split_table(rows: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, start_byte, body_start, end_byte, piece) of every text.

    piece_no counts from 1.  A text within the limit is its own single piece; a
    null or empty one has none; repeated rows are split each.  A text is cut where it is
    read, unless the table has fewer pieces than there are cores.
    """
    kind = dict(rows.dtypes)[key]

    def cut(batches):
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["text"]):
                if not t:
                    continue
                raw = t.encode("utf-8")
                for no, (a, b, e) in enumerate(split_text(t, limit, overlap), 1):
                    out.append((k, no, a, b, e, raw[a:e].decode("utf-8")))
            yield pd.DataFrame(out, columns=["key", "piece_no", "start_byte", "body_start", "end_byte", "piece"])

    picked = spread(rows.select(rows[key].alias("key"), rows[text].alias("text")).where("text is not null and text != ''"))
    return picked.mapInPandas(
        cut, f"key {kind}, piece_no int, start_byte long, body_start long, end_byte long, piece string"
    ).withColumnRenamed("key", key)
