"""Encoding whole texts with a public byte-level BPE vocabulary.

Texts are cut where a rolling hash of the last bytes says so, so that equal
passages give equal chunks wherever they stand.  A worker encodes each chunk it
meets once and keeps its ids.  Cuts fall, if at all possible, where the
splitting pattern has a boundary in any context (before a blank that a visible
character follows); chunks joined there need no repair.  A cut forced elsewhere
is repaired: the stretch between the nearest certain boundaries on both sides is
encoded again, and so is a wider one, until the wider one agrees with the narrower
one and the ids kept beside it.
"""

from __future__ import annotations

import base64
import itertools
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

VOCABULARY = os.environ.get("PALIMPSEST_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# The pattern the vocabulary's merges were made with (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MASK = np.uint64(0x7F)  # of the certain boundaries one in 128 is a cut
WINDOW = 8  # bytes the rolling hash sees
LONGEST = 1 << 14  # bytes after which a cut is forced
CACHE_IDS = 4_000_000  # ids a worker keeps

_held: dict = {}


def encoding(path: str = VOCABULARY):
    """The encoder of a rank file, loaded once a process."""
    if path not in _held:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _held[path] = tiktoken.Encoding("palimpsest", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _held[path]


def certain_boundaries(raw: np.ndarray) -> np.ndarray:
    """Offsets of blanks that a visible ASCII character follows: whatever stands
    around, the pattern begins a new piece there."""
    if len(raw) < 2:
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero((raw[:-1] == 0x20) & (raw[1:] > 0x20) & (raw[1:] < 0x7F))


def rolling_hash(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW bytes before each offset, all at least WINDOW: the bytes as
    one number of a window that moves over the text, mixed."""
    window = np.lib.stride_tricks.as_strided(raw, shape=(max(0, len(raw) - WINDOW + 1), WINDOW), strides=(1, 1))
    h = window[at - WINDOW].copy().view(np.uint64)[:, 0] * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def natural_cuts(raw: np.ndarray) -> np.ndarray:
    """The certain boundaries at which the rolling hash cuts."""
    sure = certain_boundaries(raw)
    sure = sure[sure >= WINDOW]
    return sure[(rolling_hash(raw, sure) & MASK) == 0]


def with_forced(data: bytes, cuts: list[int], longest: int) -> list[tuple[int, bool]]:
    """(offset, certain) of all chunk starts after the first: `cuts` and those
    forced where two are more than `longest` bytes apart."""
    out, last, sure = [], 0, None
    for c in [*cuts, len(data)]:
        while c - last > longest:
            if sure is None:
                sure = certain_boundaries(np.frombuffer(data, dtype=np.uint8))
            near = sure[(sure > last + longest // 2) & (sure <= last + longest)]
            if len(near):
                forced, ok = int(near[-1]), True
            else:
                forced, ok = last + longest, False
                while forced > last + 1 and data[forced] & 0xC0 == 0x80:
                    forced -= 1
            out.append((forced, ok))
            last = forced
        if c < len(data):
            out.append((c, True))
            last = c
    return out


class Encoder:
    """Encodes texts by chunks that are encoded once and kept."""

    def __init__(self, path: str = VOCABULARY, longest: int = LONGEST) -> None:
        self.bpe = encoding(path)
        self.longest = longest
        self.kept: dict[bytes, list[int]] = {}
        self.size = 0
        self.encoded = self.reused = 0
        self._lengths: dict[int, int] = {}

    def chunk(self, data: bytes) -> list[int]:
        ids = self.kept.get(data)
        if ids is None:
            ids = self.bpe.encode_ordinary(data.decode("utf-8"))
            self.encoded += 1
            if self.size > CACHE_IDS:
                self.kept.clear()
                self.size = 0
            self.kept[data] = ids
            self.size += len(ids)
        else:
            self.reused += 1
        return ids

    def _length(self, token: int) -> int:
        n = self._lengths.get(token)
        if n is None:
            n = self._lengths[token] = len(self.bpe.decode_single_token_bytes(token))
        return n

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text.  The texts are hashed together, in one pass."""
        datas = [t.encode("utf-8") if t else b"" for t in texts]
        raw = np.frombuffer(b"\n".join(datas), dtype=np.uint8)
        starts = np.zeros(len(datas) + 1, dtype=np.int64)
        np.cumsum([len(d) + 1 for d in datas], out=starts[1:])
        cuts = natural_cuts(raw)
        spans = np.searchsorted(cuts, starts)
        out = []
        for k, data in enumerate(datas):
            own = (cuts[spans[k] : spans[k + 1]] - starts[k]).tolist()
            if own and own[0] == 0:
                own = own[1:]
            out.append(self._encode(data, own))
        return out

    def _encode(self, data: bytes, cuts: list[int]) -> list[int]:
        if not data:
            return []
        if not cuts and len(data) <= self.longest:
            return list(self.chunk(data))
        all_cuts = with_forced(data, cuts, self.longest)
        ids: list[int] = []
        last = 0
        for at, _ in all_cuts:
            ids += self.chunk(data[last:at])
            last = at
        ids += self.chunk(data[last:])
        open_joins = [at for at, certain in all_cuts if not certain]
        return self._repair(data, ids, open_joins) if open_joins else ids

    def _repair(self, data: bytes, ids: list[int], joins: list[int]) -> list[int]:
        raw = np.frombuffer(data, dtype=np.uint8)
        sure = np.concatenate([[0], certain_boundaries(raw), [len(data)]])
        ends = np.concatenate([[0], np.cumsum([self._length(t) for t in ids])])
        index = lambda k: int(np.searchsorted(ends, sure[k]))
        fresh = lambda lo, hi: self.bpe.encode_ordinary(data[sure[lo] : sure[hi]].decode("utf-8"))
        out, done, covered = [], 0, 0
        for at in joins:
            if at <= covered:
                continue
            hi = min(int(np.searchsorted(sure, at, side="right")), len(sure) - 1)
            lo = hi - 1
            own = fresh(lo, hi)
            while lo > 0 or hi < len(sure) - 1:
                low, high = max(lo - 1, 0), min(hi + 1, len(sure) - 1)
                wider = fresh(low, high)
                on_ends = all(ends[min(index(k), len(ends) - 1)] == sure[k] for k in (low, lo, hi, high))
                if on_ends and wider == ids[index(low) : index(lo)] + own + ids[index(hi) : index(high)]:
                    break
                lo, hi, own = low, high, wider
            if sure[lo] < covered:  # grown into the stretch before: encode both as one
                return self.bpe.encode_ordinary(data.decode("utf-8"))
            out += ids[done : index(lo)] + own
            done, covered = index(hi), int(sure[hi])
        return out + ids[done:]


def _encoder(path: str) -> Encoder:
    key = ("encoder", path)
    if key not in _held:
        _held[key] = Encoder(path)
    return _held[key]


def encode_table(rows: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row, null and empty texts with an empty list.

    Texts are encoded where they are read, without a shuffle unless the table has fewer
    pieces than there are cores; repeated rows give repeated results.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(path)
        for batch in batches:
            ids = encoder.encode_many(batch.column(1).to_pylist())
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    return spread(rows.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_table(rows: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row; 0 for null and empty texts."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        encoder = _encoder(path)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "n_tokens": [len(ids) for ids in encoder.encode_many(list(pdf["text"]))]})

    return spread(rows.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInPandas(run, f"key {kind}, n_tokens long").withColumnRenamed("key", key)
