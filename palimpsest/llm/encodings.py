"""Text that was decoded with the wrong character encoding.

For each sentence every plausible chain of "encode as read, decode as written"
gives a candidate.  A candidate's description length is its size when compressed
with the zstandard dictionary of the language that suits it best, plus the cost
of naming the chain; the shortest description wins, and the unchanged text, whose
chain costs nothing, wins all ties.  Dictionaries are made of the words and phrases
counted in all texts of the corpus itself.  A sentence of usual character pairs only goes untested just
when no chain makes other text of usual pairs of it; all others are tested.
"""

from __future__ import annotations

import codecs
import pickle
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread

DICTIONARY_BYTES = 48_000
PIECES = 20_000  # of a language, the most useful ones, that its dictionary is chosen from; it holds fewer
SAMPLE_CHARS = 500_000  # bytes of text, of the pieces as often as they were counted, that show how often each byte comes
USUAL_SHARE = 0.03  # of a language's texts that hold a usual pair
LEVEL = 3
LOSSY = 1  # bytes to name the chain that lost characters
MARGIN = 1  # bytes a candidate must be shorter by, beyond its chain's cost

# (read as, written as, cost of naming it in bytes); the likelier the cheaper.
CHAINS = [
    ("cp1252", "utf-8", 1), ("latin-1", "utf-8", 1), ("mac_roman", "utf-8", 2), ("cp437", "utf-8", 2), ("cp850", "utf-8", 2),
    ("cp1250", "utf-8", 2), ("cp1251", "utf-8", 2), ("koi8-r", "utf-8", 2), ("cp866", "utf-8", 2), ("cp932", "utf-8", 2),
    ("iso8859-2", "utf-8", 3), ("iso8859-5", "utf-8", 3), ("cp1253", "utf-8", 3), ("cp1254", "utf-8", 3), ("gbk", "utf-8", 3), ("euc_jp", "utf-8", 3),
    ("cp437", "cp1252", 3), ("cp850", "cp1252", 3), ("mac_roman", "cp1252", 3), ("cp1252", "mac_roman", 3), ("cp1252", "cp437", 3),
    ("cp1252", "cp850", 3), ("cp1250", "cp1252", 3), ("cp1252", "cp1250", 3), ("cp1251", "cp1252", 3),
    ("cp1252", "cp1251", 3), ("latin-1", "cp1251", 3), ("cp1252", "koi8-r", 3), ("latin-1", "koi8-r", 3), ("cp1252", "cp866", 3),
    ("cp1251", "koi8-r", 3), ("koi8-r", "cp1251", 3), ("cp866", "cp1251", 3), ("cp1251", "cp866", 3), ("koi8-r", "cp866", 3), ("cp866", "koi8-r", 3),
    ("mac_roman", "cp1251", 4), ("cp437", "cp866", 4), ("cp437", "cp1251", 4), ("cp850", "cp866", 4),
    ("cp1252", "cp932", 3), ("latin-1", "cp932", 3), ("cp1252", "euc_jp", 3), ("latin-1", "euc_jp", 3), ("mac_roman", "cp932", 4), ("cp437", "cp932", 4),
]
READ_AS = sorted({read for read, _, _ in CHAINS})
MULTIBYTE = {"cp932", "gbk", "euc_jp", "utf-8"}
UTF8_CHAINS = [c for c in CHAINS if c[1] == "utf-8"]
OTHER_CHAINS = [(read, written) for read, written, _ in CHAINS if written != "utf-8"]
ASCII = "".join(map(chr, range(128)))

SENTENCE = re.compile(r"[^\n\r]+")
SENTENCE_CUT = re.compile(r"(?<=[.!?])\s+(?=\S)|(?<=[。！？])")
RUN = re.compile(r"[^\x00-\x7f]+")
PAIR = re.compile(r"[^\x00-\x7f]{2}")
LOST = "�"


@lru_cache(maxsize=None)
def _table(codec: str):
    """Decoding table and encoding map of a single-byte codec; a byte it leaves
    undefined stands for the control character of its number."""
    chars = []
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        chars.append(chr(b) if b < 128 else c)
    table = "".join(chars)
    return table, codecs.charmap_build(table)


def _bytes_as(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec) if codec in MULTIBYTE else codecs.charmap_encode(text, "strict", _table(codec)[1])[0]
    except UnicodeEncodeError:
        return None


def _text_of(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode(codec) if codec in MULTIBYTE else codecs.charmap_decode(raw, "strict", _table(codec)[0])[0]
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=None)
def _beyond_ascii(codec: str) -> frozenset[str]:
    """The characters of a single-byte codec beyond ASCII."""
    return frozenset(c for c in _table(codec)[0] if c > "\x7f")


# A character of several bytes in UTF-8.
UTF8_CHARACTER = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


@lru_cache(maxsize=200_000)
def _run_back(run: str, read: str) -> str | None:
    """A run of characters beyond ASCII whose bytes, as read, are UTF-8; correct signs
    beside or between such bytes stay."""
    if run[0] in _beyond_ascii(read) and (raw := _bytes_as(run, read)) is not None:
        try:
            return raw.decode("utf-8") if len(raw) > 1 else None
        except UnicodeDecodeError:
            pass
    out, last, changed = [], 0, False
    for part in _encodable(read).finditer(run):
        raw = _bytes_as(part[0], read)
        for m in UTF8_CHARACTER.finditer(raw):
            try:
                char = m[0].decode("utf-8")
            except UnicodeDecodeError:
                continue
            at = part.start() + m.start()
            out += (run[last:at], char)
            last, changed = part.start() + m.end(), True
    stays = "".join(out[::2]) + run[last:]
    # What stays must be signs; a letter left over says that these were no such bytes.
    return "".join(out) + run[last:] if changed and not any(unicodedata.category(c)[0] in "LM" for c in stays) else None


@lru_cache(maxsize=None)
def _encodable(codec: str) -> re.Pattern:
    """Stretches of characters beyond ASCII that a single-byte codec has."""
    return re.compile("[" + "".join(map(re.escape, sorted(_beyond_ascii(codec)))) + "]+")


@lru_cache(maxsize=None)
def _readable(codec: str) -> re.Pattern:
    return re.compile("[\\x00-\\x7f" + "".join(map(re.escape, sorted(_beyond_ascii(codec)))) + "]+")


def _by_stretches(text: str, read: str, written: str) -> str | None:
    """A single-byte chain on the stretches of a text that it can have come from;
    signs the code read as lacks stay."""
    changed = False

    def back(m: re.Match) -> str:
        nonlocal changed
        if m[0].isascii():
            return m[0]
        new = _text_of(_bytes_as(m[0], read), written)
        changed = changed or (new is not None and new != m[0])
        return m[0] if new is None else new

    new = _readable(read).sub(back, text)
    return new if changed else None


def _by_runs(text: str, read: str) -> str | None:
    """UTF-8 read as a single-byte code in parts of the text only."""
    changed = False

    def back(m: re.Match) -> str:
        nonlocal changed
        new = _run_back(m[0], read)
        changed = changed or new is not None
        return m[0] if new is None else new

    new = RUN.sub(back, text)
    return new if changed else None


def candidates(text: str, depth: int = 2, chains: list = CHAINS) -> dict[str, tuple[int, tuple]]:
    """Texts that chains of at most `depth` steps lead to, each with the cost of
    its cheapest chain and the chain."""
    found: dict[str, tuple[int, tuple]] = {}
    front = {text: (0, ())}
    for step in range(depth):
        nxt: dict[str, tuple[int, tuple]] = {}
        for t, (cost, chain) in front.items():
            beyond = {c for c in t if c > "\x7f"}
            raws = {read: _bytes_as(t, read) if read in MULTIBYTE or beyond <= _beyond_ascii(read) else None for read in READ_AS}
            # In UTF-8 no character beyond ASCII is a single byte.
            may_be_utf8 = PAIR.search(t) is not None
            for read, written, price in chains:
                if written == "utf-8":
                    if not may_be_utf8 and read not in MULTIBYTE:
                        continue
                elif step:
                    continue
                raw = raws[read]
                new = None if raw is None else _text_of(raw, written)
                if new is None and written == "utf-8" and read not in MULTIBYTE:
                    new = _by_runs(t, read)
                if new is None or new == t or new == text:
                    continue
                total = cost + price
                if total < found.get(new, (99,))[0]:
                    found[new] = (total, (*chain, (read, written)))
                    if not new.isascii():
                        nxt[new] = found[new]
        # Only what UTF-8 accepted is followed further; other codes accept anything.
        front = {t: v for t, v in nxt.items() if v[1][-1][1] == "utf-8"}
        if not front:
            break
    return found


def stretch_candidates(text: str) -> dict[str, tuple[int, tuple]]:
    """Texts that single-byte chains lead to if signs the code read as lacks stay."""
    found: dict[str, tuple[int, tuple]] = {}
    beyond = {c for c in text if c > "\x7f"}
    for read, written, price in CHAINS:
        if written in MULTIBYTE:
            continue
        other = beyond - _beyond_ascii(read)
        if not other or len(other) == len(beyond) or any(c.isalpha() for c in other):
            continue
        new = _by_stretches(text, read, written)
        if new is not None and new != text and price < found.get(new, (99,))[0]:
            found[new] = (price, ((read, written),))
    return found


WINDOW = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+(?=([\x00-\x7f]?))")


def windows_of(text: str) -> set[str]:
    """The stretches of characters beyond ASCII, each with its two neighbours."""
    return {m[0] + m[1] for m in WINDOW.finditer(text)}


@lru_cache(maxsize=200_000)
def pairs_in(window: str) -> frozenset[str]:
    s = re.sub(r"[0-9]", "0", re.sub(r"[ \t\r\n]", " ", window))
    s = re.sub(r"[!-/:-@\[-`{-~]", ".", s)
    # Beside a sign it does not matter which letter stands.
    pairs = (
        (a if a > "\x7f" or b.isalpha() or not a.isalpha() else "a") + (b if b > "\x7f" or a.isalpha() or not b.isalpha() else "a")
        for a, b in zip(s, s[1:])
    )
    return frozenset(pairs) or frozenset((s,))


def pairs_of(text: str) -> set[str]:
    """Pairs of neighbouring characters one of which is not ASCII; letters as
    they are, digits as 0, blanks and ASCII signs as one each."""
    out: set[str] = set()
    for w in windows_of(text):
        out |= pairs_in(w)
    return out


@lru_cache(maxsize=200_000)
def looks_split(pair: str) -> bool:
    """Could the two characters be the first two bytes of one in UTF-8, read in the
    commonest wrong way?"""
    if len(pair) < 2 or pair[0].isascii() or pair[1].isascii():
        return False
    for read in ("cp1252", "latin-1"):
        raw = _bytes_as(pair, read)
        if raw and 0xC2 <= raw[0] <= 0xF4 and 0x80 <= raw[1] <= 0xBF:
            return True
    return False


HAN, KANA = "\u3400-\u9fff\uf900-\ufaff々", "\u3040-\u30ff"
WITHOUT_BLANKS = re.compile(f"[{HAN}{KANA}]")
# Where no blanks are written, a change of script parts the words.
WORD = re.compile(rf"[^\s{HAN}{KANA}]{{1,32}}|[{HAN}]*[\u3040-\u309f]+|[{HAN}]+|[\u30a0-\u30ff]+")
LONG = 32  # characters of a word; longer ones are in several parts
# The repeated offsets between the tables and the content of a zstandard dictionary.
OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def pieces_of(text: str) -> set[str]:
    """The words of a text, each with a blank, and those that are not ASCII with their neighbours too."""
    words = text.split()
    every = set(words)
    if text.isascii():
        out = {w + " " for w in every if len(w) <= LONG}
        if len(out) < len(every):
            out.update(p for w in every if len(w) > LONG for p in WORD.findall(w))
        return out
    out = set()
    for w in every:
        if len(w) <= LONG and (w.isascii() or not WITHOUT_BLANKS.search(w)):
            out.add(w + " ")
        else:
            parts = WORD.findall(w)
            out.update(parts)
            out.update("".join(parts[max(0, i - 1) : i + 2]) for i, p in enumerate(parts) if not p.isascii())
    last = len(words) - 1
    for i, w in enumerate(words):
        if not w.isascii() and len(w) <= LONG:
            before, after = words[i - 1][-LONG:] + " " if i else "", words[i + 1][:LONG] + " " if i < last else ""
            out.add(f"{before}{w} {after}")
    return out


def language_of(tag: str | None) -> str | None:
    tag = (tag or "").strip().lower()[:2]
    return tag if tag.isalpha() and tag not in ("un", "") else None


def least_of(texts: int) -> float:
    """In how many of a language's texts a usual pair stands."""
    return max(2, USUAL_SHARE * texts)


class Model:
    """Dictionaries and usual pairs per language, fitted on (text, tag) rows."""

    def __init__(
        self, rows: list[tuple[str, str | None]], usual: dict[str, set[str]] | None = None, content: dict[str, bytes] | None = None
    ) -> None:
        """`usual` has the usual pairs of each language and `content` their dictionaries;
        without them they are counted in the rows and trained on them."""
        by: dict[str, list[str]] = defaultdict(list)
        for text, tag in rows:
            language = language_of(tag)
            if language and text and text.strip():
                by[language].append(text)
        if usual is None:
            usual = {}
            for language, texts in by.items():
                counts: Counter = Counter()
                for t in texts:
                    counts.update(pairs_of(t))
                usual[language] = {p for p, n in counts.items() if n >= least_of(len(texts))}
        # However often they come, pairs that look split are always put to the test.
        usual = {language: {p for p in pairs if not looks_split(p)} for language, pairs in usual.items()}
        self.content: dict[str, bytes] = dict(content or {})
        self.usual = set().union(*usual.values())
        self.usual_in = usual
        self._ways: dict[str, tuple[bool, int, int]] = {}
        self._harmless: set[str] = set()  # of those, the windows no chain makes other usual text of
        self._ready: dict | None = None
        for language, texts in sorted(by.items()):
            counts = Counter()
            for t in texts:
                counts.update(pieces_of(t))
            self.content[language] = self.dictionary(counts, usual.get(language, set()))

    def dictionary(self, counts: dict[str, int], mine: set[str]) -> bytes:
        """A dictionary of a language's pieces, counted in all its texts, `mine` being its usual
        pairs.  A piece stays out if a chain makes a commoner one of it: it may be garbled,
        however common."""
        kept, held = [], ""
        size = 0
        for piece, n in sorted(counts.items(), key=lambda c: (-(c[1] - 1) * len(c[0].encode("utf-8", "surrogatepass")), c[0])):
            raw = piece.encode("utf-8", "surrogatepass")
            if n < 2 or size + len(raw) > DICTIONARY_BYTES:
                break
            # A piece of one text only shortens no other; one within another is there already.
            if piece in held:
                continue
            if not piece.isascii() and (not pairs_of(piece) <= mine or any(counts.get(new, 0) > n for new in candidates(piece))):
                continue
            kept.append((raw, n))
            held += "\0" + piece
            size += len(raw)
        content = b"".join(raw for raw, _ in reversed(kept))  # the most useful at the end, where it is near
        total = sum(n * len(raw) for raw, n in kept)
        text = [raw for raw, n in kept for _ in range(max(1, round(n * SAMPLE_CHARS / total)))]
        random.Random(7).shuffle(text)
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, [b"".join(text[i : i + 12]) for i in range(0, len(text), 12)], level=LEVEL).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too little for tables
            return content
        # Its tables of how often bytes and lengths come are kept; its content is the pieces.
        at = made.find(OFFSETS, 0, 4096)
        return made[: at + len(OFFSETS)] + content if at > 0 else content

    def compressors(self) -> dict:
        """Compressors by language, and one without a dictionary."""
        if self._ready is None:
            options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
            self._ready = {None: zstandard.ZstdCompressor(level=LEVEL, **options)}
            for language, content in self.content.items():
                if len(content) < 8:
                    continue
                d = zstandard.ZstdCompressionDict(content)
                d.precompute_compress(level=LEVEL)
                self._ready[language] = zstandard.ZstdCompressor(dict_data=d, **options)
        return self._ready

    def __getstate__(self):
        return {"content": self.content, "usual": self.usual, "usual_in": self.usual_in, "_ready": None, "_ways": {}, "_harmless": set()}

    def lengths(self, text: str) -> dict:
        """Bytes with each dictionary."""
        raw = text.encode("utf-8", "surrogatepass")
        return {t: len(c.compress(raw)) for t, c in self.compressors().items()}

    def length(self, text: str, pairs: set[str] | None = None, also: str | None = None) -> int:
        """Bytes with the dictionary that suits best.  With `pairs`, those of the text, only
        the dictionaries of languages in which some of them are usual, and that of the
        language `also`, can suit."""
        raw = text.encode("utf-8", "surrogatepass")
        return min(
            len(c.compress(raw))
            for t, c in self.compressors().items()
            if pairs is None or t is None or t == also or not pairs.isdisjoint(self.usual_in.get(t, ()))
        )

    def _ways_of(self, window: str) -> tuple[bool, int, int]:
        """Of a window of usual pairs: can a chain by way of UTF-8 make it another one of
        usual pairs; the other chains (as bits) that leave it usual; those of them that
        change it."""
        got = self._ways.get(window)
        if got is None:
            split = any(pairs_of(new) <= self.usual for new in candidates(window, chains=UTF8_CHAINS))
            usual = changed = 0
            for bit, (read, written) in enumerate(OTHER_CHAINS):
                # A character of two bytes may take in the ASCII character after it, never the one before.
                old = window.lstrip(ASCII) if written in MULTIBYTE else window
                raw = _bytes_as(old, read)
                new = None if raw is None else _text_of(raw, written)
                if new is not None and (new == old or (len(new) == 1 and written in MULTIBYTE) or pairs_of(new) <= self.usual):
                    usual |= 1 << bit
                    changed |= (new != old) << bit
            got = split, usual, changed
            if len(self._ways) < 500_000 and len(window) < 16:
                self._ways[window] = got
                if not split and not changed:
                    self._harmless.add(window)
        return got

    def suspicious(self, sentence: str) -> bool:
        """Is there an unusual pair, or a chain that makes other text of usual pairs only?
        No other sentence can be restored, however usual its pairs are."""
        windows = windows_of(sentence)
        if windows <= self._harmless:
            return False
        usual, changed, ways = -1, 0, self._ways
        for w in windows:
            got = ways.get(w)
            if got is None:
                if not pairs_in(w) <= self.usual:
                    return True
                got = self._ways_of(w)
            if got[0]:
                return True
            usual &= got[1]
            changed |= got[2]
        live = usual & changed
        for bit, (read, written) in enumerate(OTHER_CHAINS if live else ()):
            if live >> bit & 1:
                if written not in MULTIBYTE:
                    return True
                raw = _bytes_as(sentence, read)
                new = None if raw is None else _text_of(raw, written)
                if new is not None and pairs_of(new) <= self.usual:
                    return True
        return False

    def restore(self, sentence: str) -> tuple[str, tuple]:
        """The sentence of the shortest description and its chain (empty: unchanged)."""
        length = None
        # Parts of the sentence are tried where no chain of all of it is shorter.
        for find in (candidates, stretch_candidates):
            options = find(sentence)
            if not options:
                continue
            if length is None:
                every = self.lengths(sentence)
                told = min(every, key=every.get)  # what language the rest of the sentence is in
                length = every[told] + len(pairs_of(sentence) - self.usual)
            best, best_chain, best_length = sentence, (), length
            for text, (cost, chain) in options.items():
                pairs = pairs_of(text)
                now = self.length(text, pairs, told) + cost + MARGIN + len(pairs - self.usual)
                if now < best_length or (now == best_length and chain and best_chain and len(chain) < len(best_chain)):
                    best, best_length, best_chain = text, now, chain
            if best_chain:
                return best, best_chain
        return sentence, ()

    def is_lossy(self, sentence: str) -> bool:
        """Is the sentence shorter to describe as one that lost characters?  What was
        lost cannot be named, so the candidate is what is left, at the chain's cost."""
        left = sentence.replace(LOST, "")
        return self.length(left) + LOSSY < self.length(sentence)

    def repair(self, text: str) -> tuple[str, bool, bool]:
        """(text with its garbled sentences restored, was any garbled, is any part
        beyond recovery)."""
        if text.isascii():
            return text, False, False
        out, last, hit, lost = [], 0, False, False
        for a, b in sentence_spans(text, True):
            s = text[a:b]
            if LOST in s:
                lost = lost or self.is_lossy(s)
                continue
            if s.isascii() or not self.suspicious(s):
                continue
            new, chain = self.restore(s)
            if chain:
                out += (text[last:a], new)
                last = b
                hit = True
        return "".join(out) + text[last:], hit or lost, lost


def sentence_spans(text: str, beyond_ascii: bool = False):
    for line in SENTENCE.finditer(text):
        a, end = line.span()
        if beyond_ascii and line[0].isascii():
            continue
        for cut in SENTENCE_CUT.finditer(text, a, end):
            if cut.end() > a:
                yield a, cut.end()
                a = cut.end()
        if a < end:
            yield a, end


def sentences(text: str) -> list[str]:
    return [text[a:b] for a, b in sentence_spans(text)]


def pair_counts(rows: DataFrame) -> DataFrame:
    """(tag, pair, n) of rows (tag, text): in how many texts of a tag a pair stands."""

    def run(batches):
        counts: Counter = Counter()
        for pdf in batches:
            for tag, t in zip(pdf["tag"], pdf["text"]):
                counts.update((tag, p) for p in pairs_of(t))
            if len(counts) > 300_000:
                yield table_of(counts)
                counts.clear()
        yield table_of(counts)

    def table_of(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame([(tag, p, n) for (tag, p), n in counts.items()], columns=["tag", "pair", "n"])

    parts = rows.where(F.col("text").rlike(r"[^\x00-\x7f]")).mapInPandas(run, "tag string, pair string, n long")
    return parts.groupBy("tag", "pair").agg(F.sum("n").alias("n"))


def piece_counts(rows: DataFrame) -> DataFrame:
    """(tag, piece, n) of rows (tag, text): in how many texts of a tag a piece stands, if in
    more than one.  Counts move as one row a bucket of pieces, not a row a piece."""
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        counts: dict[str, Counter] = defaultdict(Counter)
        for pdf in batches:
            for tag, t in zip(pdf["tag"], pdf["text"]):
                counts[tag].update(pieces_of(t))
                if sum(map(len, counts.values())) > 200_000:
                    yield table_of(counts)
                    counts.clear()
        yield table_of(counts)

    def table_of(counts: dict[str, Counter]) -> pd.DataFrame:
        parts: dict[int, list] = defaultdict(list)
        for tag, own in counts.items():
            for piece, n in own.items():
                parts[zlib.crc32(piece.encode("utf-8", "surrogatepass")) % buckets].append((tag, piece, n))
        return pd.DataFrame({"bucket": list(parts), "counts": [pickle.dumps(part) for part in parts.values()]})

    def added(pdf):
        total: Counter = Counter()
        for part in pdf["counts"]:
            for tag, piece, n in pickle.loads(part):
                total[tag, piece] += n
        several = [(tag, piece, n) for (tag, piece), n in total.items() if n > 1]
        return pd.DataFrame(several, columns=["tag", "piece", "n"])

    return rows.mapInPandas(run, "bucket int, counts binary").groupBy("bucket").applyInPandas(added, "tag string, piece string, n long")


def fit(rows: DataFrame, key: str, text: str, language: str) -> Model:
    """A model of the usual pairs and of dictionaries of the pieces of all whole texts."""
    tag = F.substring(F.lower(F.trim(F.col(language))), 1, 2)
    told = rows.select(tag.alias("tag"), F.col(text).alias("text")).where(
        F.col("text").rlike(r"\S") & F.expr("tag rlike '^[a-z]{2}$' and tag != 'un'")
    )
    sizes = {r["tag"]: r["count"] for r in told.groupBy("tag").count().collect()}  # a row per pair of letters at most
    usual: dict[str, set[str]] = {t: set() for t in sizes}
    if sizes:
        least = rows.sparkSession.createDataFrame([(t, float(least_of(n))) for t, n in sizes.items()], "tag string, least double")
        # At this share the pairs of a tag are few, whatever the number of texts.
        for r in pair_counts(told.select("tag", "text")).join(F.broadcast(least), "tag").where("n >= least").select("tag", "pair").collect():
            usual[r["tag"]].add(r["pair"])
    # The most useful pieces of each tag, first of shares of it, so that no task sorts all.
    picked = piece_counts(told).withColumn("gain", (F.col("n") - 1) * F.octet_length("piece"))
    picked = picked.withColumn("slot", F.pmod(F.xxhash64("piece"), F.lit(16)))
    for by in (["tag", "slot"], ["tag"]):
        ranked = Window.partitionBy(*by).orderBy(F.desc("gain"), "piece")
        picked = picked.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= PIECES)
    plain = Model([], usual)

    def train(pdf):
        tag = pdf["tag"].iloc[0]
        counts = dict(zip(pdf["piece"], pdf["n"].tolist()))
        return pd.DataFrame({"tag": [tag], "content": [plain.dictionary(counts, {p for p in usual[tag] if not looks_split(p)})]})

    # Each dictionary is made where the language's pieces are; only dictionaries come here.
    made = picked.select("tag", "piece", "n").groupBy("tag").applyInPandas(train, "tag string, content binary").collect() if sizes else []
    return Model([], usual, {r["tag"]: bytes(r["content"]) for r in sorted(made, key=lambda r: r["tag"])})


def repair_table(rows: DataFrame, key: str, text: str, language: str, with_text: bool = True) -> DataFrame:
    """(key, garbled, lost, text): whether any part was decoded wrongly, whether a
    part is beyond recovery, and the text with its garbled sentences restored.

    Null and empty texts are not garbled and stay as they are; repeated rows are
    treated each.  Whole texts are read, where they are stored, without a shuffle unless
    the table has fewer pieces than there are cores.
    """
    rows = spread(rows.select(key, text, language))
    model_of = rows.sparkSession.sparkContext.broadcast(fit(rows, key, text, language))
    kind = dict(rows.dtypes)[key]

    def run(batches):
        model = model_of.value
        for pdf in batches:
            done = [model.repair(t) if t else (t, False, False) for t in pdf["text"]]
            out = {"key": pdf["key"], "garbled": [d[1] for d in done], "lost": [d[2] for d in done]}
            if with_text:
                out["text"] = [d[0] for d in done]
            yield pd.DataFrame(out)

    picked = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if not with_text:
        picked = picked.where(F.col("text").rlike(r"[^\x00-\x7f]"))
    schema = f"key {kind}, garbled boolean, lost boolean" + ", text string" * with_text
    return picked.mapInPandas(run, schema).withColumnRenamed("key", key)
