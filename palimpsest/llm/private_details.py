"""Personal details in free text: find them and put typed placeholders there.

One Aho-Corasick pass over the lower-cased text finds all anchors: at-signs in their
notations, schemes, identifier, card and telephone cues, digits, street and post-box
words, name cues and name parts.  At each anchor a deterministic parser widens to the
boundaries of the e-mail address, number, account, postal address or name and validates
it: check digits where a notation has them, impossible numbers, and what stands before.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import product

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME = KINDS = ("email", "phone", "id_number", "address", "name")
# Anchors that are no details themselves.
DIGIT, SCHEME, ID_CUE, CARD_CUE, PHONE_CUE, NAME_CUE, GREETING = range(7)
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

# A lexicon is a closed word list; beyond this it would not be one.
MOST_NAME_PARTS = 100_000

# --- e-mail ---------------------------------------------------------------
AT_SIGNS = ("@", "＠", "%40", "&#64;", "[at]", "(at)", "{at}", " at ")
LOCAL = re.compile(r"[A-Za-z0-9À-ɏ](?:[A-Za-z0-9À-ɏ._%+'-]*[A-Za-z0-9À-ɏ_+-])?$")
DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"
DOMAIN = re.compile(rf"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:{DOT}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*{DOT}[a-z]{{2,24}}(?![a-z0-9-]|\.[a-z0-9])", re.I)
SPELLED_DOMAIN = re.compile(r"[a-z0-9-]+(?: dot [a-z0-9-]+)+\b", re.I)

# --- numbers --------------------------------------------------------------
SEPARATORS = " ().-/ ‐‑–"
LEAST_RUN = 6  # characters from the first digit of a number to its last
SCHEMES = ("tel:", "sms:", "callto:", "mailto:")
ID_CUES = (
    "ssn", "social security", "passport no", "passport number", "passport or id no", "passport:", "national id", "identity card", "identity number", "id card",
    "id number", "tax id", "personal number", "national insurance", "personalausweis", "ausweisnummer", "steuer-id", "numéro de sécurité sociale",
    "pièce d'identité", "pièce d’identité", "documento de identidad", "dni", "паспорт", "снилс",
)
CARD_CUES = ("card", "visa", "mastercard", "amex", "carte bancaire", "tarjeta", "kreditkarte")
PHONE_CUES = ("phone:", "tel.", "mobile:", "cell:", "fax:", "telefon:", "téléphone:", "teléfono:", "телефон:")
CUE_REACH = 24  # characters between a cue and its number, at most
# Before a bare row of digits these say that it names no person.
TECHNICAL = re.compile(
    r"(?:\b(?:build|job|run|offset|size|bytes?|port|pid|lines?|version|ts|time|timestamp|epoch|seq|count|rows?|event|batch|commit|ticket|issue|order|invoice|"
    r"item|record|block|page|hash|seed|node|shard|inode|step|revision|rev|id[=:])[\s:=#]*|[=#])$", re.I,
)
# Lengths of account numbers by country (fixed values).
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
    "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26, "UA": 29, "SA": 24, "AE": 23, "IL": 23, "BR": 29,
}
# Country codes and the lengths of their national numbers (fixed values).
PLANS = {
    "1": (10, 10), "7": (10, 10), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "39": (8, 11),
    "41": (9, 9), "43": (7, 12), "44": (9, 10), "45": (8, 8), "46": (7, 9), "47": (8, 8), "48": (9, 9), "49": (7, 11),
    "52": (10, 10), "55": (10, 11), "61": (9, 9), "81": (9, 10), "82": (8, 10), "86": (10, 11), "91": (10, 10), "351": (9, 9),
    "353": (7, 9), "358": (6, 11), "420": (9, 9),
}
NATIONAL = re.compile(
    r"(?:1[ .\- ‑])?\(?[2-9]\d{2}\)?[ .\- ‑]{1,2}\d{3}[ .\- ‑]\d{4}(?!\d)"
    r"|0(?!00)\d{1,4}[ /.\- ‑]\d{2,8}(?:[ .\- ‑]\d{2,6}){0,4}(?!\d|[:.]\d)"
    r"|\(0\d{1,4}\)[ ]?\d{3,8}(?:[ -]\d{2,6}){0,3}(?!\d|[:.]\d)"
    r"|\(0\)[ ]?\d{2,5}(?:[ .-]\d{3,4}){1,3}(?!\d|[:.]\d)"
)
SSN = re.compile(r"(?!000|666)\d{3}([ \-‑])(?!00)\d{2}\1(?!0000)\d{4}(?![\w-])")
BIRTH_NUMBER = re.compile(r"\d{6}[-+]\d{4}(?![\w-])")
ELEVEN = re.compile(r"\d{11}(?![\w-])")
INSURANCE = re.compile(r"(?<![\w-])[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D](?!\w)")
PASSPORT = re.compile(r"(?<![\w-])[A-Z]{2}\d{7}(?![\w-])")
CUED_ID = re.compile(r"\d(?:[ \-‑]?\d){6,11}(?![\w-])")
CARD = re.compile(r"[3-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?(?![\w-])|3[47]\d{2}([ -]?)\d{6}\2\d{5}(?![\w-])")
CUED_PHONE = re.compile(r"\+?\(?\d(?:[ ().\-/‑]{0,2}\d){6,14}(?!\w)")


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


# --- addresses ------------------------------------------------------------
CAP = r"[A-ZÀ-ÞĀ-Ž][\w’'-]*"
CITY = rf"{CAP}(?: (?:upon|am|sur|de|of) {CAP})?"
ZIP = r"(?:[A-Z]{2} \d{5}(?:-\d{4})?|\d{5}(?:-\d{3,4})?|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2})"
STREET = (
    "St|Street|Ave|Avenue|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Terrace|Close|Crescent|Square|Sq|Way|Place|Pl|Row|"
    "Gardens|Parkway|Highway|Alley|Mews|Walk"
)
ADDRESSES = [
    re.compile(
        rf"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.? ?\d+\w?,\s)?(?<![\w.:-])\d{{1,5}}[a-zA-Z]? (?:{CAP} ){{1,3}}(?:{STREET})\b\.?"
        rf"(?:,? (?:(?:Apt|Apartment|Flat|Unit|Suite)\.?|#) ?\w+)?(?:,?\s{CITY}(?=,? {ZIP}\b|[.,\"\s]|$))?(?:,? {ZIP}\b)?"
    ),
    re.compile(
        r"(?<![\w.:-])\d{1,4}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|bd|place|chemin|impasse|quai|allée|route|cours)"
        rf"(?: (?:de la|de l[’']|de|du|des|la|le|les|d[’']))? ?{CAP}(?: {CAP})?(?:, \d{{5}} {CITY})?"
    ),
    re.compile(
        rf"(?<!\w)(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Carrera|Rua|Via|Viale|Praça|Travessa)(?: (?:de las|de los|de la|del|de|da|do|dos|das))?"
        rf"(?: {CAP}){{1,3}},? (?:n[.º°]+ ?)?\d{{1,4}}(?:, \d{{4,5}}(?:-\d{{3}})? {CITY})?"
    ),
    re.compile(rf"(?<!\w)[A-ZÄÖÜ][\w-]*(?:weg|straße|strasse|str\.|gasse|allee|platz|damm|ufer) \d{{1,4}}[a-z]?(?!\w)(?:, \d{{5}} {CITY})?"),
    re.compile(
        r"(?<!\w)(?:P\.? ?O\.? ?Box|PO Box|Post Office Box|Postfach|Apartado(?: de [Cc]orreos)?|Boîte postale|B\.?P\.?|Caixa [Pp]ostal|а/я)"
        rf" ?#?\d{{1,6}}(?:,\s{CITY}(?: \d{{4,5}})?|,\s\d{{5}} {CITY})?"
    ),
]
ADDRESS_WORDS = (
    *(f" {w.lower()}" for w in STREET.split("|")), " rue", " avenue", " boulevard", " bd ", " place ", " chemin", " impasse", " quai ", " allée",
    " route ", " cours ", "calle ", "avenida ", "avda.", "plaza ", "paseo ", "camino ", "carrera ", "rua ", "via ", "viale ", "praça ", "travessa ",
    "weg ", "straße ", "strasse ", "str. ", "gasse ", "allee ", "platz ", "damm ", "ufer ",
    "box ", "postfach", "apartado", "boîte postale", "bp ", "b.p.", "caixa postal", "а/я",
)

# --- names ----------------------------------------------------------------
BEFORE_LOWER_NAME = re.compile(
    r"(?:\b(?:thanks|thank you|ask|told|tell|hi|hello|hey|dear|regards|cheers|grüße|cc|merci|gracias|hola|obrigad[oa]|danke)[,:]?|\bsigned:)\s+$", re.I
)
# Whoever follows these is a person; others follow the second kind too, so the line or the clause must end there.
NAME_CUES = (
    "my name is ", "signed: ", "signed by ", "mr ", "mr. ", "mrs ", "mrs. ", "ms ", "ms. ", "dr ", "dr. ", "prof. ", "ich heiße ", "mein name ist ", "je m'appelle ",
    "je m’appelle ", "me llamo ", "mi nombre es ", "меня зовут ", "herr ", "frau ", "monsieur ", "madame ", "señor ", "señora ",
)
GREETINGS = ("dear ", "regards,", "cheers,", "sincerely,", "hi ", "hello ")
_PART = r"[^\W\d_](?:[^\W\d_]|[’'](?=[^\W\d_]))*(?:-[^\W\d_]+)?"
PERSON = re.compile(rf"\s*({_PART}(?:[ ](?:[^\W\d_]\.|(?:van|von|de|da|del|la|der|den|bin|al)(?= )|{_PART})){{0,3}})")
NO_PERSON = {
    "a", "all", "an", "and", "anyone", "api", "are", "body", "can", "chair", "committee", "crew", "customer", "customers", "department", "do", "does",
    "each", "engineering", "every", "everybody", "everyone", "folks", "for", "friends", "from", "go", "group", "have", "he", "here", "his", "how",
    "i", "if", "in", "is", "it", "its", "just", "let", "madam", "maintainer", "maintainers", "manager", "me", "my", "nobody", "not", "of", "off",
    "office", "on", "one", "operations", "our", "people", "please", "release", "robot", "root", "run", "she", "sir", "so", "some", "staff", "support",
    "system", "team", "that", "the", "their", "them", "there", "these", "they", "this", "those", "to", "today", "tomorrow", "us", "user", "users",
    "we", "what", "when", "where", "which", "who", "why", "will", "with", "world", "yes", "you", "your",
}
JOINS_NAMES = re.compile(r"(?:\s[A-Z]\.)?\s|-|,\s")
CODE_BEFORE, CODE_AFTER = set("_/@\\#$`=+~^&"), set("_/@\\#$`=+~^&(")


def name_model(parts: list[str]) -> set[str]:
    """Lower-case name words: the given parts and all that their building blocks make.

    Every part is split into a stem and an ending; the splits are chosen anew, a
    few times over, so that each uses the stem and the ending that most other
    parts use too.  Endings used at least three times and the stems they were
    used with recombine freely.  The list holds only some of the names in use,
    its blocks reach the others.
    """
    words = sorted({p.strip().lower() for p in parts if p and len(p.strip()) > 4})
    stems = Counter(w[:i] for w in words for i in range(2, len(w) - 1))
    endings = Counter(w[i:] for w in words for i in range(2, len(w) - 1))
    split: dict[str, int] = {}
    for _ in range(12):
        before = dict(split)
        for w in words:
            mine = split.get(w)

            def score(i: int) -> float:
                own = i == mine
                return math.log(stems[w[:i]] - own + 0.1) + math.log(endings[w[i:]] - own + 0.1)  # noqa: B023

            split[w] = max(range(2, len(w) - 1), key=lambda i: (score(i), -abs(i - 3)))
        stems = Counter(w[:i] for w, i in split.items())
        endings = Counter(w[i:] for w, i in split.items())
        if split == before:
            break
    keep_endings = {e for e, n in endings.items() if n >= 3}
    keep_stems = {w[:i] for w, i in split.items() if w[i:] in keep_endings and i > 2}
    return {p.strip().lower() for p in parts if p and len(p.strip()) > 2} | {a + b for a, b in product(keep_stems, keep_endings)}


class Finder:
    """Spans (start, end, kind) of personal details in a text."""

    def __init__(self, given: list[str], family: list[str]) -> None:
        self.listed = {w.lower() for w in (*given, *family) if w}
        self.names = name_model(given) | name_model(family)
        self.anchors = ahocorasick.Automaton()
        words: dict[str, set[str]] = defaultdict(set)
        for w in AT_SIGNS:
            words[w].add(EMAIL)
        for w in ADDRESS_WORDS:
            words[w].add(ADDRESS)
        for w in self.names:
            words[w].add(NAME)
        for kind, cues in ((DIGIT, "0123456789"), (SCHEME, SCHEMES), (ID_CUE, ID_CUES), (CARD_CUE, CARD_CUES), (PHONE_CUE, PHONE_CUES), (NAME_CUE, NAME_CUES), (GREETING, GREETINGS)):
            for w in cues:
                words[w].add(kind)
        for w, kinds in words.items():
            self.anchors.add_word(w, (len(w), tuple(kinds)))
        self.anchors.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        taken: list[tuple[int, int, str]] = []
        names, streets, digits, persons = [], [], [], []
        cues: dict[int, list[tuple[int, int]]] = {ID_CUE: [], CARD_CUE: [], PHONE_CUE: []}
        for last, (size, kinds) in self.anchors.iter(low):
            a, b = last + 1 - size, last + 1
            for kind in kinds:
                if kind == DIGIT:
                    digits.append(last)
                elif kind == EMAIL:
                    found = self._email(text, a, b)
                    if found and not self._inside(found, taken):
                        taken.append((*found, EMAIL))
                elif kind == ADDRESS:
                    streets.append((a, b))
                elif kind == NAME:
                    names.append((a, b))
                elif a and low[a - 1].isalnum():
                    continue  # a cue begins a word
                elif kind == SCHEME:
                    if low[a] != "m":
                        cues[PHONE_CUE].append((a, b))
                elif kind in cues:
                    cues[kind].append((a, b))
                else:
                    persons.append((a, b, kind))
        for a, b in streets:
            if any(x <= a and b <= y for x, y, _ in taken):
                continue
            found = self._address(text, a, b)
            if found and not self._inside(found, taken):
                taken.append((*found, ADDRESS))
        for start, end in self._runs(text, digits):
            at = start
            while at < end:
                found = self._number(text, at, end, cues)
                if not found:
                    # the next group of the run may start a number of its own
                    nxt = next((i for i in range(at + 1, end) if text[i].isdigit() and text[i - 1] == " " and text[i - 2].isdigit()), None)
                    if nxt is None:
                        break
                    at = nxt
                    continue
                a, b, kind = found
                if not self._inside((a, b), taken):
                    taken.append(found)
                at = max(b, at + 1)
                while at < end and not text[at].isdigit():
                    at += 1
        if names or persons:
            taken += self._names(text, low, names, persons, taken)
        return sorted(taken)

    @staticmethod
    def _runs(text: str, digits: list[int]) -> list[tuple[int, int]]:
        """Stretches of digits with nothing but separators between them."""
        out: list[list[int]] = []
        for i in digits:
            if out and (i == out[-1][1] or all(c in SEPARATORS for c in text[out[-1][1] : i])):
                out[-1][1] = i + 1
            else:
                out.append([i, i + 1])
        return [(a, b) for a, b in out]

    @staticmethod
    def _inside(span: tuple[int, int], taken: list) -> bool:
        return any(a < span[1] and span[0] < b for a, b, _ in taken)

    @staticmethod
    def _email(text: str, a: int, b: int) -> tuple[int, int] | None:
        sign = text[a:b]
        spelled = len(sign) > 1 and not sign.startswith(("%", "&"))
        before = text[max(0, a - 80) : a]
        if spelled:
            before = before.rstrip()
        local = LOCAL.search(before)
        if not local:
            return None
        after = b + (len(text[b : b + 2]) - len(text[b : b + 2].lstrip()) if spelled else 0)
        domain = (SPELLED_DOMAIN if sign == " at " else DOMAIN).match(text, after)
        if not domain or (sign == "@" and text[after : after + 1].isdigit() and re.match(r"[\d.]+$", domain[0])):
            return None
        start = max(0, a - 80) + local.start()
        if start and text[start - 1] in "@/":
            return None
        if text[max(0, start - 1) : start] == "\\":
            start += 1
        return start, domain.end()

    @staticmethod
    def _address(text: str, a: int, b: int) -> tuple[int, int] | None:
        low = max(0, a - 60)
        for pattern in ADDRESSES:
            for m in pattern.finditer(text, low, min(len(text), b + 90)):
                if m.start() <= a + 1 and b - 1 <= m.end():
                    return m.start(), m.end()
                if m.start() > b:
                    break
        return None

    @staticmethod
    def _account(text: str, at: int) -> tuple[int, int] | None:
        """An account number by country, length and check digits, that begins two letters before `at`."""
        a = at - 2
        if a < 0 or not (text[a:at].isalpha() and text[a:at].isupper() and text[a:at].isascii()) or (a and (text[a - 1].isalnum() or text[a - 1] in "_-")):
            return None
        size = IBAN_LENGTHS.get(text[a:at])
        packed, i = "", a
        while size and i < len(text) and len(packed) < size:
            c = text[i]
            if c.isascii() and (c.isdigit() or c.isupper()):
                packed += c
            elif c not in " -" or text[i - 1] in " -":
                return None
            i += 1
        if not size or len(packed) < size or text[i : i + 1].isalnum():
            return None
        return (a, i) if int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1 else None

    @staticmethod
    def _cued(text: str, at: int, cues: list[tuple[int, int]], reach: int = CUE_REACH) -> bool:
        """Does a cue stand shortly before, with no digits between?"""
        return any(b <= at <= b + reach and not any(c.isdigit() or c == "\n" for c in text[b:at]) for _, b in cues)

    @staticmethod
    def _number(text: str, at: int, end: int, cues: dict[int, list[tuple[int, int]]]) -> tuple[int, int, str] | None:
        """A phone, identity, card or account number that begins at the digit `at` or just before."""
        a = at
        before = text[a - 1] if a else " "
        account = Finder._account(text, a)
        if account:
            return *account, ID_NUMBER
        for pattern in (INSURANCE, PASSPORT):
            for back in (2, 3):
                m = pattern.match(text, a - back) if a >= back else None
                if m and m.end() > a:
                    return m.start(), m.end(), ID_NUMBER
        if end - a < LEAST_RUN:
            return None
        if Finder._cued(text, a, cues[PHONE_CUE], 3):
            m = CUED_PHONE.match(text, a - (before == "("))
            if m and before != "+" and not text.startswith("(+", a - 2):
                return m.start(), m.end(), PHONE
        if not (before.isalnum() or before in "_@-#/+."):
            m = CARD.match(text, a)
            if m and luhn("".join(c for c in m[0] if c.isdigit())) and (m[1] or m[2] or Finder._cued(text, a, cues[CARD_CUE])):
                return m.start(), m.end(), ID_NUMBER
            m = CUED_ID.match(text, a) if Finder._cued(text, a, cues[ID_CUE]) else None
            if m:
                return m.start(), m.end(), ID_NUMBER
        if before == "+" or (before == "(" and a >= 2 and text[a - 2] == "+"):
            return Finder._international(text, a, a - (1 if before == "+" else 2), "")
        if text.startswith("00", a) and not (before.isalnum() or before in "._@/-:#"):
            found = Finder._international(text, a + 2, a, "00")
            if found:
                return found
        paren = before == "("
        outer = text[a - 2] if paren and a >= 2 else (" " if paren else before)
        if outer.isalnum() or outer in "_@-#/" or (outer in ".:" and a >= 2 and text[a - 2 - paren : a - 1 - paren].isdigit()):
            return None
        if not paren:
            for pattern in (SSN, BIRTH_NUMBER, ELEVEN):
                m = pattern.match(text, a)
                if m and not (pattern is ELEVEN and TECHNICAL.search(text, max(0, a - 16), a)):
                    return m.start(), m.end(), PHONE if pattern is ELEVEN and m[0][0] == "0" else ID_NUMBER
        m = NATIONAL.match(text, a - paren)
        if m:
            digits = sum(c.isdigit() for c in m[0])
            if 9 <= digits <= 12 or (digits == 8 and m[0][0] in "0("):
                return m.start(), m.end(), PHONE
        return None

    @staticmethod
    def _international(text: str, a: int, start: int, prefix: str) -> tuple[int, int, str] | None:
        digits, ends = "", []
        i = a
        while i < len(text) and len(digits) < 15:
            c = text[i]
            if c.isdigit() and c.isascii():
                digits += c
                ends.append(i + 1)
            elif c not in SEPARATORS or (i and text[i - 1] in "-./" and c in "-./"):
                break
            i += 1
        for size in (3, 2, 1):
            plan = PLANS.get(digits[:size])
            if not plan:
                continue
            code = size
            rest = len(digits) - code
            if code < len(digits) and digits[code] == "0" and "(0" in text[a : a + 8]:
                code += 1
                rest -= 1
            for n in range(min(rest, plan[1]), plan[0] - 1, -1):
                e = ends[code + n - 1]
                nxt = text[e : e + 2]
                if not nxt[:1].isdigit() and not (nxt[:1] == ":" and nxt[1:].isdigit()) and not nxt[:1].isalpha():
                    return start, e, PHONE
        if not prefix and 8 <= len(digits) <= 15 and digits[:1] != "0":
            e = ends[-1]
            if not text[e : e + 1].isalnum() and digits[:3] not in PLANS and digits[:2] not in PLANS and digits[:1] not in PLANS:
                return start, e, PHONE
        return None

    def _plain_lower(self, text: str, word: str, a: int, b: int) -> bool:
        """A listed name in lower case, without a cue, counts where plain words in lower
        case or the ends of the sentence stand around it; a tool's or file's name does not."""
        if word.lower() not in self.listed:
            return False
        before, after = re.search(r"(\S+)?([ \n])?$", text[max(0, a - 30) : a]), re.match(r"([.,;!?]?)(?:([ \n])(\S+)?|$)", text[b : b + 30])
        if not before or not after or (a and not before[2]):
            return False
        sides = [w.strip(".,;:!?\"") for w in (before[1], after[3]) if w]
        return all(w.isalpha() and w.islower() for w in sides) and bool(sides)

    @staticmethod
    def _person(text: str, low: str, a: int, b: int, kind: int) -> tuple[int, int] | None:
        """The capitalised words after a cue, if they can be a person."""
        m = PERSON.match(text, b)
        if not m or (low.startswith(("dr", "ms", "mr"), a) and any(c.isdigit() for c in text[max(0, a - 25) : a])):
            return None
        words, end = [], m.start(1)
        for w in re.finditer(r"\S+", m[1]):
            bare = w[0].lower().strip(".")
            if not (w[0][0].isupper() or (words and bare in ("van", "von", "de", "da", "del", "la", "der", "den", "bin", "al"))) or bare in NO_PERSON:
                break
            words.append(w[0])
            end = m.start(1) + w.end()
        if not words or not words[-1][0].isupper() or not any(len(w) > 2 and not w.isupper() for w in words) or text[end : end + 1] in CODE_AFTER:
            return None
        if any(c.isupper() for w in words for c in w[1:] if not w.isupper() and "-" not in w and "’" not in w and not w.startswith(("Mc", "Mac", "De", "La", "O'", "D'"))):
            return None
        following = text[end : end + 1]
        if text[end : end + 2].rstrip() and (following in ".:" and text[end + 1 : end + 2].isalnum() or following in "/\\"):
            return None  # a file, a host or a path
        if kind == GREETING and not (len(words) <= 3 and (not following or following in ",.!\n")):
            return None
        return m.start(1), end

    def _names(self, text: str, low: str, hits: list[tuple[int, int]], cues: list[tuple[int, int, int]], taken: list) -> list[tuple[int, int, str]]:
        good: list[tuple[int, int]] = []
        for a, b in sorted(hits):
            before, after = text[a - 1 : a] if a else "", text[b : b + 1]
            if before.isalnum() or after.isalnum() or before in CODE_BEFORE and before or after in CODE_AFTER and after:
                continue
            if (after in ".:" and after and (text[b + 1 : b + 2].isalnum() or text[b : b + 2] == "::")) or (
                before in ".:" and before and a >= 2 and (text[a - 2].isalnum() or text[a - 2] == ":") and not text[a - 2 : a] == "::" and before == "."
            ):
                continue
            if before == ":" and a >= 2 and text[a - 2] == ":":
                continue
            if any(x < b and a < y for x, y, _ in taken):
                continue
            word = text[a:b]
            if before == "-" or after == "-":  # double names only; a hyphen elsewhere is a tool's or file's
                other = next((h for h in hits if h[0] == b + 1 or h[1] == a - 1), None)
                if not other or not (text[other[0]].isupper() and word[0].isupper()):
                    continue
            if word[0].islower() and not BEFORE_LOWER_NAME.search(text, max(0, a - 24), a) and not self._plain_lower(text, word, a, b):
                continue
            good.append((a, b))
        for a, b, kind in cues:
            found = self._person(text, low, a, b, kind)
            if found and not self._inside(found, taken) and not any(x < found[1] and found[0] < y for x, y in good):
                good.append(found)
        good.sort()
        out: list[list[int]] = []
        for a, b in good:
            if out and JOINS_NAMES.fullmatch(text, out[-1][1], a):
                out[-1][1] = max(b, out[-1][1])
            elif not out or a >= out[-1][1]:
                out.append([a, b])
        return [(a, b, NAME) for a, b in out]


@lru_cache(maxsize=4)
def _finder(given: tuple[str, ...], family: tuple[str, ...]) -> Finder:
    """One finder a worker process and lexicon."""
    return Finder(list(given), list(family))


ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def unescape(raw: str) -> tuple[str, list[int], list[int]]:
    """A JSON text without its escapes, and where its stretches come from:
    positions in the result and, for each, the position in the raw text."""
    out, here, there, size, last = [], [0], [0], 0, 0
    for m in ESCAPE.finditer(raw):
        plain = raw[last : m.start()]
        char = chr(int(m[1], 16)) if m[1] else SIMPLE.get(m[2], m[2])
        out += (plain, char)
        size += len(plain)
        here += (size, size + 1)
        there += (m.start(), m.end())
        size += 1
        last = m.end()
    out.append(raw[last:])
    return "".join(out), here, there


def find_in(content: str, finder: Finder) -> list[tuple[int, int, str]]:
    """Spans in a content as stored: JSON block lists are read without their
    escapes, the spans still name positions of the stored text."""
    if "\\" in content and content.lstrip()[:1] == "[" and content.lstrip()[1:].lstrip()[:1] == "{":
        plain, here, there = unescape(content)

        def back(p: int, end: bool) -> int:
            k = bisect.bisect_right(here, p) - 1
            if end and here[k] == p and k:
                k -= 1
                return there[k] + (p - here[k]) if there[k] + (p - here[k]) <= there[k + 1] and p - here[k] != 1 else there[k + 1]
            return there[k] + p - here[k]

        return [(back(a, False), back(b, True), kind) for a, b, kind in finder.spans(plain)]
    return finder.spans(content)


def redact(content: str, finder: Finder) -> tuple[str, list[str]]:
    out, last, kinds = [], 0, []
    for a, b, kind in find_in(content, finder):
        if a < last:
            continue
        out += (content[last:a], PLACEHOLDER[kind])
        kinds.append(kind)
        last = b
    return "".join(out) + content[last:], kinds


def name_parts(lexicon: DataFrame) -> tuple[list[str], list[str]]:
    """Given and family parts of the closed list, its size checked first."""
    rows = lexicon.select("name_part", "part_kind").where("name_part is not null").limit(MOST_NAME_PARTS + 1).collect()
    if len(rows) > MOST_NAME_PARTS:
        raise ValueError(f"a name lexicon has at most {MOST_NAME_PARTS} parts")
    return [r[0] for r in rows if r[1] == "given"], [r[0] for r in rows if r[1] != "given"]


def redact_table(rows: DataFrame, lexicon: DataFrame, key: str, text: str, source: str, with_text: bool = True) -> DataFrame:
    """(source_table, row_key, kinds, content) of every row: the kinds found, in
    order of place and with repeats, and the text with placeholders.

    A null text gives null and no kinds; an empty one stays empty.  Rows are
    treated one by one where they are read, so repeated rows count each.
    """
    given, family = name_parts(lexicon)

    def run(batches):
        finder = _finder(tuple(given), tuple(family))
        for pdf in batches:
            keys, kinds, texts = pdf["row_key"], [], []
            for t in pdf["content"]:
                if not t:
                    kinds.append([])
                    texts.append(t)
                    continue
                clean, found = redact(t, finder)
                kinds.append(found)
                texts.append(clean)
            out = {"row_key": keys, "kinds": kinds}
            if with_text:
                out["content"] = texts
            yield pd.DataFrame(out)

    schema = "row_key string, kinds array<string>" + ", content string" * with_text
    picked = rows.select(rows[key].cast("string").alias("row_key"), rows[text].alias("content"))
    if not with_text:
        picked = picked.where("content is not null and content != ''")
    return spread(picked).mapInPandas(run, schema).select(F.lit(source).alias("source_table"), "*")


def found_kinds(rows: DataFrame, lexicon: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(source_table, row_key, pii_kind), once per row and kind found."""
    found = redact_table(rows, lexicon, key, text, source, with_text=False)
    return found.select("source_table", "row_key", F.explode(F.array_distinct("kinds")).alias("pii_kind"))
