"""Personal data: fixed patterns on the text as it is, and the same patterns on a deobfuscated copy mapped back.

The transducer rewrites a text piece by piece (look-alike characters, invisible characters, "at" and "dot" disguises,
spelled digits) and remembers for every rewritten piece where it came from, so that what is found in the copy is
reported in code points of the source.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from veriquill.llm.common import bounded_batches, id_field, map_batches

KINDS = ("email", "ip", "card", "phone")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A failing start inside a run of digits fails for the whole run, so only the first digit of a run is tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; each has one at sign, so the scan goes from one to the next."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        local = text[free:at]
        start = free + len(local.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        free = m.end() if m else at + 1  # no match holds an earlier at sign
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted: what the four patterns find, failing matches dropped, none retried."""
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        # no retries: the first three parts are followed by a dot and the last is taken whole
        spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    spans.sort()
    return spans


# Letters of other scripts that are drawn like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ℓ": "l", "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ",
}
# Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
# digits' names in English, German, French and Spanish, in that order, for 0 to 9.
DIGIT_NAMES = (
    ("zero", "oh", "null", "zéro", "cero"),
    ("one", "eins", "un", "uno"),
    ("two", "zwei", "zwo", "deux", "dos"),
    ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"),
    ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
# How an at sign and a dot are disguised, and the words for a plus sign.
AT_WORDS, DOT_WORDS, PLUS_WORDS = ("at", "arobase", "arroba"), ("dot", "punkt", "point", "punto"), ("plus", "más")

# Words that follow "at" in ordinary prose and name no host.
NO_HOST = ("the", "a", "an", "this", "that", "these", "those", "my", "your", "our", "their", "his", "her", "its", "any", "some", "each", "every", "one", "least", "most", "all")

NAMED = {name: str(d) for d, names in enumerate(DIGIT_NAMES) for name in names}
_NAME = "|".join(sorted(NAMED, key=lambda n: (-len(n), n)))
_AT, _DOT, _PLUS = "|".join(AT_WORDS), "|".join(DOT_WORDS), "|".join(PLUS_WORDS)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
#: White space around a disguise, however much of it. A run of blanks is entered at its beginning only and never given
#: back, so that reading stays linear in the text.
_GAP, _LEAD = r"\s*+", r"(?:(?<!\s)\s++)?"
#: A digit or its name, for runs of three or more of which one at least is spelled.
_UNIT = rf"(?:\b(?:{_NAME})\b|[0-9])"
RUN = rf"(?:\b(?:{_PLUS})\b[\s-]*+)?{_UNIT}(?:(?:[\s,-]*+|\s++(?:{_DOT})\s++){_UNIT}){{2,}}"
BARE_AT = rf"(?<=\w)\s++(?:{_AT})\s++(?!(?:{'|'.join(NO_HOST)})\b)(?=[\w-]++(?:\s++(?:{_DOT})\s|{_GAP}{_OPEN}{_GAP}(?:{_DOT}|\.)|\.\w))"
STAGES = re.compile(
    rf"(?P<at>{_LEAD}{_OPEN}{_GAP}(?:{_AT}|@){_GAP}{_CLOSE}{_GAP})"
    rf"|(?P<dot>{_LEAD}{_OPEN}{_GAP}(?:{_DOT}|\.){_GAP}{_CLOSE}{_GAP})"
    rf"|(?P<bareat>{BARE_AT})"
    rf"|(?P<baredot>(?<=\w)\s++(?:{_DOT})\s++(?=\w))"
    rf"|(?P<spaced>(?<=\w)\s++@{_GAP}(?=\w)|(?<=\w)@\s++(?=\w++\.\w))"
    rf"|(?P<run>{RUN})",
    re.I,
)
UNIT = re.compile(rf"(?P<plus>\b(?:{_PLUS})\b)|\b(?P<name>{_NAME})\b|(?P<digit>[0-9])", re.I)


def _ascii_of(c: str) -> str | None:
    """What a character is rewritten to; None if it stays."""
    if c in INVISIBLE:
        return ""
    if (new := LOOKALIKES.get(c)) is not None:
        return new
    if c.isascii():
        return None
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    new = unicodedata.normalize("NFKC", c)
    return new if new.isascii() else None


#: Every character that is rewritten, and to what.
FOLDED = {c: new for c in map(chr, range(0x80, sys.maxunicode + 1)) if (new := _ascii_of(c)) is not None}
#: A text can only hold something new if it has one of these characters, one of these patterns matches, or one of these words
#: stands in it.
ODD = frozenset(FOLDED)
BRACKETED = re.compile(rf"{_OPEN}{_GAP}(?:{_AT}|{_DOT}|@|\.){_GAP}{_CLOSE}", re.I)
SPACED_AT = re.compile(r"\s@|@\s")
HOST_AT = re.compile(BARE_AT, re.I)
WORD = re.compile(r"\w+")
SPELLED = re.compile(RUN, re.I)
ATS, DOTS, UNITS = frozenset(AT_WORDS), frozenset(DOT_WORDS), frozenset([*NAMED, *PLUS_WORDS])


class Copy:
    """A rewritten text and, for each of its pieces, where the piece stood in the source."""

    def __init__(self, source: str):
        self.source, self.parts, self.starts, self.origins, self.length, self.read = source, [], [], [], 0, 0

    def keep(self, upto: int) -> None:
        """Copy the source up to there as it is."""
        if upto > self.read:
            self._add(self.source[self.read : upto], self.read, None)
            self.read = upto

    def put(self, text: str, upto: int) -> None:
        """Write text in place of the source up to there."""
        if text:
            self._add(text, self.read, upto)
        self.read = upto

    def _add(self, text: str, start: int, end: int | None) -> None:
        self.parts.append(text)
        self.starts.append(self.length)
        self.origins.append((start, end))
        self.length += len(text)

    def text(self) -> str:
        return "".join(self.parts)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a non-empty span of the copy; a rewritten piece counts whole."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        (a, to), (b, upto) = self.origins[i], self.origins[j]
        return a if to is not None else a + start - self.starts[i], upto if upto is not None else b + end - self.starts[j]


def fold_characters(text: str) -> Copy:
    """First transducer: look-alikes and compatibility forms to ASCII, invisible characters to nothing."""
    out = Copy(text)
    if odd := ODD.intersection(text):
        for m in re.finditer(f"[{''.join(map(re.escape, sorted(odd)))}]", text):
            out.keep(m.start())
            out.put(FOLDED[m[0]], m.end())
    out.keep(len(text))
    return out


def fold_words(text: str) -> Copy:
    """Second transducer: disguised at signs and dots, and runs of spelled digits."""
    out = Copy(text)
    for m in STAGES.finditer(text):
        if m.lastgroup == "run":
            units = list(UNIT.finditer(text, m.start(), m.end()))
            if all(u["digit"] for u in units):
                continue
            for u in units:  # of what stands between the digits only a dot is kept
                if out.read < m.start():
                    out.keep(u.start())
                else:
                    out.put("." if WORD.search(text, out.read, u.start()) else "", u.start())
                out.put("+" if u["plus"] else u["digit"] or NAMED[lowered(u["name"])], u.end())
        else:
            out.keep(m.start())
            out.put("@" if m.lastgroup in ("at", "bareat", "spaced") else ".", m.end())
    out.keep(len(text))
    return out


def lowered(text: str) -> str:
    """Lower case as patterns without case see it, to which a dotted capital I is an i."""
    return text.lower().replace("i\u0307", "i")


def disguised(text: str) -> bool:
    """Whether a transducer may rewrite something; a text for which this is false is its own copy."""
    if not text.isascii() and not ODD.isdisjoint(text) or BRACKETED.search(text) or "@" in text and SPACED_AT.search(text):
        return True
    words = set(WORD.findall(lowered(text)))
    if not DOTS.isdisjoint(words) or not ATS.isdisjoint(words) and HOST_AT.search(text):
        return True
    return not UNITS.isdisjoint(words) and any(not all(u["digit"] for u in UNIT.finditer(m[0])) for m in SPELLED.finditer(text))


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only show in the deobfuscated copy, in source code points, sorted; none lies inside a base span."""
    if not disguised(text):
        return []
    first = fold_characters(text)
    second = fold_words(first.text())
    plain = second.text()
    if plain == text:
        return []
    found = set()
    for start, kind, end in base_spans(plain):
        a, b = second.back(start, end)
        a, b = first.back(a, b)
        while a < b and text[a].isspace():  # the blanks before a disguise belong to nothing
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        found.add((a, kind, b))
    ends: dict[int, list[tuple[int, int]]] = {}
    for a, kind, b in base:
        ends.setdefault(kind, []).append((a, b))
    out = []
    for a, kind, b in found:
        same = ends.get(kind, [])
        i = bisect_right(same, (a, float("inf"))) - 1  # base spans of a kind do not overlap
        if not (i >= 0 and same[i][1] >= b):
            out.append((a, kind, b))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added.

    A null text counts as empty and has no spans; repeated rows and null ids each give a row; an empty table gives an
    empty one; other columns are ignored. Offsets are code points of the source, end exclusive; spans that begin together
    stand in the order of their kinds. Texts are read whole, however long; every pattern is linear in the text. No shuffle.
    """
    schema = T.StructType(
        [id_field(df, id_col), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]
    )
    none = hashlib.sha256(b"").hexdigest()

    def make(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in schema}
        out[id_col] = batch.column(0)
        for text in batch.column(1).to_pylist():
            base = base_spans(text) if text else []
            more = added_spans(text, base) if text else []
            for k, name in enumerate(KINDS):
                out[f"n_{name}"].append(sum(s[1] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest() if base else none)
            out["spans"].append(written(sorted(base + more)))
            out["n_added"].append(len(more))
        return out

    return map_batches(df.select(df[id_col], df[text_col]), make, schema)


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; spans that touch the same characters become one."""
    base = base_spans(text)
    spans = sorted(base + added_spans(text, base))
    if not spans:
        return text
    out, read, i = [], 0, 0
    while i < len(spans):
        a, kind, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[read:a], f"[{KINDS[kind].upper()}]"]
        read = b
    return "".join([*out, text[read:]])


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with personal data in its text replaced; all rows and columns stay, length_col follows the new text.

    A null text stays null, an empty table empty.
    """

    bounded_batches(df.sparkSession)

    @pandas_udf(T.StringType())
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t) if t else t)

    out = df.withColumn(text_col, clean(df[text_col]))
    if length_col and length_col in df.columns:
        out = out.withColumn(length_col, F.length(out[text_col]).cast(df.schema[length_col].dataType))
    return out
