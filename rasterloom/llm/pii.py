"""Personal data in whole texts, also when disguised.

Base spans come from the text as it stands. Two transducers then rewrite disguises one after the other: the first folds
homoglyphs, compatibility forms and invisible characters, the second spelled digits and at/dot phrases. Each keeps for a
rewritten piece the characters it stands for; the same detectors run on what comes out, and what they find is mapped back
through both to source characters. Base spans stay; an added span overlaps a base span of its kind only where it holds it
whole. Offsets are code points, ends exclusive.

Null or empty text has no spans. One row per input row: repeated rows, null ids and extra columns do no harm (only the
id and the text are read). All work is linear in the text, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, str, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Anchored at each @, so a long run without one costs nothing; a local part may not reach into the match before."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def detect(text: str) -> list[Span]:
    """(start, kind, end) of each kind, leftmost and not overlapping within a kind; failing matches are dropped."""
    found = [(a, "email", b) for a, b in _emails(text)] if "@" in text else []
    found += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    found += [(m.start(), "card", m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        found += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(
    zip(
        "асеорхуіјѕһԁԛԝАВЕКМНОРСТХУІЈЅԌαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡℓ",
        "aceopxyijshdqwABEKMHOPCTXYIJSGaeiknoptuxABEZHIKMNOPTYXigl",
        strict=True,
    )
)
_LOOKALIKES |= {"․": ".", "。": ".", "｡": ".", "．": ".", "‧": ".", "·": ".", "∙": ".", "•": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹢": "+", "＋": "+"}
_INVISIBLE = "­​‌‍⁠﻿"
# Digit words.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Top-level domains that a bare "at ... dot ..." phrase has to end in.
_TOP = frozenset("com org net edu gov mil int info biz name io co ai app dev me tv uk us de fr es it nl be ch at se no dk fi pl pt ru eu ca au nz jp cn in br mx example test invalid".split())

_WORD = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_AT_WORD, _DOT_WORD = r"at|arroba|arobase|klammeraffe|@", r"dot|punkt|punto|point|\."
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_DOT_PHRASE = rf"(?:\s*{_OPEN}\s*(?:{_DOT_WORD})\s*{_CLOSE}\s*|\s+(?:dot|punkt|punto)\s+|\.)"
# A bracket or a letter opens every alternative, never a run of blanks: those around a bracket are taken by hand.
_PHRASES = re.compile(
    rf"(?P<at>{_OPEN}\s*(?:{_AT_WORD})\s*{_CLOSE})"
    rf"|(?P<dot>{_OPEN}\s*(?:{_DOT_WORD})\s*{_CLOSE})"
    rf"|(?P<bare_at>(?<=[a-z0-9])\s+(?:at|arroba|arobase)\s+(?=[a-z0-9-]+(?:{_DOT_PHRASE}[a-z0-9-]+)*?(?:\s*{_OPEN}\s*(?:{_DOT_WORD})\s*{_CLOSE}\s*|\s+(?:dot|punkt|punto)\s+)[a-z0-9-]))"
    rf"|(?P<spelled>(?:(?:\bplus\b|\+)\s*)?\b(?:{_WORD})\b(?:[\s,-]+(?:dot\s+|point\s+)?(?:{_WORD}|[0-9])\b){{3,}})"
    rf"|(?P<bare_dot>(?<=[a-z0-9])\s+(?:dot|punkt|punto)\s+(?=[a-z0-9]))",
    re.IGNORECASE,
)
_BARE_AT, _BRACKET = re.compile(r"\s(?:at|arroba|arobase)\s", re.IGNORECASE), re.compile(_OPEN)
_ODD = re.compile(r"[^\x00-\x7f]+")
_SPELLED_PART = re.compile(rf"\b(?P<digit>{_WORD})\b|(?P<dot>\b(?:dot|point)\b)|(?P<plus>\bplus\b|\+)|(?P<figure>[0-9])", re.IGNORECASE)
# Whether a case-folded text may hold something for the second transducer.
_MAYBE_PHRASE = re.compile(rf"{_OPEN}\s*(?:{_AT_WORD}|{_DOT_WORD})\s*{_CLOSE}|\s(?:dot|punkt|punto)\s")
_MAYBE_SPELLED = re.compile(rf"\b(?:{_WORD})[\s,-]+(?:dot\s+|point\s+)?(?:{_WORD}|[0-9])\b[\s,-]+(?:dot\s+|point\s+)?(?:{_WORD}|[0-9])\b")


def _may_hold_phrases(text: str) -> bool:
    folded = text.casefold()
    return bool(_MAYBE_PHRASE.search(folded) or _MAYBE_SPELLED.search(folded))




def _plain(c: str) -> str:
    """The ASCII form of a homoglyph or compatibility form, "" for an invisible character, c itself for others."""
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() else c


_odd: dict[str, str] = {}


def _is_odd(text: str) -> bool:
    """Whether some character has a plain form; one dictionary look-up for each distinct character."""
    if text.isascii():
        return False
    for c in set(text):
        if c > "\x7f":
            if c not in _odd:
                _odd[c] = _plain(c)
            if _odd[c] != c:
                return True
    return False


class _Rewritten:
    """A rewritten text and its pieces: where each begins in it, and the range of the text before that it stands for. A piece
    as long as its range maps character by character."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.begins: list[int] = []
        self.froms: list[int] = []
        self.tos: list[int] = []
        self.size = 0

    def put(self, piece: str, a: int, b: int) -> None:
        if piece:
            self.out.append(piece)
            self.begins.append(self.size)
            self.froms.append(a)
            self.tos.append(b)
            self.size += len(piece)

    def back(self, a: int, b: int) -> tuple[int, int]:
        """The range that the characters a .. b - 1 stand for."""
        i, j = bisect_right(self.begins, a) - 1, bisect_right(self.begins, b - 1) - 1
        start = self.froms[i] + (a - self.begins[i] if self._even(i) else 0)
        return start, self.froms[j] + (b - self.begins[j]) if self._even(j) else self.tos[j]

    def _even(self, k: int) -> bool:
        return self.tos[k] - self.froms[k] == len(self.out[k])

    def text(self) -> str:
        return "".join(self.out)


def fold_characters(text: str) -> _Rewritten:
    """The first transducer: the plain forms of odd characters."""
    made, last = _Rewritten(), 0
    for m in _ODD.finditer(text):
        for at in range(*m.span()):
            c = text[at]
            if c not in _odd:
                _odd[c] = _plain(c)
            if _odd[c] != c:
                made.put(text[last:at], last, at)
                made.put(_odd[c], at, at + 1)
                last = at + 1
    made.put(text[last:], last, len(text))
    return made


def fold_phrases(text: str) -> _Rewritten:
    """The second transducer: at/dot phrases, with the blanks around them, and spelled digits."""
    made, last = _Rewritten(), 0
    for m in _PHRASES.finditer(text):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind in ("at", "dot"):
            while start > last and text[start - 1].isspace():
                start -= 1
            while end < len(text) and text[end].isspace():
                end += 1
        start = max(start, last)
        made.put(text[last:start], last, start)
        if kind == "spelled":
            for part in _SPELLED_PART.finditer(text, start, end):
                digit = {"digit": _DIGIT_WORDS.get(part[0].casefold(), ""), "dot": ".", "plus": "+", "figure": part[0]}[part.lastgroup]
                made.put(digit, part.start(), part.end())
        else:
            made.put("@" if kind.endswith("at") else ".", start, end)
        last = end
    made.put(text[last:], last, len(text))
    return made


def _added(text: str, base: list[Span]) -> list[Span]:
    folded = fold_characters(text) if _is_odd(text) else None
    plain = folded.text() if folded else text
    phrased = fold_phrases(plain) if _may_hold_phrases(plain) else None
    if not (folded or phrased):
        return []
    by_kind = {k: sorted((a, b) for a, kind, b in base if kind == k) for k in KINDS}
    added = []
    read = phrased.text() if phrased else plain
    for a, kind, b in detect(read):
        start, end = phrased.back(a, b) if phrased else (a, b)
        bare = kind == "email" and _BARE_AT.search(plain, start, end) and not _BRACKET.search(plain, start, end)
        if bare and read[a:b].rpartition(".")[2].lower() not in _TOP:
            continue
        start, end = folded.back(start, end) if folded else (start, end)
        own = by_kind[kind]
        # A base span inside it is a part of the disguised one; any other overlap is the base span's.
        touching = [(x, y) for x, y in own[max(0, bisect_right(own, (start, -1)) - 1) : bisect_right(own, (end, -1))] if x < end and start < y]
        if not any((x, y) == (start, end) or not (start <= x and y <= end) for x, y in touching):
            added.append((start, kind, end))
    return added


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """The base spans and the added ones."""
    base = detect(text or "")
    return base, _added(text or "", base)


def _join(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


SCHEMA = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for text in part.column(1):
                base, added = scan(text.as_py())
                rows.append((*(sum(kind == k for _, kind, _ in base) for k in KINDS), hashlib.sha256(_join(base).encode()).hexdigest(), _join(base + added), len(added)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.string()), pa.array(columns[6], pa.int64())],
                names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, the base counts by kind, the digest of the base spans, all spans, n_added."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan_batches, SCHEMA).withColumnRenamed("id", id_col)
