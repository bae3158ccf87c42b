"""BASIC program text to the tokenised form of eight-bit Apple computers."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import DataFrame

# Keywords in token order, from 0x80.
KEYWORDS = (
    "END FOR NEXT DATA INPUT DEL DIM READ GR TEXT PR# IN# CALL PLOT HLIN VLIN HGR2 HGR HCOLOR= HPLOT DRAW XDRAW HTAB HOME ROT= SCALE= SHLOAD TRACE "
    "NOTRACE NORMAL INVERSE FLASH COLOR= POP VTAB HIMEM: LOMEM: ONERR RESUME RECALL STORE SPEED= LET GOTO RUN IF RESTORE & GOSUB RETURN REM STOP ON WAIT "
    "LOAD SAVE DEF POKE PRINT CONT LIST CLEAR GET NEW TAB( TO FN SPC( THEN AT NOT STEP + - * / ^ AND OR > = < SGN INT ABS USR FRE SCRN( PDL POS SQR RND LOG "
    "EXP COS SIN TAN ATN PEEK LEN STR$ VAL ASC CHR$ LEFT$ RIGHT$ MID$"
).split()
CODES = {word: 0x80 + k for k, word in enumerate(KEYWORDS)}
# Longest keyword first; blanks between its characters are not looked for.
_PART = re.compile(r'"[^"]*"?|' + "|".join(re.escape(w) for w in sorted(KEYWORDS, key=len, reverse=True)) + r"|\s+|.", re.IGNORECASE | re.DOTALL)
START = 0x0801


def tokenise_line(text: str) -> bytes:
    """The bytes of a line after its number. Strings, what follows REM, and DATA up to a colon stay as they are; blanks
    elsewhere are dropped; other characters are upper-cased."""
    out, at = bytearray(), 0
    raw = lambda s: s.encode("ascii", "replace")
    while at < len(text):
        part = _PART.match(text, at)[0]
        at += len(part)
        code = CODES.get(part.upper())
        if part[0] == '"':
            out += raw(part)
        elif code is None:
            out += raw(part.upper()) if not part.isspace() else b""
        else:
            out.append(code)
            if part.upper() == "REM":
                out += raw(text[at:])
                break
            if part.upper() == "DATA":
                end = re.compile(r'(?:"[^"]*"?|[^:"])*').match(text, at).end()
                out += raw(text[at:end])
                at = end
    return bytes(out)


def link(lines: list[tuple[int, bytes]], start: int = START) -> bytes:
    """Lines (number, bytes) as a program: each begins with the address of the next, two zero bytes end it."""
    out, at = bytearray(), start
    for number, body in lines:
        at += len(body) + 5
        out += struct.pack("<HH", at, number) + body + b"\0"
    return bytes(out) + b"\0\0"


def tokenise(source: str) -> bytes:
    """A whole program; lines without a number are left out, and lines keep their order."""
    found = (re.match(r"\s*(\d+)\s*(.*)", line) for line in source.splitlines())
    return link([(int(m[1]), tokenise_line(m[2])) for m in found if m])


def tokenise_programs(programs: DataFrame, text: str = "text") -> DataFrame:
    """programs with the column `content`, the tokenised bytes; null text gives null."""

    def work(batches):
        for batch in batches:
            content = pd.Series([None if s is None else tokenise(s) for s in batch[text]], dtype=object)
            yield batch.assign(content=content)

    schema = ", ".join(f"`{c}` {t}" for c, t in programs.dtypes if c != "content")
    return programs.drop("content").mapInPandas(work, f"{schema}, content binary")


def remarks(text: str, width: int = 232, end: int = 0x9600) -> list[bytes]:
    """A whole text as REM lines: lines over `width` go on in the next, and what would pass `end` in the next program."""
    programs, lines, at = [], [], START
    for line in text.splitlines() or [""]:
        for k in range(0, max(len(line), 1), width):
            body = tokenise_line("REM " + line[k : k + width])
            if at + len(body) + 7 > end:
                programs.append(link(lines))
                lines, at = [], START
            lines.append((10 * (len(lines) + 1), body))
            at += len(body) + 5
    return [*programs, link(lines)]


def remark_programs(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, part, content): the programs of each whole text, numbered from 0; null text gives null."""

    def work(batches):
        for batch in batches:
            rows = [(k, n, c) for k, s in zip(batch[key], batch[text], strict=True) for n, c in enumerate([None] if s is None else remarks(s))]
            yield pd.DataFrame({key: pd.Series([r[0] for r in rows], dtype=object), "part": [r[1] for r in rows], "content": pd.Series([r[2] for r in rows], dtype=object)})

    return texts.select(key, text).mapInPandas(work, f"`{key}` {dict(texts.dtypes)[key]}, part long, content binary")


def slideshow(names: list[str], pause: int = 3000) -> str:
    """A program that shows each picture in turn, again and again."""
    lines = ['10 D$ = CHR$(4)', "20 HGR : POKE 49234,0"]
    for k, name in enumerate(names):
        lines += [f'{100 + 10 * k} PRINT D$;"BLOAD {name},A$2000" : FOR I = 1 TO {pause} : NEXT I']
    return "\n".join([*lines, f"{100 + 10 * len(names)} GOTO 100"])
