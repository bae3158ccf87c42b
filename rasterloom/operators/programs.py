"""BASIC programs as relations: lines of text to tokens, links by running sums, and lines to one binary a program.

A line is read from left to right. Strings stay as they are, also where they are not closed; REM takes the rest of the line
and DATA all up to a colon outside of strings; of the keywords that fit, the longest one becomes its byte; any other character
stays itself. Characters that are not ASCII go. One pattern tells these parts apart, so that no state is carried by hand.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basic import CODES, KEYWORDS, START
from .blocks import running_sum
from .native import assemble, byte_hex

#: The parts of a line, as a pattern that more than one engine knows.
PARTS = r'(?is)"[^"]*"?|REM.*|DATA(?:"[^"]*"?|[^:"])*|' + "|".join(re.escape(w) for w in sorted(KEYWORDS, key=lambda w: (-len(w), w)) if w not in ("REM", "DATA")) + "|."


def _ascii_hex(text: Column) -> Column:
    return F.hex(F.encode(F.regexp_replace(text, r"[^\x00-\x7F]", ""), "US-ASCII"))


def tokens(text: Column) -> Column:
    """The bytes of a line after its number, in hex; null for null."""
    codes = F.create_map(*[x for word, code in CODES.items() for x in (F.lit(word), F.lit(f"{code:02X}"))])

    def told(part: Column) -> Column:
        upper = F.upper(part)
        rest = lambda word: F.concat(F.lit(f"{CODES[word]:02X}"), _ascii_hex(F.substring(part, F.lit(len(word) + 1), F.length(part))))
        return F.when(part.startswith('"'), _ascii_hex(part)).when(upper.startswith("REM"), rest("REM")).when(upper.startswith("DATA"), rest("DATA")).otherwise(F.coalesce(F.try_element_at(codes, upper), _ascii_hex(part)))

    return F.when(text.isNotNull(), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(PARTS), F.lit(0)), told), ""))


def linked_programs(lines: DataFrame, keys: tuple[str, ...], order: str, text: str = "text", start: int = START) -> DataFrame:
    """(keys, content): lines(keys, order, text) as tokenised programs, each line with the address of the next one.

    A line begins with its number; lines without one, or with one over 65535, are left out, also null ones. Lines keep the
    order of `order`, whatever their numbers are. Addresses are running sums of lengths, so a long program spreads. A program
    that would pass address 65535 is an error.
    """
    told = lines.select(*keys, order, F.btrim(text, F.lit(" \t")).alias("__text")).withColumn("__number", F.expr("try_cast(regexp_extract(__text, '^[0-9]+', 0) as bigint)"))
    body = F.btrim(F.regexp_replace("__text", "^[0-9]+", ""), F.lit(" \t"))
    numbered = told.where("__number <= 65535").withColumn("__hex", tokens(body))
    placed = running_sum(numbered.withColumn("__size", F.length("__hex") / 2 + 5).withColumn("__size", F.col("__size").cast("long")), "__size", (order,), keys, "__upto")
    following = F.col("__upto") + start
    checked = F.when(following <= 65535, following).otherwise(F.raise_error(F.lit("a program passes the last address")).cast("long"))
    word = lambda n: F.concat(byte_hex(n % 256), byte_hex(F.call_function("shiftright", n, F.lit(8))))
    parts = placed.select(*keys, F.floor(F.col("__upto") / 4096).alias("line"), F.col("__upto").alias("at"), F.concat(word(checked), word(F.col("__number")), "__hex", F.lit("00")).alias("hex"))
    return assemble(parts, keys, tail="0000")
