"""Quality rules: a threshold table compiled into Spark projections, evaluated without user functions.

Rows: one per input row. Null text counts as empty text. Repeated rows are judged each on their own. Input columns
whose names clash with the measures are replaced by the measures; all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, let, word_array

# Common function words of the corpus languages.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "le la les et des en un du une que est pour qui dans par plus pas au sur ne se "
    "el los las y del se una por con no su para al lo como más pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails when `numerator` is beyond `limit` times `denominator` (above it, or below it if `least`).

    `applies` names a measure that has to reach `applies_from` for the rule to speak at all.
    """

    name: str
    numerator: str
    denominator: str
    limit: float
    least: bool = False
    applies: str = "n_words"
    applies_from: int = 20


#: The production threshold table.
RULES = (
    Rule("symbols_to_words", "n_symbols", "n_words", 0.1),
    Rule("word_length_high", "word_chars", "n_words", 15.0),
    Rule("word_length_low", "word_chars", "n_words", 2.0, least=True),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.4, applies="n_lines", applies_from=8),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, least=True, applies_from=256),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", 0.9, applies="n_lines", applies_from=10),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", 0.3, applies="n_lines", applies_from=10),
)

WINDOW = 8


def _window_hashes(words: Column) -> Column:
    """From word hashes, one of each window of WINDOW (a power of two) words, by doubling: two of k words make one of 2k."""

    def doubled(hashes: Column, span: int) -> Column:
        if span == WINDOW:
            return F.slice(hashes, 1, F.size(hashes) - (WINDOW - 1))
        pairs = F.zip_with(hashes, F.slice(hashes, span + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))
        return let(pairs, lambda h: doubled(h, 2 * span))

    return F.when(F.size(words) < WINDOW + 1, F.array().cast("array<bigint>")).otherwise(doubled(words, 1))


def _covered(hashes: Column) -> Column:
    """How many words lie in a window whose hash is found twice or more."""

    def marked(ordered: Column) -> Column:
        # In hash order, equal neighbours mark both positions.
        same = F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        return let(same, lambda s: F.zip_with(ordered, F.zip_with(s, F.concat(F.array(F.lit(False)), s), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))), lambda a, hit: F.when(hit, a["i"])))

    def words_in(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    numbered = F.zip_with(hashes, F.sequence(F.lit(1), F.size(hashes)), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return let(F.sort_array(numbered), lambda ordered: let(F.sort_array(F.filter(marked(ordered), lambda i: i.isNotNull())), words_in))


def _parts(text: Column) -> tuple[Column, Column, dict[str, Column]]:
    """A struct of the measures of words, one of those of lines, and the other measures by name."""
    body = F.coalesce(text, F.lit(""))

    # Hashes of the stop words, also with a capital, so that words need not be folded; constants to the optimizer.
    stop_hashes = [F.xxhash64(F.lit(w)) for word in STOP_WORDS for w in (word, word.capitalize())]

    def of_words(words: Column) -> Column:
        # Words are compared by 64-bit hashes. A text without a repetition costs one hash set.
        repeats = let(_window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeats.cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda h: h.isin(stop_hashes))).cast("long").alias("n_stop_words"),
        )

    unspaced = body
    for space in SPACES:
        unspaced = F.replace(unspaced, F.lit(space), F.lit(""))

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: F.substring(x, 1, 1).isin("-", "*", "•", "‣", "·"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("…")))).cast("long").alias("n_ellipsis_lines"),
        )

    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = let(F.transform(word_array(text), lambda w: F.xxhash64(w)), of_words)
    by_name = {"word_chars": F.length(unspaced).cast("long"), "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long")}
    return words, let(lines, of_lines), by_name


OF_WORDS, OF_LINES = ("n_words", "n_repeat_words", "n_stop_words"), ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measures n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and those that only rules use."""
    words, lines, by_name = _parts(F.col(f"`{text}`"))
    of_words, of_lines = (name + "_" * max([len(c) for c in df.columns], default=0) for name in ("of_words", "of_lines"))
    staged = df.withColumns({of_words: words, of_lines: lines} | by_name)
    return staged.withColumns({c: F.col(of_words)[c] for c in OF_WORDS} | {c: F.col(of_lines)[c] for c in OF_LINES}).drop(of_words, of_lines)


def compile_rules(rules: tuple[Rule, ...] = RULES, measure: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """One boolean column per rule: true where the document fails it. measure: a measure by its name."""

    def failed(r: Rule) -> Column:
        bound = F.lit(float(r.limit)) * measure(r.denominator)
        beyond = measure(r.numerator) < bound if r.least else measure(r.numerator) > bound
        return (measure(r.applies) >= r.applies_from) & beyond

    return {r.name: failed(r) for r in rules}


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measures() plus base_failed, failed_rules (names, in table order) and kept.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. kept: neither base_failed nor any rule.
    """
    checks = compile_rules(rules)
    names = F.array(*[F.when(hit, F.lit(name)) for name, hit in checks.items()]) if checks else F.array().cast("array<string>")
    measured = measures(df, text).withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "failed_rules": F.array_compact(names),
        }
    )
    return measured.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def filter_quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that all rules keep, with df's own columns only.

    The predicate is one expression over lambda variables: one over columns would be pushed through their projection,
    and each mention of a measure would compute it again.
    """
    words, lines, by_name = _parts(F.col(f"`{text}`"))

    def verdict(m: Column) -> Column:
        at = lambda name: m["words" if name in OF_WORDS else "lines"][name] if name not in by_name else m[name]
        failed = (at("n_words") < 20) | (100 * at("n_repeat_words") > 30 * at("n_words"))
        for hit in compile_rules(rules, at).values():
            failed = failed | hit
        return ~failed

    return df.where(let(F.struct(words.alias("words"), lines.alias("lines"), *[c.alias(k) for k, c in by_name.items()]), verdict))
