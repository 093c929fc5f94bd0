"""Quality rules: a table of thresholds, compiled into one Spark projection.

All counts of a text and all ratios of the rules are column expressions; no user function, join or
shuffle is involved. Repeated word windows are found by 64-bit names of all 8-word windows of a text,
and only texts in which a name occurs twice are looked at any further.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.vectors import let
from orrery.llm.columns import SPACE

#: Symbols of n_symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window of n_repeat_words.
REPEAT = 8
#: Columns of ``counts``.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_letter_words")
# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for on with by this it as are be was from at or an "
    "der die das und ist nicht mit für auf von zu den ein eine im sich als "
    "le la les des et est que pour dans en un une du pas qui sur au de "
    "el los las y por con para se del al no su una lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if least <= ratio <= most; a null ratio passes."""

    name: str
    ratio: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are SQL over the counts of ``counts``.
RULES = (
    Rule("mean_word_length", "word_chars / nullif(n_words, 0)", 2.0, 14.0),
    Rule("symbol_ratio", "n_symbols / nullif(n_words, 0)", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words / nullif(n_words, 0)", 0.02, None),
    Rule("duplicate_line_ratio", "n_dup_lines / nullif(n_lines, 0)", None, 0.5),
    Rule("letter_word_ratio", "n_letter_words / nullif(n_words, 0)", 0.6, None),
)


def _free(name: str, columns: list[str]) -> str:
    """A column name that ``columns`` doesn't hold in any case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c))
    return text


def _words(text: Column) -> Column:
    """The words of a text that isn't null; white space at its ends leaves no empty pieces."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE + "+"))


def _covered(names: Column) -> Column:
    """Words that repeated windows cover, by the windows' names in order of their starts; the last
    REPEAT - 1 names are null. Names stand sorted next to their starts, and neighbours with one
    name are repeats."""
    placed = F.array_sort(F.filter(F.transform(names, lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: x["h"].isNotNull()))
    again = lambda p: F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]))
    starts = let(placed, lambda p: F.array_sort(F.transform(again(p), lambda x: x["i"])))
    gaps = let(starts, lambda s: F.transform(s, lambda x, k: F.least(F.coalesce(F.get(s, k + 1) - x, F.lit(REPEAT)), F.lit(REPEAT))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def _repeat_words(words: Column) -> Column:
    """Words in REPEAT-word windows that occur twice or more among an array's words. A text's
    windows are named in one pass; only texts with fewer names than windows are looked at further."""
    windows = F.size(words) - REPEAT + 1
    names = F.transform(words, lambda w, i: F.when(i < windows, F.xxhash64(w, *[F.get(words, i + k) for k in range(1, REPEAT)])))
    repeats = lambda n: F.when(F.size(F.array_distinct(n)) <= windows, _covered(n)).otherwise(0)  # noqa: E731  null is a name, too
    return F.when(windows > 1, let(names, repeats)).otherwise(0)


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` (text, further columns kept) with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines (lines with a word), n_stop_words and n_letter_words.

    A text's words are split once and bound within one expression, so that no array of them becomes a
    column: rows carry the text and numbers only. Columns named as the new ones are replaced."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.ltrim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)
    of_words = lambda w: F.array(
        F.size(w),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))),
        F.size(F.filter(w, lambda x: F.lower(x) != F.upper(x))),
        _repeat_words(w),
    )
    of_lines = lambda x: F.array(F.size(x), F.size(x) - F.size(F.array_distinct(x)))
    own = [c for c in docs.columns if c not in COUNTS]
    numbers, lined = _free("numbers", own), _free("lined", own)
    out = docs.select(*own).withColumns({numbers: let(_words(text), of_words), lined: let(lines, of_lines)})
    made = {
        "n_words": F.get(numbers, 0),
        "word_chars": F.length(_without(text, " \t\n\x0b\x0c\r")),
        "n_symbols": F.length(text) - F.length(_without(text, SYMBOLS)),
        "n_dup_lines": F.get(lined, 1),
        "n_repeat_words": F.get(numbers, 3),
        "n_lines": F.get(lined, 0),
        "n_stop_words": F.get(numbers, 1),
        "n_letter_words": F.get(numbers, 2),
    }
    return out.select(*own, *[c.cast("long").alias(name) for name, c in made.items()])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least_words: int = 20, most_repeat: int = 30) -> DataFrame:
    """``docs`` (text, further columns kept) with the counts, a ratio column for each rule,
    base_failed (too few words, or over ``most_repeat`` percent of them in repeated windows), failed (names of
    the failed rules) and kept (neither). Null and empty texts have no words and fail the base;
    repeated rows each get their verdict; columns named as the new ones are replaced."""
    made = [*COUNTS, *[r.name for r in rules], "base_failed", "failed", "kept"]
    out = counts(docs.drop(*made))
    out = out.withColumns({r.name: F.expr(f"({r.ratio})") for r in rules})
    bounds = {r.name: (F.coalesce(F.col(r.name) >= r.least, F.lit(True)) if r.least is not None else F.lit(True)) & (F.coalesce(F.col(r.name) <= r.most, F.lit(True)) if r.most is not None else F.lit(True)) for r in rules}
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in bounds.items()]), lambda x: x.isNotNull())
    base = (F.col("n_words") < least_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(most_repeat) * F.col("n_words"))
    out = out.withColumns({"base_failed": base, "failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
