"""Quality rules, line first: lines are judged and removed before documents are.

Every line with a word is held against punctuation, navigation and boilerplate rules.
Lines that fail are cut from the text, and a document that loses too large a share of
its words is rejected. Two figures of the whole document come first: too few words, or
too many words inside repeated five-word windows, reject it outright.

Built-in column functions only. Nothing is shuffled: each row is judged by itself, so
a hot source or repeated rows cost no more than others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, own_names, SPACE, text_or_empty

#: Fixed value of the contract: characters counted as symbols.
SYMBOLS = "[#*$%&|<>]+"
#: Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = [
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "enable javascript",
    "privacy policy",
    "terms of use",
    "terms of service",
    "subscribe to our newsletter",
    "click here to",
    "lorem ipsum",
    "skip to content",
    "share on facebook",
    "share on twitter",
]


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; shares are whole percent."""

    window: int = 5
    min_words: int = 10
    repeat_pct: int = 20  # words inside repeated windows, of all words
    symbol_pct: int = 30  # symbol characters for each word of a line
    exclaim_pct: int = 30  # words that end in two or more exclamation marks
    separators: int = 3  # bars, arrows and bullets that make a line navigation
    separator_pct: int = 25  # ... and how many for each word
    boilerplate_words: int = 30  # longer lines are text that mentions a phrase
    unended_words: int = 200  # a longer line without any sentence end fails
    min_kept_pct: int = 50  # words that must be left


def _count(line: Column, pattern: str) -> Column:
    """Characters of ``line`` inside matches of ``pattern``."""
    return F.length(line) - F.length(F.regexp_replace(line, pattern, ""))


def _line_words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, SPACE), ""))


def line_fails(line: Column, rules: LineRules) -> Column:
    """True for a line that breaks a rule; the line holds at least one word."""
    n = _line_words(line)
    symbols = _count(line, SYMBOLS)
    exclaims = F.size(F.split(line, r"!!+(?=[\x20\x09-\x0D]|$)")) - 1
    separators = F.size(F.split(line, "[|»•›]")) - 1
    punctuation = (
        (100 * symbols > rules.symbol_pct * n)
        | (100 * exclaims > rules.exclaim_pct * n)
        | ((n > rules.unended_words) & ~line.rlike(r"[.!?。！？…:;]"))
    )
    navigation = (separators >= rules.separators) & (
        100 * separators > rules.separator_pct * n
    )
    low = F.lower(line)
    phrase = F.lit(False)
    for text in BOILERPLATE:
        phrase = phrase | low.contains(text)
    return punctuation | navigation | (phrase & (n <= rules.boilerplate_words))


def _window_hashes(words: Column, window: int) -> Column:
    """One hash for each window of consecutive words."""
    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    return F.transform(
        starts, lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(window)])
    )


def _repeated(hashes: Column) -> Column:
    """Places of windows whose hash occurs twice or more, in order of the text."""
    at = F.sequence(F.lit(0), F.size(hashes) - 1)

    def marked(places):  # equal windows stand side by side
        same = lambda x, k: F.coalesce(F.get(places, k)["h"] == x["h"], F.lit(False))
        found = F.filter(places, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    return let(F.sort_array(F.arrays_zip(hashes.alias("h"), at.alias("i"))), marked)


def _covered(starts: Column, window: int) -> Column:
    """Words inside windows that begin at sorted ``starts``."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        starts,
        zero,
        lambda acc, i: F.struct(
            (acc["n"] + i + window - F.greatest(i, acc["end"])).alias("n"),
            (i + window).alias("end"),
        ),
    )["n"]


def repeated_words(words: Column, window: int) -> Column:
    """How many words stand inside windows that occur twice or more."""
    repeats = lambda h: F.size(F.array_distinct(h)) < F.size(h)
    count = lambda h: F.when(repeats(h), _covered(_repeated(h), window)).otherwise(0)
    return let(
        words,
        lambda w: F.when(
            F.size(w) >= window, let(_window_hashes(w, window), count)
        ).otherwise(0),
    )


@own_names
def quality_rules(
    df: DataFrame, text: str = "text", rules: LineRules = LineRules()
) -> DataFrame:
    """All columns of ``df`` and the struct ``quality`` (one of that name is replaced).

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed and kept (boolean), n_kept_words (long) and cleaned, the text without
    the failed lines; blank lines stay. Null and empty texts have no words, so they fail the base rules;
    ``cleaned`` is then empty. Repeated rows get the same verdict each; lines are
    compared as they stand, and the first of equal lines is no duplicate.
    """
    w = rules.window
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    kept = [c for c in df.columns if c != "quality"]
    base = df.select(*kept, text_or_empty(text).alias("_t"))
    split = base.withColumns(
        {
            "_w": F.array_remove(F.split("_t", SPACE), ""),
            "_l": F.split("_t", "\n"),
            "_symbols": _count(F.col("_t"), SYMBOLS),
        }
    )
    lined = split.withColumns(
        {
            "_lines": F.filter("_l", has_word),
            "_good": F.filter("_l", lambda x: ~has_word(x) | ~line_fails(x, rules)),
        }
    )
    n_words = F.size("_w")
    figures = lined.select(
        *kept,
        n_words.cast("long").alias("_n"),
        F.length(F.array_join("_w", "")).cast("long").alias("_chars"),
        F.col("_symbols").cast("long").alias("_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_dup"),
        repeated_words(F.col("_w"), w).cast("long").alias("_rep"),
        F.array_join("_good", "\n").alias("_clean"),
    )
    judged = figures.withColumns(
        {
            "_left": _line_words(F.col("_clean")).cast("long"),
            "_bad": (F.col("_n") < rules.min_words)
            | (100 * F.col("_rep") > rules.repeat_pct * F.col("_n")),
        }
    )
    keep = ~F.col("_bad") & (100 * F.col("_left") >= rules.min_kept_pct * F.col("_n"))
    return judged.select(
        *kept,
        F.struct(
            F.col("_n").alias("n_words"),
            F.col("_chars").alias("word_chars"),
            F.col("_symbols").alias("n_symbols"),
            F.col("_dup").alias("n_dup_lines"),
            F.col("_rep").alias("n_repeat_words"),
            F.col("_bad").alias("base_failed"),
            keep.alias("kept"),
            F.col("_left").alias("n_kept_words"),
            F.col("_clean").alias("cleaned"),
        ).alias("quality"),
    )
