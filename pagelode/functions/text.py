"""Column helpers for plain text: whitespace, tokens, entities.

Every pattern here avoids the engine-dependent ``\\s`` / ``\\w`` classes and
spells the character set out, so the same text gives the same tokens whatever
regex library reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as white space.
WHITESPACE = (
    r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# The rest of Unicode but for the plain space; frequent ranges first.
NOT_WHITESPACE = (
    r"\x{21}-\x{7E}\x{A1}-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}"
    r"\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}"
    r"\x{00}-\x{08}\x{0E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}"
)

# The characters that make up a word.
WORD = r"\p{L}\p{N}_"

# A token is a run of word characters; single dots inside it do not split it
# ("3.14", "a.b"). The possessive quantifiers keep the match linear.
TOKEN_PATTERN = rf"[{WORD}]++(?:\.[{WORD}]++)*+"

# Default English stop list of the analyzer.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "have", "if",
    "in", "is", "it", "may", "not", "of", "on", "or", "tbd", "that", "the", "this",
    "to", "us", "we", "when", "will", "with", "yet", "you", "your",
]

# Characters a query keeps besides words and white space.
QUERY_OPERATORS = "\"'+\\-*()"

# Entities decoded without leaving the JVM, "&amp;" last.
COMMON_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&nbsp;": "\u00a0",
    "&copy;": "©",
    "&reg;": "®",
    "&middot;": "·",
    "&laquo;": "«",
    "&raquo;": "»",
    "&ndash;": "–",
    "&mdash;": "—",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&bull;": "•",
    "&hellip;": "…",
    "&amp;": "&",
}

# Matches an entity that COMMON_ENTITIES does not cover.
RARE_ENTITY = (
    "&(?!(?:"
    + "|".join(e[1:-1] for e in COMMON_ENTITIES)
    + ");)(?:#[0-9xX]|[A-Za-z])"
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used.

    Inside a lambda Spark shares no common subexpressions, so a value used many
    times would be computed, and its expression tree copied, as many times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(text: Column | str) -> Column:
    """Collapse each white-space run to one space and strip both ends.

    A run that is one plain space already is not matched.
    """
    runs = rf"[^\x{{20}}{NOT_WHITESPACE}][{WHITESPACE}]*+|\x{{20}}[{WHITESPACE}]++"
    return F.trim(F.regexp_replace(text, runs, " "))


def split_words(text: Column | str) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(text, rf"[{WHITESPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of white-space separated words.

    In clean text the words are one more than the spaces; only other text is split.
    """
    unclean = rf"[^\x{{20}}{NOT_WHITESPACE}]|\x{{20}}\x{{20}}|^\x{{20}}|\x{{20}}$"
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return (
        F.when(text == "", 0)
        .when(text.rlike(unclean), F.size(split_words(text)))
        .otherwise(spaces + 1)
    )


def clean_query(query: Column | str) -> Column:
    """Keep words, white space and ``" ' + - * ( )``; blank out the rest."""
    kept = rf"[^{WORD}{WHITESPACE}{QUERY_OPERATORS}]"
    return clean_text(F.regexp_replace(query, kept, " "))


def tokens(
    text: Column | str,
    stop_words: list[str] | None = None,
    min_length: int = 2,
    pattern: str = TOKEN_PATTERN,
) -> Column:
    """Lower-cased tokens in text order, short tokens and stop words dropped."""
    stop = STOP_WORDS if stop_words is None else stop_words
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))

    def keep(word: Column) -> Column:
        long_enough = F.length(word) >= min_length
        return long_enough & ~word.isin(list(stop)) if stop else long_enough

    return F.filter(words, keep)


def decode_common_entities(text: Column) -> Column:
    """Decode the entities of COMMON_ENTITIES; skip texts without ``&``."""
    pairs = F.split(
        F.lit("\n".join(f"{e} {c}" for e, c in COMMON_ENTITIES.items())), "\n"
    )

    def decode_one(plain: Column, pair: Column) -> Column:
        return F.replace(
            plain, F.substring_index(pair, " ", 1), F.substring_index(pair, " ", -1)
        )

    return let(
        text,
        lambda plain: F.when(
            F.contains(plain, F.lit("&")), F.aggregate(pairs, plain, decode_one)
        ).otherwise(plain),
    )


def headings_text(headings: Column | str) -> Column:
    """Heading texts joined by one space."""
    return F.array_join(F.transform(headings, lambda h: h["text"]), " ")


def crawl_timestamp(epoch_seconds: Column | str) -> Column:
    """Epoch seconds as a timestamp; a missing time is the epoch itself."""
    seconds = F.col(epoch_seconds) if isinstance(epoch_seconds, str) else epoch_seconds
    return F.timestamp_seconds(F.coalesce(seconds, F.lit(0.0)))


def snippet(content: Column | str, size: int = 300) -> Column:
    """First ``size`` characters and ``...``, or the whole text if it fits."""
    text = F.col(content) if isinstance(content, str) else content
    return F.when(
        F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))
    ).otherwise(text)
