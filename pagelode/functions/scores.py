"""Ranking factors as column expressions.

``terms`` is an array of lower-cased query words. All term tests are substring
tests on lower-cased text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, split_words, word_count

# Default weights of the ranking factors.
DEFAULT_WEIGHTS = {
    "title_match": 3.0,
    "content_match": 1.0,
    "meta_description_match": 2.0,
    "heading_match": 2.5,
    "url_match": 1.5,
    "freshness": 1.0,
    "content_length": 0.5,
    "depth_penalty": -0.2,
}


def merge_weights(changes: dict[str, float] | None = None) -> dict[str, float]:
    """Default weights with some of them replaced; unknown names are refused."""
    unknown = set(changes or {}) - set(DEFAULT_WEIGHTS)
    if unknown:
        raise ValueError(f"unknown ranking weights: {sorted(unknown)}")
    return {**DEFAULT_WEIGHTS, **{k: float(v) for k, v in (changes or {}).items()}}


def query_words(query: Column | str) -> Column:
    """Words a query is ranked by: raw, lower-cased, split at white space."""
    return split_words(F.lower(query))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def occurrences(lowered: Column, term: Column) -> Column:
    """Number of non-overlapping occurrences of a non-empty term."""
    removed = F.length(lowered) - F.length(F.replace(lowered, term, F.lit("")))
    return removed / F.length(term)


def term_frequency(content: Column, term: Column) -> Column:
    """Occurrences per white-space separated word."""
    return F.get(term_frequencies(content, F.array(term)), F.lit(0))


def term_frequencies(content: Column, terms: Column) -> Column:
    """``term_frequency`` of each of ``terms``, in their order; the text is read once."""
    text = F.struct(
        F.lower(content).alias("lowered"),
        F.nullif(word_count(content), F.lit(0)).alias("words"),
    )
    return let(
        text,
        lambda t: F.transform(
            terms, lambda w: occurrences(t["lowered"], F.lower(w)) / t["words"]
        ),
    )


def inverse_document_frequency(n_docs: Column, df: Column) -> Column:
    """``ln(N / (df + 1))``; zero or negative for frequent terms."""
    return F.ln(n_docs / (df + 1))


def field_score(terms: Column, text: Column) -> Column:
    """Per term: 10 if it is the whole text, 5 as a word in it, 2 inside a word."""

    def score(lowered: Column) -> Column:
        padded = F.concat(F.lit(" "), lowered, F.lit(" "))
        return _sum(
            F.transform(
                terms,
                lambda t: F.when(t == lowered, 10.0)
                .when(F.contains(padded, F.concat(F.lit(" "), t, F.lit(" "))), 5.0)
                .when(F.contains(lowered, t), 2.0)
                .otherwise(0.0),
            )
        )

    return let(
        F.lower(F.coalesce(text, F.lit(""))),
        lambda lowered: F.when(lowered == "", 0.0).otherwise(score(lowered)),
    )


def content_score(
    terms: Column, content: Column, n_docs: Column, dfs: Column
) -> Column:
    """Sum over terms of occurrences x tf-idf x position bonus.

    ``dfs`` holds the document frequency of each term, in the order of ``terms``.
    The bonus falls from 1 at the start of the text to 0.5 at its end.
    """

    def score(text: Column) -> Column:
        lowered, words = text["lowered"], text["words"]

        def one(term: Column, df: Column) -> Column:
            found = F.instr(lowered, term) - 1
            bonus = F.when(found >= 0, 1.0 - found / text["length"] * 0.5).otherwise(1.0)
            return let(
                occurrences(lowered, term),
                lambda n: n * (n / words * inverse_document_frequency(n_docs, df)) * bonus,
            )

        return _sum(F.zip_with(terms, dfs, one))

    text = F.coalesce(content, F.lit(""))
    bound = F.struct(
        F.lower(text).alias("lowered"),
        F.length(text).alias("length"),
        F.nullif(word_count(text), F.lit(0)).alias("words"),
    )
    return let(
        bound,
        lambda t: F.when(t["length"] == 0, 0.0).otherwise(F.coalesce(score(t), F.lit(0.0))),
    )


def url_score(terms: Column, url: Column) -> Column:
    """Number of terms contained in the url."""
    return let(
        F.lower(F.coalesce(url, F.lit(""))),
        lambda u: F.size(F.filter(terms, lambda t: F.contains(u, t))).cast("double"),
    )


def freshness_score(crawl_time: Column, as_of: float) -> Column:
    """``exp(-age in days / 30)`` at the clock ``as_of`` (epoch seconds)."""
    seconds = F.unix_micros(crawl_time) / 1e6
    age_days = (F.lit(float(as_of)) - seconds) / 86400.0
    return F.when(crawl_time.isNull(), 0.0).otherwise(F.exp(-age_days / 30.0))


def content_length_score(length: Column) -> Column:
    """Bell curve around 1500 characters, fixed scores at both far ends."""
    distance = (length - 1500) / 750.0
    return (
        F.when(length.isNull() | (length == 0), 0.0)
        .when(length < 100, 0.1)
        .when(length > 10000, 0.3)
        .otherwise(F.exp(-(distance * distance) / 2.0))
    )


def depth_penalty(depth: Column) -> Column:
    return depth * 0.1
