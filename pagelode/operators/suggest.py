"""Query completions and popular terms, both from title terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.shards import align_shards
from ..functions.text import split_words
from .joins import join_small
from .match import match_prefix
from .score import top_k


def suggest(
    documents: DataFrame,
    postings: DataFrame,
    term_stats: DataFrame,
    prefixes: DataFrame,
    limit: int = 5,
) -> DataFrame:
    """Up to ``limit`` title words per prefix: (query_id, word, rank).

    The first ``2 * limit`` documents (by url) with a title term of that prefix
    offer the words of their titles that start with the prefix and are longer.
    ``documents`` needs url and title alone: a ``hit_store`` will do.
    """
    prefixes = prefixes.withColumn("prefix", F.lower("prefix"))
    found = match_prefix(postings, prefixes, "title", term_stats)
    first = top_k(found, 2 * limit, [F.col("url")]).drop("rank")
    first, shard = align_shards(documents, first, "url")
    titled = join_small(
        documents, first, [*shard, "url"], bound=prefixes, times=2 * limit
    ).select("query_id", F.explode(split_words(F.lower("title"))).alias("word"))
    words = join_small(titled, prefixes, ["query_id"], spread=["word"]).filter(
        F.startswith("word", "prefix") & (F.length("word") > F.length("prefix"))
    )
    return top_k(words.select("query_id", "word").distinct(), limit, [F.col("word")])


def popular_terms(term_stats: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent title terms of more than three characters: (term, df)."""
    return (
        term_stats.filter((F.col("field") == "title") & (F.length("term") > 3))
        .select("term", "df")
        .orderBy(F.col("df").desc(), "term")
        .limit(limit)
    )
