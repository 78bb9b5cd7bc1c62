"""Re-ranking of candidate hits by weighted factors.

Candidates are rows (query_id, url, title, content, ...). The corpus of a query
is its own candidate set. No step gathers a query's candidates in one task: the
corpus figures are partial aggregates, and ordering is left to ``top_k`` or to a
global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scores as S
from ..functions.text import let
from .joins import join_small
from .score import SCORE_DECIMALS, top_k



def rank_order() -> list:
    """Best first; equal ranking scores by relevance, then url."""
    return [F.col("ranking_score").desc(), F.col("score").desc(), F.col("url")]


def with_query_words(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Add ``terms``, the words each candidate's query is ranked by."""
    words = queries.select("query_id", S.query_words("query").alias("terms"))
    return join_small(candidates, words, ["query_id"], spread=["url"], bound=queries)


def corpus_figures(worded: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query (query_id, n_docs, dfs): candidates, and those holding each term.

    ``dfs`` follows the order of ``terms``; it is as long as the query.
    """
    found = let(
        F.lower(F.col("content")),
        lambda text: F.transform("terms", lambda t: F.contains(text, t).cast("int")),
    )
    per_term = (
        worded.select("query_id", F.posexplode(found).alias("at", "hit"))
        .groupBy("query_id", "at")
        .agg(F.count("*").alias("n_docs"), F.sum("hit").alias("df"))
    )
    return per_term.groupBy("query_id").agg(
        F.max("n_docs").alias("n_docs"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("at", "df"))), lambda s: s["df"]
        ).alias("dfs"),
    )


def with_corpus(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates with ``terms``, ``n_docs`` and ``dfs`` of their query."""
    worded = with_query_words(candidates, queries)
    figures = corpus_figures(worded, queries)
    return join_small(
        worded, figures, ["query_id"], how="left", spread=["url"], bound=queries
    )


def term_figures(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Per candidate and query term: tf, df, idf and tf-idf."""
    pairs = F.zip_with(
        "terms", "dfs", lambda t, d: F.struct(t.alias("term"), d.alias("df"))
    )
    # a word repeated in the query has one figure
    distinct = F.array_distinct(pairs)
    tfs = S.term_frequencies(F.col("content"), F.transform(distinct, lambda p: p["term"]))
    figures = F.zip_with(
        distinct,
        tfs,
        lambda p, tf: F.struct(
            p["term"].alias("term"), F.coalesce(tf, F.lit(0.0)).alias("tf"), p["df"].alias("df")
        ),
    )
    idf = S.inverse_document_frequency(F.col("n_docs"), F.col("df"))
    return (
        with_corpus(candidates, queries)
        .select("query_id", "url", "n_docs", F.inline(figures))
        .select("query_id", "url", "term", "tf", "df", idf.alias("idf"))
        .withColumn("tf_idf", F.col("tf") * F.col("idf"))
    )


def rank_results(
    candidates: DataFrame,
    queries: DataFrame,
    as_of: float,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Add ``ranking_score`` and ``score_breakdown`` to each candidate."""
    w = S.merge_weights(weights)
    corpus = with_corpus(candidates, queries)
    terms = F.col("terms")
    headings = F.col("headings") if "headings" in candidates.columns else F.lit("")
    base = F.col("score") if "score" in candidates.columns else F.lit(0.0)
    dfs = F.coalesce(F.col("dfs"), F.array().cast("array<bigint>"))
    parts = {
        "title_score": S.field_score(terms, F.col("title")),
        "content_score": S.content_score(terms, F.col("content"), F.col("n_docs"), dfs),
        "meta_score": S.field_score(terms, F.col("meta_description")),
        "heading_score": S.field_score(terms, headings),
        "url_score": S.url_score(terms, F.col("url")),
        "freshness_score": S.freshness_score(F.col("crawl_time"), as_of),
        "content_length_score": S.content_length_score(F.col("content_length")),
        "depth_penalty": S.depth_penalty(F.col("depth")),
    }
    scored = corpus.withColumn(
        "score_breakdown", F.struct(*[c.alias(n) for n, c in parts.items()])
    )
    part = {n: F.col("score_breakdown")[n] for n in parts}
    total = (
        part["title_score"] * w["title_match"]
        + part["content_score"] * w["content_match"]
        + part["meta_score"] * w["meta_description_match"]
        + part["heading_score"] * w["heading_match"]
        + part["url_score"] * w["url_match"]
        + part["freshness_score"] * w["freshness"]
        + part["content_length_score"] * w["content_length"]
        - part["depth_penalty"] * abs(w["depth_penalty"])
    )
    return scored.select(
        *candidates.columns,
        F.round(total + F.coalesce(base, F.lit(0.0)), SCORE_DECIMALS).alias(
            "ranking_score"
        ),
        "score_breakdown",
    )


def best_ranked(ranked: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` rows of each query by ranking, numbered by ``rank``."""
    return top_k(ranked.drop("rank"), limit, rank_order())
