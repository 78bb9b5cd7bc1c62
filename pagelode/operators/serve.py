"""Result pages and other outputs of a search.

Input rows are ranked hits; each query has at most ``rank`` limit of them, so
everything gathered per query is bounded by the page in question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_text
from .rank import best_ranked

PER_PAGE = 10


def paginate(ranked: DataFrame, page: int, per_page: int = PER_PAGE) -> DataFrame:
    """Page ``page`` (from 1) of each query's ranked hits, with their ``rank``."""
    first = (page - 1) * per_page + 1
    return best_ranked(ranked, page * per_page).filter(F.col("rank") >= first)


def page_info(ranked: DataFrame, page: int, per_page: int = PER_PAGE) -> DataFrame:
    """Per query: total hits, and whether pages lie before and after this one."""
    return ranked.groupBy("query_id").agg(
        F.count("*").alias("total"),
        F.lit(page > 1).alias("has_prev"),
        (F.count("*") > page * per_page).alias("has_next"),
    )


def _fixed(value: Column, decimals: int) -> Column:
    return F.call_function("format_number", value, F.lit("0." + "0" * decimals))


def display_rows(ranked: DataFrame) -> DataFrame:
    """Texts of a result list entry."""
    score = F.col("ranking_score")
    part = F.col("score_breakdown")
    described = F.coalesce(F.col("meta_description"), F.lit("")) != ""
    return ranked.select(
        "query_id",
        "url",
        F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"),
        F.when(described, F.col("meta_description"))
        .otherwise(
            F.concat(F.substring(F.coalesce("content", F.lit("")), 1, 200), F.lit("..."))
        )
        .alias("snippet"),
        F.when(F.coalesce(score, F.lit(0.0)) != 0, _fixed(score, 2)).alias("score_text"),
        _fixed(part["title_score"], 1).alias("title_text"),
        _fixed(part["content_score"], 1).alias("content_text"),
        _fixed(part["freshness_score"], 1).alias("freshness_text"),
    )


def answer_context(ranked: DataFrame, n: int = 3) -> DataFrame:
    """Source texts of the ``n`` best hits of each query, in rank order."""
    described = F.coalesce(F.col("meta_description"), F.lit("")) != ""
    text = F.when(described, F.col("meta_description")).otherwise(
        F.substring(F.coalesce("content", F.lit("")), 1, 300)
    )
    block = F.concat(
        F.lit("\n[Source "), F.col("rank").cast("string"), F.lit("]: "), text, F.lit("\n")
    )
    best = best_ranked(ranked, n).select("query_id", "rank", block.alias("block"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", "block")))
    return best.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["block"]), "").alias("context")
    )


def to_envelope(results: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query: (query_id, query, results, total, error).

    ``results`` are numbered by ``rank`` and already cut to the wanted limit. A
    blank query has an error and no results.
    """
    fields = [c for c in results.columns if c not in ("query_id", "rank")]
    hits = results.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("results")
    )
    blank = clean_text(F.coalesce("query", F.lit(""))) == ""
    return queries.join(hits, "query_id", "left").select(
        "query_id",
        clean_text("query").alias("query"),
        "results",
        F.when(~blank, F.coalesce(F.size("results"), F.lit(0))).alias("total"),
        # fixed value: the answer to an empty query
        F.when(blank, F.lit("Query parameter is required")).alias("error"),
    )
