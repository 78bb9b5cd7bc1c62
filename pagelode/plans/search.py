"""The whole search: clean, match, score, project, re-rank, cut."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.match import analyze_queries
from ..operators.rank import best_ranked, rank_results
from ..operators.score import bm25, project_hits, top_k
from ..session import stage
from .index import SearchIndex


def search(
    index: SearchIndex,
    queries: DataFrame,
    as_of: float,
    limit: int = 10,
    enable_ranking: bool = True,
    weights: dict[str, float] | None = None,
    require_all: bool = True,
    fields: list[str] | None = None,
) -> DataFrame:
    """Best ``limit`` hits for each of ``queries`` (query_id, query).

    The cheap relevance score picks ``2 * limit`` candidates per query; only those
    are fetched and re-ranked. Candidates are written to the shared folder once,
    so neither ranking pass repeats the index scan.
    """
    options = {"fields": fields} if fields else {}
    terms = analyze_queries(queries, index.analyzer, **options)
    scored = bm25(
        index.postings, terms, index.term_stats, index.field_stats, require_all=require_all
    )
    hits = top_k(scored, 2 * limit)
    found = stage(
        project_hits(index.hits, hits, queries=queries, per_query=2 * limit),
        "candidates",
    )
    if not enable_ranking:
        return top_k(found.drop("rank"), limit)
    return best_ranked(rank_results(found.drop("rank"), queries, as_of, weights), limit)
