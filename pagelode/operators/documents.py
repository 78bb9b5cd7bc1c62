"""Changing and counting sets of current documents (one row per url)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .joins import join_small


def upsert_documents(current: DataFrame, updates: DataFrame) -> DataFrame:
    """``current`` with the rows of ``updates`` in place of those of equal url."""
    urls = updates.select("url").distinct()
    kept = join_small(current, urls, ["url"], how="left_anti", bound=updates.select("url"))
    return kept.unionByName(updates.select(*current.columns))


def delete_documents(current: DataFrame, urls: DataFrame) -> DataFrame:
    """``current`` without the given urls."""
    return join_small(current, urls.select("url"), ["url"], how="left_anti")


def index_stats(current: DataFrame) -> DataFrame:
    """Number of documents."""
    return current.agg(F.count("*").alias("document_count"))
