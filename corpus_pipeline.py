"""From raw documents to token ids: five stages, each written and read again.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return
the columns of ``docs``; ``n_chars`` follows a text that a stage changes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelode.llm.bpe import bpe_round_trip
from pagelode.llm.common import table
from pagelode.llm.decontaminate import decontaminate
from pagelode.llm.ngram_join import one_of_each
from pagelode.llm.pii import find_pii, sanitise
from pagelode.llm.quality_rules import quality_rules
from pagelode.llm.queries import bpe_digests
from pagelode.session import stage

#: SQL has no byte-pair encoding; the tests hold the stages against plain Python.
ORACLE_SQL = None


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail them."""
    # a row number keeps the filter above the rules, which then run once for each row
    judged = quality_rules(docs).withColumn("_row", F.monotonically_increasing_id())
    kept = judged.filter("quality.kept AND _row >= 0")
    return _with_text(kept.withColumn("text", F.col("quality.cleaned")), docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect."""
    return one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items do not contaminate."""
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return judged.filter("not contamination.contaminated").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks."""
    return _with_text(sanitise(find_pii(docs)), docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, with the digests of ids and decoded text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe_round_trip(docs.select("doc_id", "text"), path)
    return bpe_digests(coded, "ids")


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("personal data", pii_stage),
    ("byte-pair encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
