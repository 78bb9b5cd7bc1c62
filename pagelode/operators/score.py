"""Relevance scores, best hits, and the fields a hit carries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.shards import align_shards, shard_column
from ..functions.text import clean_query, snippet
from ..session import stage
from .analyze import TEXT_FIELDS, Analyzer
from .joins import deal_by, join_small
from .match import MASK_BITS, covers_all_terms, look_up, match_by_document, match_phrase, match_prefix

# Scores are compared at this many decimals: the order of hits then does not
# depend on the order in which partial sums arrive.
SCORE_DECIMALS = 6

# The fields of a hit.
HIT_FIELDS = [
    "url",
    "title",
    "content",
    "meta_description",
    "content_length",
    "crawl_time",
    "depth",
]


def weigh_terms(
    query_terms: DataFrame,
    term_stats: DataFrame,
    field_stats: DataFrame,
    field_weights: dict[str, float] | None = None,
) -> DataFrame:
    """Query terms with all that scoring needs besides the posting itself.

    idf = ln(N / (df + 1)) + 1. Terms that occur nowhere drop out. The statistics
    go to the query side, so the postings see a single join.
    """
    keys = query_terms.select("field", "term").distinct()
    # few distinct query terms: the vocabulary is reduced to them first
    known = join_small(term_stats, keys, ["field", "term"], "left_semi")
    weight = F.lit(1.0)
    for field, value in (field_weights or {}).items():
        weight = F.when(F.col("field") == field, float(value)).otherwise(weight)
    idf = F.ln(F.col("n_docs") / (F.col("df") + 1)) + 1
    stats = (
        known.join(F.broadcast(field_stats), "field")  # one row per field
        .withColumn("idf", idf * weight)
        .select("field", "term", "idf", "avg_len")
    )
    # a word that very many queries share spreads over the salts
    return join_small(
        query_terms, stats, ["field", "term"], spread=["query_id"], bound=query_terms
    )


def bm25_share(k1: float, b: float) -> Column:
    """Share of a posting joined with its weighted term."""
    tf = F.col("tf")
    norm = 1 - b + b * F.col("field_len") / F.col("avg_len")
    return F.col("idf") * tf * (k1 + 1) / (tf + k1 * norm)


def posting_scores(
    postings: DataFrame, weighted: DataFrame, query_terms: DataFrame, k1: float, b: float
) -> DataFrame:
    """BM25 share of each matching posting."""
    return match_by_document(postings, weighted, bound=query_terms).select(
        "query_id", "n_terms", "term_no", "url", bm25_share(k1, b).alias("share")
    )


def bm25(
    postings: DataFrame,
    query_terms: DataFrame,
    term_stats: DataFrame,
    field_stats: DataFrame,
    k1: float = 1.2,
    b: float = 0.75,
    field_weights: dict[str, float] | None = None,
    require_all: bool = True,
) -> DataFrame:
    """Score (query_id, url, score) summed over terms and fields.

    Matching and scoring share one aggregation. With ``require_all`` a document
    must match every term in some field, else any term is enough.
    """
    weighted = weigh_terms(query_terms, term_stats, field_stats, field_weights)
    shares = posting_scores(postings, weighted, query_terms, k1, b)
    score = F.round(F.sum("share"), SCORE_DECIMALS).alias("score")
    if not require_all:
        return shares.groupBy("query_id", "url").agg(score)
    masks, covered = covers_all_terms(query_terms)
    grouped = shares.groupBy("query_id", "n_terms", "url").agg(score, *masks)
    return grouped.filter(covered).select("query_id", "url", "score")


def clause_units(
    clauses: DataFrame, analyzer: Analyzer = Analyzer(), fields: list[str] = TEXT_FIELDS
) -> DataFrame:
    """What each clause of a query asks of a document, numbered within the query.

    ``clauses``: (query_id, clause_no, occur, kind, text); occur is ``must``, ``should``
    or ``must_not``, kind ``term``, ``phrase`` or ``prefix``. Every word of a term clause
    is a unit of its own, a phrase is one unit, a prefix (its last word) too. Clauses
    without a word ask nothing. Result: (query_id, unit, occur, kind, words).
    """
    cleaned = clauses.withColumn("clean", clean_query("text")).filter("clean != ''")
    tokens = analyzer.tokens("clean")
    last = F.element_at(F.filter(F.split(F.lower("clean"), " "), lambda w: w != ""), -1)
    groups = (
        F.when(F.col("kind") == "term", F.transform(tokens, lambda w: F.array(w)))
        .when(F.col("kind") == "phrase", F.filter(F.array(tokens), lambda p: F.size(p) > 0))
        .otherwise(F.array(F.array(last)))
    )
    rows = cleaned.select("query_id", "clause_no", "occur", "kind", F.posexplode(groups).alias("n", "words"))
    # a query has few clauses: as many as its author wrote
    by_place = Window.partitionBy("query_id").orderBy("clause_no", "n")
    numbered = rows.withColumn("unit", F.row_number().over(by_place) - 1)
    return numbered.select("query_id", "unit", "occur", "kind", "words")


def _unit_terms(units: DataFrame, analyzer: Analyzer, fields: list[str]) -> DataFrame:
    """Words of units as each field is indexed: (key, n_terms, field, term_no, term)."""
    per_field = units.select(
        F.struct("query_id", "unit", "occur").alias("query_id"),
        F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"),
        F.col("words").alias("tokens"),
    )
    return analyzer.with_terms(per_field).select(
        "query_id", "field", F.size("terms").alias("n_terms"),
        F.posexplode("terms").alias("term_no", "term"),
    )


def scored_matches(
    postings: DataFrame,
    clauses: DataFrame,
    term_stats: DataFrame,
    field_stats: DataFrame,
    analyzer: Analyzer = Analyzer(),
    fields: list[str] = TEXT_FIELDS,
    k1: float = 1.2,
    b: float = 0.75,
    prefix_score: float = 1.0,
) -> DataFrame:
    """Documents that meet a query's clauses, with their score: (query_id, url, score).

    A document must meet every ``must`` unit and no ``must_not`` unit; without a
    ``must`` unit it has to meet one that ``should``. A word is met by any field, a phrase
    within one field, a prefix by any term that starts with it. A word scores its BM25
    share in each field it occurs in; a phrase those of its words in each field that holds
    it; a prefix a fixed score. Terms, phrases and prefixes meet in one aggregation that
    sums scores and tests the coverage by one bit a unit.
    """
    units = stage(clause_units(clauses, analyzer, fields), "units")
    of_kind = lambda kind: units.filter(F.col("kind") == kind)

    words = _unit_terms(of_kind("term"), analyzer, fields)
    weighted = weigh_terms(words, term_stats, field_stats)
    met = [posting_scores(postings, weighted, words, k1, b).select("query_id", "url", "share")]

    phrase_words = _unit_terms(of_kind("phrase"), analyzer, fields)
    places = match_phrase(postings, phrase_words, term_stats)
    holding = places.select("query_id", "url", "field").distinct()
    heavy = weigh_terms(phrase_words, term_stats, field_stats)
    # documents that hold a phrase are few beside the postings of its words
    wanted = stage(join_small(holding, heavy, ["query_id", "field"], bound=phrase_words), "phrase-words")
    in_phrase = look_up(postings, wanted).select("query_id", "url", bm25_share(k1, b).alias("share"))
    met.append(deal_by(in_phrase, "url", postings))

    heads = of_kind("prefix").select(
        F.struct("query_id", "unit", "occur").alias("query_id"), F.get("words", F.lit(0)).alias("prefix")
    )
    for field in fields:
        found = match_prefix(postings, heads, field, term_stats)
        met.append(found.select("query_id", "url", F.lit(None).cast("double").alias("share")))

    rows = reduce(DataFrame.unionByName, met).select("query_id.*", "url", "share")
    longest = units.agg(F.max("unit")).first()[0] or 0
    masks = longest // MASK_BITS + 1
    word, bit = F.expr(f"unit div {MASK_BITS}"), F.expr(f"shiftleft(1L, unit % {MASK_BITS})")
    no_bit = F.lit(0).cast("long")

    def bits(occur: str, m: int):
        here = (F.col("occur") == occur) & (word == m)
        return F.bit_or(F.when(here, bit).otherwise(no_bit))

    prefixed = F.col("share").isNull() & (F.col("occur") != "must_not")
    grouped = rows.groupBy("query_id", "url").agg(
        F.sum(F.when(F.col("occur") != "must_not", F.coalesce("share", F.lit(0.0)))).alias("_sum"),
        *[bits("must", m).alias(f"_must{m}") for m in range(masks)],
        # a prefix counts once a document, whatever the number of fields
        *[F.bit_or(F.when(prefixed & (word == m), bit).otherwise(no_bit)).alias(f"_pre{m}") for m in range(masks)],
        F.max(F.col("occur") == "must_not").alias("_not"),
        F.max(F.col("occur") != "must_not").alias("_any"),
    )
    needed = units.groupBy("query_id").agg(F.count(F.when(F.col("occur") == "must", 1)).alias("_needed"))
    total = lambda name: sum((F.bit_count(f"{name}{m}") for m in range(masks)), F.lit(0))
    judged = join_small(grouped, needed, ["query_id"], spread=["url"], bound=clauses)
    covered = ~F.col("_not") & F.col("_any") & (total("_must") == F.col("_needed"))
    score = F.coalesce("_sum", F.lit(0.0)) + total("_pre") * F.lit(prefix_score)
    return judged.filter(covered).select(
        "query_id", "url", F.round(score, SCORE_DECIMALS).alias("score")
    )


def top_k(scored: DataFrame, k: int, order: list | None = None) -> DataFrame:
    """Best ``k`` rows per query with their ``rank`` from 1; ties by url.

    Up to Spark's own limit (1000 rows by default) the rank limit also works before
    the shuffle: each task sends at most ``k`` rows per query, so a query that matches
    most of the corpus stays cheap.
    """
    order = order or [F.col("score").desc(), F.col("url")]
    window = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(window)).filter(
        F.col("rank") <= k
    )


def hit_store(documents: DataFrame) -> DataFrame:
    """The fields of a hit that ``documents`` have; content is cut to a snippet.

    Stored beside the index, it keeps whole contents out of the join with hits.
    """
    shard = [c for c in [shard_column(documents)] if c]
    fields = [
        snippet("content").alias(f) if f == "content" else f
        for f in HIT_FIELDS
        if f in documents.columns
    ]
    return documents.select(*fields, *shard)


def project_hits(
    store: DataFrame,
    hits: DataFrame,
    queries: DataFrame | None = None,
    per_query: int = 1,
) -> DataFrame:
    """Stored fields of each hit, from a ``hit_store``.

    Given ``queries``, the size probe uses that there are at most ``per_query``
    hits for each of them instead of computing the hits.
    """
    hits, shard = align_shards(store, hits, "url")
    on = [*shard, "url"]
    joined = join_small(store, hits, on, bound=queries, times=per_query)
    extra = [c for c in hits.columns if c not in on]
    return joined.select(*extra, *[f for f in HIT_FIELDS if f in store.columns])
