"""Finding documents for a table of queries.

One query and a million queries are the same plan. Query terms are rows
(query_id, term_no, n_terms, field, term); the postings are scanned once and
joined with them. The query side is broadcast if a probe shows it small, else the
join is salted by url so that a term found in a third of all documents spreads
over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.shards import align_shards
from ..functions.text import clean_query
from ..session import stage
from .analyze import TEXT_FIELDS, Analyzer
from .joins import HELD_TOGETHER, deal_by, fits_broadcast, join_small, shuffle_join

TERM_KEY = ["field", "term"]
MASK_BITS = 62
#: The last code point: not a character, so no term has it.
_AFTER_ALL = "\U0010ffff"


def with_clean_query(queries: DataFrame) -> DataFrame:
    """Add ``clean``; queries with nothing left are dropped."""
    return queries.withColumn("clean", clean_query("query")).filter("clean != ''")


def analyze_queries(
    queries: DataFrame, analyzer: Analyzer = Analyzer(), fields: list[str] = TEXT_FIELDS
) -> DataFrame:
    """Terms of each query in the form each field is indexed under.

    A repeated word counts once. ``n_terms`` is the number of distinct words.
    """
    words = with_clean_query(queries).select(
        "query_id", F.array_distinct(analyzer.tokens("clean")).alias("words")
    )
    per_field = words.select(
        "query_id",
        F.size("words").alias("n_terms"),
        F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"),
        F.col("words").alias("tokens"),
    )
    return analyzer.with_terms(per_field).select(
        "query_id", "n_terms", "field", F.posexplode("terms").alias("term_no", "term")
    )


def match_terms(
    postings: DataFrame, query_terms: DataFrame, bound: DataFrame | None = None
) -> DataFrame:
    """Postings joined with the query terms that look for them.

    ``bound`` may name a cheaper frame that has at least the rows of
    ``query_terms``; the size probe reads that one.
    """
    wanted = query_terms.filter(F.length("term") > 0)
    wanted, shard = align_shards(postings, wanted, "term")
    return join_small(postings, wanted, TERM_KEY + shard, spread=["url"], bound=bound)


def match_by_document(
    postings: DataFrame, query_terms: DataFrame, bound: DataFrame | None = None
) -> DataFrame:
    """``match_terms`` without positions, all rows of a url in one task.

    The postings of the terms asked for are dealt by url, each once; only then do the
    queries join that ask for them. A word of very many queries costs no shuffle for
    each, and what groups by query and url runs inside the parts.
    """
    wanted = query_terms.filter(F.length("term") > 0)
    aligned, shard = align_shards(postings, wanted, "term")
    narrow = postings.drop("positions", *shard)
    if not fits_broadcast(wanted if bound is None else bound):
        return shuffle_join(postings, aligned, TERM_KEY + shard, spread=["url"]).select(
            *narrow.columns, *[c for c in wanted.columns if c not in TERM_KEY]
        )
    terms = aligned.select(*TERM_KEY, *shard).distinct()
    found = postings.join(F.broadcast(terms), TERM_KEY + shard, "left_semi")
    dealt = deal_by(found.select(*narrow.columns), "url", postings)
    return dealt.join(F.broadcast(wanted), TERM_KEY)


def look_up(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Postings joined with the (field, term, url) of ``wanted``.

    If those are too many for a broadcast, only the postings of their terms travel.
    """
    wanted, shard = align_shards(postings, wanted, "term")
    on = [*TERM_KEY, "url", *shard]
    if fits_broadcast(wanted, HELD_TOGETHER):
        return postings.join(F.broadcast(wanted), on)
    terms = wanted.select(*TERM_KEY, *shard).distinct()
    few = join_small(postings, terms, [*TERM_KEY, *shard], "left_semi")
    # by its size in files Spark would broadcast it after all
    return few.join(wanted.hint("merge"), on)


def match_field(postings: DataFrame, query_terms: DataFrame, field: str) -> DataFrame:
    """Documents whose ``field`` holds a term: (query_id, term_no, url, tf)."""
    one_field = postings.filter(F.col("field") == field)
    matched = match_by_document(one_field, query_terms.filter(F.col("field") == field))
    return matched.select("query_id", "n_terms", "term_no", "field", "url", "tf")


def match_multi(
    postings: DataFrame, query_terms: DataFrame, fields: list[str] = TEXT_FIELDS
) -> DataFrame:
    """Documents holding a term in any of ``fields``: (query_id, term_no, url)."""
    chosen = F.col("field").isin(fields)
    matched = match_by_document(postings.filter(chosen), query_terms.filter(chosen))
    return matched.groupBy("query_id", "n_terms", "term_no", "url").agg(
        F.count("*").alias("n_fields")
    )


def covers_all_terms(query_terms: DataFrame) -> tuple[list, object]:
    """Aggregates and a test that a group of matches covers every query term.

    Each term sets one bit, so matching stays a plain hash aggregation with
    map-side combining; the number of mask words follows the longest query.
    """
    longest = query_terms.agg(F.max("n_terms")).first()[0] or 1
    words = (longest + MASK_BITS - 1) // MASK_BITS
    bit = F.expr(f"shiftleft(1L, term_no % {MASK_BITS})")
    word = F.expr(f"term_no div {MASK_BITS}")
    masks = [
        F.bit_or(F.when(word == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"_m{w}")
        for w in range(words)
    ]
    found = sum((F.bit_count(f"_m{w}") for w in range(words)), F.lit(0))
    return masks, found == F.col("n_terms")


def match_all(matches: DataFrame, query_terms: DataFrame) -> DataFrame:
    """Documents that match every term of the query: (query_id, url)."""
    masks, covered = covers_all_terms(query_terms)
    grouped = matches.groupBy("query_id", "n_terms", "url").agg(*masks)
    return grouped.filter(covered).select("query_id", "url")


def match_any(matches: DataFrame) -> DataFrame:
    """Documents that match at least one term: (query_id, url)."""
    return matches.select("query_id", "url").distinct()


def match_exclude(matched: DataFrame, excluded: DataFrame) -> DataFrame:
    """Matched documents without those found by the excluded terms."""
    return matched.join(
        excluded.select("query_id", "url").distinct(), ["query_id", "url"], "left_anti"
    )


def match_phrase(
    postings: DataFrame, phrases: DataFrame, term_stats: DataFrame
) -> DataFrame:
    """Places where all words of a phrase follow each other in one field.

    ``phrases``: (query_id, n_terms, field, term_no, term), term_no from 0, words
    may repeat. Result: (query_id, url, field, start).

    The rarest word of a phrase names the candidate documents and the starts they
    allow; a phrase with a word that ``term_stats`` lacks has none. Its next rarest word,
    looked up in those documents, leaves few; every other word is looked up in what is
    left, and its positions are intersected with the starts inside the row. Positions of
    common words are never laid out as rows.
    """
    # the vocabulary grows with the corpus: it is reduced to the phrases' words first
    asked = phrases.select(*TERM_KEY).distinct()
    stats = join_small(term_stats, asked, TERM_KEY, "left_semi", bound=phrases)
    known = join_small(
        phrases, stats, TERM_KEY, spread=["query_id", "term_no"], bound=phrases
    )
    whole = (
        known.groupBy("query_id", "field", "n_terms")
        .agg(F.sort_array(F.collect_list(F.struct("df", "term_no", "term"))).alias("words"))
        .filter("size(words) = n_terms")
    )
    rarest = F.col("words")[0]
    first = whole.select("query_id", "field", "n_terms", rarest["term"].alias("term"), rarest["term_no"].alias("term_no"), "words")
    shifted = F.transform("positions", lambda p: p - F.col("term_no"))
    candidates = match_terms(postings, first, bound=phrases).select(
        "query_id", "field", "n_terms", "url", "words",
        F.filter(shifted, lambda p: p >= 0).alias("starts"),
    )
    # the probes and all uses below read them: written once
    candidates = stage(candidates, "phrase-candidates")
    key = ["query_id", "field", "n_terms", "url"]
    left = _beside_next_rarest(postings, candidates, key)
    wanted = left.select(*key, "starts", F.inline(F.expr("slice(words, 2, n_terms - 1)")))
    hits = (
        look_up(postings, wanted)
        .select(*key, F.array_intersect("starts", shifted).alias("starts"))
        .filter("size(starts) > 0")
        .groupBy(*key)
        .agg(F.collect_list("starts").alias("all"))
        .filter("size(all) = n_terms - 1")
    )
    common = F.expr("aggregate(all, all[0], (a, b) -> array_intersect(a, b))")
    several = hits.select("query_id", "url", "field", F.explode(common).alias("start"))
    single = candidates.filter("n_terms = 1").select(
        "query_id", "url", "field", F.explode("starts").alias("start")
    )
    return several.unionByName(single)


def _beside_next_rarest(postings: DataFrame, candidates: DataFrame, key: list) -> DataFrame:
    """Candidates with their phrase's next rarest word where some start allows it."""
    longer = candidates.filter("n_terms > 1")
    following = F.col("words")[1]
    wanted = longer.select(*key, "starts", following["term"].alias("term"), following["term_no"].alias("term_no"))
    places = F.transform("positions", lambda p: p - F.col("term_no"))
    beside = look_up(postings, wanted).filter(F.arrays_overlap("starts", places)).select(*key)
    beside = stage(beside, "phrase-pairs").distinct()
    same = [longer[c].eqNullSafe(beside[c]) for c in key]
    few = F.broadcast(beside) if fits_broadcast(beside, HELD_TOGETHER) else beside.hint("merge")
    return stage(longer.join(few, same, "left_semi"), "phrase-left")


def phrase_terms(
    queries: DataFrame, analyzer: Analyzer = Analyzer(), fields: list[str] = TEXT_FIELDS
) -> DataFrame:
    """Words of each query as one phrase; unlike query terms they may repeat."""
    words = with_clean_query(queries).select(
        "query_id",
        F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"),
        analyzer.tokens("clean").alias("tokens"),
    )
    return analyzer.with_terms(words).select(
        "query_id",
        "field",
        F.size("terms").alias("n_terms"),
        F.posexplode("terms").alias("term_no", "term"),
    )


def expand_prefixes(terms: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows of ``terms`` joined with every prefix their ``term`` starts with.

    An equi-join on the leading characters: each term offers its first n
    characters for every prefix length in use, so terms and prefixes are never
    compared pairwise. The prefixes' range is a filter that a vocabulary sorted by
    term can use.
    """
    prefixes = prefixes.filter(F.length("prefix") > 0)
    found = prefixes.agg(
        F.min("prefix").alias("low"),
        F.max(F.concat("prefix", F.lit(_AFTER_ALL))).alias("high"),
        F.collect_set(F.length("prefix")).alias("lengths"),
    ).first()
    if found["lengths"]:
        terms = terms.filter(F.col("term").between(found["low"], found["high"]))
    sizes = F.array(*[F.lit(n) for n in sorted(found["lengths"])]).cast("array<int>")
    offered = F.transform(
        F.filter(sizes, lambda n: n <= F.length("term")),
        lambda n: F.substring(F.col("term"), F.lit(1), n),
    )
    heads = terms.withColumn("prefix", F.explode(offered))
    return join_small(heads, prefixes, ["prefix"], spread=["term"])


def match_prefix(
    postings: DataFrame, prefixes: DataFrame, field: str, term_stats: DataFrame
) -> DataFrame:
    """Documents with a term of ``field`` that starts with the prefix: (query_id, url).

    Prefixes are looked up in the vocabulary, each distinct one once; the postings see
    one join on field and term, so only the directories of found terms are read. If the
    terms found are too many for a broadcast, the postings offer their own leading
    characters instead: the prefixes, not the vocabulary, bound that join. What is found
    is dealt by url once and grouped there.
    """
    vocabulary = term_stats.filter(F.col("field") == field).select("field", "term")
    sought = prefixes.select("prefix").distinct()
    found = expand_prefixes(vocabulary, sought)
    terms, shard = align_shards(postings, found, "term")
    in_field = postings.filter(F.col("field") == field)
    if fits_broadcast(found, HELD_TOGETHER):
        matched = in_field.join(F.broadcast(terms), [*TERM_KEY, *shard])
    else:
        matched = expand_prefixes(in_field.select("term", "url"), sought)
    per_prefix = deal_by(matched.select("prefix", "url"), "url", postings).distinct()
    asked = prefixes.select("query_id", "prefix")
    return match_any(join_small(per_prefix, asked, ["prefix"], spread=["url"]))
