"""Registered queries: each operator over the whole given tables.

Every entry takes (spark, folder of the Parquet tables) and returns a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import html as H, scores as S, text as T
from ..functions.urls import resolve_url
from ..operators import analyze as A, crawl as C, documents as D, match as M
from ..operators import parse, rank as R, score as B, serve as V, suggest as G
from ..session import scratch_path, stage
from ..sources import document_log as L
from ..sources.pages import page_records, seeds_from_text
from ..streaming.ingest import ingest_stream
from . import views
from .index import update_index, write_index
from .search import search as run_search
from .views import AS_OF, PLAIN

QUERIES = {}
LIMIT = 10


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _seconds(column="crawl_time"):
    return F.unix_seconds(column).alias("crawl_seconds")


def _postings(spark, folder, fields=None):
    postings = views.text_index(spark, folder).postings
    return postings.filter(F.col("field").isin(fields)) if fields else postings


def _query_terms(spark, folder, fields=A.TEXT_FIELDS):
    return M.analyze_queries(views.queries(spark, folder), PLAIN, fields)


def _bm25(spark, folder, require_all=True):
    index = views.text_index(spark, folder)
    return B.bm25(
        index.postings,
        _query_terms(spark, folder),
        index.term_stats,
        index.field_stats,
        require_all=require_all,
    )


def _candidates(spark, folder, whole=False):
    """The candidates that a search for any term ranks: twice the limit per query.

    They carry the snippet of a hit or, if ``whole``, the document's whole content.
    """
    hits = B.top_k(_bm25(spark, folder, require_all=False), 2 * LIMIT)
    index = views.text_index(spark, folder)
    found = B.project_hits(
        index.documents if whole else index.hits, hits,
        queries=views.queries(spark, folder), per_query=2 * LIMIT,
    )
    return stage(found.select("query_id", "score", *B.HIT_FIELDS), "candidates")


def _ranked(spark, folder, weights=None):
    return R.rank_results(
        _candidates(spark, folder), views.queries(spark, folder), AS_OF, weights
    )


def _served(spark, folder, limit):
    """What a search for any term serves: its best ``limit`` hits per query, ranked."""
    index, asked = views.text_index(spark, folder), views.queries(spark, folder)
    return run_search(index, asked, AS_OF, limit, require_all=False)


def _six(column, name):
    return F.round(column, 6).alias(name)


# --- sources and sinks -----------------------------------------------------------


@query
def page_scan(spark, folder):
    pages = page_records(views.table(spark, folder, "pages"), "html")
    return pages.select("url", F.md5("content").alias("content_md5"), "depth", "crawl_time")


@query
def seed_scan(spark, folder):
    text = views.spread_table(spark, folder, "documents", "doc_id").select("doc_id", "text")
    return seeds_from_text(text, "text")


@query
def document_append(spark, folder):
    log = scratch_path(spark, "log")
    L.append_documents(views.text_documents(spark, folder), log, 0)
    return L.all_documents(L.read_log(spark, log)).select(
        "url", "title", "meta_description", F.md5("content").alias("content_md5"),
        "headings", "content_length", _seconds(), "depth",
    )


@query
def search_envelope(spark, folder):
    results = _served(spark, folder, LIMIT)
    envelope = V.to_envelope(results, views.queries(spark, folder))
    urls = F.array_join(F.transform("results", lambda r: r["url"]), " ")
    return envelope.select("query_id", "query", urls.alias("urls"), "total", "error")


# --- crawl -----------------------------------------------------------------------


@query
def url_resolve(spark, folder):
    pages = views.rich_pages(spark, folder)
    hrefs = pages.select(
        "url", F.posexplode(H.raw_hrefs(H.quiet_html("content"))).alias("pos", "href")
    )
    return hrefs.select("url", "pos", "href", resolve_url("url", "href").alias("link"))


@query
def raw_links(spark, folder):
    return C.extract_raw_links(views.fetches(spark, folder))


@query
def fetch_filter(spark, folder):
    kept = C.html_only(views.fetches(spark, folder))
    return kept.select("url", "status", "content_type")


@query
def robots_filter(spark, folder):
    urls = views.table(spark, folder, "pages").select("url")
    return C.robots_filter(urls, views.robots_rules(spark, folder))


@query
def link_edges(spark, folder):
    pages = views.fetches(spark, folder).select("url", "content", "depth")
    repeated = (
        C.extract_raw_links(pages).groupBy(F.col("link").alias("url")).count().filter("count > 1")
    )
    return C.link_edges(pages, repeated.select("url"))


@query
def crawl_frontier(spark, folder):
    graph = views.crawl_graph(spark, folder)
    graph["edges"] = C.store_edges(graph["edges"], scratch_path(spark, "edges"))
    return C.crawl_frontier(**graph, max_depth=3)


# --- page parsing ----------------------------------------------------------------


@query
def clean_text(spark, folder):
    docs = views.spread_table(spark, folder, "documents", "doc_id")
    return docs.select("doc_id", F.md5(T.clean_text("text")).alias("text_md5"))


@query
def page_title(spark, folder):
    pages = views.fetches(spark, folder)
    return pages.select("url", H.extract_title(H.quiet_html("content")).alias("title"))


@query
def meta_description(spark, folder):
    pages = views.rich_pages(spark, folder)
    found = H.extract_meta_description(H.quiet_html("content"))
    return pages.select("url", found.alias("meta_description"))


@query
def strip_boilerplate(spark, folder):
    pages = views.fetches(spark, folder)
    return pages.select("url", H.strip_boilerplate("content").alias("html"))


@query
def main_content(spark, folder):
    return views.parsed_pages(spark, folder).select("url", "content", "content_length")


@query
def classed_content(spark, folder):
    parsed = parse.parse_pages(page_records(views.classed_pages(spark, folder)))
    return parsed.select("url", "content", "content_length")


@query
def page_headings(spark, folder):
    parsed = views.parsed_pages(spark, folder)
    return parsed.select("url", F.posexplode("headings").alias("pos", "h")).select(
        "url", "pos", "h.level", "h.text"
    )


@query
def page_links(spark, folder):
    parsed = views.parsed_pages(spark, folder)
    return parsed.select("url", F.posexplode("links").alias("pos", "l")).select(
        "url", "pos", F.col("l.url").alias("link"), "l.text", "l.title"
    )


@query
def parse_pages(spark, folder):
    return views.parsed_pages(spark, folder).select(
        "url", "title", "meta_description", "content", "content_length",
        F.size("headings").alias("n_headings"), F.size("links").alias("n_links"),
        "crawl_time", "depth",
    )


@query
def headings_text(spark, folder):
    return views.page_documents(spark, folder).select("url", "headings")


@query
def crawl_timestamp(spark, folder):
    pages = views.fetches(spark, folder)
    return pages.select("url", _seconds(T.crawl_timestamp("crawl_time")))


# --- text analysis and index tables ----------------------------------------------


@query
def tokenize(spark, folder):
    return A.tokenize(views.text_documents(spark, folder), PLAIN)


@query
def stem_terms(spark, folder):
    docs = A.analyze_fields(views.text_documents(spark, folder), PLAIN, ["title", "content"])
    return A.stem_counts(docs)


@query
def postings(spark, folder):
    places = F.array_join(F.col("positions").cast("array<string>"), " ")
    built = A.build_postings(views.text_documents(spark, folder), PLAIN)
    return built.select(
        "field", "term", "url", "tf", "field_len", F.md5(places).alias("positions_md5")
    )


@query
def field_terms(spark, folder):
    docs = views.text_documents(spark, folder)
    return A.field_terms(A.build_postings(docs, PLAIN, ["content"]), "content")


@query
def document_upsert(spark, folder):
    current = views.text_documents(spark, folder)
    docs = D.upsert_documents(current, views.updates(spark, folder))
    return docs.select("url", "title", "content_length", "depth")


@query
def document_delete(spark, folder):
    current = views.text_documents(spark, folder)
    docs = D.delete_documents(current, views.removed_urls(spark, folder))
    return docs.select("url", "title", "content_length", "depth")


@query
def index_stats(spark, folder):
    current = views.text_documents(spark, folder)
    return D.index_stats(D.upsert_documents(current, views.updates(spark, folder)))


@query
def document_compact(spark, folder):
    log, out = scratch_path(spark, "log"), scratch_path(spark, "compact")
    L.append_documents(views.text_documents(spark, folder), log, 0)
    L.append_documents(views.updates(spark, folder), log, 1)
    L.append_deletions(views.removed_urls(spark, folder), log, 2)
    return L.compact_documents(spark, log, out).select(
        "url", "title", F.md5("content").alias("content_md5"), "content_length", "depth"
    )


# --- matching --------------------------------------------------------------------


@query
def query_clean(spark, folder):
    docs = views.spread_table(spark, folder, "documents", "doc_id")
    return docs.select("doc_id", F.md5(T.clean_query("text")).alias("query_md5"))


@query
def match_field(spark, folder):
    found = M.match_field(
        _postings(spark, folder, ["title"]), _query_terms(spark, folder, ["title"]), "title"
    )
    return found.groupBy("query_id", "url").agg(F.sum("tf").alias("tf"))


def _matches(spark, folder):
    return M.match_multi(_postings(spark, folder), _query_terms(spark, folder))


@query
def match_multifield(spark, folder):
    found = _matches(spark, folder)
    return found.groupBy("query_id", "url").agg(F.sum("n_fields").alias("n_fields"))


@query
def match_all(spark, folder):
    return M.match_all(_matches(spark, folder), _query_terms(spark, folder))


@query
def match_any(spark, folder):
    return M.match_any(_matches(spark, folder))


@query
def match_exclude(spark, folder):
    terms = _query_terms(spark, folder)
    index = _postings(spark, folder)
    wanted = M.match_any(M.match_by_document(index, terms.filter("term_no = 0")))
    unwanted = M.match_any(M.match_by_document(index, terms.filter("term_no > 0")))
    return M.match_exclude(wanted, unwanted)


@query
def match_phrase(spark, folder):
    phrases = M.phrase_terms(views.queries(spark, folder), PLAIN)
    index = views.text_index(spark, folder)
    return M.match_phrase(index.postings, phrases, index.term_stats)


@query
def match_prefix(spark, folder):
    index = views.text_index(spark, folder)
    asked = views.prefixes(spark, folder)
    return M.match_prefix(index.postings, asked, "content", index.term_stats)


@query
def bm25_score(spark, folder):
    return _bm25(spark, folder)


@query
def scored_matches(spark, folder):
    index = views.text_index(spark, folder)
    asked = views.clauses(spark, folder)
    return B.scored_matches(index.postings, asked, index.term_stats, index.field_stats, PLAIN)


@query
def search_topk(spark, folder):
    return B.top_k(_bm25(spark, folder, require_all=False), 10)


@query
def hit_projection(spark, folder):
    hits = B.top_k(_bm25(spark, folder, require_all=False), 10)
    store = views.text_index(spark, folder).hits
    found = B.project_hits(store, hits, views.queries(spark, folder), 10)
    return found.withColumn("crawl_time", _seconds()).withColumnRenamed(
        "crawl_time", "crawl_seconds"
    )


@query
def suggest(spark, folder):
    index = views.text_index(spark, folder)
    asked = views.prefixes(spark, folder)
    return G.suggest(index.hits, index.postings, index.term_stats, asked, 5)


@query
def popular_terms(spark, folder):
    return G.popular_terms(views.text_index(spark, folder).term_stats, 10)


def _with_parts(ranked: DataFrame) -> DataFrame:
    parts = [f.name for f in ranked.schema["score_breakdown"].dataType.fields]
    return ranked.select(
        "query_id", "url", "score", "ranking_score",
        *[_six(F.col("score_breakdown")[p], p) for p in parts],
        *[c for c in ("rank",) if c in ranked.columns],
    )


@query
def search(spark, folder):
    index = views.text_index(spark, folder)
    return _with_parts(run_search(index, views.queries(spark, folder), AS_OF, 10))


@query
def search_stemmed(spark, folder):
    """The whole search with the default analyzer: titles and contents are stemmed."""
    index = views.text_index(spark, folder, A.Analyzer())
    return _with_parts(run_search(index, views.queries(spark, folder), AS_OF, 10))


def _updated_index(spark, folder):
    """An index of its own: written, then updated, then some urls removed."""
    path = scratch_path(spark, "updated-index")
    write_index(views.text_documents(spark, folder), path, PLAIN)
    update_index(spark, path, views.updates(spark, folder), analyzer=PLAIN, batch="new")
    gone = views.removed_urls(spark, folder)
    return update_index(spark, path, deletes=gone, analyzer=PLAIN, batch="gone")


@query
def search_updated(spark, folder):
    index = _updated_index(spark, folder)
    return _with_parts(run_search(index, views.queries(spark, folder), AS_OF, 10))


@query
def updated_term_stats(spark, folder):
    index = _updated_index(spark, folder)
    lengths = index.field_stats.select("field", "n_docs", _six(F.col("avg_len"), "avg_len"))
    # one row per field; by its files' size Spark would broadcast the vocabulary instead
    return index.term_stats.join(F.broadcast(lengths), "field")


# --- ranking ---------------------------------------------------------------------


def _term_figures(spark, folder, *columns, whole=False):
    candidates = _candidates(spark, folder, whole)
    figures = R.term_figures(candidates, views.queries(spark, folder))
    return figures.select(
        "query_id", "url", "term",
        *[_six(F.col(c), c) if c != "df" else F.col(c) for c in columns],
    )


@query
def term_frequency(spark, folder):
    """Over the whole contents of the candidates."""
    candidates = _candidates(spark, folder, whole=True)
    worded = R.with_query_words(candidates, views.queries(spark, folder))
    terms = F.array_distinct("terms")
    figures = F.zip_with(
        terms,
        S.term_frequencies(F.col("content"), terms),
        lambda t, tf: F.struct(t.alias("term"), tf.alias("tf")),
    )
    per_term = worded.select("query_id", "url", F.inline(figures))
    return per_term.select("query_id", "url", "term", _six(F.col("tf"), "tf"))


@query
def document_frequency(spark, folder):
    figures = _term_figures(spark, folder, "df")
    return figures.groupBy("query_id", "term").agg(F.max("df").alias("df"))


@query
def inverse_doc_frequency(spark, folder):
    figures = _term_figures(spark, folder, "idf")
    return figures.groupBy("query_id", "term").agg(F.max("idf").alias("idf"))


@query
def tf_idf(spark, folder):
    """Over the whole contents of the candidates."""
    return _term_figures(spark, folder, "tf_idf", whole=True)


def _factor(name):
    def run(spark, folder):
        scored = _ranked(spark, folder)
        value = _six(F.col("score_breakdown")[name], name)
        return scored.select("query_id", "url", value)

    return run


for _key, _part in {
    "title_score": "title_score",
    "content_score": "content_score",
    "url_score": "url_score",
    "meta_score": "meta_score",
}.items():
    QUERIES[_key] = _factor(_part)


@query
def heading_score(spark, folder):
    """Pages keep their headings as candidates; the page title is the query."""
    docs = views.page_documents(spark, folder)
    score = S.field_score(S.query_words("title"), F.col("headings"))
    return docs.select("url", score.alias("heading_score"))


@query
def freshness_score(spark, folder):
    docs = views.text_documents(spark, folder)
    score = S.freshness_score(F.col("crawl_time"), AS_OF)
    return docs.select("url", _six(score, "freshness_score"))


@query
def content_length_score(spark, folder):
    docs = views.text_documents(spark, folder)
    score = S.content_length_score(F.col("content_length"))
    return docs.select("url", _six(score, "content_length_score"))


@query
def depth_penalty(spark, folder):
    docs = views.text_documents(spark, folder)
    return docs.select("url", _six(S.depth_penalty(F.col("depth")), "depth_penalty"))


@query
def rank_results(spark, folder):
    return _with_parts(_ranked(spark, folder))


@query
def rank_reweighted(spark, folder):
    ranked = _ranked(spark, folder, {"title_match": 0.5, "freshness": 10, "depth_penalty": 2})
    return ranked.select("query_id", "url", "ranking_score")


# --- serving ---------------------------------------------------------------------


@query
def paginate(spark, folder):
    page = V.paginate(_served(spark, folder, 2 * V.PER_PAGE), 2)
    return page.select("query_id", "url", "ranking_score", "rank")


@query
def page_info(spark, folder):
    """Counts every hit of the search, not those it serves."""
    return V.page_info(_bm25(spark, folder, require_all=False), 2)


@query
def display_rows(spark, folder):
    return V.display_rows(_ranked(spark, folder))


@query
def answer_context(spark, folder):
    return V.answer_context(_served(spark, folder, V.PER_PAGE), 3)


# --- streaming -------------------------------------------------------------------


@query
def stream_ingest(spark, folder):
    """All pages through the stream into a log, read back as current documents."""
    schema = views.table(spark, folder, "pages").schema
    log = scratch_path(spark, "log")
    # a pattern, as a stream takes no path of one file; a folder of part files matches too
    ingest_stream(
        spark, f"{folder}/pages.parque[t]", schema, log, scratch_path(spark, "stream"),
        content="html",
    ).awaitTermination()
    docs = L.latest_documents(L.read_log(spark, log))
    return docs.select(
        "url", "title", "content", "content_length", "depth", _seconds()
    )
