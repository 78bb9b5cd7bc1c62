"""Inputs of the registered queries, derived from the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import clean_query, clean_text
from ..functions.urls import origin
from ..operators.analyze import Analyzer
from ..operators.parse import parse_pages, to_documents
from ..session import scratch_path, use_all_cores
from ..sources.pages import page_records
from .index import SearchIndex, write_index

AS_OF = 1735689600.0  # 2025-01-01T00:00:00Z, the fixed clock of freshness
FIRST_CRAWL = 1704067200  # 2024-01-01T00:00:00Z
PLAIN = Analyzer().unstemmed()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table whose rows are costly to process, spread if it is small."""
    return use_all_cores(table(spark, folder, name), key)


def fetches(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the status, type, depth and time a fetch would add."""
    url = F.col("url")
    return spread_table(spark, folder, "pages", "page_id").select(
        "page_id",
        "url",
        F.col("html").alias("content"),
        F.when(F.endswith(url, F.lit("/")), 404).otherwise(200).alias("status"),
        F.when(F.contains(url, F.lit("utm_source")), "application/pdf")
        .otherwise("Text/HTML; charset=utf-8")
        .alias("content_type"),
        (F.size(F.split(url, "/")) - 3).alias("depth"),
        (F.lit(float(FIRST_CRAWL)) + F.col("page_id") * 3600).alias("crawl_time"),
    )


def rich_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched pages with a description, more headings and links in the article."""
    heading = F.regexp_extract("content", "<h1>([^<]*)", 1)
    words = F.slice(F.split(F.replace(heading, F.lit('"'), F.lit("")), " "), 1, 5)
    described = F.concat(
        F.lit('<head><meta name="description" content="'),
        F.array_join(words, " "),
        F.lit('">'),
    )
    number = F.col("page_id").cast("string")
    extra = F.concat(
        F.lit("<h3>Part three of "), number, F.lit("</h3><h2>Part <i>"), number,
        F.lit('</i></h2><a href="up/'), number, F.lit('?v=1" title="Up &amp; over">Go <b>up</b></a>'),
        F.lit('<a href="mailto:x@example.org">Mail</a></article>'),
    )
    html = F.replace(F.replace("content", F.lit("<head>"), described), F.lit("</article>"), extra)
    return fetches(spark, folder).withColumn("content", html)


def classed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Rich pages whose articles carry main-content classes, one inside the other."""
    opened = F.lit('<article class="Post-Content"><div class="body">')
    html = F.replace("content", F.lit("<article>"), opened)
    html = F.replace(html, F.lit("</article>"), F.lit("</div></article>"))
    return rich_pages(spark, folder).withColumn("content", html)


def parsed_pages(spark: SparkSession, folder: str) -> DataFrame:
    return parse_pages(page_records(rich_pages(spark, folder)))


def page_documents(spark: SparkSession, folder: str) -> DataFrame:
    return to_documents(parsed_pages(spark, folder))


def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Text documents as index documents: first line title, second description."""
    doc_id = F.col("doc_id").cast("string")
    lines = F.split("text", "\n", 3)  # only the first two are used
    content = clean_text("text")
    return spread_table(spark, folder, "documents", "doc_id").select(
        F.concat(
            F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), doc_id
        ).alias("url"),
        clean_text(F.get(lines, F.lit(0))).alias("title"),
        content.alias("content"),
        clean_text(F.coalesce(F.get(lines, F.lit(1)), F.lit(""))).alias("meta_description"),
        F.lit("").alias("headings"),
        F.length(content).alias("content_length"),
        F.timestamp_seconds(F.lit(FIRST_CRAWL) + F.col("doc_id") % 365 * 86400).alias(
            "crawl_time"
        ),
        (F.col("doc_id") % 5).cast("int").alias("depth"),
    )


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """Each benchmark text, whole."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def clauses(spark: SparkSession, folder: str) -> DataFrame:
    """A query of clauses from the words of each benchmark text: the first must occur,
    a word that begins like the second too; the next two should stand side by side; the
    last must not occur."""
    words = PLAIN.tokens(clean_query("query"))
    found = queries(spark, folder).select("query_id", words.alias("w"))

    def clause(number, occur, kind, text):
        return F.struct(
            F.lit(number).alias("clause_no"), F.lit(occur).alias("occur"),
            F.lit(kind).alias("kind"), text.alias("text"),
        )

    word = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(""))
    rows = F.array(
        clause(0, "must", "term", word(0)),
        clause(1, "must", "prefix", F.substring(word(1), 1, 4)),
        clause(2, "should", "phrase", F.concat_ws(" ", word(2), word(3))),
        clause(3, "must_not", "term", F.coalesce(F.try_element_at("w", F.lit(-1)), F.lit(""))),
    )
    return found.select("query_id", F.inline(rows))


def prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """First three letters of each benchmark text."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lower(F.substring("text", 1, 3)).alias("prefix")
    )


def updates(spark: SparkSession, folder: str) -> DataFrame:
    """English documents with a new title, and one new document per benchmark text."""
    docs = text_documents(spark, folder)
    changed = docs.filter(F.contains("url", F.lit("/en/"))).withColumn(
        "title", F.concat(F.lit("Updated "), "title")
    )
    content = clean_text("text")
    new = table(spark, folder, "benchmark").select(
        F.concat(F.lit("https://new.example.com/"), F.col("item_id").cast("string")).alias("url"),
        F.lit("New").alias("title"),
        content.alias("content"),
        F.lit("").alias("meta_description"),
        F.lit("").alias("headings"),
        F.length(content).alias("content_length"),
        F.timestamp_seconds(F.lit(FIRST_CRAWL)).alias("crawl_time"),
        F.lit(0).alias("depth"),
    )
    return changed.unionByName(new)


def removed_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Urls of the German documents."""
    docs = text_documents(spark, folder)
    return docs.filter(F.contains("url", F.lit("/de/"))).select("url")


def robots_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules per host: hosts of several pages allow Spanish before all forbid it;
    plain http hosts forbid French."""
    hosts = (
        table(spark, folder, "pages")
        .groupBy(origin("url").alias("origin"))
        .agg(F.count("*").alias("n"))
    )

    def rule(order: int, prefix: str, allow: bool, where: str):
        return F.when(
            F.expr(where),
            F.struct(
                F.lit(order).alias("rule_order"),
                F.lit(prefix).alias("path_prefix"),
                F.lit(allow).alias("allow"),
            ),
        )

    rules = F.array(
        rule(0, "/es/", True, "n > 1"),
        rule(1, "/es/", False, "true"),
        rule(2, "/fr/", False, "startswith(origin, 'http://')"),
    )
    return hosts.select("origin", F.inline(F.array_compact(rules)))


def crawl_graph(spark: SparkSession, folder: str) -> dict:
    """Link graph from orders: customers are pages, each order is a link."""
    customers = table(spark, folder, "customer")
    total = customers.count()

    def address(key):
        return F.concat(F.lit("https://site.example/"), key.cast("string"))

    edges = table(spark, folder, "orders").select(
        address(F.col("o_custkey")).alias("src"),
        F.col("o_orderkey").alias("pos"),
        address(F.col("o_orderkey") * 7919 % total).alias("dst"),
    )
    pages = customers.filter("c_acctbal >= 0").select(address(F.col("c_custkey")).alias("url"))
    seeds = (
        customers.groupBy("c_nationkey")
        .agg(F.min("c_custkey").alias("seed_order"))
        .select(address(F.col("seed_order")).alias("url"), "seed_order")
    )
    return {"seeds": seeds, "edges": edges, "pages": pages, "max_pages": total * 2 // 3}


_INDEXES: dict[tuple, SearchIndex] = {}


def text_index(
    spark: SparkSession, folder: str, analyzer: Analyzer = PLAIN
) -> SearchIndex:
    """Stored index of the text documents.

    A session writes it once per analyzer and state of the table: the names, sizes and
    times of the table's files are part of the key, so a changed table has a new index.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/documents.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    state = tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)
    key = (spark.sparkContext.applicationId, folder, analyzer, state)
    if key not in _INDEXES:
        docs = text_documents(spark, folder)
        _INDEXES[key] = write_index(docs, scratch_path(spark, "index"), analyzer)
    return _INDEXES[key]
