"""From fetched pages to structured page records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import html as H
from ..functions.htmltree import read_tree
from ..functions.text import crawl_timestamp, headings_text
from ..functions.urls import url_parts

# The stored fields of a document.
DOCUMENT_FIELDS = [
    "url",
    "title",
    "content",
    "meta_description",
    "headings",
    "content_length",
    "crawl_time",
    "depth",
]


def parse_pages(pages: DataFrame) -> DataFrame:
    """Pages (url, content[, depth, crawl_time]) to parsed page records.

    One pass, no shuffle. Null or unreadable html drops the page. Title and meta
    description come from the whole page; content, headings and links from the
    page without boilerplate.
    """
    columns = pages.columns
    depth = F.col("depth") if "depth" in columns else F.lit(0)
    crawled = F.col("crawl_time") if "crawl_time" in columns else F.lit(0.0)
    quiet, stripped = F.col("_quiet"), F.col("_stripped")
    tree = F.col("_tree")

    staged = (
        pages.filter(F.col("content").isNotNull())
        .select(
            "url",
            F.coalesce(crawled.cast("double"), F.lit(0.0)).alias("crawl_time"),
            F.coalesce(depth.cast("int"), F.lit(0)).alias("depth"),
            H.quiet_html("content").alias("_quiet"),
        )
        .withColumn("_stripped", H.strip_boilerplate("_quiet"))
        .withColumn("_heads", H.heading_elements(stripped))
        .withColumn("_anchors", H.anchor_elements(stripped))
        .withColumn(
            "_hard", H.needs_tree(quiet, stripped, F.col("_heads"), F.col("_anchors"))
        )
        .withColumn("_tree", read_tree(F.when(F.col("_hard"), quiet)))
        .withColumn("_base", url_parts("url"))
        .filter(~F.col("_hard") | tree["title"].isNotNull())
    )

    def either(name: str, plain):
        return F.when(F.col("_hard"), tree[name]).otherwise(plain)

    main = F.when(H.has_content_class(stripped), H.content_text(stripped)).otherwise(
        H.body_text(stripped)
    )
    links = either("links", H.links_from(F.col("_anchors")))
    return staged.select(
        "url",
        either("title", H.extract_title(quiet)).alias("title"),
        either("meta_description", H.extract_meta_description(quiet)).alias(
            "meta_description"
        ),
        either("content", main).alias("content"),
        either("headings", H.headings_from(F.col("_heads"))).alias("headings"),
        H.resolve_links(links, F.col("_base")).alias("links"),
        "crawl_time",
        "depth",
    ).withColumn("content_length", F.length("content"))


def to_documents(parsed: DataFrame) -> DataFrame:
    """Parsed pages as flat index documents."""
    return parsed.select(
        "url",
        "title",
        "content",
        "meta_description",
        headings_text("headings").alias("headings"),
        "content_length",
        crawl_timestamp("crawl_time").alias("crawl_time"),
        "depth",
    )
