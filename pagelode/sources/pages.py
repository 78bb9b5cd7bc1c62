"""Reading fetched pages and crawl seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import WHITESPACE

# The crawl job file.
JOB_FILE = (
    "crawl_jobs array<struct<id:bigint,name:string,seed_urls:array<string>,"
    "schedule_type:string,schedule_time:string,max_pages:int,max_depth:int,"
    "created_at:string,last_run:string,next_run:string,status:string>>"
)


def page_records(pages: DataFrame, content: str = "content") -> DataFrame:
    """Page records (url, content, depth, crawl_time) with defaults for absent ones."""

    def default(name: str, kind: str) -> Column:
        value = F.col(name).cast(kind) if name in pages.columns else F.lit(None)
        return F.coalesce(value, F.lit(0).cast(kind)).alias(name)

    return pages.select(
        "url",
        F.col(content).alias("content"),
        default("depth", "int"),
        default("crawl_time", "double"),
    )


def read_pages(
    spark: SparkSession, path: str, content: str = "content", format: str = "parquet"
) -> DataFrame:
    """Fetched pages stored in any Spark file format."""
    return page_records(spark.read.format(format).load(path), content)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of a crawl job file: (job_id, seed_order, seed_url, max_pages, max_depth)."""
    jobs = spark.read.schema(JOB_FILE).json(path, multiLine=True)
    return (
        jobs.select(F.inline("crawl_jobs"))
        .select(
            F.col("id").alias("job_id"),
            F.posexplode("seed_urls").alias("seed_order", "seed_url"),
            "max_pages",
            "max_depth",
        )
    )


def seeds_from_text(df: DataFrame, column: str) -> DataFrame:
    """One row per non-blank line of ``column``, stripped; other columns stay."""
    edge = rf"^[{WHITESPACE}]+|[{WHITESPACE}]+$"
    lines = F.transform(
        F.split(F.col(column), "\n"), lambda line: F.regexp_replace(line, edge, "")
    )
    kept = F.filter(lines, lambda line: line != "")
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode(kept).alias("seed_order", "seed_url"))
