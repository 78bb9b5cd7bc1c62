"""Documents as a log of batches in plain Parquet.

Each batch is one ``batch_id=N/stream=S`` directory; what is not appended by a stream
belongs to the stream ``main``. Writing a batch again replaces it, so a replay changes
nothing, and a batch appears as a whole when its job commits. Writers with different
stream names never touch each other's batches. A deletion is a row too. The current
documents are a view over the log.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.parse import DOCUMENT_FIELDS

LOG_SCHEMA = (
    "url string, title string, content string, meta_description string, "
    "headings string, content_length int, crawl_time timestamp, depth int, "
    "deleted boolean, row_id bigint, batch_id bigint, stream string"
)
MAIN = "main"
#: What tells the newest row of a url, most telling first.
NEWEST = ("batch_id", "stream", "crawl_time", "row_id")
#: A url with more rows, and more than this share of the log, is hot when it is compacted.
HOT_ROWS, HOT_SHARE = 1000, 0.001


def _append(rows: DataFrame, log: str, batch_id: int, stream: str = MAIN) -> None:
    rows.withColumn("row_id", F.monotonically_increasing_id()).write.mode(
        "overwrite"
    ).parquet(f"{log}/batch_id={batch_id}/stream={stream}")


def append_documents(docs: DataFrame, log: str, batch_id: int, stream: str = MAIN) -> None:
    """Add documents as one batch, as they are: copies of a url stay."""
    rows = docs.select(*DOCUMENT_FIELDS, F.lit(False).alias("deleted"))
    _append(rows, log, batch_id, stream)


def batch_for(spark: SparkSession, log: str, stream: str) -> int:
    """Batch id for a stream's batch: the one it has, or the next after all others.

    Reads only the log's partition values. A batch that is run again finds the id that
    its first run took, also after other writers went on or the log was compacted.
    """
    try:
        rows = read_log(spark, log)
    except AnalysisException:  # no batch yet
        return 0
    own = F.max(F.when(F.col("stream") == stream, F.col("batch_id")))
    found = rows.agg(own.alias("own"), F.max("batch_id").alias("last")).first()
    if found["own"] is not None:
        return found["own"]
    return 0 if found["last"] is None else found["last"] + 1


def append_deletions(urls: DataFrame, log: str, batch_id: int) -> None:
    """Add the deletion of each of ``urls`` (url) as one batch."""
    empty = [
        F.lit(None).cast(kind).alias(name)
        for name, kind in (f.split() for f in LOG_SCHEMA.split(", ")[1:8])
    ]
    _append(urls.select("url", *empty, F.lit(True).alias("deleted")), log, batch_id)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """All rows of the log."""
    return spark.read.schema(LOG_SCHEMA).option("basePath", log).parquet(log)


def latest_documents(log: DataFrame) -> DataFrame:
    """Current documents: the last row of each url, unless it is a deletion.

    Within one batch the latest crawl wins, then the later row.

    The rank limit also works before the shuffle, so a url with very many copies
    sends one row per task.
    """
    last = Window.partitionBy("url").orderBy(*[F.col(c).desc_nulls_last() for c in NEWEST])
    return (
        log.withColumn("_n", F.row_number().over(last))
        .filter("_n = 1 AND NOT deleted")
        .select(*DOCUMENT_FIELDS)
    )


def all_documents(log: DataFrame) -> DataFrame:
    """Every appended document, copies included."""
    return log.filter("NOT deleted").select(*DOCUMENT_FIELDS)


def _one_row_of_hot_urls(rows: DataFrame) -> DataFrame:
    """``rows`` without the older copies of urls that hold a large part of the log.

    Only keys travel here, no bodies. At most ``1 / HOT_SHARE`` urls can be hot, so their
    newest keys are a table of bounded size.
    """
    key = F.struct(*NEWEST)
    counted = rows.groupBy("url").agg(F.count("*").alias("n"), F.max(key).alias("_key"))
    total = rows.count()
    hot = counted.filter(F.col("n") > max(HOT_ROWS, total * HOT_SHARE)).select("url", "_key")
    joined = rows.join(F.broadcast(hot), "url", "left")
    return joined.filter(F.col("_key").isNull() | (key == F.col("_key"))).drop("_key")


def compact_documents(
    spark: SparkSession, log: str, out: str, files: int | None = None
) -> DataFrame:
    """Write the current documents of ``log`` as a new log, sorted by url.

    Rows are range partitioned by url once, and the newest of each url is chosen inside
    the sorted partitions.
    """
    rows = read_log(spark, log)
    batch_id = rows.agg(F.max("batch_id")).first()[0] or 0
    keys = ["url"] if files is None else [files, "url"]
    dealt = _one_row_of_hot_urls(rows).repartitionByRange(*keys)
    append_documents(latest_documents(dealt), out, batch_id)
    return latest_documents(read_log(spark, out))
