"""Continuous indexing: new page files become batches of the document log."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.analyze import Analyzer
from ..operators.parse import parse_pages, to_documents
from ..plans.index import is_published, newest_per_url, update_index, write_index
from ..sources.document_log import all_documents, append_documents, batch_for, read_log
from ..sources.pages import page_records


def ingest_stream(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    log: str,
    checkpoint: str,
    content: str = "content",
    name: str | None = None,
    options: dict[str, str] | None = None,
    trigger: dict | None = None,
    index: str | None = None,
    analyzer: Analyzer = Analyzer(),
    shards: int = 16,
) -> StreamingQuery:
    """Start a query that parses page files and appends them to the log.

    A micro-batch takes the next free batch of the log and keeps it: run again after a
    failure it replaces its own directory and no other. Streams are told apart by
    ``name``, by default one made from source and checkpoint, so several sources can
    feed one log, one after the other or at once. Without ``trigger`` the query takes
    all files present and stops.

    With ``index``, a path, each micro-batch also updates the search index there, which
    the first one writes; only one stream may do so. A batch that is run again finds its
    name published and leaves the index alone.
    """
    name = name or hashlib.md5(f"{source}\n{checkpoint}".encode()).hexdigest()[:12]
    pages = spark.readStream.schema(schema).options(**(options or {})).parquet(source)

    def index_batch(batch: DataFrame, batch_id: int) -> None:
        documents = to_documents(parse_pages(page_records(batch, content)))
        stream = f"{name}-{batch_id}"
        session = batch.sparkSession
        number = batch_for(session, log, stream)
        append_documents(documents, log, number, stream)
        if index is None:
            return
        written = all_documents(read_log(session, log).filter(F.col("stream") == stream))
        if is_published(session, index):
            update_index(session, index, written, analyzer=analyzer, batch=stream)
        else:
            write_index(newest_per_url(written), index, analyzer, shards, batch=stream)

    return (
        pages.writeStream.foreachBatch(index_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
