"""The search index as plain Parquet tables.

Layout, chosen for reads that touch few terms and few documents:

* ``documents``: directories by hash of the url, sorted by url.
* ``hits``: the fields of a hit, with a snippet in place of the content, in the same
  layout. Fetching hits prunes directories at run time and reads no content.
* ``postings``: directories by field and hash of the term, sorted by term. A
  query reads the directories of its own terms. A build deals them by hash in as many
  tasks as the documents' bytes ask for; a directory then has several files. A merge
  rebalances them: adaptive execution splits a directory that holds a very common term.
* ``term_stats``, ``field_stats``: document frequencies, sorted by term, and field lengths.

Every build writes a new version beside the old ones and is published by one row that
is appended last. A build that fails leaves the published index as it was; readers
that hold an older version keep its files.

An update does not touch the version. It writes a *segment* beside it: the same tables
for the new documents, the urls that are gone with their old rows (``gone``), and how
the statistics change, which takes the old documents of those urls and no postings. Reading
merges: rows of a url are alive if no later segment lists it. ``merge_index`` makes a
version of all segments without analysing a text again; updates do so themselves past
``MAX_SEGMENTS``. Urls that are gone and no longer fit a broadcast meet the rows by shuffle.

One writer at a time; readers need no care. An update may name its batch: a batch that
is already published changes nothing, so it can be run again after a failure.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.shards import add_shard
from ..operators.analyze import (
    Analyzer, build_postings, bundle_postings, field_stats, term_stats, unbundle_postings,
)
from ..operators.joins import TASK_BYTES, fits_broadcast, join_small, stored_bytes
from ..operators.score import hit_store

#: Segments beside a version before an update merges them.
MAX_SEGMENTS = 16
#: An index is written once and read often; snappy's files are about half as large again.
CODEC = "zstd"
_CHANGES = "field string, term string, df long, n_tokens long"
_PUBLISHED = (
    "number long, version string, segments array<string>, batches array<string>, "
    "documents string"
)
_POSTINGS = "term string, url string, tf int, field_len int, positions array<int>, field string"
_TERMS = "field string, term string, df long"
_FIELDS = "field string, n_docs long, n_tokens long"


@dataclass(frozen=True)
class SearchIndex:
    """Tables of one index; lazy when built, scans when read."""

    documents: DataFrame
    hits: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    analyzer: Analyzer


def build_index(documents: DataFrame, analyzer: Analyzer = Analyzer()) -> SearchIndex:
    """Index of current documents (one row per url), computed when used."""
    postings = build_postings(documents, analyzer)
    return SearchIndex(
        documents,
        hit_store(documents),
        postings,
        term_stats(postings),
        field_stats(documents, analyzer),
        analyzer,
    )


def write_index(
    documents: DataFrame,
    path: str,
    analyzer: Analyzer = Analyzer(),
    shards: int = 16,
    batch: str | None = None,
) -> SearchIndex:
    """Write the index tables as a new version below ``path``; return them as scans.

    ``shards`` is the number of hash directories of documents and of each field's
    postings; take more for more data. ``batch`` names the documents' batch, as in
    ``update_index``.
    """
    spark, version = documents.sparkSession, f"version-{uuid.uuid4().hex}"
    folder = f"{path}/{version}"
    stored = _write_documents(documents, folder, shards)
    _write_new_postings(stored, analyzer, folder, shards)
    _write_statistics(spark, folder, stored.schema, shards)
    _publish(spark, path, version, [], [] if batch is None else [batch], stored.schema)
    return read_index(spark, path, analyzer)


def update_index(
    spark: SparkSession,
    path: str,
    upserts: DataFrame | None = None,
    deletes: DataFrame | None = None,
    analyzer: Analyzer = Analyzer(),
    batch: str | None = None,
) -> SearchIndex:
    """Replace documents by url, add new ones, remove those of ``deletes`` (url).

    A url in both is replaced. Of several rows of one url in ``upserts`` the latest
    crawl counts. ``analyzer`` must be that of the index.
    """
    last = _needed(spark, path)
    if batch is not None and batch in (last["batches"] or []):
        return read_index(spark, path, analyzer)
    current = read_index(spark, path, analyzer)
    shards = _shards(current.documents)
    plain = [c for c in current.documents.columns if c != f"shard_{shards}"]
    new = (
        current.documents.select(*plain).limit(0)
        if upserts is None
        else newest_per_url(upserts).select(*plain)
    )
    segment = f"segment-{uuid.uuid4().hex}"
    folder = f"{path}/{segment}"
    stored = _write_documents(new, folder, shards)
    urls = stored.select("url")
    if deletes is not None:
        urls = urls.unionByName(deletes.select("url")).distinct()
    urls = add_shard(urls, "url", shards)
    urls.write.parquet(f"{folder}/gone")
    gone = spark.read.schema(urls.schema).parquet(f"{folder}/gone")
    _write_new_postings(stored, analyzer, folder, shards)
    fresh = spark.read.schema(current.postings.schema).parquet(f"{folder}/postings")
    old = join_small(current.documents, gone, [f"shard_{shards}", "url"], "left_semi")
    _write_changes((stored, fresh), (old, build_postings(old, analyzer)), folder)
    batches = [*(last["batches"] or []), *([batch] if batch is not None else [])]
    segments = [*(last["segments"] or []), segment]
    _publish(spark, path, last["version"], segments, batches, stored.schema)
    if len(segments) >= MAX_SEGMENTS:
        return merge_index(spark, path, analyzer)
    return read_index(spark, path, analyzer)


def merge_index(
    spark: SparkSession, path: str, analyzer: Analyzer = Analyzer()
) -> SearchIndex:
    """Publish the current state as one version without segments."""
    last = _needed(spark, path)
    if last["segments"]:
        current = read_index(spark, path, analyzer)
        version, shards = f"version-{uuid.uuid4().hex}", _shards(current.documents)
        folder = f"{path}/{version}"
        shard = f"shard_{shards}"
        stored = _write_documents(current.documents.drop(shard), folder, shards)
        _write_postings(current.postings.drop(shard), folder, shards)
        _write_statistics(spark, folder, stored.schema, shards)
        _publish(spark, path, version, [], list(last["batches"] or []), stored.schema)
    return read_index(spark, path, analyzer)


def read_index(
    spark: SparkSession, path: str, analyzer: Analyzer = Analyzer()
) -> SearchIndex:
    """The newest published version below ``path`` with its segments."""
    last = _needed(spark, path)
    segments = list(last["segments"] or [])
    folders = [f"{path}/{name}" for name in [last["version"], *segments]]
    schema = T.StructType.fromJson(json.loads(last["documents"]))
    schemas = {
        "documents": schema,
        "hits": hit_store(spark.createDataFrame([], schema)).schema,
        "postings": _postings_schema(_shards(schema)),
        "term_stats": _TERMS,
    }
    base = {
        name: spark.read.schema(schema).parquet(f"{folders[0]}/{name}")
        for name, schema in schemas.items()
    }
    counts = spark.read.schema(_FIELDS).parquet(f"{folders[0]}/field_stats")
    if segments:
        gone = _gone(spark, path, segments)
        for name in ("documents", "hits", "postings"):
            parts = [base[name]] + [
                spark.read.schema(base[name].schema).parquet(f"{folder}/{name}")
                for folder in folders[1:]
            ]
            base[name] = _alive(parts, gone)
        base["term_stats"], counts = _changed(spark, folders, base["term_stats"], counts)
    average = F.col("n_tokens") / F.col("n_docs")
    known = counts.filter("field is not null")
    lengths = known.select("field", "n_docs", average.alias("avg_len"))
    return SearchIndex(**base, field_stats=lengths, analyzer=analyzer)


# --- reading and writing the parts ---------------------------------------------------


def _shards(stored: DataFrame | T.StructType) -> int:
    names = stored.names if isinstance(stored, T.StructType) else stored.columns
    return next(int(c.split("_")[1]) for c in names if c.startswith("shard_"))


def _postings_schema(shards: int) -> str:
    return f"{_POSTINGS}, shard_{shards} int"


def newest_per_url(documents: DataFrame) -> DataFrame:
    """One row per url: the latest crawl; of equal ones always the same row."""
    order = [F.col("crawl_time").desc_nulls_last(), F.xxhash64(*documents.columns)]
    window = Window.partitionBy("url").orderBy(*order)
    return documents.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def _gone(spark: SparkSession, path: str, segments: list[str]) -> DataFrame:
    """Urls that segments replaced or removed, with the last segment that did (from 1)."""
    parts = [
        spark.read.schema("url string").parquet(f"{path}/{name}/gone").withColumn("_last", F.lit(n))
        for n, name in enumerate(segments, 1)
    ]
    merged = reduce(DataFrame.unionByName, parts)
    return merged.groupBy("url").agg(F.max("_last").alias("_last"))


def _alive(parts: list[DataFrame], gone: DataFrame) -> DataFrame:
    """Rows of the version and its segments that no later segment replaced."""
    numbered = [part.withColumn("_part", F.lit(n)) for n, part in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, numbered)
    fits = fits_broadcast(gone)
    later = F.broadcast(gone) if fits else gone.hint("merge")
    dead = (rows["url"] == later["url"]) & (rows["_part"] < later["_last"])
    if fits:
        return rows.join(later, dead, "left_anti").drop("_part")
    # Spark takes a semi join with wanted terms before an outer join and a generator, but
    # not before an anti join or a filter: all postings would travel. A url is gone once.
    met = rows.join(later, dead, "left").select(rows["*"], later["_last"])
    kept = F.when(F.col("_last").isNull(), F.array(F.lit(True))).otherwise(F.array())
    return met.withColumn("_kept", F.explode(kept)).drop("_part", "_last", "_kept")


def _changed(spark, folders, stats, counts):
    """Statistics of the version with the changes of its segments."""
    changes = spark.read.schema(_CHANGES).parquet(*[f"{f}/changes" for f in folders[1:]])
    summed = (
        stats.unionByName(changes.filter("term is not null").select(*stats.columns))
        .groupBy("field", "term")
        .agg(F.sum("df").alias("df"))
        .filter("df > 0")
    )
    # a few rows: one for each field, and the number of documents
    totals = changes.groupBy("field").agg(F.sum("df").alias("d"), F.sum("n_tokens").alias("n"))
    grown = {row["field"]: (row["d"], row["n"]) for row in totals.collect()}
    base = {row["field"]: (row["n_docs"], row["n_tokens"]) for row in counts.collect()}
    fields = base.keys() | grown.keys()
    n_docs = base.get(None, (0, 0))[0] + grown.get(None, (0, 0))[0]
    tokens = {f: base.get(f, (0, 0))[1] + grown.get(f, (0, 0))[1] for f in fields if f}
    rows = [(field, n_docs, n) for field, n in sorted(tokens.items()) if n > 0]
    return summed, spark.createDataFrame(rows, _FIELDS)


def _write_documents(documents: DataFrame, folder: str, shards: int) -> DataFrame:
    """Write documents and hits; the documents as a scan."""
    shard, rows = f"shard_{shards}", add_shard(documents, "url", shards)
    _write_sharded(rows, [shard], ["url"], f"{folder}/documents")
    stored = documents.sparkSession.read.schema(rows.schema).parquet(f"{folder}/documents")
    _write_sharded(hit_store(stored), [shard], ["url"], f"{folder}/hits")
    return stored


def _write_postings(postings: DataFrame, folder: str, shards: int) -> None:
    rows = add_shard(postings, "term", shards)
    _write_sharded(rows, ["field", f"shard_{shards}"], ["term"], f"{folder}/postings")


def _write_new_postings(documents: DataFrame, analyzer: Analyzer, folder: str, shards: int) -> None:
    """Write the postings of stored ``documents``; bundles are shuffled, not the postings.

    A task unpacks and sorts about what ``TASK_BYTES`` of the documents have; few documents
    keep all cores busy if they have a megabyte for each.
    """
    size = stored_bytes(documents)
    cores = documents.sparkSession.sparkContext.defaultParallelism
    parts = max(size // TASK_BYTES, min(cores, size >> 20)) + 1
    bundles = bundle_postings(documents, analyzer, shards, parts)
    _write_sorted(
        unbundle_postings(bundles, shards),
        ["field", f"shard_{shards}"], ["term"], f"{folder}/postings",
    )


def _write_statistics(
    spark: SparkSession, folder: str, documents: T.StructType, shards: int
) -> None:
    """Term and field statistics of the documents and postings below ``folder``.

    The field statistics' row without a field has the number of documents.
    """
    written = spark.read.schema(_postings_schema(shards)).parquet(f"{folder}/postings")
    by_term = term_stats(written).repartitionByRange("term").sortWithinPartitions("term")
    by_term.write.parquet(f"{folder}/term_stats", compression=CODEC)
    n_docs = spark.read.schema(documents).parquet(f"{folder}/documents").count()
    fields = written.groupBy("field").agg(
        F.lit(n_docs).cast("long").alias("n_docs"), F.sum("tf").alias("n_tokens")
    )
    whole = spark.createDataFrame([(None, n_docs, 0)], _FIELDS)
    fields.unionByName(whole).coalesce(1).write.parquet(f"{folder}/field_stats")


def _write_changes(new: tuple, old: tuple, folder: str) -> None:
    """How statistics change: (documents, postings) count up if new, down if old.

    ``df`` and ``n_tokens`` are changes by term; the row without a term has the change
    of the number of documents in ``df``.
    """
    parts = []
    for sign, (documents, postings) in ((1, new), (-1, old)):
        columns = [F.col("tf") * sign, F.lit(sign).cast("long")]
        parts.append(postings.select("field", "term", *[c.alias(n) for c, n in zip(columns, ("n", "d"))]))
        parts.append(documents.select(*[F.lit(v).cast(k).alias(n) for v, k, n in (
            (None, "string", "field"), (None, "string", "term"), (0, "int", "n"), (sign, "long", "d"),
        )]))
    signed = reduce(DataFrame.unionByName, parts)
    changes = signed.groupBy("field", "term").agg(F.sum("d").alias("df"), F.sum("n").alias("n_tokens"))
    changes.write.parquet(f"{folder}/changes", compression=CODEC)


def _published(spark: SparkSession, path: str):
    """Number, version, segments and batches published last, or None."""
    try:
        rows = spark.read.schema(_PUBLISHED).parquet(f"{path}/published")
    except AnalysisException:  # nothing is published yet
        return None
    return rows.agg(F.max_by(F.struct("*"), "number").alias("last")).first()["last"]


def _needed(spark: SparkSession, path: str):
    last = _published(spark, path)
    if last is None:
        raise FileNotFoundError(f"no index is published in {path}")
    return last


def is_published(spark: SparkSession, path: str) -> bool:
    """True if an index can be read from ``path``."""
    return _published(spark, path) is not None


def _publish(
    spark: SparkSession,
    path: str,
    version: str,
    segments: list[str],
    batches: list[str],
    documents: T.StructType,
) -> None:
    last = _published(spark, path)
    number = last["number"] + 1 if last else 0
    values = (number, version, segments, batches, documents.json())
    row = spark.createDataFrame([values], _PUBLISHED)
    row.coalesce(1).write.mode("append").parquet(f"{path}/published")


def _write_sharded(
    df: DataFrame, directories: list[str], order: list[str], path: str
) -> None:
    _write_sorted(df.hint("rebalance", *directories), directories, order, path)


def _write_sorted(
    df: DataFrame, directories: list[str], order: list[str], path: str
) -> None:
    (
        df.sortWithinPartitions(*directories, *order)
        .write.mode("overwrite")
        .partitionBy(*directories)
        .parquet(path, compression=CODEC)
    )
