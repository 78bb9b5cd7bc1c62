"""Text analysis and the inverted index.

Everything up to the postings is a map over documents: each document row turns
into its own postings, so building them shuffles nothing and no term, however
common, gathers in one task. What a stored index writes is packed and unpacked in
arrays, a bounded number of terms at a time.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.shards import HASH_SEED
from ..functions.stem import stem_tokens

TEXT_FIELDS = ["title", "content", "meta_description", "headings"]
#: Terms that a worker takes together, and postings of one batch that it sends.
HELD_TERMS, SENT_ROWS = 1 << 20, 1 << 16


@dataclass(frozen=True)
class Analyzer:
    """How text becomes terms; ``stemmed_fields`` are reduced to word stems."""

    stop_words: tuple[str, ...] = tuple(T.STOP_WORDS)
    min_length: int = 2
    pattern: str = T.TOKEN_PATTERN
    stemmed_fields: tuple[str, ...] = ("title", "content")

    def unstemmed(self) -> Analyzer:
        return replace(self, stemmed_fields=())

    def tokens(self, text: Column | str) -> Column:
        return T.tokens(text, list(self.stop_words), self.min_length, self.pattern)

    def with_terms(self, df: DataFrame) -> DataFrame:
        """Replace ``tokens`` by the terms its ``field`` is indexed under."""
        if not self.stemmed_fields:
            return df.withColumnRenamed("tokens", "terms")
        stemmed = F.col("field").isin(list(self.stemmed_fields))
        stems = stem_tokens(F.when(stemmed, F.col("tokens")))
        return (
            df.withColumn("_stems", stems)
            .withColumn("terms", F.when(stemmed, F.col("_stems")).otherwise(F.col("tokens")))
            .drop("_stems", "tokens")
        )


def analyze_fields(
    docs: DataFrame, analyzer: Analyzer = Analyzer(), fields: list[str] = TEXT_FIELDS
) -> DataFrame:
    """One row (url, field, terms) per document and field, terms in text order."""
    texts = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.coalesce(F.col(name), F.lit("")).alias("text"),
            )
            for name in fields
        ]
    )
    rows = docs.select("url", F.inline(texts))
    return analyzer.with_terms(
        rows.select("url", "field", analyzer.tokens("text").alias("tokens"))
    )


def tokenize(
    docs: DataFrame, analyzer: Analyzer = Analyzer(), fields: list[str] = TEXT_FIELDS
) -> DataFrame:
    """One row (url, field, pos, term) per kept token."""
    return analyze_fields(docs, analyzer, fields).select(
        "url", "field", F.posexplode("terms").alias("pos", "term")
    )


def build_postings(
    docs: DataFrame, analyzer: Analyzer = Analyzer(), fields: list[str] = TEXT_FIELDS
) -> DataFrame:
    """Inverted index rows (field, term, url, tf, field_len, positions).

    The (term, position) pairs of a field are sorted inside the row and cut where
    the term changes.
    """
    pairs = F.sort_array(
        F.transform("terms", lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    )
    run_starts = F.expr(
        """if(field_len > 0,
              filter(sequence(0, field_len - 1),
                     i -> i = 0 or get(pairs, i).term != get(pairs, i - 1).term),
              array())"""
    )
    runs = F.expr(
        """inline(transform(starts, (s, j) -> named_struct(
              'term', get(pairs, s).term,
              'tf', coalesce(get(starts, j + 1), field_len) - s,
              'positions', transform(
                  slice(pairs, s + 1, coalesce(get(starts, j + 1), field_len) - s),
                  p -> p.pos))))"""
    )
    return (
        analyze_fields(docs, analyzer, fields)
        .select("url", "field", F.size("terms").alias("field_len"), pairs.alias("pairs"))
        .withColumn("starts", run_starts)
        .select("field", "url", "field_len", runs)
        .select("field", "term", "url", "tf", "field_len", "positions")
    )


def pack_postings(
    docs: DataFrame, analyzer: Analyzer, shards: int, fields: list[str] = TEXT_FIELDS
) -> DataFrame:
    """The rows of ``build_postings``, packed: one row per document, field and shard.

    ``terms`` are the shard's terms in order, ``firsts`` where the positions of each
    begin in ``places``. A shuffle of these carries a url once a shard, not once a term.
    Result: (url, field, field_len, shard_<shards>, terms, firsts, places).
    """
    kind = (
        f"url string, field string, field_len int, shard_{shards} int, "
        "terms array<string>, firsts array<int>, places array<int>"
    )

    def run(batches):
        for batch in batches:
            for piece in _pieces(batch, pc.list_value_length(batch.column(2))):
                yield _packed(piece, shards)

    return analyze_fields(docs, analyzer, fields).select("url", "field", "terms").mapInArrow(run, kind)


def _packed(batch: pa.RecordBatch, shards: int) -> pa.RecordBatch:
    """Packed rows of a batch of (url, field, terms)."""
    url, field, texts = (batch.column(i) for i in range(3))
    sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy().astype(np.int64)
    words, codes = _ranked(texts.flatten())
    hashes = [xxhash.xxh64_intdigest(w, HASH_SEED) for w in words.cast(pa.binary()).to_pylist()]
    shard_of = np.array(hashes, dtype=np.uint64).view(np.int64) % shards
    # sorted by row, shard and term; what is equal stays in text order
    row = np.repeat(np.arange(len(sizes)), sizes)
    part = row * shards + shard_of[codes]
    order = np.argsort(part * max(1, len(words)) + codes, kind="stable")
    part, codes = part[order], codes[order]
    new_part = np.diff(part, prepend=-1) != 0
    runs = np.flatnonzero(new_part | (np.diff(codes, prepend=-1) != 0))
    parts = np.flatnonzero(new_part)
    at = np.searchsorted(runs, np.append(parts, len(order)))
    places = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
    row, held = row[order][parts], pa.array(np.append(parts, len(order)), pa.int32())
    as_int = lambda x: pa.array(x, pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            url.take(pa.array(row)),
            field.take(pa.array(row)),
            as_int(sizes[row]),
            as_int(part[parts] % shards),
            pa.ListArray.from_arrays(as_int(at), words.take(pa.array(codes[runs]))),
            pa.ListArray.from_arrays(as_int(at), as_int(runs - np.repeat(parts, np.diff(at)))),
            pa.ListArray.from_arrays(held, as_int(places)),
        ],
        names=["url", "field", "field_len", f"shard_{shards}", "terms", "firsts", "places"],
    )


def unpack_postings(packed: DataFrame) -> DataFrame:
    """Postings of ``pack_postings``, with its shard column last.

    They come in runs sorted by field, shard and term: sorting them whole is a merge.
    """
    shard = next(c for c in packed.columns if c.startswith("shard_"))
    kind = (
        "field string, term string, url string, tf int, field_len int, "
        f"positions array<int>, {shard} int"
    )

    def run(batches):
        for batch in batches:
            yield from _pieces(batch, pc.list_value_length(batch.column(4)))

    columns = ["url", "field", "field_len", shard, "terms", "firsts", "places"]
    return packed.select(*columns).mapInArrow(lambda batches: _unpacked(run(batches)), kind)


def bundle_postings(
    docs: DataFrame, analyzer: Analyzer, shards: int, parts: int, fields: list[str] = TEXT_FIELDS
) -> DataFrame:
    """The rows of ``pack_postings`` in compressed bundles, dealt to about ``parts`` tasks.

    A bundle has the rows of one field and shard among some thousand documents: each term
    and url once, and numbers. Few directories meet in a task: with fewer parts than shards
    a part takes neighbouring shards, with more a shard's bundles take turns.
    """
    together = max(1, shards // parts)
    turns = max(1, -(-parts // shards))
    n_parts = -(-shards // together) * turns

    def run(batches):
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for piece in _pieces(batch, pc.list_value_length(batch.column(2))):
                found = [*_bundles(_packed(piece, shards))]
                part = [shard // together * turns + turn % turns for shard, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array([data for _, data in found], pa.binary())],
                    names=["part", "data"],
                )
                turn += 1

    analyzed = analyze_fields(docs, analyzer, fields).select("url", "field", "terms")
    return analyzed.mapInArrow(run, "part int, data binary").repartitionById(n_parts, "part")


def unbundle_postings(bundles: DataFrame, shards: int) -> DataFrame:
    """Postings of ``bundle_postings``, as ``unpack_postings`` gives them."""
    kind = (
        "field string, term string, url string, tf int, field_len int, "
        f"positions array<int>, shard_{shards} int"
    )

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                yield _from_bundle(data.as_buffer(), shards)

    return bundles.select("data").mapInArrow(lambda batches: _unpacked(run(batches)), kind)


def _bundles(packed: pa.RecordBatch):
    """(shard, bytes) of each field and shard in packed rows."""
    shard = packed.column(3).to_numpy().astype(np.int64)
    _, fields = _ranked(packed.column(1))
    group = fields * (shard.max(initial=0) + 1) + shard
    order = np.argsort(group, kind="stable")
    rows, group, shard = packed.take(pa.array(order)), group[order], shard[order]
    begins = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    for low, high in zip(begins, [*begins[1:], len(group)]):
        yield int(shard[low]), _as_bundle(rows.slice(low, high - low))


def _as_bundle(rows: pa.RecordBatch) -> bytes:
    url, field, field_len, shard, terms, firsts, places = rows.columns
    words = terms.flatten().dictionary_encode()
    n_terms = pc.list_value_length(terms).to_numpy()
    n_places = pc.list_value_length(places).to_numpy().astype(np.int64)
    begins = firsts.flatten().to_numpy() + np.repeat(np.cumsum(n_places) - n_places, n_terms)
    held = [
        field[:1], shard[:1], url, _narrow(field_len), _narrow(n_terms), words.dictionary,
        _narrow(words.indices), _narrow(np.diff(begins, append=n_places.sum())), _narrow(places.flatten()),
    ]
    # columns of different lengths: each is the one list of its column
    one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in held]
    batch = pa.RecordBatch.from_arrays(one, names=[str(i) for i in range(len(one))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _narrow(numbers: pa.Array | np.ndarray) -> pa.Array:
    """Numbers from 0 in the least bytes that hold them."""
    x = np.asarray(numbers)
    most = x.max(initial=0)
    return pa.array(x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32))


def _from_bundle(data: pa.Buffer, shards: int) -> pa.RecordBatch:
    """Packed rows of a bundle."""
    batch = pa.ipc.open_stream(data).read_next_batch()
    field, shard, url, field_len, n_terms, words, codes, tfs, places = (c.flatten() for c in batch.columns)
    n_terms, tfs = n_terms.to_numpy().astype(np.int64), tfs.to_numpy().astype(np.int64)
    ends, begins = np.append(0, np.cumsum(n_terms)), np.append(0, np.cumsum(tfs))
    firsts = begins[:-1] - np.repeat(begins[ends[:-1]], n_terms)
    as_int = lambda x: pa.array(x, pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            url,
            pa.repeat(field[0], len(url)),
            field_len.cast(pa.int32()),
            pa.repeat(shard[0], len(url)),
            pa.ListArray.from_arrays(as_int(ends), words.take(codes)),
            pa.ListArray.from_arrays(as_int(ends), as_int(firsts)),
            pa.ListArray.from_arrays(as_int(begins[ends]), places.cast(pa.int32())),
        ],
        names=["url", "field", "field_len", f"shard_{shards}", "terms", "firsts", "places"],
    )


def _unpacked(packed):
    """Batches of postings from batches of packed rows, ``HELD_TERMS`` terms at a time."""
    held, size = [], 0
    for piece in packed:
        held.append(piece)
        size += len(piece.column(4).flatten())
        if size >= HELD_TERMS:
            yield from _slices(_postings_of(held))
            held, size = [], 0
    if size:
        yield from _slices(_postings_of(held))


def _postings_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    url, field, field_len, number, terms, firsts, places = rows.columns
    n_terms = pc.list_value_length(terms).to_numpy().astype(np.int64)
    n_places = pc.list_value_length(places).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n_terms)), n_terms)
    begins = firsts.flatten().to_numpy() + (np.cumsum(n_places) - n_places)[row]
    words, codes = _ranked(terms.flatten())
    _, fields = _ranked(field)
    numbers = number.to_numpy().astype(np.int64)
    directory = fields * (numbers.max() + 1) + numbers
    order = np.argsort(directory[row] * len(words) + codes, kind="stable")
    row = pa.array(row[order])
    ends = pa.array(np.append(begins, n_places.sum()), pa.int32())
    positions = pa.ListArray.from_arrays(ends, places.flatten()).take(pa.array(order))
    return pa.RecordBatch.from_arrays(
        [
            field.take(row),
            words.take(pa.array(codes[order])),
            url.take(row),
            pc.list_value_length(positions),
            field_len.take(row),
            positions,
            number.take(row),
        ],
        names=["field", "term", "url", "tf", "field_len", "positions", rows.schema.names[3]],
    )


def _ranked(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct texts in order and the place of each text among them."""
    coded = texts.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def _pieces(batch: pa.RecordBatch, sizes: pa.Array):
    """Rows of a batch, so many together that they hold ``HELD_TERMS`` terms or a bit more."""
    sizes = pc.fill_null(sizes, 0).to_numpy().astype(np.int64)
    piece = (np.cumsum(sizes) - sizes) // HELD_TERMS
    begins = np.flatnonzero(np.diff(piece, prepend=-1))
    for low, high in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows]):
        yield batch.slice(low, high - low)


def _slices(batch: pa.RecordBatch):
    for low in range(0, batch.num_rows, SENT_ROWS):
        yield batch.slice(low, SENT_ROWS)


def term_stats(postings: DataFrame) -> DataFrame:
    """Document frequency per (field, term)."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def stem_counts(analyzed: DataFrame) -> DataFrame:
    """How often each stem occurs: (field, stem, n) from unstemmed (field, terms).

    Words are counted first, so only the distinct vocabulary is stemmed.
    """
    words = analyzed.select("field", F.explode("terms").alias("term"))
    counted = words.groupBy("field", "term").agg(F.count("*").alias("n"))
    stemmed = counted.withColumn("stem", F.get(stem_tokens(F.array("term")), F.lit(0)))
    return stemmed.groupBy("field", "stem").agg(F.sum("n").alias("n"))


def field_terms(postings: DataFrame, field: str) -> DataFrame:
    """Terms of one field with their document frequency."""
    return term_stats(postings.filter(F.col("field") == field)).select("term", "df")


def field_stats(
    docs: DataFrame, analyzer: Analyzer = Analyzer(), fields: list[str] = TEXT_FIELDS
) -> DataFrame:
    """Number of documents and mean length per field; one row per field."""
    return (
        analyze_fields(docs, analyzer, fields)
        .groupBy("field")
        .agg(F.count("*").alias("n_docs"), F.avg(F.size("terms")).alias("avg_len"))
    )


# Executors get this code inside the task and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
