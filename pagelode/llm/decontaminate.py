"""Benchmark decontamination by a prefix-filtered set join.

A window of an item can only occur in a document that holds the window's rarest
word, so that word alone is joined: it is the necessary prefix of the window under the
order by rarity in the corpus. Where a document word meets a prefix, its position and
the word's place in the window give the one span that could hold the window. Spans
that would leave the document are dropped, the others compared word by word.

The windows of the items are the query set. Their index reaches the executors in
blocks of a checked size, and every block meets all rows. Documents are never shuffled,
so hot sources, groups of copies and shared passages cost no more than other rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import stage
from .common import own_names, text_or_empty

#: Bytes of item words whose windows are broadcast together.
BLOCK_BYTES = 2 * 1024 * 1024
#: Words of an item that stay in one piece; longer items are cut with overlaps.
PIECE_WORDS = 20_000
#: Fixed value of the contract: words are runs of ASCII letters, digits and non-ASCII.
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TABLE = bytes(c if c in _KEPT else 32 for c in bytes(range(256)).lower())

_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def item_words(text: bytes | None) -> list[bytes]:
    """Lower-case words of a text in UTF-8; none for null."""
    return text.translate(_TABLE).split() if text else []


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """Rows (item, words): items cut so that every window lies in exactly one piece."""

    def cut(batches):
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            rows = [
                (i, b" ".join(w[s : s + PIECE_WORDS + window - 1]))
                for i, w in zip(ids, map(item_words, texts), strict=True)
                for s in range(0, max(1, len(w) - window + 1), PIECE_WORDS)
                if w
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())],
                names=["item", "words"],
            )

    return items.mapInArrow(cut, "item string, words binary").distinct()


def _corpus_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each of a block's words stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known, found = shared.value, defaultdict(int)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word in filter(known.__contains__, item_words(text)):
                    found[word] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
            names=["word", "n"],
        )

    counts = docs.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n"))
    return {bytes(word): n for word, n in counts.collect()}  # no more than the block's words


class WindowIndex:
    """The windows of one block: prefix words with their places, windows with items."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], counts: dict, window: int):
        self.places: dict[bytes, set] = defaultdict(set)
        self.windows: dict[tuple, tuple] = {}
        for item, words in pieces:
            size = min(window, len(words))
            for start in range(len(words) - size + 1):
                span = tuple(words[start : start + size])
                known = self.windows.get(span)
                if known is None:
                    at = min(range(size), key=lambda k: (counts.get(span[k], 0), span[k]))
                    self.places[span[at]].add((at, size))
                    self.windows[span] = (item,)
                elif item not in known:
                    self.windows[span] = (*known, item)
        self.places = {word: sorted(p) for word, p in self.places.items()}
        self.prefixes = frozenset(self.places)

    def find(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """Starts and ends of the spans that windows occupy, merged, and the items."""
        if self.prefixes.isdisjoint(words):
            return [], [], set()
        places, windows, n = self.places, self.windows, len(words)
        spans, items = set(), set()
        for at, word in enumerate(words):
            for offset, size in places.get(word, ()):
                start = at - offset
                if start < 0 or start + size > n:
                    continue
                found = windows.get(tuple(words[start : start + size]))
                if found:
                    spans.add((start, start + size))
                    items.update(found)
        return *merge_spans(sorted(spans)), items


def merge_spans(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Sorted spans as starts and ends of their union."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _apply_block(docs: DataFrame, shared, kept: list[str]) -> DataFrame:
    """One pass: adds a block's spans and items to those of earlier blocks."""
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("_found", _FOUND)])

    def run(batches):
        index = shared.value
        for batch in batches:
            before = batch.column("_found").to_pylist()
            found = []
            for text, old in zip(batch.column("_text").to_pylist(), before, strict=True):
                words = item_words(text)
                starts, ends, items = index.find(words)
                if old and old["starts"]:
                    both = sorted([*zip(starts, ends), *zip(old["starts"], old["ends"])])
                    starts, ends = merge_spans(both)
                    items |= set(old["items"])
                found.append((len(words), starts, ends, sorted(items)))
            kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
            columns = [
                pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)
            ]
            struct = pa.StructArray.from_arrays(columns, names=_FOUND.names)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], struct], names=[*kept, "_found"]
            )

    return docs.mapInArrow(run, schema)


@own_names
def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    share_pct: int = 5,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All columns of ``docs`` and the struct ``contamination`` (replaced if there).

    Its fields: n_words, n_hit (words inside any occurrence of a window), items (ids
    as strings, sorted, each once), starts and ends (word spans, merged) and
    contaminated: some word is hit and the hits are ``share_pct`` percent of the words
    or more. A window is ``window`` consecutive words of an item; an item with fewer
    words is one window, an item without words none. Null texts have no words; a null
    item id counts as an empty id. Repeated documents are judged alike, repeated items
    count once, and an empty benchmark contaminates nothing.
    """
    kept = [c for c in docs.columns if c != "contamination"]
    source = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
        text_or_empty(item_text).cast("binary").alias("words"),
    )
    pieces = stage(_pieces(source, window), "item-pieces")
    size = pieces.agg(F.sum(F.octet_length("words") + F.octet_length("item"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    numbered = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))

    texts = docs.select(text_or_empty(text).cast("binary").alias("_text"))
    state = docs.select(
        *kept, text_or_empty(text).cast("binary").alias("_text"), F.lit(None).cast(_FOUND).alias("_found")
    )
    carried = [*kept, "_text"] if blocks > 1 else kept
    for block in range(blocks):
        rows = numbered.filter(F.col("block") == block).select("item", "words").collect()
        split = [(r["item"], bytes(r["words"]).split()) for r in rows]
        vocabulary = {word for _, words in split for word in words}
        counts = _corpus_counts(texts, vocabulary) if vocabulary else {}
        index = docs.sparkSession.sparkContext.broadcast(WindowIndex(split, counts, window))
        last = block == blocks - 1
        state = _apply_block(state, index, kept if last else carried)
        if not last:  # one block's index at a time in a worker
            state = stage(state, "contamination-block")
    found = F.col("_found")
    hit = F.coalesce(
        F.aggregate(
            F.zip_with(found["ends"], found["starts"], lambda e, s: e - s),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        ),
        F.lit(0).cast("long"),
    )
    return state.select(
        *kept,
        F.struct(
            found["n_words"].alias("n_words"),
            hit.alias("n_hit"),
            found["items"].alias("items"),
            found["starts"].alias("starts"),
            found["ends"].alias("ends"),
            ((hit > 0) & (100 * hit >= share_pct * found["n_words"])).alias("contaminated"),
        ).alias("contamination"),
    )
