"""Phrase collocations by prefix-free parsing.

1. *Parsing.* A piece of words is cut before every window of ``max_words - 1`` words whose
   hash is a multiple of ``spacing``; the window belongs to both chunks it separates. So
   equal passages give equal chunks wherever they stand, and no phrase of ``max_words``
   words lies across a cut. The distinct chunks of a language and their frequencies, the
   dictionary, are written to the shared folder.
2. *Counting.* Phrases are counted inside distinct chunks only, times the chunk's
   frequency. A chunk counts the phrases that begin in the words before its closing
   window; those inside the window are the next chunk's.
3. *Levels.* Words are counted first, then phrases of two words, and so on. A phrase is
   counted only if both phrases of one word less inside it may be frequent. What may be
   frequent is a bit field of ``filter_bits`` bits, whatever the data's size: every
   frequent phrase sets its bit, so none is missed and the counts of what passes are
   exact. A field that fills up on very large data only filters less.

Each task adds up its own counts before they are shuffled by (lang, phrase), so a common
word or passage arrives as one row per task.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.joins import join_small
from ..session import stage
from .common import text_or_empty

#: Fixed values of the contract: where a phrase cannot go on, and what parts words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: A text's bytes with A-Z in lower case, every end as a line feed, every blank as a space.
_READ = bytes(10 if c in ENDS else 32 if c in BLANKS else c for c in bytes(range(256)).lower())


@dataclass(frozen=True)
class PhraseRules:
    """Phrases of 2 to ``max_words`` words; the first four figures are the contract's.

    ``spacing``: mean distance of cuts; ``filter_bits``: size of the field of phrases
    that may be frequent; ``batch_bytes``: text that a task handles together, a longer
    row by itself. None of the last three changes a result.
    """

    max_words: int = 3
    min_count: int = 10
    covered_percent: int = 50
    per_lang: int = 2000
    spacing: int = 16
    filter_bits: int = 1 << 26
    batch_bytes: int = 1 << 23


def _hash(words: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in words], dtype=np.uint64)


def _mix(hashes: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; whole-array arithmetic modulo 2^64."""
    with np.errstate(over="ignore"):
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return hashes ^ (hashes >> np.uint64(29))


def _window_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of the words side by side, from a hash for each word."""
    total = np.zeros(len(parts[0]), dtype=np.uint64)
    for part in parts:
        with np.errstate(over="ignore"):
            total = _mix(total * np.uint64(31) + part)
    return total


def _runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of several runs laid end to end."""
    starts = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(starts, lengths)


def _words(column: pa.Array, table: bytes | None = None):
    """(words, the row of each, the piece of each) of binary values, by whole arrays.

    Words are what spaces and line feeds part; a line feed or a row's end ends a piece.
    """
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    raw = bytes(column.buffers()[2])[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else b""
    data = np.frombuffer(raw if table is None else raw.translate(table), np.uint8)
    offsets = offsets - offsets[0]
    inside = (data != 32) & (data != 10)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    kept = np.cumsum(inside, dtype=np.int32)
    ends = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
    words = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])]
    )
    row = np.searchsorted(offsets[1:], starts, side="right")
    breaks = np.flatnonzero(data == 10)
    return words, row, row + np.searchsorted(breaks, starts)


def _coded(words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, and the distinct words."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _sizes(groups: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal values in a rising array."""
    edges = np.flatnonzero(np.diff(groups)) + 1
    return np.diff(np.concatenate([[0], edges, [len(groups)]])) if len(groups) else edges


def _together(batches, rules: PhraseRules):
    """Record batches cut and joined to about ``batch_bytes`` of their last column."""
    waiting, size = [], 0
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset :][: len(text) + 1].astype(np.int64)
        at = 0
        while at < batch.num_rows:
            room = max(1, rules.batch_bytes - size)
            to = int(np.searchsorted(ends, ends[at] + room, side="left"))
            to = min(max(to, at + 1), batch.num_rows)
            waiting.append(batch.slice(at, to - at))
            size += int(ends[to] - ends[at])
            at = to
            if size >= rules.batch_bytes:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, size = [], 0
    if size or waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _binary(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks().cast(pa.binary())


def _joined(words: pa.Array, begins: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Words from each begin on, as many as its length, joined by blanks."""
    at = np.repeat(begins, lengths) + _runs(lengths)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(at)))
    return pc.binary_join(lists, b" ")


def _chunks(words: pa.Array, pieces: np.ndarray, langs: np.ndarray, rules: PhraseRules):
    """(lang, chunk, closed, times) from words with the piece and language of each.

    An unclosed chunk ends its piece.
    """
    width = rules.max_words - 1
    codes, distinct = _coded(words)
    n = _sizes(pieces)
    inside = _runs(n)
    left = np.repeat(n, n) - inside  # words from here to the end of the piece
    hashes = _hash(distinct)[codes]
    last = len(codes) - width + 1
    cut = inside == 0
    if last > 0:
        trigger = _window_hash([hashes[i : i + last] for i in range(width)])
        cut[:last] |= (trigger % np.uint64(rules.spacing) == 0) & (left[:last] >= width)
    begins = np.flatnonzero(cut)
    lengths = np.diff(np.append(begins, len(codes)))
    closed = left[begins] > lengths  # another chunk of the piece follows
    text = _joined(words, begins, lengths + np.where(closed, width, 0))
    found = pa.table({"lang": langs[begins], "chunk": text, "closed": closed})
    return found.group_by(["lang", "chunk", "closed"]).aggregate([([], "count_all")])


def _dictionary(docs: DataFrame, text: str, lang: str, rules: PhraseRules) -> DataFrame:
    """Distinct chunks with their frequency: (lang, closed, times, chunk)."""
    whole = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        text_or_empty(F.col(text)).alias("text"),
    )

    def parse(batches):
        for table in _together(batches, rules):
            names = table["lang"].combine_chunks().dictionary_encode()
            words, row, pieces = _words(_binary(table["text"]), _READ)
            if not len(words):
                continue
            langs = names.indices.to_numpy(zero_copy_only=False)[row]
            found = _chunks(words, pieces, langs, rules)
            out = pa.table(
                {
                    "lang": names.dictionary.take(found["lang"].combine_chunks()),
                    "closed": found["closed"],
                    "times": found["count_all"],
                    "chunk": found["chunk"].cast(pa.string()),
                }
            )
            yield from out.to_batches(max_chunksize=100_000)

    parsed = whole.mapInArrow(parse, "lang string, closed boolean, times long, chunk string")
    found = parsed.groupBy("lang", "chunk", "closed").agg(F.sum("times").alias("times"))
    return found.select("lang", "closed", "times", "chunk")


def _places(lang: np.ndarray, words: list[np.ndarray], bits: int) -> np.ndarray:
    """Place in the bit field, from the hashes of the language and of each word."""
    return ((_window_hash([lang, *words]) >> np.uint64(7)) % np.uint64(bits)).astype(np.int64)


def _frequent_bits(frequent: DataFrame, bits: int) -> np.ndarray:
    """The bit field of phrases (lang, phrase); as large for any number of them."""

    def places(batches):
        for batch in batches:
            lists = [w.encode().split(b" ") for w in batch.column(1).to_pylist()]
            if not lists:
                continue
            langs = _hash([x.encode() for x in batch.column(0).to_pylist()])
            hashes = np.array([[zlib.crc32(w) for w in x] for x in lists], dtype=np.uint64)
            place = _places(langs, list(hashes.T), bits)
            yield pa.RecordBatch.from_pydict({"place": place >> 6, "bit": (place & 63).astype(np.int32)})

    placed = frequent.select("lang", "phrase").mapInArrow(places, "place long, bit int")
    filled = placed.groupBy("place").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    table = filled.toArrow()
    field = np.zeros((bits + 63) >> 6, dtype=np.int64)
    field[table["place"].to_numpy()] = table["bits"].to_numpy()
    return field


def _may_be_frequent(field: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (field[places >> 6] >> (places & 63)) & 1 == 1


def _summed(lang: np.ndarray, codes: list[np.ndarray], size: int, weights: np.ndarray):
    """Place of the first and the sum of weights for each distinct (lang, codes)."""
    key, span = lang, int(lang.max()) + 1
    for code in codes:
        if span * size >= 2**62:  # number what there is anew, so that keys stay longs
            found, key = np.unique(key, return_inverse=True)
            span = len(found)
        key, span = key * size + code, span * size
    order = np.argsort(key)
    ranked = key[order]
    edges = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return order[edges], np.add.reduceat(weights[order], edges)


def _counts(dictionary: DataFrame, length: int, field, rules: PhraseRules) -> DataFrame:
    """Frequent phrases of ``length`` words: (lang, phrase, f); for words, all of them."""
    shared = dictionary.sparkSession.sparkContext.broadcast(field)
    width = rules.max_words - 1

    def count(batches):
        for table in _together(batches, rules):
            names = table["lang"].combine_chunks().dictionary_encode()
            words, row, _ = _words(_binary(table["chunk"]))
            codes, distinct = _coded(words)
            n = np.bincount(row, minlength=table.num_rows)  # every chunk has a word
            shut = table["closed"].to_numpy()
            own = n - np.where(shut, width, 0)  # phrases begin in these words
            inside = _runs(n)
            begins = np.flatnonzero((inside < own[row]) & (inside + length <= n[row]))
            lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row[begins]]
            if length > 1:
                bits, hashes = shared.value, _hash(distinct)[codes]
                lang_hash = _hash([x.encode() for x in names.dictionary.to_pylist()])[lang]
                fits = np.ones(len(begins), dtype=bool)
                for skip in (0, 1):  # the phrase without its last and its first word
                    inner = [hashes[begins + skip + i] for i in range(length - 1)]
                    fits &= _may_be_frequent(bits, _places(lang_hash, inner, rules.filter_bits))
                begins, lang = begins[fits], lang[fits]
            if not len(begins):
                continue
            weights = table["times"].to_numpy()[row[begins]]
            first, totals = _summed(lang, [codes[begins + i] for i in range(length)], len(distinct), weights)
            phrases = _joined(words, begins[first], np.full(len(first), length, dtype=np.int64))
            out = pa.table(
                {
                    "lang": names.dictionary.take(pa.array(lang[first])),
                    "phrase": phrases.cast(pa.string()),
                    "f": totals,
                }
            )
            yield from out.to_batches(max_chunksize=100_000)

    columns = dictionary.select("lang", "closed", "times", "chunk")
    found = columns.mapInArrow(count, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", rules: PhraseRules = PhraseRules()
) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, words, phrase, f) and all word occurrences (lang, n).

    ``words`` is the phrase's number of words, from 1 to ``max_words``; f is at least
    ``min_count``. Both are written tables. Null texts have no words; a null language
    is ``und``. An empty table gives empty tables.
    """
    dictionary = stage(_dictionary(docs, text, lang, rules), "chunks")
    width = rules.max_words - 1
    owned = F.size(F.split("chunk", " ")) - F.when(F.col("closed"), width).otherwise(0)
    totals = stage(
        dictionary.groupBy("lang").agg(F.sum(F.col("times") * owned).alias("n")), "word-totals"
    )
    levels, field = [], None
    for length in range(1, rules.max_words + 1):
        if levels:
            field = _frequent_bits(levels[-1], rules.filter_bits)
        counted = _counts(dictionary, length, field, rules).filter(F.col("f") >= rules.min_count)
        levels.append(stage(counted, f"phrases-{length}"))
    frequent = None
    for length, level in enumerate(levels, 1):
        sized = level.select("lang", F.lit(length).alias("words"), "phrase", "f")
        frequent = sized if frequent is None else frequent.unionByName(sized)
    return frequent, totals


def _part(first: str, count: str):
    return F.concat_ws(" ", F.slice("_w", F.expr(first), F.expr(count)))


def score_phrases(frequent: DataFrame, rules: PhraseRules = PhraseRules()) -> DataFrame:
    """Candidates with their lowest-scoring cut: (lang, words, phrase, a, k, l, r, score).

    Score is floor(1000000 * a * a / (l * r)) in whole numbers of up to 38 digits. Of
    cuts that score alike the first counts.
    """
    candidates = frequent.filter("words > 1").withColumn("_w", F.split("phrase", " "))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "words", "phrase", F.col("f").alias("a"), "k",
        _part("1", "k").alias("_first"), _part("k + 1", "words - k").alias("_rest"),
    )

    def known(side: str, name: str) -> DataFrame:
        return frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))

    for side, name in (("_first", "l"), ("_rest", "r")):
        # a part has one row; parts of very many phrases are split by the skew join
        cuts = cuts.join(known(side, name), ["lang", side])
    a, l, r = [F.col(c).cast("decimal(18,0)") for c in "alr"]
    product = (F.lit(1_000_000).cast("decimal(7,0)") * a * a).alias("_above")
    exact = cuts.select("*", product, (l * r).alias("_below"))
    scored = exact.withColumn("score", F.expr("cast(_above div _below as bigint)"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("m")
    return scored.groupBy("lang", "words", "phrase", "a").agg(lowest).select(
        "lang", "words", "phrase", "a", "m.k", "m.l", "m.r", "m.score"
    )


def _not_covered(scored: DataFrame, rules: PhraseRules) -> DataFrame:
    """Without the phrases that a longer candidate holds often enough."""
    longer = scored.filter("words > 2").withColumn("_w", F.split("phrase", " "))
    inner = longer.select(
        "lang",
        F.col("a").alias("_longer"),
        F.explode(
            F.expr(
                "flatten(transform(sequence(2, words - 1), m -> transform("
                "sequence(1, words - m + 1), i -> array_join(slice(_w, i, m), ' '))))"
            )
        ).alias("phrase"),
    )
    most = inner.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    joined = scored.join(most, ["lang", "phrase"], "left")
    covered = F.coalesce(
        100 * F.col("_longer") >= rules.covered_percent * F.col("a"), F.lit(False)
    )
    return joined.filter(~covered).drop("_longer")


def _best(scored: DataFrame, rules: PhraseRules) -> DataFrame:
    """The first ``per_lang`` of each language with their ``rank``.

    A coarse count of scores (1,001 steps) tells from which score on a language has
    enough phrases; what lies below does not reach the ranking. Every part of the rest
    gives its own first rows before they meet.
    """
    step = F.expr("score div 1000").alias("step")
    steps = scored.groupBy("lang", step).agg(F.count("*").alias("n"))
    above = Window.partitionBy("lang").orderBy(F.col("step").desc())
    enough = steps.withColumn("n", F.sum("n").over(above)).groupBy("lang").agg(
        F.coalesce(
            F.max(F.when(F.col("n") >= rules.per_lang, F.col("step"))), F.lit(0)
        ).alias("least")
    )
    high = join_small(scored, enough, ["lang"], spread=["phrase"])
    kept = high.filter(F.col("score") >= F.col("least") * 1000).drop("least")
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    for keys in (["lang", "_part"], ["lang"]):
        window = Window.partitionBy(*keys).orderBy(*order)
        salted = salted.withColumn("rank", F.row_number().over(window)).filter(
            F.col("rank") <= rules.per_lang
        )
    return salted.drop("_part")


def mine_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", rules: PhraseRules = PhraseRules()
) -> DataFrame:
    """Collocations of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), cut where a phrase cannot go on, and split into words.
    ``a`` counts the phrase, ``l`` and ``r`` its two parts at the lowest-scoring cut, ``n``
    all words of the language. Null and empty texts count for nothing, a null language is
    ``und``; repeated rows count each time. Ranks are without ties: score and a falling,
    then the phrase by its bytes. Other columns of ``docs`` are not read.
    """
    frequent, totals = phrase_counts(docs, text, lang, rules)
    scored = stage(score_phrases(frequent, rules), "scored-phrases")
    best = _best(stage(_not_covered(scored, rules), "ranked-phrases"), rules)
    return best.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
