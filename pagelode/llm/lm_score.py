"""Language-model scores of texts.

Words are written as subword ids of a given tokenizer. The texts are read twice:

1. The first pass over the training texts counts words, and adds up for every id what
   stands beside it and in its texts, as a short vector of whole numbers. Ids with like
   vectors make the classes of the attention model. The pass also keeps the texts' ids.
2. The model is trained in a few rounds, each on its share of the texts, every window
   once. A round deals its texts by a hash of id and text to parts of like size, trains
   every part from the same weights and averages them by tokens. Neither the classes nor
   the weights depend on how the input is split.
3. The second pass scores every text whole, in batches of overlapping windows. A word's
   probability is that of its subword ids, mixed with the word's base probability.

Both scores need the count of each word. Words above a fixed rank travel to the tasks
as a table of bounded size; all others meet their counts in a shuffle join, as one row
for each text and word that carries what the model gave each of its occurrences.
Nothing that grows with the corpus reaches the driver.
"""

from __future__ import annotations

import base64
from array import array
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import text_or_empty
from .lm_model import (
    CLASSES, CONTEXT, END, PAD, Tables, Trainer, log_probs, pack, start_weights, unpack, windows,
)

KEPT_WORDS = 300_000
#: Bytes of texts that a worker takes together.
HELD_BYTES = 1 << 20
#: Words whose counts are broadcast, and their longest length: bounds of that table.
COMMON_WORDS, COMMON_BYTES = 50_000, 48
#: Windows of one scoring batch: their logits stay in a core's own cache.
BATCH = 128
#: Entries of an id's vector: half tell its neighbours, half its texts.
TRAITS = 16
#: A text's mean is told in this many steps, so that sums are exact.
STEPS = 256
#: Rows of the table of vectors that travel together, and states that one task adds up.
ROWS, FAN_IN = 1024, 64


@dataclass(frozen=True)
class LmRules:
    """Shape of the model's classes and of the mixture."""

    own_classes: int = 30  # ids that are a class of their own
    word_share: float = 0.65  # of the base probability in a word's probability
    step: int = 32  # windows of a training step at least
    steps: int = 256  # of a part in one round at most: larger parts take larger steps
    rate: float = 0.05  # of the first round's steps
    rounds: int = 3  # averaged one after the other
    part_ids: int = 2_000_000  # ids that a part has, all rounds together


class Subwords:
    """Subword ids of words; what was looked up stays at hand.

    A word is told by its place among the words met so far; place 0 is the end of a text,
    which has one id, the first beyond the vocabulary.
    """

    def __init__(self, spec: tuple[str, dict]):
        pattern, ranks = spec
        self.spec = spec
        self.coder = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = 1 + max(ranks.values())
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes | None, int] = {None: 0}
        self._ids, self._starts, self._sizes = array("i", [self.end]), array("q", [0]), array("i", [1])

    def full(self) -> bool:
        return len(self.known) > KEPT_WORDS

    def words(self, start: int = 0) -> list[bytes | None]:
        """Words from a place on, in the order of their places."""
        return list(islice(self.known, start, None))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words, each text's followed by its end, and how many each text has."""
        words: list[bytes | None] = []
        counts = []
        for text in texts:
            found = split_lower(text)
            words += found
            words.append(None)
            counts.append(len(found) + 1)
        known = self.known
        places = np.array(list(map(known.get, words, repeat(-1))), dtype=np.int64)
        for i in np.flatnonzero(places < 0).tolist():
            word = words[i]
            if word not in known:
                known[word] = len(known)
                ids = self.coder.encode_ordinary(" " + word.decode("utf-8", "replace"))
                self._starts.append(len(self._ids))
                self._sizes.append(len(ids))
                self._ids.extend(ids)
            places[i] = known[word]
        return places, np.array(counts, dtype=np.int64)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of those words in order, and how many each word has."""
        sizes = np.frombuffer(self._sizes, "i4")[places].astype(np.int64)
        starts = np.frombuffer(self._starts, "i8")[places]
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        return np.frombuffer(self._ids, "i4")[at], sizes


def read_ranks(path: str, pattern: str) -> tuple[str, dict]:
    """A vocabulary file of ranks, read on the driver."""
    with open(path, "rb") as file:
        pairs = (line.split() for line in file)
        return pattern, {base64.b64decode(a): int(b) for a, b in pairs}


_CODERS: dict = {}


def _subwords(shared) -> Subwords:
    """One coder for each worker process."""
    key = id(shared.value)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Subwords(shared.value)
    return _CODERS[key]


def split_lower(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case."""
    return text.lower().split()


def _pieces(batch: pa.RecordBatch):
    """Rows of a batch, so many together that their texts have ``HELD_BYTES`` or a bit more."""
    sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
    piece = (np.cumsum(sizes, dtype=np.int64) - sizes) // HELD_BYTES
    begins = np.flatnonzero(np.diff(piece, prepend=-1))
    for low, high in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows]):
        yield batch.slice(low, high - low)


def _begins(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _signs(size: int) -> np.ndarray:
    """A fixed vector of -1 and 1 for each id, and zeros for a text's border."""
    r = np.random.default_rng(11)
    half = r.integers(0, 2, size=(size + 1, TRAITS // 2)) * 2 - 1
    half[size] = 0
    return half.astype(np.int64)


def id_kind(size: int) -> np.dtype:
    """How ids of a vocabulary of that size are stored."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _read(train: DataFrame, coder, size: int) -> DataFrame:
    """One pass: rows of word counts, of the ids' counts and vectors, and of texts.

    A row has (word, n) or (chunk, part, table) or (key, ids). Table rows hold ``ROWS``
    ids: texts with the id's count, then its vector; the row after the last id has the
    number of texts.
    """
    schema = "word binary, n long, chunk int, part long, table binary, key long, ids binary"
    names = ["word", "n", "chunk", "part", "table", "key", "ids"]
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]

    kind = id_kind(size)

    def rows(**found):
        n = len(next(iter(found.values())))
        as_array = lambda x, t: x if isinstance(x, pa.Array) else pa.array(x, t)
        return pa.RecordBatch.from_arrays(
            [as_array(found[k], t) if k in found else pa.nulls(n, t) for k, t in zip(names, kinds)],
            names=names,
        )

    def run(batches):
        subwords, signs = _subwords(coder), _signs(size)
        table = np.zeros((size + 1, TRAITS + 1))
        counts = np.zeros(0, dtype=np.int64)

        def add(line: np.ndarray, lengths: np.ndarray) -> None:
            """Counts and vectors of texts, each with its border behind it."""
            sign = signs[line]
            beside = np.zeros_like(sign)
            beside[1:] += sign[:-1]
            beside[:-1] += sign[1:]
            means = np.add.reduceat(sign, _begins(lengths), axis=0) / np.maximum(1, lengths - 1)[:, None]
            inside = np.repeat(np.rint(means * STEPS).astype(np.int64), lengths, axis=0)
            order = np.argsort(line.astype(np.uint16) if size < 1 << 16 else line, kind="stable")
            seen = np.bincount(line, minlength=size + 1)
            used = np.flatnonzero(seen)
            begins = _begins(seen)[used]
            table[:, 0] += seen
            for k, half in ((1, beside), (1 + TRAITS // 2, inside)):
                table[used, k : k + TRAITS // 2] += np.add.reduceat(half[order], begins, axis=0)

        def word_rows():
            used = np.flatnonzero(counts[1:]) + 1
            words = subwords.words()
            return rows(word=[words[i] for i in used.tolist()], n=counts[used])

        for batch in batches:
            for piece in _pieces(batch):
                places, n_words = subwords(piece.column(1).to_pylist())
                seen = np.bincount(places, minlength=len(subwords.known))
                seen[: len(counts)] += counts
                counts = seen
                line, sizes = subwords.ids(places)
                lengths = np.add.reduceat(sizes, _begins(n_words))
                add(line, lengths)
                ends = np.concatenate([[0], np.cumsum(lengths - 1)]) * kind.itemsize
                data = line[line != size].astype(kind)
                ids = pa.Array.from_buffers(
                    pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]
                )
                yield rows(key=piece.column(0), ids=ids)
                if subwords.full():
                    yield word_rows()
                    subwords.clear()
                    counts = np.zeros(0, dtype=np.int64)
        yield word_rows()
        part = TaskContext.get().partitionId()
        used = [k for k in range(0, size + 1, ROWS) if table[k : k + ROWS, 0].any()]
        yield rows(
            chunk=[k // ROWS for k in used],
            part=[part] * len(used),
            table=[table[k : k + ROWS].tobytes() for k in used],
        )

    return train.mapInArrow(run, schema)


def _added(states: DataFrame, key: str, value: str) -> dict[int, np.ndarray]:
    """Sums of the arrays in ``value`` for each ``key``, in two levels by ``part``."""

    def add(group):
        order = np.lexsort((group.column("part").to_numpy(),))
        total = 0.0
        for i in order:  # always in the same order
            total = total + np.frombuffer(group.column(value)[int(i)].as_py())
        return pa.table(
            {key: group.column(key)[:1], "part": group.column("part")[:1], value: pa.array([total.tobytes()])},
            schema=group.schema,
        )

    columns = states.select(F.col(key).cast("int").alias(key), F.col("part").cast("long").alias("part"), value)
    kind = f"{key} int, part long, {value} binary"
    near = columns.groupBy(key, F.expr(f"part div {FAN_IN}").alias("_near")).applyInArrow(
        lambda group: add(group), kind
    )
    found = near.groupBy(key).applyInArrow(lambda group: add(group), kind).collect()
    return {r[key]: np.frombuffer(bytes(r[value])) for r in found}


def _clusters(vectors: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Nearest of ``k`` centres for each vector; the first centres lie far apart."""
    if k <= 1 or not len(vectors):
        return np.zeros(len(vectors), dtype=np.int64)
    heavy = np.argsort(-weight, kind="stable")[:2000]
    chosen = [heavy[0]]
    far = ((vectors[heavy] - vectors[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(heavy)):
        chosen.append(heavy[int(np.argmax(far * np.sqrt(weight[heavy])))])
        far = np.minimum(far, ((vectors[heavy] - vectors[chosen[-1]]) ** 2).sum(1))
    centres = vectors[chosen].copy()
    for _ in range(20):
        near = np.argmax(vectors @ centres.T - (centres**2).sum(1) / 2, axis=1)
        total = np.bincount(near, weights=weight, minlength=len(centres))
        for j in range(vectors.shape[1]):
            sums = np.bincount(near, weights=weight * vectors[:, j], minlength=len(centres))
            centres[:, j] = np.where(total > 0, sums / np.maximum(total, 1e-9), centres[:, j])
    return near


class Classes:
    """Class of each id and the log share of the id in its class."""

    def __init__(self, table: np.ndarray, texts: int, rules: LmRules):
        """``table`` has an id's count and vector in each row."""
        n, size = table[:, 0], len(table)
        order = np.argsort(-n, kind="stable")
        own = min(rules.own_classes, size)
        of = np.empty(size, dtype=np.int64)
        of[order[:own]] = 2 + np.arange(own)
        rest = order[own:]
        mean = table[:, 1:] / np.maximum(n, 1)[:, None]
        mean -= (mean * n[:, None]).sum(0) / max(1.0, n.sum())
        spread = np.sqrt((mean**2 * n[:, None]).sum(0) / max(1.0, n.sum()))
        # what few occurrences tell counts less
        vectors = mean / np.maximum(spread, 1e-9) * (n / (n + 4))[:, None]
        of[rest] = 2 + own + _clusters(vectors[rest], n[rest] + 1e-3, CLASSES - 2 - own)
        smooth = n + 0.5
        totals = np.bincount(of, weights=smooth, minlength=CLASSES)
        self.of = of
        self.log_share = np.log(smooth / totals[of])
        totals[END] = texts + 0.5
        totals[0] = 1e-9
        self.log_prior = np.log(np.maximum(totals, 1e-9) / totals.sum())


def _trained(texts: DataFrame, classes, start: dict, ids: int, kind: np.dtype, rules: LmRules) -> dict:
    """Weights after all rounds; ``texts`` has (key, ids) of the training texts."""
    parts = max(1, -(-ids // rules.part_ids))
    spark = texts.sparkSession
    dealt = texts.withColumn("part", F.pmod("key", F.lit(parts))).withColumn(
        "round", F.pmod(F.shiftright("key", 32), F.lit(rules.rounds))
    )

    def trainer_of(shared, rate: float):
        def train(key, group):
            of, begin = shared.value
            order = np.lexsort((group.column("key").to_numpy(),))
            lines = [np.frombuffer(group.column("ids")[int(i)].as_py(), kind) for i in order]
            trainer = Trainer({k: w.copy() for k, w in begin.items()}, rate)
            x = np.concatenate([windows(np.append(of[line], END)) for line in lines])
            size = max(rules.step, -(-len(x) // rules.steps))
            for at in range(0, len(x), size):
                trainer.step(x[at : at + size])
            tokens = len(x) * CONTEXT
            state = np.append(pack(trainer.w) * tokens, tokens)
            return pa.table(
                {"all": pa.array([0], pa.int32()), "part": pa.array([key[0].as_py()], pa.int64()),
                 "state": pa.array([state.tobytes()])}
            )

        return train

    weights = start
    for number in range(rules.rounds):
        train = trainer_of(spark.sparkContext.broadcast((classes.value.of, weights)), rules.rate / (1 + number))
        own = dealt.filter(F.col("round") == number).select("part", "key", "ids")
        states = own.groupBy("part").applyInArrow(train, "all int, part long, state binary")
        total = _added(stage(states, f"lm-round-{number}"), "all", "state").get(0)
        if total is not None:
            weights = unpack(total[:-1] / total[-1], start)
    return weights


def score_texts(
    docs: DataFrame,
    held_out,
    vocabulary: tuple[str, dict],
    doc_id: str = "doc_id",
    text: str = "text",
    rules: LmRules = LmRules(),
) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score), one for each
    row of ``docs``; scores are log10 of the text's probability.

    ``vocabulary`` is the result of ``read_ranks``. Rows for which the boolean column
    expression ``held_out`` is true teach nothing. Tokens are words, A-Z in lower case,
    and one end for each text; a null text is an empty one and has its end alone.
    Repeated rows get the same scores each. Without any training row all counts are
    zero and the model keeps its first weights.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    coder = sc.broadcast(vocabulary)
    texts = docs.select(
        F.col(doc_id).alias("doc_id"), text_or_empty(text).cast("binary").alias("_text"), held_out.alias("_out")
    )
    size = 1 + max(vocabulary[1].values())
    key = F.xxhash64("doc_id", "_text").alias("key")
    train = texts.filter("not _out").select(key, "_text")
    read = stage(_read(train, coder, size), "lm-read")
    words = read.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c"))
    words = stage(words, "lm-words")

    table = np.zeros((-(-(size + 1) // ROWS) * ROWS, TRAITS + 1))
    for chunk, rows in _added(read.filter("chunk is not null"), "chunk", "table").items():
        rows = rows.reshape(-1, TRAITS + 1)  # as many rows as the vocabulary has ids
        table[chunk * ROWS : chunk * ROWS + len(rows)] = rows
    ends = int(table[size, 0])
    shared = sc.broadcast(Classes(table[:size], ends, rules))
    start = start_weights(shared.value.log_prior)
    coded = read.filter("key is not null").select("key", "ids")
    model = sc.broadcast(_trained(coded, shared, start, int(table[: size, 0].sum()), id_kind(size), rules))

    sums = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total = (sums["n"] or 0) + ends
    distinct = sums["v"] + (ends > 0)
    top = words.filter(F.octet_length("word") <= COMMON_BYTES).orderBy(F.col("c").desc(), "word")
    common = sc.broadcast({bytes(r["word"]): r["c"] for r in top.limit(COMMON_WORDS).collect()})
    log_total = float(np.log10(total + 0.5 * (distinct + 1)))
    log_share, log_rest = float(np.log(rules.word_share)), float(np.log1p(-rules.word_share))

    def key_of(number, text) -> int:
        return xxhash.xxh3_64_intdigest(text, seed=hash_seed(number)) - (1 << 63)

    def hash_seed(number) -> int:
        return 0 if number is None else xxhash.xxh3_64_intdigest(str(number))

    ln10 = float(np.log(10))

    def score(batches):
        subwords, classes, tables, known = _subwords(coder), shared.value, Tables(model.value), common.value
        of, share = np.append(classes.of, END), np.append(classes.log_share, 0.0)
        counts = np.zeros(0, dtype=np.float64)  # by place; -1 for words that are not common
        for batch in batches:
            for piece in _pieces(batch):
                if subwords.full():
                    subwords.clear()
                    counts = counts[:0]
                texts = piece.column(1).to_pylist()
                places, n_words = subwords(texts)
                fresh = map(known.get, subwords.words(len(counts)), repeat(-1))
                counts = np.concatenate([counts, np.array(list(fresh), dtype=np.float64)])
                counts[0] = ends
                line, sizes = subwords.ids(places)
                begins = _begins(n_words)
                lengths = np.add.reduceat(sizes, begins)
                # a block of padding before each text, and after it up to a whole block
                blocks = 1 - -lengths // CONTEXT
                first = _begins(blocks)
                at = np.repeat((first + 1) * CONTEXT - _begins(lengths), lengths)
                at += np.arange(len(line))
                padded = np.full(int(blocks.sum()) * CONTEXT, PAD, dtype=np.int64)
                padded[at] = of[line]
                padded = padded.reshape(-1, CONTEXT)
                logs = np.zeros(padded.shape)
                scored = np.ones(len(padded), dtype=bool)
                scored[first] = False
                scored = np.flatnonzero(scored)
                for low in range(0, len(scored), BATCH):
                    some = scored[low : low + BATCH]
                    logs[some] = log_probs(tables, np.hstack([padded[some - 1], padded[some]]))
                own = logs.ravel()[at] + share[line]
                by_word = np.add.reduceat(own, _begins(sizes))
                count = counts[places]
                often = np.log(np.maximum(counts, 0) + 0.5)
                mixed = np.logaddexp(by_word + log_rest, often[places] - log_total * ln10 + log_share)
                unmet = count < 0
                mixed[unmet] = 0.0  # mixed below, when they have met their counts
                hot = np.where(unmet, 0.0, (often / ln10)[places])
                n_known = np.add.reduceat((count > 0).astype(np.int64), begins)

                # words that are not common: one entry for each text and word
                where = np.flatnonzero(unmet)
                text_of = np.repeat(np.arange(len(texts)), n_words)[where]
                met_as = text_of * len(counts) + places[where]
                order = np.argsort(met_as, kind="stable")
                new = np.flatnonzero(np.diff(met_as[order], prepend=-1))
                asked_by = text_of[order][new]
                offsets = np.searchsorted(asked_by, np.arange(len(texts) + 1)).astype(np.int32)
                words = subwords.words()
                asked = pa.array([words[i] for i in places[where][order][new].tolist()], pa.binary())
                inner = pa.ListArray.from_arrays(
                    pa.array(np.append(new, len(where)).astype(np.int32)), pa.array(by_word[where][order])
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array([*map(key_of, piece.column(0).to_pylist(), texts)], pa.int64()),
                        pa.array(n_words),
                        pa.array(n_known),
                        pa.array(np.add.reduceat(hot, begins)),
                        pa.array(np.add.reduceat(mixed, begins) / ln10),
                        pa.ListArray.from_arrays(pa.array(offsets), asked),
                        pa.ListArray.from_arrays(pa.array(offsets), inner),
                    ],
                    names=["doc_id", "key", "n_tokens", "hot_known", "hot", "score", "word", "logs"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    plain = texts.select("doc_id", "_text")
    scored = stage(
        plain.mapInArrow(
            score,
            f"doc_id {kind}, key long, n_tokens long, hot_known long, hot double, score double, "
            "word array<binary>, logs array<array<double>>",
        ),
        "lm-scores",
    )
    asked = scored.select("key", F.explode(F.arrays_zip("word", "logs")).alias("a")).select("key", "a.word", "a.logs")
    met = asked.join(words, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    own = F.log(F.col("c") + 0.5) - log_total * float(np.log(10)) + log_share

    def mixed(log: Column) -> Column:
        """Log of the sum of both shares."""
        model_log = log + log_rest
        return F.greatest(model_log, own) + F.log1p(F.exp(-F.abs(model_log - own)))

    k = F.size("logs").cast("long")
    cold = met.groupBy("key").agg(
        F.sum(k * F.log10(F.col("c") + 0.5)).alias("cold"),
        F.sum(F.when(F.col("c") > 0, k).otherwise(0)).alias("cold_known"),
        F.sum(F.aggregate("logs", F.lit(0.0), lambda sum_, log: sum_ + mixed(log))).alias("cold_score"),
    )
    # rows that are repeated asked once each: their sums are divided by their number
    copies = scored.groupBy("key").agg(F.count("*").alias("copies"))
    cold = cold.join(copies, "key").select(
        "key",
        (F.col("cold") / F.col("copies")).alias("cold"),
        (F.col("cold_known") / F.col("copies")).cast("long").alias("cold_known"),
        (F.col("cold_score") / F.col("copies") / float(np.log(10))).alias("cold_score"),
    )
    zero = lambda name, z: F.coalesce(name, F.lit(z))
    return scored.join(cold, "key", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("hot_known") + zero("cold_known", 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot") + zero("cold", 0.0) - F.col("n_tokens") * log_total).alias("base_score"),
        (F.col("score") + zero("cold_score", 0.0)).alias("score"),
    )
