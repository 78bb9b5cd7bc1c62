"""Toxicity by a lexicon trie, misspellings included, and the words around each hit.

Training counts, over all labelled rows of the training folds, in how many toxic and
other documents each beginning of a word stands. Beginnings that are telling become
the lexicon: whole words, and stems that stand for all words that begin with them. It
is kept as a trie. A word of a text is looked up in the trie while a Levenshtein
automaton of the word runs along, so words that begin with a term but for one edit are
found too. What such a form weighs is learned: one that stands in other documents as
often as in toxic ones is no misspelling.

Every hit is weighed by its context window: the log-odds of the words beside hits in
toxic and in other documents tell abuse from quotation. A logistic model of hit
figures gives the score. Counting and scoring run over all rows; what the driver holds
is the lexicon, the context words and the figures of a bounded sample of rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.joins import join_small
from ..session import stage
from .common import free_name, sha256, text_or_empty

_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = frozenset("\"'“”„«»‘’‹›")
KEPT_WORDS = 300_000
FEATURES = 7


@dataclass(frozen=True)
class ToxicityRules:
    """Limits; the lexicon, the context words and the sample are bounded."""

    min_stem: int = 3
    min_documents: int = 5  # toxic documents that a term must stand in
    min_odds: float = 2.0  # log-odds of a term
    lexicon: int = 5_000  # best terms kept, none the beginning of another
    fuzzy_length: int = 3  # shorter terms match only as they are; no term is shorter
    window: int = 4  # words on either side
    context_words: int = 5_000
    sample: int = 40_000  # labelled rows that the last model is fitted on
    threshold: float = 0.3


class Trie:
    """Lexicon of terms with weights; stems also match longer words."""

    def __init__(self, terms: dict[str, float], fuzzy_length: int, learned: dict[str, float] | None = None):
        self.root: dict = {}
        self.fuzzy_length = fuzzy_length
        self.learned = learned or {}  # weights of misspelled forms
        for term, weight in terms.items():
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = (weight, len(term))

    def exact(self, word: str) -> tuple[float, int]:
        """Weight and length of the longest term that the word begins with."""
        node, best = self.root, (0.0, 0)
        for letter in word:
            node = node.get(letter)
            if node is None:
                break
            best = node.get("", best)
        return best

    def fuzzy(self, word: str) -> float:
        """Best weight of a term that is the whole word with one letter wrong."""
        return self.forms(word).get(word, 0.0)

    def misspelled(self, word: str) -> float:
        """Best weight of a form of the word, a learned one where there is one."""
        return max((self.learned.get(form, weight) for form, weight in self.forms(word).items()), default=0.0)

    def forms(self, word: str) -> dict[str, float]:
        """Beginnings of the word within one edit of a term, with the best such term's weight.

        The automaton has read some letters without an error and follows the trie; at
        every place it may spend its one error on a letter too many, too few or changed,
        and must then agree up to a term's end. What follows there is a longer form.
        """
        found: dict[str, float] = {}
        node, at, size = self.root, 0, len(word)
        while node is not None:
            here = word[at] if at < size else None
            after = word[at + 1] if at + 1 < size else None
            # an error leads on only where a term ends or the next letter goes on
            if after in node or "" in node:
                self._ends(node, word, at + 1, found)
            for letter, below in node.items():
                if letter:
                    ends = "" in below
                    if ends or here in below:
                        self._ends(below, word, at, found)
                    if ends or after in below:
                        self._ends(below, word, at + 1, found)
            node = node.get(here)
            at += 1
        return found

    def _ends(self, node: dict, word: str, at: int, found: dict[str, float]) -> None:
        """Add the terms that end on the way, read from ``at`` on."""
        while node is not None and at <= len(word):
            weight, length = node.get("", (0.0, 0))
            if length and length >= self.fuzzy_length:
                found[word[:at]] = max(weight, found.get(word[:at], 0.0))
            node = node.get(word[at]) if at < len(word) else None
            at += 1


class Scorer:
    """Hit figures of texts; looked-up words are kept between texts."""

    def __init__(self, lexicon: dict, learned: dict, context: dict, rules: ToxicityRules):
        self.trie = Trie(lexicon, rules.fuzzy_length, learned)
        self.context, self.rules, self.known = context, rules, {}

    def lookup(self, word: str) -> tuple[float, int]:
        """Weight of a word, and 1 for a lexicon term, 2 for a misspelled one."""
        found = self.known.get(word)
        if found is None:
            weight, length = self.trie.exact(word)
            kind = 1 if length else 0
            if not length and (near := self.trie.misspelled(word)):
                weight, kind = near, 2
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            found = self.known[word] = (weight, kind)
        return found

    def hits(self, text: str) -> list[tuple[float, int, bool, list[str]]]:
        """Hits as (weight, kind, quoted, words of the window)."""
        words = _WORD.findall(text.lower())
        if not any(self.lookup(w)[1] for w in set(words)):
            return []
        found = []
        low, w = text.lower(), self.rules.window
        spans = [m.span() for m in _WORD.finditer(low)]
        for k, word in enumerate(words):
            weight, kind = self.lookup(word)
            if kind:
                start, end = spans[k]
                quoted = low[max(0, start - 1) : start] in _QUOTES and low[end : end + 1] in _QUOTES
                around = words[max(0, k - w) : k] + words[k + 1 : k + 1 + w]
                found.append((weight, kind, quoted and start > 0, around))
        return found

    def figures(self, text: str) -> list[float]:
        """Features of one text: weights, context, quotation, density."""
        found = self.hits(text)
        if not found:
            return [0.0] * FEATURES
        total = best = context = quoted = fuzzy = 0.0
        for weight, kind, in_quotes, around in found:
            own = 0.5 * weight if in_quotes else weight
            total += own
            best = max(best, own)
            context += sum(self.context.get(x, 0.0) for x in around) / max(1, len(around))
            quoted += in_quotes
            fuzzy += kind == 2
        n = len(found)
        words = 1 + len(text) / 6
        return [
            1.0, min(best, 12) / 4, math.log1p(total) / 2, math.log1p(n),
            context / n, (quoted + fuzzy) / n, math.log1p(100 * total / words) / 3,
        ]


def _training(docs, labels, doc_id, text, fold):
    """Rows (text, toxic) of labelled documents in the training folds.

    Labels are first gathered by document: the larger of several counts.
    """
    known = labels.filter("toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    rows = docs.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("_text"), fold.alias("_out"))
    rows = rows.filter(~F.col("_out")).select("_id", "_text")
    return join_small(rows, known, ["_id"]).select("_id", "_text", "toxic")


def _different(rows: DataFrame) -> DataFrame:
    """``rows`` with each text once for each label, and its digest ``_mark``.

    Counted once each, copies of one text cannot make all its words telling; texts that
    differ anywhere all count.
    """
    return rows.withColumn("_mark", sha256("_text")).dropDuplicates(["_mark", "toxic"])


def _lexicon(rows: DataFrame, sizes: dict, rules: ToxicityRules) -> dict[str, float]:
    """The most telling words and stems with their log-odds.

    A stem counts as often as the words that begin with it. Of terms that begin with
    one another the best stays, the longer one if they are equal.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(r"\p{L}+"), F.lit(0)))
    toxic, other = (F.sum((F.col("toxic") == k).cast("long")) for k in (1, 0))
    counted = (
        rows.select("toxic", F.explode(words).alias("w"))
        .groupBy("w").agg(toxic.alias("p"), other.alias("q"))
        .select("p", "q", F.explode(F.transform(
            F.sequence(F.lit(rules.min_stem), F.greatest(F.length("w"), F.lit(rules.min_stem))),
            lambda k: F.substring("w", F.lit(1), k),
        )).alias("term"))
        .groupBy("term").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    )
    odds = F.log((F.col("p") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("q") + 0.5) / (sizes[0] + 1.0))
    best = (
        counted.filter(F.col("p") >= rules.min_documents).withColumn("odds", odds)
        .filter((F.col("odds") >= rules.min_odds) & (F.length("term") >= rules.min_stem))
        .withColumn("worth", F.round(F.col("odds") * F.sqrt("p"), 6))
        .select("term", "odds", "worth")
    )
    chosen: dict[str, float] = {}
    inside: set[str] = set()  # beginnings of chosen terms
    for r in stage(best, "toxic-terms").orderBy(F.col("worth").desc(), F.length("term").desc(), "term").toLocalIterator():
        if len(chosen) >= rules.lexicon:
            break
        term = r["term"]
        above = any(term[:k] in chosen for k in range(rules.min_stem, len(term)))
        if not above and term not in inside:
            chosen[term] = float(r["odds"])
            inside.update(term[:k] for k in range(1, len(term)))
    return chosen


def _misspelled(rows: DataFrame, lexicon: dict, sizes: dict, rules: ToxicityRules) -> dict[str, float]:
    """Weights of the misspelled forms seen in training; 0 for what is no telling form.

    A form starts at its term's log-odds, worth one document, and its own documents move
    it: a form that stands in other documents, too, sinks below the limit for terms. The
    lexicon's neighbourhood bounds the forms.
    """
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        trie, known = Trie(shared.value, rules.fuzzy_length), {}

        def forms(word: str) -> dict[str, float]:
            found = known.get(word)
            if found is None:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                found = known[word] = {} if trie.exact(word)[1] else trie.forms(word)
            return found

        for batch in batches:
            counts: dict = {}
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                met: dict[str, float] = {}
                for word in set(_WORD.findall(text.lower())):
                    met.update(forms(word))
                for form, weight in met.items():
                    n = counts.setdefault(form, [0, 0, weight])
                    n[toxic] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.string()),
                    pa.array([n[1] for n in counts.values()], pa.int64()),
                    pa.array([n[0] for n in counts.values()], pa.int64()),
                    pa.array([n[2] for n in counts.values()], pa.float64()),
                ],
                names=["form", "p", "q", "weight"],
            )

    counted = rows.select("_text", "toxic").mapInArrow(run, "form string, p long, q long, weight double")
    counted = counted.groupBy("form").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.max("weight").alias("weight"))
    learned = {}
    one = 1 / (sizes[0] + sizes[1])
    for r in counted.collect():
        odds = math.log((r["p"] / sizes[1] + one * math.exp(r["weight"])) / (r["q"] / sizes[0] + one))
        learned[r["form"]] = min(odds, r["weight"]) if odds >= rules.min_odds else 0.0
    return learned


def _context(rows: DataFrame, lexicon: dict, learned: dict, rules: ToxicityRules) -> dict[str, float]:
    """Log-odds of words beside hits, toxic documents against others."""
    shared = rows.sparkSession.sparkContext.broadcast((lexicon, learned))

    def run(batches):
        scorer = Scorer(*shared.value, {}, rules)
        for batch in batches:
            counts: dict = {}
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word in {x for hit in scorer.hits(text) for x in hit[3]}:
                    counts[word, toxic] = counts.get((word, toxic), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in counts], pa.string()),
                    pa.array([k[1] for k in counts], pa.int32()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                names=["word", "toxic", "n"],
            )

    counted = rows.select("_text", "toxic").mapInArrow(run, "word string, toxic int, n long")
    counted = counted.groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"),
    )
    most = counted.orderBy((F.col("p") + F.col("q")).desc(), "word").limit(rules.context_words)
    return {r["word"]: math.log((r["p"] + 1) / (r["q"] + 1)) for r in most.collect()}


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps; last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 1e-2
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held_out,
    doc_id: str = "doc_id",
    text: str = "text",
    rules: ToxicityRules = ToxicityRules(),
) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (replaced if there).

    ``labels`` has doc_id and toxic; rows for which the boolean column expression
    ``held_out`` is true teach nothing. Only texts enter a score. Null and empty texts
    have no hits and get the score of texts without hits. Repeated rows get the same
    score. Without toxic or without other labels in training all scores are the share
    of toxic labels (0 without labels).
    """
    sc = docs.sparkSession.sparkContext
    rows = stage(_different(_training(docs, labels, doc_id, text, held_out)), "toxic-training")
    sizes = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if sizes[0] and sizes[1]:
        lexicon = _lexicon(rows, sizes, rules)
        learned = _misspelled(rows, lexicon, sizes, rules)
        context = _context(rows, lexicon, learned, rules)
        model = sc.broadcast((lexicon, learned, context))
        # the places of the sample are told apart first: its texts stay spread over tasks
        places = rows.select("_id", "_mark", "toxic").orderBy(F.xxhash64("_id"), "_id", "_mark", "toxic")
        chosen = places.limit(rules.sample).select("_mark", "toxic")
        sample = rows.join(F.broadcast(chosen), ["_mark", "toxic"]).select("_text", "toxic")

        def features(batches):
            scorer = Scorer(*model.value, rules)
            for batch in batches:
                x = [scorer.figures(t) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"]
                )

        found = sample.mapInArrow(features, "x array<double>, toxic int").collect()
        weights = _fit(np.array([r["x"] for r in found]), np.array([r["toxic"] for r in found], float))
    else:
        model = sc.broadcast(({}, {}, {}))
        share = sizes[1] / max(1, sizes[0] + sizes[1])
        bias = 30.0 if share == 1 else -30.0
        weights = np.array([0.0] * FEATURES + [bias])

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType())])

    def run(batches):
        scorer = Scorer(*model.value, rules)
        for batch in batches:
            x = [scorer.figures(t) for t in batch.columns[-1].to_pylist()]
            z = np.array(x).reshape(-1, FEATURES) @ weights[:-1] + weights[-1]
            scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*kept, "score"]
            )

    carried = free_name("_text", kept)
    scored = docs.select(*kept, text_or_empty(text).alias(carried)).mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= rules.threshold).cast("int"))
