import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelode.llm import phrases as P

from .brute import lower_az


def pieces(text):
    for piece in re.split("[.,;:!?\n-\r]", lower_az(text or "")):
        found = re.findall("[^ \t]+", piece)
        if found:
            yield found


def counts(rows, most):
    found, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for m in range(1, most + 1):
                for i in range(len(words) - m + 1):
                    found[lang, tuple(words[i : i + m])] += 1
    return found, totals


def brute(rows, rules):
    found, totals = counts(rows, rules.max_words)
    scored = {}
    for (lang, w), a in found.items():
        if len(w) > 1 and a >= rules.min_count:
            cuts = []
            for k in range(1, len(w)):
                l, r = found[lang, w[:k]], found[lang, w[k:]]
                cuts.append((1000000 * a * a // (l * r), k, l, r))
            scored[lang, w] = (a, *min(cuts))
    out = {}
    for (lang, w), (a, score, _, l, r) in scored.items():
        covered = any(
            100 * b >= rules.covered_percent * a
            and other_lang == lang
            and any(longer[i : i + len(w)] == w for i in range(len(longer) - len(w) + 1))
            for (other_lang, longer), (b, *_) in scored.items()
            if len(longer) > len(w)
        )
        if not covered:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return {
        (lang, rank, p.decode(), -a, l, r, totals[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[: rules.per_lang], 1)
    }


def sample(seed=0):
    r = random.Random(seed)
    vocabulary = ["a", "b", "cc", "Dd", "e", "f'", "é", "ß", "中", "x-y"]
    rows = []
    for i in range(120):
        words = r.choices(vocabulary, weights=[30, 20, 9, 9, 5, 5, 3, 3, 2, 1], k=r.randint(0, 60))
        text = "".join(w + r.choice([" "] * 12 + ["  ", "\t", ". ", "\n", "\r", "\x0b", ","]) for w in words)
        rows.append((r.choice(["en", "en", "de", None]), text))
    rows += [("en", "the same long passage stands here again and again without an end")] * 40
    rows += [("en", "go " * 500), ("fr", None), ("fr", ""), (None, ".;:"), ("de", "a b")]
    return rows


@pytest.mark.parametrize(
    "rules",
    [
        P.PhraseRules(),
        P.PhraseRules(spacing=1, batch_bytes=50),
        P.PhraseRules(spacing=2, per_lang=7, batch_bytes=900, filter_bits=64),
        P.PhraseRules(4, 3, covered_percent=80, spacing=3, batch_bytes=700, filter_bits=1000),
        P.PhraseRules(2, 5, spacing=4, filter_bits=1 << 10),
    ],
    ids=["contract", "all cut", "full field", "four words", "two words"],
)
def test_phrases_equal_plain_counts(spark, rules):
    rows = sample()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = {tuple(r) for r in P.mine_phrases(docs, rules=rules).collect()}
    assert got == brute(rows, rules)


@pytest.mark.parametrize("spacing", [1, 2, 5, 1000])
@pytest.mark.parametrize("width", [2, 3, 4])
def test_chunks_count_every_phrase_once(width, spacing):
    r = random.Random(spacing)
    texts = [r.choices("abcde", k=r.randint(1, 40)) for _ in range(60)] + [["z"] * 50]
    rules = P.PhraseRules(max_words=width, spacing=spacing)
    column = pa.array([" ".join(t).encode() for t in texts], pa.binary())
    words, row, pieces = P._words(column)
    assert row.tolist() == pieces.tolist() == [i for i, t in enumerate(texts) for _ in t]
    found = P._chunks(words, pieces, np.zeros(len(words), dtype=np.int64), rules).to_pylist()
    counted = Counter()
    for row in found:
        chunk = row["chunk"].decode().split(" ")
        own = len(chunk) - (width - 1 if row["closed"] else 0)
        for m in range(1, width + 1):
            for i in range(own):
                if i + m <= len(chunk):
                    counted[tuple(chunk[i : i + m])] += row["count_all"]
    wanted, _ = counts([("x", " ".join(t)) for t in texts], width)
    assert counted == Counter({w: n for (_, w), n in wanted.items()})


def test_words_of_sliced_columns():
    texts = ["", "a  b.C d", "\t", "é\nx", "", "No end", "."]
    words, row, pieces = P._words(pa.array([t.encode() for t in texts], pa.binary())[1:], P._READ)
    assert words.to_pylist() == [w.encode() for w in ["a", "b", "c", "d", "é", "x", "no", "end"]]
    assert row.tolist() == [0, 0, 0, 0, 2, 2, 4, 4]
    assert np.diff(pieces).astype(bool).tolist() == [False, True, False, True, True, True, False]
    assert len(P._words(pa.array([b"", b" "], pa.binary()))[0]) == 0


def test_keys_are_numbered_anew_before_they_overflow():
    r = np.random.default_rng(1)
    codes = [r.integers(0, 3, 500) for _ in range(5)]
    lang, weights = r.integers(0, 2, 500), r.integers(1, 9, 500)
    first, totals = P._summed(lang, codes, 2**30, weights)
    wanted = Counter()
    for i in range(500):
        wanted[lang[i], *[c[i] for c in codes]] += weights[i]
    assert {(lang[i], *[c[i] for c in codes]): n for i, n in zip(first, totals)} == wanted


def test_large_counts_stay_exact(spark):
    big = 4_000_000_007
    rows = [("en", 1, "a", 3 * big), ("en", 1, "b", big + 1), ("en", 2, "a b", big), ("en", 2, "b a", 3)]
    frequent = spark.createDataFrame(rows, "lang string, words int, phrase string, f long")
    got = {r.phrase: r.score for r in P.score_phrases(frequent).collect()}
    assert got["a b"] == 1_000_000 * big * big // (3 * big * (big + 1))


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([("x y", "en", 1, 2, "q")] * 12, "body string, tongue string, n int, f int, phrase string")
    got = P.mine_phrases(docs, "body", "tongue").collect()
    assert [tuple(r) for r in got] == [("en", 1, "x y", 12, 12, 12, 24, 1000000)]
    empty = P.mine_phrases(docs.limit(0), "body", "tongue")
    assert empty.count() == 0 and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert P.mine_phrases(docs.withColumn("body", F.lit(None).cast("string")), "body", "tongue").count() == 0
