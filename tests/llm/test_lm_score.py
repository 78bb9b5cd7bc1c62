import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagelode.llm import lm_model as M, lm_score
from pagelode.llm.common import fold

from .brute import WORD, lower_az


@pytest.fixture(scope="module")
def vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return lm_score.read_ranks(path, public_tokenizers.PATTERN)


def wanted(rows, held):
    words = lambda t: [*WORD.findall(lower_az(t or "")), None]
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))
    return sorted(
        (str(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(base(t), 6)) for i, t in rows
    )


def check(df, held, rows, vocabulary, plain):
    got = lm_score.score_texts(df, held, vocabulary).collect()
    found = sorted(
        (str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got
    )
    assert found == wanted(rows, plain)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    return got


@pytest.mark.parametrize("common", [3, 50_000])
def test_base_scores_equal_plain_counts(spark, vocabulary, monkeypatch, common):
    monkeypatch.setattr(lm_score, "COMMON_WORDS", common)
    rows = [(1, "The cat saw the dog"), (1, "The cat saw the dog"), (2, None), (3, ""), (None, "É é the\x1cnew"), (7, "zebra " * 70)]
    docs = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, word string")
    held = F.coalesce(F.col("doc_id") == 7, F.lit(False))
    got = check(docs, held, rows, vocabulary, lambda i: i == 7)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    nothing = lm_score.score_texts(docs, F.lit(True), vocabulary).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in nothing)
    assert lm_score.score_texts(docs.limit(0), held, vocabulary).count() == 0


def test_training_makes_texts_likelier(spark, tiny_dir, vocabulary):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet").select("doc_id", "text")
    held = fold("doc_id", 5) == 1
    total = lambda rules, out: sum(
        r.score for r in lm_score.score_texts(docs, out, vocabulary, rules=rules).withColumn("h", held).filter("h").collect()
    )
    alone = lm_score.LmRules(word_share=1e-9)
    assert total(alone, held) > 0.9 * total(alone, F.lit(True))


def test_rare_words_enter_the_score_with_their_counts(spark, vocabulary, monkeypatch):
    rows = [(i, f"the zebra{i % 3} met a {'long' * 20} word twice{i} twice{i}") for i in range(9)] + [(1, None), (20, "unseen zebra1")]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    total = {}
    for common, size in ((50_000, 1000), (50_000, 48), (2, 48), (0, 48)):
        monkeypatch.setattr(lm_score, "COMMON_WORDS", common)
        monkeypatch.setattr(lm_score, "COMMON_BYTES", size)
        got = lm_score.score_texts(docs, F.col("doc_id") == 20, vocabulary).collect()
        total[common, size] = sorted((r.doc_id, r.n_known, round(r.score, 6)) for r in got)
    assert len({str(x) for x in total.values()}) == 1


def test_every_window_trains(spark, vocabulary):
    rules = lm_score.LmRules(rounds=1)

    def scores(third):
        texts = ["one two three"] * 2 + [third] + ["one two three"] * 5 + ["blue red", "red blue"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        found = lm_score.score_texts(docs, F.col("doc_id") >= 8, vocabulary, rules=rules)
        return sorted((r.doc_id, r.score) for r in found.collect())[8:]

    assert scores("red blue green") != scores("green blue red")  # equal counts


def test_scores_do_not_depend_on_the_split(spark, tiny_dir, vocabulary):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet").select("doc_id", "text")
    rules = lm_score.LmRules(part_ids=40_000)
    found = []
    for parts in (1, 7):
        scored = lm_score.score_texts(docs.repartition(parts), fold("doc_id", 5) == 1, vocabulary, rules=rules)
        found.append(sorted((r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in scored.collect()))
    assert found[0] == found[1]


def test_scores_beat_the_base_in_both_folds(spark, tiny_dir, vocabulary):
    larger = tiny_dir.replace("sf0.001", "sf0.01")  # 1,000 documents
    docs = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text")
    held = fold("doc_id", 5) == 1
    scored = lm_score.score_texts(docs, held, vocabulary).groupBy(held.alias("h"))
    sums = {r.h: r for r in scored.agg(F.sum("score").alias("model"), F.sum("base_score").alias("base")).collect()}
    assert sums[True].model > sums[True].base and sums[False].model > sums[False].base


def test_a_first_token_does_not_know_what_follows():
    """Nor if training has driven the weights apart."""
    r = np.random.default_rng(3)
    w = M.start_weights(np.log(np.full(M.CLASSES, 1 / M.CLASSES)))
    w = {name: r.normal(size=x.shape).astype(np.float32) for name, x in w.items()}
    texts = [r.integers(1, M.CLASSES, size=n) for n in (1, 5, 16, 40)]
    for text in texts:
        follows = np.append(text[:1], r.integers(1, M.CLASSES, size=9))
        a, b = (M.log_probs(w, M.windows(z))[0, 0] for z in (text, follows))
        assert math.isclose(a, b, rel_tol=1e-5)


def test_scores_do_not_depend_on_what_is_held(spark, tiny_dir, vocabulary, monkeypatch):
    """Texts taken one by one, and words forgotten at once, give the same scores."""
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet").select("doc_id", "text").limit(60)
    found = []
    for held, kept in ((1 << 20, 300_000), (1, 20)):
        monkeypatch.setattr(lm_score, "HELD_BYTES", held)
        monkeypatch.setattr(lm_score, "KEPT_WORDS", kept)
        scored = lm_score.score_texts(docs, fold("doc_id", 5) == 1, vocabulary)
        found.append(sorted((r.doc_id, r.n_tokens, r.n_known, round(r.score, 5)) for r in scored.collect()))
    assert found[0] == found[1]


def test_classes_follow_what_stands_beside(spark, vocabulary):
    """Ids of two languages that never meet fall into different classes."""
    r = np.random.default_rng(0)
    table = np.zeros((400, lm_score.TRAITS + 1))
    table[:, 0] = r.integers(5, 500, 400)
    side = np.where(np.arange(400) % 2, 1, -1)[:, None] * r.integers(1, 3, lm_score.TRAITS)
    table[:, 1:] = np.rint((side + r.normal(size=(400, lm_score.TRAITS)) * 0.2) * table[:, :1])
    of = lm_score.Classes(table, 10, lm_score.LmRules(own_classes=4)).of
    assert not set(of[::2]) & set(of[1::2])
