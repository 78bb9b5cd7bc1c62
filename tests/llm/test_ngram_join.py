import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelode.llm import ngram_join as N
from pagelode.llm.ngram_join import components, ngram_components, one_of_each, shared_counts

from .brute import components as brute_components, shingles

SCHEMA = "doc_id long, text string, sig string, token int, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def corpus(seed):
    """Copies with few and many changes, a shared passage, short and empty texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 3)))
    passage = " ".join(word() for _ in range(40))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(r.randint(20, 90))]
        for _ in range(12):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy) + (" " + passage if r.random() < 0.3 else ""))
    texts += [passage] * 3 + [passage + " x"] + ["", None, " \n", "a b", "A b", "a b c d e f g h", "a b c d e f g h i"]
    return list(enumerate(texts))


def short_sets(percent):
    """Sets of few shingles around the bound, of words of their own."""
    texts = []
    for n in range(1, 9):
        words = [f"p{n}w{i}" for i in range(n + 4)]
        texts += [" ".join(words), " ".join(words + ["x"]), " ".join(words[1:]), " ".join(words + ["y", "z"])]
    return [(1000 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent, full", [(80, 1000), (60, 1000), (75, 3), (90, 1000)])
def test_components_equal_all_pairs(spark, monkeypatch, percent, full):
    monkeypatch.setattr(N, "FULL_BUCKET", full)  # shared by many: not looked up
    rows = corpus(percent) + short_sets(percent)
    found = ngram_components(frame(spark, rows), percent=percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    wanted = brute_components(dict(rows), percent)
    assert got == {i: (len(shingles(t)), wanted[i]) for i, t in rows}


def test_one_of_each_keeps_a_row_of_every_component(spark):
    rows = corpus(3)
    kept = one_of_each(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "sig", "token", "n"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(dict(rows)).values()))


def test_nulls_repeated_rows_and_empty_tables(spark):
    assert ngram_components(frame(spark, [])).count() == 0
    text = "one two three four five six"
    rows = [(None, text), (3, text), (3, text), (None, None), (7, "other words here")]
    got = sorted(map(str, ngram_components(frame(spark, rows)).collect()))
    assert got == sorted(
        f"Row(doc_id={i}, n_shingles={n}, component_id={c})"
        for i, n, c in [(None, 2, 3), (3, 2, 3), (3, 2, 3), (None, 0, None), (7, 1, 7)]
    )
    assert sorted(str(r.doc_id) for r in one_of_each(frame(spark, rows)).collect()) == ["3", "7", "None"]


def test_one_of_each_tells_equal_ids_and_null_ids_apart(spark):
    one, two = "one two three four five six", "other words stand in this text"
    rows = [(7, one), (7, two), (7, two), (None, one), (None, "no id but words of its own"),
            (None, "no id but words of its own"), (9, two), (7, ""), (7, ""), (None, None)]
    docs = frame(spark, rows).withColumn("_number", F.lit("a")).withColumn("_key", F.lit(1))
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted(
        [("7", one), ("7", two), ("None", "no id but words of its own"), ("7", ""), ("7", ""), ("None", "None")]
    )


def test_percent_has_bounds(spark):
    with pytest.raises(ValueError):
        ngram_components(frame(spark, [(1, "a b")]), percent=50)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "x long, y long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


@pytest.mark.parametrize("cut", [1, 2, 3, 50])
def test_shared_counts_over_batches(cut):
    r = random.Random(cut)
    rows = sorted((r.randint(0, 9), r.randint(0, 4)) for _ in range(60))
    done = [(r.randint(0, 9), r.randint(0, 4), r.randint(1, 5)) for _ in range(9)]
    mixed = sorted([(t, c, -1) for t, c in rows] + done)
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in part]), pa.array([x[1] for x in part]),
             pa.array([None if x[2] < 0 else x[2] for x in part], pa.int64())],
            names=["token", "class", "m"],
        )
        for part in (mixed[i : i + cut] for i in range(0, len(mixed), cut))
    ]
    got = {}
    for _, c, m in done:
        got[c] = got.get(c, 0) - m
    for batch in shared_counts(iter(batches)):
        for c, m in zip(*(x.to_pylist() for x in batch.columns)):
            got[c] = got.get(c, 0) + m
    by_token = {}
    for t, c in rows:
        by_token.setdefault(t, set()).add(c)
    wanted = {}
    for found in by_token.values():
        for c in found if len(found) > 1 else ():
            wanted[c] = wanted.get(c, 0) + 1
    assert {c: m for c, m in got.items() if m} == wanted
