import random

import pytest
from pyspark.sql import functions as F

from pagelode.llm import pii
from pagelode.llm.pii import Disclosure, find_pii, sanitise

from .brute import pii_base

SCHEMA = "doc_id long, text string, pii int, key string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 7, "k") for i, t in enumerate(texts)], SCHEMA)


def spans(df):
    return {
        r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.pii] for r in df.collect()
    }


def test_patterns_equal_plain_search(spark):
    r = random.Random(5)
    parts = [
        "a@b.c", "x.y@z-1.org.", "@", ".", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "+1 (068) 555-2748",
        "4111111111111111", "4111-1111-1111-1111", "1234567890123456", "+", " ", " ", "é😀", "_", "a@b.c_d@e.f", "0012.7.0.1", "-", "9",
        "+49 30 1234567", "a@b@c.d", "\n",
    ]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(400)]
    texts += [None, "", "7" * 5000, "a" * 20000, "1." * 5000, "x@" + "a." * 5000 + "a", "4 " * 9000]
    got = spans(find_pii(frame(spark, texts)))
    for i, text in enumerate(texts):
        base = [s for s in got[i] if not s.startswith("term")]
        assert base == pii_base(text), repr(text)[:200]


def test_all_documents(spark, tiny_dir):
    docs = spark.read.parquet(f"{tiny_dir}/documents.parquet")
    got = spans(find_pii(docs))
    for row in docs.collect():
        assert [s for s in got[row.doc_id] if not s.startswith("term")] == pii_base(row.text)


@pytest.fixture(scope="module")
def named(spark):
    texts = [f"{w} wrote Zorblat Quen at zq@x.org about {w} today" for w in ("alpha", "beta", "gamma", "delta")]
    texts += [f"today {w} wrote about at some place {i}" for i, w in enumerate(["alpha", "beta", "gamma", "delta"] * 8)]
    return frame(spark, texts)


def test_terms_that_give_an_entity_away(named):
    got = {r.doc_id: [(s.kind, s.value) for s in r.pii] for r in find_pii(named).collect()}
    for i in range(4):
        assert got[i] == [("email", "zq@x.org"), ("term", "zorblat"), ("term", "quen")]
    assert all(not got[i] for i in range(4, len(got)))


def test_copies_are_one_context(spark):
    copies = frame(spark, ["call Zorblat at zq@x.org now"] * 5 + ["call at now"] * 20)
    assert all("term" not in str(s) for s in spans(find_pii(copies)).values())


def test_sanitised_text(named):
    clean = {r.doc_id: r.text for r in sanitise(find_pii(named)).collect()}
    assert clean[0] == "alpha wrote [TERM] [TERM] at [EMAIL] about alpha today"
    assert clean[9] == "today beta wrote about at some place 5"


def test_empty_tables_and_repeated_rows(spark):
    assert find_pii(frame(spark, [])).count() == 0
    rows = [(1, "a@b.cd", 7, "k")] * 3 + [(None, "a@b.cd", 7, "k"), (None, None, None, None)]
    got = find_pii(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "key", "pii"]
    assert [r.n for r in got.select(F.size("pii").alias("n")).orderBy("n").collect()] == [0, 1, 1, 1, 1]
    assert sorted(str(r.text) for r in sanitise(got).collect()) == ["None"] + ["[EMAIL]"] * 4


def test_no_python_on_the_main_path(named):
    plan = find_pii(named)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_threshold_is_a_parameter(named):
    strict = find_pii(named, limits=Disclosure(min_contexts=5))
    assert all("term" not in str(s) for s in spans(strict).values())


def test_single_mention_discloses_in_the_whole_document(spark):
    far = "some plain words of no weight " * 12
    texts = [f"Zorblat sold it. {far} Write to zq@x.org now. {far} So said ZORBLAT again."]
    texts += [f"some plain words of no weight sold it now, write to so said again {i}" for i in range(120)]
    found = find_pii(frame(spark, texts))
    (row,) = [r for r in found.collect() if r.doc_id == 0]
    assert [s.value for s in row.pii if s.kind == "term"] == ["zorblat", "zorblat"]
    clean = {r.doc_id: r.text for r in sanitise(found).collect()}
    assert "zorblat" not in clean[0].lower() and clean[0].count("[TERM]") == 2
    assert clean[5] == texts[5]


def test_all_entities_of_a_document_meet_its_terms_as_one_class(spark):
    texts = [" ".join(f"m{i}@x.org Name{chr(97 + i)}" for i in range(26))] + [f"plain text {i}" for i in range(120)]
    (row,) = [r for r in find_pii(frame(spark, texts)).collect() if r.doc_id == 0]
    assert sum(s.kind == "term" for s in row.pii) == sum(s.kind == "email" for s in row.pii) == 26


def test_only_words_of_copies_are_shuffled_to_be_distinct(spark, monkeypatch):
    texts = ["call Zorblat at zq@x.org", "some alpha words"] + ["some beta words"] * 3 + [None, ""]
    docs = frame(spark, texts).select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("unit"), F.coalesce("text", F.lit("")).alias("_text"))
    worded = lambda df: df.select("unit", F.explode(F.array_distinct(pii._terms("_text"))).alias("term"))
    wanted = sorted(map(tuple, worded(docs).distinct().collect()))
    units = pii._counted_units(docs)
    assert units.agg(F.count("*")).first()[0] == docs.select("unit").distinct().count()
    found = pii._unit_terms(docs, units, worded)
    assert sorted(map(tuple, found.collect())) == wanted
    plan = found._jdf.queryExecution().executedPlan().toString()
    alone = plan[plan.index("Union") : plan.index("LeftSemi")]
    assert "LeftAnti" in alone and alone.count("hashpartitioning(unit") == 1
    monkeypatch.setattr(pii, "SHARED_UNITS", 0)
    assert sorted(map(tuple, pii._unit_terms(docs, units, worded).collect())) == wanted


def test_texts_without_personal_data_stay_in_place(spark, monkeypatch):
    texts = ["call Zorblat at zq@x.org", "call Zorblat at zq@x.org", "some words", "some words", None, "", "ip 1.2.3.4"]
    docs = frame(spark, texts).unionByName(frame(spark, ["call Zorblat at zq@x.org", None]))
    found = find_pii(docs)
    wanted = sorted((r.doc_id, str(r.text), r.pii) for r in found.collect())
    assert len(wanted) == 9 and sum(bool(w[2]) for w in wanted) == 4
    assert "Exchange hashpartitioning(_pii_key" not in found._jdf.queryExecution().executedPlan().toString()
    for shared in (pii.SHARED_UNITS, 0):
        monkeypatch.setattr(pii, "fits_broadcast", lambda df: False)
        monkeypatch.setattr(pii, "SHARED_UNITS", shared)
        far = find_pii(docs)
        assert sorted((r.doc_id, str(r.text), r.pii) for r in far.collect()) == wanted
        plan = far._jdf.queryExecution().optimizedPlan().toString()
        assert ("LeftAnti" in plan and "LeftSemi" in plan) == (shared > 0)
