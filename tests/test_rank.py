"""Ranking factors against a plain restatement of their rules."""

import math
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from pagelode.functions import scores as S
from pagelode.functions.text import word_count
from pagelode.operators.rank import best_ranked, rank_results
from pagelode.operators.serve import (
    answer_context,
    display_rows,
    page_info,
    paginate,
    to_envelope,
)

AS_OF = 1735689600.0


def field(words, text):
    text = text.lower()
    score = 0.0
    for word in words if text else []:
        if word == text:
            score += 10
        elif f" {word} " in f" {text} ":
            score += 5
        elif word in text:
            score += 2
    return score


def content(words, text, corpus):
    if not text:
        return 0.0
    low, total = text.lower(), 0.0
    for word in words:
        n = low.count(word)
        df = sum(word in other.lower() for other in corpus)
        tf = n / len(text.split())
        at = low.find(word)
        bonus = 1 - at / len(text) * 0.5 if at >= 0 else 1.0
        total += n * tf * math.log(len(corpus) / (df + 1)) * bonus
    return total


@pytest.mark.parametrize(
    "title, score",
    [("Spark", 10), ("use Spark now", 5), ("use spark, now", 2), ("none", 0), ("", 0)],
)
def test_title_terms(spark, title, score):
    df = spark.createDataFrame([(title, ["spark"])], "t string, w array<string>")
    assert df.select(S.field_score(F.col("w"), F.col("t")).alias("s")).first().s == score


@pytest.mark.parametrize(
    "n, score",
    [(None, 0), (0, 0), (99, 0.1), (100, math.exp(-(1400**2) / (2 * 750**2))),
     (1500, 1), (10000, math.exp(-(8500**2) / (2 * 750**2))), (10001, 0.3)],
)
def test_content_length(spark, n, score):
    df = spark.createDataFrame([(n,)], "n int")
    got = df.select(S.content_length_score(F.col("n")).alias("s")).first().s
    assert got == pytest.approx(score)


@pytest.mark.parametrize(
    "days, score", [(None, 0), (0, 1), (30, math.exp(-1)), (-1, math.exp(1 / 30))]
)
def test_freshness(spark, days, score):
    when = None
    if days is not None:
        when = datetime.fromtimestamp(AS_OF, timezone.utc) - timedelta(days=days)
    df = spark.createDataFrame([(when,)], "t timestamp")
    got = df.select(S.freshness_score(F.col("t"), AS_OF).alias("s")).first().s
    assert got == pytest.approx(score)


@pytest.mark.parametrize("n, df, idf", [(1, 1, math.log(1 / 2)), (2, 1, 0.0)])
def test_idf_may_be_negative(spark, n, df, idf):
    frame = spark.createDataFrame([(n, df)], "n long, df long")
    got = frame.select(S.inverse_document_frequency(F.col("n"), F.col("df")).alias("x"))
    assert got.first().x == pytest.approx(idf)


@pytest.mark.parametrize("text", ["", " ", "a", "a b", " a  b ", "a b\nc", "é à ...", "a\x1cb"])
def test_word_count(spark, text):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(word_count(F.col("t")).alias("n")).first().n == len(text.split())


def test_weights():
    assert S.merge_weights({"url_match": 9})["url_match"] == 9.0
    assert S.merge_weights()["heading_match"] == 2.5
    with pytest.raises(ValueError):
        S.merge_weights({"speed": 1})
    S.merge_weights()["freshness"] = 5
    assert S.DEFAULT_WEIGHTS["freshness"] == 1.0


TEXT = st.lists(st.sampled_from(["ab", "abc", "b", "Ab,", "ca b"]), max_size=8).map(" ".join)
ROW = "query_id long, url string, title string, content string, meta_description string, "
ROW += "headings string, content_length int, crawl_time timestamp, depth int, score double"


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(TEXT, TEXT, TEXT, TEXT), min_size=1, max_size=8), TEXT)
def test_ranking_equals_the_plain_rules(spark, docs, query):
    when = datetime.fromtimestamp(AS_OF, timezone.utc)
    rows = [
        (7, f"http://ab.x/{i}", t, c, m, h, 1500, when, i, i / 8)
        for i, (t, c, m, h) in enumerate(docs)
    ]
    queries = spark.createDataFrame([(7, query)], "query_id long, query string")
    ranked = rank_results(spark.createDataFrame(rows, ROW), queries, AS_OF)
    got = {r.url: r for r in ranked.collect()}
    words, corpus = query.lower().split(), [c for _, c, _, _ in docs]
    for i, (t, c, m, h) in enumerate(docs):
        row = got[f"http://ab.x/{i}"]
        parts = row.score_breakdown
        assert parts.title_score == field(words, t)
        assert parts.meta_score == field(words, m)
        assert parts.heading_score == field(words, h)
        assert parts.content_score == pytest.approx(content(words, c, corpus))
        assert parts.url_score == sum(w in row.url for w in words)
        total = 3 * parts.title_score + parts.content_score + 2 * parts.meta_score
        total += 2.5 * parts.heading_score + 1.5 * parts.url_score + 1 + 0.5
        assert row.ranking_score == pytest.approx(total - 0.02 * i + i / 8, abs=1e-5)


@pytest.fixture(scope="module")
def ranked(spark):
    """25 hits of query 1 and one of query 2, best first by number."""
    part = (0.0, 0.125, 0.0, 0.0, 0.0, 0.25, 0.0, 0.0)
    rows = [
        (1, f"u{i:02}", "" if i == 1 else f"t{i}", "c" * 310, "m" if i == 2 else "",
         100.0 - i, 0.0, part)
        for i in range(1, 26)
    ] + [(2, "v", "t", "short", "", 0.0, 0.0, part)]
    names = (
        "title_score content_score meta_score heading_score url_score "
        "freshness_score content_length_score depth_penalty"
    ).split()
    breakdown = ",".join(f"{n}:double" for n in names)
    return spark.createDataFrame(
        rows,
        "query_id long, url string, title string, content string, meta_description string,"
        f"ranking_score double, score double, score_breakdown struct<{breakdown}>",
    )


def test_pages(ranked):
    rows = paginate(ranked, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.url, r["rank"]) for r in rows] == [
        (1, f"u{i}", i) for i in range(21, 26)
    ]


@pytest.mark.parametrize("page, has_prev, has_next", [(1, False, True), (2, True, True), (3, True, False)])
def test_page_info(ranked, page, has_prev, has_next):
    row = page_info(ranked, page).filter("query_id = 1").first()
    assert (row.total, row.has_prev, row.has_next) == (25, has_prev, has_next)


def test_display(ranked):
    rows = {r.url: r for r in display_rows(ranked).collect()}
    assert rows["u01"].title == "Untitled"
    assert rows["u01"].snippet == "c" * 200 + "..."
    assert rows["u02"].snippet == "m"
    assert rows["u02"].score_text == "98.00"
    assert rows["v"].score_text is None
    assert (rows["v"].snippet, rows["v"].content_text) == ("short...", "0.1")


def test_answer_context(ranked):
    row = answer_context(ranked).filter("query_id = 1").first()
    cut = "c" * 300
    assert row.context == (
        f"\n[Source 1]: {cut}\n\n[Source 2]: m\n\n[Source 3]: {cut}\n"
    )


def test_envelope(spark, ranked):
    queries = spark.createDataFrame(
        [(1, " x "), (2, "y"), (3, "  "), (4, "none")], "query_id long, query string"
    )
    rows = {r.query_id: r for r in to_envelope(best_ranked(ranked, 10), queries).collect()}
    assert [r.url for r in rows[1].results] == [f"u{i:02}" for i in range(1, 11)]
    assert (rows[1].query, rows[1].total, rows[2].total, rows[4].total) == ("x", 10, 1, 0)
    assert rows[3].error and rows[3].total is None and rows[1].error is None
