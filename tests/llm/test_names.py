"""Columns with the names that operators use for themselves, and odd rows beside them."""

import pytest
from pyspark.sql import functions as F

from pagelode.llm.decontaminate import decontaminate
from pagelode.llm.html_extract import extract_text, main_text
from pagelode.llm.pii import find_pii, sanitise
from pagelode.llm.quality_rules import quality_rules
from pagelode.llm.toxicity import score_toxicity
from pagelode.llm.url_filters import filter_urls

CLASHING = (
    "_t _n _w _l _u _clean _left _bad _text _found _pii_key _pii_all _page _spans _done "
    "_salt _Text aside_t _id _out"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Mail a@b.example or call, said the fox."), (2, None), (3, ""), (1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    taken = {c.lower(): c for c in CLASHING}.values()
    return df.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in taken})


def same(before, after, new):
    """Every column of before stands in after with its values."""
    assert after.columns == [*before.columns, *new]
    order = lambda df: sorted(map(str, df.select(before.columns).collect()))
    assert order(after) == order(before)


def test_quality_rules(docs):
    same(docs, quality_rules(docs), ["quality"])


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, "said the fox")], "item_id long, text string")
    same(docs, decontaminate(docs, items), ["contamination"])
    blocks = decontaminate(docs, items.union(items.selectExpr("2", "'call said'")), block_bytes=10)
    same(docs, blocks, ["contamination"])


def test_personal_data(docs):
    found = find_pii(docs)
    same(docs, found, ["pii"])
    clean = sanitise(found)
    assert clean.columns == found.columns
    assert "a@b.example" not in " ".join(r.text or "" for r in clean.collect())
    same(docs.drop("text"), clean.drop("text", "pii"), [])


def test_text_in_a_column_of_such_a_name(docs):
    named = docs.drop("_text").withColumnRenamed("text", "_text")
    found = find_pii(named, text="_text")
    same(named, found, ["pii"])
    assert "a@b.example" not in " ".join(r["_text"] or "" for r in sanitise(found, "_text").collect())


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    scored = score_toxicity(docs, labels, F.lit(False))
    same(docs, scored, ["score", "predicted"])


def test_url_filters(spark, docs):
    captures = docs.withColumn("url", F.lit("http://a.example/x")).withColumn(
        "fetch_time", F.timestamp_seconds(F.lit(10)).cast("timestamp_ntz")
    )
    entries = spark.createDataFrame(
        [("block", "host", "a.example", "add", 1)], "list string, kind string, pattern string, action string, seq int"
    ).withColumn("time", F.timestamp_seconds(F.lit(5)).cast("timestamp_ntz"))
    judged = filter_urls(captures, entries)
    same(captures, judged, ["url_filter"])
    assert not any(r.url_filter.kept for r in judged.collect())


def test_extract_text(docs):
    pages = docs.withColumnRenamed("text", "html")
    out = extract_text(pages, out="main")
    assert out.columns == [*[c for c in pages.columns if c != "html"], "main"]
    assert out.count() == 4


STORY = " ".join(f"Plain sentence number {i}, with some words in it." for i in range(12))


def page(inside):
    return f"<html><body><article><h1>T</h1><p>{STORY}</p>{inside}<p>{STORY}</p></article></body></html>"


@pytest.mark.parametrize(
    "inside, kept, gone",
    [
        (f'<p data-x="{"a>b" * 4000}">Story, here.</p>', ["Story, here."], "a>b"),
        ("<p " + " ".join(f'd{i}="x>{i}"' for i in range(250)) + ">Many of them, here.</p>", ["Many of them, here."], "x>"),
        ('<p data-id="share">Kept, of the story.</p>', ["Kept, of the story."], "share"),
        ('<p title="class=ad">Kept, of the story.</p>', ["Kept, of the story."], "class"),
        ("<ul><li>one item</li></ul><blockquote>A quote.</blockquote><table><tr><td>cell</td></tr></table>",
         ["one item", "A quote.", "cell"], "<"),
        ('<div class="ad"><p>Buy this, now.</p></div>', [], "Buy"),
    ],
    ids=["long value", "many attributes", "data-id", "quoted name", "short blocks", "advert"],
)
def test_tags_and_short_blocks(inside, kept, gone):
    text = main_text(page(inside))
    assert all(k in text for k in kept) and gone not in text and text.count("Plain sentence") == 24


def test_open_quotes_take_linear_time():
    for text in ("<p>" + '<a "x ' * 60001 + ">", "<p>" + '<a "x> ' * 60001, "<p>" + "<a 'x\" " * 60001):
        assert isinstance(main_text(text), str)
