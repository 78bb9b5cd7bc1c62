"""Updates of a stored index against an index built anew."""

import pytest

from pagelode.operators.analyze import Analyzer
from pagelode.operators import joins
from pagelode.plans import index as I
from pagelode.plans.search import search
from pagelode.sources.document_log import latest_documents, read_log
from pagelode.streaming.ingest import ingest_stream

PLAIN = Analyzer().unstemmed()
SCHEMA = (
    "url string, title string, content string, meta_description string, headings string, "
    "content_length int, crawl_time timestamp, depth int"
)


def docs(spark, *rows):
    full = [(u, t, c, "", "", len(c), None, 0) for u, t, c in rows]
    return spark.createDataFrame(full, SCHEMA)


def content(index):
    """Tables of an index as comparable sets, without the layout columns."""
    names = ["documents", "hits", "postings", "term_stats", "field_stats"]
    out = {}
    for name in names:
        frame = getattr(index, name)
        frame = frame.select(*sorted(c for c in frame.columns if not c.startswith("shard_")))
        rows = [tuple(str(v) for v in r) for r in frame.collect()]
        assert len(rows) == len(set(rows))
        out[name] = set(rows)
    return out


def found(spark, index, *texts):
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    return [tuple(r) for r in search(index, queries, 0.0).select("query_id", "url", "score", "rank").collect()]


@pytest.fixture
def path(spark, tmp_path):
    first = docs(spark, ("a", "red fox", "a red fox runs"), ("b", "blue car", "cars are blue"),
                 ("c", "green tree", "red leaves"))
    I.write_index(first, str(tmp_path / "index"), PLAIN, shards=3)
    return str(tmp_path / "index")


def rebuilt(spark, tmp_path, *rows):
    return I.write_index(docs(spark, *rows), str(tmp_path / "anew"), PLAIN, shards=3)


def test_updates_equal_a_build(spark, path, tmp_path):
    I.update_index(spark, path, docs(spark, ("a", "old fox", "grey"), ("d", "red", "red red")), analyzer=PLAIN)
    I.update_index(spark, path, deletes=docs(spark, ("b", "", ""), ("x", "", "")), analyzer=PLAIN)
    I.update_index(spark, path, docs(spark, ("b", "back", "fox")), docs(spark, ("d", "", "")), PLAIN)
    got = I.update_index(spark, path, docs(spark, ("a", "new", "red fox")), analyzer=PLAIN)
    want = rebuilt(spark, tmp_path, ("a", "new", "red fox"), ("b", "back", "fox"), ("c", "green tree", "red leaves"))
    assert content(got) == content(want)
    assert found(spark, got, "red fox", "fox", "grey blue") == found(spark, want, "red fox", "fox", "grey blue")
    merged = I.merge_index(spark, path, PLAIN)
    assert content(merged) == content(want)
    assert "LeftAnti" not in merged.postings._jdf.queryExecution().optimizedPlan().toString()


def test_a_published_batch_changes_nothing_again(spark, path):
    one = docs(spark, ("a", "one", "one"))
    before = content(I.update_index(spark, path, one, analyzer=PLAIN, batch="1"))
    after = I.update_index(spark, path, docs(spark, ("a", "two", "two")), analyzer=PLAIN, batch="1")
    assert content(after) == before
    I.merge_index(spark, path, PLAIN)
    again = I.update_index(spark, path, docs(spark, ("a", "two", "two")), analyzer=PLAIN, batch="1")
    assert content(again) == before


def test_an_update_that_fails_publishes_nothing(spark, path, monkeypatch):
    before = content(I.read_index(spark, path, PLAIN))

    def broken(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(I, "_write_changes", broken)
    with pytest.raises(RuntimeError):
        I.update_index(spark, path, docs(spark, ("z", "z", "z")), analyzer=PLAIN, batch="1")
    assert content(I.read_index(spark, path, PLAIN)) == before
    monkeypatch.undo()
    assert content(I.update_index(spark, path, docs(spark, ("z", "zz", "zz")), analyzer=PLAIN, batch="1")) != before


def test_segments_merge_past_the_limit(spark, path, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "MAX_SEGMENTS", 2)
    I.update_index(spark, path, docs(spark, ("a", "x", "x")), analyzer=PLAIN)
    got = I.update_index(spark, path, docs(spark, ("a", "y", "y")), analyzer=PLAIN)
    assert not I._published(spark, path)["segments"]
    want = rebuilt(spark, tmp_path, ("a", "y", "y"), ("b", "blue car", "cars are blue"), ("c", "green tree", "red leaves"))
    assert content(got) == content(want)


def test_urls_too_many_to_broadcast_merge_nothing(spark, path, tmp_path, monkeypatch):
    """An update that replaces many documents does not write the index anew."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    I.update_index(spark, path, docs(spark, ("a", "new", "red fox"), ("d", "red", "fox red")), analyzer=PLAIN)
    got = I.update_index(spark, path, deletes=docs(spark, ("b", "", ""), ("x", "", "")), analyzer=PLAIN)
    assert len(I._published(spark, path)["segments"]) == 2
    want = rebuilt(spark, tmp_path, ("a", "new", "red fox"), ("c", "green tree", "red leaves"), ("d", "red", "fox red"))
    assert content(got) == content(want)
    assert found(spark, got, "red fox", "fox", "blue") == found(spark, want, "red fox", "fox", "blue")


def test_every_document_can_go(spark, path):
    gone = I.read_index(spark, path, PLAIN).documents.select("url")
    left = I.update_index(spark, path, deletes=gone, analyzer=PLAIN)
    assert all(not rows for rows in content(left).values())
    assert found(spark, left, "red fox") == []


def test_of_repeated_urls_the_latest_crawl_counts(spark, path):
    rows = docs(spark, ("n", "old", "old"), ("n", "new", "new")).selectExpr(
        "* except (crawl_time)", "timestamp_seconds(if(title = 'new', 10, 5)) as crawl_time"
    )
    got = I.update_index(spark, path, rows, analyzer=PLAIN)
    assert [r.title for r in got.documents.filter("url = 'n'").collect()] == ["new"]


def test_merged_reads_still_prune_directories(spark, path):
    index = I.update_index(spark, path, docs(spark, ("a", "x", "red")), analyzer=PLAIN)
    from pagelode.operators.match import analyze_queries, match_terms

    queries = spark.createDataFrame([(1, "red")], "query_id long, query string")
    plan = match_terms(index.postings, analyze_queries(queries, PLAIN))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("dynamicpruning") >= 2  # version and segment
    assert {r.url for r in plan.collect()} == {"a", "c"}


def page(url, text):
    return (url, f"<html><head><title>{text}</title></head><body>{text}</body></html>")


def test_a_stream_feeds_the_index(spark, tmp_path):
    source, log, index = (str(tmp_path / n) for n in ("in", "log", "index"))
    schema = "url string, html string"

    def run():
        ingest_stream(
            spark, source, schema, log, str(tmp_path / "check"), content="html", index=index,
            analyzer=PLAIN, shards=2,
        ).awaitTermination()

    spark.createDataFrame([page("http://a/", "red fox"), page("http://b/", "blue car")], schema).write.parquet(source)
    run()
    assert {r[1] for r in found(spark, I.read_index(spark, index, PLAIN), "red fox")} == {"http://a/"}
    spark.createDataFrame([page("http://a/", "grey fox"), page("http://c/", "red fox")], schema).write.mode("append").parquet(source)
    run()
    run()  # nothing new
    stored = I.read_index(spark, index, PLAIN)
    assert {r[1] for r in found(spark, stored, "red fox")} == {"http://c/"}
    current = latest_documents(read_log(spark, log))
    anew = I.write_index(current, str(tmp_path / "anew"), PLAIN, shards=2)
    assert content(stored) == content(anew)
