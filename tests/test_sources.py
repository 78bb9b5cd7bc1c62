"""Sources, the document log and continuous ingestion."""

import json

import pytest

from pyspark.sql import functions as F

from pagelode.operators.documents import delete_documents, index_stats, upsert_documents
from pagelode.operators.parse import DOCUMENT_FIELDS, parse_pages, to_documents
from pagelode.session import shared_dir, stage, use_all_cores
from pagelode.sources import document_log as L
from pagelode.sources.pages import page_records, read_pages, read_seeds, seeds_from_text
from pagelode.streaming.ingest import ingest_stream

DOC = (
    "url string, title string, content string, meta_description string, headings string, "
    "content_length int, crawl_time timestamp, depth int"
)


def documents(spark, **titles):
    rows = [(u, t, "c", "", "", 1, None, 0) for u, t in titles.items()]
    return spark.createDataFrame(rows, DOC)


def titles(df):
    return sorted((r.url, r.title) for r in df.collect())


def test_job_file(spark, tmp_path):
    jobs = {
        "crawl_jobs": [
            {"id": 1, "name": "n", "seed_urls": ["http://a", "http://b"], "max_pages": 5,
             "max_depth": 2, "last_run": None, "status": "scheduled"},
            {"id": 2, "name": "m", "seed_urls": [], "max_pages": 1, "max_depth": 1},
        ],
        "last_updated": "x",
    }
    path = tmp_path / "jobs.json"
    path.write_text(json.dumps(jobs, indent=2))
    rows = read_seeds(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "http://a", 5, 2), (1, 1, "http://b", 5, 2)]


def test_job_file_without_jobs(spark, tmp_path):
    path = tmp_path / "jobs.json"
    path.write_text("{}")
    assert read_seeds(spark, str(path)).count() == 0


def test_seeds_from_text(spark):
    df = spark.createDataFrame([(1, " http://a \r\n\n \t\nhttp://b"), (2, "")], "id int, t string")
    rows = seeds_from_text(df, "t").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "http://a"), (1, 1, "http://b")]


def test_page_defaults(spark, tmp_path):
    spark.createDataFrame([("u", "h")], "url string, html string").write.json(str(tmp_path / "p"))
    row = read_pages(spark, str(tmp_path / "p"), content="html", format="json").first()
    assert tuple(row) == ("u", "h", 0, 0.0)


def test_log_append_upsert_delete_compact(spark, tmp_path):
    log = str(tmp_path / "log")
    L.append_documents(documents(spark, a="1", b="1", c="1"), log, 0)
    L.append_documents(documents(spark, b="2", d="2"), log, 1)
    L.append_deletions(spark.createDataFrame([("c",)], "url string"), log, 2)
    rows = L.read_log(spark, log)
    assert titles(L.all_documents(rows)) == [
        ("a", "1"), ("b", "1"), ("b", "2"), ("c", "1"), ("d", "2"),
    ]
    current = [("a", "1"), ("b", "2"), ("d", "2")]
    assert titles(L.latest_documents(rows)) == current
    assert index_stats(L.latest_documents(rows)).first().document_count == 3
    # a batch written again replaces itself
    L.append_documents(documents(spark, b="2", d="2"), log, 1)
    assert titles(L.latest_documents(L.read_log(spark, log))) == current
    out = str(tmp_path / "compact")
    assert titles(L.compact_documents(spark, log, out, files=2)) == current
    assert L.read_log(spark, out).count() == 3
    # the compacted log goes on with the next batch
    L.append_documents(documents(spark, c="3"), out, 3)
    assert titles(L.latest_documents(L.read_log(spark, out))) == [*current[:2], ("c", "3"), ("d", "2")]


def test_latest_view_limits_before_the_shuffle(spark, tmp_path):
    log = str(tmp_path / "log")
    copies = spark.range(500).select(F.lit("same").alias("url"), F.col("id").cast("string").alias("title"))
    others = {f: F.lit(None).cast(t) for f, t in (x.split() for x in DOC.split(", ")[2:])}
    L.append_documents(copies.withColumns(others).coalesce(1), log, 0)
    latest = L.latest_documents(L.read_log(spark, log))
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle
    assert titles(latest) == [("same", "499")]


def test_compaction_moves_bodies_once_and_hot_urls_hardly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "HOT_ROWS", 50)
    log = str(tmp_path / "log")
    urls = F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 40))
    rows = spark.range(500).select(urls.alias("url"), F.col("id").cast("string").alias("title"))
    others = {f: F.lit(None).cast(t) for f, t in (x.split() for x in DOC.split(", ")[2:])}
    L.append_documents(rows.withColumns(others).repartition(3), log, 0)
    L.append_deletions(spark.createDataFrame([("u1",)], "url string"), log, 1)
    wanted = titles(L.latest_documents(L.read_log(spark, log)))
    thinned = L._one_row_of_hot_urls(L.read_log(spark, log))
    assert thinned.filter("url = 'hot'").count() == 1
    plan = L.latest_documents(thinned.repartitionByRange("url"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan.split("rangepartitioning")[0]
    out = str(tmp_path / "compact")
    assert titles(L.compact_documents(spark, log, out, files=4)) == wanted and len(wanted) == 40
    for part in spark.read.parquet(out).select(F.input_file_name().alias("f"), "url").groupBy("f").agg(F.collect_list("url").alias("u")).collect():
        assert part.u == sorted(part.u)


def test_upsert_is_idempotent_and_delete_exact(spark):
    current, updates = documents(spark, a="1", b="1"), documents(spark, b="2", c="2")
    once = upsert_documents(current, updates)
    assert titles(once) == titles(upsert_documents(once, updates))
    assert titles(once) == [("a", "1"), ("b", "2"), ("c", "2")]
    gone = spark.createDataFrame([("a",), ("a",), ("B",)], "url string")
    assert titles(delete_documents(once, gone)) == [("b", "2"), ("c", "2")]


def test_stream_equals_batch_and_replay_changes_nothing(spark, tiny_dir, tmp_path):
    pages = spark.read.parquet(f"{tiny_dir}/pages.parquet")
    source, log = str(tmp_path / "pages"), str(tmp_path / "log")
    first, second = pages.filter("page_id <= 20"), pages.filter("page_id > 20")

    def run(checkpoint):
        ingest_stream(
            spark, source, pages.schema, log, str(tmp_path / checkpoint), content="html",
            options={"maxFilesPerTrigger": "1"}, name="pages",
        ).awaitTermination()
        return L.latest_documents(L.read_log(spark, log))

    first.coalesce(1).write.mode("append").parquet(source)
    run("cp")
    second.coalesce(1).write.mode("append").parquet(source)
    streamed = run("cp")
    batch = to_documents(parse_pages(page_records(pages, "html"))).select(*DOCUMENT_FIELDS)
    assert streamed.count() == pages.count()
    assert streamed.exceptAll(batch).count() == 0
    # a new checkpoint replays both files into the same batch directories
    assert run("cp-2").exceptAll(batch).count() == 0
    assert L.read_log(spark, log).count() == pages.count()


def test_streams_never_replace_each_other(spark, tmp_path):
    schema, log = "url string, content string", str(tmp_path / "log")

    def feed(source, url, text, checkpoint):
        page = spark.createDataFrame([(url, f"<html><body>{text}</body></html>")], schema)
        page.write.mode("append").parquet(str(tmp_path / source))
        ingest_stream(
            spark, str(tmp_path / source), schema, log, str(tmp_path / checkpoint)
        ).awaitTermination()

    def current():
        rows = L.latest_documents(L.read_log(spark, log)).collect()
        return sorted((r.url, r.content) for r in rows)

    feed("one", "http://a/", "old", "cp-1")
    feed("two", "http://b/", "b", "cp-2")  # its own checkpoint starts at batch 0 again
    assert current() == [("http://a/", "old"), ("http://b/", "b")]
    feed("two", "http://a/", "new", "cp-2")
    assert current() == [("http://a/", "new"), ("http://b/", "b")]
    out = str(tmp_path / "compact")
    L.compact_documents(spark, log, out)
    log = out
    feed("three", "http://a/", "newest", "cp-3")
    assert current() == [("http://a/", "newest"), ("http://b/", "b")]


def test_staged_table_is_cut_off_from_its_source(spark):
    staged = stage(spark.range(5), "numbers")
    assert "Range" not in staged._jdf.queryExecution().optimizedPlan().toString()
    assert staged.inputFiles()[0].replace("file://", "").startswith(
        shared_dir(spark).replace("file://", "").rstrip("/")
    )


def test_small_inputs_are_spread_and_large_ones_left(spark):
    cores = spark.sparkContext.defaultParallelism
    small = spark.range(10).coalesce(1)
    assert use_all_cores(small, "id").rdd.getNumPartitions() == cores
    large = spark.range(0, 10, 1, cores)
    assert use_all_cores(large, "id") is large


def test_files_of_one_row_group_are_spread(spark, tmp_path):
    """One file fills one split, whatever the number of splits it is cut into."""
    cores = spark.sparkContext.defaultParallelism
    path, rows = str(tmp_path / "t.parquet"), 2000 * cores
    spark.range(rows).coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        cut = spark.read.parquet(path)
        assert cut.rdd.getNumPartitions() >= cores
        dealt = use_all_cores(cut, "id")
        sizes = [len(part) for part in dealt.rdd.glom().collect()]
        assert sum(sizes) == rows and max(sizes) < rows / (2 * cores)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("path", ["pagelode", "__spark_entry__.py"])
def test_no_local_checkpoints(path):
    import pathlib

    root = pathlib.Path(__file__).parent.parent / path
    files = root.rglob("*.py") if root.is_dir() else [root]
    assert not [f for f in files if "localCheckpoint" in f.read_text()]
