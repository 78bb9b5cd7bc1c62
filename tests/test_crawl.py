"""Frontier and crawl rules on small literal graphs, and against a queue."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from pagelode.functions.shards import align_shards
from pagelode.operators import crawl as C, joins


def visit(seeds, edges, fetchable, max_pages, max_depth):
    """A first-in-first-out queue: what the frontier has to equal."""
    queue, visited = deque((u, 0) for u in seeds), {}
    while queue and len(visited) < max_pages:
        url, depth = queue.popleft()
        if url in visited or depth > max_depth or url not in fetchable:
            continue
        visited[url] = (depth, len(visited) + 1)
        queue.extend((link, depth + 1) for link in edges.get(url, []) if link not in visited)
    return visited


def frontier(spark, seeds, edges, fetchable, max_pages, max_depth):
    rows = [(s, i, d) for s, links in edges.items() for i, d in enumerate(links)]
    out = C.crawl_frontier(
        spark.createDataFrame([(u, i) for i, u in enumerate(seeds)], "url string, seed_order long"),
        spark.createDataFrame(rows, "src string, pos long, dst string"),
        spark.createDataFrame([(u,) for u in fetchable], "url string"),
        max_pages,
        max_depth,
    )
    return {r.url: (r.depth, r.crawl_seq) for r in out.collect()}


DIAMOND = {"a": ["b", "c"], "b": ["d", "a"], "c": ["d", "e"], "d": ["f"], "e": ["f", "e"]}


@pytest.mark.parametrize(
    "seeds, max_pages, max_depth, missing",
    [
        (["a"], 100, 3, ""),  # cycle and diamond
        (["a"], 4, 3, ""),  # cap inside a level
        (["a"], 100, 0, ""),
        (["x", "c"], 100, 3, "x"),  # seed not fetchable
        (["c", "a", "c"], 100, 1, ""),  # duplicate seeds
        (["a"], 100, 3, "c"),
        (["x"], 100, 3, "x"),  # nothing to visit
    ],
)
def test_small_graphs(spark, seeds, max_pages, max_depth, missing):
    pages = set("abcdef") - set(missing)
    args = (seeds, DIAMOND, pages, max_pages, max_depth)
    assert frontier(spark, *args) == visit(*args)


def test_stored_edges_are_pruned_by_level(spark, tmp_path):
    r = random.Random(5)
    edges = {str(i): [str(r.randrange(80)) for _ in range(3)] for i in range(80)}
    rows = [(s, i, d) for s, links in edges.items() for i, d in enumerate(links)]
    frame = spark.createDataFrame(rows, "src string, pos long, dst string")
    stored = C.store_edges(frame, str(tmp_path / "edges"), shards=8)
    seeds = spark.createDataFrame([("3", 0)], "url string, seed_order long")
    pages = spark.createDataFrame([(u,) for u in edges], "url string")
    got = C.crawl_frontier(seeds, stored, pages, 60, 3)
    assert {x.url: (x.depth, x.crawl_seq) for x in got.collect()} == visit(["3"], edges, set(edges), 60, 3)
    asked = seeds.filter("seed_order >= 0").select(F.col("url").alias("src"))
    parents, shard = align_shards(stored, asked, "src")
    plan = joins.join_small(stored, parents, ["src", *shard])._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


@pytest.mark.parametrize("broadcast_rows", [joins.BROADCAST_ROWS, 0])
def test_random_graph_with_a_hub(spark, monkeypatch, broadcast_rows):
    """One page holds a third of all links and is the target of another third.

    Without broadcasts the levels are numbered over many tasks.
    """
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(3)
    names = [f"n{i}" for i in range(60)]
    edges = {n: [rng.choice(names) for _ in range(3)] + ["n0", "n0"] for n in names}
    edges["n0"] = [rng.choice(names) for _ in range(150)]
    args = (["n1", "n2"], edges, set(names[:50]), 37, 4)
    assert frontier(spark, *args) == visit(*args)


def test_raw_links_see_the_whole_page(spark):
    html = (
        '<nav><a href="/n">n</a></nav><a href="mailto:x@y">m</a><!-- <a href="/c">c</a> -->'
        '<a name="k">k</a><a href="/n">n</a><A HREF=\'//h.net/p\'>h</A>'
    )
    pages = spark.createDataFrame([("https://a.b/d/e", html)], "url string, content string")
    rows = C.extract_raw_links(pages).orderBy("pos").collect()
    assert [r.link for r in rows] == ["https://a.b/n", "https://a.b/n", "https://h.net/p"]


def test_html_only(spark):
    rows = [
        ("a", 200, "text/html"),
        ("b", 404, "text/html"),
        ("c", 200, "application/pdf"),
        ("d", 399, "TEXT/HTML; charset=x"),
        ("e", 200, None),
    ]
    kept = C.html_only(spark.createDataFrame(rows, "url string, status int, content_type string"))
    assert sorted(r.url for r in kept.collect()) == ["a", "d"]


def test_robots_first_rule_decides(spark):
    rules = [
        ("http://a", 0, "/x/open", True),
        ("http://a", 1, "/x/", False),
        ("http://a", 2, "/x/shut", True),
        ("http://b", 0, "", False),  # an empty prefix forbids nothing
        ("http://c", 0, "/", False),
        ("http://d", 0, "/a b", False),
    ]
    urls = "http://a/x/open/1 http://a/x/shut http://a/y http://b/q http://c http://c/z http://d/a%20b http://d/a+b http://e/ http://a/y"
    out = C.robots_filter(
        spark.createDataFrame([(u,) for u in urls.split()], "url string"),
        spark.createDataFrame(rules, "origin string, rule_order int, path_prefix string, allow boolean"),
    )
    assert sorted(r.url for r in out.collect()) == [
        "http://a/x/open/1", "http://a/y", "http://a/y", "http://b/q", "http://d/a+b", "http://e/",
    ]


def test_link_edges(spark):
    pages = spark.createDataFrame(
        [("http://a/", '<a href="/1">1</a><a href="/2">2</a>', 2)],
        "url string, content string, depth int",
    )
    seen = spark.createDataFrame([("http://a/1",)], "url string")
    rows = C.link_edges(pages, seen).collect()
    assert [(r.src_url, r.link, r.link_depth) for r in rows] == [("http://a/", "http://a/2", 3)]
