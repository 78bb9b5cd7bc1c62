import random

import pytest

from pyspark.sql import functions as F

from pagelode.functions import html as H
from pagelode.functions.htmltree import read_page
from pagelode.operators.parse import parse_pages, to_documents

PAGES = {
    "no_title": "<body><h1>First</h1><h1>Second</h1></body>",
    "no_title_no_h1": "<body><p>x</p></body>",
    "empty_title": "<title> </title><body><h1>H</h1></body>",
    "meta_reversed": '<meta content="  a &amp; b " name="description"><body>x</body>',
    "meta_case": '<meta name="Description" content="no"><META NAME=description CONTENT=yes>',
    "class_content": '<body><main class="main">a<div class="Page-Content">b</div></main></body>',
    "class_nobody": '<body>out<div class="nobody">in</div></body>',
    "plain_article": "<body>p <article>q</article></body>",
    "no_body": "<p>fragment</p>",
    "heading_in_header": "<body><header><h1>Top</h1></header><h2>Sub</h2></body>",
    "heading_order": "<body><h2>b</h2><h1>a</h1><h3>d</h3><h1>c</h1></body>",
    "unclosed_body": "<body>runs to <b>the</b> end",
    "link_in_comment": '<!-- <a href="/no">n</a><title>No</title> --><title>Yes</title>'
    '<script>var s="<a href=/no>";</script><body><a href="/yes">y</a></body>',
    "quotes": "<body><a href='/s' title=\"t > u\">1</a><a href=/b>2</a><a href>3</a><a name=z>4</a></body>",
    "unclosed_nav": '<body>a<div>b<nav>c<a href="/n">d</a></div>e</body>',
    "nested_nav": "<body>a<nav>b<nav>c</nav>d</nav>e</body>",
    "stray_close": "<body>a</nav>b</body>",
    "entities": "<title>&lt;b&gt; &amp;copy; &copy;</title><body>&eacute;&#233;&#xe9; x</body>",
    "nested_anchor": '<body><a href="/1">a<a href="/2">b</a>c</a></body>',
    "unclosed_heading": "<body><h2>a<p>b</body>",
    "two_attrs": '<body><a data-href="/no" href="/one" href="/two">x</a></body>',
    "spaces": "<title>a  \n b</title><body> c\t\td </body>",
    "null": None,
}

EXPECTED = {
    "no_title": dict(title="First", headings=[(1, "First"), (1, "Second")]),
    "no_title_no_h1": dict(title="No Title", content="x"),
    "empty_title": dict(title="", content="H"),
    "meta_reversed": dict(meta_description="a & b"),
    "meta_case": dict(meta_description="yes"),
    "class_content": dict(content="ab b"),
    "class_nobody": dict(content="in"),
    "plain_article": dict(content="p q"),
    "no_body": dict(content=""),
    "heading_in_header": dict(title="Top", headings=[(2, "Sub")]),
    "heading_order": dict(headings=[(1, "a"), (1, "c"), (2, "b"), (3, "d")]),
    "unclosed_body": dict(content="runs to the end"),
    "link_in_comment": dict(title="Yes", links=[("http://t.x/yes", "y", "")]),
    "quotes": dict(
        links=[
            ("http://t.x/s", "1", "t > u"),
            ("http://t.x/b", "2", ""),
            ("http://t.x/p", "3", ""),
        ]
    ),
    "unclosed_nav": dict(content="abe", links=[]),
    "nested_nav": dict(content="ae"),
    "stray_close": dict(content="ab"),
    "entities": dict(title="<b> &copy; ©", content="ééé x"),
    "nested_anchor": dict(
        links=[("http://t.x/1", "abc", ""), ("http://t.x/2", "b", "")]
    ),
    "unclosed_heading": dict(headings=[(2, "ab")]),
    "two_attrs": dict(links=[("http://t.x/two", "x", "")]),
    "spaces": dict(title="a b", content="c d"),
}


@pytest.fixture(scope="module")
def parsed(spark):
    # the url names the case; links resolve against the fixed path /p
    rows = [(f"http://t.x/p#{name}", body) for name, body in PAGES.items()]
    pages = spark.createDataFrame(rows, "url string, content string")
    out = parse_pages(pages).withColumn(
        "links",
        F.transform("links", lambda l: F.struct(l["url"], l["text"], l["title"])),
    )
    return {r.url.split("#")[1]: r for r in out.collect()}


@pytest.mark.parametrize("name", EXPECTED)
def test_corner_page(parsed, name):
    row = parsed[name]
    for field, value in EXPECTED[name].items():
        got = row[field]
        if field == "links":
            got = [(l.url.split("#")[0], l.text, l.title) for l in got]
        if field == "headings":
            got = [(h.level, h.text) for h in got]
        assert got == value, field


def test_null_page_is_dropped(parsed):
    assert set(parsed) == set(PAGES) - {"null"}


def test_defaults_and_length(parsed):
    row = parsed["no_title_no_h1"]
    assert (row.crawl_time, row.depth, row.content_length) == (0.0, 0, 1)


def test_patterns_and_tree_agree_on_plain_pages(spark, tiny_dir):
    pages = spark.read.parquet(f"{tiny_dir}/pages.parquet")
    parsed = parse_pages(pages.select("url", F.col("html").alias("content")))
    text = {r.url: r for r in parsed.collect()}
    assert len(text) == pages.count()
    for row in pages.collect():
        tree = read_page(row.html)
        got = text[row.url]
        for field in ("title", "meta_description", "content"):
            assert got[field] == tree[field], (row.url, field)
        assert [(h.level, h.text) for h in got.headings] == [
            (h["level"], h["text"]) for h in tree["headings"]
        ]


def random_page(seed):
    """Elements that open, close and stay open in any order, some of main-content class."""
    r = random.Random(seed)
    starts = ["<div>", '<div class="Content x">', "<main class=main>", "<article class='post-body'>", "<span>",
              "<p>", "<br>", "<section class=content>", "<img/>", "<div class=content />", '<DIV CLASS="body">',
              '<div title="class=content">', '<div class=a class="main">', "<li>", "<!doctype x>"]
    ends = ["</div>", "</main>", "</article>", "</span>", "</p>", "</section>", "</DIV >", "</li>", "</b>"]
    parts = [r.choice([r.choice(starts), r.choice(ends), f"t{i} ", "a &amp; b", " "]) for i in range(r.randint(1, 40))]
    return "<body>" + "".join(parts) + r.choice(["</body>", ""])


def test_main_content_needs_no_python(spark):
    pages = {f"http://t.x/{i}": random_page(i) for i in range(300)}
    frame = spark.createDataFrame(list(pages.items()), "url string, content string")
    got = {r.url: r.content for r in parse_pages(frame).collect()}
    for url, page in pages.items():
        assert got[url] == read_page(page)["content"], page
    quiet, stripped = H.quiet_html("content"), H.strip_boilerplate(H.quiet_html("content"))
    hard = H.needs_tree(quiet, stripped, H.heading_elements(stripped), H.anchor_elements(stripped))
    assert frame.filter(hard).count() == 0
    assert frame.filter(H.has_content_class(stripped)).count() > 150


def test_documents_have_the_index_fields(spark):
    pages = spark.createDataFrame(
        [("u", "<body><h2>b</h2><h1>a</h1></body>", 3, 86400.0)],
        "url string, content string, depth int, crawl_time double",
    )
    row = to_documents(parse_pages(pages)).first()
    assert (row.headings, row.depth, row.crawl_time.isoformat()) == (
        "a b",
        3,
        "1970-01-02T00:00:00",
    )


def test_long_page_does_not_overflow_the_matcher(spark):
    inside = "x" * 300_000
    page = f'<title>t</title><body><a title="{inside}" href="/l">{inside}</a>' + (
        "<p class='c'>y</p>" * 20_000
    )
    pages = spark.createDataFrame([("http://t.x/", page)], "url string, content string")
    row = parse_pages(pages).first()
    assert row.content_length == 320_000
    assert row.links[0].url == "http://t.x/l"


def test_quiet_html_keeps_text_outside(spark):
    df = spark.createDataFrame([("a<!-- b -->c<style>d</style>e",)], "h string")
    assert df.select(H.quiet_html("h").alias("q")).first().q == "ace"
