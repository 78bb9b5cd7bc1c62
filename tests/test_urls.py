from urllib.parse import urljoin

from pyspark.sql import functions as F

from pagelode.functions.urls import origin, resolve_url

BASES = [
    "http://a.b/c/d?q=1#f",
    "https://x.org",
    "https://x.org/",
    "http://a.b/c/d/e/",
    "http://a.b/c//d/./e",
]
HREFS = (
    "/r/s|g|./g|../g|../../g|../../../g|g/|?y=2|#z|//h.net/p|https://o.net/q|"
    "mailto:a@b||g;x=1?y#s|/a/./b/../c|.|..|a/../b?k=/x|javascript:void(0)|"
    "http://a.b|https://x.org/k?a#b|g?y/./x|g#s/../x|a//b|/a//b/|/..|%7Eme|"
    "  /lead|tel:1|HTTP://UP.org/a|//h.net|?|#|a:b|1:2|/é?ü#ö"
).split("|")


def test_every_pair_equals_the_standard_library(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    rows = (
        spark.createDataFrame(pairs, "base string, href string")
        .select("base", "href", resolve_url("base", "href").alias("url"))
        .collect()
    )
    wrong = [
        (r.base, r.href, r.url, urljoin(r.base, r.href))
        for r in rows
        if r.url != urljoin(r.base, r.href)
    ]
    assert len(rows) == len(pairs)
    assert wrong == []


def test_null_href_stays_null(spark):
    df = spark.createDataFrame([("http://a.b/", None)], "base string, href string")
    assert df.select(resolve_url("base", "href").alias("u")).first().u is None


def test_origin(spark):
    df = spark.createDataFrame([("https://a.b:8/c?d",), ("mailto:x",)], "u string")
    assert [r.o for r in df.select(origin("u").alias("o")).collect()] == [
        "https://a.b:8",
        "",
    ]
