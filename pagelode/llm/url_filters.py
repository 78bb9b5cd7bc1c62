"""URL filters by temporal lists.

Lists change over time: a dated entry adds or removes a pattern. The entries of one
pattern become validity intervals, each from its entry to the next. A capture is judged
by the entries that were active when it was fetched: its host, the domains above it and
the beginnings of its path are looked up, and an as-of join keeps the intervals that
hold the fetch time. The most specific pattern decides; an allow list wins over a block
list of the same pattern.

Built-in column functions only. Lists may be large, so both sides are shuffled; a host
with a third of all captures is spread over ``salts`` copies of its few intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import own_names

#: Kinds of patterns, least specific first.
KINDS = ["domain", "host", "prefix"]


def host_of(url):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path_of(url):
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Rows (list, kind, pattern, since, until) from dated entries.

    ``entries`` has list, kind, pattern, time, action (add or remove) and seq, which
    orders entries of one moment: the last of them holds. ``until`` is null while the
    entry is active. Entries with a null pattern or time, or with a kind or action that
    is none of those named, are no entries.
    """
    known = entries.filter(
        F.col("pattern").isNotNull() & F.col("time").isNotNull()
        & F.col("kind").isin(KINDS) & F.col("action").isin("add", "remove")
    ).select("list", "kind", F.col("pattern"), "time", "action", "seq")
    order = W.partitionBy("list", "kind", "pattern").orderBy("time", "seq", "action")
    dated = known.withColumn("until", F.lead("time").over(order))
    active = (F.col("action") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("time")))
    return dated.filter(active).select("list", "kind", "pattern", F.col("time").alias("since"), "until")


def _keys(url: str):
    """All patterns that could name a url, as (kind, pattern)."""
    labels = F.split(host_of(url), r"\.")
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    n, m = F.size(labels), F.size(parts)
    domains = F.when(
        n >= 2,
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")),
    ).otherwise(F.array().cast("array<string>"))
    prefixes = F.when(
        m >= 1,
        F.transform(
            F.sequence(F.lit(1), m),
            lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    tagged = lambda kind, array: F.transform(
        array, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern"))
    )
    return F.concat(
        tagged("domain", domains), tagged("host", F.array(host_of(url))), tagged("prefix", prefixes)
    )


@own_names
def filter_urls(
    captures: DataFrame, entries: DataFrame, url: str = "url", time: str = "fetch_time", salts: int = 16
) -> DataFrame:
    """All columns of ``captures`` and the struct ``url_filter`` (replaced if there).

    Its fields: kept, and list, kind, pattern and since of the deciding entry (null if
    none was active). A capture is dropped if the deciding list's name is ``block``.
    Null or malformed urls and null times meet no entry and are kept. Repeated rows are
    judged alike. Empty lists keep all.
    """
    kept = [c for c in captures.columns if c != "url_filter"]
    asked = captures.select(F.col(url).alias("_u"), F.col(time).alias("_t"))
    asked = asked.filter(F.col("_u").isNotNull() & F.col("_t").isNotNull() & (host_of("_u") != "")).distinct()
    salted = asked.withColumn("_salt", F.pmod(F.xxhash64("_u", "_t"), F.lit(salts)).cast("int"))
    keyed = salted.select("_u", "_t", "_salt", F.explode(_keys("_u")).alias("k")).select(
        "_u", "_t", "_salt", "k.kind", "k.pattern"
    )
    intervals = validity_intervals(entries).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    active = (F.col("since") <= F.col("_t")) & (F.col("until").isNull() | (F.col("_t") < F.col("until")))
    met = keyed.join(intervals, ["kind", "pattern", "_salt"]).filter(active)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    weight = F.struct(
        rank.alias("rank"), F.length("pattern").alias("length"), (F.col("list") == "allow").alias("allow"),
        F.col("since").alias("since"), F.col("list").alias("list"), F.col("pattern").alias("pattern"),
        F.col("kind").alias("kind"),
    )
    best = met.groupBy("_u", "_t").agg(F.max(weight).alias("_w"))
    joined = captures.select(*kept, F.col(url).alias("_u"), F.col(time).alias("_t")).join(
        best, ["_u", "_t"], "left"
    )
    verdict = F.struct(
        F.coalesce(F.col("_w.list") != "block", F.lit(True)).alias("kept"),
        *[F.col(f"_w.{f}").alias(f) for f in ("list", "kind", "pattern", "since")],
    )
    return joined.select(*kept, verdict.alias("url_filter"))
