"""Link extraction, crawl rules and the breadth-first frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html as H
from ..functions.shards import add_shard, align_shards
from ..functions.urls import origin, resolve_against, url_parts
from ..session import stage
from .joins import join_small


def extract_raw_links(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Absolute http(s) links of raw pages: (url, pos, link), duplicates kept.

    ``pos`` is the place among the kept links of the page, from 0. Page columns
    named in ``keep`` come along.
    """
    hrefs = pages.select(
        "url",
        *keep,
        url_parts("url").alias("base"),
        H.raw_hrefs(H.quiet_html("content")).alias("hrefs"),
    )
    links = F.filter(
        F.transform("hrefs", lambda h: resolve_against(F.col("base"), h)),
        lambda l: F.startswith(l, F.lit("http://")) | F.startswith(l, F.lit("https://")),
    )
    return hrefs.select("url", *keep, F.posexplode(links).alias("pos", "link"))


def html_only(fetches: DataFrame) -> DataFrame:
    """Successful fetches (status < 400) of content type text/html."""
    is_html = F.contains(
        F.lower(F.coalesce("content_type", F.lit(""))), F.lit("text/html")
    )
    return fetches.filter((F.col("status") < 400) & is_html)


def _unquote(path: Column) -> Column:
    """Percent-decoded text; ``+`` stays, broken escapes leave the text as it is."""
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.coalesce(decoded, path)


def robots_filter(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Urls their host's rules allow.

    ``rules``: (origin, rule_order, path_prefix, allow). The first rule whose path
    prefix fits decides; an empty prefix allows; no fitting rule allows.
    """
    path = F.substring(
        F.col("url"), F.length(origin("url")) + 1, F.length("url")
    )
    rooted = F.when(path == "", "/").otherwise(path)
    located = urls.withColumns({"_origin": origin("url"), "_path": _unquote(rooted)})
    # one row per host: its rules in order, as its robots file lists them
    rule = F.struct("rule_order", "path_prefix", "allow")
    hosts = rules.groupBy(F.col("origin").alias("_origin")).agg(
        F.sort_array(F.collect_list(rule)).alias("_rules")
    )
    judged = join_small(located, hosts, ["_origin"], how="left", spread=["url"])
    fitting = F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["path_prefix"]))
    first = F.get(fitting, F.lit(0))
    allowed = F.coalesce(first["allow"] | (first["path_prefix"] == ""), F.lit(True))
    return judged.filter(allowed).select(*urls.columns)


def link_edges(pages: DataFrame, visited: DataFrame) -> DataFrame:
    """Links not visited yet: (src_url, pos, link, link_depth).

    ``visited`` may be as large as the crawl, so it is not copied to salts: where
    one link holds many rows, adaptive execution splits the left side of the join.
    """
    links = extract_raw_links(pages, keep=("depth",))
    seen = visited.select(F.col("url").alias("link")).distinct()
    open_links = join_small(links, seen, ["link"], how="left_anti")
    return open_links.select(
        F.col("url").alias("src_url"), "pos", "link", (F.col("depth") + 1).alias("link_depth")
    )


def store_edges(edges: DataFrame, path: str, shards: int = 16) -> DataFrame:
    """Write ``edges`` (src, pos, dst) clustered by source; return them as a scan.

    Directories by hash of the source, sorted by source inside: a level of the frontier
    reads the directories of its own pages. A source with very many links spreads over
    several files of its directory.
    """
    rows, shard = add_shard(edges.select("src", "pos", "dst"), "src", shards), f"shard_{shards}"
    (
        rows.hint("rebalance", shard)
        .sortWithinPartitions(shard, "src", "pos")
        .write.partitionBy(shard)
        .parquet(path)
    )
    return edges.sparkSession.read.schema(rows.schema).parquet(path)


def _number_rows(df: DataFrame, order: list[str], start: int, name: str) -> tuple[DataFrame, int]:
    """``df`` written with ``crawl_seq``, a dense number in sort order, and its size.

    Numbers begin at ``start``. Range partitioning sorts the rows over all tasks; the
    number of a row is its place in its partition plus the sizes of the partitions
    before. Only those sizes, one per partition, are brought together.
    """
    placed = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33).cast("int"))
        .withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)),
        name,
    )
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before = [0]
    for part in range(max(sizes, default=-1) + 1):
        before.append(before[-1] + sizes.get(part, 0))
    offset = F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_part"))
    numbered = placed.withColumn("crawl_seq", offset + F.col("_at") + start)
    return numbered.drop("_id", "_part", "_at"), before[-1]


def crawl_frontier(
    seeds: DataFrame,
    edges: DataFrame,
    pages: DataFrame,
    max_pages: int = 100,
    max_depth: int = 3,
) -> DataFrame:
    """Breadth-first visit order: (url, depth, crawl_seq), crawl_seq from 1.

    ``seeds`` (url, seed_order), ``edges`` (src, pos, dst), ``pages`` (url): the
    fetchable ones. A page is visited once, at its smallest depth, in the order a
    first-in-first-out queue would reach it: by its earliest parent, then by link
    position. The visit ends after ``max_depth`` levels or ``max_pages`` pages.

    A few jobs per level; every level is written to the shared folder, so lineage
    does not grow with depth. Edges from ``store_edges`` are read by a level where its
    pages' links lie; others are read whole once per level.
    """
    fetchable = pages.select("url")
    found = seeds.groupBy("url").agg(
        F.min("seed_order").alias("_order"), F.lit(0).cast("long").alias("_pos")
    )
    levels, visited, count = [], None, 0
    for depth in range(max_depth + 1):
        # written once: the probe, the joins and the range sample all read it
        if visited is not None:
            found = found.join(visited, "url", "left_anti")
        found = stage(found, f"found-{depth}")
        candidates = join_small(fetchable, found, ["url"]).dropDuplicates(["url"])
        level, size = _number_rows(
            candidates, ["_order", "_pos", "url"], count + 1, f"level-{depth}"
        )
        level = level.select(
            "url", F.lit(depth).alias("depth"), F.col("crawl_seq").cast("long")
        ).filter(F.col("crawl_seq") <= max_pages)
        levels.append(level)
        count += size
        if size == 0 or count >= max_pages:
            break
        reached = level.select("url")
        visited = reached if visited is None else visited.unionByName(reached)
        # where a page has very many links, adaptive execution splits its edges
        parents = level.select(F.col("url").alias("src"), F.col("crawl_seq").alias("_order"))
        parents, shard = align_shards(edges, parents, "src")
        links = join_small(edges, parents, ["src", *shard], bound=found)
        # a popular target is reduced to its first link before the shuffle
        found = (
            links.groupBy(F.col("dst").alias("url"))
            .agg(F.min(F.struct("_order", F.col("pos").alias("_pos"))).alias("_first"))
            .select("url", "_first._order", "_first._pos")
        )
    result = levels[0]
    for level in levels[1:]:
        result = result.unionByName(level)
    return result
