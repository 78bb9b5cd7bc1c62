"""Relative reference resolution (RFC 3986) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let

# Schemes under which a relative reference is resolved.
RELATIVE_SCHEMES = [
    "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def url_parts(url: Column | str) -> Column:
    """Struct (raw, scheme, netloc, path, query, fragment); path keeps ``;x``."""
    raw = F.col(url) if isinstance(url, str) else url
    text = F.regexp_replace(
        F.regexp_replace(raw, r"^[\x{00}-\x{20}]+", ""), r"[\t\r\n]", ""
    )

    def split_rest(rest: Column) -> Column:
        before_fragment = F.substring_index(rest, "#", 1)
        before_query = F.substring_index(before_fragment, "?", 1)
        return F.struct(
            raw.alias("raw"),
            F.lower(F.regexp_extract(text, _SCHEME, 1)).alias("scheme"),
            F.regexp_extract(before_query, r"^//([^/]*)", 1).alias("netloc"),
            F.regexp_replace(before_query, r"^//[^/]*", "").alias("path"),
            F.regexp_extract(before_fragment, r"(?s)\?(.*)$", 1).alias("query"),
            F.regexp_extract(rest, r"(?s)#(.*)$", 1).alias("fragment"),
        )

    return let(F.regexp_replace(text, _SCHEME, ""), split_rest)


def origin(url: Column | str) -> Column:
    """``scheme://host`` of a url."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def _assemble(scheme, netloc, path, query, fragment) -> Column:
    def marked(mark: str, part: Column) -> Column:
        return let(part, lambda p: F.when(p != "", F.concat(F.lit(mark), p)).otherwise(""))

    rooted = F.regexp_replace(path, "(?s)^([^/])", "/$1")
    return F.concat(
        scheme, F.lit("://"), netloc, rooted, marked("?", query), marked("#", fragment)
    )


def _walk(segments: Column, relative: Column) -> Column:
    """Drop ``.`` / ``..`` segments, and empty inner ones of a merged path."""
    last = F.size(segments) - 1
    kept = F.filter(
        segments, lambda s, i: ~relative | (s != "") | (i == 0) | (i == last)
    )
    walked = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda done, s: F.when(
            s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        )
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    closing = F.when(
        F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))
    ).otherwise(F.array().cast("array<string>"))
    joined = F.array_join(F.concat(walked, closing), "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def _merge_paths(base_path: Column, path: Column) -> Column:
    relative = ~F.startswith(path, F.lit("/"))
    folder = F.regexp_extract(base_path, r"(?s)^(.*/)", 1)

    def normalize(merged: Column) -> Column:
        dotted = merged.rlike(r"(?:^|/)\.\.?(?:/|$)|//")
        walked = let(F.split(merged, "/"), lambda s: _walk(s, relative))
        return F.when(dotted, walked).otherwise(merged)

    return let(F.when(relative, F.concat(folder, path)).otherwise(path), normalize)


def _resolve(base: Column, ref: Column) -> Column:
    href, path = ref["raw"], ref["path"]
    scheme = F.when(ref["scheme"] == "", base["scheme"]).otherwise(ref["scheme"])
    same_host = ref["netloc"] == ""
    inherits = same_host & (path == "")
    target = _assemble(
        base["scheme"],
        F.when(same_host, base["netloc"]).otherwise(ref["netloc"]),
        F.when(inherits, base["path"])
        .when(same_host, _merge_paths(base["path"], path))
        .otherwise(path),
        F.when(inherits & (ref["query"] == ""), base["query"]).otherwise(ref["query"]),
        ref["fragment"],
    )
    return (
        F.when(F.coalesce(base["raw"], F.lit("")) == "", href)
        .when(href == "", base["raw"])
        .when((scheme != base["scheme"]) | ~scheme.isin(RELATIVE_SCHEMES), href)
        .otherwise(target)
    )


def resolve_against(base: Column, href: Column) -> Column:
    """Resolve ``href`` against a base already split by :func:`url_parts`."""
    return let(url_parts(href), lambda ref: _resolve(base, ref))


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of ``href`` found on the page ``base``."""
    ref = F.col(href) if isinstance(href, str) else href
    return let(url_parts(base), lambda parts: resolve_against(parts, ref))
