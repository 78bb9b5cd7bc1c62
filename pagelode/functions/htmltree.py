"""Element-tree reading of a page, for markup that patterns cannot read.

One Arrow UDF returns all parsed fields; rows that do not need it pass null.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from .html import BOILERPLATE, CONTENT_CLASSES, VOID

PARSED = (
    "title string, meta_description string, content string, "
    "headings array<struct<level:int,text:string>>, "
    "links array<struct<href:string,text:string,title:string>>"
)

_CONTENT_CLASS = re.compile("|".join(CONTENT_CLASSES), re.I)
_SPACE = re.compile(r"\s+")


def _clean(chunks) -> str:
    return _SPACE.sub(" ", "".join(chunks)).strip()


class _PageReader(HTMLParser):
    """Collects text per wanted element while tags open and close."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = []  # (tag name, text chunks or None)
        self.hidden = 0  # open boilerplate elements
        self.titles, self.first_h1, self.bodies = [], [], []
        self.main, self.headings, self.links = [], [], []
        self.meta = None

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag == "meta" and self.meta is None and attrs.get("name") == "description":
            self.meta = attrs.get("content", "")
        if tag in VOID:
            return
        sinks = []

        def collect(into, *extra, whole_page=False):
            chunks = []
            into.append((chunks, *extra))
            sinks.append((chunks, whole_page))

        if tag == "title":
            collect(self.titles, whole_page=True)
        if tag == "h1":
            collect(self.first_h1, whole_page=True)
        if tag in BOILERPLATE:
            self.hidden += 1
        elif not self.hidden:
            if tag == "body":
                collect(self.bodies)
            if tag in ("main", "article", "div") and _CONTENT_CLASS.search(
                attrs.get("class", "")
            ):
                collect(self.main)
            if re.fullmatch("h[1-6]", tag):
                collect(self.headings, int(tag[1]))
            if tag == "a" and "href" in attrs:
                collect(self.links, attrs["href"], attrs.get("title", ""))
        self.open.append((tag, sinks))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID or all(name != tag for name, _ in self.open):
            return
        while self.open:
            name, _ = self.open.pop()
            self.hidden -= name in BOILERPLATE
            if name == tag:
                return

    def handle_data(self, data):
        if any(name in ("script", "style") for name, _ in self.open[-1:]):
            return
        for _, sinks in self.open:
            for chunks, whole_page in sinks:
                if whole_page or not self.hidden:
                    chunks.append(data)


def read_page(html: str) -> dict | None:
    """Parsed fields of one page, or None if it cannot be read."""
    reader = _PageReader()
    try:
        reader.feed(html)
        reader.close()
    except (AssertionError, ValueError):
        return None
    if reader.titles:
        title = _clean(reader.titles[0][0])
    elif reader.first_h1:
        title = _clean(reader.first_h1[0][0])
    else:
        title = "No Title"
    if reader.main:
        content = _clean(c for chunks, in reader.main for c in [*chunks, " "])
    else:
        content = _clean(reader.bodies[0][0]) if reader.bodies else ""
    headings = [{"level": n, "text": _clean(c)} for c, n in reader.headings]
    return {
        "title": title,
        "meta_description": _clean(reader.meta or ""),
        "content": content,
        "headings": sorted(headings, key=lambda h: h["level"]),
        "links": [{"href": h, "text": _clean(c), "title": t} for c, h, t in reader.links],
    }


def _read_pages(html: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys(["title", "meta_description", "content", "headings", "links"])
    rows = [(read_page(page) or empty) if page is not None else empty for page in html]
    return pd.DataFrame(rows, columns=list(empty))


def read_tree(html: Column) -> Column:
    """Struct of parsed fields; all null where ``html`` is null or unreadable.

    Declared nondeterministic so that filters on the result stay above it and the
    optimizer never evaluates it, or what feeds it, a second time.
    """
    return F.pandas_udf(_read_pages, PARSED).asNondeterministic()(html)


# Executors get this code inside the task and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
