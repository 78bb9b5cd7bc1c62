"""Reading page HTML with column expressions.

All of this stays inside the JVM. Pages whose markup these patterns cannot read
exactly are recognised by :func:`needs_tree` and go through
:mod:`pagelode.functions.htmltree` instead.

Two derived texts are used throughout:

* *quiet* html: comments, scripts and styles removed, so no pattern can match
  inside them;
* *stripped* html: quiet html without navigation, header, footer and aside.

Quantifiers are possessive or lazy over a single character class, which Java
matches without recursion; long pages cannot overflow the stack.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import RARE_ENTITY, clean_text, decode_common_entities
from .urls import resolve_against

# Elements of one page that may stay open before the tree reads its main content.
MOST_OPEN = 500

# Elements without an end tag.
VOID = {
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr",
    "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid",
    "param", "source", "spacer", "track", "wbr",
}

# The inside of a tag up to its ">"; a ">" within quotes does not end it.
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
_END_OF_NAME = r"(?=[\s/>])"

# Elements that never hold page text.
BOILERPLATE = [
    "script", "style", "nav", "header", "footer", "aside",
]

# Class-name parts that mark a main-content element.
CONTENT_CLASSES = [
    "content", "main", "article", "body",
]

_SILENT = rf"(?is)<!--.*?-->|<(script|style){_END_OF_NAME}{_INSIDE}>.*?</\1\s*+>"
_BOILERPLATE = (
    rf"(?is)<!--.*?-->|<({'|'.join(BOILERPLATE)}){_END_OF_NAME}{_INSIDE}>.*?</\1\s*+>"
)
_ANY_TAG = rf"(?s)<(?:/?[A-Za-z]{_INSIDE}|[!?][^>]*+)>"
_ATTRIBUTE = (
    r"""[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+"""
)


def _all(html: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(f"({pattern})"), F.lit(1))


def quiet_html(html: Column | str) -> Column:
    """Html without comments, scripts and styles."""
    return F.regexp_replace(html, _SILENT, "")


def strip_boilerplate(html: Column | str) -> Column:
    """Html without script, style, nav, header, footer, aside and comments."""
    return F.regexp_replace(html, _BOILERPLATE, "")


def inner_text(fragment: Column) -> Column:
    """Text of an html fragment: tags dropped, entities decoded, cleaned."""
    return clean_text(decode_common_entities(F.regexp_replace(fragment, _ANY_TAG, "")))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a start tag; ``''`` if valueless, null if absent.

    The last of several equal names counts.
    """
    pairs = _all(F.regexp_replace(tag, r"^<[A-Za-z][^\s/>]*+", ""), _ATTRIBUTE)
    own = F.filter(pairs, lambda p: p.rlike(rf"(?i)^{name}\s*(?:=|$)"))
    value = F.regexp_extract(F.try_element_at(own, F.lit(-1)), r"(?s)=\s*(.*)$", 1)
    bare = F.regexp_replace(value, r"""(?s)^(?:"(.*)"|'(.*)')$""", "$1$2")
    return decode_common_entities(bare)


def extract_title(quiet: Column) -> Column:
    """First title, else first h1, else ``No Title``; an empty title stays."""

    def first(tag: str) -> Column:
        return F.regexp_extract(
            quiet, rf"(?is)<{tag}{_END_OF_NAME}{_INSIDE}>(.*?)</{tag}\s*+>", 1
        )

    return (
        F.when(quiet.rlike(r"(?i)<title[\s/>]"), inner_text(first("title")))
        .when(quiet.rlike(r"(?i)<h1[\s/>]"), inner_text(first("h1")))
        .otherwise("No Title")
    )


def extract_meta_description(quiet: Column) -> Column:
    """Content of the first meta tag named exactly ``description``, else ``''``."""
    metas = _all(quiet, rf"(?i)<meta{_END_OF_NAME}{_INSIDE}>")
    described = F.filter(metas, lambda m: attribute(m, "name") == "description")
    content = F.transform(
        described, lambda m: clean_text(F.coalesce(attribute(m, "content"), F.lit("")))
    )
    return F.coalesce(F.get(content, F.lit(0)), F.lit(""))


def body_text(stripped: Column) -> Column:
    """Text of the body element; an unclosed body runs to the end."""
    body = F.regexp_extract(
        stripped, rf"(?is)<body{_END_OF_NAME}{_INSIDE}>(.*?)(?:</body\s*+>|\z)", 1
    )
    return inner_text(body)


def _is_content(tag: Column) -> Column:
    """Whether a start tag opens a main-content element."""
    named = tag.rlike(rf"(?i)^<(?:main|article|div){_END_OF_NAME}")
    classes = F.coalesce(attribute(tag, "class"), F.lit(""))
    return F.when(named, classes.rlike(rf"(?i){'|'.join(CONTENT_CLASSES)}")).otherwise(False)


def has_content_class(stripped: Column) -> Column:
    """Whether any element is of a main-content class."""
    return F.exists(_all(stripped, rf"(?i)<(?:main|article|div)\s{_INSIDE}>"), _is_content)


def content_text(stripped: Column) -> Column:
    """Text of all main-content elements in order of their start, a space between them.

    A nested one stands in its outer one's text and once more for itself. One scan over
    the tags keeps the open elements: an end tag closes the last open element of its name
    and all that were opened inside it; one without such an element closes nothing; what
    is never closed runs to the end.
    """
    tags = _all(stripped, _ANY_TAG)
    pieces = F.split(stripped, _ANY_TAG)  # one more than tags
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([A-Za-z][^\s/>]*)", 1))
    marks = F.transform(
        tags,
        lambda t, i: F.struct(
            name(t).alias("name"),
            i.alias("at"),
            F.startswith(t, F.lit("</")).alias("closing"),
            F.endswith(t, F.lit("/>")).alias("empty"),
            _is_content(t).alias("content"),
        ),
    )
    elements = F.filter(
        marks, lambda m: (m["name"] != "") & ~m["name"].isin(sorted(VOID)) & (m["closing"] | ~m["empty"])
    )
    open_type = "array<struct<name:string,at:int,content:boolean>>"
    span_type = "array<struct<start:int,end:int>>"

    def spans(closed: Column, end: Column) -> Column:
        return F.transform(
            F.filter(closed, lambda o: o["content"]),
            lambda o: F.struct(o["at"].alias("start"), end.cast("int").alias("end")),
        )

    def step(state: Column, m: Column) -> Column:
        held = state["open"]
        from_end = F.array_position(F.reverse(F.transform(held, lambda o: o["name"])), m["name"])
        opened = F.struct(m["name"].alias("name"), m["at"].alias("at"), m["content"].alias("content"))
        kept = (F.size(held) - from_end).cast("int")

        return (
            F.when(
                ~m["closing"],
                F.struct(F.concat(held, F.array(opened)).alias("open"), state["spans"].alias("spans")),
            )
            .when(from_end == 0, state)
            .otherwise(
                F.struct(
                    F.slice(held, 1, kept).alias("open"),
                    F.concat(
                        state["spans"], spans(F.slice(held, kept + 1, F.size(held)), m["at"])
                    ).alias("spans"),
                )
            )
        )

    start = F.struct(
        F.array().cast(open_type).alias("open"), F.array().cast(span_type).alias("spans")
    )
    found = F.aggregate(
        elements,
        start,
        step,
        lambda state: F.sort_array(F.concat(state["spans"], spans(state["open"], F.size(tags)))),
    )
    texts = F.transform(
        found, lambda s: F.array_join(F.slice(pieces, s["start"] + 2, s["end"] - s["start"]), "")
    )
    return clean_text(decode_common_entities(F.array_join(texts, " ")))


def heading_elements(stripped: Column) -> Column:
    """Whole heading elements in document order."""
    return F.regexp_extract_all(
        stripped,
        F.lit(rf"(?is)(<(h[1-6]){_END_OF_NAME}{_INSIDE}>.*?</\2\s*+>)"),
        F.lit(1),
    )


def anchor_elements(stripped: Column) -> Column:
    """Whole anchor elements in document order."""
    return _all(stripped, rf"(?is)<a{_END_OF_NAME}{_INSIDE}>.*?</a\s*+>")


def headings_from(elements: Column) -> Column:
    """Array of (level, text): all h1 first, then h2, ...; document order within."""
    keyed = F.transform(
        elements,
        lambda e, i: F.struct(
            F.substring(e, 3, 1).cast("int").alias("level"),
            i.alias("at"),
            inner_text(e).alias("text"),
        ),
    )
    return F.transform(
        F.sort_array(keyed), lambda h: F.struct(h["level"], h["text"])
    )


def links_from(elements: Column) -> Column:
    """Array of (href, text, title) for anchors that carry an href."""

    def read(element: Column) -> Column:
        tag = F.regexp_extract(element, rf"(?s)^<{_INSIDE}>", 0)
        return F.struct(
            attribute(tag, "href").alias("href"),
            inner_text(element).alias("text"),
            F.coalesce(attribute(tag, "title"), F.lit("")).alias("title"),
        )

    return F.filter(F.transform(elements, read), lambda a: a["href"].isNotNull())


def resolve_links(links: Column, base: Column) -> Column:
    """Array of (url, text, title) from (href, text, title)."""
    return F.transform(
        links,
        lambda a: F.struct(
            resolve_against(base, a["href"]).alias("url"), a["text"], a["title"]
        ),
    )


def raw_hrefs(quiet: Column) -> Column:
    """Href of every anchor start tag, in document order."""
    tags = _all(quiet, rf"(?i)<a{_END_OF_NAME}{_INSIDE}>")
    return F.filter(
        F.transform(tags, lambda t: attribute(t, "href")), lambda h: h.isNotNull()
    )


def needs_tree(
    quiet: Column, stripped: Column, headings: Column, anchors: Column
) -> Column:
    """True where the patterns above may differ from a real element tree.

    That is: a boilerplate tag left over because it is nested or never closed, a
    heading or anchor that is nested or never closed, an unclosed title, or an entity
    outside the common ones. Main-content elements are read here, unless so many
    elements stay open that keeping them would cost more than the tree.
    """
    starts = F.regexp_count(stripped, F.lit("<[A-Za-z]"))
    ends = F.regexp_count(stripped, F.lit("</[A-Za-z]"))
    left_over = rf"(?i)</?(?:{'|'.join(BOILERPLATE)})[\s/>]"
    opened = F.regexp_count(stripped, F.lit(r"(?i)<(?:h[1-6]|a)[\s/>]"))
    titles = F.regexp_count(quiet, F.lit(r"(?i)<title[\s/>]"))
    closed_titles = F.regexp_count(quiet, F.lit(r"(?i)</title\s*>"))
    return (
        (opened != F.size(headings) + F.size(anchors))
        | (titles != closed_titles)
        | stripped.rlike(left_over)
        | ((starts - ends > MOST_OPEN) & has_content_class(stripped))
        | quiet.rlike(RARE_ENTITY)
    )
