"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with the path of block elements above
it. Length and punctuation are added up per path and divided by its blocks, link text
counts against the path, and the two ratios are fused into one score. Scores are
smoothed with the scores of the containers above, so a heading or a one-word paragraph beside
long ones stands with them. Paths at or above a share of the best one are content.
Elements that by name, class, id or role are no article text never enter; the page, its
body, main and article elements are never left out by a class, id or role. A name that
only has such a word as a part lowers the score of what it holds. Text inside and
outside of article elements is scored alike; headings right before content go with it.

Each page is read alone inside a map, so nothing is shuffled and pages of any length,
host or number of copies cost what their length costs.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import free_name, text_or_empty

#: Elements by how they take part.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
RAW = ["script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math"]
BLOCKS = [
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hgroup", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
]
NOT_TEXT = ["aside", "button", "dialog", "footer", "form", "head", "input", "menu", "nav", "object", "search", "select", "option"]
#: Whole words of class, id and role that mark notices, menus and the like.
NOT_TEXT_NAMES = [
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb",
    "breadcrumbs", "comment", "comments", "commentlist", "consent", "contentinfo", "cookie", "cookies", "discussion",
    "disqus", "footer", "gdpr", "hidden", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notification", "pager", "pagination", "popup", "promo", "promoted", "promotion", "related",
    "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "topbar", "widget",
]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
#: An open element of the first kind ends where one of the second kind begins.
CLOSED_BY = {
    "p": set(BLOCKS), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"}, "head": {"body"},
}
#: Containers above a path that lend it their score; the share left is tiny by then.
LEVELS = 24
_VOID, _RAW, _BLOCKS, _NOT_TEXT = map(frozenset, (VOID, RAW, BLOCKS, NOT_TEXT))
_NAMES = frozenset(NOT_TEXT_NAMES)

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]{0,9999}+\"|'[^']{0,9999}+'){0,200}+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",  # quotes that never close
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NAMING = frozenset(["class", "id", "role"])
_PLAIN = re.compile(r"[^>\"']*")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Elements that hold the story: their class, id or role tells nothing against it.
_KEPT = frozenset(["html", "body", "main", "article"])
_PART = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？…]")


@dataclass(frozen=True)
class PathRules:
    """Weights of the method."""

    smooth: float = 0.7  # what is left of a container's score one level below it
    threshold: float = 0.2  # share of the best path's smoothed score
    suspect: float = 0.15  # what is left of a score below a name with a part from NOT_TEXT_NAMES
    link_share: float = 0.6  # paths with more of their text in links are no content


@dataclass
class Block:
    path: int
    text: str
    links: int
    heading: str = ""  # h1 to h6
    article: int = 0  # number of the article or main element around it


def _naming(attributes: str) -> list[str]:
    """Values of class, id and role; attributes whose name merely ends so do not count."""
    if not attributes or "=" not in attributes:
        return []
    return ["".join(v) for n, *v in _ATTRIBUTE.findall(attributes) if n.lower() in _NAMING]


def _tag_end(page: str, at: int, failed: set[int]) -> int | None:
    """Where the tag ends whose attributes begin at ``at``; None if a quote never closes.

    For tags beyond the bounds of ``_MARKUP``. ``failed`` has the places of quotes from
    which no end was reached before, so that all calls for a page take linear time.
    """
    seen = []
    while True:
        at = _PLAIN.match(page, at).end()
        if at >= len(page) or at in failed:
            failed.update(seen)
            return None
        if page[at] == ">":
            return at + 1
        seen.append(at)
        close = page.find(page[at], at + 1)
        if close < 0:
            failed.update(seen)
            return None
        at = close + 1


def _excluded(name: str, attributes: str, inside_article: bool) -> bool:
    if name in _NOT_TEXT or (name == "header" and not inside_article):
        return True
    if not attributes:
        return False
    told = attributes
    if name in _KEPT:  # what its class, id or role says is no hint
        told = _ATTRIBUTE.sub(lambda m: "" if m[1].lower() in _NAMING else m[0], attributes)
    if _HIDDEN.search(told):
        return True
    if name in _KEPT:
        return False
    for value in _naming(attributes):
        for word in value.split():
            if word.lower() in _NAMES:
                return True
            if word.lower() in ("header", "site-header", "page-header") and not inside_article:
                return True
    return False


def _suspect(name: str, attributes: str) -> bool:
    """Whether a class, id or role has a part that marks notices, menus and the like."""
    if not attributes or name in _KEPT:
        return False
    return any(p.lower() in _NAMES for value in _naming(attributes) for p in _PART.findall(value))


class Paths:
    """Tag paths as numbers: each is its container's number and one more label."""

    def __init__(self):
        self.numbers, self.above, self.top, self.suspect = {}, [-1], [True], [False]

    def below(self, container: int, label: str, suspect: bool = False) -> int:
        key = (container, label, suspect)
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.above)
            self.above.append(container)
            self.top.append(label.split(".")[0] in ("html", "body"))
            self.suspect.append(suspect or self.suspect[container])
        return found

    def containers(self, path: int):
        """Containers below the page's own level, nearest first."""
        path = self.above[path]
        for _ in range(LEVELS):
            if self.top[path]:
                return
            yield path
            path = self.above[path]


def read_blocks(page: str) -> tuple[list[Block], Paths]:
    """Text blocks of a page in order, without elements that hold no article text."""
    open_names: list[str] = []
    dropped: list[bool] = []  # whether the element or one above it is excluded
    at_path: list[int] = []
    at_article: list[int] = []
    n_articles = 0
    paths = Paths()
    blocks: list[Block] = []
    pieces: list[str] = []
    linked = articles = links = 0

    def finish() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            heading = next((n for n in reversed(open_names) if n in _BLOCKS), "")
            heading = heading if heading in HEADINGS else ""
            path, article = (at_path[-1], at_article[-1]) if at_path else (0, 0)
            blocks.append(Block(path, text, min(linked, len(text)), heading, article))
        pieces.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal articles, links
        while len(open_names) > to:
            name = open_names[-1]
            if name in _BLOCKS:
                finish()
            articles -= name in ("article", "main")
            links -= name == "a"
            open_names.pop()
            dropped.pop()
            at_path.pop()
            at_article.pop()

    def add(text: str) -> None:
        nonlocal linked
        if text and not (dropped and dropped[-1]):
            pieces.append(text)
            if links:
                linked += len(text.strip())

    failed: set[int] = set()
    at, last = 0, max(page.rfind(">"), page.rfind("<!"))
    while True:
        found = _MARKUP.search(page, at) if at <= last else None
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        slash, tag, attributes = found[1], found[2], found[3]
        if tag is None:
            slash, tag, attributes = found[4], found[5], found[6]
            if tag:
                end = _tag_end(page, found.end(5), failed)
                if end is not None:
                    attributes, at = page[found.end(5) : end - 1], end
        name = (tag or "").lower()
        if not name:
            continue
        if slash:  # an end tag closes down to its element, if there is one
            if name == "br" or name == "p" and "p" not in open_names:
                add(" ")
            elif name in open_names:
                close(len(open_names) - 1 - open_names[::-1].index(name))
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if not attributes.rstrip().endswith("/"):
                at = end.end() if end else len(page)
            add(" ")
            continue
        if name in _VOID:
            if name == "hr":
                finish()
            add(" ")
            continue
        if name in _BLOCKS or name == "option":
            at_most = len(open_names)
            for k in range(len(open_names) - 1, -1, -1):
                if name in CLOSED_BY.get(open_names[k], ()):
                    at_most = k
                elif open_names[k] in _BLOCKS:
                    break
            close(at_most)
        if name in _BLOCKS:
            finish()
        articles += name in ("article", "main")
        links += name == "a"
        out = bool(dropped and dropped[-1]) or _excluded(name, attributes, articles > 0)
        open_names.append(name)
        dropped.append(out)
        path = at_path[-1] if at_path else 0
        if name in _BLOCKS:
            named = _naming(attributes)
            label = f"{name}.{named[0]}" if named else name
            path = paths.below(path, label, _suspect(name, attributes))
        at_path.append(path)
        if name in ("article", "main"):
            n_articles += 1
            at_article.append(n_articles)
        else:
            at_article.append(at_article[-1] if at_article else 0)
    finish()
    close(0)
    return blocks, paths


def choose(blocks: list[Block], paths: Paths, rules: PathRules) -> list[str]:
    """Texts of the blocks on content paths."""
    own = defaultdict(lambda: [0, 0, 0, 0])
    for b in blocks:
        figures = (len(b.text), len(_PUNCTUATION.findall(b.text)), b.links, 1)
        own[b.path] = [x + y for x, y in zip(own[b.path], figures, strict=True)]
    inside = defaultdict(lambda: [0, 0, 0, 0])  # of a container with all below it
    for path, figures in own.items():
        for up in paths.containers(path):
            inside[up] = [x + y for x, y in zip(inside[up], figures, strict=True)]

    def fused(chars: int, marks: int, links: int, n: int) -> float:
        return (chars - links) / n * (1 + math.log1p(marks / n))

    scores = {}
    for path, figures in own.items():
        score, weight = fused(*figures), 1.0
        for up in paths.containers(path):
            weight *= rules.smooth
            score = max(score, weight * fused(*inside[up]))
        scores[path] = score * rules.suspect if paths.suspect[path] else score
    best = max(scores.values(), default=0)
    good = {
        p
        for p, score in scores.items()
        if score >= rules.threshold * best and own[p][2] <= rules.link_share * own[p][0]
    }
    kept = [b.path in good for b in blocks]
    # what stands between two kept blocks of one article belongs to it, however short
    ends: dict[int, list[int]] = defaultdict(list)
    for k, b in enumerate(blocks):
        if kept[k] and b.article:
            ends[b.article].append(k)
    for article, places in ends.items():
        for k in range(places[0], places[-1]):
            b = blocks[k]
            if b.article == article and not paths.suspect[b.path]:
                kept[k] = kept[k] or b.links <= rules.link_share * len(b.text)
    first = next((k for k, x in enumerate(kept) if x), 0)
    titles = [k for k in range(first) if blocks[k].heading == "h1" and not paths.suspect[blocks[k].path]]
    if titles and not any(blocks[k].heading == "h1" and kept[k] for k in range(len(blocks))):
        kept[titles[-1]] = True  # the headline, whatever stands between
    for k in range(len(blocks) - 2, -1, -1):
        kept[k] = kept[k] or bool(blocks[k].heading and kept[k + 1] and not paths.suspect[blocks[k].path])
    return [b.text for b, x in zip(blocks, kept, strict=True) if x]


def main_text(page: str | None, rules: PathRules = PathRules()) -> str:
    """Main text of one page; empty for null, empty and text-free pages."""
    return "\n\n".join(choose(*read_blocks(page), rules)) if page else ""


def extract_text(
    pages: DataFrame, column: str = "html", out: str = "text", rules: PathRules = PathRules()
) -> DataFrame:
    """``pages`` without ``column``, with the main text of each page in ``out``.

    Null and empty pages give an empty text. Rows are read one by one, so repeated rows
    stay repeated. Other columns stay; one of the name ``out`` is replaced.
    """
    kept = [c for c in pages.columns if c not in (column, out)]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(page, rules) for page in batch.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, out]
            )

    carried = free_name("_page", kept)
    source = pages.select(*kept, text_or_empty(column).alias(carried))
    return source.mapInArrow(run, schema)
