"""The registered queries once more, as SQL over the same tables.

Written for DuckDB, whose regular expressions are RE2. Shared inputs are common
table expressions; ``_sql`` puts those a query needs in front of it.
"""

from __future__ import annotations

from ..functions.scores import DEFAULT_WEIGHTS
from ..functions.stem import STEP_2, STEP_3, STEP_4
from ..functions.text import COMMON_ENTITIES, STOP_WORDS, WHITESPACE, WORD
from .views import AS_OF, FIRST_CRAWL

_TOKEN = rf"[{WORD}]+(?:\.[{WORD}]+)*"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_PARTS = (
    "title_score content_score meta_score heading_score url_score "
    "freshness_score content_length_score depth_penalty"
).split()


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WHITESPACE}]+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WHITESPACE}]+'), lambda w: w <> '')"


def _decode(x: str) -> str:
    for entity, char in COMMON_ENTITIES.items():
        quoted = char.replace("'", "''")
        x = f"replace({x}, '{entity}', '{quoted}')"
    return x


def _inner(x: str) -> str:
    return _clean(_decode(f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"))


def _drop(x: str, *tags: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for tag in tags:
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    return x


def _quiet(x: str) -> str:
    return _drop(x, "script", "style")


def _stripped(x: str) -> str:
    return _drop(x, "script", "style", "nav", "header", "footer", "aside")


def _title(html: str) -> str:
    quiet = _quiet(html)
    first = "regexp_extract({}, '(?is)<{}[^>]*>(.*?)</{}>', 1)"
    return f"""CASE WHEN regexp_matches({quiet}, '(?i)<title')
        THEN {_inner(first.format(quiet, 'title', 'title'))}
        WHEN regexp_matches({quiet}, '(?i)<h1')
        THEN {_inner(first.format(quiet, 'h1', 'h1'))} ELSE 'No Title' END"""


def _meta(html: str) -> str:
    found = f"""regexp_extract({_quiet(html)},
        '(?i)<meta name="description" content="([^"]*)">', 1)"""
    return _clean(_decode(found))


def _body(html: str) -> str:
    body = rf"regexp_extract({_stripped(html)}, '(?is)<body[^>]*>(.*?)(?:</body>|\z)', 1)"
    return _inner(body)


def _origin(url: str) -> str:
    return f"regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"


def _resolve(url: str, href: str) -> str:
    """Enough for the hrefs in the test pages: rooted, relative to the folder, mailto."""
    path = f"regexp_replace(substr({url}, length({_origin(url)}) + 1), '[?#].*$', '')"
    return f"""CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href}
        WHEN starts_with({href}, '/') THEN {_origin(url)} || {href}
        ELSE {_origin(url)} || regexp_extract({path}, '^(.*/)', 1) || {href} END"""


def _tokens(x: str) -> str:
    return f"""list_filter(regexp_extract_all(lower({x}), '{_TOKEN}'),
        lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w))"""


def _query_clean(x: str) -> str:
    kept = f"[^{WORD}{WHITESPACE}\"''+\\-*()]"
    return _clean(f"regexp_replace({x}, '{kept}', ' ', 'g')")


def _snippet(x: str) -> str:
    return f"CASE WHEN length({x}) > 300 THEN substr({x}, 1, 300) || '...' ELSE {x} END"


def _field_score(terms: str, text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    return f"""CASE WHEN {t} = '' THEN 0.0 ELSE coalesce(list_sum(list_transform({terms},
        lambda w: CASE WHEN w = {t} THEN 10.0
          WHEN contains(' ' || {t} || ' ', ' ' || w || ' ') THEN 5.0
          WHEN contains({t}, w) THEN 2.0 ELSE 0.0 END)), 0.0) END"""


def _count(text: str, term: str) -> str:
    return (
        f"((length(lower({text})) - length(replace(lower({text}), {term}, '')))"
        f"::DOUBLE / length({term}))"
    )


_LENGTH_SCORE = """CASE WHEN content_length IS NULL OR content_length = 0 THEN 0.0
    WHEN content_length < 100 THEN 0.1 WHEN content_length > 10000 THEN 0.3
    ELSE exp(-pow((content_length - 1500) / 750.0, 2) / 2.0) END"""
_FRESHNESS = f"exp(-(({AS_OF} - crawl_seconds) / 86400.0) / 30.0)"

_CTES = {
    "fetches": f"""SELECT page_id, url, html AS content,
        CASE WHEN ends_with(url, '/') THEN 404 ELSE 200 END AS status,
        CASE WHEN contains(url, 'utm_source') THEN 'application/pdf'
             ELSE 'Text/HTML; charset=utf-8' END AS content_type,
        len(str_split(url, '/')) - 3 AS depth,
        {FIRST_CRAWL}::DOUBLE + page_id * 3600 AS crawl_time FROM pages""",
    "rich": """SELECT * REPLACE (replace(replace(content, '<head>',
          '<head><meta name="description" content="' || array_to_string(str_split(
            replace(regexp_extract(content, '<h1>([^<]*)', 1), '"', ''), ' ')[1:5], ' ')
          || '">'),
        '</article>', '<h3>Part three of ' || page_id || '</h3><h2>Part <i>' || page_id
          || '</i></h2><a href="up/' || page_id
          || '?v=1" title="Up &amp; over">Go <b>up</b></a>'
          || '<a href="mailto:x@example.org">Mail</a></article>') AS content) FROM fetches""",
    "page_docs": f"""SELECT url, title, meta_description, content, headings, anchors,
          length(content) AS content_length, crawl_time, depth FROM (
        SELECT url, {_title('content')} AS title, {_meta('content')} AS meta_description,
          {_body('content')} AS content, crawl_time, depth,
          list_filter(flatten([{", ".join(
            "list_transform(regexp_extract_all(stripped, "
            f"'(?is)<h{n}[^>]*>(.*?)</h{n}>', 1), lambda h: "
            f"{{'level': {n}, 'text': {_inner('h')}}})" for n in range(1, 7))}]),
            lambda h: true) AS headings,
          regexp_extract_all(stripped, '(?is)<a [^>]*>.*?</a>') AS anchors
        FROM (SELECT *, {_stripped('content')} AS stripped FROM rich))""",
    "text_docs": f"""SELECT 'https://' || source || '.example.com/' || lang || '/' || doc_id
          AS url, {_clean("str_split(text, chr(10))[1]")} AS title,
        {_clean('text')} AS content,
        {_clean("coalesce(str_split(text, chr(10))[2], '')")} AS meta_description,
        '' AS headings, length({_clean('text')}) AS content_length,
        {FIRST_CRAWL} + doc_id % 365 * 86400 AS crawl_seconds, doc_id % 5 AS depth
        FROM documents""",
    "queries": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "prefixes": "SELECT item_id AS query_id, lower(substr(text, 1, 3)) AS prefix FROM benchmark",
    "updates": f"""SELECT * REPLACE ('Updated ' || title AS title) FROM text_docs
        WHERE contains(url, '/en/')
        UNION ALL SELECT 'https://new.example.com/' || item_id, 'New', {_clean('text')}, '', '',
        length({_clean('text')}), {FIRST_CRAWL}, 0 FROM benchmark""",
    "robots": f"""SELECT origin, rule_order, path_prefix, allow FROM (
        SELECT {_origin('url')} AS origin, count(*) AS n FROM pages GROUP BY 1),
        (VALUES (0, '/es/', true), (1, '/es/', false), (2, '/fr/', false))
          r(rule_order, path_prefix, allow)
        WHERE (rule_order = 0 AND n > 1) OR rule_order = 1
          OR (rule_order = 2 AND starts_with(origin, 'http://'))""",
    "links": f"""SELECT url, depth, pos, link FROM (
        SELECT url, depth, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS pos
        FROM (SELECT url, depth, list_filter(list_transform(
          regexp_extract_all({_quiet('content')}, '(?i)<a href="([^"]*)"', 1),
          lambda h: {_resolve('url', _decode('h'))}),
          lambda l: starts_with(l, 'http://') OR starts_with(l, 'https://')) AS links
          FROM fetches))""",
    "field_tokens": f"""SELECT url, field, {_tokens('text')} AS terms FROM (
        SELECT url, 'title' AS field, title AS text FROM text_docs UNION ALL
        SELECT url, 'content', content FROM text_docs UNION ALL
        SELECT url, 'meta_description', meta_description FROM text_docs UNION ALL
        SELECT url, 'headings', headings FROM text_docs)""",
    "tokens": """SELECT url, field, unnest(terms) AS term,
        generate_subscripts(terms, 1) - 1 AS pos, len(terms) AS field_len FROM field_tokens""",
    "postings": """SELECT field, term, url, count(*) AS tf, any_value(field_len) AS field_len
        FROM tokens GROUP BY field, term, url""",
    "term_df": "SELECT field, term, count(*) AS df FROM postings GROUP BY field, term",
    "field_len": """SELECT field, count(*) AS n_docs, avg(len(terms)) AS avg_len
        FROM field_tokens GROUP BY field""",
    "query_words": f"""SELECT query_id, {_tokens(_query_clean('query'))} AS words FROM queries""",
    "query_terms": """SELECT query_id, len(list_distinct(words)) AS n_terms,
        unnest(list_distinct(words)) AS term, words[1] AS first_word FROM query_words""",
    "matches": """SELECT q.query_id, q.n_terms, q.term, q.first_word, p.field, p.url, p.tf,
        p.field_len FROM postings p JOIN query_terms q ON p.term = q.term""",
    "shares": """SELECT query_id, n_terms, m.term, url,
        (ln(n_docs / (df + 1)) + 1) * tf * 2.2
          / (tf + 1.2 * (0.25 + 0.75 * m.field_len / avg_len)) AS share
        FROM matches m JOIN term_df d ON m.field = d.field AND m.term = d.term
        JOIN field_len f ON f.field = m.field""",
    "bm25_any": """SELECT query_id, url, round(sum(share), 6) AS score FROM shares
        GROUP BY query_id, url""",
    "bm25_all": """SELECT query_id, url, round(sum(share), 6) AS score FROM shares
        GROUP BY query_id, n_terms, url HAVING count(DISTINCT term) = n_terms""",
    "top_any": """SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, url) AS rank FROM bm25_any
        QUALIFY rank <= 10""",
    "cand_any": """SELECT * FROM bm25_any QUALIFY row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, url) <= 20""",
    "cand_page": """SELECT * FROM bm25_any QUALIFY row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, url) <= 40""",
    "top_all": """SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, url) AS rank FROM bm25_all
        QUALIFY rank <= 20""",
    "raw_words": f"SELECT query_id, {_words('lower(query)')} AS terms FROM queries",
}


def _ranking(source: str, weights: dict | None = None, whole: bool = False) -> str:
    """Ranked candidates of the scored rows in ``source``, by snippet or whole content."""
    text = "content" if whole else _snippet("content")
    w = {**DEFAULT_WEIGHTS, **(weights or {})}
    found = "instr(lower(content), t.term) - 1"
    return f"""cands AS (SELECT b.query_id, b.score, d.url, title,
          {text} AS content, meta_description, content_length,
          crawl_seconds, depth FROM {source} b JOIN text_docs d ON b.url = d.url),
        worded AS (SELECT c.*, r.terms FROM cands c JOIN raw_words r USING (query_id)),
        per_term AS (SELECT query_id, url, unnest(terms) AS term,
          generate_subscripts(terms, 1) AS pos, content FROM worded),
        corpus AS (SELECT query_id, pos, any_value(term) AS term, count(*) AS n_docs,
          sum(contains(lower(content), term)::INT)::BIGINT AS df
          FROM per_term GROUP BY query_id, pos),
        figures AS (SELECT t.query_id, t.url, t.pos, t.term, n_docs, df,
          {_count('content', 't.term')} AS n,
          {_count('content', 't.term')} / nullif(len({_words('content')}), 0) AS tf,
          ln(n_docs / (df + 1)) AS idf,
          CASE WHEN {found} >= 0 THEN 1.0 - ({found}) / length(content) * 0.5
               ELSE 1.0 END AS bonus
          FROM per_term t JOIN corpus c ON c.query_id = t.query_id AND c.pos = t.pos),
        content_scores AS (SELECT query_id, url, sum(n * (tf * idf) * bonus) AS content_score
          FROM figures GROUP BY query_id, url),
        parts AS (SELECT w.*, {_field_score('terms', 'title')} AS title_score,
          coalesce(s.content_score, 0.0) AS content_score,
          {_field_score('terms', 'meta_description')} AS meta_score, 0.0 AS heading_score,
          len(list_filter(terms, lambda t: contains(lower(w.url), t)))::DOUBLE AS url_score,
          {_FRESHNESS} AS freshness_score, {_LENGTH_SCORE} AS content_length_score,
          depth * 0.1::DOUBLE AS depth_penalty
          FROM worded w LEFT JOIN content_scores s
            ON s.query_id = w.query_id AND s.url = w.url),
        ranked AS (SELECT *, round(title_score * {w['title_match']}
          + content_score * {w['content_match']}
          + meta_score * {w['meta_description_match']}
          + heading_score * {w['heading_match']} + url_score * {w['url_match']}
          + freshness_score * {w['freshness']}
          + content_length_score * {w['content_length']}
          - depth_penalty * {abs(w['depth_penalty'])} + score, 6) AS ranking_score FROM parts),
        placed AS (SELECT *, row_number() OVER (PARTITION BY query_id
          ORDER BY ranking_score DESC, score DESC, url) AS rank FROM ranked)"""


_NEEDS = {
    "rich": ["fetches"],
    "page_docs": ["rich"],
    "updates": ["text_docs"],
    "links": ["fetches"],
    "field_tokens": ["text_docs"],
    "tokens": ["field_tokens"],
    "postings": ["tokens"],
    "term_df": ["postings"],
    "field_len": ["field_tokens"],
    "query_words": ["queries"],
    "query_terms": ["query_words"],
    "matches": ["postings", "query_terms"],
    "shares": ["matches", "term_df", "field_len"],
    "bm25_any": ["shares"],
    "bm25_all": ["shares"],
    "top_any": ["bm25_any"],
    "cand_any": ["bm25_any"],
    "cand_page": ["bm25_any"],
    "top_all": ["bm25_all"],
    "raw_words": ["queries"],
}


def _sql(needs: str, select: str, extra: str = "") -> str:
    wanted = set()

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        wanted.add(name)

    for name in needs.split():
        add(name)
    # scored postings are read several times: compute them once
    stored = {"postings", "field_tokens", "bm25_any", "bm25_all", "cand_any", "page_docs"}
    parts = [
        f"{name} AS {'MATERIALIZED ' if name in stored else ''}({body})"
        for name, body in _CTES.items()
        if name in wanted
    ]
    if extra:
        parts.append(extra)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


def _rank_sql(
    select: str, source: str = "cand_any", weights: dict | None = None, whole: bool = False
) -> str:
    return _sql(f"{source} text_docs raw_words", select, _ranking(source, weights, whole))


_BREAKDOWN = ", ".join(f"round({p}, 6) AS {p}" for p in _PARTS)


def _frontier() -> str:
    """Breadth-first levels 0 to 3, written out one after the other."""
    site = "'https://site.example/' || "
    levels = f"""
      edges AS (SELECT {site}o_custkey AS src, o_orderkey AS pos,
        {site}(o_orderkey * 7919 % (SELECT count(*) FROM customer)) AS dst FROM orders),
      pages_ok AS (SELECT {site}c_custkey AS url FROM customer WHERE c_acctbal >= 0),
      seeds AS (SELECT {site}min(c_custkey) AS url, min(c_custkey) AS seed_order
        FROM customer GROUP BY c_nationkey),
      cap AS (SELECT count(*) * 2 // 3 AS n FROM customer),
      level0 AS (SELECT url, 0 AS depth, row_number() OVER (ORDER BY seed_order, url)
        AS crawl_seq FROM seeds SEMI JOIN pages_ok USING (url)),
      seen0 AS (SELECT * FROM level0 WHERE crawl_seq <= (SELECT n FROM cap))"""
    for d in (1, 2, 3):
        levels += f""",
      first{d} AS (SELECT dst AS url, min(struct_pack(o := crawl_seq, p := pos)) AS f
        FROM edges JOIN seen{d - 1} s ON s.url = src AND s.depth = {d - 1} GROUP BY dst),
      level{d} AS (SELECT url, {d} AS depth, row_number() OVER (ORDER BY f.o, f.p, url)
          + (SELECT count(*) FROM seen{d - 1}) AS crawl_seq
        FROM first{d} SEMI JOIN pages_ok USING (url)
        ANTI JOIN seen{d - 1} USING (url)),
      seen{d} AS (SELECT * FROM seen{d - 1} UNION ALL SELECT * FROM level{d}
        WHERE crawl_seq <= (SELECT n FROM cap))"""
    return f"WITH {levels} SELECT url, depth, crawl_seq FROM seen3"


def _fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {x})"


_DESCRIBED = "meta_description <> ''"

ORACLES = {
    # sources and sinks
    "page_scan": """SELECT url, md5(html) AS content_md5, 0 AS depth, 0.0::DOUBLE AS crawl_time
        FROM pages""",
    "seed_scan": f"""SELECT doc_id, unnest(lines) AS seed_url,
        generate_subscripts(lines, 1) - 1 AS seed_order FROM (SELECT doc_id, list_filter(
          list_transform(str_split(text, chr(10)), lambda l: regexp_replace(l,
            '^[{WHITESPACE}]+|[{WHITESPACE}]+$', '', 'g')), lambda l: l <> '') AS lines
        FROM documents)""",
    "document_append": _sql("text_docs", """SELECT url, title, meta_description,
        md5(content) AS content_md5, headings, content_length, crawl_seconds, depth
        FROM text_docs"""),
    "search_envelope": _rank_sql(f"""SELECT q.query_id, any_value(trim(regexp_replace(q.query,
          '[{WHITESPACE}]+', ' ', 'g'))) AS query,
        string_agg(p.url, ' ' ORDER BY rank) AS urls, count(p.url) AS total,
        NULL::VARCHAR AS error
        FROM queries q LEFT JOIN placed p ON p.query_id = q.query_id AND rank <= 10
        GROUP BY q.query_id"""),
    # crawl
    "url_resolve": _sql("rich", f"""SELECT url, pos, href, {_resolve('url', 'href')} AS link
        FROM (SELECT url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos
        FROM (SELECT url, list_transform(regexp_extract_all({_quiet('content')},
          '(?i)<a href="([^"]*)"', 1), lambda h: {_decode('h')}) AS hrefs FROM rich))"""),
    "raw_links": _sql("links", "SELECT url, pos, link FROM links"),
    "fetch_filter": _sql("fetches", """SELECT url, status, content_type FROM fetches
        WHERE status < 400 AND contains(lower(content_type), 'text/html')"""),
    "robots_filter": _sql("robots", f"""SELECT url FROM pages p WHERE coalesce((
        SELECT arg_min(allow, rule_order) FROM robots r WHERE r.origin = {_origin('p.url')}
          AND starts_with(substr(p.url, length(r.origin) + 1), path_prefix)), true)"""),
    "link_edges": _sql("links", """SELECT url AS src_url, pos, link, depth + 1 AS link_depth
        FROM links WHERE link NOT IN
        (SELECT link FROM links GROUP BY link HAVING count(*) > 1)"""),
    "crawl_frontier": _frontier(),
    # page parsing
    "clean_text": f"SELECT doc_id, md5({_clean('text')}) AS text_md5 FROM documents",
    "page_title": f"SELECT url, {_title('html')} AS title FROM pages",
    "meta_description": _sql("rich", f"""SELECT url, {_meta('content')} AS meta_description
        FROM rich"""),
    "strip_boilerplate": f"SELECT url, {_stripped('html')} AS html FROM pages",
    "main_content": _sql("page_docs", "SELECT url, content, content_length FROM page_docs"),
    "page_headings": _sql("page_docs", """SELECT url, pos, h.level AS level, h.text AS text
        FROM (SELECT url, unnest(headings) AS h, generate_subscripts(headings, 1) - 1 AS pos
        FROM page_docs)"""),
    "page_links": _sql("page_docs", f"""SELECT url, pos, {_resolve('url', 'href')} AS link,
        text, title FROM (SELECT url, pos,
          {_decode("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href,
          {_inner('a')} AS text,
          {_decode("regexp_extract(a, 'title=\"([^\"]*)\"', 1)")} AS title
        FROM (SELECT url, unnest(anchors) AS a, generate_subscripts(anchors, 1) - 1 AS pos
          FROM page_docs))"""),
    "parse_pages": _sql("page_docs", """SELECT url, title, meta_description, content,
        content_length, len(headings) AS n_headings, len(anchors) AS n_links, crawl_time,
        depth FROM page_docs"""),
    "headings_text": _sql("page_docs", """SELECT url, array_to_string(
        list_transform(headings, lambda h: h.text), ' ') AS headings FROM page_docs"""),
    "crawl_timestamp": _sql("fetches", """SELECT url, crawl_time::BIGINT AS crawl_seconds
        FROM fetches"""),
    # text analysis and index tables
    "tokenize": _sql("tokens", "SELECT url, field, pos, term FROM tokens"),
    "postings": _sql("tokens", """SELECT field, term, url, count(*) AS tf,
        any_value(field_len) AS field_len,
        md5(string_agg(pos::VARCHAR, ' ' ORDER BY pos)) AS positions_md5
        FROM tokens GROUP BY field, term, url"""),
    "field_terms": _sql("term_df", "SELECT term, df FROM term_df WHERE field = 'content'"),
    "document_upsert": _sql("updates", """SELECT url, title, content_length, depth
        FROM (SELECT * FROM text_docs WHERE url NOT IN (SELECT url FROM updates)
        UNION ALL SELECT * FROM updates)"""),
    "document_delete": _sql("text_docs", """SELECT url, title, content_length, depth
        FROM text_docs WHERE NOT contains(url, '/de/')"""),
    "index_stats": _sql("updates", """SELECT count(*) AS document_count FROM (
        SELECT url FROM text_docs UNION SELECT url FROM updates)"""),
    "document_compact": _sql("updates", """SELECT url, title, md5(content) AS content_md5,
        content_length, depth
        FROM (SELECT * FROM text_docs WHERE url NOT IN (SELECT url FROM updates)
        UNION ALL SELECT * FROM updates) WHERE NOT contains(url, '/de/')"""),
    # matching
    "query_clean": f"SELECT doc_id, md5({_query_clean('text')}) AS query_md5 FROM documents",
    "match_field": _sql("matches", """SELECT query_id, url, sum(tf)::BIGINT AS tf FROM matches
        WHERE field = 'title' GROUP BY query_id, url"""),
    "match_multifield": _sql("matches", """SELECT query_id, url, count(*) AS n_fields
        FROM matches GROUP BY query_id, url"""),
    "match_all": _sql("matches", """SELECT query_id, url FROM matches
        GROUP BY query_id, n_terms, url HAVING count(DISTINCT term) = n_terms"""),
    "match_any": _sql("matches", "SELECT DISTINCT query_id, url FROM matches"),
    "match_exclude": _sql("matches", """SELECT DISTINCT query_id, url FROM matches m
        WHERE term = first_word AND NOT EXISTS (SELECT 1 FROM matches x
          WHERE x.query_id = m.query_id AND x.url = m.url AND x.term <> x.first_word)"""),
    "match_phrase": _sql("tokens query_words", """SELECT w.query_id, t.url, t.field,
        t.pos - w.i AS start FROM (SELECT query_id, len(words) AS n, unnest(words) AS term,
          generate_subscripts(words, 1) - 1 AS i FROM query_words) w
        JOIN tokens t ON t.term = w.term
        GROUP BY w.query_id, w.n, t.url, t.field, start HAVING count(*) = w.n"""),
    "match_prefix": _sql("postings prefixes", """SELECT DISTINCT query_id, url
        FROM postings p JOIN prefixes q ON starts_with(p.term, q.prefix)
        WHERE field = 'content'"""),
    "bm25_score": _sql("bm25_all", "SELECT query_id, url, score FROM bm25_all"),
    "search_topk": _sql("top_any", "SELECT query_id, url, score, rank FROM top_any"),
    "hit_projection": _sql("top_any text_docs", f"""SELECT query_id, t.url, score, rank, title,
        {_snippet('content')} AS content, meta_description, content_length, crawl_seconds,
        depth FROM top_any t JOIN text_docs d ON t.url = d.url"""),
    "suggest": _sql("postings prefixes", f"""SELECT query_id, word, row_number() OVER (
          PARTITION BY query_id ORDER BY word) AS rank
        FROM (SELECT DISTINCT query_id, prefix, unnest({_words('lower(title)')}) AS word
          FROM (SELECT query_id, prefix, url FROM (SELECT DISTINCT query_id, prefix, url
            FROM postings p JOIN prefixes q ON starts_with(p.term, q.prefix)
            WHERE field = 'title')
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY url) <= 10)
          JOIN text_docs USING (url))
        WHERE starts_with(word, prefix) AND length(word) > length(prefix)
        QUALIFY rank <= 5"""),
    "popular_terms": _sql("term_df", """SELECT term, df FROM term_df WHERE field = 'title'
        AND length(term) > 3 ORDER BY df DESC, term LIMIT 10"""),
    "search": _rank_sql(f"""SELECT query_id, url, score, ranking_score, {_BREAKDOWN}, rank
        FROM placed WHERE rank <= 10""", "top_all"),
    # ranking
    "term_frequency": _rank_sql("""SELECT DISTINCT query_id, url, term, round(tf, 6) AS tf
        FROM figures""", whole=True),
    "document_frequency": _rank_sql("SELECT DISTINCT query_id, term, df FROM corpus"),
    "inverse_doc_frequency": _rank_sql("""SELECT DISTINCT query_id, term,
        round(ln(n_docs / (df + 1)), 6) AS idf FROM corpus"""),
    "tf_idf": _rank_sql("""SELECT DISTINCT query_id, url, term, round(tf * idf, 6) AS tf_idf
        FROM figures""", whole=True),
    **{
        part: _rank_sql(f"SELECT query_id, url, round({part}, 6) AS {part} FROM ranked")
        for part in ("title_score", "content_score", "url_score", "meta_score")
    },
    "heading_score": _sql("page_docs", f"""SELECT url, {_field_score('terms', 'headings')}
        AS heading_score FROM (SELECT url, {_words('lower(title)')} AS terms, array_to_string(
        list_transform(headings, lambda h: h.text), ' ') AS headings FROM page_docs)"""),
    "freshness_score": _sql("text_docs", f"""SELECT url, round({_FRESHNESS}, 6)
        AS freshness_score FROM text_docs"""),
    "content_length_score": _sql("text_docs", f"""SELECT url, round({_LENGTH_SCORE}, 6)
        AS content_length_score FROM text_docs"""),
    "depth_penalty": _sql("text_docs", """SELECT url, round(depth * 0.1::DOUBLE, 6)
        AS depth_penalty FROM text_docs"""),
    "rank_results": _rank_sql(f"""SELECT query_id, url, score, ranking_score, {_BREAKDOWN}
        FROM ranked"""),
    "rank_reweighted": _rank_sql("SELECT query_id, url, ranking_score FROM ranked",
        weights={"title_match": 0.5, "freshness": 10.0, "depth_penalty": 2.0}),
    # serving
    "paginate": _rank_sql("""SELECT query_id, url, ranking_score, rank FROM placed
        WHERE rank BETWEEN 11 AND 20""", "cand_page"),
    "page_info": _sql("bm25_any", """SELECT query_id, count(*) AS total, true AS has_prev,
        count(*) > 20 AS has_next FROM bm25_any GROUP BY query_id"""),
    "display_rows": _rank_sql(f"""SELECT query_id, url,
        CASE WHEN title = '' THEN 'Untitled' ELSE title END AS title,
        CASE WHEN {_DESCRIBED} THEN meta_description
             ELSE substr(content, 1, 200) || '...' END AS snippet,
        CASE WHEN ranking_score <> 0 THEN {_fixed('ranking_score', 2)} END AS score_text,
        {_fixed('title_score', 1)} AS title_text, {_fixed('content_score', 1)} AS content_text,
        {_fixed('freshness_score', 1)} AS freshness_text FROM ranked"""),
    "answer_context": _rank_sql(f"""SELECT query_id, string_agg(chr(10) || '[Source ' || rank
        || ']: ' || CASE WHEN {_DESCRIBED} THEN meta_description ELSE substr(content, 1, 300)
        END || chr(10), '' ORDER BY rank) AS context FROM placed WHERE rank <= 3
        GROUP BY query_id"""),
}

ORACLES["stream_ingest"] = f"""SELECT url, title, content, length(content) AS content_length,
    0 AS depth, 0 AS crawl_seconds FROM (SELECT url, {_title('html')} AS title,
    {_body('html')} AS content FROM pages)"""


def _updated(sql: str) -> str:
    """The same query over the documents after an update and a removal."""
    old = "text_docs AS ("
    updates = _CTES["updates"].replace("text_docs", "old_docs")
    body = _CTES["text_docs"]
    merged = """SELECT * FROM (SELECT * FROM old_docs WHERE url NOT IN (SELECT url FROM updates)
        UNION ALL SELECT * FROM updates) WHERE NOT contains(url, '/de/')"""
    return sql.replace(
        f"{old}{body})",
        f"old_docs AS ({body}),\nupdates AS ({updates}),\n{old}{merged})",
    )


# words of the queries in clauses: see views.clauses
ORACLES["scored_matches"] = _sql(
    "postings tokens term_df field_len query_words",
    """SELECT query_id, url, round(score + 1, 6) AS score FROM (
        SELECT query_id, url, sum(share) AS score FROM scored GROUP BY query_id, url
        HAVING bool_or(must)) SEMI JOIN headed USING (query_id, url)
        ANTI JOIN unwanted USING (query_id, url)""",
    """worded AS (SELECT query_id, coalesce(words[1], '') AS a, substr(words[2], 1, 4) AS b,
          words[3] AS c, words[4] AS d, words[len(words)] AS e FROM query_words),
        share AS (SELECT p.field, p.term, url, (ln(n_docs / (df + 1)) + 1) * tf * 2.2
          / (tf + 1.2 * (0.25 + 0.75 * p.field_len / avg_len)) AS share
          FROM postings p JOIN term_df d ON p.field = d.field AND p.term = d.term
          JOIN field_len f ON f.field = p.field),
        paired AS (SELECT DISTINCT query_id, x.field, x.url, c, d FROM worded
          JOIN tokens x ON x.term = c JOIN tokens y ON y.term = d AND y.field = x.field
            AND y.url = x.url AND y.pos = x.pos + 1),
        scored AS (
          SELECT query_id, url, share, true AS must FROM worded JOIN share ON term = a
          UNION ALL SELECT query_id, p.url, share, false FROM paired p JOIN share s
            ON s.term = c AND s.field = p.field AND s.url = p.url
          UNION ALL SELECT query_id, p.url, share, false FROM paired p JOIN share s
            ON s.term = d AND s.field = p.field AND s.url = p.url),
        headed AS (SELECT DISTINCT query_id, url FROM worded
          JOIN (SELECT DISTINCT term FROM term_df) t ON starts_with(t.term, b) AND b <> ''
          JOIN postings p ON p.term = t.term),
        unwanted AS (SELECT DISTINCT query_id, url FROM worded JOIN postings ON term = e)""",
)

ORACLES["search_updated"] = _updated(ORACLES["search"])
ORACLES["updated_term_stats"] = _updated(
    _sql(
        "term_df field_len",
        """SELECT d.field, term, df, n_docs, round(avg_len, 6) AS avg_len
        FROM term_df d JOIN field_len f ON d.field = f.field""",
    )
)


def _shape(w: str) -> str:
    """Vowels v and consonants c of a word; y is a vowel after a consonant."""
    return f"""list_reduce(list_prepend('', regexp_extract_all({w}, '(?s).')), lambda a, x: a || CASE
        WHEN x IN ('a', 'e', 'i', 'o', 'u') OR x = 'y' AND ends_with(a, 'c') THEN 'v' ELSE 'c' END)"""


def _measure(part: str) -> str:
    return f"len(regexp_extract_all({part}, 'v+c+'))"


def _cut(suffix: str, x: str = "w") -> str:
    return f"substr({x}, 1, length(w) - {len(suffix)})"


def _replaced(rules: dict[str, str]) -> str:
    cases = " ".join(
        f"WHEN ends_with(w, '{s}') THEN CASE WHEN {_measure(_cut(s, 's'))} > 0"
        f" THEN {_cut(s)} || '{rules[s]}' ELSE w END"
        for s in sorted(rules, key=len, reverse=True)
    )
    return f"CASE {cases} ELSE w END"


def _ending_dropped() -> str:
    cases = " ".join(
        f"WHEN ends_with(w, '{s}') THEN CASE WHEN {_measure(_cut(s, 's'))} > 1"
        + (f" AND regexp_matches({_cut(s)}, '[st]$')" if s == "ion" else "")
        + f" THEN {_cut(s)} ELSE w END"
        for s in sorted(STEP_4, key=len, reverse=True)
    )
    return f"CASE {cases} ELSE w END"


# the outer element's text, then the inner one's
_ARTICLE = _inner(
    f"""array_to_string(list_transform(regexp_extract_all({_stripped('content')},
      '(?is)<article>(.*?)</article>', 1), lambda a: a || ' ' || a), ' ')"""
)
ORACLES["classed_content"] = _sql(
    "rich",
    f"""SELECT url, text AS content, length(text) AS content_length FROM (SELECT url,
      CASE WHEN contains({_stripped('content')}, '<article>') THEN {_ARTICLE}
        ELSE {_body('content')} END AS text FROM rich)""",
)


def _porter(words: str) -> str:
    """CTEs that end in ``stems`` (word, stem): the published steps, one after the other."""
    past = "CASE WHEN ends_with(w, 'ed') THEN substr(w, 1, length(w) - 2) ELSE substr(w, 1, length(w) - 3) END"
    steps = [
        # plurals
        """CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN substr(w, 1, length(w) - 2)
          WHEN ends_with(w, 'ss') OR NOT ends_with(w, 's') THEN w
          ELSE substr(w, 1, length(w) - 1) END""",
        # past forms and gerunds; a stem that lost its ending is mended
        f"""CASE WHEN ends_with(w, 'eed') THEN
            CASE WHEN {_measure(_cut('eed', 's'))} > 0 THEN {_cut('d')} ELSE w END
          WHEN (ends_with(w, 'ed') OR ends_with(w, 'ing'))
            AND contains(substr(s, 1, length({past})), 'v') THEN
            CASE WHEN regexp_matches({past}, '(at|bl|iz)$') THEN {past} || 'e'
              WHEN length({past}) > 1 AND right({past}, 1) = substr({past}, length({past}) - 1, 1)
                AND substr(s, length({past}), 1) = 'c' THEN
                CASE WHEN right({past}, 1) IN ('l', 's', 'z')
                  THEN CASE WHEN {_measure(f'substr(s, 1, length({past}))')} = 1
                    AND regexp_matches(substr(s, 1, length({past})), 'cvc$')
                    AND right({past}, 1) NOT IN ('w', 'x', 'y') THEN {past} || 'e' ELSE {past} END
                  ELSE substr({past}, 1, length({past}) - 1) END
              WHEN {_measure(f'substr(s, 1, length({past}))')} = 1
                AND regexp_matches(substr(s, 1, length({past})), 'cvc$')
                AND right({past}, 1) NOT IN ('w', 'x', 'y') THEN {past} || 'e'
              ELSE {past} END
          ELSE w END""",
        f"CASE WHEN ends_with(w, 'y') AND contains({_cut('y', 's')}, 'v') THEN {_cut('y')} || 'i' ELSE w END",
        _replaced(STEP_2),
        _replaced(STEP_3),
        _ending_dropped(),
        f"""CASE WHEN ends_with(w, 'e') AND ({_measure(_cut('e', 's'))} > 1
            OR {_measure(_cut('e', 's'))} = 1 AND NOT (regexp_matches({_cut('e', 's')}, 'cvc$')
              AND NOT regexp_matches({_cut('e')}, '[wxy]$'))) THEN {_cut('e')} ELSE w END""",
        f"CASE WHEN ends_with(w, 'll') AND {_measure(_cut('l', 's'))} > 1 THEN {_cut('l')} ELSE w END",
    ]
    ctes = [f"porter0 AS (SELECT DISTINCT term AS word, term AS w FROM {words})"]
    for n, step in enumerate(steps, 1):
        ctes.append(
            f"porter{n} AS (SELECT word, CASE WHEN length(word) < 3 THEN word ELSE {step} END AS w"
            f" FROM (SELECT word, w, {_shape('w')} AS s FROM porter{n - 1}))"
        )
    return ",\n".join([*ctes, f"stems AS (SELECT word, w AS stem FROM porter{len(steps)})"])


ORACLES["stem_terms"] = _sql(
    "tokens",
    "SELECT field, stem, count(*) AS n FROM tokens JOIN stems ON term = word"
    " WHERE field IN ('title', 'content') GROUP BY field, stem",
    _porter("tokens"),
)



def _stemmed(sql: str) -> str:
    """A query over an index whose titles and contents are stemmed.

    Query words are stemmed for those fields alone. Coverage counts words as asked, so
    two words of one stem are two terms.
    """
    fields = "field IN ('title', 'content')"

    def cte(name: str, body: str) -> str:
        stored = "MATERIALIZED " if name in ("postings", "field_tokens") else ""
        return f"{name} AS {stored}({body})"

    asked = [cte(n, _CTES[n]) for n in ("queries", "query_words", "query_terms")]
    for part in asked:
        sql = sql.replace(part + ",\n", "")
    words = "SELECT term FROM plain_tokens UNION SELECT term FROM query_terms"
    tokens = f"""SELECT url, field, CASE WHEN {fields} THEN stem ELSE term END AS term, pos,
        field_len FROM plain_tokens JOIN stems ON word = term"""
    sql = sql.replace(
        cte("tokens", _CTES["tokens"]),
        ",\n".join(
            [*asked, cte("plain_tokens", _CTES["tokens"]), cte("all_words", words),
             _porter("all_words"), cte("tokens", tokens)]
        ),
    )
    matches = f"""SELECT q.query_id, q.n_terms, q.term AS asked, p.term, p.field, p.url, p.tf,
        p.field_len FROM query_terms q JOIN stems ON word = q.term JOIN postings p
          ON p.term = CASE WHEN {fields} THEN stem ELSE q.term END"""
    sql = sql.replace(cte("matches", _CTES["matches"]), cte("matches", matches))
    return sql.replace("SELECT query_id, n_terms, m.term, url,", "SELECT query_id, n_terms, asked AS term, url,")


ORACLES["search_stemmed"] = _stemmed(ORACLES["search"])
