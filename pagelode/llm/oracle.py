"""SQL beside the queries of this subpackage, where SQL can express them."""

ORACLES: dict[str, str] = {}


def oracle(name: str):
    def add(sql: str) -> None:
        ORACLES[name] = sql

    return add


oracle("op10_decontaminate")(
    r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
    array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM item, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win
), place AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
), hit AS (
  SELECT p.doc_id, p.i, p.n, win.item_id FROM place p JOIN win ON p.n = win.n AND p.g = win.g
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
)

oracle("op6_quality_rules")(
    r"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    string_split(coalesce(text, ''), chr(10)) AS al,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM doc, unnest(range(1, len(w) - 3)) AS t(i)
), twice AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT k) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY doc_id
), line AS (
  SELECT doc_id, k, al[k] AS x, len(regexp_extract_all(al[k], '[^\x20\x09-\x0D]+')) AS n,
    length(al[k]) - length(regexp_replace(al[k], '[#*$%&|<>]', '', 'g')) AS symbols,
    len(regexp_extract_all(al[k], '!!+([\x20\x09-\x0D]|$)')) AS exclaims,
    len(regexp_extract_all(al[k], '[|»•›]')) AS separators
  FROM doc, unnest(range(1, len(al) + 1)) AS t(k)
), clean AS (
  SELECT doc_id, sum(n) AS n, string_agg(x, chr(10) ORDER BY k) AS cleaned FROM line
  WHERE n = 0 OR NOT (
    100 * symbols > 30 * n OR 100 * exclaims > 30 * n
    OR n > 200 AND NOT regexp_matches(x, '[.!?。！？…:;]')
    OR separators >= 3 AND 100 * separators > 25 * n
    OR n <= 30 AND regexp_matches(lower(x), '(all rights reserved|accept cookies|cookie policy|enable javascript|privacy policy|terms of use|terms of service|subscribe to our newsletter|click here to|lorem ipsum|skip to content|share on facebook|share on twitter)')
  ) GROUP BY doc_id
), figures AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(clean.n, 0) AS BIGINT) AS n_kept_words, coalesce(cleaned, '') AS c
  FROM doc LEFT JOIN rep USING (doc_id) LEFT JOIN clean USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND 100 * n_kept_words >= 50 * n_words AS kept,
  n_kept_words, sha256(c) AS cleaned_sha256
FROM figures
"""
)

oracle("op1_url_filters")(
    r"""
WITH page AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'),
      lambda x: x <> '') AS parts,
    CAST(to_timestamp(1704067200 + page_id * 7919 % 2592000) AT TIME ZONE 'UTC' AS TIMESTAMP) AS t
  FROM pages
), entry AS (
  SELECT CASE WHEN event_id % 5 = 0 THEN 'allow' ELSE 'block' END AS list,
    CASE event_id % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'host' ELSE 'prefix' END AS kind,
    CASE event_id % 3 WHEN 0 THEN regexp_extract(host, '([^.]+\.[^.]+)$', 1) WHEN 1 THEN host
      ELSE host || regexp_extract(url, '^[a-z]+://[^/]+(/[^/?#]+)', 1) END AS pattern,
    ts, event_type NOT IN ('view', 'error') AS adds, event_id
  FROM events JOIN page ON user_id = page_id
), dated AS (
  SELECT *, lead(ts) OVER (PARTITION BY list, kind, pattern ORDER BY ts, event_id) AS until FROM entry
), interval AS (
  SELECT * FROM dated WHERE adds AND (until IS NULL OR until > ts)
), key AS (
  SELECT page_id, t, 'host' AS kind, host AS pattern FROM page
  UNION ALL
  SELECT page_id, t, 'domain', array_to_string(string_split(host, '.')[i:], '.')
  FROM page, unnest(range(1, len(string_split(host, '.')))) AS r(i)
  UNION ALL
  SELECT page_id, t, 'prefix', host || '/' || array_to_string(parts[1:i], '/')
  FROM page, unnest(range(1, len(parts) + 1)) AS r(i)
), best AS (
  SELECT page_id, list, kind, pattern, ts FROM key JOIN interval USING (kind, pattern)
  WHERE ts <= t AND (until IS NULL OR t < until)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY
    CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(pattern) DESC,
    list = 'allow' DESC, ts DESC, list DESC, pattern DESC) = 1
)
SELECT page.page_id, url, coalesce(list <> 'block', true) AS kept, list, kind, pattern, ts AS since
FROM page LEFT JOIN best USING (page_id)
"""
)

oracle("op13_phrases")(
    r"""
WITH piece AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)
), total AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY lang
), counted AS (
  SELECT lang, m, g, count(*) AS f FROM (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g
    FROM piece, (VALUES (1), (2), (3)) AS size(m), unnest(range(1, len(w) - m + 2)) AS t(i))
  GROUP BY lang, m, g
), candidate AS (
  SELECT lang, m, g, f AS a, string_split(g, ' ') AS w FROM counted WHERE m > 1 AND f >= 10
), known AS (
  SELECT concat(lang, chr(9), g) AS key, f FROM counted WHERE f >= 10
), cut AS (
  SELECT lang, m, g, a, k, concat(lang, chr(9), array_to_string(w[1:k], ' ')) AS first_key,
    concat(lang, chr(9), array_to_string(w[k + 1:], ' ')) AS rest_key
  FROM candidate, (VALUES (1), (2)) AS cuts(k) WHERE k < m
), scored AS (
  SELECT lang, m, g, a, x.f AS l, y.f AS r,
    CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut JOIN known x ON x.key = first_key JOIN known y ON y.key = rest_key
  QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inner_phrase AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS g, max(a) AS most
  FROM candidate, (VALUES (1), (2)) AS place(i) WHERE m = 3 GROUP BY ALL
), best AS (
  SELECT s.lang, s.g, s.a, s.l, s.r, s.score,
    row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.g) AS rank
  FROM scored s LEFT JOIN inner_phrase i ON s.lang = i.lang AND s.g = i.g
  WHERE NOT coalesce(100 * most >= 50 * s.a, false)
)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM best JOIN total USING (lang)
WHERE rank <= 2000
"""
)
