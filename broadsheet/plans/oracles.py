"""The same results in plain SQL for DuckDB, written without the operators."""

from __future__ import annotations

SQL: dict[str, str] = {}


# Feeds and articles

SQL["feed_items_roundtrip"] = """
SELECT 'http://feeds.example.org/' || (page_id // 20) AS feed_url, CAST(page_id % 20 AS INTEGER) AS pos,
  regexp_extract(html, '<title>(.*?)</title>', 1) AS title, url AS link, 'page ' || page_id AS summary,
  CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'Tue, 01 Dec 2026 10:00:' || lpad(CAST(page_id % 60 AS VARCHAR), 2, '0') || ' GMT' END AS published
FROM pages
"""

ITEMS = """
items AS (
  SELECT url AS link, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'day ' || (page_id % 30) END AS published FROM pages
  UNION ALL
  SELECT url || '&gone', CASE WHEN page_id % 4 = 0 THEN '' ELSE 'day ' || (page_id % 30) END FROM pages
)
"""

SQL["fetch_status"] = f"""
WITH {ITEMS}
SELECT link, CASE WHEN html IS NULL THEN 'failed' ELSE 'ok' END AS fetch_status, coalesce(length(html), 0) AS n_chars
FROM items LEFT JOIN pages ON url = link
"""


def decoded(text: str) -> str:
    """References of the given pages, by nested replacement with the ampersand last."""
    for name, char in [("copy", "©"), ("middot", "·"), ("nbsp", " "), ("quot", '"'), ("apos", "''"), ("lt", "<"), ("gt", ">"), ("amp", "&")]:
        text = f"replace({text}, '&{name};', '{char}')"
    return text


RAW_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
TITLE = f"regexp_replace({decoded(RAW_TITLE)}, '^\\s+|\\s+$', '', 'g')"

TEXTS = f"""
bare AS (SELECT page_id, url, {TITLE} AS title,
    regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '', 'g') AS h FROM pages),
region AS (SELECT page_id, url, title, regexp_extract(h, '(?is)<article\\b[^>]*>(.*?)(?:</article\\s*>|\\z)', 1) AS h FROM bare),
lined AS (SELECT page_id, url, title, regexp_replace(regexp_replace(h, '(?i)</p\\s*>|<br\\s*/?>|</h[1-6]\\s*>|</li\\s*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS h FROM region),
texts AS (SELECT page_id, url, title,
    regexp_replace(regexp_replace(regexp_replace({decoded('h')}, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM lined)
"""

SQL["article_text"] = f"WITH {TEXTS} SELECT page_id, title, text FROM texts"


def grams(name: str, source: str, keep: str) -> str:
    """All trigrams of a padded lower-case text, one row each."""
    return f"""
{name}_c AS (SELECT {keep}, string_split(' ' || lower(text) || ' ', '') AS c FROM {source}),
{name}_i AS (SELECT {keep}, c, unnest(range(1, len(c) - 1)) AS i FROM {name}_c),
{name} AS (SELECT {keep}, c[i] || c[i + 1] || c[i + 2] AS gram FROM {name}_i)
"""


PROFILES = f"""
{grams('dg', 'documents', 'lang')},
counted AS (SELECT lang, gram, count(*) AS n FROM dg GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM counted GROUP BY lang),
profiles AS (SELECT c.lang, gram, CAST(round(1000.0 * ln(1.0 + CAST(n AS DOUBLE) / CAST(total AS DOUBLE) / 1e-6)) AS BIGINT) AS weight
  FROM counted c JOIN totals t ON c.lang = t.lang)
"""

SQL["language_profiles"] = f"WITH {PROFILES} SELECT lang, gram, weight FROM profiles"

SQL["detect_language"] = f"""
WITH {PROFILES}, {grams('tg', 'documents', 'doc_id')},
scores AS (SELECT doc_id, lang, sum(weight) AS score FROM tg JOIN profiles p ON tg.gram = p.gram GROUP BY ALL),
best AS (SELECT doc_id, arg_max(lang, (score, lang)) AS language FROM scores GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN regexp_matches(d.text, '\\p{{L}}') THEN coalesce(b.language, 'unknown') ELSE 'unknown' END AS language
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id
"""

NORMALIZED = f"""
{PROFILES}, {TEXTS}, {ITEMS}, {grams('tg', 'texts', 'url')},
scores AS (SELECT url, lang, sum(weight) AS score FROM tg JOIN profiles p ON tg.gram = p.gram GROUP BY ALL),
best AS (SELECT url, arg_max(lang, (score, lang)) AS language FROM scores GROUP BY url),
normalized AS (
  SELECT t.title, i.link, t.text, i.published,
    CASE WHEN t.url IS NULL THEN NULL WHEN regexp_matches(t.text, '\\p{{L}}') THEN coalesce(b.language, 'unknown') ELSE 'unknown' END AS language,
    CASE WHEN t.url IS NULL THEN 'failed' ELSE 'ok' END AS status
  FROM items i LEFT JOIN texts t ON t.url = i.link LEFT JOIN best b ON b.url = i.link)
"""

SQL["articles_normalized"] = f"WITH {NORMALIZED} SELECT title, link, text, published, language, status FROM normalized"
SQL["articles_kept"] = f"WITH {NORMALIZED} SELECT link, language, CAST(length(text) AS INTEGER) AS n_chars FROM normalized WHERE status = 'ok'"
SQL["articles_saved"] = SQL["articles_kept"]
SQL["articles_streamed"] = f"""
SELECT kept.* FROM ({SQL["articles_kept"]}) kept JOIN pages ON url = link WHERE page_id // 20 % 2 = 0
"""
SQL["feed_reports"] = """
SELECT 'http://feeds.example.org/' || (page_id // 20) AS feed_url,
  CASE page_id // 20 % 6 WHEN 1 THEN 'malformed' WHEN 3 THEN 'malformed' WHEN 5 THEN 'empty' ELSE 'ok' END AS status,
  CAST(CASE WHEN page_id // 20 % 2 = 0 THEN count(*) ELSE 0 END AS INTEGER) AS n_items
FROM pages GROUP BY page_id // 20
"""
SQL["article_counts"] = f"""
WITH {ITEMS} SELECT count(*) AS pulled, count(html) AS saved, count(*) - count(html) AS failed
FROM items LEFT JOIN pages ON url = link
"""

CENTROIDS = """
cells AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
centroids AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM cells GROUP BY ALL)
"""

SQL["topic_prototypes"] = f"""
WITH {CENTROIDS} SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(x, 6) AS x FROM centroids
"""

SQL["topic_by_prototype"] = f"""
WITH {CENTROIDS},
scored AS (
  SELECT v.vec_id, c.label, round(sum(CAST(v.x AS DOUBLE) * c.x)
    / sqrt(sum(CAST(v.x AS DOUBLE) * CAST(v.x AS DOUBLE)) * sum(c.x * c.x)), 6) AS score
  FROM cells v JOIN centroids c ON v.pos = c.pos GROUP BY ALL)
SELECT vec_id, CAST(arg_max(label, (score, -label)) AS VARCHAR) AS topic FROM scored GROUP BY vec_id
"""

SQL["topic_by_tokens"] = """
WITH seeds(ord, label, words) AS (VALUES
  (0, 'Politics', 'der the le'), (1, 'Technology', 'und of de'), (2, 'Health', 'die and la'), (3, 'Entertainment', 'ein to les'),
  (4, 'Sports', 'von in que'), (5, 'Finance', 'zu that en'), (6, 'Science', 'mit it et'), (7, 'World', 'sich for un'), (8, 'Business', 'das is el')),
seed AS (SELECT ord, label, unnest(string_split(words, ' ')) AS word, 4 - unnest([1, 2, 3]) AS weight FROM seeds),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents),
scores AS (SELECT doc_id, ord, label, sum(weight) AS score FROM words JOIN seed USING (word) GROUP BY ALL),
best AS (SELECT doc_id, arg_max(label, (score, -ord)) AS topic FROM scores GROUP BY doc_id)
SELECT doc_id, coalesce(topic, 'Unknown') AS topic FROM documents LEFT JOIN best USING (doc_id)
"""

# Feed discovery

SQL["url_classes"] = """
WITH u AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN ' ' || url || ' ' WHEN 1 THEN 'feed://' || regexp_replace(url, '^.*://', '')
    WHEN 2 THEN regexp_replace(url, '^.*://', '') WHEN 3 THEN url || '/comments.rss' WHEN 4 THEN url || '.XML'
    WHEN 5 THEN url || '/georss' WHEN 6 THEN url || '/atom' WHEN 7 THEN url || '.rdf' ELSE url || '.xml' END AS url FROM pages),
t AS (SELECT page_id, url, trim(url) AS s, lower(url) AS low FROM u)
SELECT page_id,
  CASE WHEN starts_with(s, 'feed://') THEN 'http://' || substring(s, 8)
       WHEN starts_with(s, 'http://') OR starts_with(s, 'https://') THEN s ELSE 'http://' || s END AS coerced,
  ends_with(low, '.rss') OR ends_with(low, '.rdf') OR ends_with(low, '.xml') OR ends_with(low, '.atom') AS is_feed_url,
  contains(low, 'rss') OR contains(low, 'rdf') OR contains(low, 'xml') OR contains(low, 'atom') OR contains(low, 'feed') AS is_feedlike,
  CASE WHEN contains(url, 'comments') THEN -2 WHEN contains(url, 'georss') THEN -1 WHEN contains(url, 'atom') THEN 5
       WHEN contains(url, 'rss') THEN 4 WHEN contains(url, 'rdf') THEN 3 WHEN contains(url, '.xml') THEN 2
       WHEN contains(url, 'feed') THEN 1 ELSE 0 END AS prob
FROM t
"""

SQL["resolved_urls"] = """
WITH b AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+:', 0) AS scheme, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS site,
    regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*(.*)$', 1) AS path,
    regexp_extract(regexp_replace(url, '#.*$', ''), '\\?.*$', 0) AS query FROM pages),
f AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder FROM b),
p AS (SELECT *, CASE WHEN folder = '' THEN '/' ELSE folder END AS dir FROM f),
g AS (SELECT *, CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]*/$', '') END AS up FROM p),
r AS (SELECT *, unnest(['x', './x/', '../x', '/x?y=1', '//cdn.example.net/x', 'http://other.example.org/x', '?q=1', '#part', '']) AS ref FROM g)
SELECT page_id, ref, CASE ref WHEN 'x' THEN site || dir || 'x' WHEN './x/' THEN site || dir || 'x/' WHEN '../x' THEN site || up || 'x'
  WHEN '/x?y=1' THEN site || '/x?y=1' WHEN '//cdn.example.net/x' THEN scheme || '//cdn.example.net/x'
  WHEN 'http://other.example.org/x' THEN ref WHEN '?q=1' THEN site || path || '?q=1'
  WHEN '#part' THEN site || path || query || '#part' ELSE url END AS resolved
FROM r
"""

CRAWL = """
shaped AS (SELECT *, page_id % 8 AS k, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS site,
    regexp_extract(regexp_replace(url, '[?#].*$', ''), '^.*/', 0) AS folder FROM pages),
bodies AS (SELECT url, site, page_id, k, CASE k WHEN 0 THEN '<rss version=''2.0''><channel/></rss>' WHEN 6 THEN NULL ELSE
    replace(replace(html, '</head>', CASE k WHEN 1 THEN '<LINK rel=alternate type="application/rss+xml" href="/f' || page_id || '.xml"></head>'
      WHEN 2 THEN '<link rel=x type="text/css" href="/style.xml"></head>'
      WHEN 7 THEN '<link type="application/atom+xml" href="/atom' || page_id || '"></head>' ELSE '</head>' END),
      '</body>', CASE WHEN k IN (2, 7) THEN '<a href="/news' || page_id || '.rss">news</a></body>'
      WHEN k = 3 THEN '<a href="http://feeds.example.com/feed' || (page_id % 5) || '">f</a></body>' ELSE '</body>' END) END AS body FROM shaped),
feed_urls AS (SELECT unnest(CASE k WHEN 1 THEN [site || '/f' || page_id || '.xml'] WHEN 2 THEN [site || '/news' || page_id || '.rss']
    WHEN 3 THEN ['http://feeds.example.com/feed' || (page_id % 5)] WHEN 4 THEN [folder || 'rss.xml']
    WHEN 7 THEN [site || '/atom' || page_id, site || '/news' || page_id || '.rss'] ELSE [] END) AS url FROM shaped),
feeds AS (SELECT DISTINCT url FROM feed_urls UNION SELECT url FROM bodies WHERE k = 0),
tags AS (SELECT url, site, unnest(regexp_extract_all(body, '(?i)<(?:a|link)\\b[^<>]*>')) AS tag FROM bodies WHERE k <> 0 AND body IS NOT NULL),
hrefs AS (SELECT url, site, lower(regexp_extract(tag, '^<([a-zA-Z]+)', 1)) AS name, regexp_extract(tag, 'type="([^"]*)"', 1) AS kind,
    regexp_extract(tag, 'href="([^"]*)"', 1) AS href FROM tags),
full_hrefs AS (SELECT url, name, kind, href, CASE WHEN starts_with(href, '/') THEN site || href ELSE href END AS target FROM hrefs),
tag_candidates AS (
  SELECT DISTINCT url AS page_url, 1 AS stage, target AS url FROM full_hrefs WHERE name = 'link' AND kind IN
    ('application/rss+xml', 'text/xml', 'application/atom+xml', 'application/x.atom+xml', 'application/x-atom+xml')
  UNION ALL SELECT DISTINCT url, 2, target FROM full_hrefs WHERE name = 'a' AND NOT contains(href, '://') AND regexp_matches(lower(href), '\\.(rss|rdf|xml|atom)$')
  UNION ALL SELECT DISTINCT url, 3, target FROM full_hrefs WHERE name = 'a' AND regexp_matches(lower(href), 'rss|rdf|xml|atom|feed')),
guesses AS (SELECT url AS page_url, 4 AS stage, (CASE WHEN regexp_matches(folder, '^[a-z]+://$') THEN site || '/' ELSE folder END) ||
    unnest(['atom.xml', 'index.atom', 'index.rdf', 'rss.xml', 'index.xml', 'index.rss']) AS url FROM shaped)
"""

SQL["feed_pages"] = f"""
WITH {CRAWL}
SELECT DISTINCT url, coalesce(k = 0, false) AS is_feed FROM bodies UNION SELECT DISTINCT url, true FROM feed_urls
"""
SQL["link_candidates"] = f"WITH {CRAWL} SELECT page_url, stage, url FROM tag_candidates WHERE stage = 1"
SQL["anchor_candidates"] = f"WITH {CRAWL} SELECT page_url, stage, url FROM tag_candidates WHERE stage > 1"
SQL["checked_guesses"] = f"WITH {CRAWL} SELECT page_url, stage, url FROM guesses WHERE url IN (SELECT url FROM feeds)"

FOUND = f"""
{CRAWL},
checked AS (
  SELECT url AS page_url, 0 AS stage, url FROM bodies WHERE k = 0
  UNION ALL SELECT c.page_url, c.stage, c.url FROM (SELECT * FROM tag_candidates UNION ALL SELECT * FROM guesses) c
    JOIN bodies b ON b.url = c.page_url WHERE b.k NOT IN (0, 6) AND c.url IN (SELECT url FROM feeds))
"""


def ranked(source: str) -> str:
    prob = """CASE WHEN contains(url, 'comments') THEN -2 WHEN contains(url, 'georss') THEN -1 WHEN contains(url, 'atom') THEN 5
       WHEN contains(url, 'rss') THEN 4 WHEN contains(url, 'rdf') THEN 3 WHEN contains(url, '.xml') THEN 2
       WHEN contains(url, 'feed') THEN 1 ELSE 0 END"""
    return f"""
, kept AS (SELECT page_url, url, min(stage) AS stage, {prob} AS prob FROM {source} GROUP BY page_url, url)
SELECT page_url, url, stage, prob, CAST(row_number() OVER (PARTITION BY page_url ORDER BY prob DESC, url) AS INTEGER) AS rank FROM kept
"""


SQL["find_feeds"] = (
    f"WITH {FOUND}, firsts AS (SELECT *, min(stage) OVER (PARTITION BY page_url) AS f FROM checked), "
    f"first_only AS (SELECT page_url, stage, url FROM firsts WHERE stage = f) {ranked('first_only')}"
)
SQL["find_feeds_all"] = f"WITH {FOUND} {ranked('checked')}"

# Pointers

POINTERS = """
ptrs AS (SELECT *, CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '/' || p_brand || '/' || p_size WHEN 2 THEN '/a~1' || p_name
    WHEN 3 THEN '/~0' || p_brand || '/' WHEN 4 THEN p_name WHEN 5 THEN '/' || p_brand || '~' ELSE '/~2' || p_size END AS pointer FROM part)
"""

SQL["pointer_parse"] = f"""
WITH {POINTERS},
e AS (SELECT *, CASE WHEN regexp_matches(pointer, '~[^01]|~$') THEN 'invalid_escape'
    WHEN pointer <> '' AND NOT starts_with(pointer, '/') THEN 'no_leading_slash' END AS error FROM ptrs),
parts AS (SELECT *, CASE WHEN error IS NULL THEN
    CASE WHEN pointer = '' THEN [] ELSE list_transform(string_split(substring(pointer, 2), '/'), lambda p: replace(replace(p, '~1', '/'), '~0', '~')) END END AS parts FROM e)
SELECT p_partkey, CASE WHEN parts IS NULL THEN NULL ELSE CAST(len(parts) AS INTEGER) END AS n_parts,
  CASE WHEN len(parts) = 0 THEN '' ELSE array_to_string(parts, '|') END AS parts, error FROM parts
"""

SQL["pointer_build"] = """
SELECT p_partkey, '/' || replace(replace(p_brand || '/~', '~', '~0'), '/', '~1') || '/' || p_size || '/~01' AS path,
  '/' || replace(replace(p_brand || '/~', '~', '~0'), '/', '~1') || '/' || p_size || '/~01/x~1y/0' AS longer, true AS below, false AS above
FROM part
"""

SQL["pointer_get"] = """
SELECT event_id, CAST(json_extract(props, '/k') AS VARCHAR) AS k, coalesce(CAST(json_extract(props, '/missing/0') AS VARCHAR), '-1') AS missing FROM events
"""

DOCS = """
o AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, '{"id":' || o_custkey || ',"rank":"' || o_orderpriority || '"}' AS owner FROM orders),
docs AS (SELECT o_orderkey AS doc_id, *, '{"cents":' || cents || ',"codes":[' || o_custkey || ',' || o_orderkey || '],"id":' || o_orderkey ||
    ',"owner":' || owner || ',"state":"' || o_orderstatus || '"}' AS doc FROM o)
"""

SQL["pointer_join"] = f"""
WITH {DOCS},
p AS (SELECT *, CASE o_orderkey % 8 WHEN 0 THEN '/id' WHEN 1 THEN '/codes/1' WHEN 2 THEN '/owner/rank' WHEN 3 THEN '/codes/-'
    WHEN 4 THEN '/codes/01' WHEN 5 THEN '/state/0' WHEN 6 THEN 'id' ELSE '/codes/2' END AS pointer FROM docs),
v AS (SELECT doc_id, pointer, CASE WHEN starts_with(pointer, '/') AND pointer <> '/codes/-' THEN CAST(json_extract(doc, pointer) AS VARCHAR) END AS value FROM p)
SELECT doc_id, pointer, value, CASE WHEN NOT starts_with(pointer, '/') THEN 'invalid' WHEN value IS NOT NULL THEN 'ok'
  WHEN pointer = '/codes/-' THEN 'end_of_list' ELSE 'missing' END AS status
FROM v
"""

SQL["flatten_docs"] = f"""
WITH {DOCS},
t AS (SELECT d.doc_id, j.key, j.value, j.type AS jtype, j.fullkey, j.path AS parent_key FROM docs d, json_tree(d.doc) j)
SELECT doc_id, replace(replace(replace(replace(fullkey, '$', ''), '.', '/'), '[', '/'), ']', '') AS path,
  CASE WHEN fullkey = '$' THEN NULL ELSE replace(replace(replace(replace(parent_key, '$', ''), '.', '/'), '[', '/'), ']', '') END AS parent,
  CASE jtype WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string' ELSE 'int' END AS type,
  CAST(value AS VARCHAR) AS value
FROM t
"""

SQL["pointer_set"] = f"""
WITH {DOCS}
SELECT doc_id, '{{"cents":' || cents || ',"codes":[true,' || o_orderkey || ',9],"id":' || o_orderkey || ',"owner":{{"id":' || o_custkey ||
  ',"rank":[1]}},"state":"' || o_orderstatus || '"}}' AS doc, 'pointer_error' AS status FROM docs
"""

SQL["pointer_test"] = "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'F'"

SQL["single_edits"] = f"""
WITH {DOCS}
SELECT doc_id, '[' || o_custkey || ',5,' || o_orderkey || ']' AS added,
  '{{"cents":' || cents || ',"codes":[' || o_custkey || ',' || o_orderkey || '],"id":' || o_orderkey || ',"state":"' || o_orderstatus || '"}}' AS removed,
  '{{"id":5,"rank":"' || o_orderpriority || '"}}' AS replaced, CAST(NULL AS VARCHAR) AS conflict,
  '{{"cents":' || cents || ',"codes":["' || o_orderpriority || '",' || o_custkey || ',' || o_orderkey || '],"id":' || o_orderkey ||
    ',"owner":{{"id":' || o_custkey || '}},"state":"' || o_orderstatus || '"}}' AS moved,
  CAST(o_orderkey AS VARCHAR) AS copied, o_custkey = 5 AS tested
FROM docs
"""

# Change logs

LINES = """
lines_n AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS n FROM lineitem)
"""

BROKEN = f"""
{LINES},
checked AS (SELECT l_orderkey AS doc_id, n AS seq,
    CASE WHEN l_partkey % 9 = 0 THEN 'missing_op' WHEN l_partkey % 9 = 1 THEN 'unknown_op'
         WHEN l_suppkey % 9 = 0 THEN 'missing_path' WHEN l_suppkey % 9 IN (1, 2) THEN 'bad_pointer' END AS error FROM lines_n)
"""

SQL["patch_validate"] = f"""
WITH {BROKEN}
SELECT doc_id, seq, error, CASE WHEN error = 'bad_pointer' THEN 'pointer_error' WHEN error IS NOT NULL THEN 'invalid' END AS status FROM checked
"""

SQL["patch_apply_malformed"] = f"""
WITH {BROKEN}, firsts AS (SELECT doc_id, min(seq) AS seq, arg_min(error, seq) AS error FROM checked WHERE error IS NOT NULL GROUP BY doc_id)
SELECT o_orderkey AS doc_id, CASE WHEN error IS NULL THEN 'ok' WHEN error = 'bad_pointer' THEN 'pointer_error' ELSE 'invalid' END AS status,
  CAST(f.seq AS BIGINT) AS failed_seq
FROM orders LEFT JOIN firsts f ON f.doc_id = o_orderkey
"""

MEMBER_LOG = f"""
{LINES},
log AS (
  SELECT l_orderkey AS doc_id, (n - 1) * 3 + 1 AS seq, 'add' AS op, '/line' || n AS path, CAST(l_partkey AS VARCHAR) AS value FROM lines_n
  UNION ALL SELECT l_orderkey, (n - 1) * 3 + 2, 'remove', '/line' || n, NULL FROM lines_n WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey, (n - 1) * 3 + 2, 'replace', '/absent', '1' FROM lines_n WHERE l_returnflag <> 'R' AND l_orderkey % 10 = 7
  UNION ALL SELECT l_orderkey, (n - 1) * 3 + 3, 'replace', '/state', '"' || l_linestatus || '"' FROM lines_n)
"""

SQL["patch_order"] = f"""
WITH {MEMBER_LOG}
SELECT doc_id, string_agg(concat_ws(' ', op, path, value), ';' ORDER BY seq) AS ops FROM log GROUP BY doc_id
"""

SQL["patch_apply_objects"] = f"""
WITH {DOCS}, {MEMBER_LOG},
lasts AS (SELECT doc_id, path, arg_max(op, seq) AS op, arg_max(CASE WHEN value IS NULL THEN '' ELSE value END, seq) AS value FROM log GROUP BY doc_id, path),
lines AS (SELECT doc_id, string_agg('"' || substring(path, 2) || '":' || value || ',', '' ORDER BY path) AS lines FROM lasts WHERE starts_with(path, '/line') AND op = 'add' GROUP BY doc_id),
states AS (SELECT doc_id, value AS state FROM lasts WHERE path = '/state'),
faults AS (SELECT doc_id, min(seq) AS failed_seq FROM log WHERE path = '/absent' GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN f.failed_seq IS NOT NULL OR s.state IS NULL THEN d.doc ELSE
    '{{"cents":' || cents || ',"codes":[' || o_custkey || ',' || o_orderkey || '],"id":' || o_orderkey || ',' || coalesce(lines, '') ||
    '"owner":' || owner || ',"state":' || s.state || '}}' END AS doc,
  CASE WHEN f.failed_seq IS NULL THEN 'ok' ELSE 'conflict' END AS status, CAST(f.failed_seq AS BIGINT) AS failed_seq
FROM docs d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN states s ON s.doc_id = d.doc_id LEFT JOIN faults f ON f.doc_id = d.doc_id
"""

SQL["patch_apply_full"] = f"""
WITH {DOCS}
SELECT doc_id, CASE WHEN o_orderkey % 11 = 0 THEN doc ELSE
  '{{"buyer":{{"id":' || o_custkey || ',"rank":null}},"cents":' || cents || ',"codes":[5,' || o_orderkey || ',{{"x":[1]}}],"first":' || o_custkey ||
  ',"id":' || o_orderkey || ',"state":"' || o_orderstatus || '"}}' END AS doc,
  CASE WHEN o_orderkey % 11 = 0 THEN 'test_failed' ELSE 'ok' END AS status,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN 7 END AS BIGINT) AS failed_seq
FROM docs
"""

SQL["json_text_patches"] = """
WITH steps(seq, op, path, "from", value) AS (VALUES (1, 'add', '/codes/1', NULL, '5'), (2, 'add', '/codes/-', NULL, '{"x":[1]}'),
  (3, 'copy', '/first', '/codes/0', NULL), (4, 'move', '/buyer', '/owner', NULL), (5, 'remove', '/codes/0', NULL, NULL),
  (6, 'replace', '/buyer/rank', NULL, 'null'), (7, 'test', '/id', NULL, 'id'))
SELECT o_orderkey AS doc_id, seq, op, path, "from",
  CASE WHEN value = 'id' THEN CASE WHEN o_orderkey % 11 = 0 THEN '-1' ELSE CAST(o_orderkey AS VARCHAR) END ELSE value END AS value
FROM orders, steps
"""

SQL["json_duplicate_keys"] = """
SELECT o_orderkey AS doc_id, '{"a":[' || o_custkey || ',' || o_orderkey || '],"b":0}' AS doc FROM orders
"""

SQL["patch_apply_own"] = f"""
WITH {DOCS}
SELECT doc_id, CASE WHEN o_orderkey % 7 = 0 THEN doc ELSE '{{"cents":' || cents * (o_orderkey % 5 + 2) || ',"codes":[' || o_custkey || ',' || o_orderkey ||
    '],"id":' || o_orderkey || ',"owner":{{"id":' || o_custkey || '}},"state":"' || o_orderstatus || '"}}' END AS doc,
  CASE WHEN o_orderkey % 7 = 0 THEN 'conflict' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 1::BIGINT END AS failed_seq
FROM docs
"""

# Snapshot diff


def diff_rows(columns: str, shapes: list[tuple[int, list[str]]]) -> str:
    parts = [f"SELECT doc_id, {ops} FROM docs WHERE o_orderkey % 5 = {k}" for k, rows in shapes for ops in rows]
    return f"WITH {DOCS}, ops AS ({' UNION ALL '.join(parts)}) SELECT {columns} FROM (SELECT * FROM ops) AS t({columns})"


SQL["snapshot_diff"] = diff_rows(
    "doc_id, seq, op, path, value",
    [
        (1, ["1, 'replace', '/cents', CAST(cents AS VARCHAR)", "2, 'replace', '/state', '\"Z\"'"]),
        (2, ["1, 'remove', '/owner', NULL", "2, 'add', '/buyer', owner"]),
        (3, ["1, 'add', '/codes/2', '1'", "2, 'add', '/codes/3', '{\"a/b\":2}'"]),
        (4, ["1, 'remove', '/codes/1', NULL", "2, 'remove', '/owner/rank', NULL", "3, 'add', '/last', CAST(o_orderkey AS VARCHAR)",
             "4, 'add', '/note', 'null'", "5, 'replace', '/cents', '[' || cents || ']'", "6, 'replace', '/codes/0', '-1'"]),
    ],
)

SQL["snapshot_diff_moves"] = diff_rows(
    'doc_id, seq, op, path, "from", value',
    [
        (1, ["1, 'replace', '/cents', NULL, CAST(cents AS VARCHAR)", "2, 'replace', '/state', NULL, '\"Z\"'"]),
        (2, ["1, 'move', '/buyer', '/owner', NULL"]),
        (3, ["1, 'add', '/codes/2', NULL, '1'", "2, 'add', '/codes/3', NULL, '{\"a/b\":2}'"]),
        (4, ["1, 'remove', '/owner/rank', NULL, NULL", "2, 'move', '/last', '/codes/1', NULL", "3, 'add', '/note', NULL, 'null'",
             "4, 'replace', '/cents', NULL, '[' || cents || ']'", "5, 'replace', '/codes/0', NULL, '-1'"]),
    ],
)

SQL["diff_roundtrip"] = "SELECT o_orderkey AS doc_id, 'ok' AS status, true AS same FROM orders"
SQL["diff_moves_roundtrip"] = SQL["diff_roundtrip"]

SQL["merged_replaces"] = f"""
WITH {LINES}, l AS (SELECT l_orderkey AS doc_id, n AS seq, CASE WHEN n % 2 = 1 THEN 'remove' ELSE 'add' END AS op,
    '/' || CASE WHEN l_returnflag = 'R' THEN 'a' ELSE CAST(n AS VARCHAR) END AS path FROM lines_n),
m AS (SELECT a.*, EXISTS (SELECT 1 FROM l b WHERE b.doc_id = a.doc_id AND b.seq = a.seq + 1 AND b.path = a.path AND a.op = 'remove') AS absorbed,
    EXISTS (SELECT 1 FROM l b WHERE b.doc_id = a.doc_id AND b.seq = a.seq - 1 AND b.path = a.path AND a.op = 'add') AS merged FROM l a)
SELECT doc_id, seq, CASE WHEN merged THEN 'replace' ELSE op END AS op, path FROM m WHERE NOT absorbed
"""

# Markup

LITERAL = "(?is)^(<(?:script|style)\\b[^<>]*>)(.*?)(</(?:script|style)\\s*>)?$"
TOKEN = (
    "(?i:<script\\b[^<>]*>)(?s:.*?)(?i:</script\\s*>)|(?i:<style\\b[^<>]*>)(?s:.*?)(?i:</style\\s*>)"
    "|<!--(?s:.*?)--\\s*>|<[?!][^>]*>|<>|</?[a-zA-Z][^<>]*>?|</[^<>]*>?|&#[0-9]+;?|&[a-zA-Z][-.a-zA-Z0-9]*;?|[^<&]+|[<&]"
)
TOKENS = f"""
edge AS (SELECT page_id, replace(html, '</article>', '<I CLASS=x data-n=''' || page_id || ''' hidden>&#65;&#300;&lt <u><></u></></b></q><?note ' || page_id || '></article>') AS html FROM pages),
found AS (SELECT page_id, regexp_extract_all(html, '{TOKEN}') AS t FROM edge),
cut AS (SELECT page_id, flatten(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '(?i)^<(?:script|style)\\b[^<>]*>')
    THEN list_filter([regexp_extract(x, '{LITERAL}', 1), regexp_extract(x, '{LITERAL}', 2), regexp_extract(x, '{LITERAL}', 3)], lambda y: y <> '')
    ELSE [x] END)) AS t FROM found),
rowed AS (SELECT page_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS raw FROM cut),
kinds AS (SELECT *, CASE WHEN starts_with(raw, '<!--') THEN 'comment' WHEN starts_with(raw, '<?') THEN 'instruction'
    WHEN starts_with(raw, '<!') THEN 'declaration' WHEN regexp_matches(raw, '^<[>a-zA-Z]') THEN 'start' WHEN starts_with(raw, '</') THEN 'end'
    WHEN regexp_matches(raw, '^&#[0-9]+;?$') THEN 'charref' WHEN regexp_matches(raw, '^&[a-zA-Z][-.a-zA-Z0-9]*;?$') THEN 'entityref' ELSE 'data' END AS kind FROM rowed),
named AS (SELECT *, CASE WHEN kind = 'start' AND raw <> '<>' THEN lower(regexp_extract(raw, '^<([a-zA-Z][-_.a-zA-Z0-9]*)', 1)) END AS own FROM kinds),
tokens AS (SELECT page_id, pos, kind, raw,
    CASE kind WHEN 'start' THEN last_value(own IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
      WHEN 'end' THEN lower(trim(regexp_extract(raw, '^</([^<>]*)', 1)))
      WHEN 'charref' THEN regexp_extract(raw, '([0-9]+)', 1) WHEN 'entityref' THEN regexp_extract(raw, '^&([-.a-zA-Z0-9]+)', 1) END AS tag,
    CASE kind WHEN 'data' THEN raw WHEN 'comment' THEN regexp_extract(raw, '(?s)^<!--(.*)-->$', 1)
      WHEN 'declaration' THEN raw[3:-2] WHEN 'instruction' THEN raw[3:-2]
      WHEN 'charref' THEN CASE raw WHEN '&#65;' THEN 'A' END
      WHEN 'entityref' THEN CASE regexp_extract(raw, '^&([-.a-zA-Z0-9]+)', 1) WHEN 'lt' THEN '<' WHEN 'gt' THEN '>' WHEN 'amp' THEN '&' WHEN 'quot' THEN '"' WHEN 'apos' THEN '''' END END AS data
  FROM named)
"""

SQL["markup_tokens"] = f"WITH {TOKENS} SELECT page_id, pos, kind, tag, data, raw FROM tokens"
SQL["start_tags"] = f"WITH {TOKENS} SELECT page_id, pos, tag, raw FROM tokens WHERE kind = 'start'"
SQL["end_tags"] = f"WITH {TOKENS} SELECT page_id, pos, tag FROM tokens WHERE kind = 'end'"
SQL["charrefs"] = f"WITH {TOKENS} SELECT page_id, pos, tag, data FROM tokens WHERE kind = 'charref'"
SQL["entityrefs"] = f"WITH {TOKENS} SELECT tag, data, count(*) AS n FROM tokens WHERE kind = 'entityref' GROUP BY ALL"
SQL["comments"] = f"WITH {TOKENS} SELECT page_id, pos, data FROM tokens WHERE kind = 'comment'"
SQL["declarations"] = f"WITH {TOKENS} SELECT page_id, pos, data FROM tokens WHERE kind IN ('declaration', 'instruction')"
SQL["text_runs"] = f"WITH {TOKENS} SELECT page_id, count(*) AS n, CAST(sum(length(data)) AS BIGINT) AS n_chars FROM tokens WHERE kind = 'data' GROUP BY page_id"
SQL["tag_census"] = f"""
WITH {TOKENS} SELECT tag, count(*) FILTER (WHERE kind = 'start') AS starts, count(*) FILTER (WHERE kind = 'end') AS ends
FROM tokens WHERE kind IN ('start', 'end') GROUP BY tag
"""
VOID = "('area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr')"
SQL["tag_balance"] = f"""
WITH {TOKENS} SELECT tag, count(*) FILTER (WHERE kind = 'start') AS starts, count(*) FILTER (WHERE kind = 'end') AS ends,
  count(*) FILTER (WHERE kind = 'start') - count(*) FILTER (WHERE kind = 'end') AS unclosed
FROM tokens WHERE kind IN ('start', 'end') AND tag NOT IN {VOID} GROUP BY tag
"""
SQL["tag_depth"] = f"""
WITH {TOKENS} SELECT page_id, pos, kind, tag, CAST(sum(CASE kind WHEN 'start' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS depth
FROM tokens WHERE kind IN ('start', 'end') AND tag NOT IN {VOID}
"""
SQL["attribute_rows"] = f"""
WITH {TOKENS},
inner_text AS (SELECT page_id, pos, tag, regexp_replace(raw, '^<(?:[a-zA-Z][-_.a-zA-Z0-9]*)?|>$', '', 'g') AS t FROM tokens WHERE kind = 'start'),
pairs AS (SELECT page_id, pos, tag, regexp_extract_all(t, '\\s*[a-zA-Z_][-:.a-zA-Z_0-9]*(?:\\s*=\\s*(?:''[^'']*''|"[^"]*"|[-a-zA-Z0-9./]*))?') AS p FROM inner_text),
one AS (SELECT page_id, pos, tag, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS n, trim(unnest(p)) AS a FROM pairs)
SELECT page_id, pos, tag, n, lower(regexp_extract(a, '^[^=]+', 0)) AS name,
  CASE WHEN contains(a, '=') THEN trim(regexp_extract(a, '=(.*)$', 1), '''"') ELSE a END AS value
FROM one
"""

STACK = f"""
{TOKENS.replace('WITH', '')},
moves AS (SELECT page_id, pos, kind, tag, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n
  FROM tokens WHERE kind IN ('start', 'end') AND tag NOT IN {VOID}),
walk(page_id, n, stack, pos, kind, tag, keep) AS (
  SELECT page_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), -1, '', '', 0 FROM pages
  UNION ALL
  SELECT w.page_id, m.n,
    CASE WHEN m.kind = 'start' THEN list_append(w.after, m.tag) ELSE w.after END, m.pos, m.kind, m.tag,
    CAST(CASE WHEN m.kind = 'start' THEN -1 WHEN m.tag = '' THEN len(w.after) - 1
      ELSE coalesce(list_max(list_filter(range(1, len(w.after) + 1), lambda i: w.after[i] = m.tag)), 0) - 1 END AS INTEGER)
  FROM (SELECT *, CASE WHEN kind = 'end' AND keep >= 0 THEN stack[1:keep] ELSE stack END AS after FROM walk) w
  JOIN moves m ON m.page_id = w.page_id AND m.n = w.n + 1),
events AS (
  SELECT page_id, pos, tag, 'open' AS action, CAST(len(stack) AS INTEGER) AS depth FROM walk WHERE kind = 'start'
  UNION ALL SELECT page_id, pos, tag, 'unbalanced', CAST(len(stack) AS INTEGER) FROM walk WHERE kind = 'end' AND keep < 0
  UNION ALL SELECT page_id, pos, stack[i], CASE WHEN i = keep + 1 THEN 'close' ELSE 'implied_close' END, CAST(i - 1 AS INTEGER)
    FROM (SELECT *, unnest(range(keep + 1, len(stack) + 1)) AS i FROM walk WHERE kind = 'end' AND keep >= 0))
"""
SQL["close_events"] = f"WITH RECURSIVE {STACK} SELECT page_id, pos, tag, action, depth FROM events"
SQL["unbalanced_tags"] = f"WITH RECURSIVE {STACK} SELECT page_id, pos, tag, depth FROM events WHERE action = 'unbalanced'"

SQL["sql_markup_tokens"] = """
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<!--(?s:.*?)--\\s*>|<[?!][^>]*>|<>|</?[a-zA-Z][^<>]*>?|</[^<>]*>?|&#[0-9]+;?|&[a-zA-Z][-.a-zA-Z0-9]*;?|[^<&]+|[<&]')) AS raw FROM pages)
SELECT page_id, count(*) AS n, CAST(sum(length(raw)) AS BIGINT) AS n_chars FROM t GROUP BY page_id
"""
SQL["chunk_reassembly"] = "SELECT page_id, md5(html) AS digest FROM pages"
SQL["markup_stream_tokens"] = f"""
WITH {TOKENS.replace(TOKENS[TOKENS.index("edge AS"):TOKENS.index("found AS")], "edge AS (SELECT page_id, html FROM pages)," + chr(10))}
SELECT page_id, kind, count(*) AS n FROM tokens GROUP BY ALL
"""

_PLAIN_TOKENS = TOKENS.replace(TOKENS[TOKENS.index("edge AS"):TOKENS.index("found AS")], "edge AS (SELECT page_id, html FROM pages)," + chr(10))
SQL["short_tag_tokens"] = f"""
WITH {_PLAIN_TOKENS}, both_kinds AS (
  SELECT page_id, kind, tag, data FROM tokens
  UNION ALL SELECT page_id, 'start', 'q1', NULL FROM pages
  UNION ALL SELECT page_id, 'data', NULL, 'page ' || page_id FROM pages
  UNION ALL SELECT page_id, 'end', 'q1', NULL FROM pages
)
SELECT page_id, kind, tag, count(*) AS n, CAST(sum(length(data)) AS BIGINT) AS n_chars FROM both_kinds GROUP BY ALL
"""
SQL["own_entities"] = f"WITH {TOKENS} SELECT tag, '{{' || tag || '}}' AS data, count(*) AS n FROM tokens WHERE kind = 'entityref' GROUP BY ALL"

# Segmentation

LATIN = "abcdefghijklmnopqrstuvwxyz"
MIXED = "あいうえかきけしとのカタト東京大学日本人一二三中国語"
SPACED = f"""
spaced AS (SELECT doc_id, translate(trim(regexp_replace(lower(text), '[ \\t\\r\\n\\f]+', ' ', 'g')), '{LATIN}', '{MIXED}') AS text FROM documents)
"""


def class_of(char: str) -> str:
    return f"""CASE WHEN {char} IN ('B3','B2','B1','E1','E2','E3') THEN 'O'
      WHEN regexp_matches({char}, '^[一二三四五六七八九十百千万億兆]') THEN 'M' WHEN regexp_matches({char}, '^[一-龠々〆ヵヶ]') THEN 'H'
      WHEN regexp_matches({char}, '^[ぁ-ん]') THEN 'I' WHEN regexp_matches({char}, '^[ァ-ヺーｦ-ﾞ]') THEN 'K'
      WHEN regexp_matches({char}, '^[a-zA-Zａ-ｚＡ-ＺÀ-ÖØ-öø-ÿĀ-ſ]') THEN 'A' WHEN regexp_matches({char}, '^[0-9０-９]') THEN 'N' ELSE 'O' END"""


SQL["char_classes"] = f"""
WITH {SPACED}, chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM spaced),
counts AS (SELECT doc_id, c, count(*) AS n FROM chars GROUP BY ALL)
SELECT doc_id, {class_of('c')} AS class, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL
"""

# One row per gap: six characters (w1..w6), six classes (c1..c6), three decisions (p1..p3) and the mark b.
GAPS = f"""
{SPACED},
chars AS (SELECT doc_id, string_split(replace(text, ' ', ''), '') AS s,
    list_transform(regexp_extract_all(text, ' *[^ ]'), lambda x: CASE WHEN starts_with(x, ' ') THEN 'B' ELSE 'O' END) AS m FROM spaced),
alphabet AS (SELECT c, {class_of('c')} AS k FROM (SELECT DISTINCT unnest(s) AS c FROM chars)),
places AS (SELECT doc_id, unnest(list_concat(['B3','B2','B1'], s, ['E1','E2','E3'])) AS c, unnest(list_concat(['U','U','U','U'], m[2:], ['U','U','U'])) AS mark,
    generate_subscripts(list_concat(['B3','B2','B1'], s, ['E1','E2','E3']), 1) - 4 AS pos, len(s) AS n FROM chars WHERE len(s) > 0),
classed AS (SELECT p.*, coalesce(a.k, 'O') AS k FROM places p LEFT JOIN alphabet a ON a.c = p.c),
lagged AS (SELECT doc_id, pos, n, mark AS b,
    lag(c, 3) OVER w AS w1, lag(c, 2) OVER w AS w2, lag(c, 1) OVER w AS w3, c AS w4, lead(c, 1) OVER w AS w5, lead(c, 2) OVER w AS w6,
    lag(k, 3) OVER w AS c1, lag(k, 2) OVER w AS c2, lag(k, 1) OVER w AS c3, k AS c4, lead(k, 1) OVER w AS c5, lead(k, 2) OVER w AS c6,
    lag(mark, 3) OVER w AS p1, lag(mark, 2) OVER w AS p2, lag(mark, 1) OVER w AS p3
  FROM classed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
gaps AS (SELECT * FROM lagged WHERE pos >= 1 AND pos < n)
"""

CHAR_KEYS = {
    "UW1": "w1", "UW2": "w2", "UW3": "w3", "UW4": "w4", "UW5": "w5", "UW6": "w6", "BW1": "w2||w3", "BW2": "w3||w4", "BW3": "w4||w5",
    "TW1": "w1||w2||w3", "TW2": "w2||w3||w4", "TW3": "w3||w4||w5", "TW4": "w4||w5||w6",
}
CLASS_KEYS = {k.replace("W", "C"): v.replace("w", "c") for k, v in CHAR_KEYS.items()}
HISTORY_KEYS = [
    ("UP1", "p1"), ("UP2", "p2"), ("UP3", "p3"), ("BP1", "p1||p2"), ("BP2", "p2||p3"), ("UQ1", "p1||c1"), ("UQ2", "p2||c2"), ("UQ1", "p3||c3"),
    ("BQ1", "p2||c2||c3"), ("BQ2", "p2||c3||c4"), ("BQ3", "p3||c2||c3"), ("BQ4", "p3||c3||c4"),
    ("TQ1", "p2||c1||c2||c3"), ("TQ2", "p2||c2||c3||c4"), ("TQ3", "p3||c1||c2||c3"), ("TQ4", "p3||c2||c3||c4"),
]


def feature_counts(source: str, keys, columns: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, {k} AS key, {columns} FROM {source} GROUP BY 1, 2" for f, k in keys)


SQL["segment_features"] = f"""
WITH {GAPS}
SELECT feature, key AS feature_key, n FROM ({feature_counts('gaps', [*CHAR_KEYS.items(), *CLASS_KEYS.items()], 'count(*) AS n')})
"""

MARKS = "count(*) FILTER (WHERE b = 'B') AS nb, count(*) FILTER (WHERE b = 'O') AS no"
WEIGHTS = f"""
{GAPS},
counts_raw AS ({feature_counts('gaps', [*CHAR_KEYS.items(), *CLASS_KEYS.items(), *HISTORY_KEYS], MARKS)}),
counts AS (SELECT feature, key, sum(nb) AS nb, sum(no) AS no FROM counts_raw GROUP BY ALL),
prior AS (SELECT ln((CAST(count(*) FILTER (WHERE b = 'B') AS DOUBLE) + 1.0) / (CAST(count(*) FILTER (WHERE b = 'O') AS DOUBLE) + 1.0)) AS base FROM gaps),
weights AS (SELECT feature, key, CAST(round((ln((CAST(nb AS DOUBLE) + 1.0) / (CAST(no AS DOUBLE) + 1.0)) - base) * 100) AS INTEGER) AS weight FROM counts, prior
  UNION ALL SELECT 'BIAS', '', CAST(round(base * 100) AS INTEGER) FROM prior)
"""
SQL["segment_weights"] = f"WITH {WEIGHTS} SELECT feature, key, weight FROM weights"


def static_sum() -> str:
    joins, total = [], ["(SELECT weight FROM weights WHERE feature = 'BIAS')"]
    for f, k in [*CHAR_KEYS.items(), *CLASS_KEYS.items()]:
        joins.append(f"LEFT JOIN weights t{f} ON t{f}.feature = '{f}' AND t{f}.key = {k}")
        total.append(f"coalesce(t{f}.weight, 0)")
    return f"SELECT doc_id, pos, {' + '.join(total)} AS static FROM gaps {' '.join(joins)}"


SQL["segment_static_scores"] = f"""
WITH {WEIGHTS}, scored AS ({static_sum()})
SELECT doc_id, count(*) AS n_gaps, CAST(sum(static) AS BIGINT) AS total, CAST(sum(static * pos) AS BIGINT) AS moment FROM scored GROUP BY doc_id
"""


def history_sum() -> str:
    joins, total = [], []
    for i, (f, k) in enumerate(HISTORY_KEYS):
        joins.append(f"LEFT JOIN weights h{i} ON h{i}.feature = '{f}' AND h{i}.key = {k}")
        total.append(f"coalesce(h{i}.weight, 0)")
    return f"SELECT c1||c2||c3||c4 AS c4, state, CAST({' + '.join(total)} AS INTEGER) AS score FROM grid {' '.join(joins)}"


SQL["segment_history_scores"] = f"""
WITH {WEIGHTS}, k AS (SELECT unnest(['M','H','I','K','A','N','O']) AS k),
states(state, s) AS (VALUES (0,'UUU'),(1,'UUB'),(2,'UUO'),(3,'UBB'),(4,'UBO'),(5,'UOB'),(6,'UOO'),
  (7,'BBB'),(8,'BBO'),(9,'BOB'),(10,'BOO'),(11,'OBB'),(12,'OBO'),(13,'OOB'),(14,'OOO')),
grid AS (SELECT a.k AS c1, b.k AS c2, c.k AS c3, d.k AS c4, state, s[1] AS p1, s[2] AS p2, s[3] AS p3 FROM k a, k b, k c, k d, states)
{history_sum()}
"""

# Each gap lists what it does in every state; a text is folded along them, its decisions so far as one string.
SQL["segment_tokens"] = f"""
WITH {WEIGHTS}, k AS (SELECT unnest(['M','H','I','K','A','N','O']) AS k),
states(state, s) AS (VALUES (0,'UUU'),(1,'UUB'),(2,'UUO'),(3,'UBB'),(4,'UBO'),(5,'UOB'),(6,'UOO'),
  (7,'BBB'),(8,'BBO'),(9,'BOB'),(10,'BOO'),(11,'OBB'),(12,'OBO'),(13,'OOB'),(14,'OOO')),
grid AS (SELECT a.k AS c1, b.k AS c2, c.k AS c3, d.k AS c4, state, s[1] AS p1, s[2] AS p2, s[3] AS p3 FROM k a, k b, k c, k d, states),
history AS (SELECT c4, list(score ORDER BY state) AS scores FROM ({history_sum()}) GROUP BY c4),
scored AS ({static_sum()}),
steps AS (
  SELECT g.doc_id, g.pos, array_to_string(list_transform(h.scores, lambda x: CASE WHEN s.static + x > 0 THEN 'B' ELSE 'O' END), '') AS step
  FROM gaps g JOIN scored s ON s.doc_id = g.doc_id AND s.pos = g.pos JOIN history h ON h.c4 = g.c1 || g.c2 || g.c3 || g.c4
), folded AS (
  SELECT doc_id, list_reduce(['UUU'] || list(step ORDER BY pos), lambda past, step:
    past || step[list_position(['UUU','UUB','UUO','UBB','UBO','UOB','UOO','BBB','BBO','BOB','BOO','OBB','OBO','OOB','OOO'], right(past, 3))]) AS past
  FROM steps GROUP BY doc_id
), marked AS (
  SELECT c.doc_id, unnest(c.s) AS c, generate_subscripts(c.s, 1) AS pos, unnest(string_split('B' || coalesce(substr(f.past, 4), ''), '')) AS b
  FROM chars c LEFT JOIN folded f ON f.doc_id = c.doc_id WHERE len(c.s) > 0
), runs AS (SELECT *, sum(CASE WHEN b = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked)
SELECT doc_id, CAST(run - 1 AS INTEGER) AS pos, string_agg(c, '' ORDER BY pos) AS token FROM runs GROUP BY doc_id, run
"""

SQL["segment_concatenation"] = f"WITH {SPACED} SELECT doc_id, md5(replace(text, ' ', '')) AS digest FROM spaced"

# File requests

SQL["file_status"] = """
SELECT page_id, CASE WHEN page_id % 13 = 0 OR page_id % 10 = 3 THEN NULL ELSE
    CASE page_id % 10 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 5 THEN 400 WHEN 8 THEN 200 WHEN 9 THEN 403 ELSE 404 END END AS status,
  CASE WHEN page_id % 13 = 0 THEN 'invalid_method' WHEN page_id % 10 = 3 THEN 'host_not_permitted' END AS error
FROM pages
"""

SQL["topic_by_model"] = """
WITH t AS (
  SELECT doc_id, text, [length(text) - length(replace(text, c, '')) FOR c IN ['a', 'e', 'i', 'o', 'u', 'd', 'n', 's', 't']] AS n
  FROM documents
)
SELECT doc_id, CASE WHEN doc_id % 50 = 0 OR text = '' THEN 'Unknown' ELSE
  ['Politics', 'Technology', 'Health', 'Entertainment', 'Sports', 'Finance', 'Science', 'World', 'Business'][list_position(n, list_max(n))] END AS topic
FROM t
"""

SQL["patch_apply_dirty"] = """
WITH l AS (SELECT l_orderkey AS k, count(*) AS c FROM lineitem GROUP BY 1),
members AS (
  SELECT k, string_agg('"m' || i || '":' || CASE WHEN k % 8 = 6 THEN '12345678901234567.89' ELSE CAST(i AS VARCHAR) END || ',', '' ORDER BY 'm' || i) AS added
  FROM (SELECT k, unnest(generate_series(1, c)) AS i FROM l) GROUP BY k
), d AS (
  SELECT o_orderkey AS k, c, added, CASE WHEN c IS NULL OR o_orderkey % 8 = 5 THEN 0 ELSE o_orderkey % 8 END AS fault,
    CASE WHEN o_orderkey % 8 = 5 THEN '' ELSE coalesce(added, '') END AS more
  FROM orders LEFT JOIN l ON o_orderkey = l.k LEFT JOIN members m ON o_orderkey = m.k
), r AS (
  SELECT k AS doc_id,
    CASE WHEN k % 6 = 5 THEN NULL ELSE '{"k":' || k || ',' || CASE WHEN fault IN (0, 2, 6) THEN more WHEN fault = 4 AND c = 1 THEN '"m":1,' ELSE '' END
      || '"n":12345678901234567.89,"s":"P"}' END AS doc,
    CASE WHEN k % 6 = 5 OR fault IN (1, 3) OR (fault = 4 AND c > 1) THEN 'invalid' WHEN fault = 7 THEN 'conflict' ELSE 'ok' END AS status,
    CASE WHEN k % 6 = 5 THEN NULL WHEN fault = 1 THEN 1 WHEN fault = 4 AND c > 1 THEN 7 WHEN fault = 7 THEN 1 END AS failed_seq
  FROM d
)
SELECT doc_id, doc, status, CAST(failed_seq AS BIGINT) AS failed_seq FROM r
UNION ALL
SELECT CASE WHEN k % 8 = 5 THEN -k ELSE k END, NULL, 'orphan',
  CASE k % 8 WHEN 2 THEN -99 WHEN 3 THEN CASE WHEN c > 1 THEN 2 END WHEN 4 THEN 7 ELSE 1 END
FROM l WHERE k % 8 = 5 OR k NOT IN (SELECT o_orderkey FROM orders)
"""

SQL["rest_is_text"] = """
SELECT page_id, CAST(regexp_matches(html, '<article[^<>]*>') AS BIGINT) AS n_articles,
  md5(CASE WHEN regexp_matches(html, '<article[^<>]*>') THEN regexp_extract(html, '(?s)<article[^<>]*>(.*)$', 1)
    ELSE regexp_extract(html, '[^<>]*$', 0) END) AS rest_md5
FROM pages
"""
