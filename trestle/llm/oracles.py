"""DuckDB's SQL for queries of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

SPACED = r"[^\x20\x09-\x0D]+"
LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(pattern: str = SPACED, text: str = "coalesce(text, '')") -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_words()} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id),
kept AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) END AS kept FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (
  SELECT page_id, payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 10 * (k // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31 AS INT) + 1, 1) FOR k IN range(32)], '') AS payload_digest,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)), '^www[.]', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*?:([0-9]+)(?:[/?#]|$)', 1) AS port,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path,
    lower(regexp_extract(url, '[?]([^#]*)', 1)) AS query,
    strftime(TIMESTAMP '2000-01-01' + to_seconds(page_id % 1073741824), '%Y%m%d%H%M%S') AS timestamp
  FROM p),
r AS (
  SELECT page_id, payload_bytes, payload_digest, timestamp, min(page_id) OVER (PARTITION BY payload_digest) AS first,
    array_to_string(list_reverse(string_split(host, '.')), ',') || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || ')' || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS url_key
  FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, url_key, timestamp, row_number() OVER (ORDER BY url_key, timestamp, page_id) - 1 AS position
FROM r
"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(text=LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, gram FROM (
  SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

CONTAMINATED = f"""
WITH d AS (SELECT doc_id, {_words(LETTERED, LOWER)} AS w FROM documents),
b AS (SELECT item_id, {_words(LETTERED, LOWER)} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
found AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, found.n, item_id FROM found JOIN windows ON found.n = windows.n AND found.gram = windows.gram),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUALITY_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_words()} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{SPACED}')) AS x FROM d),
counted AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(x) - len(list_distinct(x)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
"""


QUOTATIONS = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
x AS (SELECT conv_id, turn, i, regexp_replace(ls[i], '\r+$', '') AS line FROM (SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM m)),
y AS (SELECT conv_id, turn, i, line, regexp_extract(line, '^[ \t]*(?:>[ \t]?)+') AS mark FROM x),
z AS (SELECT conv_id, turn, i, len(regexp_extract_all(mark, '>')) AS level, substr(line, length(mark) + 1) AS rest FROM y),
l AS (SELECT *, lead(level, 1, 0) OVER w AS next, lead(level, 2, 0) OVER w AS second, lag(level, 1, 0) OVER w AS before FROM z WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
own AS (SELECT conv_id, turn, i, rest FROM l WHERE level = 0 AND NOT ((next > 0 OR second > 0) AND regexp_matches(regexp_replace(rest, '^\s+|\s+$', '', 'g'),
  '(?i)^(?:On\b.*\bwrote:|.{1,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s?:|-{2,}\s*(?:Original|Forwarded) Message\s*-{2,})\s*$'))),
-- a passage: consecutive lines of one level; the message's own lines are passage 0
lines AS (
  SELECT conv_id, turn, 0 AS level, 0 AS passage, i, rest FROM own
  UNION ALL SELECT conv_id, turn, level, passage, i, rest FROM (SELECT *, sum(CASE WHEN level <> before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS passage FROM l) WHERE level > 0),
marked AS (SELECT *, trim(regexp_replace(lower(rest), '\s+', ' ', 'g')) AS n, sum(CASE WHEN trim(regexp_replace(rest, '\s+', ' ', 'g')) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn, level, passage ORDER BY i) AS paragraph FROM lines),
pieces AS (
  SELECT conv_id, turn, level, passage, 0 AS kind, string_agg(n, ' ' ORDER BY i) FILTER (n <> '') AS n FROM marked GROUP BY conv_id, turn, level, passage
  UNION ALL SELECT conv_id, turn, level, passage, 1, string_agg(n, ' ' ORDER BY i) FILTER (n <> '') FROM marked GROUP BY conv_id, turn, level, passage, paragraph
  UNION ALL SELECT conv_id, turn, level, passage, 2, n FROM marked),
kept AS (SELECT conv_id, turn, level, passage, min(kind) AS kind, n FROM pieces WHERE n <> '' GROUP BY conv_id, turn, level, passage, n),
best AS (
  SELECT q.conv_id, q.turn, arg_min(w.turn, {'level': q.level, 'kind': q.kind, 'short': -length(q.n), 'back': -w.turn}) AS writer
  FROM kept q JOIN kept w ON q.conv_id = w.conv_id AND q.n = w.n AND w.turn < q.turn WHERE q.level > 0 AND w.level = 0 GROUP BY q.conv_id, q.turn),
links AS (
  SELECT m.conv_id, m.turn, coalesce(writer, previous) AS parent_turn, CASE WHEN writer IS NOT NULL THEN 'quote' WHEN previous IS NOT NULL THEN 'previous' ELSE 'root' END AS link
  FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM m) m LEFT JOIN best USING (conv_id, turn)),
tree AS (
  SELECT conv_id, turn, [turn] AS path FROM links WHERE parent_turn IS NULL
  UNION ALL SELECT links.conv_id, links.turn, list_append(path, links.turn) FROM tree JOIN links ON links.conv_id = tree.conv_id AND links.parent_turn = tree.turn),
bodies AS (SELECT conv_id, turn, string_agg(rest, chr(10) ORDER BY i) AS body FROM own GROUP BY conv_id, turn),
deep AS (SELECT conv_id, turn, max(level) AS lines, max(level) FILTER (n <> '') AS depth FROM marked GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, role, parent_turn, link, row_number() OVER (PARTITION BY m.conv_id ORDER BY path) - 1 AS position, CAST(len(path) - 1 AS BIGINT) AS depth, CAST(coalesce(deep.depth, 0) AS BIGINT) AS depth_quoted,
  CASE WHEN coalesce(deep.lines, 0) = 0 THEN text ELSE trim(regexp_replace(coalesce(body, ''), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) END AS text
FROM m JOIN links USING (conv_id, turn) JOIN tree USING (conv_id, turn) LEFT JOIN bodies USING (conv_id, turn) LEFT JOIN deep USING (conv_id, turn)
"""


REPLIES = f"""
SELECT conv_id, CAST(position // 100 AS BIGINT) AS part, count(*) AS n_messages, string_agg(coalesce(role, '') || ': ' || text, chr(10) || chr(10) ORDER BY position) AS text
FROM ({QUOTATIONS}) GROUP BY conv_id, position // 100
"""


def _secrets() -> str:
    from . import secretscan as S

    spans = []
    for rank, pattern in enumerate((S.ASSIGN, S.ACCESS, S.HEX)):
        p = "'" + pattern.replace("'", "''") + "'"
        long_enough = f"length(regexp_extract(f[i], {p}, 2)) >= 8" if rank == 0 else "true"
        # the pieces between the matches give their places
        split = f"SELECT doc_id, f, g, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {p}) AS f, string_split_regex(coalesce(text, ''), {p}) AS g FROM documents)"
        placed = f"SELECT doc_id, f, i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM ({split})"
        spans.append(f"SELECT doc_id, {rank} AS rank, start, '{S.KINDS[rank]}:' || start || ':' || (start + length(f[i])) AS span FROM ({placed}) WHERE {long_enough}")
    found = " UNION ALL ".join(spans)
    listed = f"SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, string_agg(span, ',' ORDER BY start, rank) AS spans FROM ({found}) GROUP BY doc_id"
    return f"SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM documents LEFT JOIN ({listed}) USING (doc_id)"


SQL = {"op5_substring": SUBSTRING, "op6_warc": WARC, "op7_near": NEAR, "op8_quotations": QUOTATIONS, "op8_replies": REPLIES, "op9_decontaminate": CONTAMINATED, "secrets_base": _secrets(), "quality_base": QUALITY_BASE}
