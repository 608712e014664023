"""SQL twins of the queries that SQL can express, for an independent engine.

Written from what each query returns; chunks, stretches of time and cells, by which the
operators spread their work, have no part here.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: str) -> str:
    return f"CASE WHEN strpos(COALESCE({url}, ''), '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"


def _host(rest: str) -> str:
    return f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


# longest first
_RULES = [
    ("www.example.com", "/en/", "allow"),
    ("example.com", "/en/", "block"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
    ("com", "/", "allow"),
]
_RULE = " ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _RULES)
_RULED = " ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _RULES)


def _ranked(name: str, source: str, target: str, seeds: str) -> str:
    """CTEs: a personalised PageRank; the last, with host and rank, is ``name``.

    What restarts send is followed link by link until a host gets less than 1e-15 of it;
    a host's rank is what came to it of what came to all.
    """
    return f"""{name}_share AS (SELECT {source} AS host, {target} AS target,
  links / SUM(links) OVER (PARTITION BY {source}) AS share FROM edges),
{name}_sent AS (
  SELECT 0 AS n, host, seed / SUM(seed) OVER () AS mass FROM ({seeds})
  UNION ALL
  SELECT r.n + 1, s.target, 0.85 * SUM(r.mass * s.share) FROM {name}_sent r JOIN {name}_share s ON s.host = r.host
  GROUP BY r.n, s.target HAVING SUM(r.mass * s.share) > 1e-15),
{name} AS (SELECT host, SUM(mass) / SUM(SUM(mass)) OVER () AS rank FROM {name}_sent GROUP BY host)"""


_LINK_GRAPH = f"""WITH RECURSIVE placed AS (
  SELECT page_id, html, {_host("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, html, {_rest("url")} AS rest FROM pages)),
judged AS (SELECT *, CASE {_RULE} END AS rule, CASE {_RULED} END AS ruled FROM placed),
found AS (
  SELECT host, unnest(regexp_extract_all(html,
    '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]*)', 1)) AS link FROM placed),
linked AS (
  SELECT host AS source, {_host("rest")} AS target
  FROM (SELECT host, substr(link, strpos(link, '//') + 2) AS rest FROM found)),
edges AS (
  SELECT source, target, CAST(COUNT(*) AS DOUBLE) AS links FROM linked
  WHERE source <> target AND source <> '' AND target <> '' GROUP BY source, target),
hosts AS (
  SELECT host, COUNT(*) AS pages, COUNT(*) FILTER (ruled = 'allow') AS allowed,
    COUNT(*) FILTER (ruled = 'block') AS blocked FROM judged WHERE host <> '' GROUP BY host),
{_ranked("trust", "source", "target", "SELECT host, CAST(allowed AS DOUBLE) AS seed FROM hosts WHERE allowed > 0 AND blocked = 0")},
{_ranked("distrust", "target", "source", "SELECT host, CAST(blocked AS DOUBLE) AS seed FROM hosts WHERE blocked = pages")}
SELECT j.page_id, j.host, j.path, j.rule,
  COALESCE(j.ruled, CASE WHEN d.rank - COALESCE(t.rank, 0) > 1e-9 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN trust t ON t.host = j.host LEFT JOIN distrust d ON d.host = j.host"""

_SCHEDULE = """WITH sized AS (
  SELECT row_number() OVER () AS row, doc_id, source,
    COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
totals AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
    CAST(source_size AS DOUBLE) * 3 AS cap, SUM(CAST(source_size AS DOUBLE)) OVER () AS whole FROM totals),
levels AS (
  SELECT *, (whole - COALESCE(SUM(cap) OVER early, 0.0))
    / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER early, 0.0)) AS level FROM weighed
  WINDOW early AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shared AS (SELECT *, LEAST(cap, MAX(level) OVER () * weight) AS target FROM levels),
edges AS (
  SELECT *, CASE WHEN n = MAX(n) OVER () THEN 2147483648
    ELSE CAST(FLOOR(SUM(target) OVER (ORDER BY n) / SUM(target) OVER () * 2147483648) AS BIGINT) END AS high
  FROM shared),
plan AS (SELECT *, COALESCE(LAG(high) OVER (ORDER BY n), 0) AS low FROM edges),
points AS (
  SELECT (i % 2147483648) * 1327217885 % 2147483648 AS point
  FROM range((SELECT CAST((SUM(size) + 127) // 128 AS BIGINT) FROM sized)) r(i)),
owned AS (
  SELECT n, COUNT(*) AS slots FROM points JOIN plan ON point >= low AND point < high GROUP BY n),
known AS (
  SELECT s.row, s.doc_id, s.size, p.n, p.source_size, p.target, COALESCE(o.slots, 0) * 128 AS reach
  FROM sized s JOIN plan p ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN owned o ON o.n = p.n),
drawn AS (
  SELECT *, CONCAT(CAST(round AS STRING), ':', COALESCE(CAST(doc_id AS STRING), 'null')) AS draw
  FROM known, (VALUES (0), (1), (2)) r(round)),
placed AS (
  SELECT *, round * source_size + COALESCE(SUM(size) OVER (
    PARTITION BY n, round
    ORDER BY CAST('0x' || substr(md5(draw), 1, 8) AS BIGINT) & 2147483647, draw, size, row
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM drawn)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(SUM(GREATEST(0, LEAST(start + size, reach) - start)) AS BIGINT) AS taken
FROM placed GROUP BY row, doc_id, size, source_size, target"""

# a url by the rules of http: scheme, authority, path, query, each cut where the next begins
_REVISITS = """WITH trimmed AS (
  SELECT page_id, html, regexp_replace(translate(url, concat(chr(9), chr(10), chr(13)), ''),
    '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS url FROM pages WHERE page_id IS NOT NULL),
schemed AS (
  SELECT *, strpos(url, '://') AS colon, split_part(url, '#', 1) AS whole FROM trimmed),
parts AS (
  SELECT *, regexp_full_match(left(url, colon - 1), '[A-Za-z][A-Za-z0-9+.-]*') AS proper,
    lower(left(url, colon - 1)) AS scheme, split_part(substr(whole, colon + 3), '?', 1) AS place,
    substr(whole, colon + 3) AS rest FROM schemed),
hosted AS (
  SELECT *, lower(split_part(place, '/', 1)) AS authority, substr(place, length(split_part(place, '/', 1)) + 1) AS path,
    CASE WHEN strpos(rest, '?') > 0 THEN substr(rest, strpos(rest, '?') + 1) ELSE '' END AS asked FROM parts),
keyed AS (
  SELECT *, CASE WHEN scheme = 'http' AND ends_with(authority, ':80') THEN left(authority, -3)
      WHEN scheme = 'https' AND ends_with(authority, ':443') THEN left(authority, -4) ELSE authority END AS served,
    list_sort([p for p in string_split(asked, '&')
      if p <> '' AND NOT regexp_matches(p, '^(?:utm_[^=&]*|ref|fbclid|gclid)(?:=|$)')]) AS query FROM hosted),
named AS (
  SELECT *, CASE WHEN starts_with(served, 'www.') THEN substr(served, 5) ELSE served END AS host FROM keyed),
visits AS (
  SELECT page_id, html, page_id * 977 % 8640000 AS ts,
    CASE WHEN colon > 1 AND proper AND host <> '' THEN CONCAT(host, rtrim(path, '/'),
      CASE WHEN len(query) > 0 THEN CONCAT('?', array_to_string(query, '&')) ELSE '' END) END AS url_key,
    CONCAT('"', substr(md5(html), 1, 12), '"') AS etag, page_id // 100 AS day FROM named),
revisits AS (
  SELECT page_id, url_key, page_id * 2 + 1 AS capture_id, day,
    CASE WHEN page_id % 7 = 3 THEN ts - 500 ELSE ts + 86400 * (page_id % 4) END AS ts,
    CASE WHEN page_id % 5 = 2 THEN '"other"' WHEN page_id % 3 = 0 THEN NULL ELSE etag END AS told FROM visits),
latest AS (
  SELECT r.capture_id, arg_max(f.page_id, (f.ts, f.page_id)) AS page_id
  FROM revisits r JOIN visits f ON f.url_key = r.url_key AND f.ts <= r.ts GROUP BY r.capture_id),
met AS (
  SELECT r.capture_id, r.url_key, r.ts, f.page_id * 2 AS response_id, f.html, f.etag,
    CASE WHEN f.page_id IS NULL THEN 'no_response'
      WHEN r.told IS NOT NULL AND r.told IS DISTINCT FROM f.etag THEN 'mismatch'
      WHEN r.told IS NULL AND r.day <> f.day THEN 'mismatch' ELSE 'resolved' END AS status
  FROM revisits r LEFT JOIN latest l ON l.capture_id = r.capture_id LEFT JOIN visits f ON f.page_id = l.page_id)
SELECT capture_id, url_key, ts AS "at", response_id, status,
  CASE WHEN status = 'resolved' THEN md5(html) END AS body_md5,
  CASE WHEN status = 'resolved' THEN CONCAT('cache-control=max-age=60;content-length=', length(html),
    ';content-type=text/html;date=', ts, ';etag=', etag) END AS headers
FROM met"""

# Roles a turn may take, by the state before it; inserts between turns, never more than two.
_TURNS = """WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS entries),
original AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS key FROM conversations),
hashed AS (
  SELECT o.*, xor(list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::UBIGINT)),
      lambda c, b: xor(c >> 8, t.entries[1 + (xor(c, b) & 255)::INTEGER])), 4294967295::UBIGINT) % 20 AS kind
  FROM original o, crc_table t),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) copy(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
placed AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
faulty AS (
  SELECT *, CASE WHEN words = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(words, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM told),
inserts(state, made, middle, cost, written) AS (VALUES
  (0, '', 0, 0, []), (0, 'I', 2, 2, ['user:']), (0, 'II', 3, 4, ['user:', 'assistant:']),
  (1, '', 1, 0, []), (1, 'I', 2, 2, ['user:']), (1, 'II', 3, 4, ['user:', 'assistant:']),
  (2, '', 2, 0, []), (2, 'I', 3, 2, ['assistant:']),
  (3, '', 3, 0, []), (3, 'I', 2, 2, ['user:'])),
takes(middle, role, initial, state) AS (VALUES
  (0, 'system', 's', 1), (0, 'user', 'u', 2), (1, 'user', 'u', 2), (3, 'user', 'u', 2), (2, 'assistant', 'a', 3)),
edits AS (
  SELECT f.conv_id, f.i, n.middle, 'D' AS edit, 3 AS cost, n.middle AS state, []::VARCHAR[] AS written
  FROM faulty f, (SELECT DISTINCT middle FROM inserts) n
  UNION ALL
  SELECT f.conv_id, f.i, t.middle, CASE WHEN f.initial = t.initial THEN 'K' ELSE 'R' END,
    CASE WHEN f.initial = t.initial THEN 0 ELSE 2 END + (f.fault = 't')::INTEGER, t.state,
    [concat(CASE WHEN f.initial = t.initial THEN f.role ELSE t.role END, ':', f.text)]
  FROM faulty f, takes t WHERE f.fault NOT IN ('b', 'd') AND (f.initial = t.initial OR t.initial <> 's')),
best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state,
    {'cost': 0::BIGINT, 'audit': '', 'written': []::VARCHAR[]} AS way FROM damaged
  UNION ALL
  SELECT b.conv_id, e.i, e.state, min({
    'cost': (b.way).cost + n.cost + e.cost, 'audit': concat((b.way).audit, n.made, e.edit),
    'written': list_concat((b.way).written, list_concat(n.written, e.written))}) AS way
  FROM best b JOIN inserts n ON n.state = b.state
    JOIN edits e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 AND e.middle = n.middle
  GROUP BY b.conv_id, e.i, e.state),
ended AS (
  SELECT b.conv_id, min({
    'cost': (b.way).cost + n.cost, 'audit': concat((b.way).audit, n.made),
    'written': list_concat((b.way).written, n.written)}) AS way
  FROM best b JOIN (SELECT conv_id, count(*) AS turns FROM damaged GROUP BY conv_id) c
      ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.turns = b.i
    JOIN inserts n ON n.state = b.state WHERE n.middle IN (0, 3) GROUP BY b.conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (previous IS NOT NULL AND concat(previous, initial) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce((e.way).cost, 0)::BIGINT AS cost,
  coalesce((e.way).audit, '') AS audit,
  sha256(coalesce(array_to_string((e.way).written, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
  LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""

ORACLE: dict[str, str] = {
    "op5_revisit_resolution": _REVISITS,
    "op7_link_graph": _LINK_GRAPH,
    "op10_source_schedule": _SCHEDULE,
    "op11_turn_alignment": _TURNS,
}
