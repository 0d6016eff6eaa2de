"""SQL for the corpus queries that SQL can express, run on the same tables."""

from __future__ import annotations

from folio.llm import line_dedup, ngram_join, quality

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LOWER = f"translate(coalesce(text, ''), {_ABC})"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SPACE = r"[\x20\x09-\x0D]+"

OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::varchar[] ELSE list_transform(range(1, greatest(len(w) - {ngram_join.WORDS - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {ngram_join.WORDS - 1}], ' ')) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes m ON p.a = m.doc_id JOIN sizes n ON p.b = n.doc_id WHERE 100 * c >= {ngram_join.PERCENT} * (m.n + n.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON d.doc_id = r.a"""

OP3 = rf"""WITH d AS (SELECT doc_id, source, text, {_WORDS.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, regexp_replace(lower(trim(regexp_replace(x, '{_SPACE}', ' ', 'g'))), '[0-9]+', '0', 'g') AS h, len({_WORDS.format("x")}) AS n FROM (SELECT doc_id, source, text, unnest(lines) AS x FROM d)),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
bad AS (SELECT l.source, h FROM l JOIN hosts ON l.source = hosts.source GROUP BY l.source, h, hosts.n HAVING count(DISTINCT text) > {quality.MIN_DOCS} AND (count(DISTINCT text) > hosts.n * {quality.MIN_SHARE} OR count(DISTINCT text) > {quality.MANY_DOCS})),
gone AS (SELECT doc_id, sum(l.n)::bigint AS n FROM l JOIN bad ON l.source = bad.source AND l.h = bad.h GROUP BY doc_id),
b AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(w) AS base_failed, coalesce(gone.n, 0) AS n_boilerplate_words FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id)
SELECT *, NOT base_failed AND NOT (n_boilerplate_words > 0 AND (n_words - n_boilerplate_words < n_words * {quality.KEPT_SHARE} OR n_words - n_boilerplate_words < {quality.MIN_WORDS})) AS kept FROM b"""

_NAMES = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10 = f"""WITH d AS (SELECT doc_id, {_NAMES} AS w FROM documents),
i AS (SELECT item_id::varchar AS item_id, w, least(len(w), 13) AS n FROM (SELECT item_id, {_NAMES} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
dwin AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, item_id, p, dwin.n FROM dwin JOIN win ON dwin.n = win.n AND dwin.k = win.k),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""

_SUM = "(b.c - a.c + a.w)"
OP5 = rf"""WITH l AS (SELECT doc_id, i, x, lower(trim(regexp_replace(x, '{_SPACE}', ' ', 'g'))) AS h, len({_WORDS.format("x")}) AS w
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM l WHERE w > 0),
runs AS (SELECT DISTINCT a.doc_id, a.p, b.p AS z FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + {line_dedup.MAX_LINES - 1}
  WHERE ({_SUM} >= {line_dedup.MIN_WORDS} OR b.p = a.p + {line_dedup.MAX_LINES - 1}) AND ({_SUM} - b.w < {line_dedup.MIN_WORDS} OR {_SUM} - a.w < {line_dedup.MIN_WORDS})),
content AS (SELECT r.doc_id, r.p, r.z, string_agg(h, chr(10) ORDER BY n.p) AS k FROM runs r JOIN n ON r.doc_id = n.doc_id AND n.p BETWEEN r.p AND r.z GROUP BY ALL),
later AS (SELECT doc_id, p, z FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM content) WHERE nth > 1),
gone AS (SELECT DISTINCT n.doc_id, n.i FROM later r JOIN n ON r.doc_id = n.doc_id AND n.p BETWEEN r.p AND r.z),
kept AS (SELECT l.doc_id, string_agg(x, chr(10) ORDER BY l.i) AS t FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT d.doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, coalesce(g.n, 0) AS n_removed, octet_length(encode(coalesce(t, ''))) AS n_bytes_kept, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON d.doc_id = g.doc_id"""

OP2 = r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, p, md5(substring(x, 2 * p + 1, 800)) AS k FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399)) AS p FROM d)),
twice AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM s) WHERE c > 1),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS fresh FROM twice)) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM runs UNION ALL SELECT d.doc_id, coalesce(max(b), 0), length(any_value(x)) // 2 FROM d LEFT JOIN runs r ON d.doc_id = r.doc_id GROUP BY d.doc_id),
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
said AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 51)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM (SELECT doc_id, p, md5(array_to_string(w[p:p + 50], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 49)) AS p FROM w))) WHERE c > 1) GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substring(x, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS k FROM gaps g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(r.removed, 0)::bigint AS n_removed, coalesce(r.n, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256, coalesce(said.n, 0) AS n_passage_words
FROM d JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN said ON d.doc_id = said.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n, sum(b - a) AS removed FROM runs GROUP BY doc_id) r ON d.doc_id = r.doc_id"""

_BYTES = "list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substring(hex(encode({0})), (2 * i + 1)::int, 2))::bigint)"
#: The table of the usual CRC-32, from its polynomial.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc32(text: str) -> str:
    return f"(4294967295 - list_reduce(list_prepend(4294967295::bigint, {_BYTES.format(text)}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


OP13 = f"""WITH {_CRC_TABLE}, d AS (SELECT doc_id, {_NAMES} AS w FROM documents), b AS (SELECT unnest({_NAMES}) AS f FROM benchmark),
f AS (SELECT doc_id, f, count(*) AS c FROM (SELECT doc_id, unnest(w) AS f FROM d) GROUP BY ALL),
k AS (SELECT f, ({_crc32("f")} % 10000)::bigint AS k FROM (SELECT f FROM f UNION SELECT f FROM b), crc),
n AS (SELECT k, sum(s)::bigint AS s, sum(t)::bigint AS t FROM (SELECT k, c AS s, 0 AS t FROM f JOIN k ON f.f = k.f UNION ALL SELECT k, 0, 1 FROM b JOIN k ON b.f = k.f) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((t + 1)::double * (sum(s) OVER () + 10000)::double / ((s + 1)::double * (sum(t) OVER () + 10000)::double)))::bigint AS gain FROM n),
v AS (SELECT doc_id, sum(c * gain)::bigint AS weight FROM f JOIN k ON f.f = k.f JOIN g ON k.k = g.k GROUP BY doc_id),
p AS (SELECT d.doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5)::double / 4294967296)))::bigint AS score FROM d LEFT JOIN v ON d.doc_id = v.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM p WHERE n_features >= 20)
SELECT p.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM p LEFT JOIN r ON p.doc_id = r.doc_id"""

_LAST = "list_sort(list(conv_id) FILTER (len = depth))"
OP12 = f"""WITH {_CRC_TABLE}, o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substring(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, h, conv_id - conv_id % 5 AS b FROM (SELECT conv_id, ({_crc32("s")} % 9)::bigint AS h FROM (SELECT DISTINCT conv_id, conv_id::varchar AS s FROM o), crc)),
m AS (SELECT c.conv_id, h, b, count(o.p) AS m FROM c LEFT JOIN o ON o.conv_id = b AND o.p <= h GROUP BY ALL),
r AS (SELECT m.conv_id, o.p AS depth, role, text FROM m JOIN o ON o.conv_id = b AND o.p <= h UNION ALL SELECT m.conv_id, m + o.p - h, role, text FROM m JOIN o ON o.conv_id = m.conv_id AND o.p > h UNION ALL SELECT conv_id, 0, '', '' FROM c),
k AS (SELECT conv_id, depth, octet_length(encode(text)) AS n_bytes, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '/') OVER (PARTITION BY conv_id ORDER BY depth)) AS k, max(depth) OVER (PARTITION BY conv_id) AS len FROM r),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes, sha256(coalesce(array_to_string({_LAST}, ','), '')) AS ends_sha256, bool_and(len = depth) AS childless FROM k GROUP BY ALL),
up AS (SELECT n.conv_id, n.depth, a.depth AS d, a.k, n.childless, (n.n_convs - 1) * n.n_bytes AS saved FROM n JOIN k a ON a.conv_id = n.conv_id AND a.depth <= n.depth),
s AS (SELECT d, k, count(*) FILTER (depth = d + 1) AS n_children, count(*) FILTER (childless) AS n_leaves, sum(saved)::bigint AS saved_tokens FROM up GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s ON n.depth = s.d AND n.k = s.k LEFT JOIN k own ON own.conv_id = n.conv_id AND own.depth = n.depth - 1 LEFT JOIN n p ON p.depth = own.depth AND p.k = own.k"""
