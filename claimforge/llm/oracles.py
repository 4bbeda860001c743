"""DuckDB SQL of the training-data queries that SQL can express; the others are tested against brute force."""

OP1 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT s, min(doc_id) AS doc_id FROM win GROUP BY s),
hit AS (SELECT DISTINCT win.doc_id, i + j AS p FROM win JOIN first ON win.s = first.s AND first.doc_id < win.doc_id, range(0, 50) AS r(j)),
pos AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT pos.doc_id, string_agg(x, ' ' ORDER BY pos.p) FILTER (WHERE hit.p IS NULL) AS t, count(hit.p) AS n_removed FROM pos LEFT JOIN hit ON pos.doc_id = hit.doc_id AND pos.p = hit.p GROUP BY pos.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

OP2 = r"""WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

OP7 = r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
run AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS head FROM later),
grp AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM run),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM grp GROUP BY doc_id, g),
edge AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, g FROM span),
piece AS (SELECT e.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS t, max(b) AS last, count(*) AS n_spans, sum(b - a) AS n_removed FROM edge e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE t || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN piece ON d.doc_id = piece.doc_id"""

OP13 = r"""WITH w AS (SELECT item_id, CAST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS VARCHAR[]) AS w FROM benchmark WHERE text IS NOT NULL),
z AS (SELECT item_id, w, least(len(w), 10) AS m FROM w WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM z)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spot AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM z) WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, win.m, i FROM spot JOIN win ON spot.m = win.m AND spot.s = win.s),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id"""

# --- fixed values: CRC-32 of half a byte, by its value
NIBBLES = (
    0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
)


def _half(x: str) -> str:
    return f"xor([{', '.join(map(str, NIBBLES))}][({x} & 15) + 1], {x} >> 4)"


def _crc32(x: str) -> str:
    """Unsigned CRC-32 of a string of ASCII characters, as BIGINT."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(ch) AS BIGINT) FOR ch IN string_split({x}, '')]), lambda c, b : {_half(_half('xor(c, b)'))}), 4294967295)"


OP12 = rf"""WITH d AS (SELECT doc_id, CAST(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS VARCHAR[]) AS w, coalesce({_crc32("CAST(doc_id AS VARCHAR)")}, 1) AS h FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT doc_id, w, n, a, h % 10 = 0 AND n > 0 AS changed, 1 + (n - a) // (3 + g % 8) AS p FROM a),
e AS (SELECT doc_id, n, i, w[1 + CASE WHEN changed AND i >= a THEN a + (i - a) % p ELSE i END] AS x FROM (SELECT *, unnest(range(n)) AS i FROM p)),
eq AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM e l JOIN e r ON l.doc_id = r.doc_id AND l.x = r.x AND l.i < r.i WHERE 4 * (r.i - l.i) <= l.n),
isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM eq),
s AS (SELECT doc_id, q, min(i) AS s, min(i) + count(*) + q AS e FROM isl GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.q < s.q AND o.s <= s.s AND o.e >= s.e)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM run),
kept AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.i) AS t FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.i = gone.i WHERE gone.i IS NULL GROUP BY e.doc_id),
agg AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', e - s, ',', q, chr(10)), '' ORDER BY s, q) AS t FROM run GROUP BY doc_id),
best AS (SELECT doc_id, s, e - s AS length, q FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s, q) = 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.length, best.q AS period, 1000 * best.length // best.q AS exponent_milli, sha256(coalesce(agg.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN agg ON d.doc_id = agg.doc_id LEFT JOIN best ON d.doc_id = best.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id"""

OP11 = rf"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, {_crc32("CAST(c AS VARCHAR)")} % 6 AS h, c - c % 100 AS base FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, t.pos + 1 AS d, role, text FROM h JOIN t ON t.c = h.base AND t.pos < h.h
UNION ALL SELECT h.c, least(h.h, (SELECT count(*) FROM t b WHERE b.c = h.base)) + t.pos - h.h + 1, role, text FROM h JOIN t ON t.c = h.c AND t.pos >= h.h),
own AS (SELECT c, list(concat(length(role), ':', role, length(text), ':', text) ORDER BY d) AS keys, list(length(text) ORDER BY d) AS sizes FROM r GROUP BY c),
x AS (SELECT h.c, coalesce(keys, []) AS keys, sizes, len(coalesce(keys, [])) AS len FROM h LEFT JOIN own ON own.c = h.c),
path AS (SELECT c, len, unnest(range(len + 1)) AS d, keys, sizes FROM x),
pre AS (SELECT c, len, d, sha256(array_to_string(keys[:d], chr(1))) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(keys[:d - 1], chr(1))) END AS up, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS n FROM path),
node AS (SELECT d, k, min(c) AS c, any_value(up) AS up, count(*) AS n_convs, any_value(n) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = len) AS ends FROM pre GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY d, up),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k),
below AS (SELECT a.d, a.k, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.n) AS saved FROM pre a JOIN pre v ON v.c = a.c AND v.d >= a.d JOIN full_ b ON b.d = v.d AND b.k = v.k AND b.c = v.c GROUP BY a.d, a.k)
SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_ f JOIN below ON below.d = f.d AND below.k = f.k LEFT JOIN node p ON p.d = f.d - 1 AND p.k = f.up"""
