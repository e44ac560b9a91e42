"""SQL (DuckDB dialect) for those queries of this subpackage that SQL can express.

Trained models, tokenizers and patterns with checks are left to the tests."""

CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT],
           list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
         lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
           lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
WORDS = r"""list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""


def encoded(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(encoded, ["doc_id", "source", "lang", "n_chars", text])) + ")"


ORACLE = {
    "op1_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
           lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(m) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op3_warc": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(8), lambda g:
        array_to_string(list_transform([15, 10, 5, 0], lambda k:
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 (((('0x' || substr(h, 5 * g + 1, 5))::BIGINT >> k) & 31) + 1)::BIGINT, 1)), '')), '')
        AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to FROM d""",
    "op4_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
t AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark),
ig AS (SELECT item_id, g, count(*) AS c FROM (SELECT item_id, array_to_string(w[i:i + 4], ' ') AS g
         FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)) GROUP BY ALL),
dg AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
hit AS (SELECT doc_id, item_id, pos, g, c FROM dg JOIN ig USING (g)),
near AS (SELECT DISTINCT hit.doc_id, hit.item_id, hit.pos, hit.g, hit.c, len(t.w) AS size, len(d.w) AS n
         FROM hit JOIN t USING (item_id) JOIN d USING (doc_id)),
st AS (SELECT doc_id, item_id, size, n, unnest(range(greatest(0, least(pos - size + 5, n - size)),
              greatest(0, least(pos, n - size)) + 1)) AS s, pos FROM near),
win AS (SELECT DISTINCT doc_id, item_id, size, n, s FROM st),
cnt AS (SELECT win.doc_id, win.item_id, win.s, win.size, win.n, near.g, any_value(near.c) AS c, count(*) AS k
        FROM win JOIN near ON near.doc_id = win.doc_id AND near.item_id = win.item_id
                          AND near.pos BETWEEN win.s AND win.s + win.size - 5 GROUP BY ALL),
sim AS (SELECT doc_id, item_id, sum(least(c, k)) AS same, any_value(size) - 4 AS a, least(any_value(size), any_value(n)) - 4 AS b
        FROM cnt GROUP BY doc_id, item_id, s)
SELECT doc_id, item_id, round(max(same / (a + b - same)), 6) AS similarity FROM sim
WHERE same >= 0.8 * (a + b - same) GROUP BY doc_id, item_id""",
    "op9_substring_dedup": r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h,
                  octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s
        FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 99)) AS i FROM h WHERE n_bytes >= 100)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win)
         WHERE k > 1),
isl AS (SELECT doc_id, i, sum(CASE WHEN i > prev + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
        FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM late)),
sp AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM isl GROUP BY ALL),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_b FROM sp),
kept AS (SELECT cut.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail,
                string_agg(substr(h, 2 * from_b + 1, 2 * (a - from_b)), '' ORDER BY a) AS k
         FROM cut JOIN h USING (doc_id) GROUP BY cut.doc_id)
SELECT h.doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN tail IS NULL THEN h ELSE k || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id)""",
    "op11_seed_extend": f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS s
        FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM w WHERE len(w) >= 50)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM late),
pos AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (doc_id, i)
         GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op12_periodic_runs": f"""
WITH a AS (SELECT doc_id, {WORDS} AS w, {CRC32} AS h FROM documents),
b AS (SELECT doc_id, w, h, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM a),
v AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
        w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM b),
pos AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM v),
eq AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM pos l JOIN pos r ON l.doc_id = r.doc_id AND l.x = r.x
       AND r.i > l.i AND r.i - l.i <= l.n // 4),
isl AS (SELECT doc_id, q, min(i) AS s, count(*) AS c FROM (
          SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM eq)
        GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, s, c + q AS length, min(q) AS q FROM isl GROUP BY ALL),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / q DESC, s, q) = 1),
every AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS t
          FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT v.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.length::BIGINT AS length,
       best.q::BIGINT AS period, (1000 * best.length // best.q)::BIGINT AS exponent_milli,
       sha256(coalesce(every.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM v LEFT JOIN best USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE l AS (SELECT doc_id, source, {leaf("text")} AS leaf,
       CASE WHEN {CRC32} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS claim FROM documents),
src AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM l)),
p AS (SELECT doc_id, leaf, claim, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
             count(*) OVER (PARTITION BY tree) AS n
      FROM l JOIN src ON l.source IS NOT DISTINCT FROM src.source),
low AS (SELECT tree, 0 AS level, idx, n, leaf AS d FROM p
        UNION ALL
        SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM low
        WHERE n > 1 GROUP BY tree, level, idx // 3, n),
top AS (SELECT 0 AS level, tree AS idx, count(*) OVER () AS n, d FROM low WHERE n = 1
        UNION ALL
        SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM top
        WHERE n > 1 GROUP BY level, idx // 3, n),
node AS (SELECT tree, level, idx, n, d FROM low WHERE n > 1 UNION ALL SELECT -1, level, idx, n, d FROM top),
sib AS (SELECT a.tree, a.level, a.idx, any_value(a.n) AS n,
               coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
               coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
        FROM node a JOIN node b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3
        WHERE a.n > 1 GROUP BY a.tree, a.level, a.idx),
f AS (SELECT tree AS own, idx AS place, CASE WHEN n = 1 THEN -1 ELSE tree END AS tree, 0 AS level,
             CASE WHEN n = 1 THEN tree ELSE idx END AS idx, coalesce(claim, leaf) AS h, '' AS s FROM p
      UNION ALL
      SELECT own, place, CASE WHEN n <= 3 AND f.tree >= 0 THEN -1 ELSE f.tree END,
             CASE WHEN n <= 3 AND f.tree >= 0 THEN 0 ELSE f.level + 1 END,
             CASE WHEN n <= 3 AND f.tree >= 0 THEN f.tree ELSE f.idx // 3 END,
             sha256(l || h || r), s || l || r FROM f JOIN sib ON f.tree = sib.tree AND f.level = sib.level AND f.idx = sib.idx),
root AS (SELECT d AS root, level FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, low.d AS subroot, root, sha256(s) AS proof_sha256, h AS folded_root, h = root AS verified
FROM p CROSS JOIN root JOIN low ON low.tree = p.tree AND low.n = 1
JOIN f ON f.own = p.tree AND f.place = p.idx AND f.tree = -1 AND f.level = root.level""",
}
