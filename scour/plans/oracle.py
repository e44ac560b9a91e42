"""Equivalent SQL (DuckDB dialect) for the registered queries.

Tables are the driver's views. Column names match ``scour.plans.registry``.
The hash-embedder and distance rules are written out once as CTE builders.
"""

from __future__ import annotations

from scour.plans.registry import (DEEP_LIMIT, DEEP_SHARE, DIM, K, PAGE_LIMIT, PAGE_OFFSET,
                                  PLAN_BATCH, PLAN_OFFSET, PLAN_SHARE, REFUSED)
from scour.sources.requests import DEFAULT_API_KEY


def _posts() -> str:
    return """
q AS (SELECT conv_id * 1000 + turn AS id, split_part(text, chr(10), 1) AS title, text AS body,
             CASE WHEN role = 'user' THEN conv_id * 1000 + turn + 1 END AS accepted_answer_id
      FROM conversations WHERE role IN ('user', 'system')),
a AS (SELECT conv_id * 1000 + turn AS id, text AS body FROM conversations WHERE role = 'assistant'),
pairs AS (SELECT q.id AS question_id, q.title AS question_title, q.body AS question_body,
                 q.accepted_answer_id, a.body AS accepted_answer_body
          FROM q LEFT JOIN a ON q.accepted_answer_id = a.id
          WHERE q.accepted_answer_id IS NOT NULL)"""


def _refused(key: str) -> str:
    return f"substr({key}, 1, 1) IN ({', '.join(repr(x) for x in REFUSED)})"


def _embed(name: str, src: str, key: str, text: str) -> str:
    """CTEs ``{name}_w`` (sparse cell sums), ``{name}_n`` (non-zero norms) and
    ``{name}_v`` (dense unit vectors as DOUBLE[] of FLOAT values) for
    ``src(key, text)``."""
    return f"""
{name}_tok AS (SELECT {key} AS k, unnest(string_split_regex(lower({text}), '[ \\n\\t\\r]+')) AS t
               FROM {src}),
{name}_cw AS (SELECT k, ('0x' || substr(md5(t), 1, 7))::BIGINT AS code FROM {name}_tok WHERE t <> ''),
{name}_w AS (SELECT k, (code // 16) % {DIM} AS cell,
                    sum(CASE WHEN code % 2 = 0 THEN 1 ELSE -1 END) AS w
             FROM {name}_cw GROUP BY ALL),
{name}_n AS (SELECT k, sqrt(sum(w * w)) AS norm FROM {name}_w GROUP BY k HAVING sum(w * w) > 0),
{name}_v AS (SELECT n.k, list(coalesce((w.w / n.norm)::FLOAT, 0)::DOUBLE ORDER BY c.cell) AS v
             FROM {name}_n n CROSS JOIN range({DIM}) c(cell)
             LEFT JOIN {name}_w w ON w.k = n.k AND w.cell = c.cell
             GROUP BY n.k)"""


def _d2(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(list_zip({a}, {b}), "
            f"lambda t: (t[1] - t[2]) * (t[1] - t[2])), lambda x, y: x + y)")


def _knn_emb(where: str = "") -> str:
    return f"""
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, {_d2('a.v', 'b.v')} AS dist2 FROM e a, e b {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist2, vec_id) AS rank FROM pairs),
hits AS (SELECT query_id, rank::INT AS rank, vec_id, dist2 FROM ranked WHERE rank <= {K})"""


def _stored() -> str:
    return """
stored AS (SELECT sha256(d.text) AS content_id FROM documents d
           WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))"""


def _search() -> str:
    """Requests, accepted set, query vectors, document index, hits, answers."""
    return f"""
req AS (SELECT conv_id * 1000 + turn AS query_id,
               CASE WHEN role = 'user' THEN text END AS query_text,
               CASE WHEN conv_id % 9 = 7 THEN NULL
                    WHEN conv_id % 9 = 4 THEN 'wrong-key' ELSE '{DEFAULT_API_KEY}' END AS api_key_header
        FROM conversations WHERE role IN ('user', 'system')),
acc AS (SELECT * FROM req WHERE coalesce(query_text, '') <> ''
                           AND api_key_header IS NOT DISTINCT FROM '{DEFAULT_API_KEY}'),
dd AS (SELECT DISTINCT sha256(text) AS doc_id, text FROM documents),
{_embed('de', 'dd', 'doc_id', 'text')},
{_embed('qe', 'acc', 'query_id', 'query_text')},
sp AS (SELECT q.k AS query_id, d.k AS doc_id, {_d2('q.v', 'd.v')} AS dist2 FROM qe_v q, de_v d),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist2, doc_id) AS rank FROM sp),
hits AS (SELECT sr.query_id, sr.rank, sr.doc_id, dd.text FROM sr JOIN dd USING (doc_id) WHERE sr.rank <= {K}),
prompts AS (SELECT acc.query_id, count(*) AS hit_count,
                   '<user_query>' || chr(10) || acc.query_text || chr(10) || '</user_query>'
                   || chr(10) || chr(10)
                   || string_agg(chr(10) || '<match_' || (hits.rank - 1) || '>' || chr(10) || hits.text
                                 || chr(10) || '</match_' || (hits.rank - 1) || '>' || chr(10),
                                 chr(10) ORDER BY hits.rank)
                   || chr(10) AS prompt,
                   'Read ' || count(*) || ' matches.' || chr(10) || '<markdown>'
                   || max(CASE WHEN hits.rank = 1 THEN hits.text END) || '</markdown>' AS result
            FROM acc JOIN hits USING (query_id) GROUP BY acc.query_id, acc.query_text),
answers AS (SELECT query_id, hit_count, prompt,
                   CASE WHEN contains(result, '<markdown>') AND contains(result, '</markdown>')
                        THEN coalesce(regexp_extract(result, '(?s)<markdown>(.*)</markdown>', 1), '')
                        ELSE result END AS markdown
            FROM prompts),
qerr AS (SELECT query_id, CASE WHEN n.k IS NULL THEN
                  CASE WHEN t.k IS NULL THEN 'empty input' ELSE 'zero vector' END END AS embed_error
         FROM acc LEFT JOIN (SELECT DISTINCT k FROM qe_w) t ON t.k = acc.query_id
                  LEFT JOIN qe_n n ON n.k = acc.query_id),
outp AS (SELECT req.query_id,
                CASE WHEN coalesce(req.query_text, '') = '' THEN 400
                     WHEN req.api_key_header IS DISTINCT FROM '{DEFAULT_API_KEY}' THEN 401
                     WHEN qerr.embed_error IS NOT NULL THEN 500
                     WHEN coalesce(answers.hit_count, 0) = 0 THEN 404
                     ELSE 200 END AS status_code,
                qerr.embed_error, answers.hit_count, answers.prompt, answers.markdown
         FROM req LEFT JOIN qerr USING (query_id) LEFT JOIN answers USING (query_id)),
resp AS (SELECT query_id, status_code::INT AS status_code,
                CASE status_code WHEN 400 THEN 'No query text provided in event.'
                                 WHEN 401 THEN 'Unauthorized'
                                 WHEN 500 THEN 'Embedding generation failed: ' || embed_error
                                 WHEN 404 THEN 'No matches found' END AS error,
                CASE status_code WHEN 400 THEN 'validate' WHEN 401 THEN 'authorize'
                                 WHEN 500 THEN 'embed' WHEN 404 THEN 'search' END AS error_stage,
                CASE WHEN status_code = 200 THEN markdown END AS markdown,
                hit_count, prompt
         FROM outp)"""


def _plan() -> str:
    return f"""
src AS (SELECT doc_id, text, sha256(text) AS content_id,
               row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents),
paged AS (SELECT *, (rn - {PLAN_OFFSET}) // {PLAN_BATCH} AS batch_no FROM src WHERE rn >= {PLAN_OFFSET}),
{_stored()},
fresh AS (SELECT * FROM paged p WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.content_id = p.content_id)),
fd AS (SELECT DISTINCT content_id, text FROM fresh),
{_embed('pe', 'fd', 'content_id', 'text')},
ok AS (SELECT f.* FROM fresh f WHERE NOT {_refused('f.content_id')}
       AND EXISTS (SELECT 1 FROM pe_n n WHERE n.k = f.content_id)),
fb AS (SELECT content_id, min(batch_no) AS first_batch FROM ok GROUP BY 1),
ok1 AS (SELECT ok.* FROM ok JOIN fb USING (content_id) WHERE ok.batch_no = fb.first_batch),
fetched AS (SELECT batch_no, count(*) AS fetched FROM paged GROUP BY 1),
ix AS (SELECT batch_no, count(*) AS indexed FROM ok1 GROUP BY 1),
pb AS (SELECT f.batch_no, f.fetched, coalesce(ix.indexed, 0) AS indexed
       FROM fetched f LEFT JOIN ix USING (batch_no)),
run AS (SELECT *, coalesce(sum(indexed) OVER (ORDER BY batch_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS total_before FROM pb),
many AS (SELECT floor(count(*) * {PLAN_SHARE}) AS n FROM src s
         WHERE NOT EXISTS (SELECT 1 FROM stored t WHERE t.content_id = s.content_id)),
kb AS (SELECT run.* FROM run, many WHERE total_before < many.n)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts)


ORACLE = {
    "qa_source_join": _with(_posts()) + "\nSELECT * FROM pairs",
    "qa_source_page": _with(_posts())
    + f"\nSELECT * FROM pairs ORDER BY question_id LIMIT {PAGE_LIMIT} OFFSET {PAGE_OFFSET}",
    "qa_keyset_page": _with(_posts())
    + f"\nSELECT * FROM pairs ORDER BY question_id LIMIT {PAGE_LIMIT} OFFSET {PAGE_LIMIT}",
    "qa_deep_page": _with(_posts(), f"""
num AS (SELECT *, row_number() OVER (ORDER BY question_id) - 1 AS rn, count(*) OVER () AS many FROM pairs)""")
    + f"""
SELECT question_id, question_title, question_body, accepted_answer_id, accepted_answer_body FROM num
WHERE rn >= floor(many * {DEEP_SHARE}) AND rn < floor(many * {DEEP_SHARE}) + {DEEP_LIMIT}""",
    "doc_assemble": _with(_posts()) + """
SELECT question_id, sha256(t) AS doc_id, t AS text FROM (
  SELECT question_id, 'Title: ' || coalesce(question_title, 'None') || '\nBody: '
         || coalesce(question_body, 'None') || '\nAccepted Answer: '
         || coalesce(accepted_answer_body, 'None') AS t FROM pairs)""",
    "doc_id_hash": "SELECT doc_id, sha256(text) AS content_id FROM documents",
    "new_docs_anti": _with(_stored()) + """
SELECT d.doc_id, sha256(d.text) AS content_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.content_id = sha256(d.text))""",
    "embed_hash": _with("dd AS (SELECT DISTINCT sha256(text) AS doc_id, text FROM documents)",
                        _embed("x", "dd", "doc_id", "text")) + """
SELECT w.k AS doc_id, w.cell::INT AS cell, round(((w.w / n.norm)::FLOAT)::DOUBLE, 6) AS value
FROM x_w w JOIN x_n n USING (k) WHERE w.w <> 0""",
    "embed_failures": _with("dd AS (SELECT DISTINCT sha256(text) AS doc_id, text FROM documents)",
                            _embed("x", "dd", "doc_id", "text")) + f"""
SELECT dd.doc_id, err IS NULL AS ok, err AS error FROM (
  SELECT dd.doc_id, CASE WHEN {_refused('dd.doc_id')} THEN 'ValueError: refused'
                         WHEN t.k IS NULL THEN 'ValueError: empty input'
                         WHEN n.k IS NULL THEN 'ValueError: zero vector' END AS err
  FROM dd LEFT JOIN (SELECT DISTINCT k FROM x_w) t ON t.k = dd.doc_id
          LEFT JOIN x_n n ON n.k = dd.doc_id) dd""",
    "batch_plan": _with(_plan()) + """
SELECT doc_id, rn, batch_no, content_id FROM ok1 WHERE batch_no IN (SELECT batch_no FROM kb)""",
    "ingest_rejects": _with(_plan()) + f"""
SELECT f.doc_id, f.rn, f.batch_no, f.content_id,
       CASE WHEN {_refused('f.content_id')} THEN 'ValueError: refused'
            WHEN w.k IS NULL THEN 'ValueError: empty input' ELSE 'ValueError: zero vector' END AS error
FROM fresh f LEFT JOIN (SELECT DISTINCT k FROM pe_w) w ON w.k = f.content_id
WHERE f.batch_no IN (SELECT batch_no FROM kb)
  AND ({_refused('f.content_id')} OR NOT EXISTS (SELECT 1 FROM pe_n n WHERE n.k = f.content_id))""",
    "ingest_progress": _with(_plan()) + f"""
SELECT batch_no, {PLAN_OFFSET} + batch_no * {PLAN_BATCH} AS page_offset, fetched, indexed,
       total_before, total_before + indexed AS total_after FROM kb""",
    "ingest_index": _with(_posts(), """
dd AS (SELECT DISTINCT 'Title: ' || coalesce(question_title, 'None') || '\nBody: '
         || coalesce(question_body, 'None') || '\nAccepted Answer: '
         || coalesce(accepted_answer_body, 'None') AS text FROM pairs)""",
                          _embed("x", "dd", "sha256(text)", "text")) + f"""
SELECT sha256(dd.text) AS doc_id, dd.text, 0::BIGINT AS run_id, {DIM} AS width
FROM dd JOIN x_n n ON n.k = sha256(dd.text)""",
    "index_schema_check": f"""
SELECT vec_id, reason IS NULL AS valid, reason FROM (
  SELECT vec_id, CASE vec_id % 11 WHEN 1 THEN 'missing vector' WHEN 2 THEN 'width 7 != {DIM}'
                      WHEN 3 THEN 'null or NaN cell' WHEN 4 THEN 'null or NaN cell' END AS reason
  FROM embeddings)""",
    "index_upsert": _with(
        "lab AS (SELECT DISTINCT sha256(text) AS doc_id, text FROM documents d "
        "WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))",
        "en AS (SELECT DISTINCT sha256(text) AS doc_id, text FROM documents WHERE lang = 'en')",
        _embed("l", "lab", "doc_id", "text"), _embed("g", "en", "doc_id", "text")) + f"""
SELECT doc_id, max(run_id)::BIGINT AS run_id, {DIM} AS width FROM (
  SELECT k AS doc_id, 1 AS run_id FROM l_n UNION ALL SELECT k AS doc_id, 3 AS run_id FROM g_n)
GROUP BY doc_id""",
    "knn_single": f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
m AS (SELECT list(mx ORDER BY i) AS mv FROM (SELECT i, avg(x) AS mx FROM u GROUP BY i)),
d AS (SELECT vec_id, {_d2('e.v', 'm.mv')} AS dist2 FROM e, m),
r AS (SELECT *, row_number() OVER (ORDER BY dist2, vec_id) AS rank FROM d)
SELECT rank::INT AS rank, vec_id, round(dist2, 6) AS dist2, round(1.0 / (1.0 + dist2), 6) AS score
FROM r WHERE rank <= {K}""",
    "knn_batch": _with(_knn_emb()) + """
SELECT query_id, rank, vec_id, round(dist2, 6) AS dist2, round(1.0 / (1.0 + dist2), 6) AS score FROM hits""",
    "knn_spoiled": _with(_knn_emb("WHERE b.vec_id % 11 NOT IN (1, 2, 3, 4)")) + """
SELECT query_id, rank, vec_id, round(dist2, 6) AS dist2, round(1.0 / (1.0 + dist2), 6) AS score FROM hits""",
    "hits_text": _with(_knn_emb()) + """
SELECT h.query_id, h.rank, h.vec_id, coalesce(d.text, '') AS text
FROM hits h LEFT JOIN (SELECT doc_id, text FROM documents WHERE lang = 'en') d ON d.doc_id = h.vec_id""",
    "prompt_assemble": _with(_search()) + """
SELECT query_id, hit_count, prompt FROM resp WHERE prompt IS NOT NULL""",
    "answer_extract": _with(_search()) + """
SELECT query_id, markdown FROM resp WHERE status_code = 200""",
    "rag_answer": _with(_search()) + """
SELECT query_id, status_code, error, markdown FROM resp""",
    "rag_plugin_model": _with(_search()) + """
SELECT query_id, status_code,
       CASE WHEN status_code = 200 THEN length(prompt) || ' characters' || chr(10) || 'read' END AS markdown
FROM resp""",
    "response_status": _with(_search()) + """
SELECT query_id, status_code, error_stage, hit_count FROM resp""",
    "response_json": _with(_search()) + """
SELECT query_id, status_code,
       CASE WHEN status_code = 200 THEN to_json({'markdown': markdown})
            ELSE to_json({'error': error}) END::VARCHAR AS body FROM resp""",
    "request_events": f"""
SELECT conv_id * 1000 + turn AS query_id, CASE WHEN role = 'user' THEN text END AS query_text,
       CASE WHEN conv_id % 9 = 7 THEN NULL
            WHEN conv_id % 9 = 4 THEN 'wrong-key' ELSE '{DEFAULT_API_KEY}' END AS api_key_header
FROM conversations WHERE role IN ('user', 'system')""",
    "request_decode": """
SELECT page_id, path, ref, coalesce(TRY_CAST(page AS INT), 1) AS page_no, n_params FROM (
  SELECT page_id,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
         CASE WHEN qs <> '' THEN url_decode(NULLIF(regexp_extract(qs, '(&|^)ref=([^&]*)', 2), ''))
              END AS ref,
         CASE WHEN qs <> '' THEN NULLIF(regexp_extract(qs, '(&|^)page=([^&]*)', 2), '') END AS page,
         (CASE WHEN qs <> '' THEN len(list_distinct(list_transform(string_split(qs, '&'),
              lambda p: split_part(p, '=', 1)))) ELSE 0 END)::INTEGER AS n_params
  FROM (SELECT page_id, url, regexp_extract(url, '\\?([^#]*)', 1) AS qs FROM pages))""",
}
ORACLE["knn_ivf"] = ORACLE["knn_blocks"] = ORACLE["knn_batch"]
ORACLE["knn_probe_recall"] = ORACLE["knn_graph_recall"] = "SELECT count(DISTINCT vec_id) AS queries, true AS enough FROM embeddings"
ORACLE["ingest_stream"] = _with(
    "dd AS (SELECT DISTINCT sha256(text) AS doc_id, text FROM documents)", _stored(),
    _embed("x", "dd", "doc_id", "text")) + f"""
SELECT k AS doc_id, {DIM} AS width, 1::BIGINT AS n,
       CASE WHEN k IN (SELECT content_id FROM stored) THEN 1 ELSE 0 END AS old FROM x_n"""
ORACLE["qa_source_sql"] = ORACLE["qa_source_page"]
ORACLE["response_stream"] = ORACLE["response_json"]
