"""Registered queries over the driver tables, one per operator family.

Each function takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
column names match the SQL in ``scour.plans.oracle``. Every query reads whole
tables; fixed parameters are listed once below.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.functions.text import content_id
from scour.operators import index as idx
from scour.operators.answer import hits_with_text, map_model
from scour.operators.embed import checked, hash_embedder, hash_vector, udf_embedder
from scour.operators.ingest import batch_plan as _batch_plan
from scour.operators.ingest import skip_stored
from scour.operators.knn import build_ivf, knn
from scour.operators.knn import knn_single as _knn_single
from scour.operators.knn_blocks import build_cells, recall
from scour.operators.knn_blocks import knn_blocks as _knn_blocks
from scour.operators.knn_graph import build_graph
from scour.operators.knn_graph import knn_graph as _knn_graph
from scour.plans.ingest import ingest_event, qa_documents
from scour.plans.search import search
from scour.session import materialize, scratch_path
from scour.sources import qa, sql
from scour.sources.requests import (DEFAULT_API_KEY, decode_events, int_param, request_fields,
                                    requests_from_conversations, url_requests)
from scour.sources.tables import read_table
from scour.streaming.ingest_stream import ingest_stream as _ingest_stream
from scour.streaming.serve_stream import read_responses, serve_batch, serve_stream

# Fixed parameters of the registered queries.
DIM = 64                  # width of the driver's vectors and of the hash embedder
K = 5                     # neighbours per search
PAGE_LIMIT, PAGE_OFFSET = 50, 10
DEEP_LIMIT, DEEP_SHARE = 40, 0.75     # a page past three quarters of the rows
PLAN_SHARE, PLAN_BATCH, PLAN_OFFSET = 0.75, 20, 10   # N: three quarters of the rows not stored
INGEST_RECORDS, INGEST_BATCH = 100_000_000, 64
REFUSED = ("0", "3")      # first hex digits of content ids that the flaky embedder refuses
IVF_CELLS = 16
BEAM = 64                 # of the graph search
COARSE, FINE = 16, 4      # centroids of the residual cell code
PROBES, RECALL = 40, 0.9  # cells read per query by the approximate search, and its floor
STREAM_FILES = 3


def _t(spark, sf, name):
    return read_table(spark, sf, name)


def _posts(spark, sf):
    conv = _t(spark, sf, "conversations")
    return qa.questions_from_conversations(conv), qa.answers_from_conversations(conv)


def _round(c, n=6):
    return F.round(F.col(c), n).alias(c)


# -------------------------------------------------------------------- sources

def qa_source_join(spark: SparkSession, sf: str) -> DataFrame:
    q, a = _posts(spark, sf)
    return qa.qa_pairs(q, a)


def qa_source_page(spark: SparkSession, sf: str) -> DataFrame:
    q, a = _posts(spark, sf)
    return qa.source_page(q, a, PAGE_LIMIT, PAGE_OFFSET)


def qa_deep_page(spark: SparkSession, sf: str) -> DataFrame:
    q, a = _posts(spark, sf)
    many = q.filter(F.col("accepted_answer_id").isNotNull()).count()
    return qa.source_page(q, a, DEEP_LIMIT, int(many * DEEP_SHARE), shallow=0)


def qa_source_sql(spark, sf):
    """A page by SQL text with named parameters."""
    q, a = _posts(spark, sf)
    return sql.pairs_page(q, a, PAGE_LIMIT, PAGE_OFFSET)


def qa_keyset_page(spark, sf):
    """The page that follows the first one, by its cursor."""
    q, a = _posts(spark, sf)
    _, cursor = qa.page_after(q, a, PAGE_LIMIT)
    return qa.page_after(q, a, PAGE_LIMIT, cursor)[0]


# ------------------------------------------------------------------ documents

def doc_assemble(spark, sf):
    q, a = _posts(spark, sf)
    return qa_documents(qa.qa_pairs(q, a)).select("question_id", "doc_id", "text")


def doc_id_hash(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", content_id("text").alias("content_id"))


def _stored_ids(spark, sf):
    docs = _t(spark, sf, "documents")
    labelled = docs.join(_t(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return labelled.select(content_id("text").alias("content_id"))


def new_docs_anti(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", content_id("text").alias("content_id"))
    return skip_stored(docs, _stored_ids(spark, sf), "content_id")


def _keyed_docs(spark, sf):
    """Documents by content id, each text once: copies collapse before the
    shuffle, so the embedder sees every text once."""
    return _t(spark, sf, "documents").select(content_id("text").alias("doc_id"), "text").distinct()


def embed_hash(spark, sf):
    e = hash_embedder(DIM)(_keyed_docs(spark, sf), "text")
    return (e.filter(F.col("error").isNull())
            .select("doc_id", F.posexplode("embedding").alias("cell", "x"))
            .filter(F.col("x") != 0)
            .select("doc_id", F.col("cell").cast("int").alias("cell"),
                    F.round(F.col("x").cast("double"), 6).alias("value")))


def flaky_embedder():
    """A plug-in embedder that refuses some texts, chosen by their content id."""
    def factory():
        def call(text: str):
            if hashlib.sha256(text.encode()).hexdigest()[0] in REFUSED:
                raise ValueError("refused")
            vector, error = hash_vector(text, DIM)
            if error:
                raise ValueError(error)
            return vector
        return call

    return udf_embedder(factory, DIM, retryable=(ValueError,))


def embed_failures(spark, sf):
    e = checked(flaky_embedder(), DIM)(_keyed_docs(spark, sf), "text")
    return e.select("doc_id", F.col("error").isNull().alias("ok"), "error")


# ------------------------------------------------------------- ingest control

def _plan(spark, sf):
    src = _t(spark, sf, "documents").select("doc_id", "text",
                                             content_id("text").alias("content_id"))
    stored = _stored_ids(spark, sf)
    fresh = skip_stored(src.select("content_id"), stored, "content_id").count()
    return _batch_plan(src, "doc_id", stored, flaky_embedder(),
                       number_of_records=int(fresh * PLAN_SHARE), batch_size=PLAN_BATCH,
                       offset=PLAN_OFFSET, key="content_id", text="text")


def batch_plan(spark, sf):
    kept, _, _ = _plan(spark, sf)
    return kept.select("doc_id", "rn", "batch_no", "content_id")


def ingest_rejects(spark, sf):
    _, rejects, _ = _plan(spark, sf)
    return rejects.select("doc_id", "rn", "batch_no", "content_id", "error")


def ingest_progress(spark, sf):
    _, _, batches = _plan(spark, sf)
    return batches


# ---------------------------------------------------------------------- index

def ingest_index(spark, sf):
    """Pairs to documents to index, run twice: the second run adds nothing."""
    q, a = _posts(spark, sf)
    docs = qa_documents(qa.qa_pairs(q, a))
    path = scratch_path(spark, "index")
    for run in (0, 1):
        ingest_event(spark, docs, path, {"number_of_records": str(INGEST_RECORDS),
                                         "batch_size": str(INGEST_BATCH)},
                     order_col="question_id", dim=DIM, run_id=run)
    return idx.read_index(spark, path).select("doc_id", "text", "run_id",
                                               F.size("embedding").alias("width"))


def _spoiled(spark, sf):
    """``embeddings`` with bad vectors among them, chosen by ``vec_id``: missing,
    short, with a NaN and with a NULL cell."""
    kind = F.pmod("vec_id", F.lit(11))
    v = F.col("embedding")
    cell = lambda bad: F.transform(v, lambda x, i: F.when(i == 3, bad).otherwise(x))
    return _t(spark, sf, "embeddings").select("vec_id", F.when(kind == 1, F.lit(None))
        .when(kind == 2, F.slice(v, 1, 7)).when(kind == 3, cell(F.lit(float("nan")).cast("float")))
        .when(kind == 4, cell(F.lit(None).cast("float"))).otherwise(v).alias("embedding"))


def index_schema_check(spark, sf):
    path = idx.create_if_missing(spark, scratch_path(spark, "index"), DIM)
    width = idx.index_dimension(spark, path)
    return idx.check_vectors(_spoiled(spark, sf), "embedding", width).select(
        "vec_id", "valid", "reason")


def _embedded(spark, docs):
    """(doc_id, text, embedding): each content id once, embedded once."""
    d = docs.select(content_id("text").alias("doc_id"), "text").distinct()
    e = hash_embedder(DIM)(d, "text").filter(F.col("error").isNull())
    return e.select("doc_id", "text", "embedding")


def index_upsert(spark, sf):
    """Labelled documents first; then English ones in a batch that holds every
    id twice, of runs 2 and 3."""
    docs = _t(spark, sf, "documents")
    labelled = docs.join(_t(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    english = docs.filter(F.col("lang") == "en")
    path = scratch_path(spark, "index")
    idx.upsert(spark, path, idx.to_index_rows(_embedded(spark, labelled), 1), DIM)
    again = idx.to_index_rows(_embedded(spark, english), 2)
    again = again.withColumn("run_id", F.explode(F.array(F.lit(3), F.lit(2)).cast("array<long>")))
    idx.upsert(spark, path, again, DIM)
    return idx.read_index(spark, path).select("doc_id", "run_id",
                                               F.size("embedding").alias("width"))


# --------------------------------------------------------------------- search

def _emb_queries(spark, sf):
    e = _t(spark, sf, "embeddings")
    return e, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


# The query vectors of the kNN queries are a plain scan (no embedder to run
# once), so knn() need not write them to the checkpoint folder first.
_SCAN_QUERIES = {"materialize": False}


def _hits_out(h):
    return h.select("query_id", "rank", "vec_id", _round("dist2"), _round("score"))


def knn_single(spark, sf):
    e = _t(spark, sf, "embeddings")
    mean = (e.select(F.posexplode("embedding").alias("i", "x"))
            .groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
            .orderBy("i").collect())              # one row per dimension
    q = [r["m"] for r in mean]
    return _knn_single(e, q, K, cid="vec_id").select("rank", "vec_id", _round("dist2"), _round("score"))


def knn_batch(spark, sf):
    e, q = _emb_queries(spark, sf)
    return _hits_out(knn(q, e, K, qid="query_id", qvec="qv", cid="vec_id", cvec="embedding",
                         **_SCAN_QUERIES))


def knn_ivf(spark, sf):
    e, q = _emb_queries(spark, sf)
    return _hits_out(knn(q, e, K, qid="query_id", qvec="qv", cid="vec_id", cvec="embedding",
                         index=build_ivf(e, cid="vec_id", cvec="embedding", dim=DIM,
                                         cells=IVF_CELLS), **_SCAN_QUERIES))


def _cells(e):
    return build_cells(e, cid="vec_id", cvec="embedding", dim=DIM, coarse=COARSE, fine=FINE)


def knn_blocks(spark, sf):
    """Exact search with queries and corpus both dealt out in blocks."""
    e, q = _emb_queries(spark, sf)
    return _hits_out(_knn_blocks(q, _cells(e), K))


def _probed(spark, sf):
    e, q = _emb_queries(spark, sf)
    index = _cells(e)
    found = materialize(_knn_blocks(q, index, K, nprobe=PROBES), "knn-probed")
    return found, recall(found, _knn_blocks(q, index, K), cid="vec_id")


def knn_probe(spark, sf):
    """Approximate search (multi-probe over cells), each query with its recall."""
    found, share = _probed(spark, sf)
    return found.join(share, "query_id").select("query_id", "rank", "vec_id", _round("dist2"), "recall")


def knn_probe_recall(spark, sf):
    """One row: does the approximate search reach its floor over all queries?"""
    _, share = _probed(spark, sf)
    return share.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= RECALL).alias("enough"))


def _walked(spark, sf):
    e, q = _emb_queries(spark, sf)
    index = build_graph(e, cid="vec_id", cvec="embedding", dim=DIM)
    found = materialize(_knn_graph(q, index, K, beam=BEAM), "knn-walked")
    return found, recall(found, _knn_blocks(q, _cells(e), K), cid="vec_id")


def knn_graph(spark, sf):
    """Approximate search over a neighbour graph, each query with its recall."""
    found, share = _walked(spark, sf)
    return found.join(share, "query_id").select("query_id", "rank", "vec_id", _round("dist2"), "recall")


def knn_graph_recall(spark, sf):
    """One row: does the graph search reach its floor over all queries?"""
    _, share = _walked(spark, sf)
    return share.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= RECALL).alias("enough"))


def knn_spoiled(spark, sf):
    """Search among vectors some of which can't be compared."""
    e, q = _spoiled(spark, sf), _emb_queries(spark, sf)[1]
    return _hits_out(knn(q, e, K, qid="query_id", qvec="qv", cid="vec_id", cvec="embedding",
                         dim=DIM, **_SCAN_QUERIES))


def hits_text(spark, sf):
    e, q = _emb_queries(spark, sf)
    h = knn(q, e, K, qid="query_id", qvec="qv", cid="vec_id", cvec="embedding", **_SCAN_QUERIES)
    en = _t(spark, sf, "documents").filter(F.col("lang") == "en")
    return hits_with_text(h, en, "vec_id", "doc_id").select("query_id", "rank", "vec_id", "text")


_indexes: dict[tuple[str, str], str] = {}   # (application, data folder) -> index


def document_index(spark, sf):
    """The stored index over ``documents``, built once per application and data
    folder (a search reads an index, it does not build one)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        path = scratch_path(spark, "index")
        idx.create_if_missing(spark, path, DIM)
        idx.append_rows(spark, path, idx.to_index_rows(_embedded(spark, _t(spark, sf, "documents")), 0))
        _indexes[key] = path
    return idx.read_index(spark, _indexes[key])


def _search(spark, sf, **options):
    reqs = requests_from_conversations(_t(spark, sf, "conversations"))
    return search(reqs, document_index(spark, sf), k=K, api_key=DEFAULT_API_KEY, dim=DIM, **options)


def counting_model(prompts):
    """A plug-in answer model: says how long the prompt is, outside of any tag."""
    def factory():
        def call(prompt, system, temperature):
            return {"output": {"message": {"role": "assistant", "content": [
                {"text": f"{len(prompt)} characters"}, {"text": "read"}]}}}
        return call

    return map_model(prompts, factory)


def rag_plugin_model(spark, sf):
    return _search(spark, sf, model=counting_model).select("query_id", "status_code", "markdown")


def prompt_assemble(spark, sf):
    return _search(spark, sf).filter(F.col("prompt").isNotNull()) \
                             .select("query_id", "hit_count", "prompt")


def answer_extract(spark, sf):
    return _search(spark, sf).filter(F.col("status_code") == 200).select("query_id", "markdown")


def rag_answer(spark, sf):
    return _search(spark, sf).select("query_id", "status_code", "error", "markdown")


def response_status(spark, sf):
    return _search(spark, sf).select("query_id", "status_code", "error_stage", "hit_count")


def response_json(spark, sf):
    from scour.operators.respond import to_responses
    return to_responses(_search(spark, sf))


def _events(spark, sf):
    reqs = requests_from_conversations(_t(spark, sf, "conversations"))
    return reqs.select("query_id", F.to_json(F.struct(
        F.lit("/search").alias("path"), F.lit("GET").alias("httpMethod"),
        F.col("params").alias("queryStringParameters"), "headers",
        F.lit(False).alias("isBase64Encoded"))).alias("event"))


def response_stream(spark, sf):
    """The requests as a stream of several micro-batches; then the same checkpoint
    again, and the first epoch once more: every request has one response."""
    document_index(spark, sf)
    index = _indexes[spark.sparkContext.applicationId, sf]
    source, out, ckpt = (scratch_path(spark, f"serve-{x}") for x in ("source", "out", "ckpt"))
    events = _events(spark, sf).repartition(STREAM_FILES, "query_id")
    events.write.parquet(source)
    options = {"k": K, "api_key": DEFAULT_API_KEY, "dim": DIM}
    for _ in range(2):
        serve_stream(spark, source, index, out, ckpt, **options)
    answered = read_responses(spark, out)
    again = materialize(spark.read.parquet(source).join(
        answered.filter("epoch = 0").select("query_id"), "query_id", "left_semi"), "serve-again")
    serve_batch(spark, again, 0, index, out, "requests", **options)
    return read_responses(spark, out).select("query_id", "status_code", "body")


def request_events(spark, sf):
    """JSON events, written from the requests and read back."""
    return request_fields(decode_events(_events(spark, sf))).select("query_id", "query_text", "api_key_header")


def request_decode(spark, sf):
    p = url_requests(_t(spark, sf, "pages").select("page_id", "url"), "url", "ref")
    return p.select("page_id", "path", F.col("param_value").alias("ref"),
                    int_param(F.col("params"), "page", 1).alias("page_no"),
                    F.coalesce(F.size(F.map_keys("params")), F.lit(0)).alias("n_params"))


# ------------------------------------------------------------------ streaming

def ingest_stream(spark, sf):
    """Several micro-batches over an index that holds the labelled documents
    already; then the same checkpoint again, and a new one: neither adds rows."""
    docs = _t(spark, sf, "documents")
    labelled = docs.join(_t(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    path, source = scratch_path(spark, "stream-index"), scratch_path(spark, "stream-source")
    idx.create_if_missing(spark, path, DIM)
    idx.append_rows(spark, path, idx.to_index_rows(_embedded(spark, labelled), -1))
    # as many micro-batches at any size: a batch is several files where the input has many splits
    each = -(-docs.rdd.getNumPartitions() // STREAM_FILES)
    docs.select("text").repartition(STREAM_FILES * each).write.parquet(source)
    first = scratch_path(spark, "stream-ckpt")
    for ckpt, files in ((first, each), (first, each), (scratch_path(spark, "stream-ckpt"), STREAM_FILES * each)):
        _ingest_stream(spark, source, path, ckpt, dim=DIM, max_files_per_trigger=files)
    return (idx.read_index(spark, path).groupBy("doc_id", F.size("embedding").alias("width"))
            .agg(F.count(F.lit(1)).alias("n"), F.min((F.col("run_id") < 0).cast("int")).alias("old")))


QUERIES = {
    "qa_source_join": qa_source_join,
    "qa_source_page": qa_source_page,
    "qa_deep_page": qa_deep_page,
    "qa_source_sql": qa_source_sql,
    "qa_keyset_page": qa_keyset_page,
    "doc_assemble": doc_assemble,
    "doc_id_hash": doc_id_hash,
    "new_docs_anti": new_docs_anti,
    "embed_hash": embed_hash,
    "embed_failures": embed_failures,
    "batch_plan": batch_plan,
    "ingest_progress": ingest_progress,
    "ingest_rejects": ingest_rejects,
    "ingest_index": ingest_index,
    "index_schema_check": index_schema_check,
    "index_upsert": index_upsert,
    "knn_single": knn_single,
    "knn_batch": knn_batch,
    "knn_ivf": knn_ivf,
    "knn_blocks": knn_blocks,
    "knn_probe": knn_probe,
    "knn_probe_recall": knn_probe_recall,
    "knn_graph": knn_graph,
    "knn_graph_recall": knn_graph_recall,
    "knn_spoiled": knn_spoiled,
    "hits_text": hits_text,
    "prompt_assemble": prompt_assemble,
    "answer_extract": answer_extract,
    "rag_answer": rag_answer,
    "rag_plugin_model": rag_plugin_model,
    "response_status": response_status,
    "response_json": response_json,
    "response_stream": response_stream,
    "request_decode": request_decode,
    "request_events": request_events,
    "ingest_stream": ingest_stream,
}
