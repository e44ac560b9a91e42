"""Search plan: a table of requests in, one status and answer per request out.

validate + authorise -> embed the accepted queries -> k nearest documents ->
hit texts -> prompt -> answer model -> extract -> status and body. Every stage
adds columns keyed by ``query_id``; one bad request never fails the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.operators.answer import assemble_prompts, extract_answer, hits_with_text, offline_model
from scour.operators.embed import DEFAULT_DIM, checked, hash_embedder
from scour.operators.knn import knn
from scour.operators.respond import missing_query, unauthorized, with_status
from scour.session import materialize
from scour.sources.requests import request_fields

K_DEFAULT = 5


def attach_text(hits: DataFrame, index: DataFrame, qid: str = "query_id",
                key: str = "doc_id") -> DataFrame:
    """Hit texts (see ``hits_with_text``)."""
    return hits_with_text(hits, index, key, key, "text", qid)


def embed_queries(accepted: DataFrame, embed=None, dim: int = DEFAULT_DIM) -> DataFrame:
    """``query_id, query_text, embedding, error`` (map-only). A vector of another
    width than the index, or with NULL or NaN cells, is an error."""
    return checked(embed or hash_embedder(dim), dim)(
        accepted.select("query_id", "query_text"), "query_text")


def search(requests: DataFrame, index: DataFrame, *, k: int = K_DEFAULT,
           api_key: str | None = None, dim: int = DEFAULT_DIM, embed=None,
           model=None, knn_options: dict | None = None) -> DataFrame:
    """``requests(query_id, params, headers)`` x ``index(doc_id, text, embedding)``
    -> ``query_id, status_code, error, error_stage, markdown, hit_count, prompt``.

    ``dim`` is the width of the index. Index rows without a usable vector of
    that width can't be hits; ``operators.knn.split_valid`` names them."""
    req = request_fields(requests)
    accepted = req.filter(~missing_query(F.col("query_text"))
                          & ~unauthorized(F.col("api_key_header"), api_key))
    # the query vectors feed both the search and the status: embed once
    vecs = materialize(embed_queries(accepted, embed, dim), "query-vectors")
    ok_vecs = vecs.filter(F.col("error").isNull()).select("query_id", F.col("embedding").alias("qv"))
    hits = knn(ok_vecs, index.select("doc_id", "embedding"), k, qid="query_id", qvec="qv",
               cid="doc_id", cvec="embedding",
               **{"materialize": False, "dim": dim, **(knn_options or {})})
    hits = attach_text(hits, index)
    prompts = assemble_prompts(accepted, hits)
    answered = (model or offline_model)(prompts)
    answered = extract_answer(answered).select(
        "query_id", "hit_count", "prompt", "markdown", F.col("model_error").alias("search_error"))
    out = (req.select("query_id", "query_text", "api_key_header")
           .join(vecs.select("query_id", F.col("error").alias("embed_error")), "query_id", "left")
           .join(answered, "query_id", "left"))
    return with_status(out, api_key).select(
        "query_id", "status_code", "error", "error_stage", "markdown", "hit_count", "prompt")
