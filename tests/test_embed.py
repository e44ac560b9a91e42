"""Embedders: UDF and Catalyst forms agree; pluggable embedder failure capture."""

import pytest
from pyspark.sql import functions as F

from scour.operators.embed import hash_embed, hash_embedder, udf_embedder
from tests.conftest import SF_SMALL


def test_udf_and_catalyst_forms_agree(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet") \
        .select(F.sha2("text", 256).alias("doc_id"), "text")
    docs = docs.unionByName(spark.createDataFrame(
        [("empty", "  \n\t"), ("none", None), ("long", "word " * 50)], "doc_id string, text string"))
    a = {r["doc_id"]: (r["embedding"], r["error"]) for r in
         hash_embedder(64, max_chars=200)(docs, "text").collect()}
    b = {r["doc_id"]: (r["embedding"], r["error"]) for r in
         hash_embed(docs, "doc_id", "text", 64, max_chars=200).collect()}
    assert a == b
    assert a["empty"] == (None, "empty input") and a["long"] == (None, "input too long")
    v = [x for x in a[next(k for k in a if a[k][0] is not None)][0]]
    assert abs(sum(x * x for x in v) - 1.0) < 1e-5


class ClientError(Exception):
    pass


def test_pluggable_embedder_captures_retryable_errors(spark):
    def factory():
        def fn(text):
            n = int(text.split()[-1])
            if n % 2 == 0:
                raise ClientError("InvokeModel")
            return [0.1, 0.2, 0.3]
        return fn

    df = spark.createDataFrame([(f"Title {i}",) for i in range(1, 11)], "text string")
    out = udf_embedder(factory, 3, retryable=(ClientError,))(df, "text").collect()
    assert sum(r["error"] is None for r in out) == 5
    assert all(r["error"].startswith("ClientError") for r in out if r["error"])
    assert all(len(r["embedding"]) == 3 for r in out if r["error"] is None)


def test_pluggable_embedder_other_errors_fail(spark):
    def factory():
        def fn(text):
            raise ValueError("boom")
        return fn

    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(Exception):
        udf_embedder(factory, 3, retryable=(ClientError,))(df, "text").collect()


def test_wrong_width_is_an_error(spark):
    df = spark.createDataFrame([("a",)], "text string")
    r = udf_embedder(lambda: (lambda t: [1.0, 2.0]), 3)(df, "text").first()
    assert r["embedding"] is None and r["error"] == "bad width 2 != 3"


def test_batch_hash_vectors_equal_per_text():
    import numpy as np
    from scour.operators import embed as E

    texts = ["Hello  world\tagain", "", None, "x " * 5, "UPPER lower Upper", "a\r\nb", "long " * 30,
             "ünïcödé wörds ünïcödé", "   ", "one"]
    for mc in (None, 40):
        old_chunk = E._CHUNK_CHARS
        try:
            for chunk in (8 << 20, 3):          # one chunk, and one text per chunk
                E._CHUNK_CHARS = chunk
                vecs, errs = E.hash_vectors(texts, 16, mc)
                for t, v, e in zip(texts, vecs, errs):
                    want_v, want_e = E.hash_vector(t, 16, mc)
                    assert e == want_e
                    assert (v is None and want_v is None) or np.array_equal(v, want_v)
        finally:
            E._CHUNK_CHARS = old_chunk


def test_many_texts_are_embedded_in_bounded_memory():
    import tracemalloc

    from scour.operators.embed import hash_vectors

    texts = [" ".join(f"w{(i * 131 + j) % 9973}" for j in range(180)) for i in range(6_000)]
    tracemalloc.start()
    try:
        hash_vectors(texts, 16)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 << 20                               # all 6 million characters at once: over 100 MB
