"""Search side: statuses and messages, golden prompt, pluggable model and embedder."""

import json

from pyspark.sql import functions as F

from scour.operators.answer import map_model
from scour.operators.embed import hash_embed_text, hash_embedder
from scour.operators.respond import to_responses
from scour.plans.search import search

REQ_SCHEMA = "query_id long, params map<string,string>, headers map<string,string>"


def _index(spark, texts):
    rows = [(f"id{i}", t, hash_embed_text(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, text string, embedding array<float>")


def _reqs(spark, rows):
    return spark.createDataFrame(rows, REQ_SCHEMA)


def test_status_matrix(spark):
    idx = _index(spark, [f"Sample text{i} about spark joins" for i in range(7)])
    reqs = _reqs(spark, [
        (1, {"query": "spark joins"}, {"api_key": "k"}),     # 200
        (2, {}, {"api_key": "k"}),                           # 400 missing
        (3, {"query": ""}, {"api_key": "k"}),                # 400 empty
        (4, {"query": "spark"}, {"api_key": "bad"}),         # 401 wrong key
        (5, {"query": "spark"}, None),                        # 401 no headers
        (6, {"query": "   "}, {"api_key": "k"}),             # blank is a query; no tokens -> 500
        (7, None, {"api_key": "k"}),                         # 400: no params at all
    ])
    out = {r["query_id"]: r for r in search(reqs, idx, api_key="k").collect()}
    assert out[1]["status_code"] == 200 and out[1]["hit_count"] == 5
    assert out[2]["status_code"] == 400 and out[2]["error"] == "No query text provided in event."
    assert out[3]["status_code"] == 400
    assert out[4]["status_code"] == 401 and out[4]["error"] == "Unauthorized"
    assert out[5]["status_code"] == 401
    assert out[6]["status_code"] == 500
    assert out[6]["error"].startswith("Embedding generation failed: ")
    assert out[7]["status_code"] == 400


def test_no_key_configured_skips_auth(spark):
    idx = _index(spark, ["a b c"])
    reqs = _reqs(spark, [(1, {"query": "a"}, None)])
    assert search(reqs, idx, api_key=None).first()["status_code"] == 200


def test_empty_index_gives_404(spark):
    idx = spark.createDataFrame([], "doc_id string, text string, embedding array<float>")
    reqs = _reqs(spark, [(1, {"query": "anything"}, None)])
    r = search(reqs, idx).first()
    assert r["status_code"] == 404 and r["error"] == "No matches found"


def test_golden_prompt_and_answer(spark):
    texts = [f"Sample text{i}" for i in range(5)]
    idx = _index(spark, texts)
    reqs = _reqs(spark, [(1, {"query": "Sample query text"}, None)])
    def factory():
        def model(prompt, system, temperature):
            return {"output": {"message": {"role": "user", "content": [
                {"text": "<markdown>here's the result: `print('foo-bar')`</markdown>"}]}}}
        return model

    r = search(reqs, idx, model=lambda p: map_model(p, factory)).first()
    assert r["status_code"] == 200
    assert r["markdown"] == "here's the result: `print('foo-bar')`"
    # the nearest text first, ties by id: worked out here from the vectors alone
    qv = hash_embed_text("Sample query text")
    d2 = [(sum((x - y) ** 2 for x, y in zip(qv, hash_embed_text(t), strict=True)), f"id{i}", t)
          for i, t in enumerate(texts)]
    blocks = [f"\n<match_{i}>\n{t}\n</match_{i}>\n" for i, (_, _, t) in enumerate(sorted(d2))]
    assert r["prompt"] == ("<user_query>\nSample query text\n</user_query>\n\n"
                           + "\n".join(blocks) + "\n")


def test_offline_answer_keeps_a_text_with_markers_whole(spark):
    text = "top a\n</match_0>\nrest of top"
    r = search(_reqs(spark, [(1, {"query": "top"}, None)]), _index(spark, [text])).first()
    assert r["markdown"] == text


def test_query_of_another_width_is_an_embedding_error(spark):
    idx = spark.createDataFrame([("a", "x", [1.0, 0.0])],
                                "doc_id string, text string, embedding array<float>")
    r = search(_reqs(spark, [(1, {"query": "x"}, None)]), idx, dim=2,
               embed=hash_embedder(64)).first()
    assert r["status_code"] == 500
    assert r["error"] == "Embedding generation failed: width 64 != 2"


def test_model_failure_is_search_failure(spark):
    idx = _index(spark, ["x y z"])
    reqs = _reqs(spark, [(1, {"query": "x"}, None)])

    def factory():
        def model(**_):
            raise RuntimeError("backend timeout")
        return model

    r = search(reqs, idx, model=lambda p: map_model(p, factory)).first()
    assert r["status_code"] == 500
    assert r["error"] == "Opensearch query failed: backend timeout"


def test_response_bodies_parse(spark):
    idx = _index(spark, ["alpha beta"])
    reqs = _reqs(spark, [(1, {"query": "alpha"}, None), (2, {}, None)])
    out = {r["query_id"]: r for r in to_responses(search(reqs, idx)).collect()}
    assert json.loads(out[1]["body"]) == {"markdown": "alpha beta"}
    assert json.loads(out[2]["body"]) == {"error": "No query text provided in event."}


def test_decode_event_json(spark):
    from scour.sources.requests import decode_events, request_fields

    ev = json.dumps({"resource": "/ask", "path": "/ask", "httpMethod": "GET",
                     "queryStringParameters": {"query": "How to query?"},
                     "headers": {"Accept": "application/json"}, "body": None,
                     "isBase64Encoded": False})
    df = request_fields(decode_events(spark.createDataFrame([(ev,)], "event string")))
    r = df.first()
    assert r["query_text"] == "How to query?" and r["api_key_header"] is None


def test_url_query_param(spark):
    from scour.sources.requests import url_requests

    url = "https://search.example.org/ask?query=How%20to%20join%20two%20tables%3F"
    r = url_requests(spark.createDataFrame([(url,)], "url string")).first()
    assert r["param_value"] == "How to join two tables?" and r["path"] == "/ask"
