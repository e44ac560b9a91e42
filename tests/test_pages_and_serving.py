"""Pages by offset, cursor and SQL text; responses of a stream."""

import random

from pyspark.sql import functions as F

from scour.operators.embed import hash_embedder
from scour.operators.index import append_rows, create_if_missing, to_index_rows
from scour.session import scratch_path
from scour.sources import qa, sql
from scour.streaming.serve_stream import read_responses, serve_batch, serve_stream


def posts(spark):
    ids = list(range(10, 400, 3))
    random.Random(2).shuffle(ids)
    q = spark.createDataFrame([(i, f"t{i}", f"b{i}", None if i % 5 == 0 else i + 1) for i in ids],
                              "id long, title string, body string, accepted_answer_id long").repartition(4)
    a = spark.createDataFrame([(i + 1, f"a{i}") for i in ids if i % 7], "id long, body string")
    return q, a, sorted(i for i in ids if i % 5)


def rows(df):
    return sorted(tuple(r) for r in df.select("question_id", "question_title", "accepted_answer_body").collect())


def test_shallow_deep_and_sql_pages_are_the_same(spark):
    q, a, ids = posts(spark)
    for n, first in ((10, 0), (7, 13), (50, 95), (5, 1000), (0, 3)):
        expected = [(i, f"t{i}", f"a{i}" if i % 7 else None) for i in ids[first:first + n]]
        for page in (qa.source_page(q, a, n, first), qa.source_page(q, a, n, first, shallow=0),
                     sql.pairs_page(q, a, n, first)):
            assert rows(page) == expected
    plan = qa.source_page(q, a, 10, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_cursor_reads_every_pair_once(spark):
    q, a, ids = posts(spark)
    seen, cursor = [], None
    while True:
        page, cursor = qa.page_after(q, a, 30, cursor)
        seen += rows(page)
        if cursor is None:
            break
        assert max(seen)[0] == cursor
    assert [r[0] for r in seen] == ids


def test_sql_parameters_are_values_and_views_go(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x' OR '1'='1")], "id long, v string")
    before = {t.name for t in spark.catalog.listTables()}
    got = sql.parametrised(spark, "SELECT id FROM {t} WHERE v = :v", {"t": df}, {"v": "x' OR '1'='1"}).collect()
    assert [r["id"] for r in got] == [2]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_each_request_is_answered_once_whatever_runs_again(spark):
    texts = spark.createDataFrame([(f"{i:x}" * 8, f"text number {i} about topic {i % 3}") for i in range(12)],
                                  "doc_id string, text string")
    index = create_if_missing(spark, scratch_path(spark, "serve-index"), 16)
    append_rows(spark, index, to_index_rows(hash_embedder(16)(texts, "text"), 0))
    events = [(i, '{"queryStringParameters": {"query": "text number %d"}, "headers": {"api_key": "k"}}' % i)
              for i in range(8)] + [(8, '{"queryStringParameters": null}'), (9, "no json"),
                                    (10, '{"queryStringParameters": {"query": "x"}}')]
    source, out, ckpt = (scratch_path(spark, f"serve-{n}") for n in ("source", "out", "ckpt"))
    df = spark.createDataFrame(events + events[:2], "query_id long, event string")
    df.repartition(3, "query_id").write.parquet(source)
    options = {"k": 2, "api_key": "k", "dim": 16}
    for _ in range(2):
        serve_stream(spark, source, index, out, ckpt, **options)
    first = {r["query_id"]: r for r in read_responses(spark, out).collect()}
    assert read_responses(spark, out).count() == len(first) == 11
    assert {i: first[i]["status_code"] for i in range(11)} == {**{i: 200 for i in range(8)}, 8: 400, 9: 400, 10: 401}
    epoch = max(r["epoch"] for r in first.values())
    ids = [i for i, r in first.items() if r["epoch"] == epoch]
    assert epoch > 0 and len(ids) < 11
    serve_batch(spark, df.filter(F.col("query_id").isin(ids)), epoch, index, out, "requests", **options)
    assert {r["query_id"]: r for r in read_responses(spark, out).collect()} == first
    assert read_responses(spark, out).count() == 11
