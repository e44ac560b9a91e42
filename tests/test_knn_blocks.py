"""Distributed search: exact form equals numpy brute force, probing has its recall."""

import numpy as np
import pytest

from scour.operators.knn import knn
from scour.operators.knn_blocks import build_cells, knn_blocks, recall
from tests.test_knn import _brute, _data, _hits


@pytest.mark.parametrize("piece_rows,query_rows", [(50_000, 10_000), (25, 3)])   # whole cells; many blocks
def test_blocks_equal_brute_force(spark, piece_rows, query_rows):
    X, Q, corpus, queries = _data(spark, n=500, q=60, d=8)
    index = build_cells(corpus, dim=8, coarse=5, fine=3, piece_rows=piece_rows)
    assert _hits(knn_blocks(queries, index, 5, query_rows=query_rows)) == _brute(X, Q, 5)


def test_clustered_vectors_and_ties(spark):
    rng = np.random.default_rng(4)
    X = np.repeat(rng.normal(size=(6, 4)), 40, axis=0).astype(np.float32)    # copies: all ties
    X[::7] += rng.normal(size=(len(X[::7]), 4)).astype(np.float32) * 0.01
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "doc_id long, embedding array<float>")
    queries = corpus.selectExpr("doc_id as query_id", "embedding as qv").filter("query_id % 9 = 0")
    index = build_cells(corpus, dim=4, coarse=4, fine=4, piece_rows=30)
    Q = {i: X[i].astype(np.float64) for i in range(0, len(X), 9)}
    got = _hits(knn_blocks(queries, index, 7, query_rows=5))
    assert got == {i: v for i, v in zip(Q, _brute(X.astype(np.float64), list(Q.values()), 7).values(), strict=True)}


def test_more_neighbours_than_vectors_and_bad_rows(spark):
    rows = [(i, [float(i), 0.0]) for i in range(9)] + [(91, None), (92, [1.0]), (93, [float("nan"), 0.0])]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0])],
                                    "query_id long, qv array<float>")
    index = build_cells(corpus, dim=2, coarse=3, fine=2)
    assert _hits(knn_blocks(queries, index, 50)) == {1: list(range(9))}
    none = build_cells(corpus.limit(0), dim=2)
    assert knn_blocks(queries, none, 3).count() == 0 and knn_blocks(queries.limit(0), index, 3).count() == 0


def test_probing_reaches_its_recall(spark):
    X, Q, corpus, queries = _data(spark, n=900, q=60, d=8, seed=5)
    index = build_cells(corpus, dim=8, coarse=8, fine=8)
    exact = knn(queries, corpus, 5)
    few, some = (np.mean([r["recall"] for r in recall(knn_blocks(queries, index, 5, nprobe=p), exact).collect()])
                 for p in (2, 24))
    assert few < some and some >= 0.9
    assert _hits(knn_blocks(queries, index, 5, nprobe=64)) == _brute(X, Q, 5)


def test_queries_stay_off_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    _, _, corpus, queries = _data(spark, n=200, q=40, d=8)
    index = build_cells(corpus, dim=8, coarse=4, fine=2)
    seen = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: seen.append(df.columns) or collect(df))
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: pytest.fail("vectors on the driver"))
    knn_blocks(queries, index, 5)
    assert seen and all(c == ["cell", "n"] for c in seen)


def test_string_ids(spark):
    corpus = spark.createDataFrame([(f"d{i}", [float(i), 0.0]) for i in range(9)], "doc_id string, embedding array<float>")
    queries = corpus.selectExpr("doc_id as query_id", "embedding as qv")
    got = knn_blocks(queries, build_cells(corpus, dim=2, coarse=2, fine=2), 1).collect()
    assert len(got) == 9 and all(r["query_id"] == r["doc_id"] for r in got)


def test_the_second_pass_returns_what_beats_the_first(spark, monkeypatch):
    from scour.operators import knn_blocks as module

    X, Q, corpus, queries = _data(spark, n=600, q=60, d=4, dup=False)
    index = build_cells(corpus, dim=4, coarse=6, fine=4)
    merged = []
    final = module._final_topk
    monkeypatch.setattr(module, "_final_topk", lambda c, *a: merged.append(c.count()) or final(c, *a))
    assert _hits(knn_blocks(queries, index, 5)) == _brute(X, Q, 5)
    far = merged[-1] - 60 * 5
    cells = module._sent(queries.withColumn("to_beat", module.F.lit(float("inf"))), index, 5, None,
                         "query_id", "qv", True).count()
    assert far < cells                                   # k a cell and query before
