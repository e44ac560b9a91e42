"""Graph search: everything is reachable, a full beam is exact, a beam has its recall."""

import numpy as np
import pytest

from scour.operators.knn import knn
from scour.operators.knn_blocks import recall
from scour.operators.knn_graph import _reached, build_graph, knn_graph, neighbour_graph, walk
from tests.test_knn import _brute, _data, _hits


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
def test_every_vector_is_reached_and_a_full_beam_is_exact(kind):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 6))
    if kind == "clusters":
        X = np.repeat(rng.normal(size=(10, 6)) * 100, 30, axis=0) + X * 0.01
    if kind == "copies":
        X = np.repeat(rng.normal(size=(3, 6)), 100, axis=0)
    edges, entry = neighbour_graph(X, 6)
    assert _reached(edges, entry).all()
    padded = np.full((300, max(map(len, edges))), -1)
    for i, e in enumerate(edges):
        padded[i, :len(e)] = e
    q, x = walk(X, padded, entry, X[:20], 300)
    assert all(set(x[q == i].tolist()) == set(range(300)) for i in range(20))


@pytest.mark.parametrize("part_rows,query_rows", [(5_000, 2_000), (60, 7)])      # one graph; many blocks
def test_graph_search_recall(spark, part_rows, query_rows):
    X, Q, corpus, queries = _data(spark, n=500, q=40, d=16)
    index = build_graph(corpus, dim=16, degree=12, part_rows=part_rows)
    full = knn_graph(queries, index, 5, beam=500, query_rows=query_rows)
    assert _hits(full) == _brute(X, Q, 5)
    got = recall(knn_graph(queries, index, 5, beam=48, query_rows=query_rows), knn(queries, corpus, 5)).collect()
    assert len(got) == 40 and np.mean([r["recall"] for r in got]) >= 0.9


def test_graph_of_few_bad_and_no_rows(spark):
    rows = [(i, [float(i), 0.0]) for i in range(3)] + [(91, None), (92, [1.0]), (93, [float("nan"), 0.0])]
    corpus = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "query_id long, qv array<float>")
    assert _hits(knn_graph(queries, build_graph(corpus, dim=2), 50)) == {1: [0, 1, 2]}
    assert _hits(knn_graph(queries, build_graph(corpus.limit(1), dim=2), 50)) == {1: [0]}
    assert knn_graph(queries, build_graph(corpus.limit(0), dim=2), 3).count() == 0
    assert knn_graph(queries.limit(0), build_graph(corpus, dim=2), 3).count() == 0


def test_a_walk_takes_no_distance_twice(monkeypatch):
    """A hub with many neighbours does not widen the work of all others."""
    from scour.operators import knn_graph as module

    rng = np.random.default_rng(8)
    X = rng.normal(size=(400, 6))
    edges, entry = neighbour_graph(X, 6)
    edges[entry] = sorted(set(range(400)) - {entry})
    padded = np.full((400, 399), -1)
    for i, e in enumerate(edges):
        padded[i, :len(e)] = e
    taken = []
    plain = module._sq
    monkeypatch.setattr(module, "_sq", lambda a, b: (lambda d: taken.append(d.size) or d)(plain(a, b)))
    q, x = walk(X, padded, entry, X[:20], 30)
    assert len(q) == 20 * 30 and sum(taken) <= 20 * 400
    for i in range(20):                                  # all are neighbours of the entry: exact
        assert set(x[q == i]) == set(np.argsort(plain(X, X[i]))[:30])


def _padded(edges):
    out = np.full((len(edges), max(map(len, edges))), -1)
    for i, e in enumerate(edges):
        out[i, :len(e)] = e
    return out


def test_a_group_of_walkers_compares_a_row_once(monkeypatch):
    """What one walker comes to is compared with all of its group, by one product."""
    from scour.operators import knn_graph as module

    X = np.random.default_rng(12).normal(size=(900, 12))
    edges, entry = neighbour_graph(X, 12)
    compared = []
    plain = module._Walks._compare
    monkeypatch.setattr(module._Walks, "_compare",
                        lambda self, Q, held, rows: compared.extend(rows.tolist()) or plain(self, Q, held, rows))
    q, x = walk(X, _padded(edges), entry, X[:300] + 0.01, 20)
    assert len(q) == 300 * 20 and len(compared) == len(set(compared)) <= 900


def test_a_graph_holds_more_rows_and_is_wider_there(spark):
    """More than 5,000 rows are one graph, in which a walker alone finds as much."""
    from scour.operators import knn_graph as module

    rng = np.random.default_rng(13)
    X = rng.normal(size=(8_000, 24))
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "doc_id long, embedding array<double>")
    index = build_graph(corpus, dim=24, degree=8)
    rows = index.rows.orderBy("node").collect()
    assert index.parts == 1 and len(rows) == 8_000
    assert np.mean([len(r["neighbours"]) for r in rows]) > 8
    starts = np.r_[0, np.cumsum([len(r["neighbours"]) for r in rows])]
    walks = module._Walks(np.array([r["embedding"] for r in rows]), starts,
                          np.concatenate([r["neighbours"] for r in rows]), [r["entry"] for r in rows].index(True))
    hits = 0
    for q in rng.normal(size=(40, 24)):
        _, x = walks.of(q[None], 64)
        near = np.argsort(((X - q) ** 2).sum(1))[:5].tolist()
        hits += len(set(near) & {rows[i]["doc_id"] for i in x.tolist()})
    assert hits >= 0.9 * 200


@pytest.mark.parametrize("kind", ["far", "tight", "outlier", "endless", "tiny"])
def test_walks_of_odd_vectors_find_their_neighbours(kind):
    """Far from the origin, in tight clusters far apart, beside vectors of another size."""
    rng = np.random.default_rng(14)
    X = rng.normal(size=(1_500, 16))
    if kind == "far":
        X = X * 0.01 + 1_000.0
    if kind == "tight":
        X = np.repeat(rng.normal(size=(5, 16)), 300, axis=0) * 100 + X * 0.01
    if kind == "tiny":
        X = X * 1e-25
    asked = np.arange(3, 1_500, 30)
    Q = X[asked] * (1 + 1e-7)
    if kind == "outlier":
        X[0] *= 1e30
    if kind == "endless":
        X[0, 3] = np.inf
    edges, entry = neighbour_graph(X, 16)
    assert _reached(edges, entry).all()
    found = 0
    with np.errstate(all="ignore"):
        for i, q in zip(asked, Q, strict=True):
            _, x = walk(X, _padded(edges), entry, q[None], 64)
            near = np.argsort(((X - q) ** 2).sum(1))[:5].tolist()
            assert i in x
            found += len(set(near) & set(x.tolist()))
    assert found >= 0.9 * 5 * len(asked)
