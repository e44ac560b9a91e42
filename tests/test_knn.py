"""kNN: every strategy equals numpy brute force; approximate recall floor."""

import numpy as np
import pytest

from scour.operators.knn import _Best, _seq_sq_l2, build_ivf, knn, knn_single, split_valid


def _data(spark, n=300, q=40, d=16, seed=3, dup=True):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d)).astype(np.float32)
    if dup:
        X[5] = X[7]  # an exact tie
    Q = np.vstack([X[:q // 2], rng.normal(size=(q - q // 2, d)).astype(np.float32)])
    corpus = spark.createDataFrame([(int(i), X[i].tolist()) for i in range(n)],
                                   "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(int(i), Q[i].tolist()) for i in range(q)],
                                    "query_id long, qv array<float>")
    return X.astype(np.float64), Q.astype(np.float64), corpus, queries


def _brute(X, Q, k):
    out = {}
    for i, qv in enumerate(Q):
        d2 = ((X - qv) ** 2).sum(1)
        order = sorted(range(len(X)), key=lambda j: (d2[j], j))[:k]
        out[i] = order
    return out


@pytest.mark.parametrize("block", [1 << 20, 2000])     # one block of queries; several
def test_scan_equals_brute_force(spark, block):
    X, Q, corpus, queries = _data(spark)
    assert _hits(knn(queries, corpus, 5, query_block_bytes=block)) == _brute(X, Q, 5)


def test_cells_are_exact_and_probing_recalls(spark):
    X, Q, corpus, queries = _data(spark, n=900, q=50, d=8, seed=5)
    ivf = build_ivf(corpus, dim=8, cells=12)
    truth = _brute(X, Q, 5)
    assert _hits(knn(queries, corpus, 5, index=ivf)) == truth
    some = _hits(knn(queries, corpus, 5, index=ivf, nprobe=3, query_block_bytes=400))
    assert np.mean([len(set(some.get(i, [])) & set(v)) / 5 for i, v in truth.items()]) >= 0.7


def test_corpus_is_in_no_exchange(spark):
    _, _, corpus, queries = _data(spark)
    for index in (None, build_ivf(corpus, dim=16, cells=4)):
        plan = knn(queries, corpus, 5, index=index)._jdf.queryExecution().executedPlan().toString()
        assert "embedding" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def _hits(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


def test_single_query(spark):
    X, Q, corpus, _ = _data(spark)
    got = knn_single(corpus, Q[3].tolist(), 4, cid="doc_id").orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == _brute(X, Q[3:4], 4)[0]
    assert got[0]["rank"] == 1 and got[0]["score"] == pytest.approx(1 / (1 + got[0]["dist2"]))


BAD = [(91, None), (92, [1.0]), (93, [float("nan"), 0.0]), (94, [None, 1.0])]


def test_bad_corpus_rows_are_left_out_and_named(spark):
    good = [(i, [float(i), 0.0]) for i in range(40)]
    corpus = spark.createDataFrame(good + BAD, "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, qv array<float>")
    for index in (None, build_ivf(corpus, dim=2, cells=3)):
        assert _hits(knn(queries, corpus, 50, index=index))[1] == list(range(40))
    top = knn_single(corpus, [0.0, 0.0], 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in top] == [0, 1, 2]
    _, rejects = split_valid(corpus, "embedding", 2)
    assert {r["doc_id"]: r["reason"] for r in rejects.collect()} == {
        91: "missing vector", 92: "width 1 != 2", 93: "null or NaN cell", 94: "null or NaN cell"}


def test_width_is_never_guessed(spark):
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)],
                                   "doc_id long, embedding array<float>")
    mixed = spark.createDataFrame([(0, [1.0, 1.0, 1.0])] + [(i, [0.0, float(i)]) for i in range(1, 5)],
                                  "query_id long, qv array<float>")
    with pytest.raises(ValueError):
        knn(mixed, corpus, 3)
    got = _hits(knn(mixed, corpus, 3, dim=2))
    assert set(got) == {1, 2, 3, 4} and all(len(v) == 3 for v in got.values())


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_id_types(spark, kind):
    rows = [(str(i) if kind == "string" else i, [float(i), 0.0]) for i in range(9)]
    corpus = spark.createDataFrame(rows, f"doc_id {kind}, embedding array<float>")
    queries = corpus.selectExpr("doc_id as query_id", "embedding as qv")
    got = knn(queries, corpus, 1).collect()
    assert len(got) == 9 and all(r["query_id"] == r["doc_id"] for r in got)


def _searched(X, Q, k, ids=None, to_beat=None, step=50):
    best = _Best(Q, k, to_beat)
    ids = np.arange(len(X)) if ids is None else ids
    for lo in range(0, len(X), step):
        best.scan(X[lo:lo + step], ids[lo:lo + step])
    best.merge()
    place = np.lexsort((best.ids, best.d, best.q))
    return [best.ids[place][best.q[place] == i].tolist() for i in range(len(Q))]


@pytest.mark.parametrize("shift,scale", [(0, 1), (1000, 0.01), (0, 1e-25), (0, 1e25), (-3, 1e6)])
def test_screening_in_single_precision_is_exact(shift, scale):
    """Far from the origin, tiny, and beyond single precision: the exact neighbours, ties by id."""
    rng = np.random.default_rng(9)
    X = rng.normal(size=(700, 12)) * scale + shift
    X[300:340] = X[5]                                    # ties
    X = X[rng.permutation(700)]
    want = [np.lexsort((np.arange(700), _seq_sq_l2(np.tile(q, (700, 1)), X)))[:6].tolist() for q in X[:90]]
    assert _searched(X, X[:90], 6) == want
    beat = [_seq_sq_l2(X[i:i + 1], X[w[2]:w[2] + 1])[0] for i, w in enumerate(want)]
    got = _searched(X, X[:90], 6, to_beat=np.array(beat))
    assert all(g[:3] == w[:3] for g, w in zip(got, want, strict=True))


def test_a_batch_is_compared_exactly_where_it_can_be_nearer_only(monkeypatch):
    """Once a query has near rows, others cost no selection and no exact comparison."""
    from scour.operators import knn as module

    compared = []
    exact = module._seq_sq_l2
    monkeypatch.setattr(module, "_seq_sq_l2", lambda a, b: compared.append(len(a)) or exact(a, b))
    rng = np.random.default_rng(10)
    X = rng.normal(size=(20_000, 16))
    _searched(X, X[:200], 5, step=1000)
    assert sum(compared) < 200 * 5 * 12                  # 20 batches of 5 each before: 20,000
