"""Nearest-neighbour search over DataFrames, exact.

Both forms return ``(query id, rank, corpus id, dist2, score)`` with ties on
distance broken by corpus id, and neither moves the corpus:

* ``knn_single`` - one query vector: a JVM distance expression plus
  ``orderBy(...).limit(k)``, which Catalyst plans as ``TakeOrderedAndProject``
  (a per-partition top-k, then a k x partitions merge).
* ``knn`` - a table of queries, in blocks of bounded size that ride along with
  the tasks; each corpus partition streams through ``mapInArrow`` and emits
  only its k best per query. A batch of the corpus is compared with a query
  only if it can hold something nearer than what the query has already: its
  vectors lie in a ball around their mean, and the distance to the ball is a
  lower bound.

``build_ivf`` writes a corpus ordered by cell (the nearest of a bounded number
of centroids). Its batches are small balls, so the bound prunes most of them;
``nprobe`` reads only the nearest cells of every query, which is approximate.

Vectors must be of one width, without NULL or NaN cells. ``split_valid`` parts
the rows that are not; the searches leave such corpus rows out and raise on
queries of unknown width rather than guess one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions.vectors import l2_score, sq_l2
from scour.operators.index import check_vectors
from scour.session import materialize as write_stage

# Slack on distance comparisons between the screening (matrix product) form
# and the exact left-to-right form of the squared distance.
_EPS = 1e-7
#: Rounding of one single-precision operation, doubled; the least number it can tell
#: from 0; and the largest squared length that is screened in single precision.
_ROUNDING, _TINY, _LARGEST = 2.0 ** -22, 1e-36, 1e30
_SUB_QUERIES = 256
_BATCH_ROWS = 1024
#: Bytes of query vectors and ids that ride along with the tasks at once.
QUERY_BLOCK_BYTES = 32 << 20


# --------------------------------------------------------------------------
# numpy kernels (run inside tasks)
# --------------------------------------------------------------------------

def _seq_sq_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared L2 per row, summed over dimensions left to right, in double."""
    acc = np.zeros(a.shape[0], dtype=np.float64)
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        acc += d * d
    return acc


def _id_order(ids: np.ndarray) -> np.ndarray:
    """Integer codes that sort like the ids (numbers or strings)."""
    if ids.dtype.kind in "iuf":
        return ids
    codes, _ = pd.factorize(pd.Series(ids), sort=True)
    return codes


def _first_k(qi: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of every query, in ``order`` (sorted by query)."""
    q = qi[order]
    first = np.r_[True, q[1:] != q[:-1]]
    idx = np.arange(len(q))
    start = np.maximum.accumulate(np.where(first, idx, 0))
    return order[(idx - start) < k]


def _block_topk(Q: np.ndarray, X: np.ndarray, xorder: np.ndarray, k: int):
    """k best corpus rows per query. Returns (query idx, corpus idx, d2)."""
    outs_q, outs_x, outs_d = [], [], []
    if len(Q) == 0 or len(X) == 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, np.zeros(0)
    xn = np.einsum("ij,ij->i", X, X)
    kk = min(k, X.shape[0])
    for s in range(0, len(Q), _SUB_QUERIES):
        Qs = Q[s:s + _SUB_QUERIES]
        approx = np.einsum("ij,ij->i", Qs, Qs)[:, None] + xn[None, :] - 2.0 * (Qs @ X.T)
        if kk < X.shape[0]:
            kth = np.partition(approx, kk - 1, axis=1)[:, kk - 1]
        else:
            kth = approx.max(axis=1)
        qi, xi = np.nonzero(approx <= (kth + _EPS)[:, None])
        d2 = _seq_sq_l2(Qs[qi], X[xi])
        keep = _first_k(qi, np.lexsort((xorder[xi], d2, qi)), k)
        outs_q.append(qi[keep] + s)
        outs_x.append(xi[keep])
        outs_d.append(d2[keep])
    return np.concatenate(outs_q), np.concatenate(outs_x), np.concatenate(outs_d)


def _list_matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Flat Arrow list<float> column -> (rows, dim) float64 matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


class _Best:
    """The k best rows so far of every query, and the distance to beat.

    A batch is screened in single precision, around a common centre: what is beyond the
    distance to beat by more than the rounding can be is out, and only the rest is
    compared exactly. What passes is merged each time the rows seen have doubled."""

    def __init__(self, Q: np.ndarray, k: int, to_beat: np.ndarray | None = None):
        self.Q, self.k = Q, k
        self.to_beat = np.full(len(Q), np.inf) if to_beat is None else np.array(to_beat, np.float64)
        self.q, self.ids, self.d = np.zeros(0, np.int64), None, np.zeros(0)
        self.new, self.many, self.rows, self.due = [], 0, 0, 0
        self.centre = None

    def _start(self, X: np.ndarray) -> None:
        self.centre = X.mean(0)
        Q = self.Q - self.centre
        self.qn = np.einsum("ij,ij->i", Q, Q)
        self.left = np.empty((len(Q), Q.shape[1] + 1), np.float32)
        self.left[:, :-1], self.left[:, -1] = -2.0 * Q, 1.0

    def _near(self, X: np.ndarray) -> np.ndarray:
        """Queries that something in the ball around X (less the centre) could still improve."""
        mid = X.mean(0)
        radius = math.sqrt(max(0.0, float(((X - mid) ** 2).sum(1).max())))
        mn = float(mid @ mid)
        away = self.qn + mn + self.left[:, :-1] @ mid.astype(np.float32)
        away -= _ROUNDING * X.shape[1] * (np.sqrt(self.qn) + math.sqrt(mn)) ** 2
        low = np.maximum(np.sqrt(np.maximum(away, 0.0)) - radius, 0.0) ** 2
        return np.flatnonzero(low <= self.to_beat * (1 + _EPS) + _EPS)

    def scan(self, X: np.ndarray, ids: np.ndarray) -> None:
        """Rows X of these ids."""
        if not len(self.Q) or not len(X):
            return
        if self.centre is None:
            with np.errstate(all="ignore"):
                self._start(X)
        with np.errstate(all="ignore"):
            C = X - self.centre
            xn = np.einsum("ij,ij->i", C, C)
        if not max(float(self.qn.max()), float(xn.max())) < _LARGEST:      # beyond single precision, or no number
            q, x, d2 = _block_topk(self.Q, X, _id_order(ids), self.k)
            self._hold(q, ids[x], d2)
        else:
            pick = self._near(C)
            for q, x in _grouped(self._screened(pick, C, xn)):
                d2 = _seq_sq_l2(self.Q[q], X[x])
                keep = d2 <= self.to_beat[q]
                self._hold(q[keep], ids[x[keep]], d2[keep])
        self.rows += len(X)
        if self.rows >= self.due or self.many > 4 * self.k * len(self.Q):
            self.merge()
            self.due = 2 * self.rows

    def _screened(self, pick: np.ndarray, C: np.ndarray, xn: np.ndarray):
        """(query, row) of pairs that may be near enough, a block of queries at a time."""
        right = np.empty((len(C), C.shape[1] + 1), np.float32)
        right[:, :-1], right[:, -1] = C, xn
        right = right.T
        far = math.sqrt(float(xn.max()))
        room, marks = np.empty((_SUB_QUERIES, len(C)), np.float32), np.zeros(_SUB_QUERIES * len(C) + 8, bool)
        for lo in range(0, len(pick), _SUB_QUERIES):
            own = pick[lo:lo + _SUB_QUERIES]
            slack = _ROUNDING * right.shape[0] * (np.sqrt(self.qn[own]) + far) ** 2 + _TINY
            d2 = np.matmul(self.left[own], right, out=room[:len(own)])     # less the query's square
            limit = self.to_beat[own] - self.qn[own] + slack
            if self.k < len(C) and np.isinf(limit).any():
                kth = np.partition(d2, self.k - 1, axis=1)[:, self.k - 1]
                limit = np.minimum(limit, kth + 2 * slack)
            limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
            np.less_equal(d2, limit[:, None], out=marks[:d2.size].reshape(d2.shape))
            at = _marked(marks[:-(-d2.size // 8) * 8])
            at = at[at < d2.size]                        # behind are marks of the block before
            yield own[at // len(C)], at % len(C)

    def _hold(self, q: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        if len(q):
            self.new.append((q, ids, d))
            self.many += len(q)

    def merge(self) -> None:
        if not self.new:
            return
        q, ids, d = (np.concatenate(c) for c in zip(*self.new, strict=True))
        self.new, self.many = [], 0
        touched = np.zeros(len(self.Q), bool)
        touched[q] = True
        if self.ids is not None:
            old = touched[self.q]
            q, d = np.concatenate([self.q[old], q]), np.concatenate([self.d[old], d])
            ids = np.concatenate([self.ids[old], ids])
        order = np.lexsort((d, q))
        same = (q[order][1:] == q[order][:-1]) & (d[order][1:] == d[order][:-1])
        if same.any():                                   # ties go to the smaller id
            tied = order[np.r_[False, same] | np.r_[same, False]]
            code = np.zeros(len(q), np.int64)
            code[tied] = np.unique(_id_order(ids[tied]), return_inverse=True)[1]
            order = np.lexsort((code, d, q))
        keep = _first_k(q, order, self.k)
        q, ids, d = q[keep], ids[keep], d[keep]
        last = np.r_[q[1:] != q[:-1], True]
        full = np.bincount(q, minlength=len(self.Q))[q[last]] >= self.k
        beaten = q[last][full]
        self.to_beat[beaten] = np.minimum(self.to_beat[beaten], d[last][full])
        if self.ids is not None:
            rest = ~touched[self.q]
            q, d = np.concatenate([self.q[rest], q]), np.concatenate([self.d[rest], d])
            ids = np.concatenate([self.ids[rest], ids])
        self.q, self.ids, self.d = q, ids, d


def _marked(marks: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a few marks among many, eight at a time."""
    some = np.flatnonzero(marks.view(np.uint64))
    row, at = np.nonzero(marks.reshape(-1, 8)[some])
    return some[row] * 8 + at


def _grouped(pairs, least: int = 2_048, most: int = 16_384):
    """Pairs of arrays in pieces of ``least`` to about ``most`` places, but for the last."""
    held, many = [], 0
    for q, x in pairs:
        for lo in range(0, len(q), most):
            held.append((q[lo:lo + most], x[lo:lo + most]))
            many += len(held[-1][0])
            if many >= least:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held, many = [], 0
    if many:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


# --------------------------------------------------------------------------
# rows that can take part
# --------------------------------------------------------------------------

def split_valid(df: DataFrame, vec: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(rows with a usable vector, the others with their ``reason``)."""
    tested = check_vectors(df, vec, dim)
    return (tested.filter("valid").drop("valid", "reason"),
            tested.filter(~F.col("valid")).drop("valid"))


def width_of(df: DataFrame, vec: str) -> int | None:
    """The one width of all vectors; None without any, an error with several."""
    got = df.filter(F.col(vec).isNotNull()).agg(F.min(F.size(vec)).alias("lo"),
                                                F.max(F.size(vec)).alias("hi")).first()
    if got["lo"] != got["hi"]:
        raise ValueError(f"vectors of width {got['lo']} to {got['hi']}: name the width with dim")
    return got["lo"]


# --------------------------------------------------------------------------
# searches
# --------------------------------------------------------------------------

def knn_single(corpus: DataFrame, query_vector, k: int = 1, *, cid: str = "doc_id",
               cvec: str = "embedding") -> DataFrame:
    """k nearest corpus rows to one query vector (a list of floats). Corpus rows
    without a usable vector of its width are left out (see ``split_valid``)."""
    values = [float(x) for x in query_vector]
    if not values or any(math.isnan(x) for x in values):
        raise ValueError("the query vector is empty or holds NaN")
    good, _ = split_valid(corpus.select(cid, cvec), cvec, len(values))
    d2 = sq_l2(F.col(cvec), F.lit(values).cast("array<double>"))
    top = (good.select(cid, d2.alias("dist2"))
           .orderBy(F.col("dist2"), F.col(cid))
           .limit(k))
    w = Window.orderBy(F.col("dist2"), F.col(cid))
    # the window runs over the k rows left after the limit only
    return top.select(F.row_number().over(w).cast("int").alias("rank"), cid, "dist2",
                      l2_score(F.col("dist2")).alias("score"))


def _final_topk(cands: DataFrame, k: int, qid: str, cid: str) -> DataFrame:
    w = Window.partitionBy(qid).orderBy(F.col("dist2"), F.col(cid))
    return (cands.withColumn("rank", F.row_number().over(w).cast("int"))
            .filter(F.col("rank") <= k)
            .select(qid, "rank", cid, "dist2", l2_score(F.col("dist2")).alias("score")))


def knn(queries: DataFrame, corpus: DataFrame, k: int = 5, *,
        qid: str = "query_id", qvec: str = "qv",
        cid: str = "doc_id", cvec: str = "embedding", dim: int | None = None,
        query_block_bytes: int = QUERY_BLOCK_BYTES, materialize: bool = True,
        index: "IvfIndex | None" = None, nprobe: int | None = None) -> DataFrame:
    """k nearest corpus vectors for every query row.

    ``dim`` is the width; without it the queries must all have one width.
    Queries and corpus rows without a usable vector of that width are left out
    (``split_valid`` names them). Queries are counted and sent in blocks of at
    most ``query_block_bytes``; each block is one scan of the corpus.

    With ``index`` the scan reads the corpus in cell order; all cells, which is
    exact, unless ``nprobe`` limits it to the nearest cells of every query,
    which may miss neighbours in others."""
    queries = queries.select(F.col(qid), F.col(qvec)).filter(F.col(qvec).isNotNull())
    if materialize:
        # written once: the embedder behind the queries runs once
        queries = write_stage(queries, "knn-queries")
    dim = dim or width_of(queries, qvec)
    if dim is None:
        return _empty_hits(queries, corpus, qid, cid)
    queries, _ = split_valid(queries, qvec, dim)
    id_bytes = F.octet_length(F.col(qid).cast("string"))
    size = queries.agg(F.count(F.lit(1)).alias("n"),
                       F.coalesce(F.sum(id_bytes + 8 * dim + 16), F.lit(0)).alias("b")).first()
    if not size["n"]:
        return _empty_hits(queries, corpus, qid, cid)
    blocks = max(1, math.ceil(size["b"] / query_block_bytes))
    rows = index.assigned if index is not None else corpus
    good, _ = split_valid(rows, cvec, dim)
    parts = None
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.filter(
            F.pmod(F.xxhash64(qid), F.lit(blocks)) == b)
        near = good
        if index is not None and nprobe:
            near = good.filter(F.col("cell").isin(index.cells_near(mine, qvec, dim, nprobe)))
        found = _scan_block(mine, near, k, qid, qvec, cid, cvec, dim)
        parts = found if parts is None else parts.unionByName(found)
    return _final_topk(parts, k, qid, cid)


def _empty_hits(queries, corpus, qid, cid):
    schema = T.StructType([queries.schema[qid], T.StructField("rank", T.IntegerType()),
                           corpus.schema[cid], T.StructField("dist2", T.DoubleType()),
                           T.StructField("score", T.DoubleType())])
    return queries.sparkSession.createDataFrame([], schema)


def _scan_block(queries, corpus, k, qid, qvec, cid, cvec, dim):
    """One block of queries shipped with the tasks; corpus streamed where it lies."""
    from pyspark.sql.pandas.types import to_arrow_type

    tbl = queries.toArrow()                               # bounded: one block
    ids = tbl.column(qid).combine_chunks() if tbl.num_rows else pa.array([])
    # the numbers as they are stored; tasks widen them
    Q = tbl.column(qvec).combine_chunks().flatten().to_numpy(zero_copy_only=False) if tbl.num_rows else np.zeros(0)
    q_type, c_type = (to_arrow_type(queries.schema[qid].dataType),
                      to_arrow_type(corpus.schema[cid].dataType))
    out_schema = T.StructType([queries.schema[qid], corpus.schema[cid],
                               T.StructField("dist2", T.DoubleType())])

    def scan(batches):
        best = _Best(Q.astype(np.float64).reshape(-1, dim), k)
        for whole in batches:
            for lo in range(0, whole.num_rows, _BATCH_ROWS):
                rb = whole.slice(lo, _BATCH_ROWS)
                best.scan(_list_matrix(rb.column(1), dim), rb.column(0).to_numpy(zero_copy_only=False))
        best.merge()
        if len(best.q):
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(best.q)).cast(q_type), pa.array(best.ids.tolist(), c_type),
                 pa.array(best.d, pa.float64())], names=[qid, cid, "dist2"])

    return corpus.select(cid, cvec).mapInArrow(scan, out_schema)


# --------------------------------------------------------------------------
# corpus in cell order
# --------------------------------------------------------------------------

def _cell_dists(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    cn = np.einsum("ij,ij->i", C, C)
    return np.einsum("ij,ij->i", X, X)[:, None] + cn[None, :] - 2.0 * (X @ C.T)


def _nearest_cells(X: np.ndarray, C: np.ndarray, n: int = 1) -> np.ndarray:
    """The n nearest centroids of every row, a bounded block of rows at a time."""
    step = max(1, (8 << 20) // (8 * len(C)))
    return np.concatenate([np.argsort(_cell_dists(X[i:i + step], C), axis=1, kind="stable")[:, :n]
                           for i in range(0, len(X), step)] or [np.zeros((0, n), np.int64)])


def drawn_vectors(corpus: DataFrame, cid: str, cvec: str, dim: int, rows: int) -> np.ndarray:
    """About ``rows`` vectors on the driver, drawn by the hash of the id, in id order."""
    share = min(1.0, rows / max(1, corpus.count()))
    drawn = corpus.filter(F.pmod(F.xxhash64(cid, F.lit("train")), F.lit(1 << 30))
                          < int(share * (1 << 30))).select(cid, cvec).toArrow()
    X = _list_matrix(drawn.column(cvec), dim) if drawn.num_rows else np.zeros((0, dim))
    return X[np.argsort(_id_order(drawn.column(cid).to_numpy()), kind="stable")] if len(X) else X


def lloyd(X: np.ndarray, cells: int, passes: int = 8) -> np.ndarray:
    """Lloyd's k-means: at most ``cells`` centroids; one at the origin without vectors."""
    if not len(X):
        return np.zeros((1, X.shape[1]))
    C = X[np.linspace(0, len(X) - 1, min(cells, len(X))).astype(int)].copy()
    for _ in range(passes):
        own = _nearest_cells(X, C)[:, 0]
        n = np.bincount(own, minlength=len(C))
        sums = np.zeros_like(C)
        np.add.at(sums, own, X)
        C[n > 0] = sums[n > 0] / n[n > 0, None]
    return C


def centroids_of(corpus: DataFrame, cid: str, cvec: str, dim: int, cells: int,
                 train_rows: int = 20_000, passes: int = 8) -> np.ndarray:
    """Centroids of a share of about ``train_rows`` vectors, on the driver. They decide
    how well the scan prunes, never what an exact search returns."""
    return lloyd(drawn_vectors(corpus, cid, cvec, dim, train_rows), cells, passes)


class IvfIndex:
    """Centroids (a bounded number) and the corpus with its cell, written in cell
    order. Build once, search many query tables."""

    def __init__(self, centroids: np.ndarray, assigned: DataFrame):
        self.centroids, self.assigned = centroids, assigned

    def cells_near(self, queries: DataFrame, qvec: str, dim: int, nprobe: int) -> list[int]:
        """All cells that are among the ``nprobe`` nearest of a query of the block."""
        tbl = queries.select(qvec).toArrow()              # bounded: one block
        if not tbl.num_rows:
            return []
        near = _nearest_cells(_list_matrix(tbl.column(qvec), dim), self.centroids,
                              min(nprobe, len(self.centroids)))
        return sorted(set(near.ravel().tolist()))


def build_ivf(corpus: DataFrame, *, cid: str = "doc_id", cvec: str = "embedding", dim: int,
              cells: int = 64, train_rows: int = 20_000) -> IvfIndex:
    """The usable rows of ``corpus``, range-partitioned by cell and written."""
    good, _ = split_valid(corpus.select(cid, cvec), cvec, dim)
    C = centroids_of(good, cid, cvec, dim, cells, train_rows)

    def assign(batches):
        for rb in batches:
            cell = _nearest_cells(_list_matrix(rb.column(1), dim), C)[:, 0]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(cell.astype(np.int32))],
                                             names=[cid, cvec, "cell"])

    schema = T.StructType([good.schema[cid], good.schema[cvec], T.StructField("cell", T.IntegerType())])
    placed = good.mapInArrow(assign, schema).repartitionByRange("cell", cid).sortWithinPartitions("cell", cid)
    return IvfIndex(C, write_stage(placed, "ivf-cells"))
