"""Approximate nearest-neighbour search over a neighbour graph per index partition.

The corpus is dealt into partitions of bounded size by the hash of the id. Each
partition gets a navigable graph, a Parquet column ``neighbours`` beside the vectors:

* the nearest vectors of every vector, thinned so that no neighbour is nearer to a kept
  one than to the vector itself (edges in all directions, not all into one cluster);
* the same edges backwards;
* an edge to every vector that can't be reached from the entry (the vector nearest to
  the mean), from the nearest one that can: a search can reach all.

A search walks every partition from its entry, keeping the ``beam`` best seen and
expanding those that are not expanded, and merges the partitions' hits by a top-k. Queries
that are alike walk together, in numpy, and share what they see: vectors with clusters are
seen in part, vectors without nearly all by a large group, at the cost of a matrix
product. Queries and graphs meet in blocks of (partition, piece of the queries); no vector
visits the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.operators.knn import (_ROUNDING, _cell_dists, _final_topk, _first_k, _id_order, _list_matrix,
                                 _nearest_cells, _seq_sq_l2, split_valid)
from scour.session import materialize

PART_ROWS = 30_000
GRAPH_ROWS = 5_000              # beyond so many rows of a graph its degree grows, with the square root
QUERY_ROWS = 16_000             # the index is sent once for each piece of so many queries
_WALKERS = 1_024                # queries that walk together
_BATCH = 1_024                  # rows compared with the walkers at once
_FAR = 1_000.0                  # radii of a partition; what lies beyond walks as if it lay there

# A row in a beam: the bits of its distance, which sort like it, and its number.
_ROW, _NONE = np.uint64(2 ** 32 - 1), np.uint64(2 ** 64 - 1)


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...j,...j->...", d, d)


def _frame(X: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and radius (of nine tenths of the rows)."""
    with np.errstate(all="ignore"):
        centre = np.nan_to_num(np.median(X, 0))
        length = np.sqrt(_sq(X, centre))
    length = length[np.isfinite(length)]
    return centre, (float(np.quantile(length, 0.9)) or float(length.max()) or 1.0) if len(length) else 1.0


def _single(X: np.ndarray, frame: tuple[np.ndarray, float]) -> np.ndarray:
    """Vectors in a partition's frame, where single precision holds what tells them apart."""
    with np.errstate(all="ignore"):
        away = np.nan_to_num((X - frame[0]) / frame[1]).clip(-1e150, 1e150)
    length = np.sqrt(np.einsum("ij,ij->i", away, away)) / _FAR
    return (away / np.maximum(length, 1.0)[:, None]).astype(np.float32)


def _nearest(X: np.ndarray, S: np.ndarray, many: int) -> np.ndarray:
    """The ``many`` nearest other rows of every row, nearest first; ``S`` are the rows in single
    precision. Where neighbours are nearer than that can tell, double is used."""
    norms = np.einsum("ij,ij->i", S, S)
    slack = _ROUNDING * X.shape[1] * (np.sqrt(norms) + math.sqrt(norms.max())) ** 2
    out = np.empty((len(X), many), np.int32)
    for lo in range(0, len(X), 64):
        own = np.arange(lo, min(lo + 64, len(X)))
        d = S[own] @ (-2.0 * S.T)
        d += norms
        at, far = _first(d, own, many)
        rough = far + norms[own] < 100 * slack[own]
        if rough.any():
            at[rough] = _first(_cell_dists(X[own[rough]], X), own[rough], many)[0]
        out[own] = at
    return out


def _first(d: np.ndarray, own: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``many`` least of every row but its ``own``, least first, and the last of them."""
    d[np.arange(len(d)), own] = np.inf
    pick = np.argpartition(d, many - 1, axis=1)[:, :many]
    got = np.take_along_axis(d, pick, 1)
    return np.take_along_axis(pick, np.argsort(got, 1, "stable"), 1), got.max(1)


def _thinned(X: np.ndarray, near: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, candidate): of the candidates, nearest first, those that no kept one is nearer to."""
    rows, found = [], []
    for lo in range(0, len(X), 64):
        mine = near[lo:lo + 64]
        Y = X.take(mine, 0) - X[lo:lo + 64, None]
        away = np.einsum("rcj,rcj->rc", Y, Y)
        between = np.matmul(Y, Y.transpose(0, 2, 1))
        between *= -2.0
        between += away[:, :, None]
        between += away[:, None, :]
        nearer = between < away[:, :, None] * np.float32(1 - 1e-5)
        kept, size = np.zeros(mine.shape, bool), np.zeros(len(mine), np.int64)
        for j in range(mine.shape[1]):
            kept[:, j] = ~(kept[:, :j] & nearer[:, j, :j]).any(1) & (size < degree)
            size += kept[:, j]
        row, at = np.nonzero(kept)
        rows.append(row + lo)
        found.append(mine[row, at])
    return np.concatenate(rows), np.concatenate(found)


def _spans(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., one after the other."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + many, many)


def _reach(starts: np.ndarray, ends: np.ndarray, seen: np.ndarray, entry: int) -> None:
    """Marks what can be reached from ``entry`` by rows that are not seen."""
    todo = np.array([entry])
    while len(todo):
        seen[todo] = True
        to = ends[_spans(starts[todo], starts[todo + 1] - starts[todo])]
        todo = np.unique(to[~seen[to]])


def _reached(edges: list, entry: int) -> np.ndarray:
    seen = np.zeros(len(edges), bool)
    _reach(np.r_[0, np.cumsum([len(e) for e in edges])], np.concatenate(edges).astype(np.int64), seen, entry)
    return seen


def _edges(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges in both directions, once each: those of row i are ``ends[starts[i]:starts[i + 1]]``."""
    code = np.concatenate([a * np.int64(n) + b, b * np.int64(n) + a])
    code.sort()
    code = code[np.r_[True, code[1:] != code[:-1]]] if len(code) else code
    return np.searchsorted(code, np.arange(n + 1) * np.int64(n)), (code % n).astype(np.int32)


def _graph(X: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(starts, ends, entry) of the neighbours of every row, see ``_edges``."""
    n, S = len(X), _single(X, _frame(X))
    entry = int(_sq(S, S.mean(0)).argmin())
    if n == 1:
        return np.zeros(2, np.int64), np.zeros(0, np.int32), entry
    a, b = _thinned(S, _nearest(X, S, min(2 * degree, n - 1)), degree)
    starts, ends = _edges(a, b, n)
    seen, more = np.zeros(n, bool), []
    _reach(starts, ends, seen, entry)
    while not seen.all():
        inside, outside = np.flatnonzero(seen), np.flatnonzero(~seen)[:64]
        d = _cell_dists(X[outside], X[inside])
        nearest = inside[d.argmin(1)]
        for at in np.argsort(d.min(1), kind="stable"):    # the nearest pair of both sides first
            if not seen[outside[at]]:
                more.append((nearest[at], outside[at]))
                _reach(starts, ends, seen, int(outside[at]))
    if more:
        c, d = np.array(more).T
        starts, ends = _edges(np.concatenate([a, c]), np.concatenate([b, d]), n)
    return starts, ends, entry


def neighbour_graph(X: np.ndarray, degree: int) -> tuple[list[np.ndarray], int]:
    """(neighbours of every row, entry)."""
    starts, ends, entry = _graph(X, degree)
    return np.split(ends, starts[1:-1]), entry


def walk(X: np.ndarray, neighbours: np.ndarray, entry: int, Q: np.ndarray, beam: int,
         ) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the ``beam`` best rows that walks from the entry have seen.
    ``neighbours`` is padded with -1."""
    real = neighbours >= 0
    return _Walks(X, np.r_[0, np.cumsum(real.sum(1))], neighbours[real], entry).of(Q, beam)


class _Walks:
    """Walks over the neighbours of row i at ``ends[starts[i]:starts[i + 1]]``.

    The walkers of a group share what they see: a row that one of them comes to is compared
    with all, by one matrix product, and is expanded once. What the product leaves open, by
    more than its rounding, is compared by differences; all in single precision, so that
    what they find is to be compared exactly. They are done when all rows of their beams
    are expanded."""

    def __init__(self, X: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: int):
        self.frame, self.starts, self.ends, self.entry = _frame(X), starts, ends, entry
        self.X = _single(X, self.frame)
        self.norms = np.einsum("ij,ij->i", self.X, self.X)

    def of(self, Q: np.ndarray, beam: int, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the ``beam`` best rows that a group has seen, for each of its queries;
        with ``k``, of those that may be among the k best."""
        Q, n = _single(Q, self.frame), len(self.X)
        held = np.full((len(Q), min(beam, n)), _NONE)
        seen, expanded, rows = np.zeros(n, bool), np.zeros(n, bool), np.array([self.entry])
        while True:
            seen[rows] = True
            for lo in range(0, len(rows), _BATCH):
                self._compare(Q, held, rows[lo:lo + _BATCH])
            real = held != _NONE
            at = np.where(real, held & _ROW, 0).astype(np.int64)
            best = np.zeros(n, bool)
            best[at[real]] = True
            new = np.flatnonzero(best & ~expanded)
            if not len(new):
                break
            expanded[new] = True
            near = np.zeros(n, bool)
            near[self.ends[_spans(self.starts[new], self.starts[new + 1] - self.starts[new])]] = True
            rows = np.flatnonzero(near & ~seen)
        if k and k < held.shape[1]:
            real &= _distances(held) <= self._bound(Q, held[:, k - 1])[:, None]
        asked, place = np.nonzero(real)
        return asked, at[asked, place]

    def _bound(self, Q: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Square of a distance in single precision that no row can have which is nearer than the ``last``."""
        own, most = np.einsum("ij,ij->i", Q, Q), float(self.norms.max())
        slack = 2 * _ROUNDING * (Q.shape[1] + 1) * (np.sqrt(own) + math.sqrt(most))
        moved = np.maximum(own, most) >= (0.999 * _FAR) ** 2
        return np.where(moved | (last == _NONE), np.float32(np.inf), (np.sqrt(_distances(last)) + slack) ** 2)

    def _compare(self, Q: np.ndarray, held: np.ndarray, rows: np.ndarray) -> None:
        """Puts the rows into the beams that they are near enough for."""
        X, norms, beam = self.X.take(rows, 0), self.norms.take(rows), held.shape[1]
        own = np.einsum("ij,ij->i", Q, Q)
        d = Q @ (-2.0 * X.T)
        d += norms
        slack = _ROUNDING * (X.shape[1] + 1) * (np.sqrt(own) + math.sqrt(norms.max())) ** 2
        limit = np.where(held[:, -1] == _NONE, np.float32(np.inf), _distances(held[:, -1])) - own + slack
        near = d <= limit[:, None]
        if beam < len(rows) and np.count_nonzero(near) > 2 * held.size:
            limit = np.minimum(limit, np.partition(d, beam - 1, axis=1)[:, beam - 1] + 2 * slack)
            near = d <= limit[:, None]
        q, x = np.divmod(np.flatnonzero(near), len(rows))
        keys = np.empty(len(q), np.uint64)
        for lo in range(0, len(q), _BATCH):
            far = _sq(Q.take(q[lo:lo + _BATCH], 0), X.take(x[lo:lo + _BATCH], 0))
            keys[lo:lo + _BATCH] = far.view(np.uint32)
        keys = (keys << np.uint64(32)) | rows.take(x).astype(np.uint64)
        better = np.flatnonzero(keys < held[:, -1].take(q))
        if len(better):
            _enter(held, q.take(better), keys.take(better))


def _distances(held: np.ndarray) -> np.ndarray:
    return (held >> np.uint64(32)).astype(np.uint32).view(np.float32)


def _enter(held: np.ndarray, w: np.ndarray, keys: np.ndarray) -> None:
    """Puts rows, in order of their walkers, into the beams."""
    change = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    many, beam = np.diff(np.r_[change, len(w)]), held.shape[1]
    own = w[change]
    both = np.full((len(own), beam + int(many.max())), _NONE)
    both[:, :beam] = held[own]
    both[np.repeat(np.arange(len(own)), many), beam + np.arange(len(w)) - np.repeat(change, many)] = keys
    both.sort(1)
    held[own] = both[:, :beam]


class GraphIndex:
    """Vectors with their partition, place in it, neighbours and whether they are its entry."""

    def __init__(self, rows: DataFrame, parts: int, dim: int, cid: str, cvec: str):
        self.rows, self.parts, self.dim, self.cid, self.cvec = rows, parts, dim, cid, cvec


def build_graph(corpus: DataFrame, *, cid: str = "doc_id", cvec: str = "embedding", dim: int,
                degree: int = 24, part_rows: int = PART_ROWS) -> GraphIndex:
    """The graphs of the usable rows of ``corpus``, written. Rows of equal ids are rows."""
    good, _ = split_valid(corpus.select(cid, cvec), cvec, dim)
    parts = max(1, math.ceil(good.count() / part_rows))
    good = good.withColumn("part", F.pmod(F.xxhash64(cid), F.lit(parts)).cast("int"))
    schema = T.StructType([*good.schema.fields, T.StructField("node", T.IntegerType()),
                           T.StructField("neighbours", T.ArrayType(T.IntegerType())),
                           T.StructField("entry", T.BooleanType())])

    def linked(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(_id_order(table[cid].to_numpy()), kind="stable")))
        wider = max(1.0, math.sqrt(table.num_rows / GRAPH_ROWS))
        starts, ends, entry = _graph(_list_matrix(table[cvec], dim), math.ceil(degree * wider))
        place = np.arange(table.num_rows, dtype=np.int32)
        return (table.append_column("node", pa.array(place))
                .append_column("neighbours", pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ends)))
                .append_column("entry", pa.array(place == entry)))

    rows = materialize(good.groupBy("part").applyInArrow(linked, schema), "knn-graph")
    return GraphIndex(rows, parts, dim, cid, cvec)


def knn_graph(queries: DataFrame, index: GraphIndex, k: int = 5, *, qid: str = "query_id", qvec: str = "qv",
              beam: int = 64, query_rows: int = QUERY_ROWS) -> DataFrame:
    """About the k nearest vectors of every query: (query id, rank, id, dist2, score), ties
    on distance broken by id. A wider ``beam`` (k at least) finds more of them; as wide
    as a partition it finds all.

    Queries without a usable vector are left out; an empty side gives no rows."""
    from pyspark.sql.pandas.types import to_arrow_type

    dim, cid, cvec, width = index.dim, index.cid, index.cvec, max(beam, k)
    queries = materialize(split_valid(queries.select(qid, qvec), qvec, dim)[0].dropDuplicates([qid]),
                          "knn-queries")
    pieces = max(1, math.ceil(queries.count() / query_rows))
    piece = F.sequence(F.lit(0), F.lit(pieces - 1))
    left = queries.withColumn("piece", F.pmod(F.xxhash64(qid), F.lit(pieces)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(index.parts - 1))))
    right = index.rows.select(F.col(cid).alias("_cid"), F.col(cvec).alias("_cvec"), "part", "node",
                              "neighbours", "entry", F.explode(piece).alias("piece"))
    q_type, c_type = to_arrow_type(queries.schema[qid].dataType), to_arrow_type(index.rows.schema[cid].dataType)
    out = T.StructType([queries.schema[qid], index.rows.schema[cid], T.StructField("dist2", T.DoubleType())])

    def found(asks: pa.Table, rows: pa.Table) -> pa.Table:
        names = [qid, cid, "dist2"]
        if not asks.num_rows or not rows.num_rows:
            return pa.table([pa.array([], q_type), pa.array([], c_type), pa.array([], pa.float64())], names=names)
        rows = rows.take(pa.array(np.argsort(rows["node"].to_numpy())))
        X, ids = _list_matrix(rows["_cvec"], dim), rows["_cid"].combine_chunks()
        order = _id_order(ids.to_numpy(zero_copy_only=False))
        edges = rows["neighbours"].combine_chunks()
        starts = np.r_[0, np.cumsum(edges.value_lengths().to_numpy())]
        ends = edges.flatten().to_numpy()
        Q = _list_matrix(asks[qvec], dim)
        entry = int(np.flatnonzero(rows["entry"].to_numpy(zero_copy_only=False))[0])
        walks, hits = _Walks(X, starts, ends, entry), []
        alike = np.lexsort(_nearest_cells(Q, X[::-(-len(X) // 64)], 2).T[::-1])      # walk together
        for lo in range(0, len(Q), _WALKERS):
            own = alike[lo:lo + _WALKERS]
            q, x = walks.of(Q[own], width, k)
            q = own[q]
            d2 = _seq_sq_l2(Q[q], X[x])
            keep = _first_k(q, np.lexsort((order[x], d2, q)), k)
            hits.append((q[keep], x[keep], d2[keep]))
        q, x, d2 = (np.concatenate(h) for h in zip(*hits, strict=True))
        return pa.table([asks[qid].combine_chunks().take(pa.array(q)).cast(q_type),
                         ids.take(pa.array(x)).cast(c_type), pa.array(d2)], names=names)

    block = ["part", "piece"]
    near = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(found, out)
    return _final_topk(near, k, qid, cid)
