"""Nearest-neighbour search with both sides distributed.

The corpus is written by cells of a residual code: the nearest of some coarse
centroids, and the nearest of some fine ones to what is left of the vector. Every
cell is a ball around its code's centre; centres, radii and counts are a bounded
table (coarse x fine rows) that rides along with the tasks. Queries are rows like
any others and never visit the driver:

* ``knn_blocks`` is exact. Every query goes to its nearest cells until they hold
  k vectors; its k-th distance there bounds what other cells must beat, and the query
  goes to those whose ball comes nearer.
* ``nprobe`` stops after that many nearest cells of every query (multi-probe), which
  may miss neighbours; ``recall`` measures how many.

Queries and corpus meet in blocks of (cell, piece of its vectors, piece of its
queries) of bounded size, so a cell that holds a third of the corpus, or is sought
by a third of the queries, is many blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.operators.knn import (_BATCH_ROWS, _EPS, _Best, _cell_dists, _final_topk, _id_order, _list_matrix,
                                 _nearest_cells, drawn_vectors, lloyd, split_valid)
from scour.session import materialize

#: Rows of a block: vectors of a cell's piece, and queries of a cell's piece.
PIECE_ROWS = 50_000
QUERY_ROWS = 10_000
_META_BYTES = 64 << 20          # most bytes of centres that travel with the tasks


@dataclass
class CellIndex:
    """The usable vectors with their cell and piece, and the table of cells."""
    rows: DataFrame             # id, vector, cell, piece
    centres: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    cid: str
    cvec: str
    piece_rows: int

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    @property
    def pieces(self) -> np.ndarray:
        return np.maximum(1, -(-self.counts // self.piece_rows))


def build_cells(corpus: DataFrame, *, cid: str = "doc_id", cvec: str = "embedding", dim: int,
                coarse: int = 32, fine: int = 16, train_rows: int = 20_000,
                piece_rows: int = PIECE_ROWS) -> CellIndex:
    """Train both codebooks on about ``train_rows`` vectors, code every usable row of
    ``corpus`` and write it in cell order."""
    if coarse * fine * dim * 8 > _META_BYTES:
        raise ValueError("too many cells for centres that travel with the tasks")
    good, _ = split_valid(corpus.select(cid, cvec), cvec, dim)
    X = drawn_vectors(good, cid, cvec, dim, train_rows)
    first = lloyd(X, coarse)
    rest = X - first[_nearest_cells(X, first)[:, 0]] if len(X) else X
    second = lloyd(rest, fine)
    centres = (first[:, None, :] + second[None, :, :]).reshape(-1, dim)

    def assign(batches):
        for rb in batches:
            x = _list_matrix(rb.column(1), dim)
            near = _nearest_cells(x, first)[:, 0]
            cell = near * len(second) + _nearest_cells(x - first[near], second)[:, 0]
            away = np.sqrt(((x - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*rb.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=[cid, cvec, "cell", "away"])

    schema = T.StructType([good.schema[cid], good.schema[cvec], T.StructField("cell", T.IntegerType()),
                           T.StructField("away", T.DoubleType())])
    rows = materialize(good.mapInArrow(assign, schema).repartitionByRange("cell", cid)
                       .sortWithinPartitions("cell", cid), "knn-cells")
    radii, counts = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in rows.groupBy("cell").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n")).collect():
        radii[r["cell"]], counts[r["cell"]] = r["r"], r["n"]          # a row per cell, bounded
    index = CellIndex(rows, centres, radii, counts, cid, cvec, piece_rows)
    if int(index.pieces.max()) > 1:
        many = F.array(*[F.lit(int(p)) for p in index.pieces])
        piece = F.pmod(F.xxhash64(cid), F.get(many, F.col("cell"))).cast("int")
    else:
        piece = F.lit(0)
    index.rows = rows.drop("away").withColumn("piece", piece)
    return index


def _targets(index: CellIndex, k: int, nprobe: int | None, bounded: bool):
    """For queries (and, if ``bounded``, their k-th distance so far): (query, cell)."""
    centres, radii, counts = index.centres, index.radii, index.counts
    alive = np.flatnonzero(counts)

    def nearest_first(Q):
        d2 = np.maximum(_cell_dists(Q, centres[alive]), 0.0)
        order = np.argsort(d2, axis=1, kind="stable")
        if nprobe:
            visited = np.arange(len(alive))[None, :] < nprobe
            return d2, order, np.broadcast_to(visited, order.shape)
        held = np.cumsum(counts[alive][order], axis=1)
        return d2, order, np.c_[np.zeros(len(Q), np.int64), held[:, :-1]] < k

    def of(Q, to_beat):
        if not len(alive):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        d2, order, visited = nearest_first(Q)
        if not bounded:
            q, at = np.nonzero(visited)
            return q, alive[order[q, at]]
        seen = np.zeros(d2.shape, bool)
        np.put_along_axis(seen, order, visited, axis=1)
        low = np.maximum(np.sqrt(d2) - radii[alive] - _EPS, 0.0) ** 2
        q, at = np.nonzero(~seen & (low <= (to_beat + _EPS)[:, None]))
        return q, alive[at]

    return of


def _sent(queries: DataFrame, index: CellIndex, k: int, nprobe: int | None, qid: str, qvec: str,
          bounded: bool) -> DataFrame:
    """The queries, a row for every cell they go to, with the distance to beat there."""
    of, dim = _targets(index, k, nprobe, bounded), index.dim

    def send(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                rb = whole.slice(lo, 512)
                Q = _list_matrix(rb.column(1), dim)
                beat = rb.column(2).to_numpy(zero_copy_only=False) if bounded else np.zeros(len(Q))
                q, cell = of(Q, beat)
                at = pa.array(q)
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).take(at), rb.column(1).take(at), pa.array(cell.astype(np.int32)),
                     pa.array(beat[q] if bounded else np.full(len(q), np.inf))],
                    names=[qid, qvec, "cell", "to_beat"])

    schema = T.StructType([queries.schema[qid], queries.schema[qvec], T.StructField("cell", T.IntegerType()),
                           T.StructField("to_beat", T.DoubleType())])
    columns = [qid, qvec, "to_beat"] if bounded else [qid, qvec]
    return queries.select(*columns).mapInArrow(send, schema)


def _met(sent: DataFrame, index: CellIndex, k: int, qid: str, qvec: str, query_rows: int) -> DataFrame:
    """The k best of every block for its queries, as far as they come up to the distance to
    beat: query id, corpus id, dist2."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, dim, cid, cvec = sent.sparkSession, index.dim, index.cid, index.cvec
    sent = materialize(sent, "knn-sent")
    asked = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    out_schema = T.StructType([sent.schema[qid], index.rows.schema[cid], T.StructField("dist2", T.DoubleType())])
    if not asked:
        return spark.createDataFrame([], out_schema)
    cells = F.broadcast(spark.createDataFrame(              # a row per cell, bounded
        [(int(c), int(index.pieces[c]), -(-n // query_rows)) for c, n in asked.items()],
        "cell int, pieces int, parts int"))
    left = sent.join(cells, "cell").select(
        qid, qvec, "to_beat", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
        F.pmod(F.xxhash64(qid), F.col("parts")).cast("int").alias("part"))
    right = index.rows.join(cells, "cell").select(
        F.col(cid).alias("_cid"), F.col(cvec).alias("_cvec"), "cell", "piece",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    q_type, c_type = to_arrow_type(sent.schema[qid].dataType), to_arrow_type(index.rows.schema[cid].dataType)

    def best(asks: pa.Table, rows: pa.Table) -> pa.Table:
        ids = pa.array([], c_type)
        found = _Best(np.zeros((0, dim)), k)
        if asks.num_rows and rows.num_rows:
            ids = rows["_cid"].combine_chunks()
            place = pa.array(np.argsort(_id_order(ids.to_numpy(zero_copy_only=False)), kind="stable"))
            ids, vectors = ids.take(place), rows["_cvec"].combine_chunks().take(place)
            found = _Best(_list_matrix(asks[qvec], dim), k, asks["to_beat"].to_numpy())
            order = np.arange(len(ids))                  # ids by their place in id order
            for lo in range(0, len(ids), _BATCH_ROWS):
                found.scan(_list_matrix(vectors.slice(lo, _BATCH_ROWS), dim), order[lo:lo + _BATCH_ROWS])
            found.merge()
        q, x = found.q, found.ids if len(found.q) else np.zeros(0, np.int64)
        return pa.table([asks[qid].combine_chunks().take(pa.array(q)).cast(q_type) if len(q) else pa.array([], q_type),
                         ids.take(pa.array(x)).cast(c_type), pa.array(found.d, pa.float64())],
                        names=[qid, cid, "dist2"])

    block = ["cell", "piece", "part"]
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(best, out_schema)


def knn_blocks(queries: DataFrame, index: CellIndex, k: int = 5, *, qid: str = "query_id", qvec: str = "qv",
               nprobe: int | None = None, query_rows: int = QUERY_ROWS) -> DataFrame:
    """k nearest indexed vectors for every query: (query id, rank, id, dist2, score), ties
    on distance broken by id; exact without ``nprobe``.

    Queries without a usable vector of the index's width are left out (``split_valid``
    names them); rows of one query id count as one query, which has to have one
    vector. An empty side gives no rows. The driver holds the table of cells only."""
    queries = materialize(split_valid(queries.select(qid, qvec), qvec, index.dim)[0]
                          .dropDuplicates([qid]), "knn-queries")
    near = materialize(_met(_sent(queries, index, k, nprobe, qid, qvec, False), index, k, qid, qvec, query_rows),
                       "knn-near")
    top = _final_topk(near, k, qid, index.cid)
    if nprobe:
        return top
    top = materialize(top, "knn-bounds")
    reached = top.filter(F.col("rank") == k).select(F.col(qid).alias("_q"), F.col("dist2").alias("to_beat"))
    bounded = queries.join(reached, queries[qid] == reached["_q"], "left").select(
        qid, qvec, F.coalesce("to_beat", F.lit(float("inf"))).alias("to_beat"))
    far = _met(_sent(bounded, index, k, None, qid, qvec, True), index, k, qid, qvec, query_rows)
    return _final_topk(top.select(qid, index.cid, "dist2").unionByName(far), k, qid, index.cid)


def recall(found: DataFrame, exact: DataFrame, qid: str = "query_id", cid: str = "doc_id") -> DataFrame:
    """query id, recall: the share of a query's exact hits that were found."""
    hit = exact.select(qid, cid).join(found.select(qid, cid, F.lit(1).alias("_hit")), [qid, cid], "left")
    return hit.groupBy(qid).agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))
