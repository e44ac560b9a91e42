"""Quality classifier: random indexing, pooling, a two-layer network.

1. Random indexing over all documents. A word belongs to one of ``BUCKETS``
   hash buckets, each bucket has a fixed sparse ternary index vector, and its
   word vector is the sum of the index vectors of its neighbours (two words to
   either side) in the whole corpus. Every task adds up its part; Spark sums
   the parts by bucket, so a row per bucket and task is shuffled, and a table of
   fixed size (BUCKETS x DIM) comes back and is broadcast.
2. Pooling. A document is the mean and the spread of its word vectors, the mean
   likeness of each to the next, and the logarithm of its length. Written once to
   the shared folder.
3. A two-layer numpy network learns the label on the driver, from all labelled
   documents or, if they are more, a share of about ``max_rows`` drawn by the hash
   of the id (held-out documents never); a fifth of them is kept back for the
   temperature that calibrates its scores.
4. All documents are scored from the pooled table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.llm.common import id_text, stage, text_blocks

BUCKETS = 8192
DIM = 64
NONZERO = 4
REACH = 2
FEATURES = 2 * DIM + 2
HIDDEN = 32

#: Characters of texts, and buckets of words, that a task holds at once.
BLOCK_CHARS, WORDS = 1_000_000, 100_000


class _Buckets(dict):
    """Bucket of each word seen; emptied by the caller when it grows large."""

    def __missing__(self, word: bytes) -> int:
        self[word] = b = zlib.crc32(word) % BUCKETS
        return b


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every bucket's index vector."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def bucket_words(texts: list[str], buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word of a block, and the number of words of each text."""
    if len(buckets) > WORDS:
        buckets.clear()
    rows = []
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").split()
        rows.append(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)))
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.array([len(r) for r in rows])


def context_sums(df: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Word vectors, BUCKETS x DIM, of unit length (zero for unseen buckets)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIM)
        buckets = _Buckets()
        for _, texts in text_blocks(batches, BLOCK_CHARS):
            b, n = bucket_words(texts, buckets)
            doc = np.repeat(np.arange(len(n)), n)
            for o in range(1, REACH + 1):
                same = doc[o:] == doc[:-o] if len(b) > o else np.zeros(0, bool)
                left, right = b[:-o][same], b[o:][same]
                for near, far in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(near * DIM + places[far, k], signs[far, k],
                                             BUCKETS * DIM)
        rows = total.reshape(BUCKETS, DIM)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), *(pa.array(rows[used, k]) for k in range(DIM))],
            ["bucket", *(f"v{k}" for k in range(DIM))])

    parts = id_text(df, id_col, text_col).mapInArrow(
        run, "bucket long, " + ", ".join(f"v{k} double" for k in range(DIM)))
    sums = parts.groupBy("bucket").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM)])
    out = np.zeros((BUCKETS, DIM))
    got = sums.toPandas().to_numpy()                      # at most BUCKETS rows
    if len(got):
        out[got[:, 0].astype(int)] = got[:, 1:]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).astype(np.float32)


def pool(df: DataFrame, vectors: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc_id, features binary (FEATURES little-endian 32-bit floats)."""
    shared = df.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, buckets = shared.value, _Buckets()
        for ids, texts in text_blocks(batches, BLOCK_CHARS):
            b, n = bucket_words(texts, buckets)
            out = np.zeros((len(n), FEATURES), np.float32)
            full = np.flatnonzero(n)
            if len(full):
                starts = (np.cumsum(n) - n)[full]
                rows = w[b]
                m = n[full, None].astype(np.float32)
                mean = np.add.reduceat(rows, starts, axis=0) / m
                alike = np.zeros(len(b), np.float32)
                alike[:-1] = np.einsum("ij,ij->i", rows[:-1], rows[1:])
                alike[starts + n[full] - 1] = 0           # the next word is another text's
                out[full, -2] = np.add.reduceat(alike, starts) / m[:, 0]
                np.multiply(rows, rows, out=rows)
                spread = np.add.reduceat(rows, starts, axis=0) / m - mean * mean
                out[full, :DIM] = mean
                out[full, DIM:2 * DIM] = np.sqrt(np.maximum(spread, 0))
                out[full, -1] = np.log1p(n[full]) / 10
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([r.tobytes() for r in out], pa.binary())],
                ["doc_id", "features"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, features binary")


@dataclass
class Network:
    """score = sigmoid((relu((x - mean) / scale @ w1 + b1) @ w2 + b2) / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4,
        seed: int = 11) -> Network:
    """Adam on mini-batches of four fifths; the rest sets the temperature.

    Without rows, or with one label only, the score is the share of label 1
    (0.5 without rows)."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    if len(y) < 10 or len(np.unique(y)) < 2:
        p = np.clip(np.mean(y), 0.01, 0.99) if len(y) else 0.5
        return Network(np.zeros(dim), np.ones(dim), np.zeros((dim, HIDDEN)), np.zeros(HIDDEN),
                       np.zeros(HIDDEN), float(np.log(p / (1 - p))))
    order = rng.permutation(len(y))
    hold, train = order[:len(y) // 5], order[len(y) // 5:]
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-4
    p = [rng.normal(0, (2 / dim) ** 0.5, (dim, HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z = (x - mean) / scale
    step = 0
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), 128):
            pick = train[at:at + 128]
            h = np.maximum(z[pick] @ p[0] + p[1], 0)
            d = (sigmoid(h @ p[2] + p[3][0]) - y[pick]) / len(pick)
            dh = np.outer(d, p[2]) * (h > 0)
            grads = [z[pick].T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2],
                     np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(s[i] / (1 - 0.999 ** step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    grid = np.geomspace(0.25, 8, 61)
    out = net.logits(x[hold])
    net.temperature = float(grid[int(np.argmin([log_loss(out / t, y[hold]) for t in grid]))])
    return net


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``, is 0 (a null id counts as held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", threshold: float = 0.3,
             max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out boolean, score double, predicted int for every row.

    Null and empty texts have the features of no words and a score like any
    other. Repeated rows come out repeated; several labels of one document count
    as the smallest; rows without a label are scored only; without labels every
    score is 0.5. Columns besides the two named are not read."""
    vectors = context_sums(df, id_col, text_col)
    pooled = stage(pool(df, vectors, id_col, text_col), "quality-features")
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"),
                           F.col(label_col).cast("int").alias("label"))
             .filter("label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
             .filter(~held_out()))
    share = min(1.0, max_rows / max(1, known.count()))    # about max_rows rows come back
    rows = (known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
            .join(pooled, "doc_id").select("doc_id", "label", "features").collect())
    rows.sort(key=lambda r: (r.doc_id, r.label, bytes(r.features)))
    x = np.frombuffer(b"".join(bytes(r.features) for r in rows), "<f4").reshape(-1, FEATURES)
    net = fit(x.astype(np.float64), np.array([r.label for r in rows], np.float64))
    shared = df.sparkSession.sparkContext.broadcast(vars(net))   # plain arrays and numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(**shared.value)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(-1, FEATURES)
            score = np.clip(net.score(x.astype(np.float64)), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())],
                                             ["doc_id", "score"])

    scored = pooled.select("doc_id", "features").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
