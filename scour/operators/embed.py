"""Embedders.

An embedder is a function ``embed(df, text_col) -> df`` that adds two columns
per row, ``embedding array<float>`` and ``error string`` (exactly one is NULL).
It is a map-only step: no shuffle, no join back, copies of a text simply get
the same vector.

* ``hash_embedder`` - the built-in offline default: signed feature hashing
  (Weinberger et al., ICML 2009) in an Arrow-batched pandas UDF. Measured
  against the Catalyst form below it is bit-identical on every document and
  faster, and it moves no data: the relational form must shuffle up to
  ``dim + 2`` partial rows per document keyed by the 64-character content id,
  about twice the input text at scale.
* ``udf_embedder`` - any user model (e.g. a remote service) as an iterator
  pandas UDF: the client is built once per partition; errors of the given
  retryable classes become the row's ``error``, other errors fail the task.
* ``hash_embed`` - the same hash rule written with Catalyst expressions
  (explode, partial aggregate per (key, cell), one row per key). Kept for
  sessions without Python workers and as a cross-check in the tests.

Hash rule, fixed values shared with the SQL oracle:
  * tokens: lower-case, split on runs of space / newline / tab / carriage
    return, empty tokens dropped;
  * code: the first 7 hex digits of md5(token) as an integer; cell = first 6
    hex digits modulo the width; sign +1 when the 7th digit is even, else -1;
  * signs are summed per cell and the vector is divided by its L2 norm;
  * a text with no tokens, a zero norm, or longer than ``max_chars`` fails.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain
from typing import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.operators.service import ONE_BY_ONE, ServiceCalls

from scour.functions.vectors import unit_length
from scour.operators.index import check_vectors
from pyspark.sql import types as T

# Fixed values of the hash embedder rule.
TOKEN_SPLIT = "[ \n\t\r]+"
HASH_HEX_DIGITS = 7
DEFAULT_DIM = 64

ERR_EMPTY = "empty input"
ERR_ZERO = "zero vector"
ERR_TOO_LONG = "input too long"


# Marker elements: a space can never be a token (tokens are split on spaces).
_ROW_MARK = " "
_LONG_MARK = "  "
_ROW_CELL, _LONG_CELL = -1, -2


def hash_embed(df: DataFrame, key: str, text: str, dim: int = DEFAULT_DIM,
               max_chars: int | None = None) -> DataFrame:
    """Embed ``text`` per ``key`` with the hash rule, in one pass (JVM side).

    Each input row contributes one marker element besides its tokens, so the
    per-(key, cell) partial aggregate also counts the copies of a key and its
    too-long copies. Copies of one text add identical integer sums, so the
    sums are divided by the copy count exactly: duplicates need no text
    shuffle, sort or join, and give the same vector as one copy.
    """
    t = F.col(text)
    too_long = (F.length(t) > F.lit(max_chars)) if max_chars else F.lit(False)
    body = F.when(~too_long, F.split(F.lower(t), TOKEN_SPLIT))
    elems = F.concat(F.array(F.when(too_long, F.lit(_LONG_MARK)).otherwise(F.lit(_ROW_MARK))),
                     F.coalesce(body, F.array().cast("array<string>")))
    toks = df.select(key, F.explode(elems).alias("tok")).filter(F.col("tok") != "")
    code = F.conv(F.substring(F.md5(F.col("tok")), 1, HASH_HEX_DIGITS), 16, 10).cast("long")
    cell = (F.when(F.col("tok") == _ROW_MARK, F.lit(_ROW_CELL))
            .when(F.col("tok") == _LONG_MARK, F.lit(_LONG_CELL))
            .otherwise((F.shiftright(code, 4) % dim).cast("int")))
    sgn = F.when(F.col("tok").isin(_ROW_MARK, _LONG_MARK) | (code % 2 == 0), F.lit(1)).otherwise(F.lit(-1))
    per_cell = (toks.select(key, cell.alias("cell"), sgn.alias("sgn"))
                .groupBy(key, "cell").agg(F.sum("sgn").alias("w")))
    is_vec = F.col("cell") >= 0
    per_key = per_cell.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.when(is_vec, F.struct("cell", "w")))).alias("m"),
        F.sum(F.when(is_vec, F.col("w").cast("decimal(38,0)") * F.col("w"))).alias("ssq"),
        F.count(F.when(is_vec, 1)).alias("ncells"),
        F.max(F.when(F.col("cell") == _ROW_CELL, F.col("w"))).alias("copies"),
        F.max(F.when(F.col("cell") == _LONG_CELL, F.col("w"))).alias("long_copies"))
    copies = F.col("copies").cast("long")
    norm = F.sqrt((F.col("ssq") / (copies * copies)).cast("double"))
    # per-copy cell sum (an exact integer) over the norm
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda j: ((F.coalesce(F.element_at(F.col("m"), j), F.lit(0)) / copies)
                                 .cast("long").cast("double") / norm).cast("float"))
    err = (F.when(F.col("long_copies").isNotNull(), F.lit(ERR_TOO_LONG))
           .when(F.col("ncells") == 0, F.lit(ERR_EMPTY))
           .when(F.col("ssq") == 0, F.lit(ERR_ZERO)))
    return per_key.select(key, F.when(err.isNull(), vec).cast(T.ArrayType(T.FloatType())).alias("embedding"),
                          err.alias("error"))


_SPLIT = re.compile(TOKEN_SPLIT)


def hash_vector(text: str | None, dim: int = DEFAULT_DIM, max_chars: int | None = None):
    """(float32 unit vector, None) or (None, error) for one text."""
    if text is None:
        return None, ERR_EMPTY
    if max_chars and len(text) > max_chars:
        return None, ERR_TOO_LONG
    toks = [t for t in _SPLIT.split(text.lower()) if t]
    if not toks:
        return None, ERR_EMPTY
    heads = np.fromiter((int.from_bytes(hashlib.md5(t.encode("utf-8")).digest()[:4], "big")
                         for t in toks), dtype=np.int64, count=len(toks))
    code = heads >> 4                                   # first 7 hex digits
    w = np.bincount((code >> 4) % dim, weights=np.where(code % 2 == 0, 1.0, -1.0),
                    minlength=dim)
    norm = float(np.sqrt((w * w).sum()))
    if norm == 0:
        return None, ERR_ZERO
    return (w / norm).astype(np.float32), None


# Texts are tokenised a chunk at a time so the token list of one Arrow batch
# stays bounded in memory (a batch may hold thousands of long documents).
_CHUNK_CHARS = 1 << 20


def _hash_chunk(texts, dim, max_chars, vecs, errs, base):
    toks = []
    for i, t in enumerate(texts):
        tk = []
        if not isinstance(t, str):
            errs[base + i] = ERR_EMPTY
        elif max_chars and len(t) > max_chars:
            errs[base + i] = ERR_TOO_LONG
        else:
            tk = [x for x in _SPLIT.split(t.lower()) if x]
            if not tk:
                errs[base + i] = ERR_EMPTY
        toks.append(tk)
    n = len(texts)
    lens = np.fromiter(map(len, toks), dtype=np.int64, count=n)
    flat = list(chain.from_iterable(toks))
    if flat:
        # md5 once per distinct token of the chunk; one bincount for all rows
        idx, uniq = pd.factorize(pd.Series(flat, dtype=object), sort=False)
        ucode = np.fromiter((int.from_bytes(hashlib.md5(u.encode("utf-8")).digest()[:4], "big") >> 4
                             for u in uniq), dtype=np.int64, count=len(uniq))
        code = ucode[idx]
        doc = np.repeat(np.arange(n), lens)
        w = np.bincount(doc * dim + (code >> 4) % dim, weights=np.where(code % 2 == 0, 1.0, -1.0),
                        minlength=n * dim).reshape(n, dim)
    else:
        w = np.zeros((n, dim))
    norm = np.sqrt((w * w).sum(axis=1))
    for i in range(n):
        if errs[base + i] is None:
            if norm[i] == 0:
                errs[base + i] = ERR_ZERO
            else:
                vecs[base + i] = (w[i] / norm[i]).astype(np.float32)


def hash_vectors(texts, dim: int = DEFAULT_DIM, max_chars: int | None = None):
    """``hash_vector`` over many texts at once (lists of vectors and errors);
    the same result for every text, with md5 taken once per distinct token
    of a chunk and the cell sums of all rows done by one ``bincount``."""
    texts = list(texts)
    n = len(texts)
    vecs, errs = [None] * n, [None] * n
    start = 0
    while start < n:
        end, size = start, 0
        while end < n and (end == start or size < _CHUNK_CHARS):
            t = texts[end]
            size += len(t) if isinstance(t, str) else 0
            end += 1
        _hash_chunk(texts[start:end], dim, max_chars, vecs, errs, start)
        start = end
    return vecs, errs


def hash_embed_text(text: str, dim: int = DEFAULT_DIM) -> list[float] | None:
    """Hash vector of one text as a list (None when it fails)."""
    v, _ = hash_vector(text, dim)
    return None if v is None else [float(x) for x in v]


_EMBED_STRUCT = "struct<embedding:array<float>, error:string>"


def _hash_udf(dim: int, max_chars: int | None):
    @F.pandas_udf(_EMBED_STRUCT)
    def embed(texts: pd.Series) -> pd.DataFrame:
        vecs, errs = hash_vectors(texts, dim, max_chars)
        return pd.DataFrame({"embedding": vecs, "error": errs})
    # Marked non-deterministic so that Catalyst evaluates it exactly once, where
    # it is written: a filter on its output is not pushed below an exchange and
    # the call is not copied into each field that reads the struct.
    return embed.asNondeterministic()


def with_embedding(df: DataFrame, text: str, column) -> DataFrame:
    """Add ``embedding`` and ``error`` from an embedding struct column."""
    return (df.withColumn("_emb", column(F.col(text)))
            .withColumn("embedding", F.col("_emb.embedding"))
            .withColumn("error", F.col("_emb.error")).drop("_emb"))


def hash_embedder(dim: int = DEFAULT_DIM, max_chars: int | None = None):
    """The default embedder: ``embed(df, text_col)`` adds embedding / error."""
    udf = _hash_udf(dim, max_chars)

    def embed(df: DataFrame, text: str) -> DataFrame:
        return with_embedding(df, text, udf)
    return embed


def udf_embedder(factory: Callable[[], Callable[[str], Iterable[float]]], dim: int,
                 retryable: tuple[type[BaseException], ...] = (Exception,),
                 calls: ServiceCalls = ONE_BY_ONE):
    """A user model as an embedder; ``factory()`` builds the client once per
    partition and returns ``fn(text) -> vector`` (with ``calls.batch`` above 1,
    ``fn(texts) -> vectors``). ``calls`` says how many requests are on their way at
    once and how they are repeated; rows keep their order. The UDF is marked
    non-deterministic so the optimizer never repeats or moves the calls."""
    def vector(result) -> tuple[np.ndarray | None, str | None]:
        try:
            v = np.asarray([float(x) for x in result], dtype=np.float32)
        except retryable as e:
            return None, f"{type(e).__name__}: {e}"
        return (v, None) if len(v) == dim else (None, f"bad width {len(v)} != {dim}")

    @F.pandas_udf(_EMBED_STRUCT)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = factory()
        for texts in batches:
            out = [vector(x) if e is None else (None, f"{type(e).__name__}: {e}")
                   for x, e in calls.map(fn, texts, retryable)]
            yield pd.DataFrame({"embedding": [v for v, _ in out], "error": [e for _, e in out]})

    call = call.asNondeterministic()

    def embed(df: DataFrame, text: str) -> DataFrame:
        return with_embedding(df, text, call)
    return embed


def checked(embed, dim: int):
    """An embedder whose bad vectors (missing, of another width than ``dim``, with
    NULL or NaN cells) are errors and whose good ones have unit length."""
    def run(df: DataFrame, text: str) -> DataFrame:
        out = check_vectors(embed(df, text), "embedding", dim)
        good = F.col("error").isNull() & F.col("valid")
        return (out.withColumn("error", F.coalesce("error", "reason"))
                .withColumn("embedding", F.when(good, unit_length("embedding")))
                .drop("valid", "reason"))
    return run
