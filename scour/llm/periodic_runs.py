"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q (words q apart are identical) and
length >= max(``least``, 4 * q) that no neighbouring word extends keeping period q.

* Suffix array. The words of a block of documents are sorted by prefix doubling, each
  document on its own part of the array. The ranks of level k name the strings of
  2^k words, and are kept, as they answer longest common extensions.
* Queries. Level k looks for periods in (2^(k-1), 2^k]. Every dyadic block, 2^k words
  from a multiple of 2^k, has its occurrences in one interval of the suffix array;
  a wavelet tree over the array gives the next one behind and the last one before the
  block (range successor and predecessor). Occurrences in a window of twice the
  block are an arithmetic progression, so if one is at most 2^k words away, its
  distance is the difference of the progression: a candidate period.
* Completeness. A run of period q and 4 * q words or more holds a block of
  its level, as 2^k < 2 * q, with the occurrence q words behind it or q words before
  it; none in the run is nearer, since a string of a whole period occurs at multiples
  of the smallest period only.
* Candidates are extended both ways by longest common extensions and kept where the
  stretch is long enough; one stretch found by several periods has the smallest.

All documents of a block are handled at once in numpy; documents are independent, so
Spark needs no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.llm.common import id_text, text_blocks

BLOCK_CHARS = 1_500_000
EXPONENT = 4                    # least number of periods in a run; the method needs 4


class Suffixes:
    """Suffix array of documents laid side by side, with the ranks of every level.

    ``ranks[k][i]`` is the first place in the array of the suffixes that begin with the
    2^k words at i, ``sizes[k]`` their number at that place; suffixes of different
    documents never share a rank."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, end: np.ndarray, most: int):
        n = len(words)
        key = (doc.astype(np.int64) << 32) | words
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        rank, size = np.empty(n, np.int32), np.zeros(n, np.int32)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.diff(np.r_[start, n])
        rank[self.order] = np.repeat(start, many)
        size[start] = many
        self.ranks, self.sizes = [rank], [size]
        half = 1
        while 2 * half <= most:
            rank, size = self.ranks[-1], self.sizes[-1]
            slots = np.flatnonzero(size[rank[self.order]] > 1)
            if not len(slots):
                break
            at = self.order[slots]
            behind = at + half
            second = np.where(behind < end[at], rank[np.minimum(behind, n - 1)].astype(np.int64) + 1, 0)
            joint = rank[at].astype(np.int64) * (n + 1) + second
            turn = np.argsort(joint, kind="stable")
            at, joint = at[turn], joint[turn]
            self.order[slots] = at
            lead = np.flatnonzero(np.r_[True, joint[1:] != joint[:-1]])
            many = np.diff(np.r_[lead, len(slots)])
            rank, size = rank.copy(), size.copy()
            rank[at] = np.repeat(slots[lead], many)
            size[slots] = 0
            size[slots[lead]] = many
            self.ranks.append(rank)
            self.sizes.append(size)
            half *= 2

    def forward(self, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of the words from i and from j > i."""
        i, j = i.copy(), j.copy()
        first, n = j.copy(), len(self.order)
        for k in reversed(range(len(self.ranks))):
            rank, go = self.ranks[k], np.arange(len(i))
            while len(go):
                x, y = i[go], j[go]
                go = go[(y < end[go]) & (rank[x] == rank[np.minimum(y, n - 1)])]
                i[go] += 1 << k
                j[go] += 1 << k
                if k < len(self.ranks) - 1:
                    break
        return j - first

    def backward(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of the words before i and before j."""
        i, j = i.copy(), j.copy()
        first = i.copy()
        for k in reversed(range(len(self.ranks))):
            rank, go = self.ranks[k], np.arange(len(i))
            while len(go):
                x, y = i[go] - (1 << k), j[go] - (1 << k)
                go = go[(x >= begin[go]) & (rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)])]
                i[go] -= 1 << k
                j[go] -= 1 << k
                if k < len(self.ranks) - 1:
                    break
        return first - i


class Wavelet:
    """Wavelet tree, stored level by level, over an array of numbers below 2^bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for b in reversed(range(bits)):
            one = (values >> b & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((b, zeros))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the numbers at lo .. hi - 1 are smaller than x."""
        count = np.zeros(len(x), np.int64)
        for b, zeros in self.levels:
            a, z = zeros[lo], zeros[hi]
            one = (x >> b & 1).astype(bool)
            count += np.where(one, z - a, 0)
            lo = np.where(one, zeros[-1] + lo - a, a)
            hi = np.where(one, zeros[-1] + hi - z, z)
        return count

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the numbers at lo .. hi - 1."""
        value = np.zeros(len(k), np.int64)
        for b, zeros in self.levels:
            a, z = zeros[lo], zeros[hi]
            one = k >= z - a
            k = np.where(one, k - (z - a), k)
            value |= one.astype(np.int64) << b
            lo = np.where(one, zeros[-1] + lo - a, a)
            hi = np.where(one, zeros[-1] + hi - z, z)
        return value


def least_count(k: int, least: int) -> int:
    """How often a run holds its block of level k at least."""
    q = 1 if k == 0 else (1 << (k - 1)) + 1                # the smallest period of the level
    return min((max(least, EXPONENT * p) - (1 << k)) // p for p in (q, 1 << k))


def candidates(array: Suffixes, begin: np.ndarray, sizes: np.ndarray, least: int,
               ) -> tuple[np.ndarray, np.ndarray]:
    """(i, d): places i with the 2^k words there and d words behind equal, d in the
    range of level k. ``begin`` and ``sizes`` are those of the documents."""
    tree = Wavelet(array.order - np.repeat(begin, sizes), max(1, int(sizes.max() - 1).bit_length()))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k, (rank, size) in enumerate(zip(array.ranks, array.sizes, strict=True)):
        width = 1 << k
        many = np.where(sizes >= 2 * width, sizes // width, 0)
        first = np.repeat(begin, many)
        local = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * width
        lo = rank[first + local].astype(np.int64)
        several = size[lo] >= max(2, least_count(k, least))
        first, local, lo = first[several], local[several], lo[several]
        hi = lo + size[lo]
        place = tree.below(lo, hi, local)
        for step in (1, -1):                              # range successor, range predecessor
            there = (place + step >= 0) & (place + step < hi - lo)
            other = tree.smallest(lo[there], hi[there], place[there] + step)
            d = np.abs(other - local[there])
            near = (d <= width) & (2 * d > width)
            found.append(((first[there] + np.minimum(other, local[there]))[near], d[near]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs_of(texts: list[list], least: int = 6) -> list[np.ndarray]:
    """For each word sequence its runs: rows of start, length, period, in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    none = [np.zeros((0, 3), np.int64)] * len(texts)
    if not sizes.sum():
        return none
    known: dict = {}
    words = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, sizes.sum())
    begin = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    end = np.repeat(begin + sizes, sizes)
    array = Suffixes(words, doc, end, max(1, int(sizes.max()) // 2))
    i, d = candidates(array, begin, sizes, least)
    if not len(i):
        return none
    kept = np.unique(np.stack([i, d], 1), axis=0)
    i, d = kept[:, 0], kept[:, 1]
    start = i - array.backward(i, i + d, begin[doc[i]])
    stop = i + d + array.forward(i, i + d, end[i])
    enough = stop - start >= np.maximum(least, EXPONENT * d)
    start, stop, d = start[enough], stop[enough], d[enough]
    order = np.lexsort((d, stop, start))                  # one stretch: its smallest period
    start, stop, d = start[order], stop[order], d[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])] if len(start) else np.zeros(0, bool)
    start, stop, d = start[new], stop[new], d[new]
    order = np.lexsort((d, start))
    start, stop, d = start[order], stop[order], d[order]
    own = doc[start]
    rows = np.stack([start - begin[own], stop - start, d], 1)
    return np.split(rows, np.searchsorted(own, np.arange(1, len(texts))))


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def find_runs(df: DataFrame, least: int = 6, edit: Callable[[int | None, list], list] | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs: array of struct<start, length, period> by start, then period, and
    collapsed: the words outside every run's repeats, joined by one space.

    Words are parted by ASCII white space; ``edit`` (a function of id and words) may
    change them first. A null, empty or blank text has no runs and collapses to the empty
    text. Every row is judged alone, so repeated rows come out repeated, and a null
    doc_id is kept. Columns besides the two named are not read; an empty table gives no
    rows. A text is handled whole, in about 150 bytes a word and 4 more for every
    doubling of its longest repeated string."""
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches, BLOCK_CHARS):
            split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
            if edit:
                split = [edit(d, w) for d, w in zip(ids, split, strict=True)]
            found = runs_of(split, least)
            flat = np.concatenate(found)
            kept = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass")
                    for w, r in zip(split, found, strict=True)]
            offsets = np.r_[0, np.cumsum([len(r) for r in found])].astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, i], pa.int64()) for i in range(3)],
                                              fields=list(kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offsets, rows), pa.array(kept, pa.string())],
                ["doc_id", "runs", "collapsed"])

    return id_text(df, id_col, text_col).mapInArrow(
        run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id: int | None, words: list) -> list:
    """The registered query's texts: with h the CRC-32 of the id, in every tenth
    document the words from a on repeat with period p."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, exactly; then the first, the shortest period."""
    def order(x: Column, y: Column) -> Column:
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        before = (left > right) | ((left == right) & (
            (x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
        same = (left == right) & (x["start"] == y["start"]) & (x["period"] == y["period"])
        return F.when(before, -1).when(same, 0).otherwise(1)

    return F.get(F.array_sort(runs, order), F.lit(0))


def digest(df: DataFrame, edit: Callable[[int | None, list], list] | None = planted) -> DataFrame:
    """Digests of ``find_runs``: the number of runs, the strongest one, SHA-256 of all
    runs (a line ``start,length,period`` each) and of the collapsed text."""
    found = find_runs(df, edit=edit).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]),
                                                   F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
