"""Benchmark decontamination: SimHash of item-sized windows.

1. The word 5-grams and 64-bit SimHashes of the benchmark items are sent to all tasks,
   in blocks of bounded size. A document's windows of an item's length get a
   fingerprint wherever they share a 5-gram with an item of that length that the
   document shares enough 5-grams with anywhere; other windows are like no item. The
   fingerprints of all starts come from running sums of the 5-grams' bits.
2. Fingerprints meet by a multi-index: eight blocks of eight bits. Two
   fingerprints at most RADIUS apart differ by at most RADIUS // 8 bits in one
   of the blocks, so every item is filed under all values of each block within
   that distance, and a window looks up its own eight. All pairs within the
   radius are found, and no others go on; windows meet only items of their own length.
3. The weighted similarity (sum of the smaller over sum of the larger counts of
   every 5-gram) of these pairs decides, exactly. A shared 5-gram counts in a range of
   starts, and the sum of these ranges is what each window shares with the item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.llm.common import id_text, stage, text_blocks
from scour.llm.jaccard_join import _Hashes, mix

N = 5
BLOCKS, BITS = 8, 8
#: 5-grams with a similarity of 0.8 or more give fingerprints about 9.7 bits
#: apart, with a deviation of 2.9; this is 4.6 deviations beyond.
RADIUS = 23
#: 5-grams of one block of items sent to the tasks, 24 bytes each.
BLOCK_GRAMS = 1_000_000
#: Starts whose fingerprints are summed at once, and pairs of a window and an item
#: looked up at once: both bound memory only.
STRETCH, PAIRS = 16_384, 2_000_000
WORD = re.compile(r"\w+")


def words_of(text: str, hashes: dict) -> np.ndarray:
    """Hash of every word: runs of letters, digits and _, lower-cased."""
    found = WORD.findall(text.lower())
    return np.fromiter((hashes[w] for w in found), np.uint64, len(found))


def grams_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that start at each place."""
    out = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + len(out)]
        out ^= out >> np.uint64(29)
    return mix(out)


def simhash(grams: np.ndarray) -> int:
    """64-bit SimHash, as a signed long."""
    bits = np.unpackbits(mix(grams).view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(0, dtype=np.int64) * 2 >= len(grams)
    return int(np.packbits(ones).view(np.int64)[0])


def window_prints(grams: np.ndarray, starts: np.ndarray, held: int) -> np.ndarray:
    """SimHash of the ``held`` grams from each of ``starts`` (ascending)."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):                                # a stretch of the text at a time
        j = int(np.searchsorted(starts, starts[i] + STRETCH))
        low, s = starts[i], starts[i:j] - starts[i]
        bits = np.unpackbits(mix(grams[low:starts[j - 1] + held]).view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        out[i:j] = np.packbits((sums[s + held] - sums[s]) * 2 >= held, axis=1).view(np.uint64)[:, 0]
        i = j
    return out


class PrintIndex:
    """Multi-index over the fingerprints of the items of one length."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.blocks = prints, []
        near = np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1)
                         for c in combinations(range(BITS), k)], np.int64)
        for block in range(BLOCKS):
            filed = (block_value(prints, block)[:, None] ^ near).ravel()
            order = np.argsort(filed, kind="stable")
            self.blocks.append((np.searchsorted(filed[order], np.arange(2 ** BITS + 1)),
                                order // len(near)))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs at most RADIUS apart."""
        step = max(1, PAIRS // max(1, len(self.prints)))
        found = [np.zeros(0, np.int64)]
        for low in range(0, len(prints), step):
            mine = prints[low:low + step]
            pairs = []
            for block, (bounds, who) in enumerate(self.blocks):
                value = block_value(mine, block)
                many = bounds[value + 1] - bounds[value]
                at = np.repeat(np.arange(len(mine)), many)
                item = who[np.repeat(bounds[value] - (np.cumsum(many) - many), many) + np.arange(len(at))]
                close = np.bitwise_count(mine[at] ^ self.prints[item]) <= RADIUS
                pairs.append((at[close] + low) * len(self.prints) + item[close])
            found.append(np.unique(np.concatenate(pairs)))
        pairs = np.concatenate(found)
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


def block_value(prints: np.ndarray, block: int) -> np.ndarray:
    return ((prints >> np.uint64(BITS * block)) & np.uint64(2 ** BITS - 1)).astype(np.int64)


def items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, n_words, fingerprint and grams of items that have words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for ids, texts in text_blocks(batches):
            rows = []
            for i, t in zip(ids, texts, strict=True):
                w = words_of(t, hashes)
                if i is None or not len(w):
                    continue
                g = grams_of(w, min(N, len(w)))
                rows.append((i, len(w), simhash(g), np.sort(g).view(np.int64)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64()))],
                ["item_id", "n_words", "fingerprint", "grams"])

    return id_text(benchmark, id_col, text_col).withColumnRenamed("doc_id", "item_id").mapInArrow(
        run, "item_id long, n_words int, fingerprint long, grams array<long>")


def shared_grams(own: np.ndarray, w: np.ndarray, size: int, grams: np.ndarray, owners: np.ndarray,
                 counts: np.ndarray, lengths: np.ndarray, threshold: float):
    """(item, start, shared), ascending: from ``start`` to the next one of an item, the
    windows of the item's length share so many 5-grams with it. Items that share too few
    with the whole document for ``threshold`` are left out."""
    nothing = (np.zeros(0, np.int64),) * 3
    lo = np.searchsorted(grams, own)
    at = np.flatnonzero(grams[np.minimum(lo, len(grams) - 1)] == own)
    if not len(at):
        return nothing
    many = np.searchsorted(grams, own[at], side="right") - lo[at]
    pick = np.repeat(lo[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    place = np.repeat(at, many)
    item = owners[pick]
    length = lengths[item]
    held = np.minimum(length, len(w)) - size + 1          # grams of a window
    need = threshold * (length - size + 1 + held) / (1 + threshold) - 1e-6
    _, back, hits = np.unique(item, return_inverse=True, return_counts=True)
    keep = (np.minimum(length, N) == size) & (hits[back] >= need)
    if not keep.any():
        return nothing
    pick, place, item, length, held = (x[keep] for x in (pick, place, item, length, held))
    order = np.argsort(pick, kind="stable")               # by item's gram, then place
    pick, place, item, length, held = (x[order] for x in (pick, place, item, length, held))
    # an occurrence counts where fewer than the item's own lie before it in the window
    before = np.arange(len(pick)) - counts[pick]
    same = (before >= 0) & (pick[np.maximum(before, 0)] == pick)
    first = np.maximum(0, place - held + 1)
    first = np.where(same, np.maximum(first, place[np.maximum(before, 0)] + 1), first)
    beyond = np.minimum(place, np.maximum(0, len(w) - length)) + 1
    some = first < beyond
    who = np.concatenate([item[some], item[some]])
    start = np.concatenate([first[some], beyond[some]])
    step = np.repeat([1, -1], some.sum())
    order = np.lexsort((start, who))
    who, start, shared = who[order], start[order], np.cumsum(step[order])
    last = np.flatnonzero(np.r_[(who[1:] != who[:-1]) | (start[1:] != start[:-1]), True])
    return who[last], start[last], shared[last]


def similar_windows(w: np.ndarray, grams: np.ndarray, owners: np.ndarray, counts: np.ndarray,
                    lengths: np.ndarray, indexes: dict[int, tuple[np.ndarray, PrintIndex]],
                    threshold: float) -> list[tuple[int, int, float]]:
    """(item, start, similarity) of the first best window of every item, of those that
    the fingerprints propose and that reach the threshold.

    ``grams`` (sorted), ``owners`` and ``counts``: the distinct grams of the items,
    the item and how often it has the gram; ``lengths``: words of the items;
    ``indexes``: by length, the items and their fingerprints."""
    out = []
    for size in np.unique(np.minimum(lengths, N)).tolist():
        own = grams_of(w, size)
        if not len(own):
            continue
        who, start, shared = shared_grams(own, w, size, grams, owners, counts, lengths, threshold)
        for length in np.unique(lengths[who]).tolist():
            mine = np.flatnonzero(lengths[who] == length)
            item, low, common = who[mine], start[mine], shared[mine]
            some = np.flatnonzero(common > 0)             # the last start of an item shares nothing
            many = low[some + 1] - low[some]
            starts = np.unique(np.repeat(low[some] - (np.cumsum(many) - many), many) + np.arange(many.sum()))
            held = min(length, len(w)) - size + 1
            known, index = indexes[length]
            at, which = index.within(window_prints(own, starts, held))
            at, which = starts[at], known[which]
            # exact: what the window shares with the item it was proposed for
            wide = len(w) + 1
            seg = np.searchsorted(item * wide + low, which * wide + at, side="right") - 1
            both = np.where((seg >= 0) & (item[np.maximum(seg, 0)] == which), common[np.maximum(seg, 0)], 0)
            alike = both / (length - size + 1 + held - both)
            keep = alike >= threshold
            at, which, alike = at[keep], which[keep], alike[keep]
            order = np.lexsort((at, -alike, which))
            order = order[np.flatnonzero(np.r_[True, which[order][1:] != which[order][:-1]])] if len(order) else order
            out += zip(which[order].tolist(), at[order].tolist(), alike[order].tolist(), strict=True)
    return out


def windows(docs: DataFrame, known: tuple, threshold: float) -> DataFrame:
    """doc_id, same (names the item's text), similarity, start, n_words of the
    ``similar_windows``; ``known``: plain arrays, see ``contaminated``."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, prints, grams, owners, counts, lengths = shared.value
        indexes = {}
        for length in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == length)
            indexes[length] = mine, PrintIndex(prints[mine])
        hashes = _Hashes()
        for names, texts in text_blocks(batches):
            if len(hashes) > 500_000:
                hashes.clear()
            rows = [(d, int(ids[i]), alike, start, int(lengths[i]))
                    for d, t in zip(names, texts, strict=True)
                    for i, start, alike in similar_windows(words_of(t, hashes), grams, owners, counts,
                                                           lengths, indexes, threshold)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(
                    cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32()), strict=True)],
                ["doc_id", "same", "similarity", "start", "n_words"])

    return docs.mapInArrow(run, "doc_id long, same long, similarity double, start long, n_words int")


def contaminated(df: DataFrame, benchmark: DataFrame, threshold: float = 0.8,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start (word), n_words: the best window of every
    document and item with a weighted similarity of ``threshold`` or more.

    Null, empty and wordless texts and items match nothing; an item of under
    five words is one gram; repeated documents or items give one row per pair of
    ids; a document shorter than an item is one window; columns besides those
    named are not read; without documents or items there are no rows."""
    docs = id_text(df, id_col, text_col)
    every = stage(items(benchmark, item_col, item_text_col), "decontaminate-items")
    every = every.withColumn("same", F.xxhash64("n_words", "grams"))   # equal items: one text
    known = stage(every.groupBy("same").agg(*[F.first(c).alias(c) for c in (
        "n_words", "grams", "fingerprint")]), "decontaminate-distinct")
    total = known.agg(F.sum(F.size("grams"))).first()[0] or 0
    blocks = -(-total // BLOCK_GRAMS)
    parts = []
    for i in range(blocks):                               # a block of items at a time
        rows = known.filter(F.pmod("same", F.lit(blocks)) == i).orderBy("same").collect()
        if not rows:
            continue
        each = [np.unique(np.array(r.grams, np.int64).view(np.uint64), return_counts=True) for r in rows]
        gram = np.concatenate([g for g, _ in each])
        order = np.argsort(gram, kind="stable")
        owner = np.repeat(np.arange(len(rows)), [len(g) for g, _ in each])[order]
        count = np.concatenate([c for _, c in each])[order]
        parts.append(windows(docs, (
            np.array([r.same for r in rows], np.int64),
            np.array([r.fingerprint for r in rows], np.int64).view(np.uint64),
            gram[order], owner, count, np.array([r.n_words for r in rows], np.int64)), threshold))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, similarity double, start long, n_words int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return (found.join(every.select("same", "item_id"), "same").groupBy("doc_id", "item_id")
            .agg(F.max_by(F.struct("similarity", "start", "n_words"),
                          F.struct("similarity", -F.col("start"), "n_words")).alias("best"))
            .select("doc_id", "item_id", "best.*"))
